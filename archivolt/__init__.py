"""archivolt: a Spark-native engine for building and querying a document catalogue."""

__version__ = "0.1.0"
