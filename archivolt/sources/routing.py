"""Which extractor reads a file: types by extension and by leading bytes, routes, page decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions by route, types by extension, leading bytes of types.
DOCUMENT_TEXT = (".txt", ".md", ".markdown", ".mdx", ".rst", ".org", ".text", ".csv", ".tsv", ".tex", ".bib", ".vtt", ".srt")
CODE_TEXT = (
    ".json", ".jsonl", ".ndjson", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".env", ".properties", ".xml", ".svg", ".py", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".astro", ".vue", ".sh", ".bash", ".zsh", ".sql", ".go",
    ".rs", ".java", ".c", ".h", ".cpp", ".hpp", ".cs", ".rb", ".php", ".swift", ".kt", ".lua", ".r", ".pl", ".m", ".scala", ".dart", ".gradle", ".css", ".scss", ".dockerfile", ".makefile",
)
OFFICE = (".docx", ".doc", ".xlsx", ".xls", ".xlsm", ".pptx", ".ppt", ".odt", ".ods", ".odp", ".rtf", ".msg", ".pages", ".numbers", ".key", ".html", ".htm", ".xhtml", ".epub")
IMAGE = (".png", ".jpg", ".jpeg", ".tiff", ".tif", ".heic", ".bmp", ".webp")
TEXT_TYPES = ("text/plain", "text/markdown", "text/csv", "application/json")
TYPES = {
    ".pdf": "application/pdf", ".txt": "text/plain", ".md": "text/markdown", ".csv": "text/csv", ".html": "text/html", ".htm": "text/html", ".json": "application/json", ".xml": "text/xml", ".rtf": "application/rtf", ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".epub": "application/epub+zip", ".py": "text/x-python", ".zip": "application/zip", ".gz": "application/gzip",
}
LEADING = (
    ("25504446", "application/pdf"), ("504B0304", "application/zip"), ("D0CF11E0", "application/x-ole-storage"), ("7B5C727466", "application/rtf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"),
    ("53514C69746520666F726D6174203300", "application/vnd.sqlite3"), ("7F454C46", "application/x-executable"), ("CFFAEDFE", "application/x-mach-binary"), ("1F8B", "application/gzip"),
)
OCTETS = "application/octet-stream"


def type_by_extension(ext: Column) -> Column:
    """The media type that an extension stands for, or null."""
    pairs = [F.lit(x) for kv in TYPES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(ext))


def sniff_type(ext: Column, head: Column) -> Column:
    """The type by extension, else by the leading bytes (binary): an empty file, UTF-8 text, or octets."""
    hexed = F.hex(head)
    out = F.when(F.length(head) == 0, "application/x-empty").when(F.is_valid_utf8(head.cast("string")), "text/plain").otherwise(OCTETS)
    for prefix, kind in reversed(LEADING):
        refined = F.when(F.lower(ext).isin(".docx", ".xlsx", ".pptx", ".epub"), type_by_extension(ext)).otherwise(kind) if kind == "application/zip" else F.lit(kind)
        out = F.when(F.startswith(hexed, F.lit(prefix)), refined).otherwise(out)
    return F.coalesce(type_by_extension(ext), out)


def route(ext: Column, mime: Column, source_code: bool = False, images: bool = False) -> Column:
    """pdf, office, plain, image or skip."""
    e = F.lower(F.coalesce(ext, F.lit("")))
    code = F.lit("plain" if source_code else "skip")
    text = mime.isin(*TEXT_TYPES) | F.startswith(mime, F.lit("text/"))
    return (
        F.when((e == ".pdf") | (mime == "application/pdf"), "pdf")
        .when(e.isin(*OFFICE), "office")
        .when(e.isin(*DOCUMENT_TEXT), "plain")
        .when(e.isin(*CODE_TEXT), code)
        .when(e.isin(*IMAGE), "image" if images else "skip")
        .when((e == "") & text, code)
        .otherwise("skip")
    )


def scan_outcome(denied: Column, size: Column, ext: Column, mime: Column, most_bytes: int = 104_857_600) -> Column:
    """denied, too_large, no_route or included."""
    return F.when(denied.isNotNull(), "denied").when(size > most_bytes, "too_large").when(route(ext, mime) == "skip", "no_route").otherwise("included")


def sampled_pages(pages: Column, sample: int = 8) -> Column:
    """At most ``sample`` page numbers (from 0), evenly spaced."""
    n = F.least(pages, F.lit(sample))
    return F.when(pages > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(i * pages / n).cast("int")))).otherwise(F.array().cast("array<int>"))


def page_texts(extracts: DataFrame) -> DataFrame:
    """extract_path, page (from 0), text: the pages of extracted texts that carry page markers."""
    rows = extracts.filter(F.col("extract_path").isNotNull() & F.col("text").isNotNull()).groupBy("extract_path").agg(F.min("text").alias("text"))
    rows = rows.filter(F.col("text").rlike(r"<!-- page \d+ -->"))
    parts = F.slice(F.split("text", r"<!-- page \d+ -->"), 2, 1 << 20)
    return rows.select("extract_path", F.posexplode(parts).alias("page", "text")).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))


def page_decision(pages: DataFrame, thin_chars: int = 100, share: float = 0.6, sample: int = 8) -> DataFrame:
    """extract_path, pages, thin_pages, decision: ``ocr`` where at least ``share`` of the sampled pages hold fewer
    than ``thin_chars`` characters, ``hybrid`` where any page does, else ``text``."""
    thin = F.length("text") < thin_chars
    sizes = pages.groupBy("extract_path").agg(F.count(F.lit(1)).cast("int").alias("pages"), F.sum(thin.cast("int")).alias("thin_pages"))
    taken = sizes.select("extract_path", F.explode(sampled_pages(F.col("pages"), sample)).alias("page"))
    sampled = pages.join(taken, ["extract_path", "page"]).groupBy("extract_path").agg(F.avg(thin.cast("double")).alias("share"))
    decision = F.when(F.col("share") >= share, "ocr").when(F.col("thin_pages") > 0, "hybrid").otherwise("text")
    return sizes.join(sampled, "extract_path").select("extract_path", F.col("pages").cast("long").alias("pages"), F.col("thin_pages").cast("long").alias("thin_pages"), decision.alias("decision"))
