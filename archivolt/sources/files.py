"""The file census as a source: a walk of folder trees, in parallel over their subfolders."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.globs import DENY, glob_regex
from .routing import scan_outcome, sniff_type

SCHEMA = "path string, root string, ext string, size bigint, inode bigint, mtime double, head binary, problem string"


class _Folder(InputPartition):
    def __init__(self, root: str, folder: str, deep: bool):
        self.root, self.folder, self.deep = root, folder, deep


class FolderReader(DataSourceReader):
    """Lists files without following links or leaving the device; denied folders are never entered."""

    def __init__(self, options):
        import json
        import re

        self.roots = json.loads(options.get("roots", "[]"))
        globs = [g.lower() for g in json.loads(options.get("deny", "null")) or DENY]
        self.named = [re.compile(glob_regex(g)) for g in globs if "/" not in g]
        self.whole = [re.compile(glob_regex(g)) for g in globs if "/" in g] + [re.compile(glob_regex(g.rstrip("/*"))) for g in globs if "/" in g]

    def _denied(self, path: str) -> bool:
        low = path.lower()
        name = low.rsplit("/", 1)[-1]
        return any(p.match(name) for p in self.named) or any(p.match(low) for p in self.whole)

    def partitions(self) -> Sequence[InputPartition]:
        """One task for each top folder of a root, and one for the root's own files."""
        out: list[InputPartition] = []
        for root in self.roots:
            root = root.rstrip("/") or "/"
            if not os.path.isdir(root):
                continue
            out.append(_Folder(root, root, False))
            with os.scandir(root) as entries:
                out += [_Folder(root, e.path, True) for e in sorted(entries, key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and not self._denied(e.path)]
        return out or [_Folder("", "", False)]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        if not partition.folder:
            return
        device = os.stat(partition.root).st_dev
        todo = [partition.folder]
        while todo:
            folder = todo.pop()
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                if e.is_symlink():
                    continue
                if e.is_dir(follow_symlinks=False):
                    if partition.deep and not self._denied(e.path) and e.stat(follow_symlinks=False).st_dev == device:
                        todo.append(e.path)
                    continue
                yield self._row(partition.root, e)

    @staticmethod
    def _row(root: str, e: os.DirEntry) -> tuple:
        ext = os.path.splitext(e.name)[1].lower()
        try:
            s = e.stat(follow_symlinks=False)
            if not stat.S_ISREG(s.st_mode):
                return e.path, root, ext, 0, 0, 0.0, None, "unreadable"
            if s.st_size and not s.st_blocks:
                return e.path, root, ext, s.st_size, s.st_ino, s.st_mtime, None, "dataless"
            with open(e.path, "rb") as fh:
                return e.path, root, ext, s.st_size, s.st_ino, s.st_mtime, fh.read(16), None
        except OSError:
            return e.path, root, ext, 0, 0, 0.0, None, "unreadable"


class FolderSource(DataSource):
    """``spark.read.format("archivolt_folders").option("roots", json)``."""

    @classmethod
    def name(cls) -> str:
        return "archivolt_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)


def walk(spark: SparkSession, roots: list[str], deny: Sequence[str] = DENY) -> DataFrame:
    """The files below ``roots``: path, root, ext, size, inode, mtime, head (16 bytes), problem."""
    import json

    spark.dataSource.register(FolderSource)
    return spark.read.format("archivolt_folders").option("roots", json.dumps(roots)).option("deny", json.dumps(list(deny))).load()


def scan(spark: SparkSession, roots: list[str], deny: Sequence[str] = DENY, most_bytes: int = 104_857_600) -> DataFrame:
    """The stat pass of a census: the walk with mime and scan_status."""
    from ..functions.globs import denied_by

    rows = walk(spark, roots, deny).withColumn("mime", sniff_type(F.col("ext"), F.col("head")))
    outcome = scan_outcome(denied_by(F.col("path"), deny), F.col("size"), F.col("ext"), F.col("mime"), most_bytes)
    return rows.withColumn("scan_status", F.coalesce("problem", outcome)).drop("head", "problem")


def _hash_blocks(batches):
    """path, size -> path, hash: SHA-256 by blocks of 1 MiB; null where a file cannot be read."""
    import hashlib

    import pandas as pd

    for batch in batches:
        out = []
        for path in batch["path"]:
            digest = hashlib.sha256()
            try:
                with open(path, "rb") as fh:
                    while block := fh.read(1 << 20):
                        digest.update(block)
                out.append(digest.hexdigest())
            except OSError:
                out.append(None)
        yield pd.DataFrame({"path": batch["path"], "hash": out})


def _spread(paths: DataFrame, parts: int | None) -> DataFrame:
    """``paths`` over the tasks by a hash of the path, as large and small files come in any order."""
    return paths.repartition(parts, F.xxhash64("path")) if parts else paths.repartition(F.xxhash64("path"))


def hash_files(paths: DataFrame, parts: int | None = None) -> DataFrame:
    """path, hash of the files that ``paths`` names, and of no others."""
    return _spread(paths.select("path"), parts).mapInPandas(_hash_blocks, "path string, hash string")


def _contents(batches):
    import pandas as pd

    for batch in batches:
        for path in batch["path"]:  # one file at a time
            try:
                with open(path, "rb") as fh:
                    content = fh.read()
            except OSError:
                content = None
            yield pd.DataFrame({"path": [path], "content": pd.Series([content], dtype=object)})


def read_files(paths: DataFrame, parts: int | None = None) -> DataFrame:
    """path, content of the files that ``paths`` names, and of no others; null where a file cannot be read."""
    return _spread(paths.select("path"), parts).mapInPandas(_contents, "path string, content binary")


def content_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, hash (SHA-256) of files or folders of files, read by Spark."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return rows.select(F.regexp_replace(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/*", "/").alias("path"), F.sha2("content", 256).alias("hash"))
