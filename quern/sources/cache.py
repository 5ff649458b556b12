"""Parsed graphs kept as Parquet, by content and profile."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import __version__
from quern.operators.hashing import profiled
from quern.sources.schema import Schema
from quern.sources.step import File, read_graph, read_step

#: Entries that are kept; the ones written first go.
MAX_ENTRIES = 64


def content_key(spark: SparkSession, path: str, profile: str) -> str:
    """Version, digest of the file's bytes (made where they are read) and profile."""
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    return f"{__version__}_{digest}_{hashlib.sha256(profile.encode()).hexdigest()[:8]}"


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cached_graph(spark: SparkSession, path: str, cache: str, profile: str = "semantic_stable", schema: Schema | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph of a file as the profile sees it, from the cache folder if it has been read before.

    Tables are written beside and renamed, so a reader never sees half of one.
    """
    place = f"{cache.rstrip('/')}/{content_key(spark, path, profile)}"
    target, fs = _fs(spark, place)
    if not fs.exists(target):
        entities, refs = profiled(*read_step(spark, path, schema), profile)
        entities.write.mode("overwrite").parquet(f"{place}.part/entities")
        refs.write.mode("overwrite").parquet(f"{place}.part/refs")
        part, _ = _fs(spark, f"{place}.part")
        if not fs.rename(part, target):
            fs.delete(part, True)
        evict(spark, cache)
    return spark.read.parquet(f"{place}/entities"), spark.read.parquet(f"{place}/refs")


def evict(spark: SparkSession, cache: str, most: int = MAX_ENTRIES) -> None:
    path, fs = _fs(spark, cache)
    entries = sorted(fs.listStatus(path), key=lambda s: s.getModificationTime())
    for status in entries[: max(0, len(entries) - most)]:
        fs.delete(status.getPath(), True)


def clear_cache(spark: SparkSession, cache: str) -> None:
    path, fs = _fs(spark, cache)
    fs.delete(path, True)


#: Graphs read by this process, by path, time and length of the file; the first ones read go.
_KEPT: dict[tuple, File] = {}
MOST_KEPT = 32


def kept_graph(spark: SparkSession, path: str, schema: Schema | None = None) -> File:
    """The graph of a file, parsed once in a process as long as the file stays as it is."""
    status = _fs(spark, path)
    status = status[1].getFileStatus(status[0])
    key = status.getPath().toString(), status.getModificationTime(), status.getLen(), spark.sparkContext.applicationId
    if key not in _KEPT:
        _KEPT[key] = read_graph(spark, path, schema)
        for old in [*_KEPT][: max(0, len(_KEPT) - MOST_KEPT)]:
            del _KEPT[old]
    return _KEPT[key]
