"""Intermediate tables in the folder that driver and executors share.

A table written there cuts a plan's lineage as ``checkpoint()`` does and is
read again, column by column, as often as needed. It survives lost executors.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_written: list[str] = []
_per_worker: list = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder is set on a local master (tests);
    on a cluster that would be one machine's disk, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder, and read from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quern-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def hinted(table: DataFrame, rows: int) -> DataFrame:
    """A stored table with a broadcast hint if it has at most ``rows`` rows; beyond that joins shuffle it."""
    return F.broadcast(table) if table.count() <= rows else table


def veiled(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str], Callable[..., list]]:
    """``docs`` with columns named c0, c1, ... so that no name clashes with those of an operator, which begin with ``_``.

    Also the new names of the ``wanted`` columns, and a function that gives
    the select list of the old names; keywords put something else in a column's place.
    """
    names = docs.columns
    low = [n.lower() for n in names]
    hidden = [f"c{i}" for i in range(len(names))]
    at = [hidden[names.index(w) if w in names else low.index(w.lower())] for w in wanted]

    def restored(**instead) -> list:
        return [F.col(instead.get(h, h)).alias(n) for h, n in zip(hidden, names)]

    return docs.toDF(*hidden), at, restored


def local_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a DataFrame.

    Spark reads a list that ``createDataFrame`` gets in Python workers of
    another kind than those of ``mapInArrow``: each executor then holds a
    second daemon and as many workers again. Arrow rows need none.
    """
    kinds = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kinds)
    columns = zip(*rows) if rows else ((),) * len(arrow)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), kinds)


def small_batches(spark: SparkSession, most: int = 1 << 20) -> None:
    """Let Arrow batches of whole texts end at ``most`` bytes, on this session, unless they already end sooner.

    By rows alone, a batch of long documents could be larger than a task's memory.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most:
        spark.conf.set(key, str(most))


def per_worker(most: int) -> Callable:
    """As ``lru_cache``, of what the tasks of one operator share in a Python worker; :func:`lean_memory` ends it."""

    def of(make: Callable) -> Callable:
        made = lru_cache(most)(make)
        _per_worker.append(made)
        return made

    return of


@lru_cache(1)
def _allocator() -> ctypes.CDLL | None:
    """The C library, told to map blocks of a megabyte or more by themselves and to keep little that is free; None if it is not glibc."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD; by itself it follows the largest block freed, to 32 MB
        libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
        return libc if libc.malloc_trim else None
    except (AttributeError, OSError):
        return None


def lean_memory(used: Callable | None = None) -> None:
    """In a Python worker, as a task begins: give back to the system what earlier tasks left.

    Workers outlive their stage, so what operators
    keep :func:`per_worker` goes as well, but for ``used``, which this task's operator uses. Arrow and
    the C library return freed buffers instead of keeping them.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    for made in _per_worker:
        if made is not used:
            made.cache_clear()
    if _allocator():
        _allocator().malloc_trim(0)


def mark() -> int:
    """A point in time for :func:`forget`."""
    return len(_written)


def forget(spark: SparkSession, since: int, until: int | None = None) -> None:
    """Delete the tables stored between two marks; nothing may read them any more."""
    doomed = _written[since:until]
    del _written[since:until]
    jvm = spark._jvm
    for path in doomed:
        place = jvm.org.apache.hadoop.fs.Path(path).getParent()
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
