"""Sharding along a Hilbert curve through quantised metadata, by column expressions only.

Each dimension is quantised to ``bits`` bits; the curve index of a cell comes
from a fold over its bits through the curve's state table. Rows are put in
order of curve index and the order is cut into runs of equal counts, so that a
shard covers few ranges of every dimension and a reader's filters on any of
them prune files.

The global position of a row is its position within a small group plus the
number of rows before that group. Groups are cells, and a cell with more than
``run`` rows is split by a hash of the id, so no task sorts a hot cell. The
table of cells is broadcast where it has at most 500,000 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm._store import hinted, stored, veiled

#: Modulus (a prime) and factor of the hash that splits a hot cell.
SPLIT_MODULUS, SPLIT_FACTOR = 1_048_573, 2_654_435_761


def magnitude(size: Column, bits: int) -> Column:
    """Number of the steps 2 ** (k / 1.5), k from 1, that a positive long reaches, in ``bits`` bits.

    Whole thresholds are compared, so that other engines get the same codes.
    """
    steps = [round(2 ** (k / 1.5)) for k in range(1, 1 << bits)]
    return sum(((size >= F.lit(t)).cast("long") for t in steps[1:]), (size >= F.lit(steps[0])).cast("long"))


def curve_table(n: int) -> list[int]:
    """For each state and corner of the n-dimensional curve: next state * 2**n + rank of the corner.

    A state is the corner where the curve enters and the axis along which it
    leaves (Hamilton and Rau-Chaplin, Compact Hilbert indices).
    """
    full = (1 << n) - 1

    def turn(x: int, by: int) -> int:
        by %= n
        return (x << by | x >> (n - by)) & full

    def gray(w: int) -> int:
        return w ^ w >> 1

    rank = {gray(w): w for w in range(1 << n)}
    ones = [next(i for i in range(n + 1) if not w >> i & 1) for w in range(1 << n)]
    table = []
    for entry in range(1 << n):
        for axis in range(n):
            for corner in range(1 << n):
                w = rank[turn(corner ^ entry, -(axis + 1))]
                enter = gray(2 * ((w - 1) // 2)) if w else 0
                leave = 0 if not w else ones[w] if w & 1 else ones[w - 1]
                table.append(((entry ^ turn(enter, axis + 1)) * n + (axis + leave + 1) % n << n) + w)
    return table


def curve_index(codes: list[Column], bits: int) -> Column:
    """Hilbert index of a cell; the first code is the lowest bit of each corner."""
    n = len(codes)
    table = F.array(*map(F.lit, curve_table(n)))

    def step(acc: Column, i: Column) -> Column:
        corner = F.lit(0).cast("long")
        for k, c in enumerate(codes):
            corner = corner + F.call_function("shiftright", c, i).bitwiseAND(F.lit(1)).cast("long") * (1 << k)
        entry = F.get(table, (F.shiftleft(acc["state"], n) + corner).cast("int")).cast("long")
        return F.struct((F.shiftleft(acc["index"], n) + entry.bitwiseAND(F.lit((1 << n) - 1))).alias("index"), F.shiftright(entry, n).alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).cast("long").alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step)["index"]


def _category_codes(docs: DataFrame, col: str, bits: int) -> DataFrame:
    """Rank of each value among the distinct ones (null first), scaled to ``bits`` bits."""
    values = docs.groupBy(F.col(col).alias("v")).count()
    rank, n = F.row_number().over(W.orderBy(F.col("v").asc_nulls_first())) - 1, F.count("*").over(W.partitionBy())
    return values.select("v", F.floor(rank * (1 << bits) / n).cast("long").alias("code"))


def hilbert_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source"), bits: int = 5, run: int = 65_536) -> DataFrame:
    """Every row of ``docs`` with its place: columns size, text_crc32, hilbert_index, shard and slot.

    Dimensions are the ``categories`` and the magnitude (log2, stepped) of the
    size, UTF-8 bytes of the text plus one. Shard counts differ by at most
    one; slots run from 0 without gaps within a shard. Within a cell rows are
    ordered by id, size and checksum; rows equal in all of them may swap.
    Null texts count as no bytes, null ids come first, null categories are
    values of their own; texts of any length are whole, and an empty table
    stays empty. Equal texts may go to several shards: the law is that counts
    are even, which a large group of copies kept together would break.
    Columns of ``docs`` that already have one of the five names are replaced,
    others pass through whatever their names.
    """
    docs, (id_col, text_col, *categories), restored = veiled(docs.drop("size", "text_crc32", "hilbert_index", "shard", "slot"), id_col, text_col, *categories)
    rows = docs
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = rows.withColumn("size", F.octet_length(text).cast("long") + 1).withColumn("text_crc32", F.crc32(text))
    rows = rows.withColumn("_c0", magnitude(F.col("size"), bits))
    for k, col in enumerate(categories, 1):
        codes = _category_codes(docs, col, bits).select(F.col("v").alias("_v"), F.col("code").alias(f"_c{k}"))
        rows = rows.join(codes, rows[col].eqNullSafe(codes["_v"])).drop("_v")
    axes = [f"_c{k}" for k in range(len(categories) + 1)]
    cells = rows.groupBy(*axes).agg(F.count("*").alias("n"))
    cells = cells.select(*axes, curve_index([F.col(c) for c in axes], bits).alias("hilbert_index"), F.ceil(F.col("n") / run).alias("_parts"))
    mixed = F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(SPLIT_MODULUS)) * SPLIT_FACTOR + F.col("text_crc32")
    part = F.floor(F.pmod(mixed, F.lit(1 << 32)) * F.col("_parts") / float(1 << 32)).cast("long")
    rows = rows.join(hinted(stored(cells, "cells"), 500_000), axes).withColumn("_part", part)
    groups = rows.groupBy("hilbert_index", "_part").agg(F.count("*").alias("_n"))
    ordered = W.orderBy("hilbert_index", "_part")
    before = F.sum("_n").over(ordered) - F.col("_n")
    groups = groups.select("hilbert_index", "_part", before.alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_total"))
    rows = rows.join(groups, ["hilbert_index", "_part"])
    within = W.partitionBy("hilbert_index", "_part").orderBy(F.col(id_col).asc_nulls_first(), "size", "text_crc32")
    at = F.col("_before") + F.row_number().over(within) - 1
    rows = rows.withColumn("_at", at.cast("long"))
    base, more = F.expr(f"_total div {shards}"), F.expr(f"_total % {shards}")
    long_rows = more * (base + 1)
    shard = F.when(F.col("_at") < long_rows, F.floor(F.col("_at") / (base + 1))).otherwise(more + F.floor((F.col("_at") - long_rows) / F.greatest(base, F.lit(1))))
    rows = rows.withColumn("shard", shard.cast("int"))
    first = F.when(F.col("shard") < more, F.col("shard") * (base + 1)).otherwise(long_rows + (F.col("shard") - more) * base)
    rows = rows.withColumn("slot", (F.col("_at") - first).cast("long"))
    return rows.select(*restored(), "size", "text_crc32", "hilbert_index", "shard", "slot")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder of Parquet for each shard, its rows in order of slot."""
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
