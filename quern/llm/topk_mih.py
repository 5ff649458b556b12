"""Exact k nearest binary codes by incremental multi-index hashing.

A code is cut into segments of somewhat less than log2(n) bits for n distinct
codes, and codes are indexed by each segment's value, so a probe meets a few
codes at any size. For radius 0, 1, 2, ... every unresolved query probes, in each
segment, the values at exactly that Hamming distance from its own. After
radius r every code within ``segments * (r + 1) - 1`` has been met, since a
code further off in all segments would be further off in sum. A query is
resolved once its k-th verified distance is within that bound.

Probing, verification (an xor and a bit count) and ranking are joins and
windows of column expressions; the values to probe are made by generators, bit
by bit. A pair is taken only in its least distant segment, so no pair is met
twice. Once a radius has more values to probe than there are codes, the
queries still open are held against all codes, in blocks. Rows with equal
codes are one code with its k + 1 least ids.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm._store import stored


def sign_code(vector: Column) -> Column:
    """An array of longs, 64 components each: bit i is set if component i is over zero. Null for null, empty or incomplete vectors."""
    none = F.lit(0).cast("long")

    def word(at: Column) -> Column:
        bits = F.transform(F.slice(vector, at * 64 + 1, F.lit(64)), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(none))
        return F.aggregate(bits, none, lambda acc, b: acc.bitwiseOR(b))

    whole = vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return F.when(whole, F.transform(F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / 64).cast("int")), word))


def _segments(n: int, words: int) -> list[tuple[int, int, int]]:
    """(word, first bit, width) of each segment, for ``n`` distinct codes: one more than makes a bucket of one, as probes grow faster than buckets."""
    each = min(8, max(2, round(64 / math.log2(max(4, n))) + 1))
    cuts = [round(64 * i / each) for i in range(each + 1)]
    return [(word, lo, hi - lo) for word in range(words) for lo, hi in zip(cuts, cuts[1:])]


def _as_words(code: Column, kind: str, words: int) -> Column:
    """The code as an array of ``words`` longs; words that it lacks are zero."""
    code = F.array(code.cast("long")) if not kind.startswith("array") else code.cast("array<long>")
    return F.array(*(F.coalesce(F.get(code, F.lit(i)), F.lit(0)).cast("long") for i in range(words)))


def _apart(words: int) -> Column:
    return sum((F.bit_count(F.get("code", F.lit(i)).bitwiseXOR(F.get("q", F.lit(i)))) for i in range(1, words)), F.bit_count(F.get("code", F.lit(0)).bitwiseXOR(F.get("q", F.lit(0)))))


def _probes(open_q: DataFrame, cuts: list[tuple[int, int, int]], r: int, tasks: int) -> DataFrame:
    """(q, bound, seg, val): in each segment the values at distance ``r`` from the query's own."""
    own = F.array(*(F.struct(F.shiftrightunsigned(F.get("q", F.lit(w)), lo).bitwiseAND(F.lit((1 << width) - 1)).alias("val"), F.lit(width).alias("width")) for w, lo, width in cuts))
    rows = open_q.repartition(tasks, "q").select("q", "bound", F.posexplode(own).alias("seg", "own"))
    rows = rows.select("q", "bound", "seg", F.col("own.val").alias("val"), F.col("own.width").alias("width"), F.lit(-1).alias("at")).where(F.col("width") >= r)
    for left in range(r, 0, -1):
        rows = rows.select("q", "bound", "seg", "val", "width", F.explode(F.sequence(F.col("at") + 1, F.col("width") - left)).alias("at"))
        rows = rows.withColumn("val", F.col("val").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))))
    return rows.select("q", "bound", "seg", "val")


def nearest_codes(queries: DataFrame, codes: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, neighbor_id, distance)``: for each query its ``k`` nearest other rows.

    ``queries`` and ``codes`` have columns id and code, a long or an array of
    longs of any length (bits that a shorter one lacks are zero); other
    columns are ignored, whatever their names. Rows are ordered by distance,
    then id; a query never finds the row with its own id. With fewer than
    ``k`` other rows all are returned. Null ids or codes are left out, and
    repeated rows are found once for each id and code. Without queries or
    codes the result is empty.
    """
    spark = codes.sparkSession
    kinds = dict(codes.dtypes)["code"], dict(queries.dtypes)["code"]
    words = max([1, *(table.agg(F.max(F.size("code"))).first()[0] or 1 for table, kind in zip((codes, queries), kinds) if kind.startswith("array"))])
    rows = codes.select(F.col("id").cast("long"), F.when(F.col("code").isNotNull(), _as_words(F.col("code"), kinds[0], words)).alias("code")).where("id is not null and code is not null").distinct()
    asks = queries.select(F.col("id").cast("long").alias("query_id"), F.when(F.col("code").isNotNull(), _as_words(F.col("code"), kinds[1], words)).alias("q"))
    asks = stored(asks.where("query_id is not null and q is not null").distinct(), "asks")
    least = rows.withColumn("r", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("r") <= k + 1)
    ids = stored(least.select("code", "id", "r"), "ids")
    firsts = ids.where("r = 1").select("code", F.col("id").alias("least"))
    n = firsts.count()
    cuts = _segments(n, words)
    value = lambda c, w, lo, width: F.shiftrightunsigned(F.get(c, F.lit(w)), lo).bitwiseAND(F.lit((1 << width) - 1))
    index = stored(firsts.select("code", "least", F.posexplode(F.array(*(value("code", *cut) for cut in cuts))).alias("seg", "val")), "index")
    away = [F.bit_count(value("code", *cut).bitwiseXOR(value("q", *cut))) for cut in cuts]
    tasks = spark.sparkContext.defaultParallelism
    most = 64 * words
    # With each open code the distance that a find must not exceed: the k-th so far of its queries.
    open_q = asks.select("q", F.lit(most).alias("bound")).distinct()
    best: DataFrame | None = None
    order = W.partitionBy("query_id").orderBy("distance", "neighbor_id")
    for r in range(max(width for *_, width in cuts) + 1):
        scan = sum(math.comb(width, r) for *_, width in cuts) > max(1024, n)
        if scan:
            blocks = F.sequence(F.lit(0), F.lit(4 * tasks - 1))
            met = open_q.select("q", "bound", F.explode(blocks).alias("block")).hint("merge").join(firsts.withColumn("block", F.pmod(F.xxhash64("code"), F.lit(4 * tasks)).cast("int")), "block")
            fresh = F.least(*away) >= r if len(away) > 1 else away[0] >= r
        else:
            # Generators make far more rows than the planner expects; by its estimate it would broadcast them.
            met = _probes(open_q, cuts, r, tasks).hint("merge").join(index, ["seg", "val"])
            # Only in the first of the segments that are nearest.
            fresh = F.lit(True)
            for s, d in enumerate(away):
                fresh = fresh & F.when(F.col("seg") > s, d > r).otherwise(d >= r)
        met = met.where(fresh & (_apart(words) <= F.col("bound"))).select("q", "code", "least", _apart(words).alias("distance"))
        # No query needs more than the k + 1 codes that come first by distance and least id (each has an id, one may be its own).
        met = met.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("distance", "least"))).where(F.col("r") <= k + 1).select("q", "code", "distance")
        found = met.join(ids, "code").join(asks, "q").where("id <> query_id").select("query_id", "q", F.col("id").alias("neighbor_id"), "distance")
        found = found if best is None else found.union(best)
        best = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "best")
        covered = len(cuts) * (r + 1) - 1
        if scan or covered >= most:
            break
        so_far = best.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("d"))
        so_far = asks.join(so_far, "query_id", "left").select("q", F.when(F.col("n") == k, F.col("d")).otherwise(most).alias("bound"))
        open_q = stored(so_far.where(F.col("bound") > covered).groupBy("q").agg(F.max("bound").alias("bound")), "open")
        if open_q.isEmpty():
            break
    return best.select("query_id", F.row_number().over(order).cast("long").alias("rank"), "neighbor_id", F.col("distance").cast("long").alias("distance"))
