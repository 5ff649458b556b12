"""Matching of signature rows: candidates, confidence, one-to-one assignment and the report of aspects.

A signature row has step_id, guid, canonical_class, vh_geometry, vh_data,
vh_topology, placement (array of longs) and centroid (array of three doubles, metres).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.spatial import delta_mm
from quern.plans.loops import connected, stored

#: Default radius in metres and least score of a match; priority of reasons.
RADIUS_M, MIN_SCORE = 0.5, 0.3
PRIORITY = {"guid": 0, "geometry_hash": 1, "spatial_fallback": 2}


def radius(value: float | None) -> float:
    return value if value and value > 0 else RADIUS_M


def equi_candidates(old: DataFrame, new: DataFrame, key: str, reason: str) -> DataFrame:
    """All pairs of rows with the same key; null and empty keys pair with nothing."""
    sides = [s.where(F.col(key) != "").select(key, F.col("step_id").alias(n)) for s, n in ((old, "old_step"), (new, "new_step"))]
    return sides[0].join(sides[1], key).select("old_step", "new_step", F.lit(reason).alias("reason"))


def _matched(one: DataFrame, other: DataFrame) -> DataFrame:
    """Steps of ``one`` that have a candidate in ``other``, by semi-joins instead of the pairs."""
    found = None
    for key in ("guid", "vh_geometry"):
        hit = one.where(F.col(key) != "").join(other.where(F.col(key) != "").select(key), key, "left_semi").select("step_id")
        found = hit if found is None else found.union(hit)
    return found


def spatial_candidates(old: DataFrame, new: DataFrame, radius_m: float = RADIUS_M) -> DataFrame:
    """Pairs of one class within the radius, of rows that no other rule pairs.

    Space is cut into cells of the radius: a new row is put into its cell, an
    old one into its own and the 26 around, so the join is by equality.
    """
    size = radius(radius_m)
    left = old.join(_matched(old, new), "step_id", "left_anti").where("centroid IS NOT NULL").select(F.col("step_id").alias("old_step"), "canonical_class", F.col("centroid").alias("p"))
    right = new.join(_matched(new, old), "step_id", "left_anti").where("centroid IS NOT NULL").select(F.col("step_id").alias("new_step"), "canonical_class", F.col("centroid").alias("q"))
    around = [F.array(*map(F.lit, (i, j, k))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    left = left.select("*", F.explode(F.array(*around)).alias("by"))
    left = left.select("old_step", "canonical_class", "p", *((F.floor(F.col("p")[k] / size) + F.col("by")[k]).alias(f"c{k}") for k in range(3)))
    right = right.select("new_step", "canonical_class", "q", *(F.floor(F.col("q")[k] / size).alias(f"c{k}") for k in range(3)))
    apart = sum((F.col("p")[k] - F.col("q")[k]) * (F.col("p")[k] - F.col("q")[k]) for k in range(3))
    near = left.join(right, ["canonical_class", "c0", "c1", "c2"]).where(apart <= size * size)
    return near.select("old_step", "new_step", F.lit("spatial_fallback").alias("reason"))


def candidates(old: DataFrame, new: DataFrame, radius_m: float = RADIUS_M) -> DataFrame:
    """(old_step, new_step, reason), each pair once with the reason of highest priority."""
    pairs = equi_candidates(old, new, "guid", "guid").union(equi_candidates(old, new, "vh_geometry", "geometry_hash")).union(spatial_candidates(old, new, radius_m))
    rank = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))[F.col("reason")]
    return pairs.groupBy("old_step", "new_step").agg(F.min_by("reason", rank).alias("reason"))


def dirty_guids(rows: DataFrame) -> DataFrame:
    return rows.where("guid <> ''").groupBy("guid").agg(F.count("*").alias("n")).where("n > 1").select("guid")


def score(pairs: DataFrame, old: DataFrame, new: DataFrame, radius_m: float = RADIUS_M) -> DataFrame:
    """``pairs`` plus score, by tiers; an identifier that a side has twice caps it at a half."""
    size = radius(radius_m)
    columns = ["guid", "canonical_class", "vh_geometry", "vh_data", "vh_topology", "placement", "centroid"]

    def side(rows: DataFrame, step: str, mark: str) -> DataFrame:
        dirty = dirty_guids(rows).withColumn("dirty", F.lit(True))
        return rows.join(dirty, "guid", "left").select(F.col("step_id").alias(step), F.struct(*columns, F.coalesce("dirty", F.lit(False)).alias("dirty")).alias(mark))

    both = pairs.join(side(old, "old_step", "o"), "old_step").join(side(new, "new_step", "n"), "new_step")
    same_guid = F.coalesce((F.col("o.guid") != "") & (F.col("o.guid") == F.col("n.guid")), F.lit(False))
    same_class = F.col("o.canonical_class").eqNullSafe(F.col("n.canonical_class"))
    same_vector = F.lit(True)
    for c in ("vh_geometry", "vh_data", "vh_topology", "placement"):
        same_vector = same_vector & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    apart = sum((F.col("o.centroid")[k] - F.col("n.centroid")[k]) * (F.col("o.centroid")[k] - F.col("n.centroid")[k]) for k in range(3))
    close = F.coalesce(apart <= size * size, F.lit(False))
    tier = (
        F.when(same_guid & same_class & same_vector, 1.0)
        .when(same_guid & same_class, 0.9)
        .when(~same_guid & same_vector & close, 0.8)
        .when(~same_guid & ~same_vector & same_class & close, 0.5)
        .when(same_guid, 0.1)
        .otherwise(0.0)
    )
    return both.select(*pairs.columns, F.when(F.col("o.dirty") | F.col("n.dirty"), F.least(tier, F.lit(0.5))).otherwise(tier).alias("score"))


def _greedy_component(rows):
    """Sequential greedy on what rounds have left of one component."""
    import pyarrow as pa

    ordered = sorted(rows.to_pylist(), key=lambda r: (-r["score"], r["old_step"], r["new_step"], r["reason"]))
    old, new, out = set(), set(), []
    for r in ordered:
        if r["old_step"] not in old and r["new_step"] not in new:
            old.add(r["old_step"])
            new.add(r["new_step"])
            out.append(r)
    return pa.Table.from_pylist([{k: r[k] for k in ("old_step", "new_step", "score", "reason")} for r in out], pa.schema([("old_step", pa.int64()), ("new_step", pa.int64()), ("score", pa.float64()), ("reason", pa.string())]))


def greedy(scored: DataFrame, min_score: float = MIN_SCORE, rounds: int = 5) -> DataFrame:
    """One-to-one matches as a greedy pass over (-score, old, new, reason) would choose them.

    A pair that is first for both its ends is in the result of the greedy
    pass, so rounds of such pairs are taken at once. A block of equal scores
    in which every old row meets every new one is paired by rank, which is
    what the pass does there. What a few rounds leave over is solved in order,
    by connected component.
    """
    order = [F.desc("score"), "old_step", "new_step", "reason"]
    left = stored(scored.where(F.col("score") >= min_score).select("old_step", "new_step", "score", "reason"), "scored")
    taken = None

    def take(found: DataFrame) -> DataFrame:
        nonlocal taken
        taken = found if taken is None else taken.union(found)
        rest = left.join(found.select("old_step"), "old_step", "left_anti").join(found.select("new_step"), "new_step", "left_anti")
        return stored(rest.select("old_step", "new_step", "score", "reason"), "left")

    found = stored(_tied_blocks(left), "tied")
    left = take(found)
    for _ in range(rounds):
        if left.isEmpty():
            return taken
        firsts = left.withColumn("a", F.row_number().over(W.partitionBy("old_step").orderBy(*order))).withColumn("b", F.row_number().over(W.partitionBy("new_step").orderBy(*order)))
        left = take(stored(firsts.where("a = 1 AND b = 1").select("old_step", "new_step", "score", "reason"), "mutual"))
    if left.isEmpty():
        return taken
    ends = left.select((2 * F.col("old_step")).alias("a"), (2 * F.col("new_step") + 1).alias("b"))
    parts = left.join(connected(ends), 2 * F.col("old_step") == F.col("node"))
    rest = parts.groupBy("component").applyInArrow(_greedy_component, "old_step long, new_step long, score double, reason string")
    return taken.union(stored(rest, "greedy"))


def _tied_blocks(scored: DataFrame) -> DataFrame:
    """Matches within blocks that are complete, tied, and joined to nothing else."""
    by_old = scored.groupBy("old_step").agg(F.min("new_step").alias("key"), F.max("new_step").alias("last"), F.count("*").alias("degree"), F.min("score").alias("low"), F.max("score").alias("high"), F.sum(F.xxhash64("new_step").cast("decimal(38,0)")).alias("mix"))
    sides = by_old.where("low = high").groupBy("key", "last", "degree", "low", "mix").agg(F.count("*").alias("olds"), F.min("old_step").alias("block"))
    tagged = by_old.join(sides, ["key", "last", "degree", "low", "mix"]).select("old_step", "block", "olds", "degree")
    inside = scored.join(tagged, "old_step")
    in_degree = scored.groupBy("new_step").agg(F.count("*").alias("all"))
    whole = inside.groupBy("block", "new_step").agg(F.count("*").alias("met"), F.first("olds").alias("olds"), F.first("degree").alias("degree")).join(in_degree, "new_step")
    whole = whole.groupBy("block", "degree").agg(F.count("*").alias("news"), F.min(F.col("met") == F.col("olds")).alias("full"), F.min(F.col("all") == F.col("met")).alias("closed")).where("full AND closed AND news = degree").select("block")
    mine = inside.join(whole, "block")
    olds = mine.select("block", "old_step").distinct().withColumn("rank", F.row_number().over(W.partitionBy("block").orderBy("old_step")))
    news = mine.select("block", "new_step").distinct().withColumn("rank", F.row_number().over(W.partitionBy("block").orderBy("new_step")))
    return mine.join(olds.join(news, ["block", "rank"]).select("old_step", "new_step"), ["old_step", "new_step"]).select("old_step", "new_step", "score", "reason")


def unmatched(rows: DataFrame, matches: DataFrame, step: str) -> DataFrame:
    return rows.select("step_id").join(matches.select(F.col(step).alias("step_id")), "step_id", "left_anti")


def aspects(matches: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Matches with flags geometry, data, topology and placement, the shift in mm, and the section of the report."""
    columns = ["canonical_class", "vh_geometry", "vh_data", "vh_topology", "placement", "centroid"]
    sides = [s.select(F.col("step_id").alias(n), F.struct(*columns).alias(n[0])) for s, n in ((old, "old_step"), (new, "new_step"))]
    both = matches.join(sides[0], "old_step").join(sides[1], "new_step")

    def differs(c: str) -> Column:
        return ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))

    flags = {"geometry": "vh_geometry", "data": "vh_data", "topology": "vh_topology", "placement": "placement"}
    rows = both.select("old_step", "new_step", "score", "reason", F.col("n.canonical_class").alias("canonical_class"), *(differs(c).alias(f) for f, c in flags.items()), delta_mm(F.col("o.centroid"), F.col("n.centroid")).alias("placement_delta_mm"))
    return rows.withColumn("section", F.when(F.col("geometry") | F.col("data") | F.col("topology") | F.col("placement"), "modified").otherwise("unchanged"))


def signature_diff(old: DataFrame, new: DataFrame, radius_m: float = RADIUS_M) -> DataFrame:
    """The whole report: rows of sections added, deleted, modified and unchanged."""
    found = stored(greedy(score(candidates(old, new, radius_m), old, new, radius_m)), "matches")
    rows = aspects(found, old, new)
    alone = lambda side, step, section: unmatched(side, found, step).join(side, "step_id").select(F.col("step_id").alias(step), "canonical_class", F.lit(section).alias("section"))
    return rows.unionByName(alone(old, "old_step", "deleted"), allowMissingColumns=True).unionByName(alone(new, "new_step", "added"), allowMissingColumns=True)


def signature_diff_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("section").agg(F.count("*").alias("n"))


def centroid_and_box(points: DataFrame) -> DataFrame:
    """(step_id, n, centroid, box) of distinct points (step_id, point_step, x, y, z); null coordinates are 0."""
    once = points.select("step_id", "point_step", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in "xyz")).dropDuplicates(["step_id", "point_step"])
    return once.groupBy("step_id").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"c{c}") for c in "xyz"), *(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"))


def invariants_match(old: Column, new: Column, tolerance: float = 1e-6) -> Column:
    """Whether two structs of :func:`centroid_and_box` agree in count, box and centroid."""
    same = old["n"] == new["n"]
    for c in [f"{p}{a}" for p in ("c", "min_", "max_") for a in "xyz"]:
        same = same & (F.abs(old[c] - new[c]) <= tolerance)
    return same
