"""Matching of entities between two graphs where identifiers do not settle it."""

from __future__ import annotations

from dataclasses import dataclass
from math import inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.canonical import FIELD, SEP, degree_similarity, jaccard, literal_token, type_compatibility, type_family
from quern.operators.hashing import semantic_signatures, structural_hashes
from quern.operators.identity import guid_overlap, unique_pairs
from quern.plans.loops import stored

#: Policies of root remap and of secondary matching.
ROOT_OVERLAP, ROOT_THRESHOLD, ROOT_MARGIN, ROOT_MAX = 0.30, 0.72, 0.08, 8
SECONDARY = {"threshold": 0.55, "margin": 0.10, "assignment_max": 12, "depth2_max": 8, "depth3_max": 6, "unresolved_limit": 1_000_000, "pair_limit": 500_000_000}
#: Confidence of text matches, and the largest bucket that is refined.
TEXT_UNIQUE, TEXT_REFINED, REFINE_MAX = 0.99, 0.97, 16
LARGE_FAMILY = 20_000


# --- text fingerprints --------------------------------------------------------


def fingerprint_pairs(old: DataFrame, new: DataFrame, key: str = "hash") -> DataFrame:
    """(old_step, new_step, confidence) of fingerprints that one entity of either side has."""
    return unique_pairs(old, new, key).select("old_step", "new_step", F.lit(TEXT_UNIQUE).alias("confidence"))


def refined_pairs(old: DataFrame, new: DataFrame, key: str = "hash", near: str = "near") -> DataFrame:
    """Pairs within buckets of equal size, 2 to ``REFINE_MAX``, by a second key of the neighbourhood.

    A bucket is matched whole or not at all: every second key must be unique in it on both sides.
    """

    def sizes(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.count("*").alias(name))

    buckets = sizes(old, "a").join(sizes(new, "b"), key).where(f"a = b AND a > 1 AND a <= {REFINE_MAX}").select(key, F.col("a").alias("size"))

    def single(rows: DataFrame, name: str) -> DataFrame:
        return rows.join(buckets, key).groupBy(key, near).agg(F.count("*").alias("n"), F.min("step_id").alias(name), F.first("size").alias("size")).where("n = 1").drop("n")

    pairs = single(old, "old_step").join(single(new, "new_step").drop("size"), [key, near])
    whole = pairs.groupBy(key).agg(F.count("*").alias("got"), F.first("size").alias("size")).where("got = size").select(key)
    return pairs.join(whole, key, "left_semi").select("old_step", "new_step", F.lit(TEXT_REFINED).alias("confidence"))


def neighbour_signature(entities: DataFrame, refs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(step_id, near): digest of the sorted (path, hash) of an entity's targets; dangling ones count as MISSING."""
    named = refs.join(hashes.select(F.col("step_id").alias("target_step"), "hash"), "target_step", "left")
    one = F.concat_ws(FIELD, "path", F.coalesce("hash", F.lit("MISSING")))
    near = named.groupBy("source_step").agg(F.array_join(F.array_sort(F.collect_list(one)), SEP).alias("near"))
    rows = entities.select("step_id").join(near, F.col("step_id") == F.col("source_step"), "left")
    return rows.select("step_id", F.sha2(F.coalesce("near", F.lit("")), 256).alias("near"))


# --- roots with other identifiers ----------------------------------------------


def root_signatures(entities: DataFrame, refs: DataFrame) -> DataFrame:
    """(step_id, hash) of entities with an identifier; the identifier itself is not in it."""
    return structural_hashes(entities.where("global_id IS NOT NULL"), refs).select("step_id", "hash")


def root_remap(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], overlap: float = ROOT_OVERLAP) -> DataFrame:
    """(old_step, new_step, stage) of roots whose identifiers changed; empty where enough of them are kept.

    Stage 1 takes signatures unique on both sides, stage 2 splits buckets by
    the signatures of neighbours, stage 3 tries all assignments of small buckets.
    """
    spark = old[0].sparkSession
    if guid_overlap(old[0], new[0]) >= overlap:
        return spark.createDataFrame([], "old_step long, new_step long, stage int")
    kept = unique_pairs(old[0], new[0])
    sides = []
    for (entities, refs), step in ((old, "old_step"), (new, "new_step")):
        roots = entities.where("global_id IS NOT NULL").join(kept.select(F.col(step).alias("step_id")), "step_id", "left_anti")
        signed = root_signatures(roots, refs)
        near = neighbour_signature(roots, refs, structural_hashes(entities, refs))
        sides.append(stored(signed.join(near, "step_id"), "roots"))
    first = unique_pairs(*sides, key="hash").select("old_step", "new_step", F.lit(1).alias("stage"))
    rest = [s.join(first.select(F.col(c).alias("step_id")), "step_id", "left_anti").withColumn("both", F.concat_ws("|", "hash", "near")) for s, c in zip(sides, ("old_step", "new_step"))]
    second = unique_pairs(*rest, key="both").select("old_step", "new_step", F.lit(2).alias("stage"))
    left = [s.join(second.select(F.col(c).alias("step_id")), "step_id", "left_anti") for s, c in zip(rest, ("old_step", "new_step"))]
    wide = [stored(s.select("step_id", "hash").join(_root_features(*g), "step_id"), "root_features") for s, g in zip(left, (old, new))]
    third = best_in_buckets(_root_scores(*wide)).select("old_step", "new_step", F.lit(3).alias("stage"))
    return stored(first.union(second).union(third), "remap")


def _root_features(entities: DataFrame, refs: DataFrame) -> DataFrame:
    hashes = structural_hashes(entities, refs).select(F.col("step_id").alias("target_step"), "hash")
    token = F.concat_ws(FIELD, "path", F.coalesce("target_type", F.lit("")), F.coalesce("hash", F.lit("MISSING")))
    near = refs.join(hashes, "target_step", "left").groupBy("source_step").agg(F.array_sort(F.collect_set(token)).alias("near"), F.array_sort(F.collect_list(token)).alias("all"), F.array_sort(F.collect_set(F.concat_ws(FIELD, "path", "target_type"))).alias("labels"), F.count("*").alias("degree"))
    none = F.array().cast("array<string>")
    rows = entities.where("global_id IS NOT NULL").join(near, F.col("step_id") == F.col("source_step"), "left")
    return rows.select("step_id", "entity_type", F.map_keys("attributes").alias("paths"), F.array_distinct(F.transform(F.map_values("attributes"), literal_token)).alias("literals"), F.coalesce("labels", none).alias("labels"), F.coalesce("near", none).alias("near"), F.array_join(F.coalesce("all", none), SEP).alias("all"), F.coalesce("degree", F.lit(0)).alias("degree"))


def _root_scores(old: DataFrame, new: DataFrame, most: int = ROOT_MAX) -> DataFrame:
    """(block, old_step, new_step, score) within buckets of one signature with at most ``most`` roots on a side."""
    sizes = [s.groupBy("hash").agg(F.count("*").alias(n)).where(F.col(n) <= most) for s, n in ((old, "a"), (new, "b"))]
    small = sizes[0].join(sizes[1], "hash").select("hash")
    left, right = (s.join(small, "hash").select("hash", F.struct(*s.columns).alias(n)) for s, n in ((old, "o"), (new, "n")))
    x, y = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    score = (
        0.15 * (x("entity_type") == y("entity_type")).cast("double") + 0.15 * jaccard(x("paths"), y("paths")) + 0.20 * jaccard(x("literals"), y("literals")) + 0.10 * jaccard(x("labels"), y("labels"))
        + 0.25 * jaccard(x("near"), y("near")) + 0.10 * (x("all") == y("all")).cast("double") + 0.05 * degree_similarity(x("degree"), y("degree"))
    )
    return left.join(right, "hash").select(F.col("hash").alias("block"), F.col("o.step_id").alias("old_step"), F.col("n.step_id").alias("new_step"), score.alias("score"))


def two_best(scores: dict[tuple[int, int], float]) -> list[tuple[int, float, tuple]]:
    """The two best assignments by count, total and pairs, each as (count, total, pairs).

    Old rows are taken in turn. For each set of used new rows only the two
    best beginnings are kept, as all that share the set can go on alike.
    """
    news = {n: 1 << i for i, n in enumerate(sorted({n for _, n in scores}))}
    front: dict[int, list] = {0: [(0, 0.0, ())]}
    for old in sorted({o for o, _ in scores}):
        grown: dict[int, list] = {}
        options = [(None, 0, 0.0), *((n, news[n], s) for (o, n), s in scores.items() if o == old)]
        for used, kept in front.items():
            for n, bit, s in options:
                if not used & bit:
                    grown.setdefault(used | bit, []).extend((k + 1, t + s, (*p, (old, n))) if n is not None else (k, t, p) for k, t, p in kept)
        front = {u: sorted(c, key=_assignment_rank, reverse=True)[:2] for u, c in grown.items()}
    return sorted((c for cs in front.values() for c in cs), key=_assignment_rank, reverse=True)[:2]


def _assignment_rank(candidate: tuple[int, float, tuple]) -> tuple:
    return candidate[0], round(candidate[1], 12), candidate[2]


def best_in_buckets(scored: DataFrame, threshold: float = ROOT_THRESHOLD, margin: float = ROOT_MARGIN) -> DataFrame:
    """(old_step, new_step) of the best assignment of each block, unless another of the same count comes within ``margin``."""
    import pyarrow as pa

    out = pa.schema([("old_step", pa.int64()), ("new_step", pa.int64())])

    def solve(table: pa.Table) -> pa.Table:
        best = two_best({(r["old_step"], r["new_step"]): r["score"] for r in table.to_pylist()})
        close = len(best) > 1 and best[0][0] == best[1][0] and best[0][1] - best[1][1] < margin
        return pa.Table.from_pylist([] if close else [{"old_step": o, "new_step": n} for o, n in best[0][2]], out)

    return scored.where(F.col("score") >= threshold).groupBy("block").applyInArrow(solve, "old_step long, new_step long")


# --- along references -----------------------------------------------------------


def propagate(pairs: DataFrame, old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], taken: DataFrame | None = None) -> DataFrame:
    """(old_step, new_step, hop) of entities without identifier, found from matched pairs along references.

    From a matched pair, targets match that are the only ones of their path
    and type on both sides, among targets that are not matched yet; those with
    an identifier count but never match. All pairs of one hop are handled at
    once, and counts are taken anew in the next; where two would claim an
    entity, the one with the smallest old source, path and type has it.
    ``taken(old_step, new_step)`` are matched already, besides ``pairs``. It
    ends when a hop finds nothing.
    """
    from pyspark.sql import Window as W

    pairs = pairs.select("old_step", "new_step")
    used = stored(pairs.union(taken.select("old_step", "new_step")) if taken is not None else pairs, "used")
    front, found, hop = stored(pairs, "pairs"), None, 0

    def targets(side: tuple[DataFrame, DataFrame], name: str) -> DataFrame:
        """The only open target of each path and type from an entity of the front."""
        entities, refs = side
        step, known = f"{name}_step", entities.select(F.col("step_id").alias("target_step"), F.col("global_id").isNotNull().alias("root"))
        open_refs = refs.join(front.select(F.col(step).alias("source_step")).distinct(), "source_step", "left_semi").join(used.select(F.col(step).alias("target_step")), "target_step", "left_anti")
        one = open_refs.join(known, "target_step").groupBy("source_step", "path", "target_type").agg(F.count("*").alias("n"), F.min("target_step").alias("to"), F.min("root").alias("root"))
        return one.where("n = 1").select(F.col("source_step").alias(step), "path", F.coalesce("target_type", F.lit("")).alias("type"), F.col("to").alias(f"{name}_to"), F.col("root").alias(f"{name}_root"))

    while True:
        hop += 1
        met = front.join(targets(old, "old"), "old_step").join(targets(new, "new"), ["new_step", "path", "type"]).where("NOT old_root AND NOT new_root")
        met = met.select(F.col("old_to").alias("to_old"), F.col("new_to").alias("to_new"), F.struct("old_step", "path", "type").alias("by"))
        met = met.withColumn("x", F.row_number().over(W.partitionBy("to_old").orderBy("by", "to_new"))).where("x = 1").withColumn("y", F.row_number().over(W.partitionBy("to_new").orderBy("by", "to_old"))).where("y = 1")
        front = stored(met.select(F.col("to_old").alias("old_step"), F.col("to_new").alias("new_step"), F.lit(hop).alias("hop")), "hop")
        if front.isEmpty():
            return front if found is None else found
        found = front if found is None else found.union(front)
        front = front.select("old_step", "new_step")
        used = used.union(front)


# --- features and blocks -----------------------------------------------------------


def features(entities: DataFrame, refs: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """One wide row for each entity without identifier, or each of ``steps(step_id)``: what blocking and likeness at depth 1 need."""
    wanted = entities.where("global_id IS NULL")
    if steps is not None:
        wanted = wanted.join(steps.select("step_id"), "step_id", "left_semi")
    own = refs.join(wanted.select(F.col("step_id").alias("source_step")), "source_step", "left_semi")
    counted = own.groupBy("source_step", "path", type_family(F.col("target_type")).alias("t")).agg(F.count("*").alias("n"))
    ahead = counted.groupBy("source_step").agg(
        F.array_sort(F.collect_list(F.concat_ws(FIELD, "path", "t"))).alias("edge_labels"), F.sum("n").alias("degree"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(FIELD, "path", "t", F.col("n").cast("string")))), SEP), 256).alias("digest"),
    )
    back = _upward(entities, refs.join(wanted.select(F.col("step_id").alias("target_step")), "target_step", "left_semi"))
    d1 = back.groupBy("at").agg(F.array_sort(F.collect_set("token")).alias("ancestry1"))
    rows = wanted.join(semantic_signatures(wanted).select("step_id", "signature"), "step_id")
    for side, by in ((ahead, "source_step"), (d1, "at")):
        rows = rows.join(side.withColumnRenamed(by, "step_id"), "step_id", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "step_id", "entity_type", type_family(F.col("entity_type")).alias("family"), "signature",
        F.array_sort(F.map_keys("attributes")).alias("paths"),
        F.array_sort(F.array_distinct(F.transform(F.map_values("attributes"), literal_token))).alias("literals"),
        F.coalesce("edge_labels", none).alias("edge_labels"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("digest", F.lit("0" * 64)).alias("digest"),
        F.coalesce("ancestry1", none).alias("ancestry1"),
    )


def _upward(entities: DataFrame, refs: DataFrame) -> DataFrame:
    """(at, source_step, token) for each reference to ``at``: its path and the family it comes from."""
    sources = entities.select(F.col("step_id").alias("source_step"), type_family(F.col("entity_type")).alias("source_type"))
    return refs.join(sources, "source_step").select(F.col("target_step").alias("at"), "source_step", F.concat_ws(FIELD, "path", "source_type").alias("token"))


def deep_features(entities: DataFrame, refs: DataFrame, steps: DataFrame) -> DataFrame:
    """(step_id, ancestry2, depth2, depth3) of ``steps(step_id)``: who refers to those that refer to it, and its surroundings.

    The digests of depth 2 and 3 are of the references that lie so many steps
    away, each from the entity's first visit, with their types.
    """
    edges = refs.join(entities.select(F.col("step_id").alias("target_step")), "target_step", "left_semi").select(F.col("source_step").alias("node"), "path", type_family(F.col("target_type")).alias("t"), "target_step")
    kinds = entities.select(F.col("step_id").alias("node"), type_family(F.col("entity_type")).alias("kind"))
    level = stored(steps.select("step_id", F.col("step_id").alias("node")).distinct(), "level")
    seen, labels = level, None
    for depth in (1, 2, 3):
        out = level.join(edges, "node").join(kinds, "node")
        found = out.select("step_id", F.lit(depth).alias("depth"), F.concat_ws(FIELD, F.lit(str(depth)), "path", F.coalesce("t", F.lit("")), "kind").alias("label"))
        labels = found if labels is None else labels.union(found)
        level = stored(out.select("step_id", F.col("target_step").alias("node")).distinct().join(seen, ["step_id", "node"], "left_anti"), "level")
        seen = seen.union(level)
    around = lambda k: F.sha2(F.array_join(F.array_sort(F.collect_list(F.when(F.col("depth") <= k, F.col("label")))), SEP), 256)
    digests = labels.groupBy("step_id").agg(around(2).alias("depth2"), around(3).alias("depth3"))
    first = _upward(entities, refs.join(steps.select(F.col("step_id").alias("target_step")), "target_step", "left_semi"))
    above = _upward(entities, refs.join(first.select(F.col("source_step").alias("target_step")).distinct(), "target_step", "left_semi"))
    second = first.select("at", "source_step", "token").join(above.select(F.col("at").alias("source_step"), F.col("token").alias("over")), "source_step")
    ancestry = second.groupBy(F.col("at").alias("step_id")).agg(F.array_sort(F.collect_set(F.concat_ws(SEP, "token", "over"))).alias("ancestry2"))
    rows = steps.select("step_id").distinct().join(digests, "step_id", "left").join(ancestry, "step_id", "left")
    return rows.select("step_id", F.coalesce("ancestry2", F.array().cast("array<string>")).alias("ancestry2"), F.coalesce("depth2", F.lit("")).alias("depth2"), F.coalesce("depth3", F.lit("")).alias("depth3"))


def blocking_key() -> Column:
    """Coarse key of a feature row: family, capped counts and the first digit of the neighbourhood digest."""
    part = lambda n, by: F.least(F.lit(8), F.floor(n / by).cast("long")).cast("string")
    nibble = F.floor(F.conv(F.substring("digest", 1, 1), 16, 10).cast("long") / 4).cast("string")
    return F.concat_ws("|", "family", part(F.col("degree"), 2), part(F.size("edge_labels"), 2), part(F.size("paths"), 4), part(F.size("literals"), 4), part(F.size("ancestry1"), 2), nibble)


def similarity(a: str, b: str, depth: int = 1) -> Column:
    """Weighted likeness of two feature structs named ``a`` and ``b``; beyond depth 1 they have the deep features too."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    equal = lambda c: (x(c) == y(c)).cast("double")
    total = (
        0.14 * type_compatibility(x("entity_type"), y("entity_type")) + 0.22 * equal("signature") + 0.14 * jaccard(x("paths"), y("paths"))
        + 0.10 * jaccard(x("literals"), y("literals")) + 0.13 * jaccard(x("edge_labels"), y("edge_labels"))
        + 0.05 * degree_similarity(x("degree"), y("degree")) + 0.04 * jaccard(x("ancestry1"), y("ancestry1"))
    )
    if depth >= 2:
        total = total + 0.14 * jaccard(x("ancestry2"), y("ancestry2")) + 0.03 * equal("depth2")
    if depth >= 3:
        total = total + 0.03 * equal("depth3")
    return F.least(F.lit(1.0), total)


# --- assignment ------------------------------------------------------------------


def assign(scores: dict[tuple[int, int], float], threshold: float, margin: float) -> tuple[dict[int, int], bool]:
    """Assignment of least cost that may leave rows out at ``1 - threshold + 0.05`` each, and whether it is ambiguous.

    Shortest augmenting paths with potentials over the square matrix of both
    sides and their stand-ins. Ambiguous means that some chosen pair beats
    another of its row or column by less than ``margin``.
    """
    olds, news = sorted({o for o, _ in scores}), sorted({n for _, n in scores})
    m, n = len(olds), len(news)
    size, spare, never = m + n, 1 - threshold + 0.05, 1e6

    def cost(i: int, j: int) -> float:
        if i < m and j < n:
            s = scores.get((olds[i], news[j]))
            return never if s is None else 1 - s
        return spare if i < m or j < n else 0.0

    row_of, up, vp = [-1] * size, [0.0] * size, [0.0] * size
    for start in range(size):
        # Dijkstra from the free row over reduced costs.
        dist, prev, done = [inf] * size, [-1] * size, [False] * size
        i, reach, last = start, 0.0, -1
        while True:
            at, best = -1, inf
            for j in range(size):
                if not done[j]:
                    d = reach + cost(i, j) - up[i] - vp[j]
                    if d < dist[j]:
                        dist[j], prev[j] = d, last
                    if dist[j] < best:
                        at, best = j, dist[j]
            done[at], reach, last = True, best, at
            if row_of[at] < 0:
                break
            i = row_of[at]
        up[start] += reach
        for j in range(size):
            if done[j] and j != last:
                up[row_of[j]] += reach - dist[j]
                vp[j] -= reach - dist[j]
        while last >= 0:
            row_of[last] = start if prev[last] < 0 else row_of[prev[last]]
            last = prev[last]
    chosen = {olds[row_of[j]]: news[j] for j in range(n) if 0 <= row_of[j] < m and scores.get((olds[row_of[j]], news[j]), -1.0) >= threshold}
    close = any((o, w) != (old, new) and (o == old or w == new) and scores[old, new] - s < margin for old, new in chosen.items() for (o, w), s in scores.items())
    return chosen, close


def assign_blocks(scored: DataFrame, threshold: float = SECONDARY["threshold"], margin: float = SECONDARY["margin"]) -> DataFrame:
    """(block, old_step, new_step, score) by :func:`assign` within each block of rows (block, old_step, new_step, score).

    An ambiguous block has one row, without steps.
    """
    import pyarrow as pa

    out = pa.schema([("block", pa.string()), ("old_step", pa.int64()), ("new_step", pa.int64()), ("score", pa.float64())])

    def solve(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        scores = {(r["old_step"], r["new_step"]): r["score"] for r in rows}
        chosen, close = assign(scores, threshold, margin)
        block = rows[0]["block"]
        if close:
            return pa.Table.from_pylist([{"block": block, "old_step": None, "new_step": None, "score": None}], out)
        return pa.Table.from_pylist([{"block": block, "old_step": o, "new_step": n, "score": scores[o, n]} for o, n in sorted(chosen.items())], out)

    alike = scored.where(F.col("score") >= threshold).select("block", "old_step", "new_step", "score")
    return alike.groupBy("block").applyInArrow(solve, "block string, old_step long, new_step long, score double")


@dataclass
class Secondary:
    """``pairs`` (block, old_step, new_step, score, depth), the rows (block, side, step_id) of blocks left open because they are ambiguous, and how many matches those could have been."""

    pairs: DataFrame
    ambiguous: DataFrame
    ambiguous_count: int


def _placed_in_blocks(old: DataFrame, new: DataFrame) -> list[DataFrame]:
    """Both sides with ``block``: the whole family where it is large, else the blocking key, or the rest of the family where the other side lacks that key."""
    sides = [s.withColumn("key", blocking_key()) for s in (old, new)]
    families = [s.groupBy("family").agg(F.count("*").alias(n)) for s, n in zip(sides, "ab")]
    both = families[0].join(families[1], "family")
    large = stored(both.select("family", (F.greatest("a", "b") >= LARGE_FAMILY).alias("large")), "families")
    shared = stored(sides[0].select("key").distinct().join(sides[1].select("key").distinct(), "key").withColumn("shared", F.lit(True)), "shared_keys")
    block = F.when(F.col("large"), F.concat("family", F.lit("|large"))).when(F.col("shared"), F.col("key")).otherwise(F.concat("family", F.lit("|residual")))
    return [stored(s.join(large, "family").join(shared, "key", "left").withColumn("block", block).drop("key", "shared"), "blocked") for s in sides]


def secondary_match(old: DataFrame, new: DataFrame, policy: dict | None = None, graphs: tuple | None = None) -> Secondary:
    """Match unresolved feature rows of two graphs, by block and then likeness.

    Families of ``LARGE_FAMILY`` rows or more, and blocks over the policy's
    size, match by unique signature alone. Other blocks are assigned by
    likeness at depth 1; small ones that stay ambiguous again at depth 2 and
    then 3, which read ``graphs`` (both as entities and references; without
    them only depth 1 is tried). Rows whose key the other side lacks are one
    block of their family. The number of rows and pairs is known before any
    pair is made; beyond the policy's limits nothing is matched.
    """
    rules = SECONDARY | (policy or {})
    spark = old.sparkSession
    old, new = stored(old, "features"), stored(new, "features")
    a, b = old.count(), new.count()
    none = spark.createDataFrame([], "block string, old_step long, new_step long, score double, depth int"), spark.createDataFrame([], "block string, side string, step_id long")
    if max(a, b) > rules["unresolved_limit"] or a * b > rules["pair_limit"]:
        return Secondary(*none, min(a, b))
    if not a or not b:
        return Secondary(*none, 0)
    sides = _placed_in_blocks(old, new)
    sizes = [s.groupBy("block").agg(F.count("*").alias(n), F.max("large").alias("large")) for s, n in zip(sides, "ab")]
    most = rules["assignment_max"]
    blocks = sizes[0].join(sizes[1].drop("large"), "block").withColumn("signed", F.col("large") | (F.greatest("a", "b") > most)).withColumn("limit", F.least("a", "b"))
    blocks = stored(blocks, "blocks")
    # By signature: unique on both sides within the block.
    signed = blocks.where("signed").select("block")
    counts = [s.join(signed, "block", "left_semi").groupBy("block", "signature").agg(F.count("*").alias(n), F.min("step_id").alias(step)) for s, n, step in zip(sides, "ab", ("old_step", "new_step"))]
    met = stored(counts[0].join(counts[1], ["block", "signature"]), "signatures")
    found = [met.where("a = 1 AND b = 1").select("block", "old_step", "new_step", F.lit(1.0).alias("score"), F.lit(1).alias("depth"))]
    left_open = met.where("a > 1 OR b > 1").groupBy("block").agg(F.sum(F.least("a", "b")).alias("n"))
    # By assignment, deeper where it stays ambiguous.
    rest = blocks.where("NOT signed").select("block", "limit")
    for depth in (1, 2, 3):
        if depth > 1:
            rest = stored(rest.where(F.col("limit") <= rules[f"depth{depth}_max"]), "deepened")
            if graphs is None or rest.isEmpty():
                break
            more = [s.join(rest, "block", "left_semi").select("block", F.struct(*s.columns).alias(k)) for s, k in zip(sides, "on")]
            deep = [deep_features(*g, m.select(F.col(f"{k}.step_id").alias("step_id"))).withColumnRenamed("step_id", "at") for g, m, k in zip(graphs, more, "on")]
            ends = [m.join(d, F.col(f"{k}.step_id") == F.col("at")).select("block", F.struct(f"{k}.*", "ancestry2", "depth2", "depth3").alias(k)) for m, d, k in zip(more, deep, "on")]
        else:
            ends = [s.join(rest, "block", "left_semi").select("block", F.struct(*s.columns).alias(k)) for s, k in zip(sides, "on")]
        scored = ends[0].join(ends[1], "block").select("block", F.col("o.step_id").alias("old_step"), F.col("n.step_id").alias("new_step"), similarity("o", "n", depth).alias("score"))
        tried = stored(assign_blocks(scored, rules["threshold"], rules["margin"]), "assigned")
        found.append(tried.where("old_step IS NOT NULL").withColumn("depth", F.lit(depth)))
        close = stored(rest.join(tried.where("old_step IS NULL").select("block"), "block"), "ambiguous")
        # Those that no deeper round takes up stay ambiguous.
        last = close if depth == 3 or graphs is None else close.where(F.col("limit") > rules[f"depth{depth + 1}_max"])
        left_open = left_open.union(last.select("block", F.col("limit").cast("long")))
        rest = close
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.union(f)
    pairs, left_open = stored(pairs, "secondary"), stored(left_open, "open_blocks")
    rows = [s.join(left_open, "block", "left_semi").join(pairs.select(F.col(step).alias("step_id")), "step_id", "left_anti").select("block", F.lit(k).alias("side"), "step_id") for s, k, step in zip(sides, ("old", "new"), ("old_step", "new_step"))]
    return Secondary(pairs, rows[0].union(rows[1]), left_open.agg(F.sum("n")).first()[0] or 0)


def ambiguous_ids(ambiguous: DataFrame, side: str) -> DataFrame:
    """(step_id, class_id): one ``C:`` class for each ambiguous block, the same on both sides."""
    return ambiguous.where(F.col("side") == side).select("step_id", F.concat(F.lit("C:"), F.sha2(F.concat(F.lit("ambiguous|"), "block"), 256)).alias("class_id"))


def validated_policy(policy: dict | None) -> dict:
    """The secondary policy with defaults filled in; unknown names and values out of range are errors."""
    given = policy or {}
    for k in given:
        if k not in SECONDARY:
            raise ValueError(f"Unknown matcher policy: {k}")
    for k in ("threshold", "margin"):
        if k in given and not 0 <= given[k] <= 1:
            raise ValueError(f"Matcher policy {k} must be between 0 and 1")
    for k in given.keys() - {"threshold", "margin"}:
        if not isinstance(given[k], int) or given[k] <= 0:
            raise ValueError(f"Matcher policy {k} must be a positive integer")
    return SECONDARY | given
