"""Colour refinement over references, and classes of what it cannot tell apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.canonical import FIELD, SEP
from quern.plans.loops import least_reachable, placed, stored

ROUND_HASHES = ("auto", "sha256", "md5", "xxhash64")
#: Rounds, and fewer for large graphs (least entities, rounds).
MAX_ROUNDS, LARGE_ROUNDS = 8, ((1_000_000, 3), (500_000, 4), (250_000, 5))


def _hasher(name: str):
    if name in ("auto", "sha256"):
        return lambda text: F.sha2(text, 256)
    if name == "md5":
        return F.md5
    if name == "xxhash64":
        return lambda text: F.lower(F.hex(F.xxhash64(text)))
    raise ValueError(f"Unknown WL round hash: {name}")


def round_limit(entities: int) -> int:
    return next((r for least, r in LARGE_ROUNDS if entities >= least), MAX_ROUNDS)


def refine_once(colours: DataFrame, edges: DataFrame, round_hash: str = "auto") -> DataFrame:
    """(step_id, colour) after one round.

    ``colours(step_id, colour)``, ``edges(source_step, path, target_type,
    target_step)``. The new colour digests the old one and the sorted multiset
    of (path, type, colour) of the targets; equal triples are counted before
    they are gathered.
    """
    near = edges.join(colours.select(F.col("step_id").alias("target_step"), "colour"), "target_step")
    counted = near.groupBy("source_step", "path", F.coalesce("target_type", F.lit("")).alias("target_type"), "colour").agg(F.count("*").alias("n"))
    one = F.concat_ws(FIELD, "path", "target_type", "colour", F.col("n").cast("string"))
    around = counted.groupBy("source_step").agg(F.array_join(F.array_sort(F.collect_list(one)), SEP).alias("around"))
    rows = colours.join(around, colours["step_id"] == around["source_step"], "left")
    return rows.select("step_id", _hasher(round_hash)(F.concat_ws("\n", "colour", F.coalesce("around", F.lit("")))).alias("colour"))


def refine(seeds: DataFrame, edges: DataFrame, max_rounds: int | None = None, round_hash: str = "auto", stop_early: bool = True) -> tuple[DataFrame, int]:
    """Colours after refinement, and the rounds made; it stops once the number of colours stood still twice.

    Colours of two graphs can be compared only after equally many rounds, so
    they are refined as one graph, or with ``stop_early`` False.
    """
    colours = stored(seeds.select("step_id", "colour"), "colours")
    n, classes = colours.agg(F.count("*"), F.count_distinct("colour")).first()
    still = made = 0
    for _ in range(max_rounds or round_limit(n)):
        colours = stored(refine_once(colours, edges, round_hash), "colours")
        made += 1
        if not stop_early:
            continue
        now = colours.agg(F.count_distinct("colour")).first()[0]
        still = still + 1 if now == classes else 0
        classes = now
        if still == 2 or classes == n:
            break
    return colours, made


def partition_summary(colours: DataFrame) -> DataFrame:
    """(size, classes): how many colours have how many entities."""
    return colours.groupBy("colour").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("classes"))


def _trimmed(edges: DataFrame, pays: float = 0.05) -> DataFrame:
    """``edges`` without those at nodes that no edge enters or leaves, layer by layer while a layer is worth its table."""
    n = edges.count()
    while n:
        entered, left = edges.select(F.col("b").alias("a")).distinct(), edges.select(F.col("a").alias("b")).distinct()
        edges = stored(edges.join(entered, "a", "left_semi").join(left, "b", "left_semi").select("a", "b"), "trimmed")
        before, n = n, edges.count()
        if n > (1 - pays) * before:
            break
    return edges


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of the directed edges (a, b); component is the least node of each.

    Nodes without a way in or out are components of their own and are trimmed
    first. What is left is numbered at random. Nodes that reach the same least
    number, and are reached by it, form a component, which leaves the graph;
    and so on until none is left. With random numbers a chain or tree falls
    apart in about as many rounds as its length has digits.
    """
    nodes, edges = nodes.select("node").distinct(), stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    edges = _trimmed(edges)
    core = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "core")
    out = nodes.join(core, "node", "left_anti").select("node", F.col("node").alias("component"))
    if core.isEmpty():
        return out
    numbers = placed(core.withColumn("mixed", F.xxhash64("node")), "mixed", "node").select("node", F.col("position").alias("at"))
    ends = [numbers.select(F.col("node").alias(c), F.col("at").alias(f"{c}_at")) for c in "ab"]
    edges = stored(edges.join(ends[0], "a").join(ends[1], "b").select(F.col("a_at").alias("a"), F.col("b_at").alias("b")), "edges")
    left, found = numbers.select(F.col("at").alias("node")), None
    while not left.isEmpty():
        up = least_reachable(left, edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Only edges between nodes that the same least number reaches can lie in its component.
        tops = [up.select(F.col("node").alias(c), F.col("least").alias(f"{c}_top")) for c in "ab"]
        inner = stored(edges.join(tops[0], "a").join(tops[1], "b").where("a_top = b_top").select("a", "b"), "edges")
        both = least_reachable(left, inner).join(up.select("node", F.col("least").alias("from")), "node").where(F.col("least") == F.col("from"))
        one = stored(both.select("node", F.col("least").alias("component")), "components")
        found = one if found is None else found.union(one)
        left = stored(left.join(one, "node", "left_anti"), "nodes")
        edges = inner.join(one.select(F.col("node").alias("a")), "a", "left_anti").join(one.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b")
        edges = stored(edges, "edges")
    named = found.join(numbers.select(F.col("at").alias("at"), F.col("node").alias("is")), F.col("node") == F.col("at")).select("component", F.col("is").alias("node"))
    least = named.groupBy("component").agg(F.min("node").alias("least"))
    return out.union(named.join(least, "component").select("node", F.col("least").alias("component")))


def ambiguous_classes(colours: DataFrame, members: DataFrame, edges: DataFrame, types: DataFrame, most: int = 128) -> DataFrame:
    """(step_id, class_id) of entities that share colour and strong component with another one.

    ``members(node, component)``. A group of up to ``most`` members is split
    once more by labels and colours of edges within the component; larger ones
    stay one class. The id depends on types, colours and labels alone.
    """
    placed = colours.join(members.select(F.col("node").alias("step_id"), "component"), "step_id").join(types.select("step_id", "entity_type"), "step_id")
    groups = placed.groupBy("component", "colour").agg(F.count("*").alias("n")).where("n > 1")
    placed = stored(placed.join(groups, ["component", "colour"]), "ambiguous")
    ends = members.select(F.col("node").alias("target_step"), F.col("component").alias("c2")).join(colours.select(F.col("step_id").alias("target_step"), F.col("colour").alias("k2")), "target_step")
    inner = edges.join(placed.select(F.col("step_id").alias("source_step"), "component"), "source_step").join(ends, "target_step").where("component = c2")
    one = F.concat_ws(FIELD, "path", F.coalesce("target_type", F.lit("")), "k2")
    local = inner.groupBy("source_step").agg(F.array_join(F.array_sort(F.collect_list(one)), SEP).alias("local"))
    rows = placed.join(local, placed["step_id"] == local["source_step"], "left")
    text = F.concat_ws("\n", "entity_type", "colour", F.when(F.col("n") <= most, F.coalesce("local", F.lit(""))).otherwise(F.lit("unsplit")))
    return rows.select("step_id", F.concat(F.lit("C:"), F.sha2(text, 256)).alias("class_id"))


def rooted_owners(entities: DataFrame, refs: DataFrame, steps: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(step_id, owner): the identified entities from which each of ``steps`` is reached along references.

    The search goes backwards, starts at the steps asked for only, and ends
    when a round adds nothing, at any depth. An entity with an identifier owns
    itself. Owners go by ``ids(step_id, entity_id)`` where given.
    """
    back = refs.select(F.col("target_step").alias("at"), "source_step").distinct()
    seen = stored(steps.select("step_id", F.col("step_id").alias("at")).distinct(), "seen")
    front = seen
    while True:
        front = front.join(back, "at").select("step_id", F.col("source_step").alias("at")).distinct()
        front = stored(front.join(seen, ["step_id", "at"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.union(front)
    named = entities.where("global_id IS NOT NULL AND global_id <> ''").select(F.col("step_id").alias("at"), F.concat(F.lit("G:"), "global_id").alias("owner"))
    if ids is not None:
        named = named.join(ids.select(F.col("step_id").alias("at"), "entity_id"), "at").select("at", F.col("entity_id").alias("owner"))
    return seen.join(named, "at").select("step_id", "owner").distinct()


def owner_summary(owners: DataFrame, sample: int = 5) -> DataFrame:
    """(step_id, sample, total): the first owners in order, and how many there are.

    Owners are numbered before they are gathered, so a step with very many costs no more.
    """
    from pyspark.sql import Window as W

    ranked = owners.withColumn("rank", F.row_number().over(W.partitionBy("step_id").orderBy("owner"))).where(F.col("rank") <= sample)
    firsts = ranked.groupBy("step_id").agg(F.array_sort(F.collect_list("owner")).alias("sample"))
    return firsts.join(owners.groupBy("step_id").agg(F.count("*").alias("total")), "step_id")


def adjacency(entities: DataFrame, refs: DataFrame) -> DataFrame:
    """References whose both ends are entities, as forward edges; the other direction is the same table read backwards."""
    steps: Column = F.col("step_id")
    return refs.join(entities.select(steps.alias("target_step")), "target_step", "left_semi").join(entities.select(steps.alias("source_step")), "source_step", "left_semi").select("source_step", "path", "target_type", "target_step")
