"""The whole comparison of two graphs: identities, matches, change feed, class deltas and markers."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import changes, geometry, hashing, identity, index, matching, refinement, signatures
from quern.plans.loops import stored

Graph = tuple[DataFrame, DataFrame]
#: Fixed value: the version of the result's form.
RESULT_VERSION = "2"
_STAGES = ("assign_ids", "root_remap", "text_fingerprint", "path_propagation", "secondary_match", "class_deltas", "base_changes", "derived_markers")


@dataclass
class GraphDiff:
    """Frames of a comparison.

    ``changes`` are numbered and hold class deltas too; ``stats`` says how ids
    on both sides were matched; ``header`` has the policies and counts, and
    ``timings`` milliseconds by stage.
    """

    changes: DataFrame
    class_deltas: DataFrame
    markers: DataFrame
    stats: DataFrame
    old_ids: DataFrame
    new_ids: DataFrame
    header: dict = field(default_factory=dict)
    timings: dict = field(default_factory=dict)


def assign_ids(graph: Graph, guid_policy: str, rounds: int | None = None) -> DataFrame:
    """(step_id, entity_id, method, confidence, hash): ``G:``/``G!:`` by identifier, else ``H:`` by refined structure.

    Entities that share colour and strong component are one ``C:`` class.
    ``rounds`` of refinement; without, as many as the graph's size calls for.
    """
    entities, refs = graph
    named = identity.identify(entities, guid_policy).select("step_id", "entity_id")
    hashes = stored(hashing.structural_hashes(entities, refs).select("step_id", "hash"), "hashes")
    seeds = hashes.select("step_id", F.col("hash").alias("colour"))
    edges = stored(refinement.adjacency(entities, refs), "edges")
    colours, _ = refinement.refine(seeds, edges, rounds)
    ids = entities.select("step_id").join(named, "step_id", "left").join(hashes, "step_id").join(colours, "step_id")
    members = refinement.strong_components(entities.select(F.col("step_id").alias("node")), edges.select(F.col("source_step").alias("a"), F.col("target_step").alias("b")))
    shared = members.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    cyclic = stored(members.join(shared, "component", "left_semi"), "cyclic")
    classes = refinement.ambiguous_classes(colours, cyclic, edges, entities)
    ids = ids.join(classes, "step_id", "left")
    guid_method = F.when(F.col("entity_id").startswith("G!:"), "guid_disambiguated").otherwise("exact_guid")
    method = F.when(F.col("entity_id").isNotNull(), guid_method).when(F.col("class_id").isNotNull(), "equivalence_class").otherwise("exact_hash")
    ids = ids.select("step_id", F.coalesce("entity_id", "class_id", F.concat(F.lit("H:"), "colour")).alias("entity_id"), method.alias("method"), "hash")
    unsure = F.col("method").isin("guid_disambiguated", "equivalence_class")
    return stored(ids.select("step_id", "entity_id", "method", F.when(unsure, 0.0).otherwise(1.0).alias("confidence"), "hash"), "ids")


def _as_one(old: Graph, new: Graph) -> Graph:
    """Both graphs as one: steps of the old one are even, those of the new one odd."""
    sides = []
    for k, (name, (entities, refs)) in enumerate((("old", old), ("new", new))):
        moved = lambda c, k=k: (F.col(c) * 2 + k).alias(c)
        sides.append((
            entities.select(F.lit(name).alias("graph_id"), moved("step_id"), "ord", "entity_type", "global_id", "attributes"),
            refs.select(F.lit(name).alias("graph_id"), moved("source_step"), "ref_ord", "path", moved("target_step"), "target_type"),
        ))
    return sides[0][0].union(sides[1][0]), sides[0][1].union(sides[1][1])


def _header(profile: str, guid_policy: str, geometry_policy: str, policy: dict, schemas: tuple[str, str] | None, stats: dict) -> dict:
    old, new = schemas or (None, None)
    return {
        "version": RESULT_VERSION, "profile": profile, "geometry_policy": geometry_policy,
        "schema_policy": {"mode": "same_schema_only", "old_schema": old, "new_schema": new},
        "identity_policy": {"guid_policy": guid_policy, "matcher_policy": policy}, "stats": stats,
    }


def _unchanged(graph: Graph, guid_policy: str) -> GraphDiff:
    """The comparison of a graph with itself: nothing changed, all matched; the identifier policy still holds."""
    spark = graph[0].sparkSession
    identity.identify(graph[0], guid_policy)
    ids = graph[0].select("step_id", F.coalesce(F.concat(F.lit("G:"), "global_id"), F.concat(F.lit("H:"), F.col("step_id").cast("string"))).alias("entity_id"), F.lit("exact_hash").alias("method"), F.lit(1.0).alias("confidence"), F.lit("").alias("hash"))
    none = spark.createDataFrame([], _CHANGE_SCHEMA)
    stats = ids.groupBy("method").agg(F.count("*").alias("matched"))
    return GraphDiff(none, spark.createDataFrame([], "entity_id string, class_id string, old_count long, new_count long"), spark.createDataFrame([], "marker_type string, relation_type string, child_id string, old_parent_id string, new_parent_id string, source_change_ids array<string>"), stats, ids, ids, {"stats": {}})


_CHANGE_SCHEMA = (
    f"op string, old_entity_id string, new_entity_id string, n int, old_step long, new_step long, entity_type string, field_ops {changes.FIELD_OPS}, change_categories array<string>, stability_tier string, "
    "match_method string, match_confidence double, owner_sample array<string>, owner_total long, old_snapshot string, new_snapshot string, class_id string, old_count long, new_count long, position long, change_id string"
)


def _with_new_ids(pairs: DataFrame, new_ids: DataFrame, method: str, confidence=None) -> DataFrame:
    given = F.lit(1.0) if confidence is None else F.col(confidence)
    return pairs.join(new_ids.select(F.col("step_id").alias("new_step"), F.col("entity_id").alias("new_id")), "new_step").select("old_step", "new_step", "new_id", F.lit(method).alias("method"), given.alias("confidence"))


class _Clock:
    """Times stages and tells the caller of each."""

    def __init__(self, progress: Callable[[dict], None] | None) -> None:
        self.progress, self.timings, self.done = progress, {}, 0

    def tell(self, **event) -> None:
        if self.progress:
            self.progress(event | {"overall_progress": round(self.done / len(_STAGES), 6)})

    def stage(self, name: str) -> Iterator[None]:
        self.tell(stage=name, status="start")
        began = time.perf_counter()
        yield
        self.timings[name] = round((time.perf_counter() - began) * 1000, 3)
        self.done += 1
        self.tell(stage=name, status="done", elapsed_ms=self.timings[name])


def graph_diff(
    old: Graph, new: Graph, profile: str = "semantic_stable", guid_policy: str = "fail_fast", geometry_policy: str = "strict_syntax", matcher_policy: dict | None = None,
    schemas: tuple[str, str] | None = None, snapshots: bool = True, progress: Callable[[dict], None] | None = None,
) -> GraphDiff:
    """Compare two graphs.

    Old entities take the id of what they match, in the order: changed
    identifiers (if few were kept), fingerprints, unique ids, references from
    matched roots, similarity within blocks; a later match overwrites.
    ``progress`` is called at the begin and end of every stage.
    """
    changes.check_geometry_policy(geometry_policy)
    policy = matching.validated_policy(matcher_policy)
    if schemas:
        changes.check_schemas(*schemas)
    same = old is new
    raw = old, new
    old, new = hashing.profiled(*old, profile), hashing.profiled(*new, profile)
    clock = _Clock(progress)
    if same:
        found = _unchanged(old, guid_policy)
        clock.done = len(_STAGES)
        clock.tell(stage="done", status="done")
        found.header = _header(profile, guid_policy, geometry_policy, policy, schemas, {"same_graph": True})
        return found
    for _ in clock.stage("assign_ids"):
        counts = [g[0].count() for g in (old, new)]
        # As one graph, so that both sides have equally many rounds and their colours can be compared.
        assigned = assign_ids(_as_one(old, new), guid_policy, min(map(refinement.round_limit, counts)))
        ids, new_ids = (assigned.where(F.col("step_id") % 2 == k).withColumn("step_id", F.expr("step_id div 2")) for k in (0, 1))
    for _ in clock.stage("root_remap"):
        remap = stored(matching.root_remap(old, new).select("old_step", "new_step"), "remap")
        ids = stored(changes_applied(ids, _with_new_ids(remap, new_ids, "root_remap")), "ids")
    for _ in clock.stage("text_fingerprint"):
        plain, none = [], ids.select("step_id", "hash", F.lit("").alias("near")).limit(0)
        unnamed = all(not g[0].where("global_id IS NULL").isEmpty() for g in (old, new))
        for i, g in ((ids, old), (new_ids, new)) if unnamed else ():
            hashes = i.join(g[0].where("global_id IS NULL").select("step_id"), "step_id", "left_semi").select("step_id", "hash")
            every = i.select("step_id", "hash")
            plain.append(stored(hashes.join(matching.neighbour_signature(g[0], g[1], every), "step_id"), "fingerprints"))
        plain = plain or [none, none]
        text = matching.fingerprint_pairs(*plain).union(matching.refined_pairs(*plain))
        text = stored(_with_new_ids(text, new_ids, "text_fingerprint", "confidence"), "text_pairs")
        ids = stored(changes_applied(ids, text), "ids")
    for _ in clock.stage("path_propagation"):
        exact = identity.unique_pairs(ids, new_ids, "entity_id").select("old_step", "new_step")
        exact = stored(exact.join(text.select("old_step"), "old_step", "left_anti").join(text.select("new_step"), "new_step", "left_anti").union(text.select("old_step", "new_step")), "exact")
        roots = exact.join(old[0].where("global_id IS NOT NULL").select(F.col("step_id").alias("old_step")), "old_step", "left_semi")
        path = _with_new_ids(matching.propagate(roots, old, new, exact), new_ids, "path_propagation")
        ids = stored(changes_applied(ids, path), "ids")
    for _ in clock.stage("secondary_match"):
        resolved = stored(identity.unique_pairs(ids, new_ids, "entity_id").select("old_step", "new_step"), "resolved")
        rest = [stored(g[0].where("global_id IS NULL").select("step_id").join(resolved.select(F.col(c).alias("step_id")), "step_id", "left_anti"), "rest") for g, c in ((old, "old_step"), (new, "new_step"))]
        if any(r.isEmpty() for r in rest):
            spark = rest[0].sparkSession
            secondary = matching.Secondary(spark.createDataFrame([], "block string, old_step long, new_step long, score double, depth int"), spark.createDataFrame([], "block string, side string, step_id long"), 0)
        else:
            secondary = matching.secondary_match(*(matching.features(*g, r) for g, r in zip((old, new), rest)), policy, (old, new))
            ids = stored(changes_applied(ids, _with_new_ids(secondary.pairs, new_ids, "secondary_match", "score")), "ids")
            ids, new_ids = (stored(_as_classes(i, matching.ambiguous_ids(secondary.ambiguous, k)), "ids") for i, k in ((ids, "old"), (new_ids, "new")))

    for _ in clock.stage("class_deltas"):
        deltas = stored(changes.class_deltas(ids, new_ids), "deltas")
        # Classes of equal counts and alike entities that all go by their hash say nothing; those of other counts are class deltas.
        quiet = stored(deltas.select("entity_id").union(_quiet(ids, new_ids)).distinct(), "quiet")
    for _ in clock.stage("base_changes"):
        sides = []
        for g, i in ((old, ids), (new, new_ids)):
            rows = changes.comparable(*g, i.select("step_id", "entity_id", "hash"))
            sides.append(rows.join(quiet, "entity_id", "left_anti"))
        found = changes.base_changes(*sides)
        found = found.withColumn("field_ops", changes.deep_field_ops(F.col("field_ops")))
        found = found.withColumn("change_categories", changes.categories(F.col("op"), F.col("entity_type"), F.col("field_ops")))
        found = stored(found, "base_changes")
        if geometry_policy == "invariant_probe":
            found = stored(found.join(_form_swaps(found, raw), ["old_step", "new_step"], "left_anti"), "probed")
        found = _described(found, deltas, ids, new_ids, old, new, snapshots)
        feed = stored(changes.with_change_ids(found), "feed").select([f.split(" ")[0] for f in _CHANGE_SCHEMA.replace(f"field_ops {changes.FIELD_OPS}", "field_ops x").split(", ")])
    for _ in clock.stage("derived_markers"):
        links = [changes.parent_links(*g, i) for g, i in ((old, ids), (new, new_ids))]
        markers = stored(changes.reparented(*links, changes.change_index(feed)), "markers")
        ordered = ids.join(old[0].select("step_id", "ord"), "step_id")
        matched = stored(changes.match_stats(ordered, new_ids), "stats")
        stats = _stats(matched, secondary, remap, path, counts, raw)
    return GraphDiff(feed, deltas, markers, matched, ids, new_ids, _header(profile, guid_policy, geometry_policy, policy, schemas, stats), clock.timings)


def _quiet(ids: DataFrame, new_ids: DataFrame) -> DataFrame:
    """Ids with equal counts on both sides that are classes, or hashes that all their entities have as they are."""
    sides = [s.where(F.col("entity_id").rlike("^[CH]:")).groupBy("entity_id").agg(F.count("*").alias(n), F.min(F.col("method") == "exact_hash").alias(f"{n}_exact")) for s, n in ((ids, "a"), (new_ids, "b"))]
    both = sides[0].join(sides[1], "entity_id").where("a = b")
    return both.where(F.col("entity_id").startswith("C:") | (F.col("a_exact") & F.col("b_exact"))).select("entity_id")


def _described(found: DataFrame, deltas: DataFrame, ids: DataFrame, new_ids: DataFrame, old: Graph, new: Graph, snapshots: bool) -> DataFrame:
    """Changes and class deltas with identity, owners, snapshots and class counts."""
    sides = [i.select(F.col("step_id").alias(c), F.struct("method", "confidence").alias(k)) for i, c, k in ((ids, "old_step", "a"), (new_ids, "new_step", "b"))]
    rows = found.join(sides[0], "old_step", "left").join(sides[1], "new_step", "left")
    method, confidence = changes.resolved_identity(F.col("a"), F.col("b"))
    rows = rows.withColumns({"match_method": method, "match_confidence": confidence, "class_id": F.lit(None).cast("string"), "old_count": F.lit(None).cast("long"), "new_count": F.lit(None).cast("long")}).drop("a", "b")
    key = F.concat_ws("|", "op", F.coalesce("old_entity_id", "new_entity_id"), F.col("n").cast("string"))
    rows = rows.withColumn("key", key).withColumn("stability_tier", changes.stability_tier(F.coalesce("old_entity_id", "new_entity_id")))
    classes = deltas.select(
        F.lit("CLASS_DELTA").alias("op"), F.col("entity_id").alias("old_entity_id"), F.col("entity_id").alias("new_entity_id"), F.lit(1).alias("n"), F.lit("equivalence_class").alias("match_method"), F.lit(1.0).alias("match_confidence"),
        "class_id", "old_count", "new_count", F.array(F.lit("CLASS_DELTA")).alias("change_categories"), F.lit("C").alias("stability_tier"), F.concat(F.lit("CLASS_DELTA|"), "entity_id").alias("key"), F.array().cast(changes.FIELD_OPS).alias("field_ops"),
    )
    exemplar = new_ids.join(deltas.select("entity_id"), "entity_id").groupBy("entity_id").agg(F.min("step_id").alias("new_step")).join(new[0].select(F.col("step_id").alias("new_step"), "entity_type"), "new_step")
    classes = classes.join(exemplar.select(F.col("entity_id").alias("old_entity_id"), "entity_type", "new_step"), "old_entity_id", "left")
    rows = stored(rows.unionByName(classes, allowMissingColumns=True), "described")
    # Owners of every entity a change is about; of a class, of all its members on both sides.
    owned = None
    for g, i, c in ((old, ids, "old_step"), (new, new_ids, "new_step")):
        of = rows.where((F.col("op") != "CLASS_DELTA") & F.col(c).isNotNull()).select("key", F.col(c).alias("step_id"))
        of = of.union(i.join(deltas.select("entity_id"), "entity_id").select(F.concat(F.lit("CLASS_DELTA|"), "entity_id"), "step_id"))
        owners = of.join(refinement.rooted_owners(*g, of, i), "step_id").select("key", "owner")
        owned = owners if owned is None else owned.union(owners)
    summary = refinement.owner_summary(owned.distinct().withColumnRenamed("key", "step_id")).select(F.col("step_id").alias("key"), F.col("sample").alias("owner_sample"), F.col("total").alias("owner_total"))
    rows = rows.join(summary, "key", "left").withColumn("owner_total", F.coalesce("owner_total", F.lit(0)).cast("long")).withColumn("owner_sample", F.coalesce("owner_sample", F.array().cast("array<string>")))
    shown = {"old_snapshot": (old, "old_step", "op = 'REMOVE'"), "new_snapshot": (new, "new_step", "op IN ('ADD', 'CLASS_DELTA')")}
    for name, (g, step, when) in shown.items():
        if snapshots:
            wanted = rows.where(when).select(F.col(step).alias("step_id")).distinct()
            rows = rows.join(changes.snapshots(*g, wanted).select(F.col("step_id").alias(step), F.col("snapshot").alias(name)), step, "left").withColumn(name, F.when(F.expr(when), F.col(name)))
        else:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return rows.drop("key")


def _form_swaps(found: DataFrame, graphs: tuple[Graph, Graph]) -> DataFrame:
    """(old_step, new_step) of modifications of geometry whose representation has the same points, box and centroid on both sides."""
    only = F.array_contains("change_categories", "GEOMETRY") & (F.size(F.array_except("change_categories", F.array(*map(F.lit, ("GEOMETRY", "ATTRIBUTES", "RELATIONSHIP"))))) == 0)
    swaps = stored(found.where((F.col("op") == "MODIFY") & only).select("old_step", "new_step"), "swaps")
    shapes = []
    for (entities, refs), step, name in zip(graphs, ("old_step", "new_step"), "ab"):
        heads = refs.where(F.col("path").startswith("/Representation")).join(swaps.select(F.col(step).alias("source_step")), "source_step", "left_semi").select(F.col("source_step").alias("owner"), F.col("target_step").alias("step_id")).distinct()
        met = geometry.reachable(heads.select("step_id").distinct(), refs).join(heads, "step_id").select(F.col("owner").alias("step_id"), F.col("at").alias("point_step")).distinct()
        points = met.join(geometry.cartesian_points(entities), "point_step")
        boxed = signatures.centroid_and_box(points)
        shapes.append(boxed.select(F.col("step_id").alias(step), F.struct(*boxed.columns[1:]).alias(name)))
    both = swaps.join(shapes[0], "old_step").join(shapes[1], "new_step")
    return both.where(signatures.invariants_match(F.col("a"), F.col("b"))).select("old_step", "new_step")


def _stats(matched: DataFrame, secondary: matching.Secondary, remap: DataFrame, path: DataFrame, counts: list[int], graphs: tuple[Graph, Graph]) -> dict:
    by_method = {r["method"]: r["matched"] for r in matched.orderBy("method").collect()}
    quality = [{k: v for r in identity.guid_quality(g[0].where("global_id IS NOT NULL")).drop("graph_id").collect() for k, v in r.asDict().items()} for g in graphs]
    return {
        "old_entities": counts[0], "new_entities": counts[1], "matched": sum(by_method.values()), "matched_by_method": by_method,
        "ambiguous": int(secondary.ambiguous_count), "stage_matches": {"root_remap": remap.count(), "path_propagation": path.count(), "secondary_match": secondary.pairs.count()},
        "dangling_refs": {"old": index.dangling_count(*graphs[0]), "new": index.dangling_count(*graphs[1])}, "guid_quality": {"old": quality[0], "new": quality[1]},
    }


def _as_classes(ids: DataFrame, classes: DataFrame) -> DataFrame:
    """``ids`` where entities that the matching could not tell apart have their class instead."""
    rows = ids.join(classes, "step_id", "left")
    known = F.col("class_id").isNotNull()
    return rows.select("step_id", F.coalesce("class_id", "entity_id").alias("entity_id"), F.when(known, "equivalence_class").otherwise(F.col("method")).alias("method"), F.when(known, 0.0).otherwise(F.col("confidence")).alias("confidence"), "hash")


def changes_applied(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """``ids`` with the new side's id and the method of each pair; of several pairs of one entity the last by new step."""
    taken = pairs.groupBy(F.col("old_step").alias("step_id")).agg(F.max_by(F.struct("new_id", F.col("method").alias("by"), F.col("confidence").alias("sure")), "new_step").alias("t"))
    rows = ids.join(taken.select("step_id", "t.*"), "step_id", "left")
    return rows.select("step_id", F.coalesce("new_id", "entity_id").alias("entity_id"), F.coalesce("by", "method").alias("method"), F.coalesce("sure", "confidence").alias("confidence"), "hash")


def diff_files(spark, old_path: str, new_path: str, schema=None, progress: Callable[[dict], None] | None = None, **options) -> GraphDiff:
    """:func:`graph_diff` of two STEP files; files of different schemas are an error, and one file with itself is read once."""
    from quern.sources import cache, step

    began = time.perf_counter()
    same = step.same_file(spark, old_path, new_path)
    old = cache.kept_graph(spark, old_path, schema)
    new = old if same else cache.kept_graph(spark, new_path, schema)
    parsed = round((time.perf_counter() - began) * 1000, 3)
    found = graph_diff(old.graph, old.graph if same else new.graph, schemas=(old.schema, new.schema), progress=progress, **options)
    found.timings = {"parse": parsed} | found.timings
    return found


def header_json(found: GraphDiff) -> str:
    return json.dumps(found.header, sort_keys=True, separators=(",", ":"), default=lambda x: x.isoformat() if isinstance(x, datetime) else str(x))
