"""The change feed between two graphs whose entities have comparable ids."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.canonical import FIELD, SEP, rewritten_target, strip_ref_ids
from quern.plans.loops import placed

#: Relations that place a child under a parent; priority of match methods.
PARENT_RELATIONS = ("IfcRelContainedInSpatialStructure", "IfcRelAggregates", "IfcRelNests")
METHOD_PRIORITY = {"root_remap": 5, "path_propagation": 4, "text_fingerprint": 3, "secondary_match": 3, "exact_guid": 2, "guid_disambiguated": 2, "exact_hash": 1, "equivalence_class": 0}
GEOMETRY_POLICIES = ("strict_syntax", "invariant_probe")


def check_schemas(old: str, new: str) -> None:
    if old != new:
        raise ValueError(f"Schema mismatch: {old} vs {new}")


def check_geometry_policy(policy: str) -> None:
    if policy not in GEOMETRY_POLICIES:
        raise ValueError(f"Unknown geometry policy: {policy}")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with the occurrence of each entity_id in file order; a running count, which keeps no rows in memory."""
    return rows.withColumn("n", F.row_number().over(W.partitionBy("entity_id").orderBy("ord")))


def comparable(entities: DataFrame, refs: DataFrame, ids: DataFrame) -> DataFrame:
    """(entity_id, ord, step_id, entity_type, attributes, links, hash): references in order, as path and target id.

    ``ids(step_id, entity_id)`` may have the structural hash as well; entities
    that go by their hash are compared by it, not by what they refer to.
    """
    if "hash" not in ids.columns:
        ids = ids.withColumn("hash", F.lit(None).cast("string"))
    named = refs.join(ids.select(F.col("step_id").alias("target_step"), F.col("entity_id").alias("target_id")), "target_step", "left")
    link = F.struct("ref_ord", F.concat_ws(FIELD, "path", rewritten_target(F.col("target_id"), F.col("target_step"))).alias("link"))
    links = named.groupBy("source_step").agg(F.transform(F.array_sort(F.collect_list(link)), lambda x: x["link"]).alias("links"))
    rows = entities.join(ids, "step_id").join(links, F.col("step_id") == F.col("source_step"), "left")
    # References in attributes are compared by the links, which say what they mean; their steps say nothing.
    attributes = F.transform_values("attributes", lambda k, v: strip_ref_ids(v)).alias("attributes")
    return rows.select("entity_id", "ord", "step_id", "entity_type", attributes, F.coalesce("links", F.array().cast("array<string>")).alias("links"), "hash")


def base_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two sides of :func:`comparable`: op, ids, steps and field operations.

    Entities of one id pair by occurrence; what has no partner was added or
    removed; a pair that differs in type, attributes or links was modified.
    Unequal rows are found by comparing digests within the join.
    """
    digest = F.sha2(F.concat_ws("\n", "entity_type", F.array_join(F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), SEP), F.array_join("links", SEP)), 256)
    digest = F.when(F.col("entity_id").startswith("H:"), F.coalesce("hash", digest)).otherwise(digest)
    sides = [numbered(s).select("entity_id", "n", F.struct("step_id", "entity_type", "attributes", "links", digest.alias("digest")).alias(k)) for s, k in ((old, "o"), (new, "w"))]
    both = sides[0].join(sides[1], ["entity_id", "n"], "full_outer").where(~F.col("o.digest").eqNullSafe(F.col("w.digest")))
    op = F.when(F.col("o").isNull(), "ADD").when(F.col("w").isNull(), "REMOVE").otherwise("MODIFY")
    rows = both.select("entity_id", "n", op.alias("op"), "o", "w")
    return rows.select(
        "op", F.when(F.col("o").isNotNull(), F.col("entity_id")).alias("old_entity_id"), F.when(F.col("w").isNotNull(), F.col("entity_id")).alias("new_entity_id"), "n",
        F.col("o.step_id").alias("old_step"), F.col("w.step_id").alias("new_step"), F.coalesce("w.entity_type", "o.entity_type").alias("entity_type"),
        F.when(F.col("op") == "MODIFY", field_operations(F.col("o"), F.col("w"))).otherwise(F.array().cast(FIELD_OPS)).alias("field_ops"),
    )


FIELD_OPS = "array<struct<path:string,op:string,old:string,new:string>>"


def _field_op(path: Column, old: Column, new: Column) -> Column:
    op = F.when(old.isNull(), "add").when(new.isNull(), "remove").otherwise("replace")
    return F.struct(path.alias("path"), op.alias("op"), old.alias("old"), new.alias("new"))


def field_operations(old: Column, new: Column) -> Column:
    """Differences of two structs with entity_type, attributes and links: by attribute name, then by position."""
    names = F.array_sort(F.array_union(F.map_keys(old["attributes"]), F.map_keys(new["attributes"])))
    fields = F.transform(names, lambda k: _field_op(F.concat(F.lit("/attributes/"), k), old["attributes"][k], new["attributes"][k]))
    last = F.greatest(F.size(old["links"]), F.size(new["links"]))
    places = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    links = F.transform(places, lambda i: _field_op(F.concat(F.lit("/refs/"), i.cast("string")), F.get(old["links"], i), F.get(new["links"], i)))
    kind = F.array(_field_op(F.lit("/entity_type"), old["entity_type"], new["entity_type"]))
    # A reference held by an attribute, which :func:`comparable` leaves out there, differs as that attribute's too.
    path, target = (lambda x: F.substring_index(x, FIELD, 1)), (lambda x: F.concat(F.lit('"'), F.substring_index(x, FIELD, -1), F.lit('"')))
    held = lambda i: (path(F.get(old["links"], i)) == path(F.get(new["links"], i))) & F.array_contains(names, F.regexp_extract(path(F.get(old["links"], i)), "^/([^/@]+)", 1))
    within = F.transform(F.filter(places, lambda i: F.coalesce(held(i), F.lit(False))), lambda i: _field_op(F.concat(F.lit("/attributes"), path(F.get(old["links"], i)), F.lit("/id")), target(F.get(old["links"], i)), target(F.get(new["links"], i))))
    return F.filter(F.concat(fields, within, kind, links), lambda f: ~f["old"].eqNullSafe(f["new"])).cast(FIELD_OPS)


def categories(op: Column, entity_type: Column, field_ops: Column) -> Column:
    """Sorted categories of a change by operation, type and paths."""
    starts = lambda *prefixes: F.exists(field_ops, lambda f: F.rlike(f["path"], F.lit("^(" + "|".join(prefixes) + ")")))
    found = F.array_compact(
        F.array(
            F.when(starts("/attributes") | ((op == "MODIFY") & (F.size(field_ops) == 0) & ~entity_type.startswith("IfcRel")), "ATTRIBUTES"),
            F.when(starts("/entity_type"), "CLASS"),
            F.when(op == "CLASS_DELTA", "CLASS_DELTA"),
            F.when(op.isin("ADD", "REMOVE"), "ENTITY"),
            F.when(starts(*(f"/attributes/{a}" for a in ("ObjectPlacement", "Representation", "RelativePlacement", "Coordinates"))), "GEOMETRY"),
            F.when(starts("/refs") | (entity_type.startswith("IfcRel") & (op != "CLASS_DELTA")), "RELATIONSHIP"),
        )
    )
    return F.array_sort(found)


def class_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids of classes of alike entities whose counts differ, for sides of (entity_id, method).

    ``C:`` ids always are classes; ``H:`` ids are if all their entities have
    them by exact hash. An id that one side lacks is added or removed instead.
    """
    sides = [s.groupBy("entity_id").agg(F.count("*").alias(n), F.min(F.col("method") == "exact_hash").alias(f"{n}_exact")) for s, n in ((old, "old_count"), (new, "new_count"))]
    both = sides[0].join(sides[1], "entity_id").where("old_count <> new_count")
    exact = F.col("entity_id").startswith("H:") & F.col("old_count_exact") & F.col("new_count_exact")
    kept = both.where(F.col("entity_id").startswith("C:") | exact)
    return kept.select("entity_id", F.concat(F.lit("C:"), F.expr("substr(entity_id, 3)")).alias("class_id"), "old_count", "new_count")


def stability_tier(entity_id: Column) -> Column:
    """G for plain identifiers only; all other ids but class deltas report H."""
    return F.when(entity_id.startswith("G:"), "G").otherwise("H")


def resolved_identity(old: Column, new: Column) -> tuple[Column, Column]:
    """Method and confidence of two structs with both: of higher priority, then of higher confidence; the old one on ties."""
    rank = F.create_map(*(F.lit(x) for kv in METHOD_PRIORITY.items() for x in kv))
    order = lambda s: F.struct(F.coalesce(rank[s["method"]], F.lit(0)), s["confidence"])
    best = F.when(old.isNull() | (new.isNotNull() & (order(new) > order(old))), new).otherwise(old)
    return best["method"], best["confidence"]


def _deep_ops(path: str, old, new) -> list[dict]:
    """Differences of two parsed JSON values, by key and by position."""
    if old == new and type(old) is type(new):
        return []
    one = lambda p, op, o, n: {"path": p or "/", "op": op, "old": None if o is None else json.dumps(o, sort_keys=True, separators=(",", ":")), "new": None if n is None else json.dumps(n, sort_keys=True, separators=(",", ":"))}
    if type(old) is type(new) and isinstance(old, dict):
        out = []
        for k in sorted({*old, *new}):
            at = f"{path}/{k}"
            out += [one(at, "add", None, new[k])] if k not in old else [one(at, "remove", old[k], None)] if k not in new else _deep_ops(at, old[k], new[k])
        return out
    if type(old) is type(new) and isinstance(old, list):
        out = [x for i, (o, n) in enumerate(zip(old, new)) for x in _deep_ops(f"{path}/{i}", o, n)]
        out += [one(f"{path}/{i}", "remove", old[i], None) for i in range(len(new), len(old))]
        return out + [one(f"{path}/{i}", "add", None, new[i]) for i in range(len(old), len(new))]
    return [one(path, "replace", old, new)]


def deep_field_ops(field_ops: Column) -> Column:
    """Field operations of :func:`field_operations` taken down to the smallest differing part of each value.

    Values are nested to any depth, which columns can't recurse into; only the
    modified entities pass this Arrow function.
    """
    def parsed(path: str, value: str | None):
        if value is None:
            return None
        if path.startswith("/refs/"):
            name, _, target = value.partition(FIELD)
            return {"path": name, "target": target}
        return json.loads(value) if path.startswith("/attributes/") else value

    @F.pandas_udf(FIELD_OPS)
    def deeper(ops: pd.Series) -> pd.Series:
        def one(op) -> list[dict]:
            path, kind = op["path"], op["op"]
            old, new = parsed(path, op["old"]), parsed(path, op["new"])
            return _deep_ops(path, old, new) if kind == "replace" else [{"path": path, "op": kind, "old": op["old"], "new": op["new"]}]

        return ops.map(lambda row: [x for op in row for x in one(op)] if row is not None else None)

    return deeper(field_ops)


def snapshots(entities: DataFrame, refs: DataFrame, steps: DataFrame) -> DataFrame:
    """(step_id, snapshot): type, attributes and references of entities as one JSON text."""
    wanted = steps.select("step_id")
    link = F.struct("ref_ord", F.struct("path", F.col("target_step").alias("target"), "target_type").alias("r"))
    links = refs.join(wanted.withColumnRenamed("step_id", "source_step"), "source_step", "left_semi").groupBy("source_step").agg(F.transform(F.array_sort(F.collect_list(link)), lambda x: x["r"]).alias("links"))
    rows = entities.join(wanted, "step_id", "left_semi").join(links, F.col("step_id") == F.col("source_step"), "left")
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))), ",")
    text = F.concat(F.lit('{"attributes":{'), pairs, F.lit('},"entity_type":"'), "entity_type", F.lit('","refs":'), F.coalesce(F.to_json("links", {"ignoreNullFields": "false"}), F.lit("[]")), F.lit("}"))
    return rows.select("step_id", text.alias("snapshot"))


def with_change_ids(changes: DataFrame) -> DataFrame:
    """Numbers chg-000001, ... over entity id, then pairs, removals and additions; beyond a million they grow longer."""
    rank = F.when(F.col("op").isin("MODIFY", "CLASS_DELTA"), 0).when(F.col("op") == "REMOVE", 1).otherwise(2)
    keyed = changes.withColumns({"_id": F.coalesce("old_entity_id", "new_entity_id"), "_rank": rank})
    return placed(keyed, "_id", "_rank", "n").withColumn("change_id", F.format_string("chg-%06d", "position")).drop("_id", "_rank")


def op_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("op").agg(F.count("*").alias("n"))


def change_index(changes: DataFrame) -> DataFrame:
    """(entity_id, change_id): which changes name an entity on either side."""
    return changes.select(F.explode(F.array_distinct(F.array_compact(F.array("old_entity_id", "new_entity_id")))).alias("entity_id"), "change_id")


def match_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    """(method, matched) over ids on both sides: of each, the methods of the first old occurrences that have a partner."""
    rows = numbered(old).select("entity_id", "n", "method").join(new.groupBy("entity_id").agg(F.count("*").alias("partners")), "entity_id")
    return rows.where("n <= partners").groupBy("method").agg(F.count("*").alias("matched"))


def parent_links(entities: DataFrame, refs: DataFrame, ids: DataFrame, relations: tuple[str, ...] = PARENT_RELATIONS) -> DataFrame:
    """(relation_type, child_id, parent_id, relation_id) of relation entities with one parent; children with two parents are left out."""
    kinds = entities.where(F.col("entity_type").isin(*relations)).join(ids.select("step_id", F.col("entity_id").alias("relation_id")), "step_id").select(F.col("step_id").alias("source_step"), F.col("entity_type").alias("relation_type"), "relation_id", "ord")
    named = refs.join(kinds, "source_step").join(ids.select(F.col("step_id").alias("target_step"), F.col("entity_id").alias("target_id")), "target_step", "left")
    parents = named.where(F.col("path").startswith("/Relating")).groupBy("source_step").agg(F.count_distinct("target_step").alias("k"), F.first("target_id").alias("parent_id")).where("k = 1 AND parent_id IS NOT NULL")
    children = named.where(F.col("path").startswith("/Related") & F.col("target_id").isNotNull()).select("source_step", "relation_type", "relation_id", "ord", F.col("target_id").alias("child_id"))
    links = children.join(parents.select("source_step", "parent_id"), "source_step")
    return links.groupBy("relation_type", "child_id").agg(F.count_distinct("parent_id").alias("k"), F.max_by("parent_id", "ord").alias("parent_id"), F.max_by("relation_id", "ord").alias("relation_id")).where("k = 1").drop("k")


def direct_links(refs: DataFrame, ids: DataFrame, path: str) -> DataFrame:
    """Parent links of one reference path, as of a relation named by it."""
    child, parent = ids.select(F.col("step_id").alias("source_step"), F.col("entity_id").alias("child_id")), ids.select(F.col("step_id").alias("target_step"), F.col("entity_id").alias("parent_id"))
    return refs.where(F.col("path") == path).join(child, "source_step").join(parent, "target_step").select(F.lit(path).alias("relation_type"), "child_id", "parent_id")


def reparented(old: DataFrame, new: DataFrame, by_entity: DataFrame | None = None) -> DataFrame:
    """REPARENT markers: children of both sides whose parent is another now.

    With ``by_entity`` of :func:`change_index` each has the ids of the changes
    of the child, its parents and the relations.
    """
    sides = [s.select("relation_type", "child_id", F.col("parent_id").alias(f"{n}_parent_id"), *([F.col("relation_id").alias(f"{n}_relation_id")] if by_entity is not None else [])) for s, n in ((old, "old"), (new, "new"))]
    both = sides[0].join(sides[1], ["relation_type", "child_id"]).where("old_parent_id <> new_parent_id")
    marker = [F.lit("REPARENT").alias("marker_type"), "relation_type", "child_id", "old_parent_id", "new_parent_id"]
    if by_entity is None:
        return both.select(*marker)
    named = F.array_distinct(F.array("old_relation_id", "new_relation_id", "child_id", "old_parent_id", "new_parent_id"))
    about = both.select("relation_type", "child_id", F.explode(named).alias("entity_id")).join(by_entity, "entity_id").groupBy("relation_type", "child_id").agg(F.array_sort(F.collect_set("change_id")).alias("source_change_ids"))
    rows = both.join(about, ["relation_type", "child_id"], "left")
    return rows.select(*marker, F.coalesce("source_change_ids", F.array().cast("array<string>")).alias("source_change_ids"))


def bulk_moves(moves: DataFrame, least: int = 5) -> DataFrame:
    """(dx, dy, dz, n): displacements that at least ``least`` entities share. Known from tests and prose only."""
    return moves.groupBy("dx", "dy", "dz").agg(F.count("*").alias("n")).where(F.col("n") >= least)
