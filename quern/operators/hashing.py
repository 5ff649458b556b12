"""Fingerprints of entities: structural, textual, semantic and over their parts.

All digests are SHA-256 of text that is put together by column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.canonical import FIELD, SEP, strip_ref_ids, value_shape

OWNER_ATTRIBUTE = "OwnerHistory"


def profiled(entities: DataFrame, refs: DataFrame, profile: str = "semantic_stable") -> tuple[DataFrame, DataFrame]:
    """The graph as a profile sees it: "semantic_stable" is without ownership, "raw_exact" is all."""
    if profile == "raw_exact":
        return entities, refs
    if profile != "semantic_stable":
        raise ValueError(f"Unknown profile: {profile}")
    kept = F.map_filter("attributes", lambda k, v: k != OWNER_ATTRIBUTE)
    blank = F.create_map().cast("map<string,string>")
    attributes = F.when(F.col("entity_type") == "IfcOwnerHistory", blank).otherwise(kept)
    return entities.withColumn("attributes", attributes), refs.where(~F.col("path").startswith(f"/{OWNER_ATTRIBUTE}"))


def attribute_text(attributes: Column, value=strip_ref_ids) -> Column:
    """``name=value`` for each attribute by name, without the ids of references."""
    pairs = F.transform(F.map_entries(attributes), lambda e: F.concat(e["key"], F.lit("="), value(e["value"])))
    return F.array_join(F.array_sort(pairs), SEP)


def edge_signature(refs: DataFrame) -> DataFrame:
    """(graph_id, step_id, edges): the multiset of (path, target type, count) of each source, as sorted text."""
    counted = refs.groupBy("graph_id", "source_step", "path", "target_type").agg(F.count("*").alias("n"))
    one = F.concat_ws(FIELD, "path", F.coalesce("target_type", F.lit("")), F.col("n").cast("string"))
    text = F.array_join(F.array_sort(F.collect_list(one)), SEP)
    return counted.groupBy("graph_id", F.col("source_step").alias("step_id")).agg(text.alias("edges"))


def structural_hashes(entities: DataFrame, refs: DataFrame) -> DataFrame:
    """(graph_id, step_id, hash): digest of type, attributes without reference ids, and edge multiset.

    Targets do not count, so the hash tells the form of an entity, not its place.
    """
    rows = entities.join(edge_signature(refs), ["graph_id", "step_id"], "left")
    text = F.concat_ws("\n", "entity_type", attribute_text(F.col("attributes")), F.coalesce("edges", F.lit("")))
    return rows.select("graph_id", "step_id", F.sha2(text, 256).alias("hash"))


def semantic_signatures(entities: DataFrame) -> DataFrame:
    """(graph_id, step_id, signature): digest of type and shapes of attributes, without literals."""
    text = F.concat_ws("\n", "entity_type", attribute_text(F.col("attributes"), value_shape))
    return entities.select("graph_id", "step_id", F.sha2(text, 256).alias("signature"))


def merkle_hashes(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(step_id, hash) of an acyclic part graph: each digest covers the digests of the parts.

    ``edges(source_step, label, target_step)`` lead to parts. Level by level,
    an entity is hashed once all its parts are. A part that is no entity
    counts as missing. What is left when a level adds nothing lies on or above
    a cycle and counts as cyclic by its step.
    """
    from quern.plans.loops import stored

    own = entities.select("step_id", F.concat_ws(SEP, F.concat(F.lit("class="), "entity_type"), F.array_join(F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat(F.lit("attr="), e["key"], F.lit(":"), e["value"]))), SEP)).alias("own"))
    links = edges.select("source_step", "label", "target_step")
    gone = links.join(own.select(F.col("step_id").alias("target_step")), "target_step", "left_anti").select(F.col("target_step").alias("step_id")).distinct()
    done = gone.select("step_id", F.sha2(F.concat(F.lit("missing:"), F.col("step_id").cast("string")), 256).alias("hash"))
    fan = links.groupBy("source_step").agg(F.count("*").alias("parts"))
    pending = own.join(fan.withColumnRenamed("source_step", "step_id"), "step_id", "left").fillna(0, ["parts"])
    leaves = pending.where("parts = 0").select("step_id", F.sha2("own", 256).alias("hash"))
    done, pending = stored(done.union(leaves), "merkle"), stored(pending.where("parts > 0"), "pending")
    while True:
        known = links.join(done.select(F.col("step_id").alias("target_step"), "hash"), "target_step")
        known = known.join(pending.select(F.col("step_id").alias("source_step")), "source_step", "left_semi")
        entry = F.concat(F.lit("edge="), "label", F.lit(":"), "hash")
        ready = known.groupBy("source_step").agg(F.count("*").alias("known"), F.array_join(F.array_sort(F.collect_list(entry)), SEP).alias("below"))
        level = pending.join(ready, (pending["step_id"] == ready["source_step"]) & (pending["parts"] == ready["known"]))
        level = stored(level.select("step_id", F.sha2(F.concat_ws(SEP, "own", "below"), 256).alias("hash")), "level")
        if level.isEmpty():
            break
        done = done.union(level)
        pending = stored(pending.join(level, "step_id", "left_anti"), "pending")
    cyclic = pending.select("step_id", F.sha2(F.concat(F.lit("cycle:"), F.col("step_id").cast("string")), 256).alias("hash"))
    return done.union(cyclic).join(entities.select("step_id"), "step_id", "left_semi")


def topology_hashes(seeds: DataFrame, context: DataFrame, spatial: DataFrame) -> DataFrame:
    """(step_id, hash) over the seeds of neighbours: one step away by context edges, up to two by spatial ones.

    ``seeds(step_id, seed)``; edges are (a, b), followed both ways. An
    entity met by both kinds of edge counts twice, itself never.
    """

    def both(edges: DataFrame) -> DataFrame:
        return edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").where("a <> b").distinct()

    near, one = both(context), both(spatial)
    two = one.join(one.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).where("a <> b")
    around = near.withColumn("how", F.lit("context:")).union(one.union(two).distinct().withColumn("how", F.lit("spatial:")))
    named = around.join(seeds.select(F.col("step_id").alias("b"), "seed"), "b", "left")
    tokens = named.groupBy("a").agg(F.array_sort(F.collect_list(F.concat("how", F.coalesce("seed", F.lit(""))))).alias("tokens"))
    rows = seeds.join(tokens, seeds["step_id"] == tokens["a"], "left")
    own = F.array(F.concat(F.lit("self:"), "seed"))
    text = F.array_join(F.when(F.col("tokens").isNull(), own).otherwise(F.concat(own, "tokens")), SEP)
    return rows.select("step_id", F.sha2(text, 256).alias("hash"))
