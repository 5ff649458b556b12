"""Identifiers of entities: their quality, disambiguation, and unique pairs between two graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GUID_POLICIES = ("fail_fast", "disambiguate")


def _valid():
    return F.col("global_id").isNotNull() & (F.trim("global_id") != "")


def guid_quality(entities: DataFrame) -> DataFrame:
    """One row a graph: valid_total, unique_valid, duplicate_ids, duplicate_occurrences, invalid."""
    by = entities.groupBy("graph_id", "global_id").agg(F.count("*").alias("n"))
    total = lambda test, value: F.sum(F.when(test, value).otherwise(0)).cast("long")
    valid, many = _valid(), F.col("n") > 1
    return by.groupBy("graph_id").agg(
        total(valid, F.col("n")).alias("valid_total"),
        total(valid & ~many, F.lit(1)).alias("unique_valid"),
        total(valid & many, F.lit(1)).alias("duplicate_ids"),
        total(valid & many, F.col("n")).alias("duplicate_occurrences"),
        total(~valid & F.col("global_id").isNotNull(), F.col("n")).alias("invalid"),
    )


def collision_count(entities: DataFrame) -> DataFrame:
    """One row a graph: how many identifiers more than one entity has."""
    by = entities.where(_valid()).groupBy("graph_id", "global_id").agg(F.count("*").alias("n"))
    return by.groupBy("graph_id").agg(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).cast("long").alias("collisions"))


def identify(entities: DataFrame, policy: str = "fail_fast") -> DataFrame:
    """Entities with an identifier, plus entity_id: ``G:<guid>`` or, where that is ambiguous or blank, ``G!:...#n``.

    "fail_fast" raises for the latter; "disambiguate" numbers them by step.
    """
    if policy not in GUID_POLICIES:
        raise ValueError(f"Unknown guid policy: {policy}")
    named = entities.where("global_id IS NOT NULL")
    if policy == "fail_fast":
        for row in guid_quality(named).collect():
            if row.duplicate_ids or row.invalid:
                raise ValueError(f"GUID policy violation in {row.graph_id}: {row.duplicate_ids} duplicate ids, {row.invalid} invalid")
        return named.withColumn("entity_id", F.concat(F.lit("G:"), "global_id"))
    key = F.when(_valid(), F.col("global_id")).otherwise("INVALID")
    counted = named.withColumn("key", key)
    many = counted.groupBy("graph_id", "key").agg(F.count("*").alias("n")).where("n > 1 OR key = 'INVALID'")
    # Only ambiguous entities are numbered; the others never pass a window.
    again = counted.join(many.select("graph_id", "key"), ["graph_id", "key"], "left_semi")
    numbered = again.withColumn("entity_id", F.concat(F.lit("G!:"), "key", F.lit("#"), F.row_number().over(W.partitionBy("graph_id", "key").orderBy("step_id")).cast("string")))
    single = counted.join(many.select("graph_id", "key"), ["graph_id", "key"], "left_anti").withColumn("entity_id", F.concat(F.lit("G:"), "global_id"))
    return single.unionByName(numbered).drop("key")


def unique_side(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name) of keys that one row has."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min("step_id").alias(name)).where("n = 1").select(key, name)


def unique_pairs(old: DataFrame, new: DataFrame, key: str = "global_id") -> DataFrame:
    """(key, old_step, new_step) of keys that one entity of either side has."""
    return unique_side(old, key, "old_step").join(unique_side(new, key, "new_step"), key)


def guid_overlap(old: DataFrame, new: DataFrame) -> float:
    """Share of the old unique identifiers that are unique in the new graph too; 1 without any."""
    before = unique_side(old, "global_id", "old_step")
    total = before.count()
    return before.join(unique_side(new, "global_id", "new_step"), "global_id").count() / total if total else 1.0
