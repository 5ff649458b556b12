"""Queries on one graph: filters by type, identifier, attribute and labelled edge.

There is no eager index: every accessor is a DataFrame over ``entities`` and
``refs``, so filters and column pruning reach the files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.canonical import NULL_VALUE, provenance


class GraphIndex:
    """Accessors over the entities and references of one graph.

    ``type_closure(type, ancestor)`` says which types count as which, a type
    counting as itself; without it queries that include subtypes are errors.
    """

    def __init__(self, entities: DataFrame, refs: DataFrame, type_closure: DataFrame | None = None) -> None:
        self.entities, self.refs, self.type_closure = entities, refs, type_closure

    # types
    def entities_of_type(self, entity_type: str, include_subtypes: bool = False) -> DataFrame:
        if not include_subtypes:
            return self.entities.where(F.col("entity_type") == entity_type)
        if self.type_closure is None:
            raise ValueError("include_subtypes needs a type closure")
        wanted = self.type_closure.where(F.col("ancestor") == entity_type).select(F.col("type").alias("entity_type"))
        return self.entities.join(wanted, "entity_type", "left_semi")

    def type_counts(self) -> DataFrame:
        return self.entities.groupBy("entity_type").agg(F.count("*").alias("n"))

    def has_type(self, entity_type: str) -> bool:
        return not self.entities_of_type(entity_type).isEmpty()

    def total_entities(self) -> int:
        return self.entities.count()

    # identifiers
    def all_guids(self) -> DataFrame:
        return self.entities.where("global_id IS NOT NULL").select("global_id").distinct()

    def entities_by_guid(self) -> DataFrame:
        """(global_id, steps) with the steps in ascending order; empty identifiers are indexed too."""
        return self.entities.where("global_id IS NOT NULL").groupBy("global_id").agg(F.array_sort(F.collect_list("step_id")).alias("steps"))

    def unique_guids(self) -> DataFrame:
        """(global_id, step_id) of identifiers that one entity has."""
        named = self.entities.where("global_id IS NOT NULL").groupBy("global_id").agg(F.count("*").alias("n"), F.min("step_id").alias("step_id"))
        return named.where("n = 1").select("global_id", "step_id")

    def entity_by_guid(self, guid: str) -> int | None:
        """The step with an identifier, None if there is none or more than one."""
        rows = self.entities.where(F.col("global_id") == guid).select("step_id").limit(2).collect()
        return rows[0][0] if len(rows) == 1 else None

    # attributes
    def with_attribute(self, name: str) -> DataFrame:
        return self.entities.where(F.map_contains_key("attributes", F.lit(name)))

    def with_nonempty_attribute(self, name: str) -> DataFrame:
        return self.entities.where(F.col("attributes")[name] != NULL_VALUE)

    def with_attribute_value(self, name: str, value: str) -> DataFrame:
        """Of entities whose attribute equals a canonical value."""
        return self.entities.where(F.col("attributes")[name] == value)

    # edges
    def edges(self) -> DataFrame:
        """(source_step, target_step, attr_name, in_aggregate, path, target_type) of references with a target."""
        attr, aggregate = provenance(F.col("path"))
        targets = self.entities.select(F.col("step_id").alias("target_step"))
        return self.refs.join(targets, "target_step", "left_semi").select("source_step", "target_step", attr.alias("attr_name"), aggregate.alias("in_aggregate"), "path", "target_type")

    def targets_of(self, steps: DataFrame) -> DataFrame:
        return self.edges().join(steps.select(F.col("step_id").alias("source_step")), "source_step", "left_semi")

    def sources_of(self, steps: DataFrame) -> DataFrame:
        return self.edges().join(steps.select(F.col("step_id").alias("target_step")), "target_step", "left_semi")

    # points
    def lookup(self, steps: list[int]) -> DataFrame:
        """Entities in the order of ``steps``; unknown ones are skipped."""
        wanted = self.entities.sparkSession.createDataFrame([*enumerate(steps)], "position int, step_id long")
        return self.entities.join(F.broadcast(wanted), "step_id").orderBy("position").drop("position")

    def query(self, *, entity_type: str | None = None, include_subtypes: bool = False, guid: str | None = None, attr_name: str | None = None, require_nonnull: bool = False, attr_value: str | None = None) -> DataFrame:
        """Entities that pass all filters given; without filters all of them."""
        if attr_value is not None and attr_name is None:
            raise ValueError("attr_value needs attr_name")
        found = self.entities if entity_type is None else self.entities_of_type(entity_type, include_subtypes)
        tests = []
        if guid is not None:
            tests.append(F.col("global_id") == guid)
        if attr_name is not None:
            value = F.col("attributes")[attr_name]
            tests.append(value == attr_value if attr_value is not None else value != NULL_VALUE if require_nonnull else F.map_contains_key("attributes", F.lit(attr_name)))
        return reduce(DataFrame.where, tests, found)


def dangling(entities: DataFrame, refs: DataFrame) -> DataFrame:
    """References whose target is no entity of their graph."""
    return refs.join(entities.select("graph_id", F.col("step_id").alias("target_step")), ["graph_id", "target_step"], "left_anti")


def dangling_count(entities: DataFrame, refs: DataFrame) -> int:
    return dangling(entities, refs).count()


def dangling_report(entities: DataFrame, refs: DataFrame, sample: int = 10) -> DataFrame:
    """The first dangling references by source, path, target and type, each with the number of all."""
    lost = dangling(entities, refs)
    total = lost.groupBy("graph_id").agg(F.count("*").alias("total"))
    by = ["source_step", "path", "target_step", "target_type"]
    from pyspark.sql import Window as W

    first = lost.withColumn("rank", F.row_number().over(W.partitionBy("graph_id").orderBy(*by))).where(F.col("rank") <= sample)
    return first.join(F.broadcast(total), "graph_id").select("graph_id", *by, "total")
