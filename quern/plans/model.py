"""Building models compared by signatures: reading, placements, points, signature rows and the sections of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.canonical import REAL_SCALE
from quern.functions.spatial import padded
from quern.operators import geometry, identity, index, signatures
from quern.plans.loops import stored
from quern.sources import step
from quern.sources.schema import Schema, core_schema
from quern.streaming import feed

_NUMBERS = "struct<items:array<struct<kind:string,value:string>>>"


def _numbers(value: Column) -> Column:
    """Numbers of a canonical list, plain or quantised."""
    items = F.from_json(value, _NUMBERS)["items"]
    return F.transform(items, lambda i: F.when(i["kind"] == "real_q", i["value"].cast("double") / REAL_SCALE).otherwise(i["value"].cast("double")))


def _one(refs: DataFrame, attribute: str, name: str) -> DataFrame:
    """(step_id, name): the target of a single-valued attribute."""
    hit = F.col("path").isin(f"/{attribute}") | F.col("path").startswith(f"/{attribute}@")
    return refs.where(hit).groupBy(F.col("source_step").alias("step_id")).agg(F.min("target_step").alias(name))


def placements(entities: DataFrame, refs: DataFrame) -> DataFrame:
    """(step_id, parent, local) of local placements: the matrix of the axis placement they refer to, and what they are relative to."""
    values = entities.where(F.col("entity_type").isin("IfcCartesianPoint", "IfcDirection")).select(F.col("step_id").alias("at"), padded(_numbers(F.coalesce(F.col("attributes")["Coordinates"], F.col("attributes")["DirectionRatios"]))).alias("v"))
    axes = entities.where(F.col("entity_type").startswith("IfcAxis2Placement")).select("step_id")
    for attribute in ("Location", "Axis", "RefDirection"):
        part = _one(refs, attribute, "at").join(values, "at").select("step_id", F.col("v").alias(attribute))
        axes = axes.join(part, "step_id", "left")
    local = axes.select(F.col("step_id").alias("axis"), geometry.local_matrix(*(F.col(a) for a in ("Location", "Axis", "RefDirection"))).alias("local"))
    rows = entities.where("entity_type = 'IfcLocalPlacement'").select("step_id")
    rows = rows.join(_one(refs, "PlacementRelTo", "parent"), "step_id", "left").join(_one(refs, "RelativePlacement", "axis"), "step_id", "left").join(local, "axis", "left")
    none = F.lit(None).cast("array<double>")
    return rows.select("step_id", "parent", F.coalesce("local", geometry.local_matrix(none, none, none)).alias("local"))


def model_rows(entities: DataFrame, refs: DataFrame, schema: Schema | None = None) -> DataFrame:
    """Signature rows of the products of a model."""
    spark = entities.sparkSession
    kinds = [(t,) for t, above in (schema or core_schema()).closure() if above == "IfcProduct"]
    edges = stored(geometry.classified_edges(entities, refs), "model_edges")
    matrices = geometry.placement_matrices(placements(entities, refs))
    points = geometry.cartesian_points(entities).select("point_step", F.array("x", "y", "z").alias("coordinates"))
    products = entities.join(F.broadcast(spark.createDataFrame(kinds, "entity_type string")), "entity_type", "left_semi").select("step_id")
    products = products.join(_one(refs, "ObjectPlacement", "placement_step"), "step_id", "left")
    spatial = stored(geometry.spatial_features(products, edges, points, stored(matrices, "matrices")), "spatial")
    return stored(geometry.signature_rows(entities, edges, spatial), "signature_rows")


def model_diff(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], radius_m: float = signatures.RADIUS_M, schema: Schema | None = None) -> tuple[DataFrame, dict]:
    """The report of two models, as rows of sections, and its diagnostics."""
    sides = [model_rows(*g, schema) for g in (old, new)]
    report = stored(signatures.signature_diff(*sides, radius_m), "report")
    collisions = [sum(r.collisions for r in identity.collision_count(g[0]).collect()) for g in (old, new)]
    counts = {r["section"]: r["n"] for r in signatures.signature_diff_counts(report).collect()}
    diagnostics = {
        "sections": {k: counts.get(k, 0) for k in ("added", "deleted", "modified", "unchanged")},
        "guid_collisions": dict(zip(("old", "new"), collisions)),
        "dangling_refs": dict(zip(("old", "new"), (index.dangling_count(*g) for g in (old, new)))),
        "edges": {r["kind"]: r["n"] for r in geometry.edge_stats(geometry.classified_edges(*new)).collect()},
    }
    return report, diagnostics


def model_diff_files(spark: SparkSession, old_path: str, new_path: str, radius_m: float = signatures.RADIUS_M, schema: Schema | None = None) -> tuple[DataFrame, dict]:
    """:func:`model_diff` of two STEP files, read by the rules of signatures: reals are quantised and references carry no id."""
    files = [step.read_graph(spark, p, schema, quantised=True) for p in (old_path, new_path)]
    return model_diff(files[0].graph, files[1].graph, radius_m, schema)


def section_lines(report: DataFrame) -> DataFrame:
    """The report as JSON lines in order of section, class and steps."""
    item = F.struct("section", "old_step", "new_step", "score", "reason", "canonical_class", "geometry", "data", "topology", "placement", "placement_delta_mm")
    return feed.sections(report, item)
