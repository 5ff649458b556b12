"""Classified edges of building models, placements, geometry points, and signature rows from all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.canonical import REAL_SCALE, canonical_class, provenance
from quern.functions.spatial import axis_placement, identity_matrix, matmul, padded, quantised_matrix, transformed
from quern.operators.hashing import merkle_hashes, topology_hashes
from quern.plans.loops import stored

#: Relationship, attribute of sources, attribute of targets, classification, domain, both directions, domain by target.
EDGE_RULES = (
    ("IfcRelDefinesByProperties", "RelatedObjects", "RelatingPropertyDefinition", "include", "data", False, False),
    ("IfcRelAssociatesMaterial", "RelatedObjects", "RelatingMaterial", "include", "data", False, False),
    ("IfcRelContainedInSpatialStructure", "RelatedElements", "RelatingStructure", "include", "spatial", False, False),
    ("IfcRelAggregates", "RelatedObjects", "RelatingObject", "include", "geometry", False, True),
    ("IfcRelVoidsElement", "RelatingBuildingElement", "RelatedOpeningElement", "include", "geometry", False, False),
    ("IfcRelFillsElement", "RelatingOpeningElement", "RelatedBuildingElement", "context", "topology", True, False),
    ("IfcRelConnectsPathElements", "RelatingElement", "RelatedElement", "context", "topology", True, False),
    ("IfcRelConnectsElements", "RelatingElement", "RelatedElement", "context", "topology", True, False),
    ("IfcRelDefinesByType", "RelatedObjects", "RelatingType", "context", "topology", False, False),
)
#: Attributes of placements, attributes and target types of geometry, and spatial classes.
PLACEMENT_ATTRIBUTES = ("ObjectPlacement", "PlacementRelTo", "RelativePlacement", "Location", "Axis", "RefDirection")
GEOMETRY_ATTRIBUTES = ("Representation", "Representations", "RepresentationMaps", "Items", "Points", "Coordinates", "OuterCurve", "SweptArea", "BasisCurve", "Position", "MappedRepresentation", "MappingSource")
GEOMETRY_TYPES = ("IfcShape", "IfcGeometric", "IfcCartesianPoint", "IfcPolyline", "IfcCurve", "IfcProfile", "IfcRepresentation", "IfcDirection", "IfcAxis2Placement")
SPATIAL_CLASSES = ("IfcProject", "IfcSite", "IfcBuilding", "IfcBuildingStorey", "IfcSpace")
_EDGE = ["source_step", "target_step", "classification", "domain", "label"]


def classified_edges(entities: DataFrame, refs: DataFrame) -> DataFrame:
    """(source_step, target_step, classification, domain, label), each once.

    Direct references count only as placement or geometry, and not from
    relationships; those give an edge from each of their sources to each of
    their targets, as the rule table says.
    """
    spark = entities.sparkSession
    attr, _ = provenance(F.col("path"))
    named = refs.join(entities.select(F.col("step_id").alias("source_step"), F.col("entity_type").alias("source_type")), "source_step").withColumn("attr", attr)
    domain = F.when(F.col("attr").isin(*PLACEMENT_ATTRIBUTES), "placement").when(F.col("attr").isin(*GEOMETRY_ATTRIBUTES) | F.rlike(F.coalesce("target_type", F.lit("")), F.lit("^(" + "|".join(GEOMETRY_TYPES) + ")")), "geometry")
    direct = named.where(~F.col("source_type").startswith("IfcRel")).withColumn("domain", domain).where("domain IS NOT NULL")
    direct = direct.select("source_step", "target_step", F.lit("include").alias("classification"), "domain", F.concat_ws(".", "source_type", "attr").alias("label"))
    rules = spark.createDataFrame(EDGE_RULES, "rel string, source_attr string, target_attr string, classification string, domain string, both boolean, dynamic boolean")
    rel = named.select(F.col("source_step").alias("rel_step"), F.col("source_type").alias("rel"), "attr", "target_step")
    ruled = rel.join(F.broadcast(rules), "rel")
    sources = ruled.where("attr = source_attr").select("rel_step", "rel", "source_attr", F.col("target_step").alias("s"), "classification", "domain", "both", "dynamic")
    targets = ruled.where("attr = target_attr").select("rel_step", "source_attr", F.col("target_step").alias("t"))
    kinds = entities.select(F.col("step_id").alias("t"), F.col("entity_type").alias("kind"))
    cross = sources.join(targets, ["rel_step", "source_attr"]).join(kinds, "t", "left")
    cross = cross.withColumn("domain", F.when(F.col("dynamic") & F.col("kind").isin(*SPATIAL_CLASSES), "spatial").otherwise(F.col("domain")))
    ahead = cross.select(F.col("s").alias("source_step"), F.col("t").alias("target_step"), "classification", "domain", F.col("rel").alias("label"))
    back = cross.where("both").select(F.col("t").alias("source_step"), F.col("s").alias("target_step"), "classification", "domain", F.col("rel").alias("label"))
    return direct.union(ahead).union(back).dropDuplicates(_EDGE)


def edge_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.concat_ws(":", "classification", "domain").alias("kind")).agg(F.count("*").alias("n"))


def inverted_links(refs: DataFrame) -> DataFrame:
    """(target_step, source_step, path) of all references, also those without a target entity."""
    return refs.select("target_step", "source_step", "path")


def placement_matrices(placements: DataFrame) -> DataFrame:
    """(step_id, matrix) of placements(step_id, parent, local): the local matrix under those of all ancestors.

    Each round joins every chain with the chain of the placement it has
    reached, so depths double, and after log2 of their number all chains have
    ended. A placement on or under a cycle has no matrix; an unknown parent
    counts as none.
    """
    known = placements.select("step_id")
    rows = placements.join(known.select(F.col("step_id").alias("parent")), "parent", "left_semi").select("step_id", "parent", "local")
    rows = rows.union(placements.join(known.select(F.col("step_id").alias("parent")), "parent", "left_anti").select("step_id", F.lit(None).cast("long").alias("parent"), "local"))
    state = stored(rows.select("step_id", "parent", F.col("local").alias("matrix")), "placements")
    for _ in range(rows.count().bit_length() + 1):
        if state.where("parent IS NOT NULL").isEmpty():
            break
        up = state.select(F.col("step_id").alias("parent"), F.col("parent").alias("next"), F.col("matrix").alias("above"))
        moved = state.join(up, "parent").select("step_id", F.col("next").alias("parent"), matmul(F.col("above"), F.col("matrix")).alias("matrix"))
        # What has come back to itself is on a cycle and leaves; so does, a round later, what hangs on it.
        moved = moved.where(~F.col("parent").eqNullSafe(F.col("step_id")))
        state = stored(state.where("parent IS NULL").union(moved), "placements")
    return state.where("parent IS NULL").select("step_id", "matrix")


def reachable(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(step_id, at): what each of ``starts(step_id)`` reaches along edges (source_step, target_step), itself included."""
    links = edges.select(F.col("source_step").alias("at"), F.col("target_step").alias("to")).distinct()
    seen = front = stored(starts.select("step_id", F.col("step_id").alias("at")).distinct(), "seen")
    while True:
        front = front.join(links, "at").select("step_id", F.col("to").alias("at")).distinct()
        front = stored(front.join(seen, ["step_id", "at"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def cartesian_points(entities: DataFrame) -> DataFrame:
    """(point_step, x, y, z) of point entities, from their canonical coordinates; missing ones are 0."""
    items = F.from_json(F.col("attributes")["Coordinates"], "struct<items:array<struct<kind:string,value:string>>>")["items"]
    number = F.transform(items, lambda i: F.when(i["kind"] == "real_q", i["value"].cast("double") / REAL_SCALE).otherwise(i["value"].cast("double")))
    rows = entities.where("entity_type = 'IfcCartesianPoint'").select(F.col("step_id").alias("point_step"), padded(number).alias("p")).where("p IS NOT NULL")
    return rows.select("point_step", *(F.col("p")[k].alias(c) for k, c in enumerate("xyz")))


def spatial_features(products: DataFrame, edges: DataFrame, points: DataFrame, matrices: DataFrame) -> DataFrame:
    """(step_id, placement, centroid, aabb) of products(step_id, placement_step).

    points(point_step, coordinates) are met along geometry edges and moved by
    the product's matrix; without points the placement's origin stands in.
    """
    geometry = edges.where("classification = 'include' AND domain = 'geometry'")
    met = reachable(products.select("step_id"), geometry).join(points.select(F.col("point_step").alias("at"), padded(F.col("coordinates")).alias("p")), "at")
    placed = products.join(matrices.select(F.col("step_id").alias("placement_step"), "matrix"), "placement_step", "left").select("step_id", "matrix")
    world = met.join(placed, "step_id").select("step_id", F.when(F.col("matrix").isNull(), F.col("p")).otherwise(transformed(F.col("matrix"), F.col("p"))).alias("p"))
    axes = range(3)
    shape = world.groupBy("step_id").agg(F.array(*(F.avg(F.col("p")[k]) for k in axes)).alias("mean"), F.array(*(F.min(F.col("p")[k]) for k in axes), *(F.max(F.col("p")[k]) for k in axes)).alias("box"))
    rows = placed.join(shape, "step_id", "left")
    origin = F.when(F.col("matrix").isNotNull(), F.array(*(F.col("matrix")[4 * k + 3] for k in axes)))
    centroid = F.coalesce("mean", origin)
    return rows.select("step_id", F.when(F.col("matrix").isNotNull(), quantised_matrix(F.col("matrix"))).alias("placement"), centroid.alias("centroid"), F.coalesce("box", F.concat(centroid, centroid)).alias("aabb"))


def local_matrix(location, axis, direction):
    """Matrix of an axis placement of which every part may be missing."""
    return F.coalesce(axis_placement(location, axis, direction), identity_matrix())


def signature_rows(entities: DataFrame, edges: DataFrame, spatial: DataFrame) -> DataFrame:
    """Signature rows of the entities in ``spatial``: hashes of parts by domain, of surroundings, and where they are."""

    def domain(name: str) -> DataFrame:
        kept = (lambda k: k.isin(*GEOMETRY_ATTRIBUTES) | F.rlike(k, F.lit("Coord|Direction|Point"))) if name == "geometry" else (lambda k: ~k.isin(*GEOMETRY_ATTRIBUTES))
        own = F.map_filter("attributes", lambda k, v: ~k.isin("GlobalId", "OwnerHistory", *PLACEMENT_ATTRIBUTES) & kept(k) & (F.get_json_object(v, "$.kind") != "ref"))
        part = entities.select("step_id", canonical_class(F.col("entity_type")).alias("entity_type"), own.alias("attributes"))
        parts = edges.where((F.col("classification") == "include") & (F.col("domain") == name))
        return stored(merkle_hashes(part, parts).withColumnRenamed("hash", f"vh_{name}"), name)

    hashed = entities.select("step_id", "global_id", canonical_class(F.col("entity_type")).alias("canonical_class")).join(domain("geometry"), "step_id").join(domain("data"), "step_id")
    seeds = stored(hashed.select("step_id", F.sha2(F.concat_ws("|", "canonical_class", "vh_geometry", "vh_data"), 256).alias("seed")), "seeds")
    pairs = lambda c, d: edges.where((F.col("classification") == c) & (F.col("domain") == d)).select(F.col("source_step").alias("a"), F.col("target_step").alias("b"))
    topology = topology_hashes(seeds, pairs("context", "topology"), pairs("include", "spatial")).withColumnRenamed("hash", "vh_topology")
    return hashed.join(topology, "step_id").join(spatial, "step_id").withColumnRenamed("global_id", "guid")
