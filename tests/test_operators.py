"""Operators against brute force and small graphs with known results."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import canonical, spatial, wording
from quern.operators import changes, hashing, identity, index, matching, refinement, scenes, signatures
from quern.plans.diff import graph_diff
from quern.plans.loops import connected
from quern.sources.step import parse_step, read_step, step_index
from quern.streaming import feed

E_SCHEMA = "graph_id string, step_id long, ord long, entity_type string, global_id string, attributes map<string,string>"
R_SCHEMA = "graph_id string, source_step long, ref_ord int, path string, target_step long, target_type string"


def text(v):
    return f'{{"kind":"string","value":"{v}"}}'


def make(spark, entities, refs=(), graph_id="g"):
    """entities: (step, type, guid, attributes), refs: (source, path, target)."""
    types = {e[0]: e[1] for e in entities}
    rows = [(graph_id, s, i, t, g, {k: text(v) for k, v in a.items()}) for i, (s, t, g, a) in enumerate(entities)]
    links = [(graph_id, s, i, p, t, types.get(t)) for i, (s, p, t) in enumerate(refs)]
    return spark.createDataFrame(rows, E_SCHEMA), spark.createDataFrame(links, R_SCHEMA)


def pairs(df):
    return {tuple(r) for r in df.collect()}


# --- index ---------------------------------------------------------------------


def test_index_is_a_scan(spark):
    entities, refs = make(
        spark,
        [(1, "Wall", "A", {"Name": "w"}), (2, "Wall", "B", {}), (3, "Door", "A", {"Name": "w"}), (4, "Door", None, {"Tag": "t"})],
        [(1, "/Parts/0", 3), (1, "/Owner@Person", 2), (2, "/Owner", 99)],
    )
    closure = spark.createDataFrame([("Wall", "Wall"), ("Door", "Door"), ("Wall", "Thing"), ("Door", "Thing")], "type string, ancestor string")
    g = index.GraphIndex(entities, refs, closure)
    assert {r.step_id for r in g.query(entity_type="Thing", include_subtypes=True).collect()} == {1, 2, 3, 4}
    assert g.query(entity_type="Nothing").count() == 0 and g.query().count() == g.total_entities() == 4
    assert g.entity_by_guid("A") is None and g.entity_by_guid("B") == 2 and g.entity_by_guid("Z") is None
    assert {r.step_id for r in g.query(attr_name="Name", attr_value=text("w"), entity_type="Door").collect()} == {3}
    found = {(r.source_step, r.target_step, r.attr_name, r.in_aggregate) for r in g.edges().collect()}
    assert found == {(1, 3, "Parts", True), (1, 2, "Owner", False)}
    assert [r.step_id for r in g.lookup([3, 77, 1]).collect()] == [3, 1]
    with pytest.raises(ValueError):
        g.query(attr_value="x")
    with pytest.raises(ValueError):
        index.GraphIndex(entities, refs).query(entity_type="Wall", include_subtypes=True)
    assert [(r.source_step, r.target_step, r.total) for r in index.dangling_report(entities, refs).collect()] == [(2, 99, 1)]


# --- values ---------------------------------------------------------------------


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_canonical_values(spark):
    assert one(spark, canonical.canonical_string(F.lit('a"b\\c\n')))[0] == '{"kind":"string","value":"a\\"b\\\\c\\n"}'
    assert one(spark, canonical.canonical_real(F.lit(2.5e-6)), canonical.canonical_real(F.lit(float("nan")))) == ('{"kind":"real_q","value":2}', '{"kind":"real_q","value":0}')
    assert one(spark, canonical.canonical_real_exact(F.lit(0.1)), canonical.canonical_real_exact(F.lit(-0.0))) == ('{"kind":"real","value":"0.10000000000000001"}', '{"kind":"real","value":"0"}')
    items = F.array(F.lit("b"), F.lit("a"), F.lit("a"))
    assert one(spark, canonical.canonical_items("bag", items), canonical.canonical_items("list", items)) == ('{"items":[a,a,b],"kind":"bag"}', '{"items":[b,a,a],"kind":"list"}')
    assert one(spark, canonical.strip_ref_ids(F.lit('[{"id":12,"kind":"ref"}]')))[0] == '[{"kind":"ref"}]'
    none = F.array().cast("array<string>")
    assert one(spark, canonical.jaccard(none, none), canonical.jaccard(items, F.array(F.lit("a"))), canonical.degree_similarity(F.lit(2), F.lit(4))) == (1.0, 0.5, 0.5)
    assert one(spark, canonical.si_unit_factor(F.lit("MILLI"), F.lit("LENGTHUNIT")), canonical.si_unit_factor(F.lit("CENTI"), F.lit("AREAUNIT"))) == pytest.approx((1e-3, 1e-4))
    assert one(spark, canonical.logical_text(F.lit(" .T. ")), canonical.logical_text(F.lit(" x ")))[0] == '{"kind":"bool","value":true}'
    with pytest.raises(Exception):
        one(spark, canonical.canonical_real_exact(F.lit(float("inf"))))


def test_matrices_and_words(spark):
    at = spatial.axis_placement(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.lit(None).cast("array<double>"), F.array(F.lit(0.0), F.lit(2.0), F.lit(0.0)))
    point = spatial.transformed(at, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    assert one(spark, point)[0] == pytest.approx([1.0, 3.0, 3.0])
    assert one(spark, spatial.matmul(at, spatial.identity_matrix()), at)[0] == pytest.approx(one(spark, at)[0])
    assert one(spark, spatial.wall_orientation(spatial.identity_matrix()), spatial.describe_move(F.lit(2000.0), F.lit(0.0), F.lit(0.0)), spatial.describe_move(F.lit(0.1), F.lit(0.0), F.lit(-5.0)), spatial.describe_move(F.lit(0.0), F.lit(0.5), F.lit(0.0))) == ("north-facing", "moved 2.0m east", "moved 5mm down", "placement changed (negligible shift)")
    names = ["M_Dresser: 1220 x 1830 x 0610mm:123456", "M_Chair-Executive:M_Chair-Executive:99", "Group#17", "Surface:1310134", "Plain Name", "", None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", wording.clean_name(F.col("n"))).orderBy("i").collect()
    assert [r[1] for r in rows] == ["dresser", "chair executive", None, "surface", "Plain Name", None, None]
    assert one(spark, wording.plural(F.lit(2), F.lit("entity")), wording.plural(F.lit(1), F.lit("box")), wording.plural(F.lit(3), F.lit("box"))) == ("2 entities", "1 box", "3 boxes")
    assert one(spark, wording.relative_time(F.lit(90.0)), wording.relative_time(F.lit(86400.0 * 400)), wording.relative_time(F.lit(5.9))) == ("2 minutes later", "1.1 years later", "5 seconds later")
    assert one(spark, *(wording.relative_time(F.lit(86400.0 * d), days_only=True) for d in (29, 31, 400))) == ("29 days later", "31 days later", "400 days later")
    assert one(spark, wording.clean_field_name(F.lit("pset.Pset_DoorCommon.FireRating"), True), wording.clean_field_name(F.lit("pset.Other.X")), wording.clean_value(F.lit("Door: Fire Rating"))) == ("FireRating (door)", "X", "none")
    assert one(spark, wording.is_external(F.lit(None).cast("boolean"), F.lit("Yttervägg"), F.lit(None)), wording.is_external(F.lit(False), F.lit("outer"), F.lit(None))) == (True, False)
    nothing = F.lit(None).cast("string")
    flag = F.lit(None).cast("boolean")
    assert one(spark, wording.element_label(F.lit("wall"), nothing, F.lit(True), F.lit("north-facing"), flag, nothing, F.lit(False), F.lit("Floor 0")))[0] == "exterior north-facing wall on Floor 0"
    assert one(spark, wording.parse_timestamp(F.lit("2024-01-02T03:04:05")).cast("string"), wording.parse_timestamp(F.lit("2024-01-02")).cast("string"), wording.parse_timestamp(F.lit("x"))) == ("2024-01-02 03:04:05", "2024-01-02 00:00:00", None)


# --- hashes and refinement ------------------------------------------------------


def test_refinement_ignores_numbering(spark):
    def colours(shift):
        e, r = make(spark, [(s + shift, "P", None, {}) for s in (1, 2, 3, 4)], [(1 + shift, "/n", 2 + shift), (2 + shift, "/n", 3 + shift)])
        seeds = e.select("step_id", F.lit("x").alias("colour"))
        return sorted(x.colour for x in refinement.refine(seeds, refinement.adjacency(e, r))[0].collect())

    assert colours(0) == colours(100)
    assert len(set(colours(0))) == 3
    with pytest.raises(ValueError):
        refinement._hasher("blake9")


def test_strong_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)]
    reach = {i: {i} for i in range(30)}
    for _ in range(30):
        for a, b in edges:
            reach[a] |= reach[b]
    want = {(i, min(j for j in reach[i] if i in reach[j])) for i in range(30)}
    found = refinement.strong_components(spark.range(30).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "a long, b long"))
    assert pairs(found) == want


def test_cycle_is_one_class(spark):
    def classes(n, shift):
        e, r = make(spark, [(i + shift, "P", None, {}) for i in range(n)], [(i + shift, "/n", (i + 1) % n + shift) for i in range(n)])
        edges = refinement.adjacency(e, r)
        colours = e.select("step_id", F.lit("c").alias("colour"))
        members = refinement.strong_components(e.select(F.col("step_id").alias("node")), edges.select(F.col("source_step").alias("a"), F.col("target_step").alias("b")))
        return [x.class_id for x in refinement.ambiguous_classes(colours, members, edges, e).collect()]

    assert len(set(classes(3, 0))) == 1 and len(classes(4, 10)) == 4
    assert set(classes(4, 0)) == set(classes(4, 10))


def test_merkle_and_owners(spark):
    e, r = make(spark, [(1, "A", "R1", {}), (2, "B", None, {"x": "1"}), (3, "B", None, {"x": "1"}), (4, "C", "R2", {})], [(1, "/p", 2), (4, "/p", 3), (4, "/p", 9), (2, "/q", 3)])
    got = dict(pairs(hashing.merkle_hashes(e, r.select("source_step", F.col("path").alias("label"), "target_step"))))
    assert len(got) == 4 and len(set(got.values())) == 4
    cyclic = make(spark, [(1, "A", None, {}), (2, "A", None, {})], [(1, "/n", 2), (2, "/n", 1)])
    assert hashing.merkle_hashes(cyclic[0], cyclic[1].select("source_step", F.col("path").alias("label"), "target_step")).count() == 2
    owners = refinement.rooted_owners(e, r, spark.createDataFrame([(3,)], "step_id long"))
    assert pairs(owners) == {(3, "G:R1"), (3, "G:R2")}
    summary = refinement.owner_summary(owners, 1).first()
    assert (summary["sample"], summary.total) == (["G:R1"], 2)


def test_connected(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 51)]
    assert pairs(connected(spark.createDataFrame(edges, "a long, b long"))) == {(i, 0) for i in range(21)} | {(50, 50), (51, 50)}


# --- identifiers ------------------------------------------------------------------


def test_guid_policy(spark):
    e, _ = make(spark, [(1, "W", "DUP", {}), (2, "W", "DUP", {}), (3, "W", "", {}), (4, "W", "A", {})])
    row = identity.guid_quality(e).first()
    assert (row.duplicate_ids, row.duplicate_occurrences, row.invalid, row.unique_valid) == (1, 2, 1, 1)
    found = {r.step_id: r.entity_id for r in identity.identify(e, "disambiguate").collect()}
    assert found == {1: "G!:DUP#1", 2: "G!:DUP#2", 3: "G!:INVALID#1", 4: "G:A"}
    with pytest.raises(ValueError, match="GUID policy violation"):
        identity.identify(e)
    with pytest.raises(ValueError, match="Unknown guid policy"):
        identity.identify(e, "none")


# --- signatures ---------------------------------------------------------------------


def plain_greedy(rows):
    old, new, out = set(), set(), set()
    for s, o, n, reason in sorted(rows, key=lambda r: (-r[0], r[1], r[2], r[3])):
        if o not in old and n not in new:
            old.add(o)
            new.add(n)
            out.add((o, n, s, reason))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_is_the_sequential_pass(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([0.5, 0.9, 1.0]), o, n + 100, "guid") for o, n in itertools.product(range(14), range(14)) if rng.random() < 0.4]
    rows += [(0.5, o, n, "geometry_hash") for o in range(200, 212) for n in range(300, 312)]
    got = signatures.greedy(spark.createDataFrame(rows, "score double, old_step long, new_step long, reason string"), rounds=seed)
    assert {(r.old_step, r.new_step, r.score, r.reason) for r in got.collect()} == plain_greedy(rows)


def test_spatial_candidates_are_all_pairs_in_radius(spark):
    rng = random.Random(9)
    rows = [(i, f"g{i}", rng.choice("AB"), f"h{i}", "d", "t", [1], [rng.uniform(-1, 1) for _ in range(3)]) for i in range(120)]
    schema = "step_id long, guid string, canonical_class string, vh_geometry string, vh_data string, vh_topology string, placement array<long>, centroid array<double>"
    old, new = spark.createDataFrame(rows[:60], schema), spark.createDataFrame(rows[60:], schema)
    want = {(a[0], b[0], "spatial_fallback") for a in rows[:60] for b in rows[60:] if a[2] == b[2] and sum((x - y) ** 2 for x, y in zip(a[7], b[7])) <= 0.25}
    assert pairs(signatures.spatial_candidates(old, new)) == want
    report = signatures.signature_diff(old, new)
    assert sum(r.n for r in signatures.signature_diff_counts(report).collect()) == report.count()


# --- matching -------------------------------------------------------------------------


def best_total(scores, threshold):
    olds, news = sorted({o for o, _ in scores}), sorted({n for _, n in scores})
    spare = 1 - threshold + 0.05
    best = None
    for choice in itertools.product([None, *news], repeat=len(olds)):
        used = [n for n in choice if n is not None]
        if len(set(used)) < len(used) or any(n is not None and (o, n) not in scores for o, n in zip(olds, choice)):
            continue
        cost = sum(spare if n is None else 1 - scores[o, n] for o, n in zip(olds, choice)) + spare * (len(news) - len(used))
        best = cost if best is None else min(best, cost)
    return best


def test_assignment_is_of_least_cost():
    rng = random.Random(3)
    for _ in range(60):
        scores = {(o, 10 + n): round(rng.uniform(0.5, 1), 3) for o in range(4) for n in range(4) if rng.random() < 0.7}
        if not scores:
            continue
        chosen, _ = matching.assign(scores, 0.5, 0.0)
        spare, news = 0.55, {n for _, n in scores}
        cost = sum(1 - scores[p] for p in chosen.items()) + spare * (len({o for o, _ in scores}) - len(chosen)) + spare * (len(news) - len(chosen))
        assert cost == pytest.approx(best_total(scores, 0.5))
    assert matching.assign({(1, 2): 0.9, (1, 3): 0.85}, 0.5, 0.1)[1]


def test_propagation_along_a_chain(spark):
    old = make(spark, [(1, "W", "A", {}), (2, "P", None, {}), (3, "Q", None, {})], [(1, "/p", 2), (2, "/q", 3)])
    new = make(spark, [(101, "W", "A", {}), (102, "P", None, {}), (103, "Q", None, {})], [(101, "/p", 102), (102, "/q", 103)])
    start = spark.createDataFrame([(1, 101)], "old_step long, new_step long")
    assert pairs(matching.propagate(start, old, new).select("old_step", "new_step")) == {(2, 102), (3, 103)}


def test_policy_messages():
    with pytest.raises(ValueError, match="Unknown matcher policy"):
        matching.validated_policy({"x": 1})
    with pytest.raises(ValueError, match="between 0 and 1"):
        matching.validated_policy({"threshold": 2})
    with pytest.raises(ValueError, match="positive integer"):
        matching.validated_policy({"assignment_max": 0})


# --- whole comparisons ------------------------------------------------------------------


def test_basic_diff(spark):
    old = make(spark, [(1, "IfcWall", "AAA", {"Name": "x"}), (2, "IfcWall", "BBB", {"Name": "y"})])
    new = make(spark, [(1, "IfcWall", "AAA", {"Name": "z"}), (2, "IfcWall", "CCC", {"Name": "y"})])
    rows = {r.op: r for r in graph_diff(old, new).changes.collect()}
    assert set(rows) == {"ADD", "MODIFY", "REMOVE"}
    assert rows["MODIFY"].change_categories == ["ATTRIBUTES"] and [f.op for f in rows["MODIFY"].field_ops] == ["replace"]
    assert [rows[o].change_id for o in ("MODIFY", "REMOVE", "ADD")] == ["chg-000001", "chg-000002", "chg-000003"]


def test_reparent_and_renumbering(spark):
    kinds = [(1, "IfcWall", "W", {}), (2, "IfcBuildingStorey", "S1", {}), (3, "IfcBuildingStorey", "S2", {}), (4, "IfcRelContainedInSpatialStructure", "REL", {})]
    old = make(spark, kinds, [(4, "/RelatedElements/0", 1), (4, "/RelatingStructure", 2)])
    new = make(spark, [(s + 50, *x) for s, *x in kinds], [(54, "/RelatedElements/0", 51), (54, "/RelatingStructure", 53)])
    found = graph_diff(old, new)
    assert [(m.child_id, m.old_parent_id, m.new_parent_id) for m in found.markers.collect()] == [("G:W", "G:S1", "G:S2")]
    same = make(spark, [(s + 50, *x) for s, *x in kinds], [(54, "/RelatedElements/0", 51), (54, "/RelatingStructure", 52)])
    assert graph_diff(old, same).changes.count() == 0


def test_class_delta_of_points(spark):
    wall = (1, "IfcWall", "W", {})
    old = make(spark, [wall, (2, "IfcPoint", None, {"c": "0"}), (3, "IfcPoint", None, {"c": "0"})])
    new = make(spark, [wall, (2, "IfcPoint", None, {"c": "0"})])
    found = graph_diff(old, new)
    assert [(r.old_count, r.new_count, r.class_id[:2]) for r in found.class_deltas.collect()] == [(2, 1, "C:")]
    assert found.changes.count() == 0


def test_errors(spark):
    g = make(spark, [(1, "W", "A", {})])
    with pytest.raises(ValueError, match="Schema mismatch: IFC4 vs IFC2X3"):
        graph_diff(g, g, schemas=("IFC4", "IFC2X3"))
    with pytest.raises(ValueError):
        graph_diff(g, g, geometry_policy="other")
    with pytest.raises(ValueError):
        graph_diff(g, g, profile="other")


# --- scenes, files, feeds -------------------------------------------------------------------


def test_nearest_named(spark):
    rng = random.Random(5)
    points = [(i, *(rng.uniform(0, 20_000) for _ in range(3))) for i in range(40)]
    named = [(f"n{i}" if i % 5 else f"auto#{i}", i, *p[1:]) for i, p in enumerate(points)]
    want = set()
    for i, *p in points:
        options = [(sum((a - b) ** 2 for a, b in zip(p, q)) ** 0.5, o, n) for n, o, *q in named if "#" not in n]
        want.add((i, min(x for x in options if x[0] >= 100)[2]))
    got = scenes.nearest_named(spark.createDataFrame(points, "id long, x double, y double, z double"), spark.createDataFrame(named, "name string, ord long, x double, y double, z double"))
    assert pairs(got) == want


@pytest.mark.parametrize("wide,region_names", [(300, 8), (300, 2048), (60, 8), (5_000, 3), (0, 8)])
def test_nearest_named_in_dense_places(spark, wide, region_names):
    """Many names within the least distance, places that repeat or tie, outliers, rows without a coordinate or not finite."""
    rng = random.Random(wide)
    places = [tuple(float(rng.randrange(-wide, wide + 1)) for _ in range(3)) for _ in range(120)]
    places += places[:20] + [(10_000.0, 0.0, 0.0), (10_000.0, 0.0, 50.0), (None, 1.0, 1.0), (float("inf"), 0.0, 0.0)]
    points = [(i, *p) for i, p in enumerate(places)] + [(3, *places[9])]
    named = [(f"n{i % 40}" if i % 7 else f"auto#{i}", 1000 - i, *p) for i, p in enumerate(places)]
    want = {}
    for i, *p in points:
        options = [(sum((a - b) ** 2 for a, b in zip(p, q)) ** 0.5, o, n) for n, o, *q in named if "#" not in n and None not in [*p, *q] and not (float("inf") in p and float("inf") in q)]
        want[i] = min([x for x in [*options, want.get(i)] if x and x[0] >= 100], default=None)
    got = scenes.nearest_named(spark.createDataFrame(points, "id long, x double, y double, z double"), spark.createDataFrame(named, "name string, ord long, x double, y double, z double"), region_names=region_names)
    assert pairs(got) == {(i, x[2]) for i, x in want.items() if x}


def test_nearest_named_searches_few_regions():
    """Though all places lie within a few metres, a point is held against few of the regions."""
    rng = np.random.default_rng(8)
    regions = scenes.Regions.cut(places := rng.normal(size=(20_000, 3)) * 1250, math.ceil(20_000 / 512), 100.0)
    own = regions.own(places)
    ids, sizes = np.unique(own, return_counts=True)
    assert sizes.max() < 700
    boxes = np.array([[places[own == k].min(0), places[own == k].max(0)] for k in ids])
    row, region, _ = regions.with_boxes(ids, boxes, False).further(places[:2000], np.full(2000, 130.0))
    assert len(row) < 5 * 2000


def test_chunks_and_feed(spark):
    rows = spark.range(1, 8).select(F.col("id").alias("position"), F.lit("ADD").alias("op"))
    got = feed.chunks(rows, "position", F.col("position").cast("string"), 3).orderBy("offset").collect()
    assert [(r.offset, r["count"], r["items"]) for r in got] == [(0, 3, "[1,2,3]"), (3, 3, "[4,5,6]"), (6, 1, "[7]")]
    with pytest.raises(ValueError):
        feed.chunks(rows, "position", F.col("op"), 0)
    assert feed.chunks(rows, "position", F.col("op"), 0, clamp=True).count() == 7
    lines = feed.ndjson(rows, rows.limit(0), F.struct("op"), F.struct("op"), version="1").orderBy("rank", "position").collect()
    assert lines[0].value.startswith('{"event":"header"') and lines[-1].value == '{"event":"end","op_counts":{"ADD":7}}'


def test_follow_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"op":"ADD"}\n{"op":"ADD"}\n{"op":"REMOVE"}\n')
    feed.follow(spark, str(folder), "op string", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("op").agg(F.sum("n").alias("n"))
    assert pairs(got) == {("ADD", 2), ("REMOVE", 1)}


def test_precision_recall(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "old_step long, new_step long")
    b = spark.createDataFrame([(1, 1), (3, 3)], "old_step long, new_step long")
    assert tuple(scenes.precision_recall(a, b).first()) == (0.5, 0.5, 0.5)


# --- STEP files --------------------------------------------------------------------------------

STEP = """ISO-10303-21;
HEADER;
FILE_DESCRIPTION((''),'2;1');
FILE_NAME('a.ifc','2024-05-01T10:00:00',(''),(''),'','','');
FILE_SCHEMA(('IFC4'));
ENDSEC;
DATA;
/* a comment */
#1=IFCWALL('GUID1',$,'It''s; a wall',.T.,#2,(1.,2.5E0),IFCLABEL('x'));
#2= IFCOWNERHISTORY(*,(#1,#3));
ENDSEC;
END-ISO-10303-21;
"""


def test_step_source(spark, tmp_path):
    path = tmp_path / "a.ifc"
    path.write_text(STEP)
    entities, refs = read_step(spark, str(path))
    rows = {r.step_id: r for r in entities.collect()}
    assert rows[1].entity_type == "IfcWall" and rows[1].global_id == "GUID1" and rows[1].attributes["Name"] == '{"kind":"string","value":"It\'s; a wall"}'
    assert rows[1].attributes["ObjectType"] == '{"kind":"ref","id":2}'.replace('"kind":"ref","id":2', '"id":2,"kind":"ref"')
    assert rows[1].attributes["Representation"] == '{"kind":"simple","type":"IfcLabel","value":{"kind":"string","value":"x"}}'
    assert rows[1].time_stamp == "2024-05-01T10:00:00" and rows[2].ord == 1
    assert {(r.source_step, r.path, r.target_step, r.target_type) for r in refs.collect()} == {(1, "/ObjectType", 2, "IfcOwnerHistory"), (2, "/OwningApplication/0", 1, "IfcWall"), (2, "/OwningApplication/1", 3, None)}
    assert {r.step_id: r.offset for r in step_index(spark, str(path)).collect()} == {1: STEP.index("#1="), 2: STEP.index("#2=")}
    with pytest.raises(ValueError, match="Unsupported schema"):
        parse_step(STEP.replace("IFC4", "IFC9"))


def test_express_schema():
    from quern.sources.schema import core_schema, express_schema

    schema = express_schema("""SCHEMA X; TYPE IfcLabel = STRING; END_TYPE;
    ENTITY IfcRoot ABSTRACT SUPERTYPE OF (ONEOF (IfcThing)); GlobalId : IfcGloballyUniqueId; Name : OPTIONAL IfcLabel; UNIQUE UR1 : GlobalId; END_ENTITY;
    ENTITY IfcThing SUBTYPE OF (IfcRoot); Parts : SET [1:?] OF IfcRoot; Line : LIST OF REAL; INVERSE Up : SET OF IfcRoot FOR Parts; WHERE WR1 : TRUE; END_ENTITY; END_SCHEMA;""")
    assert schema.attributes("IFCTHING") == [("GlobalId", None), ("Name", None), ("Parts", "set"), ("Line", "list")]
    assert schema.name("IFCTHING") == "IfcThing" and schema.name("IFCLABEL") == "IfcLabel" and ("IfcThing", "IfcRoot") in schema.closure()
    core = core_schema()
    assert [n for n, _ in core.attributes("IFCWALLSTANDARDCASE")][-2:] == ["Tag", "PredefinedType"] and ("IfcDoor", "IfcProduct") in core.closure()
    assert core.attributes("IFCNEWTHING", "0" * 22)[0] == ("GlobalId", None) and core.attributes("IFCNEWTHING", "no id") == []
    assert core.name("IFCLENGTHMEASURE") == "IfcLengthMeasure" and core.name("IFCPLANEANGLEMEASURE") == "IfcPlaneAngleMeasure"


MODEL = """ISO-10303-21;
HEADER;
FILE_NAME('m.ifc','2024-05-01T10:00:00',(''),(''),'','','');
FILE_SCHEMA(('IFC4'));
ENDSEC;
DATA;
#1=IFCOWNERHISTORY($,$,$,.ADDED.,$,$,$,{stamp});
#2=IFCUNITASSIGNMENT((#3,#4));
#3=IFCSIUNIT(*,.LENGTHUNIT.,.MILLI.,.METRE.);
#4=IFCCONVERSIONBASEDUNIT(*,.PLANEANGLEUNIT.,'DEGREE',#5);
#5=IFCMEASUREWITHUNIT(IFCPLANEANGLEMEASURE(0.0174532925),#6);
#6=IFCSIUNIT(*,.PLANEANGLEUNIT.,$,.RADIAN.);
#10=IFCBUILDINGSTOREY('0000000000000000000001',#1,'EG',$,$,$,$,$,.ELEMENT.,0.);
#11=IFCBUILDINGSTOREY('0000000000000000000002',#1,'OG',$,$,$,$,$,.ELEMENT.,3.);
#20=IFCWALL('0000000000000000000003',#1,'{name}',$,$,#30,#40,'T',$);
#21=IFCRELCONTAINEDINSPATIALSTRUCTURE('0000000000000000000004',#1,$,$,(#20),#{storey});
#30=IFCLOCALPLACEMENT($,#31);
#31=IFCAXIS2PLACEMENT3D(#32,$,$);
#32=IFCCARTESIANPOINT(({x},0.,0.));
#40=IFCPRODUCTDEFINITIONSHAPE($,$,(#41));
#41=IFCSHAPEREPRESENTATION($,'Body','{form}',({items}));
#50=IFCPOLYLINE((#51,#52));
#51=IFCCARTESIANPOINT((0.,0.));
#52=IFCCARTESIANPOINT((1.,2.));
#60=IFCPROPERTYSINGLEVALUE('Height',$,IFCLENGTHMEASURE({height}),$);
{more}
ENDSEC;
END-ISO-10303-21;
"""


def model(path, **changed):
    values = {"stamp": 1, "name": "Wall", "storey": 10, "x": "5.", "form": "Curve", "items": "#50", "height": "2500.", "more": ""} | changed
    path.write_text(MODEL.format(**values))
    return str(path)


def test_units_and_measures(spark, tmp_path):
    from quern.sources.step import read_graph, unit_table

    path = model(tmp_path / "m.ifc")
    entities, _ = read_step(spark, path)
    assert {r.unit_type: r.factor for r in unit_table(entities).collect()} == {"LENGTHUNIT": 0.001, "PLANEANGLEUNIT": pytest.approx(0.0174532925)}
    by = {r.step_id: r for r in entities.collect()}
    assert by[60].attributes["NominalValue"] == '{"kind":"simple","type":"IfcLengthMeasure","value":{"kind":"real","value":"2.5"}}'
    assert '"kind":"set"' in by[21].attributes["RelatedElements"] and '"kind":"list"' in by[50].attributes["Points"]
    file = read_graph(spark, path, quantised=True)
    assert file.schema == "IFC4" and file.units["LENGTHUNIT"] == 0.001
    assert {r.attributes["Coordinates"] for r in file.graph[0].where("step_id = 52").collect()} == {'{"items":[{"kind":"real_q","value":1000000},{"kind":"real_q","value":2000000}],"kind":"list"}'}


def test_files_from_end_to_end(spark, tmp_path, capsys, monkeypatch):
    import json

    from quern import __main__ as command

    monkeypatch.setattr(command, "ship", lambda spark: None)
    old, new = model(tmp_path / "a.ifc"), model(tmp_path / "b.ifc", stamp=2, name="Wall 2", storey=11)
    assert command.main([old, new, "--stream", "ndjson"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.strip().split("\n")]
    assert [x["event"] for x in lines] == ["header", "base_change", "base_change", "derived_marker", "end"]
    # The owner history differs, which the profile leaves out; the wall has another name and storey.
    assert lines[0]["header"]["schema_policy"]["old_schema"] == "IFC4" and lines[0]["header"]["stats"]["matched"] == 19
    assert [f["path"] for f in lines[1]["data"]["field_ops"]] == ["/attributes/Name/value"]
    assert [f["path"] for f in lines[2]["data"]["field_ops"]] == ["/attributes/RelatingStructure/id", "/refs/1/target"]
    assert lines[3]["data"]["marker_type"] == "REPARENT" and lines[3]["data"]["old_parent_id"].endswith("1") and lines[3]["data"]["source_change_ids"] == ["chg-000001", "chg-000002"]
    assert command.main([old, old]) == 0 and capsys.readouterr().out == "no changes\n"
    assert command.main([old, model(tmp_path / "c.ifc", more="#70=IFCDOOR('0000000000000000000003',$,$,$,$,$,$,$,$,$,$,$,$);")]) == 1 and "GUID policy" in capsys.readouterr().err


def test_model_engine(spark, tmp_path):
    from quern.plans.model import model_diff_files, section_lines

    old, new = model(tmp_path / "a.ifc"), model(tmp_path / "b.ifc", x="5.25", more="#70=IFCDOOR('0000000000000000000009',$,$,$,$,$,$,$,$,$,$,$,$);")
    report, diagnostics = model_diff_files(spark, old, new)
    rows = {(r.section, r.old_step, r.new_step): r for r in report.collect()}
    assert diagnostics["sections"] == {"added": 1, "deleted": 0, "modified": 1, "unchanged": 2} and diagnostics["guid_collisions"] == {"old": 0, "new": 0}
    moved = rows["modified", 20, 20]
    assert moved.placement and not moved.geometry and moved.placement_delta_mm == 250.0
    lines = section_lines(report).orderBy("position").collect()
    assert [r.section for r in lines] == ["added", "modified", "unchanged", "unchanged"] and [r.position for r in lines] == [1, 2, 3, 4]


def test_geometry_policy(spark, tmp_path):
    """The same points by another form of representation are a change, or none by invariants."""
    from quern.sources.step import read_graph

    other = "#53=IFCCARTESIANPOINT((0.,0.));\n#54=IFCCARTESIANPOINT((1.,2.));\n#55=IFCTRIMMEDTHING((#53,#54));\n#42=IFCPRODUCTDEFINITIONSHAPE('other',$,(#43));\n#43=IFCSHAPEREPRESENTATION($,'Body','Other',(#55));"
    a = read_graph(spark, model(tmp_path / "a.ifc")).graph
    text_ = MODEL.replace("#30,#40,'T'", "#30,#42,'T'").format(stamp=1, name="Wall", storey=10, x="5.", form="Curve", items="#50", height="2500.", more=other)
    (tmp_path / "b.ifc").write_text(text_)
    b = read_graph(spark, str(tmp_path / "b.ifc")).graph
    strict, probe = (graph_diff(a, b, geometry_policy=p).changes.where("op = 'MODIFY'").collect() for p in ("strict_syntax", "invariant_probe"))
    assert [r.old_entity_id for r in strict] == ["G:0000000000000000000003"] and strict[0].change_categories == ["ATTRIBUTES", "GEOMETRY", "RELATIONSHIP"]
    assert probe == []


def test_cache(spark, tmp_path):
    from quern.sources.cache import cached_graph, clear_cache

    path = tmp_path / "a.ifc"
    path.write_text(STEP)
    first = cached_graph(spark, str(path), str(tmp_path / "cache"))[0].count()
    assert cached_graph(spark, str(path), str(tmp_path / "cache"))[0].count() == first == 2
    clear_cache(spark, str(tmp_path / "cache"))
    assert not (tmp_path / "cache").exists()


def test_version_chain_and_overlaps(spark):
    files = spark.createDataFrame([("g", "a", 1), ("g", "b", 2), ("g", "c", 3), ("h", "x", 1)], "group string, file string, at int")
    assert pairs(scenes.version_pairs(files)) == {("g", "a", "b", "step"), ("g", "b", "c", "step"), ("g", "a", "c", "cumulative")}
    items = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2"), ("b", "2")], "file string, item string")
    row = scenes.file_overlaps(items).first()
    assert (row.shared, row.jaccard, row.multiset) == (1, 0.5, pytest.approx(1 / 3))


def test_field_operations_and_categories(spark):
    schema = "o struct<entity_type:string,attributes:map<string,string>,links:array<string>>, w struct<entity_type:string,attributes:map<string,string>,links:array<string>>"
    row = [(("A", {"x": "1", "y": "2"}, ["p"]), ("A", {"x": "1", "z": "3"}, ["p", "q"]))]
    ops = spark.createDataFrame(row, schema).select(changes.field_operations(F.col("o"), F.col("w")).alias("f")).first().f
    assert [(f.path, f.op) for f in ops] == [("/attributes/y", "remove"), ("/attributes/z", "add"), ("/refs/1", "add")]


# --- building models ------------------------------------------------------------------------------


def test_two_best_by_enumeration():
    rng = random.Random(8)
    for _ in range(40):
        scores = {(o, 10 + n): round(rng.uniform(0.5, 1), 2) for o in range(4) for n in range(4) if rng.random() < 0.6}
        if not scores:
            continue
        olds, news = sorted({o for o, _ in scores}), sorted({n for _, n in scores})
        every = []
        for choice in itertools.product([None, *news], repeat=len(olds)):
            pairs_ = tuple((o, n) for o, n in zip(olds, choice) if n is not None)
            if len({n for _, n in pairs_}) == len(pairs_) and all(p in scores for p in pairs_):
                every.append((len(pairs_), round(sum(scores[p] for p in pairs_), 12), pairs_))
        want = sorted(every, reverse=True)[:2]
        assert [(k, round(t, 12), p) for k, t, p in matching.two_best(scores)] == want


def test_edge_policy(spark):
    from quern.operators.geometry import classified_edges, edge_stats

    e, r = make(
        spark,
        [(1, "IfcWall", "W", {}), (2, "IfcBuildingStorey", "S", {}), (3, "IfcRelAggregates", "R1", {}), (4, "IfcWall", "W2", {}), (5, "IfcRelConnectsElements", "R2", {}), (6, "IfcLocalPlacement", None, {}), (7, "IfcRelAggregates", "R3", {}), (8, "IfcRelAssignsToGroup", "R4", {})],
        [(1, "/ObjectPlacement", 6), (1, "/Other", 4), (3, "/RelatedObjects/0", 1), (3, "/RelatingObject", 2), (5, "/RelatingElement", 1), (5, "/RelatedElement", 4), (7, "/RelatedObjects/0", 1), (7, "/RelatingObject", 4), (8, "/RelatedObjects/0", 1)],
    )
    edges = classified_edges(e, r)
    assert {(x.source_step, x.target_step, x.domain) for x in edges.collect()} == {(1, 6, "placement"), (1, 2, "spatial"), (1, 4, "topology"), (4, 1, "topology"), (1, 4, "geometry")}
    assert dict(pairs(edge_stats(edges))) == {"include:placement": 1, "include:spatial": 1, "context:topology": 2, "include:geometry": 1}


def test_placements_and_features(spark):
    from quern.operators.geometry import placement_matrices, signature_rows, spatial_features

    def shift(x):
        return [1.0, 0, 0, x, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]

    rows = [(1, None, shift(1.0)), (2, 1, shift(2.0)), (3, 2, shift(4.0)), (4, 3, shift(8.0)), (5, 6, shift(1.0)), (6, 5, shift(1.0)), (7, 6, shift(1.0)), (8, 99, shift(5.0))]
    rows = [(a, b, [float(x) for x in m]) for a, b, m in rows]
    got = {r.step_id: r.matrix[3] for r in placement_matrices(spark.createDataFrame(rows, "step_id long, parent long, local array<double>")).collect()}
    assert got == {1: 1.0, 2: 3.0, 3: 7.0, 4: 15.0, 8: 5.0}
    e, _ = make(spark, [(20, "IfcWall", "W", {"Name": "a"}), (21, "IfcCartesianPoint", None, {"Coordinates": "x"}), (22, "IfcDoor", "D", {"Name": "b"})])
    edges = spark.createDataFrame([(20, 21, "include", "geometry", "x")], "source_step long, target_step long, classification string, domain string, label string")
    products = spark.createDataFrame([(20, 2), (22, 1)], "step_id long, placement_step long")
    points = spark.createDataFrame([(21, [1.0, 2.0])], "point_step long, coordinates array<double>")
    matrices = spark.createDataFrame([(1, [float(x) for x in shift(1.0)]), (2, [float(x) for x in shift(3.0)])], "step_id long, matrix array<double>")
    found = spatial_features(products, edges, points, matrices)
    by = {r.step_id: r for r in found.collect()}
    assert by[20].centroid == [4.0, 2.0, 0.0] and by[22].centroid == [1.0, 0.0, 0.0] and by[22].aabb == [1.0, 0, 0, 1.0, 0, 0]
    signed = {r.step_id: r for r in signature_rows(e, edges, found).collect()}
    assert signed[20].guid == "W" and signed[20].vh_geometry != signed[22].vh_geometry and len(signed[20].placement) == 16


def test_ambiguous_points_are_a_class(spark):
    wall = (1, "IfcWall", "W", {})
    old = make(spark, [wall, (2, "IfcPoint", None, {"c": "1"}), (3, "IfcPoint", None, {"c": "2"})], [(1, "/p", 2), (1, "/p", 3)])
    new = make(spark, [wall, (2, "IfcPoint", None, {"c": "5"})], [(1, "/p", 2)])
    found = graph_diff(old, new)
    assert [(r.old_count, r.new_count, r.class_id[:2]) for r in found.class_deltas.collect()] == [(2, 1, "C:")]
    assert [r.op for r in found.changes.collect() if r.op != "MODIFY"] == ["CLASS_DELTA"]


def test_same_graph_and_report(spark):
    from quern.plans.report import environment_fingerprint, markdown_report, scene_summary

    g = make(spark, [(1, "IfcWall", "A", {"Name": "x"})])
    assert graph_diff(g, g).changes.count() == 0
    with pytest.raises(ValueError):
        bad = make(spark, [(1, "W", "A", {}), (2, "W", "A", {})])
        graph_diff(bad, bad)
    rows = spark.createDataFrame([("ADD", "IfcWall", None, "G:A", [], "chg-000001", 1)], f"op string, entity_type string, old_entity_id string, new_entity_id string, field_ops {changes.FIELD_OPS}, change_id string, position long")
    text_ = markdown_report(rows, spark.createDataFrame([], "relation_type string, child_id string, old_parent_id string, new_parent_id string"), "T", 4)
    assert "+1 added, 4 unchanged" in text_ and "| IfcWall | 1 |" in text_ and "chg-000001" in text_
    assert scene_summary(spark.createDataFrame([("F0", "wall"), ("F0", "wall"), (None, "door")], "storey string, category string")) == ["(none): 1 door", "F0: 2 wall"]
    assert environment_fingerprint().startswith('{"python"')
    assert scenes.group_label(["house_v1.ifc", "house_v2.ifc"]) == "house"


# --- nothing is cut off -----------------------------------------------------------------------------


def test_long_chains(spark):
    from quern.operators.geometry import reachable

    n = 38
    e, r = make(spark, [(i, "IfcThing", "A" if i == 0 else None, {"k": str(i)}) for i in range(n)], [(i, "/next", i + 1) for i in range(n - 1)])
    owners = {x.step_id: x.owner for x in refinement.rooted_owners(e, r, e.select("step_id").where("step_id IN (30, 37)")).collect()}
    assert owners == {30: "G:A", 37: "G:A"}
    assert reachable(e.where("step_id = 0").select("step_id"), r).count() == n
    start = spark.createDataFrame([(0, 0)], "old_step long, new_step long")
    assert matching.propagate(start, (e, r), (e, r)).count() == n - 1


def test_deep_parts_are_hashed_alike(spark):
    """Two chains of 68 parts, with other steps: their hashes are the same at every depth."""
    n = 68
    e, r = make(spark, [(base + i, "IfcThing", None, {"k": str(i)}) for base in (0, 1000) for i in range(n)], [(base + i, "/next", base + i + 1) for base in (0, 1000) for i in range(n - 1)])
    found = {x.step_id: x.hash for x in hashing.merkle_hashes(e, r.select("source_step", F.col("path").alias("label"), "target_step")).collect()}
    assert all(found[i] == found[1000 + i] for i in range(n)) and len(set(found.values())) == n


def test_strong_components_are_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(40 + i, 41 + i) for i in range(19)] + [(55, 50)]
    reach = {v: {v} for v in range(60)}
    for _ in range(60):
        for a, b in edges:
            reach[a] |= reach[b]
    want = {v: min(x for x in reach[v] if v in reach[x]) for v in reach}
    found = refinement.strong_components(spark.range(60).toDF("node"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == want


def test_numbers_of_many_changes(spark):
    rows = spark.range(1_000_002).select(F.lit("ADD").alias("op"), F.lit(None).cast("string").alias("old_entity_id"), F.format_string("G:%09d", "id").alias("new_entity_id"), F.lit(1).alias("n"))
    found = changes.with_change_ids(rows)
    assert found.select("change_id").distinct().count() == 1_000_002
    assert {(r.new_entity_id, r.change_id) for r in found.where("position IN (1, 1000000, 1000002)").collect()} == {("G:000000000", "chg-000001"), ("G:000999999", "chg-1000000"), ("G:001000001", "chg-1000002")}


def test_counts_are_taken_anew_each_hop(spark):
    """A target matched elsewhere no longer counts, one with an identifier does."""
    e, r = make(spark, [(1, "A", "R1", {}), (2, "A", "R2", {}), (3, "P", None, {}), (4, "P", None, {}), (5, "B", None, {}), (6, "Q", None, {}), (7, "Q", "R7", {})], [(1, "/b", 5), (5, "/p", 3), (5, "/p", 4), (2, "/p", 3), (1, "/q", 6), (1, "/q", 7)])
    start = spark.createDataFrame([(1, 1), (2, 2)], "old_step long, new_step long")
    # 3 comes from 2, 5 from 1; then 4 is the only open target of 5. Of 6 and 7 none is the only one.
    assert pairs(matching.propagate(start, (e, r), (e, r)).select("old_step", "hop")) == {(3, 1), (5, 1), (4, 2)}


def test_deeper_likeness_and_residual_blocks(spark):
    """Two alike entities under different grand-parents are told apart at depth 2; a row whose block key has no counterpart is tried with its family."""
    def graph_of(swap, base):
        a, b = (11, 10) if swap else (10, 11)
        e = [(1, "IfcDoor", "G1", {}), (2, "IfcWindow", "G2", {}), (base + a, "IfcHolder", None, {"k": "1"}), (base + b, "IfcHolder", None, {"k": "1"}), (base + 20, "IfcProxy", None, {"t": "x"}), (base + 21, "IfcProxy", None, {"t": "x"})]
        r = [(1, "/d", base + 10), (2, "/w", base + 11), (base + 10, "/p", base + 20), (base + 11, "/p", base + 21)]
        return make(spark, e, r)

    old, new = graph_of(False, 0), graph_of(False, 100)
    wanted = [g[0].where("entity_type = 'IfcProxy'") for g in (old, new)]
    rows = [matching.features(*g, w) for g, w in zip((old, new), wanted)]
    assert matching.secondary_match(*rows).ambiguous_count == 2
    found = matching.secondary_match(*rows, graphs=(old, new))
    assert pairs(found.pairs.select("old_step", "new_step", "depth")) == {(20, 120, 2), (21, 121, 2)} and found.ambiguous_count == 0
    deep = {x.step_id: x for x in matching.deep_features(*old, wanted[0]).collect()}
    assert deep[20].ancestry2 != deep[21].ancestry2 and deep[20].depth3 == deep[21].depth3
    a = make(spark, [(1, "IfcBeam", None, {"Tag": "b", "l": "1"}), (9, "IfcX", None, {})], [(1, "/x", 9), (1, "/y", 9), (1, "/z", 9), (1, "/z", 9)])
    b = make(spark, [(2, "IfcBeam", None, {"Tag": "b", "l": "1"}), (9, "IfcX", None, {})], [(2, "/x", 9)])
    rows = [matching.features(*g, g[0].where("entity_type = 'IfcBeam'")) for g in (a, b)]
    assert [(r.block, r.old_step, r.new_step) for r in matching.secondary_match(*rows).pairs.collect()] == [("IfcBeam|residual", 1, 2)]


def test_whole_result(spark):
    """Field operations go down to the value; owners, identities, snapshots, header and replayed lines."""
    import json

    from quern.plans.report import change_summary, folder_report, inspection
    from quern.streaming.feed import replay

    seen = []
    old = make(spark, [(1, "IfcWall", "A", {"Name": "x", "P": "1"}), (5, "IfcPoint", None, {"c": "9"}), *((i, "IfcWall", f"R{i}", {"Name": f"r{i}"}) for i in range(10, 16))], [(i, "/p", 5) for i in range(10, 16)])
    new = make(spark, [(1, "IfcWall", "A", {"Name": "y", "Q": "1"}), *((i, "IfcWall", f"R{i}", {"Name": f"r{i}"}) for i in range(10, 16))])
    found = graph_diff(old, new, progress=seen.append)
    by = {(r.op, r.old_entity_id or r.new_entity_id): r for r in found.changes.collect()}
    wall = by["MODIFY", "G:A"]
    assert [(f.path, f.op, f.old, f.new) for f in wall.field_ops] == [("/attributes/Name/value", "replace", '"x"', '"y"'), ("/attributes/P", "remove", '{"kind":"string","value":"1"}', None), ("/attributes/Q", "add", None, '{"kind":"string","value":"1"}')]
    (gone,) = [r for r in by.values() if r.op == "REMOVE"]
    assert gone.owner_total == 6 and gone.owner_sample == [f"G:R{i}" for i in range(10, 15)] and json.loads(gone.old_snapshot)["entity_type"] == "IfcPoint"
    assert wall.match_method == "exact_guid" and wall.match_confidence == 1.0 and wall.stability_tier == "G"
    assert found.header["stats"]["matched_by_method"] == {"exact_guid": 7} and found.header["stats"]["guid_quality"]["old"]["unique_valid"] == 7
    assert [e["stage"] for e in seen if e["status"] == "done"] == list(found.timings) and seen[-1]["overall_progress"] == 1.0
    lines = [json.loads(r.value) for r in replay(found, "chunked_json", 3).orderBy("rank", "position").collect()]
    assert lines[0]["header"]["version"] == "2" and lines[1]["count"] == 3 and lines[1]["items"][0]["change_id"] == "chg-000001"
    with pytest.raises(ValueError):
        replay(found, "chunked_json", 0)
    assert change_summary(found.changes)[0] == "7 MODIFY, 1 REMOVE" and inspection(old[0])["types"] == [("IfcWall", 7), ("IfcPoint", 1)]
    assert "1. a to b (step)" in folder_report([("a", "b", "step")], ["# t\n\ntext"])
