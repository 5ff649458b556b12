"""Queries on one graph, each with the DuckDB SQL that states its result: index, canonical values, hashes, refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.canonical import canonical_items, canonical_string, normalise_measure, quantised
from quern.operators import hashing, identity, refinement
from quern.operators.index import GraphIndex, dangling_report
from quern.plans.tables import PLACES, ROOTS, graph, graph_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_SEP, _FIELD = "chr(31)", "chr(30)"
#: A small type lattice over the tables, for queries with subtypes.
CLOSURE = [("Region", "Place"), ("Nation", "Place"), ("Supplier", "Party"), ("Customer", "Party"), ("Part", "Item"), ("Orders", "Item"), ("Place", "Root"), ("Party", "Root"), ("Item", "Root")]


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c for c in ctes if c) + "\n" + select


def _index(spark: SparkSession, sf_dir: str, kinds=ROOTS, version: str = "old") -> GraphIndex:
    return GraphIndex(*graph(spark, sf_dir, version, kinds))


_OLD = graph_sql(("old",))
_NEW = graph_sql(("new",))
_DOCS = graph_sql(("old",), ("Document",))
_PLACES = graph_sql(("old",), PLACES)


@query(_with(_OLD, select="SELECT entity_type, count(*) AS n FROM e GROUP BY entity_type"))
def index_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).type_counts()


@query(_with(_DOCS, select="SELECT global_id, min(step_id) AS step_id FROM e WHERE global_id IS NOT NULL GROUP BY global_id HAVING count(*) = 1"))
def index_guid_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, ["Document"]).unique_guids()


@query(_with(_DOCS, select="SELECT global_id, array_to_string(list(step_id ORDER BY step_id), ',') AS steps FROM e WHERE global_id IS NOT NULL GROUP BY global_id HAVING count(*) > 1"))
def index_guid_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _index(spark, sf_dir, ["Document"]).entities_by_guid().where(F.size("steps") > 1)
    return found.select("global_id", F.array_join(F.col("steps").cast("array<string>"), ",").alias("steps"))


@query(_with(_OLD, select="SELECT step_id, entity_type FROM e JOIN a USING (graph_id, step_id) WHERE name = 'Balance'"))
def index_attr_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).query(attr_name="Balance").select("step_id", "entity_type")


@query(_with(_OLD, select="""SELECT step_id, entity_type FROM e JOIN a USING (graph_id, step_id) WHERE name = 'Segment' AND value <> '{"kind":"null"}'"""))
def index_attr_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).with_nonempty_attribute("Segment").select("step_id", "entity_type")


@query(_with(_OLD, select="""SELECT step_id, entity_type FROM e JOIN a USING (graph_id, step_id) WHERE name = 'Segment' AND value = '{"kind":"string","value":"BUILDING"}'"""))
def index_attr_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).with_attribute_value("Segment", '{"kind":"string","value":"BUILDING"}').select("step_id", "entity_type")


_EDGES = "edges AS (SELECT source_step, target_step, split_part(string_split(ltrim(path, '/'), '/')[1], '@', 1) AS attr_name, len(string_split(ltrim(path, '/'), '/')) > 1 AS in_aggregate FROM r WHERE target_step IN (SELECT step_id FROM e))"


@query(_with(_NEW, _EDGES, select="SELECT g.* FROM edges g JOIN e ON e.step_id = g.source_step WHERE e.entity_type = 'Customer'"))
def index_edges_fwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir, version="new")
    return index.targets_of(index.entities_of_type("Customer")).select("source_step", "target_step", "attr_name", "in_aggregate")


@query(_with(_NEW, _EDGES, select="SELECT g.* FROM edges g JOIN e ON e.step_id = g.target_step WHERE e.entity_type = 'Customer'"))
def index_edges_rev(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir, version="new")
    return index.sources_of(index.entities_of_type("Customer")).select("source_step", "target_step", "attr_name", "in_aggregate")


@query(_with(_OLD, select="""SELECT step_id, global_id FROM e JOIN a USING (graph_id, step_id) WHERE entity_type = 'Orders' AND name = 'Status' AND value = '{"kind":"string","value":"F"}'"""))
def index_conjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _index(spark, sf_dir).query(entity_type="Orders", attr_name="Status", attr_value='{"kind":"string","value":"F"}')
    return found.select("step_id", "global_id")


@query(_with(_OLD, select="SELECT entity_type, count(*) AS n FROM e WHERE entity_type IN ('Supplier', 'Customer') GROUP BY entity_type"))
def index_subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, refs = graph(spark, sf_dir)
    pairs, grown = set(CLOSURE) | {(t, t) for pair in CLOSURE for t in pair}, 0
    while grown != len(pairs):
        grown = len(pairs)
        pairs |= {(a, d) for a, b in pairs for c, d in pairs if b == c}
    closure = spark.createDataFrame(sorted(pairs), "type string, ancestor string")
    return GraphIndex(entities, refs, closure).entities_of_type("Party", include_subtypes=True).groupBy("entity_type").agg(F.count("*").alias("n"))


@query(_with(_OLD, select="SELECT attr_name, count(*) AS sources, count(DISTINCT target_step) AS targets FROM (SELECT source_step, target_step, ltrim(path, '/') AS attr_name FROM r WHERE target_step IN (SELECT step_id FROM e)) GROUP BY attr_name"))
def adjacency_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = refinement.adjacency(*graph(spark, sf_dir))
    return edges.groupBy(F.ltrim("path", F.lit("/")).alias("attr_name")).agg(F.count("*").alias("sources"), F.count_distinct("target_step").alias("targets"))


@query(_with(_NEW, "lost AS (SELECT * FROM r WHERE target_step NOT IN (SELECT step_id FROM e))", select="SELECT graph_id, source_step, path, target_step, target_type, (SELECT count(*) FROM lost) AS total FROM lost ORDER BY source_step, path, target_step, target_type LIMIT 10"))
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dangling_report(*graph(spark, sf_dir, "new"))


@query(_with(_OLD, select="SELECT e.step_id, count(name) FILTER (name <> 'OwnerHistory') AS kept, count(name) AS attributes FROM e JOIN a USING (graph_id, step_id) WHERE entity_type = 'Orders' GROUP BY e.step_id"))
def profile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, refs = graph(spark, sf_dir)
    kept, _ = hashing.profiled(entities.withColumn("raw", F.size("attributes")), refs)
    return kept.where("entity_type = 'Orders'").select("step_id", F.size("attributes").cast("long").alias("kept"), F.col("raw").cast("long").alias("attributes"))


_TURNS = """t AS (SELECT conv_id, turn, CASE WHEN role IS NULL THEN '{"kind":"null"}' ELSE '{"kind":"string","value":' || to_json(role)::VARCHAR || '}' END AS v FROM conversations)"""


@query(_with(_TURNS, select="""SELECT conv_id, '{"items":[' || string_agg(v, ',' ORDER BY turn, v) || '],"kind":"list"}' AS as_list, '{"items":[' || string_agg(v, ',' ORDER BY v) || '],"kind":"bag"}' AS as_bag FROM t GROUP BY conv_id"""))
def canonical_list_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", canonical_string(F.col("role")).alias("v"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "v"))), lambda x: x["v"])
    return turns.groupBy("conv_id").agg(canonical_items("list", ordered).alias("as_list"), canonical_items("bag", F.collect_list("v")).alias("as_bag"))


@query("SELECT l_returnflag, l_linestatus, sum(round_even(l_extendedprice * 1e6, 0)::BIGINT)::BIGINT AS price, sum(round_even((round_even(l_quantity * 0.3048 / 1e-6, 0) * 1e-6) * 1e6, 0)::BIGINT)::BIGINT AS metres FROM lineitem GROUP BY ALL")
def quantize_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    metres = normalise_measure(F.col("l_quantity"), F.lit(0.3048), 1e-6)
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.sum(quantised(F.col("l_extendedprice"))).alias("price"), F.sum(quantised(metres)).alias("metres"))


# --- hashes ------------------------------------------------------------------------

_STRIP = "regexp_replace(value, '\\{\"id\":-?[0-9]+,\"kind\":\"ref\"\\}', '{\"kind\":\"ref\"}', 'g')"
EDGE_SQL = f"es AS (SELECT graph_id, source_step AS step_id, string_agg(path || {_FIELD} || coalesce(target_type, '') || {_FIELD} || n, {_SEP} ORDER BY path || {_FIELD} || coalesce(target_type, '') || {_FIELD} || n) AS edges FROM (SELECT graph_id, source_step, path, target_type, count(*) AS n FROM r GROUP BY ALL) GROUP BY ALL)"
HASH_SQL = EDGE_SQL + f",\natt AS (SELECT graph_id, step_id, string_agg(name || '=' || {_STRIP}, {_SEP} ORDER BY name || '=' || {_STRIP}) AS attrs FROM a GROUP BY ALL),\nh AS (SELECT e.graph_id, e.step_id, e.entity_type, e.global_id, sha256(e.entity_type || chr(10) || coalesce(attrs, '') || chr(10) || coalesce(edges, '')) AS hash FROM e LEFT JOIN att USING (graph_id, step_id) LEFT JOIN es USING (graph_id, step_id))"


@query(_with(_OLD, HASH_SQL, select="SELECT step_id, hash FROM h"))
def structural_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.structural_hashes(*graph(spark, sf_dir)).select("step_id", "hash")


_LINES = ("Lineitem",)


@query(_with(graph_sql(("old",), _LINES), EDGE_SQL, select="SELECT step_id, edges FROM es"))
def edge_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.edge_signature(graph(spark, sf_dir, kinds=_LINES)[1]).select("step_id", "edges")


@query(_with(_OLD, f"att AS (SELECT step_id, string_agg(name || '=' || json_extract_string(value, '$.kind'), {_SEP} ORDER BY name) AS attrs FROM a GROUP BY ALL)", select="SELECT step_id, sha256(entity_type || chr(10) || attrs) AS signature FROM e JOIN att USING (step_id)"))
def semantic_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.semantic_signatures(graph(spark, sf_dir)[0]).select("step_id", "signature")


_OWN = f"own AS (SELECT step_id, 'class=' || entity_type || {_SEP} || string_agg('attr=' || name || ':' || value, {_SEP} ORDER BY 'attr=' || name || ':' || value) AS own FROM e JOIN a USING (step_id) GROUP BY step_id, entity_type)"


def _merkle_sql(levels: int) -> str:
    parts = [_PLACES, _OWN, "m0 AS (SELECT step_id, sha256(own) AS hash FROM own WHERE step_id NOT IN (SELECT source_step FROM r))"]
    for k in range(1, levels + 1):
        parts.append(f"m{k} AS (SELECT o.step_id, sha256(any_value(own) || {_SEP} || string_agg('edge=' || path || ':' || m.hash, {_SEP} ORDER BY 'edge=' || path || ':' || m.hash)) AS hash FROM own o JOIN r ON r.source_step = o.step_id JOIN m{k - 1} m ON m.step_id = r.target_step GROUP BY o.step_id)")
    return _with(*parts, select=" UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(levels + 1)))


@query(_merkle_sql(2))
def merkle_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, refs = graph(spark, sf_dir, kinds=PLACES)
    return hashing.merkle_hashes(entities, refs.select("source_step", F.col("path").alias("label"), "target_step")).select("step_id", "hash")


_SEEDS = "seed AS (SELECT step_id, sha256(entity_type || '|' || global_id) AS seed FROM e)"


@query(
    _with(
        _PLACES, _SEEDS,
        "c AS (SELECT source_step AS a, target_step AS b FROM r WHERE path = '/Nation'), s AS (SELECT source_step AS a, target_step AS b FROM r WHERE path = '/Region')",
        "cb AS (SELECT a, b FROM c UNION SELECT b, a FROM c), sb AS (SELECT a, b FROM s UNION SELECT b, a FROM s)",
        "s2 AS (SELECT a, b FROM sb UNION SELECT x.a, y.b FROM sb x JOIN sb y ON x.b = y.a WHERE x.a <> y.b)",
        "tok AS (SELECT a, 'context:' || seed AS t FROM cb JOIN seed ON b = step_id UNION ALL SELECT a, 'spatial:' || seed FROM s2 JOIN seed ON b = step_id)",
        f"tl AS (SELECT a, string_agg(t, {_SEP} ORDER BY t) AS tokens FROM tok GROUP BY a)",
        select=f"SELECT step_id, sha256('self:' || seed || coalesce({_SEP} || tokens, '')) AS hash FROM seed LEFT JOIN tl ON a = step_id",
    )
)
def topology_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, refs = graph(spark, sf_dir, kinds=PLACES)
    seeds = entities.select("step_id", F.sha2(F.concat_ws("|", "entity_type", "global_id"), 256).alias("seed"))
    edges = lambda p: refs.where(F.col("path") == p).select(F.col("source_step").alias("a"), F.col("target_step").alias("b"))
    return hashing.topology_hashes(seeds, edges("/Nation"), edges("/Region"))


# --- refinement ----------------------------------------------------------------------

_GRAPH4 = ("Region", "Nation", "Customer", "Orders")


def _wl_sql(rounds: int) -> str:
    parts = [graph_sql(("old",), _GRAPH4), "w0 AS (SELECT step_id, sha256(entity_type) AS colour FROM e)"]
    for k in range(1, rounds + 1):
        one = f"path || {_FIELD} || target_type || {_FIELD} || colour || {_FIELD} || n"
        parts.append(f"g{k} AS (SELECT source_step, string_agg({one}, {_SEP} ORDER BY {one}) AS around FROM (SELECT source_step, path, target_type, colour, count(*) AS n FROM r JOIN w{k - 1} ON step_id = target_step GROUP BY ALL) GROUP BY source_step)")
        parts.append(f"w{k} AS (SELECT step_id, sha256(colour || chr(10) || coalesce(around, '')) AS colour FROM w{k - 1} LEFT JOIN g{k} ON source_step = step_id)")
    return ", ".join(parts)


def _seeded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    entities, refs = graph(spark, sf_dir, kinds=_GRAPH4)
    return entities.select("step_id", F.sha2("entity_type", 256).alias("colour")), refs


def _wl_round(rounds: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        colours, refs = _seeded(spark, sf_dir)
        for _ in range(rounds):
            colours = refinement.refine_once(colours, refs)
        return colours

    return run


for _k in (1, 2, 3):
    QUERIES[f"wl_round_{_k}"] = _wl_round(_k)
    ORACLES[f"wl_round_{_k}"] = _with(_wl_sql(_k), select=f"SELECT * FROM w{_k}")


@query(_with(_wl_sql(3), select="SELECT size, count(*) AS classes FROM (SELECT count(*) AS size FROM w3 GROUP BY colour) GROUP BY size"))
def wl_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    colours, refs = _seeded(spark, sf_dir)
    return refinement.partition_summary(refinement.refine(colours, refs, max_rounds=3)[0])


_ITEMS = ("Orders", "Lineitem")


@query(_with(graph_sql(("old",), _ITEMS), f"x AS (SELECT source_step AS line, target_step AS o FROM r WHERE path = '/Order' AND target_step IN (SELECT step_id FROM e))", "m AS (SELECT line, min(o) AS o FROM x GROUP BY line)", select="SELECT step_id AS node, coalesce(m.o, step_id) AS component FROM e LEFT JOIN m ON m.line = step_id"))
def scc_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong components of orders and their lines, which refer to each other."""
    entities, refs = graph(spark, sf_dir, kinds=_ITEMS)
    down = refs.where("path = '/Order'").select(F.col("source_step").alias("a"), F.col("target_step").alias("b")).join(entities.select(F.col("step_id").alias("b")), "b", "left_semi").select("a", "b")
    edges = down.union(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return refinement.strong_components(entities.select(F.col("step_id").alias("node")), edges)


@query()
def rooted_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, refs = graph(spark, sf_dir, kinds=_GRAPH4)
    steps = entities.where("entity_type = 'Nation'").select("step_id")
    summary = refinement.owner_summary(refinement.rooted_owners(entities, refs, steps))
    return summary.select("step_id", F.array_join("sample", ",").alias("sample"), "total")


ORACLES["rooted_owners"] = _with(
    graph_sql(("old",), _GRAPH4),
    "o1 AS (SELECT r.target_step AS step_id, r.source_step AS at FROM r WHERE path = '/Nation'), o2 AS (SELECT o1.step_id, r.source_step AS at FROM o1 JOIN r ON r.target_step = o1.at WHERE path = '/Customer')",
    "n AS (SELECT step_id FROM e WHERE entity_type = 'Nation'), owned AS (SELECT step_id, step_id AS at FROM n UNION SELECT * FROM o1 UNION SELECT * FROM o2), named AS (SELECT DISTINCT o.step_id, 'G:' || global_id AS owner FROM owned o JOIN e ON e.step_id = o.at)",
    "k AS (SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY owner) AS i, count(*) OVER (PARTITION BY step_id) AS total FROM named)",
    select="SELECT step_id, string_agg(owner, ',' ORDER BY owner) AS sample, any_value(total) AS total FROM k WHERE i <= 5 GROUP BY step_id",
)


# --- identifiers -----------------------------------------------------------------------


@query(_with(_DOCS, "g AS (SELECT graph_id, global_id, count(*) AS n FROM e GROUP BY ALL)", select="SELECT graph_id, sum(n)::BIGINT AS valid_total, count(*) FILTER (n = 1) AS unique_valid, count(*) FILTER (n > 1) AS duplicate_ids, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_occurrences, 0::BIGINT AS invalid FROM g GROUP BY graph_id"))
def guid_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.guid_quality(graph(spark, sf_dir, kinds=["Document"])[0])


@query(_with(_DOCS, "g AS (SELECT global_id, count(*) AS n FROM e GROUP BY ALL)", select="SELECT 'old' AS graph_id, count(*) FILTER (n > 1) AS collisions FROM g"))
def guid_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.collision_count(graph(spark, sf_dir, kinds=["Document"])[0])


@query(_with(_DOCS, "g AS (SELECT *, count(*) OVER (PARTITION BY global_id) AS n, row_number() OVER (PARTITION BY global_id ORDER BY step_id) AS i FROM e)", select="SELECT step_id, CASE WHEN n = 1 THEN 'G:' || global_id ELSE 'G!:' || global_id || '#' || i END AS entity_id FROM g"))
def guid_disambiguate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.identify(graph(spark, sf_dir, kinds=["Document"])[0], "disambiguate").select("step_id", "entity_id")
