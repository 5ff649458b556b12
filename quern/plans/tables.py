"""The star schema as a versioned typed graph: entities with attributes, and labelled references.

``graph`` gives one version of the tables as two DataFrames:
``entities(graph_id, step_id, ord, entity_type, global_id, attributes)`` and
``refs(graph_id, source_step, ref_ord, path, target_step, target_type)``.
``graph_sql`` states the same as DuckDB common table expressions ``e``, ``a``
(attributes in long form) and ``r``. The new version has edits by key
modulus. Line items have no key: their step is a row number over all columns.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.canonical import canonical_int, canonical_real, canonical_string

#: Room for the keys of one type.
SPAN = 1_000_000_000


@dataclass(frozen=True)
class Kind:
    table: str
    number: int
    key: str
    #: Attribute name, kind of value, SQL expression; alphabetical.
    attributes: tuple[tuple[str, str, str], ...]
    refs: tuple[tuple[str, str, str], ...] = ()
    root: bool = True
    guid: str = ""
    #: SELECT over the table that gives the new version.
    edit: str = "SELECT * FROM {t}"
    columns: tuple[str, ...] = field(default=())


def _replace(columns: str, changed: dict[str, str]) -> str:
    return ", ".join(f"{changed[c]} AS {c}" if c in changed else c for c in columns.split())


_CUSTOMER = "c_custkey c_name c_nationkey c_acctbal c_mktsegment"
_PART = "p_partkey p_name p_brand p_type p_size p_retailprice"
_ORDERS = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"
LINE_COLUMNS = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()

KINDS: dict[str, Kind] = {
    "Region": Kind("region", 1, "r_regionkey", (("Name", "string", "r_name"),)),
    "Nation": Kind("nation", 2, "n_nationkey", (("Name", "string", "n_name"),), (("/Region", "Region", "n_regionkey"),)),
    "Supplier": Kind("supplier", 3, "s_suppkey", (("Balance", "real", "s_acctbal"), ("Name", "string", "s_name")), (("/Nation", "Nation", "s_nationkey"),)),
    "Customer": Kind(
        "customer", 4, "c_custkey",
        (("Balance", "real", "c_acctbal"), ("Name", "string", "c_name"), ("Segment", "string", "nullif(c_mktsegment, 'MACHINERY')")),
        (("/Nation", "Nation", "c_nationkey"),),
        edit="SELECT " + _replace(_CUSTOMER, {"c_name": "CASE WHEN c_custkey % 89 = 0 THEN concat(c_name, ' II') ELSE c_name END", "c_nationkey": "CASE WHEN c_custkey % 83 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END"})
        + " FROM {t} WHERE c_custkey % 97 <> 0 UNION ALL SELECT " + _replace(_CUSTOMER, {"c_custkey": "c_custkey + 500000000"}) + " FROM {t} WHERE c_custkey % 101 = 0",
    ),
    "Part": Kind(
        "part", 5, "p_partkey",
        (("Brand", "string", "p_brand"), ("Name", "string", "p_name"), ("Price", "real", "p_retailprice"), ("Size", "int", "p_size"), ("Type", "string", "p_type")),
        edit="SELECT " + _replace(_PART, {"p_size": "CASE WHEN p_partkey % 61 = 0 THEN p_size + 1 ELSE p_size END"}) + " FROM {t}",
    ),
    "Orders": Kind(
        "orders", 6, "o_orderkey",
        (("Date", "string", "CAST(CAST(o_orderdate AS DATE) AS {str})"), ("OwnerHistory", "string", "o_orderpriority"), ("Status", "string", "o_orderstatus"), ("Total", "real", "o_totalprice")),
        (("/Customer", "Customer", "o_custkey"),),
        edit="SELECT " + _replace(_ORDERS, {"o_totalprice": "CASE WHEN o_orderkey % 71 = 0 THEN o_totalprice + 1 ELSE o_totalprice END", "o_orderpriority": "CASE WHEN o_orderkey % 73 = 0 THEN '9-OTHER' ELSE o_orderpriority END"}) + " FROM {t}",
    ),
    "Lineitem": Kind(
        "lineitem", 7, "l_step",
        (("Discount", "real", "l_discount"), ("Quantity", "real", "l_quantity"), ("ReturnFlag", "string", "l_returnflag"), ("Status", "string", "l_linestatus"), ("Tax", "real", "l_tax")),
        (("/Order", "Orders", "l_orderkey"), ("/Part", "Part", "l_partkey"), ("/Supplier", "Supplier", "l_suppkey")),
        root=False,
        edit="SELECT * FROM {t} WHERE (l_orderkey + l_step) % 50 <> 0",
    ),
    "Document": Kind("documents", 8, "doc_id", (("Language", "string", "lang"), ("Source", "string", "source")), guid="md5(coalesce(text, ''))"),
}
ROOTS = ("Region", "Nation", "Supplier", "Customer", "Part", "Orders")
PLACES = ("Region", "Nation", "Supplier", "Customer")


def _frame(spark: SparkSession, sf_dir: str, kind: Kind, version: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{kind.table}.parquet")
    if kind.table == "lineitem":
        rows = _line_steps(rows)
    if version == "new" and kind.edit != "SELECT * FROM {t}":
        rows = spark.sql(kind.edit.replace("{t}", "{rows}"), rows=rows)
    return rows


def _line_steps(rows: DataFrame) -> DataFrame:
    """Row numbers over all columns, counted by order so that no task sorts the whole table.

    l_step is (order key + 1) * 1000 + number within the order.
    """
    from pyspark.sql import Window as W

    within = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE_COLUMNS[1:]))
    return rows.withColumn("l_step", ((F.col("l_orderkey") + 1) * 1000 + within).cast("long"))


def _step(kind: Kind, key) -> object:
    return (F.lit(kind.number * SPAN) if kind.table != "lineitem" else F.lit(kind.number * SPAN * 1000)) + F.col(key).cast("long")


def step_sql(name: str, key: str) -> str:
    kind = KINDS[name]
    return f"({kind.number * SPAN * (1000 if kind.table == 'lineitem' else 1)} + {key}::BIGINT)"


_CANON = {"string": canonical_string, "int": canonical_int, "real": canonical_real}


def graph(spark: SparkSession, sf_dir: str, version: str = "old", kinds: Iterable[str] = ROOTS, fresh_guids: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entities and references of one version ("old" or "new") of the tables of some kinds."""
    entities = refs = None
    for name in kinds:
        kind = KINDS[name]
        rows = _frame(spark, sf_dir, kind, version)
        step = _step(kind, kind.key)
        guid = F.expr(kind.guid) if kind.guid else F.md5(F.concat(F.lit(f"{'fresh' if fresh_guids and version == 'new' else ''}{name}:"), F.col(kind.key).cast("string")))
        values = [x for n, k, e in kind.attributes for x in (F.lit(n), _CANON[k](F.expr(e.replace("{str}", "STRING"))))]
        one = rows.select(
            F.lit(version).alias("graph_id"), step.alias("step_id"), step.alias("ord"), F.lit(name).alias("entity_type"),
            (guid if kind.root else F.lit(None).cast("string")).alias("global_id"), F.create_map(*values).alias("attributes"),
        )
        entities = one if entities is None else entities.unionAll(one)
        if kind.refs:
            links = [F.struct(F.lit(i).alias("ref_ord"), F.lit(p).alias("path"), _step(KINDS[t], c).alias("target_step"), F.lit(t).alias("target_type")) for i, (p, t, c) in enumerate(kind.refs)]
            own = rows.select(F.lit(version).alias("graph_id"), step.alias("source_step"), F.inline(F.array(*links)))
            refs = own if refs is None else refs.unionAll(own)
    if refs is None:
        refs = spark.createDataFrame([], "graph_id string, source_step long, ref_ord int, path string, target_step long, target_type string")
    return entities, refs


def graph_sql(versions: Iterable[str] = ("old",), kinds: Iterable[str] = ROOTS, fresh_guids: bool = False) -> str:
    """The CTEs ``e``, ``a`` and ``r`` over the same rows, for DuckDB."""
    ctes, e, a, r = [], [], [], []
    for name in kinds:
        kind = KINDS[name]
        base = kind.table
        if kind.table == "lineitem":
            ctes.append(f"line_steps AS (SELECT *, (l_orderkey + 1) * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_COLUMNS[1:])}) AS l_step FROM lineitem)")
            base = "line_steps"
        for v in versions:
            t = f"{kind.table}_{v}"
            ctes.append(f"{t} AS ({(kind.edit if v == 'new' else 'SELECT * FROM {t}').format(t=base)})")
            step = step_sql(name, kind.key)
            guid = kind.guid or f"md5('{'fresh' if fresh_guids and v == 'new' else ''}{name}:' || {kind.key})"
            e.append(f"SELECT '{v}' AS graph_id, {step} AS step_id, '{name}' AS entity_type, {guid if kind.root else 'NULL'} AS global_id FROM {t}")
            for n, k, x in kind.attributes:
                x = x.replace("{str}", "VARCHAR")
                value = {"string": f"to_json({x})::VARCHAR", "int": f"({x})::BIGINT::VARCHAR", "real": f"round_even({x} * 1e6, 0)::BIGINT::VARCHAR"}[k]
                tag = "real_q" if k == "real" else k
                a.append(f"SELECT '{v}' AS graph_id, {step} AS step_id, '{n}' AS name, CASE WHEN {x} IS NULL THEN '{{\"kind\":\"null\"}}' ELSE '{{\"kind\":\"{tag}\",\"value\":' || {value} || '}}' END AS value FROM {t}")
            for i, (p, target, c) in enumerate(kind.refs):
                r.append(f"SELECT '{v}' AS graph_id, {step} AS source_step, {i} AS ref_ord, '{p}' AS path, {step_sql(target, c)} AS target_step, '{target}' AS target_type FROM {t}")
    if not r:
        r.append("SELECT '' AS graph_id, 0::BIGINT AS source_step, 0 AS ref_ord, '' AS path, 0::BIGINT AS target_step, '' AS target_type WHERE false")
    return ",\n".join([*ctes, *(f"{n} AS ({' UNION ALL '.join(x)})" for n, x in (("e", e), ("a", a), ("r", r)))])
