"""STEP (ISO 10303-21) files as entities and references.

Files are read by Spark (any store it reads) and parsed on the executors, one
file a task, once; what is parsed is a table from then on. Names of types and
attributes, and which aggregates are sets, come from a schema (see
:mod:`quern.sources.schema`). Measures are in the file's units and are brought
to SI units.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.canonical import DIRECTION_SCALE, MEASURE_STEPS, OTHER_MEASURE_STEP, REAL_SCALE, SI_PREFIXES
from quern.plans.loops import stored
from quern.sources.schema import Schema, core_schema

_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^']|'')*')|(?P<ref>#\d+)|(?P<real>[-+]?\d+\.\d*(?:[eE][-+]?\d+)?)|(?P<int>[-+]?\d+)|(?P<enum>\.[A-Za-z0-9_]+\.)|(?P<binary>\"[0-9A-Fa-f]*\")|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign>[$*(),;=]))")
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
SCHEMAS = ("IFC4", "IFC2X3")

ENTITY_SCHEMA = "graph_id string, step_id long, ord long, entity_type string, global_id string, attributes map<string,string>, refs array<struct<ref_ord:int,path:string,target_step:long>>, schema_name string, time_stamp string, units map<string,double>"


def _tokens(text: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m.group(m.lastgroup)) for m in _TOKEN.finditer(text)]


def _decoded(text: str) -> str:
    r"""A STEP string without quotes; ``\X2\....\X0\`` and ``\S\`` escapes are resolved."""
    text = text[1:-1].replace("''", "'")
    text = re.sub(r"\\X2\\([0-9A-Fa-f]+)\\X0\\", lambda m: bytes.fromhex(m[1]).decode("utf-16-be", "replace"), text)
    text = re.sub(r"\\X\\([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), text)
    return re.sub(r"\\S\\(.)", lambda m: chr(ord(m[1]) + 128), text)


def _value(tokens: list[tuple[str, str]], at: int) -> tuple[dict | list, int]:
    """The value that starts at a token, as a canonical union, and where the next one starts."""
    kind, text = tokens[at]
    if kind == "sign" and text == "(":
        items, at = [], at + 1
        while tokens[at][1] != ")" or tokens[at][0] != "sign":
            if tokens[at] == ("sign", ","):
                at += 1
                continue
            item, at = _value(tokens, at)
            items.append(item)
        return {"items": items, "kind": "list"}, at + 1
    if kind == "name" and at + 1 < len(tokens) and tokens[at + 1] == ("sign", "("):
        inner, at = _value(tokens, at + 1)
        return {"kind": "simple", "type": text, "value": inner["items"][0] if inner["items"] else {"kind": "null"}}, at
    made = {
        "string": lambda: {"kind": "string", "value": _decoded(text)},
        "ref": lambda: {"id": int(text[1:]), "kind": "ref"},
        "real": lambda: {"kind": "real", "value": f"{float(text) + 0.0:.17g}"},
        "int": lambda: {"kind": "int", "value": int(text)},
        "binary": lambda: {"kind": "string", "value": text.strip('"')},
        "name": lambda: {"kind": "string", "value": text},
        "enum": lambda: {"kind": "bool", "value": text == ".T."} if text in (".T.", ".F.") else {"kind": "string", "value": text.strip(".")},
        "sign": lambda: {"kind": "null"} if text == "$" else {"kind": "derived"},
    }[kind]()
    return made, at + 1


#: Measures whose unit is not named after them, and those without a unit.
_UNIT_OF = {"IFCPOSITIVELENGTHMEASURE": "LENGTHUNIT", "IFCNONNEGATIVELENGTHMEASURE": "LENGTHUNIT", "IFCPOSITIVEPLANEANGLEMEASURE": "PLANEANGLEUNIT"}
_NO_UNIT = ("IFCRATIOMEASURE", "IFCPOSITIVERATIOMEASURE")


def unit_type(measure: str) -> str | None:
    """The type of unit in which a measure is given; null for what is no measure or a ratio."""
    key = measure.upper()
    if key in _UNIT_OF or key in _NO_UNIT:
        return _UNIT_OF.get(key)
    return f"{key[3:-7]}UNIT" if key.startswith("IFC") and key.endswith("MEASURE") and len(key) > 10 else None


def _canonical_text(value: dict) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def _settled(value: dict, path: str, links: list, schema: Schema, units: dict[str, float], kind: str | None = None) -> dict:
    """The canonical form of a parsed value; references met on the way are added to ``links`` as (path, step)."""
    if value["kind"] == "ref":
        links.append((path, value["id"]))
    elif value["kind"] == "list":
        items = [_settled(v, f"{path}/{i}", links, schema, units) for i, v in enumerate(value["items"])]
        return {"items": sorted(items, key=_canonical_text) if kind in ("set", "bag") else items, "kind": kind or "list"}
    elif value["kind"] == "simple":
        inner, unit = _settled(value["value"], path, links, schema, units), unit_type(value["type"])
        if unit and inner["kind"] in ("real", "int"):
            step = MEASURE_STEPS.get(unit, OTHER_MEASURE_STEP)
            inner = {"kind": "real", "value": f"{round(float(inner['value']) * units.get(unit, 1.0) / step) * step + 0.0:.17g}"}
        return {"kind": "simple", "type": schema.name(value["type"]), "value": inner}
    return value


def quantise(value: dict, name: str = "") -> dict:
    """A canonical value by the rules of signatures: reals as whole quanta, references without their id."""
    if value["kind"] == "ref":
        return {"kind": "ref"}
    if value["kind"] == "real":
        scale = DIRECTION_SCALE if name == "DirectionRatios" else REAL_SCALE
        return {"kind": "real_q", "value": round(float(value["value"]) * scale)}
    out = dict(value)
    if "items" in value:
        out["items"] = [quantise(v, name) for v in value["items"]]
    if isinstance(value.get("value"), dict):
        out["value"] = quantise(value["value"], name)
    return out


def unit_factors(records: dict[int, tuple[str, list[dict]]]) -> dict[str, float]:
    """Factor to SI of each type of unit, from the first unit assignment of the records step -> (keyword, values)."""

    def get(values: list[dict], i: int) -> dict:
        return values[i] if i < len(values) else {"kind": "null"}

    def factor(step: int, above: tuple = ()) -> float:
        if step not in records or step in above:
            return 1.0
        kind, values = records[step]
        if kind == "IFCSIUNIT":
            power = {"AREAUNIT": 2, "VOLUMEUNIT": 3}.get(get(values, 1).get("value"), 1)
            return SI_PREFIXES.get(get(values, 2).get("value"), 1.0) ** power
        if kind in ("IFCCONVERSIONBASEDUNIT", "IFCCONVERSIONBASEDUNITWITHOFFSET"):
            found = records.get(get(values, 3).get("id"))
            if not found:
                return 1.0
            amount = get(found[1], 0)
            amount = amount["value"] if amount["kind"] == "simple" else amount
            base = factor(get(found[1], 1).get("id"), (*above, step))
            return float(amount["value"]) * base if amount["kind"] in ("real", "int") else base
        if kind == "IFCDERIVEDUNIT":
            out = 1.0
            for item in get(values, 0).get("items", []):
                part = records.get(item.get("id"), ("", []))[1]
                out *= factor(get(part, 0).get("id"), (*above, step)) ** int(get(part, 1).get("value") or 0)
            return out
        return 1.0

    place = {"IFCSIUNIT": 1, "IFCCONVERSIONBASEDUNIT": 1, "IFCCONVERSIONBASEDUNITWITHOFFSET": 1, "IFCDERIVEDUNIT": 1}
    first = next((v for k, v in records.values() if k == "IFCUNITASSIGNMENT"), [])
    out = {}
    for item in get(first, 0).get("items", []):
        kind, values = records.get(item.get("id"), ("", []))
        name = get(values, place[kind]).get("value") if kind in place else None
        if name:
            found = factor(item["id"])
            if 0 < found < float("inf"):
                out[name] = found
    return dict(sorted(out.items()))


def parse_step(text: str, schema: Schema | None = None, quantised: bool = False) -> tuple[dict, Iterator[dict]]:
    """Header fields with the units, and the entities of a file in order. Only the schemas of ``SCHEMAS`` are read."""
    text = _COMMENT.sub(" ", text)
    tokens = _tokens(text)
    header: dict = {}
    for i, (kind, name) in enumerate(tokens):
        if kind == "name" and name in ("FILE_SCHEMA", "FILE_NAME") and i + 1 < len(tokens):
            header[name] = _value(tokens, i + 1)[0]["items"]
        if (kind, name) == ("name", "DATA"):
            break
    named = header["FILE_SCHEMA"][0]["items"][0]["value"] if "FILE_SCHEMA" in header else ""
    if not named.startswith(SCHEMAS):
        raise ValueError(f"Unsupported schema: {named}")
    stamp = header["FILE_NAME"][1].get("value") if len(header.get("FILE_NAME", [])) > 1 else None
    units = unit_factors({step: (kind, values) for step, kind, values in _records(tokens) if "UNIT" in kind or kind == "IFCMEASUREWITHUNIT"})
    return {"schema": named, "time_stamp": stamp, "units": units}, _entities(tokens, schema or core_schema(), units, quantised)


def _records(tokens: list[tuple[str, str]]) -> Iterator[tuple[int, str, list[dict]]]:
    """(step, keyword, values) of each record."""
    at = 0
    while at + 3 < len(tokens):
        if tokens[at][0] != "ref" or tokens[at + 1] != ("sign", "=") or tokens[at + 2][0] != "name":
            at += 1
            continue
        step, kind = int(tokens[at][1][1:]), tokens[at + 2][1].upper()
        value, at = _value(tokens, at + 3)
        yield step, kind, value["items"]


def _entities(tokens: list[tuple[str, str]], schema: Schema, units: dict[str, float], quantised: bool = False) -> Iterator[dict]:
    for order, (step, kind, values) in enumerate(_records(tokens)):
        known = schema.attributes(kind, values[0].get("value") if values and values[0]["kind"] == "string" else None)
        attributes, links = {}, []
        for i, v in enumerate(values):
            name, aggregate = known[i] if i < len(known) else (f"arg{i}", None)
            attributes[name] = _settled(v, f"/{name}", links, schema, units, aggregate)
            if quantised:
                attributes[name] = quantise(attributes[name], name)
        yield {
            "step_id": step, "ord": order, "entity_type": schema.name(kind), "global_id": attributes.get("GlobalId", {}).get("value"),
            "attributes": [(k, _canonical_text(v)) for k, v in attributes.items() if k != "GlobalId"],
            "refs": [{"ref_ord": i, "path": p, "target_step": t} for i, (p, t) in enumerate(links)],
        }


_ARROW = pa.schema([
    ("graph_id", pa.string()), ("step_id", pa.int64()), ("ord", pa.int64()), ("entity_type", pa.string()), ("global_id", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())),
    ("refs", pa.list_(pa.struct([("ref_ord", pa.int32()), ("path", pa.string()), ("target_step", pa.int64())]))), ("schema_name", pa.string()), ("time_stamp", pa.string()), ("units", pa.map_(pa.string(), pa.float64())),
])


def read_step(spark: SparkSession, path: str | list[str], schema: Schema | None = None, batch: int = 10_000, quantised: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entities and references of files; graph_id is the file's path. Every entity has the schema, time stamp and units of its file.

    ``quantised`` reads values by the rules of signatures (see :func:`quantise`).
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                header, entities = parse_step(content.decode("utf-8", "replace"), schema, quantised)
                same = {"graph_id": name, "schema_name": header["schema"], "time_stamp": header["time_stamp"], "units": [*header["units"].items()]}
                rows = []
                for e in entities:
                    rows.append(e | same)
                    if len(rows) == batch:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = stored(files.repartition(F.col("path")).mapInArrow(task, ENTITY_SCHEMA), "parsed")
    types = rows.select("graph_id", F.col("step_id").alias("target_step"), F.col("entity_type").alias("target_type"))
    links = rows.select("graph_id", F.col("step_id").alias("source_step"), F.inline("refs"))
    refs = links.join(types, ["graph_id", "target_step"], "left").select("graph_id", "source_step", "ref_ord", "path", "target_step", "target_type")
    return rows.drop("refs"), refs


@dataclass
class File:
    """One file as a graph, with the name of its schema, its time stamp and units."""

    graph: tuple[DataFrame, DataFrame]
    schema: str
    time_stamp: str | None
    units: dict[str, float]


def read_graph(spark: SparkSession, path: str, schema: Schema | None = None, quantised: bool = False) -> File:
    """A file as a graph whose id does not tell where the file lies."""
    entities, refs = read_step(spark, path, schema, quantised=quantised)
    first = entities.select("schema_name", "time_stamp", "units").first()
    entities, refs = (x.withColumn("graph_id", F.lit("file")) for x in (entities.drop("schema_name", "time_stamp", "units"), refs))
    return File((entities, refs), *((first.schema_name, first.time_stamp, first.units or {}) if first else ("", None, {})))


def unit_table(entities: DataFrame) -> DataFrame:
    """(graph_id, unit_type, factor) of the files that :func:`read_step` has read."""
    return entities.groupBy("graph_id").agg(F.first("units").alias("units")).select("graph_id", F.explode("units").alias("unit_type", "factor"))


def same_file(spark: SparkSession, a: str, b: str) -> bool:
    """Whether two paths are one path of one store."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    full = []
    for p in (a, b):
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        full.append(fs.resolvePath(path).toString() if fs.exists(path) else p)
    return full[0] == full[1]


def step_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, step_id, offset): the byte at which each entity's record begins; the first one of a number counts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out: dict[int, int] = {}
                for m in re.finditer(rb"#(\d+)\s*=", raw):
                    out.setdefault(int(m[1]), m.start())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(out)), pa.array([*out], pa.int64()), pa.array([*out.values()], pa.int64())], ["path", "step_id", "offset"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.repartition(F.col("path")).mapInArrow(task, "path string, step_id long, offset long")


def folder_products(spark: SparkSession, folder: str, schema: Schema | None = None, pattern: str = "*.ifc") -> DataFrame:
    """(path, step_id, entity_type, guid, name) of the products in the files of a folder: what overlaps of files are counted by."""
    kinds = [(t,) for t, above in (schema or core_schema()).closure() if above == "IfcProduct"]
    paths = [r.path for r in folder_files(spark, folder, pattern).select("path").collect()]
    if not paths:
        return spark.createDataFrame([], "path string, step_id long, entity_type string, guid string, name string")
    entities, _ = read_step(spark, paths, schema)
    rows = entities.join(F.broadcast(spark.createDataFrame(kinds, "entity_type string")), "entity_type", "left_semi")
    return rows.select(F.col("graph_id").alias("path"), "step_id", "entity_type", F.col("global_id").alias("guid"), F.get_json_object(F.col("attributes")["Name"], "$.value").alias("name"))


def folder_files(spark: SparkSession, folder: str, pattern: str = "*.ifc") -> DataFrame:
    """(path, length, modified) of the files of a folder, without their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
