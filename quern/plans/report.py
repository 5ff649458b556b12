"""Reports of a comparison for people. Only counts and the rows that are shown reach the driver."""

from __future__ import annotations

import json
import platform

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import __version__
from quern.operators.scenes import class_breakdown


def environment_fingerprint() -> str:
    """What a result may depend on, as canonical JSON."""
    return json.dumps({"python": platform.python_version(), "quern": __version__, "spark": pyspark.__version__}, sort_keys=True, separators=(",", ":"))


def stats_line(counts: dict[str, int]) -> str:
    """``+1 added, -2 deleted, ~3 changed, 4 unchanged``, without what did not occur."""
    parts = [f"{sign}{counts[k]} {k}" for k, sign in (("added", "+"), ("deleted", "-"), ("moved", ""), ("changed", "~")) if counts.get(k)]
    return ", ".join([*parts, f"{counts.get('unchanged', 0)} unchanged"])


def markdown_report(changes: DataFrame, markers: DataFrame, title: str, unchanged: int = 0, shown: int = 20) -> str:
    """Counts, the most common types of each operation, and the first changes, as Markdown."""
    names = {"ADD": "added", "REMOVE": "deleted", "MODIFY": "changed"}
    counts = {names.get(r.op, r.op.lower()): r.n for r in changes.groupBy("op").agg(F.count("*").alias("n")).collect()} | {"unchanged": unchanged}
    lines = [f"# {title}", "", stats_line(counts), ""]
    for op, name in names.items():
        rows = class_breakdown(changes.where(F.col("op") == op), "entity_type", 10).collect()
        if rows:
            lines += [f"## {name.capitalize()}", "", "| Type | Count |", "|---|---|", *(f"| {r.entity_type} | {r.n} |" for r in rows), ""]
    first = changes.orderBy("position").limit(shown).collect()
    if first:
        lines += ["## First changes", "", "| Change | Operation | Entity | Fields |", "|---|---|---|---|"]
        lines += [f"| {r.change_id} | {r.op} | {r.old_entity_id or r.new_entity_id} | {', '.join(f.path for f in r.field_ops[:3])} |" for r in first]
        lines.append("")
    moved = markers.orderBy("relation_type", "child_id").limit(shown).collect()
    if moved:
        lines += ["## Moved", "", *(f"- {m.child_id}: {m.old_parent_id} → {m.new_parent_id}" for m in moved), ""]
    return "\n".join(lines)


def scene_summary(elements: DataFrame, top: int = 5) -> list[str]:
    """One line for each storey with its most common categories; elements(storey, category)."""
    from pyspark.sql import Window as W

    counts = elements.groupBy("storey", "category").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("storey").orderBy(F.desc("n"), "category"))).where(F.col("rank") <= top)
    listed = ranked.groupBy("storey").agg(F.array_sort(F.collect_list(F.struct("rank", "category", "n"))).alias("c")).orderBy(F.col("storey").asc_nulls_first())
    return [f"{r.storey or '(none)'}: " + ", ".join(f"{x.n} {x.category}" for x in r.c) for r in listed.collect()]


def folder_report(pairs: list[tuple[str, str, str]], reports: list[str], title: str = "Versions") -> str:
    """Reports of the pairs (old, new, kind) of a folder as one text, with a list of them first."""
    lines = [f"# {title}", "", *(f"{i}. {old} to {new} ({kind})" for i, (old, new, kind) in enumerate(pairs, 1)), ""]
    for (old, new, _), text in zip(pairs, reports):
        lines += [f"## {old} to {new}", "", *(f"#{x}" if x.startswith("#") else x for x in text.split("\n")[1:])]
    return "\n".join(lines)


def change_summary(changes: DataFrame, shown: int = 10) -> list[str]:
    """Console lines: counts by operation, then the most common types of each."""
    counts = {r["op"]: r["n"] for r in changes.groupBy("op").agg(F.count("*").alias("n")).collect()}
    lines = [", ".join(f"{n} {op}" for op, n in sorted(counts.items())) or "no changes"]
    for op in sorted(counts):
        rows = class_breakdown(changes.where(F.col("op") == op), "entity_type", shown).collect()
        lines.append(f"{op}: " + ", ".join(f"{r.n} {r.entity_type}" for r in rows))
    return lines


def inspection(entities: DataFrame, top: int = 15) -> dict[str, list[tuple[str, int]]]:
    """The most common types of a graph, and of its relationships."""
    relation = F.col("entity_type").startswith("IfcRel")
    return {name: [(r.entity_type, r.n) for r in class_breakdown(entities.where(test), "entity_type", top).collect()] for name, test in (("types", ~relation), ("relations", relation))}
