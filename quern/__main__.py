"""``python -m quern OLD NEW``: what changed between two STEP files, on standard output."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from quern.functions.ship import ship
from quern.operators.signatures import RADIUS_M
from quern.plans.diff import diff_files
from quern.plans.model import model_diff_files, section_lines
from quern.plans.report import change_summary, markdown_report
from quern.sources.schema import express_schema
from quern.streaming import feed


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quern", description=__doc__)
    parser.add_argument("old")
    parser.add_argument("new")
    parser.add_argument("--engine", choices=("graph", "model"), default="graph", help="compare graphs, or the signatures of products")
    parser.add_argument("--stream", choices=("none", "ndjson", "chunked_json"), default="none")
    parser.add_argument("--chunk-size", type=int, default=1000)
    parser.add_argument("--matcher-radius-m", type=float, default=RADIUS_M, help="engine model: how far a product may have moved")
    parser.add_argument("--profile", choices=("semantic_stable", "raw_exact"), default="semantic_stable")
    parser.add_argument("--guid-policy", choices=("fail_fast", "disambiguate"), default="fail_fast")
    parser.add_argument("--geometry-policy", choices=("strict_syntax", "invariant_probe"), default="strict_syntax")
    parser.add_argument("--schema", help="EXPRESS text of the files' schema")
    parser.add_argument("--report", choices=("summary", "markdown"), default="summary", help="form of the result without --stream")
    parser.add_argument("--timings", action="store_true")
    args = parser.parse_args(argv)
    try:
        schema = express_schema(open(args.schema).read()) if args.schema else None
        spark = SparkSession.builder.appName("quern").getOrCreate()
        ship(spark)
        if args.engine == "model":
            report, diagnostics = model_diff_files(spark, args.old, args.new, args.matcher_radius_m, schema)
            if args.stream == "none":
                print(json.dumps(diagnostics, sort_keys=True))
                return 0
            lines = section_lines(report)
            if args.stream == "chunked_json":
                lines = feed.chunks(lines, "position", lines["value"], args.chunk_size, clamp=True).selectExpr("offset AS position", "to_json(struct(offset, count, items)) AS value")
            for row in lines.orderBy("position").select("value").toLocalIterator():
                print(row.value)
            return 0
        found = diff_files(spark, args.old, args.new, schema=schema, profile=args.profile, guid_policy=args.guid_policy, geometry_policy=args.geometry_policy, snapshots=args.stream == "none")
        if args.stream == "none":
            print(markdown_report(found.changes, found.markers, f"{args.old} to {args.new}") if args.report == "markdown" else "\n".join(change_summary(found.changes)))
        else:
            for row in feed.replay(found, args.stream, args.chunk_size).orderBy("rank", "position").select("value").toLocalIterator():
                print(row.value)
        if args.timings:
            print(json.dumps(found.timings, sort_keys=True), file=sys.stderr)
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
