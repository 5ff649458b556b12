"""The change feed as lines: NDJSON events and chunks, as batch tables and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.loops import placed

_JSON = {"ignoreNullFields": "false"}


def event_lines(kind: str, rows: DataFrame, position: str, payload: Column) -> DataFrame:
    """(section, position, value): one JSON line for each row, its index from 0 in order of ``position``."""
    body = F.to_json(F.struct(F.lit(kind).alias("event"), (F.col(position) - 1).alias("index"), payload.alias("data")), _JSON)
    return rows.select(F.lit(kind).alias("section"), F.col(position).alias("position"), body.alias("value"))


def header_line(spark: SparkSession, **fields: str) -> DataFrame:
    columns = [F.lit(v).alias(k) for k, v in fields.items()]
    return spark.range(1).select(F.lit("header").alias("section"), F.lit(0).cast("long").alias("position"), F.to_json(F.struct(F.lit("header").alias("event"), *columns)).alias("value"))


def end_line(changes: DataFrame) -> DataFrame:
    """The closing event with the operations and their counts, by name."""
    counts = changes.groupBy("op").agg(F.count("*").alias("n"))
    text = F.concat(F.lit('{"event":"end","op_counts":{'), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "op", F.lit('":'), F.col("n").cast("string")))), ","), F.lit("}}"))
    return counts.agg(text.alias("value")).select(F.lit("end").alias("section"), F.lit(0).cast("long").alias("position"), "value")


def ndjson(changes: DataFrame, markers: DataFrame, change: Column, marker: Column, **header: str) -> DataFrame:
    """All lines of a feed; in file order by (section rank, position) where one file is wanted."""
    parts = header_line(changes.sparkSession, **header), event_lines("base_change", changes, "position", change), event_lines("derived_marker", markers, "position", marker), end_line(changes)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.create_map(*(F.lit(x) for kv in (("header", 0), ("base_change", 1), ("derived_marker", 2), ("end", 3)) for x in kv))
    return out.withColumn("rank", rank[F.col("section")])


def serialized(rows: DataFrame, id_col: str, record: Column) -> DataFrame:
    """(position, record): text records in order of tier (G, H, C, other) and id."""
    tier = F.when(F.col(id_col).startswith("G:"), 0).when(F.col(id_col).startswith("H:"), 1).when(F.col(id_col).startswith("C:"), 2).otherwise(3)
    keyed = rows.select(tier.alias("tier"), F.col(id_col).alias("id"), record.alias("record"))
    return placed(keyed, "tier", "id", "record").select("position", "record")


def sections(report: DataFrame, item: Column) -> DataFrame:
    """(section, position, value) of a signature report: added, deleted, modified, unchanged, each in order of class and steps; positions run through all."""
    rank = F.create_map(*(F.lit(x) for kv in (("added", 0), ("deleted", 1), ("modified", 2), ("unchanged", 3)) for x in kv))[F.col("section")]
    rows = report.select(rank.alias("rank"), "section", "canonical_class", "old_step", "new_step", F.to_json(item, _JSON).alias("value"))
    return placed(rows, "rank", "canonical_class", "old_step", "new_step").select("section", "position", "value")


def chunks(rows: DataFrame, position: str, item: Column, chunk_size: int = 1000, clamp: bool = False) -> DataFrame:
    """(offset, count, items): JSON arrays of ``chunk_size`` rows in order of ``position`` (from 1).

    A size that is not positive is an error, or 1 with ``clamp``.
    """
    if chunk_size <= 0:
        if not clamp:
            raise ValueError("chunk_size must be positive")
        chunk_size = 1
    number = F.floor((F.col(position) - 1) / chunk_size)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), item.alias("v")))), lambda x: x["v"])
    grouped = rows.groupBy(number.alias("chunk")).agg(F.count("*").alias("count"), listed.alias("items"))
    return grouped.select((F.col("chunk") * chunk_size).alias("offset"), "count", F.concat(F.lit("["), F.array_join("items", ","), F.lit("]")).alias("items"))


def change_payload() -> Column:
    """What a line says of a change; snapshots are left out of streams."""
    found = F.struct(F.col("stability_tier"), F.col("match_method"), F.col("match_confidence"))
    owners = F.struct(F.col("owner_sample").alias("sample"), F.col("owner_total").alias("total"))
    classes = F.when(F.col("class_id").isNotNull(), F.struct(F.col("class_id").alias("id"), "old_count", "new_count"))
    return F.struct("change_id", "op", "old_entity_id", "new_entity_id", found.alias("identity"), "field_ops", owners.alias("rooted_owners"), "change_categories", classes.alias("equivalence_class"))


def replay(found, mode: str = "ndjson", chunk_size: int = 1000) -> DataFrame:
    """A finished comparison as lines (rank, position, value): header, changes, markers and the end; or header and chunks of either kind."""
    if mode not in ("ndjson", "chunked_json"):
        raise ValueError(f"Unknown stream mode: {mode}")
    if chunk_size <= 0:
        raise ValueError("chunk_size must be positive")
    from quern.plans.diff import header_json

    spark = found.changes.sparkSession
    head = spark.createDataFrame([(0, 0, '{"event":"header","header":' + header_json(found) + "}")], "rank int, position long, value string")
    order = [c for c in ("relation_type", "child_id") if c in found.markers.columns]
    markers = placed(found.markers, *order)
    marker = F.struct(*found.markers.columns)
    if mode == "ndjson":
        parts = [event_lines("base_change", found.changes, "position", change_payload()), event_lines("derived_marker", markers, "position", marker), end_line(found.changes)]
    else:
        parts = []
        for kind, rows, item in (("base_changes", found.changes, change_payload()), ("derived_markers", markers, marker)):
            listed = chunks(rows, "position", F.to_json(item, _JSON), chunk_size)
            text = F.concat(F.lit(f'{{"event":"{kind}","offset":'), F.col("offset").cast("string"), F.lit(',"count":'), F.col("count").cast("string"), F.lit(',"items":'), "items", F.lit("}"))
            parts.append(listed.select(F.lit(kind).alias("section"), (F.col("offset") + 1).cast("long").alias("position"), text.alias("value")))
        parts.append(end_line(found.changes))
    out = head
    for rank, part in enumerate(parts, 1):
        out = out.unionByName(part.select(F.lit(rank).alias("rank"), F.col("position").cast("long").alias("position"), "value"))
    return out


def write_lines(lines: DataFrame, path: str) -> None:
    """The feed as text files; range-partitioned by place, so files in name order are the feed in order."""
    lines.repartitionByRange("rank", "position").sortWithinPartitions("rank", "position").select("value").write.text(path)


def follow(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str):
    """Append new change files of a folder to a Parquet table of op counts for each batch; ends when all are read."""
    stream = spark.readStream.schema(schema).json(folder)

    def batch(rows: DataFrame, number: int) -> None:
        counts = rows.groupBy("op").agg(F.count("*").alias("n"))
        counts.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
