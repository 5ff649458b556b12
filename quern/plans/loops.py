"""Iteration without growing plans: every round is written as a table in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may do without, and then gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/quern-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``position`` from 1 in the given order, numbered within ranges.

    Rows are dealt to tasks by sampled ranges of the order, counted and sorted
    there; no task sorts more than its range, however ids are spelled, and
    only the number of rows of each range reaches the driver.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id that Spark gives a row: the task in the upper bits, the place within it in the lower 33.
    ranged = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    counts = ranged.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n")).collect()
    before, total = [], 0
    for r in sorted(counts, key=lambda r: r["_range"]):
        before.append((r["_range"], total))
        total += r["_n"]
    starts = F.broadcast(spark.createDataFrame(before, "_range long, _before long"))
    out = ranged.withColumn("_range", F.shiftright("_at", 33)).join(starts, "_range")
    return out.select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("position"))


def least_reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, least): the least node reached from each node along directed edges (a, b), itself included.

    Each round takes the least label over edges and then that label's own
    label, which is reached too, until no label changes.
    """
    state = stored(nodes.select("node", F.col("node").alias("least")), "least")
    while True:
        offers = edges.join(state.select(F.col("node").alias("b"), "least"), "b").groupBy("a").agg(F.min("least").alias("offer"))
        moved = state.join(offers, state["node"] == offers["a"], "left").select("node", "least", F.least("least", "offer").alias("to"))
        jump = state.select(F.col("node").alias("to"), F.col("least").alias("further"))
        moved = moved.join(jump, "to", "left").select("node", F.least("to", "further").alias("least"), (F.least("to", "further") < F.col("least")).alias("changed"))
        moved = stored(moved, "least")
        state = moved.select("node", "least")
        if moved.where("changed").isEmpty():
            return state


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for nodes with edges (a, b), followed both ways; component is the least node.

    Each round takes the least label of neighbours and then that label's own label, so paths halve.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").where("a <> b").distinct(), "edges")
    state = stored(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while True:
        offers = both.join(state.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("offer"))
        moved = state.join(offers, state["node"] == offers["a"]).select("node", "component", F.least("component", "offer").alias("to"))
        jump = state.select(F.col("node").alias("to"), F.col("component").alias("further"))
        moved = stored(moved.join(jump, "to", "left").select("node", F.least("to", "further").alias("component"), (F.least("to", "further") < F.col("component")).alias("changed")), "labels")
        state = moved.select("node", "component")
        if moved.where("changed").isEmpty():
            return state
