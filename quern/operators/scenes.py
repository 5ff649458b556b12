"""Spatial structure, hosting, labels, and files that belong together."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.runs import whole_groups
from quern.plans.loops import connected, stored

#: Least overlap of identifiers, and of contents, of files of one group; least distance of a neighbour in mm.
GUID_OVERLAP, CONTENT_OVERLAP, LEAST_MM = 0.5, 0.6, 100.0


def hosting(voids: DataFrame, fills: DataFrame) -> DataFrame:
    """(filler, host) over openings: voids(ord, host, opening), fills(ord, opening, filler); the last void of an opening counts."""
    walls = voids.groupBy("opening").agg(F.max_by("host", "ord").alias("host"))
    return fills.join(walls, "opening").groupBy("filler").agg(F.max_by("host", "ord").alias("host"))


def storeys_of(contained: DataFrame, parts: DataFrame) -> DataFrame:
    """(element, storey): by containment, else through the whole that an element is part of, at any depth.

    contained(element, storey), parts(whole, part). It ends when a round adds nothing.
    """
    found = front = stored(contained.groupBy("element").agg(F.min("storey").alias("storey")), "storeys")
    while True:
        through = parts.join(front.withColumnRenamed("element", "whole"), "whole").groupBy(F.col("part").alias("element")).agg(F.min("storey").alias("storey"))
        front = stored(through.join(found.select("element"), "element", "left_anti"), "storeys")
        if front.isEmpty():
            return found
        found = found.union(front)


def nearest_named(points: DataFrame, named: DataFrame, least_mm: float = LEAST_MM, region_names: int = 2048) -> DataFrame:
    """(id, name) of the nearest of ``named(name, ord, x, y, z)`` at least ``least_mm`` from each of ``points(id, x, y, z)``.

    Space is cut into regions of about ``region_names`` places of names,
    however densely they lie. A point is first held against the names of its
    own region; what it finds there, or the far corner of a region that lies
    far enough off, bounds its distance, and only regions that reach into
    that distance and out of ``least_mm`` are searched after that. Ties go to
    the first name in order. Places that repeat are searched once; points and
    names without a coordinate meet nothing.
    """
    place = list("xyz")
    names = named.where("name IS NOT NULL AND name <> ''").where(~F.col("name").rlike("^.+#[0-9]+$")).dropna(subset=place)
    names = stored(names.groupBy(place).agg(F.min(F.struct("ord", "name")).alias("n")).select(*place, "n.ord", "n.name"), "names")
    spots = points.select(place).dropna().distinct()
    total = names.count()
    # Where to cut is read off some places; it moves work between tasks and changes no result.
    every = max(1, total // 100_000)
    some = names.select(place).where(F.pmod(F.xxhash64(*place), F.lit(every)) == 0).toArrow()
    regions = Regions.cut(np.column_stack([some[c].to_numpy() for c in place]).reshape(-1, 3), math.ceil(total / region_names), least_mm)
    names = stored(names.mapInArrow(regions.own_task, T.StructType([*names.schema.fields, T.StructField("region", T.LongType())])), "named_regions")
    ends = names.where("region >= 0").groupBy("region").agg(*(f(c) for f in (F.min, F.max) for c in place)).collect()
    regions = regions.with_boxes(np.array([r[0] for r in ends], np.int64), np.array([r[1:] for r in ends], float).reshape(-1, 2, 3), not names.where("region < 0").isEmpty())

    first = spots.mapInArrow(regions.own_task, "x double, y double, z double, region long").withColumn("bound", F.lit(None).cast("double"))
    own = stored(_searched(first, names, least_mm), "nearest")
    further = own.select(*place, "away").mapInArrow(regions.further_task, "x double, y double, z double, region long, bound double")
    found = own.where("ord IS NOT NULL OR name IS NOT NULL").union(_searched(further, names, least_mm).where("ord IS NOT NULL OR name IS NOT NULL"))
    best = stored(found.groupBy(place).agg(F.min(F.struct("away", "ord", "name")).alias("best")), "best")
    return points.select("id", *place).join(best, place).groupBy("id").agg(F.min("best").alias("best")).select("id", F.col("best.name").alias("name"))


def _searched(asked: DataFrame, names: DataFrame, least_mm: float, chunk: int = 16_384) -> DataFrame:
    """(x, y, z, away, ord, name) of asked(x, y, z, region, bound): the first name of the region, null if there is none within the bound.

    The asked of a region are dealt into chunks, each with all its names.
    """
    asked = stored(asked, "asked")
    chunks = asked.groupBy("region").agg(F.ceil(F.count("*") / chunk).cast("long").alias("chunks"))
    chunks = stored(chunks, "chunks")
    no_name = [F.lit(None).cast(names.schema[c].dataType).alias(c) for c in ("ord", "name")]
    asked = asked.join(chunks, "region").select("region", F.pmod(F.xxhash64("x", "y", "z"), F.col("chunks")).alias("chunk"), F.lit(1).alias("asks"), "x", "y", "z", "bound", *no_name)
    told = names.join(chunks, "region").select("region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("asks"), "x", "y", "z", F.lit(None).cast("double").alias("bound"), "ord", "name")
    rows = asked.union(told).repartition("region", "chunk").sortWithinPartitions("region", "chunk", "asks", "ord", "name")
    return rows.mapInArrow(_nearest_task(least_mm), T.StructType([*(T.StructField(c, T.DoubleType()) for c in ("x", "y", "z", "away")), names.schema["ord"], names.schema["name"]]))


def _nearest_task(least: float, at_once: int = 1 << 18):
    """Task over rows (region, chunk, asks, x, y, z, bound, ord, name) sorted so that names come before what asks, in order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["region", "chunk"]):
            asks = table["asks"].to_numpy() == 1
            at = np.column_stack([table[c].to_numpy() for c in "xyz"])
            bound = table["bound"].to_numpy()
            away, pick = np.full(len(at), np.nan), np.full(len(at), -1)
            for lo, hi in zip(starts, [*starts[1:], len(at)]):
                mid = lo + int((~asks[lo:hi]).sum())
                step = max(1, at_once // max(1, mid - lo))
                for q in range(mid, hi if mid > lo else mid, step):
                    away[q : min(q + step, hi)], pick[q : min(q + step, hi)] = _nearest(at[q : min(q + step, hi)], at[lo:mid], least)
                pick[mid:hi] += np.where(pick[mid:hi] >= 0, lo, 0)
            pick[away > bound] = -1
            found = np.flatnonzero(asks)
            chosen = pa.array(pick[found], mask=pick[found] < 0)
            none = pa.array(np.where(pick[found] < 0, 0.0, away[found]), mask=pick[found] < 0)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in at[found].T.copy()), none, *(table[c].take(chosen).combine_chunks() for c in ("ord", "name"))], ["x", "y", "z", "away", "ord", "name"])

    return task


def _nearest(at: np.ndarray, names: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Distance and index of the first nearest name for each row, -1 if there is none; distances that are not a number come last."""
    with np.errstate(invalid="ignore", over="ignore"):
        x, y, z = (at[:, None, k] - names[None, :, k] for k in range(3))
        d = np.sqrt(x * x + y * y + z * z)
        far = ~(d < least)
        key = np.where(far & ~np.isnan(d), d, np.inf)
    pick = key.argmin(1)
    away = d[np.arange(len(at)), pick]
    for i in np.flatnonzero(np.isinf(key[np.arange(len(at)), pick])):
        some = np.flatnonzero(far[i])
        some = some[np.lexsort((some, d[i, some]))]
        pick[i], away[i] = (some[0], d[i, some[0]]) if len(some) else (-1, np.nan)
    return away, pick


@dataclass(frozen=True)
class Regions:
    """Boxes that a tree of cuts makes, each across the widest side; places that are not finite are in region -1."""

    axes: np.ndarray
    cuts: np.ndarray
    depth: int
    least: float
    ids: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    others: bool = False

    @classmethod
    def cut(cls, places: np.ndarray, count: int, least: float) -> Regions:
        depth = max(0, math.ceil(math.log2(max(1, count))))
        nodes = (1 << depth) - 1
        axes, cuts = np.zeros(nodes, np.int64), np.zeros(nodes)
        held = {0: places[np.isfinite(places).all(1)]}
        for node in range(nodes):
            here = held.pop(node)
            if len(here):
                axes[node] = np.argmax(here.max(0) - here.min(0))
                values = np.sort(here[:, axes[node]])
                above = values[values > values[0]]
                cuts[node] = max(values[len(values) // 2], above[0] if len(above) else values[0])
            right = here[:, axes[node]] >= cuts[node]
            held[2 * node + 1], held[2 * node + 2] = here[~right], here[right]
        return cls(axes, cuts, depth, least)

    def with_boxes(self, ids: np.ndarray, boxes: np.ndarray, others: bool) -> Regions:
        """With the box that holds the names of each region that has any, and whether names are in region -1."""
        return replace(self, ids=ids, low=boxes[:, 0], high=boxes[:, 1], others=others)

    def own(self, places: np.ndarray) -> np.ndarray:
        at = np.zeros(len(places), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (places[np.arange(len(places)), self.axes[at]] >= self.cuts[at])
        return np.where(np.isfinite(places).all(1), at - ((1 << self.depth) - 1), -1)

    def further(self, places: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, region, bound) of the regions besides its own that may hold something as near for each row; away is NaN where nothing is found."""
        own, finite = self.own(places), np.isfinite(places).all(1)
        with np.errstate(invalid="ignore", over="ignore"):
            p = places[:, None, :]
            near = np.sqrt((np.maximum(0, np.maximum(self.low - p, p - self.high)) ** 2).sum(2))
            far = np.sqrt((np.maximum(np.abs(p - self.low), np.abs(p - self.high)) ** 2).sum(2))
            # Room for rounding, so that no region at the very bound is passed over.
            bound = np.where(near * (1 - 1e-9) >= self.least, far, np.inf).min(1, initial=np.inf) * (1 + 1e-9)
            bound = np.where(finite, np.fmin(bound, away), np.inf)
            visit = (near * (1 - 1e-9) <= bound[:, None]) & (far * (1 + 1e-9) >= self.least) | ~finite[:, None]
        row, k = np.nonzero(visit & (self.ids != own[:, None]))
        region = self.ids[k]
        if self.others:
            lost = np.flatnonzero(np.isinf(bound) & (own != -1))
            row, region = np.r_[row, lost], np.r_[region, np.full(len(lost), -1)]
        return row, region, np.where(np.isinf(bound), np.nan, bound)[row]

    def own_task(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = np.column_stack([b[c].to_numpy() for c in "xyz"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(self.own(places))], [*b.schema.names, "region"])

    def further_task(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 18) // max(1, len(self.ids)))
        for b in batches:
            places = np.column_stack([b[c].to_numpy() for c in "xyz"])
            away = b["away"].to_numpy(zero_copy_only=False).astype(float)
            for lo in range(0, b.num_rows, step):
                row, region, bound = self.further(places[lo : lo + step], away[lo : lo + step])
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in places[lo + row].T.copy()), pa.array(region), pa.array(bound, mask=np.isnan(bound))], ["x", "y", "z", "region", "bound"])


def file_overlaps(items: DataFrame) -> DataFrame:
    """(a, b, shared, jaccard, multiset) for files a < b that share an item; items(file, item), repeats counted.

    Only files that share something meet, by item.
    """
    counts = items.groupBy("file", "item").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("file").agg(F.count("*").alias("k"), F.sum("c").alias("t"))
    left, right = counts.select(F.col("file").alias("a"), "item", F.col("c").alias("ca")), counts.select(F.col("file").alias("b"), "item", F.col("c").alias("cb"))
    met = left.join(right, "item").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum(F.least("ca", "cb")).alias("both"))
    met = met.join(sizes.select(F.col("file").alias("a"), F.col("k").alias("ka"), F.col("t").alias("ta")), "a").join(sizes.select(F.col("file").alias("b"), F.col("k").alias("kb"), F.col("t").alias("tb")), "b")
    return met.select("a", "b", "shared", (F.col("shared") / (F.col("ka") + F.col("kb") - F.col("shared"))).alias("jaccard"), (F.col("both") / (F.col("ta") + F.col("tb") - F.col("both"))).alias("multiset"))


def file_groups(overlaps: DataFrame, least: float = GUID_OVERLAP, contents: DataFrame | None = None, least_content: float = CONTENT_OVERLAP) -> DataFrame:
    """(node, component) of files joined by an overlap of identifiers of at least ``least``.

    With ``contents``, overlaps of what the files hold, files that no
    identifiers join are joined by a multiset overlap of ``least_content``.
    """
    found = connected(overlaps.where(F.col("jaccard") >= least).select("a", "b"))
    if contents is None:
        return found
    alone = contents.where(F.col("multiset") >= least_content)
    for c in ("a", "b"):
        alone = alone.join(found.select(F.col("node").alias(c)), c, "left_anti")
    return found.union(connected(alone.select("a", "b")))


def version_pairs(files: DataFrame) -> DataFrame:
    """Consecutive versions of each group by time, and first to last where there are three or more.

    files(group, file, at); output (group, old_file, new_file, kind).
    """
    order = W.partitionBy("group").orderBy("at", "file")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = files.select("group", "file", F.lead("file").over(order).alias("next"), F.first("file").over(whole).alias("first"), F.last("file").over(whole).alias("last"), F.count("*").over(W.partitionBy("group")).alias("n"))
    steps = rows.where("next IS NOT NULL").select("group", F.col("file").alias("old_file"), F.col("next").alias("new_file"), F.lit("step").alias("kind"))
    total = rows.where("n >= 3 AND file = first").select("group", F.col("first").alias("old_file"), F.col("last").alias("new_file"), F.lit("cumulative").alias("kind"))
    return steps.union(total)


def class_breakdown(rows: DataFrame, by: str, top: int = 10) -> DataFrame:
    """(by, n) of the ``top`` most common values; ties in order of the value."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(top)


def latest_labels(labels: DataFrame) -> DataFrame:
    """(id, label): of labels(id, version, label) the one of the last version."""
    return labels.groupBy("id").agg(F.max_by("label", "version").alias("label"))


def precision_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row precision, recall, f1 of pairs (old_step, new_step); two empty sides are perfect."""
    keys = ["old_step", "new_step"]
    hits = found.join(truth, keys, "left_semi").agg(F.count("*").alias("tp"))
    sums = hits.crossJoin(found.agg(F.count("*").alias("f"))).crossJoin(truth.agg(F.count("*").alias("t")))
    p, r = F.when(F.col("f") == 0, 1.0).otherwise(F.col("tp") / F.col("f")), F.when(F.col("t") == 0, 1.0).otherwise(F.col("tp") / F.col("t"))
    return sums.select(p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"))


def timing_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, runs, min, max, mean, median, p95) of a measure; percentiles are interpolated."""
    v = F.col(value)
    return rows.groupBy(by).agg(F.count(v).alias("runs"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.95)).alias("p95"))


def group_label(names: list[str]) -> str:
    """What the file names of a group begin with, without a version suffix or separators at the end."""
    import os
    import re

    common = os.path.commonprefix([os.path.splitext(n)[0] for n in names])
    return re.sub(r"[-_ .]*(v(er(sion)?)?)?[-_ .]*$", "", common, flags=re.I) or (names[0] if names else "")
