"""Embedding near-duplicates by collision counts over sorted one-dimensional projections.

Every vector is scaled to length one and projected on many orthonormal random
directions. In each projection the values are sorted, and a query collides
with what lies in the window centred on it. A pair at the least cosine would
collide in a binomial number of projections; pairs with at least the count
that all but a thousandth of such pairs reach are verified by cosine in
double precision, others are not. The first projections have a count of their
own, so most pairs are done after a few of them.

Windows of one projection hold a fixed share of all vectors, so counting over
the whole table would be quadratic. Vectors first meet at the ends of other
sorted projections: out of a group of projections a vector goes to the end,
low or high, at which it lies furthest out, and a block is one end of each of
a few groups. :func:`_plan` chooses their number and size for the number of
distinct vectors, and as many bands of blocks as a pair at the least cosine
needs to share a block with the wanted recall; the chance of a shared end is
simulated. The copies of a vector that are shuffled grow with the logarithm of
the table (9 at 51,000 vectors of 64 dimensions, 19 at 10 ** 6, 52 at 10 ** 9).

A pair counts only in the first band in which it shares a block, so links are
counted where they are found and pairs are not shuffled. A block of more than
``block`` vectors is split into chunks, every pair of chunks being a task.
Equal vectors are one node with a multiplicity from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._components import components
from quern.llm._runs import spanning, whole_groups
from quern.llm._store import hinted, lean_memory, small_batches, stored

#: Projections counted over, and how many of them are looked at first.
_COUNTED, _FIRST = 64, 16
#: Chance that a pair at the least cosine falls short of the collision counts.
_LOST = 1e-3
#: Microseconds that a row costs to shuffle, a block to begin, a pair to count; they only choose between plans.
_ROW_COST, _BLOCK_COST, _PAIR_COST = 15.0, 1000.0, 0.05


def _nodes(kind: str):
    """Task that gives each vector two hashes and its bytes, or nulls where it is null, zero, or holds a null or non-finite value."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for b in batches:
            raw = []
            for v in b.column(1):
                x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0
                raw.append(x.tobytes() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
            hashes = [(None, None) if r is None else divmod(xxhash.xxh3_128_intdigest(r), 1 << 64) for r in raw]
            h1, h2 = ([None if h is None else h - (1 << 63) for h in hs] for hs in (zip(*hashes) if hashes else ((), ())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(raw, pa.binary())], ["id", "h1", "h2", "vec"])

    return task


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@lru_cache(16)
def _directions(dim: int, n: int, seed: int) -> np.ndarray:
    """``n`` directions (dim, n): as many orthonormal ones as there are dimensions, then others again."""
    rng = np.random.default_rng([seed, dim])
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(max(1, -(-n // dim)))], 1)[:, :n]


@lru_cache(256)
def _shared_end(dim: int, group: int, cosine: float) -> float:
    """Chance that two vectors at the cosine lie furthest out at the same end of ``group`` orthonormal projections."""
    rng = np.random.default_rng([3, dim, group])
    x, y = rng.normal(size=(2, max(256, (1 << 20) // dim), dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine**2) * y / np.maximum(1e-12, np.linalg.norm(y, axis=1, keepdims=True))
    same = [(_ends(x[:, k : k + group]) == _ends(y[:, k : k + group])).mean() for k in range(0, dim - group + 1, group)]
    return max(0.01, float(np.mean(same)) - 0.005 - (len(same) * len(x)) ** -0.5)  # less two deviations of the estimate


def _ends(values: np.ndarray) -> np.ndarray:
    """The end at which each row lies furthest out: twice the column, and one more at the low end."""
    at = np.abs(values).argmax(1)
    return 2 * at + (values[np.arange(len(values)), at] < 0)


@lru_cache(4096)
def _plan(n: int, cosine: float, dim: int, recall: float) -> tuple[int, int, int]:
    """Groups in a block's key, projections in a group and number of bands, for ``n`` vectors of ``dim`` dimensions."""
    best = (1 * (_ROW_COST + _BLOCK_COST / n + n / 2 * _PAIR_COST), 0, 1, 1)
    groups = {max(1, dim >> k) for k in range(dim.bit_length())}
    for group in sorted(groups):
        p = _shared_end(dim, group, cosine)
        for deep in range(1, 2 + math.ceil(math.log2(max(2, n)))):
            size = max(1.0, n / (2.0 * group) ** deep)
            bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(p**deep))))
            best = min(best, (bands * (_ROW_COST + _BLOCK_COST / size + size / 2 * _PAIR_COST), deep, group, bands))
            if size == 1:
                break
    return best[1:]


def _least(m: int, lost: float) -> int:
    """The count of collisions in ``m`` projections that all but ``lost`` of the pairs at the least cosine reach."""
    p = math.erf(1.8 / math.sqrt(2))
    tail, least = 0.0, 0
    for c in range(m + 1):
        tail += math.comb(m, c) * p**c * (1 - p) ** (m - c)
        if tail > lost:
            break
        least = c + 1
    return least


def _window(cosine: float, dim: int) -> tuple[int, int, float, int, int]:
    """Projections to count over first and in all, half-width of the window, least count of each."""
    m = min(_COUNTED, dim)
    first = min(_FIRST, m)
    return first, m, 1.8 * math.sqrt(2 * (1 - cosine) / dim), _least(first, _LOST / 2), _least(m, _LOST / 2)


def _band_keys(cosine: float, recall: float, kind: str, seed: int):
    """Task that adds the keys of a vector's bands to (node, size, vec, length, n)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for b in batches:
            raw, n = b.column(2).to_pylist(), b.column(4).to_pylist()
            keys: list = [None] * len(raw)
            for length, many in {(len(r), k) for r, k in zip(raw, n)}:
                own = [i for i, r in enumerate(raw) if len(r) == length]
                x = _unit([raw[i] for i in own], kind)
                deep, group, bands = _plan(many, cosine, x.shape[1], recall)
                key = np.zeros((len(own), bands), np.int64)
                if deep:
                    values = x @ _directions(x.shape[1], bands * deep * group, seed + 1)
                    for k in range(bands * deep):
                        key[:, k // deep] = key[:, k // deep] * 2 * group + _ends(values[:, k * group : (k + 1) * group])
                for i, k in zip(own, key):
                    keys[i] = k
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64())
            held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], held], ["node", "size", "vec", "length", "keys"])

    return task


def _collisions(asked: np.ndarray, held: np.ndarray, half: float) -> np.ndarray:
    """For each pair (asked, held) in how many columns held lies in the window centred on asked."""
    counts = np.zeros((len(asked), len(held)), np.uint8)
    kind = np.uint8 if len(held) < 256 else np.uint16 if len(held) < 65_536 else np.uint32
    for a, h in zip(asked.T, held.T):
        order = np.argsort(h)
        rank = np.empty(len(h), kind)
        rank[order] = np.arange(len(h))
        lo = np.searchsorted(h[order], a - half, "left").astype(kind)
        hi = np.searchsorted(h[order], a + half, "right").astype(kind)
        counts += (rank[None] - lo[:, None]) < (hi - lo)[:, None]
    return counts


def _pairs_of(x: np.ndarray, asks: int, keys: np.ndarray, cosine: float, seed: int, at_once: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (i, j) of one block that share none of the earlier ``keys``: the last ``asks`` rows with the others, or all with all."""
    first, m, half, least_first, least = _window(cosine, x.shape[1])
    p = (x @ _directions(x.shape[1], m, seed)).astype(np.float32)
    held = len(x) - asks
    for s in range(held if asks else 0, len(x), at_once):
        e = min(s + at_once, len(x))
        base = 0 if asks else s
        i, j = np.nonzero(_collisions(p[s:e, :first], p[base : held if asks else len(x), :first], half) >= least_first)
        i, j = i + s, j + base
        if not asks:
            i, j = i[j > i], j[j > i]
        for k in range(0, len(i), 1 << 15):
            a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            fresh = ~(keys[a] == keys[b]).any(1)
            a, b = a[fresh], b[fresh]
            close = (np.abs(p[a] - p[b]) <= half).sum(1) >= least
            a, b = a[close], b[close]
            near = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
            if near.any():
                yield a[near], b[near]


def _block_links(cosine: float, kind: str, seed: int):
    """Task over rows of blocks sorted by (length, band, key, tree, part, role): role 0 is searched, role 1 asks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for table, starts in whole_groups(batches, ["length", "band", "key", "tree", "part"], 8192):
            node, size, role = (table[c].to_numpy() for c in ("node", "size", "role"))
            bounds = [*starts, len(node)]
            out: list[tuple] = []
            for s, e in zip(bounds, bounds[1:]):
                asks = int(role[s:e].sum())
                if e - s < 2 or asks == e - s:
                    continue
                lists = table["earlier"].slice(s, e - s).combine_chunks()
                keys = lists.flatten().to_numpy().reshape(e - s, -1)
                x = _unit(table["vec"].slice(s, e - s).to_pylist(), kind)
                label, n = None, np.zeros(e - s, np.int64)
                for a, b in _pairs_of(x, asks, keys, cosine, seed):
                    n += np.bincount(a, size[s:e][b], e - s).astype(np.int64) + np.bincount(b, size[s:e][a], e - s).astype(np.int64)
                    label = spanning(e - s, a, b, label)
                if label is not None:
                    some = np.flatnonzero(n)
                    out.append((node[s:e][some], node[s:e][label[some]], n[some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["a", "b", "n"])

    return task


def _blocks(keyed: DataFrame, block: int) -> DataFrame:
    """A row for each vector and band, dealt by block, or by pairs of chunks of a large one; only keys are counted beforehand."""
    places = keyed.select("length", F.posexplode("keys").alias("band", "key"))
    large = places.groupBy("length", "band", "key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = hinted(stored(large.select("length", "band", "key", F.ceil(F.col("n") / block).cast("long").alias("c")), "large_blocks"), 500_000)
    rows = keyed.select("*", F.posexplode("keys").alias("band", "key")).withColumn("earlier", F.slice("keys", F.lit(1), F.col("band"))).drop("keys")
    whole = F.coalesce("c", F.lit(1).cast("long"))
    rows = rows.join(large, ["length", "band", "key"], "left").withColumns({"c": whole, "mine": F.pmod(F.xxhash64("node"), whole)})
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("o"))
    rows = rows.withColumns({"tree": F.least("mine", "o"), "part": F.greatest("mine", "o"), "role": F.when(F.col("o") < F.col("mine"), 1).otherwise(0)})
    by = ["length", "band", "key", "tree", "part"]
    return rows.select(*by, "role", "node", "size", "vec", "earlier").repartition(*by).sortWithinPartitions(*by, "role")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, recall: float = 0.995, block: int = 4096, seed: int = 17) -> DataFrame:
    """``(id, n_links, component, kept)`` for every row of ``vectors``.

    n_links counts the other rows at ``cosine`` or more, component is the
    smallest id that links reach, and kept marks the row whose id that is.
    Vectors that are null, zero, or hold null or non-finite values have no
    links and are their own component. Vectors of different lengths never
    link; any length will do. Repeated rows are other rows, and link. Null ids
    never name a component that has another id. Other columns are ignored,
    whatever their names, and an empty table gives an empty result. ``recall``
    is that of pairs at the cosine itself; closer ones are found more often.
    """
    spark = vectors.sparkSession
    single = isinstance(getattr(vectors.schema[vector_col].dataType, "elementType", None), T.FloatType)
    kind = "<f4" if single else "<f8"
    small_batches(spark)
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vec"))
    rows = stored(named.mapInArrow(_nodes(kind), "id long, h1 long, h2 long, vec binary"), "vectors")
    nodes = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("size"), F.first("vec").alias("vec"))
    nodes = stored(nodes.select("*", F.octet_length("vec").alias("length"), F.monotonically_increasing_id().alias("node")), "nodes")
    lengths = hinted(stored(nodes.groupBy("length").agg(F.count("*").alias("n")), "lengths"), 10_000)
    keyed = nodes.join(lengths, "length").select("node", "size", "vec", "length", "n").mapInArrow(_band_keys(cosine, recall, kind, seed), "node long, size long, vec binary, length int, keys array<long>")
    links = stored(_blocks(stored(keyed, "keyed"), block).mapInArrow(_block_links(cosine, kind, seed), "a long, b long, n long"), "links")
    counts = links.groupBy("a").agg(F.sum("n").alias("n"))
    linked = components(links.select("a", "b"))
    named = nodes.select("h1", "h2", "node", "least", "size").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tops = named.groupBy("component").agg(F.min("least").alias("top"))
    named = named.join(tops, "component").join(counts, F.col("node") == F.col("a"), "left")
    named = stored(named.select("h1", "h2", "top", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links")), "named")
    out = rows.select("id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("top"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
