"""SimHash near-duplicates by BK-trees over shards of fingerprints.

A document's fingerprint sums the bits of the XXH64 hashes of its word
shingles. Two fingerprints link at ``radius`` differing bits or fewer.

Documents with one fingerprint are one node from the start. Distinct
fingerprints are dealt into shards by pigeonhole: the 64 bits are cut into
``radius + 2`` segments, and two fingerprints within the radius agree on at
least two of them, so a shard for each pair of segments and each of their
values holds every link. Each shard becomes a BK-tree (children are keyed by
their integer Hamming distance to the parent); a search from distance d
follows only edges from d - radius to d + radius. A tree goes to the tasks
that query it as rows of a shuffle: a broadcast from the driver would need
all fingerprints there. A shard over ``tree_size`` fingerprints becomes
several trees, each sent to every chunk of the shard's queries, so no task
holds more than two chunks and no link is lost. Tasks return spanning links
of what they found, at most one for each query, never all pairs.

``similar_components`` takes a Jaccard similarity instead of a radius. Then
the radius is a sixth of all bits or more and segments can't be kept whole, so
shards are random choices of bits out of four fingerprints, as many as the
wanted recall needs. Among many documents 64 bits come close by chance, so a
pair that a tree finds must be close by all 256 bits as well. Each task then
returns spanning forests, closest pairs first, and each of their pairs is held
against the similarity of the two sets of shingles themselves. What the
fingerprints miss is found exactly: two sets of the similarity share one of
the first shingles of each in any common order, so sets of different
components that meet there are compared too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._components import components
from quern.llm._runs import spanning, spanning_edges, whole_groups
from quern.llm._store import hinted, lean_memory, small_batches, stored

#: Bit j of byte value v, for sums of bits from byte histograms.
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
_SEED = 42
#: Fingerprints that tell pairs apart, besides the one that the trees hold.
_MORE = 3
#: Forests of found pairs that a task returns: a group holds together while fewer of its pairs than this fail.
_FORESTS = 3


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a whole text; zero where it has no words."""
    return _majority(_shingle_hashes(text, shingle))


def _shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(_SEED)), np.uint64)


def _majority(hashes: np.ndarray) -> int:
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(sum(1 << int(j) for j in np.flatnonzero(2 * ones > len(hashes))))


def sketch(text: str | None, shingle: int) -> list[int]:
    """A hash of the set of shingles, its fingerprint and, from the same hashes mixed anew, ``_MORE`` others."""
    hashes = np.unique(_shingle_hashes(text, shingle))
    out = [xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), _SEED), _majority(hashes)]
    for _ in range(_MORE):
        hashes = hashes ^ hashes >> np.uint64(31)
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15)
        hashes = hashes ^ hashes >> np.uint64(29)
        out.append(_majority(hashes))
    return out


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` of every row; fp is the fingerprint as a signed long."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    small_batches(docs.sparkSession)
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return ids.mapInArrow(task, "id long, fp long")


# --- BK-trees: a forest over many shards at once, level by level ---------------


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def grow_forest(fps: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of distinct fingerprints, one for each shard (ascending labels).

    Returns the root of each shard, the children sorted by (parent, edge), the
    edge of each, and for each node where its children begin in that order.
    """
    n = len(fps)
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    parent, edge = np.full(n, -1), np.zeros(n, np.int16)
    at = np.repeat(first, np.diff(np.r_[first, n]))
    down = np.setdiff1d(np.arange(n), first, assume_unique=True)
    at = at[down]
    while len(down):
        d = _distance(fps[down], fps[at])
        order = np.lexsort((down, d, at))
        down, at, d = down[order], at[order], d[order]
        new = np.r_[True, (at[1:] != at[:-1]) | (d[1:] != d[:-1])]
        child = down[new]
        parent[child], edge[child] = at[new], d[new]
        at = np.repeat(child, np.diff(np.r_[np.flatnonzero(new), len(down)]))[~new]
        down = down[~new]
    kids = np.lexsort((edge, parent))
    kids = kids[parent[kids] >= 0]
    begins = np.searchsorted(parent[kids], np.arange(n + 1))
    return first, kids, edge[kids], begins


def search_forest(fps: np.ndarray, forest: tuple, queries: np.ndarray, roots: np.ndarray, radius: int, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, node) within the radius, in slices; ``roots`` is each query's tree.

    About ``at_once`` edges are looked at together, those of one node at least.
    """
    _, kids, edges, begins = forest
    step = 4096
    for lo in range(0, len(queries), step):
        todo = [(np.arange(lo, min(lo + step, len(queries))), roots[lo : lo + step])]
        while todo:
            q, node = todo.pop()
            count = begins[node + 1] - begins[node]
            if len(q) > 1 and len(q) + count.sum() > at_once:
                half = len(q) // 2
                todo += [(q[half:], node[half:]), (q[:half], node[:half])]
                continue
            d = _distance(queries[q], fps[node])
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            some = np.repeat(np.arange(len(q)), count)
            if not len(some):
                continue
            slot = np.arange(len(some)) - np.repeat(np.cumsum(count) - count, count) + begins[node[some]]
            follow = np.abs(edges[slot] - d[some]) <= radius
            todo.append((q[some[follow]], kids[slot[follow]]))


def _shard_links(radius: int, most: int | None = None):
    """Task over rows (key, pair, role, fp) sorted in that order: role 0 is in the tree, role 1 queries it.

    With ``most``, rows have a node and further fingerprints as well; fingerprints may
    repeat, pairs are found only with at most that many bits of difference
    over all, and links are pairs of nodes found: ``_FORESTS`` forests, each
    of what the earlier ones leave, with the closest pairs first.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for table, starts in whole_groups(batches, ["key", "pair"]):
            counts = np.diff(np.r_[starts, table.num_rows])
            table = table.filter(pa.array(np.repeat(counts > 1, counts)))
            if not table.num_rows:
                continue
            starts = np.r_[0, np.cumsum(counts[counts > 1])[:-1]]
            fps = table["fp"].to_numpy().view(np.uint64)
            role = table["role"].to_numpy()
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(fps)]))
            other = np.bincount(group, weights=role, minlength=len(starts)) > 0
            trees, asks = np.flatnonzero(role == 0), np.flatnonzero((role == 1) | ~other[group])
            if not len(trees) or not len(asks):
                continue
            forest = grow_forest(fps[trees], group[trees])
            root_of = np.full(len(starts), -1)
            root_of[group[trees][forest[0]]] = forest[0]
            roots = root_of[group[asks]]
            asks, roots = asks[roots >= 0], roots[roots >= 0]
            label = None
            forests, held = [(np.zeros(0, np.int64),) * 3] * _FORESTS, []
            names = fps.view(np.int64)
            if most is not None:
                names = table["node"].to_numpy()
                wide = np.column_stack([table[f"more{i}"].to_numpy().view(np.uint64) for i in range(_MORE)])
            for q, node in search_forest(fps[trees], forest, fps[asks], roots, radius):
                a, b = asks[q], trees[node]
                if most is not None:
                    a, b = a[a != b], b[a != b]
                    d = _distance(fps[a], fps[b]) + np.bitwise_count(wide[a] ^ wide[b]).sum(1, dtype=np.int16)
                    near = d <= most
                    held.append((np.minimum(a, b)[near], np.maximum(a, b)[near], d[near].astype(np.int64)))
                    if sum(len(x[0]) for x in held) > 1 << 20:
                        forests, held = _grown(len(fps), forests, held), []
                    continue
                label = spanning(len(fps), a, b, label)
            if most is not None:
                a, b, _ = (np.concatenate(c) for c in zip(*_grown(len(fps), forests, held)))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], ["a", "b"])
            if label is not None:
                found = np.flatnonzero(label != np.arange(len(fps)))
                yield pa.RecordBatch.from_arrays([pa.array(names[found]), pa.array(names[label[found]])], ["a", "b"])

    return task


def _grown(n: int, forests: list[tuple], held: list[tuple]) -> list[tuple]:
    """The forests of edges (a, b, distance), old and held: each the least that spans what those before it leave."""
    out, left = [], held
    for forest in forests:
        a, b, d = (np.concatenate(c) for c in zip(forest, *left))
        order = np.lexsort((b, a, d))
        a, b, d = a[order], b[order], d[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
        a, b, d = a[new], b[new], d[new]
        kept = spanning_edges(n, a, b)
        out.append((a[kept], b[kept], d[kept]))
        left = [(a[~kept], b[~kept], d[~kept])]
    return out


def fingerprint_links(fps: DataFrame, radius: int = 2, tree_size: int = 2048) -> DataFrame:
    """Spanning links (a, b) between the distinct longs of column ``fp`` within the radius."""
    width = 64 // (radius + 2)
    cuts = [*(i * width for i in range(radius + 2)), 64]
    segments = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    masks = [{"fp": a | b} for a, b in combinations(segments, 2)]
    return _in_shards(_dealt(fps.select("fp"), masks), ["fp"], tree_size).mapInArrow(_shard_links(radius), "a long, b long")


def _dealt(rows: DataFrame, masks: list[dict[str, int]]) -> DataFrame:
    """``rows`` once for each mask, with the key of the shard: mask number and the columns' bits under the mask.

    The key is a hash of both. Should two keys meet, their shards are one; distances are compared anyway.
    """
    signed = [{c: np.array([m], np.uint64).view(np.int64)[0].item() for c, m in mask.items() if m} for mask in masks]
    keys = F.array(*(F.xxhash64(F.lit(i), *(F.col(c).bitwiseAND(F.lit(m)) for c, m in mask.items())) for i, mask in enumerate(signed)))
    return rows.select("*", F.explode(keys).alias("key"))


def _in_shards(dealt: DataFrame, columns: list[str], tree_size: int) -> DataFrame:
    """Rows (key, pair, role, fp, ...) dealt to tasks by shard, or by pairs of chunks of a large one.

    Only keys are counted beforehand; the rows themselves are shuffled once.
    """
    large = dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tree_size)
    large = hinted(stored(large.select("key", F.ceil(F.col("n") / tree_size).cast("long").alias("c")), "large_shards"), 500_000)
    whole = F.coalesce("c", F.lit(1).cast("long"))
    dealt = dealt.join(large, "key", "left").select("key", *columns, whole.alias("c"), F.pmod(F.xxhash64(columns[-1]), whole).alias("mine"))
    dealt = dealt.select("key", *columns, "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("o"))
    pair = F.least("mine", "o") * (1 << 31) + F.greatest("mine", "o")
    dealt = dealt.select("key", pair.alias("pair"), F.when(F.col("o") < F.col("mine"), 1).otherwise(0).alias("role"), *columns)
    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair", "role", "fp")


def _bits_apart(similarity: float) -> float:
    """Share of bits in which fingerprints of two shingle sets of a Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _chances(bits: int, apart: float) -> np.ndarray:
    """Chance of each number of differing bits, from none to all."""
    return np.array([math.comb(bits, d) * apart**d * (1 - apart) ** (bits - d) for d in range(bits + 1)])


def _cuts(n: int, similarity: float, recall: float) -> tuple[int, int, int, int]:
    """Bits of a mask, number of masks, and the bounds on the bits of difference in a tree and over all.

    The bits in which a pair differs are the same under every mask, so the
    chance that no mask misses them all is taken for each number of them. Each
    bound may lose a tenth of what ``recall`` allows.
    """
    apart, bits = _bits_apart(similarity), (1 + _MORE) * 64
    width = min(40, max(8, math.ceil(math.log2(max(2, n) / 32))))
    lost = (1 - recall) / 10
    chance = _chances(bits, apart)
    radius = int(np.searchsorted(np.cumsum(_chances(64, apart)), 1 - lost))
    most = int(np.searchsorted(np.cumsum(chance), 1 - lost))
    agree = np.array([math.comb(bits - d, width) / math.comb(bits, width) for d in range(most + 1)])
    cuts = 1
    while chance[: most + 1] @ (1 - (1 - agree) ** cuts) - lost < recall:
        cuts += 1
    return width, cuts, radius, most


def similar_links(nodes: DataFrame, n: int, similarity: float, recall: float = 0.95, tree_size: int = 2048, seed: int = 3) -> DataFrame:
    """Pairs (a, b) of the nodes (node, fp, more0, ...), ``n`` of them, that may be as similar."""
    width, cuts, radius, most = _cuts(n, similarity, recall)
    rng = np.random.default_rng(seed)
    words = ["fp", *(f"more{i}" for i in range(_MORE))]
    chosen = [rng.choice(64 * len(words), width, replace=False) for _ in range(cuts)]
    masks = [{c: sum(1 << int(j) % 64 for j in some if j // 64 == i) for i, c in enumerate(words)} for some in chosen]
    columns = [*words, "node"]
    return _in_shards(_dealt(nodes.select(columns), masks), columns, tree_size).mapInArrow(_shard_links(radius, most), "a long, b long")


def _paired(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b), each once and a < b, and (node, text) of the nodes in them."""
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = hinted(stored(nodes.select("node", "hash").join(wanted, "node", "left_semi"), "paired_nodes"), 500_000)
    return pairs, texts.select(F.xxhash64("text").alias("hash"), "text").join(wanted, "hash").groupBy("node").agg(F.first("text").alias("text"))


def _plausible(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs without those that can't have the similarity by how many shingles fall into each of 256 bins.

    The counts of two sets are no further apart than the sets, so no pair with the similarity goes.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for b in batches:
            sets = [np.unique(_shingle_hashes(t.as_py(), shingle)) for t in b.column(1)]
            bins = [np.minimum(np.bincount((x & np.uint64(255)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(bins, pa.binary())], ["node", "size", "bins"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for b in batches:
            x, y = (np.array([np.frombuffer(v.as_py(), np.uint8) for v in b.column(c)], np.int16).reshape(-1, 256) for c in (3, 5))
            total = b.column(2).to_numpy() + b.column(4).to_numpy()
            keep = pa.array(np.abs(x - y).sum(1) <= total * (1 - similarity) / (1 + similarity) + 1e-6)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    pairs, texts = _paired(pairs, nodes, texts)
    bins = stored(texts.mapInArrow(task, "node long, size long, bins binary"), "bins")
    both = pairs.join(bins.toDF("a", "n", "x"), "a").join(bins.toDF("b", "m", "y"), "b")
    return both.select("a", "b", "n", "x", "m", "y").mapInArrow(near, "a long, b long")


#: Buckets of shingles' hashes for their frequency, and documents that are counted for it.
_BUCKETS, _COUNTED = 1 << 21, 20_000


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(43)).astype(np.int64)


def _often(texts: DataFrame, n: int, shingle: int) -> np.ndarray:
    """How many texts have a shingle of each bucket, estimated from about ``_COUNTED`` of the ``n`` texts.

    The estimate only sets the order in which shingles come, rare ones first, and how finely work is dealt: whatever it is, no pair is lost.
    """
    every = max(1, n // _COUNTED)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        counts = np.zeros(_BUCKETS, np.int32)
        for b in batches:
            for t in b.column(0):
                np.add.at(counts, _bucket(np.unique(_shingle_hashes(t.as_py(), shingle))), 1)
        found = np.flatnonzero(counts)
        for lo in range(0, len(found), 1 << 16):
            some = found[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some].astype(np.int64))], ["bucket", "n"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    counts = some.select("text").mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").cast("int").alias("n")).where("n > 1").toArrow()
    out = np.zeros(_BUCKETS, np.int32)
    out[counts["bucket"].to_numpy()] = np.minimum(counts["n"].to_numpy().astype(np.int64) * every, (1 << 31) - 1)
    return out


def _first_shingles(shingle: int, similarity: float, often, chunk: int):
    """Task over rows (text, node, component) to (key, node, component, size, at): the shingles of a set that may be the first it shares.

    A set of n shingles shares at least ``similarity`` of them, so one is among
    the first n - ceil(similarity * n) + 1, in an order that all sets use. A
    shingle that more than ``chunk`` texts may have is dealt to pairs of
    chunks of them: the key is of the pair too. at is the place in the order, with 1
    for the second chunk of a pair and 2 for a pair of different chunks in its low bits.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        counts = often.value
        for b in batches:
            rows = []
            nodes, components_ = b.column(1).to_numpy(), b.column(2).to_numpy()
            for i, t in enumerate(b.column(0)):
                hashes = np.unique(_shingle_hashes(t.as_py(), shingle))
                n = len(hashes)
                if not n:
                    continue
                count = counts[_bucket(hashes)]
                first = np.lexsort((hashes, count))[: n - math.ceil(similarity * n - 1e-9) + 1]
                parts = -(-np.maximum(count[first], 1).astype(np.int64) // chunk)
                key, at = hashes[first].view(np.int64), 4 * np.arange(len(first))
                if (parts > 1).any():
                    mine = int(nodes[i]) % parts
                    which = np.repeat(np.arange(len(first)), parts)
                    other = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
                    mine, parts = mine[which], parts[which]
                    pair = np.minimum(mine, other).astype(np.uint64) << np.uint64(32) | np.maximum(mine, other).astype(np.uint64)
                    # Should two keys meet, their sets are compared anyway.
                    mixed = (key[which].view(np.uint64) ^ (pair + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                    key = np.where(parts > 1, mixed, key[which])
                    at = at[which] + (other < mine) + 2 * (other != mine)
                rows.append((key, np.full(len(key), nodes[i]), np.full(len(key), components_[i]), np.full(len(key), n, np.int32), at.astype(np.int32)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["key", "node", "component", "size", "at"])

    return task


def _crossing(similarity: float, at_once: int = 1 << 18):
    """Task over rows of ``_first_shingles`` sorted by key and component to pairs (a, b) of nodes of different components that may have the similarity."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for table, starts in whole_groups(batches, ["key"]):
            node, component = table["node"].to_numpy(), table["component"].to_numpy()
            size, at = table["size"].to_numpy().astype(np.int64), table["at"].to_numpy()
            place, role, crossed = at >> 2, at & 1, at & 2 > 0
            n = len(node)
            ends = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
            new = np.zeros(n, bool)
            new[starts] = True
            new[1:] |= component[1:] != component[:-1]
            runs = np.flatnonzero(new)
            after = np.repeat(np.r_[runs[1:], n], np.diff(np.r_[runs, n]))
            rows = np.flatnonzero(after < ends)
            while len(rows):
                # All rows after those of its own component, for as many rows as ``at_once`` allows, at least one.
                count = (ends - after)[rows]
                here = max(1, int(np.searchsorted(np.cumsum(count), at_once, side="right")))
                x = np.repeat(rows[:here], count[:here])
                y = np.arange(len(x)) - np.repeat(np.cumsum(count[:here]) - count[:here], count[:here]) + after[x]
                rows = rows[here:]
                total = size[x] + size[y]
                # At the first shingle that two sets share, what comes before it differs and what follows is all they may share.
                may = place[x] + place[y] <= total * (1 - similarity) / (1 + similarity) + 1e-6
                may &= np.minimum(size[x] - place[x], size[y] - place[y]) >= total * similarity / (1 + similarity) - 1e-6
                may &= ~crossed[x] | (role[x] != role[y])
                if may.any():
                    found = np.unique(np.column_stack([node[x[may]], node[y[may]]]), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.T.copy()], ["a", "b"])

    return task


def _missed(nodes: DataFrame, found: DataFrame, texts: DataFrame, n: int, shingle: int, similarity: float, chunk: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components of ``found`` among which all that have the similarity are."""
    small_batches(texts.sparkSession)
    often = texts.sparkSession.sparkContext.broadcast(_often(texts, n, shingle))
    one = nodes.join(found, "node", "left").select(F.col("least.id").alias("id"), F.col("least.hash").alias("hash"), "node", F.coalesce("component", "node").alias("component"))
    one = hinted(stored(one, "compared"), 1_000_000)
    rows = texts.withColumn("hash", F.xxhash64("text")).alias("t").join(one.alias("o"), F.expr("t.id <=> o.id AND t.hash = o.hash")).select("t.text", "o.node", "o.component")
    rows = rows.mapInArrow(_first_shingles(shingle, similarity, often, chunk), "key long, node long, component long, size int, at int")
    rows = rows.repartition("key").sortWithinPartitions("key", "component")
    return rows.mapInArrow(_crossing(similarity), "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs whose sets of shingles have the similarity; only texts in a pair are read again."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for b in batches:
            sets = [np.unique(_shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "grams"])

    pairs, texts = _paired(pairs, nodes, texts)
    sets = stored(texts.mapInArrow(task, "node long, grams array<long>"), "shingles")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, chunk: int = 8192) -> DataFrame:
    """``(id, hash, fp, component, component_hash)``, linking texts of a Jaccard similarity.

    Every link is of two texts whose sets of ``shingle``-word shingles have
    that similarity, exactly, and no such pair is in two components. 256 bits
    tell which pairs to compare first; texts that these leave in different
    components are compared where they share one of the shingles that they
    must. Texts of equal sets are one. Texts with fewer words than a shingle
    are one shingle; null texts and those without words are equal.

    hash is that of the text; (component, component_hash) is the least (id,
    hash) that links reach, null ids first, so rows that repeat an id or have
    none are told apart by their texts. Repeated rows get the same result.
    Texts of any length are whole, other columns are ignored, and an empty
    table gives an empty result.
    """
    words = ["fp", *(f"more{i}" for i in range(_MORE))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for b in batches:
            found = np.array([sketch(t.as_py(), shingle) for t in b.column(1)], np.uint64).reshape(b.num_rows, 2 + _MORE)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c.copy().view(np.int64)) for c in found.T)], ["id", "hash", "node", *words])

    small_batches(docs.sparkSession)
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = ids.select("id", "text", F.xxhash64("text").alias("hash")).mapInArrow(task, "id long, hash long, node long, " + ", ".join(f"{w} long" for w in words))
    prints = stored(prints, "sketches")
    nodes = stored(prints.groupBy("node").agg(F.min(F.struct("id", "hash")).alias("least"), F.min("hash").alias("hash"), *(F.first(c).alias(c) for c in words)), "nodes")
    n = nodes.count()
    found = components(_verified(similar_links(nodes, n, similarity), nodes, ids.select("text"), shingle, similarity))
    more = _plausible(_missed(nodes, found, ids, n, shingle, similarity, chunk), nodes, ids.select("text"), shingle, similarity)
    more = _verified(more, nodes, ids.select("text"), shingle, similarity)
    found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    named = _named(prints, nodes.select("node", "least"), found)
    return named.select("id", "hash", "fp", F.col("component.id").alias("component"), F.col("component.hash").alias("component_hash"))


def _named(prints: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``prints`` with component, the smallest of the nodes' ``least`` that links reach."""
    linked = found.join(nodes, "node")
    tops = linked.groupBy("component").agg(F.min("least").alias("top"))
    linked = linked.join(tops, "component").select("node", "top")
    names = stored(nodes.join(linked, "node", "left").select("node", F.coalesce("top", "least").alias("component")), "names")
    return prints.join(names, "node")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, tree_size: int = 2048) -> DataFrame:
    """``(id, fp, component)`` for every row of ``docs``.

    component is the smallest id that can be reached by links. A null or blank
    text has fingerprint zero and links like any other; a null id gets a row,
    and never names a component unless all its ids are null. Repeated rows
    are kept, each with the same result. Texts of any length are whole, other
    columns are ignored, and an empty table gives an empty result.
    """
    prints = stored(with_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    prints = prints.select("id", "fp", F.col("fp").alias("node"))
    nodes = stored(prints.groupBy("node").agg(F.min("id").alias("least")), "nodes")
    found = components(fingerprint_links(nodes.select(F.col("node").alias("fp")), radius, tree_size))
    return _named(prints, nodes, found).select("id", "fp", "component")
