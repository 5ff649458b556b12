"""Quality scores by Bradley-Terry ranking of preference pairs.

Each labelled good document is preferred to each labelled bad one. The score
is linear in features of the whole text and is fitted by logistic loss on the
feature differences of all pairs (Newton steps, ridge penalty), so features that
all documents share cancel out. A quantile of the training scores, at the
share of bad labels, becomes the threshold; scores are squashed around it.

Pairs are never listed. The loss of a pair is a smooth function of the
difference of two scores, so sums over all pairs follow from moments of each
label's scores: the weights of Chebyshev nodes in cells of width one, which
interpolate that function to about ten digits. Tasks add up moments and
weighted squares of the stored features of all labelled documents; the driver
gets one small table from each task, whatever the number of labels.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._store import hinted, lean_memory, small_batches, stored

#: The score at the threshold quantile.
AT_THRESHOLD = 0.3

_SIGNS = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[]_{|}~\\^`\n", np.uint8)
_CLASSES = (slice(48, 58), slice(65, 91), slice(97, 123), slice(128, 256))


def features(text: str | None) -> np.ndarray:
    """Features of a whole text: rates of signs and character classes, and shapes of words and lines."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    n_words = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words))
    rates = [hist[_SIGNS] / n_words, [hist[c].sum() / n for c in _CLASSES]]
    shapes = [
        np.log1p(len(words)),
        lengths.mean() / 10 if len(words) else 0,
        lengths.std() / 10 if len(words) else 0,
        lengths.max(initial=0) / 100,
        len(set(words)) / n_words,
        len(set(lines)) / len(lines),
        np.log1p(n_words / len(lines)),
        np.log1p(len(lines)),
        sum(map(bytes.isupper, words)) / n_words,
        sum(map(bytes.islower, words)) / n_words,
        sum(map(bytes.isalpha, words)) / n_words,
    ]
    x = np.concatenate([np.log1p(20 * np.concatenate(rates)), np.array(shapes, float)])
    return np.concatenate([x, x * x])


@dataclass
class PairwiseRanker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.raw(x) - self.threshold, -30, 30) + np.log(AT_THRESHOLD / (1 - AT_THRESHOLD))
        return 1 / (1 + np.exp(-z))


#: Nodes in a cell of width one, and the bits of a score that one pass over the scores settles.
_NODES, _DIGIT = 12, 12
_AT = (np.cos((2 * np.arange(_NODES) + 1) * np.pi / (2 * _NODES)) + 1) / 2
_BASIS = np.linalg.inv(np.polynomial.chebyshev.chebvander(2 * _AT - 1, _NODES - 1))

#: Adds up a function of features and labels (arrays by key) over all labelled rows.
Summed = Callable[[Callable[[np.ndarray, np.ndarray], dict]], dict]


def _added(total: dict, part: dict) -> dict:
    for k, v in part.items():
        total[k] = total[k] + v if k in total else v
    return total


def _chance(x: np.ndarray) -> np.ndarray:
    return (1 + np.tanh(x / 2)) / 2


def _moments(z: np.ndarray, good: np.ndarray, w: np.ndarray) -> dict:
    """By label and cell, the weight of each node and the sums of the features that go with it."""
    s = z @ w
    cell = np.floor(s)
    basis = np.polynomial.chebyshev.chebvander(2 * (s - cell) - 1, _NODES - 1) @ _BASIS
    out = {}
    for label in (True, False):
        for c in np.unique(cell[good == label]):
            here = (good == label) & (cell == c)
            out[label, float(c)] = basis[here].T @ np.column_stack([np.ones(here.sum()), z[here]])
    return out


def _nodes(moments: dict, label: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the nodes of a label, their weights and sums of features."""
    cells = sorted(c for k, c in moments if k == label)
    held = np.concatenate([moments[label, c] for c in cells])
    return np.concatenate([c + _AT for c in cells]), held[:, 0], held[:, 1:]


def _squares(z: np.ndarray, good: np.ndarray, w: np.ndarray, others: dict) -> dict:
    """Squares of features, each row weighted by the curvature of its pairs with all nodes of the other label."""
    s, weight = z @ w, np.zeros(len(z))
    for label, (at, n) in others.items():
        mine = np.flatnonzero(good == label)
        step = max(1, (1 << 18) // len(at))
        for lo in range(0, len(mine), step):
            rows = mine[lo : lo + step]
            p = _chance(s[rows][:, None] - at[None])
            weight[rows] = (p * (1 - p)) @ n
    return {"squares": (z * weight[:, None]).T @ z}


def _order_statistics(summed: Summed, scores: Callable, ranks: list[int]) -> list[float]:
    """The scores of some ranks from 0, exactly: bits of the scores are settled by counting, highest first."""

    def keys(x: np.ndarray) -> np.ndarray:
        bits = (scores(x) + 0.0).view(np.int64)
        return np.where(bits < 0, ~bits, bits ^ np.int64(-(1 << 63))).view(np.uint64)

    found, left = [0] * len(ranks), list(ranks)
    for shift in range(64 - 64 % _DIGIT, -1, -_DIGIT):

        def counts(x: np.ndarray, good: np.ndarray, shift=shift, found=tuple(found)) -> dict:
            k = keys(x)
            high = k >> np.uint64(shift + _DIGIT) if shift + _DIGIT < 64 else np.zeros(len(k), np.uint64)
            digit = (k >> np.uint64(shift) & np.uint64((1 << _DIGIT) - 1)).astype(np.int64)
            return {f: np.bincount(digit[high == np.uint64(f)], minlength=1 << _DIGIT) for f in set(found)}

        n = summed(counts)
        for i, f in enumerate(found):
            below = np.cumsum(n[f])
            digit = int(np.searchsorted(below, left[i], side="right"))
            left[i] -= int(below[digit - 1]) if digit else 0
            found[i] = f << _DIGIT | digit
    bits = np.array(found, np.uint64).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(-(1 << 63)), ~bits).view(np.float64).tolist()


def _fitted(summed: Summed, width: int, ridge: float, steps: int) -> PairwiseRanker:
    """Bradley-Terry weights from all pairs of a good row and a bad one."""
    first = summed(lambda x, good: {"n": np.array([good.sum(), (~good).sum()]), "sum": x.sum(0)})
    n_good, n_bad = map(int, first.get("n", (0, 0)))
    n, w = n_good + n_bad, np.zeros(width)
    if not n:
        return PairwiseRanker(np.zeros(width), np.ones(width), w, -1.0)
    mean = first["sum"] / n
    scale = np.maximum(np.sqrt(summed(lambda x, good: {"squares": ((x - mean) ** 2).sum(0)})["squares"] / n), 1e-6)
    if not n_good or not n_bad:
        # One label only: everything scores alike, above the threshold if that label is good.
        return PairwiseRanker(mean, scale, w, -1.0 if n_good else 1.0)
    for _ in range(steps):
        moments = summed(lambda x, good: _moments((x - mean) / scale, good, w))
        (at_g, n_g, z_g), (at_b, n_b, z_b) = _nodes(moments, True), _nodes(moments, False)
        p = _chance(at_b[None] - at_g[:, None])
        gradient = (z_g.T @ (p @ n_b) - z_b.T @ (p.T @ n_g)) / n_good / n_bad - ridge * w
        others = {True: (at_b, n_b), False: (at_g, n_g)}
        squares = summed(lambda x, good: _squares((x - mean) / scale, good, w, others))["squares"]
        across = z_g.T @ (p * (1 - p)) @ z_b
        curve = (squares - across - across.T) / n_good / n_bad + ridge * np.eye(width)
        move = np.linalg.solve(curve, gradient)
        w = w + move
        if np.abs(move).max() < 1e-6:
            break
    rank = (n - 1) * (n_bad / n)
    low, high = _order_statistics(summed, lambda x: ((x - mean) / scale) @ w, [int(rank), min(int(rank) + 1, n - 1)])
    return PairwiseRanker(mean, scale, w, low + (high - low) * (rank - int(rank)))


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int | None = None, ridge: float = 1e-3, steps: int = 25, seed: int = 5) -> PairwiseRanker:
    """Bradley-Terry weights from all (good, bad) pairs of the rows of ``x``, or from ``pairs`` random ones."""
    best, worst = np.flatnonzero(good), np.flatnonzero(~good)
    ranker = _fitted(lambda f: f(x, good) if len(x) else {}, x.shape[1], ridge, steps if pairs is None else 0)
    if pairs is None or not len(best) or not len(worst):
        return ranker
    z = (x - ranker.mean) / ranker.scale
    rng = np.random.default_rng(seed)
    w = np.zeros(x.shape[1])
    d = z[rng.choice(best, pairs)] - z[rng.choice(worst, pairs)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = d.T @ p / pairs - ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, gradient)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return PairwiseRanker(ranker.mean, ranker.scale, w, float(np.quantile(z @ w, len(worst) / len(x))))


def _with_features(docs: DataFrame, text_col: str, extra: list[str]) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for b in batches:
            rows = [features(t.as_py()).tolist() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), *b.columns[1:]], ["x", *extra])

    small_batches(docs.sparkSession)
    chosen = docs.select(text_col, *extra)
    return chosen.mapInArrow(task, T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), *chosen.schema.fields[1:]]))


def train_ranker(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", ridge: float = 1e-3, steps: int = 25) -> PairwiseRanker:
    """A ranker from all labelled rows (0 bad, other values good, null unlabelled).

    Only labelled documents are read for features, which are stored; sums over
    them reach the driver. Labels of one id count as their least; of documents
    that share an id the one with the least hash of the text is taken. Null
    ids, null texts (as empty), long texts, other columns and empty tables are fine.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    chosen = hinted(stored(chosen.select("_id", (F.col("_label") != 0).alias("_good")), "labels"), 1_000_000)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id").withColumn("_hash", F.xxhash64("_text"))
    rows = _with_features(rows, "_text", ["_id", "_hash", "_good"])
    width = len(features(""))
    # Features are followed by their squares, which need not be stored.
    rows = rows.groupBy("_id").agg(F.min(F.struct("_hash", F.slice("x", 1, width // 2).alias("x"), "_good")).alias("_row"))
    rows = stored(rows.sortWithinPartitions("_id").select("_row.x", "_row._good"), "features")

    def summed(f: Callable[[np.ndarray, np.ndarray], dict]) -> dict:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lean_memory()
            total: dict = {}
            for b in batches:
                if b.num_rows:
                    x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    _added(total, f(np.concatenate([x, x * x], 1), b.column(1).to_numpy(zero_copy_only=False).astype(bool)))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

        total: dict = {}
        for r in rows.mapInArrow(task, "part binary").collect():
            _added(total, pickle.loads(r.part))
        return total

    return _fitted(summed, width, ridge, steps)


def score_quality(docs: DataFrame, ranker: PairwiseRanker, text_col: str = "text") -> DataFrame:
    """Every row and column of ``docs`` plus quality_score, in (0, 1).

    Null and empty texts are scored by the features of an empty text; equal
    texts score alike, and texts of any length are read whole. An empty table
    stays empty. A column already called quality_score is replaced, others
    pass through whatever their names.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("quality_score")
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(ranker)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(at)]).reshape(b.num_rows, -1)
            scores = shared.value.score(x) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, "quality_score"])

    return docs.mapInArrow(task, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))
