"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes, words and all between them, in spans of
``_SPAN`` bytes that end between characters, in both directions, and gives
every byte position a distribution over the languages. A document's
probabilities are the mean over all positions of its whole text. State begins
anew with each span; a position has up to ``_SPAN`` bytes around it to go by.

Training is numpy back-propagation through time with Adam, on the driver, on
spans of a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._store import lean_memory, small_batches

_SPAN = 128
UNDETERMINED = "und"


def _cut(b: bytes) -> list[bytes]:
    """Bytes in spans of at most ``_SPAN``, which end between characters."""
    out, lo = [], 0
    while lo < len(b):
        hi = lo + _SPAN
        while hi < len(b) and b[hi] & 0xC0 == 0x80:
            hi -= 1
        out.append(b[lo:hi])
        lo = hi
    return out


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, span) of rows (lang, text), a batch for each text."""
    lean_memory()
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            spans = _cut(text.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(spans), pa.string()), pa.array(spans, pa.binary())], ["lang", "span"])


def _matrix(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte matrix, zero-padded to the longest, and lengths."""
    lengths = np.fromiter(map(len, spans), np.int64, len(spans))
    width = int(lengths.max(initial=1))
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in spans), np.uint8).reshape(len(spans), width), lengths


def _soft(x: np.ndarray) -> np.ndarray:
    """Softsign, which squashes as tanh does without an exponential; a gate is half of it plus a half."""
    return x / (1 + np.abs(x))


class ByteBiGRU:
    """Weights: for each direction an input table (256, 3H), a recurrent matrix (H, 3H); then an output layer."""

    def __init__(self, langs: list[str], hidden: int = 16, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.w[f"u{d}"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
        self.w["o"] = rng.normal(0, 0.3, (2 * hidden, len(langs))).astype(np.float32)
        self.w["c"] = np.zeros(len(langs), np.float32)

    def _run(self, d: str, xs: np.ndarray, live: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (T, N, H) of direction d; positions where ``live`` is 0 leave the state as it is."""
        h_size, n, t_size = self.hidden, xs.shape[0], xs.shape[1]
        h, out, tape = np.zeros((n, h_size), np.float32), np.empty((t_size, n, h_size), np.float32), []
        table, u = self.w[f"x{d}"], self.w[f"u{d}"]
        for t in range(t_size) if d == "f" else range(t_size - 1, -1, -1):
            x = table[xs[:, t]]
            g = 0.5 + 0.5 * _soft(x[:, : 2 * h_size] + h @ u[:, : 2 * h_size])
            z, r = g[:, :h_size], g[:, h_size:]
            c = _soft(x[:, 2 * h_size :] + (r * h) @ u[:, 2 * h_size :])
            m = live[:, t, None]
            new = h + m * z * (c - h)
            if keep:
                tape.append((t, h, z, r, c, m))
            h = out[t] = new
        return out, tape

    def _back(self, d: str, xs: np.ndarray, tape: list, grad_out: np.ndarray, grads: dict) -> None:
        h_size = self.hidden
        u = self.w[f"u{d}"]
        gx, gu = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(u)
        gh = np.zeros(grad_out.shape[1:], np.float32)
        inputs = np.empty((xs.shape[1], xs.shape[0], 3 * h_size), np.float32)
        for t, h, z, r, c, m in reversed(tape):
            gh = gh + grad_out[t]
            step = gh * m
            gc = step * z * (1 - np.abs(c)) ** 2
            gz = step * (c - h) * 2 * np.minimum(z, 1 - z) ** 2
            grh = gc @ u[:, 2 * h_size :].T
            gr = grh * h * 2 * np.minimum(r, 1 - r) ** 2
            gates = np.concatenate([gz, gr], 1)
            gu[:, : 2 * h_size] += h.T @ gates
            gu[:, 2 * h_size :] += (r * h).T @ gc
            inputs[t, :, : 2 * h_size], inputs[t, :, 2 * h_size :] = gates, gc
            gh = gh - step * z + grh * r + gates @ u[:, : 2 * h_size].T
        np.add.at(gx, xs.T.reshape(-1), inputs.reshape(-1, 3 * h_size))
        grads[f"x{d}"], grads[f"u{d}"] = gx, gu

    def positions(self, xs: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Distribution (T, N, L) over languages at every position."""
        live = (np.arange(xs.shape[1]) < lengths[:, None]).astype(np.float32)
        hf, tf = self._run("f", xs, live, keep)
        hb, tb = self._run("b", xs, live, keep)
        h = np.concatenate([hf, hb], 2)
        logit = h @ self.w["o"] + self.w["c"]
        p = np.exp(logit - logit.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        return (p, live, h, tf, tb) if keep else (p, live)

    def train(self, spans: list[bytes], langs: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.02, least_steps: int = 150, seed: int = 11) -> None:
        """``langs``: the index of each span's language. Few spans are passed more often, ``least_steps`` steps in all."""
        rng = np.random.default_rng(seed)
        xs, lengths = _matrix(spans)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        step, h_size = 0, self.hidden
        each = -(-len(xs) // batch)
        total = max(least_steps, epochs * each)
        for _ in range(-(-total // each)):
            order = rng.permutation(len(xs))
            for lo in range(0, len(xs), batch):
                take = order[lo : lo + batch]
                x = xs[take][:, : int(lengths[take].max())]
                p, live, h, tf, tb = self.positions(x, lengths[take], keep=True)
                g = p.copy()
                g[:, np.arange(len(take)), langs[take]] -= 1
                g *= (live / (lengths[take][:, None] * len(take))).T[:, :, None]
                grads = {"o": np.einsum("tnh,tnl->hl", h, g), "c": g.sum((0, 1))}
                gh = g @ self.w["o"].T
                self._back("f", x, tf, gh[:, :, :h_size], grads)
                self._back("b", x, tb, gh[:, :, h_size:], grads)
                step += 1
                now = rate * max(0.02, 1 - step / (total + 1))
                for k, v in grads.items():
                    m, s = moment[k]
                    m += 0.1 * (v - m)
                    s += 0.01 * (v * v - s)
                    self.w[k] -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)

    def span_sums(self, spans: list[bytes], at_once: int = 2048) -> np.ndarray:
        """For each span the sum of its positions' distributions.

        Spans run from the longest, so those still live at a position are the
        first rows. The halves of the gates are taken into the weights: a
        step is h += (1 + z) / 2 * (c - h).
        """
        out = np.zeros((len(spans), len(self.langs)))
        order = sorted(range(len(spans)), key=lambda i: -len(spans[i]))
        h_size = self.hidden
        parts = {}
        for d in "fb":
            x, u = (np.split(self.w[f"{k}{d}"], 3, 1) for k in "xu")
            parts[d] = *map(np.ascontiguousarray, x), *map(np.ascontiguousarray, (u[0], u[1], u[2] / 2))
        to_f, to_b = (np.ascontiguousarray(w.T) for w in np.split(self.w["o"], 2))

        def squash(a: np.ndarray) -> None:
            size = np.abs(a)
            size += 1
            a /= size

        def step(d: str, codes: np.ndarray, h: np.ndarray) -> None:
            xz, xr, xc, uz, ur, uc = parts[d]
            z, r = h @ uz, h @ ur
            z += xz.take(codes, 0)
            r += xr.take(codes, 0)
            squash(z)
            squash(r)
            r += 1
            r *= h
            c = r @ uc
            c += xc.take(codes, 0)
            squash(c)
            c -= h
            c *= 0.5
            z += 1
            c *= z
            h += c

        for lo in range(0, len(order), at_once):
            take = order[lo : lo + at_once]
            xs, lengths = _matrix([spans[i] for i in take])
            columns = np.ascontiguousarray(xs.T).astype(np.intp)
            live = np.searchsorted(-lengths, -np.arange(xs.shape[1]), "left")
            h = np.zeros((len(take), h_size), np.float32)
            ahead = []
            for t, n in enumerate(live):
                step("f", columns[t, :n], h[:n])
                ahead.append(to_f @ h[:n].T)
            h = np.zeros((len(take), h_size), np.float32)
            sums = np.zeros((len(self.langs), len(take)), np.float32)
            for t in range(xs.shape[1] - 1, -1, -1):
                n = live[t]
                step("b", columns[t, :n], h[:n])
                p = to_b @ h[:n].T
                p += ahead.pop()
                p += self.w["c"][:, None]
                p -= p.max(0)
                np.exp(p, out=p)
                p /= p.sum(0)
                sums[:, :n] += p
            out[take] = sums.T
        return out

    def predict(self, texts: list[str | None], at_once: int = 1 << 20) -> Iterator[tuple[str, float]]:
        """Language and score of each text; spans of many texts run together, about ``at_once`` bytes, and those of a longer one in turns."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        total, held, owner, size = np.zeros((len(raw), len(self.langs))), [], [], 0
        letters = [any(map(str.isalpha, t or "")) for t in texts]
        for i, r in enumerate(raw):
            for span in _cut(r) if letters[i] else ():
                held.append(span)
                owner.append(i)
                size += len(span)
                if size >= at_once:
                    np.add.at(total, owner, self.span_sums(held))
                    held, owner, size = [], [], 0
        np.add.at(total, owner, self.span_sums(held))
        for i, r in enumerate(raw):
            if not letters[i]:
                yield UNDETERMINED, 0.0
            else:
                best = int(total[i].argmax())
                yield self.langs[best], float(min(1.0, total[i, best] / len(r)))


def train_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 4000, max_spans: int = 4000, hidden: int = 8, epochs: int = 3) -> ByteBiGRU | None:
    """A network trained on rows of ``docs`` with text and language; None where there are none.

    The sample: for each language the ``max_docs / languages`` documents (20 at
    least) with the least hash of id and text, whole; of the distinct spans of
    each language's, cut as in prediction, the ``max_spans / languages`` (50 at
    least) with the least hash. Every language that has a row is learned. The
    bounds are independent of the corpus, and only these spans reach the
    driver. Null ids, empty texts, repeated rows and other columns are fine.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    langs = sorted(r.lang for r in sizes.collect())
    if not langs:
        return None
    each = max(20, max_docs // len(langs))
    # The share of the hash range that holds about twice as many as needed of a language; the window then sees no more.
    near = known.join(F.broadcast(sizes), "lang").where(F.col("h").cast("double") / float(1 << 63) <= -1 + 2 * F.least(F.lit(1.0), (2.0 * each + 50) / F.col("n")))
    picked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("rank") <= each)
    small_batches(docs.sparkSession)
    spans = picked.select("lang", "text").mapInArrow(_cut_texts, "lang string, span binary").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("span"), "span")
    rows = spans.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(50, max_spans // len(langs))).select("lang", "span").collect()
    rows = sorted((r.lang, bytes(r.span)) for r in rows)
    model = ByteBiGRU(langs, hidden)
    if rows and len(langs) > 1:
        at = {x: i for i, x in enumerate(langs)}
        model.train([span for _, span in rows], np.array([at[x] for x, _ in rows]), epochs)
    return model


def identify_languages(docs: DataFrame, model: ByteBiGRU | None, text_col: str = "text") -> DataFrame:
    """Every row and column of ``docs`` plus ``lang_pred`` and ``lang_score``.

    lang_pred is ``und`` with score 0 for a text that is null, empty or has no
    letter, and for all rows where there is no model. Otherwise the score is
    the pooled probability of the language; on a tie the one first in
    alphabetical order. A text of any length is read whole. Repeated rows get
    the same result, and an empty table stays empty. Columns already called
    lang_pred or lang_score are replaced; others pass through, whatever their
    names.
    """
    docs = docs.drop("lang_pred", "lang_score")
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for b in batches:
            texts = b.column(at).to_pylist()
            found = [*shared.value.predict(texts)] if shared.value else [(UNDETERMINED, 0.0)] * len(texts)
            lang, score = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(task, schema)
