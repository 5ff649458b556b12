"""SimHash, BPE, token counts, languages and quality against brute force, libraries and held-out rows."""

import hashlib
import random
import subprocess
import sys

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import catalog
from quern.llm.bpe_trie import WordTrieBPE, encode_documents
from quern.llm.language_bigru import ByteBiGRU, _cut, _matrix, identify_languages, train_language_model
from quern.llm.quality_ranker import features, fit_pairs, score_quality, train_ranker
from quern.llm.queries_text import tokenizer_path
from quern.llm.simhash_bktree import _bits_apart, _cuts, fingerprint, grow_forest, search_forest, similar_components, simhash_components
from quern.llm.token_count import CountingViterbi, count_tokens, vocabulary

from ..conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, component long, lang_pred string"
LONG = "word " * 30_000


def docs_of(spark, texts, ids=None):
    rows = [(i, t, "en", "s", None, "clash", 5, "xx") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("text").collect()]


# --- SimHash ------------------------------------------------------------------------


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_fingerprint_by_definition(texts):
    for t in [*texts[:40], "", None, "One", "two Words", "a\x0bb\x1cc d e f", "x x x x x", "ÄÖ ÜÄ ÄÖ ÜÄ"]:
        assert fingerprint(t) == plain_fingerprint(t)


def test_bk_trees_find_all(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 20, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(1 << a) ^ np.uint64(1 << b) for a in range(0, 60, 7) for b in range(0, 60, 11)]))
    shard = np.sort(rng.integers(0, 5, len(fps)))
    forest = grow_forest(fps, shard)
    roots = forest[0][np.searchsorted(shard[forest[0]], shard)]
    got = {(int(q), int(n)) for qs, ns in search_forest(fps, forest, fps, roots, 2) for q, n in zip(qs, ns)}
    want = {(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero((np.bitwise_count(fps ^ fps[i]) <= 2) & (shard == shard[i]))}
    assert got == want


@pytest.mark.parametrize("tree_size", [2048, 3])
def test_simhash_is_brute_force(spark, tree_size):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(12)]
    texts = base + [t + " " + rng.choice(words) for t in base for _ in range(5)] + [base[0]] * 4 + ["", None, " \n ", "one", "One", LONG]
    docs = docs_of(spark, texts).union(docs_of(spark, [base[1], None, ""], [None, None, 7]))
    rows = [(r.id, r.fp & (1 << 64) - 1, r.component) for r in simhash_components(docs, tree_size=tree_size).collect()]
    fps = {f for _, f, _ in rows}
    label = plain_components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for i, f, _ in rows:
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    assert len(rows) == docs.count()
    assert all(c == least[label[f]] for _, f, c in rows)


def test_simhash_of_nothing(spark):
    assert simhash_components(docs_of(spark, ["a"]).limit(0)).count() == 0
    assert similar_components(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_similar_texts_meet(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(400)] for _ in range(30)]
    near = [[*b[:200], "changed", *b[201:]] for b in base]
    found = {r.id: r.component for r in similar_components(docs_of(spark, [" ".join(t) for t in base + near])).collect()}
    assert sum(found[i + 30] == i for i in range(30)) >= 28
    assert len({found[i] for i in range(30)}) == 30


def test_similar_texts_meet_at_the_bound_and_none_below(spark):
    """Pairs of Jaccard similarity just over 0.8 are joined, pairs of 0.7 are not."""
    rng = random.Random(8)
    base = [[f"w{rng.randrange(100_000)}" for _ in range(404)] for _ in range(400)]
    same = [b[:361] + [f"v{rng.randrange(100_000)}" for _ in range(43)] for b in base[:300]]  # 357 of 443 shingles: 0.806
    other = [b[:333] + [f"v{rng.randrange(100_000)}" for _ in range(71)] for b in base[300:]]  # 329 of 471 shingles: 0.699
    texts = [" ".join(t) for t in base + same + other]
    found = {r.id: r.component for r in similar_components(docs_of(spark, texts)).collect()}
    assert sum(found[400 + i] == i for i in range(300)) >= 0.93 * 300
    assert all(found[700 + i] == 700 + i for i in range(100))


@pytest.mark.parametrize("chunk", [8192, 3])
def test_similar_texts_are_brute_force(spark, chunk):
    """No pair at the bound or above is in two components and none below joins any, short texts and shared lines included."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(100_000)}"
    shared = [word() for _ in range(12)]
    texts = []
    for _ in range(400):
        n = rng.choice([6, 8, 13, 40, 200, 400])
        base = shared + [word() for _ in range(n)]
        cut = len(base) - 4 - round((len(base) - 4) * rng.choice([0.08, 0.1, 0.105, 0.11, 0.115, 0.13, 0.2])) + 4
        texts += [base, base[:cut] + [word() for _ in range(len(base) - cut)], base[: -rng.randrange(1, max(2, len(base) // 4))]]
    sets = [frozenset(zip(*(t[i:] for i in range(5)))) for t in texts]
    where, label = {}, list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in {j for g in x for j in where.get(g, ())}:
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                label = [min(label[i], label[j]) if k in (label[i], label[j]) else k for k in label]
        for g in x:
            where.setdefault(g, []).append(i)
    found = {r.id: r.component for r in similar_components(docs_of(spark, [" ".join(t) for t in texts]), chunk=chunk).collect()}
    assert [found[i] for i in range(len(texts))] == label


@pytest.mark.parametrize("n", [10_000, 1_000_000, 30_000_000])
def test_similar_recall_holds_at_any_size(n):
    """Pairs at the bound: some mask agrees, the tree's bits are within its radius and all bits within theirs."""
    width, cuts, radius, most = _cuts(n, 0.8, 0.95)
    rng = np.random.default_rng(4)
    masks = np.array([np.isin(np.arange(256), rng.choice(256, width, replace=False)) for _ in range(cuts)])
    differ = rng.random((4000, 256)) < _bits_apart(0.8)
    agree = (differ.astype(np.int16) @ masks.T.astype(np.int16) == 0).any(1)
    assert (agree & (differ[:, :64].sum(1) <= radius) & (differ.sum(1) <= most)).mean() >= 0.935


# --- BPE ---------------------------------------------------------------------------------


def test_encoding_is_the_librarys(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(4)
    chars = [chr(c) for c in [*range(1, 0x180), *range(0x300, 0x340), *range(0x390, 0x3C9), 0x3000, 0x2028, 0xAC00, 0x1F600]]
    odd = ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 50))) for _ in range(800)]
    odd += ["", " ", "<|startoftext|>Hi<|ENDOFTEXT|> <|endoftext|>", "it's DON'T we'll 123", "a" * 3000, "日本語 한국어 ก็ 👨‍👩‍👧"]
    for encoder in (WordTrieBPE(tokenizer_path("word_bpe_49k.json")), WordTrieBPE(tokenizer_path("word_bpe_49k.json"), remembered=400)):
        for text, (ids, decoded) in zip(odd + texts, encoder.encode_batch(odd + texts)):
            want = library.encode(text, add_special_tokens=False).ids
            assert ids == " ".join(map(str, want))
            assert decoded == library.decode(want, skip_special_tokens=False)


def test_encoding_of_odd_rows(spark):
    docs = docs_of(spark, [None, "", "Hello world", "Hello world", LONG], [1, None, 3, 3, 4])
    rows = encode_documents(docs, tokenizer_path("word_bpe_49k.json")).collect()
    assert sorted((r.id or 0, len(r.ids), r.decoded[:5]) for r in rows) == [(0, 0, ""), (1, 0, ""), (3, 2, "hello"), (3, 2, "hello"), (4, 30_000, "word<")]
    assert encode_documents(docs.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_op9_digests(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    row = catalog.QUERIES["op9_bpe"](spark, f"{DATA}/sf0.001").where("doc_id = 3").first()
    text = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").where("doc_id = 3").first().text
    ids = library.encode(text, add_special_tokens=False).ids
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# --- token counts --------------------------------------------------------------------------


def test_counts_are_the_unigram_models(spark, texts):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = vocabulary(tokenizer_path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(pieces, 0, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace()
    rng = random.Random(5)
    odd = ["", " ", "  ", "▁", "a▁b", " a  b ", "<0x41> <s>", "a\n\nb"] + ["".join(rng.choice("abet ▁é中") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    counter = CountingViterbi(pieces, 1000)
    for t in odd + texts[:60]:
        assert counter.document(t)[0] == len(library.encode(t, add_special_tokens=False).ids)


def test_count_ties_and_scores():
    # Equal scores: the candidate that starts first stays.
    counter = CountingViterbi([("<unk>", 0), ("▁ab", -4), ("▁a", -2), ("b", -2), ("▁", -1), ("a", -1)], 10)
    assert counter.search("▁ab") == (-4, 1)
    assert counter.search("▁z") == (-1 - 14, 2)


def test_fractional_scores_are_the_librarys():
    from tokenizers import Tokenizer, models, pre_tokenizers

    rng = random.Random(16)
    pieces = [("<unk>", 0.0), ("▁", -1.25), *((c, -2.0 - i / 7) for i, c in enumerate("abcd")), *(("".join(rng.choice("abcd") for _ in range(n)), -3.0 - rng.random() * n) for n in (2, 2, 2, 3, 3, 4)), ("▁ab", -2.75)]
    pieces = list(dict(pieces).items())
    library = Tokenizer(models.Unigram(pieces, 0, False))
    library.pre_tokenizer = pre_tokenizers.Metaspace()
    counter = CountingViterbi(pieces, 1000)
    for _ in range(300):
        t = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 40)))
        assert counter.document(t)[0] == len(library.encode(t, add_special_tokens=False).ids)


def test_count_odd_rows(spark):
    docs = docs_of(spark, [None, "", "a b", "a b", "x" * 100_000, LONG], [1, None, 3, 3, 5, 6])
    rows = count_tokens(docs, tokenizer_path("piece_bpe_32k.model")).collect()
    assert sorted((r.id or 0, r.n_tokens) for r in rows)[:4] == [(0, 0), (1, 0), (3, 2), (3, 2)]
    counter = CountingViterbi(vocabulary(tokenizer_path("piece_bpe_32k.model")), 10)
    assert {r.id: r.n_tokens for r in rows if (r.id or 0) > 4} == {5: counter.search("▁" + "x" * 100_000)[1], 6: 30_000 * counter.search("▁word")[1] + counter.search("▁")[1]}
    assert count_tokens(docs.limit(0), tokenizer_path("piece_bpe_32k.model")).count() == 0


# --- languages ---------------------------------------------------------------------------------


def test_gradients(monkeypatch):
    """Every weight's gradient by back-propagation is the difference quotient of the loss."""
    model = ByteBiGRU(["a", "b", "c"], hidden=3, seed=1)
    spans, langs = [b"abca", b"xy", b"q"], np.array([0, 1, 2])
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}

    def loss():
        xs, lengths = _matrix(spans)
        p, live = model.positions(xs, lengths)
        return float((-np.log(p[:, np.arange(3), langs]) * live.T / lengths).sum() / 3)

    before, found = {k: v.copy() for k, v in model.w.items()}, {}
    # One step of one batch, whose moments at step 1 give the gradient back.
    monkeypatch.setattr(np, "zeros_like", lambda v, like=np.zeros_like: found.setdefault(len(found), like(v)))
    model.train(spans, langs, epochs=1, batch=3, least_steps=1)
    monkeypatch.undo()
    first = [found[2 * i] for i in range(len(before))]
    model.w = before
    for (k, v), m in zip(before.items(), first):
        for at in np.ndindex(v.shape):
            if k[0] == "x" and at[0] not in b"abcxyq":
                continue
            kept, quotient = v[at], 0.0
            for sign in (1, -1):
                v[at] = kept + sign * 1e-4
                quotient += sign * loss() / 2e-4
            v[at] = kept
            assert abs(quotient - m[at] / 0.1) < 2e-4, (k, at)


def test_spans_are_brute_force():
    """The sums of the batched run are those of the whole distributions, one span at a time."""
    rng = random.Random(15)
    model = ByteBiGRU(["a", "b", "c"], hidden=4, seed=3)
    texts = ["".join(rng.choice("ab é中\n") for _ in range(rng.randrange(1, 400))) for _ in range(40)] + ["", "x", LONG]
    for text, (lang, score) in zip(texts, model.predict(texts, at_once=1000)):
        total, raw = np.zeros(3), text.encode()
        assert b"".join(_cut(raw)) == raw and all(0 < len(x) <= 128 and x.decode() for x in _cut(raw))
        for span in _cut(raw)[: 1 << 30 if len(raw) < 5000 else 0]:
            p, _ = model.positions(*_matrix([span]))
            total += p[:, 0].sum(0)
        if not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0.0)
        elif len(raw) < 5000:
            assert lang == model.langs[int(total.argmax())] and abs(score - total.max() / len(raw)) < 1e-4


def test_languages_of_held_out_rows(spark):
    found = catalog.QUERIES["op10_language"](spark, f"{DATA}/sf0.01").where("held_out").join(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 250 and right / n > 0.98


def test_language_without_spaces(spark):
    """Words of any length are learned as well as predicted."""
    rng = random.Random(5)
    signs, words = [chr(0x4E00 + i) for i in range(60)], ["the", "house", "is", "near", "and", "dog"]

    def rows(n, start):
        zh = docs_of(spark, ["".join(rng.choice(signs) for _ in range(100)) for _ in range(n)], [*range(start, start + n)]).withColumn("lang", F.lit("zh"))
        return docs_of(spark, [" ".join(rng.choice(words) for _ in range(30)) for _ in range(n)], [*range(start + n, start + 2 * n)]).withColumn("lang", F.lit("en")).union(zh)

    model = train_language_model(rows(30, 0), epochs=30)
    held_out = identify_languages(rows(10, 1000), model).collect()
    assert [r.lang_pred for r in held_out] == [r.lang for r in held_out]


def test_language_of_odd_rows(spark):
    train = docs_of(spark, ["the cat and dog " * 5, "the house is near " * 5]).withColumn("lang", F.lit("en")).union(docs_of(spark, ["der hund und katze " * 5, "das haus ist nahe " * 5], [8, 9]).withColumn("lang", F.lit("de")))
    model = train_language_model(train, epochs=30)
    docs = docs_of(spark, [None, "", "123 !!", "der und haus", "der und haus", LONG], [1, 2, 3, 4, 4, None])
    rows = identify_languages(docs, model).collect()
    assert len(rows) == 6 and len(rows[0]) == 9
    by = {(r.doc_id, (r.text or "")[:3]): (r.lang_pred, r.lang_score) for r in rows}
    assert all(by[k] == ("und", 0.0) for k in [(1, ""), (2, ""), (3, "123")])
    assert by[4, "der"][0] == "de" and 0 < by[4, "der"][1] <= 1
    assert identify_languages(docs.limit(0), model).count() == 0
    assert train_language_model(docs.limit(0)) is None
    assert {r.lang_pred for r in identify_languages(docs, None).collect()} == {"und"}


# --- quality ----------------------------------------------------------------------------------------


def test_ranker_orders_pairs():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 5))
    good = x @ np.array([1.0, -2, 0, 0, 0.5]) + rng.normal(size=600) * 0.2 > -1
    ranker = fit_pairs(x, good, pairs=20_000)
    s = ranker.score(x)
    assert (s[good][:, None] > s[~good][None]).mean() > 0.98 and ((s >= 0.3) == good).mean() > 0.93
    assert fit_pairs(x, np.ones(600, bool)).score(x).min() >= 0.3 and fit_pairs(x, np.zeros(600, bool)).score(x).max() < 0.3


def test_ranker_takes_all_pairs():
    """The gradient over every pair, listed here, is nothing at the weights; the threshold is the quantile of all scores."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 4)) * [1, 5, 0.1, 1]
    x[0, 3] = 400.0
    good = x @ np.array([1.0, -0.2, 0, 0]) + rng.normal(size=300) > -0.5
    ranker = fit_pairs(x, good)
    z = (x - x.mean(0)) / x.std(0)
    d = (z[good][:, None] - z[~good][None]).reshape(-1, 4)
    gradient = d.T @ (1 / (1 + np.exp(d @ ranker.weights))) / len(d) - 1e-3 * ranker.weights
    assert np.abs(gradient).max() < 1e-7 and np.abs(ranker.weights).max() > 0.5
    assert ranker.threshold == pytest.approx(np.quantile(z @ ranker.weights, (~good).mean()), abs=1e-12)


def test_ranker_takes_all_labels(spark):
    """Spark's sums over all labelled documents are those of one array, and every label counts."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["calm", "LOUD!!", "7", "line\n", "wörd"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    good = [t.count("!") < 8 for t in texts]
    docs = docs_of(spark, texts).repartition(5)
    ids = [r.doc_id for r in docs.orderBy("doc_id").collect()]
    ranker = train_ranker(docs, spark.createDataFrame(list(zip(ids, map(int, good))), "doc_id long, quality int"))
    plain = fit_pairs(np.array([features(t) for t in texts]), np.array(good))
    assert ranker.mean == pytest.approx(plain.mean) and ranker.weights == pytest.approx(plain.weights, abs=1e-6) and ranker.threshold == pytest.approx(plain.threshold, abs=1e-6)


def test_quality_of_held_out_rows(spark):
    found = catalog.QUERIES["op6_quality"](spark, f"{DATA}/sf0.01").where("held_out").join(spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"), "doc_id")
    right, n = found.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right / n > 0.95


def test_quality_of_odd_rows(spark):
    docs = docs_of(spark, ["A calm line of words.", None, "", "A calm line of words.", "LOUD!! LOUD!!", LONG], [1, 2, None, 1, 5, 6])
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, None), (None, 1), (99, 0)], "doc_id long, quality int")
    rows = score_quality(docs, train_ranker(docs, labels)).collect()
    assert len(rows) == 6 and all(0 <= r.quality_score <= 1 for r in rows)
    assert len({r.quality_score for r in rows if r.doc_id == 1}) == 1
    assert {r.quality_score for r in rows if not r.text}.__len__() == 1
    assert score_quality(docs.limit(0), train_ranker(docs, labels.limit(0))).count() == 0
    assert len(features(None)) == len(features("x y")) and np.isfinite(features("")).all()


def test_workers_give_back_what_earlier_tasks_left():
    code = """
import re
from pathlib import Path
from quern.llm import bpe_trie, token_count
from quern.llm._store import lean_memory
from quern.llm.queries_text import tokenizer_path

def mb():
    return sum(map(int, re.findall(r"Anonymous:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

lean_memory()
began = mb()
used = [bytes(100_000) for _ in range(3000)] + [bytearray(i % 100 + 30_000) for i in range(2000)]
for b in used[3000:]:
    b[0] = 1
pins = used[::50]
del used, b
path = tokenizer_path("word_bpe_49k.json")
assert bpe_trie._encoder(path, 9) is bpe_trie._encoder(path, 9)
lean_memory(bpe_trie._encoder)
assert bpe_trie._encoder.cache_info().currsize == 1
lean_memory(token_count._counter)
assert bpe_trie._encoder.cache_info().currsize == 0
print(began, mb())
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert not said.returncode, said.stderr
    began, after = map(float, said.stdout.split())
    assert after < began + 60
