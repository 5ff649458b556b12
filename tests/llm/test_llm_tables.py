"""Embeddings, mixtures, shards, codes, line chunks and the pipeline against brute force and SQL."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import catalog
from quern.llm._components import components
from quern.llm.embedding_collisions import _band_keys, _pairs_of, near_duplicates
from quern.llm.language_bigru import identify_languages
from quern.llm.line_chunks import FACTOR, MODULUS, drop_repeated_chunks, drop_repeated_passages
from quern.llm.mixture_raking import MARGINALS, _rake_frame, mix, mixing_plan, n_words, rake, topic_of
from quern.llm.quality_ranker import score_quality, train_ranker
from quern.llm.sharding_hilbert import curve_index, curve_table, hilbert_shards, write_shards
from quern.llm.topk_mih import _segments, nearest_codes, sign_code

from ..conftest import DATA
from ..test_catalog import TABLES
from .test_llm_text import LONG, docs_of


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, f"{DATA}/sf0.001")
    relation = duck.sql(catalog.ORACLES[name])
    wanted = [dict(zip(relation.columns, r)) for r in relation.fetchall()]
    key = lambda r: repr(sorted(r.items()))
    assert sorted(key(r.asDict()) for r in found.collect()) == sorted(map(key, wanted))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    label = {i: i for i in range(200)}
    for _ in range(200):
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    touched = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, label[x]) for x in touched}


# --- embeddings ------------------------------------------------------------------------


def vectors(n, dim=32, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n // 2 : n // 2 + n // 4] = x[: n // 4] + rng.normal(size=(n // 4, dim)) * 0.3
    x[-n // 8 :] = x[0] + rng.normal(size=(n // 8, dim)) * 0.05
    return x


@pytest.mark.parametrize("block", [1024, 16])
def test_links_are_brute_force(spark, block):
    x = vectors(400)
    rows = [(i, [float(c) for c in v], "clash") for i, v in enumerate(x)] + [(900, [float(c) for c in x[3]], ""), (901, None, ""), (902, [0.0] * 32, ""), (903, [float("nan")] * 32, ""), (904, [1.0, None], ""), (None, [float(c) for c in x[3]], ""), (905, [1.0, 2.0], ""), (906, [2.0, 4.0], "")]
    found = {r.id: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string"), block=block).collect()}
    full = np.concatenate([x, x[3:4], x[3:4]])
    u = full / np.linalg.norm(full, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    want = linked.sum(1)
    ids = [*range(400), 900, None]
    got = np.array([found[i].n_links for i in ids])
    assert got.sum() >= 0.99 * want.sum() and (got <= want).all()
    assert (found[900].n_links, found[900].component, found[900].kept) == (want[400], found[3].component, False)
    assert all((found[i].n_links, found[i].component, found[i].kept) == (0, i, True) for i in (901, 902, 903, 904))
    assert found[905].n_links == found[906].n_links == 1 and found[906].component == 905


def test_longer_vectors_cost_the_others_no_links(spark):
    """Vectors of other lengths never link, so links of the rest are the same with and without them."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 64))
    y = x + rng.normal(size=x.shape) * 0.45  # cosine about 0.91
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(np.concatenate([x, y]))]
    strays = [(10_000, [float(c) for c in rng.normal(size=768)]), (10_001, [1.0, 2.0]), (10_002, [2.0, 4.0])]
    u = np.concatenate([x, y])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum() - len(u)
    found = near_duplicates(spark.createDataFrame(rows + strays, "vec_id long, embedding array<double>")).collect()
    assert 0.98 * want <= sum(r.n_links for r in found if r.id < 10_000) <= want
    assert {r.id: r.n_links for r in found if r.id >= 10_000} == {10_000: 0, 10_001: 1, 10_002: 1}


@pytest.mark.parametrize("n", [10_000, 1_000_000, 100_000_000])
def test_pairs_at_the_bound_share_a_block_at_any_size(n):
    """Pairs of cosine 0.9 have a key in common, and enough collisions, whatever the size of the table."""
    rng = np.random.default_rng(14)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(0.19) * y / np.linalg.norm(y, axis=1, keepdims=True)
    both = np.concatenate([x, y])
    raw = pa.array([v.tobytes() for v in both], pa.binary())
    ones = pa.array([1] * len(both), pa.int64())
    batch = pa.RecordBatch.from_arrays([ones, ones, raw, pa.array([512] * len(both), pa.int32()), pa.array([n] * len(both), pa.int64())], ["node", "size", "vec", "length", "n"])
    keys = np.array(next(_band_keys(0.9, 0.995, "<f8", 17)(iter([batch]))).column(4).to_pylist())
    shared = (keys[:1500] == keys[1500:]).any(1)
    enough = [len(next(_pairs_of(both[[i, 1500 + i]], 0, np.zeros((2, 0), np.int64), 0.9 - 1e-9, 17), ([], []))[0]) for i in range(1500)]
    assert shared.mean() >= 0.99 and np.mean(enough) >= 0.997


def test_no_vectors(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- mixtures -------------------------------------------------------------------------------


def test_raking_meets_targets():
    rng = np.random.default_rng(2)
    cells = [(s, g, t) for s in "ab" for g in ("x", "y", None) for t in "pq"]
    tokens = rng.uniform(50, 100, len(cells))
    targets = [{"a": 0.4, "b": 0.6}, {"x": 0.3, "y": 0.4, None: 0.3}, {"p": 0.5, "q": 0.5}]
    w = rake(cells, tokens, targets, 0.4, 60)
    for i, target in enumerate(targets):
        for v, share in target.items():
            assert sum(x for c, x in zip(cells, w) if c[i] == v) / w.sum() == pytest.approx(share, abs=1e-6)
    assert (w <= tokens).all() and w.sum() == pytest.approx(0.4 * tokens.sum())


def test_both_ways_of_raking_agree(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    cells = docs.select("source", "lang", topic_of(F.col("text")).alias("topic"), n_words(F.col("text")).alias("t")).groupBy(*MARGINALS).agg(F.sum("t").cast("double").alias("tokens"))
    a = {tuple(r)[:3]: r.probability for r in mixing_plan(cells, rounds=3).collect()}
    b = {tuple(r)[:3]: r.probability for r in _rake_frame(cells.where("tokens > 0"), 0.7, 0.5, 3).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)



def test_plan_of_cells_needs_no_python_workers(spark):
    cells = spark.createDataFrame([("a", "x", None, 3.0), (None, "y", "prose", 1.0)], "source string, lang string, topic string, tokens double")
    for some in (cells, cells.limit(0)):
        plan = mixing_plan(some)
        assert "LogicalRDD" not in plan._jdf.queryExecution().analyzed().toString()
        assert {tuple(r)[:3] for r in plan.collect()} == {tuple(r)[:3] for r in some.collect()}
        assert plan.schema.simpleString() == "struct<source:string,lang:string,topic:string,probability:double>"


def test_mixture_of_odd_rows(spark):
    docs = docs_of(spark, ["some words here", None, "", "more words", "more words", LONG], [1, 2, 3, 4, 4, None]).withColumn("lang", F.when(F.col("doc_id") != 1, F.col("lang"))).withColumn("mix_topic", F.lit("clash"))
    rows = mix(docs, keep=1.0).collect()
    assert {(r.doc_id, r.mix_tokens) for r in rows} == {(1, 3), (4, 2), (None, 30_000)} and len(rows) == 4
    assert mix(docs.limit(0)).count() == 0
    half = mix(docs, keep=0.5)
    assert sorted(map(str, half.collect())) == sorted(map(str, half.collect()))


# --- shards ------------------------------------------------------------------------------------


def test_curve_is_continuous(spark):
    for n, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = spark.range(side**n).select(*(F.floor(F.col("id") / side**k).cast("long").bitwiseAND(side - 1).alias(f"c{k}") for k in range(n)))
        rows = sorted(cells.select("*", curve_index([F.col(f"c{k}") for k in range(n)], bits).alias("h")).collect(), key=lambda r: r.h)
        assert [r.h for r in rows] == [*range(side**n)]
        assert all(sum(abs(a[k] - b[k]) for k in range(n)) == 1 for a, b in zip(rows, rows[1:]))
    assert len(curve_table(3)) == 192


@pytest.mark.parametrize("run", [65_536, 4])
def test_shards_are_even_and_gapless(spark, run, tmp_path):
    texts = [None, "", "a", "a", "aé", LONG] + [f"text {i}" for i in range(40)] + ["same"] * 30
    docs = docs_of(spark, texts, [None, 1, 2, 2, *range(4, len(texts))]).withColumn("shard", F.lit("clash")).withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    placed = hilbert_shards(docs, run=run)
    rows = placed.collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r["size"] == len((r.text or "").encode()) + 1
        assert r.text_crc32 == __import__("zlib").crc32((r.text or "").encode())
    assert sorted(by) == [*range(8)] and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == [*range(len(s))] for s in by.values())
    write_shards(placed.select("doc_id", "text", "shard", "slot"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(texts)
    assert hilbert_shards(docs.limit(0)).count() == 0
    assert hilbert_shards(docs.limit(3)).select("shard", "slot").distinct().count() == 3


# --- codes ----------------------------------------------------------------------------------------


def test_nearest_codes_are_brute_force(spark):
    rng = np.random.default_rng(3)
    codes = rng.integers(-(1 << 63), (1 << 63) - 1, 300)
    codes[100:140] = codes[0]
    codes[140:200] = codes[1] ^ (np.int64(1) << rng.integers(0, 62, 60))
    rows = [(i, int(c)) for i, c in enumerate(codes)] + [(3, int(codes[3])), (None, 5), (400, None)]
    table = spark.createDataFrame(rows, "id long, code long")
    found = nearest_codes(table.where("id % 50 = 0 OR id IS NULL"), table, k=7)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbor_id))
    bits = codes.view(np.uint64)
    for q in range(0, 300, 50):
        near = sorted((int(np.bitwise_count(bits[q] ^ c)), i) for i, c in enumerate(bits) if i != q)[:7]
        assert sorted(got[q]) == [(k + 1, d, i) for k, (d, i) in enumerate(near)]
    few = nearest_codes(table.where("id = 0"), table.where("id < 4"), k=7)
    assert few.count() == 3
    assert nearest_codes(table.limit(0), table, k=2).count() == 0 and nearest_codes(table.where("id = 1"), table.limit(0), k=2).count() == 0


def test_sign_codes(spark):
    rows = [([1.0, -1.0, 0.5],), (None,), ([],), ([1.0, None],), ([float("nan")],), ([1.0] * 64,), ([1.0] * 65,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<double>").select(sign_code(F.col("v"))).collect()]
    assert got == [[5], None, None, None, None, [-1], [-1, 1]]


def test_nearest_long_vectors_are_brute_force(spark):
    """Vectors of over 64 components, of several lengths: a component that one lacks is not over zero."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(120, 100))
    x[60:] = x[:60] + rng.normal(size=(60, 100)) * 0.3
    vectors = [[float(c) for c in v[: (100, 70, 3)[i % 3]]] for i, v in enumerate(x)]
    table = spark.createDataFrame([(i, v, "clash", 1) for i, v in enumerate(vectors)], "id long, v array<double>, seg string, val int").withColumn("code", sign_code(F.col("v")))
    got = {}
    for r in nearest_codes(table.where("id % 10 = 0"), table, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbor_id))
    bits = [{j for j, c in enumerate(v) if c > 0} for v in vectors]
    for q in range(0, 120, 10):
        near = sorted((len(bits[q] ^ b), i) for i, b in enumerate(bits) if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, d, i) for k, (d, i) in enumerate(near)]


def test_segments_follow_the_table():
    widths = [{w for *_, w in _segments(n, 1)} for n in (3, 500, 51_000, 10**7, 10**9, 10**12)]
    assert widths[0] == {8} and widths[2] == {12, 13} and widths[4] == widths[5] == {21, 22}
    assert all(sum(w for *_, w in _segments(n, 2)) == 128 for n in (1, 500, 10**7))

# --- line chunks ------------------------------------------------------------------------------------


def plain_chunks(text):
    import hashlib

    lines = text.split("\n")
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    out, run = [], []
    for i, line in enumerate(lines):
        run.append(line)
        if ((hashes[i - 1] if i else 0) * FACTOR + hashes[i]) % MODULUS % 3 == 0 or i == len(lines) - 1:
            out.append(run)
            run = []
    return out


def test_chunks_are_brute_force(spark):
    rng = random.Random(7)
    passage = [f"passage line {i}" for i in range(25)]
    texts = []
    for i in range(40):
        own = [f"own {i} {rng.random()}" for _ in range(rng.randrange(12))]
        cut = rng.randrange(len(own) + 1)
        texts.append("\n".join(own[:cut] + (passage if i % 3 == 0 else []) + own[cut:]))
    texts += [None, "", "\n\n\n", "\n\n\n", "single", "single", LONG, texts[0]]
    ids = [*range(len(texts))]
    docs = docs_of(spark, texts, ids).union(docs_of(spark, [texts[3], texts[6]], [3, None])).withColumn("removed_lines", F.lit("clash"))
    seen, want = set(), {}
    for i, t in sorted([*zip(ids, texts), (1 << 62, texts[6])], key=lambda x: x[0]):
        if t is None:
            want[i] = None
            continue
        kept = []
        for c in plain_chunks(t):
            k = "\n".join(c)
            if len(c) >= 2 and k in seen:
                continue
            if len(c) >= 2:
                seen.add(k)
            kept.append(k)
        want[i] = "\n".join(kept)
    rows = drop_repeated_chunks(docs).collect()
    assert len(rows) == docs.count() and sum(r.removed_chunks for r in rows) > 10
    assert all(r.text == want[(1 << 62) if r.doc_id is None else r.doc_id] for r in rows)
    assert drop_repeated_chunks(docs.limit(0)).count() == 0


def test_passages_are_brute_force(spark):
    rng = random.Random(9)
    texts = []
    for i in range(60):
        own = [f"own {i} {j}" for j in range(rng.randrange(1, 8))]
        length = 2 + i % 5
        passage = [f"passage of {length}, line {j}" for j in range(length)]
        texts.append("\n".join(own + passage + [f"end {i}"]))
    texts += [None, "", "\n\n\n", "single", "single", LONG, texts[0], "x\nx\nx\ny"]
    docs = docs_of(spark, texts, [*range(len(texts))]).union(docs_of(spark, [texts[3], texts[66]], [3, None])).withColumn("removed_lines", F.lit("clash"))
    seen, want = set(), {}
    for i, t in enumerate([*texts, texts[66]]):
        lines = (t or "").split("\n")
        pairs, gone = [*zip(lines, lines[1:])], set()
        for j, p in enumerate(pairs):
            gone |= {j, j + 1} if p in seen else set()
            seen.add(p)
        want[i] = t if not gone else "\n".join(x for j, x in enumerate(lines) if j not in gone), len(gone)
    rows = drop_repeated_passages(docs).collect()
    assert len(rows) == docs.count()
    assert all((r.text, r.removed_lines) == want[len(texts) if r.doc_id is None else r.doc_id] for r in rows)
    assert drop_repeated_passages(docs.limit(0)).count() == 0


def test_stage_removes_short_passages(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    texts = [f"own {i}\n" + "\n".join(f"passage of {2 + i % 5}, line {j}" for j in range(2 + i % 5)) + f"\nend {i}" for i in range(50)]
    rows = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)], docs.schema)
    found = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, rows, "").collect()}
    assert found == {i: t if i < 5 else f"own {i}\nend {i}" for i, t in enumerate(texts)}


# --- pipeline ----------------------------------------------------------------------------------------------


def test_stages(spark):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    junk = spark.createDataFrame([(10_001, "123 456", None, "src0", 7), (10_002, None, "en", "src1", None)], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs.union(junk), sf)
    assert kept.columns == docs.columns and kept.count() == n and kept.where("lang IS NULL").isEmpty()
    lines = stages["line_dedup"](spark, docs, sf)
    wrong = lines.where(F.col("n_chars") != F.length("text"))
    assert lines.columns == docs.columns and wrong.isEmpty()
    twice = docs.union(docs.withColumn("doc_id", F.col("doc_id") + 20_000)).union(docs.limit(3))
    single = stages["simhash_dedup"](spark, twice, sf)
    assert single.columns == docs.columns and single.where("doc_id >= 20000").isEmpty() and single.count() == single.select("doc_id").distinct().count()
    mixed = stages["mixture"](spark, docs, sf)
    assert mixed.columns == docs.columns and 0 < mixed.count() < n
    assert stages["bpe"](spark, docs.limit(5), sf).columns == ["doc_id", "ids", "decoded"]


def test_ids_that_repeat_or_lack(spark):
    """Rows without an id, and those that share one, are told apart by their texts in the near-duplicate stage."""
    rng = random.Random(17)
    words = [f"w{i}" for i in range(5000)]
    base = [[rng.choice(words) for _ in range(300)] for _ in range(6)]
    near = [" ".join([*b[:150], "changed", *b[151:]]) for b in base]
    text = [" ".join(b) for b in base]
    rows = [(1, text[0]), (None, near[0]), (None, text[1]), (None, near[1]), (None, text[1]), (2, text[2]), (2, text[3]), (3, near[3]), (4, text[4]), (4, text[4]), (5, None), (6, ""), (0, near[2])]
    docs = spark.createDataFrame([(i, t, "en", "src0", None, "clash", 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _id string, _n int")
    kept = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((99 if r.doc_id is None else r.doc_id, r.text or "") for r in kept.collect())
    # Of the two rows without id and near-equal texts one stays; row 2 with text 2 goes for row 0, row 2 with text 3 stays for row 3.
    assert [i for i, _ in got] == [0, 1, 2, 4, 5, 99] and got[2][1] == text[3] and got[5][1] in (text[1], near[1])


def test_names_that_clash(spark):
    """Columns with the names that operators use inside come back as they were, and change nothing else."""
    texts = [f"line a\nline b\nown {i}\nline a\nline b" for i in range(6)] + [None, "", "x | y 1999"]
    plain = docs_of(spark, texts).select("doc_id", "text", "lang", "source")
    names = ["_id", "_key", "_text", "_new", "_gone", "_lines", "_stay", "_chunks", "_hash", "_part", "_parts", "_at", "_total", "_before", "_c0", "_c1", "_v", "_n", "_source", "_lang", "_topic", "_label", "seg", "val", "mask", "c", "n", "b", "x", "h", "rank", "span", "vec", "node", "fp", "C0"]
    clashing = plain.select("*", *(F.lit(f"clash {n}").alias(n) for n in names))
    model = None
    for f in (drop_repeated_chunks, drop_repeated_passages, mix, hilbert_shards, lambda d: identify_languages(d, model), lambda d: score_quality(d, train_ranker(d, spark.createDataFrame([(1, 1), (8, 0)], "doc_id long, quality int")))):
        want, got = f(plain), f(clashing)
        assert [c for c in got.columns if c not in names] == want.columns
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
        assert got.select(*names).distinct().collect() == [tuple(f"clash {n}" for n in names)]


def test_run(spark):
    out = corpus_pipeline.run(spark, f"{DATA}/sf0.001")
    assert out.count() > 0 and out.where(F.size("ids") == 0).isEmpty()


def test_empty_table_through_the_stages(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, f"{DATA}/sf0.001").count() == 0
