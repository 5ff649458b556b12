"""Queries of the remaining training-data operators, with DuckDB SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import line_chunks, mixture_raking, sharding_hilbert
from quern.llm.embedding_collisions import near_duplicates
from quern.llm.quality_ranker import AT_THRESHOLD, score_quality, train_ranker
from quern.llm.queries_text import documents, tokenizer_path
from quern.llm.token_count import count_tokens
from quern.llm.topk_mih import nearest_codes, sign_code

_NOT_BLANK = "[^ \\t\\n\\x0B\\f\\r]"


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


_OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), named AS (
  SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.x = e.vec_id) AS n_links,
         least(e.vec_id, coalesce((SELECT min(r.y) FROM reach r WHERE r.x = e.vec_id), e.vec_id)) AS component_id
  FROM embeddings e)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM named
"""


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = mixture_raking.mix(documents(spark, sf_dir))
    return kept.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_probability", 9).alias("probability"))


def _op4_sql(power: float = 0.7, keep: float = 0.5, rounds: int = 20) -> str:
    parts = [
        f"d AS (SELECT doc_id, text, source, lang, len(regexp_extract_all(coalesce(text, ''), '{_NOT_BLANK}+')) AS n, CASE WHEN NOT regexp_matches(coalesce(text, ''), '{_NOT_BLANK}') THEN 'blank' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!! ') THEN 'loud' WHEN regexp_matches(text, '[0-9]{{4}}') THEN 'numeric' WHEN regexp_matches(text, '[$%&#*]{{3}}') THEN 'noisy' ELSE 'prose' END AS topic FROM documents)",
        "c AS (SELECT source, lang, topic, sum(n)::DOUBLE AS t FROM d GROUP BY ALL HAVING sum(n) > 0)",
    ]
    for k in mixture_raking.MARGINALS:
        parts.append(f"g_{k} AS (SELECT {k}, g / sum(g) OVER () AS goal FROM (SELECT {k}, pow(sum(t) / (SELECT sum(t) FROM c), {power}) AS g FROM c GROUP BY {k}))")
    goals = ", ".join(f"g_{k}.goal AS goal_{k}" for k in mixture_raking.MARGINALS)
    joins = " ".join(f"JOIN g_{k} ON c.{k} IS NOT DISTINCT FROM g_{k}.{k}" for k in mixture_raking.MARGINALS)
    parts.append(f"r0 AS (SELECT c.*, {goals}, t * {keep} AS w, sum(t) OVER () AS total FROM c {joins})")
    steps = [k for _ in range(rounds) for k in mixture_raking.MARGINALS]
    for i, k in enumerate(steps):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT * REPLACE (least(t, w * goal_{k} * {keep} * total / sum(w) OVER (PARTITION BY {k})) AS w) FROM r{i})")
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, d.source, d.lang, d.topic, n::BIGINT AS n_tokens, round(w / t, 9) AS probability FROM d JOIN r{len(steps)} r ON d.source IS NOT DISTINCT FROM r.source AND d.lang IS NOT DISTINCT FROM r.lang AND d.topic = r.topic"
        " WHERE n > 0 AND ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0 < w / t"
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding_hilbert.hilbert_shards(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _op5_sql(bits: int = 5, shards: int = 8, run: int = 65_536) -> str:
    table = sharding_hilbert.curve_table(3)
    steps = " + ".join(f"(size >= {round(2 ** (k / 1.5))})::BIGINT" for k in range(1, 1 << bits))
    parts = [
        # One step of the reflected CRC for each value of a byte, by its rule.
        "crc AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce([b] || range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM range(256) x(b)))",
        "d0 AS (SELECT doc_id, lang, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents)",
        "d1 AS (SELECT doc_id, lang, source, size, xor(4294967295, list_reduce([4294967295] || list_transform(range(size - 1), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT), lambda v, b: xor(v >> 8, t[(xor(v, b) & 255) + 1]))) AS crc FROM d0, crc)",
    ]
    for k, c in ((1, "lang"), (2, "source")):
        parts.append(f"q{k} AS (SELECT {c}, ((row_number() OVER (ORDER BY {c} NULLS FIRST) - 1) * {1 << bits}) // count(*) OVER () AS code FROM (SELECT DISTINCT {c} FROM d1))")
    parts.append(f"l{bits} AS (SELECT doc_id, size, crc, {steps} AS c0, q1.code AS c1, q2.code AS c2, 0::BIGINT AS h, 0::BIGINT AS s FROM d1 JOIN q1 ON d1.lang IS NOT DISTINCT FROM q1.lang JOIN q2 ON d1.source IS NOT DISTINCT FROM q2.source)")
    for i in reversed(range(bits)):
        parts.append(f"m{i} AS (SELECT *, {table}[s * 8 + ((c0 >> {i}) & 1) + 2 * ((c1 >> {i}) & 1) + 4 * ((c2 >> {i}) & 1) + 1] AS e FROM l{i + 1})")
        parts.append(f"l{i} AS (SELECT * EXCLUDE (e) REPLACE (h * 8 + (e & 7) AS h, e >> 3 AS s) FROM m{i})")
    mixed = f"(((coalesce(doc_id, 0) % {sharding_hilbert.SPLIT_MODULUS} + {sharding_hilbert.SPLIT_MODULUS}) % {sharding_hilbert.SPLIT_MODULUS}) * {sharding_hilbert.SPLIT_FACTOR} + crc) % 4294967296"
    parts.append(f"p AS (SELECT *, floor(({mixed}) * ceil(count(*) OVER (PARTITION BY c0, c1, c2) / {float(run)}) / 4294967296.0) AS part, count(*) OVER () AS n FROM l0)")
    parts.append("o AS (SELECT *, row_number() OVER (ORDER BY h, part, doc_id NULLS FIRST, size, crc) - 1 AS a FROM p)")
    parts.append(f"f AS (SELECT *, n // {shards} AS base, n % {shards} AS more FROM o)")
    parts.append("z AS (SELECT *, CASE WHEN a < more * (base + 1) THEN a // (base + 1) ELSE more + (a - more * (base + 1)) // greatest(base, 1) END AS shard FROM f)")
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard, (a - CASE WHEN shard < more THEN shard * (base + 1) ELSE more * (base + 1) + (shard - more) * base END)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM z"


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    ranker = train_ranker(docs.where(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out))
    found = score_quality(docs.select("doc_id", "text"), ranker)
    return found.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= AT_THRESHOLD).cast("int").alias("predicted"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return nearest_codes(codes.where("id % 100 = 0"), codes)


_OP7_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) >= 1 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0
), p AS (
  SELECT q.id AS query_id, c.id AS neighbor_id, len(list_filter(range(greatest(len(q.s), len(c.s))), lambda i: coalesce(q.s[i + 1], false) <> coalesce(c.s[i + 1], false))) AS distance
  FROM v q JOIN v c ON q.id % 100 = 0 AND q.id <> c.id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM p)
SELECT query_id, rank::BIGINT AS rank, neighbor_id, distance::BIGINT AS distance FROM r WHERE rank <= 10
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_chunks.drop_repeated_chunks(documents(spark, sf_dir))
    return kept.select("doc_id", "removed_chunks", "removed_lines", F.md5("text").alias("text_md5"))


_OP8_SQL = f"""
WITH d AS (SELECT DISTINCT coalesce(doc_id, 9223372036854775807) AS i, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT i, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM l),
b AS (SELECT *, ((coalesce(lag(h) OVER w, 0) * {line_chunks.FACTOR} + h) % {line_chunks.MODULUS}) % 3 = 0 AS ends FROM h WINDOW w AS (PARTITION BY i, text ORDER BY n)),
c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY i, text ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM b),
k AS (SELECT i, text, place, count(*) AS n, string_agg(line, chr(10) ORDER BY c.n) AS chunk FROM c GROUP BY i, text, place),
g AS (SELECT *, n >= 2 AND row_number() OVER (PARTITION BY chunk ORDER BY i, text, place) > 1 AS gone FROM k),
t AS (SELECT i, text, count(*) FILTER (gone) AS removed_chunks, coalesce(sum(n) FILTER (gone), 0) AS removed_lines, coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (NOT gone), '') AS kept FROM g GROUP BY i, text)
SELECT s.doc_id, coalesce(removed_chunks, 0)::BIGINT AS removed_chunks, coalesce(removed_lines, 0)::BIGINT AS removed_lines, md5(t.kept) AS text_md5
FROM documents s LEFT JOIN t ON coalesce(s.doc_id, 9223372036854775807) = t.i AND s.text = t.text
"""

QUERIES = {
    "op2_token_count": op2_token_count,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_mixture": op4_mixture,
    "op5_sharding": op5_sharding,
    "op6_quality": op6_quality,
    "op7_topk": op7_topk,
    "op8_line_dedup": op8_line_dedup,
}
ORACLES = {"op3_embedding_dedup": _OP3_SQL, "op4_mixture": _op4_sql(), "op5_sharding": _op5_sql(), "op7_topk": _OP7_SQL, "op8_line_dedup": _OP8_SQL}
