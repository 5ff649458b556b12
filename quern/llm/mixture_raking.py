"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed by cell (source, language, topic). Raking scales the
cells until their sums meet the targets of all three marginals at once, a
share ``keep`` of all tokens being wanted; no cell can give more than it has,
so weights are cut there in each step and the others of its marginals rise. A
document is kept with probability raked weight / tokens of its cell. The draw
is a hash of the seed, the id and the text, so a lost task draws the same again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._store import local_rows, stored, veiled

MARGINALS = ("source", "lang", "topic")
_WORDS = "[^ \\t\\n\\x0B\\f\\r]+"


def n_words(text: Column) -> Column:
    """White-space delimited words of the whole text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A topic by the form of the text, the first that fits."""
    return (
        F.when(~F.coalesce(text, F.lit("")).rlike("[^ \\t\\n\\x0B\\f\\r]"), "blank")
        .when(text.contains(" | "), "table")
        .when(text.contains("!! "), "loud")
        .when(text.rlike("[0-9]{4}"), "numeric")
        .when(text.rlike("[$%&#*]{3}"), "noisy")
        .otherwise("prose")
    )


def tempered(shares: dict, power: float) -> dict:
    """Target shares in proportion to the given ones raised to ``power``."""
    raised = {k: v**power if v > 0 else 0.0 for k, v in shares.items()}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()} if total else raised


def cells_of(docs: DataFrame, tokens: Column, keys: dict[str, Column]) -> DataFrame:
    return docs.select(*(c.cast("string").alias(k) for k, c in keys.items()), tokens.alias("t")).groupBy(*keys).agg(F.sum("t").cast("double").alias("tokens"))


def rake(cells: list[tuple], tokens: np.ndarray, targets: list[dict], keep: float, rounds: int) -> np.ndarray:
    """Raked weights of cells (tuples of marginal values) with positive tokens; none exceeds its tokens."""
    steps = []
    for i, target in enumerate(targets):
        values = [*dict.fromkeys(c[i] for c in cells)]
        at = {v: k for k, v in enumerate(values)}
        steps.append((np.array([at[c[i]] for c in cells]), np.array([target.get(v, 0.0) for v in values]) * keep * tokens.sum()))
    w = tokens * keep
    for _ in range(rounds):
        for code, target in steps:
            have = np.bincount(code, weights=w, minlength=len(target))
            w = np.minimum(tokens, w * np.divide(target, have, out=np.zeros_like(target), where=have > 0)[code])
    return w


def _rake_frame(cells: DataFrame, power: float, keep: float, rounds: int, targets: dict[str, dict] | None = None) -> DataFrame:
    """The same for more cells than the driver should hold; a table is written each round.

    Sums of a marginal are aggregates that come back by a join, so a value
    with most of the cells is one row of each task.
    """
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    shares = cells.withColumn("w", F.col("tokens") * keep)
    goals = {}
    for k in MARGINALS:
        if targets and k in targets:
            goal = local_rows(spark, [(v, float(x)) for v, x in targets[k].items()], "v string, g double")
        else:
            goal = shares.groupBy(F.col(k).alias("v")).agg(F.pow(F.sum("tokens") / total, F.lit(power)).alias("g"))
            goal = goal.withColumn("g", F.col("g") / goal.agg(F.sum("g")).first()[0]) if total else goal
        goals[k] = stored(goal, f"goal_{k}")
    for _ in range(rounds):
        for k in MARGINALS:
            have = shares.groupBy(F.col(k).alias("v")).agg(F.sum("w").alias("have")).alias("h")
            scale = have.join(goals[k].alias("g"), F.col("h.v").eqNullSafe(F.col("g.v")), "left").select(F.col("h.v").alias("v"), F.when(F.col("have") > 0, F.coalesce("g", F.lit(0.0)) * (keep * total) / F.col("have")).otherwise(0.0).alias("scale"))
            shares = shares.join(scale, shares[k].eqNullSafe(scale["v"])).withColumn("w", F.least("tokens", F.col("w") * F.col("scale"))).select(*MARGINALS, "tokens", "w")
        shares = stored(shares, "raked")
    return shares.select(*MARGINALS, (F.col("w") / F.col("tokens")).alias("probability"))


def mixing_plan(cells: DataFrame, power: float = 0.7, keep: float = 0.5, rounds: int = 20, max_cells: int = 100_000, targets: dict[str, dict] | None = None) -> DataFrame:
    """``(source, lang, topic, probability)`` for every cell with tokens.

    ``targets``: wanted shares for each marginal by value; without, the
    shares that the corpus has, raised to ``power`` and scaled to one. Cells
    that the driver should not hold, more than ``max_cells``, are raked by the
    same rounds as joins and aggregates, with the same result.
    """
    spark = cells.sparkSession
    schema = "source string, lang string, topic string, probability double"
    cells = cells.where("tokens > 0")
    rows = cells.limit(max_cells + 1).collect()
    if len(rows) > max_cells:
        return _rake_frame(stored(cells, "cells"), power, keep, rounds, targets)
    keys, tokens = [tuple(r[k] for k in MARGINALS) for r in rows], np.array([r.tokens for r in rows], float)
    if not rows:
        return local_rows(spark, [], schema)
    wanted = []
    for i, k in enumerate(MARGINALS):
        shares: dict = {}
        for key, t in zip(keys, tokens):
            shares[key[i]] = shares.get(key[i], 0.0) + t / tokens.sum()
        wanted.append((targets or {}).get(k) or tempered(shares, power))
    chance = rake(keys, tokens, wanted, keep, rounds) / tokens
    # Bounded by max_cells rows, so documents are not shuffled to meet it.
    return F.broadcast(local_rows(spark, [(*k, float(p)) for k, p in zip(keys, chance)], schema))


def draw(id_col: Column, text_col: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the seed, the id and the text alone."""
    of = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(F.md5(of), 1, 13), 16, 10).cast("double") / float(16**13)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", power: float = 0.7, keep: float = 0.5, rounds: int = 20, seed: str = "mix", targets: dict[str, dict] | None = None, max_cells: int = 100_000) -> DataFrame:
    """The sampled rows of ``docs``, whole, with mix_tokens, mix_topic and mix_probability.

    Null sources and languages are values of their own. Documents without
    words (null, empty or blank texts) have no token weight: they say nothing
    about the mixture and are left out. Texts of any length count whole. Rows
    that repeat id and text are drawn alike; null ids are drawn by their
    texts. An empty table stays empty. Columns that already have one of the
    three names are replaced, others pass through whatever their names.
    """
    docs, (id_col, text_col, source_col, lang_col), restored = veiled(docs.drop("mix_tokens", "mix_topic", "mix_probability"), id_col, text_col, source_col, lang_col)
    keys = {"source": F.col(source_col), "lang": F.col(lang_col), "topic": topic_of(F.col(text_col))}
    plan = mixing_plan(cells_of(docs, n_words(F.col(text_col)), keys), power, keep, rounds, max_cells, targets)
    plan = plan.select(*(F.col(k).alias(f"_{k}") for k in MARGINALS), F.col("probability").alias("mix_probability"))
    rows = docs.withColumn("mix_tokens", n_words(F.col(text_col))).withColumn("mix_topic", keys["topic"])
    on = rows[source_col].cast("string").eqNullSafe(plan["_source"]) & rows[lang_col].cast("string").eqNullSafe(plan["_lang"]) & rows["mix_topic"].eqNullSafe(plan["_topic"])
    kept = rows.where("mix_tokens > 0").join(plan, on)
    return kept.where(draw(F.col(id_col), F.col(text_col), seed) < F.col("mix_probability")).select(*restored(), "mix_tokens", "mix_topic", "mix_probability")
