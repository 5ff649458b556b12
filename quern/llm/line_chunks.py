"""Removal of repeated multi-line chunks, by column expressions only.

A text is cut into lines and each line hashed. A rolling hash over the hashes
of two lines chooses, by its value alone, after which lines a chunk ends; so lines put in or taken out elsewhere move no other boundary, and a
passage shared by two documents is cut alike in both. Of all chunks of two or
more lines that are equal byte for byte, the first by (id, text hash, place)
stays and every other is removed.

Chunk hashes are counted with partial aggregation; texts of chunks are
shuffled only for hashes that occur more than once, and there they are grouped
by the bytes themselves, combined before the shuffle, so a passage of a third
of all documents is one row from each task.

A passage of a few lines seldom holds a whole chunk. ``drop_repeated_passages``
therefore asks of every two lines in succession, instead of every chunk,
whether they came before, and so covers each passage of two lines or more to
its ends, at one narrow row for each line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._store import hinted, stored, veiled

#: The rolling hash: hash of the line before, times this, plus the line's, modulo a prime.
FACTOR, MODULUS = 1_000_003, 2_147_483_647
#: Rows of repeated hashes, and of documents that lose chunks, up to which these narrow tables are broadcast
#: (tens of MB) so that texts stay where they are; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


def line_hash(line: Column) -> Column:
    """28 bits of the MD5 of a line's bytes."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that no optimiser rule merges into what reads them.

    Filters and projections that use a column are otherwise moved below it and
    repeat its whole expression, in a lambda for every element. They don't
    pass a generator, which here makes one row of each.
    """
    return rows.select("*", F.inline_outer(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _with_chunks(rows: DataFrame, text_col: str, divisor: int) -> DataFrame:
    """``rows`` with _chunks: array of structs (n lines, chunk text) in order; null for a null text."""
    rows = _settled(rows, _lines=F.split(F.col(text_col), "\n", -1))
    rows = _settled(rows, _hashes=F.transform("_lines", line_hash))
    last = F.size("_lines") - 1

    def end(h: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("_hashes", i - 1)).otherwise(F.lit(0))
        rolled = F.pmod(before * FACTOR + h, F.lit(MODULUS))
        return F.when((rolled % divisor == 0) | (i == last), i + 1)

    rows = _settled(rows, _ends=F.array_compact(F.transform("_hashes", end)))

    def chunk(stop: Column, i: Column) -> Column:
        start = F.when(i > 0, F.get("_ends", i - 1)).otherwise(F.lit(0))
        return F.struct((stop - start).alias("n"), F.array_join(F.slice("_lines", start + 1, stop - start), "\n").alias("chunk"))

    return _settled(rows, _chunks=F.transform("_ends", chunk)).drop("_lines", "_hashes", "_ends")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with _id (null last) and _key, which tell documents apart; repeated rows are one document."""
    last = F.lit((1 << 63) - 1)
    return docs.withColumn("_id", F.coalesce(F.col(id_col).cast("long"), last)).withColumn("_key", F.xxhash64(F.col(text_col)))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 3) -> DataFrame:
    """(_id, _key, _gone): for each document that loses chunks, the places of those, ascending."""
    rows = _keyed(docs.select(id_col, text_col), id_col, text_col).where(F.col(text_col).contains("\n"))
    chunks = _with_chunks(rows.select("_id", "_key", F.col(text_col).alias("_text")), "_text", divisor)
    chunks = chunks.select("_id", "_key", F.posexplode_outer("_chunks").alias("_place", "_c")).where("_c.n >= 2")
    return _repeats(chunks.select("_id", "_key", "_place", F.xxhash64("_c.chunk").alias("_hash"), F.col("_c.chunk").alias("_chunk")))


def _repeats(chunks: DataFrame) -> DataFrame:
    """(_id, _key, _gone) from chunks (_id, _key, _place, _hash, _chunk): the places of all but the first of equal ones."""
    twice = stored(chunks.groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1").select("_hash"), "repeated_hashes")
    twice = hinted(twice, BROADCAST_ROWS)
    again = stored(chunks.join(twice, "_hash", "left_semi"), "chunks_again")
    first = again.groupBy("_hash", "_chunk").agg(F.min(F.struct("_id", "_key", "_place")).alias("_first"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.select("_hash", "_chunk", "_first"), "first_chunks")
    others = again.join(first, ["_hash", "_chunk"]).where(F.struct("_id", "_key", "_place") != F.col("_first"))
    return others.groupBy("_id", "_key").agg(F.array_sort(F.collect_set("_place")).alias("_gone"))


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 3) -> DataFrame:
    """Every row of ``docs`` with repeated chunks taken out of its text, plus removed_chunks and removed_lines.

    A boundary falls after a line with chance 1 / ``divisor``. Null texts stay
    null, and texts of one line stay as they are. Rows that repeat id and text
    are one document: they keep or lose the same chunks. Documents with equal
    texts and other ids are different documents, of which the smallest id
    keeps the chunks (null ids come last). A text all of whose chunks go is
    left empty. A text of any length is cut whole, and an empty table stays
    empty. Columns that already have one of the two names are replaced, others
    pass through whatever their names.
    """
    docs, (id_col, text_col), restored = veiled(docs.drop("removed_chunks", "removed_lines"), id_col, text_col)
    gone = hinted(stored(repeated_chunks(docs, id_col, text_col, divisor), "gone_chunks"), BROADCAST_ROWS)
    gone = gone.select(F.col("_id").alias("_i"), F.col("_key").alias("_k"), "_gone")
    rows = _keyed(docs, id_col, text_col)
    rows = rows.join(gone, (rows["_id"] == gone["_i"]) & (rows["_key"] == gone["_k"]), "left").drop("_id", "_key", "_i", "_k")
    # Only texts that lose something are cut again.
    rows = _with_chunks(rows.withColumn("_text", F.when(F.col("_gone").isNotNull(), F.col(text_col))), "_text", divisor)
    out = F.filter("_chunks", lambda c, i: F.array_contains("_gone", i))
    kept = F.filter("_chunks", lambda c, i: ~F.array_contains("_gone", i))
    lines = F.aggregate(out, F.lit(0), lambda acc, c: acc + c["n"])
    rows = _settled(
        rows,
        _new=F.when(F.col("_gone").isNotNull(), F.array_join(F.transform(kept, lambda c: c["chunk"]), "\n")).otherwise(F.col(text_col)),
        removed_chunks=F.coalesce(F.size(F.col("_gone")), F.lit(0)).cast("long"),
        removed_lines=F.coalesce(lines, F.lit(0)).cast("long"),
    )
    return rows.select(*restored(**{text_col: "_new"}), "removed_chunks", "removed_lines")


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` without the lines of repeated passages, plus removed_lines.

    Two lines in succession that came before, by (id, text hash, place), both
    go; the first copy of any line stays. Two lines are told by 192 bits of
    hashes. Null texts, single lines, repeated rows, equal texts, long texts,
    empty tables and other columns are treated as by :func:`drop_repeated_chunks`.
    """
    docs, (id_col, text_col), restored = veiled(docs.drop("removed_lines"), id_col, text_col)
    rows = _keyed(docs.select(id_col, text_col), id_col, text_col).where(F.col(text_col).contains("\n"))
    rows = _settled(rows.select("_id", "_key", F.col(text_col).alias("_text")), _lines=F.split("_text", "\n", -1)).drop("_text")

    def marked(line: Column, i: Column) -> Column:
        two = F.concat(line, F.lit("\n"), F.get("_lines", i + 1))
        return F.struct(F.xxhash64(two).alias("hash"), F.md5(two).alias("chunk"))

    rows = _settled(rows, _pairs=F.transform(F.slice("_lines", F.lit(1), F.size("_lines") - 1), marked)).drop("_lines")
    pairs = rows.select("_id", "_key", F.posexplode("_pairs").alias("_place", "_p"))
    pairs = pairs.select("_id", "_key", "_place", F.col("_p.hash").alias("_hash"), F.col("_p.chunk").alias("_chunk"))
    gone = hinted(stored(_repeats(pairs), "gone_pairs"), BROADCAST_ROWS)
    gone = gone.select(F.col("_id").alias("_i"), F.col("_key").alias("_k"), "_gone")
    rows = _keyed(docs, id_col, text_col)
    rows = rows.join(gone, (rows["_id"] == gone["_i"]) & (rows["_key"] == gone["_k"]), "left").drop("_id", "_key", "_i", "_k")
    rows = _settled(rows, _lines=F.split(F.when(F.col("_gone").isNotNull(), F.col(text_col)), "\n", -1))
    places = F.sequence(F.lit(0), F.size("_lines") - 1)
    stay = F.array_except(places, F.concat("_gone", F.transform("_gone", lambda i: i + 1)))
    rows = _settled(rows, _stay=F.when(F.col("_gone").isNotNull(), stay))
    rows = _settled(
        rows,
        _new=F.when(F.col("_gone").isNotNull(), F.array_join(F.transform("_stay", lambda i: F.get("_lines", i)), "\n")).otherwise(F.col(text_col)),
        removed_lines=F.when(F.col("_gone").isNotNull(), F.size("_lines") - F.size("_stay")).otherwise(0).cast("long"),
    )
    return rows.select(*restored(**{text_col: "_new"}), "removed_lines")
