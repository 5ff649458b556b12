"""Token counts of a unigram tokenizer by a Viterbi search that keeps counts only.

An Aho-Corasick automaton over the vocabulary reports every piece that ends
at each position of a word; dynamic programming carries the best score and,
with it, the number of pieces. Nothing is traced back. The rules are those of
the unigram model of the tokenizers library with byte fallback: a candidate
replaces the best so far only if its score is greater, candidates come in
order of their start, a character without a piece of its own may be unknown
at the least score less 10, and an unknown character counts as its bytes.

Texts are cut before each word mark as the library's Metaspace does. A
distinct word is searched once for each Python worker, whose memory of words
is bounded. Where all scores are integers, a word's score and count are one
number and a text's are one sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._store import lean_memory, per_worker, small_batches

#: Fixed values of the tokenizer: the word mark and what an unknown character costs below the least score.
MARK = "▁"
_UNKNOWN_PENALTY = 10


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file, in order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]


class CountingViterbi:
    """Maps words to their score and count: ``-score << 32 | count`` where scores are integers, so that sums add both."""

    def __init__(self, pieces: list[tuple[str, float]], remembered: int) -> None:
        if any(s > 0 for _, s in pieces):
            raise ValueError("scores must not be positive")
        self.whole = all(s == int(s) for _, s in pieces)
        number = int if self.whole else float
        if any(MARK in p[1:] for p, _ in pieces if set(p) != {MARK}):
            raise ValueError("a piece crosses a word mark")
        self.automaton = ahocorasick.Automaton()
        for p, s in dict(reversed(pieces)).items():
            self.automaton.add_word(p, (len(p), number(s)))
        self.automaton.make_automaton()
        self.unknown = number(min(s for _, s in pieces)) - _UNKNOWN_PENALTY
        self.remembered = remembered
        self.known: dict = {}

    def search(self, word: str) -> tuple[float, int]:
        """Best score and piece count of one word."""
        score, count = [0] * (len(word) + 1), [0] * (len(word) + 1)
        at = 0
        best = single = None
        unknown = self.unknown

        def close(end: int) -> None:
            """Settle the position after character ``end - 1``, for which ``best`` holds what was found."""
            nonlocal best
            if not single:
                s = score[end - 1] + unknown
                if best is None or s > best[0]:
                    best = (s, count[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass")))
            score[end], count[end] = best

        for last, (length, s) in self.automaton.iter(word):  # ends ascend; at one end the longest comes first
            end = last + 1
            while at < last:
                at += 1
                close(at)
                best = single = None
            start = end - length
            s += score[start]
            if best is None or s > best[0]:
                best = (s, count[start] + 1)
            if length == 1:
                single = True
        while at < len(word):
            at += 1
            close(at)
            best = single = None
        return score[-1], count[-1]

    def recalled(self, word: str):
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.remembered:
                self.known.clear()
            score, count = self.search(word)
            found = self.known[word] = -score << 32 | count if self.whole else (score, count)
        return found

    def document(self, text: str | None) -> tuple[int, float]:
        """Token count and score of a whole text."""
        if not text:
            return 0, 0
        text = text.replace(MARK, " ")
        found = map(self.recalled, [MARK + w for w in (text[1:] if text[0] == " " else text).split(" ")])
        if not self.whole:
            scores, counts = zip(*found)
            return sum(counts), sum(scores)
        total = sum(found)
        return total & 0xFFFFFFFF, -(total >> 32)


@per_worker(2)
def _counter(path: str, remembered: int) -> CountingViterbi:
    return CountingViterbi(vocabulary(path), remembered)


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", remembered: int = 500_000) -> DataFrame:
    """``(id, n_tokens, score)`` for every row of ``docs``: the best segmentation's pieces and its score.

    A null or empty text has no tokens and score 0; texts and words of any
    length are searched whole. Repeated rows are kept, null ids stay null,
    other columns are ignored, and an empty table gives an empty result.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory(_counter)
        counter = _counter(vocabulary_path, remembered)
        for b in batches:
            rows = [counter.document(t.as_py()) for t in b.column(1)]
            n, s = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(map(float, s), pa.float64())], ["id", "n_tokens", "score"])

    small_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(task, "id long, n_tokens long, score double")
