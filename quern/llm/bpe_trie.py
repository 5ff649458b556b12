"""BPE encoding and decoding by depth-first traversal of a trie of distinct words.

BPE has a prefix property: the encoding of a prefix of a word is the encoding
of a shorter prefix plus one last token. A list of tokens is an encoding if
each token encodes to itself and no merge crosses the border of any two
neighbours. So a node of the trie needs only its last token and where that
begins, found from the states of its ancestors; words that share a prefix
share the work. The last symbol of a word carries the end-of-word suffix, so
a word's end looks for a last token among those with the suffix.

Texts are cut at white space, which no word of the pre-tokenizer crosses;
distinct pieces are normalised, cut into words and encoded once for each
Python worker, whose memory of them is bounded.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm._store import lean_memory, per_worker, small_batches

#: Unicode's White_Space, at which the tokenizer's \s cuts.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: str.split() cuts at these as well, the tokenizer doesn't.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_NEVER = 1 << 60
#: Pieces of printable ASCII and Latin-1 letters, which composition leaves alone, and the word pattern for them in lower case.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: The characters that stand for bytes: printable ones for themselves, the others in order from 256.
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(_OTHERS)}
#: The normaliser and the pattern that those rules are derived from.
_RULES = ["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTrieBPE:
    """Encoder of whole texts with the ids of a BPE tokenizer file that has word-end suffixes."""

    def __init__(self, path: str, remembered: int = 300_000) -> None:
        library = Tokenizer.from_file(path)
        self.normalize, self.cut_words = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or model.get("dropout") or spec.get("decoder"):
            raise ValueError("a BPE file with word-end suffix and without decoder is needed")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be matched as they stand")
        if ([n["type"] for n in spec["normalizer"]["normalizers"]], spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]) != _RULES:
            raise ValueError("the file's normaliser or word pattern is another")
        self.suffix, self.ids = model["end_of_word_suffix"], model["vocab"]
        self.names = {i: s for s, i in self.ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._learn_merges([tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.decimal = {i: str(i) for i in self.names}
        self.remembered = remembered
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _learn_merges(self, merges: list[tuple[str, str]]) -> None:
        ids = self.ids
        self.rank = {(ids[a], ids[b]): r for r, (a, b) in enumerate(merges)}
        made = {ids[a + b]: (ids[a], ids[b], r) for r, (a, b) in reversed([*enumerate(merges)])}
        # The tokens that stand at a token's right (left) border while it is being built, each followed by the rank of the merge that replaces it.
        self.right: dict[int, tuple] = {}
        self.left: dict[int, tuple] = {}
        # A token is real if its own string encodes to it.
        real = set()
        for t in ids.values():
            if t not in made:
                self.right[t] = self.left[t] = (t, _NEVER)
                real.add(t)
        for t, (a, b, r) in sorted(made.items(), key=lambda x: x[1][2]):
            self.right[t] = (*self.right[b][:-1], r, t, _NEVER)
            self.left[t] = (*self.left[a][:-1], r, t, _NEVER)
            if a in real and b in real and self._apart(a, b, whole=False):
                real.add(t)
        names = {i: s for s, i in ids.items()}
        self.token = {names[t]: t for t in real}
        self.longest = max(len(s.removesuffix(self.suffix)) for s in self.token)
        self.known: dict[int, bool] = {}

    def _apart(self, a: int, b: int, whole: bool = True) -> bool:
        """Whether no merge crosses the border of a and b; not ``whole``: before both are complete."""
        xs, ys, i, j = self.right[a], self.left[b], 0, 0
        while True:
            x, next_x, y, next_y = xs[i], xs[i + 1], ys[j], ys[j + 1]
            if next_x == _NEVER and next_y == _NEVER:
                return not whole or (x, y) not in self.rank
            r = self.rank.get((x, y), _NEVER)
            if r < next_x and r <= next_y and r != _NEVER:  # on a tie the merge further left goes first
                return False
            if next_x <= next_y:
                i += 2
            else:
                j += 2

    def _fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            found = self.known[key] = self._apart(a, b)
        return found

    def encode_words(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each distinct byte-level word, by one depth-first traversal of their trie.

        The trie is kept as its words in order, which is the order of the
        traversal, with the length of the prefix that each shares with the
        one before. The state of a prefix (its last token, and where that
        begins) is found when a word below asks for it, and stays on the path
        for all words that share the prefix.
        """
        out: dict[str, tuple[int, ...]] = {}
        # States along the current path: last token of the prefix of each length, or None so far, and where it begins.
        last: list = [0]
        begin: list = [0]
        token, longest, known, suffix = self.token, self.longest, self.known, self.suffix
        path = ""

        def settle(depth: int, tail: str) -> tuple[int, int]:
            """The last token of the prefix of a length (``tail``: of the word that ends there), and its begin."""
            for lo in range(depth - longest if depth > longest else 0, depth):
                t = token.get(path[lo:depth] + tail)
                if t is None:
                    continue
                if not lo:
                    return t, 0
                before = last[lo]
                if before is None:
                    before, begin[lo] = settle(lo, "")
                    last[lo] = before
                fits = known.get(before << 32 | t)
                if fits is None:
                    fits = self._fits(before, t)
                if fits:
                    return t, lo
            raise ValueError(f"no encoding of {path[:depth]!r}")

        for word in sorted(words):
            shared = 0
            for x, y in zip(path, word):
                if x != y:
                    break
                shared += 1
            path, depth = word, len(word)
            last[shared + 1 :] = begin[shared + 1 :] = [None] * (depth - shared)
            for lo in self._steps(depth):  # a very long word settles its prefixes in order
                if last[lo] is None:
                    last[lo], begin[lo] = settle(lo, "")
            t, lo = settle(depth, suffix)
            ids = [t]
            while lo:
                if last[lo] is None:
                    last[lo], begin[lo] = settle(lo, "")
                ids.append(last[lo])
                lo = begin[lo]
            ids.reverse()
            out[word] = tuple(ids)
        return out

    @staticmethod
    def _steps(depth: int, often: int = 64) -> range:
        """Prefix lengths to settle beforehand, so that no demand nests deeper than ``often``."""
        return range(1, depth) if depth > often else range(0)

    def _learn_pieces(self, new: set[str], needed: list[list]) -> None:
        """Add new pieces; when there are too many, only those that the texts at hand need stay."""
        if len(self.pieces) + len(new) > self.remembered:
            stay = {p for ps in needed for p in ps if p.__class__ is str}.difference(new)
            self.pieces = {p: self.pieces[p] for p in stay}
        cut = {p: self._words(p) for p in new}
        words = self.encode_words({w for ws in cut.values() for w in ws})
        for p, ws in cut.items():
            self.pieces[p] = words[ws[0]] if len(ws) == 1 else tuple(chain.from_iterable([words[w] for w in ws]))

    def _words(self, piece: str) -> list[str]:
        """Byte-level words of a piece; for plain letters and printable ASCII the rules come down to one pattern."""
        if piece.isascii() and piece.isprintable():
            piece = piece.lower()
            return [piece] if piece.isalpha() else _PLAIN_WORDS.findall(piece)
        if _PLAIN.fullmatch(piece):
            return [w.encode().decode("latin-1").translate(_BYTE_CHARS) for w in _PLAIN_WORDS.findall(piece.lower())]
        return [w for w, _ in self.cut_words(self.normalize(piece))]

    def _split(self, text: str) -> list[str]:
        return [p for p in _SPACE.split(text) if p] if _NOT_SPACE.search(text) else text.split()

    def encode_ids(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        at = 0
        while at < len(texts):
            # As many texts as bring at most a bounded number of new pieces.
            parts, new = [], set()
            while at < len(texts) and len(new) < self.remembered // 4:
                text = texts[at]
                at += 1
                if self.at_special and "<" in text and (cut := self.at_special.split(text))[1:]:
                    pieces = []
                    for s in cut:
                        pieces += [self.special[s]] if s in self.special else self._split(s)
                else:
                    pieces = self._split(text)
                parts.append(pieces)
                new |= {p for p in pieces if p.__class__ is str}.difference(self.pieces)
            if new:
                self._learn_pieces(new, parts)
            known = self.pieces
            for ps in parts:
                try:
                    yield list(chain.from_iterable(map(known.__getitem__, ps)))
                except KeyError:  # special tokens stand as their ids
                    yield list(chain.from_iterable(known[p] if p.__class__ is str else (p,) for p in ps))

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text its ids, as decimals joined by a space, and its decoded form."""
        for ids in self.encode_ids(texts):
            yield " ".join(map(self.decimal.__getitem__, ids)), self.decode(ids)


@per_worker(2)
def _encoder(path: str, remembered: int) -> WordTrieBPE:
    return WordTrieBPE(path, remembered)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", remembered: int = 300_000) -> DataFrame:
    """``(id, ids array<int>, decoded string)`` for every row of ``docs``.

    ``tokenizer`` is the path of the tokenizer file, there on every machine.
    A null or empty text encodes to no ids and decodes to the empty string.
    Texts of any length are encoded whole. Repeated rows are kept, null ids
    stay null, other columns are ignored, and an empty table gives an empty result.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory(_encoder)
        encoder = _encoder(tokenizer, remembered)
        for b in _slices(batches):
            ids, ends, decoded = [], [0], []
            for found in encoder.encode_ids([t or "" for t in b.column(1).to_pylist()]):
                ids.append(np.array(found, np.int32))
                ends.append(ends[-1] + len(found))
                decoded.append(encoder.decode(found))
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), listed, pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    return _named(docs, id_col, text_col).mapInArrow(task, "id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", remembered: int = 300_000) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: digests made where the ids are, which are not shipped."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory(_encoder)
        encoder = _encoder(tokenizer, remembered)
        for b in _slices(batches):
            rows = [(i.count(" ") + 1 if i else 0, hashlib.sha256(i.encode()).hexdigest(), hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest()) for i, d in encoder.encode_batch([t or "" for t in b.column(1).to_pylist()])]
            n, x, y = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _named(docs, id_col, text_col).mapInArrow(task, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice's texts have about ``most`` bytes or are one row."""
    for b in batches:
        step = max(1, int(b.num_rows * most / max(most, b.nbytes)))
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)
