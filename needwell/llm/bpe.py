"""Byte-pair encoding and decoding with a public vocabulary, by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that ends its encoding. An automaton over the
vocabulary lists, at each prefix end, the tokens that are suffixes of the prefix. A token is the
prefix's last one if it is compatible with the last token of what is left before it: undoing the
merges of the two tokens, latest first, must never meet a merge across their border that would have
come earlier. The last tokens are stored, and back-pointers from the whole word give the ids: no merge
is ever carried out, and a word costs time in proportion to its length, however long it is.

Texts become words as the vocabulary's own file says: special tokens are cut out, the rest is put in
NFC and lower case, and a pattern takes contractions, letters, single digits and other signs; white
space is dropped. Characters whose class differs between Unicode versions go through the library's
own normaliser and splitter, all others through a faster path that agrees with it.

The vocabulary file must be on every node, like the library; its path is a parameter.

Defined cases: a null text is empty: no ids, empty decoding; rows are independent, so repeated rows
and null ids repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .registry import query, table

END = "</w>"
_MARK = "\0"
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_VERSIONED = re.compile("[^\x00-ԯ -⁯₠-₿]")
#: a worker stays small: some 80 MB of known words and pairs
_CACHED_WORDS = 200_000
_CACHED_PAIRS = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in such vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """A vocabulary, ready to encode and decode texts exactly as its library does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in (ids | self.special).items()}
        self.digits = {i: str(i) for i in self.names}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.letters = _byte_letters()

        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        newest = -1
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            whole, pair = ids[left + right], (ids[left], ids[right])
            if whole <= newest:
                raise ValueError("ids must follow the order of merges")
            newest = whole
            self.merged[pair], self.halves[whole] = whole, pair
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}

        # base tokens, then merged ones whose own encoding is themselves: no other can ever appear
        letters = set(self.letters.values())
        form = {ids[c]: c for c in letters} | {ids[c + END]: c + _MARK for c in letters}
        self.suffixes = ahocorasick.Automaton()
        for token, text in form.items():
            self.suffixes.add_word(text, (token, len(text)))
        for whole, (left, right) in self.halves.items():
            if left in form and right in form and self.compatible(left, right, whole):
                form[whole] = form[left] + form[right]
                self.suffixes.add_word(form[whole], (whole, len(form[whole])))
        self.suffixes.make_automaton()

    @cached_property
    def library(self):
        """The library's normaliser and splitter, loaded by the first text that needs them."""
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(self.path)
        return loaded.normalizer, loaded.pre_tokenizer

    def compatible(self, left: int, right: int, limit: float = float("inf")) -> bool:
        """Whether merging would keep two tokens apart, merges from `limit` on left aside."""
        merged, halves = self.merged, self.halves
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            born_left, born_right = (left if left in halves else -1), (right if right in halves else -1)
            if born_left < 0 and born_right < 0:
                return True
            # the later merge is undone; among equal ones the right one came later
            if born_left > born_right:
                limit, left = born_left, halves[left][1]
            else:
                limit, right = born_right + 1, halves[right][0]

    def word(self, letters: str) -> list[int]:
        """Ids of one word in byte letters."""
        size = len(letters) + 2
        last = [-1] * size  # the last token of the prefix of each length
        back = [0] * size  # and where that token starts
        known = self.pairs
        if len(known) >= _CACHED_PAIRS:
            known.clear()
        for end, (token, length) in self.suffixes.iter(letters + _MARK):
            at = end + 1
            if last[at] >= 0:
                continue
            start = at - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = known.get((before, token))
                if fits is None:
                    fits = known[before, token] = self.compatible(before, token)
                if not fits:
                    continue
            last[at], back[at] = token, start
        out, at = [], size - 1
        while at > 0:
            out.append(last[at])
            at = back[at]
        out.reverse()
        return out

    def _known_word(self, piece: str) -> list[int]:
        found = self.words.get(piece)
        if found is None:
            found = self.word("".join(map(self.letters.__getitem__, piece.encode())))
            if len(piece) <= 64:
                if len(self.words) >= _CACHED_WORDS:
                    self.words.clear()
                self.words[piece] = found
        return found

    def _plain(self, text: str) -> list[int]:
        ids: list[int] = []
        if _VERSIONED.search(text):
            normalizer, splitter = self.library
            for letters, _ in splitter.pre_tokenize_str(normalizer.normalize_str(text)):
                ids += self.word(letters)
            return ids
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        words, known = self.words, self._known_word
        for piece in _WORDS.findall(text):
            ids += words.get(piece) or known(piece)
        return ids

    def encode(self, text: str) -> list[int]:
        if "<|" not in text:
            return self._plain(text)
        ids, at = [], 0
        for m in self.cut.finditer(text):
            ids += self._plain(text[at : m.start()])
            ids.append(self.special[m[0]])
            at = m.end()
        return ids + self._plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings joined by a space, as the library does for a vocabulary without decoder."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker, which stays for many tasks."""
    return Encoder(path)


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    return (value.as_py() or "" for value in batch.column(column))


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids of every row."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids = pa.array([own.encode(t) for t in _texts(batch, "text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return _slim(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of every row of ids; null ids give an empty text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = pa.array([own.decode(v.as_py() or []) for v in batch.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of their decoding, in one pass over the texts."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            counts, hashes, decoded = [], [], []
            for text in _texts(batch, "text"):
                ids = own.encode(text)
                counts.append(len(ids))
                hashes.append(sha(" ".join(map(own.digits.__getitem__, ids))))
                decoded.append(sha(own.decode(ids)))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(decoded)]
            del batch  # not beside the next one
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _slim(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every document, as digests."""
    return round_trip(table(spark, sf_dir, "documents"))
