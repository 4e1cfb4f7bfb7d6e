"""Byte-level BPE in linear time: longest matches of an Aho-Corasick automaton with backtracking.

Bytes are mapped to Latin-1 characters so that the automaton, which reads strings, sees one character a
byte. Whether two tokens may stand side by side in the result of the exact merges is decided by splitting
them back along the merges that made them; the answers are memoised. The encoder goes from left to right,
takes the longest token that may follow, and steps back when nothing fits; a position that failed is never
tried again, so the work is linear in the text. The result is what applying the merges by rank gives.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import Memo, give_back, map_batches, small, text_or_empty, vocabulary_path

#: White space as the pattern's \s has it: the property White_Space, without \x1c-\x1f.
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Distinct pieces of text remembered in a worker; the memory is emptied when full.
MEMO = 400_000


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.words: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.words[rank] = word
        self.automaton = ahocorasick.Automaton()
        for word, rank in ranks.items():
            self.automaton.add_word(word.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.matches = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(self.words))]
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter = [self._longest_below(w) for w in self.words]
        self._learn_halves()
        self.parts = Memo(lambda part: array("I", self._part(part)).tobytes())
        #: A space between white space, or one that ends the text after white space: cutting there isn't safe.
        self.unsafe = re.compile(r"\s (?:\s|\Z)").search
        self.digits = [str(i).encode() for i in range(len(self.words))]

    def _longest_below(self, word: bytes) -> int:
        """The longest token that is a proper prefix of the word, or -1."""
        for n in range(len(word) - 1, 0, -1):
            if (rank := self.ranks.get(word[:n])) is not None:
                return rank
        return -1

    def _learn_halves(self) -> None:
        """In rank order, the two tokens whose merge makes each token."""
        for rank, word in enumerate(self.words):
            left = self.shorter[rank]
            while left >= 0:
                right = self.ranks.get(word[len(self.words[left]) :])
                if right is not None and left < rank and right < rank and self._adjacent(left, right):
                    self.pairs[left, right] = rank
                    self.halves[rank] = (left, right)
                    break
                left = self.shorter[left]
        self.fits.clear()

    def _adjacent(self, left: int, right: int) -> bool:
        """True if the merges leave these two tokens side by side.

        Undoes the later merge of the two, again and again, and looks at the pair that meets at the seam: a merge
        of that pair which comes before the one just undone would have crossed the seam.
        """
        limit = len(self.words) + 1
        while True:
            if self.pairs.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, half = left, self.halves[left][1]
                if half != left:
                    left = half
                    continue
                half = self.halves[right][0]
                if half == right:
                    return True
                limit, right = right + 1, half
            else:
                limit, half = right + 1, self.halves[right][0]
                if half != right:
                    right = half
                    continue
                half = self.halves[left][1]
                if half == left:
                    return True
                limit, left = left, half

    def _fit(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            known = self.fits[key] = self._adjacent(left, right)
        return known

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one match of the pattern."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        longest: dict[int, int] = {}
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - len(self.words[rank])
            if start not in longest or len(self.words[longest[start]]) < len(self.words[rank]):
                longest[start] = rank
        out: list[int] = []
        failed: set[int] = set()
        at, token, n = 0, longest[0], len(piece)
        while True:
            end = at + len(self.words[token])
            if end not in failed and (not out or self._fit(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return tuple(out)
                token = longest[at]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                failed.add(at)
                token = out.pop()
                at -= len(self.words[token])
                while self.shorter[token] < 0 and out:
                    failed.add(at)
                    token = out.pop()
                    at -= len(self.words[token])
                token = self.shorter[token]

    def _part(self, part: str) -> tuple[int, ...]:
        """The ids of a part of a text whose matches don't reach beyond it."""
        ids: list[int] = []
        for match in self.matches(part):
            ids += self.encode_piece(match.encode())
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text.

        No match holds a space but as its first character or within white space, so a text may be cut before each
        single space; parts that came before are looked up. Texts with longer white space go match by match.
        """
        if not text:
            return []
        self.parts.trim(MEMO)
        if self.unsafe(text):
            parts = self.matches(text)
        else:
            first, *rest = text.split(" ")
            parts = ([first] if first else []) + [" " + r for r in rest]
        return array("I", b"".join(map(self.parts.__getitem__, parts))).tolist()

    def forget(self) -> None:
        """Frees what is remembered, so that tasks of other operators in the same worker have the memory."""
        self.parts.clear()
        self.fits.clear()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: each line a token in base64 and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@functools.lru_cache(maxsize=2)
def load(name: str, pattern: str | None = None) -> ByteBPE:
    """One encoder a worker process, kept between tasks."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return ByteBPE(read_ranks(vocabulary_path(name)), pattern)


def encode_texts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """id, token_ids array<int> (with ids=True), n_tokens, ids_sha256, decoded_sha256 of each whole text.

    The digests are taken of the decimal ids joined by one space, and of the bytes that the ids decode to.
    Null counts as the empty text, which has no ids. Nothing is shuffled; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in small(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                tokens = bpe.encode(text)
                rows.append((tokens if ids else None, len(tokens), hashlib.sha256(b" ".join(map(bpe.digits.__getitem__, tokens))).hexdigest(), hashlib.sha256(bpe.decode(tokens)).hexdigest()))
            types = [pa.list_(pa.int32()), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]
            yield pa.record_batch([batch.column(0), *cols], ["__id", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"__id {kind}, token_ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = map_batches(df.select(F.col(id_col).alias("__id"), text_or_empty(text_col)), run, schema).withColumnRenamed("__id", id_col)
    return out if ids else out.drop("token_ids")


def decode_ids(df: DataFrame, vocabulary: str, ids_col: str = "token_ids", id_col: str = "doc_id") -> DataFrame:
    """id, decoded binary: the bytes of each list of ids; null for a null list or an id that doesn't exist."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        n = len(bpe.words)
        for batch in batches:
            lists = batch.column(1).to_pylist()
            done = [bpe.decode(x) if x is not None and all(i is not None and 0 <= i < n for i in x) else None for x in lists]
            yield pa.record_batch([batch.column(0), pa.array(done, pa.binary())], ["__id", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col).alias("__id"), ids_col), run, f"__id {kind}, decoded binary").withColumnRenamed("__id", id_col)
