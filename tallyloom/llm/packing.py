"""Packing token sequences into training windows by Karmarkar-Karp multiway differencing.

A document's tokens are its ids by the tokenizers library and an end id. What fills whole windows is cut off as
such; the rest is cut into parts of at most piece_tokens. Blocks of parts are then spread over windows: every
part starts as a partial partition of its own, and the two partial partitions with the largest imbalance are
merged, the fullest windows of one with the emptiest of the other, until one is left, whose windows are nearly
equal. Their number starts at the fewest that can hold the block and rises while one is over capacity.

A task packs its own rows, block by block, so nothing is shuffled and memory holds one block; the number of
blocks grows with the data. Window numbers carry the partition in their high bits.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import Memo, give_back, map_batches, small, text_or_empty, vocabulary_path
from tallyloom.llm.token_counts import Splitter

#: Tokens of a window; the longest part of a document that is packed with others; windows that a block aims to fill;
#: tokens of a block left free, which is what differencing needs to even out.
WINDOW, PIECE_TOKENS, BLOCK_WINDOWS, SLACK = 2048, 512, 96, 48
#: Words and runs remembered in a worker.
MEMO = 200_000


class WordIds(Splitter):
    """Ids by the library's model, remembered by runs of characters without white space, two bytes an id."""

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 65_536:
            raise ValueError("ids of this tokenizer don't fit in two bytes")
        tokenize = self.library.model.tokenize
        self.ids_of_word = Memo(lambda word: array("H", [t.id for t in tokenize(self.symbols(word))]).tobytes())
        self.ids_of_run = Memo(lambda run: b"".join(map(self.ids_of_word.__getitem__, self.words(self.normalise(run)))))

    def forget(self) -> None:
        self.ids_of_word.clear()
        self.ids_of_run.clear()

    def ids(self, text: str) -> np.ndarray:
        if any(m in text for m in self.marks):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        self.ids_of_run.trim(MEMO)
        self.ids_of_word.trim(MEMO)
        return np.frombuffer(b"".join(map(self.ids_of_run.__getitem__, self.split(text))), np.uint16).astype("<u4")


@functools.lru_cache(maxsize=2)
def load(name: str) -> WordIds:
    return WordIds(vocabulary_path(name))


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k lists of indices whose sums of sizes are nearly equal."""
    heap = []
    for i, size in enumerate(sizes):
        # (imbalance, tie, sums in falling order without the empty windows, their members)
        heap.append((-size, i, [size], [[i]]))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        if len(a) < len(b):
            a, in_a, b, in_b = b, in_b, a, in_a
        # both padded with empty windows to k; the fullest of b meets the emptiest of a
        free = k - len(a)
        sums, members = list(a), list(in_a)
        for j in range(min(free, len(b))):
            sums.append(b[j])
            members.append(in_b[j])
        for j in range(free, len(b)):
            at = len(a) - 1 - (j - free)
            sums[at] += b[j]
            members[at] = in_a[at] + in_b[j]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, members = [sums[i] for i in order], [members[i] for i in order]
        least = sums[-1] if len(sums) == k else 0
        heapq.heappush(heap, (least - sums[0], tie, sums, members))
        tie += 1
    members = heap[0][3] if heap else []
    return members + [[] for _ in range(k - len(members))]


def fill_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of indices, none over capacity; every size must be at most capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return [w for w in windows if w]
        k += 1


class _Packer:
    """Takes documents of one task and gives rows of pieces."""

    def __init__(self, partition: int, window: int, piece: int, block_windows: int, with_ids: bool):
        self.base, self.next = partition << 33, 0
        self.window, self.piece, self.with_ids = window, piece, with_ids
        self.full = block_windows * window - min(SLACK, window // 8)
        self.waiting: list[tuple[object, int, np.ndarray, int]] = []
        self.held = 0
        self.rows: list[tuple] = []

    def row(self, doc: object, start: int, ids: np.ndarray, total: int, sequence: int, offset: int) -> None:
        self.rows.append((doc, start, len(ids), zlib.crc32(ids), total, self.base + sequence, offset, ids if self.with_ids else None))

    def add(self, doc: object, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.window:
            self.row(doc, at, ids[at : at + self.window], total, self.next, 0)
            self.next += 1
            at += self.window
        if at == total:
            return
        parts = -(-(total - at) // self.piece)
        edges = [at + (total - at) * i // parts for i in range(parts + 1)]
        for a, b in zip(edges, edges[1:], strict=False):
            if self.held + b - a >= self.full:  # the part that completes the block is cut to fit
                cut = a + self.full - self.held
                self.hold(doc, a, ids[a:cut], total)
                self.flush()
                a = cut
            if a < b:
                self.hold(doc, a, ids[a:b], total)

    def hold(self, doc: object, start: int, ids: np.ndarray, total: int) -> None:
        if len(ids):
            self.waiting.append((doc, start, ids, total))
            self.held += len(ids)

    def flush(self) -> None:
        for members in fill_windows([len(w[2]) for w in self.waiting], self.window) if self.waiting else []:
            offset = 0
            for i in members:
                doc, start, ids, total = self.waiting[i]
                self.row(doc, start, ids, total, self.next, offset)
                offset += len(ids)
            self.next += 1
        self.waiting, self.held = [], 0

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack_documents(
    df: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = 1,
    piece_tokens: int = PIECE_TOKENS,
    block_windows: int = BLOCK_WINDOWS,
    with_ids: bool = False,
) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids with with_ids.

    Every id of every document lies in one piece; the pieces of a sequence lie one behind another from offset 0 and
    hold at most window ids. A null text counts as empty and gives its end id alone. Documents that repeat are packed
    again, each for itself. An empty table gives no rows. sequence_id is unique, not dense: the high bits are the
    partition's number.
    """
    if not 0 < piece_tokens <= window:
        raise ValueError("piece_tokens must be positive and at most window")
    names = ["__id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, context = load(vocabulary), TaskContext.get()
        packer, kind = _Packer(context.partitionId() if context else 0, window, piece_tokens, block_windows, with_ids), pa.int64()

        def out() -> pa.RecordBatch:
            rows = packer.take()
            types = [kind, *[pa.int64()] * 6, pa.list_(pa.int32())]
            return pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names)

        for batch in small(batches):
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc, np.append(words.ids(text), np.uint32(end_id)).astype("<u4", copy=False))
                if len(packer.rows) > 20_000:
                    yield out()
        packer.flush()
        words.forget()
        give_back()
        if packer.rows:
            yield out()

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"__id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
    out = map_batches(df.select(F.col(id_col).alias("__id"), text_or_empty(text_col)), run, schema).withColumnRenamed("__id", id_col)
    return out if with_ids else out.drop("ids")
