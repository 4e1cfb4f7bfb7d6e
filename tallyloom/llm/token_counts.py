"""Token counts by a compiled finite-state tokenizer.

The tokenizer (lower-cased words, byte-level BPE whose last symbol ends the word) is compiled to two
deterministic machines. One classes characters and finds where words end. The other reads a word's bytes;
its states are the classes of prefixes with their exact merges, each transition carries the number of tokens
it emits (it may take some back), and each state a number emitted when the word ends there. Transitions are
compiled when first taken and kept.

Text is counted in chunks, which meet in the up-sweep of a prefix scan, log2(chunks) rounds of independent compositions.
On both levels a chunk is a map from the state that enters it to the state that leaves it and the tokens that it emits:

- Of a text, the state is the run that is open. A chunk's map is the characters before its first white space, which
  finish whatever run has begun, a count, and the run that it leaves open.
- Of a word, the state is the word machine's, as the last tokens of the latest prefixes. A chunk's map is made for the entering
  state that a few symbols before the chunk lead to from a word's start, which is nearly always the one that really enters.
  Where it isn't, composing reads the chunk again from the state that does. So long words are cut anywhere, and the result is exact.

A text of any length needs no more memory than itself, its maps and a bounded number of states.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple, TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import Memo, give_back, map_batches, small, text_or_empty, vocabulary_path
from tallyloom.llm.byte_bpe import SPACE

#: Characters of a chunk of a text, and of a word.
CHUNK, WORD_CHUNK = 8_192, 1_024
#: Words remembered in a worker, and states of the word machine; both start anew when full.
MEMO, STATES = 400_000, 100_000
#: Characters beyond which a run or a word isn't remembered.
REMEMBERED = 256
T = TypeVar("T")
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def printable_bytes() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else 256 and up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else more))
        more += b not in shown
    return out


class ShortMemo(Memo):
    """A memo that keeps no long keys, of which few would fill the memory."""

    def __missing__(self, key):
        return super().__missing__(key) if len(key) <= REMEMBERED else self.make(key)


#: What a state of the word machine knows, without its number: the symbol, last token and token count of each prefix that later
#: tokens may look back to, oldest first, and whether the word starts there.
Known = tuple[tuple[tuple[str, int, int], ...], bool]
START: Known = ((), True)


class ChunkMap(NamedTuple):
    """What the symbols from start to end of a word make of the state that enters."""

    start: int
    end: int
    enters: Known
    leaves: Known
    emitted: int


class WordMachine:
    """Counts the tokens of one word, symbol by symbol.

    A state is a prefix of words: the last token of the merges of each of its prefixes. Of a string's merges, the
    tokens before the last are the merges of what comes before it, so the next state needs only the longest token
    that ends here and may follow the state that lies before it. That one lies at most the longest token's length back, so
    a state holds the one it came from, and in a long word all but the last few can be let go.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.inner = {w: i for w, i in vocab.items() if not w.endswith("</w>")}
        self.final = {w[:-4]: i for w, i in vocab.items() if w.endswith("</w>") and w != "</w>"}
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.rank = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = r
            self.made[whole] = (r, left, right)
        self.memo: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        #: For each state: its last symbol, the state it came from, its last token, its number of tokens, and moves.
        self.symbol, self.parent, self.last, self.count = [""], [0], [-1], [0]
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        self.ends: list[dict[str, int]] = [{}]
        self.entered: dict[Known, int] = {START: 0}

    def _add(self, symbol: str, parent: int, last: int, count: int) -> int:
        self.symbol.append(symbol)
        self.parent.append(parent)
        self.last.append(last)
        self.count.append(count)
        self.moves.append({})
        self.ends.append({})
        return len(self.last) - 1

    def _path(self, state: int) -> list[int]:
        """The state and those it came from, as far back as a token reaches."""
        path = [state]
        while state and len(path) < self.longest:
            state = self.parent[state]
            path.append(state)
        return path

    def known(self, state: int) -> Known:
        """What the rest of a word needs of the state."""
        path = self._path(state)
        whole = path[-1] == 0
        path = path[::-1][1:] if whole else path[::-1]
        less = self.count[path[0]] if path and not whole else 0
        return tuple((self.symbol[s], self.last[s], self.count[s] - less) for s in path), whole

    def enter(self, known: Known) -> int:
        """A state that goes on like the one that this was known of."""
        state = self.entered.get(known)
        if state is None:
            state = 0 if known[1] else -1  # what came before the oldest isn't looked at again
            for symbol, last, count in known[0]:
                state = self._add(symbol, state, last, count)
            self.entered[known] = state
        return state

    def adjacent(self, left: int, right: int) -> bool:
        """True if the merges leave the tokens side by side."""
        key = (left, right)
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            known = self.memo[key] = self._adjacent(left, right)
        return known

    def _adjacent(self, left: int, right: int) -> bool:
        """Follows both sides' merges at the seam in the order of their ranks.

        A seam merge happens at rank r if, at r, the left side ends and the right side begins with its two parts.
        """
        none = len(self.rank) + 1
        ends, begins = [], []  # (token, from rank, until rank): what ends or begins at the seam, and when
        token, until = left, none
        while True:
            r, a, b = self.made.get(token, (-1, -1, -1))
            ends.append((token, r, until))
            if r < 0:
                break
            token, until = b, r
        token, until = right, none
        while True:
            r, a, b = self.made.get(token, (-1, -1, -1))
            begins.append((token, r, until))
            if r < 0:
                break
            token, until = a, r
        for a, a_from, a_until in ends:
            for b, b_from, b_until in begins:
                r = self.rank.get((a, b))
                if r is not None and a_from < r and b_from < r and self._first(r, a_until, b_until):
                    return False
        return True

    @staticmethod
    def _first(r: int, left_until: int, right_until: int) -> bool:
        """A pair at the seam merges at r when neither side has merged on before; on a tie of ranks the left comes first."""
        return r < left_until and r <= right_until

    def _step(self, state: int, symbol: str, tokens: dict[str, int]) -> tuple[int, int]:
        """The last token and the state before it when the symbol is read (as the word's last if tokens is final)."""
        path = self._path(state)
        text = "".join([self.symbol[s] for s in reversed(path[:-1])]) + symbol
        for size in range(len(path), 0, -1):
            token = tokens.get(text[-size:])
            if token is None:
                continue
            before = path[size - 1]
            if before == 0 or self.adjacent(self.last[before], token):
                return token, before
        raise ValueError(f"the vocabulary lacks {symbol!r}")

    def move(self, state: int, symbol: str) -> tuple[int, int]:
        """The next state, and the tokens that the transition emits."""
        found = self.moves[state].get(symbol)
        if found is None:
            token, before = self._step(state, symbol, self.inner)
            new = self._add(symbol, state, token, self.count[before] + 1)
            found = self.moves[state][symbol] = (new, self.count[new] - self.count[state])
        return found

    def end(self, state: int, symbol: str) -> int:
        """The tokens emitted when the symbol is the word's last."""
        found = self.ends[state].get(symbol)
        if found is None:
            _, before = self._step(state, symbol, self.final)
            found = self.ends[state][symbol] = self.count[before] + 1 - self.count[state]
        return found

    def run(self, state: int, symbols: str) -> tuple[int, int]:
        """The state that the symbols, none of them the word's last, lead to, and the tokens emitted."""
        total = 0
        for symbol in symbols:
            state, emitted = self.move(state, symbol)
            total += emitted
            if len(self.last) > STATES:
                known = self.known(state)
                self.reset()
                state = self.enter(known)
        return state, total

    def through(self, known: Known, symbols: str) -> tuple[Known, int]:
        state, total = self.run(self.enter(known), symbols)
        return self.known(state), total

    def chunk_map(self, word: str, start: int, end: int) -> ChunkMap:
        enters, _ = self.through(START, word[max(0, start - 2 * self.longest) : start])
        leaves, emitted = self.through(enters, word[start:end])
        return ChunkMap(start, end, enters, leaves, emitted)

    def compose(self, word: str, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of a chunk followed by another; if another state enters than the second was made for, it is read again."""
        leaves, emitted = (b.leaves, b.emitted) if a.leaves == b.enters else self.through(a.leaves, word[b.start : b.end])
        return ChunkMap(a.start, b.end, a.enters, leaves, a.emitted + emitted)

    def tokens(self, word: str) -> int:
        last = len(word) - 1
        if last <= WORD_CHUNK:
            state, total = self.run(0, word[:-1])
            return total + self.end(state, word[-1])
        maps = [self.chunk_map(word, i, min(last, i + WORD_CHUNK)) for i in range(0, last, WORD_CHUNK)]
        whole = up_sweep(maps, functools.partial(self.compose, word))
        return whole.emitted + self.end(self.enter(whole.leaves), word[-1])


def up_sweep(maps: list[T], compose: Callable[[T, T], T]) -> T:
    """The map of all together, in log2(n) rounds of independent compositions."""
    while len(maps) > 1:
        maps = [compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


class Splitter:
    """Runs and words of a text, as the tokenizer of a file has them."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model.get("end_of_word_suffix") != "</w>" or split["pattern"].get("Regex") != WORD_PATTERN or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this tokenizer isn't of the kind that is compiled here")
        self.pattern = regex.compile(WORD_PATTERN).findall
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"])))).finditer
        self.marks = tuple(t["content"] for t in spec["added_tokens"])
        self.odd_space = regex.compile("[\x1c-\x1f]").search
        self.spaces = regex.compile(f"[{SPACE}]+").split
        self.bytes = str.maketrans({i: c for i, c in enumerate(printable_bytes())})
        self.compile(model)

    def compile(self, model: dict) -> None:
        """Takes what else is needed of the file's model."""

    def symbols(self, word: str) -> str:
        """A word's bytes, each as the character that stands for it."""
        return word.encode().decode("latin-1").translate(self.bytes)

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def words(self, run: str) -> list[str]:
        """The words of a normalised run; letters alone, or with one sign behind them, need no pattern."""
        if run.isalpha():
            return [run]
        if run[-1] in ".,;:!?" and run[:-1].isalpha():
            return [run[:-1], run[-1]]
        return self.pattern(run)

    def split(self, text: str) -> list[str]:
        return [r for r in self.spaces(text) if r] if self.odd_space(text) else text.split()


class TokenCounter(Splitter):
    """Counts by the compiled machines."""

    def compile(self, model: dict) -> None:
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.machine = WordMachine(model["vocab"], merges)
        self.counts = ShortMemo(self.run)
        self.known = ShortMemo(lambda word: self.machine.tokens(self.symbols(word)))

    def forget(self) -> None:
        """Frees what is remembered, so that tasks of other operators in the same worker have the memory."""
        self.counts.clear()
        self.known.clear()
        self.machine.reset()

    def run(self, run: str) -> int:
        """The tokens of a run of characters without white space."""
        self.known.trim(MEMO)
        return sum(map(self.known.__getitem__, self.words(self.normalise(run))))

    def total(self, runs: list[str]) -> int:
        self.counts.trim(MEMO)
        return sum(map(self.counts.__getitem__, runs))

    def chunk_map(self, chunk: str) -> tuple[str, int, str | None]:
        """(head, count, tail): head finishes the word that enters, tail is left open; tail None: no white space, all is head."""
        runs = self.split(chunk)
        inner = " " + chunk + " "
        if not runs:
            return ("", 0, "") if chunk else ("", 0, None)
        starts, ends = not self.split(inner[1:2]), not self.split(inner[-2:-1])
        if len(runs) == 1 and not starts and not ends:
            return runs[0], 0, None
        head = "" if starts else runs.pop(0)
        tail = "" if ends else runs.pop()
        return head, self.total(runs), tail

    def compose(self, a: tuple[str, int, str | None], b: tuple[str, int, str | None]) -> tuple[str, int, str | None]:
        """The map of a chunk followed by another; associative."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        if b[2] is None:
            return a[0], a[1] + b[1], a[2] + b[0]
        seam = a[2] + b[0]
        return a[0], a[1] + b[1] + (self.total([seam]) if seam else 0), b[2]

    def close(self, whole: tuple[str, int, str | None]) -> int:
        return whole[1] + self.total([x for x in (whole[0], whole[2]) if x])

    def plain(self, text: str) -> int:
        """The tokens of a text without special strings."""
        return self.close(up_sweep([self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)], self.compose)) if text else 0

    def count(self, text: str) -> int:
        """The tokens of a whole text; special strings in it count as the one token that the library makes of each."""
        if not any(m in text for m in self.marks):
            return self.plain(text)
        total, at = 0, 0
        for m in self.special(text):
            total += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.plain(text[at:])


@functools.lru_cache(maxsize=2)
def load(name: str) -> TokenCounter:
    """One counter a worker process, kept between tasks with the words it remembers: they cost most of a task's time, and both memos and the states
    are bounded. Spark ends a worker that has had nothing to do for a minute."""
    return TokenCounter(vocabulary_path(name))


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens of each whole text.

    Null counts as the empty text, with no tokens. Rows stay where they are: nothing is shuffled, and repeated
    rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(vocabulary)
        for batch in small(batches):
            counts = [counter.count(t) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["__id", "n_bytes", "n_tokens"])
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    narrow = df.select(F.col(id_col).alias("__id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("__text"))
    return map_batches(narrow, run, f"__id {kind}, n_bytes long, n_tokens long").withColumnRenamed("__id", id_col)
