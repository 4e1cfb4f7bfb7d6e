"""Language identification by a linear-chain conditional random field over words.

Each word is scored for each language by hashed features: affixes, character n-grams, the word itself and the lexicons
(the words that are frequent in one language of the training rows). Learned transitions say how readily the language
changes between neighbouring words. Forward-backward gives each word's distribution; a text's language is the one with the
largest mean over its words, so that code-switched texts get labels word by word and one language as a whole.

The labels share out each word among the languages that were learned, whatever the word. Whether a text is in any of them is another
question, answered by its fit: the share of its letter trigrams that the language's training rows have. What a text must reach is
learned too, half way between the fit of training windows kept back and that of the same windows with their letters shuffled.

The field is fitted on the driver on a bounded sample, at most TRAIN_PER_LANGUAGE windows of TRAIN_CHARS characters of each
language, every word of which is used; labelling runs in the tasks over whole texts. The model grows with the number of languages alone.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm._shared import Memo, give_back, map_batches, small, text_or_empty

#: Bounds of the training sample: windows of a language, characters of a window, languages (more are an error).
TRAIN_PER_LANGUAGE, TRAIN_CHARS, MAX_LANGUAGES = 300, 1000, 256
#: Of so many windows of a language one is kept back for the least fit.
KEPT_BACK = 10
#: Hashed features; words of a lexicon; words of a training sequence; steps of the fit.
BUCKETS, LEXICON, SEQUENCE, STEPS = 1 << 15, 1500, 40, 40
#: Words and runs remembered in a worker, and words times texts that are labelled at once.
MEMO, BLOCK = 120_000, 200_000
#: Words that a labeller remembers where no other stage shares the executors' memory.
MEMO_ALONE = 400_000
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


_HASHES = Memo(_hash)  # of affixes and n-grams: few, and in most words


def features(word: str, lexicon: dict[str, list[int]]) -> list[int]:
    """The hashed features of a word."""
    _HASHES.trim(MEMO)
    marked, n = f"^{word}$", len(word)
    found = [f"#{min(n, 12)}"]
    found += ["p" + word[:i] for i in (1, 2, 3) if n > i]
    found += ["s" + word[-i:] for i in (1, 2, 3, 4) if n > i]
    found += ["b" + marked[i : i + 2] for i in range(n + 1)]
    found += ["t" + marked[i : i + 3] for i in range(n)]
    found += [f"l{i}" for i in lexicon.get(word, ())]
    return [_hash("=" + word), *map(_HASHES.__getitem__, found)]


def trigrams(word: str) -> Iterator[str]:
    marked = f"^{word}$"
    return (marked[i : i + 3] for i in range(len(marked) - 2))


@dataclass
class Field:
    """languages, feature weights (buckets x languages), transition scores, each word's lexicons, the languages that have a trigram (as
    bits), and the least fit of a text in one of the languages."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, list[int]] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    least_fit: float = 0.0

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        lists = [features(w, self.lexicon) for w in words]
        starts = np.cumsum([0, *map(len, lists)])[:-1]
        flat = np.fromiter((i for x in lists for i in x), np.int64)
        return np.add.reduceat(self.weights[flat], starts, axis=0)


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, expected transitions, log partition) of sequences padded to one length: (sequences, words, languages)."""
    n, width, k = emissions.shape
    peak = emissions.max(axis=2, keepdims=True)
    scores = np.exp(emissions - peak)
    move = np.exp(transitions)
    forward = np.empty_like(scores)
    scale = np.ones((n, width))
    live = np.arange(width)[None, :] < lengths[:, None]
    state = scores[:, 0] / k
    for t in range(width):
        if t:
            state = (state @ move) * scores[:, t]
        total = state.sum(axis=1)
        state = state / total[:, None]
        scale[:, t] = total
        forward[:, t] = state
    back = np.ones((n, k))
    marginals = np.empty_like(scores)
    expected = np.zeros((k, k))
    for t in range(width - 1, -1, -1):
        marginals[:, t] = forward[:, t] * back
        if t:
            ahead = back * scores[:, t] / scale[:, t][:, None]
            alive = live[:, t]
            expected += (forward[alive, t - 1].T @ ahead[alive]) * move
            back = np.where(alive[:, None], ahead @ move.T, 1.0)
    marginals /= marginals.sum(axis=2, keepdims=True)
    return marginals * live[:, :, None], expected, ((np.log(scale) + peak[:, :, 0]) * live).sum(axis=1)


def _learn_trigrams(texts: list[tuple[int, list[str]]], k: int, seed: int = 3) -> tuple[dict[str, int], float]:
    """The languages (as bits) that have a trigram, and the least fit, from windows that one in KEPT_BACK doesn't add to."""
    rng, seen = np.random.default_rng(seed), [0] * k
    grams: dict[str, int] = {}
    back = []
    for lang, words in texts:
        seen[lang] += 1
        if seen[lang] % KEPT_BACK == 0:
            back.append((lang, words))
        else:
            for gram in {g for w in words for g in trigrams(w)}:
                grams[gram] = grams.get(gram, 0) | 1 << lang
    if not back:
        return grams, 0.0
    share = lambda lang, words: np.mean([grams.get(g, 0) >> lang & 1 for w in words for g in trigrams(w)])
    plain, mixed = [share(lang, w) for lang, w in back], []
    for _, words in back:
        letters = rng.permutation(list("".join(words)))
        ends = np.cumsum([0, *map(len, words)])
        shuffled = ["".join(letters[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        mixed.append(max(share(i, shuffled) for i in range(k)))
    return grams, float(min(np.mean(plain) + np.mean(mixed), 2 * min(plain)) / 2)


def fit(rows: list[tuple[str, str]], steps: int = STEPS, rate: float = 0.4, decay: float = 1e-4) -> Field:
    """A field from (language, text). Sequences are taken from one text, and from two of different languages, half and half."""
    languages = sorted({lang for lang, _ in rows})
    k = len(languages)
    code = {lang: i for i, lang in enumerate(languages)}
    texts = [(code[lang], w) for lang, t in rows if (w := words_of(t))]
    counts = [Counter() for _ in languages]
    for lang, w in texts:
        counts[lang].update(w)
    lexicon: dict[str, list[int]] = {}
    for i, c in enumerate(counts):
        for word, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(word, []).append(i)
    grams, least_fit = _learn_trigrams(texts, k)
    if k < 2 or not texts:
        return Field(languages, np.zeros((BUCKETS, max(1, k)), np.float32), np.zeros((max(1, k),) * 2), lexicon, grams, least_fit)
    rng = np.random.default_rng(7)
    sequences: list[tuple[list[str], list[int]]] = []
    for lang, w in texts:
        for i in range(0, len(w), SEQUENCE):
            sequences.append((w[i : i + SEQUENCE], [lang] * len(w[i : i + SEQUENCE])))
    for i in range(len(sequences) // 4):
        a, b = rng.integers(0, len(sequences), 2)
        m, n = rng.integers(1, SEQUENCE // 2 + 1, 2)
        (aw, al), (bw, bl) = sequences[a], sequences[b]
        sequences.append((aw[:m] + bw[:n] + aw[m : 2 * m], al[:m] + bl[:n] + al[m : 2 * m]))
    vocabulary = {w: i for i, w in enumerate(sorted({w for s, _ in sequences for w in s}))}
    lists = [features(w, lexicon) for w in vocabulary]
    starts = np.cumsum([0, *map(len, lists)])[:-1]
    flat = np.fromiter((i for x in lists for i in x), np.int64)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    lengths = np.array([len(s) for s, _ in sequences])
    width = int(lengths.max())
    ids, gold = np.zeros((len(sequences), width), np.int64), np.zeros((len(sequences), width), np.int64)
    for i, (s, y) in enumerate(sequences):
        ids[i, : len(s)] = [vocabulary[w] for w in s]
        gold[i, : len(s)] = y
    live = np.arange(width)[None, :] < lengths[:, None]
    want = np.eye(k)[gold] * live[:, :, None]
    seen = np.zeros((k, k))
    pair = live[:, 1:]
    np.add.at(seen, (gold[:, :-1][pair], gold[:, 1:][pair]), 1)
    weights, moves = np.zeros((BUCKETS, k)), np.zeros((k, k))
    g_weights, g_moves = np.full((BUCKETS, k), 1e-8), np.full((k, k), 1e-8)
    total = live.sum()
    for _ in range(steps):
        per_word = np.add.reduceat(weights[flat], starts, axis=0)
        marginals, expected, _ = forward_backward(per_word[ids], lengths, moves)
        error = (marginals - want)[live]
        by_word = np.stack([np.bincount(ids[live], error[:, j], len(lists)) for j in range(k)], axis=1)
        down = np.stack([np.bincount(flat, by_word[owner, j], BUCKETS) for j in range(k)], axis=1) / total + decay * weights
        down_moves = (expected - seen) / total + decay * moves
        g_weights += down**2
        g_moves += down_moves**2
        weights -= rate * down / np.sqrt(g_weights)
        moves -= rate * down_moves / np.sqrt(g_moves)
    return Field(languages, weights.astype(np.float32), moves, lexicon, grams, least_fit)


class Labeller:
    """Labels whole texts; the scores of words are remembered."""

    def __init__(self, model: Field, memo: int = MEMO):
        self.model, self.memo = model, memo
        #: For each trigram of the model a row, with a one for each language that has it; row 0 is for all others.
        self.rows = {gram: i for i, gram in enumerate(model.grams, 1)}
        bits = np.array([0, *model.grams.values()], object)  # of any number of languages
        self.has = np.stack([(bits >> i & 1).astype(np.int32) for i in range(len(model.languages))], axis=1) if model.languages else np.zeros((len(bits), 0), np.int32)
        self.clear()

    def grams(self, words: list[str]) -> np.ndarray:
        """For each word how many of its trigrams each language has, and in the last column how many it has in all."""
        get = self.rows.get
        flat = np.fromiter((get(g, 0) for w in words for g in trigrams(w)), np.int32)
        sizes = np.array([len(w) for w in words])  # as many trigrams as letters, with the ends marked
        starts = np.cumsum([0, *sizes[:-1]])
        return np.column_stack([np.add.reduceat(self.has[flat], starts, axis=0), sizes])

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.runs: dict[str, bytes] = {}
        self.scores = np.zeros((1024, len(self.model.languages)), np.float32)
        self.fits = np.zeros((1024, len(self.model.languages) + 1), np.int32)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's words; new words are scored together."""
        if len(self.words) > self.memo or len(self.runs) > self.memo:
            self.clear()
        known, runs, fresh, out = self.words, self.runs, [], []
        for text in texts:
            row = text.split()
            for run in set(row).difference(runs):
                found = words_of(run)
                for w in found:
                    if w not in known:
                        known[w] = len(known)
                        fresh.append(w)
                runs[run] = array("I", [known[w] for w in found]).tobytes()
            out.append(np.frombuffer(b"".join(map(runs.__getitem__, row)), np.uint32))
        if fresh:
            if len(known) > len(self.scores):
                more = max(len(known), len(self.scores))
                self.scores, self.fits = (np.concatenate([x, np.zeros((more, x.shape[1]), x.dtype)]) for x in (self.scores, self.fits))
            for i in range(0, len(fresh), 4_000):
                part = fresh[i : i + 4_000]
                at = len(known) - len(fresh) + i
                self.scores[at : at + len(part)] = self.model.emissions(part)
                self.fits[at : at + len(part)] = self.grams(part)
        return out

    def marginals(self, ids: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """(index of the text, its words' distributions), in blocks of texts of like length."""
        order = sorted((i for i, x in enumerate(ids) if len(x)), key=lambda i: len(ids[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(ids[order[end]]) * (end + 1 - at) <= BLOCK:
                end += 1
            block = order[at:end]
            lengths = np.array([len(ids[i]) for i in block])
            padded = np.zeros((len(block), lengths.max()), np.int64)
            for r, i in enumerate(block):
                padded[r, : lengths[r]] = ids[i]
            found, _, _ = forward_backward(self.scores[padded].astype(np.float64), lengths, self.model.transitions)
            for r, i in enumerate(block):
                yield i, found[r, : lengths[r]]
            at = end

    def judge(self, texts: list[str]) -> Iterator[tuple[int, tuple[int, float, float, bool]]]:
        """(index of the text, (its language, the language's mean share, the fit, whether it is foreign)) of texts with letters.

        tops holds the language of each word of the text that was given last.
        """
        ids = self.ids(texts)
        for i, found in self.marginals(ids):
            mean, self.tops = found.mean(axis=0), found.argmax(axis=1)
            grams = int(self.fits[ids[i], -1].sum(dtype=np.int64))
            fit = float(self.fits[ids[i], self.tops].sum(dtype=np.int64) / grams)
            best = int(mean.argmax())
            yield i, (best, float(min(1.0, mean[best])), fit, fit + 0.5 / grams**0.5 < self.model.least_fit)


def held_out(id_col: str) -> Column:
    """True for the documents that are kept from training."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def training_rows(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """At most TRAIN_PER_LANGUAGE windows of each language, from rows that are not held out.

    Rows are taken in the order of a hash of id and text; each task keeps its first ones before anything is shuffled. More than
    MAX_LANGUAGES languages are an error: such a column hardly holds languages, and none is left out silently.
    """
    labelled = df.filter(F.col(lang_col).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(False)) & (F.length(text_col) > 0))
    narrow = labelled.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.xxhash64(id_col, text_col).alias("h"))
    languages = labelled.select(lang_col).distinct().limit(MAX_LANGUAGES + 1).count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has over {MAX_LANGUAGES} values")
    order = Window.partitionBy("l").orderBy("h")
    chosen = narrow.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= TRAIN_PER_LANGUAGE).select("i", "l", "h")
    chosen = F.broadcast(chosen.orderBy("l", "h").limit(TRAIN_PER_LANGUAGE * MAX_LANGUAGES))
    n = F.length(text_col)
    start = F.when(n > TRAIN_CHARS, F.pmod(F.xxhash64("h"), n - TRAIN_CHARS)).otherwise(0).cast("int") + 1
    hashed = labelled.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.xxhash64(id_col, text_col).alias("h"), text_col)
    rows = hashed.join(chosen, ["i", "l", "h"]).select("l", "h", F.substring(F.col(text_col), start, F.lit(TRAIN_CHARS)).alias("t"))
    found = rows.orderBy("l", "h", "t").limit(TRAIN_PER_LANGUAGE * MAX_LANGUAGES).collect()
    return [(r["l"], r["t"]) for r in found]


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field:
    return fit(training_rows(df, id_col, text_col, lang_col))


def identify(df: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text", segments: bool = False) -> DataFrame:
    """id, lang_pred, score (mean share of that language over the words), fit, and with segments the runs of words of one language.

    fit is the share of the text's trigrams that the training rows of each word's language have; foreign is true for a text that falls short
    of the model's least fit by more than chance allows its length. A null text, or one without letters, gives und with score and
    fit 0 and isn't foreign; so does every text if the model knows no language. Only the text is used, whole and of any length. Nothing
    is shuffled; repeated rows give repeated rows, rows without an id a row without one, and an empty table no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # of a size bounded by BUCKETS, MAX_LANGUAGES and the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, names = Labeller(shared.value, MEMO_ALONE), shared.value.languages
        for batch in small(batches, 4000):
            texts = batch.column(1).to_pylist()
            langs, scores, parts = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            fits, foreign = [0.0] * len(texts), [False] * len(texts)
            for i, (best, score, fit, strange) in labeller.judge(texts) if names else ():
                langs[i], scores[i], fits[i], foreign[i] = names[best], score, fit, strange
                if segments:
                    tops = labeller.tops
                    edges = [0, *(np.flatnonzero(np.diff(tops)) + 1).tolist(), len(tops)]
                    parts[i] = [{"lang": names[tops[a]], "first_word": a, "n_words": b - a} for a, b in zip(edges, edges[1:], strict=False)]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))
            columns = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.float64()), pa.array(foreign, pa.bool_()), pa.array(parts, kind)]
            yield pa.record_batch([batch.column(0), *columns], ["__id", "lang_pred", "score", "fit", "foreign", "segments"])
        labeller.clear()
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"__id {kind}, lang_pred string, score double, fit double, foreign boolean, segments array<struct<lang: string, first_word: int, n_words: int>>"
    out = map_batches(df.select(F.col(id_col).alias("__id"), text_or_empty(text_col)), run, schema).withColumnRenamed("__id", id_col)
    return out if segments else out.drop("segments")


def keep_known(df: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """The rows whose text is in one of the model's languages: those without letters and foreign ones go.

    A model without languages has nothing to reject by, and all rows stay. Each row is judged by its own text, in place: nothing is
    shuffled, and columns, repeated rows and rows without an id pass as they are.
    """
    if not model.languages:
        return df
    shared, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in small(batches, 4000):
            known = np.zeros(batch.num_rows, bool)
            for i, (_, _, _, foreign) in labeller.judge([t or "" for t in batch.column(at).to_pylist()]):
                known[i] = not foreign
            yield batch.filter(pa.array(known))
        labeller.clear()
        give_back()

    return map_batches(df, run, df.schema)
