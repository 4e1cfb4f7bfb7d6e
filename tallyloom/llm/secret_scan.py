"""Secret scans: patterns, and a character convolutional network over every candidate and its surroundings.

Three kinds of patterns give the base findings. Candidates are these and every other run of CANDIDATE_CHARS or more characters that keys
are made of, unless it lies within a base finding. The network reads a
candidate with the characters before and after it, a longer one in slices that overlap by half, and gives the odds that it is a secret.

Labels: the patterns' findings are secrets. Not secrets are candidates with evidence of their own: numbers (cards, telephone numbers,
dates, addresses of machines), host names and mail addresses, paths and names made of words, and words of the text joined by
signs. Long plain words are sampled apart from the rest, as there are so many, a third of them in capitals. All other candidates are unlabelled. Windows come also with another finding's surroundings, and secrets also spelt anew in
other alphabets and lengths, so that the network must know a secret without its keyword and in forms that no pattern has.

A held-out part of the labelled findings ends the fit when their loss no longer falls, calibrates the odds (Platt) and sets the threshold:
the highest that keeps RECALL of the held-out secrets, wherever that lies. Candidates that reach it are added as kind net; base
findings stay, with their odds beside them.

The network is fitted on all labelled findings. The first SAMPLE of each label by a hash start it; then passes over all that aren't held
out follow: each task takes its findings in steps from the common numbers on, and the tasks' numbers are averaged. The held-out loss, the
calibration and the threshold are sums and counts over all held-out findings. Scanning runs in the tasks over whole texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import cut, give_back, map_batches, small, text_or_empty

#: The kinds in the order in which findings that start together are listed.
KINDS = ("assign", "access", "hex", "net")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: The least length of other candidates.
CANDIDATE_CHARS = 12
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % CANDIDATE_CHARS)
_MIXED = re.compile(r"[0-9]|[a-z][A-Z]")
#: Shapes of candidates that are no secrets: numbers; host names; words and short numbers, with signs or capitals where one begins.
NUMBER = re.compile(r"[0-9+/_=.-]+")
HOST = re.compile(r"(?:[a-z0-9-]+\.)+[a-z]{2,6}")
NAMES = re.compile(r"[+/_=.-]*(?:(?:(?<![A-Za-z])[a-z]{3,15}(?![a-z])|[A-Z][a-z]{2,15}(?![a-z])|(?<![0-9])[0-9]{1,4}(?![0-9]))[+/_=.-]*)+")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A network's input: characters before, of (a slice of), and after the candidate.
BEFORE, INSIDE, AFTER = 20, 48, 12
#: Findings of each label that start the fit; part held out; recall that the threshold keeps; secrets spelt anew in either part at least.
SAMPLE, HELD, RECALL, RESPELT = 800, 0.25, 0.98, 200
#: Steps of the fit at most, rows of a step, steps between looks at the held-out loss, looks without gain that end it.
STEPS, ROWS, LOOK, PATIENCE = 1500, 64, 50, 4
#: Passes over all findings at most, their rate, secrets that a task has on average at least.
PASSES, PASS_RATE, TASK_SECRETS = 3, 0.001, 500
_FILTERS, _DIMS, _SPAN = 16, 8, 5

Span = tuple[int, int, str]


def base_findings(text: str) -> list[Span]:
    """(start, end, kind) by the patterns, leftmost and not overlapping within a kind; failing matches are dropped."""
    found: list[Span] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    found.sort(key=lambda f: (f[0], KINDS.index(f[2])))
    return found


def other_candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Runs that may be keys and reach beyond any base finding, in one sweep: base findings come by their starts."""
    out, at, end = [], 0, -1
    for m in RUN.finditer(text):
        a, b = m.span()
        while at < len(base) and base[at][0] <= a:
            end = max(end, base[at][1])
            at += 1
        if b > end:
            out.append((a, b))
    return out


def harmless(text: str, start: int, end: int) -> bool:
    """True if there is evidence that the candidate is no secret: its shape, or a mail address around it."""
    run = text[start:end].strip(".")
    if "@" in (text[max(0, start - 1) : start], text[end : end + 1]):
        return True
    return any(shape.fullmatch(run) for shape in (NUMBER, HOST, NAMES))


def _classes() -> np.ndarray:
    """A class for each of 256 characters: letters, digits and signs each for itself, other letters and the rest by groups."""
    out = np.full(256, 1, np.int64)
    for i in range(33, 127):
        out[i] = i - 30
    out[32], out[10] = 2, 2
    return out


_CLASS = _classes()
_SYMBOLS = 98


def window_of(text: str, start: int, end: int, inside: str) -> str:
    """The characters that the network reads, padded with zeros; inside is the candidate or a slice of it."""
    return text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + inside.ljust(INSIDE, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")


def windows_of(text: str, start: int, end: int) -> list[str]:
    """A window for each slice of the candidate; slices overlap by half, and the last ends where the candidate ends."""
    last = max(start, end - INSIDE)
    return [window_of(text, start, end, text[at : min(end, at + INSIDE)]) for at in [*range(start, last, INSIDE // 2), last]]


def encode(windows: list[str]) -> np.ndarray:
    """The class of each character of windows of one length; the zeros that pad them stay zeros."""
    raw = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(windows), -1 if windows else 0)
    return np.where(raw == 0, 0, _CLASS[np.minimum(raw, 255)])


#: Arrays that steps use again: taking and freeing their memory at each step would cost more than the step.
_ROOM: dict[tuple[str, np.dtype], np.ndarray] = {}


def _room(name: str, shape: tuple[int, ...], dtype: np.dtype) -> np.ndarray:
    """An array for one use at a time, with whatever its last use left in it."""
    n = math.prod(shape)
    if len(_ROOM.get((name, dtype), ())) < n:
        _ROOM[name, dtype] = np.empty(n, dtype)
    return _ROOM[name, dtype][:n].reshape(shape) if n else np.empty(shape, dtype)


def _neighbours(name: str, rows: np.ndarray) -> np.ndarray:
    """Each place of (rows, places, depth) side by side with the _SPAN - 1 places after it, which follow it in memory: a row for each such run."""
    n, places, depth = rows.shape
    out = _room(name, (n, places - _SPAN + 1, _SPAN * depth), rows.dtype)
    out[:] = np.lib.stride_tricks.as_strided(rows, out.shape, rows.strides)
    return out.reshape(-1, _SPAN * depth)


def _mean(act: np.ndarray) -> np.ndarray:
    """The mean over the places, as a product: numpy's own goes through so short an axis slowly."""
    return (np.full((1, act.shape[1]), 1 / act.shape[1], act.dtype) @ act)[:, 0]


@dataclass
class Network:
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    shift: float
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = 1.0
    report: dict[str, float] = field(default_factory=dict)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """What each layer makes of x; the first two are overwritten by the next call."""
        n = x.shape[1] - _SPAN + 1
        kind = self.embedding.dtype
        cols = _neighbours("cols", self.embedding.take(x, axis=0, out=_room("embedded", (*x.shape, _DIMS), kind), mode="clip"))
        act = np.matmul(cols, self.filters, out=_room("act", (len(cols), _FILTERS), kind))
        act += self.bias
        act = np.maximum(act, 0, out=act).reshape(len(x), n, _FILTERS)
        edges = (slice(0, BEFORE - _SPAN + 1), slice(BEFORE - _SPAN + 1, BEFORE + INSIDE), slice(BEFORE + INSIDE - 1, n))
        tops = [act[:, s].argmax(axis=1) + s.start for s in edges]
        pooled = np.concatenate([np.take_along_axis(act, t[:, None], axis=1)[:, 0] for t in tops] + [_mean(act[:, edges[1]])], axis=1)
        return cols, act, np.stack(tops), pooled, pooled @ self.dense + self.shift

    def odds(self, windows: list[str]) -> np.ndarray:
        """Calibrated probabilities."""
        if not windows:
            return np.zeros(0)
        parts = [self.forward(encode(windows[i : i + 512]))[4] for i in range(0, len(windows), 512)]
        return 1 / (1 + np.exp(-np.clip(self.scale * np.concatenate(parts) + self.offset, -30, 30)))


def _logits(net: Network, x: np.ndarray) -> np.ndarray:
    return np.concatenate([net.forward(x[i : i + 512])[4] for i in range(0, len(x), 512)])


def _loss(net: Network, x: np.ndarray, y: np.ndarray) -> float:
    """The mean log loss, both labels weighing the same."""
    signed = np.where(y > 0, 1, -1) * _logits(net, x)
    each = np.logaddexp(0, -signed)
    return float(each[y > 0].mean() + each[y == 0].mean())


NUMBERS = ("embedding", "filters", "bias", "dense", "shift")


def _network(*numbers) -> Network:
    """A network of numbers in single precision: steps take half the time."""
    return Network(*[np.asarray(part, np.float32) for part in numbers])


class _Steps:
    """Steps of a network down the slope of its loss (Adam)."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.step = net, rate, 0
        self.first, self.second = dict.fromkeys(NUMBERS, 0.0), dict.fromkeys(NUMBERS, 0.0)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> None:
        net, first, second = self.net, self.first, self.second
        self.step += 1
        middle = slice(BEFORE - _SPAN + 1, BEFORE + INSIDE)
        cols, act, tops, pooled, logit = net.forward(x)
        error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(x)).astype(act.dtype)
        back = error[:, None] * net.dense[None, :]
        n, edge = act.shape[1], _SPAN - 1
        padded = _room("padded", (len(x), n + 2 * edge, _FILTERS), act.dtype)
        padded[:] = 0
        grad_act = padded[:, edge : edge + n]
        grad_act[:, middle] = back[:, None, 3 * _FILTERS :] / (middle.stop - middle.start)
        for part in range(3):
            old = np.take_along_axis(grad_act, tops[part][:, None], axis=1)
            np.put_along_axis(grad_act, tops[part][:, None], old + back[:, None, part * _FILTERS : (part + 1) * _FILTERS], axis=1)
        grad_act *= act > 0
        flat = _room("flat", act.shape, act.dtype)
        flat[:] = grad_act
        flat = flat.reshape(-1, _FILTERS)
        # a place's gradient comes from the runs that end with it up to those that begin with it, so the filters' parts go backwards
        by_place = _neighbours("runs", padded) @ np.concatenate([part.T for part in np.split(net.filters, _SPAN)[::-1]])
        ids = x.ravel()
        grad_embedding = np.stack([np.bincount(ids, by_place[:, d], _SYMBOLS) for d in range(_DIMS)], axis=1)
        grads = {"embedding": grad_embedding.astype(act.dtype), "filters": cols.T @ flat, "bias": np.ones(len(flat), act.dtype) @ flat, "dense": pooled.T @ error, "shift": error.sum()}
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g**2
            setattr(net, k, getattr(net, k) - self.rate * (first[k] / (1 - 0.9**self.step)) / (np.sqrt(second[k] / (1 - 0.999**self.step)) + 1e-8))


def _fit_network(x: np.ndarray, y: np.ndarray, held: tuple[np.ndarray, np.ndarray], steps: int = STEPS, rate: float = 0.005) -> Network:
    """Fitted by steps, not epochs, until the held-out loss settles; rows of both labels in equal numbers."""
    rng = np.random.default_rng(11)
    start = (rng.normal(0, 0.3, (_SYMBOLS, _DIMS)), rng.normal(0, (_SPAN * _DIMS) ** -0.5, (_SPAN * _DIMS, _FILTERS)), np.zeros(_FILTERS), rng.normal(0, 0.1, 4 * _FILTERS), 0.0)
    net = _network(*start)
    take = _Steps(net, rate)
    best, least, without = {}, np.inf, 0
    by_label = [np.flatnonzero(y == label) for label in (0, 1)]
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(own, ROWS // 2) for own in by_label])
        take(x[rows], y[rows])
        if step % LOOK == 0:
            loss = _loss(net, *held)
            if loss < least - 1e-3:
                best, least, without = {k: getattr(net, k) for k in NUMBERS}, loss, 0
            else:
                without += 1
            if without == PATIENCE:
                break
    for k, value in best.items():
        setattr(net, k, value)
    return net


def _calibrate(net: Network, x: np.ndarray, y: np.ndarray) -> None:
    """Platt's scale and offset by Newton's method on held-out logits, then the threshold and what it keeps."""
    logit = _logits(net, x).astype(float)
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        w, d = p * (1 - p) + 1e-9, p - target
        h = np.array([[(w * logit**2).sum() + 1e-3, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [(d * logit).sum() + 1e-3 * (a - 1), d.sum()])
        a, b = max(0.05, a - np.clip(step[0], -1, 1)), b - np.clip(step[1], -5, 5)
    net.scale, net.offset = float(a), float(b)
    odds = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
    secrets = np.sort(odds[y > 0])
    net.threshold = float(secrets[int((1 - RECALL) * len(secrets))])
    net.report = {
        "held_out_secrets": int((y > 0).sum()), "held_out_others": int((y == 0).sum()),
        "recall": float((odds[y > 0] >= net.threshold).mean()), "false_alarms": float((odds[y == 0] >= net.threshold).mean()),
    }


_ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def _respell(window: str, rng: np.random.Generator) -> str:
    """The window of a secret with its characters drawn anew, of another length, at times behind a short word and a sign."""
    letters = _ALPHABETS[rng.integers(len(_ALPHABETS))]
    drawn = lambda of, n: "".join([of[i] for i in rng.integers(len(of), size=n).tolist()])
    word = drawn("abcdefghijklmnoprstuvwy", rng.integers(2, 5)) + "_-"[rng.integers(2)] if rng.random() < 0.4 else ""
    inside = word + drawn(letters, rng.integers(14, INSIDE + 1))
    return window[:BEFORE] + inside[:INSIDE].ljust(INSIDE, "\0") + window[-AFTER:]


def fit(secrets: list[str], others: list[str]) -> Network:
    """A calibrated network from windows of findings that are secrets and of candidates that aren't.

    With fewer than two of either nothing can be learned and held against anything: the threshold is then out of reach, the report is
    empty, and the patterns' findings stand alone.
    """
    if min(len(secrets), len(others)) < 2:
        return Network(np.zeros((_SYMBOLS, _DIMS)), np.zeros((_SPAN * _DIMS, _FILTERS)), np.zeros(_FILTERS), np.zeros(4 * _FILTERS), 0.0, threshold=2.0)
    rng = np.random.default_rng(5)
    sides = []
    for windows, label in ((secrets, 1.0), (others, 0.0)):
        order = [windows[i] for i in rng.permutation(len(windows))]
        n = max(1, round(HELD * len(order)))
        sides.append([(w, label) for w in order[:n]])
        sides.append([(w, label) for w in order[n:]])
    parts = []
    for rows in (sides[0] + sides[2], sides[1] + sides[3]):  # held out, fitted: none of one is in the other
        own = [w for w, label in rows if label]
        rows = rows + [(_respell(own[i % len(own)], rng), 1.0) for i in range(max(RESPELT, 2 * len(own)))]
        x, y = encode([w for w, _ in rows]), np.array([label for _, label in rows])
        swapped, other = x.copy(), rng.permutation(len(x))
        swapped[:, :BEFORE], swapped[:, -AFTER:] = x[other][:, :BEFORE], x[other][:, -AFTER:]
        parts.append((np.concatenate([x, swapped]), np.concatenate([y, y])))
    net = _fit_network(*parts[1], parts[0])
    _calibrate(net, *parts[0])
    return net


def _value_of(text: str, span: Span) -> tuple[int, int]:
    """Where the secret itself lies in a finding: the value of an assignment."""
    if span[2] == "assign" and (m := ASSIGN.match(text, span[0])):
        return m.span(2)
    return span[:2]


_CAPITALS = {c: c - 32 for c in range(ord("a"), ord("z") + 1)}
_WORDS = re.compile(r"[A-Za-z]{2,15}")


def _joined(text: str, mark: int) -> str | None:
    """A window of some neighbouring words of the text, joined by a sign into one run, at times with a number."""
    words = [m.span() for m in _WORDS.finditer(text, mark % len(text) if text else 0, (mark % len(text) if text else 0) + 200)]
    if len(words) < 4:
        return None
    chosen, sign = words[1 : 3 + mark // 7 % 2], ("-", "_", ".", "/", "")[mark // 3 % 5]
    parts = [text[a:b] if sign else text[a:b].capitalize() for a, b in chosen]
    run = sign.join([*parts, *([str(mark % 2100)] if mark // 5 % 2 else [])])
    return window_of(text, chosen[0][0], chosen[-1][1], run[:INSIDE])


def _labelled(text: str) -> Iterator[tuple[int, int, str]]:
    """(label: 1 secret, 0 not, -1 joined words, -2 plain words; hash of text and place, window) of a text; of a long finding one slice, chosen by the hash."""
    mark, base = zlib.crc32(text.encode("utf-8", "replace")), base_findings(text)
    found = [(1, *_value_of(text, span)) for span in base]
    found += [(0 if _MIXED.search(text, a, b) else -2, a, b) for a, b in other_candidates(text, base) if harmless(text, a, b)]
    for label, a, b in found:
        h = zlib.crc32(b"%d:%d" % (mark, a))
        slices = windows_of(text, a, b)
        window = slices[h % len(slices)]
        yield label, h, window.translate(_CAPITALS) if label == -2 and h % 3 == 0 else window
    if (words := _joined(text, mark)) is not None:
        yield -1, zlib.crc32(b"%d:" % mark), words


def labelled_findings(df: DataFrame, text_col: str = "text") -> DataFrame:
    """label, h, w: all labelled findings of all rows, equal ones once (see _labelled)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = sorted({row for text in batch.column(0).to_pylist() for row in _labelled(text)})
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["label", "h", "w"])
        give_back()

    return map_batches(df.select(text_or_empty(text_col)), run, "label int, h long, w string").distinct()


def _first(found: DataFrame) -> tuple[list[str], list[str]]:
    """Windows of the first SAMPLE secrets by the hash, and of as many of each kind of the others."""
    takes = [[r["w"] for r in found.filter(F.col("label") == label).orderBy("h", "w").limit(SAMPLE).collect()] for label in (1, 0, -1, -2)]
    return takes[0], takes[1] + takes[2] + takes[3]


def _sides(batch: pa.RecordBatch, times: int = 2) -> tuple[np.ndarray, np.ndarray, np.random.Generator]:
    """(findings, labels, a generator) of a batch of labelled findings, each secret spelt anew so many times among them."""
    labels, windows = batch.column(0).to_numpy(), batch.column(1).to_pylist()
    rng = np.random.default_rng(zlib.crc32("".join(windows[:50]).encode("utf-8", "replace")))
    own = [w for label, w in zip(labels, windows, strict=True) if label > 0]
    spelt = [_respell(w, rng) for w in own for _ in range(times)]
    return encode(windows + spelt).reshape(-1, BEFORE + INSIDE + AFTER), np.concatenate([labels > 0, np.ones(len(spelt), bool)]).astype(float), rng


def _other_surroundings(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    swapped, other = x.copy(), rng.permutation(len(x))
    swapped[:, :BEFORE], swapped[:, -AFTER:] = x[other][:, :BEFORE], x[other][:, -AFTER:]
    return swapped


def _pass(net: Network, found: DataFrame, first: tuple[list[str], list[str]]) -> Network:
    """The network after one pass over the findings: the mean of what the tasks made of it, by their steps. Some of the first findings
    go with every batch, as secrets and the rarer kinds of others are few in it; all of the batch's own are taken."""
    shared = found.sparkSession.sparkContext.broadcast((net, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, (secrets, others) = shared.value
        net = _network(*[getattr(net, k) for k in NUMBERS])
        take, half = _Steps(net, PASS_RATE), ROWS // 2
        for batch in batches:
            x, y, rng = _sides(batch)
            more = [secrets[i] for i in rng.integers(len(secrets), size=RESPELT // 2)] + [_respell(secrets[i], rng) for i in rng.integers(len(secrets), size=RESPELT)]
            also = [others[i] for i in rng.integers(len(others), size=RESPELT)]
            sides = [np.concatenate([x[y == 0], encode(also)]), np.concatenate([x[y > 0], encode(more)])]
            orders = [np.resize(rng.permutation(len(side)), -(-max(map(len, sides)) // half) * half) for side in sides]  # each at least once
            for at in range(0, len(orders[0]), half):
                rows = np.concatenate([side[order[at : at + half]] for side, order in zip(sides, orders, strict=True)])
                take(_other_surroundings(rows, rng) if rng.random() < 0.5 else rows, np.repeat([0.0, 1.0], half))
        yield pa.record_batch([pa.array([np.concatenate([np.ravel(getattr(net, k)) for k in NUMBERS]).tolist()], pa.list_(pa.float64())), pa.array([take.step], pa.int64())], ["numbers", "steps"])
        give_back()

    each = map_batches(found.select("label", "w"), run, "numbers array<double>, steps long").select("steps", F.posexplode("numbers").alias("at", "number"))
    mean = each.groupBy("at").agg((F.sum(F.col("number") * F.col("steps")) / F.sum("steps")).alias("number"))
    flat = np.array([r["number"] for r in sorted(mean.collect(), key=lambda r: r["at"])])  # some thousand numbers
    ends = np.cumsum([np.size(getattr(net, k)) for k in NUMBERS])
    return _network(*[part.reshape(np.shape(getattr(net, k))) for k, part in zip(NUMBERS, np.split(flat, ends[:-1]), strict=True)])


def _judged(net: Network, found: DataFrame, times: int) -> DataFrame:
    """y, logit of the held-out findings, with their own and other surroundings."""
    shared = found.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, rng = _sides(batch, times)
            if len(x):
                yield pa.record_batch([pa.array(np.concatenate([y, y])), pa.array(_logits(shared.value, np.concatenate([x, _other_surroundings(x, rng)])).astype(float))], ["y", "logit"])
        give_back()

    return cut(map_batches(found.select("label", "w"), run, "y double, logit double"))


def _mean_loss(judged: DataFrame) -> float:
    signed = F.when(F.col("y") > 0, -F.col("logit")).otherwise(F.col("logit"))
    each = F.greatest(signed, F.lit(0.0)) + F.log1p(F.exp(-F.abs(signed)))
    return sum(r["loss"] for r in judged.groupBy("y").agg(F.avg(each).alias("loss")).collect())


def _kth(values: DataFrame, k: int) -> float:
    """The value with k smaller ones before it, exactly: counts in narrower and narrower ranges, then one range's few values."""
    while True:
        low, high, n = values.agg(F.min("logit"), F.max("logit"), F.count("*")).first()
        if low == high:
            return low
        if n <= 10_000:
            return sorted(r["logit"] for r in values.collect())[k]
        place = F.least(F.floor((F.col("logit") - low) / (high - low) * 1000), F.lit(999))
        for r in sorted(values.groupBy(place.alias("at")).agg(F.count("*").alias("n")).collect(), key=lambda r: r["at"]):
            if k < r["n"]:
                values = values.filter(place == r["at"])
                break
            k -= r["n"]


def _calibrate_all(net: Network, judged: DataFrame) -> None:
    """What _calibrate does, by sums and counts over a table."""
    counts = {r["y"]: r["count"] for r in judged.groupBy("y").count().collect()}
    yes, no = counts[1.0], counts[0.0]
    a, b, logit = 1.0, 0.0, F.col("logit")
    for _ in range(30):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * logit + b))))
        w, d = p * (1 - p) + 1e-9, p - F.when(F.col("y") > 0, (yes + 1) / (yes + 2)).otherwise(1 / (no + 2))
        ll, l1, one, dl, d1 = judged.agg(F.sum(w * logit * logit), F.sum(w * logit), F.sum(w), F.sum(d * logit), F.sum(d)).first()
        step = np.linalg.solve(np.array([[ll + 1e-3, l1], [l1, one + 1e-3]]), [dl + 1e-3 * (a - 1), d1])
        a, b = float(max(0.05, a - np.clip(step[0], -1, 1))), float(b - np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-6:
            break
    net.scale, net.offset = a, b
    bound = _kth(judged.filter("y > 0").select("logit"), int((1 - RECALL) * yes))
    net.threshold = float(1 / (1 + np.exp(-np.clip(a * bound + b, -30, 30))))
    reach = {r["y"]: r["n"] for r in judged.filter(logit >= bound).groupBy("y").agg(F.count("*").alias("n")).collect()}
    net.report = {"held_out_secrets": yes, "held_out_others": no, "recall": reach[1.0] / yes, "false_alarms": reach.get(0.0, 0) / no}


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """A calibrated network from all labelled findings of all rows. Where each label has at most SAMPLE, the start is the
    whole fit; with fewer than eight secrets, too few to hold some out by their hash, it is the whole fit on the first of the others."""
    found = cut(labelled_findings(df, text_col).sortWithinPartitions("h", "label", "w"))  # steps come in the same order each time
    counts = {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}
    if max(counts.values(), default=0) <= SAMPLE or counts.get(1, 0) < 8:
        return fit(*_first(found))
    held = F.pmod(F.xxhash64("w"), F.lit(round(1 / HELD))) == 0
    own, kept = found.filter(~held).coalesce(max(1, counts[1] // TASK_SECRETS)), found.filter(held)
    sides = {r["y"]: r["count"] for r in kept.groupBy((F.col("label") > 0).alias("y")).count().collect()}
    first = _first(own)
    if len(sides) < 2 or min(map(len, first)) < 2:
        return fit(*_first(found))
    net = _pass(fit(*first), own, first)  # the start, from the first findings alone, never stands by itself
    times = max(2, -(-RESPELT // sides[True]))
    judged = _judged(net, kept, times)
    loss = _mean_loss(judged)
    for _ in range(PASSES - 1):
        after = _pass(net, own, first)
        seen = _judged(after, kept, times)
        less = _mean_loss(seen)
        if less >= loss - 1e-3:
            break
        net, judged, loss = after, seen, less
    _calibrate_all(net, judged)
    return net


def scan_batch(texts: list[str], net: Network) -> list[list[tuple[int, int, str, float]]]:
    """All findings of each text with their odds, sorted; the candidates of a batch are judged together."""
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    where, windows = [], []
    for i, text in enumerate(texts):
        base = base_findings(text)
        found = [(*span, *_value_of(text, span)) for span in base]
        found += [(a, b, "net", a, b) for a, b in other_candidates(text, base)] if net.threshold <= 1 else []
        for a, b, kind, x, y in found:
            slices = windows_of(text, x, y)
            windows += slices
            where.append((i, a, b, kind, len(slices)))
    odds, at = net.odds(windows), 0
    for i, a, b, kind, n in where:
        most = float(odds[at : at + n].max())
        at += n
        if kind != "net" or most >= net.threshold:
            out[i].append((a, b, kind, most))
    for spans in out:
        spans.sort(key=lambda f: (f[0], KINDS.index(f[2])))
    return out


def scan(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, findings array<struct<kind, start, end, odds>>: whole texts of any length, offsets in code points, end exclusive.

    Null counts as the empty text, which has none. Nothing is shuffled; repeated rows give repeated rows, rows without an id a row
    without one, and an empty table no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("odds", pa.float64())]))
        for batch in small(batches):
            found = scan_batch(batch.column(1).to_pylist(), shared.value)
            yield pa.record_batch([batch.column(0), pa.array([[{"kind": k, "start": a, "end": b, "odds": p} for a, b, k, p in f] for f in found], kind)], ["__id", "findings"])
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"__id {kind}, findings array<struct<kind: string, start: int, end: int, odds: double>>"
    return map_batches(df.select(F.col(id_col).alias("__id"), text_or_empty(text_col)), run, schema).withColumnRenamed("__id", id_col)


def redact_text(text: str, spans: list[tuple], mask: str = "[SECRET]") -> str:
    """The text with every finding, overlapping ones as one, replaced by the mask."""
    out, at = [], 0
    for a, b, *_ in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(df: DataFrame, net: Network, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows, in place and in as many batches, with findings in the text masked; null texts stay null, other columns as they are."""
    shared, at = df.sparkSession.sparkContext.broadcast(net), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = batch.column(at).to_pylist()
            found = scan_batch([t or "" for t in rows], shared.value)
            masked = pa.array([t if not f else redact_text(t, f, mask) for t, f in zip(rows, found, strict=True)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), masked)
        give_back()

    return map_batches(df, run, df.schema)
