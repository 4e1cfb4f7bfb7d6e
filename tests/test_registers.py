"""What corpora teach about their language, against plain versions."""

import random
import re
from collections import Counter, defaultdict

from tallyloom.operators import company, conventions, literacy

NAMES = ["Alice", "Justine", "Tom", "Felix"]


def story(n=700, seed=3):
    rng = random.Random(seed)
    nouns = ["baker", "garden", "letter", "river", "window", "walk", "friends"]
    out = []
    for _ in range(n):
        a, b, x, y = rng.choice(NAMES), rng.choice(NAMES), rng.choice(nouns), rng.choice(nouns)
        out.append(
            rng.choice(
                [
                    f"{a} was the {x}.", f"{a} is a {x} of the {y}.", f"Then he was walking to the {x} quickly.", f"“I see the {x},” said {a}.", f"“The {x}!” asked {b} slowly.",
                    f"Mr. {a} walked to the {y}, and the {x} asked nobody.", f"The {x} of {a} was quick and slow.", f"He had the {x} at the {y}.", f"“No,” {b} replied kindly, “a {x}.”",
                    f"{b} is going home with the kind {x}", f"It was raining greatly in the great {x}.\n\n{a} walks nicely", f"She is a nice {y}; she was at St. {b}.",
                ]
            )
        )
    return " ".join(out)


def plain_literacy(texts):
    freq, cap, low, start, fin, dot = (Counter() for _ in range(6))
    cop, nom, ing, pcap, noun, speech = (Counter() for _ in range(6))
    words = []
    for text in texts:
        for s in re.split(r"(?<=[.!?])\s+|\n{2,}", text or ""):
            words.append((s, [(m.start(), m.group()) for m in re.finditer(r"[^\W\d_’']*(?:[^\W\d_]|['’])+", s)]))
    for s, ws in words:
        for i, (at, w) in enumerate(ws):
            t, after = w.lower(), s[at + len(w) :]
            freq[t] += 1
            (cap if w[0].isupper() else low)[t] += 1
            start[t] += w[0].isupper() and i == 0
            rest = after.lstrip()
            fin[t] += not rest or not rest[0].isalpha()
            dot[t] += after.startswith(".")
    total = sum(freq.values())
    rank = sorted(freq, key=lambda t: (-freq[t], t))
    closing = lambda g: re.search(r"[,.!?;:—-]\s*[\"“”«»]\s*$", g[-3:]) is not None
    speaker = lambda w: w is not None and (w[0].isupper() or freq[w.lower()] / total > 0.003)
    for s, ws in words:
        for i, (at, w) in enumerate(ws):
            t = w.lower()
            prev, nxt = (ws[i - 1][1] if i else None), (ws[i + 1][1] if i + 1 < len(ws) else None)
            if prev and nxt and nxt.lower() in rank[:3]:
                p = prev.lower()
                cop[t] += prev[0].isupper() and (i == 1 or low[p] < cap[p])
                nom[t] += 1
            elif nxt and nxt[0].isupper():
                nom[t] += 1
            ing[t] += bool(nxt) and len(nxt) > 4 and nxt.lower().endswith("ing")
            pcap[t] += bool(prev) and prev[0].isupper()
            noun[t] += bool(prev) and prev.lower() == rank[0]
            speech[t] += closing(s[:at]) and speaker(nxt)
            speech[t] += i > 0 and closing(s[: ws[i - 1][0]]) and speaker(prev)
    c, f = (lambda t: cap[t] / freq[t]), (lambda t: fin[t] / freq[t])
    out = defaultdict(dict)
    for t, n in freq.items():
        if start[t] >= 3 and low[t] >= 2 * (cap[t] - start[t]) and low[t] >= start[t]:
            out["starter"][t] = start[t]
        if n >= 20 and len(t) <= 5 and c(t) <= 0.4 and f(t) <= 0.05 and nom[t] / n >= 0.25 and pcap[t] / n <= 0.2:
            out["preposition"][t] = n
        if dot[t] >= 3 and len(t) <= 6 and dot[t] / n >= 0.8 and (c(t) >= 0.8 or not re.search("[aeiouy]", t)):
            out["abbreviation"][t] = dot[t]
    link = {t: n for t, n in cop.items() if n > 0 and t not in rank[:8] and t not in out["preposition"] and c(t) < 0.4}
    best = lambda d, n: dict(sorted(d.items(), key=lambda e: (-e[1], e[0]))[:n])
    out["copula"] = best({t: n for t, n in link.items() if n >= 8 and f(t) < 0.3 and ing[t] >= 3}, 12)
    out["attribution-verb"] = best({t: n for t, n in speech.items() if n >= 3 and c(t) < 0.35 and t not in rank[:60] and not noun[t]}, 40)
    ly = [t for t in freq if t.endswith("ly") and len(t) > 4]
    if sum(t[:-2] in freq for t in ly) >= 5:
        for t in ly:
            b = t[:-2]
            if freq[t] >= 2 and (b in freq or b + "e" in freq or (b.endswith("i") and b[:-1] + "y" in freq)):
                out["modifier"][t] = freq[t]
    for t, n in link.items():
        if n >= 4 and t not in out["copula"]:
            out["modifier"][t] = max(n, out["modifier"].get(t, 0))
    claimed = {*out["copula"], *out["attribution-verb"], *out["modifier"]}
    for t, n in freq.items():
        forms = [t + "s", t + "ed", t + "ing"]
        forms += [t[:-1] + "ing"] if t.endswith("e") else []
        forms += [t[:-2], t[:-1]] if t.endswith("ed") else []
        forms += [t[:-3], t[:-3] + "e"] if t.endswith("ing") else []
        if n >= 5 and c(t) < 0.35 and n / total > 0.0002 and t not in claimed and (t in rank[:20] or not any(x in freq for x in forms)):
            out["function"][t] = n
    return {(r, t, n) for r, d in out.items() for t, n in d.items()}


def test_literacy(spark):
    filler = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} " * (600 if i < 7 else 200) for i in range(70))  # so that verbs aren't among the most frequent
    texts = [story(), story(200, 4), filler, None, "", " \n\n ", "x", "’ '", story(30, 5), story(30, 5)]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, token int")
    got = {tuple(r) for r in literacy.induce_literacy(df, "text").collect()}
    assert got == plain_literacy(texts)
    assert {r for r, _, _ in got} == set(literacy.REGISTERS)
    held = {(r, t) for r, t, _ in got}
    assert {("copula", "was"), ("attribution-verb", "replied"), ("abbreviation", "mr"), ("modifier", "quickly"), ("function", "the")} <= held


def test_literacy_of_nothing(spark):
    assert literacy.induce_literacy(spark.createDataFrame([], "text string"), "text").collect() == []
    assert literacy.induce_literacy(spark.createDataFrame([(None,), ("",), ("1 2 3",)], "text string"), "text").collect() == []


def test_frames_are_learned_from_speech(spark):
    texts = ['Ann asked dass the report is late. "Yes," replied Tom. Tom replied dass he left. The study shows dass it works. The fact dass he left. A new survey found dass.', None, ""]
    df = spark.createDataFrame([(t, "x") for t in texts], "text string, token string")
    quoted = df.selectExpr("text", "concat(text, ' He asked, \"no\"') as quoted")
    got = {(r.register, r.token): r["count"] for r in company.attribution_frames(quoted, "text", "quoted").collect()}
    assert {t for r, t in got if r == "attribution-verb"} == {"asked", "replied"}
    assert got["marker", "dass"] == 2 and ("marker", "that") not in got
    assert {t for r, t in got if r == "report-verb"} == {"asked", "replied", "shows", "found"}
    assert {t for r, t in got if r == "source-noun"} == {"study", "survey"}
    closed = spark.createDataFrame([("dass",), ("found",)], "token string")
    got = {(r.register, r.token) for r in company.attribution_frames(quoted, "text", "quoted", closed).collect()}
    assert ("report-verb", "found") not in got and ("marker", "dass") in got
    none = company.attribution_frames(spark.createDataFrame([], "text string"), "text").collect()
    assert [(r.register, r.token, r["count"]) for r in none] == [("marker", "that", 0)]


def plain_slots(docs, frame_size, pool_size, least, k, floor):
    freq = Counter(t for d in docs for t in d if t != company.BOUNDARY)
    order = sorted(freq, key=lambda t: (-freq[t], t))
    frame, pool = set(order[:frame_size]), [t for t in order if freq[t] >= least][:pool_size]
    near = defaultdict(Counter)
    for d in docs:
        for a, b in zip(d, d[1:]):
            if company.BOUNDARY not in (a, b):
                near[a]["R" + b] += b in frame
                near[b]["L" + a] += a in frame
    norm = {t: sum(c * c for c in near[t].values()) ** 0.5 for t in pool}
    sim = lambda a, b: sum(c * near[b][x] for x, c in near[a].items()) / (norm[a] * norm[b]) if norm[a] * norm[b] else 0.0
    top = {a: [(s, b) for s, b in sorted(((sim(a, b), b) for b in pool if b != a), key=lambda e: (-e[0], e[1]))[:k] if s >= floor] for a in pool}
    root = {t: t for t in pool}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a in pool:
        for _, b in top[a]:
            if any(x == a for _, x in top[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = defaultdict(list)
    for t in pool:
        groups[find(t)].append(t)
    return sorted(groups.values(), key=lambda g: (-len(g), g[0])), freq


def test_rungs(spark):
    rng = random.Random(2)
    det, nouns, verbs = ["the", "a"], ["cat", "dog", "cow", "hen"], ["runs", "eats"]
    docs = []
    for d in range(12):
        seq = []
        for _ in range(25):
            seq += [rng.choice(det), rng.choice(nouns), rng.choice(verbs), *([rng.choice(det), rng.choice(nouns)] if rng.random() < 0.5 else []), company.BOUNDARY]
        docs.append(seq)
    sizes = {"frame_size": 20, "pool_size": 50, "least": 3, "k": 10, "floor": 0.6}
    stream = spark.createDataFrame([(d, i, t) for d, seq in enumerate(docs) for i, t in enumerate(seq)], "doc int, pos int, token string")
    got = {(r.rung, r.token, r.slot, r.size, r.freq) for r in company.rungs(stream, most=4, **sizes).collect()}
    want, now = set(), docs
    for rung in range(4):
        groups, freq = plain_slots(now, **sizes)
        slot_of = {t: i for i, g in enumerate(groups) for t in g}
        want |= {(rung, t, s, len(groups[s]), freq[t]) for t, s in slot_of.items()}
        if all(len(g) == 1 for g in groups):
            break
        now = [[f"§{slot_of[t]}" if t in slot_of else t for t in d] for d in now]
    assert got == want and 1 <= max(r for r, *_ in got) < 4
    assert company.rungs(stream.limit(0)).collect() == []


def test_rungs_are_climbed_to_the_end(spark, monkeypatch):
    """Far more rungs than pools hold at first; chapters of few pairs, signs that the pool leaves out, and words that look like signs."""
    monkeypatch.setattr(company, "CHAPTER", 150)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)] + ["§3", "§11", "§007", "§999"]
    docs = [[rng.choice(words[: rng.choice([8, 40, 124])]) for _ in range(30)] + ["§3", company.BOUNDARY, "w1"] for _ in range(40)]
    sizes = {"frame_size": 9, "pool_size": 12, "least": 3, "k": 4, "floor": 0.3}
    stream = spark.createDataFrame([(d, i, t) for d, seq in enumerate(docs) for i, t in enumerate(seq)], "doc int, pos int, token string")
    got = {(r.rung, r.token, r.slot, r.size, r.freq) for r in company.rungs(stream, **sizes).collect()}
    want, now = set(), docs
    for rung in range(1000):
        groups, freq = plain_slots(now, **sizes)
        slot_of = {t: i for i, g in enumerate(groups) for t in g}
        want |= {(rung, t, s, len(groups[s]), freq[t]) for t, s in slot_of.items()}
        if all(len(g) == 1 for g in groups):
            break
        now = [[f"§{slot_of[t]}" if t in slot_of else t for t in d] for d in now]
    assert got == want and max(r for r, *_ in got) > 6
    monkeypatch.setattr(company, "DENSE", 1)
    wide = {(r.rung, r.token, r.slot, r.size, r.freq) for r in company.rungs(stream, most=2, **sizes).collect()}
    assert wide == {r for r in want if r[0] < 2}


def test_sediment_replaces_registers(spark):
    seeds = conventions.seed(spark, {"copula": ["is", "was"], "demonym": ["french"], "abbreviation": ["mr"]})
    induced = spark.createDataFrame([("copula", "Ist.", 9), ("copula", "was", 4), ("starter", "the", 3)], "register string, token string, weight long")
    both = conventions.overlay(seeds, conventions.sediment(induced, "shelf"))
    assert {(r.kind, r.token, r.shelf, r.support) for r in both.collect()} == {("copula", "ist", "shelf", 3), ("copula", "was", "shelf", 3), ("demonym", "french", None, 3), ("abbreviation", "mr", None, 3)}
    words = spark.createDataFrame([("IS",), ("ist",), ("French.",), (None,), ("",), ("ist",)], "token string")
    asked = lambda e: {(r.question, r.token) for r in conventions.all_answers(words, e).collect()}
    assert asked(seeds) == {("copula", "is"), ("auxiliary", "is"), ("demonym", "french")}
    assert asked(both) == {("copula", "ist"), ("auxiliary", "ist"), ("demonym", "french")}
    assert conventions.overlay(seeds, conventions.sediment(induced.limit(0), "none")).count() == seeds.count()


def test_irregular_pasts(spark):
    pairs = spark.createDataFrame([("write", "wrote"), ("bid", "bid"), ("bid", "bade")], "base string, past string")
    verbs = spark.createDataFrame([("Write", 1), ("wrote.", 2), ("bid", 3), ("walk", 4), (None, 5)], "token string, past int").drop("past")
    got = {r.token: (r.past, r.is_past) for r in conventions.irregular_past(verbs, pairs).collect()}
    assert got == {"Write": ("wrote", False), "wrote.": (None, True), "bid": ("bade", True), "walk": (None, False), None: (None, False)}


def test_rungs_need_pairs_alone(spark):
    """Pairs read from texts are those of their stream, and lifting pairs is lifting the stream; no text is shuffled or ordered."""
    texts = spark.createDataFrame([(1, "a b a b c. b"), (2, ""), (3, None), (4, "c"), (5, "b a")], "doc int, text string")
    stream = company.token_stream(texts, "text", "doc")
    rows = lambda df: {tuple(r) for r in df.collect()}
    met = company.text_pairs(texts, "text")
    assert rows(met.select("token", "next", "count")) == rows(company.pairs(stream).select("token", "next", "count")) and "Window" not in met._jdf.queryExecution().optimizedPlan().toString()
    slot_of = spark.createDataFrame([("a", 0), ("b", 0)], "token string, slot int")
    assert rows(company.lift_pairs(met, slot_of).select("token", "next", "count")) == rows(company.pairs(company.lift(stream, slot_of)).select("token", "next", "count"))
    F = company.F
    broken = stream.withColumn("token", F.when(F.col("pos") == 2, company.BOUNDARY).otherwise(F.col("token")))
    assert rows(company.pairs(broken).filter("next is not null").select("token", F.lit("R"), "next", "count")) <= rows(company.neighbours(broken))


def test_frames_shuffle_only_what_a_marker_follows(spark):
    texts = spark.createDataFrame([('"x" said that he goes; he reported that one fell. noise of many other words',)] * 3, "text string")
    marks = spark.createDataFrame([("that",)], "token string")
    assert {r.next for r in company.report_grams(texts, "text", marks).collect()} == {"that"}


def test_words_are_counted_once_for_sediment_and_frames(spark, monkeypatch):
    """Both read what the profile of the words wrote."""
    from tallyloom.plans import registers

    counted, written, profile, cut = [], [], literacy.profile, registers.cut
    monkeypatch.setattr(literacy, "profile", lambda words: counted.append(1) or profile(words))
    monkeypatch.setattr(registers, "cut", lambda df: written.append(1) or cut(df))
    registers.k02_sediment(spark, "/root/testdata/sf0.001")
    assert len(counted) == 1
    registers.a23_frames(spark, "/root/testdata/sf0.001")
    assert len(counted) == len(written) == 2


def test_words_take_along_what_they_need_of_their_sentence(spark):
    df = spark.createDataFrame([("Él said, “Go now.” ... It's\n\n1 b",), (None,), ("",), ("--",)], "t string")
    words = literacy.sentence_words(df, "t")
    got = [(r.word, r.prev, r.next, r.place, r.before, r.before_prev, r.after) for r in words.collect()]
    assert got == [
        ("Él", None, "said", 0, "", None, " "), ("said", "Él", "Go", 1, " ", "", ", “"), ("Go", "said", "now", 2, ", “", " ", " "), ("now", "Go", None, 3, " ", ", “", ".” ..."),
        ("It's", None, None, 0, "", None, ""), ("b", None, None, 0, "1 ", None, ""),
    ]
    assert "posexplode" not in words._jdf.queryExecution().optimizedPlan().toString()  # each word copied its sentence's arrays before
