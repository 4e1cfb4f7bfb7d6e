"""Clusters, whitening and fingerprints against brute force, on small rows with every odd case."""

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tallyloom.llm import clustering, fingerprints, queries, whitening

VECTOR_ROWS = "vec_id long, embedding array<double>, label int, x int, cluster int, distance int, n int"


def vectors(spark, rows, schema=VECTOR_ROWS):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5) for i, v in rows], schema)


def odd_vectors(dims=64, n=60, seed=5):
    rng = np.random.default_rng(seed)
    good = [(i, (rng.normal(size=dims) * rng.choice([0.1, 2.0], dims)).tolist()) for i in range(n)]
    good += [(7, good[7][1]), (8, good[9][1]), (None, good[3][1]), (n, [0.0] * dims), (n + 1, [0.0] * dims)]
    bad = [(900, None), (901, good[0][1][:-1] + [None]), (902, good[0][1][:-1] + [math.nan]), (903, good[0][1][:-1] + [-math.inf]), (904, []), (905, good[0][1][:-1])]
    return good, bad


def plain_clusters(rows, k=8, rounds=10):
    x = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows]
    first = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in x)[:k]
    centres = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in x]

    for _ in range(rounds):
        members = defaultdict(list)
        for (_, j), (_, v) in zip(assign(), x, strict=True):
            members[j].append(v)
        for j, vs in members.items():
            centres[j] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    found, inertia = assign(), defaultdict(int)
    for d, j in found:
        inertia[j] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, j, d, inertia[j], sum(inertia.values()), names[j]) for (i, _), (d, j) in zip(x, found, strict=True)]


def test_clusters(spark, tmp_path):
    good, bad = odd_vectors()
    vectors(spark, good + bad).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [tuple(r) for r in queries.op11_clustering(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(plain_clusters(good), key=repr)


def test_few_and_no_vectors(spark):
    good, bad = odd_vectors()
    for rows in (good[:3], [good[0]] * 9, good[:1]):
        got = [tuple(r) for r in clustering.cluster_vectors(vectors(spark, rows), rounds=2).collect()]
        assert sorted(got, key=repr) == sorted(plain_clusters(rows, rounds=2), key=repr)
    for rows in (bad, []):
        assert clustering.cluster_vectors(vectors(spark, rows)).collect() == []
    with pytest.raises(Exception, match="beyond"):
        clustering.cluster_vectors(vectors(spark, [(1, [1e30] * 64)])).collect()


def test_partial_distances_abandon_and_keep_ties():
    rng = np.random.default_rng(1)
    c = rng.integers(-900, 900, (8, 64))
    c[5] = c[2]
    x = np.concatenate([c[rng.integers(0, 8, 300)] + rng.integers(-30, 30, (300, 64)), (c[:4] + c[4:]) // 2])
    for order in (np.arange(64), rng.permutation(64)):
        who, d, terms = clustering.nearest(x, c, order)
        whole = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (who == whole.argmin(1)).all() and (d == whole.min(1)).all()
        assert terms < 0.6 * whole.size * 64


def plain_whitening(rows, most=8):
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(col) for col in zip(*x, strict=True)]
    m = [[n * a - s for a, s in zip(v, sums, strict=True)] for v in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in m), n**3)) for j in range(d)] for i in range(d)])
    return n, m, cov


def check_whitening(got, rows, most=8):
    n, m, cov = plain_whitening(rows)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(most, len(cov))
    by_id = defaultdict(list)
    for r in got:
        by_id[r.vec_id].append(r)
    assert len(got) == k * n
    for (i, _), dev in zip(rows, m, strict=True):
        mine = [r for r in by_id[i] if r.deviation_exact == sum(v * v for v in dev)]
        assert {r.component for r in mine} == set(range(1, k + 1))
        for r in mine:
            assert r.n == n and r.deviation == sum(v * v for v in dev)
            assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
            want = float(np.dot(np.array(dev) / n, axes[:, r.component - 1]) / math.sqrt(values[r.component - 1]))
            assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-7)
            assert r.identity_error < 1e-9
    for c in range(1, k + 1):
        w = np.array([r.whitened for r in got if r.component == c])
        assert abs(w.mean()) < 1e-9 and w.var() == pytest.approx(1, abs=1e-9)


def test_whitening(spark, tmp_path):
    good, bad = odd_vectors(dims=12, n=70)
    vectors(spark, good + bad[:4] + [(905, good[0][1][:-1]), (904, [])]).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op12_whitening(spark, str(tmp_path)).collect()
    assert got[0].deviation > 0
    check_whitening(got, good)


def test_whitening_of_short_few_and_no_vectors(spark):
    rng = np.random.default_rng(3)
    short = [(i, rng.normal(size=3).tolist()) for i in range(20)]
    check_whitening(whitening.whiten_vectors(vectors(spark, short)).collect(), short)
    flat = [(i, [float(i), 1.0, float(i)]) for i in range(5)]  # one direction only
    got = whitening.whiten_vectors(vectors(spark, flat)).collect()
    assert {(r.component, r.whitened is None) for r in got} == {(1, False), (2, True), (3, True)}
    assert all(r.identity_error < 1e-9 for r in got)
    one = whitening.whiten_vectors(vectors(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, None, None, None)] * 2
    assert whitening.whiten_vectors(vectors(spark, [])).collect() == []
    assert whitening.whiten_vectors(vectors(spark, [(1, None), (2, [])])).collect() == []


def test_compensated_sums_keep_what_doubles_lose():
    rng = np.random.default_rng(2)
    rows = [[float(v) for v in rng.integers(-(2**52), 2**52, 2)] for _ in range(300)]
    rows += [[-a, b] for a, b in rows] + [[1.0, 1.0]]
    x = np.array(rows)
    i, j = np.triu_indices(2)
    high, low = whitening.column_sums(whitening.outer_products((x, np.zeros_like(x)), i, j))
    exact = [sum(int(r[a]) * int(r[b]) for r in rows) for a, b in zip(i, j, strict=True)]
    assert [int(h) + int(e) for h, e in zip(high, low, strict=True)] == pytest.approx(exact, rel=1e-30, abs=1)
    assert exact[1] == 1


def test_deviations_beyond_a_long():
    x = np.array([[0, 5], [2**26, -(2**26)]])
    for n in (2, 10**6, 10**9, 10**10):
        s = np.array([n // 2, 7])
        want = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
        assert whitening.squared_deviation(x, s, n) == want


SPACE = " \t\n\x0b\f\r"


def plain_print(text, words=5, scale=8):
    for c in SPACE:
        text = text.replace(c, " ")
    w = [x for x in text.lower().split(" ") if x]
    h = {hashlib.md5(" ".join(w[i : i + words]).encode()).hexdigest()[:16] for i in range(max(1, len(w) - words + 1))} if w else set()
    low = {x for x in h if int(x, 16) < 2**64 // scale}
    return sorted(low or ({min(h)} if h else set()))


def plain_likeness(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def texts_of(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "straße", "漢字", "😀"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    return ["", None, " \n", "one", "a b c d e", "A  b\tc\nd e", prose(40), prose(900), prose(7), prose(200), "x" * 3001, "lo " * 20_000, prose(11), "\x1c odd \x1f space wide　cjk"]


def plain_report(rows):
    """rows: (id, text) in order, without repeats."""
    bodies = [(i, t or "") for i, t in rows]
    out = []
    for (i, t), (_, after) in zip(bodies, bodies[1:] + bodies[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = plain_print(t), plain_print(edited), plain_print(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), ",".join(a), ",".join(b), plain_likeness(a, b), plain_likeness(a, c)))
    return out


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "h", 2, 3) for i, t in rows], "doc_id long, text string, lang string, id int, h string, copies int, next int")


def test_fingerprints(spark, tmp_path):
    rows = [(3 * i - 5, t) for i, t in enumerate(texts_of())]
    documents(spark, random.Random(1).sample(rows, len(rows))).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r)[:7] for r in queries.op13_fingerprints(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(plain_report(rows))


def test_fingerprints_of_repeated_and_null_ids(spark):
    rows = [(None, "first of all of these texts here"), (1, "a b c d e f"), (2, "g h i j k l m n"), (9, None)]
    got = [tuple(r)[:7] for r in fingerprints.fingerprint_report(documents(spark, rows + [rows[1]] * 2 + [rows[0], rows[3]])).collect()]
    want = plain_report(rows)
    assert sorted(got, key=repr) == sorted(want + [want[1]] * 2 + [want[0], want[3]], key=repr)
    clash = fingerprints.fingerprint_report(documents(spark, [(1, "a b"), (1, "c d"), (2, "e")])).collect()
    assert sorted(r.doc_id for r in clash) == [1, 1, 2] and len({r.edited_sha256 for r in clash}) == 3
    alone = fingerprints.fingerprint_report(documents(spark, [(4, "abcd")])).collect()
    assert [(r.edited_sha256, r.near_edited, r.near_next) for r in alone] == [(hashlib.sha256(b"abab").hexdigest(), 0.0, 1.0)]
    assert fingerprints.fingerprint_report(documents(spark, [])).collect() == []


def test_prints_merge_and_estimate(spark):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(4000))
    part = " ".join(text.split(" ")[1000:1400])
    df = spark.createDataFrame([(1, text), (1, part), (2, part), (2, "three words only"), (None, "q r s t u v"), (3, ""), (4, "three words only")], "g int, text string")
    df = df.withColumn("p", fingerprints.fingerprint(df.text))
    merged = defaultdict(set)
    for r in fingerprints.merge_groups(df, "g", "p").collect():
        merged[r.g].add(r.hash)
    prints = defaultdict(set)
    for t in df.collect():
        assert t.p == plain_print(t.text)
        prints[t.g] |= set(t.p)
    for g in (1, 2, None, 3, 4):
        low = {h for h in prints[g] if h < "2"}
        assert merged[g] == (low or set(sorted(prints[g])[:1]))
    a, b = (fingerprints.fingerprint(c) for c in (df.text, fingerprints.F.lit(part)))
    r = df.filter("g = 1").orderBy(fingerprints.F.length("text").desc()).select(fingerprints.containment(b, a).alias("c"), fingerprints.containment(a, b).alias("d"), fingerprints.likeness(a, b).alias("l"), fingerprints.merge(a, b).alias("m"), a.alias("a")).first()
    assert r.c == 1.0 and r.m == r.a and abs(r.l - 396 / 3996) < 0.03 and abs(r.d - 396 / 3996) < 0.03
