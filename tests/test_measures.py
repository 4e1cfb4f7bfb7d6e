import math
import random

import numpy as np
import pytest

from tallyloom.functions import cube
from tallyloom.operators import emergence, folds, measure, priors, records

F = measure.F


def test_cube():
    assert len(cube.CELL_NAMES) == 27 and cube.CELL_NAMES[:4] == ["NUL_Clearing_Void", "NUL_Dissecting_Entity", "NUL_Unraveling_Kind", "SEG_Clearing_Field"]
    assert cube.CELL_NAMES[-1] == "REC_Composing_Paradigm" and cube.BY_NAME[0] == "CON_Binding_Link"


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 2.0, 3.0], [2.0, 4.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(measure.cosine(F.col("a"), F.col("b"))).collect()]
    assert np.allclose(got, [1, 0, 0, 1])


def test_shares(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0],), ([0.0, 0.0, 0.0],), ([0.5, 0.5, 0.0],)], "w array<double>")
    assert [list(r.out) for r in measure.add_shares(df, F.col("w"), "out").collect()] == [[333333, 333333, 333334], [0, 0, 0], [500000, 500000, 0]]


ACTS = "id int, acts array<struct<act:string,grain:string,weight_ppm:long>>, held boolean"


def fold(spark, rows):
    out = measure.cells_long(measure.measure_folds(spark.createDataFrame(rows, ACTS)), "id").filter("amplitude_ppm > 0").collect()
    return {(r.id, cube.CELL_NAMES[r.cell]): r.amplitude_ppm for r in out}


def test_folds(spark):
    got = fold(spark, [(1, [], True), (2, [], False), (3, [("CON", "Figure", 600000), ("SIG", "Figure", 400000)], False), (4, None, True)])
    assert got == {(1, "NUL_Dissecting_Entity"): 1000000, (3, "CON_Binding_Link"): 600000, (3, "SIG_Binding_Entity"): 400000, (4, "NUL_Dissecting_Entity"): 1000000}


def test_unknown_cell_is_an_error(spark):
    with pytest.raises(Exception, match="no cell"):
        fold(spark, [(1, [("XXX", "Figure", 1)], False)])


SITE = "struct<cultivating:double,clearing:double,tending:double>"
READING = f"id int, surprises array<string>, n_syn int, ground struct<void:{SITE},field:{SITE},atmosphere:{SITE}>, held boolean, predicted boolean"


def test_readings(spark):
    full = ((1.0, 1.0, 1.0),) * 3
    rows = [(1, [], 0, None, False, False), (2, [], 0, None, True, True), (3, ["INS", "SEG"], 1, None, False, True), (4, [], 0, full, False, False), (5, [], 0, ((0.0, 1.0, 1.0), *full[1:]), False, False), (6, None, None, None, False, False)]
    got = {r.id: r.acts for r in folds.fold_readings(spark.createDataFrame(rows, READING)).collect()}
    acts = {i: sorted(e.act for e in a) for i, a in got.items()}
    assert acts[1] == ["EVA"] and acts[2] == ["EVA", "NUL", "REC"] and acts[3] == ["EVA", "INS", "REC", "SEG", "SYN", "SYN"] and acts[6] == ["EVA"]
    assert sum(e.grain == "Ground" for e in got[4]) == 9 and sum(e.grain == "Ground" for e in got[5]) == 8
    assert all(sum(e.weight_ppm for e in a) == 1_000_000 for a in got.values())


def one_hot(i, mass=1.0, n=12):
    p = np.full(n, (1 - mass) / (n - 1))
    p[i] = mass
    return p


def brute_condense(p, overhead):
    def gain(rows):
        v = p[rows]
        q = v.sum(axis=0) / (v.sum() or 1)
        ent = lambda x: math.floor(sum(-a * math.log2(a) for a in x if a > 0) * 1e6 + 0.5) / 1e6
        return sum(ent(x) * min(1, sum(math.sqrt(a * b) for a, b in zip(x, q, strict=True))) for x in v) - ent(q) - overhead

    clusters = [[i] for i in range(len(p))]
    while True:
        best = None
        for i in range(len(clusters)):
            for j in range(i + 1, len(clusters)):
                d = round(gain(clusters[i] + clusters[j]) - gain(clusters[i]) - gain(clusters[j]), 9)
                if d > 0 and (best is None or d > best[0]):
                    best = (d, i, j)
        if best is None:
            return clusters
        _, i, j = best
        clusters = [c for k, c in enumerate(clusters) if k not in (i, j)] + [clusters[i] + clusters[j]]


def test_condense_equals_brute_force():
    rng = np.random.default_rng(3)
    for case in range(25):
        p = rng.dirichlet(np.full(6, 0.4), rng.integers(2, 10))
        p[rng.integers(len(p))] = p[0]
        overhead = [0.1, 0.3, 1.0][case % 3]
        assert emergence.condense(p, overhead) == brute_condense(p, overhead)


def test_tiers():
    p = np.stack([one_hot(0, 0.9)] * 3 + [one_hot(2, 0.9)])
    figs, residual = emergence.figures(["o1", "o2", "o3", "o4"], ["s"] * 4, p, emergence.Policy(0.3))
    assert [sorted(f["members"]) for f in figs] == [["o1", "o2", "o3"]] and residual == [3]
    two = np.stack([one_hot(0, 0.4)] * 2)
    assert len(emergence.grounds(["a", "b"], ["s1", "s2"], two, emergence.Policy(0.01))) == 1
    assert emergence.grounds(["a", "b"], ["s1", "s1"], two, emergence.Policy(0.01)) == []


def test_identity(spark):
    schema = "name string, tier string, members array<string>"
    before = spark.createDataFrame([("h1", "Figure", ["a", "b", "c"]), ("h2", "Pattern", ["a", "b"])], schema)
    after = spark.createDataFrame([("n1", "Figure", ["a", "b", "c"]), ("n2", "Figure", ["a", "x", "y", "z"]), ("n3", "Figure", ["q"])], schema)
    got = {r.candidate: (r.previous, r.outcome) for r in emergence.identify(after, before).collect()}
    assert got == {"n1": ("h1", "kept"), "n2": ("h1", "rebound"), "n3": (None, "minted")}


def spans(spark, rows):
    return spark.createDataFrame([(b, i, c, p) for b, i, ps in rows for c, p in enumerate(ps)], "book string, pos int, cell int, p double")


def test_prior_laws(spark):
    s = spans(spark, [("a", 0, [0.7, 0.1, 0.1, 0.1]), ("a", 1, [0.25] * 4), ("b", 0, [1.0, 0.0, 0.0, 0.0])])
    q = priors.normalise(priors.accumulate(s, "book"), "book")
    assert all(abs(r[1] - 1) < 1e-9 for r in q.groupBy("book").sum("q").collect())
    flat = spark.createDataFrame([(c, 0.25) for c in range(4)], "cell int, q double")
    bits = [r.bits for r in priors.surprise(s, flat, ["cell"]).collect()]
    assert np.allclose(bits, 2.0)
    empty = priors.normalise(spark.createDataFrame([("a", c, 0.0) for c in range(4)], "book string, cell int, mass double"), "book")
    assert {r.q for r in empty.collect()} == {0.25}
    ppm = priors.exact_ppm(q, "book").groupBy("book").sum("ppm").collect()
    assert {r[1] for r in ppm} == {1_000_000}


def test_correlation_of_a_constant_is_zero(spark):
    mass = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0), ("b", 0, 1.0), ("b", 1, 2.0), ("c", 0, 2.0), ("c", 1, 4.0)], "book string, cell int, mass double")
    got = {(r.a, r.b): r["corr"] for r in priors.correlations(mass, "book").collect()}
    assert got[("a", "b")] == 0 and abs(got[("b", "c")] - 1) < 1e-12


def test_records():
    d, c, x = ["DEF"], ["CON"], ["X"]
    exact = records.Mining(min_units=2, max_units=2, similarity=1.0)
    (g,) = records.mine([d, c, d, c], exact)
    assert g["starts"] == [0, 2] and g["confidence"] == 1.0
    best = records.mine([d, c, x, d, c, x, d, c], records.Mining(min_units=2, max_units=2, similarity=1.0, max_gap=1))[0]
    assert best["starts"] == [0, 3, 6]
    assert records.jaccard(frozenset(), frozenset()) == 1.0 and records.mine([], exact) == []


def test_basis(spark):
    rng = random.Random(2)
    pool = {i: [rng.randrange(0, 1_000_000) for _ in range(27)] for i in range(30)}
    df = spark.createDataFrame(list(pool.items()), "candidate_id long, amplitude_ppm array<long>")
    got = [(c["candidate_id"], c["admitted_for"]) for c in records.select_basis(df, target=6, per_cell=2)]
    best, count, want, place = dict.fromkeys(cube.BY_NAME, 0), dict.fromkeys(cube.BY_NAME, 0), [], {c: cube.CELL_NAMES.index(c) for c in cube.BY_NAME}
    for _ in range(6):
        gain = lambda i: sum(max(0, pool[i][place[c]] - best[c]) for c in cube.BY_NAME if count[c] < 2)  # noqa: B023, E731
        i = min((i for i in pool if i not in [w[0] for w in want]), key=lambda i: (-gain(i), i))
        cell = max((c for c in cube.BY_NAME if count[c] < 2), key=lambda c: (max(0, pool[i][place[c]] - best[c]), -cube.BY_NAME.index(c)))
        want.append((i, cell))
        count[cell] += 1
        best = {c: max(best[c], pool[i][place[c]]) for c in best}
    assert got == want


def test_gaps_without_pairs_equal_gaps_of_pairs(spark):
    rng = random.Random(6)
    mass = [(f"b{b}", c, 0.25 if b == 3 else rng.random()) for b in range(9) for c in range(27)]  # b3 is constant
    mass = spark.createDataFrame(mass, "book string, cell int, mass double")
    rounds = [(perm, f"b{b}", "xyz"[rng.randrange(3)]) for perm in range(5) for b in range(9)] + [(9, f"b{b}", "x") for b in range(9)] + [(10, "b1", "x"), (10, "b2", "y")]
    labels = spark.createDataFrame(rounds, "perm int, book string, label string")
    want = {r.perm: r.gap for r in priors.gap(priors.correlations(mass, "book"), labels, "perm").collect()}
    got = {r.perm: r.gap for r in priors.label_gaps(priors.standardised(mass, "book"), labels, "book", "perm").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_vectors_that_are_like_no_centroid(spark):
    good = [0.5, -0.25, 0.0]
    rows = [(1, good), (2, None), (3, [1.0]), (4, [1.0, None, 0.0]), (5, [float("nan"), 1.0, 1.0]), (6, [0.0, 0.0, 0.0]), (7, [])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    cents = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(26)), lambda i: F.array(F.lit(1.0), i.cast("double"), F.lit(2.0))).alias("centroids"))
    got = {r.id: r for r in measure.measure_vectors(df, cents, "v").collect()}
    plain = measure.cosines(df.filter("id = 1"), cents, "v").first().cosines
    assert got[1].cosines == pytest.approx(plain) and sum(got[1].amplitude_ppm) >= 999_000
    assert all(set(got[i].similarity_ppm) == set(got[i].amplitude_ppm) == {0} for i in range(2, 8))


def test_pools_of_any_size_choose_the_same(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, [rng.randrange(0, 400_000) if rng.random() < 0.2 else 0 for _ in range(27)]) for i in range(150)]
    df = spark.createDataFrame(rows + [(200, rows[3][1])], "candidate_id long, amplitude_ppm array<int>")
    whole = records.select_basis(df, target=25)
    monkeypatch.setattr(records, "POOL", 3)
    assert records.select_basis(df, target=25) == whole and len(whole) > 5


def test_condense_of_many_observations_reads_no_pair_twice(monkeypatch):
    """Exact gains are worked out for a small part of the pairs, and the clusters are those of the plain search."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.full(27, 0.5), 1500)
    p[::100] = 0.0
    p[50:60] = p[0:10]
    worked_out, plain = [], emergence._gains
    monkeypatch.setattr(emergence, "_gains", lambda s, w, o: worked_out.append(len(s)) or plain(s, w, o))
    found = emergence.condense(p, 1.0, max_rounds=10)
    assert sum(worked_out) < 0.1 * len(p) ** 2 / 2
    assert sorted(i for rows in found for i in rows) == list(range(len(p))) and len(found) == len(p) - 10
    assert emergence.condense(p[:90], 0.5) == brute_condense(p[:90], 0.5)


def test_condense_ends_only_when_nothing_gains():
    """More merges than the 2,000 that once were the limit: each of eleven kinds becomes one cluster, in all tiers' code."""
    rng = np.random.default_rng(5)
    p = np.stack([one_hot(i % 11, 0.9) for i in range(2200)]) + rng.dirichlet(np.full(12, 50.0), 2200) * 0.02
    p /= p.sum(axis=1, keepdims=True)
    figs, residual = emergence.figures([str(i) for i in range(2200)], [str(i % 7) for i in range(2200)], p, emergence.Policy())
    assert residual == [] and sorted(sorted({int(m) % 11 for m in f["members"]}) for f in figs) == [[k] for k in range(11)]


def test_condense_bounds_merged_clusters_too(monkeypatch):
    """To the end of all merges exact gains are worked out for a small part of the pairs, not for each row after each merge."""
    p = np.random.default_rng(8).dirichlet(np.full(27, 0.7), 900)
    worked_out, plain = [], emergence._gains
    monkeypatch.setattr(emergence, "_gains", lambda s, w, o: worked_out.append(len(s)) or plain(s, w, o))
    found = emergence.condense(p, 1.0)
    assert len(found) < 100 and sum(worked_out) < 0.25 * len(p) ** 2 / 2


def test_condense_equals_brute_force_with_ties_and_empty_rows(monkeypatch):
    """Rows of few distinct values, some without mass, and lists too short for what is near."""
    rng = np.random.default_rng(6)
    monkeypatch.setattr(emergence, "FIRST", 4)
    monkeypatch.setattr(emergence, "LISTED", 3)
    for case in range(8):
        p = rng.multinomial(8, rng.dirichlet(np.full(6, 0.6)), 24) / 8
        p[::9] = 0.0
        overhead = [0.1, 0.5, 1.0, 2.0][case % 4]
        assert emergence.condense(p, overhead) == brute_condense(p, overhead)


def test_the_bounds_of_pairs_hold():
    rng = np.random.default_rng(4)
    p = np.round(np.concatenate([rng.dirichlet(np.full(27, a), 40) for a in (0.02, 0.3, 5.0)] + [np.zeros((2, 27))]), 6)
    h = emergence._entropy(p)
    w = h[:, None] * np.sqrt(p)
    for overhead in (0.5, 1.0):
        bounds = emergence._Bounds(p, h, overhead)
        for i in range(len(p) - 1):
            gains = emergence._gains(p[i] + p[i + 1 :], w[i] + w[i + 1 :], overhead) + 2 * overhead
            assert (bounds.of(i, slice(i + 1, len(p))) >= gains).all() and bounds.best_later()[i] >= gains.max()


def test_overlaps_sizes_aren_t_worked_out_for_every_member(spark):
    """The number of a group's members is made before its members are spread, else it costs their square."""
    groups = spark.range(6000).groupBy(F.lit("a").alias("name"), F.lit("Figure").alias("tier")).agg(F.collect_list(F.col("id").cast("string")).alias("members"))
    plan = emergence.overlaps(groups, groups)._jdf.queryExecution().optimizedPlan().toString()
    above = [line for line in plan.splitlines() if "explode" in line or "Project" in line]
    first = next(i for i, line in enumerate(above) if "explode" in line)
    assert not any("size(array_distinct" in line for line in above[:first])
    assert emergence.overlaps(groups, groups).collect()[0]["overlap"] == 1.0


def test_folds_are_made_by_the_batch(spark):
    """No lambda runs for each of an event's cells, and odd readings keep their rules."""
    rows = [(1, ["CON", "SEG"], 2, None, True, True), (2, None, None, None, None, None), (3, [], -1, ((1.0, 0.0, None), (0.0, 2.0, 0.0), (1.0, 0.0, 0.0)), True, False)]
    schema = "id int, surprises array<string>, n_syn int, ground struct<void:struct<cultivating:double,clearing:double,tending:double>,field:struct<cultivating:double,clearing:double,tending:double>,atmosphere:struct<cultivating:double,clearing:double,tending:double>>, held boolean, predicted boolean"
    made = folds.fold_readings(spark.createDataFrame(rows, schema))
    got = {r.id: [tuple(a) for a in r.acts] for r in made.collect()}
    assert [a[:3] for a in got[1]] == [("CON", "Figure", 125000), ("SEG", "Figure", 125000), ("SYN", "Figure", 125000), ("SYN", "Figure", 125000), ("SYN", "Ground", 125000), ("SYN", "Ground", 125000), ("REC", "Figure", 125000), ("EVA", "Figure", 125000)]
    assert got[2] == [("EVA", "Figure", 1000000, None)]
    assert got[3] == [("INS", "Ground", 83333, "ground:void.cultivating"), ("REC", "Ground", 83333, "ground:atmosphere.cultivating"), ("SEG", "Ground", 166667, "ground:field.clearing"), ("NUL", "Figure", 333333, None), ("EVA", "Figure", 333334, None)]
    plan = measure.measure_folds(made)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("MapInArrow") == 2


def test_records_of_a_short_stream_are_mined_at_once(monkeypatch):
    """One product gives the likeness of all windows of a length; rows of it are made one by one for long streams alone, with the same groups."""
    units = [[f"a{i % 5}", f"b{i * i % 7}"] for i in range(40)]
    one_by_one = records._alike
    monkeypatch.setattr(records, "_alike", None)
    found = records.mine(units)
    monkeypatch.setattr(records, "_alike", one_by_one)
    monkeypatch.setattr(records, "ALIKE_NUMBERS", 64)
    assert found and found == records.mine(units)
