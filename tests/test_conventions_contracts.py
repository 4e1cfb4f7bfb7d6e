import json
import random
import re
from pathlib import Path

from tallyloom.functions import canonical
from tallyloom.functions import text as rules
from tallyloom.operators import company, contracts, conventions

F = rules.F
ROOT = Path(__file__).resolve().parent.parent


def test_strain():
    e = {"origin": "prior", "weight": 0, "support": 3, "strain": 0, "defeated": False}
    for n in range(4):
        e = conventions.apply_op(e, "break")
        assert e["defeated"] == (n == 3)
    learned = conventions.apply_op(None, "learn")
    once = conventions.apply_op(learned, "break")
    assert not once["defeated"] and conventions.apply_op(once, "break")["defeated"]
    assert conventions.apply_op(e, "reinstate") == e | {"defeated": False, "strain": 0}


def test_fold_log_equals_one_by_one(spark):
    """Tokens with few steps, and two with so many that each lies in several chunks; of the ops some mostly break."""
    rng = random.Random(2)
    log = []
    for i in range(4000):
        ops = [*conventions.OPS, "unknown"] if rng.random() < 0.3 else ["hold", "break", "break", "hold"]
        log.append((rng.choice("kkkn"), rng.choice(["a", "A.", "b", "b", f"r{rng.randrange(300)}"]), i, rng.choice(ops), rng.randrange(1, 3)))
    prior = [("k", "a", "prior", 0, 3, 0, False), ("m", "z", "prior", 2, 1, 2, True), ("n", "b", "learned", 5, 7, 4, True)]
    fields = ("origin", "weight", "support", "strain", "defeated")
    want = {(k, t): dict(zip(fields, rest, strict=True)) for k, t, *rest in prior}
    for k, t, _, op, w in log:
        key = (k, re.sub(r"\.$", "", t.lower()))
        want[key] = conventions.apply_op(want.get(key), op, w)
    schema = "kind string, token string, pos int, op string, weight int"
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that small ranges stay apart
    try:
        out = conventions.fold_log(spark.createDataFrame(rng.sample(log, len(log)), schema).repartition(3), spark.createDataFrame(prior, conventions.ENTRY)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {(r.kind, r.token): {f: r[f] for f in fields} for r in out} == want
    none = conventions.fold_log(spark.createDataFrame([], schema), spark.createDataFrame(prior, conventions.ENTRY)).collect()
    assert sorted(tuple(r) for r in none) == sorted(prior)


def test_answers_and_inheritance(spark):
    entries = spark.createDataFrame([("copula", "is", "prior", 0, 3, 0, False), ("auxiliary", "can", "learned", 1, 1, 0, False), ("copula", "was", "prior", 0, 1, 2, True)], conventions.ENTRY)
    asked = spark.createDataFrame([("Is",), ("can.",), ("was",)], "token string")
    assert {r.token for r in conventions.answers(asked, entries, "auxiliary").collect()} == {"Is", "can."}
    assert {(r.token, r.support) for r in conventions.inherit(entries).collect()} == {("is", 3), ("can", 1)}
    lines = [json.loads(r[0]) for r in entries.select(conventions.exported(entries)).collect()]
    assert lines[1] == {"op": "REC", "kind": "auxiliary", "token": "can", "weight": 1} and lines[2]["defeated"] is True


def pocket(**more):
    p = {"schema": "Pocket@1", "pocket_id": "p", "role": "corpus", "reader_version": "reader4.2", "basis_id": "b", "distributions": {"a": {"n": 1}}} | more
    return p | {"content_hash": canonical.content_hash(p)}


def test_firewalls(spark):
    kinds = contracts.publish_kinds([{"id": "k", "members": [1], "parameters": [{"id": "p", "provenance_expression": {"op": "add", "args": [1, {"op": "x", "channel_index": 2}]}}]}], {"basis_id": "b"})
    bad_kind = {"schema": "KindVocabulary@1", "kinds": [{"parameters": [{"provenance_expression": {"op": "add", "args": ["text"]}}]}]}
    role = {"schema": "RoleExpectation@1", "basis_id": "b", "ballast": {"ungated_fraction_ppm": 100000, "floor_ppm": 100000}}
    docs = [pocket(), pocket(role="x"), pocket(distributions={"a": [{"Sentence": 1}]}), pocket() | {"content_hash": "no"}, kinds, kinds | {"members": []}, bad_kind, role | {"content_hash": canonical.content_hash(role)}, role | {"note": "free text"}, role | {"ballast": {"ungated_fraction_ppm": 50000, "floor_ppm": 100000}}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(10, "{"), (11, None)], "i int, j string")
    got = [r[0] for r in df.orderBy("i").select(contracts.artifact_fault("j")).collect()]
    assert got == [None, "role", "text at $.distributions.a[0].Sentence", "content_hash", None, "roster at $.members", "expression.args[0]: a string or nothing", None, "string at note", "ballast", "not JSON", "not JSON"]


def test_expressions():
    assert contracts.bad_expression({"op": "add", "channel_index": -1}) == "expression.channel_index" and contracts.bad_expression({"op": "Add"}) == "expression.op"
    assert contracts.bad_expression({"op": "a", "x": 1}) == "expression.x" and contracts.bad_expression(None) and contracts.bad_expression([1, 2.5, True]) is None


def test_reader_versions(spark):
    df = spark.createDataFrame([("reader4.2",), ("Reader4@1",), ("reader5.0",), ("none",), (None,)], "v string")
    assert [r.compatible for r in contracts.compatible(df, "v", "reader4.9").collect()] == [True, True, False, False, False]


def test_readiness(spark):
    ch = spark.createDataFrame([("good", 12, 0.1), ("low", 10, 0.1), ("torn", 12, 0.9), ("none", 12, 0.1)], "channel string, median_steps int, fragmentation double")
    sp = spark.createDataFrame([(c, s, True, 2.0, 1.0, 0.5) for c in ("good", "low", "torn") for s in "abc"], "channel string, seed string, recovered boolean, gain double, null_gain double, effect double")
    got = {r.channel: (r.ready, list(r.reasons)) for r in contracts.readiness(ch, sp).collect()}
    assert got["good"] == (True, []) and got["low"][1] == ["median_n_steps_above_floor"] and got["torn"][1] == ["coreference_fragmentation_below_threshold"] and len(got["none"][1]) == 4


def test_induction_does_not_know_names():
    for name in ("emergence", "measure", "priors", "records"):
        assert "external_name" not in (ROOT / f"tallyloom/operators/{name}.py").read_text()


def test_nothing_imports_the_llm_package():
    for path in (ROOT / "tallyloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tallyloom.llm" not in path.read_text(), path


def test_segments(spark):
    text = 'He said "Go." Then left.  Ok! she\n\n \nimport a\nimport b\nimport c\nimport d'
    df = spark.createDataFrame([(1, text)], "id int, t string")
    (r,) = df.select(rules.sentences(F.col("t")).alias("s"), rules.paragraphs(F.col("t")).alias("p"), rules.lines(F.col("t")).alias("l")).collect()
    assert r.s[:2] == ['He said "Go."', "Then left."] and len(r.p) == 2 and len(r.l) == 5
    for s in rules.spans(df, "t", "sentence", "id").collect():
        assert text[s.start : s.end] == s.text
    again = spark.createDataFrame([(1, "Yes. Yes. Yes. 😀 Yes.")], "id int, t string")
    assert [(s.start, s.end) for s in rules.spans(again, "t", "sentence", "id").orderBy("position").collect()] == [(0, 4), (5, 9), (10, 21)]


def test_small_text_rules(spark):
    df = spark.createDataFrame([("a/b\\c.txt", " A  B ", "> x\nACGTAC\nGG", "Fiction -- x, y")], "p string, n string, f string, s string")
    (r,) = df.select(rules.flat_name(F.col("p")), rules.actor_slug(F.col("n")), rules.codons(F.col("f"), 1), rules.subject_key(F.col("s"))).collect()
    assert tuple(r) == ("a__b__c.txt", "a-b", ["CGT", "ACG"], "Fiction")


def test_slots_group_like_company(spark):
    rng = random.Random(3)
    rows, pos = [], 0
    for _ in range(400):
        for t in (rng.choice(["the", "a"]), rng.choice(["cat", "dog", "cow"]), rng.choice(["runs", "eats"]), company.BOUNDARY):
            rows.append(("d", pos, t))
            pos += 1
    stream = spark.createDataFrame(rows, "doc string, pos int, token string")
    freq = company.frequencies(stream)
    pool = company.top_tokens(freq, 50, 3)
    near = company.nearest(company.company_vectors(company.neighbours(stream), company.top_tokens(freq, 20), pool), 10)
    slot = {r.token: r.slot for r in company.slots(pool, company.mutual(near, 0.6)).collect()}
    assert slot["cat"] == slot["dog"] == slot["cow"] != slot["the"] == slot["a"]
    lifted = {r.token for r in company.lift(stream, company.slots(pool, company.mutual(near, 0.6))).collect()}
    assert lifted <= {"§0", "§1", "§2", "§3", company.BOUNDARY}
