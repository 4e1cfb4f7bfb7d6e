import random

import pytest

from tallyloom.functions import canonical
from tallyloom.operators import ledger

EVENTS = "event_id string, event_type string, inputs array<string>, retracted_event_id string, superseded_event_id string, observation_id string, source_id string, basis_id string, place int"


def events(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2], *r[3:], *[None] * (8 - len(r)), i) for i, r in enumerate(rows)], EVENTS)


def brute_order(inputs):
    ids, order = set(inputs), []
    while len(order) < len(ids):
        ready = sorted(i for i in ids - set(order) if all(x in order for x in inputs[i] if x in ids))
        if not ready:
            return order, ids - set(order)
        order.append(ready[0])
    return order, set()


def test_topological_equals_brute_force(spark):
    rng = random.Random(4)
    inputs = {}
    for block in range(40):
        names = [f"e{rng.randrange(10**6):06d}" for _ in range(rng.randrange(1, 9))]
        for n, name in enumerate(names):
            inputs[name] = rng.sample(names[:n], min(n, rng.randrange(0, 3))) + (["gone"] if rng.random() < 0.2 else [])
    df = events(spark, [(k, "observation.created", v) for k, v in inputs.items()])
    got = [r.event_id for r in ledger.topological(df).orderBy("reach", "pos").collect()]
    assert got == brute_order(inputs)[0]


def test_cycle_is_marked(spark):
    df = events(spark, [("a", "t", ["b"]), ("b", "t", ["a"]), ("c", "t", []), ("d", "t", ["a"])])
    got = {r.event_id: r.pos for r in ledger.topological(df).collect()}
    assert got == {"a": -1, "b": -1, "c": 0, "d": -1}


def test_corrections_and_head(spark):
    df = events(
        spark,
        [("a", "observation.created", []), ("b", "observation.created", ["a"]), ("r", "event.retracted", ["b"], "b"), ("rr", "event.retracted", ["r"], "r"), ("s", "event.superseded", ["a"], None, "a"), ("n", "event.retracted", [], None)],
    )
    gone = ledger.corrections(df)
    assert {(r.event_id, r.how) for r in gone.collect()} == {("b", "retracted"), ("r", "retracted"), ("a", "superseded")}
    resolved = ledger.resolve(df, gone)
    assert {r.event_id for r in resolved.collect()} == {"rr", "s", "n"}  # a retracted retraction still retracts
    assert {r.event_id for r in ledger.head(resolved).collect()} == {"rr", "s", "n"}
    two = events(spark, [("a", "t", []), ("b", "t", ["a"])])
    assert [r.event_id for r in ledger.head(two).collect()] == ["b"] and ledger.head(two.limit(0)).count() == 0


def test_observations(spark):
    df = events(
        spark,
        [("1", "observation.created", [], None, None, "o1", "s1"), ("2", "observation.created", [], None, None, "o1", "s2"), ("3", "observation.measured", [], None, None, "o1", None, "b"), ("4", "observation.measured", [], None, None, "o2", None, None), ("5", "observation.measured", [], None, None, "o3", None, "b")],
    )
    bad = spark.createDataFrame([("o3",)], "observation_id string")
    got = {r.event_id: (r.source_id, r.basis_id) for r in ledger.observations(df, ledger.sources_of(df, ledger.F.col("place")), bad).collect()}
    assert got == {"3": ("s2", "b"), "4": ("unknown-source", None)}


def test_violations_and_types(spark):
    assert len(ledger.WRITABLE) == 28 and len(ledger.PROJECTED) == 22
    rows = [("f1", 0, "x", "observation.created", "{}"), ("f2", 0, "x", "observation.created", '{"a": {"ledger_position": 1}}'), ("f2", 1, "y", "holon.emerged", "{}"), ("f2", 2, "y", "odd", "{}")]
    df = spark.createDataFrame(rows, "file string, place int, event_id string, event_type string, payload string")
    assert {tuple(r) for r in ledger.violations(df).collect()} == {("f2", "x", "duplicate-id"), ("f2", "x", "ledger-position"), ("f2", "y", "projected-type"), ("f2", "y", "unknown-type")}


def test_lens_id(spark):
    df = spark.createDataFrame([("exemplar-basis:sha256:" + "a" * 64,), (None,), ("short",)], "b string")
    assert [r[0] for r in df.select(ledger.lens_id(df.b)).collect()] == ["basis-" + "a" * 18, "unset", "short"]


@pytest.mark.parametrize(
    ("value", "text"),
    [(1.0, "1"), (-0.0, "0"), (0.5, "0.5"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-6, "0.000001"), (1e-7, "1e-7"), (1.5e-7, "1.5e-7"), (123.456, "123.456"), (0.1 + 0.2, "0.30000000000000004"), (-2.5e22, "-2.5e+22")],
)
def test_numbers(value, text):
    assert canonical.number(value) == text


def test_canonical_json():
    assert canonical.dumps({"b": [1, {"z": None, "a": "é\n"}], "a": True, "10": 1, "9": 2}) == '{"9":2,"10":1,"a":true,"b":[1,{"a":"é\\n","z":null}]}'
    assert canonical.first_float({"a": [1, {"b": 0.5}]}) == "a[1].b" and canonical.first_float({"a": [1.0]}) is None and canonical.first_float(0.5) == "(root)"
    value = {"x": 1, "content_hash": "?"}
    assert canonical.content_hash(value) == canonical.sha256_ref('{"x":1}')


def test_canonical_udfs(spark):
    df = spark.createDataFrame([('{"b":1,"a":[2.5]}',), (None,), ("{",)], "j string")
    assert [r[0] for r in df.select(canonical.canonical_udf("j")).collect()] == ['{"a":[2.5],"b":1}', None, None]
    assert [r[0] for r in df.limit(2).select(canonical.float_path_udf("j")).collect()] == ["a[0]", None]


def test_chains_that_lie_together_are_one_star_at_once(spark):
    from tallyloom.operators import graph

    chain = [(f"e{i:04d}", f"e{i + 1:04d}") for i in range(600)] + [("x1", "x2"), ("x3", "x2"), ("x1", "x3")]
    edges = spark.createDataFrame(chain, "x string, y string").coalesce(1)
    got = {(r.x, r.y) for r in graph._contracted(edges).collect()}
    assert got == {(f"e{i:04d}", "e0000") for i in range(1, 601)} | {("x2", "x1"), ("x3", "x1")}
    found = {r.node: r.component for r in graph.components(edges.repartition(7), "x", "y", max_rounds=12).collect()}
    assert found == {f"e{i:04d}": "e0000" for i in range(601)} | {"x1": "x1", "x2": "x1", "x3": "x1"}
    assert graph.components(edges, "x", "y", max_rounds=2).count() == 604  # more rounds before
    odd = spark.createDataFrame([(float("nan"), 2.0), (2.0, 1.0)], "x double, y double")
    assert {r.component for r in graph.components(odd, "x", "y").collect()} == {1.0}
    pairs = spark.createDataFrame([((1, 2), (3, 4))], "x struct<a: int, b: int>, y struct<a: int, b: int>")
    assert graph.components(pairs, "x", "y").count() == 2
