"""Builds, their publication and verification; policies."""

import pytest

from tallyloom.operators import publication
from tallyloom.sources import policies

BASES = ["exemplar-basis:sha256:" + c * 64 for c in "ab"]
EVENT = "event_id string, event_type string, inputs array<string>, retracted_event_id string, superseded_event_id string, observation_id string, source_id string, basis_id string, place long"
POLICY = {"library": "a: 1 # note", "emergence-policy": "mint_overhead_bits: 1"}


def ledger(n=24):
    rows = []
    for i in range(n):
        rows.append((f"c{i:02d}", "observation.created", [], None, None, f"o{i}", f"s{i % 4}", None, 2 * i))
        rows.append((f"m{i:02d}", "observation.measured", [f"c{i:02d}"], None, None, f"o{i}", None, BASES[i % 2], 2 * i + 1))
    rows.append(("x1", "event.retracted", [], "m02", None, None, None, None, 100))
    rows.append(("x2", "observation.invalidated", [], None, None, "o3", None, None, 101))
    rows.append(("x3", "observation.declined", [], None, None, None, None, None, 102))
    return rows


def vectors(spark, n=24):
    rows = []
    for i in range(n):
        cells = [0] * 27
        cells[(i % 2) * 9 + i % 3], cells[20] = 900_000, 100_000
        rows.append((f"o{i}", cells))
    return spark.createDataFrame(rows, "observation_id string, amplitude_ppm array<int>")


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_builds_publish_and_verify(spark, tmp_path):
    root, vec = str(tmp_path / "out"), vectors(spark)
    frame = lambda rows: spark.createDataFrame(rows, EVENT)
    assert publication.current(spark, root) is None and publication.read_published(spark, root, "holons") is None
    first = publication.build(frame(ledger()), vec, POLICY, determinism="reproduced")
    again = publication.build(frame(ledger()[::-1]).repartition(5), vec, POLICY, determinism="reproduced")
    for name, table in first.tables.items():
        assert rows_of(table) == rows_of(again.tables[name]), name
    assert publication.verify(spark, root, first).collect() == []
    publication.publish(first, root, "2024-01-01")
    assert publication.current(spark, root) == first.projection_id == again.projection_id
    assert [r.outcome for r in publication.verify(spark, root, again).collect()] == ["reproduced", "reproduced"]
    sal = {r.lens_id: r for r in publication.read_published(spark, root, "salience").collect()}
    assert sorted(r.observation_count for r in sal.values()) == [11, 11]  # one retracted, one invalidated
    assert all(r.holons_figure > 0 for r in sal.values())
    assert {r.change for r in first.tables["diff"].collect()} == {"added"}
    packs = {r.lens_id: r for r in publication.read_published(spark, root, "pack").collect()}
    assert {k: r.holon_count for k, r in packs.items()} == {k: r.holons_figure + r.holons_pattern + r.holons_ground for k, r in sal.items()}

    tampered = publication.build(frame([r for r in ledger() if r[0] != "m05"]), vec, POLICY)
    assert {r.outcome for r in publication.verify(spark, root, tampered).collect()} == {"diverged"}
    one = publication.build(frame(ledger()), vec, POLICY, active_basis=BASES[0])
    assert sorted(r.outcome for r in publication.verify(spark, root, one).collect()) == ["missing", "reproduced"]

    # a publication that dies before its pointer leaves the old one; its repetition completes it
    more = publication.build(frame(ledger()[:-1] + [("x9", "event.retracted", [], "m04", None, None, None, None, 103)]), vec, POLICY, publication.previous_holons(spark, root))
    publication.write_snapshot(more, root)
    assert publication.current(spark, root) == first.projection_id
    publication.publish(more, root, "2024-01-02")
    assert publication.current(spark, root) == more.projection_id != first.projection_id
    changed = {r.change for r in more.tables["diff"].collect()}
    assert "changed" in changed and "added" not in changed  # names are kept
    marks = {(r.projection_id, r.is_current) for r in publication.published_manifests(spark, root).collect()}
    assert marks == {(first.projection_id, False), (more.projection_id, True)}


def test_empty_ledger(spark):
    made = publication.build(spark.createDataFrame([], EVENT), vectors(spark).limit(0), {})
    assert [(r.lens_id, r.events_resolved, r.holons_figure) for r in made.tables["manifest"].collect()] == [("unset", 0, 0)]
    assert all(t.count() == 0 for n, t in made.tables.items() if n in ("holons", "diff", "rebounds"))


def test_policies(spark, tmp_path):
    text = '# a policy\nspec_version: "1.0.0"\nlibrary:\n  name: "x # y"\n  notes: >\n    folded: no\n  n: 3  # three\nmint: 0.5\nlist:\n  - a: 1\non: true\nurl: a:b\nempty:\n'
    (tmp_path / "p.yaml").write_text(text)
    (tmp_path / "q.yaml").write_text("a: 1\n")
    (tmp_path / "r.txt").write_text("a: 2\n")
    found = policies.read_policies(spark, str(tmp_path))
    assert set(found) == {"p", "q"} and found["p"].text == text
    assert found["p"].options == {"spec_version": "1.0.0", "library.name": "x # y", "library.n": 3, "mint": 0.5, "on": True, "url": "a:b"}
    whole = policies.configuration_hash(found)
    (tmp_path / "q.yaml").write_text("a: 1 # the same\n")
    other = policies.read_policies(spark, str(tmp_path))
    assert other["q"].options == found["q"].options and policies.configuration_hash(other) != whole
    assert policies.read_policies(spark, str(tmp_path / "none")) == {}
    (tmp_path / "active.json").write_text('{"basis_id": "exemplar-basis:sha256:1", "_comment": "x"}')
    assert policies.active_basis(spark, str(tmp_path / "active.json")) == "exemplar-basis:sha256:1"
    assert policies.active_basis(spark, str(tmp_path / "none.json")) is None


@pytest.mark.parametrize("raw,value", [("'a'", "a"), ("null", None), ("-2", -2), ("x y", "x y"), ("false", False)])
def test_option_values(raw, value):
    assert policies.parse_options(f"k: {raw}").get("k", "absent") == value
