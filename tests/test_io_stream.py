import json
import os
import subprocess
import sys

from tallyloom.operators import graph, projection
from tallyloom.plans import projections
from tallyloom.sources import ledger_io
from tallyloom.streaming import ledger_stream


def event(i, kind="observation.created"):
    return {"spec_version": "1.0.0", "event_type": kind, "event_id": f"e{i}", "occurred_at": "t", "actor": {"type": "a", "id": "b", "version": "1"}, "run": {"run_id": "r", "batch_id": "b", "configuration_hash": "c"}, "inputs": [], "payload": {"n": i}}


def batch(name, *events):
    return json.dumps({"batch_id": name, "submitted_at": "2024", "events": list(events)})


def test_batches(spark, tmp_path):
    (tmp_path / "2024-01").mkdir()
    (tmp_path / "2024-01" / "b1.json").write_text(batch("b1", event(1), event(2)))
    (tmp_path / "b2.json").write_text(batch("b2", event(3)))
    (tmp_path / "note.txt").write_text("no")
    rows = ledger_io.read_batches(spark, str(tmp_path)).collect()
    assert {(r.batch_id, r.place, r.event_id) for r in rows} == {("b1", 0, "e1"), ("b1", 1, "e2"), ("b2", 0, "e3")}
    assert ledger_io.batch_files(spark, str(tmp_path)) == 2
    assert ledger_io.read_batches(spark, str(tmp_path / "none")).count() == 0 == ledger_io.batch_files(spark, str(tmp_path / "none"))


def test_manifest_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,title,words\r\n1,"a, b",3\r\n\r\n2,"two\nlines ""q""",4\r\n1,last,5\r\n')
    got = {r.id: (r.title, r.words) for r in ledger_io.read_manifest(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {"1": ("last", "5"), "2": ('two\nlines "q"', "4")}


def test_texts_and_nested_strings(spark, tmp_path):
    (tmp_path / "b.txt").write_text("B\n1")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.txt").write_text("C")
    assert [tuple(r) for r in ledger_io.read_texts(spark, str(tmp_path)).collect()] == [("b.txt", "B\n1")]
    df = spark.createDataFrame([('[["a"," "],["b"]]',), ('["c"]',)], "j string")
    assert [r.text for r in ledger_io.joined_strings(df, "j", "j").orderBy("text").collect()] == ["a\nb", "c"]
    deep = "[" * 10 + '"x", "y"' + "]" * 5 + ', "z"' + "]" * 5
    rows = [(1, deep), (2, '["a", 1, null, {"b": "no"}, [], [["b"], " "], true, "c"]'), (3, '"one"'), (4, None), (5, "[broken"), (6, "[]"), (None, '["n"]')]
    got = ledger_io.joined_strings(spark.createDataFrame(rows, "id int, j string"), "id", "j").collect()
    assert {r.id: r.text for r in got} == {1: "x\ny\nz", 2: "a\nb\nc", 3: "one", None: "n"}
    assert ledger_io.nested_strings(spark.createDataFrame([], "id int, j string"), "id", "j").collect() == []


def test_binary_files(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    rows = ledger_io.read_binary(files, lambda b: [(i, c) for i, c in enumerate(b)], "i long, c long").collect()
    assert [(r.i, r.c) for r in rows] == [(0, 97), (1, 98), (2, 99)]


def test_holons_round_trip(spark, tmp_path):
    path = str(tmp_path / "holons")
    schema = "holon_id string, tier string, members array<string>"
    assert ledger_io.read_holons(spark, path, schema).count() == 0
    df = spark.createDataFrame([("holon:sha256:ab12", "Figure", ["a"], "l1"), ("holon:sha256:cd34", "Figure", ["b"], "l2")], schema + ", lens_id string")
    ledger_io.write_holons(df, path)
    ledger_io.write_holons(df.filter("lens_id = 'l1'"), path)
    got = {(r.holon_id, r.lens_id, r.shard) for r in ledger_io.read_holons(spark, path, schema).collect()}
    assert got == {("holon:sha256:ab12", "l1", "ab"), ("holon:sha256:cd34", "l2", "cd")}


def test_stream_takes_each_batch_once(spark, tmp_path):
    arrived, table = tmp_path / "in", str(tmp_path / "ledger")
    arrived.mkdir()
    (arrived / "1.json").write_text(batch("b1", event(1), event(2)))
    (arrived / "2.json").write_text(batch("b2", event(3, "holon.emerged")))

    def run():
        ledger_stream.accept_batches(ledger_stream.batch_stream(spark, str(arrived), ledger_io.BATCH), table, str(tmp_path / "cp")).awaitTermination()
        return sorted((r.batch_id, r.event_id) for r in spark.read.parquet(table).collect())

    assert run() == [("b1", "e1"), ("b1", "e2")]
    (arrived / "3.json").write_text(batch("b1", event(9)))
    (arrived / "4.json").write_text(batch("b3", event(4)))
    assert run() == [("b1", "e1"), ("b1", "e2"), ("b3", "e4")]


def test_conventions_stream(spark, tmp_path):
    schema = "kind string, token string, pos long, op string, weight long"
    path = str(tmp_path / "log")
    spark.createDataFrame([("k", "a", 0, "learn", 1), ("k", "a", 1, "break", 1), ("k", "a", 2, "break", 1)], schema).coalesce(1).write.parquet(path)
    query = ledger_stream.convention_stream(spark.readStream.schema(schema).parquet(path)).writeStream.format("memory").queryName("entries").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    (r,) = spark.sql("select * from entries").collect()
    assert (r.support, r.strain, r.defeated) == (1, 2, True)


def test_components(spark):
    df = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 5), (None, 1)], "a long, b long")
    assert {(r.node, r.component) for r in graph.components(df).collect()} == {(2, 2), (3, 2), (4, 2), (5, 2), (8, 8), (9, 8)}
    chain = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in graph.components(chain).collect()} == {0}
    assert graph.components(df.limit(0)).count() == 0


def test_projection_is_stable(spark):
    a, b = (projections.x01_projection(spark, "/root/testdata/sf0.001").orderBy("lens_id").collect() for _ in range(2))
    assert a == b and len(a) == 2 and all(r.holons_figure + r.holons_pattern > 0 for r in a)


def test_builds_of_x02_run_beside_each_other(spark, monkeypatch):
    """All three builds begin before any ends."""
    import threading

    began, plain = threading.Barrier(3), projections.publication.build
    monkeypatch.setattr(projections.publication, "build", lambda *a, **k: began.wait(60) is not None and plain(*a, **k))
    got = {(r.build, r.outcome) for r in projections.x02_rebuilt(spark, "/root/testdata/sf0.001").collect()}
    assert got == {("other order", "reproduced"), ("events gone", "diverged")}


def test_claims(spark):
    arg = "struct<text:string,id:string,start:int,end:int>"
    log = spark.createDataFrame([(1, 0, 0, "SEG", "argspan", ("A", "a", 0, 1), ("v", None, 2, 3), ("B", None, 4, 5), None, None, None), (1, 1, 0, "SEG", "argspan", None, None, ("B", None, 4, 5), None, None, None), (1, 2, 1, "SYN", "alias", None, None, None, None, None, None), (1, 3, 1, "SYN", "alias", None, None, None, None, None, None), (1, 4, 1, "EVA", None, None, None, None, "merge", "corroborated", 3)], f"doc int, seq int, sent int, op string, kind string, subject {arg}, verb {arg}, object {arg}, site string, verdict string, ref int")
    (r,) = projection.relations(log, spark.createDataFrame([(1, 0, 10)], "doc int, sent int, base int")).collect()
    assert (r.subject.start, r.verb.end, r.object.start) == (10, 13, 14)
    assert [r.seq for r in projection.equivalences(log).collect()] == [3]


def test_scratch_folder_of_a_session_that_names_none(tmp_path):
    """In a process of its own, with an empty configuration."""
    code = """
from tallyloom.session import build_session
from tallyloom.sources.scratch import cut, scratch_dir
spark = build_session("alone", 1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert sorted(r.id for r in cut(cut(spark.range(3))).collect()) == [0, 1, 2]
assert scratch_dir(spark) == scratch_dir(spark.newSession()) and scratch_dir(spark).startswith("file:///")
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root, "TMPDIR": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, timeout=120)


def test_deep_arrays_are_written_every_few_levels(spark, monkeypatch):
    from tallyloom.sources import ledger_io

    written, plain = [], ledger_io.cut
    monkeypatch.setattr(ledger_io, "cut", lambda df: written.append(1) or plain(df))
    df = spark.createDataFrame([("a", "[" * 9 + '"x","y"' + "]" * 9), ("b", '["p",["q",["r"]]]')], "k string, j string")
    assert {(r.k, r.text) for r in ledger_io.joined_strings(df, "k", "j").collect()} == {("a", "x\ny"), ("b", "p\nq\nr")}
    assert len(written) <= 4
