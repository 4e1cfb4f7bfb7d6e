"""Files and manifests, span ranges, relation types, initialisms and slot members, with their odd rows."""

from tallyloom.operators import conventions, corpora


def test_files_meet_their_manifest(spark):
    files = spark.createDataFrame([("pg12.txt",), ("12",), ("x.txt",), (None,)], "file string")
    manifest = spark.createDataFrame([(12, "Short STORIES"), (13, "fiction"), (None, "x")], "id long, subject string")
    found = corpora.with_manifest(files, manifest, "file", "id")
    assert found.columns == ["file", "id", "subject"] and sorted(r.file for r in found.collect()) == ["12", "pg12.txt"]
    flags = manifest.unionByName(spark.createDataFrame([(1, None), (2, "history")], manifest.schema)).select(corpora.is_fiction(manifest["subject"]).alias("f"))
    assert sorted(r.f for r in flags.collect()) == [False, False, False, True, True]


def test_span_range_skips_the_opening(spark):
    spans = spark.createDataFrame([("a", i) for i in range(20)] + [("b", i) for i in range(15)], "book string, pos int")
    assert sorted((r.book, r.pos) for r in corpora.span_range(spans, "book", "pos", 3).collect()) == [("a", 15), ("a", 16), ("a", 17)]


def test_relation_types(spark):
    entries = conventions.seed(spark, {"attribution-verb": ["said"]})
    table = spark.createDataFrame([("b", 1, "ran"), ("a", 0, "ran"), ("a", 0, "said")], "bucket string, ord int, token string")
    tokens = spark.createDataFrame([("Ran",), ("said.",), ("day",), (None,)], "token string")
    got = {r.token: r.relation_type for r in corpora.relation_types(tokens, entries, table).collect()}
    assert got == {"Ran": "a", "said.": "speech", "day": None, None: None}


def test_initialisms_and_slots(spark):
    uses = spark.createDataFrame([("NDP", "first", 1, 1), ("ndp.", "last", 2, 5), ("X", "x", 1, 1)], "token string, expansion string, weight int, pos int")
    assert sorted(map(tuple, corpora.initialisms(uses, "pos").collect())) == [("ndp", "last", 3), ("x", "x", 1)]
    slots = spark.createDataFrame([("c", 1), ("a", 1), ("b", 1), ("z", 2)], "token string, slot int")
    assert sorted(map(tuple, corpora.slot_members(slots).collect())) == [("a", 1, 2, "b"), ("b", 1, 2, "a"), ("c", 1, 2, "a"), ("z", 2, 0, None)]
