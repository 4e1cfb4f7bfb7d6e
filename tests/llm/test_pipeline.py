"""The pipeline's stages one after another, against brute force on a small table."""

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tallyloom.llm import secret_scan
from tallyloom.llm._shared import vocabulary_path
from tests.llm.test_operators import brute_near, norm

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    first = corpus_pipeline.keep_languages(spark, docs, SF)
    assert first.columns == columns and {r.doc_id for r in first.collect()} == set(rows)  # all are in some language
    second = corpus_pipeline.drop_copies(spark, docs, SF)
    groups = defaultdict(list)
    for i, r in rows.items():
        groups[norm(r.text)].append(i)
    stay = {min(g, key=lambda j: (-len(rows[j].text), j)) for g in groups.values()}
    assert second.columns == columns and sorted(r.doc_id for r in second.collect()) == sorted(stay)
    third = corpus_pipeline.drop_near_copies(spark, second, SF)
    want = brute_near({i: rows[i].text for i in stay}, 80)
    assert third.columns == columns and sorted(r.doc_id for r in third.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    fourth = corpus_pipeline.mask_secrets(spark, third, SF)
    assert fourth.columns == columns
    for r in fourth.collect():
        assert not secret_scan.base_findings(r.text.replace("[SECRET]", " ")) and r.n_chars == len(r.text)
    packed = corpus_pipeline.pack(spark, fourth, SF).collect()
    library = Tokenizer.from_file(vocabulary_path(corpus_pipeline.VOCABULARY))
    pieces = defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append(r)
    for r in fourth.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(pieces.pop(r.doc_id), key=lambda p: p.start)
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))] and {p.doc_tokens for p in own} == {len(ids)}
        assert [p.ids_crc32 for p in own] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own]
    assert not pieces


def test_languages_are_kept_and_junk_goes(spark):
    """Clean documents of the four languages, switched ones among them, stay; texts of other kinds go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = docs.filter("length(text) > 200").limit(200).collect()
    odd = ["zxqv kkwq jjxz wvvq qqpz xkcq zzvw " * 10, "0x5f3759df 11:22 33 -- ## " * 20, "漢字仮名交じり文の文書です " * 10, "", None, "Быстрая лиса прыгает через собаку " * 5]
    switched = clean[0].text[:300] + " " + clean[1].text[:300]
    rows = [*clean, *[(10**6 + i, t, None, None, 0) for i, t in enumerate([*odd, switched])]]
    stay = {r.doc_id for r in corpus_pipeline.keep_languages(spark, spark.createDataFrame(rows, docs.schema), "").collect()}
    assert stay == {r.doc_id for r in clean} | {10**6 + len(odd)}


def test_near_copies_from_80_percent(spark):
    """Pairs of 0.79 to 0.86, by themselves and in a large group."""
    texts = {}
    for n, share in enumerate((79, 80, 82, 84, 85, 86)):
        own = [f"s{n}w{i}" for i in range(104)]
        texts[2 * n], texts[2 * n + 1] = " ".join(own), " ".join(own[: share + 4])
    base = [f"b{i}" for i in range(104)]
    for i in range(120):
        at = 10 + i % 60
        texts[100 + i] = " ".join([*base[:at], f"w{i}", *base[at + 1 :]])
    texts[300], texts[301], texts[302] = " ".join(base), " ".join(base[:84]), " ".join(base[1:84])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    stay = sorted(i for i, (_, c) in brute_near(texts, 80).items() if c == i)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == stay
    assert stay != sorted(i for i, (_, c) in brute_near(texts).items() if c == i)


def test_run_is_the_stages_in_order(spark):
    out = corpus_pipeline.run(spark, SF)
    assert "sequence_id" in out.columns and out.count() > 0


def test_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "the same of text", "en", "s", 1), (3, "the same of text", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF)
        df.count()
