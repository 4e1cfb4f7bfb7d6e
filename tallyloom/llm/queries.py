"""The queries of this package's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import byte_bpe, clustering, exact_dedup, fingerprints, language_id, line_dedup, media_tiff, near_dedup, packing, secret_scan, sharding, token_counts, whitening
from tallyloom.llm._shared import squeeze_space, text_or_empty

BYTE_BPE, WORD_BPE = "byte_bpe_50k.tiktoken", "word_bpe_49k.json"
#: The names of the shards that op4 deals documents to.
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))
#: Tokens above which op9 marks a document.
TOKEN_LIMIT = 2048


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", F.sha2(squeeze_space(text_or_empty("text")), 256).alias("text_sha256"))
    return exact_dedup.exact_groups(docs, carry=["text_sha256"])


OP1_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as body, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
g as (
  select norm, count(*) as group_size, max(length(body)) as points from t group by norm),
k as (
  select t.norm, min(t.doc_id) as keep_id from t join g on t.norm = g.norm and length(t.body) = g.points group by t.norm)
select t.doc_id, k.keep_id, g.group_size::bigint as group_size, t.doc_id = k.keep_id as kept, sha256(t.norm) as text_sha256
from t join g on t.norm = g.norm join k on t.norm = k.norm
"""


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), WORD_BPE)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", F.octet_length(text_or_empty("text")).cast("long").alias("n_bytes"))
    return sharding.assign_shards(docs, F.col("doc_id"), SHARDS)


def op4_sql() -> str:
    """The table as a constant, one letter a slot; the rest is plain SQL."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    table = "".join(letters[i] for i in sharding.fill_table(SHARDS))
    return f"""
with s as (
  select doc_id, source, octet_length(encode(coalesce(text, '')))::bigint as n_bytes,
    (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint % {sharding.TABLE_SIZE})::int as slot
  from documents)
select doc_id, source, n_bytes, slot, (instr('{letters}', substr('{table}', slot + 1, 1)) - 1)::int as shard from s
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", F.coalesce(language_id.held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score", "fit")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_texts(_documents(spark, sf_dir), BYTE_BPE, ids=False)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = secret_scan.scan(docs, secret_scan.train(docs))
    count = lambda kind: F.size(F.filter("findings", lambda f: f.kind == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f.kind, f.start, f.end)), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(F.filter("findings", lambda f: f.kind != "net")), 256).alias("base_sha256"),
        listed(F.col("findings")).alias("spans"),
    )


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media_tiff.store_texts(_documents(spark, sf_dir))
    stored = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    pages = media_tiff.tiff_pages(stored, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    return pages.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.format_string("%dx%d mean=%d values=%d", "width", "height", "mean_milli", "distinct_values").alias("feature"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(_documents(spark, sf_dir), WORD_BPE)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_documents(spark, sf_dir))


#: p is the length of the common prefix of two lines; one edit after it must make the rest equal.
OP10_SQL = r"""
with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
o as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as no from t),
e as (select * from o where regexp_matches(line, '[^\x20\x09-\x0D]')),
d as (select line, length(line) as n, min((doc_id, no)) as first from e group by line),
c as (
  select a.line, a.n, b.line as other, b.n as m, coalesce(list_max(list_filter(generate_series(1, least(a.n, b.n)), lambda k: a.line[:k] = b.line[:k])), 0) as p
  from d a join d b on abs(a.n - b.n) <= 1 and b.first < a.first
    and (least(a.n, b.n) < 16 or substr(a.line, 1, 4) = substr(b.line, 1, 4) or right(a.line, 4) = right(b.line, 4))),
near as (
  select distinct line from c where case when n = m then substr(line, p + 2) = substr(other, p + 2)
    when n > m then substr(line, p + 2) = substr(other, p + 1) else substr(line, p + 1) = substr(other, p + 2) end),
gone as (
  select distinct e.doc_id, e.no from e join d on e.line = d.line left join near on e.line = near.line
  where near.line is not null or (e.doc_id, e.no) <> d.first),
g as (select doc_id, count(*) as k, string_agg(no::varchar, ',' order by no) as dropped from gone group by doc_id)
select t.doc_id, len(t.lines)::bigint as n_lines, coalesce(g.k, 0)::bigint as n_dropped, coalesce(g.dropped, '') as dropped
from t left join g on t.doc_id = g.doc_id
"""


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_sql(k: int = 8, rounds: int = 10) -> str:
    """One assignment and one mean a round, written out; arg_min takes the smaller number of equally near centroids by a pair."""
    distance = "list_sum(list_transform(list_zip(e.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    assign = "a{r} as materialized (select e.i, min(({d}, c.n)) as best from e cross join c{r} c group by e.i)"
    move = """s{r} as (select best[2] as n, dim, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) as m
  from (select a.best, unnest(e.x) as v, generate_subscripts(e.x, 1) as dim from a{r} a join e on a.i = e.i) group by 1, 2),
c{t} as materialized (select c.n, coalesce(any_value(s.x), any_value(c.x)) as x
  from c{r} c left join (select n, list(m::bigint order by dim) as x from s{r} group by n) s on c.n = s.n group by c.n)"""
    steps = [p.format(r=r, t=r + 1, d=distance) for r in range(rounds) for p in (assign, move)] + [assign.format(r=rounds, d=distance)]
    return f"""
with e as materialized (
  select row_number() over () as i, vec_id, list_transform(embedding, lambda v: floor(1024 * v::double)::bigint) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda v: v is not null and isfinite(v))) = 64),
c0 as materialized (
  select row_number() over (order by h, x) - 1 as n, x from (select sha256('3:' || coalesce(vec_id::varchar, '')) as h, x from e order by h, x limit {k})),
{", ".join(steps)}
select e.vec_id, a.best[2]::int as cluster, a.best[1]::bigint as distance,
  (sum(a.best[1]) over (partition by a.best[2]))::bigint as cluster_inertia, (sum(a.best[1]) over ())::bigint as inertia,
  sha256(array_to_string(c.x, ',')) as centroid_sha256
from a{rounds} a join e on a.i = e.i join c{rounds} c on c.n = a.best[2]
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(_documents(spark, sf_dir))


def _op13_print(text: str) -> str:
    """The fingerprint of a text as SQL."""
    words = rf"regexp_extract_all(lower({text}), '[^\x20\x09-\x0D]+')"
    hashes = f"(select list_transform(case when len(w) = 0 then [] else generate_series(1, greatest(1, len(w) - 4)) end, lambda i: left(md5(array_to_string(w[i:i + 4], ' ')), 16)) as h from (select {words} as w))"
    return f"""(select list_sort(list_distinct(case when list_min(h) < '2' then list_filter(h, lambda x: x < '2') when len(h) > 0 then [list_min(h)] else h end)) from {hashes})"""


OP13_SQL = f"""
with t as (
  select doc_id, coalesce(text, '') as body, coalesce(lead(coalesce(text, '')) over (order by doc_id, text), first(coalesce(text, '')) over (order by doc_id, text)) as after
  from documents),
e as (select *, length(body) - length(body) // 2 as stay, body[:length(body) - length(body) // 2] || after[:length(body) // 2] as edited from t),
p as (select *, {_op13_print("body")} as a, {_op13_print("edited")} as b, {_op13_print("after")} as c from e),
n as (select *, len(list_intersect(a, b)) as ab, len(list_intersect(a, c)) as ac from p)
select doc_id, length(body)::bigint as n_chars, sha256(edited) as edited_sha256, array_to_string(a, ',') as fingerprint, array_to_string(b, ',') as edited_fingerprint,
  case when len(a) + len(b) = 0 then 1.0::double else ab::double / (len(a) + len(b) - ab) end as near_edited,
  case when len(a) + len(c) = 0 then 1.0::double else ac::double / (len(a) + len(c) - ac) end as near_next,
  case when len(c) = 0 then 0.0::double else ac::double / len(c) end as next_in_doc,
  case when len(a) = 0 then 0.0::double else ac::double / len(a) end as doc_in_next
from n
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_near_dedup": op2_near_dedup,
        "op3_packing": op3_packing,
        "op4_sharding": op4_sharding,
        "op5_language_id": op5_language_id,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_secret_scan": op7_secret_scan,
        "op8_media": op8_media,
        "op9_token_counts": op9_token_counts,
        "op10_line_dedup": op10_line_dedup,
        "op11_clustering": op11_clustering,
        "op12_whitening": op12_whitening,
        "op13_fingerprints": op13_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op4_sharding": op4_sql(), "op10_line_dedup": OP10_SQL, "op11_clustering": op11_sql(), "op13_fingerprints": OP13_SQL}
