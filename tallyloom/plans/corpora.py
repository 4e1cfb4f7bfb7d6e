"""Queries over files and manifests, ranges of spans, registers and initialisms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import conventions, corpora
from tallyloom.session import table

#: Spans of a book that are read after its opening.
MOST = 40
#: The speech verbs and the buckets of the query on relation types, in the order in which a bucket wins.
SPEECH = ("that", "was")
BUCKETS = (("place", ("from", "with", "this")), ("share", ("with", "and")), ("kind", ("this", "is", "that")))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_WORDS = "w as (select token, count(*) n from (select unnest(regexp_extract_all(lower(text), '([a-z]+)', 1)) token from documents) group by 1)"


def j12_manifest(spark, sf_dir):
    """Documents as files, some named otherwise; parts as the manifest, their types as subjects."""
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, "pg").otherwise(""), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".txt").otherwise(".md"))
    subject = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_type", F.lit(" Short Stories"))).when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("FICTION, "), "p_name")).otherwise(F.col("p_type"))
    manifest = table(spark, sf_dir, "part").select("p_partkey", subject.alias("subject"))
    found = corpora.with_manifest(table(spark, sf_dir, "documents").select("doc_id", name.alias("file")), manifest, "file", "p_partkey")
    return found.select("file", "p_partkey", corpora.is_fiction(F.col("subject")).alias("fiction"))


J12 = r"""
with f as (select case when doc_id % 2 = 0 then 'pg' else '' end || doc_id || case when doc_id % 3 = 0 then '.txt' else '.md' end as file from documents),
p as (select p_partkey, case when p_partkey % 5 = 0 then p_type || ' Short Stories' when p_partkey % 7 = 0 then 'FICTION, ' || p_name else p_type end s from part)
select file, p_partkey, regexp_matches(s, '(?i)fiction|stories') as fiction from f join p on regexp_replace(regexp_replace(file, '^pg', ''), '\.txt$', '') = p_partkey::varchar"""


def p15_span_range(spark, sf_dir):
    """Users as books, their events as spans."""
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    placed = table(spark, sf_dir, "events").select("user_id", "event_id", pos.alias("pos"))
    return corpora.span_range(placed, "user_id", "pos", MOST)


P15 = f"""with e as (select user_id, event_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) pos, count(*) over (partition by user_id) n from events)
select user_id, event_id, pos from e where pos >= least(15, n) and pos < least(n, 15 + {MOST})"""


KINDS = ("copula", "preposition", "calendar")


def k05_answers(spark, sf_dir):
    """Every word of the documents that a register holds, by the question that it answers."""
    entries = conventions.seed(spark, corpora.REGISTERS)
    words = _words(spark, sf_dir)
    found = [conventions.answers(words, entries, q).withColumn("question", F.lit(q)) for q in KINDS]
    return found[0].unionByName(found[1]).unionByName(found[2])


K05 = (
    f"with {_WORDS}, r as (select * from (values "
    + ", ".join(f"('{kind}', '{token}')" for kind in KINDS for token in corpora.REGISTERS[kind])
    + ") v(question, token)) select w.token, n, question from w join r on w.token = r.token"
)


def f39_relation_type(spark, sf_dir):
    """Every word of the documents with its relation type."""
    entries = conventions.seed(spark, {"attribution-verb": list(SPEECH)})
    rows = [(bucket, i, t) for i, (bucket, tokens) in enumerate(BUCKETS) for t in tokens]
    return corpora.relation_types(_words(spark, sf_dir), entries, spark.createDataFrame(rows, "bucket string, ord int, token string")).select("token", "n", "relation_type")


F39 = (
    f"with {_WORDS}, b as (select * from (values "
    + ", ".join(f"('{bucket}', {i}, '{t}')" for i, (bucket, tokens) in enumerate(BUCKETS) for t in tokens)
    + f""") v(bucket, ord, token)), f as (select token, arg_min(bucket, ord) bucket from b group by 1)
select w.token, n, case when w.token in {SPEECH} then 'speech' else bucket end as relation_type from w left join f on w.token = f.token"""
)


def k07_initialisms(spark, sf_dir):
    """Market segments as acronyms of their customers' names, the last customer's name counting."""
    uses = table(spark, sf_dir, "customer").select(F.concat(F.substring("c_mktsegment", 1, 3), F.lit(".")).alias("token"), F.col("c_name").alias("expansion"), F.lit(1).alias("weight"), F.col("c_custkey").alias("pos"))
    return corpora.initialisms(uses, "pos")


K07 = "select lower(substr(c_mktsegment, 1, 3)) as token, arg_max(c_name, c_custkey) as expansion, count(*)::bigint as weight from customer group by 1"


def j16_slot_mates(spark, sf_dir):
    """Nations as tokens, their regions as slots."""
    return corpora.slot_members(table(spark, sf_dir, "nation").select(F.col("n_name").alias("token"), F.col("n_regionkey").alias("slot")))


J16 = """
select x.n_name as token, x.n_regionkey as slot, count(y.n_name) as n_mates, min(y.n_name) as first_mate
from nation x left join nation y on x.n_regionkey = y.n_regionkey and x.n_name <> y.n_name group by 1, 2"""

QUERIES = {
    "j12_manifest": (j12_manifest, J12),
    "p15_span_range": (p15_span_range, P15),
    "k05_answers": (k05_answers, K05),
    "f39_relation_type": (f39_relation_type, F39),
    "k07_initialisms": (k07_initialisms, K07),
    "j16_slot_mates": (j16_slot_mates, J16),
}
