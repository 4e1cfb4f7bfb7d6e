"""Queries over a ledger made from the events table.

Each event names the one before it of the same user as its input. signup creates an observation, view and purchase measure it, an error
retracts the event before it, and a click declines. Observations are users; the basis is the user's parity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import emergence, ledger
from tallyloom.session import table

TYPES = {"error": "event.retracted", "signup": "observation.created", "view": "observation.measured", "purchase": "observation.measured"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events")
    before = Window.partitionBy("user_id").orderBy("ts", "event_id")
    name = lambda c: F.concat(F.lit("ev:"), F.lpad(c.cast("string"), 8, "0"))
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in TYPES.items()], F.lit("observation.declined"))
    e = raw.select("event_id", "user_id", "event_type", "ts", F.lag("event_id").over(before).alias("prev"), F.row_number().over(before).alias("place"))
    return e.select(
        name(F.col("event_id")).alias("event_id"),
        kind.alias("event_type"),
        F.when(F.col("prev").isNull(), F.array().cast("array<string>")).otherwise(F.array(name(F.col("prev")))).alias("inputs"),
        F.when(F.col("event_type") == "error", name(F.col("prev"))).alias("retracted_event_id"),
        F.lit(None).cast("string").alias("superseded_event_id"),
        F.concat(F.lit("ob:"), F.col("user_id").cast("string")).alias("observation_id"),
        F.concat(F.lit("src:"), (F.col("user_id") % 7).cast("string")).alias("source_id"),
        F.concat(F.lit("exemplar-basis:sha256:"), F.sha2((F.col("user_id") % 2).cast("string"), 256)).alias("basis_id"),
        "place",
    )


BASE = """
with e as (select event_id, user_id, event_type, ts, lag(event_id) over (partition by user_id order by ts, event_id) prev, row_number() over (partition by user_id order by ts, event_id) place from events),
l as (select 'ev:' || lpad(event_id::varchar, 8, '0') id, case when prev is null then null else 'ev:' || lpad(prev::varchar, 8, '0') end inp,
  case event_type when 'error' then 'event.retracted' when 'signup' then 'observation.created' when 'view' then 'observation.measured' when 'purchase' then 'observation.measured' else 'observation.declined' end typ,
  'ob:' || user_id ob, 'src:' || (user_id % 7) src, 'exemplar-basis:sha256:' || sha256((user_id % 2)::varchar) basis, place from e),
ret as (select distinct inp id from l where typ = 'event.retracted' and inp is not null),
res as (select l.* from l left join ret on l.id = ret.id where ret.id is null)"""


def _resolved(spark, sf_dir):
    e = events(spark, sf_dir)
    return ledger.resolve(e, ledger.corrections(e))


def j02_resolved(spark, sf_dir):
    return _resolved(spark, sf_dir).select("event_id", "event_type")


J02 = BASE + " select id as event_id, typ as event_type from res"


def j04_head(spark, sf_dir):
    return ledger.head(_resolved(spark, sf_dir))


J04 = BASE + " select id as event_id from res where id not in (select inp from res where inp is not null)"


def j05_edges(spark, sf_dir):
    return ledger.edges(_resolved(spark, sf_dir))


J05 = BASE + " select r.id as event_id, r.inp as input_id from res r where r.inp in (select id from res)"


def j01_obs_source(spark, sf_dir):
    """Every third user's observation counts as invalidated."""
    r = _resolved(spark, sf_dir)
    bad = r.select("observation_id").filter(F.substring("observation_id", 4, 20).cast("int") % 3 == 0)
    found = ledger.observations(r, ledger.sources_of(r, F.col("place")), bad)
    return found.select("event_id", "observation_id", "source_id", "basis_id")


OBS = BASE + """, made as (select ob, max_by(src, place) src from res where typ = 'observation.created' group by 1),
obs as (select r.id, r.ob, coalesce(made.src, 'unknown-source') src, r.basis from res r left join made on r.ob = made.ob where typ = 'observation.measured' and substr(r.ob, 4)::int % 3 <> 0)"""
J01 = OBS + " select id as event_id, ob as observation_id, src as source_id, basis as basis_id from obs"


def a01_by_basis(spark, sf_dir):
    return j01_obs_source(spark, sf_dir).groupBy(ledger.lens_id(F.col("basis_id")).alias("lens_id")).agg(F.count("*").alias("n"), F.countDistinct("observation_id").alias("n_observations"), F.countDistinct("source_id").alias("n_sources"))


A01 = OBS + " select substr(replace(basis, 'exemplar-basis:sha256:', 'basis-'), 1, 24) as lens_id, count(*) as n, count(distinct ob) as n_observations, count(distinct src) as n_sources from obs group by 1"


def a02_counts(spark, sf_dir):
    e = events(spark, sf_dir)
    gone = ledger.corrections(e)
    named = gone.filter("how = 'retracted'").agg(F.countDistinct("event_id").alias("n_retracted"))
    resolved = ledger.resolve(e, gone).agg(F.count("*").alias("n_resolved"), F.count_if(F.col("event_type") == "observation.declined").alias("n_declined"))
    return resolved.crossJoin(named)  # one row each


A02 = BASE + " select (select count(*) from res) as n_resolved, (select count(*) from res where typ = 'observation.declined') as n_declined, (select count(*) from ret) as n_retracted"


def p01_types(spark, sf_dir):
    return events(spark, sf_dir).groupBy(ledger.type_class(F.col("event_type")).alias("class"), "event_type").agg(F.count("*").alias("n"))


P01 = BASE + " select 'writable' as class, typ as event_type, count(*) as n from l group by 2"


def p05_violations(spark, sf_dir):
    """Batches of one user each; some ids are made to repeat, some types to be wrong, and some payloads to hold a position."""
    raw = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 11 == 0, "holon.emerged").when(F.col("event_id") % 13 == 0, "no.such").otherwise("observation.measured")
    b = raw.select(
        F.col("user_id").cast("string").alias("file"),
        F.col("event_id").alias("place"),
        (F.floor(F.col("event_id") / F.when(F.col("event_id") % 5 == 0, 10).otherwise(1)) * 1).cast("string").alias("event_id"),
        kind.alias("event_type"),
        F.when(F.col("event_id") % 17 == 0, '{"a":{"ledger_position":1}}').otherwise("{}").alias("payload"),
    )
    return ledger.violations(b)


P05 = """
with b as (select user_id::varchar file, event_id place, floor(event_id::double / case when event_id % 5 = 0 then 10 else 1 end)::bigint::varchar event_id,
  case when event_id % 11 = 0 then 'projected' when event_id % 13 = 0 then 'unknown' else 'writable' end class, event_id % 17 = 0 pos from events),
f as (select *, row_number() over (partition by event_id order by file, place) r from b where class = 'writable')
select file, event_id, class || '-type' as violation from b where class <> 'writable'
union all select file, event_id, 'duplicate-id' from f where r > 1
union all select file, event_id, 'ledger-position' from f where pos"""


def w09_last(spark, sf_dir):
    raw = table(spark, sf_dir, "events")
    return ledger.last_by(raw, ["user_id", "event_type"], "value", ["ts", "event_id"])


W09 = "select user_id, event_type, max_by(value, (ts, event_id)) as value from events group by 1, 2"


def _groups(spark, sf_dir, width: int, skip: int) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % skip != 0)
    return v.groupBy(F.concat(F.lit("h"), (F.col("vec_id") % width).cast("string")).alias("name"), F.lit("Figure").alias("tier")).agg(F.collect_set(F.col("vec_id").cast("string")).alias("members"))


_GROUPS = """with p as (select 'h' || (vec_id % 12) name, vec_id::varchar m from embeddings where vec_id % 3 <> 0),
n as (select 'h' || (vec_id % 14) name, vec_id::varchar m from embeddings where vec_id % 5 <> 0)"""


def j06_diff(spark, sf_dir):
    return ledger.differences(_groups(spark, sf_dir, 12, 3), _groups(spark, sf_dir, 14, 5))


J06 = _GROUPS + """, a as (select name, list_sort(list(m)) x from p group by 1), b as (select name, list_sort(list(m)) x from n group by 1)
select coalesce(a.name, b.name) as name, case when a.x is null then 'added' when b.x is null then 'dissolved' when a.x <> b.x then 'changed' else 'same' end as change from a full join b on a.name = b.name"""


def j07_identity(spark, sf_dir):
    found = emergence.identify(_groups(spark, sf_dir, 14, 5), _groups(spark, sf_dir, 12, 3), emergence.Policy(identity_threshold=0.06))
    return found.select("candidate", "previous", F.round("overlap", 9).alias("overlap"), "outcome")


J07 = _GROUPS + """, pc as (select name, count(*) c from p group by 1), nc as (select name, count(*) c from n group by 1),
o as (select n.name cand, p.name prev, count(*) k from n join p on n.m = p.m group by 1, 2),
j as (select cand, prev, k::double/(nc.c + pc.c - k) ov from o join nc on nc.name = cand join pc on pc.name = prev),
b as (select * from (select *, row_number() over (partition by cand order by round(ov, 12) desc, prev) r from j) where r = 1)
select nc.name as candidate, prev as previous, round(coalesce(ov, 0.0), 9) as overlap, case when ov >= 0.06 then 'kept' when ov > 0 then 'rebound' else 'minted' end as outcome from nc left join b on nc.name = b.cand"""


def g01_topological(spark, sf_dir):
    return ledger.topological(events(spark, sf_dir)).select("event_id", "pos", "reach")


#: A user's events are a chain, so the place in it is the place in its component.
G01 = BASE + " select id as event_id, place - 1 as pos, max(id) over (partition by ob order by place rows between unbounded preceding and current row) as reach from l"


def s21_create_only(spark, sf_dir):
    """Every user's first event submits a batch named by the hour; batches of even hours are known."""
    raw = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd-HH").alias("batch_id"), F.col("ts").alias("submitted_at"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("file"))
    known = raw.filter(F.substring("batch_id", -2, 2).cast("int") % 2 == 0).select("batch_id").distinct()
    return ledger.unseen_batches(raw, known).select("batch_id", "file")


S21 = """with s as (select strftime(ts, '%Y-%m-%d-%H') batch_id, ts, lpad(event_id::varchar, 9, '0') file from events)
select batch_id, min_by(file, (ts, file)) as file from s where right(batch_id, 2)::int % 2 <> 0 group by 1"""


def f02_content_ref(spark, sf_dir):
    """Ids of documents by their texts, and of sources by their names."""
    d = table(spark, sf_dir, "documents")
    from tallyloom.functions.canonical import ref_column

    return d.select("doc_id", ref_column("representation", F.coalesce("text", F.lit(""))).alias("representation_id"), ref_column("source", F.coalesce("source", F.lit(""))).alias("source_id"))


F02 = "select doc_id, 'representation:sha256:' || sha256(coalesce(text, '')) as representation_id, 'source:sha256:' || sha256(coalesce(source, '')) as source_id from documents"


def f46_json_scalar(spark, sf_dir):
    """The number in each event's props, from a variant."""
    v = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    return v.groupBy("event_type").agg(F.sum(F.try_variant_get("v", "$.k", "long")).alias("k"), F.count(F.try_variant_get("v", "$.none", "string")).alias("n_none"))


F46 = "select event_type, cast(sum((props::json->>'k')::bigint) as bigint) as k, count(props::json->>'none') as n_none from events group by 1"


QUERIES = {
    "j01_obs_source": (j01_obs_source, J01),
    "j02_resolved": (j02_resolved, J02),
    "j04_head": (j04_head, J04),
    "j05_edges": (j05_edges, J05),
    "a01_by_basis": (a01_by_basis, A01),
    "a02_counts": (a02_counts, A02),
    "p01_types": (p01_types, P01),
    "p05_violations": (p05_violations, P05),
    "w09_last": (w09_last, W09),
    "j06_diff": (j06_diff, J06),
    "j07_identity": (j07_identity, J07),
    "g01_topological": (g01_topological, G01),
    "s21_create_only": (s21_create_only, S21),
    "f02_content_ref": (f02_content_ref, F02),
    "f46_json_scalar": (f46_json_scalar, F46),
}
