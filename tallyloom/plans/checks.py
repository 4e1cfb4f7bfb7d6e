"""Queries that check events and projections, and read folds, segments and spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import cube, schema
from tallyloom.operators import checks, folds, ledger, measure
from tallyloom.plans import ledgers, readings
from tallyloom.session import table

AT = "2024-01-01T00:00:00.000Z"
#: Books of the queries on readings.
BOOKS = 7


def p06_rejections(spark, sf_dir):
    """Events as batches of a user each: some types are wrong, some fields missing, some ids tampered with or repeated."""
    i = F.col("event_id")
    kind = F.when(i % 11 == 0, "holon.emerged").when(i % 13 == 0, "no.such").otherwise("observation.measured")
    n = F.when(i % 5 == 0, F.floor(i / 10)).otherwise(i).cast("long").cast("string")
    extra = F.when(i % 17 == 0, '"ledger_position":1,').when(i % 19 == 0, '"a":{"b":[1,0.5]},').otherwise("")
    head = F.concat(F.lit('{"actor":{"id":"a","type":"agent"},"event_type":"'), kind, F.lit('",'))
    rest = F.concat(F.lit(f'"occurred_at":"{AT}","payload":{{'), extra, F.lit('"n":'), n, F.lit('},"run":{"run_id":"r"},"spec_version":"1.0.0"'))
    inputs = F.lit('"inputs":[],')
    made = F.concat(F.lit("sha256:"), F.sha2(F.concat(head, inputs, rest, F.lit("}"), F.when(i % 23 == 0, "x").otherwise("")), 256))
    event = F.concat(head, F.when(i % 29 == 0, "").otherwise(inputs), rest, F.lit(',"event_id":"'), made, F.lit('"}'))
    batches = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file"), i.alias("place"), event.alias("event"))
    return checks.rejections(batches)


P06 = f"""
with b as (select user_id::varchar as file, event_id as place, case when event_id % 11 = 0 then 'holon.emerged' when event_id % 13 = 0 then 'no.such' else 'observation.measured' end as typ,
  case when event_id % 5 = 0 then event_id // 10 else event_id end as n, case when event_id % 17 = 0 then '"ledger_position":1,' when event_id % 19 = 0 then '"a":{{"b":[1,0.5]}},' else '' end as extra from events),
c as (select *, 'sha256:' || sha256('{{"actor":{{"id":"a","type":"agent"}},"event_type":"' || typ || '","inputs":[],"occurred_at":"{AT}","payload":{{' || extra || '"n":' || n || '}},"run":{{"run_id":"r"}},"spec_version":"1.0.0"}}'
  || case when place % 23 = 0 then 'x' else '' end) as event_id from b),
f as (select *, row_number() over (partition by event_id order by file, place) r from c where typ = 'observation.measured' and place % 29 <> 0)
select file, place, event_id, 'ledger-position' as reason from c where place % 17 = 0
union all select file, place, event_id, case typ when 'holon.emerged' then 'projected-type' else 'unknown-type' end from c where typ <> 'observation.measured'
union all select file, place, event_id, 'fields' from c where typ = 'observation.measured' and place % 29 = 0
union all select file, place, event_id, 'id' from f where place % 23 = 0
union all select file, place, event_id, 'duplicate-id' from f where r > 1
union all select file, place, event_id, 'float:payload.a.b[1]' from f where place % 19 = 0 and place % 17 <> 0"""


def p09_scope(spark, sf_dir):
    """The bases of all observations, of none, and an active one."""
    obs = ledgers.j01_obs_source(spark, sf_dir)
    named = lambda df, how: df.select(F.lit(how).alias("scope"), "basis_id")
    return named(checks.basis_scope(obs), "all").unionByName(named(checks.basis_scope(obs.limit(0)), "none")).unionByName(named(checks.basis_scope(obs, "exemplar-basis:sha256:0"), "active"))


P09 = ledgers.OBS + " select distinct 'all' as scope, basis as basis_id from obs union all select 'none', null union all select 'active', 'exemplar-basis:sha256:0'"


def f50_lenses(spark, sf_dir):
    return checks.lens_index(ledgers.j01_obs_source(spark, sf_dir), F.col("event_id"))


F50 = ledgers.OBS + """, f as (select basis, min(id) first_id from obs group by 1), o as (select basis, cast(row_number() over (order by first_id) - 1 as int) o from f)
select substr(replace(basis, 'exemplar-basis:sha256:', 'basis-'), 1, 24) as lens_id, basis as basis_id, o as ord, o = 0 as is_default from o"""


def x02_reproduced(spark, sf_dir):
    """Nations as lenses, their customers as what was folded; the rebuild lacks a nation and some customers."""
    c = table(spark, sf_dir, "customer").withColumn("lens_id", F.concat(F.lit("basis-"), F.col("c_nationkey").cast("string")))
    counts = [F.count("*").alias("n"), F.max("c_custkey").alias("head_digest")]
    claim = F.when(F.col("c_nationkey") % 4 == 0, "attested").otherwise("reproduced").alias("determinism")
    published = c.groupBy("lens_id", claim).agg(*counts)
    rebuilt = c.filter("c_custkey % 40 <> 0 and c_nationkey <> 3").groupBy("lens_id").agg(*counts)
    return checks.reproduced(published, rebuilt, ["head_digest", "n"])


X02 = """
with p as (select c_nationkey k, count(*) n, max(c_custkey) h from customer group by 1),
r as (select c_nationkey k, count(*) n, max(c_custkey) h from customer where c_custkey % 40 <> 0 and c_nationkey <> 3 group by 1)
select 'basis-' || p.k as lens_id, case when p.k % 4 = 0 then 'attested' when r.k is null then 'missing' when p.n = r.n and p.h = r.h then 'reproduced' else 'diverged' end as outcome from p left join r on p.k = r.k"""


def u05_channels(spark, sf_dir):
    """Words of part names as channels, some with the gated one among them; a part's size says whether it is ready."""
    gated = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit(checks.GATED_CHANNEL))).otherwise(F.array().cast("array<string>"))
    channels = F.concat(gated, F.split("p_name", " "))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(checks.snapshot_channels(channels, F.col("p_size") % 3 == 0), ",").alias("channels"))


U05 = "select p_partkey, replace(p_name, ' ', ',') || case when p_size % 3 = 0 then ',kind-vocabulary' else '' end as channels from part"


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    m = measure.measure_folds(folds.fold_readings(readings.readings(spark, sf_dir)))
    said = {"reader_version": F.lit("reader5.1"), "lens_id": F.lit("unset"), "surprisal_bits": (i % 7) / 2, "bayes_bits": (i % 5) / 4}
    return m.select("event_id", "held", "similarity_ppm", "amplitude_ppm", (i % BOOKS).cast("int").alias("book"), *[v.alias(k) for k, v in said.items()])


def f13_fold_diagnostics(spark, sf_dir):
    return checks.fold_diagnostics(_measured(spark, sf_dir)).select("event_id", "diagnostics.entropy_microunits", "diagnostics.total_supported_amplitude", "diagnostics.surprisal_bits", "diagnostics.bayes_bits", "diagnostics.held")


F13 = f"""
select event_id, cast(floor(sum(-(amplitude_ppm / 1000000.0::double) * log2(amplitude_ppm / 1000000.0::double)) * 1000000 + 0.5) as bigint) as entropy_microunits, sum(amplitude_ppm)::bigint as total_supported_amplitude,
  (event_id % 7)::double / 2 as surprisal_bits, (event_id % 5)::double / 4 as bayes_bits, event_id % 2 = 0 as held from ({readings.F12}) group by event_id"""


def f14_measure_fold(spark, sf_dir):
    """The id of each reading's measurement."""
    return checks.fold_measurements(_measured(spark, sf_dir), F.lit("exemplar-basis:sha256:0")).select("event_id", "measurement_protocol", "measurement_id")


def a14_readings(spark, sf_dir):
    return checks.reading_summary(_measured(spark, sf_dir), "book")


A14R = f"""
select cast(event_id % {BOOKS} as int) as book, count(*) as spans, count(*) filter (event_id % 2 = 0) as held_spans, count(*) as evidence_spans,
  round(100.0::double * count(*) filter (event_id % 2 = 0) / count(*), 1) as held_pct, round(sum((event_id % 7)::double / 2) / count(*), 4) as mean_surprisal_bits from events group by 1"""


def a15_act_shares(spark, sf_dir):
    return checks.act_shares(_measured(spark, sf_dir), "book", cube.cells(spark).select(F.col("idx").alias("cell"), "act"))


A15 = f"""
with f as ({readings.F12}), b as (select cast(event_id % {BOOKS} as int) book, count(*) spans from events group by 1)
select b.book, act, count(*) as n, round(100.0::double * count(*) / any_value(spans), 1) as pct
from f join (select idx, act from {cube.values_sql()}) c on f.cell = c.idx join b on b.book = f.event_id % {BOOKS} group by 1, 2"""


def f27_nested(spark, sf_dir):
    """Sentences within the paragraphs of documents, and whether each stands where its offsets say."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = checks.nested_segments(docs.withColumn("whole", F.col("text")), "text", "sentence", "doc_id", "whole")
    exact = F.substring(F.col("whole"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")
    return found.select("doc_id", "paragraph_index", "position", F.length("text").alias("n_chars"), exact.alias("exact"))


F27 = r"""
with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') ps from documents),
q as (select doc_id, cast(generate_subscripts(ps, 1) - 1 as int) paragraph_index, unnest(ps) t from p),
s as (select doc_id, paragraph_index, list_filter(list_transform(string_split(regexp_replace(t, '([.!?]["''’”)\]]*)(\s+)([A-Z0-9])', '\1⏹\3', 'g'), '⏹'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') ss from q),
u as (select doc_id, paragraph_index, cast(generate_subscripts(ss, 1) - 1 as int) position, unnest(ss) t from s)
select doc_id, paragraph_index, position, cast(length(t) as int) as n_chars, true as exact from u"""


def a10_spread(spark, sf_dir):
    found = checks.spread(table(spark, sf_dir, "events"), ["user_id"], "value")
    return found.select("user_id", "n", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"))


A10 = "select user_id, count(value) as n, round(coalesce(avg(value), 0), 6) as mean, round(case when count(value) < 2 then 0 else stddev_pop(value) end, 6) as stddev from events group by 1"




def p05_schema(spark, sf_dir):
    """Events as envelopes with planted faults, and every rule of the schema that each violates."""
    i = F.col("event_id")
    digest = F.concat(F.lit("sha256:"), F.sha2(i.cast("string"), 256))
    hexes = F.sha2(F.col("user_id").cast("string"), 256)
    uuid = F.concat_ws("-", F.concat(F.lit("uuid:"), F.substring(hexes, 1, 8)), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))
    kind = F.when(i % 3 == 0, "event.retracted").when(i % 7 == 0, "no.such").otherwise("observation.flagged")
    retracted = F.concat(F.lit('{"retracted_event_id":"'), F.when(i % 4 == 0, "x").otherwise(digest), F.lit('","reason":"'), F.when(i % 10 == 0, "").otherwise("r"), F.lit('"}'))
    flagged = F.concat(F.lit('{"observation_id":"observation:'), digest, F.lit('","flagged_by":"human","reason":"r","weight_ppm":'), F.when(i % 5 == 0, "-1").when(i % 11 == 0, "0.5").otherwise("1000000"), F.lit("}"))
    head = F.concat(F.lit('{"spec_version":'), F.when(i % 13 == 0, "1").otherwise('"1.0.0"'), F.lit(',"event_type":"'), kind, F.lit('","event_id":"'), digest, F.lit(f'","occurred_at":"{AT}",'))
    actor = F.when(i % 17 == 0, "").otherwise('"actor":{"type":"agent","id":"a","version":"1"},')
    run = F.concat(F.lit('"run":{"run_id":"'), F.when(i % 19 == 0, "r").otherwise(uuid), F.lit('","batch_id":"'), uuid, F.lit('","configuration_hash":"'), digest, F.lit('"},"inputs":["'), digest, F.when(i % 23 == 0, '","y').otherwise(""), F.lit('"],'))
    event = F.concat(head, actor, run, F.when(i % 29 == 0, '"ledger_position":1,').otherwise(""), F.lit('"payload":'), F.when(i % 3 == 0, retracted).otherwise(flagged), F.when(i % 31 == 0, "").otherwise("}"))
    found = schema.violations(F.try_parse_json(event), schema.event_schema(ledger.WRITABLE + ledger.PROJECTED))
    return table(spark, sf_dir, "events").select("event_id", F.posexplode(found).alias("ord", "violation"))


P05 = """
with r as (
  select event_id, event_id % 31 = 0 as broken, [case when event_id % 17 = 0 then '$.actor: required' end, case when event_id % 13 = 0 then '$.spec_version: type' end,
    case when event_id % 3 <> 0 and event_id % 7 = 0 then '$.event_type: enum' end, case when event_id % 19 = 0 then '$.run.run_id: pattern' end,
    case when event_id % 23 = 0 then '$.inputs[1]: pattern' end,
    case when event_id % 3 = 0 and event_id % 4 = 0 then '$.payload.retracted_event_id: pattern' end, case when event_id % 3 = 0 and event_id % 10 = 0 then '$.payload.reason: minLength' end,
    case when event_id % 3 <> 0 and event_id % 7 <> 0 and event_id % 5 = 0 then '$.payload.weight_ppm: minimum' end,
    case when event_id % 3 <> 0 and event_id % 7 <> 0 and event_id % 5 <> 0 and event_id % 11 = 0 then '$.payload.weight_ppm: type' end,
    case when event_id % 29 = 0 then '$: not' end] as v from events),
f as (select event_id, case when broken then ['$: json'] else list_filter(v, lambda x: x is not null) end as v from r)
select event_id, (generate_subscripts(v, 1) - 1)::int as ord, unnest(v) as violation from f"""

QUERIES = {
    "p05_schema": (p05_schema, P05),
    "p06_rejections": (p06_rejections, P06),
    "p09_scope": (p09_scope, P09),
    "f50_lenses": (f50_lenses, F50),
    "x02_reproduced": (x02_reproduced, X02),
    "u05_channels": (u05_channels, U05),
    "f13_fold_diagnostics": (f13_fold_diagnostics, F13),
    "f14_measure_fold": (f14_measure_fold, None),
    "a14_readings": (a14_readings, A14R),
    "a15_act_shares": (a15_act_shares, A15),
    "f27_nested": (f27_nested, F27),
    "a10_spread": (a10_spread, A10),
}
