"""Queries over units made from events: folds, records, conventions, exemplars, condensation and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import cube
from tallyloom.operators import contracts, conventions, emergence, folds, measure, records
from tallyloom.plans.measurement import BASE as MEASURED
from tallyloom.plans.measurement import measured
from tallyloom.session import table

ACT = {"signup": "INS", "click": "CON", "view": "SIG", "purchase": "SYN", "error": "NUL"}


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading of each event: surprises by its type, merges, ground amounts, held and predicted from its numbers."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("event_id").alias("i"))
    act = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in ACT.items()])
    amount = lambda k: (F.col("i") % k).cast("double")
    site = lambda a, b, c: F.struct(amount(a).alias("cultivating"), amount(b).alias("clearing"), amount(c).alias("tending"))
    ground = F.when(F.col("i") % 4 == 0, F.struct(site(3, 2, 5).alias("void"), site(2, 7, 2).alias("field"), site(5, 3, 2).alias("atmosphere")))
    return e.select(
        "event_id",
        F.when(F.col("i") % 3 == 0, F.array().cast("array<string>")).when(F.col("i") % 3 == 1, F.array(act)).otherwise(F.array(act, F.lit("SEG"))).alias("surprises"),
        F.when(F.col("i") % 10 == 0, 1).otherwise(0).alias("n_syn"),
        ground.alias("ground"),
        (F.col("i") % 2 == 0).alias("held"),
        (F.col("i") % 5 == 0).alias("predicted"),
    )


def f42_folds(spark, sf_dir):
    f = folds.fold_readings(readings(spark, sf_dir))
    return f.select("event_id", F.posexplode("acts").alias("i", "a")).select("event_id", "i", "a.act", "a.grain", "a.weight_ppm")


_GROUND = [(site, st, act, k) for st, ks in (("cultivating", (3, 2, 5)), ("clearing", (2, 7, 3)), ("tending", (5, 2, 2))) for (site, acts), k in zip(folds.GROUND_ACTS.items(), ks, strict=True) for act in [acts[st]]]
_TOT = {st: " + ".join(f"(i % {k})" for s, t, a, k in _GROUND if t == st) for st in folds.STANCES}
_ACTIVE = " + ".join(f"case when {t} > 0 then 1 else 0 end" for t in _TOT.values())
_FOLD = (
    """
with e as (select event_id, event_id i, case event_type when 'signup' then 'INS' when 'click' then 'CON' when 'view' then 'SIG' when 'purchase' then 'SYN' else 'NUL' end act from events),
u as (
  select event_id, 10 o, act, 'Figure' grain, 1.0::double units from e where i % 3 > 0
  union all select event_id, 11, 'SEG', 'Figure', 1.0 from e where i % 3 = 2
  union all select event_id, 12, 'SYN', 'Figure', 1.0 from e where i % 10 = 0
"""
    + "".join(f"  union all select event_id, {20 + n}, '{act}', 'Ground', (i % {k})::double / ({_TOT[st]}) / ({_ACTIVE}) from e where i % 4 = 0 and i % {k} > 0\n" for n, (site, st, act, k) in enumerate(_GROUND))
    + """
  union all select event_id, 40, 'SYN', 'Ground', 1.0 from e where i % 10 = 0
  union all select event_id, 41, 'NUL', 'Figure', 1.0 from e where i % 2 = 0 and i % 3 = 0 and i % 10 <> 0
  union all select event_id, 42, 'REC', 'Figure', 1.0 from e where i % 5 = 0
  union all select event_id, 43, 'EVA', 'Figure', 1.0 from e),
r as (select *, row_number() over (partition by event_id order by o) - 1 k, case when o < 43 then cast(floor(units / sum(units) over (partition by event_id) * 1000000 + 0.5) as bigint) else 0 end w from u),
fold as (select event_id, k, act, grain, cast(case when o = 43 then 1000000 - sum(w) over (partition by event_id) else w end as bigint) weight_ppm from r)"""
)
F42 = _FOLD + " select event_id, cast(k as int) as i, act, grain, weight_ppm from fold"


def f12_fold_ppm(spark, sf_dir):
    m = measure.measure_folds(folds.fold_readings(readings(spark, sf_dir)))
    return measure.cells_long(m, "event_id").filter("amplitude_ppm > 0")


F12 = _FOLD + f""", c as (select * from {cube.values_sql()}), w as (select event_id, idx cell, sum(weight_ppm)::bigint w from fold join c on fold.act = c.act and fold.grain = c.grain group by 1, 2),
s as (select *, case when cell < 26 then cast(floor(w / sum(w) over (partition by event_id)::double * 1000000 + 0.5) as bigint) else 0 end r from w),
t as (select event_id, cell, w similarity_ppm, r amplitude_ppm from s where cell < 26 union all
  select e.event_id, 26, coalesce((select w from w where w.event_id = e.event_id and w.cell = 26), 0), greatest(0, 1000000 - e.r) from (select event_id, sum(r) r from s group by 1) e)
select event_id, cell, similarity_ppm, amplitude_ppm::bigint as amplitude_ppm from t where amplitude_ppm > 0"""


def f32_signatures(spark, sf_dir):
    f = folds.fold_readings(readings(spark, sf_dir))
    return f.select("event_id", F.array_join(folds.signature(F.col("acts")), " ").alias("signature"))


F32 = _FOLD + " select event_id, string_agg(s, ' ' order by s) as signature from (select distinct event_id, act || ':' || grain s from fold) group by 1"


def _units(spark, sf_dir):
    """Units of users: the act of each event at a grain by its value."""
    e = table(spark, sf_dir, "events")
    act = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in ACT.items()])
    grain = F.when(F.col("value") < 33, "Ground").when(F.col("value") < 66, "Figure").otherwise("Pattern")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("user_id", pos.alias("pos"), F.array(F.concat_ws(":", act, grain)).alias("signature"))


def w06_windows(spark, sf_dir):
    return records.window_signatures(_units(spark, sf_dir), "user_id", "pos", "signature", 3).select(F.col("doc").alias("user_id"), "pos", F.array_join("window", " ").alias("window"))


W06 = """
with u as (select user_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) pos,
  case event_type when 'signup' then 'INS' when 'click' then 'CON' when 'view' then 'SIG' when 'purchase' then 'SYN' else 'NUL' end || ':' || case when value < 33 then 'Ground' when value < 66 then 'Figure' else 'Pattern' end s from events),
w as (select user_id, pos, list(s) over (partition by user_id order by pos rows between current row and 2 following) l from u)
select user_id, pos, array_to_string(list_sort(list_distinct(l)), ' ') as "window" from w where len(l) = 3"""


def g10_records(spark, sf_dir):
    return records.mine_records(_units(spark, sf_dir), "user_id", "pos", "signature").select("doc", "rank", "unit_count", "n_records", "confidence", F.array_join("signature", " ").alias("signature"))


def a28_conventions(spark, sf_dir):
    """Event types as tokens of their users' registers: each event teaches, holds, breaks, defeats or restores."""
    op = F.element_at(F.array(*[F.lit(o) for o in conventions.OPS]), (F.col("event_id") % 6 + 1).cast("int"))
    log = table(spark, sf_dir, "events").select(F.concat(F.lit("k"), F.col("user_id") % 5).alias("kind"), F.col("event_type").alias("token"), F.struct("ts", "event_id").alias("pos"), op.alias("op"), F.lit(1).alias("weight"))
    seeds = conventions.seed(spark, {f"k{i}": ["view", "click"] for i in range(5)})
    return conventions.fold_log(log, seeds)


A28 = """
with e as (select 'k' || (user_id % 5) kind, event_type token, ts, event_id, event_id % 6 op from events),
pr as (select 'k' || i kind, t token from range(5) r(i), (values ('view'), ('click')) v(t)),
l as (select kind, token, list({'op': op, 'w': 0::bigint, 'su': 0::bigint, 'st': 0::bigint, 'd': false, 'o': 'learned'} order by ts, event_id) a from e group by 1, 2),
j as (select coalesce(l.kind, pr.kind) kind, coalesce(l.token, pr.token) token, coalesce(a, []) a, pr.kind is not null p from l full join pr on l.kind = pr.kind and l.token = pr.token),
r as (select kind, token, list_reduce([{'op': -1::bigint, 'w': 0::bigint, 'su': case when p then 3 else 0 end::bigint, 'st': 0::bigint, 'd': false, 'o': case when p then 'prior' else 'learned' end}] || a, lambda s, x:
  {'op': x.op, 'w': s.w + case when x.op = 0 then 1 else 0 end, 'su': s.su + case when x.op in (0, 1, 5) then 1 else 0 end,
   'st': case x.op when 1 then greatest(0, s.st - 1) when 2 then s.st + 1 when 4 then 0 else s.st end,
   'd': case when x.op in (0, 4) then false when x.op = 3 then true when x.op = 1 and greatest(0, s.st - 1) > s.su + 1 then true when x.op = 2 and s.st + 1 > s.su then true else s.d end,
   'o': case when x.op = 0 then 'learned' else s.o end}) z from j)
select kind, token, z.o as origin, z.w as weight, z.su as support, z.st as strain, z.d as defeated from r"""


def c16_compatibility(spark, sf_dir):
    """Parts as snapshots of packs: their epochs, schemas and engines vary with their keys."""
    k = F.col("p_partkey")
    version = F.concat_ws(".", (k % 7).cast("string"), (k % 4).cast("string"), F.when(k % 3 > 0, (k % 11).cast("string")))
    snapshots = table(spark, sf_dir, "part").select(
        k.alias("snapshot_id"), F.when(k % 5 == 0, "Other@1").otherwise("PriorSnapshot@1").alias("schema"), F.concat(F.lit("epoch-"), (k % 3).cast("string")).alias("operator_epoch"), F.when(k % 13 != 0, version).alias("engine_version")
    )
    rows = [("epoch-0", ">=5.0.0 <6", ["PriorSnapshot@1"]), ("epoch-1", ">2.1 <=4.3.9", ["PriorSnapshot@1", "Other@1"])]
    return contracts.compatibility(snapshots, spark.createDataFrame(rows, "operator_epoch string, engine_compatibility string, spec_versions array<string>")).select("snapshot_id", "reason")


C16 = """
with v as (select p_partkey k, p_partkey % 7 a, p_partkey % 4 b, case when p_partkey % 3 > 0 then p_partkey % 11 else 0 end c, p_partkey % 13 <> 0 known from part)
select k as snapshot_id, case when k % 3 = 2 then 'unknown-epoch' when k % 3 = 0 and k % 5 = 0 then 'schema'
  when k % 3 = 0 and not (known and (a, b, c) >= (5, 0, 0) and (a, b, c) < (6, 0, 0)) then 'engine'
  when k % 3 = 1 and not (known and (a, b, c) > (2, 1, 0) and (a, b, c) <= (4, 3, 9)) then 'engine' end as reason from v"""


def p16_lint(spark, sf_dir):
    """Pages as published files, some of them code, some importing, some naming the latest, some with an id of zeros; then what a later state changed."""
    k = F.col("page_id")
    name = F.concat(F.lit("packs/"), k.cast("string"), F.when(k % 7 == 0, ".Js").when(k % 2 == 0, ".json").otherwise(".html"))
    zeros = F.concat(F.lit('{"pack_id":"pack:sha256:'), F.repeat(F.lit("0"), 64), F.lit('"}'))
    text = F.when((k % 2 == 0) & (k % 5 == 0), zeros).when(k % 11 == 0, "const a = require('foreignapp/x')").when(k % 13 == 0, "see the @latest one").otherwise(F.md5("html"))
    files = table(spark, sf_dir, "pages").select(k.alias("k"), name.alias("path"), text.alias("text"))
    later = files.filter("k % 17 <> 0").withColumn("text", F.when(F.col("k") % 19 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return contracts.lint(files, "foreignapp").unionByName(contracts.changed_snapshots(files, later))


P16 = """
with f as (select page_id k, 'packs/' || page_id || case when page_id % 7 = 0 then '.Js' when page_id % 2 = 0 then '.json' else '.html' end as path from pages),
r as (select path, case when k % 7 = 0 then 'code' end a, case when not (k % 2 = 0 and k % 5 = 0) and k % 11 = 0 then 'import' end b,
  case when not (k % 2 = 0 and k % 5 = 0) and k % 11 <> 0 and k % 13 = 0 then 'implicit-latest' end c,
  case when k % 7 <> 0 and k % 2 = 0 and k % 5 = 0 then 'zero-id' end d, case when k % 17 = 0 then 'dropped' when k % 19 = 0 then 'changed' end e from f)
select path, rule from (select path, unnest([a, b, c, d, e]) rule from r) where rule is not null"""


def k10_relations(spark, sf_dir):
    """Sources as relation verbs with their counts."""
    verbs = table(spark, sf_dir, "documents").groupBy(F.concat("source", F.lit(".")).alias("via")).agg(F.count("*").alias("count"))
    return conventions.corpus_relations(verbs, 20, 50)


K10 = "select 'relation' as kind, source as token, 'prior' as origin, 0::bigint as weight, least(count(*), 50) as support, 0::bigint as strain, false as defeated from documents group by source having count(*) >= 20"


def g09_basis(spark, sf_dir):
    chosen = records.select_basis(measured(spark, sf_dir).select(F.col("vec_id").alias("candidate_id"), "amplitude_ppm"))
    return spark.createDataFrame([(c["rank"], c["candidate_id"], c["admitted_for"], c["gain"]) for c in chosen], "rank int, candidate_id long, admitted_for string, gain long")


def g09_first_pick(spark, sf_dir):
    """The first exemplar: the largest sum of amplitudes, of equal ones the smallest id."""
    m = measured(spark, sf_dir).select("vec_id", measure.supported(F.col("amplitude_ppm")).alias("gain"))
    return m.orderBy(F.desc("gain"), "vec_id").limit(1).select(F.col("vec_id").alias("candidate_id"), "gain")


G09 = MEASURED + " select vec_id as candidate_id, sum(amplitude_ppm)::bigint as gain from m group by 1 order by 2 desc, 1 limit 1"


def g02_condense(spark, sf_dir):
    """Every label's vectors as a lens of its own, their sources by id modulo 7."""
    m = measured(spark, sf_dir).withColumn("source", (F.col("vec_id") % 7).cast("string"))
    found = emergence.emerge_groups(emergence.members(m, "label", "vec_id", "source"))
    return found.select("grp", "tier", "n_members", F.array_join("members", ",").alias("members"), F.round("gain_bits", 6).alias("gain_bits"))


def a16_tiers(spark, sf_dir):
    """Groups by tier: their number, mean gain, members and sources."""
    m = measured(spark, sf_dir).withColumn("source", (F.col("vec_id") % 7).cast("string"))
    found = emergence.emerge_groups(emergence.members(m, "label", "vec_id", "source"))
    return found.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("gain_bits"), 6).alias("gain_bits"), F.round(F.avg("n_members"), 6).alias("members"), F.round(F.avg(F.size("sources")), 6).alias("sources"))


def c11_readiness(spark, sf_dir):
    """Users as channels, each of their events as a split."""
    e = table(spark, sf_dir, "events")
    channels = e.groupBy(F.col("user_id").alias("channel")).agg(F.median(F.col("event_id") % 25).alias("median_steps"), (F.avg("value") / 120).alias("fragmentation"))
    splits = e.select(F.col("user_id").alias("channel"), F.col("event_type").alias("seed"), (F.col("event_id") % 35 != 0).alias("recovered"), F.col("value").alias("gain"), F.lit(1.0).alias("null_gain"), (F.col("value") - 3).alias("effect"))
    r = contracts.readiness(channels, splits)
    return r.select("channel", "ready", F.array_join("reasons", ",").alias("reasons"))


C11 = """
with c as (select user_id, median(event_id % 25) ms, avg(value)/120 fr from events group by 1),
s as (select user_id, count(distinct event_type) seeds, count(*) n, count(*) filter (event_id % 35 = 0) lost, count(*) filter (not (value > 1.0)) bn, count(*) filter (not (value - 3 >= 0)) be from events group by 1),
j as (select c.user_id, ms, fr, coalesce(seeds, 0) seeds, coalesce(n, 0) n, coalesce(lost, 0) lost, coalesce(bn, 0) bn, coalesce(be, 0) be from c left join s on c.user_id = s.user_id),
r as (select user_id, list_filter([case when ms < 12 then 'median_n_steps_above_floor' end, case when seeds < 3 then 'min_independent_splits' end, case when n = 0 or lost > 0 then 'kind_recovers_across_splits' end,
  case when n = 0 or bn > 0 then 'transfer_gain_clears_membership_null' end, case when n = 0 or be > 0 then 'relative_effect_floor_met_on_holdout' end, case when fr >= 0.35 then 'coreference_fragmentation_below_threshold' end], lambda x: x is not null) a from j)
select user_id as channel, len(a) = 0 as ready, coalesce(array_to_string(a, ','), '') as reasons from r"""


def c15_rights(spark, sf_dir):
    """Sources with a status by their number; some have none, some one that isn't known."""
    n = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    status = F.try_element_at(F.array(*[F.lit(s) for s, _ in contracts.RIGHTS], F.lit("odd")), n % 7 + 1)
    return contracts.retained(table(spark, sf_dir, "documents").select("source").distinct().withColumn("status", status)).select("source", "status", "may_retain_full_text")


C15 = r"""
with s as (select distinct source, regexp_extract(source, '(\d+)', 1)::int % 7 k from documents)
select source, case k when 0 then 'public_domain' when 1 then 'licensed' when 2 then 'fair_use_asserted' when 3 then 'restricted' else 'unknown' end as status, k < 3 as may_retain_full_text from s"""


def c03_one_basis(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 400 == 0, "b2").otherwise("b1").alias("basis_id"))
    return contracts.one_basis(e, "user_id")


C03 = "select user_id, count(distinct event_id % 400 = 0) as n_bases, count(distinct event_id % 400 = 0) <= 1 as comparable from events group by 1"


def j14_names(spark, sf_dir):
    """Names that were given for the vocabulary's present hash; stale ones don't show."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.sha2((F.col("c_nationkey") % 5).cast("string"), 256).alias("content_hash"))
    names = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.sha2((F.col("c_nationkey") % 4).cast("string"), 256).alias("content_hash"), F.col("c_name").alias("external_name"))
    return contracts.with_names(c, names).select("id", "external_name")


J14 = "select c_custkey as id, case when c_custkey % 3 = 0 and c_nationkey % 5 = c_nationkey % 4 then c_name end as external_name from customer"

QUERIES = {
    "f42_folds": (f42_folds, F42),
    "f12_fold_ppm": (f12_fold_ppm, F12),
    "f32_signatures": (f32_signatures, F32),
    "w06_windows": (w06_windows, W06),
    "g10_records": (g10_records, None),
    "c16_compatibility": (c16_compatibility, C16),
    "p16_lint": (p16_lint, P16),
    "a28_conventions": (a28_conventions, A28),
    "k10_relations": (k10_relations, K10),
    "g09_basis": (g09_basis, None),
    "g09_first_pick": (g09_first_pick, G09),
    "g02_condense": (g02_condense, None),
    "a16_tiers": (a16_tiers, None),
    "c11_readiness": (c11_readiness, C11),
    "c15_rights": (c15_rights, C15),
    "c03_one_basis": (c03_one_basis, C03),
    "j14_names": (j14_names, J14),
}
