"""Queries over measured embeddings: scores, distributions, gains, priors, folds and permutation tests.

Centroids are the mean embeddings by vec_id modulo 27; a vector's label stands for its book and its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import cube
from tallyloom.functions.numeric import PPM, settled
from tallyloom.operators import emergence, measure, priors
from tallyloom.session import table
from tallyloom.sources.scratch import cut

DIMS, PERMUTATIONS, FOLDS = 64, 2000, 4


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, similarity_ppm and amplitude_ppm in cube order."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    cents = measure.centroids(vectors, (F.col("vec_id") % 27).cast("int"), "embedding", DIMS)
    return measure.measure_vectors(vectors, cents, "embedding").drop("embedding")


def long_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.cells_long(measured(spark, sf_dir), "vec_id", "label")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, pos, cell, p): each label is a book, its vectors by id are its spans."""
    pos = F.row_number().over(Window.partitionBy("book").orderBy("vec_id")) - 1
    placed = measured(spark, sf_dir).select("vec_id", F.col("label").alias("book"), "similarity_ppm", "amplitude_ppm").withColumn("pos", pos)
    return measure.cells_long(placed, "book", "pos").select("book", "pos", "cell", (F.col("amplitude_ppm") / PPM).alias("p"))


#: m(vec_id, label, cell, cosv, similarity_ppm, amplitude_ppm) and sp(book, pos, cell, p), for DuckDB.
BASE = """
with x as (select vec_id, label, unnest(embedding)::double v, generate_subscripts(embedding, 1) - 1 pos from embeddings),
cen as (select cast(vec_id % 27 as int) cell, pos, avg(v) cv from x group by 1, 2),
cn as (select cell, sqrt(sum(cv*cv)) n from cen group by cell),
xn as (select vec_id, label, sqrt(sum(v*v)) n from x group by vec_id, label),
cs as (select x.vec_id, cen.cell, sum(x.v*cen.cv) dt from x join cen on x.pos = cen.pos group by x.vec_id, cen.cell),
co as (select cs.vec_id, xn.label, cs.cell, case when xn.n*cn.n > 0 then dt/(xn.n*cn.n) else 0 end cosv from cs join xn on cs.vec_id = xn.vec_id join cn on cs.cell = cn.cell),
ps as (select *, greatest(cosv, 0) p0, sum(greatest(cosv, 0)) over (partition by vec_id) sm from co),
rs as (select *, case when sm > 0 and cell < 26 then cast(floor(p0/sm*1000000+0.5) as bigint) else 0 end r from ps),
m as (select vec_id, label, cell, cosv, cast(greatest(-1000000, least(1000000, floor(cosv*1000000+0.5))) as bigint) similarity_ppm,
  cast(case when sm <= 0 then 0 when cell < 26 then r else greatest(0, 1000000 - sum(r) over (partition by vec_id)) end as bigint) amplitude_ppm from rs),
sp as (select label as book, dense_rank() over (partition by label order by vec_id) - 1 as pos, cell, amplitude_ppm/1000000.0::double as p, vec_id, similarity_ppm, amplitude_ppm from m),
mass as (select book, cell, sum(p) mass from sp group by 1, 2),
books as (select book, count(distinct pos) n_spans from sp group by 1),
""".rstrip().rstrip(",")


def _norm_sql(source: str, keys: str, value: str = "mass") -> str:
    """A normalised prior q per group of keys ('' for none) as a select over source."""
    over = f"over (partition by {keys})" if keys else "over ()"
    cols = f"{keys}, " if keys else ""
    return f"""select {cols}cell, f / sum(f) {over} q from (select {cols}cell, case when t > 0 then greatest({value}/t, 1e-6) else 1.0 end f from (select {cols}cell, {value}, sum({value}) {over} t from {source}))"""


CORR = """
pr as (select a.book a, b.book b, count(*)::double n, sum(a.mass) sx, sum(b.mass) sy, sum(a.mass*a.mass) sxx, sum(b.mass*b.mass) syy, sum(a.mass*b.mass) sxy
  from mass a join mass b on a.cell = b.cell and a.book < b.book group by 1, 2),
corr as (select a, b, case when n < 2 or sxx - sx*sx/n <= 1e-15 or syy - sy*sy/n <= 1e-15 then 0.0 else (sxy - sx*sy/n)/sqrt((sxx - sx*sx/n)*(syy - sy*sy/n)) end corr from pr)"""


def f04_cosine(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    cents = measure.centroids(vectors, (F.col("vec_id") % 27).cast("int"), "embedding", DIMS)
    scored = measure.cosines(vectors, cents, "embedding")
    return scored.select("vec_id", F.posexplode("cosines").alias("cell", "c")).select("vec_id", "cell", settled(F.col("c"), 9).alias("cosine"))


F04 = BASE + " select vec_id, cell, round(cosv, 9) + 0.0 as cosine from m"


def f07_ppm(spark, sf_dir):
    return long_cells(spark, sf_dir).select("vec_id", "cell", "similarity_ppm", "amplitude_ppm")


F07 = BASE + " select vec_id, cell, similarity_ppm, amplitude_ppm from m"


def f09_diagnostics(spark, sf_dir):
    return measured(spark, sf_dir).select("vec_id", measure.entropy_microbits(F.col("amplitude_ppm")).alias("entropy_microunits"), measure.supported(F.col("amplitude_ppm")).alias("total_supported_amplitude"))


_ENT = "cast(floor(sum(case when amplitude_ppm > 0 then -(amplitude_ppm/1000000.0::double)*log2(amplitude_ppm/1000000.0::double) else 0 end)*1000000+0.5) as bigint)"
F09 = BASE + f" select vec_id, {_ENT} as entropy_microunits, cast(sum(amplitude_ppm) as bigint) as total_supported_amplitude from m group by vec_id"


def p10_gate(spark, sf_dir):
    total = measure.supported(F.col("amplitude_ppm"))
    kind = F.when(total < 300_000, "observation.declined").otherwise("observation.measured")
    return measured(spark, sf_dir).groupBy(kind.alias("event_type")).agg(F.count("*").alias("n"))


P10 = BASE + " select case when t < 300000 then 'observation.declined' else 'observation.measured' end as event_type, count(*) as n from (select vec_id, sum(amplitude_ppm) t from m group by vec_id) group by 1"


def a03_prototype(spark, sf_dir):
    return emergence.prototypes(emergence.members(measured(spark, sf_dir), "label", "vec_id")).select("grp", "cell", settled(F.col("q"), 9).alias("q"))


_GAIN = """, ent as (select vec_id, label, floor(sum(case when amplitude_ppm > 0 then -(amplitude_ppm/1000000.0::double)*log2(amplitude_ppm/1000000.0::double) else 0 end)*1000000+0.5)/1000000 h from m group by 1, 2),
sw as (select m.label, m.cell, sum(amplitude_ppm/1000000.0::double) s, sum(h*sqrt(amplitude_ppm/1000000.0::double)) w from m join ent using (vec_id) group by 1, 2),
pq as (select label, cell, s / (case when sum(s) over (partition by label) = 0 then 1 else sum(s) over (partition by label) end) q, w from sw)"""
A03 = BASE + _GAIN + " select label as grp, cell, round(q, 9) + 0.0 as q from pq"


def a04_gain(spark, sf_dir):
    found = emergence.group_gains(emergence.members(measured(spark, sf_dir), "label", "vec_id"))
    return found.select("grp", "n_members", settled(F.col("gain_bits")).alias("gain_bits"))


A04 = BASE + _GAIN + """ select pq.label as grp, any_value(c.n) as n_members,
  round(sum(sqrt(q)*w) - floor(sum(case when q > 0 then -q*log2(q) else 0 end)*1000000+0.5)/1000000 - 1.0, 6) + 0.0 as gain_bits
from pq join (select label, count(*) n from ent group by 1) c on pq.label = c.label group by pq.label"""


def f15_bhattacharyya(spark, sf_dir):
    """Between the prototypes of every two labels."""
    q = emergence.prototypes(emergence.members(measured(spark, sf_dir), "label", "vec_id"))
    return emergence.bhattacharyya(q.select(F.col("grp").alias("a"), "cell", F.col("q").alias("p")), q.select(F.col("grp").alias("b"), "cell", "q")).filter("a < b").select("a", "b", settled(F.col("bc")).alias("bc"))


F15 = BASE + _GAIN + " select x.label as a, y.label as b, round(least(1.0, greatest(0.0, sum(sqrt(x.q*y.q)))), 6) + 0.0 as bc from pq x join pq y on x.cell = y.cell and x.label < y.label group by 1, 2"


def f17_regrain(spark, sf_dir):
    q = emergence.prototypes(emergence.members(measured(spark, sf_dir), "label", "vec_id"))
    names = cube.cells(spark)
    named = q.join(F.broadcast(names.select(F.col("idx").alias("cell"), F.col("cell").alias("name"))), "cell")
    return emergence.regrain(named.select("grp", F.col("name").alias("cell"), F.col("q").alias("p")), "Pattern", names, "grp").select("grp", "cell", settled(F.col("p"), 9).alias("p"))


F17 = BASE + _GAIN + f""", c as (select * from {cube.values_sql()})
select pq.label as grp, t.cell, round(sum(case when f.act = t.act and t.grain = 'Pattern' then q else 0 end), 9) + 0.0 as p
from pq join c f on pq.cell = f.idx cross join c t group by 1, 2"""


def g05_holdout(spark, sf_dir):
    """Clusters are vec_id modulo 5, sources the labels."""
    m = measured(spark, sf_dir).withColumn("cluster", (F.col("vec_id") % 5).cast("int"))
    return emergence.source_holdout(emergence.members(m, "cluster", "vec_id", "label")).select("grp", "source", "n_left", settled(F.col("gain_bits")).alias("gain_bits"), "survives")


G05 = BASE + """, ent as (select vec_id, label, cast(vec_id % 5 as int) g, floor(sum(case when amplitude_ppm > 0 then -(amplitude_ppm/1000000.0::double)*log2(amplitude_ppm/1000000.0::double) else 0 end)*1000000+0.5)/1000000 h from m group by 1, 2),
pairs as (select distinct g, label src from ent),
sw as (select p.g, p.src, m.cell, sum(amplitude_ppm/1000000.0::double) s, sum(h*sqrt(amplitude_ppm/1000000.0::double)) w from pairs p join ent e on e.g = p.g and e.label <> p.src join m on m.vec_id = e.vec_id group by 1, 2, 3),
nl as (select p.g, p.src, count(e.vec_id) n from pairs p left join ent e on e.g = p.g and e.label <> p.src group by 1, 2),
pq as (select g, src, s/(case when sum(s) over (partition by g, src) = 0 then 1 else sum(s) over (partition by g, src) end) q, w from sw),
gn as (select g, src, sum(sqrt(q)*w) - floor(sum(case when q > 0 then -q*log2(q) else 0 end)*1000000+0.5)/1000000 - 1.0 gain from pq group by 1, 2)
select nl.g as grp, nl.src as source, n as n_left, round(coalesce(gain, -1.0), 6) + 0.0 as gain_bits, n >= 2 and coalesce(gain, -1.0) > 0 as survives from nl left join gn on nl.g = gn.g and nl.src = gn.src"""


def a06_normalise(spark, sf_dir):
    return priors.normalise(priors.accumulate(spans(spark, sf_dir), "book"), "book").select("book", "cell", settled(F.col("q"), 9).alias("q"))


A06 = BASE + f" select book, cell, round(q, 9) + 0.0 as q from ({_norm_sql('mass', 'book')})"


def a07_cross_entropy(spark, sf_dir):
    """Mean surprise of each book under the prior of all books, its own entropy, and the difference."""
    s = spans(spark, sf_dir)
    prior = priors.normalise(priors.accumulate(s))
    ce = priors.surprise(s, prior, ["cell"]).groupBy("book").agg(F.avg("bits").alias("ce"))
    own = priors.entropy_of(priors.normalise(priors.accumulate(s, "book"), "book"), "book")
    return ce.join(own, "book").select("book", settled(F.col("ce")).alias("cross_entropy"), settled(F.col("entropy")).alias("entropy"), settled(F.col("ce") - F.col("entropy")).alias("kl"))


A07 = BASE + f""", tot as (select cell, sum(mass) mass from mass group by 1), pr as ({_norm_sql('tot', '')}), own as ({_norm_sql('mass', 'book')}),
ce as (select book, avg(bits) ce from (select book, pos, sum(case when p > 0 then -p*log2(q) else 0 end) bits from sp join pr on sp.cell = pr.cell group by 1, 2) group by 1),
h as (select book, sum(-q*log2(q)) h from own group by 1)
select ce.book, round(ce, 6) + 0.0 as cross_entropy, round(h, 6) + 0.0 as entropy, round(ce - h, 6) + 0.0 as kl from ce join h on ce.book = h.book"""


def a13_kfold(spark, sf_dir):
    """Each fold's mean surprise under the other folds' prior, a uniform one, and the first other book's."""
    s = _folded(spark, sf_dir)
    mass = priors.accumulate(s, "fold")
    trained = priors.normalise(priors.leave_one_out(mass, "fold"), "fold")
    ce = priors.surprise(s, trained, ["fold", "cell"]).groupBy("fold").agg(F.avg("bits").alias("ce"), F.count("*").alias("n_spans"))
    own = priors.entropy_of(priors.normalise(mass, "fold"), "fold")
    return ce.join(own, "fold").select("fold", "n_spans", settled(F.col("ce")).alias("cross_entropy"), settled(F.col("ce") - F.col("entropy")).alias("kl"), settled(F.lit(4.754887502163468) - F.col("entropy")).alias("kl_uniform"))


def _folded(spark, sf_dir):
    s = spans(spark, sf_dir)
    books = s.select("book").distinct().withColumn("fold", (F.row_number().over(Window.orderBy("book")) - 1) % FOLDS)
    return s.join(F.broadcast(books), "book")  # one row a book, numbered in their order


A13 = BASE + f""", bf as (select book, (row_number() over (order by book) - 1) % 4 fold from books),
fs as (select sp.*, fold from sp join bf on sp.book = bf.book), fm as (select fold, cell, sum(p) mass from fs group by 1, 2),
lo as (select fold, cell, sum(mass) over (partition by cell) - mass as mass from fm), tr as ({_norm_sql('lo', 'fold')}), own as ({_norm_sql('fm', 'fold')}),
h as (select fold, sum(-q*log2(q)) h from own group by 1),
ce as (select fold, avg(bits) ce, count(*) n from (select fs.fold, fs.book, fs.pos, sum(case when p > 0 then -p*log2(q) else 0 end) bits from fs join tr on fs.fold = tr.fold and fs.cell = tr.cell group by 1, 2, 3) group by 1)
select cast(ce.fold as int) as fold, n as n_spans, round(ce, 6) + 0.0 as cross_entropy, round(ce - h, 6) + 0.0 as kl, round(4.754887502163468 - h, 6) + 0.0 as kl_uniform from ce join h on ce.fold = h.fold"""


def f20_restrict(spark, sf_dir):
    """The spans over the cells of Figure grain alone: each book's prior."""
    figure = [c[0] for c in cube.CELLS if c[3] == "Figure"]
    s = priors.restrict(spans(spark, sf_dir), F.col("cell").isin(figure), len(figure))
    return priors.normalise(priors.accumulate(s, "book"), "book").select("book", "cell", settled(F.col("q"), 9).alias("q"))


F20 = BASE + f""", k as (select book, pos, cell, p, sum(p) over (partition by book, pos) t from sp where cell % 3 = 1),
rr as (select book, cell, sum(case when t > 0 then p/t else 1.0/9 end) mass from k group by 1, 2) select book, cell, round(q, 9) + 0.0 as q from ({_norm_sql('rr', 'book')})"""


def f21_sites(spark, sf_dir):
    """Mass by site, and its total, as a rollup of book and site."""
    sites = F.broadcast(cube.cells(spark).select(F.col("idx").alias("cell"), "site"))
    return spans(spark, sf_dir).join(sites, "cell").rollup("book", "site").agg(settled(F.sum("p")).alias("mass"))


F21 = BASE + f" select book, site, round(sum(p), 6) + 0.0 as mass from sp join (select idx, site from {cube.values_sql()}) c on sp.cell = c.idx group by rollup (book, site)"


def f22_exclude(spark, sf_dir):
    """Amplitudes with the cells of Ground grain set to 0 and the rest scaled up, each rounded for itself."""
    long = long_cells(spark, sf_dir)
    out = F.col("cell") % 3 == 0
    left = F.sum(F.when(out, 0).otherwise(F.col("amplitude_ppm"))).over(Window.partitionBy("vec_id"))
    share = F.floor(F.col("amplitude_ppm") / F.when(left > 0, left).otherwise(1) * PPM + 0.5).cast("long")
    return long.select("vec_id", "cell", F.when(out, 0).otherwise(F.col("similarity_ppm")).cast("long").alias("similarity_ppm"), F.when(out | (left <= 0), 0).otherwise(share).cast("long").alias("amplitude_ppm"))


F22 = BASE + """, e as (select *, sum(case when cell % 3 = 0 then 0 else amplitude_ppm end) over (partition by vec_id) lf from m)
select vec_id, cell, cast(case when cell % 3 = 0 then 0 else similarity_ppm end as bigint) as similarity_ppm, cast(case when cell % 3 = 0 or lf <= 0 then 0 else floor(amplitude_ppm/lf::double*1000000+0.5) end as bigint) as amplitude_ppm from e"""


def a29_exact_ppm(spark, sf_dir):
    return priors.exact_ppm(priors.normalise(priors.accumulate(spans(spark, sf_dir), "book"), "book"), "book").select("book", "cell", F.col("ppm").cast("long").alias("ppm"))


A29 = BASE + f""", q as ({_norm_sql('mass', 'book')}), f as (select book, cell, q*1000000 r, cast(floor(q*1000000) as bigint) f from q),
g as (select *, row_number() over (partition by book order by round(r - f, 9) desc, cell) rk, 1000000 - sum(f) over (partition by book) lf from f)
select book, cell, cast(f + case when rk <= lf then 1 else 0 end as bigint) as ppm from g"""


def j11_pairs(spark, sf_dir):
    return priors.correlations(priors.accumulate(spans(spark, sf_dir), "book"), "book").select("a", "b", settled(F.col("corr")).alias("corr"))


J11 = BASE + "," + CORR + " select a, b, round(corr, 6) + 0.0 as corr from corr"


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("book")).distinct().withColumn("label", (F.col("book") % 3).cast("int"))


def a11_gap(spark, sf_dir):
    standard = priors.standardised(priors.accumulate(spans(spark, sf_dir), "book"), "book")
    return priors.label_gaps(standard, _labels(spark, sf_dir), "book").select(settled(F.col("gap")).alias("gap"))


A11 = BASE + "," + CORR + " select round(coalesce(avg(corr) filter (a % 3 = b % 3), 0) - coalesce(avg(corr) filter (a % 3 <> b % 3), 0), 6) + 0.0 as gap from corr"


def a12_permutation(spark, sf_dir):
    standard = cut(priors.standardised(priors.accumulate(spans(spark, sf_dir), "book"), "book"))
    labels = _labels(spark, sf_dir)
    found = priors.permutation_p(priors.label_gaps(standard, labels, "book"), priors.label_gaps(standard, priors.shuffled_labels(labels, PERMUTATIONS), "book", "perm"), PERMUTATIONS)
    return found.select(settled(F.col("gap")).alias("gap"), F.col("at_least").cast("long").alias("at_least"), settled(F.col("p_value")).alias("p_value"))


A12 = BASE + "," + CORR + f""", lb as (select book, book % 3 label from books), pm as (select unnest(range(1, {PERMUTATIONS} + 1))::int perm),
seat as (select perm, book, row_number() over (partition by perm order by book) i from lb, pm),
deal as (select perm, label, row_number() over (partition by perm order by md5(concat(perm, ':', book)), book) i from lb, pm),
sh as (select seat.perm, book, label from seat join deal on seat.perm = deal.perm and seat.i = deal.i),
ob as (select coalesce(avg(corr) filter (a % 3 = b % 3), 0) - coalesce(avg(corr) filter (a % 3 <> b % 3), 0) gap from corr),
pg as (select x.perm, coalesce(avg(corr) filter (x.label = y.label), 0) - coalesce(avg(corr) filter (x.label <> y.label), 0) g from corr join sh x on x.book = a join sh y on y.book = b and x.perm = y.perm group by 1)
select round(gap, 6) + 0.0 as gap, cast(sum(case when g >= gap - 1e-12 then 1 else 0 end) as bigint) as at_least, round((sum(case when g >= gap - 1e-12 then 1 else 0 end) + 1)/{PERMUTATIONS + 1}.0::double, 6) + 0.0 as p_value from pg, ob group by gap"""

#: Cells that the structural channel fills without regard to the text; one channel leaves them out.
FILLED = ("EVA_Binding_Lens", "REC_Making_Lens")


def x11_channels(spark, sf_dir):
    """The gap between labels in three channels, under one set of permutations: all cells, those that structure doesn't fill, and structure alone (the
    strongest cell of each span)."""
    s = cut(spans(spark, sf_dir))
    left = [c[0] for c in cube.CELLS if c[1] not in FILLED]
    matched = priors.restrict(s, F.col("cell").isin(left), len(left))
    top = F.row_number().over(Window.partitionBy("book", "pos").orderBy(F.desc("p"), "cell"))
    strongest = s.withColumn("p", F.when(top == 1, 1.0).otherwise(0.0))
    named = [priors.accumulate(df, "book").withColumn("channel", F.lit(name)) for name, df in (("content", s), ("content, matched", matched), ("structure", strongest))]
    standard = cut(priors.standardised(named[0].unionByName(named[1]).unionByName(named[2]), "channel", "book"))
    labels = _labels(spark, sf_dir)
    dealt = priors.shuffled_labels(labels, PERMUTATIONS)
    found = priors.permutation_p(priors.label_gaps(standard, labels, "book", "channel"), priors.label_gaps(standard, dealt, "book", "channel", "perm"), PERMUTATIONS, "channel")
    return found.select("channel", settled(F.col("gap")).alias("gap"), F.col("at_least").cast("long").alias("at_least"), settled(F.col("p_value")).alias("p_value"))


X11 = BASE + f""", lf as (select book, pos, cell, p, sum(p) over (partition by book, pos) t from sp where cell not in ({", ".join(str(c[0]) for c in cube.CELLS if c[1] in FILLED)})),
ch as (select 'content' as channel, book, cell, mass from mass
  union all select 'content, matched', book, cell, sum(case when t > 0 then p / t else 1.0 / {27 - len(FILLED)} end) from lf group by book, cell
  union all select 'structure', book, cell, sum(case when r = 1 then 1.0 else 0.0 end)::double from (select book, cell, row_number() over (partition by book, pos order by p desc, cell) r from sp) group by book, cell),
pr as (select a.channel, a.book a, b.book b, count(*)::double n, sum(a.mass) sx, sum(b.mass) sy, sum(a.mass*a.mass) sxx, sum(b.mass*b.mass) syy, sum(a.mass*b.mass) sxy
  from ch a join ch b on a.channel = b.channel and a.cell = b.cell and a.book < b.book group by 1, 2, 3),
corr as (select channel, a, b, case when n < 2 or sxx - sx*sx/n <= 1e-15 or syy - sy*sy/n <= 1e-15 then 0.0 else (sxy - sx*sy/n)/sqrt((sxx - sx*sx/n)*(syy - sy*sy/n)) end corr from pr),
lb as (select book, book % 3 label from books), pm as (select unnest(range(1, {PERMUTATIONS} + 1))::int perm),
seat as (select perm, book, row_number() over (partition by perm order by book) i from lb, pm),
deal as (select perm, label, row_number() over (partition by perm order by md5(concat(perm, ':', book)), book) i from lb, pm),
sh as (select seat.perm, book, label from seat join deal on seat.perm = deal.perm and seat.i = deal.i),
ob as (select channel, coalesce(avg(corr) filter (a % 3 = b % 3), 0) - coalesce(avg(corr) filter (a % 3 <> b % 3), 0) gap from corr group by 1),
pg as (select channel, x.perm, coalesce(avg(corr) filter (x.label = y.label), 0) - coalesce(avg(corr) filter (x.label <> y.label), 0) g from corr join sh x on x.book = a join sh y on y.book = b and x.perm = y.perm group by 1, 2)
select ob.channel, round(gap, 6) + 0.0 as gap, cast(sum(case when g >= gap - 1e-12 then 1 else 0 end) as bigint) as at_least, round((sum(case when g >= gap - 1e-12 then 1 else 0 end) + 1)/{PERMUTATIONS + 1}.0::double, 6) + 0.0 as p_value from pg join ob on pg.channel = ob.channel group by ob.channel, gap"""

KS = (1, 3, 5, 10, 20, 0)


def t05_topk_prior(spark, sf_dir):
    """Mean surprise of each book under the prior of its k most similar others; k = 0: of all others."""
    s = spans(spark, sf_dir)
    mass = priors.accumulate(s, "book")
    near = priors.normalise(priors.nearest_prior(mass, priors.correlations(mass, "book"), "book", KS), "book", "k")
    bits = priors.surprise(s, near, ["book", "cell"], ("book", "pos", "k"))
    return bits.groupBy("book", "k").agg(settled(F.avg("bits")).alias("surprise"))


T05 = BASE + "," + CORR + f""", bo as (select a h, b o, corr from corr union all select b, a, corr from corr),
rk as (select h, o, row_number() over (partition by h order by round(corr, 9) desc, o) r, count(*) over (partition by h) n from bo),
ks as (select unnest([1, 3, 5, 10, 20, 0]) k),
nm as (select h as book, k, cell, sum(mass) mass from rk join mass on mass.book = rk.o cross join ks where r <= case when k = 0 then n else k end and (k = 0 or k <= n) group by 1, 2, 3),
q as ({_norm_sql('nm', 'book, k')})
select book, k, round(avg(bits), 6) + 0.0 as surprise from (select sp.book, k, pos, sum(case when p > 0 then -p*log2(q) else 0 end) bits from sp join q on sp.book = q.book and sp.cell = q.cell group by 1, 2, 3) group by 1, 2"""


def t06_halves(spark, sf_dir):
    """Books by their mean correlation with the others: the typical half and the outlying one."""
    pairs = priors.correlations(priors.accumulate(spans(spark, sf_dir), "book"), "book")
    both = pairs.select(F.col("a").alias("book"), "corr").unionByName(pairs.select(F.col("b").alias("book"), "corr"))
    mean = both.groupBy("book").agg(F.avg("corr").alias("c"))
    place, n = F.row_number().over(Window.orderBy(F.round("c", 9).desc(), "book")), F.count("*").over(Window.partitionBy(F.lit(0)))
    return mean.withColumns({"i": place, "n": n}).select("book", F.when(F.col("i") <= F.floor(F.col("n") / 2), "typical").otherwise("outlier").alias("half"))


T06 = BASE + "," + CORR + """, mc as (select book, avg(corr) c from (select a book, corr from corr union all select b, corr from corr) group by 1)
select book, case when row_number() over (order by round(c, 9) desc, book) <= floor(count(*) over () / 2) then 'typical' else 'outlier' end as half from mc"""


def w01_expanding(spark, sf_dir):
    seen = priors.expanding(spans(spark, sf_dir))
    return seen.select("book", "pos", "cell", settled(F.col("seen")).alias("seen"))


W01 = BASE + " select book, cast(pos as int) as pos, cell, round(coalesce(sum(p) over (partition by book, cell order by pos rows between unbounded preceding and 1 preceding), 0), 6) + 0.0 as seen from sp"

ALPHAS = (3.0, 10.0, 30.0)


def w02_blend(spark, sf_dir):
    """Early and late thirds of each book of 6 spans or more: surprise under local counts blended with the prior of other books."""
    s = spans(spark, sf_dir)
    prior = priors.normalise(priors.leave_one_out(priors.accumulate(s, "book"), "book"), "book", out="prior")
    seen = priors.expanding(s).join(prior.select("book", "cell", "prior"), ["book", "cell"])
    q = priors.blend(seen.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in ALPHAS]))), F.col("alpha"))
    bits = q.groupBy("book", "pos", "alpha").agg(F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log2("q")).otherwise(0.0)).alias("bits"))
    n = F.count("*").over(Window.partitionBy("book", "alpha"))
    third = F.floor(F.col("n") / 3)
    part = F.when(F.col("pos") < third, "early").when(F.col("pos") >= F.col("n") - third, "late")
    return bits.withColumn("n", n).filter("n >= 6").withColumn("part", part).filter("part is not null").groupBy("book", "alpha", "part").agg(settled(F.avg("bits")).alias("bits"))


W02 = BASE + f""", lo as (select book, cell, sum(mass) over (partition by cell) - mass as mass from mass), pr as ({_norm_sql('lo', 'book')}),
sn as (select book, pos, cell, p, coalesce(sum(p) over (partition by book, cell order by pos rows between unbounded preceding and 1 preceding), 0) seen from sp),
sa as (select *, sum(seen) over (partition by book, pos) sall from sn), al as (select unnest([3.0, 10.0, 30.0])::double alpha),
bt as (select sa.book, pos, alpha, sum(case when p > 0 then -p*log2((seen + alpha*q)/(sall + alpha)) else 0 end) bits from sa join pr on sa.book = pr.book and sa.cell = pr.cell cross join al group by 1, 2, 3),
bn as (select *, count(*) over (partition by book, alpha) n from bt)
select book, alpha, case when pos < floor(n/3) then 'early' else 'late' end as part, round(avg(bits), 6) + 0.0 as bits from bn where n >= 6 and (pos < floor(n/3) or pos >= n - floor(n/3)) group by 1, 2, 3"""


def w07_slices(spark, sf_dir):
    """Each book cut in 14 even slices: mass of the cell that leads each."""
    s = spans(spark, sf_dir)
    n = s.groupBy("book").agg((F.max("pos") + 1).alias("n"))
    cut = s.join(F.broadcast(n), "book").withColumn("slice", F.floor(F.col("pos") / F.ceil(F.col("n") / 14)).cast("int"))
    mass = cut.groupBy("book", "slice", "cell").agg(F.round(F.sum("p"), 9).alias("mass"))
    return mass.groupBy("book", "slice").agg(F.max_by("cell", F.struct("mass", -F.col("cell"))).alias("cell"), settled(F.max("mass")).alias("mass"))


W07 = BASE + """, sl as (select sp.book, cast(floor(pos / ceil(n_spans/14.0)) as int) slice, cell, round(sum(p), 9) mass from sp join books on sp.book = books.book group by 1, 2, 3)
select book, slice, cell, round(mass, 6) + 0.0 as mass from (select *, row_number() over (partition by book, slice order by mass desc, cell) r from sl) where r = 1"""


def a17_metaphor(spark, sf_dir):
    """Three kinds of books (label modulo 3): mean surprise of each kind's spans under each kind's prior, its own without the span's book."""
    s = spans(spark, sf_dir).withColumn("kind", (F.col("book") % 3).cast("int"))
    mass = priors.accumulate(s, "kind")
    own = priors.accumulate(s, "kind", "book").withColumnRenamed("mass", "own")
    books = s.select("kind", "book").distinct().withColumnRenamed("kind", "source")
    given = books.crossJoin(F.broadcast(mass.withColumnRenamed("kind", "prior")))  # kinds by cells: a fixed, small table
    left = given.join(own.withColumnRenamed("kind", "prior"), ["prior", "book", "cell"], "left").withColumn("mass", F.greatest(F.lit(0.0), F.col("mass") - F.coalesce("own", F.lit(0.0))))
    q = priors.normalise(left.select("source", "book", "prior", "cell", "mass"), "source", "book", "prior")
    bits = priors.surprise(s, q.select("book", "cell", "prior", "q", "source"), ["book", "cell"], ("book", "pos", "source", "prior"))
    return bits.groupBy("source", "prior").agg(settled(F.avg("bits")).alias("surprise"))


A17 = BASE + f""", ks as (select *, cast(book % 3 as int) kind from sp), km as (select kind, cell, sum(p) mass from ks group by 1, 2),
gv as (select b.book, cast(b.book % 3 as int) source, km.kind prior, km.cell, greatest(0.0, km.mass - case when km.kind = b.book % 3 then o.mass else 0 end) mass from books b cross join km join mass o on o.book = b.book and o.cell = km.cell),
q as ({_norm_sql('gv', 'book, source, prior')})
select source, prior, round(avg(bits), 6) + 0.0 as surprise from (select q.source, q.prior, sp.book, sp.pos, sum(case when p > 0 then -p*log2(q) else 0 end) bits from sp join q on sp.book = q.book and sp.cell = q.cell group by 1, 2, 3, 4) group by 1, 2"""


def a18_cell_kl(spark, sf_dir):
    """Each book's three cells with the largest terms of its divergence from the others' prior."""
    mass = priors.accumulate(spans(spark, sf_dir), "book")
    p = priors.normalise(mass, "book", out="p").select("book", "cell", "p")
    q = priors.normalise(priors.leave_one_out(mass, "book"), "book")
    term = p.join(q.select("book", "cell", "q"), ["book", "cell"]).withColumn("kl", F.round(F.col("p") * F.log2(F.col("p") / F.col("q")), 9))
    return term.withColumn("rank", F.row_number().over(Window.partitionBy("book").orderBy(F.abs("kl").desc(), "cell"))).filter("rank <= 3").select("book", "rank", "cell", settled(F.col("kl")).alias("kl"))


A18 = BASE + f""", lo as (select book, cell, sum(mass) over (partition by cell) - mass as mass from mass), pp as ({_norm_sql('mass', 'book')}), qq as ({_norm_sql('lo', 'book')}),
tm as (select pp.book, pp.cell, round(pp.q*log2(pp.q/qq.q), 9) kl from pp join qq on pp.book = qq.book and pp.cell = qq.cell)
select book, cast(r as int) as rank, cell, round(kl, 6) + 0.0 as kl from (select *, row_number() over (partition by book order by abs(kl) desc, cell) r from tm) where r <= 3"""


def a19_coverage(spark, sf_dir):
    """Cells covered by each label's vectors, and the least of the cells' best amplitudes."""
    best = long_cells(spark, sf_dir).groupBy("label", "cell").agg(F.max("amplitude_ppm").alias("best"))
    return best.groupBy("label").agg(F.count_if(F.col("best") > 0).alias("cells_covered"), F.min("best").alias("min_cell_confidence_ppm"))


A19 = BASE + " select label, count(*) filter (best > 0) as cells_covered, min(best) as min_cell_confidence_ppm from (select label, cell, max(amplitude_ppm) best from m group by 1, 2) group by 1"


def a14_presence(spark, sf_dir):
    """Spans in which each act is present, and its share of the mass."""
    acts = F.broadcast(cube.cells(spark).select(F.col("idx").alias("cell"), "act"))
    by_act = long_cells(spark, sf_dir).join(acts, "cell").groupBy("vec_id", "act").agg(F.sum("amplitude_ppm").alias("a"))
    total = F.sum(F.sum("a")).over(Window.partitionBy(F.lit(0)))
    return by_act.groupBy("act").agg(F.count_if(F.col("a") > 0).alias("n_spans"), F.round(100.0 * F.sum("a") / total, 1).alias("percent"))


A14 = BASE + f", b as (select vec_id, act, sum(amplitude_ppm) a from m join (select idx, act from {cube.values_sql()}) c on m.cell = c.idx group by 1, 2) select act, count(*) filter (a > 0) as n_spans, round(100.0::double*sum(a)/sum(sum(a)) over (), 1) as percent from b group by 1"


QUERIES = {
    "f04_cosine": (f04_cosine, F04),
    "f07_ppm": (f07_ppm, F07),
    "f09_diagnostics": (f09_diagnostics, F09),
    "p10_gate": (p10_gate, P10),
    "a03_prototype": (a03_prototype, A03),
    "a04_gain": (a04_gain, A04),
    "f15_bhattacharyya": (f15_bhattacharyya, F15),
    "f17_regrain": (f17_regrain, F17),
    "g05_holdout": (g05_holdout, G05),
    "a06_normalise": (a06_normalise, A06),
    "a07_cross_entropy": (a07_cross_entropy, A07),
    "a13_kfold": (a13_kfold, A13),
    "f20_restrict": (f20_restrict, F20),
    "f21_sites": (f21_sites, F21),
    "f22_exclude": (f22_exclude, F22),
    "a29_exact_ppm": (a29_exact_ppm, A29),
    "j11_pairs": (j11_pairs, J11),
    "a11_gap": (a11_gap, A11),
    "a12_permutation": (a12_permutation, A12),
    "x11_channels": (x11_channels, X11),
    "t05_topk_prior": (t05_topk_prior, T05),
    "t06_halves": (t06_halves, T06),
    "w01_expanding": (w01_expanding, W01),
    "w02_blend": (w02_blend, W02),
    "w07_slices": (w07_slices, W07),
    "a17_metaphor": (a17_metaphor, A17),
    "a18_cell_kl": (a18_cell_kl, A18),
    "a19_coverage": (a19_coverage, A19),
    "a14_presence": (a14_presence, A14),
}
