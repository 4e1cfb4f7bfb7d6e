"""Queries on what a corpus teaches about its own language."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import conventions, corpora, literacy
from tallyloom.session import table
from tallyloom.sources.scratch import cut


def _dialogue(spark, sf_dir):
    """All documents; what stands behind a comma is spoken up to it."""
    return table(spark, sf_dir, "documents").select(F.regexp_replace("text", ", ", ",” ").alias("text"))


# The words of the sentences with their neighbours (x), their sums (p), the anchors (top, n, sp), the frames (fr) and both (b).
_WORDS = r"""
s as (select unnest(string_split(regexp_replace(regexp_replace(regexp_replace(text, ', ', ',” ', 'g'), '([.!?])[\t-\r\p{Z}\x{FEFF}]+', '\1⏹', 'g'), '\n{2,}', '⏹', 'g'), '⏹')) s from documents),
h as (select row_number() over () id, regexp_extract_all(s, '([\p{L}''’]+)([^\p{L}''’]*)', 1) w, [regexp_extract(s, '^[^\p{L}''’]*')] || regexp_extract_all(s, '([\p{L}''’]+)([^\p{L}''’]*)', 2) gap from s),
e as (select id, unnest(w) word, generate_subscripts(w, 1) i, w, gap from h),
x as (select word, lower(word) token, w[i - 1] prev, w[i + 1] nxt, i - 1 place, gap[i] before, case when i > 1 then gap[i - 1] end before_prev, gap[i + 1] after from (select id, word, i, w, gap from e)),
y as (select *, regexp_matches(word, '^\p{Lu}') cap, coalesce(regexp_matches(prev, '^\p{Lu}'), false) cap_prev, coalesce(regexp_matches(nxt, '^\p{Lu}'), false) cap_next from x),
p as materialized (select token, count(*) n, count(*) filter (cap) n_cap, count(*) filter (not cap) n_low, count(*) filter (cap and place = 0) n_start,
  count(*) filter (nxt is null or regexp_matches(after, '[^\t-\r\p{Z}\x{FEFF}]') or regexp_matches(nxt, '^[''’]')) n_final, count(*) filter (after like '.%') n_dot from y group by 1),
n as (select sum(n) words from p),
top as materialized (select token, row_number() over (order by n desc, token) r from p order by r limit 60),
sp as materialized (select token from p, n where p.n / words > 0.003)"""
_FRAMES = r"""
z as (select *, coalesce(lower(nxt) in (select token from top where r <= 3), false) and prev is not null as article,
  coalesce(regexp_matches(right(before, 3), '[,.!?;:—-][\t-\r\p{Z}\x{FEFF}]*["“”«»][\t-\r\p{Z}\x{FEFF}]*$'), false) as closed,
  coalesce(regexp_matches(right(before_prev, 3), '[,.!?;:—-][\t-\r\p{Z}\x{FEFF}]*["“”«»][\t-\r\p{Z}\x{FEFF}]*$'), false) as closed_prev from y),
fr as materialized (select z.token, count(*) filter (article and cap_prev and (place = 1 or q.n_low < q.n_cap)) n_copula, count(*) filter (article or cap_next) n_nominal,
  count(*) filter (length(nxt) > 4 and lower(nxt) like '%ing') n_ing, count(*) filter (cap_prev) n_prev_cap, count(*) filter (lower(prev) = (select token from top where r = 1)) n_noun,
  count(*) filter (closed and (cap_next or lower(nxt) in (select token from sp))) + count(*) filter (closed_prev and (cap_prev or lower(prev) in (select token from sp))) n_speech
  from z left join p q on q.token = lower(z.prev) group by 1)"""


def a22_profile(spark, sf_dir):
    """Every word of the documents: its uses, capitals, small letters, openings, ends and full stops."""
    return literacy.profile(literacy.sentence_words(_dialogue(spark, sf_dir), "text"))


A22P = f"with {_WORDS} select token, n, n_cap, n_low, n_start, n_final, n_dot from p"


def a23_frames(spark, sf_dir):
    """Every word of the documents: how often it stands in each frame around the most frequent words."""
    words = literacy.sentence_words(_dialogue(spark, sf_dir), "text")
    counts = cut(literacy.profile(words))
    top, speakers, _ = literacy.anchors(counts)
    return literacy.frame_counts(words, counts, top, speakers)


A23 = f"with {_WORDS}, {_FRAMES} select token, n_copula, n_nominal, n_ing, n_prev_cap, n_noun, n_speech from fr"


def k12_literacy(spark, sf_dir):
    """The seven registers that the documents teach."""
    return literacy.induce_literacy(_dialogue(spark, sf_dir), "text")


_REGISTERS = r"""
b as (select p.*, fr.* exclude (token), n_cap / n as capr, n_final / n as finr, coalesce(top.r, 99) as r from p join fr on p.token = fr.token left join top on p.token = top.token),
prep as (select token, n as weight from b where n >= 20 and length(token) <= 5 and capr <= 0.4 and finr <= 0.05 and n_nominal / n >= 0.25 and n_prev_cap / n <= 0.2),
li as (select * from b where n_copula > 0 and r > 8 and token not in (select token from prep) and capr < 0.4),
cop as (select token, n_copula as weight from li where n_copula >= 8 and finr < 0.3 and n_ing >= 3 order by n_copula desc, token limit 12),
spe as (select token, n_speech as weight from b where n_speech >= 3 and capr < 0.35 and r = 99 and n_noun = 0 order by n_speech desc, token limit 40),
ly as (select token, n, token[:-3] as stem from b where token like '%ly' and length(token) > 4),
der as (select token, n as weight from ly where n >= 2 and (select count(*) from ly where stem in (select token from p)) >= 5
  and (stem in (select token from p) or stem || 'e' in (select token from p) or (stem like '%i' and stem[:-2] || 'y' in (select token from p)))),
mod as (select token, max(weight) as weight from (select * from der union all select token, n_copula from li where n_copula >= 4 and token not in (select token from cop)) group by 1),
fc as (select token, n, r from b, n where b.n >= 5 and capr < 0.35 and b.n / words > 0.0002
  and token not in (select token from cop union all select token from spe union all select token from mod)),
fam as (select distinct token from (select token, unnest([token || 's', token || 'ed', token || 'ing', case when token like '%e' then token[:-2] || 'ing' end, case when token like '%ed' then token[:-3] end,
  case when token like '%ed' then token[:-2] end, case when token like '%ing' then token[:-4] end, case when token like '%ing' then token[:-4] || 'e' end]) f from fc where r > 20) where f in (select token from p))
select 'function' as register, token, n::bigint as weight from fc where token not in (select token from fam)
union all select 'starter', token, n_start from b where n_start >= 3 and n_low >= 2 * (n_cap - n_start) and n_low >= n_start
union all select 'preposition', token, weight from prep union all select 'copula', token, weight from cop union all select 'attribution-verb', token, weight from spe
union all select 'abbreviation', token, n_dot from b where n_dot >= 3 and length(token) <= 6 and n_dot / n >= 0.8 and (capr >= 0.8 or not regexp_matches(token, '[aeiouy]'))
union all select 'modifier', token, weight from mod"""
K12 = f"with {_WORDS}, {_FRAMES}, {_REGISTERS}"



def k02_sediment(spark, sf_dir):
    """What every word of the documents is to a reader with the seeds, and to one whose registers the documents taught."""
    uses = literacy.sentence_words(_dialogue(spark, sf_dir), "text")
    counts = cut(literacy.profile(uses))
    seeds = conventions.seed(spark, corpora.REGISTERS)
    learned = conventions.sediment(literacy.literacy_of(uses, counts), "documents")
    words = counts.select("token")
    before, after = conventions.all_answers(words, seeds), conventions.all_answers(words, conventions.overlay(seeds, learned))
    met = before.withColumn("before", F.lit(True)).join(after.withColumn("after", F.lit(True)), ["question", "token"], "full")
    return met.select("question", "token", F.coalesce("before", F.lit(False)).alias("before"), F.coalesce("after", F.lit(False)).alias("after"))


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join("('%s', '%s')" % row for row in rows)


K02 = rf"""
with learned as ({K12}),
seeds(kind, token) as (values {_values([(k, t) for k, ts in corpora.REGISTERS.items() for t in dict.fromkeys(ts)])}),
asks(question, kind) as (values {_values([(q, k) for q, ks in conventions.QUESTIONS.items() for k in ks])}),
{_WORDS},
words as (select distinct regexp_replace(token, '\.$', '') token from p),
new as (select register as kind, token from learned where register in (select kind from seeds) union select * from seeds where kind not in (select register from learned)),
a as (select distinct question, w.token from words w join seeds e on w.token = e.token join asks q on q.kind = e.kind),
b as (select distinct question, w.token from words w join new e on w.token = e.token join asks q on q.kind = e.kind)
select coalesce(a.question, b.question) as question, coalesce(a.token, b.token) as token, a.token is not null as before, b.token is not null as after
from a full join b on a.question = b.question and a.token = b.token"""


def f44_irregular(spark, sf_dir):
    """Which words of the documents have an irregular past, and which are one; the pairs are words of the same beginning that differ in one vowel."""
    words = cut(literacy.profile(literacy.sentence_words(_dialogue(spark, sf_dir), "text")).select("token"))
    swapped = words.filter(F.col("token").rlike("^[a-z]*i[a-z]*$")).select(F.col("token").alias("base"), F.replace("token", F.lit("i"), F.lit("a")).alias("past"))
    pairs = swapped.join(words.select(F.col("token").alias("past")), "past", "left_semi")
    return conventions.irregular_past(words, pairs).filter("past is not null or is_past")


F44 = rf"""with {_WORDS},
w as (select distinct regexp_replace(token, '\.$', '') token from p),
i as (select token base, replace(token, 'i', 'a') past from p where regexp_matches(token, '^[a-z]*i[a-z]*$') and replace(token, 'i', 'a') in (select token from p))
select p.token, (select min(past) from i where base = p.token) as past, p.token in (select past from i) as is_past from p where p.token in (select base from i union select past from i)"""

QUERIES = {
    "a22_profile": (a22_profile, A22P),
    "a23_frames": (a23_frames, A23),
    "k12_literacy": (k12_literacy, K12),
    "k02_sediment": (k02_sediment, K02),
    "f44_irregular": (f44_irregular, F44),
}
