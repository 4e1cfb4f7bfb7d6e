"""Queries over documents, pages and conversations: segments, markup, company of words, catalogues and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as rules
from tallyloom.operators import company, corpora
from tallyloom.session import table
from tallyloom.sources import ledger_io
from tallyloom.sources.scratch import cut


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def f25_sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(rules.sentences(F.col("text"))).alias("pos", "sentence"))


F25 = r"""
with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]["''’”)\]]*)(\s+)([A-Z0-9])', '\1⏹\3', 'g'), '⏹'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') a from documents)
select doc_id, cast(unnest(generate_series(0, len(a) - 1)) as int) as pos, unnest(a) as sentence from s"""


def f26_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(rules.lines(F.col("text"))).alias("pos", "line"))


F26 = r"""
with s as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') a from documents)
select doc_id, cast(unnest(generate_series(0, len(a) - 1)) as int) as pos, unnest(a) as line from s"""


def f24_paragraphs(spark, sf_dir):
    """Conversations as texts of paragraphs, one a turn."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    joined = turns.select("conv_id", F.array_join(F.transform("t", lambda x: x.text), "\n\n").alias("text"))
    return joined.select("conv_id", F.posexplode(rules.paragraphs(F.col("text"))).alias("pos", "paragraph"))


F24 = r"""
with t as (select conv_id, string_agg(text, chr(10) || chr(10) order by turn, text) text from conversations group by 1),
s as (select conv_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') a from t)
select conv_id, cast(unnest(generate_series(0, len(a) - 1)) as int) as pos, unnest(a) as paragraph from s"""


def w04_offsets(spark, sf_dir):
    """Sentences of benchmark items and where they start and end."""
    return rules.spans(table(spark, sf_dir, "benchmark"), "text", "sentence", "item_id")


W04 = r"""
with p as (select item_id, string_split(regexp_replace(text, '([.!?]["''’”)\]]*\s+)([A-Z0-9])', '\1⏹\2', 'g'), '⏹') a from benchmark),
u as (select item_id, generate_subscripts(a, 1) i, unnest(a) p from p),
v as (select *, sum(length(p)) over (partition by item_id order by i) - length(p) o from u),
w as (select item_id, i, o + length(p) - length(regexp_replace(p, '^\s+', '')) s, regexp_replace(p, '^\s+|\s+$', '', 'g') t from v)
select item_id, (row_number() over (partition by item_id order by i) - 1)::int as position, s::int as start, (s + length(t))::int as "end", t as text from w where t <> ''"""


def f29_verses(spark, sf_dir):
    """Each page as if it were one verse."""
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(rules.verse_text(F.col("html")), 256).alias("text_sha256"))


F29 = r"""select page_id, sha256(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<sup class="footnote-marker">.*?</sup>', '', 'g'), '<i class="footnote">.*?</i>', '', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) as text_sha256 from pages"""


def f30_html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", rules.html_text(F.col("html")).alias("text"))


F30 = r"""
with a as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head[^>]*>.*?</head>', '', 'g'), '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g') h from pages),
b as (select page_id, replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"') t from a)
select page_id, coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(t, '\r\n|\n|\r'), lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)), '') as text from b"""


def f49_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(rules.links(F.col("html"))).alias("link"))


F49 = r"""select page_id, link from (select distinct page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) link from pages) where not regexp_matches(link, '^(http:|https:|mailto:|#)') and not regexp_matches(link, '\.(css|ico)$')"""


def f23_strip_frame(spark, sf_dir):
    """Documents in a book's frame, every fifth without its end line."""
    framed = F.concat(F.lit("Title\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n"), "text", F.when(F.col("doc_id") % 5 == 0, "").otherwise("\n*** END OF THIS PROJECT GUTENBERG EBOOK X ***\nLicence"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(rules.strip_frame(framed), 256).alias("sha256"))


F23 = r"select doc_id, sha256(case when doc_id % 5 = 0 then 'Title' || chr(10) || '*** START OF THE PROJECT GUTENBERG EBOOK X ***' || chr(10) || text else text || chr(10) end) as sha256 from documents"


def a20_counts(spark, sf_dir):
    words = rules.word_count(F.col("text")).cast("long")
    return _docs(spark, sf_dir).select("doc_id", words.alias("words"), F.length("text").cast("long").alias("chars"), rules.pages(words).alias("pages"))


A20 = r"with w as (select doc_id, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::bigint n from documents) select doc_id, n as words, length(text)::bigint as chars, greatest(1, n // 300)::bigint as pages from w"


def _catalogue(spark, sf_dir):
    """Documents as a catalogue: subject, language, type and number."""
    subject = F.concat("lang", F.when(F.col("doc_id") % 3 == 0, F.lit(" -- ")).otherwise(F.lit(", ")), "source")
    return _docs(spark, sf_dir).select(F.concat(F.when(F.col("doc_id") % 9 == 0, F.lit("x")).otherwise(F.lit("")), F.col("doc_id").cast("string")).alias("id"), "lang", "source", subject.alias("subjects"), F.length("text").alias("chars"))


_CAT = "c as (select case when doc_id % 9 = 0 then 'x' else '' end || doc_id id, lang, source, case when doc_id % 3 = 0 then lang || ' -- ' || source else lang || ', ' || source end subjects, length(text) chars from documents)"


def p13_catalogue(spark, sf_dir):
    """English entries with a number, by their first subject and source."""
    kept = _catalogue(spark, sf_dir).filter((F.col("lang") == "en") & F.col("id").rlike("^[0-9]+$"))
    return kept.groupBy(rules.subject_key(F.col("subjects")).alias("subject_key"), "source").agg(F.count("*").alias("n"))


P13 = f"with {_CAT} select 'en' as subject_key, source, count(*) as n from c where lang = 'en' and regexp_matches(id, '^[0-9]+$') group by 2"


def t10_stratified(spark, sf_dir):
    """200 documents, one source after another, within a source in the order of a hash."""
    d = _docs(spark, sf_dir).select("doc_id", "source", F.md5(F.col("doc_id").cast("string")).alias("h"))
    turn = d.withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy("h", "doc_id")))
    return turn.orderBy("turn", F.md5("source"), "source").limit(200).select("doc_id", "source", F.col("turn").cast("long").alias("turn"))


T10 = "select doc_id, source, r as turn from (select doc_id, source, row_number() over (partition by source order by md5(doc_id::varchar), doc_id) r from documents) order by r, md5(source), source limit 200"


def t11_budget(spark, sf_dir):
    """Each source's documents by id until 40 pages are reached; the one that crosses the mark stays."""
    d = a20_counts(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    before = F.sum("pages").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumn("before", F.coalesce(before, F.lit(0))).filter("before < 40").select("source", "doc_id", "pages")


T11 = r"""with w as (select doc_id, source, greatest(1, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) // 300)::bigint pages from documents),
b as (select *, coalesce(sum(pages) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) before from w)
select source, doc_id, pages from b where before < 40"""


def p14_every_kth(spark, sf_dir):
    """Lines of each document of more than 3 lines: from the fourth on, every k-th, so that at most 5 are taken."""
    ln = f26_lines(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("doc_id"))
    step = F.greatest(F.lit(1), F.floor((F.col("n") - 3) / 5)).cast("int")
    return ln.withColumn("n", n).filter("pos >= 3").withColumn("i", F.col("pos") - 3).filter((F.pmod("i", step) == 0) & (F.col("i") / step < 5)).select("doc_id", "pos")


P14 = r"""
with s as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') a from documents),
l as (select doc_id, len(a) n, cast(unnest(generate_series(0, len(a) - 1)) as int) pos from s),
k as (select *, pos - 3 i, greatest(1, (n - 3) // 5) step from l where pos >= 3)
select doc_id, pos from k where i % step = 0 and i / step < 5"""


def s10_consolidate(spark, sf_dir):
    """Documents of 200 characters or more outside two collections, with flat names."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("\\"), F.col("doc_id").cast("string"), F.lit(".txt"))
    kept = _docs(spark, sf_dir).filter((F.length("text") >= 200) & ~F.col("source").isin("src3", "src7"))
    return kept.select(rules.flat_name(path).alias("name"), F.length("text").cast("long").alias("chars"))


S10 = r"select regexp_replace(source || '/' || lang || '\' || doc_id || '.txt', '[\\/]', '__', 'g') as name, length(text)::bigint as chars from documents where length(text) >= 200 and source not in ('src3', 'src7')"


def s11_flatten(spark, sf_dir):
    """The lines of each document as JSON, once in an array and once as many deep in arrays as the id's last digit says, out and in order again."""
    lines = F.to_json(F.split("text", "\n"))
    deep = (F.col("doc_id") % 10).cast("int")
    wrapped = F.concat(F.lit("["), lines, F.lit(","), F.repeat(F.lit("["), deep), lines, F.repeat(F.lit("]"), deep), F.lit("]"))
    found = ledger_io.joined_strings(_docs(spark, sf_dir).select("doc_id", wrapped.alias("j")), "doc_id", "j")
    return found.select("doc_id", F.size(F.split("text", "\n")).alias("n"), F.sha2("text", 256).alias("sha256"))


S11 = r"""
with t as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') a from documents)
select doc_id, (2 * len(a))::int as n, sha256(array_to_string(a || a, chr(10))) as sha256 from t where len(a) > 0"""


def s13_codons(spark, sf_dir):
    """Documents as FASTA: all but the letters a, c, g and t is dropped first; counted by codon for the three frames."""
    fasta = F.concat(F.lit(">seq\n"), F.regexp_replace(F.lower("text"), "[^acgt]", ""))
    rows = [_docs(spark, sf_dir).select(F.lit(f).alias("frame"), F.explode(rules.codons(fasta, f)).alias("codon")) for f in (0, 1, 2)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("frame", "codon").agg(F.count("*").alias("n"))


S13 = r"""with q as (select upper(regexp_replace(lower(text), '[^acgt]', '', 'g')) s from documents), f as (select unnest([0, 1, 2]) frame),
c as (select frame, unnest(regexp_extract_all(substr(s, frame + 1), '(...)', 1)) codon from q, f)
select frame, codon, count(*) as n from c group by 1, 2"""


def f33_reader_major(spark, sf_dir):
    """Reader versions made from sources; the compatible ones with reader4."""
    v = F.concat(F.when(F.col("doc_id") % 4 == 0, F.lit("Reader")).otherwise(F.lit("reader")), (F.col("doc_id") % 6).cast("string"), F.when(F.col("doc_id") % 5 == 0, F.lit("x")).otherwise(F.lit(".2@1")))
    major = rules.reader_major(v)
    return _docs(spark, sf_dir).select("doc_id", major.alias("major"), F.coalesce(major == "reader4", F.lit(False)).alias("compatible"))


F33 = "select doc_id, case when doc_id % 5 = 0 then null else 'reader' || (doc_id % 6) end as major, doc_id % 5 <> 0 and doc_id % 6 = 4 as compatible from documents"


def f47_small_rules(spark, sf_dir):
    """The small normal forms side by side."""
    d = _docs(spark, sf_dir)
    return d.select("doc_id", rules.actor_slug(F.col("text")).alias("slug"), rules.norm_token(F.col("text")).alias("token"), rules.array_path(F.concat(F.lit("a["), "doc_id", F.lit("].b[0].c"))).alias("path"))


F47 = r"""with s as (select doc_id, text, regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', '-', 'g') g from documents)
select doc_id, case when g = '' then 'anonymous' else g end as slug, regexp_replace(lower(text), '\.$', '') as token, 'a[].b[].c' as path from s"""


def a22_token_frequency(spark, sf_dir):
    """Every word: how often used, capitalised, in small letters, and before a full stop."""
    w = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+\.?)"), 1)).alias("w"))
    token = F.lower(F.regexp_replace("w", r"\.$", ""))
    found = w.groupBy(token.alias("token")).agg(F.count("*").alias("n"), F.count_if(F.col("w").rlike(r"^\p{Lu}")).alias("n_cap"), F.count_if(F.col("w").rlike(r"^\p{Ll}")).alias("n_lower"), F.count_if(F.col("w").endswith(".")).alias("n_dot"))
    return found


A22 = r"with w as (select unnest(regexp_extract_all(text, '(\p{L}+\.?)', 1)) w from documents) select lower(regexp_replace(w, '\.$', '')) as token, count(*) as n, count(*) filter (regexp_matches(w, '^\p{Lu}')) as n_cap, count(*) filter (regexp_matches(w, '^\p{Ll}')) as n_lower, count(*) filter (w like '%.') as n_dot from w group by 1"


def _speech(spark, sf_dir):
    """Documents with quotes put in: after every comma, and around what follows a full stop."""
    t = F.regexp_replace(F.regexp_replace("text", ", ", ', "'), r"\. ([A-Z])", '." $1')
    return _docs(spark, sf_dir).select(t.alias("t"))


def a24_speech_verbs(spark, sf_dir):
    return company.speech_verbs(_speech(spark, sf_dir), "t")


A24 = r"""
with s as (select regexp_replace(regexp_replace(text, ', ', ', "', 'g'), '\. ([A-Z])', '." \1', 'g') t from documents),
w as (select unnest(list_concat(regexp_extract_all(t, '\b([a-z]{2,})\s*[,:]?\s*["“”]', 1), regexp_extract_all(t, '["“”]\s*,?\s*([a-z]{2,})\s+(?:[A-Z][a-z]+|he|she|they|the)\b', 1))) token from s where regexp_matches(t, '["“”]'))
select token, count(*) as count from w where (regexp_matches(token, '(ed|s|t)$') or token in ('say','ask','cry','tell','add','go','reply'))
  and token not in ('the','and','but','that','with','for','his','her','their','this','then','when','while','because','about','into','from') group by 1"""


def a25_frames(spark, sf_dir):
    """Verbs of speech, markers, report verbs and source nouns of all documents, each learned from the one before; quotes are put in for the first."""
    quoted = F.regexp_replace(F.regexp_replace("text", ", ", ', "'), r"\. ([A-Z])", '." $1')
    return company.attribution_frames(_docs(spark, sf_dir).select("text", quoted.alias("quoted")), "text", "quoted")


_DET = "('the','a','an','this','that','these','those','his','her','its','their','our','my','your','one','another','some','any','each','every','no')"
A25 = rf"""
with sv as ({A24}),
t as (select doc_id, regexp_extract_all(lower(text), '([a-z][a-z''’-]*)', 1) a from documents),
u as (select doc_id, unnest(generate_series(1, len(a))) i, unnest(a) w from t),
x as (select *, lead(w) over q nx, lag(w, 1) over q b1, lag(w, 2) over q b2, lag(w, 3) over q b3, lag(w, 4) over q b4 from u window q as (partition by doc_id order by i)),
mk as (select nx token, count(*) c from x where w in (select token from sv) and length(nx) <= 5 group by 1 having count(*) >= 2),
mm as (select * from mk union all select 'that', 0 where not exists (from mk)),
m as (select * from x where nx in (select token from mm) and b1 is not null),
v as (select w token, count(*) c from m where length(w) >= 3 and w not in (select token from mm) and b1 not in {_DET} group by 1),
n as (select b1 token, count(*) c from m where w in (select token from v union all select token from sv) and length(b1) >= 3 and b1 not in {_DET} and (coalesce(b2 in {_DET}, false) or coalesce(b3 in {_DET}, false) or coalesce(b4 in {_DET}, false)) group by 1)
select 'attribution-verb' as register, token, count from sv union all select 'marker', token, c from mm union all select 'report-verb', token, c from v union all select 'source-noun', token, c from n"""


def a26_calendar(spark, sf_dir):
    """Documents in which every third capitalised word got a year behind it."""
    t = F.regexp_replace("text", r"([A-Z][a-z]+) ([a-z]+)", "$1 1999 $2")
    return company.calendar_tokens(_docs(spark, sf_dir).select(t.alias("t")), "t")


A26 = r"""
with s as (select regexp_replace(text, '([A-Z][a-z]+) ([a-z]+)', '\1 1999 \2', 'g') t from documents),
n as (select lower(regexp_replace(w, '\.$', '')) token, count(*) n from (select unnest(regexp_extract_all(t, '(\p{Lu}\p{Ll}*\.?)', 1)) w from s) group by 1),
d as (select lower(regexp_replace(w, '\.$', '')) token, count(*) c from (select unnest(regexp_extract_all(t, '(\p{Lu}\p{Ll}*\.?)\s+(?:\d{1,2}(?:st|nd|rd|th)?,?\s+)?(?:1[5-9]|20)\d{2}\b', 1)) w from s) group by 1)
select n.token, c as count from n join d on n.token = d.token where length(n.token) >= 3 and n >= 4 and c::double/n >= 0.5"""


def _stream(spark, sf_dir):
    return company.token_stream(table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn", F.substring(F.md5("text"), 1, 6)).alias("doc"), "text").dropDuplicates(["doc"]), "text", "doc")


_TOK = r"""
t as (select distinct on (doc) conv_id || ':' || turn || ':' || substr(md5(text), 1, 6) doc, regexp_extract_all(lower(text), '([a-z][a-z''’-]*)', 1) a from conversations),
u as (select doc, unnest(generate_series(1, len(a))) i, unnest(a) token from t),
fr as (select token, count(*) freq from u group by 1),
nb as (select token, side, other, count(*) c from (select token, 'L' side, lag(token) over (partition by doc order by i) other from u union all select token, 'R', lead(token) over (partition by doc order by i) from u) where other is not null group by 1, 2, 3)"""


def a27_company(spark, sf_dir):
    return company.neighbours(_stream(spark, sf_dir))


A27 = f"with {_TOK} select token, side, other, c as count from nb"
FRAME, POOL, NEAREST, LEAST, ALIKE = 100, 500, 10, 3, 0.30


def _nearest(spark, sf_dir):
    stream = _stream(spark, sf_dir)
    freq = company.frequencies(stream)
    pool = cut(company.top_tokens(freq, POOL, LEAST))  # at most POOL rows; both tables are read more than once
    return pool, cut(company.nearest(company.company_vectors(company.neighbours(stream), company.top_tokens(freq, FRAME), pool), NEAREST))


def t02_frame(spark, sf_dir):
    return company.top_tokens(company.frequencies(_stream(spark, sf_dir)), FRAME)


T02 = f"with {_TOK} select token, freq from fr order by freq desc, token limit {FRAME}"


def t04_knn(spark, sf_dir):
    return _nearest(spark, sf_dir)[1].select("a", "b", F.round("sim", 6).alias("sim"))


_KNN = f"""{_TOK}, fm as (select token from fr order by freq desc, token limit {FRAME}), po as (select token, freq from fr where freq >= {LEAST} order by freq desc, token limit {POOL}),
vc as materialized (select token, side || other coord, c, (sum(c*c) over (partition by token))::bigint s from nb where other in (select token from fm) and token in (select token from po)),
si as materialized (select p.token a, q.token b, sum(p.c*q.c)::double / (sqrt(p.s::double) * sqrt(q.s::double)) sim from vc p join vc q on p.coord = q.coord and p.token <> q.token group by p.token, q.token, p.s, q.s),
kn as materialized (select * from (select *, row_number() over (partition by a order by sim desc, b) r from si where sim > 0) where r <= {NEAREST})"""
T04 = f"with {_KNN} select a, b, round(sim, 6) as sim from kn"


def j17_mutual(spark, sf_dir):
    return company.mutual(_nearest(spark, sf_dir)[1], ALIKE)


J17 = f"""with {_KNN}
select a, b from (select least(a, b) a, greatest(a, b) b from kn where sim >= {ALIKE}) group by 1, 2 having count(*) = 2"""


def g11_slots(spark, sf_dir):
    pool, near = _nearest(spark, sf_dir)
    return company.slots(pool, company.mutual(near, ALIKE)).select("token", F.col("size").cast("long").alias("size"))


G11 = f"""with recursive {_KNN}, mu as (select x.a, x.b from kn x join kn y on x.a = y.b and x.b = y.a where x.sim >= {ALIKE} and y.sim >= {ALIKE}),
rc as (select token, token root from po union select mu.b, rc.root from rc join mu on mu.a = rc.token),
rt as (select token, min(root) root from rc group by 1)
select token, count(*) over (partition by root) as size from rt"""



def j16_induced_mates(spark, sf_dir):
    """The slot mates of the conversations' words: how many share a word's induced slot, and the first of them."""
    pool, near = _nearest(spark, sf_dir)
    return corpora.slot_members(company.slots(pool, company.mutual(near, ALIKE))).select("token", "n_mates", "first_mate")


J16 = G11[: G11.rindex("select token")] + "select token, (select count(*) from rt o where o.root = rt.root) - 1 as n_mates, (select min(o.token) from rt o where o.root = rt.root and o.token <> rt.token) as first_mate from rt"


def g12_rungs(spark, sf_dir):
    """Slots of all documents' words, slots of what these make, and so on until a rung joins nothing."""
    return company.rungs_of_pairs(company.text_pairs(_docs(spark, sf_dir), "text"), frame_size=FRAME, pool_size=POOL, least=LEAST, k=NEAREST, floor=ALIKE)


QUERIES = {
    "f23_strip_frame": (f23_strip_frame, F23),
    "f24_paragraphs": (f24_paragraphs, F24),
    "f25_sentences": (f25_sentences, F25),
    "f26_lines": (f26_lines, F26),
    "w04_offsets": (w04_offsets, W04),
    "f29_verses": (f29_verses, F29),
    "f30_html_text": (f30_html_text, F30),
    "f49_links": (f49_links, F49),
    "a20_counts": (a20_counts, A20),
    "p13_catalogue": (p13_catalogue, P13),
    "t10_stratified": (t10_stratified, T10),
    "t11_budget": (t11_budget, T11),
    "p14_every_kth": (p14_every_kth, P14),
    "s10_consolidate": (s10_consolidate, S10),
    "s11_flatten": (s11_flatten, S11),
    "s13_codons": (s13_codons, S13),
    "f33_reader_major": (f33_reader_major, F33),
    "f47_small_rules": (f47_small_rules, F47),
    "a22_token_frequency": (a22_token_frequency, A22),
    "a24_speech_verbs": (a24_speech_verbs, A24),
    "a25_frames": (a25_frames, A25),
    "a26_calendar": (a26_calendar, A26),
    "a27_company": (a27_company, A27),
    "t02_frame": (t02_frame, T02),
    "t04_knn": (t04_knn, T04),
    "j17_mutual": (j17_mutual, J17),
    "g11_slots": (g11_slots, G11),
    "j16_induced_mates": (j16_induced_mates, J16),
    "g12_rungs": (g12_rungs, None),
}
