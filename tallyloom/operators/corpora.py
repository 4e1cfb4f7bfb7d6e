"""Corpora and their readers' registers: files against manifests, ranges of spans, tokens by register, initialisms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import norm_token
from tallyloom.operators.conventions import held

#: Spans that open a book and are skipped.
OPENING = 15

# The registers that every reader starts with. Function words hold the prepositions too. The long list of words that open a
# clause is no constant here: it is induced (literacy) or given.
PREPOSITIONS = """of in on at to from by with into onto upon over under through after before between among against about as
    unto toward towards for near beside within without beyond beneath above below behind around past""".split()
REGISTERS = {
    "attribution-verb": """said says say asked asks replied replies told tells cried cries shouted whispered muttered answered answers
        called calls exclaimed declared added continued thought thinks wondered murmured repeated insisted remarked
        observed screamed begged urged warned promised admitted confessed announced wrote writes""".split(),
    "abbreviation": """mr mrs ms dr st mt messrs mme mlle prof rev hon capt col gen sgt lt cmdr sr jr esq co inc ltd no vol pp rd ave fig
        vs etc al eg ie cf viz jan feb mar apr jun jul aug sep sept oct nov dec""".split(),
    "copula": "is am are was were be been being".split(),
    "modifier": """then now also just once soon suddenly slowly quietly gently again still only even simply quickly immediately
        finally however never always often already almost nearly merely truly indeed perhaps really quite rather very
        much more most less so too such thus hence
        had has have having would could will shall should did does do not must might may can""".split(),
    "preposition": PREPOSITIONS,
    "function": """a an the this that these those and or but nor so yet
        he she it they we i you him them us me thee thou ye who whom whose which what his her its their
        our my your thy thine mine hers ours yours there then now here very not also thus lo behold
        yea nay verily when where why how if because while though although until unless whether else ever never""".split()
    + PREPOSITIONS
    + """is am are was were be been being have has had do does did
        shall will would should could may might must can hath hast doth dost art wast wilt shalt""".split(),
    "demonym": """russian french american german english british irish scottish welsh italian spanish portuguese dutch belgian
        swiss austrian greek turkish polish czech hungarian romanian bulgarian serbian croatian ukrainian swedish
        norwegian danish finnish icelandic chinese japanese korean vietnamese thai indian pakistani persian iranian iraqi
        israeli arab arabic egyptian moroccan nigerian kenyan ethiopian mexican canadian brazilian argentine argentinian
        chilean peruvian colombian cuban australian european asian african jewish hispanic latino latina slavic nordic
        baltic anglo saxon""".split(),
    "calendar": """monday tuesday wednesday thursday friday saturday sunday january february september october november december
        feb sep sept oct nov dec""".split(),
}


def file_key(name: Column) -> Column:
    """What a file's name and a manifest's id have in common: the name without a leading pg and a trailing .txt."""
    return F.regexp_replace(F.regexp_replace(name, r"^pg", ""), r"\.txt$", "")


def with_manifest(files: DataFrame, manifest: DataFrame, name_col: str, id_col: str) -> DataFrame:
    """The files that the manifest knows, with its columns; files that it lacks are left out, a null name or id meets nothing."""
    keyed = manifest.withColumn("__key", F.col(id_col).cast("string"))
    return files.withColumn("__key", file_key(F.col(name_col))).join(keyed, "__key").drop("__key")


def is_fiction(subject: Column) -> Column:
    """True if a subject line speaks of fiction or stories, in either case; false for null."""
    return F.coalesce(subject.rlike("(?i)fiction|stories"), F.lit(False))


def span_range(spans: DataFrame, book_col: str, pos_col: str, most: int, opening: int = OPENING) -> DataFrame:
    """Up to so many spans of each book (positions from 0), after its opening ones; a book no longer than its opening gives none."""
    return spans.filter((F.col(pos_col) >= opening) & (F.col(pos_col) < opening + most))


def relation_types(tokens: DataFrame, entries: DataFrame, table: DataFrame) -> DataFrame:
    """Adds relation_type: speech for a token of the attribution register, else the first bucket of (bucket, ord, token) that has it, else null.

    The table is the caller's and small enough for its language; the registers are entries as conventions has them.
    """
    speech = held(entries, ["attribution-verb"]).select(F.col("token").alias("__t"), F.lit(True).alias("__speech"))
    first = table.groupBy(norm_token(F.col("token")).alias("__t")).agg(F.min_by("bucket", "ord").alias("__bucket"))
    found = tokens.withColumn("__t", norm_token(F.col("token"))).join(speech, "__t", "left").join(first, "__t", "left")
    return found.withColumn("relation_type", F.when(F.col("__speech"), F.lit("speech")).otherwise(F.col("__bucket"))).drop("__t", "__speech", "__bucket")


def initialisms(uses: DataFrame, pos_col: str) -> DataFrame:
    """(token, expansion, weight): what each acronym stands for, by the last of its uses (token, expansion, weight, position).

    Uses of a hot acronym are summed before their shuffle; of uses at one position the last expansion in order counts.
    """
    last = F.max_by("expansion", F.struct(F.col(pos_col), F.col("expansion")))
    return uses.groupBy(norm_token(F.col("token")).alias("token")).agg(last.alias("expansion"), F.sum("weight").cast("long").alias("weight"))


def slot_members(slots: DataFrame) -> DataFrame:
    """(token, slot, n_mates, first_mate): how many others share a token's slot, and the first of them; no pairs are made."""
    whole = Window.partitionBy("slot")
    least, second = F.min("token").over(whole), F.min(F.when(F.col("token") != F.col("__least"), F.col("token"))).over(whole)
    found = slots.withColumn("__least", least).withColumn("__second", second)
    mate = F.when(F.col("token") == F.col("__least"), F.col("__second")).otherwise(F.col("__least"))
    return found.select("token", "slot", (F.count("*").over(whole) - 1).alias("n_mates"), mate.alias("first_mate"))
