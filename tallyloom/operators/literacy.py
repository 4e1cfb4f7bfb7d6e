"""Literacy: the registers that a corpus teaches about its language, from where its words stand.

Two passes over the texts. The first counts each word's uses: capitalised, small, opening a sentence with a capital, before a sign,
before a full stop. Its most frequent words (at most 60, and those that make up over 0.3 percent of the corpus, at most 333)
are the anchors of the second, which counts the frames around them. Both are sums by word, made in each task before they are
shuffled; everything after that is on tables of one row a word. The anchors are the only rows that the driver sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.scratch import cut

# White space, words, marks of quotation, and signs before a closing mark.
SPACE = r"[\t-\r\p{Z}\x{FEFF}]"
LETTERS = r"\p{L}'’"
MARKS = '"“”«»'
CLOSING = rf"[,.!?;:—-]{SPACE}*[{MARKS}]{SPACE}*$"
# The anchors' numbers and the registers' thresholds.
ARTICLES, GLUE, CORE, FREQUENT = 3, 8, 20, 60
LEAST, SPEAKER_SHARE, COPULAS, SPEECH_VERBS, PRODUCTIVE = 3, 0.003, 12, 40, 5
REGISTERS = ("function", "starter", "preposition", "copula", "attribution-verb", "abbreviation", "modifier")


def _capital(word: Column) -> Column:
    first = F.left(word, F.lit(1))  # letters of ASCII, nearly all there are, need no pattern
    return F.coalesce(F.when(first.between("A", "Z"), True).when(first.between("a", "z"), False).otherwise(word.rlike(r"^\p{Lu}")), F.lit(False))


def sentence_words(texts: DataFrame, text_col: str) -> DataFrame:
    """One row a word: word, token (lower-cased), prev, next, place in its sentence (from 0), before and before_prev (what lies before it and before the
    one before it, between words), after.

    A sentence ends where white space follows . ! or ?, or at an empty line; null and blank texts have none. Texts are read whole.
    """
    sentence = texts.select(F.explode(F.split(text_col, rf"(?<=[.!?]){SPACE}+|\n{{2,}}")).alias("s"))
    piece = F.lit(rf"([{LETTERS}]+)([^{LETTERS}]*)")
    held = sentence.select(
        F.regexp_extract_all("s", piece, 1).alias("w"),
        F.concat(F.array(F.regexp_extract("s", rf"^[^{LETTERS}]*", 0)), F.regexp_extract_all("s", piece, 2)).alias("gap"),
    )
    # a word takes along what it needs of its sentence, not the sentence
    size, none = F.size("w"), F.array(F.lit(None).cast("string"))
    shifted = {
        "word": F.col("w"), "prev": F.concat(none, F.slice("w", F.lit(1), F.greatest(size - 1, F.lit(0)))), "next": F.concat(F.slice("w", F.lit(2), size), none),
        "place": F.sequence(F.lit(0), size - 1), "before": F.slice("gap", F.lit(1), size),
        "before_prev": F.concat(none, F.slice("gap", F.lit(1), F.greatest(size - 1, F.lit(0)))), "after": F.slice("gap", F.lit(2), size),
    }
    each = held.filter(size > 0).select(F.inline(F.arrays_zip(*[c.alias(n) for n, c in shifted.items()])).alias(*shifted))
    return each.select("word", F.lower("word").alias("token"), "prev", "next", "place", "before", "before_prev", "after")


def profile(words: DataFrame) -> DataFrame:
    """token, n, n_cap, n_low, n_start (opens a sentence with a capital), n_final (before a sign, or last), n_dot (before a full stop)."""
    cap = _capital(F.col("word"))
    marked = (F.col("after") != " ") & F.col("after").rlike(rf"[^\t-\r\p{{Z}}\x{{FEFF}}]")
    signed = F.col("next").isNull() | marked | F.col("next").startswith("'") | F.col("next").startswith("’")
    return words.groupBy("token").agg(
        F.count("*").alias("n"), F.count_if(cap).alias("n_cap"), F.count_if(~cap).alias("n_low"), F.count_if(cap & (F.col("place") == 0)).alias("n_start"),
        F.count_if(signed).alias("n_final"), F.count_if(F.col("after").startswith(".")).alias("n_dot"),
    )


def anchors(counts: DataFrame) -> tuple[list[str], list[str], int]:
    """(the most frequent tokens in order, of equal ones the first; the tokens that are frequent enough to be speakers; the number of words)."""
    words = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    speakers = counts.filter(F.col("n") / max(1, words) > SPEAKER_SHARE).select("token").collect()
    return [r.token for r in top], [r.token for r in speakers], words


def frame_counts(words: DataFrame, counts: DataFrame, top: list[str], speakers: list[str]) -> DataFrame:
    """token, n_copula, n_nominal, n_ing, n_prev_cap, n_noun, n_speech: how often a token stands in each frame.

    n_copula: behind a subject (the capitalised word that opens a sentence, or one that is mostly capitalised) and before an article;
    n_nominal: before an article or a capital; n_ing: before a word in -ing; n_prev_cap: behind a capital; n_noun: behind the most
    frequent word; n_speech: behind a closing quotation mark with a speaker on its other side, or behind such a speaker.
    """
    article = F.coalesce(F.lower("next").isin(top[:ARTICLES]), F.lit(False))
    inner, cap_prev, cap_next = F.col("prev").isNotNull() & F.col("next").isNotNull(), _capital(F.col("prev")), _capital(F.col("next"))
    links = inner & article & cap_prev
    closing = lambda gap: F.coalesce((F.length(gap) > 1) & F.substring(gap, -3, 3).rlike(CLOSING), F.lit(False))  # noqa: E731  a sign and a mark at least
    speaker = lambda w: _capital(w) | F.coalesce(F.lower(w).isin(speakers), F.lit(False))
    met = words.withColumn("subject", F.when(links & (F.col("place") != 1), F.lower("prev"))).groupBy("token", "subject").agg(
        F.count("*").alias("n_all"),
        F.count_if(links & (F.col("place") == 1)).alias("n_opened"),
        F.count_if((inner & article) | cap_next).alias("n_nominal"),
        F.count_if((F.length("next") > 4) & F.lower("next").endswith("ing")).alias("n_ing"),
        F.count_if(cap_prev).alias("n_prev_cap"),
        F.count_if(F.lower("prev") == F.lit(top[0] if top else None).cast("string")).alias("n_noun"),
        (F.count_if(closing("before") & speaker(F.col("next"))) + F.count_if(closing("before_prev") & speaker(F.col("prev")))).alias("n_speech"),
    )
    named = counts.filter("n_low < n_cap").select(F.col("token").alias("subject"), F.lit(True).alias("named"))
    scored = F.col("n_opened") + F.when(F.col("named"), F.col("n_all")).otherwise(0)
    summed = [F.sum(c).alias(c) for c in ("n_nominal", "n_ing", "n_prev_cap", "n_noun", "n_speech")]
    return met.join(named, "subject", "left").groupBy("token").agg(F.sum(scored).alias("n_copula"), *summed)


def _attested(tokens: DataFrame, counts: DataFrame, forms: Column) -> DataFrame:
    """(token): the tokens of which one of the forms is a token of the corpus too."""
    made = tokens.select("token", F.explode(F.array_compact(forms)).alias("form"))
    return made.join(counts.select(F.col("token").alias("form")), "form", "left_semi").select("token").distinct()


def _less(token: Column, n: int) -> Column:
    """The token without its last n characters."""
    return F.left(token, F.length(token) - n)


def registers(counts: DataFrame, frames: DataFrame, top: list[str], words: int) -> DataFrame:
    """register, token, weight of all registers, from the sums of both passes.

    function: frequent words in small letters that no other register claims and that have no inflected family; starter: capitalised where
    they open a sentence, small elsewhere; preposition: short, frequent, before nouns, never last; copula: between a subject and an
    article; attribution-verb: beside a quotation and its speaker; abbreviation: nearly always with a full stop; modifier: words in -ly
    with a stem, once the ending is productive, and what else stands like a copula. Of equal scores at a list's end the first tokens stay; a
    word that is a modifier in both ways has its greater weight.
    """
    t = F.col("token")
    size, cap, final = F.length(t), F.col("n_cap") / F.col("n"), F.col("n_final") / F.col("n")
    both = cut(counts.join(frames, "token"))
    glue, listed = t.isin(top[:GLUE]), lambda df, name, weight: df.select(F.lit(name).alias("register"), "token", F.col(weight).cast("long").alias("weight"))
    starter = listed(both.filter((F.col("n_start") >= LEAST) & (F.col("n_low") >= 2 * (F.col("n_cap") - F.col("n_start"))) & (F.col("n_low") >= F.col("n_start"))), "starter", "n_start")
    short = (F.col("n") >= 20) & (size <= 5) & (cap <= 0.4) & (final <= 0.05)
    preposition = short & (F.col("n_nominal") / F.col("n") >= 0.25) & (F.col("n_prev_cap") / F.col("n") <= 0.2)
    linking = both.filter((F.col("n_copula") > 0) & ~glue & ~preposition & (cap < 0.4))
    copula = cut(listed(linking.filter((F.col("n_copula") >= 8) & (final < 0.3) & (F.col("n_ing") >= 3)).orderBy(F.desc("n_copula"), "token").limit(COPULAS), "copula", "n_copula"))
    spoken = both.filter((F.col("n_speech") >= LEAST) & (cap < 0.35) & ~t.isin(top) & (F.col("n_noun") == 0))
    speech = cut(listed(spoken.orderBy(F.desc("n_speech"), "token").limit(SPEECH_VERBS), "attribution-verb", "n_speech"))
    dotted = (F.col("n_dot") >= LEAST) & (size <= 6) & (F.col("n_dot") / F.col("n") >= 0.8) & ((cap >= 0.8) | ~t.rlike("[aeiouy]"))

    ly = both.filter(t.endswith("ly") & (size > 4))
    stem = _less(t, 2)
    if _attested(ly, counts, F.array(stem)).limit(PRODUCTIVE).count() == PRODUCTIVE:
        stemmed = _attested(ly, counts, F.array(stem, F.concat(stem, F.lit("e")), F.when(stem.endswith("i"), F.concat(_less(t, 3), F.lit("y")))))
        derived = ly.filter("n >= 2").join(stemmed, "token", "left_semi")
    else:
        derived = ly.limit(0)
    auxiliary = linking.filter("n_copula >= 4").join(F.broadcast(copula), "token", "left_anti")  # at most COPULAS rows
    modifier = listed(derived, "modifier", "n").unionByName(listed(auxiliary, "modifier", "n_copula")).groupBy("register", "token").agg(F.max("weight").alias("weight"))
    modifier = cut(modifier)

    frequent = both.filter((F.col("n") >= 5) & (cap < 0.35) & (F.col("n") / max(1, words) > 0.0002))  # at most 5,000 rows
    ends = lambda end, *forms: [F.when(t.endswith(end), f) for f in forms]
    suffixed = [F.concat(t, F.lit(e)) for e in ("s", "ed", "ing")]
    family = F.array(*suffixed, *ends("e", F.concat(_less(t, 1), F.lit("ing"))), *ends("ed", _less(t, 2), _less(t, 1)), *ends("ing", _less(t, 3), F.concat(_less(t, 3), F.lit("e"))))
    inflected = _attested(frequent.filter(~t.isin(top[:CORE])), counts, family)
    claimed = copula.select("token").union(speech.select("token")).union(modifier.select("token"))
    function = listed(frequent.join(claimed, "token", "left_anti").join(inflected, "token", "left_anti"), "function", "n")
    found = function
    for part in (starter, listed(both.filter(preposition), "preposition", "n"), copula, speech, listed(both.filter(dotted), "abbreviation", "n_dot"), modifier):
        found = found.unionByName(part)
    return found


def literacy_of(words: DataFrame, counts: DataFrame) -> DataFrame:
    """What induce_literacy finds, of words and their profile."""
    top, speakers, n = anchors(counts)
    return registers(counts, frame_counts(words, counts, top, speakers), top, n)


def induce_literacy(texts: DataFrame, text_col: str) -> DataFrame:
    """register, token, weight: what the texts teach. Null and blank texts teach nothing, repeated rows count each, and an empty table gives no
    rows. Other columns are not read."""
    words = sentence_words(texts, text_col)
    return literacy_of(words, cut(profile(words)))
