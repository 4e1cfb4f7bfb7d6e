"""Text rules as columns: frames, markup, segments, small normal forms. No look-around, so that other engines can run the same patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.numeric import once

#: Stands between segments while a text is split: one of the code points that are no characters.
CUT = "\ufdd0"
# Signs that may follow the end of a sentence, and the lines around a book.
CLOSERS = "[\"'’”)\\]]*"
_START = r"(?i)\*\*\* ?START OF (THE|THIS) PROJECT GUTENBERG EBOOK[^\n]*\*\*\*"
_END = r"(?i)\*\*\* ?END OF (THE|THIS) PROJECT GUTENBERG EBOOK"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _split(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), trimmed), lambda s: s != "")


def sentences(text: Column) -> Column:
    """A sentence ends at . ! or ? and closing signs, before white space and an ASCII capital or digit, or at the end."""
    return _split(F.regexp_replace(text, f"([.!?]{CLOSERS})(\\s+)([A-Z0-9])", f"$1{CUT}$3"), CUT)


def paragraphs(text: Column) -> Column:
    return _split(text, r"\n[ \t]*\n+")


def lines(text: Column) -> Column:
    return _split(text, r"\n")


def spans(df: DataFrame, text_col: str, how: str, *keep: str) -> DataFrame:
    """(kept, position, start, end, text): segments with offsets in code points, from left to right.

    The text is cut into pieces that keep what separates them, so a segment's place is the sum of the lengths before it, and repeated
    segments have their own places. Null and blank texts have none.
    """
    t = F.col(text_col)
    marked = {
        "sentence": F.regexp_replace(t, f"([.!?]{CLOSERS}\\s+)([A-Z0-9])", f"$1{CUT}$2"),
        "paragraph": F.regexp_replace(t, r"(\n[ \t]*\n+)", f"$1{CUT}"),
        "line": F.replace(t, F.lit("\n"), F.lit("\n" + CUT)),
    }[how]
    held = once(df.select(*keep, F.split(marked, CUT).alias("__p")), __n=F.transform("__p", lambda p: F.length(p)))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda state, n: F.struct((state.at + n).alias("at"), F.array_append(state.out, state.at).alias("out"))
    held = once(held, __s=F.aggregate("__n", empty, step, lambda s: s.out))
    first = lambda p: F.length(p) - F.length(F.regexp_replace(p, r"^\s+", ""))
    placed = F.filter(F.transform(F.arrays_zip("__p", "__s"), lambda x: F.struct((x["__s"] + first(x["__p"])).alias("start"), trimmed(x["__p"]).alias("text"))), lambda x: x.text != "")
    found = held.select(*keep, F.posexplode(placed).alias("position", "s"))
    return found.select(*keep, "position", "s.start", (F.col("s.start") + F.length("s.text")).alias("end"), "s.text")


def strip_frame(text: Column) -> Column:
    """What lies between a book's start and end lines; the whole text without both."""
    start, end = F.regexp_instr(text, F.lit(_START)), F.regexp_instr(text, F.lit(_END))
    rest = F.substring(text, start, F.length(text))
    first = start + F.locate("\n", rest)
    return F.when((start > 0) & (end > start), F.substring(text, first, end - first)).otherwise(text)


def html_text(html: Column) -> Column:
    """Page text: head, script and style go, tags become spaces, five entities are read, lines are squeezed, blank ones go."""
    for tag in ("head", "script", "style"):
        html = F.regexp_replace(html, f"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    text = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, sign in (("&amp;", "&"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    squeezed = F.transform(F.split(text, r"\r\n|\n|\r"), lambda s: trimmed(F.regexp_replace(s, r"[ \t]+", " ")))
    return F.array_join(F.filter(squeezed, lambda s: s != ""), "\n")


def verse_text(html: Column) -> Column:
    """One verse: footnotes go whole, tags become spaces, white space is squeezed."""
    text = F.regexp_replace(html, '<sup class="footnote-marker">.*?</sup>', "")
    text = F.regexp_replace(text, '<i class="footnote">.*?</i>', "")
    text = F.replace(F.regexp_replace(text, "<[^>]+>", " "), F.lit("&nbsp;"), F.lit(" "))
    return trimmed(F.regexp_replace(text, r"\s+", " "))


def links(html: Column) -> Column:
    """Sorted distinct relative links, but for style sheets and icons."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), 1))
    return F.array_sort(F.filter(found, lambda h: ~h.rlike(r"^(http:|https:|mailto:|#)") & ~h.rlike(r"\.(css|ico)\z")))


def norm_token(token: Column) -> Column:
    """Lower case, without one dot at the end."""
    return F.regexp_replace(F.lower(token), r"\.\z", "")


def actor_slug(name: Column) -> Column:
    slug = F.regexp_replace(F.lower(trimmed(F.coalesce(name, F.lit("")))), r"\s+", "-")
    return F.when(slug == "", "anonymous").otherwise(slug)


def reader_major(version: Column) -> Column:
    """Name and major number of a reader version, lower case; null if it has none."""
    pattern = r"(?i)^([a-z][a-z0-9_-]*)(\d+)(?:\.|@|\z)"
    return F.when(version.rlike(pattern), F.concat(F.lower(F.regexp_extract(version, pattern, 1)), F.regexp_extract(version, pattern, 2)))


def array_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\[\d+\]", "[]")


def flat_name(path: Column) -> Column:
    return F.regexp_replace(path, r"[\\/]", "__")


def codons(fasta: Column, frame: int = 0) -> Column:
    """Triplets of the sequence lines from an offset of 0, 1 or 2; an incomplete last one goes."""
    sequence = F.upper(F.regexp_replace(F.regexp_replace(fasta, r"(?m)^>.*$", ""), r"\s+", ""))
    return F.regexp_extract_all(F.substring(sequence, frame + 1, 1 << 30), F.lit("(...)"), 1)


def subject_key(subjects: Column) -> Column:
    """The first subject before -- or a comma."""
    key = trimmed(F.split(F.coalesce(subjects, F.lit("Uncategorized")), "--|,")[0])
    return F.when(key == "", "Uncategorized").otherwise(key)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def pages(words: Column, per_page: int = 300) -> Column:
    return F.greatest(F.lit(1), F.floor(words / per_page)).cast("long")
