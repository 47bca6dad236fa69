"""Text primitives as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a sentence ends at white space after . ! ? and before a capital, a quote or a parenthesis.
SENTENCE_BREAK = r"""(?<=[.!?])\s+(?=[A-Z"'(])"""
LOOSE_BREAK = r"(?<=[.!?])\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; inside a lambda an expression would be computed anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space at either end, line breaks included (trim leaves those)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def words(text: Column) -> Column:
    """Words between runs of white space; none for null or blank texts."""
    bare = strip(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"\s+"))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sentences(text: Column, pattern: str = SENTENCE_BREAK) -> Column:
    """Stripped sentences that aren't empty; a line break inside a sentence stays."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), pattern), strip), lambda s: s != "")


def keyword_clean(text: Column) -> Column:
    """Lower case, and a space for everything but a-z, white space, slash and hyphen."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z\s/-]", " ")


def slug(name: Column) -> Column:
    """Lower case, one underscore for each run of other characters, none at the ends."""
    safe = F.regexp_replace(F.lower(strip(name)), r"[^a-zA-Z0-9_-]", "_")
    return F.btrim(F.regexp_replace(safe, "_+", "_"), F.lit("_"))


def title_name(slugged: Column) -> Column:
    """Words of a slug with capitals, after hyphens and apostrophes too."""
    parts = F.split(F.replace(slugged, F.lit("_"), F.lit(" ")), r"(?<=[^a-zA-Z])|(?=[^a-zA-Z])")
    return F.array_join(F.transform(parts, F.initcap), "")


def identity_normal(text: Column) -> Column:
    """Accents off Latin-1 letters, lower case, and single spaces for all but a-z 0-9 & ' + and hyphen."""
    accented = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿ"
    plain = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyy"
    low = F.lower(F.translate(F.coalesce(text, F.lit("")), accented, plain))
    return F.btrim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9&'+ -]+", " "), r"\s+", " "))


def contains_any(text: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def month(raw: Column) -> Column:
    """yyyyMMdd... or yyyy-MM... as yyyy-MM, anything else cut to seven characters, '' for null."""
    raw = F.coalesce(raw, F.lit(""))
    compact = F.regexp_extract(raw, r"^(\d{4})(\d{2})(\d{2})", 0) != ""
    dashed = F.regexp_extract(raw, r"^(\d{4})-(\d{2})", 0)
    return F.when(compact, F.concat(F.substring(raw, 1, 4), F.lit("-"), F.substring(raw, 5, 2))).when(dashed != "", dashed).otherwise(F.substring(raw, 1, 7))


def clock(seconds: Column) -> Column:
    """H:MM:SS, M:SS below an hour, 0:00 for null and negative values."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), (s % 60).cast("long")
    return F.when(s.isNull() | (s < 0), "0:00").when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def ngrams(items: Column, n: int) -> Column:
    """Runs of n items, joined by spaces; none if there are fewer."""

    def runs(a: Column) -> Column:
        at = F.when(F.size(a) >= n, F.sequence(F.lit(1), F.size(a) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(a, i, n), " "))

    return let(items, runs)


def excerpt(text: Column, needle: Column, radius: int = 130) -> Column:
    """Up to `radius` characters on either side of the first needle, white space squeezed; '' without one."""
    at = F.when(F.coalesce(needle, F.lit("")) == "", 0).otherwise(F.position(needle, text))
    start = F.greatest(F.lit(1), at - radius)
    return F.when(F.coalesce(at, F.lit(0)) > 0, squeeze(F.substring(text, start, at - start + F.char_length(needle) + radius))).otherwise("")


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with each literal {name} replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def stars(p: Column) -> Column:
    """Significance marks of a p-value."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


#: Fixed value: words of over five letters that don't tell where a passage stands.
COMMON_LONG = ["there", "their", "these", "those", "about", "which", "would", "could", "should"]


def alignment(transcript: Column, cleaned: Column) -> Column:
    """0-based place in a transcript where its cleaned text begins.

    Anchors of 120, 80, 50 and 30 characters (cut at the last space) are looked for, then
    runs of three long words of the first 200 characters; else a third of the transcript is taken to be introduction.
    """
    low, first = F.lower(transcript), strip(cleaned)
    place = lambda a: F.nullif(F.position(F.lower(a), low), F.lit(0))
    anchors = [place(F.regexp_replace(F.substring(first, 1, n), r"(?s) [^ ]*$", "")) for n in (120, 80, 50, 30)]
    long_words = F.filter(F.split(F.substring(first, 1, 200), r"\s+"), lambda w: (F.char_length(w) > 5) & ~F.lower(w).isin(COMMON_LONG))
    phrase = F.get(F.filter(F.transform(ngrams(long_words, 3), lambda p: F.position(F.lower(p), low)), lambda i: i > 0), F.lit(0))
    return F.coalesce(*(a - 1 for a in anchors), phrase - 1, F.floor(F.char_length(transcript) / 3).cast("int"))
