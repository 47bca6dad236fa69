"""Column expressions that the native operators share; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\f\r"
#: Fixed pattern: what parts words of lower-cased text, ASCII but for digits and small letters.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NOT_ALNUM_CHARS = "".join(chr(i) for i in range(128) if not (48 <= i < 58 or 97 <= i < 123))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's body is evaluated anew for each element, and so are columns inlined in it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _split(text: Column, ends: str, pattern: str) -> Column:
    bare = F.btrim(text, F.lit(ends))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, pattern))


def space_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+; none for null."""
    return _split(F.coalesce(text, F.lit("")), SPACES, r"[\x20\x09-\x0D]+")


def alnum_words(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case; none for null."""
    return _split(lower_ascii(F.coalesce(text, F.lit(""))), _NOT_ALNUM_CHARS, NOT_ALNUM)


def covered(spans: Column) -> Column:
    """Places covered by an array of (at, len) structs, which may overlap."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))

    def add(acc: Column, x: Column) -> Column:
        end = x["at"] + x["len"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["upto"], x["at"]))).alias("n"), F.greatest(acc["upto"], end).alias("upto"))

    return F.aggregate(F.sort_array(spans), zero, add, lambda acc: acc["n"])
