"""Parsers of model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels, and the forms of replies.
VALENCES = ["positive", "negative", "neutral"]
MODALITIES = ["emphatic", "hedged", "neutral"]
NUMBERED = r"^(\d+)\|(.+)$"
FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
WITH_SCORE = r'(?s)\{[^{}]*"score"[^{}]*\}'
FLAT_OBJECT = r"(?s)\{[^{}]+\}"


def labelled_lines(reply: Column) -> Column:
    """Valid lines `idx|valence|modality` as structs; an index must not be negative."""
    parts = F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), lambda x: F.transform(F.split(x, r"\|"), lambda p: F.lower(F.regexp_replace(p, r"^\s+|\s+$", ""))))
    rows = F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("int").alias("idx"), F.get(p, F.lit(1)).alias("valence"), F.get(p, F.lit(2)).alias("modality")))
    return F.filter(rows, lambda r: r["idx"].isNotNull() & (r["idx"] >= 0) & r["valence"].isin(VALENCES) & r["modality"].isin(MODALITIES))


def numbered_lines(reply: Column) -> Column:
    """Lines `number|text` as structs."""
    rows = F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), lambda x: F.struct(F.regexp_extract(x, NUMBERED, 1).try_cast("int").alias("idx"), F.regexp_extract(x, NUMBERED, 2).alias("text")))
    return F.filter(rows, lambda r: r["idx"].isNotNull())


def json_score(reply: Column) -> Column:
    """The score 0, 1 or 2 of a JSON reply, bare, fenced or inside other text; -1 if there is none."""
    schema = "score string"
    bare = F.from_json(reply, schema)["score"]
    fenced = F.from_json(F.regexp_extract(reply, FENCED, 1), schema)["score"]
    inside = F.from_json(F.regexp_extract(reply, WITH_SCORE, 0), schema)["score"]
    score = F.coalesce(bare, fenced, inside).try_cast("int")
    return F.when(score.isin(0, 1, 2), score).otherwise(F.lit(-1))


def guest_label(reply: Column, speakers: Column | None = None) -> Column:
    """The speaker whom the first flat JSON object of a reply calls `guest`.

    With an array of speakers, the first of them in order whose own key says so, or, where that
    is missing, a key that is equal but for case and spaces; else the first such key itself.
    """
    pairs = F.from_json(F.regexp_extract(reply, FLAT_OBJECT, 0), "map<string,string>")
    guest = lambda v: F.lower(F.trim(v)) == "guest"
    if speakers is None:
        return F.get(F.map_keys(F.map_filter(pairs, lambda k, v: guest(v))), F.lit(0))
    plain = lambda x: F.replace(F.lower(x), F.lit(" "), F.lit("_"))

    def says(name: Column) -> Column:
        like = F.map_values(F.map_filter(pairs, lambda k, v: plain(k) == F.lower(name)))
        return F.coalesce(guest(F.coalesce(F.element_at(pairs, name), F.get(like, F.lit(0)))), F.lit(False))

    known = F.array_sort(F.filter(speakers, lambda x: x != "UNKNOWN"))
    return F.get(F.filter(known, says), F.lit(0))
