"""License scans inside the JVM, by a positional index over rare words.

Every template is a run of words with a label. The index holds, for each template,
the words of highest IDF in the corpus that is scanned, with their places in it. A
text looks up its licence words of highest IDF, the places of text and template
give an alignment, and an alignment counts once the template's mandatory key
phrase stands there, word by word. Templates whose key phrase is the whole are exact.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.native import alnum_words

#: Words of a template that the index holds.
ANCHORS = 3
#: Share of a template's IDF that an alignment must match, beside the key phrase.
LEAST_SCORE = 0.6


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str | None = None  # the mandatory phrase; the whole text unless given
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(r"[a-z0-9]+", self.text.lower())

    @property
    def key_at(self) -> tuple[int, int]:
        words, key = self.words, re.findall(r"[a-z0-9]+", (self.key or self.text).lower())
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        return at, len(key)


#: The base phrases, then phrases of well-known licences.
TEMPLATES = [
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge to any person"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "you may not use this file except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("gpl-3", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2", "mozilla public license version 2 0", "mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc0", "creative commons zero v1 0 universal", "creative commons zero"),
    Template("cc-by-sa", "creative commons attribution sharealike", "creative commons attribution sharealike"),
    Template("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Template("proprietary", "all rights reserved no part of this publication may be reproduced", "no part of this publication may be reproduced"),
    Template("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "warranties of merchantability fitness for a particular purpose and noninfringement"),
    Template("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "distributed under the license is distributed on an as is basis"),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", "under the terms of the gnu general public license as published by"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    Template("bsl-1", "boost software license version 1 0", "boost software license"),
    Template("ofl", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    Template("odbl", "made available under the open database license", "open database license"),
    Template("cc-by-nd", "creative commons attribution noderivatives"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("public-domain", "has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
]


def word_idf(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of the templates' words over all texts; the vocabulary is a few hundred words, and so are the rows collected."""
    known = F.array(*map(F.lit, vocabulary))
    present = F.array_intersect(alnum_words(F.col("text")), known)
    # an empty string stands for the text itself
    counts = docs.select(F.explode(F.array_append(present, F.lit(""))).alias("word")).groupBy("word").count().collect()
    found = {r["word"]: r["count"] for r in counts}
    total = found.pop("", 0)
    return {w: math.log((total + 1) / (found.get(w, 0) + 0.5)) for w in vocabulary}


def _index(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """word, template, tpos and the template's words, weights and key, for its words of highest IDF."""
    vocabulary = sorted({w for t in templates for w in t.words})
    idf = word_idf(docs, vocabulary)
    rows = []
    for number, t in enumerate(templates):
        words = t.words
        at, n = t.key_at
        # the key phrase must hold an anchor, or a text with the key alone would not be looked up
        inside = sorted(range(at, at + n), key=lambda i: (-idf[words[i]], words[i], i))[:1]
        rest = [i for i in sorted(range(len(words)), key=lambda i: (-idf[words[i]], words[i], i)) if i not in inside]
        for i in inside + ([] if at == 0 and n == len(words) else rest[: ANCHORS - 1]):
            rows.append((words[i], number, t.label, t.base, i, words, [idf[w] for w in words], at, n, words[at : at + n]))
    schema = "anchor string, template int, label string, base boolean, tpos int, twords array<string>, weights array<double>, kpos int, klen int, key array<string>"
    return docs.sparkSession.createDataFrame(rows, schema)


def _share(words: Column, off: Column) -> Column:
    """Share of the template's IDF whose words stand in place."""
    hit = F.aggregate(F.zip_with(F.expr("sequence(0, size(twords) - 1)"), "weights", lambda i, w: F.when(F.get(words, off + i) == F.get(F.col("twords"), i), w).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    full = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return F.round(F.try_divide(hit, full), 6)


def scan(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and places, for each row.

    score is the best share of a template's IDF among those found, 0 without any.
    Null and empty texts have no words; repeated rows return as often as they stand;
    a null doc_id stays null.
    """
    templates = templates or TEMPLATES
    docs = docs.select("doc_id", "text")
    index = _index(docs, templates)
    anchors = F.array(*(F.lit(r["anchor"]) for r in index.select("anchor").distinct().orderBy("anchor").collect()))
    d = docs.select("doc_id", F.xxhash64("text").alias("hash"), alnum_words(F.col("text")).alias("words"))
    last = F.when(F.arrays_overlap("words", anchors), F.size("words") - 1).otherwise(-1)
    d = d.select("doc_id", "hash", "words", F.size("words").alias("n"), F.explode(F.sequence(F.lit(-1), last)).alias("pos"))
    d = d.withColumn("word", F.when(F.col("pos") >= 0, F.get("words", F.col("pos"))))
    # the index has three rows a template
    rows = d.join(F.broadcast(index), F.expr("word = anchor and pos >= tpos and slice(words, greatest(pos - tpos + kpos + 1, 1), klen) = key"), "left").where("pos < 0 or anchor is not null")
    off = F.col("pos") - F.col("tpos")
    rows = rows.select("doc_id", "hash", "n", "pos", "label", "base", "template", off.alias("off"), F.when(F.col("pos") >= 0, _share(F.col("words"), off)).alias("score"))
    found = F.collect_set(F.when((F.col("pos") >= 0) & (F.col("base") | (F.col("score") >= LEAST_SCORE)), F.struct("off", "template", "label", "base", "score"))).alias("places")
    out = rows.groupBy("doc_id", "hash", "n").agg(F.count_if(F.col("pos") < 0).alias("copies"), found)
    own = F.filter("places", lambda x: x["base"])
    names = lambda a: F.array_join(F.sort_array(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    starts = F.transform(own, lambda x: x["off"].cast("long"))
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.size(own).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(own).alias("base_labels"),
        names(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: x["score"])), F.lit(0.0)).alias("score"),
        F.sort_array("places").alias("places"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy"),
    ).drop("__copy")
