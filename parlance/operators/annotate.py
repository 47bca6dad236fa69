"""Labelling by a provider: a function of batches, with retries; the default is the lexicon and needs no network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import lexicon, text
from parlance.operators import relational

Provider = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
KEY = ["video_id", "sentence_index"]


def by_lexicon(samples: DataFrame) -> DataFrame:
    """samples with valence and modality by keyword rules, inside the JVM."""
    clean = samples.withColumn("__t", text.keyword_clean(F.col("text"))).withColumn("__hit", lexicon.any_hit(F.col("__t")))
    counts = clean.withColumns(lexicon.counts(F.col("__t"), F.col("__hit")))
    return counts.select(*samples.columns, lexicon.valence().alias("valence"), lexicon.modality(lexicon.certainty()).alias("modality"))


def by_provider(samples: DataFrame, provider: Provider) -> DataFrame:
    """samples labelled by an injected function from batches (video_id, sentence_index, text) to batches with valence and modality."""
    rows = samples.select(*KEY, "text")
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    return rows.mapInPandas(provider, f"{types}, valence string, modality string").where("valence in ('positive', 'negative', 'neutral') and modality in ('emphatic', 'hedged', 'neutral')")


def retried(call: Callable, attempts: int = 3, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call with waits of base ** n seconds between its attempts."""

    def run(*args):
        for n in range(attempts):
            try:
                return call(*args)
            except Exception:
                if n + 1 == attempts:
                    raise
                sleep(base**n)

    return run


def annotate(samples: DataFrame, done: DataFrame | None = None, provider: Provider | None = None) -> DataFrame:
    """Labels of the samples that aren't done yet."""
    todo = samples if done is None else relational.pending(samples, done, KEY)
    return by_lexicon(todo) if provider is None else by_provider(todo, provider)


def prompts(batched: DataFrame, batch: str = "batch_id", at: str = "rel_idx", column: str = "text") -> DataFrame:
    """A prompt body for each batch: numbered lines in order."""
    rows = batched.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(at, column))).alias("r"))
    return rows.select(batch, F.array_join(F.transform("r", lambda x: F.concat(x[at].cast("string"), F.lit(". "), x[column])), "\n").alias("prompt"))


def segment_prompts(batched: DataFrame, batch: str = "batch_id", at: str = "idx", column: str = "text") -> DataFrame:
    """A prompt body for each batch of long sentences: `--- Segment n ---` and the text, a blank line between."""
    rows = batched.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(at, column))).alias("r"))
    return rows.select(batch, F.array_join(F.transform("r", lambda x: F.concat(F.lit("--- Segment "), x[at].cast("string"), F.lit(" ---\n"), x[column])), "\n\n").alias("prompt"))


#: Texts of a speaker that a prompt shows, and characters of these.
SPEAKER_SAMPLES, SPEAKER_CHARS = 20, 1200


def speaker_prompts(segments: DataFrame, file: str = "file", at: str = "idx") -> DataFrame:
    """A prompt body for each file: `--- SPEAKER ---` and evenly spaced texts of each known speaker, in order of names.

    Places are counted by windows, so that only the texts shown are gathered.
    """
    known = segments.where("speaker <> 'UNKNOWN'")
    by = Window.partitionBy(file, "speaker")
    placed = known.withColumns({"__i": F.row_number().over(by.orderBy(at)) - 1, "__n": F.count(F.lit(1)).over(by)})
    turn = F.floor((F.col("__i") * SPEAKER_SAMPLES + F.col("__n") - 1) / F.col("__n"))
    shown = placed.where((F.col("__n") <= SPEAKER_SAMPLES) | (F.floor(turn * F.col("__n") / SPEAKER_SAMPLES) == F.col("__i")) & (turn < SPEAKER_SAMPLES))
    one = shown.groupBy(file, "speaker").agg(F.array_sort(F.collect_list(F.struct("__i", "text"))).alias("r"))
    body = F.left(F.array_join(F.transform("r", lambda x: x["text"]), "\n"), F.lit(SPEAKER_CHARS))
    heads = one.select(file, F.struct("speaker", F.concat(F.lit("--- "), F.col("speaker"), F.lit(" ---\n"), body).alias("text")).alias("s"))
    return heads.groupBy(file).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["text"]), "\n\n").alias("prompt"))
