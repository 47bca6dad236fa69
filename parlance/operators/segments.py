"""Quality of transcripts by their segments: text, speakers, time, anomalies and the overall grade.

Segments have file, idx, speaker, start, end (seconds) and text; scores are 0 to 100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions.text import ngrams, share, strip, words
from parlance.operators.ordered import gaps, tail_k

# Filler words (those of two words can't match a single token) and the caption patterns.
FILLERS = ["um", "uh", "ah", "er", "erm", "hmm", "mm-hmm", "uh-huh", "like", "you know", "i mean", "sort of", "kind of", "actually", "basically", "literally", "right", "okay", "so", "well"]
CAPTION = r"^[A-Z\s]+$|^♪.+♪$|^\[.*\]$"
ODD_CHARACTER = r"""[^\p{L}\p{N}_\s.,!?;'"-]"""


def step(value: Column, *limits: tuple[float, float], below: bool = False) -> Column:
    """The deduction of the first limit that value is over (or below)."""
    out = None
    for limit, points in limits:
        test = value < limit if below else value > limit
        out = F.when(test, points) if out is None else out.when(test, points)
    return out.otherwise(0)


def is_caption(text: Column) -> Column:
    return F.regexp_like(text, F.lit(CAPTION))


def text_quality(segments: DataFrame, duration: DataFrame) -> DataFrame:
    """Rates of speech, short, empty, filler and caption segments by file. duration: file, duration."""
    t = segments.select("file", strip(F.coalesce("text", F.lit(""))).alias("t"))
    t = t.withColumn("w", words(F.lower("t")))
    bare = F.transform("w", lambda w: F.btrim(w, F.lit(".,!?;:\"'")))
    t = t.select("file", "t", F.size("w").alias("n"), F.size(F.filter(bare, lambda w: w.isin(FILLERS))).alias("fillers"))
    agg = t.groupBy("file").agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum("n").alias("total_words"),
        F.count_if(F.col("n") <= 2).alias("short_segments"),
        F.count_if(F.col("n") == 0).alias("empty_segments"),
        F.sum("fillers").alias("filler_words"),
        F.count_if(is_caption(F.col("t"))).alias("caption_segments"),
        F.count_if(F.regexp_like("t", F.lit(r"[^\x00-\x7F]"))).alias("non_english_segments"),
    ).join(duration, "file", "left")
    c = F.col
    wps = F.when(c("duration") > 0, c("total_words") / c("duration")).otherwise(0.0)
    short, empty, filler = share(c("short_segments"), c("segments")), share(c("empty_segments"), c("segments")), F.coalesce(share(c("filler_words"), c("total_words")), F.lit(0.0))
    # the branch for fillers over a quarter can't be reached behind that over 0.15
    score = 100 - F.when(wps < 1, 15).when(wps > 5, 10).otherwise(0) - step(short, (0.5, 20), (0.3, 10)) - step(empty, (0.05, 15)) - step(filler, (0.15, 10)) - F.when(c("non_english_segments") > 0, 10).otherwise(0)
    flags = F.array_compact(F.array(F.when(wps < 1, "WARN:very_low_wps").when(wps > 5, "WARN:high_wps"), F.when(short > 0.5, "FAIL:excessive_short_segments").when(short > 0.3, "WARN:many_short_segments"), F.when(filler > 0.2, "WARN:high_filler_ratio")))
    return agg.select("file", "segments", "total_words", "short_segments", "empty_segments", "filler_words", "caption_segments", "non_english_segments", F.greatest(score, F.lit(0)).alias("text_score"), flags.alias("text_flags"))


def speaker_shares(segments: DataFrame) -> DataFrame:
    """file and its speakers as `speaker=segments`, the most first; equal ones by name."""
    n = segments.groupBy("file", "speaker").agg(F.count(F.lit(1)).alias("n"))
    one = n.groupBy("file").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "speaker"))).alias("r"))
    return one.select("file", F.array_join(F.transform("r", lambda x: F.concat(x["speaker"], F.lit("="), (-x["less"]).cast("string"))), ",").alias("shares"))


def diarization_stability(segments: DataFrame) -> DataFrame:
    """Speakers, very short segments, unknown share, change rate and spread of durations by file."""
    c = F.col
    w = W.partitionBy("file").orderBy("idx")
    s = segments.withColumn("d", c("end") - c("start")).withColumn("change", F.when(F.lag(F.lit(1)).over(w).isNotNull() & ~c("speaker").eqNullSafe(F.lag("speaker").over(w)), 1).otherwise(0))
    agg = s.groupBy("file").agg(F.count(F.lit(1)).alias("segments"), F.count_distinct(F.coalesce("speaker", F.lit("\0"))).alias("speakers"), F.count_if(c("d") < 1).alias("very_short"), F.count_if(c("speaker") == "UNKNOWN").alias("unknown"), F.sum("change").alias("changes"), F.avg("d").alias("mean_d"), F.stddev_pop("d").alias("sd_d"))
    short, unknown, rate = share(c("very_short"), c("segments")), share(c("unknown"), c("segments")), share(c("changes"), c("segments"))
    cv = F.when(c("mean_d") > 0, c("sd_d") / c("mean_d")).otherwise(0.0)
    score = 100 - F.when(c("speakers") == 1, 10).when(c("speakers") >= 8, 25).when(c("speakers") >= 6, 10).otherwise(0) - step(short, (0.2, 20), (0.1, 10)) - step(unknown, (0.3, 25), (0.1, 10)) - step(rate, (0.6, 15)) - step(cv, (2.0, 10))
    flags = F.array_compact(
        F.array(
            F.when(c("speakers") >= 8, "FAIL:too_many_speakers").when(c("speakers") >= 6, "WARN:many_speakers").when(c("speakers") <= 1, "WARN:single_speaker"),
            F.when(unknown > 0.3, "FAIL:high_unknown_ratio").when(unknown > 0.1, "WARN:some_unknown"),
            F.when(short > 0.2, "FAIL:excessive_short_segments").when(short > 0.1, "WARN:many_short_segments"),
            F.when(rate > 0.6, "WARN:high_turn_rate"),
        )
    )
    return agg.select("file", "speakers", "very_short", "unknown", "changes", F.round("mean_d", 6).alias("mean_duration"), F.round(cv, 6).alias("duration_cv"), F.greatest(score, F.lit(0)).alias("diarization_score"), flags.alias("diarization_flags"))


def temporal_quality(segments: DataFrame, duration: DataFrame) -> DataFrame:
    """Coverage, gaps and overlaps by file; overlaps may lift coverage over 1; without a duration the score is 0."""
    c = F.col
    g = gaps(segments, "file", "start", "end", ["idx"])
    agg = g.groupBy("file").agg(F.sum(c("end") - c("start")).alias("covered"), F.sum("gap").alias("total_gap"), F.max("gap").alias("max_gap"), F.count_if(c("gap") > 0).alias("n_gaps"), F.sum("overlap").alias("total_overlap"), F.count_if(c("overlap") > 0).alias("n_overlaps")).join(duration, "file", "left")
    coverage, gap, over = (share(c(x), c("duration")) for x in ("covered", "total_gap", "total_overlap"))
    score = 100 - step(coverage, (0.5, 30), (0.7, 15), below=True) - step(gap, (0.2, 20), (0.1, 10)) - step(c("max_gap"), (30, 15), (10, 5)) - step(over, (0.05, 10))
    flags = F.array_compact(F.array(F.when(coverage < 0.5, "FAIL:low_coverage").when(coverage < 0.7, "WARN:moderate_coverage"), F.when(gap > 0.2, "FAIL:large_gaps").when(gap > 0.1, "WARN:some_gaps"), F.when(c("max_gap") > 30, "WARN:long_silence"), F.when(over > 0.05, "WARN:overlap")))
    some = c("duration") > 0
    return agg.select("file", F.round(coverage, 3).alias("coverage"), F.round("total_gap", 2).alias("total_gap"), F.round("max_gap", 2).alias("max_gap"), "n_gaps", F.round("total_overlap", 2).alias("total_overlap"), "n_overlaps", F.when(some, F.greatest(score, F.lit(0))).otherwise(0).alias("temporal_score"), F.when(some, flags).otherwise(F.array(F.lit("FAIL:no_data"))).alias("temporal_flags"))


def repeated_trigrams(segments: DataFrame, least: int = 5) -> DataFrame:
    """file, trigram, n of the three-word runs that a file's whole text has at least `least` times."""
    rows = segments.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.lower(strip(F.coalesce("text", F.lit("")))).alias("t")))), lambda x: x["t"]), " ").alias("t"))
    grams = rows.select("file", F.explode(ngrams(words(F.col("t")), 3)).alias("trigram"))
    return grams.groupBy("file", "trigram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def anomaly_quality(segments: DataFrame) -> DataFrame:
    """Odd patterns by file; trailing captions are told but don't cost points."""
    c = F.col
    s = segments.withColumn("t", strip(F.coalesce("text", F.lit("")))).withColumn("d", c("end") - c("start"))
    agg = s.groupBy("file").agg(
        F.count_if((F.char_length("t") > 50) & ~F.contains("t", F.lit(" "))).alias("long_words"),
        F.count_if(F.regexp_like("t", F.lit(ODD_CHARACTER))).alias("odd_characters"),
        F.count_if((c("d") < 0.5) & (c("t") != "")).alias("ultrashort"),
        F.count_if(c("d") > 30).alias("overlong"),
    )
    tail = tail_k(s.select("file", "idx", "t"), ["file"], ["idx"], 5).groupBy("file").agg(F.count_if(is_caption(c("t"))).alias("tail_captions"))
    tri = repeated_trigrams(segments).groupBy("file").agg(F.count(F.lit(1)).alias("trigrams"))
    out = agg.join(tail, "file").join(tri, "file", "left").withColumn("trigrams", F.coalesce("trigrams", F.lit(0)))
    rules = [(c("trigrams") > 0, F.concat(F.lit("WARN:repeated_trigrams:"), c("trigrams").cast("string"))), (c("long_words") > 3, F.lit("WARN:long_word_segments")), (c("odd_characters") > 5, F.lit("WARN:special_characters")), (c("ultrashort") > 10, F.lit("WARN:ultrashort_with_text")), (c("overlong") > 3, F.lit("WARN:long_segments_no_change"))]
    score = F.lit(100)
    for test, _ in rules:
        score = score - F.when(test, 15).otherwise(0)
    flags = F.array_compact(F.array(*(F.when(t, f) for t, f in rules), F.when(c("tail_captions") >= 3, F.lit("INFO:trailing_captions"))))
    return out.select("file", "trigrams", "long_words", "odd_characters", "ultrashort", "overlong", "tail_captions", F.greatest(score, F.lit(0)).alias("anomaly_score"), flags.alias("anomaly_flags"))


#: The weights of the four scores.
WEIGHTS = {"text": 0.30, "diarization": 0.35, "temporal": 0.20, "anomaly": 0.15}


def overall_grade(segments: DataFrame, duration: DataFrame) -> DataFrame:
    """The weighted score, grade and flag counts of each file. All parts are grouped by file alike."""
    parts = text_quality(segments, duration).join(diarization_stability(segments), "file").join(temporal_quality(segments, duration), "file").join(anomaly_quality(segments), "file")
    score = sum((F.col(f"{p}_score") * w for p, w in WEIGHTS.items()), F.lit(0.0))
    flags = F.concat(*(F.col(f"{p}_flags") for p in WEIGHTS))
    n = lambda kind: F.size(F.filter("flags", lambda f: F.startswith(f, F.lit(kind)))).alias(f"{kind.lower()}s")
    out = parts.select("file", *(f"{p}_score" for p in WEIGHTS), F.round(score, 6).alias("overall"), flags.alias("flags"))
    grade = F.when(F.col("overall") >= 80, "GOOD").when(F.col("overall") >= 60, "FAIR").when(F.col("overall") >= 40, "POOR").otherwise("BAD")
    return out.select("file", *(f"{p}_score" for p in WEIGHTS), F.round("overall", 2).alias("overall_score"), grade.alias("grade"), n("FAIL"), n("WARN"))


def speaker_words(segments: DataFrame, unknown: str | None = "UNKNOWN") -> DataFrame:
    """Words and first segment of each speaker of a file, without the unknown one; a null speaker counts as a speaker."""
    s = segments if unknown is None else segments.where(~F.col("speaker").eqNullSafe(F.lit(unknown)))
    return s.groupBy("file", "speaker").agg(F.sum(F.size(words(F.col("text")))).cast("long").alias("n_words"), F.min("idx").alias("first_idx"))


def guest(segments: DataFrame, ratio_below: float = 0.3) -> DataFrame:
    """The speaker with most words (the first of equals) and the rule that names them: alone, well ahead of one other, or left to a provider."""
    s = speaker_words(segments)
    top = s.groupBy("file").agg(F.array_sort(F.collect_list(F.struct((-F.col("n_words")).alias("neg"), "first_idx", "speaker"))).alias("r"), F.sum("n_words").alias("total_words"))
    n = F.size("r")
    first, second = -F.col("r")[0]["neg"], -F.get("r", F.lit(1))["neg"]
    ratio = F.when(n == 2, second / F.greatest(first, F.lit(1)))
    method = F.when(n == 1, "single").when((n == 2) & (ratio < ratio_below), "duration").otherwise("provider")
    return top.select("file", F.col("r")[0]["speaker"].alias("target"), method.alias("method"), n.alias("n_speakers"), "total_words", first.alias("guest_words"))


def guest_hosted(segments: DataFrame, ratio_below: float = 0.25) -> DataFrame:
    """The hosted variant: the speaker with fewest words, not the second, is held against the first."""
    s = speaker_words(segments, unknown=None)
    agg = s.groupBy("file").agg(F.count(F.lit(1)).alias("n_speakers"), F.max("n_words").alias("most"), F.min("n_words").alias("least"), F.min(F.struct((-F.col("n_words")).alias("neg"), "first_idx", "speaker"))["speaker"].alias("target"))
    ratio = F.col("least") / F.greatest("most", F.lit(1))
    return agg.select("file", "target", F.when(F.col("n_speakers") == 1, "single_speaker").when(ratio < ratio_below, "duration_clear").otherwise("duration_ambiguous").alias("method"), "n_speakers", "most", "least")


def guest_text(segments: DataFrame) -> DataFrame:
    """file, speaker and that speaker's texts joined by line breaks, in order."""
    rows = segments.groupBy("file", "speaker").agg(F.array_sort(F.collect_list(F.struct("idx", strip(F.coalesce("text", F.lit(""))).alias("t")))).alias("r"))
    return rows.select("file", "speaker", F.array_join(F.transform("r", lambda x: x["t"]), "\n").alias("text"))


def chunks(files: DataFrame, length: float = 1800.0) -> DataFrame:
    """file, chunk, start and end of the parts of files longer than `length` seconds; one part for others."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration") / length))
    rows = files.select("file", "duration", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    return rows.select("file", "chunk", (F.col("chunk") * length).alias("start"), F.least((F.col("chunk") + 1) * length, F.col("duration")).alias("end"))
