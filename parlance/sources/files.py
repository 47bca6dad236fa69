"""Readers and writers of the pipeline's files. All go through Spark's readers; nothing is opened from the driver."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.text import squeeze, strip
from parlance.operators.ordered import dedup_consecutive

SEGMENT = "struct<start: double, end: double, speaker: string, text: string>"
SCHEMAS = {
    "search_hit": "id string, title string, upload_date string, duration string, channel string, description string, language string",
    "transcript": f"filename string, language string, duration double, segments array<{SEGMENT}>",
    "manifest": "id string, state string, retries int, speaker string, title string, updated string, m4a_size bigint, error string",
    "corpus": "video_id string, speaker string, sentence_index int, sentence string",
    "annotation": "video_id string, sentence_index int, text string, valence string, modality string",
}


def _unkeyed(part: str):
    """A directory's name, or its value if it is one of a partitioned table (name=value)."""
    return F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), part, 1), r"^[^=]*=", "")


def _named(path) -> object:
    """What a file is called: its stem, or, of a part file, the value of its directory."""
    own = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)*$", 1)
    value = F.regexp_extract(path, r"/[^/=]+=([^/]+)/part-[^/]*$", 1)
    return F.when(value != "", value).otherwise(own)


def _stem():
    return _named(F.col("_metadata.file_path"))


def _parent():
    return _unkeyed(r"([^/]+)/[^/]+$")


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One object a line. strict: a bad line fails the read and a missing path gives no rows; else bad lines are skipped."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if strict and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """key and value of one JSON object of strings, such as the months of videos."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.StringType()))).alias("key", "value"))


def directory_arrays(spark: SparkSession, path: str, schema: str = SCHEMAS["search_hit"], glob: str = "*.json") -> DataFrame:
    """<speaker>/video_list.json: rows of JSON arrays, with the directory as speaker; unreadable files are skipped."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True).select(_parent().alias("speaker"), "value")
    rows = raw.select("speaker", F.explode(F.from_json("value", f"array<struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in schema.split(','))}>>")).alias("r"))
    return rows.select("r.*", "speaker").where("coalesce(id, '') <> ''")


def transcripts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """file (its own filename, or the file's), idx, speaker, start, end, text and duration of transcript documents; those without segments have no rows (transcript_errors has them).

    A file holds a document or an array of them; with `lines`, any number, one a line. These have
    no file of their own and are called by their filename alone. A file each costs a few
    milliseconds and a place in the driver's listing; files of lines are split and read as streams.
    """
    name = F.col("filename") if lines else F.coalesce("filename", _stem())
    raw = spark.read.schema(SCHEMAS["transcript"]).option("multiLine", not lines).option("recursiveFileLookup", "true").json(path).select(name.alias("file"), "duration", F.posexplode("segments").alias("idx", "s"))
    return raw.select("file", "idx", "s.speaker", "s.start", "s.end", "s.text", "duration")


def transcript_errors(spark: SparkSession, path: str) -> DataFrame:
    """file and error of documents that are no transcripts: no JSON object, or one without segments."""
    raw = spark.read.text(path, wholetext=True).select(_stem().alias("file"), F.try_parse_json("value").alias("doc"))
    said = F.when(F.col("doc").isNull() | ~F.startswith(F.schema_of_variant("doc"), F.lit("OBJECT")), "not a JSON object")
    said = said.when(F.try_variant_get("doc", "$.segments", "variant").isNull(), "not a transcription JSON (no 'segments' key)")
    return raw.select("file", said.alias("error")).where("error is not null")


def whole_texts(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """video_id (the file's stem) and its whole text."""
    return spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").text(path, wholetext=True).select(_stem().alias("video_id"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """video_id, sentence_index and sentence: physical lines, of which blank ones count but don't show."""
    rows = whole_texts(spark, path).select("video_id", F.posexplode(F.split("text", "\n")).alias("sentence_index", "s"))
    return rows.select("video_id", "sentence_index", strip(F.col("s")).alias("sentence")).where("sentence <> ''")


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """video_id and paragraph: blocks between blank lines, their lines joined by spaces."""
    rows = whole_texts(spark, path).select("video_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("idx", "p"))
    return rows.select("video_id", "idx", squeeze(F.col("p")).alias("paragraph")).where("paragraph <> ''")


def file_ids(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """Distinct stems of the files of given suffixes; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.endswith("path", F.lit(s))
    return found.where(ends).select(_named(F.col("path")).alias("id")).distinct()


def month_labels(spark: SparkSession, path: str, schema: str = SCHEMAS["annotation"]) -> DataFrame:
    """Labels of <speaker>/<YYYY-MM>.jsonl with speaker and month from the path; files that start with _ are left out."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_]*.jsonl").json(path).select("*", _parent().alias("speaker"), _stem().alias("ym"))


def names(spark: SparkSession, path: str) -> DataFrame:
    """pos and name from .jsonl (field speaker), .json (a list) or text (a name a line); the first of equal names stays."""
    raw = spark.read.text(path, wholetext=True)
    kind = F.regexp_extract("_metadata.file_path", r"\.([a-z]+)$", 1)
    jsons = F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.get_json_object(x, "$.speaker"))
    listed = F.from_json("value", "array<string>")
    plain = F.filter(F.transform(F.split("value", "\n"), strip), lambda x: x != "")
    every = F.when(kind == "jsonl", jsons).when((kind == "json") | (F.substring(F.trim("value"), 1, 1) == "["), listed).otherwise(plain)
    rows = raw.select(F.posexplode(F.array_distinct(F.filter(F.transform(every, strip), lambda x: x.isNotNull() & (x != "")))).alias("pos", "name"))
    return rows


#: Entities that captions hold.
_ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " "}


def captions(spark: SparkSession, path: str, mode: str = "identity", max_chars: int = 200_000, suffix: str = ".vtt") -> DataFrame:
    """video_id and spoken text of WebVTT files, in three readings.

    identity: entities resolved, tags and `>>` off, lines equal to the one before dropped. plain:
    notes and timings off, tags off, repeated lines kept. audit: whole lines with <c> tags
    dropped, entities resolved, consecutive repeats dropped, joined by line breaks.
    """
    raw = whole_texts(spark, path, suffix)
    value = F.substring("text", 1, max_chars) if mode == "identity" else F.col("text")
    rows = F.filter(F.transform(F.split(value, r"\r?\n"), strip), lambda x: x != "")
    timing = r"-->|^\d{2}:\d{2}:\d{2}\." if mode == "identity" else r"-->|^\d{2}:\d{2}"
    head = r"^WEBVTT$|^Kind:|^Language:" if mode == "identity" else r"^WEBVTT|^NOTE" if mode == "plain" else r"^WEBVTT|^Kind:|^Language:|^NOTE"

    def unescape(x):
        for a, b in reversed(_ENTITIES.items()):  # &amp; last, so that nothing is resolved twice
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    if mode != "plain":
        rows = F.transform(rows, unescape)
    rows = F.filter(rows, lambda x: ~F.regexp_like(x, F.lit(head)) & ~F.regexp_like(x, F.lit(timing)))
    if mode == "audit":
        rows = F.filter(rows, lambda x: ~F.regexp_like(x, F.lit("</?c>")))
    rows = F.transform(rows, lambda x: F.regexp_replace(x, "<[^>]+>", ""))
    if mode == "identity":
        rows = F.transform(rows, lambda x: squeeze(F.replace(x, F.lit(">>"), F.lit(" "))))
    rows = F.filter(F.transform(rows, strip), lambda x: x != "")
    made = raw.select("video_id", rows.alias("l"))
    if mode != "plain":
        made = made.select("video_id", dedup_consecutive(F.col("l")).alias("l"))
    return made.select("video_id", F.array_join("l", "\n" if mode == "audit" else " ").alias("text"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line; the job's committer makes it all or nothing."""
    df.write.mode(mode).json(path)


def write_texts(df: DataFrame, path: str, video: str = "video_id", order: str = "idx", text: str = "sentence") -> None:
    """A directory for each video with its sentences, one a line, in order."""
    rows = df.groupBy(video).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias("value"))
    rows.write.mode("overwrite").partitionBy(video).text(path)


def write_speaker_turns(df: DataFrame, path: str) -> None:
    """[SPEAKER] heads and texts of each file's turns (file, run, speaker, text)."""
    rows = df.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("run", "speaker", "text"))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: F.concat(F.lit("["), F.coalesce(x["speaker"], F.lit("UNKNOWN")), F.lit("]\n"), x["text"])), "\n\n")
    rows.select("file", text.alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def rewritten(df: DataFrame, path: str, backup: str | None = None) -> None:
    """df in place of the folder `path` from which it may itself be read: written beside it, then put there by renames.

    The old folder goes to `backup`, or away. A failed run leaves the old folder or, between the
    renames, both others; nothing is ever half written.
    """
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}.new"
    df.write.mode("overwrite").json(fresh)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    old = backup or f"{path.rstrip('/')}.old"
    fs.delete(at(old), True)
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise OSError(f"{path} can't be moved to {old}")
    if not fs.rename(at(fresh), at(path)):
        raise OSError(f"{fresh} can't be moved to {path}")
    if not backup:
        fs.delete(at(old), True)


def audit_lines(results: DataFrame) -> DataFrame:
    """ord and line of a text report on (domain, speaker, video_id, pos, stage, score, reason): a head for each video, its stages, a blank line."""
    score = F.when(F.col("score") < 0, "?").otherwise(F.col("score").cast("string"))
    stage = F.concat(F.lit("  "), F.col("stage"), F.lit(": score="), score, F.lit("  "), F.coalesce("reason", F.lit("")))
    key = ["domain", "speaker", "video_id"]
    made = results.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", stage.alias("text")))).alias("r"))
    head = F.concat(F.lit("["), F.col("domain"), F.lit("] "), F.col("speaker"), F.lit("/"), F.col("video_id").cast("string"))
    every = F.concat(F.array(head), F.transform("r", lambda x: x["text"]), F.array(F.lit("")))
    rows = made.select(*key, F.posexplode(every).alias("pos", "line"))
    return rows.orderBy(*key, "pos")


def write_report(lines: DataFrame, path: str, title: str = "Pipeline Quality Audit Report") -> None:
    """The lines as one text file under a title. For reports, which a person reads: all lines go through one task."""
    spark = lines.sparkSession
    top = spark.createDataFrame([(0, title), (1, "=" * 60), (2, "")], "n long, line string")
    ordered = lines.withColumn("n", F.monotonically_increasing_id() + 3).select("n", "line")
    top.unionByName(ordered).repartition(1).sortWithinPartitions("n").select("line").write.mode("overwrite").text(path)


def report(df: DataFrame) -> str:
    """A small result (one row a group) as pretty JSON."""
    import json

    return json.dumps([r.asDict(recursive=True) for r in df.collect()], ensure_ascii=False, indent=2, default=str)


def speakers(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-hidden directories that hold a `transcripts` directory with files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"/([^/.][^/]*)/transcripts/[^/]+$", 1).alias("speaker"))
    return found.where("speaker <> ''").distinct()


def crawl_rows(raw: DataFrame, min_seconds: float | None = None, max_seconds: float | None = None) -> DataFrame:
    """Search hits from landed crawl rows (query_idx, pos and the crawler's fields): titles and channels by fallback, the first hit of an id, newest month first.

    The duration limits are strict; they and the columns reach the scan.
    """
    from parlance.functions.text import clock, month
    from parlance.operators.relational import keep_first

    full = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    rows = raw.where(full("id").isNotNull())
    if min_seconds is not None:
        rows = rows.where(F.col("duration") > min_seconds)
    if max_seconds is not None:
        rows = rows.where(F.col("duration") < max_seconds)
    one = keep_first(rows, ["id"], ["query_idx", "pos"])
    out = one.select(
        "id",
        F.trim(F.coalesce(full("fulltitle"), F.col("title"), F.lit(""))).alias("title"),
        month(F.col("upload_date")).alias("upload_date"),
        clock(F.col("duration")).alias("duration"),
        F.coalesce(full("channel"), full("uploader"), F.lit("")).alias("channel"),
        F.left(F.coalesce("description", F.lit("")), F.lit(1000)).alias("description"),
        F.coalesce("language", F.lit("")).alias("language"),
        "query_idx",
        "pos",
    )
    return out.orderBy(F.desc("upload_date"), "query_idx", "pos").drop("query_idx", "pos")


# What a fetch error says of videos that are gone, by what was fetched.
UNAVAILABLE = {
    "captions": r"video unavailable|private video|age.restrict|removed|not available|playback restricted|community guidelines",
    "metadata": r"video unavailable|private video|age\.restrict|removed|not available",
    "audio": r"video unavailable|private video|age.restrict|removed|not available|playback restricted|community guidelines",
}


def fetch_status(error, stage: str = "captions"):
    """unavailable or failed, from what a fetch printed."""
    return F.when(F.regexp_like(F.lower(error), F.lit(UNAVAILABLE[stage])), "unavailable").otherwise("failed")
