"""The retry automaton of the work manifest, in batch form; streaming has the same step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The states, and the tries before a failed item stays failed.
STATES = ["pending", "uploading", "uploaded", "processing", "done", "failed"]
MAX_RETRIES = 3

#: Statuses of videos that each stage leaves out.
EXCLUDED = {
    "captions": ["unavailable", "no_captions", "audio_failed", "filtered"],
    "rules": ["unavailable", "no_captions", "filtered"],
    "selection": ["unavailable", "no_captions", "audio_failed", "filtered"],
}


def open_for(videos: DataFrame, stage: str, have: DataFrame | None = None) -> DataFrame:
    """Videos (id, status, ...) that a stage still has to do: an id, no status that it leaves out (null is none), and not among those it has."""
    rows = videos.where((F.coalesce(F.col("id").cast("string"), F.lit("")) != "") & ~F.coalesce("status", F.lit("")).isin(EXCLUDED[stage]))
    return rows if have is None else rows.join(have.select("id"), "id", "left_anti")


def after(event: Column, failures: Column, max_retries: int = MAX_RETRIES) -> Column:
    """The state that the last event leaves: a failure goes back to uploaded until the tries are used up."""
    return F.when(event == "done", "done").when((event == "fail") & (failures > max_retries), "failed").when(event == "fail", "uploaded").otherwise("processing")


def latest(events: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """id, state, failures and n of events (id, seq, event): one partial aggregate, since only the last event and the failures matter."""
    agg = events.groupBy("id").agg(F.max_by("event", "seq").alias("event"), F.count_if(F.col("event") == "fail").alias("failures"), F.count(F.lit(1)).alias("n"))
    return agg.select("id", after(F.col("event"), F.col("failures"), max_retries).alias("state"), "failures", "n")


def recovered(manifest: DataFrame, uploaded: DataFrame, finished: DataFrame) -> DataFrame:
    """Transient states after a crash, set right by what exists: finished ids are done, uploaded ones uploaded, others pending; done and failed stay."""
    m = manifest.join(uploaded.select("id").distinct().withColumn("up", F.lit(True)), "id", "left").join(finished.select("id").distinct().withColumn("fin", F.lit(True)), "id", "left")
    new = F.when(F.col("fin"), "done").when(F.col("state").isin("done", "failed", "pending"), F.col("state")).when(F.col("up"), "uploaded").otherwise("pending")
    return m.withColumn("state", new).drop("up", "fin")


def reset_failed(manifest: DataFrame) -> DataFrame:
    """Failed ids start anew."""
    failed = F.col("state") == "failed"
    return manifest.withColumns({"state": F.when(failed, "pending").otherwise(F.col("state")), "retries": F.when(failed, 0).otherwise(F.col("retries"))})


def retryable(manifest: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    return manifest.where((F.col("state") == "failed") & (F.col("retries") < max_retries))
