"""Streaming forms: incremental labels with a watermark, and the work manifest as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from parlance.operators.state import MAX_RETRIES


def stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """New files of a folder; `files` at most a trigger keeps batches bounded."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def daily_counts(labels: DataFrame, late: str = "2 days") -> DataFrame:
    """Labels by day and axis value; days close once the watermark passes them."""
    rows = labels.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 day"), "valence", "modality").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "valence", "modality", "n")


def append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, appended once: the checkpoint is the resume set."""
    return df.writeStream.outputMode("append").format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Manifest(StatefulProcessor):
    """The state of one id: failures are counted, and a failed id stays failed beyond the tries."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("manifest", "state string, failures int, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, failures, n = self.state.get() if self.state.exists() else ("pending", 0, 0)
        events = pd.concat(list(rows)).sort_values("seq")["event"]
        failures += int((events == "fail").sum())
        n += len(events)
        last = events.iloc[-1]
        state = "done" if last == "done" else "processing" if last != "fail" else "failed" if failures > MAX_RETRIES else "uploaded"
        self.state.update((state, failures, n))
        yield pd.DataFrame({"id": [key[0]], "state": [state], "failures": [failures], "n": [n]})

    def close(self) -> None:
        pass


def manifest(events: DataFrame) -> DataFrame:
    """Updates of id, state, failures and n from a stream of (id, seq, event); needs the RocksDB state store."""
    events = events.withColumn("id", F.col("id").cast("string"))
    return events.groupBy("id").transformWithStateInPandas(Manifest(), "id string, state string, failures int, n long", "Update", "None")


MANIFEST = "id string, state string, failures int, n long"


def states(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each id that `poll` has written; a batch that was written twice counts once."""
    rows = spark.read.schema(MANIFEST).parquet(path)
    return rows.groupBy("id").agg(F.max_by(F.struct("state", "failures"), "n").alias("s"), F.max("n").alias("n")).select("id", "s.state", "s.failures", "n")


def poll(events: DataFrame, path: str, checkpoint: str, report: Callable[[dict[str, int]], None], every: float | None = 60.0, idle: int = 10) -> dict[str, int]:
    """Follows a stream of events until every id is done, and returns the ids by state.

    A trigger each `every` seconds appends the states that changed to `path`. `report` gets the
    counts after each wait in which something changed, after `idle` quiet ones, and at the end. With
    every=None there is one run over all that is there now. The checkpoint carries on after a crash.
    """
    spark = events.sparkSession
    spark.createDataFrame([], MANIFEST).write.mode("append").parquet(path)
    writer = manifest(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, _: batch.write.mode("append").parquet(path))

    def counted() -> dict[str, int]:
        return {r["state"]: r["count"] for r in states(spark, path).groupBy("state").count().collect()}  # six states

    if every is None:
        writer.trigger(availableNow=True).start().awaitTermination()
        report(counts := counted())
        return counts
    run, before, quiet = writer.trigger(processingTime=f"{every} seconds").start(), None, 0
    try:
        while True:
            run.awaitTermination(every)
            counts = counted()
            quiet = quiet + 1 if counts == before else 0
            finished = bool(counts) and set(counts) == {"done"}
            if counts != before or quiet >= idle or finished:
                report(counts)
                quiet = 0
            if finished or not run.isActive:
                return counts
            before = counts
    finally:
        run.stop()
