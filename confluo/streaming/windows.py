"""Structured Streaming: engine extras, and the batch state operators as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type) per window and type; events later than the watermark are dropped by Spark."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def visits(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Visits per user, closed by a pause."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def hysteresis(scores: DataFrame, leave: float = 3.0, enter: float = 5.0) -> DataFrame:
    """Whether each page (path, score, ts) is in, carried over the stream: in from ``enter`` on, out below ``leave``."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        inside = state.get[0] if state.exists else False
        rows = pd.concat(frames).sort_values("ts")
        for s in rows["score"]:
            inside = bool(s >= leave) if inside else bool(s >= enter)
        state.update((inside,))
        yield pd.DataFrame({"path": [key[0]], "indexable": [inside]})

    return scores.groupBy("path").applyInPandasWithState(step, "path string, indexable boolean", "inside boolean", "update", "NoTimeout")


def merged_log(stream: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch of observations (id, content_hash, ...) that the log at ``path`` does not have yet.

    The batch number names the folder, so a repeated batch overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["id", "content_hash"])
        try:
            known = spark.read.schema(fresh.schema).option("recursiveFileLookup", True).parquet(path)
            known = known.where(~F.contains(F.input_file_name(), F.lit(f"/batch-{number:08d}/")))
            fresh = fresh.join(known.select("id", "content_hash").distinct(), ["id", "content_hash"], "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("overwrite").parquet(f"{path}/batch-{number:08d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
