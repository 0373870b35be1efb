"""Streams of edits: trailing-edge debounce and latest generations with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(log: DataFrame, key: str, gap_ms: int, lateness: str = "10 minutes") -> DataFrame:
    """The last value of each burst of a stream or table (key, ts, event_id, value); a burst ends ``gap_ms`` after its last event.

    On a stream, a burst is given out once the watermark has passed its end, and its state goes with it.
    """
    burst = F.session_window("ts", f"{gap_ms} milliseconds")
    return log.withWatermark("ts", lateness).groupBy(key, burst.alias("burst")).agg(F.count("*").alias("n"), F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts")).drop("burst")


def windowed_counts(log: DataFrame, kind: str, width: str, slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Events of each kind in windows of time."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return log.withWatermark("ts", lateness).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def first_requests(requests: DataFrame, key: str, lateness: str = "10 minutes") -> DataFrame:
    """The first of several equal requests; later ones within the watermark join it."""
    return requests.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def current_results(results: DataFrame, key: str) -> DataFrame:
    """Results of each key's latest generation; those of superseded ones go."""
    latest = results.groupBy(key).agg(F.max("generation").alias("generation"))
    return results.join(latest, [key, "generation"], "left_semi")


def write_each(stream: DataFrame, path: str, checkpoint: str):
    """A stream written batch by batch, one batch after the other; a repeated batch overwrites its own folder."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
