"""Streaming forms of commit classification; the projections are those of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultgrain.operators.classify import commit_features
from faultgrain.operators.review import review_changes


def stream_classify(commits: DataFrame) -> DataFrame:
    """Classified feature rows of an unbounded stream of commits; stateless."""
    return commit_features(commits)


def stream_window_counts(classified: DataFrame, *, size: str = "180 days", slide: str = "90 days", late: str = "30 days") -> DataFrame:
    """(start, stop, category, n) per sliding event-time window, once the watermark has passed its end.

    The watermark follows the greatest time seen, ``late`` behind it; rows of windows that it has passed are dropped, which bounds the state to
    the windows that are still open. Rows without a category move the watermark on and count nowhere, so one of them (see flush_row) at the end of the input
    brings out the last windows.
    """
    at = classified.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", late)
    # counted, not filtered: a filter on the category would come before the watermark
    n = at.groupBy(F.window("at", size, slide).alias("w"), "category").agg(F.count("category").alias("n"))
    return n.where("n > 0").select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "category", "n")


def flush_row(commits: DataFrame, *, after: int) -> DataFrame:
    """One commit without a message, ``after`` seconds behind the latest: it moves a stream's watermark past all windows of the others."""
    last = commits.agg((F.max("timestamp") + after).alias("timestamp"))
    named = [F.col("timestamp") if c == "timestamp" else F.lit(None).cast(t).alias(c) for c, t in commits.dtypes]
    return last.where("timestamp IS NOT NULL").select(*named)


def in_order_of_time(commits: DataFrame, *, slices: int, time: str = "timestamp") -> Iterator[DataFrame]:
    """The rows in ``slices`` parts of equal spans of time, the earliest first; a part without rows is left out."""
    low, high = commits.agg(F.min(time), F.max(time)).first()
    for k in range(slices if low is not None else 0):
        span = (high - low) / slices
        part = commits.where((F.col(time) >= low + k * span) & ((F.col(time) < low + (k + 1) * span) | F.lit(k == slices - 1)))
        if not part.isEmpty():
            yield part


def drained(spark: SparkSession, parts: Iterator[DataFrame], stream: Callable[[DataFrame], DataFrame], *, source: str, sink: str, state: str) -> DataFrame:
    """All that ``stream`` has made of the parts, each of which is added to the files of ``source`` once the one before is worked off.

    The query ends with each part's batch and starts anew from its checkpoint for the next, as after a failure: state and watermark
    come back from there. Results are appended to the Parquet table ``sink``.
    """
    out = None
    for part in parts:
        part.write.mode("append").parquet(source)
        out = stream(spark.readStream.schema(part.schema).parquet(source))
        out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    if out is None:
        raise ValueError("a stream without any part has no schema")
    return spark.read.schema(out.schema).parquet(sink)


def stream_review(files: DataFrame, known: DataFrame) -> DataFrame:
    """Warnings for an unbounded stream of changed files against a stored baseline."""
    return review_changes(files, known)
