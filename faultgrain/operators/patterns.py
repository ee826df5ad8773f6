"""Patterns, counts and distributions of classified commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultgrain.functions.taxonomy import CATEGORIES


def _means() -> list:
    return [
        F.count(F.lit(1)).alias("frequency"),
        F.avg(F.col("confidence").cast("double")).alias("confidence"),
        F.avg(F.col("lines_added") + F.col("lines_removed")).alias("avg_lines"),
        F.avg("files_changed").alias("avg_files"),
    ]


def defect_patterns(classified: DataFrame, *, examples: int = 3) -> DataFrame:
    """One row for each repository and category: frequency, means, and up to ``examples`` newest examples.

    Each task keeps its newest rows of a group before the shuffle, so no group is gathered whole.
    """
    rows = classified.where(F.col("category").isNotNull())
    stats = rows.groupBy("repo", "category").agg(*_means())
    newest = Window.partitionBy("repo", "category").orderBy(F.desc("timestamp"), "commit_id")
    some = rows.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= examples)
    example = F.struct("place", F.substring("hash", 1, 8).alias("commit_hash"), "message", "author", "timestamp")
    shown = some.groupBy("repo", "category").agg(F.sort_array(F.collect_list(example)).alias("examples"))
    return stats.join(shown, ["repo", "category"])


def strip_pii(patterns: DataFrame) -> DataFrame:
    """Hash and author of every example become REDACTED."""
    hidden = F.transform("examples", lambda e: e.withField("commit_hash", F.lit("REDACTED")).withField("author", F.lit("REDACTED")))
    return patterns.withColumn("examples", hidden)


def summarize(patterns: DataFrame, *, min_frequency: int = 5, top_n: int = 10) -> DataFrame:
    """The most frequent patterns at or above min_frequency."""
    order = [F.desc("frequency"), *(c for c in ("repo", "category") if c in patterns.columns)]
    return patterns.where(F.col("frequency") >= min_frequency).orderBy(*order).limit(top_n)


def org_rollup(classified: DataFrame) -> DataFrame:
    """Patterns of each repository and category, of each repository, and of all; level is 0, 1 or 3."""
    rows = classified.where(F.col("category").isNotNull())
    return rows.rollup("repo", "category").agg(F.grouping_id().alias("level"), *_means())


def count_by_category(classified: DataFrame, *, zeros: bool = True) -> DataFrame:
    """Rows of each category; with ``zeros`` categories that don't occur too."""
    n = classified.where(F.col("category").isNotNull()).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    if not zeros:
        return n
    names = classified.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"))
    return names.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def most_common_defect(classified: DataFrame, *, limit: int = 5) -> DataFrame:
    return count_by_category(classified, zeros=False).orderBy(F.desc("n"), "category").limit(limit)


def defect_distribution(classified: DataFrame) -> DataFrame:
    """category, n and its percent of all classified rows; at most one row a category is gathered for the total."""
    n = count_by_category(classified, zeros=False)
    return n.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))))


def confidence_stats(classified: DataFrame) -> DataFrame:
    c = F.col("confidence").cast("double")
    return classified.where("category IS NOT NULL").agg(
        F.count(c).alias("n"), F.min(c).alias("least"), F.max(c).alias("most"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")
    )


def confidence_histogram(classified: DataFrame, *, bins: int = 5) -> DataFrame:
    """Rows of each equal-width bin from the least to the greatest confidence, which the last bin includes."""
    c = classified.where("category IS NOT NULL").select(F.col("confidence").cast("double").alias("c"))
    ends = c.agg(F.min("c").alias("low"), F.max("c").alias("high"))
    width = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / bins).otherwise(F.lit(1.0))
    placed = c.join(F.broadcast(ends)).select(F.least(F.floor((F.col("c") - F.col("low")) / width), F.lit(bins - 1)).cast("int").alias("bin"))  # one row
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def cross_repo_matrix(classified: DataFrame, repos: list[str]) -> DataFrame:
    """category by repository: percent of the repository's classified rows, 0 where absent."""
    n = classified.where("category IS NOT NULL").groupBy("repo", "category").agg(F.count(F.lit(1)).alias("n"))
    share = n.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("repo")))
    return share.groupBy("category").pivot("repo", repos).agg(F.first("percent")).na.fill(0.0)


def class_weights(labelled: DataFrame, *, label: str = "label") -> DataFrame:
    """rows / (classes * rows of the class), of the classes that occur."""
    n = labelled.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))  # a row for each class
    return n.withColumn("weight", F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n")))


def defect_trend(classified: DataFrame, *, period: str = "month") -> DataFrame:
    """Rows of each category and period, and the change from the category's period before."""
    at = F.unix_timestamp(F.date_trunc(period, F.timestamp_seconds("timestamp")))
    n = classified.where("category IS NOT NULL").groupBy("category", at.alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("change", F.col("n") - F.lag("n").over(Window.partitionBy("category").orderBy("period")))
