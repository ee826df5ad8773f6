"""Assembling training rows: merging, statistics and label numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultgrain.operators.ordering import global_index, positioned


def merge_training(existing: DataFrame, new: DataFrame, *, strategy: str = "append", weight: float = 1.0) -> DataFrame:
    """``append``: both, columns missing on a side null; ``replace``: the new rows; ``weighted``: both, the new with ``weight``, the old with 1."""
    if strategy == "replace":
        return new
    if strategy == "weighted":
        existing, new = existing.withColumn("weight", F.lit(1.0)), new.withColumn("weight", F.lit(float(weight)))
    elif strategy != "append":
        raise ValueError(f"unknown strategy {strategy!r}")
    return existing.unionByName(new, allowMissingColumns=True)


def dataset_stats(rows: DataFrame) -> DataFrame:
    """(category, n, avg_confidence, total): one row for each category, with the number of all rows."""
    n = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("confidence").cast("double")).alias("avg_confidence"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))  # a row for each category


def category_index(rows: DataFrame) -> DataFrame:
    """(category, label): the categories that occur, numbered from 0 by name."""
    names = rows.where(F.col("category").isNotNull()).select("category").distinct()
    return names.withColumn("label", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("category")) - 1)  # a row for each category


def describe(rows: DataFrame, columns: list[str], *, tie: str) -> DataFrame:
    """(column, count, mean, std, min, median, max) over the values that aren't null; std of the population, the upper median.

    Medians come from one global order of (column, value, tie), so no task holds all values and the cost is that of one sort, however many
    columns there are. A column without values has count 0, else nulls. NaN counts as the greatest value.
    """
    one = lambda c: [F.count(c), F.avg(c), F.stddev_pop(c), F.min(c), F.max(c)]
    names = ["count", "mean", "std", "min", "max"]
    pick = rows.select(tie, *(F.col(c).cast("double").alias(c) for c in columns))
    wide = pick.agg(*(x.alias(f"{c}_{n}") for c in columns for n, x in zip(names, one(c), strict=True)))
    item = lambda k, c: F.struct(F.lit(k).alias("fg_column"), F.lit(c).alias("column"), *(F.col(f"{c}_{n}").alias(n) for n in names))
    out = wide.select(F.explode(F.array(*map(item, range(len(columns)), columns))).alias("x")).select("x.*")
    cell = lambda k, c: F.struct(F.lit(k).alias("fg_column"), F.col(c).alias("median"))
    cells = pick.select(F.col(tie).alias("fg_tie"), F.explode(F.array(*map(cell, range(len(columns)), columns))).alias("x")).select("fg_tie", "x.*").where("median IS NOT NULL")
    placed = positioned(cells, F.col("fg_column").asc(), F.col("median").asc(), F.col("fg_tie").asc_nulls_first())
    before = Window.partitionBy(F.lit(1)).orderBy("fg_column").rowsBetween(Window.unboundedPreceding, -1)  # a row for each column
    middles = out.where(F.col("count") > 0).select(F.col("fg_column").alias("fg_of"), (F.coalesce(F.sum("count").over(before), F.lit(0)) + F.expr("count div 2")).alias("position"))
    medians = placed.join(F.broadcast(middles), "position").select(F.col("fg_of").alias("fg_column"), "median")
    return out.join(F.broadcast(medians), "fg_column", "left").select("column", "count", "mean", "std", "min", "median", "max")


def shares(rows: DataFrame, *, by: str = "category") -> DataFrame:
    """(by, n, total, percent), one row for each value."""
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))  # a row for each value
    return n.withColumn("percent", 100 * F.col("n") / F.col("total"))


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n, percent) of each value of each column that isn't null, in one pass; percent of the values that aren't null."""
    cells = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x"))
    n = cells.where("x.value IS NOT NULL").groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("column").agg(F.sum("n").alias("total"))  # a row for each column
    return n.join(F.broadcast(total), "column").select("column", "value", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def repos_since(repos: DataFrame, since: str) -> DataFrame:
    """Repositories updated at or after a time, by stars (ties by name)."""
    return repos.where(F.col("updated_at") >= F.lit(since).cast("timestamp")).orderBy(F.desc("stars"), "name")


def top_repos(repos: DataFrame, *, limit: int = 5) -> DataFrame:
    """The ``limit`` repositories with the most stars; an unknown language shows as Unknown."""
    return repos.orderBy(F.desc("stars"), "name").limit(limit).withColumn("language", F.coalesce("language", F.lit("Unknown")))


def row_ranks(rows: DataFrame, by: str, tie: str, *, run: str | None = None) -> DataFrame:
    """Adds rank, from 1, by falling ``by``: in each ``run``, or over all rows by ranges, without gathering them in one task."""
    if run is not None:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(run).orderBy(F.desc(by), tie)).cast("long"))
    return global_index(rows, by, tie, descending=True).withColumn("rank", F.col("position") + 1).drop("position")
