"""Positions and running sums in a global order, without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultgrain.sources.scratch import scratch_path


def ordered(df: DataFrame, *order: Column, ranges: int | None = None) -> DataFrame:
    """The rows with fg_id, which rises in the given order; its upper bits (fg_part) number the ranges that the rows were dealt to.

    The engine's range sort finds the cuts, so neither the driver nor the plan holds any of them. The sorted table is written once to the shared
    folder: a lost executor doesn't number rows anew. Without ``ranges`` adaptive execution sizes them. Rows that are equal in
    all of the order stay in one range; a last column that tells rows apart lets every key be cut.
    """
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    rows = dealt.sortWithinPartitions(*order).withColumn("fg_id", F.monotonically_increasing_id())
    path = scratch_path(df.sparkSession, "ordered")
    rows.write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path).withColumn("fg_part", F.shiftright("fg_id", 33))


def _offsets(totals: DataFrame, names: list[str]) -> DataFrame:
    """fg_part and, for each name, the sum over the ranges before; totals has a row for each range."""
    before = Window.partitionBy(F.lit(1)).orderBy("fg_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("fg_part", *(F.coalesce(F.sum(f"fg_total_{n}").over(before), F.lit(0)).alias(f"fg_offset_{n}") for n in names))


def positioned(df: DataFrame, *order: Column, name: str = "position", ranges: int | None = None) -> DataFrame:
    """Adds the position, from 0, of each row in the given order: its place within its range and the rows of the ranges before."""
    rows = ordered(df, *order, ranges=ranges)
    offsets = _offsets(rows.groupBy("fg_part").agg(F.count(F.lit(1)).alias("fg_total_n")), ["n"])
    place = F.col("fg_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("fg_offset_n")
    return rows.join(F.broadcast(offsets), "fg_part").select(*(F.col(f"`{c}`") for c in df.columns), place.alias(name))  # a row for each range


def _by_number(key: str, tie: str, descending: bool) -> list[Column]:
    number = F.col(key).cast("double")
    return [(-number if descending else number).asc_nulls_first(), F.col(tie).asc_nulls_first()]


def running_sums(df: DataFrame, key: str, tie: str, sums: dict[str, Column], *, descending: bool = False, ranges: int | None = None) -> DataFrame:
    """Adds, for each name, the sum of a column over all rows up to this one in the order of (key, tie).

    Sums run within a range of the ordered rows, and each range adds the totals of those before it. As the tie takes part, a
    key that many rows share is cut like any other. ``key`` is numeric; rows whose key is null come first.
    """
    rows = ordered(df.withColumns({f"fg_{n}": c for n, c in sums.items()}), *_by_number(key, tie, descending), ranges=ranges)
    offsets = _offsets(rows.groupBy("fg_part").agg(*(F.sum(f"fg_{n}").alias(f"fg_total_{n}") for n in sums)), list(sums))
    inside = Window.partitionBy("fg_part").orderBy("fg_id").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(offsets), "fg_part")  # a row for each range
    out = out.withColumns({n: F.sum(f"fg_{n}").over(inside) + F.col(f"fg_offset_{n}") for n in sums})
    return out.drop("fg_id", "fg_part", *(f"fg_{n}" for n in sums), *(f"fg_offset_{n}" for n in sums))


def global_index(df: DataFrame, key: str, tie: str, *, descending: bool = False, ranges: int | None = None) -> DataFrame:
    """Adds position, from 0, of each row in the order of (key, tie)."""
    return positioned(df, *_by_number(key, tie, descending), ranges=ranges)


def dataset_splits(df: DataFrame, *, order_by: str, tie: str) -> DataFrame:
    """Adds split: the first 70 % of rows (rounded down) are train, the next 15 % (rounded down) validation, the rest test."""
    rows = global_index(df, order_by, tie).join(F.broadcast(df.agg(F.count(F.lit(1)).alias("fg_n"))))  # one row
    train, validation = F.expr("fg_n * 70 div 100"), F.expr("fg_n * 15 div 100")
    place = F.when(F.col("position") < train, "train").when(F.col("position") < train + validation, "validation").otherwise("test")
    return rows.withColumn("split", place).drop("fg_n")
