"""Sliding time windows, correlations in and over them, and their drift."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HALF_YEAR = 6 * 30 * 24 * 3600

#: The numbers of a commit's feature vector, in order.
FEATURES = [
    "defect_category", "files_changed", "lines_added", "lines_deleted", "complexity_delta", "timestamp", "hour_of_day", "day_of_week",
    "error_code_class", "has_suggestion", "suggestion_applicability", "clippy_lint_count", "span_line_delta", "diagnostic_confidence",
]


def _bounds(df: DataFrame, time: str, size: int) -> DataFrame:
    """One row: low, and last, the number of the last full window (below 0: none)."""
    ends = df.agg(F.min(time).alias("low"), F.max(time).alias("high"))
    return ends.select("low", F.floor((F.col("high") - F.col("low") - size) / (size // 2)).alias("last"))


def time_windows(df: DataFrame, *, time: str = "timestamp", size: int = HALF_YEAR) -> DataFrame:
    """(window, start, stop): full windows [start, stop) from the least time on, each half a size after the one before."""
    some = _bounds(df, time, size).where("last >= 0")
    out = some.select("low", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("window"))
    start = F.col("low") + F.col("window") * (size // 2)
    return out.select("window", start.alias("start"), (start + size).alias("stop"))


def in_windows(df: DataFrame, *, time: str = "timestamp", size: int = HALF_YEAR) -> DataFrame:
    """Each row once for each full window that holds it (two at most), with column window."""
    rows = df.join(F.broadcast(_bounds(df, time, size)))  # one row
    half = size // 2
    first = F.greatest(F.floor((F.col(time) - F.col("low") - size) / half) + 1, F.lit(0))
    final = F.least(F.floor((F.col(time) - F.col("low")) / half), F.col("last"))
    return rows.where(first <= final).withColumn("window", F.explode(F.sequence(first, final))).drop("low", "last")


#: Groups whose moments a task holds before it sends them on, and into how many parts a group's moments are first merged.
_HELD, _PARTS = 10_000, 64


def _merged(a: tuple, b: tuple) -> tuple:
    """(rows, means, sums of centred products) of two sets of rows together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _rows_of(held: dict, part: int, names: list[str], key: pa.DataType) -> pa.RecordBatch:
    k = [m[1] for m in held.values()]
    columns = [pa.array(list(held), key), pa.array([part] * len(held), pa.int32()), pa.array([m[0] for m in held.values()], pa.int64())]
    columns += [pa.array([x.tolist() for x in k], pa.list_(pa.float64())), pa.array([m[2].ravel().tolist() for m in held.values()], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names)


def _moments(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    part, key = TaskContext.get().partitionId() % _PARTS, None
    for batch in batches:
        key = batch.column(0).type
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]], 1)
        groups = batch.column(0).dictionary_encode()
        at = groups.indices.fill_null(len(groups.dictionary)).to_numpy(zero_copy_only=False)
        whole = ~np.isnan(x).any(1)
        x, at = x[whole], at[whole]
        values = [*groups.dictionary.to_pylist(), None]
        for g in np.unique(at):
            some = x[at == g]
            mean = some.mean(0)
            centred = some - mean
            own = (len(some), mean, centred.T @ centred)
            held[values[g]] = _merged(held[values[g]], own) if values[g] in held else own
        if len(held) > _HELD:
            yield _rows_of(held, part, names, key)
            held = {}
    if held:
        yield _rows_of(held, part, names, key)


def _added(table: pa.Table) -> tuple:
    rows = [(n, np.array(m), np.array(s).reshape(len(m), -1)) for n, m, s in zip(*(table[c].to_pylist() for c in ("n", "mean", "products")), strict=True)]
    return reduce(_merged, rows)


def _r_rows(table: pa.Table, by: str) -> pa.Table:
    _, _, s = _added(table)
    spread = np.sqrt(np.maximum(np.diag(s), 0))
    product = np.outer(spread, spread)
    r = np.divide(s, product, out=np.zeros_like(s), where=product > 1e-9)
    np.fill_diagonal(r, 1.0)
    k = len(s)
    i, j = np.divmod(np.arange(k * k), k)
    return pa.table({by: pa.concat_arrays([table[by].chunk(0).slice(0, 1)] * (k * k)), "i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "r": pa.array(r.ravel())})


def correlations(df: DataFrame, columns: list[str], *, by: str = "window") -> DataFrame:
    """(by, i, j, r): Pearson's r of every pair of columns in each group; 1 on the diagonal, 0 where one is constant.

    One pass: each task keeps the number of rows, the means and the matrix of centred products of each group, and sends on these alone;
    matrices are merged by the gap of their means, first in parts and then whole, so the digits of epoch seconds don't get lost. Rows with a null
    or NaN in a column don't count. The shuffle has one matrix for each task and group, whatever the number of rows.
    """
    kind = df.schema[by].dataType.simpleString()
    pick = df.select(by, *(F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)))
    names = [by, "fg_part", "n", "mean", "products"]
    schema = f"`{by}` {kind}, fg_part int, n long, mean array<double>, products array<double>"
    parts = pick.mapInArrow(lambda b: _moments(b, names), schema)

    def together(table: pa.Table) -> pa.Table:
        held = {table[by][0].as_py(): _added(table)}
        return pa.Table.from_batches([_rows_of(held, table["fg_part"][0].as_py(), names, table[by].type)])

    merged = parts.groupBy(by, "fg_part").applyInArrow(together, schema)
    return merged.groupBy(by).applyInArrow(lambda t: _r_rows(t, by), f"`{by}` {kind}, i int, j int, r double")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, r) over all rows."""
    return correlations(df.withColumn("fg_all", F.lit(0)), columns, by="fg_all").drop("fg_all")


def category_counts(classified: DataFrame, categories: list[str], *, by: str = "repo") -> DataFrame:
    """One row for each ``by`` with a count of every category, 0 where it doesn't occur."""
    rows = classified.where(F.col("category").isNotNull())
    return rows.groupBy(by).agg(*(F.count_if(F.col("category") == c).alias(c) for c in categories))


def concept_drift(matrices: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """(window, next_window, drift, significant): Frobenius norm between matrices of consecutive windows that have rows."""
    names = matrices.select("window").distinct()
    n = names.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("window")))  # a row for each window
    cells = matrices.join(n, "window")
    after = cells.select((F.col("n") - 1).alias("n"), "i", "j", F.col("r").alias("r2"), F.col("window").alias("next_window"))
    d = F.col("r2") - F.col("r")
    out = cells.join(after, ["n", "i", "j"]).groupBy("window", "next_window").agg(F.sqrt(F.sum(d * d)).alias("drift"))
    return out.withColumn("significant", F.col("drift") > threshold)


def lagged_correlation(classified: DataFrame, first: str, second: str, *, lag: int = 1, step: int = 86400) -> DataFrame:
    """One row: Pearson's r of the count of one category on a day with the count of another ``lag`` days later.

    Every day from the least to the greatest counts, with 0 where nothing happened; days whose partner lies outside go.
    """
    rows = classified.where(F.col("category").isNotNull()).withColumn("day", F.floor(F.col("timestamp") / step))
    ends = rows.agg(F.min("day").alias("low"), F.max("day").alias("high")).where("low IS NOT NULL")
    days = ends.select(F.explode(F.sequence("low", "high")).alias("day"))
    n = rows.groupBy("day").agg(F.count_if(F.col("category") == first).alias("a"), F.count_if(F.col("category") == second).alias("b"))
    filled = days.join(n, "day", "left").select("day", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    pairs = filled.select("day", "a").join(filled.select((F.col("day") - lag).alias("day"), "b"), "day")
    return correlation_matrix(pairs, ["a", "b"]).where("i = 0 AND j = 1").select("r")
