"""Compiler diagnostics: categories, classes, import statistics and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultgrain.functions.taxonomy import CATEGORIES, CODE_CATEGORY, CODE_CLASS, CODE_CONFIDENCE, LINT_CATEGORY, OTHER_CLASS, OTHER_CONFIDENCE


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v)))), key)


def map_diagnostics(df: DataFrame) -> DataFrame:
    """Adds category: the given one if it is known, else the compiler code's, else the lint's, else null."""
    given = F.when(F.col("given_category").isin(CATEGORIES), F.col("given_category"))
    return df.withColumn("category", F.coalesce(given, _lookup(CODE_CATEGORY, F.col("error_code")), _lookup(LINT_CATEGORY, F.col("clippy_lint"))))


def diagnostic_class(df: DataFrame) -> DataFrame:
    """Adds the compiler code's confidence and class."""
    code = F.col("error_code")
    return df.withColumns(
        {
            "code_confidence": F.coalesce(_lookup(CODE_CONFIDENCE, code), F.lit(OTHER_CONFIDENCE)),
            "code_class": F.coalesce(_lookup(CODE_CLASS, code), F.lit(OTHER_CLASS)),
        }
    )


def import_stats(df: DataFrame, *, min_confidence: float = 0.75) -> DataFrame:
    """One row: total, imported, skipped for confidence (tested first) or category, and the mean confidence of those imported."""
    low = F.col("confidence") < min_confidence
    known = ~low & F.col("category").isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(known).alias("imported"),
        F.count_if(low).alias("skipped_low_confidence"),
        F.count_if(~low & F.col("category").isNull()).alias("skipped_unknown"),
        F.avg(F.when(known, F.col("confidence"))).alias("avg_confidence"),
    )


def import_counts(df: DataFrame, by: str, *, min_confidence: float = 0.75) -> DataFrame:
    """(by, n): imported diagnostics of each value of a column (category, or source file)."""
    return diagnostics_to_training(df, min_confidence=min_confidence).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def diagnostics_to_training(df: DataFrame, *, min_confidence: float = 0.75) -> DataFrame:
    return df.where((F.col("confidence") >= min_confidence) & F.col("category").isNotNull())
