"""Fault localisation from test coverage and line history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LARGEST = 3.4028234663852886e38  # the largest 32-bit float


def combine_coverage(coverage: DataFrame) -> DataFrame:
    """For each executed statement the numbers of passed and failed tests that ran it."""
    test = lambda failed: F.count_distinct(F.when(F.col("failed") == failed, F.col("test_id")))
    return coverage.where("hits > 0").groupBy("file", "line").agg(test(False).alias("passed"), test(True).alias("failed"))


def test_totals(coverage: DataFrame) -> DataFrame:
    """One row: total_passed and total_failed."""
    one = F.count_distinct(F.when(~F.col("failed"), F.col("test_id"))), F.count_distinct(F.when(F.col("failed"), F.col("test_id")))
    return coverage.agg(one[0].alias("total_passed"), one[1].alias("total_failed"))


def _dstar(star: int) -> Column:
    top = F.pow(F.col("failed").cast("double"), F.lit(star))
    low = F.col("passed") + F.greatest(F.col("total_failed") - F.col("failed"), F.lit(0))
    return F.when(low == 0, F.when(top > 0, F.lit(LARGEST)).otherwise(F.lit(0.0))).otherwise(top / low)


def sbfl_scores(statements: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds tarantula, ochiai, dstar2 and dstar3 to (file, line, passed, failed). ``totals`` has one row."""
    rows = statements.join(F.broadcast(totals))  # one row
    f = F.when(F.col("total_failed") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("failed"), F.col("total_failed")))
    p = F.when(F.col("total_passed") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("passed"), F.col("total_passed")))
    root = F.sqrt(F.col("total_failed").cast("double") * (F.col("failed") + F.col("passed")))
    return rows.withColumns(
        {
            "tarantula": F.when(f + p == 0, F.lit(0.0)).otherwise(F.try_divide(f, f + p)),
            "ochiai": F.when(root == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("failed"), root)),
            "dstar2": _dstar(2),
            "dstar3": _dstar(3),
        }
    )


def sbfl_rank(scored: DataFrame, *, formula: str = "tarantula", top_n: int = 10, min_score: float = 0.0) -> DataFrame:
    """The top_n statements by a score, numbered from 1; those below min_score go after numbering."""
    top = scored.orderBy(F.desc(formula), "file", "line").limit(top_n)
    place = Window.partitionBy(F.lit(1)).orderBy(F.desc(formula), "file", "line")  # top_n rows
    return top.withColumn("score", F.col(formula)).withColumn("rank", F.row_number().over(place)).where(F.col("score") >= min_score)


def szz_trace(changed: DataFrame, blame: DataFrame) -> DataFrame:
    """For each fix: introducing commits of its deleted lines (not itself), faulty lines, and the confidence.

    Fixes without a traced line stay, with confidence Low; Medium: several commits; High: one.
    """
    traced = changed.where("was_deleted").join(blame, ["file", "line"])
    hits = traced.groupBy("fix_commit").agg(
        F.sort_array(F.collect_set(F.when(F.col("commit_id") != F.col("fix_commit"), F.col("commit_id")))).alias("introducing"),
        F.sort_array(F.collect_set(F.struct("file", "line"))).alias("faulty_lines"),
    )
    out = changed.select("fix_commit").distinct().join(hits, "fix_commit", "left")
    n = F.coalesce(F.size("introducing"), F.lit(0))
    return out.withColumn("confidence", F.when(n == 1, "High").when(n > 1, "Medium").otherwise("Low"))


def file_history(changed: DataFrame, blame: DataFrame) -> DataFrame:
    """(file, history): faulty lines of each file, once a fix, over the number of fixes; files without any are left out.

    Counted from the lines themselves: no fix's lines are gathered in one row.
    """
    fixes = changed.agg(F.count_distinct("fix_commit").alias("fixes"))
    lines = changed.where("was_deleted").join(blame.select("file", "line"), ["file", "line"]).select("fix_commit", "file", "line").distinct()
    n = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(fixes)).select("file", (F.col("n") / F.col("fixes")).alias("history"))  # one row


def hybrid_rank(ranked: DataFrame, history: DataFrame, *, alpha: float = 0.7) -> DataFrame:
    """Ranks by alpha * score + (1 - alpha) * the file's history, 0 where it has none."""
    both = ranked.join(history, "file", "left")
    score = alpha * F.col("score") + (1 - alpha) * F.coalesce("history", F.lit(0.0))
    out = both.select("file", "line", score.alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "file", "line")))  # of a top-n list


def tdg_by_repo(tdg: DataFrame) -> DataFrame:
    return tdg.groupBy("repo").agg(F.avg("total").alias("avg_tdg"), F.greatest(F.max("total"), F.lit(0.0)).alias("max_tdg"))


def file_churn(changed: DataFrame) -> DataFrame:
    """Commits of each file over those of the file that has most."""
    n = changed.groupBy("file").agg(F.count_distinct("fix_commit").alias("commits"))
    return n.join(F.broadcast(n.agg(F.max("commits").alias("most")))).select("file", (F.col("commits") / F.col("most")).alias("churn"))  # one row


def sbfl_confidence(statements: DataFrame, totals: DataFrame) -> DataFrame:
    """One row: how far a ranking can be trusted, 0..1, from failing tests, their share of all tests and statements covered.

    0 without a failing test (and with one, whose logarithm is 0) or without statements.
    """
    row = statements.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(totals))  # one row each
    failed = F.col("total_failed").cast("double")
    share = failed / (failed + F.col("total_passed"))
    ratio = F.when(share < 0.01, share * 10).when(share > 0.5, 1.5 - share).otherwise(F.lit(1.0))
    value = F.least(F.ln(failed), F.lit(3.0)) / 3 * ratio * F.least(F.ln(F.col("n").cast("double")), F.lit(7.0)) / 7
    return row.select(F.when((failed > 0) & (F.col("n") > 0), F.least(value, F.lit(1.0))).otherwise(F.lit(0.0)).alias("confidence"))
