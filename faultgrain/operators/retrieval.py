"""Known bugs as a knowledge base: search by words, fixes to suggest, and fault localisation that draws on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultgrain.operators.text import bm25_search, tokenize

#: A known fix's confidence, and how far behind a statement without similar bugs is ranked.
FIX_CONFIDENCE, NO_HIT = 0.7, 100


def bug_tokens(bugs: DataFrame) -> DataFrame:
    """(doc_id, tokens) of bugs (id, title, description, symptoms array, root_cause, fix_pattern), all as one text."""
    text = F.concat_ws("\n\n", "title", "description", F.array_join("symptoms", "\n- "), "root_cause", "fix_pattern")
    return tokenize(bugs.select(F.col("id").alias("doc_id"), text.alias("text"))).drop("text")


def explained(ranked: DataFrame) -> DataFrame:
    """Adds explanation to ranked statements (passed, failed, total_passed, total_failed, score): how many of the tests ran it."""
    percent = lambda n, of: F.when(F.col(of) > 0, F.floor(F.try_divide(F.col(n) * 100.0, F.col(of)))).otherwise(F.lit(0)).cast("string")
    part = lambda n, of: F.concat(percent(n, of), F.lit("% of "), F.lit(f"{n.replace('failed', 'failing').replace('passed', 'passing')} tests ("), F.col(n).cast("string"), F.lit("/"), F.col(of).cast("string"), F.lit(")"))
    text = F.concat(F.lit("Executed by "), part("failed", "total_failed"), F.lit(" and "), part("passed", "total_passed"), F.lit(". Suspiciousness score: "), F.format_string("%.3f", "score"))
    return ranked.withColumn("explanation", text)


def fix_suggestions(found: DataFrame, bugs: DataFrame, *, limit: int | None = None) -> DataFrame:
    """(query_id, rank, bug_id, pattern, example, confidence): the fix of each bug found (query_id, doc_id, rank), ``limit`` a query at most."""
    rows = found.join(bugs.select(F.col("id").alias("doc_id"), "category", "fix_pattern"), "doc_id")
    if limit is not None:
        rows = rows.where(F.col("rank") <= limit)
    pattern = F.concat(F.lit("Fix pattern for "), "category")
    return rows.select("query_id", "rank", F.col("doc_id").alias("bug_id"), pattern.alias("pattern"), F.col("fix_pattern").alias("example"), F.lit(FIX_CONFIDENCE).alias("confidence"))


def fused(strategy: str, score: Column, similarity: Column, rank: Column, *, k: float = 60.0, weight: float = 0.7) -> Column:
    """One score of two: ``rrf`` (reciprocal ranks), ``linear``, ``average`` or ``sbfl`` (the first alone). Ranks count from 0."""
    if strategy == "rrf":
        other = F.when(similarity > 0, rank).otherwise(rank + NO_HIT)
        return F.lit(1.0) / (rank + k) + F.lit(1.0) / (other + k)
    if strategy == "linear":
        return score * weight + similarity * (1 - weight)
    if strategy == "average":
        return (score + similarity) / 2
    if strategy == "sbfl":
        return score
    raise ValueError(f"unknown strategy {strategy!r}")


def rag_localize(ranked: DataFrame, bugs: DataFrame, *, strategy: str = "rrf", similar: int = 5, k: float = 60.0, weight: float = 0.7) -> DataFrame:
    """Adds similarity, n_similar, combined and combined_rank to ranked statements (file, line, score, rank, explanation).

    A statement's file name, line and explanation are searched among the bugs; the mean of its best ``similar`` scores is its
    similarity, 0 without a hit. Only the ranked statements, a short list, are searched for.
    """
    name = F.element_at(F.split("file", "/"), -1)
    text = F.concat_ws(" ", name, F.lit("line"), F.col("line").cast("string"), "explanation")
    asked = tokenize(ranked.select(F.col("rank").alias("query_id"), text.alias("text")))
    found = bm25_search(bug_tokens(bugs), asked, top_k=similar)
    mean = found.groupBy(F.col("query_id").alias("rank")).agg(F.avg("score").alias("similarity"), F.count(F.lit(1)).alias("n_similar"))
    rows = ranked.join(mean, "rank", "left").na.fill({"similarity": 0.0, "n_similar": 0})
    rows = rows.withColumn("combined", fused(strategy, F.col("score"), F.col("similarity"), F.col("rank") - 1, k=k, weight=weight))
    place = Window.partitionBy(F.lit(1)).orderBy(F.desc("combined"), "rank")  # the ranked list
    return rows.withColumn("combined_rank", F.row_number().over(place))
