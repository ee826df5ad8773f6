"""Reviews of changed files against a baseline of defect categories, and filters of changed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The file names that a category concerns.
CONFIG_ENDS = [".yaml", ".yml", ".toml", ".json", ".env", ".config", ".ini"]
INTEGRATION_PARTS = ["api", "client", "http", "integration", "service"]
CODE_ENDS = [".rs", ".py", ".js", ".ts", ".java", ".go", ".cpp", ".c", ".rb", ".php"]
COSMETIC_STARTS = ["//", "/*", "*", "use ", "import "]


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def file_classes(file: Column) -> Column:
    """The categories whose history matters to a file, as an array."""
    tests = {
        "Configuration Errors": _any([F.endswith(file, F.lit(x)) for x in CONFIG_ENDS]),
        "Integration Failures": _any([F.contains(F.lower(file), F.lit(x)) for x in INTEGRATION_PARTS]),
        "Logic Errors": _any([F.endswith(file, F.lit(x)) for x in CODE_ENDS]),
    }
    return F.array_compact(F.array(*(F.when(t, F.lit(name)) for name, t in tests.items())))


def baseline(patterns: DataFrame, tdg: DataFrame) -> DataFrame:
    """(category, frequency, avg_tdg) over all repositories. patterns: (repo, category, frequency); tdg: (repo, avg_tdg)."""
    rows = patterns.join(tdg.select("repo", "avg_tdg"), "repo", "left")
    return rows.groupBy("category").agg(F.sum("frequency").alias("frequency"), F.avg("avg_tdg").alias("avg_tdg"))


def review_changes(files: DataFrame, known: DataFrame) -> DataFrame:
    """(file, category, frequency, avg_tdg) for each file of a class that went wrong often, or seldom but in poor code.

    Often: 20 times; 10 are enough where the mean quality score is below 60, a missing one being 0. ``known`` has one
    row for each category, so the join sends it to the files. ``files`` may be a stream: nothing is kept between rows.
    """
    quality = F.coalesce("avg_tdg", F.lit(0.0))
    poor = known.where((F.col("frequency") >= 20) | ((F.col("frequency") >= 10) & (quality < 60)))
    classed = files.select("file", F.explode(file_classes(F.col("file"))).alias("category"))
    poor = F.broadcast(poor.select("category", "frequency", quality.alias("avg_tdg")))  # a row for each category
    return classed.join(poor, "category").select("file", "category", "frequency", "avg_tdg")


def clean_files(files: DataFrame, warnings: DataFrame) -> DataFrame:
    """The files without a warning."""
    return files.join(warnings.select("file"), "file", "left_anti")


def filter_cosmetic(changed: DataFrame, file_lines: DataFrame) -> DataFrame:
    """Changed lines (file, line) but blank ones, comments and imports; lines of unknown content stay."""
    rows = changed.join(file_lines.select("file", "line", "content"), ["file", "line"], "left")
    text = F.trim("content")
    plain = (text == "") | _any([F.startswith(text, F.lit(x)) for x in COSMETIC_STARTS])
    return rows.where(~F.coalesce(plain, F.lit(False))).drop("content")
