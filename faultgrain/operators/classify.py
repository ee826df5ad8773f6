"""Classification of messages by rules. All of these are projections: no shuffle, no Python."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultgrain.functions.taxonomy import BOOST, CATEGORIES, CEILING, FIX_RULES, NO_FIX, NO_FIX_CATEGORY, RULES, UNKNOWN_FIX


def _float(x: float) -> Column:
    return F.lit(x).cast("float")


def _nothing(text: str) -> Column:
    """0, by a higher-order function.

    A projection that has one is compiled into many small methods. Without it the rules become one method of whole-stage code, which is
    too large for the JVM to compile and runs interpreted, at a third of the speed.
    """
    return F.size(F.filter(F.array(text), lambda _: F.lit(False)))


class _Ranking:
    """Every (rule, number of its patterns found), from the least to the most confident, as number from 1 on; 0: nothing found.

    So a rule's standing is one integer that literals give, and rules are compared without building rows. Confidences
    are FLOAT, in which two boosted rules can differ by a last digit where they would tie in DOUBLE.
    """

    def __init__(self, rules: list[tuple[str, float, list[str]]], *, more_first: bool = False):
        f = np.float32
        found = [(float(min(f(base) + f(n - 1) * f(BOOST), f(CEILING))), n if more_first else 0, -i, n) for i, (_, base, p) in enumerate(rules) for n in range(1, len(p) + 1)]
        self.order = sorted(found)
        self.rules = rules
        self.rank = {(-o[2], o[3]): k for k, o in enumerate(self.order, 1)}

    def _by_rank(self, values: list, none: Column) -> Column:
        return F.array(none, *map(F.lit, values))

    def ranks(self, text: str) -> list[Column]:
        out = []
        for i, (_, _, patterns) in enumerate(self.rules):
            n = sum((F.contains(text, F.lit(p)).cast("int") for p in patterns[1:]), F.contains(text, F.lit(patterns[0])).cast("int"))
            out.append(F.get(F.array(F.lit(0), *(F.lit(self.rank[i, k]) for k in range(1, len(patterns) + 1))), n))
        return out

    def category(self, rank: Column) -> Column:
        return F.get(self._by_rank([self.rules[-o[2]][0] for o in self.order], F.lit(None).cast("string")), rank)

    def confidence(self, rank: Column) -> Column:
        return F.get(self._by_rank([_float(o[0]) for o in self.order], F.lit(None).cast("float")), rank)

    def patterns(self, text: str, rank: Column) -> Column:
        """The patterns of a rank's rule that a text contains, in the order of the rule."""
        rule = F.get(self._by_rank([-o[2] for o in self.order], F.lit(None).cast("int")), rank)
        table = F.array(*(F.array(*map(F.lit, p)) for _, _, p in self.rules))
        return F.filter(F.get(table, rule), lambda p: F.contains(text, p))

    def least(self, confidence: float) -> int:
        """The least rank at or above a confidence."""
        return next((k for k, o in enumerate(self.order, 1) if o[0] >= float(np.float32(confidence))), len(self.order) + 1)


_RANKING, _FIX_RANKING = _Ranking(RULES), _Ranking(FIX_RULES, more_first=True)


def classify_commits(df: DataFrame, *, message: str = "message") -> DataFrame:
    """Adds category, confidence (FLOAT), matched_patterns and explanation; null where nothing matches.

    The highest confidence wins, of equal ones the earlier rule.
    """
    rows = df.withColumn("fg_text", F.lower(message))
    rows = rows.withColumn("fg_best", F.greatest(*_RANKING.ranks("fg_text"), _nothing("fg_text")))
    best = F.col("fg_best")
    out = rows.withColumns({"category": _RANKING.category(best), "confidence": _RANKING.confidence(best)})
    out = out.withColumn("matched_patterns", F.when(best > 0, _RANKING.patterns("fg_text", best))).drop("fg_text", "fg_best")
    percent = F.round(F.col("confidence").cast("double") * 100).cast("int").cast("string")
    text = F.concat(F.lit("Classified as '"), "category", F.lit("' based on patterns: "), F.array_join("matched_patterns", ", "), F.lit(". Confidence: "), percent, F.lit("%"))
    return out.withColumn("explanation", text)


def classify_multi(df: DataFrame, *, message: str = "message", top_n: int = 3, min_confidence: float = 0.60) -> DataFrame:
    """Adds categories: the top_n (category, confidence) at or above min_confidence, best first; and their patterns."""
    least = _RANKING.least(min_confidence)
    rows = df.withColumn("fg_text", F.lower(message)).withColumn("fg_ranks", F.array(*_RANKING.ranks("fg_text"), _nothing("fg_text")))
    # a generator of no row or one, as a filter would be moved below the ranks and evaluate them once more
    enough = F.explode(F.filter(F.array("fg_ranks"), lambda r: F.array_max(r) >= least))
    rows = rows.withColumn("fg_ranks", enough)
    rows = rows.withColumn("fg_ranks", F.filter(F.slice(F.sort_array("fg_ranks", asc=False), 1, top_n), lambda r: r >= least))
    label = lambda r: F.struct(_RANKING.category(r).alias("category"), _RANKING.confidence(r).alias("confidence"))
    out = rows.withColumn("categories", F.transform("fg_ranks", label))
    patterns = F.array_distinct(F.flatten(F.transform("fg_ranks", lambda r: _RANKING.patterns("fg_text", r))))
    return out.withColumn("matched_patterns", patterns).drop("fg_text", "fg_ranks")


def classify_fix_only(df: DataFrame, *, message: str = "message") -> DataFrame:
    """Adds category and confidence (FLOAT) by the 21 finer categories, of messages that fix something.

    The highest confidence wins, of equal ones the rule with more patterns, then the earlier one. Fixes that no rule knows
    are Unknown; other messages, and null, are NotDefect with confidence 0.
    """
    rows = df.withColumn("fg_text", F.coalesce(F.lower(message), F.lit("")))
    rows = rows.withColumn("fg_best", F.greatest(*_FIX_RANKING.ranks("fg_text"), _nothing("fg_text")))
    m, best = F.col("fg_text"), F.col("fg_best")
    fix = m.startswith("fix") | _any([m.contains(p) for p in ("fix:", "bugfix", "hotfix", "patch:")])
    name, sure = UNKNOWN_FIX
    category = F.when(~fix, NO_FIX_CATEGORY).when(best > 0, _FIX_RANKING.category(best)).otherwise(name)
    confidence = F.when(~fix, _float(NO_FIX)).when(best > 0, _FIX_RANKING.confidence(best)).otherwise(_float(sure))
    return rows.withColumns({"category": category, "confidence": confidence}).drop("fg_text", "fg_best")


def explode_labels(df: DataFrame, *, key: str = "commit_id") -> DataFrame:
    """One row for each of a row's categories, of what classify_multi returns."""
    return df.select(key, F.posexplode("categories").alias("place", "label")).select(key, "place", "label.category", "label.confidence")


# fixed values: marks of commits that fix a defect, and of those that are none
NO_WORK_STARTS, NO_WORK_MARKS = ["merge", "revert"], ["wip", "work in progress"]
FIX_STARTS, FIX_MARKS = ["fix:", "bug:", "patch:"], ["fix ", "bug ", "error", "crash", "issue"]


def newest_commits(commits: DataFrame, limit: int, *, key: str = "commit_id") -> DataFrame:
    """The ``limit`` newest commits of each repository; each task keeps no more of a repository before the shuffle."""
    newest = Window.partitionBy("repo").orderBy(F.desc("timestamp"), key)
    return commits.withColumn("fg_place", F.row_number().over(newest)).where(F.col("fg_place") <= limit).drop("fg_place")


def filter_defect_fix(df: DataFrame, *, message: str = "message") -> DataFrame:
    """Messages that fix a defect; merges, reverts and unfinished work are none."""
    m = F.lower(message)
    out = _any([m.startswith(p) for p in NO_WORK_STARTS] + [m.contains(p) for p in NO_WORK_MARKS])
    words = [m.startswith(p) for p in FIX_STARTS] + [m.contains(p) for p in FIX_MARKS]
    return df.where(~out & _any(words))


# fixed values: marks of commits that fix a bug
BUG_FIX_MARKS = ["fix:", "fixes:", "fixed:", "fix(", "bug:", "bugfix:", "hotfix:", "resolve:", "resolves:", "resolved:", "close:", "closes:", "closed:"]


def filter_bug_fix(df: DataFrame, *, message: str = "message") -> DataFrame:
    """Messages with a mark of a bug fix, or with both '#' and a digit."""
    m = F.lower(message)
    return df.where(_any([m.contains(p) for p in BUG_FIX_MARKS]) | (m.contains("#") & m.rlike("[0-9]")))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def encode_label(df: DataFrame, *, category: str = "category") -> DataFrame:
    """Adds label, the category's place in the taxonomy; null for a name that isn't in it."""
    table = F.create_map(*(x for i, c in enumerate(CATEGORIES) for x in (F.lit(c), F.lit(i).cast("tinyint"))))
    return df.withColumn("label", F.try_element_at(table, F.col(category)))


def extract_features(df: DataFrame) -> DataFrame:
    """The numbers of a commit's feature vector; hour and weekday (Monday 0) are UTC. Commits without a time go."""
    at = F.timestamp_seconds("timestamp")
    return df.where(F.col("timestamp").isNotNull()).withColumns(
        {
            "hour_of_day": F.hour(at),
            "day_of_week": F.weekday(at),
            "lines_deleted": F.col("lines_removed"),
            "complexity_delta": F.lit(0.0),
            "error_code_class": F.lit(4).cast("tinyint"),
            "has_suggestion": F.lit(0).cast("tinyint"),
            "suggestion_applicability": F.lit(0).cast("tinyint"),
            "clippy_lint_count": F.lit(0).cast("tinyint"),
            "span_line_delta": F.lit(0.0),
            "diagnostic_confidence": F.lit(0.0),
        }
    )


def commit_features(df: DataFrame, *, unclassified: str = "zero", min_confidence: float = 0.0) -> DataFrame:
    """Classify and extract features. Unclassified commits count as label 0 (``zero``) or go (``drop``)."""
    out = encode_label(classify_commits(df))
    if unclassified == "drop":
        out = out.where(F.col("confidence") >= _float(min_confidence))
    return extract_features(out.withColumn("defect_category", F.coalesce("label", F.lit(0).cast("tinyint"))))
