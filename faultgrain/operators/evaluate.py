"""Measures of predictions (score in 0..1, label 0 or 1), labeling functions and their ensemble."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultgrain.operators.ordering import running_sums


def classification_metrics(df: DataFrame, *, predicted: str = "predicted", label: str = "label") -> DataFrame:
    """Precision, recall and F1 of each class that is predicted or occurs (0 on an empty denominator), and the accuracy."""
    table = df.groupBy(F.col(predicted).alias("p"), F.col(label).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    sides = table.select(F.explode(F.array_distinct(F.array("p", "t"))).alias("class"), "p", "t", "n")
    hit, p, t = ((F.col("p") == F.col("class")) & (F.col("t") == F.col("class")), F.col("p") == F.col("class"), F.col("t") == F.col("class"))
    part = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    sums = sides.groupBy("class").agg(part(hit).alias("tp"), part(p).alias("said"), part(t).alias("real"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    out = sums.withColumns({"precision": rate("tp", "said"), "recall": rate("tp", "real")})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    accuracy = table.agg((F.sum(F.when(F.col("p") == F.col("t"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return out.withColumn("f1", f1).join(F.broadcast(accuracy)).select("class", "precision", "recall", "f1", "accuracy")  # one row


def focal_loss(df: DataFrame, *, gamma: float = 2.0, alpha: float = 1.0) -> DataFrame:
    """One row: mean of -alpha (1 - p)^gamma ln p, p the probability given to the true label, at least 1e-7."""
    p = F.greatest(F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score")), F.lit(1e-7))
    return df.agg(F.avg(-alpha * F.pow(1 - p, F.lit(gamma)) * F.ln(p)).alias("loss"))


def prefix_sums(df: DataFrame, *, tie: str) -> DataFrame:
    """Adds tp and fp, running counts by falling score."""
    hit = F.col("label").cast("long")
    return running_sums(df, "score", tie, {"tp": hit, "fp": 1 - hit}, descending=True)


def auprc(df: DataFrame, *, tie: str) -> DataFrame:
    """One row: the sum of precision times the step of recall, by falling score; null without a positive row."""
    step = F.when(F.col("label") == 1, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    return prefix_sums(df, tie=tie).agg(F.try_divide(F.sum(step), F.sum("label")).alias("auprc"))


def precision_at_recall(df: DataFrame, *, tie: str, target: float = 0.8) -> DataFrame:
    """One row: precision at the first row, by falling score, whose recall reaches the target; 0 if none does."""
    rows = prefix_sums(df, tie=tie).join(F.broadcast(df.agg(F.sum("label").alias("all"))))  # one row
    enough = rows.where(F.try_divide(F.col("tp"), F.col("all")) >= target)
    first = F.min_by(F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") + F.col("fp"))
    return enough.agg(F.coalesce(first, F.lit(0.0)).alias("precision"))


def interval(p: Column, deviations: float, variance: float = 1.0) -> tuple[Column, Column]:
    """Low and high end of ``deviations`` standard deviations around a probability, clamped to 0..1."""
    half = deviations * F.sqrt(variance * p * (1 - p))
    return F.greatest(p - half, F.lit(0.0)), F.least(p + half, F.lit(1.0))


def calibration_metrics(df: DataFrame, *, bins: int = 10, ends: tuple[Column, Column] | None = None) -> DataFrame:
    """One row: Brier score, the mean (ece) and greatest (mce) gap of score and label over equal-width bins, and coverage.

    coverage: the share of labels within the predicted interval, whose ends are given or else 1.96 deviations around the score. No rows
    give 1 for the errors and 0 for the coverage.
    """
    low, high = ends or interval(F.col("score"), 1.96)
    placed = df.withColumns({"bin": F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)), "fg_inside": F.col("label").between(low, high).cast("long")})
    error = F.col("score") - F.col("label")
    per = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("s"), F.avg("label").alias("t"), F.sum(error * error).alias("e"), F.sum("fg_inside").alias("i"))
    gap, n = F.abs(F.col("s") - F.col("t")), F.sum("n")
    told = {"brier": F.sum("e") / n, "ece": F.sum(gap * F.col("n")) / n, "mce": F.max(gap), "coverage": F.sum("i") / n}
    return per.agg(*(F.coalesce(c, F.lit(0.0 if name == "coverage" else 1.0)).alias(name) for name, c in told.items()))


#: Nominal levels of a coverage curve.
LEVELS = (0.5, 0.68, 0.8, 0.9, 0.95, 0.99)


def coverage_curve(df: DataFrame, *, levels: tuple[float, ...] = LEVELS, variance: float = 1.0) -> DataFrame:
    """(level, coverage, width): how many labels lie within the intervals of each nominal level, and how wide these are on average.

    An interval of a level spans as many deviations as a normal distribution needs for it. One pass and one row a level reach the
    last task. No rows: no rows.
    """
    ends = {level: interval(F.col("score"), NormalDist().inv_cdf(0.5 + level / 2), variance) for level in levels}
    cells = F.array(*(F.struct(F.lit(level).alias("level"), F.col("label").between(a, b).cast("double").alias("inside"), (b - a).alias("width")) for level, (a, b) in ends.items()))
    rows = df.select(F.explode(cells).alias("x")).select("x.*")
    return rows.groupBy("level").agg(F.avg("inside").alias("coverage"), F.avg("width").alias("width"))


#: fixed values: column, votes 1 above, votes -1 below (none: never)
LABEL_FUNCTIONS = [("sbfl_score", 0.7, 0.2), ("tdg_score", 0.5, 0.2), ("churn_score", 0.9, 0.3), ("complexity_score", 0.7, 0.3), ("rag_similarity", 0.8, None)]

#: A labeling function: its name, and its vote as a column: 1 (defect), -1 (clean), 0 or null (abstains).
Labeler = tuple[str, Column]


def vote(column: str, above: float, below: float | None) -> Column:
    """1 above a threshold, -1 below another, else 0."""
    c = F.when(F.col(column) > above, 1)
    return (c if below is None else c.when(F.col(column) < below, -1)).otherwise(0)


def built_in_functions() -> list[Labeler]:
    """A threshold on each score of a file."""
    return [(c, vote(c, a, b)) for c, a, b in LABEL_FUNCTIONS]


def label_functions(df: DataFrame, functions: list[Labeler] | None = None) -> DataFrame:
    """Adds vote_<name> for each labeling function, built-in ones or a caller's: 1, -1 or 0; a null vote is 0, any other number an error."""
    own = built_in_functions() if functions is None else functions
    if not own or len({n for n, _ in own}) < len(own):
        raise ValueError("labeling functions need names that differ, and there must be one at least")

    def checked(name: str, c: Column) -> Column:
        c = F.coalesce(c.cast("int"), F.lit(0))
        return F.when(c.isin(-1, 0, 1), c).otherwise(F.raise_error(F.lit(f"{name}: a vote is 1, -1 or 0")).cast("int"))

    return df.withColumns({f"vote_{n}": checked(n, c) if functions is not None else c for n, c in own})


def vote_columns(voted: DataFrame) -> list[str]:
    """The votes of a table, in the order of its columns."""
    return [c for c in voted.columns if c.startswith("vote_")]


def ensemble_predict(voted: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds probability: weight of the positive votes over that of all votes cast, 0.5 where none is; equal weights by default.

    weights: by vote column, as label_model gives them. Any number of labeling functions takes part.
    """
    names = vote_columns(voted)
    weights = weights or {n: 1 / len(names) for n in names}
    side = lambda v: sum((F.when(F.col(n) == v, F.lit(w)).otherwise(F.lit(0.0)) for n, w in weights.items()), F.lit(0.0))
    return voted.withColumn("probability", F.coalesce(F.try_divide(side(1), side(1) + side(-1)), F.lit(0.5)))


def file_scores(df: DataFrame, scores: list[str] | None = None) -> DataFrame:
    """The scores of a file, clamped to 0..1: the five built-in ones, or a caller's."""
    return df.withColumns({c: F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(0.0)) for c in scores or [c for c, _, _ in LABEL_FUNCTIONS]})
