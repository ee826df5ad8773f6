"""Fitted models: text classifier, clusters, label model and calibration."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultgrain.operators.evaluate import LABEL_FUNCTIONS, interval, vote_columns
from faultgrain.operators.ordering import global_index, ordered
from faultgrain.sources.scratch import checkpointed, stored


def train_text_classifier(rows: DataFrame, *, trees: int = 100, depth: int = 20, max_features: int = 1500, seed: int = 42) -> PipelineModel:
    """TF-IDF and a random forest over rows of (tokens, category); rows without a category are left out.

    The rows are stored once, as each stage and each level of the trees' preparation reads them anew.
    """
    stages = [
        StringIndexer(inputCol="category", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep"),
        CountVectorizer(inputCol="tokens", outputCol="tf", vocabSize=max_features),
        IDF(inputCol="tf", outputCol="features"),
        RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed),
    ]
    return Pipeline(stages=stages).fit(stored(rows.where(F.col("category").isNotNull()).select("tokens", "category")))


def classifier_accuracy(model: PipelineModel, rows: DataFrame, *, by: str = "split") -> DataFrame:
    """(by, n, accuracy) of a text classifier on rows of (by, tokens, category); a category it never saw counts as missed."""
    names = F.array(*map(F.lit, model.stages[0].labels))
    known = rows.where(F.col("category").isNotNull()).select(by, "tokens", F.col("category").alias("fg_category"))
    for stage in model.stages[1:]:
        known = stage.transform(known)
    hit = F.coalesce(F.get(names, F.col("prediction").cast("int")) == F.col("fg_category"), F.lit(False))
    return known.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("accuracy"))


def save_classifier(model: PipelineModel, path: str) -> None:
    """Saves all stages, so that what is loaded predicts as the fitted one does."""
    model.write().overwrite().save(path)


def load_classifier(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict_top_n(model: PipelineModel, rows: DataFrame, *, key: str, n: int = 3) -> DataFrame:
    """(key, place, category, confidence): the n likeliest categories of each row of (key, tokens), from place 0 on."""
    names = F.array(*map(F.lit, model.stages[0].labels))
    out = rows.select(key, "tokens")
    for stage in model.stages[1:]:
        out = stage.transform(out)
    p = F.transform(vector_to_array("probability"), lambda x, i: F.struct((-x).alias("less"), F.get(names, i).alias("category")))
    best = F.slice(F.array_sort(F.filter(p, lambda x: x["category"].isNotNull())), 1, n)
    return out.select(key, F.posexplode(best).alias("place", "x")).select(key, "place", "x.category", (-F.col("x.less")).alias("confidence"))


def classify_hybrid(ruled: DataFrame, predicted: DataFrame, *, key: str, threshold: float = 0.6) -> DataFrame:
    """(key, category, confidence, by_model): the model's first category where it is sure enough, else the rules'."""
    first = predicted.where("place = 0").select(key, F.col("category").alias("m_category"), F.col("confidence").alias("m_confidence"))
    rows = ruled.select(key, "category", F.col("confidence").cast("double").alias("confidence")).join(first, key, "left")
    sure = F.coalesce(F.col("m_confidence") >= threshold, F.lit(False))
    return rows.select(
        key,
        F.when(sure, F.col("m_category")).otherwise(F.col("category")).alias("category"),
        F.when(sure, F.col("m_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        sure.alias("by_model"),
    )


def cluster_columns(rows: DataFrame, columns: list[str], *, k: int, seed: int = 42, rounds: int = 100) -> DataFrame:
    """Adds cluster and distance2 (squared, to the nearest centre) of k-means over number columns."""
    placed = VectorAssembler(inputCols=columns, outputCol="fg_features", handleInvalid="skip").transform(rows)
    return _clustered(placed, "fg_features", k, seed, rounds).drop("fg_features")


def semantic_clusters(tokenized: DataFrame, *, k: int, max_features: int = 1000, seed: int = 42, rounds: int = 100) -> DataFrame:
    """Adds cluster and distance2 of k-means over TF-IDF vectors of (tokens), each of length 1."""
    words = CountVectorizer(inputCol="tokens", outputCol="fg_tf", vocabSize=max_features)
    counts = stored(words.fit(tokenized).transform(tokenized))  # every later pass reads the counts, so texts are cut into tokens twice
    stages = [IDF(inputCol="fg_tf", outputCol="fg_weighed"), Normalizer(inputCol="fg_weighed", outputCol="fg_features")]
    placed = Pipeline(stages=stages).fit(counts).transform(counts)
    return _clustered(placed, "fg_features", k, seed, rounds).drop("fg_tf", "fg_weighed", "fg_features")


def _clustered(rows: DataFrame, vector: str, k: int, seed: int, rounds: int) -> DataFrame:
    model = KMeans(featuresCol=vector, predictionCol="cluster", k=k, seed=seed, maxIter=rounds).fit(rows)
    found = model.transform(rows)
    centres = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.clusterCenters()))  # k rows of the vector's length
    gap = F.zip_with(vector_to_array(vector), F.get(centres, F.col("cluster")), lambda a, b: (a - b) * (a - b))
    return found.withColumn("distance2", F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))


def inertia(clustered: DataFrame) -> DataFrame:
    """One row: the sum of squared distances to the nearest centres."""
    return clustered.agg(F.coalesce(F.sum("distance2"), F.lit(0.0)).alias("inertia"))


def label_model(voted: DataFrame, *, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(name, weight): weights of the labeling functions by expectation-maximisation, summing to 1; no rows, no weights.

    Equal rows of votes are counted once and for all, in a table in the shared folder; a round is one aggregation over these
    counts, whose single row, a weight for each function and the likelihood, is all that the driver sees, however many functions
    and patterns there are. It stops when the likelihood settles, without taking the last step.
    """
    names = vote_columns(voted)
    counts = checkpointed(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("fg_n")))
    weights, before = [1 / len(names)] * len(names), -math.inf
    fitted = not counts.isEmpty()
    for _ in range(rounds if fitted else 0):
        side = lambda v: sum((F.when(F.col(c) == v, F.lit(w)).otherwise(F.lit(0.0)) for c, w in zip(names, weights, strict=True)), F.lit(0.0))  # noqa: B023, E731
        rows = counts.select(*names, "fg_n", side(1).alias("up"), side(-1).alias("down"))
        rows = rows.withColumn("p", F.when(F.col("up") + F.col("down") > 0, F.try_divide("up", F.col("up") + F.col("down"))).otherwise(F.lit(0.5)))
        p = F.greatest(F.least("p", F.lit(1 - 1e-10)), F.lit(1e-10))
        fits = [F.sum(F.when(F.col(c) == 1, F.col("fg_n") * F.col("p")).when(F.col(c) == -1, F.col("fg_n") * (1 - F.col("p")))) / F.sum(F.when(F.col(c) != 0, F.col("fg_n"))) for c in names]
        found = rows.agg(F.sum(F.col("fg_n") * (F.ln(p) + F.ln(1 - p))).alias("fg_fit"), *(F.coalesce(f, F.lit(0.5)).alias(c) for c, f in zip(names, fits, strict=True))).first()
        if abs(found["fg_fit"] - before) < tolerance:
            break
        before, weights = found["fg_fit"], [found[c] for c in names]
    total = sum(weights)
    rows = [(n, w / total if total > 0 else w) for n, w in zip(names, weights, strict=True)] if fitted else []
    return voted.sparkSession.createDataFrame(rows, "name string, weight double")


#: Ranges whose blocks are pooled in one task of a level of the tree.
FAN = 16


def _pooled(blocks: pa.Table) -> pa.Table:
    """Neighbouring blocks (low, high, total, weight), in order, pooled until their means rise; ``part`` becomes that of the next level."""
    rows = sorted(zip(*(blocks[c].to_pylist() for c in ("low", "high", "total", "weight")), strict=True))
    out: list[list[float]] = []
    for low, high, total, weight in rows:
        out.append([low, high, total, weight])
        # means compared as products, which are exact for whole numbers
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, high, total, weight = out.pop()
            out[-1][1:] = high, out[-1][2] + total, out[-1][3] + weight
    part = blocks["part"][0].as_py() // FAN
    columns = list(zip(*out, strict=True))
    return pa.table({"part": pa.array([part] * len(out), pa.int64())} | {c: pa.array(v, pa.float64()) for c, v in zip(("low", "high", "total", "weight"), columns, strict=True)})


def isotonic_steps(rows: DataFrame, *, score: str = "score", label: str = "label", ranges: int | None = None) -> DataFrame:
    """(low, high, value): the rising steps of the isotonic fit of label on score.

    Equal scores are summed first. Each range of a range sort pools its neighbours whose means fall; what is left of FAN ranges is pooled together, and so on
    up a tree, which gives the steps of all rows: these are the slopes of the lower hull of the cumulated sums. A range's rows, or the steps that are left
    of FAN ranges, meet in one task; of n rows with labels 0 and 1 no more than about n to the power 2/3 steps can be left. Nothing reaches the driver but
    the number of ranges. Rows without score or label are left out.
    """
    each = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("low"))
    each = each.agg(F.sum(F.col(label).cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    placed = ordered(each, F.col("low").asc(), ranges=ranges)
    schema = "part long, low double, high double, total double, weight double"
    blocks = placed.select((F.col("fg_part") * FAN).alias("part"), "low", F.col("low").alias("high"), "total", "weight")
    parts = (placed.agg(F.max("fg_part")).first()[0] or 0) + 1
    blocks = blocks.groupBy("part").applyInArrow(_pooled, schema)
    while parts > 1:
        blocks = blocks.withColumn("part", F.expr(f"part div {FAN} * {FAN}")).groupBy("part").applyInArrow(_pooled, schema)
        parts = -(-parts // FAN)
    return blocks.select("low", "high", (F.col("total") / F.col("weight")).alias("value"))


def isotonic_transform(rows: DataFrame, steps: DataFrame, *, score: str = "score", name: str = "calibrated") -> DataFrame:
    """Adds the value of the steps at each score, on straight lines between them; beyond the first and last step, theirs. Null without steps or score.

    Rows and ends of steps are range-sorted together; each row takes the end before and after it in its range, or else the nearest of the ranges around.
    """
    end = F.when(F.col("fg_step"), F.struct(F.col("fg_x").alias("x"), F.col("fg_value").alias("v")))
    own = rows.withColumns({"fg_x": F.col(score).cast("double"), "fg_step": F.lit(False), "fg_value": F.lit(None).cast("double")})
    ends = steps.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("fg_x"), F.lit(True).alias("fg_step"), F.col("value").alias("fg_value"))
    placed = ordered(own.unionByName(ends, allowMissingColumns=True), F.col("fg_x").asc(), F.col("fg_step").desc()).withColumn("fg_end", end)
    of = placed.groupBy("fg_part").agg(F.min("fg_end").alias("first"), F.max("fg_end").alias("last"))  # a row for each range
    all_before = Window.partitionBy(F.lit(1)).orderBy("fg_part").rowsBetween(Window.unboundedPreceding, -1)
    all_after = Window.partitionBy(F.lit(1)).orderBy(F.desc("fg_part")).rowsBetween(Window.unboundedPreceding, -1)
    around = of.select("fg_part", F.max("last").over(all_before).alias("fg_before"), F.min("first").over(all_after).alias("fg_after"))
    inside = Window.partitionBy("fg_part").orderBy("fg_id")
    below = F.coalesce(F.max("fg_end").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("fg_before"))
    back = Window.partitionBy("fg_part").orderBy(F.desc("fg_id"))  # a frame that only grows: one that shrinks is summed anew for each row
    above = F.coalesce(F.min("fg_end").over(back.rowsBetween(Window.unboundedPreceding, 0)), F.col("fg_after"))
    out = placed.join(F.broadcast(around), "fg_part").withColumns({"fg_low": below, "fg_high": above}).where("NOT fg_step")
    low, high = F.col("fg_low"), F.col("fg_high")
    line = low["v"] + (high["v"] - low["v"]) * F.try_divide(F.col("fg_x") - low["x"], high["x"] - low["x"])
    exact = F.when(low["x"] == F.col("fg_x"), low["v"])
    value = F.when(F.col("fg_x").isNotNull(), F.coalesce(exact, line, low["v"], high["v"]))
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), value.alias(name))


def isotonic_calibrate(rows: DataFrame, *, order_by: str, tie: str, least_rows: int = 10) -> DataFrame:
    """Adds calibrated: an isotonic fit of label on score over the last fifth of rows, at least ``least_rows``, with lines between its steps."""
    placed = global_index(rows, order_by, tie).join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("fg_n"))))  # one row
    held = placed.where(F.col("position") >= F.col("fg_n") - F.greatest(F.floor(F.col("fg_n") / 5), F.lit(least_rows)))
    return isotonic_transform(rows, isotonic_steps(held))


def calibrated_predict(rows: DataFrame, *, probability: str = "probability", variance: float = 1.0, weights: dict[str, float] | None = None, scores: list[str] | None = None) -> DataFrame:
    """Adds low, high, confidence_level and factors: an interval of 1.96 deviations, its class and each score's share in percent.

    The interval is clamped to 0..1; narrower than 0.15 is High, than 0.30 Medium, else Low. Shares of all-zero scores are equal.
    scores: the columns that the factors come from, the five built-in ones or a caller's; weights are by these.
    """
    names = scores or [c for c, _, _ in LABEL_FUNCTIONS]
    weights = weights or {n: 1 / len(names) for n in names}
    low, high = interval(F.col(probability), 1.96, variance)
    parts = {n: F.abs(F.col(n) * weights[n]) for n in names}
    total = sum(parts.values(), F.lit(0.0))
    share = lambda n: F.when(total > 0, F.try_divide(parts[n], total) * 100).otherwise(F.lit(100.0 / len(names)))
    factors = F.array(*(F.struct(F.lit(n).alias("factor"), share(n).alias("share"), F.col(n).alias("value")) for n in names))
    level = F.when(high - low < 0.15, "High").when(high - low < 0.30, "Medium").otherwise("Low")
    return rows.withColumns({"low": low, "high": high, "confidence_level": level, "factors": factors})
