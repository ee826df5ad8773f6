"""What has to hold at any size: ranges, tiles, blocks and batches cut small, against plain code or the uncut form."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultgrain.operators import dataset, evaluate, models, neighbours, ordering, text, timeseries
from faultgrain.streaming import commits as streams


def test_plans_of_orders_do_not_grow_with_the_ranges(spark):
    rows = spark.range(3000).select("id", (F.col("id") * 7919 % 50).cast("double").alias("key"), (F.col("id") % 2).alias("label"))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    few, many = (ordering.running_sums(rows, "key", "id", {"n": F.lit(1)}, ranges=r) for r in (8, 400))
    assert abs(size(few) - size(many)) < 50
    assert sorted(r.n for r in many.collect()) == list(range(1, 3001))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "Python" not in plan


def test_orders_of_columns_with_nulls(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else float(i), None, 5.0) for i in range(10)], "id long, a double, b double, c double")
    out = {r.column: r for r in dataset.describe(rows, ["a", "b", "c"], tie="id").collect()}
    assert (out["a"]["count"], out["a"].median, out["b"]["count"], out["b"].median, out["c"].median) == (6, 5.0, 0, None, 5.0)
    empty = ordering.positioned(rows.limit(0), F.col("id").asc())
    assert empty.count() == 0 and empty.columns == [*rows.columns, "position"]


def vectors(spark, n: int, seed: int = 1, dims: int = 3):
    r = random.Random(seed)
    centres = [[r.uniform(-20, 20) for _ in range(dims)] for _ in range(5)]
    # a third of all points are one point
    rows = [(i, i % 4, *([1.0] * dims if i % 3 == 0 else [c + r.gauss(0, 1) for c in r.choice(centres)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, label int, " + ", ".join(f"x{k} double" for k in range(dims)))


def test_neighbours_by_pivots_equal_all_pairs(spark):
    rows, df = vectors(spark, 900)
    columns = ["x0", "x1", "x2"]
    asked = df.where("id % 7 = 0").select(F.col("id").alias("q"), *columns)
    counter = spark.sparkContext.accumulator(0)
    for apart, tile in ((False, 2048), (False, 40), (True, 40)):
        got = neighbours.nearest(asked, df, columns, k=4, query="q", key="id", apart=apart, tile=tile, keep=["label"], counter=counter if tile == 40 and not apart else None).collect()
        want = {}
        for q in rows[::7]:
            near = sorted((round(sum((a - b) ** 2 for a, b in zip(q[2:], x[2:])), 9), x[0], x[1]) for x in rows if not apart or x[0] != q[0])[:4]
            want |= {(q[0], place + 1): (i, label) for place, (_, i, label) in enumerate(near)}
        assert {(r.q, r.place): (r.id, r.label) for r in got} == want
    assert 0 < counter.value < 0.7 * len(rows) * asked.count()  # pairs that bounds rule out aren't compared
    odd = spark.createDataFrame([(1, 0.0), (2, None), (3, float("nan")), (4, 3.0)], "id long, x double")
    got = neighbours.nearest(odd.withColumnRenamed("id", "q"), odd, ["x"], k=3, query="q", key="id").collect()
    assert {(r.q, r.id) for r in got} == {(1, 1), (1, 4), (4, 1), (4, 4)}
    assert neighbours.nearest(asked, df.limit(0), columns, k=2, query="q", key="id").count() == 0
    assert neighbours.nearest(asked.limit(0), df, columns, k=2, query="q", key="id").count() == 0


def test_silhouettes_in_tiles_equal_plain_ones(spark):
    rows, df = vectors(spark, 120)
    x, label = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {}
    for i in range(len(rows)):
        others = np.arange(len(rows)) != i
        a = d[i][(label == label[i]) & others].mean()
        b = min(d[i][label == c].mean() for c in set(label) - {label[i]})
        want[i] = (b - a) / max(a, b)
    for tile in (2048, 25):
        got = {r.id: r.silhouette for r in neighbours.silhouettes(df, ["x0", "x1", "x2"], key="id", cluster="label", tile=tile).collect()}
        assert got == pytest.approx(want)


def test_synthetic_numbers_are_what_features_can_be(spark):
    rows = spark.createDataFrame([(1, 1, -5.0, 22.0, 3.7), (2, 1, 9.0, 29.0, 8.9), *((i, 0, 0.0, 0.0, 0.0) for i in range(3, 20))], "id long, label int, lines_added double, hour_of_day double, day_of_week double")
    columns = ["lines_added", "hour_of_day", "day_of_week"]
    out = neighbours.smote(rows, columns, minority=F.col("label") == 1, order_by="id", limits=neighbours.feature_limits(columns)).collect()
    assert len(out) == 15
    for r in out:
        assert r.lines_added >= 0 and r.hour_of_day <= 23 and r.day_of_week <= 6 and r.hour_of_day == int(r.hour_of_day) and r.day_of_week == int(r.day_of_week)
    assert {r.hour_of_day for r in out} >= {22.0, 23.0}


def test_correlations_of_far_values_merged_over_tasks(spark):
    r = random.Random(2)
    rows = [(i % 3, 1.7e9 + r.random(), r.random() * 5, 4.0) for i in range(500)] + [(None, 1.0, 2.0, 3.0), (None, 2.0, 1.0, 3.0), (0, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double").repartition(6)
    got = {(x.g, x.i, x.j): x.r for x in timeseries.correlations(df, ["a", "b", "c"], by="g").collect()}
    assert len(got) == 4 * 9 and got[None, 0, 1] == pytest.approx(-1)
    for g in range(3):
        part = np.array([x[1:3] for x in rows if x[0] == g and x[1] is not None])
        centred = part - part.mean(0)
        want = (centred[:, 0] @ centred[:, 1]) / np.sqrt((centred[:, 0] ** 2).sum() * (centred[:, 1] ** 2).sum())
        assert got[g, 0, 1] == got[g, 1, 0] and math.isclose(got[g, 0, 1], want, abs_tol=1e-6) and got[g, 0, 2] == 0 and got[g, 2, 2] == 1
    assert timeseries.correlation_matrix(df.limit(0), ["a", "b"]).count() == 0


def plain_bm25(docs: dict, queries: dict, k: int) -> dict:
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for q, terms in queries.items():
        scores = {}
        for t in set(terms):
            df = sum(t in d for d in docs.values())
            for i, d in docs.items():
                if t in d:
                    tf = d.count(t)
                    scores[i] = scores.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        top = sorted(((-round(s, 9), i) for i, s in scores.items()))[:k]
        out |= {(q, place + 1): i for place, (_, i) in enumerate(top)}
    return out


def test_search_skips_frequent_terms_and_finds_the_same(spark):
    r = random.Random(7)
    docs = {i: [w for k, w in enumerate(["of", "the", *[f"t{k}" for k in range(40)]]) if r.random() < (0.6 if k < 2 else 0.05)] * r.randint(1, 2) for i in range(400)}
    queries = {100: ["of", "t3", "t4"], 101: ["of", "the"], 102: ["the", "t9", "t9", "none"], 103: ["none"], 104: []}
    frame = lambda d, key: spark.createDataFrame(list(d.items()), f"{key} long, tokens array<string>")
    a, b = frame(docs, "doc_id"), frame(queries, "query_id")
    got = text.bm25_search(a, b, top_k=3).collect()
    assert {(x.query_id, x["rank"]): x.doc_id for x in got} == plain_bm25(docs, queries, 3)
    read = {x.query_id: x.share for x in text.bm25_reading(a, b, top_k=3).collect()}
    assert read[100] < 0.4 and read[102] < 0.4 and 103 not in read  # a term of half the texts isn't read


def test_similar_texts_with_a_term_in_all_of_them(spark):
    r = random.Random(8)
    rows = []
    for i in range(60):
        words = {"all": 1.0} | {f"w{r.randrange(12)}": 1.0 for _ in range(3)}
        norm = math.sqrt(sum(x * x for x in words.values()))
        rows += [(i, w, x / norm) for w, x in words.items()]
    weights = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    bags = {}
    for i, w, x in rows:
        bags.setdefault(i, {})[w] = x
    cos = lambda a, b: round(sum(x * bags[b].get(w, 0) for w, x in bags[a].items()), 9)
    for least in (0.3, 0.7):
        want = {(a, b) for a, b in itertools.combinations(bags, 2) if cos(a, b) >= least}
        for block in (1024, 7):
            assert {(x.a, x.b) for x in text.pairwise_similarity(weights, least=least, block=block).collect()} == want


def test_labeling_functions_of_a_caller(spark):
    df = spark.createDataFrame([(1, 0.9, "x"), (2, 0.1, None), (3, 0.5, "y")], "id int, a double, b string")
    own = [("high", F.when(F.col("a") > 0.8, 1).when(F.col("a") < 0.2, -1)), ("named", F.when(F.col("b") == "x", F.lit(1)).otherwise(F.lit(0)))]
    voted = evaluate.label_functions(df, own)
    assert [(r.vote_high, r.vote_named) for r in voted.orderBy("id").collect()] == [(1, 1), (-1, 0), (0, 0)]
    assert [r.probability for r in evaluate.ensemble_predict(voted).orderBy("id").collect()] == [1, 0, 0.5]
    assert [r.probability for r in evaluate.ensemble_predict(voted, {"vote_named": 1.0}).orderBy("id").collect()] == [1, 0.5, 0.5]
    assert [r.name for r in models.label_model(voted).collect()] == ["vote_high", "vote_named"]
    with pytest.raises(Exception, match="a vote is 1, -1 or 0"):
        evaluate.label_functions(df, [("bad", F.lit(2))]).collect()
    for bad in ([], [("n", F.lit(1)), ("n", F.lit(0))]):
        with pytest.raises(ValueError, match="labeling functions"):
            evaluate.label_functions(df, bad)
    scored = models.calibrated_predict(evaluate.ensemble_predict(voted), scores=["a"]).orderBy("id").first()
    assert [(f.factor, f.share) for f in scored.factors] == [("a", 100)]


def test_coverage_of_intervals(spark):
    rows = spark.createDataFrame([(0.95, 1), (0.5, 0), (0.99, 0), (0.0, 0)], "score double, label int")
    assert evaluate.calibration_metrics(rows).first().coverage == 0.75  # 0.99 leaves 0 outside
    given = evaluate.calibration_metrics(rows, ends=(F.lit(0.5), F.lit(1.0))).first()
    assert given.coverage == 0.25
    none = evaluate.calibration_metrics(rows.limit(0)).first()
    assert (none.brier, none.ece, none.mce, none.coverage) == (1, 1, 1, 0)
    curve = sorted((r.level, r.coverage, r.width) for r in evaluate.coverage_curve(rows).collect())
    assert [c[0] for c in curve] == list(evaluate.LEVELS) and all(a[1] <= b[1] and a[2] <= b[2] for a, b in zip(curve, curve[1:]))


def test_isotonic_fit_over_many_ranges_equals_one(spark):
    from pyspark.ml.regression import IsotonicRegression

    r = random.Random(9)
    rows = [(i, r.randrange(400) / 400, 0) for i in range(3000)]
    rows = [(i, s, int(r.random() < s * s)) for i, s, _ in rows]
    df = spark.createDataFrame(rows, "id long, score double, label int")
    want = {x.id: x.p for x in IsotonicRegression(featuresCol="score", labelCol="label", predictionCol="p").fit(df.withColumn("label", F.col("label").cast("double"))).transform(df).collect()}
    for ranges in (1, 40):
        steps = models.isotonic_steps(df, ranges=ranges)
        got = {x.id: x.calibrated for x in models.isotonic_transform(df, steps).collect()}
        assert got == pytest.approx(want)
    values = [x.value for x in steps.orderBy("low").collect()]
    assert values == sorted(values) and len(values) < 60
    # between and beyond the steps, and without a score
    few = spark.createDataFrame([(0.2, 0), (0.4, 1)], "score double, label int")
    asked = spark.createDataFrame([(1, 0.0), (2, 0.3), (3, 0.9), (4, None)], "id int, score double")
    got = {x.id: x.calibrated for x in models.isotonic_transform(asked, models.isotonic_steps(few)).collect()}
    assert got == {1: 0.0, 2: pytest.approx(0.5), 3: 1.0, 4: None}
    assert models.isotonic_transform(asked, models.isotonic_steps(few.limit(0))).where("calibrated IS NULL").count() == 4


STREAM = "commit_id long, message string, timestamp long, files_changed long, lines_added long, lines_removed long"
DAY = 86_400


def counted(rows) -> dict:
    return {(int(r.start.timestamp()), r.category): r.n for r in rows}


def test_a_stream_restarts_drops_late_rows_and_flushes(spark, tmp_path):
    row = lambda i, day: (i, ["fix memory leak", "deadlock in mutex"][i % 2], 800_000_000 + day * DAY, 1, i, 0)
    rows = [row(i, 3 * i) for i in range(300)]
    every = spark.createDataFrame(rows, STREAM)
    late = spark.createDataFrame([row(1000 + i, i) for i in range(20)], STREAM)  # two years behind when they come
    count = lambda s: streams.stream_window_counts(streams.stream_classify(s))

    def parts():
        slices = list(streams.in_order_of_time(every, slices=4))
        assert sum(s.count() for s in slices) == 300
        yield from slices[:3]
        yield slices[3].unionByName(late)
        yield streams.flush_row(every, after=300 * DAY)

    paths = {name: str(tmp_path / name) for name in ("source", "sink", "state")}
    out = streams.drained(spark, parts(), count, **paths)
    batch = counted(count(every).collect())
    got = out.collect()
    assert counted(got) == batch and len(got) == len(batch)  # late rows count nowhere, and every window came out once
    assert len(list((tmp_path / "state" / "commits").glob("[0-9]*"))) >= 5  # a batch for each part, all from one checkpoint
    # without the last row, the windows that the watermark hasn't passed stay open
    half = {name: str(tmp_path / f"{name}-2") for name in ("source", "sink", "state")}
    open_ended = counted(streams.drained(spark, streams.in_order_of_time(every, slices=2), count, **half).collect())
    assert open_ended.items() < batch.items()
    with pytest.raises(ValueError, match="without any part"):
        streams.drained(spark, streams.in_order_of_time(every.limit(0), slices=2), count, **half)
