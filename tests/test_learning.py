"""Reviews, graphs, file sources, summaries and fitted models by hand values, plain code and properties."""

import json
import math

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from faultgrain.operators import coverage, dataset, evaluate, graph, models, review, text
from faultgrain.sources import files
from faultgrain.streaming.commits import stream_review


def test_review_thresholds(spark):
    known = spark.createDataFrame(
        [("Configuration Errors", 10, 59.0), ("Integration Failures", 19, 60.0), ("Logic Errors", 20, 99.0)], "category string, frequency long, avg_tdg double"
    )
    changed = spark.createDataFrame([("a.yaml",), ("src/HttpClient.rs",), ("README.md",), (None,)], "file string")
    got = {(r.file, r.category) for r in review.review_changes(changed, known).collect()}
    assert got == {("a.yaml", "Configuration Errors"), ("src/HttpClient.rs", "Logic Errors")}
    assert {r.file for r in review.clean_files(changed, review.review_changes(changed, known)).collect()} == {"README.md", None}
    poor = known.withColumn("avg_tdg", F.lit(None).cast("double"))  # no score counts as 0
    assert review.review_changes(changed, poor).count() == 3


def test_stream_review_equals_batch(spark, tmp_path):
    known = spark.createDataFrame([("Logic Errors", 30, 80.0)], "category string, frequency long, avg_tdg double")
    spark.createDataFrame([("a.rs",), ("b.md",)], "file string").write.parquet(str(tmp_path / "in"))
    stream = stream_review(spark.readStream.schema("file string").parquet(str(tmp_path / "in")), known)
    q = stream.writeStream.format("memory").queryName("s_review").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("s_review").collect()] == [("a.rs", "Logic Errors", 30, 80.0)]


def test_pagerank_sums_to_one_and_spreads_lost_rank(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], "src string, dst string, weight long")
    got = {r.node: r["rank"] for r in graph.pagerank(edges).collect()}
    want = dict.fromkeys("abc", 1 / 3)
    for _ in range(20):
        want = {n: 0.05 + 0.85 * ({"b": want["a"], "c": want["b"]}.get(n, 0) + want["c"] / 3) for n in "abc"}
    assert math.isclose(sum(got.values()), 1) and all(math.isclose(got[n], want[n], rel_tol=1e-9) for n in "abc")
    assert graph.pagerank(edges.where("weight > 1")).count() == 0


def test_levels(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (4, 3), (3, 5)], "src int, dst int")
    seeds = spark.createDataFrame([(1,), (1,), (None,)], "node int")
    assert {r.node: r.level for r in graph.bfs_levels(edges, seeds).collect()} == {1: 0, 2: 1, 4: 1, 3: 2, 5: 3}
    assert {r.node for r in graph.bfs_levels(edges, seeds, max_depth=1).collect()} == {1, 2, 4}


def test_lcov(spark, tmp_path):
    (tmp_path / "x.info").write_text("TN:t\nDA:9,9\nSF:a.rs\nDA:1,5\n DA:2,0\nDA:x,1\nDA:3\nend_of_record\nDA:7,7\nSF:b.rs\nDA:4,1,sum\nend_of_record\n")
    assert sorted(map(tuple, files.read_lcov(spark, str(tmp_path)).collect())) == [("a.rs", 1, 5), ("a.rs", 2, 0), ("b.rs", 4, 1)]


def test_json_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.jsonl").write_text(json.dumps({"message": "m", "confidence": 0.5, "timestamp": 3}) + "\n\n")
    row = files.read_diagnostics_json(spark, str(tmp_path / "d")).collect()
    assert len(row) == 1 and row[0].message == "m" and row[0].error_code is None
    (tmp_path / "n.jsonl").write_text(json.dumps({"message": "m", "kind": "Logic Errors"}) + "\n")
    assert files.read_diagnostics_json(spark, str(tmp_path / "n.jsonl"), names={"given_category": "kind"}).first().given_category == "Logic Errors"
    (tmp_path / "d" / "y.jsonl").write_text("{broken\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.read_diagnostics_json(spark, str(tmp_path / "d")).collect()
    (tmp_path / "t.json").write_text(json.dumps({"files": [{"file_path": "a.rs", "total": 55.5, "grade": "C"}]}, indent=1))
    assert [tuple(r) for r in files.read_tdg(spark, str(tmp_path / "t.json")).collect()] == [("a.rs", 55.5, "C")]
    spark.createDataFrame([("m", 0.5, 7)], "message string, confidence float, extra int").write.parquet(str(tmp_path / "p"))
    rows = files.read_diagnostics_parquet(spark, str(tmp_path / "p"))
    assert "extra" not in rows.columns and rows.first().span is None
    got = {r.field: (r.status, r.nulls) for r in files.validate_diagnostics(spark.read.parquet(str(tmp_path / "p"))).collect()}
    assert got == {"timestamp": ("missing", None), "message": ("required", 0), "confidence": ("required", 0), "extra": ("extra", 0)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1.0), (3, 2.0), (3, None)], "defect_category int, x double")
    files.save_features(rows, str(tmp_path / "f"))
    files.save_features(rows, str(tmp_path / "f"))
    assert files.features_of(spark, str(tmp_path / "f"), 3).count() == 4
    assert tuple(files.export_features(rows, str(tmp_path / "e"), ["x"]).first()) == (3, 1, 2)
    files.write_report(rows, str(tmp_path / "c"), form="csv")
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 3
    with pytest.raises(ValueError):
        files.write_report(rows, str(tmp_path / "z"), form="xml")


def test_summaries(spark):
    rows = spark.createDataFrame([(1, 4.0), (2, 1.0), (3, 3.0), (4, 2.0), (5, None)], "id int, v double")
    r = dataset.describe(rows, ["v"], tie="id").first()
    assert (r["count"], r["mean"], r["min"], r["median"], r["max"]) == (4, 2.5, 1, 3, 4) and math.isclose(r["std"], math.sqrt(1.25))
    assert dataset.describe(rows.where("id = 5"), ["v"], tie="id").first()["median"] is None
    one = spark.createDataFrame([("a", 1)], "file string, line int")
    totals = lambda p, f: spark.createDataFrame([(p, f)], "total_passed long, total_failed long")
    assert coverage.sbfl_confidence(one, totals(5, 0)).first()[0] == 0 and coverage.sbfl_confidence(one, totals(5, 1)).first()[0] == 0
    assert coverage.sbfl_confidence(one.where("line > 1"), totals(5, 5)).first()[0] == 0


def _em(rows, rounds=100):
    """Row by row, with the last step left out once the likelihood settles."""
    w, before = [0.2] * 5, -math.inf
    for _ in range(rounds):
        y = []
        for r in rows:
            up, down = sum(a for a, v in zip(w, r) if v == 1), sum(a for a, v in zip(w, r) if v == -1)
            y.append(up / (up + down) if up + down else 0.5)
        ll = sum(math.log(min(max(p, 1e-10), 1 - 1e-10)) + math.log(1 - min(max(p, 1e-10), 1 - 1e-10)) for p in y)
        if abs(ll - before) < 1e-6:
            break
        before = ll
        for j in range(5):
            cast = [p if r[j] == 1 else 1 - p for p, r in zip(y, rows) if r[j]]
            w[j] = sum(cast) / len(cast) if cast else 0.5
    return [x / sum(w) for x in w]


def test_label_model_equals_the_fit_row_by_row(spark):
    names = [c for c, _, _ in evaluate.LABEL_FUNCTIONS]
    rows = [tuple((i * k % 101) / 100 for k in (7, 13, 29, 31, 37)) for i in range(200)]
    voted = evaluate.label_functions(spark.createDataFrame(rows, [*names]))
    want = _em([tuple(r[f"vote_{n}"] for n in names) for r in voted.collect()])
    got = [r.weight for r in models.label_model(voted).collect()]
    assert all(math.isclose(a, b, rel_tol=1e-6) for a, b in zip(got, want, strict=True)) and math.isclose(sum(got), 1)
    assert models.label_model(voted.limit(0)).count() == 0


def test_interval_and_shares(spark):
    names = [c for c, _, _ in evaluate.LABEL_FUNCTIONS]
    rows = spark.createDataFrame([(1.0, 1.0, 0.0, 0.0, 0.0, 0.0), (0.5, 0.0, 0.0, 0.0, 0.0, 0.0)], ["probability", *names])
    sure, half = models.calibrated_predict(rows).collect()
    assert (sure.low, sure.high, sure.confidence_level) == (1, 1, "High") and [f.share for f in sure.factors] == [100, 0, 0, 0, 0]
    assert (half.low, half.high, half.confidence_level) == (0, 1, "Low") and {f.share for f in half.factors} == {20}


def test_calibration_is_monotone_and_fits_the_last_rows(spark):
    rows = spark.range(200).select("id", ((F.col("id") * 37 % 100) / 100).alias("score"), ((F.col("id") * 37 % 100) >= 60).cast("int").alias("label"))
    got = sorted((r.score, r.calibrated) for r in models.isotonic_calibrate(rows, order_by="id", tie="id").collect())
    assert len(got) == 200 and all(a[1] <= b[1] + 1e-12 for a, b in zip(got, got[1:])) and got[0][1] == 0 and got[-1][1] == 1


def test_clusters(spark):
    rows = spark.createDataFrame([(i, float(i % 2 * 100 + i % 3)) for i in range(30)], "id int, v double")
    found = models.cluster_columns(rows, ["v"], k=2)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.cluster, set()).add(r.id % 2)
    assert sorted(map(sorted, groups.values())) == [[0], [1]]
    assert math.isclose(models.inertia(found).first().inertia, 30 * 2 / 3, rel_tol=1e-6)


def test_text_classifier_and_hybrid(spark):
    rows = [(i, ["memory leak here", "deadlock of threads", "slow query plan"][i % 3], ["M", "C", "P"][i % 3]) for i in range(60)] + [(99, "slow query", None)]
    data = text.tokenize(spark.createDataFrame(rows, "id int, text string, category string"))
    model = models.train_text_classifier(data, trees=10, depth=5)
    top = models.predict_top_n(model, data, key="id", n=2)
    first = {r.id: r.category for r in top.where("place = 0").collect()}
    assert all(first[i] == c for i, _, c in rows if c) and first[99] == "P" and top.count() == 2 * len(rows)
    ruled = data.withColumns({"category": F.lit("R"), "confidence": F.lit(0.8)})
    assert {r.category for r in models.classify_hybrid(ruled, top, key="id", threshold=0.0).collect()} == {"M", "C", "P"}
    assert {r.category for r in models.classify_hybrid(ruled, top, key="id", threshold=1.1).collect()} == {"R"}
