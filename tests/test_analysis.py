"""Hand values and edge cases of text, time, evaluation, ordering, graph and stream operators."""

import math

import pytest
from pyspark.sql import functions as F

from faultgrain.operators import dataset, evaluate, graph, ordering, text, timeseries
from faultgrain.streaming.commits import stream_classify, stream_window_counts


def test_tokens_and_ngrams(spark):
    rows = spark.createDataFrame([(1, "The Null-pointer in Parser_2"), (2, None), (3, "one")], "doc_id int, text string")
    tokens = text.tokenize(rows)
    out = {r.doc_id: (r.tokens, r.ngrams) for r in text.ngrams(tokens, n=2).collect()}
    assert out[1] == (["null", "pointer", "parser_2"], ["null_pointer", "pointer_parser_2"])
    assert out[2] == ([], []) and out[3] == (["one"], [])
    assert text.tokenize(rows, stop_words=["one"]).where("doc_id = 3").first().tokens == []
    with pytest.raises(ValueError):
        text.ngrams(tokens, n=0)


def test_tfidf_has_length_one(spark):
    rows = text.tokenize(spark.createDataFrame([(1, "x y y"), (2, "y z"), (3, "")], "doc_id int, text string"))
    norms = text.tfidf(rows).groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert {r.doc_id for r in norms} == {1, 2} and all(math.isclose(r.n, 1) for r in norms)


def test_positions_by_hand_and_of_nothing(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("key"))
    for parts in (1, 16):
        got = {r.id: r.position for r in ordering.global_index(rows.repartition(parts), "key", "id").collect()}
        assert got == {i: p for p, i in enumerate(sorted(range(1000), key=lambda i: (i % 7, i)))}
    assert ordering.global_index(rows.where("id < 0"), "key", "id").count() == 0
    splits = ordering.dataset_splits(rows.limit(7), order_by="key", tie="id").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in splits} == {"train": 4, "validation": 1, "test": 2}


def test_correlation_of_equal_opposite_and_constant_columns(spark):
    rows = spark.createDataFrame([(i, -2 * i, 5) for i in range(10)], ["a", "b", "c"])
    got = {(r.i, r.j): r.r for r in timeseries.correlation_matrix(rows, ["a", "b", "c"]).collect()}
    assert math.isclose(got[0, 1], -1) and got[0, 2] == got[2, 1] == 0 and got[2, 2] == 1 and got[0, 1] == got[1, 0]


def test_five_windows_in_three_spans(spark):
    size = timeseries.HALF_YEAR
    rows = spark.createDataFrame([(0,), (3 * size,)], ["timestamp"])
    assert timeseries.time_windows(rows).count() == 5
    assert [r.window for r in timeseries.in_windows(rows).orderBy("window").collect()] == [0]  # the end of the last window is open
    assert timeseries.time_windows(rows.limit(1)).count() == 0


def test_drift(spark):
    cells = spark.createDataFrame([(0, 0, 1, 0.0), (2, 0, 1, 0.0), (5, 0, 1, 0.6)], "window int, i int, j int, r double")
    got = [(r.window, r.next_window, r.drift, r.significant) for r in timeseries.concept_drift(cells).orderBy("window").collect()]
    assert got == [(0, 2, 0.0, False), (2, 5, 0.6, True)]


def test_measures(spark):
    rows = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 0), (3, 0.7, 1), (4, 0.1, 0)], "id int, score double, label int")
    assert math.isclose(evaluate.auprc(rows, tie="id").first().auprc, (1 + 2 / 3) / 2)
    assert math.isclose(evaluate.precision_at_recall(rows, tie="id", target=1.0).first().precision, 2 / 3)
    none = rows.where("label = 0")
    assert evaluate.auprc(none, tie="id").first().auprc is None and evaluate.precision_at_recall(none, tie="id").first().precision == 0
    sure = evaluate.ensemble_predict(evaluate.label_functions(spark.createDataFrame([(0.9, 0.9, 0.95, 0.9, 0.9), (0.5, 0.3, 0.5, 0.5, 0.5)], [c for c, _, _ in evaluate.LABEL_FUNCTIONS])))
    assert [r.probability for r in sure.collect()] == [1.0, 0.5]


def test_merge_and_edges(spark):
    old, new = spark.createDataFrame([(1,)], ["a"]), spark.createDataFrame([(2, 3)], ["a", "b"])
    assert dataset.merge_training(old, new).count() == 2 and dataset.merge_training(old, new, strategy="replace").columns == ["a", "b"]
    with pytest.raises(ValueError):
        dataset.merge_training(old, new, strategy="other")
    changed = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (2, "x"), (2, "z"), (3, "x")], ["fix_commit", "file"])
    got = {(r.source_file, r.target_file): r.weight for r in graph.cochange_edges(changed).collect()}
    assert got == {("x", "y"): 2, ("x", "z"): 1, ("y", "z"): 1}
    assert {tuple(r) for r in graph.cochange_edges(changed, max_files=2).collect()} == {("x", "y", 1)}


def test_streams_equal_batches(spark, tmp_path):
    schema = "commit_id long, message string, timestamp long, files_changed long, lines_added long, lines_removed long"
    rows = [(i, ["fix memory leak", "docs", "deadlock in mutex"][i % 3], 800_000_000 + i * 86_400, 1, i, 0) for i in range(30)]
    batch = spark.createDataFrame(rows, schema)
    batch.write.parquet(str(tmp_path / "in"))

    def drained(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(repr, spark.table(name).collect()))

    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert drained(stream_classify(read()), "s_classified", "append") == sorted(map(repr, stream_classify(batch).collect()))
    counted = stream_window_counts(stream_classify(batch))
    assert counted.count() > 0
    assert drained(stream_window_counts(stream_classify(read())), "s_counts", "append") == []  # no window is over
