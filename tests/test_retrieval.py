"""Neighbours, oversampling, silhouettes, clusters, stems, similarity, retrieval and ordering by hand values and plain code."""

import math
import random

import pytest
from pyspark.sql import functions as F

from faultgrain import catalog
from faultgrain.operators import classify, dataset, models, neighbours, ordering, retrieval, text
from faultgrain.operators.stems import stem, stem_tokens
from faultgrain.operators.timeseries import correlations
from faultgrain.sources import files


def points(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double, label int")


def test_nearest_class_and_ties(spark):
    rows = points(spark, [(1, 0.0, 0.0, 0), (2, 0.0, 1.0, 1), (3, 1.0, 0.0, 1), (4, 9.0, 9.0, 2), (5, 9.0, 8.0, 2), (6, 0.0, 2.0, 0)])
    asked = rows.where("id IN (1, 4)").select(F.col("id").alias("q"), "x", "y")
    got = {r.q: r.predicted for r in neighbours.knn_predict(asked, rows, ["x", "y"], query="q", key="id", k=4).collect()}
    assert got == {1: 1, 4: 2}  # two of each class: the highest wins
    share = {(r.q, r.label): r.share for r in neighbours.knn_proba(asked, rows, ["x", "y"], query="q", key="id", k=10).collect()}
    assert math.isclose(share[1, 0], 1 / 3) and math.isclose(sum(v for (q, _), v in share.items() if q == 4), 1)


def test_synthetic_rows_by_plain_code(spark):
    r = random.Random(1)
    few = [(i, float(r.randint(0, 9)), float(r.randint(-9, 9)), 1) for i in range(7)]
    rows = points(spark, few + [(100 + i, 0.0, 0.0, 0) for i in range(40)])
    got = {s["sample"]: (s.base, s.neighbour, s.x, s.y) for s in neighbours.smote(rows, ["x", "y"], minority=F.col("label") == 1, order_by="id", ratio=0.5, k=3, limits={"y": lambda c: F.greatest(c, F.lit(0.0))}).collect()}
    want = {}
    for i in range(20 - 7):
        base = few[i % 7]
        near = sorted((x for x in few if x != base), key=lambda p: ((p[1] - base[1]) ** 2 + (p[2] - base[2]) ** 2, p[0]))[:3]
        other, gap = near[i % 3], (17 * i + 42) % 100 / 100
        want[i] = (base[0], other[0], base[1] + gap * (other[1] - base[1]), max(0.0, base[2] + gap * (other[2] - base[2])))
    assert got.keys() == want.keys() and all(a == pytest.approx(b) for a, b in ((got[i], want[i]) for i in want))
    assert neighbours.smote(rows, ["x", "y"], minority=F.col("label") == 1, order_by="id", ratio=0.1).count() == 0
    with pytest.raises(ValueError):
        neighbours.smote(rows, ["x", "y"], minority=F.col("id") == 1, order_by="id")


def test_silhouettes(spark):
    rows = points(spark, [(1, 0.0, 0.0, 0), (2, 0.0, 2.0, 0), (3, 10.0, 0.0, 1)])
    got = {r.id: r.silhouette for r in neighbours.silhouettes(rows, ["x", "y"], key="id", cluster="label").collect()}
    assert math.isclose(got[1], 0.8) and math.isclose(got[2], 1 - 2 / math.sqrt(104)) and math.isclose(got[3], 1.0)
    one = neighbours.silhouettes(rows.where("label = 0"), ["x", "y"], key="id", cluster="label").collect()
    assert [r.silhouette for r in one] == [-1.0, -1.0]
    many = points(spark, [(i, float(i % 2 * 50 + i % 5), 0.0, i % 2) for i in range(40)])
    assert neighbours.squared_silhouette(many, ["x", "y"], cluster="label").first()[0] > 0.9


def test_exact_clusters_start_from_the_first_rows(spark):
    rows = points(spark, [(1, 0.0, 0.0, 0), (2, 9.0, 0.0, 0), (3, 1.0, 0.0, 0), (4, 8.0, 0.0, 0), (5, 0.0, 0.0, 0)])
    got = {r.id: (r.cluster, round(r.distance2, 6)) for r in neighbours.kmeans_exact(rows, ["x", "y"], k=2, order_by="id").collect()}
    assert {i: c for i, (c, _) in got.items()} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0}
    assert got[2][1] == 0.25 and got[3][1] == round((2 / 3) ** 2, 6)
    with pytest.raises(ValueError):
        neighbours.kmeans_exact(rows.limit(1), ["x", "y"], k=2, order_by="id")


def test_porter_stems(spark):
    known = {
        "memory": "memori", "condition": "condit", "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
        "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky",
        "relational": "relat", "rational": "ration", "digitizer": "digit", "operator": "oper", "hopefulness": "hope", "triplicate": "triplic", "electrical": "electr",
        "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll",
    }
    assert {w: stem(w) for w in known} == known
    rows = spark.createDataFrame([(1, ["memory", "leaks", "memory"]), (2, []), (3, ["é1", "is"])], "doc_id int, tokens array<string>")
    assert {r.doc_id: r.stems for r in stem_tokens(rows).collect()} == {1: ["memori", "leak", "memori"], 2: [], 3: ["é1", "is"]}


def test_similar_texts_equal_plain_cosines(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice("abcdefghijkl") * 2 for _ in range(r.randint(2, 9))) for _ in range(60)]
    weights = text.tfidf(text.tokenize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).cache()
    vector: dict = {}
    for x in weights.collect():
        vector.setdefault(x.doc_id, {})[x.term] = x.weight
    for least in (0.3, 0.8, 1.0):
        want = {}
        for a in vector:
            for b in vector:
                s = round(sum(w * vector[b].get(t, 0) for t, w in vector[a].items()), 9)
                if a < b and s >= least:
                    want[a, b] = s
        got = {(x.a, x.b): x.similarity for x in text.pairwise_similarity(weights, least=least).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[p], want[p], abs_tol=1e-8) for p in want)
    with pytest.raises(ValueError):
        text.pairwise_similarity(weights, least=0)


def test_finer_categories(spark):
    rows = ["fix: sql injection xss security", "docs only", "fix typo", "bugfix: lifetime 'a", "hotfix for mutex deadlock thread lock", None, "Fix: borrow move ownership lifetime reference"]
    got = [(r.category, round(r.confidence, 4)) for r in classify.classify_fix_only(spark.createDataFrame([(m,) for m in rows], "message string")).collect()]
    assert got[0] == ("SecurityVulnerabilities", 0.95) and got[1] == ("NotDefect", 0) and got[2] == ("Unknown", 0.7) and got[5] == ("NotDefect", 0)
    # two patterns of the later rule reach the confidence of one of the earlier, and more patterns win
    assert got[3] == ("LifetimeAnnotation", 0.85) and got[4] == ("ConcurrencyBugs", 0.95) and got[6] == ("OwnershipBorrow", 0.95)


def test_multiple_labels_equal_plain_rules(spark):
    import numpy as np

    from faultgrain.functions.taxonomy import RULES

    r = random.Random(7)
    every = [p for _, _, ps in RULES for p in ps]
    rows = [(i, " ".join(r.sample(every, r.randint(0, 6)))) for i in range(300)]
    got = {x.commit_id: [(c.category, c.confidence) for c in x.categories] for x in classify.classify_multi(spark.createDataFrame(rows, "commit_id long, message string")).collect()}
    f = np.float32
    for i, m in rows:
        found = [(c, float(min(f(b) + f(n - 1) * f(0.05), f(0.95)))) for c, b, ps in RULES if (n := sum(p in m for p in ps))]
        assert got.get(i, []) == [x for x in sorted(found, key=lambda x: -x[1])[:3] if x[1] >= float(f(0.6))]


def test_retrieval_fuses_ranks(spark):
    bugs = spark.createDataFrame([("b1", "crash in parser", "m1.rs line 7 fails", ["boom"], "null", "check it", "Logic Errors"), ("b2", "slow", "x", [], "y", "z", "Type Errors")],
                                 "id string, title string, description string, symptoms array<string>, root_cause string, fix_pattern string, category string")
    ranked = spark.createDataFrame([("src/m0.rs", 3, 0.9, 1, "tells"), ("src/m1.rs", 7, 0.8, 2, "tells")], "file string, line long, score double, rank int, explanation string")
    got = {r.file: r for r in retrieval.rag_localize(ranked, bugs.where("id = 'b1'")).collect()}
    assert got["src/m1.rs"].similarity == 1 and math.isclose(got["src/m1.rs"].combined, 2 / 61)
    for strategy, want in (("linear", 0.8 * 0.7 + 0.3), ("average", 0.9), ("sbfl", 0.8)):
        out = {r.file: r.combined for r in retrieval.rag_localize(ranked, bugs, strategy=strategy).collect()}
        assert math.isclose(out["src/m1.rs"], want)
    with pytest.raises(ValueError):
        retrieval.rag_localize(ranked, bugs, strategy="x")
    row = spark.createDataFrame([("a", 1, 1, 9, 20, 10, 0.5)], "file string, line long, passed long, failed long, total_passed long, total_failed long, score double")
    told = retrieval.explained(row)
    assert told.first().explanation == "Executed by 90% of failing tests (9/10) and 5% of passing tests (1/20). Suspiciousness score: 0.500"


def test_order_where_half_of_all_keys_are_equal(spark):
    rows = [(i, f"t{i * 7919 % 2000:04d}", 1.0 if i % 2 else float(i % 50)) for i in range(2000)] + [(5000, "null", None)]
    frame = spark.createDataFrame(rows, "id long, tie string, key double").repartition(7)
    got = {r.id: r.position for r in ordering.global_index(frame, "key", "tie", ranges=20).collect()}
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0.0, r[1]))
    assert got == {r[0]: p for p, r in enumerate(order)}
    parts = ordering.ordered(frame, F.col("key").asc(), F.col("tie").asc(), ranges=20).where("key = 1").select("fg_part").distinct().count()
    assert parts >= 8  # the frequent key is cut too


def test_correlations_of_each_group(spark):
    r = random.Random(5)
    rows = [(i % 3, r.random() * 1e9, r.random(), 5.0) for i in range(90)]
    got = {(x.g, x.i, x.j): x.r for x in correlations(spark.createDataFrame(rows, "g int, `a.b` double, b double, c double"), ["a.b", "b", "c"], by="g").collect()}
    assert len(got) == 27 and all(got[g, i, j] == got[g, j, i] for g in range(3) for i in range(3) for j in range(3))
    for g in range(3):
        a, b = ([x[k] for x in rows if x[0] == g] for k in (1, 2))
        ma, mb = sum(a) / 30, sum(b) / 30
        want = sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
        assert math.isclose(got[g, 0, 1], want, rel_tol=1e-9) and got[g, 0, 2] == 0 and got[g, 2, 2] == 1


def test_saved_classifier_predicts_alike(spark, tmp_path):
    rows = spark.createDataFrame([("train", ["leak", "memory"], "A"), ("train", ["lock", "wait"], "B"), ("test", ["memory"], "A"), ("test", ["lock"], "C")] * 5, "split string, tokens array<string>, category string")
    model = models.train_text_classifier(rows.where("split = 'train'"), trees=5, depth=3)
    models.save_classifier(model, str(tmp_path / "m"))
    got = [sorted(map(tuple, models.classifier_accuracy(m, rows).collect())) for m in (model, models.load_classifier(str(tmp_path / "m")))]
    assert got[0] == got[1] and dict((s, n) for s, n, _ in got[0]) == {"train": 10, "test": 10}
    assert dict((s, a) for s, _, a in got[0])["test"] <= 0.5  # a category that it never saw


def test_features_keep_their_names(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 0), (3, 4, 1)], "a int, b int, defect_category int")
    about = files.export_features(rows, str(tmp_path / "f"), ["b", "a"]).first()
    assert (about.n_samples, about.n_features, about.n_classes) == (2, 2, 2)
    assert sorted(map(tuple, files.load_features(spark, str(tmp_path / "f")).select("a", "b", "label").collect())) == [(1, 2, 0), (3, 4, 1)]


def test_counts_ranks_and_repositories(spark):
    rows = spark.createDataFrame([("x", 1), ("x", None), (None, 2), ("y", 2)], "a string, b int")
    got = {(r.column, r.value): (r.n, r.percent) for r in dataset.value_counts(rows, ["a", "b"]).collect()}
    assert got["b", "2"][0] == 2 and math.isclose(got["a", "x"][1], 200 / 3) and len(got) == 4
    repos = spark.createDataFrame([("a", 5, None, "2020-01-01"), ("b", 9, "Go", "2019-12-31"), ("c", 5, "Go", "2021-01-01")], "name string, stars long, language string, updated_at string")
    repos = repos.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    assert [r.name for r in dataset.repos_since(repos, "2020-01-01").collect()] == ["a", "c"]
    assert [(r.name, r.language) for r in dataset.top_repos(repos, limit=2).collect()] == [("b", "Go"), ("a", "Unknown")]


def test_names_are_registered_once():
    assert len(catalog.queries()) == sum(len(p.QUERIES) for p in catalog._PARTS)


def test_changes_of_any_size_make_pairs(spark):
    from faultgrain.operators.graph import cochange_edges

    changed = spark.createDataFrame([(1, f"f{i:03d}") for i in range(60)], "fix_commit long, file string")
    assert cochange_edges(changed).count() == 60 * 59 // 2 and cochange_edges(changed, max_files=50).count() == 0


def test_newest_commits(spark):
    rows = spark.createDataFrame([(i, "r" + str(i % 2), i // 3) for i in range(12)], "commit_id long, repo string, timestamp long")
    got = {(r.repo, r.commit_id) for r in classify.newest_commits(rows, 2).collect()}
    assert got == {("r1", 9), ("r1", 11), ("r0", 10), ("r0", 6)}


def test_stems_of_the_whole_table_equal_plain_code(spark):
    import os
    import re

    from faultgrain import catalog
    from faultgrain.operators.text import STOP_WORDS

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no tables here")
    got = {r.doc_id: r.stems for r in catalog.queries()["stem_tokens"](spark, data).collect()}
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    words = lambda t: [w for w in re.findall(r"\w+", (t or "").lower()) if w not in STOP_WORDS]
    plain = {r.doc_id: r.text for r in rows if r.text is None or r.text.isascii()}
    assert len(plain) > 20 and all(got[d] == " ".join(map(stem, words(t))) for d, t in plain.items())
