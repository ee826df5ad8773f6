"""Registered queries of fitted models, which have no SQL, against plain code over their results."""

import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from faultgrain import catalog
from faultgrain.functions.taxonomy import CATEGORIES
from faultgrain.operators import models, text
from faultgrain.operators.classify import classify_commits
from faultgrain.sources.views import view

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def ruled(spark):
    return {r.commit_id: r for r in classify_commits(view(spark, DATA, "commits")).select("commit_id", "repo", "category", "confidence").collect()}


def settled(points: np.ndarray, cluster: np.ndarray, distance2: np.ndarray, close: float) -> None:
    """Every point is in the cluster of the nearest mean, at the distance that is told."""
    names = sorted(set(cluster))
    centres = np.stack([points[cluster == c].mean(0) for c in names])
    d = ((points[:, None] - centres[None]) ** 2).sum(2)
    own = d[np.arange(len(points)), np.searchsorted(names, cluster)]
    assert (own <= d.min(1) + close).all() and np.allclose(own, distance2, atol=close)


def test_repositories_lie_with_their_nearest_mean(spark, ruled):
    counts = defaultdict(Counter)
    for r in ruled.values():
        if r.category:
            counts[r.repo][r.category] += 1
    rows = {r.repo: r for r in catalog.queries()["cluster_repos"](spark, DATA).collect()}
    assert rows.keys() == counts.keys()
    repos = sorted(rows)
    points = np.array([[counts[r][c] / sum(counts[r].values()) for c in CATEGORIES] for r in repos])
    settled(points, np.array([rows[r].cluster for r in repos]), np.array([rows[r].distance2 for r in repos]), 1e-3)


def test_texts_lie_with_their_nearest_mean(spark):
    r = np.random.default_rng(3)
    docs = [(i, [f"t{i % 3}{j}" for j in r.integers(0, 6, 12)] + ["all"]) for i in range(90)]
    rows = {x.doc_id: x for x in models.semantic_clusters(spark.createDataFrame(docs, "doc_id long, tokens array<string>"), k=3).collect()}
    df = Counter(t for _, tokens in docs for t in set(tokens))
    terms = sorted(df)
    weight = {t: np.log((len(docs) + 1) / (df[t] + 1)) for t in terms}
    points = np.array([[tokens.count(t) * weight[t] for t in terms] for _, tokens in docs])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    settled(points, np.array([rows[i].cluster for i, _ in docs]), np.array([rows[i].distance2 for i, _ in docs]), 1e-2)
    out = catalog.queries()["semantic_clusters"](spark, DATA)
    assert out.count() == spark.read.parquet(f"{DATA}/documents.parquet").count() and {x.cluster for x in out.collect()} == {0, 1, 2, 3}


def test_forest_of_the_default_size(spark, ruled):
    """Messages come from a few templates, so a forest that learns knows nearly all of them again."""
    accuracy = {r.split: r.accuracy for r in catalog.queries()["train_text_classifier"](spark, DATA).collect()}
    assert set(accuracy) == {"train", "validation", "test"} and min(accuracy.values()) > 0.95
    model = models.train_text_classifier(text.tokenize(classify_commits(view(spark, DATA, "commits")), text="message").limit(50), trees=3, depth=2)
    assert model.stages[-1].getNumTrees == 3
    top = defaultdict(dict)
    for r in catalog.queries()["predict_top_n"](spark, DATA).collect():
        top[r.commit_id][r.place] = r
    assert top.keys() == ruled.keys()
    for places in top.values():
        sure = [places[k].confidence for k in sorted(places)]
        assert sorted(places) == [0, 1, 2] and sure == sorted(sure, reverse=True) and sum(sure) <= 1 + 1e-9
    known = [c for c, r in ruled.items() if r.category]
    assert sum(top[c][0].category == ruled[c].category for c in known) > 0.95 * len(known)
    for r in catalog.queries()["classify_hybrid"](spark, DATA).collect():
        first, rule = top[r.commit_id][0], ruled[r.commit_id]
        assert r.by_model == (first.confidence >= 0.6)
        assert r.category == (first.category if r.by_model else rule.category)
        assert r.confidence == pytest.approx(first.confidence if r.by_model else rule.confidence)


def test_clusters_of_features_equal_plain_rounds(spark):
    from faultgrain.operators.neighbours import kmeans_exact

    r = np.random.default_rng(4)
    points = np.concatenate([r.normal(c, 1.0, (60, 2)) for c in ((0, 0), (6, 1), (2, 7))])
    r.shuffle(points)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double").repartition(4)
    got = {x.id: (x.cluster, x.distance2) for x in kmeans_exact(df, ["x", "y"], k=4, order_by="id").collect()}
    centres = points[:4].copy()
    for _ in range(100):
        own = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([points[own == k].mean(0) if (own == k).any() else centres[k] for k in range(4)])
        moved, centres = np.abs(new - centres).max(), new
        if moved < 1e-6:
            break
    d = ((points[:, None] - centres[None]) ** 2).sum(2)
    assert [got[i][0] for i in range(len(points))] == d.argmin(1).tolist()
    assert np.allclose([got[i][1] for i in range(len(points))], d.min(1))
