"""Every registered query against its SQL on the smallest tables, and the shape of some plans."""

import glob
import os

import duckdb
import pytest

from faultgrain import catalog
from faultgrain.operators import classify
from faultgrain.operators.coverage import sbfl_scores

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, other, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    want = sorted(map(repr, other.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()))
    assert got == want


def test_confidence_is_float_and_earlier_rules_win(spark):
    rows = spark.createDataFrame([("fix: null pointer and lifetime",), ("use after free, use-after-free; security",), ("docs",)], ["message"])
    out = [(r.category, round(r.confidence, 4) if r.confidence else None) for r in classify.classify_commits(rows).collect()]
    assert out == [("Memory Safety", 0.85), ("Memory Safety", 0.9), (None, None)]


def test_scores_by_hand(spark):
    statements = spark.createDataFrame([("a", 1, 2, 10), ("a", 2, 0, 0), ("a", 3, 0, 10)], "file string, line int, passed long, failed long")
    totals = spark.createDataFrame([(100, 10)], "total_passed long, total_failed long")
    out = {r.line: r for r in sbfl_scores(statements, totals).collect()}
    assert round(out[1].tarantula, 4) == 0.9804 and round(out[1].ochiai, 4) == 0.9129 and out[1].dstar2 == 50
    assert out[2].tarantula == out[2].ochiai == out[2].dstar2 == 0
    assert out[3].dstar2 > 1e38


def test_classification_needs_no_shuffle(spark):
    from faultgrain.sources.views import view

    df = classify.classify_commits(spark.createDataFrame([("x",)], ["message"]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert view(spark, DATA, "commits").count() > 0
