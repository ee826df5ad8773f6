"""Queries of reviews, graphs, summaries and fitted models, and their SQL where one exists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.functions.taxonomy import CATEGORIES
from faultgrain.operators import coverage as V
from faultgrain.operators import dataset as N
from faultgrain.operators import evaluate as E
from faultgrain.operators import graph as G
from faultgrain.operators import models as M
from faultgrain.operators import patterns as P
from faultgrain.operators import review as R
from faultgrain.operators import text as X
from faultgrain.operators import timeseries as S
from faultgrain.plans.analysis import _OWN_NAMES, _OWN_VOTES, _TERMS, _VOTES, _features, _own_votes, _texts, _tokens
from faultgrain.plans.core import _PATTERNS, _RULES, _STATEMENTS, _classified, _r, _with
from faultgrain.sources.files import validate_diagnostics as _validated
from faultgrain.sources.scratch import stored
from faultgrain.sources.views import oracle, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- reviews

_NAME = """concat(CASE p_partkey % 3 WHEN 0 THEN 'src/api/' WHEN 1 THEN 'src/' ELSE 'docs/' END, 'f', CAST(p_partkey AS STRING),
  CASE p_partkey % 5 WHEN 0 THEN '.rs' WHEN 1 THEN '.yaml' WHEN 2 THEN '.md' WHEN 3 THEN '.py' ELSE '.txt' END)"""
_REVIEW = f"""{_PATTERNS}, {oracle('tdg')}, v_q AS (SELECT repo, avg(total) AS avg_tdg FROM v_tdg GROUP BY repo), v_files AS (SELECT {_NAME} AS file FROM part),
v_known AS (SELECT category, CAST(sum(frequency) AS BIGINT) AS frequency, avg(avg_tdg) AS avg_tdg FROM v_patterns LEFT JOIN v_q USING (repo) GROUP BY category),
v_classed AS (SELECT file, 'Configuration Errors' AS category FROM v_files WHERE regexp_matches(file, '\\.(yaml|yml|toml|json|env|config|ini)$')
  UNION ALL SELECT file, 'Integration Failures' FROM v_files WHERE regexp_matches(lower(file), 'api|client|http|integration|service')
  UNION ALL SELECT file, 'Logic Errors' FROM v_files WHERE regexp_matches(file, '\\.(rs|py|js|ts|java|go|cpp|c|rb|php)$')),
v_warned AS (SELECT file, category, frequency, round(coalesce(avg_tdg, 0), 6) AS avg_tdg FROM v_classed JOIN v_known USING (category)
  WHERE frequency >= 20 OR (frequency >= 10 AND coalesce(avg_tdg, 0) < 60))"""


def _files(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select(F.expr(_NAME).alias("file"))


def _warnings(spark, d) -> DataFrame:
    known = R.baseline(P.defect_patterns(_classified(spark, d)), V.tdg_by_repo(view(spark, d, "tdg")))
    return R.review_changes(_files(spark, d), known)


@query(_with(_REVIEW, "SELECT * FROM v_warned"))
def review_changes(spark, d):
    return _warnings(spark, d).select("file", "category", "frequency", _r("avg_tdg"))


@query(_with(_REVIEW, "SELECT file FROM v_files WHERE file NOT IN (SELECT file FROM v_warned)"))
def clean_files(spark, d):
    return R.clean_files(_files(spark, d), _warnings(spark, d))


# Lines have no content in the given tables; comments of orders stand in for it.
_LINES = """SELECT concat('src/m', CAST(o_orderkey % 25 AS STRING), '.rs') AS file, CAST(o_orderkey % 80 AS BIGINT) AS line,
  min(CASE o_orderkey % 4 WHEN 0 THEN '  // note' WHEN 1 THEN 'use std' WHEN 2 THEN ' ' ELSE concat('x = ', o_orderpriority) END) AS content FROM {orders} GROUP BY 1, 2"""


@query(_with(f"{oracle('changed_lines')}, v_lines AS ({_LINES.format(orders='orders')})", """SELECT fix_commit, c.file, c.line, was_deleted FROM v_changed_lines c LEFT JOIN v_lines l ON l.file = c.file AND l.line = c.line
  WHERE content IS NULL OR NOT (trim(content) = '' OR regexp_matches(trim(content), '^(//|/\\*|\\*|use |import )'))"""))
def filter_cosmetic(spark, d):
    lines = spark.sql(_LINES, orders=spark.read.parquet(f"{d}/orders.parquet"))
    return R.filter_cosmetic(view(spark, d, "changed_lines"), lines).select("fix_commit", "file", "line", "was_deleted")


# --- graphs: lines of files point to the lines of other files that are changed after them

_EDGE = f"""{oracle('changed_lines')}, v_f AS (SELECT DISTINCT fix_commit, file FROM v_changed_lines), v_e AS MATERIALIZED (SELECT a.file AS src, b.file AS dst, count(*) AS weight
  FROM v_f a JOIN v_f b ON a.fix_commit = b.fix_commit AND a.file < b.file GROUP BY 1, 2), v_links AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM v_e),
v_nodes AS MATERIALIZED (SELECT src AS node FROM v_e UNION SELECT dst FROM v_e), v_rank0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM v_nodes) AS rank FROM v_nodes)"""


def _rank_step(k: int) -> str:
    return f"""v_got{k} AS MATERIALIZED (SELECT dst, sum(rank * share) AS got FROM v_rank{k - 1} JOIN v_links ON src = node GROUP BY dst),
v_rank{k} AS MATERIALIZED (SELECT node, 0.15 / (SELECT count(*) FROM v_nodes) + 0.85 * (coalesce(got, 0) + (1 - coalesce((SELECT sum(got) FROM v_got{k}), 0)) / (SELECT count(*) FROM v_nodes)) AS rank
  FROM v_nodes LEFT JOIN v_got{k} ON dst = node)"""


def _edges(spark, d) -> DataFrame:
    return G.cochange_edges(view(spark, d, "changed_lines")).select(F.col("source_file").alias("src"), F.col("target_file").alias("dst"), "weight")


@query(_with(", ".join([_EDGE, *map(_rank_step, range(1, 21))]), "SELECT node, round(rank, 8) AS rank FROM v_rank20"))
def pagerank(spark, d):
    return G.pagerank(_edges(spark, d)).select("node", _r("rank", 8))


_SEED = "src/m0.rs"


@query(f"WITH RECURSIVE {_EDGE}, v_reached AS (SELECT '{_SEED}' AS node, 0 AS level UNION SELECT dst, level + 1 FROM v_reached JOIN v_e ON src = node WHERE level < 10) "
       "SELECT node, min(level) AS level FROM v_reached GROUP BY node")  # fmt: skip
def bfs_levels(spark, d):
    return G.bfs_levels(_edges(spark, d), spark.range(1).select(F.lit(_SEED).alias("node")))


# --- summaries

_NUMBERS = ["lines_added", "lines_removed", "files_changed"]


@query(_with(oracle("commits"), " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min,
  (SELECT CAST({c} AS DOUBLE) FROM v_commits ORDER BY {c}, commit_id LIMIT 1 OFFSET (SELECT count(*) // 2 FROM v_commits)) AS median, CAST(max({c}) AS DOUBLE) AS max FROM v_commits""" for c in _NUMBERS)))  # fmt: skip
def describe(spark, d):
    return N.describe(view(spark, d, "commits"), _NUMBERS, tie="commit_id").select("column", "count", _r("mean"), _r("std"), "min", "median", "max")


@query(_with(_RULES, """SELECT category, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent
  FROM v_classified WHERE category IS NOT NULL GROUP BY category"""))
def list_all_summary(spark, d):
    return N.shares(_classified(spark, d).where("category IS NOT NULL")).select("category", "n", "total", _r("percent"))


@query(_with(_STATEMENTS, """, v_x AS (SELECT (SELECT count(*) FROM v_st) AS n, CAST(tf AS DOUBLE) AS f, CAST(tp AS DOUBLE) AS p FROM v_tot)
  SELECT round(least(ln(f), 3) / 3 * CASE WHEN f / (f + p) < 0.01 THEN f / (f + p) * 10 WHEN f / (f + p) > 0.5 THEN 1.5 - f / (f + p) ELSE 1 END * least(ln(n), 7) / 7, 6) AS confidence FROM v_x"""))
def sbfl_confidence(spark, d):
    coverage = view(spark, d, "coverage")
    return V.sbfl_confidence(V.combine_coverage(coverage), V.test_totals(coverage)).select(_r("confidence"))


_SCORES = [c for c, _, _ in E.LABEL_FUNCTIONS]


@query(_with(oracle("file_features"), f"SELECT row_id, {', '.join(f'round(greatest(least({c}, 1), 0), 6) AS {c}' for c in _SCORES)} FROM v_file_features"))
def file_scores(spark, d):
    return E.file_scores(view(spark, d, "file_features")).select("row_id", *map(_r, _SCORES))


@query(_with(oracle("commits"), "SELECT round(corr(CAST(lines_added AS DOUBLE), CAST(files_changed AS DOUBLE)), 6) AS r FROM v_commits"))
def pearson_pair(spark, d):
    return S.correlation_matrix(view(spark, d, "commits"), ["lines_added", "files_changed"]).where("i = 0 AND j = 1").select(_r("r"))


@query(_with(oracle("diagnostics"), """SELECT x.field, x.status, x.nulls FROM (SELECT unnest([{'field': 'message', 'status': 'missing', 'nulls': NULL::BIGINT},
  {'field': 'confidence', 'status': 'required', 'nulls': count(*) FILTER (confidence IS NULL)}, {'field': 'timestamp', 'status': 'required', 'nulls': count(*) FILTER ("timestamp" IS NULL)},
  {'field': 'error_code', 'status': 'optional', 'nulls': count(*) FILTER (error_code IS NULL)}, {'field': 'clippy_lint', 'status': 'optional', 'nulls': count(*) FILTER (clippy_lint IS NULL)},
  {'field': 'given_category', 'status': 'optional', 'nulls': count(*) FILTER (given_category IS NULL)}, {'field': 'event_id', 'status': 'extra', 'nulls': count(*) FILTER (event_id IS NULL)},
  {'field': 'source_file', 'status': 'extra', 'nulls': count(*) FILTER (source_file IS NULL)}]) AS x FROM v_diagnostics)"""))
def validate_diagnostics(spark, d):
    return _validated(view(spark, d, "diagnostics"))


@query(_with(_TERMS, """, v_raw AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM v_tokens)) / (1 + df)) + 1) AS raw FROM v_tf JOIN v_vocabulary USING (term)),
  v_w AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM v_raw), v_n AS (SELECT count(*) AS n FROM v_tokens),
  v_s AS (SELECT term, round(sum(w * w) / n - pow(sum(w) / n, 2), 12) AS variance, CASE WHEN count(*) < n THEN least(min(w), 0) ELSE min(w) END AS low,
    CASE WHEN count(*) < n THEN greatest(max(w), 0) ELSE max(w) END AS high FROM v_w, v_n GROUP BY term, n),
  v_two AS (SELECT *, greatest(high - low, 0.001) AS range, row_number() OVER (ORDER BY variance DESC, term) AS axis FROM v_s QUALIFY axis <= 2),
  v_at AS (SELECT doc_id, axis, coalesce(max(w), 0) AS w FROM (SELECT DISTINCT doc_id FROM v_w) CROSS JOIN v_two LEFT JOIN v_w USING (doc_id, term) GROUP BY doc_id, axis)
  SELECT doc_id, round(max(CASE WHEN axis = 1 THEN (w - low) / range * 2 - 1 END), 6) AS x, round(max(CASE WHEN axis = 2 THEN (w - low) / range * 2 - 1 END), 6) AS y FROM v_at JOIN v_two USING (axis) GROUP BY doc_id"""))
def project_2d(spark, d):
    texts = _texts(spark, d)
    return X.project_2d(X.tfidf(texts, text="text"), texts.agg(F.count(F.lit(1)).alias("n"))).select("doc_id", _r("x"), _r("y"))


# --- fitted models; those without SQL are tested against plain code or properties


def _em_sql(votes: str, names: list[str]) -> str:
    """Rounds of expectation and maximisation over counted vote rows, until the likelihood settles."""
    n = len(names)
    up, down = (" + ".join(f"CASE WHEN {v} = {side} THEN w[{j + 1}] ELSE 0 END" for j, v in enumerate(names)) for side in (1, -1))
    fit = ", ".join(f"coalesce(sum(n * CASE WHEN {v} = 1 THEN p ELSE 1 - p END) FILTER ({v} <> 0) / sum(n) FILTER ({v} <> 0), 0.5)" for v in names)
    rows = " UNION ALL ".join(f"SELECT '{v}' AS name, round(w[{j + 1}] / list_sum(w), 6) AS weight FROM v_last" for j, v in enumerate(names))
    return f"""WITH RECURSIVE {votes}, v_c AS MATERIALIZED (SELECT {', '.join(names)}, count(*) AS n FROM v_votes GROUP BY ALL),
v_em AS (SELECT 0 AS k, [{', '.join(['1.0::DOUBLE / ' + str(n)] * n)}] AS w, '-infinity'::DOUBLE AS fit, false AS done UNION ALL
  SELECT k + 1, CASE WHEN abs(new - fit) < 1e-6 THEN w ELSE ws END, new, abs(new - fit) < 1e-6 FROM (
    SELECT k, w, fit, sum(n * (ln(least(greatest(p, 1e-10), 1 - 1e-10)) + ln(1 - least(greatest(p, 1e-10), 1 - 1e-10)))) AS new, [{fit}] AS ws FROM (
      SELECT *, CASE WHEN up + down > 0 THEN up / (up + down) ELSE 0.5 END AS p FROM (SELECT *, CAST({up} AS DOUBLE) AS up, CAST({down} AS DOUBLE) AS down FROM v_em, v_c WHERE NOT done AND k < 100)) GROUP BY k, w, fit)),
v_last AS (SELECT w FROM v_em ORDER BY k DESC LIMIT 1) {rows}"""


@query(_em_sql(_VOTES, [f"vote_{c}" for c in _SCORES]))
def label_model(spark, d):
    return M.label_model(E.label_functions(view(spark, d, "file_features"))).select("name", _r("weight"))


@query(_em_sql(_OWN_VOTES, _OWN_NAMES))
def own_label_model(spark, d):
    """Weights of five built-in labeling functions and two of a caller's own."""
    return M.label_model(_own_votes(spark, d)).select("name", _r("weight"))


@query(_with(_VOTES, ", v_p AS (SELECT row_id, CASE WHEN p + q = 0 THEN 0.5 ELSE CAST(p AS DOUBLE) / (p + q) END AS probability FROM (SELECT row_id, "
  + " + ".join(f"CAST(vote_{c} = 1 AS INT)" for c in _SCORES) + " AS p, " + " + ".join(f"CAST(vote_{c} = -1 AS INT)" for c in _SCORES) + " AS q FROM v_votes)), "
  "v_i AS (SELECT row_id, probability, greatest(probability - 1.96 * sqrt(probability * (1 - probability)), 0) AS low, least(probability + 1.96 * sqrt(probability * (1 - probability)), 1) AS high FROM v_p) "
  "SELECT row_id, round(probability, 6) AS probability, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN high - low < 0.15 THEN 'High' WHEN high - low < 0.3 THEN 'Medium' ELSE 'Low' END AS confidence_level FROM v_i"))
def calibrated_predict(spark, d):
    voted = E.ensemble_predict(E.label_functions(view(spark, d, "file_features")))
    return M.calibrated_predict(voted).select("row_id", _r("probability"), _r("low"), _r("high"), "confidence_level")


# The isotonic fit at a score is the greatest, over starts before it, of the least mean up to an end after it.
@query(_with(oracle("predictions"), """, v_p AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS pos, count(*) OVER () AS n FROM v_predictions),
  v_h AS (SELECT score AS x, avg(label) AS y, count(*) AS w FROM v_p WHERE pos > n - greatest(n // 5, 10) GROUP BY score),
  v_c AS MATERIALIZED (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(y * w) OVER (ORDER BY x) AS sy, sum(w) OVER (ORDER BY x) AS sw FROM v_h),
  v_z AS (SELECT i, sy, sw FROM v_c UNION ALL SELECT 0, 0, 0),
  v_m AS MATERIALIZED (SELECT a.i + 1 AS s, b.i AS e, (b.sy - a.sy) / (b.sw - a.sw) AS m FROM v_z a JOIN v_z b ON a.i < b.i),
  v_g AS (SELECT s, c.i, min(m) AS m FROM v_m JOIN v_c c ON s <= c.i AND e >= c.i GROUP BY s, c.i),
  v_f AS MATERIALIZED (SELECT x, max(m) AS f FROM v_g JOIN v_c USING (i) GROUP BY x),
  v_b AS (SELECT doc_id, score, (SELECT max(x) FROM v_f WHERE x <= score) AS lo, (SELECT min(x) FROM v_f WHERE x >= score) AS hi FROM v_predictions)
  SELECT doc_id, score, round(CASE WHEN lo IS NULL THEN h.f WHEN hi IS NULL OR lo = hi THEN l.f ELSE l.f + (h.f - l.f) * (score - lo) / (hi - lo) END, 6) AS calibrated
  FROM v_b LEFT JOIN v_f l ON l.x = lo LEFT JOIN v_f h ON h.x = hi"""))
def isotonic_calibrate(spark, d):
    return M.isotonic_calibrate(view(spark, d, "predictions"), order_by="doc_id", tie="doc_id").select("doc_id", "score", _r("calibrated"))


@query()
def cluster_repos(spark, d):
    wide = S.category_counts(_classified(spark, d), CATEGORIES)
    total = sum(F.col(f"`{c}`") for c in CATEGORIES)
    shared = wide.select("repo", *((F.col(f"`{c}`") / total).alias(f"c{i}") for i, c in enumerate(CATEGORIES)))
    return M.cluster_columns(shared, [f"c{i}" for i in range(len(CATEGORIES))], k=3).select("repo", "cluster", "distance2")


@query()
def semantic_clusters(spark, d):
    return M.semantic_clusters(_tokens(spark, d), k=4).select("doc_id", "cluster", "distance2")


def _predicted(spark, d) -> DataFrame:
    rows = stored(X.tokenize(_classified(spark, d), text="message").select("commit_id", "tokens", "category"))
    return M.predict_top_n(M.train_text_classifier(rows), rows, key="commit_id")


@query()
def predict_top_n(spark, d):
    return _predicted(spark, d)


@query()
def classify_hybrid(spark, d):
    return M.classify_hybrid(_classified(spark, d), _predicted(spark, d), key="commit_id")
