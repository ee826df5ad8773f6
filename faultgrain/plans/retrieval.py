"""Queries of neighbours, retrieval, repositories, finer categories and exact clusters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.functions import taxonomy as T
from faultgrain.operators import classify as C
from faultgrain.operators import coverage as V
from faultgrain.operators import dataset as N
from faultgrain.operators import diagnostics as D
from faultgrain.operators import models as M
from faultgrain.operators import neighbours as K
from faultgrain.operators import ordering as O
from faultgrain.operators import retrieval as L
from faultgrain.operators import stems as Z
from faultgrain.operators import text as X
from faultgrain.operators import timeseries as S
from faultgrain.plans.analysis import _TERMS, _TRAINING, _WORDS, _features, _texts, _training
from faultgrain.plans.core import _DIAG, _FEATURES, _RULES, _SCORED_TOP, _classified, _quoted, _r, _scores, _with
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


# --- commits and repositories


@query(_with(oracle("commits"), "SELECT repo, commit_id, hash, message, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY timestamp DESC, commit_id) AS place FROM v_commits) WHERE place <= 100"))
def src_commits(spark, d):
    return C.newest_commits(view(spark, d, "commits"), 100).select("repo", "commit_id", "hash", "message", "timestamp")


_FIX_ROWS = ", ".join(f"({i}, {_quoted(c)}, CAST({b} AS FLOAT), {_quoted(p)})" for i, (c, b, ps) in enumerate(T.FIX_RULES) for p in ps)


@query(_with(oracle("commits"), f""", v_rules AS (SELECT * FROM (VALUES {_FIX_ROWS}) AS r(rule, category, base, pattern)), v_m AS (SELECT commit_id, lower(message) AS m FROM v_commits),
  v_hits AS (SELECT commit_id, rule, category, count(*) AS n, least(base + CAST(count(*) - 1 AS FLOAT) * CAST(0.05 AS FLOAT), CAST(0.95 AS FLOAT)) AS confidence
    FROM v_m JOIN v_rules ON contains(m, pattern) GROUP BY commit_id, rule, category, base),
  v_best AS (SELECT * FROM v_hits QUALIFY row_number() OVER (PARTITION BY commit_id ORDER BY confidence DESC, n DESC, rule) = 1),
  v_fix AS (SELECT commit_id, starts_with(m, 'fix') OR contains(m, 'fix:') OR contains(m, 'bugfix') OR contains(m, 'hotfix') OR contains(m, 'patch:') AS fix FROM v_m)
  SELECT commit_id, CASE WHEN NOT fix THEN 'NotDefect' ELSE coalesce(category, 'Unknown') END AS category,
    round(CAST(CASE WHEN NOT fix THEN 0 ELSE coalesce(confidence, CAST(0.7 AS FLOAT)) END AS DOUBLE), 4) AS confidence FROM v_fix LEFT JOIN v_best USING (commit_id)"""))
def classify_fix_only(spark, d):
    return C.classify_fix_only(view(spark, d, "commits")).select("commit_id", "category", _r("confidence", 4))


@query(_with(oracle("repos"), "SELECT name, stars, language, updated_at FROM v_repos WHERE updated_at >= TIMESTAMP '1997-01-01'"))
def repos_since(spark, d):
    return N.repos_since(view(spark, d, "repos"), "1997-01-01").select("name", "stars", "language", "updated_at")


@query(_with(oracle("repos"), "SELECT name, stars, coalesce(language, 'Unknown') AS language FROM v_repos WHERE updated_at >= TIMESTAMP '1997-01-01' ORDER BY stars DESC, name LIMIT 5"))
def top_repos(spark, d):
    return N.top_repos(N.repos_since(view(spark, d, "repos"), "1997-01-01")).select("name", "stars", "language")


# --- neighbours

_DIMS = [f"e{i}" for i in range(64)]
_VECTORS = f"v_e AS (SELECT vec_id, label, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}' for i in range(64))} FROM embeddings)"
_DISTANCE = " + ".join(f"(r.e{i} - q.e{i}) * (r.e{i} - q.e{i})" for i in range(64))


def _near(k: int) -> str:
    return f"""{_VECTORS}, v_near AS (SELECT query_id, label FROM (SELECT q.vec_id AS query_id, r.vec_id, r.label, round({_DISTANCE}, 9) AS d FROM v_e q, v_e r WHERE q.vec_id % 50 = 0)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) <= {k})"""


def _vectors(spark, d) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return rows.select("vec_id", "label", *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(_DIMS)))


def _asked(rows: DataFrame) -> DataFrame:
    return rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), *_DIMS)


@query(_with(_near(5), "SELECT query_id, max_by(label, n * 1000 + label) AS predicted FROM (SELECT query_id, label, count(*) AS n FROM v_near GROUP BY 1, 2) GROUP BY query_id"))
def knn_predict(spark, d):
    rows = _vectors(spark, d)
    return K.knn_predict(_asked(rows), rows, _DIMS, query="query_id", key="vec_id")


@query(_with(_near(10), "SELECT query_id, label, count(*) AS votes, round(CAST(count(*) AS DOUBLE) / 10, 6) AS share FROM v_near GROUP BY 1, 2"))
def knn_proba(spark, d):
    rows = _vectors(spark, d)
    return K.knn_proba(_asked(rows), rows, _DIMS, query="query_id", key="vec_id").select("query_id", "label", "votes", _r("share"))


@query(_with(_VECTORS, f""", v_p AS (SELECT q.vec_id, q.label AS own, r.label AS other, avg(CASE WHEN r.vec_id <> q.vec_id THEN sqrt({_DISTANCE}) END) AS m FROM v_e q, v_e r GROUP BY ALL),
  v_ab AS (SELECT vec_id, coalesce(max(CASE WHEN own = other THEN m END), 0) AS a, coalesce(min(CASE WHEN own <> other THEN m END), 0) AS b FROM v_p GROUP BY vec_id)
  SELECT round(avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM v_ab"""))
def silhouette(spark, d):
    return K.silhouette(_vectors(spark, d), _DIMS, key="vec_id", cluster="label").select(_r("silhouette"))


_ALSO = "0 AS complexity_delta, 4 AS error_code_class, 0 AS has_suggestion, 0 AS suggestion_applicability, 0 AS clippy_lint_count, 0 AS span_line_delta, 0 AS diagnostic_confidence"
_FEW = "defect_category = 3"
_MINORITY = f"""{_FEATURES}, v_few AS MATERIALIZED (SELECT row_number() OVER (ORDER BY commit_id) - 1 AS p, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in S.FEATURES)} FROM (SELECT *, {_ALSO} FROM v_features) WHERE {_FEW}),
v_m AS (SELECT count(*) AS m FROM v_few), v_need AS (SELECT CAST(floor(((SELECT count(*) FROM v_features) - m) * CAST(0.1 AS DOUBLE)) AS BIGINT) - m AS need, m FROM v_m),
v_near AS (SELECT b.p AS base, n.p AS neighbour, row_number() OVER (PARTITION BY b.p ORDER BY round({' + '.join(f'(n.{c} - b.{c}) * (n.{c} - b.{c})' for c in S.FEATURES)}, 9), n.p) - 1 AS place
  FROM v_few b JOIN v_need ON b.p < need JOIN v_few n ON n.p <> b.p QUALIFY place < 5),
v_each AS (SELECT base, count(*) AS c FROM v_near GROUP BY base),
v_s AS (SELECT i AS sample, i % m AS base, ((i * 17 + 42) % 100) / CAST(100 AS DOUBLE) AS gap FROM (SELECT unnest(range(greatest(need, 0))) AS i, m FROM v_need))"""
_CUT = {"files_changed": "greatest({}, 0)", "lines_added": "greatest({}, 0)", "lines_deleted": "greatest({}, 0)", "hour_of_day": "least(floor(greatest({}, 0)), 23)", "day_of_week": "least(floor(greatest({}, 0)), 6)"}
_CUT |= {c: "least(floor(greatest({}, 0)), 255)" for c in ("error_code_class", "has_suggestion", "suggestion_applicability", "clippy_lint_count")}


@query(_with(_MINORITY, f"SELECT sample, v_s.base, neighbour, {', '.join(f'round({_CUT.get(c, '{}').format(f'(b.{c} + gap * (n.{c} - b.{c}))')}, 4) AS {c}' for c in S.FEATURES)} FROM v_s JOIN v_each USING (base) "
  "JOIN v_near r ON r.base = v_s.base AND r.place = sample % c JOIN v_few b ON b.p = v_s.base JOIN v_few n ON n.p = neighbour"))
def smote(spark, d):
    """All 14 numbers, cut to what each can be."""
    rows = _features(spark, d).select("commit_id", *S.FEATURES)
    out = K.smote(rows, S.FEATURES, minority=F.expr(_FEW), order_by="commit_id", ratio=0.1, limits=K.feature_limits(S.FEATURES))
    return out.select("sample", "base", "neighbour", *(_r(c, 4) for c in S.FEATURES))


_CLUSTERS = 5
_DIMENSIONS = range(1, len(S.FEATURES) + 1)
_GAP2 = lambda a, b: f"list_sum(list_transform(range(1, {len(S.FEATURES) + 1}), lambda j: ({a}[j] - {b}[j]) * ({a}[j] - {b}[j])))"
# Rounds go on until no centre moves: the state is the list of centres.
_LLOYD = f"""WITH RECURSIVE {_FEATURES}, v_x AS MATERIALIZED (SELECT commit_id, [{', '.join(f'CAST({c} AS DOUBLE)' for c in S.FEATURES)}] AS v FROM (SELECT *, {_ALSO} FROM v_features)),
v_km AS (SELECT 0 AS i, (SELECT list(v ORDER BY commit_id) FROM (SELECT * FROM v_x ORDER BY commit_id LIMIT {_CLUSTERS})) AS z, false AS done UNION ALL
  SELECT i + 1, n, list_min(list_transform(range(1, {_CLUSTERS + 1}), lambda k: sqrt({_GAP2('n[k]', 'z[k]')}) < greatest(1e-6, 1e-12 * sqrt(list_sum(list_transform(n[k], lambda x: x * x)))))) FROM (
    SELECT i, z, list_transform(range(1, {_CLUSTERS + 1}), lambda k: coalesce(list_filter(cs, lambda x: x.k = k)[1].c, z[k])) AS n FROM (
      SELECT any_value(i) AS i, any_value(z) AS z, list({{'k': k, 'c': c}}) AS cs FROM (
        SELECT any_value(i) AS i, any_value(z) AS z, k, [{', '.join(f'avg(v[{j}])' for j in _DIMENSIONS)}] AS c FROM (
          SELECT i, z, v, list_position(ds, list_min(ds)) AS k FROM (SELECT i, z, v, list_transform(z, lambda c: {_GAP2('v', 'c')}) AS ds FROM v_km, v_x WHERE NOT done AND i < 100)) GROUP BY k) HAVING count(*) > 0))),
v_z AS (SELECT z FROM v_km ORDER BY i DESC LIMIT 1), v_a AS (SELECT commit_id, list_position(ds, list_min(ds)) - 1 AS k, list_min(ds) AS d FROM (SELECT commit_id, list_transform(z, lambda c: {_GAP2('v', 'c')}) AS ds FROM v_z, v_x))"""


def _clustered(spark, d) -> DataFrame:
    """To convergence over all 14 numbers, from the first rows on."""
    return K.kmeans_exact(_features(spark, d).select("commit_id", *S.FEATURES), S.FEATURES, k=_CLUSTERS, order_by="commit_id")


# Seconds since 1970 are among the numbers: distances are whole numbers of some ten millions, with nine digits that hold.
@query(f"{_LLOYD} SELECT commit_id, CAST(k AS INT) AS cluster, round(sqrt(d), 0) AS distance FROM v_a")
def kmeans_features(spark, d):
    return _clustered(spark, d).select("commit_id", "cluster", F.round(F.sqrt("distance2"), 0).alias("distance"))


@query(f"{_LLOYD} SELECT round(sqrt(sum(d) / count(*)), 0) AS spread FROM v_a")
def inertia(spark, d):
    """As the root of the mean, since the sum has 19 digits."""
    rows = _clustered(spark, d)
    n = F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))  # one row
    return M.inertia(rows).join(n).select(F.round(F.sqrt(F.col("inertia") / F.col("n")), 0).alias("spread"))


# --- text


@query()
def stem_tokens(spark, d):
    return Z.stem_tokens(_texts(spark, d), text="text").select("doc_id", F.array_join("stems", " ").alias("stems"))


_LEAST = 0.75


@query(_with(_TERMS, f""", v_raw AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM v_tokens)) / (1 + df)) + 1) AS raw FROM v_tf JOIN v_vocabulary USING (term)),
  v_w AS MATERIALIZED (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM v_raw),
  v_s AS (SELECT x.doc_id AS a, y.doc_id AS b, round(sum(x.w * y.w), 6) AS similarity FROM v_w x JOIN v_w y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY 1, 2)
  SELECT a, b, similarity FROM v_s WHERE similarity >= {_LEAST}"""))
def pairwise_similarity(spark, d):
    return X.pairwise_similarity(X.tfidf(_texts(spark, d), text="text"), least=_LEAST).select("a", "b", _r("similarity"))


# --- retrieval


def _ranked(spark, d) -> DataFrame:
    return L.explained(V.sbfl_rank(_scores(spark, d), formula="ochiai", top_n=20, min_score=0.1))


_EXPLAINED = f"""{_SCORED_TOP}, v_ranked AS (SELECT file, line, score, rank, passed, failed, tp, tf, 'Executed by ' || CAST(floor(failed * 100.0 / tf) AS BIGINT) || '% of failing tests (' || failed || '/' || tf || ') and '
  || CAST(floor(passed * 100.0 / tp) AS BIGINT) || '% of passing tests (' || passed || '/' || tp || ')' AS told FROM v_top, v_tot WHERE score >= 0.1)"""
# of the score only the number before the point can be a word of a bug: lines have two digits
_BUG_WORDS = _WORDS.replace("TEXT", "title || chr(10) || description || chr(10) || array_to_string(symptoms, ' ') || chr(10) || root_cause || chr(10) || fix_pattern")
_FOUND = f"""{_EXPLAINED}, {oracle("bugs")}, v_bug AS MATERIALIZED (SELECT id, {_BUG_WORDS} AS tokens FROM v_bugs),
v_ask AS (SELECT rank, unnest(list_distinct({_WORDS.replace('TEXT', "replace(file, 'src/', '') || ' line ' || line || ' ' || told || '. Suspiciousness score: ' || CAST(floor(score) AS BIGINT)")})) AS term FROM v_ranked),
v_posting AS (SELECT id, len(tokens) AS length, unnest(tokens) AS term FROM v_bug),
v_tf AS (SELECT id, length, term, count(*) AS tf FROM v_posting WHERE term IN (SELECT term FROM v_ask) GROUP BY ALL),
v_part AS (SELECT id, term, ln(1 + ((SELECT count(*) FROM v_bug) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (SELECT avg(len(tokens)) FROM v_bug))) AS part
  FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM v_tf)),
v_sum AS (SELECT rank, id, round(sum(part), 9) AS raw FROM v_ask JOIN v_part USING (term) GROUP BY 1, 2),
v_hit AS (SELECT rank, id, place, raw / max(raw) OVER (PARTITION BY rank) AS score FROM (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY raw DESC, id) AS place FROM v_sum) WHERE place <= 5)"""


@query(_with(_FOUND, """, v_mean AS (SELECT rank, avg(score) AS similarity, count(*) AS n FROM v_hit GROUP BY rank),
  v_f AS (SELECT file, line, rank, coalesce(similarity, 0) AS s, coalesce(n, 0) AS n_similar, 1.0::DOUBLE / (rank - 1 + 60) + 1.0::DOUBLE / (rank - 1 + 60 + CASE WHEN coalesce(similarity, 0) > 0 THEN 0 ELSE 100 END) AS c FROM v_ranked LEFT JOIN v_mean USING (rank))
  SELECT file, line, CAST(rank AS INT) AS rank, round(s, 6) AS similarity, n_similar, round(c, 8) AS combined, CAST(row_number() OVER (ORDER BY c DESC, rank) AS INT) AS combined_rank FROM v_f"""))
def rag_localize(spark, d):
    out = L.rag_localize(_ranked(spark, d), view(spark, d, "bugs"))
    return out.select("file", "line", "rank", _r("similarity"), "n_similar", _r("combined", 8), "combined_rank")


@query(_with(_FOUND, """SELECT rank AS query_id, CAST(place AS INT) AS rank, b.id AS bug_id, 'Fix pattern for ' || category AS pattern, fix_pattern AS example, 0.7::DOUBLE AS confidence
  FROM v_hit JOIN v_bugs b ON b.id = v_hit.id WHERE place <= 3"""))
def fix_suggestions(spark, d):
    ranked, bugs = _ranked(spark, d), view(spark, d, "bugs")
    text = F.concat_ws(" ", F.element_at(F.split("file", "/"), -1), F.lit("line"), F.col("line").cast("string"), "explanation")
    asked = X.tokenize(ranked.select(F.col("rank").cast("long").alias("query_id"), text.alias("text")))
    return L.fix_suggestions(X.bm25_search(L.bug_tokens(bugs), asked), bugs, limit=3)


# --- datasets and models


@query(_with(_DIAG, " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count({c}) FROM v_mapped), 6) AS percent FROM v_mapped WHERE {c} IS NOT NULL GROUP BY {c}""" for c in ("category", "error_code", "code_class"))))
def value_counts(spark, d):
    rows = D.diagnostic_class(D.map_diagnostics(view(spark, d, "diagnostics")))
    return N.value_counts(rows, ["category", "error_code", "code_class"]).select("column", "value", "n", _r("percent"))


def _import_counts(by: str):
    def f(spark, d):
        return D.import_counts(D.map_diagnostics(view(spark, d, "diagnostics")), by)

    f.__name__ = f"import_by_{by}"
    return query(_with(_TRAINING, f"SELECT {by}, count(*) AS n FROM v_new GROUP BY {by}"))(f)


_import_counts("category")
_import_counts("source_file")


@query(_with(f"{_RULES}, {_TRAINING}", """, v_old AS (SELECT commit_id AS id, category, confidence FROM v_classified WHERE category IS NOT NULL)
  SELECT id, category, round(CAST(confidence AS DOUBLE), 4) AS confidence, NULL AS source_file FROM v_old UNION ALL SELECT id, category, round(CAST(confidence AS DOUBLE), 4), source_file FROM v_new"""))
def merge_training(spark, d):
    old = _classified(spark, d).where("category IS NOT NULL").select(F.col("commit_id").alias("id"), "category", F.col("confidence").cast("double").alias("confidence"))
    return N.merge_training(old, _training(spark, d)).select("id", "category", _r("confidence", 4), "source_file")


@query(_with(oracle("commits"), "SELECT commit_id, row_number() OVER (ORDER BY lines_added DESC, commit_id) AS rank, row_number() OVER (PARTITION BY repo ORDER BY lines_added DESC, commit_id) AS repo_rank FROM v_commits"))
def row_ranks(spark, d):
    rows = N.row_ranks(view(spark, d, "commits").select("commit_id", "repo", "lines_added"), "lines_added", "commit_id")
    return N.row_ranks(rows.withColumnRenamed("rank", "all_rank"), "lines_added", "commit_id", run="repo").select("commit_id", F.col("all_rank").alias("rank"), F.col("rank").alias("repo_rank"))


@query()
def train_text_classifier(spark, d):
    rows = O.dataset_splits(_classified(spark, d).where("category IS NOT NULL"), order_by="timestamp", tie="commit_id")
    rows = X.tokenize(rows.select("split", "message", "category"), text="message")
    model = M.train_text_classifier(rows.where("split = 'train'"))
    return M.classifier_accuracy(model, rows).select("split", "n", _r("accuracy", 4))
