"""Queries of text, time, evaluation, dataset and graph operators, and their SQL."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.functions.taxonomy import CATEGORIES
from faultgrain.operators import coverage as V
from faultgrain.operators import dataset as N
from faultgrain.operators import diagnostics as D
from faultgrain.operators import evaluate as E
from faultgrain.operators import graph as G
from faultgrain.operators import ordering as O
from faultgrain.operators import patterns as P
from faultgrain.operators import text as X
from faultgrain.operators import timeseries as S
from faultgrain.operators.classify import commit_features
from faultgrain.plans.core import _DIAG, _FEATURES, _PATTERNS, _RULES, _TOP, _classified, _r, _scores, _with
from faultgrain.sources.views import oracle, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# --- text

_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_WORDS = f"list_filter(regexp_extract_all(lower(coalesce(TEXT, '')), '{X.WORD}'), lambda w: NOT list_contains([{_STOP}], w))"
_TOKENS = f"v_tokens AS (SELECT doc_id, {_WORDS.replace('TEXT', 'text')} AS tokens FROM documents)"
_TERMS = f"""{_TOKENS}, v_tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM v_tokens) GROUP BY 1, 2),
v_vocabulary AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM v_tf GROUP BY term ORDER BY cf DESC, term LIMIT 1000)"""


def _tokens(spark, d) -> DataFrame:
    return X.tokenize(_texts(spark, d)).drop("text")


def _texts(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


@query(_with(_TOKENS, "SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM v_tokens"))
def tokenize(spark, d):
    return _tokens(spark, d).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query(_with(_TOKENS, """SELECT doc_id, coalesce(array_to_string(list_transform(range(1, CAST(len(tokens) AS BIGINT)), lambda i: tokens[i] || '_' || tokens[i + 1]), ' '), '') AS ngrams FROM v_tokens"""))
def ngrams(spark, d):
    return X.ngrams(_tokens(spark, d), n=2).select("doc_id", F.array_join("ngrams", " ").alias("ngrams"))


@query(_with(_TERMS, "SELECT * FROM v_vocabulary"))
def vocabulary(spark, d):
    return X.vocabulary(_texts(spark, d), text="text")


@query(_with(_TERMS, """, v_raw AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM v_tokens)) / (1 + df)) + 1) AS raw FROM v_tf JOIN v_vocabulary USING (term))
  SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM v_raw"""))
def tfidf(spark, d):
    return X.tfidf(_texts(spark, d), text="text").select("doc_id", "term", _r("weight"))


@query(_with(_TOKENS, f""", v_asked AS (SELECT item_id AS query_id, unnest(list_distinct({_WORDS.replace('TEXT', 'text')})) AS term FROM benchmark),
  v_posting AS (SELECT doc_id, len(tokens) AS length, unnest(tokens) AS term FROM v_tokens),
  v_tf AS (SELECT doc_id, length, term, count(*) AS tf FROM v_posting WHERE term IN (SELECT term FROM v_asked) GROUP BY ALL),
  v_part AS (SELECT doc_id, term, ln(1 + ((SELECT count(*) FROM v_tokens) - df + 0.5) / (df + 0.5)) * tf * 2.2
    / (tf + 1.2 * (0.25 + 0.75 * length / (SELECT avg(len(tokens)) FROM v_tokens))) AS part FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM v_tf)),
  v_scored AS (SELECT query_id, doc_id, round(sum(part), 9) AS raw FROM v_asked JOIN v_part USING (term) GROUP BY 1, 2)
  SELECT query_id, doc_id, CAST(rank AS INT) AS rank, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id) AS rank FROM v_scored) WHERE rank <= 5"""))
def bm25_search(spark, d):
    asked = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return X.bm25_search(_texts(spark, d), asked, text="text").select("query_id", "doc_id", "rank", _r("score"))


# --- time

_SIZE, _HALF = S.HALF_YEAR, S.HALF_YEAR // 2
_WINDOWS = f"""{_FEATURES}, v_ends AS (SELECT min(timestamp) AS low, CAST(floor((max(timestamp) - min(timestamp) - {_SIZE}) / {_HALF}) AS BIGINT) AS last FROM v_features),
v_windows AS (SELECT w AS "window", low + w * {_HALF} AS "start", low + w * {_HALF} + {_SIZE} AS "stop" FROM (SELECT low, unnest(range(0, last + 1)) AS w FROM v_ends)),
v_in AS MATERIALIZED (SELECT w."window", f.*, 0 AS complexity_delta, 4 AS error_code_class, 0 AS has_suggestion, 0 AS suggestion_applicability, 0 AS clippy_lint_count,
  0 AS span_line_delta, 0 AS diagnostic_confidence FROM v_features f JOIN v_windows w ON f.timestamp >= w."start" AND f.timestamp < w."stop")"""


def _correlations(rows: str, by: str, columns: list[str], pairs_as: str) -> str:
    """CTEs: long correlations of columns of a CTE in each group."""
    quoted = [f'"{c}"' for c in columns]
    means = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m{k}" for k, c in enumerate(quoted))
    centred = ", ".join(f"CAST(r.{c} AS DOUBLE) - m{k} AS c{k}" for k, c in enumerate(quoted))
    n = range(len(columns))
    sums = ", ".join(f"sum(c{i} * c{j}) AS s_{i}_{j}" for i in n for j in n if i <= j)
    cell = lambda i, j: "1.0" if i == j else f"CASE WHEN sqrt(s_{i}_{i}) * sqrt(s_{j}_{j}) > 1e-9 THEN s_{min(i, j)}_{max(i, j)} / (sqrt(s_{i}_{i}) * sqrt(s_{j}_{j})) ELSE 0.0 END"
    cells = ", ".join(f"{{'i': {i}, 'j': {j}, 'r': CAST({cell(i, j)} AS DOUBLE)}}" for i in n for j in n)
    return f"""v_m AS (SELECT {by}, {means} FROM {rows} GROUP BY {by}), v_c AS (SELECT r.{by}, {centred} FROM {rows} r JOIN v_m ON v_m.{by} = r.{by}),
v_s AS (SELECT {by}, {sums} FROM v_c GROUP BY {by}), {pairs_as} AS (SELECT {by}, x.i AS i, x.j AS j, x.r AS r FROM (SELECT {by}, unnest([{cells}]) AS x FROM v_s))"""


def _features(spark, d) -> DataFrame:
    return commit_features(view(spark, d, "commits"))


@query(_with(_WINDOWS, 'SELECT "window", "start", "stop" FROM v_windows'))
def time_windows(spark, d):
    return S.time_windows(view(spark, d, "commits"))


@query(_with(_WINDOWS, 'SELECT "window", category, count(*) AS n FROM v_in GROUP BY "window", category'))
def window_counts(spark, d):
    return S.in_windows(_classified(spark, d)).groupBy("window", "category").agg(F.count(F.lit(1)).alias("n"))


_MATRICES = f"{_WINDOWS}, {_correlations('v_in', '"window"', S.FEATURES, 'v_r')}"


@query(_with(_MATRICES, 'SELECT "window", i, j, round(r, 4) AS r FROM v_r'))
def window_correlation(spark, d):
    return S.correlations(S.in_windows(_features(spark, d)), S.FEATURES).select("window", "i", "j", _r("r", 4))


@query(_with(_MATRICES, """, v_n AS (SELECT "window", row_number() OVER (ORDER BY "window") AS n FROM (SELECT DISTINCT "window" FROM v_r)), v_rn AS (SELECT v_r.*, n FROM v_r JOIN v_n USING ("window"))
  SELECT a."window", b."window" AS next_window, round(sqrt(sum((b.r - a.r) * (b.r - a.r))), 4) AS drift, sqrt(sum((b.r - a.r) * (b.r - a.r))) > 0.5 AS significant
  FROM v_rn a JOIN v_rn b ON b.n = a.n + 1 AND b.i = a.i AND b.j = a.j GROUP BY 1, 2"""))
def concept_drift(spark, d):
    out = S.concept_drift(S.correlations(S.in_windows(_features(spark, d)), S.FEATURES))
    return out.select("window", "next_window", _r("drift", 4), "significant")


@query(_with(f"{_FEATURES}, v_all AS MATERIALIZED (SELECT 0 AS k, *, 0 AS complexity_delta, 4 AS error_code_class, 0 AS has_suggestion, 0 AS suggestion_applicability, 0 AS clippy_lint_count, "
  f"0 AS span_line_delta, 0 AS diagnostic_confidence FROM v_features), {_correlations('v_all', 'k', S.FEATURES, 'v_r')}", "SELECT i, j, round(r, 4) AS r FROM v_r"))
def correlation_matrix(spark, d):
    return S.correlation_matrix(_features(spark, d), S.FEATURES).select("i", "j", _r("r", 4))


_COUNT_COLUMNS = ", ".join(f"count(*) FILTER (category = '{c}') AS \"{c}\"" for c in CATEGORIES)


@query(_with(f"{_RULES}, v_wide AS MATERIALIZED (SELECT 0 AS k, repo, {_COUNT_COLUMNS} FROM v_classified WHERE category IS NOT NULL GROUP BY repo), {_correlations('v_wide', 'k', CATEGORIES, 'v_r')}",
  "SELECT i, j, round(r, 4) AS r FROM v_r WHERE abs(r) >= 0.3"))
def category_correlation(spark, d):
    wide = S.category_counts(_classified(spark, d), CATEGORIES)
    return S.correlation_matrix(wide, CATEGORIES).where(F.abs("r") >= 0.3).select("i", "j", _r("r", 4))


_A, _B = CATEGORIES[0], CATEGORIES[1]


@query(_with(_RULES, f""", v_day AS (SELECT CAST(floor(timestamp / 86400) AS BIGINT) AS day, count(*) FILTER (category = '{_A}') AS a, count(*) FILTER (category = '{_B}') AS b
    FROM v_classified WHERE category IS NOT NULL GROUP BY 1), v_days AS (SELECT unnest(range(low, high + 1)) AS day FROM (SELECT min(day) AS low, max(day) AS high FROM v_day)),
  v_full AS (SELECT day, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM v_days LEFT JOIN v_day USING (day))
  SELECT round(corr(CAST(x.a AS DOUBLE), CAST(y.b AS DOUBLE)), 4) AS r FROM v_full x JOIN v_full y ON y.day = x.day + 7"""))
def lagged_correlation(spark, d):
    return S.lagged_correlation(_classified(spark, d), _A, _B, lag=7).select(_r("r", 4))


# --- evaluation

_PREDICTIONS = oracle("predictions")
_CURVE = f"{_PREDICTIONS}, v_curve AS (SELECT *, CAST(sum(label) OVER w AS BIGINT) AS tp, CAST(sum(1 - label) OVER w AS BIGINT) AS fp FROM v_predictions WINDOW w AS (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING))"


@query(_with(_PREDICTIONS, """, v_p AS (SELECT CAST(score >= 0.5 AS INT) AS p, label AS t FROM v_predictions), v_k AS (SELECT DISTINCT unnest([p, t]) AS class FROM v_p),
  v_s AS (SELECT class, count(*) FILTER (p = class AND t = class) AS tp, count(*) FILTER (p = class) AS said, count(*) FILTER (t = class) AS real FROM v_k, v_p GROUP BY class),
  v_x AS (SELECT class, CASE WHEN said = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / said END AS pr, CASE WHEN real = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / real END AS re FROM v_s)
  SELECT class, round(pr, 6) AS "precision", round(re, 6) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1, (SELECT round(avg(CAST(p = t AS INT)), 6) FROM v_p) AS accuracy FROM v_x"""))
def classification_metrics(spark, d):
    rows = view(spark, d, "predictions").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return E.classification_metrics(rows).select("class", *map(_r, ("precision", "recall", "f1", "accuracy")))


@query(_with(_PREDICTIONS, "SELECT round(avg(-pow(1 - p, 2) * ln(p)), 6) AS loss FROM (SELECT greatest(CASE WHEN label = 1 THEN score ELSE 1 - score END, 1e-7) AS p FROM v_predictions)"))
def focal_loss(spark, d):
    return E.focal_loss(view(spark, d, "predictions")).select(_r("loss"))


@query(_with(_CURVE, "SELECT doc_id, tp, fp FROM v_curve"))
def prefix_sums(spark, d):
    return E.prefix_sums(view(spark, d, "predictions"), tie="doc_id").select("doc_id", "tp", "fp")


@query(_with(_CURVE, "SELECT round(sum(CASE WHEN label = 1 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END) / sum(label), 6) AS auprc FROM v_curve"))
def auprc(spark, d):
    return E.auprc(view(spark, d, "predictions"), tie="doc_id").select(_r("auprc"))


@query(_with(_CURVE, 'SELECT round(coalesce(min_by(CAST(tp AS DOUBLE) / (tp + fp), tp + fp), 0), 6) AS "precision" FROM v_curve WHERE CAST(tp AS DOUBLE) / (SELECT sum(label) FROM v_predictions) >= 0.8'))
def precision_at_recall(spark, d):
    return E.precision_at_recall(view(spark, d, "predictions"), tie="doc_id").select(_r("precision"))


_Z = {level: NormalDist().inv_cdf(0.5 + level / 2) for level in E.LEVELS}
_ENDS = "SELECT *, greatest(score - {z} * sqrt(score * (1 - score)), 0) AS low, least(score + {z} * sqrt(score * (1 - score)), 1) AS high FROM v_predictions"


@query(_with(_PREDICTIONS, f""", v_i AS ({_ENDS.format(z=1.96)}), v_b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, abs(avg(score) - avg(label)) AS gap, sum((score - label) * (score - label)) AS e,
    count(*) FILTER (label BETWEEN low AND high) AS i FROM v_i GROUP BY 1)
  SELECT round(sum(e) / sum(n), 6) AS brier, round(sum(gap * n) / sum(n), 6) AS ece, round(max(gap), 6) AS mce, round(CAST(sum(i) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS coverage FROM v_b"""))
def calibration_metrics(spark, d):
    return E.calibration_metrics(view(spark, d, "predictions")).select(*map(_r, ("brier", "ece", "mce", "coverage")))


@query(_with(_PREDICTIONS, ", " + ", ".join(f"v_i{k} AS ({_ENDS.format(z=f'CAST({z!r} AS DOUBLE)')})" for k, z in enumerate(_Z.values())) + " " + " UNION ALL ".join(
  f"SELECT CAST({level} AS DOUBLE) AS level, round(avg(CAST(label BETWEEN low AND high AS INT)), 6) AS coverage, round(avg(high - low), 6) AS width FROM v_i{k} HAVING count(*) > 0" for k, level in enumerate(_Z))))
def coverage_curve(spark, d):
    return E.coverage_curve(view(spark, d, "predictions")).select("level", _r("coverage"), _r("width"))


_VOTES = f"{oracle('file_features')}, v_votes AS (SELECT row_id, " + ", ".join(
    f"CASE WHEN {c} > {a} THEN 1 " + (f"WHEN {c} < {b} THEN -1 " if b is not None else "") + f"ELSE 0 END AS vote_{c}" for c, a, b in E.LABEL_FUNCTIONS
) + " FROM v_file_features)"
_VOTE_NAMES = [f"vote_{c}" for c, _, _ in E.LABEL_FUNCTIONS]


@query(_with(_VOTES, f"SELECT row_id, {', '.join(_VOTE_NAMES)} FROM v_votes"))
def label_functions(spark, d):
    return E.label_functions(view(spark, d, "file_features")).select("row_id", *_VOTE_NAMES)


@query(_with(_VOTES, "SELECT row_id, round(CASE WHEN p + q = 0 THEN 0.5 ELSE CAST(p AS DOUBLE) / (p + q) END, 6) AS probability FROM (SELECT row_id, "
  + " + ".join(f"CAST({v} = 1 AS INT)" for v in _VOTE_NAMES) + " AS p, " + " + ".join(f"CAST({v} = -1 AS INT)" for v in _VOTE_NAMES) + " AS q FROM v_votes)"))
def ensemble_predict(spark, d):
    return E.ensemble_predict(E.label_functions(view(spark, d, "file_features"))).select("row_id", _r("probability"))


# Two functions of a caller's own beside the five: a file suspicious on two counts, and one that nobody touches.
_OWN = {
    "hot_and_complex": "CASE WHEN sbfl_score > 0.6 AND complexity_score > 0.6 THEN 1 WHEN sbfl_score < 0.2 AND complexity_score < 0.2 THEN -1 END",
    "stale": "CASE WHEN churn_score < 0.05 THEN -1 ELSE 0 END",
}
_OWN_NAMES = [*_VOTE_NAMES, *(f"vote_{n}" for n in _OWN)]
_OWN_VOTES = f"{oracle('file_features')}, v_votes AS (SELECT row_id, " + ", ".join(
    f"CASE WHEN {c} > {a} THEN 1 " + (f"WHEN {c} < {b} THEN -1 " if b is not None else "") + f"ELSE 0 END AS vote_{c}" for c, a, b in E.LABEL_FUNCTIONS
) + "".join(f", coalesce({sql}, 0) AS vote_{n}" for n, sql in _OWN.items()) + " FROM v_file_features)"


def _own_votes(spark, d) -> DataFrame:
    return E.label_functions(view(spark, d, "file_features"), [*E.built_in_functions(), *((n, F.expr(sql)) for n, sql in _OWN.items())])


@query(_with(_OWN_VOTES, f"SELECT row_id, {', '.join(_OWN_NAMES)}, round(CASE WHEN p + q = 0 THEN 0.5 ELSE CAST(p AS DOUBLE) / (p + q) END, 6) AS probability FROM (SELECT *, "
  + " + ".join(f"CAST({v} = 1 AS INT)" for v in _OWN_NAMES) + " AS p, " + " + ".join(f"CAST({v} = -1 AS INT)" for v in _OWN_NAMES) + " AS q FROM v_votes)"))
def own_label_functions(spark, d):
    return E.ensemble_predict(_own_votes(spark, d)).select("row_id", *_OWN_NAMES, _r("probability"))


# --- datasets, scores of repositories and files, graph


@query(_with(oracle("commits"), """SELECT commit_id, CASE WHEN p < n * 70 // 100 THEN 'train' WHEN p < n * 70 // 100 + n * 15 // 100 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT commit_id, row_number() OVER (ORDER BY timestamp, commit_id) - 1 AS p, count(*) OVER () AS n FROM v_commits)"""))
def dataset_splits(spark, d):
    return O.dataset_splits(view(spark, d, "commits").select("commit_id", "timestamp"), order_by="timestamp", tie="commit_id").select("commit_id", "split")


@query(_with(oracle("tdg"), "SELECT file, round(total, 6) AS total, CAST(row_number() OVER (ORDER BY total, file) - 1 AS BIGINT) AS position FROM (SELECT file, max(total) AS total FROM v_tdg GROUP BY file)"))
def global_index(spark, d):
    worst = view(spark, d, "tdg").groupBy("file").agg(F.max("total").alias("total"))
    return O.global_index(worst, "total", "file").select("file", _r("total"), "position")


@query(_with(f"{_PATTERNS}, {oracle('tdg')}, v_q AS (SELECT repo, round(avg(total), 6) AS avg_tdg, round(greatest(max(total), 0), 6) AS max_tdg FROM v_tdg GROUP BY repo)",
  "SELECT repo, category, frequency, avg_tdg, max_tdg FROM v_patterns LEFT JOIN v_q USING (repo)"))
def enrich_tdg_patterns(spark, d):
    out = P.defect_patterns(_classified(spark, d)).join(V.tdg_by_repo(view(spark, d, "tdg")), "repo", "left")
    return out.select("repo", "category", "frequency", _r("avg_tdg"), _r("max_tdg"))


@query(_with(f"{_TOP}, {oracle('tdg')}", "SELECT t.file, line, CAST(rank AS INT) AS rank, tdg FROM v_top t LEFT JOIN (SELECT file, max(total) AS tdg FROM v_tdg GROUP BY file) q ON q.file = t.file"))
def enrich_tdg_ranking(spark, d):
    tdg = view(spark, d, "tdg").groupBy("file").agg(F.max("total").alias("tdg"))
    return V.sbfl_rank(_scores(spark, d), formula="ochiai", top_n=20).join(tdg, "file", "left").select("file", "line", "rank", "tdg")


@query(_with(oracle("changed_lines"), """, v_f AS (SELECT DISTINCT fix_commit, file FROM v_changed_lines)
  SELECT a.file AS source_file, b.file AS target_file, count(*) AS weight FROM v_f a JOIN v_f b ON a.fix_commit = b.fix_commit AND a.file < b.file GROUP BY 1, 2"""))
def cochange_edges(spark, d):
    return G.cochange_edges(view(spark, d, "changed_lines"))


def _training(spark, d):
    return D.diagnostics_to_training(D.map_diagnostics(view(spark, d, "diagnostics"))).select(F.col("event_id").alias("id"), "category", "confidence", "source_file")


_TRAINING = f"{_DIAG}, v_new AS (SELECT event_id AS id, category, confidence, source_file FROM v_mapped WHERE confidence >= 0.75 AND category IS NOT NULL)"


@query(_with(f"{_RULES}, {_TRAINING}", """, v_old AS (SELECT commit_id AS id, category, confidence FROM v_classified WHERE category IS NOT NULL)
  SELECT id, category, round(CAST(confidence AS DOUBLE), 4) AS confidence, NULL AS source_file, 1.0::DOUBLE AS weight FROM v_old
  UNION ALL SELECT id, category, round(CAST(confidence AS DOUBLE), 4), source_file, 2.0 FROM v_new"""))
def merge_weighted(spark, d):
    old = _classified(spark, d).where("category IS NOT NULL").select(F.col("commit_id").alias("id"), "category", F.col("confidence").cast("double").alias("confidence"))
    merged = N.merge_training(old, _training(spark, d), strategy="weighted", weight=2.0)
    return merged.select("id", "category", _r("confidence", 4), "source_file", "weight")


@query(_with(_TRAINING, "SELECT category, count(*) AS n, round(avg(confidence), 6) AS avg_confidence, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM v_new GROUP BY category"))
def dataset_stats(spark, d):
    return N.dataset_stats(_training(spark, d)).select("category", "n", _r("avg_confidence"), "total")


@query(_with(_TRAINING, "SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INT) AS label FROM (SELECT DISTINCT category FROM v_new)"))
def category_index(spark, d):
    return N.category_index(_training(spark, d))
