"""Queries over the derived views, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.functions import taxonomy as T
from faultgrain.operators import classify as C
from faultgrain.operators import coverage as V
from faultgrain.operators import diagnostics as D
from faultgrain.operators import patterns as P
from faultgrain.sources.views import oracle, view

REPOS = [f"repo-{i}" for i in range(20)]


def _r(name: str, places: int = 6):
    return F.round(F.col(name).cast("double"), places).alias(name)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_RULE_ROWS = ", ".join(f"({i}, {_quoted(c)}, CAST({b} AS FLOAT), {k}, {_quoted(p)})" for i, (c, b, ps) in enumerate(T.RULES) for k, p in enumerate(ps))
_CATEGORY_ROWS = ", ".join(f"({i}, {_quoted(c)})" for i, c in enumerate(T.CATEGORIES))
_RULES = f"""{oracle("commits")},
v_rules AS (SELECT * FROM (VALUES {_RULE_ROWS}) AS r(rule, category, base, k, pattern)),
v_hits AS (SELECT commit_id, rule, category, least(base + CAST(count(*) - 1 AS FLOAT) * CAST(0.05 AS FLOAT), CAST(0.95 AS FLOAT)) AS confidence,
  string_agg(pattern, '|' ORDER BY k) AS patterns FROM v_commits JOIN v_rules ON contains(lower(message), pattern) GROUP BY commit_id, rule, category, base),
v_ranked AS (SELECT *, row_number() OVER (PARTITION BY commit_id ORDER BY confidence DESC, rule) AS place FROM v_hits),
v_classified AS (SELECT c.*, r.category, r.confidence, r.patterns FROM v_commits c LEFT JOIN v_ranked r ON r.commit_id = c.commit_id AND r.place = 1)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _classified(spark, d) -> DataFrame:
    return C.classify_commits(view(spark, d, "commits"))


def _with(ctes: str, body: str) -> str:
    """A statement; a body that starts with a comma goes on with CTEs of its own."""
    return f"WITH {ctes}{body}" if body.startswith(",") else f"WITH {ctes} {body}"


@query(_with(_RULES, """SELECT commit_id, category, round(CAST(confidence AS DOUBLE), 4) AS confidence, patterns,
  'Classified as ''' || category || ''' based on patterns: ' || replace(patterns, '|', ', ') || '. Confidence: ' || CAST(round(CAST(confidence AS DOUBLE) * 100) AS INT) || '%' AS explanation FROM v_classified"""))
def classify_commits(spark, d):
    out = _classified(spark, d)
    return out.select("commit_id", "category", _r("confidence", 4), F.array_join("matched_patterns", "|").alias("patterns"), "explanation")


@query(_with(_RULES, """SELECT commit_id, CAST(place - 1 AS INT) AS place, category, round(CAST(confidence AS DOUBLE), 4) AS confidence
  FROM v_ranked WHERE place <= 3 AND confidence >= CAST(0.6 AS FLOAT)"""))
def explode_labels(spark, d):
    return C.explode_labels(C.classify_multi(view(spark, d, "commits"))).select("commit_id", "place", "category", _r("confidence", 4))


@query(_with(_RULES, """SELECT commit_id, string_agg(category || ':' || CAST(CAST(round(CAST(confidence AS DOUBLE) * 100) AS INT) AS VARCHAR), '|' ORDER BY place) AS categories,
  max(CASE WHEN place = 1 THEN category END) AS primary_category FROM v_ranked WHERE place <= 3 AND confidence >= CAST(0.6 AS FLOAT) GROUP BY commit_id"""))
def classify_multi(spark, d):
    shown = F.transform("categories", lambda x: F.concat_ws(":", x["category"], F.round(x["confidence"].cast("double") * 100).cast("int")))
    return C.classify_multi(view(spark, d, "commits")).select("commit_id", F.array_join(shown, "|").alias("categories"), F.col("categories")[0]["category"].alias("primary_category"))


_FIX = """(NOT (starts_with(m, 'merge') OR starts_with(m, 'revert') OR contains(m, 'wip') OR contains(m, 'work in progress'))
  AND (starts_with(m, 'fix:') OR starts_with(m, 'bug:') OR starts_with(m, 'patch:') OR contains(m, 'fix ') OR contains(m, 'bug ')
  OR contains(m, 'error') OR contains(m, 'crash') OR contains(m, 'issue')))"""


@query(_with(oracle("commits"), f"SELECT commit_id, message FROM (SELECT *, lower(message) AS m FROM v_commits) WHERE {_FIX}"))
def filter_defect_fix(spark, d):
    return C.filter_defect_fix(view(spark, d, "commits")).select("commit_id", "message")


@query(_with(oracle("commits"), "SELECT commit_id, message FROM (SELECT *, lower(message) AS m FROM v_commits) WHERE " + " OR ".join(f"contains(m, '{p}')" for p in C.BUG_FIX_MARKS) + " OR (contains(m, '#') AND regexp_matches(m, '[0-9]'))"))
def filter_bug_fix(spark, d):
    return C.filter_bug_fix(view(spark, d, "commits")).select("commit_id", "message")


@query(_with(f"{_RULES}, v_names AS (SELECT * FROM (VALUES {_CATEGORY_ROWS}) AS n(label, category))",
  "SELECT commit_id, category, CAST(label AS TINYINT) AS label FROM v_classified LEFT JOIN v_names USING (category)"))
def encode_label(spark, d):
    return C.encode_label(_classified(spark, d)).select("commit_id", "category", "label")


_FEATURES = f"""{_RULES}, v_names AS (SELECT * FROM (VALUES {_CATEGORY_ROWS}) AS n(label, category)),
v_features AS (SELECT commit_id, CAST(coalesce(label, 0) AS INT) AS defect_category, files_changed, lines_added, lines_removed AS lines_deleted, timestamp,
  CAST(floor(timestamp / 3600) AS BIGINT) % 24 AS hour_of_day, (CAST(floor(timestamp / 86400) AS BIGINT) + 3) % 7 AS day_of_week, category, confidence
  FROM v_classified LEFT JOIN v_names USING (category))"""
_FEATURE_NAMES = ["commit_id", "defect_category", "files_changed", "lines_added", "lines_deleted", "timestamp", "hour_of_day", "day_of_week"]
_FEATURE_SQL = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _FEATURE_NAMES)


def _features(spark, d, **options):
    return C.commit_features(view(spark, d, "commits"), **options).select(*(F.col(c).cast("long").alias(c) for c in _FEATURE_NAMES))


@query(_with(_FEATURES, f"SELECT {_FEATURE_SQL} FROM v_features"))
def extract_features(spark, d):
    return _features(spark, d)


@query(_with(_FEATURES, f"SELECT {_FEATURE_SQL} FROM v_features WHERE confidence >= CAST(0.8 AS FLOAT)"))
def commit_features(spark, d):
    return _features(spark, d, unclassified="drop", min_confidence=0.8)


@query(_with(_FEATURES, f"SELECT {_FEATURE_SQL} FROM v_features WHERE defect_category = 1"))
def features_by_category(spark, d):
    return _features(spark, d).where("defect_category = 1")


@query(_with(_FEATURES, f"SELECT {_FEATURE_SQL} FROM v_features WHERE timestamp >= 800000000 AND timestamp < 850000000"))
def features_by_time(spark, d):
    return _features(spark, d).where("timestamp >= 800000000 AND timestamp < 850000000")


_PATTERNS = f"""{_RULES}, v_places AS (SELECT *, row_number() OVER (PARTITION BY repo, category ORDER BY timestamp DESC, commit_id) AS place FROM v_classified WHERE category IS NOT NULL),
v_patterns AS (SELECT repo, category, count(*) AS frequency, round(avg(CAST(confidence AS DOUBLE)), 6) AS confidence, round(avg(lines_added + lines_removed), 6) AS avg_lines,
  round(avg(files_changed), 6) AS avg_files, string_agg(substr(hash, 1, 8), '|' ORDER BY place) FILTER (place <= 3) AS examples,
  string_agg('REDACTED', '|') FILTER (place <= 3) AS redacted FROM v_places GROUP BY repo, category)"""


def _patterns(df):
    hashes = F.array_join(F.transform("examples", lambda e: e["commit_hash"]), "|")
    return df.select("repo", "category", "frequency", _r("confidence"), _r("avg_lines"), _r("avg_files"), hashes.alias("examples"))


@query(_with(_PATTERNS, "SELECT repo, category, frequency, confidence, avg_lines, avg_files, examples FROM v_patterns"))
def defect_patterns(spark, d):
    return _patterns(P.defect_patterns(_classified(spark, d)))


@query(_with(_PATTERNS, "SELECT repo, category, frequency, confidence, avg_lines, avg_files, redacted AS examples FROM v_patterns"))
def strip_pii(spark, d):
    return _patterns(P.strip_pii(P.defect_patterns(_classified(spark, d))))


@query(_with(_PATTERNS, "SELECT repo, category, frequency, confidence, avg_lines, avg_files, examples FROM v_patterns WHERE frequency >= 5 ORDER BY frequency DESC, repo, category LIMIT 10"))
def summarize(spark, d):
    return _patterns(P.summarize(P.defect_patterns(_classified(spark, d))))


@query(_with(_RULES, """SELECT repo, category, CAST(grouping(repo) * 2 + grouping(category) AS BIGINT) AS level, count(*) AS frequency,
  round(avg(CAST(confidence AS DOUBLE)), 6) AS confidence, round(avg(lines_added + lines_removed), 6) AS avg_lines, round(avg(files_changed), 6) AS avg_files
  FROM v_classified WHERE category IS NOT NULL GROUP BY ROLLUP (repo, category)"""))
def org_rollup(spark, d):
    return P.org_rollup(_classified(spark, d)).select("repo", "category", "level", "frequency", _r("confidence"), _r("avg_lines"), _r("avg_files"))


_COUNTS = f"{_RULES}, v_counts AS (SELECT category, count(*) AS n FROM v_classified WHERE category IS NOT NULL GROUP BY category)"


@query(_with(f"{_COUNTS}, v_names AS (SELECT * FROM (VALUES {_CATEGORY_ROWS}) AS n(label, category))", "SELECT category, coalesce(n, 0) AS n FROM v_names LEFT JOIN v_counts USING (category)"))
def count_by_category(spark, d):
    return P.count_by_category(_classified(spark, d))


@query(_with(_COUNTS, "SELECT category, n FROM v_counts ORDER BY n DESC, category LIMIT 5"))
def most_common_defect(spark, d):
    return P.most_common_defect(_classified(spark, d))


@query(_with(_COUNTS, "SELECT category, n, round(n * 100.0 / (SELECT sum(n) FROM v_counts), 6) AS percent FROM v_counts"))
def defect_distribution(spark, d):
    return P.defect_distribution(_classified(spark, d)).select("category", "n", _r("percent"))


@query(_with(_COUNTS, "SELECT category, n, round(n * 100.0 / (SELECT sum(n) FROM v_counts), 6) AS percent FROM v_counts ORDER BY n DESC, category LIMIT 10"))
def top_classes(spark, d):
    return P.defect_distribution(_classified(spark, d)).orderBy(F.desc("n"), "category").limit(10).select("category", "n", _r("percent"))


@query(_with(_RULES, """SELECT count(*) AS n, round(min(c), 6) AS least, round(max(c), 6) AS most, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std
  FROM (SELECT CAST(confidence AS DOUBLE) AS c FROM v_classified WHERE category IS NOT NULL)"""))
def confidence_stats(spark, d):
    return P.confidence_stats(_classified(spark, d)).select("n", _r("least"), _r("most"), _r("mean"), _r("std"))


@query(_with(_RULES, """SELECT bin, count(*) AS n FROM (SELECT CAST(least(floor((c - low) / ((high - low) / 5)), 4) AS INT) AS bin FROM
  (SELECT CAST(confidence AS DOUBLE) AS c FROM v_classified WHERE category IS NOT NULL),
  (SELECT min(CAST(confidence AS DOUBLE)) AS low, max(CAST(confidence AS DOUBLE)) AS high FROM v_classified WHERE category IS NOT NULL)) GROUP BY bin"""))
def confidence_histogram(spark, d):
    return P.confidence_histogram(_classified(spark, d))


@query(_with(f"{_RULES}, v_n AS (SELECT repo, category, count(*) AS n FROM v_classified WHERE category IS NOT NULL GROUP BY repo, category), v_p AS (SELECT repo, category, n * 100.0 / sum(n) OVER (PARTITION BY repo) AS p FROM v_n)",
  "SELECT category, " + ", ".join(f"round(CAST(coalesce(max(CASE WHEN repo = '{r}' THEN p END), 0) AS DOUBLE), 6) AS \"{r}\"" for r in REPOS) + " FROM v_p GROUP BY category"))
def cross_repo_matrix(spark, d):
    return P.cross_repo_matrix(_classified(spark, d), REPOS).select("category", *(F.round(F.col(f"`{r}`"), 6).alias(r) for r in REPOS))


@query(_with(_COUNTS, "SELECT category, n, round((SELECT sum(n) FROM v_counts) / ((SELECT count(*) FROM v_counts) * n), 6) AS weight FROM v_counts"))
def class_weights(spark, d):
    return P.class_weights(_classified(spark, d), label="category").select("category", "n", _r("weight"))


@query(_with(_RULES, """SELECT category, period, n, n - lag(n) OVER (PARTITION BY category ORDER BY period) AS change FROM (SELECT category,
  CAST(epoch(date_trunc('month', make_timestamp(timestamp * 1000000))) AS BIGINT) AS period, count(*) AS n FROM v_classified WHERE category IS NOT NULL GROUP BY 1, 2)"""))
def defect_trend(spark, d):
    return P.defect_trend(_classified(spark, d))


@query(_with(_RULES, f"SELECT commit_id, category, round(CAST(confidence AS DOUBLE), 4) AS confidence FROM (SELECT *, lower(message) AS m FROM v_classified) WHERE confidence >= CAST(0.75 AS FLOAT) AND {_FIX}"))
def training_examples(spark, d):
    out = C.classify_commits(C.filter_defect_fix(view(spark, d, "commits")))
    return out.where(F.col("confidence") >= F.lit(0.75).cast("float")).select("commit_id", "category", _r("confidence", 4))


# --- fault localisation

_STATEMENTS = f"""{oracle("coverage")}, v_st AS (SELECT file, line, count(DISTINCT CASE WHEN NOT failed THEN test_id END) AS passed,
  count(DISTINCT CASE WHEN failed THEN test_id END) AS failed FROM v_coverage WHERE hits > 0 GROUP BY file, line),
v_tot AS (SELECT count(DISTINCT CASE WHEN NOT failed THEN test_id END) AS tp, count(DISTINCT CASE WHEN failed THEN test_id END) AS tf FROM v_coverage),
v_fp AS (SELECT file, line, passed, failed, tp, tf, CAST(failed AS DOUBLE) / tf AS f, CAST(passed AS DOUBLE) / tp AS p FROM v_st, v_tot),
v_scores AS (SELECT file, line, passed, failed, CASE WHEN f + p = 0 THEN 0 ELSE f / (f + p) END AS tarantula,
  CASE WHEN failed + passed = 0 THEN 0 ELSE failed / sqrt(CAST(tf AS DOUBLE) * (failed + passed)) END AS ochiai,
  CASE WHEN passed + tf - failed = 0 THEN CASE WHEN failed > 0 THEN {V.LARGEST} ELSE 0 END ELSE pow(CAST(failed AS DOUBLE), 2) / (passed + tf - failed) END AS dstar2,
  CASE WHEN passed + tf - failed = 0 THEN CASE WHEN failed > 0 THEN {V.LARGEST} ELSE 0 END ELSE pow(CAST(failed AS DOUBLE), 3) / (passed + tf - failed) END AS dstar3 FROM v_fp)"""


def _scores(spark, d):
    coverage = view(spark, d, "coverage")
    return V.sbfl_scores(V.combine_coverage(coverage), V.test_totals(coverage))


@query(_with(_STATEMENTS, "SELECT file, line, passed, failed FROM v_st"))
def combine_coverage(spark, d):
    return V.combine_coverage(view(spark, d, "coverage"))


@query(_with(_STATEMENTS, "SELECT file, line, passed, failed, round(tarantula, 6) AS tarantula, round(ochiai, 6) AS ochiai, round(dstar2, 6) AS dstar2, round(dstar3, 6) AS dstar3 FROM v_scores"))
def sbfl_scores(spark, d):
    return _scores(spark, d).select("file", "line", "passed", "failed", *map(_r, ("tarantula", "ochiai", "dstar2", "dstar3")))


_TOP = f"{_STATEMENTS}, v_top AS (SELECT file, line, ochiai AS score, row_number() OVER (ORDER BY ochiai DESC, file, line) AS rank FROM v_scores QUALIFY rank <= 20)"


_SCORED_TOP = f"{_STATEMENTS}, v_top AS (SELECT file, line, passed, failed, ochiai AS score, row_number() OVER (ORDER BY ochiai DESC, file, line) AS rank FROM v_scores QUALIFY rank <= 20)"


@query(_with(_TOP, "SELECT file, line, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM v_top WHERE score >= 0.1"))
def sbfl_rank(spark, d):
    return V.sbfl_rank(_scores(spark, d), formula="ochiai", top_n=20, min_score=0.1).select("file", "line", _r("score"), "rank")


_SZZ = f"""{oracle("changed_lines")}, {oracle("blame")}, v_hit AS (SELECT c.fix_commit, c.file, c.line, b.commit_id FROM v_changed_lines c JOIN v_blame b ON b.file = c.file AND b.line = c.line WHERE was_deleted),
v_szz AS (SELECT fix_commit, count(DISTINCT CASE WHEN commit_id <> fix_commit THEN commit_id END) AS n FROM v_hit GROUP BY fix_commit),
v_hist AS (SELECT file, CAST(count(*) AS DOUBLE) / (SELECT count(DISTINCT fix_commit) FROM v_changed_lines) AS history FROM (SELECT DISTINCT fix_commit, file, line FROM v_hit) GROUP BY file)"""


@query(_with(_SZZ, """SELECT f.fix_commit, CAST(coalesce(n, 0) AS BIGINT) AS n_introducing, CASE WHEN coalesce(n, 0) = 1 THEN 'High' WHEN n > 1 THEN 'Medium' ELSE 'Low' END AS confidence,
  (SELECT count(DISTINCT (file, line)) FROM v_hit h WHERE h.fix_commit = f.fix_commit) AS n_faulty,
  coalesce((SELECT string_agg(x, '|' ORDER BY c) FROM (SELECT DISTINCT commit_id AS c, CAST(commit_id AS VARCHAR) AS x FROM v_hit h WHERE h.fix_commit = f.fix_commit AND commit_id <> f.fix_commit)), '') AS introducing
  FROM (SELECT DISTINCT fix_commit FROM v_changed_lines) f LEFT JOIN v_szz s ON s.fix_commit = f.fix_commit"""))
def szz_trace(spark, d):
    out = V.szz_trace(view(spark, d, "changed_lines"), view(spark, d, "blame"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    shown = F.coalesce(F.array_join(F.transform("introducing", lambda x: x.cast("string")), "|"), F.lit(""))
    return out.select("fix_commit", n("introducing").alias("n_introducing"), "confidence", n("faulty_lines").alias("n_faulty"), shown.alias("introducing"))


def _history(spark, d):
    return V.file_history(view(spark, d, "changed_lines"), view(spark, d, "blame"))


@query(_with(_SZZ, "SELECT file, round(history, 6) AS history FROM v_hist"))
def file_history(spark, d):
    return _history(spark, d).select("file", _r("history"))


@query(_with(f"{_TOP}, {_SZZ}", """SELECT file, line, round(s, 6) AS score, CAST(row_number() OVER (ORDER BY s DESC, file, line) AS INT) AS rank
  FROM (SELECT t.file, line, 0.7 * score + (1 - CAST(0.7 AS DOUBLE)) * coalesce(history, 0) AS s FROM v_top t LEFT JOIN v_hist h ON h.file = t.file)"""))
def hybrid_rank(spark, d):
    return V.hybrid_rank(V.sbfl_rank(_scores(spark, d), formula="ochiai", top_n=20), _history(spark, d)).select("file", "line", _r("score"), "rank")


@query(_with(oracle("changed_lines"), "SELECT file, round(CAST(n AS DOUBLE) / max(n) OVER (), 6) AS churn FROM (SELECT file, count(DISTINCT fix_commit) AS n FROM v_changed_lines GROUP BY file)"))
def file_churn(spark, d):
    return V.file_churn(view(spark, d, "changed_lines")).select("file", _r("churn"))


@query(_with(oracle("tdg"), "SELECT repo, round(avg(total), 6) AS avg_tdg, round(greatest(max(total), 0), 6) AS max_tdg FROM v_tdg GROUP BY repo"))
def tdg_by_repo(spark, d):
    return V.tdg_by_repo(view(spark, d, "tdg")).select("repo", _r("avg_tdg"), _r("max_tdg"))


# --- diagnostics


def _table(table: dict, name: str, value: str) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(f'({_quoted(k)}, {_quoted(v) if isinstance(v, str) else v})' for k, v in table.items())}) AS t(k, {value}))"


_DIAG = f"""{oracle("diagnostics")}, {_table(T.CODE_CATEGORY, "v_code", "c1")}, {_table(T.LINT_CATEGORY, "v_lint", "c2")}, {_table(T.CODE_CONFIDENCE, "v_conf", "x")}, {_table(T.CODE_CLASS, "v_class", "y")},
v_mapped AS (SELECT d.*, coalesce(CASE WHEN given_category IN ({", ".join(map(_quoted, T.CATEGORIES))}) THEN given_category END, c1, c2) AS category,
  CAST(coalesce(x, 0.7) AS DOUBLE) AS code_confidence, coalesce(y, 'other') AS code_class FROM v_diagnostics d
  LEFT JOIN v_code a ON a.k = error_code LEFT JOIN v_lint b ON b.k = clippy_lint LEFT JOIN v_conf c ON c.k = error_code LEFT JOIN v_class e ON e.k = error_code)"""


@query(_with(_DIAG, "SELECT event_id, category FROM v_mapped"))
def map_diagnostics(spark, d):
    return D.map_diagnostics(view(spark, d, "diagnostics")).select("event_id", "category")


@query(_with(_DIAG, "SELECT event_id, code_confidence, code_class FROM v_mapped"))
def diagnostic_class(spark, d):
    return D.diagnostic_class(view(spark, d, "diagnostics")).select("event_id", "code_confidence", "code_class")


@query(_with(_DIAG, """SELECT count(*) AS total, count(*) FILTER (confidence >= 0.75 AND category IS NOT NULL) AS imported, count(*) FILTER (confidence < 0.75) AS skipped_low_confidence,
  count(*) FILTER (confidence >= 0.75 AND category IS NULL) AS skipped_unknown, round(avg(confidence) FILTER (confidence >= 0.75 AND category IS NOT NULL), 6) AS avg_confidence FROM v_mapped"""))
def import_stats(spark, d):
    out = D.import_stats(D.map_diagnostics(view(spark, d, "diagnostics")))
    return out.select("total", "imported", "skipped_low_confidence", "skipped_unknown", _r("avg_confidence"))


@query(_with(_DIAG, "SELECT event_id, source_file, category, confidence FROM v_mapped WHERE confidence >= 0.75 AND category IS NOT NULL"))
def diagnostics_to_training(spark, d):
    return D.diagnostics_to_training(D.map_diagnostics(view(spark, d, "diagnostics"))).select("event_id", "source_file", "category", "confidence")
