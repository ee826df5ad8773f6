"""Queries that write derived tables and read them back by each source, sink and stream, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultgrain.operators import coverage as V
from faultgrain.operators import patterns as P
from faultgrain.operators import review as R
from faultgrain.plans.analysis import _features
from faultgrain.plans.core import _CATEGORY_ROWS, _FEATURE_NAMES, _FEATURE_SQL, _FEATURES, _PATTERNS, _RULES, _classified, _r, _with
from faultgrain.plans.learning import _REVIEW, _files
from faultgrain.sources import files as S
from faultgrain.sources.scratch import scratch_path
from faultgrain.sources.views import oracle, view
from faultgrain.streaming import commits as W

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# --- sources

_DIAGNOSTIC_SQL = _with(oracle("diagnostics"), "SELECT source_file, error_code, clippy_lint, given_category, round(confidence, 4) AS confidence, timestamp FROM v_diagnostics")


def _diagnostics(rows: DataFrame) -> DataFrame:
    return rows.select("source_file", "error_code", "clippy_lint", "given_category", _r("confidence", 4), "timestamp")


@query(_DIAGNOSTIC_SQL)
def src_diagnostics_jsonl(spark, d):
    path = scratch_path(spark, "diagnostics-json")
    view(spark, d, "diagnostics").drop("event_id").withColumn("message", F.lit("m")).write.json(path)
    return _diagnostics(S.read_diagnostics_json(spark, path))


@query(_DIAGNOSTIC_SQL)
def src_diagnostics_parquet(spark, d):
    path = scratch_path(spark, "diagnostics-parquet")
    view(spark, d, "diagnostics").write.parquet(path)
    return _diagnostics(S.read_diagnostics_parquet(spark, path))


@query(_with(oracle("coverage"), "SELECT file, line, CAST(sum(hits) AS BIGINT) AS hits FROM v_coverage GROUP BY file, line"))
def src_lcov(spark, d):
    """Counts of each file as one record of LCOV text, as coverage tools write it."""
    path = scratch_path(spark, "lcov")
    n = view(spark, d, "coverage").groupBy("file", "line").agg(F.sum("hits").alias("hits"))
    record = F.array_join(F.sort_array(F.collect_list(F.format_string("DA:%d,%d", "line", "hits"))), "\n")
    n.groupBy("file").agg(record.alias("r")).select(F.concat(F.lit("SF:"), "file", F.lit("\n"), "r", F.lit("\nend_of_record")).alias("value")).write.text(path)
    return S.read_lcov(spark, path)


@query(_with(oracle("tdg"), "SELECT repo || '/' || file AS file, total, CASE WHEN total >= 60 THEN 'A' ELSE 'C' END AS grade FROM v_tdg"))
def src_tdg(spark, d):
    path = scratch_path(spark, "tdg")
    grade = F.when(F.col("total") >= 60, "A").otherwise("C").alias("grade")
    rows = view(spark, d, "tdg").select("repo", F.struct(F.concat_ws("/", "repo", "file").alias("file_path"), "total", grade).alias("f"))
    rows.groupBy("repo").agg(F.collect_list("f").alias("files")).select("files").repartition("files").write.option("maxRecordsPerFile", 1).json(path)
    return S.read_tdg(spark, path)


@query(_with(oracle("bugs"), "SELECT id, title, description, category, severity, array_to_string(affected_files, ',') AS affected_files, array_to_string(symptoms, ',') AS symptoms, root_cause, fix_pattern FROM v_bugs"))
def src_bug_kb(spark, d):
    path = scratch_path(spark, "bugs")
    S.save_bugs(view(spark, d, "bugs"), path)
    joined = [F.array_join(c, ",").alias(c) for c in ("affected_files", "symptoms")]
    return S.read_bugs(spark, path).select("id", "title", "description", "category", "severity", *joined, "root_cause", "fix_pattern")


# --- sinks


@query(_with(_FEATURES, f"SELECT {_FEATURE_SQL} FROM v_features WHERE defect_category = 3"))
def feature_store(spark, d):
    path = scratch_path(spark, "features")
    S.save_features(_features(spark, d), path)
    return S.features_of(spark, path, 3).select(*(F.col(c).cast("long").alias(c) for c in _FEATURE_NAMES))


@query(_with(_FEATURES, """SELECT label, count(*) AS n, CAST(sum(files_changed) AS DOUBLE) AS files_changed, CAST(sum(hour_of_day) AS DOUBLE) AS hour_of_day, 2 AS n_features, (SELECT count(DISTINCT defect_category) FROM v_features) AS n_classes
  FROM (SELECT CAST(defect_category AS INT) AS label, files_changed, hour_of_day FROM v_features) GROUP BY label"""))
def export_features(spark, d):
    path = scratch_path(spark, "exported")
    about = S.export_features(_features(spark, d).withColumn("defect_category", F.col("defect_category").cast("int")), path, ["files_changed", "hour_of_day"])
    out = S.load_features(spark, path).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("files_changed").alias("files_changed"), F.sum("hour_of_day").alias("hour_of_day"))
    return out.join(F.broadcast(about.select("n_features", "n_classes")))  # one row


@query(_with(_PATTERNS, "SELECT repo, category, frequency, confidence, avg_lines, examples FROM v_patterns"))
def write_report(spark, d):
    path = scratch_path(spark, "report")
    rows = P.defect_patterns(_classified(spark, d))
    S.write_report(rows, path)
    back = spark.read.schema(rows.schema).json(path)
    hashes = F.array_join(F.transform("examples", lambda e: e["commit_hash"]), "|")
    return back.select("repo", "category", "frequency", _r("confidence"), _r("avg_lines"), hashes.alias("examples"))


@query(_with(f"{_RULES}, v_counts AS (SELECT category, count(*) AS n FROM v_classified WHERE category IS NOT NULL GROUP BY category), v_names AS (SELECT * FROM (VALUES {_CATEGORY_ROWS}) AS n(label, category))",
  "SELECT category, coalesce(n, 0) AS n FROM v_names LEFT JOIN v_counts USING (category)"))
def export_query_result(spark, d):
    path = scratch_path(spark, "counts")
    S.write_report(P.count_by_category(_classified(spark, d)), path, form="csv")
    return spark.read.csv(path, header=True, schema="category string, n long")


# --- streams: parts of the input arrive one after the other, and the query starts anew from its checkpoint for each

_SLICES = 6


def _drained(spark: SparkSession, parts, stream, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    return W.drained(spark, parts, stream, source=f"{path}/source", sink=f"{path}/sink", state=f"{path}/state")


@query(_with(_FEATURES, f"SELECT {_FEATURE_SQL} FROM v_features"))
def stream_classify(spark, d):
    shown = [F.col(c).cast("long").alias(c) for c in _FEATURE_NAMES]
    return _drained(spark, W.in_order_of_time(view(spark, d, "commits"), slices=_SLICES), lambda s: W.stream_classify(s).select(*shown), "stream-classified")


@query(_with(_RULES, """, v_at AS (SELECT category, timestamp AS t FROM v_classified WHERE category IS NOT NULL), v_w AS (SELECT category, unnest([t // 7776000, t // 7776000 - 1]) * 7776000 AS start FROM v_at)
  SELECT CAST(start AS BIGINT) AS start, CAST(start + 15552000 AS BIGINT) AS stop, category, count(*) AS n FROM v_w GROUP BY 1, 2, 3"""))
def stream_window_counts(spark, d):
    """All windows, as in a batch: parts come in the order of time, and a last row brings out the windows that are still open."""
    commits = view(spark, d, "commits")

    def parts():
        yield from W.in_order_of_time(commits, slices=_SLICES)
        yield W.flush_row(commits, after=300 * 86400)

    out = _drained(spark, parts(), lambda s: W.stream_window_counts(W.stream_classify(s)), "stream-counts")
    return out.select(F.unix_timestamp("start").alias("start"), F.unix_timestamp("stop").alias("stop"), "category", "n")


@query(_with(_REVIEW, "SELECT * FROM v_warned"))
def stream_review(spark, d):
    known = R.baseline(P.defect_patterns(_classified(spark, d)), V.tdg_by_repo(view(spark, d, "tdg")))
    files = _files(spark, d).withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(3)))
    parts = (files.where(F.col("bucket") == k).drop("bucket") for k in range(3))
    return _drained(spark, parts, lambda s: W.stream_review(s, known), "stream-warnings").select("file", "category", "frequency", _r("avg_tdg"))
