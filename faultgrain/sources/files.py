"""Readers and writers of diagnostics, coverage, quality scores, bug documents and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# The fields of a diagnostic.
REQUIRED = ["message", "confidence", "timestamp"]
OPTIONAL = ["error_code", "clippy_lint", "given_category", "suggestion", "span"]

DIAGNOSTICS = (
    "source_file string, error_code string, clippy_lint string, level string, message string, given_category string, confidence float, "
    "span struct<line_start: int, column_start: int>, suggestion struct<replacement: string, applicability: string>, timestamp bigint, tool_version string"
)
BUGS = (
    "id string, title string, description string, fix_commit string, fix_diff string, affected_files array<string>, category string, "
    "severity int, symptoms array<string>, root_cause string, fix_pattern string"
)


def _own_names(rows: DataFrame, names: dict[str, str] | None) -> DataFrame:
    return rows.withColumnsRenamed({theirs: ours for ours, theirs in (names or {}).items()})


def read_diagnostics_json(spark: SparkSession, path: str, *, names: dict[str, str] | None = None) -> DataFrame:
    """Diagnostics of JSON lines; blank lines are skipped and a broken line fails the job.

    ``names``: what files call a field that has another name here, such as {"given_category": "kind"}.
    """
    schema = StructType([StructField((names or {}).get(f.name, f.name), f.dataType) for f in StructType.fromDDL(DIAGNOSTICS)])
    return _own_names(spark.read.schema(schema).json(path, mode="FAILFAST"), names)


def read_diagnostics_parquet(spark: SparkSession, path: str, *, shuffle_seed: int | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Diagnostics of Parquet files, absent columns null, rows in random order on request; ``names`` as for JSON."""
    rows = _own_names(spark.read.parquet(path), names)
    fields = spark.createDataFrame([], DIAGNOSTICS).schema.fields
    out = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
    return out if shuffle_seed is None else out.orderBy(F.rand(shuffle_seed))


def read_lcov(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, hits) of LCOV text. Counts outside a file's record and unreadable numbers are skipped.

    Files are split at the ends of records, so one large file is read by many tasks.
    """
    records = spark.read.option("lineSep", "end_of_record\n").text(path)
    # a record may name several files: each part runs from one SF line to the next
    parts = records.select(F.explode(F.split(F.concat(F.lit("\n"), "value"), r"\n\s*SF:")).alias("part")).where(F.col("part").rlike(r"^[^\s]"))
    lines = parts.select(
        F.trim(F.regexp_extract("part", r"^([^\r\n]*)", 1)).alias("file"),
        F.explode(F.expr(r"regexp_extract_all(part, '\\n\\s*DA:([^\\r\\n]*)', 1)")).alias("x"),
    )
    at = F.split("x", ",")
    number = lambda c: F.when(c.rlike(r"^\+?[0-9]+$"), c.try_cast("bigint"))
    out = lines.where(F.size(at) >= 2).select("file", number(at[0]).alias("line"), number(at[1]).alias("hits"))
    return out.where("line IS NOT NULL AND hits IS NOT NULL")


def read_tdg(spark: SparkSession, path: str) -> DataFrame:
    """(file, total, grade) of quality-score reports."""
    schema = "files array<struct<file_path: string, total: double, grade: string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("files").alias("x"))
    return rows.select(F.col("x.file_path").alias("file"), "x.total", "x.grade")


def read_bugs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUGS).json(path)


def save_bugs(bugs: DataFrame, path: str, *, mode: str = "error") -> None:
    """Bug documents as JSON lines, as read_bugs reads them."""
    bugs.select(*(x.split(":")[0].split(" ")[0] for x in BUGS.split(", "))).write.mode(mode).json(path)


def validate_diagnostics(rows: DataFrame) -> DataFrame:
    """(field, status, nulls): required fields present or missing, optional ones where present, all others extra.

    nulls counts the rows without a value, null for a missing field. All fields are counted in one aggregation.
    """
    status = {f: "missing" for f in REQUIRED if f not in rows.columns}
    status |= {c: "required" if c in REQUIRED else "optional" if c in OPTIONAL else "extra" for c in rows.columns}
    n = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns))
    item = lambda f, s: F.struct(F.lit(f).alias("field"), F.lit(s).alias("status"), (F.lit(None).cast("bigint") if s == "missing" else F.col(f)).alias("nulls"))
    return n.select(F.explode(F.array(*(item(f, s) for f, s in status.items()))).alias("x")).select("x.*")


def save_features(features: DataFrame, path: str, *, mode: str = "append") -> None:
    """A feature table in folders by category, so that a query for a category reads its folder alone."""
    features.write.partitionBy("defect_category").mode(mode).parquet(path)


def features_of(spark: SparkSession, path: str, category: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("defect_category") == category)


def export_features(features: DataFrame, path: str, names: list[str], *, label: str = "defect_category") -> DataFrame:
    """Writes (features array, label) as Parquet, the names with the column; returns one row: n_samples, n_features, n_classes."""
    packed = F.array(*(F.col(n).cast("double") for n in names)).alias("features", metadata={"names": names})
    features.select(packed, F.col(label).alias("label")).write.parquet(path)
    out = features.sparkSession.read.parquet(path)
    return out.agg(F.count(F.lit(1)).alias("n_samples"), F.lit(len(names)).alias("n_features"), F.count_distinct("label").alias("n_classes"))


def load_features(spark: SparkSession, path: str) -> DataFrame:
    """What export_features wrote, a column for each name."""
    rows = spark.read.parquet(path)
    names = rows.schema["features"].metadata["names"]
    return rows.select(*(F.get("features", F.lit(i)).alias(n) for i, n in enumerate(names)), "label")


def write_report(rows: DataFrame, path: str, *, form: str = "json") -> None:
    """Writes a report as ``json``, ``csv`` (flat columns, with names) or ``parquet``."""
    if form not in ("json", "csv", "parquet"):
        raise ValueError(f"unknown form {form!r}")
    rows.write.format(form).options(**({"header": True} if form == "csv" else {})).save(path)
