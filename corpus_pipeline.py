"""A cleaning pipeline over ``documents``: language, lines, near duplicates, contamination, pieces.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns a DataFrame;
run() writes each result as Parquet and reads it again for the next. All but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultgrain.llm.decontamination import decontaminate
from faultgrain.llm.language_id import UNKNOWN, identify_language
from faultgrain.llm.line_dedup import line_dedup
from faultgrain.llm.near_dedup import near_dedup
from faultgrain.llm.queries import model_path
from faultgrain.llm.sentencepiece_codec import encode_documents
from faultgrain.llm.spark_tools import delete, passing, shared_dir, table, without

#: Least score of a language that is accepted: more sure than not.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that is surer than not, go."""
    found = identify_language(docs)
    return without(docs, found.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < LEAST_SCORE)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus, equal or one edit away, go; their documents stay."""
    return line_dedup(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays; of repeated rows one."""
    return without(docs, near_dedup(docs).where(~F.col("head"))).dropDuplicates(["doc_id", "text"])


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages in a twentieth of their words or more go."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    out = encode_documents(docs, model_path(), outputs=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("contamination", contamination),
    ("pieces", pieces),
]

#: The stages can't all be written in SQL (a fitted classifier, a tokenizer): tests hold them against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's table is written to the shared folder, and the one before it then deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with passing(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
