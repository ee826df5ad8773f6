"""Operator 6: exact de-duplication by skew-safe combining, on DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultgrain.llm.spark_tools import Scratch, own_id, row_id

SALTS = 60


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row with the largest id stays.

    Copies are combined within each task, then by (digest, salt), then the winners of all salts by digest. Each
    step groups by the text itself, so it compares full contents: a digest only deals the rows out, and no task
    gets more than a salt's share of a hot text. Documents then look up their group by digest and salt. Where two
    texts share a digest, those rows alone are matched by text.

    Null ids: such a row has keep_id null unless its text also has a row with an id, and stays only then. Rows
    that repeat in both id and text count separately, and share ``kept``. An empty table gives no rows. Other
    columns are ignored. A row's salt follows from its place in the input and is stored with it, so rows without an id, or of
    one id, are spread like others; ``salts`` is any number.
    """
    scratch = Scratch(docs.sparkSession)
    make = digest or (lambda t: F.unhex(F.sha2(t, 256)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    salt = F.pmod(F.xxhash64("k_id", "at"), F.lit(salts)).cast("int").alias("s")
    rows = docs.select(row_id(id_col).alias("k_id"), text.alias("t"), F.monotonically_increasing_id().alias("at"))
    rows = rows.select("k_id", "t", make(F.col("t")).alias("d"), salt)
    winners = rows.groupBy("d", "s", "t").agg(F.max("k_id").alias("keep"), F.count(F.lit(1)).alias("n"))
    by_text = winners.repartition("d").groupBy("d", "t").agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))
    totals = [F.count(F.lit(1)).alias("texts"), F.max("keep").alias("keep"), F.sum("n").alias("n")]
    groups = scratch.written(by_text.groupBy("d").agg(*totals), "exact-groups", keep=True)
    # digests, ids and salts of all rows, without their texts
    sha = F.lower(F.hex("d")) if digest is None else F.sha2("t", 256)
    members = scratch.written(rows.select("k_id", "d", "s", sha.alias("sha")), "exact-members", keep=True)
    lookup = members.select("d", "s").distinct().join(groups.where("texts = 1").select("d", "keep", "n"), "d")
    found = members.join(lookup, ["d", "s"]).select("k_id", "sha", "keep", "n")
    shared = groups.where("texts > 1").select("d")
    if not shared.isEmpty():
        # several texts under one digest: those rows are stored with their texts and looked up by these, one row for each salt and text
        own = scratch.written(rows.join(shared, "d", "left_semi"), "exact-shared", keep=True)
        group = own.groupBy("d", "s", "t").agg(F.max("k_id").alias("keep"), F.count(F.lit(1)).alias("n"))
        total = group.groupBy("d", "t").agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))
        met = group.select("d", "s", "t").join(total, ["d", "t"])
        found = found.unionByName(own.join(met, ["d", "s", "t"]).select("k_id", F.sha2("t", 256).alias("sha"), "keep", "n"))
    return found.select(
        own_id().alias("doc_id"),
        own_id("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("k_id") == F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
