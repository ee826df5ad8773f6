"""Small Spark helpers that the operators share: scratch tables, row keys, Arrow mapping and membership bits."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(2**63)

_KEPT: ContextVar[list[str] | None] = ContextVar("kept", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode, as in tests, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = getattr(spark.sparkContext, "_faultgrain_scratch", None)
        if path is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
            path = spark.sparkContext._faultgrain_scratch = tempfile.mkdtemp(prefix="faultgrain-")
    return path.rstrip("/")


class Scratch:
    """Tables that cut lineage: each is written to the shared folder as Parquet and read back, so it survives lost executors.

    close() deletes them, but for those that were written with ``keep``, which a result still reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._paths, self._shared = spark, [], []

    def written(self, df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        kept = _KEPT.get()
        if not keep:
            self._paths.append(path)
        elif kept is not None:
            kept.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def broadcast(self, value):
        """A value for all workers, given back by close()."""
        self._shared.append(self.spark.sparkContext.broadcast(value))
        return self._shared[-1]

    def drop(self, prefix: str) -> None:
        """Deletes the tables whose names begin so."""
        gone = [p for p in self._paths if p.rsplit("/", 1)[-1].startswith(prefix)]
        self._paths = [p for p in self._paths if p not in gone]
        for path in gone:
            delete(self.spark, path)

    def close(self) -> None:
        self.drop("")
        for value in self._shared:
            value.destroy()
        self._shared = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that operators keep for their results are deleted at the end: write the results within."""
    paths: list[str] = []
    before = _KEPT.set(paths)
    try:
        yield
    finally:
        _KEPT.reset(before)
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def map_arrow(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow by workers that give freed memory back to the system after each partition, as Spark keeps them for the next."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return df.mapInArrow(lean, schema)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k_id, k_tag, text): null texts are empty; k_id and k_tag tell rows of one id with different texts apart.

    Rows that repeat in both id and text share a key, and so share every result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(row_id(id_col).alias("k_id"), text_tag(text).alias("k_tag"), text.alias("text"))


def row_id(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def text_tag(text: Column) -> Column:
    """62 bits of a text, as a number from 0 on."""
    return F.shiftrightunsigned(F.xxhash64(text), 2)


def own_id(column: str = "k_id") -> Column:
    """The id as it came: null again where it was null."""
    return F.when(F.col(column) != NULL_ID, F.col(column))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, whatever the case of their letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, refused: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key (k_id, k_tag) isn't among ``refused``; its columns stay, whatever their names."""
    key, tag = fresh(docs, "k_id", "k_tag")
    rows = docs.withColumns({key: row_id(id_col), tag: text_tag(F.coalesce(F.col(text_col), F.lit("")))})
    gone = refused.select(F.col("k_id").alias(key), F.col("k_tag").alias(tag)).distinct()
    return rows.join(gone, [key, tag], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def looked_up(rows: DataFrame, table: DataFrame, key: str, scratch: Scratch, *, frequent: int = 4096) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each value of ``key`` (a long) and in n how many of ``rows`` have it.

    Values that over 1 in ``frequent`` of the rows have are sent to all tasks (``frequent`` at most), and their rows spread,
    so none of them meets in one task.
    """
    values = [c for c in table.columns if c != key]
    bound = table.agg(F.ceil(F.sum("n") / frequent).alias("k_bound"))
    often = table.join(F.broadcast(bound), F.col("n") > F.col("k_bound"))  # one row
    often = scratch.written(often.select(key, F.lit(True).alias("k_often"), *(F.col(c).alias(f"k_{c}") for c in values)), "often")
    at = F.when(F.col("k_often").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns))
    out = rows.join(F.broadcast(often), key, "left").withColumn("k_at", at)
    out = out.join(table.select(F.col(key).alias("k_at"), F.lit(True).alias("k_found"), *values), "k_at", "left")
    return out.where("k_often OR k_found").select(*rows.columns, *(F.coalesce(f"k_{c}", c).alias(c) for c in values))


def membership_bits(hashes: DataFrame, column: str, *, bits_per_key: int = 64, max_log2: int = 27) -> np.ndarray:
    """A bit array that marks the top bits of each 64-bit hash in ``column``, as uint64 words.

    It has between 2**16 and 2**max_log2 bits (16 MB at the default), whatever the number of hashes; that is
    the bound of what is collected and broadcast. A fuller array only lets more rows through to the exact join.
    """
    n = hashes.count()
    log2 = min(max_log2, max(16, math.ceil(math.log2(max(1, n) * bits_per_key))))
    cell = F.shiftrightunsigned(F.col(column), 64 - log2)
    rows = (
        hashes.select(cell.alias("cell"))
        .select(F.shiftright("cell", 6).alias("word"), F.expr("shiftleft(1L, CAST(cell & 63 AS INT))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (log2 - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def has_bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` (uint64) may be members."""
    cell = hashes >> np.uint64(64 - (len(bits).bit_length() - 1) - 6)
    return (bits[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) == 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
