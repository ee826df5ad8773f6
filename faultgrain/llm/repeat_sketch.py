"""Count-min sketches of sampled grams, made for each partition and merged, that tell which may occur twice.

A window is represented by its smallest gram (see window_minima). Occurrences of one window at different places
choose different positions of one gram, so a gram's count is never below the window's: a sketch of the chosen
positions overestimates window counts at about a tenth of their number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.llm.spark_tools import map_arrow
from faultgrain.llm.text_arrays import chunks, mix

ROWS = 2
BLOCK = 16  # a block has 2**16 cells
FLUSH = 4_000_000
#: Most cells of a row, as a power of two: 2 bits a cell while merging, 1 bit afterwards, so 2 * 32 MB are broadcast.
MOST_LOG2 = 28

Sampler = Callable[[np.ndarray, np.ndarray], np.ndarray]


def log2_cells(docs: DataFrame, bytes_a_gram: float) -> int:
    """Four cells for each gram expected in the whole table, up to MOST_LOG2."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_LOG2, max(BLOCK, math.ceil(math.log2(4 * total / bytes_a_gram + 1))))


def _cells(grams: np.ndarray, log2: int) -> list[np.ndarray]:
    return [(mix(grams, 0x51ED * (r + 1)) >> np.uint64(64 - log2)).astype(np.int64) for r in range(ROWS)]


def _partition_sketch(batches: Iterator[pa.RecordBatch], sample: Sampler, log2: int, counted: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (block, ones, twos): the cells of a block counted once and more often, as 16-bit offsets.

    If ``counted``, also times: how often, for each of twos, as 32-bit numbers.
    """
    held, size = [], 0
    for batch in batches:
        for _, _, data, at in chunks(batch.column("text")):
            grams = sample(data, at)
            for r, cell in enumerate(_cells(grams, log2)):
                held.append(cell + (r << log2))
            size += len(grams)
            if size >= FLUSH:
                yield _packed(held, counted)
                held, size = [], 0
    if size:
        yield _packed(held, counted)


def _packed(held: list[np.ndarray], counted: bool = False) -> pa.RecordBatch:
    cells, n = np.unique(np.concatenate(held), return_counts=True)
    block = cells >> BLOCK
    blocks = np.unique(block)
    columns = [pa.array(blocks.astype(np.int32))]
    for part in (n == 1, n > 1):
        offsets = (cells[part] & ((1 << BLOCK) - 1)).astype(np.uint16)
        ends = np.append(np.searchsorted(block[part], blocks), len(offsets)) * 2
        columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(blocks), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(offsets)]))
    if counted:
        part = n > 1
        ends = np.append(np.searchsorted(block[part], blocks), np.count_nonzero(part)) * 4
        columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(blocks), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(n[part].astype(np.uint32))]))
    return pa.RecordBatch.from_arrays(columns, ["block", "ones", "twos", "times"][: len(columns)])


def _merged(group: pa.Table) -> pa.Table:
    """One block's counts over all partitions, as a bit for each cell that has 2 or more."""
    n = np.zeros(1 << BLOCK, np.int64)
    for name, weight in (("ones", 1), ("twos", 2)):
        for part in group.column(name).to_pylist():
            n[np.frombuffer(part, np.uint16)] += weight
    return pa.table({"block": group.column("block").slice(0, 1), "bits": pa.array([np.packbits(n > 1).tobytes()], pa.binary())})


def repeat_sketch(docs: DataFrame, sample: Sampler, log2: int) -> np.ndarray:
    """ROWS x 2**log2 / 8 bytes: the bits of the cells that two or more sampled grams fell in.

    ``docs`` has a column text. Each partition sends at most 2 bytes for each gram and row of the sketch; a block
    is merged in one task, and only the merged bits reach the driver (64 MB at most).
    """
    parts = map_arrow(docs.select("text"), lambda b: _partition_sketch(b, sample, log2), "block int, ones binary, twos binary")
    merged = parts.groupBy("block").applyInArrow(_merged, "block int, bits binary").toArrow()
    out = np.zeros((ROWS << (log2 - BLOCK), 1 << (BLOCK - 3)), np.uint8)
    for block, bits in zip(merged["block"].to_pylist(), merged["bits"].to_pylist(), strict=True):
        out[block] = np.frombuffer(bits, np.uint8)
    return out.reshape(ROWS, -1)


def counted_sketch(docs: DataFrame, sample: Sampler, log2: int, often: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits of repeat_sketch, and the sorted cells (row << log2 | cell) that more than ``often`` sampled grams fell in.

    A cell's count is exact, so there are at most ROWS / often of these cells for each sampled gram.
    """

    def merged(group: pa.Table) -> pa.Table:
        n = np.zeros(1 << BLOCK, np.int64)
        for ones, twos, times in zip(*(group.column(c).to_pylist() for c in ("ones", "twos", "times")), strict=True):
            n[np.frombuffer(ones, np.uint16)] += 1
            n[np.frombuffer(twos, np.uint16)] += np.frombuffer(times, np.uint32)
        hot = np.flatnonzero(n > often).astype(np.uint16).tobytes()
        return pa.table({"block": group.column("block").slice(0, 1), "bits": pa.array([np.packbits(n > 1).tobytes()], pa.binary()), "hot": pa.array([hot], pa.binary())})

    parts = map_arrow(docs.select("text"), lambda b: _partition_sketch(b, sample, log2, True), "block int, ones binary, twos binary, times binary")
    found = parts.groupBy("block").applyInArrow(merged, "block int, bits binary, hot binary").toArrow()
    out = np.zeros((ROWS << (log2 - BLOCK), 1 << (BLOCK - 3)), np.uint8)
    hot = [np.zeros(0, np.int64)]
    for block, bits, cells in zip(*(found[c].to_pylist() for c in ("block", "bits", "hot")), strict=True):
        out[block] = np.frombuffer(bits, np.uint8)
        hot.append(np.frombuffer(cells, np.uint16).astype(np.int64) + (block << BLOCK))
    return out.reshape(ROWS, -1), np.sort(np.concatenate(hot))


def maybe_often(hot: np.ndarray, grams: np.ndarray, log2: int) -> np.ndarray:
    """Which grams fall in cells of ``hot`` alone; every gram that occurs more often than its bound is among them."""
    out = np.ones(len(grams), bool)
    for r, cell in enumerate(_cells(grams, log2)):
        at = np.searchsorted(hot, cell + (r << log2))
        out &= np.append(hot, -1)[at] == cell + (r << log2)
    return out


def maybe_repeated(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Which grams the sketch counts twice or more; every gram that does occur twice is among them."""
    log2 = (bits.shape[1] * 8).bit_length() - 1
    out = np.ones(len(grams), bool)
    for row, cell in zip(bits, _cells(grams, log2), strict=True):
        out &= (row[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return out


def by_document(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(k_id, k_tag, text, spans) with a document's (position << 32 | length) values, null if it has none."""
    own = spans.select("k_id", "k_tag", F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("len").cast("long")).alias("span"))
    return docs.join(own.groupBy("k_id", "k_tag").agg(F.collect_list("span").alias("spans")), ["k_id", "k_tag"], "left")


def spans_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, length) of the spans of a batch."""
    column = batch.column("spans")
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    packed = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(n)), n), packed >> 32, packed & 0xFFFFFFFF
