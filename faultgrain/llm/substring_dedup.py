"""Operator 5: removal of word sequences that repeat anywhere, with a count-min prefilter."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultgrain.llm.repeat_sketch import by_document, log2_cells, maybe_repeated, repeat_sketch, spans_of
from faultgrain.llm.spark_tools import keyed, map_arrow, own_id
from faultgrain.llm.text_arrays import NOT_SPACE, Words, chunks, covered, gram_hashes, mix, window_minima

WINDOW = 35
GRAM = 12
FLUSH = 1_500_000


def _chosen(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, position of each one's smallest gram, hash of every gram) of one chunk."""
    grams = gram_hashes(words.hashes(), gram)
    low = window_minima(grams, window - gram + 1)
    starts = np.flatnonzero(words.row[: len(low)] == words.row[len(words) - len(low) :]) if len(low) else low
    return starts, low[starts], grams


def _sample(data: np.ndarray, at: np.ndarray, window: int, gram: int) -> np.ndarray:
    _, low, grams = _chosen(Words(data, at, NOT_SPACE), window, gram)
    return grams[np.unique(low)]


def _windows(batches: Iterator[pa.RecordBatch], sketch, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Windows that the sketch counts twice, as (h, place, k_id, about).

    place: 31 more bits of the hash, then the position. about: the tag, 0, and 1 if known to repeat. Windows that
    repeat within the task need no shuffle: one of them is sent for all, the others as runs, with the tag in h, and
    the length, 1 and 1 in about.
    """
    held, size = [], 0
    for batch in batches:
        ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k_id", "k_tag"))
        for i, _, data, at in chunks(batch.column("text")):
            words = Words(data, at, NOT_SPACE)
            starts, low, grams = _chosen(words, window, gram)
            starts = starts[maybe_repeated(sketch.value, grams[low])]
            if len(starts):
                hashes, row = words.hashes(), words.row[starts]
                h1 = gram_hashes(hashes, window)[starts]
                h2 = gram_hashes(mix(hashes, 0xA5A5), window, 0x9FB21C651E98DF25)[starts] >> np.uint64(33)
                held.append((h1, h2.astype(np.int64), ids[i + row], tags[i + row], starts - words.first[row]))
                size += len(starts)
        if size >= FLUSH:
            yield _combined(held)
            held, size = [], 0
    if size:
        yield _combined(held)


def _combined(held: list[tuple]) -> pa.RecordBatch:
    h1, h2, ids, tags, pos = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    many = np.diff(np.append(np.flatnonzero(first), len(a))) > 1
    one, rest = order[first], order[~first]
    rest = rest[np.lexsort((pos[rest], tags[rest], ids[rest]))]
    # the others of a repeated window: runs of consecutive positions
    p, d, t = pos[rest], ids[rest], tags[rest]
    new = np.concatenate(([True], (p[1:] != p[:-1] + 1) | (d[1:] != d[:-1]) | (t[1:] != t[:-1]))) if len(p) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(p)))
    h = np.concatenate((h1[one].view(np.int64), t[at]))
    place = np.concatenate(((h2[one] << 32) | pos[one], p[at]))
    about = np.concatenate(((tags[one] << 2) | many, (length << 2) | 3))
    columns = [h, place, np.concatenate((ids[one], d[at])), about]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["h", "place", "k_id", "about"])


def repeated_windows(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k_id, k_tag, pos, len): runs of word positions at which a window starts that starts elsewhere too."""
    per_gram = 6 * (window - gram + 2) / 2  # bytes of text for each gram that is chosen
    bits = repeat_sketch(docs, lambda data, at: _sample(data, at, window, gram), log2_cells(docs, per_gram))
    sketch = docs.sparkSession.sparkContext.broadcast(bits)
    found = map_arrow(docs, lambda b: _windows(b, sketch, window, gram), "h long, place long, k_id long, about long")
    same = Window.partitionBy("h", F.shiftright("place", 32))
    known, run = F.col("about").bitwiseAND(F.lit(1)), F.col("about").bitwiseAND(F.lit(2)) == 2
    return found.withColumn("count", F.sum(known + 1).over(same)).where("count > 1").select(
        "k_id",
        F.when(run, F.col("h")).otherwise(F.shiftrightunsigned("about", 2)).alias("k_tag"),
        F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos"),
        F.when(run, F.shiftright("about", 2)).otherwise(F.lit(1)).alias("len"),
    )


def _kept(batches: Iterator[pa.RecordBatch], window: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, pos, length = spans_of(batch)
        for i, j, data, at in chunks(batch.column("text")):
            words = Words(data, at, NOT_SPACE)
            a, b = np.searchsorted(row, (i, j))
            gone = covered(words.first[row[a:b] - i] + pos[a:b], length[a:b] + window - 1, len(words))
            text, where = words.compact()
            text = text[np.repeat(~gone, np.diff(where))]
            size = np.concatenate(([0], np.cumsum(np.diff(where) * ~gone)))[words.first]
            out = [text[x : max(x, y - 1)].tobytes() for x, y in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
            removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[words.first])
            columns = [batch.column(c).slice(i, j - i) for c in ("k_id", "k_tag")]
            columns += [pa.array(np.diff(words.first), pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in out])]
            columns.append(pa.array([x.decode() for x in out] if texts else [None] * len(out), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["k_id", "k_tag", "n_words", "n_removed", "kept_sha256", "kept_text"])


def substring_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, texts: bool = True
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text (null unless ``texts``), k_id, k_tag.

    Words are what white space (space, \\x09-\\x0D) separates. Every word is removed that lies in ``window``
    consecutive words of its document which also start anywhere else, in the same document or another; windows
    are judged on the input. The kept words are joined by one space.

    First pass: each partition's count-min sketch of the chosen ``gram``-word grams, merged. Second pass: windows
    that the merged sketch counts twice or more are grouped exactly by 95 bits of hash, after windows that repeat
    within a task were combined; so a passage that a third of all rows share sends one row a task. Windows never
    cross documents. The sketch's size follows the input up to a bound; beyond it more windows are grouped, and
    none is lost.

    Null and empty texts have no words and keep the empty text. Rows that repeat remove each other's windows.
    An empty table gives no rows. Other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col)
    both = by_document(rows, repeated_windows(rows, window=window, gram=gram))
    schema = "k_id long, k_tag long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    out = map_arrow(both, lambda b: _kept(b, window, texts), schema)
    return out.select(own_id().alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept_text", "k_id", "k_tag")
