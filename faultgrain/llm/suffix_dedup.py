"""Operator 2: removal of byte strings that repeat anywhere, by merging shard Burrows-Wheeler transforms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.llm.repeat_sketch import by_document, counted_sketch, log2_cells, maybe_often, maybe_repeated, spans_of
from faultgrain.llm.spark_tools import keyed, map_arrow, own_id
from faultgrain.llm.text_arrays import chunks, covered, gram_hashes, mix, runs, window_minima

LENGTH = 200
GRAM = 32
STRIDE = 8
DIGEST = 16
END = 0xFF  # no UTF-8 text has this byte
#: Most segments of an anchor (of length * 2 bytes each at most) that are merged in one task.
OFTEN = 1 << 13
BATCH = 1 << 17  # small enough that the arrays of a merge stay in the processor's cache


# --- Burrows-Wheeler transforms of shards, and their merge


def _words_of(text: np.ndarray) -> np.ndarray:
    """The STRIDE bytes from each position of a cyclic text on, as one number that sorts as the bytes do."""
    out = np.zeros(len(text), np.uint64)
    for i in range(STRIDE):
        out = (out << np.uint64(8)) | np.roll(text, -i)
    return out


def _ranked(parts: list[np.ndarray]) -> list[np.ndarray]:
    values, rank = np.unique(np.concatenate(parts), return_inverse=True)
    rank = rank.astype(np.uint16 if len(values) <= 1 << 16 else np.int64)
    return np.split(rank, np.cumsum([len(p) for p in parts])[:-1])


def _suffix_order(rank: np.ndarray, length: int) -> np.ndarray:
    """Positions of a cyclic text sorted by at least their first ``length`` bytes; rank: of the first STRIDE."""
    rank, depth = rank.astype(np.uint64), STRIDE
    while True:
        order = np.argsort(rank, kind="stable")
        if depth >= length:
            return order
        pair = rank * np.uint64(int(rank[order[-1]]) + 1) + np.roll(rank, -depth)
        order = np.argsort(pair)
        step = np.concatenate(([0], np.cumsum(pair[order][1:] != pair[order][:-1])))
        rank = np.empty(len(rank), np.uint64)
        rank[order] = step.astype(np.uint64)
        depth *= 2
        if int(step[-1]) == len(rank) - 1:
            return order


def merge_bwts(symbols: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge shard transforms: (shard of each suffix in merged order, common prefix with the suffix before it).

    symbols[i]: of shard i, the STRIDE bytes before each suffix, in the shard's suffix order. Starting from the
    shards one after the other, each round sorts the interleave stably by symbol, which orders the suffixes by
    STRIDE more bytes; positions where a block of equal prefixes splits are the common prefixes. Prefixes are
    told up to ``length`` (a multiple of STRIDE); no suffix is compared or sorted again.
    """
    z = np.repeat(np.arange(len(symbols), dtype=np.uint8), [len(s) for s in symbols])
    symbols = [s for s in symbols]
    n = len(z)
    prefix = np.full(n, length, np.int32)
    if n:
        prefix[0] = 0
    split = np.zeros(n, bool)
    split[:1] = True
    now = np.empty(n, np.result_type(*symbols) if symbols else np.uint16)
    for depth in range(0, length, STRIDE):
        for i, s in enumerate(symbols):
            now[z == i] = s
        order = np.argsort(now, kind="stable")
        block = np.cumsum(split, dtype=np.int32)[order]
        sorted_now = now[order]
        z = z[order]
        at = np.flatnonzero(((sorted_now[1:] != sorted_now[:-1]) | (block[1:] != block[:-1])) & ~split[1:]) + 1
        split[at] = True
        prefix[at] = depth  # differs within the next STRIDE bytes
        if split.all():
            break
    return z, prefix


def repeated_starts(texts: list[bytes], length: int = LENGTH, shards: int = 2) -> list[np.ndarray]:
    """For each text, which of its len - length + 1 starts has ``length`` bytes that start elsewhere in ``texts`` too."""
    shards = min(shards, len(texts))
    parts = [[t for t in texts[i::shards]] for i in range(shards)]
    joined = [np.frombuffer(b"".join(t + bytes([END]) for t in p), np.uint8) for p in parts]
    ranks = _ranked([_words_of(t) for t in joined])
    orders = [_suffix_order(r, length) for r in ranks]
    # the symbol before a suffix is what starts STRIDE bytes earlier
    z, prefix = merge_bwts([np.roll(r, STRIDE)[o] for r, o in zip(ranks, orders, strict=True)], length)
    same = prefix >= length
    same |= np.append(same[1:], False)
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(texts)
    for i, (part, order) in enumerate(zip(parts, orders, strict=True)):
        flag = np.zeros(len(order), bool)
        flag[order] = same[z == i]
        at = 0
        for j, t in enumerate(part):
            out[i + j * shards] = flag[at : at + max(0, len(t) - length + 1)]
            at += len(t) + 1
    return out


# --- candidate segments


def _anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts of whole strings, their rows, position of each one's smallest gram, hash of every gram)."""
    grams = gram_hashes(data.astype(np.uint64) + np.uint64(1), gram)
    low = window_minima(grams, length - gram + 1)
    size = np.maximum(0, np.diff(at) - 1 - length + 1)  # a space follows each row
    row = np.repeat(np.arange(len(size)), size)
    starts = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + at[:-1][row]
    return starts, row, low[starts], grams


def _sample(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> np.ndarray:
    _, _, low, grams = _anchors(data, at, length, gram)
    return grams[np.unique(low)]


_SEGMENTS = "h long, k_id long, k_tag long, pos int, n int, many boolean, segment binary"


def _by_start(segments: list[list], length: int) -> tuple[list, list[tuple]]:
    """The starts of ``segments``, each under the digest of its own string; and those equal to one of them, as positions.

    A digest goes in place of a segment. It is shorter than a string, so it is only ever compared as a whole.
    """
    rows: dict[bytes, list] = {}
    rest: list[tuple] = []
    for _, k, tag, p, n, many, segment in segments:
        again = np.zeros(n, bool)
        for i in range(n):
            digest = hashlib.blake2b(segment[i : i + length], digest_size=DIGEST).digest()
            have = rows.get(digest)
            if have is None:
                rows[digest] = [int.from_bytes(digest[:8], "little", signed=True), k, tag, p + i, 1, many, digest]
            else:
                have[5] = again[i] = True
        rest += [(k, tag, p + a, m) for a, m in zip(*(x.tolist() for x in runs(again)), strict=True)]
    return [*rows.values()], rest


def _rows(out: list, rest: list[tuple]) -> pa.RecordBatch:
    spread = mix(np.arange(len(rest), dtype=np.uint64), len(out) + 1).view(np.int64).tolist()
    out = out + [[h, *x, True, None] for h, x in zip(spread, rest, strict=True)]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["h", "k_id", "k_tag", "pos", "n", "many", "segment"])


def _segments(batches: Iterator[pa.RecordBatch], sketch, hot, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Runs of starts that chose one anchor which the sketch counts twice, with the bytes they cover.

    Of equal segments of a task one is sent for all, with many true; the others go as positions alone. Segments
    of the anchors in ``hot`` go start by start, under the digests of their strings.
    """
    log2 = (sketch.value.shape[1] * 8).bit_length() - 1
    for batch in batches:
        ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k_id", "k_tag"))
        rows: dict[tuple[int, bytes], list] = {}
        rest = []
        for i, _, data, at in chunks(batch.column("text")):
            starts, row, low, grams = _anchors(data, at, length, gram)
            if not len(starts):
                continue
            new = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (row[1:] != row[:-1]))))
            n = np.diff(np.append(new, len(starts)))
            hashes = grams[low[new]]
            may = maybe_repeated(sketch.value, hashes)
            new, n, hashes = new[may], n[may], hashes[may].view(np.int64)
            text = data.tobytes()
            often = maybe_often(hot.value, hashes.view(np.uint64), log2) if len(hot.value) else np.zeros(len(new), bool)
            apart: dict[tuple[int, bytes], list] = {}
            for h, s, size, r, p, o in zip(hashes.tolist(), starts[new].tolist(), n.tolist(), (row[new] + i).tolist(), (starts[new] - at[row[new]]).tolist(), often.tolist(), strict=True):
                segment = text[s : s + size + length - 1]
                into = apart if o else rows
                have = into.get((h, segment))
                if have is None:
                    into[h, segment] = [h, int(ids[r]), int(tags[r]), p, size, False, segment]
                else:
                    have[5] = True
                    rest.append((int(ids[r]), int(tags[r]), p, size))
            if apart:
                yield _rows(*_by_start([*apart.values()], length))
        if rows or rest:
            yield _rows([*rows.values()], rest)


def _repeats(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs of repeated starts, from segments sorted by anchor hash."""
    held: dict[int, list[tuple]] = {}
    size, last = 0, None
    for batch in batches:
        for h, *row in zip(*(batch.column(c).to_pylist() for c in ("h", "k_id", "k_tag", "pos", "n", "many", "segment")), strict=True):
            if h != last and size >= BATCH:
                yield _judged(held, length)
                held, size = {}, 0
            last = h
            held.setdefault(h, []).append(row)
            size += len(row[-1] or b"") or DIGEST
    if held:
        yield _judged(held, length)


def _judged(held: dict[int, list[tuple]], length: int) -> pa.RecordBatch:
    out, texts, asked = [], [], []
    for group in held.values():
        by_text: dict[bytes | None, list[tuple]] = {}
        for row in group:
            by_text.setdefault(row[-1], []).append(row)
        unsure = []
        for text, rows in by_text.items():
            if text is None or len(rows) > 1 or rows[0][4]:
                out += [(r[0], r[1], r[2], r[3]) for r in rows]
            else:
                unsure.append((text, rows[0]))
        segments = [t for t in by_text if t is not None]
        if unsure and len(segments) > 1:  # every segment is a partner, those already judged too
            sure = dict(unsure)
            texts += segments
            asked += [sure.get(t) for t in segments]
    for row, flags in zip(asked, repeated_starts(texts, length) if texts else [], strict=True):
        if row is not None:
            out += [(row[0], row[1], row[2] + a, n) for a, n in zip(*(x.tolist() for x in runs(flags)), strict=True)]
    columns = [[*c] for c in zip(*out, strict=True)] or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["k_id", "k_tag", "pos", "len"])


def anchored_segments(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, often: int = OFTEN) -> DataFrame:
    """Rows of _SEGMENTS: equal strings are under one h or sent as positions; none has more than ``often`` segments of strings."""
    per_gram = (length - gram + 2) / 2
    bits, cells = counted_sketch(docs, lambda data, at: _sample(data, at, length, gram), log2_cells(docs, per_gram), often)
    context = docs.sparkSession.sparkContext
    sketch, hot = context.broadcast(bits), context.broadcast(cells)
    return map_arrow(docs, lambda b: _segments(b, sketch, hot, length, gram), _SEGMENTS)


def repeated_strings(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, often: int = OFTEN) -> DataFrame:
    """(k_id, k_tag, pos, len): runs of byte positions at which ``length`` bytes start that start elsewhere too."""
    segments = anchored_segments(docs, length=length, gram=gram, often=often).repartition("h").sortWithinPartitions("h")
    return map_arrow(segments, lambda b: _repeats(b, length), "k_id long, k_tag long, pos long, len long")


def _kept(batches: Iterator[pa.RecordBatch], length: int, bodies: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, pos, n = spans_of(batch)
        for i, j, data, at in chunks(batch.column("text")):
            a, b = np.searchsorted(row, (i, j))
            gone = covered(at[row[a:b] - i] + pos[a:b], n[a:b] + length - 1, len(data))
            total = np.concatenate(([0], np.cumsum(gone)))
            first = np.concatenate(([0], np.cumsum(gone & ~np.concatenate(([False], gone[:-1])))))
            ends = at[1:] - 1
            out = [data[x:y][~gone[x:y]].tobytes() for x, y in zip(at[:-1].tolist(), ends.tolist(), strict=True)]
            columns = [batch.column(c).slice(i, j - i) for c in ("k_id", "k_tag")]
            columns += [pa.array(x, pa.int64()) for x in (ends - at[:-1], total[ends] - total[at[:-1]], first[ends] - first[at[:-1]])]
            columns += [pa.array([hashlib.sha256(x).hexdigest() for x in out]), pa.array(out if bodies else [None] * len(out), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["k_id", "k_tag", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])


def suffix_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, often: int = OFTEN, bodies: bool = True
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes (null unless ``bodies``), k_id, k_tag.

    Texts are UTF-8 bytes. Every byte is removed that lies in a string of ``length`` bytes which also starts
    anywhere else, in the same document or another; strings are judged on the input, overlaps count and none
    crosses documents. n_spans: maximal removed runs. What is kept may not be UTF-8, as strings may begin
    within a character. ``length`` is a multiple of 8, longer than ``gram``.

    A merged count-min sketch of anchors (each string's smallest ``gram``-byte gram) drops strings that occur
    once; none that repeats is lost. The rest is dealt by anchor, so equal strings meet: equal segments are
    combined within each task and again in the group, and the different ones that share an anchor are sorted as
    shards whose Burrows-Wheeler transforms are merged. Intervals of the merged order with ``length`` common
    bytes are the repeats. A task holds the different segments of one anchor, of at most length * 2 bytes each and
    at most ``often`` of them: the sketch counts anchors, and the strings of those that occur more often go each
    under 128 bits of its own hash, where equal hashes are equal strings.

    Null and empty texts have 0 bytes. Rows that repeat remove each other. An empty table gives no rows. Other
    columns are ignored.
    """
    if length % STRIDE or length <= gram:
        raise ValueError("length must be a multiple of 8 and longer than gram")
    rows = keyed(docs, id_col, text_col)
    both = by_document(rows, repeated_strings(rows, length=length, gram=gram, often=often))
    schema = "k_id long, k_tag long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"
    out = map_arrow(both, lambda b: _kept(b, length, bodies), schema)
    return out.select(own_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "k_id", "k_tag")
