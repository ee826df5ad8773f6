"""Runs of words that repeat with a short period: Lyndon arrays by Baier grouping, their roots extended to runs.

A run's smallest period is the length of a Lyndon word that repeats in it, and under one of the two orders of words that
word is the longest Lyndon word at its place. So the longest Lyndon words of both orders, extended to both sides, give
every run. The first phase of Baier's suffix sorter ends with suffixes grouped by just these words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.llm.spark_tools import map_arrow
from faultgrain.llm.text_arrays import covered, gram_hashes, mix, runs

LEAST_WORDS, LEAST_TIMES = 24, 3


def lyndon_lengths(values: list[int], *, falling: bool = False) -> list[int]:
    """The length of the longest Lyndon word at each place, under the order of numbers or the reverse one.

    Groups of places, at first by value, are gone through from the highest to the lowest. A place in a group carries its word
    to the nearest place before it that is in a lower group, whose own word is longer by that: places that got most words
    move first, to a group of their own just above the one they were in. Each place is gone through once and moves its
    neighbour once, so the work is nearly linear.
    """
    n = len(values)
    order = sorted(set(values), reverse=falling)
    number = {v: g for g, v in enumerate(order)}
    group = [number[v] for v in values]
    members: list[list[int]] = [[] for _ in order]
    for i, g in enumerate(group):
        members[g].append(i)
    width, lower, higher = [1] * len(order), list(range(-1, len(order) - 1)), [*range(1, len(order)), -1]
    left = list(range(n + 1))  # of place i - 1 and those before it, the last that isn't gone through, plus 1
    out, g = [0] * n, len(order) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = []
        long = width[g]
        for i in own:
            out[i] = long
            left[i + 1] = i
        got: dict[int, int] = {}
        for i in own:
            j = i
            while left[j] != j:
                left[j] = j = left[left[j]]
            if j:
                got[j - 1] = got.get(j - 1, 0) + 1
        by_times: dict[int, dict[int, list[int]]] = {}
        for j, times in got.items():
            by_times.setdefault(times, {}).setdefault(group[j], []).append(j)
        for times in sorted(by_times, reverse=True):
            for old, places in by_times[times].items():
                new, above = len(width), higher[old]
                width.append(width[old] + times * long)
                members.append(places)
                lower.append(old)
                higher.append(above)
                higher[old] = new
                if above >= 0:
                    lower[above] = new
                for j in places:
                    group[j] = new
        g = lower[g]
    return out


class Extensions:
    """How far two places of a sequence agree, from names of all its blocks of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray):
        self.n, self.names = len(values), [values.astype(np.int32)]
        while 2 << (len(self.names) - 1) <= self.n:
            size, last = 1 << (len(self.names) - 1), self.names[-1].astype(np.int64)
            both = last[:-size] * (self.n + 1) + last[size:]
            self.names.append(np.unique(both, return_inverse=True)[1].astype(np.int32))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of equal values from i and from j > i on."""
        done = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.names))):
            fits = np.flatnonzero(j + done + (1 << k) <= self.n)
            same = self.names[k][i[fits] + done[fits]] == self.names[k][j[fits] + done[fits]]
            done[fits[same]] += 1 << k
        return done

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of equal values before i and before j > i."""
        done = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.names))):
            fits = np.flatnonzero(i - done - (1 << k) >= 0)
            at = done[fits] + (1 << k)
            same = self.names[k][i[fits] - at] == self.names[k][j[fits] - at]
            done[fits[same]] += 1 << k
        return done


def _runs_within(values: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, length, period) of the runs of one stretch; values are numbers from 0 to at most its length."""
    n, extended, found = len(values), Extensions(values), []
    for falling in (False, True):
        p = np.array(lyndon_lengths(values.tolist(), falling=falling), np.int64)
        i = np.flatnonzero(np.arange(n) + 2 * p <= n)  # a run of two periods and more has its word twice in a row
        i = i[p[i + p[i]] == p[i]]
        p = p[i]
        length = p + extended.forward(i, i + p)
        before = extended.backward(i, i + p)
        keep = length + before >= np.maximum(least, times * p)
        found.append(np.stack([(i - before)[keep], (length + before)[keep], p[keep]], 1))
    return np.unique(np.concatenate(found), axis=0)


def qualified_runs(values: np.ndarray, *, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> np.ndarray:
    """Rows (start, length, period) by start, then period: the runs of at least ``least`` values and ``times`` (3 or more) periods.

    In such a run every value stands in a block of ``least`` - ``least`` // ``times`` values that stands once more, a period away.
    So only stretches that repeated blocks cover are looked at, each by itself; a run never leaves its stretch.
    """
    block = max(1, least - least // times)
    grams = gram_hashes(mix(values.astype(np.uint64) + np.uint64(1)), block)
    if len(values) < least or not len(grams):
        return np.zeros((0, 3), np.int64)
    order = np.argsort(grams, kind="stable")
    same = np.diff(grams[order]) == 0
    again = np.zeros(len(grams), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    found = [np.zeros((0, 3), np.int64)]
    for start, length in zip(*runs(covered(at, np.full(len(at), block), len(values))), strict=True):
        if length >= least:
            some = _runs_within(np.unique(values[start : start + length], return_inverse=True)[1], least, times)
            some[:, 0] += start
            found.append(some)
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def planted(words: list[bytes], doc_id: int) -> list[bytes]:
    """The words with a periodic tail in one of ten documents, by the checksum of the id; its place and period follow from it too."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _row(doc_id: int | None, text: str | None, plant: bool, least: int, times: int) -> tuple:
    words = (text or "").encode().split()  # at the space and \x09-\x0D alone
    if plant and doc_id is not None:
        words = planted(words, doc_id)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    values = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    rows = qualified_runs(values, least=least, times=times)
    listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in rows.tolist()).encode()).hexdigest()
    best = (None, None, None, None)
    if len(rows):
        s, n, p = max(rows.tolist(), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        best = (s, n, p, 1000 * n // p)
        gone = covered(rows[:, 0] + rows[:, 2], rows[:, 1] - rows[:, 2], len(words))
        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    kept = b" ".join(words)
    return doc_id, len(rows), *best, listed, hashlib.sha256(kept).hexdigest(), rows, kept


def _rows(batches: Iterator[pa.RecordBatch], plant: bool, least: int, times: int, outputs: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(10)]
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            *plain, rows, kept = _row(doc_id.as_py(), text.as_py(), plant, least, times)
            shown = [[{"start": s, "length": n, "period": p} for s, n, p in rows.tolist()], kept.decode()] if outputs else [None, None]
            for column, value in zip(columns, [*plain, *shown], strict=True):
                column.append(value)
        kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def periodic_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, least: int = LEAST_WORDS, times: int = LEAST_TIMES, outputs: bool = True
) -> DataFrame:
    """One row per document: doc_id, n_runs, the run with the greatest length / period (start, length, period, exponent_milli), runs_sha256, collapsed_sha256, runs, collapsed.

    A run is a stretch of words whose smallest period q fits ``times`` times at least (3 or more), of ``least`` words or more, that no
    neighbouring word extends. ``collapsed`` is the text without the words of any run after its first q, joined by one space.
    runs and collapsed are null unless ``outputs``. ``plant`` first gives one document in ten a periodic tail (see planted).

    A null or empty text has no words: no runs, nulls for the greatest run, an empty collapsed text. Among runs of equal length /
    period the one that starts first is the greatest, then the one of the smaller period. A row without an id is never planted. Rows that repeat get rows of
    their own; an empty table gives none; other columns are ignored. A row is worked on in one task, without a shuffle, in memory
    that grows with its longest repeated stretch times the logarithm of that.
    """
    if times < 3:
        raise ValueError("times must be 3 or more")
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    pick = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(pick, lambda b: _rows(b, plant, least, times, outputs), schema)
