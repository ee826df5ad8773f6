"""Operator 9: language identification, family first, then one-versus-one linear support vector machines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultgrain.llm.spark_tools import Scratch, map_arrow, own_id, row_id, text_tag
from faultgrain.llm.text_arrays import LOWER, chunks

UNKNOWN = "und"
FEATURES = 1 << 12
#: Most labelled rows that the classifiers are fitted on, shared evenly by the languages.
SAMPLE = 6000
#: Most values of the language column that are learned, the most frequent ones: a machine is fitted for each pair within a family.
LANGUAGES = 64
#: Most rows that are turned into features at once.
ROWS = 64

# fixed values: language families by ISO 639-1 code; any other code is a family of its own
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "turkic": "az kk ky tr tt ug uz",
    "uralic": "et fi hu",
    "semitic": "ar he mt",
}


def family_of(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang.split("-")[0] in codes.split()), lang)


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of hashed counts of the 1 to 3 byte grams of lower-cased texts, square-rooted, of length 1.

    A gram never spans two texts; white space, digits and punctuation all count as one space.
    """
    rows = len(at) - 1
    text = LOWER[data]
    text = np.where((text < 0x61) | ((text > 0x7A) & (text < 0x80)), np.uint8(32), text).astype(np.uint32)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(at))
    out = np.zeros(rows * FEATURES, np.int64)
    code = text
    for k in range(1, 4):
        if k > 1:
            code = (code[:-1] << np.uint32(8)) | text[k - 1 :]
        cell = ((code * np.uint32(2) + np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
        same = row[: len(code)] == row[k - 1 : k - 1 + len(code)] if k > 1 else slice(None)
        blank = code != 32 if k == 1 else (code & np.uint32(0xFFFF)) != 0x2020
        keep = blank & same if k > 1 else blank
        out += np.bincount(row[: len(code)][keep] * FEATURES + cell[keep], minlength=len(out))
    x = np.sqrt(out.reshape(rows, FEATURES))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _svm(x: np.ndarray, rows: np.ndarray, sign: np.ndarray, rounds: int = 12, reg: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine on some rows of x, by averaged sub-gradient steps in a fixed order."""
    w, mean, t = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), 0
    rng = np.random.default_rng(0)
    weight = np.where(sign > 0, len(sign) / max(1, 2 * (sign > 0).sum()), len(sign) / max(1, 2 * (sign < 0).sum()))
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for part in np.array_split(order, max(1, len(rows) // 32)):
            t += 1
            some = np.hstack((x[rows[part]].astype(np.float64), np.ones((len(part), 1))))
            bad = sign[part] * (some @ w) < 1
            rate = 1 / (reg * (t + 1000))
            w *= 1 - rate * reg
            w += rate / len(part) * ((sign[part] * weight[part] * bad) @ some)
            mean += (w - mean) / t
    return mean


@dataclass(frozen=True)
class LanguageModel:
    """families: a row of weights for each pair of families; within[f]: for each pair of languages of family f."""

    families: list[str]
    family_pairs: list[tuple[int, int]]
    family_weights: np.ndarray
    languages: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int]]]
    weights: dict[str, np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score): the score multiplies the shares that the family and the language win."""
        if not self.families:
            return np.full(len(x), UNKNOWN, object), np.zeros(len(x))
        x = np.hstack((x, np.ones((len(x), 1))))
        family, sure = _vote(x, self.family_weights, self.family_pairs, len(self.families))
        lang = np.full(len(x), UNKNOWN, object)
        for f, name in enumerate(self.families):
            at = np.flatnonzero(family == f)
            if len(at):
                best, share = _vote(x[at], self.weights[name], self.pairs[name], len(self.languages[name]))
                lang[at] = np.array(self.languages[name], object)[best]
                sure[at] *= share
        return lang, sure


def _vote(x: np.ndarray, weights: np.ndarray, pairs: list[tuple[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The class that wins most pairs; of equal ones that with the larger margins. Its mean share of its pairs."""
    if n == 1:
        return np.zeros(len(x), int), np.ones(len(x))
    share = 1 / (1 + np.exp(-2 * np.clip(x @ weights.T, -30, 30)))
    wins, total = np.zeros((len(x), n)), np.zeros((len(x), n))
    for k, (i, j) in enumerate(pairs):
        wins[:, i] += share[:, k] > 0.5
        wins[:, j] += share[:, k] <= 0.5
        total[:, i] += share[:, k]
        total[:, j] += 1 - share[:, k]
    best = np.argmax(wins + total / n, axis=1)
    return best, total[np.arange(len(x)), best] / (n - 1)


def _one_versus_one(x: np.ndarray, rows: np.ndarray, label: np.ndarray, n: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Weights of each pair of the n classes; label is of the rows."""
    pairs, weights = list(combinations(range(n), 2)), []
    for i, j in pairs:
        own = (label == i) | (label == j)
        weights.append(_svm(x, rows[own], np.where(label[own] == i, 1.0, -1.0)))
    return pairs, np.array(weights) if weights else np.zeros((0, x.shape[1] + 1))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, cells, values): the features that aren't 0, as 16-bit cells and 32-bit numbers."""
    for batch in batches:
        for i, j, data, at in chunks(batch.column("text"), rows=ROWS):
            cells, values = [], []
            for row in features(data, at).astype(np.float32):
                some = np.flatnonzero(row)
                cells.append(some.astype(np.uint16).tobytes())
                values.append(row[some].tobytes())
            columns = [batch.column("lang").slice(i, j - i), pa.array(cells, pa.binary()), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "cells", "values"])


def _chosen(known: DataFrame, names: dict[str, int], id_col: str, text_col: str, lang_col: str, each: int) -> DataFrame:
    """(lang, text): ``each`` rows at most of a language. Rows that repeat in id, text and language count once.

    ``names``: the rows of each language. Rows whose hash is low enough to be about three times ``each`` of a language
    are ranked by it, so no task ranks more, however many rows a language has.
    """
    rows = known.select(F.col(id_col).alias("own"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text")).withColumn("spread", F.xxhash64("own", "mark"))
    share = F.create_map(*(F.lit(x) for lang, n in names.items() for x in (lang, min(1.0, 3.0 * each / n))))
    # a share of all 64-bit hashes, from the least one up
    few = rows.where(F.col("spread") <= (F.element_at(share, F.col("lang")) * 2.0 - 1.0) * 2.0**63)
    place = Window.partitionBy("lang").orderBy("spread", "own", "mark")
    ids = few.select("own", "lang", "mark", "spread").distinct().withColumn("place", F.row_number().over(place))
    ids = ids.where(F.col("place") <= each).drop("place")
    return few.join(F.broadcast(ids), ["own", "lang", "mark", "spread"]).groupBy("own", "lang", "mark").agg(F.min("text").alias("text")).select("lang", "text")


def fit_language_model(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, languages: int = LANGUAGES
) -> LanguageModel:
    """Fit on rows with a language whose crc32(id as text) mod 5 is not 0.

    At most ``sample`` rows are used (one of each language at least), as many of each language, chosen by the
    hash of their ids and texts; only their features (at most FEATURES numbers a row) reach the driver. Of a column of many
    values the ``languages`` most frequent are learned (ties: the smaller), so stray ones don't count. Where no row can be learned from, the model has no language and says ``und`` to every text.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    counts = known.where(F.col(lang_col) != UNKNOWN).groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r.lang: r.n for r in counts.orderBy(F.desc("n"), "lang").limit(languages).collect()}
    names = sorted(counts)
    if not names:
        return LanguageModel([], [], np.zeros((0, FEATURES + 1)), {}, {}, {})
    chosen = _chosen(known.where(F.col(lang_col).isin(names)), counts, id_col, text_col, lang_col, max(1, sample // len(names)))
    got = map_arrow(chosen, _feature_rows, "lang string, cells binary, values binary").toArrow()
    lang = np.array(got["lang"].to_pylist(), object)
    x = np.zeros((len(lang), FEATURES), np.float32)
    for row, cells, values in zip(x, got["cells"], got["values"], strict=True):
        row[np.frombuffer(cells.as_buffer(), np.uint16)] = np.frombuffer(values.as_buffer(), np.float32)
    del got
    order = np.lexsort((x[:, :64] @ np.arange(1, 65), lang.astype(str)))  # the same whatever order rows came in
    lang = lang[order]
    families = sorted({family_of(n) for n in names})
    members = {f: [n for n in names if family_of(n) == f] for f in families}
    label = np.array([families.index(family_of(v)) for v in lang])
    family_pairs, family_weights = _one_versus_one(x, order, label, len(families))
    pairs, weights = {}, {}
    for f in families:
        own = np.isin(lang, members[f])
        pairs[f], weights[f] = _one_versus_one(x, order[own], np.array([members[f].index(v) for v in lang[own]]), len(members[f]))
    return LanguageModel(families, family_pairs, family_weights, members, pairs, weights)


def held_out(id_col: str = "doc_id"):
    """Rows that nothing is learned from; a row without an id is one of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def _predictions(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, at in chunks(batch.column("text"), rows=ROWS):
            lang, score = model.value.predict(features(data, at))
            # a letter beyond ASCII is looked for only where there is none within
            ascii_letter = np.add.reduceat(np.append((LOWER[data] >= 0x61) & (LOWER[data] <= 0x7A), False), at[:-1]) > 0
            for r in np.flatnonzero(~ascii_letter).tolist():
                if not any(map(str.isalpha, data[at[r] : at[r + 1]].tobytes().decode())):
                    lang[r], score[r] = UNKNOWN, 0.0
            columns = [batch.column(c).slice(i, j - i) for c in ("k_id", "k_tag", "held_out")]
            columns += [pa.array(lang.tolist(), pa.string()), pa.array(np.clip(score, 0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["k_id", "k_tag", "held_out", "lang_pred", "score"])


def identify_language(
    docs: DataFrame, model: LanguageModel | None = None, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1), k_id, k_tag.

    Families are told apart first; within the family, one linear support vector machine for each pair of
    languages votes. Features are the hashed 1 to 3 byte grams of the whole text. The model, of bounded size, is
    broadcast. Without ``model`` one is fitted on ``docs``, from text and language alone.

    ``und``, with score 0: the text is null or has no letter, or no row outside the held-out ones has a language and
    a text to learn from. Rows that repeat get the same answer. A row without
    an id counts as held out. An empty table gives no rows, and needs no model. Other columns are ignored.
    """
    if model is None and docs.limit(1).isEmpty():
        model = LanguageModel([], [], np.zeros((0, FEATURES + 1)), {}, {}, {})
    model = model or fit_language_model(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, sample=sample)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(row_id(id_col).alias("k_id"), text_tag(text).alias("k_tag"), held_out(id_col).alias("held_out"), text.alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        shared = scratch.broadcast(model)
        out = map_arrow(rows, lambda b: _predictions(b, shared), "k_id long, k_tag long, held_out boolean, lang_pred string, score double")
        out = scratch.written(out, "languages", keep=True)
    return out.select(own_id().alias("doc_id"), "held_out", "lang_pred", "score", "k_id", "k_tag")
