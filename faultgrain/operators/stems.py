"""Porter stems of tokens, found once for each distinct token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultgrain.operators.text import coded, lower, sliced

# The endings of Porter's algorithm (1980), by step, with what takes their place.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


_KINDS = str.maketrans({x: "v" if x in "aeiou" else "c" for x in "abcdefghijklmnopqrstuvwxyz"})


def _kinds(word: str) -> str:
    """c or v for each letter: a, e, i, o, u are vowels, and y after a consonant."""
    if "y" not in word:
        return word.translate(_KINDS)
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    return _kinds(stem).count("vc")


def _short_end(word: str) -> bool:
    return len(word) >= 3 and _kinds(word).endswith("cvc") and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) >= 2 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _longest(word: str, endings: tuple[str, ...]) -> str | None:
    """The first ending that the word has: they are given by falling length."""
    return next(e for e in endings if word.endswith(e)) if word.endswith(endings) else None


_ENDS2, _ENDS3, _ENDS4 = (tuple(sorted(x, key=len, reverse=True)) for x in (STEP2, STEP3, STEP4))


def stem(word: str) -> str:
    """The Porter stem of a lower-case English word; words of one or two letters, and others than a to z, stay."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    cut = False
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (word.endswith("ed") and "v" in _kinds(word[:-2])) or (word.endswith("ing") and "v" in _kinds(word[:-3])):
        word, cut = word[: -2 if word.endswith("ed") else -3], True
    if cut:
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short_end(word):
            word += "e"
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    for table, endings in ((STEP2, _ENDS2), (STEP3, _ENDS3)):
        end = _longest(word, endings)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + table[end]
    end = _longest(word, _ENDS4)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if _double(word) and word[-1] == "l" and _measure(word) > 1 else word


#: Stems that a worker keeps at most, of the tokens that it has met.
KEPT = 1 << 20
_known: dict[str, str] = {}


def _stems(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """(key, stems) of tokens or texts with each distinct token of a batch stemmed once, and those that the worker has met not again."""
    for batch in sliced(batches):
        terms, row, term = coded(batch)
        if len(_known) > KEPT:
            _known.clear()
        words = terms.to_pylist()
        _known.update((w, stem(w)) for w in words if w not in _known)
        stems = pa.array([_known[w] for w in words], pa.string()).take(pa.array(term))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(batch)))])
        yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), stems)], [key, "stems"])


def stem_tokens(rows: DataFrame, *, key: str = "doc_id", text: str | None = None) -> DataFrame:
    """(key, stems): the stem of each token, in order; none where there are no tokens. Rows hold tokens, or whole texts in the column ``text``.

    Tokens are cut and stemmed where the texts are, each distinct one once a batch, so nothing is dealt by token and the work in Python follows the vocabulary.
    """
    kind = rows.schema[key].dataType.simpleString()
    own = rows.select(key, "tokens" if text is None else lower(text).alias("text"))
    return own.mapInArrow(lambda b: _stems(b, key), f"`{key}` {kind}, stems array<string>")
