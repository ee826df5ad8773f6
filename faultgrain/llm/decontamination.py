"""Operator 3: benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultgrain.llm.spark_tools import Scratch, has_bit, keyed, looked_up, map_arrow, membership_bits, own_id, text_tag
from faultgrain.llm.text_arrays import ALNUM, LOWER, Words, chunks, gram_hashes, window_minima

WINDOW = 13
GRAM = 5
#: Different stretches that items may have around one gram and still be compared with a document's one by one.
MANY = 16

_SCHEMA = "k_id long, k_tag long, at int, size int, short boolean, fp long, before string, gram string, after string"


def _fingerprints(batches: Iterator[pa.RecordBatch], window: int, gram: int, lengths: list[int], bits, items: bool) -> Iterator[pa.RecordBatch]:
    """Rows of selected grams; for documents also one with at = -1 and size = the number of words.

    Of each window's k-grams the one with the smallest hash is selected (winnowing), and once for all windows that
    select it: ``before`` and ``after`` are the words of these windows around it. A short window is its own gram.
    ``lengths``: of the short windows looked for in documents; of an item, its own length counts.
    """
    for batch in batches:
        for i, j, data, at in chunks(batch.column("text")):
            words = Words(LOWER[data], at, ALNUM)
            per_row = np.diff(words.first)
            hashes = words.hashes()
            text, where = words.compact()
            found = []  # (first word, gram's first word, gram's end, end, hash) of each
            grams = gram_hashes(hashes, gram)
            low = window_minima(grams, window - gram + 1)
            s = np.flatnonzero(words.row[: len(low)] == words.row[window - 1 : window - 1 + len(low)])
            if len(s):
                new = np.flatnonzero(np.diff(low[s], prepend=-1))
                p = low[s[new]]
                found.append((s[new], p, p + gram, s[np.append(new[1:], len(s)) - 1] + window, grams[p], False))
            for n in range(1, window) if items else lengths:
                short = gram_hashes(hashes, n)
                s = words.first[:-1][per_row == n] if items else np.flatnonzero(words.row[: len(short)] == words.row[n - 1 :])
                if len(s) and len(short):
                    found.append((s, s, s + n, s + n, short[s], True))
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False)[i:j] for c in ("k_id", "k_tag"))
            if not items:
                none = [None] * (j - i)
                yield _batch(ids, tags, np.full(j - i, -1), per_row, False, np.zeros(j - i, np.uint64), none, none, none)
            for *places, fp, short in found:
                if bits is not None:
                    keep = has_bit(bits.value, fp)
                    places, fp = [x[keep] for x in places], fp[keep]
                if len(fp):
                    row = words.row[places[0]]
                    shown = [_texts(text, where[a], where[b]) for a, b in zip(places, places[1:], strict=False)]
                    yield _batch(ids[row], tags[row], places[1] - words.first[row], places[2] - places[1], short, fp, *shown)


def _texts(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The words between, joined by spaces; the last one's space is left out."""
    return [text[a : max(a, b - 1)].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _batch(ids, tags, at, size, short, fp, before, gram, after) -> pa.RecordBatch:
    columns = [pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32))]
    columns += [pa.array(np.full(len(at), short)), pa.array(fp.view(np.int64)), *(pa.array(x, pa.string()) for x in (before, gram, after))]
    return pa.RecordBatch.from_arrays(columns, ["k_id", "k_tag", "at", "size", "short", "fp", "before", "gram", "after"])


def _words(text: Column | str) -> Column:
    return F.array_remove(F.split(text, " "), "")


def _alike(a: Column, b: Column) -> Column:
    """How many first elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return F.array_position(F.concat(same, F.array(F.lit(False))), False).cast("int") - 1


def _windows(rows: DataFrame, window: int, *kept: str) -> DataFrame:
    """``kept``, and s, n, words of each window of the rows' stretches; a short one is one window."""
    words = _words(F.concat_ws(" ", "before", "gram", "after"))
    rows = rows.withColumn("all", words).withColumn("n", F.when(F.col("short"), F.size("all")).otherwise(window))
    starts = F.sequence(F.lit(1), F.size("all") - F.col("n") + 1)
    cut = F.transform(starts, lambda k: F.array_join(F.slice("all", k, F.col("n")), " "))
    rows = rows.select(*kept, "short", "n", (F.col("at") - F.size(_words("before"))).alias("from"), F.posexplode(cut).alias("k", "words"))
    return rows.select(*kept, (F.col("from") + F.col("k")).alias("s"), "n", F.xxhash64("short", "words").alias("link"), "short", "words")


def _extended(seen: DataFrame, table: DataFrame, window: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(k_id, k_tag, s, n, link): a document's gram that an item has too, extended to both sides as far as words are equal.

    Kept if the words reach a window's length, or the gram is a short item. The second table: grams that too many
    stretches of items are around.
    """
    found = scratch.written(looked_up(seen, table, "fp", scratch), "shared-grams")
    pairs = found.where("choices IS NOT NULL").withColumn("item", F.explode("choices"))
    pairs = pairs.where("item.short = short AND item.gram = gram")
    left = _alike(F.reverse(_words("before")), F.reverse(_words("item.before")))
    pairs = pairs.withColumn("left", left).withColumn("right", _alike(_words("after"), _words("item.after")))
    pairs = pairs.withColumn("n", F.col("left") + F.col("size") + F.col("right")).where(F.col("short") | (F.col("n") >= window))
    hits = pairs.select("k_id", "k_tag", (F.col("at") - F.col("left")).alias("s"), "n", F.col("item.link").alias("link"))
    return hits, found.where("choices IS NULL").select(*seen.columns)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    share: int = 20,
    many: int = MANY,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and k_id, k_tag).

    Words are runs of letters, digits and characters beyond ASCII, after lower-casing A-Z. A window is ``window``
    consecutive words of an item; an item of fewer words is one window. A document's word is hit if any window
    occurs around it. Contaminated: some word is hit, and 1 in ``share`` of the words at least.

    Of each window the ``gram``-word gram with the smallest hash is selected, so a span of ``window`` words that an
    item and a document share has the same selected gram in both. A bit array of bounded size drops grams that no item
    has before the shuffle; the others are joined, each once with the words of its windows, and hits are extended to
    both sides word by word. Around a gram that items have in more than ``many`` different stretches, windows are joined
    by all their words instead, so work doesn't grow with the product of both sides. Nothing is lost in either way.

    A null or empty text has no words: n_words 0, not contaminated. Items without words match nothing; items
    without an id hit words but aren't listed. Documents that repeat in id and text give a row each; so do rows
    without an id. An empty benchmark hits nothing. Other columns of either table are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    tests = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    tests = tests.select("item", F.xxhash64("text").alias("k_id"), text_tag(F.concat(F.lit("item "), "text")).alias("k_tag"), "text")
    distinct = tests.select("k_id", "k_tag", "text").distinct()
    item_rows = scratch.written(map_arrow(distinct, lambda b: _fingerprints(b, window, gram, [], None, True), _SCHEMA), "benchmark-grams")
    lengths = sorted(r.size for r in item_rows.where("short").select("size").distinct().collect())
    bits = scratch.broadcast(membership_bits(item_rows.select("fp").distinct(), "fp"))
    seen = map_arrow(keyed(docs, id_col, text_col), lambda b: _fingerprints(b, window, gram, lengths, bits, False), _SCHEMA)
    seen = scratch.written(seen, "document-grams", keep=True)

    # c: how many different stretches items have around a gram
    item_rows = item_rows.withColumn("link", F.xxhash64("fp", "short", "before", "gram", "after"))
    counts = item_rows.groupBy("fp", "link").agg(F.count(F.lit(1)).alias("n")).groupBy("fp").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"))
    counts = scratch.written(counts, "gram-counts")
    item_rows = scratch.written(looked_up(item_rows, counts, "fp", scratch), "counted-grams", keep=True)
    few, crowded = item_rows.where(F.col("c") <= many), item_rows.where(F.col("c") > many)
    choices = few.select("fp", F.struct("short", "before", "gram", "after", "link").alias("item")).distinct()
    choices = choices.groupBy("fp").agg(F.collect_list("item").alias("choices"))
    grams = seen.where("at >= 0")
    asked = grams.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    table = scratch.written(asked.join(counts.select("fp"), "fp").join(choices, "fp", "left"), "gram-choices")
    hits, rest = _extended(grams, table, window, scratch)
    item_windows = scratch.written(_windows(crowded, window, "k_id", "k_tag"), "benchmark-windows", keep=True)
    rest = scratch.written(_windows(rest, window, "k_id", "k_tag"), "document-windows")
    known = item_windows.select("link", "short", "words").distinct().groupBy("link").agg(F.collect_list(F.struct("short", "words")).alias("same"))
    known = scratch.written(rest.groupBy("link").agg(F.count(F.lit(1)).alias("n")).join(known, "link"), "shared-windows")
    rest = looked_up(rest.withColumnRenamed("n", "long"), known, "link", scratch)
    rest = rest.where(F.exists("same", lambda w: (w["short"] == F.col("short")) & (w["words"] == F.col("words"))))
    hits = hits.union(rest.select("k_id", "k_tag", "s", "long", "link")).distinct()
    hits = scratch.written(hits, "benchmark-hits", keep=True)
    spans = hits.select("k_id", "k_tag", "s", "n").distinct()
    place = Window.partitionBy("k_id", "k_tag").orderBy("s", "n")
    reached = F.max(F.col("s") + F.col("n")).over(place.rowsBetween(Window.unboundedPreceding, -1))
    n_hit = (
        spans.select("k_id", "k_tag", "s", "n", F.coalesce(reached, F.lit(0)).alias("reached"))
        .groupBy("k_id", "k_tag")
        .agg(F.sum(F.greatest(F.lit(0), F.col("s") + F.col("n") - F.greatest("s", "reached"))).alias("n_hit"))
    )
    own = [F.col("k_id").alias("i_id"), F.col("k_tag").alias("i_tag"), "link"]
    named = few.select(*own).union(item_windows.select(*own)).distinct()
    named = named.join(tests.select("item", F.col("k_id").alias("i_id"), F.col("k_tag").alias("i_tag")).where("item IS NOT NULL").distinct(), ["i_id", "i_tag"])
    # Documents that hit the same stretches have the same items: these are listed once for each distinct set of these, however
    # many documents have it, and not for each pair of a document and an item.
    sets = hits.groupBy("k_id", "k_tag").agg(F.sort_array(F.collect_set("link")).alias("links"))
    sets = sets.withColumn("set", F.unhex(F.sha2(F.array_join("links", ",").cast("binary"), 256)))
    sets = scratch.written(sets, "link-sets", keep=True)
    named = named.select("link", "item").distinct()
    items = sets.groupBy("set").agg(F.first("links").alias("links")).select("set", F.explode("links").alias("link"))
    items = items.join(named, "link").groupBy("set").agg(F.sort_array(F.collect_set("item")).alias("items"))
    items = sets.select("k_id", "k_tag", "set").join(items, "set").select("k_id", "k_tag", F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("listed"))
    scratch.close()
    out = seen.where("at < 0").select("k_id", "k_tag", F.col("size").cast("long").alias("n_words"))
    out = out.join(n_hit, ["k_id", "k_tag"], "left").join(items, ["k_id", "k_tag"], "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        own_id().alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("listed", F.lit("")), 256).alias("items_sha256"),
        ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"),
        "k_id",
        "k_tag",
    )
