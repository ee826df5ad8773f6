"""Operator 8: near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultgrain.llm.components import connected_components, joined_parts
from faultgrain.llm.spark_tools import Scratch, has_bit, keyed, looked_up, map_arrow, membership_bits, own_id
from faultgrain.llm.text_arrays import LOWER, NOT_SPACE, Words, chunks, gram_hashes, mix

SHINGLE = 5
BANDS = 32
ROWS = 4
#: Similarity as a fraction of whole numbers: 75 / 100.
SIMILAR = (75, 100)
#: Entries of one item that a task meets at once.
ITEM_BLOCK = 1 << 10

_BLOCK = 1 << 15


def shingle_sets(data: np.ndarray, at: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a chunk."""
    words = Words(LOWER[data], at, NOT_SPACE)
    hashes, first = words.hashes(), words.first
    grams = gram_hashes(hashes, shingle)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= shingle:
            x = np.sort(grams[a : b - shingle + 1])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            yield gram_hashes(hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def _permute(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(items: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the minimum of p(s(v) + k), for two permutations s and p of 2**32 values.

    p is the same for all coordinates but shifted by k places in the circle of values.
    """
    first = (mix(items, 0x3C6EF372) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    step = max(1, _BLOCK // size)
    for i in range(0, len(first), step):
        np.minimum(out, _permute(first[None, i : i + step] + shift).min(axis=1), out=out)
    return out


def band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates."""
    grid = sign.reshape(bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = mix(key ^ grid[:, r], r + 1)
    return key


def _sketches(batches: Iterator[pa.RecordBatch], shingle: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for _, _, data, at in chunks(batch.column("text")):
            for x in shingle_sets(data, at, shingle):
                if len(x):
                    marks = [int(mix(x, salt).sum(dtype=np.uint64)) for salt in (0x1234567, 0x89ABCDE)]
                    out.append((len(x), *np.array(marks, np.uint64).view(np.int64).tolist(), band_keys(signature(x, bands * rows), bands, rows).view(np.int64)))
                else:
                    out.append((0, 0, 0, None))
        n, a, b, keys = zip(*out, strict=True) if out else ((), (), (), ())
        columns = [batch.column("k_id"), batch.column("k_tag"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["k_id", "k_tag", "n_shingles", "d1", "d2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int, bits) -> Iterator[pa.RecordBatch]:
    """(k_id, k_tag, items) of the rows whose ``mark`` may be a member of ``bits``."""
    for batch in batches:
        keep = has_bit(bits.value, batch.column("mark").to_numpy(zero_copy_only=False).view(np.uint64))
        batch = batch.filter(pa.array(keep))
        for i, j, data, at in chunks(batch.column("text")):
            items = [x.view(np.int64) for x in shingle_sets(data, at, shingle)]
            keys = [batch.column(c).slice(i, j - i) for c in ("k_id", "k_tag")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(items, pa.list_(pa.int64()))], ["k_id", "k_tag", "items"])


#: Pairs of one document that meet its set in one task, about.
SHARE = 256


def _verified(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int], scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of sets that are similar enough, by their full sets.

    The leader of a large bucket (b) has many pairs: these are dealt into shares, to each of which its set is sent, so the sets
    of a bucket's members never meet in one task.
    """
    pairs = pairs.select("a", "b")
    counts = scratch.written(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("shares", F.ceil(F.col("n") / SHARE)), "pair-counts")
    pairs = looked_up(pairs, counts, "b", scratch).withColumn("share", F.pmod(F.xxhash64("a"), F.col("shares"))).select("a", "b", "share")
    left = sets.select(F.col("doc").alias("a"), F.col("items").alias("a_items"))
    right = sets.select(F.col("doc").alias("b"), F.col("items").alias("b_items")).join(counts.select("b", "shares"), "b")
    right = right.select("b", "b_items", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    both = F.size(F.array_intersect("a_items", "b_items"))
    least, of = similar
    return (
        pairs.join(left, "a").join(right, ["b", "share"])
        .where(of * both >= least * (F.size("a_items") + F.size("b_items") - both))
        .select("a", "b")
    )


def _prefix_pairs(sets: DataFrame, parts: DataFrame, similar: tuple[int, int], block: int, scratch: Scratch) -> DataFrame:
    """Every pair (a, b) of different parts that can be similar, by prefix filtering: no bucket is listed in pairs.

    Sets whose similarity reaches the bound share one of the rarest |x| - ceil(bound * |x|) + 1 items of each. Items
    that all lie in one part are dropped before the join. Of two similar sets the one that isn't larger (a) has their
    first common item in an even shorter prefix, where what is left of it can hold the common items of two sets of its
    size; only these entries are met by others. An item with more than ``block`` of them is split into parts of about
    that size, so no task holds all sets that share a frequent item.
    """
    least, of = similar
    items = sets.join(parts, "doc").select("doc", "part", F.size("items").alias("size"), F.explode("items").alias("item"))
    rare = items.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("p1"), F.max("part").alias("p2"))
    rare = scratch.written(rare.where("p1 < p2").select("item", "n"), "shared-items")
    shared = looked_up(items, rare, "item", scratch)
    # items that only one part has come first in any order; they count towards the prefix but join with nothing
    ranked = shared.groupBy("doc", "part", "size").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("order"))
    alone = F.col("size") - F.size("order")
    room = F.least((F.col("size") - F.ceil(F.col("size") * least / of) + 1 - alone).cast("int"), F.size("order"))
    heads = (
        ranked.withColumn("room", room)
        .where("room > 0")
        .select("doc", "part", "size", alone.alias("alone"), F.posexplode(F.slice("order", F.lit(1), F.col("room"))).alias("i", "x"))
        .select("doc", "part", "size", "x.item", (F.col("size") - F.col("alone") - F.col("i")).alias("left"))
    )
    smaller = (of + least) * F.col("left") >= 2 * least * F.col("size")
    heads = scratch.written(heads.withColumn("smaller", smaller), "item-heads")
    blocks = heads.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count_if("smaller") / block).alias("blocks")).where("blocks > 0")
    heads = scratch.written(looked_up(heads, scratch.written(blocks, "item-blocks"), "item", scratch).drop("n"), "met-heads")
    a = heads.where("smaller").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks"))).alias("a")
    b = heads.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).alias("b")
    fits = (F.col("a.part") != F.col("b.part")) & (F.col("a.size") <= F.col("b.size")) & (of * F.col("a.size") >= least * F.col("b.size"))
    # where this is the first item that both have, what is left of each from here on must hold the common items
    enough = least * (F.col("a.size") + F.col("b.size"))
    fits &= ((of + least) * F.col("a.left") >= enough) & ((of + least) * F.col("b.left") >= enough)
    met = a.join(b, (F.col("a.item") == F.col("b.item")) & (F.col("a.block") == F.col("b.block")) & fits)
    return met.select(F.least("a.doc", "b.doc").alias("a"), F.greatest("a.doc", "b.doc").alias("b")).distinct()


def near_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    similar: tuple[int, int] = SIMILAR,
    block: int = ITEM_BLOCK,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, head (and k_id, k_tag).

    A document's set holds its distinct ``shingle``-word shingles, of words that white space separates after
    lower-casing A-Z; with fewer words the whole sequence is one. Documents are linked when their sets reach the
    similarity. component_id is the smallest id that links reach; kept: it is the document's own. head is true for
    one text of each component, the first by id and then by a hash of the text: the same as kept where ids are there
    and differ.

    Equal sets are combined first and stand for all their copies. bands * rows circulant MinHash coordinates are
    banded; a pair at the bound itself is missed with probability (1 - 0.75**4)**32, 5 in a million. Of each
    bucket, every member is checked on full sets against the one with the smallest number, not against the others. Members that
    are still in different components after that are compared by prefix filtering, which loses no pair. So links
    within a component are never listed, and a bucket of any size makes as many pairs as it has members.

    Documents without words or text have n_shingles 0, are linked with nothing and kept. Rows that repeat, and
    rows of equal sets, form one component; rows without an id count as the smallest id, and their component_id
    is null and kept true; head tells which of them to keep. An empty table gives no rows. Other columns are ignored.
    The tables that the result reads stay in the shared folder; all others are deleted.
    """
    scratch = Scratch(docs.sparkSession)
    schema = "k_id long, k_tag long, n_shingles long, d1 long, d2 long, bands array<long>"
    found = map_arrow(keyed(docs, id_col, text_col), lambda b: _sketches(b, shingle, bands, rows), schema)
    found = scratch.written(found, "sketches", keep=True)
    some = found.where("n_shingles > 0")
    # one document stands for each set; its number, in the order of ids, is a node, which is unique where ids repeat
    heads = some.groupBy("n_shingles", "d1", "d2").agg(F.min(F.struct("k_id", "k_tag")).alias("head")).orderBy("head")
    heads = heads.select("n_shingles", "d1", "d2", "head.*", F.monotonically_increasing_id().alias("node"))
    heads = scratch.written(heads, "set-heads")
    keys = (
        some.select("k_id", "k_tag", "d1", "d2", "n_shingles", "bands")
        .join(heads.select("k_id", "k_tag", "d1", "d2", "n_shingles", "node"), ["k_id", "k_tag", "d1", "d2", "n_shingles"])
        .dropDuplicates(["node"])
        .select(F.col("node").alias("doc"), F.explode("bands").alias("key"))
    )
    keys = scratch.written(keys, "band-keys")
    leaders = keys.groupBy("key").agg(F.min("doc").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    leaders = scratch.written(leaders, "leaders")
    # a key that a large part of the documents has is looked up where they are
    members = scratch.written(looked_up(keys, leaders, "key", scratch).select("key", F.col("doc").alias("a"), "b"), "buckets")
    pairs = scratch.written(members.where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")), "pairs")
    involved = heads.join(members.select(F.col("a").alias("node")).distinct(), "node").select("k_id", "k_tag", F.col("node").alias("doc"))
    involved = scratch.written(involved.withColumn("mark", _mark()), "involved")
    bits = scratch.broadcast(membership_bits(involved.select("mark").distinct(), "mark"))
    texts = keyed(docs, id_col, text_col).withColumn("mark", _mark())
    sets = map_arrow(texts, lambda b: _sets(b, shingle, bits), "k_id long, k_tag long, items array<long>")
    sets = sets.dropDuplicates(["k_id", "k_tag"]).join(involved.drop("mark"), ["k_id", "k_tag"]).select("doc", "items")
    sets = scratch.written(sets, "sets")
    nodes = involved.select(F.col("doc").alias("a"))
    # first the likeliest leader of each member, then the others where that has not settled it
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b"))
    links = scratch.written(_verified(best, sets, similar, scratch), "links-1")
    parts = connected_components(nodes, links, scratch)
    rest = pairs.select("a", "b").join(best.withColumn("was", F.lit(True)), ["a", "b"], "left_anti")
    parts = joined_parts(parts, _verified(_different(rest, parts), sets, similar, scratch), scratch)
    # buckets whose members are not yet one component, beyond the leader's
    apart = members.join(_different(pairs.select("a", "b"), parts), ["a", "b"]).select("key").distinct()
    open_keys = members.where("a <> b").join(apart, "key", "left_semi").join(parts.select(F.col("doc").alias("a"), "part"), "a")
    open_keys = scratch.written(open_keys.select("key", F.col("a").alias("doc"), "part"), "open-buckets")
    mixed = open_keys.groupBy("key").agg(F.min("part").alias("p1"), F.max("part").alias("p2")).where("p1 < p2").select("key")
    unsettled = scratch.written(open_keys.join(mixed, "key", "left_semi").select("doc", "part").distinct(), "unsettled")
    if not unsettled.isEmpty():
        last = _prefix_pairs(sets.join(unsettled.select("doc"), "doc", "left_semi"), unsettled, similar, block, scratch)
        tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        last = scratch.written(last.join(tried, ["a", "b"], "left_anti"), "prefix-pairs")
        parts = joined_parts(parts, _verified(last, sets, similar, scratch), scratch)
    # the part's number is any of its nodes; its name is the smallest id
    placed = heads.join(parts.select(F.col("doc").alias("node"), "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    names = placed.groupBy("part").agg(F.min(F.struct("k_id", "k_tag", "n_shingles", "d1", "d2")).alias("first"))
    groups = scratch.written(placed.join(names, "part").select("n_shingles", "d1", "d2", "first"), "components", keep=True)
    scratch.close()
    out = some.select("k_id", "k_tag", "n_shingles", "d1", "d2").join(groups, ["n_shingles", "d1", "d2"])
    out = out.select("k_id", "k_tag", "n_shingles", F.col("first.k_id").alias("component"), F.struct("k_id", "k_tag", "n_shingles", "d1", "d2").eqNullSafe(F.col("first")).alias("head"))
    bare = found.where("n_shingles = 0").select("k_id", "k_tag", "n_shingles", F.col("k_id").alias("component"), F.lit(True).alias("head"))
    return out.unionByName(bare).select(
        own_id().alias("doc_id"),
        "n_shingles",
        own_id("component").alias("component_id"),
        (F.col("k_id") == F.col("component")).alias("kept"),
        "head",
        "k_id",
        "k_tag",
    )


def _mark() -> Column:
    return F.xxhash64("k_id", "k_tag")


def _different(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    for end in ("a", "b"):
        pairs = pairs.join(parts.select(F.col("doc").alias(end), F.col("part").alias(f"{end}_part")), end)
    return pairs.where("a_part <> b_part").select("a", "b")
