"""Operator 7: sharding by fixed virtual slots and a versioned slot-to-shard map, on DataFrame functions alone."""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultgrain.llm.spark_tools import Scratch, own_id, row_id, shared_dir, text_tag

SLOTS = 4096
SHARDS = 16
#: A stored map is edited where the heaviest shard exceeds the lightest by more than this share of the mean.
TOLERANCE = 0.002


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot] for every virtual slot; each edit makes a new version."""

    version: int
    shard_of: tuple[int, ...]
    shards: int

    def table(self, spark: SparkSession) -> DataFrame:
        """(version, vslot, shard), as many rows as there are slots."""
        rows = json.dumps([{"vslot": i, "shard": s} for i, s in enumerate(self.shard_of)])
        parsed = F.from_json(F.lit(rows), "array<struct<vslot:int,shard:int>>")
        return spark.range(1).select(F.inline(parsed)).select(F.lit(self.version).alias("version"), "vslot", "shard", F.lit(self.shards).alias("shards"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the stored map; older versions stay readable."""
        self.table(spark).drop("version").write.parquet(f"{path}/version={self.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
    """The given or the newest version of a stored map; none where nothing is stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    stored = spark.read.parquet(path)
    version = stored.agg(F.max("version")).first()[0] if version is None else version
    rows = sorted((r.vslot, r.shard, r.shards) for r in stored.where(F.col("version") == version).collect())  # a row for each slot
    return SlotMap(version, tuple(s for _, s, _ in rows), rows[0][2])


def even_map(*, slots: int = SLOTS, shards: int = SHARDS) -> SlotMap:
    """First version: slots are dealt in turn, whatever they hold."""
    return SlotMap(1, tuple(i % shards for i in range(slots)), shards)


def spread_of(slot_map: SlotMap, slot_bytes: dict[int, int]) -> float:
    """What the heaviest shard holds more than the lightest, as a share of the mean."""
    load = [0] * slot_map.shards
    for slot, shard in enumerate(slot_map.shard_of):
        load[shard] += slot_bytes.get(slot, 0)
    return (max(load) - min(load)) * slot_map.shards / (sum(load) or 1)


def rebalanced_map(old: SlotMap, slot_bytes: dict[int, int], *, shards: int) -> SlotMap:
    """The next version for ``shards`` shards: few slots move.

    Slots of shards that no longer exist go to the lightest ones. Then the heaviest shard gives the lightest one a
    slot, or trades one for a lighter one, whichever comes nearest to half their difference, until nothing lessens it.
    """
    out = list(old.shard_of)
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]  # (bytes, slot), sorted
    homeless = []
    for size, slot in sorted((slot_bytes.get(i, 0), i) for i in range(len(out))):
        if out[slot] < shards:
            load[out[slot]] += size
            held[out[slot]].append((size, slot))
        else:
            homeless.append((size, slot))

    def move(item: tuple[int, int], to: int, since: int | None = None) -> None:
        if since is not None:
            held[since].remove(item)
            load[since] -= item[0]
        insort(held[to], item)
        load[to] += item[0]
        out[item[1]] = to

    for item in reversed(homeless):
        move(item, min(range(shards), key=lambda s: (load[s], s)))
    for _ in range(len(out)):
        high, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        best, trade = (gap, None), None
        for give in held[high]:
            # what comes back, if anything, should weigh give less half the gap
            at = bisect_left(held[low], (give[0] - gap / 2, -1))
            for back in [None, *held[low][max(0, at - 1) : at + 1]]:
                left = abs(gap - 2 * (give[0] - (back[0] if back else 0)))
                if left < best[0]:
                    best, trade = (left, give), (give, back)
        if trade is None:
            break
        move(trade[0], low, high)
        if trade[1]:
            move(trade[1], high, low)
    return SlotMap(old.version + 1, tuple(out), shards)


def current_map(spark: SparkSession, path: str, slot_bytes: dict[int, int], *, slots: int = SLOTS, shards: int = SHARDS, tolerance: float = TOLERANCE) -> SlotMap:
    """The newest version of the map stored at ``path``, edited and stored again where shards are not near equal.

    Where nothing is stored, an even map is stored first. What is returned was read back from the store.
    """
    found = load_map(spark, path)
    if found is None:
        found = even_map(slots=slots, shards=shards)
        found.save(spark, path)
    if found.shards != shards or spread_of(found, slot_bytes) > tolerance:
        edited = rebalanced_map(found, slot_bytes, shards=shards)
        if (edited.shards, edited.shard_of) != (found.shards, found.shard_of):  # a map that can't be any better stays
            edited.save(spark, path)
    return load_map(spark, path)


def sized_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k_id, size, text_crc32, spread, at): spread hashes id and text; at tells rows apart once the table is written."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        row_id(id_col).alias("k_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(row_id(id_col), text_tag(text)).alias("spread"),
        F.monotonically_increasing_id().alias("at"),
    )


def slotted(rows: DataFrame, *, slots: int = SLOTS) -> DataFrame:
    """``rows`` with vslot, the virtual slot of a record by its id and text.

    Rows that repeat so often in both that they would weigh a slot down are dealt one by one.
    """
    same = rows.groupBy("spread").agg(F.count(F.lit(1)).alias("n"))
    bound = rows.agg((F.count(F.lit(1)) / (8 * slots)).alias("bound"))
    often = same.where("n > 16").join(F.broadcast(bound), F.col("n") > F.col("bound"))  # one row
    often = often.select("spread", F.lit(True).alias("often"))  # at most 8 * slots rows
    spread = F.when(F.col("often"), F.xxhash64("spread", "at")).otherwise(F.col("spread"))
    return rows.join(F.broadcast(often), "spread", "left").withColumn("vslot", F.pmod(spread, F.lit(slots)).cast("int")).drop("often", "spread")


def slot_bytes(rows: DataFrame) -> dict[int, int]:
    """Bytes of each virtual slot: at most one row a slot reaches the driver."""
    return {r.vslot: r.bytes for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect()}


def shard_documents(
    docs: DataFrame,
    map_path: str | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    slots: int = SLOTS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version.

    Records are hashed into ``slots`` virtual slots, the bytes of each slot are summed, and the map from slots to shards
    that is stored at ``map_path`` says where they go. Where its shards aren't near equal any more (beyond ``tolerance``),
    or where another number of shards is asked for, the map is edited, moving few slots, and stored as the next version.
    A first version deals the slots in turn. Without ``map_path`` the map stands in the shared folder, one for each number of slots, and every
    later run begins with the version that the last one left.

    Law ``bytes``: shard sizes differ by no more than about ``tolerance`` of their mean, or by one record where that
    outweighs a shard. ``slot`` numbers the rows of each shard from 0 without a gap, in the order of virtual slot, id and
    checksum. A null text has size 1 and checksum 0. A record's virtual slot depends on its id and text; rows that
    repeat get numbers of their own, and very many of them several slots. An empty table gives no rows; an id that is null
    stays null. ``grown_shard`` is null, as the law is not ``key``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    map_path = map_path or f"{shared_dir(spark)}/slot-map-{slots}"
    rows = scratch.written(sized_rows(docs, id_col=id_col, text_col=text_col), "sharding-rows", keep=True)
    rows = slotted(rows, slots=slots)
    slot_map = current_map(spark, map_path, slot_bytes(rows), slots=slots, shards=shards, tolerance=tolerance)
    counts = rows.groupBy("vslot").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        slot_map.table(spark)
        .join(counts, "vslot", "left")
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select("version", "vslot", "shard", "offset")
    )
    within = Window.partitionBy("vslot").orderBy("k_id", "text_crc32", "size", "at")
    return (
        rows.withColumn("rank", F.row_number().over(within))
        .join(F.broadcast(placed), "vslot")  # a row for each virtual slot, whatever the input
        .select(
            own_id().alias("doc_id"),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "vslot",
            F.col("version").alias("map_version"),
        )
    )
