"""Graphs of files that change together, ranks and distances in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.sources.scratch import checkpointed


def cochange_edges(changed: DataFrame, *, commit: str = "fix_commit", max_files: int | None = None, block: int = 512) -> DataFrame:
    """(source_file, target_file, weight): commits in which both files changed, source before target.

    A commit's files meet in blocks of about ``block`` x ``block``, so the pairs of a sweeping commit are made in many tasks, and counted in
    each before they are shuffled. A commit of n files has n * (n - 1) / 2 pairs, as asked for; with ``max_files``, commits of more files
    (sweeping renames, formatting) are left out as saying nothing of two files.
    """
    files = changed.select(F.col(commit).alias("c"), "file").where(F.col("file").isNotNull()).distinct()
    sizes = files.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    if max_files is not None:
        sizes = sizes.where(F.col("n") <= max_files)
    dealt = files.join(sizes.select("c", F.ceil(F.col("n") / block).cast("int").alias("parts")), "c")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("file"), F.col("parts")).cast("int"))
    left = dealt.select("c", F.col("file").alias("x"), F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"))
    right = dealt.select("c", F.col("file").alias("y"), F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j"))
    pairs = left.join(right, ["c", "i", "j"]).where("x <> y AND (i < j OR x < y)").select(F.least("x", "y").alias("source_file"), F.greatest("x", "y").alias("target_file"))
    return pairs.groupBy("source_file", "target_file").agg(F.count(F.lit(1)).alias("weight"))


def _ranks_after(ranks: DataFrame, links: DataFrame, total: DataFrame, damping: float) -> DataFrame:
    got = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
    # what nodes without links hold is what the others don't pass on
    passed = got.agg(F.coalesce(F.sum("got"), F.lit(0.0)).alias("passed"))
    rows = ranks.select("node").join(got.withColumnRenamed("dst", "node"), "node", "left").join(F.broadcast(passed)).join(F.broadcast(total))  # one row each
    lost = (1 - F.col("passed")) / F.col("n")
    return rows.select("node", ((1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + lost)).alias("rank"))


def pagerank(edges: DataFrame, *, rounds: int = 20, damping: float = 0.85, cut_every: int = 4) -> DataFrame:
    """(node, rank) after fixed rounds over edges (src, dst, weight); rank of nodes without links is spread evenly.

    A node passes its rank on by weight. Lineage is cut by a checkpoint every few rounds. Ranks sum to 1; no edges, no rows.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    total = nodes.agg(F.count(F.lit(1)).alias("n"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    links = checkpointed(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("share")))
    total = checkpointed(total)
    ranks = checkpointed(nodes.join(F.broadcast(total)).select("node", (F.lit(1.0) / F.col("n")).alias("rank")))  # one row
    for k in range(1, rounds + 1):
        ranks = _ranks_after(ranks, links, total, damping)
        if k % cut_every == 0:
            ranks = checkpointed(ranks)
    return ranks


def bfs_levels(edges: DataFrame, seeds: DataFrame, *, max_depth: int = 10) -> DataFrame:
    """(node, level): the fewest edges (src, dst) from any seed (node) to each node that is reached within max_depth."""
    edges = checkpointed(edges.select("src", "dst").distinct())  # read at every level
    seen = checkpointed(seeds.select("node").where(F.col("node").isNotNull()).distinct().withColumn("level", F.lit(0)))
    front = seen
    for depth in range(1, max_depth + 1):
        reached = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = checkpointed(reached.join(seen, "node", "left_anti").withColumn("level", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
