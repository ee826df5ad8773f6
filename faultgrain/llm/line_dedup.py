"""Operator 4: near-duplicate lines by a deletion-neighbourhood join, on DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultgrain.llm.spark_tools import Scratch, fresh, row_id, text_tag

#: Lines of fewer characters are never removed: 1 leaves out empty lines alone.
LEAST = 1
#: At most so many lines are told apart as frequent ones.
FREQUENT = 4096
#: Characters of a block at least; longer lines have blocks of the square root of their length.
BLOCK = 32


def _lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the tag comes first, else it would be taken of the whole text for each of its lines
    rows = docs.select(row_id(id_col).alias("k_id"), text_tag(text).alias("k_tag"), text.alias("text"))
    rows = rows.select("k_id", "k_tag", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.where(F.length("line") >= least).withColumn("lid", F.unhex(F.md5("line")))


def _half_keys() -> Column:
    """Hashes of the first and the last half of a line. Lines one edit apart share one of them.

    With odd lengths a half may have one character more or less, so both are given.
    """
    keys = [F.xxhash64(F.lit("head"), F.left("line", a)) for a in (F.expr("length(line) div 2"), F.expr("(length(line) - 1) div 2"))]
    keys += [F.xxhash64(F.lit("tail"), F.right("line", b)) for b in (F.expr("(length(line) + 1) div 2"), F.expr("length(line) div 2"))]
    return F.array_distinct(F.array(*keys))


def _blocks(block: int) -> Column:
    """(role, key, mid, single) of each block of a line: the key hashes everything but the block, mid is the block.

    Role y: the line as it is. Role x: the line as one of one more character would be without some character
    of the block. Both number blocks by the longer line's length, so lines one edit apart share a key.
    """

    def of(role: str, nominal: str, tail: str, width: str) -> str:
        return f"""transform(sequence(0, ({nominal} - 1) div t_{role}), j -> struct('{role}' AS role,
            xxhash64({nominal}, j, left(line, j * t_{role}), substring(line, {tail})) AS key,
            substring(line, j * t_{role} + 1, {width}) AS mid, {nominal} <= t_{role} AS single))"""

    y = of("y", "n", "(j + 1) * t_y + 1", "t_y")
    x = of("x", "(n + 1)", "(j + 1) * t_x", "t_x - 1")
    return F.expr(f"concat({y}, {x})")


def near_lines(
    docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, block: int = BLOCK, frequent: int = FREQUENT
) -> DataFrame:
    """(k_id, k_tag, gone): the positions of the lines of a document that go."""
    lines = _lines(docs, id_col, text_col, least)
    known = lines.withColumn("keys", _half_keys()).groupBy("lid").agg(
        F.min(F.struct("k_id", "k_tag", "pos")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys")
    )
    known = scratch.written(known, "distinct-lines")
    # lines that share a half with another line
    halves = known.select("lid", F.explode("keys").alias("key"))
    mark = F.xxhash64("lid")
    shared = halves.groupBy("key").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where("a < b").select("key")
    likely = halves.join(shared, "key").select("lid").distinct().join(known.select("lid", "first"), "lid")
    likely = likely.select("lid", F.col("first.k_id").alias("k_id"), F.col("first.k_tag").alias("k_tag"), F.col("first.pos").alias("pos"))
    texts = lines.drop("lid").join(likely, ["k_id", "k_tag", "pos"]).dropDuplicates(["lid"])
    texts = scratch.written(texts.select(F.struct("k_id", "k_tag", "pos", "lid").alias("own"), "line"), "likely-lines")
    # of those, lines that share all but one block with another; a line of a single block has nothing but the block
    sized = texts.select("own", "line", F.length("line").alias("n"))
    sized = sized.withColumns({f"t_{r}": F.greatest(F.lit(block), F.sqrt(F.col("n") + e).cast("int")) for r, e in (("y", 0), ("x", 1))})
    blocks = sized.select("own", F.explode(_blocks(block)).alias("b")).select("own", "b.*")
    blocks = scratch.written(blocks, "line-blocks")
    long = blocks.where("NOT single")
    y, mark = F.col("role") == "y", F.xxhash64("own.lid")
    met = long.groupBy("key").agg(F.min(F.when(y, mark)).alias("a"), F.max(F.when(y, mark)).alias("b"), F.max(~y).alias("x"))
    met = met.where("a < b OR (a IS NOT NULL AND x)").withColumn("more", F.expr("a < b"))
    near = long.join(met.select("key", "more", "x"), "key").where((F.col("role") == "x") | F.col("more") | F.col("x"))
    near = near.select("own", "role", "key", "mid").unionByName(blocks.where("single").select("own", "role", "key", "mid"))
    # the deletion neighbourhood: a key with its position (substitutions), one without (insertions and deletions)
    left, right = "left(mid, i - 1)", "substring(mid, i + 1)"
    each = "sequence(1, length(mid))"
    variants = F.expr(f"""CASE WHEN role = 'x' THEN array(struct('x' AS role, xxhash64('d', key, mid) AS key))
        WHEN mid = '' THEN array() ELSE array_distinct(concat(
            transform({each}, i -> struct('s' AS role, xxhash64('s', key, i, {left}, {right}) AS key)),
            transform({each}, i -> struct('y' AS role, xxhash64('d', key, concat({left}, {right})) AS key)))) END""")
    keys = near.select("own", F.explode(variants).alias("v")).select("own", "v.*")
    # Equal keys of one role s differ in that position alone; one x is one deletion from every y. So the earliest
    # of the key tells for each line, and no pairs are listed: a key has a line for each character at most.
    one = Window.partitionBy("key")
    other = (
        F.when(F.col("role") == "s", F.min("own").over(one))
        .when(F.col("role") == "y", F.min(F.when(F.col("role") == "x", F.col("own"))).over(one))
        .otherwise(F.min(F.when(F.col("role") == "y", F.col("own"))).over(one))
    )
    pairs = keys.withColumn("other", other).where("other < own").select("own", "other").distinct()
    pairs = pairs.join(texts.select("own", "line"), "own").join(texts.select(F.col("own").alias("other"), F.col("line").alias("earlier")), "other")
    close = pairs.where(F.levenshtein("line", "earlier", 1).isin(0, 1)).select("own.lid").distinct().withColumn("near", F.lit(True))
    # every line but the first of its kind, and every line of a kind that has an earlier neighbour
    judged = known.join(close, "lid", "left").where("near OR n > 1").select("lid", "first", "n", F.coalesce("near", F.lit(False)).alias("near"))
    judged = scratch.written(judged, "judged-lines")
    # Kinds with over 1 in ``frequent`` of all lines are looked up where the lines are, and their lines spread by place,
    # so none meets in one task.
    bound = known.agg(F.ceil(F.sum("n") / frequent).alias("bound"))
    often = judged.join(F.broadcast(bound), F.col("n") > F.col("bound"))  # one row
    often = scratch.written(often.select("lid", F.col("first").alias("o_first"), F.col("near").alias("o_near")), "frequent-lines")
    places = lines.select("k_id", "k_tag", "pos", "lid").join(F.broadcast(often), "lid", "left")  # ``frequent`` rows at most
    spread = F.unhex(F.md5(F.concat_ws(" ", "k_id", "k_tag", "pos")))
    places = places.withColumn("lid", F.when(F.col("o_first").isNull(), F.col("lid")).otherwise(spread))
    places = places.join(judged.select("lid", "first", "near"), "lid", "left")
    near, first = F.coalesce("o_near", "near"), F.coalesce("o_first", "first")
    gone = places.where(first.isNotNull() & (near | (F.struct("k_id", "k_tag", "pos") != first)))
    return scratch.written(gone.groupBy("k_id", "k_tag").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "lines-gone", keep=True)


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """The rows and columns of ``docs`` with the text that is left, and k_lines and k_removed (numbers of lines).

    Lines are what newlines separate. In the order of (id, a hash of the text, position), a line goes if an
    earlier line of any document is equal to it or one edit away: one character inserted, deleted or replaced.
    Lines are judged on the input: one that goes can still be the earlier line. Lines of fewer than ``least``
    characters, by default empty ones, stay and are nobody's earlier line.

    Hashes of halves, then (in lines of over ``block`` characters) of all but one block, find the lines that can have
    a neighbour; those emit every variant of the block with one character deleted, as a hashed key. Equal keys are
    joined and each line checked against the earliest by edit distance. Keys are combined by minima, so no group's
    pairs are listed.

    A null text has one empty line and stays null; an empty text likewise. Rows that repeat in id and text lose
    the same lines and keep the same first ones. Rows without an id come first. An empty table gives no rows. The
    columns of ``docs`` stay as they are, whatever their names; where one is called k_lines or k_removed, the new
    column's name has _ after it.
    """
    with Scratch(docs.sparkSession) as scratch:
        gone = near_lines(docs, scratch, id_col=id_col, text_col=text_col, least=least, block=block)
    key, tag, out, n_lines, n_removed = fresh(docs, "k_id", "k_tag", "k_gone", "k_lines", "k_removed")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({key: row_id(id_col), tag: text_tag(text)})
    rows = rows.join(gone.select(F.col("k_id").alias(key), F.col("k_tag").alias(tag), F.col("gone").alias(out)), [key, tag], "left")
    parts = F.split(F.col(text_col), "\n", -1)
    # a flag for each line, from the rising places of those that go: stretches of true, each ended by one false
    gap = F.transform(out, lambda p, i: F.concat(F.array_repeat(F.lit(True), p - F.coalesce(F.get(F.col(out), i - 1), F.lit(-1)) - 1), F.array(F.lit(False))))
    after = F.array_repeat(F.lit(True), F.size(parts) - 1 - F.element_at(out, -1))
    stays = F.arrays_zip(parts.alias("line"), F.concat(F.flatten(gap), after).alias("stays"))
    left = F.array_join(F.transform(F.filter(stays, lambda x: x["stays"]), lambda x: x["line"]), "\n")
    rows = rows.withColumn(n_lines, F.size(F.split(text, "\n", -1)).cast("long"))
    rows = rows.withColumn(n_removed, F.coalesce(F.size(out), F.lit(0)).cast("long"))
    rows = rows.withColumn(text_col, F.when(F.col(out).isNull(), F.col(text_col)).otherwise(left))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), n_lines, n_removed)


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_sha256."""
    out = line_dedup(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return out.select(
        "doc_id",
        F.col("k_lines").alias("n_lines"),
        F.col("k_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
