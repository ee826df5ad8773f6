"""One key in most rows, and very long texts: results stay right, and costs in proportion."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from faultgrain.llm import sharding
from faultgrain.llm.decontamination import decontaminate
from faultgrain.llm.exact_dedup import exact_dedup
from faultgrain.llm.line_dedup import line_report
from faultgrain.llm.near_dedup import near_dedup
from faultgrain.llm.pii import find_pii

DOCS = "doc_id long, text string"


def seconds(make) -> float:
    make()  # compiled
    began = time.process_time(), time.time()
    make()
    return time.time() - began[1]


def test_addresses_of_one_text_cost_in_proportion(spark):
    def run(n: int) -> float:
        text = " ".join(f"u{i}@ex{i}.com key=ab{i}cdef{i}99" for i in range(n))
        df = spark.createDataFrame([(1, text)], DOCS)
        return seconds(lambda: find_pii(df).collect())

    assert run(8000) < 2.5 * run(4000) + 2


def test_lines_of_one_text_cost_in_proportion(spark):
    def run(n: int) -> float:
        df = spark.createDataFrame([(1, "same line of text\n" * n)], DOCS)
        assert line_report(df).first().n_removed == n - 1
        return seconds(lambda: line_report(df).collect())

    assert run(80_000) < 2.5 * run(40_000) + 2


def test_planted_secrets_are_found_and_words_are_not(spark):
    """Recall and precision of the spans that the method adds, on texts whose secrets and accounts are known."""
    r = random.Random(11)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    token = lambda n: "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    words = "the quick report of chapter section page figure shows that version release model and others are fine".split()
    rows, want = [], {}
    for i in range(400):
        text = " ".join(r.choice(words) for _ in range(30))
        spans = set()
        if i % 2 == 0:
            for _ in range(2):
                secret = r.choice([hexes(32), token(24), "AKIA" + token(16).upper()])
                if not any(c.isdigit() for c in secret):
                    continue
                text += f" {r.choice(['token', 'password', 'api_key', 'secret'])}={r.choice(['', chr(34)])}"
                spans.add(("secret", len(text), len(text) + len(secret)))
                text += secret + (chr(34) if text.endswith(chr(34)) else "")
                text += " and so on."
        text += " see version 1.2 page 12 of 2019, chapter 7, ab1 and model rx200."
        rows.append((i, text))
        want[i] = spans
    found = {x.doc_id: {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in x.spans.split(",") if s) if k == "secret"} for x in find_pii(spark.createDataFrame(rows, DOCS)).collect()}
    planted = sum(map(len, want.values()))
    hit = sum(len(found[i] & want[i]) for i in want)
    extra = sum(len(found[i] - want[i]) for i in want)
    assert planted > 300 and hit >= 0.95 * planted and extra <= 0.05 * planted


def test_copies_without_ids_are_spread_over_salts(spark):
    rows = [(None, "same text")] * 3000 + [(7, "same text")] * 3000 + [(i, f"t{i}") for i in range(100, 200)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    out = exact_dedup(df).where("group_size = 6000")
    assert out.count() == 6000 and {r.keep_id for r in out.select("keep_id").distinct().collect()} == {7}
    assert out.where("kept").count() == 3000
    salts = df.select(F.lit(None).cast("long").alias("k_id"), F.monotonically_increasing_id().alias("at")).select(F.pmod(F.xxhash64("k_id", "at"), F.lit(60)).alias("s")).groupBy("s").count()
    assert salts.count() == 60 and salts.agg(F.max("count")).first()[0] < 300
    for many in (1, 500):
        assert exact_dedup(df, salts=many).where("kept").count() == 3100


def test_many_documents_with_the_windows_of_many_items(spark):
    passage = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{passage} and {i}") for i in range(700)] + [(1000, "nothing here")], DOCS)
    items = spark.createDataFrame([(i, f"item {i} {passage}") for i in range(700)], "item_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in decontaminate(docs, items).collect()}
    assert time.time() - began < 120
    assert {got[i].n_items for i in range(700)} == {700} and {got[i].n_hit for i in range(700)} == {40} and len({got[i].items_sha256 for i in range(700)}) == 1
    assert got[1000].n_items == 0 and not got[1000].contaminated


def plain_hits(text: str, items: list[tuple], width: int) -> tuple:
    """(words, hit words, items that hit) by their definition."""
    w, hit, names = text.split(), set(), set()
    for name, item in items:
        x = item.split()
        n = min(width, len(x))
        windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if x else set()
        at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows] if x else []
        hit |= {j for i in at for j in range(i, i + n)}
        names |= {str(name)} if at else set()
    return len(w), len(hit), ",".join(sorted(names))


@pytest.mark.parametrize("many", [0, 2, 1000])
def test_hits_extended_from_grams_equal_plain_ones(spark, many):
    """Few different words: grams stand in many stretches, ties of hashes and short items abound."""
    r = random.Random(21)
    some = lambda n, k: " ".join(r.choice("abcdef"[:k]) for _ in range(n))
    items = [(i, some(r.randrange(0, 16), r.choice([2, 6]))) for i in range(60)] + [(100 + i, "a a a a a a a a a") for i in range(3)]
    docs = [(i, some(r.randrange(0, 60), r.choice([2, 6]))) for i in range(150)] + [(500, "a " * 300), (501, ""), (502, " ".join(t for _, t in items))]
    out = decontaminate(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, "item_id long, text string"), window=7, gram=3, many=many)
    got = {x.doc_id: (x.n_words, x.n_hit, x.items_sha256) for x in out.collect()}
    want = {i: plain_hits(t, items, 7) for i, t in docs}
    assert got == {i: (n, hit, hashlib.sha256(names.encode()).hexdigest()) for i, (n, hit, names) in want.items()}
    assert sum(hit > 0 for _, hit, _ in want.values()) > 50


def test_a_gram_that_half_of_all_items_and_documents_have(spark):
    r = random.Random(22)
    word = lambda: f"w{r.randrange(10**6)}"
    phrase = " ".join(f"often{i}" for i in range(5))
    around = lambda: " ".join([*(word() for _ in range(12)), phrase, *(word() for _ in range(12))])
    items = [(i, around()) for i in range(2000)]
    docs = [(i, around()) for i in range(2000)] + [(5000 + i, items[i][1]) for i in range(300)]
    got = {x.doc_id: (x.n_hit, x.n_items) for x in decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {got[i] for i in range(2000)} == {(0, 0)} and {got[5000 + i] for i in range(300)} == {(29, 1)}


def test_one_bucket_with_half_of_all_documents(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:58] + [f"x{i}", base[59]])) for i in range(600)]
    r = random.Random(12)
    rows += [(1000 + i, " ".join(f"v{r.randrange(10**6)}" for _ in range(60))) for i in range(600)]
    got = {x.doc_id: x.component_id for x in near_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert {got[i] for i in range(600)} == {0} and all(got[i] == i for i in range(1000, 1600))


def test_a_later_run_loads_the_stored_map(spark, tmp_path):
    path = str(tmp_path / "map")
    rows = [(i, "x" * (i % 97)) for i in range(3000)]
    first = sharding.shard_documents(spark.createDataFrame(rows, DOCS), path, shards=4, slots=64).collect()
    again = sharding.shard_documents(spark.createDataFrame(rows, DOCS), path, shards=4, slots=64).collect()
    place = lambda out: {r.doc_id: (r.shard, r.map_version) for r in out}
    assert place(first) == place(again)  # the map of the first run serves the second
    grown = sharding.shard_documents(spark.createDataFrame(rows, DOCS), path, shards=5, slots=64).collect()
    moved = sum(place(grown)[i][0] != place(first)[i][0] for i, _ in rows)
    assert {r.map_version for r in grown} == {first[0].map_version + 1} and 0 < moved < 0.5 * len(rows)
    # a last shard that holds no slot still counts
    sharding.SlotMap(9, (0, 1, 0, 1), 3).save(spark, path + "-2")
    assert sharding.load_map(spark, path + "-2").shards == 3


@pytest.mark.parametrize("name", ["slots"])
def test_the_map_stands_in_the_shared_folder(spark, name):
    rows = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(500)], DOCS)
    a, b = (sharding.shard_documents(rows, slots=32).collect() for _ in range(2))
    assert {(r.doc_id, r.shard, r.map_version) for r in a} == {(r.doc_id, r.shard, r.map_version) for r in b}
