"""The text operators on odd tables, and against plain code."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultgrain.llm import queries as Q
from faultgrain.llm.components import connected_components
from faultgrain.llm.decontamination import decontaminate
from faultgrain.llm.exact_dedup import exact_dedup
from faultgrain.llm.language_id import _chosen, fit_language_model, identify_language
from faultgrain.llm.line_dedup import line_dedup, line_report
from faultgrain.llm.near_dedup import near_dedup
from faultgrain.llm.pii import find_pii, reliabilities
from faultgrain.llm.sentencepiece_codec import codec, encode_documents
from faultgrain.llm.sharding import current_map, even_map, load_map, rebalanced_map, shard_documents, spread_of
from faultgrain.llm.spark_tools import keyed
from faultgrain.llm.substring_dedup import substring_dedup
from faultgrain.llm.suffix_dedup import anchored_segments, repeated_starts, suffix_dedup
from plain import components, kept_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k_id string, h long, pos string, d string"
DATA = "/root/testdata/sf0.001"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows; columns whose names clash with inner ones."""
    copy = words(1, 120)
    texts = [None, "", " ", "x", copy, copy, copy + " end", words(2, 20_000), "é" * 300, "line of some length here\n" * 4 + "line of same length here", "!!! 123", "\n\n\n"]
    rows = [(i, t, ("en", "de", None)[i % 3], "s", None, "a", 1, "b", "c") for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[0], (None, copy, "en", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


OPERATORS = {
    "pii": find_pii,
    "suffix": suffix_dedup,
    "decontaminate": lambda d: decontaminate(d, d.select(F.col("doc_id").alias("item_id"), "text", "h")),
    "lines": line_report,
    "substring": substring_dedup,
    "exact": exact_dedup,
    "shard": shard_documents,
    "near": near_dedup,
    "language": identify_language,
    "pieces": lambda d: encode_documents(d, Q.model_path()),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_each_get_a_row(spark, name):
    rows = odd_rows()
    out = OPERATORS[name](spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, (r[0] for r in out))) == sorted(map(str, (r.doc_id for r in out))) == sorted(str(r[0]) for r in rows)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_dedup_with_colliding_digests(spark):
    rows = [(i, f"t{i % 7}", *[None] * 7) for i in range(50)]
    for digest in (None, lambda t: F.lit(1)):
        out = exact_dedup(spark.createDataFrame(rows, SCHEMA), digest=digest).collect()
        assert {r.doc_id: r.keep_id for r in out} == {i: max(j for j in range(50) if j % 7 == i % 7) for i in range(50)}


def test_shards_and_edited_map(spark, tmp_path):
    rows = [(i, "x" * (i % 97), *[None] * 7) for i in range(3000)]
    out = shard_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes, slots = {}, {}
    for r in out:
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.text_crc32 == zlib.crc32(b"x" * (r.doc_id % 97))
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) < 0.02 * max(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    weight = {i: 100 + i % 13 for i in range(4096)}
    first = even_map()
    more = rebalanced_map(first, weight, shards=17)
    moved = [(a, b) for a, b in zip(first.shard_of, more.shard_of, strict=True) if a != b]
    assert sum(b == 16 for _, b in moved) > 200 and len(moved) < 300 and spread_of(more, weight) < 0.002
    path = str(tmp_path / "map")
    assert load_map(spark, path) is None
    stored = current_map(spark, path, weight)
    assert stored.version in (1, 2) and current_map(spark, path, weight) == stored  # balanced: no new version
    grown = current_map(spark, path, weight, shards=17)
    assert grown.version == stored.version + 1 and grown.shards == 17 and load_map(spark, path, stored.version) == stored
    fewer = current_map(spark, path, weight, shards=15)
    assert fewer.shards == 15 and set(fewer.shard_of) == set(range(15)) and spread_of(fewer, weight) < 0.002


def test_shards_where_one_row_repeats(spark):
    rows = [(i, "x" * (i % 97), *[None] * 7) for i in range(2000)] + [(7, "same text", *[None] * 7)] * 1000 + [(None, "no id", *[None] * 7)] * 1000
    out = shard_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    load = Counter()
    for r in out:
        load[r.shard] += r["size"]
    assert len(out) == 4000 and max(load.values()) - min(load.values()) < 0.02 * max(load.values())
    for shard in range(16):
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))


def test_merged_transforms_find_repeats():
    r = random.Random(5)
    base = bytes(r.choice(b"abcd") for _ in range(900))
    texts = [base[:400], base[100:500], base[350:], b"ab" * 200, bytes(r.choice(b"ab") for _ in range(300)), base[:199]]
    seen: dict[bytes, int] = {}
    for t in texts:
        for s in range(len(t) - 199):
            seen[t[s : s + 200]] = seen.get(t[s : s + 200], 0) + 1
    for shards in (2, 3):
        got = repeated_starts(texts, 200, shards)
        assert [f.tolist() for f in got] == [[seen[t[s : s + 200]] > 1 for s in range(len(t) - 199)] for t in texts]


def test_common_phrase_is_split(spark):
    r = random.Random(6)
    phrase = "".join(r.choice("abcdefgh ") for _ in range(120))
    texts = [words(1000 + i, 60) + phrase + words(5000 + i, 60) for i in range(400)]
    texts += [texts[7], texts[8][:500], *[t[:150] + phrase * 3 + t[150:] for t in texts[:40]], "x" * 5000, words(77, 20) + texts[9][100:]]
    frame = spark.createDataFrame([(i, t, *[None] * 7) for i, t in enumerate(texts)], SCHEMA)
    groups = anchored_segments(keyed(frame), often=50).where(F.octet_length("segment") >= 200).groupBy("h").count()
    assert groups.agg(F.max("count")).first()[0] <= 50
    seen = Counter(t[s : s + 200] for t in texts for s in range(len(t) - 199))
    got = suffix_dedup(frame, often=50).collect()
    for x in got:
        t, gone = texts[x.doc_id], set()
        for s in range(len(t) - 199):
            if seen[t[s : s + 200]] > 1:
                gone.update(range(s, s + 200))
        assert x.kept_bytes == "".join(c for i, c in enumerate(t) if i not in gone).encode() and x.n_removed == len(gone)
    assert len(got) == len(texts) and [tuple(x) for x in sorted(got)] == [tuple(x) for x in sorted(suffix_dedup(frame).collect())]


def test_lines_one_edit_apart(spark):
    line = "a line that is long enough to count " * 3
    other = line[:50] + "#" + line[51:]
    texts = [line, f"{other}\nshort", line[:-1], line + "!", line[:20] + "zz" + line[20:], line.replace("long", "lang", 1)]
    rows = [(i, t, *[None] * 7) for i, t in enumerate(texts)]
    out = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {0: line, 1: "short", 2: "", 3: "", 4: texts[4], 5: ""}


def test_near_duplicates_by_hand(spark):
    a = words(3, 100).split()
    near, far = a[:50] + ["zz"] + a[51:], a[:40] + words(4, 60).split()
    rows = [(i, t, *[None] * 7) for i, t in enumerate([" ".join(a), " ".join(near), " ".join(far), " ".join(a).upper(), "", None])]
    out = {r.doc_id: (r.component_id, r.kept) for r in near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {0: (0, True), 1: (0, False), 2: (2, True), 3: (0, False), 4: (4, True), 5: (5, True)}


def test_components_of_long_chains(spark):
    ids = random.Random(8).sample(range(1000, 1500), 500)
    far = [(i, i + 1) for i in range(2, 400)] + [(400, 1)]  # the smallest id at the far end
    drift = [(ids[i], ids[i + d]) for d in (1, 2) for i in range(500 - d)]
    nodes = spark.createDataFrame([(i,) for i in [*range(401), *ids]], "a long")
    out = {r.doc: r.part for r in connected_components(nodes, spark.createDataFrame(far + drift, "a long, b long")).collect()}
    assert out == {0: 0} | dict.fromkeys(range(1, 401), 1) | dict.fromkeys(ids, 1000)


def test_chain_of_versions_is_one_component(spark):
    text = words(11, 10 * 300 + 94).split()
    # 100 shingles each; neighbours share 90 of 110, documents two apart 80 of 120
    versions = [" ".join(text[10 * i : 10 * i + 104]) for i in range(300)]
    rows = [((i + 1) % 300, t, *[None] * 7) for i, t in enumerate(versions)]
    out = {r.doc_id: (r.component_id, r.kept) for r in near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {i: (0, i == 0) for i in range(300)}


def test_substrings_and_words_of_35(spark):
    common = words(9, 35)
    rows = [(0, f"a b {common} c", *[None] * 7), (1, f"{common} d", *[None] * 7), (2, words(9, 34), *[None] * 7)]
    out = {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[0] == (35, "a b c") and out[1] == (35, "d") and out[2][0] == 0


def test_personal_data(spark):
    text = "mail joe.x@a-b.example.org_y@c.d 1.2.3.4.5 999.1.1.1 card 4111 1111 1111 1111  +1 (555) 555-1234 token = 'f33e61083db5dbdf4bd2369d2f80176e'"
    out = find_pii(spark.createDataFrame([(0, text, *[None] * 7)], SCHEMA)).first()
    assert (out.n_email, out.n_ip, out.n_card, out.n_phone) == (2, 1, 1, 1)
    assert out.base_sha256 == hashlib.sha256(",".join(s for s in out.spans.split(",") if not s.startswith("secret")).encode()).hexdigest()


def plain_base(text: str) -> list[tuple]:
    """(start, kind, end) of the base spans, by plain patterns and plain tests."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])*",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    }

    def good(kind: str, m: str) -> bool:
        digits = re.sub("[^0-9]", "", m)
        if kind == "card":
            twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            return 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in twice) % 10 == 0
        return {"email": True, "ip": all(int(x) < 256 for x in m.split(".")) if kind == "ip" else True, "phone": 9 <= len(digits) <= 15}[kind]

    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, text) if good(k, m[0]))


def test_base_spans_equal_plain_patterns(spark):
    cards = ["4111111111111111", "4539148803436467", "378282246310005", "6304000000000000", "4222222222222", "501800000009"]
    texts = [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    for c in cards:
        for mark in " -":
            texts += [f"é {mark.join(c[i : i + k] for i in range(0, len(c), k))}, paid" for k in (1, 2, 3, 4, 6)]
        texts += [" ".join(c[:6]) + "-" + "-".join(c[6:]), "  ".join(c), "--".join(c), ".".join(c), c, f"1 2 3  {' '.join(c)}"]
    got = find_pii(spark.createDataFrame([(i, t, *[None] * 7) for i, t in enumerate(texts)], SCHEMA)).collect()
    for r in got:
        want = plain_base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[1] == i for x in want) for i in range(4)), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest()
    assert len(got) == len(texts) and sum(r.n_card for r in got) > 60


def packed(votes: tuple) -> int:
    return sum((v + 1) * 3**j for j, v in enumerate(votes))


def test_reliable_labelers_win():
    counts = {packed(p): n for p, n in {(1, 1, 1, 1, 1, 0): 50, (-1, 0, -1, -1, -1, -1): 80, (1, 0, 0, 1, 0, 0): 20, (0, 0, -1, -1, 0, 0): 30}.items()}
    right, belief = reliabilities(counts)
    assert sorted(belief.values())[0] < 0.05 and sum(p > 0.9 for p in belief.values()) == 2
    assert all(0.65 <= r <= 0.98 for r in right)


def test_labelers_keep_their_sides():
    """A pattern that all say yes to stays one, whatever else the corpus holds."""
    yes, no = packed((1, 0, 1, 1, 0, 0)), packed((-1, 0, 0, -1, -1, 0))
    for n in (0, 10, 10_000_000):
        _, belief = reliabilities({yes: 13, no: n, packed((1, 0, 0, -1, -1, -1)): n, packed((0, 0, 0, 0, 1, 0)): n // 2})
        assert belief[yes] > 0.8 and belief[no] < 0.2


def test_secrets_stay_among_unrelated_rows(spark):
    r = random.Random(3)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(20)]
    ours = [f'words and then token = "{h}" and words' for h in hexes] + ["pay 4539148803436468 now", "account: 1234 5678 9012 3456"]
    clean = ["on page 12 of chapter7 see version 2 and route66", "part b52 came in 1999 to gate 7a", "just words, no number"] * 5
    noise = ["".join(r.choice("0123456789abXYZ#+/_-. ") for _ in range(60)) for _ in range(1500)]

    def added(texts):
        got = find_pii(spark.createDataFrame([(i, t, *[None] * 7) for i, t in enumerate(texts)], SCHEMA)).collect()
        return {r.doc_id: (r.n_secret, r.n_account, r.flagged) for r in got}

    alone, mixed = added(ours + clean), added(ours + clean + noise)
    want = {i: (1, 0, True) for i in range(20)} | {20: (0, 1, True), 21: (0, 1, True)} | {22 + i: (0, 0, False) for i in range(15)}
    assert alone == want and {i: mixed[i] for i in want} == want


@pytest.mark.parametrize("text", ["", " ", "  a  b", "▁a ▁▁", "<s> </s>", "日本語 🎉", "a" * 300, "x\n\n\ty", "1234567890" * 5, "aaaa    bbbb", words(1, 300)])
def test_pieces_equal_the_library(text):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=Q.model_path()), codec(Q.model_path())
    ids = library.encode(text, add_bos=True, add_eos=True)
    assert own.encode(text) == ids
    assert own.decode(ids) == own.decode_bytes(np.array(ids)).decode() == library.decode(ids)


def test_held_out_accuracy(spark):
    out = Q.op9_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() >= 0.9 * out.count()


def test_nothing_to_learn_a_language_from(spark):
    for lang, ids in ((None, range(30)), ("en", [None] * 5)):
        rows = [(i, f"some words {i}", lang, *[None] * 6) for i in ids]
        out = identify_language(spark.createDataFrame(rows, SCHEMA)).collect()
        assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)] * len(rows)


def test_sample_is_bounded_where_ids_repeat(spark):
    rows = [(i % 2, f"text {i % 40}", ("en", "de")[i % 2], *[None] * 6) for i in range(400)]
    out = _chosen(spark.createDataFrame(rows, SCHEMA), {"en": 200, "de": 200}, "doc_id", "text", "lang", 7).collect()
    assert 0 < Counter(r.lang for r in out)["de"] <= 7 and 0 < Counter(r.lang for r in out)["en"] <= 7
    every = _chosen(spark.createDataFrame(rows, SCHEMA), {"en": 200, "de": 200}, "doc_id", "text", "lang", 100).collect()
    assert len(every) == len({(r.lang, r.text) for r in every}) == 40


def test_stray_languages_are_not_learned(spark):
    """A dirty column: thousands of values that one row each has, beside two real languages."""
    spoken = {"en": "the cat and the dog went over the hill", "de": "der hund und die katze gingen über den berg"}
    rows = [(i, f"{spoken[k]} {i}", k, *[None] * 6) for i in range(300) for k in [("en", "de")[i % 2]]]
    rows += [(1000 + i, f"zzz {i}", f"x{i}", *[None] * 6) for i in range(3000)]
    model = fit_language_model(spark.createDataFrame(rows, SCHEMA), languages=2)
    assert sorted(n for names in model.languages.values() for n in names) == ["de", "en"]
    got = identify_language(spark.createDataFrame(rows, SCHEMA), model).where("doc_id < 300").collect()
    assert all(r.lang_pred == ("en", "de")[r.doc_id % 2] for r in got) and len(got) == 300


def test_many_short_texts_make_small_features():
    from faultgrain.llm.language_id import ROWS, features
    from faultgrain.llm.text_arrays import chunks
    import pyarrow as pa

    parts = [features(data, at) for _, _, data, at in chunks(pa.array(["ab cd"] * 1000), rows=ROWS)]
    assert max(map(len, parts)) <= ROWS and sum(map(len, parts)) == 1000 and np.allclose(np.vstack(parts)[0], np.vstack(parts)[999])


def test_lines_that_half_of_all_rows_share(spark):
    r = random.Random(4)
    rows = [(i, "the common line\n" + words(100 + i, 4) if i % 2 else words(100 + i, 4), *[None] * 7) for i in range(600)]
    rows += [(600 + i, c, *[None] * 7) for i, c in enumerate(["a", "b", "ab", "é", "", "\n\n", "x\ny", "Für.", "For."])]
    r.shuffle(rows)
    want = kept_lines([(x[0], x[1]) for x in rows])
    assert {x.doc_id: x.text for x in line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_templates_with_frequent_items(spark):
    """Documents of few common paragraphs in many buckets: frequent items are split, and no link is lost."""
    r = random.Random(9)
    parts = [words(700 + i, 25) for i in range(12)]
    texts = [" ".join([*r.sample(parts, 5), words(9000 + i, r.randint(1, 20))]) for i in range(150)]
    texts += [t + " tail" for t in texts[:20]]
    frame = spark.createDataFrame([(i, t, *[None] * 7) for i, t in enumerate(texts)], SCHEMA)
    want = components(list(enumerate(texts)))
    for block in (2, 1024):
        assert {x.doc_id: x.component_id for x in near_dedup(frame, block=block).collect()} == want


def test_one_of_each_group_without_ids(spark):
    near = words(3, 100).split()
    texts = [" ".join(near), " ".join([*near[:50], "zz", *near[51:]]), words(4, 30), None, ""]
    rows = [(None, t, *[None] * 7) for t in texts] + [(5, texts[0], *[None] * 7)]
    out = near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(x["head"] for x in out if x.n_shingles > 50) == 1 and sum(x["head"] for x in out) == 4


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, k_id string, K_TAG string, k_gone string, k_lines string, `a.b` string"


@pytest.mark.parametrize("name", ["language", "lines", "near_duplicates", "contamination", "pieces"])
@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows_and_clashing_names(spark, name, empty):
    import corpus_pipeline as P

    rows = [] if empty else [(*r[:5], "1", "2", "3", "4", "5") for r in odd_rows()]
    docs = spark.createDataFrame(rows, CLASHING)
    out = dict(P.STAGES)[name](spark, docs, DATA)
    got = out.collect()
    if name == "pieces":
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and len(got) == len(rows)
        return
    assert out.schema == docs.schema and len(got) <= len(rows)
    assert all(tuple(r[5:]) == ("1", "2", "3", "4", "5") for r in got)
    if name == "contamination":
        assert len(got) == len(rows)
    if name == "near_duplicates" and not empty:
        assert sum(r.text == words(1, 120) for r in got) == 1


def test_decontamination_without_a_benchmark(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    for items in ([], [(None, None), (1, ""), (2, "!!")]):
        out = decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert len(out) == len(odd_rows()) and not any(r.contaminated or r.n_hit or r.n_items for r in out)


def test_scratch_tables_go(spark, tmp_path):
    import os

    from faultgrain.llm.spark_tools import passing, shared_dir

    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    before = set(os.listdir(shared_dir(spark)))
    with passing(spark):
        near_dedup(docs).count()
        line_report(docs).count()
        decontaminate(docs, docs.select(F.col("doc_id").alias("item_id"), "text")).count()
    assert set(os.listdir(shared_dir(spark))) == before


def test_ids_that_are_missing_get_results_of_their_own(spark):
    """Rows without an id are told apart by 62 bits of their texts."""
    texts = [words(i, 40) for i in range(300)] + [words(0, 40)]
    out = substring_dedup(spark.createDataFrame([(None, t, *[None] * 7) for t in texts], SCHEMA)).collect()
    assert sorted(r.kept_text for r in out) == sorted(["", "", *texts[1:300]])
