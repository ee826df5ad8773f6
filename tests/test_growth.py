"""Plans and passes of queries whose work has to grow with their input and no faster."""

import numpy as np
import pytest

from faultgrain.operators import models, neighbours, stems, text


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def words(n: int, seed: int = 1) -> list[tuple[int, list[str]]]:
    r = np.random.default_rng(seed)
    return [(i, [f"w{j}" for j in r.integers(0, 40, 12)]) for i in range(n)]


@pytest.fixture(scope="module")
def tokens(spark):
    return spark.createDataFrame(words(300), "doc_id long, tokens array<string>").repartition(3)


def test_pairs_meet_in_tiles_and_not_by_term(spark, tokens):
    """All texts share frequent terms: met by term, a pair would come up for each."""
    weights = text.tfidf(tokens).localCheckpoint()
    found = text.pairwise_similarity(weights, least=0.5, block=64)
    assert "Join" not in plan(found)
    bags = {}
    for r in weights.collect():
        bags.setdefault(r.doc_id, np.zeros(40))[int(r.term[1:])] = r.weight
    m = np.stack([bags[i] for i in range(300)])
    a, b = np.nonzero(np.triu(np.round(m @ m.T, 9) >= 0.5, 1))
    got = {(r.a, r.b): r.similarity for r in found.collect()}
    assert got.keys() == set(zip(a.tolist(), b.tolist(), strict=True)) and len(got) == found.count()
    assert all(abs(s - m[i] @ m[j]) < 1e-9 for (i, j), s in got.items())


def test_texts_of_pairs_travel_a_bounded_number_of_times(spark):
    """Each text went to a tile with each 2048 others, as words and not as numbers: what travels grew with the square of the texts."""
    rows = spark.range(24000).selectExpr("id AS doc_id", "explode(map(concat('own', id), 0.6D, concat('common', id % 50), 0.8D)) AS (term, weight)")
    weights = rows.unionByName(spark.createDataFrame([(24001, "own7", 0.6), (24001, "common7", 0.8)], rows.schema)).localCheckpoint()
    written = lambda: spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    got = text.pairwise_similarity(weights, least=0.7).collect()
    assert [(x.a, x.b, round(x.similarity, 9)) for x in got] == [(7, 24001, 1.0)]
    assert written() - before < 4e6


def test_every_two_texts_meet_once(spark):
    """On planes over several primes: equal texts make all pairs, each once; a text whose rows are dealt over many tasks is one."""
    weights = spark.createDataFrame([(i, t, w) for i in range(70) for t, w in (("x", 0.6), ("y", 0.8))], "doc_id long, term string, weight double").repartition(7)
    for block in (5, 20, 1000):
        got = [(x.a, x.b) for x in text.pairwise_similarity(weights, least=0.99, block=block).collect()]
        assert len(got) == len(set(got)) == 70 * 69 // 2 and all(a < b for a, b in got)


def test_pairs_of_texts_in_several_languages(spark):
    """Texts whose terms are of one language, of two, or single words; pairs right at the bound, many vocabularies wide: the same as from one product of matrices."""
    r = np.random.default_rng(4)
    for many in (60, 3000):
        m = np.zeros((900, 5 * many))
        for i in range(900):
            for language in r.choice(5, r.choice([1, 1, 1, 2]), replace=False):
                at = language * many + np.minimum(r.pareto(0.6, r.choice([1, 3, 40])).astype(int), many - 1)
                m[i, at] += r.integers(1, 9, len(at))
        m[:4] = 0
        m[:4, :5] = [[1, 0, 0, 0, 0], [3, 4, 0, 0, 0], [3, 0, 4, 0, 0], [0, 0, 3, 4, 0]]  # 0.6, 0.6 and 0.36, 0.48
        m /= np.linalg.norm(m, axis=1)[:, None]
        weights = spark.createDataFrame([(int(i), f"t{j}", float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "doc_id long, term string, weight double")
        a, b = np.nonzero(np.triu(np.round(m @ m.T, 9) >= 0.6, 1))
        got = {(x.a, x.b): x.similarity for x in text.pairwise_similarity(weights, least=0.6).collect()}
        assert {(0, 1), (0, 2)} <= got.keys() == set(zip(a.tolist(), b.tolist(), strict=True))
        assert all(abs(s - m[i] @ m[j]) < 1e-12 for (i, j), s in got.items())


def test_isotonic_lines_use_frames_that_only_grow(spark):
    """A frame that ends with the last row is summed anew for each row of a range."""
    rows = spark.range(400).selectExpr("id", "(id * 37 % 101) / 100.0D AS score", "CAST(id % 3 = 0 AS INT) AS label")
    found = models.isotonic_transform(rows, models.isotonic_steps(rows, ranges=4))
    assert "unboundedfollowing" not in plan(found).lower()
    assert found.count() == 400 and found.where("calibrated IS NULL").count() == 0


def test_terms_are_counted_where_the_texts_are(spark, tokens):
    """No row a token is dealt by term or text; texts whose key repeats are one."""
    assert "explode" not in plan(text.tfidf(tokens)) and "Exchange hashpartitioning" not in plan(text.tfidf(tokens))
    twice = spark.createDataFrame([(1, ["a", "b"]), (1, ["a"]), (2, ["b"]), (3, None)], "doc_id long, tokens array<string>")
    assert {(r.term, r.cf, r.df) for r in text.vocabulary(twice).collect()} == {("a", 2, 1), ("b", 2, 2)}
    assert sorted((r.doc_id, r.term) for r in text.tfidf(twice).collect()) == [(1, "a"), (1, "b"), (2, "b")]


def test_stems_are_found_without_a_shuffle(spark, tokens):
    assert "Join" not in plan(stems.stem_tokens(tokens))
    few = spark.createDataFrame([(1, ["cats", "running", "cats"]), (2, None)], "doc_id long, tokens array<string>")
    assert {r.doc_id: r.stems for r in stems.stem_tokens(few).collect()} == {1: ["cat", "run", "cat"], 2: []}


ODD = ["The cat's HAT, the hat_2!", None, "", "the of", "\u2003é1—É1\u00a0x\tthe\nnaïve ², 中文。字 x x", "İstanbul ΣΑΣ don't running-late __ 3.14", " , ", "running, running. RUNNING"]


def test_texts_are_cut_into_tokens_where_they_are_counted(spark):
    """Row by row, an array of tokens takes most of the time; the tokens are those of tokenize, also where keys repeat."""
    texts = spark.createDataFrame(list(enumerate(ODD * 3)), "doc_id long, text string")
    assert "regexp_extract_all" not in plan(text.tfidf(texts, text="text")) + plan(stems.stem_tokens(texts, text="text")) + plan(text.vocabulary(texts, text="text"))
    for rows in (texts, texts.unionByName(texts.limit(5)), texts.limit(0)):
        tokenized = text.tokenize(rows)
        for f in (text.tfidf, text.vocabulary, stems.stem_tokens):
            assert sorted(map(tuple, f(rows, text="text").collect())) == sorted(map(tuple, f(tokenized).collect()))
    got = {r.doc_id: r.stems for r in stems.stem_tokens(texts, text="text").collect()}
    assert got[0] == ["cat", "s", "hat", "hat_2"] and got[1] == got[2] == got[3] == [] and got[7] == ["run", "run", "run"]


def test_texts_are_scored_where_they_are(spark):
    """Only the best of each task travel, no postings: the same as from postings dealt by term, ties, many batches, repeated ids and all."""
    r = np.random.default_rng(5)
    word = lambda: f"w{min(int(r.pareto(0.7)), 400)}"
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(r.integers(0, 60)))) for i in range(1500)] + [(1500 + i, "w3 w7 w9") for i in range(40)] + [(1600, None)], "doc_id long, text string").repartition(2)
    asked = spark.createDataFrame([(f"q{i}", " ".join(word() for _ in range(r.integers(1, 25)))) for i in range(40)] + [("ties", "w3 w7 w9"), ("none", "unheard of"), ("null", None), ("the", "the")], "query_id string, text string")
    found = text.bm25_search(docs, asked, top_k=4, text="text")
    assert "regexp_extract_all" not in plan(found) and "SortMergeJoin" not in plan(found) and "Exchange hashpartitioning(term" not in plan(found)
    rows = lambda df: sorted((x.query_id, x["rank"], x.doc_id, round(x.score, 7)) for x in df.collect())
    got = rows(found)
    a, b = text.tokenize(docs), text.tokenize(asked)
    assert got == rows(text.bm25_search(a, b, top_k=4)) and {x[0] for x in got} == {f"q{i}" for i in range(40)} | {"ties"}
    dealt = {(x.query_id, x.doc_id): x.raw for x in text._dealt(a, b, 4, 1.2, 0.75).collect()}
    best = {q: sorted((-raw, d) for (p, d), raw in dealt.items() if p == q)[:4] for q in {q for q, _ in dealt}}
    assert got == sorted((q, k + 1, d, round(raw / top[0][0], 7)) for q, top in best.items() for k, (raw, d) in enumerate(top))
    twice = docs.unionByName(docs.where("doc_id < 9"))  # an id that repeats: both texts count, from postings dealt by term
    assert len(rows(text.bm25_search(twice, asked, top_k=4, text="text"))) == len(got)
    assert text.bm25_search(docs.limit(0), asked, text="text").count() == text.bm25_search(docs, asked.limit(0), text="text").count() == 0


def test_a_caller_without_stop_words_keeps_all(spark):
    rows = spark.createDataFrame([(1, "The end of it")], "doc_id long, text string")
    assert text.tokenize(rows, stop_words=[]).first().tokens == ["the", "end", "of", "it"]
    assert text.tokenize(rows, stop_words=["end"]).first().tokens == ["the", "of", "it"]


def test_distances_of_near_points_keep_their_digits():
    """A product of matrices alone loses them: equal points far out would lie apart."""
    x = np.random.default_rng(2).normal(0, 1, (50, 8)) + 1e6
    d = neighbours._distances(x, x)
    assert (np.diag(d) == 0).all()
    assert np.allclose(d, np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), rtol=1e-9)


def test_rounds_read_rows_of_unclear_ranges_alone(spark):
    rows = spark.range(5000).selectExpr("id", "CAST(id * 7919 % 5000 AS DOUBLE) AS x", "CAST(id % 3 AS DOUBLE) AS y")
    ranges = neighbours._Ranges(rows, ["x", "y"])
    own = ranges.nearest([(500.0, 1.0), (4500.0, 1.0)])
    assert sum(ranges.n) == 5000 and 0 < sum(n for c, n in zip(own, ranges.n, strict=True) if c is None) < 100
    assert {c for c in own if c is not None} == {0, 1}
