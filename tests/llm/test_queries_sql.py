"""Each query with SQL against it, and the others against plain code, over whole small tables."""

import glob
import os
import zlib

import duckdb
import pytest

from faultgrain.llm import queries as Q
from plain import components, contaminated, kept_lines, sha

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, other, name):
    df = Q.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    want = sorted(map(repr, other.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({Q.oracle_sql()[name]})").fetchall()))
    assert got == want


def texts(spark, name: str = "documents", key: str = "doc_id") -> list[tuple]:
    return [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/{name}.parquet").select(key, "text").collect()]


def test_shards_of_the_whole_table(spark):
    got = {r.doc_id: r for r in Q.op7_sharding(spark, DATA).collect()}
    rows = texts(spark)
    assert sorted(got) == sorted(d for d, _ in rows)
    load, slots = [0] * 16, [[] for _ in range(16)]
    for d, t in rows:
        raw = (t or "").encode()
        assert (got[d]["size"], got[d].text_crc32, got[d].law, got[d].grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        load[got[d].shard] += len(raw) + 1
        slots[got[d].shard].append(got[d].slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    # near equal, as far as the longest document allows
    assert max(load) - min(load) <= max(len((t or "").encode()) for _, t in rows) + 1
    versions = {r.map_version for r in got.values()}
    assert len(versions) == 1 and min(versions) >= 2  # an even map first, then edited


def test_pieces_of_the_whole_table(spark):
    import numpy as np
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=Q.model_path())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op10_sentencepiece(spark, DATA).collect()}
    for d, t in texts(spark):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[d] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids)))


def test_lines_components_and_contamination_equal_plain_code(spark):
    rows = texts(spark)
    kept = kept_lines(rows)
    assert {r.doc_id: r.kept_sha256 for r in Q.op4_line_dedup(spark, DATA).collect()} == {d: sha(t or "") for d, t in kept.items()}
    assert {r.doc_id: r.component_id for r in Q.op8_near_dedup(spark, DATA).collect()} == components(rows)
    want = contaminated(rows, texts(spark, "benchmark", "item_id"))
    assert {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in Q.op3_decontamination(spark, DATA).collect()} == want


def test_pipeline_equals_plain_stages(spark):
    """All but the language classifier, whose predictions are taken from its query, in plain code and the library."""
    import corpus_pipeline as P
    import numpy as np
    import sentencepiece

    sure = {r.doc_id for r in Q.op9_language_id(spark, DATA).collect() if r.lang_pred != "und" and r.score >= P.LEAST_SCORE}
    left = kept_lines([(d, t) for d, t in texts(spark) if d in sure])
    part = components(list(left.items()))
    left = {d: t for d, t in left.items() if part[d] == d}
    bad = contaminated(list(left.items()), texts(spark, "benchmark", "item_id"))
    library = sentencepiece.SentencePieceProcessor(model_file=Q.model_path())
    want = {}
    for d, t in left.items():
        if not bad[d][2]:
            ids = library.encode(t or "", add_bos=True, add_eos=True)
            want[d] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.run(spark, DATA).collect()}
    assert got == want and len(got) > 100
