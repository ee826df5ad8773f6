"""Which tokens of two tokenizers overlap, in each document and over the corpus, by inverted bitmaps of token pairs.

Documents are numbered in chunks. For every pair of overlapping tokens a chunk has a compressed bitmap of the documents that
hold it, and planes of bitmaps, one for each binary digit, of how much more often than once they do. Bitmaps of a
task's batches are merged by OR; their bits are counted and the counts of all chunks added, which gives corpus-wide counts of
documents and links. These go back to the chunks, whose postings turn them into each document's scores.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.llm.spark_tools import Scratch, map_arrow

#: A chunk ends at so many documents, or when its documents hold so many links.
CHUNK_DOCS, CHUNK_LINKS = 4096, 2_000_000
#: A bitmap of more documents is a bit for each of the chunk, else a list: both have 512 bytes then.
DENSE = CHUNK_DOCS // 16
BUCKETS = 256
#: Stretches of text that a worker remembers; beyond it, or eight times as many links, it begins anew.
REMEMBERED = 300_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LOADED: dict[tuple[str, str], Aligner] = {}


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in the entries of a byte-level vocabulary: itself if it shows, else one from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers of a worker, and what is known of stretches of text.

    A text is cut before each space between two characters that aren't white space. No token of either tokenizer spans such a
    place, so both encode stretches as they do within the text, and tokens of both end at each cut.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = {i: bytes(letters[c] for c in w) if all(c in letters for c in w) else w.encode() for w, i in entries.items()}
        self.n_b = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.n_b))]
        self._n_a = max(self.a_bytes) + 1
        self._a_size = np.array([len(self.a_bytes.get(i, b"")) for i in range(self._n_a)], np.int64)
        self._b_size = np.array(list(map(len, self.b_bytes)), np.int64)
        #: each token as it is shown within a group and at the end of its side of it
        self._words = [f"{i}{e}" for i in range(self._n_a) for e in ",|"] + [f"{i}{e}" for i in range(self.n_b) for e in ",;"]
        #: else whole texts are stretches
        self.cuts = not any(" " in p.lstrip(b" ").decode(errors="replace") for p in self.b_bytes)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        #: of each stretch: tokens of a and of b, groups, links (and where they begin), tokens in the order of groups (and where they begin), whether its bytes come back
        self._held = np.zeros((0, 7), np.int64)
        self._pairs, self._shown = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, stretches: list[str]) -> None:
        a = [x.ids for x in self.a.encode_batch([" " + s for s in stretches], add_special_tokens=False)]
        b = self.b.encode(stretches, num_threads=1)
        raw = [(" " + s).encode() for s in stretches]
        same = lambda k: all(b"".join(map(table.__getitem__, ids[k])) == raw[k] for table, ids in ((self.a_bytes, a), (self.b_bytes, b)))
        joined, whole = b"".join(raw), np.ones(len(raw), bool)
        if not all(b"".join([table[i] for ids in x for i in ids]) == joined for table, x in ((self.a_bytes, a), (self.b_bytes, b))):
            whole = np.array([same(k) for k in range(len(raw))], bool)
        ends = np.cumsum(np.where(whole, list(map(len, raw)), 0)) if raw else np.zeros(0, np.int64)
        flat = [np.array([i for k, ids in enumerate(x) if whole[k] for i in ids], np.int64) for x in (a, b)]
        self._add(*flat, ends, whole)
        self.number.update(zip(stretches, range(len(self._held) - len(stretches), len(self._held)), strict=True))

    def _add(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> None:
        """Links and groups of the tokens of stretches whose bytes end at ``ends``; those that aren't whole have no tokens."""
        end_a, end_b = np.cumsum(self._a_size[a]), np.cumsum(self._b_size[b])
        both = np.sort(np.concatenate((end_a, end_b)), kind="stable")
        first = np.diff(both, prepend=-1) > 0
        cuts = both[first]
        common = both[1:][~first[1:]] if len(both) else both
        pairs = a[np.searchsorted(end_a, cuts)] * self.n_b + b[np.searchsorted(end_b, cuts)]
        at = [np.searchsorted(common, e) for e in (end_a, end_b)]
        closes = [common[g] == e for g, e in zip(at, (end_a, end_b), strict=True)]
        shown = np.concatenate((2 * a + closes[0], 2 * (self._n_a + b) + closes[1]))
        shown = shown[np.argsort(np.concatenate((2 * at[0], 2 * at[1] + 1)), kind="stable")]
        n = lambda e: np.diff(np.searchsorted(e, ends, side="right"), prepend=0)
        links, tokens = n(cuts), n(end_a) + n(end_b)
        rows = [n(end_a), n(end_b), n(common), len(self._pairs) + np.cumsum(links) - links, links, len(self._shown) + np.cumsum(tokens) - tokens, whole]
        if len(whole):
            # stretches without bytes end where the one before does
            for r in (0, 1, 2, 4):
                rows[r] = np.where(whole, rows[r], 0)
        self._held = np.concatenate((self._held, np.stack(rows, 1).astype(np.int64)))
        self._pairs, self._shown = np.concatenate((self._pairs, pairs)), np.concatenate((self._shown, shown.astype(np.int32)))

    def stretches(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        parts = text.split(" ")
        return parts if parts == text.split() else _CUT.split(text)

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Rows (n_a, n_b, n_groups, links), the digests of the groups, and the (text, pair) of each link; nothing for a text whose bytes don't come back."""
        parts = [self.stretches(t) if t else [] for t in texts]
        if len(self.number) > REMEMBERED or len(self._pairs) > 8 * REMEMBERED:
            self.forget()
        self.learn(sorted(set().union(*parts).difference(self.number)))
        size = np.array(list(map(len, parts)), np.int64)
        at = np.fromiter((self.number[s] for p in parts for s in p), np.int64, int(size.sum()))
        row = np.repeat(np.arange(len(texts)), size)
        whole = np.ones(len(texts), bool)
        whole[row[self._held[at, 6] == 0]] = False
        at, row = at[whole[row]], row[whole[row]]
        held = self._held[at]
        counts = np.stack([np.bincount(row, held[:, c], len(texts)) for c in (0, 1, 2, 4)], 1).astype(np.int64)
        links = self._pairs[_ranges(held[:, 3], held[:, 4])]
        shown = self._shown[_ranges(held[:, 5], held[:, 0] + held[:, 1])].tolist()
        ends = np.cumsum(counts[:, 0] + counts[:, 1]).tolist()
        digests = [hashlib.sha256("".join(map(self._words.__getitem__, shown[s:e]))[:-1].encode()).hexdigest() if e > s else "" for s, e in zip([0, *ends], ends, strict=False)]
        return counts, digests, np.repeat(row, held[:, 4]), links


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def aligner(a_path: str, b_path: str) -> Aligner:
    """The tokenizers of two files, which are at the same paths on every machine, kept for each Python worker."""
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Aligner(a_path, b_path)
    return _LOADED[a_path, b_path]


# --- bitmaps of the documents 0 .. CHUNK_DOCS - 1 of a chunk, one for each of its pairs


def packed(pair: np.ndarray, doc: np.ndarray, n: int) -> tuple[bytes, bytes, bytes]:
    """(numbers of documents, lists, bits) of n bitmaps, from sorted (bitmap, document) entries."""
    count = np.bincount(pair, minlength=n)
    dense = count > DENSE
    one = dense[pair]
    bits = np.zeros((int(dense.sum()), CHUNK_DOCS), bool)
    bits[(np.cumsum(dense) - 1)[pair[one]], doc[one]] = True
    return count.astype(np.uint16).tobytes(), doc[~one].astype(np.uint16).tobytes(), np.packbits(bits, axis=1).tobytes()


def unpacked(count: bytes, lists: bytes, bits: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The (bitmap, document) entries of packed bitmaps."""
    n = np.frombuffer(count, np.uint16).astype(np.int64)
    sparse = np.where(n > DENSE, 0, n)
    row, doc = np.nonzero(np.unpackbits(np.frombuffer(bits, np.uint8).reshape(-1, CHUNK_DOCS // 8), axis=1))
    pair = np.concatenate((np.repeat(np.arange(len(n)), sparse), np.flatnonzero(n > DENSE)[row]))
    return pair, np.concatenate((np.frombuffer(lists, np.uint16).astype(np.int64), doc))


_BITMAP = pa.struct([("count", pa.binary()), ("lists", pa.binary()), ("bits", pa.binary())])
_PER_DOC = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
_INDEX = "chunk long, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>>, pairs binary, holders struct<count: binary, lists: binary, bits: binary>, planes array<struct<count: binary, lists: binary, bits: binary>>"


def _chunk(number: int, docs: list[tuple], codes: list[np.ndarray]) -> pa.RecordBatch:
    """One chunk's row; codes are pair * CHUNK_DOCS + document for each link."""
    code, times = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_counts=True)
    pairs, at = np.unique(code // CHUNK_DOCS, return_inverse=True)
    doc, more = code % CHUNK_DOCS, times - 1
    plane = lambda on: dict(zip(("count", "lists", "bits"), packed(at[on], doc[on], len(pairs)), strict=True))
    planes = [plane((more >> k) & 1 == 1) for k in range(int(more.max(initial=0)).bit_length())]
    rows = [dict(zip((c for c, _ in _PER_DOC), d, strict=True)) for d in docs]
    columns = [pa.array([number]), pa.array([rows], pa.list_(pa.struct(_PER_DOC))), pa.array([pairs.tobytes()], pa.binary()), pa.array([plane(more >= 0)], _BITMAP), pa.array([planes], pa.list_(_BITMAP))]
    return pa.RecordBatch.from_arrays(columns, ["chunk", "docs", "pairs", "holders", "planes"])


def _indexed(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, most_links: int) -> Iterator[pa.RecordBatch]:
    own = aligner(a_path, b_path)
    number, docs, codes, links = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        i = 0
        while i < len(ids):
            some = []
            while i + len(some) < len(ids) and len(docs) + len(some) < CHUNK_DOCS and sum(map(len, some)) < 1 << 18:
                some.append(texts[i + len(some)].as_py() or "")
            counts, digests, row, pairs = own.align(some)
            codes.append(pairs * CHUNK_DOCS + row + len(docs))
            docs += [(ids[i + k], *n, digest) for k, (n, digest) in enumerate(zip(counts.tolist(), digests, strict=True))]
            links += len(pairs)
            i += len(some)
            if len(docs) == CHUNK_DOCS or links >= most_links:
                yield _chunk(number, docs, codes)
                number, docs, codes, links = number + 1, [], [], 0
    if docs:
        yield _chunk(number, docs, codes)


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n_docs, n_links) of each chunk: the bits of the holders, and those of each plane by its weight."""
    for batch in batches:
        for row in batch.to_pylist():
            pairs, n = np.frombuffer(row["pairs"], np.int64), np.frombuffer(row["holders"]["count"], np.uint16).astype(np.int64)
            links = n.copy()
            for k, plane in enumerate(row["planes"]):
                links += np.frombuffer(plane["count"], np.uint16).astype(np.int64) << k
            for x in range(0, len(pairs), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[x : x + 100_000]) for c in (pairs, n, links)], ["pair", "n_docs", "n_links"])


def _asked(batches: Iterator[pa.RecordBatch], n_b: int) -> Iterator[pa.RecordBatch]:
    """(chunk, bucket, pairs): the pairs of a chunk by the bucket of their first token."""
    for batch in batches:
        for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
            pairs = np.frombuffer(raw, np.int64)
            bucket = pairs // n_b % BUCKETS
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
            some = np.flatnonzero(np.diff(ends))
            parts = [pairs[order[ends[b] : ends[b + 1]]].tobytes() for b in some]
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(some), pa.int64()), pa.array(some.astype(np.int32)), pa.array(parts, pa.binary())], ["chunk", "bucket", "pairs"])


def _block(group: pa.Table, n_b: int) -> pa.Table:
    """One bucket's counts, sorted by pair, and whether each is the highest of its first token."""
    order = np.argsort(group["pair"].to_numpy())
    pairs, n = group["pair"].to_numpy()[order], group["n_docs"].to_numpy()[order]
    first = np.flatnonzero(np.diff(pairs // n_b, prepend=-1))
    best = n == np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(n))))
    return pa.table({"bucket": group["bucket"].slice(0, 1), "known": pa.array([pairs.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary()), "best": pa.array([best.tobytes()], pa.binary())})


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, best = [], []
        for pairs, known, count, top in zip(*(batch.column(c) for c in ("pairs", "known", "n", "best")), strict=True):
            at = np.searchsorted(np.frombuffer(known.as_buffer(), np.int64), np.frombuffer(pairs.as_buffer(), np.int64))
            n.append(np.frombuffer(count.as_buffer(), np.int64)[at].tobytes())
            best.append(np.frombuffer(top.as_buffer(), bool)[at].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("bucket"), pa.array(n, pa.binary()), pa.array(best, pa.binary())], ["chunk", "bucket", "n", "best"])


def _scored(index: pa.Table, answers: pa.Table, n_b: int) -> pa.Table:
    """A chunk's documents with the sums over their postings of the counts of pairs, and of those that are best."""
    row = index.to_pylist()[0]
    pairs, docs = np.frombuffer(row["pairs"], np.int64), row["docs"]
    bucket = pairs // n_b % BUCKETS
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    n, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    for b, count, top in zip(*(answers[c].to_pylist() for c in ("bucket", "n", "best")), strict=True):
        at = order[ends[b] : ends[b + 1]]
        n[at], best[at] = np.frombuffer(count, np.int64), np.frombuffer(top, bool)
    total, tops = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    for weight, plane in [(1, row["holders"]), *((1 << k, p) for k, p in enumerate(row["planes"]))]:
        pair, doc = unpacked(plane["count"], plane["lists"], plane["bits"])
        np.add.at(total, doc, weight * n[pair])
        np.add.at(tops, doc, weight * best[pair])
    columns = {c: pa.array([d[c] for d in docs], kind) for c, kind in _PER_DOC}
    return pa.table({c: columns[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": pa.array(tops), "count_sum": pa.array(total), "groups_sha256": columns["groups_sha256"]})


def _index(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, scratch: Scratch, most_links: int) -> tuple[DataFrame, DataFrame]:
    """The chunks, and (pair, n_docs, n_links) of the whole corpus."""
    pick = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = scratch.written(map_arrow(pick, lambda b: _indexed(b, a_path, b_path, most_links), _INDEX), "chunks", keep=True)
    rows = map_arrow(chunks.select("pairs", "holders", "planes"), _pair_rows, "pair long, n_docs long, n_links long")
    return chunks, rows.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))


def aligned_pairs(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """(a, b, n_docs, n_links, best): every pair of tokens that overlap somewhere, in how many documents and how often.

    ``best``: no other token b overlaps a in more documents. Rows of docs count as documents, also if they repeat; see align_tokens.
    """
    n_b = aligner(a_path, b_path).n_b
    _, pairs = _index(docs, a_path, b_path, id_col, text_col, Scratch(docs.sparkSession), chunk_links)
    pairs = pairs.select(F.expr(f"pair div {n_b}").alias("a"), (F.col("pair") % n_b).alias("b"), "n_docs", "n_links")
    top = pairs.groupBy("a").agg(F.max("n_docs").alias("top"))
    return pairs.join(top, "a").select("a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("top")).alias("best"))


def align_tokens(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    a_path: a byte-level vocabulary of the library tokenizers, given a space and the text; b_path: a model of sentencepiece that
    adds the space itself; special tokens are plain text. Tokens of both whose bytes overlap are linked; a pair's count is the
    number of documents that hold it linked. n_best: links whose count is the highest of their first token's; count_sum: of all
    links' counts. groups_sha256: of the token ids between places where tokens of both end.

    A null or empty text, and one whose bytes don't come back from the tokens (as with U+2581), has zeros and the digest ''. Each row is
    a document, also if rows or ids repeat; an empty table gives no rows; other columns are ignored. A text is encoded in one task,
    in memory proportional to it. Counts of a bucket of tokens meet in one task: at most the pairs of the two vocabularies
    over BUCKETS, whatever the corpus.
    """
    spark, n_b = docs.sparkSession, aligner(a_path, b_path).n_b
    with Scratch(spark) as scratch:
        chunks, pairs = _index(docs, a_path, b_path, id_col, text_col, scratch, chunk_links)
        bucketed = pairs.withColumn("bucket", F.expr(f"pair div {n_b} % {BUCKETS}").cast("int")).select("bucket", "pair", "n_docs")
        blocks = bucketed.groupBy("bucket").applyInArrow(lambda g: _block(g, n_b), "bucket int, known binary, n binary, best binary")
        # a block goes to as many tasks as the chunks that ask for it need
        spread = 1 + chunks.count() // 512
        blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        asked = map_arrow(chunks.select("chunk", "pairs"), lambda b: _asked(b, n_b), "chunk long, bucket int, pairs binary")
        asked = asked.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(spread)).cast("int"))
        answers = map_arrow(asked.join(blocks, ["bucket", "part"]).select("chunk", "pairs", "bucket", "known", "n", "best"), _answered, "chunk long, bucket int, n binary, best binary")
        out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda i, a: _scored(i, a, n_b), out)
