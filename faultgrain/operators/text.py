"""Word features of texts: tokens, n-grams, vocabulary, TF-IDF and BM25."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from faultgrain.sources.scratch import checkpointed, stored

#: Words that carry no topic; a caller's list replaces it.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]
WORD = r"[\p{L}\p{N}_]+"
_BETWEEN = r"[^\p{L}\p{N}_]+"


def tokenize(df: DataFrame, *, text: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """Adds tokens: the lower-cased words of a text that aren't stop words; none where the text is null."""
    words = F.regexp_extract_all(lower(text), F.lit(WORD), F.lit(0))
    stop = STOP_WORDS if stop_words is None else stop_words
    return df.withColumn("tokens", F.filter(words, lambda w: ~w.isin(stop)))  # a set, where there are more than ten


def lower(text: str) -> Column:
    """The text in lower case; empty where it is null."""
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def ngrams(tokenized: DataFrame, *, n: int = 2) -> DataFrame:
    """Adds ngrams: each run of n tokens, joined by "_"; none in shorter texts."""
    if n < 1:
        raise ValueError("n must be at least 1")
    many = F.size("tokens") >= n
    starts = F.sequence(F.lit(1), F.greatest(F.size("tokens") - (n - 1), F.lit(1)))
    grams = F.transform(starts, lambda i: F.array_join(F.slice("tokens", i, n), "_"))
    return tokenized.withColumn("ngrams", F.when(many, grams).otherwise(F.array().cast("array<string>")))


def one_row_each(rows: DataFrame, key: str, text: str | None = None) -> DataFrame:
    """(key, tokens): the rows as they are, or, where a key repeats, with the tokens of all its rows put together.

    With ``text``, texts of their own keys stay whole, in lower case, as (key, text): they are cut into tokens where they are read.
    """
    if rows.groupBy(key).count().where("count > 1").isEmpty():
        return rows.select(key, "tokens" if text is None else lower(text).alias("text"))
    tokenized = rows if text is None else tokenize(rows, text=text)
    return tokenized.groupBy(key).agg(F.flatten(F.collect_list("tokens")).alias("tokens"))


_STOP = pa.array([*STOP_WORDS, ""])


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bound what the numbers of their tokens take."""
    for batch in batches:
        yield from (batch.slice(at, rows) for at in range(0, len(batch), rows))


def coded(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(terms, row, term) of a batch's tokens, in order, or of its lower-cased texts: numbers are places in the batch and in terms.

    A text's pieces between blanks are told apart first, and each distinct one of the batch is cut into the tokens that ``tokenize`` finds once.
    """
    whole = "tokens" not in batch.schema.names
    lists = pc.utf8_split_whitespace(batch.column("text")) if whole else batch.column("tokens")
    row = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    encoded = lists.flatten().dictionary_encode()
    if not whole:
        some = encoded.is_valid().to_numpy(zero_copy_only=False)
        return encoded.dictionary, row[some], pc.drop_null(encoded.indices).to_numpy()
    words = pc.split_pattern_regex(encoded.dictionary, _BETWEEN)
    piece, word = pc.list_parent_indices(words), words.flatten()
    kept = pc.invert(pc.is_in(word, value_set=_STOP.cast(word.type)))
    word = word.filter(kept).dictionary_encode()
    n = np.bincount(piece.filter(kept).to_numpy(), minlength=len(words))  # tokens of each piece
    at = encoded.indices.to_numpy()
    own = n[at]
    place = np.arange(own.sum()) + np.repeat((np.cumsum(n) - n)[at] - (np.cumsum(own) - own), own)
    return word.dictionary, np.repeat(row, own), word.indices.to_numpy()[place]


def counted(batch: pa.RecordBatch, known: pa.Array | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, row, term, tf, length) of a batch: how often each row has each of its terms, of the known ones if given, and each row's number of tokens."""
    terms, row, term = coded(batch)
    length = np.bincount(row, minlength=len(batch))
    if known is not None:
        term = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy()[term]
        row, term, terms = row[term >= 0], term[term >= 0], known
    codes, tf = np.unique(row * max(len(terms), 1) + term, return_counts=True)
    return terms, *np.divmod(codes, max(len(terms), 1)), tf, length


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, cf, df) of each batch."""
    for batch in sliced(batches):
        terms, _, term, tf, _ = counted(batch)
        cf, df = np.bincount(term, tf, len(terms)).astype(np.int64), np.bincount(term, minlength=len(terms))
        some = pa.array(df > 0)
        yield pa.RecordBatch.from_arrays([terms.filter(some), pa.array(cf).filter(some), pa.array(df).filter(some)], ["term", "cf", "df"])


def _weights(batches: Iterator[pa.RecordBatch], key: str, terms: pa.Array, idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        _, row, term, tf, _ = counted(batch, terms)
        raw = tf * idf[term]
        norm = np.sqrt(np.bincount(row, raw * raw, len(batch)))
        yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), terms.take(pa.array(term)), pa.array(raw / norm[row])], [key, "term", "weight"])


def _vocabulary(whole: DataFrame, max_features: int) -> DataFrame:
    parts = whole.select(whole.columns[-1]).mapInArrow(_terms, "term string, cf long, df long")
    return parts.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df")).orderBy(F.desc("cf"), "term").limit(max_features)


def vocabulary(rows: DataFrame, *, max_features: int = 1000, key: str = "doc_id", text: str | None = None) -> DataFrame:
    """The max_features most frequent terms with cf (occurrences) and df (texts) of tokens, or of the column ``text``; ties by term."""
    return _vocabulary(one_row_each(rows, key, text), max_features)


def tfidf(rows: DataFrame, *, max_features: int = 1000, key: str = "doc_id", text: str | None = None) -> DataFrame:
    """(key, term, weight): tf * (ln((1 + N) / (1 + df)) + 1), each text's vector of length 1, over the top terms.

    Terms are counted where the texts are: a text's tokens are never dealt by term or text. The vocabulary is all that is gathered and sent to the workers.
    Rows hold tokens, or whole texts in the column ``text``, which is faster, as each distinct piece of a batch's texts is cut into tokens once.
    """
    whole, total = one_row_each(rows, key, text), rows.count()
    kept = _vocabulary(whole, max_features).collect()  # max_features rows
    terms, idf = pa.array([r.term for r in kept], pa.string()), np.log((1 + total) / (1 + np.array([r.df for r in kept], float))) + 1
    kind = whole.schema[key].dataType.simpleString()
    return whole.mapInArrow(lambda b: _weights(b, key, terms, idf), f"`{key}` {kind}, term string, weight double")


#: Asked terms that are sent to all texts at most.
MOST_ASKED = 200_000
#: What two sums of the same parts may differ by.
_SLACK = 1e-8


def _postings(batches: Iterator[pa.RecordBatch], known: pa.Array | None) -> Iterator[pa.RecordBatch]:
    """(doc_id, length, term, tf): a row for each of a text's known terms, all if none are given, and one without term for the text itself."""
    for batch in sliced(batches):
        terms, row, term, tf, length = counted(batch, known)
        length = pa.array(length, pa.int32())
        for rows, *rest in ((pa.array(np.arange(len(batch))), pa.nulls(len(batch), pa.string()), pa.nulls(len(batch), pa.int64())), (pa.array(row), terms.take(pa.array(term)), pa.array(tf, pa.int64()))):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), length.take(rows), *rest], ["doc_id", "length", "term", "tf"])


class _Bm25:
    """Postings of the asked terms with their parts of a score, and which terms of each query have to be read in full.

    No posting of a term says more than the term's greatest part. A query's k-th best score is at least the k-th best that its rarest terms give alone; terms
    whose greatest parts, from the least on, sum to less than that can't bring a text among the top k by themselves (they are light).
    """

    def __init__(self, docs: DataFrame, queries: DataFrame, top_k: int, k1: float, b: float):
        asked = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("term"))
        few = asked.limit(MOST_ASKED + 1).count() <= MOST_ASKED
        self.sent = F.broadcast if few else lambda rows: rows
        terms = pa.array([r.term for r in asked.select("term").distinct().collect()], pa.string()) if few else None
        kind = docs.schema["doc_id"].dataType.simpleString()
        read = stored(docs.select("doc_id", "tokens").mapInArrow(lambda b: _postings(b, terms), f"doc_id {kind}, length int, term string, tf long"))
        corpus = read.where("tf IS NULL").agg(F.count(F.lit(1)).alias("total"), F.avg("length").alias("mean"))
        postings = read.where("tf IS NOT NULL") if few else read.where("tf IS NOT NULL").join(asked.select("term").distinct(), "term", "left_semi")
        if not read.where("tf IS NULL").groupBy("doc_id", "length").count().where("count > 1").isEmpty():  # rows that can't be told apart are one text
            postings = stored(postings.groupBy("term", "doc_id", "length").agg(F.sum("tf").alias("tf")))
        df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weighed = postings.join(self.sent(df), "term").join(F.broadcast(corpus))  # one row
        idf = F.ln(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
        self.parts = stored(weighed.select("term", "doc_id", part.alias("part")))
        known = self.parts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("most"))
        terms = checkpointed(asked.join(self.sent(known), "term"))
        rarest = Window.partitionBy("query_id").orderBy("df", "term")
        before = F.coalesce(F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        first = self.scores(terms.withColumn("before", before).where(F.col("before") < 4 * top_k))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw"), "doc_id"))
        reached = first.withColumn("place", place).where(F.col("place") == top_k).select("query_id", F.col("raw").alias("reached"))
        upto = F.sum("most").over(Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
        light = upto < F.coalesce("reached", F.lit(0.0)) - _SLACK
        self.terms = checkpointed(terms.join(self.sent(reached), "query_id", "left").withColumn("light", light))

    def scores(self, terms: DataFrame) -> DataFrame:
        """(query_id, doc_id, raw) from all postings of some of the queries' terms."""
        rows = self.parts.join(self.sent(terms.select("query_id", "term")), "term")
        return rows.groupBy("query_id", "doc_id").agg(F.sum("part").alias("raw"))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, term): the distinct terms of each query."""
    for batch in sliced(batches):
        terms, row, term, _, _ = counted(batch)
        yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(row)), terms.take(pa.array(term))], ["query_id", "term"])


def _asked_counts(batches: Iterator[pa.RecordBatch], terms: pa.Array) -> Iterator[pa.RecordBatch]:
    """(term, df, tf, length) of each asked term: its texts, its most occurrences in one and the least length of one. And a row without term: texts, those with tokens, their lengths."""
    for batch in sliced(batches):
        _, row, term, tf, length = counted(batch, terms)
        df, most, least = np.bincount(term, minlength=len(terms)), np.zeros(len(terms), int), np.full(len(terms), 1 << 62)
        np.maximum.at(most, term, tf)
        np.minimum.at(least, term, length[row])
        some = np.flatnonzero(df)
        numbers = ((df, len(batch)), (most, len(batch) - batch.column(batch.num_columns - 1).null_count), (least, length.sum()))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([terms.take(pa.array(some)), pa.nulls(1, terms.type)]), *(pa.array([*x[some], all_], pa.int64()) for x, all_ in numbers)], ["term", "df", "tf", "length"])


class _Scorer:
    """Scores texts against all queries, batch by batch, and keeps the ``top_k`` of each query.

    No posting of a term says more than its bound. Terms whose bounds, from the least on, sum to less than a query's k-th best score so far can't bring a text
    among the top k by themselves (they are light): they are looked up only for texts that still can get there with the others.
    """

    def __init__(self, terms: pa.Array, asked: tuple[np.ndarray, np.ndarray], ids: pa.Array, idf: np.ndarray, bound: np.ndarray, mean: float, top_k: int, k1: float, b: float):
        order = np.lexsort((bound[asked[1]], asked[0]))
        self.terms, self.ids, self.idf, self.bound, self.mean, self.top_k, self.k1, self.b = terms, ids, idf, bound, mean, top_k, k1, b
        self.query, self.term = (x[order] for x in asked)  # by query and rising bound
        self.start = np.searchsorted(self.query, np.arange(len(ids) + 1))
        summed = np.concatenate([[0.0], np.cumsum(bound[self.term])])
        self.upto = summed[1:] - summed[self.start[self.query]]

    def top(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, reached = None, np.full(len(self.ids), -np.inf)
        for batch in sliced(batches, max(1, min(512, 2_000_000 // max(1, len(self.ids))))):
            row, query, raw = self.scored(batch, reached)
            new = pa.table({"query": pa.array(query, pa.int64()), "doc_id": batch.column("doc_id").take(pa.array(row)), "raw": pa.array(raw, pa.float64())})
            found = new if found is None else pa.concat_tables([found, new])
            found = found.sort_by([("query", "ascending"), ("raw", "descending"), ("doc_id", "ascending")])
            query = found["query"].to_numpy()
            place = np.arange(len(query)) - np.searchsorted(query, query)
            last = place == self.top_k - 1
            reached[query[last]] = found["raw"].to_numpy()[last]
            found = found.filter(pa.array(place < self.top_k))
        if found is not None:
            out = pa.table({"query_id": self.ids.take(found["query"].combine_chunks()), "doc_id": found["doc_id"], "raw": found["raw"]})
            yield from out.combine_chunks().to_batches()

    def scored(self, batch: pa.RecordBatch, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, query, raw) of the texts that may be among the top k of a query, which have reached so much."""
        _, row, term, tf, length = counted(batch, self.terms)
        part = self.idf[term] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length[row] / self.mean))
        light = self.upto < reached[self.query] - _SLACK
        n_light = np.bincount(self.query[light], minlength=len(self.ids))  # the first of each query
        rest = np.where(n_light > 0, self.upto[np.minimum(self.start[:-1] + np.maximum(n_light, 1) - 1, len(self.upto) - 1)], 0.0)
        by = np.argsort(self.term[~light], kind="stable")
        of, n = self.query[~light][by], np.bincount(self.term[~light], minlength=len(self.terms))
        raw = np.zeros(len(batch) * len(self.ids))
        for at in range(0, len(row), 1 << 16):
            here = slice(at, at + (1 << 16))
            own = n[term[here]]
            entry = np.arange(own.sum()) + np.repeat((np.cumsum(n) - n)[term[here]] - (np.cumsum(own) - own), own)
            raw += np.bincount(np.repeat(row[here], own) * len(self.ids) + of[entry], np.repeat(part[here], own), len(raw))
        cell = np.flatnonzero(raw)
        cell = cell[raw[cell] + rest[cell % len(self.ids)] >= reached[cell % len(self.ids)] - _SLACK]
        own_row, query = np.divmod(cell, len(self.ids))
        raw, more = raw[cell], n_light[query]
        entry = np.arange(more.sum()) + np.repeat(self.start[query] - (np.cumsum(more) - more), more)
        codes, wanted = row * len(self.terms) + term, np.repeat(own_row, more) * len(self.terms) + self.term[entry]
        place = np.minimum(np.searchsorted(codes, wanted), max(len(codes) - 1, 0))
        if len(codes):
            raw += np.bincount(np.repeat(np.arange(len(cell)), more), np.where(codes[place] == wanted, part[place], 0.0), len(cell))
        raw = np.round(raw, 9)
        kept = raw >= reached[query]
        return own_row[kept], query[kept], raw[kept]


def bm25_search(docs: DataFrame, queries: DataFrame, *, top_k: int = 5, k1: float = 1.2, b: float = 0.75, text: str | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the top_k texts of each query by BM25 over the query's distinct terms, ties by doc_id.

    Scores are divided by the query's greatest. Both sides hold tokens, or whole texts in the column ``text``. Up to MOST_ASKED asked terms, counted first, are
    sent to the texts: a pass counts the texts of each, and another scores texts where they are, so that only the top k of each task travel. Frequent
    terms, which can't bring a text among the top k, are looked up only for texts that still can get there. With more asked terms, and where
    ids of texts are null or repeat, postings are dealt by term and looked up by (term, text). The result is exact.
    """
    single = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty()
    read = lambda rows, key: rows.select(key, "tokens" if text is None else lower(text).alias("text"))
    kind = {key: rows.schema[key].dataType.simpleString() for key, rows in (("query_id", queries), ("doc_id", docs))}
    asked = read(queries.where("query_id IS NOT NULL"), "query_id").mapInArrow(_asked, f"query_id {kind['query_id']}, term string").limit(MOST_ASKED + 1).toArrow().combine_chunks()
    if not single or len(asked) > MOST_ASKED:
        scored = _dealt(*(rows if text is None else tokenize(rows, text=text) for rows in (docs, queries)), top_k, k1, b)
    else:
        scored = _scored_in_place(read(docs, "doc_id"), asked, kind, top_k, k1, b)
    best = Window.partitionBy("query_id").orderBy(F.desc("raw"), "doc_id")
    top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
    return top.withColumn("score", F.col("raw") / F.max("raw").over(Window.partitionBy("query_id"))).drop("raw")


def _scored_in_place(docs: DataFrame, asked: pa.Table, kind: dict[str, str], top_k: int, k1: float, b: float) -> DataFrame:
    """(query_id, doc_id, raw): the top_k texts of each task for each query. asked: (query_id, term), MOST_ASKED rows at most."""
    ids, terms = (asked[c].combine_chunks().dictionary_encode() if len(asked) else asked[c].combine_chunks() for c in ("query_id", "term"))
    schema = f"query_id {kind['query_id']}, doc_id {kind['doc_id']}, raw double"
    if not len(asked):
        return docs.sparkSession.createDataFrame([], schema)
    known = terms.dictionary
    counts = docs.select(docs.columns[-1]).mapInArrow(lambda x: _asked_counts(x, known), "term string, df long, tf long, length long").groupBy("term")
    rows = counts.agg(F.sum("df").alias("df"), F.max("tf").alias("most"), F.min("length").alias("least"), F.sum("tf").alias("texts"), F.sum("length").alias("length")).collect()  # one for each asked term
    corpus = next((r for r in rows if r.term is None), None)
    if corpus is None or not corpus.length:
        return docs.sparkSession.createDataFrame([], schema)
    of, mean = {r.term: r for r in rows}, corpus.length / corpus.texts
    df, tf, least = (np.array([getattr(of[t], c) if t in of else 0 for t in known.to_pylist()], float) for c in ("df", "most", "least"))
    idf = np.log(1 + (corpus.df - df + 0.5) / (df + 0.5))
    bound = np.where(df > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * least / mean)), 0.0)
    scorer = _Scorer(known, (ids.indices.to_numpy(), terms.indices.to_numpy()), ids.dictionary, idf, bound, mean, top_k, k1, b)
    return docs.mapInArrow(scorer.top, schema)


def _dealt(docs: DataFrame, queries: DataFrame, top_k: int, k1: float, b: float) -> DataFrame:
    """(query_id, doc_id, raw) of the texts that may be among the top k, from postings dealt by term."""
    own = _Bm25(docs, queries, top_k, k1, b)
    rest = own.terms.groupBy("query_id").agg(F.sum(F.when(F.col("light"), F.col("most")).otherwise(0.0)).alias("rest"), F.coalesce(F.max("reached"), F.lit(0.0)).alias("reached"))
    heavy = own.scores(own.terms.where("NOT light")).join(own.sent(rest), "query_id")
    heavy = checkpointed(heavy.where(F.col("raw") + F.col("rest") >= F.col("reached") - _SLACK).select("query_id", "doc_id", "raw"))
    light = heavy.select("query_id", "doc_id").join(own.sent(own.terms.where("light").select("query_id", "term")), "query_id")
    more = light.join(own.parts, ["term", "doc_id"]).select("query_id", "doc_id", F.col("part").alias("raw"))
    return heavy.unionByName(more).groupBy("query_id", "doc_id").agg(F.round(F.sum("raw"), 9).alias("raw"))


def bm25_reading(docs: DataFrame, queries: DataFrame, *, top_k: int = 5, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, postings, read, share): postings of each query's terms, and those that are scored without looking at the text first where they are dealt by term."""
    terms = _Bm25(docs, queries, top_k, k1, b).terms
    read = F.sum(F.when(~F.col("light"), F.col("df")).otherwise(0))
    return terms.groupBy("query_id").agg(F.sum("df").alias("postings"), read.alias("read"), (read / F.sum("df")).alias("share"))


def project_2d(weights: DataFrame, total: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, x, y): weights of the two terms whose weight varies most, scaled to -1..1; ties by term.

    weights: (key, term, weight), a term that a text lacks weighing 0; total: one row, n texts. Ranges below 0.001 count as
    0.001. Texts without any weight are left out.
    """
    w, weights = F.col("weight"), stored(weights)
    sums = weights.groupBy("term").agg(F.sum(w).alias("s"), F.sum(w * w).alias("q"), F.min(w).alias("low"), F.max(w).alias("high"), F.count(F.lit(1)).alias("in"))
    rows = sums.join(F.broadcast(total))  # one row
    variance = F.round(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), 12)
    low = F.when(F.col("in") < F.col("n"), F.least("low", F.lit(0.0))).otherwise(F.col("low"))
    high = F.when(F.col("in") < F.col("n"), F.greatest("high", F.lit(0.0))).otherwise(F.col("high"))
    two = rows.select("term", low.alias("low"), F.greatest(high - low, F.lit(0.001)).alias("range"), variance.alias("variance")).orderBy(F.desc("variance"), "term").limit(2)
    two = two.withColumn("axis", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("variance"), "term")))  # two rows
    ends = two.agg(*(F.max(F.when(F.col("axis") == a, F.col(c))).alias(f"{c}{a}") for a in (1, 2) for c in ("term", "low", "range")))
    place = lambda a: F.max(F.when(F.col("term") == F.col(f"term{a}"), w)).alias(f"w{a}")
    some = weights.join(F.broadcast(ends.select("term1", "term2"))).groupBy(key).agg(place(1), place(2))  # one row
    scaled = lambda a: (F.coalesce(f"w{a}", F.lit(0.0)) - F.col(f"low{a}")) / F.col(f"range{a}") * 2 - 1
    return some.join(F.broadcast(ends)).select(key, scaled(1).alias("x"), scaled(2).alias("y"))  # one row


#: Terms whose weights are laid out at a time, and texts on both sides of a product.
_WIDE, _HIGH, _ACROSS = 4096, 512, 2048
#: Groups of terms by which pairs are ruled out, and texts that the groups are drawn from. Of a product, the share of pairs up to which each is multiplied by itself.
_GROUPS, _DRAWN, _FEW = 16, 2048, 0.02
#: Weights that are packed at a time, and texts of a pack, whose numbers are 16 bits long.
_PACKED, _NUMBERED = 1 << 19, 1 << 15


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block's weights, ordered by term: its texts, its terms, how many weights each term has, and the weights with the numbers of their texts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= _PACKED:
            yield from _packed(pa.Table.from_batches(held))
            held = []
    if held:
        yield from _packed(pa.Table.from_batches(held))


def _packed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    keys, terms = (rows[c].combine_chunks().dictionary_encode() for c in ("fg_key", "term"))
    text, term, weight = keys.indices.to_numpy(), terms.indices.to_numpy(), rows["weight"].to_numpy()
    block = np.zeros(len(keys.dictionary), np.int64)
    block[text] = rows["fg_block"].to_numpy()
    by_block = np.argsort(block, kind="stable")
    number = np.empty(len(block), np.int64)
    number[by_block] = np.arange(len(block)) - np.searchsorted(block[by_block], block[by_block])
    pack = block * (1 + len(block) // _NUMBERED) + number // _NUMBERED  # of each text
    order = np.lexsort((number[text], term, pack[text]))
    text, term, weight = text[order], term[order], weight[order]
    ends = np.flatnonzero(np.append(np.diff(pack[text]) != 0, True)) + 1
    for first, end in zip(np.append(0, ends[:-1]), ends, strict=True):
        its, counts = np.unique(term[first:end], return_counts=True)
        of, place = np.unique(text[first:end], return_inverse=True)
        lists = [keys.dictionary.take(pa.array(of)), terms.dictionary.take(pa.array(its)), pa.array(counts, pa.int32()), pa.array(place, pa.int16()), pa.array(weight[first:end])]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        yield pa.RecordBatch.from_arrays([pa.array([block[text[first]]]), *lists], ["fg_block", "fg_keys", "fg_terms", "fg_counts", "fg_numbers", "fg_weights"])


def _term_groups(text: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int) -> np.ndarray:
    """A group for each term: terms of texts that are alike share one, by k-means over some texts and the most frequent terms. Others share the last group."""
    step = -(-n // _DRAWN)
    drawn = text % step == 0
    often = np.sort(np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:_WIDE])
    texts = _laid_out((text[drawn] // step, term[drawn], weight[drawn]), -(-n // step), _columns(often, n_terms))
    r = np.random.default_rng(0)
    centres, nearest = texts[:1], texts @ texts[0]
    for _ in range(_GROUPS - 1):
        far = np.clip(1 - nearest, 1e-9, None) ** 2
        new = texts[r.choice(len(texts), p=far / far.sum())]
        centres, nearest = np.vstack([centres, new]), np.maximum(nearest, texts @ new)
    for _ in range(8):
        own, sums = (texts @ centres.T).argmax(1), np.zeros_like(centres)
        np.add.at(sums, own, texts)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    out = np.full(n_terms, _GROUPS)
    out[often] = centres.argmax(0)
    return out


class _Bags:
    """Weights of the texts of some blocks, text by text: ``keys`` has the texts, those of a block together, and in it those that are alike.

    ``profile`` has the lengths of a text's parts, a part for each group of terms: the product of two texts' profiles is at least that of the texts.
    """

    def __init__(self, packs: Iterator[pa.RecordBatch]):
        names, keys, terms, numbers, counts, weights = [], [], [], [], [], []
        for batch in packs:
            for k in range(len(batch)):
                at = {c: batch.column(c)[k] for c in batch.schema.names}
                names.append((at["fg_block"].as_py(), at["fg_own"].as_py()))
                keys.append(at["fg_keys"].values)
                terms.append(at["fg_terms"].values)
                for to, c in ((numbers, "fg_numbers"), (counts, "fg_counts"), (weights, "fg_weights")):
                    to.append(at[c].values.to_numpy())
        texts, words = (pa.concat_arrays(x).dictionary_encode() for x in (keys, terms))
        n, self.n_terms, code = len(texts.dictionary), len(words.dictionary), texts.indices.to_numpy()
        block, own = np.empty(n, np.int64), np.empty(n, bool)
        block[code], own[code] = (np.repeat([x[c] for x in names], [len(x) for x in keys]) for c in (0, 1))
        starts = np.cumsum([0, *map(len, keys)])
        text = np.concatenate([code[a:][k] for a, k in zip(starts, numbers, strict=False)])
        term, weight = np.repeat(words.indices.to_numpy(), np.concatenate(counts)), np.concatenate(weights)
        part = text.astype(np.int64) * (_GROUPS + 1) + _term_groups(text, term, weight, n, self.n_terms)[term]
        profile = np.sqrt(np.bincount(part, weight * weight, n * (_GROUPS + 1))).reshape(n, _GROUPS + 1)
        order = np.lexsort((-profile.max(1), profile.argmax(1), block))
        self.keys, self.block, self.own, self.profile = texts.dictionary.take(pa.array(order)), block[order], own[order], profile[order]
        place = np.empty(n, np.int32)
        place[order] = np.arange(n)
        text = place[text]
        by_text = np.argsort(text, kind="stable")
        self.text, self.term, self.weight = text[by_text], term[by_text], weight[by_text]
        self.start = np.append(0, np.cumsum(np.bincount(text, minlength=n)))

    def part(self, first: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight) of the texts from ``first`` on and before ``end``, numbered from 0."""
        at = slice(self.start[first], self.start[end])
        return self.text[at] - first, self.term[at], self.weight[at]

    def sides(self) -> Iterator[tuple[int, int, int]]:
        """(first, end, before): texts to multiply with all before ``before``. Texts of a block meet those of the blocks before it, and each other where it is its own."""
        cuts = np.flatnonzero(np.append(True, np.diff(self.block) != 0))
        for start, stop in zip(cuts, np.append(cuts[1:], len(self.block)), strict=True):
            for first in range(start, stop, _ACROSS):
                end = min(first + _ACROSS, stop)
                yield first, end, end if self.own[start] else start


def _columns(terms: np.ndarray, n: int) -> np.ndarray:
    """The place in ``terms`` of each of n terms, -1 for the others."""
    out = np.full(n, -1)
    out[terms] = np.arange(len(terms))
    return out


def _laid_out(part: tuple[np.ndarray, np.ndarray, np.ndarray], texts: int, columns: np.ndarray) -> np.ndarray:
    """The weights as a matrix: a row for each text, and for each term the column that ``columns`` tells, if any."""
    text, term, weight = part
    column = columns[term]
    some = column >= 0
    out = np.zeros((texts, columns.max() + 1))
    out[text[some], column[some]] = weight[some]
    return out


def _reaching(left: np.ndarray, right: np.ndarray, small: np.ndarray, among: np.ndarray, least: float, length: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, product) of the rows of ``left`` and of those ``among`` the rows of ``right`` whose product may reach ``least``. small: ``right`` with half the digits.

    All products are made with half the digits first, off by less than ``slack``; then whole ones, of pairs that are left, or all if many are. length: of the longest row.
    """
    slack = (left.shape[1] + 8) * 2.0**-23 * length**2 + 1e-9
    i, j = np.nonzero(left.astype(np.float32) @ (small if len(among) == len(small) else small[among]).T >= np.float32(least - slack))
    if len(i) > _FEW * len(left) * len(among):
        return i, j, (left @ right[among].T)[i, j]
    parts = [np.einsum("ij,ij->i", left[i[k : k + 1024]], right[among[j[k : k + 1024]]]) for k in range(0, len(i), 1024)]
    return i, j, np.concatenate([np.empty(0), *parts])


def _pairs(bags: _Bags, least: float) -> Iterator[pa.RecordBatch]:
    """(a, b, similarity) of the pairs that reach ``least``."""
    length = np.sqrt((bags.profile**2).sum(1).max())
    for first, end, before in bags.sides():
        across = bags.part(first, end)
        known = np.unique(across[1])
        columns = _columns(known, bags.n_terms)
        right = _laid_out(across, end - first, columns) if len(known) <= _WIDE else None
        small = None if right is None else right.astype(np.float32)
        for top in range(0, before, _HIGH):
            high = min(_HIGH, before - top)
            may = bags.profile[top : top + high] @ bags.profile[first:end].T >= least - 1e-8
            down, among = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
            if not len(down):
                continue
            left = bags.part(top, top + high)
            if right is not None:
                i, j, similarity = _reaching(_laid_out(left, high, columns)[down], right, small, among, least, length)
            else:
                product, shared = np.zeros((len(down), len(among))), np.intersect1d(known, left[1])
                for low in range(0, len(shared), _WIDE):
                    some = _columns(shared[low : low + _WIDE], bags.n_terms)
                    product += _laid_out(left, high, some)[down] @ _laid_out(across, end - first, some)[among].T
                i, j = np.nonzero(product >= least - 1e-9)
                similarity = product[i, j]
            i, j = down[i] + top, among[j] + first
            some = (np.round(similarity, 9) >= least) & (i < j)
            if some.any():
                x, y = (bags.keys.take(pa.array(k[some])) for k in (i, j))
                less = pc.less(x, y)
                yield pa.RecordBatch.from_arrays([pc.if_else(less, x, y), pc.if_else(less, y, x), pa.array(similarity[some])], ["a", "b", "similarity"])


def _prime(least: int) -> int:
    return next(p for p in range(least, 2 * least) if all(p % d for d in range(2, int(p**0.5) + 1)))


def pairwise_similarity(weights: DataFrame, *, least: float = 0.5, key: str = "doc_id", block: int = 131072) -> DataFrame:
    """(a, b, similarity): the cosine of every pair a < b of texts that reach ``least`` (above 0). weights: (key, term, weight), of length 1.

    Texts are dealt to p x p blocks, the points of a plane over the prime p, and each line of the plane is a group: every two points lie on one line, so every two
    blocks meet in one group, of which there are p x (p + 1). A group holds 1 / p of the texts, about ``block`` at most, and texts travel p + 1 times, packed.
    In a group they are multiplied as matrices, whatever terms they share, but for those whose profiles rule that out. The work grows with the square of the texts, as the pairs do.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    rows = stored(weights.where(F.col(key).isNotNull()).select(F.col(key).alias("fg_key"), "term", "weight"))
    p = _prime(max(5, -(-rows.select("fg_key").distinct().count() // block)))
    kind = rows.schema["fg_key"].dataType.simpleString()
    lists = f"fg_block long, fg_keys array<{kind}>, fg_terms array<string>, fg_counts array<int>, fg_numbers array<smallint>, fg_weights array<double>"
    packs = rows.withColumn("fg_block", F.pmod(F.xxhash64("fg_key"), F.lit(p * p))).mapInArrow(_packs, lists)
    # Lines are y = m x + c, and x = c as the p-th slope. A block meets itself on the line whose slope is its x.
    line = f"transform(sequence(0, {p}), m -> struct(IF(m = {p}, {p * p} + fg_block div {p}, m * {p} + pmod(fg_block % {p} - m * (fg_block div {p}), {p})) AS fg_line, m = fg_block div {p} AS fg_own))"
    sent = packs.select("*", F.expr(f"inline({line})")).repartition(4 * p * (p + 1), "fg_line")

    def group(packs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pairs(_Bags(packs), least)

    return sent.groupBy("fg_line").applyInArrow(group, f"a {kind}, b {kind}, similarity double")
