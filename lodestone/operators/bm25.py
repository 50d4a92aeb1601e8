"""Okapi BM25 over a forward index: docs(doc_id, doc_len, terms), with terms an array of (term, tf).

A document is one row, so its terms are counted within the row, without a shuffle; the table is written once and searches
read it column by column: lengths for the collection, terms for the frequencies. All of a document's score comes from
its row too: where the queries' terms measure small they are sent to the tasks, which score batches of documents and
pass on k rows a query and batch; more queries are joined with the postings. postings(term, doc_id, tf, doc_len),
vocab and doc_stats are views of it. Term statistics are taken from all documents when a query runs, so appended
documents and filters change nothing about them but what they should."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.text import tokenize
from ..storage import batches_of, stored
from .exact import BROADCAST_BYTES, top_k


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def tf_weight(tf, doc_len, avg_len, k1: float, b: float):
    """Of columns or arrays alike; avg_len is positive wherever a document has a term."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / avg_len))


FORWARD = "doc_len long, terms array<struct<term: string, tf: long>>"
#: So many scores of documents by queries are held at a time.
SCORES = 1 << 22
#: So many rows a worker gets at a time; and so many tokens or terms, and pairs of a term and a query that asks for it, are worked on at a time, or those of one document.
ROWS, TERMS, PAIRS = 1000, 1 << 18, 1 << 19


def _runs(sizes: np.ndarray, most: int, rows: int):
    """(start, end) of runs of rows, of at most so many rows each, whose sizes add up to at most so much; a larger row is a run of its own."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield at, to
        at = to


def _parts(batch, most: int, rows: int):
    """Slices of a batch, by the lengths of the lists in its last column."""
    sizes = batch.column(batch.num_columns - 1).value_lengths().to_numpy(zero_copy_only=False)
    return (batch.slice(a, b - a) for a, b in _runs(sizes.astype(np.int64), most, rows))


def _counted(batches):
    """(doc_id, doc_len, terms) of (doc_id, tokens)."""
    import pyarrow as pa

    for batch in batches:
        for part in _parts(batch, TERMS, ROWS):
            tokens = part.column(1)
            lengths = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            words = tokens.flatten().dictionary_encode()
            n = max(1, len(words.dictionary))
            row = np.repeat(np.arange(len(lengths)), lengths)
            key, tf = np.unique(row * n + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            offsets = np.searchsorted(key, np.arange(len(lengths) + 1) * n).astype(np.int32)
            terms = pa.StructArray.from_arrays([words.dictionary.take(pa.array(key % n)), pa.array(tf.astype(np.int64))], ["term", "tf"])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets), terms)], ["doc_id", "doc_len", "terms"])


@dataclass
class Bm25Index:
    docs: DataFrame
    k1: float = 1.2
    b: float = 0.75
    remove_stopwords: bool = True

    def __post_init__(self):
        if self.k1 < 0 or not 0 <= self.b <= 1:
            raise ValueError("k1 must not be negative, b must lie between 0 and 1")

    @staticmethod
    def forward(docs: DataFrame, remove_stopwords: bool = True) -> DataFrame:
        """The forward index of docs(doc_id, text). Empty documents count, those without an id do not."""
        t = docs.where("doc_id IS NOT NULL").select("doc_id", tokenize(F.coalesce("text", F.lit("")), remove_stopwords).alias("_t"))
        return t.mapInArrow(_counted, StructType([t.schema["doc_id"], *StructType.fromDDL(FORWARD)]))

    @classmethod
    def build(cls, docs: DataFrame, k1: float = 1.2, b: float = 0.75, remove_stopwords: bool = True) -> Bm25Index:
        cls(docs, k1, b)  # parameters are checked before anything is written
        with batches_of(docs.sparkSession, ROWS):
            return cls(stored(cls.forward(docs, remove_stopwords), "bm25"), k1, b, remove_stopwords)

    def append(self, docs: DataFrame) -> Bm25Index:
        more = Bm25Index.build(docs, self.k1, self.b, self.remove_stopwords)
        return Bm25Index(self.docs.unionByName(more.docs), self.k1, self.b, self.remove_stopwords)

    @property
    def postings(self) -> DataFrame:
        return self.docs.select("doc_id", "doc_len", F.inline("terms")).select("term", "doc_id", "tf", "doc_len")

    @property
    def doc_stats(self) -> DataFrame:
        return self.docs.select("doc_id", "doc_len")

    def vocab(self) -> DataFrame:
        return self.docs.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))

    def collection(self) -> DataFrame:
        return self.docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_len"))

    def __len__(self) -> int:
        return self.docs.count()

    def vocab_size(self) -> int:
        return self.vocab().count()

    def _weighted(self, terms: DataFrame, small: bool, allowed: DataFrame | None = None) -> DataFrame:
        """(term, doc_id, w): the contribution of each of terms(term, ...) to each allowed document that has it, with terms' other columns."""
        send = F.broadcast if small else (lambda df: df)
        docs = self._allowed(allowed)
        found = docs.select("doc_id", "doc_len", F.inline("terms")).join(send(self._frequencies(terms, small)), "term")
        full = found.crossJoin(F.broadcast(self.collection()))  # one row
        weighted = full.select("term", "doc_id", (idf(F.col("n_docs"), F.col("df")) * tf_weight(F.col("tf"), F.col("doc_len"), F.col("avg_len"), self.k1, self.b)).alias("w"))
        return weighted.join(send(terms), "term")

    def _frequencies(self, terms: DataFrame, small: bool) -> DataFrame:
        """(term, df) of terms, over all documents, from the terms' column alone."""
        wanted = terms.select("term").distinct()
        every = self.docs.select(F.explode("terms.term").alias("term"))
        return every.join(F.broadcast(wanted) if small else wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))

    def _allowed(self, allowed: DataFrame | None) -> DataFrame:
        return self.docs if allowed is None else self.docs.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")

    def search(self, queries: DataFrame, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, doc_id, score) for queries(query_id, text); allowed restricts documents, not statistics. Queries without an id take no part.

        What documents are scored for in the tasks is written, so that workers get few rows at a time whatever the session's setting when the result is read."""
        terms = queries.where("query_id IS NOT NULL").select("query_id", F.explode(F.array_distinct(tokenize(F.coalesce("text", F.lit("")), self.remove_stopwords))).alias("term")).distinct()
        n, size = terms.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
        small = n * 64 + (size or 0) <= BROADCAST_BYTES
        best = lambda scores: top_k(scores, ["query_id"], [F.round("score", 9).desc(), "doc_id"], k).select("query_id", "rank", "doc_id", "score")
        if small:
            with batches_of(self.docs.sparkSession, ROWS):
                return stored(best(self._scored(terms, k, allowed)), "scored")
        return best(self._weighted(terms, False, allowed).groupBy("query_id", "doc_id").agg(F.sum("w").alias("score")))

    def _scored(self, terms: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
        """(query_id, doc_id, score) of at least the k best of each task's documents, for terms that have been measured as few. A task's k-th score so far
        bounds what it passes on of later documents."""
        schema = StructType([StructField("query_id", terms.schema["query_id"].dataType), self.docs.schema["doc_id"], StructField("score", StructType.fromDDL("s double")["s"].dataType)])
        df = {r["term"]: r["df"] for r in self._frequencies(terms, True).collect()}
        n_docs, avg_len = self.collection().first()
        asked = [(r["query_id"], r["term"]) for r in terms.collect() if r["term"] in df]
        if not asked or k <= 0:
            return self.docs.sparkSession.createDataFrame([], schema)
        words = sorted(df)
        place = {w: i for i, w in enumerate(words)}
        ids = sorted({q for q, _ in asked})
        number = {q: i for i, q in enumerate(ids)}
        pairs = np.array(sorted((place[w], number[q]) for q, w in asked))
        weight = np.log(1 + (n_docs - np.array([df[w] for w in words]) + 0.5) / (np.array([df[w] for w in words]) + 0.5))
        sent = self.docs.sparkSession.sparkContext.broadcast((words, weight, ids, pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))))

        k1, b = self.k1, self.b

        def scan(batches):
            import pyarrow as pa
            import pyarrow.compute as pc

            words, weight, ids, who, starts = sent.value
            known, names = pa.array(words, pa.string()), pa.array(ids)
            bound = np.zeros(len(ids))
            for whole in batches:
                for batch in _parts(whole, TERMS, max(1, SCORES // len(ids))):
                    lists, n = batch.column(2), batch.num_rows
                    flat = lists.flatten()
                    at = pc.index_in(flat.field("term"), value_set=known)
                    hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                    if not len(hit):
                        continue
                    term = at.take(pa.array(hit)).to_numpy(zero_copy_only=False).astype(np.int64)
                    doc = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))[hit]
                    w = weight[term] * tf_weight(flat.field("tf").to_numpy()[hit], batch.column(1).to_numpy()[doc], avg_len, k1, b)
                    many = starts[term + 1] - starts[term]
                    scores = np.empty((len(ids), n))
                    for lo, hi in _runs(np.bincount(doc, many, n).astype(np.int64), PAIRS, n):
                        own = slice(*np.searchsorted(doc, (lo, hi)))
                        m = many[own]
                        q = who[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m - starts[term[own]], m)]
                        scores[:, lo:hi] = np.bincount(q * (hi - lo) + np.repeat(doc[own] - lo, m), np.repeat(w[own], m), len(ids) * (hi - lo)).reshape(len(ids), -1)
                    m = min(k, n)
                    least = np.maximum(np.partition(scores, -m, axis=1)[:, -m], bound)
                    if m == k:
                        bound = least
                    # what rounding to nine digits can't tell from the k-th goes on too
                    q, d = np.nonzero((scores >= least[:, None] - 1e-8) & (scores > 0))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), batch.column(0).take(pa.array(d)), pa.array(scores[q, d])], ["query_id", "doc_id", "score"])

        return self._allowed(allowed).select("doc_id", "doc_len", "terms").mapInArrow(scan, schema)

    def score(self, term: str) -> DataFrame:
        """(doc_id, score) of one raw term for every document."""
        w = self._weighted(self.docs.sparkSession.createDataFrame([(term,)], "term string"), True).select("doc_id", "w")
        return self.doc_stats.select("doc_id").join(w, "doc_id", "left").select("doc_id", F.coalesce("w", F.lit(0.0)).alias("score"))

    def save(self, path: str) -> None:
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        meta = self.docs.sparkSession.createDataFrame([(2, self.k1, self.b, self.remove_stopwords)], "version int, k1 double, b double, remove_stopwords boolean")
        meta.write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> Bm25Index:
        m = spark.read.parquet(f"{path}/meta").first()
        return cls(spark.read.parquet(f"{path}/docs"), m["k1"], m["b"], m["remove_stopwords"])
