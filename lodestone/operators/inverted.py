"""Okapi BM25 over stored inverted lists with block maxima.

Documents are dealt to ranges of about RANGE by a hash of their ids; a block holds the documents of one range that have a term: ids, frequencies
and lengths as arrays. Beside them stand the block's count and its frontier, the (frequency, length) pairs that no other pair of the block beats in
both: whatever k1, b and the mean length are, no document of the block weighs more than the best of its frontier. Blocks lie in buckets of terms, each task's sorted by
term, so that a search reads the row groups of its terms alone, first without the arrays. The sum of a query's block maxima bounds the score of every
document in a range. A search scores the ranges with the greatest bounds first; then only those whose bound reaches the k-th score found: the
other blocks are never read.

Documents that are added later make ranges of their own (a segment each), so nothing is rewritten; frequencies and the mean length come from all
segments when a search runs. Cases: as in bm25 (documents and queries without id take no part, empty documents count); scores tie by id after rounding to nine digits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.text import tokenize
from ..storage import batches_of, drop, new_path, stored
from .bm25 import ROWS, Bm25Index, idf, tf_weight
from .exact import BROADCAST_BYTES, top_k

#: So many documents a range, about, and ranges a slab (a task's unit).
RANGE, SLAB = 128, 16
#: Buckets of terms, and ranges that are scored first for a query.
BUCKETS, FIRST = 32, 8
#: So many terms a scan is told at most.
NAMED = 200


BEST = "best array<struct<tf: int, doc_len: int>>"


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term, F.lit(21)), F.lit(BUCKETS)).cast("int")


def _blocked(group):
    """Blocks (term, range, best, ids, tfs, lens) of a slab of (doc_id, range, doc_len, terms)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ids, lists = group["doc_id"].combine_chunks(), group["terms"].combine_chunks()
    flat = lists.flatten()
    words = flat.field("term").dictionary_encode()
    doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    tf, length = flat.field("tf").to_numpy(zero_copy_only=False), group["doc_len"].to_numpy()[doc]
    part = group["range"].to_numpy()[doc]
    rank = np.empty(len(ids), np.int64)
    rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    term = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((rank[doc], part, term))
    doc, tf, length, part, term = (x[order] for x in (doc, tf, length, part, term))
    first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (part[1:] != part[:-1]))) if len(term) else np.zeros(0, np.int64)
    offsets = np.append(first, len(term)).astype(np.int32)
    block = np.repeat(np.arange(len(first)), np.diff(offsets))
    # the frontier: by falling frequency, each posting that is shorter than all of its block before
    by = np.lexsort((length, -tf, block))
    value = length[by] - block[by] * (int(length.max(initial=0)) + 1)
    least = np.minimum.accumulate(value)
    front = by[np.append(True, value[1:] < least[:-1])] if len(by) else by
    ends = np.searchsorted(block[front], np.arange(len(first) + 1)).astype(np.int32)
    best = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(tf[front].astype(np.int32)), pa.array(length[front].astype(np.int32))], ["tf", "doc_len"]))
    listed = lambda x: pa.ListArray.from_arrays(pa.array(offsets), x)
    columns = [words.dictionary.take(pa.array(term[first])), pa.array(part[first]), best, listed(ids.take(pa.array(doc))), listed(pa.array(tf.astype(np.int32))), listed(pa.array(length.astype(np.int32)))]
    return pa.table(columns, ["term", "range", "best", "ids", "tfs", "lens"])


@dataclass
class InvertedIndex:
    """Lies under path: blocks (bucket, term, segment, range, n, best, ids, tfs, lens), a folder a bucket; sums (segment, n_docs, total); meta."""

    spark: object
    path: str
    k1: float = 1.2
    b: float = 0.75
    remove_stopwords: bool = True

    def __post_init__(self):
        if self.k1 < 0 or not 0 <= self.b <= 1:
            raise ValueError("k1 must not be negative, b must lie between 0 and 1")

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, k1: float = 1.2, b: float = 0.75, remove_stopwords: bool = True) -> InvertedIndex:
        """The index of docs(doc_id, text), under path or in the shared folder."""
        out = cls(docs.sparkSession, path or new_path(docs.sparkSession, "inverted"), k1, b, remove_stopwords)
        out._write(docs, 0)
        meta = docs.sparkSession.createDataFrame([(3, k1, b, remove_stopwords)], "version int, k1 double, b double, remove_stopwords boolean")
        meta.write.parquet(f"{out.path}/meta")
        return out

    @classmethod
    def load(cls, spark, path: str) -> InvertedIndex:
        m = spark.read.parquet(f"{path}/meta").first()
        return cls(spark, path, m["k1"], m["b"], m["remove_stopwords"])

    def add(self, docs: DataFrame) -> InvertedIndex:
        """Adds docs(doc_id, text) as a segment; what is there stays as it is. Sums are written last: a segment without them isn't read."""
        self._write(docs, 1 + max(r[0] for r in self.sums.select("segment").collect()))
        return self

    def _write(self, docs: DataFrame, segment: int) -> None:
        with batches_of(docs.sparkSession, ROWS):
            forward = stored(Bm25Index.forward(docs, self.remove_stopwords), "forward")
        n, total = forward.agg(F.count("*"), F.sum("doc_len")).first()
        ranges = max(1, -(-n // RANGE))
        rows = forward.select("doc_id", "doc_len", "terms", F.pmod(F.xxhash64("doc_id", F.lit(22)), F.lit(ranges)).alias("range"))
        kind = docs.schema["doc_id"].dataType.simpleString()
        lists = rows.groupBy(F.floor(F.col("range") / SLAB).alias("slab")).applyInArrow(_blocked, StructType.fromDDL(f"term string, range long, {BEST}, ids array<{kind}>, tfs array<int>, lens array<int>"))
        blocks = lists.select(bucket_of(F.col("term")).alias("bucket"), "term", F.lit(segment).alias("segment"), "range", F.size("ids").alias("n"), "best", "ids", "tfs", "lens")
        # where slabs are made: blocks are more than the postings they were made of, and aren't shuffled
        blocks = blocks.sortWithinPartitions("bucket", "term", "range")
        blocks.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/blocks/part={segment}")
        drop(forward)
        sums = self.spark.createDataFrame([(segment, n, total or 0, docs.schema["doc_id"].dataType.simpleString())], "segment int, n_docs long, total long, id_type string")
        sums.write.mode("overwrite").parquet(f"{self.path}/sums/part={segment}")

    @property
    def sums(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/sums").drop("part")

    @property
    def blocks(self) -> DataFrame:
        """The blocks of all finished segments."""
        known = [(r["segment"], r["id_type"]) for r in self.sums.select("segment", "id_type").collect()]  # a row per addition
        schema = f"term string, segment int, range long, n int, {BEST}, ids array<{known[0][1]}>, tfs array<int>, lens array<int>, part int, bucket int"
        return self.spark.read.schema(StructType.fromDDL(schema)).parquet(f"{self.path}/blocks").where(F.col("part").isin([s for s, _ in known]))

    def _terms(self, queries: DataFrame) -> tuple[DataFrame, bool]:
        """(query_id, term), and whether they are few enough to be sent."""
        terms = queries.where("query_id IS NOT NULL").select("query_id", F.explode(F.array_distinct(tokenize(F.coalesce("text", F.lit("")), self.remove_stopwords))).alias("term")).distinct()
        n, size = terms.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
        return terms, n * 64 + (size or 0) <= BROADCAST_BYTES

    def bounds(self, terms: DataFrame, small: bool) -> tuple[DataFrame, DataFrame, float]:
        """(query_id, segment, range, bound) for terms(query_id, term); (term, idf) of the terms there are; and the mean length."""
        send = F.broadcast if small else (lambda df: df)
        n_docs, total = self.sums.agg(F.sum("n_docs"), F.sum("total")).first()
        mean = total / n_docs if n_docs else 0.0
        found = self._named(self.blocks, terms) if small else self.blocks.join(terms.select("term").distinct(), "term", "left_semi")
        heads = stored(found.select("term", "segment", "range", "n", F.array_max(F.transform("best", lambda x: tf_weight(x["tf"], x["doc_len"], F.lit(mean), self.k1, self.b))).alias("w")), "heads")
        weight = stored(heads.groupBy("term").agg(F.sum("n").alias("df")).select("term", idf(F.lit(n_docs), F.col("df")).alias("idf")), "weights")
        each = heads.join(send(terms.join(weight, "term")), "term")
        return each.groupBy("query_id", "segment", "range").agg(F.sum(F.col("idf") * F.col("w")).alias("bound")), weight, mean

    def scored(self, wanted: DataFrame, terms: DataFrame, small: bool, weight: DataFrame, mean: float, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, score) of the documents in wanted(query_id, segment, range), at least the k best of each slab and query.

        The blocks of a slab come together once, whatever the number of queries that want them; only more terms than are sent are joined with them."""
        if not small:
            return self._joined(wanted, terms, weight, mean, allowed)
        known = {r["term"]: r["idf"] for r in weight.collect()}
        asked: dict[str, list] = {}
        for r in terms.collect():  # measured as small
            if r["term"] in known:
                asked.setdefault(r["term"], []).append(r["query_id"])
        sent = self.spark.sparkContext.broadcast({t: (known[t], q) for t, q in asked.items()})
        found = self._named(self.blocks, weight).select("term", "segment", "range", "ids", "tfs", "lens")
        found = found.join(wanted.select("segment", "range").distinct(), ["segment", "range"], "left_semi")
        slab = F.floor(F.col("range") / SLAB)
        kind, asking = dict(found.dtypes)["ids"].removeprefix("array<")[:-1], terms.schema["query_id"].dataType
        schema = StructType([StructField("query_id", asking), *StructType.fromDDL(f"doc_id {kind}, score double")])
        k1, b, cut = self.k1, self.b, allowed is None

        def score(blocks, wants):
            import pyarrow as pa

            out = pa.schema([("query_id", wants.schema.field("query_id").type), ("doc_id", blocks.schema.field("ids").type.value_type), ("score", pa.float64())])
            if not blocks.num_rows or not wants.num_rows:
                return out.empty_table()
            names = sorted(set(wants["query_id"].to_pylist()))
            place = {q: i for i, q in enumerate(names)}
            ranges = np.unique(blocks["range"].to_numpy())
            want = np.zeros((len(names), len(ranges)), bool)
            at = np.searchsorted(ranges, wants["range"].to_numpy())
            inside = (at < len(ranges)) & (ranges[np.minimum(at, len(ranges) - 1)] == wants["range"].to_numpy())
            want[np.array([place[q] for q in wants["query_id"].to_pylist()])[inside], at[inside]] = True
            ids = blocks["ids"].combine_chunks()
            n = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            docs = ids.flatten().dictionary_encode()
            doc = docs.indices.to_numpy(zero_copy_only=False)
            tf, length = (blocks[c].combine_chunks().flatten().to_numpy() for c in ("tfs", "lens"))
            w = tf_weight(tf.astype(np.float64), length, mean, k1, b)
            part = np.empty(len(docs.dictionary), np.int64)
            part[doc] = np.repeat(np.searchsorted(ranges, blocks["range"].to_numpy()), n)
            scores = np.zeros((len(names), len(docs.dictionary)))
            starts = np.append(0, np.cumsum(n))
            for i, term in enumerate(blocks["term"].to_pylist()):
                idf_, who = sent.value.get(term, (0, ()))
                who = [place[q] for q in who if q in place]
                if who:
                    scores[np.array(who)[:, None], doc[starts[i] : starts[i + 1]]] += idf_ * w[starts[i] : starts[i + 1]]
            scores[~want[:, part]] = 0
            if cut:
                m = min(k, scores.shape[1])
                least = np.partition(scores, -m, axis=1)[:, -m] - 1e-8
                q, d = np.nonzero((scores >= least[:, None]) & (scores > 0))
            else:
                q, d = np.nonzero(scores > 0)
            return pa.table([pa.array(names, out.field(0).type).take(pa.array(q)), docs.dictionary.take(pa.array(d)), pa.array(scores[q, d])], schema=out)

        wanted = wanted.select("query_id", "segment", "range", slab.alias("slab"))
        got = found.withColumn("slab", slab).groupBy("segment", "slab").cogroup(wanted.groupBy("segment", "slab")).applyInArrow(score, schema)
        return got if allowed is None else got.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")

    def _named(self, blocks: DataFrame, terms: DataFrame) -> DataFrame:
        """Blocks of terms(term), which have been measured as few: up to NAMED are told to the scan, with their buckets; more are sent."""
        found = [tuple(r) for r in terms.select(bucket_of(F.col("term")), "term").distinct().collect()]
        if len(found) > NAMED:
            return blocks.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
        return blocks.where(F.col("bucket").isin(sorted({x for x, _ in found}))).where(F.col("term").isin([x for _, x in found]))

    def _joined(self, wanted: DataFrame, terms: DataFrame, weight: DataFrame, mean: float, allowed: DataFrame | None) -> DataFrame:
        pairs = wanted.join(terms, "query_id").join(weight, "term")
        found = self.blocks.select("term", "segment", "range", "ids", "tfs", "lens").join(pairs, ["term", "segment", "range"])
        each = found.select("query_id", "idf", F.inline(F.arrays_zip("ids", "tfs", "lens"))).withColumnRenamed("ids", "doc_id")
        if allowed is not None:
            each = each.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
        w = F.col("idf") * tf_weight(F.col("tfs"), F.col("lens"), F.lit(mean), self.k1, self.b)
        return each.groupBy("query_id", "doc_id").agg(F.sum(w).alias("score"))

    def search(self, queries: DataFrame, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, doc_id, score) for queries(query_id, text), as Bm25Index.search gives; allowed restricts documents, not statistics."""
        return self._search(queries, k, allowed)[0]

    def _search(self, queries: DataFrame, k: int, allowed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The result, and (query_id, segment, range, bound, first): the ranges that were scored."""
        terms, small = self._terms(queries)
        terms = stored(terms, "terms")
        bounds, weight, mean = self.bounds(terms, small)
        order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "segment", "range")
        ranked = stored(bounds.withColumn("place", F.row_number().over(order)), "bounds")
        best = lambda df: top_k(df, ["query_id"], [F.round("score", 9).desc(), "doc_id"], k)
        first = ranked.where(F.col("place") <= FIRST)
        found = stored(best(self.scored(first.select("query_id", "segment", "range"), terms, small, weight, mean, k, allowed)), "scores")
        kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).select("query_id", "s")
        # what rounding to nine digits can't tell from the k-th is scored too
        more = ranked.where(F.col("place") > FIRST).join(kth, "query_id", "left").where(F.col("s").isNull() | (F.col("bound") >= F.col("s") - 1e-8))
        more = stored(more.select("query_id", "segment", "range", "bound"), "more")
        if not more.isEmpty():
            rest = self.scored(more.select("query_id", "segment", "range"), terms, small, weight, mean, k, allowed)
            found = best(found.drop("rank").unionByName(best(rest).drop("rank")))
        read = first.select("query_id", "segment", "range", "bound", F.lit(True).alias("first")).unionByName(more.withColumn("first", F.lit(False)))
        return found.where(F.lit(k > 0)).select("query_id", "rank", "doc_id", "score"), read
