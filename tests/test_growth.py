"""What holds when tables grow: results that stay those of SQL, and work that grows no faster than the tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25, exact, fusion, graph_shards, hnsw, inverted, masks, pq
from lodestone.plans import catalog

SF = "/root/testdata/sf0.001"


def told(df):
    return sorted((r["query_id"], r["rank"], r["neighbor_id"], round(r["dist"], 6)) for r in df.collect())


def vectors(spark, n, dim=8, seed=1):
    v = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return spark.createDataFrame([(i, v[i].tolist(), i % 10) for i in range(n)], "id long, vector array<float>, label int")


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_whole_reordering_joins_no_pairs(spark, monkeypatch, metric):
    """With all rows measured again, the codes are asked for the k best alone, and the result is exact."""
    rows = vectors(spark, 600)
    index, asked = pq.PqIndex.build(rows, metric, parts=4, words=16), []
    estimated = pq.PqIndex.estimated
    monkeypatch.setattr(pq.PqIndex, "estimated", lambda self, q, k: asked.append(k) or estimated(self, q, k))
    assert told(index.search(rows.where("id % 50 = 0"), 7, 600)) == told(exact.knn_exact(rows.where("id % 50 = 0"), rows, 7, metric))
    assert asked == [7]
    assert index.search(rows.limit(2), 700, 700).count() == 1200


@pytest.mark.parametrize("name,metric", [("hnsw_adaptive", "ip"), ("knn_adaptive", "l2")])
def test_adaptive_queries_are_exact_beyond_their_switch(spark, monkeypatch, name, metric):
    """Where more rows are allowed than the first side scans, the answer is still that of SQL."""
    monkeypatch.setattr(catalog, "FEW", 5)
    b, q = catalog._base(spark, SF), catalog._asked(spark, SF)
    assert told(catalog.queries()[name](spark, SF)) == told(exact.knn_exact(q, b, 10, metric, F.col("label") == 3))


def test_completed_where_nothing_was_found(spark):
    """An approximation that finds too few, or nothing, costs time but no row."""
    b = vectors(spark, 400)
    q, few = b.where("id % 40 = 1"), F.col("label") == 3
    want = told(exact.knn_exact(q, b, 5, "l2", few))
    for found in (exact.knn_postfilter(q, b, 5, "l2", few, 2), exact.knn_exact(q, b, 5, "l2", few).where("query_id > 100"), exact._empty(spark)):
        assert told(exact.knn_adaptive(q, b, 5, "l2", few, 0, lambda found=found: found, True)) == want


def test_shards_of_several_graphs(spark, monkeypatch, tmp_path):
    """The number of shards stays what was asked for, and no graph holds more rows than a task should."""
    monkeypatch.setattr(graph_shards, "SHARD_ROWS", 60)
    monkeypatch.setattr(catalog, "_base", lambda spark, d: vectors(spark, 400))
    assert tuple(catalog.hnsw_total_info(spark, SF).first()) == (400, 8, 4)
    index = catalog._halves(spark, SF)
    assert index.pieces == 4 and index.nodes.groupBy("shard").count().agg(F.max("count")).first()[0] < 100
    assert [r["shard"] for r in index.info().orderBy("shard").collect()] == [0, 1]
    same = hnsw.HnswIndex._placed(vectors(spark, 400), 2, index.params).select("id", F.col("shard").alias("s"))
    assert index.nodes.join(same, "id").where("pmod(shard, 2) <> s").count() == 0
    b = vectors(spark, 400)
    q = b.where("id % 40 = 1")
    keep = b.where("label < 5")
    truth = exact.knn_exact(q, b, 10, "ip")
    assert fusion.recall_at_k(index.search(q, 10, 60), truth, q).first()["recall"] >= 0.95
    index.save(str(tmp_path / "g"))
    again = hnsw.HnswIndex.load(spark, str(tmp_path / "g"))
    assert told(again.search(q, 10, mask=masks.of(keep), exact_below=10_000)) == told(exact.knn_exact(q, b, 10, "ip", allowed=keep))


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_columns_measure_only_candidates(spark, metric):
    """The query's function measures a bounded number of pairs by columns, and finds the same with copies, bad rows and far vectors."""
    rows = vectors(spark, 1000).withColumn("vector", F.transform("vector", lambda x: (x + 1000).cast("float")))
    rows = rows.withColumn("id", F.when(F.col("id") != 9, F.col("id"))).unionByName(rows.withColumn("id", F.col("id") + 5000))
    q = rows.where("id % 100 = 1")
    found = exact.knn_expr(q, rows, 6, metric)
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert told(found) == told(exact.knn_exact(q, rows, 6, metric))
    assert exact.knn_expr(q, rows, 0, metric).count() == 0 and exact.knn_expr(q, rows.limit(0), 6, metric).count() == 0


def test_blocks_grow_before_their_number(spark):
    """Four times the rows make at most four times the pairs of blocks that are shuffled, until blocks are as large as they may be."""
    few = exact._blocks(spark, exact.BLOCK_ROWS * 4)
    assert few == 4 and exact._blocks(spark, exact.BLOCK_ROWS * 16) == 4
    assert exact._blocks(spark, exact.BLOCK_ROWS * exact.LARGE * 19) == 19 and exact._blocks(spark, 0) == exact._blocks(spark, 1) == 1


def test_kth_at_most():
    d = np.random.default_rng(2).normal(size=(20, 1003))
    for m in (1, 7, 250, 1003):
        assert (exact.kth_at_most(d, m) >= np.sort(d, axis=1)[:, m - 1]).all()


def test_tokens_are_counted_where_they_are_made(spark):
    """Texts are dealt once, by document; no token is shuffled."""
    plan = catalog.sql_tokenize(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")


def test_batches_of_the_stream_do_not_grow_with_the_tasks_that_write(spark, monkeypatch):
    at = []
    path = catalog.new_path
    monkeypatch.setattr(catalog, "new_path", lambda spark, name: at.append(path(spark, name)) or at[-1])
    monkeypatch.setattr(catalog.ivf.IvfIndex, "build", lambda *a, **b: None)
    monkeypatch.setattr(catalog.streamed, "append_vectors", lambda *a: type("Q", (), {"awaitTermination": lambda self: None})())
    monkeypatch.setattr(catalog, "_base", lambda spark, d: vectors(spark, 900).repartition(7))
    catalog._streamed(spark, SF)
    fed = spark.read.parquet(at[0])
    assert len(fed.inputFiles()) == 6 and fed.count() == 900 + 450 + 630


def test_range_shards_grow_before_their_number(spark, monkeypatch):
    said = []
    monkeypatch.setattr(catalog, "_base", lambda spark, d: vectors(spark, 900))
    monkeypatch.setattr(graph_shards.HnswShards, "build", lambda rows, params, shard_rows: said.append(shard_rows) or graph_shards.HnswShards(spark, "", params, 0))
    monkeypatch.setattr(graph_shards.HnswShards, "add", lambda self, rows: self)
    monkeypatch.setattr(catalog, "RANGES", 4)
    for least in (700, 10):
        monkeypatch.setattr(catalog, "RANGE_ROWS", least)
        catalog._ranges(spark, SF)
    monkeypatch.setattr(graph_shards, "SHARD_ROWS", 100)
    catalog._ranges(spark, SF)
    assert said == [700, 113, 50]


def test_blocks_of_postings_are_written_where_they_are_made(spark, monkeypatch):
    """Building deals documents once; their blocks, which are larger, are not shuffled again, and each file is sorted by term."""
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} rare{i}") for i in range(300)], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "repartition", lambda *a: pytest.fail("blocks are shuffled"))
    index = inverted.InvertedIndex.build(docs)
    rows = index.blocks.select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("at"), "term").orderBy("f", "at").collect()
    assert all(a["term"] <= b["term"] for a, b in zip(rows, rows[1:]) if a["f"] == b["f"]) and len(rows) >= 312


def test_scoring_holds_few_pairs_at_a_time(spark, monkeypatch):
    """A batch of many documents whose terms many queries ask for is worked on in parts, and later parts pass on only what beats the k-th so far."""
    import tracemalloc

    import pyarrow as pa

    n, common = 3000, " ".join(f"c{j}" for j in range(20))
    docs = spark.createDataFrame([(i, f"{common} w{i % 13} " + "x " * (i * 7 % 499)) for i in range(n)], "doc_id long, text string").coalesce(1)
    q = spark.createDataFrame([(i, f"{common} w{i}") for i in range(100)], "query_id long, text string")
    index, scans, given = bm25.Bm25Index.build(docs), [], []
    of, write = type(docs).mapInArrow, bm25.stored
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: scans.append(f) or of(self, f, schema))
    monkeypatch.setattr(bm25, "stored", lambda df, name: given.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or write(df, name))
    found = lambda: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in index.search(q, 5).collect())
    got = found()
    assert given == [str(bm25.ROWS)] and len(got) == 500
    batch = index.docs.toArrow().combine_chunks().select(["doc_id", "doc_len", "terms"]).to_batches()[0]
    tracemalloc.start()
    passed = sum(b.num_rows for b in scans[0]([batch]))
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    # the same documents again, all of them worse: nothing is passed on
    worse = batch.set_column(1, "doc_len", pa.array(np.full(n, 10_000)))
    assert sum(b.num_rows for b in scans[0]([batch, worse])) == passed
    for name, most in (("TERMS", 200), ("PAIRS", 900)):
        monkeypatch.setattr(bm25, name, most)
        assert found() == got


def test_counting_holds_few_tokens_at_a_time():
    import tracemalloc

    import pyarrow as pa

    n, words = 2000, 1000
    tokens = pa.ListArray.from_arrays(pa.array(np.arange(0, n * words + 1, words), pa.int32()), pa.array([f"w{i % 97}" for i in range(n * words)]))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), tokens], ["doc_id", "tokens"])
    tracemalloc.start()
    made = list(bm25._counted([batch]))
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
    assert sum(b.num_rows for b in made) == n and {x for b in made for x in b.column(1).to_pylist()} == {words}
    assert [*bm25._runs(np.array([3, 0, 9, 1, 1, 0]), 4, 10)] == [(0, 2), (2, 3), (3, 6)] and [*bm25._runs(np.zeros(5), 4, 2)] == [(0, 2), (2, 4), (4, 5)]


def test_graphs_stay_small_enough_to_be_searched_well(spark):
    """Where the number of shards is fixed a graph holds some 5,000 rows at most, at any size: of 12,800 a search of width 64 missed the gate."""
    assert [catalog._pieces(spark.range(n), 4) for n in (0, 2000, 20_000, 51_282, 615_384)] == [1, 1, 1, 3, 31]
    assert catalog._pieces(spark.range(51_282), 1) == 11
