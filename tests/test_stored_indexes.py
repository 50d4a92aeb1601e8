"""Indexes that are stored and read in part: inverted lists, inverted files, graph shards, codes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25, exact, fusion, graph_shards, hnsw, inverted, ivf, pq, selection


def vecs(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, vector array<float>")


def told(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def corpus(seed=1, n=900):
    """Words of very unequal frequency; a few documents hold rare words."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    p = 1 / np.arange(1, 301)
    out = [" ".join(rng.choice(words, rng.integers(1, 60), p=p / p.sum())) for _ in range(n)]
    for i in range(0, n, 90):
        out[i] += " rare rare rarer"
    return [*out, "", None]


def test_inverted_lists(spark, tmp_path, monkeypatch):
    """Equal to the forward index whatever the parameters, for sent and for joined terms, with filters, additions and after loading; most blocks of rare words' queries are passed over."""
    monkeypatch.setattr(inverted, "RANGE", 16)
    docs = spark.createDataFrame([*enumerate(corpus()), (None, "rare")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "rare rarer w250"), (2, "w0 w1 w2"), (3, "w7 rare"), (4, "nothing the"), (5, None), (None, "rare")], "query_id long, text string")
    even = docs.where("doc_id % 2 = 0")
    for k1, b in ((1.2, 0.75), (0.9, 0.0)):
        old = bm25.Bm25Index.build(docs, k1, b)
        index = inverted.InvertedIndex.build(docs, str(tmp_path / f"i{b}"), k1, b)
        found, read = index._search(q, 10, None)
        assert told(found) == told(old.search(q, 10)) and found.count() > 20
        terms, small = index._terms(q)
        every = {r[0]: r[1] for r in index.bounds(terms, small)[0].groupBy("query_id").count().collect()}
        scored = {r[0]: r[1] for r in read.groupBy("query_id").count().collect()}
        assert scored[3] < every[3]
        assert told(index.search(q, 10, even)) == told(old.search(q, 10, even))
        assert told(index.search(q, 3)) == told(old.search(q, 3)) and index.search(q, 0).count() == 0
    monkeypatch.setattr(inverted, "BROADCAST_BYTES", 0)
    again = inverted.InvertedIndex.load(spark, str(tmp_path / "i0.0"))
    assert told(again.search(q, 10)) == told(old.search(q, 10)) and told(again.search(q, 10, even)) == told(old.search(q, 10, even))
    monkeypatch.undo()
    monkeypatch.setattr(inverted, "NAMED", 2)
    grown = inverted.InvertedIndex.build(even, str(tmp_path / "g")).add(docs.where("doc_id % 2 = 1")).add(docs.where("doc_id IS NULL"))
    assert told(grown.search(q, 10)) == told(bm25.Bm25Index.build(docs).search(q, 10))
    assert inverted.InvertedIndex.build(docs.where("doc_id < 0")).search(q).count() == 0
    with pytest.raises(ValueError):
        inverted.InvertedIndex.build(docs, k1=-1)


def test_a_term_of_one_block_is_read_alone(spark, tmp_path):
    """Bucket and term reach the scan, and the first pass reads no arrays."""
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    index = inverted.InvertedIndex.build(docs, str(tmp_path / "i"))
    terms = spark.createDataFrame([(1, "rare")], "query_id long, term string")
    plan = index._named(index.blocks, terms).select("term", "n", "best")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan and "EqualTo(term,rare)" in plan or "In(term" in plan
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_frontier_bounds_every_document(spark):
    docs = spark.createDataFrame(list(enumerate(corpus(2, 200))), "doc_id long, text string")
    for r in inverted.InvertedIndex.build(docs).blocks.collect():
        best = [(x["tf"], x["doc_len"]) for x in r["best"]]
        pairs = set(zip(r["tfs"], r["lens"]))
        assert set(best) == {p for p in pairs if not any(o != p and o[0] >= p[0] and o[1] <= p[1] for o in pairs)}
        assert r["n"] == len(r["ids"]) and list(r["ids"]) == sorted(r["ids"])


def test_stored_inverted_file(spark, tmp_path, monkeypatch):
    """Only folders of probed cells are read; added rows are found; loading gives the same; all cells make it exact."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 8)) * 5
    v = np.float32(centre[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 8)))
    v[7, 2] = np.nan
    base = vecs(spark, list(enumerate(v)))
    q = base.where("id % 50 = 1")
    index = ivf.IvfIndex.build(base.where("id % 3 > 0"), "l2", str(tmp_path / "i"), nlist=12, rounds=3).add(base.where("id % 3 = 0"))
    truth = exact.knn_exact(q, base, 10, "l2")
    assert told(index.search(q, 10, 12)) == told(truth)
    assert fusion.recall_at_k(index.search(q, 10, 2), truth, q).first()["recall"] >= 0.9
    again = ivf.IvfIndex.load(spark, str(tmp_path / "i"))
    one = base.where("id = 1")
    probes = ivf.probed(one, again.cents, 1)
    rows = again.pruned(probes)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan
    files = {r[0] for r in rows.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(files) <= 2 < again.cells.select(F.input_file_name()).distinct().count()
    cell = probes.first()["cell"]
    assert {r["cell"] for r in rows.select("cell").distinct().collect()} == {cell}
    assert told(again.search(one, 5, 1)) == told(ivf.ivf_search(one, again.cells, again.cents, 5, 1, "l2"))
    monkeypatch.setattr(ivf, "NAMED", 0)  # cells are joined
    assert told(again.search(q, 10, 12)) == told(truth)


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_graph_shards(spark, tmp_path, metric):
    """5,000 rows in contiguous shards: recall, and additions that leave the files of other shards alone."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(5200, 32)).astype(np.float32)
    if metric == "ip":
        v /= np.linalg.norm(v, axis=1)[:, None]
    v[17, 3] = np.inf
    base = vecs(spark, list(enumerate(v)))
    q = vecs(spark, [(10_000 + i, x) for i, x in enumerate(rng.normal(size=(60, 32)))])
    p, at = hnsw.HnswParams(metric, 12, 60), str(tmp_path / "g")
    first = graph_shards.HnswShards.build(base.where("id < 5000"), at, p, 800)
    told_ = first.manifest.orderBy("shard").collect()
    assert len(told_) == 7 and len(first) == 4999
    assert all(a["hi"] < b["lo"] for a, b in zip(told_, told_[1:])) and all(500 < r["n"] < 900 for r in told_)
    truth = exact.knn_exact(q, base.where("id < 5000"), 10, metric)
    assert fusion.recall_at_k(first.search(q, 10, 100), truth, q).first()["recall"] >= 0.95
    assert set(first.index.violations().first()) == {0}
    assert told(first.search(q, 10, where=F.col("id") % 2 == 0, exact_below=9999)) == told(exact.knn_exact(q, base.where("id < 5000 AND id % 2 = 0"), 10, metric))
    # a few rows in one range, and some beyond all
    moved = spark.createDataFrame([(-5, v[1].tolist())], "id long, vector array<float>").unionByName(base.where("id >= 5000"))
    files = lambda x: {r["shard"]: sorted(os.listdir(f"{at}/{r['folder']}")) for r in x.manifest.collect()}
    before = files(first)
    grown = first.add(moved)
    after = files(grown)
    assert len(after) == 8 and [s for s in before if before[s] != after[s]] == [0] and len(grown) == 5200
    assert [r["folder"] for r in grown.manifest.where("shard BETWEEN 1 AND 6").orderBy("shard").collect()] == [r["folder"] for r in told_[1:]]
    again = graph_shards.reuse(base, at, p)
    assert again.version == 2 and len(again) == 5200 and len(graph_shards.HnswShards.open(spark, at, version=1)) == 4999
    assert told(again.search(q, 5)) == told(grown.search(q, 5))
    with pytest.raises(ValueError):
        graph_shards.reuse(base, at, hnsw.HnswParams(metric, 13, 60))
    with pytest.raises(Exception, match="already"):
        again.add(base.where("id = 7"))
    assert len(graph_shards.HnswShards.open(spark, at)) == 5200  # a failed addition changes nothing


def test_no_rows_make_no_shards(spark):
    none = graph_shards.HnswShards.build(vecs(spark, [(0, [1.0])]).where("id < 0"))
    assert len(none) == 0 and none.search(vecs(spark, [(1, [1.0])])).count() == 0
    assert len(none.add(vecs(spark, [(4, [1.0, 2.0])]))) == 1


def test_percentiles_by_selection(spark, monkeypatch):
    """One group with nearly all rows, ties, values at all scales, infinities, nulls, NaN and a null group: as numpy says, in several rounds."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=2000), 10 ** rng.uniform(-300, 300, 500), np.full(700, 0.25), [1e308, -1e308, 5e-324]])
    rows = [("hot", float(v)) for v in x] + [("one", 2.5), ("two", 1.0), ("two", 4.0), (None, 7.0), (None, 9.0), ("none", None), ("none", float("nan")), ("hot", None), ("hot", float("nan"))]
    rows += [("ends", v) for v in (float("-inf"), -1.0, 0.0, 3.0, float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    points = (0.0, 0.1, 0.5, 0.95, 0.99, 1.0)
    want = {}
    for g in {r[0] for r in rows}:
        own = np.array([v for k, v in rows if k == g and v is not None and v == v])
        with np.errstate(invalid="ignore"):
            want[g] = [float(np.percentile(own, 100 * p)) if len(own) else None for p in points]
    for parts in (selection.PARTS, 256):
        monkeypatch.setattr(selection, "PARTS", parts)
        got = {r["g"]: list(r)[1:] for r in selection.percentiles(df, ["g"], "v", points).collect()}
        assert set(got) == set(want)
        for g in want:
            if g == "ends":
                assert got[g][0] == float("-inf") and got[g][2] == 0.0 and got[g][-1] == float("inf")
            else:
                assert got[g] == pytest.approx(want[g], rel=1e-12) if want[g][0] is not None else got[g] == want[g]
    whole = selection.percentiles(df.where("g = 'two'"), [], "v", (0.5,)).collect()
    assert [tuple(r) for r in whole] == [(2.5,)]
    assert selection.percentiles(df.where("g = 'x'"), ["g"], "v").count() == 0


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_quantised_search(spark, tmp_path, monkeypatch, metric):
    """Recall with few rows measured again, exactness with all; bad rows, ties, additions, rounds, loading."""
    rng = np.random.default_rng(12)
    v = np.float32(rng.normal(size=(30, 16))[rng.integers(0, 30, 900)] + 0.3 * rng.normal(size=(900, 16)))
    v[20:25] = v[10]
    v[3, 1] = np.nan
    base = vecs(spark, list(enumerate(v)))
    q = base.where("id % 40 = 3 OR id = 10")
    index = pq.PqIndex.build(base.where("id < 600"), metric, str(tmp_path / "p"), parts=8, words=64).add(base.where("id >= 600"))
    truth = exact.knn_exact(q, base, 7, metric)
    assert told(index.search(q, 7, 900)) == told(truth)
    assert fusion.recall_at_k(index.search(q, 7, 60), truth, q, 7, True).first()["recall"] >= 0.9
    assert {r[0] for r in index.rows.select(F.octet_length("code")).distinct().collect()} == {8} and index.rows.count() == 899
    monkeypatch.setattr(pq, "BROADCAST_BYTES", 8 * 64 * 8 * 5)
    assert told(pq.PqIndex.load(spark, str(tmp_path / "p")).search(q, 7, 900)) == told(truth)
    assert index.search(q, 0).count() == 0 and index.search(q.where("id < 0")).count() == 0
    with pytest.raises(ValueError):
        pq.PqIndex.build(base, metric, parts=5)
