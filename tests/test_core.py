"""The retrieval operators: golden cases, properties, and SQL over the supplied tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.functions import sql, text, vectors
from lodestone.operators import bm25, exact, fusion, hnsw, ivf
from lodestone.sources import resumable, shards
from lodestone.streaming import append

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def vecs(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, vector array<float>")


def test_corners_of_a_square_and_its_centre(spark):
    base = vecs(spark, [(11, (0, 0)), (12, (0, 8)), (13, (8, 0)), (14, (8, 8)), (15, (4, 4))])
    q = vecs(spark, [(100, (7, 5.5))])
    for found in (exact.knn_exact(q, base, 4, "l2"), exact.knn_expr(q, base, 4, "l2")):
        assert [(r["neighbor_id"], r["dist"]) for r in found.orderBy("rank").collect()] == [(14, 7.25), (15, 11.25), (13, 31.25), (12, 55.25)]
    assert exact.knn_exact(q, base, 50, "l2").count() == 5
    assert exact.knn_exact(q, base, 0, "l2").count() == 0


@pytest.mark.parametrize("centre,spread", [(0, 1), (1e4, 0.01), (1e5, 0.01), (1e6, 0.1), (-3e7, 4)])
def test_exact_far_from_the_origin(centre, spread):
    """The nearest are the true ones wherever the vectors lie, and equal distances go by id."""
    rng = np.random.default_rng(6)
    v = np.float64(np.float32(centre + spread * rng.normal(size=(1500, 48))))
    q, own = v[:9] + 0, rng.permutation(1500)
    at, which, dist = exact.nearest_rows(q, own, v, 10, "l2", step=4)
    d = ((q[:, None] - v[None]) ** 2).sum(2)
    for i in range(9):
        order = np.lexsort((own, d[i]))[:10]
        assert which[at == i].tolist() == order.tolist() and (dist[at == i] == d[i][order]).all()


def test_one_precision_on_all_paths(spark, monkeypatch):
    """Doubles are taken as 32-bit floats, sent, in blocks or by columns; bad vectors are errors on each path."""
    rows = spark.createDataFrame([(i, [0.1 * i, 0.2]) for i in range(6)], "id long, vector array<double>")
    paths = [lambda q, b: exact.knn_exact(q, b, 3, "l2"), lambda q, b: exact.knn_expr(q, b, 3, "l2")]
    want = [sorted(map(tuple, f(rows, rows).collect())) for f in paths]
    wrong = [spark.createDataFrame([(1, x)], "id long, vector array<double>") for x in (None, [1.0], [1.0, None])]
    for small in (False, True):
        if small:
            monkeypatch.setattr(exact, "BROADCAST_BYTES", 0)
        for f, w in zip(paths, want):
            assert sorted(map(tuple, f(rows, rows).collect())) == w == want[0]
            for bad in wrong:
                with pytest.raises(Exception, match="vectors must not be null"):
                    f(rows, bad).collect()


def test_empty_index(spark):
    q = vecs(spark, [(0, (0, 0))])
    index = exact.BruteForceIndex(2)
    assert len(index) == 0 and index.search(q, 3).count() == 0
    pad = exact.padded(index.search(q, 3), q, 3).collect()
    assert [(r["neighbor_id"], r["is_missing"]) for r in pad] == [(-1, True)] * 3
    index.add(vecs(spark, [(5, (1, 1))]))
    assert len(index) == 1 and index.dim == 2 and [r["neighbor_id"] for r in index.search(q, 3).collect()] == [5]
    graph = hnsw.HnswIndex.build(vecs(spark, []), 2)
    assert len(graph) == 0 and graph.dim == 0 and graph.max_level == -1 and graph.search(q, 3).count() == 0


@pytest.mark.parametrize("limit", [0, 1 << 25])
def test_shards_in_one_pass(spark, monkeypatch, limit):
    rng = np.random.default_rng(8)
    b = vecs(spark, list(enumerate(rng.normal(size=(60, 4)))))
    parts = shards.with_shard(b, 60, 4)
    q = b.where("id < 5")
    want = [(s, *tuple(r)) for s in range(4) for r in exact.knn_exact(q, parts.where(F.col("shard") == s), 3, "ip").collect()]
    monkeypatch.setattr(exact, "BROADCAST_BYTES", limit)
    assert sorted(map(tuple, exact.knn_by_shard(q, parts, 3, "ip").collect())) == sorted(want)


def test_ties_go_by_id_and_padding(spark):
    base = vecs(spark, [(3, (1, 0)), (1, (1, 0)), (2, (1, 0))])
    q = vecs(spark, [(0, (0, 0))])
    assert [r["neighbor_id"] for r in exact.knn_exact(q, base, 2, "l2").orderBy("rank").collect()] == [1, 2]
    pad = exact.padded(exact.knn_exact(q, base, 5, "l2"), q, 5).orderBy("rank").collect()
    assert [r["neighbor_id"] for r in pad] == [1, 2, 3, -1, -1] and pad[4]["dist"] is None


def test_errors(spark):
    with pytest.raises(ValueError):
        vectors.check_metric("hamming")
    with pytest.raises(ValueError):
        exact.BruteForceIndex(0)
    with pytest.raises(ValueError):
        bm25.Bm25Index(None, -1)
    with pytest.raises(Exception, match="dense"):
        shards.with_shard(spark.createDataFrame([(1,), (7,)], "id long"), 2, 2).collect()
    with pytest.raises(Exception):
        exact.knn_exact(vecs(spark, [(0, (0, 0))]), vecs(spark, [(0, (0, 0, 0))]), 1).collect()


def test_tokenize(spark):
    d = spark.createDataFrame([("The Éclair's 2 cats, naïve A",)], "t string")
    r = d.select(text.tokenize(F.col("t"), False).alias("a"), text.tokenize(F.col("t")).alias("b")).first()
    assert r["a"] == ["the", "Éclair", "s", "2", "cats", "naïve", "a"] and r["b"] == ["Éclair", "2", "cats", "naïve"]
    assert len(text.STOPWORDS) == 38


def test_clean(spark):
    d = spark.createDataFrame([(" see http://a.b/c  @josé_1 you\n",), (None,)], "t string")
    assert [r[0] for r in d.select(text.clean(F.col("t"))).collect()] == ["see you", ""]


def test_bm25_formula(spark, tmp_path):
    docs = ["fast fox", "a fox and a fox", "", "slow bear fox bear", "wolf"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    index = bm25.Bm25Index.build(d)
    toks = [[w for w in x.split() if w not in text.STOPWORDS] for x in docs]
    avg = sum(map(len, toks)) / len(toks)

    def score(q, t):
        s = 0
        for w in set(q):
            df, tf = sum(w in x for x in toks), t.count(w)
            if tf:
                s += math.log(1 + (len(toks) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
        return s

    q = spark.createDataFrame([(7, "fox fox bear"), (8, "none")], "query_id long, text string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in index.search(q, 10).collect()}
    want = {(7, i): score(["fox", "bear"], t) for i, t in enumerate(toks) if score(["fox", "bear"], t)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    keep = spark.createDataFrame([(1,)], "doc_id long")
    assert abs(index.search(q, 10, keep).first()["score"] - want[7, 1]) < 1e-9  # statistics stay
    index.save(str(tmp_path / "i"))
    again = bm25.Bm25Index.load(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, again.search(q).collect())) == sorted(map(tuple, index.search(q).collect()))
    assert dict(map(tuple, index.score("bear").collect()))[0] == 0.0


def test_rrf_and_recall(spark):
    def ranking(*ids):
        return spark.createDataFrame([(4, i + 1, x) for i, x in enumerate(ids)], "query_id long, rank int, id long")

    a, b, c = ranking(50, 60, 70, 80), ranking(-1, 70, 60), ranking(90)
    got = {r["id"]: r["score"] for r in fusion.rrf([a, b, c], 10, 9).collect()}
    want = {50: 1 / 10, 60: 1 / 11 + 1 / 12, 70: 1 / 12 + 1 / 11, 80: 1 / 13, 90: 1 / 10}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert [r["id"] for r in fusion.rrf([a, b, c], 4, 9).orderBy("rank").collect()] == [60, 70, 50, 90]  # ties by id
    assert fusion.rrf([], 3).count() == 0
    n = [x.withColumnRenamed("id", "neighbor_id") for x in (a, b)]
    one, two = (spark.createDataFrame([(i,) for i in ids], "id long") for ids in ([4], [4, 5]))
    assert fusion.recall_at_k(n[0], n[1], one, 2).first()["recall"] == 0  # the first two of either are others
    assert fusion.recall_at_k(n[0], n[0], one, 4).first()["recall"] == 1
    assert fusion.recall_at_k(n[0], n[0], two, 4).first()["recall"] == 0.5  # a query that found nothing counts
    assert fusion.recall_at_k(n[0].limit(0), n[0], two, 4).first()["recall"] == 0
    assert fusion.recall_at_k(n[0], n[0].limit(0), two, 4, True).first()["recall"] is None
    runs = spark.createDataFrame([("x", 100, 2.0), ("x", 100, 0.5), ("y", 100, 4.0)], "algo string, n int, s double")
    assert {r["algo"]: r["qps"] for r in fusion.qps(runs, ["algo"], "n", "s").collect()} == {"x": 200, "y": 25}


def test_shard_bounds():
    assert shards.shard_bounds(10, 4) == [(0, 0, 2), (1, 2, 5), (2, 5, 7), (3, 7, 10)]


@pytest.fixture(scope="module", params=["l2", "ip"])
def graphs(spark, request):
    """A thousand rows by metric, whole and in two additions; and the queries with their true neighbours."""
    rng = np.random.default_rng(7)
    base = vecs(spark, list(enumerate(rng.normal(size=(1000, 16)))))
    q = vecs(spark, [(10_000 + i, v) for i, v in enumerate(rng.normal(size=(40, 16)))])
    p = hnsw.HnswParams(request.param, 8, 64)
    whole = hnsw.HnswIndex.build(base, 2, p)
    grown = hnsw.HnswIndex.build(base.where("id % 3 = 0"), 2, p).add(base.where("id % 3 = 1")).add(base.where("id % 3 = 2"))
    truth = exact.knn_exact(q, base, 10, request.param).cache()
    return base, q, whole, grown, truth


def test_hnsw(spark, tmp_path, graphs):
    base, q, index, _, truth = graphs
    assert set(index.violations().first()) == {0}
    r = [fusion.recall_at_k(index.search(q, 10, ef), truth, q).first()["recall"] for ef in (10, 30, 100)]
    assert r[2] >= 0.95 and r[0] <= r[1] + 0.01 and r[1] <= r[2] + 0.01
    found = index.search(q, 10, 64, F.col("id") % 3 == 0)
    assert found.where("neighbor_id % 3 <> 0").count() == 0 and found.count() > 0
    assert index.search(q, 10, 64, F.lit(False)).count() == 0 and index.search(q, 10, 64, F.lit(False), exact_below=9999).count() == 0
    index.save(str(tmp_path / "h"))
    again = hnsw.HnswIndex.load(spark, str(tmp_path / "h"))
    assert again.params == index.params
    assert sorted(map(tuple, again.search(q, 5).collect())) == sorted(map(tuple, index.search(q, 5).collect()))


def test_hnsw_accessors(graphs):
    base, _, index, _, _ = graphs
    assert len(index) == 1000 and index.dim == 16 and index.metric == index.params.metric
    links = {r["neighbor_id"] for r in index.neighbors(17).collect()}
    shard = {r["id"]: r["shard"] for r in index.nodes.select("id", "shard").collect()}
    assert 0 < len(links) <= 16 and {shard[x] for x in links} == {shard[17]}
    assert index.neighbors(17, 99).count() == 0 and index.neighbors(5000).count() == 0
    assert index.vector(17).first()["vector"] == base.where("id = 17").first()["vector"]
    entries = {r["shard"]: r["level"] for r in index.entry_points().collect()}
    assert {r["shard"]: r["max_level"] for r in index.info().collect()} == entries and max(entries.values()) == index.max_level
    assert tuple(index.total_info().first()) == (1000, 16, 2)


def test_hnsw_grows_by_additions(spark, graphs):
    """Rows go into the graphs that are there: links of before are kept where nothing new came between."""
    base, q, _, grown, truth = graphs
    assert len(grown) == 1000 and set(grown.violations().first()) == {0}
    assert fusion.recall_at_k(grown.search(q, 10, 100), truth, q).first()["recall"] >= 0.95
    few = grown.add(vecs(spark, [(5000, [9.0] * 16)]))
    old, new = ({(r["id"], r["level"]): r["neighbors"] for r in x.links.collect()} for x in (grown, few))
    changed = [k for k in old if old[k] != new[k]]
    assert new[5000, 0] and len(changed) <= 2 * len(new[5000, 0]) + 20
    with pytest.raises(Exception, match="dimension"):
        grown.add(vecs(spark, [(5001, [1.0]), (5002, [1.0]), (5003, [1.0])]))


@pytest.mark.parametrize("share", [2, 3, 10, 100])
def test_hnsw_filters(graphs, share):
    base, q, index, _, _ = graphs
    keep = base.where(F.col("id") % share == 0)
    truth = exact.knn_exact(q, keep, 10, index.metric)
    graph = index.search(q, 10, 100, allowed=keep)
    assert graph.where(F.col("neighbor_id") % share != 0).count() == 0
    assert fusion.recall_at_k(graph, truth, q, 10, True).first()["recall"] >= 0.95
    scanned = sorted(map(tuple, index.search(q, 10, 10, allowed=keep, exact_below=1000).collect()))
    assert scanned == sorted(map(tuple, truth.collect()))
    if share == 2:
        assert sorted(map(tuple, index.search(q, 5, 50, allowed=base).collect())) == sorted(map(tuple, index.search(q, 5, 50).collect()))


def test_hnsw_heuristic_is_no_worse_and_levels_thin_out(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 12)) * 6
    base = vecs(spark, [(i, centres[i % 20] + rng.normal(size=12)) for i in range(600)])
    q = vecs(spark, [(9000 + i, centres[i % 20] + rng.normal(size=12)) for i in range(40)])
    truth = exact.knn_exact(q, base, 10, "l2").cache()
    r = [fusion.recall_at_k(hnsw.HnswIndex.build(base, 1, hnsw.HnswParams("l2", 6, 40, 42, h)).search(q, 10, 40), truth, q).first()["recall"] for h in (True, False)]
    assert r[0] >= r[1] - 0.01 and r[0] >= 0.9
    up = spark.range(20_000).select(hnsw.level_of(F.col("id"), 16).alias("l")).where("l >= 1").count() / 20_000
    assert 0.04 < up < 0.09


def test_shards_csv_and_arrays(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(25, 3)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(3)
    at = str(tmp_path / "s")
    shards.write_shards(rows, at, 4)
    got, manifest = shards.read_shards(spark, at)
    assert [tuple(r) for r in manifest.orderBy("shard").collect()] == [(i, a, b, b - a, 3) for i, a, b in shards.shard_bounds(25, 4)]
    for i, a, b in shards.shard_bounds(25, 4):
        assert sorted(r["id"] for r in spark.read.parquet(shards.shard_path(at, i)).collect()) == list(range(a, b)) == sorted(r["id"] for r in got.where(F.col("shard") == i).collect())
    made = shards.write_npy(rows, str(tmp_path / "n")).collect()
    back = {}
    for r in made:
        ids = np.load(tmp_path / "n" / f"{r['name']}-ids.npy")
        assert len(ids) == r["n"]
        back |= {int(i): v.tolist() for i, v in zip(ids, np.load(tmp_path / "n" / f"{r['name']}-vectors.npy"))}
    assert back == {i: v.tolist() for i, v in enumerate(x)}
    np.save(tmp_path / "one.npy", x)
    assert {r["id"]: r["vector"] for r in shards.read_npy(spark, str(tmp_path / "one.npy"), 7).collect()} == back
    np.save(tmp_path / "none.npy", x[:0])
    assert shards.read_npy(spark, str(tmp_path / "none.npy")).count() == 0
    t = spark.createDataFrame([(1, 'a, "b"\nc', 0.5), (2, None, None), (3, "é", -1.0)], "id long, text string, v double")
    shards.write_csv(t, str(tmp_path / "c"))
    assert sorted(map(tuple, shards.read_csv(spark, str(tmp_path / "c"), "id long, text string, v double", True).collect())) == sorted(map(tuple, t.collect()))


def test_ivf_is_the_same_sent_or_in_blocks(spark, monkeypatch):
    """With a hot cell, by either way, and against brute force over the probed cells."""
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=(300, 5)) * 0.1, rng.normal(size=(60, 5)) + 5]).astype(np.float32)
    rows = vecs(spark, list(enumerate(v)))
    cents = ivf.train(rows, 5, 2)
    cells = ivf.assign(rows, cents).cache()
    q = rows.where("id % 20 = 0")
    sent = sorted(map(tuple, ivf.ivf_search(q, cells, cents, 4, 2, "l2").collect()))
    monkeypatch.setattr(ivf, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(ivf, "BLOCK_ROWS", 32)
    assert sorted(map(tuple, ivf.ivf_search(q, cells, cents, 4, 2, "l2").collect())) == sent
    c = {r["id"]: np.float64(np.float32(r["vector"])) for r in cents.collect()}
    cell = {r["id"]: r["cell"] for r in cells.collect()}
    want = []
    for i in range(0, 360, 20):
        near = sorted((((np.float64(v[i]) - x) ** 2).sum(), k) for k, x in c.items())[:2]
        own = sorted((((np.float64(v[i]) - np.float64(v[j])) ** 2).sum(), j) for j in range(360) if cell[j] in {k for _, k in near})[:4]
        want += [(i, n + 1, j) for n, (_, j) in enumerate(own)]
    assert [x[:3] for x in sent] == want


def test_streamed_documents(spark, tmp_path):
    d = spark.createDataFrame([(0, "red fox"), (1, "red red bear")], "doc_id long, text string")
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    append.append_documents(s, str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination(60)
    q = spark.createDataFrame([(0, "red")], "query_id long, text string")
    assert sorted(map(tuple, append.appended_index(spark, str(tmp_path / "index")).search(q).collect())) == sorted(map(tuple, bm25.Bm25Index.build(d).search(q).collect()))


@pytest.mark.parametrize("name", ["knn_cosine", "knn_filter_label", "bm25_search", "rrf_vectors", "ivf_search", "text_tokenize", "qps_at_recall", "knn_l2_offset", "recall_with_empty", "shard_answers"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    q = c.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, SF)
    cols = sorted(q.columns)
    assert cols == sorted(df.columns)
    want = sorted(str([r[q.columns.index(x)] for x in cols]) for r in q.fetchall())
    assert sorted(str([r[x] for x in cols]) for r in df.collect()) == want


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_many_queries_meet_the_base_in_blocks(spark, monkeypatch, metric):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)], "id long, vector array<float>")
    sent = sorted(map(tuple, exact.knn_exact(rows, rows, 7, metric).collect()))
    monkeypatch.setattr(exact, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(exact, "BLOCK_ROWS", 64)
    met = sorted(map(tuple, exact.knn_exact(rows, rows, 7, metric).collect()))
    assert [x[:3] for x in met] == [x[:3] for x in sent] and np.allclose([x[3] for x in met], [x[3] for x in sent])
    with pytest.raises(Exception, match="dimension"):
        exact.knn_exact(rows, spark.createDataFrame([(1, [1.0])], "id long, vector array<float>"), 7, metric).collect()


def test_cells_are_the_same_sent_or_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(200)], "id long, vector array<float>")
    cents = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(9)], "id long, vector array<double>")
    sent = sorted((r["id"], r["cell"]) for r in ivf.assign(rows, cents).collect())
    monkeypatch.setattr(ivf, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(exact, "BROADCAST_BYTES", 0)
    assert sorted((r["id"], r["cell"]) for r in ivf.assign(rows, cents).collect()) == sent
    c = np.array([r["vector"] for r in cents.orderBy("id").collect()])
    assert sent == [(r["id"], int(((c - np.array(r["vector"])) ** 2).sum(1).argmin())) for r in rows.orderBy("id").collect()]


def test_graph_search_in_groups_of_queries_with_an_id_mask(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = vecs(spark, [(i, rng.normal(size=8)) for i in range(150)])
    index = hnsw.HnswIndex.build(rows, 2, hnsw.HnswParams("l2", 8, 48))
    whole = sorted(map(tuple, index.search(rows, 5, 40).collect()))
    monkeypatch.setattr(hnsw, "QUERIES_A_GROUP", 20)
    assert sorted(map(tuple, index.search(rows, 5, 40).collect())) == whole
    few = rows.where("id % 7 = 0")
    found = index.search(rows, 5, 150, allowed=few)
    assert {r["neighbor_id"] % 7 for r in found.collect()} == {0}
    assert fusion.recall_at_k(found, exact.knn_exact(rows, rows, 5, "l2", allowed=few), rows, 5, True).first()["recall"] > 0.95


def test_split_of_all_rows(spark):
    import hashlib

    ids = [*range(3000), 7, 7]
    d = spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)
    want = sorted(ids, key=lambda i: (hashlib.md5(f"42-{i}".encode()).hexdigest(), i))
    for limit, n in ((0, len(ids)), (400, 450)):
        got = text.query_base_split(d, "id", 50, limit).orderBy("position").collect()
        assert [(r["id"], r["position"], r["is_query"]) for r in got] == [(i, p + 1, p < 50) for p, i in enumerate(want[:n])]


def spoilt(v):
    """Rows (id, vector) with values that are no finite 32-bit floats."""
    rows = [(i, x.tolist()) for i, x in enumerate(np.float64(np.float32(v)))]
    for i, x in ((3, float("nan")), (11, float("inf")), (12, float("-inf")), (13, 1e300)):
        rows[i][1][1] = x
    return rows


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_rows_that_are_not_finite_take_no_part(spark, monkeypatch, metric):
    """NaN, infinities and overflow as base rows, queries and centroids, and rows without id: the others fare as if they weren't there."""
    rng = np.random.default_rng(8)
    rows = spoilt(rng.normal(size=(400, 6)))
    bad = {3, 11, 12, 13}
    df = spark.createDataFrame([*rows, (None, [0.0] * 6), (None, [float("nan")] * 6)], "id long, vector array<double>").repartition(2)
    clean = spark.createDataFrame([r for r in rows if r[0] not in bad], "id long, vector array<double>")
    asked, clean_asked = df.where("id < 40 OR id IS NULL"), clean.where("id < 40")
    told = lambda found: sorted((r["query_id"], r["rank"], r["neighbor_id"]) for r in found.collect())
    want = told(exact.knn_exact(clean_asked, clean, 5, metric))
    assert len(want) == 36 * 5
    assert told(exact.knn_exact(asked, df, 5, metric)) == want  # sent
    assert told(exact.knn_expr(asked, df, 5, metric)) == want
    assert told(exact.knn_rounds(asked, df, 5, metric, 1)) == want
    shard = df.withColumn("shard", F.coalesce(F.col("id") % 3, F.lit(0)).cast("int"))
    assert told(fusion.merge_shards(exact.knn_by_shard(asked, shard, 5, metric), 5)) == want
    assert told(exact.BruteForceIndex(6, metric).add(df).search(asked, 5)) == want
    p = hnsw.HnswParams(metric, 8, 48)
    graph = hnsw.HnswIndex.build(df, 2, p)
    assert len(graph) == 396
    assert told(graph.search(asked, 5, 40)) == told(hnsw.HnswIndex.build(clean, 2, p).search(clean_asked, 5, 40))
    assert told(graph.search(asked, 5, 40, where=F.lit(True), exact_below=10_000)) == want
    cents = ivf.train(df, 8, 2)
    assert told(cents.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.size("vector").alias("neighbor_id"))) == told(ivf.train(clean, 8, 2).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.size("vector").alias("neighbor_id")))
    holed = cents.unionByName(spark.createDataFrame([(9999, [float("nan")] * 6)], "id long, vector array<double>"))
    cells = ivf.assign(df, holed).cache()
    assert cells.count() == 396 and cells.where("cell = 9999").count() == 0
    assert told(ivf.ivf_search(asked, cells, holed, 5, 8, metric)) == want
    monkeypatch.setattr(ivf, "BROADCAST_BYTES", 0)
    assert told(ivf.ivf_search(asked, cells, holed, 5, 8, metric)) == want
    assert told(exact.knn_exact(df, df, 5, metric, send=0)) == told(exact.knn_exact(clean, clean, 5, metric))  # in blocks
    assert exact.knn_exact(df.where("id = 3"), df, 5, metric).count() == 0


def test_documents_without_id_take_no_part(spark):
    d = spark.createDataFrame([(0, "red fox"), (1, "red red bear"), (None, "red")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "red"), (None, "red")], "query_id long, text string")
    found = lambda d, q: sorted(map(tuple, bm25.Bm25Index.build(d).search(q).collect()))
    assert found(d, q) == found(d.where("doc_id IS NOT NULL"), q.where("query_id = 0")) and len(found(d, q)) == 2


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_rounds_of_queries(spark, metric):
    """Several rounds, bounds from a part of the base, ties; the base's vectors meet no exchange."""
    rng = np.random.default_rng(13)
    v = rng.normal(size=(900, 16)).astype(np.float32)
    v[50:60] = v[40]
    base = vecs(spark, list(enumerate(v))).repartition(5)
    q = vecs(spark, [(i, np.tile(x, 1)) for i, x in enumerate(v[:700])])
    assert sorted(map(tuple, exact.knn_rounds(q, base, 7, metric, 1 << 15).collect())) == sorted(map(tuple, exact.knn_exact(q, base, 7, metric).collect()))
    few = base.where("id < 5")
    assert sorted(map(tuple, exact.knn_rounds(q, few, 7, metric).collect())) == sorted(map(tuple, exact.knn_exact(q, few, 7, metric).collect()))
    assert exact.knn_rounds(q.where("id < 0"), base, 7, metric).count() == 0
    sent = spark.sparkContext.broadcast((np.arange(3), np.float64(v[:3]), np.full(3, 0.5)))
    plan = exact.top_k(exact._scanned(base, sent, 16, 7, metric), ["query_id"], ["dist"], 7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") > plan.index("Window") and plan.count("Join") == 0


def test_sql_functions(spark):
    """As the columns of the same names, for nulls and zeros too."""
    sql.register(spark)
    sql.register(spark)
    rows = spark.createDataFrame([(1, [3.0, 4.0], [1.0, -1.0], "The Fox's DÉN 42"), (2, [0.0, 0.0], [2.0, 1.0], ""), (3, None, [1.0, 1.0], None)], "id long, a array<double>, b array<double>, text string")
    got = spark.sql("SELECT id, vec_dot(a, b) AS dot, vec_l2(a, b) AS l2, vec_ip(a, b) AS ip, vec_normalize(a) AS u, text_tokens(text) AS t, text_terms(text) AS s FROM {r}", r=rows)
    a, b, t = F.col("a"), F.col("b"), F.col("text")
    want = rows.select("id", vectors.dot(a, b).alias("dot"), vectors.l2_sq(a, b).alias("l2"), vectors.distance("ip", a, b).alias("ip"), vectors.normalize(a).alias("u"), text.tokenize(t, False).alias("t"), text.tokenize(t).alias("s"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    told = spark.sql("SELECT id, position, token FROM {r}, LATERAL tokenize(text)", r=rows).collect()
    assert sorted(map(tuple, told)) == [(1, i, w) for i, w in enumerate(["the", "fox", "s", "dÉn", "42"])]


def test_resumable_work(spark, tmp_path):
    """A run that fails half-way goes on: what is committed is not done again, what isn't is; the result is that of one run."""
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(60)] + [(None, "none")], "id long, text string")
    work = lambda df: df.select("id", F.upper("text").alias("up"))
    path = str(tmp_path / "r")
    calls = []

    def fails(df):
        calls.append(1)
        bad = len(calls) == 4  # the first call asks for the schema, then a call a chunk
        return work(df).withColumn("up", F.when(F.lit(bad), F.raise_error(F.lit("stopped"))).otherwise(F.col("up")))

    with pytest.raises(Exception, match="stopped"):
        resumable.resumable(rows, path, fails, 10).collect()
    assert resumable.committed(spark, path) == {0, 1}
    calls.clear()

    def counted(df):
        calls.append(1)
        return work(df)

    got = resumable.resumable(rows, path, counted, 10)
    assert len(calls) == 1 + 7 - 2 and sorted(map(str, got.collect())) == sorted(map(str, work(rows).collect()))
    calls.clear()
    assert resumable.resumable(rows, path, counted, 10).count() == 61 and len(calls) == 1
    with pytest.raises(ValueError, match="not those"):
        resumable.resumable(rows.where("id < 9"), path, work, 10)
    assert resumable.resumable(rows.where("id > 99"), str(tmp_path / "e"), work).count() == 0
