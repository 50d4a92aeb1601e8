"""Bit masks of filtered graphs, and array files as a data source."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import exact, fusion, graph_shards, hnsw, masks
from lodestone.sources import npy


def vecs(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, vector array<float>")


def ids(spark, values):
    return spark.createDataFrame([(x,) for x in values], "id long")


def told(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


EDGES = [0, 1, 62, 63, 64, 65, -1, -63, -64, -65, 2**62, -(2**63), 2**63 - 1, 5, 5, None]


def test_masks_are_sets(spark):
    a, b = masks.of(ids(spark, EDGES)), masks.of(ids(spark, [5, 64, 7, -1]))
    members = lambda m: sorted(r["id"] for r in masks.ids_of(m).select("id").collect())
    one, two = {x for x in EDGES if x is not None}, {5, 64, 7, -1}
    assert members(a) == sorted(one) and masks.size(a).first()["n"] == len(one)
    assert members(masks.union(a, b)) == sorted(one | two)
    assert members(masks.both(a, b)) == sorted(one & two) and members(masks.without(a, b)) == sorted(one - two)
    none = masks.of(ids(spark, []))
    assert members(none) == [] and masks.size(none).first()["n"] == 0 and members(masks.without(a, none)) == sorted(one)
    word, bits = (np.array([r[c] for r in a.collect()], np.int64) for c in ("word", "bits"))
    probe = np.array(sorted(one | two | {2, 128, -2}), np.int64)
    assert [x in one for x in probe.tolist()] == masks.holds(word, bits, probe).tolist()
    assert not masks.holds(word[:0], bits[:0], probe).any()


def test_words_reach_every_shard_they_overlap(spark):
    """Ranges narrower than a word, on a word's ends and beyond all."""
    begins = [3, 10, 64, 70, 1000]
    got = masks.by_range(masks.of(ids(spark, range(-5, 1100))), begins).collect()
    bits = {(r["shard"], r["word"]): r["bits"] for r in got}
    assert len(bits) == len(got)
    for i in range(-5, 1100):
        shard = int(np.searchsorted(begins, i, "right"))
        assert bits[shard, i >> 6] >> (i & 63) & 1
    assert {s for s, w in bits if w == 0} == {0, 1, 2} and {s for s, w in bits if w == 15} == {4, 5}
    hashed = masks.by_hash(masks.of(ids(spark, range(300))), 7)
    want = {(r["s"], r["id"]) for r in spark.range(300).select("id", F.pmod(F.xxhash64("id"), F.lit(7)).alias("s")).collect()}
    assert {(r["shard"], r["id"]) for r in masks.ids_of(hashed).collect()} == want


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_a_masked_graph_answers_as_a_joined_one(spark, tmp_path, monkeypatch, metric):
    """Hashed and range shards, walked and scanned, with a condition besides, in groups of queries; negative and unknown ids."""
    rng = np.random.default_rng(8)
    rows = vecs(spark, [(i - 40, rng.normal(size=8)) for i in range(400)])
    p = hnsw.HnswParams(metric, 12, 80)
    allowed = ids(spark, [*range(-40, 200, 3), 99_999, None, 11, 11])
    mask = masks.of(allowed)
    hashed = hnsw.HnswIndex.build(rows, 3, p)
    ranged = graph_shards.HnswShards.build(rows, str(tmp_path / "g"), p, 130)
    truth = exact.knn_exact(rows, rows, 5, metric, allowed=allowed)
    for size in (65_536, 50):
        monkeypatch.setattr(hnsw, "QUERIES_A_GROUP", size)
        for index in (hashed, ranged):
            got = index.search(rows, 5, 100, mask=mask)
            assert told(got) == told(index.search(rows, 5, 100, allowed=allowed))
            assert fusion.recall_at_k(got, truth, rows, 5, True).first()["recall"] >= 0.9
    assert told(ranged.search(rows, 5, mask=mask, exact_below=9999)) == told(truth)
    odd = F.col("id") % 2 == 1
    assert told(ranged.search(rows, 5, where=odd, mask=mask, exact_below=9999)) == told(exact.knn_exact(rows, rows, 5, metric, odd, allowed))
    assert hashed.search(rows, 5, mask=masks.of(ids(spark, []))).count() == 0 == ranged.search(rows, 5, mask=masks.of(ids(spark, [7777]))).count()
    plan = ranged.search(rows, 5, 100, mask=mask)._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" not in plan and "SortMergeJoin" not in plan
    with pytest.raises(ValueError):
        ranged.index.add(rows)


@pytest.fixture
def arrays(spark):
    npy.register(spark)
    return spark


def test_array_files_go_round(arrays, tmp_path):
    """Several files a task, appending, overwriting, plain arrays, types and empty tables."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(101, 3)).astype(np.float32)
    x[4, 1], x[5, 2] = np.nan, np.inf
    rows, at = vecs(arrays, [(1000 - i, v) for i, v in enumerate(x)]).repartition(3), str(tmp_path / "t")
    same = lambda df: {r["id"]: np.float32(r["vector"]).tobytes() for r in df.collect()}
    rows.where("id > 950").write.format("npy").option("rows_per_file", 8).mode("append").save(at)
    rows.where("id <= 950").write.format("npy").mode("append").save(at)
    back = arrays.read.format("npy").option("rows_per_partition", 5).load(at)
    assert same(back) == same(rows) and back.rdd.getNumPartitions() > 20
    held = {y for f in json.load(open(f"{at}/manifest.json"))["files"] for y in (f["vectors"], f["ids"])}
    assert held | {"manifest.json"} == set(os.listdir(at))
    rows.where("id = 950").write.format("npy").mode("overwrite").save("file://" + at)
    assert same(arrays.read.format("npy").load(at)) == same(rows.where("id = 950")) and len(os.listdir(at)) == 3
    rows.limit(0).write.format("npy").mode("overwrite").save(at)
    assert arrays.read.format("npy").load(at).count() == 0 and os.listdir(at) == ["manifest.json"]
    for dtype in (np.float32, np.float64, np.int16):
        y = (x[10:] * 10).astype(dtype)
        np.save(tmp_path / "one.npy", y)
        got = arrays.read.format("npy").option("rows_per_partition", 7).load(str(tmp_path / "one.npy"))
        assert same(got) == {i: v.astype(np.float32).tobytes() for i, v in enumerate(y)}
    np.save(tmp_path / "none.npy", x[:0])
    assert arrays.read.format("npy").load(str(tmp_path / "none.npy")).count() == 0


def test_array_files_of_lost_tasks_are_no_rows(arrays, tmp_path):
    """An attempt that wrote and was not committed leaves nothing; a failed job leaves the table as it was."""
    at = str(tmp_path / "t")
    rows = vecs(arrays, [(i, [i, 1]) for i in range(20)]).repartition(2)
    rows.write.format("npy").mode("append").save(at)
    before = sorted(os.listdir(at))
    writer = npy.NpyWriter(at, False, 10)
    for name in ("vectors", "ids"):  # what an attempt left whose executor was lost after it wrote
        np.save(f"{at}/{writer.job}-000000-9-aa-0000-{name}.npy", np.zeros((2, 2), np.float32))
    writer.commit([npy.Wrote(), None])
    assert sorted(os.listdir(at)) == before and arrays.read.format("npy").load(at).count() == 20
    bad = F.expr("CASE WHEN id = 19 THEN array(1F) ELSE vector END").alias("vector")
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="one length|another dimension"):
            rows.select("id", bad).write.format("npy").option("rows_per_file", 2).mode(mode).save(at)
        assert sorted(os.listdir(at)) == before
    for wrong in ("CAST(NULL AS array<float>)", "array(1F, NULL)"):
        with pytest.raises(Exception, match="must not be null"):
            rows.select("id", F.expr(wrong).alias("vector")).write.format("npy").mode("append").save(at)
    with pytest.raises(Exception, match="hold id and vector"):
        rows.withColumn("x", F.lit(1)).write.format("npy").mode("append").save(at)
    assert arrays.read.format("npy").load(at).count() == 20
