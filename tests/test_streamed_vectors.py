"""Inverted files that grow from a stream."""

import numpy as np
import pytest

from lodestone.operators import exact, ivf
from lodestone.storage import new_path
from lodestone.streaming import vectors

SCHEMA = "id long, vector array<float>"


def told(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.fixture(scope="module")
def table(spark):
    """120 rows around five centres."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(5, 4))[rng.integers(0, 5, 120)] * 4 + rng.normal(size=(120, 4))
    return spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], SCHEMA)


class Feed:
    """A folder of files, each a batch."""

    def __init__(self, spark, at):
        self.spark, self.at = spark, str(at)

    def put(self, rows):
        rows.select("id", "vector").coalesce(1).write.mode("append").parquet(self.at)

    def run(self, index, checkpoint):
        s = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.at)
        q = vectors.append_vectors(s, index, str(checkpoint))
        assert q.awaitTermination(120)
        return q


def test_a_streamed_index_is_the_batch_one(spark, table, tmp_path):
    """Rows in several batches, some of them twice, some that the index held before, some that can't be measured; then what comes later, and a new checkpoint."""
    whole = ivf.IvfIndex.build(table, "l2", str(tmp_path / "w"), nlist=5, rounds=2)
    index = ivf.IvfIndex(spark, str(tmp_path / "s"), "l2")
    whole.cents.write.parquet(f"{index.path}/cents")
    index.add(table.where("id < 30"))
    feed = Feed(spark, tmp_path / "in")
    feed.put(spark.createDataFrame([(50, [float("nan")] * 4), (None, [1.0] * 4), (5, [9.0] * 4)], SCHEMA))  # 5 is held; 50 comes again
    feed.put(table.where("id BETWEEN 20 AND 79"))
    feed.put(table.where("id BETWEEN 20 AND 79"))
    feed.run(index, tmp_path / "c")
    assert told(index.cells.select("id", "cell")) == told(whole.cells.where("id < 80").select("id", "cell"))
    feed.put(table.where("id >= 60"))
    feed.run(index, tmp_path / "c")
    want = told(whole.cells.select("id", "cell"))
    assert told(index.cells.select("id", "cell")) == want
    q = table.where("id % 10 = 5")
    assert told(index.search(q, 6, 5)) == told(exact.knn_exact(q, table, 6, "l2")) and told(index.search(q, 6, 2)) == told(whole.search(q, 6, 2))
    feed.run(index, tmp_path / "c")  # nothing new
    feed.run(index, tmp_path / "other")  # all of it again, with no memory of it
    assert told(index.cells.select("id", "cell")) == want
    assert index.streamed().select("run").distinct().count() == 1


def test_a_batch_that_stopped_runs_again(spark, table, tmp_path, monkeypatch):
    """A batch fails after it wrote its rows, before it is committed: its second run leaves each row once."""
    index = ivf.IvfIndex.build(table.where("id < 30"), "l2", str(tmp_path / "s"), nlist=5, rounds=2)
    feed = Feed(spark, tmp_path / "in")
    feed.put(table.where("id BETWEEN 30 AND 59"))
    feed.put(table.where("id >= 60"))
    real, calls = ivf.IvfIndex.add_batch, []

    def add_batch(self, rows, run, batch):
        real(self, rows, run, batch)
        calls.append(batch)
        if len(calls) == 2:
            raise RuntimeError("lost")

    monkeypatch.setattr(ivf.IvfIndex, "add_batch", add_batch)
    with pytest.raises(Exception, match="lost"):
        feed.run(index, tmp_path / "c")
    feed.run(index, tmp_path / "c")
    assert calls == [0, 1, 1]
    assert sorted(r["id"] for r in index.cells.select("id").collect()) == list(range(120))
    assert told(index.search(table, 3, 5)) == told(exact.knn_exact(table, table, 3, "l2"))


def test_ids_are_sent_or_joined(spark, table, monkeypatch):
    index = ivf.IvfIndex.build(table.where("id < 30"), "l2", new_path(spark, "s"), nlist=3, rounds=1)
    for limit in (1 << 25, 0):
        monkeypatch.setattr(vectors, "BROADCAST_BYTES", limit)
        assert sorted(r["id"] for r in vectors._unknown(index, table.where("id BETWEEN 25 AND 34"), "r", 0).collect()) == list(range(30, 35))


def test_null_vectors_stop_the_stream(spark, table, tmp_path):
    index = ivf.IvfIndex.build(table.where("id < 30"), "l2", str(tmp_path / "s"), nlist=3, rounds=1)
    feed = Feed(spark, tmp_path / "in")
    feed.put(spark.createDataFrame([(100, None)], SCHEMA))
    with pytest.raises(Exception, match="must not be null"):
        feed.run(index, tmp_path / "c")
    assert index.cells.count() == 30 and index.streamed() is None
