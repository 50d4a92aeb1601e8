"""Connected components of a table of links; only few links are brought together in one place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored

#: So many links (16 MB) are gathered in one task; more of them stay distributed.
TOGETHER = 1_000_000


def _forest(batches):
    """Of the links of each batch, one to the smallest node of each of its components for every other node."""
    import pyarrow as pa

    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, root[x], low)
            np.minimum.at(new, root[y], low)
            new = new[new]
            new = new[new]
            if (new == root).all():
                break
            root = new
        i = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[root[i]])], ["a", "b"])


def _forest_of_all(batches):
    import pyarrow as pa

    if rows := pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())])).combine_chunks().to_batches():
        yield from _forest(rows)


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.where("m < a").select("a", F.col("m").alias("b"))).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for each node of links(a, b): comp is the smallest node that it is connected with.

    Links are thinned to forests by batch. If few are left, one task does the rest; else the large-star and small-star steps
    alternate until nothing changes: minima are aggregated by partial sums, so a node with very many links is no single task's work."""
    e = stored(links.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long").distinct(), "links")
    if e.count() <= TOGETHER:
        last = stored(e.repartition(1).mapInArrow(_forest_of_all, "a long, b long"), "links")
        drop(e)
        return _labels(last)
    said = None
    while True:  # each round that changes anything lowers an end; there are O(log(nodes) ** 2)
        last, e = e, stored(_small_star(_large_star(e)), "links")
        drop(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == said or not now[0]:
            break
        said = tuple(now)
    return _labels(e)


def _labels(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
