"""Inverted files: rows by nearest centroid, of which a query reads the nearest few."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import check_metric
from ..storage import new_path, stored
from .exact import BLOCK_ROWS, BROADCAST_BYTES, FINITE, finite, knn_exact, measured, nearest_rows, rows_of, taken, top_k, whole


def centroids(rows: DataFrame, cell: str) -> DataFrame:
    """(id, vector): the mean vector of each cell, of finite rows."""
    rows = rows.where(FINITE)
    e = rows.select(F.col(cell).cast("long").alias("id"), F.posexplode(F.col("vector").cast("array<double>")).alias("p", "x"))
    means = e.groupBy("id", "p").agg(F.avg("x").alias("x"))
    return means.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("vector"))


def train(rows: DataFrame, nlist: int | None = None, rounds: int = 5, seed: int = 42) -> DataFrame:
    """(id, vector): nlist centroids (4 * sqrt(n) if not given) after so many rounds of moving each to its rows' mean.

    They start from the rows that come first by a seeded digest of the id. Cells that lose all rows disappear."""
    n, _ = measured(rows)
    order = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string")))
    cents = rows.where("id IS NOT NULL").where(FINITE).orderBy(order, "id").limit(nlist or max(1, round(4 * n**0.5)))
    cents = cents.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    for _ in range(rounds):
        cents = stored(centroids(assign(rows, cents), "cell"), "cells")  # cuts the lineage of the rounds
    return cents


def assign(rows: DataFrame, cents: DataFrame) -> DataFrame:
    """rows(id, vector) with the column cell: the nearest centroid; rows without id or with a component that isn't finite are left out.

    Centroids are sent to the tasks if they measure small, and rows aren't shuffled; more of them meet the rows in blocks."""
    n, dim = measured(cents)
    if n * dim * 8 > BROADCAST_BYTES:
        near = knn_exact(rows, cents, 1, "l2")
        return rows.select("id", "vector").join(near.select(F.col("query_id").alias("id"), F.col("neighbor_id").alias("cell")), "id")
    sent = rows.sparkSession.sparkContext.broadcast(taken(cents))

    def run(batches):
        import pyarrow as pa

        ids, v = sent.value
        for batch in batches:
            if batch.num_rows and len(ids):
                x = rows_of(batch.column(1), dim)
                ok = np.isfinite(x).all(axis=1)
                batch = batch.filter(pa.array(ok))
                _, which, _ = nearest_rows(x[ok], ids, v, 1, "l2")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids[which])], ["id", "vector", "cell"])

    return rows.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector")).mapInArrow(run, "id long, vector array<float>, cell long")


def probed(queries: DataFrame, cents: DataFrame, nprobe: int) -> DataFrame:
    """(query_id, cell): the nprobe nearest cells of each query."""
    return knn_exact(queries, cents, nprobe, "l2").select("query_id", F.col("neighbor_id").alias("cell"))


def ivf_search(queries: DataFrame, cells: DataFrame, cents: DataFrame, k: int, nprobe: int, metric: str, probes: DataFrame | None = None) -> DataFrame:
    """The k nearest among rows of each query's nprobe nearest cells, by matrix products.

    Queries with their cells are sent to the tasks that scan the rows if they measure small; no row is shuffled then,
    however many are in one cell. More of them meet the rows in blocks: BLOCK_ROWS rows of a cell and as many of its queries in a group."""
    metric = check_metric(metric)
    n, dim = measured(queries)
    spark = cells.sparkSession
    schema = "query_id long, neighbor_id long, dist double"
    if not n or k <= 0:
        return spark.createDataFrame([], "query_id long, rank int, neighbor_id long, dist double")
    if probes is None:
        probes = probed(queries, cents, nprobe)
    rows = cells.where("id IS NOT NULL").select("id", whole(dim).alias("vector"), F.col("cell").cast("long").alias("cell"))

    def near(ids, q, own, v):
        own, v = finite(own, v)
        at, which, dist = nearest_rows(q, own, v, k, metric)
        return [ids[at], own[which], dist]

    if n * (dim + nprobe) * 8 <= BROADCAST_BYTES:
        ids, q = taken(queries)
        found = probes.collect()  # nprobe a query
        by: dict[int, list[int]] = {}
        place = {int(x): i for i, x in enumerate(ids)}
        for r in found:
            by.setdefault(r["cell"], []).append(place[r["query_id"]])
        sent = spark.sparkContext.broadcast((ids, q, by))

        def scan(batches):
            import pyarrow as pa

            ids, q, by = sent.value
            for batch in batches:
                cell = batch.column(2).to_numpy()
                for c in np.unique(cell):
                    asking = by.get(int(c))
                    if asking:
                        part = batch.filter(pa.array(cell == c))
                        made = near(ids[asking], q[asking], part.column(0).to_numpy(), rows_of(part.column(1), dim))
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["query_id", "neighbor_id", "dist"])

        out = rows.mapInArrow(scan, schema)
    else:
        asked = probes.join(queries.select(F.col("id").alias("query_id"), whole(dim).alias("q")), "query_id")
        sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("n_i"))
        asks = probes.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("n_j"))
        both = F.broadcast(sizes.join(asks, "cell"))  # a row per cell, fewer than centroids
        deal = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = rows.join(both, "cell").select("cell", deal("id", "n_i", 1).alias("i"), every("n_j").alias("j"), "id", "vector")
        right = asked.join(both, "cell").select("cell", every("n_i").alias("i"), deal("query_id", "n_j", 2).alias("j"), "query_id", "q")

        def meet(a, b):
            import pyarrow as pa

            if not a.num_rows or not b.num_rows:
                made = [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())]
            else:
                made = near(b["query_id"].to_numpy(), rows_of(b["q"].combine_chunks(), dim), a["id"].to_numpy(), rows_of(a["vector"].combine_chunks(), dim))
            return pa.table([pa.array(x) for x in made], ["query_id", "neighbor_id", "dist"])

        out = left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInArrow(meet, schema)
    return top_k(out, ["query_id"], ["dist", "neighbor_id"], k).select("query_id", "rank", "neighbor_id", "dist")


#: Cells share so many folders at most; so many cells are told to a scan at most.
FOLDERS, NAMED = 1024, 4096


@dataclass
class IvfIndex:
    """A stored inverted file: rows (id, vector, cell) in folders of cells, sorted by cell, with centroids and meta beside them.

    A search tells the scan which cells are probed: other folders are pruned, and of a folder that holds several cells only the row groups of those are read. Rows
    that are added go to the cells that are there, as files of their own. Rows without id or with a component that isn't finite are left out."""

    spark: object
    path: str
    metric: str

    @classmethod
    def build(cls, rows: DataFrame, metric: str = "l2", path: str | None = None, nlist: int | None = None, rounds: int = 5, seed: int = 42) -> IvfIndex:
        """The index of rows(id, vector), under path or in the shared folder."""
        spark = rows.sparkSession
        out = cls(spark, path or new_path(spark, "ivf"), check_metric(metric))
        train(rows, nlist, rounds, seed).write.parquet(f"{out.path}/cents")
        out.add(rows)
        spark.createDataFrame([(1, out.metric)], "version int, metric string").write.parquet(f"{out.path}/meta")
        return out

    @classmethod
    def load(cls, spark, path: str) -> IvfIndex:
        return cls(spark, path, spark.read.parquet(f"{path}/meta").first()["metric"])

    @property
    def cents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cents")

    @property
    def cells(self) -> DataFrame:
        """All rows: those of add, and those of batches of a stream."""
        held = self.spark.read.schema("id long, vector array<float>, cell long, folder int").parquet(f"{self.path}/rows")
        streamed = self.streamed()
        return held if streamed is None else held.unionByName(streamed.select(held.columns))

    def streamed(self) -> DataFrame | None:
        """The rows of batches, with run and batch; None where there are none."""
        try:
            return self.spark.read.schema("id long, vector array<float>, cell long, run string, batch long, folder int").parquet(f"{self.path}/streamed")
        except AnalysisException:
            return None

    def add(self, rows: DataFrame) -> IvfIndex:
        """Rows go to the cells that are there, as new files; a job that fails commits none. Large cells go over several files."""
        self._dealt(rows).write.mode("append").partitionBy("folder").parquet(f"{self.path}/rows")
        return self

    def add_batch(self, rows: DataFrame, run: str, batch: int) -> IvfIndex:
        """As add, for a batch of a stream: a batch that comes again takes the place of what it left."""
        self._dealt(rows).write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/streamed/run={run}/batch={batch}")
        return self

    def _dealt(self, rows: DataFrame) -> DataFrame:
        placed = stored(assign(rows, self.cents), "placed")
        sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / 100_000).alias("files"))  # a row a cell
        dealt = placed.join(F.broadcast(sizes), "cell") if self.cents.count() * 16 <= BROADCAST_BYTES else placed.join(sizes, "cell")
        dealt = dealt.select("id", "vector", "cell", F.pmod(F.xxhash64("cell"), F.lit(FOLDERS)).cast("int").alias("folder"), F.pmod(F.xxhash64("id"), F.col("files")).alias("file"))
        return dealt.repartition("folder", "file").sortWithinPartitions("folder", "cell").drop("file")

    def pruned(self, probes: DataFrame) -> DataFrame:
        """The rows of the cells of probes(query_id, cell)."""
        cells = probes.select("cell").distinct()
        named = [tuple(r) for r in cells.select("cell", F.pmod(F.xxhash64("cell"), F.lit(FOLDERS)).cast("int")).limit(NAMED + 1).collect()]
        if len(named) > NAMED:  # the join prunes folders when it runs
            folder = F.pmod(F.xxhash64("cell"), F.lit(FOLDERS)).cast("int").alias("folder")
            return self.cells.join(cells.select("cell", folder), ["folder", "cell"], "left_semi").select("id", "vector", "cell")
        return self.cells.where(F.col("folder").isin(sorted({f for _, f in named}))).where(F.col("cell").isin([c for c, _ in named])).select("id", "vector", "cell")

    def search(self, queries: DataFrame, k: int = 10, nprobe: int = 8) -> DataFrame:
        probes = stored(probed(queries, self.cents, nprobe), "probes")
        return ivf_search(queries, self.pruned(probes), self.cents, k, nprobe, self.metric, probes)
