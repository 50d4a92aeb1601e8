"""Graphs over contiguous ranges of ids, with a manifest that knows each shard's files.

How many shards there are follows from the number of rows. A version is a manifest, a row a shard: its range of ids, its rows and the folder its nodes lie in. Adding
rows inserts them into the graphs of the ranges they fall in, writes only those shards anew and then a manifest that names the new
folders beside the old ones: files of other shards stay, older versions can still be read, and a job that fails leaves the last version as it
was. Rows beyond all ranges make shards of their own.

Cases: rows without id or with a component that isn't finite are left out, null vectors are an error, as is an id that is there already; an empty table makes an index
without shards."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import new_path, stored
from .exact import FINITE
from .hnsw import NODES, HnswIndex, HnswParams, level_of

#: So many rows a shard, about: a task holds one, with its links.
SHARD_ROWS = 20_000
MANIFEST = "shard int, lo long, hi long, n long, folder string"


def shards_for(n: int, shard_rows: int = SHARD_ROWS) -> int:
    return -(-n // shard_rows)


@dataclass
class HnswShards:
    spark: object
    path: str
    params: HnswParams
    version: int

    @classmethod
    def build(cls, rows: DataFrame, path: str | None = None, params: HnswParams = HnswParams(), shard_rows: int = SHARD_ROWS) -> HnswShards:
        """The index of rows(id, vector). A folder that holds an index already is an error: open() reads it."""
        spark = rows.sparkSession
        out = cls(spark, path or new_path(spark, "shards"), params, 0)
        meta = [(1, shard_rows, *asdict(params).values())]
        spark.createDataFrame(meta, "version int, shard_rows long, metric string, m int, ef_construction int, seed int, heuristic boolean").write.parquet(f"{out.path}/meta")
        return out.add(rows)

    @classmethod
    def open(cls, spark, path: str, params: HnswParams | None = None, version: int | None = None) -> HnswShards:
        """The index under path, its newest version or an older one; parameters other than those it was built with are an error."""
        r = spark.read.parquet(f"{path}/meta").first()
        known = HnswParams(r["metric"], r["m"], r["ef_construction"], r["seed"], r["heuristic"])
        if params is not None and params != known:
            raise ValueError(f"the index was built with {known}")
        return cls(spark, path, known, version or spark.read.parquet(f"{path}/manifests").agg(F.max("version")).first()[0])

    @property
    def manifest(self) -> DataFrame:
        """(shard, lo, hi, n, folder) of this version."""
        if not self.version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/version={self.version}")

    def _nodes(self, shards: list[int] | None = None) -> DataFrame:
        """The nodes of all shards, or of some; of the others no file is opened."""
        folders = [r["folder"] for r in self.manifest.orderBy("shard").collect() if shards is None or r["shard"] in shards]
        return self.spark.read.schema(NODES).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], NODES)

    @property
    def index(self) -> HnswIndex:
        begins = [r["lo"] for r in self.manifest.orderBy("shard").collect()]  # a row a shard
        return HnswIndex(self._nodes(), self.params, len(begins), begins[1:])

    def search(self, queries: DataFrame, k: int = 10, ef: int = 64, where: Column | None = None, allowed: DataFrame | None = None, exact_below: int = 0, mask: DataFrame | None = None) -> DataFrame:
        return self.index.search(queries, k, ef, where, allowed, exact_below, mask)

    def add(self, rows: DataFrame) -> HnswShards:
        """The next version, with rows(id, vector) in it."""
        shard_rows = self.spark.read.parquet(f"{self.path}/meta").first()["shard_rows"]
        rows = rows.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
        rows = stored(rows.where(f"vector IS NULL OR coalesce({FINITE}, true)"), "rows")
        held = self.manifest.orderBy("shard").collect()  # a row a shard
        top = max((r["hi"] for r in held), default=None)
        beyond = rows if top is None else rows.where(F.col("id") > top)
        more = shards_for(beyond.count(), shard_rows)
        cuts = []
        if more:
            at = beyond.agg(F.percentile_approx("id", F.array(*[F.lit(i / more) for i in range(1, more)]), 10_000 * more).alias("at")).first()["at"] if more > 1 else []
            cuts = [int(x) for x in at]
        # where each shard's range begins, but for the first
        begins = [r["lo"] for r in held[1:]] + ([top + 1] if held and more else []) + [x + 1 for x in cuts]
        sent = self.spark.sparkContext.broadcast(np.array(begins, np.int64))

        def deal(batches):
            import pyarrow as pa

            for batch in batches:
                shard = np.searchsorted(sent.value, batch.column(0).to_numpy(), "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], ["shard", "id", "vector"])

        dealt = stored(rows.mapInArrow(deal, "shard int, id long, vector array<float>"), "dealt")
        new = dealt.select("shard", "id", level_of(F.col("id"), self.params.m, self.params.seed).alias("level"), "vector")
        touched = sorted(r[0] for r in dealt.select("shard").distinct().collect())
        grow = HnswIndex._grown(self.params)

        def run(old, new):
            ids = np.concatenate([old["id"].to_numpy(), new["id"].to_numpy()])
            if len(np.unique(ids)) < len(ids):
                raise ValueError("an id is there already")
            return grow(old, new)

        grown = self._nodes(touched).groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(run, NODES)
        version, folder = self.version + 1, f"nodes/version={self.version + 1}"
        grown.withColumn("part", F.col("shard")).write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{folder}")
        fresh = []
        if touched:
            said = self.spark.read.schema(NODES + ", part int").parquet(f"{self.path}/{folder}").groupBy("shard").agg(F.min("id"), F.max("id"), F.count("*")).collect()
            fresh = [(s, lo, hi, n, f"{folder}/part={s}") for s, lo, hi, n in said]
        stay = [tuple(r) for r in held if r["shard"] not in touched]
        manifest = self.spark.createDataFrame(sorted(stay + fresh), MANIFEST)
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/version={version}")
        return HnswShards(self.spark, self.path, self.params, version)

    def __len__(self) -> int:
        return self.manifest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def reuse(rows: DataFrame, path: str, params: HnswParams, shard_rows: int = SHARD_ROWS) -> HnswShards:
    """The index under path if there is one, with its parameters checked; else that of rows, built there."""
    try:
        return HnswShards.open(rows.sparkSession, path, params)
    except AnalysisException:
        return HnswShards.build(rows, path, params, shard_rows)
