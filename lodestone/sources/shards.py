"""Contiguous shards of dense ids, CSV and array files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shard_bounds(n: int, shards: int) -> list[tuple[int, int, int]]:
    """(shard, lo, hi): equal parts of 0..n, bounds rounded down."""
    return [(i, i * n // shards, (i + 1) * n // shards) for i in range(shards)]


def with_shard(rows: DataFrame, n: int, shards: int) -> DataFrame:
    """rows with the shard of each id: the last whose lower bound is not above it. Ids must be dense, 0 to n - 1: others raise an error."""
    inside = F.expr(f"CASE WHEN id >= 0 AND id < {n} THEN id ELSE raise_error('ids of contiguous shards must be dense from 0') END")
    return rows.withColumn("shard", F.floor(((inside + 1) * shards - 1) / F.lit(n)).cast("int"))


def write_shards(rows: DataFrame, path: str, shards: int) -> None:
    """rows(id, vector) in contiguous shards, a folder each, and a manifest: (shard, lo, hi, n, dim)."""
    n, dim = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    with_shard(rows, max(n, 1), shards).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/rows")
    manifest = [(i, a, b, b - a, dim or 0) for i, a, b in shard_bounds(n, shards)]
    rows.sparkSession.createDataFrame(manifest, "shard int, lo long, hi long, n long, dim int").write.mode("overwrite").parquet(f"{path}/manifest")


def shard_path(path: str, shard: int) -> str:
    """Where a shard's rows lie, relative to the folder of all."""
    return f"{path}/rows/shard={shard}"


def read_shards(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows of all shards, with their shard, and the manifest. A filter on shard reads only its folder."""
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/manifest")


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """With multi_line a value may hold line ends; files aren't split then."""
    return spark.read.schema(schema).option("header", True).option("escape", "\"").option("multiLine", multi_line).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)


def read_npy(spark: SparkSession, path: str, step: int = 10_000) -> DataFrame:
    """(id, vector) of a two-dimensional array file that all executors can open; each task maps a range of its rows."""
    n = len(np.load(path, mmap_mode="r"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in batch.column(0).to_pylist():
                x = np.load(path, mmap_mode="r")[lo : lo + step].astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(x))), pa.array(list(x), pa.list_(pa.float32()))], ["id", "vector"])

    return spark.range(0, max(n, 1), step).mapInArrow(run, "id long, vector array<float>")


def write_npy(rows: DataFrame, folder: str) -> DataFrame:
    """rows(id, vector) as array files, a part for each task, in a folder that all executors share: name-vectors.npy
    and name-ids.npy; returns (name, n). A task that runs again writes other names."""

    def run(batches):
        import uuid
        from pathlib import Path

        import pyarrow as pa

        Path(folder).mkdir(parents=True, exist_ok=True)
        ids, vectors = [], []
        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(0).to_numpy())
                vectors.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, -1))
        if ids:
            name = uuid.uuid4().hex
            np.save(f"{folder}/{name}-vectors.npy", np.concatenate(vectors))
            np.save(f"{folder}/{name}-ids.npy", np.concatenate(ids))
            yield pa.RecordBatch.from_pydict({"name": [name], "n": pa.array([sum(map(len, ids))], pa.int64())})

    return rows.select("id", F.col("vector").cast("array<float>").alias("vector")).mapInArrow(run, "name string, n long")
