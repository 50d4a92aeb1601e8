"""Vectors in blocks, and the meeting of all blocks of two tables, one pair of blocks a group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "dim int, block long, ids binary, vectors binary"


def packed(rows: DataFrame, blocks: int) -> DataFrame:
    """rows(id, vector), dealt by a hash of the id to so many blocks of each dimension: (dim, block, ids, vectors), as bytes of 32-bit floats."""
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    rows = rows.withColumn("dim", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)))

    def join(group):
        import pyarrow as pa

        v = group["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({"dim": group["dim"][:1], "block": group["block"][:1], "ids": pa.array([group["id"].to_numpy().tobytes()], pa.binary()), "vectors": pa.array([v.tobytes()], pa.binary())})

    return rows.groupBy("dim", "block").applyInArrow(join, BLOCK)


def unpacked(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(vectors, np.float32).reshape(len(own), -1).astype(np.float64)


def met(base: DataFrame, n_base: int, asked: DataFrame, n_asked: int, run: Callable, schema: str) -> DataFrame:
    """run(ids, vectors, query_ids, queries) for each two blocks of equal dimension; it returns an Arrow table.

    Each block is copied to the groups it takes part in, so no task holds more than two blocks at a time, whatever
    the number of either, and a lost task repeats only its own groups."""
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = base.select("dim", F.col("block").alias("i"), number(n_asked).alias("j"), F.lit(0).alias("side"), "ids", "vectors")
    right = asked.select("dim", number(n_base).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "ids", "vectors")

    def pair(group):
        import pyarrow as pa

        by = {s: (i, v) for s, i, v in zip(group["side"].to_pylist(), group["ids"].to_pylist(), group["vectors"].to_pylist())}
        if len(by) < 2:
            return pa.schema(wanted).empty_table()
        return run(*unpacked(*by[0]), *unpacked(*by[1]))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = list(to_arrow_schema(StructType.fromDDL(schema)))
    return left.unionByName(right).groupBy("dim", "i", "j").applyInArrow(pair, schema)
