"""Stored inverted files that grow from a stream of vectors, each id once.

Ids that have come are kept as keyed state, by the hash of the id over all executors (where they are many, the session's state store should be the one on disk:
spark.sql.streaming.stateStore.providerClass); within a stream the first row of an id counts, in the order of batches, and of rows with one id in one batch any. An id that the index holds from elsewhere
stays as it is there. A batch is written to a folder of its own, named by the checkpoint and the batch's number: one that runs again takes the place
of what it left, and a stream that starts with a new checkpoint takes another folder and adds only what is not there. An index has one writer at a time.

Cases: rows without id or with a component that isn't finite are left out and don't count as their id's first row; null vectors are an error, which stops the stream; batches without
rows leave nothing; other columns are ignored."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.exact import BROADCAST_BYTES, FINITE
from ..operators.ivf import IvfIndex
from ..storage import drop, stored


def _unknown(index: IvfIndex, rows: DataFrame, run: str, n: int) -> DataFrame:
    """Of a batch's rows those whose ids the index holds nowhere but in this batch's own folder. A batch whose ids measure small is sent to the scan of the index's
    ids, and no row of the index is shuffled."""
    held = index.spark.read.schema("id long").parquet(f"{index.path}/rows").select("id")  # without the folder
    streamed = index.streamed()
    if streamed is not None:
        held = held.unionByName(streamed.where((F.col("run") != run) | (F.col("batch") != n)).select("id"))
    ids = rows.select("id")
    if rows.count() * 16 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    return rows.join(held.join(ids, "id", "left_semi").distinct(), "id", "left_anti")


def append_vectors(stream: DataFrame, index: IvfIndex, checkpoint: str) -> StreamingQuery:
    """Adds what the stream of (id, vector) holds now to the index, whose centroids stay as they are trained. A second run with the checkpoint goes on after the first."""
    stream = stream.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    once = stream.where(f"vector IS NULL OR coalesce({FINITE}, true)").dropDuplicates(["id"])

    def add(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        run = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        rows = stored(batch, "batch")
        there = IvfIndex(spark, index.path, index.metric)
        new = _unknown(there, rows, run, n)
        if not new.isEmpty():
            there.add_batch(new, run, n)
        drop(rows)

    return once.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
