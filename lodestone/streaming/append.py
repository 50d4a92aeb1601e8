"""Index tables that grow from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.bm25 import Bm25Index


def append_documents(stream: DataFrame, index_path: str, checkpoint: str, remove_stopwords: bool = True) -> StreamingQuery:
    """Appends each batch's forward index under index_path; a batch that runs again overwrites its own folder."""

    def add(batch: DataFrame, n: int) -> None:
        Bm25Index.forward(batch, remove_stopwords).write.mode("overwrite").parquet(f"{index_path}/docs/batch={n}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended_index(spark, index_path: str) -> Bm25Index:
    return Bm25Index(spark.read.parquet(f"{index_path}/docs").drop("batch"))
