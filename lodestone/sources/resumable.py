"""Work over a large table in numbered chunks, with a log of what is done: a run that was stopped goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

CHUNK_ROWS = 50_000


def _plan(rows: DataFrame, path: str, chunk_rows: int) -> int:
    """How many chunks there are. The first run deals the rows to a folder a chunk and writes how; later ones check that the rows are the same."""
    spark = rows.sparkSession
    seen = rows.agg(F.count("*"), F.sum(F.xxhash64("id").cast("decimal(38,0)"))).first()
    try:
        r = spark.read.parquet(f"{path}/plan").first()
    except AnalysisException:
        chunks = max(1, -(-seen[0] // chunk_rows))
        rows.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(31)), F.lit(chunks))).write.mode("overwrite").partitionBy("chunk").parquet(f"{path}/input")
        plan = spark.createDataFrame([(chunks, seen[0], str(seen[1]))], "chunks long, n long, ids string")
        plan.write.mode("overwrite").parquet(f"{path}/plan")  # last: a plan without its rows is none
        return chunks
    if (r["n"], r["ids"]) != (seen[0], str(seen[1])):
        raise ValueError("the rows are not those of the run before")
    return r["chunks"]


def committed(spark: SparkSession, path: str) -> set[int]:
    """The numbers of the chunks that are done."""
    try:
        return {r[0] for r in spark.read.schema("chunk long, n long").parquet(f"{path}/log").select("chunk").collect()}  # a row a chunk
    except AnalysisException:
        return set()


def resumable(rows: DataFrame, path: str, make: Callable[[DataFrame], DataFrame], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """make(rows) for rows(id, ...) whose rows depend on their own row alone, chunk by chunk, under path in a folder all executors share.

    A chunk's result is written, then its line in the log; what has no line is done again and overwrites what an earlier run left of it.
    Rows with null ids share a chunk; an empty table is one empty chunk; the result may have any columns but chunk."""
    spark = rows.sparkSession
    chunks = _plan(rows, path, chunk_rows)
    own = spark.read.schema(StructType([*rows.schema, StructField("chunk", LongType())])).parquet(f"{path}/input")
    done = committed(spark, path)
    schema = make(rows.limit(0)).schema
    for c in range(chunks):
        if c not in done:
            out = make(own.where(F.col("chunk") == c).drop("chunk"))
            out.write.mode("overwrite").parquet(f"{path}/rows/chunk={c}")
            spark.createDataFrame([(c, chunks)], "chunk long, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/log/at={c}")
    return spark.read.schema(schema).parquet(*[f"{path}/rows/chunk={c}" for c in range(chunks)])
