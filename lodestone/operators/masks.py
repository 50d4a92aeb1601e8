"""Sets of ids as words of 64 bits: (word, bits), a row for each word with a member.

Words go to the tasks that hold the rows, so that filtering a graph joins and shuffles none of its nodes. Dense ids take a quarter of a byte each, ids that lie thin 16
bytes at most; nothing is sent to the driver. Negative ids are members like others, null ids are left out, repeated ones count once, and an empty table is the empty set."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = "word long, bits long"


def of(ids: DataFrame, *by: Column) -> DataFrame:
    """The mask of ids(id), or one for each value of the columns by. Bits are put together before the shuffle."""
    id_ = F.col("id").cast("long")
    bit = F.expr("shiftleft(1L, cast(cast(id AS bigint) & 63 AS int))")
    return ids.where("id IS NOT NULL").groupBy(*by, F.shiftright(id_, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def ids_of(mask: DataFrame) -> DataFrame:
    """The mask's columns but bits, and id: a row for each member."""
    rows = mask.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(63)))).where("(shiftright(bits, _bit) & 1) = 1")
    return rows.withColumn("id", F.expr("shiftleft(word, 6) | _bit")).drop("word", "bits", "_bit")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    met = a.join(b.withColumnRenamed("bits", "_b"), "word")
    return met.select("word", F.col("bits").bitwiseAND(F.col("_b")).alias("bits")).where("bits <> 0")


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    met = a.join(b.withColumnRenamed("bits", "_b"), "word", "left")
    return met.select("word", F.expr("bits & ~coalesce(_b, 0L)").alias("bits")).where("bits <> 0")


def size(mask: DataFrame) -> DataFrame:
    """One row: how many members there are."""
    return mask.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("n"))


def by_hash(mask: DataFrame, n_shards: int) -> DataFrame:
    """(shard, word, bits) for shards that hold the ids which hash to them."""
    return of(ids_of(mask), F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int").alias("shard"))


def by_range(mask: DataFrame, begins: list[int]) -> DataFrame:
    """(shard, word, bits) for shards of contiguous ranges, each but the first beginning at one of begins. A word goes to every shard it reaches into: all together,
    one word a shard is sent twice."""
    sent = mask.sparkSession.sparkContext.broadcast(np.array(begins, np.int64))

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            word = batch.column(0).to_numpy()
            first = np.searchsorted(sent.value, word << 6, "right")
            n = np.searchsorted(sent.value, (word << 6) | 63, "right") - first + 1
            at = np.repeat(np.arange(len(word)), n)
            shard = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *taken.columns], ["shard", "word", "bits"])

    return mask.select("word", "bits").mapInArrow(deal, f"shard int, {WORDS}")


def holds(word: np.ndarray, bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids are members."""
    if not len(word):
        return np.zeros(len(ids), bool)
    order = np.argsort(word)
    word, bits = word[order], bits[order]
    at = np.minimum(np.searchsorted(word, ids >> 6), len(word) - 1)
    return (word[at] == ids >> 6) & ((bits[at] >> (ids & 63)) & 1 == 1)
