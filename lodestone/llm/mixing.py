"""Mixing sources to target weights, in DataFrame functions only.

Size is a document's number of words. Sources in the order of their code points, null last, weigh 5, 2, 1 in turn
and share 1.5 times all words by weight; no target exceeds twice its source's size, and what that frees is shared
again by weight. A source's repetition rate is target / size: each of its documents is taken floor(rate) times,
and once more if a seeded hash of its id falls below the fraction.

Cases: null text has size 0; sources without words get target 0; documents without id are drawn by their text; repeated rows
are drawn alike; sources that tie for a limit follow in the order of their names; texts of any length are counted whole; an empty table gives an empty result; other columns, whatever their names, pass through mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WEIGHTS = (5, 2, 1)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size and target of sizes(source, size).

    Shares are min(most * size, level * weight). Sources in the order of most * size / weight reach their limit
    first, so the level follows from running sums over the sources' own table: a row for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.lit(float(WEIGHTS[-1]))
    for i, w in enumerate(WEIGHTS[:-1]):
        weight = F.when(turn % len(WEIGHTS) == i, float(w)).otherwise(weight)
    per = per.select("source", "source_size", weight.alias("_w")).withColumn("_limit", F.col("source_size") * most)
    order = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    per = per.select(
        "*",
        F.coalesce(F.sum("_limit").over(before), F.lit(0.0)).alias("_full"),
        F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("_rest"),
        (F.sum("source_size").over(whole) * share).alias("_all"),
    ).withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_rest"))
    # The level is that of the first source which does not reach its limit.
    level = F.min(F.when(F.col("_level") * F.col("_w") < F.col("_limit"), F.struct("_full", "_level"))).over(whole)["_level"]
    return per.select("source", "source_size", F.coalesce(F.least("_limit", level * F.col("_w")), "_limit").alias("target"))


def draw_of(doc_id: Column, text: Column, seed: int = 11) -> Column:
    """A number in [0, 1) by the id, or where it is null by the text."""
    key = F.when(doc_id.isNull(), F.xxhash64(text, F.lit(seed + 1))).otherwise(F.xxhash64(doc_id, F.lit(seed)))
    return F.shiftrightunsigned(key, 11) * F.lit(2.0**-53)


def copies(draw: Column, rate: Column) -> Column:
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def plan(sizes: DataFrame) -> DataFrame:
    """sizes(doc_id, source, size, draw) with source_size, target and n_copies.

    The sources' table is joined; Spark broadcasts it only if it measures small, else it splits hot sources."""
    per = targets(sizes.select("source", "size")).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sizes.join(per, sizes["source"].eqNullSafe(per["_source"]), "left").drop("_source")
    return joined.withColumn("n_copies", copies(F.col("draw"), rate))


def sizes_of(docs: DataFrame, seed: int = 11) -> DataFrame:
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), draw_of(F.col("doc_id"), F.col("text"), seed).alias("draw"))


def mix(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The mix: docs' rows, each as often as it is taken."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "source", size_of(F.col("text")).alias("size"), draw_of(F.col("doc_id"), F.col("text"), seed).alias("draw"))
    per = targets(packed.select("source", "size")).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = packed.join(per, packed["source"].eqNullSafe(per["_source"]), "left")
    taken = joined.select("_row", copies(F.col("draw"), rate).alias("_n")).where("_n > 0")
    return taken.select("_row", F.explode(F.expr("sequence(1, _n)"))).select("_row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = plan(stored(sizes_of(docs), "sizes"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))
