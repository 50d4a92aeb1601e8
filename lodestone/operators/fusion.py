"""Fusion of rankings, merging of shards, and what measures them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .exact import top_k


def rrf(rankings: list[DataFrame], k: int = 10, c: float = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings(query_id, rank, id): negative ids keep their rank and are dropped; ties by id. No rankings give no rows."""
    if not rankings:
        return SparkSession.active().createDataFrame([], "query_id long, rank int, id long, score double")
    every = rankings[0].select("query_id", "rank", "id")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query_id", "rank", "id"))
    scores = every.where("id >= 0").groupBy("query_id", "id").agg(F.sum(1 / (c + F.col("rank"))).alias("score"))
    return top_k(scores, ["query_id"], [F.round("score", 12).desc(), "id"], k).select("query_id", "rank", "id", "score")


def merge_shards(found: DataFrame, k: int) -> DataFrame:
    """The k best of all shards' (query_id, neighbor_id, dist)."""
    return top_k(found, ["query_id"], ["dist", "neighbor_id"], k).select("query_id", "rank", "neighbor_id", "dist")


def recall_at_k(found: DataFrame, truth: DataFrame, queries: DataFrame, k: int = 10, filtered: bool = False) -> DataFrame:
    """One row: hits, possible, recall. Possible is k for each of queries(id), also where nothing was found; or with
    filtered the number of true neighbours. Without any the recall is null."""
    f = found.where(F.col("rank") <= k).select("query_id", "neighbor_id").distinct()
    t = truth.where(F.col("rank") <= k).select("query_id", "neighbor_id").distinct()
    hits = f.join(t, ["query_id", "neighbor_id"]).agg(F.count("*").alias("hits"))
    possible = t.agg(F.count("*").alias("possible")) if filtered else queries.agg((F.countDistinct("id") * k).alias("possible"))
    return hits.crossJoin(F.broadcast(possible)).withColumn("recall", F.try_divide("hits", "possible"))


def with_recall(found: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """found with each query's own recall: its share of the query's true neighbours."""
    t = truth.where(F.col("rank") <= k).select("query_id", "neighbor_id").withColumn("_t", F.lit(1))
    per = t.groupBy("query_id").agg(F.count("*").alias("_n"))
    hits = found.join(t, ["query_id", "neighbor_id"]).groupBy("query_id").agg(F.count("*").alias("_h"))
    per = per.join(hits, "query_id", "left").select("query_id", (F.coalesce("_h", F.lit(0)) / F.col("_n")).alias("recall"))
    return found.join(per, "query_id", "left")


def qps(runs: DataFrame, by: list[str], n_queries: str, seconds: str) -> DataFrame:
    """Throughput of the best run: queries by the least time."""
    return runs.groupBy(*by).agg((F.max(n_queries) / F.min(seconds)).alias("qps"))


def percentiles(df: DataFrame, by: list[str], value: str, points=(0.5, 0.95, 0.99)) -> DataFrame:
    """By Spark's own aggregate, which gathers a group's distinct values in one task; selection.percentiles gives the same without."""
    return df.groupBy(*by).agg(*[F.percentile(value, F.lit(p)).alias(f"p{round(p * 100)}") for p in points])


def pareto(points: DataFrame, recall: str = "recall", qps: str = "qps") -> DataFrame:
    """The rows no other row beats: by falling recall, those of higher throughput than all before. The input is one row per setting."""
    before = Window.orderBy(F.col(recall).desc(), F.col(qps).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("_b", F.max(qps).over(before)).where(F.col("_b").isNull() | (F.col(qps) > F.col("_b"))).drop("_b")


def qps_at_recall(points: DataFrame, targets=(0.9, 0.95, 0.99)) -> DataFrame:
    return points.groupBy("algo").agg(*[F.max(F.when(F.col("recall") >= t, F.col("qps"))).alias(f"qps_{round(t * 100)}") for t in targets])
