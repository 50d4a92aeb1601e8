"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, in alphabetical order: the words left out of the index, usual English ones and the letters that clitics leave behind (i s t d m).
STOPWORDS = (
    "a an and are as at be but by d for i if in into is it m no not of on or s such t that the their then there these they this to was will with"
).split()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokenize(text: Column, remove_stopwords: bool = True) -> Column:
    """Runs of a-z, 0-9 and non-ASCII characters, after A-Z are lower-cased (no others)."""
    tokens = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(r"[a-z0-9\x{80}-\x{10FFFF}]+"), F.lit(0))
    return F.filter(tokens, lambda t: ~t.isin(*STOPWORDS)) if remove_stopwords else tokens


def clean(text: Column) -> Column:
    """Without addresses and mentions, white space collapsed; null is empty."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)https?://\S+", "")
    out = F.regexp_replace(out, r"(?U)@\w+", "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def clean_dedup(df: DataFrame, id_col: str, text_col: str, least: int = 5) -> DataFrame:
    """Cleaned texts of at least so many characters; of equal ones the row with the smallest id. A minimum, not a window: hot texts aggregate early."""
    out = df.select(F.col(id_col), clean(F.col(text_col)).alias("clean")).where(F.length("clean") >= least)
    return out.groupBy("clean").agg(F.min(id_col).alias(id_col))


def query_base_split(df: DataFrame, id_col: str, n_queries: int, limit: int = 0, seed: int = 42) -> DataFrame:
    """All rows in an order by a seeded digest of the id: so many queries, then the base, of which limit rows are kept (0: all).

    Digests are spread evenly, so their first four digits make 65,536 small windows; only these windows' counts are added up in one task."""
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(id_col).cast("string")))
    rows = df.withColumn("_k", key)
    if limit:
        rows = rows.orderBy("_k", id_col).limit(limit + n_queries)
    rows = rows.withColumn("_p", F.substring("_k", 1, 4))
    counts = rows.groupBy("_p").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_p", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy("_k", id_col))
    out = rows.withColumn("_own", own).join(F.broadcast(counts), "_p").withColumn("position", F.col("_before") + F.col("_own"))
    return out.withColumn("is_query", F.col("position") <= n_queries).drop("_k", "_p", "_own", "_before")
