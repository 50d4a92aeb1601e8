"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1) or bad (-1) or abstains (0). Votes are counted by pattern over all documents that pass the
base rule (the others are rejected whatever the votes, and their sort of junk would take the whole bad class); with six
rules there are at most 3**6 = 729 patterns, so the counts that come to the driver are bounded whatever the input.
Expectation-maximisation over these counts estimates, for either class, how often each rule votes which way, and
the posterior probability of good quality for each pattern.

Cases: null text counts as empty; empty texts have no words and fail the base rule; a repeated row gets the same
verdict as the first; texts of any length are read whole; equal posteriors get equal verdicts, as a verdict follows from the pattern alone; the rows' own
columns are carried in one struct, so their names meet none of the features'; on an empty table nothing is fitted and nothing returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

RULES = ("repetition", "symbols", "lines", "word_length", "shouting", "stop")
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """df's columns in the struct _row, and beside it FEATURES with n_lines and n_upper."""
    w = "regexp_extract_all(_t, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)"
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    out = out.selectExpr(
        "_row",
        f"transform({w}, x -> xxhash64(x)) AS _h",
        "filter(split(_t, '\\\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]') AS _lines",
        "cast(length(_t) - length(translate(_t, '#*$%&|<>', '')) as bigint) AS n_symbols",
        "cast(length(translate(_t, ' \\t\\n\\u000b\\u000c\\r', '')) as bigint) AS word_chars",
        "cast(length(_t) - length(translate(_t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as bigint) AS n_upper",
    )
    out = out.selectExpr(
        "_row", "n_symbols", "word_chars", "n_upper", "cast(size(_h) as bigint) AS n_words", "cast(size(_lines) as bigint) AS n_lines",
        "cast(size(_lines) - size(array_distinct(_lines)) as bigint) AS n_dup_lines",
        "cast(size(array_distinct(_h)) as bigint) AS n_distinct",
        "CASE WHEN size(_h) < 3 THEN array() ELSE transform(slice(_h, 1, size(_h) - 2), (x, i) -> xxhash64(x, get(_h, i + 1), get(_h, i + 2))) END AS _tri",
    )
    # Only texts in which some window comes twice are sorted.
    out = out.withColumn("_sorted", F.expr("CASE WHEN size(array_distinct(_tri)) < size(_tri) THEN sort_array(transform(_tri, (x, i) -> struct(x AS h, i AS i))) END"))
    out = out.withColumn("_at", F.expr("sort_array(transform(filter(_sorted, (x, j) -> x.h <=> get(_sorted, j - 1).h OR x.h <=> get(_sorted, j + 1).h), x -> x.i))"))
    covered = "cast(coalesce(aggregate(transform(_at, (x, j) -> least(3, coalesce(get(_at, j + 1) - x, 3))), 0, (a, x) -> a + x), 0) as bigint) AS n_repeat_words"
    return out.selectExpr("_row", *FEATURES[:-1], covered, "n_lines", "n_upper", "n_distinct")


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def votes() -> list[Column]:
    """The rules' votes, in the order of RULES."""
    return [
        F.expr("CASE WHEN 100 * n_repeat_words > 40 * n_words THEN -1 WHEN 100 * n_repeat_words <= 20 * n_words THEN 1 ELSE 0 END"),
        F.expr("CASE WHEN 10 * n_symbols > n_words THEN -1 WHEN 100 * n_symbols <= n_words THEN 1 ELSE 0 END"),
        F.expr("CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines THEN -1 WHEN n_lines >= 2 AND 100 * n_dup_lines <= 30 * n_lines THEN 1 ELSE 0 END"),
        F.expr("CASE WHEN n_words = 0 OR word_chars < 2 * n_words OR word_chars > 14 * n_words THEN -1 WHEN word_chars BETWEEN 3 * n_words AND 10 * n_words THEN 1 ELSE 0 END"),
        F.expr("CASE WHEN 100 * n_upper > 40 * word_chars THEN -1 WHEN 100 * n_upper <= 10 * word_chars THEN 1 ELSE 0 END"),
        F.expr("CASE WHEN n_words BETWEEN 50 AND 20000 AND 100 * n_distinct < 8 * n_words THEN -1 WHEN n_words < 2000 AND 100 * n_distinct > 35 * n_words THEN 1 ELSE 0 END"),
    ]


def pattern() -> Column:
    """The votes as one number in base 3."""
    out = F.lit(0)
    for v in votes():
        out = out * 3 + (v + 1)
    return out.cast("int")


def fit(counts: dict[int, int], n_rules: int = len(RULES), prior: float = 0.9, rounds: int = 100, weight: float = 10.0) -> dict[int, float]:
    """The posterior probability of good quality of each pattern of votes, from how often each comes.

    Dirichlet priors of the given weight keep rates off 0 and 1. What names the classes is a bound on either side:
    a rule votes bad on at most 1 % of good texts and at least 10 % of bad ones."""
    digits = {p: [p // 3 ** (n_rules - 1 - j) % 3 for j in range(n_rules)] for p in counts}
    start = {0: (0.30, 0.20, 0.50), 1: (0.005, 0.145, 0.85)}
    rate = {z: [list(start[z]) for _ in range(n_rules)] for z in start}
    good, post = prior, {p: prior for p in counts}
    for _ in range(rounds if counts else 0):
        for p, d in digits.items():
            odds = math.log(good / (1 - good)) + sum(math.log(rate[1][j][v] / rate[0][j][v]) for j, v in enumerate(d))
            post[p] = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
        total, is_good = sum(counts.values()), sum(n * post[p] for p, n in counts.items())
        good = (is_good + weight * prior) / (total + weight)
        for z, mass in ((1, is_good), (0, total - is_good)):
            for j in range(n_rules):
                seen = [weight * x for x in start[z]]
                for p, n in counts.items():
                    seen[digits[p][j]] += n * (post[p] if z else 1 - post[p])
                bad = seen[0] / (mass + weight)
                held = min(bad, 0.01) if z else max(bad, 0.1)
                rate[z][j] = [held, *(x / (seen[1] + seen[2]) * (1 - held) for x in seen[1:])]
    return post


def judged(feats: DataFrame, fitted_on: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """Stored features() with posterior, base_failed and kept; the rates are estimated on all rows of fitted_on, or else of feats."""
    counts = {r["p"]: r["n"] for r in (fitted_on or feats).where(~base_failed()).groupBy(pattern().alias("p")).agg(F.count("*").alias("n")).collect()}
    post = fit(counts)
    feats = feats.withColumn("_p", pattern())
    if post:
        table = F.create_map(*[F.lit(x) for p, v in sorted(post.items()) for x in (p, float(v))])
        feats = feats.withColumn("posterior", F.coalesce(table[F.col("_p")], F.lit(0.0)))
    else:
        feats = feats.withColumn("posterior", F.lit(0.0))
    return feats.withColumn("base_failed", base_failed()).withColumn("kept", F.expr(f"NOT base_failed AND posterior >= {least}")).drop("_p")


def quality_report(docs: DataFrame) -> DataFrame:
    """A row per document: the features, the posterior and the verdict."""
    slim = features(docs.select("doc_id", "text")).selectExpr("_row.doc_id AS doc_id", *FEATURES, "n_lines", "n_upper", "n_distinct")
    out = judged(stored(slim, "quality"))
    return out.select("doc_id", *FEATURES, "base_failed", "kept", "posterior")


def quality_filter(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that are kept, with their own columns.

    Texts are read once: rows that pass the base rule are written with their pattern of votes, which is counted and filtered there."""
    verdict = F.when(base_failed(), F.lit(-1)).otherwise(pattern())
    rows = stored(features(docs).select("_row", verdict.alias("_p")).select("_p", F.when(F.col("_p") >= 0, F.col("_row")).alias("_row")), "judged")
    rows = rows.where("_p >= 0")
    post = fit({r["_p"]: r["n"] for r in rows.groupBy("_p").agg(F.count("*").alias("n")).collect()})  # at most 3**6 patterns
    return rows.where(F.col("_p").isin(*[p for p, v in post.items() if v >= least])).select("_row.*") if post else rows.select("_row.*")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
