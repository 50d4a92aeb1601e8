"""Nearest neighbours by vantage-point trees, one for each shard of the rows.

Vectors are scaled to unit length, where the order by distance is that by cosine. A tree halves its rows again and
again by their distance from a vantage point (the row that spreads a few probes most), down to leaves. For a query,
each node on the way to a leaf bounds from below, by the triangle inequality, how near the leaf's rows can be;
leaves are visited nearest bound first until factor * bound exceeds the distance of the k-th found. Factor 1 is
exact; larger factors prune more and may lose neighbours.

Shards are regions: some rows, chosen by a hash of their ids, are vantage points, and each row goes to the nearest of
them. A region keeps the least and greatest distance of its rows from its point; large ones are parts of bounded size. A query
searches the nearest regions that hold enough rows first; the distance of the k-th found there decides, by the same
inequality and factor, which other regions it is sent to. A part and a block of its queries meet in a group of
their own, both bounded in bytes, which gives k rows a query; these are merged.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null id; rows of
different dimension are not compared; equal scores tie and go by id: a shard ranks by exact score and id all vectors that rounding
can't tell from the k-th, of each distinct one the k + 1 smallest ids; rows that repeat an id count once for each distinct vector, as candidates; repeated queries count once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: So many candidates of a block of queries are held at a time.
MOST = 1 << 20
#: So many bytes of vantage points are sent to the tasks at most, and so many points.
POINT_BYTES, POINTS = 16 << 20, 4096


def rounding(dim: int) -> tuple[float, float]:
    """How far a cosine may be off by rounding, and a bound made of distances."""
    off = 4 * (dim + 8) * np.finfo(float).eps
    return off, 5 * np.sqrt(2 * off)


def apart(cosines: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(0, 2 - 2 * cosines))


class Tree:
    """leaves: arrays of row numbers. bounds: for each leaf, the (vantage, radius, inside) on the way to it."""

    def __init__(self, rows: np.ndarray, leaf: int = 64):
        self.rows, self.leaves, self.ways, self.vantage = rows, [], [], []
        todo = [(np.arange(len(rows)), ())]
        while todo:
            own, way = todo.pop()
            if len(own) <= leaf:
                if len(own):
                    self.leaves.append(own)
                    self.ways.append(way)
                continue
            probes = own[:: max(1, len(own) // 8)][:8]
            d = np.sqrt(np.maximum(0, 2 - 2 * rows[own] @ rows[probes].T))
            j = int(np.argmax(d.std(axis=0)))
            order = np.argsort(d[:, j], kind="stable")
            half = len(own) // 2
            lo, hi = d[order[half - 1], j], d[order[half], j]
            v = len(self.vantage)
            self.vantage.append(probes[j])
            todo.append((own[order[:half]], (*way, (v, lo, True))))
            todo.append((own[order[half:]], (*way, (v, hi, False))))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Of each query and leaf, the least distance that the triangle inequality allows."""
        out = np.zeros((len(queries), len(self.leaves)))
        if self.vantage:
            d = np.sqrt(np.maximum(0, 2 - 2 * queries @ self.rows[self.vantage].T))
            for i, way in enumerate(self.ways):
                for v, radius, inside in way:
                    np.maximum(out[:, i], d[:, v] - radius if inside else radius - d[:, v], out=out[:, i])
        return out

    def reach(self, queries: np.ndarray, k: int, factor: float = 1.0, start: int = 0):
        """Yields (query numbers, row numbers, cosines): of each query the k nearest rows and all that rounding can't tell from the k-th.

        Where more than MOST of them would be held at a time, the queries are halved."""
        n = len(queries)
        best = np.full((n, k), -np.inf)
        kth = best[:, 0].copy()
        off, slack = rounding(queries.shape[1])
        low = self.bounds(queries)
        order = np.argsort(low, axis=1, kind="stable")
        active = np.arange(n)
        held, total = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))], 0

        def kept():
            q, r, c = (np.concatenate(x) for x in zip(*held))
            near = c >= kth[q] - 2 * off
            return q[near], r[near], c[near]

        for step in range(len(self.leaves)):
            at = order[active, step]
            active = active[factor * (low[active, at] - slack) <= np.sqrt(np.maximum(0, 2 - 2 * kth[active]))]
            if not len(active):
                break
            at = order[active, step]
            by = np.argsort(at, kind="stable")
            values, cuts = np.unique(at[by], return_index=True)
            for x, a, b in zip(values, cuts, [*cuts[1:], len(by)]):
                q, own = active[by[a:b]], self.leaves[x]
                c = queries[q] @ self.rows[own].T
                best[q] = np.partition(np.concatenate([best[q], c], axis=1), -k, axis=1)[:, -k:]
                kth[q] = best[q].min(axis=1)
                i, j = np.nonzero(c >= kth[q][:, None] - 2 * off)
                held.append((q[i], own[j], c[i, j]))
                total += len(i)
                if total > MOST:
                    held = [kept()]
                    total = len(held[0][0])
                    if total > MOST // 2 and n > 1:
                        yield from self.reach(queries[: n // 2], k, factor, start)
                        yield from self.reach(queries[n // 2 :], k, factor, start + n // 2)
                        return
        q, r, c = kept()
        yield q + start, r, c

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> np.ndarray:
        """Row numbers by query, nearest first, -1 where there are fewer than k."""
        found = np.full((len(queries), k), -1)
        for q, r, c in self.reach(queries, k, factor):
            order = np.lexsort((r, -c, q))
            q, r = q[order], r[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            found[q[rank < k], rank[rank < k]] = r[rank < k]
        return found


def nearest(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, leaf: int):
    """(query_id, vec_id, score) of the k best rows for each query; a row with the query's own id is left out."""
    _, first, same = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
    distinct = vectors[first]
    # Each id once for each distinct vector, by vector and id.
    by = np.lexsort((ids, same))
    by = by[np.append(True, (np.diff(same[by]) != 0) | (np.diff(ids[by]) != 0))]
    same, ids = same[by], ids[by]
    starts = np.searchsorted(same, np.arange(len(first)))
    many = np.minimum(np.diff(np.append(starts, len(ids))), k + 1)
    lengths, q_lengths = np.sqrt((distinct * distinct).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    tree = Tree(distinct / lengths[:, None], leaf)
    # Vectors with the query's own id take places.
    sorted_ids = np.sort(ids)
    places = k + np.maximum(1, np.searchsorted(sorted_ids, query_ids, "right") - np.searchsorted(sorted_ids, query_ids))
    out: list[tuple] = []
    for place in np.unique(places):
        asked = np.flatnonzero(places == place)
        for q, row, _ in tree.reach(queries[asked] / q_lengths[asked, None], int(place), factor):
            q = asked[q]
            scores = np.empty(len(q))
            size = max(1, (1 << 20) // vectors.shape[1])
            for x in range(0, len(q), size):
                # in double precision, alike for equal vectors
                i, r = q[x : x + size], row[x : x + size]
                scores[x : x + size] = (distinct[r] * queries[i]).sum(axis=1) / (lengths[r] * q_lengths[i])
            n = many[row]
            own = ids[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[row], n)]
            q, scores = np.repeat(q, n), np.repeat(scores, n)
            other = own != query_ids[q]
            q, own, scores = q[other], own[other], scores[other]
            order = np.lexsort((own, -scores, q))
            q, own, scores = q[order], own[order], scores[order]
            top = np.arange(len(q)) - np.searchsorted(q, q) < k
            out += zip(query_ids[q[top]].tolist(), own[top].tolist(), scores[top].tolist())
    return out


class Regions:
    """Vantage points of one dimension, with the number of rows of each one's region and their least and greatest distance from it."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.n, self.lo, self.hi = np.zeros(len(points), np.int64), np.zeros(len(points)), np.zeros(len(points))

    def nearest(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row its region, and how far its point is."""
        d = apart(units @ self.points.T)
        at = d.argmin(axis=1)
        return at, d[np.arange(len(at)), at]

    def bounds(self, units: np.ndarray) -> np.ndarray:
        """Of each query and region, the least distance that the triangle inequality allows; infinite for empty regions."""
        d = apart(units @ self.points.T)
        return np.where(self.n > 0, np.maximum(0, np.maximum(d - self.hi, self.lo - d)), np.inf)

    def first(self, units: np.ndarray, rows: int) -> np.ndarray:
        """Of each query and region, whether it is among the nearest ones that hold so many rows together."""
        low = self.bounds(units)
        order = np.lexsort((apart(units @ self.points.T), low), axis=1)
        held = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(low.shape, bool)
        np.put_along_axis(out, order, held < rows, axis=1)
        return out & (self.n > 0)


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _units(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def vantage_points(base: DataFrame, counts: dict[int, int], points: dict[int, int]) -> dict[int, list]:
    """Of each dimension so many vectors, those that come first by a hash of the id; counts tells how many rows there are.

    The hash is even, so a threshold on it leaves few more rows than are wanted, whatever the number of rows; ids that repeat so often that they
    pass it in numbers are cut by a limit, which keeps no more rows a task than it returns. No task sorts a table."""
    by = {}
    h = F.xxhash64("id", F.lit(5))
    for d, n in points.items():
        # so far above the mean of the rows let through that fewer than n come about once in millions of times
        share = min(1.0, (n + 8 * n**0.5 + 32) / counts[d])
        own = base.where(F.col("dim") == d)
        found = own.where(h < int((2 * share - 1) * 2**63)) if share < 1 else own
        order = [h, F.col("id"), F.col("vector")]
        by[d] = [r["vector"] for r in found.select("id", "vector").orderBy(*order).limit(n).collect()]  # at most POINT_BYTES
        if not by[d]:  # few ids, all beyond the threshold
            by[d] = [r["vector"] for r in own.select("id", "vector").orderBy(*order).limit(n).collect()]
    return by


def vp_search(rows: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, shard_rows: int = 16384, block: int = 4096, leaf: int = 256, most_bytes: int = 16 << 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of rows(id, vector) for each of queries(id, vector).

    shard_rows and block bound the rows of a region's part and of a block of queries, as most_bytes does for either."""
    fit = "id IS NOT NULL AND size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(vector, x -> x <> 0)"
    spark = rows.sparkSession

    def fitting(df: DataFrame) -> DataFrame:
        df = df.selectExpr("cast(id as bigint) AS id", "cast(vector as array<double>) AS vector").where(fit)
        return df.withColumn("dim", F.size("vector"))

    # Rows that repeat meet in one part, where they count once; only queries are made distinct by a shuffle.
    base, asked = stored(fitting(rows), "rows"), stored(fitting(queries).dropDuplicates(["id", "vector"]), "queries")
    dims = asked.groupBy("dim").count().select("dim")
    counts = {r["dim"]: r["count"] for r in base.join(F.broadcast(dims), "dim", "left_semi").groupBy("dim").count().collect()}
    result = "query_id long, vec_id long, score double"
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    size = {d: max(1, min(shard_rows, most_bytes // (8 * d), max(16 * leaf, n // spark.sparkContext.defaultParallelism))) for d, n in counts.items()}
    points = {d: max(1, min(-(-n // size[d]), POINTS, POINT_BYTES // (8 * d * len(counts)))) for d, n in counts.items()}
    regions = {d: Regions(_units(np.array(v))) for d, v in vantage_points(base, counts, points).items()}
    sent = spark.sparkContext.broadcast(regions)

    def place(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                dim = batch.column(2).to_numpy()
                for d in np.unique(dim):
                    if int(d) not in sent.value:
                        continue
                    part = batch.filter(pa.array(dim == d))
                    at, far = sent.value[int(d)].nearest(_units(_matrix(part.column(1), int(d))))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at.astype(np.int32)), pa.array(far)], ["id", "vector", "dim", "region", "far"])

    placed = stored(base.mapInArrow(place, "id long, vector array<double>, dim int, region int, far double"), "placed")
    for r in placed.groupBy("dim", "region").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")).collect():  # a row per point
        own = regions[r["dim"]]
        own.n[r["region"]], own.lo[r["region"]], own.hi[r["region"]] = r["n"], r["lo"], r["hi"]
    known = spark.sparkContext.broadcast(regions)
    parts = [(d, i, -(-int(n) // size[d])) for d, own in regions.items() for i, n in enumerate(own.n) if n]
    parts = F.broadcast(spark.createDataFrame(parts, "dim int, region int, parts long"))

    def spread(units: np.ndarray, own: Regions, kth: np.ndarray | None) -> np.ndarray:
        first = own.first(units, k + 1)
        if kth is None:
            return first
        return ~first & (factor * (own.bounds(units) - rounding(units.shape[1])[1]) <= kth[:, None])

    def sending(second: bool):
        def run(batches):
            import pyarrow as pa

            for whole in batches:
                for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                    dim = batch.column(2).to_numpy()
                    for d in np.unique(dim):
                        if int(d) not in known.value:
                            continue
                        part = batch.filter(pa.array(dim == d))
                        kth = apart(part.column(3).to_numpy()) if second else None
                        q, region = np.nonzero(spread(_units(_matrix(part.column(1), int(d))), known.value[int(d)], kth))
                        for a in range(0, len(q), 4096):
                            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(q[a : a + 4096])) for c in part.columns[:3]), pa.array(region[a : a + 4096].astype(np.int32))], ["id", "vector", "dim", "region"])

        return run

    def search(left, right):
        import pyarrow as pa

        if left.num_rows and right.num_rows:
            d = len(left["vector"][0])
            got = nearest(left["id"].to_numpy(), _matrix(left["vector"].combine_chunks(), d), right["id"].to_numpy(), _matrix(right["vector"].combine_chunks(), d), k, factor, leaf)
        else:
            got = []
        return pa.table([pa.array(c, t) for c, t in zip(zip(*got) if got else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def met(asked: DataFrame, name: str) -> DataFrame:
        """The k best of asked(id, vector, dim, region), by query."""
        asked = stored(asked, name)
        blocks = asked.groupBy("dim", "region").agg(F.ceil(F.count("*") / block).alias("blocks"))  # a row per region
        both = F.broadcast(parts.join(blocks, ["dim", "region"]))
        deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = placed.join(both, ["dim", "region"]).select("dim", "region", deal("parts", 3).alias("i"), every("blocks").alias("j"), "id", "vector")
        right = asked.join(both, ["dim", "region"]).select("dim", "region", every("parts").alias("i"), deal("blocks", 4).alias("j"), "id", "vector")
        keys = ["dim", "region", "i", "j"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, result)
        return stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), f"{name}-found")

    kinds = "id long, vector array<double>, dim int, region int"
    near = met(asked.select("id", "vector", "dim").mapInArrow(sending(False), kinds), "first")
    # A query that has not found k yet is sent to all regions.
    kth = near.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("s")).otherwise(-1.0).alias("kth"))
    again = asked.join(kth, "id", "left").select("id", "vector", "dim", F.coalesce("kth", F.lit(-1.0)).alias("kth"))
    more = met(again.mapInArrow(sending(True), kinds), "second")
    found = near.unionByName(more).drop("rank")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    return vp_search(rows, rows.where("id % 50 = 0"))
