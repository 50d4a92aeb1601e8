"""Centroid clustering in whole numbers by ball-tree filtering.

Vectors are turned into integers once. Each task makes metric trees of the rows it reads, a tree for up to TREE_ROWS of them: a ball is
split between two of its rows that lie far apart, down to leaves, and stores its centre, radius, count and integer sum. The trees are
written once; no row is shuffled. A round goes down all trees at once, level by level, with the centroids that may still win: by the
triangle inequality no row of a ball is nearer to a centroid at distance d from the centre than d - radius, nor farther than d + radius. A ball that one
centroid is left for is assigned whole, by its count and sum; at a leaf the rows themselves decide, exactly. Tasks pass on a count and a sum for each
centroid and batch of trees, which are added up before they come to the driver: as many numbers as centroids have components.

Cases: vectors that are null, hold null or non-finite components or have another number of components than dim take no part; rows with a null id do,
but come last as starting centroids, as does among equal ids the row with the greater vector; repeated rows count each; ties go to the smaller number; equal
centroids leave the larger number empty, and empty ones stay as they are; fewer rows than centroids make fewer centroids; an empty table gives
no rows; other columns are ignored. Components beyond most_of(dim) once they are integers are an error, as squared distances would not fit a long; so are sums of distances that do not.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, drop, stored

TREE_ROWS, LEAF = 4096, 32
#: So many trees (some 2 MB each) are sent to a Python worker at a time.
TREES = 8
#: Up to here squared distances are exact in double precision.
SMALL = 1 << 22


def most_of(dim: int) -> int:
    """The largest integer component: dim squares of twice of it fit a long, it itself 32 bits."""
    return min((1 << 31) - 1, int(((2**63 - 1) // dim) ** 0.5) // 2 - 1)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows from integer centroids, exact."""
    if len(x) and max(np.abs(x).max(), np.abs(c).max()) * int(x.shape[1]) ** 0.5 < SMALL:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, one in enumerate(c):
        d = x.astype(np.int64) - one
        out[:, j] = (d * d).sum(axis=1)
    return out


class BallTree:
    """rows in the tree's order; of each ball its first and last row, its children (-1: a leaf), centre, radius and sum."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(rows))
        self.lo, self.hi, self.child, centre, radius, total = [], [], [], [], [], []
        exact = rows.astype(np.float64)
        todo = [(0, len(rows), -1, 0)] if len(rows) else []
        while todo:
            lo, hi, parent, side = todo.pop()
            own = exact[order[lo:hi]]
            number = len(self.lo)
            if parent >= 0:
                self.child[parent][side] = number
            mid = own.mean(axis=0)
            far = ((own - mid) ** 2).sum(axis=1)
            self.lo.append(lo)
            self.hi.append(hi)
            self.child.append([-1, -1])
            centre.append(mid)
            radius.append(np.sqrt(far.max()))
            total.append(rows[order[lo:hi]].sum(axis=0, dtype=np.int64))
            if hi - lo <= leaf or not far.max():
                continue
            a = own[far.argmax()]
            from_a = ((own - a) ** 2).sum(axis=1)
            b = own[from_a.argmax()]
            left = from_a <= ((own - b) ** 2).sum(axis=1)
            n = int(left.sum())
            if not 0 < n < hi - lo:
                continue
            order[lo:hi] = np.concatenate([order[lo:hi][left], order[lo:hi][~left]])
            todo += [(lo + n, hi, number, 1), (lo, lo + n, number, 0)]
        self.order, self.rows = order, rows[order].astype(np.int32)
        self.lo, self.hi, self.child = np.array(self.lo, np.int64), np.array(self.hi, np.int64), np.array(self.child, np.int64).reshape(-1, 2)
        dim = rows.shape[1]
        self.centre, self.radius, self.total = np.array(centre).reshape(-1, dim), np.array(radius), np.array(total, np.int64).reshape(-1, dim)

    def parts(self) -> list[bytes]:
        return [x.tobytes() for x in (self.rows, self.lo, self.hi, self.child, self.centre, self.radius, self.total)]

    @classmethod
    def of(cls, parts: list[bytes], dim: int) -> BallTree:
        tree = cls.__new__(cls)
        kinds = (np.int32, np.int64, np.int64, np.int64, np.float64, np.float64, np.int64)
        tree.rows, tree.lo, tree.hi, tree.child, tree.centre, tree.radius, tree.total = (np.frombuffer(x, k) for x, k in zip(parts, kinds))
        tree.rows, tree.centre, tree.total, tree.child = tree.rows.reshape(-1, dim), tree.centre.reshape(-1, dim), tree.total.reshape(-1, dim), tree.child.reshape(-1, 2)
        return tree

    def filtered(self, centroids: np.ndarray):
        """Yields ('balls', ball numbers, their centroid) and ('rows', row numbers, their centroid): together they hold each row once."""
        front = np.zeros(min(1, len(self.lo)), np.int64)
        alive = np.ones((len(front), len(centroids)), bool)
        # of equal centroids only the first can win
        _, first = np.unique(centroids, axis=0, return_index=True)
        alive &= np.isin(np.arange(len(centroids)), first)
        c = centroids.astype(np.float64)
        while len(front):
            m, r = self.centre[front], self.radius[front][:, None]
            far = np.sqrt(np.maximum((m * m).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (m @ c.T), 0))
            # what the expanded squares may be off by, as a distance
            slack = 1e-6 * np.sqrt((m * m).sum(axis=1)[:, None] + (c * c).sum(axis=1).max() + 1)
            most = np.where(alive, far + r, np.inf).min(axis=1)[:, None] + 2 * slack
            alive &= far - r <= most
            one = alive.sum(axis=1) == 1
            if one.any():
                yield "balls", front[one], alive[one].argmax(axis=1)
            front, alive = front[~one], alive[~one]
            leaf = self.child[front, 0] < 0
            if leaf.any():
                lo, n = self.lo[front[leaf]], (self.hi - self.lo)[front[leaf]]
                row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                d = np.where(np.repeat(alive[leaf], n, axis=0), distances(self.rows[row], centroids), np.iinfo(np.int64).max)
                yield "rows", row, d.argmin(axis=1)
            front, alive = self.child[front[~leaf]].ravel(), np.repeat(alive[~leaf], 2, axis=0)

    def sums(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Count and sum of each centroid's rows, and how many rows were looked at one by one."""
        n, total, looked = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64), 0
        for kind, what, won in self.filtered(centroids):
            if kind == "balls":
                np.add.at(n, won, (self.hi - self.lo)[what])
                np.add.at(total, won, self.total[what])
            else:
                np.add.at(n, won, 1)
                np.add.at(total, won, self.rows[what])
                looked += len(what)
        return n, total, looked

    def labels(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row its centroid and squared distance."""
        out = np.empty(len(self.rows), np.int64)
        for kind, what, won in self.filtered(centroids):
            if kind == "balls":
                for x, y in zip(what, won):
                    out[self.lo[x] : self.hi[x]] = y
            else:
                out[what] = won
        d = np.empty(len(self.rows), np.int64)
        for j in np.unique(out):
            d[out == j] = distances(self.rows[out == j], centroids[j : j + 1])[:, 0]
        return out, d


TREE = "ids binary, rows binary, lo binary, hi binary, child binary, centre binary, radius binary, total binary"


def _grown(dim: int, tree_rows: int):
    def run(batches):
        import pyarrow as pa

        def tree(held):
            t = pa.Table.from_batches(held)
            x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            if np.abs(x).max() > most_of(dim):
                raise ValueError(f"components beyond {most_of(dim)} make squared distances that are no long")
            made = BallTree(x)
            known = t["id"].combine_chunks().take(pa.array(made.order))
            ids = pa.ipc.new_stream(sink := pa.BufferOutputStream(), pa.schema([("id", pa.int64())]))
            ids.write_batch(pa.RecordBatch.from_arrays([known], ["id"]))
            ids.close()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (sink.getvalue().to_pybytes(), *made.parts())], [x.split()[0] for x in TREE.split(", ")])

        held, n = [], 0
        for whole in batches:
            for batch in (whole.slice(i, tree_rows) for i in range(0, whole.num_rows, tree_rows)):
                if held and n + batch.num_rows > tree_rows:
                    yield tree(held)
                    held, n = [], 0
                held.append(batch)
                n += batch.num_rows
        if held:
            yield tree(held)

    return run


def _trees(batch, dim: int):
    """(ids, tree) of each row of a batch of TREE."""
    import pyarrow as pa

    for i in range(batch.num_rows):
        ids, *parts = (batch.column(c)[i].as_buffer() for c in range(batch.num_columns))
        yield pa.ipc.open_stream(ids).read_all()["id"].combine_chunks(), BallTree.of(parts, dim)


def centroid_clusters(rows: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1", tree_rows: int = TREE_ROWS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each of rows(id, vector) that takes part.

    Vectors are taken as floor(scale * x). Centroids start as the k rows with the smallest sha256 of seed:id; k * dim numbers are what is sent to the tasks."""
    spark = rows.sparkSession
    fit = f"size(vector) = {dim} AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))"
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where(fit)
    # what is beyond the largest component stays beyond it, within a long
    far = f"{1 << 40}D"
    kept = rows.select("id", F.expr(f"transform(vector, x -> floor(greatest(least({scale}D * x, {far}), -{far})))").alias("x"))
    kept = stored(kept, "integers")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(order.asc_nulls_last(), "x").limit(k).select("x").collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["x"] for r in first], np.int64)
    trees = stored(kept.mapInArrow(_grown(dim, tree_rows), TREE), "trees")
    with batches_of(spark, TREES):
        found, centroids = _rounds(trees, centroids, rounds, dim)
    drop(kept, trees)
    whole = lambda x: F.sum(F.col(x).cast("decimal(38,0)"))
    per = found.groupBy("cluster").agg(whole("distance").alias("d"))
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    per = per.join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster")
    per = per.select("cluster", F.col("d").cast("long").alias("cluster_inertia"), "centroid_sha256").crossJoin(F.broadcast(per.agg(F.sum("d").cast("long").alias("inertia"))))  # k rows
    return found.join(F.broadcast(per), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds(trees: DataFrame, centroids: np.ndarray, rounds: int, dim: int) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of the last assignment, stored, and its centroids."""
    spark = trees.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centroids)

        def add(batches, sent=sent):
            import pyarrow as pa

            c = sent.value
            for batch in batches:
                n, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
                for _, tree in _trees(batch, dim):
                    more, sums, _ = tree.sums(c)
                    n += more
                    total += sums
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c)), pa.int32()), pa.array(n), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

        parts = trees.mapInArrow(add, "cluster int, n long, total array<long>")
        added = parts.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        new = centroids.copy()
        for r in added.where("n > 0").collect():  # k * dim rows
            new[r["cluster"], r["at"]] = int(r["x"]) // r["n"]
        centroids = new
    sent = spark.sparkContext.broadcast(centroids)

    def label(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, tree in _trees(batch, dim):
                won, far = tree.labels(sent.value)
                yield pa.RecordBatch.from_arrays([ids, pa.array(won.astype(np.int32)), pa.array(far)], ["id", "cluster", "distance"])

    return stored(trees.mapInArrow(label, "id long, cluster int, distance long"), "labels"), centroids


def op12_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    return centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector"))
