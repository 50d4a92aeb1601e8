"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

Unit vectors are turned by random rotations (three rounds of random signs and a Hadamard transform, after zeros fill them
up to a power of two, 64 at least); the signs of what comes out are a vector's code, a bit a dimension. Beside the first code its
correction factor is stored: the inner product of the vector with its own code. The inner product of a code with another
vector, divided by that factor, estimates the two vectors' cosine without bias; the other vector is rounded to four bits a dimension by a
random dither, so that the estimate takes a few ANDs and bit counts. How far it may be off at confidence standard deviations
follows from the factor and the rounding: only pairs whose estimate reaches the threshold within that bound are recomputed, exactly, from the
whole vectors.

Pairs come from buckets: bands of the codes' bits. Two vectors at the threshold agree in a bit with the probability p = 1 - angle / pi, so
that bands of b bits, as many as make (1 - p ** b) ** bands at most miss, lose no more than that share of the pairs at the
threshold and far less of nearer ones. b grows with the largest label, so that buckets stay small. A bucket of more rows than a block is
dealt to blocks, of which each two meet on their own; a pair is counted in the first of its common bands alone. A task passes on counts by
vector and a forest of its links, never the pairs.

Cases: rows whose label or id is null, or whose vector is null, empty, zero or holds null or non-finite components, link with nothing and come out with
0 links and their own id; vectors of another dimension or label are not compared; equal vectors of a label are one class, compared once and counted as often as they come
(a repeated row is another vector); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored
from .components import _forest, components
from .jaccard import hot_join

#: Rows of a bucket that meet in one task at most twice over, and candidates that are estimated at a time.
BLOCK, PAIRS = 4096, 1 << 20
PLANES = 4
FIT = "size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(vector, x -> x <> 0)"


def padded(dim: int) -> int:
    return max(64, 1 << (dim - 1).bit_length())


def bands_for(threshold: float, bits: int, miss: float) -> int:
    """So many bands of so many bits lose at most the share miss of the pairs at the threshold."""
    p = 1 - math.acos(threshold) / math.pi
    return max(1, math.ceil(math.log(miss) / math.log1p(-(p**bits)))) if p < 1 else 1


@lru_cache(maxsize=8)
def _signs(size: int, rotations: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, size)).choice([-1.0, 1.0], (rotations, 3, size))


def rotated(units: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows after three rounds of signs and the normalised Hadamard transform."""
    n, size = units.shape
    for own in signs:
        units = units * own
        h = 1
        while h < size:
            pair = units.reshape(n, -1, 2, h)
            units = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, size)
            h *= 2
        units = units / math.sqrt(size)
    return units


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows divided by powers of two, so that squares neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def _words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def coded(v: np.ndarray, rotations: int, seed: int):
    """Of each row: the words of its codes (rotation by rotation), those of its four bit planes, and (factor, least value, step of the planes)."""
    size = padded(v.shape[1])
    v = scaled(v)
    units = np.zeros((len(v), size))
    units[:, : v.shape[1]] = v / np.sqrt((v * v).sum(axis=1))[:, None]
    signs = _signs(size, rotations, seed)
    codes = []
    for r in range(rotations):
        x = rotated(units, signs[r])
        codes.append(_words(x > 0))
        if r == 0:
            first = x
    low, high = first.min(axis=1), first.max(axis=1)
    step = np.maximum((high - low) / (2**PLANES - 1), 1e-12)
    dither = np.random.default_rng((seed, size, 1)).random(size)
    level = np.minimum(np.floor((first - low[:, None]) / step[:, None] + dither), 2**PLANES - 1).astype(np.uint8)
    planes = [_words((level >> j) & 1) for j in range(PLANES)]
    factor = np.abs(first).sum(axis=1) / math.sqrt(size)
    return np.concatenate(codes, axis=1), np.concatenate(planes, axis=1), np.stack([factor, low, step], axis=1)


def estimates(codes: np.ndarray, planes: np.ndarray, real: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each pair the estimated cosine, by x's first code and factor and y's rounded vector. codes holds the first code's words alone."""
    words = codes.shape[1]
    size = 64 * words
    own = codes[x]
    inside = np.zeros(len(x), np.int64)
    every = np.zeros(len(x), np.int64)
    for j in range(PLANES):
        plane = planes[y, j * words : (j + 1) * words]
        inside += np.bitwise_count(own & plane).sum(axis=1, dtype=np.int64) << j
        every += np.bitwise_count(plane).sum(axis=1, dtype=np.int64) << j
    ones = np.bitwise_count(own).sum(axis=1, dtype=np.int64)
    return (real[y, 1] * (2 * ones - size) + real[y, 2] * (2 * inside - every)) / (math.sqrt(size) * real[x, 0])


def allowance(real: np.ndarray, size: int, x: np.ndarray, y: np.ndarray, threshold: float, confidence: float) -> np.ndarray:
    """How far below its cosine the estimate of a pair at the threshold lies at most, with that confidence; beyond sqrt(size - 1) the code's part is certain."""
    c = np.minimum(real[x, 0], 1)
    code = math.sqrt(1 - threshold**2) * np.sqrt(1 - c * c) * min(1, confidence / math.sqrt(size - 1))
    return (code + confidence * real[y, 2] / 2) / c


def band_keys(codes: np.ndarray, size: int, bits: int, bands: int) -> np.ndarray:
    """Of each row the bits of its bands, as integers; codes are the words of all rotations."""
    per = size // bits
    flat = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8), axis=1, bitorder="little")
    out = np.empty((len(codes), bands), np.int64)
    weight = 1 << np.arange(bits, dtype=np.int64)
    for i in range(bands):
        at = (i // per) * size + (i % per) * bits
        out[:, i] = flat[:, at : at + bits] @ weight
    return out


def _pairs(starts: np.ndarray, counts: np.ndarray):
    """Pairs (x, y), x before y, of the rows of each run, some PAIRS at a time."""
    ends = np.repeat(starts + counts, counts)
    row = np.arange(len(ends))
    after = ends - row - 1
    total = np.cumsum(after)
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        n = after[at:stop]
        x = np.repeat(row[at:stop], n)
        if len(x):
            yield x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        at = stop


def near_vectors(rows: DataFrame, threshold: float = 0.98, miss: float = 1e-5, confidence: float = 6.0, seed: int = 7, fill: int = 32) -> DataFrame:
    """vec_id, n_links, component_id and kept of each of rows(id, label, vector): links are pairs of one label with a cosine of at least the threshold.

    miss bounds the share of pairs at the threshold that no bucket holds; confidence is that of the estimates, in standard deviations; fill is how
    many vectors of the largest label a bucket holds if bits fall evenly."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie between 0 and 1")
    single = rows.schema["vector"].dataType.simpleString() == "array<float>"
    kind, real_type = ("array<float>", np.float32) if single else ("array<double>", np.float64)
    rows = rows.select(F.col("id").cast("long").alias("id"), "label", F.col("vector").cast(kind).alias("vector"))
    takes = F.expr(f"id IS NOT NULL AND label IS NOT NULL AND {FIT}")
    rows = rows.withColumn("takes", F.coalesce(takes, F.lit(False)))
    key = F.struct(F.col("label"), F.xxhash64(F.lit(1), "vector").alias("h1"), F.xxhash64(F.lit(2), "vector").alias("h2"))
    own = rows.where("takes").withColumn("class", key)
    grouped = own.groupBy("class").agg(F.min("id").alias("first"), F.count("*").alias("rows"), F.first("vector").alias("vector"))
    classes = stored(grouped.select(F.monotonically_increasing_id().alias("node"), "*", F.size("vector").alias("dim")), "vectors")
    out = rows.where(~F.col("takes")).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))

    most = classes.groupBy("class.label", "dim").count().agg(F.max("count")).first()[0] or 1
    bits = min(24, max(4, math.ceil(math.log2(most / fill)) if most > fill else 4))
    bands = bands_for(threshold, bits, miss)
    wide = classes.select("node", "rows", "vector", "dim", F.xxhash64(F.lit(3), "class.label", "dim").alias("tag"))

    def code(batches):
        import pyarrow as pa

        for whole in batches:
            dims = whole.column(3).to_numpy()
            for d in np.unique(dims):
                part = whole.filter(pa.array(dims == d))
                size = padded(int(d))
                rotations = -(-bands // (size // bits))
                for batch in (part.slice(i, max(1, (1 << 20) // size)) for i in range(0, part.num_rows, max(1, (1 << 20) // size))):
                    v = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(d))
                    codes, planes, real = coded(v.astype(np.float64), rotations, seed)
                    keys = band_keys(codes, size, bits, bands)
                    offsets = pa.array(np.arange(0, keys.size + 1, bands), pa.int32())
                    blob = [np.concatenate([a, b]).tobytes() for a, b in zip(codes, planes)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(1), pa.array([x.tobytes() for x in v], pa.binary()), batch.column(3), batch.column(4), pa.array(blob, pa.binary()), *(pa.array(x) for x in real.T), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
                        ["node", "rows", "v", "dim", "tag", "code", "factor", "low", "step", "keys"],
                    )

    schema = "node long, rows long, v binary, dim int, tag long, code binary, factor double, low double, step double, keys array<long>"
    held = stored(wide.mapInArrow(code, schema), "codes")
    bucket = F.xxhash64(F.lit(4), "tag", "band", "bits")
    sizes = held.select("tag", F.posexplode("keys").alias("band", "bits")).select(bucket.alias("bucket")).groupBy("bucket").count()
    sizes = stored(sizes.where(F.col("count") > BLOCK).select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")), "large")
    dealt = held.select("*", F.posexplode("keys").alias("band", "bits")).withColumn("bucket", bucket).drop("keys", "bits")
    dealt = dealt.join(sizes, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = F.xxhash64(F.lit(6), "bucket", F.least("i", "j"), F.greatest("i", "j"))
    dealt = dealt.select(met.alias("bucket"), "tag", "band", F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2).alias("side"), "node", "rows", "v", "dim", "code", "factor", "low", "step")

    def link(batches):
        """Counts by node (to is null), and a forest of the links (node, to)."""
        import pyarrow as pa

        def done(table):
            dims = table["dim"].to_numpy()
            for d in np.unique(dims):  # the runs of one dimension
                yield from of_dim(table.filter(pa.array(dims == d)), int(d))

        def of_dim(t, d):
            size = padded(d)
            bucket, tag, band, side, node, many = (t[c].to_numpy() for c in ("bucket", "tag", "band", "side", "node", "rows"))
            words = size // 64
            blob = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint64).reshape(len(t), -1)
            codes, planes = blob[:, : -PLANES * words], blob[:, -PLANES * words :]
            real = np.stack([t[c].to_numpy() for c in ("factor", "low", "step")], axis=1)
            v = scaled(np.frombuffer(b"".join(t["v"].to_pylist()), real_type).reshape(-1, d).astype(np.float64))
            length = np.sqrt((v * v).sum(axis=1))
            keys = band_keys(codes, size, bits, bands)
            starts = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (tag[1:] != tag[:-1]) | (band[1:] != band[:-1])))
            nodes, place = np.unique(node, return_inverse=True)
            links = np.zeros(len(nodes), np.int64)
            trees = []
            for x, y in _pairs(starts, np.diff(np.append(starts, len(t)))):
                apart = (side[x] == 0) | (side[x] != side[y])  # of two blocks only pairs across
                x, y = x[apart], y[apart]
                near = estimates(codes[:, :words], planes, real, x, y) + allowance(real, size, x, y, threshold, confidence) >= threshold
                x, y = x[near], y[near]
                for a in range(0, len(x), max(1, (1 << 21) // d)):
                    p, q = x[a : a + max(1, (1 << 21) // d)], y[a : a + max(1, (1 << 21) // d)]
                    exact = (v[p] * v[q]).sum(axis=1) / (length[p] * length[q]) >= threshold
                    p, q = p[exact], q[exact]
                    before = (keys[p] == keys[q]) & (np.arange(bands) < band[p][:, None])
                    first = ~before.any(axis=1)
                    p, q = p[first], q[first]
                    if len(p):
                        np.add.at(links, place[p], many[q])
                        np.add.at(links, place[q], many[p])
                        trees += _forest([pa.RecordBatch.from_arrays([pa.array(node[p]), pa.array(node[q])], ["a", "b"])])
            some = links > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some]), pa.nulls(int(some.sum()), pa.int64())], ["node", "links", "to"])
            if trees:
                joined = pa.Table.from_batches(trees).combine_chunks().to_batches()
                for tree in _forest(joined):
                    yield pa.RecordBatch.from_arrays([tree.column(0), pa.array(np.zeros(tree.num_rows, np.int64)), tree.column(1)], ["node", "links", "to"])

        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            key = t["bucket"].to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on
            if cut:
                yield from done(t.slice(0, cut).combine_chunks())
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield from done(rest.combine_chunks())

    n_parts = max(held.sparkSession.sparkContext.defaultParallelism, -(-held.count() * bands // 50_000))
    found = dealt.repartition(n_parts, "bucket").sortWithinPartitions("bucket", "tag", "band").mapInArrow(link, "node long, links long, to long")
    found = stored(found, "links")
    counts = found.where("to IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.where("to IS NOT NULL").select(F.col("node").alias("a"), F.col("to").alias("b")))
    known = classes.select("node", "class", "first", "rows").join(counts, "node", "left").join(comp, "node", "left")
    known = stored(known.select("class", "first", "rows", F.coalesce("comp", "node").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links")), "known")
    lowest = known.groupBy("comp").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    known = stored(hot_join(known, lowest, "comp", "members", known.count()).select("class", "rows", "n_links", "component_id"), "classes")
    drop(held, found)
    own = hot_join(own.select("id", "class"), known, "class", "rows", own.count()).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    out = own.unionByName(out)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op11_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS id", "label", "embedding AS vector"))
