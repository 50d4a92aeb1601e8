"""Rotation codes, ball trees and deletion keys against brute force, with nulls, bad values, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import balltree, codes, spelling

VECTORS = "id long, vector array<float>, label int, node long, rows long, bucket long, x array<long>, cluster int, n long"
DOCS = "doc_id long, text string, word string, n long, id long, key long"


def vectors(spark, rows):
    """rows of (id, vector, label) with columns that clash."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, 2, 3, [4], 5, 6) for i, v, label in rows], VECTORS).repartition(3)


BAD = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63]


def clustered(n=400, dim=64, seed=1):
    """Vectors around few centres at all angles, some equal, some scaled."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dim))
    v = centre[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.1, 0.2, 1], n)[:, None]
    v[5:9] = v[4]
    v[9] = 3 * v[4]
    return np.float32(v)


def brute_links(rows, threshold=0.98):
    """{place: (links, component)} of rows (id, vector, label), by place."""
    ok = [i for i, (id_, v, label) in enumerate(rows) if id_ is not None and label is not None and v is not None and len(v) and None not in list(v) and np.isfinite(np.float64(v)).all() and np.any(np.float64(v))]
    links = {i: set() for i in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.float64(rows[a][1]), np.float64(rows[b][1])
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a].add(b)
    low = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        low[i] = rows[i][0] if len(seen) == 1 else min(rows[x][0] for x in seen)
    return sorted([(rows[i][0], len(links[i]), low[i], rows[i][0] is None or rows[i][0] == low[i]) for i in range(len(rows))], key=repr)


def test_near_vectors(spark, monkeypatch):
    v = clustered()
    rows = [(i, x.tolist(), int(i % 3)) for i, x in enumerate(v)]
    rows += [(1000 + i, x, 1) for i, x in enumerate(BAD)] + [(None, v[4].tolist(), 1), (1100, v[4].tolist(), None), (1101, [1.0, 2.0], 1), (1102, [1.0, 2.001], 1), (1103, [1.0], 1), (1104, [2.0], 1), (1105, [-2.0], 1)]
    rows += [rows[4], rows[4]]  # repeated rows
    want = brute_links(rows)
    assert sum(r[1] for r in want) > 400
    for block in (codes.BLOCK, 8):  # buckets in one piece, and dealt to blocks
        monkeypatch.setattr(codes, "BLOCK", block)
        got = sorted(map(tuple, codes.near_vectors(vectors(spark, rows)).collect()), key=repr)
        assert got == want


def test_near_vectors_of_extreme_lengths(spark):
    """Squares that overflow or vanish; doubles stay doubles."""
    rows = [(i, (np.array([1.0, 2, 3, 4 + 1e-3 * i]) * 10.0**e).tolist(), 1) for i, e in enumerate((300, -300, 0, 307, -310))]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    assert [r["n_links"] for r in codes.near_vectors(df).collect()] == [4] * 5


def test_near_vectors_of_nothing(spark):
    assert codes.near_vectors(vectors(spark, [])).collect() == []
    assert [tuple(r) for r in codes.near_vectors(vectors(spark, [(3, None, None)])).collect()] == [(3, 0, 3, True)]
    with pytest.raises(ValueError):
        codes.near_vectors(vectors(spark, []), threshold=0)


def test_estimates_are_unbiased_and_their_bound_holds():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1, 64))
    x /= np.linalg.norm(x)
    other = rng.normal(size=(4000, 64))
    other -= (other @ x.T) * x
    other /= np.linalg.norm(other, axis=1)[:, None]
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * other
    b = np.arange(1, 4001)
    a = np.zeros(4000, int)
    means = []
    for seed in range(60):  # over rotations and dithers
        code, planes, real = codes.coded(np.concatenate([x, y]), 1, seed)
        got = codes.estimates(code, planes, real, a, b)
        means.append(got.mean())
        assert got.std() > 0.005 and (got + codes.allowance(real, 64, a, b, 0.98, 6.0) >= 0.98).all()
    assert abs(np.mean(means) - 0.98) < 4 * np.std(means) / 60**0.5 + 1e-4
    # others are told apart without being recomputed
    code, planes, real = codes.coded(np.concatenate([x, other]), 1, 7)
    far = codes.estimates(code, planes, real, a, b)
    assert (far + codes.allowance(real, 64, a, b, 0.98, 6.0) < 0.98).mean() > 0.999


def test_rotations_keep_products():
    v = np.random.default_rng(4).normal(size=(20, 128))
    r = codes.rotated(v, codes._signs(128, 2, 9)[1])
    assert np.allclose(r @ r.T, v @ v.T)


def test_bands_lose_no_more_than_asked():
    """Of pairs at the threshold, over many rotations."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    o = rng.normal(size=x.shape)
    o -= (o * x).sum(1)[:, None] * x
    o /= np.linalg.norm(o, axis=1)[:, None]
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * o
    for bits, miss in ((8, 1e-2), (12, 1e-2), (16, 1e-3)):
        bands = codes.bands_for(0.98, bits, miss)
        rotations = -(-bands // (64 // bits))
        keys = [codes.band_keys(codes.coded(v, rotations, 7)[0], 64, bits, bands) for v in (x, y)]
        assert (~(keys[0] == keys[1]).any(axis=1)).mean() <= 2 * miss


# --- clusters ------------------------------------------------------------------------------------------------


def brute_clusters(rows, k=16, rounds=3):
    """{(id, cluster, ...)} of rows (id, vector), as the operator states it, in whole numbers of any size."""
    kept = [(i, [int(np.floor(64.0 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and None not in list(v) and np.isfinite(np.float64(v)).all()]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [x for _, x in order[:k]]

    def assigned():
        out = []
        for _, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, y)) for y in c]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        won = [j for j, _ in assigned()]
        for j in range(len(c)):
            own = [x for (_, x), w in zip(kept, won) if w == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    last = assigned()
    per = collections.Counter()
    for j, d in last:
        per[j] += d
    digest = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    return sorted([(i, j, d, per[j], sum(per.values()), digest[j]) for (i, _), (j, d) in zip(kept, last)], key=repr)


@pytest.mark.parametrize("tree_rows", [4096, 40])
def test_clusters(spark, tree_rows):
    v = clustered(300, seed=2)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    rows += [(1000 + i, x, 1) for i, x in enumerate(BAD)] + [(1100, [1.0] * 63, 1), (None, v[3].tolist(), None)]
    rows += [rows[7]] * 3 + [(2000 + i, [0.5] * 64, 1) for i in range(60)]  # ties and a ball of no width
    got = sorted(map(tuple, balltree.centroid_clusters(vectors(spark, rows), tree_rows=tree_rows).collect()), key=repr)
    assert got == brute_clusters([r[:2] for r in rows])


def test_clusters_of_large_numbers(spark):
    """Beyond what is exact in double precision; what makes no long is refused."""
    rng = np.random.default_rng(6)
    v = (rng.integers(-200_000, 200_000, (40, 64)) * np.ones(64)).tolist()
    rows = [(i, x, 1) for i, x in enumerate(v)]
    got = sorted(map(tuple, balltree.centroid_clusters(vectors(spark, rows)).collect()), key=repr)
    assert got == brute_clusters([r[:2] for r in rows])
    for x in (1e30, -3e38, 3e6):
        with pytest.raises(Exception, match="no long"):
            balltree.centroid_clusters(vectors(spark, [(1, [x] * 64, 1)]))


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows_make_few_clusters(spark, n):
    rows = [(i, [float(i)] * 64, 1) for i in range(n)]
    got = sorted(map(tuple, balltree.centroid_clusters(vectors(spark, rows)).collect()), key=repr)
    assert got == brute_clusters([r[:2] for r in rows]) and len(got) == n


def test_equal_centroids_leave_the_larger_empty(spark):
    rows = [(i, [1.0] * 64, 1) for i in range(20)] + [(30, [2.0] * 64, 1)]
    got = sorted(map(tuple, balltree.centroid_clusters(vectors(spark, rows)).collect()), key=repr)
    assert got == brute_clusters([r[:2] for r in rows])


def test_balls_are_assigned_whole():
    """Where rows lie in clusters most are never looked at; what balls and rows say together is what all rows say."""
    rng = np.random.default_rng(7)
    centre = rng.integers(-400, 400, (16, 8))
    x = centre[rng.integers(0, 16, 5000)] + rng.integers(-9, 10, (5000, 8))
    tree = balltree.BallTree(x)
    assert (tree.total[0] == x.sum(axis=0)).all() and (np.sort(tree.order) == np.arange(5000)).all()
    for i in range(len(tree.lo)):
        own = tree.rows[tree.lo[i] : tree.hi[i]]
        assert (own.sum(axis=0) == tree.total[i]).all() and np.sqrt(((own - tree.centre[i]) ** 2).sum(axis=1).max()) <= tree.radius[i] + 1e-9
    tree = balltree.BallTree.of(tree.parts(), 8)
    n, total, looked = tree.sums(centre)
    won = balltree.distances(x, centre).argmin(axis=1)
    assert looked < 1000
    assert (n == np.bincount(won, minlength=16)).all() and all((total[j] == x[won == j].sum(axis=0)).all() for j in range(16))
    label, far = tree.labels(centre)
    assert (label == balltree.distances(tree.rows, centre).argmin(axis=1)).all() and (far == balltree.distances(tree.rows, centre).min(axis=1)).all()


# --- words ---------------------------------------------------------------------------------------------------

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute_words(rows):
    c = collections.Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 97 == 0:
                k = h % len(r)
                r = r[:k] + r[k + 1 :]
            if len(r) >= 5:
                c[r] += 1
    return {w: n for w, n in c.items() if n >= 3}


def apart(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def brute_variants(c):
    near = {w: [x for x in c if apart(w, x)] for w in c}
    form = {}
    for w, xs in near.items():
        if xs:
            best = min(xs, key=lambda x: (-c[x], x))
            if c[best] >= 2 * c[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted([(w, form.get(w), root(w), c[w], len(near[w]), c[form[w]] if w in form else None) for w in c])


def texts(seed=1, n=400):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé×") for _ in range(rng.randint(4, 8))) for _ in range(60)] + ["aaaaa", "aaaaaa", "abcde", "abced", "Naïveté"]
    out = []
    for _ in range(n):
        w = [rng.choice(base[: rng.choice([5, 20, 65])]) for _ in range(rng.randint(1, 40))]
        for i in range(len(w)):
            if rng.random() < 0.2:
                k = rng.randrange(len(w[i]))
                w[i] = rng.choice([w[i][:k] + w[i][k + 1 :], w[i][:k] + "a" + w[i][k:], w[i][:k] + "B" + w[i][k + 1 :]])
        out.append("1 ".join(w))
    long = "xyz" * 3000
    return [None, "", " ,.", *out, *[long + " " + long + "a"] * 4, out[0], out[0]]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2, 3) for i, t in rows], DOCS).repartition(3)


def test_spelling(spark):
    rows = list(enumerate(texts())) + [(None, "abcde abced"), (None, None)]
    df = docs(spark, rows)
    assert {r["word"]: r["n"] for r in spelling.counted_words(df).collect()} == brute_words(rows)
    got = sorted(map(tuple, spelling.variants(spelling.counted_words(df)).collect()))
    want = brute_variants(brute_words(rows))
    assert got == want
    assert sum(r[1] is not None for r in want) > 30


def test_spelling_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "KEYS", 100)
    monkeypatch.setattr(spelling, "PAIRS", 50)
    words = brute_words(list(enumerate(texts(2, 100))))
    got = sorted(map(tuple, spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()))
    assert got == brute_variants(words)


def test_chains_of_forms(spark):
    words = {"abcdefgh"[:5] + "x" * i: 3 * 2**i for i in range(20)} | {"zzzzz": 3}
    got = sorted(map(tuple, spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()))
    assert got == brute_variants(words)
    assert {r[2] for r in got} == {"abcde" + "x" * 19, "zzzzz"}


def test_spelling_of_nothing(spark):
    assert spelling.variants(spelling.counted_words(docs(spark, []))).collect() == []
    assert spelling.variants(spelling.counted_words(docs(spark, [(1, None), (2, ""), (3, "one two")]))).collect() == []


def test_colliding_keys_are_verified(spark, monkeypatch):
    """Keys that say nothing make all words candidates; the strings still decide."""
    made = spelling.deletion_keys

    def poor(flat, starts):
        key, word, kind = made(flat, starts)
        return key % np.uint64(3), word, kind

    words = dict(list(brute_words(list(enumerate(texts(3, 60)))).items())[:60])
    monkeypatch.setattr(spelling, "deletion_keys", poor)
    found = set()
    ids = list(words)
    for a, b in spelling.candidates(*poor(*spelling.code_points(ids))):
        found |= {(ids[x], ids[y]) for x, y in zip(a.tolist(), b.tolist())}
    assert {(x, y) for x in words for y in words if apart(x, y)} < found
    kept = spark.createDataFrame(sorted(found), "a string, b string").where(spelling.one_apart(F.col("a"), F.col("b")))
    assert {tuple(r) for r in kept.collect()} == {(x, y) for x in words for y in words if apart(x, y)}


def test_deletion_keys_equal_keys_of_the_cut_words():
    words = ["abcde", "aabbcc", "éé", "x", ""]
    key, word, kind = spelling.deletion_keys(*spelling.code_points(words))
    cut = [w[:i] + w[i + 1 :] for w in words for i in range(len(w)) if i == 0 or w[i] != w[i - 1]]
    own = spelling.deletion_keys(*spelling.code_points(cut))
    assert (key[kind == 1] == own[0][own[2] == 0]).all()
