"""Spelling variants: words that differ by one inserted, deleted or replaced code point, each with the form it is taken for.

Words are counted over all documents by column functions. A word of n code points gets a rolling hash: a sum of its code
points' random numbers times powers of an odd base, modulo 2 ** 64. Prefix sums of it give the hash of the word
without any one of its code points by a few NumPy operations (what follows the gap moves down by one power), so a word's n deletion keys are
integers and no string is ever cut. Keys of two kinds meet: a word and the words that become it by one deletion (an insertion or
deletion between the two), and two words of one length that agree after the same place is deleted (a replacement). Keys are partitioned by
their leading bits and sorted; equal neighbours are candidates, which are verified on the strings. A key of the
second kind has no more words than there are letters, one of the first no more than letters times places, so no key is hot,
whatever the number of documents.

Cases: null and empty texts have no words; a null doc_id is written as nothing in the digest; very long runs are words like others (their keys
grow with their length, not with its square); a repeated row counts again; ties in a word's best neighbour go to the smaller word in code-point order;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LOWER, UPPER
from .common import drop, mix, stored

RUN = r"[A-Za-zÀ-ÿ]+"
#: So many keys are sorted in a task, and so many pairs are made at a time.
KEYS, PAIRS = 1 << 19, 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def counted_words(docs: DataFrame, least_length: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """(word, n): runs of letters of docs(doc_id, text), lower-cased A-Z; where every divides the run's digest, one code point is deleted."""
    runs = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length)  # none gets longer
    h = F.crc32(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' code points in one array, and where each word starts (with the end)."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return flat, np.append(0, np.cumsum([len(w) for w in words]))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def deletion_keys(flat: np.ndarray, starts: np.ndarray):
    """(key, word, kind): of each word itself, of each of its deletions to meet a word, and of each deletion by its place.

    kind 0 is the word itself, 1 a deletion (the first of those that give the same string), 2 a deletion at a place; kinds 0 and 1 share keys."""
    n = np.diff(starts)
    word = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(flat)) - starts[:-1][word]
    with np.errstate(over="ignore"):
        power = _powers(int(n.max()) + 1) if len(n) else np.ones(1, np.uint64)
        value = mix(flat.astype(np.uint64) + np.uint64(1)) * power[place]
        before = np.cumsum(value) - value
        # sums of one word: what came before it is taken off, modulo 2 ** 64
        before -= before[np.minimum(starts[:-1], max(0, len(flat) - 1))][word]
        total = np.zeros(len(n), np.uint64)
        last = np.flatnonzero(n > 0)
        total[last] = (before + value)[starts[1:][last] - 1]
        without = before + (total[word] - before - value) * np.uint64(INVERSE)
        length = n.astype(np.uint64)
        whole = mix(total + mix(length + np.uint64(1)))
        cut = mix(without + mix(length[word]))
        placed = mix(mix(without + np.uint64(0x5851F42D4C957F2D)) + mix((length[word] << np.uint64(32)) + place.astype(np.uint64)))
    first = np.ones(len(flat), bool)
    first[1:] = (flat[1:] != flat[:-1]) | (place[1:] == 0)
    every = np.arange(len(n))
    return np.concatenate([whole, cut[first], placed]), np.concatenate([every, word[first], word]), np.repeat(np.array([0, 1, 2], np.int8), [len(n), int(first.sum()), len(flat)])


def candidates(key: np.ndarray, word: np.ndarray, kind: np.ndarray):
    """Yields (a, b), both ways round, of the words that share a key, a word with a deletion or two deletions at a place."""
    order = np.argsort(key, kind="stable")  # a radix sort
    key, word, kind = key[order], word[order], kind[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    many = np.repeat(size > 1, size)
    word, kind = word[many], kind[many]
    size = size[size > 1]
    end = np.repeat(np.cumsum(size), size)
    row = np.arange(len(word))
    # each row meets those after it in its run; of a word and its neighbours only the word meets all
    after = np.where(kind == 1, 0, end - row - 1)
    run_start = np.repeat(np.cumsum(size) - size, size)
    total = np.cumsum(after)
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        n = after[at:stop]
        x = np.repeat(row[at:stop], n)
        if len(x):
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            # equal kinds 2 meet, and 0 meets 1
            ok = (kind[x] + kind[y] == 1) | ((kind[x] == 2) & (kind[y] == 2))
            a, b = word[x[ok]], word[y[ok]]
            ok = a != b
            yield np.concatenate([a[ok], b[ok]]), np.concatenate([b[ok], a[ok]])
        at = stop


def _keyed(batches):
    import pyarrow as pa

    for batch in batches:
        ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        a = 0
        while a < len(words):  # some PAIRS code points at a time
            b, size = a, 0
            while b < len(words) and (b == a or size + len(words[b]) <= PAIRS // 4):
                size += len(words[b])
                b += 1
            key, word, kind = deletion_keys(*code_points(words[a:b]))
            for i in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 16)].view(np.int64)), pa.array(ids[a + word[i : i + (1 << 16)]]), pa.array(kind[i : i + (1 << 16)])], ["key", "id", "kind"])
            a = b


def _paired(group):
    import pyarrow as pa

    key, ids, kind = (group[c].to_numpy() for c in ("key", "id", "kind"))
    # a word comes before its deletions in a run of equal keys
    by = np.argsort(kind, kind="stable")
    found = [pa.table([pa.array(a), pa.array(b)], ["a", "b"]) for a, b in candidates(key[by], ids[by], kind[by])]
    return pa.concat_tables(found) if found else pa.table([pa.array([], pa.int64()), pa.array([], pa.int64())], ["a", "b"])


def one_apart(a: Column, b: Column) -> Column:
    """Whether two strings differ by exactly one inserted, deleted or replaced code point."""
    return F.levenshtein(a, b, 1) == 1


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of each of words(word, n), which must differ."""
    words = stored(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    keys = stored(words.select("id", "word").mapInArrow(_keyed, "key long, id long, kind byte"), "keys")
    bits = max(0, (keys.count() // KEYS).bit_length())
    parts = keys.withColumn("part", F.shiftrightunsigned("key", 63 - bits)).groupBy("part").applyInArrow(_paired, "a long, b long")
    pairs = parts.join(words.select(F.col("id").alias("a"), F.col("word").alias("a_word")), "a").join(words.select(F.col("id").alias("b"), F.col("word").alias("b_word"), F.col("n").alias("b_n")), "b")
    pairs = pairs.where(one_apart(F.col("a_word"), F.col("b_word"))).dropDuplicates(["a", "b"])
    best = pairs.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("m"), F.col("b_word").alias("word"), F.col("b").alias("id"))).alias("best"))
    near = stored(words.join(best.withColumnRenamed("a", "id"), "id", "left"), "near")
    drop(keys)
    takes = -F.col("best.m") >= 2 * F.col("n")  # a form comes at least twice as often, so that forms of forms end
    forms = stored(near.where(takes).select("id", F.col("best.id").alias("to")), "forms")
    roots = rooted(forms)
    named = roots.join(words.select(F.col("id").alias("to"), F.col("word").alias("root")), "to").select("id", "root")
    out = near.join(named, "id", "left")
    return out.select("word", F.when(takes, F.col("best.word")).alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, -F.col("best.m")).alias("form_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """(id, to) with each id followed to its last: the steps double from round to round, and those that have ended leave."""
    done, going = None, forms
    while not going.isEmpty():
        jump = going.select(F.col("id").alias("to"), F.col("to").alias("next"))
        if done is not None:
            jump = jump.unionByName(done.select(F.col("id").alias("to"), F.col("to").alias("next")))
        moved = stored(going.join(jump, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("on")), "forms")
        ended = moved.where("NOT on").drop("on")
        done = ended if done is None else done.unionByName(ended)
        going = moved.where("on").drop("on")
    return forms if done is None else done


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(counted_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
