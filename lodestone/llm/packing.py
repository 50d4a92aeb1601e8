"""Best-fit packing of documents into sequences of at most a fixed number of tokens.

Only lengths matter to a packing, and there are at most `most` different ones, so the plan is made on the driver
from the number of pieces of each length, whatever the number of documents. The linear grouping scheme:
large lengths, sorted, are cut into groups of equal cardinality and rounded up to the largest of the group; for these few
sizes, configurations are made one after the other, each with the largest size left and the best filling of the rest
(an exact knapsack), and used as often as the groups allow; actual lengths then take the rounded ones' places, and
small lengths go, largest first, where they fit best. What counts as large and how many groups there are is tried in a
few settings, the last with nothing large (best fit for all), and the plan with fewest sequences is taken. Each rule says: of the pieces of a length, those of rank lo to
hi go to sequences from `base`, k in each, from `offset` on. Pieces get their rank without a shuffle of the texts:
by task first, and by running sums over the tasks' counts.

Cases: null text counts as empty: its one token is the end id; null ids stay null; repeated rows are packed each;
texts longer than a sequence are cut; pieces of one length tie: which of them goes where is no part of the result's promise, the number of sequences is; an empty
table gives no sequences; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, stored
from .tokens import blocks, encoder, slices


def configurations(sizes: list[int], counts: list[int], most: int):
    """(places by size, times) until no count is left."""
    counts = list(counts)
    while any(counts):
        big = next(i for i, n in enumerate(counts) if n)
        room = most - sizes[big]
        came: list = [None] * (room + 1)
        came[0] = ()
        reach = [0]
        for i in range(big, len(sizes)):
            free = min(counts[i] - (i == big), room // sizes[i] if sizes[i] else 0)
            if free < 1:
                continue
            for at in list(reach):
                for k in range(1, free + 1):
                    to = at + k * sizes[i]
                    if to > room:
                        break
                    if came[to] is None:
                        came[to] = (at, i, k)
                        reach.append(to)
            if came[room] is not None:
                break
        at = max(reach)
        use = defaultdict(int)
        use[big] += 1
        while at:
            at, i, k = came[at]
            use[i] += k
        times = min(counts[i] // k for i, k in use.items())
        for i, k in use.items():
            counts[i] -= k * times
        yield dict(use), times


#: Groups of large lengths, and the share of a sequence above which a length is large.
SETTINGS = ((48, 1 / 8), (192, 1 / 8), (192, 1 / 4), (192, 1 / 2), (1, 1.0))


def plan(counts: dict[int, int], most: int = 4096) -> tuple[list[tuple], int]:
    """Rules (length, lo, hi, base, k, offset) for counts by length, and the number of sequences: the best of SETTINGS."""
    bound, best = -(-sum(x * n for x, n in counts.items()) // most), None
    for groups, large in SETTINGS:
        made = grouped_plan(counts, most, groups, large)
        if best is None or made[1] < best[1]:
            best = made
        if best[1] <= bound:  # no plan needs fewer
            break
    return best


def grouped_plan(counts: dict[int, int], most: int, groups: int, large: float) -> tuple[list[tuple], int]:
    """The linear grouping scheme in one setting."""
    rules: list[tuple] = []
    n_seq = 0
    open_: dict[int, list] = defaultdict(list)  # by room left: (first sequence, how many)
    rooms: list[int] = []

    def put(room: int, base: int, n: int) -> None:
        if room > 0 and n > 0:
            if not open_[room]:
                bisect.insort(rooms, room)
            open_[room].append((base, n))

    bound = max(1, int(most * large))
    big = sorted((x for x, n in counts.items() if n and x > bound), reverse=True)
    total = sum(counts[x] for x in big)
    # Equal-cardinality groups as runs (length, first rank, number), largest first.
    runs: list[list[list[int]]] = []
    size = max(1, -(-total // groups))
    left = 0
    for x in big:
        lo, n = 0, counts[x]
        while n:
            if not left:
                runs.append([])
                left = size
            k = min(n, left)
            runs[-1].append([x, lo, k])
            lo, n, left = lo + k, n - k, left - k
    sizes = [r[0][0] for r in runs]
    for use, times in configurations(sizes, [sum(x[2] for x in r) for r in runs], most):
        slots = []
        for i, k in use.items():
            for _ in range(k):
                need, slot = times, []
                while need:
                    x = runs[i][0]
                    take = min(need, x[2])
                    slot.append((x[0], x[1], take))
                    x[1] += take
                    x[2] -= take
                    need -= take
                    if not x[2]:
                        runs[i].pop(0)
                slots.append(slot)
        cuts = sorted({0, times, *(c for s in slots for c in np.cumsum([x[2] for x in s]).tolist())})
        for a, b in zip(cuts, cuts[1:]):
            offset = 0
            for s in slots:
                at = 0
                for x, lo, n in s:
                    if at <= a < at + n:
                        rules.append((x, lo + a - at, lo + b - at, n_seq + a, 1, offset))
                        offset += x
                        break
                    at += n
            put(most - offset, n_seq + a, b - a)
        n_seq += times
    for x in sorted((x for x, n in counts.items() if n and x <= bound), reverse=True):
        n, lo = counts[x], 0
        while n:
            i = bisect.bisect_left(rooms, x)
            if i == len(rooms):
                new = -(-n // (most // x))
                put(most, n_seq, new)
                n_seq += new
                continue
            room = rooms[i]
            base, bins = open_[room].pop()
            if not open_[room]:
                rooms.pop(i)
            k = room // x
            if n >= bins * k:
                rules.append((x, lo, lo + bins * k, base, k, most - room))
                put(room - k * x, base, bins)
                n, lo = n - bins * k, lo + bins * k
            else:
                full, rest = divmod(n, k)
                if full:
                    rules.append((x, lo, lo + full * k, base, k, most - room))
                    put(room - k * x, base, full)
                if rest:
                    rules.append((x, lo + full * k, lo + n, base + full, rest, most - room))
                    put(room - rest * x, base + full, 1)
                put(room, base + full + (rest > 0), bins - full - (rest > 0))
                n = 0
    return rules, n_seq


#: Chunks that a worker remembers: in the pipeline it works beside a JVM that earlier stages have filled.
KEEP = 300_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int, most: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, with the task that made it and its rank among that task's pieces of the same length."""

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        made, task, seen = encoder(tokenizer, KEEP), TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)
        end = np.array([end_id], np.uint32)
        for batch in (part for whole in batches for part in slices(whole)):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in blocks(texts):
                rows: list[tuple] = []
                for doc, found in zip(ids[part], made.encode(texts[part])):
                    data = np.concatenate([found, end])
                    for p, start in enumerate(range(0, len(data), most)):
                        x = data[start : start + most]
                        rows.append((doc, p, start, len(x), zlib.crc32(x.astype("<u4").tobytes()), task, int(seen[len(x)])))
                        seen[len(x)] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds())], names)

    def kinds():
        import pyarrow as pa

        return [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, most: int = 4096) -> DataFrame:
    """A row per piece, with sequence_id and offset."""
    with batches_of(docs.sparkSession, 1000):  # texts; what is placed below are numbers
        made = stored(pieces(docs, tokenizer, end_id, most), "pieces")
    per = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per = stored(per.select("length", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "counts")
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `most` rows
    rules, _ = plan(counts, most)
    rules = np.array(sorted(rules) or [(0, 0, 0, 0, 1, 0)], np.int64)
    sent = made.sparkSession.sparkContext.broadcast(rules)  # bounded by `most` and the number of groups

    def place(batches):
        import pyarrow as pa

        r = sent.value
        firsts = {int(x): i for i, x in reversed(list(enumerate(r[:, 0])))}
        lasts = {int(x): i + 1 for i, x in enumerate(r[:, 0])}
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            values, at = np.unique(length[order], return_index=True)
            for x, a, b in zip(values, at, [*at[1:], len(order)]):
                i, own = order[a:b], r[firsts[int(x)] : lasts[int(x)]]
                q = own[np.searchsorted(own[:, 1], rank[i], "right") - 1]
                j = rank[i] - q[:, 1]
                seq[i], off[i] = q[:, 3] + j // q[:, 4], q[:, 5] + j % q[:, 4] * x
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(per.select("length", "task", "first"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
