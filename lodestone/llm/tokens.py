"""Token ids by the tokenizers library, with words' ids remembered.

Both vocabularies part texts at a single space between other characters, so a text's ids are those of its chunks
(a word, with the space before it where the vocabulary keeps it). Chunks are encoded by the library, once a block of
texts, and those met again are kept in a dictionary of bounded size: most chunks of a large corpus come once and would
only take memory. Which were met is remembered by their hashes, in a table of fixed size; a chunk that it has forgotten
is encoded once more, with the same ids. Texts where a space follows a space, or ends the text after other white space, go to the library whole, as do those that name an added token.
"""

from __future__ import annotations

import os
from itertools import chain, compress, islice

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
MARK = "\x01"
#: Hashes of chunks that are remembered as met, a power of two.
MET = 1 << 20


class _Numbers(dict):
    """Numbers chunks as they come."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n


class Encoder:
    def __init__(self, path: str, keep: int = 900_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: Texts that hold one of the vocabulary's added tokens go to the library whole: it looks for them first.
        self.added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        a, b, both = (self._direct(x) for x in ("a", "b", "a b"))
        self.lead = " " if both != a + b else ""
        #: What stands between chunks when many are encoded at once: a character's own pretoken.
        self.mark = self._direct(self.lead + MARK)
        self.keep = keep
        self.met = np.zeros(MET, np.uint32)
        self._forget()

    def _direct(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.numbers, self.flat, self.ends, self.n_flat, self.n = _Numbers(), np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0, 0
        self.seen = np.zeros(1 << 14, np.int32)

    def _shrink(self) -> None:
        """Keeps the chunks that came more than once, or more often still, if they are at most half of what may be kept."""
        least = 2
        while (stay := self.seen[: self.n] >= least).sum() > self.keep // 2:
            least *= 2
        lengths = np.diff(self.ends[: self.n], prepend=0)
        flat = self.flat[: self.n_flat][np.repeat(stay, lengths)]
        numbers, seen, ends = _Numbers((c, i) for i, c in enumerate(compress(self.numbers, stay))), self.seen[: self.n][stay], np.cumsum(lengths[stay])
        self._forget()
        self.numbers, self.n, self.n_flat = numbers, len(ends), len(flat)
        self.flat = np.concatenate([flat, self.flat])
        self.ends = np.concatenate([ends, self.ends])
        self.seen = np.concatenate([seen, self.seen])

    def _admit(self, new: list[str]) -> None:
        """Of the chunks numbered last, those stay that came more than once, in this block or before it."""
        first = self.n - len(new)
        at = int(self.ends[first - 1]) if first else 0
        hashes = np.fromiter(map(hash, new), np.int64, len(new)).view(np.uint64)
        places, tags = hashes % np.uint64(MET), (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        stay = (self.met[places] == tags) | (self.seen[first : self.n] > 1)
        self.met[places] = tags
        for _ in new:
            self.numbers.popitem()
        lengths = np.diff(self.ends[first : self.n], prepend=at)
        flat, ends, seen = self.flat[at : self.n_flat][np.repeat(stay, lengths)], at + np.cumsum(lengths[stay]), self.seen[first : self.n][stay]
        self.seen[first : self.n] = 0
        self.n, self.n_flat = first + len(ends), at + len(flat)
        self.numbers.update(zip(compress(new, stay), range(first, self.n)))
        self.flat[at : self.n_flat], self.ends[first : self.n], self.seen[first : self.n] = flat, ends, np.maximum(seen, 2)

    def _learn(self, chunks: list[str]) -> None:
        """Appends the ids of the chunks numbered last."""
        for i in range(0, len(chunks), 4000):
            part = chunks[i : i + 4000]
            if MARK in "".join(part) or len(self.mark) > 2:
                found = [np.array(self._direct(self.lead + x if x or self.lead else x), np.uint32) for x in part]
                ids, lengths = np.concatenate(found), np.array([len(x) for x in found])
            else:
                said = [f"{self.lead or ' '}{x} {MARK}" for x in part]
                texts = ["".join(said[j : j + 40]) for j in range(0, len(said), 40)]  # short ones are encoded fastest
                ids = np.fromiter(chain.from_iterable(e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)
                stops = np.flatnonzero(ids == self.mark[-1])
                starts = np.append(0, stops[:-1] + 1)
                lengths, stay = stops + 1 - len(self.mark) - starts, np.ones(len(ids), bool)
                for k in range(len(self.mark)):
                    stay[stops - k] = False
                ids = ids[stay]
            need = self.n_flat + int(lengths.sum())
            while need > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while self.n + len(part) > len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
                self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
            self.flat[self.n_flat : need] = ids
            self.ends[self.n : self.n + len(part)] = self.n_flat + np.cumsum(lengths)
            self.n_flat, self.n = need, self.n + len(part)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers. Texts should come in blocks()."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        which, parts = [], []
        for i, t in enumerate(texts):
            if any(x in t for x in self.added) or self.lead and ("  " in t or t[-1:] == " " and t[-2:-1].isspace()):
                out[i] = np.array(self._direct(t), np.uint32)
            elif t:
                which.append(i)
                parts.append(t.split(" "))
        if not which:
            return out
        if len(self.numbers) > self.keep:
            self._shrink()
        heads = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast([w[0] for w in parts], add_special_tokens=False)]
        counts = np.array([len(w) - 1 for w in parts])
        before = len(self.numbers)
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(w[1:] for w in parts)), np.int64, int(counts.sum()))
        new = list(islice(reversed(self.numbers), len(self.numbers) - before))[::-1]
        self._learn(new)
        np.add.at(self.seen, numbers, 1)
        ends = self.ends[numbers]
        starts = np.where(numbers > 0, self.ends[numbers - 1], 0)
        lengths = ends - starts
        after = np.cumsum(lengths)
        total = int(after[-1]) if len(after) else 0
        ids = self.flat[np.arange(total) + np.repeat(starts - (after - lengths), lengths)]
        cuts = np.append(0, after)[np.append(0, np.cumsum(counts))]
        for j, (i, head) in enumerate(zip(which, heads)):
            out[i] = np.concatenate([head, ids[cuts[j] : cuts[j + 1]]])
        if new and max(map(len, new)) > 1000:  # very long chunks are not kept
            self._forget()
        elif new:
            self._admit(new)
        return out


_made: dict[str, Encoder] = {}


def encoder(path: str, keep: int = 900_000) -> Encoder:
    if path not in _made:
        _made[path] = Encoder(path, keep)
    return _made[path]


def slices(batch, rows: int = 256):
    """An Arrow batch in slices, so that few of its texts are Python strings at a time."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def blocks(texts: list[str], chars: int = 500_000):
    """Slices of texts of about so many characters."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield slice(at, i + 1)
            at, total = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))
