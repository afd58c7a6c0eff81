"""Best overlap of many sets of words with many sentences: blocks of both sides, counted exactly.

Claims and sentences become blocks, rows of bytes that a task can hold. The longest of all sentences
are counted in full against every claim; what a claim then has as its best (kept by a task from pair to
pair) bounds the rest. With a sentence's words rarest first, one that shares more words than ``best``
shares at least k of its first ``size - best + k - 1``: posting entries of such a reach are counted for
the claims of a block together, and only sentences with k of them are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.process_cache import frugal
from corpusmill.plans.staging import cut, small_batches, spread

#: Words of a block of sentences and of claims, and the longest of all sentences that are counted in full.
SENTENCE_WORDS, CLAIM_WORDS, LONGEST = 1_000_000, 500_000, 4096
#: Words of a sentence that must stand in a claim before the pair is compared, and posting entries taken at once.
TOGETHER, ENTRIES = 4, 1 << 18
#: Bytes of claim blocks that may be broadcast.
BLOCK_BYTES = 64 << 20

CLAIM_BLOCK = "c_ids binary, c_sizes binary, c_codes binary, c_words string"
SENTENCE_BLOCK = "s_sizes binary, s_codes binary, s_words string"


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))


def _within(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, .. of each range, one range after the other."""
    upto = np.cumsum(sizes)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - (upto - sizes), sizes)


class SentenceSide:
    """Postings of a block of distinct sentences: each word's sentences, those of the longest reach first."""

    def __init__(self, sizes: np.ndarray, codes: np.ndarray, words: list[str]):
        order = np.argsort(-sizes, kind="stable")  # longest first
        codes = codes[_within(_starts(sizes)[:-1][order], sizes[order])]
        self.sizes, self.vocabulary = sizes[order].astype(np.int64), {w: k for k, w in enumerate(words)}
        self.starts, n = _starts(self.sizes), len(words)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        rarest_first = np.lexsort((codes, np.bincount(codes, minlength=n)[codes], owner))
        self.codes = codes[rarest_first]
        reach = np.repeat(self.starts[1:], self.sizes) - np.arange(len(self.codes))  # size less the word's rank
        self.span = int(self.sizes[0]) + 1 if len(self.sizes) else 1
        key = self.codes.astype(np.int64) * self.span + (self.span - 1 - reach)
        by_key = np.argsort(key, kind="stable")
        self.keys, self.entries = key[by_key], owner[by_key].astype(np.int32)
        self.first = np.searchsorted(self.keys, np.arange(n + 1, dtype=np.int64) * self.span)

    def _known(self, sizes: np.ndarray, codes: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(claim, word) of the claims' words that stand in this block, and their number in each claim."""
        here = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int64, len(words))[codes]
        claim = np.repeat(np.arange(len(sizes)), sizes)[here >= 0]
        return claim, here[here >= 0], np.bincount(claim, minlength=len(sizes))

    def _met(self, claim: np.ndarray, here: np.ndarray, size: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Some claims at a time: where their words stand, and the first ``size`` entries of each word as sorted
        keys, (claim - the first of them) * sentences + sentence."""
        n, first, upto = len(self.sizes), self.first[here], np.cumsum(size)
        lo = 0
        while lo < len(claim):
            hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + ENTRIES, "right"))
            if hi < len(claim):  # whole claims, one at least
                hi = max(int(np.searchsorted(claim, claim[hi])), int(np.searchsorted(claim, claim[lo], "right")))
            own, local = slice(lo, hi), claim[lo:hi] - claim[lo]
            kind = np.int32 if (int(local[-1]) + 1) * n < 1 << 31 else np.int64
            key = np.repeat((local * n).astype(kind), size[own])
            key += self.entries[_within(first[own], size[own])]
            key.sort()
            yield own, key
            lo = hi

    def count(self, sizes: np.ndarray, codes: np.ndarray, words: list[str], best: np.ndarray) -> None:
        """Raise ``best`` of the claims by all entries of their words."""
        claim, here, _ = self._known(sizes, codes, words)
        self._count(claim, here, best)

    def meet(self, sizes: np.ndarray, codes: np.ndarray, words: list[str], best: np.ndarray) -> None:
        """The same by the entries that can lead to a better sentence."""
        claim, here, known = self._known(sizes, codes, words)
        open_ = np.minimum(known, self.span - 1) > best
        low = (open_ & (best < TOGETHER))[claim]
        self._count(claim[low], here[low], best)
        high = (open_ & (best >= TOGETHER))[claim]
        self._compare(claim[high], here[high], best)

    def _count(self, claim: np.ndarray, here: np.ndarray, best: np.ndarray) -> None:
        for own, key in self._met(claim, here, self.first[here + 1] - self.first[here]):
            if len(key):
                new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                np.maximum.at(best, claim[own][0] + key[new] // len(self.sizes), np.diff(np.append(new, len(key))))

    def _compare(self, claim: np.ndarray, here: np.ndarray, best: np.ndarray) -> None:
        """A better sentence shares ``TOGETHER`` words of a reach over best + 1 - TOGETHER; only such are compared."""
        wanted = here * self.span + (self.span - 2 - best[claim] + TOGETHER)
        order = np.argsort(wanted)
        size = np.empty(len(wanted), np.int64)
        size[order] = np.searchsorted(self.keys, wanted[order])
        size -= self.first[here]
        n, v = len(self.sizes), len(self.first)
        table = np.zeros(1 << 20, bool)  # most words of a sentence are found in no claim by their place in it
        for own, key in self._met(claim, here, size):
            last = key[TOGETHER - 1 :]
            pair = last[last == key[: len(last)]]
            if not len(pair):
                continue
            k, s = np.divmod(pair[np.append(True, pair[1:] != pair[:-1])].astype(np.int64), n)
            longer = self.sizes[s] > best[claim[own][0] + k]
            k, s = k[longer], s[longer]
            if not len(k):
                continue
            held = np.sort((claim[own] - claim[own][0]) * v + here[own])
            table[:] = False
            table[_place(held)] = True
            upto = np.cumsum(self.sizes[s])
            ends = np.unique(np.append(np.searchsorted(upto, np.arange(ENTRIES, upto[-1], ENTRIES)), len(k)))
            for lo, hi in zip(np.append(0, ends[:-1]), ends):
                length = self.sizes[s[lo:hi]]
                words = np.repeat(k[lo:hi] * v, length) + self.codes[_within(self.starts[s[lo:hi]], length)]
                near = np.flatnonzero(table[_place(words)])
                at = np.minimum(np.searchsorted(held, words[near]), len(held) - 1)
                shared = np.zeros(len(words), np.int32)
                shared[near] = held[at] == words[near]
                if hi > lo:
                    np.maximum.at(best, claim[own][0] + k[lo:hi], np.add.reduceat(shared, _starts(length)[:-1]))


def _place(x: np.ndarray) -> np.ndarray:
    return (x * 0x9E3779B1 >> 12) & ((1 << 20) - 1)


def _blocked(sets: Iterator[tuple[int, list[str]]], most: int) -> Iterator[tuple[list[int], list[int], list[int], list[str]]]:
    """(ids, sizes, codes, words) of sets, with ``most`` words and one set at least."""
    ids, sizes, codes, words = [], [], [], {}
    for i, s in sets:
        ids.append(i)
        sizes.append(len(s))
        codes += [words.setdefault(w, len(words)) for w in s]
        if len(codes) >= most:
            yield ids, sizes, codes, list(words)
            ids, sizes, codes, words = [], [], [], {}
    if ids:
        yield ids, sizes, codes, list(words)


def _distinct(sets: Iterator[set[str]]) -> Iterator[tuple[int, list[str]]]:
    """Sets that are not empty, copies among the last of them left out."""
    seen: set[frozenset[str]] = set()
    for s in sets:
        if s and (f := frozenset(s)) not in seen:
            if len(seen) >= 50_000:
                seen.clear()
            seen.add(f)
            yield 0, list(s)


def best_overlaps(claims: DataFrame, texts: DataFrame, split: Callable[[str], Iterator[set[str]]]) -> DataFrame:
    """(n, shared): the most words that each of ``claims`` (n, cw) shares with one sentence of ``texts`` (text).

    ``split`` gives the words of each sentence of a text. Nothing is held by the driver. A claim has a row
    from the longest sentences and one from each task that met a better one. The work is that of all pairs,
    less what the bounds leave out; a task holds a pair of blocks and a number for each claim that it met.
    """

    def claim_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((n, w) for b in batches for n, w in zip(b.column("n").to_pylist(), b.column("cw").to_pylist()))
        for ids, sizes, codes, words in _blocked(rows, CLAIM_WORDS):
            yield _row(["c_ids", "c_sizes", "c_codes", "c_words"], np.array(ids, np.int64), np.array(sizes, np.int32), _narrow(codes, words), words)

    def sentence_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (s for b in batches for t in b.column("text").to_pylist() if t is not None for s in split(t))
        for _, sizes, codes, words in _blocked(_distinct(found), SENTENCE_WORDS):
            yield _row(["s_sizes", "s_codes", "s_words"], np.array(sizes, np.int32), _narrow(codes, words), words)

    def long_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                sizes, codes, words = _read(r, "s")
                starts, rows = _starts(sizes), np.argsort(-sizes, kind="stable")[: max(1, LONGEST // 8)]
                texts = ["\n".join(words[c] for c in codes[starts[k] : starts[k + 1]]) for k in rows]
                yield pa.RecordBatch.from_arrays([pa.array(sizes[rows], pa.int32()), pa.array(texts)], names=["size", "words"])

    def one_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((0, w.split("\n")) for b in batches for w in b.column("words").to_pylist())
        for _, sizes, codes, words in _blocked(found, SENTENCE_WORDS):
            yield _row(["s_sizes", "s_codes", "s_words"], np.array(sizes, np.int32), _narrow(codes, words), words)
            return

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = None
        for b in batches:
            for k, r in enumerate(b.to_pylist()):
                side = side or SentenceSide(*_read(r, "s"))
                sizes, codes, words = _read(r, "c")
                own = np.zeros(len(sizes), np.int64)
                side.count(sizes, codes, words, own)
                at = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*(at.column(c) for c in ("c_ids", "c_sizes", "c_codes", "c_words")), pa.array([own.astype(np.int32).tobytes()], pa.binary())], names=["c_ids", "c_sizes", "c_codes", "c_words", "c_best"])

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield _shared(np.frombuffer(r["c_ids"], np.int64), np.frombuffer(r["c_best"], np.int32))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        last, side = None, None
        for b in batches:
            for r in b.to_pylist():
                block = r["s_sizes"], r["s_codes"], r["s_words"]  # codes alone may be those of other words
                if block != last:
                    last, side = block, SentenceSide(*_read(r, "s"))
                if r["c_ids"] not in best:
                    first = np.frombuffer(r["c_best"], np.int32)
                    best[r["c_ids"]] = first, first.astype(np.int64)
                side.meet(*_read(r, "c"), best[r["c_ids"]][1])
        for ids, (first, own) in best.items():
            better = own > first
            yield _shared(np.frombuffer(ids, np.int64)[better], own[better])

    small_batches(texts.sparkSession, 1 << 20)
    c = spread(claims.where(F.size("cw") > 0).select("n", "cw").mapInArrow(frugal(claim_blocks), CLAIM_BLOCK))
    s = cut(spread(texts.select("text")).mapInArrow(frugal(sentence_blocks), SENTENCE_BLOCK))
    longest = s.mapInArrow(frugal(long_ones), "size int, words string").orderBy(F.desc("size")).limit(LONGEST)
    head = cut(longest.coalesce(1).mapInArrow(frugal(one_block), SENTENCE_BLOCK))
    c = cut(c.crossJoin(F.broadcast(head)).mapInArrow(frugal(begin), f"{CLAIM_BLOCK}, c_best binary"))  # one row
    size: Column = F.octet_length("c_codes") + F.octet_length("c_words")
    parts = -(-(c.agg(F.sum(size)).first()[0] or 0) // BLOCK_BYTES)
    # some tasks a core, as blocks are few and large; a block of sentences is made ready once for each part of the claims
    tasks = 4 * texts.sparkSession.sparkContext.defaultParallelism
    s = s.repartition(tasks) if s.rdd.getNumPartitions() < tasks else s
    pairs = s.crossJoin(F.broadcast(c) if parts <= 1 else c.coalesce(parts))
    return c.mapInArrow(frugal(begun), SHARED).unionByName(pairs.mapInArrow(frugal(meet), SHARED))


SHARED = "n long, shared int"


def _shared(ids: np.ndarray, shared: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(shared.astype(np.int32))], names=["n", "shared"])


def _narrow(codes: list[int], words: list[str]) -> np.ndarray:
    return np.array(codes, np.uint16 if len(words) <= 1 << 16 else np.int32)


def _read(r: dict, side: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Sizes, codes and words of a block."""
    sizes, codes = np.frombuffer(r[f"{side}_sizes"], np.int32), r[f"{side}_codes"]
    kind = np.uint16 if len(codes) == 2 * int(sizes.sum()) else np.int32
    return sizes, np.frombuffer(codes, kind).astype(np.int32), r[f"{side}_words"].split("\n")


def _row(names: list[str], *columns) -> pa.RecordBatch:
    *arrays, words = columns
    return pa.RecordBatch.from_arrays([*(pa.array([a.tobytes()], pa.binary()) for a in arrays), pa.array(["\n".join(words)])], names=names)
