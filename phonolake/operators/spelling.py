"""Pairs of similar words of up to 60 letters, found in numpy by what they share.

Up to 20 letters each word is dealt to the hashes of its subsequences of ``length - k`` letters. Keys travel packed, many
to a row, and are sorted and paired where they meet. A pair meets once for each subsequence that its words share; it is
looked at under one of them only, so no pair has to be made distinct later. Longer words have too many subsequences: they
are cut in 2k + 1 segments of which one survives intact, shifted by at most k, and their pairs are made distinct.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that meet in one group, about; keys that a task deals out at once; pairs looked at together.
GROUP_KEYS = 1 << 18
DEALT_KEYS = 1 << 20
PAIRS_AT_ONCE = 1 << 17
#: Keys of one partition, about.
PARTITION_KEYS = 1 << 21
LONGEST = 20
LONGEST_CUT = 60

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_PACKED = "n int, part int, keys binary, ids binary, low binary, high binary, letters binary"


def unmatched(n: int) -> int:
    """Letters of a word of ``n`` that may stay unmatched at a ratio above 0.8."""
    return ceil(round(n * 0.2, 6)) - 1


def key_count(n: int) -> int:
    """Keys of a word of ``n`` letters, or a few more."""
    k = unmatched(n)
    return comb(n, k) if n <= LONGEST else (2 * k + 1) * (2 * k + 2)


@cache
def _left_out(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64).reshape(-1, k)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _prefixes(letters: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, one row for each length; ``letters`` has a row per word."""
    count, n = letters.shape
    sums = np.zeros((n + 1, count), np.uint64)
    for i in range(n):
        weight = np.uint64(pow(_BASE, i, 1 << 64))
        sums[i + 1] = sums[i] + _mixed(letters[:, i].astype(np.uint64) + np.uint64(1)) * weight
    return sums


def _keys(sums: np.ndarray, whole: np.ndarray, n: int, k: int, bits: int) -> np.ndarray:
    """Hashes of ``32 + bits`` bits of what is left when ``k`` letters of a window go, one row for each choice.

    ``sums`` are the prefix hashes at the window's places, ``whole`` those of the words.
    """
    choices = _left_out(n, k)
    out = sums[choices[:, 0]]
    for d in range(1, k + 1):
        end = sums[choices[:, d]] if d < k else whole
        out += (end - sums[choices[:, d - 1] + 1]) * np.uint64(pow(_UNBASE, d, 1 << 64))
    return _mixed(out) >> np.uint64(32 - bits)


def _segment_keys(sums: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hashes of the segments of the words (even) and of all places where a segment may have gone (odd), a row for each."""
    k = unmatched(n)
    starts = [i * n // (2 * k + 1) for i in range(2 * k + 2)]
    out = []
    for i, (at, end) in enumerate(zip(starts, starts[1:], strict=False)):
        for shift in (None, *range(-k, k + 1)):
            begin, stop = at + (shift or 0), end + (shift or 0)
            if begin >= 0 and stop <= n:
                piece = (sums[stop] - sums[begin]) * np.uint64(pow(_UNBASE, begin, 1 << 64))
                key = _mixed(piece + np.uint64(i * _BASE % (1 << 64))) >> np.uint64(32 - bits)
                out.append((key & ~np.uint64(1)) | np.uint64(shift is not None))
    return np.array(out)


def _narrow(values: np.ndarray, *types) -> np.ndarray:
    top = values.max() if values.size else 0
    low = values.min() if values.size else 0
    return values.astype(next((t for t in types[:-1] if low >= 0 and top <= np.iinfo(t).max), types[-1]))


def _binary(values: np.ndarray, ends: np.ndarray):
    """One binary value for each run of rows of ``values``; ``ends`` are the ends of the runs, from 0."""
    import pyarrow as pa

    values = np.ascontiguousarray(values)
    each = values.nbytes // max(1, len(values))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * each).astype(np.int32)), pa.py_buffer(values)])


def _deal(bits: dict[int, int]):
    """A ``mapInArrow`` function: the keys of the words, packed by length and part of the keys' hashes."""

    def packed(n, rows):
        import pyarrow as pa

        at_once = max(1, DEALT_KEYS // key_count(n))
        for start in range(0, len(rows[0]), at_once):
            words, ids, low, high = (column[start : start + at_once] for column in rows)
            letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, n)
            sums = _prefixes(letters)
            keys = _keys(sums, sums[n], n, unmatched(n), bits[n]) if n <= LONGEST else _segment_keys(sums, n, bits[n])
            keys = np.sort(np.ascontiguousarray(keys.T), axis=1)
            first = np.ones(keys.shape, bool)
            first[:, 1:] = keys[:, 1:] != keys[:, :-1]
            of, keys = np.nonzero(first)[0], keys[first]
            parts = keys >> np.uint64(32)
            order = np.argsort(parts.astype(np.uint16) if bits[n] <= 16 else parts, kind="stable")
            of, keys, parts = of[order], keys[order], parts[order]
            begins = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])
            ends = np.r_[begins, len(keys)]
            ids, low, high = (np.array(x, np.int64) for x in (ids, low, high))
            alike = (low == high).all()
            columns = [
                _binary(keys.astype(np.uint32), ends),
                _binary(_narrow(ids, np.uint32, np.int64)[of], ends),
                _binary(_narrow(low, np.uint32, np.int64)[of], ends),
                pa.array([b""] * len(begins), pa.binary()) if alike else _binary(high[of], ends),
                _binary(_narrow(letters, np.uint8, np.uint16, np.uint32)[of], ends),
            ]
            fixed = [pa.array(np.full(len(begins), n, np.int32)), pa.array(parts[begins].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*fixed, *columns], ["n", "part", "keys", "ids", "low", "high", "letters"])

    def run(batches):
        waiting: dict[int, list] = {}
        for batch in batches:
            lengths = batch.column(0).to_numpy()
            rows = [batch.column(i) for i in range(1, 5)]
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                own = waiting.setdefault(n, [[], [], [], []])
                for column, values in zip(own, rows, strict=True):
                    column.extend(values.take(at).to_pylist())
                if len(own[0]) * key_count(n) >= DEALT_KEYS:
                    yield from packed(n, waiting.pop(n))
        for n, rows in waiting.items():
            yield from packed(n, rows)

    return run


def _unpacked(values: list[bytes], counts: list[int], kinds: dict[int, type], width: int = 1) -> np.ndarray:
    """The values of several packed rows as one array."""
    parts = [np.frombuffer(v, kinds[len(v) // (c * width)]) for v, c in zip(values, counts, strict=True)]
    return np.concatenate(parts)


def matched_letters(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Letters that ``difflib.SequenceMatcher`` matches, for rows of words of at most 63 letters each.

    The longest common piece counts first, of equal ones the first in the left word, then in the right one; what lies
    before and after it is matched in the same way.
    """
    count, n = left.shape
    # a length and two places in one number
    step, kind_of = (5, np.int16) if max(n, right.shape[1]) < 32 else (6, np.int32)
    top = (1 << step) - 1
    total = np.zeros(count, np.int64)
    zero, full = np.zeros(count, np.int64), np.full(count, n)
    open_ = (np.arange(count), zero, full, zero, np.full(count, right.shape[1]))
    while len(open_[0]):
        kind = (open_[2] - open_[1]) * 64 + open_[4] - open_[3]
        order = np.argsort(kind, kind="stable")
        kind = kind[order]
        begins = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]).tolist()
        later = []
        for begin, end in zip(begins, [*begins[1:], len(kind)], strict=True):
            la, lb = divmod(int(kind[begin]), 64)
            for start in range(begin, end, 1 << 14):
                of, alo, ahi, blo, bhi = (x[order[start : min(end, start + (1 << 14))]] for x in open_)
                a = left[of, alo + np.arange(la)[:, None]]
                b = right[of, blo + np.arange(lb)[:, None]]
                # length, then lower place on the left, then lower place on the right
                place = (top - np.arange(lb, dtype=kind_of))[:, None]
                run = np.zeros((lb + 1, len(of)), kind_of)
                best = np.zeros(len(of), kind_of)
                for i in range(la):
                    now = run[:-1] + kind_of(1 << 2 * step)
                    now *= b == a[i]
                    run[1:] = now
                    now += place
                    np.maximum(best, now.max(axis=0) + kind_of((top - i) << step), out=best)
                size = (best >> 2 * step).astype(np.int64)
                np.add.at(total, of, size)
                last_a, last_b = top - ((best >> step) & top).astype(np.int64), top - (best & top).astype(np.int64)
                for x in (
                    (alo, alo + last_a + 1 - size, blo, blo + last_b + 1 - size),
                    (alo + last_a + 1, ahi, blo + last_b + 1, bhi),
                ):
                    some = (size > 0) & (x[1] > x[0]) & (x[3] > x[2])
                    later.append([of[some], *(v[some] for v in x)])
        open_ = tuple(np.concatenate(x) for x in zip(*later, strict=True))
    return total


class _Group:
    """Words of one length whose keys share a part of the hashes."""

    def __init__(self, n: int, part: int, bits: int, rows: list[tuple]):
        self.n, self.k, self.bits = n, unmatched(n), bits
        counts = [len(r[0]) // 4 for r in rows]
        keys = np.concatenate([np.frombuffer(r[0], np.uint32) for r in rows])
        wide = {4: np.uint32, 8: np.int64}
        self.ids = _unpacked([r[1] for r in rows], counts, wide).astype(np.int64)
        self.low = _unpacked([r[2] for r in rows], counts, wide).astype(np.int64)
        if any(r[3] for r in rows):
            ends = np.cumsum([0, *counts])
            self.high = np.concatenate([np.frombuffer(r[3], np.int64) if r[3] else self.low[a:b] for r, a, b in zip(rows, ends, ends[1:], strict=False)])
        else:
            self.high = self.low
        self.letters = _unpacked([r[4] for r in rows], counts, {1: np.uint8, 2: np.uint16, 4: np.uint32}, n).reshape(-1, n)
        order = np.argsort(keys, kind="stable")
        # words that meet no other one need no further look
        keys = keys[order]
        met = self.met(keys)
        order = order[met]
        self.keys = keys[met].astype(np.uint64) | np.uint64(part << 32)
        self.ids, self.low, self.high, self.letters = self.ids[order], self.low[order], self.high[order], self.letters[order]
        if n <= LONGEST:
            self.sums = _prefixes(self.letters)
        else:
            self.bag = np.zeros((len(self.keys), 32), np.uint8)
            for i in range(n):
                self.bag[np.arange(len(self.keys)), _mixed(self.letters[:, i].astype(np.uint64)) & np.uint64(31)] += np.uint8(1)

    def met(self, keys: np.ndarray) -> np.ndarray:
        if self.n > LONGEST:
            keys = keys >> keys.dtype.type(1)
        same = keys[1:] == keys[:-1]
        return np.r_[same, False] | np.r_[False, same]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the two rows of each pair with one key, some at a time."""
        if self.n <= LONGEST:
            others = np.arange(1, len(self.keys) + 1)
            rest = np.searchsorted(self.keys, self.keys, side="right") - others
        else:  # a whole segment meets the places of the others
            others = np.searchsorted(self.keys, self.keys | np.uint64(1), side="left")
            rest = np.searchsorted(self.keys, self.keys | np.uint64(1), side="right") - others
            rest[self.keys % np.uint64(2) == 1] = 0
        before = np.r_[0, np.cumsum(rest)]
        start = 0
        while start < len(rest):
            stop = max(start + 1, int(np.searchsorted(before, before[start] + PAIRS_AT_ONCE, side="right")) - 1)
            of = np.repeat(np.arange(start, stop), rest[start:stop])
            if len(of):
                yield of, others[of] + np.arange(before[start], before[stop]) - before[of]
            start = stop

    def shown(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pair counts under this key: the lowest one that both words have when letters go between what they begin and end with."""
        n, k = self.n, self.k
        same = self.letters[a] == self.letters[b]
        start = np.where(same.all(axis=1), 0, np.argmin(same, axis=1))
        end = np.where(same.all(axis=1), 0, n - np.argmin(same[:, ::-1], axis=1))
        end = np.minimum(np.maximum(end, start + k), n)
        start = np.minimum(start, end - k)
        width = end - start
        out = np.zeros(len(a), bool)
        for w in np.unique(width).tolist():
            of = np.flatnonzero(width == w)
            at_once = max(1, (1 << 20) // comb(w, k))
            for part in (of[i : i + at_once] for i in range(0, len(of), at_once)):
                places = start[part] + np.arange(w + 1)[:, None]
                one, two = (_keys(self.sums[places, x[part]], self.sums[n, x[part]], w, k, self.bits) for x in (a, b))
                if w == k:
                    lowest, some = one[0], one[0] == two[0]
                else:
                    both = np.concatenate([one << np.uint64(1), (two << np.uint64(1)) | np.uint64(1)])
                    both = np.sort(np.ascontiguousarray(both.T), axis=1)
                    meets = (both[:, 1:] ^ both[:, :-1]) == 1
                    at = np.argmax(meets, axis=1)
                    here = np.arange(len(part))
                    lowest, some = both[here, at] >> np.uint64(1), meets[here, at]
                out[part] = some & (lowest == self.keys[a[part]])
        return out

    def near(self, threshold: float):
        import pyarrow as pa

        for a, b in self.pairs():
            if self.n <= LONGEST:
                turned = self.ids[a] > self.ids[b]
                a, b = np.where(turned, b, a), np.where(turned, a, b)
            keep = (self.ids[a] < self.ids[b]) & ((self.low[a] != self.high[b]) | (self.high[a] != self.low[b]))
            a, b = a[keep], b[keep]
            keep = self.shown(a, b) if self.n <= LONGEST else np.minimum(self.bag[a], self.bag[b]).sum(axis=1) >= self.n - self.k
            a, b = a[keep], b[keep]
            keep = 2.0 * matched_letters(self.letters[a], self.letters[b]) / (2 * self.n) > threshold
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            text = self.letters[used].astype("<u4").tobytes().decode("utf-32-le")
            words = pa.array([text[i : i + self.n] for i in range(0, len(text), self.n)], pa.string())
            out = {"word1": words.take(pa.array(at[: len(a)])), "word2": words.take(pa.array(at[len(a) :]))}
            if self.n > LONGEST:
                out |= {"id1": pa.array(self.ids[a]), "id2": pa.array(self.ids[b])}
            yield pa.RecordBatch.from_pydict(out)


def _meet(bits: dict[int, int], threshold: float):
    """A ``mapInArrow`` function: the pairs of the packed rows, which come sorted by length and part."""

    def run(batches):
        group, rows = None, []
        for batch in batches:
            groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for i, own in enumerate(groups):
                if own != group and rows:
                    yield from _Group(*group, bits[group[0]], rows).near(threshold)
                    rows = []
                group = own
                rows.append(tuple(batch.column(c)[i].as_py() for c in range(2, 7)))
        if rows:
            yield from _Group(*group, bits[group[0]], rows).near(threshold)

    return run


def similar_words(words: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs ``word1, word2`` of equal length with a difflib ratio above ``threshold``, at least 0.8, and different sounds.

    ``words`` has the length ``n`` of at most 60 letters, word_id, word and ``low`` and ``high``, the least and greatest
    number of the word's sounds; a row per word_id and word. The word with the lower word_id comes first. The lengths
    are counted first, so that a group of keys stays small however many words there are. Runs that job when called.
    """
    sizes = {r["n"]: r["count"] * key_count(r["n"]) for r in words.groupBy("n").count().collect()}
    bits = {n: max(0, ceil(log2(keys / GROUP_KEYS))) for n, keys in sizes.items()}

    def found(kept, some: DataFrame, schema: str) -> DataFrame:
        dealt = some.select("n", "word", F.col("word_id").cast("bigint"), "low", "high").mapInArrow(_deal(bits), _PACKED)
        keys = sum(size for n, size in sizes.items() if kept(n))
        count = max(words.sparkSession.sparkContext.defaultParallelism, ceil(keys / PARTITION_KEYS))
        met = dealt.repartition(count, "n", "part").sortWithinPartitions("n", "part")
        return met.mapInArrow(_meet(bits, threshold), schema)

    short = found(lambda n: n <= LONGEST, words.filter(F.col("n") <= LONGEST), "word1 string, word2 string")
    if not any(n > LONGEST for n in sizes):
        return short
    long = found(lambda n: n > LONGEST, words.filter(F.col("n") > LONGEST), "word1 string, word2 string, id1 bigint, id2 bigint")
    return short.unionByName(long.distinct().select("word1", "word2"))
