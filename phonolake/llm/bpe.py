"""Encoding and decoding with a public byte-pair vocabulary, word by word and fragment by fragment.

A pair of bytes that occurs inside no vocabulary token can never be merged over, so a word may be cut there
and its fragments encoded on their own (forced boundaries). Words repeat, so each worker remembers a bounded
number of them; the fragments of words it has not seen are merged together, as rows of a matrix.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from phonolake.llm.common import per_row, texts

#: Words a worker remembers before it starts again with an empty table: a bound of memory, not of results.
REMEMBERED = 400_000
#: Fragments up to this many bytes are merged in a matrix, longer ones by a heap.
WIDEST = 64
#: White space of the Unicode standard, as a character class.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NO_RANK = np.int32(2**31 - 1)


@lru_cache(None)
def category_class(letter: str, end: int = sys.maxunicode + 1) -> str:
    """Members below ``end`` of the general category that starts with ``letter``, as ranges for a character class."""
    out, start = [], None
    for code in range(end + 1):
        inside = code < end and unicodedata.category(chr(code))[0] == letter
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(out)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def word_pattern(letter: str, number: str) -> str:
    return f"'(?:s|t|re|ve|m|ll|d)|[{letter}]+|[{number}]|[^{WHITE}{letter}{number}]+"


def spaced_pattern(letter: str, number: str) -> str:
    return f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{WHITE}{letter}{number}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


class Bpe:
    """The tokenizer of a vocabulary file.

    Two kinds of file are known: lower-cased words with an end mark, white space dropped, and byte-level words
    that keep the space before them.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as handle:
            spec = json.load(handle)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.lower = spec["normalizer"] is not None
        self.tokens = [b""] * (max(vocab.values()) + 1)
        for token, at in vocab.items():
            self.tokens[at] = token.encode()
        letters = byte_letters()
        number_of = {letter: b for b, letter in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + self.end] for c in letters], np.int32)
        self.inside = np.zeros((256, 256), bool)
        for token in vocab:
            raw = [number_of[c] for c in token.removesuffix(self.end)]
            self.inside[raw[:-1], raw[1:]] = True
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.joined = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.ranks = PairTable(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = word_pattern if self.lower else spaced_pattern
        self.narrow = re.compile(pattern(category_class("L", 256), category_class("N", 256)))
        self.wide = re.compile(pattern(category_class("L"), category_class("N")))
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        if not self.lower:
            return text
        text = unicodedata.normalize("NFC", text)
        # the final form of sigma depends on its neighbours in Python only
        return text.replace("Σ", "σ").lower()

    def words(self, text: str) -> list[str]:
        """Words of a text; a text within Latin-1 takes a pattern with smaller classes."""
        text = self.normal(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide.findall(text)
        return self.narrow.findall(text)

    def learn(self, words: list[str]) -> None:
        """Encode words that are not remembered yet."""
        if len(self.ids) + len(words) > REMEMBERED:
            self.ids.clear()
            self.texts.clear()
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        flat, ends = self.merged(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]))
        packed, stops, listed, start = flat.astype("<u4").tobytes(), ends.tolist(), flat.tolist(), 0
        for word, stop in zip(words, stops, strict=True):
            self.ids[word] = packed[4 * start : 4 * stop]
            self.texts[word] = b" ".join([self.tokens[i] for i in listed[start:stop]])
            start = stop

    def merged(self, data: np.ndarray, word_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words given as bytes one after another, and where each word's ids end."""
        n = len(data)
        last = np.zeros(n, bool)
        last[word_ends - 1] = True
        start = np.ones(n, bool)
        start[1:] = last[:-1] | ~self.inside[data[:-1], data[1:]]
        ids = np.where(last, self.final[data], self.first[data])
        starts = np.flatnonzero(start)
        lengths = np.diff(starts, append=n)
        counts, out = lengths.copy(), ids.copy()
        low = 1
        for high in (3, 6, 10, 16, 32, WIDEST):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            for part in range(0, len(rows), 8192):
                self._merge_rows(ids, starts, lengths, rows[part : part + 8192], high, out, counts)
        for r in np.flatnonzero(lengths > WIDEST):
            done = self._merge_long(ids[starts[r] : starts[r] + lengths[r]].tolist())
            out[starts[r] : starts[r] + len(done)] = done
            counts[r] = len(done)
        keep = np.arange(n) - np.repeat(starts, lengths) < np.repeat(counts, lengths)
        return out[keep], np.cumsum(keep)[word_ends - 1]

    def _merge_rows(self, ids, starts, lengths, rows, width, out, counts) -> None:
        """Merge one fragment per row; each step takes the best leftmost pair of every row that still has one."""
        columns = np.arange(width)
        at = starts[rows]
        size = lengths[rows]
        grid = ids[np.minimum(at[:, None] + columns, len(ids) - 1)]
        grid[columns >= size[:, None]] = -1
        rank = self.ranks.get(grid[:, :-1], grid[:, 1:])
        while len(rows):
            best = rank.argmin(1)
            every = np.arange(len(rows))
            value = rank[every, best]
            go = value != NO_RANK
            if not go.all():
                for r in np.flatnonzero(~go) if len(rows) < 4 else ():
                    out[at[r] : at[r] + size[r]] = grid[r, : size[r]]
                    counts[rows[r]] = size[r]
                if len(rows) >= 4:
                    done = np.flatnonzero(~go)
                    inside = columns < size[done][:, None]
                    out[(at[done][:, None] + columns)[inside]] = grid[done][inside]
                    counts[rows[done]] = size[done]
                rows, at, size, grid, rank, best, value = rows[go], at[go], size[go], grid[go], rank[go], best[go], value[go]
                every = np.arange(len(rows))
                if not len(rows):
                    return
            grid[every, best] = self.joined[value]
            shifted = np.minimum(columns + (columns > best[:, None]), width - 1)
            grid = np.take_along_axis(grid, shifted, 1)
            size = size - 1
            grid[every, size] = -1
            shifted = np.minimum(columns[:-1] + (columns[:-1] > best[:, None]), width - 2)
            rank = np.take_along_axis(rank, shifted, 1)
            rank[every, np.minimum(size, width - 2)] = NO_RANK
            # the pairs left and right of the new token
            rank[every, np.minimum(best, width - 2)] = self.ranks.get(grid[every, best], grid[every, np.minimum(best + 1, width - 1)])
            left = best > 0
            if left.any():
                rank[every[left], best[left] - 1] = self.ranks.get(grid[every[left], best[left] - 1], grid[every[left], best[left]])

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same by a heap over a linked list: n log n for a fragment without any forced cut."""
        n = len(parts)
        rank = lambda a, b: int(self.ranks.get(np.array([parts[a]]), np.array([parts[b]]))[0])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.ranks.get(np.array(parts[:-1]), np.array(parts[1:])).tolist()
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(first) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i], parts[j] = int(self.joined[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank(a, b)) != NO_RANK:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [x for x in parts if x >= 0]

    def split(self, batch: list[str]) -> list[list]:
        """Words of each text, all of them learned; a special token is a list of its own with its text."""
        found: list[list] = []
        for text in batch:
            words: list = []
            for k, piece in enumerate(self.special_split.split(text) if "<|" in text else (text,)):
                words += [(piece,)] if k % 2 else self.words(piece)
            found.append(words)
        new = {w for w in chain.from_iterable(found) if w not in self.ids and w.__class__ is str}
        # in slices, so that the table of words stays bounded for any batch
        if len(new) + len(self.ids) > REMEMBERED:
            self.ids.clear()
            self.texts.clear()
            new = {w for w in chain.from_iterable(found) if w.__class__ is str}
        if new:
            self.learn(sorted(new))
        for piece, at in self.special.items():
            self.ids[(piece,)], self.texts[(piece,)] = at.to_bytes(4, "little"), piece.encode()
        return found

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [b"".join(map(self.ids.__getitem__, words)) for words in self.split(batch)]

    def encode_decode_batch(self, batch: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids, and the text of the tokens with one space between them, as a file without decoder says."""
        found = self.split(batch)
        return [(b"".join(map(self.ids.__getitem__, w)), b" ".join(map(self.texts.__getitem__, w))) for w in found]


class PairTable:
    """Rank of a pair of ids, looked up for whole arrays in an open hash table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, bits: int = 19):
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NO_RANK, np.int32)
        keys = left.astype(np.int64) << 32 | right
        self.steps = 1
        waiting, slot = np.arange(len(keys)), self.slot(keys)
        while len(waiting):
            free = self.keys[slot[waiting]] < 0
            tried, at = np.unique(slot[waiting[free]], return_index=True)
            won = waiting[free][at]
            self.keys[tried], self.values[tried] = keys[won], won
            waiting = np.setdiff1d(waiting, won)
            slot[waiting] = (slot[waiting] + 1) & self.mask
            self.steps += 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = np.ascontiguousarray(left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF))
        slot = self.slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NO_RANK)
        open_ = np.flatnonzero(((found != keys) & (found >= 0)).ravel())
        flat, flat_keys, flat_slot = out.ravel(), keys.ravel(), slot.ravel()
        while len(open_):
            flat_slot[open_] = (flat_slot[open_] + 1) & self.mask
            found = self.keys[flat_slot[open_]]
            hit = found == flat_keys[open_]
            flat[open_[hit]] = self.values[flat_slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return flat.reshape(out.shape)


@lru_cache(2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode the ids again.

    One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` also ids (binary,
    little-endian unsigned 32-bit) and decoded. ``path`` is the vocabulary file, readable on every worker. A
    null text is empty and gives no ids; ids that are null or repeated stay as they are. Nothing is shuffled.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids binary, decoded string" if keep_ids else ""

    def batch_rows(batch):
        import hashlib

        import pyarrow as pa

        done = loaded(path).encode_decode_batch(batch.column(1).to_pylist())
        arrays = [
            batch.column(0).cast(pa.int64()),
            pa.array([len(ids) // 4 for ids, _ in done], pa.int64()),
            pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in done], pa.string()),
            pa.array([hashlib.sha256(text).hexdigest() for _, text in done], pa.string()),
        ]
        if keep_ids:
            arrays += [pa.array([ids for ids, _ in done], pa.binary()), pa.array([text.decode() for _, text in done], pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(arrays)]
        return pa.RecordBatch.from_arrays(arrays, names)

    return texts(docs, id_col, text_col).mapInArrow(per_row(batch_rows), schema)
