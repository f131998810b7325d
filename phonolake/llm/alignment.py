"""Alignment of the tokens of two vocabularies by the byte offsets where both end a token.

Along a stretch of one-to-one groups the two lists of end offsets agree at a fixed shift between the indexes, a
diagonal. Exponential probing compares ever longer slices on the current diagonal and halves back to the first
difference; there a group of several tokens is resolved step by step, which gives the next shift.

Tokens that end together at one offset cover each other's last bytes, so the bytes of one are a suffix of the
bytes of the other. All pairs that can ever be linked are therefore known from the vocabularies alone: at most one
for each byte of all entries. Corpus-wide counts are a vector of that length, whatever the size of the corpus.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.llm.common import small_batches, stored, texts

BATCH_BYTES = 2 << 20
FIRST_PROBE = 4 * 8
#: A single space between two characters that are neither white space nor its sign.
CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
#: Other spaces.
ODD_SPACE = re.compile(r" (?:[\s▁]|(?<=[\s▁] ))")
LEARNED_AT_ONCE = 1 << 16
#: Words that a task remembers, and from how many characters on a word is not worth it.
REMEMBERED = 250_000
LONG_WORD = 64


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """A byte-level BPE file; special tokens in a text are plain text.

    Where merge ``k`` makes entry ``256 + k``, ids are ranks and the faster library reads them; a text that it
    refuses, and any other file, goes to the library that owns the format.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        letters = byte_letters()
        special = {t["id"]: t["content"] for t in stated.get("added_tokens", [])}
        vocab = stated["model"]["vocab"]
        self.bytes = [b""] * (1 + max([*vocab.values(), *special]))
        for entry, at in vocab.items():
            self.bytes[at] = special[at].encode() if at in special else bytes(letters[c] for c in entry)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        merges = [m.split(" ") if isinstance(m, str) else m for m in stated["model"]["merges"]]
        ranked = all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
        plain = stated.get("normalizer") is None and stated["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.fast = self.ranks(256 + len(merges)) if ranked and plain else None

    def ranks(self, n_ranks: int):
        import public_tokenizers
        import tiktoken

        ranks = {b: i for i, b in enumerate(self.bytes) if b and i < n_ranks}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode_ordinary(text)
            except (ValueError, OverflowError, RuntimeError):
                pass
        return self.library.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece file with byte fallback; it puts the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self.piece_bytes(i) for i in range(self.model.get_piece_size())]

    def piece_bytes(self, at: int) -> bytes:
        piece = self.model.id_to_piece(at)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(at) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


def odd_ends(text: str) -> bool:
    """Whether a space put before or after the text might be joined to it."""
    return not text or text[0].isspace() or text[-1].isspace() or text[0] == "▁" or text[-1] == "▁"


def diagonal_runs(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """``(i, j, n)``: groups end at tokens ``i, j``, ``i + 1, j + 1`` and so on, ``n`` times; both lists end alike.

    Places are counted in bytes of the two arrays, so a probe compares memory.
    """
    runs, i, j, n = [], 0, 0, 8 * len(a)
    raw_a, raw_b = (np.append(v, end).astype(np.int64).tobytes() for v, end in ((a, -1), (b, -2)))  # ends that no probe can pass
    ends_a, ends_b = memoryview(raw_a).cast("q"), memoryview(raw_b).cast("q")
    while i < n:
        start, step = i, FIRST_PROBE
        while raw_a[i : i + step] == raw_b[j : j + step]:
            i += step
            j += step
            step += step
        while step > 8:
            step >>= 1
            if raw_a[i : i + step] == raw_b[j : j + step]:
                i += step
                j += step
        if i > start:
            runs.append((start >> 3, j - i + start >> 3, i - start >> 3))
        if i < n:
            p, q = i >> 3, j >> 3
            x, y = ends_a[p], ends_b[q]
            while x != y:
                if x < y:
                    p += 1
                    x = ends_a[p]
                else:
                    q += 1
                    y = ends_b[q]
            runs.append((p, q, 1))
            i, j = p + 1 << 3, q + 1 << 3
    return runs


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.size_a = np.array([len(x) for x in self.a.bytes], np.int64)
        self.size_b = np.array([len(x) for x in self.b.bytes], np.int64)
        self.keys = self.possible_pairs()
        self.b_of_pair = self.keys & 0xFFFFFFFF
        most = max(len(self.a.bytes), len(self.b.bytes))
        width = len(str(most - 1))
        names = np.array([str(i) for i in range(most)], f"S{width + 1}")
        self.digits = names.view(np.uint8).reshape(most, width + 1)
        self.n_digits = (self.digits > 0).sum(axis=1)
        # a piece that holds a space behind something else would join two words
        self.cuttable = self.a.fast is not None and not any(b" " in x.lstrip(b" ") for x in self.b.bytes)
        self.words_a: dict[str, bytes | None] = {}
        self.words_b: dict[str, bytes | None] = {}

    def possible_pairs(self) -> np.ndarray:
        """Sorted ``a << 32 | b`` of all entries where the bytes of one end with those of the other."""
        by_bytes: tuple[dict, dict] = ({}, {})
        for found, entries in zip(by_bytes, (self.a.bytes, self.b.bytes), strict=True):
            for at, raw in enumerate(entries):
                found.setdefault(raw, []).append(at)
        keys = set()
        for at, raw in enumerate(self.a.bytes):
            keys.update(at << 32 | other for k in range(len(raw)) for other in by_bytes[1].get(raw[k:], ()))
        for at, raw in enumerate(self.b.bytes):
            keys.update(other << 32 | at for k in range(len(raw)) for other in by_bytes[0].get(raw[k:], ()))
        return np.array(sorted(keys), np.int64)

    def learn(self, words: set[str]) -> None:
        """Ids of new words of both vocabularies; none where one of them does not give back the bytes.

        Words are read many at a time, with single spaces between them, and cut again at their last bytes.
        """
        size, line, lines, single = 0, [], [], []
        for word in words:
            if not self.cuttable or odd_ends(word):
                single.append([word])
                continue
            line.append(word)
            size += len(word)
            if size > LEARNED_AT_ONCE:
                lines.append(line)
                size, line = 0, []
        waiting = [*lines, line, *single] if line else [*lines, *single]
        while waiting:
            line = waiting.pop()
            whole = " ".join(line)
            raw = b" " + whole.encode()
            ids = self.a.encode(" " + whole), self.b.encode(whole)
            same = all(b"".join(map(side.bytes.__getitem__, own)) == raw for side, own in zip((self.a, self.b), ids, strict=True))
            if not same and len(line) > 1:
                waiting += [line[: len(line) // 2], line[len(line) // 2 :]]
                continue
            ends = np.cumsum([1 + len(w.encode()) for w in line])
            for side, known, own in ((self.size_a, self.words_a, ids[0]), (self.size_b, self.words_b, ids[1])):
                own = np.array(own, np.int32)
                cuts = (4 * np.searchsorted(np.cumsum(side[own]), ends) + 4).tolist() if same else []
                packed, start = own.tobytes(), 0
                for word, stop in zip(line, cuts or [None], strict=True):
                    known[word] = packed[start:stop] if same else None
                    start = stop

    def split(self, text: str) -> list[str]:
        if not self.cuttable:
            return [text]
        return CUT.split(text) if odd_ends(text) or ODD_SPACE.search(text) else text.split(" ")

    def tokens(self, batch: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of each text as 32-bit integers; none for an empty text or one that a vocabulary does not give back.

        Neither vocabulary joins a space to what stands before it, so texts are cut there and words are remembered.
        """
        found = [self.split(t) for t in batch]
        new = {w for words in found for w in words if w not in self.words_a}
        if len(new) + len(self.words_a) > REMEMBERED:
            self.words_a.clear()
            self.words_b.clear()
            new = {w for words in found for w in words}
        self.learn(new)
        out: tuple[list, list] = ([], [])
        for text, words in zip(batch, found, strict=True):
            parts = [self.words_a[w] for w in words] if text else []
            known = bool(parts) and None not in parts
            out[0].append(b"".join(parts) if known else b"")
            out[1].append(b"".join([self.words_b[w] for w in words]) if known else b"")
        for w in new:
            if len(w) > LONG_WORD:
                del self.words_a[w], self.words_b[w]
        return out

    def align(self, batch: list[str]) -> dict:
        """Counts, the text of the groups and the pair number of each link, for texts side by side."""
        raw = self.tokens(batch)
        n_a, n_b = (np.array([len(r) // 4 for r in side], np.int64) for side in raw)
        ids_a, ids_b = (np.frombuffer(b"".join(side), np.int32).astype(np.int64) for side in raw)
        # texts end alike in both lists, so one pass reads them all
        run = np.array(diagonal_runs(np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])), np.int64).reshape(-1, 3)
        step = np.arange(run[:, 2].sum()) - np.repeat(np.cumsum(run[:, 2]) - run[:, 2], run[:, 2])
        last_a, last_b = np.repeat(run[:, 0], run[:, 2]) + step, np.repeat(run[:, 1], run[:, 2]) + step
        n_groups = np.diff(np.searchsorted(last_a, np.cumsum(n_a)), prepend=0)
        links = np.searchsorted(self.keys, ids_a[last_a] << 32 | ids_b[last_b])
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "links": links, "groups": self.written(ids_a, ids_b, last_a, last_b, n_a + n_b)}

    def written(self, ids_a, ids_b, last_a, last_b, n_tokens) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text, all texts in one array."""
        total = len(ids_a) + len(ids_b)
        ids, sep = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        group_a, group_b = np.repeat(np.arange(len(last_a)), size_a), np.repeat(np.arange(len(last_b)), size_b)
        place_a = np.arange(len(ids_a)) + (np.cumsum(size_b) - size_b)[group_a]
        place_b = np.arange(len(ids_b)) + np.cumsum(size_a)[group_b]
        ids[place_a], ids[place_b] = ids_a, ids_b
        sep[place_a[last_a]], sep[place_b[last_b]] = ord("|"), ord(";")
        lengths = self.n_digits[ids]
        rows = self.digits[ids]
        rows[np.arange(total), lengths] = sep
        flat = rows[np.arange(rows.shape[1]) <= lengths[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths + 1)])[np.cumsum(n_tokens)]
        starts = np.concatenate([[0], ends[:-1]])
        return [flat[s : max(s, e - 1)] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


@lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times, with ``keep_groups`` also groups.

    ``path_a`` is a byte-level BPE file that reads a space and the text, ``path_b`` a sentencepiece file that puts
    the space itself. ``pairs`` are the numbers of the linked id pairs (see ``pair_counts``), ascending, ``times``
    how often each occurs in the text. Null and empty texts, and texts that a vocabulary does not give back byte by
    byte, have zeros, no pairs and an empty ``groups_sha256``. Null and repeated ids stay. Nothing is shuffled.
    """
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"
    schema += ", groups string" if keep_groups else ""

    def run(batches):
        import hashlib

        tool = aligner(path_a, path_b)
        for batch in small_batches(batches, "text", BATCH_BYTES):
            done = tool.align(batch.column(1).to_pylist())
            links, n_groups = done["links"], done["n_groups"]
            doc = np.repeat(np.arange(batch.num_rows), n_groups)
            seen, times = np.unique(doc * len(tool.keys) + links, return_counts=True)
            at = np.searchsorted(seen, np.arange(batch.num_rows + 1) * len(tool.keys)).astype(np.int32)
            counts = [pa.array(done[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_groups")]
            hashes = [hashlib.sha256(g).hexdigest() if g else "" for g in done["groups"]]
            lists = [pa.ListArray.from_arrays(at, pa.array(v.astype(np.int32))) for v in (seen % len(tool.keys), times)]
            groups = [pa.array([g.decode() for g in done["groups"]], pa.string())] if keep_groups else []
            arrays = [batch.column(0).cast(pa.int64()), *counts, pa.array(hashes, pa.string()), *lists, *groups]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])

    return texts(docs, id_col, text_col).mapInArrow(run, schema)


def pair_counts(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``pair``, ``times``: how many links of all rows of ``aligned`` hold a pair. A task adds up before the shuffle."""

    def added(batches):
        total = np.zeros(len(aligner(path_a, path_b).keys), np.int64)
        for batch in batches:
            pairs, times = (batch.column(k).flatten().to_numpy() for k in (0, 1))
            total += np.bincount(pairs, times, len(total)).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["pair", "times"])

    return rows.select("pairs", "times").mapInArrow(added, "pair int, times long").groupBy("pair").agg(F.sum("times").alias("times"))


def pair_names(counts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``a``, ``b``, ``times`` of ``pair_counts``: the ids behind the pair numbers."""

    def named(batches):
        keys = aligner(path_a, path_b).keys
        for batch in batches:
            key = keys[batch.column(0).to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), batch.column(1)], ["a", "b", "times"])

    return counts.mapInArrow(named, "a long, b long, times long")


def cross_align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row; cases as in ``aligned``.

    ``n_best`` counts the links whose pair is, over all rows, the most frequent one of its ``b`` id (ties included),
    ``count_sum`` adds the corpus-wide counts of all links. The counts are collected: they have at most as many
    rows as the vocabularies have bytes (see the module), and every task gets them as one vector.
    """
    rows = stored(aligned(docs, path_a, path_b, id_col, text_col), "aligned")
    table = pair_counts(rows, path_a, path_b).toArrow()
    seen, counted = table.column("pair").to_numpy(), table.column("times").to_numpy()

    def scored(batches):
        tool = aligner(path_a, path_b)
        count, most = np.zeros(len(tool.keys), np.int64), np.zeros(len(tool.b.bytes), np.int64)
        count[seen] = counted
        np.maximum.at(most, tool.b_of_pair, count)
        best = count == most[tool.b_of_pair]
        for batch in batches:
            pairs, times = (batch.column(batch.schema.get_field_index(c)) for c in ("pairs", "times"))
            n, at = times.flatten().to_numpy().astype(np.int64), pairs.flatten().to_numpy()
            ends = np.cumsum(pairs.value_lengths().to_numpy())
            sums = [np.concatenate([[0], np.cumsum(v)]) for v in (n * best[at], n * count[at])]
            added = [pa.array(np.diff(s[ends], prepend=0), pa.int64()) for s in sums]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(5)), *added, batch.column(5)], names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names)
    return rows.mapInArrow(scored, schema)
