"""Removal of long byte strings that occur more than once, by blockwise suffix sorting with a difference cover.

Anchors, the least of the 32-byte hashes in the first part of a window, are the same for equal windows, so windows
that can be equal have equal text after their anchor. Starts with the same anchor form a block. A block that occurs
twice as a whole settles its starts. Where different blocks share their anchor's text, pieces of them are dealt by
the text that all their windows share, and each bucket's suffixes are sorted in memory: by their first bytes, and ties
by the ranks of a difference-cover sample, which were computed before by doubling. Neighbours in that order are
compared byte by byte.
"""

from __future__ import annotations

from functools import cmp_to_key, lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.llm.common import key_columns, keyed, per_row, scratch_tables, stored

GRAM = 32
#: Bytes after an anchor that all windows of its class share.
SHARED = 100
#: Starts per piece of a block.
PIECE = 32
#: Longest stretch of a text that is hashed at once.
STRETCH = 1 << 17
BASE = 0x9E3779B97F4A7C15 | 1
#: A perfect difference set: every number below PERIOD is a difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bytes of pieces that are sorted at once; a bucket is never divided.
AT_ONCE = 4 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for factor in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(STRETCH + 1025, factor, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


class Hashes:
    """Hashes of any substring of a stretch."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


def blocks_of(data: np.ndarray, length: int) -> np.ndarray:
    """Blocks of a text: rows of first start, number of starts, anchor, hash of the anchor's text, hash of the block."""
    out = []
    reach = length - SHARED + 1  # places of the anchor
    for begin in range(0, len(data) - length + 1, STRETCH - length + 1):
        stretch = data[begin : begin + STRETCH]
        n = len(stretch) - length + 1
        if n <= 0:
            break
        hashes = Hashes(stretch)
        at = np.arange(len(stretch) - GRAM + 1)
        least = mixed((hashes.sums[GRAM:] - hashes.sums[: len(at)]) * hashes.down[: len(at)])
        # the place breaks ties to the left
        least = (least & ~np.uint64(STRETCH * 2 - 1)) | at.astype(np.uint64)
        span = 1
        while span * 2 <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = reach - span
        least = np.minimum(least[: n], least[rest : rest + n])
        anchor = (least & np.uint64(STRETCH * 2 - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        count = np.diff(first, append=n)
        anchor = anchor[first]
        whole = mixed(hashes.of(first, first + count - 1 + length) ^ (anchor - first).astype(np.uint64))
        out.append(np.stack([first + begin, count, anchor + begin, hashes.of(anchor, anchor + SHARED).view(np.int64), whole.view(np.int64)], 1))
    return np.concatenate(out) if out else np.zeros((0, 5), np.int64)


def words_at(buffer: np.ndarray, at: np.ndarray, n_words: int) -> list[np.ndarray]:
    """Eight bytes at a time as big-endian numbers, which order as the bytes do."""
    view = np.lib.stride_tricks.sliding_window_view(buffer, 8)
    return [np.ascontiguousarray(view[at + 8 * k]).view(">u8").ravel().astype(np.uint64) for k in range(n_words)]


def dense(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks from 1 of rows ordered by the keys, the first key first; equal rows have equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) + 1
    return rank


def first_bytes(buffer: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The first PERIOD bytes as four keys."""
    keys = words_at(buffer, at, 4)
    keys[3] = keys[3] & ~np.uint64(0xFF)
    return keys


@lru_cache(1)
def cover_steps() -> tuple[np.ndarray, np.ndarray]:
    """Distance from each residue to the next member, and for each pair the step that makes both members."""
    member = np.zeros(PERIOD, bool)
    member[list(COVER)] = True
    nearest = np.array([next(d for d in range(PERIOD) if member[(r + d) % PERIOD]) for r in range(PERIOD)])
    pair = np.array([[next(d for d in range(PERIOD) if member[(a + d) % PERIOD] and member[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])
    return nearest, pair


def repeated_starts(pieces: list[bytes], starts: list[int], length: int) -> list[np.ndarray]:
    """For each piece, which of its first ``starts`` suffixes share their first ``length`` bytes with another suffix.

    Pieces are laid out at multiples of the period, ends padded with zeros; only the ranks of the sample are kept for
    all of them, and each tie is settled by one rank per suffix.
    """
    nearest, pair_step = cover_steps()
    sizes = np.array([len(p) for p in pieces])
    room = -(-(sizes + 8 + PERIOD) // PERIOD) * PERIOD
    base = np.cumsum(room) - room
    buffer = np.zeros(int(room.sum()) + 64, np.uint8)
    for b, p in zip(base.tolist(), pieces, strict=True):
        buffer[b : b + len(p)] = np.frombuffer(p, np.uint8)
    # ranks of the sample, by doubling up to the length
    place = np.arange(int(room.sum()))
    sample = place[np.isin(place % PERIOD, COVER)]
    end = np.repeat(base + sizes, room)[sample]
    rank = np.zeros(len(buffer) + length + 2 * PERIOD, np.int64)
    rank[sample] = dense(first_bytes(buffer, sample))
    depth = PERIOD
    while depth < length:
        further = np.where(sample + depth < end, rank[sample + depth], 0)
        rank[sample] = dense([rank[sample], further])
        depth *= 2
    # the suffixes
    counts = np.asarray(starts)
    owner = np.repeat(np.arange(len(pieces)), counts)
    at = base[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    head = dense(first_bytes(buffer, at))
    tie = rank[at + nearest[at % PERIOD]]
    order = np.lexsort([tie, head])
    order = settle_mixed(order, head, at, rank, pair_step)
    left, right = order[:-1], order[1:]
    same = np.flatnonzero(head[left] == head[right])
    windows = np.lib.stride_tricks.sliding_window_view(buffer, length) if len(buffer) >= length else None
    found = np.zeros(len(at), bool)
    for k in range(0, len(same), 8192):
        part = same[k : k + 8192]
        equal = (windows[at[left[part]]] == windows[at[right[part]]]).all(1)
        found[left[part[equal]]] = True
        found[right[part[equal]]] = True
    return np.split(found, np.cumsum(counts)[:-1])


def settle_mixed(order, head, at, rank, pair_step):
    """Ties between suffixes of different residues need the step that leads both into the sample."""
    group = head[order]
    residue = at[order] % PERIOD
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    low = np.minimum.reduceat(residue, edges[:-1]) if len(residue) else residue
    high = np.maximum.reduceat(residue, edges[:-1]) if len(residue) else residue

    def compare(x, y):
        step = pair_step[at[x] % PERIOD, at[y] % PERIOD]
        return int(rank[at[x] + step]) - int(rank[at[y] + step])

    for g in np.flatnonzero(low != high):
        a, b = edges[g], edges[g + 1]
        order[a:b] = sorted(order[a:b].tolist(), key=cmp_to_key(compare))
    return order


def intervals_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    first = np.flatnonzero(edges == 1)
    return first, np.flatnonzero(edges == -1) - first


def repeated_intervals(docs: DataFrame, length: int = 400) -> DataFrame:
    """key_id, key_hash, start, n: runs of starts in a text whose ``length`` bytes also start anywhere else.

    ``docs`` has key_id, key_hash and text. Blocks, the table of their counts, the blocks to look into and both kinds of runs
    are written to the checkpoint folder. Equal blocks are known by 128 bits of hashes, windows inside buckets by their bytes.
    """
    if length < SHARED + GRAM:
        raise ValueError(f"length must be {SHARED + GRAM} or more")

    def cut(batch):
        import pyarrow as pa

        ids, marks, rows = [], [], []
        for key_id, key_hash, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = blocks_of(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), length)
            ids.append(np.full(len(found), key_id))
            marks.append(np.full(len(found), key_hash))
            rows.append(found)
        rows = np.concatenate(rows) if rows else np.zeros((0, 5), np.int64)
        columns = [np.concatenate(ids), np.concatenate(marks), rows[:, 3], rows[:, 4], rows[:, 0], rows[:, 1], rows[:, 2] - rows[:, 0]]
        types = [pa.int64()] * 5 + [pa.int32()] * 2
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)).cast(t) for c, t in zip(columns, types, strict=True)], ["key_id", "key_hash", "anchor_text", "whole", "start", "n", "offset"])

    blocks = stored(docs.mapInArrow(per_row(cut), "key_id long, key_hash long, anchor_text long, whole long, start long, n int, offset int"), "blocks")
    first = F.struct("key_id", "key_hash", "start", "n", "offset")
    kinds = stored(blocks.groupBy("anchor_text", "whole").agg(F.count("*").alias("times"), F.min(first).alias("at")), "kinds")
    classes = kinds.groupBy("anchor_text").agg(F.count("*").alias("different"), F.min("times").alias("fewest")).where("different > 1 and fewest = 1").select("anchor_text")
    # blocks to look into: all different ones of a class in which some occur once
    open_ = kinds.join(stored(classes, "classes").hint("merge"), "anchor_text").select("at.key_id", "at.key_hash", F.struct("anchor_text", F.col("at.start").alias("start"), F.col("at.n").alias("n"), F.col("at.offset").alias("offset"), (F.col("times") == 1).alias("once")).alias("block"))
    open_ = stored(open_.groupBy("key_id", "key_hash").agg(F.collect_list("block").alias("blocks")), "open")

    def bodies(batch):
        import pyarrow as pa

        out = []
        for key_id, key_hash, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for b in wanted:
                stop, far = b["start"] + b["n"], b["start"] + b["offset"]
                at = b["start"]
                while at < stop:
                    # pieces end where the distance to the anchor divides by PIECE, so equal windows fall into equal pieces
                    size = min(stop - at, (far - at) % PIECE + 1)
                    grid = (far - at) // PIECE
                    last_of_grid, first_of_grid = far - grid * PIECE, far - grid * PIECE - PIECE + 1
                    core = data[last_of_grid : first_of_grid + length]
                    out.append((key_id, key_hash, at, size, b["once"], b["anchor_text"] ^ grid, core, data[at : at + size - 1 + length]))
                    at += size
        columns = list(zip(*out, strict=True)) or [()] * 8
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
        hashed = [hash_bytes(c) for c in columns[6]]
        columns[6] = hashed
        types[6] = pa.int64()
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["key_id", "key_hash", "start", "n", "once", "grid", "core", "body"])

    key = ["key_id", "key_hash"]
    pieces = docs.join(open_.hint("merge"), key).select(*key, "text", "blocks").mapInArrow(per_row(bodies), "key_id long, key_hash long, start long, n int, once boolean, grid long, core long, body binary")
    pieces = pieces.withColumn("bucket", F.xxhash64("grid", "core")).drop("grid", "core")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(parts, "bucket").sortWithinPartitions("bucket", *key, "start")
    sorted_out = dealt.select("bucket", *key, "start", "n", "once", "body").mapInArrow(sorter(length), "key_id long, key_hash long, start long, n int")
    twice = kinds.where("times > 1").select("anchor_text", "whole")
    settled = blocks.join(twice.hint("merge"), ["anchor_text", "whole"], "left_semi").select(*key, "start", "n")
    # one after the other, so that the shuffles of only one of them are on disk
    return stored(settled, "settled").union(stored(sorted_out, "sorted"))


def hash_bytes(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def sorter(length: int):
    def run(batches):
        import pyarrow as pa

        names, types = ["key_id", "key_hash", "start", "n"], [pa.int64(), pa.int64(), pa.int64(), pa.int32()]

        def finish(rows):
            # a row that repeats another row's id and text is the same place
            rows = list({r[1:4]: r for r in rows}.values())
            out = []
            for row, flags in zip(rows, repeated_starts([r[6] for r in rows], [r[4] for r in rows], length), strict=True):
                if row[5]:
                    out += [(row[1], row[2], row[3] + a, n) for a, n in zip(*(x.tolist() for x in intervals_of(flags)), strict=True)]
            columns = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

        held, bucket, group, size = [], None, [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != bucket:
                    if len(group) > 1:  # alone in its bucket: nothing can be equal
                        held += group
                        size += sum(len(r[6]) for r in group)
                        if size >= AT_ONCE:
                            yield finish(held)
                            held, size = [], 0
                    bucket, group = row[0], []
                group.append(row)
        if len(group) > 1:
            held += group
        if held:
            yield finish(held)

    return run


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_bytes`` kept.

    A byte goes when a string of ``length`` bytes that covers it also starts at another place of any text, the
    same one included; strings never reach over the end of a text and are judged on the input. A null text is
    empty. Rows with the same id and text count as separate places: each is the other's repeat. Null ids work as any.
    """
    source = keyed(docs, id_col, text_col)
    with scratch_tables(docs.sparkSession):
        found = repeated_intervals(source, length).groupBy("key_id", "key_hash").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
        found = stored(found, "runs", keep=True)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_bytes else "")

    def rewritten(batch):
        import hashlib

        import pyarrow as pa

        rows = []
        for key_id, text, runs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            kept, removed, spans, at = [], 0, 0, 0
            stop = -1
            for r in sorted(runs or (), key=lambda r: r["start"]):
                a, b = r["start"], r["start"] + r["n"] - 1 + length
                if a > stop:
                    kept.append(data[at:a])
                    spans += 1
                    removed += b - a
                    at = stop = b
                elif b > stop:
                    removed += b - stop
                    at = stop = b
            kept.append(data[at:])
            whole = b"".join(kept)
            rows.append((key_id if key_id != -(2**63) else None, len(data), removed, spans, hashlib.sha256(whole).hexdigest(), *([whole] if keep_bytes else [])))
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()][: 2 if keep_bytes else 1]
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in schema.split(", ")])

    both = source.join(found.hint("merge"), ["key_id", "key_hash"], "left")
    return both.select("key_id", "text", "runs").mapInArrow(per_row(rewritten), schema)
