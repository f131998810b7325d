"""Removal of repeated passages of several lines, by content-defined chunks of lines.

A rolling hash over line hashes decides where a chunk ends, so a passage is cut alike wherever it stands. Chunk hashes
are counted over the corpus, those that repeat are grouped by their bytes, and every chunk of two or more lines that
occurred before is removed. A repeated passage also has lines at its two ends that share a chunk with their
surroundings; they are found by a hash of every two successive lines, taken only of what the chunks left. A passage of
two or more lines repeats exactly where all its pairs of successive lines do, so both steps together remove repeated
passages of any length. Lines go only where their bytes equal those of an earlier place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from phonolake.llm.common import key_columns, keyed, per_row, scratch_tables, stored

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
#: Lines that decide a boundary, one boundary in so many lines, fewest lines of a chunk; blank lines do not count.
WINDOW, DIVISOR, LEAST = 2, 3, 2


def line_chunks(line_hashes: list[int], window: int = WINDOW, divisor: int = DIVISOR, least: int = LEAST) -> list[tuple[int, int]]:
    """Chunks of lines, given by their hashes, as (first line, line after the last).

    A chunk ends after a line when it has ``least`` lines and the rolling hash over the last ``window`` line
    hashes divides by ``divisor``. The last chunk takes what remains.
    """
    oldest = pow(BASE, window, 1 << 64)
    chunks, start, rolling = [], 0, 0
    for i, h in enumerate(line_hashes):
        rolling = (rolling * BASE + h - (line_hashes[i - window] * oldest if i >= window else 0)) & MASK
        if i + 1 - start >= least and (rolling >> 32) % divisor == 0:
            chunks.append((start, i + 1))
            start = i + 1
    if start < len(line_hashes):
        chunks.append((start, len(line_hashes)))
    return chunks


def line_pairs(text: str) -> tuple[list[str], list[int]]:
    """The lines of a text and the places of those that are not blank; pair p is what lies from the p-th of these to the next."""
    lines = text.split("\n")
    return lines, [i for i, line in enumerate(lines) if line and not line.isspace()]


def pair_body(lines: list[str], solid: list[int], pair: int) -> str:
    """Two successive lines that are not blank, with the blank ones between them."""
    return "\n".join(lines[solid[pair] : solid[pair + 1] + 1])


def line_hashes(lines: list[str], places: list[int]) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(lines[i].encode("utf-8", "surrogatepass")) for i in places]


def chunk_pairs(text: str) -> list[tuple[int, int]]:
    """The chunks of a text that have two lines or more, as (first pair, pair after the last); blank lines do not count."""
    lines, solid = line_pairs(text)
    return [(a, b - 1) for a, b in line_chunks(line_hashes(lines, solid)) if b - a > 1]


def chunk_body(lines: list[str], solid: list[int], chunk: tuple[int, int]) -> bytes:
    return "\n".join(lines[solid[chunk[0]] : solid[chunk[1]] + 1]).encode("utf-8", "surrogatepass")


def pair_seeds(text: str, gone: list[int] = ()):
    """Places of the pairs of a text outside the chunks ``gone`` and a rolling hash of each; equal pairs have equal seeds."""
    import numpy as np

    lines, solid = line_pairs(text)
    if len(solid) < 2:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    second = line_hashes(lines, solid)
    # blank lines inside a pair belong to its first half
    spaced = [p for p, (a, b) in enumerate(zip(solid, solid[1:], strict=False)) if b > a + 1]
    first = np.array(second[:-1], np.uint64)
    first[spaced] = np.array(line_hashes(["\n".join(lines[solid[p] : solid[p + 1]]) for p in spaced], range(len(spaced))), np.uint64)
    seeds = (first * np.uint64(BASE) + np.array(second[1:], np.uint64)).view(np.int64)
    left = np.ones(len(seeds), bool)
    if gone:
        chunks = [(a, b - 1) for a, b in line_chunks(second) if b - a > 1]
        for place in gone:
            left[slice(*chunks[place])] = False
    return np.flatnonzero(left).astype(np.int32), seeds[left]


def without_pairs(text: str, gone: set[int]) -> tuple[str, int, int]:
    """The text without the lines of the pairs ``gone``, how many lines went, and in how many passages."""
    lines, solid = line_pairs(text)
    kept: list[str] = []
    at = passages = 0
    for pair in sorted(gone):
        first, last = solid[pair], solid[pair + 1]
        if first >= at:
            passages += 1
            kept += lines[at:first]
        at = last + 1
    kept += lines[at:]
    return "\n".join(kept), len(lines) - len(kept), passages


def repeated_chunks(source: DataFrame) -> DataFrame:
    """key_id, key_hash and ``chunks``, the places of the chunks of a text that occurred before with the same bytes."""

    def hashed(batch):
        import pyarrow as pa
        import xxhash

        ids, marks, places, digests = [], [], [], []
        for key_id, key_hash, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if "\n" not in text:
                continue
            lines, solid = line_pairs(text)
            for place, chunk in enumerate(chunk_pairs(text)):
                ids.append(key_id)
                marks.append(key_hash)
                places.append(place)
                digests.append(xxhash.xxh3_64_intdigest(chunk_body(lines, solid, chunk)) - (1 << 63))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(places, pa.int32()), pa.array(digests, pa.int64())], ["key_id", "key_hash", "place", "digest"])

    def bytes_of(batch):
        import pyarrow as pa

        ids, marks, places, bodies = [], [], [], []
        for key_id, key_hash, text, wanted in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            lines, solid = line_pairs(text)
            cut = chunk_pairs(text)
            for place in wanted:
                ids.append(key_id)
                marks.append(key_hash)
                places.append(place)
                bodies.append(chunk_body(lines, solid, cut[place]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(places, pa.int32()), pa.array(bodies, pa.binary())], ["key_id", "key_hash", "place", "body"])

    key = ["key_id", "key_hash"]
    with scratch_tables(source.sparkSession):
        chunks = stored(source.mapInArrow(per_row(hashed), "key_id long, key_hash long, place int, digest long"), "chunks")
        repeated = stored(chunks.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "repeated")
        # both sides are read from tables, so Spark can split a digest that a large share of the chunks has
        suspects = stored(chunks.join(repeated, "digest", "left_semi").groupBy(*key).agg(F.collect_set("place").alias("places")), "suspects")
        with_bytes = source.join(suspects.hint("merge"), key).select(*key, "text", "places").mapInArrow(per_row(bytes_of), "key_id long, key_hash long, place int, body binary")
        firsts = with_bytes.groupBy("body").agg(F.min(F.struct(*key, "place")).alias("first")).groupBy("first.key_id", "first.key_hash").agg(F.collect_set("first.place").alias("firsts"))
        later = F.array_except("places", F.coalesce("firsts", F.array().cast("array<int>"))).alias("chunks")
        return stored(suspects.join(firsts, key, "left").select(*key, later).where(F.size("chunks") > 0), "later", keep=True)


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every passage of two or more lines that occurred before taken out of the text.

    Blank lines do not count as lines of a passage, but those inside it must be the same. What occurs before is what
    has a smaller id, then a smaller place in the text; a null id comes first. Passages are equal when their bytes
    are, and the first occurrence of a line always stays. Where a line is repeated without a break, the first two stay
    and a third alone is no passage. Rows with the same id and text are one document here. All columns stay, with
    ``n_lines``, ``n_lines_removed`` and ``n_chunks_removed`` (passages) added; a null text stays null.

    Repeated chunks go first (:func:`repeated_chunks`), then repeated pairs of lines among the rest. All that a removed
    chunk holds also stands at its first occurrence, so the second step needs nothing of it. Runs jobs: chunks, seeds,
    those that repeat and what to remove are written to the checkpoint folder.
    """

    def seeded(batch):
        import numpy as np
        import pyarrow as pa

        found = [pair_seeds(text, gone or ()) for text, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        seeds = [s for _, s in found]
        sizes = [len(s) for s in seeds]
        places = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int32)
        keys = [np.repeat(batch.column(i).to_numpy(zero_copy_only=False), sizes) for i in range(2)]
        joined = np.concatenate(seeds) if seeds else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64()), pa.array(places, pa.int32()), pa.array(joined, pa.int64())], ["key_id", "key_hash", "place", "seed"])

    with scratch_tables(docs.sparkSession):
        source = keyed(docs, id_col, text_col)
        later = repeated_chunks(source)
        pairs = stored(source.join(later.hint("merge"), ["key_id", "key_hash"], "left").mapInArrow(per_row(seeded), "key_id long, key_hash long, place int, seed long"), "pairs")
        repeated = stored(pairs.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"), "repeated")
        # both sides are read from tables, so Spark can split a seed that a large share of the pairs has
        suspects = pairs.join(repeated, "seed", "left_semi").groupBy("key_id", "key_hash").agg(F.collect_set("place").alias("places"))
        suspects = stored(suspects, "suspects")

        def bytes_of(batch):
            import pyarrow as pa

            ids, marks, places, again, bodies = [], [], [], [], []
            for key_id, key_hash, text, wanted in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                lines, solid = line_pairs(text)
                for place in wanted:
                    body = pair_body(lines, solid, place)
                    ids.append(key_id)
                    marks.append(key_hash)
                    places.append(place)
                    again.append(place + 2 < len(solid) and pair_body(lines, solid, place + 1) == body)
                    bodies.append(body.encode("utf-8", "surrogatepass"))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(places, pa.int32()), pa.array(again, pa.bool_()), pa.array(bodies, pa.binary())], ["key_id", "key_hash", "place", "again", "body"])

        key = ["key_id", "key_hash"]
        with_bytes = source.join(suspects.hint("merge"), key).select(*key, "text", "places").mapInArrow(per_row(bytes_of), "key_id long, key_hash long, place int, again boolean, body binary")
        firsts = with_bytes.groupBy("body").agg(F.min(F.struct("key_id", "key_hash", "place", "again")).alias("first"))
        # a pair that shares a line with its own first occurrence is no second one
        stay = F.when(F.col("first.again"), F.array(F.col("first.place"), F.col("first.place") + 1)).otherwise(F.array("first.place"))
        firsts = firsts.groupBy("first.key_id", "first.key_hash").agg(F.flatten(F.collect_list(stay)).alias("firsts"))
        removals = suspects.join(firsts, key, "left").select(*key, F.array_except("places", F.coalesce("firsts", F.array().cast("array<int>"))).alias("gone")).where(F.size("gone") > 0)
        removals = stored(removals.join(later, key, "full"), "removals", keep=True)
        removals = removals.select(F.col("key_id").alias("_gone_id"), F.col("key_hash").alias("_gone_hash"), F.struct("chunks", F.col("gone").alias("pairs")).alias("_gone"))

    key_id, key_hash = key_columns(id_col, text_col)
    joined = docs.withColumns({"_key_id": key_id, "_key_hash": key_hash}).join(removals.hint("merge"), (F.col("_key_id") == F.col("_gone_id")) & (F.col("_key_hash") == F.col("_gone_hash")), "left")
    joined = joined.select(*docs.columns, "_gone")
    text_at, n_columns = docs.columns.index(text_col), len(docs.columns)
    schema = StructType(list(docs.schema.fields)).add("n_lines", "long").add("n_lines_removed", "long").add("n_chunks_removed", "long")
    schema_names = schema.names

    def rewritten(batch):
        import pyarrow as pa

        new, n_lines, gone_lines, passages = [], [], [], []
        for text, gone in zip(batch.column(text_at).to_pylist(), batch.column(n_columns).to_pylist(), strict=True):
            n_lines.append(0 if text is None else text.count("\n") + 1)
            if gone:
                cut = chunk_pairs(text) if gone["chunks"] else []
                pairs_gone = {p for place in gone["chunks"] or () for p in range(*cut[place])}.union(gone["pairs"] or ())
            text, dropped, parts = without_pairs(text, pairs_gone) if gone else (text, 0, 0)
            new.append(text)
            gone_lines.append(dropped)
            passages.append(parts)
        arrays = [batch.column(i) for i in range(n_columns)]
        arrays[text_at] = pa.array(new, pa.string())
        arrays += [pa.array(x, pa.int64()) for x in (n_lines, gone_lines, passages)]
        return pa.RecordBatch.from_arrays(arrays, schema_names)

    return joined.mapInArrow(per_row(rewritten, text_col), schema)
