"""Near-duplicate classes by weighted minwise signatures from hashed darts.

The weight axis of every shingle is cut into regions whose ends are powers of two. Darts hit a region at the times
of a Poisson process drawn from hashes of shingle and region; a dart counts for a document when its place lies
below the shingle's weight there, and each coordinate of the signature keeps its earliest dart. Two documents
agree in a coordinate with the probability of their weighted Jaccard similarity. Darts are thrown only up to a time
that fills all coordinates, so a long document costs little more than one look at each shingle.

Bands of coordinates give buckets. Members of a bucket are compared with a hub; what hubs leave apart is joined exactly
by prefix filtering. Comparing means the weighted Jaccard similarity of the whole texts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phonolake.llm.common import free_name, key_columns, keyed, per_row, scratch_tables, stored
from phonolake.llm.components import components

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 5
REMEMBERED = 500_000
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: 64-bit words of a text's bit map in the prefix join.
MAP_WORDS = 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers above 0, up to 1."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


@lru_cache(1)
def word_hashes() -> WordHashes:
    return WordHashes()


def shingles(batch: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index, hash and count of each distinct shingle of lower-cased, space-separated words.

    A text with fewer words than a shingle has one shingle of all its words; one without words has none.
    """
    known = word_hashes()
    split = [text.lower().split() for text in batch]
    sizes = np.array([len(w) for w in split], np.int64)
    flat = np.fromiter((known[w] for ws in split for w in ws), np.uint64, int(sizes.sum()))
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    padded = np.concatenate([flat, np.zeros(words, np.uint64)])
    doc = np.repeat(np.arange(len(batch)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # words from here to the end of the text
    value = np.zeros(len(flat), np.uint64)
    for k in range(words):
        value = value * PRIME + np.where(left > k, padded[k : k + len(flat)], np.uint64(1))
    first = np.repeat(np.cumsum(sizes) - sizes, sizes) == np.arange(len(flat))
    valid = (left >= words) | first
    doc, value = doc[valid], mixed(value[valid])
    _, at, counts = np.unique(mixed(value ^ (doc.astype(np.uint64) * PRIME)), return_index=True, return_counts=True)
    return doc[at], value[at], counts


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, size: int = BANDS * ROWS) -> np.ndarray:
    """One row of ``size`` dart hashes per document; a document without weight has zeros.

    ``weight`` may be any positive number. Documents whose darts leave a coordinate empty are thrown again
    for twice the time, until none is left.
    """
    out = np.zeros((n_docs, size), np.uint64)
    total = np.bincount(doc, weight, n_docs)
    waiting = total > 0
    until = np.zeros(n_docs)
    until[waiting] = size * (np.log(size) + 3) / total[waiting]
    while waiting.any():
        inside = waiting[doc]
        docs, elements, weights = doc[inside], element[inside], weight[inside].astype(np.float64)
        earliest = np.full(n_docs * size, np.inf)
        thrown = []
        region, begin, width = 0, 0.0, 1.0
        while len(docs):
            seed = elements + np.uint64(region * 0xD6E8FEB86659FD93 % 2**64)
            live, time, throw = np.arange(len(docs)), np.zeros(len(docs)), 0
            while len(live):
                draw = mixed(seed[live] + np.uint64((throw + 1) * int(PRIME) % 2**64))
                time = time - np.log(unit(draw)) / width
                soon = time <= until[docs[live]]
                live, time, draw = live[soon], time[soon], draw[soon]
                place = mixed(draw ^ np.uint64(0xA0761D6478BD642F))
                counts = begin + width * unit(place) <= weights[live]
                slot = docs[live[counts]] * size + (mixed(place[counts]) % np.uint64(size)).astype(np.int64)
                thrown.append((slot, time[counts], draw[counts]))
                np.minimum.at(earliest, slot, time[counts])
                throw += 1
            begin, width, region = (1.0, 1.0, 1) if region == 0 else (begin * 2, width * 2, region + 1)
            more = weights > begin
            docs, elements, weights = docs[more], elements[more], weights[more]
        flat = out.ravel()
        for slot, time, draw in thrown:
            won = time == earliest[slot]
            flat[slot[won]] = draw[won]
        empty = ~np.isfinite(earliest).reshape(n_docs, size).all(1)
        waiting &= empty
        until *= 2
    return out


def similarity(left: dict[int, int], right: dict[int, int]) -> float:
    """Weighted Jaccard similarity of two shingle counts."""
    small, large = (left, right) if len(left) <= len(right) else (right, left)
    both = sum(min(n, large.get(x, 0)) for x, n in small.items())
    total = sum(left.values()) + sum(right.values()) - both
    return both / total if total else 1.0


def with_signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """Key, a 128-bit digest of the text, and the bucket of every band; a text without words has no bucket."""

    def batch_rows(batch):
        import hashlib

        import pyarrow as pa

        text = batch.column(2).to_pylist()
        doc, element, counts = shingles(text, words)
        values = signatures(doc, element, counts, len(text), bands * rows)
        bucket = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], len(text), 0)
        for k in range(rows):
            bucket = mixed(bucket * PRIME + values[:, k::rows])
        some = np.bincount(doc, minlength=len(text)) > 0
        lists = pa.array([b.tolist() if s else [] for b, s in zip(bucket.view(np.int64), some, strict=True)], pa.list_(pa.int64()))
        digest = pa.array([hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in text], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digest, lists], ["key_id", "key_hash", "digest", "buckets"])

    return docs.mapInArrow(per_row(batch_rows), "key_id long, key_hash long, digest binary, buckets array<long>")


def verified(pairs: DataFrame, bodies: DataFrame, words: int) -> DataFrame:
    """``a``, ``b`` and the similarity of their whole texts."""

    def batch_rows(batches):
        import pyarrow as pa

        last: tuple = (None, None)

        def counted(text):
            _, element, counts = shingles([text], words)
            return dict(zip(element.tolist(), counts.tolist(), strict=True))

        for batch in batches:
            values = []
            for a, left, right in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if last[0] != a:
                    last = (a, counted(left))
                values.append(similarity(last[1], counted(right)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], ["a", "b", "similarity"])

    left, right = bodies.toDF("a", "left_text"), bodies.toDF("b", "right_text")
    both = pairs.hint("merge").join(right, "b").hint("merge").join(left, "a").select("a", "b", "left_text", "right_text")
    # a text may stand in several rows of the same id
    return both.mapInArrow(batch_rows, "a binary, b binary, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def prefix_pairs(open_: DataFrame, bodies: DataFrame, words: int, similar: float) -> DataFrame:
    """Pairs of texts with different labels that may reach the similarity, by exact prefix filtering.

    A shingle that occurs n times counts as n elements, so the weighted similarity is that of sets. Elements are
    ordered by how many of the texts have them, rarest first; texts that reach the similarity share an element among
    the first size - ceil(similar * size) + 1 of both. The places of a shared element bound the overlap: many texts
    around one passage differ in words of their own, which come first.

    Each text also has a bit map: bit h is set when an odd number of its elements hash to h. Every bit in which two
    maps differ needs an element of only one of the texts, so the maps bound the overlap too and no link is lost. They
    settle most pairs just below the similarity inside the join.
    """

    def elements(batch):
        import pyarrow as pa

        doc, value, counts = shingles(batch.column(1).to_pylist(), words)
        size = np.bincount(doc, counts, batch.num_rows).astype(np.int64)
        at = np.repeat(np.arange(len(doc)), counts)
        again = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        element = mixed(value[at] + again.astype(np.uint64) * PRIME)
        doc = doc[at]
        place = mixed(element) % np.uint64(64 * MAP_WORDS)
        bits = np.zeros((batch.num_rows, MAP_WORDS), np.uint64)
        np.bitwise_xor.at(bits, (doc, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
        element = element.view(np.int64)
        # the row of a text's smallest element carries its map
        smallest = np.full(batch.num_rows, np.iinfo(np.int64).max)
        np.minimum.at(smallest, doc, element)
        carries = element == smallest[doc]
        ends = np.concatenate([[0], np.cumsum(carries * MAP_WORDS)]).astype(np.int32)
        maps = pa.ListArray.from_arrays(pa.array(ends), pa.array(bits.view(np.int64)[doc[carries]].ravel()), mask=pa.array(~carries))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(element), pa.array(size[doc]), maps], ["node", "element", "size", "bits"])

    texts_of = bodies.join(open_.select("node").hint("merge"), "node").select("node", "text")
    rows = stored(texts_of.mapInArrow(per_row(elements), "node binary, element long, size long, bits array<long>").distinct(), "elements")
    maps = rows.where("bits IS NOT NULL").select("node", "bits")
    rows = rows.drop("bits")
    # elements of one text only cannot be shared, but they take their places in the prefix
    counts = stored(rows.groupBy("element").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    ranked = rows.join(counts.hint("merge"), "element", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    order = Window.partitionBy("node").orderBy("n", "element")
    # how many elements that some other text has come before
    before = F.coalesce(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    prefix = ranked.withColumns({"place": F.row_number().over(order), "before": before, "previous": F.lag("element").over(order)}).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * similar - 1e-9) + 1).where("n > 1")
    prefix = prefix.join(open_.hint("merge"), "node").select("node", "label", "element", "size", "place", "before", "previous")
    prefix = stored(prefix, "prefix")
    mixed_ = stored(prefix.groupBy("element").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("element"), "mixed")
    left = stored(prefix.join(mixed_.hint("merge"), "element").join(maps.hint("merge"), "node"), "meeting")
    left = left.select("element", F.col("node").alias("a"), "label", "size", "place", "before", "previous", "bits")
    right = left.toDF("element", "b", "label_b", "size_b", "place_b", "before_b", "previous_b", "bits_b")
    # the overlap that the similarity needs, and what can still be shared before, at and after this element
    needed = F.ceil((F.col("size") + F.col("size_b")) * (similar / (1 + similar)) - 1e-9)
    possible = F.least("before", "before_b") + 1 + F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b"))
    differ = (F.col("a") < F.col("b")) & (F.col("label") != F.col("label_b"))
    # two texts that also share the element before meet there already
    starts = ~F.coalesce(F.col("previous") == F.col("previous_b"), F.lit(False))
    apart = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(MAP_WORDS)), F.lit(0))
    near = F.col("size") + F.col("size_b") - apart >= 2 * needed
    return left.join(right.hint("merge"), "element").where(differ & (possible >= needed) & starts & near).select("a", "b").distinct()


def classes(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, hub_rounds: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: key_id, key_hash, class_id, class_key, is_first.

    Two texts are linked when the weighted Jaccard similarity of their shingle counts is ``similar`` or more and
    they share a bucket, which they miss with a chance below 1 in 10,000 at 0.8; equal texts always are. A
    class is a connected component; ``class_id`` is its smallest id (a null id is the smallest long),
    ``is_first`` marks the row of that id, on every row that repeats it with the same text. Texts without
    words, null ones too, are equal to each other only if they are the same text.

    Each bucket first compares all members with its most central one, and then with others if ``hub_rounds`` says
    so. Members of buckets that then still hold two classes go through :func:`prefix_pairs`, so hubs lose no link. Runs jobs and writes to the
    checkpoint folder.
    """
    with scratch_tables(docs.sparkSession):
        source = keyed(docs, id_col, text_col)
        signed = stored(with_signatures(source, words, bands, rows), "signed", keep=True)
        first = F.min(F.struct("key_id", "key_hash")).alias("first")
        # the node orders by id; equal texts are one node
        number = F.unhex(F.lpad(F.hex(F.col("first.key_id").bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
        nodes = stored(signed.groupBy("digest").agg(first, F.first("buckets").alias("buckets")).select(F.concat(number, "digest").alias("node"), "digest", "first", "buckets"), "nodes")
        spread = nodes.select("node", F.explode("buckets").alias("bucket"))
        shared = stored(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
        members = stored(spread.join(shared.hint("merge"), "bucket"), "members")
        wanted = members.select("node").distinct().join(nodes, "node").select("node", F.col("first.key_id").alias("key_id"), F.col("first.key_hash").alias("key_hash"))
        bodies = stored(source.join(wanted.hint("merge"), ["key_id", "key_hash"]).select("node", "text"), "bodies")
        central = stored(members.groupBy("node").agg(F.sum("n").alias("weight")), "central")
        members = stored(members.select("bucket", "node").join(central, "node"), "weighed")

        labels = links = compared = None
        for turn in range(hub_rounds + 1):
            now = members.withColumn("label", F.col("node")) if labels is None else stored(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "now")
            weight = F.col("weight") if turn == 0 else F.xxhash64("node", F.lit(turn))
            hubs = now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.struct(weight.alias("w"), F.col("node").alias("hub"), F.col("label").alias("hub_label"))).alias("top"))
            hubs = stored(hubs.where("low <> high").select("bucket", "top.hub", "top.hub_label"), "hubs")
            if turn < hub_rounds:
                pairs = now.join(hubs, "bucket").where("label <> hub_label").select(F.least("node", "hub").alias("x"), F.greatest("node", "hub").alias("y"), "hub")
                pairs = pairs.select(F.col("hub").alias("a"), F.when(F.col("hub") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b")).distinct()
            else:
                # members of buckets that still hold two classes
                open_ = stored(now.join(hubs.select("bucket"), "bucket").select("node", "label").distinct(), "open")
                pairs = prefix_pairs(open_, bodies, words, similar)
            if compared is not None:
                done = compared.select("a", "b").union(compared.select("b", "a"))
                pairs = pairs.join(done, ["a", "b"], "left_anti")
            pairs = stored(pairs, "pairs")
            if not pairs.take(1):
                if turn == 0 or turn == hub_rounds:
                    break
                continue
            fresh = stored(verified(pairs, bodies, words), "fresh")
            compared = fresh if compared is None else compared.union(fresh)
            new = fresh.where(F.col("similarity") >= similar)
            links = new if links is None else links.union(new)
            labels = components(links)

        root = F.col("node") if labels is None else F.coalesce("label", "node")
        named = nodes.select("digest", "node") if labels is None else nodes.select("digest", "node").join(labels, "node", "left")
        named = stored(named.select("digest", root.alias("class_key")), "named", keep=True)
    unsigned = F.conv(F.hex(F.substring("class_key", 1, 8)), 16, 10).cast("decimal(20,0)")
    class_id = (unsigned - F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")
    out = signed.select("key_id", "key_hash", "digest").join(named.hint("merge"), "digest").withColumn("class_id", class_id)
    # the class key ends with the digest of its first text
    return out.select("key_id", "key_hash", "class_id", "class_key", ((F.col("key_id") == F.col("class_id")) & (F.substring("class_key", 9, 16) == F.col("digest"))).alias("is_first"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, class_id, is_first; see :func:`classes`. A null id stays null."""
    lowest = F.lit(-(2**63))
    null_if_lowest = lambda c: F.when(F.col(c) != lowest, F.col(c)).alias(c)
    return classes(docs, **options).select(null_if_lowest("key_id").alias("doc_id"), null_if_lowest("class_id"), "is_first")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id; all columns unchanged, whatever their names."""
    own_id, own_hash = free_name(docs, "_key_id"), free_name(docs, "_key_hash")
    with scratch_tables(docs.sparkSession):
        found = classes(docs, id_col=id_col, text_col=text_col, **options)
        gone = stored(found.where(~F.col("is_first")).select(F.col("key_id").alias(own_id), F.col("key_hash").alias(own_hash)).distinct(), "gone", keep=True)
    key_id, key_hash = key_columns(id_col, text_col)
    rows = docs.withColumns({own_id: key_id, own_hash: key_hash})
    return rows.join(gone.hint("merge"), [own_id, own_hash], "left_anti").dropDuplicates([own_id, own_hash]).select(*docs.columns)
