"""Benchmark decontamination by latent semantic retrieval.

Texts become hashed TF-IDF vectors; a randomised SVD of all of them, run as sums over the partitions, gives the latent
space. Passages are cut to the length of the items that they are compared with, and those near an item by cosine
are candidates. An index of the items' answer words is the second source, for passages that the words around an item
drown. Candidates are settled on the words themselves: the longest common subsequence with the item, and the answer.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.llm.common import free_name, small_batches, stored, texts

FEATURES = 1 << 14
DIMENSIONS, EXTRA, POWERS = 128, 32, 2
#: Words per half passage; a passage is two halves, and starts at every half. An item takes the longest half that is no
#: longer than itself. Each is a multiple of the one before.
HALVES = (6, 12, 24)
#: Features in more than this share of all documents have no weight.
COMMON = 0.2
#: Benchmark items that one pass over the documents compares.
ITEMS_PER_PASS = 4096
#: A candidate's least cosine, the least share of an item's words in order, and of its answer words. Where the benchmark
#: names no answers, a cosine of ``CLEAR`` or a share of ``STRONG`` stands for them.
COSINE, SUBSEQUENCE, ANSWER = 0.35, 0.6, 0.5
CLEAR, STRONG = 0.4, 0.7
#: Passages whose cosines with all items are computed at once.
AT_ONCE = 1024
#: Halves whose words are added up at once.
SLOTS = 256
REMEMBERED = 1 << 16
#: Bytes of features that are multiplied at once.
TOGETHER = 16 << 20
#: Feature sums travel in this many rows.
PARTS = 64
#: The driver fetches them in this many shares, one after another.
AT_A_TIME = 8
EDGES = re.compile(r"^\W+|\W+$")
#: ASCII signs that are no part of a word; the usual case of ``EDGES``.
MARKS = string.punctuation.replace("_", "")
#: All ASCII characters that ``EDGES`` takes off.
OUTSIDE = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c != "_")


class Features(dict):
    def __init__(self):
        from xxhash import xxh3_64_intdigest

        self.digest = xxh3_64_intdigest

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        word_itself = plain(word)
        try:
            value = self.digest(word_itself) % FEATURES
        except UnicodeEncodeError:
            value = self.digest(word_itself.encode("utf-8", "surrogatepass")) % FEATURES
        self[word] = value
        return value


@lru_cache(1)
def features() -> Features:
    return Features()


def words_of(text: str) -> list[str]:
    """Words between white space; features and comparisons take their plain forms."""
    return text.split()


def plain(word: str) -> str:
    """Lower case, without what is no letter or digit at the ends."""
    word = word.lower()
    if word.isalnum():
        return word
    word = word.strip(MARKS)
    return word if word.isalnum() else EDGES.sub("", word)


def bare(words: list[str]) -> list[str]:
    return [plain(w) for w in words]


def ids_of(words: list[str]) -> np.ndarray:
    return np.fromiter(map(features().__getitem__, words), np.int32, len(words))


def ids_of_array(words) -> np.ndarray:
    """The features of an Arrow array of words, each different one hashed once. Arrow makes the plain forms of ASCII words."""
    import pyarrow.compute as pc
    from xxhash import xxh3_64_intdigest

    simple = pc.string_is_ascii(words)
    forms = pc.ascii_trim(pc.ascii_lower(words.filter(simple)), characters=OUTSIDE).dictionary_encode()
    others = words.filter(pc.invert(simple)).dictionary_encode()
    here = simple.to_numpy(zero_copy_only=False)
    digests = np.fromiter(map(xxh3_64_intdigest, forms.dictionary.cast("binary").to_pylist()), np.uint64, len(forms.dictionary))
    out = np.empty(len(words), np.int16)
    out[here] = (digests % np.uint64(FEATURES)).astype(np.int16)[forms.indices.to_numpy()]
    out[~here] = ids_of(others.dictionary.to_pylist()).astype(np.int16)[others.indices.to_numpy()]
    return out


def ids_of_texts(column) -> list[np.ndarray]:
    """The features of the words of each text in an Arrow column, as 16-bit integers.

    Arrow splits at the white space that ``str.split`` knows, and gives empty words at the ends.
    """
    import pyarrow.compute as pc

    lists = pc.utf8_split_whitespace(pc.fill_null(column, ""))
    words = lists.flatten()
    there = pc.greater(pc.binary_length(words), 0)
    ids = ids_of_array(words.filter(there))
    sizes = np.bincount(pc.list_parent_indices(lists).filter(there).to_numpy(), minlength=len(column))
    return np.split(ids, np.cumsum(sizes)[:-1]) if len(column) else []


def summed(rows: DataFrame, part_fn, height: int = FEATURES) -> np.ndarray:
    """Sum a (``height`` x k) matrix over the partitions of ``rows``: each gives its part, Spark adds them by row block."""
    n_parts = math.gcd(PARTS, height)

    def parts(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                part = part_fn(batch)
                total = part if total is None else total + part
        if total is not None:
            blocks = np.split(total.astype(np.float64), n_parts)
            yield pa.RecordBatch.from_arrays([pa.array(range(n_parts), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["block", "part"])

    def added(key, table):
        import pyarrow as pa

        total = sum(np.frombuffer(x, np.float64) for x in table.column("part").to_pylist())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, part binary"
    sums = rows.mapInArrow(parts, schema).groupBy("block").applyInArrow(added, schema)
    out = None
    for r in sums.coalesce(AT_A_TIME).toLocalIterator():  # at most PARTS rows, a few of them in the driver at once
        part = np.frombuffer(r.part, np.float64).reshape(height // n_parts, -1)
        if out is None:
            out = np.zeros((height, part.shape[1]))
        out[r.block * len(part) : (r.block + 1) * len(part)] = part
    return np.zeros((height, 0)) if out is None else out


def with_features(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` and a column ``name``: the features of the words of each text, as 16-bit integers, written once."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    at = docs.columns.index(text_col)

    def batch_rows(batches):
        import pyarrow as pa

        for batch in small_batches(batches, text_col, TOGETHER):
            ids = [x.tobytes() for x in ids_of_texts(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], [*batch.schema.names, name])

    schema = StructType([*docs.schema.fields, StructField(name, BinaryType())])
    return stored(docs.mapInArrow(batch_rows, schema), "features")


def read_ids(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int16) for x in column.to_pylist()]


def different(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different features of each text, ascending, one text after another: which text, which feature."""
    sizes = [len(t) for t in texts]
    if not sum(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = np.sort(np.repeat(np.arange(len(texts)) * FEATURES, sizes) + np.concatenate(texts))
    keys = keys[np.diff(keys, prepend=-1) > 0]
    return keys // FEATURES, keys % FEATURES


def document_frequency(read: DataFrame) -> tuple[np.ndarray, float]:
    """In how many of all documents each feature occurs, and how many documents there are."""

    def part(batch):
        total = np.zeros((FEATURES, 2))
        for cut in small_batches([batch], "ids"):
            total[:, 0] += np.bincount(different(read_ids(cut.column(0)))[1], minlength=FEATURES)
            total[0, 1] += cut.num_rows
        return total

    total = summed(read.select("ids"), part)
    return (total[:, 0], total[0, 1]) if total.size else (np.zeros(FEATURES), 0.0)


@dataclass(frozen=True)
class TextRows:
    """The unit TF-IDF rows of texts: text, feature and weight of what is not zero, by text and by feature."""

    texts: int
    text: np.ndarray
    feature: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(texts: list[np.ndarray], idf: np.ndarray) -> TextRows:
        text, feature = different(texts)
        weighed = idf[feature] > 0
        text, feature = text[weighed], feature[weighed]
        weight = idf[feature]
        norm = np.sqrt(np.bincount(text, weight.astype(np.float64) ** 2, len(texts))).astype(np.float32)
        return TextRows(len(texts), text, feature, weight / norm[text])

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """Rows times ``matrix``, a row for each text."""
        out = np.zeros((self.texts, matrix.shape[1]), np.float32)
        edges = np.searchsorted(self.text, np.arange(self.texts + 1)).tolist()
        for k, (a, b) in enumerate(pairwise(edges)):
            if a < b:
                np.matmul(self.weight[a:b], matrix.take(self.feature[a:b], axis=0, mode="clip"), out=out[k])
        return out

    def turned_times(self, image: np.ndarray) -> np.ndarray:
        """The transposed rows times ``image``, a row for each feature."""
        order = np.argsort(self.feature.astype(np.int16), kind="stable")
        text, weight = self.text[order], self.weight[order]
        out = np.zeros((FEATURES, image.shape[1]), np.float32)
        edges = np.searchsorted(self.feature[order], np.arange(FEATURES + 1)).tolist()
        for k, (a, b) in enumerate(pairwise(edges)):
            if a < b:
                np.matmul(weight[a:b], image.take(text[a:b], axis=0, mode="clip"), out=out[k])
        return out


def text_sums(texts: list[np.ndarray], idf: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A'(A ``matrix``), where the rows of A are the unit TF-IDF rows of texts."""
    rows = TextRows.of(texts, idf)
    return rows.turned_times(rows.times(matrix))


def image_squares(texts: list[np.ndarray], idf: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """(A ``matrix``)'(A ``matrix``), which needs no sums by feature."""
    image = TextRows.of(texts, idf).times(matrix)
    return image.T @ image


def latent_space(read: DataFrame, idf: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Randomised SVD of the TF-IDF rows of all texts: features x dimensions, each direction divided by its singular value.

    ``read`` has the features of each text as ``ids``. The partitions are put together to as many as there are cores, so
    that the sums that are shuffled do not grow with the documents.
    """
    rows = read.select("ids").coalesce(max(1, read.sparkSession.sparkContext.defaultParallelism))
    weight = idf.astype(np.float32)

    def product(matrix, sums, height):
        def part(batch):
            return sum(sums(read_ids(cut.column(0)), weight, matrix).astype(np.float64) for cut in small_batches([batch], "ids", TOGETHER))

        return summed(rows, part, height)

    basis = np.random.default_rng(seed).normal(size=(FEATURES, dimensions + EXTRA)).astype(np.float32)
    for _ in range(POWERS):
        image = product(basis, text_sums, FEATURES)
        if not image.size or not image.any():
            return np.zeros((FEATURES, dimensions), np.float32)
        basis = np.linalg.qr(image)[0].astype(np.float32)
    # the last pass needs the space's own matrix only: Q'A'A Q, without sums by feature
    values, turn = np.linalg.eigh(product(basis, image_squares, dimensions + EXTRA))
    order = np.argsort(values)[::-1][:dimensions]
    values = values[order]
    scale = np.where(values > 1e-6 * max(values[0], 1e-30), 1 / np.sqrt(np.maximum(values, 1e-30)), 0)
    return ((basis @ turn[:, order]) * scale).astype(np.float32)


def units(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def passage_vectors(table: np.ndarray, ids: np.ndarray, sizes: np.ndarray, halves: tuple[int, ...]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of a half: unit vectors of all passages of texts given one after another, their text and their first word in it.

    The last row of ``table`` is zero and stands for no word.
    """
    least, none = halves[0], len(table) - 1
    per_text = -(-sizes // least)
    pieces = np.append(0, np.cumsum(per_text))
    begin = np.cumsum(sizes) - sizes
    slots = np.full(pieces[-1] * least, none, np.int64)
    # a word that repeats the one before it counts once, so that it does not drown the rest
    again = np.diff(ids, prepend=-1) == 0
    again[begin[sizes > 0]] = False
    slots[np.arange(len(ids)) + np.repeat(pieces[:-1] * least - begin, sizes)] = np.where(again, none, ids)
    slots = slots.reshape(-1, least)
    sums = np.zeros((len(slots), table.shape[1]), np.float32)
    held = np.empty((SLOTS, table.shape[1]), np.float32)
    for a in range(0, len(sums), SLOTS):
        part = slots[a : a + SLOTS]
        for k in range(least):
            sums[a : a + SLOTS] += table.take(part[:, k], axis=0, mode="clip", out=held[: len(part)])
    out = {}
    for half in halves:
        group = half // least
        per_half = -(-per_text // group)
        text = np.repeat(np.arange(len(sizes)), per_half)
        place = np.arange(len(text)) - np.repeat(np.cumsum(per_half) - per_half, per_half)
        first = pieces[text] + place * group
        own = sums if group == 1 else sums[first]
        for k in range(1, group):
            there = np.flatnonzero(first + k < pieces[text + 1])
            own[there] += sums[first[there] + k]
        # the last half stands alone only where it is the first
        joined = np.zeros(len(text), bool)
        joined[:-1] = text[:-1] == text[1:]
        keep = np.flatnonzero(joined | (place == 0))
        both = own[keep]
        both[joined[keep]] += own[keep[joined[keep]] + 1]
        out[half] = units(both), text[keep], place[keep] * half
    return out


@dataclass(frozen=True)
class Item:
    """A benchmark item: its words, and their features, as bit masks of their places, and the words of its answer."""

    item_id: int
    size: int
    #: The features of its words, in order.
    words: list[int]
    masks: dict[str, int]
    features: dict[int, int]
    answer: frozenset[str]
    #: How many answer words each of their features stands for.
    answer_features: dict[int, int]

    @property
    def half(self) -> int:
        return max((h for h in HALVES if h <= self.size), default=HALVES[0])


def subsequence(size: int, masks: dict, words: list) -> int:
    """Length of the longest common subsequence of an item of ``size`` words and ``words``, bit-parallel over the item."""
    full = (1 << size) - 1
    state = full
    for mask in map(masks.get, words):
        if mask:
            hit = state & mask
            state = ((state + hit) | (state - hit)) & full
    return size - state.bit_count()


@dataclass(frozen=True)
class Searcher:
    """What a task needs to search documents for a block of items; its size is bounded by the block."""

    table: np.ndarray
    items: list[Item]
    cosine: float
    subsequence: float
    answer: float
    #: What stands for an answer; none do where the benchmark names answers.
    clear: float = CLEAR
    strong: float = STRONG

    @cached_property
    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """Items by the features of their answer words: where each feature's items start, and the items."""
        pairs = sorted((f, k) for k, item in enumerate(self.items) for f in item.answer_features)
        starts = np.zeros(FEATURES + 1, np.int64)
        np.add.at(starts, [f + 1 for f, _ in pairs], 1)
        return np.cumsum(starts), np.array([k for _, k in pairs], np.int64)

    @cached_property
    def vectors(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each length of a half: the vectors of the passages of its items, and whose they are."""
        out = {}
        for half in sorted({i.half for i in self.items}):
            own = [k for k, i in enumerate(self.items) if i.half == half]
            words = [np.array(self.items[k].words, np.int64) for k in own]
            vectors, text, _ = passage_vectors(self.table, np.concatenate(words), np.array([len(w) for w in words]), (half,))[half]
            out[half] = vectors, np.array(own)[text]
        return out

    def near(self, ids: np.ndarray, sizes: np.ndarray):
        """Texts, items and first words of passages whose cosine with the item is high enough, if they have enough of its words."""
        for half, (vectors, text, place) in passage_vectors(self.table, ids, sizes, tuple(self.vectors)).items():
            own, owner = self.vectors[half]
            hits = [np.nonzero(vectors[a : a + AT_ONCE] @ own.T >= self.cosine) for a in range(0, len(vectors), AT_ONCE)]
            row = np.concatenate([[], *(r + k * AT_ONCE for k, (r, _) in enumerate(hits))]).astype(np.int64)
            item = owner[np.concatenate([[], *(c for _, c in hits)]).astype(np.int64)]
            order = np.argsort(item, kind="stable")
            row, item = row[order], item[order]
            cuts = [*np.flatnonzero(np.diff(item, prepend=-1)).tolist(), len(item)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                k = int(item[a])
                for at in np.split(row[a:b], range(AT_ONCE, b - a, AT_ONCE)):
                    at = at[self.covered(self.items[k], ids, sizes, text[at], place[at])]
                    yield from ((t, k, p) for t, p in zip(text[at].tolist(), place[at].tolist(), strict=True))

    def covered(self, item: Item, ids: np.ndarray, sizes: np.ndarray, text: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the words around each passage, in any order, can hold enough of the item's words.

        The first 64 places of an item are bits of a word; those beyond count as there.
        """
        places = np.zeros(FEATURES + 1, np.uint64)
        for feature, mask in item.features.items():
            places[feature] = mask & (1 << 64) - 1
        first = np.maximum(0, place - item.size)
        last = np.minimum(sizes[text], place + 2 * item.half + item.size)
        begin = np.cumsum(sizes) - sizes
        # the words of one region after another
        n = last - first
        at = np.arange(n.sum()) + np.repeat(begin[text] + first - np.cumsum(n) + n, n)
        bits = places.take(ids.take(at, mode="clip"), mode="clip")
        there = np.bitwise_count(np.bitwise_or.reduceat(bits, np.cumsum(n) - n)).astype(np.int64) if len(bits) else np.zeros(len(n), np.int64)
        return there + max(0, item.size - 64) >= self.subsequence * item.size

    def together(self, ids: np.ndarray, sizes: np.ndarray):
        """Texts and items that share answer words: (text, item, places of these words in the text), in order."""
        starts, owned = self.index
        count = np.diff(starts)
        at = np.flatnonzero(count[ids])
        each = count[ids[at]]
        item = owned[np.repeat(starts[ids[at]] - np.cumsum(each) + each, each) + np.arange(each.sum())]
        at = np.repeat(at, each)
        text = np.searchsorted(np.cumsum(sizes), at, side="right")
        key = text * len(self.items) + item
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        # as many different features as the answer needs at least, so as many hits
        least = np.array([self.least_features(i) for i in self.items], np.int64)
        cuts = np.flatnonzero(np.diff(key, prepend=-1))
        ends = np.append(cuts[1:], len(key))
        enough = ends - cuts >= least[key[cuts] % len(self.items)]
        begin = np.cumsum(sizes) - sizes
        for a, b in zip(cuts[enough].tolist(), ends[enough].tolist(), strict=True):
            t, k = divmod(int(key[a]), len(self.items))
            yield t, k, (at[a:b] - begin[t]).tolist()

    def least_features(self, item: Item) -> int:
        """How few features can stand for enough answer words."""
        have, n = 0, 0
        for words in sorted(item.answer_features.values(), reverse=True):
            if have >= self.answer * len(item.answer):
                break
            have, n = have + words, n + 1
        return n

    def places(self, item: Item, hits: list[int], own: np.ndarray):
        """Starts of passages of a text whose surroundings hold enough of the item's answer words."""
        half, reach = item.half, 2 * item.half + item.size
        starts = sorted({p for q in hits for p in range(max(0, -(-(q - reach + 1) // half)) * half, q + item.size + 1, half)})
        a = b = 0
        inside: Counter = Counter()
        have = 0
        features = own[hits].tolist()
        for p in starts:
            while b < len(hits) and hits[b] < p + reach:
                inside[features[b]] += 1
                have += item.answer_features[features[b]] if inside[features[b]] == 1 else 0
                b += 1
            while a < b and hits[a] < p - item.size:
                inside[features[a]] -= 1
                have -= item.answer_features[features[a]] if inside[features[a]] == 0 else 0
                a += 1
            if have >= self.answer * len(item.answer) and (p == 0 or p + half < len(own)):
                yield p

    def find(self, batch: list[str], features: list[np.ndarray]) -> list[dict[int, tuple[float, float, float, int]]]:
        """Per text and its features: item id to best (cosine, share of the item in common, share of the answer, first word)."""
        sizes = np.array([len(f) for f in features], np.int64)
        ids = np.concatenate(features).astype(np.int64) if len(features) else np.zeros(0, np.int64)
        out: list[dict] = [{} for _ in batch]
        if not len(ids) or not self.items:
            return out
        start = np.cumsum(sizes) - sizes
        wanted = set(self.near(ids, sizes))
        for t, k, hits in self.together(ids, sizes):
            wanted.update((t, k, p) for p in self.places(self.items[k], hits, ids[start[t] : start[t] + sizes[t]]))
        text, words = None, []
        for t, k, p in sorted(wanted):
            item, own = self.items[k], ids[start[t] : start[t] + sizes[t]]
            first, last = max(0, p - item.size), p + 2 * item.half + item.size
            # equal words have equal features, so this is no less than the share of words
            if subsequence(item.size, item.features, own[first:last].tolist()) < self.subsequence * item.size:
                continue
            if text != t:
                text, words = t, words_of(batch[t])
            region = bare(words[first:last])
            share = subsequence(item.size, item.masks, region) / item.size
            if share < self.subsequence:
                continue
            answered = len(item.answer.intersection(region)) / len(item.answer)
            passage = own[p : p + 2 * item.half]
            vector = passage_vectors(self.table, passage, np.array([len(passage)]), (item.half,))[item.half][0][0]
            vectors, owner = self.vectors[item.half]
            cosine = float((vectors[owner == k] @ vector).max())
            if answered >= self.answer or share >= self.strong or cosine >= self.clear:
                found = (cosine, share, answered, p)
                old = out[t].get(item.item_id)
                if old is None or (found[1], found[0], -found[3]) > (old[1], old[0], -old[3]):
                    out[t][item.item_id] = found
        return out


def searchers(read: DataFrame, benchmark: DataFrame, dimensions: int = DIMENSIONS, cosine: float = COSINE, share: float = SUBSEQUENCE, answer: float = ANSWER, seed: int = 11, items_per_pass: int = ITEMS_PER_PASS, answer_words: int = 5):
    """One searcher for each block of benchmark items; ``read`` has the features of all texts as ``ids``.

    The answer of an item is the words of its ``answer`` column if the benchmark has one, else its
    ``answer_words`` words of the highest inverse document frequency. Items that are null or without words are
    left out; rows that repeat an item id are one item each.
    """
    frequency, n_docs = document_frequency(read)
    idf = np.log((n_docs + 1) / (frequency + 1)) + 1
    # few documents say little about which words are common
    weight_of = np.where(frequency <= max(COMMON * n_docs, 100), idf, 0)
    table = latent_space(read, weight_of, dimensions, seed) * weight_of[:, None].astype(np.float32)
    table = np.vstack([table, np.zeros((1, table.shape[1]), np.float32)])
    named = "answer" in benchmark.columns
    rows = benchmark.select("item_id", "text", *(["answer"] if named else [])).where("item_id is not null and text is not null").orderBy("item_id", "text")
    block: list[Item] = []
    stands = (2.0, 2.0) if named else (CLEAR, STRONG)

    def made():
        return Searcher(table, list(block), cosine, share, answer, *stands)

    for r in rows.toLocalIterator():  # the query set, a block of bounded size at a time
        words = [w for w in bare(words_of(r.text)) if w]
        if not words:
            continue
        masks: dict[str, int] = {}
        for k, w in enumerate(words):
            masks[w] = masks.get(w, 0) | 1 << k
        by_feature: dict[int, int] = {}
        listed = ids_of(words).tolist()
        for k, f in enumerate(listed):
            by_feature[f] = by_feature.get(f, 0) | 1 << k
        own = [w for w in bare(words_of(r.answer or "")) if w] if named else []
        weight = dict(zip(words, idf[ids_of(words)].tolist(), strict=True))
        own = own or sorted(masks, key=lambda w: (-weight[w], w))[:answer_words]
        answer_features = dict(Counter(ids_of(sorted(set(own))).tolist()))
        block.append(Item(r.item_id, len(words), listed, masks, by_feature, frozenset(own), answer_features))
        if len(block) == items_per_pass:
            yield made()
            block = []
    if block:
        yield made()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each document and benchmark item that it holds.

    Columns: doc_id, item_id, cosine, common (share of the item's words in the longest common subsequence), answered
    (share of its answer words), first_word (where the passage starts). Each row of ``docs`` is searched on its own,
    so rows that repeat give their hits again; null and empty texts have none. Document frequencies,
    the latent space and the search cover all rows.
    """
    source = with_features(texts(docs, id_col, text_col), "text", "ids")
    schema = "doc_id long, item_id long, cosine double, common double, answered double, first_word long"
    out = None
    for searcher in searchers(source, benchmark, **options):
        found = source.mapInArrow(hits(searcher), schema)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def hits(searcher: Searcher):
    def run(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        for batch in small_batches(batches, "text", 1 << 20):
            rows = [(i, item, *values) for i, found in zip(batch.column(0).to_pylist(), searcher.find(batch.column(1).to_pylist(), read_ids(batch.column(2))), strict=True) for item, values in sorted(found.items())]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "cosine", "common", "answered", "first_word"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns unchanged. Nothing but sums is shuffled.

    The rows are written once with the features of their words, which every pass over them reads.
    """
    name = free_name(docs, "_features")
    out = read = with_features(docs, text_col, name)
    text_at = docs.columns.index(text_col)
    for searcher in searchers(read.select(F.col(name).alias("ids")), benchmark, **options):
        out = out.mapInArrow(without(searcher, text_col, text_at), read.schema)
    return out.drop(name)


def without(searcher: Searcher, text_col: str, text_at: int):
    def run(batches):
        import pyarrow as pa

        for batch in small_batches(batches, text_col, 1 << 20):
            found = searcher.find([t or "" for t in batch.column(text_at).to_pylist()], read_ids(batch.column(batch.num_columns - 1)))
            yield batch.filter(pa.array([not f for f in found]))

    return run
