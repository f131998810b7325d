"""Word counts, word-level vocabularies and merge-based sub-word vocabularies."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonolake.functions import text as X
from phonolake.functions.similarity import decompose
from phonolake.session import ensure_checkpoint_dir
from phonolake.sources.corpora import spread_small_input

# Special tokens in id order, for the general and the phoneme-level vocabulary.
SPECIALS = ("[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]")
PHONEME_SPECIALS = ("[PAD]", "[CLS]", "[SEP]", "[MASK]", "[UNK]")
VOCAB_SIZE = 30522
PHONEME_VOCAB_SIZE = 1000

#: Distinct runs of symbols that merge learning takes to the driver at once.
MOST_RUNS = 100_000


def special_ids(specials: Sequence[str] = SPECIALS) -> dict[str, int]:
    return {token: i for i, token in enumerate(specials)}


def normalize_unicode(words: DataFrame, column: str = "word", out: str = "normal") -> DataFrame:
    """Decompose, lower-case and strip accents; call it on distinct words."""
    plain = F.regexp_replace(F.lower(decompose(F.col(column))), r"\p{Mn}", "")
    return words.withColumn(out, plain)


def spaced_pieces(df: DataFrame, column: str = "text") -> DataFrame:
    """``(column, n)``: what stands between white space in the texts, each distinct piece once with its count."""
    return df.select(F.explode(X.whitespace_words(F.col(column))).alias(column)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def word_frequencies(
    df: DataFrame, columns: Sequence[str] = ("text",), splitter=X.split_words, normalize: bool = True, weight: str | None = None
) -> DataFrame:
    """Corpus counts ``(word, n)`` over all given text columns; a row counts ``weight`` times.

    Words are counted as written first and normalized afterwards, so the Arrow call sees every
    distinct word once.
    """
    parts = [splitter(F.col(c)) for c in columns]
    words = parts[0] if len(parts) == 1 else F.concat(*parts)
    times = F.lit(1) if weight is None else F.col(weight)
    counts = df.select(F.explode(words).alias("word"), times.cast("long").alias("n")).groupBy("word").agg(F.sum("n").alias("n"))
    if not normalize:
        return counts
    return normalize_unicode(counts).groupBy(F.col("normal").alias("word")).agg(F.sum("n").alias("n"))


def vocab_wordlevel(counts: DataFrame, size: int = VOCAB_SIZE, specials: Sequence[str] = SPECIALS) -> DataFrame:
    """``(token, id)``: specials first, then the most frequent words, ties by word.

    The top-n keeps about ``size`` rows, which bounds the window that numbers them. Specials and the
    empty word can only take their own number of places, so they are dropped after the top-n.
    """
    order = [F.col("n").desc(), F.col("word")]
    top = counts.orderBy(*order).limit(size + 1)
    usable = top.filter(~F.col("word").isin(list(specials)) & (F.col("word") != ""))
    numbered = usable.select(
        F.col("word").alias("token"), (F.row_number().over(W.orderBy(*order)) - 1 + len(specials)).alias("id")
    ).filter(F.col("id") < size)
    fixed = counts.sparkSession.createDataFrame(list(special_ids(specials).items()), "token string, id int")
    return fixed.unionByName(numbered)


def _code(token_id: int) -> str:
    """One private-use character per token, so that character order is id order."""
    point = 0xF0000 + token_id + (2 if token_id >= 65534 else 0)
    if point > 0x10FFFD:
        raise ValueError("at most 131068 tokens are supported")
    return chr(point)


def _characters(word) -> Column:
    return F.regexp_extract_all(word, F.lit(r"(?s)."), F.lit(0))


def _pair_counts(types: DataFrame) -> DataFrame:
    """Weighted counts of adjacent symbol pairs; overlapping occurrences count each."""
    last = F.char_length("seg") - 1
    pairs = F.transform(F.sequence(F.lit(1), last), lambda i: F.substr("seg", i, F.lit(2)))
    return (
        types.filter(last > 0)
        .select("n", F.explode(pairs).alias("pair"))
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
    )


#: Words that a step of a phase takes at once.
WORDS_AT_ONCE = 1 << 17


def _gathered(batches):
    """Counts and words of some batches at a time."""
    import pyarrow as pa

    waiting, rows = [], 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= WORDS_AT_ONCE:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, rows = [], 0
    if rows:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _symbols(words) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a string column as numbers, and where its words begin and end among them."""
    import pyarrow.compute as pc

    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset :]
    text = bytes(memoryview(words.buffers()[2])[at[0] : at[len(words)]]) if at[len(words)] else b""
    return _points(text.decode()), np.r_[0, np.cumsum(pc.utf8_length(words).to_numpy())]


def _strings(data: np.ndarray, bounds: np.ndarray):
    """A string column of the symbols between bounds."""
    import pyarrow as pa

    text = data.tobytes().decode("utf-32-le").encode()
    at = np.r_[0, np.cumsum(1 + (data > 0x7F) + (data > 0x7FF) + (data > 0xFFFF))]
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(at[bounds].astype(np.int32)), pa.py_buffer(text))


def _pair_numbers(active: set[str]) -> np.ndarray:
    both = _points("".join(active)).reshape(-1, 2).astype(np.uint64)
    return np.sort((both[:, 0] << np.uint64(32)) | both[:, 1])


def _cuts(data: np.ndarray, ends: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Where the runs of the words begin, and the end."""
    wide = data.astype(np.uint64)
    both = (wide[:-1] << np.uint64(32)) | wide[1:]
    begins = np.ones(len(data) + 1, bool)
    if len(pairs) and len(both):
        begins[1:-1] = pairs[np.minimum(np.searchsorted(pairs, both), len(pairs) - 1)] != both
    begins[ends] = True
    return np.flatnonzero(begins)


def _runs(active: set[str]):
    """A ``mapInArrow`` function: the runs of symbols that only active pairs join, with summed counts."""
    pairs = _pair_numbers(active)

    def cut(batches):
        import pyarrow as pa

        for rows in _gathered(batches):
            data, ends = _symbols(rows.column(1))
            cuts = _cuts(data, ends, pairs)
            long = np.diff(cuts) > 1
            of = np.searchsorted(ends, cuts[:-1][long], side="right") - 1
            kept = data[np.repeat(long, np.diff(cuts))]
            runs = _strings(kept, np.r_[0, np.cumsum(np.diff(cuts)[long])]).dictionary_encode()
            sums = np.zeros(len(runs.dictionary), np.int64)
            np.add.at(sums, runs.indices.to_numpy(), rows.column(0).to_numpy()[of])
            yield pa.RecordBatch.from_arrays([runs.dictionary, pa.array(sums)], ["run", "n"])

    return cut


def _merged(active: set[str], changed: dict[str, str]):
    """A ``mapInArrow`` function: put what a phase made of a run in its place; words of one symbol have no pairs and go."""
    pairs, old, new = _pair_numbers(active), list(changed), list(changed.values())

    def apply(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        known, made = pa.array(old, pa.string()), pa.array(new, pa.string())
        for rows in _gathered(batches):
            data, ends = _symbols(rows.column(1))
            cuts = _cuts(data, ends, pairs)
            runs = _strings(data, cuts)
            runs = pc.coalesce(made.take(pc.index_in(runs, value_set=known)), runs)
            data, bounds = _symbols(runs)
            bounds = bounds[np.searchsorted(cuts, ends)]
            done = pa.RecordBatch.from_arrays([rows.column(0), _strings(data, bounds)], ["n", "seg"])
            yield done.filter(pa.array(np.diff(bounds) > 1))

    return apply


class _Phase:
    """One-at-a-time merging of runs while its choice is the one that all words would give.

    Outside the runs stand pairs of at most ``floor`` occurrences. As long as merges make new symbols, each symbol
    ends and begins in one symbol of the start, so a pair of two symbols comes from one pair of the start: it is in
    the runs everywhere, and counted whole, or nowhere, and then at most as frequent as ``floor``.
    """

    def __init__(self, runs: list[tuple[list[int], int]], floor: int):
        self.runs = runs
        self.floor = floor
        self.counts: dict[tuple[int, int], int] = {}
        self.places: dict[tuple[int, int], set[int]] = {}
        for at in range(len(runs)):
            self.count(at, 1)
        self.heap = [(-n, pair) for pair, n in self.counts.items()]
        heapq.heapify(self.heap)

    def count(self, at: int, sign: int) -> list[tuple[int, int]]:
        symbols, n = self.runs[at]
        pairs = list(pairwise(symbols))
        for pair in pairs:
            self.counts[pair] = self.counts.get(pair, 0) + sign * n
            if sign > 0:
                self.places.setdefault(pair, set()).add(at)
        return pairs

    def best(self, first: bool) -> tuple[int, int] | None:
        """The next pair, or none where words outside the runs may hold a better one; the first is always right."""
        while self.heap:
            n, pair = self.heap[0]
            now = self.counts.get(pair, 0)
            if now == -n:
                return pair if now > 0 and (first or now > self.floor) else None
            heapq.heappop(self.heap)
            if now > 0:
                heapq.heappush(self.heap, (-now, pair))
        return None

    def merge(self, pair: tuple[int, int], made: int) -> None:
        left, right = pair
        changed = set()
        for at in self.places.pop(pair, ()):
            symbols, n = self.runs[at]
            if not any(p == pair for p in pairwise(symbols)):
                continue
            changed.update(self.count(at, -1))
            out, k = [], 0
            while k < len(symbols):
                if k + 1 < len(symbols) and symbols[k] == left and symbols[k + 1] == right:
                    out.append(made)
                    k += 2
                else:
                    out.append(symbols[k])
                    k += 1
            self.runs[at] = (out, n)
            changed.update(self.count(at, 1))
        for p in changed:
            if self.counts[p] > 0:
                heapq.heappush(self.heap, (-self.counts[p], p))


def train_merges(
    counts: DataFrame,
    vocab_size: int = VOCAB_SIZE,
    specials: Sequence[str] = SPECIALS,
    prefix: str = "",
    extra_tokens: Sequence[str] = (),
    most_pairs: int = 20_000,
    most_runs: int = MOST_RUNS,
) -> tuple[DataFrame, DataFrame]:
    """Learn merges from word counts; gives ``vocab(token, id)`` and ``merges(rank, left, right)``.

    The state is one row per distinct word, its symbols coded as one character each. A phase counts adjacent pairs
    on the cluster and takes the most frequent ones; the rest, none above some floor, cut the words into runs. Equal
    runs are added up, and no merge above the floor can cross a cut, so merging the distinct runs one at a time
    gives the merges that all words would give (see ``_Phase``); one that makes a known token ends the phase. In the words, each run is replaced by what became of it before the next phase.

    The driver gets at most ``most_pairs`` pairs and ``most_runs`` distinct runs; where there are more, fewer pairs
    are taken, down to the single best one. Phases, not merges, cost a pass over the words. Ties go to the pair
    with the lower token ids. ``prefix`` ("##") gives continuation pieces.
    """
    spark = counts.sparkSession
    ensure_checkpoint_dir(spark)
    words = counts.filter(F.col("word") != "").select("word", "n").checkpoint()
    # Alphabets are bounded by the character set, not by the corpus.
    at = F.when(F.col("p") == 0, F.lit("")).otherwise(F.lit(prefix))
    alphabet = sorted(
        (row["mark"], row["c"])
        for row in words.select(F.posexplode(_characters(F.col("word"))).alias("p", "c"))
        .select(at.alias("mark"), "c")
        .distinct()
        .collect()
    )
    ids: dict[str, int] = {}
    for token in [*specials, *extra_tokens, *(mark + c for mark, c in alphabet)]:
        ids.setdefault(token, len(ids))
    tokens = list(ids)
    id_of = {_code(i): i for i in range(len(tokens))}

    def coded(column: Column, mark: str) -> Column:
        letters = [c for m, c in alphabet if m == mark]
        return F.translate(column, "".join(letters), "".join(_code(ids[mark + c]) for c in letters))

    first, rest = coded(F.substring("word", 1, 1), ""), coded(F.substr("word", F.lit(2)), prefix)
    types = spread_small_input(words).select(F.col("n").cast("long").alias("n"), F.concat(first, rest).alias("seg")).checkpoint()
    merges: list[tuple[str, str]] = []
    take = 512
    while len(ids) < vocab_size:
        top = _pair_counts(types).orderBy(F.col("n").desc(), "pair").limit(most_pairs + 1).collect()
        if not top:
            break
        while True:
            # pairs that are more frequent than the first one left out, or the best one alone
            floor = top[take]["n"] if take < len(top) else 0
            active = {r["pair"] for r in top if r["n"] > floor}
            if not active:
                later = next((k for k, r in enumerate(top) if r["n"] < top[0]["n"]), None)
                if later is not None and later > take:
                    take = later
                    continue
                if later is None and len(top) <= most_pairs:
                    active = {r["pair"] for r in top}
                    floor = 0
                else:
                    active, floor = {top[0]["pair"]}, top[0]["n"]
            found = types.mapInArrow(_runs(active), "run string, n long").groupBy("run").agg(F.sum("n").alias("n")).limit(most_runs + 1).toArrow()
            if found.num_rows <= most_runs:
                break
            ties = sum(r["n"] == top[0]["n"] for r in top)
            if take > ties:
                take = max(ties, take // 4)
            else:
                top, take = top[:1], 1
                active, floor = {top[0]["pair"]}, top[0]["n"]
                found = types.mapInArrow(_runs(active), "run string, n long").groupBy("run").agg(F.sum("n").alias("n")).toArrow()
                break
        runs = [([id_of[c] for c in run], n) for run, n in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)]
        phase, learned = _Phase(runs, floor), 0
        while len(ids) < vocab_size and (pair := phase.best(not learned)):
            left, right = (tokens[k] for k in pair)
            whole = left + (right[len(prefix) :] if prefix else right)
            existed = whole in ids
            made = ids.setdefault(whole, len(ids))
            if not existed:
                tokens.append(whole)
                id_of[_code(made)] = made
            merges.append((left, right))
            learned += 1
            phase.merge(pair, made)
            if existed:  # a symbol made in two ways has pairs on both sides of a cut: count anew
                break
        made_of = ("".join(map(_code, symbols)) for symbols, _ in phase.runs)
        changed = {run: made for run, made in zip(found.column(0).to_pylist(), made_of, strict=True) if run != made}
        types = types.mapInArrow(_merged(active, changed), "n long, seg string").checkpoint()
        if found.num_rows * 4 <= most_runs:
            take = min(most_pairs, take * 4)
    vocab = spark.createDataFrame(list(ids.items()), "token string, id int")
    table = spark.createDataFrame(
        [(i, left, right) for i, (left, right) in enumerate(merges)], "rank int, left string, right string"
    )
    return vocab, table
