"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Random Fourier features approximate a Gaussian kernel over the statistics, so a linear fit in them is a kernel
fit. Each partition adds up its part of the normal equations; only sums of a fixed size reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.llm.common import per_row, scratch_tables, small_batches, stored, texts

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "stops", "commas", "marks", "symbols", "bars",
    "newlines", "brackets", "high_bytes", "distinct_words", "repeated_neighbours", "white", "distinct_lines", "top_byte",
]
FOLDS = 5
#: Calibration sees ridge scores on this grid between -1 and 2.
GRID = 3000


def byte_group(members: str) -> np.ndarray:
    out = np.zeros(256)
    out[[ord(c) for c in members]] = 1
    return out


GROUPS = np.stack(
    [
        byte_group("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), byte_group("0123456789"), byte_group("."), byte_group(","),
        byte_group("!?"), byte_group("#$%&*@~^_=+<>/\\"), byte_group("|"), byte_group("\n"), byte_group("()[]{}\"'"),
        (np.arange(256) >= 128).astype(float),
    ]
)


def statistics(text: str) -> np.ndarray:
    """The statistics of a whole text; an empty one has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    size = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    n = max(1, len(words))
    lines = text.split("\n")
    white = counts[9] + counts[10] + counts[13] + counts[32]
    again = sum(map(str.__eq__, words, words[1:]))
    shares = GROUPS @ counts / size
    counts[32] = 0
    return np.array(
        [np.log1p(len(raw)), np.log1p(len(words)), (len(raw) - white) / n, *shares, len(set(words)) / n, again / n, white / size, len(set(lines)) / len(lines), counts.max() / size],
        np.float64,
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and its statistics, one row per input row."""

    def batch_rows(batch):
        import pyarrow as pa

        rows = [statistics(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], ["doc_id", "stats"])

    return docs.mapInArrow(per_row(batch_rows), "doc_id long, stats array<double>")


@dataclass(frozen=True)
class Model:
    """A fitted scorer of a size that does not depend on the data."""

    center: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.center) / self.scale, -6, 6)
        waves = np.sqrt(2 / self.waves.shape[1]) * np.cos(z @ self.waves + self.phases)
        return np.hstack([np.ones((len(stats), 1)), waves])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(stats) @ self.weights, self.knots, self.values), 0, 1)


def fold_of(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS, F.lit(0)).cast("int")


def summed(rows: DataFrame, base: Model) -> dict[int, np.ndarray]:
    """Normal equations of each fold: sums of outer products of (features, label), row by row of the matrix."""
    width = base.waves.shape[1] + 2

    def partition_sums(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            fold = batch.column(0).to_numpy(zero_copy_only=False)
            label = batch.column(1).to_numpy(zero_copy_only=False)
            stats = batch.column(2).flatten().to_numpy().reshape(len(fold), -1) if len(fold) else np.zeros((0, len(STATISTICS)))
            both = np.hstack([base.features(stats), label[:, None]])
            for f in np.unique(fold):
                part = both[fold == f]
                sums[int(f)] = sums.get(int(f), 0) + part.T @ part
        if sums:
            fold_no = np.repeat(list(sums), width).astype(np.int32)
            row_no = np.tile(np.arange(width, dtype=np.int32), len(sums))
            yield pa.RecordBatch.from_arrays([pa.array(fold_no), pa.array(row_no), pa.array([r.tobytes() for m in sums.values() for r in m], pa.binary())], ["fold", "row_no", "part"])

    def total(key, part):
        import pyarrow as pa

        acc = sum((np.frombuffer(x, np.float64) for x in part.column("part").to_pylist()), np.zeros(width))
        return pa.table({"fold": pa.array([key[0].as_py()], pa.int32()), "row_no": pa.array([key[1].as_py()], pa.int32()), "part": pa.array([acc.tobytes()], pa.binary())})

    schema = "fold int, row_no int, part binary"
    parts = rows.select("fold", "label", "stats").mapInArrow(partition_sums, schema)
    out: dict[int, np.ndarray] = {}
    for r in parts.groupBy("fold", "row_no").applyInArrow(total, schema).collect():  # folds x width rows, whatever the input
        out.setdefault(r.fold, np.zeros((width, width)))[r.row_no] = np.frombuffer(bytes(r.part), np.float64)
    return out


def ridge(sums: np.ndarray, strength: float) -> np.ndarray:
    width = len(sums) - 1
    penalty = np.eye(width) * strength
    penalty[0, 0] = 1e-9
    return np.linalg.solve(sums[:width, :width] + penalty, sums[:width, width])


def isotonic(counts: np.ndarray, positives: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over the score grid; the mean score of each pool and its share of positives."""
    pools: list[list[float]] = []
    for n, p, c in zip(counts, positives, centers, strict=True):
        if n:
            pools.append([n, p, n * c])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([s / n for n, _, s in pools]), np.array([p / n for n, p, _ in pools])


def fit(stats: DataFrame, labels: DataFrame, waves: int = 256, bandwidth: float = 0.5, strength: float = 0.1, seed: int = 7, label_col: str = "quality") -> Model:
    """Fit on every labelled row outside fold 0.

    ``stats`` is the table of :func:`with_statistics`. A document with several label rows takes their mean;
    labels that are null or other than 0 and 1 are left out. Calibration uses scores that models fitted without
    the row's fold give, summed on a fixed grid. Without labels every score is 0.5, with one class it is that class.
    """
    d = len(STATISTICS)
    sums = stats.select(*[F.col("stats")[i].alias(f"s{i}") for i in range(d)]).agg(F.count("*").alias("n"), *[f(f"s{i}").alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("v", F.stddev_pop))]).first()
    center = np.array([sums[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([sums[f"v{i}"] or 0.0 for i in range(d)])
    scale[scale < 1e-9] = 1.0
    draw = np.random.default_rng(seed)
    base = Model(center, scale, draw.normal(size=(d, waves)) * bandwidth / np.sqrt(d), draw.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), np.zeros(1), np.full(1, 0.5))
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id").alias("label_id")).agg(F.avg(F.col(label_col).cast("double")).alias("label"))
    rows = stored(stats.join(marked, F.col("doc_id") == F.col("label_id")).select(fold_of().alias("fold"), "label", "stats").where("fold <> 0"), "labelled")
    by_fold = summed(rows, base)
    if not by_fold:
        return base
    whole = sum(by_fold.values())
    models = {f: ridge(whole - by_fold.get(f, 0), strength) for f in range(1, FOLDS)}

    def out_of_fold(batches):
        import pyarrow as pa

        for batch in batches:
            fold = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(fold):
                continue
            z = base.features(batch.column(2).flatten().to_numpy().reshape(len(fold), -1))
            raw = np.choose(fold - 1, [z @ models[f] for f in range(1, FOLDS)])
            cell = np.clip(np.rint((raw + 1) / 3 * GRID), 0, GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(1)], ["cell", "label"])

    counts, positives = np.zeros(GRID + 1), np.zeros(GRID + 1)
    cells = rows.mapInArrow(out_of_fold, "cell int, label double").groupBy("cell").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    for r in cells.collect():  # GRID + 1 rows at most
        counts[r.cell], positives[r.cell] = r.n, r.p
    knots, values = isotonic(counts, positives, np.arange(GRID + 1) / GRID * 3 - 1)
    return Model(center, scale, base.waves, base.phases, ridge(whole, strength), knots, values)


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and its calibrated score between 0 and 1."""

    def batch_rows(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                values = model.score(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(batch_rows, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 from ``threshold`` on).

    A null text is empty and is scored as such. Ids may be null (never held out, never labelled) or repeat; each
    row is scored by its own text. The statistics are written once to the checkpoint folder.
    """
    stats = stored(with_statistics(texts(docs, id_col, text_col)), "stats")
    model = fit(stats, labels, **options)
    held = F.col("doc_id").isNotNull() & (fold_of() == 0)
    return scored(stats, model).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_scores` predicts as 1, all columns unchanged.

    The texts are read a second time instead of being shuffled to meet their scores.
    """
    with scratch_tables(docs.sparkSession):
        model = fit(stored(with_statistics(texts(docs, id_col, text_col)), "stats"), labels, **options)

    def keep(batches):
        import pyarrow as pa

        for batch in small_batches(batches, text_col):
            text = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            good = model.score(np.stack([statistics(t or "") for t in text])) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
