"""Labelled pair builders without quadratic joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonolake.functions.hashing import hash_below, hash_bits
from phonolake.functions.similarity import sequence_ratio
from phonolake.functions.text import is_capitalized
from phonolake.operators.positions import hashed_index, running_total, shuffled_index, with_hash_bits
from phonolake.operators.spelling import LONGEST_CUT, similar_words
from phonolake.session import ensure_checkpoint_dir


def grouped_index(df: DataFrame, groups: list[str], id_col: str, out: str = "pos", total: str | None = None) -> DataFrame:
    """Position by integer id inside each group, safe for groups of any size."""
    levels = ["_id40", "_id20"]
    keyed = df.withColumn("_id40", F.shiftright(id_col, 40)).withColumn("_id20", F.shiftright(id_col, 20))
    return running_total(keyed, levels, [F.col(id_col)], groups=groups, out=out, total=total).drop(*levels)


def rhyme_groups(verses: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(ending, pos, id, n)``: each group's members in id order, one row per member."""
    return grouped_index(verses.select("ending", id_col), ["ending"], id_col, total="n")


def rhyme_positive_pairs(verses: DataFrame, anchors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each anchor with the lowest other row of its ending, or with itself when it is alone.

    Only the two lowest ids of an ending matter. The rank limit is applied before the shuffle,
    so a hot ending sends two rows per map task.
    """
    by_id = W.partitionBy("ending").orderBy(id_col)
    two = verses.select("ending", id_col).withColumn("_rank", F.row_number().over(by_id)).filter("_rank <= 2")
    lowest = two.groupBy("ending").agg(
        F.min(F.when(F.col("_rank") == 1, F.col(id_col))).alias("_first"),
        F.min(F.when(F.col("_rank") == 2, F.col(id_col))).alias("_second"),
    )
    partner = F.when(F.col("_first") != F.col(id_col), F.col("_first")).otherwise(
        F.coalesce("_second", id_col)
    )
    return anchors.select("ending", id_col).join(lowest, "ending").select(
        F.col(id_col).alias("anchor"), partner.alias("partner")
    )


def ending_table(verses: DataFrame, seed: int | str = 42) -> DataFrame:
    """``(ending, ending_no, size, endings)`` with endings numbered in hash order."""
    sizes = verses.groupBy("ending").agg(F.count(F.lit(1)).alias("size"))
    return shuffled_index(sizes, f"{seed}:endings", ["ending"], out="ending_no", total="endings")


def rhyme_negative_pairs(
    verses: DataFrame, anchors: DataFrame, id_col: str = "doc_id", seed: int | str = 42
) -> DataFrame:
    """Each anchor with a random row of a different ending: uniform ending, then uniform member.

    The draw skips the anchor's own ending by shifting the index, so nothing is rejected. A
    corpus with a single ending gives no negative.
    """
    endings = ending_table(verses, seed)
    own = anchors.select("ending", F.col(id_col).alias("anchor")).join(
        endings.select("ending", F.col("ending_no").alias("_own"), "endings"), "ending"
    )
    draw = hash_below(F.col("endings") - 1, f"{seed}:ending", F.col("anchor"))
    aimed = own.filter("endings > 1").select(
        "anchor", (draw + F.when(draw >= F.col("_own"), 1).otherwise(0)).alias("ending_no")
    )
    members = shuffled_index(
        verses.select("ending", id_col), f"{seed}:members", [id_col], groups=["ending"], out="_member"
    )
    placed = aimed.join(endings.select("ending", "ending_no", "size"), "ending_no").select(
        "anchor", "ending", hash_below(F.col("size"), f"{seed}:member", F.col("anchor")).alias("_member")
    )
    return placed.join(members, ["ending", "_member"]).select("anchor", F.col(id_col).alias("partner"))


def pair_row_ids(pairs: DataFrame, anchor_no: str, label: str = "label", out: str = "id") -> DataFrame:
    """Two rows per anchor: the positive gets the even id, the negative the odd one."""
    return pairs.withColumn(out, 2 * F.col(anchor_no) + (1 - F.col(label)))


def _both_words():
    names = {"a.word_id": "id1", "b.word_id": "id2", "a.word": "word1", "b.word": "word2"}
    return [F.col(source).alias(name) for source, name in names.items()]


def _numbered_sounds(sized: DataFrame) -> DataFrame:
    """One row per word_id and word, with the least and greatest number of its sounds; equal sounds have one number."""
    sounds = sized.select("sound").distinct().dropna().withColumn("_no", F.monotonically_increasing_id()).checkpoint()
    # small numbers travel well: rows of a partition first, then the partition
    parts = max(1, sounds.rdd.getNumPartitions())
    no = F.col("_no").bitwiseAND(F.lit(2**33 - 1)) * parts + F.shiftright("_no", 33)
    numbered = sized.join(sounds.select("sound", no.alias("_no")), "sound").dropna(subset=["word_id"])
    return numbered.groupBy("n", "word_id", "word").agg(F.min("_no").alias("low"), F.max("_no").alias("high"))


def _long_spelling_candidates(sized: DataFrame) -> DataFrame:
    """Candidates among words above 60 letters.

    They are cut in 2k + 1 segments of which one survives intact, shifted by at most k; the
    shared-character count then thins the candidates before the similarity call.
    """
    long = sized.filter(F.col("n") > LONGEST_CUT)
    pieces = F.col("k") * 2 + 1
    start = lambda i: F.floor(i * F.col("n") / pieces).cast("int")
    segments = F.transform(
        F.sequence(F.lit(0), pieces - 1),
        lambda i: F.struct(
            i.alias("seg"), start(i).alias("at"), F.substr("word", start(i) + 1, start(i + 1) - start(i)).alias("key")
        ),
    )
    whole = long.select("word_id", "word", "sound", "n", F.inline(segments))
    shifted = F.flatten(
        F.transform(
            segments,
            lambda s: F.transform(
                F.filter(
                    F.sequence(s["at"] - F.col("k"), s["at"] + F.col("k")),
                    lambda p: (p >= 0) & (p + F.length(s["key"]) <= F.col("n")),
                ),
                lambda p: F.struct(s["seg"].alias("seg"), F.substr("word", p + 1, F.length(s["key"])).alias("key")),
            ),
        )
    )
    moved = long.select("word_id", "word", "sound", "n", "k", F.explode(F.array_distinct(shifted)).alias("s"))
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    bag_gap = F.size(F.array_except(letters(F.col("a.word")), letters(F.col("b.word"))))
    found = whole.alias("a").join(
        moved.alias("b"),
        (F.col("a.n") == F.col("b.n"))
        & (F.col("a.seg") == F.col("b.s.seg"))
        & (F.col("a.key") == F.col("b.s.key"))
        & (F.col("a.word_id") < F.col("b.word_id"))
        & (F.col("a.sound") != F.col("b.sound"))
        & (bag_gap <= F.col("b.k")),
    ).select(*_both_words())
    return found.distinct()


def near_spelling_pairs(words: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs that look alike but sound different; ``words`` has word_id, word, sound.

    A ratio above 0.8 leaves at most k = ceil(0.2 * length) - 1 characters of each word unmatched,
    so both words share a subsequence of ``length - k`` characters. Up to k = 3 (20 letters)
    words meet by that subsequence (``spelling.similar_words``): few words can share one, so no
    group can grow with the table. Longer words meet by a segment, above 60 letters in a join.
    Pairs are ordered by ``word_id``, the position in the word list.
    """
    ensure_checkpoint_dir(words.sparkSession)
    sized = (
        words.select("word_id", "word", "sound", F.length("word").alias("n"))
        .withColumn("k", (F.ceil(F.round(F.col("n") * 0.2, 6)) - 1).cast("int"))
        .filter("k >= 1")
        .checkpoint()
    )
    short = _numbered_sounds(sized.filter(F.col("n") <= LONGEST_CUT)).checkpoint()
    candidates = _long_spelling_candidates(sized)
    long = candidates.filter(sequence_ratio(F.col("word1"), F.col("word2")) > threshold).select("word1", "word2")
    return similar_words(short, threshold).unionByName(long)


def group_all_pairs(groups: DataFrame, id_col: str, items: str = "words") -> DataFrame:
    """All pairs of the items on one row, in list order. Each row is one short list of the input."""
    anchors = groups.select(id_col, F.col(items).alias("_items"), F.posexplode(items).alias("_p", "word1"))
    rest = F.slice("_items", F.col("_p") + 2, F.greatest(F.size("_items") - F.col("_p") - 1, F.lit(0)))
    return anchors.select(id_col, "word1", F.explode(rest).alias("word2"))


def adjacency_pairs(edges: DataFrame) -> DataFrame:
    """Distinct (term, related term); edges with a null end are dropped as grouping does."""
    return edges.select("term", "related_term").dropna(subset=["term"]).distinct()


def sample_unrelated_pairs(edges: DataFrame, seed: int | str = 42) -> DataFrame:
    """Two distinct random terms per term, neither related to it; the term itself is allowed.

    Nothing is rejected: draw r among the unrelated terms only, then step over the related ones.
    With a term's related numbers sorted as c_0 < c_1 < ..., the r-th unrelated number is
    r + count(i: c_i - i <= r), which is an ordinary partial aggregate. Terms with fewer than
    two unrelated terms get what there is.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    related = adjacency_pairs(edges).checkpoint()
    numbered = shuffled_index(
        related.select("term").distinct().checkpoint(), f"{seed}:terms", ["term"], out="term_no", total="terms"
    ).checkpoint()
    names = numbered.select(F.col("term_no").alias("_no"), F.col("term").alias("unrelated_term"))
    taken = related.join(numbered.select(F.col("term").alias("related_term"), F.col("term_no").alias("_c")), "related_term")
    # both are read more than once: a position reads its rows twice
    steps = grouped_index(taken.select("term", "_c").checkpoint(), ["term"], "_c", out="_i").select(
        "term", (F.col("_c") - F.col("_i")).alias("_step")
    ).checkpoint()
    degree = steps.groupBy("term").agg(F.count(F.lit(1)).alias("_degree"))
    free = F.col("terms") - F.coalesce("_degree", F.lit(0))
    first = hash_below(F.col("_free"), f"{seed}:first", F.col("term"))
    second = hash_below(F.col("_free") - 1, f"{seed}:second", F.col("term"))
    draws = (
        numbered.join(degree, "term", "left")
        .withColumn("_free", free)
        .withColumn("_r1", first)
        .withColumn("_r2", second + F.when(second >= F.col("_r1"), 1).otherwise(0))
        .select("term", "_free", F.posexplode(F.array("_r1", "_r2")).alias("_k", "_r"))
        .filter(F.col("_free") > F.col("_k"))
    )
    hit = (
        draws.join(steps, "term", "left")
        .groupBy("term", "_k", "_r")
        .agg(F.count_if(F.col("_step") <= F.col("_r")).alias("_over"))
    )
    return hit.select("term", (F.col("_k") + 1).alias("no"), (F.col("_r") + F.col("_over")).alias("_no")).join(
        names, "_no"
    ).select("term", "unrelated_term", "no")


def mispair_negatives(pairs: DataFrame, seed: int | str = 42) -> DataFrame:
    """As many (first of pair i, second of pair j) as pairs, with i and j drawn and i != j."""
    ensure_checkpoint_dir(pairs.sparkSession)
    hashed = with_hash_bits(pairs.select("word1", "word2"), f"{seed}:pairs", ["word1", "word2"]).checkpoint()
    numbered = hashed_index(hashed, ["word1", "word2"], out="no", total="n").checkpoint()
    i = hash_below(F.col("n"), f"{seed}:i", F.col("no"))
    j = hash_below(F.col("n") - 1, f"{seed}:j", F.col("no"))
    # no draw is null; said so, and in a step of its own, each is computed once: a key that may be null is first
    # tested in a filter, which computes it again
    drawn = numbered.filter("n > 1").select("no", F.coalesce(i, F.lit(0)).alias("i"), F.coalesce(j, F.lit(0)).alias("_j"))
    drawn = drawn.select("no", "i", (F.col("_j") + F.when(F.col("_j") >= F.col("i"), 1).otherwise(0)).alias("j"))
    firsts = numbered.select(F.col("no").alias("i"), "word1")
    seconds = numbered.select(F.col("no").alias("j"), "word2")
    return drawn.join(firsts, "i").join(seconds, "j").select("no", "word1", "word2")


def label_index(df: DataFrame, name: str, order: str) -> DataFrame:
    """``(name, label)`` with labels in order of first appearance; one row per class."""
    firsts = df.groupBy(name).agg(F.min(order).alias("_first"))
    return firsts.select(name, (F.row_number().over(W.orderBy("_first")) - 1).alias("label"))


def positional_word_align(df: DataFrame, left, right, id_col: str = "doc_id") -> DataFrame:
    """Word i of one text next to word i of the other, up to the shorter text; no join needed."""
    words = df.select(id_col, left.alias("_a"), right.alias("_b"))
    n = F.least(F.size("_a"), F.size("_b"))
    zipped = F.arrays_zip(F.slice("_a", F.lit(1), n).alias("word1"), F.slice("_b", F.lit(1), n).alias("word2"))
    return words.select(id_col, F.posexplode(zipped).alias("pos", "w")).select(id_col, "pos", "w.*")


def greedy_disjoint_sets(rows: DataFrame) -> DataFrame:
    """Rows kept by the sequential rule: skip a row whose lemma an earlier kept row mentions.

    ``rows`` has row_id, lemma (may be null: never skipped) and members. A row is decided as soon
    as every earlier row mentioning its lemma is decided; each round decides the first open row at
    least, and rounds repeat until none is open. State is checkpointed per round so that a lost
    executor costs one round at most. Runs jobs while it is called.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    started = rows.select("row_id", "lemma").filter(F.col("lemma").isNull() | ~is_capitalized(F.col("lemma")))
    own = F.when(F.col("lemma").isNotNull(), F.array("lemma")).otherwise(F.array().cast("array<string>"))
    mentions = (
        rows.select("row_id", F.explode(F.array_distinct(F.concat("members", own))).alias("word"))
        .join(started.select("row_id"), "row_id", "left_semi")
        .join(started.select(F.col("lemma").alias("word")).distinct(), "word", "left_semi")
        .checkpoint()
    )
    state = started.withColumn(
        "state", F.when(F.col("lemma").isNull(), F.lit("kept")).otherwise(F.lit("open"))
    ).checkpoint()
    while True:
        seen = (
            mentions.join(state.filter("state != 'dropped'").select("row_id", "state"), "row_id")
            .groupBy(F.col("word").alias("lemma"))
            .agg(
                F.min(F.when(F.col("state") == "kept", F.col("row_id"))).alias("kept_at"),
                F.min(F.when(F.col("state") == "open", F.col("row_id"))).alias("open_at"),
            )
        )
        earlier_kept = F.coalesce(F.col("kept_at") < F.col("row_id"), F.lit(False))
        earlier_open = F.coalesce(F.col("open_at") < F.col("row_id"), F.lit(False))
        state = (
            state.join(seen, "lemma", "left")
            .select(
                "row_id",
                "lemma",
                F.when(F.col("state") != "open", F.col("state"))
                .when(earlier_kept, "dropped")
                .when(~earlier_open, "kept")
                .otherwise("open")
                .alias("state"),
            )
            .checkpoint()
        )
        if state.filter("state = 'open'").isEmpty():
            break
    return rows.join(state.filter("state = 'kept'").select("row_id"), "row_id", "left_semi")
