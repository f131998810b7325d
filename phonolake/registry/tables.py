"""Aggregations, positions, samples, splits and pair builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolake.functions import phonetic as P
from phonolake.functions import text as X
from phonolake.operators import cleaning as C
from phonolake.operators import lexicon as G
from phonolake.operators import pairs as R
from phonolake.operators import sampling as S
from phonolake.operators.positions import ordered_index, shuffled_index
from phonolake.plans import tasks as PT
from phonolake.registry import sql as Q
from phonolake.registry.base import big, joint_key, query, r6, table, words_text
from phonolake.registry.scores import ARGMAX_SQL, guesses
from phonolake.registry.texts import LINES_SQL, docs, lines, sentence_pairs
from phonolake.session import ensure_checkpoint_dir
from phonolake.sources import html as HT

# --- aggregations ----------------------------------------------------------------------------

EDGES_SQL = f"""ew AS (SELECT doc_id, lang, {Q.words('lower(text)')} AS ws FROM documents),
 ex AS (SELECT lang, unnest(ws[:-2]) AS term, unnest(ws[2:]) AS related_term FROM ew),
 edges AS (SELECT DISTINCT term, lang, related_term, lang AS related_lang FROM ex
   WHERE regexp_matches(term, '^\\p{{L}}') AND regexp_matches(related_term, '^\\p{{L}}'))"""


def neighbours(spark, d):
    """Neighbouring words of a text as (term, lang, related_term, related_lang), once for each place."""
    words = X.split_words(F.lower("text"))
    spread = table(spark, d, "documents").select("lang", words.alias("w")).select(
        "lang",
        F.inline(
            F.zip_with(
                F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))),
                F.slice("w", 2, 1 << 30),
                lambda a, b: F.struct(a.alias("term"), b.alias("related_term")),
            )
        ),
    )
    letters = F.col("term").rlike(r"^\p{L}") & F.col("related_term").rlike(r"^\p{L}")
    return spread.filter(letters).select("term", "lang", "related_term", F.col("lang").alias("related_lang"))


def edges(spark, d):
    """Each neighbourhood of ``neighbours`` once."""
    return neighbours(spark, d).distinct()


@query(
    "group_to_set",
    """SELECT user_id, array_to_string(list_sort(list(event_type)), '|') AS listed, array_to_string(list_sort(list_distinct(list(event_type))), '|') AS members
    FROM events GROUP BY user_id""",
)
def group_to_set(spark, d):
    """List and set of the members of each key."""
    return S.group_to_set(table(spark, d, "events"), "user_id", "event_type").select("user_id", words_text("listed").alias("listed"), words_text("members").alias("members"))


@query(
    "set_size_stats",
    f"""WITH {EDGES_SQL}, s AS (SELECT term, count(DISTINCT related_term) AS n FROM edges GROUP BY term)
    SELECT max(n)::BIGINT AS largest, min(n)::BIGINT AS smallest, round(avg(n), 6) AS mean FROM s""",
)
def set_size_stats(spark, d):
    sizes = R.adjacency_pairs(edges(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n").alias("largest"), F.min("n").alias("smallest"), r6(F.avg("n")).alias("mean"))


@query("class_counts", "SELECT label::BIGINT AS label, count(*)::BIGINT AS n FROM embeddings GROUP BY 1")
def class_counts(spark, d):
    return S.class_counts(table(spark, d, "embeddings")).withColumn("label", big("label"))


@query("distinct_values", "SELECT count(DISTINCT event_type)::BIGINT AS kinds, count(DISTINCT user_id)::BIGINT AS users FROM events")
def distinct_values(spark, d):
    return table(spark, d, "events").agg(
        F.countDistinct("event_type").alias("kinds"), F.countDistinct("user_id").alias("users")
    )


@query(
    "balanced_class_weights",
    """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
    SELECT label::BIGINT AS label, n::BIGINT AS n, round(sum(n) OVER () / (count(*) OVER () * n)::DOUBLE, 6) AS weight FROM c""",
)
def balanced_class_weights(spark, d):
    out = S.balanced_class_weights(table(spark, d, "embeddings"))
    return out.select(big("label").alias("label"), "n", r6("weight").alias("weight"))


@query(
    "inverse_frequency_weights",
    "SELECT event_id, event_type, round(1.0::DOUBLE / count(*) OVER (PARTITION BY event_type), 9) AS weight FROM events",
)
def inverse_frequency_weights(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type")
    return S.inverse_frequency_weights(rows, "event_type").select("event_id", "event_type", F.round("weight", 9).alias("weight"))


@query(
    "word_totals_ratio",
    f"""WITH a AS (SELECT sum(len({Q.spaced('text')})) AS n FROM documents), b AS (SELECT sum(len({Q.spaced('text')})) AS n FROM conversations)
    SELECT a.n::BIGINT AS left_words, b.n::BIGINT AS right_words, round(a.n::DOUBLE / b.n, 6) AS ratio FROM a, b""",
)
def word_totals_ratio(spark, d):
    both = docs(spark, d).select("text", F.lit(1).alias("side")).unionByName(
        table(spark, d, "conversations").select("text", F.lit(2).alias("side"))
    )
    n = X.num_words(F.col("text"))
    left, right = (F.sum(F.when(F.col("side") == s, n)) for s in (1, 2))
    return both.agg(left.alias("left_words"), right.alias("right_words"), r6(left / right).alias("ratio"))


@query(
    "text_length_stats",
    """SELECT sum(len(string_split(text, ' ')))::BIGINT AS total, round(avg(len(string_split(text, ' '))), 6) AS mean,
    max(len(string_split(text, ' ')))::BIGINT AS longest FROM documents""",
)
def text_length_stats(spark, d):
    n = F.size(F.split("text", " ", -1))
    return docs(spark, d).select(n.alias("n")).agg(
        F.sum("n").alias("total"), r6(F.avg("n")).alias("mean"), big(F.max("n")).alias("longest")
    )


@query("index_bounds", "SELECT min(doc_id) AS smallest, max(doc_id) AS largest FROM labels")
def index_bounds(spark, d):
    return table(spark, d, "labels").agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest"))


# --- positions -------------------------------------------------------------------------------

@query(
    "alternate_rows",
    """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
    SELECT doc_id, pos::BIGINT AS pos FROM p WHERE pos % 2 = 0""",
)
def alternate_rows(spark, d):
    return S.alternate_rows(table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", big("pos").alias("pos"))


@query(
    "assign_batches",
    "SELECT doc_id, floor((row_number() OVER (ORDER BY doc_id) - 1) / 256)::BIGINT AS batch FROM labels",
)
def assign_batches(spark, d):
    return S.assign_batches(table(spark, d, "labels").select("doc_id"), "doc_id", 256)


@query(
    "pair_row_ids",
    """WITH a AS (SELECT doc_id, floor((row_number() OVER (ORDER BY doc_id) - 1) / 2)::BIGINT AS no, (row_number() OVER (ORDER BY doc_id) - 1) % 2 AS odd FROM labels)
    SELECT doc_id, l.label::BIGINT AS label, (2 * no + 1 - l.label)::BIGINT AS id FROM a, (VALUES (1), (0)) l(label) WHERE odd = 0""",
)
def pair_row_ids(spark, d):
    anchors = S.alternate_rows(table(spark, d, "labels").select("doc_id"), "doc_id")
    both = anchors.select("doc_id", F.expr("pos div 2").alias("no"), F.explode(F.array(F.lit(1), F.lit(0))).alias("label"))
    return R.pair_row_ids(both, "no").select("doc_id", big("label").alias("label"), big("id").alias("id"))


@query(
    "first_k_per_class",
    f"""SELECT label::BIGINT AS label, vec_id FROM embeddings WHERE {ARGMAX_SQL} = label
    QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5""",
)
def first_k_per_class(spark, d):
    """First five correctly predicted rows per class."""
    rows = S.first_k_per_class(guesses(spark, d).filter("pred = label"), "label", "vec_id", 5)
    return rows.select(big("label").alias("label"), "vec_id")


# --- sorts, samples, splits ------------------------------------------------------------------

@query(
    "seeded_shuffle",
    f"SELECT o_orderkey, (row_number() OVER (ORDER BY {Q.hash_bits(42, 'o_orderkey')}, o_orderkey) - 1)::BIGINT AS pos FROM orders",
)
def seeded_shuffle(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey")
    placed = shuffled_index(rows, 42, ["o_orderkey"])
    return S.seeded_shuffle(placed, ["o_orderkey"], 42).select("o_orderkey", big("pos").alias("pos"))


@query(
    "train_val_test_split",
    f"""WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY {Q.hash_bits(42, 'o_orderkey')}, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, {Q.split_case('pos', 'n', 0.2, 0.1)} AS split FROM p""",
)
def train_val_test_split(spark, d):
    return S.train_val_test_split(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 0.2, 0.1)


@query(
    "train_val_test_split_by_hash",
    f"""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN {Q.H('42:test', 'l_orderkey', 'l_linenumber')} < 0.2 THEN 'test'
    WHEN {Q.H('42:validation', 'l_orderkey', 'l_linenumber')} < 0.1 THEN 'validation' ELSE 'train' END AS split FROM lineitem""",
)
def train_val_test_split_by_hash(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    out = S.train_val_test_split(rows, ["l_orderkey", "l_linenumber"], 0.2, 0.1, exact=False)
    return out.withColumn("l_linenumber", big("l_linenumber"))


@query("sample_n", f"SELECT o_orderkey FROM orders ORDER BY {Q.hash_bits(42, 'o_orderkey')}, o_orderkey LIMIT 1000")
def sample_n(spark, d):
    return S.sample_n(table(spark, d, "orders").select("o_orderkey"), 1000, ["o_orderkey"])


@query(
    "cap_splits",
    f"""WITH p AS (SELECT o_orderkey, o_orderstatus AS split, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {Q.hash_bits(42, 'o_orderkey')}, o_orderkey) AS r FROM orders)
    SELECT o_orderkey, split FROM p WHERE (split = 'F' AND r <= 2000) OR (split = 'P' AND r <= 200)""",
)
def cap_splits(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("split"))
    return S.cap_splits(rows, {"F": 2000, "P": 200}, ["o_orderkey"])


@query(
    "oversample_classes",
    """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), b AS (SELECT n AS base FROM c WHERE label = 0),
    t AS (SELECT label, CASE WHEN label = 0 THEN 1 ELSE floor(base / n) END AS times FROM c, b)
    SELECT vec_id, label::BIGINT AS label, unnest(range(1, times::BIGINT + 1)) AS copy FROM embeddings JOIN t USING (label)""",
)
def oversample_classes(spark, d):
    out = S.oversample_classes(table(spark, d, "embeddings").select("vec_id", "label"))
    return out.select("vec_id", big("label").alias("label"), big("copy").alias("copy"))


@query(
    "weighted_sample_replacement",
    f"""WITH m AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {Q.hash_bits('42:order', 'event_id')}, event_id) - 1 AS member,
      count(*) OVER (PARTITION BY event_type) AS n FROM events),
    c AS (SELECT event_type, any_value(n) AS n, row_number() OVER (ORDER BY event_type) - 1 AS class, count(*) OVER () AS k FROM m GROUP BY event_type),
    dr AS (SELECT event_id AS draw, {Q.below('(SELECT max(k) FROM c)', '42:class', 'event_id')} AS class FROM events),
    pl AS (SELECT draw, event_type, {Q.below('n', '42:member', 'draw')} AS member FROM dr JOIN c USING (class))
    SELECT draw, event_type, event_id FROM pl JOIN m USING (event_type, member)""",
)
def weighted_sample_replacement(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type")
    return S.weighted_sample_replacement(rows, "event_id", "event_type").select("draw", "event_type", "event_id")


@query("head_n", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 10")
def head_n(spark, d):
    return S.head_n(docs(spark, d), 10, ["doc_id"])


# --- joins and pairs -------------------------------------------------------------------------

VERSE_SQL = f"""{LINES_SQL},
 vl AS (SELECT doc_id, line_no, line AS text, {Q.spaced('line')}[-1] AS last_word FROM lines),
 vw AS (SELECT last_word, {Q.phonemes('last_word')} AS ph FROM (SELECT DISTINCT last_word FROM vl WHERE last_word IS NOT NULL)),
 v AS (SELECT text, last_word, array_to_string(ph[-2:], ' ') AS ending,
   row_number() OVER (ORDER BY doc_id, line_no) - 1 AS pos FROM vl JOIN vw USING (last_word)),
 anchors AS (SELECT * FROM v WHERE pos % 2 = 0)"""


VERSE_KEY = ["doc_id", "line_no"]


def verses(spark, d):
    """Lines of the documents as verses, named by document and line."""
    return lines(spark, d).select(*VERSE_KEY, F.col("line").alias("text"))


def verse_lexicon(spark, d):
    last = verses(spark, d).select(X.last_word(F.col("text")).alias("word")).filter(F.col("word").isNotNull())
    return G.build_lexicon(last)


def placed_verses(spark, d):
    ended = G.with_ending(verses(spark, d), verse_lexicon(spark, d))
    ensure_checkpoint_dir(spark)
    return ordered_index(ended.select(*VERSE_KEY, "ending"), VERSE_KEY, "pos").checkpoint()


@query(
    "rhyme_groups",
    f"""WITH {VERSE_SQL} SELECT coalesce(ending, '') AS ending, (row_number() OVER (PARTITION BY ending ORDER BY v.pos) - 1)::BIGINT AS pos, v.pos::BIGINT AS verse_no,
    (count(*) OVER (PARTITION BY ending))::BIGINT AS n FROM v""",
)
def rhyme_groups(spark, d):
    numbered = placed_verses(spark, d).withColumnRenamed("pos", "verse_no")
    return R.rhyme_groups(numbered, "verse_no").select("ending", big("pos").alias("pos"), big("verse_no").alias("verse_no"), big("n").alias("n"))


POSITIVE_SQL = """two AS (SELECT ending, min(pos) AS m1 FROM v GROUP BY ending),
 sec AS (SELECT v.ending, min(pos) AS m2 FROM v JOIN two ON v.ending = two.ending AND v.pos <> two.m1 GROUP BY v.ending),
 positive AS (SELECT a.pos AS anchor, CASE WHEN m1 <> a.pos THEN m1 ELSE coalesce(m2, a.pos) END AS partner
   FROM anchors a JOIN two ON a.ending = two.ending LEFT JOIN sec ON a.ending = sec.ending)"""


@query("rhyme_positive_pairs", f"WITH {VERSE_SQL}, {POSITIVE_SQL} SELECT anchor::BIGINT AS anchor, partner::BIGINT AS partner FROM positive")
def rhyme_positive_pairs(spark, d):
    keys = placed_verses(spark, d)
    out = R.rhyme_positive_pairs(keys, keys.filter("pos % 2 = 0"), "pos")
    return out.select(big("anchor").alias("anchor"), big("partner").alias("partner"))


def negative_sql(seed: int | str = 42) -> str:
    return f"""en AS (SELECT ending, row_number() OVER (ORDER BY {Q.hash_bits(f'{seed}:endings', 'ending')}, ending) - 1 AS no, count(*) AS size, count(*) OVER () AS g FROM v GROUP BY ending),
 dr AS (SELECT a.pos AS anchor, en.no AS own, {Q.below('en.g - 1', f'{seed}:ending', 'a.pos')} AS k FROM anchors a JOIN en ON a.ending = en.ending WHERE en.g > 1),
 aim AS (SELECT anchor, CASE WHEN k >= own THEN k + 1 ELSE k END AS no FROM dr),
 mem AS (SELECT ending, pos, row_number() OVER (PARTITION BY ending ORDER BY {Q.hash_bits(f'{seed}:members', 'pos')}, pos) - 1 AS member FROM v),
 negative AS (SELECT aim.anchor, mem.pos AS partner FROM aim JOIN en ON aim.no = en.no JOIN mem ON mem.ending = en.ending
   AND mem.member = {Q.below('en.size', f'{seed}:member', 'aim.anchor')})"""


@query("rhyme_negative_pairs", f"WITH {VERSE_SQL}, {negative_sql()} SELECT anchor::BIGINT AS anchor, partner::BIGINT AS partner FROM negative")
def rhyme_negative_pairs(spark, d):
    keys = placed_verses(spark, d)
    out = R.rhyme_negative_pairs(keys, keys.filter("pos % 2 = 0"), "pos")
    return out.select(big("anchor").alias("anchor"), big("partner").alias("partner"))


RHYME_SQL = f"""{VERSE_SQL}, {POSITIVE_SQL}, {negative_sql()},
 both_pairs AS (SELECT anchor, partner, 1 AS label FROM positive UNION ALL SELECT anchor, partner, 0 FROM negative),
 rp AS (SELECT (anchor + 1 - label)::BIGINT AS id, a.text AS sentence1, b.text AS sentence2, label
   FROM both_pairs p JOIN v a ON a.pos = p.anchor JOIN v b ON b.pos = p.partner),
 rq AS (SELECT *, row_number() OVER (ORDER BY {Q.hash_bits(42, 'id')}, id) - 1 AS hpos, count(*) OVER () AS n FROM rp)"""


@query(
    "build_rhyme_pairs",
    f"WITH {RHYME_SQL} SELECT id, sentence1, sentence2, label::BIGINT AS label, {Q.split_case('hpos', 'n', 0.2, 0.1)} AS split FROM rq",
)
def build_rhyme_pairs(spark, d):
    out = PT.build_rhyme_pairs(verses(spark, d), verse_lexicon(spark, d), key=VERSE_KEY)
    return out.select(big("id").alias("id"), "sentence1", "sentence2", big("label").alias("label"), "split")


@query(
    "build_last_word_task",
    f"""WITH {RHYME_SQL}, t AS (SELECT id, sentence1, sentence2, {Q.spaced('sentence1')}[-1] AS label FROM rp WHERE label = 1),
    tq AS (SELECT *, row_number() OVER (ORDER BY {Q.hash_bits(42, 'id')}, id) - 1 AS hp, count(*) OVER () AS n FROM t)
    SELECT id, sentence1, sentence2, label, {Q.split_case('hp', 'n', 0.1, 0.1)} AS split FROM tq""",
)
def build_last_word_task(spark, d):
    pairs = PT.rhyme_pair_rows(verses(spark, d), verse_lexicon(spark, d), key=VERSE_KEY)
    return PT.build_last_word_task(pairs).withColumn("id", big("id"))


WORDLIST_SQL = f"""wl AS (SELECT DISTINCT unnest({Q.words('lower(text)')}) AS word FROM documents),
 words AS (SELECT word, row_number() OVER (ORDER BY {Q.hash_bits('words', 'word')}, word) - 1 AS word_id FROM wl WHERE regexp_matches(word, '^\\p{{L}}'))"""


def word_list(spark, d):
    """Distinct words of the documents, numbered in hash order."""
    ensure_checkpoint_dir(spark)
    words = G.corpus_words(docs(spark, d)).filter(F.col("word").rlike(r"^\p{L}")).checkpoint()
    return shuffled_index(words, "words", ["word"], out="word_id")


@query("near_spelling_pairs")
def near_spelling_pairs(spark, d):
    sound = F.array_join(P.apply_grapheme_rules(F.col("word")), "")
    return R.near_spelling_pairs(word_list(spark, d).select("word_id", "word", sound.alias("sound")))


@query(
    "group_all_pairs",
    """WITH g AS (SELECT p_partkey, string_split(p_name || ' ' || lower(p_brand) || ' ' || lower(p_type), ' ') AS ws FROM part),
    i AS (SELECT p_partkey, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM g)
    SELECT a.p_partkey, a.word AS word1, b.word AS word2 FROM i a JOIN i b ON a.p_partkey = b.p_partkey AND a.p < b.p""",
)
def group_all_pairs(spark, d):
    text = F.concat_ws(" ", "p_name", F.lower("p_brand"), F.lower("p_type"))
    groups = table(spark, d, "part").select("p_partkey", F.split(text, " ").alias("words"))
    return R.group_all_pairs(groups, "p_partkey")


@query("adjacency_pairs", f"WITH {EDGES_SQL} SELECT DISTINCT term, related_term FROM edges")
def adjacency_pairs(spark, d):
    return R.adjacency_pairs(edges(spark, d))


def unrelated_sql(source: str, seed: int | str = 42) -> str:
    return f"""rel AS (SELECT DISTINCT term, related_term FROM {source}),
 terms AS (SELECT term, row_number() OVER (ORDER BY {Q.hash_bits(f'{seed}:terms', 'term')}, term) - 1 AS no, count(*) OVER () AS t FROM (SELECT DISTINCT term FROM rel)),
 taken AS (SELECT rel.term, n.no AS c FROM rel JOIN terms n ON rel.related_term = n.term),
 steps AS (SELECT term, c - (row_number() OVER (PARTITION BY term ORDER BY c) - 1) AS step FROM taken),
 free AS (SELECT terms.term, t - coalesce(n, 0) AS f FROM terms LEFT JOIN (SELECT term, count(*) AS n FROM steps GROUP BY term) USING (term)),
 r1 AS (SELECT term, f, {Q.below('f', f'{seed}:first', 'term')} AS a, {Q.below('f - 1', f'{seed}:second', 'term')} AS b FROM free),
 dr AS (SELECT term, 1 AS k, a AS r FROM r1 WHERE f > 0 UNION ALL SELECT term, 2, CASE WHEN b >= a THEN b + 1 ELSE b END FROM r1 WHERE f > 1),
 pick AS (SELECT dr.term, k, r + count(step) FILTER (step <= r) AS no FROM dr LEFT JOIN steps USING (term) GROUP BY dr.term, k, r),
 unrel AS (SELECT pick.term, terms.term AS unrelated_term, k FROM pick JOIN terms ON pick.no = terms.no)"""


@query("sample_unrelated_pairs", f"WITH {EDGES_SQL}, {unrelated_sql('edges')} SELECT term, unrelated_term, k::BIGINT AS no FROM unrel")
def sample_unrelated_pairs(spark, d):
    return R.sample_unrelated_pairs(neighbours(spark, d)).withColumn("no", big("no"))


@query(
    "mispair_negatives",
    f"""WITH {EDGES_SQL}, p AS (SELECT DISTINCT term AS word1, related_term AS word2 FROM edges),
    q AS MATERIALIZED (SELECT word1, word2, row_number() OVER (ORDER BY {Q.hash_bits('42:pairs', 'word1', 'word2')}, word1, word2) - 1 AS no, count(*) OVER () AS n FROM p),
    dr AS (SELECT no, {Q.below('n', '42:i', 'no')} AS i, {Q.below('n - 1', '42:j', 'no')} AS j FROM q)
    SELECT dr.no::BIGINT AS no, a.word1, b.word2 FROM dr JOIN q a ON a.no = dr.i JOIN q b ON b.no = CASE WHEN dr.j >= dr.i THEN dr.j + 1 ELSE dr.j END""",
)
def mispair_negatives(spark, d):
    pairs = R.adjacency_pairs(neighbours(spark, d)).select(F.col("term").alias("word1"), F.col("related_term").alias("word2"))
    return R.mispair_negatives(pairs).withColumn("no", big("no"))


@query(
    "label_index_join",
    """WITH f AS (SELECT source, row_number() OVER (ORDER BY min(doc_id)) - 1 AS label FROM documents GROUP BY source)
    SELECT doc_id, source, label::BIGINT AS label FROM documents JOIN f USING (source)""",
)
def label_index_join(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source")
    labels = R.label_index(rows, "source", "doc_id")
    return C.lookup(rows, labels, ["source"], "inner").select("doc_id", "source", big("label").alias("label"))


@query(
    "positional_word_align",
    f"""WITH p AS (SELECT {Q.key('conv_id', 'turn')} AS idx, {Q.marks('text')} AS a,
       {Q.marks('lead(text) OVER (PARTITION BY conv_id ORDER BY turn)')} AS b FROM conversations),
    z AS (SELECT idx, a[:least(len(a), len(b))] AS a, b[:least(len(a), len(b))] AS b FROM p WHERE b IS NOT NULL)
    SELECT idx, (generate_subscripts(a, 1) - 1)::BIGINT AS pos, unnest(a) AS word1, unnest(b) AS word2 FROM z""",
)
def positional_word_align(spark, d):
    rows = sentence_pairs(spark, d)
    out = R.positional_word_align(
        rows, X.split_words_single_punct(F.col("sentence1")), X.split_words_single_punct(F.col("sentence2")), "idx"
    )
    return out.withColumn("pos", big("pos"))


SYNONYM_SQL = """parts AS (SELECT p_partkey AS row_id, list_filter(string_split(lower(p_name), ' '), lambda w: w <> '') AS w FROM part),
    listed AS (SELECT row_id, w[1] AS lemma, list_filter(w, lambda x, i: list_position(w, x) = i) AS own,
      list_filter(w[2:], lambda x, i: list_position(w[2:], x) = i) AS members, row_number() OVER (ORDER BY row_id) AS rn FROM parts),
    steps(rn, kept, seen) AS (SELECT 0::BIGINT, false, []::VARCHAR[] UNION ALL
      SELECT n.rn, NOT list_contains(seen, n.lemma), CASE WHEN list_contains(seen, n.lemma) THEN seen ELSE list_distinct(list_concat(seen, n.own)) END
      FROM steps JOIN listed n ON n.rn = steps.rn + 1),
    kept AS (SELECT listed.* FROM listed JOIN steps USING (rn) WHERE kept)"""


def synonym_rows(spark, d):
    """One row per part: the first word of its name as lemma, the others as synonyms, delimited by ``;`` and ``|`` in turn."""
    words = F.filter(F.split(F.lower("p_name"), " "), lambda w: w != "")
    mark = lambda w, i: F.concat(F.when(i == 0, "").when(i % 2 == 1, "; ").otherwise("|"), w)
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), words.alias("w"))
    others = F.when(F.size("w") > 1, F.array_join(F.transform(F.slice("w", 2, F.size("w")), mark), ""))
    return rows.select("row_id", F.try_element_at("w", F.lit(1)).alias("lemma"), others.alias("synonyms"))


@query(
    "greedy_disjoint_sets",
    f"WITH RECURSIVE {SYNONYM_SQL} SELECT row_id, lemma, array_to_string(members, '|') AS members FROM kept",
)
def greedy_disjoint_sets(spark, d):
    rows = synonym_rows(spark, d)
    members = F.array_distinct(X.split_delimited(F.coalesce("synonyms", F.lit(""))))
    kept = R.greedy_disjoint_sets(rows.select("row_id", "lemma", members.alias("members")))
    return kept.select(big("row_id").alias("row_id"), "lemma", F.array_join("members", "|").alias("members"))


@query(
    "build_synonym_task",
    f"""WITH RECURSIVE {SYNONYM_SQL},
    e AS (SELECT row_id, unnest(own) AS word, generate_subscripts(own, 1) AS i FROM kept),
    pos AS (SELECT a.word AS word1, b.word AS word2 FROM e a JOIN e b ON a.row_id = b.row_id AND a.i < b.i),
    num AS MATERIALIZED (SELECT word1, word2, row_number() OVER (ORDER BY {Q.hash_bits('42:pairs', 'word1', 'word2')}, word1, word2) - 1 AS no, count(*) OVER () AS n FROM pos),
    dr AS (SELECT no, {Q.below('n', '42:i', 'no')} AS i, {Q.below('n - 1', '42:j', 'no')} AS j FROM num),
    neg AS (SELECT a.word1, b.word2 FROM dr JOIN num a ON a.no = dr.i JOIN num b ON b.no = CASE WHEN dr.j >= dr.i THEN dr.j + 1 ELSE dr.j END),
    p AS (SELECT word1, word2, 1 AS label FROM pos UNION ALL SELECT word1, word2, 0 FROM neg),
    q AS (SELECT *, row_number() OVER (ORDER BY {Q.hash_bits(42, 'word1', 'word2', 'label')}, word1, word2, label) - 1 AS hp, count(*) OVER () AS n FROM p)
    SELECT word1, word2, label::BIGINT AS label, {Q.split_case('hp', 'n', 0.2, 0.1)} AS split FROM q""",
)
def build_synonym_task(spark, d):
    return PT.build_synonym_task(synonym_rows(spark, d)).withColumn("label", big("label"))


@query("build_homophone_task")
def build_homophone_task(spark, d):
    ensure_checkpoint_dir(spark)
    words = word_list(spark, d).checkpoint()
    lexicon = G.build_lexicon(words)
    # Word lists come from result pages, as in the extraction query.
    pages = HT.extract_html_groups(table(spark, d, "pages"), "ul", None, "a", None)
    groups = pages.select(F.struct("page_id", "group_no").alias("group_id"), "words")
    return PT.build_homophone_task(words, groups, lexicon).withColumn("label", big("label"))


@query(
    "build_etymology_task",
    f"""WITH {EDGES_SQL}, own AS (SELECT term, related_term FROM edges WHERE lang = 'en' AND related_lang = 'en'), {unrelated_sql('own')},
    p AS (SELECT DISTINCT * FROM (SELECT term AS word1, related_term AS word2, 1 AS label FROM rel UNION ALL SELECT term, unrelated_term, 0 FROM unrel)),
    q AS (SELECT *, row_number() OVER (ORDER BY {Q.hash_bits(42, 'word1', 'word2', 'label')}, word1, word2, label) - 1 AS hp, count(*) OVER () AS n FROM p WHERE word1 <> '' AND word2 <> '')
    SELECT word1, word2, label::BIGINT AS label, {Q.split_case('hp', 'n', 0.2, 0.1)} AS split FROM q""",
)
def build_etymology_task(spark, d):
    return PT.build_etymology_task(neighbours(spark, d)).withColumn("label", big("label"))


METER_SQL = f"""{LINES_SQL}, mv AS (SELECT {Q.key('doc_id', 'line_no')} AS id, doc_id, line_no, line AS Verse, source AS Meter FROM lines JOIN documents USING (doc_id)),
 ml AS (SELECT Meter, row_number() OVER (ORDER BY min((doc_id, line_no))) - 1 AS label FROM mv GROUP BY Meter),
 mq AS (SELECT id, Verse, Meter, label, row_number() OVER (ORDER BY {Q.hash_bits(42, 'id')}, id) - 1 AS hp, count(*) OVER () AS n FROM mv JOIN ml USING (Meter)),
 ms AS (SELECT id, Verse, Meter, label, {Q.split_case('hp', 'n', 0.2, 0.2)} AS split FROM mq),
 mc AS (SELECT label, count(*) AS n FROM ms WHERE split = 'train' GROUP BY label),
 mt AS (SELECT label, CASE WHEN label = 0 THEN 1 ELSE floor((SELECT n FROM mc WHERE label = 0) / n) END AS times FROM mc)"""


@query(
    "build_meter_task",
    f"""WITH {METER_SQL} SELECT id, Verse, Meter, label::BIGINT AS label, split, unnest(range(1, times::BIGINT + 1)) AS copy FROM ms JOIN mt USING (label) WHERE split = 'train'
    UNION ALL SELECT id, Verse, Meter, label, split, 1 FROM ms WHERE split <> 'train'""",
)
def build_meter_task(spark, d):
    source = table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("Meter"))
    rows = source.select("doc_id", "Meter", F.posexplode(F.split("text", "\n")).alias("line_no", "Verse"))
    meters = rows.select(joint_key("doc_id", "line_no").alias("id"), F.struct("doc_id", "line_no").alias("place"), "Verse", "Meter")
    out = PT.build_meter_task(meters, order_col="place")
    return out.select("id", "Verse", "Meter", big("label").alias("label"), "split", big("copy").alias("copy"))
