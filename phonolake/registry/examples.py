"""Encoding, padding and masking queries.

Word-level queries use the most frequent words as vocabulary. Piece queries use short letter
sequences, so that words have several tokens.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolake.functions import text as X
from phonolake.operators import encoding as E
from phonolake.operators import masking as M
from phonolake.operators import vocabulary as V
from phonolake.plans import examples as PE
from phonolake.registry import sql as Q
from phonolake.registry.base import big, ints_text, joint_key, query, r6, table
from phonolake.registry.texts import CONV_TURNS_SQL, docs, sentence_pairs
from phonolake.session import ensure_checkpoint_dir

SPECIAL = V.special_ids()
SIZE = 2000
CLS, SEP, PAD, MASK, UNK = (SPECIAL[t] for t in ("[CLS]", "[SEP]", "[PAD]", "[MASK]", "[UNK]"))


def counts(spark, d):
    """Counts of words and single marks over documents."""
    return V.word_frequencies(docs(spark, d), splitter=X.split_words_single_punct, normalize=False)


def vocab(spark, d):
    """A vocabulary is a stored artifact of at most its size, so it is checkpointed."""
    ensure_checkpoint_dir(spark)
    return V.vocab_wordlevel(counts(spark, d), SIZE).checkpoint()


SPECIALS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS token, {i} AS id" for t, i in SPECIAL.items())
VOCAB_SQL = f"""freq AS (SELECT word, count(*) AS n FROM (SELECT unnest({Q.marks('text')}) AS word FROM documents) GROUP BY word),
 vocab AS ({SPECIALS_SQL} UNION ALL SELECT word, {len(SPECIAL) - 1} + row_number() OVER (ORDER BY n DESC, word)
   FROM (SELECT * FROM freq ORDER BY n DESC, word LIMIT {SIZE - len(SPECIAL)}))"""

# Per document the list of word-level ids.
IDS_SQL = f"""{VOCAB_SQL}, tw AS (SELECT doc_id, unnest({Q.marks('text')}) AS word, generate_subscripts({Q.marks('text')}, 1) AS pos FROM documents),
 di AS (SELECT doc_id, list(coalesce(vocab.id, {UNK}) ORDER BY pos) AS ids FROM tw LEFT JOIN vocab ON vocab.token = tw.word GROUP BY doc_id),
 docids AS (SELECT d.doc_id, coalesce(ids, []) AS ids FROM documents d LEFT JOIN di ON d.doc_id = di.doc_id)"""


def txt(values: str) -> str:
    return f"coalesce(array_to_string({values}, ','), '')"


def single_sql(length: int) -> str:
    return f"list_concat(list_concat([{CLS}], ids[1:{length - 2}]), [{SEP}])"


def singles(spark, d, length: int = 128):
    return PE.single_examples(docs(spark, d), E.word_ids(vocab(spark, d)), SPECIAL, length)


@query("encode_single", f"WITH {IDS_SQL} SELECT doc_id, {txt(single_sql(128))} AS input_ids FROM docids")
def encode_single(spark, d):
    return singles(spark, d).select("doc_id", ints_text("input_ids").alias("input_ids"))


@query("token_length_stats", f"""WITH {IDS_SQL}, n AS (SELECT len({single_sql(512)}) AS n FROM docids)
    SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, max(n)::BIGINT AS longest FROM n""")
def token_length_stats(spark, d):
    n = singles(spark, d, 512).select(F.size("input_ids").alias("n"))
    return n.agg(r6(F.avg("n")).alias("mean"), r6(F.percentile("n", F.lit(0.5))).alias("median"), big(F.max("n")).alias("longest"))


PAIR_IDS_SQL = f"""{VOCAB_SQL}, {CONV_TURNS_SQL},
 pw AS (SELECT idx, 1 AS f, unnest({Q.marks('sentence1')}) AS word, generate_subscripts({Q.marks('sentence1')}, 1) AS pos FROM pairs
   UNION ALL SELECT idx, 2, unnest({Q.marks('sentence2')}), generate_subscripts({Q.marks('sentence2')}, 1) FROM pairs),
 pi AS (SELECT idx, list(coalesce(vocab.id, {UNK}) ORDER BY pos) FILTER (f = 1) AS a, list(coalesce(vocab.id, {UNK}) ORDER BY pos) FILTER (f = 2) AS b
   FROM pw LEFT JOIN vocab ON vocab.token = pw.word GROUP BY idx),
 pairids AS (SELECT pairs.idx, coalesce(a, []) AS a, coalesce(b, []) AS b FROM pairs LEFT JOIN pi ON pairs.idx = pi.idx)"""


def cut_sql(budget: int) -> str:
    half = budget // 2
    return f"""cut AS (SELECT idx, a, b, CASE WHEN len(a) + len(b) <= {budget} THEN len(a) WHEN least(len(a), len(b)) > {budget} - least(len(a), len(b))
     THEN CASE WHEN len(a) <= len(b) THEN {half} ELSE {budget - half} END
     WHEN len(a) <= len(b) THEN len(a) ELSE {budget} - len(b) END AS na,
   CASE WHEN len(a) + len(b) <= {budget} THEN len(b) WHEN least(len(a), len(b)) > {budget} - least(len(a), len(b))
     THEN CASE WHEN len(a) <= len(b) THEN {budget - half} ELSE {half} END
     WHEN len(a) <= len(b) THEN {budget} - len(a) ELSE len(b) END AS nb FROM pairids),
 enc AS (SELECT idx, na, nb, list_concat(list_concat(list_concat(list_concat([{CLS}], a[1:na]), [{SEP}]), b[1:nb]), [{SEP}]) AS ids FROM cut)"""


@query(
    "encode_pair",
    f"""WITH {PAIR_IDS_SQL}, {cut_sql(125)} SELECT idx, {txt('ids')} AS input_ids,
    {txt('list_transform(range(len(ids)), lambda i: CASE WHEN i < na + 2 THEN 0 ELSE 1 END)')} AS token_type_ids FROM enc""",
)
def encode_pair(spark, d):
    out = PE.pair_examples(sentence_pairs(spark, d), E.word_ids(vocab(spark, d)), SPECIAL, ("sentence1", "sentence2"), 128, "idx")
    return out.select("idx", *[ints_text(c).alias(c) for c in ("input_ids", "token_type_ids")])


def pad_sql(values: str, size: str, fill: int) -> str:
    return f"list_concat({values}, list_transform(range(greatest({size} - len({values}), 0)), lambda i: {fill}))"


@query(
    "pad_fixed",
    f"""WITH {IDS_SQL}, s AS (SELECT doc_id, {single_sql(128)} AS v FROM docids)
    SELECT doc_id, {txt(pad_sql('v', '128', PAD))} AS input_ids, {txt('list_transform(range(128), lambda i: CASE WHEN i < len(v) THEN 1 ELSE 0 END)')} AS attention_mask FROM s""",
)
def pad_fixed(spark, d):
    out = E.pad_fixed(singles(spark, d), SPECIAL, 128)
    return out.select("doc_id", *[ints_text(c).alias(c) for c in ("input_ids", "attention_mask")])


@query(
    "pad_dynamic",
    f"""WITH {IDS_SQL}, s AS (SELECT doc_id, {single_sql(128)} AS v, floor(doc_id / 32)::BIGINT AS batch FROM docids), m AS (SELECT *, max(len(v)) OVER (PARTITION BY batch) AS w FROM s)
    SELECT doc_id, batch, {txt(pad_sql('v', 'w', PAD))} AS input_ids FROM m""",
)
def pad_dynamic(spark, d):
    batched = singles(spark, d).withColumn("batch", F.expr("doc_id div 32"))
    return E.pad_dynamic(batched, SPECIAL).select("doc_id", "batch", ints_text("input_ids").alias("input_ids"))


@query(
    "decode_ids",
    f"""WITH {IDS_SQL}, s AS (SELECT doc_id, {single_sql(128)} AS v FROM docids), u AS (SELECT doc_id, unnest(v) AS id, generate_subscripts(v, 1) AS pos FROM s),
    g AS (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS text FROM u JOIN vocab USING (id) WHERE id NOT IN ({CLS}, {SEP}) GROUP BY doc_id)
    SELECT s.doc_id, coalesce(text, '') AS text FROM s LEFT JOIN g ON s.doc_id = g.doc_id""",
)
def decode_ids(spark, d):
    return E.decode_ids(singles(spark, d), vocab(spark, d), skip=[CLS, SEP])


def kind_sql(draw: str) -> str:
    return f"CASE WHEN {draw} < 0.8 THEN 1 WHEN {draw} < 0.9 THEN 2 ELSE 3 END"


def mlm_sql(values: str, row: str, size: int = SIZE) -> tuple[str, str]:
    """Masked ids and labels of a 128-wide list in ``u(row, i, x)`` form."""
    picked = f"(x NOT IN ({', '.join(str(v) for v in SPECIAL.values())}) AND {Q.H('42:pick', row, 'i')} < 0.15)"
    kind = f"CASE WHEN {picked} THEN {kind_sql(Q.H('42:kind', row, 'i'))} ELSE 0 END"
    return kind, f"CASE k WHEN 1 THEN {MASK} WHEN 2 THEN {Q.below(str(size), '42:token', row, 'i')} ELSE x END"


_KIND, _NEW = mlm_sql("v", "doc_id")


@query(
    "mlm_mask",
    f"""WITH {IDS_SQL}, s AS (SELECT doc_id, {single_sql(128)} AS v FROM docids), u AS (SELECT doc_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM s),
    k AS (SELECT doc_id, i, x, {_KIND} AS k FROM u)
    SELECT doc_id, string_agg({_NEW}, ',' ORDER BY i) AS input_ids, string_agg(CASE WHEN k > 0 THEN x ELSE -100 END, ',' ORDER BY i) AS labels FROM k GROUP BY doc_id""",
)
def mlm_mask(spark, d):
    masked = M.mlm_mask(F.col("input_ids"), F.col("doc_id"), SPECIAL, SIZE)
    return singles(spark, d).select("doc_id", masked.alias("m")).select(
        "doc_id", ints_text("m.input_ids").alias("input_ids"), ints_text("m.labels").alias("labels")
    )


@query(
    "mask_target_before_sep",
    f"""WITH {PAIR_IDS_SQL}, {cut_sql(125)}, u AS (SELECT idx, na, unnest(ids) AS x, generate_subscripts(ids, 1) - 1 AS i FROM enc),
    t AS (SELECT idx, len({Q.marks(Q.spaced('sentence1') + '[-1]')}) AS n FROM pairs),
    m AS (SELECT idx, i, x, (na + 1 - n >= 0 AND i >= na + 1 - n AND i < na + 1) AS inside FROM u JOIN t USING (idx))
    SELECT idx, string_agg(CASE WHEN inside THEN {MASK} ELSE x END, ',' ORDER BY i) AS input_ids, string_agg(CASE WHEN inside THEN x ELSE -100 END, ',' ORDER BY i) AS labels FROM m GROUP BY idx""",
)
def mask_target_before_sep(spark, d):
    rows = sentence_pairs(spark, d).withColumn("label", X.last_word(F.col("sentence1"))).filter("label is not null")
    out = PE.last_word_examples(rows, E.word_ids(vocab(spark, d)), SPECIAL, 128, "idx")
    return out.select("idx", ints_text("input_ids").alias("input_ids"), ints_text("labels").alias("labels"))


def dual(spark, d, inverse=False):
    """Sentence pairs as original and second text."""
    rows = sentence_pairs(spark, d).select("idx", F.col("sentence1").alias("original_text"), F.col("sentence2").alias("text"))
    table_ = E.word_ids(vocab(spark, d))
    return PE.dual_examples(rows, table_, table_, SPECIAL, inverse, 128, "idx")


def one_side(name: str) -> str:
    return f"list_concat(list_concat([{CLS}], {name}[1:126]), [{SEP}])"


@query(
    "dual_encode",
    f"""WITH {PAIR_IDS_SQL}, s AS (SELECT idx, {one_side('a')} AS a, {one_side('b')} AS b FROM pairids)
    SELECT idx, {txt(pad_sql('b', '128', PAD))} AS teacher_input_ids, {txt(pad_sql('a', '128', PAD))} AS student_input_ids,
    list_sum(list_transform(b, lambda x: 1))::BIGINT AS teacher_tokens, list_sum(list_transform(a, lambda x: 1))::BIGINT AS student_tokens FROM s""",
)
def dual_encode(spark, d):
    """The inverse direction: the second text teaches the original one."""
    total = lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + x).cast("bigint")
    return dual(spark, d, inverse=True).select(
        "idx", ints_text("teacher_input_ids").alias("teacher_input_ids"), ints_text("student_input_ids").alias("student_input_ids"),
        total(F.col("teacher_attention_mask")).alias("teacher_tokens"), total(F.col("student_attention_mask")).alias("student_tokens"),
    )


_KIND_D, _NEW_D = mlm_sql("v", "idx")


@query(
    "collate_mlm_dual",
    f"""WITH {PAIR_IDS_SQL}, s AS (SELECT idx, {pad_sql(one_side('a'), '128', PAD)} AS t, {pad_sql(one_side('b'), '128', PAD)} AS v FROM pairids),
    u AS (SELECT idx, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM s), k AS (SELECT idx, i, x, {_KIND_D} AS k FROM u),
    g AS (SELECT idx, string_agg({_NEW_D}, ',' ORDER BY i) AS student_input_ids, string_agg(CASE WHEN k > 0 THEN x ELSE -100 END, ',' ORDER BY i) AS labels FROM k GROUP BY idx)
    SELECT idx, {txt('t')} AS teacher_input_ids, student_input_ids, labels FROM s JOIN g USING (idx)""",
)
def collate_mlm_dual(spark, d):
    out = PE.collate_dual(dual(spark, d), SPECIAL, SIZE, id_col="idx")
    return out.select("idx", *[ints_text(c).alias(c) for c in ("teacher_input_ids", "student_input_ids", "labels")])


# --- pieces ----------------------------------------------------------------------------------

PIECES = 3000


def piece_vocab(spark, d):
    """Specials, then the most frequent letter sequences of 1 to 4 characters of all words.

    Sequences inside a word carry the continuation prefix.
    """
    words = counts(spark, d)
    n = F.length("word")
    spans = words.select("word", "n", F.explode(F.sequence(F.lit(1), n)).alias("at")).select(
        "word", "n", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(4), n - F.col("at") + 1))).alias("len")
    )
    piece = F.substr("word", F.col("at"), F.col("len"))
    marked = spans.select("n", F.when(F.col("at") == 1, piece).otherwise(F.concat(F.lit("##"), piece)).alias("word"))
    ensure_checkpoint_dir(spark)
    return V.vocab_wordlevel(marked.groupBy("word").agg(F.sum("n").alias("n")), PIECES).checkpoint()


PIECE_SQL = f"""freq AS (SELECT word, count(*) AS n FROM (SELECT unnest({Q.marks('text')}) AS word FROM documents) GROUP BY word),
 p1 AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS at_ FROM freq), p2 AS (SELECT word, n, at_, unnest([1, 2, 3, 4]) AS len_ FROM p1),
 p3 AS (SELECT CASE WHEN at_ = 1 THEN '' ELSE '##' END || substr(word, at_, len_) AS word, sum(n) AS n FROM p2 WHERE at_ + len_ - 1 <= length(word) GROUP BY 1),
 vocab AS ({SPECIALS_SQL} UNION ALL SELECT word, {len(SPECIAL) - 1} + row_number() OVER (ORDER BY n DESC, word)
   FROM (SELECT * FROM p3 ORDER BY n DESC, word LIMIT {PIECES - len(SPECIAL)}))"""


def walk_sql(source: str) -> str:
    """Greedy longest match of each distinct word of ``source(word)``, as ``wids(word, ids)``."""
    return f"""walk AS (
   SELECT word, 1 AS at_, []::INTEGER[] AS ids, false AS bad FROM (SELECT DISTINCT word FROM {source}) WHERE length(word) <= {E.LONGEST_WORD}
   UNION ALL
   SELECT w.word, w.at_ + coalesce(b.len_, 1000), CASE WHEN b.id IS NULL THEN w.ids ELSE list_append(w.ids, b.id) END, b.id IS NULL
   FROM walk w LEFT JOIN best b ON b.word = w.word AND b.at_ = w.at_ WHERE NOT w.bad AND w.at_ <= length(w.word)),
 wids AS (SELECT s.word, coalesce(ids, [{UNK}]) AS ids FROM (SELECT DISTINCT word FROM {source}) s
   LEFT JOIN (SELECT word, ids FROM walk WHERE NOT bad AND at_ = length(word) + 1) k ON s.word = k.word)"""


def best_sql(source: str) -> str:
    return f"""cand AS (SELECT word, at_, unnest([1, 2, 3, 4, 5, 6]) AS len_ FROM (SELECT word, unnest(range(1, length(word) + 1)) AS at_ FROM (SELECT DISTINCT word FROM {source}))),
 best AS (SELECT c.word, at_, max(len_) AS len_, arg_max(vocab.id, len_) AS id FROM cand c
   JOIN vocab ON vocab.token = CASE WHEN at_ = 1 THEN '' ELSE '##' END || substr(c.word, at_, len_) WHERE at_ + len_ - 1 <= length(c.word) GROUP BY c.word, at_)"""


def piece_table(spark, d, words):
    return E.encode_words(words, piece_vocab(spark, d), UNK)


@query("encode_words", f"WITH RECURSIVE {PIECE_SQL}, {best_sql('freq')}, {walk_sql('freq')} SELECT word, {txt('ids')} AS ids FROM wids")
def encode_words(spark, d):
    return piece_table(spark, d, counts(spark, d)).select("word", ints_text("ids").alias("ids"))


CONV_WORDS_SQL = f"""cw AS (SELECT {Q.key('conv_id', 'turn')} AS idx, {Q.marks('text')} AS ws FROM conversations),
 ct AS (SELECT idx, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM cw)"""


@query(
    "word_token_offsets",
    f"""WITH RECURSIVE {PIECE_SQL}, {CONV_WORDS_SQL}, {best_sql('ct')}, {walk_sql('ct')},
    o AS (SELECT idx, pos, len(ids) AS n, coalesce(sum(len(ids)) OVER (PARTITION BY idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ct JOIN wids USING (word))
    SELECT idx, pos::BIGINT AS pos, start::BIGINT AS start FROM o""",
)
def word_token_offsets(spark, d):
    rows = table(spark, d, "conversations").select(joint_key("conv_id", "turn").alias("idx"), "text")
    words = rows.select(F.explode(X.split_words_single_punct(F.col("text"))).alias("word"))
    ids = E.encode_texts(rows, piece_table(spark, d, words), UNK, {"text": "w"}, "idx")
    out = ids.select("idx", F.posexplode(E.word_token_offsets(F.col("w"))).alias("pos", "start"))
    return out.select("idx", big("pos").alias("pos"), big("start").alias("start"))


@query(
    "encode_offsets",
    f"""WITH RECURSIVE {PIECE_SQL}, cw AS (SELECT {Q.key('conv_id', 'turn')} AS idx, regexp_extract_all(text, {Q.quote(X.WORDS_AND_RUNS + '|[' + X.SPACE_CHARS + ']+')}) AS ws FROM conversations),
    ca AS (SELECT idx, unnest(ws) AS word, generate_subscripts(ws, 1) AS piece FROM cw),
    cb AS (SELECT idx, piece, word, coalesce(sum(length(word)) OVER (PARTITION BY idx ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ca),
    ct AS (SELECT idx, word, start, row_number() OVER (PARTITION BY idx ORDER BY piece) - 1 AS word_no FROM cb WHERE NOT regexp_matches(word, '^[{X.SPACE_CHARS}]')),
    {best_sql('ct')}, {walk_sql('ct')}
    SELECT idx, word_no::BIGINT AS word_no, start::BIGINT AS start, (start + length(word))::BIGINT AS "end", (generate_subscripts(ids, 1) - 1)::BIGINT AS piece_no, unnest(ids)::BIGINT AS id
    FROM ct JOIN wids USING (word)""",
)
def encode_offsets(spark, d):
    rows = table(spark, d, "conversations").select(joint_key("conv_id", "turn").alias("idx"), "text")
    words = rows.select(F.explode(X.split_words(F.col("text"))).alias("word"))
    out = E.encode_offsets(rows, piece_table(spark, d, words), UNK, "idx")
    return out.select("idx", *[big(c).alias(c) for c in ("word_no", "start", "end", "piece_no", "id")])


# Masked sides as lists of (word position, tokens), from sentence pairs in piece encoding.
BI_SQL = f"""{PIECE_SQL}, {CONV_TURNS_SQL},
 bw AS (SELECT idx, 1 AS side, unnest({Q.marks('sentence1')}) AS word, generate_subscripts({Q.marks('sentence1')}, 1) - 1 AS pos FROM pairs
   UNION ALL SELECT idx, 2, unnest({Q.marks('sentence2')}), generate_subscripts({Q.marks('sentence2')}, 1) - 1 FROM pairs),
 {best_sql('bw')}, {walk_sql('bw')},
 bn AS (SELECT idx, least(max(pos) FILTER (side = 1), max(pos) FILTER (side = 2)) + 1 AS n FROM bw GROUP BY idx HAVING count(DISTINCT side) = 2),
 br AS (SELECT idx, i, n, row_number() OVER (PARTITION BY idx ORDER BY {Q.H('42:word', 'idx', 'i')}, i) AS r FROM bn, LATERAL (SELECT unnest(range(n::BIGINT)) AS i)),
 bk AS (SELECT idx, i, {kind_sql(Q.H('42:kind', 'idx', 'i'))} AS k FROM br WHERE r <= greatest(1, floor(round(n * 0.15, 9)))),
 bt AS (SELECT bw.idx, side, pos, unnest(ids) AS x, generate_subscripts(ids, 1) AS sub FROM bw JOIN bn USING (idx) JOIN wids USING (word)),
 bs AS (SELECT bt.idx, side, x, coalesce(k, 0) AS k, row_number() OVER (PARTITION BY bt.idx, side ORDER BY pos, sub) AS tok FROM bt LEFT JOIN bk ON bk.idx = bt.idx AND bk.i = bt.pos),
 bc AS (SELECT * FROM bs WHERE tok <= 62)"""


def bilingual(spark, d):
    """Sentence pairs with piece encodings of both sides, words of one side by position."""
    pairs = sentence_pairs(spark, d).select("idx", F.col("sentence1").alias("original_text"), F.col("sentence2").alias("text"))
    both = F.concat(*[X.split_words_single_punct(F.col(c)) for c in ("original_text", "text")])
    return pairs, piece_table(spark, d, pairs.select(F.explode(both).alias("word")))


@query(
    "aligned_whole_word_mask",
    f"""WITH RECURSIVE {BI_SQL} SELECT idx, string_agg(k, ',' ORDER BY tok) FILTER (side = 1) AS normal, string_agg(k, ',' ORDER BY tok) FILTER (side = 2) AS phonetic FROM bc GROUP BY idx""",
)
def aligned_whole_word_mask(spark, d):
    pairs, ids = bilingual(spark, d)
    words = E.encode_texts(pairs, ids, UNK, {"original_text": "a", "text": "b"}, "idx").filter("size(a) > 0 and size(b) > 0")
    kinds = words.select("idx", M.aligned_word_kinds(F.col("a"), F.col("b"), F.col("idx"), 62).alias("k"))
    return kinds.select("idx", ints_text("k.normal").alias("normal"), ints_text("k.phonetic").alias("phonetic"))


ASSEMBLED_SQL = f"""{BI_SQL},
 sz AS (SELECT idx, count(*) FILTER (side = 1) AS na, count(*) FILTER (side = 2) AS nb FROM bc GROUP BY idx),
 seq AS (SELECT idx, CASE side WHEN 1 THEN tok ELSE na + 1 + tok END AS i, x, k FROM bc JOIN sz USING (idx)
   UNION ALL SELECT idx, 0, {CLS}, 0 FROM sz UNION ALL SELECT idx, na + 1, {SEP}, 0 FROM sz UNION ALL SELECT idx, na + nb + 2, {SEP}, 0 FROM sz),
 fin AS (SELECT idx, i, x, k, CASE k WHEN 1 THEN {MASK} WHEN 2 THEN 5 + {Q.below(str(PIECES - 5), '42:token', 'idx', 'i')} ELSE x END AS y FROM seq),
 agg AS (SELECT idx, list(y ORDER BY i) AS ids, list(CASE WHEN k > 0 THEN x ELSE -100 END ORDER BY i) AS labels, any_value(na) AS na, any_value(nb) AS nb FROM fin JOIN sz USING (idx) GROUP BY idx)"""
ASSEMBLED_OUT = f"""SELECT idx, {txt(pad_sql('ids', '128', PAD))} AS input_ids,
 {txt('list_transform(range(128), lambda i: CASE WHEN i < na + nb + 3 THEN 1 ELSE 0 END)')} AS attention_mask,
 {txt('list_transform(range(128), lambda i: CASE WHEN i >= na + 2 AND i < na + nb + 3 THEN 1 ELSE 0 END)')} AS token_type_ids,
 {txt(pad_sql('labels', '128', -100))} AS labels FROM agg"""
EXAMPLE_COLUMNS = ("input_ids", "attention_mask", "token_type_ids", "labels")


@query("assemble_bilingual_example", f"WITH RECURSIVE {ASSEMBLED_SQL} {ASSEMBLED_OUT}")
def assemble_bilingual_example(spark, d):
    pairs, ids = bilingual(spark, d)
    words = E.encode_texts(pairs, ids, UNK, {"original_text": "a", "text": "b"}, "idx").filter("size(a) > 0 and size(b) > 0")
    kinds = words.select("idx", "a", "b", M.aligned_word_kinds(F.col("a"), F.col("b"), F.col("idx"), 62).alias("k"))
    example = M.bilingual_example(F.col("a"), F.col("b"), F.col("k"), F.col("idx"), SPECIAL, PIECES)
    return kinds.select("idx", example.alias("e")).select("idx", *[ints_text(f"e.{c}").alias(c) for c in EXAMPLE_COLUMNS])


@query("build_bilingual_mlm", f"WITH RECURSIVE {ASSEMBLED_SQL} {ASSEMBLED_OUT}")
def build_bilingual_mlm(spark, d):
    pairs, ids = bilingual(spark, d)
    out = PE.build_bilingual_mlm(pairs, ids, SPECIAL, PIECES, id_col="idx")
    return out.select("idx", *[ints_text(c).alias(c) for c in EXAMPLE_COLUMNS])


@query("replay_merges")
def replay_merges(spark, d):
    """Words of the conversations under merges learned on them."""
    words = V.word_frequencies(table(spark, d, "conversations"))
    learned, merges = V.train_merges(words)
    return E.replay_merges(words, learned, merges, UNK).select("word", ints_text("ids").alias("ids"))
