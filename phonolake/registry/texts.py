"""Text expressions, filters, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolake.functions import text as X
from phonolake.functions.hashing import hash_unit
from phonolake.operators import cleaning as C
from phonolake.operators import language as L
from phonolake.operators import vocabulary as V
from phonolake.plans import corpora as PC
from phonolake.registry import sql as Q
from phonolake.registry.base import big, ints_text, joint_key, query, r6, scratch, table, words_text
from phonolake.sources import corpora as D
from phonolake.sources import files as FI
from phonolake.sources import html as HT
from phonolake.sources.catalog import TASK_FIELDS

SPLIT_SQL = f"CASE WHEN {Q.H('split', 'doc_id')} < 0.1 THEN 'test' WHEN {Q.H('split', 'doc_id')} < 0.2 THEN 'validation' ELSE 'train' END"


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def split_docs(spark, d):
    """Documents with a split decided by the hash of the id."""
    u = hash_unit("split", "doc_id")
    return docs(spark, d).withColumn("split", F.when(u < 0.1, "test").when(u < 0.2, "validation").otherwise("train"))


# --- expressions -----------------------------------------------------------------------------

def _text_query(name, fn, sql):
    @query(name, f"SELECT doc_id, {sql} AS out FROM documents")
    def run(spark, d):
        return docs(spark, d).select("doc_id", fn(F.col("text")).alias("out"))


_text_query("clean_text", X.clean_text, Q.clean("text"))
_text_query("clean_text_cased", lambda c: X.clean_text(c, lowercase=False), Q.clean("text", False))
_text_query("split_words", lambda c: words_text(X.split_words(c)), Q.joined(Q.words("text"), "|"))
_text_query("split_words_single_punct", lambda c: words_text(X.split_words_single_punct(c)), Q.joined(Q.marks("text"), "|"))
_text_query("num_words", lambda c: big(X.num_words(c)), f"len({Q.spaced('text')})::BIGINT")
_text_query("last_word", X.last_word, f"{Q.spaced('text')}[-1]")
_text_query("text_hash", X.text_hash, "md5(text)")
_text_query(
    "mask_last_word",
    X.mask_last_word,
    f"CASE WHEN len({Q.spaced('text')}) > 0 THEN array_to_string(list_append({Q.spaced('text')}[:-2], '[MASK]'), ' ') END",
)

LINES_SQL = """lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents)"""


def lines(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query(
    "normalize_poem_line",
    f"""WITH {LINES_SQL} SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(regexp_replace(line,
    '[{X.SPACE_CHARS}]+', ' ', 'g'), '[^a-zA-Z0-9 ]', '', 'g'), 'http[^ ]+', '', 'g')) AS line FROM lines""",
)
def normalize_poem_line(spark, d):
    return lines(spark, d).select("doc_id", big("line_no").alias("line_no"), X.normalize_poem_line(F.col("line")).alias("line"))


@query(
    "chunk_words",
    f"""WITH w AS (SELECT doc_id, {Q.words('text')} AS ws FROM documents),
    s AS (SELECT doc_id, ws, unnest(range(0, len(ws), 100)) AS k FROM w)
    SELECT doc_id, (k // 100)::BIGINT AS chunk_no, array_to_string(ws[k + 1:k + 100], ' ') AS text FROM s""",
)
def chunk_words(spark, d):
    return C.chunk_words(docs(spark, d), 100, index="chunk_no").withColumn("chunk_no", big("chunk_no"))


@query(
    "chunk_whitespace",
    f"""WITH w AS (SELECT doc_id, {Q.spaced('text')} AS ws FROM documents),
    s AS (SELECT doc_id, ws, unnest(range(0, len(ws), 256)) AS k FROM w)
    SELECT doc_id, (k // 256)::BIGINT AS chunk_no, array_to_string(ws[k + 1:k + 256], ' ') AS text FROM s""",
)
def chunk_whitespace(spark, d):
    out = C.chunk_words(docs(spark, d), 256, splitter=X.whitespace_words, index="chunk_no")
    return out.withColumn("chunk_no", big("chunk_no"))


@query(
    "normalize_unicode",
    f"""WITH w AS (SELECT DISTINCT unnest({Q.words('text')}) AS word FROM documents)
    SELECT word, lower(strip_accents(word)) AS normal FROM w""",
)
def normalize_unicode(spark, d):
    words = docs(spark, d).select(F.explode(X.split_words(F.col("text"))).alias("word")).distinct()
    return V.normalize_unicode(words)


@query(
    "split_delimited",
    """SELECT event_id, array_to_string(flatten(list_transform(string_split(props, ':'), lambda p: string_split(trim(p), '"'))), '|') AS out FROM events""",
)
def split_delimited(spark, d):
    cell = F.translate("props", ':"', ";|")
    return table(spark, d, "events").select("event_id", words_text(X.split_delimited(cell)).alias("out"))


@query("is_capitalized", f"""WITH w AS (SELECT DISTINCT unnest({Q.words('text')}) AS word FROM documents)
    SELECT word, regexp_matches(word, '^\\p{{Lu}}')::BIGINT AS capital FROM w""")
def is_capitalized(spark, d):
    words = docs(spark, d).select(F.explode(X.split_words(F.col("text"))).alias("word")).distinct()
    return words.select("word", big(X.is_capitalized(F.col("word")).cast("int")).alias("capital"))


# --- projections and filters -----------------------------------------------------------------

@query("project_rename", "SELECT doc_id AS id, text AS input_text FROM documents")
def project_rename(spark, d):
    return table(spark, d, "documents").drop("lang", "source", "n_chars").withColumnsRenamed({"doc_id": "id", "text": "input_text"})


@query("filter_nonempty", f"WITH {LINES_SQL} SELECT doc_id, line_no, line FROM lines WHERE length(line) > 0")
def filter_nonempty(spark, d):
    return C.filter_nonempty(lines(spark, d), "line").withColumn("line_no", big("line_no"))


@query("filter_equals", "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2')")
def filter_equals(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source")
    return C.filter_equals(C.filter_equals(rows, ["lang"], ["en", "fr"]), ["source"], ["src1", "src2"])


@query("filter_line_length", f"WITH {LINES_SQL} SELECT doc_id, line_no, line FROM lines WHERE length(line) + 1 > 2 AND length(line) + 1 < 100")
def filter_line_length(spark, d):
    return C.filter_line_length(lines(spark, d), "line").withColumn("line_no", big("line_no"))


@query("filter_bracket_lines", f"WITH {LINES_SQL} SELECT doc_id, line_no, line FROM lines WHERE NOT (contains(line, '[') AND contains(line, ']'))")
def filter_bracket_lines(spark, d):
    return C.filter_bracket_lines(lines(spark, d), "line").withColumn("line_no", big("line_no"))


@query(
    "filter_plain_words",
    f"""WITH w AS (SELECT DISTINCT unnest({Q.spaced('text')}) AS word FROM documents)
    SELECT word FROM w WHERE NOT regexp_matches(word, '[()\\- ''.]')""",
)
def filter_plain_words(spark, d):
    words = docs(spark, d).select(F.explode(X.whitespace_words(F.col("text"))).alias("word")).distinct()
    return C.filter_plain_words(words)


ENDS_SQL = f"""ends AS (SELECT conv_id, turn, trim(split_part(text, ' ', 1)) AS word1, {Q.spaced('text')}[2] AS word2 FROM conversations)"""


@query("drop_blank_rows", f"WITH {ENDS_SQL} SELECT conv_id, turn, word1, word2 FROM ends WHERE word1 <> '' AND word2 <> ''")
def drop_blank_rows(spark, d):
    ends = table(spark, d, "conversations").select(
        "conv_id", "turn", F.trim(F.split_part("text", F.lit(" "), F.lit(1))).alias("word1"),
        F.try_element_at(X.whitespace_words(F.col("text")), F.lit(2)).alias("word2"),
    )
    return C.drop_blank_rows(ends, ["word1", "word2"])


# --- language --------------------------------------------------------------------------------

PROFILE_SQL = f"""tok AS (SELECT lang, unnest({Q.words('lower(text)')}) AS token FROM documents WHERE lang IN ('en', 'fr')),
 cnt AS (SELECT token, count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (lang = 'fr') AS n_fr FROM tok
   WHERE regexp_matches(token, '^\\p{{L}}') GROUP BY token),
 tot AS (SELECT count(*) AS types, sum(n_en) AS t_en, sum(n_fr) AS t_fr FROM cnt),
 prof AS (SELECT token, n_en, n_fr, ln((n_en + 1) / (t_en + types)::DOUBLE) AS w_en, ln((n_fr + 1) / (t_fr + types)::DOUBLE) AS w_fr FROM cnt, tot)"""


@query(
    "train_language_profile",
    f"""WITH {PROFILE_SQL} SELECT token, 'en' AS lang, n_en::BIGINT AS n, round(w_en, 6) AS weight FROM prof
    UNION ALL SELECT token, 'fr', n_fr::BIGINT, round(w_fr, 6) FROM prof""",
)
def train_language_profile(spark, d):
    profile = L.train_language_profile(table(spark, d, "documents"), ["en", "fr"])
    return profile.select("token", "lang", big("n").alias("n"), r6("weight").alias("weight"))


DETECT_SQL = f"""dtok AS (SELECT doc_id, unnest({Q.words('lower(text)')}) AS token FROM documents),
 score AS (SELECT doc_id, sum(w_en) AS s_en, sum(w_fr) AS s_fr FROM dtok JOIN prof USING (token) GROUP BY doc_id)"""


@query("filter_language", f"WITH {PROFILE_SQL}, {DETECT_SQL} SELECT doc_id, text FROM documents JOIN score USING (doc_id) WHERE s_en > s_fr")
def filter_language(spark, d):
    profile = L.profile_table(table(spark, d, "documents"), ["en", "fr"])
    return L.filter_language(docs(spark, d), profile)


# --- unions, schemas, task shapes ------------------------------------------------------------

CONV_TURNS_SQL = f"""turns AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations),
 pairs AS (SELECT {Q.key('conv_id', 'turn')} AS idx, text AS sentence1, next AS sentence2, (length(text) % 2)::BIGINT AS label FROM turns WHERE next IS NOT NULL)"""


def sentence_pairs(spark, d):
    """Consecutive turns as sentence pairs; the label is the parity of the first text's length."""
    turns = table(spark, d, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sentence2"))
    return turns.join(following, ["conv_id", "turn"]).select(
        joint_key("conv_id", "turn").alias("idx"), F.col("text").alias("sentence1"), "sentence2",
        big(F.length("text") % 2).alias("label"),
    )


@query("unify_features", f"WITH {CONV_TURNS_SQL} SELECT idx, array_to_string([sentence1, sentence2], ' || ') AS features, label FROM pairs")
def unify_features(spark, d):
    unified = C.unify_features(sentence_pairs(spark, d), TASK_FIELDS["mrpc"])
    return unified.select("idx", words_text("features", " || ").alias("features"), "label")


@query("assert_same_schema", "SELECT text FROM documents UNION ALL SELECT text FROM benchmark")
def assert_same_schema(spark, d):
    left, right = docs(spark, d).select("text"), table(spark, d, "benchmark").select("text")
    C.assert_same_schema(left, right)
    return left.unionByName(right)


@query("concat_corpora", "SELECT doc_id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def concat_corpora(spark, d):
    return C.concat_corpora(docs(spark, d), table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))


@query(
    "concat_labelled_pairs",
    f"""WITH {CONV_TURNS_SQL}, neg AS (SELECT sentence2 AS a, sentence1 AS b FROM pairs)
    SELECT sentence1 AS word1, sentence2 AS word2, 1::BIGINT AS label FROM pairs UNION ALL SELECT a, b, 0 FROM neg""",
)
def concat_labelled_pairs(spark, d):
    pairs = sentence_pairs(spark, d).select(F.col("sentence1").alias("word1"), F.col("sentence2").alias("word2"))
    swapped = pairs.select(F.col("word2").alias("word1"), F.col("word1").alias("word2"))
    return C.concat_labelled_pairs(pairs, swapped).withColumn("label", big("label"))


@query(
    "processed_word_difference",
    f"""SELECT DISTINCT word FROM (SELECT unnest({Q.words('lower(text)')}) AS word FROM documents)
    WHERE word NOT IN (SELECT unnest({Q.words('lower(text)')}) FROM benchmark)""",
)
def processed_word_difference(spark, d):
    word = F.explode(X.split_words(F.lower("text"))).alias("word")
    return C.processed_difference(docs(spark, d).select(word), table(spark, d, "benchmark").select(word).distinct())


@query(
    "dedup_exact",
    "SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1",
)
def dedup_exact(spark, d):
    return C.dedup_exact(docs(spark, d))


@query(
    "dedup_exact_batched",
    "SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text), doc_id // 1000 ORDER BY doc_id) = 1",
)
def dedup_exact_batched(spark, d):
    batched = docs(spark, d).withColumn("batch", F.expr("doc_id div 1000"))
    return C.dedup_exact(batched, scope_cols=["batch"]).drop("batch")


@query("drop_duplicate_rows", "SELECT DISTINCT user_id, event_type FROM events")
def drop_duplicate_rows(spark, d):
    return C.drop_duplicate_rows(table(spark, d, "events"), ["user_id", "event_type"])


# --- sources and sinks -----------------------------------------------------------------------

@query("load_corpus", f"SELECT doc_id, text, {SPLIT_SQL} AS split FROM documents")
def load_corpus(spark, d):
    path = D.write_corpus(split_docs(spark, d), scratch(spark, "corpus"))
    return D.load_corpus(spark, path, D.CORPUS)


@query("write_corpus", f"SELECT {SPLIT_SQL} AS split, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def write_corpus(spark, d):
    path = D.write_corpus(split_docs(spark, d), D.dataset_dir(scratch(spark, "data"), "documents"))
    return D.load_corpus(spark, path).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


MNLI_SQL = f"""WITH {CONV_TURNS_SQL}, s AS (SELECT idx, sentence1 AS premise, sentence2 AS hypothesis, label,
   CASE WHEN {Q.H('mnli', 'idx')} < 0.3 THEN 'validation' WHEN {Q.H('mnli', 'idx')} < 0.5 THEN 'test' ELSE 'train' END AS split FROM pairs)
 SELECT idx, premise, hypothesis, label, split FROM s WHERE split = 'train'
 UNION ALL SELECT idx, premise, hypothesis, label, split || '_matched' FROM s WHERE split <> 'train' AND label = 0
 UNION ALL SELECT idx, premise, hypothesis, label, split || '_mismatched' FROM s WHERE split <> 'train' AND label = 1"""


@query("load_glue_task", MNLI_SQL)
def load_glue_task(spark, d):
    u = hash_unit("mnli", "idx")
    rows = D.task_table(sentence_pairs(spark, d), {"premise": "sentence1", "hypothesis": "sentence2"}, "label", "idx")
    rows = rows.withColumn("split", F.when(u < 0.3, "validation").when(u < 0.5, "test").otherwise("train"))
    root = scratch(spark, "tasks")
    D.write_task(rows, root, "mnli")
    D.write_task(rows.filter("label = 0"), root, "mnli_matched")
    D.write_task(rows.filter("label = 1"), root, "mnli_mismatched")
    return D.load_task(spark, root, "mnli")


@query("read_csv_table", "SELECT p_partkey, p_name, p_brand, p_size::BIGINT AS p_size, p_retailprice FROM part")
def read_csv_table(spark, d):
    path = scratch(spark, "csv")
    table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice").write.option("header", True).csv(path)
    return FI.read_csv_table(spark, path, "p_partkey bigint, p_name string, p_brand string, p_size bigint, p_retailprice double")


@query("write_csv_splits", f"SELECT doc_id, text, {SPLIT_SQL} AS split FROM documents")
def write_csv_splits(spark, d):
    path = FI.write_csv_splits(split_docs(spark, d), scratch(spark, "csv-splits"))
    return FI.read_csv_table(spark, path, D.CORPUS, multiline=True)


@query("read_word_list", f"SELECT unnest({Q.spaced('text')}) AS word FROM benchmark")
def read_word_list(spark, d):
    path = scratch(spark, "words")
    words = table(spark, d, "benchmark").select(F.explode(X.whitespace_words(F.col("text"))).alias("word"))
    words.select(F.concat(F.lit(" "), "word", F.lit(" ")).alias("value")).write.text(path)
    return FI.read_word_list(spark, path)


@query("read_ragged_lists", "SELECT len(string_split(p_name, ' '))::BIGINT AS width, replace(p_name, ' ', '|') AS words FROM part")
def read_ragged_lists(spark, d):
    path = scratch(spark, "lists")
    table(spark, d, "part").select(F.regexp_replace("p_name", " ", ",").alias("value")).write.text(path)
    lists = FI.read_ragged_lists(spark, path)
    return lists.select(big(F.size("words")).alias("width"), words_text("words").alias("words"))


@query(
    "write_text_shards",
    f"""WITH w AS (SELECT doc_id, {SPLIT_SQL} AS split, unnest({Q.words('text')}) AS word, generate_subscripts({Q.words('text')}, 1) - 1 AS pos FROM documents),
    n AS (SELECT word, row_number() OVER (ORDER BY split, doc_id, pos) - 1 AS k FROM w)
    SELECT (k // 10000)::BIGINT AS shard, count(*)::BIGINT AS lines, 1::BIGINT AS files, md5(string_agg(md5(word), '' ORDER BY md5(word))) AS content FROM n GROUP BY 1""",
)
def write_text_shards(spark, d):
    """One word per line, in files of 10,000 lines over all splits."""
    words = C.merged_arrays(split_docs(spark, d).select("split", "doc_id", X.split_words(F.col("text")).alias("text")), ["split", "doc_id"], "text")
    path = FI.write_text_shards(words, scratch(spark, "shards"), ["split", "doc_id"])
    content = F.md5(F.array_join(F.array_sort(F.collect_list(F.md5("value"))), ""))
    return FI.shard_lines(spark, path).groupBy("shard").agg(
        F.count(F.lit(1)).alias("lines"), big(F.size(F.collect_set("file"))).alias("files"), content.alias("content")
    )


@query("append_lines", f"WITH {LINES_SQL} SELECT line, (2 * count(*))::BIGINT AS n FROM lines GROUP BY line")
def append_lines(spark, d):
    """Two runs, the second of them again."""
    path = scratch(spark, "lines")
    rows = lines(spark, d)
    for run in ("first", "second", "second"):
        FI.append_lines(rows, path, "line", run_id=run)
    return FI.read_appended(spark, path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


# --- HTML ------------------------------------------------------------------------------------

@query(
    "extract_html_groups",
    """WITH b AS (SELECT page_id, regexp_extract_all(html, '(?s)<ul(?:\\s[^>]*)?>(.*?)</ul>', 1) AS blocks FROM pages),
    e AS (SELECT page_id, unnest(blocks) AS block, generate_subscripts(blocks, 1) - 1 AS group_no FROM b),
    w AS (SELECT page_id, group_no, list_transform(regexp_extract_all(block, '(?s)<a(?:\\s[^>]*)?>(.*?)</a>', 1),
      lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS words FROM e)
    SELECT page_id, group_no::BIGINT AS group_no, array_to_string(words, '|') AS words FROM w WHERE len(words) > 0""",
)
def extract_html_groups(spark, d):
    groups = HT.extract_html_groups(table(spark, d, "pages"), "ul", None, "a", None)
    return groups.select("page_id", big("group_no").alias("group_no"), words_text("words").alias("words"))


@query(
    "extract_page_count",
    """WITH h AS (SELECT page_id, '<div class="col-sm-9"><h5>Page <b>1</b> / ' || (page_id % 97) || '</h5></div>' || html AS html FROM pages)
    SELECT page_id, regexp_extract(html, '/ ([0-9]+)</h5>', 1)::BIGINT AS pages FROM h""",
)
def extract_page_count(spark, d):
    """The pages, each below a heading that counts result pages."""
    heading = F.concat(F.lit('<div class="col-sm-9"><h5>Page <b>1</b> / '), (F.col("page_id") % 97).cast("string"), F.lit("</h5></div>"))
    counted = HT.extract_page_count(table(spark, d, "pages").withColumn("html", F.concat(heading, "html")))
    return counted.select("page_id", big("pages").alias("pages"))


# --- composite corpus jobs -------------------------------------------------------------------

WIKI_SQL = f"""w AS (SELECT doc_id, {Q.words('text')} AS ws FROM documents),
 s AS (SELECT doc_id, ws, unnest(range(0, len(ws), 100)) AS k FROM w),
 c AS (SELECT doc_id, k // 100 AS chunk_no, {Q.clean("array_to_string(ws[k + 1:k + 100], ' ')")} AS text FROM s),
 u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id, chunk_no) = 1),
 {PROFILE_SQL},
 ct AS (SELECT doc_id, chunk_no, unnest({Q.words('lower(text)')}) AS token FROM u),
 sc AS (SELECT doc_id, chunk_no, sum(w_en) AS s_en, sum(w_fr) AS s_fr FROM ct JOIN prof USING (token) GROUP BY doc_id, chunk_no),
 wiki AS (SELECT doc_id, chunk_no::BIGINT AS chunk_no, text FROM u JOIN sc USING (doc_id, chunk_no) WHERE s_en > s_fr AND length(text) > 0)"""


@query("prepare_wikitext", f"WITH {WIKI_SQL} SELECT doc_id, chunk_no, text FROM wiki")
def prepare_wikitext(spark, d):
    profile = L.profile_table(table(spark, d, "documents"), ["en", "fr"])
    return PC.prepare_wikitext(docs(spark, d), profile).withColumn("chunk_no", big("chunk_no"))


@query(
    "prepare_bookcorpus",
    f"""WITH b AS (SELECT concat_ws(':', 'documents', doc_id) AS doc_id, text FROM documents UNION ALL SELECT concat_ws(':', 'benchmark', item_id), text FROM benchmark),
    w AS (SELECT doc_id, {Q.words('text')} AS ws FROM b), s AS (SELECT doc_id, ws, unnest(range(0, len(ws), 100)) AS k FROM w)
    SELECT doc_id, CASE WHEN {Q.H('42:validation', 'doc_id')} < 0.01 THEN 'validation' ELSE 'train' END AS split, (k // 100)::BIGINT AS chunk_no,
      {Q.clean("array_to_string(ws[k + 1:k + 100], ' ')")} AS text FROM s""",
)
def prepare_bookcorpus(spark, d):
    books = docs(spark, d).withColumn("doc_id", joint_key(F.lit("documents"), "doc_id"))
    articles = table(spark, d, "benchmark").select(joint_key(F.lit("benchmark"), "item_id").alias("doc_id"), "text")
    return PC.prepare_bookcorpus(books, articles).withColumn("chunk_no", big("chunk_no"))


@query(
    "clean_corpus",
    f"""WITH u AS (SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1),
    {PROFILE_SQL}, {DETECT_SQL} SELECT doc_id, {Q.clean('text')} AS text FROM u JOIN score USING (doc_id) WHERE s_en > s_fr""",
)
def clean_corpus(spark, d):
    return PC.clean_corpus(docs(spark, d), L.profile_table(table(spark, d, "documents"), ["en", "fr"]))


@query(
    "build_verse_lines",
    f"""WITH {LINES_SQL} SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(regexp_replace(line,
    '[{X.SPACE_CHARS}]+', ' ', 'g'), '[^a-zA-Z0-9 ]', '', 'g'), 'http[^ ]+', '', 'g')) AS text FROM lines WHERE length(line) + 1 > 2 AND length(line) + 1 < 100""",
)
def build_verse_lines(spark, d):
    return PC.build_verse_lines(docs(spark, d)).withColumn("line_no", big("line_no"))
