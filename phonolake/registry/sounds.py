"""Lexicon, transcription and rhyme queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolake.functions import phonetic as P
from phonolake.functions import text as X
from phonolake.operators import lexicon as G
from phonolake.operators import metrics as M
from phonolake.operators import vocabulary as V
from phonolake.plans import corpora as PC
from phonolake.registry import sql as Q
from phonolake.registry.base import big, query, scratch, table, words_text
from phonolake.registry.texts import CONV_TURNS_SQL, docs, sentence_pairs
from phonolake.sources import corpora as D
from phonolake.sources.catalog import task_fields

# The pronunciation table of these queries: the words of ``benchmark``, spelled letter by letter.
PRON_SQL = f"""pron AS (SELECT word, regexp_extract_all(word, '.') AS spelled FROM
   (SELECT DISTINCT unnest({Q.words('lower(text)')}) AS word FROM benchmark) WHERE regexp_matches(word, '^\\p{{L}}'))"""


def pronunciations(spark, d):
    words = G.corpus_words(table(spark, d, "benchmark")).filter(F.col("word").rlike(r"^\p{L}"))
    letters = F.regexp_extract_all("word", F.lit("."), F.lit(0))
    return words.select("word", letters.alias("phonemes"))


def lexicon(spark, d, splitter=X.split_words):
    return G.build_lexicon(G.corpus_words(docs(spark, d), splitter=splitter), pronunciations(spark, d))


def lex_sql(pattern: str = X.WORDS_AND_RUNS) -> str:
    return f"""{PRON_SQL}, dw AS (SELECT DISTINCT unnest({Q.words('lower(text)', pattern)}) AS word FROM documents),
 lex AS (SELECT dw.word, coalesce(spelled, {Q.phonemes('dw.word')}) AS phonemes FROM dw LEFT JOIN pron ON dw.word = pron.word)"""


@query("build_lexicon", f"WITH {lex_sql()} SELECT word, coalesce(array_to_string(phonemes, ' '), '') AS phonemes FROM lex")
def build_lexicon(spark, d):
    return lexicon(spark, d).select("word", words_text("phonemes", " ").alias("phonemes"))


@query(
    "lexicon_lookup",
    f"""WITH {PRON_SQL}, w AS (SELECT conv_id, turn, unnest({Q.words('text')}) AS word, generate_subscripts({Q.words('text')}, 1) - 1 AS pos FROM conversations)
    SELECT conv_id, turn, pos::BIGINT AS pos, w.word, array_to_string(spelled, ' ') AS phonemes FROM w LEFT JOIN pron ON lower(w.word) = pron.word""",
)
def lexicon_lookup(spark, d):
    words = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(X.split_words(F.col("text"))).alias("pos", "word"))
    found = G.lexicon_lookup(words, G.one_pronunciation(pronunciations(spark, d)))
    return found.select("conv_id", "turn", big("pos").alias("pos"), "word", words_text("phonemes", " ").alias("phonemes"))


@query(
    "apply_grapheme_rules",
    f"""WITH w AS (SELECT DISTINCT unnest({Q.words('text')}) AS word FROM documents)
    SELECT word, coalesce(array_to_string({Q.phonemes('word')}, ' '), '') AS phonemes FROM w""",
)
def apply_grapheme_rules(spark, d):
    words = docs(spark, d).select(F.explode(X.split_words(F.col("text"))).alias("word")).distinct()
    return words.select("word", words_text(P.apply_grapheme_rules(F.col("word")), " ").alias("phonemes"))


#: Rules of the second table: the words of the nations' names become one symbol, letters stand for themselves.
RULE_ROWS_SQL = """rule AS (SELECT lower(n_name) AS grapheme, ['N' || n_nationkey, '+'] AS phonemes, row_number() OVER (ORDER BY -length(n_name), n_name) AS rank FROM nation
    UNION ALL SELECT chr(96 + i::INT), [chr(64 + i::INT)], 1000 + i FROM range(1, 27) r(i))"""


@query(
    "rewrite_rules",
    f"""WITH w AS (SELECT DISTINCT lower(word) AS word FROM (SELECT unnest({Q.words('text')}) AS word FROM documents UNION ALL SELECT n_name || r_name FROM nation JOIN region ON n_regionkey = r_regionkey)),
    {RULE_ROWS_SQL}, one AS (SELECT map(list(grapheme), list(phonemes)) AS m, string_agg(grapheme, '|' ORDER BY rank) AS pattern FROM rule),
    found AS (SELECT word, m, regexp_extract_all(word, pattern) AS pieces FROM w, one)
    SELECT word, coalesce(array_to_string(flatten(list_transform(pieces, lambda g: m[g])), ' '), '') AS phonemes FROM found""",
)
def rewrite_rules(spark, d):
    """Transcription by a rule table instead of the built-in rules."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    mine = nation.select((-F.length("n_name")).alias("rank"), F.lower("n_name").alias("grapheme"), F.array(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), F.lit("+")).alias("phonemes"))
    letters = spark.range(1, 27).select((F.col("id") + 1000).cast("int").alias("rank"), F.char(F.col("id") + 96).alias("grapheme"), F.array(F.char(F.col("id") + 64)).alias("phonemes"))
    rules = P.rules_from_table(mine.unionByName(letters))
    names = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("n_name", "r_name").alias("word"))
    words = docs(spark, d).select(F.explode(X.split_words(F.col("text"))).alias("word")).unionByName(names)
    return G.build_lexicon(words, rules=rules).select("word", words_text("phonemes", " ").alias("phonemes"))


def _regroup(pattern: str, render: str, glue: str) -> str:
    return f"""{lex_sql(pattern)},
 t AS (SELECT doc_id, unnest({Q.words('text', pattern)}) AS word, generate_subscripts({Q.words('text', pattern)}, 1) AS pos FROM documents),
 lw AS (SELECT word, {render} AS sound FROM lex),
 j AS (SELECT doc_id, pos, coalesce(sound, t.word) AS sound FROM t LEFT JOIN lw ON lower(t.word) = lw.word),
 g AS (SELECT doc_id, string_agg(sound, '{glue}' ORDER BY pos) AS text FROM j GROUP BY doc_id)
 SELECT d.doc_id, coalesce(g.text, '') AS text FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"""


@query("phonetize_words", f"WITH {_regroup(X.WORDS_AND_RUNS, Q.joined('phonemes'), ' ')}")
def phonetize_words(spark, d):
    return G.phonetize_words(docs(spark, d), lexicon(spark, d))


@query("phonetize_whitespace", f"WITH {_regroup(X.NON_SPACE, Q.joined('phonemes'), ' ')}")
def phonetize_whitespace(spark, d):
    return G.phonetize_whitespace(docs(spark, d), lexicon(spark, d, X.whitespace_words))


@query("phonetize_phonemes", f"WITH {_regroup(X.NON_SPACE, Q.joined('phonemes', ' '), ' ')}")
def phonetize_phonemes(spark, d):
    return G.phonetize_phonemes(docs(spark, d), lexicon(spark, d, X.whitespace_words))


# Symbols of spelled words are no phoneme symbols and pass unchanged unless they happen to be one.
IPA_RENDER = f"""CASE WHEN regexp_matches(word, '^[{X.WORD_CHARS}]')
  THEN coalesce(array_to_string(list_transform(phonemes, lambda p: coalesce(map([{', '.join(Q.quote(s) for s in P.IPA)}], [{', '.join(Q.quote(i) for i in P.IPA.values())}])[p], p)), ''), '') ELSE NULL END"""


@query("transliterate_ipa", f"WITH {_regroup(X.WORDS_AND_GAPS, IPA_RENDER, '')}")
def transliterate_ipa(spark, d):
    return G.transliterate_ipa(docs(spark, d), lexicon(spark, d, X.split_words_and_gaps))


@query(
    "translate_corpus",
    f"WITH tr AS (WITH {_regroup(X.WORDS_AND_GAPS, IPA_RENDER, '')}) SELECT tr.doc_id, tr.text, d.text AS original_text FROM tr JOIN documents d ON d.doc_id = tr.doc_id",
)
def translate_corpus(spark, d):
    root = scratch(spark, "translated")
    D.write_corpus(docs(spark, d).withColumn("split", F.lit("train")), D.dataset_dir(root, "documents"))
    path = PC.convert_to_phonetic(spark, root, "documents", lexicon(spark, d, X.split_words_and_gaps))
    return D.load_corpus(spark, path).select("doc_id", "text", "original_text")


def _fields(pattern: str, render: str, glue: str, names=("sentence1", "sentence2")) -> str:
    return f"""WITH {CONV_TURNS_SQL}, {PRON_SQL},
 f AS (SELECT idx, 1 AS field, sentence1 AS text FROM pairs UNION ALL SELECT idx, 2, sentence2 FROM pairs),
 t AS (SELECT idx, field, unnest({Q.words('text', pattern)}) AS word, generate_subscripts({Q.words('text', pattern)}, 1) AS pos FROM f),
 dw AS (SELECT DISTINCT lower(word) AS word FROM t),
 lex AS (SELECT dw.word, coalesce(spelled, {Q.phonemes('dw.word')}) AS phonemes FROM dw LEFT JOIN pron ON dw.word = pron.word),
 lw AS (SELECT word, {render} AS sound FROM lex),
 g AS (SELECT idx, string_agg(coalesce(sound, t.word), '{glue}' ORDER BY pos) FILTER (field = 1) AS a,
   string_agg(coalesce(sound, t.word), '{glue}' ORDER BY pos) FILTER (field = 2) AS b FROM t LEFT JOIN lw ON lower(t.word) = lw.word GROUP BY idx)
 SELECT pairs.idx, coalesce(a, '') AS {names[0]}, coalesce(b, '') AS {names[1]}, label FROM pairs LEFT JOIN g ON pairs.idx = g.idx"""


@query("translate_task_fields", _fields(X.WORDS_AND_GAPS, IPA_RENDER, ""))
def translate_task_fields(spark, d):
    known = G.one_pronunciation(pronunciations(spark, d))
    return PC.translate_task_fields(sentence_pairs(spark, d), "mrpc", known)


@query("translate_pairs", _fields(X.NON_SPACE, Q.joined("phonemes"), " ", ("word1", "word2")))
def translate_pairs(spark, d):
    pairs = sentence_pairs(spark, d).withColumnsRenamed({"sentence1": "word1", "sentence2": "word2"})
    known = G.one_pronunciation(pronunciations(spark, d))
    return G.phonetize_whitespace(pairs, known, fields=["word1", "word2"], id_col="idx")


@query(
    "prepare_glue",
    f"SELECT 'mrpc' AS task, idx, sentence1 AS field1, sentence2 AS field2, label FROM ({_fields(X.WORDS_AND_GAPS, IPA_RENDER, '')})"
    f" UNION ALL SELECT 'qnli', idx, sentence1, sentence2, label FROM ({_fields(X.WORDS_AND_GAPS, IPA_RENDER, '')})",
)
def prepare_glue(spark, d):
    """Two tasks stored under their folders and read back."""
    root = scratch(spark, "glue")
    pairs = sentence_pairs(spark, d).withColumn("split", F.lit("train"))
    tasks = {
        task: pairs.withColumnsRenamed(dict(zip(("sentence1", "sentence2"), task_fields(task)))) for task in ("mrpc", "qnli")
    }
    PC.prepare_benchmark_tasks(tasks, root, G.one_pronunciation(pronunciations(spark, d)))
    out = None
    for task in tasks:
        one, two = task_fields(task)
        rows = D.load_task(spark, root, task, phonetic=True).select(
            F.lit(task).alias("task"), "idx", F.col(one).alias("field1"), F.col(two).alias("field2"), "label"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query("phonetic_ending", f"WITH {lex_sql()} SELECT word, coalesce(array_to_string(phonemes[-2:], ' '), '') AS ending FROM lex")
def phonetic_ending(spark, d):
    return lexicon(spark, d).select("word", words_text(P.phonetic_ending(F.col("phonemes")), " ").alias("ending"))


@query(
    "is_rhyming",
    f"""WITH {CONV_TURNS_SQL}, e AS (SELECT idx, {Q.phonemes(Q.spaced('sentence1') + '[-1]')} AS a, {Q.phonemes(Q.spaced('sentence2') + '[-1]')} AS b FROM pairs)
    SELECT idx, (len(a) >= 2 AND len(b) >= 2 AND a[-2:] = b[-2:])::BIGINT AS rhymes FROM e""",
)
def is_rhyming(spark, d):
    sound = lambda c: P.apply_grapheme_rules(X.last_word(F.col(c)))
    ends = sentence_pairs(spark, d).select("idx", sound("sentence1").alias("a"), sound("sentence2").alias("b"))
    return ends.select("idx", big(P.is_rhyming(F.col("a"), F.col("b")).cast("int")).alias("rhymes"))


@query("rhyme_score")
def rhyme_score(spark, d):
    sound = lambda c: P.apply_grapheme_rules(X.last_word(F.col(c)))
    ends = sentence_pairs(spark, d).select("label", sound("sentence1").alias("a"), sound("sentence2").alias("b"))
    return M.rhyme_score(ends.filter("a is not null and b is not null"), "a", "b", ["label"])


@query(
    "phoneme_inventory",
    f"""WITH {lex_sql()}, p AS (SELECT unnest(phonemes) AS phoneme FROM lex)
    SELECT phoneme, count(*)::BIGINT AS n, (phoneme IN ({', '.join(Q.quote(s) for s in dict.fromkeys(P.XSAMPA_INVENTORY))}))::BIGINT AS known,
    {len(P.XSAMPA_INVENTORY)}::BIGINT AS listed, {len(set(P.XSAMPA_INVENTORY))}::BIGINT AS symbols FROM p GROUP BY phoneme""",
)
def phoneme_inventory(spark, d):
    out = G.phoneme_inventory(lexicon(spark, d))
    return out.select("phoneme", "n", *[big(c).alias(c) for c in ("known", "listed", "symbols")])


# --- vocabularies ----------------------------------------------------------------------------

FREQ_SQL = f"""raw AS (SELECT unnest({Q.words('text')}) AS word FROM documents UNION ALL SELECT unnest({Q.words('text')}) FROM conversations),
 freq AS (SELECT lower(strip_accents(word)) AS word, sum(n) AS n FROM (SELECT word, count(*) AS n FROM raw GROUP BY word) GROUP BY 1)"""


def both_texts(spark, d):
    """Documents and conversations as one corpus with a split per source."""
    talk = table(spark, d, "conversations").select("text", F.lit("validation").alias("split"))
    return docs(spark, d).select("text", F.lit("train").alias("split")).unionByName(talk)


@query("word_frequencies", f"WITH {FREQ_SQL} SELECT word, n::BIGINT AS n FROM freq")
def word_frequencies(spark, d):
    return V.word_frequencies(both_texts(spark, d))


def vocab_sql(size: int, source: str = "freq") -> str:
    specials = " UNION ALL ".join(f"SELECT '{t}' AS token, {i} AS id" for i, t in enumerate(V.SPECIALS))
    return f"""vocab AS ({specials} UNION ALL SELECT word, 4 + row_number() OVER (ORDER BY n DESC, word) FROM
   (SELECT * FROM {source} WHERE word <> '' ORDER BY n DESC, word LIMIT {size - len(V.SPECIALS)}))"""


@query("vocab_wordlevel", f"WITH {FREQ_SQL}, {vocab_sql(V.VOCAB_SIZE)} SELECT token, id::BIGINT AS id FROM vocab")
def vocab_wordlevel(spark, d):
    return V.vocab_wordlevel(V.word_frequencies(both_texts(spark, d))).select("token", big("id").alias("id"))


@query("vocab_bpe")
def vocab_bpe(spark, d):
    vocab, _ = V.train_merges(V.word_frequencies(both_texts(spark, d)))
    return vocab.select("token", big("id").alias("id"))


@query("vocab_wordpiece")
def vocab_wordpiece(spark, d):
    """Continuation pieces, seeded with the phoneme inventory."""
    counts = V.word_frequencies(both_texts(spark, d))
    vocab, _ = V.train_merges(counts, prefix="##", extra_tokens=list(dict.fromkeys(P.XSAMPA_INVENTORY)))
    return vocab.select("token", big("id").alias("id"))


@query("train_vocabulary")
def train_vocabulary(spark, d):
    """Merge vocabulary over transcription and original text."""
    vocab, _ = PC.train_phonetic_vocabulary(docs(spark, d), G.one_pronunciation(pronunciations(spark, d)), "BPE")
    return vocab.select("token", big("id").alias("id"))


@query("build_phoneme_corpus", f"""WITH ph AS (WITH {_regroup(X.NON_SPACE, Q.joined('phonemes', ' '), ' ')}), w AS (SELECT doc_id, {Q.spaced('text')} AS ws FROM ph),
    s AS (SELECT doc_id, ws, unnest(range(0, len(ws), 256)) AS k FROM w)
    SELECT doc_id, (k / 256)::BIGINT AS chunk_no, array_to_string(ws[k + 1:k + 256], ' ') AS text FROM s""")
def build_phoneme_corpus(spark, d):
    out = PC.build_phoneme_corpus(docs(spark, d), lexicon(spark, d, X.whitespace_words))
    return out.withColumn("chunk_no", big("chunk_no"))
