import re

import pytest
from pyspark.sql import functions as F

from phonolake.functions import text as X
from phonolake.operators import cleaning as C
from phonolake.operators.encoding import encode_offsets

TEXTS = [
    "", "   ", "Hello, my name is Paul!!", "a http://x.y/z b", "don't\\stop `now` {x|y} #1 $5 ~z @w [k]",
    "Café ÀÉ naïve 東京 x", "t͡ʃɛlo ɡʊd", "a b c​d", "tab\tand\nnewline\r\nend", "...!? --- _x_ 1_000",
    "UPPER  lower   MiXed", "\x1cfoo\x1fbar\x85baz",
]


def one_column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("text"))).collect()]


#: Input, cleaned, cleaned with case, normalized poem line.
CLEANED = [
    ("", "", "", ""),
    ("   ", "", "", ""),
    ("Hello, my name is Paul!!", "hello, my name is paul!!", "Hello, my name is Paul!!", "Hello my name is Paul"),
    ("a http://x.y/z b", "a  b", "a  b", "a  b"),
    ("don't\\stop `now` {x|y} #1 $5", "don'tstop now xy 1 5", "don'tstop now xy 1 5", "dontstop now xy 1 5"),
    ("Café 東京 x", "caf  x", "Caf  x", "Caf  x"),
    ("tab\tand\nnewline\r\nend", "tab and newline end", "tab and newline end", "tab and newline end"),
    ("...!? --- _x_ 1_000", "...!?  x 1000", "...!?  x 1000", "x 1000"),
    ("UPPER  lower   MiXed", "upper lower mixed", "UPPER lower MiXed", "UPPER lower MiXed"),
]
#: Printed ASCII that cleaning keeps as it is; capitals become small, white space becomes one space, the rest goes.
KEPT = "abcdefghijklmnopqrstuvwxyz0123456789,.!?;:'\""


@pytest.mark.parametrize("place, ours", [(1, X.clean_text), (2, lambda c: X.clean_text(c, lowercase=False)), (3, X.normalize_poem_line)])
def test_cleaning_of_literal_texts(spark, place, ours):
    assert one_column(spark, [case[0] for case in CLEANED], ours) == [case[place] for case in CLEANED]


@pytest.mark.parametrize(
    "ours, theirs",
    [
        (X.split_words, lambda s: re.findall(r"\w+|[^\s\w]+", s)),
        (X.split_words_single_punct, lambda s: re.findall(r"\w+|[^\w\s]", s)),
        (X.whitespace_words, str.split),
        (X.num_words, lambda s: len(s.split())),
        (X.last_word, lambda s: s.split()[-1] if s.split() else None),
        (X.mask_last_word, lambda s: " ".join([*s.split()[:-1], "[MASK]"]) if s.split() else None),
    ],
)
def test_expressions_agree_with_python(spark, ours, theirs):
    assert one_column(spark, TEXTS, ours) == [theirs(t) for t in TEXTS]


def test_every_ascii_character(spark):
    texts = [f"a{chr(c)}b" for c in range(1, 128)]
    kept = [c.lower() if c.lower() in KEPT else " " if c.isspace() else "" for c in map(chr, range(1, 128))]
    assert one_column(spark, texts, X.clean_text) == [f"a{k}b" for k in kept]


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 200, 201])
def test_chunk_boundaries(spark, n):
    words = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    got = [r["text"] for r in C.chunk_words(df, 100, index="k").orderBy("k").collect()]
    assert got == [" ".join(words[i : i + 100]) for i in range(0, n, 100)]


def test_split_delimited_keeps_inner_spaces(spark):
    assert one_column(spark, ["a; b |c;", ""], X.split_delimited) == [["a", "b ", "c", ""], [""]]


def test_words_and_gaps_join_back(spark):
    assert one_column(spark, TEXTS, lambda c: F.array_join(X.split_words_and_gaps(c), "")) == TEXTS


def test_offsets_point_at_their_words(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    table = spark.createDataFrame([("x", [7, 8])], "word string, ids array<int>")
    rows = encode_offsets(df, table, 0).collect()
    for doc_id, text in enumerate(TEXTS):
        mine = sorted((r["word_no"], r["piece_no"], r["start"], r["end"]) for r in rows if r["doc_id"] == doc_id)
        spans = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\w+|[^\s\w]+", text)]
        want = [(i, p, s, e) for i, (s, e, w) in enumerate(spans) for p in range(2 if w == "x" else 1)]
        assert mine == want


def test_dedup_keeps_first_and_scopes(spark):
    rows = [(5, "b", 0), (3, "a", 0), (4, "a", 0), (9, "a", 1), (1, "c", 1), (7, "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, batch int").repartition(3)
    assert sorted(r["doc_id"] for r in C.dedup_exact(df).collect()) == [1, 3, 5]
    assert sorted(r["doc_id"] for r in C.dedup_exact(df, scope_cols=["batch"]).collect()) == [1, 3, 5, 7, 9]


def test_filters(spark):
    words = spark.createDataFrame([(w,) for w in ["ab", "a-b", "a b", "it's", "e.g", "(x", "ok"]], "word string")
    assert sorted(r[0] for r in C.filter_plain_words(words).collect()) == ["ab", "ok"]
    pairs = spark.createDataFrame([("a", "b"), ("", "b"), (None, "c"), ("d", None)], "word1 string, word2 string")
    assert C.drop_blank_rows(pairs, ["word1", "word2"]).collect() == [("a", "b")]
    lines = spark.createDataFrame([("[x]",), ("[x",), ("y",)], "text string")
    assert sorted(r[0] for r in C.filter_bracket_lines(lines).collect()) == ["[x", "y"]
    sized = spark.createDataFrame([("a" * n,) for n in (0, 1, 2, 98, 99, 100)], "text string")
    assert sorted(len(r[0]) for r in C.filter_line_length(sized).collect()) == [2, 98]


def test_schema_check(spark):
    a = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError):
        C.concat_corpora(a, a.withColumn("doc_id", F.col("doc_id").cast("int")))
    assert C.concat_corpora(a, a).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    from phonolake.streaming import clean_stream

    source = str(tmp_path / "in")
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    rows.write.parquet(source)
    stream = clean_stream(spark.readStream.schema("text string").parquet(source))
    query = stream.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r[0] for r in spark.table("cleaned").collect()) == sorted(r[0] for r in clean_stream(rows).collect())
