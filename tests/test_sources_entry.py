import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from phonolake.operators import cleaning as C
from phonolake.sources import catalog as K
from phonolake.sources import corpora as D
from phonolake.sources import files as FI
from phonolake.sources import html as HT

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def test_corpus_round_trip_and_missing_folder(spark, tmp_path):
    path = D.dataset_dir(str(tmp_path), "wiki", phonetic=True, cleaned=True)
    assert path.endswith("/cleaned_phonetic_wiki")
    df = spark.createDataFrame([(1, "x", "train"), (2, "y", "test")], D.CORPUS)
    D.write_corpus(df, path)
    assert sorted(os.listdir(path))[-2:] == ["split=test", "split=train"]
    assert sorted(map(tuple, D.load_corpus(spark, path, D.CORPUS).collect())) == [(1, "x", "train"), (2, "y", "test")]
    with pytest.raises(ValueError):
        D.load_corpus(spark, str(tmp_path / "nothing"))


def test_mnli_is_stitched(spark, tmp_path):
    def rows(tag):
        return spark.createDataFrame([(i, tag, "h", 0, s) for i, s in enumerate(("train", "validation", "test"))],
                                     "idx long, premise string, hypothesis string, label int, split string")
    for task in ("mnli", "mnli_matched", "mnli_mismatched"):
        D.write_task(rows(task), str(tmp_path), task)
    got = {(r["split"], r["premise"]) for r in D.load_task(spark, str(tmp_path), "mnli").collect()}
    assert got == {("train", "mnli")} | {(f"{s}_{v}", f"mnli_{v}") for s in ("validation", "test") for v in ("matched", "mismatched")}


def test_csv_with_newlines_and_quotes(spark, tmp_path):
    poem = 'line one\nline "two", end'
    df = spark.createDataFrame([(1, poem, "train")], D.CORPUS)
    path = FI.write_csv_splits(df, str(tmp_path / "csv"))
    assert FI.read_csv_table(spark, path, D.CORPUS, multiline=True).first()["text"] == poem


def test_text_files(spark, tmp_path):
    lines = spark.createDataFrame([(f"l{i}",) for i in range(25)], "text string").coalesce(1)
    FI.append_lines(lines, str(tmp_path / "t"))
    FI.append_lines(lines, str(tmp_path / "t"))
    assert FI.read_appended(spark, str(tmp_path / "t")).count() == 50
    words = spark.createDataFrame([(" a ",), ("b\t",)], "value string")
    assert [r[0] for r in FI.words_from_lines(words).collect()] == ["a", "b"]
    lists = spark.createDataFrame([("a,b,c",), ("x",)], "value string")
    assert [r[0] for r in FI.lists_from_lines(lists).collect()] == [["a", "b", "c"], ["x"]]
    FI.append_lines(lines, str(tmp_path / "p"), blank_between=True)
    assert FI.read_appended(spark, str(tmp_path / "p")).filter("value = ''").count() == 25


@pytest.mark.parametrize("partitions", [1, 7])
def test_shards_are_exact_and_in_order(spark, tmp_path, partitions):
    """Every file but the last has the exact number of lines, over both splits."""
    rows = [("a" if i < 1300 else "b", i, f"line {i}" if i % 50 else "two\nparts") for i in range(2345)]
    df = spark.createDataFrame(rows, "split string, id long, text string").repartition(partitions)
    path = FI.write_text_shards(df, str(tmp_path / "t"), ["split", "id"], lines_per_file=100)
    files = {}
    for r in FI.shard_lines(spark, path).collect():
        files.setdefault((r.shard, r.file), []).append(r.value)
    assert [k for k, _ in sorted(files)] == list(range(24))
    assert [len(files[k]) for k in sorted(files)] == [100] * 23 + [45]
    assert [v for k in sorted(files) for v in files[k]] == [t.replace("\n", " ") for _, _, t in rows]


def test_text_shards_of_arrays(spark, tmp_path):
    """Texts are placed whole: an array gives a line for each value, and pieces of it cross files."""
    texts = [[f"{i} {k}" if k % 5 else None for k in range(n)] for i, n in enumerate([3, 0, 250, 1, 99, 47, 100, 100])] + [None, ["a\nb"]]
    rows = [("ab"[i % 2], i, words) for i, words in enumerate(texts)]
    df = spark.createDataFrame(rows, "split string, id long, w array<string>").repartition(5)
    path = FI.write_text_shards(df, str(tmp_path / "a"), ["split", "id"], "w", lines_per_file=100)
    want = [(w or "").replace("\n", " ") for _, _, words in sorted(rows, key=lambda r: r[:2]) for w in words or []]
    got = []
    for k in range(-(-len(want) // 100)):
        (part,) = (tmp_path / "a" / f"shard={k}").glob("part-*")
        got += part.read_text().split("\n")[:-1]
        assert len(got) == min(100 * (k + 1), len(want))
    assert got == want


def test_arrays_that_share_a_key_are_merged_by_position(spark):
    rows = [(1, ["a", "c"]), (1, ["b"]), (2, ["x"]), (None, ["p", "r"]), (None, ["q", "s", "t"]), (3, [])]
    got = {r.id: r.w for r in C.merged_arrays(spark.createDataFrame(rows, "id long, w array<string>"), ["id"], "w").collect()}
    assert got == {1: ["a", "b", "c"], 2: ["x"], None: ["p", "q", "r", "s", "t"], 3: []}


def test_appends_survive_a_failed_and_a_repeated_job(spark, tmp_path):
    path = str(tmp_path / "log")
    lines = spark.range(100).repartition(4).select(F.concat(F.lit("l"), "id").alias("text"), "id")
    FI.append_lines(lines, path, run_id="one")
    broken = lines.select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("text")).alias("text"))
    with pytest.raises(Exception, match="lost"):
        FI.append_lines(broken, path, run_id="two")
    assert FI.read_appended(spark, path).count() == 100  # nothing of the failed run
    FI.append_lines(lines, path, run_id="two")
    FI.append_lines(lines, path, run_id="two")
    got = FI.read_appended(spark, path).groupBy("run").count().collect()
    assert {r["run"]: r["count"] for r in got} == {"one": 100, "two": 100}
    assert FI.read_appended(spark, str(tmp_path / "none")).count() == 0


def test_nested_and_untidy_html(spark):
    from phonolake.sources import html as HT

    page = """<DIV data-x='1' class='lg other well well-lg'><a class="word-btn btn">one</a>
      <div><a class='btn x word-btn' href=a>two <b>bold</b> &amp; more</a><a class="btn">no</a></div>
      <div class="well-lg well"><a class="btn word-btn">inner</a></div><a class="btn word-btn">three</div>
      <a class="btn word-btn">outside</a><div class="well">x</div><p><div class="well well-lg"></div>
      <div class=col-sm-9><div><h5 id='h'>Page <i>2</i> / 31</h5></div><h5>Page 3 / 99</h5></div>"""
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<div class='well well-lg'><a class='btn word-btn'>open"), (4, "</div></a><")], "page_id long, html string")
    got = {(r.page_id, r.group_no): r.words for r in HT.extract_html_groups(pages).collect()}
    assert got == {(1, 0): ["one", "two bold &amp; more", "three"], (1, 1): ["inner"], (3, 0): ["open"]}
    assert {r.page_id: r.pages for r in HT.extract_page_count(pages).collect()} == {1: 31, 2: 0, 3: 0, 4: 0}
    deep = "<div class='well well-lg'>" * 3000 + "<a class='btn word-btn'>x</a>" + "</b>" * 3000
    assert HT.block_items(deep, ("div", frozenset({"well"})), ("a", frozenset()))[-1] == ["x"]


def test_html(spark):
    page = (
        '<div class="col-sm-9"><h5>Page <b>1</b>/ 12 </h5></div><div class="well well-lg"><a class="btn word-btn" href="#">ruff</a>\n'
        '<a class="btn word-btn">rough</a><a class="other">no</a></div><div class="well well-lg"></div>'
    )
    df = spark.createDataFrame([(1, page), (2, "<p>none</p>")], "page_id long, html string")
    assert [tuple(r) for r in HT.extract_html_groups(df).collect()] == [(1, 0, ["ruff", "rough"])]
    assert dict(HT.extract_page_count(df).collect()) == {1: 12, 2: 0}


def test_catalog():
    assert K.task_fields("qnli") == ("question", "sentence")
    assert set(K.BENCHMARK_TASKS) <= set(K.TASK_FIELDS) and set(K.TASK_METRIC) <= set(K.TASK_LABELS)
    with pytest.raises(ValueError):
        K.task_fields("nothing")


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "chunk_no", "text"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["train_val_test_split", "rhyme_negative_pairs", "metric_spearman", "phonetize_words", "sample_unrelated_pairs", "prepare_wikitext"])
def test_plans_have_no_cross_join_and_no_row_python(spark, name):
    text = plan(entry.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["filter_equals"](spark, DATA))
    assert "PushedFilters: [In(lang" in text.replace("And(", "") or "In(lang" in text
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in text


CHECKED = [
    "clean_text", "chunk_words", "dedup_exact", "filter_language", "train_val_test_split", "oversample_classes",
    "rhyme_groups", "sample_unrelated_pairs", "metric_roc_auc", "metric_hit_at_k", "phonetize_words", "encode_pair", "mlm_mask",
]


@pytest.mark.parametrize("name", CHECKED)
def test_queries_match_their_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    got = sorted(repr(tuple(r)) for r in entry.queries()[name](spark, DATA).select(*[F.col(f"`{c}`") for c in columns]).collect())
    assert got == want


def test_carriage_returns_are_written_and_read_back(spark, tmp_path):
    from phonolake.registry import texts

    rows = [(1, "a\rb"), (2, "a\r\nb\r"), (3, "\r"), (4, ' "q"\r, x '), (5, "plain\nline")]
    spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = texts.write_csv_splits(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == rows
    lines = {r.line: r.n for r in texts.append_lines(spark, str(tmp_path)).collect()}
    want = [line for _, t in rows for line in t.split("\n")]
    assert lines == {line: 2 * want.count(line) for line in want}
