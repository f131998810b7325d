from datetime import datetime, timedelta

from pyspark.sql import functions as F

from phonolake import streaming as S
from phonolake.operators import language as L
from phonolake.operators import lexicon as G

START = datetime(2024, 1, 1)


def put(spark, folder, rows):
    """One file of (minutes, text) rows."""
    data = [(START + timedelta(minutes=m), t) for m, t in rows]
    spark.createDataFrame(data, "at timestamp, text string").coalesce(1).write.mode("append").parquet(folder)


def run(spark, build, folder, out, checkpoint):
    """Read what is new since the checkpoint; the query's last progress with state."""
    stream = build(spark.readStream.schema("at timestamp, text string").parquet(folder))
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [p for p in query.recentProgress if p["stateOperators"]]


def test_transcription_and_language_restart(spark, tmp_path):
    words = spark.createDataFrame([("hello", ["h", "@", "l", "oU"]), ("le", ["l", "@"])], "word string, phonemes array<string>")
    labelled = spark.createDataFrame([("hello the", "en"), ("le chat", "fr")], "text string, lang string")
    profile = L.profile_table(labelled, ["en", "fr"])

    def build(df):
        return S.transcribe_stream(S.filter_language_stream(df, profile), words)

    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    first, second = [(0, "hello le hello"), (1, "le chat")], [(2, "the hello"), (3, "zzz")]
    put(spark, folder, first)
    run(spark, build, folder, out, check)
    assert [r["text"] for r in spark.read.parquet(out).collect()] == ["h@loU l@ h@loU"]
    put(spark, folder, second)
    run(spark, build, folder, out, check)  # from its checkpoint: the first file is not read again
    rows = spark.createDataFrame(list(enumerate(t for _, t in first + second)), "doc_id long, text string")
    batch = G.phonetize_words(L.filter_language(rows, profile), words)
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == sorted(r["text"] for r in batch.collect())


def test_duplicates_restart_late_rows_and_state(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def build(df):
        return S.dedup_stream(df, "at", "10 minutes")

    def texts():
        return sorted(r["text"] for r in spark.read.parquet(out).collect())

    put(spark, folder, [(0, "a"), (1, "b"), (2, "a")])
    run(spark, build, folder, out, check)
    assert texts() == ["a", "b"]
    put(spark, folder, [(5, "a"), (6, "c")])
    run(spark, build, folder, out, check)  # the state survives the restart
    assert texts() == ["a", "b", "c"]
    put(spark, folder, [(60, "d")])
    progress = run(spark, build, folder, out, check)
    put(spark, folder, [(61, "a"), (3, "late")])
    progress += run(spark, build, folder, out, check)  # "a" is new again, the late row is dropped
    assert texts() == ["a", "a", "b", "c", "d"]
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 2
    assert spark.read.parquet(out).where(F.col("text") == "late").count() == 0
