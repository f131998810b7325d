import subprocess
import sys
import time

from pyspark.sql import functions as F

from phonolake.llm import latent, spotsigs, suffix_dedup
from phonolake.llm.common import DROP_SHUFFLES, SCOPES, scratch_tables, stored


def test_large_batches_in_a_fresh_process():
    """Nothing else may have imported the compute module that cutting needs."""
    code = """
import pyarrow as pa
from phonolake.llm.common import small_batches
batch = pa.record_batch([pa.array(range(3000)), pa.array(["x" * 3000] * 3000)], ["doc_id", "text"])
got = list(small_batches([batch], "text"))
assert sum(b.num_rows for b in got) == 3000 and len(got) == 3, [b.num_rows for b in got]
"""
    subprocess.run([sys.executable, "-c", code], check=True)


def test_batches_above_the_cut(spark):
    """3,000 texts of 3 KB in one partition."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", "id", F.repeat(F.lit("word of the text "), 180)).alias("text")).coalesce(1)
    items = spark.createDataFrame([(1, "quite another item that no document holds at all")], "item_id long, text string")
    assert latent.contamination(docs, items).count() == 0
    assert spotsigs.fingerprint_edits(docs).count() == 3000


def test_scopes_delete_what_is_not_kept(spark):
    rows = spark.range(10)
    with scratch_tables(spark):
        with scratch_tables(spark):
            gone, kept = stored(rows, "gone"), stored(rows, "kept", keep=True)
            files = gone.inputFiles()
        assert kept.count() == 10 and len(SCOPES.get()) == 1
        folder = files[0].rsplit("/", 1)[0].removeprefix("file:")
        import os

        assert not os.path.exists(folder)
        last = stored(kept, "last", keep=True)
    assert last.count() == 10 and not SCOPES.get()


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(k).getName() for k in range(files.size())) if f.startswith("shuffle_")}


def wait_until(done):
    for _ in range(100):
        if done():
            return True
        time.sleep(0.1)
    return False


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    counts = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert wait_until(lambda: shuffle_files(spark) <= before) and counts.count() == 7
    assert spark.conf.get(DROP_SHUFFLES, None) is None
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", "id", F.repeat(F.lit("one of the words "), 40)).alias("text"))
    with scratch_tables(spark):
        before = shuffle_files(spark)
        done = suffix_dedup.remove_repeats(docs)
        assert wait_until(lambda: shuffle_files(spark) <= before)
        assert len(SCOPES.get()[-1]) == 1 and done.where("n_removed > 0").count() == 300  # only the runs are left
