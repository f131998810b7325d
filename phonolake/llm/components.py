"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.llm.common import scratch_tables, stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, for every node of the links (``a``, ``b``).

    Labels travel along links and are then followed once themselves, so the number of rounds grows with the
    logarithm of the longest path. Each round is written to the checkpoint folder; a hot node is a hot join key
    only between two tables, which Spark splits.
    """
    spark = links.sparkSession
    with scratch_tables(spark):
        both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
        labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
        changed = True
        while changed:
            near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
            with scratch_tables(spark):
                moved = stored(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")), "moved")
                jump = moved.select(F.col("node").alias("label"), F.col("label").alias("further"))
                rows = moved.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old")
                labels = stored(rows, "labels", keep=True)
            changed = labels.where(F.col("label") != F.col("old")).limit(1).count() > 0
            labels = labels.select("node", "label")
        return stored(labels, "components", keep=True)
