"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import Scratch


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges`` (``a long, b long``): the least node of its component.

    Each round a node takes the least label around it, then the label of its label, until
    nothing changes. Loops and repeated edges do no harm; edges with a null end are left out."""
    scratch = Scratch(edges.sparkSession)
    both = scratch.cut(edges.filter("a is not null and b is not null and a <> b")
                       .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
                       .select("e.*").distinct())
    labels = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        around = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("new"))
        lower = scratch.cut(lower)
        jump = lower.join(lower.select(F.col("node").alias("new"), F.col("new").alias("next")), "new")
        after = scratch.cut(jump.select("node", F.least("new", "next").alias("label"), (F.least("new", "next") != F.col("label")).alias("moved")))
        moved = after.filter("moved").limit(1).count()
        scratch.drop(labels, lower)
        labels = after
        if not moved:
            return labels.select("node", "label")
