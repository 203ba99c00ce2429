"""Shared helpers of the corpus operators: table readers, shared scratch tables, spread ranks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from estatelens.session import ensure_checkpoint_dir

# Rows that one task of a ranking window sorts; larger groups are split into parts of this size.
ROWS_PER_TASK = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables in the cluster's shared checkpoint folder.

    ``cut`` writes a DataFrame as Parquet and reads it back, so later stages start
    from files that every executor sees instead of a lineage. ``drop`` removes a
    table that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
        self.made: dict[int, tuple[DataFrame, str]] = {}

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.made)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            _, path = self.made.pop(id(t), (None, None))
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def spread_rank(df: DataFrame, group: list[str], salt: Column, order: list[Column], name: str,
                rows_per_task: int = ROWS_PER_TASK, few_groups: bool = False) -> DataFrame:
    """``df`` with ``name``: a gapless rank from 0 within ``group``, without any task sorting a whole group.

    Groups are cut into parts by ``salt`` (a non-negative long); a part's rows are ranked
    by ``order`` and shifted by the sizes of the parts before it. The number of parts
    follows the size of the group, so a group with a third of all rows is spread.
    ``group`` columns must not be null. ``few_groups``: their number is known to be small, so their
    sizes are sent to all executors."""
    parts, part, before = fresh(df, "_parts", "_part", "_before")
    keys = [F.col(c) for c in group]
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows_per_task).alias(parts))
    split = df.join(F.broadcast(sizes) if few_groups else sizes, group).withColumn(part, salt % F.col(parts)).drop(parts)
    counts = split.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(before))
    counts = counts.withColumn(before, F.sum(before).over(W.partitionBy(*keys).orderBy(part)) - F.col(before))
    ranked = split.withColumn(name, F.row_number().over(W.partitionBy(*keys, part).orderBy(*order)) - 1)
    return (ranked.join(counts, [*group, part])
            .withColumn(name, F.col(name) + F.col(before)).drop(part, before))
