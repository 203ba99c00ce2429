"""Committed runs (S3-S5): every output of a run becomes visible at once, and a repeated run replaces itself.

Outputs go to a folder of their own, which nobody looks at until one file of the manifest names it. That
file is written last, by one task, so it is there whole or not at all. A run that dies before leaves a folder
without a name; a run of the same name writes a higher version, and readers take the highest. Works where
renaming folders isn't atomic."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = ("run string, version long, token string, output string, fmt string, path string, schema string, n_rows long, n_chars long, digest long")


def _measures(df: DataFrame) -> list:
    """Rows, characters of all texts, and a digest that doesn't depend on the order of rows."""
    texts = [F.coalesce(F.length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    chars = sum(texts, F.lit(0)).cast("long")
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return [F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(chars), F.lit(0)).alias("n_chars"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("digest")]


class RunStore:
    """Runs under the folder ``base``: ``data/<run>/<token>/<output>`` and ``manifest``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _manifest(self) -> DataFrame:
        path = self._path(f"{self.base}/manifest")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.base}/manifest")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def manifest(self) -> DataFrame:
        """The outputs that readers see: those of the highest version of each run (of two of the same version, the higher token)."""
        newest = F.rank().over(Window.partitionBy("run").orderBy(F.desc("version"), F.desc("token")))
        return self._manifest().withColumn("_rank", newest).filter("_rank = 1").drop("_rank")

    def write(self, run: str, outputs: dict[str, tuple[DataFrame, str]]) -> dict[str, tuple[str, int]]:
        """Writes ``outputs`` (name to rows and file format; rows of ``text`` keep their order) as the new version of ``run`` and returns
        path and number of rows of each. Rows, characters and digest are observed while writing."""
        token, records = uuid.uuid4().hex, []
        version = (self._manifest().filter(F.col("run") == run).agg(F.max("version")).first()[0] or 0) + 1
        for name, (df, fmt) in outputs.items():
            path, seen = f"{self.base}/data/{run}/{token}/{name}", Observation()
            if fmt == "text":  # a row with line ends would come back as several: lines are what is written and counted
                df = df.select(F.explode(F.split(F.coalesce(F.col(df.columns[0]), F.lit("")), "\n", -1)).alias(df.columns[0]))
            df.observe(seen, *_measures(df)).write.format(fmt).save(path)
            records.append((run, version, token, name, fmt, path, df.schema.json(), *[seen.get[m] for m in ("n_rows", "n_chars", "digest")]))
        self.spark.createDataFrame(records, MANIFEST).coalesce(1).write.mode("append").json(f"{self.base}/manifest")
        return {r[3]: (r[5], r[7]) for r in records}

    def read(self, run: str, output: str, verify: bool = False) -> DataFrame:
        """An output of the newest version of ``run``. ``verify`` reads it once more and raises where it isn't what was written."""
        found = self.manifest().filter((F.col("run") == run) & (F.col("output") == output)).first()
        if found is None:
            raise ValueError(f"run {run!r} has no committed output {output!r}")
        df = self.spark.read.schema(T.StructType.fromJson(json.loads(found.schema))).format(found.fmt).load(found.path)
        if verify:
            got = df.agg(*_measures(df)).first()
            if tuple(got) != (found.n_rows, found.n_chars, found.digest):
                raise ValueError(f"{found.path} isn't what was committed: {tuple(got)} instead of {(found.n_rows, found.n_chars, found.digest)}")
        return df

    def read_all(self, output: str) -> DataFrame | None:
        """An output of all runs together, each run's newest version; None without any. Schemas and formats must agree."""
        found = self.manifest().filter(F.col("output") == output).select("fmt", "schema", "path").collect()  # a row a run
        if not found:
            return None
        schema = T.StructType.fromJson(json.loads(found[0].schema))
        return self.spark.read.schema(schema).format(found[0].fmt).load([r.path for r in found])

    def vacuum(self) -> list[str]:
        """Deletes the folders that readers don't see: dead runs and replaced versions. Not for use while a run is being written."""
        root = self._path(f"{self.base}/data")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        kept = {(r.run, r.token) for r in self.manifest().select("run", "token").distinct().collect()}
        gone = []
        for run in fs.listStatus(root) if fs.exists(root) else []:
            for token in fs.listStatus(run.getPath()):
                if (run.getPath().getName(), token.getPath().getName()) not in kept:
                    fs.delete(token.getPath(), True)
                    gone.append(token.getPath().toString())
        return sorted(gone)
