"""Tables kept in the folder that driver and executors share: written once, read back, versioned by batch."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; of our own only on a local master where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tokenledger-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its plan is cut, lost executors lose nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def discard(df: DataFrame) -> None:
    """Delete a table made by save() that nothing lazy refers to any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, parent)


class Versions:
    """Rows by key as batches of a stream leave them: each batch writes the rows that it changed, once, under its number.

    A batch reads what earlier ones wrote and nothing of its own, so it may run
    again, after a restart too: its files are replaced and the result is the
    same. Every so many batches all rows are written anew (those that keep lets
    through), so that a reader takes one full version and fewer than `every`
    small ones.
    """

    def __init__(self, path: str, keys: list[str], schema: str, every: int = 16):
        self.path, self.keys, self.every = path, keys, every
        self.schema = schema

    def _at(self, n: int) -> str:
        return f"{self.path}/full={n // self.every * self.every}/batch={n}"

    def _written(self, spark: SparkSession, n: int) -> list[int]:
        """The batches before n that have to be read."""
        first = max(0, (n - 1) // self.every * self.every)
        return [k for k in range(first, n) if exists(spark, self._at(k))]

    def before(self, spark: SparkSession, n: int, only: DataFrame | None = None) -> DataFrame:
        """The rows, one a key, that batches before n left; only: those that its columns, some of the keys, name.

        The full version has one row a key as it is: only what later batches
        wrote is grouped, and its keys are left out of the full one.
        """
        parts = [spark.read.schema(self.schema).parquet(self._at(k)).withColumn("batch_", F.lit(k)) for k in self._written(spark, n)]
        if only is not None:
            few = only.distinct()
            parts = [p.join(few, only.columns, "left_semi") for p in parts]
        if len(parts) < 2:
            return parts[0].drop("batch_") if parts else spark.createDataFrame([], self.schema)
        names = [c for c in parts[0].columns if c not in (*self.keys, "batch_")]
        last = functools.reduce(DataFrame.unionByName, parts[1:]).groupBy(*self.keys).agg(F.max_by(F.struct(*names), "batch_").alias("last_"))
        last = last.select(*self.keys, *[F.col("last_").getField(c).alias(c) for c in names])
        return parts[0].drop("batch_").join(last.select(*self.keys), self.keys, "left_anti").unionByName(last)

    def put(self, changed: DataFrame, n: int, keep: Column | None = None, remake: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Write what batch n changed; where a full version is due, all rows that keep lets through, as remake makes them."""
        spark = changed.sparkSession
        if n % self.every == 0:
            rest = self.before(spark, n)
            rest = rest if keep is None else rest.where(keep)
            changed = changed.unionByName(rest.join(changed.select(*self.keys), self.keys, "left_anti"))
            changed = remake(changed) if remake else changed
        changed.select(*[c.split()[0] for c in self.schema.split(", ")]).write.mode("overwrite").parquet(self._at(n))
        if n % self.every == 0 and n >= 2 * self.every:  # the version before the last is read by no batch that may still run
            remove(spark, f"{self.path}/full={n - 2 * self.every}")
