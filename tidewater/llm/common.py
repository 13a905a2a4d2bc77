"""What the operators share: shared-folder tables, word rules, connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of other bytes than these.
SPACE = "\\x20\\x09-\\x0D"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once an application: they needn't have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).parents[1]
    to = Path(tempfile.mkdtemp()) / f"{top.name}.zip"
    with zipfile.ZipFile(to, "w") as bundle:
        for f in [top / "__init__.py", *(top / "llm").glob("*.py")]:
            bundle.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a session without a cluster gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lost executors cost no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Written tables of one piece of work, which are deleted together once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Like `cut`, for a table that no result reads."""
        self.paths.append(scratch(self.spark, name))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def clear(self) -> None:
        """Delete the tables."""
        while self.paths:
            remove(self.spark, self.paths.pop())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table, wherever it is stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let the driver drop what it holds of finished steps, so that Spark deletes their shuffle files now.

    Spark deletes them once the driver's JVM has found the step's objects unused, which else waits for
    that JVM to run short of memory; a long job would keep all its shuffles on disk until then. What
    Python lets go is unused for the JVM only in the next turn, and the files go a moment after that.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def n_words(text: Column) -> Column:
    """How many words a text has, without keeping them."""
    return F.size(words(text)).cast("long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for every node of edges (a, b), as a written table: label is the smallest node it reaches.

    Alternates large-star and small-star steps; each round is a written table, and hot nodes only
    meet in aggregations with map-side combine and in joins that can be split.
    """
    steps = Steps(edges.sparkSession)
    now = steps.cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = steps.cut(small, name)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    label = now.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    made = cut(label.union(label.select(F.col("label").alias("node"), "label").distinct()), name)
    steps.clear()
    return made
