"""Tables of work that goes in turns: each turn's table is written, so that its lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a session without a cluster gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Turns:
    """Written tables by name: the next of a name takes the place of the last, which is deleted then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}
        self.top = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/turns-{uuid.uuid4().hex}"

    def kept(self, df: DataFrame, name: str, by: list[str] = ()) -> DataFrame:
        """`df` as a written table, in folders by the columns `by`."""
        path = f"{self.top}/{name}-{uuid.uuid4().hex}"
        df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
        self.drop(name)
        self.held[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            if path := self.held.pop(name, None):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
