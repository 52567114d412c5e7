"""Places that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared one that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent and everything runs in this process (tests) a folder of this
    machine stands in for it; elsewhere its absence is an error, as executors would not see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/ledgerloom-shared"
    return f"{base.rstrip('/')}/ledgerloom/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame, purpose: str) -> DataFrame:
    """Write df to the shared folder and read it again: no lineage, and nothing is computed twice."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file systems; one that is absent is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Shelf:
    """The tables that one piece of work writes to the shared folder, to give up those that nothing reads any more.

    Only a table whose readers have all been written themselves may go: it could not be computed again.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame, purpose: str) -> DataFrame:
        path = shared_dir(self.spark, purpose)
        df.write.parquet(path)
        self.paths.setdefault(purpose, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *purposes: str) -> None:
        for purpose in purposes:
            for path in self.paths.pop(purpose, ()):
                delete(self.spark, path)

    def clear(self) -> None:
        self.drop(*list(self.paths))
