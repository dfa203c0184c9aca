"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only a local session may leave that unset; a cluster's machines share no other."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = context.getConf().get("spark.checkpoint.dir")
        if not path and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    path = f"{context.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: Folders that :func:`scratch` has named and :func:`release` has not removed, oldest first.
_made: list[str] = []


def made() -> int:
    """How many folders there are: what :func:`release` takes as the beginning of what came later."""
    return len(_made)


def release(since: int, *keep: DataFrame) -> None:
    """Remove the folders from number ``since`` on, but for those that ``keep`` reads. Results are lazy: what others read
    must be written elsewhere by now."""
    plain = lambda path: path.rpartition(":")[2].lstrip("/")
    read = [plain(f) for df in keep for f in df.inputFiles()]
    for path in _made[since:]:
        if any(f.startswith(plain(path) + "/") for f in read):
            continue
        spark = SparkSession.getActiveSession()
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        _made.remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: cuts the lineage and resets size estimates, which grow with every round of a loop."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """A table that grows by a delta in each round, with a column ``open`` of rows that the next round goes on with.

    Each delta is a folder of its own, and a round's rows are counted as they are written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.many, self.schema = spark, scratch(spark, name), 0, None

    def add(self, rows: DataFrame) -> int:
        """Write a round's rows; returns how many of them are open."""
        counted = Observation()
        rows.observe(counted, F.count_if("open").alias("n")).write.parquet(f"{self.path}/round={self.many}")
        self.schema = self.schema or rows.schema
        self.many += 1
        return counted.get["n"]

    def last(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/round={self.many - 1}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/round={k}" for k in range(self.many)])
