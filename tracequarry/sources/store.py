"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of this machine if Spark runs on it alone."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tracequarry")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(own)
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def workspace(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and a lost executor loses nothing."""
    path = workspace(df.sparkSession, what)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a table of written() whose last reader is done."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


COMMIT = "number int, name string, instead boolean"


class Generations:
    """Tables that grow by whole generations. A generation counts once its commit is written, which is one append of one row: what a
    failed writer leaves behind is never read. Old generations are never rewritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self) -> list[str]:
        """Names of the generations that count, in order; one row an update."""
        if not exists(self.spark, f"{self.path}/commits"):
            return []
        done = sorted(self.spark.read.schema(COMMIT).json(f"{self.path}/commits").collect(), key=lambda r: r.number)
        first = max((k for k, r in enumerate(done) if r.instead), default=0)
        return [r.name for r in done[first:]]

    def begin(self) -> str:
        """The name of a new generation; nobody reads it before it is committed."""
        return uuid.uuid4().hex

    def commit(self, name: str, instead: bool = False) -> None:
        """Makes a generation count: beside the others, or in their place."""
        number = self.spark.read.schema(COMMIT).json(f"{self.path}/commits").count() if self.commits() else 0
        self.spark.createDataFrame([(number, name, instead)], COMMIT).coalesce(1).write.mode("append").json(f"{self.path}/commits")

    def write(self, df: DataFrame, name: str, table: str) -> None:
        df.write.parquet(f"{self.path}/{table}/generation={name}")

    def read(self, table: str, schema: str, names: list[str] | None = None) -> DataFrame:
        """All rows of a table that are committed, or those of the generations named, by one scan."""
        names = self.commits() if names is None else names
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{table}/generation={n}" for n in names))


def exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.format("binaryFile").load(path).limit(0).collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True
