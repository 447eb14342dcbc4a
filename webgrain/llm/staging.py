"""Tables cut from their lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Row groups of staged tables: what a task buffers of a table that it writes.
GROUP_BYTES = 16 << 20
#: A side is broadcast only if its rows take at most about that many bytes in memory.
BROADCAST_BYTES = 64 << 20
_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local session gets a folder of this process's own;
    on a cluster no folder of one machine would do, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='webgrain-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


class Stage:
    """Tables written for one run of an operator. drop() removes those that its result does not read."""

    def __init__(self, spark: SparkSession, name: str):
        if spark.conf.get(BATCH, "10000") == "10000":  # rows are texts, so batches are kept short
            spark.conf.set(BATCH, "1000")
            spark.conf.set(BATCH_BYTES, "8m")
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n, self.paths = 0, []

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes df as Parquet and reads it back, so that a lost executor costs one stage and not the whole plan."""
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        self.paths.append(path)
        return out

    def bytes(self, df: DataFrame) -> int:
        """Bytes of a staged table's files."""
        fs, path = _fs(self.spark, df._stage_path)
        return fs.getContentSummary(path).getLength()

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            fs, path = _fs(self.spark, df._stage_path)
            fs.delete(path, True)

    def keep(self, *dfs: DataFrame) -> None:
        """Removes all tables of this run but these, once the result reads no other."""
        for path in {*self.paths} - {df._stage_path for df in dfs}:
            fs, where = _fs(self.spark, path)
            fs.delete(where, True)
        self.paths = [df._stage_path for df in dfs]

    def in_memory(self, df: DataFrame) -> int:
        """About how many bytes a staged table's rows take in memory: 8 for each fixed value, and for texts and arrays
        what the files hold, four times over."""
        files = self.bytes(df)
        fixed = sum(isinstance(f.dataType, _FIXED) for f in df.schema)
        return self.spark.read.schema(df.schema).parquet(df._stage_path).count() * (32 + 8 * fixed + 16 * (len(df.schema) - fixed)) + (4 * files if fixed < len(df.schema) else 0)

    def small(self, df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
        """df with a broadcast hint if its rows are within the bound; beyond it, Spark shuffles."""
        return F.broadcast(df) if self.bytes(df) <= most and self.in_memory(df) <= most else df


def clean(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns that an operator reads, whatever else the table holds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each name, one that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        found = f"__{name}"
        while found.lower() in taken:
            found += "_"
        taken.add(found.lower())
        out.append(found)
    return out
