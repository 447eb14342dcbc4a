"""Names, functions and SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.pages import spread
from ..sources import shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder, as batches or as streams."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    #: Tables of texts, by the column that deals their rows over the cores if the scan has fewer partitions than there are.
    TEXTS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}

    def __call__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(table, self.TEXTS[name]) if name in self.TEXTS else table

    def stream(self, name: str) -> DataFrame:
        """The table's files as they arrive, of a single file or of a folder. The file source takes a path that is no pattern
        for a folder, so the path is written as a pattern that only this table meets."""
        return self.spark.readStream.schema(self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema).parquet(f"{self.folder}/{name}.parque[t]")

    def drained(self, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
        """All that a stream gives for what is there now, written to the shared folder as its state is."""
        place = shared.run_dir(self.spark, f"streams-{name}")
        out = stream.writeStream.option("checkpointLocation", f"{place}/state").outputMode(mode).trigger(availableNow=True)
        if mode == "append":
            out = out.format("parquet").option("path", f"{place}/rows")
        else:  # the last result replaces those before, and the empty one if there is nothing to read
            self.spark.createDataFrame([], stream.schema).write.parquet(f"{place}/rows")
            out = out.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{place}/rows"))
        out.start().awaitTermination()
        return self.spark.read.schema(stream.schema).parquet(f"{place}/rows")


def query(sql: str | None = None):
    """Registers a function (spark, read) -> DataFrame under its name; read gives a table by its name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
