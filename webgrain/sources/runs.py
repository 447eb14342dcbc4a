"""Recorded runs as JSON lines, and reports as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

RUN = "scenario_id string, category string, mode string, repeat int, status string, pipeline_ms double, total_ms double, measurements array<struct<stage string, model string, duration_ms double, error string>>"


def read_runs(spark: SparkSession, path: str, schema: str = RUN) -> DataFrame:
    """One run per line; a line that is no JSON object is a row whose broken column holds it."""
    return spark.read.schema(f"{schema}, broken string").option("columnNameOfCorruptRecord", "broken").option("mode", "PERMISSIVE").json(path)


def safe_cells(report: DataFrame) -> DataFrame:
    """report with every text cell that a spreadsheet would take for a formula made plain."""
    return report.select(*[text.formula_safe(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in report.schema])


def write_report(report: DataFrame, path: str) -> None:
    """The report as folders of JSON lines, CSV with a header, and a Markdown table in as many files as there are parts."""
    report.write.mode("overwrite").json(f"{path}/json")
    flat = report.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{f.name}`") for f in report.schema])
    safe_cells(flat).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    cells = [F.regexp_replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), "\\s*\\n\\s*", " ") for c in flat.columns]
    flat.select(F.concat(F.lit("|"), F.concat_ws("|", *cells), F.lit("|")).alias("value")).write.mode("overwrite").text(f"{path}/markdown")
