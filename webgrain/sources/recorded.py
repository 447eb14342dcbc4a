"""Recordings as folders of JSON lines, a manifest beside each: runs, and responses as they were captured.

Spark's own reader lists, splits and filters the files, so a recording may lie in any store that Spark reads: conditions on
columns reach the parser, conditions on the run leave out whole files, and a stream keeps its place as a file stream does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import RUN

RESPONSE = "capture_id long, requested_url string, final_url string, status int, content_type string, headers map<string,string>, body binary, fetch_method string"
# What must agree of two manifests, and what is taken where one does not say.
COMPARED = ("model", "judgeModel", "serviceTier", "sdkVersion", "scenariosSha256", "librarySha256", "evaluationPolicy")
DEFAULTS = {"evaluationPolicy": "dimensions-v1"}
MODEL_STAGES, ANSWER_STAGES = ("query", "answer", "assess"), ("answer", "assess")
_MANIFEST, _LINES = "manifest.json", "*.json*"


def _run() -> F.Column:
    """The folder that a file lies in; folders named `run=x` are x."""
    return F.regexp_extract(F.col("_metadata.file_path"), "/(?:run=)?([^/]+)/[^/]+$", 1)


def _lines(reader, path: str, schema: str) -> DataFrame:
    options = {"columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE", "recursiveFileLookup": "true", "pathGlobFilter": _LINES}
    rows = reader.schema(f"{schema}, broken string").options(**options).json(path)
    return rows.where(F.col("_metadata.file_name") != _MANIFEST).withColumn("run", _run())


def recorded_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of all folders below path with run, the folder's name. A line that is no JSON object is a row whose broken column
    holds it; a folder without lines has no row."""
    return _lines(spark.read, path, RUN)


def recorded_responses(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Captured responses, bodies as bytes (Base64 in the files), with run and broken; stream: files as they arrive."""
    return _lines(spark.readStream if stream else spark.read, path, RESPONSE)


def write_recorded(rows: DataFrame, path: str, run: str = "run") -> None:
    """rows as JSON lines, a folder `run=x` for each run; runs that are there already get more files."""
    rows.withColumnRenamed(run, "run").write.mode("append").partitionBy("run").json(path)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """run, key, value, broken: what each manifest below path says, the entries of an object under `name.entry`.

    A manifest that is no JSON object is one row with broken, its text. An entry that is null has a null value.
    """
    text = spark.read.options(wholetext="true", recursiveFileLookup="true", pathGlobFilter=_MANIFEST).text(path).select(_run().alias("run"), "value")
    read = text.select("run", F.when(F.trim("value").startswith("{"), F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})).alias("m"), "value")
    broken = read.where("m IS NULL").select("run", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), F.col("value").alias("broken"))
    flat = read.where("m IS NOT NULL").select("run", F.explode("m").alias("key", "value"))
    inner = F.when(F.col("value").startswith("{"), F.from_json("value", "map<string,string>"))
    flat = flat.select("run", "key", "value", inner.alias("inner"))
    plain = flat.where("inner IS NULL").select("run", "key", "value")
    nested = flat.where("inner IS NOT NULL").select("run", "key", F.explode("inner").alias("entry", "value")).select("run", F.concat_ws(".", "key", "entry").alias("key"), "value")
    return plain.unionByName(nested).withColumn("broken", F.lit(None).cast("string")).unionByName(broken)


def manifest_differences(said: DataFrame, before: str, after: str, group: list[str] | None = None) -> DataFrame:
    """key, before, after, same for what must agree of two runs' manifests: the fixed keys, whether said or not, and every hash.

    What neither says is the same. group: columns that keep several pairs of runs apart.
    """
    by = [*(group or []), "key"]
    side = lambda name: said.where((F.col("run") == name) & F.col("key").isNotNull()).groupBy(*by).agg(F.first("value").alias("value"))
    a, b = (side(name).withColumnRenamed("value", column) for name, column in ((before, "before"), (after, "after")))
    both = a.join(b, by, "full")
    pairs = said.where(F.col("run").isin(before, after)).select(*(group or []), F.explode(F.array(*map(F.lit, COMPARED))).alias("key")).distinct()
    rows = both.where(F.col("key").startswith("hashes.")).unionByName(pairs.join(both, by, "left"))
    default = F.when(F.lit(False), F.lit(""))
    for key, value in DEFAULTS.items():
        default = default.when(F.col("key") == key, value)
    rows = rows.withColumns({c: F.coalesce(c, default) for c in ("before", "after")})
    return rows.withColumn("same", F.col("before").eqNullSafe(F.col("after")))


_CASE = ["scenario_id", "repeat"]


def cohort_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """scenario_id, repeat, before_n, after_n where two runs did not do the same; no row if they may be compared."""
    sides = [r.groupBy(*_CASE).agg(F.count("*").alias("n")).select(*[F.col(c).alias(f"{c}_{k}") for c in _CASE], F.col("n").alias(f"n_{k}")) for k, r in enumerate((before, after))]
    same = [F.col(f"{c}_0").eqNullSafe(F.col(f"{c}_1")) for c in _CASE]
    rows = sides[0].join(sides[1], same[0] & same[1], "full")
    n = [F.coalesce(f"n_{k}", F.lit(0)) for k in range(2)]
    return rows.where(n[0] != n[1]).select(*[F.coalesce(f"{c}_0", f"{c}_1").alias(c) for c in _CASE], n[0].alias("before_n"), n[1].alias("after_n"))


def _spent(stages: tuple[str, ...]) -> F.Column:
    took = F.filter("measurements", lambda m: m["stage"].isin(*stages))
    return F.aggregate(took, F.lit(0.0), lambda total, m: total + F.coalesce(m["duration_ms"], F.lit(0.0)))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """A row per run of after, with the one of before that has its scenario and repetition: before and after (status), mode,
    old_ms, ms, model_ms, wait_ms (what is no model's time, 0 at least), query_ms and answer_calls.

    Of several rows of before for one case, the smallest status and time count. A null scenario or repetition is equal to
    none; cohort_differences tells before whether every case has its other.
    """
    old = before.groupBy(*_CASE).agg(F.min(F.struct("status", "pipeline_ms")).alias("old"))
    rows = after.join(old, _CASE, "left")
    model = _spent(MODEL_STAGES)
    return rows.select(
        *_CASE, "mode", F.col("old.status").alias("before"), F.col("status").alias("after"), F.col("old.pipeline_ms").alias("old_ms"), F.col("pipeline_ms").alias("ms"),
        model.alias("model_ms"), F.greatest(F.lit(0.0), F.col("pipeline_ms") - model).alias("wait_ms"), _spent(("query",)).alias("query_ms"),
        F.size(F.filter("measurements", lambda m: m["stage"].isin(*ANSWER_STAGES))).alias("answer_calls"),
    )
