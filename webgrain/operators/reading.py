"""The whole way from captured responses to documents: source, decoding, screening, extraction, and which error counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources import captures as source
from . import guard, pages, policy

NO_STYLES = policy.LIMITATIONS[1]
ROW = "__row"


def references(captures: DataFrame, key: str, extra: list[str]) -> DataFrame:
    """What the request itself brings: URLs, and the provider and snippet of its hit, as attributes."""
    texts = F.array_compact(F.array(*[F.col(c) for c in ("requested_url", "final_url", *extra)]))
    rows = captures.select(key, F.posexplode(texts).alias("ordinal", "text"))
    return rows.select(key, "ordinal", F.lit("attribute").alias("location"), "text", F.lit(False).alias("truncated"), F.lit(False).alias("lines"), F.lit(0).alias("omitted"))


def identified(rows: DataFrame, name: str) -> DataFrame:
    """rows with a text of its own for each: a hash of all its fields, and a running number among equal rows. Rows that
    are equal are interchangeable, so a task that is run again names them alike."""
    plain = [F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in rows.schema]
    one, two = F.xxhash64(*plain), F.xxhash64(F.lit(1), *plain)
    n = F.row_number().over(Window.partitionBy(one, two).orderBy(one))
    return rows.withColumn(name, F.concat_ws("-", F.hex(one), F.hex(two), n.cast("string")))


def read(captures: DataFrame, key: str, *, use: str = "answer_with_citation", most: int = 20_000, extra: list[str] | None = None, additional: DataFrame | None = None) -> DataFrame:
    """captures (key, requested_url, final_url, status, content_type, headers, body, fetch_method; extra: more texts of the
    request) -> key, url, title, text, excerpt, characters, truncated, fetch_method, decision, warning_categories, reason_codes, error, reason.

    A row in, a row out, also for null and repeated keys and for equal rows. One error per row, in the order in which the
    stages are: source, decoding, the tree's limits, GUARD_DENIED, and only then the content's own. A row with an error
    has no text. additional: verdicts (key, decision, reasons) of another guard, as hooks.guarded gives them; where its
    error is not null, the row's is GUARD_FAILED.
    """
    given = list(dict.fromkeys([key, "requested_url", "final_url", "status", "content_type", "headers", "body", "fetch_method", *(extra or [])]))
    captures = identified(captures.select(*[F.col(f"`{c}`") for c in given]), ROW)
    checked = source.decoded(source.checked(captures))
    kinds = checked.select(ROW, F.col(key).alias("__key"), "fetch_method", F.col("final_url").alias("url"), "text", "media_type", F.coalesce("source_error", "decode_error").alias("stopped"))
    usable = kinds.where("stopped IS NULL").select(ROW, "url", "text", "media_type")
    read_ = pages.extracted(usable, ROW, html="text", media_type="media_type", most=most, deal=False)
    content = guard.inspect(pages.inspected(read_, ROW), ROW, use=use).withColumn("ordinal", F.lit(1))
    asked = guard.inspect(references(captures, ROW, extra or []), ROW, use=use).withColumn("ordinal", F.lit(0))
    verdicts = policy.merged_verdicts(asked.unionByName(content), ROW)
    if additional is not None:
        verdicts = verdicts.join(captures.select(ROW, F.col(key).alias("__key")), ROW)
        verdicts = policy.restricted(verdicts, additional.withColumnRenamed(key, "__key"), "__key").drop("__key")
    failed = F.lit(None).cast("string")
    verdicts = policy.public_verdict(verdicts, ROW).drop("trust", "tainted")
    made = read_.select(ROW, "title", F.coalesce("markdown", "text").alias("text"), "excerpt", "characters", "truncated", F.col("error").alias("content_error"), "reason")
    out = kinds.select(ROW, "__key", "url", "stopped", "fetch_method").join(verdicts, ROW, "left").join(made, ROW, "left")
    if additional is not None and "error" in additional.columns:
        broken = additional.where(F.col("error").isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("__broken")).distinct()
        out = out.join(broken, F.col("__key") == F.col("__broken"), "left")
        failed = F.when(F.col("__broken").isNotNull(), "GUARD_FAILED")
    limits = F.when(F.col("content_error").isin("RESPONSE_TOO_LARGE", "GUARD_FAILED"), F.col("content_error"))
    denied = F.when(~F.col("decision").isin(*policy.VISIBLE_DECISIONS), "GUARD_DENIED")
    error = F.coalesce("stopped", limits, failed, denied, "content_error")
    shown = lambda c: F.when(error.isNull(), F.col(c)).alias(c)
    return out.select(F.col("__key").alias(key), "url", shown("title"), shown("text"), shown("excerpt"), shown("characters"), shown("truncated"), "fetch_method", "decision", "warning_categories", "reason_codes", error.alias("error"), F.when(error == "CONTENT_INSUFFICIENT", F.col("reason")).alias("reason"))
