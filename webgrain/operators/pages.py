"""Captured bodies to readable rows: one Arrow pass per body, everything after it in Columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import parts, short_batches
from ..functions.bodies import body

SEGMENT = "array<struct<location string, text string, truncated boolean, lines boolean>>"
#: What is said of a body, with its types.
FIELDS = {
    "title": "string", "text": "string", "markdown": "string", "score": "long", "characters": "long", "truncated": "boolean", "excerpt": "string",
    "dynamic": "boolean", "error": "string", "reason": "string", "omitted": "long", "segments": SEGMENT,
}
MAX_HTML_BYTES = 2_000_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt over the cores by its key if it is a scan of less than a partition for each core: a small table in one file
    would keep one core busy. A larger table is not shuffled, nor is one that has been dealt, joined or grouped already.

    The plan and its estimated size decide, so that nothing is run.
    """
    session = df.sparkSession
    cores, node = session.sparkContext.defaultParallelism, df._jdf.queryExecution().optimizedPlan()
    most = cores * session._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    scan = node.nodeName() in ("LogicalRelation", "DataSourceV2ScanRelation") and not node.isStreaming()
    return df.repartition(cores, key) if scan and int(node.stats().sizeInBytes()) < most else df


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", media_type: str | None = None, fields: list[str] | None = None, most: int = 20_000, deal: bool = True) -> DataFrame:
    """key, url and the fields of each body; media_type is a column, without it all bodies are HTML.

    A body above the byte limit is an error row and never parsed: its omitted is 1, as nothing of it was inspected. A
    null body is an empty one. Markdown is rendered only if one of the fields needs it. deal: see spread().
    """
    short_batches(pages.sparkSession)
    fields = list(fields or FIELDS)
    renders = any(f in ("markdown", "truncated", "characters", "excerpt") for f in fields)
    kind = F.lit("text/html") if media_type is None else F.coalesce(media_type, F.lit("text/plain"))
    pages = spread(pages, key) if deal else pages
    rows = pages.select(F.col(key), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"), kind.alias("kind"))
    schema = f"{key} {rows.schema[0].dataType.simpleString()}, url string, {', '.join(f'{f} {FIELDS[f]}' for f in fields)}"
    segment = pa.list_(pa.struct([("location", pa.string()), ("text", pa.string()), ("truncated", pa.bool_()), ("lines", pa.bool_())]))
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), SEGMENT: segment}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            columns = (batch.column(c).to_pylist() for c in ("html", "url", "kind"))
            made = [body(h, k, u or "", most, renders) for h, u, k in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("url"), *[pa.array([m[f] for m in made], kinds[FIELDS[f]]) for f in fields]], [key, "url", *fields])

    fits = F.octet_length("html") <= MAX_HTML_BYTES
    fixed = {"error": F.lit("RESPONSE_TOO_LARGE"), "omitted": F.lit(1), "truncated": F.lit(False), "dynamic": F.lit(False), "segments": F.array()}
    large = rows.where(~fits).select(key, "url", *[fixed.get(f, F.lit(None)).cast(FIELDS[f]).alias(f) for f in fields])
    return rows.where(fits).mapInArrow(run, schema).union(large)


#: The fields that inspected() needs.
INSPECTED = ["omitted", "segments"]


def inspected(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """All segments of each extracted body, the visible one first: key, ordinal, location, text, truncated, lines, omitted.

    Each body has one row at least, also one that could not be read: its text is then empty, and its omitted above 0.
    """
    nothing = F.array(F.struct(F.lit("visible").alias("location"), F.lit("").alias("text"), F.lit(False).alias("truncated"), F.lit(False).alias("lines")))
    some = pages.select(key, F.col("omitted"), F.posexplode(F.when(F.size("segments") > 0, F.col("segments")).otherwise(nothing)).alias("ordinal", "s"))
    return some.select(key, "ordinal", "s.location", "s.text", "s.truncated", "s.lines", "omitted")
