"""Hits inspected before anyone sees them: a verdict for each, and one for the whole answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import guard, policy
from .reading import ROW, identified

#: What of a hit is inspected, and for which use.
FIELDS = ("provider", "title", "snippet", "url", "display_url")
USE = "answer_with_citation"


def inspected(hits: DataFrame, additional: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """hits (provider, title, snippet, url, display_url and others) with decision, assurance, findings, reasons and
    reason_codes of each: a row in, a row out, equal rows too. The fields are one visible text, a line each, and lines end
    clauses. additional: verdicts (key, decision, reasons) of another guard."""
    rows = identified(hits, ROW)
    text = F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in FIELDS])
    segment = rows.select(ROW, F.lit(0).alias("ordinal"), F.lit("visible").alias("location"), text.alias("text"), F.lit(False).alias("truncated"), F.lit(True).alias("lines"), F.lit(0).alias("omitted"))
    verdicts = guard.inspect(segment, ROW, use=USE).select(ROW, "decision", "assurance", "findings", "reasons", "reason_codes")
    if additional is not None:
        verdicts = policy.restricted(rows.select(ROW, key).join(verdicts, ROW), additional, key).drop(key)
    return rows.join(verdicts, ROW).drop(ROW)


def shown(inspected_hits: DataFrame) -> DataFrame:
    """The hits that may be seen."""
    return inspected_hits.where(F.col("decision").isin(*policy.VISIBLE_DECISIONS))


def answers(inspected_hits: DataFrame, query: str) -> DataFrame:
    """Per query: visible and withheld hits, decision and reasons of the whole answer. A withheld hit makes it a warning, or deny
    if none is left; the reasons are those of all hits, each once, and how many were withheld."""
    # one grouping for all of it, so that the hits are inspected once
    both = policy.withheld(inspected_hits, query, F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))
    more = F.when(F.col("withheld") > 0, F.array(F.concat(F.col("withheld").cast("string"), F.lit(" search result(s) were withheld by the context guard.")))).otherwise(F.array().cast("array<string>"))
    return both.select(query, "visible", "withheld", "decision", F.concat("reasons", more).alias("reasons"))
