"""An encyclopedia's API answers: search results as hits, and the lead section of an article as a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
LIMITATION = "Only Wikipedia section 0 was retrieved; later sections were not fetched or inspected."
_SEARCH = "query struct<search: array<struct<title: string, snippet: string, pageid: long>>>, error struct<code: string>"
_PARSE = "parse struct<title: string, text: string, revid: long, pageid: long>, error struct<code: string>"


def edition_error(edition: Column) -> Column:
    return F.when(~F.coalesce(edition.rlike("^[a-z]{2,3}(?:-[a-z0-9]{2,8})*$"), F.lit(False)), "INVALID_INPUT")


def article_url(edition: Column, title: Column) -> Column:
    return F.concat(F.lit("https://"), edition, F.lit(".wikipedia.org/wiki/"), F.replace(F.url_encode(F.replace(title, F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20")))


def _html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _shown(c: Column) -> Column:
    """A snippet's text: its marks are spans without attributes that matter, its entities the five of XML and blanks."""
    c = F.regexp_replace(c, "<[^>]*>", "")
    for raw, safe in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _valid_id(c: Column) -> Column:
    return F.coalesce(c > 0, F.lit(False))


def search_hits(answers: DataFrame, key: str, edition: str, body: str, limit: int = 10) -> DataFrame:
    """Search answers -> key, rank, title, url, snippet, error. An answer that is no such answer, or has one result without
    a title, snippet or page, is one row with PARSE_CHANGED."""
    rows = answers.select(key, F.col(edition).alias("e"), F.from_json(body, _SEARCH)["query"]["search"].alias("s"))
    whole = F.coalesce(F.forall("s", lambda x: F.coalesce((x["title"] != "") & x["snippet"].isNotNull(), F.lit(False)) & _valid_id(x["pageid"])), F.lit(False))
    good = rows.where(whole).select(key, "e", F.posexplode(F.slice("s", 1, limit)).alias("pos", "r"))
    hits = good.select(key, (F.col("pos") + 1).alias("rank"), F.col("r.title").alias("title"), article_url(F.col("e"), F.col("r.title")).alias("url"), _shown(F.col("r.snippet")).alias("snippet"), F.lit(None).cast("string").alias("error"))
    none = F.lit(None).cast("string")
    bad = rows.where(~whole).select(key, F.lit(None).cast("int").alias("rank"), none.alias("title"), none.alias("url"), none.alias("snippet"), F.lit("PARSE_CHANGED").alias("error"))
    return hits.unionByName(bad)


def lead_pages(answers: DataFrame, key: str, edition: str, body: str, revision: str | None = None) -> DataFrame:
    """Lead section answers -> key, url (of the revision), html, limitations, error. revision: the one that was asked for."""
    p = F.from_json(body, _PARSE)["parse"]
    rows = answers.select(key, F.col(edition).alias("e"), p.alias("p"), (F.col(revision) if revision else F.lit(None)).cast("long").alias("asked"))
    whole = F.coalesce((F.col("p.title") != "") & F.col("p.text").isNotNull(), F.lit(False)) & _valid_id(F.col("p.revid")) & _valid_id(F.col("p.pageid"))
    error = F.when(~whole | F.coalesce(F.col("asked") != F.col("p.revid"), F.lit(False)), "PARSE_CHANGED")
    title = _html(F.col("p.title"))
    html = F.concat(F.lit("<!doctype html><html><head><title>"), title, F.lit("</title></head><body><main><h1>"), title, F.lit("</h1>"), F.col("p.text"), F.lit("</main></body></html>"))
    url = F.concat(F.lit("https://"), F.col("e"), F.lit(".wikipedia.org/w/index.php?title="), F.url_encode("p.title"), F.lit("&oldid="), F.col("p.revid").cast("string"))
    return rows.select(key, F.when(error.isNull(), url).alias("url"), F.when(error.isNull(), html).alias("html"), F.when(error.isNull(), F.array(F.lit(LIMITATION))).alias("limitations"), error.alias("error"))
