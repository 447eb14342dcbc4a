"""Captured responses as a source: what is checked before a body is decoded, and what is kept of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hosts
from . import payloads

# Limits of a response.
MAX_URL, MAX_BODY, MAX_WIRE, MAX_REDIRECTS, MAX_HEADERS, MAX_HEADER_BYTES = 2048, 10_000_000, 1_000_000, 3, 100, 64 * 1024
METHODS = ("http", "playwright")
_TOKEN, _MEDIA = "^[!#$%&'*+\\-.^_`|~0-9A-Za-z]{1,100}$", "^[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+$"


def header_error(headers: Column) -> Column:
    """Whether a map of headers is one that a response can have: names, values, their number and size, each name once."""
    names, values = F.map_keys(headers), F.map_values(headers)
    size = F.aggregate(F.concat(names, values), F.lit(0), lambda n, x: n + F.length(x))
    fits = F.forall(names, lambda n: n.rlike(_TOKEN)) & F.forall(values, lambda v: F.coalesce((F.length(v) <= 16_384) & ~v.rlike("[\\r\\n]"), F.lit(False)))
    once = F.size(F.array_distinct(F.transform(names, F.lower))) == F.size(names)
    return ~F.coalesce((F.size(names) <= MAX_HEADERS) & (size <= MAX_HEADER_BYTES) & fits & once, F.lit(False))


def header(headers: Column, name: str) -> Column:
    """The value of a header, whatever its case; of several that differ in case only, the first."""
    return payloads.first_header(headers, name)


def response_error(df: DataFrame) -> Column:
    """Why a response (requested_url, final_url, status, content_type, headers, body, fetch_method) is not read; null if it is.

    UPSTREAM_HTTP for one that breaks a rule, UNSUPPORTED_CONTENT_TYPE for a medium that cannot be read.
    """
    c = lambda name: F.col(name)
    no = lambda ok: ~F.coalesce(ok, F.lit(False))
    media = payloads.media_type(c("content_type"))
    said = payloads.media_type(header(c("headers"), "content-type"))
    bad = (
        hosts.outbound_error(c("requested_url")).isNotNull() | hosts.outbound_error(c("final_url")).isNotNull()
        | no(c("status").between(200, 299)) | no(media.rlike(_MEDIA)) | (F.octet_length("body") > MAX_BODY) | no(c("fetch_method").isin(*METHODS))
        | header_error(c("headers")) | F.coalesce(said != media, F.lit(False))
    )
    return F.when(bad, "UPSTREAM_HTTP").when(~media.isin(*payloads.MEDIA_TYPES), "UNSUPPORTED_CONTENT_TYPE")


def address_error(addresses: Column) -> Column:
    """A host's addresses of either family: between 1 and 64, each of them public."""
    return F.when(~F.coalesce(F.size(addresses).between(1, 64), F.lit(False)), "addresses").when(~F.forall(addresses, hosts.public_address), "private_address")


def checked(captures: DataFrame, redirects: str | None = None) -> DataFrame:
    """captures with media_type, kept_headers and source_error. redirects: a column with the URLs of the redirects."""
    error = response_error(captures)
    if redirects:
        hops = F.col(redirects)
        error = F.coalesce(error, F.when(F.size(hops) > MAX_REDIRECTS, "REDIRECT_LIMIT").when(F.exists(hops, lambda u: hosts.outbound_error(u).isNotNull()), "REDIRECT_BLOCKED"))
    return captures.select("*", payloads.media_type(F.col("content_type")).alias("media_type"), payloads.kept_headers(F.col("headers")).alias("kept_headers"), error.alias("source_error"))


def decoded(captures: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Checked captures with text and decode_error; a body that is not read, or is too large on the wire, is not inflated."""
    wire = F.octet_length("body") > MAX_WIRE
    body = F.when(F.col("source_error").isNull() & ~F.coalesce(wire, F.lit(False)), F.col("body"))
    rows = captures.withColumn("body", body).withColumn("packed", header(F.col("headers"), "content-encoding")).withColumn("large", F.coalesce(wire, F.lit(False)))
    out = payloads.decoded(rows, "body", "content_type", "packed", most)
    return out.withColumn("decode_error", F.when(F.col("large"), "RESPONSE_TOO_LARGE").otherwise(F.col("decode_error"))).drop("packed", "large", "body")
