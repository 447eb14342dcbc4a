"""Captured provider payloads as rows of hits, and what their requests and headers say."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.batches import parts, short_batches

# Fixed values.
KEPT_HEADERS = ("content-type", "content-language", "last-modified", "etag")
MEDIA_TYPES = ("text/html", "application/xhtml+xml", "text/plain", "text/markdown", "application/xml", "text/xml")
CHARSETS = {"utf8": "utf-8", "utf-8": "utf-8", "utf16": "utf-16-le", "utf-16": "utf-16-le", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "shift-jis": "cp932", "shift_jis": "cp932", "sjis": "cp932", "windows-31j": "cp932", "cp932": "cp932"}
BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
_DECLARED = re.compile(r"(?:^|[;\s])charset\s*=\s*[\"']?([^;\"'\s/>]+)", re.IGNORECASE)
_RESULT = "array<struct<title string, url string, description string>>"


def json_hits(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """JSON search payloads (web.results) -> key, pos, title, url, snippet; results without title or URL are skipped."""
    parsed = F.from_json(F.col(body), f"web struct<results {_RESULT}>")
    rows = payloads.select(key, F.posexplode(parsed["web"]["results"]).alias("pos", "r"))
    rows = rows.where((F.trim("r.title") != "") & (F.trim("r.url") != ""))
    return rows.select(key, "pos", text.external_text(F.col("r.title")).alias("title"), F.col("r.url").alias("url"), text.external_text(F.coalesce("r.description", F.lit(""))).alias("snippet"))


def first_header(headers: Column, name: str) -> Column:
    """The value of the first header with this name, in any case."""
    return F.get(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name), F.lit(0))["value"]


def kept_headers(headers: Column) -> Column:
    """The headers that are kept, under lower-case names; of names that differ in case only, the first."""
    found = F.array(*[F.struct(F.lit(n).alias("key"), first_header(headers, n).alias("value")) for n in KEPT_HEADERS])
    return F.when(headers.isNotNull(), F.map_from_entries(F.filter(found, lambda e: e["value"].isNotNull())))


def json_error(body: Column) -> Column:
    """PARSE_CHANGED for a JSON search payload that json_hits can read nothing of: null, broken, or without a list of results."""
    results = F.from_json(body, f"web struct<results {_RESULT}>")["web"]["results"]
    return F.when(results.isNull(), "PARSE_CHANGED")


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.regexp_extract(content_type, "^([^;]*)", 1)))


def decompress(body: bytes, encoding: str | None, most: int = 2_000_000) -> bytes:
    """gzip, deflate or identity; ValueError for anything else, broken data, or more than most bytes. No more than most
    bytes are ever inflated."""
    encoding = (encoding or "identity").strip().lower()
    if encoding in ("", "identity"):
        out = body
    elif encoding in ("gzip", "x-gzip", "deflate"):
        kinds = (16 + zlib.MAX_WBITS,) if encoding != "deflate" else (zlib.MAX_WBITS, -zlib.MAX_WBITS)
        for k, kind in enumerate(kinds):
            inflate = zlib.decompressobj(kind)
            try:
                out = inflate.decompress(body, most + 1)
            except zlib.error as error:
                if k + 1 < len(kinds):
                    continue
                raise ValueError("broken data") from error
            if len(out) <= most and not inflate.eof:
                raise ValueError("broken data")
            break
    else:
        raise ValueError(f"no decoder for {encoding}")
    if len(out) > most:
        raise ValueError("too large")
    return out


def decode(body: bytes | None, content_type: str | None) -> tuple[str | None, str | None]:
    """Text, or the error: mark, header, the page's own declaration, and UTF-8 decide in that order; no guess is made."""
    body = bytes(body or b"")
    for mark, name in BOMS:
        if body.startswith(mark):
            charset, body = name, body[len(mark) :]
            break
    else:
        said = _DECLARED.search(content_type or "") or ("html" in (content_type or "") and _DECLARED.search(body[:4096].decode("latin-1")))
        charset = CHARSETS.get(said[1].lower()) if said else "utf-8"
    try:
        return (body.decode(charset), None) if charset else (None, "UNSUPPORTED_CONTENT_ENCODING")
    except UnicodeDecodeError:
        return None, "UNSUPPORTED_CONTENT_ENCODING"


def decoded(bodies: DataFrame, body: str = "body", content_type: str = "content_type", encoding: str | None = None, most: int = 2_000_000) -> DataFrame:
    """bodies with text and decode_error: UNSUPPORTED_CONTENT_ENCODING, RESPONSE_TOO_LARGE or null. encoding: the column that
    names the compression. A null body is an empty one."""
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])

    def one(raw, media, packed) -> tuple[str | None, str | None]:
        try:
            return decode(decompress(bytes(raw or b""), packed, most), media)
        except ValueError as error:
            return None, "RESPONSE_TOO_LARGE" if str(error) == "too large" else "UNSUPPORTED_CONTENT_ENCODING"

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for part in parts(pa.RecordBatch.from_arrays(list(columns), ["body", "type", "packed"]) for columns in batches):
            made = [one(*row) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([m[k] for m in made], pa.string()) for k in (0, 1)], ["text", "error"])

    short_batches(bodies.sparkSession)
    made = F.arrow_udf(run, kind)(body, content_type, F.col(encoding) if encoding else F.lit(None).cast("string"))
    kept = [F.col(f"`{c}`") for c in bodies.columns]
    return bodies.select(*kept, made.alias("made")).select(*kept, F.col("made.text").alias("text"), F.col("made.error").alias("decode_error"))
