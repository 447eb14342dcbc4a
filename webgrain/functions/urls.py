"""URL normalisation, hosts and outbound-address policy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import parse_qsl, quote, quote_plus, unquote_plus, urlencode, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hosts

#: Query keys that only track.
TRACKING = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "ref_src")
WRAPPER_HOST = "duckduckgo.com"


def tracking_free(url: Column) -> Column:
    """The simple shapes of normalisation, without a parser: no fragment, no tracking keys, no trailing slash."""
    key = f"(?:utm_[^=&#]*|{'|'.join(TRACKING)})"
    c = F.regexp_replace(url, "#.*$", "")
    c = F.regexp_replace(c, f"(?i)([?&]){key}(?:=[^&]*)?(?=&|$)", "$1")
    c = F.regexp_replace(F.regexp_replace(c, "&{2,}", "&"), "\\?&", "?")
    c = F.regexp_replace(c, "[?&]+$", "")
    return F.regexp_replace(c, "^([a-z]+://[^/?]+/[^?]*?)/+(\\?|$)", "$1$2")


def canonical(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def host(url: Column) -> Column:
    """Lower case, without user, port and trailing dot."""
    h = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)", 1))
    return F.regexp_replace(h, "\\.$", "")


def host_matches(host_name: Column, wanted: str) -> Column:
    return (host_name == wanted) | host_name.endswith("." + wanted)


def _absolute(raw: str) -> str | None:
    raw = raw.strip("".join(map(chr, range(33))))
    if raw.startswith("//"):
        return "https:" + raw
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", raw):
        return raw
    return f"https://{WRAPPER_HOST}/{raw.lstrip('/')}"


_URL = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):[/\\]*([^/\\?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?", re.DOTALL)
_AUTHORITY = re.compile(r"(?:(.*)@)?(\[[^\]]*\]|[^:\[\]]*)(?::([0-9]*))?", re.DOTALL)


def _parts(raw: str):
    """Scheme, user, host, port, path, query and fragment of an http(s) URL in canonical form; None if it is none."""
    whole = _URL.fullmatch(re.sub("[\t\r\n]", "", raw.strip("".join(map(chr, range(33))))))
    found = whole and _AUTHORITY.fullmatch(whole[2])
    scheme = whole[1].lower() if found else ""
    name = hosts.canonical(found[2]) if scheme in hosts.PORTS else None
    if not name or int(found[3] or 0) > 65535:
        return None
    port = None if not found[3] or int(found[3]) == hosts.PORTS[scheme] else int(found[3])
    path = []
    for piece in whole[3].replace("\\", "/").split("/")[1:]:
        low = piece.lower().replace("%2e", ".")
        if low == "..":
            path = path[:-1]
        elif low != ".":
            path.append(piece)
    return scheme, (found[1] or "") not in ("", ":"), name, port, quote("/" + "/".join(path), safe="/%:@!$&'()*+,;=-._~|"), whole[4] or "", whole[5] or ""


def unwrap(raw: str) -> str:
    """The destination of a search engine's redirect link; relative links belong to that engine."""
    whole = _absolute(raw)
    found = _parts(whole)
    if found and (found[2] == WRAPPER_HOST or found[2].endswith("." + WRAPPER_HOST)) and found[4].startswith("/l/"):
        for key, value in parse_qsl(found[5], keep_blank_values=True):
            if key == "uddg" and value:
                return value
    return whole


def normalize(raw: str | None) -> str | None:
    """Unwrapped http(s) URL without credentials, fragment, tracking keys and trailing slashes; None if unusable."""
    found = _parts(unwrap(raw)) if raw is not None else None
    if not found or found[1]:
        return None
    scheme, _, name, port, path, query, _ = found
    if path != "/":
        path = path.rstrip("/") or "/"
    pairs = [p for p in query.split("&") if p] if query else []
    kept = [p for p in pairs if not _tracks(unquote_plus(p.split("=", 1)[0]))]
    if len(kept) < len(pairs):  # only a changed query is written anew
        query = urlencode(parse_qsl("&".join(kept), keep_blank_values=True), quote_via=quote_plus, safe="*-._")
    else:
        query = quote(query, safe="%:@!$&'()*+,;=-._~/?|[]{}^`\\")
    return urlunsplit((scheme, name + (f":{port}" if port else ""), path, query, ""))


def _tracks(key: str) -> bool:
    key = key.lower()
    return key.startswith("utm_") or key in TRACKING


@F.pandas_udf(T.StringType())
def normalized_url(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in urls:
        yield s.map(normalize)
