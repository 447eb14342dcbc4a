"""Result pages of search providers as hits: blocks, the table layout, data for scripts, and the page that names their address."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from urllib.parse import parse_qs, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from ..functions.html_tree import Node, parse
from ..functions.plain import first_units, squeezed
from .requests import CHALLENGES

MAX_CANDIDATES, MAX_SOURCE, MAX_TITLE, MAX_SNIPPET = 1000, 16_384, 1000, 10_000
# Marks of the provider's pages.
PRELOAD_HOST, PRELOAD_PATH = "links.duckduckgo.com", "/d.js"
SCRIPT_MARK = re.compile(r"DDG\.pageLayout\.load\(\s*[\"']d[\"']\s*,")
_TOKEN = re.compile(r"\bvqd\s*=\s*[\"']([0-9]+-[0-9]+(?:-[0-9]+)?)[\"']", re.ASCII)
_NONE = re.compile(r"no results\.?", re.IGNORECASE)
_CHALLENGE = re.compile("|".join(f"(?:{p})" for p in CHALLENGES), re.IGNORECASE)


def _hit(title: str, href: str, snippet: str) -> dict | None:
    """A hit with its normalised URL; None without a title or a usable URL."""
    url, title = urls.normalize(href) if href else None, first_units(squeezed(title), MAX_TITLE)
    return {"title": title, "url": url, "snippet": first_units(squeezed(snippet), MAX_SNIPPET)} if url and title else None


def _first_of_each(found: list[dict | None]) -> list[dict]:
    kept: dict[str, dict] = {}
    for hit in filter(None, found):
        kept.setdefault(hit["url"], hit)
    return list(kept.values())


def _by_class(root: Node, *names: str) -> list[Node]:
    return [n for n in root.elements() if any(n.has_class(c) for c in names)]


def html_results(html: str | None) -> list[dict]:
    """Result blocks: title, target and snippet."""
    found = []
    for block in _by_class(parse(html or ""), "result"):
        link = next((n for n in block.elements("a") if n.has_class("result__a")), None)
        if link is not None:
            snippet = next(iter(_by_class(block, "result__snippet")), None)
            found.append(_hit(link.text(), link.attrs.get("href", ""), snippet.text() if snippet else ""))
    return _first_of_each(found)


def _rows_after(link: Node) -> str:
    """The text of the two table rows after a link's own."""
    row = link
    while row is not None and row.name != "tr":
        row = row.parent
    if row is None or row.parent is None:
        return ""
    rows = [c for c in row.parent.children if c.name == "tr"]
    at = next(k for k, c in enumerate(rows) if c is row)
    return "".join(c.text() for c in rows[at + 1 : at + 3])


def lite_results(html: str | None) -> list[dict]:
    """Links of the table layout; the i-th one's snippet is the i-th snippet, or the text of the next two rows."""
    root = parse(html or "")
    links = [n for n in root.elements("a") if n.has_class("result-link") or n.has_class("result__a")][:MAX_CANDIDATES]
    snippets = [n.text() for n in _by_class(root, "result-snippet")][:MAX_CANDIDATES]
    texts = snippets + [_rows_after(link) for link in links[len(snippets) :]]
    return _first_of_each([_hit(a.text(), a.attrs.get("href", ""), t) for a, t in zip(links, texts, strict=False)])


def bracketed(source: str, marker: re.Pattern) -> str | None:
    """The JSON array or object that follows a marker in a script, found by its brackets outside strings; never run."""
    found = marker.search(source)
    if not found:
        return None
    begin = next((k for k in range(found.end(), len(source)) if source[k] in "[{"), -1)
    depth, quoted, k = 0, False, begin
    while 0 <= k < len(source):
        c = source[k]
        if quoted:
            k += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if not depth:
                return source[begin : k + 1]
        k += 1
    return None


def script_results(source: str | None, marker: re.Pattern = SCRIPT_MARK) -> list[dict]:
    """Results of a page that carries them as data for its script: t, u and a of each row but those with n."""
    found = bracketed(source or "", marker)
    try:
        rows = json.loads(found) if found else []
    except ValueError:
        return []
    shown = lambda s: parse(str(s or "")).text()
    return _first_of_each([_hit(shown(r.get("t")), str(r.get("u") or ""), shown(r.get("a"))) for r in rows if isinstance(r, dict) and "n" not in r])


def outcome(html: str | None, parser: Callable[[str | None], list[dict]]) -> tuple[list[dict], str | None]:
    """(hits, error): BOT_CHALLENGE for a challenge, PARSE_CHANGED for a page that neither has hits nor says that there are none."""
    if _CHALLENGE.search(html or ""):
        return [], "BOT_CHALLENGE"
    hits = parser(html)
    if hits or _NONE.search(parse(html or "").text()):
        return hits, None
    return [], "PARSE_CHANGED"


def preload_url(html: str | None, query: str) -> tuple[str | None, str | None]:
    """(address, error) of the data for a page's script; an address of another host, path, token or query is refused."""
    if _CHALLENGE.search(html or ""):
        return None, "BOT_CHALLENGE"
    token = _TOKEN.search(html or "")
    source = next((s for n in parse(html or "").elements("script") if PRELOAD_PATH in (s := n.attrs.get("src", ""))), "")
    if not token or not source or len(source) > MAX_SOURCE:
        return None, "PARSE_CHANGED"
    try:
        to = urljoin("https://duckduckgo.com/", source)
        u = urlsplit(to)
        given = parse_qs(u.query, keep_blank_values=True)
        plain = u.scheme == "https" and u.hostname == PRELOAD_HOST and u.port is None and u.path == PRELOAD_PATH and not (u.username or u.password or u.fragment)
    except ValueError:
        return None, "PARSE_CHANGED"
    good = plain and given.get("vqd") == [token[1]] and given.get("q") == [query]
    return (to, None) if good else (None, "PARSE_CHANGED")


_HITS = T.StructType([T.StructField("hits", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("title", "url", "snippet")]))), T.StructField("error", T.StringType())])


def parsed(payloads: DataFrame, body: str, parser: Callable[[str | None], list[dict]] = html_results) -> DataFrame:
    """payloads with hits, an array in the page's order, and parse_error."""
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([outcome(p, parser) for p in pages], columns=["hits", "error"])

    kept = [F.col(f"`{c}`") for c in payloads.columns]
    made = payloads.select(*kept, F.pandas_udf(run, _HITS)(body).alias("made"))
    return made.select(*kept, F.col("made.hits").alias("hits"), F.col("made.error").alias("parse_error"))


def page_hits(payloads: DataFrame, key: str, body: str, parser: Callable[[str | None], list[dict]] = html_results, limit: int = 20) -> DataFrame:
    """key, rank (from 1), title, url, snippet of the first hits of each page; each URL once."""
    rows = parsed(payloads, body, parser).select(key, F.posexplode(F.slice("hits", 1, limit)).alias("pos", "r"))
    return rows.select(key, (F.col("pos") + 1).alias("rank"), "r.title", "r.url", "r.snippet")


#: Hosts that a provider's redirects may lead to.
REDIRECT_HOSTS = ("duckduckgo.com", "html.duckduckgo.com", "lite.duckduckgo.com", "links.duckduckgo.com")


def redirect_error(chain: F.Column, most: int = 2) -> F.Column:
    """Why a provider's redirects (an array of URLs) must not be followed; null if they may."""
    return F.when(F.size(chain) > most, "REDIRECT_LIMIT").when(~F.forall(chain, lambda u: F.coalesce(u.rlike("^https://") & urls.host(u).isin(*REDIRECT_HOSTS), F.lit(False))), "REDIRECT_HOST")
