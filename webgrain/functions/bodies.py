"""Bodies by media type: what is inspected of them, and what is read from them afterwards."""

from __future__ import annotations

from urllib.parse import urlsplit

from .extract import MIN_CHARACTERS, dynamic_shell, segments, select
from .html_tree import TooLarge, parse
from .inspection import json_segments, markdown_segments, xml_text
from .markdown import Markdown
from .markdown_code import limited
from .markdown_input import EXCERPT, markdown_page
from .plain import first_units, plain, trim, units

# Media types.
HTML, MARKDOWN, JSON, XML = ("text/html", "application/xhtml+xml"), "text/markdown", "application/json", ("application/xml", "text/xml")
READABLE = (*HTML, MARKDOWN, "text/plain", *XML)
PLAIN_MIN, DYNAMIC_MAX = 20, 500


def host(url: str) -> str:
    try:
        return urlsplit(url).hostname or ""
    except ValueError:
        return ""


def _row(visible: str, rows=(), omitted: int = 0, lines: bool = False, **more) -> dict:
    out = {"title": None, "text": None, "markdown": None, "score": None, "characters": None, "truncated": False, "excerpt": None, "dynamic": False, "error": None, "reason": None}
    parts = [{"location": a, "text": b, "truncated": c, "lines": lines and a == "visible"} for a, b, c in rows]
    return out | {"omitted": omitted, "segments": [{"location": "visible", "text": visible, "truncated": False, "lines": lines}, *parts]} | more


def _short(reason: str = "INSUFFICIENT_TEXT") -> dict:
    return {"error": "CONTENT_INSUFFICIENT", "reason": reason}


def plain_body(raw: str, url: str, most: int = 20_000) -> dict:
    text = plain(raw)
    if units(text) < PLAIN_MIN:
        return _row(text, **_short())
    cut = text if units(text) <= most else first_units(text, most).rstrip()
    return _row(text, title=host(url), text=cut, characters=units(text), truncated=cut != text, excerpt=first_units(cut, EXCERPT))


def html_body(raw: str, url: str, most: int = 20_000, markdown: bool = True, rendered: bool = False) -> dict:
    """rendered: a browser has run the page's scripts, so that it is no shell."""
    root = parse(raw)
    shell = not rendered and dynamic_shell(root, raw)
    found = segments(root, raw)
    body = next(n for n in root.walk() if n.name == "body")
    whole = body.text()
    title, text, node, score = select(root, url)
    reason = "DYNAMIC_RENDERING_REQUIRED" if shell else "INSUFFICIENT_TEXT"
    if node is None or units(text) < MIN_CHARACTERS:
        return _row(whole, found.rows, found.omitted, dynamic=shell, title=title, **_short(reason))
    seen = _row(f"{title}\n{text}", found.rows, found.omitted, dynamic=shell, title=title, score=score)
    if shell and units(text) < DYNAMIC_MAX:
        return seen | _short(reason)
    seen |= {"text": text}
    if not markdown:
        return seen | {"characters": units(text)}
    made = Markdown(url).render(node)
    cut, truncated = limited(made, most)
    return seen | {"markdown": cut, "characters": units(made), "truncated": truncated, "excerpt": limited(cut, EXCERPT)[0]}


def markdown_body(raw: str, url: str, most: int = 20_000) -> dict:
    visible, more = markdown_segments(raw)
    read = markdown_page(visible, url, most)
    reason = "INSUFFICIENT_TEXT" if read["error"] == "CONTENT_INSUFFICIENT" else None
    return _row(visible, more.rows, more.omitted, lines=True, markdown=read["text"], reason=reason, **read)


def json_body(raw: str) -> dict:
    """JSON is inspected, not read."""
    try:
        found = json_segments(raw)
    except ValueError:
        return _row("", omitted=1, error="GUARD_FAILED")
    return _row("", found.rows, found.omitted, lines=True)


def body(raw: str, media_type: str, url: str, most: int = 20_000, markdown: bool = True, rendered: bool = False) -> dict:
    """A decoded body as one row: title, text, markdown, score, characters, truncated, excerpt, dynamic, error, reason,
    omitted, segments (location, text, truncated, lines), the visible one first.

    A body beyond the limits of the tree was not inspected: it is an error row whose omitted is 1, so that no policy allows it.
    """
    kind = trim(media_type.split(";", 1)[0]).lower()
    try:
        if kind in HTML:
            return html_body(raw, url, most, markdown, rendered)
        if kind == MARKDOWN:
            return markdown_body(raw, url, most)
        if kind == JSON:
            return json_body(raw)
        return plain_body(xml_text(raw) if kind in XML else raw, url, most)
    except (TooLarge, RecursionError):
        return _row("", omitted=1, error="RESPONSE_TOO_LARGE")
