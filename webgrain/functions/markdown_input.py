"""Markdown bodies: embedded HTML becomes Markdown, code and what only looks like a tag stay as they are."""

from __future__ import annotations

import re
from bisect import bisect_right
from urllib.parse import urlsplit

from . import extract
from .html_tree import TooLarge, parse
from .markdown import MAX_OUTPUT, Markdown, blocks_normalised
from .markdown_code import TAG, Literal, code_blocks, inline_code, limited, replaced
from .plain import trim, units

MIN_CHARACTERS, EXCERPT = 20, 240
# Autolinks, escaped brackets and entities.
_AUTOLINK = re.compile(r"<(?:https?://[^<>\s]+|mailto:[^<>\s]+|[^<>\s@]+@[^<>\s@]+\.[^<>\s@]+)>")
_ESCAPED = re.compile(r"(\\+)(?:<[^<>\n]*>|<)")
_ENTITY = re.compile(rf"{TAG.pattern}|&(?:#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]+);", re.IGNORECASE | re.ASCII)


class Vault:
    """Keeps pieces of a text under names that the text does not hold."""

    def __init__(self, text: str):
        self.mark = "KEPT"
        while self.mark in text:
            self.mark += "X"
        self.kept: list[str] = []

    def put(self, piece: str) -> str:
        self.kept.append(piece)
        return f"{self.mark}N{len(self.kept) - 1}END"

    def restore(self, text: str) -> str:
        return re.sub(rf"{self.mark}N([0-9]+)END", lambda m: self.kept[int(m[1])], text)


def _outside_tags(text: str, pattern: re.Pattern, change) -> str:
    """change(match) for each match that does not begin within a tag."""
    tags = [m.span() for m in TAG.finditer(text)]
    starts = [a for a, _ in tags]

    def one(m: re.Match) -> str:
        k = bisect_right(starts, m.start()) - 1
        return m[0] if k >= 0 and tags[k][0] < m.start() < tags[k][1] else change(m)

    return pattern.sub(one, text)


def without_html(text: str, url: str) -> str:
    if "<" not in text:
        return text
    vault, literal = Vault(text), Literal()
    body = replaced(text, code_blocks(text), vault.put)
    body = replaced(body, inline_code(body), vault.put)
    body = _outside_tags(body, _AUTOLINK, lambda m: vault.put(m[0]))
    body = _outside_tags(body, _ESCAPED, lambda m: vault.put(m[0]) if len(m[1]) % 2 else m[0])
    if "<" not in body:
        return text

    def entity(m: re.Match) -> str:
        if m[0][0] == "<":
            literal.see(m[0])
            return m[0]
        return m[0] if literal.name else vault.put(m[0])

    body = _ENTITY.sub(entity, body)
    root = parse(body)
    extract.segments(root, body)
    top = next(n for n in root.walk() if n.name == "body")
    out = vault.restore(blocks_normalised(Markdown(url, native=True, restore=vault.restore).render(top)))
    if len(out) > MAX_OUTPUT:
        raise TooLarge("markdown")
    return out


def markdown_page(raw: str, url: str, most: int = 20_000, least: int = MIN_CHARACTERS) -> dict:
    """A Markdown body as title (the URL's host), text, characters, truncated, excerpt and error."""
    out = {"title": None, "text": None, "characters": None, "truncated": False, "excerpt": None, "error": None}
    try:
        text = without_html(re.sub("\r\n?", "\n", raw), url)
    except (TooLarge, RecursionError):
        return out | {"error": "RESPONSE_TOO_LARGE"}
    if units(trim(text)) < least:
        return out | {"error": "CONTENT_INSUFFICIENT"}
    try:
        host = urlsplit(url).hostname or ""
    except ValueError:
        host = ""
    cut, truncated = limited(text, most)
    return out | {"title": host, "text": cut, "characters": units(text), "truncated": truncated, "excerpt": limited(cut, EXCERPT)[0]}


