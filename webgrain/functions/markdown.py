"""HTML to Markdown as one fold over the tree.

Leaves are written at once; every other element collects what its children wrote and is closed by the rule of its
name. The fold keeps its own stack, so depth is bounded by the tree's limit alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import quote, urljoin, urlsplit

from . import tables
from .html_tree import Node, TooLarge
from .plain import SPACES, WS, dense, squeezed, trim

MAX_OUTPUT = 2_000_000
# Element names.
OMITTED = set("script style noscript template svg iframe object embed head meta link input textarea select button nav".split())
PARAGRAPHS = set("p div section article main header footer aside figure figcaption details summary dl dt dd address".split())
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "s": "~~", "del": "~~"}
AFTER_LABEL = SPACES + "|｜:：,，.。()（）/"

_CODE_CLASS = re.compile(r"(?:^|\s)language-([\w+-]{1,32})(?:\s|$)", re.ASCII)
_RUN = re.compile(f"{WS}+")
_TICKS = re.compile("`+")
_APART = re.compile(f"\n{WS}*\n")
_OPENS_FENCE = re.compile("(?:`{3,}|~{3,})")
_OPENS_BLOCK = re.compile(r"(?:`{3,}|~{3,}|\||[-+*] |[0-9]{1,9}\. |#{1,6} )")
_HEADING = re.compile("(#{1,6}) ([^\n]+)")
_SPECIAL = re.compile(r"([\\`*_\[\]#])")
_FENCE = re.compile(rf"{WS}*(?:>{WS}*)*(?:(?:[-+*]|[0-9]{{1,9}}[.)])[ \t]+)?(`{{3,}}|~{{3,}})(.*)")


def escaped(text: str) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return _SPECIAL.sub(r"\\\1", text)


def code_language(pre: Node) -> str:
    first = next((c for c in pre.children if c.name[0] != "#"), None)
    found = _CODE_CLASS.search(first.attrs.get("class", "")) if first is not None and first.name == "code" else None
    return found[1] if found else ""


def fenced(text: str, language: str = "") -> str:
    mark = "`" * max(3, 1 + max(map(len, _TICKS.findall(text)), default=0))
    return f"{mark}{language}\n{text}{'' if text.endswith(chr(10)) else chr(10)}{mark}"


def destination(href: str, base: str) -> str | None:
    """Where a link leads, if it is one that a reader may follow."""
    if not trim(href):
        return None
    try:
        to = urljoin(base, trim(href))
        if urlsplit(to).scheme not in ("http", "https", "mailto"):
            return None
    except ValueError:
        return None
    return re.sub(r"[\s()<>\\]", lambda m: quote(m[0], safe=""), to)


def whole_number(value: str | None, otherwise: int) -> int:
    m = re.match(f"{WS}*([+-]?[0-9]{{1,15}})", value or "")
    return int(m[1]) if m else otherwise


def _marked(inner: str, mark: str) -> str:
    text = trim(inner)
    if not text or (_APART.search(text) or ("\n" in text and _OPENS_FENCE.match(text))):
        return inner
    before = inner[: inner.index(text)]
    return f"{before}{mark}{text}{mark}{inner[len(before) + len(text) :]}"


class _Open:
    """An element whose children are being written."""

    __slots__ = ("links", "node", "parts", "todo")

    def __init__(self, node: Node, todo: list[Node], links: bool):
        self.node, self.todo, self.links, self.parts = node, todo, links, []

    def inner(self) -> str:
        return "".join(self.parts)


class Markdown:
    """Rendering relative to a page's URL.

    native: the tree was made from Markdown with embedded HTML; text outside of elements is Markdown already, and
    restore gives back what was protected in it.
    """

    def __init__(self, url: str, native: bool = False, restore: Callable[[str], str] | None = None):
        self.url, self.native, self.restore = url, native, restore or (lambda text: text)

    def render(self, top: Node) -> str:
        self.density = self._densities(top)
        made = self._fold(top)
        if len(made) > MAX_OUTPUT:
            raise TooLarge("markdown")
        return made if self.native else blocks_normalised(made)

    @staticmethod
    def omits(node: Node) -> bool:
        return node.name in OMITTED or node.name == "#comment" or trim(node.attrs.get("role", "")).lower() == "navigation"

    def _densities(self, top: Node) -> dict[int, tuple[int, int]]:
        """Of each element, its characters and those of links, before URLs add to them."""
        order, todo = [], [top]
        while todo:
            node = todo.pop()
            if not self.omits(node):
                order.append(node)
                todo += node.children
        out: dict[int, tuple[int, int]] = {}
        for node in reversed(order):
            if node.name == "#text":
                out[id(node)] = dense(node.data), 0
                continue
            if node.name == "img":
                all_, linked = dense(node.attrs.get("alt", "")), 0
            else:
                of = [out.get(id(c), (0, 0)) for c in node.children]
                all_, linked = sum(a for a, _ in of), sum(b for _, b in of)
            out[id(node)] = all_, all_ if node.name == "a" and node.attrs.get("href") else linked
        return out

    def _fold(self, top: Node) -> str:
        written = self._leaf(top)
        if written is not None:
            return written
        stack = [self._opened(top, False)]
        while True:
            now = stack[-1]
            if len(now.parts) < len(now.todo):
                child = now.todo[len(now.parts)]
                written = self._leaf(child)
                if written is None:
                    stack.append(self._opened(child, now.links))
                else:
                    now.parts.append(written)
                continue
            stack.pop()
            close = self.CLOSE.get(now.node.name)
            made = close(self, now) if close else now.inner()
            if not stack:
                return made
            stack[-1].parts.append(made)

    def _opened(self, node: Node, links: bool) -> _Open:
        todo = node.children
        if node.name in ("p", "li"):  # references within prose keep their URLs
            text, linked = self.density.get(id(node), (0, 0))
            links = text > 0 and linked / text < 0.5 and text - linked >= 20
        elif node.name in ("ul", "ol"):
            todo = [c for c in todo if c.name == "li"]
        elif node.name == "table":
            captions, rows = tables.parts(node)
            todo = captions + [c for row, _ in rows for c in tables.cells(row)]
        return _Open(node, todo, links)

    def _leaf(self, node: Node) -> str | None:
        """What a node without rendered children says; None for the others."""
        if node.name == "#text":
            if not self.native:
                return escaped(_RUN.sub(" ", node.data))
            own = node.parent is None or node.parent.name in ("html", "body", "#root")
            return node.data.replace("<", "&lt;") if own else escaped(node.data)
        if self.omits(node):
            return ""
        write = self.LEAF.get(node.name)
        return write(self, node) if write else None

    def _raw(self, node: Node) -> str:
        return self.restore(re.sub("\r\n?", "\n", node.text()))

    def _code(self, node: Node) -> str:
        text = self._raw(node).replace("\n", " ")
        if not text:
            return ""
        mark = "`" * (1 + max(map(len, _TICKS.findall(text)), default=0))
        pad = " " if "`" in (text[0], text[-1]) or (len(text) > 1 and text[0] == text[-1] == " " and text.strip(" ")) else ""
        return mark + pad + text + pad + mark

    def _image(self, node: Node) -> str:
        """The label, unless the text next to an icon begins with it."""
        alt = self.restore(node.attrs.get("alt", ""))
        label = trim(alt)
        siblings = node.parent.children if label and node.parent is not None else []
        at = next((k for k, c in enumerate(siblings) if c is node), len(siblings))
        for other in siblings[at + 1 :]:
            shown = squeezed(self.restore(other.text()))
            if shown:
                said = shown.startswith(label) and (len(shown) == len(label) or shown[len(label)] in AFTER_LABEL)
                return "" if said else escaped(alt)
            if other.name == "img":
                break
        return escaped(alt)

    LEAF = {
        "pre": lambda self, node: f"\n\n{fenced(self._raw(node), code_language(node))}\n\n",
        "code": _code,
        "img": _image,
        "br": lambda self, node: "  \n" if self.native else "\n",
        "hr": lambda self, node: "\n\n---\n\n",
    }

    def _table(self, now: _Open) -> str:
        return f"\n\n{tables.layout(now.node, {id(n): t for n, t in zip(now.todo, now.parts, strict=True)})}\n\n"

    def _list(self, now: _Open) -> str:
        ordered, down = now.node.name == "ol", "reversed" in now.node.attrs
        start = now.node.attrs.get("start")
        number = whole_number(start, 1) if start is not None else len(now.todo) if down else 1
        lines = []
        for item, body in zip(now.todo, map(trim, now.parts), strict=True):
            number = whole_number(item.attrs.get("value"), number)
            mark = f"{number}. " if ordered else "- "
            if body:
                first, *rest = body.split("\n")
                lines += [mark + first, *(" " * len(mark) + line if line else "" for line in rest)]
            number += -1 if down else 1
        return "\n\n" + "\n".join(lines) + "\n\n"

    def _heading(self, now: _Open) -> str:
        inner = now.inner()
        text = trim(inner)
        if _OPENS_FENCE.match(text) or _APART.search(text):
            return inner
        return f"\n\n{'#' * int(now.node.name[1])} {text.replace(chr(10), ' ')}\n\n"

    def _link(self, now: _Open) -> str:
        inner = now.inner()
        to = destination(self.restore(now.node.attrs.get("href", "")), self.url) if now.links else None
        if to is None:
            return inner
        text = trim(inner)
        if head := _HEADING.fullmatch(text):
            return f"\n\n{head[1]} [{head[2]}]({to})\n\n"
        if _APART.search(text) or _OPENS_BLOCK.match(text):
            return f"{inner}\n\n[Link]({to})\n\n"
        return f"[{re.sub(chr(10) + '+', ' ', text)}]({to})" if text else inner

    def _quote(self, now: _Open) -> str:
        return "\n\n" + "\n".join(f"> {line}" for line in trim(now.inner()).split("\n")) + "\n\n"

    def _raised(self, now: _Open) -> str:
        inner = now.inner()
        return f"{'^' if now.node.name == 'sup' else '_'}({inner})" if inner else ""

    CLOSE = {
        **{name: lambda self, now: f"\n\n{trim(now.inner())}\n\n" for name in PARAGRAPHS},
        **{name: lambda self, now: _marked(now.inner(), MARKS[now.node.name]) for name in MARKS},
        **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), _heading),
        **dict.fromkeys(("ul", "ol"), _list),
        **dict.fromkeys(("sup", "sub"), _raised),
        "table": _table,
        "a": _link,
        "blockquote": _quote,
    }


def blocks_normalised(text: str) -> str:
    """One empty line between blocks at most, except within code fences."""
    out: list[str] = []
    fence = ""
    for line in text.split("\n"):
        mark = _FENCE.fullmatch(line) if "```" in line or "~~~" in line else None
        if mark and not fence:
            fence = mark[1]
        elif mark and mark[1].startswith(fence) and not trim(mark[2]):
            fence = ""
        if fence or trim(line) or not (out and not trim(out[-1])) or mark:
            out.append(line)
    return trim("\n".join(out))
