"""A bounded HTML tree builder: implied ends, raw text, void elements and formatting that reopens across blocks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

MAX_DEPTH, MAX_NODES = 512, 100_000
#: So many equal formatting elements go on in later blocks at most, as browsers have it; earlier ones end with their block.
MAX_ALIKE = 3
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
HEAD_ONLY = set("title meta link base".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: A start tag ends the nearest of these that is open, unless one of the others stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_SCOPE = set("table td th caption button template object html body".split())


class TooLarge(ValueError):
    """The page is beyond the depth or node limit."""


class Node:
    __slots__ = ("attrs", "children", "data", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, data: str = ""):
        self.name, self.attrs, self.data, self.children, self.parent = name, attrs or {}, data, [], None

    def append(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def remove(self) -> None:
        if self.parent:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def walk(self) -> Iterator[Node]:
        """Elements and texts in document order, itself included."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += reversed(node.children)

    def elements(self, *names: str) -> list[Node]:
        return [n for n in self.walk() if n.name[0] != "#" and (not names or n.name in names)]

    def text(self) -> str:
        return "".join(n.data for n in self.walk() if n.name == "#text")

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.html = self.root.append(Node("html"))
        self.head = self.html.append(Node("head"))
        self.body = self.html.append(Node("body"))
        self.open: list[Node] = [self.body]
        self.formats: list[Node] = []
        self.nodes, self.started = 4, False

    def _add(self, node: Node, at: Node | None = None) -> Node:
        self.nodes += 1
        if self.nodes > MAX_NODES:
            raise TooLarge("nodes")
        return (at or self.open[-1]).append(node)

    def _push(self, node: Node) -> None:
        self._add(node)
        self.open.append(node)
        if len(self.open) > MAX_DEPTH:
            raise TooLarge("depth")

    def _reopen(self) -> None:
        for k, node in enumerate(self.formats):
            if not any(node is o for o in self.open):
                self.formats[k] = Node(node.name, dict(node.attrs))
                self._push(self.formats[k])

    def _close(self, names: set[str], stop: set[str]) -> bool:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name in names:
                del self.open[k:]
                return True
            if self.open[k].name in stop:
                return False
        return False

    def handle_starttag(self, name, attrs):
        given = {k: v or "" for k, v in reversed(attrs)}
        if name in ("html", "head", "body"):
            target = {"html": self.html, "head": self.head, "body": self.body}[name]
            for k, v in given.items():
                target.attrs.setdefault(k, v)
            self.started |= name == "body"
            return
        if name in HEAD_ONLY and not self.started:
            node = self._add(Node(name, given), self.head)
            if name not in VOID:
                self.open.append(node)
            return
        if name not in ("script", "style", "noscript", "template"):
            self.started = True
        if name in CLOSES_P:
            self._close({"p"}, _SCOPE)
        if name in ENDS:
            names, stop = ENDS[name]
            while self._close(names, stop) and name in ("tr", "tbody", "tfoot", "thead"):
                pass
        if name == "a" and any(f.name == "a" for f in self.formats):
            self.handle_endtag("a")
        if name == "tr" and self.open[-1].name == "table":
            self._push(Node("tbody"))
        node = Node(name, given)
        if name in VOID:
            self._reopen()
            self._add(node)
            return
        if name not in CLOSES_P and name not in ENDS and name not in ("script", "style", "caption", "colgroup"):
            self._reopen()
        self._push(node)
        if name in FORMATTING:
            alike = [k for k, f in enumerate(self.formats) if f.name == name and f.attrs == given]
            if len(alike) >= MAX_ALIKE:
                del self.formats[alike[0]]
            self.formats.append(node)

    def handle_startendtag(self, name, attrs):
        self.handle_starttag(name, attrs)  # a slash closes void elements only

    def handle_endtag(self, name):
        if name in ("html", "head", "body") or name in VOID:
            if name == "br":
                self.handle_starttag("br", [])
            return
        if name in FORMATTING:
            self.formats = [f for f in self.formats if f.name != name] if sum(f.name == name for f in self.formats) < 2 else self._without_last(name)
        if name == "p" and not any(o.name == "p" for o in self.open):
            self._push(Node("p"))
        self._close({name}, _SCOPE - {name})

    def _without_last(self, name: str) -> list[Node]:
        last = max(k for k, f in enumerate(self.formats) if f.name == name)
        return self.formats[:last] + self.formats[last + 1 :]

    def handle_data(self, data):
        if not self.started and self.open[-1] is self.body and not data.strip():
            return
        if self.open[-1].name not in ("title", "script", "style", "textarea"):
            self.started |= bool(data.strip())
            if data.strip() or self.open[-1].name not in ("table", "tbody", "thead", "tfoot", "tr"):
                self._reopen()
        last = self.open[-1].children[-1] if self.open[-1].children else None
        if last is not None and last.name == "#text":
            last.data += data
        else:
            self._add(Node("#text", data=data))

    def handle_comment(self, data):
        self._add(Node("#comment", data=data))


def parse(html: str) -> Node:
    """The document's tree; its children are html with head and body. Raises TooLarge."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root
