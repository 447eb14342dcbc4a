"""A bounded XML tree that forgives broken documents, and knows no entities but the five of XML and numbers.

Nothing outside of the document is ever read: document types and the entities that they declare are skipped, so that
references to them stay as they are written and cannot grow.
"""

from __future__ import annotations

import re

from . import html_tree
from .html_tree import Node, TooLarge

#: The entities of XML.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_TOKEN = re.compile(
    r"<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<!--(?P<comment>.*?)(?:-->|\Z)|<\?.*?(?:\?>|\Z)|<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>|<![^>]*>"
    r"|<(?P<end>/?)(?P<name>[^\s<>/!?]+)(?P<attrs>(?:[^\"'<>]|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>",
    re.DOTALL | re.IGNORECASE,
)
_REFERENCE = re.compile(r"&(?:#x([0-9a-f]{1,6})|#([0-9]{1,7})|([a-z]+));", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def _character(m: re.Match) -> str:
    if m[3]:
        return ENTITIES.get(m[3], m[0])
    code = int(m[1], 16) if m[1] else int(m[2])
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def decoded(text: str) -> str:
    return _REFERENCE.sub(_character, text)


class _Tree:
    def __init__(self):
        self.root = Node("#root")
        self.open, self.nodes = [self.root], 0

    def add(self, node: Node) -> Node:
        self.nodes += 1
        if self.nodes > html_tree.MAX_NODES:
            raise TooLarge("nodes")
        return self.open[-1].append(node)

    def text(self, data: str) -> None:
        last = self.open[-1].children[-1] if self.open[-1].children else None
        if data and last is not None and last.name == "#text":
            last.data += data
        elif data:
            self.add(Node("#text", data=data))

    def begin(self, node: Node, empty: bool) -> None:
        self.add(node)
        if not empty:
            self.open.append(node)
            if len(self.open) - 1 > html_tree.MAX_DEPTH:
                raise TooLarge("depth")

    def end(self, name: str) -> None:
        """Ends the nearest open element of that name, if there is one."""
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].name == name), None)
        if at:
            del self.open[at:]


def parse(xml: str) -> Node:
    """The document's tree, names as they are written. Raises TooLarge beyond the limits of an HTML tree."""
    tree, at = _Tree(), 0
    for m in _TOKEN.finditer(xml):
        tree.text(decoded(xml[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            tree.text(m["cdata"])
        elif m["comment"] is not None:
            tree.add(Node("#comment", data=m["comment"]))
        elif m["end"]:
            tree.end(m["name"])
        elif m["name"]:
            given = {k: decoded(a or b) for k, a, b in _ATTRIBUTE.findall(m["attrs"])}
            tree.begin(Node(m["name"], given), bool(m["empty"]))
    tree.text(decoded(xml[at:]))
    return tree.root
