"""Inspection material of bodies that are no HTML: Markdown, JSON, XML and plain text."""

from __future__ import annotations

import json
import math
import re

from . import extract, xml_tree
from .extract import MAX_SEGMENT, MAX_SEGMENTS, Segments
from .html_tree import parse
from .plain import sampled, squeezed, units

_INDEX = re.compile("0|[1-9][0-9]{0,9}")


def markdown_segments(raw: str) -> tuple[str, Segments]:
    """The text as it is and, if it holds markup, what that markup shows and hides, with all attributes."""
    text, out = re.sub("\r\n?", "\n", raw), Segments()
    if "<" in text:
        root = parse(text)
        out = extract.segments(root, text, all_attributes=True)
        shown = next(n for n in root.walk() if n.name == "body").text()
        if shown:
            out.rows.insert(0, ("visible", shown, False))
    return text, out


def number_text(value: float) -> str:
    """A JSON number as the data model writes it: the shortest digits, an exponent from 1e21 on and below 1e-6."""
    value = float(value)
    if value == 0 or math.isinf(value):
        return "0" if value == 0 else "Infinity" if value > 0 else "-Infinity"
    mantissa, _, exponent = next(t for p in range(17) if float(t := f"{abs(value):.{p}e}") == abs(value)).partition("e")
    digits, point = mantissa.replace(".", "").rstrip("0"), int(exponent) + 1
    if len(digits) <= point <= 21:
        text = digits + "0" * (point - len(digits))
    elif 0 < point <= 21:
        text = f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        text = "0." + "0" * -point + digits
    else:
        text = digits[0] + (f".{digits[1:]}" if digits[1:] else "") + f"e{point - 1:+d}"
    return ("-" if value < 0 else "") + text


def _scalar_text(value) -> str:
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    return value if isinstance(value, str) else number_text(value)


def _entries(value) -> list[tuple[str, object]]:
    """A container's keys and values; keys that are array indexes come first, in their order."""
    if isinstance(value, list):
        return [(str(k), v) for k, v in enumerate(value)]
    index = sorted((k for k in value if _INDEX.fullmatch(k) and int(k) < 2**32 - 1), key=int)
    return [(k, value[k]) for k in [*index, *(k for k in value if k not in set(index))]] if index else list(value.items())


_END = object()
FULL = object()  # a container that is too large for what is still to be read before it


def _outline(value) -> list[object]:
    """Keys and scalars in document order, a None after each container's own, FULL instead of one beyond the limit.

    waiting is how many keys and values stand before a container in those around it.
    """
    out: list[object] = []
    todo: list[tuple[object, int]] = [(value, 0)]
    while todo:
        item, waiting = todo.pop()
        if item is _END:
            out.append(None)
        elif not isinstance(item, (dict, list)):
            out.append((item,))
        else:
            pairs = _entries(item)
            if 2 * len(pairs) + waiting > MAX_SEGMENTS:
                out.append(FULL)
                continue
            todo.append((_END, 0))
            for k in range(len(pairs) - 1, -1, -1):
                todo += [(pairs[k][1], waiting + 2 * k + 1), (pairs[k][0], 0)]
    return out



def json_segments(raw: str) -> Segments:
    """Every key and scalar as a text of its own, the last first; ValueError for a body that is no JSON.

    A body nested beyond the parser's depth is not read at all, and counts as omitted.
    """

    def refuse(name: str):
        raise ValueError(name)

    out = Segments()
    try:
        value = json.loads(raw, parse_constant=refuse)
    except RecursionError:
        out.omitted = 1
        return out
    for seen, item in enumerate(reversed(_outline(value)), 1):
        if item is FULL or seen > MAX_SEGMENTS or len(out.rows) >= MAX_SEGMENTS:
            out.omitted += 1
            break
        if item is not None:
            _take(out, *markdown_segments(_scalar_text(item[0])))
    return out


def _take(out: Segments, text: str, more: Segments) -> None:
    if text := squeezed(text):
        out.rows.append(("visible", sampled(text, MAX_SEGMENT), units(text) > MAX_SEGMENT))
    room = MAX_SEGMENTS - len(out.rows)
    out.omitted += more.omitted + (len(more.rows) > room)
    out.rows += more.rows[:room]


def xml_text(raw: str) -> str:
    """The character data of an XML body. Raises TooLarge."""
    return xml_tree.parse(raw).text()
