"""Readings of a text in which a disguised instruction would be plain.

Each reading is a text with the names of the steps that made it. A step maps a text to a text; the readings are the
distinct results of running every combination that the scan allows, in a fixed order.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

MOST_BASE64, BASE64_CHARS, DECODED_CHARS = 32, 2048, 8192

# Code points that show nothing.
_INVISIBLE = (
    [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), *range(0x7F, 0xA0), 0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5]
    + [*range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF]
)
_DROP = dict.fromkeys(_INVISIBLE)
_L = r"[^\W\d_]"
# the rarer sign first, as it is looked for at every place
_DELIMITER = re.compile(rf"[._|/\\-](?<={_L}.)(?={_L})")
_SPACED = re.compile(rf"(?<![A-Za-z0-9_])(?:{_L}[\t ]+){{3,15}}{_L}(?![A-Za-z0-9_])")
# what a spelled-out word has within
_LONE = re.compile(rf"[\t ]{_L}[\t ]+{_L}[\t ]")
_ESCAPE = re.compile(r"\\u\{([0-9a-f]{1,6})\}|\\u([0-9a-f]{4})|\\x([0-9a-f]{2})", re.IGNORECASE)
_PERCENT = re.compile(r"(?:%[0-9a-f]{2})+", re.IGNORECASE)
_LEET_WORD = re.compile(r"(?:[^\W_]|[@$]){4,32}")
_LEET_RUN, _LEET_SIGN = re.compile(r"(?:[^\W_]|[@$])+"), re.compile(r"[\d@$]")
_LEET = str.maketrans("013457@$", "oieastas")
_LONG_RUN = re.compile(r"[A-Za-z0-9+/]{16}")
_BASE64 = re.compile(r"(?:[A-Za-z0-9+/]{4}){4,512}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?")
_PLAIN = re.compile(r"[^\t\n\r -~]|[%\\$@0-9]")
_JOINED, _AFTER = re.compile(r"[A-Za-z][._|/-][A-Za-z]"), re.compile(r"[._|/\\-](?=[^\W\d_])")
_RUN = re.compile(r"[A-Za-z+/]{16}")


def one_way(text: str) -> bool:
    """Whether a text reads in one way only: plain ASCII, nothing escaped, joined, spelled out or encoded."""
    return text.isascii() and not any(p.search(text) for p in (_PLAIN, _LONE, _RUN, _JOINED))


_SHOWS_NOTHING = re.compile("[" + "".join(map(chr, _INVISIBLE)).replace("\\", "\\\\") + "]")


def visible(text: str) -> str:
    return text.translate(_DROP) if _SHOWS_NOTHING.search(text) else text


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        n = int(m[1] or m[2] or m[3], 16)
        return m[0] if n > 0x10FFFF or 0xD800 <= n <= 0xDFFF else chr(n)

    return _ESCAPE.sub(one, text) if "\\" in text else text


def _unpercent(text: str) -> str:
    def one(m: re.Match) -> str:
        try:  # a run that is no UTF-8 stays whole
            return unquote_to_bytes(m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return _PERCENT.sub(one, text) if "%" in text else text


def leet(text: str) -> str:
    def one(m: re.Match) -> str:
        word = m[0]
        return word.translate(_LEET) if any(map(str.isalpha, word)) and _LEET_SIGN.search(word) else word

    # only runs with a sign are looked at, each from its first letter on
    out, at = [], 0
    for m in _LEET_SIGN.finditer(text):
        begin = m.start()
        if begin < at:
            continue
        while begin > at and (text[begin - 1].isalnum() or text[begin - 1] in "@$"):
            begin -= 1
        end = _LEET_RUN.match(text, m.start()).end()
        out += text[at:begin], _LEET_WORD.sub(one, text[begin:end])
        at = end
    return "".join(out) + text[at:]


def printable_ratio(text: str) -> float:
    return sum(unicodedata.category(c)[0] in "LNPZ" or c.isspace() for c in text) / len(text) if text else 0.0


class _Readings:
    def __init__(self):
        self.by_text: dict[str, tuple[str, ...]] = {}

    def add(self, text: str, steps) -> Iterator[tuple[str, tuple[str, ...]]]:
        """The reading, unless there is one with its text."""
        if text not in self.by_text:
            self.by_text[text] = tuple(dict.fromkeys(steps))
            yield text, self.by_text[text]

    def items(self) -> list[tuple[str, tuple[str, ...]]]:
        return list(self.by_text.items())


def _step(text: str, steps: list[str], name: str, change) -> str:
    """change(text), with name noted if it does anything."""
    after = change(text)
    if after != text and name not in steps:
        steps.append(name)
    return after


def _compact(text: str) -> str:
    return _SPACED.sub(lambda m: re.sub(r"[\t ]+", "", m[0]), text) if _LONE.search(text) else text


def _decoded(text: str, steps: list[str]) -> str:
    given = text
    text = _step(text, steps, "letter_spacing_removed", _compact)
    for _ in range(2):
        before = text
        text = _step(text, steps, "escaped_code_point_decoded", _unescape)
        text = _step(text, steps, "url_decoded", _unpercent)
        settled = text == before
        text = _step(text, steps, "invisible_control_removed", visible)
        if settled:
            break
    return text if text == given else _step(text, steps, "letter_spacing_removed", _compact)


def _delimited(text: str) -> list[tuple[str, str]]:
    if not _AFTER.search(text) or not _DELIMITER.search(text):
        return []
    return [(_DELIMITER.sub(" ", text), "word_delimiter_spaced"), (_DELIMITER.sub("", text), "letter_delimiter_removed")]


def each_reading(text: str, base64_left: int = MOST_BASE64) -> Iterator[tuple[str, tuple[str, ...]]]:
    """The readings one by one, each made when it is asked for."""
    if one_way(text):
        yield text, ()
        return
    common: list[str] = []
    text = _step(text, common, "unicode_nfkc", lambda s: s if s.isascii() else unicodedata.normalize("NFKC", s))
    text = _step(text, common, "invisible_control_removed", visible)
    out = _Readings()

    def starts():
        yield text, None
        yield from _delimited(text)

    for start, named in starts():
        steps = [*common, *([named] if named else [])]
        plain = _decoded(start, steps)
        yield from out.add(plain, steps)
        for other, name in _delimited(plain):
            yield from out.add(other, [*steps, name])
    for plain, steps in out.items():
        yield from out.add(leet(plain), [*steps, "leet_normalized"])
    for plain, steps in out.items():
        for m in _BASE64.finditer(plain) if _LONG_RUN.search(plain) else ():
            if base64_left <= 0:
                return
            inner = base64.b64decode(m[0], validate=False).decode("utf-8", "replace") if len(m[0]) <= BASE64_CHARS and len(m[0]) % 4 == 0 else ""
            if inner and len(inner) <= DECODED_CHARS and printable_ratio(inner) >= 0.9:
                base64_left -= 1
                for deeper, more in readings(inner, 0):
                    yield from out.add(deeper, [*steps, "base64_decoded", *more])


def readings(text: str, base64_left: int = MOST_BASE64) -> list[tuple[str, tuple[str, ...]]]:
    return list(each_reading(text, base64_left))
