"""The rules that can match a text, told without making its readings."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from .rules import JAPANESE, RULES, candidates
from .variants import readings, visible

#: What a reading may leave out between letters, and the signs that it may take for letters.
JOINTS, SIGNS = b" \t\n\r\x0b\x0c._|/\\-", bytes.maketrans(b"013457@$", b"oieastas")
_L = r"[^\W\d_]"
_ESCAPED = re.compile(r"\\[uxUX]|%[0-9a-fA-F][\t ._|/\\-]*[0-9a-fA-F]")
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:{_L}[\t ._|/\\-]+){{3}}{_L}(?![A-Za-z0-9])")
# the second and third letter of what is spelled out
_LONE = re.compile(rf"[\t ._|/\\-]{_L}[\t ._|/\\-]+{_L}[\t ._|/\\-]")
_RUN, _WITHIN = re.compile(r"[A-Za-z0-9+/@$]{16}"), re.compile(r"[._|\\-]")
LONGEST_KEPT = 64


def _stems() -> list[list[list[bytes]]]:
    """Of each rule, the words of each part without blanks, the part of the rarer words first. A word that holds another
    one adds nothing."""
    out = []
    for rule in RULES:
        parts = [{s.replace(" ", "") for s in part} for part in rule.stems]
        parts = [[w for w in some if not any(o != w and o in w for o in some)] for some in parts]
        out.append([sorted(w.encode() for w in some) for some in sorted(parts, key=lambda some: -min(map(len, some)))])
    return out


_STEMS = _stems()


def _decodes(token: str) -> bool:
    return any("base64_decoded" in steps and candidates(reading) for reading, steps in readings(token))


_decodes_kept = lru_cache(1 << 14)(_decodes)


ALL = frozenset(rule.category for rule in RULES)


def open_rules(text: str) -> frozenset[str]:
    """The categories of rules that may match some reading: all that do are among them.

    Once a text is normalised and without escapes, its readings only leave out joints and change signs, so that
    all their words stand in the text without joints. What is encoded stands between two blanks, unless letters are
    spelled out, and is decoded by itself.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if JAPANESE.search(text):
            return ALL
    text = visible(text)
    if (("\\" in text or "%" in text) and _ESCAPED.search(text)) or (_LONE.search(text) and _SPELLED.search(text)):
        return ALL
    bare = text.encode("utf-8", "replace").lower().translate(SIGNS, JOINTS)
    for token in text.split():
        if len(token) >= 16 and _RUN.search(_WITHIN.sub("", token)) and (_decodes_kept if len(token) <= LONGEST_KEPT else _decodes)(token):
            return ALL
    return frozenset(rule.category for rule, parts in zip(RULES, _STEMS, strict=True) if all(any(w in bare for w in words) for words in parts))
