"""Text helpers for Python code: the data model's white space and lengths in UTF-16 code units."""

from __future__ import annotations

import re

#: The white space of the data model.
SPACES = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{SPACES}]"
_RUN = re.compile(f"{WS}+")
_ODD = re.compile("[\x1c-\x1f\x85\ufeff]")  # where str.split() and the data model part


def trim(text: str) -> str:
    return text.strip(SPACES)


def squeezed(text: str) -> str:
    """Runs of white space as one blank, none at the ends."""
    return trim(_RUN.sub(" ", text)) if _ODD.search(text) else " ".join(text.split())


def dense(text: str) -> int:
    """Code units that are not white space."""
    return units(_RUN.sub("", text) if _ODD.search(text) else "".join(text.split()))


def plain(text: str) -> str:
    """Line ends as LF, blanks squeezed, one empty line at most."""
    text = re.sub(r"\r\n?", "\n", text)
    text = re.sub(r"[\t\f\v ]+", " ", text)
    text = re.sub(r" *\n *", "\n", text)
    return trim(re.sub(r"\n{3,}", "\n\n", text))


def inline(text: str) -> str:
    return trim(re.sub(f"{WS}*\n{WS}*", "\n", re.sub(r"[\t\f\v ]+", " ", text)))


def units(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def first_units(text: str, n: int) -> str:
    """The first n code units at most; half a pair is left out."""
    if n <= 0 or text.isascii():
        return text[: max(n, 0)]
    return text.encode("utf-16-le", "surrogatepass")[: 2 * n].decode("utf-16-le", "ignore")


def last_units(text: str, n: int) -> str:
    if n <= 0 or text.isascii():
        return text[-n:] if n > 0 else ""
    return text.encode("utf-16-le", "surrogatepass")[-2 * n :].decode("utf-16-le", "ignore")


def sampled(text: str, budget: int) -> str:
    """The larger half of the budget from the front and the rest from the end."""
    if units(text) <= budget:
        return text
    return first_units(text, -(-budget // 2)) + last_units(text, budget // 2)
