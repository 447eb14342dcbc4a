"""Text expressions: UTF-16 lengths, whitespace, truncation, sampling and hashing, all as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of the data model, beyond ASCII too.
SPACES = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
BLANKS = "\\x09\\x0A\\x0B\\x0C\\x0D\\x20\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"


def u16len(c: Column) -> Column:
    """UTF-16 code units: code points beyond the basic plane count twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def plain_text(c: Column) -> Column:
    """Line ends to LF, blanks collapsed and cut around line ends, one empty line at most."""
    # only what changes is matched, not each single blank or line end
    c = F.regexp_replace(c, "\\r\\n?", "\n")
    c = F.regexp_replace(c, "[\\t\\f\\x0B ]{2,}|[\\t\\f\\x0B]", " ")
    c = F.regexp_replace(c, " +\\n *|\\n +", "\n")
    return trimmed(F.regexp_replace(c, "\\n{3,}", "\n\n"))


def inline_text(c: Column) -> Column:
    c = F.regexp_replace(c, "[\\t\\f\\x0B ]+", " ")
    return trimmed(F.regexp_replace(c, f"[{BLANKS}]*\\n[{BLANKS}]*", "\n"))


def external_text(c: Column) -> Column:
    """Control characters go, tabs and line ends become blanks, runs of white space one blank."""
    c = F.regexp_replace(c, "[\\t\\n\\r]", " ")
    c = F.regexp_replace(c, "[\\x00-\\x1f\\x7f-\\x9f]", "")
    return trimmed(F.regexp_replace(c, f"[{BLANKS}]+", " "))


def has_control(c: Column) -> Column:
    return c.rlike("[\\x00-\\x1f\\x7f]")


def _units(c: Column, begin: Column, n: Column) -> Column:
    """n code units from the begin-th (from 0) on; half a pair at either end is left out."""
    raw = F.encode(c, "UTF-16BE")
    at = lambda k: F.hex(F.substring(raw, (2 * k + 1).cast("int"), F.lit(1)))
    first = begin + F.when(at(begin).between("DC", "DF"), 1).otherwise(0)
    last = begin + n - F.when(at(begin + n - 1).between("D8", "DB"), 1).otherwise(0)
    cut = F.decode(F.substring(raw, (2 * first + 1).cast("int"), F.greatest(2 * (last - first), F.lit(0)).cast("int")), "UTF-16BE")
    # texts of the basic plane need no detour
    plain = F.substring(c, (begin + 1).cast("int"), n.cast("int"))
    return F.when(n <= 0, "").when(F.length(c) == u16len(c), plain).otherwise(cut)


def first_units(c: Column, n: Column | int) -> Column:
    """The first n code units at most."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(u16len(c) <= n, c).otherwise(_units(c, F.lit(0), n))


def truncated(c: Column, limit: int) -> Column:
    """The first limit code units, without the white space before the cut."""
    return F.when(u16len(c) <= limit, c).otherwise(F.regexp_replace(first_units(c, limit), f"[{BLANKS}]+$", ""))


def excerpt(c: Column, limit: int = 240) -> Column:
    return F.when(u16len(c) > limit, truncated(c, limit))


def head_tail(c: Column, budget: Column | int) -> Column:
    """The larger half of the budget, in code units, from the front and the rest from the end, joined by nothing."""
    n = budget if isinstance(budget, Column) else F.lit(budget)
    size, head, tail = u16len(c), F.ceil(n / 2), F.floor(n / 2)
    return F.when(n <= 0, "").when(size <= n, c).otherwise(F.concat(_units(c, F.lit(0), head), _units(c, size - tail, tail)))


def segment_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def printable_ratio(c: Column) -> Column:
    good = F.regexp_count(c, F.lit(f"[\\p{{L}}\\p{{N}}\\p{{P}}\\p{{Z}}{BLANKS}]"))
    return F.when(F.length(c) > 0, good / F.length(c)).otherwise(0.0)


def markdown_escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return F.regexp_replace(c, "([\\\\`*_\\[\\]#])", "\\\\$1")


def code_language(class_name: Column) -> Column:
    found = F.regexp_extract(class_name, "(?:^|\\s)language-([\\w+-]{1,32})(?:\\s|$)", 1)
    return F.when(found != "", found)


def formula_safe(c: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a leading apostrophe."""
    return F.when(c.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def quality_score(characters: Column, paragraphs: Column, link_text: Column) -> Column:
    density = F.when(characters == 0, 1.0).otherwise(F.least(F.lit(1.0), link_text / characters))
    off = F.floor(density * F.least(characters, F.lit(10_000)) + 0.5)
    return (F.least(characters, F.lit(20_000)) + F.least(paragraphs, F.lit(20)) * 120 - off).cast("long")


#: Inline styles that hide an element.
HIDDEN_STYLES = (
    r"display\s*:\s*none",
    r"visibility\s*:\s*hidden",
    r"content-visibility\s*:\s*hidden",
    r"opacity\s*:\s*0(?:\.0+)?",
    r"font-size\s*:\s*0(?:px|em|rem|%)?",
    r"text-indent\s*:\s*-\d{3,}(?:px|em|rem)?",
    r"transform\s*:\s*scale(?:x|y)?\s*\(\s*0(?:\.0+)?(?:\s*,\s*0(?:\.0+)?)?\s*\)",
)
OFFSCREEN = (r"(?:^|;)\s*position\s*:\s*(?:absolute|fixed)\b", r"(?:^|;)\s*(?:left|top|right|bottom)\s*:\s*(?:-\d{3,}|\d{4,})(?:px|em|rem)?\b")
CLIPPED = r"(?:^|;)\s*clip(?:-path)?\s*:\s*(?:rect\s*\(\s*0|inset\s*\(\s*(?:50|100)%|circle\s*\(\s*0)"
HIDDEN = rf"(?i)(?:^|;)\s*(?:{'|'.join(HIDDEN_STYLES)})(?:\s*!important)?\s*(?:;|$)"


def style_hidden(style: Column) -> Column:
    s = trimmed(F.regexp_replace(style, f"[{BLANKS}]+", " "))
    return s.rlike(HIDDEN) | (s.rlike("(?i)" + OFFSCREEN[0]) & s.rlike("(?i)" + OFFSCREEN[1])) | s.rlike("(?i)" + CLIPPED)
