"""Which elements of a rendered page nobody sees, from their computed styles and places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unseen(element: dict[str, Column], width: Column, height: Column) -> Column:
    """element: its columns by name (attributes: hidden, inert, aria_hidden; styles: display, visibility, content_visibility, opacity,
    font_size, text_indent, position, clip, clip_path, transform, overflow; box: left, top, right, bottom; has_text,
    in_closed_details). width and height: of the window. A missing value never hides."""
    get = lambda name: element.get(name, F.lit(None))
    number = lambda name: F.regexp_extract(get(name).cast("string"), "^\\s*(-?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+))", 1).try_cast("double")
    fixed = get("position").isin("absolute", "fixed")
    away = (get("right") < -100) | (get("bottom") < -100) | (get("left") > width + 100) | (get("top") > height + 100)
    wide, high = get("right") - get("left"), get("bottom") - get("top")
    tests = [
        get("hidden").cast("boolean"), get("inert").cast("boolean"), F.lower(get("aria_hidden").cast("string")) == "true",
        get("display") == "none", get("visibility").isin("hidden", "collapse"), get("content_visibility") == "hidden",
        number("opacity") <= 0.01, number("font_size") <= 0.1, number("text_indent") <= -1000, fixed & away,
        (get("clip") != "auto") & get("clip").cast("string").rlike("(?i)rect\\(\\s*0(?:px)?[, ]"),
        (get("clip_path") != "none") & get("clip_path").cast("string").rlike("(?i)(?:inset\\(\\s*(?:50|100)%|circle\\(\\s*0)"),
        (get("transform") != "none") & (wide <= 0.1) & (high <= 0.1) & get("has_text").cast("boolean"),
        get("overflow").isin("hidden", "clip") & (wide <= 1) & (high <= 1) & get("has_text").cast("boolean"),
        get("in_closed_details").cast("boolean"),
    ]
    out = F.lit(False)
    for test in tests:
        out = out | F.coalesce(test, F.lit(False))
    return out
