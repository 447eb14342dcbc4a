"""Screening of text segments for injected instructions.

A segment's readings, rules and request grammar run in one Arrow function, which makes no readings of texts in which no
rule can match (screening.open_rules); budgets, severities, policy, reason codes and merging are Columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..functions.batches import parts, short_batches
from ..functions.directives import holding, request, sentences
from ..functions.plain import units
from ..functions.rules import RULES, benign, candidates, lowered
from ..functions.screening import open_rules
from ..functions.variants import each_reading
from . import budget, policy

FINDING = "array<struct<category string, rule string, severity string, confidence double, location string, reason string, techniques array<string>, segment_hash string>>"
MAX_CHARACTERS = 250_000


def matches(text: str, lines: bool = False, first: bool = False) -> list[tuple]:
    """(rule, steps, reading number, start, end) of all matches, in UTF-16 units of the reading; first: of each rule's
    first one only, and no more readings than that takes."""
    out, left = [], set(open_rules(text))
    for k, (reading, steps) in enumerate(each_reading(text) if left else ()):
        if not left:
            break
        spans, low = None, None
        for rule in candidates(reading, left):
            if "word_delimiter_spaced" in steps and not rule.direct:
                continue
            if rule.action is None:
                hits = [p.search(reading) for p in rule.patterns]
                at = (min(m.start() for m in hits), max(m.end() for m in hits)) if all(hits) else None
            else:
                if spans is None:
                    spans, low = sentences(reading), lowered(reading)
                # no verb and no target stands in a sentence without one of the rule's words
                some = spans if low is None else holding(spans, low, sum(rule.stems, ()))
                at = request(reading, some, rule.patterns[rule.action], rule.patterns[1 - rule.action], secret=rule.category == "secret_exfiltration", direct=rule.direct, lines=lines)
            if at:
                out.append((rule, steps, k, *(units(reading[:x]) for x in at)))
                if first:
                    left.remove(rule.category)
    return out


def findings(text: str, location: str, strict: bool, lines: bool = False) -> list[dict]:
    """One segment's findings, one for each public category and rule; the first reading's is kept."""
    out: dict[tuple, dict] = {}
    found_first = matches(text, lines, first=True)
    if not found_first:
        return []
    harmless = location == "visible" and benign(text)
    mark = hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()[:16]
    for rule, steps, k, start, end in found_first:
        place = f" Detected in {location} content." if location in policy.HIDDEN_PLACES else ""
        reason = f"{rule.reason}{place} Rule {rule.category}; variant {k}; UTF-16 range [{start}, {end})."
        found = policy.placed(rule.category, rule.severity, location, harmless, strict)
        out.setdefault((found["category"], rule.category), found | {"rule": rule.category, "location": location, "reason": reason, "techniques": list(steps), "segment_hash": mark})
    if out and harmless:
        out["benign_mention", ""] = {"category": "benign_mention", "rule": "", "severity": "info", "confidence": 0.7, "location": "visible", "reason": "Content appears to discuss or quote a security pattern.", "techniques": [], "segment_hash": mark}
    return list(out.values())


#: Letters that look like no other in any reading; all else beyond ASCII may.
PLAIN_LETTERS = r"\x09\x0A\x0D\x20-\x7E\u00A1\u00AB\u00BB\u00BF\u00C0-\u012F\u0134-\u013E\u0141-\u0148\u014A-\u017E\u2013\u2014\u2018-\u201D\u0410-\u044F"


#: What is left out of a text before rules' words are looked for, and the signs that may stand for letters.
JOINTS, SIGNS, LETTERS = " \t\n\r\x0b\x0c._|/\\-", "013457@$", "oieastas"


def possible(text: Column) -> Column:
    """Whether some rule could match some reading, for a filter in the JVM before texts are shuffled.

    Without white space, delimiters and signs that stand for letters, a text holds the words of all its readings, but
    for characters that normalise to others, escapes and encoded runs; those make a text possible by themselves.
    """

    def some_rule(bare: Column) -> Column:
        out = F.lit(False)
        for rule in RULES:
            every = F.lit(True)
            for stems in sorted(rule.stems, key=lambda stems: -min(map(len, stems))):  # the rarer words first
                words = sorted({s.replace(" ", "") for s in stems})
                # a word that holds another one adds nothing
                any_ = [F.contains(bare, F.lit(w)) for w in words if not any(o != w and o in w for o in words)]
                every = every & reduce(or_, any_)
            out = out | every
        return out

    # a list of one element, so that the bare text is made once for all the words
    bare = F.translate(F.lower(text), SIGNS + JOINTS, LETTERS)
    rules = F.exists(F.array(bare), some_rule)
    odd = F.when(F.octet_length(text) == F.length(text), text.rlike(r"[^\t\n\r -~]")).otherwise(text.rlike(f"[^{PLAIN_LETTERS}]"))
    escaped = (F.contains(text, F.lit("\\")) & text.rlike(r"\\[uxUX]")) | (F.contains(text, F.lit("%")) & text.rlike("%[0-9a-fA-F]{2}"))
    spelled = text.rlike(r"(?:^|[^A-Za-z])[A-Za-z][\t ]+[A-Za-z][\t ]+[A-Za-z][\t ]")
    encoded = F.translate(text, "._|\\-", "").rlike("[A-Za-z0-9+/@$]{16}")
    return F.coalesce(rules | encoded | odd | escaped | spelled, F.lit(False))


def scan(segments: DataFrame, *, strict: bool = False, text: str = "text", location: str = "location", lines: bool | str = False, carry: list[str] | None = None) -> DataFrame:
    """segments with findings, an array. Null texts and those in which no rule could match have an empty one.

    carry: the columns that the result keeps (all, if None). lines: whether a line's end ends a clause, or a column's name.
    """
    short_batches(segments.sparkSession)
    carry = list(segments.columns) if carry is None else carry
    ends = F.col(lines) if isinstance(lines, str) else F.lit(lines)
    marked = segments.select(*[F.col(f"`{c}`") for c in carry], F.col(text).alias("__text"), F.col(location).alias("__place"), ends.alias("__lines"))
    schema = T.StructType([*(segments.schema[c] for c in carry), T.StructField("findings", T._parse_datatype_string(FINDING))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema["findings"].dataType)
        for batch in parts(batches):
            columns = (c.to_pylist() for c in batch.columns[-3:])
            found = [[] if x is None else findings(x, place, strict, bool(cut)) for x, place, cut in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(found, kind)], [*carry, "findings"])

    return marked.mapInArrow(run, schema)


def decided(scanned: DataFrame, keys: list[str], use: str = "answer", truncated: str | None = None) -> DataFrame:
    """Scanned segments -> one decision per item: strongest severity, hidden places and truncation over its segments."""
    relevant = F.filter("findings", lambda x: x["category"] != "benign_mention")
    strongest = F.coalesce(F.array_max(F.transform(relevant, lambda x: policy.rank(policy.SEVERITIES, x["severity"]))), F.lit(0))
    hidden = F.exists(relevant, lambda x: x["location"].isin(*policy.HIDDEN_PLACES, "attribute"))
    per = scanned.select(*keys, strongest.alias("s"), hidden.alias("h"), (F.col(truncated) if truncated else F.lit(False)).alias("t"), F.size(relevant).alias("n"))
    out = per.groupBy(*keys).agg(F.max("s").alias("s"), F.bool_or("h").alias("h"), F.bool_or("t").alias("t"), F.sum("n").cast("long").alias("findings"))
    return out.select(*keys, "findings", policy.named(policy.SEVERITIES, F.col("s")).alias("severity"), policy.decision(F.col("t"), F.col("s"), F.col("h"), F.lit(use)).alias("decision"))


def budgeted(segments: DataFrame, key: str, ordinal: str, text: str = "text", most: int = MAX_CHARACTERS, segments_most: int | None = None) -> DataFrame:
    """segments with allocation, the characters of each that are read, and the text cut to them, front and end.

    All segments of an item share one budget. Beyond segments_most, only the first and last segments of an item have a share;
    the others stay as rows, with a null text and an allocation of 0.
    """
    size = t.u16len(F.col(text))
    sized = segments.withColumn("__length", F.coalesce(size, F.lit(0)))
    if segments_most is not None:
        sized = budget.marked_head_tail(sized, key, ordinal, segments_most, "__read")
    else:
        sized = sized.withColumn("__read", F.lit(True))
    shared = budget.water_filled(sized.withColumn("__wanted", F.when(F.col("__read"), F.col("__length")).otherwise(0)), key, ordinal, "__wanted", most)
    cut = F.when(F.col("__length") <= F.col("allocation"), F.col(text)).when(F.col("allocation") > 0, t.head_tail(F.col(text), F.col("allocation").cast("int")))
    return shared.withColumn(text, cut).withColumnsRenamed({"__length": "length", "__read": "selected"}).drop("__wanted")


def inspect(segments: DataFrame, key: str, *, ordinal: str = "ordinal", use: str | Column = "answer", strict: bool = False, most: int = MAX_CHARACTERS, segments_most: int | None = None) -> DataFrame:
    """Segments (key, ordinal, location, text, truncated, lines, omitted) -> one verdict per item.

    key, decision, assurance, severity, findings, reason_codes, reasons, limitations, diagnostics. The findings of an item stand in the
    order of its segments, each (category, rule, location, hash) once. A null text counts as empty.
    """
    rows = budgeted(segments, key, ordinal, most=most, segments_most=segments_most)
    kept = [key, ordinal, "truncated", "omitted", "length", "selected", "allocation"]
    scanned = scan(rows, strict=strict, lines="lines", carry=kept)
    found = F.sort_array(F.collect_list(F.when(F.size("findings") > 0, F.struct(F.col(ordinal).alias("o"), F.col("findings").alias("f")))))
    cut = F.bool_or(F.col("selected") & (F.col("allocation") < F.col("length")))
    item = scanned.groupBy(key).agg(
        F.flatten(F.transform(found, lambda x: x["f"])).alias("f"), F.bool_or("truncated").alias("long"), F.max("omitted").alias("omitted"), F.coalesce(cut, F.lit(False)).alias("over"),
        F.count("*").alias("segments"), F.count_if("selected").alias("picked"), F.count_if(F.col("allocation") > 0).alias("scanned"),
        F.sum("length").alias("available"), F.sum("allocation").alias("characters"),
    )
    return policy.verdict(item, key, use if isinstance(use, Column) else F.lit(use), most, segments_most or 0)
