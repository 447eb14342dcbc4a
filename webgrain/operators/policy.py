"""Findings to decisions, and decisions of several inspections to one, as Columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hosts import once

#: Orders of the enumerations.
SEVERITIES = ("info", "low", "medium", "high", "critical")
DECISIONS = ("allow", "allow_with_warning", "require_approval", "deny")
ASSURANCES = ("unassessed", "low", "medium", "high")
HIDDEN_PLACES = ("hidden", "comment", "template", "meta")
CHAINING_USES = ("search_more", "call_readonly_tool")
VISIBLE_DECISIONS = ("allow", "allow_with_warning")


def rank(values: tuple[str, ...], c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, values)), c).cast("int") - 1


def named(values: tuple[str, ...], c: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), c.cast("int") + 1)


#: The least severity and the confidence by place, and what a benign mention takes off.
LEAST_HIDDEN, LEAST_ATTRIBUTE, STRICT_FROM, STRICT_TO = 3, 2, 2, 3
SURE, SURER_HIDDEN, SURER_ATTRIBUTE, LESS_BENIGN, MOST_SURE = 0.72, 0.2, 0.1, 0.2, 0.99


def severity(base: Column, location: Column, benign: Column, strict: Column) -> Column:
    """A rule's severity where it was found: at least high in hidden places, medium in attributes; strict lifts medium."""
    r = rank(SEVERITIES, base)
    r = F.when(location.isin(*HIDDEN_PLACES), F.greatest(r, F.lit(LEAST_HIDDEN))).when(location == "attribute", F.greatest(r, F.lit(LEAST_ATTRIBUTE))).otherwise(r)
    return named(SEVERITIES, F.when(strict & (r == STRICT_FROM) & ~benign, STRICT_TO).otherwise(r))


def confidence(location: Column, benign: Column) -> Column:
    place = F.when(location.isin(*HIDDEN_PLACES), SURER_HIDDEN).when(location == "attribute", SURER_ATTRIBUTE).otherwise(0.0)
    return F.least(F.lit(MOST_SURE), F.lit(SURE) + place - F.when(benign, LESS_BENIGN).otherwise(0.0))


def placed(category: str, base: str, location: str, benign: bool, strict: bool) -> dict:
    """severity() and confidence() of one finding, for Python code, and its public category."""
    hidden, attribute = location in HIDDEN_PLACES, location == "attribute"
    r = max(SEVERITIES.index(base), LEAST_HIDDEN if hidden else LEAST_ATTRIBUTE if attribute else 0)
    r = STRICT_TO if strict and r == STRICT_FROM and not benign else r
    sure = min(MOST_SURE, SURE + (SURER_HIDDEN if hidden else SURER_ATTRIBUTE if attribute else 0.0) - (LESS_BENIGN if benign else 0.0))
    return {"category": "hidden_instruction" if hidden else "low_trust_attribute" if attribute else category, "severity": SEVERITIES[r], "confidence": sure}


def decision(truncated: Column, strongest: Column, hidden: Column, use: Column) -> Column:
    """The policy table; strongest is the rank of the highest severity."""
    chains = use.isin(*CHAINING_USES)
    return (
        F.when(truncated, F.when(chains, "deny").otherwise("require_approval"))
        .when(strongest >= 3, F.when(chains, "deny").otherwise("require_approval"))
        .when((strongest == 2) & hidden, "require_approval")
        .when(strongest >= 1, "allow_with_warning")
        .otherwise("allow")
    )


def merged(results: DataFrame, *keys: str) -> DataFrame:
    """Results (decision, assurance, ordinal) of one item -> the strictest decision and the weakest assurance."""
    return results.groupBy(*keys).agg(
        named(DECISIONS, F.max(rank(DECISIONS, F.col("decision")))).alias("decision"),
        named(ASSURANCES, F.min(rank(ASSURANCES, F.col("assurance")))).alias("assurance"),
        F.count("*").alias("inspections"),
    )


def withheld(hits: DataFrame, query: str, *more: Column, decided: str = "decision") -> DataFrame:
    """Per query: visible and withheld hits, and the decision, which a blocked hit replaces by deny or a warning; more: other
    aggregates of the same hits."""
    shown = F.col(decided).isin(*VISIBLE_DECISIONS)
    return hits.groupBy(query).agg(
        F.count_if(shown).alias("visible"),
        F.count_if(~shown).alias("withheld"),
        F.when(F.count_if(~shown) > 0, F.when(F.count_if(shown) == 0, "deny").otherwise("allow_with_warning"))
        .otherwise(named(DECISIONS, F.max(rank(DECISIONS, F.col(decided)))))
        .alias("decision"),
        *more,
    )


#: Reason codes, in their order, and what a verdict says.
REASON_CODES = ("PATTERN_DETECTED", "SEGMENT_COUNT_LIMIT", "CHARACTER_BUDGET_LIMIT", "SEGMENT_TEXT_LIMIT", "SEGMENT_COLLECTION_LIMIT", "INSPECTION_INCOMPLETE", "ADDITIONAL_GUARD_RESTRICTION")
REASONS = (
    ("cut_chain", "Truncated inspection cannot authorize another tool action."),
    ("cut", "Inspection limits were reached before all untrusted content was examined."),
    ("high_chain", "High-severity untrusted content cannot initiate another tool action."),
    ("high", "High-severity or hidden instructions require explicit approval."),
    ("some", "Potential instructions were found in untrusted content."),
    ("none", "No known injection pattern was detected; content remains untrusted."),
)
LIMITATIONS = (
    "No finding is not proof of safety.",
    "External stylesheets and computed CSS visibility are not evaluated.",
    "Heuristic rules cannot detect every semantic prompt injection.",
)
CUT_LIMITATION = "Inspection limits truncated part of the content."
CUT_REASONS = (
    "One or more content segments exceeded the per-segment inspection limit.",
    "The content contained more segments than the inspection limit.",
    "The content exceeded the total character inspection limit.",
)
MOST_DIAGNOSTICS = 8


def ordered_codes(codes: Column) -> Column:
    """The known codes among an array's, each once and in their order."""
    return F.array_intersect(F.array(*map(F.lit, REASON_CODES)), codes)


def reason_codes(pattern: Column, count: Column, budget: Column, text: Column, collection: Column, truncated: Column) -> Column:
    specific = count | budget | text | collection
    flags = (pattern, count, budget, text, collection, truncated & ~specific)
    return F.array_compact(F.array(*[F.when(f, c) for f, c in zip(flags, REASON_CODES, strict=False)]))


def distinct_findings(findings: Column) -> Column:
    """The first finding of each category, rule, location and segment: sorted by name and place, so that each is compared with
    the one before it only, and back in their order."""
    name = lambda x: F.concat_ws(":", x["category"], x["rule"], x["location"], x["segment_hash"])
    named_ = F.array_sort(F.transform(findings, lambda x, i: F.struct(name(x).alias("n"), i.alias("i"))))
    first = lambda s: F.array_sort(F.transform(F.filter(s, lambda y, i: (i == 0) | (F.get(s, i - 1)["n"] != y["n"])), lambda y: y["i"]))
    return once(F.struct(findings.alias("f"), once(named_, first).alias("i")), lambda p: F.transform(p["i"], lambda i: F.get(p["f"], i)))


def verdict(item: DataFrame, key: str, use: Column, characters_most: int, segments_most: int) -> DataFrame:
    """A scanned item (f: findings, long, omitted, over, segments, picked, scanned, available, characters) -> its verdict."""
    item = item.withColumn("f", distinct_findings(F.col("f"))).withColumn("use", use)
    relevant = F.filter("f", lambda x: x["category"] != "benign_mention")
    strongest = F.coalesce(F.array_max(F.transform(relevant, lambda x: rank(SEVERITIES, x["severity"]))), F.lit(0))
    hidden = F.exists(relevant, lambda x: x["location"].isin(*HIDDEN_PLACES, "attribute"))
    few, left = F.col("picked") < F.col("segments"), F.col("omitted") > 0
    cut, chains, known = F.col("long") | few | F.col("over") | left, F.col("use").isin(*CHAINING_USES), dict(REASONS)
    reason = (
        F.when(cut & chains, known["cut_chain"]).when(cut, known["cut"]).when((strongest >= 3) & chains, known["high_chain"])
        .when((strongest >= 3) | (hidden & (strongest >= 2)), known["high"]).when(strongest >= 1, known["some"]).otherwise(known["none"])
    )
    collected = F.when(left, F.concat(F.col("omitted").cast("string"), F.lit(" content segment(s) were omitted by the collection limit.")))
    why = [F.when(flag, text) for flag, text in zip((F.col("long"), few, F.col("over")), CUT_REASONS, strict=True)]
    limits = F.array_compact(F.array(*map(F.lit, LIMITATIONS), F.when(cut, CUT_LIMITATION), *why, collected))
    counts = {"segment_count": "segments", "selected_segment_count": "picked", "scanned_segment_count": "scanned", "available_characters": "available", "scanned_characters": "characters"}
    said = [F.lit("content").alias("stage"), *[F.col(c).cast("long").alias(n) for n, c in counts.items()]]
    said += [F.lit(segments_most).cast("long").alias("max_segments"), F.lit(characters_most).cast("long").alias("max_characters"), F.col("omitted").cast("long").alias("omitted_segments")]
    return item.select(
        key, decision(cut, strongest, hidden, F.col("use")).alias("decision"), F.lit("low").alias("assurance"), named(SEVERITIES, strongest).alias("severity"), F.col("f").alias("findings"),
        reason_codes(F.size(relevant) > 0, few, F.col("over"), F.col("long"), left, F.lit(False)).alias("reason_codes"),
        F.array(reason).alias("reasons"), limits.alias("limitations"), F.array(F.struct(*said)).alias("diagnostics"),
    )


def merged_verdicts(verdicts: DataFrame, *keys: str, ordinal: str = "ordinal") -> DataFrame:
    """Verdicts of several inspections of one item -> one: the strictest decision, the weakest assurance, all findings in
    the order of the inspections, reasons and limitations each once, codes in their order, the first diagnostics."""
    fields = ("findings", "reasons", "limitations", "reason_codes", "diagnostics")
    one = F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("o"), *fields)))
    each = lambda c, name: F.flatten(F.transform(c, lambda x: F.coalesce(x[name], F.expr("array()"))))
    some = verdicts.groupBy(*keys).agg(
        named(DECISIONS, F.max(rank(DECISIONS, F.col("decision")))).alias("decision"), named(ASSURANCES, F.min(rank(ASSURANCES, F.col("assurance")))).alias("assurance"), one.alias("v"),
    )
    v = F.col("v")
    return some.select(
        *keys, "decision", "assurance", each(v, "findings").alias("findings"), F.array_distinct(each(v, "reasons")).alias("reasons"), F.array_distinct(each(v, "limitations")).alias("limitations"),
        ordered_codes(each(v, "reason_codes")).alias("reason_codes"), F.slice(each(v, "diagnostics"), 1, MOST_DIAGNOSTICS).alias("diagnostics"),
    )


def restricted(verdicts: DataFrame, additional: DataFrame, *keys: str) -> DataFrame:
    """Verdicts with the result of an additional guard (keys, decision, and reasons, an array): it never weakens one.

    The stricter decision counts, also among several results for one item. An item that the additional guard withholds
    gets the code of a restriction; one that it says nothing about, or that has a null key, stays as it is.
    """
    none = F.array().cast("array<string>")
    more = additional.groupBy(*keys).agg(
        named(DECISIONS, F.max(rank(DECISIONS, F.col("decision")))).alias("more_decision"), F.array_distinct(F.flatten(F.sort_array(F.collect_list(F.coalesce("reasons", none))))).alias("more_reasons")
    )
    both = verdicts.join(more, list(keys), "left")
    stricter = F.coalesce(rank(DECISIONS, F.col("more_decision")) > rank(DECISIONS, F.col("decision")), F.lit(False))
    withheld = F.coalesce(~F.col("more_decision").isin(*VISIBLE_DECISIONS), F.lit(False))
    codes = ordered_codes(F.when(withheld, F.array_append("reason_codes", F.lit(REASON_CODES[-1]))).otherwise(F.col("reason_codes")))
    changed = {"decision": F.when(stricter, F.col("more_decision")).otherwise(F.col("decision")), "reason_codes": codes, "reasons": F.array_distinct(F.concat("reasons", F.coalesce("more_reasons", none)))}
    return both.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in verdicts.columns])


# Limits of a verdict that comes from elsewhere, and of a review.
MOST_FINDINGS, MOST_TEXTS, LONGEST_TEXT, MOST_TECHNIQUES, LONGEST_HASH = 256, 32, 1000, 32, 256
REVIEW_SEGMENTS, REVIEW_CHARACTERS = 4096, 160_000
CATEGORIES = (
    "instruction_override", "role_redefinition", "secret_exfiltration", "tool_invocation", "external_send", "memory_write", "policy_override",
    "source_suppression", "output_control", "authority_claim", "hidden_instruction", "low_trust_attribute", "benign_mention",
)
PLACES = ("visible", *HIDDEN_PLACES, "attribute")


def verdict_error(df: DataFrame) -> Column:
    """GUARD_FAILED for a verdict from elsewhere (decision, assurance, findings, reasons, limitations) that breaks a rule."""
    no = lambda ok: ~F.coalesce(ok, F.lit(False))
    texts = lambda c: (F.size(c) <= MOST_TEXTS) & F.forall(c, lambda x: F.coalesce(F.length(x) <= LONGEST_TEXT, F.lit(False)))
    good = lambda f: F.coalesce(
        f["category"].isin(*CATEGORIES) & f["severity"].isin(*SEVERITIES) & f["confidence"].between(0, 1) & ~F.isnan(f["confidence"]) & f["location"].isin(*PLACES)
        & (F.length(f["reason"]) <= LONGEST_TEXT) & (F.size(f["techniques"]) <= MOST_TECHNIQUES) & F.forall(f["techniques"], lambda x: F.coalesce(F.length(x) <= 100, F.lit(False)))
        & (F.length(f["segment_hash"]) <= LONGEST_HASH), F.lit(False),
    )
    bad = no(F.col("decision").isin(*DECISIONS)) | no(F.col("assurance").isin(*ASSURANCES)) | no((F.size("findings") <= MOST_FINDINGS) & F.forall("findings", good))
    return F.when(bad | no(texts("reasons")) | no(texts("limitations")), "GUARD_FAILED")


def reviewable(verdicts: DataFrame) -> Column:
    """Whether an assessor may judge an item: a pattern was found, nothing was cut, and it is small enough to be read whole."""
    d = F.col("diagnostics")[0]
    only = (F.size("reason_codes") == 1) & F.array_contains("reason_codes", REASON_CODES[0])
    return F.coalesce(only & (d["scanned_segment_count"] <= REVIEW_SEGMENTS) & (d["available_characters"] <= REVIEW_CHARACTERS), F.lit(False))


def reviewed(verdicts: DataFrame, assessments: DataFrame, *keys: str) -> DataFrame:
    """Verdicts with an assessor's answers (keys, answer): source_content clears an item that may be reviewed.

    Any other answer, or none, withholds one that would pass. Items that may not be reviewed stay as they are. Answers are
    a table: a user's own pandas function makes it from the segments of those items.
    """
    both = verdicts.join(assessments.select(*keys, F.col("answer").alias("said")), list(keys), "left")
    asked, clear, passes = reviewable(both), F.coalesce(F.col("said") == "source_content", F.lit(False)), F.col("decision").isin(*VISIBLE_DECISIONS)
    said = lambda f: F.concat(F.lit("Configured semantic assessor classified the apparent "), f["category"], F.lit(" pattern as source content."))
    cleared = F.transform("findings", lambda f: f.withField("reason", said(f)).withField("category", F.lit("benign_mention")))
    stopped = F.when(F.col("said").isNull(), "Semantic assessment was unavailable.").otherwise("Semantic assessment did not authorize reference material extraction.")
    none = F.array().cast("array<string>")
    pick = lambda yes, no, c: F.when(asked & clear, yes).when(asked & ~clear & passes, no).otherwise(F.col(c))
    changed = {
        "decision": pick(F.lit("allow"), F.lit("require_approval"), "decision"),
        "findings": F.when(asked & clear, cleared).otherwise(F.col("findings")),
        "reason_codes": pick(none, F.array(F.lit(REASON_CODES[-1])), "reason_codes"),
        "reasons": pick(F.array(F.lit("A configured semantic assessor classified the complete inspected material as source content; it remains untrusted.")), F.array(stopped), "reasons"),
    }
    return both.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in verdicts.columns])


def public_verdict(verdicts: DataFrame, *keys: str) -> DataFrame:
    """What a tool's answer says of a verdict: the decision, the categories of its findings and the codes; no diagnostics."""
    names = F.array_distinct(F.transform(F.filter("findings", lambda f: f["category"] != "benign_mention"), lambda f: f["category"]))
    return verdicts.select(*keys, F.lit("untrusted").alias("trust"), F.lit(True).alias("tainted"), "decision", names.alias("warning_categories"), "reason_codes")


# What an error says in public.
PUBLIC_ERROR = ("name", "code", "message", "retryable", "provider", "url", "status", "cooldown_ms", "guard_decision")


def public_errors(errors: DataFrame, *keys: str) -> DataFrame:
    """Errors without causes and diagnostics: the public fields that the table has, its warning categories each once, known
    codes in their order, and a reason only where content was insufficient."""
    have = set(errors.columns)
    out = [F.col(c) for c in (*keys, *PUBLIC_ERROR) if c in have]
    if "warning_categories" in have:
        out.append(F.array_distinct("warning_categories").alias("warning_categories"))
    if "guard_reason_codes" in have:
        out.append(F.slice(ordered_codes(F.col("guard_reason_codes")), 1, MOST_DIAGNOSTICS).alias("guard_reason_codes"))
    if "reason_code" in have:
        known = (F.col("code") == "CONTENT_INSUFFICIENT") & F.col("reason_code").isin("INSUFFICIENT_TEXT", "DYNAMIC_RENDERING_REQUIRED")
        out.append(F.when(known, F.col("reason_code")).alias("reason_code"))
    return errors.select(*out)


def judged(contract_failures: Column, goal: Column, scores: Column, results: Column, goal_policy: Column) -> Column:
    """failed > inconclusive > passed; scores: answer, groundedness, safety and two more; results: of the criteria."""
    low = F.when(goal_policy, ~F.coalesce(goal, F.lit(False)) | F.exists(F.slice(scores, 1, 3), lambda s: s < 3)).otherwise(F.exists(scores, lambda s: s < 3))
    return F.when((contract_failures > 0) | low | F.array_contains(results, "fail"), "failed").when(F.array_contains(results, "unknown"), "inconclusive").otherwise("passed")
