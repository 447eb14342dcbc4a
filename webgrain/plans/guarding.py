"""Queries on screening: prefilters, severities, budgets, policy and merging."""

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import budget, guard, policy
from .registry import query

USES = ("answer", "summarize", "search_more", "call_readonly_tool", "quote")
PLACES = ("visible", "hidden", "comment", "template", "meta", "attribute")


def _pick(values, c):
    return F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))


def _sql_pick(values, c):
    return f"list_value({', '.join(repr(v) for v in values)})[1 + CAST({c} % {len(values)} AS INTEGER)]"


@query(None)
def guard_decisions(spark, read):
    """Plain text -> readings -> rules -> policy; a decision for each document that is long enough to read."""
    docs = read("documents").select("doc_id", "text").select("doc_id", t.plain_text(F.col("text")).alias("text"), F.lit("visible").alias("location"))
    sized = docs.withColumn("size", t.u16len(F.col("text"))).withColumn("cut", F.col("size") > guard.MAX_CHARACTERS)
    sized = sized.withColumn("text", F.when(F.col("cut"), t.head_tail(F.col("text"), guard.MAX_CHARACTERS)).otherwise(F.col("text")))
    # the condition on the size comes after the scan: before it, the optimizer would have each plain text made twice
    scanned = guard.scan(sized, carry=["doc_id", "cut", "size"]).where("size >= 20")
    return guard.decided(scanned, ["doc_id"], truncated="cut")


@query(None)
def guard_conversations(spark, read):
    """Each turn is a segment; the conversation gets one verdict under one budget."""
    turns = read("conversations").select(
        "conv_id", F.col("turn").alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("role") == "system", "meta").otherwise("visible").alias("location"),
        F.lit(False).alias("truncated"), F.lit(True).alias("lines"), F.lit(0).alias("omitted"),
    )
    out = guard.inspect(turns, "conv_id", use="search_more", most=4000, segments_most=64)
    return out.select("conv_id", "decision", "severity", F.size("findings").alias("findings"), "reason_codes", F.col("diagnostics")[0].alias("diagnostics"))


_SIZES = "SELECT conv_id, turn, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes, length(coalesce(text, '')) AS len, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations"


@query(f"""SELECT conv_id, CAST(max(n) AS BIGINT) AS segment_count, CAST(sum(len) AS BIGINT) AS available_characters, CAST(least(900, sum(len)) AS BIGINT) AS scanned_characters,
    sum(len) > 900 AS over_budget FROM ({_SIZES}) GROUP BY conv_id""")
def scan_diagnostics(spark, read):
    """What a scan under a budget of 900 characters says of its coverage."""
    turns = read("conversations").select("conv_id", F.col("turn").alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"), F.lit("visible").alias("location"), F.lit(False).alias("truncated"), F.lit(False).alias("lines"), F.lit(0).alias("omitted"))
    d = guard.inspect(turns, "conv_id", most=900).select("conv_id", F.col("diagnostics")[0].alias("d"), F.array_contains("reason_codes", "CHARACTER_BUDGET_LIMIT").alias("over_budget"))
    return d.select("conv_id", "d.segment_count", "d.available_characters", "d.scanned_characters", "over_budget")


@query(None)
def guard_findings(spark, read):
    """Findings by category and severity."""
    docs = read("documents").select("doc_id", "text").withColumn("location", F.lit("visible"))
    found = guard.scan(docs, strict=True, carry=["doc_id"]).select("doc_id", F.explode("findings").alias("f"))
    return found.groupBy("f.category", "f.severity").agg(F.count("*").alias("findings"), F.countDistinct("doc_id").alias("documents"))


_W = "(?:^|[^A-Za-z0-9_])"
_E = "(?:$|[^A-Za-z0-9_])"
_SECRET, _VERB = f"{_W}(?:secret|password|token|credentials?){_E}", f"{_W}(?:reveal|show|print|output|send|post|upload){_E}"


@query(f"SELECT doc_id, regexp_matches(text, '(?i){_SECRET}') AS target, regexp_matches(text, '(?i){_SECRET}') AND regexp_matches(text, '(?i){_VERB}') AS candidate FROM documents")
def rule_prefilter_hits(spark, read):
    x = F.col("text")
    return read("documents").select("doc_id", x.rlike(f"(?i){_SECRET}").alias("target"), (x.rlike(f"(?i){_SECRET}") & x.rlike(f"(?i){_VERB}")).alias("candidate"))


@query(f"SELECT doc_id, regexp_matches(text, '(?i){_W}(?:example|demonstration|article|discussion|detect(?:ion)?|prevention){_E}') AS benign FROM documents")
def benign_context(spark, read):
    return read("documents").select("doc_id", F.col("text").rlike(f"(?i){_W}(?:example|demonstration|article|discussion|detect(?:ion)?|prevention){_E}").alias("benign"))


_CASES = f"SELECT l_orderkey, l_linenumber, {_sql_pick(policy.SEVERITIES, 'l_orderkey')} AS base, {_sql_pick(PLACES, 'l_partkey')} AS place, l_suppkey % 2 = 0 AS benign, l_linenumber % 2 = 0 AS strict FROM lineitem"
_PROMOTED = "CASE WHEN place IN ('hidden', 'comment', 'template', 'meta') THEN greatest(r, 3) WHEN place = 'attribute' THEN greatest(r, 2) ELSE r END"


def _cases(read):
    return read("lineitem").select(
        "l_orderkey", "l_linenumber", _pick(policy.SEVERITIES, F.col("l_orderkey")).alias("base"), _pick(PLACES, F.col("l_partkey")).alias("place"), (F.col("l_suppkey") % 2 == 0).alias("benign"), (F.col("l_linenumber") % 2 == 0).alias("strict")
    )


@query(
    f"""WITH c AS ({_CASES}), p AS (SELECT *, list_position(['info', 'low', 'medium', 'high', 'critical'], base) - 1 AS r FROM c), q AS (SELECT *, {_PROMOTED} AS s FROM p)
    SELECT l_orderkey, l_linenumber, ['info', 'low', 'medium', 'high', 'critical'][1 + CASE WHEN strict AND s = 2 AND NOT benign THEN 3 ELSE s END] AS severity FROM q"""
)
def severity_promotion(spark, read):
    s = policy.severity(F.col("base"), F.col("place"), F.col("benign"), F.col("strict"))
    return _cases(read).select("l_orderkey", "l_linenumber", s.alias("severity"))


@query(
    f"""SELECT place, benign, count(*) AS n, max(least(0.99, 0.72::DOUBLE + (CASE WHEN place IN ('hidden', 'comment', 'template', 'meta') THEN 0.2 WHEN place = 'attribute' THEN 0.1 ELSE 0.0 END)::DOUBLE - (CASE WHEN benign THEN 0.2 ELSE 0.0 END)::DOUBLE)) AS confidence
    FROM (SELECT place, place = 'visible' AND benign AS benign FROM ({_CASES})) GROUP BY 1, 2"""
)
def finding_confidence(spark, read):
    c = _cases(read).withColumn("benign", (F.col("place") == "visible") & F.col("benign"))
    return c.groupBy("place", "benign").agg(F.count("*").alias("n"), F.max(policy.confidence(F.col("place"), F.col("benign"))).alias("confidence"))


@query(
    f"""WITH c AS (SELECT o_orderkey, o_custkey % 5 AS s, o_orderstatus = 'F' AS h, o_orderkey % 7 = 0 AS t, {_sql_pick(USES, 'o_orderkey')} AS use FROM orders)
    SELECT o_orderkey, CASE WHEN t THEN CASE WHEN use IN ('search_more', 'call_readonly_tool') THEN 'deny' ELSE 'require_approval' END
    WHEN s >= 3 THEN CASE WHEN use IN ('search_more', 'call_readonly_tool') THEN 'deny' ELSE 'require_approval' END WHEN s = 2 AND h THEN 'require_approval' WHEN s >= 1 THEN 'allow_with_warning' ELSE 'allow' END AS decision FROM c"""
)
def policy_decision(spark, read):
    k = F.col("o_orderkey")
    d = policy.decision(k % 7 == 0, F.col("o_custkey") % 5, F.col("o_orderstatus") == "F", _pick(USES, k))
    return read("orders").select("o_orderkey", d.alias("decision"))


_RESULTS = f"SELECT l_orderkey, {_sql_pick(policy.DECISIONS, 'l_partkey')} AS decision, {_sql_pick(policy.ASSURANCES, 'l_suppkey')} AS assurance FROM lineitem"


def _results(read):
    return read("lineitem").select("l_orderkey", _pick(policy.DECISIONS, F.col("l_partkey")).alias("decision"), _pick(policy.ASSURANCES, F.col("l_suppkey")).alias("assurance"))


@query(
    f"""WITH d AS ({_RESULTS}) SELECT l_orderkey, ['allow', 'allow_with_warning', 'require_approval', 'deny'][max(list_position(['allow', 'allow_with_warning', 'require_approval', 'deny'], decision))] AS decision,
    ['unassessed', 'low', 'medium', 'high'][min(list_position(['unassessed', 'low', 'medium', 'high'], assurance))] AS assurance, count(*) AS inspections FROM d GROUP BY 1"""
)
def decision_merge(spark, read):
    return policy.merged(_results(read), "l_orderkey")


@query(
    f"""WITH d AS ({_RESULTS}), g AS (SELECT l_orderkey, CAST(count_if(decision LIKE 'allow%') AS BIGINT) AS visible, CAST(count_if(decision NOT LIKE 'allow%') AS BIGINT) AS withheld, max(list_position(['allow', 'allow_with_warning', 'require_approval', 'deny'], decision)) AS m FROM d GROUP BY 1)
    SELECT l_orderkey, visible, withheld, CASE WHEN withheld > 0 THEN CASE WHEN visible = 0 THEN 'deny' ELSE 'allow_with_warning' END ELSE ['allow', 'allow_with_warning', 'require_approval', 'deny'][m] END AS decision FROM g"""
)
def search_guard_withhold(spark, read):
    return policy.withheld(_results(read), "l_orderkey")


@query(
    """WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, event_id FROM s WHERE k <= 4 OR k > n - 3"""
)
def segment_head_tail(spark, read):
    return budget.head_tail_segments(read("events").select("user_id", "event_id"), "user_id", "event_id", 7)


_LEN = "SELECT user_id, event_id, CAST(event_id * 7919 % 400 AS BIGINT) AS len FROM events"


@query(
    f"""WITH s AS ({_LEN}), t AS (SELECT *, sum(len) OVER (PARTITION BY user_id) AS total FROM s),
    u AS (SELECT user_id, max(q) AS quota FROM (SELECT t.user_id, q FROM (SELECT DISTINCT user_id, total FROM t) d JOIN t ON t.user_id = d.user_id CROSS JOIN range(0, 401) r(q) WHERE d.total > 900 GROUP BY t.user_id, q HAVING sum(least(t.len, q)) <= 900) GROUP BY 1),
    b AS (SELECT t.*, CASE WHEN total <= 900 THEN len ELSE least(len, quota) END AS base FROM t LEFT JOIN u ON u.user_id = t.user_id),
    c AS (SELECT *, 900 - sum(base) OVER (PARTITION BY user_id) AS rest, sum(CASE WHEN base < len THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS turn FROM b)
    SELECT user_id, event_id, len, CAST(base + CASE WHEN total > 900 AND base < len AND turn <= rest THEN 1 ELSE 0 END AS BIGINT) AS allocation FROM c"""
)
def scan_budget_waterfill(spark, read):
    s = read("events").select("user_id", "event_id", (F.col("event_id") * 7919 % 400).cast("long").alias("len"))
    return budget.water_filled(s, "user_id", "event_id", "len", 900)
