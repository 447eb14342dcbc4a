"""Text and URL queries."""

from pyspark.sql import functions as F

from ..functions import hosts
from ..functions import text as t
from ..functions import urls as u
from ..sources import captures
from .registry import query

_TRIM = r"regexp_replace(regexp_replace({}, '^[\s\x{{a0}}\x{{3000}}\x{{feff}}]+', ''), '[\s\x{{a0}}\x{{3000}}\x{{feff}}]+$', '')"
PLAIN_SQL = _TRIM.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\t\f\x0b ]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")


@query(f"SELECT doc_id, sha256(x) AS plain_sha256, length(x) AS n FROM (SELECT doc_id, {PLAIN_SQL} AS x FROM documents)")
def plain_text_normalize(spark, read):
    x = t.plain_text(F.col("text"))
    return read("documents").select("doc_id", F.sha2(x, 256).alias("plain_sha256"), F.length(x).cast("long").alias("n"))


INLINE_SQL = _TRIM.format(r"regexp_replace(regexp_replace(text, '[\t\f\x0b ]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g')")


@query(f"SELECT doc_id, sha256(x) AS inline_sha256, length(x) AS n FROM (SELECT doc_id, {INLINE_SQL} AS x FROM documents)")
def inline_normalize(spark, read):
    x = t.inline_text(F.col("text"))
    return read("documents").select("doc_id", F.sha2(x, 256).alias("inline_sha256"), F.length(x).cast("long").alias("n"))


@query(r"SELECT doc_id, CASE WHEN length(text) > 240 THEN regexp_replace(left(text, 240), '[\s\x{a0}]+$', '') END AS excerpt FROM documents")
def excerpt_truncate(spark, read):
    return read("documents").select("doc_id", t.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT doc_id, CASE WHEN length(text) <= 101 THEN text ELSE left(text, 51) || right(text, 50) END AS sample FROM documents")
def head_tail_sample(spark, read):
    return read("documents").select("doc_id", t.head_tail(F.col("text"), 101).alias("sample"))


@query("SELECT doc_id, left(sha256(text), 16) AS segment_hash FROM documents")
def segment_hash(spark, read):
    return read("documents").select("doc_id", t.segment_hash(F.col("text")).alias("segment_hash"))


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS utf8, CAST(length(text) AS BIGINT) AS points FROM documents")
def text_lengths(spark, read):
    x = F.col("text")
    return read("documents").select("doc_id", F.octet_length(x).cast("long").alias("utf8"), t.u16len(x).alias("points"))


@query("SELECT doc_id, regexp_matches(text, '[\\x00-\\x1f\\x7f]') AS has_control FROM documents")
def control_characters(spark, read):
    return read("documents").select("doc_id", t.has_control(F.col("text")).alias("has_control"))


@query(
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(left(text, 300), '&', '&amp;', 'g'), '<', '&lt;', 'g'), '>', '&gt;', 'g'), '([\\`*_\[\]#])', '\\\1', 'g')) AS escaped_sha256 FROM documents"""
)
def markdown_escape(spark, read):
    return read("documents").select("doc_id", F.sha2(t.markdown_escaped(F.substring("text", 1, 300)), 256).alias("escaped_sha256"))


@query(None)
def markdown_escape_whole(spark, read):
    """Every character of each text; markdown_escape and its SQL look at the first 300."""
    return read("documents").select("doc_id", F.sha2(t.markdown_escaped(F.col("text")), 256).alias("escaped_sha256"))


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(cell, '^[=+\\-@\\t\\r]') THEN '''' || cell ELSE cell END AS cell
    FROM (SELECT doc_id, (CASE doc_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END) || source AS cell FROM documents)"""
)
def formula_neutralize(spark, read):
    lead = F.element_at(F.array(F.lit("="), F.lit("-"), F.lit("@"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    return read("documents").select("doc_id", t.formula_safe(F.concat(lead, F.col("source"))).alias("cell"))


_KEY = r"(?:utm_[^=&#]*|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|ref_src)"
TRACK_SQL = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '#.*$', ''), "
    rf"'[?&]{_KEY}=[^&]*$', '', 'gi'), '([?&]){_KEY}=[^&]*&', '\1', 'gi'), '[?&]{_KEY}=[^&]*$', '', 'gi'), "
    r"'[?&]+$', ''), '^([a-z]+://[^/?]+/[^?]*?)/+(\?|$)', '\1\2')"
)


@query(f"SELECT page_id, {TRACK_SQL.format('url')} AS url FROM pages")
def url_tracking_strip(spark, read):
    return read("pages").select("page_id", u.tracking_free(F.col("url")).alias("url"))


@query(f"SELECT page_id, {TRACK_SQL.format('url')} AS url FROM pages")
def url_normalize(spark, read):
    """The whole normaliser; on these URLs' shapes it equals the expressions."""
    return read("pages").select("page_id", u.normalized_url("url").alias("url"))


@query(f"SELECT url, min(page_id) AS page_id, count(*) AS copies FROM (SELECT page_id, {TRACK_SQL.format('url')} AS url FROM pages) GROUP BY url")
def url_dedupe_first(spark, read):
    rows = read("pages").select("page_id", u.tracking_free(F.col("url")).alias("url"))
    return rows.groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


HOST_SQL = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1))"


@query(f"SELECT {HOST_SQL} AS host, count(*) AS pages, count(DISTINCT regexp_replace(url, '#.*$', '')) AS urls FROM pages GROUP BY 1")
def host_distribution(spark, read):
    rows = read("pages").select(u.host(F.col("url")).alias("host"), u.canonical(F.col("url")).alias("u"))
    return rows.groupBy("host").agg(F.count("*").alias("pages"), F.countDistinct("u").alias("urls"))


_IP = "(({k} * 7919) % 256) || '.' || (({k} * 104729) % 256) || '.' || (({k} * 31) % 256) || '.' || ({k} % 256)"
_NETS = [(n, 2 ** (32 - int(n.split("/")[1]))) for n in hosts.V4_RESERVED]


def _first(net: str) -> int:
    a, b, c, d = map(int, net.split("/")[0].split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


@query(
    f"""SELECT address, NOT ({' OR '.join(f'v BETWEEN {_first(n)} AND {_first(n) + size - 1}' for n, size in _NETS)}) AS public FROM
    (SELECT {_IP.format(k='o_orderkey')} AS address, (((o_orderkey * 7919) % 256 * 256 + (o_orderkey * 104729) % 256) * 256 + (o_orderkey * 31) % 256) * 256 + o_orderkey % 256 AS v FROM orders)"""
)
def public_ipv4_policy(spark, read):
    k = F.col("o_orderkey")
    address = F.concat_ws(".", *[(x % 256).cast("string") for x in (k * 7919, k * 104729, k * 31, k)])
    return read("orders").select(address.alias("address"), hosts.public_ipv4(address).alias("public"))


@query(
    f"""SELECT page_id, CASE WHEN length(url) > 2048 OR trim(url) = '' THEN 'length' WHEN NOT regexp_matches(url, '^https?:') THEN 'scheme'
    WHEN regexp_matches(url, '^[a-z]+://[^/?#]*@') THEN 'credentials' WHEN {HOST_SQL} = 'localhost' OR {HOST_SQL} LIKE '%.local' THEN 'local_name' END AS error FROM
    (SELECT page_id, CASE page_id % 5 WHEN 0 THEN replace(url, 'https://', 'ftp://') WHEN 1 THEN replace(url, '://', '://me:pw@') WHEN 2 THEN 'http://printer.local/' ELSE url END AS url FROM pages)"""
)
def outbound_policy(spark, read):
    k, url = F.col("page_id") % 5, F.col("url")
    url = F.when(k == 0, F.replace(url, F.lit("https://"), F.lit("ftp://"))).when(k == 1, F.replace(url, F.lit("://"), F.lit("://me:pw@"))).when(k == 2, "http://printer.local/").otherwise(url)
    return read("pages").select("page_id", hosts.outbound_error(url).alias("error"))


#: The address of a page's URL when it is rewritten: four octets, and eight groups of an IPv6 address.
_OCTETS = [f"(page_id * {m} + {a}) % 256" for m, a in ((7919, 10), (104729, 1), (31, 0), (17, 9))]
_GROUPS = ["CASE page_id % 5 WHEN 0 THEN 8193 WHEN 1 THEN 9734 WHEN 2 THEN 64512 WHEN 3 THEN 16383 ELSE 0 END", "CASE page_id % 3 WHEN 0 THEN 3512 WHEN 1 THEN 18176 ELSE page_id % 64 END", *["0"] * 4, "page_id % 65536", "(page_id * 31) % 65536"]
_PRIVATE4 = f"({' OR '.join(f'v BETWEEN {_first(n)} AND {_first(n) + size - 1}' for n, size in _NETS)})"
_PRIVATE6 = "NOT (g0 BETWEEN 8192 AND 16383) OR (g0 = 8193 AND (g1 = 0 OR (g1 = 2 AND g2 = 0) OR g1 BETWEEN 16 AND 47 OR g1 = 3512)) OR g0 = 8194 OR (g0 = 16383 AND g1 < 4096)"


@query(
    f"""SELECT page_id, CASE WHEN form < 6 THEN CASE WHEN {_PRIVATE4} THEN 'private_address' END WHEN form < 8 THEN CASE WHEN {_PRIVATE6} THEN 'private_address' END WHEN form = 8 THEN 'private_address' WHEN form = 9 THEN 'invalid' END AS error
    FROM (SELECT page_id, page_id % 11 AS form, {_GROUPS[0]} AS g0, {_GROUPS[1]} AS g1, 0 AS g2, ((({_OCTETS[0]}) * 256 + ({_OCTETS[1]})) * 256 + ({_OCTETS[2]})) * 256 + ({_OCTETS[3]}) AS v FROM pages)"""
)
def outbound_hosts(spark, read):
    """Each page's URL with its host rewritten to an address in one of its forms: what the policy says of it."""
    o, g = [F.expr(x) for x in _OCTETS], [F.expr(x).cast("bigint") for x in _GROUPS]
    v = ((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3]
    dotted, six = F.concat_ws(".", *[x.cast("string") for x in o]), [F.lower(F.hex(x)) for x in g]
    octal = F.concat_ws(".", *[F.concat(F.lit("0"), F.conv(x, 10, 8)) for x in o])
    wide = F.translate(dotted, "0123456789", "".join(chr(0xFF10 + k) for k in range(10)))
    forms = [
        dotted, F.concat(F.lit("0x"), F.hex(v)), octal, F.concat_ws(".", o[0].cast("string"), F.concat(F.lit("0X"), F.hex(v % (1 << 24)))), wide, v.cast("string"),
        F.concat(F.lit("["), F.concat_ws(":", *six), F.lit("]")), F.concat(F.lit("["), six[0], F.lit(":"), six[1], F.lit("::"), six[6], F.lit(":"), six[7], F.lit("]")),
        F.concat(F.lit("[::ffff:"), dotted, F.lit("]")), F.concat(dotted, F.lit(".1")),
    ]
    host = F.get(F.array(*forms), (F.col("page_id") % 11).cast("int"))
    url = F.when(host.isNotNull(), F.concat(F.lit("http://"), host, F.regexp_replace("url", "^[a-z]+://[^/?#]*", ""))).otherwise(F.col("url"))
    return read("pages").select("page_id", hosts.outbound_error(url).alias("error"))


@query(
    f"""SELECT page_id, CASE WHEN page_id % 4 <> 1 AND {_PRIVATE4} THEN 'private_address' WHEN page_id % 4 <> 0 AND ({_PRIVATE6}) THEN 'private_address' END AS error
    FROM (SELECT page_id, {_GROUPS[0]} AS g0, {_GROUPS[1]} AS g1, 0 AS g2, ((({_OCTETS[0]}) * 256 + ({_OCTETS[1]})) * 256 + ({_OCTETS[2]})) * 256 + ({_OCTETS[3]}) AS v FROM pages)"""
)
def address_families(spark, read):
    """Lists of addresses of one or both families, each of which must be public."""
    four, six = F.concat_ws(".", *[F.expr(x).cast("string") for x in _OCTETS]), F.concat_ws(":", *[F.hex(F.expr(x).cast("bigint")) for x in _GROUPS])
    k = F.col("page_id") % 4
    return read("pages").select("page_id", captures.address_error(F.when(k == 0, F.array(four)).when(k == 1, F.array(six)).otherwise(F.array(four, six))).alias("error"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '<!--(?:[^-]|-[^-])*-->')) AS comments, regexp_extract(html, '<!--((?:[^-]|-[^-])*)-->', 1) AS first FROM pages")
def html_comments(spark, read):
    found = F.regexp_extract_all("html", F.lit("(?s)<!--(.*?)-->"), F.lit(1))
    return read("pages").select("page_id", F.size(found).cast("long").alias("comments"), F.coalesce(F.get(found, 0), F.lit("")).alias("first"))


_STYLES = ("display: none", "color:red; visibility : hidden !important", "opacity:0.5", "font-size:0px;x:y", "text-indent:-9999px", "position:absolute; left:-5000px", "clip-path: inset(50%)", "margin:0")


@query(
    "SELECT part, style, regexp_matches(style, '(?:^|;)\\s*(?:display\\s*:\\s*none|visibility\\s*:\\s*hidden|font-size\\s*:\\s*0(?:px)?|text-indent\\s*:\\s*-\\d{3,}(?:px)?)(?:\\s*!important)?\\s*(?:;|$)', 'i') OR (regexp_matches(style, 'position\\s*:\\s*absolute', 'i') AND regexp_matches(style, 'left\\s*:\\s*-\\d{3,}px', 'i')) OR regexp_matches(style, 'clip-path\\s*:\\s*inset\\s*\\(\\s*50%', 'i') AS hidden FROM "
    f"(SELECT p_partkey AS part, list_value({', '.join(repr(s) for s in _STYLES)})[1 + p_partkey % 8] AS style FROM part)"
)
def css_hidden_inline(spark, read):
    style = F.element_at(F.array(*map(F.lit, _STYLES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return read("part").select(F.col("p_partkey").alias("part"), style.alias("style"), t.style_hidden(style).alias("hidden"))


@query(
    """SELECT doc_id, CAST(least(c, 20000) + least(p, 20) * 120 - floor((CASE WHEN c = 0 THEN 1.0 ELSE least(1.0, l / c) END) * least(c, 10000) + 0.5) AS BIGINT) AS score
    FROM (SELECT doc_id, n_chars AS c, doc_id % 37 AS p, CAST(n_chars * (doc_id % 13) / 10.0 AS DOUBLE) AS l FROM documents)"""
)
def quality_score(spark, read):
    c, p, link = F.col("n_chars"), F.col("doc_id") % 37, F.col("n_chars") * (F.col("doc_id") % 13) / 10.0
    return read("documents").select("doc_id", t.quality_score(c, p, link).alias("score"))
