"""Hosts in every form against the standard library, and what the outbound policy says of them."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from webgrain.functions import hosts, urls
from webgrain.operators import pages, policy
from webgrain.sources import captures, payloads, requests

PRIVATE = [
    "http://0x7f000001/", "http://0x7f.1/", "http://127.1/", "http://2130706433/", "http://0177.0.0.1/", "http://[::1]/", "http://[::ffff:127.0.0.1]/", "http://１２７.０.０.１/",
    "http://①②⑦.⓪.0.1/", "http://%31%32%37.0.0.1/", "http://192.168.0.1./", "http:\\\\10.0.0.1\\x", "http:/10.0.0.1", "http://[::7f00:1]:80/", "http://[2001:db8::1]/", "http://[2002:a00:1::]/", "http://0xFFFFFFFF/",
]
OTHERS = {
    "http://8.8.8.8/": None, "http://[2606:4700::1111]/x": None, "https://example.com:443/": None, "http://bücher.de/": None, "http://@example.com/": None, "http://example.com:0080/": None, "http://example.com./": None,
    "http://user@example.com/": "credentials", "https://example.com:80/": "port", "http://example.com:99999/": "invalid", "http://example.com:x/": "invalid", "http://256.1.1.1/": "invalid", "http://1.2.3.4.5/": "invalid",
    "http://09.1/": "invalid", "http://a.0x4/": "invalid", "http://4294967296/": "invalid", "http://[::1/": "invalid", "http://[1::2::3]/": "invalid", "http://[::1%25eth0]/": "invalid", "http://a b/": "invalid", "http:///": "invalid",
    " http://LOCALHOST./ ": "local_name", "http://x.local/": "local_name", "http://home.arpa/": "local_name", "ftp://x/": "scheme", "x": "scheme", "": "length", None: "length", "http://x/" + "y" * 2048: "length",
}


def test_policy(spark):
    want = OTHERS | dict.fromkeys(PRIVATE, "private_address")
    rows = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.e for r in rows.select("u", hosts.outbound_error(F.col("u")).alias("e")).collect()} == want
    every = spark.createDataFrame([(list(want),)], "u array<string>").select(F.filter("u", lambda u: hosts.outbound_error(u).isNotNull()).alias("u"))
    assert set(every.first().u) == {u for u, e in want.items() if e and u is not None} | {None}


def test_addresses(spark):
    rng = random.Random(2)
    made = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(300)] + [str(ipaddress.ip_network(n)[k]) for n in hosts.V4_RESERVED for k in (0, -1)]
    firsts = [0x2001, 0x2002, 0x3FFF, 0x2600, 0x1FFF, 0x4000, 0]
    for _ in range(600):
        v = rng.choice(firsts) << 112 | rng.choice([0, 2, 0x10, 0x1F, 0x20, 0x2F, 0x30, 0xDB8, 0xFFF, 0x1000, rng.getrandbits(16)]) << 96 | (rng.getrandbits(96) if rng.random() < 0.5 else rng.getrandbits(16) << 80 * rng.randrange(2))
        ip = ipaddress.IPv6Address(v)
        made += [rng.choice([ip.compressed, ip.exploded, ip.compressed.upper(), ip.compressed + "%eth0", f"{':'.join(ip.exploded.split(':')[:6])}:{v >> 24 & 255}.{v >> 16 & 255}.{v >> 8 & 255}.{v & 255}"])]
    made += ["", "x", "1.2.3", "01.2.3.4", "1.2.3.4.", ":::", "1:2", "::g", "2600::1::2", "2600:::1", "2600:1:2:3:4:5:6:7:8", "2600::1.2.3", "2600::01.2.3.4", None]

    def public(text):
        try:
            ip = ipaddress.ip_address((text or "").split("%")[0])
        except ValueError:
            return False
        if ip.version == 4:
            return not any(ip in ipaddress.ip_network(n) for n in hosts.V4_RESERVED)
        return ip in ipaddress.ip_network(hosts.V6_PUBLIC) and not any(ip in ipaddress.ip_network(n) for n in hosts.V6_RESERVED)

    rows = spark.createDataFrame([(a,) for a in made], "a string").select("a", hosts.public_address(F.col("a")).alias("p")).collect()
    assert [(r.a, r.p) for r in rows] == [(a, public(a)) for a in made] and 50 < sum(r.p for r in rows) < len(rows)
    both = spark.createDataFrame([(["2606:4700::1", "8.8.8.8"],), (["8.8.8.8", "fe80::1"],), (["x"],)], "a array<string>")
    assert [r[0] for r in both.select(captures.address_error(F.col("a"))).collect()] == [None, "private_address", "private_address"]


@pytest.mark.parametrize(
    ("raw", "normal"),
    [
        ("http://[::1]/a/", "http://[::1]/a"), ("http://[2606:4700:0:0:1:0:0:1]:8080/", "http://[2606:4700::1:0:0:1]:8080/"), ("http://0x7f.1/", "http://127.0.0.1/"), ("http://0300.1/x?utm_a=1", "http://192.0.0.1/x"),
        ("http:\\\\EXAMPLE.com\\a\\..\\b", "http://example.com/b"), ("http://ex%61mple.com:80/", "http://example.com/"), ("http://[::ffff:1.2.3.4]/", "http://[::ffff:102:304]/"), ("http://[::1/", None), ("http://1.2.3.400/", None), ("http://u:p@x/", None),
    ],
)
def test_normal_urls_keep_hosts(spark, raw, normal):
    assert urls.normalize(raw) == normal
    if normal:
        assert urls.normalize(normal) == normal


def test_both_ways_name_the_same_host(spark):
    names = ["0x7f.1", "1.2", "[::1]", "[1:0:0:2::3]", "bücher.de", "ＡＢ.com", "%41.b", "a..b", "1..2", "999", "0x", "x_y.z", "[1:2:3:4:5:6:7.8.9.10]", "[::1.2.3.4", "a%", "-1", "+1", "1_0"]
    got = {r.h: r.c for r in spark.createDataFrame([(h,) for h in names], "h string").select("h", hosts.canonical_host(F.col("h")).alias("c")).collect()}
    same = lambda h: f"[{ipaddress.IPv6Address(h[1:-1])}]" if h and h[0] == "[" else h or None
    assert {h: same(c) for h, c in got.items()} == {h: same(hosts.canonical(h)) for h in names}


def test_headers_that_differ_in_case_only_end_no_job(spark):
    schema = "k long, requested_url string, final_url string, status int, content_type string, headers map<string,string>, body binary, fetch_method string"
    u, kind = "https://example.com/a", "text/plain"
    heads = [{"ETag": "1", "etag": "2", "Content-Type": kind}, {"ETag": "1", "Content-Type": kind}, None, {"X": None}]
    rows = spark.createDataFrame([(k, u, u, 200, kind, h, b"x", "http") for k, h in enumerate(heads)], schema)
    got = {r.k: r for r in captures.decoded(captures.checked(rows)).collect()}
    assert [got[k].source_error for k in range(4)] == ["UPSTREAM_HTTP", None, "UPSTREAM_HTTP", "UPSTREAM_HTTP"]
    assert got[1].kept_headers == {"etag": "1", "content-type": kind} and got[0].kept_headers["etag"] in ("1", "2") and got[2].kept_headers is None


def test_dealing_runs_nothing(spark, tmp_path):
    spark.range(50).selectExpr("id AS k", "'x' AS t").coalesce(1).write.parquet(f"{tmp_path}/t")
    table, ran = spark.read.parquet(f"{tmp_path}/t"), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        ran.add(1)
        return t

    dealt = pages.spread(table, "k")
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert pages.spread(dealt, "k") is dealt
    heavy = table.groupBy("k").agg(F.max("t").alias("t")).select("k", counted("t").alias("t"))
    assert pages.spread(heavy, "k") is heavy and ran.value == 0


def test_many_findings_of_an_item(spark):
    kind = "array<struct<category string, rule string, severity string, location string, segment_hash string, n int>>"
    rows = [[("a", "r", "low", "visible", str(k % 7000), k) for k in range(20_000)], [], None]
    out = spark.createDataFrame([(r,) for r in rows], f"f {kind}").select(policy.distinct_findings(F.col("f")).alias("f")).collect()
    assert [x.n for x in out[0].f] == list(range(7000)) and out[1].f == [] and out[2].f is None


def test_requests_to_the_json_provider(spark):
    rows = [(" a ", None, None, None, None, None, None), ("b", 5, "off", "week", None, "DE", "at"), ("c", 5, "strict", None, " en-GB ", None, None)]
    got = spark.createDataFrame(rows, "query string, limit int, safe_search string, time_range string, locale string, language string, region string")
    assert [r[0] for r in got.select(requests.json_request(got)).collect()] == [
        {"q": "a", "count": "10", "safesearch": "moderate"}, {"q": "b", "count": "5", "safesearch": "off", "search_lang": "de", "country": "AT", "freshness": "pw"}, {"q": "c", "count": "5", "safesearch": "strict", "search_lang": "en-GB"},
    ]


def test_payloads_without_results(spark):
    rows = [(None,), ("{",), ("{}",), ('{"web": {}}',), ('{"web": {"results": []}}',), ('{"web": {"results": [{"title": "t", "url": "u"}]}}',)]
    assert [r[0] for r in spark.createDataFrame(rows, "b string").select(payloads.json_error(F.col("b"))).collect()] == ["PARSE_CHANGED"] * 4 + [None] * 2
