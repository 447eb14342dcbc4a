"""Hosts of http(s) URLs as browsers read them, and which addresses are public: Columns, all in the JVM.

An IPv4 host may be written with one to four numbers in decimal, hex or octal, an IPv6 host in brackets with `::` and
an IPv4 tail, any host with percent escapes, full-width characters or another script. All become one form first, so
that a policy sees the address that a client would connect to.
"""

from __future__ import annotations

import ipaddress
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Networks that are not public. IPv6 is public within 2000::/3 only.
V4_RESERVED = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.31.196.0/24", "192.52.193.0/24", "192.88.99.0/24", "192.168.0.0/16", "192.175.48.0/24", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "224.0.0.0/3",
)
V6_RESERVED = ("2001::/32", "2001:2::/48", "2001:10::/28", "2001:20::/28", "2001:db8::/32", "2002::/16", "3fff::/20")
V6_PUBLIC = "2000::/3"
PORTS = {"http": 80, "https": 443}

_V4 = "(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_DOTTED = f"^{_V4}(?:\\.{_V4}){{3}}$"
_FORBIDDEN = "[\\x00-\\x20\"#%/:<>?@\\[\\\\\\]^`{|}\\x7f]"
_UNSAFE = re.compile("[\x00-\x20\"#%/:<>?@\\[\\\\\\]^`{|}\x7f]")


def once(value: Column, use) -> Column:
    """use(value), with value worked out once: a list of one element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _folded(numbers: Column, base: int) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda s, x: s * base + x)


def _outside(value: Column) -> Column:
    nets = map(ipaddress.ip_network, V4_RESERVED)
    return reduce(lambda a, b: a & b, [~value.between(int(n.network_address), int(n.broadcast_address)) for n in nets])


def ipv4_number(dotted: Column) -> Column:
    """A plain dotted quad as a number; null for anything else."""
    return F.when(dotted.rlike(_DOTTED), _folded(F.transform(F.split(dotted, "\\."), lambda x: x.try_cast("bigint")), 256))


def public_ipv4(address: Column) -> Column:
    """Whether a dotted quad is a public address; anything else is false."""
    return F.coalesce(once(ipv4_number(address), _outside), F.lit(False))


def ipv6_groups(address: Column) -> Column:
    """The eight 16-bit groups of an IPv6 address without brackets and zone; null if it is none."""
    tail = F.regexp_extract(address, "(?:^|:)([0-9.]+\\.[0-9.]*)$", 1)

    def groups(p: Column) -> Column:
        number = ipv4_number(p["tail"])
        pair = F.concat(F.lower(F.hex(F.floor(number / 65536).cast("bigint"))), F.lit(":"), F.lower(F.hex(number % 65536)))
        text = F.when(p["tail"] == "", p["address"]).otherwise(F.concat(F.left(p["address"], F.length(p["address"]) - F.length(p["tail"])), pair))
        return once(F.split(text, "::", -1), halves)

    def halves(parts: Column) -> Column:
        listed = lambda x: F.when(F.coalesce(x, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(x, ":", -1))
        gap = F.size(parts) == 2
        return once(F.struct(listed(F.get(parts, F.lit(0))).alias("a"), listed(F.get(parts, F.lit(1))).alias("b"), gap.alias("gap"), F.size(parts).alias("n")), filled)

    def filled(p: Column) -> Column:
        n = F.size(p["a"]) + F.size(p["b"])
        fits = (p["n"] <= 2) & F.when(p["gap"], n <= 7).otherwise(n == 8) & F.forall(F.concat(p["a"], p["b"]), lambda x: x.rlike("^[0-9A-Fa-f]{1,4}$"))
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0)))
        return F.when(fits, F.transform(F.concat(p["a"], zeros, p["b"]), lambda x: F.conv(x, 16, 10).cast("bigint")))

    return once(F.struct(address.alias("address"), tail.alias("tail")), groups)


def ipv6_longs(groups: Column) -> Column:
    """Eight groups as the two 64-bit halves of the address."""
    half = lambda a: F.aggregate(F.slice(groups, a, 4), F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 16).bitwiseOR(x))
    return F.when(groups.isNotNull(), F.struct(half(1).alias("high"), half(5).alias("low")))


def in_network(longs: Column, network: str) -> Column:
    """Whether an address (high, low) lies in an IPv6 network with a prefix of 64 bits at most."""
    net = ipaddress.ip_network(network)
    return F.shiftrightunsigned(longs["high"], 64 - net.prefixlen) == F.lit(int(net.network_address) >> 128 - net.prefixlen)


def public_ipv6(address: Column) -> Column:
    """Whether an IPv6 address, a zone included, is public; anything else is false."""
    public = lambda v: in_network(v, V6_PUBLIC) & ~reduce(lambda a, b: a | b, [in_network(v, n) for n in V6_RESERVED])
    return F.coalesce(once(ipv6_longs(once(ipv6_groups(F.regexp_replace(address, "%.+$", "")), lambda g: g)), public), F.lit(False))


def public_address(address: Column) -> Column:
    """Whether an address of either family is public; anything else is false."""
    return F.when(address.contains(":"), public_ipv6(address)).otherwise(public_ipv4(address))


def _number(part: Column) -> Column:
    """One number of an IPv4 host: hex, octal or decimal; null if it is none, 2^40 if it is too large for any place."""
    large = F.lit(1 << 40)
    hexed, octal = F.regexp_extract(part, "^0[xX]0*([0-9A-Fa-f]*)$", 1), F.regexp_extract(part, "^0+([0-7]*)$", 1)
    plain = F.regexp_extract(part, "^([1-9][0-9]*|0)$", 1)
    value = lambda digits, base, most: F.when(F.length(digits) > most, large).when(digits == "", F.lit(0)).otherwise(F.conv(digits, base, 10).cast("bigint"))
    return F.when(part.rlike("^0[xX][0-9A-Fa-f]*$"), value(hexed, 16, 9)).when(part.rlike("^0[0-7]+$"), value(octal, 8, 13)).when(plain != "", value(plain, 10, 12))


def _dotted(number: Column) -> Column:
    return F.concat_ws(".", *[F.shiftrightunsigned(number, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)])


def _ipv4(name: Column) -> Column:
    """The dotted quad of a host whose last label is a number; an empty string if it is no address."""

    def read(labels: Column) -> Column:
        labels = F.when((F.size(labels) > 1) & (F.element_at(labels, -1) == ""), F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(1)))).otherwise(labels)
        return once(F.transform(labels, _number), joined)

    def joined(numbers: Column) -> Column:
        n, last = F.size(numbers), F.element_at(numbers, -1)
        first = F.slice(numbers, 1, F.greatest(n - 1, F.lit(0)))
        fits = (n <= 4) & F.forall(numbers, lambda x: x.isNotNull()) & F.forall(first, lambda x: x <= 255) & (last < F.pow(F.lit(256), 5 - n).cast("bigint"))
        value = reduce(lambda a, b: a + b, [F.coalesce(F.get(first, F.lit(i)), F.lit(0)) * (1 << 24 - 8 * i) for i in range(3)], last)
        return F.when(F.coalesce(fits, F.lit(False)), _dotted(value)).otherwise("")

    return once(F.split(name, "\\.", -1), read)


def _ends_in_number(name: Column) -> Column:
    return name.rlike("(?:^|\\.)(?:[0-9]+|0[xX][0-9A-Fa-f]*)\\.?$")


def _domain(raw: Column) -> Column:
    """A host without brackets in ASCII: escapes and other scripts undone; null if that cannot be."""
    plain = F.when(raw.contains("%"), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))).otherwise(raw)
    ascii_ = lambda x: F.when(x.rlike("[^\\x00-\\x7f]"), F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), x)).otherwise(x)
    return F.lower(once(plain, ascii_))


def canonical_host(raw: Column) -> Column:
    """A URL's host in one form: dotted quad, groups in brackets, or an ASCII name; an empty string if it is none."""
    inside = F.regexp_extract(raw, "^\\[(.*)\\]$", 1)
    six = lambda g: F.when(g.isNull(), "").otherwise(F.concat(F.lit("["), F.array_join(F.transform(g, lambda x: F.lower(F.hex(x))), ":"), F.lit("]")))
    four = lambda d: F.when(d.isNull() | (d == "") | d.rlike(_FORBIDDEN), "").when(_ends_in_number(d), _ipv4(d)).otherwise(d)
    return F.when(raw.startswith("["), once(ipv6_groups(inside), six)).otherwise(once(_domain(raw), four))


def authority(url: Column) -> Column:
    """scheme, userinfo, raw host and port of a URL, as browsers cut it: any slashes, blanks around it ignored."""
    text = F.regexp_replace(F.regexp_replace(url, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", ""), "[\\t\\r\\n]", "")
    cut = lambda t: F.struct(F.lower(F.regexp_extract(t, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).alias("scheme"), F.regexp_extract(t, "^[A-Za-z][A-Za-z0-9+.-]*:[/\\\\]*([^/\\\\?#]*)", 1).alias("whole"))

    def parts(p: Column) -> Column:
        at = "^(?:.*@)?(\\[[^\\]]*\\]|[^:\\[\\]]*)(?::(.*))?$"
        return F.struct(
            p["scheme"].alias("scheme"), F.regexp_extract(p["whole"], "^(.*)@", 1).alias("user"), F.regexp_extract(p["whole"], at, 1).alias("host"), F.regexp_extract(p["whole"], at, 2).alias("port"),
            p["whole"].rlike(at).alias("whole"),
        )

    return once(once(text, cut), parts)


def outbound_error(url: Column) -> Column:
    """Why a URL must not be fetched, before its addresses are known; null if nothing speaks against it."""

    def error(p: Column) -> Column:
        return once(F.struct(p["url"].alias("url"), p["parts"].alias("parts"), F.when(p["parts"]["whole"], canonical_host(p["parts"]["host"])).otherwise("").alias("name")), named)

    def named(p: Column) -> Column:
        parts, name = p["parts"], F.regexp_replace(p["name"], "\\.$", "")
        local = name.isin("localhost", "home.arpa") | name.endswith(".localhost") | name.endswith(".local") | name.endswith(".home.arpa")
        port = F.regexp_replace(parts["port"], "^0+(?=[0-9])", "")
        address = F.when(name.startswith("["), ~public_ipv6(F.regexp_replace(name, "[\\[\\]]", ""))).otherwise(name.rlike(_DOTTED) & ~public_ipv4(name))
        return (
            F.when(p["url"].isNull() | (F.trim(p["url"]) == "") | (F.length(p["url"]) > 2048), "length")
            .when(~parts["scheme"].isin(*PORTS), "scheme")
            .when(~parts["user"].isin("", ":"), "credentials")
            .when(~port.rlike("^[0-9]{0,5}$") | (F.coalesce(port.try_cast("int"), F.lit(0)) > 65535), "invalid")
            .when((port != "") & (port != F.when(parts["scheme"] == "https", "443").otherwise("80")), "port")
            .when(name == "", "invalid")
            .when(local, "local_name")
            .when(address, "private_address")
        )

    return once(F.struct(url.alias("url"), authority(url).alias("parts")), error)


def _v4(name: str) -> str | None:
    """The dotted quad of an IPv4 host in any form, or None."""
    labels = name.split(".")
    if len(labels) > 1 and not labels[-1]:
        labels.pop()
    try:
        numbers = [int(x[2:] or "0", 16) if x[:2] in ("0x", "0X") else int(x, 8) if len(x) > 1 and x[0] == "0" else int(x) for x in labels if x.isascii() and "_" not in x and x[:1] not in "+- "]
    except ValueError:
        return None
    if len(numbers) < len(labels) or len(numbers) > 4 or any(x > 255 for x in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = sum(x << 24 - 8 * i for i, x in enumerate(numbers[:-1])) + numbers[-1]
    return str(ipaddress.IPv4Address(value))


def _v6(text: str) -> str:
    """An IPv6 address with its longest run of zeros as `::`, all groups in hex."""
    value = int(ipaddress.IPv6Address(text))
    groups = [value >> 112 - 16 * k & 0xFFFF for k in range(8)]
    runs = [(b - a, -a) for a in range(8) for b in range(a + 2, 9) if not any(groups[a:b])]
    said = [f"{g:x}" for g in groups]
    if not runs:
        return ":".join(said)
    n, at = max(runs)
    return ":".join(said[:-at]) + "::" + ":".join(said[n - at :])


def canonical(raw: str) -> str | None:
    """canonical_host for one host, IPv6 in brackets and shortened; None if it is no host."""
    if raw.startswith("["):
        try:
            return f"[{_v6(raw[1:-1])}]" if raw.endswith("]") and "%" not in raw else None
        except ValueError:
            return None
    try:
        name = unquote(raw, errors="strict")
        name = (name if name.isascii() else name.encode("idna").decode()).lower()
    except (ValueError, UnicodeError):
        return None
    if not name or _UNSAFE.search(name):
        return None
    return _v4(name) if re.search(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$", name) else name
