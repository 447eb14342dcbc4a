"""Search requests: validation, provider parameters, keys; and what provider pages say before they are parsed."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Parameters of the providers.
SAFE_SEARCH = {"strict": "1", "moderate": "-1", "off": "-2"}
TIME_RANGE = {"day": "d", "week": "w", "month": "m", "year": "y"}
FRESHNESS = {"day": "pd", "week": "pw", "month": "pm", "year": "py"}
DEFAULT_REGIONS = {
    "bg": "BG", "cs": "CZ", "da": "DK", "de": "DE", "el": "GR", "en": "US", "es": "ES", "et": "EE", "fi": "FI", "fr": "FR", "he": "IL", "hr": "HR",
    "hu": "HU", "id": "ID", "it": "IT", "ja": "JP", "ko": "KR", "lt": "LT", "lv": "LV", "ms": "MY", "nl": "NL", "no": "NO", "pl": "PL", "pt": "PT",
    "ro": "RO", "ru": "RU", "sk": "SK", "sl": "SI", "sv": "SE", "th": "TH", "tl": "PH", "tr": "TR", "uk": "UA", "vi": "VN", "zh": "CN",
}
#: Codes by region and language; a region alone has the first of its codes.
REGIONS = {
    "AR:es": "ar-es", "AU:en": "au-en", "AT:de": "at-de", "BE:fr": "be-fr", "BE:nl": "be-nl", "BR:pt": "br-pt", "BG:bg": "bg-bg", "CA:en": "ca-en",
    "CA:fr": "ca-fr", "CL:es": "cl-es", "CN:zh": "cn-zh", "CO:es": "co-es", "HR:hr": "hr-hr", "CZ:cs": "cz-cs", "DK:da": "dk-da", "EE:et": "ee-et",
    "FI:fi": "fi-fi", "FR:fr": "fr-fr", "DE:de": "de-de", "GR:el": "gr-el", "HK:zh": "hk-tzh", "HU:hu": "hu-hu", "IN:en": "in-en", "ID:id": "id-id",
    "ID:en": "id-en", "IE:en": "ie-en", "IL:he": "il-he", "IT:it": "it-it", "JP:ja": "jp-jp", "KR:ko": "kr-kr", "LV:lv": "lv-lv", "LT:lt": "lt-lt",
    "MY:ms": "my-ms", "MY:en": "my-en", "MX:es": "mx-es", "NL:nl": "nl-nl", "NZ:en": "nz-en", "NO:no": "no-no", "PE:es": "pe-es", "PH:en": "ph-en",
    "PH:tl": "ph-tl", "PL:pl": "pl-pl", "PT:pt": "pt-pt", "RO:ro": "ro-ro", "RU:ru": "ru-ru", "SG:en": "sg-en", "SK:sk": "sk-sk", "SI:sl": "sl-sl",
    "ZA:en": "za-en", "ES:es": "es-es", "SE:sv": "se-sv", "CH:de": "ch-de", "CH:fr": "ch-fr", "CH:it": "ch-it", "TW:zh": "tw-tzh", "TH:th": "th-th",
    "TR:tr": "tr-tr", "UA:uk": "ua-uk", "GB:en": "uk-en", "US:en": "us-en", "US:es": "ue-es", "VE:es": "ve-es", "VN:vi": "vn-vi",
}
CHALLENGES = (
    r"DDG\.(?:deep\.)?anomalyDetectionBlock\s*\(",
    r"(?:id|class)=[\"'][^\"']*\banomaly-modal\b",
    r"(?:id|class)=[\"'][^\"']*\bbot_challenge\b",
    r"(?:id|class)=[\"'][^\"']*\bchallenge-form\b",
    r"Unfortunately,\s+bots\s+use\s+DuckDuckGo\s+too",
    r"Please\s+complete\s+the\s+following\s+challenge",
)
RENDER_MODES = ("never", "auto", "always")
REQUESTED_USES = ("summarize", "answer_with_citation", "extract_facts", "search_more", "call_readonly_tool")


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key)


def region_code(language: Column, region: Column, locale: Column) -> Column:
    """A locale as it is; else the code of region and language; a language alone has its default region, a region alone its first code."""
    language, region = F.lower(language), F.upper(region)
    first: dict[str, str] = {}
    for k, code in REGIONS.items():
        first.setdefault(k[:2], code)
    of_both = _looked_up(REGIONS, F.concat_ws(":", F.coalesce(region, _looked_up(DEFAULT_REGIONS, language)), language))
    return F.coalesce(F.trim(locale), F.when(language.isNull(), _looked_up(first, region)).otherwise(of_both))


def region_error(language: Column, region: Column, locale: Column) -> Column:
    """INVALID_INPUT for a language or region that the provider has no code for; null if none is asked for, or it has one."""
    asked = language.isNotNull() | region.isNotNull()
    return F.when(locale.isNull() & asked & region_code(language, region, locale).isNull(), "INVALID_INPUT")


def safe_search(value: Column) -> Column:
    return _looked_up(SAFE_SEARCH, F.coalesce(value, F.lit("moderate")))


def time_range(value: Column) -> Column:
    return _looked_up(TIME_RANGE, value)


def challenged(body: Column) -> Column:
    return body.rlike("(?i)" + "|".join(f"(?:{p})" for p in CHALLENGES))


def search_error(df: DataFrame) -> Column:
    """Why a search request (query, limit, safe_search, time_range, locale, language, region) is invalid; null if valid."""
    size = text.u16len(text.trimmed(F.col("query")))
    both = F.col("locale").isNotNull() & (F.col("language").isNotNull() | F.col("region").isNotNull())
    return (
        F.when(F.col("query").isNull() | (size < 1) | (size > 400), "query")
        .when(~F.coalesce("limit", F.lit(10)).between(1, 20), "limit")
        .when(F.col("safe_search").isNotNull() & ~F.col("safe_search").isin(*SAFE_SEARCH), "safe_search")
        .when(F.col("time_range").isNotNull() & ~F.col("time_range").isin(*TIME_RANGE), "time_range")
        .when((F.trim("locale") == "") | (F.length("locale") > 100) | text.has_control(F.col("locale")), "locale")
        .when(~F.col("language").rlike("^[A-Za-z]{2}$"), "language")
        .when(~F.col("region").rlike("^[A-Za-z]{2}$"), "region")
        .when(both, "locale_with_language_or_region")
    )


def too_many_words(query: Column, most: int = 50) -> Column:
    """Whether a query has more words than the JSON provider takes."""
    return F.size(F.split(text.trimmed(query), f"[{text.BLANKS}]+")) > most


def json_request(df: DataFrame) -> Column:
    """What the JSON provider is asked for a valid search request: a map of its parameters, only those that are given.

    A language outweighs a locale, which is passed on as it is; defaults are those of a request.
    """
    pairs = {
        "q": text.trimmed(F.col("query")), "count": F.coalesce("limit", F.lit(10)).cast("string"), "safesearch": F.coalesce("safe_search", F.lit("moderate")),
        "search_lang": F.coalesce(F.lower("language"), F.when(F.col("locale") != "", F.trim("locale"))), "country": F.upper("region"), "freshness": freshness(F.col("time_range")),
    }
    given = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()]), lambda e: e["value"].isNotNull())
    return F.map_from_entries(given)


def freshness(span: Column) -> Column:
    return _looked_up(FRESHNESS, span)


def read_error(df: DataFrame) -> Column:
    """Why a read request (url, max_characters, render, requested_use, and of its source provider, query, rank, snippet) is
    invalid; null if valid. A source is given if one of its columns is not null."""
    url, size = text.trimmed(F.col("url")), lambda c: text.u16len(F.col(c))
    source = F.col("provider").isNotNull() | F.col("query").isNotNull() | F.col("rank").isNotNull() | F.col("snippet").isNotNull()
    blank = lambda c: F.coalesce(text.trimmed(F.col(c)) == "", F.lit(True))
    bad = blank("provider") | (size("provider") > 100) | (text.external_text(F.col("provider")) == "") | blank("query") | (size("query") > 400)
    return (
        F.when(url.isNull() | ~text.u16len(url).between(1, 2048), "url")
        .when(~F.col("max_characters").between(200, 100_000), "max_characters")
        .when(~F.col("render").isin(*RENDER_MODES), "render")
        .when(~F.col("requested_use").isin(*REQUESTED_USES), "requested_use")
        .when(source & F.coalesce(bad, F.lit(True)), "source")
        .when(source & ~F.coalesce(F.col("rank").between(1, 1_000_000), F.lit(False)), "rank")
        .when(size("snippet") > 10_000, "snippet")
    )


def search_key(provider: str) -> Column:
    """One key for equal requests, defaults filled in."""
    blank = F.lit("")
    parts = [F.lit(provider), text.trimmed(F.col("query")), F.coalesce("limit", F.lit(10)).cast("string"), F.coalesce("safe_search", F.lit("moderate"))]
    return F.to_json(F.array(*parts, *[F.coalesce(c, blank) for c in ("locale", "language", "region", "time_range")]))


def read_key() -> Column:
    """One key for equal read requests; a request's source is part of it."""
    blank = F.lit("")
    return F.to_json(F.array(text.trimmed(F.col("url")), *[F.coalesce(F.col(c).cast("string"), blank) for c in ("max_characters", "render", "requested_use", "provider", "query", "rank", "snippet")]))


def encyclopedia_page(url: Column) -> Column:
    """Edition, title and revision of an encyclopedia URL; null if it is none."""
    edition = F.regexp_extract(url, r"^https://([a-z]{2,3}(?:-[a-z0-9]{2,8})*)\.wikipedia\.org/", 1)
    path = F.regexp_extract(url, r"^https://[^/]+/wiki/([^?#]+)", 1)
    query = F.regexp_extract(url, r"^https://[^/]+/w/index\.php\?(?:[^#]*&)?title=([^&#]+)", 1)
    title = F.when(path != "", F.regexp_replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "_", " ")).otherwise(F.try_url_decode(query))
    revision = F.regexp_extract(url, r"[?&]oldid=([1-9][0-9]*)(?:[&#]|$)", 1).try_cast("long")
    return F.when((edition != "") & (title != ""), F.struct(edition.alias("edition"), title.alias("title"), revision.alias("revision")))
