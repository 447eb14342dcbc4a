"""Providers, retrievers and parsers of result pages as table functions of SQL.

`SELECT p.id, h.* FROM payloads p, LATERAL block_hits(p.body, 20) h` reads result pages, `SELECT * FROM my_search(
TABLE(requests) PARTITION BY (host), 'id')` asks a user's own provider. What a function raises, misses or gets wrong is an
error in that row's result, not the end of the query. The partitions of the table argument are dealt by Spark.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.errors import PySparkValueError
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import urls
from ..functions.plain import units
from ..sources import provider_pages
from .hooks import DEADLINE, Late, within

# Limits of a provider and of what it returns, and the errors that a call may end with.
MAX_NAME, MAX_HITS, MAX_TITLE, MAX_SNIPPET, MAX_URL, MAX_RANK = 100, 1000, 1000, 10_000, 2048, 1_000_000
CODES = (
    "INVALID_INPUT", "CONFIG_MISSING", "UNSAFE_URL", "TIMEOUT", "RATE_LIMITED", "BOT_CHALLENGE", "UPSTREAM_HTTP", "PARSE_CHANGED", "RESPONSE_TOO_LARGE",
    "UNSUPPORTED_CONTENT_TYPE", "UNSUPPORTED_CONTENT_ENCODING", "CONTENT_INSUFFICIENT", "GUARD_FAILED", "GUARD_DENIED", "UNKNOWN",
)
PARSERS = {"block_hits": provider_pages.html_results, "lite_hits": provider_pages.lite_results, "script_hits": provider_pages.script_results}
#: Equal requests that one partition asks once; older answers are forgotten beyond it.
ANSWERS = 1000

_HIT = [T.StructField("rank", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("title", "url", "snippet")]]
_ERROR = T.StructField("error", T.StringType())
_RESPONSE = [
    T.StructField("final_url", T.StringType()), T.StructField("status", T.IntegerType()), T.StructField("content_type", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("body", T.BinaryType()), T.StructField("fetch_method", T.StringType()),
]


class Failed(Exception):
    """What a provider or retriever raises to name its error, one of CODES."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def provider_error(name: object, search: object) -> str | None:
    """INVALID_INPUT for a name that is blank, too long or has control characters, or for what cannot be called."""
    good = isinstance(name, str) and name.strip() and units(name) <= MAX_NAME and not any(c <= "\x1f" or c == "\x7f" for c in name) and callable(search)
    return None if good else "INVALID_INPUT"


def _fits(value: object, most: int, least: int = 0) -> bool:
    return isinstance(value, str) and least <= units(value) <= most


def checked_hits(found: object) -> list[tuple[int, str, str, str]]:
    """rank, title, URL and snippet of what a provider returned, in its order and each URL once. Failed, PARSE_CHANGED, for more
    than 1,000 results or if one is invalid: then none of them counts."""
    if not isinstance(found, (list, tuple)) or len(found) > MAX_HITS:
        raise Failed("PARSE_CHANGED")
    out: dict[str, tuple[int, str, str, str]] = {}
    for item in found:
        hit = item if isinstance(item, dict) else {}
        title, snippet, rank, shown = hit.get("title"), hit.get("snippet"), hit.get("rank"), hit.get("display_url")
        url = urls.normalize(hit["url"]) if isinstance(hit.get("url"), str) else None
        whole = isinstance(rank, int) and not isinstance(rank, bool) and 1 <= rank <= MAX_RANK
        if not (_fits(title, MAX_TITLE, 1) and title.strip() and _fits(snippet, MAX_SNIPPET) and whole and _fits(url, MAX_URL, 1) and (shown is None or _fits(shown, MAX_URL))):
            raise Failed("PARSE_CHANGED")
        out.setdefault(url, (rank, title, url, snippet))
    return list(out.values())


def response(found: object) -> tuple:
    """A retriever's answer as a row, for captures.checked; Failed, UPSTREAM_HTTP, for one whose fields have other types."""
    got = found if isinstance(found, dict) else {}
    kinds = {"final_url": str, "status": int, "content_type": str, "headers": dict, "body": (bytes, bytearray), "fetch_method": str}
    if not all(isinstance(got.get(c), kind) for c, kind in kinds.items()) or not all(isinstance(x, str) for pair in got["headers"].items() for x in pair):
        raise Failed("UPSTREAM_HTTP")
    return tuple(bytes(got[c]) if c == "body" else got[c] for c in kinds)


def called(call: Callable, seconds: float, *args) -> tuple[object, str | None]:
    """(result, error) of a user's function within its seconds."""
    try:
        return within(seconds, call, *args), None
    except Late:
        return None, "TIMEOUT"
    except Exception as error:  # the contract: whatever a function does concerns its row alone
        code = getattr(error, "code", None)
        return None, code if code in CODES else "UNKNOWN"


def _schema(table: AnalyzeArgument, key: AnalyzeArgument, needed: str, more: list[T.StructField]) -> AnalyzeResult:
    """The result's columns: the key as the table has it, and those of the function."""
    if not table.isTable or key.isTable or not isinstance(key.value, str):
        raise PySparkValueError("the arguments are a table and the name of its key")
    names = table.dataType.names
    if key.value not in names or needed not in names:
        raise PySparkValueError(f"the table has no column {key.value if key.value not in names else needed}")
    return AnalyzeResult(T.StructType([T.StructField(key.value, table.dataType[key.value].dataType), *more, _ERROR]))


def register_parser(spark: SparkSession, name: str, parser: Callable[[str | None], list[dict]]) -> None:
    """name(body, limit): rank, title, url, snippet of a result page's first hits, or one row with its error. A page that says
    that it has no results has no row; a null page is an empty one."""

    class Hits:
        def eval(self, body: str, limit: int):
            made, error = called(provider_pages.outcome, DEADLINE, body, parser)
            hits, error = (made[0], made[1]) if made else ([], error)
            for rank, hit in enumerate(hits[: max(0, limit)], 1):
                yield rank, hit["title"], hit["url"], hit["snippet"], None
            if error:
                yield None, None, None, None, error

    spark.udtf.register(name, udtf(Hits, returnType=T.StructType([*_HIT, _ERROR])))


def register_parsers(spark: SparkSession) -> None:
    """The parsers of this library, under their names in PARSERS."""
    for name, parser in PARSERS.items():
        register_parser(spark, name, parser)


def register_provider(spark: SparkSession, name: str, search: Callable[[dict], list[dict]], *, seconds: float = DEADLINE) -> None:
    """name(TABLE(requests) [PARTITION BY ...], key): the hits of a user's provider for each request (a row with a query).

    search takes a row as a dict and returns hits (title, url, snippet, rank). A request has one row per hit, or one with its
    error: INVALID_INPUT without a query, TIMEOUT, PARSE_CHANGED for invalid hits, what the provider raises as Failed, UNKNOWN
    otherwise. Requests of a partition that are equal but for their key are asked once. ValueError for an invalid provider.
    """
    if error := provider_error(name, search):
        raise ValueError(error)

    class Provider:
        def __init__(self):
            self.answers: OrderedDict[str, tuple] = OrderedDict()

        @staticmethod
        def analyze(requests: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
            return _schema(requests, key, "query", _HIT)

        def ask(self, request: dict) -> tuple:
            if not (request["query"] or "").strip():
                return None, "INVALID_INPUT"
            return called(lambda r: checked_hits(search(r)), seconds, request)

        def eval(self, requests: T.Row, key: str):
            request = requests.asDict(recursive=True)
            mine = request[key]
            known = repr(sorted((c, v) for c, v in request.items() if c != key))
            if known in self.answers:
                self.answers.move_to_end(known)
            else:
                self.answers[known] = self.ask(request)
                if len(self.answers) > ANSWERS:
                    self.answers.popitem(last=False)
            hits, error = self.answers[known]
            for hit in hits or []:
                yield mine, *hit, None
            if error:
                yield mine, None, None, None, None, error

    spark.udtf.register(name, udtf(Provider))


def register_retriever(spark: SparkSession, name: str, retrieve: Callable[[dict], dict], *, seconds: float = DEADLINE) -> None:
    """name(TABLE(requests) [PARTITION BY ...], key): the response of a user's retriever to each request (a row with a url), a row
    each, for captures.checked.

    A request whose url is null, or whose column url_error says something (hosts.outbound_error), is UNSAFE_URL and not asked.
    """
    if error := provider_error(name, retrieve):
        raise ValueError(error)

    class Retriever:
        @staticmethod
        def analyze(requests: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
            return _schema(requests, key, "url", _RESPONSE)

        def eval(self, requests: T.Row, key: str):
            request = requests.asDict(recursive=True)
            unsafe = request["url"] is None or request.get("url_error") is not None
            made, error = (None, "UNSAFE_URL") if unsafe else called(lambda r: response(retrieve(r)), seconds, request)
            yield request[key], *(made or (None,) * len(_RESPONSE)), error

    spark.udtf.register(name, udtf(Retriever))
