"""A user's own guard and assessor, called for each item within a deadline: what they raise, miss or get wrong concerns
that item alone."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import policy

# Seconds that a hook has for an item.
DEADLINE = 30.0
ANSWERS = ("source_content",)
_VERDICT = "decision string, assurance string, findings array<struct<category string, severity string, confidence double, location string, reason string, techniques array<string>, segment_hash string>>, reasons array<string>, limitations array<string>"
_FINDING = {"category": None, "severity": None, "confidence": None, "location": None, "reason": None, "techniques": [], "segment_hash": ""}


class Late(Exception):
    """A hook took longer than it may."""


def within(seconds: float, call: Callable, *args):
    """call(*args), or Late. A task's main thread interrupts the call itself; elsewhere a call that is late is left alone."""
    if threading.current_thread() is threading.main_thread():

        def late(*_):
            raise Late

        before = signal.signal(signal.SIGALRM, late)
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            return call(*args)
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)
    done: list = []

    def run() -> None:
        try:
            done.append((call(*args), None))
        except Exception as error:
            done.append((None, error))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not done:
        raise Late
    if done[0][1]:
        raise done[0][1]
    return done[0][0]


def assessed(segments: DataFrame, verdicts: DataFrame, key: str, assessor: Callable[[pd.DataFrame], str], *, ordinal: str = "ordinal", seconds: float = DEADLINE) -> DataFrame:
    """What a user's assessor says of each item that may be reviewed: key, answer, for policy.reviewed.

    assessor takes an item's segments (ordinal, location, text; those with text, in order) as a pandas frame and returns
    `source_content` or anything else. The answer is null if it raises or takes longer than seconds. Only items that were
    read whole and are small enough are gathered (policy.reviewable: 4,096 segments and 160,000 characters at most),
    so no task holds more than one such item. A null key is never asked.
    """
    few = verdicts.where(policy.reviewable(verdicts)).select(key)
    rows = segments.join(few, key, "left_semi").where("text != ''")
    items = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("ordinal"), "location", "text"))).alias("segments"))
    kind = segments.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = []
            for item in frame["segments"]:
                try:
                    answer = within(seconds, assessor, pd.DataFrame([{"ordinal": s["ordinal"], "location": s["location"], "text": s["text"]} for s in item]))
                    said.append(answer if isinstance(answer, str) else "other")
                except Exception:  # the contract: whatever a hook does concerns its item alone
                    said.append(None)
            yield pd.DataFrame({key: frame[key], "answer": said})

    return items.mapInPandas(run, f"`{key}` {kind}, answer string")


def guarded(items: DataFrame, key: str, guard: Callable[[dict], dict], *, seconds: float = DEADLINE) -> DataFrame:
    """What a user's additional guard says of each item: key, decision, assurance, findings, reasons, limitations, error.

    guard takes a row as a dict and returns a verdict with these fields. error is GUARD_FAILED, and all else null, if it
    raises, takes longer than seconds, or returns what policy.verdict_error refuses. Rows in, rows out.
    """
    kind = items.schema[key].dataType.simpleString()

    def one(row: dict) -> list:
        try:
            said = within(seconds, guard, row)
            found = [{f: x.get(f, default) for f, default in _FINDING.items()} for x in said.get("findings") or []]
            return [str(said["decision"]), str(said["assurance"]), found, [str(x) for x in said.get("reasons") or []], [str(x) for x in said.get("limitations") or []]]
        except Exception:  # the contract: whatever a hook does concerns its item alone
            return [None, None, [], [], []]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "decision", "assurance", "findings", "reasons", "limitations"]
        for frame in frames:
            yield pd.DataFrame([[row[key], *one(row)] for row in frame.to_dict("records")], columns=names)

    said = items.mapInPandas(run, f"`{key}` {kind}, {_VERDICT}")
    error = policy.verdict_error(said)
    return said.withColumn("error", error).select(key, *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("decision", "assurance", "findings", "reasons", "limitations")], "error")
