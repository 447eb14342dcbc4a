"""Streams that remember: a cache with a time to live and a limit, cooldowns, and bytes of open requests.

Each is a processor of transformWithStateInPandas whose state is bounded per key and goes when event time has passed it. The
state store must be RocksDB (`with_state` sets it for a session).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> None:
    """The state store that processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _ordered(frames: Iterator[pd.DataFrame]) -> list[tuple]:
    """A key's rows of a micro-batch, by time and id."""
    rows = [r for f in frames for r in f.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: (r[1], r[2]))


class _Cache(StatefulProcessor):
    """Rows (cache, at, id, name); state: an entry for each name that is held, the limit at most."""

    def __init__(self, ttl: int, most: int):
        self.ttl, self.most = ttl, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "name string", "expires long, used long")
        self.uses = handle.getValueState("uses", "n long")

    def handleInputRows(self, key, rows, timerValues):
        held = {k[0]: (v[0], v[1]) for k, v in self.entries.iterator()}
        before, uses, out = dict(held), self.uses.get()[0] if self.uses.exists() else 0, []
        for _, at, id_, name, *_ in _ordered(rows):
            found = held.get(name)
            outcome = "miss" if found is None or at >= found[0] + self.ttl else "expired" if at >= found[0] else "hit"
            uses += 1
            evicted = None
            if outcome == "hit":
                held[name] = (found[0], uses)
            elif self.most and self.ttl > 0:
                held[name] = (at + self.ttl, uses)
                if len(held) > self.most:
                    oldest = min(held, key=lambda n: held[n][1])
                    evicted = oldest if held.pop(oldest)[0] > at else None
            out.append((key[0], id_, name, outcome, evicted))
        for name in before.keys() - held.keys():
            self.entries.removeKey((name,))
        for name, entry in held.items():
            if before.get(name) != entry:
                self.entries.updateValue((name,), entry)
        self.uses.update((uses,))
        self._wake(held)
        yield pd.DataFrame(out, columns=["cache", "id", "name", "outcome", "evicted"])

    def _wake(self, held: dict) -> None:
        """One timer, for when the last entry is not even known as expired any more."""
        if held:
            at = (max(e[0] for e in held.values()) + self.ttl) // 1000 + 1
            timers = [t for t in self.handle.listTimers()]
            for t in timers:
                if t != at:
                    self.handle.deleteTimer(t)
            if at not in timers:
                self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.entries.clear()
        self.uses.clear()
        return iter(())

    def close(self) -> None:
        pass


def cached(stream: DataFrame, cache: str, name: str, ts: str, id_: str, ttl_s: float, most: int, late: str = "1 hour") -> DataFrame:
    """Lookups (cache, name, ts, id) -> cache, id, name, outcome, evicted: what a cache with a time to live and a limit does.

    A lookup that finds nothing stores the name. outcome: hit; miss; expired, if an entry was found that ran out less than
    a time to live ago. An entry runs out at its end, the end included, however often it was hit; a hit makes it the most
    recently used. Beyond the limit the least recently used entry goes, and evicted names it unless it had run out. A
    limit of 0 stores nothing. Rows of a micro-batch are taken by time and id; rows that are later than late are dropped.
    State: the entries of each cache, until all have run out for a time to live.
    """
    rows = stream.withWatermark(ts, late).select(F.col(cache).cast("string").alias("cache"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(id_).cast("long").alias("id"), F.col(name).cast("string").alias("name"), F.col(ts).alias("ts_"))
    schema = "cache string, id long, name string, outcome string, evicted string"
    return rows.groupBy("cache").transformWithStateInPandas(_Cache(int(ttl_s * 1e6), most), schema, "Append", "EventTime")


class _Cooldown(StatefulProcessor):
    """Rows (key, at, id, failed), held until the watermark has passed them, so that late ones are in their places."""

    def __init__(self, cooldown: int):
        self.cooldown = cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, failed boolean")
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows, timerValues):
        new = [(at, id_, bool(failed)) for _, at, id_, failed, *_ in _ordered(rows)]
        self.waiting.appendList(new)
        self._wake(new[0][0])
        return iter(())

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((r[0], r[1], r[2]) for r in self.waiting.get())
        until = self.until.get()[0] if self.until.exists() else None
        out, left = [], [r for r in waiting if r[0] >= now]
        for at, id_, failed in waiting[: len(waiting) - len(left)]:
            out.append((key[0], id_, None if until is None else pd.Timestamp(until, unit="us"), until is not None and until > at))
            if failed:
                until = at + self.cooldown
        if left:
            self.waiting.put(left)
            self._wake(left[0][0])
        else:
            self.waiting.clear()
        if until is not None and until < now and not left:
            self.until.clear()  # closed: no later row is before it
            until = None
        elif until is not None:
            self.until.update((until,))
            if not left:
                self._wake(until)
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "until", "blocked"])

    def close(self) -> None:
        pass


def cooled(stream: DataFrame, key: str, ts: str, id_: str, failed: Column, cooldown_s: float, late: str = "1 hour") -> DataFrame:
    """Requests (key, ts, id) -> key, id, until, blocked, as operators.timing.cooled says, once the watermark has passed each.

    until: the end of the cooldown that the last earlier failure of the key started; a cooldown that ended before
    all later rows is forgotten, so until is then null. Failures that come late, but within late, are in their places.
    """
    rows = stream.withWatermark(ts, late).select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(id_).cast("long").alias("id"), F.coalesce(failed, F.lit(False)).alias("failed"), F.col(ts).alias("ts_"))
    schema = "key string, id long, until timestamp_ntz, blocked boolean"
    return rows.groupBy("key").transformWithStateInPandas(_Cooldown(int(cooldown_s * 1e6)), schema, "Append", "EventTime")


class _Bytes(StatefulProcessor):
    """Rows (key, at, id, request, kind, decoded, encoded); state: the bytes of each open request, the total, and the end."""

    def __init__(self, cap: int, idle: int):
        self.cap, self.idle = cap, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.requests = handle.getMapState("requests", "request string", "decoded long, encoded long, counted long")
        self.total = handle.getValueState("total", "bytes long, done boolean")

    def handleInputRows(self, key, rows, timerValues):
        total, done = self.total.get() if self.total.exists() else (0, False)
        open_, out, last = {}, [], 0
        for _, at, id_, request, kind, decoded, encoded, *_ in _ordered(rows):
            last = at
            if done:
                continue
            if request not in open_:
                found = self.requests.getValue((request,)) if self.requests.containsKey((request,)) else None
                open_[request] = list(found) if found else None
            if kind == "failed":
                open_[request] = None
                continue
            bad = pd.isna(encoded) or encoded < 0 or (kind == "data" and (pd.isna(decoded) or decoded < 0))
            now = open_[request] or [0, 0, 0]
            if not bad:
                now[0] += int(decoded) if kind == "data" else 0
                now[1] += int(encoded) if kind == "data" else max(0, int(encoded) - now[1])
                total += max(now[0], now[1]) - now[2]
                now[2] = max(now[0], now[1])
            open_[request] = now if kind == "data" else None
            if bad or total > self.cap:
                done = True
                out.append((key[0], id_, total, "UPSTREAM_HTTP" if bad else "RESPONSE_TOO_LARGE"))
        if done:
            self.requests.clear()
        else:
            for request, now in open_.items():
                if now:
                    self.requests.updateValue((request,), tuple(now))
                elif self.requests.containsKey((request,)):
                    self.requests.removeKey((request,))
        self.total.update((total, done))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer((last + self.idle) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "total", "code"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.requests.clear()
        self.total.clear()
        return iter(())

    def close(self) -> None:
        pass


def accounted(stream: DataFrame, key: str, ts: str, id_: str, cap: int, idle_s: float, late: str = "1 hour") -> DataFrame:
    """Network events (key, ts, id, request, kind, decoded, encoded) -> key, id, total, code: the event with which a page
    passes its cap, once, as operators.budget.accounted says. A page without events for idle_s is forgotten. Rows of a
    micro-batch are taken by time and id."""
    rows = stream.withWatermark(ts, late).select(
        F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(id_).cast("long").alias("id"), F.col("request").cast("string").alias("request"), "kind",
        F.col("decoded").cast("long").alias("decoded"), F.col("encoded").cast("long").alias("encoded"), F.col(ts).alias("ts_"),
    )
    return rows.groupBy("key").transformWithStateInPandas(_Bytes(cap, int(idle_s * 1e6)), "key string, id long, total long, code string", "Append", "EventTime")
