"""Alert life cycles, inhibition, grouped notices and traces as streams, each the same as its batch form.

All of them keep the rows of a key until the watermark has passed them and then take them in order of event
time, so what arrives out of order within ``late`` changes nothing, and a restart goes on from the checkpoint. Rows
later than that are refused by the watermark. A key's state is what it has within ``late`` and a few numbers, and lies in
slots of time: a worker holds one slot of one key, or ``HELD`` rows that have come. Event-time timers
wake a key when its next row or its next own moment is due.

The state store has to be RocksDB, which ``with_state`` sets for the session. Null keys are a key; rows without a time are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from skein.operators.telemetry import FIRING, INACTIVE, PENDING, RESOLVED

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000
STEP = {FIRING: 1, RESOLVED: -1}
#: Time whose rows of a key are read together, rows that wait to be put into slots, rows of a value of the state, and rows given at once.
SLOT, HELD, CHUNK, GIVEN = 3600 * MICROS, 50_000, 5_000, 10_000


class InOrder(StatefulProcessor):
    """Rows of a key in order of time. ``step`` gets those that the watermark has passed, a slot at a time, and what it noted before."""

    def __init__(self, names: list[str]):
        self.names = names

    def step(self, memo: dict[str, Any], rows: list[tuple[int, dict[str, Any]]], until: int) -> Iterator[tuple]:
        raise NotImplementedError

    def wakes(self, memo: dict[str, Any]) -> int | None:
        """When the key has something to do without another row."""
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long, nth long", "rows string")
        self.memo = handle.getValueState("memo", "memo string, timer long")

    def _read(self) -> tuple[dict[str, Any], int | None]:
        if not self.memo.exists():
            return {}, None
        memo, timer = self.memo.get()
        return json.loads(memo), timer

    def _note(self, memo: dict[str, Any], timer: int | None, before: int | None) -> None:
        if timer != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if timer is not None:
                self.handle.registerTimer(timer)
        self.memo.update((json.dumps(memo), timer))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        memo, timer = self._read()
        first, held = timer, []
        for frame in rows:
            held.extend(zip(frame["at"].astype("int64").tolist(), frame["what"].tolist(), strict=True))
            soonest = -(-int(frame["at"].min()) // 1000)
            first = soonest if first is None else min(first, soonest)
            if len(held) >= HELD:
                self._put(memo, held)
                held = []
        self._put(memo, held)
        self._note(memo, first, timer)
        return iter(())

    def _put(self, memo: dict[str, Any], rows: list[tuple[int, str]]) -> None:
        slots: dict[int, list[tuple[int, str]]] = {}
        for row in rows:
            slots.setdefault(row[0] // SLOT, []).append(row)
        for slot, own in slots.items():
            for a in range(0, len(own), CHUNK):
                memo["_put"] = memo.get("_put", 0) + 1
                self.waiting.updateValue((slot, memo["_put"]), (json.dumps(own[a : a + CHUNK]),))

    def _take(self, memo: dict[str, Any], until: int, left: list[int]) -> Iterator[tuple]:
        """What ``step`` gives up to a time; ``left`` gets the time of the first row that has to wait."""
        places = sorted(tuple(p) for p in self.waiting.keys()) if self.waiting.exists() else []
        for slot, own in groupby(places, key=itemgetter(0)):
            own = list(own)
            held = sorted((at, what) for p in own for at, what in json.loads(self.waiting.getValue(p)[0]))
            due, later = [r for r in held if r[0] <= until], [r for r in held if r[0] > until]
            if due:
                for p in own:
                    self.waiting.removeKey(p)
                self._put(memo, later)
                yield from self.step(memo, [(at, json.loads(what)) for at, what in due], min(until, (slot + 1) * SLOT - 1))
            if later:
                left.append(later[0][0])
                break
        yield from self.step(memo, [], until)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        memo, timer = self._read()
        until = timerValues.getCurrentWatermarkInMs() * 1000
        label, left = key if isinstance(key, tuple) else (key,), []
        told = self._take(memo, until, left)
        while out := list(islice(told, GIVEN)):
            yield pd.DataFrame([(*label, *row) for row in out], columns=self.names)
        moments = [-(-m // 1000) for m in (*left, self.wakes(memo)) if m is not None]
        # the timer that has expired is gone; a moment that has passed would be a fault of ``step``
        self._note(memo, min(moments, default=None), None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer)


def with_state(rows: DataFrame, keys: list[str], what: Column, late: str, make: type[InOrder], result: str, **settings: Any) -> DataFrame:
    """``rows(<keys>, ts)`` through a processor; ``what`` is a struct with all else that it reads of a row.

    Keys travel as one string: columns with nulls would reach the processor as floating-point numbers.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ts, label = F.col("ts").cast("timestamp"), F.to_json(F.struct(*keys)).alias("label")
    timed = rows.where("ts IS NOT NULL").select(label, ts.alias("ts"), F.unix_micros(ts).alias("at"), F.to_json(what).alias("what")).withWatermark("ts", late)
    schema = StructType([StructField("label", StringType()), *_parse_datatype_string(result).fields])
    processor = make(schema.names, **settings)
    out = timed.groupBy("label").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.select(F.from_json("label", rows.select(*keys).schema).alias("label"), *schema.names[1:]).select("label.*", *schema.names[1:])


class _LifeCycle(InOrder):
    def __init__(self, names: list[str], hold: int):
        super().__init__(names)
        self.hold = hold

    def step(self, memo, rows, until):
        times: dict[int, bool] = {}
        for at, what in rows:
            times[at] = times.get(at, False) or bool(what.get("on"))
        for at, on in times.items():
            since = memo.get("since")
            if not on:
                if since is not None:
                    yield at, RESOLVED if memo["fired"] else INACTIVE
                memo["since"] = None
                continue
            if since is None:
                memo |= {"since": at, "fired": False}
                yield at, PENDING
            if not memo["fired"] and at - memo["since"] >= self.hold:
                memo["fired"] = True
                yield at, FIRING


def transitions(points: DataFrame, keys: list[str], condition: Column, hold_seconds: int, *, late: str) -> DataFrame:
    """Stream of ``telemetry.transitions``: <keys>, ``at`` in microseconds, ``state``."""
    on = F.struct(F.coalesce(condition, F.lit(False)).alias("on"))
    return with_state(points, keys, on, late, _LifeCycle, "at long, state string", hold=hold_seconds * MICROS)


class _Inhibition(InOrder):
    def step(self, memo, rows, until):
        for at, same in groupby(rows, key=itemgetter(0)):
            changes = [what for _, what in same]
            for what in changes:
                if what.get("severity") == "critical":
                    memo["open"] = memo.get("open", 0) + STEP.get(what.get("state"), 0)
            for what in changes:
                if what.get("severity") != "warning" or memo.get("open", 0) <= 0:
                    yield at, what.get("id"), what.get("severity"), what.get("state")


def inhibited(changes: DataFrame, equal: list[str], *, late: str) -> DataFrame:
    """Stream of ``telemetry.inhibited_changes``: changes without those of warnings while a critical alert of equal labels is open."""
    what = F.struct("id", "severity", "state")
    return with_state(changes, equal, what, late, _Inhibition, "at long, id long, severity string, state string")


class _Notices(InOrder):
    def __init__(self, names: list[str], wait: int, interval: int, repeat: int):
        super().__init__(names)
        self.wait, self.interval, self.every = wait, interval, -(-repeat // interval)

    def _tick(self, memo: dict[str, Any], nth: int) -> int:
        return memo["begun"] + self.wait + nth * self.interval

    def wakes(self, memo):
        moments = [memo[n] for n in ("news", "again") if memo.get(n) is not None]
        return self._tick(memo, min(moments)) if moments else None

    def _tell(self, memo: dict[str, Any], until: int) -> Iterator[tuple]:
        """Notices up to a time, in order."""
        while (at := self.wakes(memo)) is not None and at <= until:
            again = memo.get("news") is None or (memo.get("again") is not None and memo["again"] < memo["news"])
            nth = memo["again"] if again else memo["news"]
            yield nth, at, 0 if again else memo["new"], memo["open"], again
            if not again:
                memo |= {"news": None, "new": 0}
            memo["again"] = nth + self.every if memo["open"] > 0 else None

    def step(self, memo, rows, until):
        for at, what in rows:
            memo.setdefault("begun", at)
            nth = max(0, -(-(at - memo["begun"] - self.wait) // self.interval))
            # a notice tells what came up to its moment, so earlier ones are due first
            yield from self._tell(memo, self._tick(memo, nth) - 1)
            memo["new"] = memo.get("new", 0) + 1
            memo["open"] = memo.get("open", 0) + STEP.get(what.get("state"), 0)
            memo["news"] = nth
        yield from self._tell(memo, until)


def notices(changes: DataFrame, group: list[str], *, wait: int = 10, interval: int = 10, repeat: int = 3600, late: str) -> DataFrame:
    """Stream of ``telemetry.notices``: <group>, ``nth``, ``at``, ``changes``, ``open``, ``again``."""
    settings = {"wait": wait * MICROS, "interval": interval * MICROS, "repeat": repeat * MICROS}
    return with_state(changes, group, F.struct("state"), late, _Notices, "nth long, at long, changes long, open long, again boolean", **settings)


class _Traces(InOrder):
    def __init__(self, names: list[str], wait: int, most: int):
        super().__init__(names)
        self.wait, self.most = wait, most

    def wakes(self, memo):
        held = memo.get("held")
        return next(iter(held.values()))[0] + self.wait if held else None

    def step(self, memo, rows, until):
        held = memo.setdefault("held", {})  # in the order in which the traces began

        def release(name: str, reason: str) -> tuple:
            begun, spans = held.pop(name)
            return json.loads(name), begun, spans, reason

        def waited(before: int) -> Iterator[tuple]:
            while held and held[name := next(iter(held))][0] + self.wait < before:
                yield release(name, "waited")

        for at, what in rows:
            name = json.dumps(what.get("trace"))
            yield from waited(at)
            if name not in held and len(held) >= self.most:
                yield release(next(iter(held)), "full")
            held.setdefault(name, [at, 0])[1] += 1
        yield from waited(until + 1)


def grouped_traces(spans: DataFrame, trace: str, *, wait_seconds: int = 10, most: int = 1000, shards: int = 1, late: str) -> DataFrame:
    """``trace, begun, spans, reason`` of traces, each ``wait_seconds`` after its first span or, of more than ``most`` open ones, the oldest first.

    Spans that come after their trace was released begin it anew. The ``shards`` hold an equal part of ``most`` each.
    """
    shard = F.pmod(F.xxhash64(trace), F.lit(shards)).cast("int").alias("shard")
    keyed = spans.withColumn("shard", shard)
    made = with_state(keyed, ["shard"], F.struct(F.col(trace).alias("trace")), late, _Traces, "trace long, begun long, spans long, reason string", wait=wait_seconds * MICROS, most=max(1, most // shards))
    return made.drop("shard")


def progress(changes: DataFrame, keys: list[str], *, late: str) -> DataFrame:
    """The first row of each key, once within ``late``: a notification for each (index, stage)."""
    timed = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.dropDuplicatesWithinWatermark(keys)


def settled(changes: DataFrame, key: str, *, gap: str, late: str) -> DataFrame:
    """One row for each burst of changes of a key, when nothing came for ``gap``: the debounce of a watcher."""
    timed = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("changes")).select(key, F.col("w.start").alias("begun"), "changes")
