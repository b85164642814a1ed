"""Operators with state and timers on streams: a refresh queue, a series of jobs, map views.

Each is a small machine a key: `note` takes an event, `due` says when it wants to be woken, `wake` is called then; all three may give rows.
Events wait in a list state until the watermark is past them, and a timer at each one's time brings them out in order, so that results are
the same however a stream is cut into batches and shuffled. Events later than the watermark allows are dropped, and the state of a
key that is idle goes. over_stream() runs a machine on a stream, over_table() on a table."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

#: What a state store needs that keeps timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RefreshQueue:
    """Refreshes of a source take `takes` ms each, one at a time. One that is asked for while another runs waits; while it waits it absorbs
    those asked for later: forced if any was, an owner's if any was. Rows: when a refresh starts."""

    events = "ts timestamp, force boolean, owner boolean"
    rows = "start timestamp, force boolean, owner boolean, asked long"

    def __init__(self, takes: int):
        self.takes = takes

    def note(self, state: dict, at: int, force: bool | None, owner: bool | None) -> list[tuple]:
        wait = state.setdefault("wait", [False, False, 0])
        state["wait"] = [wait[0] or bool(force), wait[1] or bool(owner), wait[2] + 1]
        return self.wake(state, at) if at >= state.get("until", at) else []

    def due(self, state: dict) -> int | None:
        return state.get("until")

    def wake(self, state: dict, at: int) -> list[tuple]:
        wait = state.pop("wait", None)
        state.pop("until", None)
        if wait is None:
            return []
        state["until"] = at + self.takes
        return [(at, *wait)]


class Series:
    """Jobs of a series, one after another: `add` puts an item at the end, `end` says the running one has ended, `cancel` takes an item out, the
    running one too. Rows: when an item starts, and how many wait then."""

    events = "ts timestamp, kind string, item string"
    rows = "start timestamp, item string, waiting long"

    def note(self, state: dict, at: int, kind: str | None, item: str | None) -> list[tuple]:
        queue = state.setdefault("queue", [])
        if kind == "add":
            queue.append(item)
        elif kind == "end" or (kind == "cancel" and state.get("runs") == item):
            state.pop("runs", None)
        elif kind == "cancel" and item in queue:
            queue.remove(item)
        if "runs" in state or not queue:
            if not queue:
                state.pop("queue")
            return []
        state["runs"] = queue.pop(0)
        return [(at, state["runs"], len(queue))]

    def due(self, state: dict) -> int | None:
        return None

    def wake(self, state: dict, at: int) -> list[tuple]:
        return []


class Views:
    """What a map shows, from the tiles it asks for: a burst ends when no new tile has come for `gap` ms; a deeper zoom starts it anew, a shallower
    one and a tile that it holds do not prolong it. Rows: a burst's zoom, its tiles, and their middle (Web Mercator tiles; the
    longitude is the circular mean). Bursts shallower than `shallowest` show nothing."""

    events = "ts timestamp, z int, x int, y int"
    rows = "until timestamp, z int, tiles long, lon double, lat double"

    def __init__(self, gap: int = 5000, shallowest: int = 0):
        self.gap, self.shallowest = gap, shallowest

    def note(self, state: dict, at: int, z: int | None, x: int | None, y: int | None) -> list[tuple]:
        if z is None or x is None or y is None:
            return []
        if not state or z > state["z"]:
            state.update(z=z, tiles=[], new=at)
        if z == state["z"] and [x, y] not in state["tiles"]:
            state["tiles"].append([x, y])
            state["new"] = at
        return []

    def due(self, state: dict) -> int | None:
        return state["new"] + self.gap + 1 if state else None

    def wake(self, state: dict, at: int) -> list[tuple]:
        z, tiles = state["z"], sorted(state["tiles"])
        state.clear()
        if z < self.shallowest:
            return []
        edge = lambda y: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / 2**z))))
        turn = [2 * math.pi * (x + 0.5) / 2**z - math.pi for x, _ in tiles]
        lon = math.degrees(math.atan2(sum(map(math.sin, turn)), sum(map(math.cos, turn))))
        return [(at, z, len(tiles), lon, sum((edge(y) + edge(y + 1)) / 2 for _, y in tiles) / len(tiles))]


def _run(machine, state: dict, events: list[tuple], upto: int | None) -> Iterator[tuple]:
    """Events (at, …) and wakings in order of time, as far as upto; a waking comes before events of its own time."""
    for event in [*sorted(events, key=lambda e: (e[0], *map(repr, e[1:]))), None]:
        limit = event[0] if event else upto
        while (due := machine.due(state)) is not None and (limit is None or due <= limit):
            yield from machine.wake(state, due)
        if event:
            yield from machine.note(state, *event)


def _millis(rows) -> list[tuple]:
    import pandas as pd

    return [(int(pd.Timestamp(r[0]).value // 1_000_000), *(None if pd.isna(x) else getattr(x, "item", lambda x=x: x)() for x in r[1:])) for r in rows if not pd.isna(r[0])]


class _Ordered(StatefulProcessor):
    def __init__(self, machine, keys: list[str], schema: T.StructType):
        self.machine, self.keys, self.schema = machine, keys, schema

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", "text string")
        self.waiting = handle.getListState("waiting", "text string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        times: set[int] = set()
        for batch in rows:
            events = _millis(batch[[c.split()[0] for c in self.machine.events.split(", ")]].itertuples(index=False))
            self.waiting.appendList([(json.dumps(e),) for e in events]) if events else None
            times.update(e[0] for e in events)
        for at in times:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        import pandas as pd

        at = expiredTimerInfo.getExpiryTimeInMs()
        events = [tuple(json.loads(text)) for (text,) in self.waiting.get()]
        later = [e for e in events if e[0] > at]
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        out = list(_run(self.machine, state, [e for e in events if e[0] <= at], at))
        if later:
            self.waiting.put([(json.dumps(e),) for e in later])
        elif events:
            self.waiting.clear()
        if state:
            self.state.update((json.dumps(state),))
            if (due := self.machine.due(state)) is not None:
                self.handle.registerTimer(due)
        elif self.state.exists():
            self.state.clear()
        if out:
            yield _frame(pd, key, self.keys, out, self.schema)


def _frame(pd, key: tuple, keys: list[str], out: list[tuple], schema: T.StructType):
    df = pd.DataFrame([(*key, *row) for row in out], columns=[f.name for f in schema])
    at = schema[len(keys)].name
    df[at] = pd.to_datetime(df[at], unit="ms")
    return df


def _schema(df: DataFrame, keys: list[str], machine) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), *T._parse_datatype_string(machine.rows)])


def over_stream(events: DataFrame, keys: list[str], machine, late: str = "10 minutes") -> DataFrame:
    """keys and the machine's rows, of a stream with the columns of `machine.events`. Sets the session's state store to one with timers."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    schema = _schema(events, keys, machine)
    marked = events.withWatermark("ts", late)
    return marked.groupBy(*keys).transformWithStateInPandas(_Ordered(machine, keys, schema), schema, "Append", "EventTime")


def over_table(events: DataFrame, keys: list[str], machine) -> DataFrame:
    """The same of a table: a key's events are a group."""
    schema = _schema(events, keys, machine)
    columns = [c.split()[0] for c in machine.events.split(", ")]

    def run(key, part):
        import pandas as pd

        out = list(_run(machine, {}, _millis(part[columns].itertuples(index=False)), None))
        return _frame(pd, key, keys, out, schema) if out else pd.DataFrame(columns=[f.name for f in schema])

    run.__annotations__ = {}
    return events.select(*keys, *columns).groupBy(*(F.col(k) for k in keys)).applyInPandas(run, schema)
