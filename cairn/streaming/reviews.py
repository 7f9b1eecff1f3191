"""Reviews: queues of items that are decided one by one, as a stateful stream with refusals, moves, undo and expiry.

A session's state is a map of decisions, a list of steps and a few values, each kept apart, so that a decision writes one entry.
Events of a session are taken by their time and number; what comes of each is told at once. A timer ends sessions that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Two decisions closer than this (ms) are one bounced key press, and the most steps that can be taken back.
BOUNCE_MS, MAX_STEPS = 45, 20_000
OUTCOME = "session string, seq long, outcome string, cursor int, kept int, marked int"


class _Review(StatefulProcessor):
    """Actions: items (a list of ids; again: what there is now), keep or trash (a decision on the current item), undo, go (by ``index``),
    jump (to ``index``), keep_all (marked ones back to keep). ``guarded`` and ``repeat`` go with a decision."""

    def __init__(self, idle_ms: int | None, ttl_ms: int | None, max_steps: int):
        self.idle_ms, self.ttl_ms, self.max_steps = idle_ms, ttl_ms, max_steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "cursor int, last_at long, first int, next int, kept int, marked int", self.ttl_ms)
        self.items = handle.getListState("items", "id string", self.ttl_ms)
        self.at = handle.getMapState("at", "id string", "pos int", self.ttl_ms)
        self.decisions = handle.getMapState("decisions", "id string", "decision string", self.ttl_ms)
        # Steps by their number: adding, taking back and forgetting the oldest touch one entry each.
        self.steps = handle.getMapState("steps", "n int", "id string, before string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        events = pd.concat(list(rows)).sort_values(["at_ms", "seq"])
        p = self.place.get() if self.place.exists() else (0, None, 0, 0, 0, 0)
        s = {"cursor": p[0], "last_at": p[1], "first": p[2], "next": p[3], "kept": p[4], "marked": p[5]}
        items = [x[0] for x in self.items.get()] if self.items.exists() else []
        out = []
        for e in events.itertuples():
            outcome, items = self._one(e, s, items)
            out.append((key[0], int(e.seq), outcome, s["cursor"], s["kept"], s["marked"]))
        self.place.update((s["cursor"], s["last_at"], s["first"], s["next"], s["kept"], s["marked"]))
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=OUTCOME.replace(",", "").split()[::2])

    def handleExpiredTimer(self, key: tuple, timer_values, expired) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        p = self.place.get()
        for state in (self.place, self.items, self.at, self.decisions, self.steps):
            state.clear()
        yield pd.DataFrame([(key[0], None, "expired", p[0], p[4], p[5])], columns=OUTCOME.replace(",", "").split()[::2])

    def _decided(self, item: str) -> str | None:
        return self.decisions.getValue((item,))[0] if self.decisions.containsKey((item,)) else None

    def _set(self, s: dict, item: str, decision: str | None) -> None:
        before = self._decided(item)
        for d, by in ((before, -1), (decision, 1)):
            if d is not None:
                s["kept" if d == "keep" else "marked"] += by
        if decision is None:
            self.decisions.removeKey((item,))
        else:
            self.decisions.updateValue((item,), (decision,))

    def _one(self, e, s: dict, items: list[str]) -> tuple[str, list[str]]:  # noqa: ANN001
        if e.action == "items":
            return "items", self._reconciled(s, items, list(e.items))
        if e.action in ("keep", "trash"):
            if s["cursor"] >= len(items):
                return "finished", items
            if e.repeat:
                return "repeat", items
            if s["last_at"] is not None and e.at_ms - s["last_at"] < BOUNCE_MS:
                return "bounce", items
            if e.action == "trash" and e.guarded:
                return "protected", items
            item = items[s["cursor"]]
            self.steps.updateValue((s["next"],), (item, self._decided(item)))
            s["next"] += 1
            if s["next"] - s["first"] > self.max_steps:
                self.steps.removeKey((s["first"],))
                s["first"] += 1
            self._set(s, item, e.action)
            s["cursor"] += 1
            s["last_at"] = int(e.at_ms)
        elif e.action == "undo":
            if s["next"] == s["first"]:
                return "nothing", items
            s["next"] -= 1
            item, before = self.steps.getValue((s["next"],))
            self.steps.removeKey((s["next"],))
            self._set(s, item, before)
            s["cursor"] = self.at.getValue((item,))[0]
        elif e.action in ("go", "jump"):
            s["cursor"] = min(len(items), max(0, int(e.index) + (s["cursor"] if e.action == "go" else 0)))
        elif e.action == "keep_all":
            for item, (decision,) in list(self._all()):
                if decision == "trash":
                    self._set(s, item, "keep")
        else:
            return "unknown", items
        return e.action, items

    def _all(self) -> Iterator[tuple[str, tuple]]:
        for (item,), value in self.decisions.iterator():
            yield item, value

    def _reconciled(self, s: dict, old: list[str], new: list[str]) -> list[str]:
        """Decisions and steps of items that are there stay; the cursor stays on its item, else on the next that is there."""
        place = {x: i for i, x in enumerate(new)}
        s["cursor"] = next((place[x] for x in old[s["cursor"] :] if x in place), len(new)) if old else min(s["cursor"], len(new))
        for item, _ in list(self._all()):
            if item not in place:
                self._set(s, item, None)
        left = [self.steps.getValue((n,)) for n in range(s["first"], s["next"])]
        self.steps.clear()
        s["first"], s["next"] = 0, 0
        for item, before in left:
            if item in place:
                self.steps.updateValue((s["next"],), (item, before))
                s["next"] += 1
        self.items.put([(x,) for x in new])
        self.at.clear()
        for x, i in place.items():
            self.at.updateValue((x,), (i,))
        return new


def reviews(events: DataFrame, idle_ms: int | None = None, ttl_ms: int | None = None, max_steps: int = MAX_STEPS) -> DataFrame:
    """(session, seq, outcome, cursor, kept, marked) for each event of a stream (session, seq, at_ms, action, items, index, guarded, repeat).

    Outcomes: the action if it was taken, else why not: finished, repeat, bounce (within BOUNCE_MS of the decision before), protected,
    nothing (to undo), unknown. Events of a batch are taken by at_ms, then seq; those of a later batch come after them. After ``idle_ms`` without an event a session is told as
    expired and forgotten; ``ttl_ms`` is the longest that any entry of its state is kept; ``max_steps`` can be taken back. Needs the RocksDB state store.
    """
    filled = events.withColumns({"guarded": F.coalesce("guarded", F.lit(False)), "repeat": F.coalesce("repeat", F.lit(False)), "index": F.coalesce("index", F.lit(0))})
    return filled.groupBy("session").transformWithStateInPandas(_Review(idle_ms, ttl_ms, max_steps), OUTCOME, "Append", "ProcessingTime" if idle_ms is not None or ttl_ms is not None else "None")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start meanwhile keep their state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)
