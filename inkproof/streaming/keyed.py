"""Keyed state of streams: what was seen of a key before, kept by Spark's state store.

A batch looks up its own keys in the store on the executors and nothing else, however much was seen;
state is part of the checkpoint, so a batch that comes again finds the state it found before.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need a store that holds more than memory does."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class FirstOfKey(StatefulProcessor):
    """Rows ``keyless, own_id, packed`` and columns to order by, of one key: adds how many came before, and the first ``most`` of their ids.

    Keeps a count and at most ``most`` ids for each key; nothing for rows without one.
    """

    def __init__(self, order: list[str], most: int = 3) -> None:
        self.order, self.most = order, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, firsts array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = list(rows)
        if rows[0]["keyless"]:
            for r in rows:
                yield Row(packed=r["packed"], duplicate_count=0, duplicate_ids=[])
            return
        rows.sort(key=lambda r: [(r[c] is not None, r[c]) for c in (*self.order, "own_id")])  # nulls first
        found = self.seen.get()
        n, firsts = (found[0], list(found[1])) if found is not None else (0, [])
        self.seen.update((n + len(rows), [*firsts, *(r["own_id"] for r in rows)][: self.most]))
        for i, r in enumerate(rows):
            yield Row(packed=r["packed"], duplicate_count=n + i, duplicate_ids=list(firsts))
            if len(firsts) < self.most:
                firsts.append(r["own_id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return iter(())

    def close(self) -> None:
        pass


class _AtKey:
    """The entry of one key, as :class:`FirstOfKey` uses a state."""

    def __init__(self, entries, key: str) -> None:
        self.entries, self.key = entries, (key,)

    def get(self):
        return self.entries.getValue(self.key)

    def update(self, value: tuple) -> None:
        self.entries.updateValue(self.key, value)


class FirstOfKeys(FirstOfKey):
    """As :class:`FirstOfKey`, for groups of keys, told apart by ``key``: each key has a state of its own, and a group's rows leave Python together.

    Spark sends one message to the state and one table of rows for each group, which costs more than the rows themselves.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("seen", "key string", "n long, firsts array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for own, mine in groupby(sorted(rows, key=lambda r: r["key"]), lambda r: r["key"]):
            self.seen = _AtKey(self.entries, own)
            yield from super().handleInputRows((own,), mine, timerValues)


class NumberInWindow(StatefulProcessor):
    """Numbers the rows of one identity and window as they arrive, in the order of time within a batch, and forgets the window by a timer.

    The timer fires when the watermark passes the window's end; rows that come later still are left out.
    """

    def __init__(self, keys: list[str], columns: list[str], at: str, order: list[str], limit: int, seconds: int) -> None:
        """``keys``: names of the grouping columns, the window's start in seconds last; ``columns``: of the result, before the number."""
        self.keys, self.columns, self.at, self.order, self.limit, self.seconds = keys, columns, at, order, limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.count = handle, handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        end = (int(key[-1]) + self.seconds) * 1000
        if timerValues.getCurrentWatermarkInMs() >= end:
            return
        rows = sorted(rows, key=lambda r: [(r[c] is None, r[c]) for c in (self.at, *self.order)])  # nulls last
        found = self.count.get()
        n = 0 if found is None else found[0]
        if found is None:
            self.handle.registerTimer(end)
        self.count.update((n + len(rows),))
        own = dict(zip(self.keys, key))
        for i, r in enumerate(rows, n + 1):
            yield Row(**{c: own[c] if c in own else r[c] for c in self.columns}, n=i, over_limit=i > self.limit)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.count.clear()
        return iter(())

    def close(self) -> None:
        pass
