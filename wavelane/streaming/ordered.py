"""Gap segmentation and windows over streams whose rows come in any order up to the watermark.

A key's rows wait in its state until the watermark has passed them and are then taken in order of time, so the results are the batch
operators'. One timer a key says when to look again. Once the watermark is more than a gap past a key's last row, no row can go on with its run: the state is
deleted, so it holds keys that are active now, not all that ever were. State tables need the RocksDB provider (:func:`with_state_tables`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MS = 1000


def with_state_tables(spark: SparkSession) -> SparkSession:
    """A session of its own with the same executors, whose streams keep state in RocksDB."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        session.conf.set(name, spark.conf.get(name))
    return session


class InOrder(StatefulProcessor):
    """Rows of a key in order of (t, ord), t in microseconds, once they can't be overtaken; ``gap`` in microseconds ends a run."""

    columns: list[str]

    def __init__(self, t: str, ord: str, gap: int):
        self.t, self.ord, self.gap = t, ord, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, ord long")
        self.run = handle.getValueState("run", "held array<long>")

    def begun(self) -> list[int]:
        """What is held of a run that has no rows yet."""
        return []

    def take(self, held: list[int], now: int) -> tuple[list[int], list[tuple]]:
        """What is held of a run after a row, and the results that the row completes."""
        raise NotImplementedError

    def ended(self, held: list[int]) -> list[tuple]:
        """The results that a run's end completes."""
        return []

    def last(self, held: list[int]) -> int | None:
        return held[-1] if held else None

    def _show(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in out], columns=self.columns)

    def _call_at(self, at: int) -> None:
        """One timer, at a time in microseconds."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(-(-at // MS) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for batch in rows:
            pairs = [(int(a), int(b)) for a, b in zip(batch[self.t], batch[self.ord], strict=True)]
            if pairs:
                self.waiting.appendList(pairs)
                least = min([p[0] for p in pairs] + ([] if least is None else [least]))
        if least is not None:
            timers = [x * MS for x in self.handle.listTimers()]
            self._call_at(min([least, *timers]))
        yield self._show(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * MS
        waiting = sorted((r[0], r[1]) for r in self.waiting.get())
        ready = [p for p in waiting if p[0] <= mark]
        held = list(self.run.get()[0]) if self.run.exists() else self.begun()
        out: list[tuple] = []
        for now, _ in ready:
            before = self.last(held)
            if before is not None and now - before > self.gap:
                out += self.ended(held)
                held = self.begun()
            held, more = self.take(held, now)
            out += more
        later = waiting[len(ready) :]
        if ready:
            self.waiting.clear()
            if later:
                self.waiting.appendList(later)
        before = self.last(held)
        first = min([p[0] for p in later[:1]] + ([] if before is None else [before + self.gap]), default=None)
        if not later and (before is None or mark > before + self.gap):
            if before is not None:
                out += self.ended(held)
            self.waiting.clear()
            self.run.clear()
        else:
            self.run.update((held,))
            self._call_at(max(first, mark + 1))
        yield self._show(key, out)

    def close(self) -> None:
        pass


class Segments(InOrder):
    """(start, end, n) of each run."""

    def take(self, held, now):
        return ([now, 1, now] if not held else [held[0], held[1] + 1, now]), []

    def ended(self, held):
        return [(held[0], held[2], held[1])]


class Strides(InOrder):
    """(t0, t1) of ``length`` rows at every ``stride``-th place of a run; the rows of one unfinished window are held."""

    def __init__(self, t: str, ord: str, gap: int, length: int, stride: int):
        super().__init__(t, ord, gap)
        if not 0 < stride <= length:
            raise ValueError("the stride must lie in 1..length")
        self.length, self.stride = length, stride

    def begun(self):
        return [0]

    def last(self, held):
        return held[-1] if held[0] else None

    def take(self, held, now):
        # First the count of window rows that are held, then their times and at any rate the last row's.
        times = [*(held[-held[0] :] if held[0] > 0 else []), now]
        if len(times) < self.length:
            return [len(times), *times], []
        rest = times[self.stride :]
        return [len(rest) or -1, *(rest or [now])], [(times[0], now)]


def _applied(rows: DataFrame, key: str, ts: str, late: str, processor: InOrder, results: str) -> DataFrame:
    kind = dict(rows.dtypes)[key]
    processor.columns = [key, *(r.split()[0] for r in results.split(", "))]
    return rows.withWatermark(ts, late).groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, {results}", "Append", "EventTime")


def segment_stream(rows: DataFrame, key: str, ts: str, t: str, ord: str, gap: int, late: str) -> DataFrame:
    """Segments (key, start, end, n) of a stream, given out once the watermark is more than ``gap`` past their end. ``ts`` is the event time that
    ``t`` counts in microseconds. Rows later than the watermark are dropped."""
    return _applied(rows, key, ts, late, Segments(t, ord, gap), "start long, end long, n long")


def window_stream(rows: DataFrame, key: str, ts: str, t: str, ord: str, gap: int, length: int, stride: int, late: str) -> DataFrame:
    """Windows (key, t0, t1) of a stream that restart after gaps, given out once the watermark has passed them."""
    return _applied(rows, key, ts, late, Strides(t, ord, gap, length, stride), "t0 long, t1 long")
