"""Streaming forms of gap segmentation and of windows that restart after gaps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_segments(events: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Sessions (keys, start, end, n) of a stream: a row exactly ``gap`` after the last starts a new one.

    Rows later than the watermark are dropped; a session is given out once the watermark has passed its end.
    """
    rows = events.withWatermark(ts, late)
    out = rows.groupBy(*keys, F.session_window(ts, gap).alias("_w")).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))
    return out.drop("_w")


def strided_stream(samples: DataFrame, key: str, t: str, ord: str, gap: float, length: int, stride: int) -> DataFrame:
    """Windows (key, t0, t1) of a stream of samples that come in order of time within a key, as the batch operator finds them.

    The state of a key is the times of its unfinished window, ``length`` + ``stride`` at most, so it doesn't grow with the
    stream. Samples older than the last one seen are dropped.
    """
    if not 0 < stride <= length:
        raise ValueError("the stride must lie in 1..length")
    kind = dict(samples.dtypes)

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: list[float] = list(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(batches)).sort_values([t, ord])
        for now in rows[t].tolist():
            if held and now < held[-1]:
                continue
            if held and now - held[-1] > gap:
                held = []
            held.append(now)
            if len(held) == length:
                out.append((group[0], held[0], held[-1]))
                held = held[stride:]
        state.update((held,))
        yield pd.DataFrame(out, columns=[key, "t0", "t1"])

    return samples.select(key, t, ord).groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, t0 {kind[t]}, t1 {kind[t]}", f"held array<{kind[t]}>", "append", GroupStateTimeout.NoTimeout)
