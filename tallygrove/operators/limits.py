"""Rate limits anchored at a key's first event, over tables of events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_window(events: DataFrame, key: str, at: str, tie: str, limit: int, seconds: float) -> DataFrame:
    """events with `allowed`. A window opens with the event that finds none open and ends so many seconds after it; denied
    events count but don't extend it.

    Events are streamed in order through each key's state, which is a window's begin and count: a partition holds whole keys in
    time order, so no key's events are gathered.
    """
    picked = events.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))
    dealt = picked.repartition(key).sortWithinPartitions(key, "_us", tie)
    width = int(seconds * 1_000_000)

    def work(frames):
        now, start, count = object(), 0, 0
        for frame in frames:
            allowed = []
            # pandas reads a null number as NaN, which differs from itself; null is one key like any other.
            names = frame[key].astype(object).where(frame[key].notna(), None)
            for name, time in zip(names, frame["_us"]):
                if name != now or time >= start + width:
                    now, start, count = name, time, 0
                count += 1
                allowed.append(count <= limit)
            yield frame.drop(columns="_us").assign(allowed=pd.Series(allowed, index=frame.index, dtype=bool))

    out = events.select("*", F.lit(True).alias("allowed")).schema
    return dealt.mapInPandas(work, out)


def cooldown(events: DataFrame, key: str, at: str, tie: str, seconds: float) -> DataFrame:
    """The first caller wins for so many seconds."""
    return fixed_window(events, key, at, tie, 1, seconds)
