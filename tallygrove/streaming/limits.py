"""The anchored fixed window over a stream of events, with the state of a key dropped when its window ends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fixed_window(events: DataFrame, key: str, at: str, tie: str, limit: int, seconds: float, lateness: str = "0 seconds") -> DataFrame:
    """events (a stream) as key, tie, us, allowed. Events of one micro-batch are taken in time order; one that comes after a
    later one's batch is judged against the window then open."""
    width = int(seconds * 1_000_000)

    def step(name, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        rows = pd.concat(frames).sort_values(["us", tie])
        allowed = []
        for time in rows["us"]:
            if start is None or time >= start + width:
                start, count = int(time), 0
            count += 1
            allowed.append(count <= limit)
        state.update((start, count))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (start + width) // 1000 + 1))
        yield pd.DataFrame({key: rows[key], tie: rows[tie], "us": rows["us"], "allowed": allowed})

    stream = events.select(F.col(key), F.col(tie), F.col(at).cast("timestamp").alias("_at"), F.unix_micros(F.col(at).cast("timestamp")).alias("us")).withWatermark("_at", lateness)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    out = f"{key} {kinds[key]}, {tie} {kinds[tie]}, us long, allowed boolean"
    return stream.groupBy(key).applyInPandasWithState(step, out, "start long, count long", "append", GroupStateTimeout.EventTimeTimeout)


def ingest(stream: DataFrame, arrival: str, stored, append) -> object:
    """A stream of staged postings into a store: `stored()` gives what there is, `append(df)` adds; one batch at a time."""
    from ..operators import ingest as I

    def batch(df: DataFrame, number: int) -> None:
        append(I.insert_if_absent(df, stored(), arrival))

    return stream.writeStream.foreachBatch(batch)
