"""Event-time windows and stateful episodes on streams; the same functions serve batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, delay: str) -> DataFrame:
    return events.withWatermark("ts", delay) if events.isStreaming else events


def tumbling(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Count and sum per event type and window; late rows beyond the watermark are dropped on streams."""
    return _counts(_late(events, delay).groupBy(F.window("ts", size), "event_type"))


def sliding(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    return _counts(_late(events, delay).groupBy(F.window("ts", size, step), "event_type"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of each user: start, end (last event plus gap), events."""
    grouped = _late(events, delay).groupBy(F.session_window("ts", gap).alias("window"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select("user_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "events", "total")


def _counts(grouped) -> DataFrame:
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


EPISODE = "run_id long, steps long, total double, best double, stuck boolean"
_STATE = "steps long, total double, best double, tool string, same int"


def episodes(steps: DataFrame, stuck_after: int = 3) -> DataFrame:
    """Running episode summary per run of a stream (run_id, step, tool, reward): steps, summed and best
    reward, and whether the last `stuck_after` calls were of one tool. State is five numbers a run."""

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total, best, tool, same = state.get if state.exists else (0, 0.0, float("-inf"), "", 0)
        rows = pd.concat(list(batches)).sort_values("step")
        for t, r in zip(rows["tool"], rows["reward"], strict=True):
            n += 1
            if r == r and r is not None:
                total, best = total + r, max(best, r)
            if isinstance(t, str):
                same, tool = (same + 1, tool) if t == tool else (1, t)
        state.update((n, total, best, tool, same))
        yield pd.DataFrame({"run_id": [key[0]], "steps": [n], "total": [total], "best": [best if best > float("-inf") else None], "stuck": [same >= stuck_after]})

    return steps.groupBy("run_id").applyInPandasWithState(update, EPISODE, _STATE, "update", "NoTimeout")
