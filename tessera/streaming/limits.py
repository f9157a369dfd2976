"""Rate limits over attempts, and over accepted attempts alone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def attempts_in_window(events: DataFrame, seconds: int, key: str = "user_id") -> DataFrame:
    """events with n: the attempts of the key in the last seconds, this one included."""
    at = F.col("ts").cast("timestamp").cast("double")
    over = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds, 0)
    return events.withColumn("n", F.count("*").over(over))


def _accept(times: list[float], held: list[float], most: int, seconds: float) -> tuple[list[bool], list[float]]:
    out = []
    for t in times:
        held = [x for x in held if x > t - seconds]
        out.append(len(held) < most)
        if out[-1]:
            held.append(t)
    return out, held


def accepted(events: DataFrame, most: int, seconds: int, key: str = "user_id") -> DataFrame:
    """(event_id, key, accepted): an attempt counts against later ones only if it was accepted, so each key's
    attempts are taken in order. A stream keeps the times of at most `most` attempts a key."""
    rows = events.select("event_id", key, F.col("ts").cast("timestamp").cast("double").alias("t"))
    schema = f"event_id long, {key} {events.schema[key].dataType.simpleString()}, accepted boolean"
    if not events.isStreaming:
        def fold(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["t", "event_id"])
            return part.assign(accepted=_accept(part["t"].tolist(), [], most, seconds)[0])[["event_id", key, "accepted"]]

        return rows.groupBy(key).applyInPandas(fold, schema)

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(parts)).sort_values(["t", "event_id"])
        held = list(state.get[0]) if state.exists else []
        said, held = _accept(part["t"].tolist(), held, most, seconds)
        state.update((held,))
        yield part.assign(accepted=said)[["event_id", key, "accepted"]]

    return rows.groupBy(key).applyInPandasWithState(step, schema, "held array<double>", "append", GroupStateTimeout.NoTimeout)
