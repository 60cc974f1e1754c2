"""Station readings as they arrive.  Every operator holds state for ``delay`` of event time, and rows behind that are late and dropped."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR_US = 3_600_000_000


def daily_maximum(stream: DataFrame, keys: Sequence[str], time: str, value: str, delay: str = "1 day") -> DataFrame:
    """(keys, day, value): the largest value of each day, handed on once the watermark has passed the day's end.

    Days are those of UTC.  Rows without a time are left out; a day of null values has a null maximum.
    """
    day = F.window(time, "1 day").alias("_day")
    daily = stream.withWatermark(time, delay).groupBy(*keys, day).agg(F.max(value).alias(value))
    return daily.select(*keys, F.to_date("_day.start").alias("day"), value)


def first_of_each(stream: DataFrame, keys: Sequence[str], time: str, delay: str = "1 day") -> DataFrame:
    """Each key's row once, however often its file is delivered.

    A copy that comes within the delay meets its key in the state; a later one is behind the watermark.  Copies must carry the
    time of the first.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def fix_hourly_spikes(
    stream: DataFrame, keys: Sequence[str], time: str, value: str, high: float = 40.0, low: float = 20.0, delay: str = "3 hours"
) -> DataFrame:
    """(keys, time, value): a value >= high whose exact previous and next hour are both < low becomes their mean.

    A reading waits until the watermark has passed its next hour, and stays one hour more as the previous one of the next.
    A key's state are the readings of the delay and two hours.  Of several readings of one key and time the first that arrives
    counts, and it alone is handed on.
    """
    keys = list(keys)
    rows = stream.withWatermark(time, delay).select(*keys, time, F.unix_micros(time).alias("_us"), F.col(value).cast("double").alias("_v"))
    types = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values, waiting = state.get if state.exists else ([], [], [])
        held = {t: (v, w) for t, v, w in zip(times, values, waiting, strict=True)}
        if not state.hasTimedOut:
            for batch in batches:
                for t, v in zip(batch["_us"].tolist(), batch["_v"].tolist(), strict=True):
                    held.setdefault(t, (v, True))
        now = state.getCurrentWatermarkMs() * 1000
        ready = sorted(t for t, (_, waits) in held.items() if waits and t + HOUR_US <= now)
        out = []
        for t in ready:
            v = held[t][0]
            near = [held[s][0] for s in (t - HOUR_US, t + HOUR_US) if s in held]
            spike = v is not None and v >= high and len(near) == 2 and all(x is not None and x < low for x in near)
            out.append((t, sum(near) / 2 if spike else v))
        done = set(ready)
        held = {t: (v, waits and t not in done) for t, (v, waits) in held.items() if t + 2 * HOUR_US > now}
        if held:
            order = sorted(held)
            state.update((order, [held[t][0] for t in order], [held[t][1] for t in order]))
            due = min(t + (HOUR_US if held[t][1] else 2 * HOUR_US) for t in order)
            state.setTimeoutTimestamp(max(due, now + 1000) // 1000)
        elif state.exists:
            state.remove()
        if out:
            frame = pd.DataFrame(out, columns=["_us", "_v"])
            for k, part in reversed(list(zip(keys, key, strict=True))):
                frame.insert(0, k, [part] * len(frame))
            yield frame

    fixed = rows.groupBy(*keys).applyInPandasWithState(
        step,
        f"{types}, _us long, _v double",
        "times array<long>, readings array<double>, waiting array<boolean>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return fixed.select(*keys, F.timestamp_micros("_us").alias(time), F.col("_v").alias(value))
