"""Structured Streaming over track rows: an addition, as batch plans cover everything else."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "`group` string, sequence string, id long, frame long, speed double"
_STATE = "frame long, X double, Y double"


def live_speed(stream: DataFrame, fps: float) -> DataFrame:
    """The speed of each row from the row before it of the same individual, as rows arrive in order of frames. The
    state is one position per individual; rows that are older than it are dropped."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        for batch in rows:
            for frame, x, y in batch.sort_values("frame")[["frame", "X", "Y"]].itertuples(index=False):
                if last is not None and frame <= last[0]:
                    continue
                speed = None if last is None else ((x - last[1]) ** 2 + (y - last[2]) ** 2) ** 0.5 * fps / (frame - last[0])
                out.append((*key, int(frame), speed))
                last = (int(frame), float(x), float(y))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["group", "sequence", "id", "frame", "speed"])

    rows = stream.select("group", "sequence", "id", "frame", "X", "Y")
    return rows.groupBy("group", "sequence", "id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def live_counts(stream: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Rows and individuals per tumbling window of event time; rows later than `late` are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "group").agg(F.count("*").alias("rows"), F.approx_count_distinct("id").alias("individuals"))
