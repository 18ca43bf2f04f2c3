"""Single columns of several tables side by side, aligned by row keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import ALIGN, ENTRY, FRAME
from ..joins import align
from ..operators.kinematics import frame_range, time_range
from .scope import in_scope


@dataclass
class Values:
    """A column of a table of tracks or features."""

    table: DataFrame
    column: str


@dataclass
class Labels:
    """Events `table(group, sequence, frame, label)`, a label for each frame, named `labels-<kind>`; 0 where a frame has none.

    Of several events of a frame the last counts, in the order of column `event` if there is one, else of the rows' ids
    and labels. Events of pairs have id1 and id2; those with id1 > id2 are taken for repeats of the other order unless
    `symmetric` is false.
    """

    table: DataFrame
    kind: str
    symmetric: bool = True

    def per_frame(self, on: list[str]) -> DataFrame:
        pair = {"id1", "id2"} <= set(self.table.columns)
        events = self.table.where("id1 <= id2") if pair and self.symmetric else self.table
        order = F.struct(*[c for c in ("event", "id1", "id2", "label") if c in self.table.columns])
        return events.groupBy(*on).agg(F.max_by("label", order).alias("_label"))


def column_names(names: list[str]) -> list[str]:
    """The first column of a name keeps it, those that follow get -1, -2 and so on."""
    return [n if not (before := names[:i].count(n)) else f"{n}-{before}" for i, n in enumerate(names)]


def load_values(sources: list[Values | Labels], groups=None, sequences=None, entries=None, fps: float | None = None, start_frame=None, end_frame=None, start_time=None, end_time=None) -> DataFrame:
    """The keys of the rows that all tables share, and one column for each source. At least one source is a `Values`.

    A table that several sources name is joined once. The selection of entries and the range of frames, given in frames or
    seconds, reach every table's scan.
    """
    values = [s for s in sources if isinstance(s, Values)]
    if not values:
        raise ValueError("load_values needs at least one column of a table of tracks or features")
    start, end = frame_range(fps, start_frame, end_frame, start_time, end_time)
    names = column_names([s.column if isinstance(s, Values) else f"labels-{s.kind}" for s in sources])
    tables: list[tuple[DataFrame, list[tuple[str, str]]]] = []
    for s, name in zip(sources, names):
        if isinstance(s, Values):
            own = next((t for t in tables if t[0] is s.table), None)
            if own is None:
                tables.append(own := (s.table, []))
            own[1].append((s.column, name))
    parts = []
    for table, wanted in tables:
        chosen = time_range(in_scope(table, groups, sequences, entries), start, end)
        keys = [c for c in (*ENTRY, *ALIGN) if c in chosen.columns]
        parts.append(chosen.select(*keys, *[F.col(f"`{c}`").alias(n) for c, n in wanted]))
    out = align(parts, check=False)
    for s, name in zip(sources, names):
        if isinstance(s, Labels):
            on = [c for c in (*ENTRY, FRAME) if c in out.columns and c in s.table.columns]
            out = out.join(s.per_frame(on), on, "left").withColumn(name, F.coalesce("_label", F.lit(0))).drop("_label")
    keys = [c for c in (*ENTRY, *ALIGN) if c in out.columns]
    return out.select(*keys, *[F.col(f"`{n}`") for n in names])
