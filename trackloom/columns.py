"""Names and roles of the columns of a track table: one row per group, sequence, frame and individual."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP, SEQUENCE, FRAME, TIME, ID = "group", "sequence", "frame", "time", "id"
X, Y, ANGLE = "X", "Y", "ANGLE"
ENTRY = [GROUP, SEQUENCE]
# Columns that are carried along and are no features, columns that rows are aligned by, the ids by the role of
# the individual that they name, and texts that stand for a name that isn't there.
META = {GROUP, SEQUENCE, FRAME, TIME, ID}
NOT_FEATURES = META | {"id1", "id2", "entity_level", "perspective", "fps", "label", "split"}
ALIGN = [FRAME, TIME, ID, "id1", "id2"]
ROLES = {"id": "alone", "id1": "first", "id_a": "first", "id_A": "first", "id2": "second", "id_b": "second", "id_B": "second"}
ABSENT = ("", "nan", "none")


def order_column(columns: list[str]) -> str:
    """`frame` if the table has it, else `time`."""
    for c in (FRAME, TIME):
        if c in columns:
            return c
    raise ValueError("a table needs a frame or a time column to be ordered")


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are features, sorted by name; the schema decides, no data are read."""
    return sorted(f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in NOT_FEATURES)


def ensure_columns(df: DataFrame, required: list[str], hint: str = "") -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}" + (f"; {hint}" if hint else ""))


def pose_pairs(columns: list[str]) -> list[tuple[str, str]]:
    """(poseX*, poseY*) pairs in lexical order of their names, so poseX10 comes before poseX2."""
    numbers = [m[1] for c in columns if (m := re.fullmatch(r"poseX(\d+)", c)) and f"poseY{m[1]}" in columns]
    return [(f"poseX{n}", f"poseY{n}") for n in sorted(numbers)]


def individuals(columns: list[str]) -> int:
    """How many individuals a row of a table speaks of: two where both roles of a pair have an id, else one or none."""
    roles = {ROLES[c] for c in columns if c in ROLES}
    return len(roles - {"alone"}) // 2 * 2 or len(roles & {"alone"})


def entry_key(group: str | None, sequence: str) -> str:
    """The name of an entry for files: both parts trimmed and percent-encoded, joined by two underscores; a sequence
    of a blank group goes by its own name."""
    for part in (group or "", sequence):
        if re.search(r"[/\\\0]", part):
            raise ValueError(f"{part!r} holds a slash, a backslash or a NUL")
    parts = [quote(part.strip(), safe="") for part in (group or "", sequence)]
    return "__".join(parts if parts[0] else parts[1:])


def parse_entry_key(key: str) -> tuple[str, str]:
    """The group, empty if the key has one part only, and the sequence; a sequence may hold two underscores itself."""
    *group, sequence = (unquote(part) for part in key.split("__", 1))
    return "".join(group), sequence


def level_names(name: Column, names: list[str], separator: str = "__") -> list[Column]:
    """The parts of a hierarchical name as columns; a part that is missing is null."""
    parts = F.split(name, re.escape(separator))
    return [F.get(parts, i).alias(n) for i, n in enumerate(names)]


def absent_text(name: Column) -> Column:
    """Text in which null, blanks, `nan` and `none` in any case are the empty string."""
    return F.when(name.isNull() | F.lower(F.trim(name)).isin(*ABSENT), "").otherwise(name)
