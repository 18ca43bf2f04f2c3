"""Named, open schemas of track tables, checked against column names only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class TrackSchema:
    """Columns that a table must, should and must not have; other columns are welcome."""

    name: str
    required: frozenset[str] = frozenset()
    prefixes: frozenset[str] = frozenset()
    recommended: frozenset[str] = frozenset()
    forbidden: frozenset[str] = frozenset()
    extends: str | None = None
    allows: frozenset[str] = frozenset()
    family: str = ""


@dataclass
class Report:
    missing: list[str] = field(default_factory=list)
    recommended: list[str] = field(default_factory=list)


_SCHEMAS: dict[str, TrackSchema] = {}


def register(schema: TrackSchema) -> TrackSchema:
    """A schema that extends another has all of its rules, but may allow what that forbids."""
    if schema.extends:
        up = get(schema.extends)
        schema = TrackSchema(schema.name, up.required | schema.required, up.prefixes | schema.prefixes, up.recommended | schema.recommended, (up.forbidden | schema.forbidden) - schema.allows, schema.extends, schema.allows, schema.family or up.family)
    _SCHEMAS[schema.name] = schema
    return schema


def get(name: str) -> TrackSchema:
    if name not in _SCHEMAS:
        raise KeyError(f"unknown track schema {name!r}; there are {sorted(_SCHEMAS)}")
    return _SCHEMAS[name]


def validate(df: DataFrame, name: str, strict: bool = False) -> Report:
    """Forbidden columns always fail; missing ones only if strict, else they are reported."""
    schema, have = get(name), set(df.columns)
    if bad := sorted(schema.forbidden & have):
        raise ValueError(f"{name} forbids {bad}")
    missing = sorted(schema.required - have) + sorted(f"{p}*" for p in schema.prefixes if not any(c.startswith(p) for c in have))
    if strict and missing:
        raise ValueError(f"{name} requires {missing}")
    return Report(missing, sorted(schema.recommended - have))


def same_family(names: list[str]) -> str:
    families = {get(n).family or n for n in names}
    if len(families) > 1:
        raise ValueError(f"one scope mixes schema families {sorted(families)}")
    return families.pop()


_KEYS = frozenset({"frame", "time", "id", "group", "sequence"})
_POSE = frozenset({"poseX", "poseY"})
_DERIVED = frozenset({"SPEED", "VX", "VY", "AX", "AY", "ACCELERATION", "ANGULAR_V", "ANGULAR_A", "BORDER_DISTANCE", "NEIGHBOR_DISTANCE", "MIDLINE_OFFSET"})

TREX_V1 = register(TrackSchema("trex_v1", _KEYS, _POSE, frozenset({"X", "Y", "ANGLE"}), family="trex"))
BODY_V1 = register(TrackSchema("body_v1", _KEYS | {"X", "Y"}, _POSE, frozenset({"ANGLE"}), _DERIVED, family="body"))
BODY_V2 = register(TrackSchema("body_v2", extends="body_v1", allows=_DERIVED))
