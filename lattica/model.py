"""Small driver-side values that operators take and return."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Bounds:
    """A closed box."""

    min_x: float
    min_y: float
    max_x: float
    max_y: float

    @staticmethod
    def of(x0: float, y0: float, x1: float, y1: float) -> Bounds:
        return Bounds(min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1))

    def union(self, other: Bounds | None) -> Bounds:
        if other is None:
            return self
        return Bounds(min(self.min_x, other.min_x), min(self.min_y, other.min_y), max(self.max_x, other.max_x), max(self.max_y, other.max_y))

    def intersect(self, other: Bounds) -> Bounds | None:
        b = Bounds(max(self.min_x, other.min_x), max(self.min_y, other.min_y), min(self.max_x, other.max_x), min(self.max_y, other.max_y))
        return b if b.min_x <= b.max_x and b.min_y <= b.max_y else None


@dataclass(frozen=True)
class PointColumns:
    """Which columns of a table play which part."""

    x: str
    y: str
    row_id: str
    z: str | None = None
    name: str | None = None
    code: str | None = None
    instance: str | None = None
    morton: str | None = None


@dataclass(frozen=True)
class TableKeys:
    """How an annotation table names what it describes."""

    regions: tuple[str, ...]
    region_key: str | None
    instance_key: str | None


@dataclass
class TilingMeta:
    bounds: Bounds | None
    rows: int
    row_groups: int
    largest_group: int
    rows_by_part: dict[int, int] = field(default_factory=dict)


DEFAULT_CAP = 4_000_000


def resolve_cap(cap: float | None) -> int:
    """A positive finite cap rounded down; else the default."""
    if cap is None or not math.isfinite(cap) or cap <= 0:
        return DEFAULT_CAP
    return math.floor(cap)


def resolve_render_cap(cap: float | None) -> int | None:
    """A positive finite cap rounded down; else no cap."""
    if cap is None or not math.isfinite(cap) or cap <= 0:
        return None
    return math.floor(cap)
