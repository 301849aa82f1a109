"""Driver-side choices: what to load, how to show it, and what was left out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from lattica.model import DEFAULT_CAP, TilingMeta
from lattica.operators.raster import MAX_CHANNELS, PALETTE, clamp_selection_value

WHITE = (255, 255, 255)
RANGE16 = (0.0, 65535.0)


def needs_row_codes(codes: Sequence[int] | None, code_column: str | None, feature_key: str, columns: Sequence[str]) -> bool:
    """A selection can be applied by a code column, or by codes made from the names."""
    return codes is not None and (code_column is not None or feature_key in columns)


def awaits_row_codes(codes: Sequence[int] | None, row_codes: Sequence[int] | None) -> bool:
    return bool(codes) and not row_codes


def encoding(preloaded: bool, tiling: TilingMeta | None, optimised: bool) -> str:
    """Tiles if they are wanted, nothing is loaded yet, and the layout has a box; else the loaded table."""
    return "morton-tiled" if optimised and not preloaded and tiling is not None and tiling.bounds is not None else "preloaded-columnar"


def load_plan(optimised: bool, probed: bool, tiling: TilingMeta | None, preloaded: bool) -> dict[str, bool]:
    """Whether to probe the layout, and whether to load the whole table."""
    return {"probe": optimised and not probed, "preload": not preloaded and (not optimised or (probed and tiling is None))}


def catalog_by_column(rows: int) -> bool:
    """Tables over the default cap get their catalogue from the column, not from loaded rows."""
    return rows > DEFAULT_CAP


def fits_view(auto: bool, layers: bool, width: float, height: float, blocking: bool, has_view: bool) -> bool:
    return auto and layers and width > 0 and height > 0 and not blocking and not has_view


@dataclass(frozen=True)
class Truncation:
    truncated: bool
    loaded: int
    total: int | None = None
    filtered: bool = False


def active_truncation(resident: Truncation | None, matched: Truncation | None, covered: Sequence[int], codes: Sequence[int] | None) -> Truncation | None:
    """That of the scan that covers the selection, else that of the loaded rows."""
    if codes and matched and covered and set(codes) <= set(covered):
        return Truncation(matched.truncated, matched.loaded, filtered=True)
    return resident


def merged_colours(explicit: Mapping, by_column: Mapping | None) -> dict:
    """A feature's own colour wins over its column's; without rows nothing changes."""
    return {**(by_column or {}), **explicit}


@dataclass
class Channels:
    colours: list[tuple] = field(default_factory=list)
    limits: list[tuple] = field(default_factory=list)
    shown: list[bool] = field(default_factory=list)
    selections: list[dict[str, int]] = field(default_factory=list)
    ids: list[str] = field(default_factory=list)


def default_channels(count: int, top: float, selections: Sequence[dict[str, int]], declared: Sequence[Mapping] = (), rgb: bool = False) -> Channels:
    """Declared colours and windows where there are any, else a palette and the type's range."""
    if declared:
        colours = [tuple(int(d["color"].lstrip("#")[k : k + 2], 16) for k in (0, 2, 4)) if d.get("color") else PALETTE[i % len(PALETTE)] for i, d in enumerate(declared)]
        limits = [(d["window"]["start"], d["window"]["end"]) if d.get("window") else (0.0, top) for d in declared]
        return Channels(colours, limits, [d.get("active", True) for d in declared], list(selections))
    if rgb:
        return Channels([(255, 0, 0), (0, 255, 0), (0, 0, 255)], [(0.0, 255.0)] * 3, [True] * 3, list(selections))
    colours = [WHITE] if count == 1 else [PALETTE[i % len(PALETTE)] for i in range(count)]
    return Channels(colours, [(0.0, top)] * count, [True] * count, list(selections))


def merge_channels(stored: Channels, defaults: Channels, layer: str, sizes: Mapping[str, int]) -> Channels:
    """What is stored, else the defaults, as long as the longest of the lists, up to the most channels.

    Selections keep the axes there are, and are held inside them.
    """
    lists = [stored.colours or defaults.colours or [WHITE], stored.limits or defaults.limits or [RANGE16], stored.shown or defaults.shown or [True]]
    base = defaults.selections or [{}]
    rows = [{**(base[i] if i < len(base) else base[0]), **s} for i, s in enumerate(stored.selections)] or [dict(s) for s in base]
    zero = dict.fromkeys(sizes, 0)
    rows = [{a: clamp_selection_value({**zero, **r}[a], n) for a, n in sizes.items()} for r in rows]
    n = min(MAX_CHANNELS, max(1, len(rows), *map(len, lists)))
    fill = lambda v, x: (list(v) + [x] * n)[:n]
    ids = [stored.ids[i] if i < len(stored.ids) else f"{layer}:ch:{i}" for i in range(n)]
    return Channels(fill(lists[0], WHITE), fill(lists[1], RANGE16), fill(lists[2], True), fill(rows, zero), ids)


def label_channels(selections: Sequence[dict[str, int]], top: float) -> Channels:
    """A label image has one channel: white, the type's whole range, shown, at its first selection."""
    return Channels([WHITE], [(0.0, top)], [True], [dict(selections[0])] if selections else [{}])
