"""Coordinate transforms: 4x4 matrices on the driver, arithmetic on columns."""

from __future__ import annotations

import warnings
from collections import deque
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = "xyz"


class MissingCoordinateSystemError(KeyError):
    def __init__(self, name: str, available: Sequence[str]):
        super().__init__(f"no coordinate system {name!r}; there are {sorted(available)}")
        self.name, self.available = name, list(available)


class SingularTransformError(ValueError):
    pass


def _slots(axes: Sequence[dict | str]) -> list[int | None]:
    """The row of x, y, z for each axis: by name, else spatial axes take the free rows in order."""
    named = [a if isinstance(a, dict) else {"name": a, "type": "space"} for a in axes]
    out = [AXES.index(a["name"]) if a["name"] in AXES and a.get("type", "space") == "space" else None for a in named]
    free = iter([i for i in range(3) if i not in out])
    return [next(free, None) if s is None and a.get("type", "space") == "space" else s for s, a in zip(out, named, strict=True)]


def _default(n: int) -> list[str]:
    return ["x", "y", "z", "w"][:n]


def translation(values: Sequence[float], axes=None) -> np.ndarray:
    m = np.eye(4)
    for v, s in zip(values, _slots(axes or _default(len(values))), strict=True):
        if s is not None:
            m[s, 3] = v
    return m


def scale(values: Sequence[float], axes=None) -> np.ndarray:
    m = np.eye(4)
    for v, s in zip(values, _slots(axes or _default(len(values))), strict=True):
        if s is not None:
            m[s, s] = v
    return m


def affine(rows: Sequence[Sequence[float]], in_axes=None, out_axes=None) -> np.ndarray:
    """An affine matrix with or without its homogeneous row, on the given axes (x, y[, z] at first)."""
    a = np.array(rows, float)
    n_in = a.shape[1] - 1
    if a.shape[0] == a.shape[1]:
        if not np.allclose(a[-1], np.eye(a.shape[1])[-1]):
            warnings.warn("the last row of an affine matrix isn't 0, ..., 0, 1", stacklevel=2)
        a = a[:-1]
    if in_axes is None and (n_in not in (2, 3) or a.shape[0] != n_in):
        warnings.warn(f"an affine matrix of shape {a.shape} isn't known; identity taken", stacklevel=2)
        return np.eye(4)
    cols, targets = _slots(in_axes or _default(n_in)), _slots(out_axes or in_axes or _default(a.shape[0]))
    m = np.eye(4)
    for row, t in zip(a, targets, strict=True):
        if t is None:
            continue
        m[t, :3] = 0
        for v, c in zip(row[:-1], cols, strict=True):
            if c is not None:
                m[t, c] = v
        m[t, 3] = row[-1]
    return m


def rotation(rows: Sequence[Sequence[float]], axes=None) -> np.ndarray:
    r = np.array(rows, float)
    if r.ndim != 2 or r.shape[0] != r.shape[1]:
        raise ValueError("a rotation is a square matrix")
    return affine(np.c_[r, np.zeros(len(r))], axes or _default(len(r)), axes or _default(len(r)))


def map_axis(order: Sequence[int]) -> np.ndarray:
    """Output axis i is input axis order[i]."""
    if sorted(order) != list(range(len(order))):
        raise ValueError("an axis map is a permutation")
    m = np.eye(4)
    m[: len(order), : len(order)] = np.eye(len(order))[list(order)]
    return m


def sequence(steps: Sequence[np.ndarray]) -> np.ndarray:
    """Steps in the order in which they are applied."""
    m = np.eye(4)
    for s in steps:
        m = s @ m
    return m


def parse(spec: dict) -> np.ndarray:
    kind = spec.get("type")
    in_axes = spec.get("input", {}).get("axes")
    out_axes = spec.get("output", {}).get("axes")
    match kind:
        case "identity":
            return np.eye(4)
        case "translation":
            return translation(spec["translation"], in_axes)
        case "scale":
            return scale(spec["scale"], in_axes)
        case "affine":
            return affine(spec["affine"], in_axes, out_axes)
        case "rotation":
            return rotation(spec["rotation"], in_axes)
        case "mapAxis":
            return map_axis(spec["mapAxis"])
        case "sequence":
            return parse_list(spec["transformations"])
    warnings.warn(f"transformation of type {kind!r} isn't known; identity taken", stacklevel=2)
    return np.eye(4)


def parse_list(specs: Sequence[dict]) -> np.ndarray:
    return sequence([parse(s) for s in specs])


def by_output(specs: Sequence[dict]) -> dict[str, np.ndarray]:
    """Transforms grouped by the name of their output system, each group in order."""
    groups: dict[str, list[dict]] = {}
    for s in specs:
        groups.setdefault(s.get("output", {}).get("name", "global"), []).append(s)
    return {k: parse_list(v) for k, v in groups.items()}


def to_system(specs: Sequence[dict], name: str) -> np.ndarray:
    every = by_output(specs)
    if name not in every:
        raise MissingCoordinateSystemError(name, list(every))
    return every[name]


def inverse(m: np.ndarray) -> np.ndarray:
    d = np.linalg.det(m)
    if not np.isfinite(d) or abs(d) < 1e-12:
        raise SingularTransformError("the transform has no inverse")
    return np.linalg.inv(m)


def uniform_scale(m: np.ndarray) -> float:
    return float(np.sqrt(np.linalg.norm(m[:3, 0]) * np.linalg.norm(m[:3, 1])))


def path(edges: Sequence[tuple[str, str, np.ndarray]], source: str, target: str) -> np.ndarray:
    """The transform between two systems along the fewest edges, taken either way."""
    seen, todo = {source: np.eye(4)}, deque([source])
    while todo:
        at = todo.popleft()
        if at == target:
            return seen[at]
        for a, b, m in edges:
            for u, v, step in ((a, b, lambda m=m: m), (b, a, lambda m=m: inverse(m))):
                if u == at and v not in seen:
                    seen[v] = step() @ seen[at]
                    todo.append(v)
    raise MissingCoordinateSystemError(target, list(seen))


def apply(m: np.ndarray | None, x: Column, y: Column, z: Column | None = None) -> tuple[Column, ...]:
    """Column arithmetic of a matrix; terms with coefficient 0 are left out."""
    if m is None:
        return (x, y) if z is None else (x, y, z)
    out = []
    for row in range(2 if z is None else 3):
        terms = [F.lit(float(m[row, k])) * v for k, v in enumerate((x, y, z)) if v is not None and m[row, k] != 0]
        total = F.lit(float(m[row, 3]))
        for t in terms:
            total = total + t
        out.append(total)
    return tuple(out)
