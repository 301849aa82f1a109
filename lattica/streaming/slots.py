"""Requests that are shared, superseded and cancelled; what is loaded and what can be reused."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Resolution:
    """idle, loading (with what was there before), ready or failed."""

    state: str = "idle"
    value: Any = None
    error: Exception | None = None

    @property
    def usable(self) -> bool:
        return self.value is not None

    @property
    def blocking(self) -> bool:
        return self.state == "loading" and self.value is None

    def unwrap(self) -> Any:
        """The value; of a failed resolution its error is raised, of one without a value a LookupError."""
        if self.error is not None:
            raise self.error
        if self.value is None:
            raise LookupError(f"there is no value: {self.state}")
        return self.value

    def unwrap_or(self, other: Any) -> Any:
        return other if self.value is None or self.error is not None else self.value

    def map(self, f: Callable[[Any], Any]) -> Resolution:
        return self if self.value is None else Resolution(self.state, f(self.value), self.error)


def classify(e: Exception) -> tuple[str, bool]:
    """(kind, may be tried again) of an error."""
    kinds = ((FileNotFoundError, "missing", False), (TimeoutError, "timeout", True), (ConnectionError, "network", True), (PermissionError, "denied", False), (KeyError, "missing", False), (ValueError, "format", False), (TypeError, "format", False))
    for kind, name, again in kinds:
        if isinstance(e, kind):
            return name, again
    return "unknown", True


class Slot:
    """One resource: a request of the same key is shared, one of another key supersedes it.

    While a request runs the last value stays. A superseded request's result and progress are
    dropped, and its Spark jobs are interrupted by tag; a cancellation leaves what was there.
    """

    def __init__(self, spark: SparkSession | None = None, changed: Callable[[Resolution], None] | None = None):
        self.spark, self.changed = spark, changed
        self.key: Any = None
        self.now = Resolution()
        self._run = 0
        self._tag: str | None = None
        self._work: Callable | None = None
        self._lock = threading.RLock()

    def _set(self, r: Resolution) -> None:
        self.now = r
        if self.changed:
            self.changed(r)

    def request(self, key: Any, work: Callable[[Callable[[Any], None]], Any]) -> Resolution:
        """Run ``work(progress)`` unless the same key is loading or ready."""
        with self._lock:
            if key == self.key and self.now.state in ("loading", "ready"):
                return self.now
            before = (self.key, self.now)
            self._interrupt()
            self._run += 1
            run, self.key, self._work = self._run, key, work
            self._tag = f"lattica-{uuid.uuid4().hex}"
            tag = self._tag
            self._set(Resolution("loading", self.now.value))

        def progress(value: Any) -> None:
            with self._lock:
                if run == self._run and self.now.state == "loading":
                    self._set(Resolution("loading", value))

        try:
            if self.spark:
                self.spark.addTag(tag)
            value = work(progress)
        except InterruptedError:
            with self._lock:
                if run == self._run:
                    self.key = before[0]
                    self._set(before[1])
            return self.now
        except Exception as e:
            with self._lock:
                if run == self._run:
                    self._set(Resolution("failed", self.now.value, e))
            return self.now
        finally:
            if self.spark:
                self.spark.removeTag(tag)
        with self._lock:
            if run == self._run:
                self._set(Resolution("ready", value))
            return self.now

    def retry(self) -> Resolution:
        if self.now.state != "failed" or self._work is None:
            return self.now
        key, self.key = self.key, None
        return self.request(key, self._work)

    def cancel(self) -> None:
        with self._lock:
            self._interrupt()
            self._run += 1
            self.key = None
            if self.now.state == "loading":
                self._set(Resolution("ready", self.now.value) if self.now.usable else Resolution())

    def _interrupt(self) -> None:
        if self.spark and self._tag and self.now.state == "loading":
            self.spark.interruptTag(self._tag)


def adequate(truncated: bool, rows: int, cap: int) -> bool:
    """A whole batch is always enough, a cut one if it reaches the cap."""
    return not truncated or rows >= cap


@dataclass
class Held:
    codes: frozenset[int] | None  # None: everything
    rows: int
    truncated: bool


@dataclass
class Planner:
    """Which loads a selection needs, given what is held and what is on its way."""

    held: Held | None = None
    pending: tuple[frozenset[int], int] | None = None
    log: list[str] = field(default_factory=list)

    def plan(self, codes: Sequence[int] | None, cap: int) -> str:
        """reuse, wait, or scan."""
        if codes is None:
            return "reuse" if self.held and self.held.codes is None and adequate(self.held.truncated, self.held.rows, cap) else "scan"
        want = frozenset(codes)
        if self.held and (self.held.codes is None or want <= self.held.codes) and adequate(self.held.truncated, self.held.rows, cap):
            return "reuse"
        if self.pending and want <= self.pending[0] and self.pending[1] == cap:
            return "wait"
        return "scan"


class Registry:
    """Resolvers by kind of entry, with snapshots kept by (entry, version, settings)."""

    def __init__(self):
        self.resolvers: dict[str, Callable[[dict], Any]] = {}
        self._kept: dict[str, tuple[Any, Any]] = {}

    def add(self, kind: str, resolver: Callable[[dict], Any]) -> None:
        self.resolvers[kind] = resolver

    def snapshot(self, entry: dict) -> Any:
        mark = (entry.get("version"), repr(sorted(entry.items(), key=lambda x: x[0])))
        kept = self._kept.get(entry["id"])
        if kept and kept[0] == mark:
            return kept[1]
        value = self.resolvers[entry["kind"]](entry)
        self._kept[entry["id"]] = (mark, value)
        return value

    def evict(self, ids: Sequence[str]) -> None:
        for i in ids:
            self._kept.pop(i, None)


class ShapesResolver:
    """Geometry, tooltips and fill colours of a shapes element, each in a slot of its own.

    A resource is asked for again only when its key changes; a cancelled or failed request leaves
    what was there before.
    """

    RESOURCES = ("geometry", "tooltip", "fill")

    def __init__(self, spark: SparkSession | None = None):
        self.slots = {r: Slot(spark) for r in self.RESOURCES}

    def wanted(self, entry: dict) -> dict[str, Any]:
        """The key of each resource that an entry needs now."""
        keys = {"geometry": (entry["element"], entry.get("version"))}
        if entry.get("tooltip"):
            keys["tooltip"] = (entry["element"], entry["table"], tuple(entry["tooltip"]))
        if entry.get("fill"):
            keys["fill"] = (entry["element"], entry["table"], entry["fill"])
        return keys

    def resolve(self, entry: dict, loaders: dict[str, Callable]) -> dict[str, Resolution]:
        for r, key in self.wanted(entry).items():
            self.slots[r].request(key, loaders[r])
        return self.snapshot(entry)

    def snapshot(self, entry: dict) -> dict[str, Resolution]:
        return {r: self.slots[r].now for r in self.wanted(entry)}


class RasterResolver:
    """Levels, channels and statistics of images, or of labels: a loader's outcome by element and version."""

    def __init__(self, load: Callable[[str], Any], channels: Callable[[Any], Any], spark: SparkSession | None = None):
        self.load, self.channels, self.spark = load, channels, spark
        self.slots: dict[str, Slot] = {}

    def resolve(self, entry: dict) -> Resolution:
        slot = self.slots.setdefault(entry["id"], Slot(self.spark))

        def work(*_):
            levels = self.load(entry["element"])
            return {"levels": levels, "channels": self.channels(levels)}

        slot.request((entry["element"], entry.get("version")), work)
        return slot.now

    def evict(self, ids: Sequence[str]) -> None:
        for i in ids:
            self.slots.pop(i, None)
