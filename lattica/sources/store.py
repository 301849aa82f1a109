"""A spatial store: five collections of elements over one hierarchy."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import transforms
from lattica.model import PointColumns, TableKeys
from lattica.operators import associations, catalog, raster
from lattica.sources import wkb, zarr

KINDS = ("images", "points", "labels", "shapes", "tables")
#: Fixed values of the store format: keys of attributes, and the type of annotation tables.
EXTRA_KEY = "spatialdata_attrs"
ENCODING_KEY = "spatialdata-encoding-type"
TABLE_TYPE = "ngff:regions_table"
_log = logging.getLogger(__name__)


class BadElementError(ValueError):
    pass


@dataclass
class Element:
    """An element's place, attributes and coordinate systems."""

    store: Store
    kind: str
    key: str
    attrs: dict

    @property
    def path(self) -> str:
        return f"{self.store.root}/{self.kind}/{self.key}"

    @property
    def _specs(self) -> list[dict]:
        if self.kind in ("images", "labels"):
            root = self.attrs.get("ome", self.attrs)
            return root["multiscales"][0].get("coordinateTransformations", [])
        return self.attrs.get("coordinateTransformations", [])

    def transform(self, system: str) -> np.ndarray:
        return transforms.to_system(self._specs, system)

    def systems(self) -> list[str]:
        return list(transforms.by_output(self._specs)) or ["global"]

    def level_transform(self, level: int, system: str) -> np.ndarray:
        """The data set's own transform first, then the element's."""
        root = self.attrs.get("ome", self.attrs)
        inner = transforms.parse_list(root["multiscales"][0]["datasets"][level].get("coordinateTransformations", []))
        return self.transform(system) @ inner


@dataclass
class Store:
    """Opened by ``Store.open``; a faulty element is reported and left out, the others stay."""

    spark: SparkSession
    root: str
    nodes: dict[str, dict]
    elements: dict[str, dict[str, Element]] = field(default_factory=dict)
    bad: list[tuple[str, str]] = field(default_factory=list)

    @staticmethod
    def open(spark: SparkSession, path: str, selection: Sequence[str] | None = None, on_bad_files: Callable[[str, Exception], None] | None = None) -> Store:
        store = Store(spark, path.rstrip("/"), zarr.nodes(spark, path))
        for kind in selection or KINDS:
            store.elements[kind] = {}
            for p, node in store.nodes.items():
                head, _, key = p.partition("/")
                if head != kind or not key or "/" in key:
                    continue
                try:
                    store._check(kind, node["attrs"])
                    store.elements[kind][key] = Element(store, kind, key, node["attrs"])
                except Exception as e:  # one element's fault is not another's
                    store.bad.append((p, str(e)))
                    on_bad_files(p, e) if on_bad_files else _log.warning("%s: %s", p, e)
        return store

    @staticmethod
    def _check(kind: str, attrs: dict) -> None:
        if kind in ("images", "labels"):
            axes, _ = zarr.labels_and_levels(attrs)
            if not 2 <= len(axes) <= 5:
                raise BadElementError("an image has two to five axes")
        elif kind == "points":
            if not attrs.get("axes"):
                raise BadElementError("points need axes")
        elif kind == "tables" and attrs.get(ENCODING_KEY, TABLE_TYPE) != TABLE_TYPE:
            raise BadElementError("a table must be a regions table")
        if kind != "tables" and kind not in ("images", "labels"):
            transforms.by_output(attrs.get("coordinateTransformations", []))

    def bad_files(self) -> DataFrame:
        return self.spark.createDataFrame(self.bad, "path string, error string")

    def systems(self) -> list[str]:
        """Coordinate systems of all elements, each once, in the order in which they appear."""
        return list(dict.fromkeys(s for k in KINDS if k != "tables" for e in self.elements.get(k, {}).values() for s in e.systems()))

    def available(self, system: str) -> list[tuple[str, str]]:
        return [(k, e.key) for k in KINDS if k != "tables" for e in self.elements.get(k, {}).values() if system in e.systems()]

    def points(self, key: str) -> tuple[DataFrame, PointColumns]:
        e = self.elements["points"][key]
        df = self.spark.read.parquet(f"{e.path}/points.parquet")
        df = df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("row_id"))
        axes = [a["name"] if isinstance(a, dict) else a for a in e.attrs["axes"]]
        extra = e.attrs.get(EXTRA_KEY, e.attrs)
        name = extra.get("feature_key")
        code = catalog.code_column(df.columns, name) if name else None
        return df, PointColumns(axes[0], axes[1], "row_id", axes[2] if len(axes) > 2 else None, name, code, extra.get("instance_key"))

    def shapes(self, key: str) -> DataFrame:
        """The table with ring or centre decoded from its geometry."""
        df = self.spark.read.parquet(f"{self.elements['shapes'][key].path}/shapes.parquet")
        wkb.check_column(df)
        if "radius" in df.columns:
            return df.withColumn("center", wkb.point_xy("geometry"))
        return df.withColumn("ring", wkb.exterior_ring("geometry"))

    def table_keys(self, key: str) -> TableKeys:
        a = self.elements["tables"][key].attrs
        region = a.get("region")
        return TableKeys(tuple([region] if isinstance(region, str) else region or []), a.get("region_key"), a.get("instance_key"))

    def obs_columns(self, key: str) -> list[str]:
        attrs = self.nodes[f"tables/{key}/obs"]["attrs"]
        return [c for c in attrs.get("column-order", []) if c != attrs.get("_index")]

    def obs_kinds(self, key: str) -> dict[str, str | None]:
        return {c: zarr.column_kind(self.nodes[f"tables/{key}/obs/{c}"]) for c in self.obs_columns(key)}

    def obs(self, key: str, columns: Sequence[str]) -> DataFrame:
        """row_index, id and the columns, each read and decoded from its own arrays."""
        base = f"tables/{key}/obs"
        out = zarr.index(self.spark, self.root, self.nodes, base, self.table_keys(key).instance_key)
        for c in columns:
            out = out.join(zarr.column(self.spark, self.root, self.nodes, f"{base}/{c}").withColumnRenamed("value", c), "row_index", "left")
        return out

    def var(self, key: str, alias_column: str | None = None) -> DataFrame:
        """row_index, id of a table's variables, and ``label`` where a column of aliases is given."""
        base = f"tables/{key}/var"
        out = zarr.index(self.spark, self.root, self.nodes, base)
        return out if alias_column is None else zarr.alias(out, zarr.column(self.spark, self.root, self.nodes, f"{base}/{alias_column}"))

    def obsm(self, key: str, name: str, dims: Sequence[int]) -> DataFrame:
        """row_index and the chosen columns of a matrix, from the chunks that hold them."""
        node = self.nodes[f"tables/{key}/obsm/{name}"]
        rows = zarr.numeric(self.spark, self.root, self.nodes, node["path"], {1: (min(dims), max(dims) + 1)})
        return rows.groupBy(F.col("i0").alias("row_index")).agg(*[F.max(F.when(F.col("i1") == d, F.col("value"))).alias(f"dim_{d}") for d in dims])

    def matrix(self, key: str, name: str = "X") -> DataFrame:
        """row, col, value of a table's dense matrix."""
        rows = zarr.numeric(self.spark, self.root, self.nodes, f"tables/{key}/{name}")
        return rows.select(F.col("i0").alias("row"), F.col("i1").alias("col"), "value")

    def level_sizes(self, kind: str, key: str) -> list[dict[str, int]]:
        _, levels = zarr.labels_and_levels(self.elements[kind][key].attrs)
        return [self.sizes(kind, key, i) for i in range(len(levels))]

    def tables_for(self, kind: str, key: str) -> list[str]:
        names = {key, f"{kind}/{key}"}
        return [t for t in self.elements.get("tables", {}) if names & set(self.table_keys(t).regions)]

    def annotation_rows(self, kind: str, key: str, table: str, columns: Sequence[str] = ()) -> DataFrame:
        keys = self.table_keys(table)
        wanted = list(dict.fromkeys([*([keys.region_key] if keys.region_key else []), *columns]))
        return associations.rows_of(self.obs(table, wanted), keys.region_key, associations.accepted_regions(kind, key, keys.regions))

    def raster(self, kind: str, key: str, level: int = 0, only: dict[str, tuple[int, int]] | None = None) -> tuple[DataFrame, list[str]]:
        """Pixels of a level: one column for each axis, and value; of ranges by axis name only the chunks they meet are read."""
        e = self.elements[kind][key]
        axes, levels = zarr.labels_and_levels(e.attrs)
        ranges = None if only is None else {axes.index(a): r for a, r in only.items()}
        df = zarr.cells(self.spark, self.root, self.nodes[f"{kind}/{key}/{levels[level]}"], ranges)
        return df.select(*[F.col(f"i{i}").alias(a) for i, a in enumerate(axes)], "value"), axes

    def sizes(self, kind: str, key: str, level: int = 0) -> dict[str, int]:
        axes, levels = zarr.labels_and_levels(self.elements[kind][key].attrs)
        return dict(zip(axes, self.nodes[f"{kind}/{key}/{levels[level]}"]["shape"], strict=True))

    def plane(self, kind: str, key: str, selection: dict[str, int], level: int = 0) -> DataFrame:
        """The plane of a selection, from its own chunks."""
        raster.check_selection(list(self.sizes(kind, key, level)), selection)
        return self.raster(kind, key, level, {a: (i, i + 1) for a, i in selection.items()})[0]

    def tile(self, kind: str, key: str, tx: int, ty: int, size: int, selection: dict[str, int] | None = None, level: int = 0) -> DataFrame:
        """The pixels of one tile, from the chunks that it meets."""
        sizes = self.sizes(kind, key, level)
        raster.check_selection(list(sizes), selection or {})
        box = raster.tile_box(tx, ty, size, sizes["x"], sizes["y"])
        return self.raster(kind, key, level, {**{a: (i, i + 1) for a, i in (selection or {}).items()}, **box})[0]

    def sub(self, prefix: str) -> Store:
        """The store below a prefix, which nothing can leave."""
        parts = [p for p in prefix.split("/") if p]
        if ".." in parts:
            raise ValueError("a prefix stays below its store")
        return Store.open(self.spark, "/".join([self.root, *parts]))

    def __str__(self) -> str:
        lines = [f"Store {self.root}"]
        for k in KINDS:
            if found := self.elements.get(k):
                lines += [f"  {k}", *(f"    {name}" for name in found)]
        return "\n".join([*lines, f"  systems: {', '.join(self.systems())}"])
