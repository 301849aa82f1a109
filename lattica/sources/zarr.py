"""Zarr hierarchies (formats 2 and 3) through Spark's binary file source.

Metadata documents become a relation of nodes; an array's chunks are read and decoded by Arrow
batches, one chunk a row, on any file system that Spark reads; a selection on axes reads the chunks
that it meets alone. Codecs: none, zlib, gzip, zstd, blosc (of lz4, snappy, zlib and zstd, with byte
and bit shuffle), transpose, crc32c and variable-length text; others can be added by
``register_decoder``, and are reported where they are missing, not guessed.
"""

from __future__ import annotations

import gzip
import json
import re
import struct
import zlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "path string, kind string, attrs string, dtype string, shape array<bigint>, chunks array<bigint>, meta string"
#: Fixed names of element types by format-2 type code.
V2_TYPES = {"b1": "bool", "i1": "int8", "i2": "int16", "i4": "int32", "i8": "int64", "u1": "uint8", "u2": "uint16", "u4": "uint32", "u8": "uint64", "f2": "float16", "f4": "float32", "f8": "float64"}
NUMBERS = frozenset(V2_TYPES.values())
WHOLE = NUMBERS - {"bool", "uint64", "float16", "float32", "float64"}


class UnsupportedCodecError(ValueError):
    pass


#: Decoders by the codec's id: (encoded bytes, the codec's settings) -> bytes.
DECODERS: dict[str, Callable[[bytes, dict], bytes]] = {}


def register_decoder(ids: str | Sequence[str], decoder: Callable[[bytes, dict], bytes]) -> None:
    """Decode chunks of a codec by a function, which goes to the executors with the scan."""
    for i in [ids] if isinstance(ids, str) else ids:
        DECODERS[i] = decoder


def _zstd(data: bytes, _: dict) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


register_decoder("zlib", lambda data, _: zlib.decompress(data))
register_decoder("gzip", lambda data, _: gzip.decompress(data))
register_decoder("zstd", _zstd)
register_decoder("crc32c", lambda data, _: data[:-4])


#: Fixed numbers of the blosc container: inner codecs, and the rule by which a block has one stream a byte.
BLOSC_CODECS = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}
BLOSC_NAMES = frozenset(("lz4", "lz4hc", "snappy", "zlib", "zstd"))
_SPLIT_MOST, _SPLIT_LEAST = 16, 128


def blosc(data: bytes, _: dict) -> bytes:
    """The content of a blosc container: a header, offsets of blocks, and blocks of one or more streams."""
    _, _, flags, width, size, block, _ = struct.unpack_from("<BBBBIII", data)
    if flags & 2:
        return data[16 : 16 + size]
    inner = BLOSC_CODECS.get(flags >> 5)
    if inner is None:
        raise UnsupportedCodecError("no decoder for blosclz")

    def stream(body: bytes, n: int) -> bytes:
        if len(body) == n:
            return body
        if inner == "zlib":
            return zlib.decompress(body)
        return _zstd(body, {}) if inner == "zstd" else pa.Codec(inner).decompress(body, n).to_pybytes()

    out = []
    for k, (at,) in enumerate(struct.iter_unpack("<I", data[16 : 16 + 4 * -(-size // block)])):
        n = min(block, size - k * block)
        whole = n == block
        parts = width if whole and not flags & 16 and width <= _SPLIT_MOST and block // width >= _SPLIT_LEAST else 1
        piece = b""
        for _part in range(parts):
            (length,) = struct.unpack_from("<i", data, at)
            piece += stream(data[at + 4 : at + 4 + length], n // parts)
            at += 4 + length
        if flags & 1 and width > 1:
            piece = _unshuffled(piece, width)
        elif flags & 4:
            piece = _bit_unshuffled(piece, width)
        out.append(piece)
    return b"".join(out)


def _unshuffled(piece: bytes, width: int) -> bytes:
    n = len(piece) // width * width
    return np.frombuffer(piece[:n], np.uint8).reshape(width, -1).T.tobytes() + piece[n:]


def _bit_unshuffled(piece: bytes, width: int) -> bytes:
    n = len(piece) // (8 * width) * 8 * width
    rows = np.frombuffer(piece[:n], np.uint8).reshape(8 * width, -1)
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + piece[n:]


register_decoder("blosc", blosc)


def normal_dtype(dtype: object) -> str | None:
    """The common name of an element type; text of any form is 'string'; unknown ones are None."""
    if not isinstance(dtype, str):
        return None
    if dtype in NUMBERS or dtype == "string":
        return dtype
    code = dtype.lstrip("<>|=")
    if code == "O" or re.fullmatch(r"[US]\d+", code):
        return "string"
    return V2_TYPES.get(code)


def column_kind(node: dict) -> str | None:
    """numeric, categorical, string or boolean, from a node's metadata alone."""
    attrs = node["attrs"]
    encoding = {"categorical": "categorical", "string-array": "string", "nullable-integer": "numeric", "nullable-boolean": "boolean", "nullable-string-array": "string"}.get(attrs.get("encoding-type"))
    if encoding:
        return encoding
    if "categories" in attrs:
        return "categorical"
    d = node.get("dtype")
    return None if d is None else "string" if d == "string" else "boolean" if d == "bool" else "numeric"


def _node(path: str, meta: dict, attrs: dict) -> dict:
    kind = meta.get("node_type") or ("array" if "shape" in meta else "group")
    raw = meta.get("data_type", meta.get("dtype"))
    chunks = meta.get("chunks") or meta.get("chunk_grid", {}).get("configuration", {}).get("chunk_shape")
    return {"path": path, "kind": kind, "attrs": attrs, "dtype": normal_dtype(raw) if kind == "array" else None, "shape": meta.get("shape"), "chunks": chunks, "meta": meta}


def nodes(spark: SparkSession, root: str) -> dict[str, dict]:
    """Every node by path, parents first; consolidated metadata is taken where there is any.

    A hierarchy's metadata is read by the driver: it plans with it, and it holds no data. Spark's
    file listings leave out names that begin with a dot, as format 2 has them, so the documents
    are read through the file system client; folders of arrays aren't descended into.
    """
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())

    def read(folder, name: str) -> dict | None:
        at = jvm.org.apache.hadoop.fs.Path(folder, name)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    top = read(place, "zarr.json")
    if entries := ((top or {}).get("consolidated_metadata") or {}).get("metadata"):
        found = {"": _node("", top, top.get("attributes", {}))} | {p: _node(p, m, m.get("attributes", {})) for p, m in entries.items()}
    elif flat := (read(place, ".zmetadata") or read(place, "zmetadata") or {}).get("metadata"):
        found = _from_v2(flat)
    else:
        found, flat, todo = {}, {}, [("", place)]
        while todo:
            where, folder = todo.pop()
            if doc := read(folder, "zarr.json"):
                found[where] = _node(where, doc, doc.get("attributes", {}))
            for name in (".zgroup", ".zarray", ".zattrs"):
                if (doc := read(folder, name)) is not None:
                    flat[f"{where}/{name}".lstrip("/")] = doc
            is_array = f"{where}/.zarray".lstrip("/") in flat or found.get(where, {}).get("kind") == "array"
            todo += [] if is_array else [(f"{where}/{f.getPath().getName()}".lstrip("/"), f.getPath()) for f in fs.listStatus(folder) if f.isDirectory()]
        found = found or _from_v2(flat)
    return dict(sorted(found.items(), key=lambda x: (len(x[0].split("/")) if x[0] else 0, x[0])))


def _from_v2(flat: dict[str, dict]) -> dict[str, dict]:
    out = {}
    for where, doc in flat.items():
        folder, _, name = where.rpartition("/")
        if name in (".zgroup", ".zarray"):
            out[folder] = _node(folder, doc, flat.get(f"{folder}/.zattrs".lstrip("/"), {}))
    return out


def node_table(spark: SparkSession, found: dict[str, dict]) -> DataFrame:
    rows = [(p, n["kind"], json.dumps(n["attrs"]), n["dtype"], n["shape"], n["chunks"], json.dumps(n["meta"])) for p, n in found.items()]
    return spark.createDataFrame(rows, NODES)


def orphans(table: DataFrame) -> DataFrame:
    """Nested paths without their parent's entry."""
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return table.where(F.col("path").contains("/")).withColumn("parent", parent).join(table.select(F.col("path").alias("parent")), "parent", "left_anti").select("path")


def tree_json(found: Mapping[str, dict]) -> str:
    """The hierarchy as nested JSON: children by name, ``_attrs``, and ``_zarray`` of arrays; what isn't data is named."""
    root: dict = {}
    for path, node in found.items():
        at = root
        for part in [p for p in path.split("/") if p]:
            at = at.setdefault(part, {})
        at["_attrs"] = node["attrs"]
        if node["kind"] == "array":
            at["_zarray"] = {k: node[k] for k in ("dtype", "shape", "chunks")}
    return json.dumps(root, default=lambda x: f"<{'function' if callable(x) else type(x).__name__}>")


def depth_sorted(df: DataFrame, path: str) -> DataFrame:
    """The rows with ``depth``, the number of parts of a path, parents before their children."""
    return df.withColumn("depth", F.size(F.split(path, "/"))).orderBy("depth", path)


def ome_path(attrs: Column) -> Column:
    """The first level's path, from attributes with or without the ``ome`` root of the later format."""
    at = lambda root: F.get_json_object(attrs, f"$.{root}multiscales[0].datasets[0].path")
    return F.coalesce(at("ome."), at(""))


@dataclass(frozen=True)
class _Codec:
    steps: tuple[tuple[Callable[[bytes, dict], bytes], dict], ...]
    dtype: np.dtype | None
    text: bool
    order: str | tuple[int, ...]  # C, F, or a permutation of the axes

    def shaped(self, values: np.ndarray, chunk: Sequence[int]) -> np.ndarray:
        if isinstance(self.order, str):
            return values.reshape(chunk, order=self.order)
        return values.reshape([chunk[a] for a in self.order]).transpose(np.argsort(self.order))


def _step(name: str, settings: dict) -> tuple[Callable[[bytes, dict], bytes], dict]:
    known = name in DECODERS and (name != "blosc" or DECODERS[name] is not blosc or settings.get("cname") in BLOSC_NAMES)
    if not known:
        raise UnsupportedCodecError(f"no decoder for {name} {settings}")
    return DECODERS[name], settings


def _codec(meta: dict) -> _Codec:
    text, steps, order, byte = False, [], meta.get("order", "C"), "<"
    if "codecs" in meta:
        for c in meta["codecs"]:
            name, settings = c["name"], c.get("configuration", {})
            if name == "vlen-utf8":
                text = True
            elif name == "bytes":
                byte = ">" if settings.get("endian") == "big" else "<"
            elif name == "transpose":
                order = settings["order"] if isinstance(settings.get("order"), str) else tuple(settings["order"])
            else:
                steps.append(_step(name, settings))
    else:
        for f in meta.get("filters") or ():
            if f["id"] == "vlen-utf8":
                text = True
            else:
                steps.append(_step(f["id"], f))
        if meta.get("compressor"):
            steps.append(_step(meta["compressor"]["id"], meta["compressor"]))
        byte = ">" if str(meta["dtype"]).startswith(">") else "<"
    name = normal_dtype(meta.get("data_type", meta.get("dtype")))
    if text or name in (None, "string"):
        fixed = str(meta.get("dtype", "")).lstrip("<>|")
        return _Codec(tuple(reversed(steps)), np.dtype(byte + fixed) if re.fullmatch(r"[US]\d+", fixed) else None, True, order)
    return _Codec(tuple(reversed(steps)), np.dtype(name).newbyteorder(byte), False, order)


def decode(data: bytes, codec: _Codec) -> np.ndarray:
    for step, settings in codec.steps:
        data = step(data, settings)
    if codec.dtype is not None:
        v = np.frombuffer(data, codec.dtype)
        return v if not codec.text else np.array([x.decode() if isinstance(x, bytes) else x for x in v], object)
    (n,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(n):
        (size,) = struct.unpack_from("<I", data, at)
        out.append(data[at + 4 : at + 4 + size].decode())
        at += 4 + size
    return np.array(out, object)


def chunk_ranges(node: dict, only: Mapping[int, tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """For each axis the chunks (first, end) that a selection of half-open index ranges meets."""
    out = []
    for axis, (size, chunk) in enumerate(zip(node["shape"], node["chunks"], strict=True)):
        low, high = (only or {}).get(axis, (0, size))
        low, high = max(0, low), min(size, high)
        out.append((low // chunk, max(low // chunk, -(-high // chunk))) if low < high else (0, 0))
    return out


#: Up to how many chunks a selection's files are asked for by name; more are listed.
NAMED = 4096


def cells(spark: SparkSession, root: str, node: dict, only: Mapping[int, tuple[int, int]] | None = None) -> DataFrame:
    """One row an element: its index on each axis (i0, i1, ...) and value (bigint, double or string).

    Chunks that aren't there hold the fill value; padding beyond the shape is cut. ``only`` selects
    half-open ranges of indices by axis: chunks that it doesn't meet aren't opened.
    """
    meta, shape, chunk = node["meta"], node["shape"], node["chunks"]
    codec, n = _codec(meta), len(shape)
    text = codec.text
    whole = not text and node["dtype"] in WHOLE
    sep = meta.get("dimension_separator", ".") if "codecs" not in meta else meta.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
    prefix = "c/" if "codecs" in meta else ""
    fill = meta.get("fill_value")
    base = f"{root.rstrip('/')}/{node['path']}"
    grid = chunk_ranges(node, only)
    bounds = [((only or {}).get(k, (0, shape[k]))[0], min(shape[k], (only or {}).get(k, (0, shape[k]))[1])) for k in range(n)]
    counts = [b - a for a, b in grid]
    schema = ", ".join([*(f"i{k} bigint" for k in range(n)), f"value {'string' if text else 'bigint' if whole else 'double'}"])
    total = int(np.prod(counts)) if n else 0
    keys = spark.range(total)
    part = []
    for k in reversed(range(n)):
        step = int(np.prod(counts[k + 1 :]))
        part.insert(0, (F.floor(F.col("id") / step) % max(1, counts[k]) + grid[k][0]).cast("string"))
    keys = keys.select("id", F.concat_ws(sep, *part).alias("key"))
    places = [base]
    if only is not None and total <= NAMED:
        jvm = spark._jvm
        names = [sep.join(str(i + grid[k][0]) for k, i in enumerate(at)) for at in np.ndindex(*counts)] if total else []
        path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{base}/{prefix}{name}")
        fs = path("0").getFileSystem(spark._jsc.hadoopConfiguration())
        places = [f"{base}/{prefix}{name}" for name in names if fs.exists(path(name))]
    if places:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(places)
        files = files.select(F.element_at(F.split("path", re.escape(f"/{node['path']}/{prefix}")), -1).alias("key"), "content")
    else:
        files = spark.createDataFrame([], "key string, content binary")

    def run(batches):
        for batch in batches:
            for i, data in zip(batch.column("id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at = []
                for count, (first, _) in zip(reversed(counts), reversed(grid), strict=True):
                    i, r = divmod(i, count)
                    at.insert(0, first + r)
                block = np.full(chunk, fill, object if text else np.int64 if whole else float) if data is None else codec.shaped(decode(data, codec), chunk)
                low = [max(0, lo - a * c) for a, c, (lo, _) in zip(at, chunk, bounds, strict=True)]
                high = [min(c, hi - a * c) for a, c, (_, hi) in zip(at, chunk, bounds, strict=True)]
                block = block[tuple(map(slice, low, high))]
                index = np.indices(block.shape).reshape(n, -1) + np.array([a * c + x for a, c, x in zip(at, chunk, low, strict=True)])[:, None]
                v = pa.array(block.ravel().tolist(), pa.string()) if text else pa.array(block.ravel().astype(np.int64 if whole else float))
                yield pa.record_batch([*(pa.array(x.astype(np.int64)) for x in index), v], names=[*(f"i{k}" for k in range(n)), "value"])

    return keys.join(files, "key", "left").select("id", "content").mapInArrow(run, schema)


def labels_and_levels(attrs: dict) -> tuple[list[str], list[str]]:
    """Axis names and level paths of the first multiscale of an OME attribute document."""
    root = attrs.get("ome", attrs)
    scales = root.get("multiscales") or []
    if not scales:
        raise ValueError("there are no multiscales")
    first = scales[0]
    axes = [a["name"] if isinstance(a, dict) else a for a in first.get("axes", [])] or ["t", "c", "z", "y", "x"]
    return axes, [d["path"] for d in first.get("datasets", [])] or ["0"]


def column(spark: SparkSession, root: str, found: dict[str, dict], path: str) -> DataFrame:
    """row_index, value of a data-frame column: categorical, nullable, text or numeric."""
    node = found[path]
    if node["kind"] == "array":
        df = cells(spark, root, node).select(F.col("i0").alias("row_index"), "value")
        if cats := node["attrs"].get("categories"):
            return _decoded(spark, root, found, df, f"{path.rpartition('/')[0]}/{cats}")
        return df
    if node["attrs"].get("encoding-type") == "categorical":
        codes = cells(spark, root, found[f"{path}/codes"]).select(F.col("i0").alias("row_index"), "value")
        return _decoded(spark, root, found, codes, f"{path}/categories")
    values = cells(spark, root, found[f"{path}/values"]).select(F.col("i0").alias("row_index"), "value")
    if f"{path}/mask" not in found:
        return values
    mask = cells(spark, root, found[f"{path}/mask"]).select(F.col("i0").alias("row_index"), F.col("value").alias("masked"))
    return values.join(mask, "row_index").select("row_index", F.when(F.col("masked") == 0, F.col("value")).alias("value"))


def _decoded(spark, root, found, codes: DataFrame, categories: str) -> DataFrame:
    cats = cells(spark, root, found[categories]).select(F.col("i0").alias("code"), F.col("value").alias("category"))
    return codes.join(cats, F.col("value") == F.col("code"), "left").select("row_index", F.col("category").alias("value"))


def numeric(spark: SparkSession, root: str, found: dict[str, dict], path: str, only: Mapping[int, tuple[int, int]] | None = None) -> DataFrame:
    """The elements of a numeric array; another array, or none, is an error."""
    node = found.get(path)
    if node is None or node["kind"] != "array":
        raise KeyError(f"there is no array {path!r}")
    if node["dtype"] not in NUMBERS:
        raise ValueError(f"{path!r} is not numeric: {node['dtype']}")
    return cells(spark, root, node, only)


def flat(spark: SparkSession, root: str, found: dict[str, dict], path: str) -> DataFrame:
    """row_index, value of an array, or of a nullable group's array with masked values as null."""
    return column(spark, root, found, path)


def index(spark: SparkSession, root: str, found: dict[str, dict], path: str, key: str | None = None) -> DataFrame:
    """row_index, id of a data frame: the given column or its index, as text, null being ''."""
    name = key or found[path]["attrs"].get("_index", "_index")
    return column(spark, root, found, f"{path}/{name}").select("row_index", F.coalesce(F.col("value").cast("string"), F.lit("")).alias("id"))


def alias(index_: DataFrame, aliases: DataFrame) -> DataFrame:
    """'alias (id)', or the id where the alias is empty."""
    a = aliases.select("row_index", F.col("value").alias("_alias"))
    return index_.join(a, "row_index", "left").withColumn("label", F.when(F.coalesce("_alias", F.lit("")) != "", F.concat("_alias", F.lit(" ("), "id", F.lit(")"))).otherwise(F.col("id"))).drop("_alias")


def dimensions(df: DataFrame, vector: str, dims: Sequence[int]) -> DataFrame:
    """Chosen components of an array column."""
    rest = [c for c in df.columns if c != vector]
    return df.select(*rest, *[F.get(vector, d).alias(f"dim_{d}") for d in dims])
