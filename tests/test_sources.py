"""Codecs, chunk and row-group pruning, footers, capped reads, writers and their checks."""

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lattica.model import Bounds, PointColumns
from lattica.operators import index, points, raster
from lattica.sources import checks, parquet, write, zarr
from lattica.sources.store import Store

C = PointColumns("x", "y", "row_id", name="gene", morton="morton")


def blosc_of(data, width, inner="lz4_raw", block=4096, shuffle=True):
    """A container as by its description: a block's streams are of one byte of each element."""
    number = {"lz4_raw": 1, "snappy": 2, "zlib": 3, "zstd": 4}[inner]
    blocks = [data[i : i + block] for i in range(0, len(data), block)]
    body, starts = b"", []
    for b in blocks:
        parts = width if len(b) == block and width <= 16 and block // width >= 128 else 1
        mixed = np.frombuffer(b, np.uint8).reshape(-1, width).T.tobytes() if shuffle else b
        starts.append(16 + 4 * len(blocks) + len(body))
        for i in range(parts):
            s = mixed[i * len(b) // parts : (i + 1) * len(b) // parts]
            z = zlib.compress(s) if inner == "zlib" else pa.compress(s, codec=inner, asbytes=True)
            z = z if len(z) < len(s) else s
            body += struct.pack("<i", len(z)) + z
    head = struct.pack("<BBBBIII", 2, 1, number << 5 | shuffle, width, len(data), block, 16 + 4 * len(blocks) + len(body))
    return head + b"".join(struct.pack("<I", s) for s in starts) + body


@pytest.mark.parametrize("inner", ["lz4_raw", "snappy", "zlib", "zstd"])
@pytest.mark.parametrize("shuffle", [True, False])
def test_blosc(inner, shuffle):
    for kind, n in (("<i4", 5000), ("<f8", 700), ("<u2", 3), ("u1", 10_000)):
        v = (np.arange(n) % 97).astype(kind)
        codec = zarr._codec({"dtype": v.dtype.str, "compressor": {"id": "blosc", "cname": "lz4", "shuffle": int(shuffle)}})
        assert (zarr.decode(blosc_of(v.tobytes(), v.itemsize, inner, shuffle=shuffle), codec) == v).all()


def test_blosc_of_stored_bytes_and_bits():
    v = np.arange(64, dtype="<i4")
    stored = struct.pack("<BBBBIII", 2, 1, 2, 4, 256, 256, 272) + v.tobytes()
    assert zarr.blosc(stored, {}) == v.tobytes()
    bits = np.unpackbits(v.view(np.uint8).reshape(64, 4), axis=1, bitorder="little").T
    mixed = np.packbits(np.ascontiguousarray(bits), axis=1, bitorder="little").tobytes()
    assert zarr._bit_unshuffled(mixed, 4) == v.tobytes()
    with pytest.raises(zarr.UnsupportedCodecError):
        zarr._codec({"dtype": "<i4", "compressor": {"id": "blosc", "cname": "blosclz"}})


@pytest.mark.parametrize("order", [[0, 2, 1], [2, 1, 0], [1, 2, 0]])
def test_transpose_by_its_order(order):
    v = np.arange(24).reshape(2, 3, 4)
    meta = {"data_type": "int64", "codecs": [{"name": "transpose", "configuration": {"order": order}}, {"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]}
    codec = zarr._codec(meta)
    data = np.ascontiguousarray(v.transpose(order)).tobytes() + b"\x01\x02\x03\x04"
    assert (codec.shaped(zarr.decode(data, codec), (2, 3, 4)) == v).all()


def test_a_decoder_can_be_added():
    with pytest.raises(zarr.UnsupportedCodecError):
        zarr._codec({"dtype": "<i4", "compressor": {"id": "backwards"}})
    zarr.register_decoder(["backwards"], lambda data, settings: data[::-1])
    try:
        codec = zarr._codec({"dtype": "<i4", "compressor": {"id": "backwards"}})
        assert zarr.decode(np.arange(3, dtype="<i4").tobytes()[::-1], codec).tolist() == [0, 1, 2]
    finally:
        del zarr.DECODERS["backwards"]


@pytest.fixture
def image(tmp_path):
    """A 2 x 20 x 30 image in chunks of 1 x 8 x 8; one chunk is left out, those never to be read are broken."""
    v = np.arange(2 * 20 * 30).reshape(2, 20, 30)
    folder = tmp_path / "s.zarr" / "images" / "im" / "0"
    folder.mkdir(parents=True)
    root = tmp_path / "s.zarr"
    for p in ("", "images"):
        (root / p / ".zgroup").write_text('{"zarr_format": 2}')
    axes = [{"name": "c"}, {"name": "y"}, {"name": "x"}]
    (root / "images/im/.zgroup").write_text('{"zarr_format": 2}')
    (root / "images/im/.zattrs").write_text(json.dumps({"multiscales": [{"axes": axes, "datasets": [{"path": "0"}]}]}))
    meta = {"zarr_format": 2, "shape": v.shape, "chunks": [1, 8, 8], "dtype": "<i4", "compressor": {"id": "zlib"}, "fill_value": 7, "order": "C", "filters": None}
    (folder / ".zarray").write_text(json.dumps(meta))
    for c in range(2):
        for y in range(3):
            for x in range(4):
                block = np.zeros((1, 8, 8), "<i4")
                part = v[c : c + 1, y * 8 : y * 8 + 8, x * 8 : x * 8 + 8]
                block[:, : part.shape[1], : part.shape[2]] = part
                (folder / f"{c}.{y}.{x}").write_bytes(zlib.compress(block.tobytes()))
    return root, v


def test_tiles_and_planes_open_their_own_chunks(spark, image):
    root, v = image
    for f in (root / "images/im/0").iterdir():
        if f.name.startswith("0."):
            f.write_bytes(b"broken")  # channel 0 can't be read
    (root / "images/im/0/1.1.1").unlink()
    store = Store.open(spark, str(root))
    v = v.copy()
    v[1, 8:16, 8:16] = 7
    got = {(r["y"], r["x"]): r["value"] for r in store.plane("images", "im", {"c": 1}).collect()}
    assert got == {(y, x): v[1, y, x] for y in range(20) for x in range(30)}
    tile = store.tile("images", "im", 1, 0, 12, {"c": 1}).collect()
    assert {(r["y"], r["x"]): r["value"] for r in tile} == {(y, x): v[1, y, x] for y in range(12) for x in range(12, 24)}
    with pytest.raises(IndexError):
        store.tile("images", "im", 3, 0, 12)
    with pytest.raises(KeyError):
        store.plane("images", "im", {"q": 0})
    assert store.sub("images").root.endswith("/images")
    with pytest.raises(ValueError):
        store.sub("../x")


def test_tree_as_json(spark, image):
    tree = json.loads(zarr.tree_json(zarr.nodes(spark, str(image[0]))))
    assert tree["images"]["im"]["0"]["_zarray"]["shape"] == [2, 20, 30] and "multiscales" in tree["images"]["im"]["_attrs"]


# points


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(20_000).selectExpr("id as row_id", "cast((id * 7919) % 10007 as double) as x", "cast((id * 104729) % 9973 as double) as y", "concat('g', id % 5) as gene")


@pytest.fixture(scope="module")
def sorted_set(spark, table, tmp_path_factory):
    folder = f"{tmp_path_factory.mktemp('sorted')}/points.parquet"
    assert write.write_grouped(table, C, folder, 500) == 20_000
    return folder


def test_grouped_files_pass_all_checks(spark, sorted_set, tmp_path):
    found = checks.morton_file(spark, sorted_set, C)
    assert checks.all_passed(found), found.collect()
    assert found.count() == 9
    footers = parquet.row_groups(spark, parquet.parts(sorted_set, spark))
    rows = [r["rows"] for r in parquet.groups(footers).orderBy("group_id").collect()]
    assert rows[0] <= 4 and max(rows) == 500 and sum(rows) == 20_000 == parquet.row_count(spark, sorted_set)
    missing = checks.morton_file(spark, f"{tmp_path}/nothing", C)
    assert not checks.all_passed(missing) and missing.count() == 1
    spark.range(9).selectExpr("id as row_id", "id * 1.0 as x", "-id * 1.0 as y", "9 - id as morton", "id as x_uint").coalesce(1).write.parquet(f"{tmp_path}/bad")
    bad = {r["id"]: r["passed"] for r in checks.morton_file(spark, f"{tmp_path}/bad", C).collect()}
    assert not bad["tail_sorted"] and not bad["no_staging_columns"] and not bad["group_of_markers"]


def test_a_view_reads_fewer_rows(spark, sorted_set, table):
    """The codes' spans reach the row groups; the answer is that of the plain filter."""
    every = index.extent(table, C)
    box = Bounds(1000, 1000, 2200, 2100)
    df = spark.read.parquet(sorted_set)
    got = points.in_view(df, C, every, box)
    assert sorted(r["row_id"] for r in got.collect()) == sorted(r["row_id"] for r in points.in_bounds(table, C, box).collect())
    assert parquet.rows_read(got.select("row_id")) < 0.5 * parquet.rows_read(points.in_bounds(df, C, Bounds(-1e9, -1e9, 1e9, 1e9)).select("row_id"))
    plain = PointColumns("x", "y", "row_id")
    assert points.in_view(df, plain, every, box).count() == got.count()


def test_groups_by_footers(spark, sorted_set, table):
    footers = parquet.row_groups(spark, parquet.parts(sorted_set, spark))
    ext = parquet.extents(footers, "morton")
    spans = index.covering_spans(spark, index.extent(table, C), Bounds(1000, 1000, 2200, 2100))
    some = index.groups_for_spans(ext, spans)
    assert 0 < some.count() < 0.5 * ext.count()
    back = parquet.read_row_group(spark, sorted_set, 7, ["row_id", "morton"])
    r = ext.where("group_id = 7").first()
    assert back.count() == r["rows"] and back.agg(F.min("morton"), F.max("morton")).first()[:] == (r["lo"], r["hi"])
    assert parquet.read_row_group(spark, sorted_set, 7, ["row_id"], limit=5, offset=3).count() == 5
    with pytest.raises(IndexError):
        parquet.read_row_group(spark, sorted_set, 10_000)


def test_footers_by_the_driver_are_the_same(spark, sorted_set, monkeypatch):
    files = parquet.parts(sorted_set, spark)
    near = sorted(map(tuple, parquet.row_groups(spark, files).collect()))
    monkeypatch.setattr(parquet, "_local", lambda path: None)
    assert sorted(map(tuple, parquet.row_groups(spark, files).collect())) == near


def test_capped_reads_open_the_first_parts_alone(spark, tmp_path):
    for i in range(4):
        pq.write_table(pa.table({"v": list(range(i * 10, i * 10 + 10))}), f"{tmp_path}/part.{i}.parquet")
    got = parquet.read_capped(spark, str(tmp_path), 15, ["v"])
    assert sorted(r["v"] for r in got.collect()) == list(range(15))
    assert {f.rsplit("/", 1)[-1] for f in got.inputFiles()} == {"part.0.parquet", "part.1.parquet"}
    assert [n.rsplit("/", 1)[-1] for n, _ in parquet.bytes_until(spark, str(tmp_path), 10)] == ["part.0.parquet"]
    assert parquet.read_capped(spark, str(tmp_path), None, ["v"]).count() == 40
    assert parquet.concat(spark, str(tmp_path)).count() == 40
    (tmp_path / "part.1.parquet").unlink()
    with pytest.raises(FileNotFoundError):
        parquet.read_capped(spark, str(tmp_path), 15)
    with pytest.raises(FileNotFoundError):
        parquet.concat(spark, str(tmp_path))


def test_caps_cut_by_a_threshold(spark):
    ids = [5, 5, 5, 9, 1, 100_000, -7, 3, 3, 12]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    for n in range(1, 12):
        assert sorted(r["id"] for r in points.first_rows(df, "id", n)[0].collect()) == sorted(ids)[:n]
    wide = spark.range(0, 10**7, 997).select(F.col("id") * 10**10)
    rows = points.first_rows(wide.toDF("id"), "id", 1234)[0]
    assert rows.count() == 1234 and rows.agg(F.max("id")).first()[0] == 1233 * 997 * 10**10
    plan = rows._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan
    assert points.first_rows(df.limit(0), "id", 3)[0].count() == 0


def test_batches_and_chunks(spark, table):
    some = table.limit(5)
    batch = points.to_batch(some, C)
    assert batch.columns == ["row_id", "x", "y", "z"] and {r["code"] for r in points.from_batch(batch).collect()} == {-1}
    coded = batch.withColumn("code", F.lit(2))
    assert points.concat_chunks([coded, coded], "code").columns[-1] == "code"
    assert "code" not in points.concat_chunks([coded, batch], "code").columns


def test_multiscale_files_and_their_checks(spark, table, tmp_path):
    df = table.selectExpr("x", "y", "gene", "cast(row_id % 3 as int) as __spatial_index__", "row_id % 64 as __morton__")
    assert write.write_multiscale(df, f"{tmp_path}/m", rows=1000) == 20_000
    assert checks.all_passed(checks.multiscale_file(spark, f"{tmp_path}/m"))
    document = json.loads(parquet.key_values(f"{tmp_path}/m", spark)["spatialdata_multiscale"])
    assert document["axes"] == ["x", "y"] and document["n_points_total"] == 20_000
    rows = [tuple(r) for r in parquet.read(spark, f"{tmp_path}/m", ["gene", "__spatial_index__", "__morton__"]).orderBy("part", "row_index").select("gene", "__spatial_index__", "__morton__").collect()]
    assert rows == sorted(rows)
    df.limit(3).write.parquet(f"{tmp_path}/plain")
    assert not checks.all_passed(checks.multiscale_file(spark, f"{tmp_path}/plain"))


def test_layouts_and_their_checks(spark, table, tmp_path):
    manifest = write.write_layouts(table.limit(3000), C, str(tmp_path))
    assert checks.all_passed(checks.layouts(spark, str(tmp_path), manifest, C))
    assert not checks.all_passed(checks.layouts(spark, str(tmp_path), {"layouts": [*manifest["layouts"], "none"]}, C))
    assert not checks.all_passed(checks.layouts(spark, str(tmp_path), {}, C))


def test_csv_input_csc_and_pyramids(spark, tmp_path):
    (tmp_path / "p.csv").write_text("x,y,gene\n1.5,2,a\n3,4,b\n")
    df = parquet.read_table(spark, f"{tmp_path}/p.csv")
    assert dict(df.dtypes) == {"x": "double", "y": "int", "gene": "string"} and df.count() == 2
    m = spark.createDataFrame([(0, 1, 2.0), (1, 0, 3.0), (2, 1, 0.0), (2, 2, 5.0)], "r int, c int, v double")
    write.write_csc(m, "r", "c", "v", f"{tmp_path}/csc")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/csc/indptr").orderBy("c").collect()] == [(0, 1, 0), (1, 1, 1), (2, 1, 2)]
    image = raster.synthetic(spark, 16, 16)
    assert write.write_pyramid(image, ["c", "z"], [16, 16], f"{tmp_path}/pyr", least=4) == [2, 2]
    assert spark.read.parquet(f"{tmp_path}/pyr/2").count() == 16
