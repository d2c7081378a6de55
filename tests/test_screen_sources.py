"""Image files, the feature sink and the stateful stream."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenspark.operators import selection, series
from screenspark.sources import images
from screenspark.streaming import state


def tiff(pages, order="<", planar=1, rows_per_strip=2):
    """A TIFF file of uncompressed strips."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        image = page if page.ndim == 3 else page[..., None]
        samples = image.shape[0] if planar == 2 else image.shape[2]
        height, width = image.shape[1:] if planar == 2 else image.shape[:2]
        planes = list(image) if planar == 2 else [image]
        offsets, sizes = [], []
        for plane in planes:
            for y in range(0, height, rows_per_strip):
                raw = plane[y : y + rows_per_strip].astype(plane.dtype.newbyteorder(order)).tobytes()
                offsets.append(len(out))
                sizes.append(len(raw))
                out += raw
        arrays = {}
        for tag, values in ((273, offsets), (279, sizes)):
            arrays[tag] = len(out)
            out += struct.pack(f"{order}{len(values)}I", *values)
        kind = {"u": 1, "i": 2, "f": 3}[page.dtype.kind]
        entries = [(256, width), (257, height), (258, page.dtype.itemsize * 8), (259, 1), (273, None), (277, samples), (278, rows_per_strip), (279, None), (284, planar), (339, kind)]
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries))
        for tag, value in entries:
            if value is not None:
                out += struct.pack(order + "HHI", tag, 3, 1) + struct.pack(order + "HH", value, 0)
            else:
                n = len(offsets)
                out += struct.pack(order + "HHI", tag, 4, n) + struct.pack(order + "I", arrays[tag] if n > 1 else (offsets if tag == 273 else sizes)[0])
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", ["uint8", "uint16", "float32"])
def test_images_of_both_axis_orders_come_back(spark, tmp_path, order, kind):
    image = (np.arange(5 * 4 * 3) % 250).reshape(5, 4, 3).astype(kind)
    (tmp_path / "last").mkdir()
    (tmp_path / "first").mkdir()
    (tmp_path / "last" / "a.tif").write_bytes(tiff([image, image * 0], order))
    (tmp_path / "last" / "b.TIFF").write_bytes(tiff([image[..., 0]], order, rows_per_strip=9))
    np.save(tmp_path / "last" / "c.npy", image)
    (tmp_path / "first" / "a.tif").write_bytes(tiff(list(np.moveaxis(image, -1, 0)), order))
    (tmp_path / "first" / "d.tif").write_bytes(tiff([np.ascontiguousarray(np.moveaxis(image, -1, 0))], order, planar=2))
    want = {(ch, y, x): float(v) for (y, x, ch), v in np.ndenumerate(image)}
    for folder, axes in (("last", "hwc"), ("first", "chw")):
        found = {}
        for r in images.read_images(spark, str(tmp_path / folder), axes).collect():
            found.setdefault(r.path.rsplit("/", 1)[1], {})[r.ch, r.y, r.x] = r.v
        for name, pixels in found.items():
            assert pixels == (want if name != "b.TIFF" else {k: v for k, v in want.items() if k[0] == 0}), name
        assert len(found) == (3 if axes == "hwc" else 2)


def test_other_files_raise(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    with pytest.raises(Exception, match="unsupported file format"):
        images.read_images(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="not a TIFF"):
        images.decode_tiff(b"nothing")


def test_written_wells_are_replaced_alone_and_pruned(spark, tmp_path):
    path = f"{tmp_path}/out"
    rows = spark.createDataFrame([("a", "w1", [1.0, 2.0]), ("b", "w2", [3.0, 4.0])], "ID string, plate_well string, features array<double>")
    images.write_features(images.wide_features(rows, 2), path)
    images.write_features(images.wide_features(rows.filter("ID = 'b'").withColumn("ID", F.lit("c")), 2), path)
    one = spark.read.parquet(path).filter("plate_well = 'w2'")
    assert [tuple(r) for r in one.select("ID", "0", "1").collect()] == [("c", 3.0, 4.0)] and spark.read.parquet(path).count() == 2
    assert "PartitionFilters: [isnotnull(plate_well" in one._jdf.queryExecution().toString()


def test_a_stream_with_state_equals_the_batch_over_a_restart(spark, tmp_path):
    draw = np.random.default_rng(8)
    rows = [(f"k{int(draw.integers(0, 3))}", i, float(draw.integers(0, 40)) if draw.random() < 0.95 else None) for i in range(120)]
    schema = "k string, t long, v double"
    cuts = [0, 9, 10, 47, 90, 120]
    source, check = f"{tmp_path}/in", f"{tmp_path}/check"
    for step, stop in ((0, 3), (3, 5)):
        for a, b in zip(cuts[step:stop], cuts[step + 1 : stop + 1]):
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = state.smoothed(stream, "k", "t", "v", 7, 0.9).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
    df = spark.createDataFrame(rows, schema)
    near = lambda r: tuple(None if x is None else round(x, 9) for x in (r.median, r.mean, r.top, r.global_mean))
    found = {(r.k, r.t): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = {(r.k, r.t): r for r in series.smoothed(df, "k", ["t"], "v", 7).collect()}
    assert len(found) == 120 and {k: near(r) for k, r in found.items()} == {k: near(r) for k, r in batch.items()}
    last = {k: max((r for r in found.values() if r.k == k), key=lambda r: r.t).ema for k in ("k0", "k1", "k2")}
    ema = selection.final_average(df.dropna(), "k", ["t"], "v", 0.9)
    assert all(abs(last[r.k] - r.ema) < 1e-9 for r in ema.collect())
