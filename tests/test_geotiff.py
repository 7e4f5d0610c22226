"""GeoTIFF files of several kinds against their values, windows that read their blocks only, and a mosaic written by Spark."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.operators.dem import Raster
from meshwright.sources import geotiff


def packed_lzw(data):
    """An LZW stream, by the letter: codes from 258, one bit wider an entry early, begun anew when full."""
    codes, table, last = [(256, 9)], {bytes([i]): i for i in range(256)}, b""
    new, width = 258, 9
    for byte in data:
        now = last + bytes([byte])
        if now in table:
            last = now
            continue
        codes.append((table[last], width))
        table[now] = new
        new += 1
        if new + 1 > (1 << width) - 0 and width < 12:
            width += 1
        if new >= 4094:
            codes.append((256, width))
            table, new, width = {bytes([i]): i for i in range(256)}, 258, 9
        last = bytes([byte])
    if last:
        codes.append((table[last], width))
        new += 1
        if new + 1 > (1 << width) and width < 12:
            width += 1
    codes.append((257, width))
    bits = "".join(f"{code:0{w}b}" for code, w in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def tiff(values, order="<", compression=1, predictor=1, tile=None, rows=7, big=False, no_data=None, samples=1, transform=False):
    """A file by the letter of the format, in ways that the library's own writer does not use."""
    height, width = values.shape
    kind = {"f": 3, "i": 2, "u": 1}[values.dtype.kind]
    blocks = []
    boxes = [(r, c, tile[1], tile[0]) for r in range(0, height, tile[1]) for c in range(0, width, tile[0])] if tile else [(r, 0, min(rows, height - r), width) for r in range(0, height, rows)]
    for r, c, h, w in boxes:
        part = np.zeros((h, w, samples), values.dtype)
        piece = values[r : r + h, c : c + w]
        part[: piece.shape[0], : piece.shape[1], 0] = piece
        if predictor == 2:
            part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
        data = part.astype(part.dtype.newbyteorder(order)).tobytes()
        if predictor == 3:
            size = values.dtype.itemsize
            planes = part.astype(part.dtype.newbyteorder(">")).view(np.uint8).reshape(h, w * samples, size).transpose(0, 2, 1).reshape(h, -1, samples)
            data = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
        blocks.append({1: lambda x: x, 5: packed_lzw, 8: zlib.compress, 32946: zlib.compress}[compression](data))
    letters = {2: "s", 3: "H", 4: "I", 12: "d", 16: "Q"}
    place = 16 if big else 4
    fields = [(256, 3, [width]), (257, 3, [height]), (258, 3, [values.dtype.itemsize * 8] * samples), (259, 3, [compression]), (277, 3, [samples]), (284, 3, [1]), (317, 3, [predictor]), (339, 3, [kind] * samples)]
    where, length = (324, 325) if tile else (273, 279)
    fields += [(322, 3, [tile[0]]), (323, 3, [tile[1]])] if tile else [(278, 3, [rows])]
    fields += [(where, place, [0] * len(blocks)), (length, 4, [len(b) for b in blocks])]
    fields += [(34264, 12, [0.001, 0, 0, 44.0, 0, -0.002, 0, 40.5, 0, 0, 0, 0, 0, 0, 0, 1])] if transform else [(33550, 12, [0.001, 0.002, 0.0]), (33922, 12, [2.0, 1.0, 0.0, 44.002, 40.498, 0.0])]
    if no_data is not None:
        fields.append((42113, 2, [str(no_data).encode() + b"\0"]))
    fields.sort()
    head, entry, room = (16, 20, 8) if big else (8, 12, 4)
    after = head + (8 if big else 2) + entry * len(fields) + room

    def body(offsets):
        rows_, extra = b"", b""
        for tag, code, items in fields:
            if tag == where:
                items = offsets
            data = items[0] if code == 2 else struct.pack(f"{order}{len(items)}{letters[code]}", *items)
            many = len(data) if code == 2 else len(items)
            if len(data) > room:
                inline = struct.pack(order + ("Q" if big else "I"), after + len(extra))
                extra += data
            else:
                inline = data.ljust(room, b"\0")
            rows_ += struct.pack(order + ("HHQ" if big else "HHI"), tag, code, many) + inline
        return rows_, extra

    _, extra = body([0] * len(blocks))
    offsets, at = [], after + len(extra)
    for b in blocks:
        offsets.append(at)
        at += len(b)
    rows_, extra = body(offsets)
    mark = b"II" if order == "<" else b"MM"
    first = mark + (struct.pack(order + "HHHQ", 43, 8, 0, 16) + struct.pack(order + "Q", len(fields)) if big else struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(fields)))
    return first + rows_ + b"\0" * room + extra + b"".join(blocks)


KINDS = [
    ("<", "f4", dict(compression=8, predictor=3, tile=(16, 16))),
    (">", "f4", dict(compression=1, rows=5)),
    ("<", "f8", dict(compression=32946, predictor=3, rows=9, big=True)),
    (">", "i2", dict(compression=5, predictor=2, tile=(32, 16))),
    ("<", "u2", dict(compression=5, rows=11)),
    ("<", "i4", dict(compression=8, predictor=2, rows=4, samples=3)),
    (">", "u1", dict(compression=5, rows=64, transform=True)),
    ("<", "f4", dict(compression=5, predictor=3, tile=(16, 32), samples=2, transform=True)),
]


@pytest.mark.parametrize("order,dtype,how", KINDS)
def test_blocks_of_every_kind(tmp_path, order, dtype, how):
    rng = np.random.default_rng(len(str(how)))
    values = (rng.random((37, 45)) * 200).cumsum(axis=1).astype(dtype) if dtype != "u1" else rng.integers(0, 250, (37, 45)).astype(dtype)
    values[3, 4] = values[36, 44] = 77
    (tmp_path / "a.tif").write_bytes(tiff(values, order, no_data=77, **how))
    shape = geotiff.layout(str(tmp_path / "a.tif"))
    assert (shape.width, shape.height, shape.no_data) == (45, 37, 77.0)
    assert (shape.west, shape.north, shape.dx, shape.dy) == pytest.approx((44.0, 40.5, 0.001, 0.002))
    reader = geotiff.GeoTiffReader(str(tmp_path / "a.tif"), 100)
    got = np.full(values.shape, -1.0)
    for part in reader.partitions():
        for batch in reader.read(part):
            r, c = batch.column("row").to_numpy(), batch.column("col").to_numpy()
            got[r, c] = batch.column("value").to_numpy(zero_copy_only=False)
    want = values.astype(float)
    want[values == 77] = np.nan
    assert np.array_equal(got, want, equal_nan=True)


def test_lzw_with_many_codes():
    rng = np.random.default_rng(0)
    for data in (rng.bytes(40_000), b"ab" * 20_000, b"", b"x", bytes(range(256)) * 50):
        assert geotiff.unpacked_lzw(packed_lzw(data)) == data


def test_what_is_not_read(tmp_path):
    values = np.ones((4, 4), np.float32)
    for name, data in (("text", b"hello world, no raster here"), ("turned", tiff(values, transform=True).replace(struct.pack("<d", -0.002), struct.pack("<d", 0.002)))):
        (tmp_path / f"{name}.tif").write_bytes(data)
        with pytest.raises(ValueError):
            geotiff.layout(str(tmp_path / f"{name}.tif"))
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        geotiff.mosaic(str(tmp_path / "none"))


def test_mosaic_round_trip_and_windows(spark, tmp_path):
    """Written by Spark, read by Spark: equal, and a window reads only the blocks that it touches."""
    px = spark.range(300 * 210).select((F.col("id") / 210).cast("int").alias("row"), (F.col("id") % 210).cast("int").alias("col"), F.when(F.col("id") % 97 != 0, (F.col("id") * 7919 % 3001).cast("double") / 8).alias("value"))
    raster = Raster(px, 44.0, 40.5, 0.001, 210, 300, 0.0005)
    written = geotiff.write_geotiff(raster, str(tmp_path / "dem"), side=128, tile=32).collect()
    assert len(written) == 6 and sum(r.pixels for r in written) == 300 * 210
    back = geotiff.load_geotiff(spark, str(tmp_path / "dem"), pixels=1)
    assert (back.width, back.height) == (210, 300) and (back.west, back.north, back.px, back.dlat) == pytest.approx((44.0, 40.5, 0.001, 0.0005))
    assert back.pixels.exceptAll(px).isEmpty() and px.exceptAll(back.pixels).isEmpty()
    assert back.pixels.rdd.getNumPartitions() == sum(-(-(min(300, r + 128) - r) // 32) * -(-(min(210, c + 128) - c) // 32) for r in (0, 128, 256) for c in (0, 128))
    window = back.window(40.5 - 0.0005 * 39.5, 44.0301, 40.5 - 0.0005 * 33.5, 44.0702)
    assert window.rdd.getNumPartitions() == 3  # one row of blocks, three columns
    assert sorted(map(tuple, window.collect())) == sorted(map(tuple, px.where("row between 33 and 39 and col between 30 and 70").collect()))
    assert back.pixels.where("row = 1000").count() == 0 and back.pixels.where("row in (5, 290) and col = 7").count() == 2
