"""GeoTIFF rasters: a Spark data source that reads blocks, and a sink that writes a mosaic of files.

A file's directory says where its strips or tiles lie and how they are packed; the source
makes partitions of neighbouring blocks, drops blocks that filters on row and col exclude before a
byte of them is read, and decodes the others in its tasks.  Of a file's bands the first is read.
No-data values are null; so are values that are not a number.  A folder is a mosaic: its files share one pixel
size and their corners lie on one lattice; rows and columns count from the mosaic's north-west corner.

Paths are read by Arrow's file systems (local, or a URI that they know) on the executors too.
"""

from __future__ import annotations

import dataclasses
import math
import struct
import zlib
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from meshwright.operators.dem import Raster

#: Pixels that a partition holds at least, where there are as many.
PIXELS = 1 << 20
# Fixed values of the format: field types (code to struct letter), tags, compression schemes.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _STRIPS, _SAMPLES, _STRIP_ROWS, _STRIP_BYTES, _PLANAR = 256, 257, 258, 259, 273, 277, 278, 279, 284
_PREDICTOR, _TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_BYTES, _FORMAT = 317, 322, 323, 324, 325, 339
_SCALE, _TIEPOINT, _TRANSFORM, _NO_DATA = 33550, 33922, 34264, 42113
_PLAIN, _LZW, _DEFLATE = (1,), (5,), (8, 32946)
#: Sample formats: unsigned, signed, floating point.
_KINDS = {1: "u", 2: "i", 3: "f"}
SCHEMA = "row int, col int, value double"


def opened(path: str) -> tuple[files.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return files.FileSystem.from_uri(path) if "://" in path else (files.FileSystem.from_uri("file://" + path) if path.startswith("/") else (files.LocalFileSystem(), path.removeprefix("file:")))


@dataclasses.dataclass(frozen=True)
class Layout:
    """What a file's directory says; ``blocks`` are (offset, bytes), row by row of blocks."""

    path: str
    width: int
    height: int
    block_width: int
    block_height: int
    blocks: tuple[tuple[int, int], ...]
    dtype: str
    compression: int
    predictor: int
    samples: int
    no_data: float | None
    west: float
    north: float
    dx: float
    dy: float

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    def box(self, block: int) -> tuple[int, int, int, int]:
        """First row, row after the last, first column and column after the last of a block."""
        r, c = divmod(block, self.across)
        r, c = r * self.block_height, c * self.block_width
        return r, min(r + self.block_height, self.height), c, min(c + self.block_width, self.width)


def _fields(handle: Any) -> tuple[str, dict[int, tuple]]:
    """The byte order and the fields of a file's first directory."""
    head = handle.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack(f"{order}H", head[2:4])[0] == 43
    at = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
    size, count, entry, word = (20, 8, "HHQ8s", "Q") if big else (12, 2, "HHI4s", "I")
    handle.seek(at)
    n = struct.unpack(order + ("Q" if big else "H"), handle.read(count))[0]
    rows = handle.read(size * n)
    found = {}
    for i in range(n):
        tag, kind, many, inline = struct.unpack_from(order + entry, rows, i * size)
        letter = _TYPES.get(kind)
        if letter is None:
            continue
        length = struct.calcsize(letter) * many
        if length > len(inline):
            handle.seek(struct.unpack(order + word, inline)[0])
            inline = handle.read(length)
        found[tag] = (inline[:many],) if letter == "s" else struct.unpack_from(f"{order}{many}{letter}", inline)
    return order, found


def layout(path: str) -> Layout:
    """The layout of a file; an error where its grid is turned, its bands lie in planes or its packing is not known."""
    system, name = opened(path)
    with system.open_input_file(name) as handle:
        order, found = _fields(handle)
    one = lambda tag, default: found.get(tag, (default,))[0]
    width, height, samples = one(_WIDTH, 0), one(_HEIGHT, 0), one(_SAMPLES, 1)
    kind = _KINDS.get(one(_FORMAT, 1))
    if kind is None or one(_BITS, 1) % 8 or (samples > 1 and one(_PLANAR, 1) != 1):
        raise ValueError(f"{path}: sample format {one(_FORMAT, 1)} of {one(_BITS, 1)} bits in planes {one(_PLANAR, 1)} is not read")
    if one(_COMPRESSION, 1) not in (*_PLAIN, *_LZW, *_DEFLATE):
        raise ValueError(f"{path}: compression {one(_COMPRESSION, 1)} is not read")
    if _TILES in found:
        shape, blocks = (one(_TILE_WIDTH, 0), one(_TILE_HEIGHT, 0)), zip(found[_TILES], found[_TILE_BYTES], strict=True)
    else:
        shape, blocks = (width, min(one(_STRIP_ROWS, height), height)), zip(found[_STRIPS], found[_STRIP_BYTES], strict=True)
    if _TRANSFORM in found:
        t = found[_TRANSFORM]
        if t[1] or t[4]:
            raise ValueError(f"{path}: a turned grid is not read")
        west, north, dx, dy = t[3], t[7], t[0], -t[5]
    elif _SCALE in found and _TIEPOINT in found:
        dx, dy = found[_SCALE][:2]
        col, row, _, x, y, _ = found[_TIEPOINT][:6]
        west, north = x - col * dx, y + row * dy
    else:
        raise ValueError(f"{path} does not say where it lies")
    if dx <= 0 or dy <= 0:
        raise ValueError(f"{path}: north must be at the first row, west at the first column")
    no_data = found[_NO_DATA][0].split(b"\0")[0].strip() if _NO_DATA in found else b""
    return Layout(path, width, height, *shape, tuple(blocks), f"{order}{kind}{one(_BITS, 8) // 8}", one(_COMPRESSION, 1), one(_PREDICTOR, 1), samples, float(no_data) if no_data else None, west, north, dx, dy)


def unpacked_lzw(data: bytes) -> bytes:
    """Bytes of an LZW stream: codes of 9 to 12 bits, most significant bit first; 256 begins anew, 257 ends."""
    out, table, width, last = [], [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
    held, bits = 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            now = table[code]
        elif last:
            now = last + last[:1]
        else:
            raise ValueError("a broken LZW stream")
        out.append(now)
        if last:
            table.append(last + now[:1])
        last = now
        # codes grow one entry early
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def decoded(data: bytes, shape: Layout, block: int) -> np.ndarray:
    """The first band of a block, as doubles; what is no data is not a number."""
    rows = shape.block_height if shape.block_width < shape.width or len(shape.blocks) == 1 else min(shape.block_height, shape.height - block * shape.block_height)
    if shape.compression in _DEFLATE:
        data = zlib.decompress(data)
    elif shape.compression in _LZW:
        data = unpacked_lzw(data)
    dtype, width = np.dtype(shape.dtype), shape.block_width * shape.samples
    rows = min(rows, len(data) // (width * dtype.itemsize))
    if shape.predictor == 3:
        # bytes of a row by significance, each the difference to the one before
        planes = np.frombuffer(data, np.uint8, rows * width * dtype.itemsize).reshape(rows, -1, shape.samples)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, width)
        grid = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, shape.block_width, shape.samples)
    else:
        grid = np.frombuffer(data, dtype, rows * width).reshape(rows, shape.block_width, shape.samples)
        if shape.predictor == 2:
            grid = np.cumsum(grid, axis=1, dtype=dtype.newbyteorder("="))
    values = grid[:, :, 0].astype(np.float64)
    if shape.no_data is not None:
        values[values == (np.float32(shape.no_data) if dtype.kind == "f" and dtype.itemsize == 4 else shape.no_data)] = np.nan
    return values


@dataclasses.dataclass(frozen=True)
class Mosaic:
    """Files on one lattice: their layouts, each with the row and column of its first pixel."""

    parts: tuple[tuple[Layout, int, int], ...]
    west: float
    north: float
    dx: float
    dy: float
    width: int
    height: int


def mosaic(path: str) -> Mosaic:
    """The file of a path, or all files of a folder that end in .tif or .tiff."""
    system, name = opened(path)
    if system.get_file_info(name).type == files.FileType.Directory:
        prefix = path.rstrip("/")
        found = sorted(x.base_name for x in system.get_file_info(files.FileSelector(name)) if x.base_name.lower().endswith((".tif", ".tiff")))
        layouts = [layout(f"{prefix}/{x}") for x in found]
    else:
        layouts = [layout(path)]
    if not layouts:
        raise ValueError(f"{path} holds no GeoTIFF")
    dx, dy = layouts[0].dx, layouts[0].dy
    west, north = min(x.west for x in layouts), max(x.north for x in layouts)
    parts = []
    for x in layouts:
        row, col = (north - x.north) / dy, (x.west - west) / dx
        if abs(x.dx / dx - 1) > 1e-9 or abs(x.dy / dy - 1) > 1e-9 or abs(row - round(row)) > 1e-3 or abs(col - round(col)) > 1e-3:
            raise ValueError(f"{x.path} does not lie on the lattice of {layouts[0].path}")
        parts.append((x, round(row), round(col)))
    return Mosaic(tuple(parts), west, north, dx, dy, max(c + x.width for x, _, c in parts), max(r + x.height for x, r, _ in parts))


@dataclasses.dataclass
class Blocks(InputPartition):
    """Blocks of one file, whose first pixel has a row and a column in the mosaic."""

    shape: Layout
    row: int
    col: int
    blocks: tuple[int, ...]


class GeoTiffReader(DataSourceReader):
    """Reads the blocks that filters on row and col leave."""

    def __init__(self, path: str, pixels: int) -> None:
        self.path, self.pixels = path, pixels
        self.least: dict[str, float] = {"row": -math.inf, "col": -math.inf}
        self.most: dict[str, float] = {"row": math.inf, "col": math.inf}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Remember bounds of row and col; Spark still applies every filter to the rows."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else None
            if name in self.least:
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.least[name] = max(self.least[name], f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.most[name] = min(self.most[name], f.value)
                if isinstance(f, In):
                    known = [v for v in f.value if v is not None]
                    self.least[name] = max(self.least[name], min(known, default=math.inf))
                    self.most[name] = min(self.most[name], max(known, default=-math.inf))
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for shape, row, col in mosaic(self.path).parts:
            group, held = [], 0
            for block in range(len(shape.blocks)):
                r0, r1, c0, c1 = shape.box(block)
                if row + r1 <= self.least["row"] or row + r0 > self.most["row"] or col + c1 <= self.least["col"] or col + c0 > self.most["col"]:
                    continue
                group.append(block)
                held += (r1 - r0) * (c1 - c0)
                if held >= self.pixels:
                    out.append(Blocks(shape, row, col, tuple(group)))
                    group, held = [], 0
            if group:
                out.append(Blocks(shape, row, col, tuple(group)))
        return out or [Blocks(shape, row, col, ())]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        shape = partition.shape
        system, name = opened(shape.path)
        with system.open_input_file(name) as handle:
            for block in partition.blocks:
                offset, size = shape.blocks[block]
                r0, r1, c0, c1 = shape.box(block)
                if size:
                    values = decoded(handle.read_at(size, offset), shape, block)[: r1 - r0, : c1 - c0]
                else:
                    values = np.full((r1 - r0, c1 - c0), np.nan)  # a block that was never written
                rows, cols = np.indices(values.shape, dtype=np.int32)
                flat = values.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(rows.ravel() + np.int32(partition.row + r0)), pa.array(cols.ravel() + np.int32(partition.col + c0)), pa.array(flat, mask=np.isnan(flat))], ["row", "col", "value"])


class GeoTiff(DataSource):
    """``spark.read.format("geotiff").load(path)``: (row, col, value) of a file or a folder of files; option ``pixels``: the pixels of a partition."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> GeoTiffReader:
        return GeoTiffReader(self.options["path"], int(self.options.get("pixels", PIXELS)))


def load_geotiff(spark: SparkSession, path: str, pixels: int = PIXELS) -> Raster:
    """A raster over a GeoTIFF file or a folder of them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiff)
    found = mosaic(path)
    return Raster(spark.read.format("geotiff").option("pixels", pixels).load(path), found.west, found.north, found.dx, found.width, found.height, found.dy)


def encoded(values: np.ndarray, west: float, north: float, dx: float, dy: float, tile: int = 256, no_data: float = -9999.0) -> bytes:
    """A GeoTIFF of one band of 32-bit floats: tiles, deflated after the floating-point predictor; what is not a number is no data."""
    height, width = values.shape
    down, across = -(-height // tile), -(-width // tile)
    whole = np.full((down * tile, across * tile), no_data, np.float32)
    whole[:height, :width] = np.where(np.isnan(values), no_data, values)
    tiles = []
    for r in range(down):
        for c in range(across):
            part = np.ascontiguousarray(whole[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile].astype(">f4"))
            planes = part.view(np.uint8).reshape(tile, tile, 4).transpose(0, 2, 1).reshape(tile, -1)
            tiles.append(zlib.compress(np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes(), 6))
    text = f"{no_data:g}".encode() + b"\0"
    fields: list[tuple[int, int, int, bytes]] = []
    pack = lambda letter, *x: struct.pack(f"<{len(x)}{letter}", *x)
    # classic files have 32-bit places, which hold the files of a mosaic
    for tag, kind, letter, items in ((_WIDTH, 4, "I", [width]), (_HEIGHT, 4, "I", [height]), (_BITS, 3, "H", [32]), (_COMPRESSION, 3, "H", [8]), (262, 3, "H", [1]), (_SAMPLES, 3, "H", [1]), (_PLANAR, 3, "H", [1]), (_PREDICTOR, 3, "H", [3]), (_TILE_WIDTH, 3, "H", [tile]), (_TILE_HEIGHT, 3, "H", [tile]), (_TILES, 4, "I", [0] * len(tiles)), (_TILE_BYTES, 4, "I", [len(x) for x in tiles]), (_FORMAT, 3, "H", [3]), (_SCALE, 12, "d", [dx, dy, 0.0]), (_TIEPOINT, 12, "d", [0.0, 0.0, 0.0, west, north, 0.0])):
        fields.append((tag, kind, len(items), pack(letter, *items)))
    fields.append((_NO_DATA, 2, len(text), text))
    after = 8 + 2 + 12 * len(fields) + 4
    places, extra = [], b""
    for _, _, _, data in fields:
        places.append(after + len(extra))
        if len(data) > 4:
            extra += data + b"\0" * (len(data) % 2)
    starts = np.cumsum([after + len(extra)] + [len(x) for x in tiles])[:-1]
    rows = b""
    for (tag, kind, many, data), place in zip(fields, places, strict=True):
        if tag == _TILES:
            data = pack("I", *starts.tolist())
            if len(data) > 4:
                extra = extra[: place - after] + data + extra[place - after + len(data) :]
        rows += struct.pack("<HHI", tag, kind, many) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", place))
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(fields)) + rows + struct.pack("<I", 0) + extra + b"".join(tiles)


def write_geotiff(raster: Raster, folder: str, side: int = 4096, tile: int = 256) -> DataFrame:
    """Write a raster as a mosaic, a file for each square of ``side`` pixels with data in it: (path, pixels), one row a file.

    Each file is made by one task and named by its place, so that a task that is run again writes the same file.
    """
    west, north, dx, dy = raster.west, raster.north, raster.px, raster.dlat

    def write(group: pd.DataFrame) -> pd.DataFrame:
        r, c = int(group.row.iloc[0]) // side, int(group.col.iloc[0]) // side
        rows, cols = group.row.to_numpy() - r * side, group.col.to_numpy() - c * side
        # no wider than its data, but from the square's corner, so that all files lie on one lattice
        values = np.full((rows.max() + 1, cols.max() + 1), np.nan)
        values[rows, cols] = group.value.to_numpy(dtype=np.float64)
        path = f"{folder.rstrip('/')}/{r:06d}_{c:06d}.tif"
        system, name = opened(path)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(name) as out:
            out.write(encoded(values, west + c * side * dx, north - r * side * dy, dx, dy, tile))
        return pd.DataFrame({"path": [path], "pixels": [len(group)]})

    square = [F.floor(F.col(c) / side).alias(f"square_{c}") for c in ("row", "col")]
    return raster.pixels.select("row", "col", F.col("value").cast("double").alias("value"), *square).groupBy("square_row", "square_col").applyInPandas(write, "path string, pixels long")
