"""Uncompressed bitmaps as tile rows: a Python data source that reads bands of an image, not images.

``spark.read.format("bitmap_tiles").option("side", 256).option("halo", 2).load(folder)`` gives the
tile rows that the stencil operators take, with ``path`` instead of ``image_id``. A file is cut
into partitions by its size; each reads the header and the pixel rows of its own tiles only, so
no task and no row holds a whole large image.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumentab.session import ship_package

GEOMETRY = ["h", "w", "oy", "ox", "th", "tw", "hy", "hx", "hh", "hw"]
SCHEMA = "path string, read_ok boolean, " + ", ".join(f"{c} int" for c in GEOMETRY) + ", planes array<array<double>>"
ARROW = pa.schema([("path", pa.string()), ("read_ok", pa.bool_()), *((c, pa.int32()) for c in GEOMETRY), ("planes", pa.list_(pa.list_(pa.float64())))])
#: Bytes of a file that one partition reads, about.
BAND_BYTES = 8 << 20
HEADER = 54


def encode(planes: np.ndarray) -> bytes:
    """24-bit bitmap of ``(3, h, w)`` planes b, g, r, or of one gray ``(h, w)`` plane; rows bottom-up."""
    planes = np.broadcast_to(planes, (3, *planes.shape[-2:]))
    _, h, w = planes.shape
    stride = (3 * w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : 3 * w] = planes.transpose(1, 2, 0).reshape(h, 3 * w)
    head = b"BM" + struct.pack("<IHHI", HEADER + h * stride, 0, 0, HEADER)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, h * stride, 2835, 2835, 0, 0) + rows[::-1].tobytes()


class Bitmap:
    """Header of an open file and its pixel rows by number, counted from the top."""

    def __init__(self, file, size: int):
        head = file.read_at(HEADER, 0) if size >= HEADER else b""
        if len(head) < HEADER or head[:2] != b"BM":
            raise ValueError("no bitmap")
        (self.start,) = struct.unpack_from("<I", head, 10)
        self.w, self.h, planes, bits, packed = struct.unpack_from("<iiHHI", head, 18)
        self.bottom_up, self.h = self.h > 0, abs(self.h)
        self.bytes = bits // 8
        self.stride = (self.w * bits + 31) // 32 * 4
        if packed or bits not in (24, 32) or planes != 1 or self.w <= 0 or self.h == 0 or self.start + self.h * self.stride > size:
            raise ValueError("not an uncompressed 24- or 32-bit bitmap, or cut short")
        self.file = file

    def rows(self, a: int, b: int) -> np.ndarray:
        """Planes b, g, r of the rows from a to b."""
        first = self.h - b if self.bottom_up else a
        data = np.frombuffer(self.file.read_at((b - a) * self.stride, self.start + first * self.stride), np.uint8).reshape(b - a, self.stride)
        data = data[::-1] if self.bottom_up else data
        return data[:, : self.w * self.bytes].reshape(b - a, self.w, self.bytes)[:, :, :3].transpose(2, 0, 1)


class Band(InputPartition):
    def __init__(self, path: str, size: int, number: int, of: int):
        self.path, self.size, self.number, self.of = path, size, number, of


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


class TileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.side, self.halo = int(options.get("side", 256)), int(options.get("halo", 0))
        self.band = int(options.get("bandbytes", options.get("bandBytes", BAND_BYTES)))
        if self.side < 1 or self.halo < 0 or self.band < 1:
            raise ValueError("side and bandBytes have to be positive, halo not negative")

    def partitions(self) -> list[Band]:
        """Bands by file size alone; headers are read by the tasks."""
        store, place = _store(self.path)
        found = store.get_file_info(place)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(place, recursive=True))
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.type == fs.FileType.File and f.path.lower().endswith(".bmp"):
                of = max(1, -(-f.size // self.band))
                out += [Band(f.path, f.size, k, of) for k in range(of)]
        return out

    def read(self, partition: Band) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as file:
            try:
                bitmap = Bitmap(file, partition.size)
            except ValueError:
                if partition.number == 0:
                    yield pa.RecordBatch.from_pylist([{"path": partition.path, "read_ok": False}], schema=ARROW)
                return
            side, halo, h, w = self.side, self.halo, bitmap.h, bitmap.w
            lines = -(-h // side)
            for line in range(lines * partition.number // partition.of, lines * (partition.number + 1) // partition.of):
                oy = line * side
                hy, end = max(0, oy - halo), min(h, oy + side + halo)
                band = bitmap.rows(hy, end)
                for ox in range(0, w, side):
                    hx, to = max(0, ox - halo), min(w, ox + side + halo)
                    cells = band[:, :, hx:to].astype(np.float64)
                    place = dict(zip(GEOMETRY, (h, w, oy, ox, min(side, h - oy), min(side, w - ox), hy, hx, end - hy, to - hx)))
                    yield pa.RecordBatch.from_pylist([{"path": partition.path, "read_ok": True, **place, "planes": [p.ravel() for p in cells]}], schema=ARROW)


class BitmapTiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bitmap_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TileReader:
        return TileReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to this session."""
    ship_package(spark)
    spark.dataSource.register(BitmapTiles)


def read_tiles(spark: SparkSession, folder: str, side: int = 256, halo: int = 0, band_bytes: int = BAND_BYTES):
    """Tile rows of all bitmaps below ``folder``; a file that can't be read is one row with ``read_ok`` false."""
    register(spark)
    return spark.read.format("bitmap_tiles").option("side", side).option("halo", halo).option("bandBytes", band_bytes).load(folder)
