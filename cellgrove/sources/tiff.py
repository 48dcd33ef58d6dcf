"""One raster block as a GeoTIFF: tiles compressed with deflate, bands one after the other, nodata, tags and georeference.

Only what these rasters need of the format: little-endian classic TIFF (below 4 GB), one sample format for all bands,
tiles of each band on their own, so a window of one band reads only the tiles that it touches.
"""

from __future__ import annotations

import struct
import zlib
from xml.etree import ElementTree

import numpy as np

# Numbers of the TIFF and GeoTIFF tags used here.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR = 256, 257, 258, 259, 262, 277, 284
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34735, 42112, 42113
# Field types (bytes, shorts, longs, doubles) with their sizes, and sample formats.
_TYPES = {"ascii": (2, 1), "short": (3, 2), "long": (4, 4), "double": (12, 8)}
_FORMATS = {"u": 1, "i": 2, "f": 3}
#: WGS 84 in degrees: model type geographic, pixel is area, EPSG 4326
_WGS84 = (1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326)


def encode(bands: np.ndarray, names: list[str], tile: int, nodata: float, tags: dict[str, str], west: float, north: float, step: float) -> bytes:
    """bands (n, height, width) as the bytes of a file; west and north are the outer corner, step the size of a pixel."""
    n, height, width = bands.shape
    across, down = -(-width // tile), -(-height // tile)
    data = bytearray(b"II*\0\0\0\0\0")
    offsets, counts = [], []
    for band in bands.astype(bands.dtype.newbyteorder("<")):
        for r in range(down):
            for c in range(across):
                block = np.full((tile, tile), nodata, bands.dtype)
                part = band[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile]
                block[: part.shape[0], : part.shape[1]] = part
                raw = zlib.compress(block.tobytes(), 6)
                offsets.append(len(data))
                counts.append(len(raw))
                data += raw + b"\0" * (len(raw) % 2)
    root = ElementTree.Element("GDALMetadata")
    for k, v in sorted(tags.items()):
        ElementTree.SubElement(root, "Item", name=k).text = v
    for i, name in enumerate(names):
        ElementTree.SubElement(root, "Item", name="DESCRIPTION", sample=str(i), role="description").text = name
    fields = [
        (WIDTH, "long", [width]), (LENGTH, "long", [height]), (BITS, "short", [8 * bands.dtype.itemsize] * n), (COMPRESSION, "short", [8]), (PHOTOMETRIC, "short", [1]),
        (SAMPLES, "short", [n]), (PLANAR, "short", [2]), (TILE_WIDTH, "long", [tile]), (TILE_LENGTH, "long", [tile]), (TILE_OFFSETS, "long", offsets), (TILE_COUNTS, "long", counts),
        (SAMPLE_FORMAT, "short", [_FORMATS[bands.dtype.kind]] * n), (PIXEL_SCALE, "double", [step, step, 0.0]), (TIEPOINT, "double", [0.0, 0.0, 0.0, west, north, 0.0]), (GEO_KEYS, "short", list(_WGS84)),
        (METADATA, "ascii", ElementTree.tostring(root) + b"\0"), (NODATA, "ascii", f"{nodata:g}".encode() + b"\0"),
    ]
    entries = b""
    for tag, kind, values in sorted(fields):
        code, size = _TYPES[kind]
        raw = bytes(values) if kind == "ascii" else struct.pack(f"<{len(values)}{ {'short': 'H', 'long': 'I', 'double': 'd'}[kind]}", *values)
        if len(raw) > 4:
            at = len(data)
            data += raw + b"\0" * (len(raw) % 2)
            raw = struct.pack("<I", at)
        entries += struct.pack("<HHI", tag, code, len(values)) + raw.ljust(4, b"\0")
    struct.pack_into("<I", data, 4, len(data))
    data += struct.pack("<H", len(fields)) + entries + b"\0\0\0\0"
    if len(data) >= 1 << 32:
        raise ValueError("a block of 4 GB or more: take smaller blocks")
    return bytes(data)


class Header:
    """What a file's directory says; file is seekable, and only the directory and its values are read."""

    def __init__(self, file):
        self.file = file
        if self._read(0, 4) != b"II*\0":
            raise ValueError("not a little-endian classic TIFF")
        (at,) = struct.unpack("<I", self._read(4, 4))
        (n,) = struct.unpack("<H", self._read(at, 2))
        raw, f = self._read(at + 2, 12 * n), {}
        sizes, letters = {code: size for code, size in _TYPES.values()}, {2: "s", 3: "H", 4: "I", 12: "d"}
        for i in range(n):
            tag, code, count = struct.unpack_from("<HHI", raw, 12 * i)
            if code in sizes:
                size = sizes[code] * count
                value = raw[12 * i + 8 : 12 * i + 8 + size] if size <= 4 else self._read(struct.unpack_from("<I", raw, 12 * i + 8)[0], size)
                f[tag] = value if code == 2 else struct.unpack(f"<{count}{letters[code]}", value)
        self.width, self.height, self.tile = f[WIDTH][0], f[LENGTH][0], f[TILE_WIDTH][0]
        self.offsets, self.counts = f[TILE_OFFSETS], f[TILE_COUNTS]
        kind = {v: k for k, v in _FORMATS.items()}[f[SAMPLE_FORMAT][0]]
        self.dtype = np.dtype(f"<{kind}{f[BITS][0] // 8}")
        self.nodata = float(f[NODATA].rstrip(b"\0"))
        self.west, self.north, self.step = f[TIEPOINT][3], f[TIEPOINT][4], f[PIXEL_SCALE][0]
        items = ElementTree.fromstring(f[METADATA].rstrip(b"\0").decode())
        self.names = [i.text for i in items if i.get("role") == "description"]
        self.tags = {i.get("name"): i.text for i in items if i.get("role") is None}
        self.across, self.down = -(-self.width // self.tile), -(-self.height // self.tile)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def tile_of(self, band: int, r: int, c: int) -> np.ndarray:
        k = (band * self.down + r) * self.across + c
        return np.frombuffer(zlib.decompress(self._read(self.offsets[k], self.counts[k])), self.dtype).reshape(self.tile, self.tile)

    def window(self, band: int, row0: int, row1: int, col0: int, col1: int) -> tuple[np.ndarray, int]:
        """The pixels [row0, row1) x [col0, col1) of a band, and how many tiles were read for them."""
        out, read, t = np.empty((row1 - row0, col1 - col0), self.dtype), 0, self.tile
        for r in range(row0 // t, -(-row1 // t)):
            for c in range(col0 // t, -(-col1 // t)):
                block = self.tile_of(band, r, c)
                read += 1
                a, b, x, y = max(row0, r * t), min(row1, (r + 1) * t), max(col0, c * t), min(col1, (c + 1) * t)
                out[a - row0 : b - row0, x - col0 : y - col0] = block[a - r * t : b - r * t, x - c * t : y - c * t]
        return out, read
