"""Media columns: signature sniffing of bytes.

An Aho-Corasick automaton finds every magic number in one pass; a validator of the format then checks its
structure (chunk chains, checksums, header fields) and computes the length, so a magic number that merely
occurs in other data is rejected. ``sniff`` corrects a declared type by what starts at offset 0 and carves
media that is embedded further in; ``store`` and ``samples`` write and read back lossless 8-bit samples.

Null or empty bytes have no media: type null, no finds. Overlapping candidates: the earliest start wins, then
the longest; media inside accepted media is reported as nested and not carved again. Very long values are
scanned whole. Extra columns pass through; result columns with a clashing name replace nothing but raise.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import arrow_rows, col, stage, texts_of

UNIT = 192
_CACHE: dict[str, object] = {}


def _png(b: bytes, at: int) -> int | None:
    """Chunks from IHDR to IEND, each with its checksum."""
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, pos)
        end = pos + 12 + size
        if end > len(b) or first and (kind != b"IHDR" or size != 13):
            return None
        if zlib.crc32(b[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end - at if size == 0 else None
        pos, first = end, False
    return None


def _riff(b: bytes, at: int) -> int | None:
    if at + 12 > len(b):
        return None
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    if size < 12 or at + size > len(b) or b[at + 8 : at + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    pos, end, kinds = at + 12, at + size, set()
    while pos + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, pos)
        kinds.add(kind)
        pos += 8 + n + n % 2
    wanted = {b"WAVE": {b"fmt ", b"data"}, b"WEBP": set(), b"AVI ": {b"LIST"}}[b[at + 8 : at + 12]]
    return size if pos in (end, end + 1) and kinds and wanted <= kinds else None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, reserved, start, header, width, height, planes, depth, packing, pixels = struct.unpack_from("<IIIIiiHHII", b, at + 2)
    if reserved or header not in (40, 52, 56, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or width <= 0 or height == 0 or at + size > len(b):
        return None
    row = (width * depth + 31) // 32 * 4
    return size if 14 + header <= start <= size and (packing or start + row * abs(height) <= size) else None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1 - at
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 < len(b):
            pos = blocks(pos + 11 + (3 << ((b[pos + 9] & 7) + 1) if b[pos + 9] & 128 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        kind = b[pos + 1]
        size = struct.unpack_from(">H", b, pos + 2)[0]
        if size < 2 or pos + 2 + size > len(b) or not (0xC0 <= kind <= 0xFE):
            return None
        pos += 2 + size
        if kind == 0xDA:
            end = b.find(b"\xff\xd9", pos)
            return end + 2 - at if end >= 0 else None
    return None


def _gzip(b: bytes, at: int) -> int | None:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    try:
        d = zlib.decompressobj(31)
        rest = memoryview(b)[at:]
        while rest and not d.eof:
            d.decompress(rest, 1 << 16)
            rest = d.unconsumed_tail
        return len(b) - at - len(d.unused_data) if d.eof else None
    except zlib.error:
        return None


def _zip(b: bytes, at: int) -> int | None:
    """From the first local header to the end of central directory that points back to it."""
    pos = b.find(b"PK\x05\x06", at)
    while pos >= 0 and pos + 22 <= len(b):
        size, offset, note = struct.unpack_from("<IIH", b, pos + 12)
        if at + offset + size == pos and b[at + offset : at + offset + 4] in (b"PK\x01\x02", b"PK\x05\x06") and pos + 22 + note <= len(b):
            return pos + 22 + note - at
        pos = b.find(b"PK\x05\x06", pos + 1)
    return None


def _pdf(b: bytes, at: int) -> int | None:
    end = b.find(b"%%EOF", at)
    return end + 5 - at if end >= 0 and b.find(b"startxref", at, end) >= 0 else None


def _snd(b: bytes, at: int) -> int | None:
    if at + 24 > len(b):
        return None
    start, size, coding, rate, channels = struct.unpack_from(">5I", b, at + 4)
    total = start + size
    return total if 24 <= start <= 1 << 16 and 1 <= coding <= 27 and rate and 1 <= channels <= 64 and at + total <= len(b) else None


#: Magic numbers (fixed values of the formats): bytes, type, validator.
FORMATS: tuple[tuple[bytes, str, Callable[[bytes, int], int | None]], ...] = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"RIFF", "riff", _riff),
    (b"BM", "image/bmp", _bmp),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"%PDF-", "application/pdf", _pdf),
    (b".snd", "audio/basic", _snd),
)
_RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}


def _automaton():
    if "a" not in _CACHE:
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, (magic, _, _) in enumerate(FORMATS):
            a.add_word(magic.decode("latin-1"), (k, len(magic)))
        a.make_automaton()
        _CACHE["a"] = a
    return _CACHE["a"]


def find_media(b: bytes) -> list[tuple[str, int, int, bool]]:
    """(type, offset, length, nested) of every confirmed medium, by offset."""
    found, end = [], 0
    for last, (k, size) in _automaton().iter(b.decode("latin-1")):
        at = last - size + 1
        length = FORMATS[k][2](b, at)
        if length is not None:
            kind = _RIFF_TYPES[b[at + 8 : at + 12]] if FORMATS[k][1] == "riff" else FORMATS[k][1]
            found.append((kind, at, length))
    out = []
    for kind, at, length in sorted(found, key=lambda f: (f[1], -f[2])):
        out.append((kind, at, length, at < end))
        end = max(end, at + length)
    return out


def sniff(df: DataFrame, bytes_col: str, declared_col: str | None = None) -> DataFrame:
    """Adds media_type (corrected), declared_ok and finds: array of (type, offset, length, nested, content).

    media_type is the medium at offset 0, or the declared type if none starts there; content is null for
    nested finds and for the one at offset 0 that fills the value (it is the value itself).
    """
    find = "array<struct<type:string,offset:bigint,length:bigint,nested:boolean,content:binary>>"
    names = [f.name for f in df.schema.fields]
    clash = {"media_type", "declared_ok", "finds"} & set(names)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    kinds = ", ".join("`" + f.name.replace("`", "``") + "` " + f.dataType.simpleString() for f in df.schema.fields)
    kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("nested", pa.bool_()), ("content", pa.binary())]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        types, right, finds = [], [], []
        declared = b.column(names.index(declared_col)).to_pylist() if declared_col else [None] * b.num_rows
        for value, said in zip(b.column(names.index(bytes_col)).to_pylist(), declared, strict=True):
            here = find_media(value) if value else []
            first = here[0][0] if here and here[0][1] == 0 else None
            types.append(first or said)
            right.append(None if said is None or first is None else said == first)
            finds.append([{"type": k, "offset": at, "length": n, "nested": inner, "content": None if inner or n == len(value) else value[at : at + n]} for k, at, n, inner in here])
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(types, pa.string()), pa.array(right, pa.bool_()), pa.array(finds, kind)], names=[*names, "media_type", "declared_ok", "finds"])

    return arrow_rows(df, run, f"{kinds}, media_type string, declared_ok boolean, finds {find}")


def _wav(data: bytes) -> bytes:
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(data)) + data


def _bmp_of(data: bytes) -> bytes:
    height, start = len(data) // UNIT, 54 + 1024
    head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", start + len(data), 0, start, 40, UNIT, -height, 1, 8, 0, len(data), 2835, 2835, 256, 0)
    return head + b"".join(bytes((g, g, g, 0)) for g in range(256)) + data


def _png_of(data: bytes) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.frombuffer(data, np.uint8).reshape(-1, UNIT)
    body = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body, 0)) + chunk(b"IEND", b"")


_WRITERS = {"audio/wav": _wav, "image/bmp": _bmp_of, "image/png": _png_of}


def store(data: bytes) -> tuple[str, bytes]:
    """The payload as 8-bit samples; the format goes by the payload's checksum, so equal payloads are equal files."""
    kind = sorted(_WRITERS)[zlib.crc32(data) % len(_WRITERS)]
    return kind, _WRITERS[kind](data)


def samples(kind: str, b: bytes) -> bytes:
    """The samples of a file of store()."""
    if kind == "audio/wav":
        return b[44 : 44 + struct.unpack_from("<I", b, 40)[0]]
    if kind == "image/bmp":
        return b[struct.unpack_from("<I", b, 10)[0] : struct.unpack_from("<I", b, 2)[0]]
    width, height = struct.unpack_from(">II", b, 16)
    body, pos = b"", 8
    while pos < len(b):
        size, name = struct.unpack_from(">I4s", b, pos)
        if name == b"IDAT":
            body += b[pos + 8 : pos + 8 + size]
        pos += size + 12
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, declared (what a careless uploader says), media: written to the shared folder and read back."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sizes, media = [], []
        for t in texts_of(b):
            data = t.encode("utf-8", "replace")
            sizes.append(len(data))
            media.append(store(data + b" " * ((-len(data)) % UNIT if data else UNIT))[1])
        said = pa.array(["application/octet-stream"] * b.num_rows)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), said, pa.array(media, pa.large_binary()).cast(pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return stage(arrow_rows(rows, run, f"doc_id {kind}, n_bytes long, declared string, media binary"), "media-stored")


def digests(sniffed: DataFrame) -> DataFrame:
    """Digests and features of sniffed media: what op2 reports of each stored file."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for kind, media in zip(b.column("media_type").to_pylist(), b.column("media").to_pylist(), strict=True):
            data = samples(kind, media)
            counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
            share = counts[counts > 0] / len(data)
            mean = float(counts @ np.arange(256)) / len(data)
            out["payload_bytes"].append(len(data))
            out["payload_sha256"].append(hashlib.sha256(data).hexdigest())
            out["tail_crc32"].append(zlib.crc32(data[-16:]))
            out["media_bytes"].append(len(media))
            out["media_sha256"].append(hashlib.sha256(media).hexdigest())
            out["feature"].append(f"{kind};levels={int((counts > 0).sum())};mean={mean:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f}")
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)), b.column("media_type")], names=["doc_id", "n_bytes", *out, "media_type"])

    kind = sniffed.schema["doc_id"].dataType.simpleString()
    rows = sniffed.select("doc_id", "n_bytes", "media", "media_type")
    return arrow_rows(rows, run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string")
