"""Best-two-fit packing of documents into token sequences of a fixed capacity.

A document is its token ids followed by an end id; only documents longer than the capacity are cut.
Pieces are dealt into groups by a hash and each group is packed: fill a sequence greedily with the longest
piece that fits, then replace its smallest piece by two unpacked pieces that fit the expanded gap more
tightly. Sequences that stay loose are dissolved and packed again with those of other groups, level by
level, as long as that helps, so no task ever holds more than ``group_pieces`` pieces or so.

Null and empty texts are the end id alone (length 1). Very long texts are cut into full pieces plus a rest.
Repeated rows are packed as often as they occur. An empty table gives an empty table. Ties between pieces
of one length go by document id and piece number. A null id is kept.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import TASK_CACHES, col, end_task, give_back, ship, stage, texts_of

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"

# The vocabulary's own splitting rule, restricted to characters below U+0250; other texts go to the library whole.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc\xbd\xbe", r"\t-\r \x85\xa0"
_PARTS = re.compile(f"[{_L}]+|[{_N}]|'s|'t|'re|'ve|'m|'ll|'d|[^{_S}{_L}{_N}]+")
_BEYOND = re.compile("[^\x00-ɏ]")
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
_MODELS: dict[str, tuple] = {}
TASK_CACHES.append(_MODELS)
_TAIL = frozenset(".,;:!?|*#%&$")
# The rules of the vocabulary file that _PARTS and _plain restate; with others the library takes whole texts.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_PARTS_MAX, _WORDS_MAX = 200_000, 60_000


def _visible_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table, n = {}, 0
    for b in range(256):
        table[b] = chr(b) if b in kept else chr(256 + n)
        n += b not in kept
    return table


_VISIBLE = _visible_bytes()


def _tokenizer(path: str) -> tuple:
    """The library's tokenizer, its model, whether its rules are the expected ones, and the bounded caches of parts and
    of words, kept over the batches of a task."""
    if path not in _MODELS:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        expected = all(said.get(k) == v for k, v in _RULES.items()) and all(t["content"].startswith("<|") for t in said.get("added_tokens") or [])
        _MODELS[path] = (whole, whole.model, expected, {}, {})
    return _MODELS[path]


def _part_ids(model, part: str) -> bytes:
    """Ids of one part, by the library's model."""
    shown = part.encode("utf-8", "replace").decode("latin-1").translate(_VISIBLE)
    ids = [t.id for t in model.tokenize(shown)]
    return struct.pack(f"<{len(ids)}I", *ids)


def _plain(text: str) -> bool:
    """Whether splitting by _PARTS is what the library does with this text."""
    return not any(x in text for x in _ODD) and (text.isascii() or _BEYOND.search(text) is None)


def encode(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers, equal to the library's encode.

    Words and their parts are looked up in caches of a bounded size, so the library encodes each new part
    once and a frequent word costs one dictionary access.
    """
    whole, model, expected, parts, words = _tokenizer(path)
    if len(parts) > _PARTS_MAX:
        parts.clear()
    if len(words) > _WORDS_MAX:
        words.clear()
    plain = [expected and _plain(t) for t in texts]
    split = [(t.lower().replace("\x85", " ").replace("\xa0", " ") if not t.isascii() else t.lower()).split() if p else [] for t, p in zip(texts, plain, strict=True)]
    for w in set().union(*split).difference(words):
        if w.isalpha():
            cut = (w,)
        elif w[-1] in _TAIL and w[:-1].isalpha():
            cut = (w[:-1], w[-1])
        else:
            cut = _PARTS.findall(w)
        ids = b""
        for p in cut:
            found = parts.get(p)
            if found is None:
                found = parts[p] = _part_ids(model, p)
            ids += found
        words[w] = ids
    get = words.__getitem__
    return [b"".join(map(get, ws)) if p else np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, p, ws in zip(texts, plain, split, strict=True)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, rows: int = 500) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document; rows texts are encoded at a time."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                b = whole.slice(lo, rows)
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encode(texts_of(b), tokenizer_path)):
                    ids += end
                    n = len(ids) // 4
                    for k, s in enumerate(range(0, n, capacity)):
                        part = ids[4 * s : 4 * (s + capacity)]
                        row.append(i), piece.append(k), start.append(s), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
                give_back()
        end_task()

    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, PIECES.format(id=kind))


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number and offset of each length, and the room left in each bin.

    Available lengths are the bits of one integer, so the longest that fits a gap is one bit operation.
    """
    stacks: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        stacks.setdefault(int(lengths[i]), []).append(i)
    mask = 0
    for s in stacks:
        mask |= 1 << s
    bins, offsets, rooms = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []

    def take(s: int) -> int:
        nonlocal mask
        stack = stacks[s]
        i = stack.pop()
        if not stack:
            mask ^= 1 << s
        return i

    def give(s: int, i: int) -> None:
        nonlocal mask
        stacks[s].append(i)
        mask |= 1 << s

    def below(most: int) -> int:
        return (mask & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 else -1

    while mask:
        room, inside = capacity, []
        while room and (s := below(room)) > 0:
            inside.append((s, take(s)))
            room -= s
        if room and mask:
            small, owner = inside[-1]
            space, best, pair = room + small, small, None
            a = below(space - 1)
            while a > 0 and 2 * a > best and best < space:
                b = below(min(a, space - a))
                if b == a and len(stacks[a]) < 2:
                    b = below(a - 1)
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                a = below(a - 1)
            if pair:
                inside.pop()
                for s in pair:
                    inside.append((s, take(s)))
                give(small, owner)
                room = space - best
        at, number = 0, len(rooms)
        for s, i in inside:
            bins[i], offsets[i] = number, at
            at += s
        rooms.append(room)
    return bins, offsets, np.array(rooms, np.int64)


def _packer(capacity: int, level: int, slack: int) -> Callable[[pa.Table], pa.Table]:
    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        group = t.column("grp")[0].as_py()
        bins, offsets, rooms = best_two_fit(t.column("length").to_numpy(), capacity)
        loose = np.flatnonzero(rooms > slack)
        t = t.drop_columns(["grp"]).append_column("sequence_id", pa.array((level << 56) + (group << 24) + bins)).append_column("offset", pa.array(offsets))
        return t.append_column("loose", pa.array(np.isin(bins, loose)))

    return pack


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = 3000, again_pieces: int = 250, slack: int = 128) -> DataFrame:
    """Every piece of every document with its sequence_id and its gapless offset there.

    group_pieces: pieces that one task packs together at first, again_pieces: at the later levels, each
    within a factor of about two; slack: unused tokens from which a sequence counts as loose and is packed
    again, as long as that halves what is loose.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    todo = stage(pieces(docs, tokenizer_path, capacity, id_col, text_col), "pack-pieces")
    n, level, done = todo.count(), 0, []
    groups = max(1, -(-n // group_pieces))
    while True:
        dealt = todo.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(groups)).cast("long"))
        packed = dealt.groupBy("grp").applyInArrow(_packer(capacity, level, slack if groups > 1 else capacity), PACKED.format(id=kind) + ", loose boolean")
        packed = stage(packed, "pack-level")
        left = packed.where("loose").count() if groups > 1 else 0
        if not left or 2 * left > n:
            done.append(packed.drop("loose"))
            break
        done.append(packed.where(~F.col("loose")).drop("loose"))
        todo = packed.where("loose").drop("loose", "sequence_id", "offset")
        n, level = left, level + 1
        groups = max(1, -(-n // again_pieces))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnRenamed("doc_id", id_col)
