"""WARC archives: writing with revisits, and reading by boundary-chain verification.

Writing: a record is one row of text whose line separator is the record's trailing CRLF CRLF, so Spark's own
text writer makes the files. Equal payloads of at least ``MIN_REVISIT`` bytes are stored once, by the
largest id; the others are revisit records that name it.

Reading: Spark's text reader, with the magic line as separator, cuts the splits of the files into pieces.
Tasks turn each piece into a candidate: the offset where a record would start and the offset of its
successor, from the header's Content-Length. A payload may contain the magic line, so only candidates that
are reached from the start of their file count: chains are followed inside a split by the task, then over
splits by pointer jumping (joins that double the distance each round). Payloads are digested where they lie
in one split; those that run over false boundaries or splits are put together in a second, filtered read.

Null payloads are empty, null urls leave out the url header, null ids the id header; control characters and
spaces in urls are percent-encoded. Very long payloads may span splits. Rows that repeat an id are records
of their own; of those that hold the largest id of a payload all are responses. An empty table writes no records; a file without a valid first record gives none. Archives
that are cut off lose the last record.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from cellgrove.llm.common import col, scratch, ship, stage

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
MIN_REVISIT = 1000
_DATE = "2024-01-01T00:00:00Z"
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")
#: a block of more bytes than this is none: such a length stands in a payload only
_MOST = 1 << 40


def _number(text: str | bytes | None) -> int | None:
    """A whole number as Spark's long holds it; None for anything else."""
    if text is None or not re.fullmatch(rb"-?[0-9]{1,19}", text.encode("utf-8", "replace") if isinstance(text, str) else text):
        return None
    n = int(text)
    return n if -(1 << 63) <= n < 1 << 63 else None


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(id, digest, refers_to) of the records whose payload is stored under another id: ids and digests only."""
    payload = col(payload_col).cast("binary")
    rows = pages.where(F.octet_length(col(payload_col)) >= MIN_REVISIT).select(col(id_col).cast("long").alias("id"), F.unhex(F.sha1(payload)).alias("digest"))
    rows = stage(rows, "warc-digests")
    last = stage(rows.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("k")).where("k > 1").select("digest", "refers_to"), "warc-repeated")
    return stage(rows.join(last, "digest").where("id <> refers_to").select("id", "digest", "refers_to").distinct(), "warc-revisits")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write the archives: one file per task; ids are whole numbers, others are refused. Payloads stay in place where the table of revisits is small enough for the
    session's broadcast threshold; else they are shuffled once, by id and digest."""
    if not isinstance(pages.schema[id_col].dataType, ByteType | ShortType | IntegerType | LongType):
        raise TypeError(f"{id_col} must be a whole number, not {pages.schema[id_col].dataType.simpleString()}")
    again = revisits(pages, id_col, payload_col)
    rows = pages.select(col(id_col).cast("long").alias("id"), F.regexp_replace(col(url_col), "[\\x00-\\x20\\x7F]", "%20").alias("url"), F.coalesce(col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.col("payload").cast("binary")))).join(again, ["id", "digest"], "left")
    is_revisit = F.col("refers_to").isNotNull()
    digest, size = F.lower(F.hex("digest")), F.octet_length("payload")

    def record_id(c):
        h = F.md5(c.cast("string").cast("binary"))
        return F.concat(F.lit("<urn:uuid:"), h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-"), h.substr(13, 4), F.lit("-"), h.substr(17, 4), F.lit("-"), h.substr(21, 12), F.lit(">"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("payload")))
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Date: {_DATE}\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:"), digest,
        F.coalesce(F.concat(F.lit("\r\nWARC-Record-ID: "), record_id(F.col("id")), F.lit("\r\nX-Page-ID: "), F.col("id").cast("string")), F.lit("")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("url")), F.lit("")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), record_id(F.col("refers_to")), F.lit("\r\nX-Refers-To-Page-ID: "), F.col("refers_to").cast("string")), F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two magic lines, with its file and split; in order within a split."""
    found = spark.read.option("lineSep", MAGIC).text(path)
    return found.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("piece"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """The pieces of each split in turn."""
    from itertools import groupby

    def rows():
        for b in batches:
            for file, split, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                yield file, split, piece.as_py()

    for (file, split), group in groupby(rows(), key=lambda r: (r[0], r[1])):
        yield file, split, (r[2] for r in group)


def _parse(piece: bytes) -> tuple[int, int, dict[str, str]] | None:
    """Header length (with the blank line), block length and fields, if the piece starts with a record's header."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    found = _LENGTH.search(piece, 0, end)
    need = _number(found[1]) if found else None
    if need is None or need > _MOST:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return end + 4, need, fields


def _payload(block: bytes) -> tuple[int, bytes, str | None]:
    """Offset of the payload in an HTTP block, the payload, and the length that a revisit states."""
    end = block.find(b"\r\n\r\n") + 4
    if not block.startswith(b"HTTP/") or end < 4:
        return 0, block, None
    said = re.search(rb"(?im)^x-payload-length:[ \t]*(\d+)", block[:end])
    return end, block[end:], said[1].decode() if said else None


_CANDIDATE = "file string, split long, at long, next long, exit long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, whole boolean"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece: offsets from the split's first piece, the chain's exit from the split, and the record's digest.

    A header that a magic line cuts (a url may end in one) is put together in its split, too.
    A row with at = -1 states the bytes that the split's pieces span. A block that false boundaries cut is
    put together here while it lasts in this split; whole tells whether it was.
    """
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    names = [f.split()[0] for f in _CANDIDATE.split(", ")]
    magic = len(MAGIC)
    for file, split, pieces in _runs(batches):
        rows: list[list] = []
        waiting: list[tuple[int, int, int, list]] = []  # heap of open blocks: end and start in the split, a number, row
        buffer, base = bytearray(), 0  # the split's bytes from the first open block's start on: one copy for all
        heads: list[tuple[list, list[bytes]]] = []  # row, bytes so far of a header without its end
        total, first = 0, True

        def begin(row: list, piece: bytes) -> bool:
            nonlocal buffer, base
            head = _parse(piece)
            if head is None:
                return False
            start, need, fields = head
            row[3] = row[2] + start + need + 4 + magic
            row[5] = _number(fields.get("x-page-id"))
            row[6] = fields.get("warc-type")
            row[7] = _number(fields.get("x-refers-to-page-id"))
            row[9] = fields.get("warc-payload-digest", "").removeprefix("sha1:") if row[6] == "revisit" else None
            body = piece[start:]
            if len(body) >= need:
                _close(row, body, need)
            else:
                if not waiting:
                    buffer, base = bytearray(body), row[2] + start
                heapq.heappush(waiting, (row[2] + start + need, row[2] + start, row[2], row))
            return True

        for piece in pieces:
            # the first piece of a file is empty; later splits start behind a magic line that the split before read
            at, skip = total, first and split == 0
            total += len(piece) + magic
            if waiting:
                buffer += MAGIC.encode() + piece
            while waiting and waiting[0][0] + 4 <= base + len(buffer):
                to, since, _, row = heapq.heappop(waiting)
                _close(row, bytes(buffer[since - base : to + 4 - base]), to - since)
            for _, parts in heads:
                parts.append(piece)
            if b"\r\n\r\n" in piece or piece.startswith(b"\r\n"):  # a magic line ends in a line break itself
                for row, parts in heads:
                    begin(row, MAGIC.encode().join(parts))
                heads = []
            first = False
            if skip:
                continue
            row = [file, split, at, None, None, None, None, None, None, None, False]
            rows.append(row)
            if not begin(row, piece) and b"\r\n\r\n" not in piece and b":" in piece.split(b"\r\n", 1)[0]:
                heads.append((row, [piece]))
        starts = {row[2]: row for row in rows}
        for row in reversed(rows):  # where the chain from here leaves the split (total and beyond)
            to = row[3]
            row[4] = to if to is None or to >= total else (starts[to][4] if to in starts else None)
        rows.append([file, split, -1, total, None, None, None, None, None, None, False])
        for lo in range(0, len(rows), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 8192], strict=True), kinds, strict=True)], names=names)


def _close(row: list, body: bytes, need: int) -> None:
    """Fill in the payload's length and digest; the block must be followed by the record's end."""
    tail = body[need : need + 4]
    if tail and not END.encode().startswith(tail):
        row[3] = None
        return
    _, payload, said = _payload(body[:need])
    if row[6] == "revisit":
        row[8] = _number(said)
    else:
        row[8], row[9] = len(payload), hashlib.sha1(payload).hexdigest()
    row[10] = True


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives: file, at, page_id, record_type, refers_to, payload_bytes, payload_digest."""
    ship(spark)
    # at counts from the split's first piece; a record's true offset is that plus what the splits before span
    found = stage(_pieces(spark, path).mapInArrow(_candidates, _CANDIDATE), "warc-candidates")
    spans = found.where("at = -1").select("file", "split", F.col("next").alias("span"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    base = spans.select("file", "split", "span", F.coalesce(F.sum("span").over(earlier), F.lit(0)).alias("base"))
    base = stage(base, "warc-splits")
    placed = found.where("at >= 0").join(base, ["file", "split"]).select("file", "split", "span", "base", (F.col("at") + F.col("base")).alias("at"), (F.col("next") + F.col("base")).alias("next"), (F.col("exit") + F.col("base")).alias("exit"), "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "whole")
    placed = stage(placed, "warc-placed")
    reached = _reached(placed, base)
    records = placed.join(reached, ["file", "split", "at"]).where("next is not null")
    wanted = ["file", "at", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    whole = records.where("whole").select(wanted)
    torn = stage(records.where("not whole").select("file", "split", "at", "next", "page_id", "record_type", "refers_to"), "warc-torn")
    if torn.limit(1).count():
        whole = whole.unionByName(_mend(spark, path, torn, base).select(wanted))
    return whole


def _reached(placed: DataFrame, base: DataFrame) -> DataFrame:
    """(file, split, at) of the candidates on the chain from the start of their file.

    First which candidate each split is entered at: pointer jumping over the exits, whose distance doubles
    every round; then the chain inside each split.
    """
    starts = base.select("file", F.col("base").alias("lo"), (F.col("base") + F.col("span")).alias("hi"), F.col("split").alias("to_split"))
    first_at = placed.where("split = 0 and base = 0").groupBy("file", "split").agg(F.min("at").alias("at"))
    entries = stage(first_at, "warc-entries")
    splits = base.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if splits > 1:
        # jump: candidate -> the candidate where its chain enters a later split
        jump = placed.where("exit is not null").select("file", "split", "at", F.col("exit").alias("to"))
        jump = jump.join(starts, (jump["file"] == starts["file"]) & (F.col("to") >= F.col("lo")) & (F.col("to") < F.col("hi"))).select(jump["file"], "split", "at", "to_split", "to")
        targets = placed.select("file", F.col("split").alias("to_split"), F.col("at").alias("to"))
        jump = stage(jump.join(targets, ["file", "to_split", "to"]), "warc-jumps")
        for _ in range(max(1, (splits - 1).bit_length())):
            here = entries.join(jump, ["file", "split", "at"]).select("file", F.col("to_split").alias("split"), F.col("to").alias("at"))
            entries = stage(entries.union(here).distinct(), "warc-entries")
            on = jump.select("file", F.col("split").alias("to_split"), F.col("at").alias("to"), F.col("to_split").alias("far_split"), F.col("to").alias("far"))
            jump = stage(jump.join(on, ["file", "to_split", "to"]).select("file", "split", "at", F.col("far_split").alias("to_split"), F.col("far").alias("to")), "warc-jumps")

    def chain(t: pa.Table) -> pa.Table:
        at = t.column("at").to_pylist()
        follow = dict(zip(at, t.column("next").to_pylist(), strict=True))
        entry = [a for a, e in zip(at, t.column("entry").to_pylist(), strict=True) if e]
        out, here = [], min(entry) if entry else None
        while here in follow:
            out.append(here)
            here = follow[here]
        return pa.table({"file": pa.array([t.column("file")[0].as_py()] * len(out), pa.string()), "split": pa.array([t.column("split")[0].as_py()] * len(out), pa.int64()), "at": pa.array(out, pa.int64())})

    marked = placed.select("file", "split", "at", "next").join(entries.withColumn("entry", F.lit(True)), ["file", "split", "at"], "left")
    return marked.groupBy("file", "split").applyInArrow(chain, "file string, split long, at long")


_BUCKET = 1 << 20


def _mend(spark: SparkSession, path: str, torn: DataFrame, base: DataFrame) -> DataFrame:
    """Records whose block is cut by false boundaries over splits: a second read keeps only their pieces."""

    def offsets(batches):
        for file, split, pieces in _runs(batches):
            total = 0
            for piece in pieces:
                yield pa.RecordBatch.from_pydict({"file": pa.array([file]), "split": pa.array([split], pa.int64()), "at": pa.array([total], pa.int64()), "piece": pa.array([piece], pa.binary())})
                total += len(piece) + len(MAGIC)

    pieces = _pieces(spark, path).mapInArrow(offsets, "file string, split long, at long, piece binary")
    pieces = pieces.join(base, ["file", "split"]).select("file", (F.col("at") + F.col("base")).alias("piece_at"), "piece")
    pieces = pieces.withColumn("bucket", F.floor(F.col("piece_at") / _BUCKET))
    spread = torn.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("at") / _BUCKET), F.floor((F.col("next") - 1) / _BUCKET))))
    parts = spread.join(pieces, ["file", "bucket"]).where("piece_at >= at and piece_at < next")

    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by("piece_at")
        body = MAGIC.encode().join(t.column("piece").to_pylist())
        head = _parse(body)
        row = [None] * 6 + [t.column("record_type")[0].as_py(), None, None, None, False]
        if head:
            row[9] = head[2].get("warc-payload-digest", "").removeprefix("sha1:") if row[6] == "revisit" else None
            _close(row, body[head[0] :], head[1])
        keep = {c: t.column(c).slice(0, 1) for c in ("file", "at", "page_id", "record_type", "refers_to")}
        return pa.table(keep | {"payload_bytes": pa.array([row[8]], pa.int64()), "payload_digest": pa.array([row[9]], pa.string())})

    return parts.groupBy("file", "at").applyInArrow(join, "file string, at long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> str:
    """Write the pages to new archives in the shared folder; returns their path."""
    path = scratch(pages.sparkSession, "warc")
    write(pages, path, id_col, url_col, payload_col)
    return path
