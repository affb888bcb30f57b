"""WARC archives: writing pages as records, and a splittable reader.

Every record is a gzip member of its own.  The reader cuts archives into byte ranges; a
task looks for the gzip magic in its range, takes a place for a record if it unpacks to a
WARC header, and owns the records that start inside its range, to their end.  Members are
unpacked piece by piece, so a long payload isn't held in memory unless it is asked for.

Of pages with equal payloads of LEAST bytes or more, the one with the smallest page_id is a
response and the others are revisits of it; rows with that same page_id are all responses.
Null ids count as larger than all others; where a group has no other, all are responses.  A
null payload is empty.  A null url gives no target; control characters, blanks and `<>` in
urls are escaped.  An empty table gives no archives, no archives give no records.  Columns
other than the three named are ignored.

A damaged member whose header can be read comes as a record of kind `damaged`; bytes
that belong to no member are passed over.  The writer makes no member that holds another
one as it is.  In archives of others, a member stored inside a member without compression
is taken for a record if a range starts between the two.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LEAST = 100
#: Bytes of a range, of an archive before the next is begun, and of what is read or unpacked at once.
SPLIT, ARCHIVE, PIECE = 16 << 20, 1 << 30, 1 << 18
#: A header longer than this isn't one.
HEADER = 16 << 20
MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"

WRITTEN = "path string, records long, bytes long"
RECORDS = pa.schema(
    [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)
RECORDS_DDL = (
    "path string, offset long, length long, record_type string, record_id string, target_uri string, page_id long, "
    "payload_bytes long, payload_digest string, refers_to long, payload binary"
)


# --- writing ---------------------------------------------------------------


def with_types(pages: DataFrame, payload: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): `refers_to` is the response's page_id for revisits, else null."""
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), data.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    # Only payloads that come more than once are looked up; while they are few, Spark sends them out and pages stay where they are.
    again = shared.written(groups.where("n > 1"))
    spread = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    rows = shared.looked_up(rows, again, "digest", "n", spread)
    later = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    return rows.select("page_id", "url", "payload", "digest", F.when(later, F.col("least")).alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    """A name of the form of a UUID, made of page and payload."""
    h = hashlib.sha256(f"{page_id} {digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def escaped(url: str) -> str:
    return "".join(c if c > " " and c not in "<>\x7f" else f"%{ord(c):02X}" for c in url)


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A record before compression."""
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = answer if refers_to is not None else answer + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}"]
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    lines += [f"WARC-Target-URI: {escaped(url)}"] if url is not None else []
    lines += [f"WARC-Page-ID: {page_id}"] if page_id is not None else []
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def member(record: bytes) -> bytes:
    """A record as a gzip member in which no other record can be found."""
    for level, strategy in ((6, zlib.Z_DEFAULT_STRATEGY), (9, zlib.Z_DEFAULT_STRATEGY), (6, zlib.Z_HUFFMAN_ONLY)):
        packer = zlib.compressobj(level, zlib.DEFLATED, 31, strategy=strategy)
        out = packer.compress(record) + packer.flush()
        at = out.find(MAGIC, 1)
        while at >= 0 and Member(Bytes(out), at).header() is None:
            at = out.find(MAGIC, at + 1)
        if at < 0:
            break
    return out


def place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path; Spark writes local paths with one slash."""
    return pyarrow.fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


class ArchiveWriter:
    """Archives of one task, one after another; each takes its name when it is complete."""

    def __init__(self, folder: str, part: int, attempt: int, most: int):
        self.fs, self.top = place(folder)
        self.fs.create_dir(self.top, recursive=True)
        self.folder, self.part, self.attempt, self.most = folder.rstrip("/"), part, attempt, most
        self.sink, self.number, self.records, self.bytes = None, 0, 0, 0

    def add(self, record: bytes) -> Iterator[dict]:
        if self.sink is not None and self.bytes >= self.most:
            yield self.close()
        if self.sink is None:
            self.name = f"pages-{self.part:06d}-{self.number:04d}.warc.gz"
            self.temporary = f"{self.top}/.{self.name}-{self.attempt}"
            self.sink, self.records, self.bytes = self.fs.open_output_stream(self.temporary), 0, 0
        data = member(record)
        self.sink.write(data)
        self.records, self.bytes = self.records + 1, self.bytes + len(data)

    def close(self) -> dict:
        self.sink.close()
        final = f"{self.top}/{self.name}"
        # A repeated task replaces the archive; not every store lets a move do that.
        if self.fs.get_file_info(final).type != pyarrow.fs.FileType.NotFound:
            self.fs.delete_file(final)
        self.fs.move(self.temporary, final)
        self.sink, self.number = None, self.number + 1
        return {"path": f"{self.folder}/{self.name}", "records": self.records, "bytes": self.bytes}


def write(pages: DataFrame, folder: str, payload: str = "html", most: int = ARCHIVE) -> DataFrame:
    """Writes a record for each page below `folder`; returns the archives (WRITTEN)."""

    def run(batches):
        context, out = TaskContext.get(), None
        for b in batches:
            done = []
            for i in range(len(b)):  # one payload at a time leaves Arrow's buffer
                if out is None:
                    out = ArchiveWriter(folder, context.partitionId(), context.taskAttemptId(), most)
                page_id, url, data, digest, refers = (b.column(c)[i].as_py() for c in ("page_id", "url", "payload", "digest", "refers_to"))
                done += out.add(page_record(page_id, url, data, digest, refers))
            yield pa.RecordBatch.from_pylist(done, archives_schema())
        if out is not None and out.sink is not None:
            yield pa.RecordBatch.from_pylist([out.close()], archives_schema())

    return shared.written(with_types(pages, payload).mapInArrow(run, WRITTEN))


def archives_schema() -> pa.Schema:
    return pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


# --- reading ---------------------------------------------------------------


class Bytes:
    """Bytes as a source."""

    def __init__(self, data: bytes):
        self.data = data

    def at(self, offset: int, n: int = PIECE) -> bytes:
        return self.data[offset : offset + n]


class File:
    """An archive, read by pieces; the last piece is kept."""

    def __init__(self, uri: str):
        fs, path = place(uri)
        self.file, self.start, self.piece = fs.open_input_file(path), 0, b""
        self.size = self.file.size()

    def at(self, offset: int, n: int = PIECE) -> bytes:
        """Up to n bytes from `offset` on, at least three unless the archive ends."""
        k = offset - self.start
        if not (0 <= k and k + 3 <= len(self.piece)):
            want = min(PIECE, max(0, self.size - offset))
            self.start, self.piece, k = offset, self.file.read_at(want, offset) if want else b"", 0
        return self.piece[k : k + n]


class Damaged(Exception):
    """A member that doesn't unpack, or whose record isn't whole."""


class Member:
    """A gzip member that may hold a record, unpacked piece by piece."""

    def __init__(self, source, offset: int):
        self.source, self.offset, self.fed, self.held, self.left = source, offset, 0, b"", b""
        self.packer, self.most = zlib.decompressobj(31), (1024, 128)  # bytes fed and unpacked at once: few, so that damage behind the header is told apart

    def more(self) -> bytes:
        """The next unpacked bytes; empty at the member's end."""
        while not self.packer.eof:
            data = self.left or self.source.at(self.offset + self.fed, self.most[0])
            if not self.left:
                self.fed += len(data)
            if not data:
                raise Damaged
            try:
                out = self.packer.decompress(data, self.most[1])
            except zlib.error as e:
                raise Damaged from e
            self.left = self.packer.unconsumed_tail
            if out:
                return out
        return b""

    def until_blank(self) -> bytes | None:
        """What comes before the next empty line, or null where there is none."""
        seen = 0
        while (at := self.held.find(END, max(0, seen - 3))) < 0:
            seen = len(self.held)
            if seen > HEADER or not (out := self.more()):
                return None
            self.held += out
        out, self.held = self.held[:at], self.held[at + 4 :]
        return out

    def header(self) -> dict[str, str] | None:
        """The record's fields, names in lower case; null if this isn't a record."""
        try:
            while len(self.held) < 5:
                if not (out := self.more()):
                    return None
                self.held += out
            text = self.until_blank() if self.held.startswith(b"WARC/") else None
        except Damaged:
            return None
        self.most = (PIECE, PIECE)
        fields = header_fields(text) if text is not None else {}
        return fields if "warc-type" in fields and fields.get("content-length", "").isdecimal() else None

    def blocks(self, n: int) -> Iterator[bytes]:
        """The next n unpacked bytes."""
        while n:
            if not self.held:
                self.held = self.more()
                if not self.held:
                    raise Damaged
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out

    def end(self) -> int:
        """The place behind the member, once nothing but the record's closing lines is left of it."""
        tail = self.held
        while out := self.more():
            tail += out
            if len(tail) > len(END):
                break
        if tail != END:
            raise Damaged
        return self.offset + self.fed - len(self.packer.unused_data)


def header_fields(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")[1:]
    pairs = [line.partition(":") for line in lines]
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def number(text: str | None) -> int | None:
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


def record(source, path: str, offset: int, payload: bool) -> tuple[list, int] | None:
    """The record whose member starts at `offset`, as a row of RECORDS, and where it ends; null if there is none."""
    m = Member(source, offset)
    fields = m.header()
    if fields is None:
        return None
    row = [path, offset, None, fields["warc-type"], fields.get("warc-record-id"), fields.get("warc-target-uri"), number(fields.get("warc-page-id"))]
    try:
        size, named = int(fields["content-length"]), None
        if fields.get("content-type", "").startswith("application/http"):
            before = m.until_blank()
            if before is None:
                raise Damaged
            size -= len(before) + len(END)
            named = number(header_fields(before).get("content-length"))
        digest, kept = hashlib.sha256(), []
        for out in m.blocks(max(0, size)):
            digest.update(out)
            if payload:
                kept.append(out)
        end = m.end()
    except Damaged:
        return [*row[:3], "damaged", *row[4:], None, None, None, None], offset + len(MAGIC)
    bare, data = digest.hexdigest(), b"".join(kept) if payload else None
    if row[3] == "revisit":  # what the record stands for
        size, data = named, None
        bare = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    row[2] = end - offset
    return [*row, size, bare, number(fields.get("warc-refers-to-page-id")), data], end


def owned(source, path: str, start: int, end: int, payload: bool) -> Iterator[list]:
    """Records that start in [start, end), in order."""
    at = start
    while at < end:
        piece = source.at(at)
        k = piece.find(MAGIC)
        if k < 0:
            if len(piece) < len(MAGIC):
                return
            at += len(piece) - len(MAGIC) + 1
            continue
        at += k
        if at >= end:
            return
        found = record(source, path, at, payload)
        if found is None:
            at += 1
        else:
            row, at = found
            yield row


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of the archives below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("path", F.col("length").alias("bytes"))


def read(files: DataFrame, split: int = SPLIT, payload: bool = False) -> DataFrame:
    """Records (RECORDS_DDL) of archives (path, bytes), dealt to all tasks by ranges of `split` bytes; `payload` fills the last column."""

    def run(batches):
        for b in batches:
            for path, start, size in zip(*(b.column(c).to_pylist() for c in ("path", "start", "bytes"))):
                source, rows, held = File(path), [], 0
                for row in owned(source, path, start, min(size, start + split), payload):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) == 1024 or held > PIECE:
                        yield record_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield record_batch(rows)

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long")))
    ranges = files.where("bytes > 0").select("path", "bytes", starts.alias("start"))
    width = shared.shuffle_width(files.sparkSession)
    return ranges.repartition(width, "path", "start").mapInArrow(run, RECORDS_DDL)


def record_batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORDS)], schema=RECORDS)
