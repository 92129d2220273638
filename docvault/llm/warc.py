"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Records are written by the tasks that hold the pages, in archives of bounded size, and read back as a stream, so neither a
task nor the driver holds an archive. Files are reached through the file system named by the folder's URI. A task that is
repeated writes its archive under a new name; only the names in the returned table count.

Null payloads are empty. A null id is written as ``-`` and read back as null. Of rows with equal payloads of at least
``least`` bytes, those with the largest id are responses; a repeated row of that id is a response as well. Empty tables give
no archive. A payload of any length is one record. Only the named columns are read. The store has to be one that Arrow's file
systems can open.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docvault.session import is_small, lookup_join, materialise, qualified

# Fixed values of the format.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 64 << 20
DICTIONARY_SAMPLES = 256      # records an archive's dictionary is made from
DICTIONARY_BYTES = 32 << 10
DATE = b"2024-01-01T00:00:00Z"
FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, at long"


class WarcError(ValueError):
    """A record or archive that breaks the format."""


def _files(folder: str):
    """File system and path of a folder with its scheme, as the driver gave it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(f"file://{folder[5:]}" if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit carries the HTTP head of the response only."""
    name = lambda x: b"<urn:page:%s>" % (b"-" if x is None else str(x).encode())
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    fields = [(b"WARC-Type", b"response" if refers_to is None else b"revisit"), (b"WARC-Record-ID", name(page_id)), (b"WARC-Date", DATE)]
    if url:
        fields.append((b"WARC-Target-URI", "".join(url.split()).encode("utf-8", "replace")))
    fields.append((b"WARC-Payload-Digest", b"sha1:" + digest.encode()))
    if refers_to is not None:
        fields += [(b"WARC-Refers-To", name(refers_to)), (b"WARC-Profile", REVISIT_PROFILE)]
    fields += [(b"Content-Type", b"application/http; msgtype=response"), (b"Content-Length", str(len(block)).encode())]
    return VERSION + b"\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """Fields of one record: id, payload length, digest, type, refers to, payload (empty for a revisit).

    Raises ``WarcError`` where a header is missing or malformed, a length differs, or a payload doesn't have its digest.
    """
    top, blank, rest = raw.partition(b"\r\n\r\n")
    lines = top.split(b"\r\n")
    if not blank or lines[0] != VERSION:
        raise WarcError("no WARC header")
    fields: dict[bytes, bytes] = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        if not colon or key.lower() in fields:
            raise WarcError(f"bad header line {line[:80]!r}")
        fields[key.lower()] = value.strip()

    def number(value: bytes | None, what: str) -> int:
        if value is None or not value.isdigit():
            raise WarcError(f"no {what}")
        return int(value)

    def page(value: bytes | None) -> int | None:
        if value is None or not (value.startswith(b"<urn:page:") and value.endswith(b">")):
            raise WarcError("bad record id")
        inner = value[10:-1]
        try:
            return None if inner == b"-" else int(inner)
        except ValueError:
            raise WarcError("bad record id") from None

    length = number(fields.get(b"content-length"), "Content-Length")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"the block has {len(rest) - 4} bytes, its header says {length}")
    kind, digest = fields.get(b"warc-type"), fields.get(b"warc-payload-digest", b"")
    if kind not in (b"response", b"revisit") or not digest.startswith(b"sha1:") or b"warc-date" not in fields:
        raise WarcError("a required header is missing")
    http, blank, payload = rest[:length].partition(b"\r\n\r\n")
    if not blank or not http.startswith(b"HTTP/1."):
        raise WarcError("no HTTP head")
    sizes = [x.partition(b":")[2].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    size = number(sizes[0] if sizes else None, "HTTP Content-Length")
    if kind == b"response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest[5:].decode()):
        raise WarcError("the payload isn't that of its header")
    if kind == b"revisit" and (payload or b"warc-refers-to" not in fields):
        raise WarcError("a revisit needs a reference and no payload")
    refers = page(fields[b"warc-refers-to"]) if kind == b"revisit" else None
    return page(fields.get(b"warc-record-id")), size, digest[5:].decode(), kind.decode(), refers, payload


class ArchiveWriter:
    """Frames of one archive. The dictionary comes from its first records, which wait until there are enough."""

    def __init__(self, out, level: int = 3):
        self.out, self.level, self.waiting, self.packer, self.size, self.begun, self.count = out, level, [], None, 0, False, 0

    def add(self, raw: bytes) -> None:
        self.count += 1
        self.size += len(raw)
        if self.begun:
            self.out.write(self.packer.compress(raw))
            return
        self.waiting.append(raw)
        if len(self.waiting) >= DICTIONARY_SAMPLES or self.size > ARCHIVE_BYTES // 8:
            self._begin()

    def _begin(self) -> None:
        import zstandard
        self.begun, book = True, None
        try:
            book = zstandard.train_dictionary(DICTIONARY_BYTES, [x[:8192] for x in self.waiting], level=self.level)
        except zstandard.ZstdError:
            pass  # too few records: the format allows an archive without a dictionary
        self.packer = zstandard.ZstdCompressor(level=self.level, dict_data=book, write_checksum=True)
        if book:
            held = zstandard.ZstdCompressor(level=19).compress(book.as_bytes())
            self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(held)) + held)
        for raw in self.waiting:
            self.out.write(self.packer.compress(raw))
        self.waiting = []

    def close(self) -> None:
        if not self.begun:
            self._begin()
        self.out.close()


def read_archive(stream) -> Iterator[tuple[int, bytes]]:
    """Number and bytes of each record of an open archive; each is one frame and nothing is left over."""
    import zstandard
    held = b""

    def fill(n: int) -> None:
        nonlocal held
        while len(held) < n:
            more = stream.read(1 << 20)
            if not more:
                raise WarcError("the archive ends inside a frame")
            held += more

    def more() -> bool:
        nonlocal held
        if not held:
            held = stream.read(1 << 20)
        return bool(held)

    book, first, at = None, True, 0
    while more():
        fill(4)
        magic = struct.unpack_from("<I", held)[0]
        if magic == DICTIONARY_FRAME and first:
            fill(8)
            size = struct.unpack_from("<I", held, 4)[0]
            fill(8 + size)
            inner, held = held[8:8 + size], held[8 + size:]
            packed = inner[:4] == struct.pack("<I", ZSTD_FRAME)
            book = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(inner) if packed else inner)
        elif 0x184D2A50 <= magic <= 0x184D2A5F:
            fill(8)
            size = struct.unpack_from("<I", held, 4)[0]
            fill(8 + size)
            held = held[8 + size:]
        elif magic == ZSTD_FRAME:
            frame, parts = zstandard.ZstdDecompressor(dict_data=book).decompressobj(), []
            while not frame.eof:
                if not more():
                    raise WarcError("the archive ends inside a frame")
                try:
                    parts.append(frame.decompress(held))
                except zstandard.ZstdError as e:
                    raise WarcError(f"frame {at}: {e}") from None
                held = frame.unused_data
            yield at, b"".join(parts)
            at += 1
        else:
            raise WarcError(f"not a frame: {magic:#x}")
        first = False


def write_warcs(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                least: int = 1000) -> DataFrame:
    """Write one record per row into archives under ``folder``; returns their paths and record counts."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
                        F.sha1(F.encode(payload, "UTF-8")).alias("digest"), F.octet_length(payload).alias("size"))
    groups = rows.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.max("id").alias("newest"), F.count(F.lit(1)).alias("n"))
    copies = materialise(groups.filter("n > 1").select("digest", "size", "newest"), "copies")
    rows = lookup_join(rows, copies, ["digest", "size"], "left", salt=F.xxhash64("id"), fits=is_small(copies))
    # A null id never wins against a number and refers to the winner.
    other = F.col("newest").isNotNull() & ~F.col("id").eqNullSafe(F.col("newest"))
    rows = rows.select("id", "url", "payload", "digest", F.when(other, F.col("newest")).alias("refers"))

    folder = qualified(spark, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        files.create_dir(root)
        archive, name, done = None, "", []
        for batch in batches:
            for i, url, text, digest, refers in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if archive is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    archive = ArchiveWriter(files.open_output_stream(name))
                archive.add(record(i, url, text.encode("utf-8", "surrogatepass"), digest, refers))
                if archive.size >= ARCHIVE_BYTES:
                    archive.close()
                    done.append((name, archive.count))
                    archive = None
        if archive is not None:
            archive.close()
            done.append((name, archive.count))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["path", "records"])

    # The table of paths is written once, so that a later read can't start the writers again.
    return materialise(rows.mapInArrow(write, "path string, records long"), "archives")


def read_warcs(spark: SparkSession, archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """One row per record of the named archives, checked by ``parse``; the record counts must be those of the table."""
    fields, folder = T._parse_datatype_string(FOUND + (", payload binary" if payloads else "")), qualified(spark, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _files(folder)
        kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                           ("refers_to", pa.int64()), ("archive", pa.string()), ("at", pa.int64())] + [("payload", pa.binary())] * payloads)
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held, size, seen = [], 0, 0
                with files.open_input_stream(path) as stream:
                    for at, raw in read_archive(stream):
                        *row, payload = parse(raw)
                        held.append((*row, path, at) + (payload,) * payloads)
                        seen, size = seen + 1, size + payloads * len(payload)
                        if len(held) >= 4096 or size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)
                            held, size = [], 0
                if seen != records:
                    raise WarcError(f"{path} has {seen} records, not {records}")
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)

    tasks = max(1, min(archives.count(), 8 * spark.sparkContext.defaultParallelism))
    return archives.select("path", "records").repartition(tasks, "path").mapInArrow(read, fields)
