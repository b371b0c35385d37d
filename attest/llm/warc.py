"""WARC archives as a Spark data source: records are written by tasks, and read by byte ranges.

`register(spark)` makes the format `warc` known; then `df.write.format("warc").save(path)` and
`spark.read.format("warc").load(path)` work. Files are reached through pyarrow, so a path may be
local, on HDFS or in an object store that it knows.
"""

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import dropped, new_path, ship, staged

SCHEMA = "record_id string, record_type string, target_uri string, payload binary, payload_digest string, refers_to string, fields map<string,string>, file string, offset long"
#: What a task writes; all but payload and target_uri must be there.
WRITTEN = "record_id string, record_type string, target_uri string, payload binary, payload_bytes long, payload_digest string, refers_to string, refers_to_uri string, fields map<string,string>"
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Bytes read at once, of a range, of a batch of rows, and of a file before the next one is begun.
READ, RANGE, BATCH, FILE = 1 << 20, 1 << 26, 1 << 23, 1 << 30


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of SHA-1, without the name of the algorithm."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record as a gzip member; header fields without a value are left out."""
    clean = lambda v: re.sub(r"[\r\n]+", " ", v)
    head = VERSION + "".join(f"{k}: {clean(v)}\r\n" for k, v in headers if v is not None).encode() + b"Content-Length: %d\r\n\r\n" % len(block)
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(head + block + b"\r\n\r\n") + made.flush()


def response(row: dict) -> bytes:
    """A response record with the payload, or a revisit record that names the response it repeats.

    Both carry the HTTP header of the full payload.
    """
    payload, kind = row["payload"] or b"", row["record_type"]
    size = row["payload_bytes"] if kind == "revisit" else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    digest = row["payload_digest"] if kind == "revisit" else payload_digest(payload)
    headers = [("WARC-Type", kind), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", DATE), ("WARC-Target-URI", row["target_uri"]), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if kind == "revisit":
        headers += [("WARC-Refers-To", row["refers_to"]), ("WARC-Refers-To-Target-URI", row["refers_to_uri"]), ("WARC-Refers-To-Date", DATE), ("WARC-Profile", PROFILE)]
        payload = b""
    return record([*headers, *sorted((row["fields"] or {}).items()), ("Content-Type", "application/http;msgtype=response")], http + payload)


def opening() -> bytes:
    """The record at the start of each file."""
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"software: attest\r\nformat: WARC File Format 1.1\r\n")


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, names in lower case, and block of a record that was unpacked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    fields = {k.strip().decode("utf-8", "replace").lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
    size = int(fields.get("content-length", "-1"))
    if not lines[0].startswith(b"WARC/") or size < 0 or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields, rest[:size]


# ---- reading by byte ranges --------------------------------------------------------------------


class Window:
    """Bytes of a file from some place on, read as they are asked for and dropped when passed."""

    def __init__(self, file, at: int):
        self.file, self.base, self.held = file, at, bytearray()
        file.seek(at)

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes at a place that is not before the last one released."""
        while self.base + len(self.held) < at + n and (more := self.file.read(max(READ, n))):
            self.held += more
        return bytes(self.held[at - self.base : at - self.base + n])

    def find(self, what: bytes, at: int, end: int) -> int:
        """The first place from `at` and before `end` where `what` begins, or -1."""
        while at < end:
            n = min(READ, end - at)
            found = self.get(at, n + len(what) - 1).find(what)
            if found >= 0:
                return at + found
            self.release(at)
            at += n
        return -1

    def release(self, at: int) -> None:
        if at - self.base > READ:
            del self.held[: at - self.base]
            self.base = at


def begins_record(window: Window, at: int) -> bool:
    """Whether a gzip member whose content begins as a WARC record does begins here."""
    try:
        return zlib.decompressobj(31).decompress(window.get(at, 512), 16).startswith(b"WARC/")
    except zlib.error:
        return False


def member(window: Window, at: int) -> tuple[bytes, int]:
    """Content of the gzip member at a place, its checksum tested, and the place after it."""
    unpack, out, here, n = zlib.decompressobj(31), [], at, 1 << 13
    while not unpack.eof:
        packed, n = window.get(here, n), min(2 * n, READ)
        if not packed:
            raise EOFError("a gzip member is cut off")
        out.append(unpack.decompress(packed))
        here += len(packed)
    return b"".join(out), here - len(unpack.unused_data)


def owned(file, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of the records that begin in a range of bytes.

    The first is looked for by gzip's magic number. A candidate counts if its content begins as a
    record, its checksum holds and the file goes on with another record or ends; else the search
    goes on one byte later. From there on records follow each other, so whatever looks like one
    inside a record is passed over. The last one may end beyond the range.
    """
    window = Window(file, start)
    at, sure = start, start == 0
    while at < end:
        if not (sure and begins_record(window, at)):
            sure = False
            at = window.find(MAGIC, at, end)
            if at < 0:
                return
            if not begins_record(window, at):
                at += 1
                continue
        try:
            raw, after = member(window, at)
            fields, block = parsed(raw)
        except (zlib.error, EOFError, ValueError):
            if sure:
                raise
            at += 1
            continue
        if not sure and window.get(after, 1) and not begins_record(window, after):
            at += 1
            continue
        yield at, fields, block
        at, sure = after, True
        window.release(at)


def row_of(path: str, offset: int, fields: dict[str, str], block: bytes, check: bool) -> dict:
    kind = fields.get("warc-type", "")
    _, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response" and check and digest is not None and digest != payload_digest(payload):
        raise ValueError(f"the payload at {path}:{offset} does not have its digest")
    return {"record_id": fields.get("warc-record-id"), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "payload": None if kind == "revisit" else payload, "payload_digest": digest, "refers_to": fields.get("warc-refers-to"), "fields": list(fields.items()), "file": path, "offset": offset}


_ROWS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("file", pa.string()), ("offset", pa.int64())])


def store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path and the path in it; without a scheme it is a local one."""
    return pa.fs.FileSystem.from_uri(path) if urlparse(path).scheme else (pa.fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range, self.check = options["path"], int(options.get("rangebytes", RANGE)), options.get("verify", "true") == "true"

    def partitions(self) -> list[Range]:
        """Ranges of all files; only names and sizes are looked at."""
        files, root = store(self.path)
        found = files.get_file_info(pa.fs.FileSelector(root, recursive=True)) if files.get_file_info(root).type == pa.fs.FileType.Directory else [files.get_file_info(root)]
        known = sorted((f.path, f.size) for f in found if f.type == pa.fs.FileType.File and f.path.endswith(".warc.gz") and not f.base_name.startswith(("_", ".")))
        return [Range(path, at, min(at + self.range, size)) for path, size in known for at in range(0, size, self.range)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        held, size = [], 0
        with store(self.path)[0].open_input_file(partition.path) as file:
            for offset, fields, block in owned(file, partition.start, partition.end):
                held.append(row_of(partition.path, offset, fields, block, self.check))
                size += len(block)
                if size > BATCH:
                    yield pa.RecordBatch.from_pylist(held, _ROWS)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _ROWS)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task attempt writes files of names of its own; those of attempts that count are put in place at the end."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.most = options["path"], overwrite, int(options.get("filebytes", FILE))
        self.own = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = store(self.path)
        files.create_dir(f"{root}/{self.own}", recursive=True)
        names, out = [], None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    row["fields"] = dict(row["fields"] or ())
                    if out is None or out.tell() > self.most:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out = files.open_output_stream(f"{root}/{self.own}/{names[-1]}", compression=None)
                        out.write(opening())
                    out.write(response(row))
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = store(self.path)
        if self.overwrite:
            for f in files.get_file_info(pa.fs.FileSelector(root, allow_not_found=True)):
                if f.type == pa.fs.FileType.File:
                    files.delete_file(f.path)
        for message in messages:
            for name in message.files if message else ():
                files.move(f"{root}/{self.own}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = store(self.path)
        if files.get_file_info(f"{root}/{self.own}").type == pa.fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.own}")


class Warc(DataSource):
    """Options: path; rangeBytes and verify for reading; fileBytes for writing."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Warc)


# ---- pages ------------------------------------------------------------------------------------


def archived(pages: DataFrame, key: str, url: str, payload: str, path: str, least: int = 0) -> None:
    """Writes a record for each row of pages: a response, or a revisit of an equal payload.

    Of equal payloads of at least `least` bytes, that of the greatest key is the response (of rows
    that repeat a key, one of them; null keys come before all others), and smaller payloads are
    all responses. Null payloads are empty, a null url gives no target, other columns are not
    looked at. Payloads are compared by SHA-256 and length. A table without rows writes no file.
    """
    spark = pages.sparkSession
    register(spark)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("target_uri"), body.alias("payload"))
    # numbers of rows have to stay as they are when rows are read again
    rows = staged(rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha": F.sha2("payload", 256), "sha1": F.sha1("payload"), "n": F.monotonically_increasing_id()}), "pages")
    found = rows.where(F.col("payload_bytes") >= least).groupBy("sha", "payload_bytes").agg(F.count("*").alias("times"), F.max(F.struct(F.col("key").isNotNull().alias("known"), "key", "n", "target_uri")).alias("first"))
    keys = found.where("times > 1").select(F.col("sha").alias("of"), F.col("payload_bytes").alias("of_bytes"), F.col("first.n").alias("of_n"), F.col("first.target_uri").alias("refers_to_uri"))
    keys = staged(keys, "repeats")
    prefix = F.lit(f"<urn:attest:{uuid.uuid4().hex}:")
    name = lambda n: F.concat(prefix, n.cast("string"), F.lit(">"))
    met = rows.join(keys, (F.col("sha") == F.col("of")) & (F.col("payload_bytes") == F.col("of_bytes")), "left")
    again = F.col("of_n").isNotNull() & (F.col("of_n") != F.col("n"))
    fields = F.when(F.col("key").isNotNull(), F.create_map(F.lit("Page-ID"), F.col("key").cast("string")))
    made = met.select(name(F.col("n")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", F.when(again, base32(F.col("sha1"))).alias("payload_digest"), F.when(again, name(F.col("of_n"))).alias("refers_to"), F.when(again, F.col("refers_to_uri")).alias("refers_to_uri"), fields.alias("fields"))
    made.write.format("warc").mode("append").option("path", path).save()
    dropped(rows)
    dropped(keys)


def base32(hexed: Column) -> Column:
    """Upper-case base32 of a digest of 20 bytes in hex: five bits a letter."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    part = lambda i: F.conv(F.substring(hexed, i * 10 + 1, 10), 16, 10).cast("long")
    return F.concat(*[F.substring(F.lit(letters), (F.shiftright(part(i), 35 - 5 * j).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for i in range(4) for j in range(8)])


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the records of pages in archives.

    A revisit's payload is that of the response it refers to, whose page_id is its refers_to.
    """
    register(spark)
    found = spark.read.format("warc").load(path).where("record_type in ('response', 'revisit')")
    page = F.try_element_at("fields", F.lit("page-id")).cast("long")
    row = found.select("record_id", "record_type", page.alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", F.col("refers_to").alias("of"))
    row = staged(row, "records")
    first = row.where("record_type = 'response'").select(F.col("record_id").alias("first"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("first_bytes"), F.col("payload_digest").alias("first_digest"))
    again = row.where("record_type = 'revisit'").join(first, F.col("of") == F.col("first"))
    again = again.select("page_id", F.col("first_bytes").alias("payload_bytes"), F.col("first_digest").alias("payload_digest"), "record_type", "refers_to")
    once = row.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return once.unionByName(again)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """pages written to archives in the shared folder, and what is read back from them."""
    path = new_path(pages.sparkSession, "warc")
    archived(pages, key, url, payload, path, least)
    return read_back(pages.sparkSession, path)
