"""WARC records in ZIP-packaged archives, written and read back by ranges.

An archive is a ZIP file of stored (not compressed) members: ``archive/data.warc.gz`` (each
record its own gzip member) and ``indexes/index.cdx`` (a line per record: id, place, length).
The reader takes the end record, the ZIP64 record where there is one, and the central
directory; finds where a stored member begins inside the file; and reads records by byte
ranges.  Nothing is extracted.

Of records with equal payloads of at least ``least`` bytes, the one with the smallest id is a
response, the others revisit it; smaller payloads are always responses.  Null payloads are
empty.  Rows that repeat the smallest id are responses each; a row without an id revisits an
equal payload that has one, and is a response where none has.  Payloads of any length are one
record.  An empty table has no archives; columns other than the id, the url and the payload are
ignored.

Digests that several pages share are sent to all tasks while they are few (counted).  Beyond,
those of very many pages still are (they are few at any size), and the rest are joined, so no
payload of a third of all pages meets in one task.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import zipfile
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attempt_name, filesystem, named, sliced, work_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records that one reading task takes at least.
RANGE = 4 << 20


def record_id(page) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def page_of(urn: str) -> int | None:
    x = urn.strip("<>").rpartition(":")[2]
    return int(x) if x else None


def warc_record(page, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One record, not compressed.  A revisit keeps the HTTP head (with the full length) and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", " ".join(url.split()))] if url is not None else []),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        *([("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_id(refers_to))] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


@dataclass
class Record:
    kind: str
    page: int | None
    url: str | None
    refers_to: int | None
    digest: str
    payload_bytes: int
    payload: bytes | None


def parse_record(data: bytes) -> Record:
    """A record from its bytes; checks lengths and the payload's digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record length does not match")
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(next(x for x in http.lower().split(b"\r\n") if x.startswith(b"content-length:")).split(b":")[1])
    digest, revisit = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != full or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload does not match its digest")
    refers = page_of(fields["warc-refers-to"]) if revisit else None
    return Record(fields["warc-type"], page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), refers, digest, full, None if revisit else payload)


class ArchiveWriter:
    """Streams records into one archive; memory holds one record and the index."""

    def __init__(self, sink):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, name: str, record: bytes) -> None:
        data = gzip.compress(record, 1, mtime=0)
        self.member.write(data)
        self.lines.append(f"{name} {self.at} {len(data)}\n")
        self.at += len(data)

    def close(self) -> None:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            for x in self.lines:
                f.write(x.encode())
        self.zip.close()


def central_directory(source: io.RawIOBase, size: int) -> dict[str, tuple[int, int, int]]:
    """name → (place of the local header, stored size, compression method) of every member."""

    def get(at: int, n: int) -> bytes:
        source.seek(at)
        return source.read(n)

    tail_at = max(0, size - 65557)
    tail = get(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)  # such bytes inside the comment
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, at):
        locator = get(tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = get(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, at = struct.unpack_from("<QQQ", record, 32)
    data, pos, out = get(at, length), 0, {}
    for _ in range(count):
        if data[pos : pos + 4] != b"PK\x01\x02":
            raise ValueError("central directory is damaged")
        method, stored, plain = (struct.unpack_from("<H", data, pos + 10)[0], *struct.unpack_from("<II", data, pos + 20))
        n, extra, comment = struct.unpack_from("<HHH", data, pos + 28)
        where = struct.unpack_from("<I", data, pos + 42)[0]
        name = data[pos + 46 : pos + 46 + n].decode()
        k, stop = pos + 46 + n, pos + 46 + n + extra
        while k + 4 <= stop:
            kind, m = struct.unpack_from("<HH", data, k)
            if kind == 1:  # 64-bit values, only for the fields that are full, in this order
                full = [f for f, x in (("plain", plain), ("stored", stored), ("where", where)) if x == 0xFFFFFFFF]
                wide = dict(zip(full, struct.unpack_from(f"<{len(full)}Q", data, k + 4)))
                stored, where = wide.get("stored", stored), wide.get("where", where)
            k += 4 + m
        out[name] = (where, stored, method)
        pos += 46 + n + extra + comment
    return out


def stored_member(source: io.RawIOBase, size: int, name: str) -> tuple[int, int]:
    """(place, length) of a stored member's bytes in the archive."""
    where, length, method = central_directory(source, size)[name]
    if method:
        raise ValueError(f"{name} is compressed; records can't be read by ranges")
    source.seek(where)
    local = source.read(30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("local header is damaged")
    n, extra = struct.unpack_from("<HH", local, 26)
    return where + 30 + n + extra, length


def record_ranges(source: io.RawIOBase, size: int) -> list[tuple[int, int]]:
    """(place, length) in the archive of every record, from the stored index."""
    base, _ = stored_member(source, size, DATA)
    at, n = stored_member(source, size, INDEX)
    source.seek(at)
    return [(base + int(a), int(b)) for _, a, b in (line.split() for line in source.read(n).decode().splitlines())]


#: So many shared digests are sent to all tasks; of more, those of so many pages.
BROADCAST_DIGESTS = 200_000
HOT_DIGEST = 1_000


def planned(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Pages with payload, digest, ``revisit`` and ``refers_to``.

    Only digests and ids are combined (before their shuffle); payloads move once.
    """
    src = pages.select(named(id_col).cast("long").alias("page"), named(url_col).alias("url"), F.coalesce(named(payload_col), F.lit("")).cast("binary").alias("payload"))
    src = src.select("*", F.sha2("payload", 256).alias("digest"))
    first = src.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = written(first, "digests")
    few = first.count() <= BROADCAST_DIGESTS
    often = 0 if few else max(HOT_DIGEST, (first.agg(F.sum("n")).first()[0] or 0) // BROADCAST_DIGESTS)
    out = src.join(F.broadcast(first.where(F.col("n") > often).select("digest", "first")), "digest", "left")
    if not few:
        rest = out.where("first is null").drop("first").join(first.where(F.col("n") <= often).select("digest", "first"), "digest", "left")
        out = out.where("first is not null").select(*rest.columns).unionByName(rest)
    revisit = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    return out.select("page", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str | None = None, least: int = 100, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record per page, an archive per task; returns (``path``, ``records``) of each archive.

    Archives bear the name of their task attempt; the (written) list holds accepted ones alone.
    """
    path = path or work_path(pages.sparkSession, "warc")

    def run(batches):
        import pyarrow as pa

        writer = sink = None
        for b in batches:
            if writer is None and b.num_rows:
                fs, root = filesystem(path)
                fs.create_dir(root, recursive=True)
                name = f"{attempt_name()}.wacz"
                sink = fs.open_output_stream(f"{root}/{name}")
                writer = ArchiveWriter(sink)
            for page, url, payload, digest, revisit, refers in (row for part in sliced([b], 2) for row in zip(*(c.to_pylist() for c in part.columns))):
                writer.add(record_id(page), warc_record(page, url, payload, digest, refers, revisit))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([len(writer.lines)], pa.int64())], ["path", "records"])

    return written(planned(pages, least, id_col, url_col, payload_col).mapInArrow(run, "path string, records long"), "archives")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives at ``path``: directories first, then ranges of records in parallel."""

    def ranges(batches):
        import pyarrow as pa

        for b in batches:
            for path in b.column(0).to_pylist():
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    places, out = record_ranges(f, f.size()), []
                for at, n in places:
                    if not out or out[-1][1] - out[-1][0] >= RANGE:
                        out.append([at, at, []])
                    out[-1][1] = at + n
                    out[-1][2].append(n)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(out)), pa.array([x[0] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], ["path", "at", "sizes"])

    def records(batches):
        import pyarrow as pa

        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for path, at, sizes in zip(*(c.to_pylist() for c in b.columns)):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    data = f.read_at(sum(sizes), at)
                rows, pos = [], 0
                for n in sizes:
                    r = parse_record(zlib.decompress(data[pos : pos + n], 31))
                    pos += n
                    rows.append((r.page, r.url, r.payload_bytes, r.digest, r.kind, r.refers_to, r.payload if with_payload else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    files = max(1, archives.count())
    found = archives.select("path").repartition(files, "path").mapInArrow(ranges, "path string, at long, sizes array<long>")
    spread = found.repartition(max(files, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path", "at")
    out = spread.mapInArrow(records, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return out if with_payload else out.drop("payload")
