"""WARC records in ZIP packages: write them, and read single records back by byte range.

A package holds stored (not compressed) members: a WARC file whose records are gzip members of their own, and an index of
their offsets. A reader looks at the end of the package for its central directory, ZIP64 or not, finds where the index and
the WARC file lie, reads the index, and then fetches records by range; nothing is extracted.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.common import bounded_batches
from tamis.session import shared_folder, written

#: Payloads shorter than this are never replaced by a revisit.
REVISIT_BYTES = 1000
#: A package is closed when its WARC file has so many bytes (one record at least).
PACKAGE_BYTES = 16 << 20
#: Records next to each other are fetched in one range of about so many bytes (one record at least).
RANGE_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"

RECORD = "page_id {kind}, url string, record_type string, refers_to {kind}, payload_bytes long, payload_digest string, payload binary"


# --- Writing ------------------------------------------------------------------------------


def _clean(value: str) -> str:
    """A header value on one line: control characters and % are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "%\x7f" else c for c in value)


def _unclean(value: str) -> str:
    out, at = [], 0
    while (next_at := value.find("%", at)) >= 0:
        out += [value[at:next_at], chr(int(value[next_at + 1 : next_at + 3], 16))]
        at = next_at + 3
    return "".join(out) + value[at:]


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, compressed by itself."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}", f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page-Id: {refers_to}")
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def package_bytes(records: list[bytes]) -> bytes:
    """A package of compressed records, with ZIP64 fields in its local headers."""
    index, at = [], 0
    for record in records:
        index.append(json.dumps({"filename": DATA, "offset": at, "length": len(record)}))
        at += len(record)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
        for name, parts in ((DATA, records), (INDEX, [("\n".join(index) + "\n").encode()])):
            with package.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                for part in parts:
                    member.write(part)
    return out.getvalue()


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str | None = None, package_bytes_limit: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record for every page (page_id, url, html); returns the written manifest: archive, bytes, records.

    Of pages with equal payloads of at least REVISIT_BYTES bytes, the one with the largest page_id is stored, the others
    revisit it. Each task writes packages under names of its own and hands the names on; the manifest is a written table, so
    files of attempts that failed are never read. Only pages that share a payload are looked up, by its digest.

    A missing html is an empty payload; a missing url has no target header; a page without id is never the one that others
    revisit, unless all of them have none; rows with the largest id repeated are all responses; an empty table writes no
    package; other columns are ignored.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = folder or f"{shared_folder(spark)}/tamis-warc-{uuid.uuid4().hex}"
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    records = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"))
    shared = (
        records.where(F.octet_length(F.col("html")) >= REVISIT_BYTES).groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1 and keeper is not null")
        .select(F.col("digest").alias("shared_digest"), "keeper")
    )
    rows = records.join(shared, (F.col("digest") == F.col("shared_digest")), "left").select(
        "page_id", "url", "html", "digest", "keeper",
        (F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))).alias("revisit"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        waiting: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            body = package_bytes(waiting)
            path = f"{root}/{uuid.uuid4().hex}.wacz"
            with system.open_output_stream(path) as out:
                out.write(body)
            done = pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{path.rpartition('/')[2]}"]), pa.array([len(body)], pa.int64()), pa.array([len(waiting)], pa.int64())],
                ["archive", "bytes", "records"],
            )
            waiting.clear()
            return done

        for batch in batches:
            for row in batch.to_pylist():
                record = record_bytes(
                    row["page_id"], row["url"], (row["html"] or "").encode("utf-8", "surrogatepass"), row["digest"],
                    row["keeper"], row["revisit"],
                )
                waiting.append(record)
                size += len(record)
                if size >= package_bytes_limit:
                    yield close()
                    size = 0
        if waiting:
            yield close()

    return written(rows.mapInArrow(run, "archive string, bytes long, records long"), "warc-manifest")


# --- Reading ------------------------------------------------------------------------------

END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
#: An end record is 22 bytes and a comment of up to 65,535.
TAIL = 22 + 65535

Fetch = Callable[[int, int], bytes]


def central_directory(fetch: Fetch, size: int) -> tuple[int, int, int]:
    """Offset, length and number of entries of a package's central directory."""
    start = max(0, size - TAIL)
    tail = fetch(start, size - start)
    at = tail.rfind(END)
    while at >= 0:
        comment = struct.unpack_from("<H", tail, at + 20)[0] if at + 22 <= len(tail) else -1
        if at + 22 + comment == len(tail):
            break
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP package, or one cut short")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        place = start + at - 20
        locator = fetch(place, 20) if place >= 0 else b""
        if locator[:4] == LOCATOR64:
            record = fetch(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != END64:
                raise ValueError("the ZIP64 locator does not point at a ZIP64 end record")
            count, length, offset = struct.unpack_from("<QQQ", record, 32)
    return offset, length, count


def members(fetch: Fetch, size: int) -> dict[str, tuple[int, int, int]]:
    """Of each member: compression method, offset of its local header, stored length. Later entries of a name win."""
    offset, length, count = central_directory(fetch, size)
    table, at, found = fetch(offset, length), 0, {}
    for _ in range(count):
        if table[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is cut short")
        flags, method = struct.unpack_from("<HH", table, at + 8)
        packed, whole, name_length, extra_length, comment_length = struct.unpack_from("<IIHHH", table, at + 20)
        header = struct.unpack_from("<I", table, at + 42)[0]
        name = table[at + 46 : at + 46 + name_length].decode("utf-8" if flags & 0x800 else "cp437")
        extra = table[at + 46 + name_length : at + 46 + name_length + extra_length]
        place = 0
        while place + 4 <= len(extra):
            tag, part = struct.unpack_from("<HH", extra, place)
            if tag == 1:  # ZIP64: 8 bytes for each field above that is full, in this order
                fields, wide = place + 4, []
                for value in (whole, packed, header):
                    if value == 0xFFFFFFFF:
                        wide.append(struct.unpack_from("<Q", extra, fields)[0])
                        fields += 8
                    else:
                        wide.append(value)
                whole, packed, header = wide
            place += 4 + part
        found[name] = method, header, packed
        at += 46 + name_length + extra_length + comment_length
    return found


def member_start(fetch: Fetch, header: int) -> int:
    """Where a member's bytes start: after its local header, whose extra field may differ from the directory's."""
    local = fetch(header, 30)
    if local[:4] != LOCAL:
        raise ValueError("no local header where the central directory points")
    name_length, extra_length = struct.unpack_from("<HH", local, 26)
    return header + 30 + name_length + extra_length


def ranges_of(fetch: Fetch, size: int, most: int = RANGE_BYTES) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Byte ranges of a package to fetch: where each starts, and the (offset, length) of the records inside it."""
    found = members(fetch, size)
    starts: dict[str, int] = {}
    method, header, length = found[INDEX]
    if method != zipfile.ZIP_STORED:
        raise ValueError("the index is not a stored member")
    lines = fetch(member_start(fetch, header), length).decode().splitlines()
    begin, inside = 0, []
    for line in lines:
        entry = json.loads(line[line.index("{") :])
        name = entry["filename"]
        if name not in starts:
            method, header, _ = found[name]
            if method != zipfile.ZIP_STORED:
                raise ValueError(f"{name} is not a stored member")
            starts[name] = member_start(fetch, header)
        offset, count = starts[name] + int(entry["offset"]), int(entry["length"])
        if inside and (offset != begin + inside[-1][0] + inside[-1][1] or offset + count - begin > most):
            yield begin, inside
            inside = []
        if not inside:
            begin = offset
        inside.append((offset - begin, count))
    if inside:
        yield begin, inside


def parse_record(data: bytes) -> dict:
    """The columns of one compressed record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = None if fields["WARC-Type"] == "revisit" else block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"a record's payload does not match its digest {digest}")
    whole = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": whole("X-Page-Id"), "url": _unclean(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
        "record_type": fields["WARC-Type"], "refers_to": whole("X-Refers-To-Page-Id"),
        "payload_bytes": len(payload) if payload is not None else whole("X-Payload-Length"), "payload_digest": digest,
        "payload": payload,
    }


def _fetcher(archive: str) -> tuple[Fetch, int]:
    system, path = _file_system(archive)
    source = system.open_input_file(path)
    return (lambda offset, length: source.read_at(length, offset)), source.size()


def read_archives(manifest: DataFrame, kind: str = "long") -> DataFrame:
    """The records of all packages in a manifest (column ``archive``), one row per record, payloads included.

    The ranges are dealt out anew before they are fetched, so that a large package is read by many tasks. Revisits have no
    payload; their length and digest are the ones in the header. A response whose payload does not match its digest, or a
    package cut short, is an error. An empty manifest gives no rows.
    """
    def locate(batches):
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                fetch, size = _fetcher(archive)
                for begin, inside in ranges_of(fetch, size):
                    yield pa.RecordBatch.from_pylist(
                        [{"archive": archive, "begin": begin, "offsets": [a for a, _ in inside], "lengths": [b for _, b in inside]}],
                        pa.schema({"archive": pa.string(), "begin": pa.int64(), "offsets": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64())}),
                    )

    def fetch_all(batches):
        target = pa.schema({
            "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
            "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(),
        })
        for batch in batches:
            for row in batch.to_pylist():
                fetch, _ = _fetcher(row["archive"])
                body = fetch(row["begin"], row["offsets"][-1] + row["lengths"][-1])
                yield pa.RecordBatch.from_pylist(
                    [parse_record(body[a : a + b]) for a, b in zip(row["offsets"], row["lengths"])], target
                )

    spark = manifest.sparkSession
    located = manifest.select("archive").mapInArrow(locate, "archive string, begin long, offsets array<long>, lengths array<long>")
    return located.repartition(_tasks(spark), F.xxhash64("archive", "begin")).mapInArrow(fetch_all, RECORD.format(kind=kind))


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
