"""WARC records in ZIP packages: written, then found through the ZIP directory and the index, and read by range.

A package is a ZIP file with two stored members: archive/data.warc.gz, one gzip member per record, and indexes/index.cdx, a line per
record with its offset and length in the archive. Nothing is ever extracted: the reader parses the end of the file (ZIP64
too), the central directory, the local heads of the stored members and the index, and then reads records by their ranges.

Of records with equal payloads of MIN_REVISIT bytes or more, that with the least id is the response and the others revisit
it; shorter ones are all responses. A revisit keeps the HTTP head and the full payload's digest and length, not the payload.

Tasks write packages under names of their own attempt; the table of packages that Spark commits says which ones count, so a lost
executor leaves only files that nobody reads. Ranges of records, not packages, are the unit of reading.

Defined cases: a null html is an empty payload, a null url gives no target URI; a null id is written as such, and is the
response only where all its equals have null ids; rows that repeat and share the least id are all responses; an empty table gives
no package; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowpact.llm.common import Scratch, filesystem, lookup, read_range

MIN_REVISIT = 100
#: A package is closed when its archive has this many bytes.
PACKAGE_BYTES = 64 << 20
#: Records of a range that is read at once: bytes at most (a longer record is a range of its own).
RANGE_BYTES = 4 << 20
LEVEL = 6

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_EOCD, _EOCD64, _LOCATOR, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def _safe(url: str) -> str:
    """What may not stand in a head line, as per cent and hex."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page: int | None, url: str | None, payload: bytes, digest: str, size: int, refers: int | None) -> bytes:
    """One WARC record, compressed; refers: the id of the response that it revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers is not None else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
             "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> dict:
    """A record's heads (record and HTTP), and its payload."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    heads = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(heads["Content-Length"])]
    if len(block) != int(heads["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"warc": heads, "http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


class _Counted(io.RawIOBase):
    """An output that can't seek, as object stores give: ZIP members then carry their sizes behind them."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)


def write_package(uri: str, records: Iterator[tuple[str, bytes]], most: int) -> tuple[int, int]:
    """Writes records until the archive has `most` bytes or there are none; their number, and the archive's bytes."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    index, n, size = [], 0, 0
    with store.open_output_stream(path) as out, zipfile.ZipFile(_Counted(out), "w", zipfile.ZIP_STORED) as package:
        with package.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as archive:
            for name, data in records:
                archive.write(data)
                index.append(json.dumps({"id": name, "offset": size, "length": len(data)}))
                n, size = n + 1, size + len(data)
                if size >= most:
                    break
        package.writestr(zipfile.ZipInfo(INDEX), "".join(f"{x}\n" for x in index))
    return n, size


def members(uri: str) -> dict[str, tuple[int, int]]:
    """First byte and length of each stored member, from the directory at the file's end."""
    tail = read_range(uri, -(22 + 0xFFFF + 20), 22 + 0xFFFF + 20)
    at = tail.rfind(_EOCD)
    if at < 0:
        raise ValueError(f"{uri} is not a ZIP file")
    count, size, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if at >= 20 and tail[at - 20 : at - 16] == _LOCATOR:
        (where,) = struct.unpack("<Q", tail[at - 12 : at - 4])
        end = read_range(uri, where, 56)
        if end[:4] != _EOCD64:
            raise ValueError(f"{uri} has no ZIP64 directory where it should be")
        count, size, start = struct.unpack("<QQQ", end[32:56])
    directory, at, found = read_range(uri, start, size), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != _CENTRAL:
            raise ValueError(f"the directory of {uri} is damaged")
        method, = struct.unpack("<H", directory[at + 10 : at + 12])
        packed, full, name, extra, comment = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        (local,) = struct.unpack("<I", directory[at + 42 : at + 46])
        title = directory[at + 46 : at + 46 + name].decode()
        more, k = directory[at + 46 + name : at + 46 + name + extra], 0
        while k + 4 <= len(more):
            kind, width = struct.unpack("<HH", more[k : k + 4])
            if kind == 1:
                wide = list(struct.unpack(f"<{width // 8}Q", more[k + 4 : k + 4 + width // 8 * 8]))
                if full == 0xFFFFFFFF:
                    full = wide.pop(0)
                if packed == 0xFFFFFFFF:
                    packed = wide.pop(0)
                if local == 0xFFFFFFFF:
                    local = wide.pop(0)
            k += 4 + width
        at += 46 + name + extra + comment
        if method == 0:
            head = read_range(uri, local, 30)
            if head[:4] != _LOCAL:
                raise ValueError(f"member {title} of {uri} is not where the directory says")
            found[title] = (local + 30 + sum(struct.unpack("<HH", head[26:30])), packed)
    return found


def ranges(uri: str, most: int = RANGE_BYTES) -> Iterator[tuple[int, list[int]]]:
    """Runs of neighbouring records: first byte in the file, and each record's length."""
    found = members(uri)
    base, _ = found[ARCHIVE]
    start, lengths = None, []
    for line in io.BytesIO(read_range(uri, *found[INDEX])):
        entry = json.loads(line)
        if lengths and sum(lengths) + entry["length"] > most:
            yield start, lengths
            start, lengths = None, []
        start = base + entry["offset"] if start is None else start
        lengths.append(entry["length"])
    if lengths:
        yield start, lengths


def write(pages: DataFrame, scratch: Scratch, id_column: str = "page_id", url: str = "url", html: str = "html",
          min_revisit: int = MIN_REVISIT, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes a record per page; the table of packages: uri, records, bytes."""
    folder = f"{scratch.path}/packages"
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.length("payload").cast("long"))
    # Digests that come twice: counted before they are shuffled, so a digest of a third of the rows is a row per task.
    twice = scratch.stage(
        rows.filter(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
        .filter("n > 1").select("digest", "least"), "twice")
    joined = lookup(rows, twice, ["digest"])
    revisits = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    joined = joined.select("page_id", "url", F.when(revisits, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
                           "digest", "size", F.when(revisits, F.col("least")).alias("refers"))

    def run(batches):
        def records():
            for batch in batches:
                for x in batch.to_pylist():
                    yield str(x["page_id"]), record(x["page_id"], x["url"], x["payload"], x["digest"], x["size"], x["refers"])

        source = records()
        for first in source:
            uri = f"{folder}/{uuid.uuid4().hex}.zip"
            n, size = write_package(uri, itertools.chain([first], source), package_bytes)
            yield pa.RecordBatch.from_pydict({"uri": [uri], "records": [n], "bytes": [size]})

    return scratch.stage(joined.mapInArrow(run, "uri string, records long, bytes long"), "packages-table")


def read(packages: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (null for revisits): a row per record."""
    spark = packages.sparkSession
    cores, files, size = spark.sparkContext.defaultParallelism, *packages.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()

    def find(batches):
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                for start, lengths in ranges(uri):
                    yield pa.RecordBatch.from_pydict({"uri": [uri], "start": [start], "lengths": pa.array([lengths], pa.list_(pa.int64()))})

    def load(batches):
        for batch in batches:
            for x in batch.to_pylist():
                data, at, out = read_range(x["uri"], x["start"], sum(x["lengths"])), 0, []
                for n in x["lengths"]:
                    out.append(_row(parse(data[at : at + n])))
                    at += n
                names = ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()))], names)

    found = packages.select("uri").repartition(max(1, min(4 * cores, files))).mapInArrow(find, "uri string, start long, lengths array<long>")
    return found.repartition(max(cores, -(-size // (4 * RANGE_BYTES)))).mapInArrow(
        load, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def _row(found: dict) -> tuple:
    warc = found["warc"]
    name = lambda key: int(x) if (x := warc.get(key, "<urn:page:>")[10:-1]) else None
    digest = warc["WARC-Payload-Digest"].removeprefix("sha256:")
    full = warc["WARC-Type"] == "response"
    size = int(found["http"]["Content-Length"])
    if full and (len(found["payload"]) != size or hashlib.sha256(found["payload"]).hexdigest() != digest):
        raise ValueError(f"the payload of {warc['WARC-Record-ID']} is not what its head says")
    return (name("WARC-Record-ID"), warc.get("WARC-Target-URI"), warc["WARC-Type"], name("WARC-Refers-To"), digest, size, found["payload"] if full else None)
