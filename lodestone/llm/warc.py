"""WARC records in ZIP packages, written and read back without extraction.

A package holds stored (uncompressed) members: archive/data.warc.gz, in which each record is a gzip member of its
own, after a warcinfo record; and indexes/index.cdx with a CDXJ line (sort-friendly address, time, and as JSON address, type,
status, digest, length, offset, file name) for each page, in the order of these lines. A response holds an HTTP head
and the payload, a revisit the head alone. WARC-Date is the time of writing, given once for all tasks. The reader finds the end-of-central-directory
record, follows the ZIP64 locator where there is one, parses the central directory, locates the members' data by
their local headers and range-reads records by the index; neighbouring ranges are joined up to a bounded size.

Cases: null html is an empty payload; a null url is written as "urn:page"; pages with a null id are all responses, and
their records have no WARC-Page-ID; record ids follow from page id and payload, so rows that repeat both share one; rows
that repeat the largest id of a payload are all responses; an empty table makes
no packages; other columns are ignored; a payload of any size is one record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import time
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, open_fs, stored

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
NO = 0xFFFFFFFF


def zip_package(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP of stored members; ZIP64 where asked for or needed."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        n, at, crc = len(data), len(out), zlib.crc32(data)
        wide = zip64 or n >= NO or at >= NO
        label = name.encode()
        extra = struct.pack("<HHQQ", 1, 16, n, n) if wide else b""
        sizes = (NO, NO) if wide else (n, n)
        out += struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if wide else 20, 0x800, 0, 0, 33, crc, *sizes, len(label), len(extra)) + label + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if wide else b""
        central += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, *sizes, len(label), len(extra), 0, 0, 0, 0, NO if wide else at) + label + extra
    at, n = len(out), len(members)
    out += central
    if zip64 or at + len(central) >= NO or n >= 0xFFFF:
        end = len(out)
        out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(central), at) + struct.pack("<IIQI", 0x07064B50, 0, end, 1)
        return bytes(out + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, NO, NO, 0))
    return bytes(out + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, len(central), at, 0))


class Package:
    """The members of a ZIP behind read_at(n, at) and size()."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail_at = max(0, size - 65_557 - 20)
        tail = source.read_at(size - tail_at, tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        n, length, where = struct.unpack_from("<10xHII", tail, at)
        if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07" and (n == 0xFFFF or NO in (length, where)):
            head = source.read_at(56, struct.unpack_from("<8xQ", tail, at - 20)[0])
            if head[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            n, length, where = struct.unpack_from("<32xQQQ", head)
        central = source.read_at(length, where)
        self.members: dict[str, tuple[int, int, int]] = {}
        p = 0
        for _ in range(n):
            kind, how, packed, full, n_name, n_extra, n_note, place = struct.unpack_from("<I6xH8xIIHHH8xI", central, p)
            if kind != 0x02014B50:
                raise ValueError("broken central directory")
            name = central[p + 46 : p + 46 + n_name].decode()
            e, stop = p + 46 + n_name, p + 46 + n_name + n_extra
            while e + 4 <= stop:
                tag, size_ = struct.unpack_from("<HH", central, e)
                if tag == 1:
                    wide = list(struct.unpack_from(f"<{size_ // 8}Q", central, e + 4))
                    full = wide.pop(0) if full == NO else full
                    packed = wide.pop(0) if packed == NO else packed
                    place = wide.pop(0) if place == NO else place
                e += 4 + size_
            self.members[name] = (how, place, packed)
            p = stop + n_note

    def locate(self, name: str) -> tuple[int, int]:
        """Where a stored member's data begins, and its length."""
        how, place, length = self.members[name]
        if how:
            raise ValueError(f"{name} is not stored")
        head = self.source.read_at(30, place)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        return place + 30 + sum(struct.unpack_from("<26xHH", head)), length


def record_id(page_id: int | None, digest: str) -> str:
    """Of a page's record; a page without id has one of its own."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _record(kind: str, id_: str, date: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", id_), ("WARC-Date", date), *fields, ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def info(date: str) -> bytes:
    return _record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", date, [("Content-Type", "application/warc-fields")], b"software: lodestone\r\nformat: WARC File Format 1.1\r\n")


def address(url: str | None) -> str:
    return (url or "urn:page").translate({10: "%0A", 13: "%0D"})


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, or without its payload a revisit. digest: hexadecimal SHA-1 of the payload."""
    fields = [("WARC-Target-URI", address(url))]
    if page_id is not None:
        fields += [("WARC-Page-ID", str(page_id))]
    fields += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("WARC-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Date", date), ("WARC-Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response")]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record("response" if refers_to is None else "revisit", record_id(page_id, digest), date, fields, head + (payload if refers_to is None else b""))


def surt(url: str) -> str:
    """The address with its host turned round, for sorting: http://www.a.org/x is org,a,www)/x."""
    m = re.match(r"(?i)https?://([^/?#]*)([^#]*)", url)
    if not m:
        return url.lower()
    host, _, port = m[1].rpartition("@")[2].lower().partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (m[2].lower() or "/")


def cdx_line(url: str | None, date: str, digest: str, revisit: bool, offset: int, length: int) -> str:
    says = {"url": address(url), "mime": "warc/revisit" if revisit else "text/html", "status": "200", "digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "length": str(length), "offset": str(offset), "filename": DATA.rpartition("/")[2]}
    return f"{surt(says['url']).replace(' ', '%20')} {re.sub('[^0-9]', '', date)} {json.dumps(says)}\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields in lower case, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def judged(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, digest and refers_to.

    Payloads that come more than once are counted first, by partial sums; a payload that many pages share is a
    skewed key of the join, which Spark splits."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    twice = p.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page_id").alias("keep"), F.count("*").alias("c")).where("c > 1").drop("c")
    return p.join(twice, ["digest", "n"], "left").select("page_id", "url", "payload", "digest", F.when(F.col("page_id") < F.col("keep"), F.col("keep")).alias("refers_to"))


def write_packages(records: DataFrame, folder: str, limit: int = 32 << 20, zip64: bool = False) -> DataFrame:
    """Writes packages of about `limit` bytes; returns a row for each. Each attempt of a task writes under names of its own."""

    date = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())

    def write(batches):
        import pyarrow as pa

        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)

        def close():
            name = f"{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(zip_package([(DATA, bytes(data)), (INDEX, "".join(sorted(lines)).encode())], zip64))
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n": pa.array([len(lines)], pa.int64())})

        begun = gzip.compress(info(date), 3, mtime=0)
        data, lines = bytearray(begun), []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                packed = gzip.compress(record(*row, date), 3, mtime=0)
                lines.append(cdx_line(row[1], date, row[3], row[4] is not None, len(data), len(packed)))
                data += packed
                if len(data) >= limit:
                    yield close()
                    data, lines = bytearray(begun), []
        if lines:
            yield close()

    return stored(records.mapInArrow(write, "path string, n long"), "packages")


def read_packages(packages: DataFrame, together: int = 4 << 20) -> DataFrame:
    """What the records say and hold: page_id, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits)."""

    def read(batches):
        import pyarrow as pa

        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def number(said: str | None) -> int | None:
            return int(said) if said else None

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = open_fs(path)
                with fs.open_input_file(at) as source:
                    package = Package(source)
                    begin, length = package.locate(INDEX)
                    said = (json.loads(x.split(b" ", 2)[2]) for x in source.read_at(length, begin).split(b"\n") if x)
                    spots = sorted((int(x["offset"]), int(x["length"])) for x in said)
                    begin, _ = package.locate(DATA)
                    i = 0
                    while i < len(spots):
                        j = i + 1
                        while j < len(spots) and spots[j][0] == sum(spots[j - 1]) and sum(spots[j]) - spots[i][0] <= together:
                            j += 1
                        data = source.read_at(sum(spots[j - 1]) - spots[i][0], begin + spots[i][0])
                        rows = []
                        for o, n in spots[i:j]:
                            o -= spots[i][0]
                            says, payload = parse_record(gzip.decompress(data[o : o + n]))
                            digest, size = base64.b32decode(says["warc-payload-digest"].removeprefix("sha1:")).hex(), int(says["warc-payload-length"])
                            if says["warc-type"] == "response":
                                payload = payload.partition(b"\r\n\r\n")[2]
                                if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
                                    raise ValueError(f"{path}: a payload differs from its digest")
                            else:
                                payload = None
                            rows.append((number(says.get("warc-page-id")), size, digest, says["warc-type"], number(says.get("warc-refers-to-page-id")), payload))
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        i = j

    n = max(1, min(packages.count(), 20_000))
    return packages.select("path").repartition(n).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_packages(write_packages(judged(pages), new_path(spark, "warc"))).drop("payload")
