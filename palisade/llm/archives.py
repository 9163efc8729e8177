"""Web archives in ZIP packages: WARC records of pages, written and read back by ranges.

A package holds ``archive/data.warc.gz``, one gzip member a record, and ``indexes/index.cdxj``, a line a record with its offset and length;
both are stored, not deflated, so a record is a range of the package. Sizes and offsets beyond 32 bits are written in ZIP64 form and read in
both forms. Readers parse the end record, the ZIP64 end record and the central directory, then the index, then each record by itself; nothing
is extracted, and a task holds one record.

Packages go to the folder that driver and executors share, under a name of the task attempt, and are renamed when complete: an attempt that dies
leaves no package, and only those listed by finished tasks are read.

Defined cases: a null payload is empty; records of payloads of at least ``LEAST`` bytes that are equal revisit the one with the smallest page id
(rows that share it are all responses); rows with a null id revisit a page with one and are responses where there is none; a null URL is written
as empty; an empty table gives no package and no rows; other columns are not looked at.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from palisade.llm.common import shared_folder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 100
PACKAGE_BYTES = 64 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# Fixed values of the ZIP format: signatures, and the values that say that the real one is in ZIP64 form.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
ZIP64_FIELD, FULL16, FULL32 = 1, 0xFFFF, 0xFFFFFFFF
FIXED_DATE = "2024-01-01T00:00:00Z"


# --- Where packages are kept. ---


def filesystem(path: str):
    """File system and path of a URI or a plain path, on the driver and in tasks alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


# --- Records. ---


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record; a revisit has the digest and length of its payload but not the payload."""
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", FIXED_DATE), ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url or "")), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


# --- Packages. ---


class PackageWriter:
    """Writes one package front to back; the data member first, then the index, then the directory."""

    def __init__(self, out: BinaryIO):
        self.out, self.at, self.entries, self.index = out, 0, [], []
        self._begin(DATA)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _begin(self, name: str) -> None:
        # Size and checksum follow the data in a descriptor of 64-bit sizes, which the empty ZIP64 field announces.
        self.entry = {"name": name.encode(), "header": self.at, "crc": 0, "size": 0}
        extra = struct.pack("<HHQQ", ZIP64_FIELD, 16, 0, 0)
        self._put(LOCAL + struct.pack("<5H3I2H", 45, 8, 0, 0, 33, 0, FULL32, FULL32, len(self.entry["name"]), len(extra)) + self.entry["name"] + extra)
        self.start = self.at

    def _end(self) -> None:
        e = self.entry
        self._put(b"PK\x07\x08" + struct.pack("<IQQ", e["crc"], e["size"], e["size"]))
        self.entries.append(e)

    def _data(self, data: bytes) -> None:
        self.entry["crc"] = zlib.crc32(data, self.entry["crc"])
        self.entry["size"] += len(data)
        self._put(data)

    def add(self, raw: bytes, key: str) -> None:
        packed = gzip.compress(raw, 1, mtime=0)
        self.index.append(f"{key} {json.dumps({'filename': DATA, 'offset': self.at - self.start, 'length': len(packed)})}\n")
        self._data(packed)

    def close(self) -> None:
        self._end()
        self._begin(INDEX)
        for line in self.index:
            self._data(line.encode())
        self._end()
        directory = self.at
        for e in self.entries:
            extra = struct.pack("<HHQQQ", ZIP64_FIELD, 24, e["size"], e["size"], e["header"])
            self._put(CENTRAL + struct.pack("<6H3I5H2I", 45, 45, 8, 0, 0, 33, e["crc"], FULL32, FULL32, len(e["name"]), len(extra), 0, 0, 0, 0, FULL32) + e["name"] + extra)
        length, end = self.at - directory, self.at
        n = len(self.entries)
        self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, directory))
        self._put(LOCATOR64 + struct.pack("<IQI", 0, end, 1))
        self._put(END + struct.pack("<4H2IH", 0, 0, FULL16, FULL16, FULL32, FULL32, 0))


def at(source: BinaryIO, offset: int, length: int) -> bytes:
    source.seek(offset)
    data = source.read(length)
    if len(data) != length:
        raise ValueError("the package ends early")
    return data


def members(source: BinaryIO, size: int) -> dict[str, tuple[int, int, int]]:
    """``name: (offset of the data, size, checksum)`` of the stored members, from the central directory in plain or ZIP64 form."""
    tail_at = max(0, size - (22 + FULL16))
    tail = at(source, tail_at, size - tail_at)
    found = tail.rfind(END)
    if found < 0:
        raise ValueError("no end record")
    _, _, _, count, length, start, _ = struct.unpack_from("<4H2IH", tail, found + 4)
    if FULL16 == count or FULL32 in (length, start):
        locator = at(source, tail_at + found - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end64 = at(source, struct.unpack_from("<IQI", locator, 4)[1], 56)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end record")
        *_, count, length, start = struct.unpack_from("<QHHIIQQQQ", end64, 4)
    directory, where, out = at(source, start, length), 0, {}
    for _ in range(count):
        if directory[where : where + 4] != CENTRAL:
            raise ValueError("broken directory")
        _, _, _, method, _, _, crc, packed, full, n, x, c, _, _, _, header = struct.unpack_from("<6H3I5H2I", directory, where + 4)
        name = directory[where + 46 : where + 46 + n].decode()
        extra = directory[where + 46 + n : where + 46 + n + x]
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<HH", extra)
            if kind == ZIP64_FIELD:
                wide = list(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                full = wide.pop(0) if full == FULL32 else full
                packed = wide.pop(0) if packed == FULL32 else packed
                header = wide.pop(0) if header == FULL32 else header
            extra = extra[4 + width :]
        where += 46 + n + x + c
        if method == 0:
            local = at(source, header, 30)
            if local[:4] != LOCAL:
                raise ValueError("broken local header")
            n_local, x_local = struct.unpack_from("<HH", local, 26)
            out[name] = (header + 30 + n_local + x_local, packed, crc)
    return out


def records(source: BinaryIO, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a package in the order of its index, each read by its range."""
    known = members(source, size)
    start, length, crc = known[INDEX]
    index = at(source, start, length)
    if zlib.crc32(index) != crc:
        raise ValueError("broken index")
    for line in io.BytesIO(index):
        entry = json.loads(line[line.index(b"{") :])
        begin, held, _ = known[entry["filename"]]
        if entry["offset"] + entry["length"] > held:
            raise ValueError("a record outside its member")
        yield parse(gzip.decompress(at(source, begin + entry["offset"], entry["length"])))


# --- On Spark. ---


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``(page_id, url, payload, digest, refers_to, revisit)``: which records revisit which."""
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # Only digests seen more than once go into the join; hot ones are split by the skew handling of the join.
    first = (
        rows.filter(F.octet_length("payload") >= least).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    )
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_packages(rows: DataFrame, folder: str, most: int = PACKAGE_BYTES) -> DataFrame:
    """Writes ``planned`` rows into packages below ``folder``; ``(path, size, n)`` of each. Must be stored before it is used twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        done: list[tuple[str, int, int]] = []
        writer = out = None

        def finish() -> None:
            writer.close()
            out.close()
            final = f"{root}/{name}-{len(done)}.wacz"
            system.move(f"{final}.part", final)
            done.append((final, writer.at, len(writer.index)))

        for batch in batches:
            ids, urls, payloads, digests, refers, revisits = batch.columns
            for i in range(batch.num_rows):
                if writer is None:
                    out = system.open_output_stream(f"{root}/{name}-{len(done)}.wacz.part")
                    writer = PackageWriter(out)
                page, payload = ids[i].as_py(), payloads[i].as_py()
                writer.add(record(page, urls[i].as_py(), payload, digests[i].as_py(), refers[i].as_py(), revisits[i].as_py()), "-" if page is None else str(page))
                if writer.at >= most:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()))], ["path", "size", "n"])

    return rows.mapInArrow(run, "path string, size long, n long")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_packages(packages: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """Records of ``packages(path, size)``; the payload of a response is checked against its digest and returned on request."""
    schema = RECORD + (", payload binary" if payload else "")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def number(urn: str) -> int | None:
        text = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(folder)
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                with system.open_input_file(path) as source:
                    for fields, body in records(source, size):
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"a payload of {path} differs from its digest")
                        refers = fields.get("WARC-Refers-To")
                        row = (number(fields["WARC-Record-ID"]), int(fields["WARC-Payload-Length"]), digest, kind, number(refers) if refers else None, fields["WARC-Target-URI"])
                        rows.append(row + ((body if kind == "response" else None),) * payload)
                        held += len(body) * payload
                        if len(rows) >= 5000 or held > (8 << 20):
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return packages.select("path", "size").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Every page as it comes back from the packages written for the table."""
    from palisade.llm.common import cut_lineage

    folder = shared_folder(pages.sparkSession, "packages")
    packages = cut_lineage(write_packages(planned(pages), folder))
    return read_packages(packages.repartition("path"), folder)
