"""WARC in ZIP packages: written per partition, read by range without extraction.

A package holds stored (uncompressed) members: ``archive/data.warc.gz``, in which every record is a gzip
member of its own, and ``indexes/index.cdx`` with the offset and length of each record. The reader parses
the end record, the ZIP64 end record and the central directory of a package, finds archive members and
indexes, cuts the archive at indexed records into ranges and reads and parses each range by itself.

Payloads that occur more than once are stored once, by the page with the smallest id; the others are
revisits of it. Files are reached through pyarrow, so executors read and write the shared folder itself.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, join_hot, stored, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Bytes of an archive that one task reads where an index allows it, bytes held of it at a time, and records a batch holds.
RANGE, BLOCK, BATCH = 8 << 20, 1 << 20, 256
#: Tasks that list or read at most.
MAX_TASKS = 20_000
DATE = "2024-01-01T00:00:00Z"


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


# --- records


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit without it when ``refers_to`` is given."""
    digest = base32_sha1(payload)
    name = lambda n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{n}')}>"
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": name(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else quote(url, safe="/:?#[]@!$&'()*+,;=%~"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-ID": page_id,
        "X-Payload-Length": len(payload),
        "Content-Type": "application/http; msgtype=response",
    }
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is not None:
        head |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": name(refers_to),
            "X-Refers-To-Page-ID": refers_to,
        }
        payload = b""
    block = http + payload
    lines = [f"{k}: {v}\r\n" for k, v in (head | {"Content-Length": len(block)}).items() if v is not None]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + "".join(lines).encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def blocks(file, at: int, size: int, most: int = BLOCK) -> Iterator[bytes]:
    """The bytes of a range, block by block."""
    end = at + size
    while at < end:
        data = file.read_at(min(most, end - at), at)
        if not data:
            raise ValueError("an archive ends before its directory says so")
        yield data
        at += len(data)


def unpacked(data: Iterator[bytes]) -> Iterator[bytes]:
    """What gzip members that follow each other hold, in pieces; each byte is looked at once or twice.

    Members are mostly short, so they are fed small pieces first: what a member leaves of a piece is fed again.
    """
    member = None
    for block in data:
        view, at = memoryview(block), 0
        while at < len(view):
            if member is None:
                member, step = zlib.decompressobj(31), 2048
            piece = view[at : at + step]
            yield member.decompress(piece)
            at, step = at + len(piece), min(2 * step, 1 << 16)
            if member.eof:
                at -= len(member.unused_data)
                member = None
    if member is not None:
        raise ValueError("a gzip member is cut off")


def records(data: Iterator[bytes]) -> Iterator[dict]:
    """The records of an archive's bytes, packed (each by itself or all together) or plain, one at a time."""
    data = iter(data)
    first = next(data, b"")
    data = chain([first], data)
    source = unpacked(data) if first[:2] == b"\x1f\x8b" else data
    held, ended = bytearray(), False

    def fill(n: int) -> None:
        nonlocal ended
        while len(held) < n and not ended:
            more = next(source, None)
            if more is None:
                ended = True
            else:
                held.extend(more)

    while True:
        fill(1)
        while held[:1] in (b"\r", b"\n"):
            del held[:1]
            fill(1)
        if not held:
            return
        looked = 0
        while (end := held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(held)
            fill(looked + 1)
            if len(held) == looked:
                raise ValueError("not a WARC record")
        fields = header(bytes(held[:end]))
        size = int(fields["content-length"])
        fill(end + 4 + size)
        if len(held) < end + 4 + size:
            raise ValueError("a WARC record is cut off")
        yield fields | {"block": bytes(held[end + 4 : end + 4 + size])}
        del held[: end + 4 + size]


def header(head: bytes) -> dict[str, str]:
    """The fields of a record by lower-case name."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parsed(fields: dict) -> tuple:
    """A record in the order of ``KINDS``; payloads of records written here have to have their digest.

    Records of other writers have no page_id; what they don't say is worked out where it can be.
    """
    number = lambda k: int(fields[k]) if k in fields else None
    kind, block = fields["warc-type"], fields["block"]
    http = fields.get("content-type", "").startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    given = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind != "revisit":
        made = base32_sha1(payload)
        if "x-page-id" in fields and made != given:
            raise ValueError(f"payload of page {fields['x-page-id']} doesn't have its digest")
        given = given or made
    size = fields.get("x-payload-length") or (None if kind == "revisit" else len(payload))
    size = None if size is None else int(size)
    return (
        number("x-page-id"), size, given, kind, number("x-refers-to-page-id"), fields.get("warc-target-uri"),
        fields.get("warc-record-id"), fields.get("warc-refers-to"), payload,
    )


# --- packages


def directory(file, size: int) -> list[dict]:
    """Name, method, offset of the data and size of each member, from the central or ZIP64 directory."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    k = tail.rfind(b"PK\x05\x06")
    if k < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    count, length, start = struct.unpack_from("<HII", tail, k + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        mark, _, at, _ = struct.unpack("<4sIQI", read(tail_at + k - 20, 20))
        if mark != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = read(at, 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    central, at, found = read(start, length), 0, []
    for _ in range(count):
        if central[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method, packed, plain, n, m, c, offset = struct.unpack_from("<H8xIIHHH8xI", central, at + 10)
        name = central[at + 46 : at + 46 + n].decode("utf-8", "replace")
        extra, e = central[at + 46 + n : at + 46 + n + m], 0
        while e + 4 <= len(extra):
            tag, width = struct.unpack_from("<HH", extra, e)
            if tag == 1:  # ZIP64: only the fields that don't fit above, in this order
                fields, f = [plain, packed, offset], e + 4
                for i, v in enumerate(fields):
                    if v == 0xFFFFFFFF:
                        fields[i] = struct.unpack_from("<Q", extra, f)[0]
                        f += 8
                plain, packed, offset = fields
            e += 4 + width
        # The local header may have another extra field than the central one.
        local = read(offset, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header for {name}")
        skip = 30 + sum(struct.unpack_from("<HH", local, 26))
        found.append({"name": name, "method": method, "at": offset + skip, "size": packed})
        at += 46 + n + m + c
    return found


def ranges(file, size: int, span: int = RANGE) -> Iterator[tuple[int, int]]:
    """Start and length of byte ranges of whole records: about ``span`` each where there is an index.

    An archive without an index is one range, which is read block by block all the same.
    """
    members = directory(file, size)
    cuts: dict[str, array] = {}
    for x in (x for x in members if x["name"].endswith(".cdx") and not x["method"]):
        rest = b""
        for block in blocks(_ReadAt(file), x["at"], x["size"]):
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                _cut(cuts, line)
        _cut(cuts, rest)
    for x in members:
        if not x["name"].endswith((".warc.gz", ".warc")):
            continue
        if x["method"]:
            raise ValueError(f"{x['name']} is compressed within its package; only stored members can be read by range")
        start = 0
        for cut in [*sorted(cuts.get(x["name"], ()))[1:], x["size"]]:
            if (cut - start >= span or cut == x["size"]) and cut > start:
                yield x["at"] + start, cut - start
                start = cut


def _cut(cuts: dict, line: bytes) -> None:
    """Notes where a record of an index line begins; lines of other index formats are left out."""
    fields = line.decode("utf-8", "replace").split(" ")
    if len(fields) == 3 and fields[0].isdigit():
        cuts.setdefault(fields[2].strip(), array("q")).append(int(fields[0]))


class _ReadAt:
    """``read_at`` for files that only seek and read."""

    def __init__(self, file):
        self.file = file

    def read_at(self, n: int, at: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a package per partition; a row per package: its ``package`` address, ``records`` and ``bytes``.

    ``pages`` has page_id, url, payload (binary), refers_to. A task writes under a name of its own and
    renames at the end, so a repeated task leaves one whole package.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(folder)
        fs.create_dir(at)
        part = TaskContext.get().partitionId()
        final, own = f"part-{part:06d}.wacz", f"{at}/.{uuid.uuid4().hex}"
        n, offset, lines = 0, 0, []
        with fs.open_output_stream(own) as out, zipfile.ZipFile(_Stream(out), "w", zipfile.ZIP_STORED) as package:
            with package.open(DATA, "w", force_zip64=True) as data:
                for b in batches:
                    for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                        packed = record_bytes(page_id, url, payload, refers_to)
                        data.write(packed)
                        lines.append(f"{offset} {len(packed)} {DATA}\n")
                        offset, n = offset + len(packed), n + 1
            package.writestr(INDEX, "".join(lines))
        if n:
            fs.move(own, f"{at}/{final}")
            yield pa.RecordBatch.from_pydict({"package": [f"{folder}/{final}"], "records": [n], "bytes": [offset]})
        else:
            fs.delete_file(own)

    rows = pages.select("page_id", "url", "payload", "refers_to")
    return stored(rows.mapInArrow(written, "package string, records bigint, bytes bigint"), "packages")


class _Stream(io.RawIOBase):
    """A stream without seeking, as remote stores give: zipfile then writes sizes behind the data."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)


#: What is read of a record.
KINDS = (
    ("page_id", pa.int64(), "bigint"), ("payload_bytes", pa.int64(), "bigint"), ("payload_digest", pa.string(), "string"),
    ("record_type", pa.string(), "string"), ("refers_to", pa.int64(), "bigint"), ("url", pa.string(), "string"),
    ("record_id", pa.string(), "string"), ("refers_to_id", pa.string(), "string"), ("payload", pa.binary(), "binary"),
)


def read_packages(packages: DataFrame, payload: bool = False) -> DataFrame:
    """A row per record of the packages at the addresses in ``package``; with ``payload``, the stored bytes too.

    Records of all types and all writers are read; page_id and refers_to are null where a record has none.
    Packages are listed first; the ranges found, a small table, set how many tasks read.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for address in b.column(0).to_pylist():
                fs, at = _open(address)
                with fs.open_input_file(at) as file:
                    found = list(ranges(file, file.size()))
                yield pa.RecordBatch.from_pydict(
                    {"package": [address] * len(found), "at": [a for a, _ in found], "size": [n for _, n in found]},
                    schema=pa.schema([("package", pa.string()), ("at", pa.int64()), ("size", pa.int64())]),
                )

    kinds = [(c, t) for c, t, _ in KINDS if payload or c != "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for address, start, size in zip(*(c.to_pylist() for c in b.columns)):
                fs, at = _open(address)
                with fs.open_input_file(at) as file:
                    rows, held = [], 0
                    for fields in records(blocks(file, start, size)):
                        rows.append(parsed(fields)[: len(kinds)])
                        held += len(fields["block"])
                        if len(rows) == BATCH or held > RANGE:
                            yield _batch(rows, kinds)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, kinds)

    packages = packages.select("package")
    tasks = max(1, min(MAX_TASKS, packages.count()))
    found = packages.repartition(tasks, "package").mapInArrow(listed, "package string, at bigint, size bigint")
    found = stored(found, "ranges")
    tasks = max(1, min(MAX_TASKS, 2 * found.count()))  # twice the ranges: few of them meet in a task
    schema = ", ".join(f"{c} {t}" for c, _, t in KINDS if payload or c != "payload")
    return found.repartition(tasks, "package", "at").mapInArrow(read, schema)


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(zip(*rows), kinds)], schema=pa.schema(kinds))


def with_first(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and ``refers_to``: the smallest page_id with an equal payload, null on that page.

    Null html counts as empty. All rows with that smallest id are responses; rows without an id revisit
    it too, or are responses where no row with an equal payload has an id. Payloads that very many pages
    share, such as the empty one, reach their pages by broadcast, so no task gets all of these.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("_digest", F.sha1("payload"))
    counts = rows.groupBy("_digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    counts = stored(counts.where("n > 1"), "digests")
    rows = join_hot(rows, counts, "_digest", "n", pages.count(), ["page_id", "url"])
    return rows.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as packages in ``folder`` and gives their addresses.

    Null urls have no target header; repeated rows are records of their own; no rows, no packages; other
    columns are not read.
    """
    return write_packages(with_first(pages), folder)


def op4_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/packages-{uuid.uuid4().hex}"
    found = read_packages(archive(table(spark, sf_dir, "pages"), folder))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes,
  translate(
    lpad(to_base(('0x' || substr(h, 1, 10))::BIGINT, 32), 8, '0') || lpad(to_base(('0x' || substr(h, 11, 10))::BIGINT, 32), 8, '0')
    || lpad(to_base(('0x' || substr(h, 21, 10))::BIGINT, 32), 8, '0') || lpad(to_base(('0x' || substr(h, 31, 10))::BIGINT, 32), 8, '0'),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""
