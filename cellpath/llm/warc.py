"""WARC archives: a writer with revisit records, and a reader that splits files at any byte.

Every record is a gzip member of its own. A reading task gets a byte range, looks in it for the gzip magic, and takes
a candidate only if what it decodes to begins with a complete WARC header; it owns the records that start inside its range and reads
the last one to its end, wherever that is. Bytes that look like a member but do not decode to one are
passed over. So a file of any size is read by as many tasks as it has ranges, with no index.

The reader takes archives as they come: any version and type of record, header names in any case, with or without a blank after the colon
and folded over lines, line ends with or without carriage return, several records in a member (which is then decoded as a whole). The payload of a response, request
or revisit is what follows its HTTP header, that of other records their whole block; a payload digest is checked by its label (md5, sha1, sha256,
sha512, in base 16, 32 or 64). Headers that are missing or not of their form come back null.

Null payloads are empty; null ids and addresses leave their headers out and come back null. Repeated rows get a record each. Among rows
of equal payloads of ``SMALLEST`` bytes or more those with the smallest id are responses (rows that repeat that id too), the others
revisits. Payloads may hold anything, line ends and header-like text included. An empty table makes
no archive. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpath.llm.files import each, locate, partition_index, whole_file
from cellpath.session import checkpoint

SMALLEST = 100
SPLIT = 32 << 20
_READ = 1 << 20
_MAGIC = b"\x1f\x8b\x08"

# Names of the format.
_VERSION = b"WARC/1.1"
_BEGIN = b"WARC/"
_RECORD = re.compile(rb"[\r\n]*(WARC/[0-9.]+[ \t]*\r?\n)")
_EMPTY_LINE = re.compile(rb"\r?\n\r?\n")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def encode_record(page: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP header only, as one gzip member."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page is not None:
        headers.append(("X-Page-ID", str(page)))
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="%:/?#[]@!$&'()*+,;=~")))
    if refers_to is None:
        block += payload
    else:
        headers += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", _record_id(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    headers.append(("Content-Length", str(len(block))))
    head = _VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def _headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a blank goes on with the one before."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", head).splitlines()[1:]
    fields = (line.decode("utf-8", "replace").partition(":") for line in lines if b":" in line)
    return {name.strip().lower(): value.strip() for name, _, value in fields}


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"[0-9]{1,18}", text) else None


def _parted(block: bytes) -> tuple[bytes, bytes]:
    """What stands before and after the first empty line."""
    found = _EMPTY_LINE.search(block)
    return (block[: found.start()], block[found.end() :]) if found else (block, b"")


def _digest_holds(payload: bytes, labelled: str | None) -> bool | None:
    """Whether a payload has its digest; null if there is none that can be checked."""
    label, _, value = (labelled or "").partition(":")
    label = label.strip().lower().replace("-", "")
    if label not in ("md5", "sha1", "sha256", "sha512") or not value.strip():
        return None
    raw = hashlib.new(label, payload).digest()
    forms = raw.hex(), base64.b32encode(raw).decode(), base64.b64encode(raw).decode()
    value = value.strip()
    return value.lower() == forms[0] or value.upper().rstrip("=") == forms[1].rstrip("=") or value.rstrip("=") == forms[2].rstrip("=")


def decode_records(raw: bytes) -> Iterator[dict]:
    """Headers and payloads of the records of a member; the payload of a revisit is None."""
    at = 0
    while found := _RECORD.match(raw, at):
        end_of_head = _EMPTY_LINE.search(raw, found.end() - 1)
        if end_of_head is None:
            return
        headers = _headers(raw[found.start(1) : end_of_head.start()])
        size = _number(headers.get("content-length"))
        end = len(raw) if size is None else end_of_head.end() + size
        yield _decoded(headers, raw[end_of_head.end() : end], end <= len(raw))
        at = end


def _decoded(headers: dict[str, str], block: bytes, whole: bool) -> dict:
    kind = headers.get("warc-type", "").lower()
    http = kind in ("response", "request", "revisit") and "http" in headers.get("content-type", "application/http").lower()
    head, payload = _parted(block) if http else (b"", block)
    labelled = headers.get("warc-payload-digest")
    digest = (labelled or "").partition(":")[2].strip() or None
    holds, size = None, len(payload)
    if kind == "revisit":
        payload, size = None, _number(_headers(head).get("content-length"))
    else:
        holds = _digest_holds(payload, labelled) if whole else False
        digest = hashlib.sha256(payload).hexdigest()
    return {
        "page_id": _number(headers.get("x-page-id")),
        "url": headers["warc-target-uri"].strip("<>") if "warc-target-uri" in headers else None,
        "record_type": kind or None,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": _number(headers.get("x-refers-to-page")),
        "record_id": headers.get("warc-record-id"),
        "date": headers.get("warc-date"),
        "digest_holds": holds,
        "payload": payload,
    }


class _Range:
    """Bytes of a file from ``start`` on, read on as far as records go."""

    def __init__(self, source: pa.NativeFile, start: int, end: int, size: int):
        self.source, self.base, self.size = source, start, size
        self.data = bytearray()
        self.more(end - start + len(_MAGIC))

    def more(self, count: int = _READ) -> bool:
        at = self.base + len(self.data)
        count = min(count, self.size - at)
        if count > 0:
            self.source.seek(at)
            self.data += self.source.read(count)
        return count > 0

    def member(self, at: int) -> tuple[bytes, int] | None:
        """What the member at ``at`` decodes to and where it ends; None if none begins there."""
        unpack, parts, seen = zlib.decompressobj(31), [], 0
        checked = False
        while not unpack.eof:
            if at + seen == len(self.data) and not self.more():
                return None
            step = bytes(self.data[at + seen : at + seen + _READ])
            seen += len(step)
            try:
                parts.append(unpack.decompress(step))
            except zlib.error:
                return None
            if not checked:
                start = b"".join(parts).lstrip(b"\r\n")
                if not start.startswith(_BEGIN[: len(start)]):
                    return None
                checked = len(start) >= len(_BEGIN)
        whole = b"".join(parts)
        return (whole, at + seen - len(unpack.unused_data)) if _RECORD.match(whole) and _EMPTY_LINE.search(whole) else None


def range_records(source: pa.NativeFile, start: int, end: int, size: int) -> Iterator[bytes]:
    """Members with records that start in ``[start, end)``."""
    part, at = _Range(source, start, min(end, size), size), 0
    while True:
        at = part.data.find(_MAGIC, at)
        if at < 0 or start + at >= end:
            return
        found = part.member(at)
        if found:
            yield found[0]
            at = found[1]
        else:
            at += 1


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record per row; returns the archives: path, bytes, records."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    firsts = (
        rows.where(F.col("size") >= SMALLEST)
        .groupBy(F.col("digest").alias("of"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
    )
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = rows.join(firsts, (F.col("digest") == F.col("of")) & (F.col("size") >= SMALLEST), "left")
    marked = marked.select(
        "page_id", "url", F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "size", "digest", F.when(again, F.col("first")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[bytes]:
            for batch in batches:
                columns = [batch[c].to_pylist() for c in ("page_id", "url", "payload", "size", "digest", "refers_to")]
                yield from (encode_record(*row) for row in zip(*columns))

        todo = members()
        first = next(todo, None)
        if first is None:
            return
        name, size, count = f"part-{partition_index():06d}.warc.gz", 0, 0
        with whole_file(folder, name) as out:
            for member in (m for some in ([first], todo) for m in some):
                out.write(member)
                size, count = size + len(member), count + 1
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [count]})

    return checkpoint(marked.mapInArrow(write, "path string, bytes long, records long"))


_READ_SCHEMA = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
    "record_id string, date string, digest_holds boolean, payload binary"
)


def archives(folder: str) -> list[tuple[str, int]]:
    """Paths and sizes of the archives of a folder, as any reader lists its files."""
    store, root = locate(folder)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    scheme = folder[: len(folder) - len(root)] if folder.endswith(root) else ""
    return [(f"{scheme}{x.path}", x.size) for x in found if x.is_file and x.path.endswith(".warc.gz")]


def read_archives(spark: SparkSession, folder: str, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """Records of all archives of a folder, read in byte ranges of ``split``.

    ``payload_digest`` is the SHA-256 of the payload, of revisits what their header says; ``digest_holds`` whether the payload has the digest of its header.
    """
    files = archives(folder)
    # The driver knows the files; their ranges are made by tasks.
    ranges = sum(-(-size // split) for _, size in files)
    table = spark.createDataFrame(files, "path string, size long").where("size > 0")
    low = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long")))
    table = table.select("path", "size", low.alias("low")).withColumn("high", F.least(F.col("low") + split, "size"))
    table = table.coalesce(1).repartition(max(1, ranges))

    def read(row: dict) -> Iterator[pa.RecordBatch]:
        store, path = locate(row["path"])
        with store.open_input_file(path) as source:
            waiting, held = [], 0
            for raw in range_records(source, row["low"], row["high"], row["size"]):
                for record in decode_records(raw):
                    if not payloads:
                        record["payload"] = None
                    waiting.append(record)
                    held += len(record["payload"] or b"") + 300
                    if held > 8 * _READ:
                        yield _batch(waiting)
                        waiting, held = [], 0
            if waiting:
                yield _batch(waiting)

    return table.mapInArrow(lambda batches: each(batches, read), _READ_SCHEMA)


_ARROW = pa.schema([
    ("page_id", pa.int64()),
    ("url", pa.string()),
    ("record_type", pa.string()),
    ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()),
    ("refers_to", pa.int64()),
    ("record_id", pa.string()),
    ("date", pa.string()),
    ("digest_holds", pa.bool_()),
    ("payload", pa.binary()),
])


def _batch(records: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(records, schema=_ARROW)
