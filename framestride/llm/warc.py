"""WARC archives: a writer with revisit records, and a salvage reader that recovers from damage.

write() puts one record per page into gzip members of archives in a folder that all executors share;
a manifest table, committed by Spark, names the archives, so files of lost or repeated tasks are
never read. salvage() reads archives (gzip members or plain records). A member or record that fails
a check (gzip CRC, version line, header, length, digest) is left, the reader searches for the next
member or version line whose record passes, goes on there, and returns the bytes in between as a
quarantined gap. Of a damaged member of several records, those that pass are kept, and the search
goes on in its inflated bytes.
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
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: An archive is closed after this many bytes.
ROLL = 64 << 20
#: Tasks that read archives, at most; more archives take turns.
ARCHIVES = 100_000
CHUNK = 1 << 18
VERSION = b"WARC/1."
LINES = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "path string, begin bigint, end bigint, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary, gap string"
_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.string()]


def digest(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes | None, size: int, payload_digest: str, refers_to: str | None, date: str) -> bytes:
    """One record, not compressed. A revisit has the HTTP header only, with the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {re.sub(r'[\x00-\x20]+', '%20', uri)}"]
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def record_id(page_id, payload_digest: str) -> str:
    """A URN of the page's id, quoted so that it holds no colon, or urn:page::digest for a null one (an empty one is %)."""
    return f"urn:page:{'' if page_id is None else quote(str(page_id), safe='') or '%'}:{payload_digest}"


def _writer(folder: str, date: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        out, name, size, n = None, "", 0, 0

        def manifest() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "records"])

        try:
            for part in parts:
                for row in part.to_pylist():
                    payload = None if row["html"] is None else row["html"].encode("utf-8", "replace")
                    own, first = row["payload_digest"], row["first_id"]
                    data = record("revisit" if payload is None else "response", record_id(row["page_id"], own), row["url"] or "urn:none", payload, row["size"], own, record_id(first, own) if payload is None else None, date)
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(data := _member(data))
                    size, n = size + len(data), n + 1
                    if size >= ROLL:
                        out.close()
                        out = None
                        yield manifest()
            if out is not None:
                out.close()
                out = None
                yield manifest()
        finally:
            if out is not None:
                out.close()

    return run


def base32(hex_digest):
    """Base32 of a 160-bit hexadecimal column, in groups of five digits to four characters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    bits = F.lpad(F.conv(F.substring(hex_digest, 1, 10), 16, 2), 40, "0")
    for i in range(1, 4):
        bits = F.concat(bits, F.lpad(F.conv(F.substring(hex_digest, 10 * i + 1, 10), 16, 2), 40, "0"))
    at = [F.conv(F.substring(bits, 5 * i + 1, 5), 2, 10).cast("int") for i in range(32)]
    return F.concat(*[F.substring(letters, x + 1, F.lit(1)) for x in at])


def write(pages: DataFrame, folder: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of pages (page_id, url, html); the manifest (path, bytes, records).

    Of the rows with equal payloads of at least `least` bytes the one with the smallest page_id is the
    response, and the others are revisits of it; rows that share that page_id too are one page written
    several times, all as responses. A null html is an empty payload, a null url is urn:none. A row
    with a null page_id revisits a row that has one; where none has one, all are responses. A very
    long html is one record like any other. Other columns are not read, whatever their names; no
    pages give no archive.
    """
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    sha, size = F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").cast("bigint").alias("size")
    keyed = base.select("page_id", "url", "html", sha, size)
    small = keyed.select("page_id", "url", "sha", "size")
    first = small.where(F.col("size") >= least).groupBy("sha", "size").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"), F.count("*").alias("n"), F.count("page_id").alias("named"))
    first = first.where("first_id != last_id or named > 0 and named < n").select("sha", "size", "first_id")
    # Revisits need no html, so what is dealt by payload is small; the responses never move for it.
    again = shared.cut(small.join(first, ["sha", "size"]).where(~F.col("page_id").eqNullSafe(F.col("first_id"))), "warc-revisits")
    own, maybe = shared.apart(keyed, again, "page_id", "sha", "size")
    told = again.select(*(F.col(c).alias(f"of_{c}") for c in ("page_id", "sha", "size"))).distinct()
    maybe = maybe.join(told, F.col("page_id").eqNullSafe(F.col("of_page_id")) & (F.col("sha") == F.col("of_sha")) & (F.col("size") == F.col("of_size")), "left_anti")
    none = F.lit(None).cast(dict(pages.dtypes)["page_id"])
    rows = own.unionAll(maybe).select("page_id", "url", "html", "size", none.alias("first_id"), base32(F.col("sha")).alias("payload_digest"))
    rows = rows.unionAll(again.select("page_id", "url", F.lit(None).cast("string").alias("html"), "size", "first_id", base32(F.col("sha")).alias("payload_digest")))
    return shared.cut(rows.mapInArrow(_writer(folder, date), "path string, bytes bigint, records bigint"), "warc-manifest")


class _Bad(Exception):
    pass


def _headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            raise _Bad("header line without a colon")
        out[key.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def _take(data: bytearray, whole: bool) -> tuple[dict, int] | None:
    """The record that data begins with, and its size; None if more bytes are needed. Raises _Bad."""
    if data[:10] not in LINES and (whole or len(data) >= 10 or not any(x.startswith(bytes(data)) for x in LINES)):
        raise _Bad("no version line")
    stop = data.find(b"\r\n\r\n")
    if stop < 0:
        if whole:
            raise _Bad("header without an end")
        return None
    line = data.find(b"\r\n")
    head = _headers(bytes(data[line + 2 : stop])) if line < stop else {}
    if not (size := head.get("content-length", "")).isdigit():
        raise _Bad("no content length")
    end = stop + 4 + int(size)
    if len(data) < end + 4:
        if whole:
            raise _Bad("record is cut short")
        return None
    if data[end : end + 4] != b"\r\n\r\n":
        raise _Bad("length does not lead to the record's end")
    block = bytes(data[stop + 4 : end])
    told = head.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != digest(block):
        raise _Bad("block digest differs")
    payload, n, kind = block, len(block), head.get("warc-type")
    if head.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        n = len(payload)
        if kind == "revisit" and (m := re.search(rb"(?mi)^content-length:\s*(\d+)", http)):
            n = int(m[1])
    told = head.get("warc-payload-digest", "")
    if told.startswith("sha1:"):
        told = told[5:]
        if kind != "revisit" and told != digest(payload):
            raise _Bad("payload digest differs")
    bare = lambda k: head[k].strip("<>") if k in head else None
    return {"record_type": kind, "record_id": bare("warc-record-id"), "target_uri": head.get("warc-target-uri"), "refers_to": bare("warc-refers-to"), "payload_digest": told or digest(payload), "payload_bytes": n, "payload": None if kind == "revisit" else payload, "gap": None}, end + 4


def _gzip(f, at: int, size: int) -> tuple[list[dict], int, str | None]:
    """Records and gaps of the member that begins at a byte, where reading ended, and why the rest is lost, if so.

    After a record that fails, the inflated bytes are searched for the next one that passes; the gap
    names them. Raises _Bad if no record passes, or if all do and the CRC differs, since that
    may be any of them.
    """
    pack, data, out, place, base = zlib.decompressobj(31), bytearray(), [], at, 0
    lost, broken, crc = None, None, False
    gap = lambda: {"gap": f"{lost[1]} (inflated bytes {lost[0]} to {base})"}
    while not pack.eof and broken is None:
        chunk = f.read_at(min(CHUNK, size - place), place) if place < size else b""
        before = pack.copy()
        try:
            data += pack.decompress(chunk)
            place += len(chunk)
            if not chunk:
                broken = "member is cut short"
        except zlib.error:
            broken = "member does not inflate or its CRC differs"
            try:
                for i in range(len(chunk)):
                    data += before.decompress(chunk[i : i + 1])
            except zlib.error as e:
                crc = "incorrect" in str(e) and "check" in str(e) and "header" not in str(e)
        done = pack.eof or broken is not None
        while data:
            try:
                got = _take(data, done)
            except _Bad as e:
                lost = lost or (base, str(e))
                n = data.find(VERSION, 1)
                n = n if n >= 0 else len(data) if done else max(1, len(data) - len(VERSION) + 1)
                del data[:n]
                base += n
                continue
            if got is None:
                break
            if lost:
                out.append(gap())
                lost = None
            out.append(got[0])
            del data[: got[1]]
            base += got[1]
    if lost:
        out.append(gap())
    failed = [x["gap"] for x in out if x["gap"] is not None]
    if out and len(failed) == len(out) or broken and not out or crc and not failed:
        raise _Bad(broken or failed[0].partition(" (inflated")[0])
    return out, place - len(pack.unused_data), broken


def _plain(f, at: int, size: int) -> tuple[list[dict], int]:
    data, place = bytearray(), at
    while True:
        chunk = f.read_at(min(CHUNK, size - place), place) if place < size else b""
        data += chunk
        place += len(chunk)
        if got := _take(data, place >= size):
            return [got[0]], at + got[1]


def read(f, size: int) -> Iterator[dict]:
    """Records and gaps of one archive, in order of their bytes; f has read_at(n, offset)."""
    at, left, why = 0, None, ""
    while at < size:
        begin, broken = f.read_at(min(len(VERSION), size - at), at), None
        try:
            if begin.startswith(MAGIC):
                found, end, broken = _gzip(f, at, size)
            elif begin == VERSION:
                found, end = _plain(f, at, size)
            else:
                raise _Bad("neither a member nor a version line")
            if left is not None:
                yield {"begin": left, "end": at, "gap": why}
                left = None
            for x in found:
                yield x | {"begin": at, "end": end}
            if broken:
                left, why = at, broken
            at = _next(f, at + 1, size) if broken else end
        except _Bad as e:
            if left is None:
                left, why = at, str(e)
            at = _next(f, at + 1, size)
    if left is not None:
        yield {"begin": left, "end": size, "gap": why}


def _next(f, at: int, size: int) -> int:
    """The next byte from `at` on that a member or a version line may begin at."""
    keep = len(VERSION) - 1
    while at < size:
        chunk = f.read_at(min(CHUNK, size - at), at)
        hits = [x for x in (chunk.find(MAGIC), chunk.find(VERSION)) if x >= 0]
        if hits:
            return at + min(hits)
        if at + len(chunk) >= size:
            return size
        at += len(chunk) - keep
    return size


def salvage(spark: SparkSession, paths: DataFrame, payload: bool = True) -> DataFrame:
    """Records and gaps of the archives that paths (path) names: RECORD's columns, one row each.

    gap is null for a record; for a quarantined range of bytes [begin, end) it says which check
    failed first, and all else is null. payload=False leaves the payloads out (after checking them).
    Each archive is read as a stream by one of as many tasks as there are archives (ARCHIVES of them
    at most). A path that is there twice is read twice; a null one gives nothing, nor does an empty
    archive or table. Other columns are not read.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path in part.column("path").to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as f:
                    rows, held = [], 0
                    for x in read(f, f.size()):
                        if not payload:
                            x["payload"] = None
                        rows.append(x | {"path": path})
                        held += 200 + len(x.get("payload") or b"")
                        if held > 4 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                    yield _rows(rows)

    names = paths.select("path").where("path is not null")
    # A number that is asked for is not coalesced, as that of a key would be for so few small rows.
    return names.repartition(min(ARCHIVES, max(1, names.count()))).mapInArrow(run, RECORD)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in rows], t) for n, t in zip(_NAMES, _KINDS, strict=True)], _NAMES)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records read back from new archives."""
    spark = pages.sparkSession
    made = write(pages, shared.scratch(spark, "warc"))
    back = salvage(spark, made, payload=False).where("gap is null")
    kind = dict(pages.dtypes)["page_id"]
    told = lambda c: F.nullif(F.split_part(F.col(c), F.lit(":"), F.lit(3)), F.lit(""))
    page = lambda c: F.when(told(c) == "%", "").otherwise(F.url_decode(told(c))).cast(kind)
    return back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
