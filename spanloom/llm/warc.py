"""Legacy archive converter: ARC (versions 1 and 2) to WARC, both written and read with Spark.

Archives are plain record streams of bytes: a task collects records up to a size
and yields them as one row, which Spark's text writer puts down unread as a file
of its own, so files reach any store that Spark writes to. They are read back
whole and parsed by their declared lengths, never by separators.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flag_keys, new_path, stage

#: Bytes of records from which on an archive file is full: it holds one record beyond that at most.
ARCHIVE_BYTES = 16 << 20
#: Equal payloads from this size on are written once and then revisited.
REVISIT_BYTES = 1000
#: Fixed values of the formats: the header lines' field names by version.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
KEY_HEADER = b"X-Record-Key"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "place string, key long, uri string, ip string, date string, mime string, head binary, payload binary, bytes long, digest string, info boolean"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]").sub


def _line(*fields) -> bytes:
    return " ".join(str(f) for f in fields).encode()


def _filedesc(version: str, date: str) -> bytes:
    block = f"{version} 0 spanloom\n{ARC_FIELDS[version]}\n".encode()
    blank = () if version == "1" else (200, "-", "-", 0, "records.arc")
    return _line("filedesc://records.arc", "0.0.0.0", date, "text/plain", *blank, len(block)) + b"\n" + block


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "20260101000000", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """ARC files under ``path``, one record for each row; every other file of a task is of version 2.

    A body is a string or binary; a null one is empty. A null URL is
    ``urn:row:<key>``; white space and control characters in a URL are
    percent-encoded, as header fields are split at blanks.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size, version = [], 0, "1"
        for batch in batches:
            for key, url, body in zip(batch["key"], batch["url"], batch["body"]):
                body = body or b""
                url = _UNSAFE(lambda m: b"%%%02X" % m[0][0], (f"urn:row:{key}" if url is None else url or "urn:row:").encode())
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s: %s\r\n\r\n" % (len(body), KEY_HEADER, key.encode())
                blank = () if version == "1" else (200, "-", "-", 0, "records.arc")
                line = b" ".join([url, _line("0.0.0.0", date, "text/html", *blank, len(head) + len(body))])
                parts += [line, b"\n", head, body, b"\n"] if parts else [_filedesc(version, date), b"\n", line, b"\n", head, body, b"\n"]
                size += len(line) + len(head) + len(body)
                if size >= archive_bytes:
                    yield pd.DataFrame({"value": [b"".join(parts[:-1])]})
                    parts, size, version = [], 0, "1" if version == "2" else "2"
        if parts:
            yield pd.DataFrame({"value": [b"".join(parts[:-1])]})

    rows = pages.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("key"), F.col(url_col).cast("string").alias("url"), F.col(body_col).cast("binary").alias("body"))
    _write(rows.mapInPandas(write, "value binary"), path, "\n")


def _write(archives: DataFrame, path: str, separator: str) -> None:
    """Each row as a file; the writer passes a string's bytes on as they are and ends them with the separator."""
    archives.select(F.col("value").cast("string")).write.option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path)


def _unzip(data: bytes) -> bytes:
    """All members of a gzip file; other data as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        data = z.unused_data
    return b"".join(out) or data


def _readable(field: bytes) -> str:
    """A header field as text: bytes that are no UTF-8, and blanks, are percent-encoded."""
    return "".join(f"%{ord(c) - 0xDC00:02X}" if 0xDC80 <= ord(c) <= 0xDCFF else "%20" if c == " " else c for c in field.decode("utf-8", "surrogateescape"))


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows as a frame whose keys stay whole numbers beside nulls."""
    found = pd.DataFrame(rows, columns=columns, dtype=object)
    for i, c in enumerate(columns):
        if c in ("key", "refers_to"):
            found[c] = pd.Series([r[i] for r in rows], dtype="Int64")
    return found


def parse_arc(data: bytes) -> Iterator[tuple[int, str, str, str, str, bool, bytes]]:
    """(offset, url, ip, date, content type, is version block, content) of each record.

    The version block says how many fields header lines have from there on; a URL
    may hold blanks, as fields are counted from the end. A last record shorter
    than declared is passed on as far as it goes; a line that is no header raises
    ValueError, as what follows can't be told apart.
    """
    at, fields = 0, 5
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].rstrip(b"\r")
        if not line:
            at = end + 1
            continue
        info = line.startswith(b"filedesc://")
        wanted = fields if not info else 10 if line.count(b" ") >= 9 else 5
        parts = line.rsplit(b" ", wanted - 1)
        if len(parts) != wanted or not parts[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}: {line[:80]!r}")
        content = data[end + 1 : end + 1 + int(parts[-1])]
        if info:
            version = content.split(b" ", 1)[0].decode("ascii", "replace")
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version!r} is not known")
            fields = len(ARC_FIELDS[version].split(" "))
        yield at, *map(_readable, parts[:4]), info, content
        at = end + 1 + int(parts[-1]) + 1


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the ARC files under ``path``, with place (file and offset), digest and size of the full payload.

    The payload of an HTTP exchange is what follows its head; of other records,
    which have no head, it is all. Heads and payloads are bytes, whatever their encoding.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows, file = [], hashlib.sha1(name.encode()).hexdigest()[:20]
                for at, uri, ip, date, mime, info, block in parse_arc(_unzip(content)):
                    head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                    key = next((h.split(b":", 1)[1].strip() for h in head.split(b"\r\n") if h.startswith(KEY_HEADER + b":")), b"")
                    rows.append((f"{file}:{at}", int(key) if key.lstrip(b"-").isdigit() else None, uri, ip, date, mime, head, payload if payloads else None, len(payload), hashlib.sha1(payload).hexdigest(), info))
                yield _frame(rows, [x.split()[0] for x in RECORDS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, RECORDS)


def record_id(key: str, place: str) -> str:
    """Unique by the record's file and offset; the same archive gives the same identifiers in every run."""
    return f"<urn:record:{key}:{place}>"


def stamp(date: str) -> str:
    """An ARC date of up to 14 digits as a WARC date; what is missing is the earliest there is, what is no date 1970."""
    d = date[:14] if date.isdigit() and len(date) >= 4 else "1970"
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _warc_record(r) -> bytes:
    """One WARC/1.1 record, without the blank lines that end it."""
    b32 = lambda digest: "sha1:" + base64.b32encode(digest).decode()
    if r.info:
        kind, block, lines = "warcinfo", r.payload, ["Content-Type: text/plain"]
    else:
        again = isinstance(r.rep, str) and r.head != b""
        kind = "revisit" if again else "response" if r.head else "resource"
        block = (r.head + b"\r\n\r\n" if r.head else b"") + (b"" if again else r.payload)
        mime = "application/http; msgtype=response" if r.head else r.mime
        lines = [f"WARC-Target-URI: {r.uri}", f"WARC-IP-Address: {r.ip}", f"WARC-Payload-Digest: {b32(bytes.fromhex(r.digest))}", f"Content-Type: {mime}"]
        if again:
            lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(r.rep_key, r.rep)}", f"WARC-Refers-To-Target-URI: {r.rep_uri}", f"WARC-Refers-To-Date: {stamp(r.rep_date)}", f"X-Payload-Length: {r.bytes}"]
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(r.key, r.place)}", f"WARC-Date: {stamp(r.date)}", *lines, f"WARC-Block-Digest: {b32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block


def convert(spark: SparkSession, arc_path: str, warc_path: str, archive_bytes: int = ARCHIVE_BYTES, revisit_bytes: int = REVISIT_BYTES) -> None:
    """WARC files under ``warc_path`` for the ARC files under ``arc_path``.

    Of equal payloads of at least ``revisit_bytes`` the record with the largest
    key is a response and the others revisit it (a null key is smaller than any;
    of records tied on it, one is the response); smaller payloads are all
    responses. Records without an HTTP head become resources, version blocks
    warcinfo. A filter clears records whose payload nobody shares where they lie;
    only the others meet their response in a join, which can be split.
    """
    small = read_arc(spark, arc_path, payloads=False).where(~F.col("info") & (F.octet_length("head") > 0) & (F.col("bytes") >= revisit_bytes))
    again = small.groupBy("digest", "bytes").agg(F.count("*").alias("c"), F.max(F.struct("key", "place", "uri", "date")).alias("top")).where("c > 1")
    again = stage(again.select("digest", "bytes", F.col("top.place").alias("rep"), F.col("top.key").alias("rep_key"), F.col("top.uri").alias("rep_uri"), F.col("top.date").alias("rep_date")), "warc-again")
    rows = flag_keys(read_arc(spark, arc_path), "digest", again.select("digest"), "shared")
    met = rows.where("shared").join(again.hint("merge"), ["digest", "bytes"], "left").withColumn("rep", F.when(F.col("rep") != F.col("place"), F.col("rep")))
    rows = rows.where("NOT shared").unionByName(met, allowMissingColumns=True)
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("key", "rep_key")})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                record = _warc_record(r)
                parts.append(record)
                size += len(record)
                if size >= archive_bytes:
                    yield pd.DataFrame({"value": [b"\r\n\r\n".join(parts)]})
                    parts, size = [], 0
        if parts:
            yield pd.DataFrame({"value": [b"\r\n\r\n".join(parts)]})

    _write(rows.mapInPandas(write, "value binary"), warc_path, "\r\n\r\n")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared length."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            if data[at:].strip():
                raise ValueError(f"no WARC header at byte {at}")
            return
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}: {lines[0][:80]!r}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each response, resource or revisit: its key and id, target, date, type, what it refers to (key and id), and size, digest and, if asked for, bytes of the payload.

    A response's size and digest are those of the payload found; a digest other
    than the header's raises ValueError. A revisit's are its headers', its payload is null.
    """

    def key_of(name: str | None) -> int | None:
        key = (name or "::").split(":")[2]
        return int(key) if key else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for headers, block in parse_warc(_unzip(content)):
                    kind, name, refers = headers["WARC-Type"], headers["WARC-Record-ID"], headers.get("WARC-Refers-To")
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    payload = block if kind == "resource" else block.partition(b"\r\n\r\n")[2]
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].split(":")[1]).hex()
                    if kind != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload digest of {name} does not hold")
                    size = int(headers["X-Payload-Length"]) if kind == "revisit" else len(payload)
                    rows.append((key_of(name), name, headers["WARC-Target-URI"], headers["WARC-Date"], kind, key_of(refers), refers, size, digest, payload if payloads and kind != "revisit" else None))
                yield _frame(rows, ["key", "id", "uri", "date", "type", "refers_to", "refers_to_id", "bytes", "digest", "payload"])

    schema = "key long, id string, uri string, date string, type string, refers_to long, refers_to_id string, bytes long, digest string, payload binary"
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)


def convert_pages(pages: DataFrame, **names) -> DataFrame:
    """Write ``pages`` as ARC, convert that to WARC and read the WARC back.

    A null body is an empty payload, a null id an empty key; rows that repeat an id
    stay separate records. An empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc, **names)
    convert(spark, arc, warc)
    return read_warc(spark, warc)
