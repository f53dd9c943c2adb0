"""Legacy archive converter: ARC files to WARC records, with revisits for repeated payloads.

ARC has a version block first, then records of one header line and as many bytes as it declares. Version 1 lines have
five fields, version 2 lines ten. Each record becomes a WARC record of the same capture: identifier, date, type and
digests are derived from what the ARC record says, so a second conversion gives the same bytes. Archives are kept as
rows of bytes (one row holds some megabytes of consecutive records), which any file system that Spark writes can hold.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import broadcast_if_small, materialize, small_batches

#: The fields of a header line by ARC version.
ARC_FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result", "checksum", "location", "offset", "filename", "length"),
}
ARCHIVE_BYTES = 8 << 20
#: Payloads from this size on are stored once.
REVISIT_FROM = 1000
_EPOCH = 1_262_304_000  # 2010-01-01, the date of page 0 in archives made here
PAGE_HEADER = b"X-Page-Id"


@dataclass(frozen=True)
class ArcRecord:
    version: int
    fields: dict[str, str]
    block: bytes
    opens: bool = False  # the version block that begins the file


def _stamp(seconds: int) -> str:
    import time

    return time.strftime("%Y%m%d%H%M%S", time.gmtime(seconds))


def arc_version_block(version: int, name: str = "pages.arc", date: str = "20100101000000") -> bytes:
    body = f"{version} 0 converter\n{' '.join(_LEGEND[version])}\n".encode()
    head = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"]
    extra = ["200", "-", "-", "0", name] if version == 2 else []
    return " ".join([*head, *extra, str(len(body))]).encode() + b"\n" + body + b"\n"


#: The legend line of each version's first block.
_LEGEND = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}


def _url_field(url: str | None) -> str:
    """A header line is split at spaces, so white space and control characters are escaped; a missing address is 'about:blank'."""
    return "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "about:blank"


def arc_record(version: int, url: str | None, block: bytes, date: str, ip: str = "0.0.0.0", content_type: str = "text/html", offset: int = 0, name: str = "pages.arc") -> bytes:
    extra = ["200", hashlib.md5(block).hexdigest(), "-", str(offset), name] if version == 2 else []
    return " ".join([_url_field(url), ip, date, content_type, *extra, str(len(block))]).encode() + b"\n" + block + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, plain or with each record gzipped, the version block first.

    Only the first record can be a version block: its address begins with filedesc: and it is plain text. A page of such
    an address is a record like any other, and a file without a version block is read as version 1. The version comes from the version block's first line; a header line with fewer fields than its version has, or a
    block shorter than it declares, is an error.
    """
    if data[:2] == b"\x1f\x8b":
        data = b"".join(_members(data))
    at, version, first = 0, 1, True
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line without an end at byte {at}")
        parts = data[at:end].decode("utf-8", "replace").split()
        length = int(parts[-1]) if parts and parts[-1].isdigit() else -1
        block = data[end + 1 : end + 1 + length]
        if length < 0 or len(block) < length:
            raise ValueError(f"bad or unmet length at byte {at}")
        opens = first and parts[0].startswith("filedesc:") and "text/plain" in parts[3:-1]
        first = False
        if opens:
            stated = block.split(None, 1)[:1]
            version = int(stated[0]) if stated and stated[0].isdigit() else 0
            if version not in ARC_FIELDS:
                raise ValueError(f"version block without a known version: {block[:40]!r}")
        names = ARC_FIELDS[version]
        if len(parts) < len(names):
            raise ValueError(f"version {version} header with {len(parts)} fields at byte {at}")
        # a content type may hold spaces; everything else is one field
        spare = len(parts) - len(names)
        joined = [*parts[:3], " ".join(parts[3 : 4 + spare]), *parts[4 + spare :]]
        yield ArcRecord(version, dict(zip(names, joined, strict=True)), block, opens)
        at = end + 1 + length


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload) of an HTTP message; a block that is none is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    for mark in (b"\r\n\r\n", b"\n\n"):
        if (at := block.find(mark)) >= 0:
            return block[: at + len(mark)], block[at + len(mark) :]
    return block, b""


def warc_date(arc_date: str) -> str:
    """YYYYMMDDhhmmss (or a leading part of it) as an ISO date in UTC."""
    full = arc_date + "00000101000000"[len(arc_date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def warc_type(record: ArcRecord) -> str:
    if record.opens:
        return "warcinfo"
    return "response" if record.block.startswith(b"HTTP/") else "resource"


def record_id(url: str, date: str, digest: str, key: str = "") -> str:
    """The same capture gets the same identifier in every conversion."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {date} {digest} {key}").urn


def _base32(digest_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode()


def warc_record(kind: str, identifier: str, date: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    named = [("WARC-Type", kind), ("WARC-Record-ID", f"<{identifier}>"), ("WARC-Date", date), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _members(data: bytes) -> Iterator[bytes]:
    """The contents of each gzip member; data is fed in pieces, so that long archives are not copied once per member."""
    at, step = 0, 1 << 16
    while at < len(data):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            piece = data[at : at + step]
            if not piece:
                raise ValueError("truncated gzip member")
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(out)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a WARC file with one gzip member per record."""
    for record in _members(data):
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        length = int(headers["content-length"])
        if len(rest) < length:
            raise ValueError("truncated WARC record")
        yield headers, rest[:length]


CONVERTED = "page_id bigint, url string, date string, record_id string, kind string, digest string, payload_bytes bigint, block binary"


def pages_to_arc(pages: DataFrame, version: int = 1, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(arc): legacy archives of the pages, an HTTP response each, some megabytes per row. The page's id is kept in an
    HTTP header, and its capture is dated that many seconds after the first of 2010.

    Null html: no payload; null id: no such header; null or empty url: about:blank; white space in urls is escaped.
    Repeated rows are captured each, a page longer than ARCHIVE_BYTES is an archive of its own, an empty table gives no
    archives; other columns are dropped.
    """

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in small_batches(batch, 2, ARCHIVE_BYTES):
                out, at = [arc_version_block(version)], 0
                for page, url, html in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    own = b"" if page is None else PAGE_HEADER + b": %d\r\n" % page
                    body = (html or "").encode()
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(body) + body
                    at += len(out[-1])
                    out.append(arc_record(version, url, block, _stamp(_EPOCH + (page or 0) % (1 << 31)), offset=at))
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["arc"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(each, "arc binary")


def convert_arc(archives: DataFrame, arc_col: str = "arc") -> DataFrame:
    """A row per ARC record: (page_id, url, date, record_id, kind, digest, payload_bytes, block), version blocks as warcinfo.

    page_id is the number in the page header, null without one. A null archive has no records; a damaged one is an error.
    """

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "date", "record_id", "kind", "digest", "payload_bytes", "block"]
        for batch in batches:
            for arc in batch.column(0):
                out = []
                for record in parse_arc(arc.as_py() or b""):
                    head, payload = split_http(record.block)
                    digest = hashlib.sha1(payload).hexdigest()
                    at = head.find(b"\r\n" + PAGE_HEADER + b": ")
                    page = int(head[at + len(PAGE_HEADER) + 4 :].split(b"\r\n", 1)[0]) if at >= 0 else None
                    date = warc_date(record.fields["date"])
                    out.append((page, record.fields["url"], date, record_id(record.fields["url"], date, digest, str(page)), warc_type(record), digest, len(payload), record.block))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return archives.select(F.col(arc_col).alias("arc")).mapInArrow(each, CONVERTED)


def with_revisits(records: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """records with `kind` set to revisit, and refers_to, refers_to_id, refers_to_url and refers_to_date, where a response
    with an equal payload of at least `least` bytes and a larger page_id exists; equal largest ids are all responses."""
    responses = records.where((F.col("kind") == "response") & (F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    kept = responses.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "record_id", "url", "date")).alias("first"))
    kept = materialize(kept.where("n > 1").select(F.col("digest").alias("same"), "first"), "repeated")
    joined = records.join(broadcast_if_small(kept), (F.col("digest") == F.col("same")) & (F.col("payload_bytes") >= least) & (F.col("kind") == "response"), "left")
    moved = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    refers = [F.when(moved, F.col(f"first.{c}")).alias(n) for c, n in (("page_id", "refers_to"), ("record_id", "refers_to_id"), ("url", "refers_to_url"), ("date", "refers_to_date"))]
    plain = [c for c in records.columns if c != "kind"]
    return joined.select(*plain, F.when(moved, F.lit("revisit")).otherwise(F.col("kind")).alias("kind"), *refers)


def write_warc(records: DataFrame, path: str) -> None:
    """Store records as WARC archives under path: rows (warc) of gzipped records, some megabytes each, warcinfo records too.

    A revisit keeps its HTTP head; its payload is that of the record it refers to. Repeated rows are written each, an
    empty table writes no archives.
    """

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in small_batches(batch, batch.schema.get_field_index("block"), ARCHIVE_BYTES):
                out = []
                for r in part.to_pylist():
                    block, headers = r["block"], [("WARC-Target-URI", r["url"])]
                    head, _ = split_http(block)
                    if r["kind"] == "warcinfo":
                        headers = [("WARC-Filename", r["url"].removeprefix("filedesc://")), ("Content-Type", "application/warc-fields")]
                    elif r["kind"] == "revisit":
                        block = head
                        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                        headers += [("WARC-Profile", profile), ("WARC-Refers-To", f"<{r['refers_to_id']}>"), ("WARC-Refers-To-Target-URI", r["refers_to_url"]), ("WARC-Refers-To-Date", r["refers_to_date"])]
                    if r["kind"] in ("response", "revisit"):
                        headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", _base32(r["digest"]))]
                    headers.append(("WARC-Block-Digest", _base32(hashlib.sha1(block).hexdigest())))
                    out.append(gzip_member(warc_record(r["kind"], r["record_id"], r["date"], headers, block)))
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["warc"])

    records.mapInArrow(each, "warc binary").write.option("compression", "none").parquet(path)


def read_warc(archives: DataFrame, warc_col: str = "warc") -> DataFrame:
    """(page_id, kind, record_id, url, date, payload_bytes, payload_digest, refers_to_id) per response, resource or revisit.

    Digests of stored payloads are computed from the bytes read and must equal the header's, as block digests must. A
    revisit's payload_bytes are null: its record holds no payload. A null archive has no records; repeated archives are
    read each; other columns are dropped.
    """

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["page_id", "kind", "record_id", "url", "date", "payload_bytes", "payload_digest", "refers_to_id"]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            for data in batch.column(0):
                out = []
                for h, block in parse_warc(data.as_py() or b""):
                    kind = h["warc-type"]
                    if kind == "warcinfo":
                        continue
                    if "warc-block-digest" in h and h["warc-block-digest"] != _base32(hashlib.sha1(block).hexdigest()):
                        raise ValueError(f"block digest differs in {h['warc-record-id']}")
                    head, payload = split_http(block)
                    if kind == "revisit":
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        size = None
                    else:
                        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                        if "warc-payload-digest" in h and h["warc-payload-digest"] != _base32(digest):
                            raise ValueError(f"payload digest differs in {h['warc-record-id']}")
                    at = head.find(b"\r\n" + PAGE_HEADER + b": ")
                    page = int(head[at + len(PAGE_HEADER) + 4 :].split(b"\r\n", 1)[0]) if at >= 0 else None
                    out.append((page, kind, h["warc-record-id"].strip("<>"), h.get("warc-target-uri"), h["warc-date"], size, digest, h.get("warc-refers-to", "").strip("<>") or None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return archives.select(F.col(warc_col).alias("warc")).mapInArrow(
        each, "page_id bigint, kind string, record_id string, url string, date string, payload_bytes bigint, payload_digest string, refers_to_id string"
    )


def resolved(records: DataFrame) -> DataFrame:
    """records of read_warc with refers_to, and with payload_bytes of revisits, from the record that WARC-Refers-To names.

    Rows with one identifier are captures of the same page and count as one target. A revisit whose target is missing,
    or whose target has another payload digest, keeps nulls.
    """
    wanted = records.where("refers_to_id is not null").select(F.col("refers_to_id").alias("record_id")).distinct()
    targets = records.where("kind <> 'revisit'").join(broadcast_if_small(materialize(wanted, "wanted")), "record_id", "left_semi")
    targets = targets.groupBy(F.col("record_id").alias("to_id"), F.col("payload_digest").alias("to_digest")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("to_bytes"))
    targets = broadcast_if_small(materialize(targets, "targets"))
    joined = records.join(targets, (F.col("refers_to_id") == F.col("to_id")) & (F.col("payload_digest") == F.col("to_digest")), "left")
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "to_bytes")).drop("to_id", "to_digest", "to_bytes")


def convert_pages(pages: DataFrame, path: str, version: int = 1) -> DataFrame:
    """pages to ARC, to WARC archives under path, and read back: a row per page, as read_warc, with references resolved.

    Null html is an empty payload, null urls become about:blank, repeated rows are captured each, an empty table writes
    archives without responses; other columns are dropped.
    """
    records = materialize(convert_arc(pages_to_arc(pages, version)), "converted")
    write_warc(with_revisits(records), path)
    return resolved(materialize(read_warc(pages.sparkSession.read.schema("warc binary").parquet(path)), "read-back"))
