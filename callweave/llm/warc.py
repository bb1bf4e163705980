"""WARC/1.1 archives: a writer with revisit records and a reader that salvages what damage leaves.

Writing. Records are rendered by SQL expressions and written by Spark's text writer, so archives go to any store
that Spark reaches; every record is a gzip member of its own, so damage to one leaves the others readable. The
text writer ends each row, some members together, with a separator, which is an empty gzip member here. Payloads of at least
`revisit_from` bytes that occur more than once are stored once, with the largest id; the others become revisit
records that hold the HTTP head only, with the digest and length of the full payload.

Reading. Archives are read whole (the writer bounds them by `bytes_per_file` and one record) and parsed in the task. A record
is accepted if its header block is well formed, its length fits, CR LF CR LF follows and the digest of its
payload agrees. After a failed check the reader searches for the next valid member (gzip) or version line, goes
on there, and reports the bytes between as a quarantined gap with the reason; `salvaged` keeps the log of gaps.

Edge cases: null payloads are empty; null ids are written as an empty id and read back as null; repeated rows are
written each; equal payloads whose largest id occurs on several rows are all responses; an empty table writes no
record and reads back empty.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_FROM = 1000
#: Bytes of an archive, and of the rows that it is written in; the last record of a row may go beyond.
BYTES_PER_FILE, ROWS_PER_FILE = 16 << 20, 8
#: Bytes and rows of a batch of parsed records.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1000
#: A gzip member without content: valid between members and at the end of a file.
EMPTY_MEMBER = b"\x1f\x8b\x08\0\0\0\0\0\0\x03\x03\0\0\0\0\0\0\0\0\0"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
SCHEMA = "path string, kind string, offset long, length long, reason string, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary"


# ---------------------------------------------------------------- writing


def _urn(id_: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(">"))


def with_revisits(pages: DataFrame, payload: str = "payload", id_: str = "id", revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Adds digest, size, record_type and refers_to. Counting by digest has map-side sums; only slim rows are joined."""
    sized = pages.withColumn("digest", F.sha1(F.col(payload))).withColumn("size", F.octet_length(payload).cast("long"))
    large = sized.where(F.col("size") >= revisit_from).groupBy(F.col("digest").alias("__d"), F.col("size").alias("__n"))
    shared = large.agg(F.max(id_).alias("__first"), F.count("*").alias("__rows")).where("__rows > 1").drop("__rows")
    joined = sized.join(shared, (F.col("digest") == F.col("__d")) & (F.col("size") == F.col("__n")), "left")
    revisits = F.coalesce(~F.col(id_).eqNullSafe(F.col("__first")) & F.col("__d").isNotNull() & F.col("__first").isNotNull(), F.lit(False))
    return joined.withColumn("record_type", F.when(revisits, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisits, F.col("__first"))).drop("__d", "__n", "__first")


def render(records: DataFrame, payload: str = "payload", id_: str = "id", uri: str = "uri", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column `value`: the bytes of the record."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("record_type") == "revisit"
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    clean = F.regexp_replace(F.coalesce(F.col(uri), F.lit("")), r"[\x00-\x20\x7f]", "")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Record-ID: "), _urn(F.col(id_)),
        F.lit("\r\nWARC-Target-URI: "), clean, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"),
    )
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col(payload))
    return records.select(F.concat(head.cast("binary"), http.cast("binary"), body, F.lit("\r\n\r\n").cast("binary")).alias("value"))


def _members(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each record as a gzip member; a row holds members until they reach `most` bytes."""

    def row(members: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["value"])

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for value in batch.column(0):
                engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                held.append(engine.compress(value.as_py()) + engine.flush())
                size += len(held[-1])
                if size >= most:
                    yield row(held)
                    held, size = [], 0
        if held:
            yield row(held)

    return compress


def write_warc(pages: DataFrame, path: str, payload: Column, id_: Column, uri: Column, revisit_from: int = REVISIT_FROM, bytes_per_file: int = BYTES_PER_FILE) -> None:
    rows = pages.select(id_.alias("id"), uri.alias("uri"), F.coalesce(payload.cast("binary"), F.lit("").cast("binary")).alias("payload"))
    members = render(with_revisits(rows, revisit_from=revisit_from)).mapInArrow(_members(bytes_per_file // ROWS_PER_FILE), "value binary").select(F.col("value").cast("string"))
    # the encoding is that of the separator; the rows' bytes are written as they are
    members.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", ROWS_PER_FILE).option("compression", "none").text(path)


# ---------------------------------------------------------------- reading


def _headers(block: bytes) -> dict[str, str] | None:
    out: dict[str, str] = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return None
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _same_digest(stated: str, payload: bytes) -> bool:
    algorithm, _, value = stated.partition(":")
    if algorithm.lower() != "sha1":
        return True
    found = hashlib.sha1(payload)
    return value.lower() == found.hexdigest() or value.upper() == base64.b32encode(found.digest()).decode()


def parse_record(data: bytes, at: int) -> tuple[dict, int] | str:
    """The record whose version line starts at `at`, and where it ends; or why there is none."""
    version = VERSION.match(data, at)
    if not version:
        return "no version line"
    end = data.find(b"\r\n\r\n", version.end())
    if end < 0:
        return "header block without end"
    headers = _headers(data[version.end() : end])
    if headers is None or "warc-type" not in headers or not headers.get("content-length", "").isdigit():
        return "malformed header block"
    start, size = end + 4, int(headers["content-length"])
    stop = start + size
    if stop + 4 > len(data):
        return "content runs past the end"
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "no end mark after the content"
    content = data[start:stop]
    payload, stated = content, None
    if headers.get("content-type", "").startswith("application/http"):
        head_end = content.find(b"\r\n\r\n")
        if head_end < 0:
            return "HTTP head without end"
        payload = content[head_end + 4 :]
        found = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", content[:head_end])
        stated = int(found[1]) if found else None
    kind = headers["warc-type"]
    if kind != "revisit" and stated is not None and stated != len(payload):
        return "payload length differs"
    digest = headers.get("warc-payload-digest", "")
    if kind != "revisit" and digest and not _same_digest(digest, payload):
        return "payload digest differs"
    record = {
        "record_type": kind, "record_id": headers.get("warc-record-id"), "refers_to": headers.get("warc-refers-to"), "target_uri": headers.get("warc-target-uri"),
        "payload_digest": digest.partition(":")[2] or None, "payload_bytes": stated if kind == "revisit" and stated is not None else len(payload), "payload": payload,
    }
    return record, stop + 4


def salvage(data: bytes, base: int = 0) -> Iterator[dict]:
    """Records of a plain archive, and the gaps between them."""
    at, gap, reason = 0, -1, ""
    while at < len(data):
        got = parse_record(data, at)
        if isinstance(got, tuple):
            if gap >= 0:
                yield {"kind": "gap", "offset": base + gap, "length": at - gap, "reason": reason}
                gap = -1
            record, end = got
            yield record | {"kind": "record", "offset": base + at, "length": end - at}
            at = end
            continue
        if gap < 0:
            gap, reason = at, got
        following = VERSION.search(data, at + 1)
        at = following.start() if following else len(data)
    if gap >= 0:
        yield {"kind": "gap", "offset": base + gap, "length": len(data) - gap, "reason": reason}


def _member(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """What the gzip member at `at` holds, where it ends, and whether it is whole; fed in steps, so little is copied twice."""
    engine, view, out, begin = zlib.decompressobj(31), memoryview(data), [], at
    step = 1 << 12
    while at < len(data):
        part = view[at : at + step]
        try:
            out.append(engine.decompress(part))
        except zlib.error:
            # a failing step gives nothing: decoded again, byte by byte, it gives what stands before the damage
            engine = zlib.decompressobj(31)
            engine.decompress(view[begin:at])
            with contextlib.suppress(zlib.error):
                while at < len(data):
                    out.append(engine.decompress(view[at : at + 1]))
                    at += 1
            break
        at += len(part)
        if engine.eof:
            return b"".join(out), at - len(engine.unused_data), True
    return b"".join(out), at, False


def salvage_gzip(data: bytes) -> Iterator[dict]:
    """Records of an archive of gzip members (one for each record, or for many); offsets are those of the members.

    Of a broken member the records before the damage are kept, and the gap begins where decoding failed; the search
    for the next valid one starts after its head, and the gap goes back to that head if a member follows before.
    """
    at, gap, reason, failed = 0, -1, "", -1
    while at < len(data):
        is_head = data[at : at + 3] == b"\x1f\x8b\x08"
        out, end, whole = _member(data, at) if is_head else (b"", at, False)
        if whole and gap >= 0:
            start = failed if gap < failed < at else gap
            yield {"kind": "gap", "offset": start, "length": at - start, "reason": reason}
            gap = failed = -1
        kept = 0
        for x in salvage(out):
            if whole or x["kind"] == "record":
                kept += 1
                yield x | {"offset": at, "length": end - at}
        if whole:
            at = end
            continue
        if gap < 0:
            gap, reason = at, "broken member" if is_head else "no member"
            failed = end if kept else -1
        following = data.find(b"\x1f\x8b\x08", at + 1)
        at = following if following >= 0 else len(data)
    if gap >= 0:
        start = failed if gap < failed < len(data) else gap
        yield {"kind": "gap", "offset": start, "length": len(data) - start, "reason": reason}


def _parse_files(with_payload: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                found = salvage_gzip(content) if content[:2] == b"\x1f\x8b" else salvage(content)
                rows: list[dict] = []
                size = 0
                for x in found:
                    rows.append(x | {"path": path} | ({} if with_payload else {"payload": None}))
                    size += len(x.get("payload") or b"") if with_payload else 0
                    if len(rows) == BATCH_ROWS or size >= BATCH_BYTES:
                        yield _frame(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows, names)

    return parse


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows).reindex(columns=names)
    return out.astype({"payload_bytes": "Int64"}).astype(object).where(lambda x: x.notna(), None)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of kind `record`, and of kind `gap` for quarantined bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(_parse_files(with_payload), SCHEMA)


def salvaged(spark: SparkSession, path: str, log: str, with_payload: bool = True) -> DataFrame:
    """The records; rows and the log of gaps are written below `log`, as kind=record and kind=gap."""
    read_warc(spark, path, with_payload).write.option("compression", "zstd").partitionBy("kind").parquet(log)
    return spark.read.schema(SCHEMA).parquet(log).where("kind = 'record'").select(*[x.split()[0] for x in SCHEMA.split(", ")])


def page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
