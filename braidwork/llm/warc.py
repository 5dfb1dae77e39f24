"""WARC archives: writing with revisits and segments, and reassembly of what is read back."""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT_BYTES = 1000
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
END = b"\r\n\r\n"
#: Revisits listed in one broadcast; with more of them the join shuffles.
MAX_BROADCAST_ROWS = 200_000
SALTS = 16
#: The headers of the format that are used here.
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return VERSION + b"\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = []
    for a in range(0, len(payload), size):
        part = payload[a : a + size]
        out += (b"%x\r\n" % len(part), part, b"\r\n")
    return b"".join(out) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body; trailers are passed over. A broken frame raises ValueError."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size without an end")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of another length")
        out.append(body[at : at + size])
        at += size + 2


def records_of(page_id, url, payload: bytes, digest: bytes, kind: str, refers_to, uid: int, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The record of a page, without the blank lines after it, and its continuations."""
    name = f"<urn:x-page:{'' if page_id is None else page_id}:{uid}>"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", None if url is None else "".join(url.split()))]
    own = [("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()), ("X-Payload-Length", len(payload)), ("X-Page-Id", page_id)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if kind == "revisit":
        headers = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, *own, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>"), ("Content-Type", "application/http;msgtype=response")]
        return [_record(headers, http)]
    block = http + chunked(payload, chunk_bytes)
    parts = [block[a : a + segment_bytes] for a in range(0, len(block), segment_bytes)]
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, *own, ("Content-Type", "application/http;msgtype=response")]
    if len(parts) == 1:
        return [_record(headers, block)]
    out = [_record([*headers, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{n}>"), *common, ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n)]
        if n == len(parts):
            more.append(("WARC-Segment-Total-Length", len(block)))
        out.append(_record(more, part))
    return out


def _revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page, target) for all rows of groups of equal payloads of at least min_bytes, target being the largest page.

    Groups are found by SHA-256 with minima and counts combined before the
    shuffle; the rows of a group meet its target by a salted join, so that a
    group may hold any share of the rows.
    """
    keyed = pages.where(F.length("payload") >= min_bytes).select("page", F.sha2("payload", 256).alias("key"))
    groups = keyed.groupBy("key").agg(F.max("page").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "target")
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int"))
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, ["key", "salt"]).where("page < target").select("page", "key", "target").distinct()


def write_archive(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES,
    segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES,
) -> None:
    """Write one WARC record for each page into files under `path`, a folder of any file system of Spark's.

    The payload is the html in UTF-8 (null: empty), sent with chunked transfer
    framing.  Of pages with equal payloads of at least min_revisit_bytes the
    one of the largest id is a response and the others are revisits of it;
    rows that repeat that id are responses too, and so are all of a group if
    none has an id.  A block longer than segment_bytes is cut into a first
    record and continuations.  Empty table: an archive without records.
    """
    from .common import dropped, written

    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    again = written(_revisits(rows, min_revisit_bytes), "revisits")
    n = again.count()
    if n:
        # a page id may repeat with other payloads: the payload's key is part of the join
        flags = again.select(F.col("page").alias("p"), F.col("key"), "target")
        flags = F.broadcast(flags) if n <= MAX_BROADCAST_ROWS else flags
        key = F.when(F.length("payload") >= min_revisit_bytes, F.sha2("payload", 256))
        joined = rows.withColumn("own", key).join(flags, (F.col("page") == F.col("p")) & (F.col("own") == F.col("key")), "left").select("page", "url", "payload", "target")
    else:
        joined = rows.withColumn("target", F.lit(None).cast("long"))

    def run(batches):
        uid = TaskContext.get().partitionId() << 36
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                out = []
                for page, url, payload, target in zip(*(b.column(c).slice(lo, 200).to_pylist() for c in ("page", "url", "payload", "target"))):
                    kind = "response" if target is None else "revisit"
                    out += records_of(page, url, payload, hashlib.sha1(payload).digest(), kind, target, uid, segment_bytes, chunk_bytes)
                    uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    # each line of the text sink is one record, and its line end the two blank lines after a record
    lines = joined.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("compression", "gzip").text(path)
    dropped(again)


RECORD = "type string, origin string, segment int, total long, page_id long, refers_to long, digest string, payload_length long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under path, one row each; block is the record's content.

    The gzip files, which Spark never cuts, are read as text ended by blank
    lines; the bytes are put together again and cut by each record's
    Content-Length, so a task streams through its file and holds one record
    at a time.
    """
    parts = spark.read.option("lineSep", END.decode()).text(path).select(F.col("value").cast("binary").alias("value"))

    def parse(head: bytes) -> dict[str, str]:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:60]!r}")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def row(h: dict[str, str], block: bytes):
        number = lambda k: int(h[k]) if h.get(k) else None
        digest = h.get("warc-payload-digest")
        if digest and digest.startswith("sha1:"):
            digest = base64.b32decode(digest[5:]).hex()
        refers = h.get("warc-refers-to")
        return (
            h.get("warc-type"), h.get("warc-segment-origin-id") or h.get("warc-record-id"), number("warc-segment-number"), number("warc-segment-total-length"),
            number("x-page-id"), int(refers.split(":")[2].rstrip(">")) if refers else None, digest, number("x-payload-length"), block,
        )

    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches):
        out, held = [], 0
        head, need, stream = None, 0, bytearray()
        for b in batches:
            for x in b.column("value").to_pylist():
                stream += x + END  # the bytes of the file again
                while True:
                    if head is None:
                        skip = len(stream) - len(stream.lstrip(b"\r\n"))
                        at = stream.find(END, skip)
                        if at < 0:
                            break
                        head = parse(bytes(stream[skip:at]))
                        need = int(head["content-length"])
                        del stream[: at + len(END)]
                    if len(stream) < need:
                        break
                    out.append(row(head, bytes(stream[:need])))
                    del stream[:need]
                    held += need
                    head = None
                if held > 4 << 20 or len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out, held = [], 0
        if head is not None:
            raise ValueError("the archive ends within a record")
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return parts.mapInArrow(run, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Responses and revisits with their whole, decoded payloads.

    Segmented records are grouped by the id of the first, ordered by segment
    number and put together; their numbers must be 1, 2, ... and their length
    the total that the last one names.  Only they are shuffled.  Chunked
    transfer framing is then undone.  A broken record raises an error that
    names it.  Returns page_id, record_type, refers_to, digest (the one
    written), payload_length (the one written), payload (null for revisits).
    """
    whole = records.where("segment is null")
    parts = records.where("segment is not null").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("s"), F.max("total").alias("total"), F.max("page_id").alias("page_id"),
        F.max("digest").alias("digest"), F.max("payload_length").alias("payload_length"),
    )
    joined = parts.select(
        F.lit("response").alias("type"), "origin", F.col("page_id"), F.lit(None).cast("long").alias("refers_to"), "digest", "payload_length",
        F.when(
            (F.transform("s", lambda x: x["segment"]) == F.sequence(F.lit(1), F.size("s"))) & (F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x["block"])) == F.col("total")),
            F.col("s.block"),
        ).alias("blocks"),
    )
    one = whole.select("type", "origin", "page_id", "refers_to", "digest", "payload_length", F.array("block").alias("blocks"))

    def run(batches):
        for b in batches:
            payloads = []
            for kind, name, blocks in zip(b.column("type").to_pylist(), b.column("origin").to_pylist(), b.column("blocks").to_pylist()):
                if blocks is None:
                    raise ValueError(f"segments of {name} are missing or of another length")
                if kind == "revisit":
                    payloads.append(None)
                    continue
                head, _, body = b"".join(blocks).partition(END)
                payloads.append(dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("type"), b.column("refers_to"), b.column("digest"), b.column("payload_length"), pa.array(payloads, pa.binary())], ["page_id", "record_type", "refers_to", "digest", "payload_length", "payload"])

    return one.unionByName(joined).where("type in ('response', 'revisit')").mapInArrow(run, "page_id long, record_type string, refers_to long, digest string, payload_length long, payload binary")
