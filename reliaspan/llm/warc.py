"""WARC archives: writing them with Spark's text sink, and reading them back with segment reassembly.

A payload is stored as an HTTP response in chunked transfer framing. A record whose block is longer
than SEGMENT bytes is cut: the first part keeps the record's type with segment number 1, the others are
continuation records that name the first by its id; the last one states the total length. The reader
groups the parts by that id, orders them by number, verifies the numbers and the total length, joins
the blocks and decodes the framing.

Records equal in payload (of at least `least` bytes) are written once; later ones are revisits that
refer to the record with the smallest id.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliaspan.session import materialise

#: Bytes of a block from which it is cut, bytes of a chunk of the framing.
SEGMENT, CHUNK = 32_768, 16_384
VERSION = b"WARC/1.1"
#: Records of one archive file, at most.
FILE_RECORDS = 2_000
#: The date that every written record states, so that reruns agree.
DATE = "2024-01-01T00:00:00Z"
LINE = b"\r\n"

ROW = "page_id long, uri string, record_type string, refers_to long, payload binary, digest string, problem string"


def digest(payload: bytes) -> str:
    """Bare base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes) -> bytes:
    """The payload in HTTP chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + CHUNK]), payload[i : i + CHUNK]) for i in range(0, len(payload), CHUNK)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if a chunk is cut off or its size is no number."""
    out, at = [], 0
    while True:
        end = body.find(LINE, at)
        if end < 0:
            raise ValueError("no chunk size")
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if size < 0 or end + 2 + size + 2 > len(body) or body[end + 2 + size : end + 4 + size] != LINE:
            raise ValueError("chunk cut off")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _record(head: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head.items()), b"Content-Length: %d" % len(block)]
    return LINE.join(lines) + LINE + LINE + block


def _name(page_id: int | None, payload_digest: str, part: int = 1, copy: int | None = None) -> str:
    own = f"{page_id}/{payload_digest}/{part}" if copy is None else f"{page_id}/{payload_digest}/{part}/{copy}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, own)}>"


def records(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, copy: int | None = None, one: bool = True) -> Iterator[bytes]:
    """The WARC records of one page: a response in one or more segments, or a revisit of page `refers_to`.

    `copy` tells rows with the same page_id and payload apart. A revisit names the record it refers to
    only if the page `refers_to` has `one` with that payload.
    """
    checksum = digest(payload)
    head = {"WARC-Type": "response", "WARC-Record-ID": _name(page_id, checksum, 1, copy), "WARC-Date": DATE}
    if uri is not None:
        head["WARC-Target-URI"] = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in uri)
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    head |= {"WARC-Payload-Digest": f"sha1:{checksum}", "X-Payload-Length": str(len(payload))}
    if refers_to is not None:
        head |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", **({"WARC-Refers-To": _name(refers_to, checksum)} if one else {}), "X-Refers-To-Page-ID": str(refers_to), "Content-Type": "application/http; msgtype=response"}
        yield _record(head, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= SEGMENT:
        yield _record(head | {"Content-Type": "application/http; msgtype=response"}, block)
        return
    parts = range(0, len(block), SEGMENT)
    for n, at in enumerate(parts, 1):
        own = head | {"Content-Type": "application/http; msgtype=response", "WARC-Segment-Number": "1"} if n == 1 else {
            "WARC-Type": "continuation", "WARC-Record-ID": _name(page_id, checksum, n, copy), "WARC-Date": DATE, "WARC-Segment-Origin-ID": head["WARC-Record-ID"], "WARC-Segment-Number": str(n)
        }
        if n == len(parts) and n > 1:
            own["WARC-Segment-Total-Length"] = str(len(block))
        yield _record(own, block[at : at + SEGMENT])


def write(pages: DataFrame, path: str, page_id: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0) -> None:
    """Writes a record for each row of pages as gzip-compressed archives under `path`, by Spark's text sink.

    Text payloads are written in UTF-8, NULL as an empty payload. Equal payloads of at least `least`
    bytes: the row with the smallest id is the response, others revisit it; rows that repeat that id
    are responses, and rows with a NULL id are, where no row of the payload has an id. Rows with the same
    id and payload have record ids made from their place, which may differ in a rerun.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(uri).cast("string").alias("uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    key = F.unhex(F.sha1("payload"))
    per = rows.groupBy(key.alias("key"), "page_id").agg(F.count("*").alias("m"), F.max(F.octet_length("payload")).alias("size"))
    id_of = F.when(F.max("size") >= least, F.min("page_id"))
    first = per.groupBy("key").agg(id_of.alias("first_id"), F.coalesce(F.min_by("m", "page_id"), F.max("m")).alias("first_m"), F.max("m").alias("most"), F.sum("m").alias("n")).filter("n > 1").drop("n")
    is_first = F.col("page_id").eqNullSafe(F.col("first_id"))
    copy = F.when((F.col("most") > 1) & ~(is_first & (F.col("first_m") == 1)), F.monotonically_increasing_id())
    joined = rows.withColumn("own", key).join(first, F.col("own") == F.col("key"), "left")
    marked = joined.select("page_id", "uri", "payload", F.when(~is_first, F.col("first_id")).alias("refers_to"), copy.alias("copy"), F.coalesce(F.col("first_m") == 1, F.lit(True)).alias("one"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in records(*row)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    # the sink writes a string's bytes as they are, and the line end is what WARC puts after a record
    made = marked.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    made.write.mode("overwrite").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def inflate(content: bytes) -> bytes:
    """An archive's bytes: plain, or gzip of the whole or of each record."""
    out = []
    while content.startswith(b"\x1f\x8b"):
        d = zlib.decompressobj(31)
        out.append(d.decompress(content))
        if not d.eof:
            raise ValueError("archive cut off")
        content = d.unused_data
    return b"".join([*out, content])


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of the records of an archive; ValueError at one that is cut off."""
    at = 0
    while at < len(content):
        if content.startswith(LINE, at):
            at += 2
            continue
        end = content.find(LINE + LINE, at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        head: dict[str, str] = {}
        for line in content[at:end].split(LINE)[1:]:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        if end + 4 + size > len(content):
            raise ValueError(f"record cut off at byte {at}")
        yield head, content[end + 4 : end + 4 + size]
        at = end + 4 + size


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP message, without chunked framing."""
    head, gap, body = block.partition(LINE + LINE)
    if not gap:
        raise ValueError("no HTTP head")
    chunks = any(line.lower().replace(b" ", b"").startswith(b"transfer-encoding:chunked") for line in head.split(LINE))
    return unchunked(body) if chunks else body


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under `path` as rows of ROW: responses and revisits, made whole again.

    `problem` is NULL, or says why a record could not be made whole: a missing or repeated segment, a
    wrong total length, broken framing, or a digest that differs; its payload is then NULL. A revisit has
    no payload of its own. Segments may lie in any file, in any order. An archive file is read in one
    task and must fit its memory; the writer bounds it by records, a record by its page.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("content")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["origin", "segment", "total", "page_id", "uri", "record_type", "refers_to", "digest", "block"]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        number = lambda x: None if x is None else int(x)
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for h, block in parse(inflate(content.as_py())):
                    more = h["warc-type"] == "continuation"
                    if not more and h["warc-type"] not in ("response", "revisit"):
                        continue
                    segment = number(h.get("warc-segment-number"))
                    rows.append((h["warc-segment-origin-id"] if more else h["warc-record-id"], segment, number(h.get("warc-segment-total-length")), number(h.get("x-page-id")), h.get("warc-target-uri"), h["warc-type"], number(h.get("x-refers-to-page-id")), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, block))
                    held += len(block)
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    parts = files.mapInArrow(split, "origin string, segment int, total long, page_id long, uri string, record_type string, refers_to long, digest string, block binary")
    head = ("page_id", "uri", "record_type", "refers_to", "digest")
    whole = parts.filter("segment is null").select(*head, "block", F.lit(None).cast("string").alias("problem"))
    cut = (
        parts.filter("segment is not null").groupBy("origin")
        .agg(F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("s"), F.max("total").alias("total"), *[F.max_by(c, -F.col("segment")).alias(c) for c in head])
        .withColumn("numbers", F.transform("s", lambda x: x["segment"]))
        .withColumn("size", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"])))
        .select(
            *head,
            F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["block"])), "")).alias("block"),
            F.when(F.col("numbers") != F.sequence(F.lit(1), F.size("numbers")), "segments missing or repeated").when(~F.col("total").eqNullSafe(F.col("size")), "wrong total length").alias("problem"),
        )
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads, problems = [], []
            c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for block, kind, want, problem in zip(c["block"], c["record_type"].to_pylist(), c["digest"].to_pylist(), c["problem"].to_pylist(), strict=True):
                body = None
                if problem is None and kind == "response":
                    try:
                        body = http_payload(block.as_py())
                        if want is not None and digest(body) != want:
                            body, problem = None, "wrong digest"
                    except ValueError as e:
                        problem = str(e)
                payloads.append(body)
                problems.append(problem)
            yield pa.RecordBatch.from_arrays([*(c[n] for n in ("page_id", "uri", "record_type", "refers_to")), pa.array(payloads, pa.binary()), c["digest"], pa.array(problems, pa.string())], ["page_id", "uri", "record_type", "refers_to", "payload", "digest", "problem"])

    return whole.unionByName(cut).mapInArrow(finish, ROW)


def resolve(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, problem) of read records.

    A revisit's size is that of the response it refers to, found by digest; NULL, with a problem, if
    there is none. Only digests and sizes are shuffled, never payloads.
    """
    short = materialise(found.select("page_id", F.octet_length("payload").cast("long").alias("own_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", "problem"))
    sizes = short.filter("record_type = 'response' and problem is null").groupBy(F.col("payload_digest").alias("of")).agg(F.max("own_bytes").alias("full_bytes"))
    revisits = short.filter("record_type = 'revisit'")
    looked_up = revisits.join(sizes, F.col("payload_digest") == F.col("of"), "left")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")
    known = looked_up.withColumn("payload_bytes", F.col("full_bytes")).withColumn("problem", F.when(F.col("full_bytes").isNull(), "no response to refer to")).select(*columns)
    return short.filter("record_type = 'response'").withColumn("payload_bytes", F.col("own_bytes")).select(*columns).unionByName(known)
