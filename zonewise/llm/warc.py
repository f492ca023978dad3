"""WARC archives: writing with revisit records, and reading by verified chains of records.

Reading does not trust the magic at the start of a record, which a payload may hold as well. Every
block of a file is searched for places where a well-formed header stands; each such candidate names
its successor, the byte after its body. A candidate is a record only if the chain from the start of
the file reaches it. Within a block, chains are followed at once; over blocks, reachability is found
by pointer jumping in as many rounds as the binary logarithm of the blocks in the longest file.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, col

BLOCK_BYTES = 1 << 20
#: Bytes of records in a file, about, and at most (or one record); files are read whole, one at a time, by a task.
FILE_BYTES, MOST_FILE_BYTES = 32 << 20, 256 << 20
#: Bytes of a record besides its payload and its URI, at most.
FRAME_BYTES = 600
MAGIC = b"WARC/1.1\r\n"
HEADER_END = b"\r\n\r\n"
RECORD_END = "\r\n\r\n"
#: Payloads that occur more than once, up to which their digests are broadcast (about 100 bytes each).
BROADCAST_PAYLOADS = 200_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELD = re.compile(rb"([!#$%&'*+\-.^_`|~0-9A-Za-z]+):[ \t]*([^\r\n]*)\r\n")
FIELDS = (b"content-length", b"warc-type", b"warc-record-id", b"warc-refers-to", b"warc-target-uri", b"warc-payload-digest")


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column: each 5 hexadecimal digits make 4 base32 digits."""
    digits = F.sha1(payload)

    def digit(i: Column) -> Column:
        twenty = F.conv(F.substring(digits, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("bigint")
        five = F.floor(twenty / F.pow(F.lit(32), 3 - i % 4)).cast("bigint") % 32
        return F.substring(F.lit(BASE32), five.cast("int") + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), digit), "")


def plan_records(pages: DataFrame, scratch: Scratch, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """Rows (id, url, payload, digest, refers_to): refers_to is null for a response.

    Equal payloads are told by length and SHA-256. Payloads that occur more than once are found by a
    partial aggregate without the payloads; if they are few enough by count, they are broadcast, and
    no payload is shuffled. Else the join is on the digest, whose hot keys Spark's skew join splits.
    """
    rows = pages.select(col(id_col).cast("bigint").alias("id"), col(url_col).cast("string").alias("url"), F.encode(F.coalesce(col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    repeated = rows.filter(F.col("size") >= min_bytes).groupBy("same", "size").agg(F.max("id").alias("kept"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    repeated = scratch.write(repeated, "repeated")
    met = rows.join(F.broadcast(repeated) if repeated.count() <= BROADCAST_PAYLOADS else repeated, ["same", "size"], "left")
    return met.select("id", "url", "payload", base32_sha1(F.col("payload")).alias("digest"), F.when(~F.col("id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"))


def record_text(date: str) -> Column:
    """A record without its end, as a string whose bytes are the record's. A revisit has no body."""
    line = "\r\n"
    uri = F.regexp_replace(F.col("url"), "[\\x00-\\x20\\x7F]", "%20")
    again = F.col("refers_to").isNotNull()
    body = F.when(again, F.lit("")).otherwise(F.col("payload").cast("string"))
    size = F.when(again, F.lit(0)).otherwise(F.octet_length("payload"))
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit(f"{line}WARC-Record-ID: <urn:page:"), name, F.lit(f">{line}WARC-Date: {date}"),
        F.coalesce(F.concat(F.lit(f"{line}WARC-Target-URI: "), uri), F.lit("")),
        F.lit(f"{line}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(again, F.concat(F.lit(f"{line}WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(f">{line}WARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit(f"{line}Content-Type: text/html{line}Content-Length: "), size.cast("string"), F.lit(line * 2), body,
    )


def write_archives(pages: DataFrame, path: str, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record for each row to WARC files under ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes, those with the largest id are
    responses and the others revisits of it; all other rows are responses. Rows that repeat the
    largest id are responses all. A null id counts as less than any; a null payload is empty.
    Control characters and spaces in URLs are written as %20. No file has more than MOST_FILE_BYTES, or
    one record: rows far larger than the others are written by themselves.
    """
    bytes_of = F.octet_length(F.coalesce(col(payload_col), F.lit(""))) + 3 * F.octet_length(F.coalesce(col(url_col).cast("string"), F.lit(""))) + FRAME_BYTES
    rows, total, most = pages.agg(F.count(F.lit(1)), F.sum(bytes_of), F.max(bytes_of)).first()
    mean = max(1, (total or 0) // max(1, rows))
    usual = max(mean, mean * MOST_FILE_BYTES // FILE_BYTES)
    planned = plan_records(pages, scratch, id_col, url_col, payload_col, min_bytes)
    size = F.octet_length("payload") + 3 * F.octet_length(F.coalesce("url", F.lit(""))) + FRAME_BYTES
    # the text sink writes a string's bytes as they are, and after each what ends a record
    parts = [("overwrite", size <= usual, FILE_BYTES // mean)]
    if most and most > usual:
        parts.append(("append", size > usual, MOST_FILE_BYTES // most))
    for mode, chosen, each in parts:
        made = planned.filter(chosen).select(record_text(date).alias("value"))
        made.write.option("lineSep", RECORD_END).option("maxRecordsPerFile", max(1, each)).mode(mode).text(path)


def parse_header(data: memoryview, at: int, known: dict[int, tuple | None]) -> tuple[dict[bytes, bytes], int] | None:
    """The fields (FIELDS, names in lower case) of the header whose lines start at ``at``, and the byte after it; None if it is not well-formed.

    known: what headers from a line on are, which candidates of one file share: a line of a payload
    that many magics stand before is read once.
    """
    lines = []
    while at not in known:
        if bytes(data[at : at + 2]) == b"\r\n":
            known[at] = (at + 2, None)
            break
        line = FIELD.match(data, at)
        if not line:
            known[at] = None
            break
        lines.append((at, line))
        at = line.end()
    # a header's lines are linked, so that one that ends in another one's lines shares them
    for start, line in reversed(lines):
        rest = known[line.end()]
        name = line[1].lower()
        known[start] = None if rest is None else (rest[0], (name, line[2].rstrip(), rest[1]) if name in FIELDS else rest[1])
        at = start
    made = known[at]
    if made is None:
        return None
    fields: dict[bytes, bytes] = {}
    link = made[1]
    while link is not None and len(fields) < len(FIELDS):
        fields.setdefault(link[0], link[1])
        link = link[2]
    size = fields.get(b"content-length", b"")
    if not size.isdigit() or len(size) > 18 or b"warc-type" not in fields:
        return None
    return fields, made[0]


def candidates(data: memoryview) -> Iterator[tuple[int, int, dict[bytes, bytes], int, int]]:
    """(offset, successor, fields, body start, body end) of every candidate whose record, with its end, lies in the file."""
    known: dict[int, tuple | None] = {}
    for match in re.finditer(re.escape(MAGIC), data):
        parsed = parse_header(data, match.end(), known)
        if parsed:
            fields, body = parsed
            end = body + int(fields[b"content-length"])
            if bytes(data[end : end + 4]) == HEADER_END:
                yield match.start(), end + 4, fields, body, end


CANDIDATE = "file string, offset bigint, successor bigint, beyond bigint, block bigint, size bigint, type string, record_id string, refers_to string, uri string, said_digest string, body_bytes bigint, body_digest string"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """CANDIDATE rows of all files. beyond is where the chain from a candidate leaves its block, at the end of the file too; null if it breaks off within."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in CANDIDATE.split(", "))])
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(content.as_buffer())
                rows = []
                beyond: dict[int, int | None] = {}
                here = list(candidates(data))
                for at, successor, *_ in reversed(here):
                    inside = successor // BLOCK_BYTES == at // BLOCK_BYTES and successor < len(data)
                    beyond[at] = beyond.get(successor) if inside else successor
                for at, successor, fields, body, end in here:
                    text = {k: fields[k].decode("utf-8", "replace") if k in fields else None for k in (b"warc-type", b"warc-record-id", b"warc-refers-to", b"warc-target-uri", b"warc-payload-digest")}
                    digest = base64.b32encode(hashlib.sha1(data[body:end]).digest()).decode()
                    rows.append((file, at, successor, beyond[at], at // BLOCK_BYTES, len(data), *text.values(), end - body, digest))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter("length > 0").select("path", "content").mapInArrow(found, CANDIDATE)


def reached_blocks(scanned: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (file, offset): where the chain from each file's start enters a block, once each, by pointer jumping."""
    jumps = scratch.write(scanned.filter("beyond < size").select("file", "offset", F.col("beyond").alias("to")), "jumps0")
    entered = scratch.write(scanned.filter("offset = 0").select("file", "offset"), "entered0")
    blocks = (scanned.agg(F.max("block")).first()[0] or 0) + 1
    rounds = blocks.bit_length()
    for k in range(rounds):
        # after round k the entries reached in fewer than 2**(k+1) jumps are known
        further = entered.join(jumps, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        entered = scratch.write(entered.union(further).distinct(), f"entered{k + 1}")
        if k + 1 < rounds:
            second = jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("further"))
            jumps = scratch.write(jumps.join(second, ["file", "to"]).select("file", "offset", F.col("further").alias("to")), f"jumps{k + 1}")
            scratch.drop(f"jumps{k}")
        scratch.drop(f"entered{k}")
    return entered


def chained(scanned: DataFrame, entered: DataFrame) -> DataFrame:
    """The candidates that the chains reach: each block is walked from where its file's chain enters it."""
    schema = scanned.schema

    def walk(key: tuple, rows: pa.Table) -> pa.Table:
        at = {o: i for i, o in enumerate(rows.column("offset").to_pylist())}
        follow = rows.column("successor").to_pylist()
        keep, place = [], next((e for e in rows.column("entry").to_pylist() if e is not None), None)
        while place in at:
            keep.append(at[place])
            place = follow[at[place]]
        return rows.select(schema.names).take(pa.array(keep, pa.int64()))

    entries = entered.select("file", F.col("offset").alias("entry"), F.expr(f"offset DIV {BLOCK_BYTES}").alias("block"))
    met = scanned.join(entries, ["file", "block"]).select(*schema.names, "entry")
    return met.groupBy("file", "block").applyInArrow(walk, schema)


def read_archives(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """One row per record of the WARC files under ``path``: CANDIDATE without the chain's columns.

    A file's records end where its chain breaks off, at a damaged record say; magic within a payload
    makes no record. Of a field that a header has twice the first counts. A file is held by one task,
    so it must be below 2 GB (write_archives keeps to MOST_FILE_BYTES); an empty file or folder has no
    records.
    """
    scanned = scratch.write(scan(spark, path), "candidates")
    return chained(scanned, reached_blocks(scanned, scratch)).drop("successor", "beyond", "block", "size")


def page_number(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")


def read_pages(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, as the bodies show.

    A revisit has the length and digest of the response it refers to, if that response's digest is
    the one that the revisit names; else its own digest field and no length.
    """
    records = scratch.write(read_archives(spark, path, scratch), "records")
    rows = records.select(page_number(F.col("record_id")).alias("page_id"), F.col("type").alias("record_type"), page_number(F.col("refers_to")).alias("refers_to"), F.regexp_replace("said_digest", "^sha1:", "").alias("said"), "body_bytes", "body_digest")
    # a page id may be repeated, with other payloads too: those are told by the digest
    responses = rows.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("body_digest").alias("said")).agg(F.max("body_bytes").alias("r_bytes"))
    met = rows.join(responses, ["refers_to", "said"], "left")
    own = F.col("record_type") == "response"
    return met.select(
        "page_id", F.when(own, F.col("body_bytes")).otherwise(F.col("r_bytes")).alias("payload_bytes"),
        F.when(own, F.col("body_digest")).otherwise(F.col("said")).alias("payload_digest"), "record_type", "refers_to",
    )
