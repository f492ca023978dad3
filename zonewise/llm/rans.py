"""Token ids in binary files: a static range asymmetric numeral system over independent interleaved blocks.

One table of frequencies, counted over all ids, is shared by all blocks. A block holds the ids of
whole documents, dealt to many interleaved coder states so that numpy steps them together; its
header is a checkpoint: where its ids start in its part of the corpus, which documents it has, the
states to resume from, and checksums of its ids and of its payload. So any block can be decoded alone.

The documents are dealt to parts by ranges of their ids, so files in the order of their names hold
documents in ascending order. A file is blocks with MAGIC after each; no block has MAGIC in it, so
Spark's text source, with MAGIC as the line separator, cuts a file at any block and many tasks read
it at once. Ids before a part are sums of the headers of the parts before it, made on two levels.

Block: mask u8, and exclusive-or'ed with the mask, little-endian:
    part u32 | lanes u32 | documents u32 | ids u64 | words u32 | crc32 of the ids u32 |
    first id in the part u64 | crc32 of all that follows u32 |
    of each document: has an id u8, id i64, ids u64 | states u64 * lanes | words u32 * words
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .pretoken import encoder
from .store import Scratch, col

MAGIC = "ZWRANS2\n"
HEAD = struct.Struct("<IIIQIIQI")
HEAD_BYTES = 1 + HEAD.size
#: The sum of the frequencies is 2**SCALE; states lie in [LOW, LOW * 2**32).
SCALE, LOW = 20, 1 << 31
#: Ids in a block, or one document.
BLOCK_IDS = 1 << 18
#: Ids in a part, about: at least, as long as there are so many parts for each task that can run at once, and at most.
LEAST_PART_IDS, PART_IDS, PARTS_PER_TASK = 1 << 22, 1 << 26, 64
#: Parts whose first ids are summed by one task, and parts up to which these are broadcast (16 bytes each).
PARTS_TOGETHER, BROADCAST_PARTS = 1024, 500_000
MAX_LANES = 2048
END_ID = 0


class Table:
    """Frequencies that sum to 2**SCALE, at least 1 for every symbol that was counted."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        total = 1 << SCALE
        freq = np.maximum(1, counts.astype(np.float64) * ((total - len(symbols)) / max(1, counts.sum()))).astype(np.int64)
        order = np.argsort(-freq, kind="stable")
        short = total - int(freq.sum())
        # what rounding left goes to, or comes from, the most frequent symbols
        while short and len(freq):
            if short > 0:
                freq[order[0]] += short
                break
            take = np.minimum(freq[order] - 1, max(1, -short // len(order)))
            take[np.cumsum(take) > -short] = 0
            if not take.any():
                take[0] = 1
            freq[order] -= take
            short += int(take.sum())
        size = int(symbols.max(initial=0)) + 1
        self.freq, self.start = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint64)
        self.freq[symbols] = freq
        self.start[symbols] = np.cumsum(freq) - freq
        self.symbol = np.repeat(symbols.astype(np.uint32), freq)


def encode_ids(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """States and words of one block's ids."""
    lanes = lanes_of(len(ids))
    state = np.full(lanes, LOW, dtype=np.uint64)
    words = []
    for t in range((len(ids) - 1) // lanes if len(ids) else -1, -1, -1):
        row = ids[t * lanes : (t + 1) * lanes]
        f, c = table.freq[row], table.start[row]
        x = state[: len(row)]
        full = x >= (f << np.uint64(63 - SCALE))
        words.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: len(row)] = (q << np.uint64(SCALE)) + (x - q * f) + c
    return state, np.concatenate(words[::-1]) if words else np.zeros(0, dtype=np.uint32)


def decode_ids(state: np.ndarray, words: np.ndarray, n: int, table: Table) -> np.ndarray:
    lanes = len(state)
    out = np.empty(n, dtype=np.uint32)
    state = state.copy()
    at = 0
    for t in range(-(-n // lanes) if n else 0):
        x = state[: min(lanes, n - t * lanes)]
        slot = x & np.uint64((1 << SCALE) - 1)
        row = table.symbol[slot]
        out[t * lanes : t * lanes + len(row)] = row
        x = table.freq[row] * (x >> np.uint64(SCALE)) + slot - table.start[row]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
        at += len(low)
        state[: len(x)] = x
    if at != len(words) or (state != LOW).any():
        raise ValueError("a block's words do not end where its ids do")
    return out


def lanes_of(n: int) -> int:
    """Interleaved states for n ids: a power of two, at least some 64 ids each."""
    lanes = 1
    while lanes < MAX_LANES and lanes * 128 <= n:
        lanes *= 2
    return lanes


DOC = np.dtype([("known", "u1"), ("id", "<i8"), ("size", "<u8")])


def masked(block: bytes, mask: int) -> bytes:
    return (np.frombuffer(block, dtype=np.uint8) ^ np.uint8(mask)).tobytes() if mask else block


def pack_block(doc_ids: list[int | None], parts: list[np.ndarray], part: int, first: int, table: Table) -> bytes:
    ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
    state, words = encode_ids(ids, table)
    docs = np.zeros(len(doc_ids), dtype=DOC)
    docs["known"] = [d is not None for d in doc_ids]
    docs["id"] = [d or 0 for d in doc_ids]
    docs["size"] = [len(p) for p in parts]
    body = docs.tobytes() + state.astype("<u8").tobytes() + words.astype("<u4").tobytes()
    block = HEAD.pack(part, len(state), len(docs), len(ids), len(words), zlib.crc32(ids.astype("<u4").tobytes()), first, zlib.crc32(body)) + body
    # each mask has its own places where the masked block could hold the separator, so some mask has none
    mask = next(m for m in range(256) if MAGIC.encode() not in masked(block, m))
    return bytes([mask]) + masked(block, mask)


def part_and_size(block: bytes) -> tuple[int, int]:
    """A block's part and its number of ids."""
    head = HEAD.unpack_from(masked(block[1 : 1 + HEAD.size], block[0]))
    return head[0], head[3]


def unpack_block(block: bytes, table: Table) -> tuple[int, int, np.ndarray, np.ndarray]:
    """A block's part, the number of its first id there, its documents (DOC), and its ids; checksums are verified."""
    data = masked(block[1:], block[0])
    if len(data) < HEAD.size:
        raise ValueError("a block is cut off")
    part, lanes, n_docs, n, n_words, crc_ids, first, crc_body = HEAD.unpack_from(data)
    at = HEAD.size
    if len(data) != at + n_docs * DOC.itemsize + 8 * lanes + 4 * n_words or zlib.crc32(data[at:]) != crc_body:
        raise ValueError(f"the block from id {first} of part {part} is damaged")
    docs = np.frombuffer(data, DOC, n_docs, at)
    state = np.frombuffer(data, "<u8", lanes, at := at + n_docs * DOC.itemsize)
    words = np.frombuffer(data, "<u4", n_words, at + 8 * lanes)
    ids = decode_ids(state, words, n, table)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
        raise ValueError(f"ids of the block from id {first} of part {part} are damaged")
    return part, first, docs, ids


def id_type(tokenizer_file: str) -> str:
    """The narrowest integer that intermediate tables can hold the ids in."""
    return "<u2" if Tokenizer.from_file(tokenizer_file).get_vocab_size() <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, tokenizer_file: str, id_col: str, text_col: str, kind: str = "<u4") -> DataFrame:
    """Rows (id, n, tie, row, ids): the ids of each text and END_ID, as little-endian unsigned integers; tie is a hash of them, row tells equal rows apart."""

    @F.arrow_udf("struct<n: bigint, ids: binary>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(tokenizer_file)
        end = np.array([END_ID], dtype=kind).tobytes()
        for batch in texts:
            made = enc.encode(batch)
            yield pa.StructArray.from_arrays([pa.array([len(x) + 1 for x in made], pa.int64()), pa.array([x.astype(kind).tobytes() + end for x in made], pa.binary())], ["n", "ids"])

    made = docs.select(col(id_col).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"), encode(col(text_col)).alias("e"))
    return made.select("id", "e.n", F.xxhash64("e.ids").alias("tie"), "row", "e.ids")


def count_ids(encoded: DataFrame, kind: str = "<u4") -> Table:
    """The shared table. What reaches the driver is bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for blob in batch.column(0):
                more = np.bincount(np.frombuffer(blob.as_buffer(), kind))
                if len(more) > len(total):
                    total, more = more, total
                total[: len(more)] += more
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["symbol", "n"])

    counts = encoded.select("ids").mapInArrow(count, "symbol bigint, n bigint").groupBy("symbol").agg(F.sum("n").alias("n")).orderBy("symbol").toPandas()
    return Table(counts["symbol"].to_numpy(dtype=np.int64), counts["n"].to_numpy(dtype=np.int64))


def write_files(encoded: DataFrame, table: Table, path: str, kind: str = "<u4") -> None:
    """Writes blocks of tokenize's rows, which must be written somewhere, in ascending (id, tie), null ids first.

    Parts are ranges of (id, tie, row), so one id with very many rows, equal ones too, is split.
    """
    context = encoded.sparkSession.sparkContext
    total = encoded.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // PART_IDS), min(-(-total // LEAST_PART_IDS), PARTS_PER_TASK * context.defaultParallelism))
    shared = context.broadcast(table)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = shared.value, TaskContext.get().partitionId()
        first, at, doc_ids, held_ids, held = 0, 0, [], [], 0
        for batch in batches:
            blobs = batch.column("ids")
            for i, doc_id in enumerate(batch.column("id").to_pylist()):
                if held >= BLOCK_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([pack_block(doc_ids, held_ids, part, first, table)], pa.binary())], ["block"])
                    first, doc_ids, held_ids, held = at, [], [], 0
                ids = np.frombuffer(blobs[i].as_buffer(), kind).astype(np.uint32)
                doc_ids.append(doc_id)
                held_ids.append(ids)
                held += len(ids)
                at += len(ids)
        if doc_ids:
            yield pa.RecordBatch.from_arrays([pa.array([pack_block(doc_ids, held_ids, part, first, table)], pa.binary())], ["block"])

    order = (F.col("id").asc_nulls_first(), F.col("tie").asc(), F.col("row").asc())
    ordered = encoded.select("id", "tie", "row", "ids").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    made = ordered.select("id", "ids").mapInArrow(blocks, "block binary")
    # the text sink writes a string's bytes as they are, and the separator after each
    made.select(F.col("block").cast("string").alias("value")).write.option("lineSep", MAGIC).mode("overwrite").text(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("block"))


def first_ids(spark: SparkSession, path: str) -> DataFrame:
    """Rows (part, before): the ids of all parts before each, from the headers of the blocks."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [part_and_size(head) for head in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([part for part, _ in made], pa.int64()), pa.array([n for _, n in made], pa.int64())], ["part", "n"])

    parts = read_blocks(spark, path).select(F.substring("block", 1, HEAD_BYTES)).mapInArrow(heads, "part bigint, n bigint").groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.withColumn("many", F.expr(f"part DIV {PARTS_TOGETHER}"))
    many = parts.groupBy("many").agg(F.sum("n").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("many")) - F.col("n")).select("many", "before")
    within = parts.withColumn("within", F.sum("n").over(Window.partitionBy("many").orderBy("part")) - F.col("n"))
    return within.join(many, "many").select("part", (F.col("before") + F.col("within")).alias("before"))


def read_documents(spark: SparkSession, path: str, table: Table, scratch: Scratch, with_ids: bool = True) -> DataFrame:
    """Rows (id, start, n, crc[, ids]) of the files, each block decoded and verified by itself; ids as unsigned 32-bit integers."""
    shared = spark.sparkContext.broadcast(table)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                part, first, docs, ids = unpack_block(block.as_buffer().to_pybytes(), shared.value)
                ends = np.cumsum(docs["size"].astype(np.int64))
                starts = ends - docs["size"].astype(np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                blobs = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(np.full(len(docs), part)), pa.array(docs["id"].astype(np.int64), pa.int64(), mask=docs["known"] == 0), pa.array(starts + first), pa.array(ends - starts), pa.array([zlib.crc32(b) for b in blobs], pa.int64())]
                if with_ids:
                    columns.append(pa.array([bytes(b) for b in blobs], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["part", "id", "first", "n", "crc", "ids"][: len(columns)])

    before = scratch.write(first_ids(spark, path), "parts")
    rows = read_blocks(spark, path).mapInArrow(decode, "part bigint, id bigint, first bigint, n bigint, crc bigint" + ", ids binary" * with_ids)
    met = rows.join(F.broadcast(before) if before.count() <= BROADCAST_PARTS else before, "part")
    return met.select("id", (F.col("before") + F.col("first")).alias("start"), "n", "crc", *["ids"] * with_ids)


def through_files(docs: DataFrame, tokenizer_file: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, writes, and reads back: per document its id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it in ascending id order, null ids first; rows of
    the same id are ordered by a hash of their ids. A null text is empty and has the end id alone.
    """
    spark = docs.sparkSession
    kind = id_type(tokenizer_file)
    encoded = scratch.write(tokenize(docs, tokenizer_file, id_col, text_col, kind), "ids", "zstd")
    table = count_ids(encoded, kind)
    if not len(table.symbol):
        return spark.createDataFrame([], f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    write_files(encoded, table, scratch.path("files"), kind)
    scratch.drop("ids")
    return read_documents(spark, scratch.path("files"), table, scratch, with_ids=False).select(F.col("id").alias(id_col), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
