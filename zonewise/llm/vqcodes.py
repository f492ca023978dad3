"""Compression of vectors to short codes: product quantisation over integers, exact on any layout of rows.

Vectors become columnar blocks, dimension by row. In each round every task walks over its blocks: the
squared distances to a part's entries are accumulated dimension by dimension, and np.add.at adds the
rows to int64 tensors of sums and counts, which treeAggregate merges through a tree of tasks. Only
these tensors (parts x entries x width) reach the driver, however many vectors there are. As all of it
is integer arithmetic, the result does not depend on how rows fall into blocks or tasks.

Defined results: rows whose vector is null or has a null, NaN or infinite component are dropped. The
length of the first kept vector (by id, then components) is the length of all; a vector of another
length keeps its row with null code and error. Of equal ids the vectors are taken in the order of
their components, and each counts. Fewer kept vectors than entries make fewer entries. An empty table
gives no rows. Components beyond 2**27 are computed as Python integers, just as exactly; an error
beyond a bigint is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, bound_batches, col, fresh

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Rows of a block: distances to all entries of a part are held for so many rows at once.
BLOCK_ROWS = 4096
#: Up to this size of components, squared distances and their sums over a vector fit 64 bits.
SMALL = 1 << 27
#: Sums by label go to every task up to so many labels; beyond, they are joined, in SALTS pieces a label.
BROADCAST_LABELS, SALTS = 100_000, 32


@dataclass(frozen=True)
class Codebooks:
    """entries[part, entry, position], as integers (int64, or Python's where they are large)."""

    entries: np.ndarray

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite floats: int64, or Python integers where one is larger than SMALL."""
    wide = np.floor(values.astype(np.float64) * scale) if not values.size or np.abs(values).max() < 1e300 else None
    if wide is not None and (not wide.size or np.abs(wide).max() <= SMALL):
        return wide.astype(np.int64)
    return np.array([scale * n // d for n, d in (float(x).as_integer_ratio() for x in values.ravel())], dtype=object).reshape(values.shape)


def part_distances(block: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (entries x rows) of one part's columns (width x rows), dimension by dimension."""
    exact = np.result_type(block, entries)
    total = np.zeros((len(entries), block.shape[1]), dtype=exact)
    for column, places in zip(block, entries.T, strict=True):
        apart = column[None, :].astype(exact) - places[:, None]
        total += apart * apart
    return total


def assign(block: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """(codes, errors) of a block (length x rows): the nearest entry of every part, the lower index of equals, and the summed distances."""
    parts, _, width = books.entries.shape
    codes = np.zeros((parts, block.shape[1]), dtype=np.uint8)
    errors = np.zeros(block.shape[1], dtype=np.result_type(block, books.entries))
    for p in range(parts):
        d = part_distances(block[p * width : (p + 1) * width], books.entries[p])
        codes[p] = np.argmin(d, axis=0)
        errors += d[codes[p], np.arange(block.shape[1])]
    return codes, errors


def add_block(totals: tuple[np.ndarray, np.ndarray], block: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Adds a block's rows to the sums (parts x entries x width) and counts (parts x entries) of the entries they are nearest to."""
    sums, counts = totals
    parts, _, width = books.entries.shape
    codes, _ = assign(block, books)
    if block.dtype == object and sums.dtype != object:
        sums = sums.astype(object)
    for p in range(parts):
        np.add.at(sums[p], codes[p], block[p * width : (p + 1) * width].T)
        np.add.at(counts[p], codes[p], 1)
    return sums, counts


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def moved(books: Codebooks, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
    """Entries replaced by floor(sum / count); one that no row is nearest to stays."""
    used = np.maximum(counts, 1)[:, :, None]
    return Codebooks(np.where((counts > 0)[:, :, None], sums // used, books.entries))


def _columns(vectors: pa.Array, length: int, scale: int) -> np.ndarray:
    """Vectors of one length as a block of integers, dimension by row."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(integers(flat, scale).reshape(len(vectors), length).T)


def _pack(block: np.ndarray) -> tuple[str, bytes]:
    """A block's bytes in the smallest of some types that holds it; text where only Python's integers do."""
    if block.dtype == object:
        return "text", ",".join(map(str, block.ravel().tolist())).encode()
    top = int(np.abs(block).max()) if block.size else 0
    kind = "<i2" if top < 1 << 15 else "<i4"
    return kind, block.astype(kind).tobytes()


def _unpack(kind: str, data: bytes, length: int, rows: int) -> np.ndarray:
    if kind == "text":
        return np.array([int(x) for x in data.split(b",")], dtype=object).reshape(length, rows)
    return np.frombuffer(data, dtype=kind).astype(np.int64).reshape(length, rows)


def kept_vectors(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there and has only finite components."""
    v = col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(v.isNotNull() & F.coalesce(finite, F.lit(False)))


def _first(kept: DataFrame, id_col: str, vector_col: str, entries: int) -> list[list[float]]:
    """Vectors of the least ids, at most ``entries``: the length is the first one's."""
    first = kept.select(col(id_col).alias("i"), col(vector_col).alias("v")).orderBy(F.asc_nulls_last("i"), "v").limit(1).collect()
    if not first:
        return []
    fits = kept.filter(F.size(col(vector_col)) == len(first[0].v)).select(col(id_col).alias("i"), col(vector_col).alias("v"))
    return [r.v for r in fits.orderBy(F.asc_nulls_last("i"), "v").limit(entries).collect()]


def column_blocks(kept: DataFrame, vector_col: str, length: int, scratch: Scratch, scale: int = SCALE) -> DataFrame:
    """Blocks (n, kind, data) of all vectors of ``length``, written once; every round reads them."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.column(0).slice(i, BLOCK_ROWS)
                kind, data = _pack(_columns(some, length, scale))
                yield pa.RecordBatch.from_arrays([pa.array([len(some)], pa.int64()), pa.array([kind]), pa.array([data], pa.binary())], ["n", "kind", "data"])

    fits = kept.filter(F.size(col(vector_col)) == length).select(col(vector_col).cast("array<double>").alias("v"))
    return scratch.write(fits.mapInArrow(blocks, "n bigint, kind string, data binary"), "blocks")


def train(vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all kept vectors, started from those of the least ids; None without a vector.

    ``entries`` is 256 at most, and the length must be a multiple of ``parts``.
    """
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("a part has 1 to 256 entries")
    bound_batches(vectors.sparkSession)
    kept = kept_vectors(vectors, vector_col)
    first = _first(kept, id_col, vector_col, entries)
    if not first:
        return None
    length = len(first[0])
    if length % parts:
        raise ValueError(f"vectors of {length} components are not cut into {parts} equal parts")
    width = length // parts
    start = integers(np.array(first, dtype=np.float64), scale)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, width).transpose(1, 0, 2)))
    rows = column_blocks(kept, vector_col, length, scratch, scale).rdd.map(lambda r: (r.n, r.kind, bytes(r.data)))
    for _ in range(rounds):
        zero = (np.zeros(books.entries.shape, dtype=np.int64), np.zeros(books.entries.shape[:2], dtype=np.int64))

        def add(totals, row, books=books):
            return add_block(totals, _unpack(row[1], row[2], length, row[0]), books)

        books = moved(books, *rows.treeAggregate(zero, add, merge))
    scratch.drop("blocks")
    return books


CODED = {"code": "string", "error": "bigint"}


def encode(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Kept vectors' rows with code (two hex digits of the entry's index for each part) and error.

    Columns named code or error are replaced, whatever the letters' case.
    """
    bound_batches(vectors.sparkSession)
    kept = kept_vectors(vectors, vector_col)
    length = books.length

    @F.arrow_udf("struct<code: string, error: bigint>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            said, errors = [None] * len(batch), [None] * len(batch)
            fits = np.flatnonzero(pc.list_value_length(batch).fill_null(-1).to_numpy(zero_copy_only=False) == length)
            for i in range(0, len(fits), BLOCK_ROWS):
                some = fits[i : i + BLOCK_ROWS]
                codes, apart = assign(_columns(batch.take(pa.array(some)), length, scale), books)
                text = np.ascontiguousarray(codes.T).tobytes().hex()
                digits = 2 * codes.shape[0]
                for k, (row, e) in enumerate(zip(some.tolist(), apart.tolist(), strict=True)):
                    said[row], errors[row] = text[k * digits : (k + 1) * digits], e if e < 1 << 63 else None
            yield pa.StructArray.from_arrays([pa.array(said, pa.string()), pa.array(errors, pa.int64())], ["code", "error"])

    made = fresh(kept, "coded")
    others = [col(c) for c in kept.columns if c.lower() not in CODED]
    with_codes = kept.withColumn(made, coded(col(vector_col).cast("array<double>")))
    return with_codes.select(*others, col(made)["code"].alias("code"), col(made)["error"].alias("error"))


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code", vector_col: str = "decoded", scale: int = SCALE) -> DataFrame:
    """``codes`` with the vector (array<double>) that each code stands for; a null code gives null."""

    @F.arrow_udf("array<double>")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parts = np.arange(books.entries.shape[0])
        for batch in batches:
            yield pa.array([None if c is None else (books.entries[parts, list(bytes.fromhex(c))].ravel() / scale).tolist() for c in batch.to_pylist()], pa.list_(pa.float64()))

    return codes.withColumn(vector_col, decoded(col(code_col)))


def compress(vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per kept vector its id, code, error, label_error (the errors of all vectors of its label; nulls are one label) and codebooks_sha256.

    Errors by label are partial sums; a label of very many vectors meets its sum in SALTS pieces.
    """
    books = train(vectors, scratch, id_col, vector_col)
    if books is None:
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    one = vectors.select(col(id_col).alias("id"), col(vector_col).alias("vector"), col(label_col).alias("label"))
    coded = scratch.write(encode(one, books, "vector").drop("vector"), "coded")
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).try_cast("bigint").alias("label_error"))
    sums = scratch.write(sums.withColumnRenamed("label", "of"), "sums")
    if sums.count() <= BROADCAST_LABELS:
        met = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")), "left")
    else:
        dealt = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
        spread = sums.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = dealt.join(spread, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("part")), "left")
    return met.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
