"""Byte-level BPE with the tiktoken library and a local rank file: encoding and raw-byte decoding."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import let_go
from .store import bound_batches, col

#: Texts longer than this are cut at safe boundaries before encoding.
LONG_TEXT = 1 << 16
#: A cut goes before a space that follows an ASCII letter: no match of a GPT-2 style pattern holds a
#: space after its first character unless it is all white space, and none looks back.
SAFE_CUT = re.compile(r"(?<=[A-Za-z])(?= )")


@lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file: on each line a base64 token and its rank."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """Parts of about ``size`` characters whose encodings joined are the text's encoding.

    Where no safe boundary follows, the part goes on until there is one, to the end if need be.
    """
    start = 0
    while len(text) - start > size:
        cut = SAFE_CUT.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= LONG_TEXT:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in safe_parts(text):
        ids += enc.encode_ordinary(part)
    return ids


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of each whole text (array<int>) as ``ids_col``, which replaces a column of that name.

    Null and empty texts get an empty array. Special tokens' strings are ordinary text. Every row is
    handled by itself, so repeated rows and empty tables need no care.
    """

    @F.arrow_udf("array<int>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(rank_file, pattern)
        for batch in texts:
            yield pa.array([encode_text(enc, t or "") for t in batch.to_pylist()], type=pa.list_(pa.int32()))

    return docs.withColumn(ids_col, encode(col(text_col)))


def decode_documents(docs: DataFrame, rank_file: str, pattern: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with the raw bytes (binary) that each row's token ids stand for; null ids give empty bytes."""

    @F.arrow_udf("binary")
    def decode(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(rank_file, pattern)
        for batch in ids:
            yield pa.array([enc.decode_bytes(x or []) for x in batch.to_pylist()], type=pa.binary())

    return docs.withColumn(bytes_col, decode(col(ids_col)))


ROUND_TRIP = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of ids, and digests of the ids and of the bytes decoded from them.

    Encodes as ``encode_documents`` and decodes as ``decode_documents``, but in one pass, so the ids
    of the whole corpus need not leave the Python worker. ids_sha256 is over the decimal ids joined
    by commas (of an empty text over nothing).
    """

    bound_batches(docs.sparkSession)

    @F.arrow_udf(f"struct<{ROUND_TRIP.replace(' ', ': ').replace(',:', ',')}>")
    def digest(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(rank_file, pattern)
        for batch in texts:
            rows = []
            for text in batch:
                ids = encode_text(enc, text.as_py() or "")
                said = str(ids)[1:-1].replace(", ", ",").encode()
                rows.append((len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()))
            n, said_as, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(said_as, pa.string()), pa.array(decoded, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])
            let_go()

    made = docs.select(col(id_col).alias(id_col), digest(col(text_col)).alias("made"))
    return made.select(F.col(f"`{id_col}`"), "made.n_tokens", "made.ids_sha256", "made.decoded_sha256")
