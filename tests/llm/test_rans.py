import json
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from zonewise.llm import rans
from zonewise.llm.pretoken import LIMIT, PATTERN, Encoder, byte_characters
from zonewise.llm.pretoken import encoder as shared_encoder
from zonewise.llm.queries import PLAIN_TOKENIZER, QUERIES
from zonewise.llm.store import Scratch, table

from .helpers import ODD_TEXTS, SF, documents

FILE = public_tokenizers.path(PLAIN_TOKENIZER)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(FILE)


def library_ids(texts):
    lib = Tokenizer.from_file(FILE)
    return [x.ids for x in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def expected(docs):
    made = sorted(zip([d for d, _ in docs], library_ids([t for _, t in docs]), strict=True))
    out, at = [], 0
    for d, ids in made:
        raw = np.array([*ids, 0], dtype="<u4")
        out.append((d, at, len(raw), zlib.crc32(raw.tobytes())))
        at += len(raw)
    return out


def test_pattern_is_the_tokenizer_s():
    assert PATTERN == public_tokenizers.PATTERN


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab'srevlmtd  \n\t.1é\x1c\x85　日🙂", max_size=30), max_size=5))
def test_pieces_equal_the_library(texts):
    assert [x.tolist() for x in shared_encoder(FILE).encode(pa.array(texts, pa.string()))] == library_ids(texts)


def test_cache_may_start_anew(encoder, monkeypatch):
    monkeypatch.setattr("zonewise.llm.pretoken.CACHE_PIECES", 3)
    texts = ["one two three four", "five six <|endoftext|>", "one six"]
    for _ in range(3):
        assert [x.tolist() for x in encoder.encode(pa.array(texts))] == library_ids(texts)


def test_new_pieces_go_to_the_model_alone():
    """All characters below the limit, so all bytes of them, as pieces of their own and joined."""
    texts = [" ".join(map(chr, range(LIMIT))), "".join(map(chr, range(LIMIT))), "\x00\x7f\xad \xff" * 3, "", None]
    assert byte_characters().tolist() == [ord(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0]) for b in range(128)] + byte_characters()[128:].tolist()
    assert {chr(c) for c in byte_characters()} == {*ByteLevel.alphabet()} and len({*byte_characters().tolist()}) == 256
    mine = Encoder(FILE)
    mine.library = None
    assert [x.tolist() for x in mine.encode(pa.array(texts))] == library_ids(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=700), st.integers(1, 300))
def test_blocks_round_trip(ids, rare):
    ids = np.array([i % rare for i in ids], dtype=np.uint32)
    symbols, counts = np.unique(ids, return_counts=True)
    made = rans.Table(symbols.astype(np.int64), counts)
    assert made.freq.sum() == (1 << rans.SCALE if len(ids) else 0)
    state, words = rans.encode_ids(ids, made)
    assert rans.decode_ids(state, words, len(ids), made).tolist() == ids.tolist()


def test_table_of_very_uneven_counts():
    counts = np.array([1] * 60_000 + [10**12])
    made = rans.Table(np.arange(len(counts)), counts)
    assert made.freq.sum() == 1 << rans.SCALE and made.freq.min() == 1


def test_damage_is_found():
    ids = np.arange(1000, dtype=np.uint32) % 7
    made = rans.Table(np.arange(7), np.bincount(ids))
    block = bytearray(rans.pack_block([5], [ids], 3, 0, made))
    assert rans.unpack_block(bytes(block), made)[3].tolist() == ids.tolist()
    block[-10] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.unpack_block(bytes(block), made)
    with pytest.raises(ValueError, match="cut off"):
        rans.unpack_block(bytes(block[:20]), made)


def test_no_block_holds_the_separator():
    ids = np.arange(1000, dtype=np.uint32) % 7
    made = rans.Table(np.arange(7), np.bincount(ids))
    bad = int.from_bytes(rans.MAGIC.encode(), "little")
    block = rans.pack_block([bad, None], [ids, ids[:0]], 3, 9, made)
    assert block[0] and rans.MAGIC.encode() not in block
    part, first, docs, got = rans.unpack_block(block, made)
    assert (part, first, docs["id"][0], docs["size"].tolist()) == (3, 9, bad, [1000, 0]) and got.tolist() == ids.tolist()


def read_back(spark, docs):
    return sorted(tuple(r) for r in rans.through_files(docs, FILE, Scratch(spark, "t")).collect())


def parts_of(monkeypatch, ids, block=1 << 18):
    monkeypatch.setattr(rans, "LEAST_PART_IDS", ids)
    monkeypatch.setattr(rans, "PART_IDS", ids)
    monkeypatch.setattr(rans, "BLOCK_IDS", block)
    monkeypatch.setattr(rans, "PARTS_TOGETHER", 3)


@pytest.mark.parametrize(("bucket", "block"), [(1 << 22, 1 << 18), (2000, 500)])
def test_query_equals_library(spark, monkeypatch, bucket, block):
    parts_of(monkeypatch, bucket, block)
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert sorted(tuple(r) for r in QUERIES["op10_token_files"](spark, SF).collect()) == expected(docs)


def test_files_give_the_ids_back(spark):
    docs, scratch = documents(spark, ODD_TEXTS), Scratch(spark, "t")
    encoded = scratch.write(rans.tokenize(docs, FILE, "doc_id", "text"), "ids")
    made = rans.count_ids(encoded)
    rans.write_files(encoded, made, scratch.path("files"))
    got = {r.id: np.frombuffer(r["ids"], "<u4").tolist() for r in rans.read_documents(spark, scratch.path("files"), made, scratch).collect()}
    assert got == {i: [*ids, 0] for i, ids in enumerate(library_ids(ODD_TEXTS))}


def test_files_in_order_of_names_ascend_and_are_cut_anywhere(spark, monkeypatch):
    parts_of(monkeypatch, 3000, 300)
    docs, scratch = table(spark, SF, "documents").repartition(5, "text"), Scratch(spark, "t")
    encoded = scratch.write(rans.tokenize(docs, FILE, "doc_id", "text"), "ids")
    made = rans.count_ids(encoded)
    rans.write_files(encoded, made, scratch.path("files"))
    files = sorted(Path(scratch.path("files")).glob("part-*"))
    assert len(files) > 5
    seen = []
    for file in files:
        blocks = file.read_bytes().split(rans.MAGIC.encode())
        assert blocks.pop() == b""
        for block in blocks:
            seen += rans.unpack_block(block, made)[2]["id"].tolist()
    assert seen == sorted(r.doc_id for r in docs.collect())
    whole = sorted(map(tuple, rans.read_documents(spark, scratch.path("files"), made, scratch).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert rans.read_blocks(spark, scratch.path("files")).rdd.getNumPartitions() > 2 * len(files)
        assert sorted(map(tuple, rans.read_documents(spark, scratch.path("files"), made, scratch).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_texts_that_the_tokenizer_splits_otherwise_go_to_the_library(tmp_path):
    said = json.loads(Path(FILE).read_text())
    said["pre_tokenizer"]["add_prefix_space"] = True
    other = tmp_path / "other.json"
    other.write_text(json.dumps(said))
    texts = ["hello there", "", "two words"]
    lib = Tokenizer.from_file(str(other))
    assert [x.tolist() for x in Encoder(str(other)).encode(pa.array(texts))] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_odd_texts_nulls_repeats_and_empty_table(spark):
    docs = documents(spark, ODD_TEXTS)
    assert read_back(spark, docs) == expected([(i, t) for i, t in enumerate(ODD_TEXTS)])
    assert read_back(spark, docs.limit(0)) == []
    twice = spark.createDataFrame([(None, "null id"), (3, "same"), (3, "same"), (1, "x")], "doc_id long, text string")
    got = rans.through_files(twice, FILE, Scratch(spark, "t")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 3, 3] and got[2].ids_crc32 == got[3].ids_crc32


def test_equal_rows_of_one_id_are_split(spark, monkeypatch):
    parts_of(monkeypatch, 50)
    docs = spark.createDataFrame([(7, "the same text")] * 100, "doc_id long, text string")
    scratch = Scratch(spark, "t")
    got = rans.through_files(docs, FILE, scratch).orderBy("start").collect()
    assert len({r.n_tokens for r in got}) == 1 and [r.start for r in got] == [i * got[0].n_tokens for i in range(100)]
    assert len(list(Path(scratch.path("files")).glob("part-*"))) > 2


def test_a_hot_document_id_is_split(spark, monkeypatch):
    parts_of(monkeypatch, 50)
    docs = spark.createDataFrame([(7, f"text number {i} of many") for i in range(200)] + [(6, "before"), (8, "after")], "doc_id long, text string")
    got = rans.through_files(docs, FILE, Scratch(spark, "t")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [6] + [7] * 200 + [8]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
