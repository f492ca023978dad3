import base64
import hashlib
from collections import defaultdict
from pathlib import Path

import pytest

from zonewise.llm import warc
from zonewise.llm.queries import QUERIES
from zonewise.llm.store import Scratch, table

from .helpers import SF

PAGES = "page_id long, url string, html string"


def expected(pages, min_bytes=0):
    largest = defaultdict(lambda: None)
    for p, html in pages:
        raw = (html or "").encode()
        if len(raw) >= min_bytes and p is not None and (largest[raw] is None or p > largest[raw]):
            largest[raw] = p
    out = []
    for p, html in pages:
        raw = (html or "").encode()
        revisit = largest[raw] is not None and p != largest[raw]
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", largest[raw] if revisit else None))
    return sorted(out, key=str)


def through(spark, pages, **options):
    scratch = Scratch(spark, "t")
    warc.write_archives(pages, scratch.path("a"), scratch, **options)
    return sorted((tuple(r) for r in warc.read_pages(spark, scratch.path("a"), scratch).collect()), key=str)


def test_query_equals_brute_force(spark):
    got = sorted((tuple(r) for r in QUERIES["op1_warc"](spark, SF).collect()), key=str)
    assert got == expected([(r.page_id, r.html) for r in table(spark, SF, "pages").collect()])


def fake(body="x"):
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"


@pytest.mark.parametrize("block", [1 << 20, 300, 64])
def test_magic_in_payloads_nulls_repeats(spark, monkeypatch, block):
    monkeypatch.setattr(warc, "BLOCK_BYTES", block)
    pages = [(1, "http://a/\r\nb c", fake()), (2, None, None), (3, "u", ""), (4, "u", "é" * 1000), (5, "u", "é" * 1000), (6, "u", "é" * 1000), (7, "x" * 50_000, fake() * 5 + "WARC/1.1\r\n"), (8, "u", fake("WARC/1.1\r\n" * 3)[:-3]), (8, "u", "twice"), (8, "u", "twice"), (None, "u", "no id"), (None, "u", "é" * 1000), (-3, "u", "\x00\r\n\r\n")]
    pages += [(100 + i, "u", fake("y" * i) * (i % 7)) for i in range(60)]
    df = spark.createDataFrame(pages, PAGES).coalesce(2)
    assert through(spark, df) == expected([(p, h) for p, _, h in pages])


def test_least_size_of_revisits(spark):
    pages = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcd"), (4, "u", "abcd")]
    assert through(spark, spark.createDataFrame(pages, PAGES), min_bytes=4) == expected([(p, h) for p, _, h in pages], 4)


def test_a_broken_chain_ends_the_file(spark, tmp_path):
    good = fake().encode()
    (tmp_path / "a.warc").write_bytes(good * 3 + b"junk" + good * 2)
    (tmp_path / "b.warc").write_bytes(good[:-1])
    (tmp_path / "c.warc").write_bytes(b"")
    made = warc.read_archives(spark, str(tmp_path), Scratch(spark, "t")).collect()
    assert [r.offset for r in sorted(made, key=lambda r: r.offset)] == [0, len(good), 2 * len(good)]


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "u", "x", "q")], PAGES + ", payload string").withColumnRenamed("payload", "digest")
    assert through(spark, df) == expected([(1, "x")])
    assert through(spark, df.limit(0)) == []


def test_long_urls_are_kept(spark):
    pages = [(1, "http://a/" + "x" * 100_000 + "/WARC/1.1", "p"), (2, "u", fake())]
    scratch = Scratch(spark, "t")
    warc.write_archives(spark.createDataFrame(pages, PAGES), scratch.path("a"), scratch)
    found = {r.record_id: r.uri for r in warc.read_archives(spark, scratch.path("a"), scratch).collect()}
    assert found == {"<urn:page:1>": pages[0][1], "<urn:page:2>": "u"}


def test_lines_before_many_magics_are_read_once(spark):
    payload = "a: WARC/1.1\r\n" * 20_000 + "Content-Length: 1\r\nWARC-Type: response\r\n\r\nx\r\n\r\n"
    known = {}
    data = memoryview(payload.encode())
    assert len(list(warc.candidates(data))) == 20_000
    assert warc.parse_header(data, 0, known)[0][b"warc-type"] == b"response" and len(known) == 20_003
    pages = [(1, "u", payload), (2, "u", "b")]
    assert through(spark, spark.createDataFrame(pages, PAGES)) == expected([(p, h) for p, _, h in pages])


def test_files_are_bounded_where_sizes_differ(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "MOST_FILE_BYTES", 60_000)
    pages = [(i, "u", "y" * 20 + str(i)) for i in range(300)] + [(1000 + i, "u", "z" * 20_000 + str(i)) for i in range(20)]
    scratch = Scratch(spark, "t")
    df = spark.createDataFrame(pages, PAGES).coalesce(1)
    warc.write_archives(df, scratch.path("a"), scratch)
    sizes = [f.stat().st_size for f in Path(scratch.path("a")).glob("part-*")]
    assert max(sizes) <= 60_000 and min(sizes) > 1000 and len(sizes) > 8
    got = sorted((tuple(r) for r in warc.read_pages(spark, scratch.path("a"), scratch).collect()), key=str)
    assert got == expected([(p, h) for p, _, h in pages])
