import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from zonewise.llm import colloc
from zonewise.llm.queries import QUERIES
from zonewise.llm.store import Scratch, table

from .helpers import ODD_TEXTS, SF, TO_LOWER, documents


def brute(docs, least=30, top=2000, longest=4):
    """Collocations of (lang, text), by counting every phrase in plain loops."""
    counts, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(TO_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f = counts.setdefault(lang, Counter())
            for k in range(1, longest + 1):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    made = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, b in found.items():
            for k in range(2, len(p)):
                gone |= {p[i : i + k] for i in range(len(p) - k + 1) if 100 * b >= 80 * found[p[i : i + k]]}
        ranked = []
        for p in found.keys() - gone:
            score, k = min((2000000 * found[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -found[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            made.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(made)


def best(docs, scratch, **how):
    return sorted(map(tuple, colloc.Collocations(docs, scratch, **how).best().collect()))


def test_query_equals_brute_force(spark):
    rows = [(r.lang, r.text) for r in table(spark, SF, "documents").collect()]
    got = sorted(map(tuple, QUERIES["op12_collocations"](spark, SF).collect()))
    assert got == brute(rows) and got


@pytest.mark.parametrize("broadcast", [colloc.BROADCAST_PHRASES, 0])
def test_small_shards_and_shuffled_joins(spark, monkeypatch, broadcast):
    """Phrases that lie in many shards, of texts dealt to many tasks, with the ranking cut short."""
    monkeypatch.setattr(colloc, "BROADCAST_PHRASES", broadcast)
    monkeypatch.setattr(colloc, "HOT_ROWS", 5)
    monkeypatch.setattr(colloc, "SHARD_TOKENS", 500)
    monkeypatch.setattr(colloc, "HELD_TOKENS", 900)
    monkeypatch.setattr(colloc, "BUCKET_PAIRS", 100)
    docs = table(spark, SF, "documents").repartition(5)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert best(docs, Scratch(spark, "small"), min_count=12, top=40) == brute(rows, 12, 40)


def test_odd_texts_and_clashing_names(spark):
    texts = [*ODD_TEXTS, "a b c d, A B C D; a b c d", "x\x01 y x y! x\x01 y", "a b c a b c", "ba " * 700, "naïve Ünï naïve Ünï\tnaïve ünï", "q\x0bq\x0cq q"]
    rows = [(i, t, lang, i) for i, t in enumerate(texts) for lang in (None, "und", "", "EN")]
    rows += rows[:7]
    docs = spark.createDataFrame(rows, "n long, text string, lang string, phrase long")
    for least, longest in ((1, 4), (2, 2), (3, 5)):
        assert best(docs, Scratch(spark, "odd"), min_count=least, max_words=longest) == brute([(r[2], r[1]) for r in rows], least, longest=longest)


def test_empty_and_wrong_input(spark):
    empty = documents(spark, ["x"]).limit(0)
    assert best(empty, Scratch(spark, "empty")) == []
    assert best(documents(spark, [None, "", "?!"]), Scratch(spark, "none")) == []
    with pytest.raises(ValueError):
        colloc.Collocations(empty, Scratch(spark, "wrong"), max_words=1)


def test_scores_beyond_64_bits(spark):
    """Counts so large that their product with two million needs more than 64 bits."""
    made = colloc.Collocations(documents(spark, ["a b"]), Scratch(spark, "large"), min_count=1)
    big = 3 << 60
    made.phrases = spark.createDataFrame([("en", 1, "a", big, 1), ("en", 2, "b", big - 5, 1), ("en", 3, "a b", big - 7, 2)], "lang string, id long, phrase string, a long, size int")
    (row,) = made.scored().collect()
    assert (row.l, row.r, row.score) == (big, big - 5, 2000000 * (big - 7) // (2 * big - 5))


def test_lists_and_pairs_go_as_soon_as_they_are_used(spark, monkeypatch):
    events = []
    drop, counted_pairs = Scratch.drop, colloc.Collocations._frequent_pairs

    def dropped(self, *names):
        events.extend(names)
        drop(self, *names)

    def pairs(self, dealt, size):
        events.append(f"count {size}")
        return counted_pairs(self, dealt, size)

    monkeypatch.setattr(Scratch, "drop", dropped)
    monkeypatch.setattr(colloc.Collocations, "_frequent_pairs", pairs)
    docs = spark.createDataFrame([(k, "en", "a b c. a b d") for k in range(5)], "doc_id bigint, lang string, text string")
    made = colloc.Collocations(docs, Scratch(spark, "dropped"), min_count=2, max_words=3)
    assert events == ["lists-1", "count 2", "lists-2/kind=pairs", "lists-2", "count 3", "lists-3/kind=pairs", "lists-3"]
    assert {(r.phrase, r.a) for r in made.phrases.filter("size > 1").collect()} == {("a b", 10), ("b c", 5), ("b d", 5), ("a b c", 5), ("a b d", 5)}


def test_rows_of_a_shard_are_packed_in_runs():
    rows = pa.RecordBatch.from_pydict({"of": [7, 7, 7, 3, 7], "j": [0, 2, 9, 1, 11], "id": [5 << 33, 1, 3, 1, 8]})
    made = [r for batch in colloc._packed_rows(iter([rows, rows.slice(0, 0)])) for r in batch.to_pylist()]
    assert [(r["of"], colloc._unpack(r["j"]).tolist(), colloc._unpack(r["ids"]).tolist()) for r in made] == [(7, [0, 2, 9], [5 << 33, 1, 3]), (3, [1], [1]), (7, [11], [8])]


def test_the_shuffle_of_words_goes_before_the_first_pass(spark, monkeypatch):
    done, write, release = [], Scratch.write, Scratch.release
    monkeypatch.setattr(Scratch, "write", lambda self, df, name, *a, **k: (done.append(name), write(self, df, name, *a, **k))[1])
    monkeypatch.setattr(Scratch, "release", lambda self: (done.append("release"), release(self))[1])
    colloc.Collocations(table(spark, SF, "documents"), Scratch(spark, "t"))
    assert done.index("phrases-1") < done.index("release") < done.index("lists-2")


def test_passes_write_few_bytes(spark, monkeypatch):
    """A pair takes few bytes on its way, and lists of words aren't written again with those of phrases."""
    made, write = {}, Scratch.write

    def written(self, df, name, *a, **k):
        out = write(self, df, name, *a, **k)
        if name in ("lists-2", "lists-3"):
            size = sum((F.coalesce(F.length(c), F.lit(0)) for c, kind in out.dtypes if kind == "binary"), F.lit(0))
            made[name] = {r.kind: r for r in out.groupBy("kind").agg(F.sum(size).alias("bytes"), F.collect_list("heads").alias("heads")).collect()}
        return out

    monkeypatch.setattr(Scratch, "write", written)
    colloc.Collocations(table(spark, SF, "documents"), Scratch(spark, "bytes"), min_count=5)
    pairs = made["lists-2"]["pairs"]
    n = sum(len(colloc._unpack(heads)) for heads in pairs.heads)
    # 2.2 bytes with differences of signed numbers in no order, and places besides
    assert n > 10_000 and pairs.bytes < 1.8 * n
    assert 0 < made["lists-3"]["lists"].bytes < made["lists-2"]["lists"].bytes


def test_packed_integers_come_back():
    extremes = np.array([0, -1, 1, 2**63 - 1, -(2**63), 5, -(2**63), 2**63 - 1])
    for values in (extremes, np.arange(1000), np.zeros(0, dtype=np.int64), np.array([7])):
        for steps in (True, False):
            back = colloc._unpack(colloc._pack(values, steps))
            assert back.dtype == np.int64 and back.tolist() == values.tolist()


def test_frequent_words_have_low_numbers(spark):
    made = colloc.Collocations(table(spark, SF, "documents"), Scratch(spark, "numbers"), min_count=5)
    rows = made.phrases.filter("size = 1").orderBy("lang", "id").collect()
    assert len({r.id for r in rows}) == len(rows)
    for one, next_one in zip(rows, rows[1:], strict=False):
        assert one.lang != next_one.lang or one.a >= next_one.a


def test_a_shuffled_join_of_words_goes_before_the_first_pass(spark, monkeypatch):
    done, write, release = [], Scratch.write, Scratch.release
    monkeypatch.setattr(colloc, "BROADCAST_PHRASES", 0)
    monkeypatch.setattr(Scratch, "write", lambda self, df, name, *a, **k: (done.append(name), write(self, df, name, *a, **k))[1])
    monkeypatch.setattr(Scratch, "release", lambda self: (done.append("release"), release(self))[1])
    colloc.Collocations(table(spark, SF, "documents"), Scratch(spark, "joined"), max_words=2)
    assert done.index("words-of-shards") < done.index("release") < done.index("lists-2")
