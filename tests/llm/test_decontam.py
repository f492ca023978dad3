import hashlib
import random
from collections import defaultdict

import pytest

from zonewise.llm import decontam
from zonewise.llm.queries import QUERIES
from zonewise.llm.store import table

from .helpers import ODD_TEXTS, SF, alnum_words, documents


def brute(docs, items, window=13):
    wanted = defaultdict(set)
    for item, text in items:
        w = alnum_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wanted[tuple(w[i : i + window])].add(str(item) if item is not None else "")
    sizes = {len(x) for x in wanted}
    out = {}
    for d, text in docs:
        w, hit, found = alnum_words(text), set(), set()
        for i in range(len(w)):
            for n in sizes:
                if (key := tuple(w[i : i + n])) in wanted and len(key) == n:
                    hit.update(range(i, i + n))
                    found |= wanted[key]
        out[d] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def brute_matches(docs, items, window=13):
    """By walking every pair of a word of a document and a word of an item."""
    out = {}
    for d, text in docs:
        w, best = alnum_words(text), {}
        for item, other in {(str(i) if i is not None else "", t) for i, t in items}:
            v = alnum_words(other)
            for o in range(len(v)):
                for p in range(len(w)):
                    if w[p] != v[o] or (o and p and w[p - 1] == v[o - 1]):
                        continue
                    n = 0
                    while p + n < len(w) and o + n < len(v) and w[p + n] == v[o + n]:
                        n += 1
                    if n >= min(window, len(v)) and (len(v) >= window or o == 0):
                        key = (item, other, o)
                        best[key] = max(best.get(key, (0, 0)), (n, -p))
        out[d] = sorted((item, o, -p, n) for (item, _, o), (n, p) in best.items())
    return out


def test_longest_matches_equal_walking_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PAIRS", 50)
    rnd = random.Random(3)
    item = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(item)), (1, " ".join(item[:20])), (2, " ".join(item[10:])), (3, "a b " * 12), (4, "w1 w2 w3"), (None, " ".join(item)), (1, " ".join(item))]
    texts = [None, "", " ".join(item), "x " + " ".join(item[5:30]) + " y " + " ".join(item[8:36]), "a b " * 30, "b " + "a b " * 7, "W1 w2 W3 w1 w2 w3"]
    for _ in range(20):
        a, b = sorted(rnd.sample(range(41), 2))
        texts.append(" ".join(["z"] * rnd.randrange(3) + item[a:b] + ["a", "b"] * rnd.randrange(12)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_contamination(documents(spark, texts), bench).collect()
    got = {r.doc_id: [tuple(m) for m in r.matches] for r in found}
    assert got == brute_matches(list(enumerate(texts)), items)
    for r in found:
        covered = {p + k for _, _, p, n in map(tuple, r.matches) for k in range(n)}
        assert covered <= {s + k for s, n in zip(r.spans[::2], r.spans[1::2], strict=True) for k in range(n)}


def check(spark, docs, bench):
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontam.find_contamination(docs, bench).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    return got


def test_equals_brute_force_on_tables(spark):
    got = check(spark, table(spark, SF, "documents"), table(spark, SF, "benchmark"))
    assert any(x[3] for x in got.values())


def test_short_items_repeats_and_odd_texts(spark):
    long_item = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, "b C d"), (2, "b c d"), (10, "é"), (3, None), (4, ""), (None, "lines"), (5, long_item), (5, "teKST one"), (6, "word word word")], "item_id long, text string")
    texts = [*ODD_TEXTS, f"before {long_item} after " * 3, " ".join(f"w{i}" for i in range(5, 20)), " ".join(f"w{i}" for i in range(5, 17))]
    got = check(spark, documents(spark, texts), bench)
    assert got[len(ODD_TEXTS)][1] == 90 and got[len(ODD_TEXTS) + 2][1] == 0


def test_window_does_not_cross_texts(spark):
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    check(spark, documents(spark, ["x a b", "c d y", "a b c d", ""]).coalesce(1), bench)


def test_several_indexes_join_their_hits(spark, monkeypatch):
    monkeypatch.setattr(decontam, "INDEX_BYTES", 100)
    check(spark, table(spark, SF, "documents").limit(60), table(spark, SF, "benchmark"))
    docs, bench = documents(spark, ["a b c d", "clean text", None, "x y z", "x y z"]), spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d", "q " * 60, "x y z", "r " * 60])], "item_id long, text string")
    check(spark, docs, bench)
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()) == [1, 2]


def test_drop_keeps_columns_and_clean_rows(spark):
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    docs = documents(spark, ["a b c d", "clean text", None, "clean text"]).selectExpr("*", "1 AS items", "2 AS h")
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]


@pytest.mark.parametrize("side", ["docs", "bench"])
def test_empty_tables(spark, side):
    docs, bench = documents(spark, ["a b"]), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs, bench = (docs.limit(0), bench) if side == "docs" else (docs, bench.limit(0))
    assert [(r.n_words, r.n_hit) for r in decontam.find_contamination(docs, bench).collect()] == ([] if side == "docs" else [(2, 0)])


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    want = brute(docs, items)
    made = QUERIES["op5_decontamination"](spark, SF).collect()
    assert len(made) == len(docs)
    for r in made:
        words, hit, found, bad = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (words, hit, len(found), bad)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        # the longest match lies inside the words that are hit
        assert (r.longest_match > 0) == (r.n_matches > 0) == (hit > 0) and r.longest_match <= hit
