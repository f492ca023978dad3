import random
import subprocess
import sys

import numpy as np
import pytest

from zonewise.llm import jaccard
from zonewise.llm.components import components
from zonewise.llm.queries import QUERIES
from zonewise.llm.store import Scratch, table

from .helpers import ODD_TEXTS, SF, alnum_words, documents


def shingles(text):
    w = alnum_words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """docs: (id, text) with distinct ids."""
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in docs}
    links = dict.fromkeys(root, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    pairs = {(i, j) for rows in by_shingle.values() if len(rows) < 500 for i in rows for j in rows if i < j}
    pairs |= {(i, j) for rows in by_shingle.values() if len(rows) >= 500 for i in rows for j in rows if i < j}
    for i, j in pairs:
        (a, s), (b, t) = sets[i], sets[j]
        if 9 * len(s & t) >= 4 * (len(s) + len(t)):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (find(d), links[d]) for d in root}


def got(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


def near_copies(seed, many, words=120, edits=6):
    rnd = random.Random(seed)
    base = [f"w{seed}x{rnd.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(many):
        copy = list(base)
        for _ in range(rnd.randrange(edits)):
            copy[rnd.randrange(words)] = f"e{rnd.randrange(10_000)}"
        out.append(" ".join(copy))
    return out


def recall_of(depths):
    return 1 - np.prod([1 - 0.8**d for d in depths])


def test_prefixes_are_shortened_to_the_recall():
    usual = jaccard.usual_depths()
    assert recall_of(usual) >= jaccard.RECALL and max(usual) - min(usual) <= 1
    deeper = list(usual)
    deeper[usual.index(min(usual))] += 1
    assert recall_of(deeper) < jaccard.RECALL
    # a class in crowded nodes of some trees keeps longer prefixes there, at the same recall
    sizes = np.ones((2, jaccard.TREES, 5))
    sizes[0, :6] = [1000, 900, 800, 700, 600]
    sizes[1] = [5000, 50, 40, 35, 33]
    few, all_ = jaccard.shortened(sizes)
    assert recall_of(few) >= jaccard.RECALL and recall_of(all_) >= jaccard.RECALL
    assert few[:6].min() > max(usual) and few[6:].max() < few[:6].min()
    assert all_.min() == 5


def test_crowded_nodes_are_left_deep(spark):
    """Texts that share a long passage meet in shallow nodes; the forest must not verify them against each other."""
    rnd = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"w{rnd.randrange(10**6)}" for _ in range(60)]) for _ in range(300)] + near_copies(4, 40)
    scratch = Scratch(spark, "t")
    made = jaccard.NearDuplicates(documents(spark, texts), scratch)
    assert got(made.links()) == brute(list(enumerate(texts)))


def test_recall_against_brute_force(spark):
    sf = SF.replace("0.001", "0.01")
    want = brute([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])
    found = got(QUERIES["op3_ngram_jaccard"](spark, sf))
    assert sum(n for _, n in found.values()) >= 0.99 * sum(n for _, n in want.values()) > 0
    assert all(found[d][1] <= want[d][1] for d in want)


def test_query_equals_brute_force(spark):
    want = brute([(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()])
    assert got(QUERIES["op3_ngram_jaccard"](spark, SF)) == want
    assert any(n for _, n in want.values())


@pytest.mark.parametrize(("small", "block"), [(32, 512), (4, 16), (1, 7)])
def test_hot_groups_lose_no_link(spark, monkeypatch, small, block):
    monkeypatch.setattr(jaccard, "SMALL_NODE", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = [*near_copies(1, 90), *near_copies(2, 30, edits=12), *["the very same text again"] * 50, *near_copies(3, 3)]
    random.Random(5).shuffle(texts)
    docs = documents(spark, texts).repartition(3)
    assert got(jaccard.near_duplicates(docs, Scratch(spark, "t"))) == brute(list(enumerate(texts)))


def test_odd_texts(spark):
    texts = [*ODD_TEXTS, "ONE!", "One", "two words", "words two"]
    assert got(jaccard.near_duplicates(documents(spark, texts), Scratch(spark, "t"))) == brute(list(enumerate(texts)))


def test_null_and_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "A b c d e f"), (5, "A b c d e f"), (None, "alone"), (None, None), (7, None)], "doc_id long, text string")
    rows = sorted((tuple(r) for r in jaccard.near_duplicates(docs, Scratch(spark, "t")).collect()), key=str)
    assert rows == sorted([(None, 5, 2), (5, 5, 2), (5, 5, 2), (None, None, 0), (None, None, 0), (7, 7, 0)], key=str)
    assert jaccard.near_duplicates(docs.limit(0), Scratch(spark, "t")).collect() == []


def test_one_of_each_keeps_whole_rows(spark):
    texts = [*near_copies(1, 20), *["copy of a text"] * 4, None, None, "", "alone here"]
    docs = documents(spark, texts).selectExpr("*", "doc_id * 2 AS same", "'q' AS id", "text AS wins")
    docs = docs.union(docs.filter("doc_id = 20"))
    kept = jaccard.NearDuplicates(docs, Scratch(spark, "t")).one_of_each()
    assert kept.columns == docs.columns
    rows = kept.collect()
    want = {d for d, (c, _) in brute(list(enumerate(texts))).items() if c == d}
    assert sorted(r.doc_id for r in rows) == sorted(want) and all(r.same == 2 * r.doc_id and r.wins == r.text for r in rows)


def test_components_of_long_paths_and_stars(spark):
    rnd = random.Random(2)
    names = rnd.sample(range(-(10**12), 10**12), 400)
    edges = [(names[i], names[i + 1]) for i in range(150)] + [(names[200], names[i]) for i in range(201, 300)] + [(names[350], names[350])]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), "c").collect()}
    assert {roots[n] for n in names[:151]} == {min(names[:151])} and {roots[n] for n in names[200:300]} == {min(names[200:300])}
    assert len(roots) == 251


HELD = """
import re
import pyarrow as pa
from zonewise.llm import jaccard
from zonewise.llm.bytetext import text_slices

def held():
    return int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

before = held()
for k in range(3):
    batch = pa.array([" ".join(f"w{i * 31 % (997 + k)}" for i in range(j, j + 400)) for j in range(0, 2400)])
    for part in text_slices(batch):
        jaccard.class_hashes(part), jaccard.signatures(*jaccard.shingles_of(part))
    del batch, part
print(held() - before)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_a_worker_holds_little_between_batches():
    made = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True)
    assert float(made.stdout) < 50
