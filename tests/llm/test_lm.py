import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from zonewise.llm import lm
from zonewise.llm.bytetext import text_slices
from zonewise.llm.queries import QUERIES
from zonewise.llm.store import Scratch, table

from .helpers import ODD_TEXTS, SF, TO_LOWER, documents, nonspace_words

COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]


def tokens(text):
    return [*nonspace_words((text or "").translate(TO_LOWER)), None]


def held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


def brute(docs):
    counts = Counter(w for d, t in docs if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return {(d, held(d), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for d, t in docs for w in [tokens(t)]}


def check(got, docs):
    assert {(*r[:5], round(r.base_score, 6)) for r in got} == brute(docs) and len(got) == len(docs)
    assert all(r.score <= 1e-9 and math.isfinite(r.score) for r in got)


def plain_scores(texts, words, parameters, counts):
    """The trained parameters' log10 probability of each text, by loops over tokens, units and words."""
    hot, rare, size = words.hot, lm.RARE, lm.SIZE
    rows = parameters.astype(np.float64)
    vector, rows = rows[: hot + rare + 1, :size], rows[hot + rare + 1 :]
    units = len(words.noise)
    out, inner, (left, near) = rows[:units], rows[units : units + hot], rows[units + hot :][:, :size]
    ranks = {int(w): i for i, w in enumerate(words.words.view(np.int64))}
    tails = range(words.single, hot, lm.TAIL)

    def soft(h, table):
        said = table[:, :size] @ h + table[:, size]
        return said - math.log(np.exp(said - said.max()).sum()) - said.max()

    made = []
    for text in texts:
        (part,) = text_slices(pa.array([text or ""]))
        hashes, _, endings = lm.tokens_of(part)
        total, before, whole = 0.0, [hot + rare, hot + rare], words.total + words.distinct + 1
        for word, ending in zip(hashes.view(np.int64).tolist(), endings.tolist(), strict=True):
            h = vector[before[0]] * left + vector[before[1]] * near
            place = ranks.get(word, hot + ending)
            if place < words.single:
                said = soft(h, out)[place]
            elif place < hot:
                k = next(k for k, a in enumerate(tails) if a <= place < a + lm.TAIL)
                said = soft(h, out)[words.single + k] + soft(h, inner[tails[k] : tails[k] + lm.TAIL])[place - tails[k]]
            else:
                said = soft(h, out)[words.single + len(tails) + ending] + math.log((counts.get(word, 0) + 1) / words.rest[ending])
            total += math.log(lm.MIX * math.exp(said) + (1 - lm.MIX) * (counts.get(word, 0) + 1) / whole)
            before = [before[1], place]
        made.append(total / math.log(10))
    return made


@pytest.mark.parametrize(("hot", "single", "tail"), [(lm.HOT, lm.SINGLE, lm.TAIL), (300, 20, 7)])
def test_scores_equal_a_plain_evaluation(spark, monkeypatch, hot, single, tail):
    for name, value in (("HOT", hot), ("SINGLE", single), ("TAIL", tail)):
        monkeypatch.setattr(lm, name, value)
    kept = {}

    def fit(*args, trained=lm.fit):
        kept["model"] = trained(*args)
        return kept["model"]

    monkeypatch.setattr(lm, "fit", fit)
    docs = table(spark, SF, "documents").select("doc_id", "text").limit(60).union(documents(spark, [t for t in ODD_TEXTS if not t or len(t) < 1000]).selectExpr("-doc_id - 1", "text"))
    docs = Scratch(spark, "t").write(docs, "docs")
    got = {r.doc_id: r.score for r in lm.score_documents(docs, Scratch(spark, "t")).collect()}
    words, parameters, counts = kept["model"]
    counts = {r.word: r.n for r in counts.collect()}
    rows = docs.collect()
    want = plain_scores([r.text for r in rows], words, parameters, counts)
    assert np.allclose([got[r.doc_id] for r in rows], want, rtol=1e-4, atol=1e-3)
    # a share of a rare unit for each of its words and one for unseen ones
    rare = [n for w, n in counts.items() if w not in set(words.words.view(np.int64).tolist())]
    assert math.isclose(words.rest.sum(), sum(rare) + len(rare) + lm.RARE)


@pytest.mark.parametrize(("hot", "single"), [(lm.HOT, lm.SINGLE), (50, 20)])
def test_query_equals_brute_force_and_beats_the_base(spark, monkeypatch, hot, single):
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "SINGLE", single)
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    made = QUERIES["op8_lm_scoring"](spark, SF)
    assert made.columns[: len(COLUMNS)] == COLUMNS
    got = made.collect()
    check(got, docs)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_held_out_texts_are_likelier_than_by_counts(spark):
    """The shipped constants, on a table on which the log-bilinear part alone falls behind the counts."""
    held_out = QUERIES["op8_lm_scoring"](spark, SF.replace("0.001", "0.01")).filter("held_out").selectExpr("sum(score) / sum(n_tokens) AS s", "sum(base_score) / sum(n_tokens) AS b").first()
    assert held_out.s > held_out.b + 0.001


def test_odd_texts_repeats_and_null_ids(spark):
    texts = documents(spark, ODD_TEXTS).select("doc_id", "text")
    docs = texts.union(texts.filter("doc_id IN (1, 4, 10)")).union(spark.createDataFrame([(None, "null id")], "doc_id long, text string"))
    got = lm.score_documents(docs, Scratch(spark, "t")).collect()
    check(got, [(r.doc_id, r.text) for r in docs.collect()])


def test_no_training_document_and_empty_table(spark):
    only = next(i for i in range(100) if held(i))
    docs = documents(spark, ["x"]).select("text").selectExpr(f"CAST({only} AS BIGINT) AS doc_id", "text")
    (row,) = lm.score_documents(docs, Scratch(spark, "t")).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 2, 0, 0, 0) and row.score < 0
    assert lm.score_documents(docs.limit(0), Scratch(spark, "t")).collect() == []


def small_model():
    tokens, kinds = np.arange(lm.RARE), np.arange(lm.RARE) // 2
    words = lm.Vocabulary(np.arange(1, 31), np.arange(31, 1, -1), tokens, kinds, 700, 60)
    model = lm.LogBilinear(words)
    model.set_parameters(model.parameters() + np.random.default_rng(1).normal(0, 0.3, model.parameters().shape))
    return words, model


def test_probabilities_sum_to_one(monkeypatch):
    monkeypatch.setattr(lm, "SINGLE", 5)
    monkeypatch.setattr(lm, "TAIL", 7)
    words, model = small_model()
    assert words.starts.tolist() == [5, 12, 19, 26, 30]
    said = [model.log_probabilities(np.array([3, 40, w]), np.array([0, 3]))[2] for w in range(30 + lm.RARE)]
    assert abs(np.exp(said).sum() - 1) < 1e-5


def test_contexts_stay_within_texts():
    _, model = small_model()
    start = 30 + lm.RARE
    left, near = model.contexts(np.array([1, 2, 3, 4, 0, 1]), np.array([0, 3, 3, 4, 6]))
    assert near.tolist() == [start, 1, 2, start, start, 0] and left.tolist() == [start, start, 1, start, start, start]


def test_tokens_of_end_each_text():
    (part,) = text_slices(pa.array(["A b", None, " ", "b"]))
    words, bounds, endings = lm.tokens_of(part)
    assert bounds.tolist() == [0, 3, 4, 5, 7] and words[1] == words[5] and (words[[2, 3, 4, 6]] == lm.END).all()
    assert endings[1] == endings[5] and (endings[[2, 3, 4, 6]] == 0).all()


def test_sums_of_rows_and_of_exponentials():
    rng = np.random.default_rng(3)
    for width in (1, 24):
        which, rows = rng.integers(0, 40, 500), rng.normal(size=(500, width)).astype(np.float32)
        expected = np.array([rows[which == k].sum(axis=0) for k in range(50)])
        assert np.allclose(lm._row_sums(which, rows, 50), expected, atol=1e-4)
    for size in (5.0, 500.0):
        scores = rng.normal(0, size, (30, 70)).astype(np.float32)
        expected = np.logaddexp.reduce(scores.astype(np.float64), axis=1)
        assert np.allclose(lm._log_sums(scores.copy(), float(np.abs(scores).max())), expected, atol=1e-3)
    a, b = rng.normal(size=(20, 24)), rng.normal(size=(9, 24))
    assert np.abs(a @ b.T).max() <= lm._longest(a) * lm._longest(b)


@pytest.mark.parametrize("places", [1, 8, 1 << 20])
def test_a_context_met_before_is_not_normalised_again(monkeypatch, places):
    monkeypatch.setattr(lm, "SINGLE", 5)
    monkeypatch.setattr(lm, "TAIL", 7)
    monkeypatch.setattr(lm, "REMEMBERED", places, raising=False)
    rows, sums = [], lm._log_sums
    monkeypatch.setattr(lm, "_log_sums", lambda scores, most: (rows.append(len(scores)) if scores.shape[1] > 100 else None, sums(scores, most))[1])
    _, model = small_model()
    target, bounds = np.random.default_rng(2).integers(0, 5, 300), np.array([0, 100, 100, 300])
    once = model.log_probabilities(target, bounds)
    made = sum(rows)
    assert made == len({*zip(*(x.tolist() for x in model.contexts(target, bounds)), strict=True)})
    assert np.allclose(model.log_probabilities(target, bounds), once, atol=1e-5)
    assert sum(rows) == made if places > 1000 else sum(rows) > made
    # other parameters, other normalisers
    _, fresh = small_model()
    for changed in (model, fresh):
        changed.set_parameters(changed.parameters() * 0.5)
    assert np.allclose(model.log_probabilities(target, bounds), fresh.log_probabilities(target, bounds), atol=1e-5)
    steps = [np.random.default_rng(4) for _ in range(2)]
    for changed, rng in zip((model, fresh), steps, strict=True):
        changed.step(*changed.contexts(target, bounds), target, rng, np.cumsum(changed.words.noise))
    fresh.set_parameters(fresh.parameters())
    assert np.allclose(model.log_probabilities(target, bounds), fresh.log_probabilities(target, bounds), atol=1e-5)


def test_words_are_drawn_for_groups_and_stepped_by_their_slopes(monkeypatch):
    monkeypatch.setattr(lm, "SINGLE", 5)
    monkeypatch.setattr(lm, "TAIL", 7)
    words, model = small_model()
    rng = np.random.default_rng(6)
    target, left, near = rng.integers(0, 40, 400), rng.integers(0, 40, 400), rng.integers(0, 40, 400)
    before = {name: getattr(model, name).astype(np.float64) for name in model.NAMES}
    drawn, of_kind = [], model._add
    monkeypatch.setattr(model, "_add", lambda rows, **slopes: (drawn.append(rows) if "inner" in slopes else None, of_kind(rows, **slopes))[1])
    model.step(left, near, target, rng, np.cumsum(words.noise))
    inside = (target >= 5) & (target < 30)
    units = words.units(target[inside])
    sizes = [int((units == u).sum()) for u in np.unique(units)]
    groups = [min(lm.GROUP, n - a) for n in sizes for a in range(0, n, lm.GROUP)]
    (rows,) = drawn
    assert len(rows) == sum(sizes) + lm.WITHIN * len(groups) < sum(sizes) * (lm.WITHIN + 1)
    # each token against its own word and those drawn for its group, one by one
    slopes, own = np.zeros((30, lm.SIZE)), np.zeros(30)
    order = np.flatnonzero(inside)[np.argsort(units, kind="stable")]
    noise = rows[sum(sizes) :].reshape(-1, lm.WITHIN)
    for i, k in zip(order, np.repeat(np.arange(len(groups)), groups), strict=True):
        h = before["vector"][left[i]] * before["left"][0] + before["vector"][near[i]] * before["near"][0]
        first = 5 + (target[i] - 5) // 7 * 7
        size = min(7, 30 - first)
        for word, is_true in [(target[i], 1), *((w, 0) for w in noise[k])]:
            assert first <= word < first + size
            said = h @ before["inner"][word] + before["own"][word, 0] - math.log(lm.WITHIN / size)
            slope = (is_true - 1 / (1 + math.exp(-said))) / len(target)
            slopes[word] += slope * h
            own[word] += slope
    changed = model.inner - before["inner"]
    assert np.allclose(changed, lm.RATE * slopes / np.sqrt(1e-3 + slopes**2), atol=1e-4)
    assert np.allclose((model.own - before["own"])[:, 0], lm.RATE * own / np.sqrt(1e-3 + own**2), atol=1e-4)
