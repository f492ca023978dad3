"""Toxicity by Levenshtein automata over a lexicon trie, and scores of context windows.

Learning: from a bounded sample of labelled texts, terms that toxic texts have far more often than
others make the lexicon; a group of near copies counts as one text. Every term gets two weights,
one for the term as it is spelled and one for misspellings of it, both from the labels. Counts are
aggregates over (word, label, group of near copies), and features are made where the texts are.

Matching: the lexicon's trie is intersected with the Levenshtein automaton of the allowed edits; the
product is turned into a deterministic automaton as words ask for it, so a word costs one step a
letter. Each distinct word of a slice is run once.

Scoring: every hit collects the weights of the hits in a window around it, nearer ones more; a hit
in quotation marks adds to another feature than an open one, and a logistic model over these
features, fitted to the labels, tells how much either says.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import ALNUM, BYTE_HASH_FOLDED, LOWER, Slice, mix, owner, text_slices
from .sampling import share_filter
from .store import Scratch, col, fold_of, fresh

#: Bounds of the training sample: labelled documents of each class.
MAX_TOXIC, MAX_OTHER = 4_000, 8_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Terms: the least number of (groups of near copies of) toxic texts with the term; how many times likelier; letters; how many at most.
MIN_TEXTS, MIN_TIMES, MIN_LETTERS, MAX_TERMS = 3, 30, 3, 4_096
#: Standard errors by which a term's share of toxic texts must exceed its share of others.
SURE = 2.0
#: A longer word is no term.
MAX_LETTERS = 64
#: Letters that a term must have for one edit, and for two.
ONE_EDIT, TWO_EDITS = 5, 9
#: Words to either side of a hit that belong to its window.
CONTEXT = 12
#: The share of an exact term's weight that a misspelling never seen in training gets.
UNSEEN_EDIT = 0.6
OPENERS, CLOSERS = "“«„‹", "”»“›"
#: Words whose automaton result a worker remembers.
CACHE_WORDS = 250_000
#: States of the determinised automaton that a worker keeps before it starts anew.
MAX_STATES = 100_000


def allowed_edits(term: str) -> int:
    return 2 if len(term) >= TWO_EDITS else 1 if len(term) >= ONE_EDIT else 0


class LexiconAutomaton:
    """The trie of the terms intersected with Levenshtein automata, determinised lazily.

    A state is a set of (trie node, edits so far); ``match`` gives the term that a word is nearest to
    and the number of edits, or (-1, 0).
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term = [-1]
        for i, term in enumerate(terms):
            node = 0
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                node = self.children[node][letter]
            self.term[node] = i
        self.edits = [allowed_edits(t) for t in terms]
        # the edits that any term below a node allows: beyond it the node is a dead end
        self.most = [max((self.edits[self.term[n]],) if self.term[n] >= 0 else (0,)) for n in range(len(self.children))]
        for node in range(len(self.children) - 1, -1, -1):
            for child in self.children[node].values():
                self.most[node] = max(self.most[node], self.most[child])
        self.sizes = range(min(map(len, terms), default=1) - 2, max(map(len, terms), default=0) + 3)
        self._forget()

    def _forget(self) -> None:
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int]] = []
        self.numbers: dict[frozenset, int] = {}
        self.members: list[dict[int, int]] = []
        self.start = self._number(self._closed({0: 0}))

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """With the nodes reached by leaving letters of a term out."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            edits = nodes[node] + 1
            for child in self.children[node].values():
                if edits <= self.most[child] and edits < nodes.get(child, 9):
                    nodes[child] = edits
                    todo.append(child)
        return nodes

    def _number(self, nodes: dict[int, int]) -> int:
        key = frozenset(nodes.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.members)
            self.members.append(nodes)
            self.steps.append({})
            ends = [(e, self.term[n]) for n, e in nodes.items() if self.term[n] >= 0 and e <= self.edits[self.term[n]]]
            best = min(ends, default=None)
            self.accepts.append((best[1], best[0]) if best else (-1, 0))
        return self.numbers[key]

    def _step(self, state: int, letter: str) -> int:
        after: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.most[node] and edits < after.get(node, 9):
                after[node] = edits

        for node, edits in self.members[state].items():
            for other, child in self.children[node].items():
                reach(child, edits + (other != letter))
            reach(node, edits + 1)
        self.steps[state][letter] = number = self._number(self._closed(after))
        return number

    def match(self, word: str) -> tuple[int, int]:
        if len(word) not in self.sizes:
            return -1, 0
        if len(self.members) > MAX_STATES:
            self._forget()
        state, steps = self.start, self.steps
        for letter in word:
            following = steps[state].get(letter)
            state = self._step(state, letter) if following is None else following
            if not self.members[state]:
                return -1, 0
        return self.accepts[state]


def quoted(buf: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which spans of the texts (buf, offs) stand between quotation marks within their line, however long that is."""
    breaks = np.sort(np.concatenate([offs, np.flatnonzero(buf == 0x0A)]))
    first, last = breaks[np.searchsorted(breaks, starts, side="right") - 1], breaks[np.searchsorted(breaks, ends)]

    def places(mark: str) -> np.ndarray:
        code = mark.encode()
        at = np.flatnonzero(buf[: max(0, len(buf) - len(code) + 1)] == code[0])
        for k in range(1, len(code)):
            at = at[buf[at + k] == code[k]]
        return at

    def latest(at: np.ndarray) -> np.ndarray:
        # -1 where a span's line has no such mark before it
        found = np.concatenate([[-1], at])[np.searchsorted(at, starts)]
        return np.where(found >= first, found, -1)

    def follows(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(at, last) > np.searchsorted(at, ends)

    at = places('"')
    inside = ((np.searchsorted(at, starts) - np.searchsorted(at, first)) % 2 == 1) & follows(at)
    for a, b in zip(OPENERS, CLOSERS, strict=True):
        closers = places(b)
        inside |= (latest(places(a)) > latest(closers)) & follows(closers)
    return inside


N_FEATURES = 7
NAMES = tuple(f"f{k}" for k in range(N_FEATURES))


class Model:
    """Terms with their weights, and the logistic model over the features of texts."""

    def __init__(self, terms: list[str], exact: list[float], edited: list[float]):
        self.terms, self.exact, self.edited = terms, exact, edited
        self.coef, self.bias = np.zeros(N_FEATURES), -9.0

    def ready(self) -> Model:
        """Sets up what a worker needs and the pickle leaves out."""
        self.automaton, self.cache = LexiconAutomaton(self.terms), {}
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "cache")}

    def hits(self, part: Slice, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Positions of the slice's words that match, and the (term, edits) of each."""
        kinds, first, which = np.unique(words, return_index=True, return_inverse=True)
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        text = LOWER[part.buf].tobytes()
        # no term of that many bytes, edits included, is left out
        longest = 4 * self.automaton.sizes.stop
        found = np.zeros(len(kinds), dtype=bool)
        match = {}
        for i, (kind, at) in enumerate(zip(kinds.tolist(), first.tolist(), strict=True)):
            got = cache.get(kind)
            if got is None:
                got = cache[kind] = self.automaton.match(text[starts[at] : ends[at]].decode("utf-8", "replace")) if ends[at] - starts[at] <= longest else (-1, 0)
            if got[0] >= 0:
                found[i] = True
                match[i] = got
        at = np.flatnonzero(found[which])
        return at, [match[i] for i in which[at].tolist()]

    def features(self, part: Slice) -> np.ndarray:
        starts, ends, bounds = part.runs(ALNUM)
        words = part.hash_spans(part.prefix_hash(BYTE_HASH_FOLDED), starts, ends)
        out = np.zeros((part.n, N_FEATURES))
        at, matches = self.hits(part, words, starts, ends)
        calm_at = quoted(part.buf, part.offs, starts[at], ends[at]) if len(at) else np.zeros(0, dtype=bool)
        doc = np.searchsorted(bounds, at, side="right") - 1
        edges = np.flatnonzero(np.diff(doc, prepend=-1, append=part.n))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            d = doc[a]
            where = at[a:b]
            weight = np.array([self.edited[t] if e else self.exact[t] for t, e in matches[a:b]])
            exact = np.array([e == 0 for _, e in matches[a:b]])
            calm = calm_at[a:b]
            window = np.zeros(len(where))
            for k in range(len(where)):
                low, high = np.searchsorted(where, [where[k] - CONTEXT, where[k] + CONTEXT + 1])
                near = slice(low, high)
                window[k] = (weight[near] * ~calm[near] / (1 + np.abs(where[near] - where[k]))).sum()
            n = max(1, bounds[d + 1] - bounds[d])
            open_ = weight * ~calm
            out[d] = (
                (window * ~calm).max(), (open_ * exact).max(), (open_ * ~exact).max(), (weight * calm).max(),
                math.log1p(open_.sum()), min(1.0, 20 * (open_ > 0).sum() / n), math.log1p((weight * calm).sum()),
            )
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        parts = [self.features(x) for x in text_slices(texts)]
        if not parts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(np.concatenate(parts) @ self.coef + self.bias, -30, 30)))


def _more_likely(in_1: str, n_1: int, in_0: str, n_0: int) -> tuple[Column, Column]:
    """The logarithm of how many times likelier a term is in toxic texts, and whether the lower (Wilson) bound of its share there is above the upper one of its share elsewhere."""

    def bound(k: Column, n: int, z: float) -> Column:
        return (k + z * z / 2 + z * F.sqrt(k * (n - k) / max(1, n) + z * z / 4)) / (n + z * z)

    a, b = F.col(in_1).cast("double"), F.col(in_0).cast("double")
    odds = F.log((a + 0.5) / (n_1 + 1)) - F.log((b + 0.5) / (n_0 + 1))
    # a negative z with its square gives the lower bound
    return odds, bound(a, n_1, -SURE) > bound(b, n_0, SURE)


def near_copies(part: Slice, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each text a hash that near copies mostly share: the least of its words', 0 without any."""
    group = np.zeros(part.n, dtype=np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        group[some] = np.minimum.reduceat(mix(words), bounds[:-1][some])
    return group.view(np.int64)


def spellings(part: Slice, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Spans of a slice as lower-cased strings."""
    size = ends - starts
    offs = np.concatenate([[0], np.cumsum(size)])
    raw = LOWER[part.buf[np.repeat(starts - offs[:-1], size) + np.arange(offs[-1])]]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes()))


def _words_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (t, y): each distinct word that could be a term with its text's label and group, and a null word for each text."""
    for batch in batches:
        for part in text_slices(batch.column("t")):
            label = batch.column("y").slice(part.first, part.n).to_numpy()
            starts, ends, bounds = part.runs(ALNUM)
            words = part.hash_spans(part.prefix_hash(BYTE_HASH_FOLDED), starts, ends)
            near = near_copies(part, words, bounds)
            doc = owner(bounds)
            letters = np.concatenate([[0], np.cumsum((part.buf & 0xC0) != 0x80)])
            letters = letters[ends] - letters[starts]
            fits = np.flatnonzero((letters >= MIN_LETTERS) & (letters < MAX_LETTERS))
            fits = fits[np.lexsort((words[fits], doc[fits]))]
            new = np.ones(len(fits), dtype=bool)
            new[1:] = (words[fits[1:]] != words[fits[:-1]]) | (doc[fits[1:]] != doc[fits[:-1]])
            at = fits[new]
            yield pa.RecordBatch.from_arrays([spellings(part, starts[at], ends[at]), pa.array(label[doc[at]], pa.int32()), pa.array(near[doc[at]])], ["word", "y", "near"])
            yield pa.RecordBatch.from_arrays([pa.nulls(part.n, pa.string()), pa.array(label, pa.int32()), pa.array(near)], ["word", "y", "near"])


def group_counts(rows: DataFrame, key: str) -> DataFrame:
    """(key, in_1, in_0): of rows (key, y, near) the groups of near copies with label 1 and with label 0."""
    ones = F.sum(F.col("y").cast("bigint"))
    return rows.groupBy(key, "y", "near").agg(F.lit(1)).groupBy(key).agg(ones.alias("in_1"), (F.count(F.lit(1)) - ones).alias("in_0"))


def learn(sample: DataFrame, scratch: Scratch, shares: tuple[float, float] = (1.0, 1.0)) -> Model:
    """A model of rows (id, t, y): ids, texts and labels 0 or 1; shares: what part of the others and of the toxic texts the sample holds.

    Texts stay in the executors. What reaches the driver are the terms with their counts, at most
    MAX_TERMS, and N_FEATURES numbers for each text of the sample.
    """
    context = sample.sparkSession.sparkContext
    counts = scratch.write(group_counts(sample.select("t", "y").mapInArrow(_words_of_groups, "word string, y int, near bigint"), "word").filter(F.col("word").isNull() | (F.col("in_1") >= MIN_TEXTS)), "counts")
    total = counts.filter("word IS NULL").first()
    n_1, n_0 = (total.in_1, total.in_0) if total else (0, 0)
    if not n_1 or not n_0:
        model = Model([], [], [])
        model.bias = 9.0 if n_1 else -9.0
        return model
    odds, sure = _more_likely("in_1", n_1, "in_0", n_0)
    found = counts.filter("word IS NOT NULL").select("word", "in_1", odds.alias("odds"), sure.alias("sure")).filter(F.col("sure") & (F.col("odds") >= math.log(MIN_TIMES)))
    found = found.orderBy(F.desc("in_1"), "word").limit(MAX_TERMS).collect()
    model = Model([r.word for r in found], [r.odds for r in found], [0.0] * len(found))

    # misspellings of each term in texts of either label
    terms = context.broadcast(model)

    def misspelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = terms.value.ready()
        for batch in batches:
            for part in text_slices(batch.column("t")):
                label = batch.column("y").slice(part.first, part.n).to_numpy()
                starts, ends, bounds = part.runs(ALNUM)
                words = part.hash_spans(part.prefix_hash(BYTE_HASH_FOLDED), starts, ends)
                at, matches = ready.hits(part, words, starts, ends)
                doc = np.searchsorted(bounds, at, side="right") - 1
                some = np.unique(np.array([(t, d) for (t, e), d in zip(matches, doc.tolist(), strict=True) if e], dtype=np.int64).reshape(-1, 2), axis=0)
                near = near_copies(part, words, bounds)
                yield pa.RecordBatch.from_arrays([pa.array(some[:, 0].astype(np.int32)), pa.array(label[some[:, 1]], pa.int32()), pa.array(near[some[:, 1]])], ["term", "y", "near"])

    edits = group_counts(sample.select("t", "y").mapInArrow(misspelled, "term int, y int, near bigint"), "term")
    seen = {r.term: r.odds for r in edits.select("term", _more_likely("in_1", n_1, "in_0", n_0)[0].alias("odds")).collect()}
    for t, exact in enumerate(model.exact):
        most = UNSEEN_EDIT * exact
        # where only the term's own texts have its misspellings they say as much as their odds, at most so much
        model.edited[t] = min(most, max(0.0, seen[t])) if t in seen else most

    weighed = context.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = weighed.value.ready()
        for batch in batches:
            for part in text_slices(batch.column("t")):
                same = [batch.column(c).slice(part.first, part.n) for c in ("id", "y")]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array(x) for x in ready.features(part).T.copy())], ["id", "y", *NAMES])

    made = sample.select(F.col("id").cast("string").alias("id"), "y", "t").mapInArrow(features, "id string, y int, " + ", ".join(f"{n} double" for n in NAMES)).toArrow()
    # sums of floating-point numbers depend on the order
    made = made.sort_by([(n, "ascending") for n in ("id", "y", *NAMES)])
    x, label = np.stack([made.column(n).to_numpy() for n in NAMES], axis=1), made.column("y").to_numpy()
    weight = np.where(label == 1, 1 / shares[1], 1 / shares[0])
    model.coef, model.bias = fit_logistic(x, label, weight / weight.mean())
    return model


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weighted logistic regression with a ridge, by Newton steps."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    penalty = np.full(a.shape[1], ridge * len(x))
    penalty[-1] = 1e-6 * len(x)
    b = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        slope = a.T @ (weight * (p - y)) + penalty * b
        curve = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, slope)
        b -= step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return b[:-1], float(b[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from labelled ids outside the held-out fold, about MAX_TOXIC and MAX_OTHER of them at most.

    Of several labels of a document the highest holds, and of several texts of one id the one with the
    least hash; null labels and labels of no document are left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    known = known.filter(fold_of("id", FOLDS) != HELD_OUT).groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    rows = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    bounds = (MAX_OTHER, MAX_TOXIC)
    chosen = known.filter(F.when(F.col("y") == 1, share_filter(F.col("id"), rows.get(1, 0), bounds[1])).otherwise(share_filter(F.col("id"), rows.get(0, 0), bounds[0])))
    # the ids are bounded, so they can go to every task
    sample = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("t")).join(F.broadcast(chosen), "id")
    sample = sample.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("m")).select("id", "y", F.col("m.t").alias("t"))
    sample = scratch.write(sample.repartition(2 * spark.sparkContext.defaultParallelism, "id"), "sample")
    model = learn(sample, scratch, tuple(min(1.0, bounds[y] / max(1, rows.get(y, 0))) for y in (0, 1)))
    scratch.drop("sample", "counts")
    return model


def score_function(model: Model):
    """A function of a text column that gives the score; null counts as the empty text."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready = model.ready()
        for batch in texts:
            yield pa.array(ready.scores(batch), pa.float64())

    return score


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted (1 from THRESHOLD on). A null id is in no held-out fold."""
    made = docs.select(col(id_col).alias("id"), score_function(model)(col(text_col)).alias("score"))
    return made.select(F.col("id").alias(id_col), (fold_of("id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below THRESHOLD, all columns unchanged."""
    row = fresh(docs, "row")
    held = docs.select(F.struct(*(col(c) for c in docs.columns)).alias(row), score_function(model)(col(text_col)).alias("score"))
    return held.filter(F.col("score") < THRESHOLD).select(f"{row}.*")
