"""Language-model scores: a log-bilinear neural model, trained with noise-contrastive estimation.

Counts of all training tokens are made first (they are also the base score and the noise). The model
predicts a token from the two before it, in two steps: first its unit, then the word within the unit.
Each of the most frequent words is a unit of its own; the next ones, up to HOT, make units of TAIL
words of about equal frequency, within which the model chooses by the same context; all rarer words,
however many the corpus has, make RARE units by how they are spelled at the end, within which a word
gets its share by its count, with one share left for unseen words. So token probabilities sum to one
over all words, every token is predicted from its context, and a rare word is context by its unit.

Training covers every training document: in each round every task steps through its own texts from
the shared parameters, and each parameter becomes the mean of what the tasks that used it made of it,
weighted by how often they did, in a shuffle. The parameters, and so the scores, depend on how rows
fall into tasks; the counts and the base score do not.

A token's probability is the mean of the log-bilinear one, weighted MIX, and that of the counts, which
holds where a context has been seen too little; both sum to one, so it does.

Normalisers are exact, in batched matrix products over the units, and over a unit's words.

Counts of the HOT words go to every worker. A rarer word has at most one token in HOT, so no key of
the join that counts the rest can be hot through the training texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import BYTE_HASH_FOLDED, NONSPACE, STEP, U64, HashIndex, Slice, mix, segment_sums, text_slices
from .store import Scratch, col, fold_of

FOLDS, HELD_OUT = 7, 2
#: Words with vectors of their own, whose counts are broadcast; what bounds them is a worker's memory (about 400 bytes each).
HOT = 1 << 16
#: Of these the ones that are units, how many of the others make a unit, and units of rarer words.
SINGLE, TAIL, RARE = 256, 384, 128
#: The size of a word's vector.
SIZE = 24
#: Rounds of averaging; each covers its own share of the documents, together all.
ROUNDS = 2
BATCH, RATE = 4096, 0.08
#: The share of the log-bilinear model in a token's probability; the rest is that of the counts alone, as of the base score.
MIX = 0.5
#: Units drawn as noise for a batch, and words of their unit for each GROUP of a batch's tokens of one unit, or fewer.
NOISE, WITHIN, GROUP = 32, 8, 4
#: Tokens that a task trains on, about: each task sends on all its parameters.
TASK_TOKENS = 8_000_000
#: Contexts in one matrix product when scoring.
TOGETHER = 256
#: Places for contexts whose normalisers a worker remembers when scoring; a later context takes an earlier one's place.
REMEMBERED = 1 << 20
#: Bytes of text whose tokens are mixed in training, or scored at once.
MIXED_BYTES = 1 << 20
#: Bytes of text whose token counts are joined before they are sent on.
COUNT_BYTES = 8 << 20
END = np.uint64(0x5EED_0000_0000_0E0D)


def tokens_of(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a slice's lower-cased words with END after each text's, the bounds of each text's tokens, and the rare unit that each token's spelling has."""
    starts, ends, bounds = part.runs(NONSPACE)
    words = part.hash_spans(part.prefix_hash(BYTE_HASH_FOLDED), starts, ends)
    last = BYTE_HASH_FOLDED[part.buf[ends - 1]]
    ending = mix(last * U64(STEP) + np.where(ends - starts > 1, BYTE_HASH_FOLDED[part.buf[np.maximum(ends - 2, 0)]], U64(0))) % U64(RARE)
    out, unit = np.full(len(words) + part.n, END, dtype=np.uint64), np.zeros(len(words) + part.n, dtype=np.int64)
    place = np.arange(len(words)) + np.repeat(np.arange(part.n), np.diff(bounds))
    out[place], unit[place] = words, ending
    return out, bounds + np.arange(part.n + 1), unit


def count_tokens(texts: DataFrame) -> DataFrame:
    """Rows (word, ending, n) over the single text column: each word's hash, the rare unit of its spelling, and its number of tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def joined() -> pa.RecordBatch:
            words, endings, n = (np.concatenate(x) for x in zip(*held, strict=True))
            kinds, first, which = np.unique(words, return_index=True, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(endings[first].astype(np.int32)), pa.array(np.bincount(which, n).astype(np.int64))], ["word", "ending", "n"])

        for batch in batches:
            for part in text_slices(batch.column(0)):
                hashes, _, endings = tokens_of(part)
                kinds, first, n = np.unique(hashes, return_index=True, return_counts=True)
                held.append((kinds, endings[first], n))
                size += len(part.buf)
                if size >= COUNT_BYTES:
                    yield joined()
                    held, size = [], 0
        if held:
            yield joined()

    return texts.mapInArrow(count, "word bigint, ending int, n bigint").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


class Vocabulary:
    """The hot words and their counts, most frequent first, and the units.

    tokens, kinds: of each rare unit the tokens and the distinct words of training that are not hot.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: np.ndarray, kinds: np.ndarray, total: int, distinct: int):
        self.words, self.counts, self.total, self.distinct = words.astype(np.int64).view(np.uint64), counts.astype(np.int64), int(total), int(distinct)
        self.hot = len(self.words)
        #: Of each hot word the logarithm of its count and 1, and its share by counts; what comes last is for a rarer word, but for its own count and 1.
        self.logs = np.log10(np.append(self.counts, 0) + 1.0)
        self.shares = (np.append(self.counts, 0) + 1.0) / (self.total + self.distinct + 1.0)
        #: What the counts (and 1 for each word) of a rare unit add up to, with 1 for all unseen words.
        self.rest = (tokens + kinds + 1).astype(np.float64)
        self.single, self.tail = min(SINGLE, self.hot), TAIL
        #: Where each unit of several words starts among the hot ones, and the end of the last.
        self.starts = np.append(np.arange(self.single, self.hot, self.tail), self.hot)
        self.first_rare = self.single + len(self.starts) - 1
        many = np.add.reduceat(self.counts, self.starts[:-1]) if len(self.starts) > 1 else self.counts[:0]
        noise = np.concatenate([self.counts[: self.single], many, np.maximum(1, tokens)]).astype(np.float64)
        self.noise = noise / noise.sum()

    def index(self) -> HashIndex:
        made = HashIndex(len(self.words) + 1)
        made.insert(self.words, np.arange(len(self.words)))
        return made

    def places(self, rank: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """Rows of the vectors: of a hot word its own, of a rarer one its unit's."""
        return np.where(rank >= 0, rank, self.hot + ending)

    def units(self, places: np.ndarray) -> np.ndarray:
        return np.where(places < self.single, places, np.where(places < self.hot, self.single + (places - self.single) // self.tail, places - self.hot + self.first_rare))


class LogBilinear:
    """h(u, v) = left * vector[u] + near * vector[v] is the context of a token after u, v; its unit scores h . out[unit] + bias[unit], a word within
    a unit of several h . inner[word] + own[word]. The last vector stands for places before the text."""

    NAMES = ("vector", "out", "bias", "inner", "own", "left", "near")

    def __init__(self, words: Vocabulary, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.words, units = words, len(words.noise)
        self.vector = rng.normal(0, 0.1, (words.hot + RARE + 1, SIZE)).astype(np.float32)
        self.out = rng.normal(0, 0.1, (units, SIZE)).astype(np.float32)
        self.bias = np.log(words.noise).astype(np.float32)[:, None]
        self.inner = rng.normal(0, 0.1, (words.hot, SIZE)).astype(np.float32)
        of_unit = words.noise[words.units(np.arange(words.hot))] if words.hot else np.ones(0)
        self.own = np.log(np.maximum(words.counts, 1) / max(1, words.counts.sum()) / of_unit).astype(np.float32)[:, None]
        self.left, self.near = np.full((1, SIZE), 0.5, np.float32), np.ones((1, SIZE), np.float32)
        self.reset()

    def reset(self) -> None:
        self.seen = {name: np.full_like(getattr(self, name), 1e-3) for name in self.NAMES}
        self.used = {name: np.zeros(len(getattr(self, name)), dtype=np.int64) for name in self.NAMES}
        self.forget()

    def forget(self) -> None:
        """Drops what scoring remembers of the parameters."""
        self.met = None

    def parameters(self) -> np.ndarray:
        """All parameters as rows of SIZE numbers; the biases fill the last column of their vectors' rows, of SIZE + 1 numbers."""
        return np.concatenate([self._with_bias(*x) for x in ((self.vector, None), (self.out, self.bias), (self.inner, self.own), (self.left, None), (self.near, None))])

    @staticmethod
    def _with_bias(rows: np.ndarray, bias: np.ndarray | None) -> np.ndarray:
        return np.concatenate([rows, np.zeros((len(rows), 1), np.float32) if bias is None else bias], axis=1)

    def uses(self) -> np.ndarray:
        """How often each row of the parameters has been stepped."""
        return np.concatenate([self.used[name] for name in ("vector", "out", "inner", "left", "near")])

    def set_parameters(self, rows: np.ndarray) -> None:
        sizes = [len(x) for x in (self.vector, self.out, self.inner, self.left, self.near)]
        parts = np.split(rows.astype(np.float32), np.cumsum(sizes)[:-1])
        self.vector, self.out, self.inner, self.left, self.near = (np.ascontiguousarray(x[:, :SIZE]) for x in parts)
        self.bias, self.own = parts[1][:, SIZE:].copy(), parts[2][:, SIZE:].copy()
        self.reset()

    def contexts(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token the words two and one places before it in its text."""
        start = len(self.vector) - 1
        left, near = np.full(len(ids), start), np.full(len(ids), start)
        near[1:], left[2:] = ids[:-1], ids[:-2]
        first = bounds[:-1][np.diff(bounds) > 0]
        near[first] = left[first] = start
        second = bounds[:-1][np.diff(bounds) > 1] + 1
        left[second] = start
        return left, near

    def _add(self, rows: np.ndarray | None, **slopes: np.ndarray) -> None:
        """An AdaGrad step of parameters of the same rows, all without ``rows``; the slopes of equal rows are summed first."""
        if rows is None:
            kinds, times = slice(None), 1
        else:
            size = len(getattr(self, next(iter(slopes))))
            there, number = np.zeros(size, dtype=bool), np.empty(size, dtype=np.int64)
            there[rows] = True
            kinds = np.flatnonzero(there)
            number[kinds] = np.arange(len(kinds))
            which = number[rows]
            times = np.bincount(which, minlength=len(kinds))
        for name, slope in slopes.items():
            if rows is not None:
                slope = _row_sums(which, slope, len(kinds))
            value, seen = getattr(self, name), self.seen[name]
            self.used[name][kinds] += times
            squares = slope * slope
            squares += seen if rows is None else seen.take(kinds, axis=0)
            _put(seen, kinds, squares)
            change = np.divide(slope, np.sqrt(squares, out=squares), out=squares)
            change *= np.float32(RATE)
            change += value if rows is None else value.take(kinds, axis=0)
            _put(value, kinds, change)

    def step(self, left: np.ndarray, near: np.ndarray, target: np.ndarray, rng: np.random.Generator, cumulated: np.ndarray) -> None:
        """One noise-contrastive step over a batch's tokens, whose vectors' rows are ``target``."""
        words, scale = self.words, np.float32(1 / len(target))
        self.forget()
        u, v = self.vector.take(left, axis=0), self.vector.take(near, axis=0)
        context = u * self.left + v * self.near

        # units against NOISE units drawn for the whole batch
        unit = words.units(target)
        drawn = np.minimum(np.searchsorted(cumulated, rng.random(NOISE)), len(words.noise) - 1)
        shift = np.log(NOISE * words.noise).astype(np.float32)
        of_unit, of_drawn = self.out.take(unit, axis=0), self.out[drawn]
        true = scale * (1 - _sigmoid(np.einsum("ik,ik->i", context, of_unit) + self.bias[unit, 0] - shift[unit]))
        false = -scale * _sigmoid(context @ of_drawn.T + self.bias[drawn, 0] - shift[drawn])
        back = false @ of_drawn
        back += np.multiply(of_unit, true[:, None], out=of_unit)
        self._add(np.concatenate([unit, drawn]), out=np.concatenate([true[:, None] * context, false.T @ context]), bias=np.concatenate([true, false.sum(axis=0)])[:, None])

        # words within units of several, against WITHIN of the unit's words drawn for each group, all alike
        some = np.flatnonzero((target >= words.single) & (target < words.hot))
        if len(some):
            some = some[np.argsort(unit[some], kind="stable")]
            begins = np.flatnonzero(np.diff(unit[some], prepend=-1))
            place = np.arange(len(some)) - np.repeat(begins, np.diff(begins, append=len(some)))
            slot, group = place % GROUP, np.cumsum(place % GROUP == 0) - 1
            which = unit[some[slot == 0]] - words.single
            first, size = words.starts[which], words.starts[which + 1] - words.starts[which]
            drawn = np.minimum(first[:, None] + (rng.random((len(first), WITHIN)) * size[:, None]).astype(np.int64), (first + size - 1)[:, None])
            shift = np.log(WITHIN / size).astype(np.float32)
            rows, h = self.inner.take(target[some], axis=0), context.take(some, axis=0)
            true = scale * (1 - _sigmoid(np.einsum("ik,ik->i", rows, h) + self.own[target[some], 0] - shift[group]))
            # a group's contexts are the rows of a matrix; those it has not are zero and have no slopes
            grouped, there = np.zeros((len(first), GROUP, SIZE), np.float32), np.zeros((len(first), GROUP, 1), np.float32)
            grouped[group, slot], there[group, slot] = h, scale
            noise = self.inner.take(drawn, axis=0)
            said = grouped @ noise.transpose(0, 2, 1)
            said += (self.own[drawn, 0] - shift[:, None])[:, None, :]
            false = -there * _sigmoid(said)
            rows *= true[:, None]
            rows += (false @ noise)[group, slot]
            back[some] += rows
            h *= true[:, None]
            inner, own = np.concatenate([h, (false.transpose(0, 2, 1) @ grouped).reshape(-1, SIZE)]), np.concatenate([true, false.sum(axis=1).ravel()])
            self._add(np.concatenate([target[some], drawn.ravel()]), inner=inner, own=own[:, None])

        left_slope, near_slope = (back * u).sum(axis=0, keepdims=True), (back * v).sum(axis=0, keepdims=True)
        self._add(np.concatenate([left, near]), vector=np.concatenate([back * self.left, back * self.near]))
        self._add(None, left=left_slope)
        self._add(None, near=near_slope)

    def log_probabilities(self, target: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Natural logarithms of each token's normalised probability; of a rare token that of its unit."""
        words = self.words
        left, near = self.contexts(target, bounds)
        if self.met is None:
            # a bias is the weight of a last number that is always 1
            out, inner = self._with_bias(self.out, self.bias), self._with_bias(self.inner, self.own)
            self.met = out, inner, np.full(REMEMBERED, -1, dtype=np.int64), np.zeros(REMEMBERED, np.float32)
        out, inner, known, norms = self.met
        context, longest = np.ones((len(target), SIZE + 1), np.float32), 0.0
        for i in range(0, len(target), BATCH):
            h, more = self.vector.take(left[i : i + BATCH], axis=0), self.vector.take(near[i : i + BATCH], axis=0)
            h *= self.left
            h += np.multiply(more, self.near, out=more)
            longest = max(longest, _longest(h))
            context[i : i + BATCH, :SIZE] = h
        # no product of two vectors is larger than their lengths'
        most, most_inner = (longest * _longest(x[:, :SIZE]) + float(np.abs(x[:, SIZE]).max(initial=0)) for x in (out, inner))
        scores = np.empty(TOGETHER * max(len(out), words.tail), np.float32)

        def products(rows: np.ndarray, vectors: np.ndarray) -> np.ndarray:
            return np.matmul(rows, vectors.T, out=scores[: len(rows) * len(vectors)].reshape(len(rows), len(vectors)))

        # normalisers of contexts that the worker does not remember
        pair = left * len(self.vector) + near
        slot = (mix(pair.view(np.uint64)) % U64(REMEMBERED)).astype(np.int64)
        norm, new = norms[slot], np.flatnonzero(known[slot] != pair)
        kinds, first, which = np.unique(pair[new], return_index=True, return_inverse=True)
        first, made = new[first], np.empty(len(kinds), np.float32)
        for i in range(0, len(kinds), TOGETHER):
            made[i : i + TOGETHER] = _log_sums(products(context.take(first[i : i + TOGETHER], axis=0), out), most)
        norm[new] = made[which]
        known[slot[first]] = kinds
        mine = known[slot[first]] == kinds
        norms[slot[first[mine]]] = made[mine]
        unit = words.units(target)
        said = np.empty(len(target), np.float32)
        for i in range(0, len(target), BATCH):
            some = slice(i, i + BATCH)
            said[some] = np.einsum("ik,ik->i", context[some], out.take(unit[some], axis=0))
        said -= norm
        # tokens of each unit of several words together
        inside = np.flatnonzero((target >= words.single) & (target < words.hot))
        inside = inside[np.argsort(unit[inside], kind="stable")]
        edges = np.flatnonzero(np.diff(unit[inside], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            k = unit[inside[a]] - words.single
            first, last = words.starts[k], words.starts[k + 1]
            for i in range(a, b, TOGETHER):
                some = inside[i : min(b, i + TOGETHER)]
                of_words = products(context.take(some, axis=0), inner[first:last])
                own = of_words[np.arange(len(some)), target[some] - first]
                said[some] += own - _log_sums(of_words, most_inner)
        return np.minimum(said, 0).astype(np.float64)


def _row_sums(which: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows that have each number below n; columns are summed in pairs, as complex numbers, where their number is even."""
    pairs = np.ascontiguousarray(rows, dtype=np.float32)
    pairs = pairs.view(np.complex64) if pairs.shape[1] % 2 == 0 else pairs
    width = pairs.shape[1]
    sums = np.zeros(n * width, dtype=pairs.dtype)
    np.add.at(sums, (which[:, None] * width + np.arange(width)).ravel(), pairs.ravel())
    return sums.view(np.float32).reshape(n, -1)


def _put(table: np.ndarray, kinds: np.ndarray | slice, rows: np.ndarray) -> None:
    """Rows in the places of others, each as one item of its bytes."""
    if isinstance(kinds, slice):
        table[kinds] = rows
    else:
        item = f"V{table.itemsize * table.shape[1]}"
        table.view(item).reshape(-1)[kinds] = rows.view(item).reshape(-1)


def _longest(rows: np.ndarray) -> float:
    """The length of the longest row."""
    return float(np.sqrt(np.einsum("ik,ik->i", rows, rows).max(initial=0)))


def _log_sums(scores: np.ndarray, most: float) -> np.ndarray:
    """The logarithm of the sum of exponentials of each row; ``scores`` is used up. most: a bound on their size."""
    if not most < 60:
        top = scores.max(axis=1, keepdims=True)
        scores -= top
        return top[:, 0] + np.log(np.exp(scores, out=scores).sum(axis=1))
    # no sum of so small exponents leaves the range of 32 bits
    return np.log(np.exp(scores, out=scores) @ np.ones(scores.shape[1], np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train_round(texts: DataFrame, vocabulary, parameters: np.ndarray) -> np.ndarray:
    """The parameters after a round: of each row the mean of what tasks make of it with their own texts, weighted by how often they use it."""
    shared = texts.sparkSession.sparkContext.broadcast(parameters)
    columns = [f"v{k}" for k in range(SIZE + 1)]

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Vocabulary = vocabulary.value
        index, model = words.index(), LogBilinear(words)
        model.set_parameters(shared.value)
        rng, cumulated = np.random.default_rng(17), np.cumsum(words.noise)
        for batch in batches:
            for part in text_slices(batch.column(0), MIXED_BYTES):
                hashes, bounds, endings = tokens_of(part)
                target = words.places(index.lookup(hashes), endings)
                left, near = model.contexts(target, bounds)
                # a batch mixes the slice's texts
                order = rng.permutation(len(target))
                for i in range(0, len(order), BATCH):
                    some = order[i : i + BATCH]
                    model.step(left[some], near[some], target[some], rng, cumulated)
        uses = model.uses()
        rows = np.flatnonzero(uses)
        made = model.parameters()
        for i in range(0, len(rows), BATCH):
            some = rows[i : i + BATCH]
            weighted = (made[some] * uses[some][:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(uses[some]), *(pa.array(np.ascontiguousarray(weighted[:, k])) for k in range(SIZE + 1))], ["row", "uses", *columns])

    made = texts.mapInArrow(train, "row int, uses bigint, " + ", ".join(f"{c} float" for c in columns))
    mean = made.groupBy("row").agg(*((F.sum(c) / F.sum("uses")).cast("float").alias(c) for c in columns)).toArrow()
    after = parameters.copy()
    after[mean.column("row").to_numpy()] = np.stack([mean.column(c).to_numpy() for c in columns], axis=1)
    shared.destroy()
    return after


def fit(texts: DataFrame, scratch: Scratch) -> tuple[Vocabulary, np.ndarray, DataFrame]:
    """The vocabulary, the trained parameters, and the counts (word, ending, n) of all tokens of the training texts (id, text)."""
    spark = texts.sparkSession
    counts = scratch.write(count_tokens(texts.select("text")), "counts")
    units = {r.ending: (r.n, r.kinds) for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()}
    tokens, kinds = (np.array([units.get(e, (0, 0))[k] for e in range(RARE)], dtype=np.int64) for k in range(2))
    total, distinct = int(tokens.sum()), int(kinds.sum())
    hot = counts.orderBy(F.desc("n"), "word").limit(HOT).toArrow()
    word, ending, n = (hot.column(c).to_numpy() for c in ("word", "ending", "n"))
    tokens = tokens - np.bincount(ending, n, minlength=RARE).astype(np.int64)
    kinds = kinds - np.bincount(ending, minlength=RARE)
    words = Vocabulary(word, n, tokens, kinds, total, distinct)
    vocabulary = spark.sparkContext.broadcast(words)
    parameters = LogBilinear(words).parameters()
    tasks = max(2 * spark.sparkContext.defaultParallelism, total // (ROUNDS * TASK_TOKENS))
    for r in range(ROUNDS if total else 0):
        part = texts.filter(F.pmod(F.xxhash64(F.lit("round"), "id"), F.lit(ROUNDS)) == r)
        parameters = train_round(part.select("text").coalesce(tasks), vocabulary, parameters)
    return words, parameters, counts


SCORED = "row bigint, id string, n_tokens bigint, hot_tokens bigint, hot_logs double, model_logs double, rare array<struct<word: bigint, n: bigint>>"


def score_slice(part: Slice, words: Vocabulary, index: HashIndex, model: LogBilinear) -> dict[str, np.ndarray | pa.Array]:
    """Of each text what needs no counts but the hot words'; rare has its other words and how often they occur."""
    hashes, bounds, endings = tokens_of(part)
    rank = index.lookup(hashes)
    hot = rank >= 0
    logs = words.logs[rank]
    said = np.exp(model.log_probabilities(words.places(rank, endings), bounds))
    at = np.flatnonzero(~hot)
    # a rare word's share of its unit is (count + 1) / rest, and its count, a factor of both probabilities, is joined later
    said[at] /= words.rest[endings[at]]
    said = np.log10(MIX * said + (1 - MIX) * words.shares[rank])
    doc = np.searchsorted(bounds, at, side="right") - 1
    order = np.lexsort((hashes[at], doc))
    kind, doc = hashes[at][order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1])])) if len(kind) else np.zeros(0, dtype=np.int64)
    pairs = pa.StructArray.from_arrays([pa.array(kind[first].view(np.int64)), pa.array(np.diff(first, append=len(kind)))], ["word", "n"])
    return {
        "n_tokens": np.diff(bounds), "hot_tokens": segment_sums(hot, bounds), "hot_logs": segment_sums(logs, bounds), "model_logs": segment_sums(said, bounds),
        "rare": pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[first], np.arange(part.n + 1)), pa.int32()), pairs),
    }


def score_documents(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score sums log10((c + 1) / (N + V + 1)) over the tokens; score is the model's log10
    probability of the text. Null texts are empty and have the end token alone. A null id is in no
    held-out fold. Repeated rows are scored each by itself and all count in training. Without any
    training document the base score is 0, and a token's score is the mean of that and one of RARE units'.
    """
    spark = docs.sparkSession
    chosen = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    training = chosen.filter(fold_of("id", FOLDS) != HELD_OUT)
    words, parameters, counts = fit(training, scratch)
    vocabulary = spark.sparkContext.broadcast(words)
    shared = spark.sparkContext.broadcast(parameters)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Vocabulary = vocabulary.value
        index, model = words.index(), LogBilinear(words)
        model.set_parameters(shared.value)
        for batch in batches:
            for part in text_slices(batch.column("text"), MIXED_BYTES):
                made = score_slice(part, words, index, model)
                same = [batch.column(c).slice(part.first, part.n) for c in ("row", "id")]
                yield pa.RecordBatch.from_arrays([*same, *(x if isinstance(x, pa.Array) else pa.array(x) for x in made.values())], ["row", "id", *made])

    # the row numbers are fixed by writing them
    numbered = chosen.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("string").alias("id"), "text")
    scored = scratch.write(numbered.mapInArrow(score, SCORED), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    found = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("rare_tokens"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_logs"))
    met = scored.drop("rare").join(found, "row", "left").na.fill(0, ["rare_tokens", "rare_logs"])
    total = float(np.log10(words.total + words.distinct + 1.0))
    kind = docs.select(col(id_col).alias("id")).schema["id"].dataType
    return met.select(
        F.col("id").cast(kind).alias(id_col), (fold_of("id", FOLDS) == HELD_OUT).alias("held_out"), "n_tokens",
        (F.col("hot_tokens") + F.col("rare_tokens")).alias("n_known"), F.lit(words.total).cast("bigint").alias("train_tokens"),
        (F.col("hot_logs") + F.col("rare_logs") - F.col("n_tokens") * total).alias("base_score"),
        (F.col("model_logs") + F.col("rare_logs")).alias("score"),
    )
