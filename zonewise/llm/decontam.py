"""Benchmark decontamination with suffix arrays over the training texts.

The texts of a batch are shards; each shard gets an array of its suffixes, as word sequences, in
lexicographic order. Every suffix of a benchmark item that holds a window is binary-searched in it,
word by word, for all suffixes at once: the range left after the window's last word holds all places
where it occurs. From each such place that cannot be extended to the left the match is followed to
its end, which gives the longest verbatim matches and their locations; these mark the words of the
documents that are hit, and tell the items. Only training suffixes that could hold a whole window are sorted: those that begin with
enough words in a row that the benchmark has.

Documents are not shuffled; the benchmark's index goes to every worker. A benchmark beyond
INDEX_BYTES is indexed in parts, one pass over the documents for each, and the passes' hits are
united by row, so no worker and no driver holds more than a part at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import ALNUM, BYTE_HASH_FOLDED, Slice, owner, segment_sums, text_slices
from .store import Scratch, bound_batches, col

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
HIT_SHARE = 20
#: Bytes of text in one shard's suffix array.
SHARD_BYTES = 1 << 21
#: Bytes of benchmark text that one index may hold, or one item (about 20 bytes of index for each); a larger benchmark makes several passes.
INDEX_BYTES = 16 << 20
#: Pairs of a place in a shard and one in the benchmark that are looked at together.
PAIRS = 1 << 20


def words_of(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a slice, and the bounds of each text's words."""
    starts, ends, bounds = part.runs(ALNUM)
    return part.hash_spans(part.prefix_hash(BYTE_HASH_FOLDED), starts, ends), bounds


class BenchmarkIndex:
    """The windows of a benchmark as numbers of a vocabulary: windows[i, :size[i]], and where in which items each stands."""

    def __init__(self, rows: list[tuple[str, str]], window: int = WINDOW):
        rows = sorted(set(rows))
        item_ids = [i for i, _ in rows]
        words, bounds = [np.zeros(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)]
        for part in text_slices(pa.array([t for _, t in rows], pa.large_string())):
            w, b = words_of(part)
            bounds.append(b[1:] + bounds[-1][-1])
            words.append(w)
        words, bounds = np.concatenate(words), np.concatenate(bounds)
        self.vocabulary, number = np.unique(words, return_inverse=True)
        number = number.astype(np.int32) + 1
        counts = np.diff(bounds)
        made = np.where(counts == 0, 0, np.maximum(1, counts - window + 1))
        item = np.repeat(np.arange(len(counts)), made)
        start = np.arange(len(item)) - np.repeat(np.cumsum(made) - made, made) + bounds[:-1][item]
        size = np.minimum(window, counts[item])
        rows = np.zeros((len(item), window), dtype=np.int32)
        for k in range(window):
            has = size > k
            rows[has, k] = number[start[has] + k]
        self.windows, which = np.unique(rows, axis=0, return_inverse=True)
        which = which.reshape(-1)
        self.size = (self.windows > 0).sum(axis=1)
        self.ids = sorted(set(item_ids))
        order = {x: i for i, x in enumerate(self.ids)}
        ids = np.array([order[x] for x in item_ids], dtype=np.int64)
        self.least = int(self.size.min()) if len(self.windows) else 0
        # all items' words, with a number before, between and after them that no text has
        self.text = np.full(len(number) + len(counts) + 1, -1, dtype=np.int32)
        self.text[np.arange(len(number)) + owner(bounds) + 1] = number
        # the suffixes with each window: their items, offsets there and places in text
        order = np.argsort(which, kind="stable")
        self.suffix_bounds = np.searchsorted(which[order], np.arange(len(self.windows) + 1))
        self.suffix_item, self.suffix_place = ids[item][order], (start + item + 1)[order]
        self.suffix_row, self.suffix_offset = item[order], (start - bounds[:-1][item])[order]
        # the vocabulary by 16 bits of the hash, so that most words of a text are told to be foreign at once
        self.first_bits = np.zeros(1 << 16, dtype=bool)
        self.first_bits[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The vocabulary's number of each word, from 1; 0 for a word that the benchmark doesn't have."""
        out = np.zeros(len(words), dtype=np.int32)
        maybe = np.flatnonzero(self.first_bits[(words & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, words[maybe])
        known = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == words[maybe]
        out[maybe[known]] = at[known] + 1
        return out


class SuffixArray:
    """The suffixes of a shard that begin with ``least`` known words, sorted by their first ``depth`` words."""

    def __init__(self, seq: np.ndarray, least: int, depth: int):
        self.seq = seq
        n = len(seq)
        # where the run of known words at each position ends
        stop = np.where(seq == 0, np.arange(n), n)
        stop = np.minimum.accumulate(stop[::-1])[::-1]
        at = np.flatnonzero(stop - np.arange(n) >= least)
        bits = max(1, int(seq.max(initial=0)).bit_length())
        per_key = max(1, 63 // bits)
        keys = []
        for k in range(0, depth, per_key):
            key = np.zeros(len(at), dtype=np.int64)
            for j in range(k, min(depth, k + per_key)):
                key = (key << bits) | self.word(at, j)
            keys.append(key)
        self.array = at[np.lexsort(keys[::-1])]

    def word(self, at: np.ndarray, k: int) -> np.ndarray:
        return self.seq[np.minimum(at + k, len(self.seq) - 1)]

    def _bound(self, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, k: int, after: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            found = self.word(self.array[np.minimum(mid, len(self.array) - 1)], k)
            less = open_ & ((found <= wanted) if after else (found < wanted))
            low = np.where(less, mid + 1, low)
            high = np.where(open_ & ~less, mid, high)
        return low

    def search(self, windows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that occur, and the range of the array that holds the occurrences of each."""
        live = np.arange(len(windows))
        low, high = np.zeros(len(windows), dtype=np.int64), np.full(len(windows), len(self.array), dtype=np.int64)
        for k in range(windows.shape[1]):
            going = np.flatnonzero(size[live] > k)
            if not len(going):
                break
            wanted = windows[live[going], k]
            first = self._bound(low[going], high[going], wanted, k, False)
            last = self._bound(first, high[going], wanted, k, True)
            low[going], high[going] = first, last
            left = low < high
            live, low, high = live[left], low[left], high[left]
        return live, low, high


def longest_matches(seq: np.ndarray, at: np.ndarray, window: np.ndarray, begin: np.ndarray, index: BenchmarkIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matches that can be extended to neither side, for windows found at places of seq.

    Rows (text, item, offset, position, length), sorted: of each text and benchmark suffix the longest match, of equal ones the first. Then,
    of all matches, which words of seq lie inside one, and the pairs (text, item), sorted. Each occurrence of a window lies inside a match.
    """
    many = np.diff(index.suffix_bounds)[window]
    upto = np.concatenate([[0], np.cumsum(many)])
    found, pairs = [np.zeros((0, 6), dtype=np.int64)], [np.zeros((0, 2), dtype=np.int64)]
    edges = np.zeros(len(seq) + 1, dtype=np.int64)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + PAIRS, side="right")) - 1)
        some = np.repeat(np.arange(i, j), many[i:j])
        suffix = index.suffix_bounds[window[some]] + np.arange(len(some)) - (upto[some] - upto[i])
        place, there = at[some], index.suffix_place[suffix]
        # a word of 0 is foreign, so it equals none of the benchmark's
        starts = (place == 0) | (seq[place - 1] != index.text[there - 1])
        place, there, suffix = place[starts], there[starts], suffix[starts]
        length = index.size[window[some]][starts].astype(np.int64)
        going = np.arange(len(place))
        while len(going):
            further = place[going] + length[going]
            going = going[(further < len(seq)) & (seq[np.minimum(further, len(seq) - 1)] == index.text[there[going] + length[going]])]
            length[going] += 1
        doc = np.searchsorted(begin, place, "right") - 1
        made = np.stack([doc, index.suffix_item[suffix], index.suffix_row[suffix], index.suffix_offset[suffix], place - begin[doc], length], axis=1)
        np.add.at(edges, place, 1)
        np.subtract.at(edges, place + length, 1)
        pairs.append(np.unique(made[:, :2], axis=0))
        found.append(_longest(made))
        i = j
    return _longest(np.concatenate(found))[:, [0, 1, 3, 4, 5]], np.cumsum(edges[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)


def _longest(rows: np.ndarray) -> np.ndarray:
    """Of rows (text, item, its row, offset, position, length) with equal first four the longest, of equals the first."""
    rows = rows[np.lexsort((rows[:, 4], -rows[:, 5], rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :4] != rows[:-1, :4]).any(axis=1)
    return rows[new]


def shard_hits(part: Slice, index: BenchmarkIndex) -> tuple[np.ndarray, list, list, list]:
    """Of each text: its number of words, the runs of words inside matches as [start, length, ...], the items that match, and the longest matches."""
    words, bounds = words_of(part)
    n_words = np.diff(bounds)
    empty = tuple([[] for _ in range(part.n)] for _ in range(3))
    if not len(index.windows) or not len(words):
        return n_words, *empty
    # a foreign word after each text keeps windows within it
    seq = np.zeros(len(words) + part.n, dtype=np.int32)
    doc = owner(bounds)
    seq[np.arange(len(words)) + doc] = index.numbers(words)
    begin = bounds[:-1] + np.arange(part.n)
    array = SuffixArray(seq, index.least, index.windows.shape[1])
    if not len(array.array):
        return n_words, *empty
    which, low, high = array.search(index.windows, index.size)
    if not len(which):
        return n_words, *empty
    times = high - low
    at = array.array[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())]
    window = np.repeat(which, times)
    longest, inside, pairs = longest_matches(seq, at, window, begin, index)
    hit = np.concatenate([[False], inside, [False]])
    turns = np.flatnonzero(hit[1:] != hit[:-1])
    run_start, run_end = turns[::2], turns[1::2]
    spans, items, matches = empty
    for d, s, e in zip(np.searchsorted(begin, run_start, "right") - 1, run_start, run_end, strict=True):
        spans[d] += [int(s - begin[d]), int(e - s)]
    for d, i in pairs.tolist():
        items[d].append(index.ids[i])
    for d, i, *place in longest.tolist():
        matches[d].append((index.ids[i], *place))
    return n_words, spans, items, matches


MATCHES = [("item", pa.string()), ("offset", pa.int64()), ("position", pa.int64()), ("length", pa.int64())]
HITS = "struct<n_words: bigint, spans: array<bigint>, items: array<string>, matches: array<struct<item: string, offset: bigint, position: bigint, length: bigint>>>"


def hits_function(index):
    """A function of a text column that gives HITS; index is a broadcast of a BenchmarkIndex."""

    @F.arrow_udf(HITS)
    def hits(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            n, spans, items, matches = [np.zeros(0, dtype=np.int64)], [], [], []
            for part in text_slices(batch, SHARD_BYTES):
                made = shard_hits(part, index.value)
                n.append(made[0])
                for whole, more in zip((spans, items, matches), made[1:], strict=True):
                    whole += more
            bounds = np.concatenate([[0], np.cumsum([len(m) for m in matches])])
            columns = list(zip(*(x for m in matches for x in m), strict=True)) or [()] * len(MATCHES)
            found = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, MATCHES, strict=True)], [name for name, _ in MATCHES])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), found)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(n), pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), lists], ["n_words", "spans", "items", "matches"])

    return hits


def build_indexes(benchmark: DataFrame, item_col: str, text_col: str, window: int = WINDOW) -> Iterator[BenchmarkIndex]:
    """Indexes of at most INDEX_BYTES of text, or one item, each; at least one."""
    rows = benchmark.select(F.coalesce(col(item_col).cast("string"), F.lit("")).alias("i"), F.coalesce(col(text_col), F.lit("")).alias("t"))
    rows = rows.select("i", "t", F.octet_length("t").alias("n"))
    part, held, made = [], 0, False
    for row in rows.toLocalIterator():
        if part and held + row.n > INDEX_BYTES:
            yield BenchmarkIndex(part, window)
            part, held, made = [], 0, True
        part.append((row.i, row.t))
        held += row.n
    if part or not made:
        yield BenchmarkIndex(part, window)


def with_hits(rows: DataFrame, text: Column, benchmark: DataFrame, item_col: str, item_text_col: str, window: int = WINDOW) -> DataFrame:
    """``rows``, which has no columns named as here, with n_words, n_hit, spans, items and matches of the text."""
    spark = rows.sparkSession
    bound_batches(spark)
    indexes = build_indexes(benchmark, item_col, item_text_col, window)
    index, following = next(indexes), next(indexes, None)
    if following is None:
        found = rows.withColumn("__hits", hits_function(spark.sparkContext.broadcast(index))(text))
    else:
        scratch = Scratch(spark, "decontamination")
        # the row numbers are fixed by writing them
        numbered = scratch.write(rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("__text", text), "numbered")
        united, k = None, 0
        while index is not None:
            shared = spark.sparkContext.broadcast(index)
            hits = numbered.select("__row", hits_function(shared)("__text").alias("h")).select("__row", "h.*")
            made = scratch.write(hits if united is None else hits.filter(F.size("items") > 0), f"pass{k}")
            shared.destroy()
            united, k = made if united is None else united.unionByName(made), k + 1
            index, following = following, next(indexes, None)
        joined = united.groupBy("__row").agg(F.struct(F.max("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "matches"))).alias("__hits"))
        found = numbered.join(joined, "__row").drop("__row", "__text")
    h = F.col("__hits")
    made = {"n_words": h["n_words"], "n_hit": n_hit(h["spans"]), "spans": h["spans"], "items": F.array_sort(F.array_distinct(h["items"])), "matches": F.array_sort(h["matches"])}
    return found.withColumns(made).drop("__hits")


def n_hit(spans: Column) -> Column:
    """Words in the union of spans [start, length, ...], which several indexes may have given overlapping."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(spans).cast("int") - 1, F.lit(1)), lambda i: F.struct(F.get(spans, i).alias("s"), F.get(spans, i + 1).alias("n"), i.alias("i"))))
    pairs = F.filter(pairs, lambda p: p["i"] % 2 == 0)
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("total"))

    def add(acc: Column, p: Column) -> Column:
        end = F.greatest(acc["end"], p["s"] + p["n"])
        return F.struct(end.alias("end"), (acc["total"] + end - F.greatest(acc["end"], p["s"])).alias("total"))

    return F.when(F.size(spans) > 0, F.aggregate(pairs, start, add)["total"]).otherwise(F.lit(0)).cast("bigint")


def contaminated(hit: Column, words: Column) -> Column:
    return (hit > 0) & (HIT_SHARE * hit >= words)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: id, n_words, n_hit, spans, items (sorted), matches (sorted), contaminated.

    spans has, as start and length in words in turn, the runs of the document's words that lie inside
    verbatim matches of at least a window, which are the words inside occurrences of windows; n_hit counts
    them, and items are those matched. matches has the longest verbatim matches of at least ``window`` words, or
    a whole shorter item: the item, the offset in it, the position in the document and the length, all
    in words; none can be extended to either side, and of several from one offset the longest, then
    the first, is named. An item with fewer than ``window`` words, but not none, is one window. Null and
    empty texts have no words and are clean; null and empty items match nothing. Items with the same
    id count once, a null id as the empty one. Each row is judged by itself.
    """
    rows = docs.select(col(id_col).alias("__id"), col(text_col).alias("__t"))
    found = with_hits(rows, F.col("__t"), benchmark, item_col, item_text_col, window).drop("__t")
    return found.withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words"))).withColumnRenamed("__id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are clean, all columns unchanged."""
    held = docs.select(F.struct(*(col(c) for c in docs.columns)).alias("__kept"), col(text_col).alias("__t"))
    found = with_hits(held, F.col("__t"), benchmark, item_col, item_text_col)
    return found.filter(~contaminated(F.col("n_hit"), F.col("n_words"))).select("__kept.*")
