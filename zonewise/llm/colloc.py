"""Phrase collocations, mined from vertical positional lists.

The tokens of a language are dealt to shards, bounded blocks of texts with positions of their own. A
shard holds, for each word, the ascending list of its positions; positions leave a gap where a piece
ends. Phrases grow by a word in each pass: a longer phrase is two frequent ones that start one
position apart, so the positions of frequent phrases are merge-joined with themselves, and the length
of what is left is the new phrase's exact count in the shard. Counts of all shards are summed, and
only phrases that are frequent in the whole language are extended, within each shard, in the next pass.

Frequent words and phrases have numbers, the more frequent the lower, so that they and the steps of
their lists pack well. Shards send their pairs in buckets by hash, sorted and packed, and find them
again in the next pass by the same hash; as a bucket holds a bounded number of pairs, and a shard has
a pair once, no task grows with the corpus or with a frequent phrase. No occurrence leaves its shard.

Words are runs of anything but spaces and tabs within pieces, which end at .,;:!? and line ends; A-Z
are lower-cased. Null texts are empty and null languages are ``und``. Repeated rows count as often as
they occur, empty texts and tables have no phrases, and other columns are not read. A text is never
cut: a very long one makes a long shard.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import mix
from .store import Scratch, col

MIN_COUNT, MAX_WORDS, TOP = 30, 4, 2000
#: A phrase goes if a longer one around it has at least this share of its occurrences, in per cent.
COVERED = 80
#: Tokens of one language in a shard, and of all languages that a task holds back for shards.
SHARD_TOKENS, HELD_TOKENS = 1 << 19, 1 << 21
#: Numbered words and phrases go to every task up to so many; beyond, joins are shuffled.
BROADCAST_PHRASES = 200_000
#: Pieces of what is joined by a phrase's part, as many phrases share their first word; and of a language's ranking.
SALTS, RANK_PARTS = 16, 64
#: Rows from which a key of a join counts as hot.
HOT_ROWS = 1 << 16
_LOWER = bytes(range(256)).lower()
_PIECES = bytes(10 if c in b".,;:!?\n\v\f\r" else c for c in _LOWER)
#: Pairs that are counted together in a bucket, about.
BUCKET_PAIRS = 1 << 20
SHARD = "lang string, names array<binary>, n array<int>, at binary"
#: What a pass makes of a shard: a row (bucket is null) with the lists of its frequent phrases, and rows with the pairs of
#: phrases that start one position apart, by bucket; all but the numbers are packed.
PASSED = "shard bigint, bucket bigint, ids binary, n binary, at binary, heads binary, tails binary"
#: Of a bucket: a row with its frequent pairs, their numbers and counts, and rows with those that each shard (of) has, by their
#: places (j) among the pairs that it sent to the bucket.
COUNTED = "of bigint, bucket bigint, j binary, ids binary, found array<struct<head: bigint, tail: bigint, id: bigint, a: bigint>>"


def tokens_of(text: bytes) -> list[bytes | None]:
    """A text's words, with None after each piece."""
    tokens: list[bytes | None] = []
    for piece in text.translate(_PIECES).split(b"\n"):
        words = piece.split()
        if words:
            tokens += words
            tokens.append(None)
    return tokens


class _Buffer:
    """Tokens of a language that wait to become a shard."""

    def __init__(self) -> None:
        self.index: defaultdict[bytes | None, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.index[None]
        self.ids = array("I")

    def lists(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(words, list lengths, positions): long lists first, and positions ascending within each."""
        ids = np.frombuffer(self.ids, dtype=np.uint32)
        n = np.bincount(ids, minlength=len(self.index))
        order = np.append(0, 1 + np.argsort(-n[1:], kind="stable"))
        place = np.empty(len(n), dtype=np.uint32)
        place[order] = np.arange(len(n))
        words = list(self.index)
        return [words[k] for k in order[1:].tolist()], n[order[1:]], np.argsort(place[ids], kind="stable")[n[0] :]


def _pack(values: np.ndarray, steps: bool = True) -> bytes:
    """Integers as compressed byte planes, of their differences or of themselves, after how many they are and which of both."""
    packed = values.astype(np.int64)
    if steps:
        step = np.diff(packed, prepend=np.int64(0))
        # the sign goes last, or small steps back would fill all planes
        packed = (step << 1) ^ (step >> 63)
    planes = np.ascontiguousarray(packed.view(np.uint8).reshape(-1, 8).T)
    return (2 * len(values) + steps).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    size, steps = divmod(int.from_bytes(data[:8], "little"), 2)
    if not size:
        return np.zeros(0, dtype=np.int64)
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * size, codec="zstd", asbytes=True), dtype=np.uint8)
    packed = np.ascontiguousarray(planes.reshape(8, size).T).view(np.uint64).ravel()
    return np.cumsum((packed >> np.uint64(1)).view(np.int64) ^ -(packed & np.uint64(1)).view(np.int64)) if steps else packed.view(np.int64)


def _unpacked(table: pa.Table, name: str) -> np.ndarray:
    """The packed integers of all rows of a column, one after the other."""
    parts = [_unpack(x.as_py()) for x in table.column(name)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (of, j, id) as (of, j, ids), packed for each run of equal ``of`` in a batch."""
    for batch in batches:
        of, j, ids = (batch.column(c).to_numpy() for c in ("of", "j", "id"))
        cuts = np.flatnonzero(np.diff(of)) + 1
        runs = list(zip(np.split(j, cuts), np.split(ids, cuts), strict=True)) if len(of) else []
        yield pa.RecordBatch.from_arrays([pa.array(of[np.append(0, cuts)] if len(of) else of, pa.int64()), *(pa.array([_pack(r[k]) for r in runs], pa.binary()) for k in range(2))], ["of", "j", "ids"])


def _to_shards(shard_tokens: int, held_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts (lang, text) as shards."""

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, _Buffer] = {}
        held = 0

        def made(lang: str) -> pa.RecordBatch:
            words, n, at = waiting.pop(lang).lists()
            names = pa.array([words], pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([lang]), names, pa.array([n.astype(np.int32)], pa.list_(pa.int32())), pa.array([_pack(at)], pa.binary())], ["lang", "names", "n", "at"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                buffer = waiting.setdefault(lang, _Buffer())
                before = len(buffer.ids)
                buffer.ids.extend(map(buffer.index.__getitem__, tokens_of(text.as_py() or b"")))
                held += len(buffer.ids) - before
                if len(buffer.ids) >= shard_tokens or held >= held_tokens:
                    most = max(waiting, key=lambda k: len(waiting[k].ids))
                    held -= len(waiting[most].ids)
                    yield made(most)
        for lang in [*waiting]:
            if len(waiting[lang].ids):
                yield made(lang)

    return to_shards


def _among(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where ascending ``wanted`` meets ascending ``sorted_values``: its place there, -1 where it is not."""
    if not len(sorted_values):
        return np.full(len(wanted), -1)
    place = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return np.where(sorted_values[place] == wanted, place, -1)


_PASSED_ARROW = pa.schema([("shard", pa.int64()), ("bucket", pa.int64()), *((name, pa.binary()) for name in ("ids", "n", "at", "heads", "tails"))])


class _Lists:
    """Phrases by ascending number, each with the length of its list, and the positions of all, ascending within a list."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, at: np.ndarray) -> None:
        self.ids, self.n, self.at = ids, n, at

    def by_position(self) -> tuple[np.ndarray, np.ndarray]:
        """All positions, ascending, and the phrase of each."""
        order = np.argsort(self.at, kind="stable")
        return self.at[order], np.repeat(np.arange(len(self.n)), self.n)[order]

    def chosen(self, which: np.ndarray, ids: np.ndarray) -> _Lists:
        """Some of the phrases under new numbers."""
        which, ids = which[np.argsort(ids)], np.sort(ids)
        ends = np.cumsum(self.n)
        n = self.n[which]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[which] - n, n)
        return _Lists(ids, n, self.at[place])


def _followed(phrases: _Lists) -> tuple[_Lists, np.ndarray, np.ndarray]:
    """Lists of the phrases with one word more, numbered from 0 by (head, tail), and the places of each one's head and tail.

    A longer phrase is a head and a tail of equal size that starts one position on.
    """
    starts, phrase = phrases.by_position()
    follows = _among(starts, starts + 1)
    met = follows >= 0
    width = max(1, len(phrases.n))
    starts, pair = starts[met], phrase[met] * width + phrase[follows[met]]
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    return _Lists(np.arange(len(first)), np.diff(np.append(first, len(pair))), starts[order]), pair[first] // width, pair[first] % width


def _dealt(heads: np.ndarray, tails: np.ndarray, buckets: int) -> dict[int, np.ndarray]:
    """Where the pairs of each bucket are, ascending."""
    bucket = (mix(mix(heads.view(np.uint64)) + tails.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
    return {int(bucket[part[0]]): part for part in parts}


def passed(size: int, last: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The pass that makes, of a shard's lists of phrases of size - 1 words and what is known to be frequent of those of ``size``, these one's lists and the pairs that are next to be counted."""

    def step(shard: pa.Table, frequent: pa.Table) -> pa.Table:
        if not shard.num_rows or not frequent.num_rows:
            return _PASSED_ARROW.empty_table()
        number = shard.column("shard")[0].as_py()
        if size == 1:
            every = shard.column("n").combine_chunks().flatten().to_numpy().astype(np.int64)
            found, which = _Lists(np.arange(len(every)), every, _unpacked(shard, "at")), _unpacked(frequent, "j")
        else:
            before = _Lists(*(_unpacked(shard, name) for name in ("ids", "n", "at")))
            found, head, tail = _followed(before)
            sent = _dealt(before.ids[head], before.ids[tail], buckets)
            which = np.concatenate([sent[b][_unpack(j)] for b, j in zip(frequent.column("bucket").to_pylist(), frequent.column("j").to_pylist(), strict=True)])
        phrases = found.chosen(which, _unpacked(frequent, "ids"))
        rows = [] if size == last else [[number, None, _pack(phrases.ids), _pack(phrases.n, steps=False), _pack(phrases.at), None, None]]
        pairs, head, tail = _followed(phrases)
        heads, tails = phrases.ids[head], phrases.ids[tail]
        for bucket, part in _dealt(heads, tails, buckets).items():
            rows.append([number, bucket, None, _pack(pairs.n[part], steps=False), None, _pack(heads[part]), _pack(tails[part], steps=False)])
        if not rows:
            return _PASSED_ARROW.empty_table()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PASSED_ARROW.types, strict=True)], schema=_PASSED_ARROW)

    return step


_COUNTED_ARROW = pa.schema([("of", pa.int64()), ("bucket", pa.int64()), ("j", pa.binary()), ("ids", pa.binary()), ("found", pa.list_(pa.struct([(n, pa.int64()) for n in ("head", "tail", "id", "a")])))])


def counted(least: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    """The sums of a bucket's pairs over shards, numbered where they are frequent."""

    def count(bucket: pa.Table) -> pa.Table:
        number = bucket.column("bucket")[0].as_py()
        parts = [[_unpack(x.as_py()) for x in bucket.column(name)] for name in ("heads", "tails", "n")]
        heads, tails, n = (np.concatenate(p) for p in parts)
        row = np.repeat(np.arange(bucket.num_rows), [len(p) for p in parts[0]])
        j = np.concatenate([np.arange(len(p)) for p in parts[0]])
        order = np.lexsort((tails, heads))
        heads, tails = heads[order], tails[order]
        new = np.append(True, (heads[1:] != heads[:-1]) | (tails[1:] != tails[:-1]))
        first = np.flatnonzero(new)
        total = np.add.reduceat(n[order], first)
        frequent = total >= least
        # of the pair's rank in the bucket and the bucket, so frequent pairs of all buckets have low numbers
        ids = np.zeros(len(total), dtype=np.int64)
        ids[np.flatnonzero(frequent)[np.argsort(-total[frequent], kind="stable")]] = np.arange(frequent.sum()) * buckets + number
        found = [{"head": h, "tail": t, "id": i, "a": a} for h, t, i, a in zip(*(x[frequent].tolist() for x in (heads[first], tails[first], ids, total)), strict=True)]
        group = np.cumsum(new) - 1
        stays = frequent[group]
        row, j, of_pair = row[order][stays], j[order][stays], ids[group][stays]
        back = np.argsort(row, kind="stable")
        shares = np.split(back, np.cumsum(np.bincount(row, minlength=bucket.num_rows))[:-1])
        shards = bucket.column("shard").to_pylist()
        rows = [(s, number, _pack(j[share]), _pack(of_pair[share], steps=False), None) for s, share in zip(shards, shares, strict=True) if len(share)] + [(None, None, None, None, found)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _COUNTED_ARROW.types, strict=True)], schema=_COUNTED_ARROW)

    return count


class Collocations:
    """Counts of frequent phrases per language, and the collocations among them, of all ``docs``."""

    def __init__(self, docs: DataFrame, scratch: Scratch, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, covered: int = COVERED) -> None:
        if min_count < 1 or max_words < 2 or top < 1:
            raise ValueError("counts and sizes are positive, and a phrase has two words")
        self.scratch, self.min_count, self.max_words, self.top, self.covered = scratch, min_count, max_words, top, covered
        texts = docs.select(F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"), col(text_col).cast("binary").alias("text"))
        # a written table: the shards' numbers stay as they are
        shards = scratch.write(texts.mapInArrow(_to_shards(SHARD_TOKENS, HELD_TOKENS), SHARD).withColumn("shard", F.monotonically_increasing_id()), "lists-1", "zstd")
        self.totals = scratch.write(shards.select("lang", F.aggregate("n", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        words, kept = self._frequent_words(shards)
        # the shuffles that counted and joined the words go before the first pass
        scratch.release()
        #: Frequent phrases (lang, id, phrase, a, size) of one word up to max_words.
        self.phrases = level = words
        self.buckets = 1 + (self.totals.agg(F.sum("n").alias("n")).first().n or 0) // (2 * BUCKET_PAIRS)
        state = shards.select("shard", "n", "at")
        for size in range(1, max_words):
            step = passed(size, max_words - 1, self.buckets)
            made = state.groupBy("shard").cogroup(kept.groupBy("of")).applyInArrow(step, PASSED)
            kind = F.when(F.col("bucket").isNull(), "lists").otherwise("pairs")
            made = scratch.write(made.withColumn("kind", kind), f"lists-{size + 1}", by="kind")
            # what made the lists goes before their pairs are shuffled, and the pairs before the next lists are made
            scratch.drop(f"lists-{size}")
            scratch.release()
            state = made.filter("kind = 'lists'").select("shard", "ids", "n", "at")
            found, kept = self._frequent_pairs(made.filter("kind = 'pairs'").select("bucket", "shard", "heads", "tails", "n"), size + 1)
            scratch.drop(f"lists-{size + 1}/kind=pairs")
            level = scratch.write(self._texts(found, level, size + 1), f"phrases-{size + 1}")
            self.phrases = self.phrases.unionByName(level)
            scratch.release()
        scratch.drop(f"lists-{max_words}")

    def _frequent_words(self, shards: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Frequent words with numbers, and where shards have them (of, j, ids)."""
        local = shards.select("lang", F.inline(F.arrays_zip("names", "n"))).withColumnRenamed("names", "word")
        counts = local.groupBy("lang", "word").agg(F.sum("n").alias("a")).filter(F.col("a") >= self.min_count)
        # numbers ascend as counts fall
        found = self.scratch.write(counts.orderBy("lang", F.desc("a")).withColumn("id", F.monotonically_increasing_id()), "phrases-1")
        here = shards.select(F.col("shard").alias("of"), "lang", F.posexplode("names").alias("j", "word"))
        # a word has one row in a shard, so no key of this join holds many of its rows
        few = found.count() <= BROADCAST_PHRASES
        kept = here.join((F.broadcast(found) if few else found).drop("a"), ["lang", "word"]).select("of", "j", "id")
        # a broadcast join leaves a shard's rows together, in the order of j
        kept = (kept if few else kept.sortWithinPartitions("of", "j")).mapInArrow(_packed_rows, "of bigint, j binary, ids binary")
        # a shuffled join's rows are larger than the lists, so they go before these are shuffled too
        kept = kept if few else self.scratch.write(kept, "words-of-shards")
        return found.select("lang", "id", F.col("word").cast("string").alias("phrase"), "a", F.lit(1).alias("size")), kept

    def _frequent_pairs(self, dealt: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
        """Frequent pairs (head, tail, id, a) over all shards, and where shards have them (of, bucket, j, ids)."""
        made = self.scratch.write(dealt.groupBy("bucket").applyInArrow(counted(self.min_count, self.buckets), COUNTED), f"counted-{size}")
        return made.filter("of IS NULL").select(F.inline("found")), made.filter("of IS NOT NULL").select("of", "bucket", "j", "ids")

    def _texts(self, found: DataFrame, parts: DataFrame, size: int) -> DataFrame:
        """Phrases of found pairs: the head's words and the tail's last."""
        named = parts.select("lang", F.col("id").alias("head"), F.col("phrase").alias("head_text"))
        tails = parts.select(F.col("id").alias("tail"), F.substring_index("phrase", " ", -1).alias("tail_text"))
        met = self._joined(self._joined(found, named, ["head"], "tail"), tails, ["tail"], "head")
        return met.select("lang", "id", F.concat_ws(" ", "head_text", "tail_text").alias("phrase"), "a", F.lit(size).alias("size"))

    def _joined(self, many: DataFrame, one: DataFrame, keys: list[str], deal_by: str) -> DataFrame:
        """``many`` with the row of ``one``, of which there is one a key.

        Keys of more than HOT_ROWS rows, of which there can be only so many, are dealt in SALTS pieces by
        another column, and their row of ``one`` is repeated; no other is.
        """
        if one.count() <= BROADCAST_PHRASES:
            return many.join(F.broadcast(one), keys)
        hot = F.broadcast(many.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > HOT_ROWS))
        piece = F.when(F.col("__n").isNull(), 0).otherwise(F.pmod(F.xxhash64(deal_by), F.lit(SALTS)).cast("int"))
        pieces = F.when(F.col("__n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        dealt = many.join(hot, keys, "left").withColumn("__salt", piece).drop("__n")
        return dealt.join(one.join(hot, keys, "left").withColumn("__salt", F.explode(pieces)).drop("__n"), [*keys, "__salt"]).drop("__salt")

    def _with_part(self, cuts: DataFrame, part: str, name: str) -> DataFrame:
        """``cuts`` with the count of the phrase in column ``part`` as ``name``; parts of frequent phrases are frequent."""
        known = self.phrases.filter(F.col("size") < self.max_words).select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
        return self._joined(cuts, known, ["lang", part], "phrase")

    def scored(self) -> DataFrame:
        """Phrases of two words and more with their lowest-scoring cut: (lang, phrase, words, a, l, r, score)."""
        several = self.phrases.filter("size > 1").withColumn("words", F.split("phrase", " "))
        cuts = several.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
        cuts = cuts.withColumn("head", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ")).withColumn("tail", F.array_join(F.slice("words", F.col("cut") + 1, F.col("size")), " "))
        cuts = self._with_part(self._with_part(cuts, "head", "l"), "tail", "r")
        # decimals: the product may pass 64 bits
        score = F.expr("(cast(2000000 as decimal(38,0)) * a) div (cast(l as decimal(38,0)) + r)")
        best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
        return best.select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")

    def uncovered(self, scored: DataFrame) -> DataFrame:
        """Those that no longer frequent phrase around them has nearly as often, whether that one stays or not."""
        longer = scored.filter(F.size("words") > 2)
        lengths = F.sequence(F.lit(2), F.size("words") - 1)
        spans = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
        inner = longer.select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
        covered = F.lit(100).cast("decimal(38,0)") * F.col("around") >= F.lit(self.covered).cast("decimal(38,0)") * F.col("a")
        return scored.join(inner, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False))).drop("around")

    def best(self) -> DataFrame:
        """Each language's first phrases by score, count and bytes: (lang, rank, phrase, a, l, r, n, score).

        Ranked on two levels: a language's phrases are dealt to parts, and only a part's best go on.
        """
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        left = self.uncovered(self.scratch.write(self.scored(), "scored")).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
        first = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= self.top)
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= self.top)
        return ranked.join(self.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
