"""Quality rules with thresholds that follow the data: mergeable quantile sketches per language and source.

The sketch of a feature in a group is a histogram over integer bins that are exact below 64 and from
there on 32 to each power of two, so a quantile is known to within 1/32 of its value. A bin's count
is a sum: sketches of parts merge by adding, in any order, to the same sketch, so results do not
depend on how the table is split, and Spark's partial aggregates are the merge. A group has at most
some 2,000 bins whatever it holds, so a group with a third of all rows costs no more than others.

A document fails a feature if it lies beyond its group's fence. For a feature that every text has, a
fence is a quantile plus some times its distance from the median, on both sides; quantiles are
interpolated within a bin, so this distance is never zero. Of a feature that most texts have none of,
such quantiles are all zero and tell nothing, so its fence is some times the share of the group's
texts that have any, times a quantile among those: the rarer and smaller it is in the group, the less
is let through. No fence has a floor or a cutoff of its own. Sketches hold the documents that pass the
base rules. A group's sketch is mixed with its language's as if MIN_GROUP documents of that were
added, and the language's with that of all, so fences change gradually with a group's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .bytetext import BYTE_HASH, NONSPACE, STEP, U64, Slice, byte_set, mix, segment_sums, text_slices
from .store import col, fresh, once

#: [#*$%&|<>]
SYMBOLS = byte_set(*((ord(c), ord(c)) for c in "#*$%&|<>"))
NOT_CONTINUED = ~byte_set((0x80, 0xBF))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
COUNTS_TYPE = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">"

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: What the next coarser sketch weighs beside a group's own, in documents.
MIN_GROUP = 30
#: Of each feature: "share" if most texts have none of it, with a quantile of the texts that have any, else "spread", with the quantile that fences start from (the low one from its mirror image).
FEATURES = {"symbols_pm": ("share", 0.25), "dup_lines_pm": ("share", 0.9), "repeat_pm": ("share", 0.9), "word_len_10": ("spread", 0.8)}
#: How many times the distance from the median lies between a quantile and its fence, or the usual amount below the fence.
SPREADS = 6
#: The least that a text can have of a feature, which fails no text by itself: a symbol, a line again, three words again.
ONCE = {"symbols_pm": ("n_symbols", 1), "dup_lines_pm": ("n_dup_lines", 1), "repeat_pm": ("n_repeat_words", 6)}
#: Groups whose fences fit this number are broadcast; beyond it the join shuffles, and skewed keys are split.
BROADCAST_GROUPS = 100_000


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of keys that occur twice or more, and of those that are not the only or first of their kind."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    twice, later = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def slice_counts(part: Slice) -> dict[str, np.ndarray]:
    """COUNTS of each text of a slice."""
    offs, buf = part.offs, part.buf
    inside = NONSPACE[buf]
    starts, ends, bounds = part.flag_runs(inside)
    sums = part.prefix_hash(BYTE_HASH)
    words = part.hash_spans(sums, starts, ends)
    n_words = np.diff(bounds)
    doc_of_word = np.repeat(np.arange(part.n), n_words)
    salt = mix(np.arange(1, part.n + 1, dtype=np.uint64))

    n = len(words)
    repeated = np.zeros(n + 3, dtype=bool)
    if n >= 3:
        full = np.repeat(bounds[1:], n_words)[: n - 2] - np.arange(n - 2) >= 3
        at = np.flatnonzero(full)
        key = mix((words[at] * U64(STEP) + words[at + 1]) * U64(STEP) + words[at + 2]) ^ salt[doc_of_word[at]]
        at = at[_repeats(key)[0]]
        for k in range(3):
            repeated[at + k] = True

    breaks = np.flatnonzero(buf == 0x0A)
    line_starts = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    line_ends = np.sort(np.concatenate([offs[1:], breaks]), kind="stable")
    doc_of_line = np.repeat(np.arange(part.n), 1 + np.searchsorted(breaks, offs[1:]) - np.searchsorted(breaks, offs[:-1]))
    filled = np.concatenate([[0], np.cumsum(inside)])
    worded = filled[line_ends] > filled[line_starts]
    line_starts, line_ends, doc_of_line = line_starts[worded], line_ends[worded], doc_of_line[worded]
    later = _repeats(part.hash_spans(sums, line_starts, line_ends) ^ salt[doc_of_line])[1]
    return {
        "n_words": n_words,
        "word_chars": segment_sums(inside & NOT_CONTINUED[buf], offs),
        "n_symbols": segment_sums(SYMBOLS[buf], offs),
        "n_dup_lines": np.bincount(doc_of_line[later], minlength=part.n),
        "n_repeat_words": segment_sums(repeated[:n], bounds),
        "n_lines": np.bincount(doc_of_line, minlength=part.n),
    }


def text_counts() -> F.udf:
    """A function of a text column that gives COUNTS; null and empty texts have none of anything.

    See ``store.once``: a filter on what it gives does not run it again.
    """

    @F.arrow_udf(COUNTS_TYPE)
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            parts = [slice_counts(x) for x in text_slices(batch)]
            columns = [np.concatenate([p[c] for p in parts] or [np.zeros(0)]).astype(np.int64) for c in COUNTS]
            yield pa.StructArray.from_arrays([pa.array(x) for x in columns], list(COUNTS))

    return once(count)


def _ratio(part: str, whole: str, times: int) -> Column:
    return F.expr(f"CASE WHEN {whole} > 0 THEN {times} * {part} DIV {whole} ELSE 0 END")


def with_features(counted: DataFrame) -> DataFrame:
    """Integer features: symbols per 1000 word characters, later copies per 1000 lines, repeated words per 1000, ten times the mean word length."""
    return counted.withColumns(
        {"symbols_pm": _ratio("n_symbols", "word_chars", 1000), "dup_lines_pm": _ratio("n_dup_lines", "n_lines", 1000), "repeat_pm": _ratio("n_repeat_words", "n_words", 1000), "word_len_10": _ratio("word_chars", "n_words", 10)}
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def sketch_bin(value: str) -> Column:
    """The bin of a non-negative integer: itself below 64, then 32 bins to each power of two."""
    shift = f"(length(bin({value})) - 6)"
    return F.expr(f"CASE WHEN {value} < 64 THEN CAST({value} AS BIGINT) ELSE 32L * {shift} + shiftright(CAST({value} AS BIGINT), {shift}) END")


def bin_floor(b: str) -> Column:
    """The least value of a bin."""
    return F.expr(f"CASE WHEN {b} < 64 THEN {b} ELSE shiftleft(32L + {b} % 32, CAST({b} DIV 32 - 1 AS INT)) END")


def bin_width(b: str) -> Column:
    """How many integers a bin holds."""
    return F.expr(f"CASE WHEN {b} < 64 THEN 1L ELSE shiftleft(1L, CAST({b} DIV 32 - 1 AS INT)) END")


def sketches(featured: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, feature, bin, n): the sketch of every feature in every group, one row per bin in use."""
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), sketch_bin(f).alias("bin")) for f in FEATURES))
    return featured.select(*keys, F.explode(pairs).alias("p")).groupBy(*keys, "p.feature", "p.bin").agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser groups, by adding counts."""
    return sketch.groupBy(*keys, "feature", "bin").agg(F.sum("n").alias("n"))


def shrunk(sketch: DataFrame, keys: list[str], prior: DataFrame, on: list[str]) -> DataFrame:
    """The sketch of every group with the coarser group's (of the keys ``on``) added as MIN_GROUP documents.

    Counts are multiplied by the coarser group's size, so they stay integers and the sums exact.
    """
    exact = F.col("n").cast("decimal(38,0)")
    theirs = prior.withColumn("total", F.sum(exact).over(Window.partitionBy(*on, "feature"))).withColumnsRenamed({k: f"p_{k}" for k in on})
    meets = F.lit(True)
    for k in on:
        meets &= F.col(k).eqNullSafe(F.col(f"p_{k}"))
    # every group has every feature
    asked = sketch.select(*keys, F.col("feature").alias("p_feature")).distinct()
    added = asked.join(theirs, meets & F.expr("feature = p_feature")).select(*keys, "feature", "bin", (MIN_GROUP * exact).cast("decimal(38,0)").alias("n"))
    totals = theirs.select(*(f"p_{k}" for k in on), F.col("feature").alias("p_feature"), "total").distinct()
    own = sketch.join(totals, meets & F.expr("feature = p_feature")).select(*keys, "feature", "bin", (exact * F.col("total")).cast("decimal(38,0)").alias("n"))
    return merge(own.unionByName(added), keys)


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, low_<feature>, high_<feature>) from sketches; a side on which no document fails is null."""
    running = Window.partitionBy(*keys, "feature").orderBy("bin")
    whole = Window.partitionBy(*keys, "feature")
    zeros = F.sum(F.when(F.col("bin") == 0, F.col("n")).otherwise(F.lit(0))).over(whole)
    ranked = sketch.withColumn("upto", F.sum("n").over(running)).withColumn("size", F.sum("n").over(whole)).withColumn("zeros", zeros)

    def quantile(name: str, share: float, skip: Column) -> Column:
        """The value with such a share of the rows beyond the first ``skip`` below it, as if a bin's rows were spread evenly over it."""
        per_mille = round(1000 * share)
        wanted = per_mille * (F.col("size") - skip)
        # counts are integers, so the bin is exact
        here = (F.col("feature") == name) & (1000 * (F.col("upto") - skip) >= wanted) & (F.col("upto") > skip)
        within = (wanted - 1000 * (F.col("upto") - F.col("n") - skip)).cast("double") / (1000 * F.col("n")).cast("double")
        return F.min_by(bin_floor("bin") + bin_width("bin") * within, F.when(here, F.col("bin")))

    some = (F.col("size") - F.col("zeros")).cast("double") / F.col("size").cast("double")
    known, sides = [], []
    for name, (kind, q) in FEATURES.items():
        if kind == "share":
            known += [F.max(F.when(F.col("feature") == name, some)).alias(f"some_{name}"), quantile(name, q, F.col("zeros")).alias(f"of_{name}")]
            low, high = "CAST(NULL AS DOUBLE)", f"{SPREADS} * some_{name} * of_{name}"
        else:
            known += [quantile(name, x, F.lit(0)).alias(f"{side}_{name}") for side, x in (("lo", 1 - q), ("mid", 0.5), ("hi", q))]
            low, high = f"lo_{name} - {SPREADS} * (mid_{name} - lo_{name})", f"hi_{name} + {SPREADS} * (hi_{name} - mid_{name})"
        sides += [F.expr(low).alias(f"low_{name}"), F.expr(high).alias(f"high_{name}")]
    return ranked.groupBy(*keys).agg(*known).select(*keys, *sides)


def group_fences(featured: DataFrame, scratch) -> DataFrame:
    """The fences of each (lang, source), from its sketch mixed with its language's and that of all."""
    own = scratch.write(sketches(featured.filter(~base_failed()), ["lang", "source"]), "sketches")
    by_lang = merge(own, ["lang"])
    by_lang = shrunk(by_lang, ["lang"], merge(own, []), [])
    return fences(shrunk(own, ["lang", "source"], by_lang, ["lang"]), ["lang", "source"])


def within_fences() -> Column:
    ok = F.lit(True)
    for name in FEATURES:
        count, once = ONCE.get(name, ("n_words", 0))
        for side, fails in (("low", F.col(name) < F.col(f"low_{name}")), ("high", (F.col(name) > F.col(f"high_{name}")) & (F.col(count) > once))):
            ok &= ~F.coalesce(fails, F.lit(False))
    return ok


def judged(counted: DataFrame, limits: DataFrame, n_groups: int) -> DataFrame:
    """``counted`` (COUNTS, lang, source) with base_failed and kept, by the fences of each row's group."""
    featured = with_features(counted)
    limits = limits.withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    limits = F.broadcast(limits) if n_groups <= BROADCAST_GROUPS else limits
    met = featured.join(limits, featured["lang"].eqNullSafe(limits["g_lang"]) & featured["source"].eqNullSafe(limits["g_source"]), "left")
    return met.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & within_fences())


def quality_verdicts(docs: DataFrame, scratch, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: id, COUNTS, base_failed, kept.

    A null text has no words and fails the base rule. Null languages and sources are groups of their
    own. Repeated rows are judged, and counted in the sketches, each by itself. The counts are
    written to ``scratch`` once; sketches and verdicts read them from there.
    """
    counted = docs.select(col(id_col).alias("id"), col(lang_col).cast("string").alias("lang"), col(source_col).cast("string").alias("source"), text_counts()(col(text_col)).alias("c"))
    counted = scratch.write(counted.select("id", "lang", "source", "c.*"), "counts")
    limits = scratch.write(group_fences(with_features(counted), scratch), "fences")
    made = judged(counted, limits, limits.count())
    return made.select(F.col("id").alias(id_col), *COUNTS[:-1], "base_failed", "kept")


def keep_good(docs: DataFrame, scratch, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged.

    The texts are counted twice, once for the sketches and once beside the rows, so that no text is shuffled.
    """
    count = text_counts()
    counted = docs.select(col(lang_col).cast("string").alias("lang"), col(source_col).cast("string").alias("source"), count(col(text_col)).alias("c"))
    limits = scratch.write(group_fences(with_features(counted.select("lang", "source", "c.*")), scratch), "fences")
    row = fresh(docs, "row")
    held = docs.select(F.struct(*(col(c) for c in docs.columns)).alias(row), col(lang_col).cast("string").alias("lang"), col(source_col).cast("string").alias("source"), count(col(text_col)).alias("c"))
    good = judged(held.select(row, "lang", "source", "c.*"), limits, limits.count()).filter("kept")
    return good.select(f"{row}.*")
