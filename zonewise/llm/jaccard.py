"""Near-duplicate join by Jaccard similarity of word shingles, with a MinHash LSH forest.

Texts with the same words in the same order make a class; all that follows is between classes. Each
tree of the forest is a prefix trie of the classes' signatures, MAX_DEPTH values deep; a trie node is
a prefix in a tree, and its members are the classes whose signatures begin with it. Every class
starts with the full depth in all trees, and shortens its matched prefixes one value at a time until
the chance to meet a text of the threshold's similarity in some tree reaches the target recall. It
shortens where that adds fewest candidates: nodes with few members first and as far as MIN_DEPTH,
crowded ones (of a passage that many texts share, say) last and only as far as the recall still asks.
Two classes are candidates if in some tree their common prefix is as long as either one's prefix.

A node with few classes gives its pairs, which are verified on the whole shingle sets. Classes that
large nodes connect make a hot group, whose pairs are compared in blocks: prefixes tell candidates,
matrix products verify them. Blocks give counts and a spanning forest of the links, never the pairs,
and no task holds more than two blocks. Which pairs are candidates does not depend on the nodes'
sizes but through the prefixes, and each is verified once, in a small node or in a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import ALNUM, BYTE_HASH_FOLDED, LOWER, STEP, U64, Slice, mix, owner, random_words, text_slices, window_hashes
from .components import components
from .store import Scratch, col, fresh, once

SHINGLE = 5
#: The threshold as a fraction, so that it is tested in integers.
SIMILAR, OF = 4, 5
TREES, MIN_DEPTH, MAX_DEPTH, RECALL = 20, 4, 8, 0.999
#: Classes up to which shortening to a node costs nothing worth ranking: a text's own near copies must not decide its prefixes.
CROWD = 32
#: Classes in a trie node from which on it is large, and in a block of a hot group.
SMALL_NODE, BLOCK = 32, 512
#: Shingles in a block on average, if its classes have many: a task holds two blocks, 8 bytes a shingle, and some copies of them.
BLOCK_SHINGLES = 1 << 17
#: A value of a signature takes two bytes.
VALUE = np.dtype("<u2")
#: Shingles in one matrix product.
PRODUCT_COLUMNS = 4096
#: Rows up to which a table of class hashes is broadcast (16 bytes each); its rows are counted first.
BROADCAST_ROWS = 500_000


def shortened(sizes: np.ndarray) -> np.ndarray:
    """Of each class and tree the length of its prefix, (classes, TREES).

    sizes: (classes, TREES, MAX_DEPTH - MIN_DEPTH + 1), the members of the class's nodes from MIN_DEPTH on.
    """
    rows = np.arange(len(sizes))
    depth = np.full(sizes.shape[:2], MAX_DEPTH)
    cost = np.maximum(sizes, CROWD).astype(np.float64)
    chance = np.log1p(-((SIMILAR / OF) ** np.arange(MAX_DEPTH + 1, dtype=np.float64)), where=np.arange(MAX_DEPTH + 1) > 0, out=np.zeros(MAX_DEPTH + 1))
    while len(rows):
        here = depth[rows]
        # what one value less would bring in; of equals the longest prefix is shortened, then the first tree's
        price = np.take_along_axis(cost[rows], np.maximum(here - 1 - MIN_DEPTH, 0)[:, :, None], axis=2)[:, :, 0] * (MAX_DEPTH + 1) - here
        price[here == MIN_DEPTH] = np.inf
        going = (chance[here].sum(axis=1) > np.log(1 - RECALL)) & np.isfinite(price).any(axis=1)
        rows = rows[going]
        depth[rows, price[going].argmin(axis=1)] -= 1
    return depth


@lru_cache(maxsize=1)
def usual_depths() -> tuple[int, ...]:
    """The prefixes of a class that is in no crowded node."""
    return tuple(shortened(np.ones((1, TREES, MAX_DEPTH - MIN_DEPTH + 1)))[0].tolist())


#: A second hash of a byte; texts are the same if both of their hashes are.
SECOND_HASH = random_words(31, 256)[LOWER]


def shingles_of(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each text with their bounds."""
    starts, ends, bounds = part.runs(ALNUM)
    return window_hashes(part.hash_spans(part.prefix_hash(BYTE_HASH_FOLDED), starts, ends), bounds, SHINGLE)


def class_hash(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each text's sequence of words."""
    counts = np.diff(bounds)
    place = mix((np.arange(len(words)) - np.repeat(bounds[:-1], counts)).astype(np.uint64) * U64(STEP) + U64(1))
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(mix(words ^ place), out=sums[1:])
    return mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ mix(counts.astype(np.uint64)))


def class_hashes(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits that tell each text's sequence of words, as two numbers, and which texts have no words."""
    starts, ends, bounds = part.runs(ALNUM)
    h1, h2 = (class_hash(part.hash_spans(part.prefix_hash(table), starts, ends), bounds).view(np.int64) for table in (BYTE_HASH_FOLDED, SECOND_HASH))
    return h1, h2, np.diff(bounds) == 0


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each text TREES times MAX_DEPTH values, each from the least of its shingles in a fixed random order; texts without shingles get 0."""
    n = len(bounds) - 1
    filled = np.flatnonzero(np.diff(bounds))
    out = np.zeros((n, TREES * MAX_DEPTH), dtype=VALUE)
    if not len(filled):
        return out
    start = bounds[:-1][filled]
    low = (shingles >> U64(32)).astype(np.uint32)
    factor = (random_words(21, TREES * MAX_DEPTH) >> U64(32)).astype(np.uint32) | np.uint32(1)
    shift = (random_words(22, TREES * MAX_DEPTH) >> U64(32)).astype(np.uint32)
    for k in range(TREES * MAX_DEPTH):
        out[filled, k] = np.minimum.reduceat((low ^ shift[k]) * factor[k], start).astype(VALUE)
    return out


def class_function():
    """A function of a text column that gives its class as h1, h2; nulls for texts without words."""

    @F.arrow_udf("struct<h1: bigint, h2: bigint>")
    def same(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            made = [class_hashes(part) for part in text_slices(batch)] or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
            h1, h2, none = (np.concatenate(x) for x in zip(*made, strict=True))
            yield pa.StructArray.from_arrays([pa.array(h1, mask=none), pa.array(h2, mask=none)], ["h1", "h2"])

    return once(same)


def signature_function():
    """A function of a text column that gives its class as h1, h2 and its signature's bytes; nulls for texts without words."""

    @F.arrow_udf("struct<h1: bigint, h2: bigint, sig: binary>")
    def sign(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            columns = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
            sigs: list[bytes | None] = []
            for part in text_slices(batch):
                columns.append(class_hashes(part))
                sigs += [None if none else row.tobytes() for row, none in zip(signatures(*shingles_of(part)), columns[-1][2].tolist(), strict=True)]
            h1, h2, none = (np.concatenate(x) for x in zip(*columns, strict=True))
            yield pa.StructArray.from_arrays([pa.array(h1, mask=none), pa.array(h2, mask=none), pa.array(sigs, pa.binary())], ["h1", "h2", "sig"])

    return sign


def node_of(sig: Column, tree: Column, depth: Column) -> Column:
    """A hash that names the trie node of a signature's prefix in a tree."""
    return F.xxhash64(tree.cast("int"), depth.cast("int"), F.substring(sig, tree * (MAX_DEPTH * VALUE.itemsize) + 1, depth * VALUE.itemsize))


def depths_function():
    """A function from the lists of a class's crowded nodes (tree, depth, size) to the lengths of its prefixes."""

    @F.arrow_udf("array<int>")
    def depths(places: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in places:
            bounds = batch.offsets.to_numpy()
            tree, depth, size = (np.asarray(x)[bounds[0] : bounds[-1]] for x in batch.values.flatten())
            sizes = np.ones((len(batch), TREES, MAX_DEPTH - MIN_DEPTH + 1))
            sizes[owner(bounds), tree, depth - MIN_DEPTH] = size
            made = shortened(sizes)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * TREES, pa.int32()), pa.array(made.ravel(), pa.int32()))

    return depths


def set_function():
    """A function of a text column that gives its distinct shingles."""

    @F.arrow_udf("array<bigint>")
    def sets(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            lists = []
            for part in text_slices(batch):
                shingles, bounds = shingles_of(part)
                order = np.lexsort((shingles, owner(bounds)))
                ranked, row = shingles[order].view(np.int64), owner(bounds)
                new = np.ones(len(ranked), dtype=bool)
                new[1:] = (ranked[1:] != ranked[:-1]) | (row[1:] != row[:-1])
                ranked, at = ranked[new], np.concatenate([[0], np.cumsum(new)])[bounds]
                lists += [ranked[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.array(lists, pa.list_(pa.int64()))

    return sets


def similar(common: Column, a: Column, b: Column) -> Column:
    """common / (a + b - common) >= SIMILAR / OF"""
    return (SIMILAR + OF) * common >= SIMILAR * (a + b)


def _meet(left: DataFrame, small: DataFrame, on: str | list[str], how: str, rows: int) -> DataFrame:
    return left.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def meets(sig_a: np.ndarray, depth_a: np.ndarray, sig_b: np.ndarray, depth_b: np.ndarray) -> np.ndarray:
    """Which pairs are candidates: in some tree their common prefix is as long as the shorter of their two."""
    out = np.zeros((len(sig_a), len(sig_b)), dtype=bool)
    for tree in range(TREES):
        least = np.minimum(depth_a[:, tree, None], depth_b[None, :, tree])
        equal = np.ones_like(out)
        for k in range(MAX_DEPTH):
            equal &= (sig_a[:, tree, k, None] == sig_b[None, :, tree, k]) | (least <= k)
        out |= equal
    return out


def block_links(key: tuple, rows: pa.Table) -> pa.Table:
    """Links between two blocks of a hot group (within one, if they are the same): of each class their number, counting copies, and the least class they connect it to."""
    low, high = key[1].as_py(), key[2].as_py()
    same = rows.column("same").to_numpy()
    copies = rows.column("copies").to_numpy()
    block = rows.column("block").to_numpy()
    sets = rows.column("shingles").combine_chunks()
    bounds = sets.offsets.to_numpy().astype(np.int64)
    kinds, which = np.unique(sets.values.to_numpy()[bounds[0] : bounds[-1]], return_inverse=True)
    bounds -= bounds[0]
    row = owner(bounds)
    # a shingle of one class alone is common to no pair
    shared = np.bincount(which, minlength=len(kinds)) > 1
    column = np.where(shared, np.cumsum(shared) - 1, -1)[which]
    row, column = row[column >= 0], column[column >= 0]
    a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
    common = np.zeros((len(a), len(b)), dtype=np.float32)
    one = np.zeros((len(a), PRODUCT_COLUMNS), dtype=np.float32)
    two = one if low == high else np.zeros((len(b), PRODUCT_COLUMNS), dtype=np.float32)
    place = np.zeros(len(same), dtype=np.int64)
    place[a], place[b] = np.arange(len(a)), np.arange(len(b))
    for first in range(0, int(shared.sum()), PRODUCT_COLUMNS):
        some = (column >= first) & (column < first + PRODUCT_COLUMNS)
        here, at = row[some], column[some] - first
        for table, of in ((one, low), (two, high)):
            table[:] = 0
            mine = block[here] == of
            table[place[here[mine]], at[mine]] = 1
        common += one @ two.T
    size = np.diff(bounds)
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=VALUE).reshape(len(same), TREES, MAX_DEPTH)
    depth = np.stack(rows.column("depths").to_pylist()) if len(same) else np.zeros((0, TREES), dtype=np.int64)
    linked = (SIMILAR + OF) * common.astype(np.int64) >= SIMILAR * (size[a][:, None] + size[b][None, :])
    linked &= meets(sig[a], depth[a], sig[b], depth[b])
    if low == high:
        np.fill_diagonal(linked, False)
    count = np.zeros(len(same), dtype=np.int64)
    count[a] += linked @ copies[b]
    if low != high:
        count[b] += linked.T @ copies[a]
    root = same.copy()
    while True:
        before = root.copy()
        far = np.iinfo(np.int64).max
        root[a] = np.minimum(root[a], np.where(linked, root[b][None, :], far).min(axis=1, initial=far))
        root[b] = np.minimum(root[b], np.where(linked, root[a][:, None], far).min(axis=0, initial=far))
        if (root == before).all():
            break
    has = count > 0
    return pa.table({"same": same[has], "links": count[has], "root": root[has]})


class NearDuplicates:
    """The join's tables in ``scratch``: classes, and of those with links to other classes how many and their group."""

    def __init__(self, docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text"):
        self.docs, self.scratch, self.id_col, self.text_col = docs, scratch, id_col, text_col
        sign = signature_function()
        # the row numbers are fixed by writing them
        signed = docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).alias("id"), sign(col(text_col)).alias("s"))
        signed = scratch.write(signed.select("row", "id", "s.*"), "signed")
        classes = signed.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("row").alias("same"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.any_value("sig").alias("sig"))
        self.classes = scratch.write(classes, "classes")
        self.signed = signed.select("id", "h1", "h2")
        placed = self._placed()
        members = self._members(placed)
        groups = self._hot_groups(members)
        pairs = self._pairs(members, groups)
        sets = self._sets(pairs, groups)
        links = scratch.write(self._verified(pairs, sets), "links")
        in_blocks = scratch.write(self._verified_groups(groups, sets, placed), "blocks") if groups is not None else None
        scratch.drop("sets", "pairs", "members", "placed")
        self._finish(links, in_blocks)

    def _placed(self) -> DataFrame:
        """Rows (same, sig, trees, depths): the classes that share a node of MIN_DEPTH, in which trees, and all their prefixes' lengths."""
        least, tree = F.lit(MIN_DEPTH), F.sequence(F.lit(0), F.lit(TREES - 1))
        places = self.classes.select("same", F.posexplode(F.transform(tree, lambda t: node_of(F.col("sig"), t, least))).alias("tree", "node"))
        nodes = self.scratch.write(places.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "nodes")
        shared = self.scratch.write(_meet(places, nodes, "node", "inner", nodes.count()).select("same", "tree", "size"), "shared")
        trees = shared.groupBy("same").agg(F.collect_list("tree").alias("trees"))
        usual = F.array(*(F.lit(d) for d in usual_depths()))
        crowded = shared.filter(F.col("size") > CROWD)
        placed = self.classes.select("same", "sig").join(trees, "same")
        if crowded.isEmpty():
            return self.scratch.write(placed.withColumn("depths", usual), "placed")
        # members of a deeper node are members of the crowded one above it, so counts of these rows are whole
        deeper = crowded.select("same", "tree", F.explode(F.sequence(F.lit(MIN_DEPTH + 1), F.lit(MAX_DEPTH))).alias("depth")).join(self.classes.select("same", "sig"), "same")
        deeper = self.scratch.write(deeper.select("same", "tree", "depth", node_of(F.col("sig"), F.col("tree"), F.col("depth")).alias("node")), "deeper")
        sizes = self.scratch.write(deeper.groupBy("node").agg(F.count(F.lit(1)).alias("size")), "sizes")
        sized = _meet(deeper, sizes, "node", "inner", sizes.count()).select("same", "tree", "depth", "size")
        sized = sized.union(crowded.select("same", "tree", F.lit(MIN_DEPTH), "size"))
        # at most TREES times a trie's depths for each class
        lists = sized.groupBy("same").agg(F.collect_list(F.struct(F.col("tree").cast("bigint"), F.col("depth").cast("bigint"), F.col("size").cast("bigint"))).alias("places"))
        depths = lists.select("same", depths_function()("places").alias("own"))
        placed = self.scratch.write(placed.join(depths, "same", "left").select("same", "sig", "trees", F.coalesce("own", usual).alias("depths")), "placed")
        self.scratch.drop("nodes", "shared", "deeper", "sizes")
        return placed

    def _members(self, placed: DataFrame) -> DataFrame:
        """Rows (node, same, asks, size, head) of the trie nodes that hold several classes of which some asks, that is, has its prefix end there."""
        each = placed.select("same", "sig", "depths", F.explode("trees").alias("tree")).withColumn("own", F.get("depths", F.col("tree")))
        each = each.select("same", "sig", "tree", "own", F.explode(F.sequence(F.lit(MIN_DEPTH), F.col("own"))).alias("depth"))
        places = each.select("same", node_of(F.col("sig"), F.col("tree"), F.col("depth")).alias("node"), (F.col("depth") == F.col("own")).alias("asks"))
        nodes = places.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("same").alias("head"), F.max("asks").alias("asked")).filter("size > 1 AND asked").drop("asked")
        nodes = self.scratch.write(nodes, "asked")
        members = self.scratch.write(_meet(places, nodes, "node", "inner", nodes.count()), "members")
        self.scratch.drop("asked")
        return members

    def _hot_groups(self, members: DataFrame) -> DataFrame | None:
        """Rows (same, hot): the classes that large nodes connect."""
        edges = members.filter(F.col("size") > SMALL_NODE).select(F.col("same").alias("u"), F.col("head").alias("v"))
        if edges.isEmpty():
            return None
        return components(edges, self.scratch, "hot").select(F.col("node").alias("same"), F.col("root").alias("hot"))

    def _pairs(self, members: DataFrame, groups: DataFrame | None) -> DataFrame:
        """Candidate pairs (a, b) of small nodes that are not in one hot group."""
        small = members.filter(F.col("size") <= SMALL_NODE).select("node", "same", "asks")
        small = _meet(small, groups, "same", "left", groups.count()) if groups is not None else small.withColumn("hot", F.lit(None).cast("bigint"))
        lists = small.groupBy("node").agg(F.collect_list(F.struct("same", "hot", "asks")).alias("m"))

        def others(x: Column) -> Column:
            return F.transform(F.filter("m", lambda y: (y["same"] > x["same"]) & (x["asks"] | y["asks"]) & ~F.coalesce(y["hot"] == x["hot"], F.lit(False))), lambda y: F.struct(x["same"].alias("a"), y["same"].alias("b")))

        pairs = lists.select(F.explode(F.flatten(F.transform("m", others))).alias("p")).select("p.a", "p.b").distinct()
        return self.scratch.write(pairs, "pairs")

    def _sets(self, pairs: DataFrame, groups: DataFrame | None) -> DataFrame:
        """Rows (same, shingles) of the classes that have candidates."""
        wanted = pairs.select(F.col("a").alias("same")).union(pairs.select(F.col("b").alias("same")))
        if groups is not None:
            wanted = wanted.union(groups.select("same"))
        wanted = self.scratch.write(self.classes.select("same", "h1", "h2").join(wanted.distinct(), "same"), "wanted")
        texts = self.docs.select(class_function()(col(self.text_col)).alias("c"), col(self.text_col).alias("text")).select("c.*", "text").filter("h1 IS NOT NULL")
        one = _meet(texts, wanted, ["h1", "h2"], "inner", wanted.count()).groupBy("same").agg(F.any_value("text").alias("text"))
        return self.scratch.write(one.select("same", set_function()("text").alias("shingles")), "sets")

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        a = sets.select(F.col("same").alias("a"), F.col("shingles").alias("of_a"))
        b = sets.select(F.col("same").alias("b"), F.col("shingles").alias("of_b"))
        common = F.size(F.array_intersect("of_a", "of_b"))
        return pairs.join(a, "a").join(b, "b").filter(similar(common, F.size("of_a"), F.size("of_b"))).select("a", "b")

    def _verified_groups(self, groups: DataFrame, sets: DataFrame, placed: DataFrame) -> DataFrame:
        weighed = groups.join(sets.select("same", F.size("shingles").alias("n")), "same")
        sizes = weighed.groupBy("hot").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        placed = groups.join(sizes, "hot").join(self.classes.select("same", "copies"), "same").join(placed.select("same", "sig", "depths"), "same").join(sets, "same")
        placed = placed.withColumn("block", F.pmod(F.xxhash64("same"), F.col("blocks")).cast("int"))
        dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("hot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "same", "copies", "block", "sig", "depths", "shingles")
        return dealt.groupBy("hot", "low", "high").applyInArrow(block_links, "same bigint, links bigint, root bigint")

    def _finish(self, links: DataFrame, in_blocks: DataFrame | None) -> None:
        both = links.select(F.col("a").alias("same"), F.col("b").alias("other")).union(links.select(F.col("b").alias("same"), F.col("a").alias("other")))
        copies = self.classes.select(F.col("same").alias("other"), "copies")
        counted = both.join(copies, "other").select("same", F.col("copies").alias("links"))
        edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if in_blocks is not None:
            counted = counted.union(in_blocks.select("same", "links"))
            edges = edges.union(in_blocks.select(F.col("same").alias("u"), F.col("root").alias("v")))
        counted = counted.groupBy("same").agg(F.sum("links").alias("links"))
        roots = components(edges, self.scratch, "links").select(F.col("node").alias("same"), "root")
        known = self.classes.select("same", "h1", "h2", "copies", "least")
        linked = self.scratch.write(known.join(roots, "same").join(counted, "same"), "linked")
        first = linked.groupBy("root").agg(F.min("least").alias("class_id"), F.min_by("same", F.struct(F.col("least").isNull(), "least", "same")).alias("winner"))
        # a group's classes are not sent to one task, but the groups to all
        first = self.scratch.write(first, "first")
        linked = _meet(linked, first, "root", "inner", first.count()).select("h1", "h2", "copies", "class_id", (F.col("winner") == F.col("same")).alias("wins"), (F.col("copies") - 1 + F.col("links")).alias("n_links"))
        alone = _meet(known, roots.select("same"), "same", "left_anti", roots.count()).select("h1", "h2", "copies", F.col("least").alias("class_id"), F.lit(True).alias("wins"), (F.col("copies") - 1).alias("n_links"))
        made = linked.unionByName(alone)
        self.result = self.scratch.write(made, "result")

    def links(self) -> DataFrame:
        """One row per document: id, class_id, n_links. See near_duplicates."""
        kind = self.signed.schema["id"].dataType
        # a text without copies and links is its own class
        known = self.scratch.write(self.result.filter("n_links > 0").select("h1", "h2", "class_id", "n_links"), "known")
        met = _meet(self.signed, known, ["h1", "h2"], "left", known.count())
        return met.select(
            F.col("id").alias(self.id_col), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("class_id")).cast(kind).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        )

    def one_of_each(self) -> DataFrame:
        """The rows of ``docs`` without near duplicates, all columns unchanged: of each group one row with its least id.

        Only rows of classes with copies are shuffled, and of those one for each class and task.
        """
        docs, row, h1, h2 = self.docs, fresh(self.docs, "row"), fresh(self.docs, "h1"), fresh(self.docs, "h2")
        status = self.scratch.write(self.result.filter("NOT wins OR copies > 1").select(F.col("h1").alias(h1), F.col("h2").alias(h2), "wins"), "status")
        held = docs.select(F.struct(*(col(c) for c in docs.columns)).alias(row), col(self.id_col).alias("id"), class_function()(col(self.text_col)).alias("c"))
        held = held.select(row, "id", F.col("c.h1").alias(h1), F.col("c.h2").alias(h2))
        rows = status.count()
        single = _meet(held, status, [h1, h2], "left_anti", rows).select(f"{row}.*")
        copied = _meet(held, status.filter("wins").select(h1, h2), [h1, h2], "left_semi", rows)
        one = copied.groupBy(h1, h2).agg(F.min_by(row, F.struct(F.col("id").isNull(), "id")).alias(row)).select(f"{row}.*")
        return single.unionByName(one)


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id, n_links.

    Texts are linked if the Jaccard similarity of their sets of five-word shingles (words lower-cased,
    of letters and digits) is at least 0.8; a text of fewer words, but not none, has one shingle of
    them all. n_links is the number of other documents linked to this one, copies included. class_id
    is the least id of the documents that links connect. A text without words, null say, is linked to
    nothing and has its own id. Null ids are no class's least unless all are null. Repeated rows are
    copies of each other.
    """
    return NearDuplicates(docs, scratch, id_col, text_col).links()
