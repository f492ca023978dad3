"""Whether files of a table are sorted, without sorting or shuffling its rows.

A task knows the order of the rows it reads. Of each block of a file it tells the first and last key and
the first row that is out of order; these few rows a block are then compared with their neighbours,
blocks within a file and, by their first and last blocks, files with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = "file string, block bigint, n bigint, first double, last double, at bigint, bad_id {0}, bad_key double, previous double"


def block_order(table: DataFrame, key: str, id_col: str) -> DataFrame:
    """(file, block, n, first, last, at, bad_id, bad_key, previous, first_id) of each block of the files that ``table`` reads.

    at is the number in the block of its first row that is out of order, null where there is none: one
    whose key is less than that of the row before (previous), or is null or NaN. Keys are compared as
    doubles; first_id is the first row's.
    """
    id_type = table.schema[id_col].dataType.simpleString()
    rows = table.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col(key).cast("double").alias("key"), F.col(id_col).alias("id"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, told = None, None
        for batch in batches:
            for file, block, keys, ids in _by_block(batch):
                if (file, block) != place:
                    if told:
                        yield _row(place, told, batch.schema)
                    place, told = (file, block), {"n": 0, "first": keys[0], "last": keys[0], "first_id": ids[0], "at": None, "bad": None}
                before = np.append(told["last"] if told["n"] else keys[0], keys[:-1])
                # a NaN is no number to go on from: the row after it is compared with nothing
                wrong = np.flatnonzero(np.isnan(keys) | (keys < before))
                if told["at"] is None and len(wrong):
                    k = int(wrong[0])
                    told |= {"at": told["n"] + k, "bad": (ids[k].as_py(), keys[k], before[k] if told["n"] + k else None)}
                told |= {"n": told["n"] + len(keys), "last": keys[-1]}
        if told:
            yield _row(place, told, batch.schema)

    return rows.mapInArrow(blocks, BLOCKS.format(id_type) + f", first_id {id_type}")


def _by_block(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch by the block that they are of, in their order."""
    if not batch.num_rows:
        return
    files, starts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
    keys = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
    other = np.array([a != b for a, b in zip(files[1:], files[:-1], strict=True)], dtype=bool) | (starts[1:] != starts[:-1])
    cuts = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield files[a], int(starts[a]), keys[a:b], batch.column(3).slice(a, b - a)


def _row(place: tuple[str, int], told: dict, schema: pa.Schema) -> pa.RecordBatch:
    bad_id, bad_key, previous = told["bad"] or (None, None, None)
    id_type = schema.field("id").type
    values = [(place[0], pa.string()), (place[1], pa.int64()), (told["n"], pa.int64()), (float(told["first"]), pa.float64()), (float(told["last"]), pa.float64()), (told["at"], pa.int64()), (bad_id, id_type), (bad_key, pa.float64()), (previous, pa.float64()), (told["first_id"].as_py(), id_type)]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], ["file", "block", "n", "first", "last", "at", "bad_id", "bad_key", "previous", "first_id"])


def first_disorder(table: DataFrame, key: str, id_col: str) -> DataFrame:
    """The first row, by file, place in it and so the order of reading, whose key is less than the one before, or null or NaN: (file, id, key, previous), or no row.

    Files count in the order of their paths, as numbered parts of a table are named. A first row that
    is fine has no previous key.
    """
    blocks = block_order(table, key, id_col)
    within = Window.partitionBy("file").orderBy("block")
    led = blocks.withColumns({"__before": F.lag("last").over(within), "__number": F.row_number().over(within)})
    # the second level has a row for each file
    ends = led.groupBy("file").agg(F.max_by("last", "block").alias("__last"))
    files = ends.withColumn("__file_before", F.lag("__last").over(Window.orderBy("file"))).drop("__last")
    met = led.join(files, "file").withColumn("__before", F.when(F.col("__number") == 1, F.col("__file_before")).otherwise(F.col("__before")))
    border = (F.col("first") < F.col("__before")) & ~F.isnan("first") & ~F.isnan("__before")
    starts = F.when(border, F.struct(F.lit(0).cast("bigint").alias("at"), F.col("first_id").alias("id"), F.col("first").alias("key"), F.col("__before").alias("previous")))
    inner = F.when(F.col("at").isNotNull(), F.struct("at", F.col("bad_id").alias("id"), F.col("bad_key").alias("key"), "previous"))
    found = met.select("file", "block", F.coalesce(starts, inner).alias("bad")).filter("bad IS NOT NULL")
    return found.agg(F.min_by(F.struct("file", "bad.id", "bad.key", "bad.previous"), F.struct("file", "block")).alias("r")).filter("r IS NOT NULL").select("r.*")


def require_sorted(table: DataFrame, key: str, id_col: str) -> DataFrame:
    """``table``, if its files are sorted by ``key``; else a ValueError that names the first row that is not."""
    wrong = first_disorder(table, key, id_col).first()
    if wrong:
        raise ValueError(f"not sorted by {key}: {id_col} {wrong.id} has {wrong.key} after {wrong.previous} in {wrong.file}")
    return table
