"""Difference sources of visits as a stream: repeats dropped, matched with objects, counted by object.

The stream is Structured Streaming's own: its checkpoint is the only record of what was read, its keyed
state drops sources that come again within a delay and holds an object's counts, and the matching is a
stream-static spatial join on cells. Counts leave in update mode, a batch's changes under its number,
so a batch that is run again after a failure replaces what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewise.functions import sphere
from zonewise.operators.spatial import spatial_join

#: What an object's row of counts holds besides its id.
COUNTS = ("n_sources", "first_time", "last_time", "last_visit")


def new_sources(stream: DataFrame, delay: str, time: str = "time", key: str = "id") -> DataFrame:
    """Sources of which none with the key came before, within the delay; sources older than the watermark are late and left out."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def matched(stream: DataFrame, objects: DataFrame, radius: float) -> DataFrame:
    """Sources (a stream of id, ra, dec, time, visit_id) with the objects (id, ra, dec) at most ``radius`` degrees away: object_id, distance and the source's columns.

    The objects are read anew for each batch, so a file added to their table is seen by the next one.
    """
    s, place = sphere.staged(stream, s=sphere.unit_vector(F.col("ra"), F.col("dec")))
    o = objects.select(F.col("id").alias("object_id"), F.col("ra").alias("o_ra"), F.col("dec").alias("o_dec"))
    o, center = sphere.staged(o, o=sphere.unit_vector(F.col("o_ra"), F.col("o_dec")))
    d2 = sphere.chord2(place, center)
    met = spatial_join(s, o, (F.col("ra"), F.col("dec")), (F.col("o_ra"), F.col("o_dec"), F.lit(radius)), radius, d2 < sphere.chord2_of_angle(radius))
    return met.select("object_id", sphere.angle_of_chord2(d2).alias("distance"), *(F.col(c) for c in stream.columns))


def object_counts(pairs: DataFrame) -> DataFrame:
    """(object_id, n_sources, first_time, last_time, last_visit) over matched sources; as a stream, to be written in update mode."""
    return pairs.groupBy("object_id").agg(
        F.count(F.lit(1)).alias("n_sources"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.max(F.struct("time", "visit_id"))["visit_id"].alias("last_visit")
    )


def run_available(counts: DataFrame, path: str, checkpoint: str) -> None:
    """Brings the table of counts under ``path`` up to date with all that has arrived, from where the checkpoint stands, and ends."""

    def write(changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Each object's counts after the last batch that changed them."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("object_id").agg(F.max_by(F.struct(*COUNTS), F.col("batch")).alias("c"))
    return last.select("object_id", "c.*")
