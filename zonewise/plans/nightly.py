"""One telescope visit: load objects, match difference sources and predictions, make objects, update, commit."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from zonewise.functions.motion import proper_motion
from zonewise.functions.tiles import Decomposition
from zonewise.operators import match
from zonewise.sources.store import VersionedTable


@dataclass(frozen=True)
class VisitControl:
    fov_radius: float = 1.75
    match_radius_arcsec: float = 0.05
    ellipse_scaling: float = 1.0
    semi_major_threshold: float = 300.0
    semi_major_clamp: float = 0.0
    semi_minor_clamp: float = 0.0
    variability_threshold: dict[str, int] = field(default_factory=lambda: dict.fromkeys(match.FILTERS, 90))
    decomposition: Decomposition = Decomposition()

    def __post_init__(self) -> None:
        if not 0 <= self.fov_radius <= 45 or self.match_radius_arcsec < 0:
            raise ValueError("a field of view has a radius of at most 45 degrees, and a match radius is not negative")
        if any(not 0 <= t <= 100 for t in self.variability_threshold.values()):
            raise ValueError("variability thresholds lie between 0 and 100")


@dataclass(frozen=True)
class VisitResult:
    """Frames of a visit: pairs, flagged sources, prediction pairs, new objects, sources with object ids, object updates."""

    matches: DataFrame
    flagged: DataFrame
    predicted: DataFrame
    created: DataFrame
    assigned: DataFrame
    observed: DataFrame


def load_objects(table: DataFrame, control: VisitControl, ra: float, dec: float) -> DataFrame:
    """Objects of the chunks that the field of view touches: a filter on the partition column, which prunes the scan."""
    return table.filter(F.col("chunk").isin(control.decomposition.chunks_of_circle(ra, dec, control.fov_radius)))


def at_epoch(objects: DataFrame, epoch: float) -> DataFrame:
    """``objects`` with ra and dec moved to an epoch."""
    ra, dec = proper_motion(*(F.col(c) for c in ("ra", "dec", "mu_ra", "mu_decl", "parallax", "radial_velocity")), F.lit(epoch))
    return objects.withColumns({"ra": ra, "dec": dec})


def run_matching(objects: DataFrame, sources: DataFrame, predictions: DataFrame, filter_name: str, epoch: float, control: VisitControl = VisitControl(), match_radius_arcsec: float | None = None) -> VisitResult:
    """objects: id, ra, dec, motions, var_prob, latest_obs_time, <f>_num_obs; sources: id, ra, dec, pair_id, classification, object_id; predictions: id, ra, dec, smaa, smia, pa."""
    number = match.FILTERS.index(filter_name)
    radius = control.match_radius_arcsec if match_radius_arcsec is None else match_radius_arcsec
    moved = at_epoch(objects, epoch)
    pairs = match.distance_match(sources, moved, radius / 3600)
    flagged = match.match_flags(sources, pairs, objects, number, control.variability_threshold[filter_name])
    ellipses = match.prepare_ellipses(predictions, control.ellipse_scaling, control.semi_major_threshold, control.semi_major_clamp, control.semi_minor_clamp)
    predicted = match.ellipse_match(ellipses, match.without_known_variables(flagged), control.semi_major_threshold)
    created = match.new_objects(flagged, number)
    best = match.best_match(pairs)
    assigned = match.assign_objects(sources, best, created)
    observed = match.observe_objects(objects, best, filter_name, F.lit(epoch))
    return VisitResult(pairs, flagged, predicted, created, assigned, observed)


def write_outputs(result: VisitResult, folder: str, visit_id: int) -> None:
    """A visit's pairs with objects and with predictions, and its sources with their objects; a visit that is worked again replaces them."""
    for name, frame in (("matches", result.matches), ("predicted", result.predicted), ("assigned", result.assigned)):
        frame.write.mode("overwrite").parquet(f"{folder}/{name}/visit_id={visit_id}")


def visit_work(table: VersionedTable, sources_of, predictions_of, control: VisitControl = VisitControl(), outputs: str | None = None):
    """A function for streaming.visits.run_visit: matches a visit (visit_id, ra, dec, filter, epoch[, match_radius]) and stages its new and updated objects.

    Pairs and assignments go to the folder ``outputs``; those of visits that are not in the table's visits() are not valid.
    """

    def work(visit: Row) -> str:
        # partitions that the field of view does not touch are not read
        chunks = control.decomposition.chunks_of_circle(visit.ra, visit.dec, control.fov_radius)
        objects = load_objects(table.read(), control, visit.ra, visit.dec)
        radius = visit.asDict().get("match_radius")
        result = run_matching(objects, sources_of(visit), predictions_of(visit), visit["filter"], visit.epoch, control, radius)
        matched = match.best_match(result.matches).select(F.col("second").alias("id")).distinct()
        updated = result.observed.join(matched, "id", "left_semi")
        rows = match.object_rows(result.created, sources_of(visit), visit["filter"], F.lit(visit.epoch))
        fresh = result.created.join(rows.select("id", "latest_obs_time", *(f"{f}_num_obs" for f in match.FILTERS)), "id")
        fresh = fresh.withColumn("chunk", control.decomposition.chunk(F.col("ra"), F.col("dec")))
        inserts = updated.select([f.name for f in table.schema.fields]).unionByName(fresh.select([f.name for f in table.schema.fields]))
        if outputs:
            write_outputs(result, outputs, visit.visit_id)
        # new objects may lie just outside the chunks that were read
        touched = {int(c) for c in chunks} | {int(r.chunk) for r in fresh.select("chunk").distinct().toLocalIterator()}
        return table.stage_delta(inserts, updated.select(table.key), touched)

    return work
