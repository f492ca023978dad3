"""Cross-matches of one visit: difference sources with objects, ellipses with sources, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewise.functions import sphere
from zonewise.operators.components import checkpointed
from zonewise.operators.spatial import classes_of, spatial_join

#: Bits of a difference source's classification and of its exposure pair.
SHAPE_DIFFERS, POSITIVE_EXCURSION, SECOND_OF_PAIR = 1 << 2, (1 << 3) | (1 << 4), 1 << 30
ID_BITS = 56
FILTERS = ("u", "g", "r", "i", "z", "y")


def _placed(points: DataFrame, kept: Column | None, name: str, carried: dict[str, Column]) -> tuple[DataFrame, sphere.Vector]:
    """``points`` (id, ra, dec) as (<name>, <n>_ra, <n>_dec, the carried columns) with the unit vectors, once for each row and not for each candidate."""
    n = name[0]
    rows = (points if kept is None else points.filter(kept)).select(F.col("id").alias(name), F.col("ra").cast("double").alias(f"{n}_ra"), F.col("dec").cast("double").alias(f"{n}_dec"), *(c.alias(k) for k, c in carried.items()))
    return sphere.staged(rows, **{n: sphere.unit_vector(F.col(f"{n}_ra"), F.col(f"{n}_dec"))})


def _distance_pairs(first: DataFrame, second: DataFrame, radius: float, first_filter: Column | None, second_filter: Column | None, carried: dict[str, Column]) -> DataFrame:
    """distance_match with the chord's square, d2, for the distance."""
    limit = sphere.chord2_of_angle(radius)
    f, a = _placed(first, first_filter, "first", {})
    s, b = _placed(second, second_filter, "second", carried)
    d2 = sphere.chord2(a, b)
    pairs = spatial_join(f, s, (F.col("f_ra"), F.col("f_dec")), (F.col("s_ra"), F.col("s_dec"), F.lit(radius)), radius, d2 < limit)
    return pairs.select("first", "second", d2.alias("d2"), *carried)


def distance_match(first: DataFrame, second: DataFrame, radius: float, first_filter: Column | None = None, second_filter: Column | None = None, carried: dict[str, Column] | None = None) -> DataFrame:
    """Pairs (first, second, distance) closer than ``radius`` degrees, strictly; distance in degrees.

    Both tables are (id, ra, dec). The filters are over those columns; Catalyst runs them at the scans.
    carried: columns of the second table that the pairs have too, so that no join has to bring them.
    """
    pairs = _distance_pairs(first, second, radius, first_filter, second_filter, carried or {})
    return pairs.select("first", "second", sphere.angle_of_chord2(F.col("d2")).alias("distance"), *(carried or {}))


#: Squared chords that differ by less, relatively, may be one and the same, computed twice.
SAME = 1e-12


def closest(first: DataFrame, second: DataFrame, radius: float, farthest: bool = False, carried: dict[str, Column] | None = None) -> DataFrame:
    """For each first that has a match its number of matches, the nearest and its distance: (first, second, distance, n_matches[, farthest], the greatest of each carried column).

    Of equally near matches the one with the least id, of equally far ones that with the greatest. All
    pairs go by in the join's own stage and leave a count and two numbers for each first, in hash
    aggregates: least structs of distance and id would be a sort of all pairs. Circles that just reach
    so far then find the few ids.
    """
    carried = carried or {}
    pairs = _distance_pairs(first, second, radius, None, None, carried)
    found = checkpointed(pairs.groupBy("first").agg(F.count(F.lit(1)).alias("n_matches"), F.min("d2").alias("near2"), F.max("d2").alias("far2"), *(F.max(c).alias(c) for c in carried)))
    f, a = _placed(first, None, "first", {})
    s, b = _placed(second, None, "second", {})
    d2 = sphere.chord2(a, b)
    ends = checkpointed(f.join(found.select("first", "near2", "far2"), "first").withColumn("f_reach", sphere.angle_of_chord2(F.col("near2"))))
    at, of = (F.col("s_ra"), F.col("s_dec")), (F.col("f_ra"), F.col("f_dec"))
    near = spatial_join(s, ends, at, (*of, F.col("f_reach")), None, d2 <= F.col("near2") * (1 + SAME), classes_of(ends, F.col("f_reach")))
    best = near.groupBy("first").agg(F.min(F.struct(d2.alias("d2"), F.col("second"))).alias("m"))
    made = found.join(best, "first").select("first", F.col("m.second").alias("second"), sphere.angle_of_chord2(F.col("m.d2")).alias("distance"), "n_matches", *carried)
    if not farthest:
        return made
    far = spatial_join(ends, s, of, (*at, F.lit(radius)), radius, (d2 >= F.col("far2") * (1 - SAME)) & (d2 < sphere.chord2_of_angle(radius)))
    last = far.groupBy("first").agg(F.max(F.struct(d2.alias("d2"), F.col("second")))["second"].alias("farthest"))
    return made.join(last, "first")


def grouped(pairs: DataFrame) -> DataFrame:
    """For each first its matches, nearest first, then by id: (first, n_matches, matches)."""
    return pairs.groupBy("first").agg(F.count(F.lit(1)).alias("n_matches"), F.array_sort(F.collect_list(F.struct("distance", "second"))).alias("matches"))


def best_match(pairs: DataFrame) -> DataFrame:
    """For each first the pair with the least distance, of equals the one with the least second.

    An aggregate, so its partial results are one row for each first and task.
    """
    best = pairs.groupBy("first").agg(F.min(F.struct("distance", "second")).alias("m"))
    return best.select("first", F.col("m.second").alias("second"), F.col("m.distance").alias("distance"))


def match_flags(sources: DataFrame, pairs: DataFrame, objects: DataFrame | None, filter_id: int, threshold: int) -> DataFrame:
    """``sources`` with n_matches, has_match, known_variable: whether some match has varProb[filter] >= threshold.

    Without objects, pairs have that probability, p, themselves.
    """
    if objects is not None:
        pairs = pairs.join(objects.select(F.col("id").alias("second"), F.element_at("var_prob", filter_id + 1).alias("p")), "second")
    return with_flags(sources, pairs.groupBy("first").agg(F.count(F.lit(1)).alias("n_matches"), F.max("p").alias("p")), threshold)


def with_flags(sources: DataFrame, found: DataFrame, threshold: int) -> DataFrame:
    """match_flags from each first's n_matches and greatest probability p, as closest() gives them."""
    flags = found.select(F.col("first"), F.col("n_matches").alias("n"), (F.col("p") >= threshold).alias("known"))
    met = sources.join(flags, sources["id"] == flags["first"], "left").drop("first")
    return met.withColumns({"n_matches": F.coalesce("n", F.lit(0)), "has_match": F.col("n").isNotNull(), "known_variable": F.coalesce("known", F.lit(False))}).drop("n", "known")


def without_known_variables(flagged: DataFrame) -> DataFrame:
    return flagged.filter(~F.col("known_variable"))


def prepare_ellipses(predictions: DataFrame, scaling: float = 1.0, threshold: float = 300.0, major_clamp: float = 0.0, minor_clamp: float = 0.0) -> DataFrame:
    """Scales the axes (arcseconds), keeps ellipses with a semi-major axis below the threshold, then clamps; a clamp of 0 or less is off."""
    scaled = predictions.withColumns({c: F.col(c) * scaling for c in ("smaa", "smia")}).filter(~F.isnan("smaa") & (F.col("smaa") < threshold))
    for c, clamp in (("smaa", major_clamp), ("smia", minor_clamp)):
        if clamp > 0:
            scaled = scaled.withColumn(c, F.least(F.col(c), F.lit(float(clamp))))
    return scaled


def _ellipse_sides(ellipses: DataFrame, points: DataFrame, max_axis: float) -> tuple[DataFrame, DataFrame, Column, Column]:
    """Ellipses and points for a join, whether a point is inside, and the chord's square."""
    reach = F.when(F.col("e_smaa") <= max_axis, F.col("e_smaa") / 3600).otherwise(F.raise_error(F.lit("an ellipse is larger than max_axis")).cast("double"))
    e = ellipses.select(F.col("id").alias("first"), *(F.col(c).cast("double").alias(f"e_{c}") for c in ("ra", "dec", "smaa", "smia", "pa")))
    e = e.withColumn("e_reach", reach)
    p = points.select(F.col("id").alias("second"), F.col("ra").cast("double").alias("p_ra"), F.col("dec").cast("double").alias("p_dec"))
    # vectors and axes once for each row, not for each candidate
    p, v = sphere.staged(p, p=sphere.unit_vector(F.col("p_ra"), F.col("p_dec")))
    e, center, along, across = sphere.staged_ellipse(e, F.col("e_ra"), F.col("e_dec"), F.col("e_smaa"), F.col("e_smia"), F.col("e_pa"), "e")
    return e, p, sphere.in_axes(v, center, along, across), sphere.chord2(v, center)


def _ellipse_pairs(e: DataFrame, p: DataFrame, inside: Column, max_axis: float) -> DataFrame:
    # in the plane's projection the ellipse reaches as far as asin of its axis on the sphere
    return spatial_join(p, e, (F.col("p_ra"), F.col("p_dec")), (F.col("e_ra"), F.col("e_dec"), F.col("e_reach") * 1.001), max_axis / 3600 * 1.001, inside)


def ellipse_match(ellipses: DataFrame, points: DataFrame, max_axis: float) -> DataFrame:
    """Pairs (first, second, distance) of ellipses (id, ra, dec, smaa, smia, pa) and points (id, ra, dec) within; distance in degrees.

    max_axis: no semi-major axis is larger (arcseconds). Ellipses with larger ones raise an error.
    """
    e, p, inside, d2 = _ellipse_sides(ellipses, points, max_axis)
    return _ellipse_pairs(e, p, inside, max_axis).select("first", "second", sphere.angle_of_chord2(d2).alias("distance"))


def ellipse_closest(ellipses: DataFrame, points: DataFrame, max_axis: float) -> DataFrame:
    """For each ellipse that holds a point the number of points and the nearest one, as closest() has them: (first, second, distance, n_matches)."""
    e, p, inside, d2 = _ellipse_sides(ellipses, points, max_axis)
    pairs = _ellipse_pairs(e, p, inside, max_axis).select("first", d2.alias("d2"))
    found = checkpointed(pairs.groupBy("first").agg(F.count(F.lit(1)).alias("n_matches"), F.min("d2").alias("near2")))
    ends = checkpointed(e.join(found.select("first", "near2"), "first").withColumn("e_near", sphere.angle_of_chord2(F.col("near2"))))
    near = spatial_join(p, ends, (F.col("p_ra"), F.col("p_dec")), (F.col("e_ra"), F.col("e_dec"), F.col("e_near")), None, inside & (d2 <= F.col("near2") * (1 + SAME)), classes_of(ends, F.col("e_near")))
    best = near.groupBy("first").agg(F.min(F.struct(d2.alias("d2"), F.col("second"))).alias("m"))
    return found.join(best, "first").select("first", F.col("m.second").alias("second"), sphere.angle_of_chord2(F.col("m.d2")).alias("distance"), "n_matches")


def new_objects(flagged: DataFrame, filter_id: int) -> DataFrame:
    """Objects (source_id, id, ra, dec, ..., var_prob) from sources (id, ra, dec, pair_id, classification) that nothing matched.

    Not from the second of a pair of sources, nor from cosmic rays: those whose shape differs while
    the flux is in positive excursion. Ids of 2**56 and more are an error. A match with a moving
    object does not matter.
    """
    bits = F.col("classification").cast("bigint")
    cosmic = (bits.bitwiseAND(SHAPE_DIFFERS) != 0) & (bits.bitwiseAND(POSITIVE_EXCURSION) != 0)
    second = F.col("pair_id").cast("bigint").bitwiseAND(SECOND_OF_PAIR) != 0
    fresh = flagged.filter(~F.coalesce(second, F.lit(False)) & ~F.coalesce(cosmic, F.lit(False)) & ~F.col("has_match") & ~F.col("known_variable"))
    checked = F.when(F.col("id") < (1 << ID_BITS), F.col("id")).otherwise(F.raise_error(F.lit("a source id does not fit in 56 bits")).cast("bigint"))
    zeros = {c: F.lit(0.0) for c in ("mu_ra", "mu_decl", "parallax", "radial_velocity")}
    probability = F.array(*(F.lit(100 if k == filter_id else 0).cast("smallint") for k in range(len(FILTERS))))
    made = fresh.select(F.col("id").alias("source_id"), checked.bitwiseOR(F.lit((filter_id + 1) << ID_BITS)).alias("id"), "ra", "dec")
    return made.withColumns(zeros | {"var_prob": probability})


def assign_objects(sources: DataFrame, best: DataFrame, created: DataFrame) -> DataFrame:
    """``sources`` (id, object_id, ...) with object_id from the best match, and from a new object where there is one, which wins."""
    b = best.select(F.col("first").alias("id"), F.col("second").alias("b_id"))
    n = created.select(F.col("source_id").alias("id"), F.col("id").alias("n_id"))
    met = sources.join(b, "id", "left").join(n, "id", "left")
    return met.withColumn("object_id", F.coalesce("n_id", "b_id", "object_id")).drop("b_id", "n_id").select(sources.columns)


def observe_objects(objects: DataFrame, best: DataFrame, filter_name: str, time: Column) -> DataFrame:
    """``objects`` with latest_obs_time and <filter>_num_obs of those matched: each counts once, however many sources matched it."""
    seen = best.select(F.col("second").alias("id")).distinct().withColumn("__seen", F.lit(True))
    count = f"{filter_name}_num_obs"
    met = objects.join(seen, "id", "left")
    hit = F.col("__seen").isNotNull()
    return met.withColumns({"latest_obs_time": F.when(hit, time).otherwise(F.col("latest_obs_time")), count: F.col(count) + F.when(hit, 1).otherwise(0)}).select(objects.columns)


def object_rows(created: DataFrame, sources: DataFrame, filter_name: str, time: Column) -> DataFrame:
    """Catalog rows of new objects: position and first flux of their source, one observation in its filter, none in the others."""
    s = sources.select(F.col("id").alias("source_id"), "flux", "flux_err")
    met = created.select("source_id", "id", "ra", "dec").join(s, "source_id")
    columns = [F.col("id"), F.col("ra"), F.col("dec"), time.alias("earliest_obs_time"), time.alias("latest_obs_time")]
    for f in FILTERS:
        mine = f == filter_name
        columns += [
            (F.col("flux") if mine else F.lit(None).cast("double")).alias(f"{f}_flux"),
            (F.col("flux_err") if mine else F.lit(None).cast("double")).alias(f"{f}_flux_err"),
            F.lit(1 if mine else 0).alias(f"{f}_num_obs"),
        ]
    return met.select(*columns)


def annotate(pairs: DataFrame, left: str, right: str, distance: str) -> DataFrame:
    """Pairs with how many matches each side has, and whether the pair is each side's closest (of equals the least id).

    Aggregates that are joined back: one row with a great many matches is counted in many tasks.
    ``pairs`` is read three times, so it should be written somewhere.
    """
    made = pairs
    for key, other in ((left, right), (right, left)):
        best = F.min(F.struct(F.col(distance).alias("d"), F.col(other).alias("o")))
        of_key = pairs.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias(f"n_{other}"), best.alias("__m"))
        made = made.join(of_key, F.col(key) == F.col("__k")).withColumn(f"closest_for_{key}", F.col(other) == F.col("__m.o")).drop("__k", "__m")
    return made
