"""Quality checks of exposures and tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewise.functions import sphere
from zonewise.functions.wcs import pixel_to_sky, sip_shift, with_sip_terms
from zonewise.operators.components import checkpointed


def bounding_circle(circles: DataFrame) -> DataFrame:
    """One row (ra, dec, radius) around circles (ra, dec, radius): the sum of centers, the farthest center and twice the largest radius."""
    v = sphere.unit_vector(F.col("ra"), F.col("dec"))
    total = circles.agg(*(F.sum(c).alias(f"s{k}") for k, c in enumerate(v)))
    middle = tuple(F.col(f"s{k}") for k in range(3))
    reach = circles.join(F.broadcast(total)).agg(F.max(sphere.separation(v, middle)).alias("far"), F.max("radius").alias("r"))
    return total.join(F.broadcast(reach)).select(sphere.longitude(middle).alias("ra"), sphere.latitude(middle).alias("dec"), (F.col("far") + 2 * F.col("r")).alias("radius"))


def corner_statistics(pairs: DataFrame) -> DataFrame:
    """(n, min, max, mean distance) between raw and science corners (raw_ra, raw_dec, sci_ra, sci_dec)."""
    d = sphere.separation(sphere.unit_vector(F.col("raw_ra"), F.col("raw_dec")), sphere.unit_vector(F.col("sci_ra"), F.col("sci_dec")))
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.min(d).alias("min_distance"), F.max(d).alias("max_distance"), F.avg(d).alias("mean_distance"))


def max_distortion(exposures: DataFrame, grid: int, order: int, threshold: float = 0.0) -> DataFrame:
    """(exposure_id, max_distortion) in pixels over a grid that has the image's borders, of exposures that reach the threshold.

    exposures: exposure_id, crpix1, crpix2, width, height, sip. The grid's first pixel counts 1, and
    half a pixel is added, as for corners. Terms of more than ``order``, and shifts, do not count.
    """
    places = F.transform(F.sequence(F.lit(0), F.ceil(F.col("width") / grid)), lambda k: F.least(k * grid, F.col("width")))
    rows = F.transform(F.sequence(F.lit(0), F.ceil(F.col("height") / grid)), lambda k: F.least(k * grid, F.col("height")))

    def counted(name: str) -> Column:
        return F.filter(name, lambda t: (t["p"] + t["q"] > 0) & (t["p"] + t["q"] <= order))

    known = with_sip_terms(exposures).select("exposure_id", "crpix1", "crpix2", counted("sip_a").alias("a"), counted("sip_b").alias("b"), places.alias("gx"), rows.alias("gy"))
    u, v = F.col("x") + 0.5 - F.col("crpix1"), F.col("y") + 0.5 - F.col("crpix2")
    gridded = known.withColumn("x", F.explode("gx")).withColumn("y", F.explode("gy")).withColumns({"u": u, "v": v})
    moved = gridded.select("exposure_id", sip_shift(F.col("a"), F.col("u"), F.col("v")).alias("du"), sip_shift(F.col("b"), F.col("u"), F.col("v")).alias("dv"))
    made = moved.groupBy("exposure_id").agg(F.max(F.sqrt(F.col("du") * F.col("du") + F.col("dv") * F.col("dv"))).alias("max_distortion"))
    return made.filter(F.col("max_distortion") >= threshold)


def tile_difference(actual: DataFrame, processed: DataFrame) -> DataFrame:
    """(tile, kind): missing tiles are not processed though they have data, surplus ones are processed without."""
    a, p = actual.select("tile").distinct(), processed.select("tile").distinct()
    return a.join(p, "tile", "left_anti").withColumn("kind", F.lit("missing")).unionByName(p.join(a, "tile", "left_anti").withColumn("kind", F.lit("surplus")))


#: The sine of an angle by which polygons must overlap, beyond rounding.
OVERLAP = 1e-12


def _ray(v: sphere.Vector) -> Column:
    return F.struct(*(c.alias(n) for n, c in zip("xyz", v, strict=True)))


def _of(ray: Column) -> sphere.Vector:
    return ray["x"], ray["y"], ray["z"]


def _sides(corners: Column) -> Column:
    """The normals of a polygon's sides."""
    return F.transform(F.sequence(F.lit(1), F.size(corners)), lambda i: _ray(sphere.cross(_of(F.element_at(corners, i)), _of(F.element_at(corners, i % F.size(corners) + 1)))))


def polygons_overlap(a: Column, b: Column) -> Column:
    """Whether convex polygons on the sphere (arrays of corners as struct(x, y, z), in order) share more than an edge.

    If they do not, a plane parts them that holds a side of one or a corner of each.
    """
    pairs = F.flatten(F.transform(a, lambda p: F.transform(b, lambda q: _ray(sphere.cross(_of(p), _of(q))))))

    def parts(n: Column) -> Column:
        size = sphere.norm(_of(n))

        def beyond(sign: int) -> Column:
            return F.forall(a, lambda p: sign * sphere.dot(_of(p), _of(n)) >= -OVERLAP * size) & F.forall(b, lambda q: sign * sphere.dot(_of(q), _of(n)) <= OVERLAP * size)

        return (size > OVERLAP) & (beyond(1) | beyond(-1))

    return ~F.exists(F.concat(_sides(a), _sides(b), pairs), parts)


def _faces() -> Column:
    """Of each root of tiles its number and the axes of x, y and the face itself."""
    turns = [(round(math.cos(math.pi / 2 * k)), round(math.sin(math.pi / 2 * k))) for k in range(4)]
    axes = [((0, -1, 0), (1, 0, 0), (0, 0, 1)), *(((-s, c, 0), (0, 0, 1), (c, s, 0)) for c, s in turns), ((0, -1, 0), (-1, 0, 0), (0, 0, -1))]
    rays = [[_ray(tuple(F.lit(float(c)) for c in axis)) for axis in face] for face in axes]
    return F.array(*(F.struct(F.lit(k).alias("root"), x.alias("ex"), y.alias("ey"), f.alias("ef")) for k, (x, y, f) in enumerate(rays)))


def footprint_cover(exposures: DataFrame, resolution: int) -> DataFrame:
    """(exposure_id, root, x0, x1, y0, y1): blocks of tiles [x0, x1) x [y0, y1) of a root that together are what exposures (WCS, x0, y0, width, height) overlap.

    By descent: a root that an exposure overlaps is halved along both axes, and so are its parts, until
    a part lies wholly inside, which is taken as it is, or is one tile. So the work, and the blocks, grow
    with the length of the border and not with the area. Borders of tiles and of exposures are great
    circles, and overlap is decided exactly. Each level is a checkpointed step over all exposures.
    """
    left, low = F.col("x0") - 0.5, F.col("y0") - 0.5
    right, high = left + F.col("width"), low + F.col("height")
    made, *corners = sphere.staged(exposures, __a=pixel_to_sky(left, low), __b=pixel_to_sky(right, low), __c=pixel_to_sky(right, high), __d=pixel_to_sky(left, high))
    total = tuple(sum((v[k] for v in corners[1:]), corners[0][k]) for k in range(3))
    # exposures are few rows of one small file, and the tests of a part take long: dealt out, else one task has them all
    tasks = max(2, 2 * exposures.sparkSession.sparkContext.defaultParallelism)
    made = made.select("exposure_id", F.array(*map(_ray, corners)).alias("__corners"), _ray(total).alias("__sum")).repartition(tasks)
    # normals that point inwards, whichever way round the corners go
    inwards = F.transform(_sides(F.col("__corners")), lambda n: _ray(sphere.scaled(_of(n), F.signum(sphere.dot(_of(n), _of(F.col("__sum")))))))
    made = made.withColumn("__inwards", inwards).withColumn("__face", F.explode(_faces())).drop("__sum")
    parts = made.withColumns({f"{a}{k}": F.lit(k * resolution) for a in "xy" for k in (0, 1)})

    def corner(x: str, y: str) -> Column:
        along, up = (2 * F.col(c) / resolution - 1 for c in (x, y))
        ex, ey, ef = (_of(F.col(f"__face.{n}")) for n in ("ex", "ey", "ef"))
        return _ray(sphere.plus(sphere.plus(ef, sphere.scaled(ex, along)), sphere.scaled(ey, up)))

    inside = F.forall("__cell", lambda p: F.forall("__inwards", lambda n: sphere.dot(_of(p), _of(n)) >= 0))
    single = (F.col("x1") - F.col("x0") == 1) & (F.col("y1") - F.col("y0") == 1)
    cover = None
    while True:
        # made once: the test reads it for each plane and corner
        parts = sphere.once(parts, __cell=F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")))
        met = checkpointed(parts.filter(polygons_overlap(F.col("__corners"), F.col("__cell"))).withColumn("__whole", single | inside).drop("__cell"))
        whole = met.filter("__whole").select("exposure_id", F.col("__face.root").alias("root"), "x0", "x1", "y0", "y1")
        cover = whole if cover is None else cover.unionByName(whole)
        cut = met.filter("NOT __whole")
        if cut.isEmpty():
            return cover
        parts = cut
        for a in "xy":
            low, high = F.col(f"{a}0"), F.col(f"{a}1")
            middle = F.floor((low + high) / 2).cast("int")
            halves = F.when(high - low > 1, F.array(F.struct(low.alias("a"), middle.alias("z")), F.struct(middle.alias("a"), high.alias("z")))).otherwise(F.array(F.struct(low.alias("a"), high.alias("z"))))
            parts = parts.withColumn("__half", F.explode(halves)).withColumns({f"{a}0": F.col("__half.a"), f"{a}1": F.col("__half.z")}).drop("__half")


def footprint_tiles(exposures: DataFrame, resolution: int) -> DataFrame:
    """(exposure_id, tile) of the tiles that exposures (WCS, x0, y0, width, height) overlap."""
    cover = footprint_cover(exposures, resolution)
    each = cover.withColumn("__x", F.explode(F.sequence("x0", F.col("x1") - 1))).withColumn("__y", F.explode(F.sequence("y0", F.col("y1") - 1)))
    tile = (F.col("root").cast("bigint") * resolution + F.col("__y")) * resolution + F.col("__x")
    return each.select("exposure_id", tile.alias("tile"))


def amp_corners(amps: DataFrame, prefix: str, name: str) -> DataFrame:
    """``amps`` with the corners of their boxes (<prefix>x0, y0, width, height, under the WCS <prefix>crval1 ...) as <name>, an array of rays in order."""
    left, low = F.col(f"{prefix}x0") - 0.5, F.col(f"{prefix}y0") - 0.5
    right, high = left + F.col(f"{prefix}width"), low + F.col(f"{prefix}height")
    made, *corners = sphere.staged(amps, **{f"__{name}{k}": pixel_to_sky(x, y, prefix) for k, (x, y) in enumerate(((left, low), (right, low), (right, high), (left, high)))})
    return made.select(*amps.columns, F.array(*map(_ray, corners)).alias(name))


def amp_separations(amps: DataFrame, raw: str = "raw", science: str = "science") -> DataFrame:
    """``amps`` by corner: corner (from 0), corner_distance to the same corner of the other outline, edge_distance to the nearest edge of the raw one, in degrees."""
    each = amps.select("*", F.posexplode(science).alias("corner", "__at"))
    at = _of(F.col("__at"))
    edges = F.transform(F.sequence(F.lit(1), F.size(raw)), lambda i: F.struct(F.element_at(raw, i).alias("a"), F.element_at(raw, i % F.size(raw) + 1).alias("b")))
    nearest = F.array_min(F.transform(edges, lambda e: sphere.arc_distance(at, _of(e["a"]), _of(e["b"]))))
    apart = sphere.separation(_of(F.element_at(raw, F.col("corner") + 1)), at)
    return each.select(*amps.columns, "corner", apart.alias("corner_distance"), nearest.alias("edge_distance"))


def edge_statistics(separations: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, min_, max_ and mean_ of corner_distance and edge_distance) over the corners of amp_separations; means are by corner."""
    measures = [f(c).alias(f"{n}_{c}") for c in ("corner_distance", "edge_distance") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return separations.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *measures)


def missed_amps(amps: DataFrame, listed: DataFrame, resolution: int) -> DataFrame:
    """(exposure_id, amp, tile) of the amps (exposure_id, amp, and their science WCS and box) that overlap a tile without being listed there."""
    tiles = footprint_tiles(amps.withColumn("exposure_id", F.struct("exposure_id", "amp")), resolution)
    return tiles.select("exposure_id.exposure_id", "exposure_id.amp", "tile").join(listed.select("exposure_id", "amp", "tile").distinct(), ["exposure_id", "amp", "tile"], "left_anti")
