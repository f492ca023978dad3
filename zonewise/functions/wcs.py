"""World coordinates: the tangent-plane projection and its SIP distortion as column expressions.

A WCS is the columns crval1, crval2 (degrees), crpix1, crpix2, cd1_1, cd1_2, cd2_1, cd2_2 with the FITS
meaning (first pixel 1, degrees a pixel). Pixel positions in arguments count from 0. With sip=True the
columns of with_sip_terms give the distortion of the pixel plane as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sphere import Vector, dot, latitude, longitude, north_east, once, plus, scaled, staged, unit_vector

WCS = ("crval1", "crval2", "crpix1", "crpix2", "cd1_1", "cd1_2", "cd2_1", "cd2_2")


SIP = ("sip_a", "sip_b", "sip_ap", "sip_bp")
#: Newton's steps that invert a distortion without an inverse polynomial, and the pixels by which the result may miss its target, as a share of the distance from crpix (1 at least).
NEWTON_STEPS, MISS = 12, 1e-10
#: A step from so near, by the same measure, is the last one: it squares what is missed.
ARRIVED = 1e-9


def with_sip_terms(exposures: DataFrame, sip: str = "sip") -> DataFrame:
    """``exposures`` with SIP: the terms (p, q, c) of the map ``sip``, whose keys are a_p_q, b_p_q, ap_p_q and bp_p_q; no map has none."""

    def terms(letters: str) -> Column:
        mine = F.filter(F.map_entries(F.col(sip)), lambda e: F.element_at(F.split(e["key"], "_"), 1) == letters)
        made = F.transform(mine, lambda e: F.struct(F.element_at(F.split(e["key"], "_"), 2).cast("int").alias("p"), F.element_at(F.split(e["key"], "_"), 3).cast("int").alias("q"), e["value"].cast("double").alias("c")))
        return F.coalesce(made, F.array().cast("array<struct<p: int, q: int, c: double>>"))

    return exposures.withColumns({name: terms(name[4:]) for name in SIP})


def sip_shift(terms: Column, u: Column, v: Column) -> Column:
    """The sum of c * u**p * v**q over terms, of pixel offsets from crpix."""
    return F.aggregate(terms, F.lit(0.0), lambda total, t: total + t["c"] * F.pow(u, t["p"]) * F.pow(v, t["q"]))


def _slope(terms: Column, u: Column, v: Column, by: str) -> Column:
    """The derivative of sip_shift by u (p) or v (q)."""
    low = {k: F.lit(1 if k == by else 0) for k in "pq"}

    def term(t: Column) -> Column:
        return F.when(t[by] > 0, t["c"] * t[by] * F.pow(u, t["p"] - low["p"]) * F.pow(v, t["q"] - low["q"])).otherwise(0.0)

    return F.aggregate(terms, F.lit(0.0), lambda total, t: total + term(t))


def _undistorted(a: Column, b: Column, p: Column, q: Column) -> Column:
    """struct(u, v) that the distortion with terms a and b moves to (p, q), by Newton's method from there; NaN where it does not get there."""

    def missed(s: Column) -> tuple[Column, Column]:
        return s["u"] + sip_shift(a, s["u"], s["v"]) - s["p"], s["v"] + sip_shift(b, s["u"], s["v"]) - s["q"]

    def step(s: Column, _: Column) -> Column:
        # what a step needs more than once goes through a one-element array, so that it is computed once
        f, g = missed(s)
        parts = F.struct(f.alias("f"), g.alias("g"), *((_slope(terms, s["u"], s["v"], k) + F.lit(1.0 if diagonal else 0.0)).alias(name) for name, terms, k, diagonal in (("fu", a, "p", True), ("fv", a, "q", False), ("gu", b, "p", False), ("gv", b, "q", True))))

        def moved(m: Column) -> Column:
            det = m["fu"] * m["gv"] - m["fv"] * m["gu"]
            small = F.greatest(F.abs(m["f"]), F.abs(m["g"])) <= ARRIVED * F.greatest(F.lit(1.0), F.abs(s["p"]), F.abs(s["q"]))
            return F.struct(s["p"].alias("p"), s["q"].alias("q"), (s["u"] - F.try_divide(m["gv"] * m["f"] - m["fv"] * m["g"], det)).alias("u"), (s["v"] - F.try_divide(m["fu"] * m["g"] - m["gu"] * m["f"], det)).alias("v"), F.coalesce(small, F.lit(False)).alias("there"))

        # one step from where it nearly is there, and none after
        return F.when(s["there"], s).otherwise(F.element_at(F.transform(F.array(parts), moved), 1))

    def checked(s: Column) -> Column:
        f, g = missed(s)
        near = F.greatest(F.abs(f), F.abs(g)) <= MISS * F.greatest(F.lit(1.0), F.abs(s["p"]), F.abs(s["q"]))
        nan = F.lit(float("nan"))
        return F.struct(*(F.when(F.coalesce(near, F.lit(False)), s[k]).otherwise(nan).alias(k) for k in "uv"))

    start = F.struct(p.alias("p"), q.alias("q"), p.alias("u"), q.alias("v"), F.lit(False).alias("there"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, step, checked)


def _c(prefix: str) -> dict[str, Column]:
    return {n: F.col(prefix + n) for n in WCS}


def plane_to_vector(xi: Column, eta: Column, ra0: Column, dec0: Column) -> Vector:
    """The unit vector of a point (degrees to the east and north) of the plane that touches the sphere at (ra0, dec0)."""
    east, north = north_east(ra0, dec0)
    v = plus(plus(unit_vector(ra0, dec0), scaled(east, F.radians(xi))), scaled(north, F.radians(eta)))
    size = F.sqrt(dot(v, v))
    return v[0] / size, v[1] / size, v[2] / size


def vector_to_plane(v: Vector, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    """(xi, eta) in degrees; NaN for points of the far hemisphere, which the plane does not have."""
    east, north = north_east(ra0, dec0)
    front = dot(v, unit_vector(ra0, dec0))
    nan = F.lit(float("nan"))
    return F.when(front > 0, F.degrees(dot(v, east) / front)).otherwise(nan), F.when(front > 0, F.degrees(dot(v, north) / front)).otherwise(nan)


def pixel_to_sky(x: Column, y: Column, prefix: str = "", sip: bool = False) -> Vector:
    w = _c(prefix)
    u, v = x + 1 - w["crpix1"], y + 1 - w["crpix2"]
    if sip:
        u, v = u + sip_shift(F.col(f"{prefix}sip_a"), u, v), v + sip_shift(F.col(f"{prefix}sip_b"), u, v)
    return plane_to_vector(w["cd1_1"] * u + w["cd1_2"] * v, w["cd2_1"] * u + w["cd2_2"] * v, w["crval1"], w["crval2"])


def _offsets(v: Vector, w: dict[str, Column]) -> tuple[Column, Column]:
    """Where a direction is seen from crpix, in pixels of the undistorted plane."""
    xi, eta = vector_to_plane(v, w["crval1"], w["crval2"])
    det = w["cd1_1"] * w["cd2_2"] - w["cd1_2"] * w["cd2_1"]
    return (w["cd2_2"] * xi - w["cd1_2"] * eta) / det, (w["cd1_1"] * eta - w["cd2_1"] * xi) / det


def sky_to_pixel(v: Vector, prefix: str = "") -> tuple[Column, Column]:
    """Pixel positions without a distortion; NaN on the far hemisphere."""
    w = _c(prefix)
    p, q = _offsets(v, w)
    return p + w["crpix1"] - 1, q + w["crpix2"] - 1


def staged_plane(df: DataFrame, name: str, prefix: str = "") -> tuple[DataFrame, Vector, Vector, Vector]:
    """``df`` with an exposure's middle and its pixel axes as columns, and these: what seen_from needs of a WCS, without a sine for each direction."""
    w = _c(prefix)
    east, north = north_east(w["crval1"], w["crval2"])
    per = F.degrees(F.lit(1.0)) / (w["cd1_1"] * w["cd2_2"] - w["cd1_2"] * w["cd2_1"])
    made, e, n, middle = staged(df, **{f"{name}_east": east, f"{name}_north": north, f"{name}_middle": unit_vector(w["crval1"], w["crval2"])})
    along = tuple((w["cd2_2"] * a - w["cd1_2"] * b) * per for a, b in zip(e, n, strict=True))
    up = tuple((w["cd1_1"] * b - w["cd2_1"] * a) * per for a, b in zip(e, n, strict=True))
    made, along, up = staged(made, **{f"{name}_along": along, f"{name}_up": up})
    return made, middle, along, up


def _seen_from(v: Vector, plane: tuple[Vector, Vector, Vector]) -> tuple[Column, Column]:
    """_offsets, of a staged plane."""
    middle, along, up = plane
    front, nan = dot(v, middle), F.lit(float("nan"))
    return F.when(front > 0, dot(v, along) / front).otherwise(nan), F.when(front > 0, dot(v, up) / front).otherwise(nan)


def on_seen(df: DataFrame, v: Vector, plane: tuple[Vector, Vector, Vector], sip: bool = False) -> DataFrame:
    """The rows of ``df`` whose direction falls on their exposure (crpix1, crpix2, x0, y0, width, height[, SIP]), under a staged plane."""
    p, q = _seen_from(v, plane)
    made = once(df, __u=p, __v=q)
    if sip:
        a, b, ap, bp = (F.col(name) for name in SIP)
        made = once(made, __uv=_straightened(a, b, ap, bp, F.col("__u"), F.col("__v"))).withColumns({"__u": F.col("__uv.u"), "__v": F.col("__uv.v")})
    w = _c("")
    return made.filter(on_exposure(F.col("__u") + w["crpix1"] - 1, F.col("__v") + w["crpix2"] - 1, *(F.col(c) for c in ("x0", "y0", "width", "height"))))


def _straightened(a: Column, b: Column, ap: Column, bp: Column, p: Column, q: Column) -> Column:
    """struct(u, v) of offsets without the distortion: by its inverse polynomials where there are any, else by Newton's method."""
    straight = F.struct(p.alias("u"), q.alias("v"))
    inverse = F.struct((p + sip_shift(ap, p, q)).alias("u"), (q + sip_shift(bp, p, q)).alias("v"))
    return F.when((F.size(ap) > 0) | (F.size(bp) > 0), inverse).when((F.size(a) == 0) & (F.size(b) == 0), straight).otherwise(_undistorted(a, b, p, q))


def with_pixels(df: DataFrame, v: Vector, x: str = "x", y: str = "y", prefix: str = "", sip: bool = False) -> DataFrame:
    """``df`` with the pixel positions of directions as columns x and y.

    A distortion is taken back by its inverse polynomials where there are any, else by Newton's method:
    NaN on the far hemisphere, and where the distortion has no inverse that the method reaches. What is
    used more than once is a column, so that it is computed once.
    """
    w = _c(prefix)
    if not sip:
        return df.withColumns(dict(zip((x, y), sky_to_pixel(v, prefix), strict=True)))
    p, q = _offsets(v, w)
    a, b, ap, bp = (F.col(f"{prefix}{name}") for name in SIP)
    made = df.withColumns({"__p": p, "__q": q})
    made = made.withColumn("__uv", _straightened(a, b, ap, bp, F.col("__p"), F.col("__q")))
    return made.withColumns({x: F.col("__uv.u") + w["crpix1"] - 1, y: F.col("__uv.v") + w["crpix2"] - 1}).drop("__p", "__q", "__uv")


def on_exposure(x: Column, y: Column, x0: Column, y0: Column, width: Column, height: Column) -> Column:
    """Whether a pixel position lies on an image whose first pixel's middle is (x0, y0), edges included; not for NaN."""
    inside = x.between(x0 - 0.5, x0 + width - 0.5) & y.between(y0 - 0.5, y0 + height - 0.5)
    return F.coalesce(inside & ~F.isnan(x) & ~F.isnan(y), F.lit(False))


def pixel_to_plane(df: DataFrame, x: Column, y: Column, ra0: Column, dec0: Column, names: Sequence[str], step: float = 8.0, prefix: str = "", sip: bool = False) -> DataFrame:
    """``df`` with the affine map from pixels around (x, y) to the N,E plane at (ra0, dec0), in radians: six columns m11, m12, m21, m22, east, north.

    By forward differences over ``step`` pixels; east and north are where (x, y) itself goes.
    """
    east, north = north_east(ra0, dec0)
    made, e, n, origin, a, b, c = staged(df, __east=east, __north=north, __origin=unit_vector(ra0, dec0), __a=pixel_to_sky(x, y, prefix, sip), __b=pixel_to_sky(x + step, y, prefix, sip), __c=pixel_to_sky(x, y + step, prefix, sip))
    places = [(dot(v, axis) / dot(v, origin)) for v in (a, b, c) for axis in (e, n)]
    made = made.withColumns({f"__p{k}": p for k, p in enumerate(places)})
    p = [F.col(f"__p{k}") for k in range(6)]
    values = ((p[2] - p[0]) / step, (p[4] - p[0]) / step, (p[3] - p[1]) / step, (p[5] - p[1]) / step, p[0], p[1])
    return made.select(*df.columns, *(v.alias(name) for name, v in zip(names, values, strict=True)))


def coordinate_errors(df: DataFrame, x: Column, y: Column, vxx: Column, vyy: Column, vxy: Column, prefix: str = "", sip: bool = False) -> DataFrame:
    """``df`` with ra_var, dec_var, ra_dec_cov in rad**2 of sources, from their centroids' pixel covariance by the map linearised there.

    NaN off the diagonal counts as 0; NaN or null on it gives null. 32-bit floats, as catalogs hold
    them, of the coordinates themselves: ra without the cosine of the declination.
    """
    made, v = staged(df, __at=pixel_to_sky(x, y, prefix, sip))
    made = made.withColumns({"__ra": longitude(v), "__dec": latitude(v)})
    made = pixel_to_plane(made, x, y, F.col("__ra"), F.col("__dec"), ("__m0", "__m1", "__m2", "__m3", "__e", "__n"), 1.0 / 64, prefix, sip)
    m = [F.col(f"__m{k}") for k in range(4)]
    off = F.when(vxy.isNull() | F.isnan(vxy), F.lit(0.0)).otherwise(vxy.cast("double"))
    a, b, cos = vxx.cast("double"), vyy.cast("double"), F.cos(F.radians("__dec"))
    ra = (m[0] * m[0] * a + 2 * m[0] * m[1] * off + m[1] * m[1] * b) / (cos * cos)
    dec = m[2] * m[2] * a + 2 * m[2] * m[3] * off + m[3] * m[3] * b
    both = (m[0] * m[2] * a + (m[0] * m[3] + m[1] * m[2]) * off + m[1] * m[3] * b) / cos
    fine = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    return made.select(*df.columns, *(F.when(fine, c).cast("float").alias(n) for n, c in (("ra_var", ra), ("dec_var", dec), ("ra_dec_cov", both))))
