"""Spherical geometry as column expressions. Angles are degrees unless a name says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a circle reaches this close to a pole it is taken to hold all right ascensions.
POLE = 89.9

Vector = tuple[Column, Column, Column]


def unit_vector(ra: Column, dec: Column) -> Vector:
    r, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(r), F.cos(d) * F.sin(r), F.sin(d)


def without_constraints(df: DataFrame) -> DataFrame:
    """``df``, in whose session the optimizer no longer propagates constraints.

    It holds every alias of a projection against every constraint below and doubles them with each
    that occurs in another; with some twenty aliases of long expressions planning does not end.
    """
    df.sparkSession.conf.set("spark.sql.constraintPropagation.enabled", "false")
    return df


def staged(df: DataFrame, **vectors: Vector) -> tuple[DataFrame, ...]:
    """``df`` with vectors as columns <name>_0, _1, _2, and the vectors as those columns.

    Long expressions that are used in several places are so written down, and computed, once.
    """
    made = without_constraints(df).withColumns({f"{name}_{k}": c for name, v in vectors.items() for k, c in enumerate(v)})
    return made, *(tuple(F.col(f"{name}_{k}") for k in range(3)) for name in vectors)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that filters above it read as they are.

    A filter on a projection's column goes below the projection, where the expression is written out for
    each time that the filter names it. It doesn't go below a generator that makes the column.
    """
    made = df.withColumn("__once", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
    return made.withColumns({n: F.col(f"__once.{n}") for n in columns}).drop("__once")


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Vector, by: Column) -> Vector:
    return a[0] * by, a[1] * by, a[2] * by


def plus(a: Vector, b: Vector) -> Vector:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def chord2(a: Vector, b: Vector) -> Column:
    """Squared distance of unit vectors."""
    x, y, z = a[0] - b[0], a[1] - b[1], a[2] - b[2]
    return x * x + y * y + z * z


def chord2_of_angle(degrees: float) -> float:
    if degrees < 0:
        raise ValueError("a radius is not negative")
    return 4 * math.sin(math.radians(degrees) / 2) ** 2


def angle_of_chord2(d2: Column) -> Column:
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), 0.5 * F.sqrt(d2))))


def separation(a: Vector, b: Vector) -> Column:
    """The angle between two vectors of any length."""
    return F.degrees(F.atan2(norm(cross(a, b)), dot(a, b)))


def arc_distance(p: Vector, a: Vector, b: Vector) -> Column:
    """The angle between a vector and the shorter great-circle arc from a to b (vectors of any length, less than half a turn apart).

    Over the arc, between the planes through its ends that are square to it, it is the height above the
    arc's plane; elsewhere the nearer end's angle. An arc without length is its end.
    """
    n = cross(a, b)
    over = (dot(cross(n, a), p) >= 0) & (dot(cross(n, b), p) <= 0) & (norm(n) > 0)
    height = F.degrees(F.abs(F.atan2(dot(p, n), norm(cross(p, n)))))
    return F.when(over, height).otherwise(F.least(separation(p, a), separation(p, b)))


def longitude(a: Vector) -> Column:
    """In [0, 360); 0 at the poles."""
    angle = F.degrees(F.atan2(a[1], a[0]))
    return F.when((a[0] == 0) & (a[1] == 0), F.lit(0.0)).otherwise(F.when(angle < 0, angle + 360).otherwise(angle))


def latitude(a: Vector) -> Column:
    return F.degrees(F.atan2(a[2], F.sqrt(a[0] * a[0] + a[1] * a[1])))


def wrap_ra(ra: Column) -> Column:
    return F.pmod(ra, F.lit(360.0))


def clamp_dec(dec: Column) -> Column:
    return F.greatest(F.lit(-90.0), F.least(F.lit(90.0), dec))


def max_alpha(radius: Column, dec: Column) -> Column:
    """Half the extent in right ascension of the circle around a point; 180 if it comes close to a pole."""
    r, d = F.radians(radius), F.radians(dec)
    near = F.abs(dec) + radius > POLE
    wide = F.degrees(F.atan(F.sin(r) / F.sqrt(F.abs(F.cos(d - r) * F.cos(d + r)))))
    return F.when(radius == 0, F.lit(0.0)).when(near, F.lit(180.0)).otherwise(wide)


def alpha_at(radius: Column, center_dec: Column, dec: Column) -> Column:
    """Half the extent in right ascension of a circle at one declination; 0 where it does not reach, 180 near a pole."""
    r, c, d = F.radians(radius), F.radians(center_dec), F.radians(dec)
    x = F.cos(r) - F.sin(d) * F.sin(c)
    y = F.sqrt(F.greatest(F.lit(0.0), (F.cos(c) * F.cos(d)) * (F.cos(c) * F.cos(d)) - x * x))
    return F.when(F.abs(center_dec) + radius > POLE, F.lit(180.0)).when(F.abs(center_dec - dec) > radius, F.lit(0.0)).otherwise(F.degrees(F.abs(F.atan2(y, x))))


def reduced_range(low: Column, high: Column) -> tuple[Column, Column]:
    """A longitude interval with ends in [0, 360); one that wraps has low > high, a full circle is (0, 360)."""
    full = high - low >= 360
    return F.when(full, 0.0).otherwise(wrap_ra(low)), F.when(full, 360.0).otherwise(wrap_ra(high))


def north_east(ra: Column, dec: Column) -> tuple[Vector, Vector]:
    """Unit vectors to the east and to the north at a point. At a pole north is (-1, 0, 0), whatever ra is."""
    r, d = F.radians(ra), F.radians(dec)
    pole = F.abs(dec) == 90
    east = (F.when(pole, 0.0).otherwise(-F.sin(r)), F.when(pole, 1.0).otherwise(F.cos(r)), F.lit(0.0))
    north = (F.when(pole, -1.0).otherwise(-F.sin(d) * F.cos(r)), F.when(pole, 0.0).otherwise(-F.sin(d) * F.sin(r)), F.when(pole, 0.0).otherwise(F.cos(d)))
    return east, north


def in_ellipse(point: Vector, ra: Column, dec: Column, semi_major: Column, semi_minor: Column, position_angle: Column) -> Column:
    """Whether a unit vector lies in an ellipse; axes in arcseconds, the angle of the major axis east of north."""
    east, north = north_east(ra, dec)
    x, y = dot(point, east), dot(point, north)
    s, c = F.sin(F.radians(position_angle)), F.cos(F.radians(position_angle))
    along, across = s * x + c * y, c * x - s * y
    a, b = F.radians(semi_major / 3600), F.radians(semi_minor / 3600)
    # the plane through the center holds two caps of the sphere: only the near one counts
    return (dot(point, unit_vector(ra, dec)) > 0) & (along * along / (a * a) + across * across / (b * b) <= 1)


def staged_ellipse(df: DataFrame, ra: Column, dec: Column, semi_major: Column, semi_minor: Column, position_angle: Column, name: str) -> tuple[DataFrame, Vector, Vector, Vector]:
    """``df`` with an ellipse's center and its axes' directions, each divided by the axis' length, as columns, and these; arguments as of in_ellipse."""
    east, north = north_east(ra, dec)
    s, c = F.sin(F.radians(position_angle)), F.cos(F.radians(position_angle))
    a, b = F.radians(semi_major / 3600), F.radians(semi_minor / 3600)
    made, e, n = staged(df, **{f"{name}_east": east, f"{name}_north": north})
    along = tuple((s * x + c * y) / a for x, y in zip(e, n, strict=True))
    across = tuple((c * x - s * y) / b for x, y in zip(e, n, strict=True))
    return staged(made, **{f"{name}_center": unit_vector(ra, dec), f"{name}_along": along, f"{name}_across": across})


def in_axes(point: Vector, center: Vector, along: Vector, across: Vector) -> Column:
    """in_ellipse, of a staged ellipse."""
    x, y = dot(point, along), dot(point, across)
    return (dot(point, center) > 0) & (x * x + y * y <= 1)


def is_number(c: Column) -> Column:
    """Neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def is_finite(c: Column) -> Column:
    d = c.cast("double")
    return is_number(d) & (F.abs(d) != float("inf"))
