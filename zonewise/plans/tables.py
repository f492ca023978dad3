"""Sky tables derived from the driver's business tables, as frames and as SQL of the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILTERS = ("u", "g", "r", "i", "z", "y")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _wide(ra: str, dec: str) -> tuple[str, str]:
    return f"CASE WHEN {ra} < 0 THEN {ra} + 360e0 WHEN {ra} >= 360 THEN {ra} - 360e0 ELSE {ra} END", dec


#: Positions over the whole sky, one for each customer, and near them one for each order.
_OBJECT = ("((k * 7919) % 36000) / 1e2", "(((k * 104729) % 17000) - 8500) / 1e2")
_DIA = _wide(f"({_OBJECT[0]} + ((o_orderkey % 11) - 5) / 1e3)", f"{_OBJECT[1]} + ((o_orderkey % 7) - 3) / 1e3")
#: Dense positions in a field of 2 by 2 degrees, off any lattice.
_DENSE = ("1e1 + ((k * 7919) % 2000) / 1e3 + (k % 97) * 1.37e-5", "((k * 104729) % 2000) / 1e3 - 1e0 + (k % 89) * 0.93e-5")
_DENSE2 = ("1e1 + ((k * 15485863) % 2000) / 1e3 + (k % 83) * 1.71e-5", "((k * 32452843) % 2000) / 1e3 - 1e0 + (k % 79) * 1.13e-5")

#: From a hundredth of a degree to half a turn, the wider the rarer.
_EXTENT = "CASE WHEN {0} < 2 THEN 1.8e2 WHEN {0} < 5 THEN 4.7e1 WHEN {0} < 12 THEN 1.1e1 WHEN {0} < 40 THEN 2.3e0 WHEN {0} < 150 THEN 3e-1 WHEN {0} < 400 THEN 4e-2 ELSE 1e-2 END"

# each: source table, its key as k, and the columns; the text is both Spark's and DuckDB's
VIEWS: dict[str, tuple[str, str]] = {
    "object": ("SELECT c_custkey AS k FROM customer", f"k AS id, {_OBJECT[0]} AS ra, {_OBJECT[1]} AS dec"),
    "dia": ("SELECT o_orderkey, o_custkey AS k FROM orders", f"o_orderkey AS id, {_DIA[0]} AS ra, {_DIA[1]} AS dec, o_orderkey % 32 AS classification, CASE WHEN o_orderkey % 3 = 0 THEN 1073741824 + o_orderkey % 7 ELSE o_orderkey % 7 END AS pair_id, CAST(NULL AS BIGINT) AS object_id"),
    "dense": ("SELECT p_partkey AS k FROM part", f"k AS id, {_DENSE[0]} AS ra, {_DENSE[1]} AS dec, (k * 37) % 101 AS p1"),
    # clumps of seven points with cores, borders and strays
    "clump": ("SELECT p_partkey AS k FROM part", "k AS id, 1e1 + ((k - k % 7) * 7919 % 20000) / 1e4 + (k % 7) * (k % 11) * 3.1e-4 + (k % 97) * 1.37e-6 AS ra, ((k - k % 7) * 104729 % 20000) / 1e4 - 1e0 + (k % 5) * (k % 13) * 2.3e-4 + (k % 89) * 0.93e-6 AS dec"),
    "dense_src": ("SELECT c_custkey AS k FROM customer", f"k AS id, {_DENSE2[0]} AS ra, {_DENSE2[1]} AS dec, k % 32 AS classification, CASE WHEN k % 3 = 0 THEN 1073741824 + k ELSE k END AS pair_id, CAST(NULL AS BIGINT) AS object_id, k * 1.5e0 AS flux, 1e0 + k % 7 AS flux_err"),
    "ellipse": ("SELECT s_suppkey AS k FROM supplier", f"k AS id, {_DENSE2[0]} AS ra, {_DENSE2[1]} AS dec, 150e0 + (k % 13) * 20e0 AS smaa, 60e0 + (k % 7) * 12e0 AS smia, (k * 17 % 180) * 1e0 AS pa"),
    "source": (
        "SELECT *, l_orderkey * 8 + l_linenumber AS id FROM lineitem",
        "id, l_partkey AS cluster_id, 1e1 + (l_partkey % 40) * 5e-2 + ((id % 21) - 10) * 1.0037e-5 + (id % 101) * 1.7e-8 AS ra, -1e0 + (l_partkey % 37) * 5e-2 + ((id % 17) - 8) * 1.0041e-5 + (id % 103) * 1.9e-8 AS dec, "
        "l_suppkey AS exposure_id, l_suppkey % 6 AS filter_id, 5e4 + l_suppkey + l_linenumber * 1e-2 AS time_mid, l_quantity * 2e1 + id % 13 AS x, l_discount * 9e3 + l_tax * 1e3 AS y, "
        "CASE WHEN id % 31 = 0 THEN CAST('NaN' AS DOUBLE) WHEN id % 29 = 0 THEN -1e0 ELSE 1e-2 + (id % 7) * 1e-3 END AS x_var, 2e-2 + (id % 5) * 1e-3 AS y_var, CASE WHEN id % 3 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 2e-3 END AS xy_cov, "
        "CASE WHEN id % 23 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_extendedprice END AS flux, CASE WHEN id % 19 = 0 THEN 0e0 ELSE l_tax * 1e2 + 1e0 END AS flux_err, "
        "CASE WHEN id % 37 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 2e0 + (id % 11) * 1.01379137461e-1 END AS ixx, 3e0 + (id % 9) * 1.01713719377e-1 AS iyy, (id % 5) * 1.00917731913e-1 AS ixy, 1e-2 + (id % 3) * 1e-3 AS s_var, CASE WHEN id % 2 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 1e-3 END AS s_cov, "
        "l_returnflag = 'R' AS flag_r, l_linestatus = 'F' AND l_quantity > 45 AS flag_f",
    ),
    "exposure": (
        "SELECT s_suppkey AS k FROM supplier",
        "k AS exposure_id, CAST(k % 6 AS INT) AS filter_id, 1e1 + (k % 20) * 1e-1 AS crval1, -1e0 + (k % 19) * 1e-1 AS crval2, 5e2 AS crpix1, 4e2 AS crpix2, "
        "2e-4 * cos((k % 7) * 1e-1) AS cd1_1, -2e-4 * sin((k % 7) * 1e-1) AS cd1_2, 2e-4 * sin((k % 7) * 1e-1) AS cd2_1, 2e-4 * cos((k % 7) * 1e-1) AS cd2_2, "
        "CAST(0 AS INT) AS x0, CAST(0 AS INT) AS y0, CAST(1000 AS INT) AS width, CAST(800 AS INT) AS height, 5.1e4 + k AS epoch, 1e3 + k AS flux_mag0, (k % 4) * 1e0 AS flux_mag0_err",
    ),
    "box": ("SELECT o_orderkey AS k FROM orders", "k AS id, (k * 7919 % 36000) / 1e2 AS min0, (k * 7919 % 36000) / 1e2 + (k % 5) * 1e-1 AS max0, (k * 104729 % 17000) / 1e2 - 8.5e1 AS min1, (k * 104729 % 17000) / 1e2 - 8.5e1 + (k % 3) * 1e-1 AS max1"),
    "box2": ("SELECT c_custkey AS k FROM customer", "k AS id, (k * 15485863 % 36000) / 1e2 + 5e-3 AS min0, (k * 15485863 % 36000) / 1e2 + 5e-3 + (k % 7) * 2e-1 AS max0, (k * 32452843 % 17000) / 1e2 - 8.5e1 + 5e-3 AS min1, (k * 32452843 % 17000) / 1e2 - 8.5e1 + 5e-3 + (k % 4) * 2e-1 AS max1"),
    # most are small, one in a few hundred spans up to half the sky along an axis
    "wide_box": ("SELECT o_orderkey AS k FROM orders", f"k AS id, (k * 7919 % 36000) / 1e2 AS min0, (k * 7919 % 36000) / 1e2 + {_EXTENT.format('k % 997')} AS max0, (k * 104729 % 17000) / 1e2 - 8.5e1 AS min1, (k * 104729 % 17000) / 1e2 - 8.5e1 + {_EXTENT.format('k % 991')} AS max1"),
    "wide_box2": ("SELECT c_custkey AS k FROM customer", f"k AS id, (k * 15485863 % 36000) / 1e2 + 5e-3 AS min0, (k * 15485863 % 36000) / 1e2 + 5e-3 + {_EXTENT.format('k % 499')} AS max0, (k * 32452843 % 17000) / 1e2 - 8.5e1 + 5e-3 AS min1, (k * 32452843 % 17000) / 1e2 - 8.5e1 + 5e-3 + {_EXTENT.format('k % 503')} AS max1"),
    "star": (
        "SELECT p_partkey AS k FROM part",
        f"k AS id, 5e4 + k % 1000 AS epoch, {_DENSE[0]} AS ra, {_DENSE[1]} AS decl, CASE WHEN k % 10 = 0 THEN CAST(NULL AS DOUBLE) ELSE ((k % 41) - 20) * 5e1 END AS \"muRa\", ((k % 31) - 15) * 5e1 AS \"muDecl\", (k % 9) * 1e0 AS parallax, ((k % 21) - 10) * 5e0 AS \"vRad\"",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a frame."""
    inner, columns = VIEWS[name]
    table = inner.rsplit(" ", 1)[1]
    columns = columns.replace('"muRa"', "muRa").replace('"muDecl"', "muDecl").replace('"vRad"', "vRad")
    # the frame is named in this statement only, so that tables of other folders are not touched
    return spark.sql(f"SELECT {columns} FROM ({inner.replace(f' FROM {table}', ' FROM {source}')})", source=read(spark, sf_dir, table))


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a local one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(root or tempfile.gettempdir() + '/zonewise').rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cte(*names: str) -> str:
    """Derived tables as the WITH clause of a DuckDB query."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {VIEWS[n][1]} FROM ({VIEWS[n][0]}))" for n in names)


def var_prob(p: str = "p1"):
    """Six probabilities of variability, of which the second is ``p``."""
    return F.array(*(F.col(p).cast("smallint") if k == 1 else F.lit(0).cast("smallint") for k in range(6)))


# -- SQL of spherical geometry, written for DuckDB


def sql_chord2(a: str, b: str) -> str:
    """Of rows a and b with ra and dec, by the haversine."""
    return f"(4 * (power(sin(radians({a}.dec - {b}.dec) / 2), 2) + cos(radians({a}.dec)) * cos(radians({b}.dec)) * power(sin(radians({a}.ra - {b}.ra) / 2), 2)))"


def sql_angle(d2: str) -> str:
    return f"degrees(2 * asin(least(1, sqrt({d2}) / 2)))"


def sql_near(a: str, b: str, degrees: float) -> str:
    return f"abs({a}.dec - {b}.dec) <= {degrees * 1.001} AND {sql_chord2(a, b)} < 4 * power(sin(radians({degrees}) / 2), 2)"


def sql_xyz(ra: str, dec: str, prefix: str) -> str:
    return f"cos(radians({dec})) * cos(radians({ra})) AS {prefix}x, cos(radians({dec})) * sin(radians({ra})) AS {prefix}y, sin(radians({dec})) AS {prefix}z"


def sql_pixel_xyz(x: str, y: str, p: str) -> list[str]:
    """Unnormalised direction of a pixel under the WCS in scope."""
    u, v = f"({x} + 1 - crpix1)", f"({y} + 1 - crpix2)"
    xi, eta = f"radians(cd1_1 * {u} + cd1_2 * {v})", f"radians(cd2_1 * {u} + cd2_2 * {v})"
    a, d = "radians(crval1)", "radians(crval2)"
    return [f"(cos({d}) * cos({a}) - {xi} * sin({a}) - {eta} * sin({d}) * cos({a})) AS {p}x", f"(cos({d}) * sin({a}) + {xi} * cos({a}) - {eta} * sin({d}) * sin({a})) AS {p}y", f"(sin({d}) + {eta} * cos({d})) AS {p}z"]


def sql_plane(p: str, ra: str, dec: str) -> tuple[str, str]:
    """(east, north) in the plane at (ra, dec) of the direction px, py, pz."""
    a, d = f"radians({ra})", f"radians({dec})"
    front = f"(cos({d}) * cos({a}) * {p}x + cos({d}) * sin({a}) * {p}y + sin({d}) * {p}z)"
    return f"((cos({a}) * {p}y - sin({a}) * {p}x) / {front})", f"((cos({d}) * {p}z - sin({d}) * cos({a}) * {p}x - sin({d}) * sin({a}) * {p}y) / {front})"
