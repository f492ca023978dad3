"""What the fourth round's findings were about, on tables made for them."""

import datetime

import duckdb
from pyspark.sql import functions as F

from zonewise.plans.queries import ORACLE_SQL, QUERIES


def tables(tmp_path, **sql):
    """A folder of tables, each from DuckDB's SQL, and a connection that has them as views."""
    con = duckdb.connect()
    for name, text in sql.items():
        con.sql(f"COPY ({text}) TO '{tmp_path}/{name}.parquet'")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    return str(tmp_path), con


def same(spark, con, folder, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(columns).collect()), key=repr)
    assert got == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall(), key=repr)
    return got


def test_dates_at_the_end_of_a_second_and_on_half_of_a_place(spark, tmp_path):
    ends = "SELECT make_timestamp(1704067200000000 + i * 1000000 + m) AS ts FROM range(0, 400000, 977) r(i), (VALUES (0), (1), (999991), (999995), (999999)) v(m)"
    halves = "SELECT make_timestamp(1704067200000000 + 864000 * i + 432000 + m) AS ts FROM range(4000) r(i), (VALUES (-1), (0), (1)) v(m)"
    folder, con = tables(tmp_path, events=f"SELECT row_number() OVER () AS event_id, ts FROM ({ends} UNION ALL {halves})")
    assert len(same(spark, con, folder, "dates")) > 12_000


SF = "/root/testdata/sf0.001"


def test_a_cell_is_not_much_larger_than_a_circle():
    from zonewise.operators import spatial

    assert spatial.zone_height(1.0) <= 2.0
    heights = spatial.class_heights()
    assert all(b <= 2 * a for a, b in zip(heights, heights[1:], strict=False))


def test_flags_bring_the_probability_with_the_pairs(spark):
    """Pairs are joined with nothing: a join of all pairs with the objects shuffles them."""
    plan = QUERIES["dia_flags"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # the cells', and the sources'


def test_closest_of_equal_distances(spark):
    from zonewise.operators import match

    first = spark.createDataFrame([(1, 10.0, 0.0), (2, 20.0, 0.0), (3, 50.0, 0.0)], "id bigint, ra double, dec double")
    around = [(0.001, 0.0), (-0.001, 0.0), (0.0, 0.001), (0.004, 0.0), (-0.004, 0.0), (0.0, -0.004), (0.0, 0.0049)]
    rows = [(100 * k + i, ra + x, y) for k, ra in ((1, 10.0), (2, 20.0)) for i, (x, y) in enumerate([*around, *around])]
    second = spark.createDataFrame([*rows, (7, 50.0, 0.02)], "id bigint, ra double, dec double").withColumn("w", F.col("id") % 7)
    pairs = match.distance_match(first, second, 0.005).collect()
    made = {r["first"]: r for r in match.closest(first, second, 0.005, farthest=True, carried={"w": F.col("w")}).collect()}
    assert set(made) == {1, 2}
    for k, r in made.items():
        of_k = [(p.distance, p.second) for p in pairs if p.first == k]
        assert (r["distance"], r["second"]) == min(of_k) and r["farthest"] == max(of_k)[1] and r["n_matches"] == len(of_k) == 14
        assert r["w"] == max(s % 7 for _, s in of_k)


def test_no_repeated_side_is_broadcast(spark):
    for name in ("box_overlap_mixed", "spherical_overlap_mixed", "distance_match"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_pairs_of_boxes_that_wrap_need_not_be_made_distinct(spark):
    from zonewise.operators import spatial

    def boxes(*rows):
        return spark.createDataFrame(rows, "id bigint, min0 double, max0 double, min1 double, max1 double")

    rows = [(10.0, 20.0), (350.0, 375.0), (340.0, 725.0), (0.0, 355.0), (0.0, 1.0), (359.0, 360.0), (359.0, 361.0), (2.0, 359.5), (350.0, 709.0), (0.0, 0.0), (360.0, 360.0), (5.0, 3.0)]
    all_ = boxes(*((k, a, z, 0.0, 1.0) for k, (a, z) in enumerate(rows)))
    met = spatial.box_join(all_, all_, spherical=True)
    assert met._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 0

    def covers(a, z):
        return [(0.0, 360.0)] if z - a >= 360 else [(a % 360, z % 360)] if a % 360 <= z % 360 else [(a % 360, 360.0), (0.0, z % 360)]

    def meet(p, q):
        return any(a <= d + t and z + 0.0 >= c + t for a, z in covers(*p) for c, d in covers(*q) for t in (-360, 0, 360))

    assert sorted(map(tuple, met.collect())) == [(i, j) for i, p in enumerate(rows) for j, q in enumerate(rows) if meet(p, q)]


def test_filters_stay_above_long_expressions(spark):
    from zonewise.functions import sphere

    df = sphere.once(spark.range(9), y=F.sin(F.col("id"))).filter("y > 0 AND y < 0.9 AND NOT isnan(y)")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SIN(") == 1 and sorted(r.id for r in df.collect()) == [1, 3, 7]


def test_footprints_are_dealt_out(spark):
    """Exposures lie in one small file: each level of the descent was one task."""
    assert QUERIES["footprint_tiles"](spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_points_of_ellipses_are_counted_without_lists(spark, monkeypatch):
    from zonewise.operators import match

    monkeypatch.setattr(match, "grouped", lambda pairs: 1 / 0)
    assert QUERIES["ellipse_grouped"](spark, "/root/testdata/sf0.01").count() == 39
