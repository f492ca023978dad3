import math
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from zonewise.functions import sphere, tiles, wcs
from zonewise.functions.earth import earth_vector, heliocentric
from zonewise.operators import cluster, match, qa, spatial
from zonewise.plans.source_assoc import parse_ids
from zonewise.sources import results
from zonewise.sources.dialect import CsvDialect, CsvError, format_record, parse_text, read_csv
from zonewise.sources.exposures import exposures_from_rows, image_exposures
from zonewise.sources.store import VersionConflict, VersionedTable
from zonewise.streaming.visits import VisitError, VisitLog, run_visit

POINTS = "id int, ra double, dec double"


def unit(ra, dec):
    r, d = math.radians(ra), math.radians(dec)
    return np.array([math.cos(d) * math.cos(r), math.cos(d) * math.sin(r), math.sin(d)])


def around(rnd, dec_low, dec_high, n):
    return [(i, rnd.uniform(0, 360) if rnd.random() < 0.5 else rnd.uniform(-2, 2) % 360, rnd.uniform(dec_low, dec_high)) for i in range(n)]


@pytest.mark.parametrize(("low", "high", "radius"), [(88, 90, 0.5), (-90, -88, 0.5), (-1, 1, 0.7), (-90, 90, 8.0), (-1, 1, 0.0)])
def test_distance_match_equals_brute_force(spark, low, high, radius):
    rnd = random.Random(f"{low}{radius}")
    a, b = around(rnd, low, high, 300), around(rnd, low, high, 300)
    b += [(1000 + i, ra, dec) for i, ra, dec in a[:5]]
    limit = 4 * math.sin(math.radians(radius) / 2) ** 2
    va, vb = np.array([unit(*p[1:]) for p in a]), np.array([unit(*p[1:]) for p in b])
    d2 = ((va[:, None] - vb[None]) ** 2).sum(axis=2)
    want = {(a[i][0], b[j][0]) for i, j in zip(*np.nonzero(d2 < limit), strict=True)}
    got = match.distance_match(spark.createDataFrame(a, POINTS), spark.createDataFrame(b, POINTS), radius).collect()
    assert {(r.first, r.second) for r in got} == want and len(got) == len(want)


def test_bad_positions_match_nothing(spark):
    bad = spark.createDataFrame([(1, float("nan"), 0.0), (2, None, 0.0), (3, 0.0, 95.0), (4, 0.0, 0.0)], POINTS)
    assert [(r.first, r.second) for r in match.distance_match(bad, bad, 1.0).collect()] == [(4, 4)]
    with pytest.raises(ValueError):
        match.distance_match(bad, bad, -1.0)


@pytest.mark.parametrize(("low", "high"), [(89, 90), (-90, -89), (-0.5, 0.5)])
def test_ellipse_match(spark, low, high):
    rnd = random.Random(high)
    ellipses = [(i, rnd.uniform(0, 360), rnd.uniform(low, high), 300.0, 100.0, rnd.uniform(0, 180)) for i in range(40)]
    points, want = [], set()
    for i, ra, dec, a, b, pa in ellipses:
        r, d, t = math.radians(ra), math.radians(dec), math.radians(pa)
        east, north = np.array([-math.sin(r), math.cos(r), 0]), np.array([-math.sin(d) * math.cos(r), -math.sin(d) * math.sin(r), math.cos(d)])
        for scale in (0.2, 0.9, 1.2):
            phi = rnd.uniform(0, 2 * math.pi)
            u, v = scale * math.radians(a / 3600) * math.cos(phi), scale * math.radians(b / 3600) * math.sin(phi)
            p = unit(ra, dec) * math.sqrt(1 - u * u - v * v) + east * (u * math.sin(t) + v * math.cos(t)) + north * (u * math.cos(t) - v * math.sin(t))
            points.append((len(points), math.degrees(math.atan2(p[1], p[0])) % 360, math.degrees(math.asin(p[2]))))
            if scale < 1:
                want.add((i, points[-1][0]))
    e = spark.createDataFrame(ellipses, "id int, ra double, dec double, smaa double, smia double, pa double")
    got = {(r.first, r.second) for r in match.ellipse_match(e, spark.createDataFrame(points, POINTS), 300.0).collect()}
    assert want <= got and not {(p // 3, p) for p in range(2, len(points), 3)} & got


def test_box_join_wraps(spark):
    schema = "id int, min0 double, max0 double, min1 double, max1 double"
    a = spark.createDataFrame([(1, 359.0, 1.0, 0.0, 1.0), (2, 10.0, 20.0, 0.0, 1.0), (3, -1.0, 0.5, 0.0, 1.0), (4, 0.0, 360.0, 5.0, 6.0)], schema)
    b = spark.createDataFrame([(1, 0.5, 0.6, 1.0, 2.0), (2, 20.0, 21.0, 0.5, 0.6), (3, 358.0, 359.0, 0.0, 0.0), (4, 100.0, 100.0, 5.5, 5.5)], schema)
    assert sorted(map(tuple, spatial.box_join(a, b, spherical=True).collect())) == [(1, 1), (1, 3), (2, 2), (3, 1), (3, 3), (4, 4)]


def test_streaks_make_clusters(spark):
    points = [(20 * s + i, 10.0 * s + i * 0.5, 0.1 * i) for s in range(5) for i in range(20)]
    made = cluster.cluster(spark.createDataFrame(points, POINTS), cluster.ClusteringControl(2000.0, 2)).collect()
    assert {r.root // 20 for r in made if r.kind == "core"} == set(range(5)) and all(r.root // 20 == r.id // 20 for r in made)
    alone = cluster.cluster(spark.createDataFrame(points[:3], POINTS), cluster.ClusteringControl(1.0, 0)).collect()
    assert {r.kind for r in alone} == {"core"} and {r.root for r in alone} == {0, 1, 2}


def test_tiles_hold_their_places(spark):
    places = [(t, *tiles.tile_center(t, 3, (i + 0.5) / 6, (j + 0.5) / 6)) for t in range(54) for i in range(6) for j in range(6)]
    df = spark.createDataFrame(places, "tile int, ra double, dec double")
    assert df.filter(tiles.sky_tile_id(F.col("ra"), F.col("dec"), 3) != F.col("tile")).count() == 0


def test_chunks_of_circles_hold_their_points(spark):
    zones, rnd = tiles.Decomposition(10, 21), random.Random(3)
    for ra, dec, radius in [(0.5, 0, 3), (359, 60, 2), (10, 88, 3), (10, -89.5, 1), (180, 45, 0.5), (77, 90, 5)]:
        rows = []
        for i in range(300):
            v = unit(ra, dec) + np.array([rnd.gauss(0, 1) for _ in range(3)]) * math.radians(radius)
            rows.append((i, math.degrees(math.atan2(v[1], v[0])) % 360, math.degrees(math.asin(v[2] / np.linalg.norm(v)))))
        inside = [r for r in rows if math.degrees(math.acos(min(1, unit(*r[1:]) @ unit(ra, dec)))) <= radius]
        df = spark.createDataFrame(inside, POINTS).select(zones.chunk(F.col("ra"), F.col("dec")).alias("c"))
        assert {r.c for r in df.collect()} <= set(zones.chunks_of_circle(ra, dec, radius))


def test_earth_is_one_au_from_the_sun():
    days = np.arange(15020, 88069, 101.0)
    r = np.linalg.norm(heliocentric(days), axis=0)
    assert 0.983 < r.min() and r.max() < 1.0171
    assert np.linalg.norm(earth_vector(days) - heliocentric(days), axis=0).max() < 0.011
    x, y, z = earth_vector(np.array([51544.5]))[:, 0]
    assert abs(x + 0.1843) < 1e-4 and abs(y - 0.8848) < 1e-4 and abs(z - 0.3838) < 1e-4


def test_earth_equals_a_published_position():
    """The check values published with the IAU's routine for the Earth's position, TDB 2005-02-10.52501161."""
    sun, barycenter = (-0.7757238809297707, 0.5598052241363340, 0.2426998466481687), (-0.7714104440491112, 0.5598412061824171, 0.2425996277722452)
    day, km = np.array([53411.52501161]), 149597870.7
    assert np.linalg.norm(heliocentric(day)[:, 0] - sun) * km < 300
    assert np.linalg.norm(earth_vector(day)[:, 0] - barycenter) * km < 1200


DIALECTS = [CsvDialect(), CsvDialect(quoting="QUOTE_ALL"), CsvDialect(quoting="QUOTE_NONE"), CsvDialect(double_quote=True, standard_escapes=False, escape=""), CsvDialect(delimiter="\t", trailing_delimiter=True), CsvDialect(has_null=True, null="NULL", standard_escapes=False)]


@pytest.mark.parametrize("dialect", DIALECTS)
def test_dialects_round_trip(dialect):
    nulls = dialect.has_null or dialect.standard_escapes
    records = [["a", "b c", ""], ["", "x,y\tz", "q\"q"], [None if nulls else "n", "l1\nl2\rl3", "back\\slash"], ["'", "end", "\\N"]]
    if not dialect.escape:
        records = [[v.replace("\\", "/") for v in r] for r in records]
    text = "".join(format_record(r, dialect) + "\n" for r in records)
    assert parse_text(text, dialect) == records


def test_dialects_are_checked():
    for wrong in ({"delimiter": "ab"}, {"escape": ","}, {"quote": "\\"}, {"escape": ""}, {"quoting": "SOME"}, {"quote": ""}, {"null": "a,b"}):
        with pytest.raises(CsvError):
            CsvDialect(**wrong)
    for text in ('"open', '"a"b', "a\\x"):
        with pytest.raises(CsvError):
            parse_text(text, CsvDialect())
    assert parse_text('a\\x41\\t,\\N,"\\N"\n\n', CsvDialect()) == [["aA\t", None, "N"], []]


def test_id_lists():
    assert parse_ids("12..15^45") == {12, 13, 14, 45}
    with pytest.raises(ValueError):
        parse_ids("a")


def test_visit_log(spark, tmp_path):
    log = VisitLog(spark, f"{tmp_path}/log")
    for v in range(16):
        log.register(v)
    with pytest.raises(VisitError):
        log.register(3)
    with pytest.raises(VisitError):
        log.register(99)
    log.fail(2)
    log.fail(12345)
    assert not log.is_in_flight(2) and log.end(1) and not log.end(2) and not log.end(3, rollback=True)


def star_table(spark, path):
    base = spark.range(20).selectExpr("id", "CAST(id % 2 AS INT) AS chunk", "0 AS seen")
    table = VersionedTable(spark, str(path), base.schema, "id", ["chunk"])
    table.commit(table.stage_base(base))
    return table


def count_visit(table, chunks):
    """Work of a visit that counts up the objects of its chunks."""

    def work(visit):
        mine = table.read().filter(F.col("chunk").isin(chunks(visit)))
        return table.stage_delta(mine.withColumn("seen", F.col("seen") + 1), mine, chunks(visit))

    return work


def test_a_visit_is_published_once_wherever_the_run_breaks_off(spark, tmp_path):
    table, log = star_table(spark, tmp_path / "t"), VisitLog(spark, f"{tmp_path}/log")
    work, visit = count_visit(table, lambda _: [0, 1]), Row(visit_id=5)
    # between commit and the log's end
    log.register(5)
    table.commit(work(visit), 5)
    assert not run_visit(log, table, visit, work) and not log.is_in_flight(5)
    # before the commit
    log.register(6)
    work(Row(visit_id=6))
    assert run_visit(log, table, Row(visit_id=6), work)
    assert table.visits() == {5, 6} and {r.seen for r in table.read().collect()} == {2}
    # a version that is staged twice for one visit counts once
    table.commit(work(Row(visit_id=6)), 6)
    assert {r.seen for r in table.read().collect()} == {2}


def test_visits_of_other_chunks_do_not_disturb_and_of_the_same_are_worked_again(spark, tmp_path):
    table, log = star_table(spark, tmp_path / "t"), VisitLog(spark, f"{tmp_path}/log")
    work = count_visit(table, lambda v: [v.visit_id % 2])
    staged = {k: work(Row(visit_id=k)) for k in range(4)}
    table.commit(staged[0], 0)
    table.commit(staged[1], 1)
    for k in (2, 3):
        with pytest.raises(VersionConflict):
            table.commit(staged[k], k)
        assert run_visit(log, table, Row(visit_id=k), work)
    assert table.visits() == {0, 1, 2, 3} and {r.seen for r in table.read().collect()} == {2}

    def disturbed(visit, done=[]):  # noqa: B006
        made = work(visit)
        if not done:
            done.append(1)
            table.commit(work(Row(visit_id=8)), 8)
        return made

    assert run_visit(log, table, Row(visit_id=10), disturbed)
    assert {(r.chunk, r.seen) for r in table.read().collect()} == {(0, 4), (1, 2)}
    table.compact()
    assert table.deltas() == 0 and table.visits() == {0, 1, 2, 3, 8, 10} and table.read().count() == 20
    with pytest.raises(ZeroDivisionError):
        run_visit(log, table, Row(visit_id=11), lambda _: 1 / 0)
    assert 11 not in table.visits() and not log.is_in_flight(11)


def test_a_record_ends_with_its_line_whatever_the_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"f{k}.csv").write_text("a,b\n" + "".join(f"{k}{i},x\n" for i in range(5)) + "a,b\n")
    want = sorted([(f"{k}{i}", "x") for k in range(3) for i in range(5)] + [("a", "b")] * 3)
    for rows in ("2", "4096"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            assert sorted(map(tuple, read_csv(spark, str(tmp_path / "in"), CsvDialect(), header=True).collect())) == want
            (tmp_path / "broken.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
            with pytest.raises(Exception, match="ends within a field"):
                read_csv(spark, str(tmp_path / "broken.csv"), CsvDialect(), header=True).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "broken.csv"), CsvDialect(), header=True, multi_line=True).collect())) == [("1", "x\ny"), ("2", "z")]


def test_exposures_of_keys_and_values(spark):
    rows = [(1, "CDELT1", None, 2e-4, None), (1, "CDELT2", None, 3e-4, None), (1, "PC1_2", None, 0.5, None), (1, "NAXIS1", 100, None, None), (1, "NAXIS2", 50, None, None), (1, "LTV1", -7, None, None), (1, "FILTER", None, None, " r "), (1, "FLUXMAG0", None, 10.0, None),
            (2, "CD1_1", None, 1e-4, None), (2, "CDELT1", None, 9.0, None), (2, "A_1_1", None, 0.25, None)]
    names = "id int, metadataKey string, intValue int, doubleValue double, stringValue string"
    one, two = image_exposures(exposures_from_rows(spark.createDataFrame(rows, names), "id"), "id", "ugrizy").orderBy("exposure_id").collect()
    assert (one.cd1_1, one.cd1_2, one.cd2_1, one.cd2_2) == (2e-4, 1e-4, 0.0, 3e-4) and (one.x0, one.y0, one.width, one.height, one.filter_id) == (7, 0, 100, 50, 2)
    assert (one.flux_mag0, one.flux_mag0_err) == (10.0, 0.0) and (two.cd1_1, two.cd2_2, two.flux_mag0, two.filter_id) == (1e-4, 0.0, None, None) and two.sip == {"a_1_1": 0.25}
    for more, said in (((1, "FILTER", None, None, "g"), "twice"), ((2, "FLUXMAG0", None, -1.0, None), "positive"), ((2, "FILTER", None, None, "q"), "unknown filter")):
        with pytest.raises(Exception, match=said):
            image_exposures(exposures_from_rows(spark.createDataFrame([*rows, more], names), "id"), "id", "ugrizy").collect()


def test_covering_image_just_holds_its_tile():
    for tile in (0, 13, 200, 5 * 144 + 7):
        w = tiles.covering_wcs(tile, 12, 500)
        places = np.array([unit(*tiles.tile_center(tile, 12, x, y)) for x in np.linspace(0, 1, 21) for y in np.linspace(0, 1, 21)])
        r, d = math.radians(w["crval1"]), math.radians(w["crval2"])
        east, north, out = np.array([-math.sin(r), math.cos(r), 0]), np.array([-math.sin(d) * math.cos(r), -math.sin(d) * math.sin(r), math.cos(d)]), unit(w["crval1"], w["crval2"])
        pixels = np.degrees(np.stack([places @ east, places @ north]) / (places @ out)) / w["cd1_1"] + w["crpix1"] - 1
        assert pixels.min() >= -0.5 - 1e-6 and pixels.max() <= 499.5 + 1e-6 and (pixels.min() < -0.4 or pixels.max() > 499.4)
    with pytest.raises(TypeError):
        tiles.covering_wcs(0, 12, 1.5)
    with pytest.raises(ValueError, match="pixel"):
        tiles.covering_wcs(0, 12, 0)


def test_results_visits_and_clusters_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 0.1), (3, 4, 1e-300)], results.MATCHES)
    for kind in ("parquet", "tsv"):
        results.write_results(rows, f"{tmp_path}/{kind}", kind)
        assert sorted(map(tuple, results.read_results(spark, f"{tmp_path}/{kind}", kind=kind).collect())) == sorted(map(tuple, rows.collect()))
    results.write_results(spark.createDataFrame([(1, None)], results.PAIRS), f"{tmp_path}/null", "tsv")
    with pytest.raises(Exception, match="has no second"):
        results.read_results(spark, f"{tmp_path}/null", results.PAIRS, "tsv").collect()
    rows.write.parquet(f"{tmp_path}/v/matches/visit_id=7")
    assert results.visit_table(spark, f"{tmp_path}/v", "matches", 7, results.MATCHES).count() == 2
    results.drop_visit(spark, f"{tmp_path}/v", 7)
    assert results.visit_table(spark, f"{tmp_path}/v", "matches", 7, results.MATCHES).count() == 0
    clusters = spark.createDataFrame([(1, 2.0)], "cluster_id long, ra double")
    results.write_clusters(clusters, f"{tmp_path}/c", ["u", "g"], {"ra": "mean right ascension in degrees"})
    back, filters, meanings = results.read_clusters(spark, f"{tmp_path}/c")
    assert back.collect() == clusters.collect() and filters == ["u", "g"] and meanings == {"ra": "mean right ascension in degrees"}
    with pytest.raises(ValueError, match="no clusters"):
        results.read_clusters(spark, f"{tmp_path}/parquet")


def test_a_visit_ends_in_its_order(spark):
    done = []
    steps = {n: (lambda n=n: done.append(n)) for n in ("store", "append", "drop", "rollback")}
    log = results.StepLog()
    results.end_visit(log, **steps, commit=lambda: done.append("commit") or True, toggles=results.OutputToggles(drop_tables=True))
    assert done == ["store", "commit", "append", "drop"] and [r.step for r in log.table(spark).collect()] == done
    done.clear()
    with pytest.raises(RuntimeError, match="did not commit"):
        results.end_visit(log, **steps, commit=lambda: False)
    assert done == ["store"]
    done.clear()
    with pytest.raises(ZeroDivisionError):
        results.end_visit(log, **steps | {"store": lambda: 1 / 0}, commit=lambda: True)
    assert done == ["rollback"] and log.rows[-1][1] == "failed"


def test_distortions_there_and_back(spark):
    forth = {"a_2_0": 3e-6, "a_1_1": -2e-6, "a_0_3": 1e-9, "b_0_2": 4e-6, "b_1_1": 1e-6}
    rows = [(1, forth), (2, forth | {"ap_1_0": 0.25, "bp_0_2": 1e-5}), (3, {}), (4, None)]
    one = spark.createDataFrame(rows, "exposure_id int, sip map<string, double>").selectExpr("*", "10e0 AS crval1", "20e0 AS crval2", "500e0 AS crpix1", "400e0 AS crpix2", "2e-4 AS cd1_1", "1e-5 AS cd1_2", "-1e-5 AS cd2_1", "2e-4 AS cd2_2", "explode(array(0e0, 333e0, 900e0)) AS x", "120e0 AS y")
    made, v = sphere.staged(wcs.with_sip_terms(one), v=wcs.pixel_to_sky(F.col("x"), F.col("y"), sip=True))
    made = wcs.with_pixels(made, v, "p", "q", sip=True)
    flat = wcs.sky_to_pixel(v)
    for r in made.select("exposure_id", "x", "y", "p", "q", flat[0].alias("fp"), flat[1].alias("fq")).collect():
        u, w = r.x + 1 - 500, r.y + 1 - 400
        du = 3e-6 * u * u - 2e-6 * u * w + 1e-9 * w**3 if r.exposure_id < 3 else 0
        dw = 4e-6 * w * w + 1e-6 * u * w if r.exposure_id < 3 else 0
        assert abs(r.fp - r.x - du) < 1e-6 and abs(r.fq - r.y - dw) < 1e-6
        if r.exposure_id == 2:
            a, b = u + du, w + dw
            assert abs(r.p - (a + 0.25 * a + 499)) < 1e-6 and abs(r.q - (b + 1e-5 * b * b + 399)) < 1e-6
        else:
            assert abs(r.p - r.x) < 1e-6 and abs(r.q - r.y) < 1e-6


def test_radius_classes_give_the_same_pairs(spark):
    rnd = random.Random(12)
    points = spark.createDataFrame([(i, rnd.uniform(0, 360), math.degrees(math.asin(rnd.uniform(-1, 1)))) for i in range(400)], "p int, p_ra double, p_dec double")
    circles = spark.createDataFrame([(i, rnd.uniform(0, 360), math.degrees(math.asin(rnd.uniform(-1, 1))), (0.001, 0.5, 6.0, 40.0, 100.0)[i % 5]) for i in range(60)], "c int, c_ra double, c_dec double, c_r double")
    near = sphere.separation(sphere.unit_vector(F.col("p_ra"), F.col("p_dec")), sphere.unit_vector(F.col("c_ra"), F.col("c_dec"))) <= F.col("c_r")
    classes = spatial.classes_of(circles, F.col("c_r"))
    assert len(classes) > 2
    got = spatial.spatial_join(points, circles, (F.col("p_ra"), F.col("p_dec")), (F.col("c_ra"), F.col("c_dec"), F.col("c_r")), None, near, classes).select("p", "c").collect()
    want = points.crossJoin(circles).filter(near).select("p", "c").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def clipped(polygon, sides):
    """What is left of a polygon within the planes, by cutting off what lies behind each."""
    for n in sides:
        kept = []
        for p, q in zip(polygon, polygon[1:] + polygon[:1], strict=True):
            d, e = p @ n, q @ n
            if d > 0:
                kept.append(p)
            if d * e < 0:
                kept.append(p * abs(e) + q * abs(d))
        polygon = kept
    return polygon


def test_footprint_tiles_equal_clipping_and_a_fine_grid(spark):
    rnd, resolution = random.Random(8), 9
    rows = []
    for k in range(30):
        dec = (90.0, -90.0, 0.0, 35.26438968)[k] if k < 4 else math.degrees(math.asin(rnd.uniform(-1, 1)))
        ra, size, turn = 45.0 if k == 3 else rnd.uniform(0, 360), (0.02, 0.3, 3.0)[k % 3], rnd.uniform(0, 2 * math.pi)
        c, s = size * math.cos(turn), size * math.sin(turn)
        rows.append((k, ra, dec, 20.5, 10.5, c, -s, s, c, 0.0, 0.0, 40, 20))
    names = "exposure_id int, crval1 double, crval2 double, crpix1 double, crpix2 double, cd1_1 double, cd1_2 double, cd2_1 double, cd2_2 double, x0 double, y0 double, width int, height int"
    got = [tuple(r) for r in qa.footprint_tiles(spark.createDataFrame(rows, names), resolution).collect()]
    want, sampled = set(), set()
    for k, ra, dec, p1, p2, c11, c12, c21, c22, _, _, w, h in rows:
        r, d = math.radians(ra), math.radians(dec)
        east, north = np.array([-math.sin(r), math.cos(r), 0]), np.array([-math.sin(d) * math.cos(r), -math.sin(d) * math.sin(r), math.cos(d)])
        if abs(dec) == 90:
            east, north = np.array([0.0, 1.0, 0.0]), np.array([-1.0, 0.0, 0.0])

        def place(x, y):
            u, v = x + 1 - p1, y + 1 - p2
            return unit(ra, dec) + math.radians(c11 * u + c12 * v) * east + math.radians(c21 * u + c22 * v) * north

        corners = [place(x, y) for x, y in ((-0.5, -0.5), (w - 0.5, -0.5), (w - 0.5, h - 0.5), (-0.5, h - 0.5))]
        inner = sum(corners)
        sides = [n * np.sign(n @ inner) for n in (np.cross(a, b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True))]
        for tile in range(6 * resolution**2):
            polygon = [unit(*tiles.tile_center(tile, resolution, i, j)) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))]
            if clipped(polygon, sides):
                want.add((k, tile))
        grid = np.array([place(x, y) for x in np.linspace(-0.49, w - 0.51, 150) for y in np.linspace(-0.49, h - 0.51, 150)])
        sampled |= {(k, *p) for p in grid.tolist()}
    points = spark.createDataFrame(sorted(sampled), "k int, x double, y double, z double").selectExpr("k", "degrees(atan2(y, x)) AS ra", "degrees(atan2(z, sqrt(x * x + y * y))) AS dec")
    seen = {tuple(r) for r in points.select("k", tiles.sky_tile_id(F.col("ra"), F.col("dec"), resolution)).distinct().collect()}
    assert set(got) == want and len(got) == len(want) and seen <= want
