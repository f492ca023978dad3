"""Boxes of any size, reachability, scan lines, covers by descent, distortions, arcs, order of files, the source stream."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from zonewise.functions import raster, sphere, wcs
from zonewise.operators import cluster, qa, reachability, spatial
from zonewise.sources import order
from zonewise.streaming import source_stream

BOX = "id int, min0 double, max0 double, min1 double, max1 double"


def boxes(rnd, n):
    made = []
    for i in range(n):
        x, y = rnd.uniform(-10, 370), rnd.uniform(-90, 90)
        w, h = (10 ** rnd.uniform(-2.5, 2.25) for _ in range(2))
        made.append((i, x, x + w, y, min(90.0, y + h)))
    return made


def overlap(a, b, turns):
    return a[3] <= b[4] and a[4] >= b[3] and any(a[1] <= b[2] + t and a[2] >= b[1] + t for t in turns)


@pytest.mark.parametrize("spherical", [False, True])
def test_boxes_of_all_sizes(spark, spherical):
    rnd = random.Random(5)
    a, b = boxes(rnd, 150), boxes(rnd, 150)
    # cells' borders, points, equal boxes
    a += [(900, 0.01, 0.01, 0.0, 0.04), (901, 0.04, 0.16, 0.16, 0.64), (902, 10.0, 10.0, 10.0, 10.0), (903, 0.0, 0.0, -90.0, 90.0)]
    b += [(900, 0.01, 0.02, 0.04, 0.05), (901, 0.16, 0.16, 0.64, 2.56), (902, 10.0, 10.0, 10.0, 10.0), (903, 359.9, 360.0, 1.0, 1.0)]
    turns = (-720, -360, 0, 360, 720) if spherical else (0,)
    left, right = spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX)
    got = [tuple(r) for r in spatial.box_join(left, right, spherical=spherical).collect()]
    assert sorted(got) == sorted((p[0], q[0]) for p in a for q in b if overlap(p, q, turns)) and len(set(got)) == len(got)
    laid, others = spatial._boxes(left, "l", spatial.FINEST, spherical), spatial._levels(spatial._boxes(right, "r", spatial.FINEST, spherical), "r")
    assert spatial._laid(laid, "l", others, spatial.FINEST).count() <= 4 * laid.count() * len(others) and len(others) > 10


def test_boxes_that_are_none(spark):
    good = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0)], BOX)
    bad = spark.createDataFrame([(1, None, 1.0, 0.0, 1.0), (2, 0.0, math.nan, 0.0, 1.0), (3, 0.0, 1.0, 1.0, 0.0), (4, -math.inf, 1.0, 0.0, 1.0)], BOX)
    assert spatial.box_join(good, bad).collect() == [] and spatial.box_join(bad, bad, spherical=True).collect() == []
    with pytest.raises(ValueError):
        spatial.box_join(good, good, 0.0)


def kruskal(edges):
    root, tree = {}, []

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for w, u, v in sorted(edges):
        a, b = find(u), find(v)
        if a != b:
            root[a] = b
            tree.append((u, v, w))
    return sorted(tree)


def test_forest_equals_kruskal(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(1, 9) / 4, *sorted(rnd.sample(range(60), 2))) for _ in range(150)] + [(0.1, 100, 101), (0.2, 101, 102), (0.2, 100, 102)]
    least = {}
    for w, u, v in edges:
        least[u, v] = min(w, least.get((u, v), w))
    given = spark.createDataFrame([(v, u, w) if (u + v) % 2 else (u, v, w) for w, u, v in edges] + [(5, 5, 0.0), (7, 8, None)], "u long, v long, w double")
    got = sorted(map(tuple, reachability.spanning_forest(given).collect()))
    assert got == kruskal((w, u, v) for (u, v), w in least.items())
    assert reachability.spanning_forest(given.limit(0)).collect() == []


@pytest.mark.parametrize("least", [2])
def test_clusters_of_a_smaller_radius(spark, least):
    rnd = random.Random(9)
    points = [(i, 50 + rnd.gauss(0, 0.03) + (i % 4) * 0.1, rnd.gauss(0, 0.03)) for i in range(40)]
    df = spark.createDataFrame(points, "id int, ra double, dec double")
    made = reachability.reachability(df, cluster.ClusteringControl(72.0, least))
    for epsilon in (25.0,):
        want = cluster.cluster(df, cluster.ClusteringControl(epsilon, least))
        assert sorted(map(tuple, made.clusters_at(epsilon).collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        made.clusters_at(73.0)


def dense_coverage(x, y, width, height):
    """The covered area of each pixel on a whole image, edge by edge."""
    x, y = np.asarray(x, float) + 0.5, np.asarray(y, float) + 0.5
    area = np.zeros((height, width))
    for x0, y0, x1, y1 in zip(x, y, np.roll(x, -1), np.roll(y, -1), strict=True):
        if y0 == y1:
            continue
        cuts = [0.0, 1.0]
        for a, b in ((x0, x1), (y0, y1)):
            if a != b:
                at = (np.arange(math.floor(min(a, b)), math.ceil(max(a, b)) + 1) - a) / (b - a)
                cuts += at[(at > 0) & (at < 1)].tolist()
        t = np.unique(cuts)
        px, py = x0 + t * (x1 - x0), y0 + t * (y1 - y0)
        for k in range(len(t) - 1):
            rise, mid, row = py[k + 1] - py[k], (px[k] + px[k + 1]) / 2, math.floor((py[k] + py[k + 1]) / 2)
            if 0 <= row < height:
                c = min(max(math.floor(mid), -1), width)
                area[row, :max(c, 0)] += rise
                if 0 <= c < width:
                    area[row, c] += rise * (mid - c)
    return np.abs(area)


def test_scan_lines_equal_a_whole_image(spark):
    rnd = random.Random(4)
    shapes = [([0.0, 2.5, 0.0], [0.0, 0.0, 2.5]), ([-5, 50, 50, -5], [-5, -5, 60, 60]), ([3, 3, 9, 9], [2, 8, 8, 2]), ([60, 70, 70], [1, 1, 9]), ([-9, -2, -2], [1, 1, 9]), ([4.0, 30.0, 5.0, 12.0], [4.0, 6.0, 28.0, 9.0])]
    for _ in range(25):
        # stars: outlines that see their middle, convex or not, in either direction
        turns = np.sort([rnd.uniform(0, 2 * math.pi) for _ in range(rnd.randrange(3, 9))])
        far, cx, cy = [rnd.uniform(0.2, 25) for _ in turns], rnd.uniform(-5, 45), rnd.uniform(-5, 35)
        if max(np.diff(np.append(turns, turns[0] + 2 * math.pi))) < math.pi:
            x, y = [cx + r * math.cos(t) for r, t in zip(far, turns, strict=True)], [cy + r * math.sin(t) for r, t in zip(far, turns, strict=True)]
            shapes.append((x, y) if rnd.random() < 0.5 else (x[::-1], y[::-1]))
    rows = [(i, [float(v) for v in x], [float(v) for v in y]) for i, (x, y) in enumerate(shapes)]
    df = spark.createDataFrame([*rows, (99, None, None)], "k int, xs array<double>, ys array<double>")
    got = {}
    for r in raster.coverage_map(df, 40, 30, ("k",)).collect():
        got[r.k, r.px, r.py] = r.coverage
    for i, (x, y) in enumerate(shapes):
        image = dense_coverage(x, y, 40, 30)
        made = np.zeros((30, 40))
        for (k, px, py), c in got.items():
            if k == i:
                made[py, px] = c
        assert np.allclose(made, image, atol=1e-9), i
    # polygons of one key add up, and a wide row is one run
    both = raster.coverage_runs(spark.createDataFrame([(1, [-9.0, 5000.0, 5000.0, -9.0], [0.5, 0.5, 2.5, 2.5])] * 2, "k int, xs array<double>, ys array<double>"), 4000, 4000, ("k",)).collect()
    assert sorted((r.py, r.first, r.last, round(r.coverage, 9)) for r in both) == [(1, 0, 3999, 2.0), (2, 0, 3999, 2.0)]
    for wrong in ([0.0, 1.0], [0.0, 1.0, math.nan], [0.0, None, 1.0]):
        with pytest.raises(PySparkException):
            raster.coverage_map(spark.createDataFrame([(1, wrong, wrong)], "k int, xs array<double>, ys array<double>"), 4, 4, ("k",)).collect()


def test_a_wide_footprint_is_covered_by_few_blocks(spark):
    """60 degrees at resolution 335: the tiles by testing all, from blocks that grow with the border."""
    resolution, half = 335, math.degrees(math.tan(math.radians(30)))
    one = spark.createDataFrame([(1, 30.0, 20.0, 1.0, 1.0, half / 500, 0.0, 0.0, half / 500, -499.5, -499.5, 1000, 1000)], "exposure_id int, crval1 double, crval2 double, crpix1 double, crpix2 double, cd1_1 double, cd1_2 double, cd2_1 double, cd2_2 double, x0 double, y0 double, width int, height int")
    cover = qa.footprint_cover(one, resolution).collect()
    tiles = [(r.root * resolution + y) * resolution + x for r in cover for y in range(r.y0, r.y1) for x in range(r.x0, r.x1)]
    ra, dec = math.radians(30), math.radians(20)
    middle = np.array([math.cos(dec) * math.cos(ra), math.cos(dec) * math.sin(ra), math.sin(dec)])
    east, north = np.array([-math.sin(ra), math.cos(ra), 0]), np.array([-math.sin(dec) * math.cos(ra), -math.sin(dec) * math.sin(ra), math.cos(dec)])
    t = math.tan(math.radians(30))
    corners = [middle + t * (i * east + j * north) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    sides = np.array([np.cross(a, b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)])
    sides *= np.sign(sides @ middle)[:, None]
    wanted = set()
    edge = 2 * np.arange(resolution + 1) / resolution - 1
    for root in range(6):
        turn = (root - 1) * math.pi / 2
        c, s = round(math.cos(turn)), round(math.sin(turn))
        ex, ey, ef = ((-s, c, 0), (0, 0, 1), (c, s, 0)) if 0 < root < 5 else ((0, -1, 0), (1 if root == 0 else -1, 0, 0), (0, 0, 1 if root == 0 else -1))
        grid = np.array(ef) + edge[None, :, None] * np.array(ex) + edge[:, None, None] * np.array(ey)
        inside = (grid @ sides.T > 1e-12).all(axis=2)
        # a tile with a corner inside overlaps; what lies around the others' borders is left to the other direction
        some = inside[:-1, :-1] | inside[1:, :-1] | inside[:-1, 1:] | inside[1:, 1:]
        wanted |= {(root * resolution + y) * resolution + x for y, x in zip(*np.nonzero(some), strict=True)}
    assert len(set(tiles)) == len(tiles) and wanted <= set(tiles)
    # beyond those, only tiles that a corner or a side of the footprint enters between their corners
    assert len(set(tiles) - wanted) <= 80
    assert len(cover) < 12 * 4 * resolution * 60 / 90 and len(tiles) > 20 * len(cover)


def test_distortions_without_an_inverse(spark):
    one = spark.sql("SELECT 10e0 AS crval1, 20e0 AS crval2, 500e0 AS crpix1, 400e0 AS crpix2, 2e-4 AS cd1_1, 0e0 AS cd1_2, 0e0 AS cd2_1, 2e-4 AS cd2_2, map('a_2_0', -1e-3) AS sip, explode(array(10.02e0, 10.2e0, 190e0)) AS ra, 20e0 AS dec")
    made, v = sphere.staged(wcs.with_sip_terms(one), v=sphere.unit_vector(F.col("ra"), F.col("dec")))
    near, far, back = (r.x for r in wcs.with_pixels(made, v, sip=True).orderBy("ra").select("x").collect())
    # u - u**2 / 1000 has no value over 250
    u = near + 1 - 500
    assert abs(u - 1e-3 * u * u - 0.02 * math.cos(math.radians(20)) / 2e-4) < 0.1 and math.isnan(far) and math.isnan(back)


def test_arcs(spark):
    rnd = random.Random(6)
    rows = []
    for _ in range(60):
        p, a, b = ([rnd.gauss(0, 1) for _ in range(3)] for _ in range(3))
        rows.append((p, a, b))
    rows += [([1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([1.0, 1.0, 1.0], [2.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([0.0, 0.0, 1.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "p array<double>, a array<double>, b array<double>")
    vectors = [tuple(F.col(c)[k] for k in range(3)) for c in "pab"]
    for r in df.select("p", "a", "b", sphere.arc_distance(*vectors).alias("d")).collect():
        p, a, b = (np.array(x) / np.linalg.norm(x) for x in (r.p, r.a, r.b))
        t = np.linspace(0, 1, 20001)[:, None]
        arc = a * (1 - t) + b * t
        arc /= np.linalg.norm(arc, axis=1)[:, None]
        assert abs(r.d - np.degrees(np.arccos(np.clip(arc @ p, -1, 1))).min()) < 2e-2


@pytest.mark.parametrize("rows", [4, 3000])
def test_order_of_files(spark, tmp_path, rows):
    def written(name, keys):
        for i in range(0, len(keys), rows):
            part = [(k, v) for k, v in enumerate(keys[i : i + rows], i)]
            spark.createDataFrame(part, "id int, key double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/part={i:09d}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    n = 2 * rows if rows > 100 else 12
    fine = [float(k // 2) for k in range(n)]
    assert order.first_disorder(written("fine", fine), "key", "id").collect() == []
    for at, value in ((1, -1.0), (rows, -1.0), (n - 1, 0.0), (0, math.nan), (rows, None), (rows - 1, math.nan)):
        keys = [*fine]
        keys[at] = value
        (r,) = order.first_disorder(written(f"{at}-{value}", keys), "key", "id").collect()
        assert r.id == at and (r.previous is None if at == 0 else r.previous == fine[at - 1] or value is None or math.isnan(value))
    twice = [*fine]
    twice[2], twice[rows + 1] = -1.0, -1.0
    bad = written("twice", twice)
    assert order.first_disorder(bad, "key", "id").first().id == 2
    with pytest.raises(ValueError, match="id 2"):
        order.require_sorted(bad, "key", "id")
    assert order.first_disorder(bad.limit(0), "key", "id").collect() == []


def test_source_stream_drops_repeats_and_goes_on(spark, tmp_path):
    objects = spark.createDataFrame([(1, 10.0, 0.0), (2, 10.5, 0.0)], "id long, ra double, dec double")
    schema = "id long, ra double, dec double, visit_id int, time timestamp"

    def arrive(rows):
        spark.createDataFrame(rows, "id long, ra double, dec double, visit_id int, seconds long").withColumn("time", F.timestamp_seconds("seconds")).drop("seconds").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def work():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        counts = source_stream.object_counts(source_stream.matched(source_stream.new_sources(stream, "1 day"), objects, 0.01))
        source_stream.run_available(counts, f"{tmp_path}/counts", f"{tmp_path}/checkpoint")
        return sorted((r.object_id, r.n_sources, r.last_visit) for r in source_stream.read_counts(spark, f"{tmp_path}/counts").collect())

    arrive([(1, 10.0, 0.001, 7, 1000), (2, 10.5, 0.0, 7, 1000), (3, 200.0, 0.0, 7, 1000), (1, 10.0, 0.001, 7, 1000)])
    assert work() == [(1, 1, 7), (2, 1, 7)]
    # nothing new: nothing is counted again
    assert work() == [(1, 1, 7), (2, 1, 7)]
    arrive([(1, 10.0, 0.001, 7, 1000), (4, 10.001, 0.0, 8, 2000), (5, 10.0, None, 8, 2000)])
    assert work() == [(1, 2, 8), (2, 1, 7)]
