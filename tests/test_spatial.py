"""Grid and hull methods against all pairs on small awkward fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineside.operators import spatial


def km(a, b, radius=6371.0):
    (la1, lo1), (la2, lo2) = a, b
    h = (math.sin(math.radians(la2 - la1) / 2) ** 2
         + math.cos(math.radians(la1)) * math.cos(math.radians(la2)) * math.sin(math.radians(lo2 - lo1) / 2) ** 2)
    return 2 * radius * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def places(seed):
    """Groups of very different shape: cloud, line, ring, duplicates, pair, single, far apart, dense with an outlier."""
    rng = random.Random(seed)
    groups = {
        "cloud": [(40 + rng.gauss(0, 0.1), -80 + rng.gauss(0, 0.1)) for _ in range(120)],
        "line": [(40 + i * 0.01, -80.0) for i in range(30)],
        "ring": [(40 + 0.1 * math.cos(i), -80 + 0.1 * math.sin(i)) for i in range(60)],
        "same": [(40.0, -80.0)] * 4 + [(40.001, -80.0)],
        "pair": [(40.0, -80.0), (40.0, -79.9)],
        "single": [(41.0, -80.0)],
        "world": [(0.0, 179.9), (0.0, -179.9), (10.0, 170.0), (50.0, 10.0), (-60.0, 100.0)],
        "dense": [(40 + rng.random() * 1e-4, -80 + rng.random() * 1e-4) for _ in range(40)] + [(45.0, -70.0)],
    }
    return [(g, f"{g}{i:03d}", a, o) for g, pts in groups.items() for i, (a, o) in enumerate(pts)]


@pytest.fixture
def fixture(frame):
    rows = places(11)
    return rows, frame(rows, "g string, id string, lat double, lon double")


def test_span_is_the_largest_pair_distance(fixture):
    rows, df = fixture
    got = {r.g: r.span_km for r in spatial.group_span(df.repartition(3), "g").collect()}
    for g in {r[0] for r in rows}:
        pts = [r[2:] for r in rows if r[0] == g]
        assert got[g] == pytest.approx(max((km(a, b) for a in pts for b in pts), default=0.0), abs=1e-9)


def test_nearest_neighbour_is_the_smallest_pair_distance(fixture):
    rows, df = fixture
    got = {(r.g, r.id): r.nearest_neighbor_m for r in spatial.nearest_neighbour(df, "g", "id").collect()}
    assert len(got) == len(rows)
    for g, i, la, lo in rows:
        near = min((km((la, lo), (o[2], o[3]), 6_371_000.0) for o in rows if o[0] == g and o[1] != i), default=None)
        assert got[g, i] == (pytest.approx(near, abs=1e-6) if near is not None else None), (g, i)


def test_radius_matches_on_cell_borders(frame):
    left = frame([(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (30, 0), (-0.001, 59.999), (29.999, 30)])], "l int, x double, y double")
    right = frame([(i, float(x), float(y)) for i, (x, y) in enumerate([(30, 0), (0, 30), (60, 0), (-30, 60), (59.9, 30)])], "r int, rx double, ry double")
    got = {(r.l, r.r) for r in spatial.radius_matches(left, right, 30.0).collect()}
    want = {(a.l, b.r) for a in left.collect() for b in right.collect() if math.hypot(a.x - b.rx, a.y - b.ry) <= 30}
    assert got == want


@pytest.mark.parametrize("crowd", [256, 1])
def test_segments_within_on_cell_borders(frame, monkeypatch, crowd):
    monkeypatch.setattr(spatial, "_CELL_SEGMENTS", crowd)
    rng = random.Random(3)
    spots = [(0, 0), (30, 0), (-0.001, 59.999), (29.999, 30)] + [(rng.uniform(-300, 300), rng.uniform(-300, 300)) for _ in range(200)]
    points = [(0, 30, 0), (1, 0, 30), (2, 60, 0), (3, -30, 60), (4, 59.9, 30), (4, 59.9, 30), (5, 150, 120), (5, 120, 120)]
    points += [(6 + i % 40, rng.uniform(-300, 300), rng.uniform(-300, 300)) for i in range(300)]
    left = frame([(float(x), float(y)) for x, y in spots], "x double, y double")
    right = frame([(i, float(x), float(y)) for i, x, y in points], "seg int, rx double, ry double")
    got = [(r.x, r.y, r.seg) for r in spatial.segments_within(left, right, "seg", 30.0).collect()]
    want = {(float(x), float(y), i) for x, y in spots for i, rx, ry in points if (x - rx) ** 2 + (y - ry) ** 2 <= 900}
    assert len(got) == len(set(got)) and set(got) == want


def test_densify_bridges_the_gap_between_parts(frame):
    step = 40 / 111_320.0
    df = frame([("s", [(40.0, -80.0), (40.0 + step, -80.0)]), ("one", [(40.0, -80.0)])], "id string, p array<struct<lat: double, lon: double>>")
    got = sorted(r.lat for r in spatial.densify(df, "id", "p", 15.0).where("id = 's'").collect())
    assert got == pytest.approx([40.0, 40.0 + step / 3, 40.0 + 2 * step / 3, 40.0 + step])
    assert spatial.densify(df, "id", "p", 15.0).where("id = 'one'").count() == 1


def test_first_point_per_cell_and_longest_variant(frame):
    df = frame([("r", 2, 40.000001, -80.0), ("r", 1, 40.000002, -80.0), ("r", 3, 40.1, -80.0)], "g string, o int, lat double, lon double")
    assert sorted(r.lat for r in spatial.distinct_points(df, "g", "o").collect()) == [40.000002, 40.1]
    shapes = frame([("r", "b"), ("r", "b"), ("r", "a"), ("r", "a"), ("r", "c")], "g string, v string")
    assert [(r.v, r.n_points) for r in spatial.longest_variant(shapes, "g", "v").collect()] == [("a", 2)]


def test_segment_match_keeps_groups_without_a_segment(frame):
    points = frame([("near", 40.0, -80.0), ("near", 40.01, -80.0), ("far", 41.0, -80.0)], "route_id string, lat double, lon double")
    segments = frame([
        (1, [(40.0, -80.0)], 100, 5.0, 0.0), (2, [(40.0001, -80.0)], 300, None, 0.0)],
        "seg int, points array<struct<lat: double, lon: double>>, count int, truck_pct double, length_ft double")
    out = {r.route_id: r for r in spatial.match_segments(points, segments, "route_id", "seg").collect()}
    near, far = out["near"], out["far"]
    assert (near.n_segments, near.match_rate, near.weighted_aadt, near.avg_truck_pct) == (2, 0.5, 200.0, 5.0)  # zero length: plain means
    assert (near.max_aadt, near.median_aadt, near.p90_aadt) == (300, 200.0, 280.0)
    assert (far.n_segments, far.match_rate, far.weighted_aadt, far.avg_truck_pct) == (0, 0.0, 0.0, None)


def test_no_plan_compares_all_pairs(fixture):
    _, df = fixture
    plan = spatial.nearest_neighbour(df, "g", "id")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_span_of_wide_groups(frame):
    rng = random.Random(5)
    rows = [(f"g{g}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for g in range(12) for _ in range(rng.choice([2, 6, 40]))]
    rows += [("line", 0.0, float(x)) for x in range(-170, 170, 5)] + [("near", rng.uniform(40, 41), rng.uniform(-80, -79)) for _ in range(200)]
    got = {r.g: r.span_km for r in spatial.group_span(frame(rows, "g string, lat double, lon double"), "g").collect()}
    for g in got:
        pts = [r[1:] for r in rows if r[0] == g]
        assert got[g] == pytest.approx(max(km(a, b) for a in pts for b in pts), abs=1e-6), g


def test_span_of_antipodes_and_globe_wide_groups(frame):
    rng = random.Random(9)
    rows = [("exact", 0.0, 0.0), ("exact", 0.0, 180.0), ("poles", 90.0, 12.0), ("poles", -90.0, 77.0), ("cells", 2.5, 2.5), ("cells", -2.5, -177.5)]
    rows += [("two towns", 40 + rng.gauss(0, 0.1), -80 + rng.gauss(0, 0.1)) for _ in range(150)] + [("two towns", -30 + rng.gauss(0, 0.1), 60 + rng.gauss(0, 0.1)) for _ in range(150)]
    rows += [(None, rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)]
    got = {r.g: r.span_km for r in spatial.group_span(frame(rows, "g string, lat double, lon double"), "g").collect()}
    assert got["exact"] == pytest.approx(math.pi * 6371.0) and got["poles"] == pytest.approx(math.pi * 6371.0)
    for g in ("cells", "two towns", None):
        pts = [r[1:] for r in rows if r[0] == g]
        assert got[g] == pytest.approx(max(spatial._haversine_km(pts[i][0], pts[i][1], *(np.array(c) for c in zip(*pts))).max() for i in range(len(pts))), abs=1e-6), g


def test_span_of_a_large_globe_wide_group_takes_no_group_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(spatial, "_COMPARED", 1000)
    n = 30_000
    rows = spark.range(n).select(F.lit("w").alias("g"), F.degrees(F.asin(2 * F.rand(1) - 1)).alias("lat"), (F.rand(2) * 360 - 180).alias("lon"))
    from lineside.session import settle
    rows = settle(rows)
    places = np.array([(r.lat, r.lon) for r in rows.collect()])
    wide = spatial._wide_span(rows, "g")
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan
    xyz = spatial._unit(places[:, 0], places[:, 1])
    best = max(float(spatial._haversine_km(*places[i], *places[np.argmin(xyz @ xyz[i])])) for i in range(0, n, 997))
    got = wide.first().span_km
    assert best <= got + 1e-9 <= math.pi * 6371.0 + 1e-6
    far = np.argsort(np.abs(places[:, 0]))[-3000:]  # around the poles, in full
    block = spatial._haversine_km(places[far, 0][:, None], places[far, 1][:, None], places[far, 0][None], places[far, 1][None])
    assert block.max() <= got + 1e-9


def test_points_on_a_line_are_thinned():
    lat = np.linspace(40, 41, 5000)
    plane = spatial._central_plane(spatial._unit(lat, np.full(5000, -80.0)))
    kept = spatial._outer_rows(np.zeros(5000, int), plane)
    assert kept.sum() <= 4 and kept[0] and kept[-1]


def test_distances_between_antipodes_are_numbers(frame):
    from lineside.functions.columns import haversine
    rows = [(a * 5 - 87.5, o * 5 - 177.5) for a in range(36) for o in range(72)]
    df = frame(rows, "lat double, lon double")
    out = df.select(haversine(F.col("lat"), F.col("lon"), -F.col("lat"), F.col("lon") + 180).alias("d")).collect()
    assert all(r.d == pytest.approx(math.pi * 6371.0) for r in out)


def test_nearest_neighbour_on_awkward_clouds(frame):
    rng = random.Random(21)
    rows = []
    for g, (n, spread) in enumerate([(300, 30.0), (200, 0.001), (150, 0.3), (2, 90.0)]):
        rows += [(f"g{g}", f"{g}-{i}", max(-90.0, min(90.0, rng.gauss(0, spread))), rng.gauss(0, spread)) for i in range(n)]
    rows += [("g0", "pole", 90.0, 0.0), ("g0", "pole2", 90.0, 50.0), ("g9", "alone", 1.0, 1.0), ("g8", "a", 0.0, 0.0), ("g8", "b", 0.0, 180.0)]
    got = {(r.g, r.id): r.nearest_neighbor_m for r in spatial.nearest_neighbour(frame(rows, "g string, id string, lat double, lon double"), "g", "id").collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        lat, lon = (np.array([r[k] for r in own]) for k in (2, 3))
        for i, (_, name, la, lo) in enumerate(own):
            d = np.delete(spatial._haversine_km(la, lo, lat, lon), i) * 1000
            assert got[g, name] == (pytest.approx(d.min(), abs=1e-5) if len(d) else None), (g, name)


def test_order_along_the_curve(spark):
    rng = random.Random(2)
    cubes = [tuple(rng.randrange(1 << 21) for _ in range(3)) for _ in range(50)] + [(0, 0, 0), ((1 << 21) - 1,) * 3]
    df = spark.createDataFrame([tuple(8.0 * c + 1 for c in cube) for cube in cubes], "x double, y double, z double")
    for cube, row in zip(cubes, df.select(spatial._morton(F.col("x"), F.col("y"), F.col("z")).alias("m")).collect()):
        assert row.m == sum((c >> i & 1) << (3 * i + 2 - k) for k, c in enumerate(cube) for i in range(21))

def test_spans_are_worked_out_in_more_than_one_task(frame):
    df = frame([(f"g{i % 20}", 40.0 + i * 1e-4, -80.0 + i % 7 * 1e-3) for i in range(200)], "g string, lat double, lon double")
    got = spatial.group_span(df, "g")
    assert got.count() == 20 and got.rdd.getNumPartitions() == int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) > 1


@pytest.mark.parametrize("pairs, held, visits, points", [(2_000_000, 1_000_000, 1 << 20, 1 << 16), (50, 20, 40, 60)])
def test_segment_match_adds_up_without_listing_pairs(frame, monkeypatch, pairs, held, visits, points):
    for name, value in (("_PAIRS", pairs), ("_HELD", held), ("_TILE_VISITS", visits), ("_TILE_POINTS", points)):
        monkeypatch.setattr(spatial, name, value)
    written, settle = [], spatial.settle
    monkeypatch.setattr(spatial, "settle", lambda df: written.append(settle(df)) or written[-1])
    rng = random.Random(11)
    spots = [(40.44 + rng.uniform(0, 0.002), -80 + rng.uniform(0, 0.002)) for _ in range(60)]
    rows = [(f"r{g}", *spots[rng.randrange(60)]) for g in range(60) for _ in range(12)]
    rows += [(None, 40.44, -80.0), ("r1", None, -80.0), ("alone", None, None)]
    roads = []
    for i in range(300):
        lat, lon = 40.44 + rng.uniform(0, 0.002), -80 + rng.uniform(0, 0.002)
        line = [(lat, lon), (lat + rng.uniform(0, 0.0003), lon + 0.0002)] + ([(lat, lon + 0.05)] if i % 50 == 0 else [])
        roads.append((i if i else None, line, rng.choice([10, 20, 10 ** 6, rng.randrange(5000)]), rng.choice([None, 5.0, 7.5]), rng.choice([0.0, 10.0, 33.0])))
    roads += [roads[5], (7, [(40.4401, -80.0)], None, 1.0, None)]
    kind = "seg int, points array<struct<lat: double, lon: double>>, count int, truck_pct double, length_ft double"
    asked, lines = frame(rows, "route_id string, lat double, lon double"), frame(roads, kind)
    got = {r.route_id: r for r in spatial.match_segments(asked, lines, "route_id", "seg").collect()}
    counted = sum(df.count() for df in written)

    def plane(df, *more):
        return [tuple(r) for r in df.select(*more, spatial.local_east(F.col("lon")), spatial.local_north(F.col("lat"))).collect()]

    dense = plane(spatial.densify(lines, "seg", "points", 15.0), "seg")
    near, hits, total = {}, {}, 0
    for route, x, y in plane(asked, "route_id"):
        met = {s for s, rx, ry in dense if (x - rx) ** 2 + (y - ry) ** 2 <= 900} if x is not None and y is not None else set()
        near.setdefault(route, set()).update(met)
        hits.setdefault(route, []).append(bool(met))
    assert set(got) == set(near)
    for route, segs in near.items():
        r = got[route]
        assert (r.n_route_points, r.match_rate) == (len(hits[route]), pytest.approx(np.mean(hits[route])))
        carried = [x for x in roads if x[0] is not None and x[0] in segs] if route is not None else []
        total += len(carried)
        counts = [x[2] for x in carried if x[2] is not None]
        length = sum(x[4] or 0 for x in carried)
        assert (r.n_segments, r.total_length_ft) == (len(carried), pytest.approx(length))
        if not carried:
            continue
        assert r.max_aadt == max(counts)
        assert (r.median_aadt, r.p90_aadt) == pytest.approx(tuple(np.quantile(counts, [0.5, 0.9])))
        assert r.weighted_aadt == pytest.approx(sum(x[2] * x[4] for x in carried if x[2] is not None and x[4] is not None) / length)
        trucks = [x for x in carried if x[3] is not None]
        assert r.avg_truck_pct == pytest.approx(sum(x[3] * (x[4] or 0) for x in trucks) / sum(x[4] or 0 for x in trucks))
    assert total > 5000
    assert held < 1_000_000 or counted < total / 2  # no frame with a row for each pair is written


@pytest.mark.parametrize("compared", [2048, 25, 0])
def test_nearest_neighbour_writes_the_rows_once(spark, frame, monkeypatch, compared):
    monkeypatch.setattr(spatial, "_COMPARED_ROWS", compared)
    written, settle = [], spatial.settle
    monkeypatch.setattr(spatial, "settle", lambda df: written.append(settle(df)) or written[-1])
    rng = random.Random(4)
    rows = [(f"g{g}", f"{g}-{i}", rng.gauss(40, 0.1), rng.gauss(-80, 0.1), i) for g in range(9) for i in range(g * g)]
    rows += [("g3", "twin", 40.0, -80.0, 1), ("g3", "twin2", 40.0, -80.0, 2), ("g4", "nowhere", None, 1.0, 3), (None, "a", 40.0, -80.0, 4), (None, "b", 40.1, -80.0, 5)]
    df = frame(rows, "g string, id string, lat double, lon double, more int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.g, r.id): (r.more, r.nearest_neighbor_m) for r in spatial.nearest_neighbour(df, "g", "id", keep=["more"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    placed = [r for r in rows if r[2] is not None]
    assert len(got) == len(placed)
    for g, i, la, lo, more in placed:
        near = min((km((la, lo), (o[2], o[3]), 6_371_000.0) for o in placed if g and o[0] == g and o[1] != i), default=None)
        assert got[g, i] == (more, pytest.approx(near, abs=1e-6) if near is not None else None), (g, i)
    if compared == 2048:  # no second frame with a row for each place
        assert sum(d.count() for d in written) == len(placed)


@pytest.mark.parametrize("beside", [16, 0, -1])
def test_visits_of_a_tile_bring_each_segment_once(monkeypatch, beside):
    import pyarrow as pa

    monkeypatch.setattr(spatial, "_BESIDE", beside)
    rng = random.Random(2)
    spots = [(rng.uniform(0, 900), rng.uniform(0, 900), [f"g{g}" for g in rng.sample(range(20), 4)]) for _ in range(80)]
    roads = [[(x, y), (x + 40, y + 20)] for x, y in ((rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(300))]
    rows = [{"_spot": True, "x": x, "y": y, "_groups": g} for x, y, g in spots]
    rows += [{"_spot": False, "_rx": [x for x, _ in r], "_ry": [y for _, y in r], "_count": [1], "_truck": [1.0], "_length": [1.0]} for r in roads]
    doubles = pa.list_(pa.float64())
    kinds = {"_spot": pa.bool_(), "x": pa.float64(), "y": pa.float64(), "_groups": pa.list_(pa.string()), "_rx": doubles, "_ry": doubles,
             "_count": pa.list_(pa.int64()), "_truck": doubles, "_length": doubles}
    tile = spatial._Tile(pa.Table.from_pylist(rows, pa.schema(list(kinds.items()))), 30.0, 50)
    group, spot, rest = tile.meets()
    names = tile.names.to_pylist()
    got = [(names[g], int(s)) for g, p in zip(group, spot) for s in tile.seg[tile.first[p]:tile.first[p] + tile.many[p]]]
    got += [(names[g], int(s)) for gs, segs in rest() for g, s in zip(gs, segs)]
    want = {(g, i) for x, y, gs in spots for i, r in enumerate(roads) if any((x - a) ** 2 + (y - b) ** 2 <= 900 for a, b in r) for g in gs}
    assert len(got) == len(set(got)) and set(got) == want
    assert beside < 16 or len(group) > 100  # most visits are taken whole
