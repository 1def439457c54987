"""Joins by dyadic intervals and by the polygons' own grids, against brute force."""

import math
import random

from pyspark.sql import functions as F

from plotwise.operators.spatial_joins import dyadic_blocks, edge_index, pick_points, polygon_grids, range_semi_join

TOP = (1 << 63) - 1


def test_blocks_make_up_their_ranges(spark):
    rnd = random.Random(1)
    ranges = [(-TOP - 1, TOP), (0, TOP), (1, (1 << 62) + 1), (-5, 7), (3, 3), (9, 8), (TOP, TOP), (-TOP - 1, -TOP - 1), (None, 4), (4, None)]
    ranges += [tuple(sorted(rnd.sample(range(-(1 << rnd.randrange(3, 63)), 1 << rnd.randrange(3, 63)), 2))) for _ in range(100)]
    for lo, hi in ranges:
        found = sorted((b << k, (b + 1 << k) - 1) for k, b in map(tuple, dyadic_blocks(spark.createDataFrame([(lo, hi)], "lo long, hi long")).collect())) if rnd.random() < 0.15 or lo in (None, 0, 1, -5, 3, 9) else None
        if found is None:
            continue
        assert len(found) < 130
        if lo is None or hi is None or lo > hi:
            assert found == []
        else:
            assert found[0][0] == lo and found[-1][1] == hi and all(a[1] + 1 == b[0] for a, b in zip(found, found[1:]))


def test_semi_join_with_wide_nested_and_odd_ranges(spark):
    rnd = random.Random(2)
    ids = [rnd.randrange(-(1 << 62), 1 << 62) for _ in range(300)] + [None, 5, 5, 5, -1, 0, TOP, -TOP - 1] + list(range(1000, 1400))
    ranges = [(1 << 50, 1 << 61), ((1 << 50) + 5, (1 << 51) + 9), (-3, 1), (1024, 1024), (1100, 1203), (1150, 1160), (1150, 1160), (7, 6), (None, 3), (TOP - 1, TOP), (-TOP - 1, -TOP)]
    features = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, k long").withColumn("lo", F.lit(1)).withColumn("a.b", F.lit(2))
    found = range_semi_join(features, spark.createDataFrame(ranges, "lo long, hi long"))
    assert sorted(r.k for r in found.select("k").collect()) == [k for k, i in enumerate(ids) if i is not None and any(a is not None and a <= i <= b for a, b in ranges)]
    assert found.columns == features.columns
    assert range_semi_join(features, spark.createDataFrame([(5, 4)], "lo long, hi long")).count() == 0


def ring_edges(ring):
    return [(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1])]


def even_odd(x, y, edges):
    inside = False
    for x1, y1, x2, y2 in edges:
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def star(rnd, n, cx, cy, reach, whole):
    out = []
    for k in range(n):
        turn, far = 2 * math.pi * k / n, reach * rnd.uniform(0.3, 1)
        point = (cx + far * math.cos(turn), cy + far * math.sin(turn))
        out.append((float(round(point[0])), float(round(point[1]))) if whole else point)
    return out


def shapes(seed=4):
    rnd = random.Random(seed)
    found = {}
    for k in range(60):
        whole = k % 2 == 0
        edges = ring_edges(star(rnd, rnd.choice((3, 4, 7, 30, 200)), rnd.randrange(40), rnd.randrange(40), rnd.choice((3, 10, 40)), whole))
        if k % 3 == 0:  # a second ring, which overlaps or is a hole
            edges += ring_edges(star(rnd, rnd.choice((3, 9, 60)), rnd.randrange(40), rnd.randrange(40), rnd.choice((2, 8)), whole))
        found[k] = edges
    found[100] = ring_edges([(0.0, 0.0), (20.0, 0.0), (10.0, 10.0), (20.0, 20.0), (0.0, 20.0), (10.0, 10.0)])  # touches itself in a vertex
    found[101] = ring_edges([(5.0, 5.0), (5.0, 30.0), (5.0, 12.0)])  # no area
    found[102] = ring_edges([p for k in range(150) for p in ((k * 0.25, 0.0), (k * 0.25, 35.0), (k * 0.25 + 0.125, 35.0), (k * 0.25 + 0.125, 0.0))])  # a comb of long edges
    found[103] = ring_edges(star(rnd, 4000, 20, 20, 19, False))
    return found


def tables(spark, found, points):
    edges = spark.createDataFrame([(k, *e) for k, es in found.items() for e in es], "id long, x1 double, y1 double, x2 double, y2 double")
    boxes = [(k, min(min(e[0], e[2]) for e in es), min(min(e[1], e[3]) for e in es), max(max(e[0], e[2]) for e in es), max(max(e[1], e[3]) for e in es)) for k, es in found.items()]
    return spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(boxes, "id long, xmin double, ymin double, xmax double, ymax double"), edges


def test_picks_against_the_plain_rule(spark):
    rnd = random.Random(5)
    found = shapes()
    points = [(k, float(rnd.randrange(-5, 45)), float(rnd.randrange(-5, 45))) for k in range(800)]  # many on vertices and edges
    points += [(1000 + k, rnd.uniform(-5, 45), rnd.uniform(-5, 45)) for k in range(800)]
    corners = [p for k in (2, 100, 102, 103) for p in found[k][:40]]
    points += [(3000 + k, p[0], p[1]) for k, p in enumerate(corners)]
    got = {r.point_id: r.id for r in pick_points(*tables(spark, found, points), (-50.0, -50.0, 90.0, 90.0)).collect()}
    expected = {}
    for k, x, y in points:
        held = [i for i, edges in found.items() if even_odd(x, y, edges)]
        if held:
            expected[k] = max(held)
    assert got == expected and len(expected) > 500


def test_each_polygon_alone(spark):
    """Every polygon's own answer, not only the highest one's."""
    rnd = random.Random(6)
    found = shapes(7)
    points = [(k, float(rnd.randrange(-5, 45)), float(rnd.randrange(-5, 45))) for k in range(150)]
    for k in (0, 3, 100, 102, 103):
        got = {r.point_id for r in pick_points(*tables(spark, {k: found[k]}, points), (-50.0, -50.0, 90.0, 90.0)).collect()}
        assert got == {p for p, x, y in points if even_odd(x, y, found[k])}


def test_a_point_meets_few_edges_of_a_large_polygon(spark):
    rnd = random.Random(8)
    for n in (500, 8000):
        ring = [(20 + (15 + math.sin(40 * t)) * math.cos(t), 20 + (15 + math.sin(40 * t)) * math.sin(t)) for t in (2 * math.pi * k / n for k in range(n))]
        points = [(k, rnd.uniform(4, 36), rnd.uniform(4, 36)) for k in range(400)]
        at, _, edges = tables(spark, {1: ring_edges(ring)}, points)
        grids = polygon_grids(edges)
        index = edge_index(edges, grids).where("NOT odd")
        assert index.count() < 6 * n
        cells = at.join(grids).select(F.floor((F.col("x") - F.col("bx")) / F.col("w")).cast("int").alias("c"), F.floor((F.col("y") - F.col("by")) / F.col("h")).cast("int").alias("r"))
        assert cells.join(index, ["c", "r"]).count() < 40 * len(points)


def brute_crossings(rings):
    """Counts of (ring, issue) over all pairs of segments, in exact integers."""

    def turn(a, b, c):
        v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        return (v > 0) - (v < 0)

    def on(a, b, c):
        return turn(a, b, c) == 0 and min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])

    segments, sizes = [], {}
    for ring, points in rings.items():
        own = [(a, b) for a, b in zip(points, points[1:]) if a != b]
        sizes[ring] = (len(own), bool(own) and own[0][0] == own[-1][1])
        segments += [(ring, k, a, b) for k, (a, b) in enumerate(own)]
    found = {}
    for i, (r1, k1, a, b) in enumerate(segments):
        for r2, k2, c, d in segments[i + 1 :]:
            m, closed = sizes[r1]
            after, around = r1 == r2 and k2 == k1 + 1, r1 == r2 and closed and k1 == 0 and k2 == m - 1
            issue = None
            if after and around:
                issue = "ring-spike" if on(a, b, c) and on(a, b, d) else None
            elif after or around:
                far, near = (d, a) if after else (c, b)
                issue = "ring-spike" if turn(a, b, far) == 0 and turn(c, d, near) == 0 and (on(a, b, far) or on(c, d, near)) else None
            elif turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
                issue = "ring-self-crossing" if r1 == r2 else "rings-cross"
            elif on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b):
                issue = "ring-self-touch" if r1 == r2 else "rings-touch"
            if issue:
                found[r1, issue] = found.get((r1, issue), 0) + 1
    return found


def test_crossings_against_brute_force(spark):
    from plotwise.operators.linting import lint_crossings

    rnd = random.Random(12)
    square = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    features = {
        1: {0: square},
        2: {0: [(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)]},  # a bow tie
        3: {0: square, 1: [(2, 2), (4, 2), (4, 4), (2, 2)]},  # a ring inside
        4: {0: square, 1: [(0, 5), (4, 2), (4, 4), (0, 5)]},  # that touches
        5: {0: square, 1: [(-5, 5), (4, 2), (4, 4), (-5, 5)]},  # that crosses
        6: {0: [(0, 0), (5, 0), (10, 0), (5, 0), (5, 5), (0, 0)]},  # a spike
        7: {0: [(0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2), (0, 0)]},  # touches itself in a vertex
        8: {0: [(0, 0), (7, 0), (3, 0), (0, 0)]},  # on one line
        9: {0: [(0, 0), (3, 3), (0, 0)]},
        10: {0: [(0, 0), (0, 0), (5, 0), (5, 0), (5, 5), (0, 0)]},  # repeated vertices
        11: {0: [(3, 3)]},
    }
    for k in range(20, 60):
        features[k] = {r: [(rnd.randrange(12), rnd.randrange(12)) for _ in range(rnd.choice((4, 7, 12)))] for r in range(rnd.choice((1, 2, 3)))}
        features[k] = {r: p + p[:1] if rnd.random() < 0.8 else p for r, p in features[k].items()}
    features[99] = {0: [(rnd.randrange(1000), rnd.randrange(1000)) for _ in range(300)]}
    rows = [(i, r, pos, float(x), float(y)) for i, rings in features.items() for r, points in rings.items() for pos, (x, y) in enumerate(points)]
    found = lint_crossings(spark.createDataFrame(rows, "id long, ring int, pos int, x double, y double")).collect()
    expected = {(i, *key): n for i, rings in features.items() for key, n in brute_crossings(rings).items()}
    assert {(r.id, r.ring, r.issue): r.n for r in found} == expected
    assert {issue for *_, issue in expected} == {"ring-self-crossing", "ring-self-touch", "ring-spike", "rings-cross", "rings-touch"}


def test_files_of_several_crs(spark, tmp_path):
    from plotwise.operators.linting import mixed_crs
    from plotwise.sources.geoparquet import geo_key, write_files

    df = spark.range(3).select("id", F.lit(b"x").alias("geometry"))
    swiss = '{"id": {"authority": "EPSG", "code": 2056}}'
    write_files(df, f"file://{tmp_path}/d/a", {"geo": geo_key(swiss, covering=None)})
    assert mixed_crs(spark, f"file://{tmp_path}/d").collect() == []
    write_files(df, f"file://{tmp_path}/d/b", {"geo": geo_key('{"id": {"authority": "EPSG", "code": 4326}}', covering=None)})
    assert {r.crs for r in mixed_crs(spark, f"file://{tmp_path}/d").collect()} == {"EPSG:2056", "EPSG:4326"}
