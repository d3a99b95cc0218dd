"""Quadtree covers against ray casting, bit-packed scan lines against pixel pairs."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from gaugeflow.operators import areas as W
from gaugeflow.operators import radar as R
from gaugeflow.policy import GridPolicy


def inside(lat, lon, ring):
    odd = False
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
        if (b > lon) != (d > lon) and lat < a + (lon - b) * (c - a) / (d - b):
            odd = not odd
    return odd


def rings():
    draw = random.Random(7)
    out = {0: [(0.0, 0.0), (0.0, 8.0), (8.0, 8.0), (8.0, 0.0)], 1: [(1.0, 1.0), (5.0, 9.0), (1.0, 9.0), (5.0, 1.0)], 2: [(-3.3, -3.0), (-3.3, 3.0), (33.0, 0.1)]}
    for n in range(3, 9):  # stars, some smaller than a cell, across the equator and the meridian
        size, at = draw.choice([0.03, 0.4, 3.0]), (draw.uniform(-2, 2), draw.uniform(-2, 2))
        turn = [2 * math.pi * k / 14 for k in range(14)]
        out[n] = [(at[0] + size * draw.uniform(0.3, 1) * math.cos(t), at[1] + size * draw.uniform(0.3, 1) * math.sin(t)) for t in turn]
    return out


def test_cells_and_counts_equal_ray_casting(spark):
    draw, shapes = random.Random(3), rings()
    spots = [(n, draw.uniform(-4, 9), draw.uniform(-4, 10)) for n in range(3000)]
    spots += [(3000 + n, 0.125 * draw.randrange(-20, 60), 0.25 * draw.randrange(-10, 36)) for n in range(500)] + [(4000, None, 1.0), (4001, 89.99, -179.99)]
    spots += [(5000 + 20 * n + k, ring[0][0] + draw.uniform(-0.05, 0.05), ring[0][1] + draw.uniform(-0.05, 0.05)) for n, ring in shapes.items() for k in range(20)]
    stations = spark.createDataFrame(spots, "station_id long, lat double, lon double")
    rows = [(n, 0, 0, "x", ring) for n, ring in shapes.items()] + [(90, 0, 0, None, None), (91, 0, 0, "x", [(1.0, 1.0), (2.0, 2.0)])]
    areas = spark.createDataFrame(rows, "warning_id long, info_index int, area_index int, area_desc string, ring array<struct<lat:double,lon:double>>")
    want = {(s, n) for s, lat, lon in spots if lat is not None for n, ring in shapes.items() if inside(lat, lon, ring)}
    cells = W.match_cells(areas, ()).cache()
    assert {(r.station_id, r.warning_id) for r in W.at_stations(stations, cells).collect()} == want
    counts = {r.warning_id: r.n_stations for r in W.stations_in(stations.filter("lat is not null"), cells).collect()}
    assert counts == Counter(n for _, n in want)


def test_a_country_is_a_few_cells(spark):
    """One polygon over all stations: its cells do not grow with the stations, and most stations need no ray."""
    ring = [(0.0, 0.0), (0.0, 24.0), (24.0, 24.0), (24.0, 0.0)]
    areas = spark.createDataFrame([(1, 0, 0, "x", ring)], "warning_id long, info_index int, area_index int, area_desc string, ring array<struct<lat:double,lon:double>>")
    cells = W.match_cells(areas, ()).cache()
    inner = cells.filter("inner")
    area = inner.select(F.sum(F.pow(F.lit(32.0) / F.pow(F.lit(2.0), "level"), F.lit(2.0)))).first()[0]
    assert area > 0.97 * 24 * 24 and cells.count() < 6000 and inner.agg(F.min("level")).first()[0] <= 2
    assert cells.filter("not inner").select(F.max(F.size("edges"))).first()[0] <= 3  # only sides over the cell's longitudes


def test_motion_equals_all_pixel_pairs(spark):
    draw, grid = random.Random(5), GridPolicy(window=300)
    pixels = []
    for region in range(3):
        spots = {(draw.randrange(300), draw.randrange(300)) for _ in range(400)} | {(x, 150 + region) for x in range(0, 300, 1 + region)}
        for f in range(3):
            dx, dy = f * (2 * region - 2) * 3, f * 4
            pixels += [(region, f * 600, x + dx, y + dy, 1 + (x + y) % 4) for x, y in spots if 0 <= x + dx < 300 and 0 <= y + dy < 300 and draw.random() < 0.9]
    frames = spark.createDataFrame([(r, f * 600) for r in range(3) for f in range(3)], "region int, frame_time int")
    table = spark.createDataFrame(pixels, "region int, frame_time int, x int, y int, bucket int")
    got = {(r.region, r.frame_time): (r.dx, r.dy, r.overlap) for r in R.motion(table, ["region"], frames, grid).collect()}
    for region in range(3):
        for f in (0, 600):
            here = [(x, y) for r, t, x, y, _ in pixels if (r, t) == (region, f)]
            there = {(x, y) for r, t, x, y, _ in pixels if (r, t) == (region, f + 600)}
            scores = {(dx, dy): sum((x + dx, y + dy) in there for x, y in here) for dx in range(-30, 31, 2) for dy in range(-30, 31, 2)}
            best = min(scores, key=lambda s: (-scores[s], s != (0, 0), s[1], s[0]))
            assert got[region, f] == (*best, scores[best])


def test_words_move_across_their_borders(spark):
    bits = [0, 5, 62, 63, 64, 100, 127, 128, 191]
    words = [sum(1 << b % 64 for b in bits if b // 64 == i) for i in range(3)]
    row = spark.createDataFrame([[w - (1 << 64) if w >> 63 else w for w in words]], "a long, b long, c long")
    for by in (-63, -30, -1, 0, 1, 30, 63):
        moved = [v & (1 << 64) - 1 for v in row.select(*[c.alias(f"w{i}") for i, c in enumerate(R.shifted(["a", "b", "c"], by))]).first()]
        assert [64 * i + b for i, w in enumerate(moved) for b in range(64) if w >> b & 1] == [b + by for b in bits if 0 <= b + by < 192]
