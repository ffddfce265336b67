"""Points in polygons against the even-odd rule over all segments."""

import math
import random

import pytest

from weftline.operators import cells


def inside(point, ring):
    """The rule itself."""
    x, y = point
    hits = 0
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        hits += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return hits % 2 == 1


def star(rng, cx, cy, size, corners):
    return [(cx + size * rng.uniform(0.2, 1) * math.cos(a), cy + size * rng.uniform(0.2, 1) * math.sin(a)) for a in (2 * math.pi * k / corners for k in range(corners))]


def answer(spark, points, rings, cap=cells.CAP):
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "id long, x double, y double")
    polygons = spark.createDataFrame([(n, [{"x": x, "y": y} for x, y in r]) for n, r in rings.items()], "name string, ring array<struct<x: double, y: double>>")
    return {(r.id, r.name) for r in cells.point_in_polygon(frame, polygons, cap).collect()}


@pytest.mark.parametrize("unit", [1.0, 1e-7, 1e12])
def test_any_unit(spark, unit):
    rng = random.Random(2)
    rings = {f"s{k}": star(rng, rng.uniform(0, 10) * unit, rng.uniform(0, 10) * unit, 4 * unit, 90) for k in range(6)}
    rings["square"] = [(2 * unit, 2 * unit), (6 * unit, 2 * unit), (6 * unit, 6 * unit), (2 * unit, 6 * unit)]
    points = [(rng.uniform(-1, 12) * unit, rng.uniform(-1, 12) * unit) for _ in range(800)] + rings["square"] + rings["s0"][:20] + [(4 * unit, 2 * unit), (2 * unit, 3 * unit)]
    assert answer(spark, points, rings, cap=4) == {(k, n) for k, p in enumerate(points) for n, r in rings.items() if inside(p, r)}


def test_all_points_in_one_band(spark):
    rng = random.Random(3)
    rings = {"comb": [(k * 1.0, 1000.0 * (k % 2)) for k in range(400)] + [(400.0, -5.0), (0.0, -5.0)], "tall": [(10.0, -1e6), (12.0, 1e6), (300.0, 1e6), (290.0, -1e6)]}
    points = [(rng.uniform(0, 400), 0.25 + 1e-9 * rng.random()) for _ in range(2000)] + [(100.5, 0.5)] * 300
    assert answer(spark, points, rings) == {(k, n) for k, p in enumerate(points) for n, r in rings.items() if inside(p, r)}


def test_points_within_meet_no_segment(spark):
    rng = random.Random(4)
    ring = [(math.cos(a), math.sin(a)) for a in (2 * math.pi * k / 2000 for k in range(2000))]
    boxes = spark.createDataFrame([(0, 0, -0.3, 0.3, -0.3, 0.3)], "cx long, cy long, x_low double, x_high double, y_low double, y_high double")
    polygons = spark.createDataFrame([("disc", [{"x": x, "y": y} for x, y in ring])], "name string, ring array<struct<x: double, y: double>>")
    told = cells.classified(cells.segments(polygons).crossJoin(boxes))
    assert told.where("every").count() < 2000 and told.where("every IS NULL").count() <= 220  # ends within the band, to the right
    points = [(rng.uniform(-1.1, 1.1), rng.uniform(-1.1, 1.1)) for _ in range(500)]
    assert answer(spark, points, {"disc": ring}) == {(k, "disc") for k, p in enumerate(points) if inside(p, ring)}


def test_what_is_no_point_or_polygon(spark):
    nan, inf = float("nan"), float("inf")
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    assert answer(spark, [(1.0, 1.0), (nan, 1.0), (1.0, inf), (None, 1.0), (9.0, 9.0)], {"q": ring, "flat": [(0.0, 1.0), (5.0, 1.0)], "none": []}) == {(0, "q")}
    assert answer(spark, [(9.0, 9.0)], {"q": ring}) == set() and answer(spark, [(1.0, 1.0)], {"none": []}) == set()
    assert answer(spark, [], {"q": ring}) == set()
