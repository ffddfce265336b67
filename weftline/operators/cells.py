"""Points in polygons over a quadtree of cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import written

#: Halvings of both axes from a round to the next, and rounds; segments up to which a cell is a leaf.
STEP, ROUNDS, CAP = 3, 4, 32
_KEY = ["cx", "cy"]
_SEGMENT = ["name", "x1", "y1", "x2", "y2"]


def _finite(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in columns])


def segments(polygons: DataFrame) -> DataFrame:
    """(name, x1, y1, x2, y2) of the sides of ``polygons(name, ring)`` that are not level; sides without finite ends are no sides."""

    def side(p: Column, i: Column) -> Column:
        q = F.get(F.col("ring"), F.pmod(i + 1, F.size("ring")))
        return F.struct(*[v.cast("double").alias(n) for v, n in ((p["x"], "x1"), (p["y"], "y1"), (q["x"], "x2"), (q["y"], "y2"))])

    sides = polygons.select("name", F.explode(F.transform("ring", side)).alias("s")).select("name", "s.*")
    return sides.where(_finite("x1", "y1", "x2", "y2") & (F.col("y1") != F.col("y2")))


def crosses(x: str = "x", y: str = "y") -> Column:
    """Whether the ray from a point to the right meets a segment: the even-odd rule's test."""
    x, y = F.col(x), F.col(y)
    return ((F.col("y1") > y) != (F.col("y2") > y)) & (x < (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))


def classified(pairs: DataFrame) -> DataFrame:
    """Pairs of a cell's box of points and a segment with ``every``: true if each point's ray meets it, null if points must be asked; others are dropped.

    Boxes are the extents of the points in a cell, so no border is rounded; near a segment's own rounding points are asked.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    met, whole = (high > F.col("y_low")) & (low <= F.col("y_high")), (low <= F.col("y_low")) & (high > F.col("y_high"))
    at = lambda y: (F.col("x2") - F.col("x1")) * (F.greatest(low, F.least(high, F.col(y))) - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    slack = 1e-9 * (F.abs("x1") + F.abs("x2") + F.abs("x_low") + F.abs("x_high"))
    left, right = F.least(at("y_low"), at("y_high")) - slack, F.greatest(at("y_low"), at("y_high")) + slack
    beside = F.coalesce(F.col("x_low") > right, F.lit(False))
    return pairs.where(met & ~beside).withColumn("every", F.when(whole & (F.col("x_high") < left), True))


def point_in_polygon(points: DataFrame, polygons: DataFrame, cap: int = CAP) -> DataFrame:
    """(id, name) pairs of ``points(id, x, y)`` inside ``polygons(name, ring)``; ring is an array of (x, y), even-odd rule.

    The extent of the points that lie within the polygons' is cut into four to the power of ``STEP`` cells a round, whatever the unit of the coordinates and
    however thin the band they lie in. A cell that all of a segment lies to the right of counts it once for all of its points; one
    that it lies to the left of, above or below drops it. Only what passes by a cell's own points is handed to the cells within, until
    it is ``cap`` segments or fewer or rounds end, so points within a ring far from its border meet no segment. Cells are made from boxes that were summed
    up once; points are joined once, to the leaf that holds them.

    Points with null, NaN or infinite coordinates lie in nothing, nor do ids that are null; ids are unique. Names are too.
    """
    sides = written(segments(polygons), "sides")
    ends = lambda c: (F.least(f"{c}1", f"{c}2"), F.greatest(f"{c}1", f"{c}2"))
    box = sides.agg(F.min(ends("x")[0]), F.max(ends("x")[1]), F.min(ends("y")[0]), F.max(ends("y")[1])).head()
    schema = f"id {points.schema['id'].dataType.simpleString()}, name {polygons.schema['name'].dataType.simpleString()}"
    if box[0] is None:
        return points.sparkSession.createDataFrame([], schema)
    near = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    near = near.where(F.col("id").isNotNull() & _finite("x", "y") & F.col("x").between(box[0], box[1]) & F.col("y").between(box[2], box[3]))
    x0, x1, y0, y1 = near.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).head()
    if x0 is None:
        return points.sparkSession.createDataFrame([], schema)
    deep = STEP * ROUNDS
    place = lambda c, a, b: F.least(F.floor((F.col(c) / 2 - a / 2) / ((b / 2 - a / 2) or 1.0) * (1 << deep)), F.lit((1 << deep) - 1)).cast("long")
    near = near.withColumns({"cx": place("x", x0, x1), "cy": place("y", y0, y1)})
    extents = [F.min("x").alias("x_low"), F.max("x").alias("x_high"), F.min("y").alias("y_low"), F.max("y").alias("y_high")]
    fine = written(near.groupBy(*_KEY).agg(*extents), "boxes")  # at most 4 to the power of ``deep``

    leaves: list[DataFrame] = []
    asked = counted = None
    for k in range(ROUNDS):
        shift = deep - STEP * (k + 1)
        up = [F.shiftright(c, shift).alias(c) for c in _KEY]
        boxes = fine.select(*up, "x_low", "x_high", "y_low", "y_high").groupBy(*_KEY).agg(F.min("x_low").alias("x_low"), F.max("x_high").alias("x_high"), F.min("y_low").alias("y_low"), F.max("y_high").alias("y_high"))
        above = boxes.select(*[F.shiftright(c, STEP).alias(f"p{c}") for c in _KEY], *boxes.columns)
        outer = lambda df: df.withColumnsRenamed({c: f"p{c}" for c in _KEY})
        pairs = sides.crossJoin(F.broadcast(boxes)) if k == 0 else outer(asked).join(above, ["pcx", "pcy"])  # 64 boxes in the first round
        told = written(classified(pairs).select(*_KEY, "every", *_SEGMENT), "told")
        base = told.where("every").groupBy(*_KEY, "name").agg(F.count(F.lit(1)).alias("n"))
        if counted is not None:
            base = base.unionByName(outer(counted).join(above.select("pcx", "pcy", *_KEY), ["pcx", "pcy"]).select(*base.columns))
            base = base.groupBy(*_KEY, "name").agg(F.sum("n").alias("n"))
        many = told.where("every IS NULL").groupBy(*_KEY).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > (cap if k < ROUNDS - 1 else (1 << 62)))
        many = written(many.select(*_KEY), "open")
        base = written(base, "counted")
        shut = lambda df: df.join(many, _KEY, "left_anti")  # noqa: B023,E731
        tests = told.where("every IS NULL").drop("every")
        done = shut(tests).select(*_KEY, *_SEGMENT, F.lit(0).cast("long").alias("n")).unionByName(shut(base.where("n % 2 = 1")).select(*_KEY, "name", "n"), allowMissingColumns=True)
        cells = fine.select(F.col("cx").alias("fx"), F.col("cy").alias("fy"), *up)
        leaves.append(cells.join(done, _KEY).drop(*_KEY))
        asked, counted = tests.join(many, _KEY, "left_semi"), base.join(many, _KEY, "left_semi")
        if many.isEmpty():
            break
    leaf = written(reduce(lambda a, b: a.unionByName(b), leaves), "leaves")
    met = near.join(leaf, (near.cx == leaf.fx) & (near.cy == leaf.fy)).withColumn("hit", F.when(F.col("x1").isNull(), F.col("n")).otherwise(crosses().cast("long")))
    return met.groupBy("id", "name").agg(F.sum("hit").alias("n")).where("n % 2 = 1").select("id", "name")
