"""Points of frames: the brightest of each cell, pairs within a radius, neighbours, similarities in least squares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def topk_grid(points: DataFrame, by: str, width: float, height: float, rows: int = 3, columns: int = 3, k: int = 8, more: int | None = None) -> DataFrame:
    """The k points of the greatest `by` in each grid cell of a frame; ties go to the smaller id. With `more`, the greatest of
    the others follow until a frame has as many as all cells could hold, and so many more."""
    cell = (F.floor(F.col("y") * rows / height) * columns + F.floor(F.col("x") * columns / width)).cast("int")
    rank = F.row_number().over(Window.partitionBy("frame_idx", "cell").orderBy(F.desc(by), "id"))
    ranked = points.withColumn("cell", cell).withColumn("rank", rank)
    if more is None:
        return ranked.where(F.col("rank") <= k)
    place = F.row_number().over(Window.partitionBy("frame_idx").orderBy(F.col("rank") > k, F.desc(by), "id"))  # points, not pixels
    return ranked.withColumn("place", place).where(F.col("place") <= rows * columns * k + more).drop("place")


def pairs_within(left: DataFrame, right: DataFrame, radius: float, on: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_a, id_b, d2) of points of two relations nearer than radius: an equi-join on square buckets of that side.

    Only the right side is sent to its nine neighbours; a pair meets in the left point's bucket alone, and so do all pairs
    of one left point. Sizes of exploded sides are not known to the planner, so neither side is ever broadcast. `on` are
    further keys of both sides, `carry` columns of the left one that pairs keep.
    """
    bucket = lambda c: F.floor(F.col(c) / radius).cast("long")
    a = left.select(*on, *carry, F.col("id").alias("id_a"), F.col("x").alias("xa"), F.col("y").alias("ya"), bucket("x").alias("bx"), bucket("y").alias("by"))
    b = right.select(*on, F.col("id").alias("id_b"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.explode(F.array(*[F.struct((bucket("x") + i).alias("bx"), (bucket("y") + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("b"))
    b = b.select("*", "b.bx", "b.by").drop("b")
    d2 = (F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb")) + (F.col("ya") - F.col("yb")) * (F.col("ya") - F.col("yb"))
    return a.join(b.hint("merge"), [*on, "bx", "by"]).select(*on, *carry, "id_a", "id_b", "xa", "ya", "xb", "yb", d2.alias("d2")).where(F.col("d2") < radius * radius)


def nearest(pairs: DataFrame, count: int, on: tuple[str, ...] = ()) -> DataFrame:
    """Of the pairs of each left point, those with the nearest others (at most count; ties by the smaller id), as neighbours:
    (id, other, xi, eta), places about the point."""
    rank = F.row_number().over(Window.partitionBy(*on, "id_a").orderBy("d2", "id_b"))
    return pairs.where("id_a != id_b").withColumn("rank", rank).where(F.col("rank") <= count).select(*on, F.col("id_a").alias("id"), F.col("id_b").alias("other"), (F.col("xb") - F.col("xa")).alias("xi"), (F.col("yb") - F.col("ya")).alias("eta"))


def similarity_fit(pairs: DataFrame, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """Closed-form similarity from (xa, ya) to (xb, yb) in least squares: a, b, dx, dy with x' = a x - b y + dx. Sums only."""
    s = {n: F.sum(e) for n, e in (("n", F.lit(1.0)), ("xa", F.col("xa")), ("ya", F.col("ya")), ("xb", F.col("xb")), ("yb", F.col("yb")), ("aa", F.col("xa") * F.col("xa") + F.col("ya") * F.col("ya")), ("dot", F.col("xa") * F.col("xb") + F.col("ya") * F.col("yb")), ("cross", F.col("xa") * F.col("yb") - F.col("ya") * F.col("xb")))}
    t = pairs.groupBy(*keys).agg(*[e.alias(f"s_{n}") for n, e in s.items()])
    c = {n: F.col(f"s_{n}") for n in s}
    down = c["aa"] - (c["xa"] * c["xa"] + c["ya"] * c["ya"]) / c["n"]
    a = F.try_divide(c["dot"] - (c["xa"] * c["xb"] + c["ya"] * c["yb"]) / c["n"], down)
    b = F.try_divide(c["cross"] - (c["xa"] * c["yb"] - c["ya"] * c["xb"]) / c["n"], down)
    t = t.withColumns({"a": a, "b": b})
    return t.select(*keys, F.col("s_n").cast("long").alias("n"), "a", "b", ((c["xb"] - F.col("a") * c["xa"] + F.col("b") * c["ya"]) / c["n"]).alias("dx"), ((c["yb"] - F.col("b") * c["xa"] - F.col("a") * c["ya"]) / c["n"]).alias("dy"))
