"""Surface fits and frame statistics from sums that Spark aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ranks

#: Exponents of x and y of the quadratic basis, in order 1, x, y, x^2, xy, y^2.
BASIS = ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2))


def _power(i: int, j: int) -> Column:
    out = F.lit(1.0)
    for c, n in (("x", i), ("y", j)):
        for _ in range(n):
            out = out * F.col(c)
    return out


def moments(pixels: DataFrame) -> DataFrame:
    """Per frame and plane, the sums of x^i y^j (i + j up to 4) and of v x^i y^j (up to 2) over valid pixels: one aggregation."""
    sums = [F.sum(_power(i, j)).alias(f"s{i}{j}") for i in range(5) for j in range(5 - i)]
    sums += [F.sum(F.col("v") * _power(i, j)).alias(f"t{i}{j}") for i, j in BASIS]
    return pixels.where("v is not null").groupBy("frame_idx", "plane_idx").agg(*sums)


def quadratic_fit(pixels: DataFrame) -> DataFrame:
    """(frame_idx, plane_idx, c: six coefficients in basis order) of the least-squares surface; few pixels give zeros or the shortest solution."""

    def solve(parts):
        for pdf in parts:
            out = []
            for _, r in pdf.iterrows():
                a = np.array([[r[f"s{i + k}{j + m}"] for k, m in BASIS] for i, j in BASIS], dtype=float)
                out.append(np.linalg.lstsq(a, np.array([r[f"t{i}{j}"] for i, j in BASIS], dtype=float), rcond=None)[0].tolist())
            yield pdf[["frame_idx", "plane_idx"]].assign(c=out)

    return moments(pixels).mapInPandas(solve, "frame_idx int, plane_idx int, c array<double>")


def surface(c: Column) -> Column:
    """The quadratic surface of six coefficients at x, y."""
    return sum((F.element_at(c, k + 1) * _power(i, j) for k, (i, j) in enumerate(BASIS)), F.lit(0.0))


def subtract_background(pixels: DataFrame) -> DataFrame:
    """Pixels less the quadratic surface of their plane; the coefficients are a row a plane, joined by key."""
    fit = quadratic_fit(pixels)
    return pixels.join(fit, ["frame_idx", "plane_idx"]).select("frame_idx", "plane_idx", "y", "x", (F.col("v") - surface(F.col("c"))).alias("v"))


def histogram(pixels: DataFrame, bins: int = 256, log: bool = False) -> DataFrame:
    """(frame_idx, plane_idx, bin, n): equal bins between a plane's extremes (or their logarithms, positive values only)."""
    v = pixels.where("v is not null and v > 0").withColumn("v", F.log("v")) if log else pixels.where("v is not null")
    ends = v.groupBy("frame_idx", "plane_idx").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    bin_ = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) * bins / (F.col("high") - F.col("low"))))).otherwise(F.lit(0))
    return v.join(ends, ["frame_idx", "plane_idx"]).groupBy("frame_idx", "plane_idx", bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def mode_value(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """(frame_idx, plane_idx, mode): the centre of the fullest bin, the lowest of equals."""
    ends = pixels.groupBy("frame_idx", "plane_idx").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    best = histogram(pixels, bins).groupBy("frame_idx", "plane_idx").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"))
    return best.join(ends, ["frame_idx", "plane_idx"]).select("frame_idx", "plane_idx", (F.col("low") + (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / bins).alias("mode"))


def histogram_quantile(pixels: DataFrame, q: float, bins: int = 1024) -> DataFrame:
    """(frame_idx, value): quantile over all planes of a frame, from bin centres of its histogram."""
    one = pixels.withColumn("plane_idx", F.lit(0))
    ends = one.groupBy("frame_idx").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    counts = histogram(one, bins)
    run = F.sum("n").over(Window.partitionBy("frame_idx").orderBy("bin")) / F.sum("n").over(Window.partitionBy("frame_idx"))
    at = counts.withColumn("cdf", run).where(F.col("cdf") >= q).groupBy("frame_idx").agg(F.min("bin").alias("bin"))
    return at.join(ends, "frame_idx").select("frame_idx", (F.col("low") + (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / bins).alias("value"))


def half_open_end(v: Column, whole: bool) -> Column:
    """The exclusive upper end of a display range: one more for whole numbers, else a little more."""
    return v + 1 if whole else F.greatest(v * (1 + 2.0**-23), v + 2.0**-126)


def display(pixels: DataFrame, low: float = 0.01, high: float = 0.99, per_plane: bool = False) -> DataFrame:
    """Pixels scaled to 0..255 between percentiles of their frame (or plane); invalid pixels become 0."""
    keys = ["frame_idx", "plane_idx"] if per_plane else ["frame_idx"]
    p = ranks.quantiles(pixels, tuple(keys), (low, high))
    scaled = F.try_divide((F.col("v") - F.col("p")[0]) * 255, F.col("p")[1] - F.col("p")[0])
    level = F.least(F.lit(255), F.greatest(F.lit(0), F.bround(F.coalesce(scaled, F.lit(0.0)), 0).cast("int")))
    return pixels.join(p, keys, "left").select("frame_idx", "plane_idx", "y", "x", level.alias("level"))


def isolines(pixels: DataFrame, step: float) -> DataFrame:
    """Position of each value in its band of width step, from 0 up to 1."""
    return pixels.select("frame_idx", "plane_idx", "y", "x", (F.pmod("v", F.lit(step)) / step).alias("v"))


def percentile_zoom(pixels: DataFrame, low: float = 0.001, high: float = 0.999, bins: int = 256, margin: float = 0.1) -> DataFrame:
    """(frame_idx, zoom_min, zoom_end): the bin centres of a frame's planes at ranks floor(low n) and floor(high n), with a
    margin of a tenth of what lies between on either side."""
    ends = pixels.groupBy("frame_idx", "plane_idx").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    centres = histogram(pixels, bins).join(ends, ["frame_idx", "plane_idx"]).select("frame_idx", (F.col("low") + (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / bins).alias("centre"), "n")
    w = Window.partitionBy("frame_idx")  # bins, not pixels
    run = centres.groupBy("frame_idx", "centre").agg(F.sum("n").alias("n")).withColumns({"run": F.sum("n").over(w.orderBy("centre")), "total": F.sum("n").over(w)})
    first = lambda q: F.min(F.when(F.col("run") > F.floor(F.col("total") * q), F.col("centre")))
    got = run.groupBy("frame_idx").agg(first(low).alias("a"), first(high).alias("b"))
    return got.select("frame_idx", (F.col("a") - (F.col("b") - F.col("a")) * margin).alias("zoom_min"), (F.col("b") + (F.col("b") - F.col("a")) * margin).alias("zoom_end"))
