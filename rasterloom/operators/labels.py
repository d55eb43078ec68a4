"""Connected groups of pixels on planes of any size: tiles are labelled apart, seams joined by a union over border rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import planes, ranks

#: Side of a tile, which bounds what a task holds.
TILE = 256
PLANE = ["frame_idx", "plane_idx"]


def settled(df: DataFrame) -> DataFrame:
    """The rows as they are now, for plans that use them several times: a reliable checkpoint where a folder is set."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def united(links: DataFrame) -> DataFrame:
    """(frame_idx, plane_idx, label, root) of the labels in links (frame_idx, plane_idx, a, b): the smallest label that each reaches.

    Each round takes the smallest root among a label's neighbours and then the root of that, so rounds are few even where
    a group winds through many tiles.
    """
    both = links.select(*PLANE, "a", "b").union(links.select(*PLANE, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = settled(both)
    roots = settled(both.groupBy(*PLANE, F.col("a").alias("label")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(roots.select(*PLANE, F.col("label").alias("b"), "root"), [*PLANE, "b"]).groupBy(*PLANE, F.col("a").alias("label")).agg(F.min("root").alias("near"))
        new = roots.join(near, [*PLANE, "label"]).select(*PLANE, "label", F.col("root").alias("before"), F.least("root", "near").alias("root"))
        jump = roots.select(*PLANE, F.col("label").alias("root"), F.col("root").alias("beyond"))
        new = settled(new.join(jump, [*PLANE, "root"], "left").select(*PLANE, "label", "before", F.least("root", F.coalesce("beyond", "root")).alias("root")))
        roots = new.drop("before")
        if new.where("root != before").isEmpty():
            return roots


def labelled(bright: DataFrame, corners: bool = True, tile: int = TILE) -> DataFrame:
    """(frame_idx, plane_idx, y, x, v, label) of pixels in groups that touch by edges (and corners): the label is the first
    cell of the group, row by row, as y * 2^32 + x. Only the pixels given take part."""

    def run(pdf):
        y, x = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
        top, left = y.min(), x.min()
        mask = np.zeros((y.max() - top + 1, x.max() - left + 1), bool)
        mask[y - top, x - left] = True
        first = planes._labels(mask, corners)[y - top, x - left]
        return pd.DataFrame({"frame_idx": pdf["frame_idx"], "plane_idx": pdf["plane_idx"], "y": y, "x": x, "v": pdf["v"], "label": ((first // mask.shape[1] + top) << 32) + first % mask.shape[1] + left})

    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    own = bright.select(*PLANE, "y", "x", "v", at("y").alias("ty"), at("x").alias("tx")).groupBy(*PLANE, "ty", "tx").applyInPandas(run, "frame_idx int, plane_idx int, y int, x int, v double, label long")
    own = settled(own)
    edge = lambda c: (F.pmod(F.col(c), F.lit(tile)) == 0) | (F.pmod(F.col(c), F.lit(tile)) == tile - 1)
    border = own.where(edge("y") | edge("x")).select(*PLANE, "y", "x", "label")
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if corners else [])]
    beside = F.explode(F.array(*[F.struct((F.col("y") + a).alias("ny"), (F.col("x") + b).alias("nx")) for a, b in steps])).alias("n")
    across = border.select(*PLANE, "y", "x", F.col("label").alias("a"), beside).where((F.floor(F.col("n.ny") / tile) != F.floor(F.col("y") / tile)) | (F.floor(F.col("n.nx") / tile) != F.floor(F.col("x") / tile)))
    links = across.select(*PLANE, F.col("n.ny").alias("y"), F.col("n.nx").alias("x"), "a").join(border.withColumnRenamed("label", "b"), [*PLANE, "y", "x"]).where("a != b").select(*PLANE, "a", "b")
    links = settled(links)
    if links.isEmpty():
        return own
    return own.join(united(links), [*PLANE, "label"], "left").select(*PLANE, "y", "x", "v", F.coalesce("root", "label").alias("label"))


def points(pixels: DataFrame, quantile: float = 0.95, least: float = 2.0, most: float = 16.0, aspect: float = 2.0, tile: int = TILE) -> DataFrame:
    """Points of each plane: 8-connected groups of pixels over the plane's quantile, in the size range of the two diameters.

    Columns x, y (intensity centroid), brightness (sum), center_brightness, area (pixels), aspect_ratio (of the second
    moments, as sums by label); numbered by distance from the origin. Invalid pixels are background. No task holds more
    than a tile; a group may be of any extent.
    """
    over = ranks.quantiles(pixels, tuple(PLANE), (quantile,)).select(*PLANE, F.col("p")[0].alias("t"))
    bright = pixels.join(over, PLANE).where("v > t").select(*PLANE, "y", "x", "v")
    x, y, v = (F.col(c).cast("double") for c in "xyv")
    sums = labelled(bright, True, tile).groupBy(*PLANE, "label").agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y), ("sv", v), ("svx", v * x), ("svy", v * y))])
    sums = sums.where(F.col("n").between(np.pi * (least / 2) ** 2, np.pi * (most / 2) ** 2))
    m = sums.selectExpr("*", "sxx / n - (sx / n) * (sx / n) + 1 / 12D as a", "syy / n - (sy / n) * (sy / n) + 1 / 12D as b", "sxy / n - (sx / n) * (sy / n) as c")
    m = m.selectExpr("*", "(a + b) / 2 as mid", "sqrt((a - b) * (a - b) / 4 + c * c) as off").selectExpr("*", "sqrt((mid + off) / (mid - off)) as aspect_ratio").where(F.col("aspect_ratio") <= aspect * (1 + 1e-9))
    m = m.select(*PLANE, "label", F.coalesce(F.try_divide("svx", "sv"), F.col("sx") / F.col("n")).alias("cx"), F.coalesce(F.try_divide("svy", "sv"), F.col("sy") / F.col("n")).alias("cy"), F.col("sv").alias("brightness"), F.col("n").cast("int").alias("area"), "aspect_ratio")
    m = settled(m)
    place = m.select(*PLANE, "label", F.bround("cy", 0).cast("int").alias("y"), F.bround("cx", 0).cast("int").alias("x"))
    centre = pixels.select(*PLANE, "y", "x", F.col("v").alias("center_brightness")).join(place, [*PLANE, "y", "x"]).select(*PLANE, "label", "center_brightness")
    order = F.row_number().over(Window.partitionBy(*PLANE).orderBy(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy"), "label")) - 1  # points, not pixels
    return m.join(centre, [*PLANE, "label"], "left").select(*PLANE, order.cast("int").alias("point"), F.col("cx").alias("x"), F.col("cy").alias("y"), "brightness", "center_brightness", "area", "aspect_ratio")
