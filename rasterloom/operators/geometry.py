"""Parameter lookup, re-layout and resampling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEY


def lookup(frames: DataFrame, params: DataFrame, image_id: str = "image_id", line: str = "line") -> DataFrame:
    """Each frame with its parameter row: the one of its id, else the one with the empty label, else NULLs.

    A table of one row applies to all frames. The table is small (a row per frame at most) and joined by key; Spark
    broadcasts it where its size allows.
    """
    names = [c for c in params.columns if c != line]
    exact = params.select(F.col(line).alias("_id"), *[F.col(c).alias(f"_e_{c}") for c in names], F.lit(True).alias("_hit"))
    fallback = params.groupBy().agg(F.count("*").alias("_n"), *[F.max(F.when(F.col(line) == "", F.struct(c))).alias(f"_d_{c}") for c in names], *[F.max(F.struct(c)).alias(f"_o_{c}") for c in names])
    out = frames.join(exact, frames[image_id] == F.col("_id"), "left").join(F.broadcast(fallback), F.lit(True), "left")  # one row
    value = lambda c: F.when(F.col("_n") == 1, F.col(f"_o_{c}.{c}")).when(F.col("_hit"), F.col(f"_e_{c}")).otherwise(F.col(f"_d_{c}.{c}"))
    return out.select(*frames.columns, *[value(c).alias(c) for c in names])


def reposition(pixels: DataFrame, width: int, height: int, *, left: int = 0, top: int = 0, crop_width: int | None = None, crop_height: int | None = None, transpose: bool = False, rot90: int = 0, flip_x: bool = False, flip_y: bool = False, shift_x: int = 0, shift_y: int = 0) -> DataFrame:
    """Crop or extend, transpose, quarter turns (clockwise), flips, circular shift, in this order.

    Every source pixel computes its own target, so there is no join and no shuffle. Targets without a source have no
    row. Flips map x to w - 1 - x exactly.
    """
    w = width if crop_width is None else crop_width
    h = height if crop_height is None else crop_height
    x, y = F.col("x") - left, F.col("y") - top
    out = pixels.where((x >= 0) & (x < w) & (y >= 0) & (y < h))
    if transpose:
        x, y, w, h = y, x, h, w
    for _ in range(rot90 % 4):
        x, y, w, h = h - 1 - y, x, h, w
    if flip_x:
        x = w - 1 - x
    if flip_y:
        y = h - 1 - y
    x, y = F.pmod(x + shift_x, F.lit(w)), F.pmod(y + shift_y, F.lit(h))
    rest = [c for c in pixels.columns if c not in KEY]
    return out.select("frame_idx", "plane_idx", y.cast("int").alias("y"), x.cast("int").alias("x"), *rest)


def canvas(params: list[tuple[float, float, float, float]], width: int, height: int) -> tuple[int, int, int, int]:
    """left, top, width and height of the box of all transformed corners; params: dx, dy, rotation (degrees), scale."""
    xs, ys = [], []
    for dx, dy, rotation, scale in params:
        c, s = math.cos(math.radians(rotation)) * scale, math.sin(math.radians(rotation)) * scale
        for px, py in ((0, 0), (width, 0), (width, height), (0, height)):
            u, v = px - width / 2, py - height / 2
            xs.append(c * u - s * v + width / 2 + dx)
            ys.append(s * u + c * v + height / 2 + dy)
    return int(-min(xs)), int(-min(ys)), math.ceil(max(xs) - min(xs)), math.ceil(max(ys) - min(ys))


def canvas_of(params: DataFrame, width: int, height: int) -> tuple[int, int, int, int]:
    """canvas() of a parameter table (dx, dy, rotation, scale): extremes by one aggregation; (0, 0, width, height) without rows."""
    c, s = F.cos(F.radians("rotation")) * F.col("scale"), F.sin(F.radians("rotation")) * F.col("scale")
    corners = [(px - width / 2, py - height / 2) for px, py in ((0, 0), (width, 0), (width, height), (0, height))]
    xs = F.array(*[c * u - s * v + width / 2 + F.col("dx") for u, v in corners])
    ys = F.array(*[s * u + c * v + height / 2 + F.col("dy") for u, v in corners])
    low_x, low_y, high_x, high_y = params.agg(F.min(F.array_min(xs)), F.min(F.array_min(ys)), F.max(F.array_max(xs)), F.max(F.array_max(ys))).first()
    return (0, 0, width, height) if low_x is None else (int(-low_x), int(-low_y), math.ceil(high_x - low_x), math.ceil(high_y - low_y))


def transform(pixels: DataFrame, params: DataFrame, width: int, height: int, new_width: int, new_height: int, left: int = 0, top: int = 0) -> DataFrame:
    """Rotation and scale about the centre, then a shift, with bilinear weights.

    params: frame_idx, dx, dy, rotation (degrees), scale, and if need be left, top, width, height of the frame's window on
    the target plane, one row a frame; nulls count as absent. left and top (of canvas()) say where the source's origin
    stands on a target of new_width x new_height. A frame without parameters is only moved there. Each source pixel is
    sent to the targets whose four taps hold it, found from the forward map's box; weights of invalid or missing taps
    count 0, and a target is valid if a tap of some weight has a pixel. One aggregation by target, no grid join.
    """
    given = lambda n, other: F.coalesce(F.col(n), F.lit(other)) if n in params.columns else F.lit(other)
    rotation, scale = F.radians(given("rotation", 0.0)), given("scale", 1.0).cast("double")
    p = params.select(
        "frame_idx", (given("dx", 0.0).cast("double") - given("left", -left)).alias("dx"), (given("dy", 0.0).cast("double") - given("top", -top)).alias("dy"), F.cos(rotation).alias("c"), F.sin(rotation).alias("s"),
        scale.alias("scale"), given("width", new_width).alias("tw"), given("height", new_height).alias("th"),
    )
    absent = {"dx": float(left), "dy": float(top), "c": 1.0, "s": 0.0, "scale": 1.0, "tw": new_width, "th": new_height}
    rows = pixels.where("v is not null").join(p, "frame_idx", "left").fillna(absent, list(absent))
    cx, cy = width / 2, height / 2
    u, v = F.col("x") - cx, F.col("y") - cy
    tx = F.col("scale") * (F.col("c") * u - F.col("s") * v) + cx + F.col("dx")
    ty = F.col("scale") * (F.col("s") * u + F.col("c") * v) + cy + F.col("dy")
    reach = F.col("scale") * (F.abs("c") + F.abs("s")) + 1e-9  # a tap lies less than one source pixel away along each axis
    ends = lambda t: (F.floor(t - F.col("reach")).cast("int") + 1, F.ceil(t + F.col("reach")).cast("int") - 1)
    near = lambda t, size: F.explode(F.when(F.greatest(ends(t)[0], F.lit(0)) <= F.least(ends(t)[1], F.col(size) - 1), F.sequence(F.greatest(ends(t)[0], F.lit(0)), F.least(ends(t)[1], F.col(size) - 1))))
    rows = rows.select("*", tx.alias("tx"), ty.alias("ty"), reach.alias("reach"))
    rows = rows.select("*", near(F.col("tx"), "tw").alias("px")).select("*", near(F.col("ty"), "th").alias("py"))
    a, b = F.col("px") - F.col("dx") - cx, F.col("py") - F.col("dy") - cy
    xs = cx + (F.col("c") * a + F.col("s") * b) / F.col("scale")
    ys = cy + (-F.col("s") * a + F.col("c") * b) / F.col("scale")
    x0, y0 = F.floor(xs), F.floor(ys)
    rows = rows.select("frame_idx", "plane_idx", "py", "px", "x", "y", "v", x0.alias("x0"), y0.alias("y0"), (xs - x0).alias("fx"), (ys - y0).alias("fy"))
    rows = rows.where((F.col("x") - F.col("x0")).isin(0, 1) & (F.col("y") - F.col("y0")).isin(0, 1))
    weight = F.when(F.col("x") == F.col("x0"), 1 - F.col("fx")).otherwise(F.col("fx")) * F.when(F.col("y") == F.col("y0"), 1 - F.col("fy")).otherwise(F.col("fy"))
    rows = rows.withColumn("w", weight).where("w > 0")
    return rows.groupBy("frame_idx", "plane_idx", F.col("py").alias("ty"), F.col("px").alias("tx")).agg(F.sum(F.col("v") * F.col("w")).alias("v")).select("frame_idx", "plane_idx", F.col("ty").alias("y"), F.col("tx").alias("x"), "v")
