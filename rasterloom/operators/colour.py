"""Colour, tone and layout operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import lab, rgb
from ..model import KEY
from . import ranks

#: Plane of each cell of a 2 x 2 mosaic, row by row (R, G, B as 0, 1, 2).
BAYER = {"RGGB": (0, 1, 1, 2), "GRBG": (1, 0, 2, 1), "GBRG": (1, 2, 0, 1), "BGGR": (2, 1, 1, 0)}


def wide(pixels: DataFrame, planes: int = 3) -> DataFrame:
    """One row per frame and cell, plane k in column p<k>: a partial aggregation, no join."""
    cols = [F.max(F.when(F.col("plane_idx") == k, F.col("v"))).alias(f"p{k}") for k in range(planes)]
    return pixels.groupBy("frame_idx", "y", "x").agg(*cols)


def long(cells: DataFrame, values: list[Column]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("plane_idx"), v.alias("v")) for k, v in enumerate(values)])
    return cells.select("frame_idx", "y", "x", F.explode(rows).alias("r")).select("frame_idx", "r.plane_idx", "y", "x", "r.v")


def _rgb_columns(planes: int) -> tuple[Column, Column, Column]:
    p = [F.col(f"p{k}") for k in range(planes)]
    return (p[0], (p[1] + p[3]) / 2, p[2]) if planes == 4 else (p[0], p[1], p[2])


def to_lab(pixels: DataFrame, planes: int = 3, cube_root: bool = False) -> DataFrame:
    """Linear (or cube-root) Lab planes of RGB or RGBG pixels; with four planes green is the mean of both."""
    c = _rgb_columns(planes)
    return long(wide(pixels, planes), list(lab(*[F.cbrt(x) for x in c] if cube_root else c)))


def to_rgb(pixels: DataFrame, cube_root: bool = False) -> DataFrame:
    c = rgb(F.col("p0"), F.col("p1"), F.col("p2"))
    return long(wide(pixels), [F.pow(x, 3) for x in c] if cube_root else list(c))


def merge_rgbg(pixels: DataFrame) -> DataFrame:
    return long(wide(pixels, 4), list(_rgb_columns(4)))


def colour_mask(pixels: DataFrame, spheres: list[tuple[float, float, float, float, float]], space: str = "RGB") -> DataFrame:
    """Product over spheres (x, y, z, radius, sigma): 0 inside, 1 - exp(-((d - r) / sigma)^2) to three sigma beyond, 1 outside."""
    c = (F.col("p0"), F.col("p1"), F.col("p2"))
    c = lab(*c) if space == "Lab" else c
    mask: Column = F.lit(1.0)
    for x, y, z, radius, sigma in spheres:
        d = F.sqrt(sum((a - b) * (a - b) for a, b in zip(c, (x, y, z), strict=True)))
        edge = 1 - F.exp(-F.pow((d - radius) / sigma, 2)) if sigma else F.lit(1.0)
        mask = mask * F.when(d <= radius, 0.0).when(d <= radius + 3 * sigma, edge).when(d.isNotNull(), 1.0)
    return long(wide(pixels), [mask] * 3)


def bayer_sparse(pixels: DataFrame, pattern: str = "RGGB") -> DataFrame:
    """Three planes of the full extent, each valid only at its colour's cells."""
    own = F.element_at(F.array(*[F.lit(c) for c in BAYER[pattern]]), ((F.col("y") % 2) * 2 + F.col("x") % 2 + 1).cast("int"))
    planes = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("p")
    return pixels.where("plane_idx = 0").select("frame_idx", "y", "x", "v", own.alias("own"), planes).select("frame_idx", F.col("p").alias("plane_idx"), "y", "x", F.when(F.col("own") == F.col("p"), F.col("v")).alias("v"))


def bayer_dense(pixels: DataFrame, pattern: str = "RGGB") -> DataFrame:
    """Four half-size planes R, G1, B, G2; the first green of a mosaic cell is G1. Transformations scale by one half."""
    order, seen = [], 0
    for c in BAYER[pattern]:
        order.append({0: 0, 2: 2}.get(c, 1 if not seen else 3))
        seen += c == 1
    plane = F.element_at(F.array(*[F.lit(k) for k in order]), ((F.col("y") % 2) * 2 + F.col("x") % 2 + 1).cast("int"))
    return pixels.where("plane_idx = 0").select("frame_idx", plane.alias("plane_idx"), F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"), "v")


def auto_levels(pixels: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Display range of each frame: interpolated percentiles over all planes, 0 to 1 where nothing is valid."""
    p = pixels.select("frame_idx").distinct().join(ranks.quantiles(pixels, ("frame_idx",), (low, high)), "frame_idx", "left")
    return p.select("frame_idx", F.coalesce(F.col("p")[0], F.lit(0.0)).alias("low"), F.coalesce(F.col("p")[1], F.lit(1.0)).alias("high"))


def spline(points: list[tuple[float, float]], condition: str = "natural") -> list[tuple[float, float, tuple[float, float, float, float]]]:
    """(from, to, coefficients by power of x - from) of the cubic through the points; two points or fewer: the line."""
    pts = sorted(points)
    x, y = np.array([p[0] for p in pts], float), np.array([p[1] for p in pts], float)
    n = len(x) - 1
    if n <= 1:
        return [(x[0], x[-1], (y[0], (y[-1] - y[0]) / (x[-1] - x[0]) if n else 0.0, 0.0, 0.0))]
    h = np.diff(x)
    a, r = np.zeros((n + 1, n + 1)), np.zeros(n + 1)  # for the second derivatives
    for i in range(1, n):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    if condition == "clamped":
        a[0, :2], r[0] = (2 * h[0], h[0]), 6 * (y[1] - y[0]) / h[0]
        a[n, n - 1 :], r[n] = (h[-1], 2 * h[-1]), -6 * (y[n] - y[n - 1]) / h[-1]
    elif condition == "not-a-knot" and n >= 3:
        a[0, :3], a[n, n - 2 :] = (h[1], -(h[0] + h[1]), h[0]), (h[-1], -(h[-2] + h[-1]), h[-2])
    elif condition == "not-a-knot":  # three points: one parabola
        a[0, :2], a[n, n - 1 :] = (1, -1), (1, -1)
    else:
        a[0, 0] = a[n, n] = 1
    m = np.linalg.solve(a, r)
    return [(float(x[i]), float(x[i + 1]), tuple(map(float, (y[i], (y[i + 1] - y[i]) / h[i] - h[i] * (2 * m[i] + m[i + 1]) / 6, m[i] / 2, (m[i + 1] - m[i]) / (6 * h[i]))))) for i in range(n)]


def tone_curve(v: Column, points: list[tuple[float, float]], condition: str = "natural", out: tuple[float, float] = (0.0, 1.0)) -> Column:
    """The curve as one nested expression, clamped beyond its ends, scaled to the output range and clipped."""
    parts = spline(points, condition)
    pts = sorted(points)
    value = F.when(v < pts[0][0], F.lit(float(pts[0][1]))).when(v > pts[-1][0], F.lit(float(pts[-1][1])))
    for low, high, c in parts:
        t = v - low
        value = value.when(v <= high, c[0] + t * (c[1] + t * (c[2] + t * c[3])))
    scaled = value * (out[1] - out[0]) + out[0]
    return F.when(v.isNotNull(), F.greatest(F.lit(out[0]), F.least(F.lit(out[1]), scaled)))


#: Fixed values of the colour space used for chroma denoising.
YUV = ((0.299, 0.587, 0.114), (-0.14713, -0.28886, 0.436), (0.615, -0.51499, -0.10001))


def matrix_colours(cells: DataFrame, matrix) -> DataFrame:
    """p0..p2 times a 3 x 3 matrix."""
    p = [F.col(f"p{k}") for k in range(3)]
    return cells.select("frame_idx", "y", "x", *[(p[0] * r[0] + p[1] * r[1] + p[2] * r[2]).alias(f"p{k}") for k, r in enumerate(matrix)])


#: Fixed values of the colour spaces for denoising: linear colour to XYZ and back, colour to luminance and two differences and back.
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
FROM_XYZ = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875992, 0.041556), (0.055648, -0.204043, 1.057311))
DIFFERENCES = ((0.299, 0.587, 0.114), (-0.147, -0.289, 0.436), (0.615, -0.515, -0.100))
FROM_DIFFERENCES = ((1.0, 0.0, 1.140), (1.0, -0.394, -0.581), (1.0, 2.032, 0.0))


def to_space(cells: DataFrame, space: str) -> DataFrame:
    """p0..p2 of colours from 0 to 1 in the space "Lab" (by XYZ, without a white point), "YUV" or "HSV"."""
    if space == "YUV":
        return matrix_colours(cells, DIFFERENCES)
    if space == "Lab":
        x, y, z = (F.cbrt(f"p{k}") for k in range(3))
        return matrix_colours(cells, XYZ).select("frame_idx", "y", "x", (116 * y - 16).alias("p0"), (500 * (x - y)).alias("p1"), (200 * (y - z)).alias("p2"))
    r, g, b = (F.col(f"p{k}") for k in range(3))
    known = r.isNotNull() & g.isNotNull() & b.isNotNull()
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    # of equal largest colours the last one decides
    hue = F.when(top == low, 0.0).when(top == b, 4 + (r - g) / (top - low)).when(top == g, 2 + (b - r) / (top - low)).otherwise((g - b) / (top - low)) / 6
    hue = F.when(hue < 0, hue + 1).otherwise(hue)
    of = lambda c: F.when(known, c)
    return cells.select("frame_idx", "y", "x", of(hue).alias("p0"), of(F.when(top != 0, (top - low) / top).otherwise(0.0)).alias("p1"), of(top).alias("p2"))


def from_space(cells: DataFrame, space: str) -> DataFrame:
    """The inverse of to_space, clipped to 0..1."""
    p = [F.col(f"p{k}") for k in range(3)]
    if space == "HSV":
        h = p[0] * 6
        sector, f = F.pmod(F.floor(h), F.lit(6)), h - F.floor(h)
        down, q, t = p[2] * (1 - p[1]), p[2] * (1 - p[1] * f), p[2] * (1 - p[1] * (1 - f))
        order = ((p[2], t, down), (q, p[2], down), (down, p[2], t), (down, q, p[2]), (t, down, p[2]), (p[2], down, q))
        parts = []
        for k in range(3):
            value = F.lit(None).cast("double")
            for i, row in enumerate(order):
                value = F.when(sector == i, row[k]).otherwise(value)
            parts.append(value.alias(f"p{k}"))
        cells = cells.select("frame_idx", "y", "x", *parts)
    elif space == "YUV":
        cells = matrix_colours(cells, FROM_DIFFERENCES)
    else:
        y = (p[0] + 16) / 116
        cube = lambda c: c * c * c
        cells = matrix_colours(cells.select("frame_idx", "y", "x", cube(p[1] / 500 + y).alias("p0"), cube(y).alias("p1"), cube(y - p[2] / 200).alias("p2")), FROM_XYZ)
    clip = lambda c: F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))
    return cells.select("frame_idx", "y", "x", *[clip(F.col(f"p{k}")).alias(f"p{k}") for k in range(3)])


def inverse_matrix_of(matrix):
    return tuple(map(tuple, np.linalg.inv(np.array(matrix)).tolist()))


def transpose(pixels: DataFrame) -> DataFrame:
    return pixels.select("frame_idx", "plane_idx", F.col("x").alias("y"), F.col("y").alias("x"), *[c for c in pixels.columns if c not in KEY])
