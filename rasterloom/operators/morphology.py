"""Windows over tiles with a border: dilation by disks, background of star images. No task holds more than a tile."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEY

#: Side of a tile; cells on either side of the background's window, and of a saturated cell's disk, which is laid twice.
TILE, REACH, DISK = 256, 25, 10
REAL = "frame_idx int, plane_idx int, y int, x int, v double"


def on_tiles(pixels: DataFrame, halo: int, width: int, height: int, kernel: Callable[[np.ndarray], np.ndarray], tile: int = TILE) -> DataFrame:
    """Pixels that a kernel makes of each tile with `halo` cells of its neighbours about it. Cells that are invalid, absent or
    beyond the extent are NaN; cells that the kernel leaves NaN have no row. A pixel goes to the tiles that it can reach."""
    tiles = lambda c, size: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / tile)).cast("int"), F.least(F.lit((size - 1) // tile), F.floor((F.col(c) + halo) / tile)).cast("int")))
    inside = F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)
    dealt = pixels.where(F.col("v").isNotNull() & inside).select(*KEY, F.col("v").cast("double").alias("v"), tiles("y", height).alias("ty")).select("*", tiles("x", width).alias("tx"))

    def run(key, pdf):
        top, left = key[2] * tile - halo, key[3] * tile - halo
        a = np.full((tile + 2 * halo, tile + 2 * halo), np.nan)
        a[pdf["y"].to_numpy() - top, pdf["x"].to_numpy() - left] = pdf["v"].to_numpy()
        h, w = min(tile, height - top - halo), min(tile, width - left - halo)
        own = kernel(a)[halo : halo + h, halo : halo + w]
        y, x = np.nonzero(~np.isnan(own))
        return pd.DataFrame({"frame_idx": key[0], "plane_idx": key[1], "y": y + top + halo, "x": x + left + halo, "v": own[y, x]})

    return dealt.groupBy("frame_idx", "plane_idx", "ty", "tx").applyInPandas(run, REAL)


def _rows_maximum(a: np.ndarray, reach: int) -> np.ndarray:
    """Greatest value within reach along rows: maxima over powers of two, two of which cover a window."""
    wide, size = np.pad(a, ((0, 0), (reach, reach)), constant_values=-np.inf), 2 * reach + 1
    step = 1
    while 2 * step <= size:
        wide = np.maximum(wide[:, :-step], wide[:, step:])
        step *= 2
    return np.maximum(wide[:, : a.shape[1]], wide[:, size - step : size - step + a.shape[1]])


def _disk_maximum(a: np.ndarray, radius: int) -> np.ndarray:
    """Greatest value within the disk about each cell, -inf where there is none."""
    out = np.full(a.shape, -np.inf)
    for dy in range(min(radius, len(a) - 1) + 1):
        rows = _rows_maximum(a, math.isqrt(radius * radius - dy * dy))
        out[: len(a) - dy] = np.maximum(out[: len(a) - dy], rows[dy:])
        out[dy:] = np.maximum(out[dy:], rows[: len(a) - dy])
    return out


def dilate(pixels: DataFrame, radius: int, width: int, height: int, times: int = 1, tile: int = TILE) -> DataFrame:
    """The greatest valid value within the disk of this radius about each cell of the extent, so many times over. Cells that no
    valid value reaches have no row; on a mask that holds its true cells alone, as 1, this is the binary dilation."""

    def kernel(a):
        a = np.where(np.isnan(a), -np.inf, a)
        for _ in range(times):
            a = _disk_maximum(a, radius)
        return np.where(a == -np.inf, np.nan, a)

    return on_tiles(pixels, radius * times, width, height, kernel, tile)


def erode(pixels: DataFrame, radius: int, width: int, height: int, times: int = 1, tile: int = TILE) -> DataFrame:
    """The least valid value within the disk about each cell (see dilate)."""
    return dilate(pixels.withColumn("v", -F.col("v")), radius, width, height, times, tile).withColumn("v", -F.col("v"))


def _box_sum(a: np.ndarray, reach: int) -> np.ndarray:
    """Sums of the squares of 2 reach + 1 cells about each cell; outside counts 0."""
    for axis in (0, 1):
        total = np.cumsum(np.pad(a, [(1, 0) if k == axis else (0, 0) for k in (0, 1)]), axis=axis)
        at = np.arange(a.shape[axis])
        a = total.take(np.minimum(at + reach + 1, a.shape[axis]), axis) - total.take(np.maximum(at - reach, 0), axis)
    return a


def _median(a: np.ndarray, reach: int) -> np.ndarray:
    """The lower median of the valid cells of a square window, where values are few different ones: windows are counted level by level."""
    some = ~np.isnan(a)
    rank = (_box_sum(some.astype(np.int32), reach) - 1) // 2
    out, below = np.full(a.shape, np.nan), np.zeros(a.shape, np.int32)
    for level in np.unique(a[some]):
        below += _box_sum((a == level).astype(np.int32), reach)
        out[np.isnan(out) & (below > rank)] = level
    return out


def _blurred(a: np.ndarray) -> np.ndarray:
    """Binomial means of 3 x 3 valid cells as whole numbers; invalid cells stay so."""
    h, w = a.shape
    wide = np.pad(a, 1, constant_values=np.nan)
    held = np.where(np.isnan(wide), 0.0, wide)
    total, weight = np.zeros(a.shape), np.zeros(a.shape)
    for dy, p in enumerate((1, 2, 1)):
        for dx, q in enumerate((1, 2, 1)):
            total += p * q * held[dy : dy + h, dx : dx + w]
            weight += p * q * ~np.isnan(wide[dy : dy + h, dx : dx + w])
    return np.where(np.isnan(a), np.nan, np.round(total / np.maximum(weight, 1)))


def star_planes(pixels: DataFrame, width: int, height: int, saturation: float | None = None, reach: int = REACH, disk: int = DISK, tile: int = TILE) -> DataFrame:
    """What stands out in planes of whole numbers from 0 to 255 (see planes.normalised): blurred, less the background, 0 at
    least. The background is the lower median of the square window of valid cells within `reach`.

    With `saturation`, cells over that percentage of a plane's greatest value are saturated; they and what two disks about
    them reach are 0. Invalid pixels have no row.
    """

    def kernel(a):
        b = _blurred(a)
        return np.where(np.isnan(b), np.nan, np.maximum(b - _median(b, reach), 0))

    found = on_tiles(pixels, reach + 1, width, height, kernel, tile)
    if saturation is None:
        return found
    plane = ["frame_idx", "plane_idx"]
    peaks = found.groupBy(*plane).agg((F.max("v") * saturation / 100).alias("most"))
    reached = dilate(found.join(peaks, plane).where("v > most").select(*KEY, F.lit(1.0).alias("v")), disk, width, height, 2, tile)
    return found.join(reached.select(*KEY, F.lit(True).alias("hidden")), list(KEY), "left").select(*KEY, F.when(F.col("hidden"), 0.0).otherwise(F.col("v")).alias("v"))
