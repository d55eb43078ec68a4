"""Kernels, quantile windows and wavelets as tap joins: every pixel goes to the few cells that it reaches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEY, grid

#: 3 x 3 binomial and sharpening kernels.
BLUR = ((1 / 16, 2 / 16, 1 / 16), (2 / 16, 4 / 16, 2 / 16), (1 / 16, 2 / 16, 1 / 16))
SHARPEN = ((0.0, -1.0, 0.0), (-1.0, 5.0, -1.0), (0.0, -1.0, 0.0))


def gaussian_kernel(size: int = 9, spread: float = 1.0) -> tuple[tuple[float, ...], ...]:
    """exp(-(dx^2 + dy^2) / spread), normalised to one."""
    c = size // 2
    rows = [[math.exp(-((x - c) ** 2 + (y - c) ** 2) / spread) for x in range(size)] for y in range(size)]
    total = sum(map(sum, rows))
    return tuple(tuple(v / total for v in r) for r in rows)


def disk(radius: int) -> tuple[tuple[float | None, ...], ...]:
    """Ones inside a disk, None (excluded) outside."""
    return tuple(tuple(1.0 if x * x + y * y <= radius * radius else None for x in range(-radius, radius + 1)) for y in range(-radius, radius + 1))


def _taps(kernel, dy: int, dx: int) -> Column:
    """Array of (dy, dx, k) of a kernel, from which a cell's contributions are exploded."""
    taps = [(a - dy, b - dx, k) for a, row in enumerate(kernel) for b, k in enumerate(row) if k is not None]
    return F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(float(k)).alias("k")) for a, b, k in taps])


def _inside(width: int, height: int) -> Column:
    return F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)


def convolve(pixels: DataFrame, kernel, width: int, height: int) -> DataFrame:
    """True convolution, zero outside and where invalid, centre at size // 2; every cell of the extent has a value.

    The taps are exploded map-side and summed with partial aggregation; small kernels only (about 15 x 15).
    """
    taps = F.explode(_taps(kernel, len(kernel) // 2, len(kernel[0]) // 2)).alias("t")
    moved = pixels.where("v is not null").select("frame_idx", "plane_idx", "y", "x", "v", taps)
    moved = moved.select("frame_idx", "plane_idx", (F.col("y") + F.col("t.dy")).alias("y"), (F.col("x") + F.col("t.dx")).alias("x"), (F.col("v") * F.col("t.k")).alias("v")).where(_inside(width, height))
    empty = grid(pixels.select("frame_idx", "plane_idx").distinct(), width, height).select(*KEY, F.lit(0.0).alias("v"))
    return moved.union(empty).groupBy(*KEY).agg(F.sum("v").alias("v"))


def along(pixels: DataFrame, axis: str, size: int, taps: dict[int, float]) -> DataFrame:
    """The sum of taps[k] times the value k places further along an axis, mirrored at the borders (half-sample symmetric).

    Invalid pixels count 0 and stay invalid; pixels that are not there get no row. Taps reach less far than the extent.
    """
    at = F.col(axis)
    reach = max(abs(k) for k in taps)
    sent = lambda image: F.array(*[F.struct((image - k).alias("p"), F.lit(float(w)).alias("k")) for k, w in taps.items()])
    none = F.array().cast("array<struct<p: int, k: double>>")
    every = F.concat(sent(at), F.when(at < reach, sent(-1 - at)).otherwise(none), F.when(at >= size - reach, sent(2 * size - 1 - at)).otherwise(none))
    moved = pixels.where("v is not null").select(*KEY, "v", F.explode(F.filter(every, lambda c: c["p"].between(0, size - 1))).alias("c"))
    moved = moved.select(*[F.col("c.p").alias(c) if c == axis else c for c in KEY], (F.col("v") * F.col("c.k")).alias("v"), F.lit(False).alias("own"))
    own = pixels.select(*KEY, F.lit(0.0).alias("v"), F.col("v").isNotNull().alias("own"))
    return moved.union(own).groupBy(*KEY).agg(F.sum("v").alias("v"), F.max("own").alias("own")).where("own").select(*KEY, "v").union(pixels.where("v is null").select(*KEY, "v"))


def gaussian(pixels: DataFrame, width: int, height: int, sigma: float) -> DataFrame:
    """A Gaussian of this deviation in pixels, cut off beyond four deviations, along both axes in turn."""
    reach = int(4 * sigma + 0.5)
    raw = {k: math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)}
    taps = {k: w / sum(raw.values()) for k, w in raw.items()}
    return along(along(pixels, "y", height, taps), "x", width, taps)


def gradient(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """The length of the Sobel gradient."""
    slope, soft = {-1: -1.0, 1: 1.0}, {-1: 1.0, 0: 2.0, 1: 1.0}
    gx = along(along(pixels, "x", width, slope), "y", height, soft)
    gy = along(along(pixels, "y", height, slope), "x", width, soft).withColumnRenamed("v", "w")
    return gx.join(gy, list(KEY)).select(*KEY, F.sqrt(F.col("v") * F.col("v") + F.col("w") * F.col("w")).alias("v"))


#: Taps up to which windows are exploded; larger ones go by tiles of this side.
TAPS, TILE = 225, 64


def quantile_filter(pixels: DataFrame, kernel, width: int, height: int, q: float = 0.5) -> DataFrame:
    """Nearest-rank quantile of the window's values times the kernel; None in the kernel and invalid pixels do not count.

    The window of a cell begins (size - 1) // 2 before it; the rank is q (n - 1), rounded half to even. Every cell of the
    extent has a row; without a valid value in its window it is NULL. Large windows are taken tile by tile.
    """
    back = tuple(tuple(row) for row in kernel)
    if len(back) * len(back[0]) > TAPS:
        return _quantile_tiles(pixels, back, width, height, q)
    ky, kx = (len(back) - 1) // 2, (len(back[0]) - 1) // 2
    moved = pixels.where("v is not null").select(*KEY, "v", F.explode(_taps(back, ky, kx)).alias("t"))
    moved = moved.select("frame_idx", "plane_idx", (F.col("y") - F.col("t.dy")).alias("y"), (F.col("x") - F.col("t.dx")).alias("x"), (F.col("v") * F.col("t.k")).alias("v")).where(_inside(width, height))
    empty = grid(pixels.select("frame_idx", "plane_idx").distinct(), width, height).select(*KEY, F.lit(None).cast("double").alias("v"))
    ranked = moved.union(empty).groupBy(*KEY).agg(F.sort_array(F.collect_list("v")).alias("s"))
    return ranked.select(*KEY, F.get("s", F.bround(F.lit(q) * (F.size("s") - 1), 0).cast("int")).alias("v"))


def _quantile_tiles(pixels: DataFrame, kernel, width: int, height: int, q: float) -> DataFrame:
    """quantile_filter where a window holds many pixels: each pixel goes to the tiles that its windows touch, a tile is one group."""
    values = np.array([[np.nan if k is None else float(k) for k in row] for row in kernel])
    up, left = (values.shape[0] - 1) // 2, (values.shape[1] - 1) // 2
    down, right = values.shape[0] - 1 - up, values.shape[1] - 1 - left
    tiles = lambda c, before, after, size: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - after) / TILE).cast("int")), F.least(F.lit((size - 1) // TILE), F.floor((F.col(c) + before) / TILE).cast("int"))))
    empty = grid(pixels.select("frame_idx", "plane_idx").distinct(), -(-width // TILE), -(-height // TILE))
    dealt = pixels.where("v is not null").select(*KEY, "v", tiles("y", up, down, height).alias("ty")).select("*", tiles("x", left, right, width).alias("tx"))
    dealt = dealt.unionByName(empty.select("frame_idx", "plane_idx", F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(None).cast("double").alias("v"), F.col("y").alias("ty"), F.col("x").alias("tx")))

    def run(pdf):
        y0, x0 = int(pdf["ty"].iloc[0]) * TILE, int(pdf["tx"].iloc[0]) * TILE
        h, w = min(TILE, height - y0), min(TILE, width - x0)
        a = np.full((h + up + down, w + left + right), np.nan)
        some = pdf[pdf["v"].notna()]
        a[some["y"].to_numpy() - y0 + up, some["x"].to_numpy() - x0 + left] = some["v"].to_numpy()
        used = ~np.isnan(values)
        view = np.lib.stride_tricks.sliding_window_view(a, values.shape)
        out = np.full((h, w), np.nan)
        for i in range(h):  # a row of windows at once
            s = np.sort(view[i][:, used] * values[used], axis=1)
            n = (~np.isnan(s)).sum(axis=1)
            rank = np.round(q * (n - 1)).astype(int)  # half to even
            out[i] = np.where(n > 0, s[np.arange(w), np.maximum(rank, 0)], np.nan)
        y, x = np.indices(out.shape)
        return pd.DataFrame({"frame_idx": int(pdf["frame_idx"].iloc[0]), "plane_idx": int(pdf["plane_idx"].iloc[0]), "y": (y + y0).ravel(), "x": (x + x0).ravel(), "v": out.ravel()})

    found = dealt.groupBy("frame_idx", "plane_idx", "ty", "tx").applyInPandas(run, "frame_idx int, plane_idx int, y int, x int, v double")
    return found.withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))


def parse_quantile(name: str) -> tuple[float, int | None]:
    """q and the number of approximation rounds that a plane's name asks for."""
    q, rounds, tokens = 0.5, None, name.split()
    for word, value in zip(tokens, tokens[1:], strict=False):
        if word in ("quantile", "q"):
            q = float(value)
        elif word in ("approximation", "approx"):
            rounds = int(value)
    return q, rounds


def filter_bank(taps: list[float]) -> dict[str, list[float]]:
    """Analysis and synthesis filters of an orthogonal bank from its scaling filter."""
    scale = math.sqrt(2) / sum(taps)
    rec_lo = [t * scale for t in taps]
    rec_hi = [(-t if n % 2 else t) for n, t in enumerate(reversed(rec_lo))]
    return {"dec_lo": rec_lo[::-1], "dec_hi": rec_hi[::-1], "rec_lo": rec_lo, "rec_hi": rec_hi}


#: Scaling filter of the Daubechies wavelet with two vanishing moments.
DB2 = [(1 + math.sqrt(3)) / (4 * math.sqrt(2)), (3 + math.sqrt(3)) / (4 * math.sqrt(2)), (3 - math.sqrt(3)) / (4 * math.sqrt(2)), (1 - math.sqrt(3)) / (4 * math.sqrt(2))]


def _analyse(pixels: DataFrame, axis: str, size: int, taps: list[float]) -> DataFrame:
    """c[i] = sum of taps[t] * x[2 i + 1 - t] along an axis, with half-sample symmetric extension."""
    length = len(taps)
    out = (size + length - 1) // 2
    at = F.col(axis)
    taps_at = lambda image: F.array(*[F.struct((image + t - 1).alias("p"), F.lit(float(k)).alias("k")) for t, k in enumerate(taps)])
    none = F.array().cast("array<struct<p: int, k: double>>")
    # the places that show this sample: itself, and near a border its mirror image
    count = F.concat(taps_at(at), F.when(at < length, taps_at(-1 - at)).otherwise(none), F.when(at >= size - length, taps_at(2 * size - 1 - at)).otherwise(none))
    count = F.filter(count, lambda c: (F.pmod(c["p"], F.lit(2)) == 0) & c["p"].between(0, 2 * out - 2))
    rest = [c for c in KEY if c != axis]
    moved = pixels.where("v is not null").select(*KEY, "v", F.explode(count).alias("c"))
    return moved.groupBy(*rest, F.shiftright(F.col("c.p"), 1).alias(axis)).agg(F.sum(F.col("v") * F.col("c.k")).alias("v")).select(*KEY, "v")


def dwt(pixels: DataFrame, width: int, height: int, taps: list[float] = DB2) -> dict[str, DataFrame]:
    """One level of the 2-D wavelet transform: bands aa, ad, da, dd (first letter: y axis). The extent must be at least as
    long as the filter; the bands are (n + L - 1) // 2 long."""
    bank = filter_bank(taps)
    halves = {n: _analyse(pixels, "y", height, bank[f"dec_{k}"]) for n, k in (("a", "lo"), ("d", "hi"))}
    return {a + b: _analyse(halves[a], "x", width, bank[f"dec_{k}"]) for a in "ad" for b, k in (("a", "lo"), ("d", "hi"))}


def _synthesise(low: DataFrame, high: DataFrame, axis: str, size: int, bank: dict[str, list[float]]) -> DataFrame:
    """x[n] = sum of c[i] * taps[n + L - 2 - 2 i] over both bands."""
    parts = None
    for band, taps in ((low, bank["rec_lo"]), (high, bank["rec_hi"])):
        reach = F.array(*[F.struct((2 * F.col(axis) + t - len(taps) + 2).alias("p"), F.lit(float(k)).alias("k")) for t, k in enumerate(taps)])
        moved = band.select(*KEY, "v", F.explode(reach).alias("c")).where(F.col("c.p").between(0, size - 1))
        moved = moved.select(*[F.col("c.p").alias(c) if c == axis else c for c in KEY], (F.col("v") * F.col("c.k")).alias("v"))
        parts = moved if parts is None else parts.union(moved)
    return parts.groupBy(*KEY).agg(F.sum("v").alias("v"))


def idwt(bands: dict[str, DataFrame], width: int, height: int, taps: list[float] = DB2) -> DataFrame:
    """The inverse of dwt for the extent it was taken over."""
    bank = filter_bank(taps)
    return _synthesise(_synthesise(bands["aa"], bands["ad"], "x", width, bank), _synthesise(bands["da"], bands["dd"], "x", width, bank), "y", height, bank)


def dwt_levels(pixels: DataFrame, width: int, height: int, levels: int, taps: list[float] = DB2) -> dict[str, tuple[DataFrame, int, int]]:
    """Several levels: each band by name with its width and height. The details of level k are adk, dak and ddk (level 1 is
    the finest), aa is the approximation of the last one. Levels end where an extent is shorter than the filter."""
    out, extents, low = {}, [(width, height)], pixels
    for k in range(1, levels + 1):
        w, h = extents[-1]
        if min(w, h) < len(taps):
            break
        bands = dwt(low, w, h, taps)
        extents.append(((w + len(taps) - 1) // 2, (h + len(taps) - 1) // 2))
        out |= {f"{n}{k}": (bands[n], *extents[-1]) for n in ("ad", "da", "dd")}
        low = bands["aa"]
    return {"aa": (low, *extents[-1])} | out


def idwt_levels(bands: dict[str, tuple[DataFrame, int, int]], width: int, height: int, taps: list[float] = DB2) -> DataFrame:
    """The inverse of dwt_levels for the extent it was taken over."""
    low, levels = bands["aa"][0], sum(n.startswith("dd") for n in bands)
    for k in range(levels, 0, -1):
        w, h = bands[f"dd{k - 1}"][1:] if k > 1 else (width, height)
        low = idwt({"aa": low} | {n: bands[f"{n}{k}"][0] for n in ("ad", "da", "dd")}, w, h, taps)
    return low
