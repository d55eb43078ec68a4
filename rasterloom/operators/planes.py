"""Operators that need a whole plane: Fourier, linear algebra, denoising, labelling. Memory is bounded by a plane and an
Arrow batch, not by a stream: planes that come in one batch are taken as one stack, so small planes cost no call each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spectra
from .neighbourhood import filter_bank

#: Share of the Laplacian in phase correlation, and how far its peak must stand out over mean and deviation.
DETAIL, SHARP = 0.3, 1.5
REAL, COMPLEX = "frame_idx int, plane_idx int, y int, x int, v double", "frame_idx int, plane_idx int, y int, x int, re double, im double"


def _dense(pdf: pd.DataFrame, columns: tuple[str, ...], width: int, height: int, missing: float = 0.0) -> list[np.ndarray]:
    out = []
    for c in columns:
        a = np.full((height, width), missing)
        a[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf[c].to_numpy(dtype=float, na_value=missing)
        out.append(a)
    return out


def _rows(pdf: pd.DataFrame, **values: np.ndarray) -> pd.DataFrame:
    first = next(iter(values.values()))
    y, x = np.indices(first.shape)
    return pd.DataFrame({"frame_idx": int(pdf["frame_idx"].iloc[0]), "plane_idx": int(pdf["plane_idx"].iloc[0]), "y": y.ravel(), "x": x.ravel()} | {k: v.ravel() for k, v in values.items()})


def _by_plane(pixels: DataFrame, function, schema: str) -> DataFrame:
    return pixels.groupBy("frame_idx", "plane_idx").applyInPandas(function, schema)


def _stacked(pixels: DataFrame, columns: tuple[str, ...], width: int, height: int, kernel: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """kernel of stacks (planes, height, width), one a column, to the named stacks of the result. Planes come sorted, so
    that those that are complete in what was read are taken at once and the last one waits for its rest."""
    keys = ["frame_idx", "plane_idx", "y", "x"]

    def apply(t: pa.Table) -> pa.RecordBatch:
        frame, plane, y, x = (t.column(k).to_numpy() for k in keys)
        new = np.concatenate(([True], (frame[1:] != frame[:-1]) | (plane[1:] != plane[:-1])))
        at, first = np.cumsum(new) - 1, np.flatnonzero(new)
        stacks = []
        for c in columns:
            v = t.column(c).to_numpy(zero_copy_only=False).astype(float)
            stack = np.zeros((len(first), height, width))
            stack[at, y, x] = np.where(np.isnan(v), 0.0, v)
            stacks.append(stack)
        found = kernel(*stacks)
        shape = next(iter(found.values())).shape
        _, ys, xs = np.indices(shape, dtype=np.int32)
        each = lambda v: np.repeat(v[first].astype(np.int32), shape[1] * shape[2])
        return pa.RecordBatch.from_arrays([pa.array(each(frame)), pa.array(each(plane)), pa.array(ys.ravel()), pa.array(xs.ravel()), *[pa.array(np.ascontiguousarray(v, float).ravel()) for v in found.values()]], names=[*keys, *found])

    def run(parts):
        waiting: list[pa.RecordBatch] = []
        for b in parts:
            if not b.num_rows:
                continue
            frame, plane = b.column(0).to_numpy(), b.column(1).to_numpy()
            last = int(np.flatnonzero((frame != frame[-1]) | (plane != plane[-1]))[-1]) + 1 if (frame[0], plane[0]) != (frame[-1], plane[-1]) else 0
            if last == 0 and waiting:
                before = waiting[-1]
                if (before.column(0)[-1].as_py(), before.column(1)[-1].as_py()) != (int(frame[0]), int(plane[0])):
                    yield apply(pa.Table.from_batches(waiting))
                    waiting = []
            if last:
                yield apply(pa.Table.from_batches([*waiting, b.slice(0, last)]))
                waiting = []
            waiting.append(b.slice(last))
        if waiting:
            yield apply(pa.Table.from_batches(waiting))

    dealt = pixels.select(*[F.col(k).cast("int").alias(k) for k in keys], *[F.col(c).cast("double").alias(c) for c in columns])
    return dealt.repartition("frame_idx", "plane_idx").sortWithinPartitions("frame_idx", "plane_idx").mapInArrow(run, schema)


def fft(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Unnormalised 2-D transform of each plane; invalid pixels count 0. Large planes go by blocks."""
    if width * height > spectra.WHOLE:
        return spectra.transform(pixels, width, height)

    def kernel(v):
        f = np.fft.fft2(v, axes=(1, 2))
        return {"re": f.real, "im": f.imag}

    return _stacked(pixels, ("v",), width, height, kernel, COMPLEX)


def ifft(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """The inverse transform, divided by the number of pixels. Large planes go by blocks."""
    if width * height > spectra.WHOLE:
        return spectra.transform(pixels, width, height, inverse=True)

    def kernel(re, im):
        f = np.fft.ifft2(re + 1j * im, axes=(1, 2))
        return {"re": f.real, "im": f.imag}

    return _stacked(pixels, ("re", "im"), width, height, kernel, COMPLEX)


def smooth_length(n: int) -> int:
    """The least length of at least n whose prime factors are 2, 3 and 5."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def _padded(extent: tuple[int, int], kernel: np.ndarray) -> tuple[int, int]:
    return tuple(smooth_length(a + b - 1) for a, b in zip(extent, kernel.shape, strict=True))


def _spectra(data: np.ndarray, kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    shape = _padded(data.shape[1:], kernel)
    return np.fft.fft2(data, shape, axes=(1, 2)), np.fft.fft2(kernel, shape), shape


def fft_convolve(pixels: DataFrame, kernel, width: int, height: int) -> DataFrame:
    """Convolution by spectra, for kernels too large to explode; the same centre and borders as neighbourhood.convolve.
    Large planes go by blocks."""
    k = np.array(kernel, dtype=float)
    if width * height > spectra.WHOLE:
        return spectra.filtered(pixels, k, width, height, _padded((height, width), k), np.multiply, (k.shape[0] // 2, k.shape[1] // 2))

    def run(v):
        a, b, _ = _spectra(v, k)
        cy, cx = k.shape[0] // 2, k.shape[1] // 2
        return {"v": np.fft.ifft2(a * b, axes=(1, 2)).real[:, cy : cy + height, cx : cx + width]}

    return _stacked(pixels, ("v",), width, height, run, REAL)


def deconvolve(pixels: DataFrame, kernel, width: int, height: int, noise: float = 0.01) -> DataFrame:
    """Wiener filter conj(H) / (|H|^2 + noise); the modulus of the result. Large planes go by blocks."""
    k = np.array(kernel, dtype=float)
    response = lambda a, h: a * np.conj(h) / (np.abs(h) ** 2 + noise)
    if width * height > spectra.WHOLE:
        return spectra.filtered(pixels, k, width, height, _padded((height, width), k), response, (-(k.shape[0] // 2), -(k.shape[1] // 2)), np.abs)

    def run(v):
        a, b, _ = _spectra(v, k)
        full = np.fft.ifft2(response(a, b), axes=(1, 2))
        full = np.roll(full, (k.shape[0] // 2, k.shape[1] // 2), axis=(1, 2))
        return {"v": np.abs(full)[:, :height, :width]}

    return _stacked(pixels, ("v",), width, height, run, REAL)


def matrix_product(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ("frame_idx", "plane_idx")) -> DataFrame:
    """Rows of a times columns of b, plane by plane: an equi-join on the inner index and a sum."""
    left = a.select(*on, F.col("y").alias("i"), F.col("x").alias("k"), F.col("v").alias("va"))
    right = b.select(*on, F.col("y").alias("k"), F.col("x").alias("j"), F.col("v").alias("vb"))
    return left.join(right, [*on, "k"]).groupBy(*on, F.col("i").alias("y"), F.col("j").alias("x")).agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def inverse_matrix(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Inverse of each plane; singular planes become invalid. Planes that are not square raise."""
    if width != height:
        raise ValueError(f"a plane of {width} x {height} has no inverse")

    def run(v):
        try:
            return {"v": np.linalg.inv(v)}
        except np.linalg.LinAlgError:  # one of them is singular
            out = np.full(v.shape, np.nan)
            for k, m in enumerate(v):
                try:
                    out[k] = np.linalg.inv(m)
                except np.linalg.LinAlgError:
                    continue
            return {"v": out}

    return _stacked(pixels, ("v",), width, height, run, REAL).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))


def _labels(mask: np.ndarray, corners: bool) -> np.ndarray:
    """The smallest cell number of each cell's connected group (by edges, and by corners too); mask.size outside."""
    h, w = mask.shape
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape), mask.size)
    steps = [(a, b) for a in range(3) for b in range(3) if corners or a == 1 or b == 1]
    while True:
        wide = np.pad(label, 1, constant_values=mask.size)
        new = np.where(mask, np.min([wide[a : a + h, b : b + w] for a, b in steps], axis=0), mask.size)
        if (new == label).all():
            return label
        label = new


def protected(v: np.ndarray, percentile: float, radius: int) -> np.ndarray:
    """Cells of a plane (invalid: NaN) within `radius` of a bright group: over the percentile, or 2 or 5 below it, four cells
    or more that touch by edges."""
    out, (h, w) = np.zeros(v.shape, bool), v.shape
    for level in (percentile, percentile - 2, percentile - 5):
        if level <= 0 or np.isnan(v).all():
            continue
        mask = np.nan_to_num(v, nan=-np.inf) > np.nanpercentile(v, level)
        label = _labels(mask, False)
        counts = np.bincount(label[mask], minlength=mask.size + 1)
        mask &= counts[label] >= 4
        wide = np.pad(mask, radius)
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                if dx * dx + dy * dy <= radius * radius:
                    out |= wide[radius + dy : radius + dy + h, radius + dx : radius + dx + w]
    return out


def wavelet_denoise(pixels: DataFrame, width: int, height: int, sigma: float, taps: list[float], levels: int = 4, stars: float | None = None, radius: int = 3, tile: int | None = None) -> DataFrame:
    """Soft threshold sigma sqrt(2 ln n) of the detail bands of each level, by an orthogonal transform with half-sample
    symmetric extension, of any extent. Levels are as many as leave about 8 pixels, one at least.

    Invalid pixels count 0 in the transform and stay invalid; only the pixels that are there are returned. Pixels about
    bright groups over the percentile `stars` stay as they are (None: nowhere). With `tile`, each square of that side is
    an image of its own, which bounds what a task holds.
    """
    if tile:
        side = F.struct(F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"))
        pixels = pixels.withColumn("at", side)
    bank = {k: np.array(v) for k, v in filter_bank(taps).items()}
    size = len(taps)

    def split(a, axis):
        a = np.moveaxis(a, axis, -1)
        out = (a.shape[-1] + size - 1) // 2
        wide = np.pad(a, [(0, 0), (size - 1, size - 1)], mode="symmetric")
        return [np.moveaxis(sum(bank[f][t] * wide[:, size - t : size - t + 2 * out - 1 : 2] for t in range(size)), -1, axis) for f in ("dec_lo", "dec_hi")]

    def join(low, high, axis):
        low, high = np.moveaxis(low, axis, -1), np.moveaxis(high, axis, -1)
        n = low.shape[-1]
        out = np.zeros((len(low), 2 * n - 2 + size))
        for f, c in (("rec_lo", low), ("rec_hi", high)):
            for t in range(size):
                out[:, t : t + 2 * n - 1 : 2] += bank[f][t] * c
        return np.moveaxis(out[:, size - 2 : 2 * n], -1, axis)

    def tiled(key, pdf):
        ty, tx = key[2]["ty"] * tile, key[2]["tx"] * tile
        out = run(pdf.assign(y=pdf["y"] - ty, x=pdf["x"] - tx), min(tile, width - tx), min(tile, height - ty))
        return out.assign(y=out["y"] + ty, x=out["x"] + tx)

    def run(pdf, width=width, height=height):
        a, kept = _dense(pdf, ("v",), width, height)[0], []
        for _ in range(min(levels, max(1, int(np.log2(max(1, min(a.shape) // 8)))))):
            low, high = split(a, 0)
            (a, ad), (da, dd) = split(low, 1), split(high, 1)
            t = sigma * np.sqrt(2 * np.log(ad.size))
            kept.append([np.sign(c) * np.maximum(np.abs(c) - t, 0) for c in (ad, da, dd)])
        for ad, da, dd in reversed(kept):
            a = a[: ad.shape[0], : ad.shape[1]]  # one too long where the extent was odd
            a = join(join(a, ad, 1), join(da, dd, 1), 0)
        if stars is not None:
            given = _dense(pdf, ("v",), width, height, np.nan)[0]
            a = np.where(protected(given, stars, radius), np.nan_to_num(given), a[:height, :width])
        out = pdf[["frame_idx", "plane_idx", "y", "x"]].copy()
        out["v"] = np.where(pdf["v"].isna(), np.nan, a[pdf["y"].to_numpy(), pdf["x"].to_numpy()])
        return out

    found = pixels.groupBy("frame_idx", "plane_idx", "at").applyInPandas(tiled, REAL) if tile else _by_plane(pixels, lambda pdf: run(pdf), REAL)
    return found.withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))


def label_planes(pixels: DataFrame, width: int, height: int, quantile: float = 0.95, least: float = 2.0, most: float = 16.0, aspect: float = 2.0) -> DataFrame:
    """Points of each plane, see labels.points; the extent does not matter."""
    from . import labels  # which labels tiles with what is here

    return labels.points(pixels, quantile, least, most, aspect)


def _beside(pixels: DataFrame, reference: DataFrame, largest: int = 1 << 22) -> DataFrame:
    """Pixels of each frame with the reference's at the same place, as r: of the same frame if the reference has frames,
    else of the one reference plane, which is broadcast where it is counted to be small."""
    own = "frame_idx" in reference.columns
    r = reference.select(*(["frame_idx"] if own else []), "y", "x", F.col("v").alias("r"))
    if own:
        return pixels.select("frame_idx", "y", "x", "v").join(r, ["frame_idx", "y", "x"], "full_outer")
    small = r.count() <= largest
    both = pixels.select("frame_idx", "y", "x", "v").join(F.broadcast(r) if small else r, ["y", "x"], "left")
    frames = pixels.select("frame_idx").distinct().withColumn("one", F.lit(1))
    # places of the reference at which a frame has no pixel: few columns, and one row a frame and place
    rest = frames.join((F.broadcast(r) if small else r).withColumn("one", F.lit(1)), "one").join(pixels.select("frame_idx", "y", "x"), ["frame_idx", "y", "x"], "left_anti")
    return both.select("frame_idx", "y", "x", "v", "r").union(rest.select("frame_idx", "y", "x", F.lit(None).cast("double"), "r"))


def normalised(pixels: DataFrame) -> DataFrame:
    """Frames' planes with the range of three deviations on both sides of the mean as whole numbers from 0 to 255; invalid
    pixels are 127, planes without any deviation 0."""
    of = pixels.groupBy("frame_idx", "plane_idx").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))
    level = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), ((F.col("v") - F.col("mean")) / F.col("deviation") + 3) / 6 * 255))).cast("double")
    v = F.when(F.col("deviation") > 0, F.coalesce(level, F.lit(127.0))).otherwise(0.0)
    return pixels.join(of, ["frame_idx", "plane_idx"]).select("frame_idx", "plane_idx", "y", "x", v.alias("v"))


def phase_shift(pixels: DataFrame, reference: DataFrame, width: int, height: int, most: float | None = None) -> DataFrame:
    """(frame_idx, dx, dy, sharpness, success) of each frame against its reference (see _beside), by the peak of the cross-power spectrum.

    The planes are mixed with the size of their Laplacians for detail, normalised and windowed. A shift fails where it
    exceeds `most` pixels or the peak is less than SHARP times the surface's mean and deviation.
    """
    window = np.outer(np.hanning(height + 2)[1:-1], np.hanning(width + 2)[1:-1])

    def run(pdf):
        a, b = _dense(pdf, ("v", "r"), width, height)
        lap = lambda m: sum(np.roll(m, s, axis) for s in (1, -1) for axis in (0, 1)) - 4 * m
        a, b = ((1 - DETAIL) * m + DETAIL * np.abs(lap(m)) for m in (a, b))
        a, b = ((m - m.mean()) / (m.std() or 1) * window for m in (a, b))
        cross = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
        peak = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
        y, x = np.unravel_index(peak.argmax(), peak.shape)
        near = [((y + i) % height, (x + j) % width) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]
        w = np.maximum([peak[p] for p in near], 0)
        dy, dx = y + (w[1] - w[2]) / (w.sum() or 1), x + (w[3] - w[4]) / (w.sum() or 1)
        dx, dy = float(dx - width if dx > width / 2 else dx), float(dy - height if dy > height / 2 else dy)
        size = np.abs(peak)
        sharp = float(size.max() / ((size.mean() + size.std()) or 1))
        ok = sharp >= SHARP and (most is None or max(abs(dx), abs(dy)) <= most)
        return pd.DataFrame({"frame_idx": [int(pdf["frame_idx"].iloc[0])], "dx": [dx], "dy": [dy], "sharpness": [sharp], "success": [ok]})

    return _beside(pixels, reference).groupBy("frame_idx").applyInPandas(run, "frame_idx int, dx double, dy double, sharpness double, success boolean")


def template_match(pixels: DataFrame, reference: DataFrame, width: int, height: int, reach: int = 8, least: float = 0.3) -> DataFrame:
    """(frame_idx, dx, dy, score, success): place of the reference's centre half in each frame, by normalised cross-correlation of at least `least`."""

    def run(pdf):
        a, b = _dense(pdf, ("v", "r"), width, height)
        y0, x0, h, w = height // 4, width // 4, max(1, height // 2), max(1, width // 2)
        t = b[y0 : y0 + h, x0 : x0 + w]
        t = (t - t.mean()) / (t.std() or 1)
        best = (-2.0, 0, 0)
        for dy in range(max(-reach, -y0), min(reach, height - h - y0) + 1):
            for dx in range(max(-reach, -x0), min(reach, width - w - x0) + 1):
                part = a[y0 + dy : y0 + dy + h, x0 + dx : x0 + dx + w]
                best = max(best, (float(((part - part.mean()) / (part.std() or 1) * t).mean()), dx, dy))
        return pd.DataFrame({"frame_idx": [int(pdf["frame_idx"].iloc[0])], "dx": [float(best[1])], "dy": [float(best[2])], "score": [best[0]], "success": [best[0] >= least]})

    return _beside(pixels, reference).groupBy("frame_idx").applyInPandas(run, "frame_idx int, dx double, dy double, score double, success boolean")
