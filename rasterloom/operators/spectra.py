"""Fourier transforms of planes of any extent. Rows are transformed in blocks of rows, columns in blocks of columns; between
the two steps planes travel as binary pieces, so a task holds one block and never a large plane. Planes of small extent
go by lots, the same block of as many frames at once as a strip of a large plane has cells for."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows or columns of a block, and cells of a plane beyond which planes go by blocks.
BLOCK, WHOLE = 64, 1 << 20
#: Cells of a lot's strip, unless a single frame's has more.
CELLS = 1 << 16
GROUP = ["lot", "plane_idx", "at"]
PIECES = "lot int, plane_idx int, at int, of int, frames binary, data binary"


def _lot(block: int, width: int, height: int) -> Column:
    """The lot of a frame: as many successive frame numbers as have strips of CELLS together."""
    return F.floor(F.col("frame_idx") / max(1, CELLS // (block * max(width, height)))).cast("int")


def _cut(key: tuple, frames: np.ndarray, strips: np.ndarray, axis: int, block: int) -> pd.DataFrame:
    """A block's strips (frames, rows, columns) cut along their long side: a piece for each block (at) of the other
    direction, and where it comes from (of)."""
    starts = range(0, strips.shape[axis], block)
    data = [(strips[:, k : k + block] if axis == 1 else strips[:, :, k : k + block]).tobytes() for k in starts]
    return pd.DataFrame({"lot": key[0], "plane_idx": key[1], "at": [k // block for k in starts], "of": key[2], "frames": frames.tobytes(), "data": data})


def _joined(pdf: pd.DataFrame, shape: tuple[int, int], axis: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The frames of a lot and a block's strips from their pieces, zero where no piece came."""
    whose = [np.frombuffer(f, np.int32) for f in pdf["frames"]]
    frames = np.unique(np.concatenate(whose))
    out = np.zeros((len(frames), *shape), complex)
    for mine, of, data in zip(whose, pdf["of"], pdf["data"], strict=True):
        part, k, at = np.frombuffer(data, complex), np.searchsorted(frames, mine), slice(of * block, (of + 1) * block)
        if axis == 1:
            out[k, at] = part.reshape(len(k), -1, shape[1])
        else:
            out[k, :, at] = part.reshape(len(k), shape[0], -1)
    return frames, out


def _across(pixels: DataFrame, columns: tuple[str, ...], width: int, height: int, length: int, step: Callable, block: int, lot: Column) -> DataFrame:
    """Pieces of the rows' transforms of this length; invalid and absent pixels count 0."""

    def run(key, pdf):
        top = key[2] * block
        frames, k = np.unique(pdf["frame_idx"].to_numpy(dtype=np.int32), return_inverse=True)
        rows = np.zeros((len(frames), min(block, height - top), width), complex)
        parts = [pdf[c].to_numpy(dtype=float, na_value=0.0) for c in columns]
        rows[k, pdf["y"].to_numpy() - top, pdf["x"].to_numpy()] = parts[0] if len(parts) == 1 else parts[0] + 1j * parts[1]
        return _cut(key, frames, step(rows, length, axis=2), 2, block)

    dealt = pixels.select(lot.alias("lot"), "plane_idx", F.floor(F.col("y") / block).cast("int").alias("at"), "frame_idx", "y", "x", *columns)
    return dealt.groupBy(*GROUP).applyInPandas(run, PIECES)


def _placed(key: tuple, frames: np.ndarray, top: int, left: int, **values: np.ndarray) -> pd.DataFrame:
    k, y, x = np.indices(next(iter(values.values())).shape, dtype=np.int32)
    return pd.DataFrame({"frame_idx": frames[k.ravel()], "plane_idx": key[1], "y": (y + top).ravel(), "x": (x + left).ravel()} | {n: v.ravel() for n, v in values.items()})


def transform(pixels: DataFrame, width: int, height: int, inverse: bool = False, block: int = BLOCK) -> DataFrame:
    """Each plane's unnormalised transform (v to re, im), or the inverse one divided by the number of pixels (re, im to re, im)."""
    step = np.fft.ifft if inverse else np.fft.fft

    def down(key, pdf):
        left = key[2] * block
        frames, strips = _joined(pdf, (height, min(block, width - left)), 1, block)
        f = step(strips, axis=1)
        return _placed(key, frames, 0, left, re=f.real, im=f.imag)

    pieces = _across(pixels, ("re", "im") if inverse else ("v",), width, height, width, step, block, _lot(block, width, height))
    return pieces.groupBy(*GROUP).applyInPandas(down, "frame_idx int, plane_idx int, y int, x int, re double, im double")


def filtered(pixels: DataFrame, kernel: np.ndarray, width: int, height: int, shape: tuple[int, int], response: Callable, origin: tuple[int, int], finish: Callable = np.real, block: int = BLOCK) -> DataFrame:
    """response(spectrum, kernel's spectrum) of each plane padded to this shape (height, width), taken back.

    The result begins at the origin (y, x) of the padded plane and wraps round there. Two shuffles of pieces; the
    kernel's spectrum is worked out for a block's columns alone.
    """
    ys, xs = (np.arange(height) + origin[0]) % shape[0], (np.arange(width) + origin[1]) % shape[1]

    def down(key, pdf):
        columns = slice(key[2] * block, min((key[2] + 1) * block, shape[1]))
        frames, strips = _joined(pdf, (height, columns.stop - columns.start), 1, block)
        f = np.fft.fft(strips, shape[0], axis=1)
        h = np.fft.fft(np.fft.fft(kernel, shape[1], axis=1)[:, columns], shape[0], axis=0)
        return _cut(key, frames, np.fft.ifft(response(f, h), axis=1)[:, ys], 1, block)

    def back(key, pdf):
        top = key[2] * block
        frames, strips = _joined(pdf, (min(block, height - top), shape[1]), 2, block)
        return _placed(key, frames, top, 0, v=finish(np.fft.ifft(strips, axis=2)[:, :, xs]))

    pieces = _across(pixels, ("v",), width, height, shape[1], np.fft.fft, block, _lot(block, shape[1], shape[0]))
    pieces = pieces.groupBy(*GROUP).applyInPandas(down, PIECES)
    return pieces.groupBy(*GROUP).applyInPandas(back, "frame_idx int, plane_idx int, y int, x int, v double")
