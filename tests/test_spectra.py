"""Fourier transforms by blocks against those of whole planes."""

import numpy as np
import pytest
from rasterloom.operators import planes, spectra


@pytest.fixture(scope="module")
def stack(spark):
    """Two frames of 13 x 10 with holes: the relation, and the planes with zeros in the holes."""
    a = np.random.default_rng(3).normal(size=(2, 13, 10))
    holes = np.random.default_rng(4).random(a.shape) < 0.2
    a[1, 4:8] = 0  # a whole block of rows is absent
    rows = [(k, 0, y, x, None if holes[k, y, x] else float(a[k, y, x])) for k in range(2) for y in range(13) for x in range(10) if not (k == 1 and 4 <= y < 8)]
    return spark.createDataFrame(rows, "frame_idx int, plane_idx int, y int, x int, v double"), np.where(holes, 0, a)


def dense(df, *columns):
    out = np.full((len(columns), 2, 13, 10), np.nan)
    for r in df.collect():
        assert np.isnan(out[0, r.frame_idx, r.y, r.x])  # a cell has one row
        out[:, r.frame_idx, r.y, r.x] = [r[c] for c in columns]
    return out


@pytest.mark.parametrize("block", [1, 4, 64])
def test_transform_by_blocks(stack, block):
    pixels, a = stack
    re, im = dense(spectra.transform(pixels, 10, 13, block=block), "re", "im")
    assert np.allclose(re + 1j * im, np.fft.fft2(a, axes=(1, 2)))


def test_inverse_by_blocks_takes_a_transform_back(stack):
    pixels, a = stack
    re, im = dense(spectra.transform(spectra.transform(pixels, 10, 13, block=4), 10, 13, True, 3), "re", "im")
    assert np.allclose(re, a) and np.allclose(im, 0)


def test_filters_by_blocks_equal_those_of_whole_planes(stack, monkeypatch):
    pixels, _ = stack
    kernel = np.random.default_rng(5).random((5, 4))
    whole = [planes.fft_convolve(pixels, kernel, 10, 13), planes.deconvolve(pixels, kernel, 10, 13), planes.fft(pixels, 10, 13)]
    monkeypatch.setattr(spectra, "WHOLE", 100)
    parts = [planes.fft_convolve(pixels, kernel, 10, 13), planes.deconvolve(pixels, kernel, 10, 13), planes.fft(pixels, 10, 13)]
    for a, b in zip(whole, parts, strict=True):
        columns = ("v",) if "v" in a.columns else ("re", "im")
        assert np.allclose(dense(a, *columns), dense(b, *columns))


def test_no_pixels_give_no_rows(stack):
    assert spectra.transform(stack[0].where("false"), 10, 13).count() == 0


def records_shuffled(df):
    """Rows that each exchange of the plan wrote."""

    def walk(p):
        name = p.getClass().getSimpleName()
        below = [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else [p.children().apply(k) for k in range(p.children().size())]
        own = [p.metrics().apply("shuffleRecordsWritten").value()] if p.metrics().contains("shuffleRecordsWritten") else []
        return own + [n for b in below for n in walk(b)]

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_many_small_planes_are_few_groups(spark, monkeypatch):
    """A group of a lot holds the same block of many frames, also of those that lack other blocks."""
    a = np.random.default_rng(6).normal(size=(90, 8, 8))
    a[::7, 3:6] = 0  # every seventh frame lacks a block of rows
    rows = [(k, 0, y, x, float(a[k, y, x])) for k in range(90) for y in range(8) for x in range(8) if k % 7 or not 3 <= y < 6]
    pixels = spark.createDataFrame(rows, "frame_idx int, plane_idx int, y int, x int, v double")
    assert sorted(records_shuffled(spectra.transform(pixels, 8, 8, block=3))) == [9, len(rows)]  # pieces: three blocks of rows by three of columns
    monkeypatch.setattr(spectra, "CELLS", 480)  # lots of twenty frames
    assert sorted(records_shuffled(spectra.transform(pixels, 8, 8, block=3))) == [45, len(rows)]
    found = np.full((90, 8, 8), np.nan, complex)
    for r in spectra.transform(pixels, 8, 8, block=3).collect():
        found[r.frame_idx, r.y, r.x] = r.re + 1j * r.im
    assert np.allclose(found, np.fft.fft2(a, axes=(1, 2)))
    kernel = np.random.default_rng(5).random((3, 3))
    for r in spectra.filtered(pixels, kernel, 8, 8, (10, 10), np.multiply, (1, 1), block=3).collect():
        found[r.frame_idx, r.y, r.x] = r.v
    assert np.allclose(found, np.fft.ifft2(np.fft.fft2(a, (10, 10), axes=(1, 2)) * np.fft.fft2(kernel, (10, 10)), axes=(1, 2))[:, 1:9, 1:9])
