"""Dilation and star planes by tiles against plain loops; registration where a plain threshold fails."""

import numpy as np
import pytest
from rasterloom.operators import astrometry, morphology

SCHEMA = "frame_idx int, plane_idx int, y int, x int, v double"


def rows(a, frame=0):
    return [(frame, 0, int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(a) if not np.isnan(v)]


def dense(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        assert np.isnan(out[r.y, r.x])
        out[r.y, r.x] = r.v
    return out


def plain(a, reach, inside, pick):
    out = np.full(a.shape, np.nan)
    for y, x in np.ndindex(a.shape):
        cells = [a[i, j] for i in range(max(0, y - reach), min(len(a), y + reach + 1)) for j in range(max(0, x - reach), min(a.shape[1], x + reach + 1)) if inside(i - y, j - x) and not np.isnan(a[i, j])]
        if cells:
            out[y, x] = pick(cells)
    return out


@pytest.fixture(scope="module")
def plane():
    random = np.random.default_rng(8)
    a = random.integers(0, 256, (19, 23)).astype(float)
    a[random.random(a.shape) < 0.3] = np.nan
    a[:6, :6] = np.nan
    return a


@pytest.mark.parametrize("radius", [0, 1, 3])
@pytest.mark.parametrize("tile", [5, 256])
def test_dilation_and_erosion_match_plain_loops(spark, plane, radius, tile):
    pixels = spark.createDataFrame(rows(plane), SCHEMA)
    disk = lambda dy, dx: dy * dy + dx * dx <= radius * radius
    assert np.array_equal(dense(morphology.dilate(pixels, radius, 23, 19, tile=tile), plane.shape), plain(plane, radius, disk, max), equal_nan=True)
    assert np.array_equal(dense(morphology.erode(pixels, radius, 23, 19, tile=tile), plane.shape), plain(plane, radius, disk, min), equal_nan=True)
    twice = plain(plain(plane, radius, disk, max), radius, disk, max)
    assert np.array_equal(dense(morphology.dilate(pixels, radius, 23, 19, 2, tile), plane.shape), twice, equal_nan=True)


@pytest.mark.parametrize("tile", [7, 256])
def test_star_planes_match_plain_loops(spark, plane, tile):
    blurred = np.full(plane.shape, np.nan)
    for y, x in np.argwhere(~np.isnan(plane)):
        near = [((2 - abs(i - y)) * (2 - abs(j - x)), plane[i, j]) for i in range(max(0, y - 1), min(19, y + 2)) for j in range(max(0, x - 1), min(23, x + 2)) if not np.isnan(plane[i, j])]
        blurred[y, x] = np.round(sum(w * v for w, v in near) / sum(w for w, _ in near))
    background = plain(blurred, 4, lambda dy, dx: True, lambda cells: sorted(cells)[(len(cells) - 1) // 2])
    want = np.maximum(blurred - background, 0)
    pixels = spark.createDataFrame(rows(plane), SCHEMA)
    assert np.array_equal(dense(morphology.star_planes(pixels, 23, 19, reach=4, tile=tile), plane.shape), want, equal_nan=True)
    bright = np.where(want > 0.9 * np.nanmax(want), 1.0, np.nan)
    disk = lambda dy, dx: dy * dy + dx * dx <= 4
    hidden = ~np.isnan(plain(plain(bright, 2, disk, max), 2, disk, max))
    want[hidden & ~np.isnan(want)] = 0
    assert np.array_equal(dense(morphology.star_planes(pixels, 23, 19, 90.0, 4, 2, tile), plane.shape), want, equal_nan=True)


def test_empty_planes_give_no_rows(spark):
    pixels = spark.createDataFrame([(0, 0, 1, 1, None)], SCHEMA)
    assert morphology.dilate(pixels, 2, 4, 4).count() == morphology.star_planes(pixels, 4, 4, 95.0).count() == 0


def sky(dx, dy, gradient, blob):
    """Spots of 3 x 3 on a steep slope, moved by (dx, dy), and a saturated blob that does not move."""
    a = np.add.outer(np.arange(96.0), np.arange(128.0)) * gradient + np.random.default_rng(1).normal(size=(96, 128))
    for y, x in np.random.default_rng(2).integers(12, 84, (14, 2)):
        a[y + dy - 1 : y + dy + 2, x + dx - 1 : x + dx + 2] += 120
    if blob:
        a[60:74, 100:114] += 4000
    return a


@pytest.mark.parametrize("gradient, blob", [(3.0, False), (0.2, True)])
def test_registration_on_a_slope_and_beside_a_saturated_blob(spark, gradient, blob):
    frames = spark.createDataFrame([r for k, (dx, dy) in enumerate(((0, 0), (4, -3))) for r in rows(sky(dx, dy, gradient, blob), k)], SCHEMA).drop("plane_idx")
    table = astrometry.register_frames(frames, frames.where("frame_idx = 0").select("y", "x", "v"), 128, 96, quantile=0.6, most=30.0, radius=12.0, saturation=60.0 if blob else None, phase_most=0.0, template_reach=0)
    got = {r.frame_idx: r for r in table.collect()}
    assert abs(got[1].dx + 4) < 0.5 and abs(got[1].dy - 3) < 0.5 and got[1].confidence > 0
