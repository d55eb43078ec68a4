"""Groups of pixels by tiles against a flood fill of the whole plane."""

import numpy as np
import pytest

from rasterloom.operators import labels


def flood(mask, corners):
    label, steps = {}, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not (a and b))]
    for y, x in np.argwhere(mask).tolist():
        if (y, x) in label:
            continue
        todo, root = [(y, x)], (y << 32) + x
        while todo:
            p = todo.pop()
            if p not in label:
                label[p] = root
                todo += [(p[0] + a, p[1] + b) for a, b in steps if 0 <= p[0] + a < mask.shape[0] and 0 <= p[1] + b < mask.shape[1] and mask[p[0] + a, p[1] + b]]
    return label


def spiral(n):
    """A path one cell wide that winds through the whole plane."""
    mask = np.zeros((n, n), bool)
    y, x, dy, dx = 0, 0, 0, 1
    mask[0, 0] = True
    while True:
        ahead = lambda k: (y + k * dy, x + k * dx)
        free = lambda p: not (0 <= p[0] < n and 0 <= p[1] < n) or not mask[p]
        inside = lambda p: 0 <= p[0] < n and 0 <= p[1] < n
        if not inside(ahead(1)) or not free(ahead(2)) or not free(ahead(1)):
            dy, dx = dx, -dy
            if not inside(ahead(1)) or not free(ahead(2)) or not free(ahead(1)):
                return mask
        y, x = ahead(1)
        mask[y, x] = True


@pytest.mark.parametrize("corners", [True, False])
def test_tiles_and_seams_match_a_flood_fill(spark, corners):
    rng = np.random.default_rng(7)
    masks = {(0, 0): rng.random((23, 31)) < 0.42, (0, 1): spiral(21), (1, 0): np.eye(18, dtype=bool)}
    rows = [(f, p, int(y), int(x), 1.0) for (f, p), m in masks.items() for y, x in np.argwhere(m)]
    got = labels.labelled(spark.createDataFrame(rows, "frame_idx int, plane_idx int, y int, x int, v double"), corners, tile=5).collect()
    for (f, p), m in masks.items():
        assert {(r.y, r.x): r.label for r in got if (r.frame_idx, r.plane_idx) == (f, p)} == flood(m, corners)


def test_points_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(3)
    y, x = np.indices((60, 50))
    v = rng.random((60, 50)) + sum(60 * np.exp(-((y - a) ** 2 + (x - b) ** 2) / 4) for a, b in ((8, 8), (15.6, 16.2), (40, 31), (31.5, 8), (50, 44)))
    rows = [(0, 1, int(a), int(b), float(v[a, b])) for a in range(60) for b in range(50) if (a, b) != (3, 3)] + [(0, 1, 3, 3, None)]
    df = spark.createDataFrame(rows, "frame_idx int, plane_idx int, y int, x int, v double")
    one, many = (sorted(map(tuple, labels.points(df, 0.97, tile=t).collect())) for t in (256, 8))
    assert len(one) == 5 and np.allclose(one, many)
    ok = np.delete(v.ravel(), 3 * 50 + 3)
    mask = v > np.quantile(ok, 0.97)
    roots = flood(mask, True)
    for _, _, _, px, py, brightness, centre, area, ratio in one:
        root = roots[(int(round(py)), int(round(px)))]
        cells = [c for c, r in roots.items() if r == root]
        w = np.array([v[c] for c in cells])
        assert area == len(cells) and np.isclose(brightness, w.sum()) and centre == v[int(round(py)), int(round(px))] and ratio < 2
        assert np.allclose((py, px), (w[:, None] * np.array(cells)).sum(axis=0) / w.sum())
