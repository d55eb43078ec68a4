"""Order statistics by refinement, and histograms with trimmed ends."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import colour, fit, ranks


def values(spark, groups):
    return spark.createDataFrame([(f, 0, float(v) if v is not None else None) for f, vs in groups.items() for v in vs], "frame_idx int, plane_idx int, v double")


@pytest.mark.parametrize("gathered", [4, 100_000])
def test_quantiles_are_exact(spark, gathered):
    rng = np.random.default_rng(5)
    groups = {0: rng.normal(size=500), 1: np.exp(rng.normal(size=400) * 12), 2: rng.integers(0, 4, 300), 3: [7.5], 4: [2.0] * 50, 5: [1e-300] * 3 + [1e-299] * 40 + [1e300], 6: [None, 3.0, 1.0, None], 7: [None]}
    qs = (0.0, 0.01, 0.5, 0.937, 1.0)
    got = {r.frame_idx: r.p for r in ranks.quantiles(values(spark, groups), ("frame_idx",), qs, buckets=16, gathered=gathered).collect()}
    assert got.keys() == set(groups) - {7}
    for f in got:
        assert np.allclose(got[f], np.quantile([v for v in groups[f] if v is not None], qs), rtol=1e-12), f


def test_levels_of_large_and_invalid_frames(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.gamma(2.0, size=3000)
    df = values(spark, {0: v, 1: [None, None]})
    monkeypatch.setattr(ranks.quantiles, "__defaults__", (64, 50))
    got = {r.frame_idx: (r.low, r.high) for r in colour.auto_levels(df).collect()}
    assert np.allclose(got[0], np.quantile(v, (0.01, 0.99))) and got[1] == (0.0, 1.0)
    level = fit.display(df.withColumns({"y": F.lit(0), "x": F.lit(0)})).groupBy("frame_idx").agg(F.min("level").alias("a"), F.max("level").alias("b"), F.count("*").alias("n")).collect()
    assert sorted(map(tuple, level)) == [(0, 0, 255, 3000), (1, 0, 0, 2)]


def plain_histogram(v, bins):
    """Trimmed as long as it changes, by sorted values."""
    v = np.sort(v)
    low, high = lo, hi = v[0], v[-1]
    even = log = np.array([lo, hi])
    while lo < hi:
        even = np.linspace(lo, hi, bins + 1)
        log = lo + (10 ** (np.arange(bins + 1) / bins - 1) - 0.1) * (hi - lo) / 0.9
        log[0], log[-1] = lo, hi
        a, b = lo, hi
        full = np.flatnonzero(np.diff(np.searchsorted(v, log)) > 1)
        if len(full) and full[0]:
            a = log[full[0]]
        full = np.flatnonzero(np.diff(np.searchsorted(v, even)) > 1)
        if len(full) and full[-1] < bins - 1:
            b = even[full[-1] + 1]
        if (a, b) == (lo, hi):
            break
        lo, hi = a, b
    edges = np.unique(np.concatenate([[low, high], even, log])) if lo < hi else np.array([low, hi])
    counts, _ = np.histogram(v, edges) if lo < hi else (np.array([len(v)]), None)
    return [(a, b, n) for a, b, n in zip(edges[:-1], edges[1:], counts, strict=True) if n]


def test_trimmed_histogram_matches_sorted_values(spark):
    rng = np.random.default_rng(9)
    groups = {0: rng.normal(size=700), 1: np.concatenate([rng.normal(size=500), [900.0, -4000.0, 1e5]]), 2: rng.integers(0, 256, 600), 3: [5.0] * 20, 4: rng.normal(size=3)}
    got = {}
    for r in ranks.trimmed_histogram(values(spark, groups), 64).collect():
        got.setdefault(r.frame_idx, []).append((r.low, r.high, r.n))
    for f, vs in groups.items():
        want = plain_histogram(np.array(vs, float), 64)
        mine = sorted(got[f])
        assert len(mine) == len(want) and np.allclose(mine, want), f
    assert sum(n for _, _, n in got[1]) == 503 and max(h for _, h, _ in got[1]) == 1e5


def test_zoom_leaves_a_margin(spark):
    df = values(spark, {0: range(1000)})
    r = fit.percentile_zoom(df).first()
    a, b = 0.5 * 999 / 256, 255.5 * 999 / 256
    assert np.allclose((r.zoom_min, r.zoom_end), (a - (b - a) / 10, b + (b - a) / 10))
