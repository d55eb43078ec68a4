"""Consensus as joins: offsets with outliers, offsets that follow one another, plates and stars by triangles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import astrometry, consensus

POINTS = "frame_idx int, id long, x double, y double"


def field(rng, n, width=800, height=600):
    return [(k, rng.uniform(60, width - 60), rng.uniform(60, height - 60)) for k in range(n)]


def test_draws_are_below_n_and_samples_differ(spark):
    rows = spark.range(5).select(F.lit(0).alias("frame_idx"), "id").union(spark.range(2).select(F.lit(1), F.col("id")))
    s = consensus._samples(consensus._numbered(rows, "id"), 3, 200, 17).collect()
    by = {}
    for r in s:
        by.setdefault((r.frame_idx, r["round"]), set()).add(r.row)
    assert len(by) == 200 and all(len(v) == 3 and v <= set(range(5)) for v in by.values()) and len({tuple(sorted(v)) for v in by.values()}) == 10


def plain_shift(pairs, rounds, seed, tolerance=1.5):
    """The same draws, round by round."""
    d = [(xb - xa, yb - ya) for _, _, xa, ya, xb, yb in sorted(pairs)]
    n, best = len(d), []
    draw = lambda x, m: ((y := (x * 1103515245 + 12345) % 2147483648) * y % 2147483629) % m
    for r in range(rounds if n >= 3 else 0):
        gap, at, take = max(1, (n - 1) // 2), draw(r * 3 + seed, n), []
        for k in range(3):
            at = at if k == 0 else at + 1 + draw(r * 3 + seed + k, gap)
            take.append(d[at % n])
        mx, my = (sum(t[c] for t in take) / 3 for c in (0, 1))
        hit = [t for t in d if math.hypot(t[0] - mx, t[1] - my) < tolerance]
        if len(hit) > len(best):
            best = hit
            if len(best) * 2 > n or len(best) > 40:
                break
    return (len(best), *(np.mean([t[c] for t in best]) if best else 0.0 for c in (0, 1)))


def test_consensus_shift_matches_rounds_in_order(spark):
    rng, rows, want = random.Random(4), [], {}
    for f, (n, wrong) in enumerate([(30, 20), (12, 40), (60, 0), (4, 0), (2, 0), (0, 25)]):
        pairs = [(k, k, x, y, x + 5 + rng.gauss(0, 0.3), y - 3 + rng.gauss(0, 0.3)) for k, x, y in field(rng, n)]
        pairs += [(k, 1000 + k, x, y, x + rng.uniform(-40, 40), y + rng.uniform(-40, 40)) for k, x, y in field(rng, wrong)]
        want[f] = plain_shift(pairs, 100, 17)
        rows += [(f, *p) for p in pairs]
    got = consensus.consensus_shift(spark.createDataFrame(rows, "frame_idx int, id_a long, id_b long, xa double, ya double, xb double, yb double")).collect()
    assert len(got) == 6
    for r in got:
        assert r.inliers == want[r.frame_idx][0] and np.allclose((r.dx, r.dy), want[r.frame_idx][1:]) and r.success == (r.inliers >= 5)
    assert {r.frame_idx for r in got if r.success and abs(r.dx - 5) < 0.5 and abs(r.dy + 3) < 0.5} >= {0, 1, 2}


def test_a_drift_beyond_the_radius_is_followed(spark):
    rng = random.Random(8)
    stars = field(rng, 20)
    rows = [(f, k, x - 35.0 * f, y + 20.0 * f) for f in range(8) for k, x, y in stars if f != 4]  # frame 4 has nothing to match
    rows += [(4, k, x, y) for k, x, y in field(rng, 4)]
    frames = spark.range(8).select(F.col("id").cast("int").alias("frame_idx"), F.lit(None).cast("double").alias("seconds"))
    points, reference = spark.createDataFrame(rows, POINTS), spark.createDataFrame(stars, "id long, x double, y double")
    found = {p: {r.frame_idx: r for r in astrometry.detect_shifts(points, reference, frames, 90.0, 800, 600, previous=p).collect()} for p in (False, True)}
    assert all(np.allclose((r.dx, r.dy), (35 * f, -20 * f), atol=1e-6) for f, r in found[True].items() if f != 4)
    assert found[True][4].dx is None and found[True][4].confidence == 0
    # without it, only offsets below the radius
    assert [f for f, r in found[False].items() if r.dx is not None and abs(r.dx - 35 * f) < 1] == [0, 1, 2]


def test_previous_offsets_skip_what_was_not_accepted(spark):
    rows = [(0, 1.0, 1.0, 9), (1, 50.0, 0.0, 99), (1, 4.0, 1.0, 6), (3, 6.0, 2.0, 5), (3, 2.0, 1.0, 5), (4, 6.0, 9.0, 5)]
    frames = spark.range(6).select(F.col("id").cast("int").alias("frame_idx"))
    got = consensus.previous_offsets(spark.createDataFrame(rows, "frame_idx int, ox double, oy double, votes long"), frames, 10.0).collect()
    assert [(r.frame_idx, r.px, r.py) for r in sorted(got)] == [(0, 0, 0), (1, 1, 1), (2, 4, 1), (3, 4, 1), (4, 2, 1), (5, 6, 9)]


def test_shift_is_fitted_about_the_centre(spark):
    rng = random.Random(2)
    stars, t = field(rng, 30), math.radians(0.05)
    c, s = math.cos(t), math.sin(t)
    # the frame, turned about the centre by t and moved by (3, -2), is the reference
    back = [(0, k, c * (x - 403) + s * (y - 298) + 400, -s * (x - 403) + c * (y - 298) + 300) for k, x, y in stars]
    frames = spark.createDataFrame([(0, None)], "frame_idx int, seconds double")
    r = astrometry.detect_shifts(spark.createDataFrame(back, POINTS), spark.createDataFrame(stars, "id long, x double, y double"), frames, 50.0, 800, 600).first()
    assert np.allclose((r.dx, r.dy, r.rotation), (3, -2, 0.05), atol=1e-6)


def sky_to_plate(ra, dec, ra0, dec0, scale, turn, width, height):
    a, d, d0 = math.radians(ra - ra0), math.radians(dec), math.radians(dec0)
    c = math.sin(d0) * math.sin(d) + math.cos(d0) * math.cos(d) * math.cos(a)
    xi, eta = (math.degrees(v / c) for v in (math.cos(d) * math.sin(a), math.cos(d0) * math.sin(d) - math.sin(d0) * math.cos(d) * math.cos(a)))
    t = math.radians(turn)
    return c, (math.cos(t) * xi + math.sin(t) * eta) / scale + width / 2, (-math.sin(t) * xi + math.cos(t) * eta) / scale + height / 2


def test_plate_with_outliers_near_the_pole_and_the_meridian(spark):
    rng, rows, truth = random.Random(6), [], {0: (359.9, 20.0, 0.01, 30.0), 1: (120.0, 84.0, 0.02, 200.0), 2: (10.0, -40.0, 0.005, 0.0)}
    for f, (ra0, dec0, scale, turn) in truth.items():
        for k in range(30 if f < 2 else 2):
            dec = dec0 + rng.uniform(-2, 2)
            ra = (ra0 + rng.uniform(-2, 2) / math.cos(math.radians(dec))) % 360
            _, x, y = sky_to_plate(ra, dec, ra0, dec0, scale, turn, 1000, 800)
            if k % 5 == 4:
                x, y = rng.uniform(0, 1000), rng.uniform(0, 800)
            rows.append((f, k, x, y, ra, dec))
    got = {r.frame_idx: r for r in consensus.plate_consensus(spark.createDataFrame(rows, "frame_idx int, star long, x double, y double, ra double, dec double"), 1000, 800, threshold=1.5).collect()}
    for f in (0, 1):
        ra0, dec0, scale, turn = truth[f]
        r = got[f]
        assert abs((r.crval1 - ra0 + 180) % 360 - 180) < 0.05 and abs(r.crval2 - dec0) < 0.01 and abs((r.rotation - turn + 180) % 360 - 180) < (0.5 if f == 0 else 1.5) and abs(r.pixel_scale / scale - 1) < 2e-3
        assert r.inliers >= 15
    assert (got[2].rotation, got[2].pixel_scale, got[2].confidence) == (0.0, 0.0, 0.0) and abs(got[2].crval2 + 40) < 3


@pytest.fixture(scope="module")
def sky(spark):
    rng = random.Random(11)
    stars = [(k, rng.uniform(100, 130), math.degrees(math.asin(rng.uniform(math.sin(math.radians(10)), math.sin(math.radians(38))))), rng.uniform(2, 8)) for k in range(700)]
    catalog = spark.createDataFrame(stars, "id long, ra double, dec double, mag double")
    return stars, catalog, astrometry.catalog_triangles(catalog, 2.0, 8.0, 10, widest=16.0).persist()


def test_stars_are_identified_among_false_points(spark, sky):
    stars, catalog, known = sky
    rng, rows, truth, width, height, scale = random.Random(3), [], {}, 900, 700, 0.01
    for f, (ra0, dec0, turn) in enumerate([(115.0, 25.0, 40.0), (108.0, 20.0, 250.0)]):
        seen = []
        for k, ra, dec, mag in stars:
            c, x, y = sky_to_plate(ra, dec, ra0, dec0, scale, turn, width, height)
            if c > 0.9 and 5 < x < width - 5 and 5 < y < height - 5:
                seen.append((k, x, y, 100 - 10 * mag))
        truth |= {(f, n): k for n, (k, *_) in enumerate(seen)}
        rows += [(f, n, x, y, b) for n, (k, x, y, b) in enumerate(seen)]
        rows += [(f, 500 + n, rng.uniform(5, width - 5), rng.uniform(5, height - 5), 100 - 10 * rng.uniform(2, 8)) for n in range(round(len(seen) * 0.43))]  # 30 % of all
    rows += [(2, n, rng.uniform(5, 800), rng.uniform(5, 600), 50.0) for n in range(3)]  # too few
    points = spark.createDataFrame(rows, "frame_idx int, id long, x double, y double, brightness double")
    fov = math.hypot(width, height) * scale
    got = consensus.identify_frames(points, catalog, known, width, height, fov, error=0.005, rows=1, columns=1, stars=24, rounds=300).collect()
    assert {r.frame_idx for r in got} == {0, 1}
    for f in (0, 1):
        mine = [r for r in got if r.frame_idx == f]
        right = [r for r in mine if truth.get((f, r.star)) == r.id]
        assert len(mine) >= 10 and len(right) >= 0.9 * len(mine) and len({r.id for r in mine}) == len(mine)
    again = consensus.identify_frames(points.repartition(7), catalog, known, width, height, fov, error=0.005, rows=1, columns=1, stars=24, rounds=300).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
