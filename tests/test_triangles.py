"""Four stars by two triangles with a common side: against plain loops, and how many rows its joins make."""

import random

import pytest

from rasterloom.operators import consensus

KNOWN = "i0 long, i1 long, i2 long, r0 double, r1 double, r2 double"


def shape(rng, turn):
    """Sides of a triangle over its longest, which comes at `turn`."""
    a = rng.uniform(0.3, 1)
    sides = [1.0, a, rng.uniform(1.02 - a, 1)]
    return sides[turn:] + sides[:turn]


def alike(w, r, error):
    return sum((a - b) ** 2 for a, b in zip(w, r, strict=True)) <= error * error * sum(a * a for a in w)


def join_rows(df):
    """Rows that each join of the plan made."""

    def walk(p):
        name = p.getClass().getSimpleName()
        below = [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else [p.children().apply(k) for k in range(p.children().size())]
        own = [p.metrics().apply("numOutputRows").value()] if "Join" in name and p.metrics().contains("numOutputRows") else []
        return own + [n for b in below for n in walk(b)]

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("error", [0.02, 0.15])
def test_pairs_of_triangles_match_plain_loops(spark, error):
    rng = random.Random(9)
    known = [(e, 100 + e, 200 + k, *shape(rng, rng.randrange(3))) for e in range(12) for k in range(rng.randrange(1, 7))]
    known += [(*t[:3], t[3], t[4] * 0.9999, t[5] * 0.9998) for t in known[::9]]  # the same stars from another centre
    seeds = [(n, shape(rng, rng.randrange(3)), shape(rng, rng.randrange(3))) for n in range(60)]
    for n, (c, g) in enumerate([(c, g) for c in known for g in known if c[:2] == g[:2] and c[2] != g[2]][::3]):
        near = lambda t: [x * (1 + rng.uniform(-0.6, 0.6) * error) for x in t[3:]]
        over = lambda s: [x / max(s) for x in s]
        seeds.append((100 + n, over(near(c)), over(near(g))))
    want = {(n, *c[:3], g[2]) for n, p, q in seeds for c in known if alike(p, c[3:], error) for g in known if c[:2] == g[:2] and c[2] != g[2] and alike(q, g[3:], error)}
    got = consensus.intersect_triangles(spark.createDataFrame(seeds, "seed int, p array<double>, q array<double>"), spark.createDataFrame(known, KNOWN), error).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want and len(want) > 50


def test_triangles_that_agree_alone_are_no_rows(spark):
    """One shape in all first triangles: only the second ones tell the pairs apart."""
    rng = random.Random(5)
    first, second = (1.0, 0.7, 0.8), [(1.0, 0.35 + 0.05 * (k % 8), 0.66 + 0.04 * (k // 8)) for k in range(64)]
    known = [t for e in range(64) for t in ((e, 100 + e, 200, *first), (e, 100 + e, 201, *second[e]))]
    rng.shuffle(known)
    seeds = [(e, list(first), list(second[e])) for e in range(64)]
    df = consensus.intersect_triangles(spark.createDataFrame(seeds, "seed int, p array<double>, q array<double>"), spark.createDataFrame(known, KNOWN), 0.01, unique=True)
    made = join_rows(df)
    assert len(made) >= 2 and max(made) <= 4 * 64
    assert sorted(map(tuple, df.collect())) == [(e, e, 100 + e, 200, 201) for e in range(64)]


def test_turns_of_repeated_triangles_come_once(spark):
    rows = [(1, 2, 3, 0.5, 0.75), (1, 2, 3, 0.5, 0.75), (4, 5, 6, 1.0, 0.5), (6, 4, 5, 0.5, 1.0), (7, 9, 8, 1.0, 1.0), (9, 8, 7, 1.0, 1.0)]
    t = spark.createDataFrame(rows, "id0 long, id1 long, id2 long, k0 double, k1 double")
    got = sorted(map(tuple, consensus.turned_once(t).collect()))
    assert got == sorted(map(tuple, consensus.turned(t).distinct().collect())) and len(got) == len(set(got))
