"""Consensus on models as joins: minimal samples by row number, inliers counted by (frame, sample), the best kept.

No frame is ever handed to a function whole. Samples are drawn by arithmetic on their numbers, so that results neither
depend on partitions nor on the engine.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import gnomonic, gnomonic_inverse
from .points import similarity_fit, topk_grid

#: Inliers that make an offset, and as many that end the search, beside half of all pairs.
FEWEST, ENOUGH = 5, 40
#: The ways to lay two triangles with a common first side through four points: that side, then either third vertex.
SIDES = tuple(itertools.permutations(range(4)))


def draw(x: Column, n: Column) -> Column:
    """A number from 0 to n - 1 that is fixed for x: a linear step, squared modulo a prime."""
    y = (x.cast("long") * 1103515245 + 12345) % 2147483648
    return y * y % 2147483629 % n


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    w = Window.partitionBy("frame_idx")
    return rows.withColumn("row", F.row_number().over(w.orderBy(*order)) - 1).withColumn("rows", F.count("*").over(w))


def _samples(numbered: DataFrame, size: int, rounds: int, seed: int) -> DataFrame:
    """(frame_idx, round, k, row): `size` different rows for each round of each frame that has as many."""
    first = F.expr(f"round * {size} + {seed}")
    gap = F.greatest(F.lit(1), F.floor((F.col("rows") - 1) / max(1, size - 1))).cast("long")
    at, picks = draw(first, F.col("rows")), []
    for k in range(size):
        at = at if k == 0 else at + 1 + draw(first + k, gap)
        picks.append(F.struct(F.lit(k).alias("k"), (at % F.col("rows")).alias("row")))
    frames = numbered.where(F.col("rows") >= size).groupBy("frame_idx").agg(F.max("rows").alias("rows"))
    every = frames.select("frame_idx", "rows", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    return every.select("frame_idx", "round", F.explode(F.array(*picks)).alias("p")).select("frame_idx", "round", "p.k", "p.row")


def _tested(rows: DataFrame, models: DataFrame, fields: tuple[str, ...], inlier: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """The inliers of each model, (frame_idx, round, *keep); a frame's models, as many as rounds, travel as one array."""
    lists = models.groupBy("frame_idx").agg(F.collect_list(F.struct("round", *fields)).alias("models"))
    return rows.join(lists, "frame_idx").select("frame_idx", *rows.drop("frame_idx").columns, F.explode("models").alias("m")).select("frame_idx", *rows.drop("frame_idx").columns, "m.*").where(inlier).select("frame_idx", "round", *keep)


def consensus_shift(pairs: DataFrame, rounds: int = 100, tolerance: float = 1.5, seed: int = 17) -> DataFrame:
    """(frame_idx, dx, dy, inliers, confidence, success) of candidate pairs (xa, ya, xb, yb) of each frame.

    A round's model is the mean offset of three pairs. The first round on which more than half of the pairs or 40 agree
    wins, else the one with most inliers, the earliest of equals; the offset is the mean of its inliers. Five are needed.
    Frames with fewer than three pairs have no offset.
    """
    d = _numbered(pairs.select("frame_idx", "id_a", "id_b", (F.col("xb") - F.col("xa")).alias("ox"), (F.col("yb") - F.col("ya")).alias("oy")), "id_a", "id_b")
    d = _settled(d.select("frame_idx", "row", "rows", "ox", "oy"))  # several steps read the pairs, which are made once
    models = _samples(d, 3, rounds, seed).join(d.select("frame_idx", "row", "ox", "oy"), ["frame_idx", "row"]).groupBy("frame_idx", "round").agg(F.avg("ox").alias("mx"), F.avg("oy").alias("my"))
    near = lambda x, y: (F.col("ox") - F.col(x)) * (F.col("ox") - F.col(x)) + (F.col("oy") - F.col(y)) * (F.col("oy") - F.col(y)) < tolerance * tolerance
    hits = _tested(d.select("frame_idx", "ox", "oy", "rows"), models, ("mx", "my"), near("mx", "my"), ("rows", "ox", "oy"))
    counts = hits.groupBy("frame_idx", "round").agg(F.count("*").alias("inliers"), F.max("rows").alias("rows"), F.avg("ox").alias("dx"), F.avg("oy").alias("dy"))
    early = (F.col("inliers") * 2 > F.col("rows")) | (F.col("inliers") > ENOUGH)
    order = F.struct(~early, F.when(early, F.lit(0)).otherwise(-F.col("inliers")), "round")
    best = counts.groupBy("frame_idx").agg(F.min_by(F.struct("dx", "dy", "inliers"), order).alias("b")).select("frame_idx", "b.*")
    out = d.select("frame_idx").distinct().join(best, "frame_idx", "left")
    n = F.coalesce("inliers", F.lit(0)).cast("int")
    return out.select("frame_idx", F.coalesce("dx", F.lit(0.0)).alias("dx"), F.coalesce("dy", F.lit(0.0)).alias("dy"), n.alias("inliers"), F.least(F.lit(1.0), n / 20).alias("confidence"), (n >= FEWEST).alias("success"))


# --- offsets that follow one another -----------------------------------------------------------------------------


def candidate_offsets(pairs: DataFrame, tolerance: float = 1.5, fewest: int = FEWEST) -> DataFrame:
    """(frame_idx, ox, oy, votes) of the offsets on which `fewest` pairs or more agree: cells of twice the tolerance, in four
    grids that lie half a cell apart, so that pairs about any offset share a cell in one of them."""
    side = 2 * tolerance
    grids = F.explode(F.array(*[F.struct(F.lit(a).alias("ga"), F.lit(b).alias("gb")) for a in (0.0, 0.5) for b in (0.0, 0.5)])).alias("g")
    d = pairs.select("frame_idx", (F.col("xb") - F.col("xa")).alias("ox"), (F.col("yb") - F.col("ya")).alias("oy"), grids).select("*", "g.*")
    cells = d.groupBy("frame_idx", "ga", "gb", F.floor(F.col("ox") / side + F.col("ga")).alias("cx"), F.floor(F.col("oy") / side + F.col("gb")).alias("cy"))
    return cells.agg(F.avg("ox").alias("ox"), F.avg("oy").alias("oy"), F.count("*").alias("votes")).where(F.col("votes") >= fewest).select("frame_idx", "ox", "oy", "votes")


def previous_offsets(candidates: DataFrame, frames: DataFrame, radius: float) -> DataFrame:
    """(frame_idx, px, py) for every frame: the offset that was accepted for the last frame before it.

    An ordered fold: a frame accepts, of its candidates within `radius` of the last accepted offset, the one with most
    votes (ties: the nearer, then by ox and oy); a frame without any leaves the offset as it was. It begins at 0. The
    fold holds one offset and streams over a few rows a frame in the frames' order.
    """

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, best, px, py = None, None, 0.0, 0.0
        for pdf in parts:
            out = []
            for frame, ox, oy, votes in pdf.itertuples(index=False):
                if frame != now:
                    px, py = best[1] if best else (px, py)
                    now, best = frame, None
                    out.append((frame, px, py))
                far = math.hypot(ox - px, oy - py)
                if far < radius and (best is None or (-votes, far, ox, oy) < best[0]):
                    best = ((-votes, far, ox, oy), (ox, oy))
            yield pd.DataFrame(out, columns=["frame_idx", "px", "py"])

    rows = frames.select("frame_idx").distinct().join(candidates, "frame_idx", "left").select(F.col("frame_idx").cast("int").alias("frame_idx"), "ox", "oy", "votes")
    return rows.repartition(1).sortWithinPartitions("frame_idx").mapInPandas(fold, "frame_idx int, px double, py double")


def pairs_about(pairs: DataFrame, previous: DataFrame, radius: float) -> DataFrame:
    """The pairs whose offset lies within the radius of the one before."""
    x, y = F.col("xb") - F.col("xa") - F.col("px"), F.col("yb") - F.col("ya") - F.col("py")
    return pairs.join(previous, "frame_idx").where(x * x + y * y < radius * radius).drop("px", "py")


# --- the plate ---------------------------------------------------------------------------------------------------


def mean_directions(stars: DataFrame) -> DataFrame:
    """(frame_idx, ra0, dec0): the mean of the stars' directions as vectors, so that neither pole nor meridian matters."""
    r, d = F.radians("ra"), F.radians("dec")
    sums = stars.groupBy("frame_idx").agg(F.avg(F.cos(r) * F.cos(d)).alias("cx"), F.avg(F.sin(r) * F.cos(d)).alias("cy"), F.avg(F.sin(d)).alias("cz"))
    return sums.select("frame_idx", F.pmod(F.degrees(F.atan2("cy", "cx")), F.lit(360.0)).alias("ra0"), F.degrees(F.atan2(F.col("cz"), F.hypot("cx", "cy"))).alias("dec0"))


def plate_consensus(stars: DataFrame, width: float, height: float, threshold: float = 3.0, rounds: int = 100, seed: int = 42) -> DataFrame:
    """(frame_idx, crval1, crval2, rotation, pixel_scale, confidence, inliers) of identified stars (frame_idx, star, x, y, ra,
    dec) of a frame, some of which may be wrong.

    The sky is projected about the stars' mean direction; a round's model is the similarity through two stars; stars within
    `threshold` pixels of where it puts them are its inliers, and the most inliers win (the earliest of equals). The
    similarity is fitted to them in least squares. crval: the sky at the frame's centre; rotation from 0 to 360 degrees;
    pixel_scale in degrees; north is that of the mean direction. Without three inliers rotation, scale and confidence are 0.
    """
    known = stars.select("frame_idx", "star", "x", "y", "ra", "dec").where("star is not null and ra is not null and dec is not null")
    centre = mean_directions(known)
    xi, eta, c = gnomonic(F.col("ra"), F.col("dec"), F.col("ra0"), F.col("dec0"))
    placed = known.join(centre, "frame_idx").withColumn("c", c).where("c > 0").select("frame_idx", "star", (F.col("x") - width / 2).alias("u"), (F.col("y") - height / 2).alias("v"), xi.alias("xi"), eta.alias("eta"))
    rows = _numbered(placed, "star", "u", "v")
    two = _samples(rows, 2, rounds, seed).join(rows, ["frame_idx", "row"])
    at = lambda k: F.max(F.when(F.col("k") == k, F.struct("u", "v", "xi", "eta"))).alias(f"p{k}")
    m = two.groupBy("frame_idx", "round").agg(at(0), at(1)).selectExpr("*", "p1.u - p0.u as du", "p1.v - p0.v as dv", "p1.xi - p0.xi as dx", "p1.eta - p0.eta as dy").where("du * du + dv * dv > 1e-10 and dx * dx + dy * dy > 1e-12")
    m = m.selectExpr("*", "(du * dx + dv * dy) / (du * du + dv * dv) as a", "(du * dy - dv * dx) / (du * du + dv * dv) as b")
    m = m.selectExpr("frame_idx", "round", "a", "b", "(p0.xi + p1.xi - a * (p0.u + p1.u) + b * (p0.v + p1.v)) / 2 as tx", "(p0.eta + p1.eta - b * (p0.u + p1.u) - a * (p0.v + p1.v)) / 2 as ty")
    inlier = F.expr(f"power(xi - (a * u - b * v + tx), 2) + power(eta - (b * u + a * v + ty), 2) <= {threshold * threshold} * (a * a + b * b)")
    hits = _tested(rows.select("frame_idx", "star", "u", "v", "xi", "eta"), m, ("a", "b", "tx", "ty"), inlier, ("u", "v", "xi", "eta"))
    counts = hits.groupBy("frame_idx", "round").agg(F.count("*").alias("inliers"))
    best = counts.groupBy("frame_idx").agg(F.min_by("round", F.struct(-F.col("inliers"), "round")).alias("round"), F.max("inliers").alias("inliers")).where("inliers >= 3")
    fit = similarity_fit(hits.join(best.select("frame_idx", "round"), ["frame_idx", "round"]).selectExpr("frame_idx", "u as xa", "v as ya", "xi as xb", "eta as yb"))
    ra, dec = gnomonic_inverse(F.col("dx"), F.col("dy"), F.col("ra0"), F.col("dec0"))
    out = stars.select("frame_idx").distinct().join(centre, "frame_idx", "left").join(fit, "frame_idx", "left")
    some, zero = F.col("a").isNotNull(), F.lit(0.0)
    return out.select(
        "frame_idx", F.coalesce(F.when(some, ra), "ra0", zero).alias("crval1"), F.coalesce(F.when(some, dec), "dec0", zero).alias("crval2"), F.coalesce(F.pmod(F.degrees(F.atan2("b", "a")), F.lit(360.0)), zero).alias("rotation"),
        F.coalesce(F.hypot("a", "b"), zero).alias("pixel_scale"), F.when(some, F.least(F.lit(1.0), F.col("n") / 20)).otherwise(zero).alias("confidence"), F.coalesce("n", F.lit(0)).cast("long").alias("inliers"),
    )


# --- stars by triangles ------------------------------------------------------------------------------------------


def turned(triangles: DataFrame) -> DataFrame:
    """(i0, i1, i2, r0, r1, r2): each triangle (id0, id1, id2, k0, k1) from each of its vertices on, with its three sides
    i0-i1, i1-i2 and i2-i0 over the longest."""
    t = lambda a, b, c, x, y, z: F.struct(F.col(a).alias("i0"), F.col(b).alias("i1"), F.col(c).alias("i2"), x.alias("r0"), y.alias("r1"), z.alias("r2"))
    k0, k1, one = F.col("k0"), F.col("k1"), F.lit(1.0)
    return triangles.select(F.explode(F.array(t("id0", "id1", "id2", k0, k1, one), t("id1", "id2", "id0", k1, one, k0), t("id2", "id0", "id1", one, k0, k1))).alias("t")).select("t.*")


def _alike(error: float, w: str = "w", r: str = "r") -> str:
    """SQL: whether sides w0, w1, w2 and r0, r1, r2 differ by at most `error` of the former's length."""
    return "{0} <= {1} * {2}".format(" + ".join(f"({w}{k} - {r}{k}) * ({w}{k} - {r}{k})" for k in range(3)), error * error, "(" + " + ".join(f"{w}{k} * {w}{k}" for k in range(3)) + ")")


def turned_once(triangles: DataFrame) -> DataFrame:
    """turned() without repeats: triangles that come from several centres meet in one of their turns, a third of the rows."""
    first = turned(triangles).where("i0 < i1 and i0 < i2").distinct()
    t = lambda a, b, c: F.struct(*[F.col(f"{x}{k}").alias(f"{x}{n}") for x in "ir" for n, k in enumerate((a, b, c))])
    return first.select(F.explode(F.array(t(0, 1, 2), t(1, 2, 0), t(2, 0, 1))).alias("t")).select("t.*")


def _grid(error: float) -> tuple[float, int]:
    """The side of the cells in which sides of triangles are looked up, twice what they may differ, and how many cover 0 to 1."""
    width = 2 * error * math.sqrt(3) * 1.0001
    return width, int(1 / width) + 1


def _cell(sides: list[Column], error: float) -> Column:
    width, count = _grid(error)
    a, b, c = [F.floor(x / width).cast("long") for x in sides]
    return (a * count + b) * count + c


def _cells(sides: Column, error: float) -> Column:
    """The cells of all triangles that are _alike() one with these sides (over its longest): two or one along each side."""
    width, count = _grid(error)
    reach = F.sqrt(sides[0] * sides[0] + sides[1] * sides[1] + sides[2] * sides[2]) * (error * 1.0001)
    near = lambda x: F.sequence(F.floor(F.greatest(F.lit(0.0), x - reach) / width).cast("long"), F.floor(F.least(F.lit(1.0), x + reach) / width).cast("long"))
    join = lambda cells, x: F.flatten(F.transform(cells, lambda c: F.transform(near(x), lambda d: c * count + d)))
    return join(join(near(sides[0]), sides[1]), sides[2])


def intersect_triangles(seeds: DataFrame, known: DataFrame, error: float, keys: tuple[str, ...] = ("seed",), unique: bool = False) -> DataFrame:
    """(*keys, i0, i1, i2, i3): four stars for each seed of two triangles with a common first side.

    seeds: (*keys, p, q), the sides of the first and the second triangle as arrays of three over their longest. known: of
    turned(). Known triangles with a common first side are paired first and both are looked up at once, by the cells of
    their sides, so that only what is close in both is ever compared and single triangles that agree are no rows. A
    pair is kept in one order, that of its cells; seeds come in the order of theirs. `unique`: no three stars in their
    order have two different triangles in known, and no seed comes twice, so that no result can repeat.
    """
    sides = lambda x: [F.col(f"{x}{k}") for k in range(3)]
    a = known.select("i0", "i1", "i2", *[F.col(f"r{k}").alias(f"a{k}") for k in range(3)])
    b = known.select("i0", "i1", F.col("i2").alias("i3"), *[F.col(f"r{k}").alias(f"b{k}") for k in range(3)])
    pairs = a.join(b.hint("merge"), ["i0", "i1"]).where("i2 != i3").withColumns({"ca": _cell(sides("a"), error), "cb": _cell(sides("b"), error)}).where("ca < cb or ca = cb and i2 < i3")
    wanted = seeds.select(*keys, "p", "q", F.explode(_cells(F.col("p"), error)).alias("cp")).select(*keys, "p", "q", "cp", F.explode(_cells(F.col("q"), error)).alias("cq"))
    order = lambda x, y, back: F.struct(F.col(f"c{x}").alias("ca"), F.col(f"c{y}").alias("cb"), F.lit(back).alias("back"), *[F.col(s)[k].alias(f"{t}{k}") for s, t in ((x, "p"), (y, "q")) for k in range(3)])
    wanted = wanted.select(*keys, F.explode(F.filter(F.array(order("p", "q", False), order("q", "p", True)), lambda x: x["ca"] <= x["cb"])).alias("w")).select(*keys, "w.*")
    found = pairs.join(wanted.hint("merge"), ["ca", "cb"]).where(f"{_alike(error, 'p', 'a')} and {_alike(error, 'q', 'b')}")
    found = found.select(*keys, "i0", "i1", F.expr("if(back, i3, i2)").alias("i2"), F.expr("if(back, i2, i3)").alias("i3"))
    return found if unique else found.distinct()


_TURN = "(({b}.x - {a}.x) * ({c}.y - {a}.y) - ({b}.y - {a}.y) * ({c}.x - {a}.x))"
_ANGLE = "degrees(acos(greatest(-1, least(1, {a}.u * {b}.u + {a}.v * {b}.v + {a}.w * {b}.w))))"


def _sides(a: str, b: str, c: str) -> str:
    return "array(" + ", ".join(_ANGLE.format(a=x, b=y) for x, y in ((a, b), (b, c), (c, a))) + ")"


def directions(points: DataFrame, width: float, height: float, fov: float | None) -> DataFrame:
    """Points with u, v, w: unit vectors from a lens of this diagonal field of view (degrees)."""
    focal = math.hypot(width, height) / (2 * math.tan(math.radians(fov) / 2))
    x, y = F.col("x") - width / 2, F.col("y") - height / 2
    n = F.sqrt(x * x + y * y + focal * focal)
    return points.withColumns({"u": x / n, "v": y / n, "w": F.lit(focal) / n})


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The frame with a column that is worked out once a row: filters on it are not pushed below it, where they would repeat it."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def seeds_of(frames: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(frame_idx, round, stars, four, p, q): two clockwise triangles with a common side through four stars of a frame, for
    each round in which there are any of fair shape. frames: (frame_idx, stars), an array of structs a frame."""
    n = F.size("stars").cast("long")
    gap = F.greatest(F.lit(1), F.floor((n - 1) / 3)).cast("long")
    s = frames.where(F.size("stars") >= 4).select("frame_idx", "stars", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    at, picks = draw(F.expr(f"round * 5 + {seed}"), n), []
    for k in range(4):
        at = at if k == 0 else at + 1 + draw(F.expr(f"round * 5 + {seed + k}"), gap)
        picks.append(F.element_at("stars", (at % n + 1).cast("int")))
    ways = "array(" + ", ".join(f"array(f[{a}], f[{b}], f[{c}], f[{d}])" for a, b, c, d in SIDES) + ")"
    clockwise = f"filter({ways}, t -> {_TURN.format(a='t[0]', b='t[1]', c='t[2]')} < 0 and {_TURN.format(a='t[0]', b='t[1]', c='t[3]')} < 0)"
    s = _held(s, "f", F.array(*picks))
    s = _held(s, "ways", F.expr(clockwise)).where("size(ways) > 0")
    s = _held(s, "four", F.element_at("ways", (draw(F.expr(f"round * 5 + {seed + 4}"), F.size("ways").cast("long")) + 1).cast("int")))
    s = _held(s, "p", F.expr(_sides("four[0]", "four[1]", "four[2]")))
    s = _held(s, "q", F.expr(_sides("four[0]", "four[1]", "four[3]")))
    fair = "array_min({0}) >= 1e-7 and array_min({0}) >= 0.2 * array_max({0})"
    s = s.where(f"{fair.format('p')} and {fair.format('q')} and {_ANGLE.format(a='four[2]', b='four[3]')} >= 0.2 * array_max(q)")
    over = "transform({0}, x -> x / array_max({0}))"
    return s.select("frame_idx", "round", "stars", "four", F.expr(over.format("p")).alias("p"), F.expr(over.format("q")).alias("q"))


def _settled(df: DataFrame) -> DataFrame:
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def identify_frames(points: DataFrame, catalog: DataFrame, known: DataFrame, width: float, height: float, fov: float, *, error: float = 0.01, rows: int = 3, columns: int = 3, stars: int = 8, rounds: int = 100, growth: int = 6, seed: int = 42) -> DataFrame:
    """(frame_idx, star, id, x, y, brightness, ra, dec, mag, matched) of image points that are stars of the catalogue.

    points: (frame_idx, id, x, y, brightness), at most `stars` of each grid cell take part. known: triangles of
    catalog_triangles(). A hypothesis is a seed of two triangles with a common side that the catalogue has with the same
    two stars; then every other point is tested, round after round, by the triangles that it makes with two of its three
    nearest matched ones, both of them fixed. The hypothesis that takes in most points wins, the closer of equals. All
    frames and hypotheses advance together, as joins; a frame's points (a bounded number) travel as one array. Frames with
    fewer than four points or without a hypothesis give no rows. The image is taken as not mirrored.
    """
    some = directions(topk_grid(points, "brightness", width, height, rows, columns, stars), width, height, fov)
    frames = some.groupBy("frame_idx").agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("star"), "x", "y", "u", "v", "w"))).alias("stars"))
    index = _settled(turned(known).distinct())
    seeds = _settled(seeds_of(frames, rounds, seed))
    wanted = seeds.select(F.explode(F.concat(_cells(F.col("p"), error), _cells(F.col("q"), error))).alias("cell")).distinct()
    near = index.withColumn("cell", _cell([F.col(f"r{k}") for k in range(3)], error)).join(wanted, "cell", "left_semi").drop("cell")  # few seeds ask for few triangles
    found = intersect_triangles(seeds.select("frame_idx", "round", "p", "q"), near, error, ("frame_idx", "round"))
    pair = "named_struct('s', four[{0}], 'id', i{0})"
    h = found.join(seeds, ["frame_idx", "round"]).select(F.xxhash64("frame_idx", "round", "i0", "i1", "i2", "i3").alias("h"), "frame_idx", "stars", F.expr("array(" + ", ".join(pair.format(k) for k in range(4)) + ")").alias("matched"), F.lit(0.0).alias("off"))
    h = _settled(h)
    for _ in range(growth):
        # a point of its own with its three nearest matched ones, two at a time and clockwise
        o = h.select("h", "matched", F.inline(F.expr("filter(stars, x -> not exists(matched, m -> m.s.star = x.star))")))
        o = _held(o, "near", F.expr("slice(array_sort(transform(matched, m -> named_struct('d', power(m.s.x - x, 2) + power(m.s.y - y, 2), 'id', m.id, 's', m.s))), 1, 3)"))
        own = "named_struct('star', star, 'x', x, 'y', y, 'u', u, 'v', v, 'w', w)"
        o = o.select("h", "star", "x", "y", "u", "v", "w", F.expr("transform(matched, m -> m.id)").alias("ids"), F.explode(F.expr("array(array(near[0], near[1]), array(near[0], near[2]), array(near[1], near[2]))")).alias("two"))
        o = _held(o, "two", F.expr(f"if({_TURN.format(a=own, b='two[0].s', c='two[1].s')} < 0, two, reverse(two))"))
        o = _held(o, "d", F.expr(_sides(own, "two[0].s", "two[1].s"))).where("array_min(d) >= 1e-7 and array_min(d) >= 0.2 * array_max(d)")
        o = o.select("h", F.expr(own).alias("o"), "ids", F.expr("two[0].id").alias("i1"), F.expr("two[1].id").alias("i2"), *[F.expr(f"d[{k}] / array_max(d)").alias(f"w{k}") for k in range(3)])
        hit = o.join(index, ["i1", "i2"]).where(_alike(error)).where("not array_contains(ids, i0)")
        one = hit.groupBy("h", "o.star", "i0").agg(F.count("*").alias("n"), F.min(F.expr("sqrt(power(w0 - r0, 2) + power(w1 - r1, 2) + power(w2 - r2, 2))")).alias("e"), F.first("o").alias("o"))
        order = F.struct(-F.col("n"), "e", "star", "i0")
        one = one.groupBy("h", "star").agg(F.min_by(F.struct("o", "i0", "n", "e", "star"), order).alias("b")).select("h", "b.*")
        one = one.groupBy("h", "i0").agg(F.min_by(F.struct("o", "e"), order).alias("b"))
        more = one.groupBy("h").agg(F.collect_list(F.struct(F.col("b.o").alias("s"), F.col("i0").alias("id"))).alias("more"), F.sum("b.e").alias("e"))
        if more.isEmpty():
            break
        grown = h.join(more, "h", "left").select("h", "frame_idx", "stars", F.when(F.col("more").isNull(), F.col("matched")).otherwise(F.concat("matched", "more")).alias("matched"), (F.col("off") + F.coalesce("e", F.lit(0.0))).alias("off"))
        h = _settled(grown)
    best = h.groupBy("frame_idx").agg(F.max_by("matched", F.struct(F.size("matched"), -F.col("off"), "h")).alias("matched"))
    out = best.select("frame_idx", F.size("matched").alias("n"), F.explode("matched").alias("m")).select("frame_idx", F.col("m.s.star").alias("star"), F.col("m.id").alias("id"), F.col("n").alias("matched"))
    return out.join(points.select("frame_idx", F.col("id").alias("star"), "x", "y", "brightness"), ["frame_idx", "star"]).join(catalog.select("id", "ra", "dec", "mag"), "id").select("frame_idx", "star", "id", "x", "y", "brightness", "ra", "dec", "mag", "matched")
