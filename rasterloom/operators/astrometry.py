"""Points, registration and catalogue matching as bucketed range joins and grouped fits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import angular_distance, gnomonic
from . import consensus, labels, morphology, planes
from .consensus import consensus_shift as ransac_shift
from .labels import settled
from .points import nearest, pairs_within, similarity_fit, topk_grid


def cone_search(catalog: DataFrame, cones: DataFrame, limit: float | None = None) -> DataFrame:
    """(cone, id, distance) of stars within each cone (cone, ra0, dec0, radius in degrees), up to a magnitude limit.

    Joined on degrees of declination and on cells of right ascension, about a degree wide in each band; a cone near a
    pole takes all cells of a band. The exact distance decides. The planner takes cones in all their cells for as small as
    the cones, so neither side is ever broadcast.
    """
    stars = catalog if limit is None else catalog.where(F.col("mag") <= limit)
    count = F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(F.least(F.lit(90.0), F.abs(F.col("band") + 0.5) + 0.5))))).cast("int")
    bands = cones.select("*", F.explode(F.sequence(F.floor(F.col("dec0") - F.col("radius")).cast("int"), F.floor(F.col("dec0") + F.col("radius")).cast("int"))).alias("band")).withColumn("cells", count)
    reach = F.when(F.abs("dec0") + F.col("radius") < 89.9, F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians("radius")) / F.cos(F.radians("dec0"))))) + 1e-6).otherwise(180.0)
    at = lambda ra: F.floor(ra / 360 * F.col("cells")).cast("int")
    cells = F.array_distinct(F.transform(F.sequence(at(F.col("ra0") - reach), at(F.col("ra0") + reach)), lambda c: F.pmod(c, F.col("cells"))))
    bands = bands.withColumn("cell", F.explode(cells)).drop("cells")
    d = angular_distance(F.col("ra"), F.col("dec"), F.col("ra0"), F.col("dec0"))
    placed = stars.withColumn("band", F.floor("dec").cast("int")).withColumn("cells", count).withColumn("cell", F.pmod(at(F.col("ra")), F.col("cells"))).drop("cells")
    return placed.join(bands.hint("merge"), ["band", "cell"]).withColumn("distance", d).where(F.col("distance") <= F.col("radius")).select("cone", "id", "distance")


def triangles(neighbours: DataFrame) -> DataFrame:
    """Triangles of each centre with two of its neighbours: (id0, id1, id2, k0, k1).

    neighbours: (id, other, xi, eta), tangent-plane places about the centre, few per centre. Vertices run clockwise and
    begin so that the longest side comes last; the key is the two other sides over it.
    """
    a = neighbours.select("id", F.col("other").alias("o1"), F.col("xi").alias("x1"), F.col("eta").alias("y1"))
    b = neighbours.select("id", F.col("other").alias("o2"), F.col("xi").alias("x2"), F.col("eta").alias("y2"))
    both = a.join(b, "id").where("o1 < o2").withColumn("turn", F.col("x1") * F.col("y2") - F.col("y1") * F.col("x2")).where("turn != 0")
    left = F.col("turn") < 0
    pick = lambda c, d: F.when(left, F.col(c)).otherwise(F.col(d))
    t = both.select("id", pick("o1", "o2").alias("p"), pick("o2", "o1").alias("q"), pick("x1", "x2").alias("px"), pick("y1", "y2").alias("py"), pick("x2", "x1").alias("qx"), pick("y2", "y1").alias("qy"))
    length = lambda u, v: F.sqrt(u * u + v * v)
    s0, s1, s2 = length(F.col("px"), F.col("py")), length(F.col("qx") - F.col("px"), F.col("qy") - F.col("py")), length(F.col("qx"), F.col("qy"))
    t = t.select("id", "p", "q", s0.alias("s0"), s1.alias("s1"), s2.alias("s2"))  # sides: id-p, p-q, q-id
    longest = F.greatest("s0", "s1", "s2")
    roll = F.when(F.col("s2") == longest, 0).when(F.col("s0") == longest, 1).otherwise(2)
    ids, sides = F.array("id", "p", "q"), F.array("s0", "s1", "s2")
    at = lambda x, k: F.element_at(x, ((F.col("roll") + k) % 3 + 1).cast("int"))
    t = t.withColumn("roll", roll)
    return t.select(at(ids, 0).alias("id0"), at(ids, 1).alias("id1"), at(ids, 2).alias("id2"), (at(sides, 0) / at(sides, 2)).alias("k0"), (at(sides, 1) / at(sides, 2)).alias("k1"))


def catalog_triangles(catalog: DataFrame, radius: float, limit: float = 8.0, count: int = 10, widest: float = 90.0) -> DataFrame:
    """Triangles of each star up to the limit with its nearest neighbours (at most count) that are at least as bright.

    Stars with fewer than count such neighbours within the radius are searched again with twice the radius, until all have
    enough or the widest radius is reached.
    """
    stars = catalog.where(F.col("mag") <= limit)
    own, todo, near = stars.select(F.col("id").alias("cone"), F.col("ra").alias("ra0"), F.col("dec").alias("dec0"), F.col("mag").alias("mag0")), None, None
    while True:
        cones = (own if todo is None else own.join(todo, "cone", "left_semi")).withColumn("radius", F.lit(float(radius)))
        found = cone_search(stars, cones.select("cone", "ra0", "dec0", "radius"))
        found = found.where("cone != id").join(stars.select("id", "ra", "dec", "mag"), "id").join(own, "cone").where("mag <= mag0")
        last = radius >= widest
        few = own.select("cone") if todo is None else todo
        few = few.join(found.groupBy("cone").agg(F.count("*").alias("n")), "cone", "left").where(F.coalesce("n", F.lit(0)) < count).select("cone")
        few = few.checkpoint() if few.sparkSession.sparkContext.getCheckpointDir() else few.persist()
        done = found if last else found.join(few, "cone", "left_anti")
        near = done if near is None else near.unionByName(done)
        if last or few.isEmpty():
            break
        todo, radius = few, min(widest, 2 * radius)
    rank = F.row_number().over(Window.partitionBy("cone").orderBy("distance", "id"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= count)
    xi, eta, _ = gnomonic(F.col("ra"), F.col("dec"), F.col("ra0"), F.col("dec0"))
    return triangles(near.select(F.col("cone").alias("id"), F.col("id").alias("other"), xi.alias("xi"), eta.alias("eta")))


def triangle_search(wanted: DataFrame, known: DataFrame, error: float) -> DataFrame:
    """Triangle pairs whose keys differ by at most error times the wanted key's length: buckets of that side, 3 x 3 of them probed."""
    side = error * 1.4143  # keys have components up to one
    b = lambda c: F.floor(F.col(c) / side).cast("long")
    w = wanted.select(*[F.col(c).alias(f"w_{c}") for c in ("id0", "id1", "id2", "k0", "k1")], F.explode(F.array(*[F.struct((b("k0") + i).alias("b0"), (b("k1") + j).alias("b1")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("b"))
    k = known.select("id0", "id1", "id2", "k0", "k1", b("k0").alias("b0"), b("k1").alias("b1"))
    d = F.hypot(F.col("k0") - F.col("w_k0"), F.col("k1") - F.col("w_k1"))
    return w.select("*", "b.b0", "b.b1").drop("b").join(k, ["b0", "b1"]).where(d <= error * F.hypot("w_k0", "w_k1")).drop("b0", "b1")


def fall_back(found: DataFrame, *others: DataFrame) -> DataFrame:
    """A registration table in which frames without an offset take the first that another method found for them.

    others: (frame_idx, dx, dy, success, confidence) of phase correlation, template matching, in order of preference;
    their offsets say where the reference lies in the frame, so they are turned round.
    """
    for other in others:
        o = other.where("success").select("frame_idx", (-F.col("dx")).alias("ox"), (-F.col("dy")).alias("oy"), F.col("confidence").alias("oc"))
        missing = F.col("dx").isNull() & F.col("ox").isNotNull()
        joined = found.join(o, "frame_idx", "left").withColumn("missing", missing)
        pick = lambda a, b: F.when(F.col("missing"), b).otherwise(F.col(a)).alias(a)
        found = joined.select("frame_idx", pick("dx", F.col("ox")), pick("dy", F.col("oy")), pick("rotation", F.lit(0.0)), pick("confidence", F.col("oc")), "time")
    return found


def register_frames(images: DataFrame, reference: DataFrame, width: int, height: int, *, quantile: float = 0.95, least: float = 2.0, most: float = 16.0, aspect: float = 2.0, rows: int = 3, columns: int = 3, stars: int = 8, radius: float = 100.0, phase_most: float = 100.0, template_reach: int = 150, previous: bool = False, rounds: int = 100, seed: int = 17, saturation: float | None = None) -> DataFrame:
    """The registration table (see detect_shifts) of one-plane frames (frame_idx, y, x, v) against a reference plane (y, x, v).

    Frames are normalised; points are sought in what stands out of their background (see morphology.star_planes; `saturation`
    hides what lies about saturated cells), over the quantile of the values above 0. The brightest, `stars` in each grid
    cell and 20 more, are matched with the reference's. Frames where that fails are registered by phase correlation, and
    where that fails too by the place of the reference's centre.
    """
    images, reference = planes.normalised(images.withColumn("plane_idx", F.lit(0))), planes.normalised(reference.select(F.lit(0).alias("frame_idx"), F.lit(0).alias("plane_idx"), "y", "x", "v"))

    def points(df: DataFrame) -> DataFrame:
        bright = settled(morphology.star_planes(df, width, height, saturation)).where("v > 0")
        p = labels.points(bright, quantile, least, most, aspect).withColumn("id", F.col("point"))
        return topk_grid(p, "brightness", width, height, rows, columns, stars, 20).select("frame_idx", "id", "x", "y")

    frames = images.select("frame_idx").distinct().withColumn("seconds", F.lit(None).cast("double"))
    found = settled(detect_shifts(settled(points(images)), settled(points(reference).drop("frame_idx")), frames, radius, width, height, previous, seed, rounds))
    left = images.join(found.where("dx is null").select("frame_idx"), "frame_idx", "left_semi")
    plane = reference.select("y", "x", "v")
    phase = planes.phase_shift(left, plane, width, height, phase_most).withColumn("confidence", F.least(F.lit(1.0), F.col("sharpness") / 10))
    template = planes.template_match(left, plane, width, height, template_reach).withColumn("confidence", F.col("score"))
    return fall_back(found, phase, template)


def near_previous(candidates: DataFrame, most: float) -> DataFrame:
    """Offsets (frame_idx, dx, dy, ...) that lie within `most` of the last frame's before them; the others go. The frame before
    the first lies at 0. Where an offset that goes must not count for the next frame, see consensus.previous_offsets."""
    w = Window.orderBy("frame_idx")  # a row a frame
    last = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0.0))
    return candidates.withColumns({"px": last("dx"), "py": last("dy")}).where(F.hypot(F.col("dx") - F.col("px"), F.col("dy") - F.col("py")) <= most).drop("px", "py")


def detect_shifts(points: DataFrame, reference: DataFrame, frames: DataFrame, radius: float = 100.0, width: float = 0.0, height: float = 0.0, previous: bool = False, seed: int = 17, rounds: int = 100) -> DataFrame:
    """The registration table: a row a frame with dx, dy, rotation (degrees), confidence and seconds since the reference.

    dx and dy move the frame onto the reference, after a turn about the centre of a frame of this width and height.
    Candidate pairs lie within the radius; with `previous`, of where the last frame's offset puts a point, so that a drift
    may exceed the radius (see consensus.previous_offsets). An offset by consensus, a similarity on its inliers.
    points: (frame_idx, id, x, y), few a frame; reference: (id, x, y); frames: (frame_idx, seconds). Frames without an
    offset have NULLs and confidence 0.
    """
    if previous:
        far = pairs_within(points, reference, math.hypot(width, height) + radius, carry=("frame_idx",))
        pairs = consensus.pairs_about(far, consensus.previous_offsets(consensus.candidate_offsets(far), frames, radius), radius)
    else:
        pairs = pairs_within(points, reference, radius, carry=("frame_idx",))
    pairs = settled(pairs)
    found = settled(ransac_shift(pairs, rounds, seed=seed).where("success"))
    near = pairs.join(found.select("frame_idx", F.col("dx").alias("mx"), F.col("dy").alias("my")), "frame_idx").where(F.hypot(F.col("xb") - F.col("xa") - F.col("mx"), F.col("yb") - F.col("ya") - F.col("my")) < 2)
    about = {c: F.col(c) - (width if c[0] == "x" else height) / 2 for c in ("xa", "ya", "xb", "yb")}
    fit = similarity_fit(near.withColumns(about)).where("n >= 3 and a is not null").select("frame_idx", F.degrees(F.atan2("b", "a")).alias("rotation"), F.col("dx").alias("fx"), F.col("dy").alias("fy"))
    some = frames.join(found, "frame_idx", "left").join(fit, "frame_idx", "left")
    return some.select("frame_idx", F.coalesce("fx", "dx").alias("dx"), F.coalesce("fy", "dy").alias("dy"), F.coalesce("rotation", F.when(F.col("dx").isNotNull(), 0.0)).alias("rotation"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("seconds").alias("time"))


def match_offsets(pairs: DataFrame, bin_: float = 1.0) -> DataFrame:
    """The set-based variant of the consensus: votes of rounded offsets of all candidate pairs, the fullest per frame."""
    votes = pairs.groupBy("frame_idx", F.round((F.col("xb") - F.col("xa")) / bin_).cast("long").alias("ox"), F.round((F.col("yb") - F.col("ya")) / bin_).cast("long").alias("oy")).agg(F.count("*").alias("votes"))
    best = F.max_by(F.struct("ox", "oy", "votes"), F.struct("votes", -F.col("ox"), -F.col("oy")))
    return votes.groupBy("frame_idx").agg(best.alias("b")).select("frame_idx", (F.col("b.ox") * bin_).alias("dx"), (F.col("b.oy") * bin_).alias("dy"), F.col("b.votes").alias("votes"))


def star_votes(matches: DataFrame) -> DataFrame:
    """Image star to catalogue star by votes of matched triangles: (star, id, votes), one catalogue star for each image star and the other way round."""
    votes = None
    for k in range(3):
        part = matches.select(F.col(f"w_id{k}").alias("star"), F.col(f"id{k}").alias("id"))
        votes = part if votes is None else votes.union(part)
    n = votes.groupBy("star", "id").agg(F.count("*").alias("votes"))
    first = lambda key, other: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("votes"), other))
    return n.withColumn("r", first("star", "id")).withColumn("q", first("id", "star")).where("r = 1 and q = 1").select("star", "id", "votes")


def identify_stars(points: DataFrame, catalog: DataFrame, known: DataFrame, radius: float, error: float = 0.005, count: int = 10) -> DataFrame:
    """(star, id, votes, x, y, brightness, ra, dec, mag) of image points that match catalogue stars, brightest first.

    Triangles of each point with its nearest neighbours within the radius are searched among the catalogue's (known, of
    catalog_triangles) by their side ratios; the vertices of matches vote. The image is taken as not mirrored.
    """
    own = points.select("id", "x", "y")
    votes = star_votes(triangle_search(triangles(nearest(pairs_within(own, own, radius), count)), known, error))
    return votes.join(points.select(F.col("id").alias("star"), "x", "y", "brightness"), "star").join(catalog.select("id", "ra", "dec", "mag"), "id").orderBy("mag")


def orientation(stars: DataFrame, ra0: float, dec0: float) -> DataFrame:
    """(frame_idx, crval1, crval2, rotation, pixel_scale, confidence) of identified stars (frame_idx, x, y, ra, dec), bound by name."""
    xi, eta, c = gnomonic(F.col("ra"), F.col("dec"), F.lit(ra0), F.lit(dec0))
    pairs = stars.withColumn("c", c).where("c > 0").select("frame_idx", F.col("x").alias("xa"), F.col("y").alias("ya"), xi.alias("xb"), eta.alias("yb"))
    fit = similarity_fit(pairs)
    return fit.select("frame_idx", F.lit(ra0).alias("crval1"), F.lit(dec0).alias("crval2"), F.degrees(F.atan2("b", "a")).alias("rotation"), (F.hypot("a", "b") * 3600).alias("pixel_scale"), F.least(F.lit(1.0), F.col("n") / 20).alias("confidence"))


def distortion(stars: DataFrame, order: int = 2) -> DataFrame:
    """SIP coefficients of each frame: (frame_idx, a, b, rms) from (frame_idx, u, v, xi, eta), centred pixels and tangent plane.

    A linear fit to the tangent plane, its inverse, and a fit of the residuals in u^2, uv, v^2 (and the cubes for order 3).
    Six stars are needed for order 2, ten for order 3; fewer give no row.
    """
    powers = [(i, n - i) for n in range(2, order + 1) for i in range(n, -1, -1)]

    def run(pdf):
        if len(pdf) < (6 if order == 2 else 10):
            return pd.DataFrame({"frame_idx": [], "a": [], "b": [], "rms": []})
        u, v = pdf["u"].to_numpy(float), pdf["v"].to_numpy(float)
        base = np.stack((u, v, np.ones_like(u)), axis=1)
        linear = np.linalg.lstsq(base, pdf[["xi", "eta"]].to_numpy(float), rcond=None)[0]
        ideal = (pdf[["xi", "eta"]].to_numpy(float) - linear[2]) @ np.linalg.pinv(linear[:2])
        rest = ideal - np.stack((u, v), axis=1)
        terms = np.stack([u**i * v**j for i, j in powers], axis=1)
        fit = np.linalg.lstsq(terms, rest, rcond=None)[0]
        rms = float(np.sqrt(((rest - terms @ fit) ** 2).sum(axis=1).mean()))
        return pd.DataFrame({"frame_idx": [int(pdf["frame_idx"].iloc[0])], "a": [fit[:, 0].tolist()], "b": [fit[:, 1].tolist()], "rms": [rms]})

    return stars.groupBy("frame_idx").applyInPandas(run, "frame_idx int, a array<double>, b array<double>, rms double")
