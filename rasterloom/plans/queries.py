"""Registered queries over the given tables, each with its SQL equivalent where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..model import KEY, Stream
from ..operators import astrometry, colour, consensus, fit, geometry, morphology, neighbourhood, pixelwise, planes, ranks, spectra
from ..sources.tables import EM_SQL, EV_SQL, LI_SQL, PT_SQL, points_pt, raster_em, raster_li, table_ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6
KEYS = "frame_idx, plane_idx, y, x"


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def pixels_out(df: DataFrame) -> DataFrame:
    """Keys and the value rounded, as the queries return pixels."""
    values = [c for c in ("v", "re", "im") if c in df.columns]
    return df.select(*[F.col(k).cast("int").alias(k) for k in KEY if k in df.columns], *[(F.round(c, DIGITS) + F.lit(0.0)).alias(c) for c in values])


def li(sql: str) -> str:
    return f"WITH {LI_SQL} {sql}"


def em(sql: str) -> str:
    return f"WITH {EM_SQL} {sql}"


def em_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense raster with its lowest values made invalid."""
    return raster_em(spark, sf_dir).withColumn("v", F.when(F.col("v") >= -0.2, F.col("v")))


EMI = "(SELECT frame_idx, plane_idx, y, x, CASE WHEN v >= -0.2 THEN v END AS v FROM em)"

# --- unary operators ---------------------------------------------------------------------------------------------
UNARY_SQL = {
    "negate": "-v", "inverse": "CASE WHEN v <> 0 THEN 1 / v END", "sign": "CAST(sign(v) AS DOUBLE)", "absolute": "abs(v)",
    "natural_logarithm": "CASE WHEN v = 0 THEN '-inf'::DOUBLE WHEN v > 0 THEN ln(v) END", "natural_exponential": "exp(v)",
    "squared_norm": "v * v", "conjugate": "v", "fill_0": "CASE WHEN v IS NOT NULL THEN 0.0 END", "fill_1": "CASE WHEN v IS NOT NULL THEN 1.0 END", "pass": "v",
}
for _name, _sql in UNARY_SQL.items():
    register(f"px_{_name}", lambda s, d, n=_name: pixels_out(pixelwise.unary(em_invalid(s, d), n)), em(f"SELECT {KEYS}, round(CAST({_sql} AS DOUBLE), {DIGITS}) + 0.0 AS v FROM {EMI}"))

# --- binary operators: every frame with the stack's mean, which is an auxiliary stream of one frame ----------------
BINARY_SQL = {
    "offset": "a + b", "scale": "a * b", "power": "CASE WHEN a >= 0 THEN power(a, b) END", "max": "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END",
    "min": "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END", "upper_pass": "CASE WHEN a < b THEN NULL ELSE a END", "lower_pass": "CASE WHEN b < a THEN NULL ELSE a END",
}


def with_mean(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pixels = em_invalid(spark, sf_dir)
    mean = pixelwise.stack(pixels, "average")
    streams = [Stream(mean, 1, 3, 8, 8, "auxiliary"), Stream(pixels, 2, 3, 8, 8)]
    return pixels_out(pixelwise.binary(streams, name).pixels)


for _name, _sql in BINARY_SQL.items():
    register(f"px_{_name}", lambda s, d, n=_name: with_mean(s, d, n), em(f"""SELECT {KEYS}, round(CAST({_sql} AS DOUBLE), {DIGITS}) + 0.0 AS v FROM (
        SELECT p.frame_idx, plane_idx, y, x, p.v AS a, m.b FROM {EMI} p JOIN (SELECT plane_idx, y, x, avg(v) AS b FROM {EMI} GROUP BY ALL) m USING (plane_idx, y, x))"""))


def polynomial_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface = Stream(type="polynomial", coefficients=((1.0, 0.5), (0.25, 0.125)))
    return pixels_out(pixelwise.binary([Stream(raster_li(spark, sf_dir), 7, 3, 32, 32), surface], "scale").pixels)


register("px_polynomial_scale", polynomial_scale, li(f"SELECT {KEYS}, round(v * (1 + 0.5 * x + 0.25 * y + 0.125 * x * y), {DIGITS}) AS v FROM li"))


def tensor_row_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tensor of one row is broadcast over the others: the join key is x alone."""
    pixels = raster_li(spark, sf_dir)
    row = pixels.where("frame_idx = 0 and plane_idx = 0 and y = 0").select(*KEY, "v")
    streams = [Stream(pixels, 7, 3, 32, 32), Stream(row, 1, 1, 32, 1, "auxiliary", "tensor")]
    return pixels_out(pixelwise.binary(streams, "offset").pixels)


register("px_tensor_row_offset", tensor_row_offset, li(f"SELECT p.frame_idx, p.plane_idx, p.y, p.x, round(p.v + t.v, {DIGITS}) AS v FROM li p JOIN (SELECT x, v FROM li WHERE frame_idx = 0 AND plane_idx = 0 AND y = 0) t USING (x)"))

# --- stacking ----------------------------------------------------------------------------------------------------
STACK_SQL = {"sum": "sum(v)", "count": "CAST(count(v) AS DOUBLE)", "maximum": "max(v)", "minimum": "min(v)", "average": "avg(v)", "standard_deviation": "stddev_pop(v)"}
for _name, _sql in STACK_SQL.items():
    register(f"stack_{_name}", lambda s, d, n=_name: pixels_out(pixelwise.stack(raster_li(s, d), n)), li(f"SELECT 0 AS frame_idx, plane_idx, y, x, round({_sql}, {DIGITS}) AS v FROM li GROUP BY plane_idx, y, x"))
register("stack_product", lambda s, d: pixels_out(pixelwise.stack(em_invalid(s, d).withColumn("v", F.col("v") / 100 + 1), "product")), em(f"SELECT 0 AS frame_idx, plane_idx, y, x, round(product(v / 100 + 1), {DIGITS}) AS v FROM {EMI} GROUP BY plane_idx, y, x"))
CLIP = f"""clip AS (SELECT {KEYS}, CASE WHEN abs(v - avg(v) OVER w) > 1.5 * stddev_pop(v) OVER w THEN NULL ELSE v END AS v FROM li WINDOW w AS (PARTITION BY plane_idx, y, x))"""
register("sigma_clip", lambda s, d: pixels_out(pixelwise.sigma_clip(raster_li(s, d))), f"WITH {LI_SQL}, {CLIP} SELECT {KEYS}, round(v, {DIGITS}) AS v FROM clip")
register("sigma_clip_average", lambda s, d: pixels_out(pixelwise.sigma_clipped_average(raster_li(s, d))), f"WITH {LI_SQL}, {CLIP} SELECT 0 AS frame_idx, plane_idx, y, x, round(avg(v), {DIGITS}) AS v FROM clip GROUP BY plane_idx, y, x")

# --- colour and layout -------------------------------------------------------------------------------------------
WIDE = "wide AS (SELECT frame_idx, y, x, max(v) FILTER (plane_idx = 0) AS p0, max(v) FILTER (plane_idx = 1) AS p1, max(v) FILTER (plane_idx = 2) AS p2 FROM {t} GROUP BY ALL)"


def planes_sql(table: str, cte: str, *values: str) -> str:
    return f"WITH {cte}, {WIDE.format(t=table)} " + " UNION ALL ".join(f"SELECT frame_idx, {k} AS plane_idx, y, x, round({v}, {DIGITS}) + 0.0 AS v FROM wide" for k, v in enumerate(values))


LAB = ("(p0 + p1 + p2) / 3", "(p0 - p1) / sqrt(2.0)", "(p0 + p1 - 2 * p2) / sqrt(6.0)")
register("colour_lab", lambda s, d: pixels_out(colour.to_lab(raster_em(s, d))), planes_sql("em", EM_SQL, *LAB))
register("colour_rgb", lambda s, d: pixels_out(colour.to_rgb(raster_em(s, d))), planes_sql("em", EM_SQL, "p0 + p1 / sqrt(2.0) + p2 / sqrt(6.0)", "p0 - p1 / sqrt(2.0) + p2 / sqrt(6.0)", "p0 - 2 * p2 / sqrt(6.0)"))
register("colour_lab_cube_root", lambda s, d: pixels_out(colour.to_lab(raster_em(s, d), cube_root=True)), planes_sql("(SELECT frame_idx, plane_idx, y, x, cbrt(v) AS v FROM em)", EM_SQL, *LAB))
_D = "sqrt(p0 * p0 + (p1 - 0.1) * (p1 - 0.1) + p2 * p2)"
_MASK = f"CASE WHEN {_D} <= 0.1 THEN 0.0 WHEN {_D} <= 0.1 + 3 * 0.05 THEN 1 - exp(-power(({_D} - 0.1) / 0.05, 2)) WHEN {_D} IS NOT NULL THEN 1.0 END"
register("colour_mask", lambda s, d: pixels_out(colour.colour_mask(raster_em(s, d), [(0.0, 0.1, 0.0, 0.1, 0.05)])), planes_sql("em", EM_SQL, _MASK, _MASK, _MASK))
register("bayer_sparse", lambda s, d: pixels_out(colour.bayer_sparse(raster_li(s, d))), li(f"""SELECT frame_idx, p AS plane_idx, y, x, CASE WHEN p = (CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN 0 WHEN y % 2 = 1 AND x % 2 = 1 THEN 2 ELSE 1 END) THEN v END AS v
    FROM li, (SELECT CAST(unnest(range(3)) AS INT) AS p) WHERE plane_idx = 0"""))
register("bayer_dense", lambda s, d: pixels_out(colour.bayer_dense(raster_li(s, d))), li("SELECT frame_idx, CASE WHEN y % 2 = 0 THEN (x % 2) ELSE CASE WHEN x % 2 = 0 THEN 3 ELSE 2 END END AS plane_idx, y // 2 AS y, x // 2 AS x, v FROM li WHERE plane_idx = 0"))
register("auto_levels", lambda s, d: colour.auto_levels(raster_em(s, d)).select(F.col("frame_idx"), F.round("low", DIGITS).alias("low"), F.round("high", DIGITS).alias("high")), em(f"SELECT frame_idx, round(quantile_cont(v, 0.01), {DIGITS}) AS low, round(quantile_cont(v, 0.99), {DIGITS}) AS high FROM em GROUP BY frame_idx"))
CURVE = [(-0.3, 0.0), (-0.1, 0.2), (0.05, 0.7), (0.3, 1.0)]


def curve_sql() -> str:
    pieces = " ".join(f"WHEN v <= {high!r} THEN {c[0]!r} + (v - {low!r}) * ({c[1]!r} + (v - {low!r}) * ({c[2]!r} + (v - {low!r}) * {c[3]!r}))" for low, high, c in ((float(a), float(b), tuple(map(float, k))) for a, b, k in colour.spline(CURVE)))
    return f"greatest(0, least(255, 255 * CASE WHEN v < -0.3 THEN 0.0 WHEN v > 0.3 THEN 1.0 {pieces} END))"


register("tone_curve", lambda s, d: pixels_out(raster_em(s, d).withColumn("v", colour.tone_curve(F.col("v"), CURVE, out=(0.0, 255.0)))), em(f"SELECT {KEYS}, round({curve_sql()}, {DIGITS}) AS v FROM em"))
register("chroma_yuv", lambda s, d: pixels_out(colour.long(colour.matrix_colours(colour.wide(raster_em(s, d)), colour.YUV), [F.col("p0"), F.col("p1"), F.col("p2")])), planes_sql("em", EM_SQL, *["p0 * " + " + ".join(f"({v})" + (f" * p{k + 1}" if k < 2 else "") for k, v in enumerate((r[0], r[1], r[2]))).replace(f"({r[1]}) * p2", f"p1 * ({r[1]})").replace(f"({r[0]}) * p1", f"({r[0]})").replace(f"({r[2]})", f"p2 * ({r[2]})") for r in colour.YUV]))

# --- geometry ----------------------------------------------------------------------------------------------------
register("transpose", lambda s, d: pixels_out(colour.transpose(raster_li(s, d))), li("SELECT frame_idx, plane_idx, x AS y, y AS x, v FROM li"))
for _name, _args, _y, _x, _where in (
    ("roll", {"shift_x": 5, "shift_y": -3}, "(y + 29) % 32", "(x + 5) % 32", "true"),
    ("flip", {"flip_x": True}, "y", "31 - x", "true"),
    ("rot90", {"rot90": 1}, "x", "31 - y", "true"),
    ("crop", {"left": 4, "top": 2, "crop_width": 20, "crop_height": 24}, "y - 2", "x - 4", "x BETWEEN 4 AND 23 AND y BETWEEN 2 AND 25"),
):
    register(f"reposition_{_name}", lambda s, d, a=_args: pixels_out(geometry.reposition(raster_li(s, d), 32, 32, **a)), li(f"SELECT frame_idx, plane_idx, CAST({_y} AS INT) AS y, CAST({_x} AS INT) AS x, v FROM li WHERE {_where}"))
AFFINE = (2.25, -1.5, 30.0, 1.25)


def transform_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = raster_li(spark, sf_dir)
    params = pixels.select("frame_idx").distinct().select("frame_idx", *[F.lit(v).alias(n) for n, v in zip(("dx", "dy", "rotation", "scale"), AFFINE, strict=True)])
    return pixels_out(geometry.transform(pixels, params, 32, 32, 40, 40))


_C, _S = f"cos(radians({AFFINE[2]}))", f"sin(radians({AFFINE[2]}))"
register("transform_affine", transform_affine, li(f"""SELECT frame_idx, plane_idx, Y AS y, X AS x, round(sum(v * wx * wy), {DIGITS}) AS v FROM (
    SELECT p.frame_idx, p.plane_idx, Y, X, p.v, CASE WHEN p.x = x0 THEN 1 - (xs - x0) ELSE xs - x0 END AS wx, CASE WHEN p.y = y0 THEN 1 - (ys - y0) ELSE ys - y0 END AS wy
    FROM (SELECT *, floor(xs) AS x0, floor(ys) AS y0 FROM (SELECT Y, X, 16 + ({_C} * (X - {AFFINE[0]} - 16) + {_S} * (Y - {AFFINE[1]} - 16)) / {AFFINE[3]} AS xs, 16 + (-{_S} * (X - {AFFINE[0]} - 16) + {_C} * (Y - {AFFINE[1]} - 16)) / {AFFINE[3]} AS ys
        FROM (SELECT CAST(unnest(range(40)) AS INT) AS Y), (SELECT CAST(unnest(range(40)) AS INT) AS X))) g JOIN li p ON p.x - x0 IN (0, 1) AND p.y - y0 IN (0, 1)) GROUP BY ALL""".replace("Y AS y, X AS x", "ty AS y, tx AS x").replace("p.plane_idx, Y, X, p.v", "p.plane_idx, ty, tx, p.v").replace("SELECT Y, X, 16", "SELECT ty, tx, 16").replace("(X - ", "(tx - ").replace("(Y - ", "(ty - ").replace("AS Y)", "AS ty)").replace("AS X)", "AS tx)")))


def param_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' customers as frames; parameters of nations below 10 with a fallback row."""
    frames = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_nationkey").cast("string").alias("image_id"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key = nation.columns[0]
    rows = nation.where(F.col(key) < 10).select(F.col(key).cast("string").alias("line"), (F.col(key) * 1.5).cast("double").alias("dx"))
    fallback = nation.agg(F.lit("").alias("line"), F.lit(-1.0).alias("dx"))
    return geometry.lookup(frames, rows.union(fallback)).select("c_custkey", "dx")


register("param_lookup", param_lookup, "SELECT c_custkey, CASE WHEN c_nationkey < 10 AND c_nationkey IN (SELECT n_nationkey FROM nation) THEN CAST(c_nationkey * 1.5 AS DOUBLE) ELSE -1.0 END AS dx FROM customer")

# --- neighbourhood -----------------------------------------------------------------------------------------------


def kernel_sql(kernel) -> str:
    rows = [f"({a - len(kernel) // 2}, {b - len(r) // 2}, {v!r}::DOUBLE)" for a, r in enumerate(kernel) for b, v in enumerate(r)]
    return f"""SELECT g.frame_idx, g.plane_idx, g.y, g.x, round(coalesce(sum(p.v * k.k), 0), {DIGITS}) + 0.0 AS v
    FROM (SELECT DISTINCT frame_idx, plane_idx, gy.y, gx.x FROM li, (SELECT CAST(unnest(range(32)) AS INT) AS y) gy, (SELECT CAST(unnest(range(32)) AS INT) AS x) gx) g
    CROSS JOIN (VALUES {', '.join(rows)}) k(dy, dx, k) LEFT JOIN li p ON p.frame_idx = g.frame_idx AND p.plane_idx = g.plane_idx AND p.y = g.y - k.dy AND p.x = g.x - k.dx GROUP BY ALL"""


for _name, _kernel in (("blur", neighbourhood.BLUR), ("sharpen", neighbourhood.SHARPEN)):
    register(f"convolve_{_name}", lambda s, d, k=_kernel: pixels_out(neighbourhood.convolve(raster_li(s, d), k, 32, 32)), li(kernel_sql(_kernel)))
register("convolve_fft", lambda s, d: pixels_out(planes.fft_convolve(raster_li(s, d), neighbourhood.BLUR, 32, 32)).withColumn("v", F.round("v", 4)), li(kernel_sql(neighbourhood.BLUR).replace(f", {DIGITS}) + 0.0", ", 4) + 0.0")))


def rank_sql(q: float, n: int) -> str:
    b = (n - 1) // 2
    return windows_sql(q, f"(SELECT CAST(a AS INT) AS dy, CAST(b AS INT) AS dx FROM (SELECT unnest(range({-b}, {n - b})) AS a), (SELECT unnest(range({-b}, {n - b})) AS b))")


def windows_sql(q: float, taps: str) -> str:
    """Every cell of every plane with the q-quantile of the values at the taps (dy, dx) beside it, NULL where there is none."""
    return li(f"""SELECT c.frame_idx, c.plane_idx, c.y, c.x, s[CAST(round_even({q} * (len(s) - 1), 0) AS INT) + 1] AS v
        FROM (SELECT DISTINCT frame_idx, plane_idx, gy.y, gx.x FROM li, (SELECT CAST(unnest(range(32)) AS INT) AS y) gy, (SELECT CAST(unnest(range(32)) AS INT) AS x) gx) c
        LEFT JOIN (SELECT frame_idx, plane_idx, y - dy AS y, x - dx AS x, list_sort(list(v)) AS s FROM li, {taps} t
            GROUP BY frame_idx, plane_idx, li.y - dy, li.x - dx) w ON (w.frame_idx, w.plane_idx, w.y, w.x) = (c.frame_idx, c.plane_idx, c.y, c.x)""")


register("median_3x3", lambda s, d: pixels_out(neighbourhood.quantile_filter(raster_li(s, d), [[1.0] * 3] * 3, 32, 32)), rank_sql(0.5, 3))
register("quantile_filter_q80", lambda s, d: pixels_out(neighbourhood.quantile_filter(raster_li(s, d), [[1.0] * 4] * 4, 32, 32, 0.8)), rank_sql(0.8, 4))

# --- linear algebra and transforms -------------------------------------------------------------------------------


def matrix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = raster_em(spark, sf_dir)
    return pixels_out(planes.matrix_product(a, colour.transpose(a)))


register("matrix_product", matrix_product, em(f"SELECT a.frame_idx, a.plane_idx, a.y, b.y AS x, round(sum(a.v * b.v), {DIGITS}) + 0.0 AS v FROM em a JOIN em b ON a.frame_idx = b.frame_idx AND a.plane_idx = b.plane_idx AND a.x = b.x GROUP BY ALL"))


def matrix_inverse_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A times its inverse is the identity; the diagonal is lifted so that all planes are regular."""
    a = raster_em(spark, sf_dir).withColumn("v", F.col("v") + F.when(F.col("x") == F.col("y"), 3.0).otherwise(0.0))
    return pixels_out(planes.matrix_product(a, planes.inverse_matrix(a, 8, 8)))


register("matrix_inverse_check", matrix_inverse_check, em("SELECT frame_idx, plane_idx, y, x, CASE WHEN x = y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM em"))
DFT_SQL = em(f"""SELECT a.frame_idx, a.plane_idx, k.y, l.x, round(sum(a.v * cos(2 * pi() * (k.y * a.y + l.x * a.x) / 8)), {DIGITS}) + 0.0 AS re, round(-sum(a.v * sin(2 * pi() * (k.y * a.y + l.x * a.x) / 8)), {DIGITS}) + 0.0 AS im
    FROM em a, (SELECT CAST(unnest(range(8)) AS INT) AS y) k, (SELECT CAST(unnest(range(8)) AS INT) AS x) l GROUP BY ALL""")
register("dft", lambda s, d: pixels_out(planes.fft(raster_em(s, d), 8, 8)), DFT_SQL)
register("dft_by_blocks", lambda s, d: pixels_out(spectra.transform(raster_em(s, d), 8, 8, block=3)), DFT_SQL)
register("idft_round_trip", lambda s, d: pixels_out(planes.ifft(planes.fft(raster_em(s, d), 8, 8), 8, 8)), em(f"SELECT {KEYS}, round(v, {DIGITS}) + 0.0 AS v, 0.0::DOUBLE AS i FROM em").replace("AS v, 0.0::DOUBLE AS i", "AS re, 0.0::DOUBLE AS im"))
TURN = "2 * pi() * (ky * {y} + kx * {x}) / 10"  # planes of 8 x 8 padded to 10 x 10
WIENER_SQL = em(f"""SELECT frame_idx, plane_idx, y, x, round(sqrt(re * re + im * im), {DIGITS}) + 0.0 AS v FROM (
    SELECT frame_idx, plane_idx, c.y, c.x, sum(gr * cos({TURN.format(y="(c.y - 1)", x="(c.x - 1)")}) - gi * sin({TURN.format(y="(c.y - 1)", x="(c.x - 1)")})) / 100 AS re,
           sum(gr * sin({TURN.format(y="(c.y - 1)", x="(c.x - 1)")}) + gi * cos({TURN.format(y="(c.y - 1)", x="(c.x - 1)")})) / 100 AS im
    FROM (SELECT frame_idx, plane_idx, f.ky, f.kx, (fr * hr + fi * hi) / (hr * hr + hi * hi + 0.01) AS gr, (fi * hr - fr * hi) / (hr * hr + hi * hi + 0.01) AS gi
          FROM (SELECT frame_idx, plane_idx, ky, kx, sum(v * cos({TURN.format(y="y", x="x")})) AS fr, -sum(v * sin({TURN.format(y="y", x="x")})) AS fi
                FROM em, (SELECT unnest(range(10)) AS ky), (SELECT unnest(range(10)) AS kx) GROUP BY ALL) f
          JOIN (SELECT ky, kx, sum(w * cos({TURN.format(y="i", x="j")})) AS hr, -sum(w * sin({TURN.format(y="i", x="j")})) AS hi
                FROM (SELECT i, j, (2 - abs(i - 1)) * (2 - abs(j - 1)) / 16.0::DOUBLE AS w FROM (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j)),
                     (SELECT unnest(range(10)) AS ky), (SELECT unnest(range(10)) AS kx) GROUP BY ALL) h USING (ky, kx)) g,
         (SELECT CAST(unnest(range(8)) AS INT) AS y) c_y, (SELECT CAST(unnest(range(8)) AS INT) AS x) c_x, LATERAL (SELECT c_y.y AS y, c_x.x AS x) c GROUP BY ALL)""")
register("deconvolve_wiener", lambda s, d: pixels_out(planes.deconvolve(raster_em(s, d), neighbourhood.BLUR, 8, 8)), WIENER_SQL)
register("wavelet_denoise", lambda s, d: pixels_out(planes.wavelet_denoise(raster_li(s, d), 32, 32, 1.5, neighbourhood.DB2)))


def band_sql(fy: str, fx: str) -> str:
    bank = neighbourhood.filter_bank(neighbourhood.DB2)
    taps = lambda k: "(VALUES " + ", ".join(f"({t}, {v!r}::DOUBLE)" for t, v in enumerate(bank[k])) + ")"
    mirror = lambda e: f"CASE WHEN {e} < 0 THEN -1 - ({e}) WHEN {e} > 7 THEN 15 - ({e}) ELSE {e} END"
    return em(f"""SELECT e.frame_idx, e.plane_idx, i.i AS y, j.j AS x, round(sum(e.v * ky.k * kx.k), {DIGITS}) + 0.0 AS v
    FROM (SELECT CAST(unnest(range(5)) AS INT) AS i) i, (SELECT CAST(unnest(range(5)) AS INT) AS j) j, {taps(fy)} ky(t, k), {taps(fx)} kx(t, k), em e
    WHERE e.y = {mirror('(2 * i.i + 1 - ky.t)')} AND e.x = {mirror('(2 * j.j + 1 - kx.t)')} GROUP BY ALL""")


for _band in ("aa", "ad", "da", "dd"):
    _f = {"a": "dec_lo", "d": "dec_hi"}
    register(f"dwt_{_band}", lambda s, d, b=_band: pixels_out(neighbourhood.dwt(raster_em(s, d), 8, 8)[b]), band_sql(_f[_band[0]], _f[_band[1]]))
register("idwt_round_trip", lambda s, d: pixels_out(neighbourhood.idwt(neighbourhood.dwt(raster_em(s, d), 8, 8), 8, 8)), em(f"SELECT {KEYS}, round(v, {DIGITS}) + 0.0 AS v FROM em"))

# --- fits and statistics -----------------------------------------------------------------------------------------
register("quadratic_moments", lambda s, d: fit.moments(raster_li(s, d)).select("frame_idx", "plane_idx", "s00", "s21", "s40", "t00", "t11", "t02"), li("SELECT frame_idx, plane_idx, CAST(count(*) AS DOUBLE) AS s00, CAST(sum(x * x * y) AS DOUBLE) AS s21, CAST(sum(x * x * x * x) AS DOUBLE) AS s40, sum(v) AS t00, sum(v * x * y) AS t11, sum(v * y * y) AS t02 FROM li GROUP BY ALL"))
register("background_residual", lambda s, d: fit.subtract_background(raster_li(s, d)).groupBy("frame_idx", "plane_idx").agg((F.round(F.sum("v"), 3) + F.lit(0.0)).alias("total"), (F.round(F.sum(F.col("v") * F.col("x")), 3) + F.lit(0.0)).alias("total_x")), li("SELECT DISTINCT frame_idx, plane_idx, 0.0::DOUBLE AS total, 0.0::DOUBLE AS total_x FROM li"))
register("histogram_256", lambda s, d: fit.histogram(raster_li(s, d)), li("""SELECT frame_idx, plane_idx, CASE WHEN hi > lo THEN CAST(least(255, floor((v - lo) * 256 / (hi - lo))) AS INT) ELSE 0 END AS bin, count(*) AS n
    FROM (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM li WINDOW w AS (PARTITION BY frame_idx, plane_idx)) GROUP BY ALL"""))
register("histogram_log", lambda s, d: fit.histogram(raster_li(s, d), 64, log=True).groupBy("frame_idx", "plane_idx").agg(F.sum("n").alias("n")), li("SELECT frame_idx, plane_idx, CAST(count(*) AS BIGINT) AS n FROM li WHERE v > 0 GROUP BY ALL"))
register("mode_value", lambda s, d: fit.mode_value(raster_li(s, d), 16).select("frame_idx", "plane_idx", F.round("mode", DIGITS).alias("mode")), li(f"""SELECT frame_idx, plane_idx, round(lo + (bin + 0.5) * (hi - lo) / 16, {DIGITS}) AS mode FROM (
    SELECT frame_idx, plane_idx, lo, hi, CASE WHEN hi > lo THEN least(15, floor((v - lo) * 16 / (hi - lo))) ELSE 0 END AS bin, count(*) AS n
    FROM (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM li WINDOW w AS (PARTITION BY frame_idx, plane_idx)) GROUP BY 1, 2, 3, 4, 5
    QUALIFY row_number() OVER (PARTITION BY frame_idx, plane_idx ORDER BY n DESC, bin) = 1)"""))
register("quantile_approx", lambda s, d: fit.histogram_quantile(raster_li(s, d), 0.75, 1024).select("frame_idx", F.round("value", DIGITS).alias("value")), li(f"""SELECT frame_idx, round(lo + (bin + 0.5) * (hi - lo) / 1024, {DIGITS}) AS value FROM (
    SELECT frame_idx, min(bin) AS bin, any_value(lo) AS lo, any_value(hi) AS hi FROM (SELECT frame_idx, lo, hi, bin, sum(n) OVER (PARTITION BY frame_idx ORDER BY bin) / sum(n) OVER (PARTITION BY frame_idx) AS cdf FROM (
        SELECT frame_idx, lo, hi, least(1023, floor((v - lo) * 1024 / (hi - lo))) AS bin, count(*) AS n FROM (SELECT *, min(v) OVER (PARTITION BY frame_idx) AS lo, max(v) OVER (PARTITION BY frame_idx) AS hi FROM li) GROUP BY ALL)) WHERE cdf >= 0.75 GROUP BY frame_idx)"""))
register("min_max", lambda s, d: raster_em(s, d).groupBy("frame_idx", "plane_idx").agg(F.min("v").alias("low"), F.max("v").alias("high")), em("SELECT frame_idx, plane_idx, min(v) AS low, max(v) AS high FROM em GROUP BY ALL"))
register("quantise_8bit", lambda s, d: raster_em(s, d).select(*KEY, scalar.quantise(F.col("v"), -0.5, 0.5, 255).alias("q")), em(f"SELECT {KEYS}, CAST(least(255, greatest(0, round_even((v + 0.5) * 256.0, 0))) AS INT) AS q FROM em"))
register("display_adaptive", lambda s, d: fit.display(raster_li(s, d)), li(f"""SELECT {KEYS}, CAST(least(255, greatest(0, round_even(coalesce((v - lo) * 255 / (hi - lo), 0), 0))) AS INT) AS level FROM li JOIN (SELECT frame_idx, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM li GROUP BY frame_idx) USING (frame_idx)"""))
register("isolines", lambda s, d: pixels_out(fit.isolines(raster_li(s, d), 16.0)), li(f"SELECT {KEYS}, round((v % 16) / 16, {DIGITS}) AS v FROM li"))

# a trimmed range, round by round: the first bin of the logarithmic edges and the last of the even ones with two values or more
_LOG_EDGE = "(CASE WHEN {k} <= 0 THEN lo WHEN {k} >= 32 THEN hi ELSE lo + (power(10.0, {k} / 32.0 - 1) - 0.1) * (hi - lo) / 0.9 END)"
_EVEN_EDGE = "(CASE WHEN {k} <= 0 THEN lo WHEN {k} >= 32 THEN hi ELSE lo + {k} * (hi - lo) / 32 END)"


def trim_sql(before: str, after: str) -> str:
    count = lambda edge: f"SELECT frame_idx, plane_idx, lo, hi, k FROM {before} JOIN tail USING (frame_idx, plane_idx), (SELECT unnest(range(32)) AS k) WHERE v >= lo AND v < hi AND v >= {edge.format(k='k')} AND v < {edge.format(k='(k + 1)')} GROUP BY ALL HAVING count(*) > 1"
    return f"""{after}_a AS (SELECT frame_idx, plane_idx, min(k) AS a FROM ({count(_LOG_EDGE)}) GROUP BY ALL), {after}_b AS (SELECT frame_idx, plane_idx, max(k) AS b FROM ({count(_EVEN_EDGE)}) GROUP BY ALL),
    {after} AS (SELECT frame_idx, plane_idx, low, high, CASE WHEN a > 0 THEN {_LOG_EDGE.format(k='a')} ELSE lo END AS lo, CASE WHEN b < 31 THEN {_EVEN_EDGE.format(k='(b + 1)')} ELSE hi END AS hi FROM {before} LEFT JOIN {after}_a USING (frame_idx, plane_idx) LEFT JOIN {after}_b USING (frame_idx, plane_idx))"""


#: Planes of whole customer balances with a few far outliers.
TAIL_SQL = "tail AS (SELECT CAST(c_nationkey % 3 AS INT) AS frame_idx, CAST(c_custkey % 2 AS INT) AS plane_idx, CASE WHEN c_custkey % 211 = 7 THEN c_acctbal * 40 WHEN c_custkey % 223 = 9 THEN -c_acctbal * 9 ELSE c_acctbal END AS v FROM customer)"
HIGH_RES_SQL = f"""{TAIL_SQL}, r0 AS (SELECT frame_idx, plane_idx, min(v) AS low, max(v) AS high, min(v) AS lo, max(v) AS hi FROM tail GROUP BY ALL), {trim_sql('r0', 'r1')}, {trim_sql('r1', 'r2')},
    edges AS (SELECT frame_idx, plane_idx, unnest(list_sort(list_distinct(list_concat([low, high], list_transform(range(33), lambda k: {_LOG_EDGE.format(k='k')}), list_transform(range(33), lambda k: {_EVEN_EDGE.format(k='k')}))))) AS edge FROM r2),
    spans AS (SELECT *, lead(edge) OVER w AS upper, lead(edge, 2) OVER w IS NULL AS last FROM edges WINDOW w AS (PARTITION BY frame_idx, plane_idx ORDER BY edge)),
    hist AS (SELECT frame_idx, plane_idx, edge AS low, upper AS high, count(*) AS n FROM spans JOIN tail USING (frame_idx, plane_idx) WHERE v >= edge AND (v < upper OR last AND v = upper) GROUP BY ALL)"""


def tail_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    v = F.when(k % 211 == 7, b * 40).when(k % 223 == 9, -b * 9).otherwise(b)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_nationkey") % 3).cast("int").alias("frame_idx"), (k % 2).cast("int").alias("plane_idx"), v.alias("v"))


def high_res(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.trimmed_histogram(tail_values(spark, sf_dir), 32, 2)


register("high_res_histogram", lambda s, d: high_res(s, d).select("frame_idx", "plane_idx", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n"), f"WITH {HIGH_RES_SQL} SELECT frame_idx, plane_idx, round(low, 4) AS low, round(high, 4) AS high, n FROM hist")
register("high_res_mode", lambda s, d: ranks.trimmed_mode(high_res(s, d)).select("frame_idx", "plane_idx", F.round("mode", 4).alias("mode")), f"WITH {HIGH_RES_SQL} SELECT frame_idx, plane_idx, round(arg_min((low + high) / 2, (-n, low)), 4) AS mode FROM hist GROUP BY ALL")
register("high_res_quantile", lambda s, d: ranks.histogram_quantile(high_res(s, d), 0.9).select("frame_idx", F.round("value", 4).alias("value")), f"""WITH {HIGH_RES_SQL}, c AS (SELECT frame_idx, (low + high) / 2 AS centre, sum(n) OVER (PARTITION BY frame_idx ORDER BY (low + high) / 2) AS run, sum(n) OVER (PARTITION BY frame_idx) AS total FROM hist)
    SELECT frame_idx, round(min(centre), 4) AS value FROM c WHERE run >= 0.9 * total GROUP BY frame_idx""")
register("exact_quantiles", lambda s, d: ranks.quantiles(raster_em(s, d), ("plane_idx",), (0.001, 0.25, 0.5, 0.999), buckets=64, gathered=32).select("plane_idx", *[F.round(F.col("p")[k], DIGITS).alias(f"q{k}") for k in range(4)]), em(f"SELECT plane_idx, {', '.join(f'round(quantile_cont(v, {q}), {DIGITS}) AS q{k}' for k, q in enumerate((0.001, 0.25, 0.5, 0.999)))} FROM em GROUP BY plane_idx"))
register("percentile_zoom", lambda s, d: fit.percentile_zoom(raster_em(s, d)).select("frame_idx", F.round("zoom_min", DIGITS).alias("zoom_min"), F.round("zoom_end", DIGITS).alias("zoom_end")), em(f"""SELECT frame_idx, round(a - (b - a) * 0.1, {DIGITS}) AS zoom_min, round(b + (b - a) * 0.1, {DIGITS}) AS zoom_end FROM (
    SELECT frame_idx, c[CAST(floor(len(c) * 0.001) AS INT) + 1] AS a, c[CAST(floor(len(c) * 0.999) AS INT) + 1] AS b FROM (SELECT frame_idx, list_sort(list(CASE WHEN hi > lo THEN lo + (least(255, floor((v - lo) * 256 / (hi - lo))) + 0.5) * (hi - lo) / 256 ELSE lo END)) AS c
        FROM (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM em WINDOW w AS (PARTITION BY frame_idx, plane_idx)) GROUP BY frame_idx))"""))
register("half_open_end", lambda s, d: table_ev(s, d).agg(fit.half_open_end(F.max("v"), True).alias("upper_end")), f"WITH {EV_SQL} SELECT max(v) + 1 AS upper_end FROM ev")
register("table_preview", lambda s, d: table_ev(s, d).orderBy("y", "x").limit(20).select("y", "x", "v"), f"WITH {EV_SQL} SELECT y, x, v FROM ev ORDER BY y, x LIMIT 20")
register("hourly_table", lambda s, d: table_ev(s, d).select("y", "x", "v"), f"WITH {EV_SQL} SELECT y, x, v FROM ev")

# --- points and sky ----------------------------------------------------------------------------------------------
register("topk_grid", lambda s, d: astrometry.topk_grid(points_pt(s, d), "mag", 1024, 1024).select("frame_idx", "cell", "rank", "id", "mag"), f"""WITH {PT_SQL} SELECT * FROM (SELECT frame_idx, CAST(floor(y * 3 / 1024) * 3 + floor(x * 3 / 1024) AS INT) AS cell, CAST(row_number() OVER (PARTITION BY frame_idx, floor(y * 3 / 1024) * 3 + floor(x * 3 / 1024) ORDER BY mag DESC, id) AS INT) AS rank, id, mag FROM pt) WHERE rank <= 8""")


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of each frame's points of even and of odd id, as of two exposures."""
    p = points_pt(spark, sf_dir).select("frame_idx", "id", "x", "y")
    return astrometry.pairs_within(p.where("id % 2 = 0"), p.where("id % 2 = 1"), 64.0, on=("frame_idx",)).select("id_a", "id_b", "d2")


register("candidate_pairs", candidate_pairs, f"WITH {PT_SQL} SELECT a.id AS id_a, b.id AS id_b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM pt a JOIN pt b ON a.frame_idx = b.frame_idx AND a.id % 2 = 0 AND b.id % 2 = 1 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 4096")
HAVERSINE = "degrees(2 * asin(sqrt(least(1.0, power(sin(radians({d1} - {d2}) / 2), 2) + cos(radians({d1})) * cos(radians({d2})) * power(sin(radians({r1} - {r2}) / 2), 2)))))"


def cone_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points_pt(spark, sf_dir)
    cones = p.where("id % 20 = 0").select(F.col("id").alias("cone"), (F.col("ra") + 0.5).alias("ra0"), (F.col("dec") * 0.9).alias("dec0"), F.lit(7.3).alias("radius"))
    return astrometry.cone_search(p, cones, 8.0).select("cone", "id", F.round("distance", DIGITS).alias("distance"))


_H = HAVERSINE.format(d1="p.dec", d2="c.dec0", r1="p.ra", r2="c.ra0")
register("cone_search", cone_search, f"WITH {PT_SQL}, c AS (SELECT id AS cone, ra + 0.5 AS ra0, dec * 0.9 AS dec0 FROM pt WHERE id % 20 = 0) SELECT cone, p.id, round({_H}, {DIGITS}) AS distance FROM pt p JOIN c ON p.mag <= 8.0 AND {_H} <= 7.3")
register("angular_distance", lambda s, d: points_pt(s, d).select("id", F.round(scalar.angular_distance(F.col("ra"), F.col("dec"), F.lit(120.0), F.lit(30.0)), DIGITS).alias("distance")), f"WITH {PT_SQL} SELECT id, round({HAVERSINE.format(d1='dec', d2='30.0', r1='ra', r2='120.0')}, {DIGITS}) AS distance FROM pt")


def gnomonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    xi, eta, c = scalar.gnomonic(F.col("ra"), F.col("dec"), F.lit(120.0), F.lit(30.0))
    return points_pt(spark, sf_dir).withColumns({"xi": xi, "eta": eta, "c": c}).where("c > 0.01").select("id", F.round("xi", 4).alias("xi"), F.round("eta", 4).alias("eta"))


_CD = "(sin(radians(30.0)) * sin(radians(dec)) + cos(radians(30.0)) * cos(radians(dec)) * cos(radians(ra - 120.0)))"
register("gnomonic", gnomonic, f"WITH {PT_SQL} SELECT id, round(degrees(cos(radians(dec)) * sin(radians(ra - 120.0)) / {_CD}), 4) AS xi, round(degrees((cos(radians(30.0)) * sin(radians(dec)) - sin(radians(30.0)) * cos(radians(dec)) * cos(radians(ra - 120.0))) / {_CD}), 4) AS eta FROM pt WHERE {_CD} > 0.01")


def gnomonic_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points_pt(spark, sf_dir)
    xi, eta, c = scalar.gnomonic(F.col("ra"), F.col("dec"), F.lit(120.0), F.lit(30.0))
    ra, dec = scalar.gnomonic_inverse(F.col("xi"), F.col("eta"), F.lit(120.0), F.lit(30.0))
    ra = F.pmod(F.round(ra, 4), F.lit(360.0))  # just below a full turn rounds to one
    return p.withColumns({"xi": xi, "eta": eta, "c": c}).where("c > 0.2 and dec < 90").select("id", ra.alias("ra"), F.round(dec, 4).alias("dec"))


register("gnomonic_round_trip", gnomonic_round_trip, f"WITH {PT_SQL} SELECT id, ra, dec FROM pt WHERE {_CD} > 0.2 AND dec < 90")


def image_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of each point with its five nearest neighbours in its frame."""
    p = points_pt(spark, sf_dir).select("frame_idx", "id", "x", "y")
    return astrometry.triangles(astrometry.nearest(astrometry.pairs_within(p, p, 96.0, on=("frame_idx",)), 5))


#: The triangles in SQL; id0..id2, k0, k1 as the library gives them.
TRIANGLES_SQL = f"""WITH {PT_SQL}, n AS (SELECT a.id, b.id AS o, b.x - a.x AS u, b.y - a.y AS v FROM pt a JOIN pt b ON a.frame_idx = b.frame_idx AND a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 9216
        QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) <= 5),
    b AS (SELECT p.id, p.o AS o1, p.u AS u1, p.v AS v1, q.o AS o2, q.u AS u2, q.v AS v2, p.u * q.v - p.v * q.u < 0 AS l FROM n p JOIN n q ON p.id = q.id AND p.o < q.o AND p.u * q.v <> p.v * q.u),
    c AS (SELECT id, CASE WHEN l THEN o1 ELSE o2 END AS p, CASE WHEN l THEN o2 ELSE o1 END AS q, CASE WHEN l THEN u1 ELSE u2 END AS px, CASE WHEN l THEN v1 ELSE v2 END AS py, CASE WHEN l THEN u2 ELSE u1 END AS qx, CASE WHEN l THEN v2 ELSE v1 END AS qy FROM b),
    d AS (SELECT [id, p, q] AS ids, [sqrt(px * px + py * py), sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py)), sqrt(qx * qx + qy * qy)] AS s FROM c),
    e AS (SELECT ids, s, CASE WHEN s[3] = list_max(s) THEN 0 WHEN s[1] = list_max(s) THEN 1 ELSE 2 END AS r FROM d),
    t AS (SELECT ids[r % 3 + 1] AS id0, ids[(r + 1) % 3 + 1] AS id1, ids[(r + 2) % 3 + 1] AS id2, s[r % 3 + 1] / s[(r + 2) % 3 + 1] AS k0, s[(r + 1) % 3 + 1] / s[(r + 2) % 3 + 1] AS k1 FROM e)"""


register("triangle_keys", lambda s, d: image_triangles(s, d).select("id0", "id1", "id2", F.round("k0", DIGITS).alias("k0"), F.round("k1", DIGITS).alias("k1")), f"{TRIANGLES_SQL} SELECT id0, id1, id2, round(k0, {DIGITS}) AS k0, round(k1, {DIGITS}) AS k1 FROM t")


def triangle_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = image_triangles(spark, sf_dir).dropDuplicates(["id0", "id1", "id2"])
    found = astrometry.triangle_search(t.where("id0 % 20 = 0"), t, 0.001)
    return found.select("w_id0", "w_id1", "w_id2", "id0", "id1", "id2")


register("triangle_search", triangle_search, f"""{TRIANGLES_SQL}, u AS (SELECT DISTINCT id0, id1, id2, k0, k1 FROM t)
    SELECT w.id0 AS w_id0, w.id1 AS w_id1, w.id2 AS w_id2, u.id0, u.id1, u.id2 FROM u w JOIN u ON w.id0 % 20 = 0 AND abs(w.k0 - u.k0) <= 0.0015 AND sqrt((w.k0 - u.k0) * (w.k0 - u.k0) + (w.k1 - u.k1) * (w.k1 - u.k1)) <= 0.001 * sqrt(w.k0 * w.k0 + w.k1 * w.k1)""")


def moved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of each frame's points with the same moved by (7, -4)."""
    p = points_pt(spark, sf_dir).select("frame_idx", "id", "x", "y")
    return astrometry.pairs_within(p, p.withColumns({"x": F.col("x") + 7, "y": F.col("y") - 4}), 12.0, on=("frame_idx",))


register("shift_votes", lambda s, d: astrometry.match_offsets(moved_pairs(s, d)), f"""WITH {PT_SQL}, o AS (SELECT a.frame_idx, b.x + 7 - a.x AS dx, b.y - 4 - a.y AS dy FROM pt a JOIN pt b ON a.frame_idx = b.frame_idx AND (b.x + 7 - a.x) * (b.x + 7 - a.x) + (b.y - 4 - a.y) * (b.y - 4 - a.y) < 144)
    SELECT frame_idx, dx, dy, count(*) AS votes FROM o GROUP BY frame_idx, dx, dy QUALIFY row_number() OVER (PARTITION BY frame_idx ORDER BY votes DESC, dx, dy) = 1""")
#: A consensus on the true offset takes in the true pairs and the few others that lie within the tolerance; their mean rounds to it.
register("ransac_shift", lambda s, d: astrometry.ransac_shift(moved_pairs(s, d)).select("frame_idx", F.round("dx").alias("dx"), F.round("dy").alias("dy"), "success"), f"WITH {PT_SQL} SELECT DISTINCT frame_idx, 7.0::DOUBLE AS dx, -4.0::DOUBLE AS dy, true AS success FROM pt")


def stray_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of each frame's points with the same moved by (7, -4), every fifth of them elsewhere."""
    p = points_pt(spark, sf_dir).select("frame_idx", "id", "x", "y")
    away = F.col("id") % 5 == 4
    moved = p.withColumns({"x": F.col("x") + F.when(away, F.col("id") * 31 % 25 - 12).otherwise(7), "y": F.col("y") + F.when(away, F.col("id") * 17 % 25 - 12).otherwise(-4)})
    return astrometry.pairs_within(p, moved, 12.0, on=("frame_idx",))


STRAY_SQL = f"""{PT_SQL}, moved AS (SELECT frame_idx, id, x + CASE WHEN id % 5 = 4 THEN id * 31 % 25 - 12 ELSE 7 END AS x, y + CASE WHEN id % 5 = 4 THEN id * 17 % 25 - 12 ELSE -4 END AS y FROM pt),
    pairs AS (SELECT a.frame_idx, a.id AS id_a, b.id AS id_b, b.x - a.x AS ox, b.y - a.y AS oy FROM pt a JOIN moved b ON a.frame_idx = b.frame_idx AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) < 144)"""


def draw_sql(x: str, n: str) -> str:
    """consensus.draw in SQL."""
    y = f"((CAST({x} AS BIGINT) * 1103515245 + 12345) % 2147483648)"
    return f"({y} * {y} % 2147483629 % {n})"


def samples_sql(rows: str, size: int, rounds: int, seed: int) -> str:
    """consensus._samples in SQL: (frame_idx, round, k, row) of a relation with row and n."""
    first, gap = f"(round * {size} + {seed})", f"greatest(1, (n - 1) // {max(1, size - 1)})"
    at, picks = draw_sql(first, "n"), []
    for k in range(size):
        at = at if k == 0 else f"{at} + 1 + {draw_sql(f'({first} + {k})', gap)}"
        picks.append(f"({at}) % n")
    return f"""SELECT frame_idx, round, unnest(range({size})) AS k, unnest([{', '.join(picks)}]) AS row FROM (SELECT DISTINCT frame_idx, n FROM {rows} WHERE n >= {size}), (SELECT unnest(range({rounds})) AS round)"""


register(
    "consensus_shift", lambda s, d: astrometry.ransac_shift(stray_pairs(s, d), rounds=40).select("frame_idx", F.round("dx", DIGITS).alias("dx"), F.round("dy", DIGITS).alias("dy"), "inliers", "success"),
    f"""WITH {STRAY_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY id_a, id_b) - 1 AS row, count(*) OVER (PARTITION BY frame_idx) AS n FROM pairs),
    s AS ({samples_sql("d", 3, 40, 17)}), m AS (SELECT frame_idx, round, avg(ox) AS mx, avg(oy) AS my FROM s JOIN d USING (frame_idx, row) GROUP BY ALL),
    c AS (SELECT frame_idx, round, any_value(n) AS n, count(*) AS inliers, avg(ox) AS dx, avg(oy) AS dy FROM m JOIN d USING (frame_idx) WHERE (ox - mx) * (ox - mx) + (oy - my) * (oy - my) < 2.25 GROUP BY ALL),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY frame_idx ORDER BY NOT (2 * inliers > n OR inliers > 40), CASE WHEN 2 * inliers > n OR inliers > 40 THEN 0 ELSE -inliers END, round) = 1)
    SELECT frame_idx, round(coalesce(dx, 0), {DIGITS}) AS dx, round(coalesce(dy, 0), {DIGITS}) AS dy, CAST(coalesce(inliers, 0) AS INT) AS inliers, coalesce(inliers, 0) >= 5 AS success FROM (SELECT DISTINCT frame_idx FROM pairs) LEFT JOIN b USING (frame_idx)""",
)


def previous_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each frame's search begins: the offset that was accepted before it."""
    pairs = stray_pairs(spark, sf_dir)
    found = consensus.previous_offsets(consensus.candidate_offsets(pairs), pairs.select("frame_idx"), 9.0)
    return found.select("frame_idx", F.round("px", DIGITS).alias("px"), F.round("py", DIGITS).alias("py"))


register("previous_offset", previous_offset, f"""WITH RECURSIVE {STRAY_SQL}, c AS (SELECT frame_idx, avg(ox) AS ox, avg(oy) AS oy, count(*) AS votes FROM pairs, (VALUES (0.0), (0.5)) a(ga), (VALUES (0.0), (0.5)) b(gb)
        GROUP BY frame_idx, ga, gb, floor(ox / 3 + ga), floor(oy / 3 + gb) HAVING count(*) >= 5), f AS (SELECT frame_idx, row_number() OVER (ORDER BY frame_idx) AS k FROM (SELECT DISTINCT frame_idx FROM pairs)),
    fold(k, px, py) AS (SELECT CAST(1 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
        SELECT k + 1, coalesce(b.o, px), coalesce(b.p, py) FROM (SELECT fold.k, any_value(fold.px) AS px, any_value(fold.py) AS py, arg_min(struct_pack(o := c.ox, p := c.oy), struct_pack(a := -c.votes, b := sqrt((c.ox - fold.px) * (c.ox - fold.px) + (c.oy - fold.py) * (c.oy - fold.py)), c := c.ox, d := c.oy)) AS b
            FROM fold JOIN f ON f.k = fold.k LEFT JOIN c ON c.frame_idx = f.frame_idx AND (c.ox - fold.px) * (c.ox - fold.px) + (c.oy - fold.py) * (c.oy - fold.py) < 81 GROUP BY fold.k))
    SELECT f.frame_idx, round(px, {DIGITS}) AS px, round(py, {DIGITS}) AS py FROM fold JOIN f USING (k)""")


def star_pair_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four stars for each two triangles of a point that share their first side, found among all triangles again."""
    known = consensus.turned_once(image_triangles(spark, sf_dir))
    some = known.where("i0 % 20 = 0").withColumn("p", F.array("r0", "r1", "r2"))
    seeds = some.select("i0", "i1", F.col("i2").alias("p2"), "p").join(some.select("i0", "i1", F.col("i2").alias("q2"), F.col("p").alias("q")), ["i0", "i1"]).where("p2 < q2")
    seeds = seeds.select(*[F.col(a).alias(b) for a, b in (("i0", "w0"), ("i1", "w1"), ("p2", "w2"), ("q2", "w3"))], "p", "q").withColumn("seed", F.struct("w0", "w1", "w2", "w3"))
    found = consensus.intersect_triangles(seeds.select("seed", "p", "q"), known, 0.01, unique=True)  # whole places: the sides do not depend on the centre
    return found.select("seed.*", "i0", "i1", "i2", "i3")


_NEAR = "(s.{0}0 - {1}.r0) * (s.{0}0 - {1}.r0) + (s.{0}1 - {1}.r1) * (s.{0}1 - {1}.r1) + (s.{0}2 - {1}.r2) * (s.{0}2 - {1}.r2) <= 0.0001 * (s.{0}0 * s.{0}0 + s.{0}1 * s.{0}1 + s.{0}2 * s.{0}2)"
register("star_pair_intersection", star_pair_intersection, f"""{TRIANGLES_SQL}, k AS (SELECT id0 AS i0, id1 AS i1, id2 AS i2, k0 AS r0, k1 AS r1, 1.0::DOUBLE AS r2 FROM t UNION SELECT id1, id2, id0, k1, 1.0, k0 FROM t UNION SELECT id2, id0, id1, 1.0, k0, k1 FROM t),
    s AS (SELECT p.i0 AS w0, p.i1 AS w1, p.i2 AS w2, q.i2 AS w3, p.r0 AS p0, p.r1 AS p1, p.r2 AS p2, q.r0 AS q0, q.r1 AS q1, q.r2 AS q2 FROM k p JOIN k q ON p.i0 % 20 = 0 AND p.i0 = q.i0 AND p.i1 = q.i1 AND p.i2 < q.i2)
    SELECT DISTINCT s.w0, s.w1, s.w2, s.w3, c.i0, c.i1, c.i2, g.i2 AS i3 FROM s JOIN k c ON abs(s.p0 - c.r0) < 0.02 AND {_NEAR.format('p', 'c')} JOIN k g ON c.i0 = g.i0 AND c.i1 = g.i1 AND c.i2 <> g.i2 AND {_NEAR.format('q', 'g')}""")


def similarity_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A known rotation, scale and shift found back from sums."""
    p = points_pt(spark, sf_dir)
    xb, yb = 0.8 * F.col("x") - 0.6 * F.col("y") + 5, 0.6 * F.col("x") + 0.8 * F.col("y") - 3
    out = astrometry.similarity_fit(p.select("frame_idx", F.col("x").alias("xa"), F.col("y").alias("ya"), xb.alias("xb"), yb.alias("yb")))
    return out.select("frame_idx", "n", *[F.round(c, DIGITS).alias(c) for c in ("a", "b", "dx", "dy")])


register("similarity_fit", similarity_fit, f"WITH {PT_SQL} SELECT frame_idx, count(*) AS n, 0.8::DOUBLE AS a, 0.6::DOUBLE AS b, 5.0::DOUBLE AS dx, -3.0::DOUBLE AS dy FROM pt GROUP BY frame_idx")


def sky_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars near a pointing with image places of a known plate: half a degree a hundred pixels, turned by 30 degrees."""
    xi, eta, c = scalar.gnomonic(F.col("ra"), F.col("dec"), F.lit(120.0), F.lit(30.0))
    p = points_pt(spark, sf_dir).select("frame_idx", "id", "ra", "dec").withColumns({"xi": xi, "eta": eta, "c": c}).where("c > 0.6")
    k, cos, sin = 200.0, math.cos(math.radians(30)), math.sin(math.radians(30))
    return p.withColumns({"x": k * (cos * F.col("xi") + sin * F.col("eta")), "y": k * (-sin * F.col("xi") + cos * F.col("eta"))})


register("plate_orientation", lambda s, d: astrometry.orientation(sky_stars(s, d), 120.0, 30.0).select("frame_idx", "crval1", "crval2", F.round("rotation", 4).alias("rotation"), F.round("pixel_scale", 4).alias("pixel_scale"), "confidence"), f"WITH {PT_SQL} SELECT frame_idx, 120.0::DOUBLE AS crval1, 30.0::DOUBLE AS crval2, 30.0::DOUBLE AS rotation, 18.0::DOUBLE AS pixel_scale, least(1.0, count(*) / 20)::DOUBLE AS confidence FROM pt WHERE {_CD} > 0.6 GROUP BY frame_idx")
register("plate_distortion", lambda s, d: astrometry.distortion(sky_stars(s, d).select("frame_idx", (F.col("x") + 1e-6 * F.col("x") * F.col("x")).alias("u"), F.col("y").alias("v"), "xi", "eta")).select("frame_idx", F.size("a").alias("terms"), (F.round("rms", 1) + F.lit(0.0)).alias("rms")))
def plate_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates of the stars about a pointing, with places a little off, every fifth of them elsewhere."""
    stars = sky_stars(spark, sf_dir).select("frame_idx", F.col("id").alias("star"), "ra", "dec")
    xi, eta, _ = scalar.gnomonic(F.col("ra"), F.col("dec"), F.col("ra0"), F.col("dec0"))
    stars = stars.join(consensus.mean_directions(stars), "frame_idx").withColumns({"xi": xi, "eta": eta})
    off = F.when(F.col("star") % 5 == 2, F.col("star") * 7 % 300 - 150.0).otherwise((F.col("star") * 13 % 7 - 3) * 0.2)
    k, cos, sin = 200.0, math.cos(math.radians(30)), math.sin(math.radians(30))
    stars = stars.withColumns({"x": k * (cos * F.col("xi") + sin * F.col("eta")) + off, "y": k * (-sin * F.col("xi") + cos * F.col("eta")) - off})
    found = consensus.plate_consensus(stars, 0, 0, threshold=3.0, rounds=30)
    return found.select("frame_idx", *[F.round(c, 4).alias(c) for c in ("crval1", "crval2", "rotation")], F.round("pixel_scale", 6).alias("pixel_scale"), "confidence", "inliers")


#: Tangent-plane places (degrees) about a direction, and the direction of a place, in SQL.
_XI = "degrees(cos(radians(dec)) * sin(radians(ra - {0})) / {2})", "degrees((cos(radians({1})) * sin(radians(dec)) - sin(radians({1})) * cos(radians(dec)) * cos(radians(ra - {0}))) / {2})"
_C = "(sin(radians({1})) * sin(radians(dec)) + cos(radians({1})) * cos(radians(dec)) * cos(radians(ra - {0})))"
_OWN = ("ra0", "dec0")
_U = [x.format(*_OWN, _C.format(*_OWN)) for x in _XI]
register("plate_consensus", plate_consensus, f"""WITH {PT_SQL}, st AS (SELECT frame_idx, id, ra, dec, CASE WHEN id % 5 = 2 THEN id * 7 % 300 - 150.0 ELSE (id * 13 % 7 - 3) * 0.2 END::DOUBLE AS o FROM pt WHERE {_CD} > 0.6),
    ce AS (SELECT frame_idx, (degrees(atan2(avg(sin(radians(ra)) * cos(radians(dec))), avg(cos(radians(ra)) * cos(radians(dec))))) + 360) % 360 AS ra0, degrees(atan2(avg(sin(radians(dec))), sqrt(power(avg(cos(radians(ra)) * cos(radians(dec))), 2) + power(avg(sin(radians(ra)) * cos(radians(dec))), 2)))) AS dec0 FROM st GROUP BY frame_idx),
    pl AS (SELECT *, 200 * (cos(radians(30)) * xi + sin(radians(30)) * eta) + o AS u, 200 * (-sin(radians(30)) * xi + cos(radians(30)) * eta) - o AS v FROM (SELECT *, {_U[0]} AS xi, {_U[1]} AS eta, {_C.format(*_OWN)} AS c FROM st JOIN ce USING (frame_idx))),
    d AS (SELECT frame_idx, id, u, v, xi, eta, row_number() OVER (PARTITION BY frame_idx ORDER BY id) - 1 AS row, count(*) OVER (PARTITION BY frame_idx) AS n FROM pl WHERE c > 0),
    s AS ({samples_sql("d", 2, 30, 42)}), w AS (SELECT frame_idx, round, max(u) FILTER (k = 0) AS u0, max(v) FILTER (k = 0) AS v0, max(xi) FILTER (k = 0) AS x0, max(eta) FILTER (k = 0) AS y0, max(u) FILTER (k = 1) AS u1, max(v) FILTER (k = 1) AS v1, max(xi) FILTER (k = 1) AS x1, max(eta) FILTER (k = 1) AS y1 FROM s JOIN d USING (frame_idx, row) GROUP BY ALL),
    ab AS (SELECT *, ((u1 - u0) * (x1 - x0) + (v1 - v0) * (y1 - y0)) / ((u1 - u0) * (u1 - u0) + (v1 - v0) * (v1 - v0)) AS a, ((u1 - u0) * (y1 - y0) - (v1 - v0) * (x1 - x0)) / ((u1 - u0) * (u1 - u0) + (v1 - v0) * (v1 - v0)) AS b FROM w WHERE (u1 - u0) * (u1 - u0) + (v1 - v0) * (v1 - v0) > 1e-10 AND (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) > 1e-12),
    h AS (SELECT d.*, round FROM ab JOIN d USING (frame_idx) WHERE power(xi - (a * u - b * v + (x0 + x1 - a * (u0 + u1) + b * (v0 + v1)) / 2), 2) + power(eta - (b * u + a * v + (y0 + y1 - b * (u0 + u1) - a * (v0 + v1)) / 2), 2) <= 9 * (a * a + b * b)),
    g AS (SELECT frame_idx, round, count(*) AS m, avg(u) AS u, avg(v) AS v, avg(xi) AS xi, avg(eta) AS eta, sum(u * u + v * v) - count(*) * (avg(u) * avg(u) + avg(v) * avg(v)) AS q, sum(u * xi + v * eta) - count(*) * (avg(u) * avg(xi) + avg(v) * avg(eta)) AS p, sum(u * eta - v * xi) - count(*) * (avg(u) * avg(eta) - avg(v) * avg(xi)) AS r
        FROM h GROUP BY frame_idx, round HAVING count(*) >= 3 QUALIFY row_number() OVER (PARTITION BY frame_idx ORDER BY m DESC, round) = 1),
    z AS (SELECT *, p / q AS a, r / q AS b, radians(xi - p / q * u + r / q * v) AS tx, radians(eta - r / q * u - p / q * v) AS ty FROM g JOIN ce USING (frame_idx))
    SELECT frame_idx, round((ra0 + degrees(atan2(tx, cos(radians(dec0)) - ty * sin(radians(dec0)))) + 360) % 360, 4) AS crval1, round(degrees(atan2(sin(radians(dec0)) + ty * cos(radians(dec0)), sqrt(tx * tx + power(cos(radians(dec0)) - ty * sin(radians(dec0)), 2)))), 4) AS crval2,
        round((degrees(atan2(b, a)) + 360) % 360, 4) AS rotation, round(sqrt(a * a + b * b), 6) AS pixel_scale, least(1.0, m / 20)::DOUBLE AS confidence, m AS inliers FROM z""")
register("point_extraction", lambda s, d: planes.label_planes(raster_li(s, d), 32, 32, quantile=0.75).select("frame_idx", "plane_idx", "point", F.round("x", DIGITS).alias("x"), F.round("y", DIGITS).alias("y"), F.round("brightness", DIGITS).alias("brightness"), "area"), f"""WITH RECURSIVE {LI_SQL}, q AS (SELECT frame_idx, plane_idx, quantile_cont(v, 0.75) AS q FROM li GROUP BY ALL),
    m AS (SELECT frame_idx, plane_idx, y, x, v, y * 32 + x AS k FROM li JOIN q USING (frame_idx, plane_idx) WHERE v > q),
    e AS (SELECT a.frame_idx, a.plane_idx, a.k AS a, b.k AS b FROM m a JOIN m b ON a.frame_idx = b.frame_idx AND a.plane_idx = b.plane_idx AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
    reach(frame_idx, plane_idx, a, b) AS (SELECT frame_idx, plane_idx, k, k FROM m UNION SELECT r.frame_idx, r.plane_idx, r.a, e.b FROM reach r JOIN e ON e.frame_idx = r.frame_idx AND e.plane_idx = r.plane_idx AND e.a = r.b),
    label AS (SELECT frame_idx, plane_idx, a AS k, min(b) AS label FROM reach GROUP BY ALL),
    g AS (SELECT frame_idx, plane_idx, label, count(*) AS area, sum(v) AS brightness, sum(v * x) / sum(v) AS cx, sum(v * y) / sum(v) AS cy, var_pop(x) + 1 / 12 AS sxx, var_pop(y) + 1 / 12 AS syy, covar_pop(x, y) AS sxy FROM m JOIN label USING (frame_idx, plane_idx, k) GROUP BY ALL),
    h AS (SELECT *, (sxx + syy) / 2 AS mid, sqrt((sxx - syy) * (sxx - syy) / 4 + sxy * sxy) AS off FROM g WHERE area BETWEEN pi() AND pi() * 64)
    SELECT frame_idx, plane_idx, CAST(row_number() OVER (PARTITION BY frame_idx, plane_idx ORDER BY cx * cx + cy * cy, label) - 1 AS INT) AS point, round(cx, {DIGITS}) AS x, round(cy, {DIGITS}) AS y, brightness, CAST(area AS INT) AS area FROM h WHERE sqrt((mid + off) / (mid - off)) <= 2.000000002""")


def phase_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame's first plane, rolled by its number, against itself."""
    base = raster_li(spark, sf_dir).where("plane_idx = 0").select("frame_idx", "y", "x", "v")
    rolled = base.select("frame_idx", F.pmod(F.col("y") + F.col("frame_idx"), F.lit(32)).alias("y"), F.pmod(F.col("x") + 2 * F.col("frame_idx"), F.lit(32)).alias("x"), "v")
    return planes.phase_shift(rolled, base, 32, 32).select("frame_idx", F.round("dx").alias("dx"), F.round("dy").alias("dy"))


register("phase_shift", phase_shift, li("SELECT DISTINCT frame_idx, CAST(2 * frame_idx AS DOUBLE) AS dx, CAST(frame_idx AS DOUBLE) AS dy FROM li WHERE plane_idx = 0"))


def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, by the place of the reference's centre; frames are moved without wrapping."""
    base = raster_li(spark, sf_dir).where("plane_idx = 0").select("frame_idx", "y", "x", "v")
    moved = base.select("frame_idx", (F.col("y") + F.col("frame_idx")).alias("y"), (F.col("x") - F.col("frame_idx")).alias("x"), "v").where("y < 32 and x >= 0")
    return planes.template_match(moved, base, 32, 32).select("frame_idx", "dx", "dy", "success")


DISK3 = "(SELECT CAST(a AS INT) AS dy, CAST(b AS INT) AS dx FROM (SELECT unnest(range(-3, 4)) AS a), (SELECT unnest(range(-3, 4)) AS b) WHERE a * a + b * b <= 9)"
for _name, _fn, _sql in (("dilate_disk", morphology.dilate, "max"), ("erode_disk", morphology.erode, "min")):
    register(_name, lambda s, d, f=_fn: pixels_out(f(raster_li(s, d), 3, 32, 32, tile=16)), li(f"""SELECT frame_idx, plane_idx, y + dy AS y, x + dx AS x, round(CAST({_sql}(v) AS DOUBLE), {DIGITS}) + 0.0 AS v
        FROM li, {DISK3} WHERE y + dy BETWEEN 0 AND 31 AND x + dx BETWEEN 0 AND 31 GROUP BY ALL"""))
register("star_planes", lambda s, d: pixels_out(morphology.star_planes(raster_li(s, d).withColumn("v", F.col("v") % 256), 32, 32, reach=6, tile=16)), li(f"""
    , b AS (SELECT c.frame_idx, c.plane_idx, c.y, c.x, round_even(sum((2 - abs(n.y - c.y)) * (2 - abs(n.x - c.x)) * (n.v % 256)) / sum((2 - abs(n.y - c.y)) * (2 - abs(n.x - c.x))), 0) AS v
            FROM li c JOIN li n ON c.frame_idx = n.frame_idx AND c.plane_idx = n.plane_idx AND n.y BETWEEN c.y - 1 AND c.y + 1 AND n.x BETWEEN c.x - 1 AND c.x + 1 GROUP BY ALL)
    SELECT c.frame_idx, c.plane_idx, c.y, c.x, round(greatest(any_value(c.v) - quantile_disc(n.v, 0.5), 0.0), {DIGITS}) + 0.0 AS v
    FROM b c JOIN b n ON c.frame_idx = n.frame_idx AND c.plane_idx = n.plane_idx AND n.y BETWEEN c.y - 6 AND c.y + 6 AND n.x BETWEEN c.x - 6 AND c.x + 6 GROUP BY ALL"""))
register("template_match", template_match, li("SELECT DISTINCT frame_idx, CAST(-frame_idx AS DOUBLE) AS dx, CAST(frame_idx AS DOUBLE) AS dy, true AS success FROM li WHERE plane_idx = 0"))

# --- macros ------------------------------------------------------------------------------------------------------
from . import macros  # noqa: E402

register("lrgb_combination", lambda s, d: pixels_out(macros.lrgb_combination(raster_em(s, d), raster_em(s, d))), planes_sql("em", EM_SQL, *[f"p0 {e}" for e in ("+ (p0 - p1) / 2 + (p0 + p1 - 2 * p2) / 6", "- (p0 - p1) / 2 + (p0 + p1 - 2 * p2) / 6", "- 2 * (p0 + p1 - 2 * p2) / 6")]))
register("chroma_denoise", lambda s, d: pixels_out(macros.chroma_denoise(raster_em(s, d), 8, 8)))
DISK = "(SELECT CAST(a AS INT) AS dy, CAST(b AS INT) AS dx FROM (SELECT unnest(range(-25, 26)) AS a), (SELECT unnest(range(-25, 26)) AS b) WHERE a * a + b * b <= 625)"
for _space in ("Lab", "YUV", "HSV"):
    register(f"colour_denoise_{_space.lower()}", lambda s, d, n=_space: pixels_out(macros.colour_denoise(raster_em(s, d), 8, 8, n, 0.5, 0.2)))
register("median_disk", lambda s, d: pixels_out(macros.median_filter(raster_li(s, d), 32, 32)), windows_sql(0.5, DISK))
register("star_mask", lambda s, d: pixels_out(macros.star_mask(raster_li(s, d), 32, 32)), f"""WITH {LI_SQL}, m AS ({windows_sql(0.5, DISK).replace(f"WITH {LI_SQL}", "")}), b AS ({kernel_sql(neighbourhood.BLUR).replace(f"round(coalesce(sum(p.v * k.k), 0), {DIGITS}) + 0.0", "coalesce(sum(p.v * k.k), 0)")}),
    d AS (SELECT b.frame_idx, b.plane_idx, b.y, b.x, b.v - m.v AS v FROM b JOIN m USING (frame_idx, plane_idx, y, x)), t AS (SELECT frame_idx, plane_idx, quantile_cont(v, 0.95) AS t FROM d WHERE v > 0 GROUP BY ALL)
    SELECT {KEYS}, CASE WHEN v > t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM d LEFT JOIN t USING (frame_idx, plane_idx)""")
register("dwt_two_levels_round_trip", lambda s, d: pixels_out(neighbourhood.idwt_levels(neighbourhood.dwt_levels(raster_em(s, d), 8, 8, 2), 8, 8)), em(f"SELECT {KEYS}, round(v, {DIGITS}) + 0.0 AS v FROM em"))
register("wavelet_soft_threshold", lambda s, d: pixels_out(macros.wavelet_denoise(raster_em(s, d), 8, 8, 0.05)))


def pixel_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames shifted by their number and averaged."""
    pixels = raster_li(spark, sf_dir)
    params = pixels.select("frame_idx").distinct().select("frame_idx", F.col("frame_idx").alias("dx"), F.lit(0).alias("dy"), F.lit(0.0).alias("rotation"), F.lit(1.0).alias("scale"))
    return pixels_out(macros.pixel_complete(pixels, params, 32, 32, 38, 32))


register("pixel_complete", pixel_complete, li(f"SELECT 0 AS frame_idx, plane_idx, y, x + frame_idx AS x, round(avg(v), {DIGITS}) AS v FROM li GROUP BY ALL").replace("SELECT 0 AS frame_idx, plane_idx, y, x + frame_idx AS x, round(avg(v), 6) AS v FROM li GROUP BY ALL", "SELECT 0 AS frame_idx, plane_idx, y, tx AS x, round(avg(v), 6) AS v FROM (SELECT plane_idx, y, x + frame_idx AS tx, v FROM li) GROUP BY plane_idx, y, tx"))
