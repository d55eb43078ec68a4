"""The semantic contract, and round trips of the operators, on small arrays."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.functions import scalar
from rasterloom.model import KEY, Stream, concatenated, multiply_polynomials, ordered
from rasterloom.operators import astrometry, colour, fit, geometry, neighbourhood, pixelwise, planes
from rasterloom.plans import flow as flows
from rasterloom.plans import macros
from rasterloom.sources import csvplanes, images
from rasterloom.streaming import stacking


def raster(spark, a, frame=0, plane=0):
    rows = [(frame, plane, y, x, None if a[y][x] is None else float(a[y][x])) for y in range(len(a)) for x in range(len(a[0]))]
    return spark.createDataFrame(rows, "frame_idx int, plane_idx int, y int, x int, v double")


def array(df, height, width, c="v"):
    a = np.full((height, width), np.nan)
    for r in df.collect():
        a[r["y"], r["x"]] = np.nan if r[c] is None else r[c]
    return a


@pytest.mark.parametrize(("name", "want"), [("inverse", [0.5, None, -1.0, None]), ("natural_logarithm", [math.log(2), -math.inf, None, None]), ("fill_0", [0.0, 0.0, 0.0, None]), ("sign", [1.0, 0.0, -1.0, None])])
def test_unary_invalid_values(spark, name, want):
    got = [r.v for r in pixelwise.unary(raster(spark, [[2, 0, -1, None]]), name).orderBy("x").collect()]
    assert got == want


def test_pixelwise_extremes_propagate_and_stacks_skip(spark):
    a, b = raster(spark, [[1, None]]), raster(spark, [[3, 4]], 1)
    pair = pixelwise.binary([Stream(a), Stream(b.withColumn("frame_idx", F.lit(0)))], "max")
    assert [r.v for r in pair.pixels.orderBy("x").collect()] == [3.0, None]
    both = a.union(b)
    assert [r.v for r in pixelwise.stack(both, "maximum").orderBy("x").collect()] == [3.0, 4.0]
    assert [r.v for r in pixelwise.stack(raster(spark, [[None, None]]), "count").collect()] == [0.0, 0.0]
    assert [r.v for r in pixelwise.stack(raster(spark, [[None]]), "sum").collect()] == [None]


def test_passes_are_not_strict_and_keep_on_invalid_bounds(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, None)], "a double, b double")
    got = df.select(scalar.BINARY["upper_pass"](F.col("a"), F.col("b")).alias("u"), scalar.BINARY["lower_pass"](F.col("a"), F.col("b")).alias("l")).collect()
    assert [tuple(r) for r in got] == [(None, 1.0), (2.0, 2.0), (3.0, 3.0)]


def test_operand_order_and_lengths(spark):
    a = Stream(raster(spark, [[1]]), length=2, category="auxiliary")
    b = Stream(raster(spark, [[1]]), length=3)
    assert ordered([a, b])[0] is b
    with pytest.raises(ValueError):
        pixelwise.binary([a, b], "offset")


def test_polynomials_combine():
    assert multiply_polynomials(((1.0, 1.0),), ((1.0, -1.0),)) == ((1.0, 0.0, -1.0),)
    s = pixelwise.binary([Stream(type="polynomial", coefficients=((1.0,),)), Stream(type="polynomial", coefficients=((0.0, 2.0),))], "offset")
    assert s.coefficients == ((1.0, 2.0),)


def test_concatenation_renumbers(spark):
    out = concatenated([raster(spark, [[1]]), raster(spark, [[2]])], [1, 1])
    assert sorted((r.frame_idx, r.v) for r in out.collect()) == [(0, 1.0), (1, 2.0)]


def test_sigma_clip_keeps_equal_and_single_values(spark):
    one = raster(spark, [[5]])
    assert pixelwise.sigma_clip(one).first().v == 5.0
    many = one
    for k in range(1, 9):
        many = many.union(raster(spark, [[5 if k < 8 else 100]], k))
    assert sorted((r.v is None, r.v or 0) for r in pixelwise.sigma_clip(many).collect())[-1] == (True, 0)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.integers(-9, 9), min_size=5, max_size=5), min_size=4, max_size=4))
def test_layout_round_trips(spark, a):
    p = raster(spark, a)
    want = np.array(a, float)
    assert (array(colour.transpose(colour.transpose(p)), 4, 5) == want).all()
    q = p
    for k in range(4):
        q = geometry.reposition(q, *((5, 4) if k % 2 == 0 else (4, 5)), rot90=1)
    assert (array(q, 4, 5) == want).all()
    assert (array(geometry.reposition(p, 5, 4, flip_x=True, shift_y=1), 4, 5) == np.roll(want[:, ::-1], 1, axis=0)).all()
    assert (array(geometry.reposition(p, 5, 4, rot90=1), 5, 4) == np.rot90(want, -1)).all()


def test_transform_identity_shift_and_quarter_turn(spark):
    a = np.arange(16.0).reshape(4, 4)
    p = raster(spark, a.tolist())
    params = lambda dx, dy, r, s: spark.createDataFrame([(0, float(dx), float(dy), float(r), float(s))], "frame_idx int, dx double, dy double, rotation double, scale double")
    assert (array(geometry.transform(p, params(0, 0, 0, 1), 4, 4, 4, 4), 4, 4) == a).all()
    moved = array(geometry.transform(p, params(1, 0, 0, 1), 4, 4, 5, 4), 4, 5)
    assert np.isnan(moved[:, 0]).all() and (moved[:, 1:] == a).all()
    half = array(geometry.transform(p, params(0.5, 0, 0, 1), 4, 4, 4, 4), 4, 4)
    assert np.allclose(half[:, 1:], (a[:, 1:] + a[:, :-1]) / 2)
    assert geometry.canvas([(0, 0, 0, 1), (3, -2, 0, 1)], 10, 10) == (0, 2, 13, 12)


def test_convolution_matches_numpy_and_spectra(spark):
    rng = np.random.default_rng(1)
    a, k = rng.integers(-5, 5, (7, 9)).astype(float), [[1.0, 2.0, 0.0], [0.0, -1.0, 3.0]]
    want = np.zeros_like(a)
    for y in range(7):
        for x in range(9):
            for i in range(2):
                for j in range(3):
                    u, v = y - (i - 1), x - (j - 1)
                    if 0 <= u < 7 and 0 <= v < 9:
                        want[y, x] += k[i][j] * a[u, v]
    p = raster(spark, a.tolist())
    assert np.allclose(array(neighbourhood.convolve(p, k, 9, 7), 7, 9), want)
    assert np.allclose(array(planes.fft_convolve(p, k, 9, 7), 7, 9), want)


def test_transforms_invert(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(8, 12))
    p = raster(spark, a.tolist())
    assert np.allclose(array(planes.ifft(planes.fft(p, 12, 8), 12, 8), 8, 12, "re"), a)
    assert np.allclose(array(neighbourhood.idwt(neighbourhood.dwt(p, 12, 8), 12, 8), 8, 12), a)
    assert np.allclose(array(planes.wavelet_denoise(p, 12, 8, 0.0, neighbourhood.DB2), 8, 12), a)


@pytest.mark.parametrize(("height", "width", "levels"), [(9, 13, 1), (18, 11, 1), (33, 35, 2), (34, 33, 1)])
def test_wavelet_denoise_of_any_extent(spark, height, width, levels):
    """Against plain sums over the half-sample symmetric extension."""
    sigma, size = 0.2, 4
    bank = neighbourhood.filter_bank(neighbourhood.DB2)

    def analysis(n):  # rows of coefficients, columns of samples
        at = lambda i: i % (2 * n) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n)
        made = []
        for f in ("dec_lo", "dec_hi"):
            m = np.zeros(((n + size - 1) // 2, n))
            for i in range(len(m)):
                for t in range(size):
                    m[i, at(2 * i + 1 - t)] += bank[f][t]
            made.append(m)
        return made

    def synthesis(n):
        return [np.array([[bank[f][k + size - 2 - 2 * i] if 0 <= k + size - 2 - 2 * i < size else 0 for i in range((n + size - 1) // 2)] for k in range(n)]) for f in ("rec_lo", "rec_hi")]

    def denoise(a, depth):
        if not depth:
            return a
        (ly, hy), (lx, hx) = analysis(a.shape[0]), analysis(a.shape[1])
        (sy, ty), (sx, tx) = synthesis(a.shape[0]), synthesis(a.shape[1])
        limit = sigma * np.sqrt(2 * np.log(len(ly) * len(lx)))
        soft = lambda c: np.sign(c) * np.maximum(np.abs(c) - limit, 0)
        return sy @ denoise(ly @ a @ lx.T, depth - 1) @ sx.T + sy @ soft(ly @ a @ hx.T) @ tx.T + ty @ soft(hy @ a @ lx.T) @ sx.T + ty @ soft(hy @ a @ hx.T) @ tx.T

    a = np.random.default_rng(height).normal(size=(height, width))
    rows = a.tolist()
    rows[3][4] = None
    a[3, 4] = 0
    got = array(planes.wavelet_denoise(raster(spark, rows), width, height, sigma, neighbourhood.DB2, levels), height, width)
    assert np.isnan(got[3, 4]) and np.isnan(got).sum() == 1
    want = denoise(a, levels)
    want[3, 4] = got[3, 4]
    assert np.allclose(got, want, equal_nan=True) and not np.allclose(got, a, atol=0.1, equal_nan=True)


def test_colour_inverse_and_bayer(spark):
    p = raster(spark, [[1, 2]]).union(raster(spark, [[3, 5]], plane=1)).union(raster(spark, [[7, 4]], plane=2))
    back = colour.to_rgb(colour.to_lab(p))
    assert {(r.plane_idx, r.x): round(r.v, 9) for r in back.collect()} == {(r.plane_idx, r.x): r.v for r in p.collect()}
    dense = colour.bayer_dense(raster(spark, [[1, 2, 3], [4, 5, 6], [7, 8, 9]]))
    assert sorted((r.plane_idx, r.y, r.x, r.v) for r in dense.collect())[:4] == [(0, 0, 0, 1.0), (0, 0, 1, 3.0), (0, 1, 0, 7.0), (0, 1, 1, 9.0)]


@pytest.mark.parametrize("condition", ["natural", "clamped", "not-a-knot"])
def test_tone_curve_passes_its_points(spark, condition):
    pts = [(0.0, 0.0), (0.3, 0.5), (0.6, 0.4), (1.0, 1.0)]
    df = spark.createDataFrame([(p[0],) for p in pts] + [(-1.0,), (2.0,), (None,)], "v double")
    got = [r[0] for r in df.select(colour.tone_curve(F.col("v"), pts, condition)).collect()]
    assert np.allclose(got[:4], [p[1] for p in pts]) and got[4:] == [0.0, 1.0, None]


def test_matrix_inverse_and_singular(spark):
    a = [[2.0, 1.0], [1.0, 3.0]]
    inv = planes.inverse_matrix(raster(spark, a), 2, 2)
    assert np.allclose(array(planes.matrix_product(raster(spark, a), inv), 2, 2), np.eye(2))
    assert np.isnan(array(planes.inverse_matrix(raster(spark, [[1, 1], [1, 1]]), 2, 2), 2, 2)).all()
    with pytest.raises(ValueError):
        planes.inverse_matrix(raster(spark, [[1, 1]]), 2, 1)


def test_quadratic_fit_recovers_a_surface(spark):
    a = [[1 + 2 * x - y + 0.5 * x * x - 0.25 * x * y + 0.125 * y * y for x in range(6)] for y in range(5)]
    assert np.allclose(fit.quadratic_fit(raster(spark, a)).first().c, [1, 2, -1, 0.5, -0.25, 0.125])
    assert np.allclose(array(fit.subtract_background(raster(spark, a)), 5, 6), 0, atol=1e-8)


def test_points_touching_diagonally_are_one(spark):
    a = [[0.0] * 12 for _ in range(12)]
    for y, x in ((3, 3), (4, 4), (3, 4), (4, 3), (5, 5)):
        a[y][x] = 10.0
    a[0][11] = None
    rows = planes.label_planes(raster(spark, a), 12, 12, aspect=3.0).collect()
    assert len(rows) == 1 and rows[0].area == 5 and rows[0].brightness == 50.0


def test_registration_finds_a_shift(spark):
    rng = np.random.default_rng(3)
    ref = [(i, *map(float, rng.uniform(0, 500, 2))) for i in range(60)]
    pts = spark.createDataFrame([(0, i, x + 12.5, y - 7.25) for i, x, y in ref], "frame_idx int, id long, x double, y double")
    reference = spark.createDataFrame(ref, "id long, x double, y double")
    frames = spark.createDataFrame([(0, 1.5), (1, 2.5)], "frame_idx int, seconds double")
    r, none = astrometry.detect_shifts(pts, reference, frames, 20.0).orderBy("frame_idx").collect()
    assert abs(r.dx + 12.5) < 0.1 and abs(r.dy - 7.25) < 0.1 and abs(r.rotation) < 0.01 and r.confidence == 1.0 and r.time == 1.5
    assert none.dx is None and none.confidence == 0.0


def test_stars_are_identified(spark):
    rng = np.random.default_rng(6)
    stars = spark.createDataFrame([(k, float(ra), float(dec), float(m)) for k, (ra, dec, m) in enumerate(zip(100 + rng.uniform(-2, 2, 30), rng.uniform(-2, 2, 30), rng.uniform(2, 7, 30), strict=True))], "id long, ra double, dec double, mag double")
    xi, eta, _ = scalar.gnomonic(F.col("ra"), F.col("dec"), F.lit(100.0), F.lit(0.0))
    turn = math.radians(25)
    points = stars.withColumns({"xi": xi, "eta": eta}).select((F.col("id") + 1000).alias("id"), (300 * (math.cos(turn) * F.col("xi") - math.sin(turn) * F.col("eta"))).alias("x"), (300 * (math.sin(turn) * F.col("xi") + math.cos(turn) * F.col("eta"))).alias("y"), (-F.col("mag")).alias("brightness"))
    known = astrometry.catalog_triangles(stars, 2.0, count=12)
    rows = astrometry.identify_stars(points, stars, known, 600.0, 0.002).collect()
    right = sum(r.star == r.id + 1000 for r in rows)
    assert right >= 20 and right >= 0.8 * len(rows)


def test_triangle_keys_ignore_scale_and_turn(spark):
    def key(scale, turn):
        c, s = scale * math.cos(turn), scale * math.sin(turn)
        rows = [(0, k, c * x - s * y, s * x + c * y) for k, (x, y) in enumerate([(3.0, 1.0), (-1.0, 2.0)], 1)]
        return astrometry.triangles(spark.createDataFrame(rows, "id long, other long, xi double, eta double")).first()

    a, b = key(1, 0), key(2.5, 1.1)
    assert (a.id0, a.id1, a.id2) == (b.id0, b.id1, b.id2) and abs(a.k0 - b.k0) < 1e-12 and abs(a.k1 - b.k1) < 1e-12


def test_lookup_falls_back(spark):
    frames = spark.createDataFrame([("a",), ("b",)], "image_id string")
    table = spark.createDataFrame([("a", 1.0), ("", 9.0)], "line string, dx double")
    assert [r.dx for r in geometry.lookup(frames, table).orderBy("image_id").collect()] == [1.0, 9.0]
    assert [r.dx for r in geometry.lookup(frames, table.where("line = 'a'")).collect()] == [1.0, 1.0]


def test_csv_round_trip(spark, tmp_path):
    text = "# R\nimg,a,b\nr0,1,x\nr1,3,4\n# G\nimg,a,b\nr0,5,6\nr1,7,8\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.csv").write_text(text)
    got = csvplanes.read_csv(spark, str(tmp_path / "in"))
    assert sorted((r.plane_idx, r.y, r.x, r.v) for r in got.collect() if r.v is not None)[0] == (0, 0, 0, 1.0)
    assert got.where("v is null").count() == 1
    rows = [r.row for r in csvplanes.csv_rows(got, kind="img").orderBy("plane_idx", "y", "part").collect()]
    assert rows == ["# R", "img,a,b", "r0,1.0,", "r1,3.0,4.0", "# G", "img,a,b", "r0,5.0,6.0", "r1,7.0,8.0"]


def test_catalog_drops_bad_rows(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("# stars\nHIP\tRArad\tDErad\tHpmag\n2\t1.5\t2\t3\n1\t0\t0\tbad\n")
    assert [tuple(r) for r in csvplanes.read_catalog(spark, str(tmp_path / "c.tsv")).collect()] == [(2, 1.5, 2.0, 3.0)]


@pytest.mark.parametrize("depth", [8, 16])
def test_png_round_trip(spark, tmp_path, depth):
    a = np.random.default_rng(4).integers(0, 1 << depth, (3, 5, 7))
    (tmp_path / "a.png").write_bytes(images.write_png(a, depth))
    got = images.read_png(spark, str(tmp_path / "a.png"))
    assert (array(got.where("plane_idx = 1"), 5, 7) == a[1]).all()


def test_fits_reader(spark, tmp_path):
    card = lambda k, v: f"{k:<8}= {v:>20}".ljust(80)
    head = "".join([card("SIMPLE", "T"), card("BITPIX", 16), card("NAXIS", 2), card("NAXIS1", 3), card("NAXIS2", 2), card("BZERO", 10), card("BAYERPAT", "'RGGB'"), "END".ljust(80)]).ljust(2880)
    data = np.arange(6, dtype=">i2").tobytes().ljust(2880, b"\0")
    (tmp_path / "a.fits").write_bytes(head.encode() + data)
    assert (array(images.read_fits(spark, str(tmp_path / "a.fits")), 2, 3) == np.arange(6).reshape(2, 3) + 10).all()
    h = images.read_fits_headers(spark, str(tmp_path / "a.fits")).first()
    assert (h.mode, h.bayer_pattern, h.width, h.height, h.planes, h.header["BZERO"]) == ("BAYER", "RGGB", 3, 2, 1, "10")
    flow = graph(("fits_reader", {"path": str(tmp_path)}, [1]), ("negate", {}, []))
    assert flow.run(1).width == 3 and values(flow.run(1).pixels)[0, 0, 1, 2] == -15.0


def test_encoded_frames_and_headers(spark):
    r = images.encode_frames(raster(spark, [[0.0, 1.0], [None, 2.0]]), 2, 2, 0.0, 1.0).first()
    assert images.png_pixels(bytes(r.file))[0].tolist() == [[0, 255], [0, 255]] and r.size == len(r.file)
    frames = spark.createDataFrame([({"DATE-OBS": "2024-01-02T03:04:05", "EXPTIME": "1.5"},)], "exif map<string,string>")
    h = images.normalise_headers(frames).first()
    assert h.exposure_time == 1.5 and str(h.datetime) == "2024-01-02 03:04:05"
    frames = spark.createDataFrame([({"SensitivityType": "2", "RecommendedExposureIndex": "800", "ISOSpeed": "100", "DateTimeDigitized": "2024:01:02 03:04:05", "SubSecTimeDigitized": "25"},), ({"PhotographicSensitivity": "400", "ISOSpeed": "1"},)], "exif map<string,string>")
    first, second = images.normalise_headers(frames).collect()
    assert (first.iso_speed, second.iso_speed, str(first.datetime), second.datetime) == (800.0, 400.0, "2024-01-02 03:04:05.250000", None)


def test_predicted_rows_match_a_plain_filter():
    rng = np.random.default_rng(2)
    line, up = rng.integers(0, 256, 60).astype(np.uint8).tobytes(), rng.integers(0, 256, 60).astype(np.uint8).tobytes()
    for kind, step in ((3, 3), (4, 1), (4, 4)):
        row = []
        for i in range(60):
            left, corner = (row[i - step], up[i - step]) if i >= step else (0, 0)
            p = left + up[i] - corner
            guess = (left + up[i]) // 2 if kind == 3 else min((left, up[i], corner), key=lambda c: abs(p - c))
            row.append((line[i] + guess) & 255)
        assert list(images._predicted(kind, line, up, step)) == row


AVERAGE = {"nodes": [{"index": 0, "type": "pass", "connections": [1, 2]}, {"index": 1, "type": "count", "connections": [3]}, {"index": 2, "type": "sum", "connections": [4]}, {"index": 3, "type": "inverse", "connections": [4]}, {"index": 4, "type": "scale", "connections": []}]}


def test_flow_files_of_three_generations(spark):
    first = {"nodes": [{"id": n["index"], "type": n["type"]} for n in AVERAGE["nodes"]], "connections": [{"from": n["index"], "to": t} for n in AVERAGE["nodes"] for t in n["connections"]]}
    pixels = raster(spark, [[1, 2]]).union(raster(spark, [[3, None]], 1))
    for data in ({"version": "1", **AVERAGE}, first):
        flow = flows.load(json.dumps(data))
        flow.validate()
        got = flow.run(4, n0=Stream(pixels, 2, 1, 2, 1))
        want = macros.average(pixels)
        assert [r.v for r in got.pixels.orderBy("x").collect()] == [r.v for r in want.orderBy("x").collect()]
        assert flows.load(flows.dump(flow)).nodes.keys() == flow.nodes.keys()
    old = flows.load(json.dumps({"nodes": [{"index": 0, "type": "coefficients", "planeCount": 1, "planeNames": ["L"], "connections": []}]}))
    assert old.nodes[0].params["planes"] == ["L"]


def test_flow_rejects_cycles_and_reuses_results(spark):
    with pytest.raises(ValueError):
        flows.load(json.dumps({"nodes": [{"index": 0, "type": "pass", "connections": [1]}, {"index": 1, "type": "pass", "connections": [0]}]}))
    flow = flows.Flow()
    source = flow.add("reader")
    node = flow.add("negate", source)
    s = Stream(raster(spark, [[1]]))
    assert flow.run(node, n0=s) is flow.run(node, n0=s)


def noise(spark, frames=1, planes=1, width=12, height=10, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(f, p, y, x, float(rng.normal())) for f in range(frames) for p in range(planes) for y in range(height) for x in range(width)]
    return spark.createDataFrame(rows, "frame_idx int, plane_idx int, y int, x int, v double"), frames, planes, width, height


def values(pixels):
    return {tuple(r[k] for k in KEY): r["v"] for r in pixels.collect()}


def close(a, b):
    a, b = values(a), values(b)
    return a.keys() == b.keys() and all((x is None) == (b[k] is None) and (x is None or abs(x - b[k]) < 1e-9) for k, x in a.items())


def graph(*nodes):
    """A flow from (type, parameters, connections)."""
    return flows.load(json.dumps({"version": "1", "nodes": [{"index": k, "type": kind, **params, "connections": to} for k, (kind, params, to) in enumerate(nodes)]}))


def kernel_table(rows, **more):
    return {"category": "auxiliary", "planes": ["Plane 0"], "columns": [str(k) for k in range(len(rows[0]))], "lines": [str(k) for k in range(len(rows))], "table": {f"0,{x},{y}": v for y, row in enumerate(rows) for x, v in enumerate(row) if v}, **more}


def test_flow_of_a_table_kernel_and_of_one_for_each_plane(spark):
    pixels, frames, count, w, h = noise(spark, 2, 3)
    flow = graph(("pass", {}, [2]), ("table", kernel_table(neighbourhood.BLUR), [2]), ("convolution", {}, []))
    flow.validate()
    assert close(flow.run(2, n0=Stream(pixels, frames, count, w, h)).pixels, macros.blur(pixels, w, h))
    table = kernel_table(neighbourhood.BLUR)
    table |= {"planes": ["L", "a", "b"], "table": {"0,1,1": 1.0} | {k.replace("0,", f"{p},", 1): v for p in (1, 2) for k, v in table["table"].items()}}
    flow = graph(("lab_converter", {}, [2]), ("table", table, [2]), ("convolution", {}, [3]), ("rgb_converter", {}, []))
    flow.nodes[0].inputs = [9]
    flow.nodes[9] = flows.Node(9, "pass")
    assert close(flow.run(3, n9=Stream(pixels, frames, count, w, h)).pixels, macros.chroma_denoise(pixels, w, h))


def test_flow_of_a_median_over_a_disk(spark):
    """A disk cut from a table by a polynomial, its sign and a threshold, as the kernel of a quantile filter."""
    pixels, frames, count, w, h = noise(spark)
    disk = {"planes": ["quantile 0.5"], "columns": 5, "lines": 5, "table": 0}
    inside = {"category": "auxiliary", "xOrder": 2, "yOrder": 2, "coefficients": {"0,0,0": -3.5, "0,1,0": 4.0, "0,2,0": -1.0, "0,0,1": 4.0, "0,0,2": -1.0}}
    flow = graph(("table", disk, [2]), ("coefficients", inside, [2]), ("offset", {}, [3]), ("sign", {}, [5]), ("coefficients", {"category": "auxiliary", "coefficients": {"0,0,0": 0.1}}, [5]), ("upper_pass", {}, [6]), ("pass", {"category": "auxiliary"}, [8]), ("pass", {}, [8]), ("quantile_filter", {}, []))
    assert close(flow.run(8, n7=Stream(pixels, frames, count, w, h)).pixels, macros.median_filter(pixels, w, h, 2))


def test_flow_of_spectra(spark):
    """Convolution and Wiener filter by spectra of repositioned planes."""
    pixels, frames, count, w, h = noise(spark, 2)
    size = lambda a, b, **more: {"category": "auxiliary", "columns": [*more, "width", "height"], "lines": ["1"], "table": {f"0,{k},0": float(v) for k, v in enumerate((*more.values(), a, b))}}
    kernel = ("table", kernel_table(neighbourhood.BLUR), [2])
    flow = graph(("pass", {}, [4]), kernel, ("reposition", {}, [6]), ("table", size(16, 15), [4]), ("reposition", {}, [7]), ("table", size(16, 15, shift_x=-1, shift_y=-1), [2]), ("fft", {"category": "auxiliary"}, [8]), ("fft", {}, [8]), ("scale", {}, [9]), ("ifft", {}, [11]), ("table", size(w, h), [11]), ("reposition", {}, []))
    got = flow.run(11, n0=Stream(pixels, frames, count, w, h)).pixels
    assert close(got.select(*KEY, F.col("re").alias("v")), macros.blur(pixels, w, h)) and got.where("abs(im) > 1e-9").count() == 0
    wiener = graph(("pass", {}, [1]), ("fft", {"category": "auxiliary"}, [2, 4]), ("squared_norm", {"category": "auxiliary"}, [3]), ("offset", {"category": "auxiliary"}, [5]), ("conjugate", {"category": "auxiliary"}, [6]), ("inverse", {"category": "auxiliary"}, [6]), ("scale", {"category": "auxiliary"}, [7]), ("scale", {}, []), ("coefficients", {"category": "auxiliary", "coefficients": {"0,0,0": 0.01}}, [3]))
    wiener.nodes[7].inputs.append(9)
    wiener.nodes[9] = flows.Node(9, "fft", inputs=[0])
    a = np.fft.fft2(array(pixels.where("frame_idx = 1"), h, w))
    want = a * np.conj(a) / (np.abs(a) ** 2 + 0.01)
    found = wiener.run(7, n0=Stream(pixels.where("frame_idx = 1").withColumn("frame_idx", F.lit(0)), 1, count, w, h)).pixels
    assert np.allclose(array(found, h, w, "re"), want.real) and np.allclose(array(found, h, w, "im"), want.imag)


def test_flow_of_wavelets(spark):
    """Soft threshold of the details of two planes, and two levels back and forth."""
    pixels, frames, count, w, h = noise(spark, 1, 2)
    taps = ("table", kernel_table([neighbourhood.DB2]), [2, 9])
    shrink = {"category": "auxiliary", "coefficients": {"0,0,0": -0.3}}
    details = {"planes": [f"P{k}" for k in range(8)], "coefficients": {f"{k},0,0": 1.0 for k in range(8) if k % 4}}
    flow = graph(("pass", {}, [2]), taps, ("dwt", {}, [3, 7]), ("absolute", {}, [5]), ("coefficients", shrink, [10]), ("offset", {}, [6]), ("max", {}, [8]), ("sign", {}, [8]), ("scale", {}, [9]), ("idwt", {}, []), ("scale", {"category": "auxiliary"}, [5]), ("coefficients", details, [10]), ("coefficients", {"category": "auxiliary"}, [6]))
    assert close(flow.run(9, n0=Stream(pixels, frames, count, w, h)).pixels, macros.wavelet_denoise(pixels, w, h, 0.3))
    twice = graph(("pass", {}, [2]), ("table", kernel_table([neighbourhood.DB2]), [2, 3, 4, 5]), ("dwt", {}, [3]), ("dwt", {}, [4]), ("idwt", {}, [5]), ("idwt", {}, []))
    source = Stream(pixels, frames, count, w, h, names=("A", "B"))
    level = twice.run(3, n0=source)
    assert level.planes == 14 and level.names[:5] == ("A", "A (ad2)", "A (da2)", "A (dd2)", "A (ad1)") and level.sizes == ((12, 10), (7, 6), (5, 4))
    back = twice.run(5, n0=source)
    assert close(back.pixels, pixels) and (back.planes, back.width, back.height) == (2, 12, 10)


def test_flow_of_aligned_frames(spark):
    """Coverage-weighted mean of frames moved by a table; one-line tables hold for all frames, unknown ones stay."""
    pixels, frames, count, w, h = noise(spark, 3)
    moves = {"category": "auxiliary", "columns": ["dx", "dy"], "lines": ["0", "1"], "table": {"0,0,1": 2.0, "0,1,1": 1.0}}
    flow = graph(("pass", {}, [1, 6]), ("fill_1", {}, [3]), ("table", moves, [3, 6]), ("transform", {}, [4]), ("sum", {}, [5]), ("inverse", {}, [8]), ("transform", {}, [7]), ("sum", {}, [8]), ("scale", {}, []))
    params = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0), (1, 2.0, 1.0, 0.0, 1.0), (2, 0.0, 0.0, 0.0, 1.0)], "frame_idx int, dx double, dy double, rotation double, scale double")
    got = flow.run(8, n0=Stream(pixels, frames, count, w, h))
    assert (got.width, got.height) == (14, 11) and close(got.pixels, macros.pixel_complete(pixels, params, w, h, 14, 11))


def stars(spark, shifts, size=64, seed=4, count=20):
    rng = np.random.default_rng(seed)
    at = [(float(rng.uniform(8, size - 8)), float(rng.uniform(8, size - 8)), float(rng.uniform(50, 100))) for _ in range(count)]
    rows = []
    for f, (dx, dy) in enumerate(shifts):
        y, x = np.indices((size, size))
        a = sum(b * np.exp(-((x - sx - dx) ** 2 + (y - sy - dy) ** 2) / 3.0) for sx, sy, b in at)
        rows += [(f, 0, int(j), int(i), float(a[j, i])) for j in range(size) for i in range(size)]
    return spark.createDataFrame(rows, "frame_idx int, plane_idx int, y int, x int, v double"), len(shifts), size


def test_flow_of_star_alignment_and_moving_objects(spark):
    pixels, n, size = stars(spark, [(0, 0), (3, -2), (-1, 4)])
    source = Stream(pixels, n, 1, size, size)
    settings = {"category": "auxiliary", "alignmentPlane": 1, "starThreshold": 90, "starSampleRadius": 12}
    flow = graph(("pass", {}, [1, 2]), ("shift_detection", settings, [2]), ("transform", {}, []))
    table = {(r.y, r.x): r.v for r in flow.run(1, n0=source).pixels.collect()}
    assert [(round(table[k, 0]), round(table[k, 1])) for k in range(n)] == [(0, 0), (-3, 2), (1, -4)]
    aligned = flow.run(2, n0=source)
    spread = aligned.pixels.groupBy("y", "x").agg(F.count("v").alias("n"), (F.max("v") - F.min("v")).alias("d")).where("n = 3").agg(F.avg("d")).first()[0]
    assert spread < 1.5
    moving = {"category": "auxiliary", "xOrder": 5, "yOrder": 5, "tensor": {f"0,{k},{k}": 1.0 for k in range(5)} | {"0,0,4": 0.5}}
    metcalf = graph(("pass", {}, [1]), ("shift_detection", settings, [3]), ("tensor", moving, [3]), ("matrix_product", {"category": "auxiliary"}, []))
    assert metcalf.run(3, n0=source).width == 5
    points = graph(("pass", {}, [1]), ("points_extraction", {"threshold": 90}, []))
    found = points.run(1, n0=source)
    assert found.columns[:3] == ("x", "y", "brightness") and found.pixels.where("frame_idx = 0").count() > 5 * 6


def test_registration_falls_back(spark):
    """Frames without points are registered by their spectra, and those that fail there by their centre."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(32, 32)).cumsum(axis=0).cumsum(axis=1)
    rows = [(f, int(y), int(x), float(np.roll(base, (f, -f), (0, 1))[y, x])) for f in range(3) for y in range(32) for x in range(32)]
    frames = spark.createDataFrame(rows, "frame_idx int, y int, x int, v double")
    got = {r.frame_idx: r for r in astrometry.register_frames(frames, frames.where("frame_idx = 0").select("y", "x", "v"), 32, 32, least=100.0, most=101.0).collect()}
    assert all(got[f].dx is not None and round(got[f].dx) == f and round(got[f].dy) == -f and got[f].confidence > 0 for f in range(3))
    table = spark.createDataFrame([(0, None, None, None, 0.0, None), (1, 5.0, 5.0, 0.0, 0.9, None)], "frame_idx int, dx double, dy double, rotation double, confidence double, time double")
    other = spark.createDataFrame([(0, 2.0, 1.0, True, 0.4), (1, 9.0, 9.0, True, 0.4)], "frame_idx int, dx double, dy double, success boolean, confidence double")
    assert [tuple(r)[:5] for r in astrometry.fall_back(table, other.where("frame_idx = 9"), other).orderBy("frame_idx").collect()] == [(0, -2.0, -1.0, 0.0, 0.4), (1, 5.0, 5.0, 0.0, 0.9)]
    assert [r.frame_idx for r in astrometry.near_previous(spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 2.0), (2, 90.0, 2.0)], "frame_idx int, dx double, dy double"), 10.0).orderBy("frame_idx").collect()] == [0, 1]


def test_constants_of_flows(spark):
    pixels, frames, count, w, h = noise(spark, 1, 3)
    flow = graph(("pass", {}, [2]), ("coefficients", {"category": "auxiliary", "planes": ["a", "b", "c"], "coefficients": {"1,0,0": 2.0, "2,0,0": 3.0}}, [2]), ("scale", {}, []), ("coefficients", {"coefficients": {"0,0,0": 4.0}}, [4]), ("inverse", {}, [5]), ("power", {}, []), ("coefficients", {"category": "auxiliary", "coefficients": {"0,0,0": 0.5}}, [5]))
    got = values(flow.run(2, n0=Stream(pixels, frames, count, w, h)).pixels)
    assert all(abs(got[k] - v * (0, 2, 3)[k[1]]) < 1e-9 for k, v in values(pixels).items())
    assert flow.run(5).coefficients == ((0.5,),)
    two = graph(("tensor", {"xOrder": 3, "yOrder": 2, "tensor": {"0,2,1": 5.0}}, []),).run(0)
    assert (two.width, two.height, two.type) == (3, 2, "tensor") and {(r.y, r.x): r.v for r in two.pixels.collect()}[1, 2] == 5.0
    with pytest.raises(RuntimeError):
        graph(("coefficients", {"xOrder": 1, "coefficients": {"0,1,0": 1.0}}, [1]), ("inverse", {}, [])).run(1)


def test_transform_keeps_frames_without_parameters(spark):
    pixels, *_ = noise(spark, 2)
    params = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 1.0, 5, 4)], "frame_idx int, dx double, dy double, rotation double, scale double, width int, height int")
    got = values(geometry.transform(pixels, params, 12, 10, 14, 11, 2, 1))
    want = values(pixels)
    assert all(abs(got[1, 0, y + 1, x + 2] - want[1, 0, y, x]) < 1e-9 for y in range(10) for x in range(12))
    assert {k[2:] for k in got if k[0] == 0} == {(y, x) for y in range(1, 4) for x in range(3, 5)}


def test_large_windows_go_by_tiles(spark, monkeypatch):
    rng = np.random.default_rng(1)
    a = [[None if rng.random() < 0.2 else float(rng.integers(0, 50)) for _ in range(23)] for _ in range(17)]
    p, kernel = raster(spark, a), neighbourhood.disk(4)
    want = values(neighbourhood.quantile_filter(p, kernel, 23, 17, 0.3))
    monkeypatch.setattr(neighbourhood, "TAPS", 1)
    monkeypatch.setattr(neighbourhood, "TILE", 7)
    assert values(neighbourhood.quantile_filter(p, kernel, 23, 17, 0.3)) == want
    assert values(neighbourhood.quantile_filter(raster(spark, [[None, None, None, 1, 1]]), [[1.0]], 5, 1)) == {(0, 0, 0, x): (None if x < 3 else 1.0) for x in range(5)}


def test_protected_cells_lie_about_bright_groups():
    v = np.zeros((20, 20))
    v[5:7, 5:7] = 10.0  # four cells by edges
    v[15, 15] = v[16, 16] = v[17, 17] = v[18, 18] = 20.0  # by corners only
    v[0, 0] = np.nan
    y, x = np.indices(v.shape)
    want = np.min([np.hypot(y - a, x - b) for a in (5, 6) for b in (5, 6)], axis=0) <= 2
    assert (planes.protected(v, 97.0, 2) == want).all()
    assert not planes.protected(np.full((3, 3), np.nan), 99.0, 1).any()


def test_colour_denoising_matches_a_plain_version(spark):
    import colorsys

    pixels, frames, count, w, h = noise(spark, 2, 3)
    pixels = pixels.withColumn("v", F.when((F.col("x") == 3) & (F.col("y") == 4), None).otherwise(F.col("v") + F.when(F.col("x") > 6, 40.0).otherwise(0.0)))

    def smooth(a, axis, taps):
        reach = max(map(abs, taps))
        wide = np.moveaxis(np.pad(np.moveaxis(np.nan_to_num(a), axis, -1), [(0, 0), (reach, reach)], mode="symmetric"), -1, -1)
        n = a.shape[axis]
        return np.moveaxis(sum(t * wide[:, reach + k : reach + k + n] for k, t in taps.items()), -1, axis)

    def blurred(a, sigma):
        reach = int(4 * sigma + 0.5)
        raw = {k: math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)}
        taps = {k: v / sum(raw.values()) for k, v in raw.items()}
        return np.where(np.isnan(a), np.nan, smooth(np.where(np.isnan(a), 0, smooth(a, 0, taps)), 1, taps))

    def stacks(df):
        a = np.full((frames, 3, h, w), np.nan)
        for k, v in values(df).items():
            a[k] = np.nan if v is None else v
        return a

    given = stacks(pixels)
    for space in ("Lab", "YUV", "HSV"):
        got = stacks(macros.colour_denoise(pixels, w, h, space, 0.6, 0.3, 0.2))
        for f in range(frames):
            a = given[f]
            low, high = np.nanmin(a), np.nanmax(a)
            n = (a - low) / (high - low)
            if space == "HSV":
                c = np.stack(np.vectorize(lambda r, g, b: (np.nan,) * 3 if np.isnan(r + g + b) else colorsys.rgb_to_hsv(r, g, b))(*n))
            else:
                c = np.tensordot(colour.XYZ if space == "Lab" else colour.DIFFERENCES, n, 1)
            if space == "Lab":
                x, y, z = np.cbrt(c)
                c = np.stack((116 * y - 16, 500 * (x - y), 200 * (y - z)))
            slope, soft = {-1: -1.0, 1: 1.0}, {-1: 1.0, 0: 2.0, 1: 1.0}
            gone = np.isnan(c[0])
            zero = lambda m: np.where(gone, 0, m)
            g = np.hypot(smooth(zero(smooth(c[0], 1, slope)), 0, soft), smooth(zero(smooth(c[0], 0, slope)), 1, soft))[~gone]
            edge = np.zeros((h, w), bool)
            edge[~gone] = (g - g.min()) / (g.max() - g.min()) > 0.2
            d = np.where(edge, c, np.stack([blurred(c[0], 0.3), blurred(c[1], 0.6), blurred(c[2], 0.6)]))
            if space == "HSV":
                out = np.stack(np.vectorize(lambda x, y, z: (np.nan,) * 3 if np.isnan(x) else colorsys.hsv_to_rgb(x, y, z))(*d))
            elif space == "YUV":
                out = np.tensordot(colour.FROM_DIFFERENCES, d, 1)
            else:
                fy = (d[0] + 16) / 116
                out = np.tensordot(colour.FROM_XYZ, np.stack((d[1] / 500 + fy, fy, fy - d[2] / 200)) ** 3, 1)
            want = np.clip(out, 0, 1) * (high - low) + low
            assert np.allclose(got[f], want, equal_nan=True, atol=1e-6), space


def test_live_stack(spark, tmp_path):
    folder = tmp_path / "frames"
    for k, v in enumerate((1.0, 3.0)):
        raster(spark, [[v]], k).withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.mode("append").parquet(str(folder))
    query = stacking.start(stacking.live_stack(stacking.arriving(spark, str(folder))), "live", str(tmp_path / "check"))
    query.processAllAvailable()
    row = spark.table("live").first()
    query.stop()
    assert (row["sum"], row["count"], row["average"]) == (4.0, 2, 2.0)


def test_keys_are_stable():
    assert KEY == ("frame_idx", "plane_idx", "y", "x")
