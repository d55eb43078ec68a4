"""Nodes by the parameters that flow files hold."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_consensus import sky_to_plate
from test_operators import close, graph, kernel_table, noise

from rasterloom.functions.wavelets import scaling_filter
from rasterloom.model import Stream
from rasterloom.operators import colour, neighbourhood, planes
from rasterloom.plans import flow as flows
from rasterloom.sources import csvplanes


def test_masks_and_curves_read_their_own_names(spark):
    pixels, frames, count, w, h = noise(spark, 2, 3)
    source = Stream(pixels, frames, count, w, h)
    mask = graph(("colorspace_mask", {"color_space": "RGB", "mask_3d_points": [[0.2, 0.3, 0.4, 0.3, 0.2]], "rotation_matrix": [[1, 0, 0], [0, 1, 0], [0, 0, 1]]}, []))
    mask.nodes[0].inputs = [7]
    mask.nodes[7] = flows.Node(7, "pass")
    want = colour.colour_mask(pixels, [(0.2, 0.3, 0.4, 0.3, 0.2)])
    got = mask.run(0, n7=source).pixels
    assert close(got, want) and got.where("v < 1").count() > 0
    one = mask.run(0, n7=Stream(pixels.where("plane_idx = 0"), frames, 1, w, h)).pixels
    assert {r.v for r in one.select("v").distinct().collect()} == {1.0}
    curve = graph(("tone_curve", {"controlPoints": [[0.0, 0.1], [0.5, 0.4], [1.0, 0.9]], "boundaryCondition": "clamped", "outputMin": 10, "outputEnd": 20, "displayMin": -5, "displayEnd": 9}, []))
    curve.nodes[0].inputs = [7]
    curve.nodes[7] = flows.Node(7, "pass")
    tone = colour.tone_curve(F.col("v"), [(0.0, 0.1), (0.5, 0.4), (1.0, 0.9)], "clamped", (10.0, 20.0))
    assert close(curve.run(0, n7=source).pixels, pixels.withColumn("v", tone))


def test_unknown_parameters_are_refused(spark):
    for kind, params in (("tone_curve", {"control": []}), ("negate", {"sigma": 1}), ("wavelet_denoise", {"wavelets": "db2"}), ("colorspace_mask", {"mask_points": []})):
        flow = graph((kind, params, []))
        with pytest.raises(ValueError, match="takes no"):
            flow.validate()
        with pytest.raises(ValueError, match="takes no"):
            flow.run(0)


def test_readers_and_writers_read_their_own_names(spark, tmp_path):
    a, b = (str(tmp_path / x) for x in ("a.csv", "b.csv"))
    for path, n in ((a, 1), (b, 2)):
        with open(path, "w") as f:
            f.write(f"image,a,b\n0,{n},{n + 1}\n1,{n + 2},\n")
    flow = graph(("file_reader", {"filePaths": [a, b]}, [1]), ("file_writer", {"outputFilePath": str(tmp_path / "out")}, []))
    got = flow.run(1)
    assert (got.length, got.width, got.height) == (2, 2, 2)
    assert close(csvplanes.read_csv(spark, str(tmp_path / "out")).select("frame_idx", "plane_idx", "y", "x", "v"), got.pixels)
    with pytest.raises(RuntimeError, match="no file"):
        graph(("fits_reader", {}, [])).run(0)


def test_two_levels_are_taken_back_at_once(spark):
    pixels, frames, count, w, h = noise(spark, 1, 2)
    taps = ("table", kernel_table([neighbourhood.DB2]), [2, 3, 4])
    flow = graph(("pass", {}, [2]), taps, ("dwt", {}, [3]), ("dwt", {}, [4]), ("idwt", {}, []))
    got = flow.run(4, n0=Stream(pixels, frames, count, w, h, names=("A", "B")))
    assert close(got.pixels, pixels) and (got.planes, got.width, got.height, got.names, got.sizes) == (2, w, h, ("A", "B"), ())


@pytest.mark.parametrize("name", ["haar", *[f"db{k}" for k in (1, 2, 3, 4, 7, 12, 20)], *[f"sym{k}" for k in (2, 4, 5, 8)]])
def test_scaling_filters_are_orthonormal(name):
    h = np.array(scaling_filter(name))
    n = len(h) // 2
    assert abs(h.sum() - math.sqrt(2)) < 1e-12
    assert all(abs(h[2 * m :] @ h[: len(h) - 2 * m] - (m == 0)) < 1e-12 for m in range(n))
    assert all(abs((np.linspace(-1, 1, 2 * n) ** p * (-1.0) ** np.arange(2 * n)) @ h) < 1e-10 for p in range(n))


def test_scaling_filters_have_their_known_values():
    assert np.allclose(scaling_filter("db2"), neighbourhood.DB2)
    # fixed values: the published scaling filters with four vanishing moments
    assert np.allclose(scaling_filter("db4"), [0.23037781, 0.71484657, 0.63088077, -0.02798377, -0.18703481, 0.03084138, 0.03288301, -0.01059740])
    assert np.allclose(scaling_filter("sym4"), [0.03222310, -0.01260397, -0.09921954, 0.29785780, 0.80373875, 0.49761867, -0.02963553, -0.07576571])
    for name in ("db0", "db21", "sym1", "coif1", "x"):
        with pytest.raises(ValueError, match="no wavelet"):
            scaling_filter(name)


def test_denoising_takes_the_wavelet_and_works_by_tiles(spark):
    pixels, frames, count, w, h = noise(spark, 1, 2)
    source = Stream(pixels, frames, count, w, h)
    out = {}
    for name in ("haar", "db4"):
        flow = graph(("wavelet_denoise", {"wavelet": name, "sigma": 0.2, "levels": 1, "star_protection": False}, []))
        flow.nodes[0].inputs = [7]
        flow.nodes[7] = flows.Node(7, "pass")
        out[name] = flow.run(0, n7=source).pixels
        assert close(out[name], planes.wavelet_denoise(pixels, w, h, 0.2, list(scaling_filter(name)), 1))
    assert not close(out["haar"], out["db4"])
    tiled = planes.wavelet_denoise(pixels, w, h, 0.2, neighbourhood.DB2, 1, tile=7)
    for ty in range(0, h, 7):
        for tx in range(0, w, 7):
            part = pixels.where(f"y between {ty} and {ty + 6} and x between {tx} and {tx + 6}").withColumns({"y": F.col("y") - ty, "x": F.col("x") - tx})
            want = planes.wavelet_denoise(part, min(7, w - tx), min(7, h - ty), 0.2, neighbourhood.DB2, 1)
            got = tiled.where(f"y between {ty} and {ty + 6} and x between {tx} and {tx + 6}").withColumns({"y": F.col("y") - ty, "x": F.col("x") - tx})
            assert close(got, want)


def as_table(spark, rows, columns, frames=1):
    cells = [(f, 0, y, x, float(v)) for f, y, row in rows for x, v in enumerate(row)]
    return Stream(spark.createDataFrame(cells, "frame_idx int, plane_idx int, y int, x int, v double"), frames, 1, len(columns), 1 + max(y for _, y, _ in rows), type="table", columns=columns)


def test_stars_and_plates_in_one_flow(spark):
    rng, width, height, scale = random.Random(21), 900, 700, 0.01
    stars = [(k, rng.uniform(105, 117), rng.uniform(14, 26), rng.uniform(2, 8)) for k in range(260)]
    seen = [(x, y, 100 - 10 * mag, k) for k, ra, dec, mag in stars for c, x, y in [sky_to_plate(ra, dec, 111.0, 20.0, scale, 70.0, width, height)] if 5 < x < width - 5 and 5 < y < height - 5]
    points = as_table(spark, [(0, n, p[:3]) for n, p in enumerate(seen)], ("x", "y", "brightness"))
    catalog = as_table(spark, [(0, n, s) for n, s in enumerate(stars)], ("id", "ra", "dec", "mag"))
    text = {"version": "1", "nodes": [
        {"index": 0, "type": "pass", "connections": [2]}, {"index": 1, "type": "pass", "category": "auxiliary", "connections": [2]},
        {"index": 2, "type": "star_identification", "fovDeg": math.hypot(width, height) * scale, "useHeaderFovDeg": False, "catalog.matchLimit": 0.5, "catalog.magLimit": 8.0, "gridRows": 1, "gridCols": 1, "starsPerGrid": 16, "ransacIterations": 120, "ransacSeed": 2725, "connections": [3]},
        {"index": 3, "type": "orientation", "ransacThresholdPx": 3.0, "ransacIterations": 60, "ransacSeed": 2725, "connections": []},
    ]}
    flow = flows.load(json.dumps(text))
    flow.validate()
    named = flow.run(2, n0=points, n1=catalog)
    lines = {}
    for r in named.pixels.collect():
        lines.setdefault(r.y, {})[named.columns[r.x]] = r.v
    right = [s for s in lines.values() if any(abs(s["x"] - x) < 1e-6 and abs(s["y"] - y) < 1e-6 and k == s["id"] for x, y, _, k in seen)]
    assert len(lines) >= 10 and len(right) == len(lines) and [lines[k]["mag"] for k in sorted(lines)] == sorted(s["mag"] for s in lines.values())
    plate = {r.x: r.v for r in flow.run(3, n0=points, n1=catalog).pixels.collect()}
    assert abs((plate[2] - 70 + 180) % 360 - 180) < 1.5 and abs(plate[3] / scale - 1) < 0.01 and abs(plate[0] - 111) < 1.5 and abs(plate[1] - 20) < 1.5 and plate[4] >= 0.5
