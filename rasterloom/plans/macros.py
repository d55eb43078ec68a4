"""Macro operators in their fused forms, on pixels of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import soft_threshold
from ..model import KEY, grid
from ..operators import astrometry, colour, fit, geometry, neighbourhood, pixelwise, planes


def average(pixels: DataFrame) -> DataFrame:
    return pixelwise.stack(pixels, "average")


def standard_deviation(pixels: DataFrame) -> DataFrame:
    return pixelwise.stack(pixels, "standard_deviation")


def sigma_filtering(pixels: DataFrame, sigma: float = 1.5) -> DataFrame:
    return pixelwise.sigma_clip(pixels, sigma)


def pixel_complete(pixels: DataFrame, params: DataFrame, width: int, height: int, new_width: int, new_height: int, sigma: float | None = None) -> DataFrame:
    """Aligned frames averaged by coverage, with outliers clipped first if sigma is given."""
    aligned = geometry.transform(pixels, params, width, height, new_width, new_height)
    return average(aligned if sigma is None else pixelwise.sigma_clip(aligned, sigma))


def star_alignment(pixels: DataFrame, reference: DataFrame, width: int, height: int, plane: int = 1, **settings) -> tuple[DataFrame, int, int]:
    """Frames moved and turned onto a reference frame (y, x, v of the plane), with the width and height of the common canvas."""
    table = astrometry.register_frames(pixels.where(F.col("plane_idx") == plane).select("frame_idx", "y", "x", "v"), reference, width, height, **settings)
    params = table.where("dx is not null").select("frame_idx", "dx", "dy", "rotation", F.lit(1.0).alias("scale"))
    left, top, new_width, new_height = geometry.canvas_of(params, width, height)
    return geometry.transform(pixels, params, width, height, new_width, new_height, left, top), new_width, new_height


def background_flat(pixels: DataFrame) -> DataFrame:
    return fit.subtract_background(pixels)


def blur(pixels: DataFrame, width: int, height: int) -> DataFrame:
    return neighbourhood.convolve(pixels, neighbourhood.BLUR, width, height)


def unsharp_mask(pixels: DataFrame, width: int, height: int) -> DataFrame:
    return neighbourhood.convolve(pixels, neighbourhood.SHARPEN, width, height)


def chroma_denoise(pixels: DataFrame, width: int, height: int, kernel=neighbourhood.BLUR) -> DataFrame:
    """Colour planes a and b blurred, lightness kept."""
    lab = colour.to_lab(pixels)
    soft = neighbourhood.convolve(lab.where("plane_idx > 0"), kernel, width, height)
    return colour.to_rgb(lab.where("plane_idx = 0").unionByName(soft))


def colour_denoise(pixels: DataFrame, width: int, height: int, space: str = "Lab", chroma: float = 2.0, luma: float = 0.2, edges: float | None = 0.1) -> DataFrame:
    """Gaussians of `luma` and `chroma` pixels over the first and the other two channels of a colour space.

    Frames are brought to 0..1 first and back at the end. Where the gradient of the first channel, brought to 0..1 over the
    frame, exceeds `edges`, pixels stay as they are (None: nowhere). Invalid pixels stay invalid.
    """
    ends = pixels.groupBy("frame_idx").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    span = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    ends = ends.select("frame_idx", F.when(F.col("high") > F.col("low"), F.col("low")).otherwise(0.0).alias("low"), span.alias("span"))
    scaled = pixels.join(ends, "frame_idx").select(*KEY, ((F.col("v") - F.col("low")) / F.col("span")).alias("v"))
    three = [F.col(f"p{k}") for k in range(3)]
    channels = colour.long(colour.to_space(colour.wide(scaled), space), three)
    soft = None
    for where, sigma in (("plane_idx = 0", luma), ("plane_idx > 0", chroma)):
        part = channels.where(where)
        part = neighbourhood.gaussian(part, width, height, sigma) if sigma > 0 else part
        soft = part if soft is None else soft.unionByName(part)
    if edges is not None:
        slope = neighbourhood.gradient(channels.where("plane_idx = 0"), width, height)
        of = slope.groupBy("frame_idx").agg(F.min("v").alias("least"), F.max("v").alias("most"))
        level = F.when(F.col("most") > F.col("least"), (F.col("v") - F.col("least")) / (F.col("most") - F.col("least"))).otherwise(F.col("v"))
        sharp = slope.join(of, "frame_idx").where(level > edges).select("frame_idx", "y", "x", F.lit(True).alias("sharp"))
        whole = channels.withColumnRenamed("v", "kept")
        soft = soft.join(whole, list(KEY)).join(sharp, ["frame_idx", "y", "x"], "left").select(*KEY, F.when(F.col("sharp"), F.col("kept")).otherwise(F.col("v")).alias("v"))
    back = colour.long(colour.from_space(colour.wide(soft), space), three)
    return back.join(ends, "frame_idx").select(*KEY, (F.col("v") * F.col("span") + F.col("low")).alias("v"))


def lrgb_combination(light: DataFrame, colours: DataFrame) -> DataFrame:
    """Lightness of the first plane of one stream with the colours of another."""
    ab = colour.to_lab(colours).where("plane_idx > 0")
    return colour.to_rgb(light.where("plane_idx = 0").select(*KEY, "v").unionByName(ab.select(*KEY, "v")))


def median_filter(pixels: DataFrame, width: int, height: int, radius: int = 25) -> DataFrame:
    return neighbourhood.quantile_filter(pixels, neighbourhood.disk(radius), width, height)


def convolution(pixels: DataFrame, kernel, width: int, height: int) -> DataFrame:
    return planes.fft_convolve(pixels, kernel, width, height)


def wiener_deconvolution(pixels: DataFrame, kernel, width: int, height: int) -> DataFrame:
    return planes.deconvolve(pixels, kernel, width, height)


def star_mask(pixels: DataFrame, width: int, height: int, radius: int = 25, quantile: float = 0.95) -> DataFrame:
    """1 where blurred pixels exceed the local median by more than the quantile of positive differences, else 0."""
    soft = blur(pixels, width, height)
    base = median_filter(pixels, width, height, radius).withColumnRenamed("v", "m")
    diff = soft.join(base, list(KEY)).select(*KEY, (F.col("v") - F.col("m")).alias("v"))
    level = diff.where("v > 0").groupBy("frame_idx", "plane_idx").agg(F.percentile("v", quantile).alias("t"))
    return diff.join(level, ["frame_idx", "plane_idx"], "left").select(*KEY, F.when(F.col("v") > F.col("t"), 1.0).otherwise(0.0).alias("v"))


def star_extraction(pixels: DataFrame, width: int, height: int, radius: int = 25) -> DataFrame:
    """Points of the pixels less their local median."""
    base = median_filter(pixels, width, height, radius).withColumnRenamed("v", "m")
    flat = blur(pixels, width, height).join(base, list(KEY)).select(*KEY, (F.col("v") - F.col("m")).alias("v"))
    return planes.label_planes(flat, width, height)


def moving_object(params: DataFrame, speed_x: float, speed_y: float) -> DataFrame:
    """Alignment on an object that moves against the stars: shifts follow the time column."""
    return params.withColumns({"dx": F.col("dx") - speed_x * F.col("time"), "dy": F.col("dy") - speed_y * F.col("time")})


def wavelet_denoise(pixels: DataFrame, width: int, height: int, threshold: float, bands: tuple[str, ...] = ("ad", "da", "dd")) -> DataFrame:
    """One level apart, the chosen detail bands under a soft threshold, and together again."""
    parts = neighbourhood.dwt(pixels, width, height)
    parts |= {b: parts[b].withColumn("v", soft_threshold(F.col("v"), threshold)) for b in bands}
    return neighbourhood.idwt(parts, width, height)


def gaussian_image(frames: DataFrame, size: int = 9) -> DataFrame:
    """A normalised Gaussian as a one-plane image for every frame."""
    c = size // 2
    raw = grid(frames.select("frame_idx").distinct().withColumn("plane_idx", F.lit(0)), size, size)
    v = F.exp(-(F.pow(F.col("x") - c, 2) + F.pow(F.col("y") - c, 2)))
    total = sum(sum(r) for r in [[2.718281828459045 ** -((x - c) ** 2 + (y - c) ** 2) for x in range(size)] for y in range(size)])
    return raw.select(*KEY, (v / total).alias("v"))
