"""Pixel algebra: projections, zips of streams, and stacking aggregates."""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import BINARY, UNARY, complex_product, modulus
from ..model import CELL, KEY, Stream, add_polynomials, constant, multiply_polynomials, ordered, polynomial_of, surfaces


def unary(pixels: DataFrame, name: str) -> DataFrame:
    """One projection per operator; Catalyst fuses chains of them."""
    return pixels.withColumn("v", UNARY[name](F.col("v")))


def unary_complex(pixels: DataFrame, name: str) -> DataFrame:
    """Operators that treat complex pixels differently; absolute and squared_norm give real pixels."""
    re, im = F.col("re"), F.col("im")
    if name in ("absolute", "squared_norm"):
        return pixels.select(*[c for c in pixels.columns if c not in ("re", "im")], (modulus(re, im) if name == "absolute" else re * re + im * im).alias("v"))
    square = re * re + im * im
    change = {"conjugate": (re, -im), "negate": (-re, -im), "pass": (re, im), "inverse": (F.try_divide(re, square), F.try_divide(-im, square))}[name]
    return pixels.withColumns({"re": change[0], "im": change[1]})


#: Of two constants; anything else of polynomials than sums and products needs constants.
OF_CONSTANTS = {"power": lambda a, b: a**b if a > 0 or b == int(b) else math.nan, "max": max, "min": min}


def combined(name: str, a, b):
    """Two polynomials under a binary operator."""
    if name in ("offset", "scale"):
        return (add_polynomials if name == "offset" else multiply_polynomials)(a, b)
    x, y = constant(a), constant(b)
    if x is None or y is None or name not in OF_CONSTANTS:
        raise ValueError(f"{name} of polynomials takes constants")
    return ((float(OF_CONSTANTS[name](x, y)),),)


def binary(streams: list[Stream], name: str) -> Stream:
    """Left fold of a binary operator over two or more streams.

    The join key leaves out what an operand does not vary over: frames of a single-frame stream, planes of a
    single-plane one, and an axis of extent one. Polynomials and constants become expressions. Streams of different
    lengths over one do not fit together and raise.
    """
    streams = ordered(streams)
    if len(streams) < 2:
        raise ValueError("a binary operator takes two streams at least")
    if all(s.type == "polynomial" for s in streams):
        planes = max(len(surfaces(s)) for s in streams)
        grids = [surfaces(s) * planes if len(surfaces(s)) == 1 else surfaces(s) for s in streams]
        made = tuple(reduce(lambda a, b: combined(name, a, b), g) for g in zip(*grids, strict=True))
        return replace(streams[0], coefficients=made[0], by_plane=made if planes > 1 else ())
    lengths = {s.length for s in streams if s.pixels is not None and s.length > 1}
    if len(lengths) > 1:
        raise ValueError(f"streams of {sorted(lengths)} frames cannot be zipped")
    real = [s for s in streams if s.pixels is not None]
    base = max(real, key=lambda s: (s.planes if s.category == "primary" else 0, s.length, s.width * s.height))
    out, first = base.pixels.withColumnRenamed("v", f"v{streams.index(base)}"), streams.index(base)
    for k, s in enumerate(streams):
        if k == first:
            continue
        if s.type == "polynomial":
            out = out.withColumn(f"v{k}", polynomial_of(s))
            continue
        varies = {"frame_idx": s.length > 1, "plane_idx": s.planes > 1, "y": s.height > 1, "x": s.width > 1}
        on = [c for c in KEY if varies[c]]
        side = s.pixels.select(*on, F.col("v").alias(f"v{k}"))
        out = out.join(side, on, "inner") if on else out.join(F.broadcast(side.limit(1)), F.lit(True))  # a single pixel
    value: Column = F.col("v0")
    for k in range(1, len(streams)):
        value = BINARY[name](value, F.col(f"v{k}"))
    pixels = out.select(*KEY, value.alias("v"))
    return replace(base, pixels=pixels, length=max(s.length for s in real), width=max(s.width for s in real), height=max(s.height for s in real))


def binary_complex(a: DataFrame, b: DataFrame, on: tuple[str, ...] = KEY, name: str = "scale") -> DataFrame:
    """Product (or sum, name "offset") of two rasters that share keys, of which one at least is complex."""
    parts = lambda df: (F.col("re"), F.col("im")) if "re" in df.columns else (F.col("v"), F.when(F.col("v").isNotNull(), F.lit(0.0)))
    a = a.select(*KEY, parts(a)[0].alias("ra"), parts(a)[1].alias("ia"))
    b = b.select(*on, parts(b)[0].alias("rb"), parts(b)[1].alias("ib"))
    x, y = (F.col("ra"), F.col("ia")), (F.col("rb"), F.col("ib"))
    re, im = complex_product(x, y) if name == "scale" else (x[0] + y[0], x[1] + y[1])
    return a.join(b, list(on)).select(*KEY, re.alias("re"), im.alias("im"))


STACK = {
    "sum": lambda v: F.sum(v),
    "product": lambda v: F.product(v),
    "count": lambda v: F.count(v).cast("double"),
    "maximum": lambda v: F.max(v),
    "minimum": lambda v: F.min(v),
    "average": lambda v: F.avg(v),
    "standard_deviation": lambda v: F.stddev_pop(v),
}


def stack(pixels: DataFrame, name: str) -> DataFrame:
    """N:1 aggregate over frames that skips invalid values; one shuffle with partial aggregation, on (plane, y, x)."""
    return pixels.groupBy(*CELL).agg(STACK[name](F.col("v")).alias("v")).select(F.lit(0).alias("frame_idx"), *CELL, "v")


def stack_complex(pixels: DataFrame, name: str = "sum") -> DataFrame:
    if name != "sum":
        raise ValueError("complex pixels can be summed only")
    return pixels.groupBy(*CELL).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def sigma_clip(pixels: DataFrame, sigma: float = 1.5) -> DataFrame:
    """Pixels further than sigma population deviations from their cell's mean become invalid.

    One window over the cell replaces an aggregate and a join back: a single shuffle.
    """
    w = Window.partitionBy(*CELL)
    mean, deviation = F.avg("v").over(w), F.stddev_pop("v").over(w)
    far = F.abs(F.col("v") - mean) > sigma * deviation
    return pixels.select(*KEY, F.when(far, None).otherwise(F.col("v")).alias("v"))


def sigma_clipped_average(pixels: DataFrame, sigma: float = 1.5) -> DataFrame:
    return stack(sigma_clip(pixels, sigma), "average")
