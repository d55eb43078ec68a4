"""The data model: a raster is a relation of frames and one of pixels.

frames: frame_idx, category, type, mode, width, height, planes and optional header columns.
pixels: frame_idx, plane_idx, y, x, v (real) or re, im (complex). NULL stands for an invalid value; an absent row lies
outside a frame's extent. NaN never enters `pixels`: sources convert it with `valid`.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("frame_idx", "plane_idx", "y", "x")
CELL = ("plane_idx", "y", "x")
CATEGORY_PRIORITY = {"primary": 0, "auxiliary": 10_000}
TYPE_PRIORITY = {"table": 0, "image": 0, "tensor": 1_000, "polynomial": 2_000}


def valid(v: Column) -> Column:
    """NaN becomes NULL."""
    return F.when(F.isnan(v), None).otherwise(v)


@dataclass(frozen=True)
class Stream:
    """One input of an operator: pixels and what planning needs to know about them.

    length counts frames; planes, width and height are extents. A polynomial has coefficients instead of pixels:
    coefficients[j][i] stands for x^i y^j at absolute pixel positions; by_plane has one such grid for each of several
    planes. columns and lines name a table's axes, names its planes, ids the frames; sizes are the extents before each
    level of a wavelet transform; header is a relation that belongs to the frames.
    """

    pixels: DataFrame | None = None
    length: int = 1
    planes: int = 1
    width: int = 1
    height: int = 1
    category: str = "primary"
    type: str = "image"
    coefficients: tuple[tuple[float, ...], ...] = field(default=())
    by_plane: tuple[tuple[tuple[float, ...], ...], ...] = ()
    columns: tuple[str, ...] = ()
    lines: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()
    sizes: tuple[tuple[int, int], ...] = ()
    header: DataFrame | None = None

    def priority(self) -> int:
        return CATEGORY_PRIORITY.get(self.category, 20_000) + TYPE_PRIORITY.get(self.type, 0) + max(0, min(999, 1000 - self.length))


def ordered(streams: list[Stream]) -> list[Stream]:
    """Operands in evaluation order: category, then type, then longer streams first; ties keep their order."""
    return sorted(streams, key=Stream.priority)


def polynomial(coefficients: tuple[tuple[float, ...], ...], x: Column | str = "x", y: Column | str = "y") -> Column:
    """Sum of c[j][i] x^i y^j as one expression, so that no join is needed."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    terms = []
    for j, row in enumerate(coefficients):
        for i, c in enumerate(row):
            if c:
                term = F.lit(float(c))
                for base, power in ((x, i), (y, j)):
                    for _ in range(power):
                        term = term * base
                terms.append(term)
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)


def surfaces(s: Stream) -> tuple:
    """The coefficient grids of a polynomial, one for each plane that it tells apart."""
    return s.by_plane or (s.coefficients,)


def polynomial_of(s: Stream) -> Column:
    """A polynomial stream's value at a pixel; planes beyond those it tells apart are 0."""
    if not s.by_plane:
        return polynomial(s.coefficients)
    value = F.lit(0.0)
    for k, c in enumerate(s.by_plane):
        value = F.when(F.col("plane_idx") == k, polynomial(c)).otherwise(value)
    return value


def constant(c) -> float | None:
    """The value of a polynomial without x and y, else None."""
    return None if any(v for j, row in enumerate(c) for i, v in enumerate(row) if i or j) else float(c[0][0] if c and c[0] else 0.0)


def multiply_polynomials(a, b):
    """Coefficients of a product of two polynomials."""
    out = [[0.0] * (len(a[0]) + len(b[0]) - 1) for _ in range(len(a) + len(b) - 1)]
    for j, row in enumerate(a):
        for i, c in enumerate(row):
            for m, other in enumerate(b):
                for k, d in enumerate(other):
                    out[j + m][i + k] += c * d
    return tuple(map(tuple, out))


def add_polynomials(a, b):
    """Coefficients of a sum of two polynomials."""
    at = lambda p, j, i: p[j][i] if j < len(p) and i < len(p[j]) else 0.0
    return tuple(tuple(at(a, j, i) + at(b, j, i) for i in range(max(len(a[0]), len(b[0])))) for j in range(max(len(a), len(b))))


def concatenated(streams: list[DataFrame], lengths: list[int]) -> DataFrame:
    """All frames of several streams one after the other, renumbered."""
    out, offset = None, 0
    for pixels, n in zip(streams, lengths, strict=True):
        part = pixels.withColumn("frame_idx", F.col("frame_idx") + offset)
        out, offset = part if out is None else out.unionByName(part), offset + n
    return out


def grid(keys: DataFrame, width: int, height: int) -> DataFrame:
    """Every y, x of the extent for every row of keys."""
    return keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
