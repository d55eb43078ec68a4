"""FITS, PNG and PGM/PPM frames from binary files, decoded inside tasks, and quantised writers."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "source_file string, part int, plane_idx int, y int, x int, v double"
#: Bytes of a FITS block and the numpy types by BITPIX.
FITS_BLOCK, FITS_TYPES = 2880, {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
#: Header of a PNG file, and its channels by colour type.
PNG_MAGIC, PNG_CHANNELS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def fits_units(data: bytes) -> list[tuple[dict[str, str], np.ndarray]]:
    """Header cards and values (float, BSCALE and BZERO applied) of every unit that has two axes or more."""
    at, out = 0, []
    while at + FITS_BLOCK <= len(data):
        cards: dict[str, str] = {}
        done = False
        while not done and at + FITS_BLOCK <= len(data):
            block = data[at : at + FITS_BLOCK].decode("ascii", "replace")
            at += FITS_BLOCK
            for i in range(0, FITS_BLOCK, 80):
                card = block[i : i + 80]
                if card[:8].strip() == "END":
                    done = True
                    break
                if card[8:10] == "= ":
                    value = card[10:].strip()
                    cards[card[:8].strip()] = value[1:].split("'")[0].rstrip() if value.startswith("'") else value.split("/")[0].strip()
        axes = [int(cards[f"NAXIS{k}"]) for k in range(int(cards.get("NAXIS", 0)), 0, -1)]
        kind = np.dtype(FITS_TYPES[int(cards.get("BITPIX", 8))])
        size = int(np.prod(axes)) * kind.itemsize if axes else 0
        if len(axes) >= 2:
            v = np.frombuffer(data, kind, int(np.prod(axes)), at).reshape(axes).astype(float)
            out.append((cards, v * float(cards.get("BSCALE", 1)) + float(cards.get("BZERO", 0))))
        at += -(-size // FITS_BLOCK) * FITS_BLOCK
    return out


def channels_first(v: np.ndarray) -> np.ndarray:
    """Planes of a unit: two axes are one plane; of three, the first counts planes if it is four at most, else the last."""
    if v.ndim == 2:
        return v[None]
    v = v.reshape(-1, *v.shape[-2:]) if v.ndim > 3 else v
    return v if v.shape[0] <= 4 else np.moveaxis(v, -1, 0)


def png_pixels(data: bytes) -> np.ndarray:
    """planes x height x width of a PNG that is not interlaced, of 8 or 16 bits; a palette becomes three planes."""
    if data[:8] != PNG_MAGIC:
        raise ValueError("not a PNG")
    at, body, palette = 8, b"", b""
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", part)
        elif name == b"PLTE":
            palette = part
        elif name == b"IDAT":
            body += part
        at += 12 + size
    if laced or depth not in (8, 16):
        raise ValueError("interlaced files and depths below 8 are not read")
    step = PNG_CHANNELS[colour] * depth // 8
    raw, stride, rows = zlib.decompress(body), step * width, []
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = raw[y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1)
        if kind in (0, 2):
            row = line + (above if kind else 0)
        elif kind == 1:
            row = line.reshape(width, step).cumsum(axis=0, dtype=np.uint8).ravel()
        else:
            row = np.frombuffer(_predicted(kind, line.tobytes(), above.tobytes(), step), np.uint8)
        above = row.astype(np.uint8)
        rows.append(above)
    v = np.stack(rows)
    v = v.reshape(height, width, -1) if depth == 8 else v.reshape(-1).view(">u2").reshape(height, width, -1)
    if colour == 3:
        v = np.frombuffer(palette, np.uint8).reshape(-1, 3)[v[..., 0]]
    return np.moveaxis(v, -1, 0)


def _predicted(kind: int, line: bytes, up: bytes, step: int) -> bytearray:
    """A row of filter 3 (mean) or 4 (nearest of left, above and corner): each byte needs the one before it, so plain ints are quickest."""
    row = bytearray(len(line))
    for i, value in enumerate(line):
        above = up[i]
        left, corner = (row[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 3:
            guess = (left + above) >> 1
        else:
            p, q = above - corner, left - corner  # distances of left and of above from left + above - corner
            r = abs(p + q)
            p, q = abs(p), abs(q)
            guess = left if p <= q and p <= r else above if q <= r else corner
        row[i] = (value + guess) & 255
    return row


def write_png(planes: np.ndarray, depth: int = 8) -> bytes:
    """A PNG of one, two, three or four planes."""
    count, height, width = planes.shape
    raw = np.moveaxis(planes, 0, -1).astype(">u2" if depth == 16 else np.uint8).reshape(height, -1).view(np.uint8)
    body = zlib.compress(b"".join(b"\0" + r.tobytes() for r in raw))
    chunk = lambda name, d: struct.pack(">I", len(d)) + name + d + struct.pack(">I", zlib.crc32(name + d))
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[count]
    return PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def write_pnm(planes: np.ndarray, depth: int = 8) -> bytes:
    """A binary PGM (one plane) or PPM (three)."""
    count, height, width = planes.shape
    head = f"P{5 if count == 1 else 6}\n{width} {height}\n{(1 << depth) - 1}\n".encode()
    return head + np.moveaxis(planes, 0, -1).astype(">u2" if depth == 16 else np.uint8).tobytes()


def _decoded(spark: SparkSession, path: str | list[str], decode) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(parts):
        for pdf in parts:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                for part, planes in enumerate(decode(data)):
                    for k, plane in enumerate(planes):
                        height = max(1, PIXELS_AT_ONCE // max(1, plane.shape[1]))
                        for top in range(0, plane.shape[0], height):
                            some = plane[top : top + height]
                            y, x = np.indices(some.shape)
                            yield pd.DataFrame({"source_file": name, "part": part, "plane_idx": k, "y": y.ravel() + top, "x": x.ravel(), "v": some.ravel().astype(float)})

    out = files.mapInPandas(run, PIXELS)
    return out.withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))


#: Pixels of a plane that leave a decoder as one frame of rows.
PIXELS_AT_ONCE = 1 << 18


def read_fits_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_file, part, mode, bayer_pattern, width, height, planes, header): a row for each unit with an image.

    mode is L, RGB or RGBA by the number of planes, FITS_nC for other numbers, and BAYER where one plane has a mosaic pattern.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(parts):
        for pdf in parts:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                for part, (cards, v) in enumerate(fits_units(data)):
                    planes = channels_first(v)
                    pattern = cards.get("BAYERPAT") or cards.get("BAYER")
                    pattern = pattern.strip(" '").upper() if pattern and len(planes) == 1 else None
                    mode = "BAYER" if pattern else {1: "L", 3: "RGB", 4: "RGBA"}.get(len(planes), f"FITS_{len(planes)}C")
                    yield pd.DataFrame([{"source_file": name, "part": part, "mode": mode, "bayer_pattern": pattern, "width": planes.shape[2], "height": planes.shape[1], "planes": len(planes), "header": {k: str(x) for k, x in cards.items()}}])

    return files.mapInPandas(run, "source_file string, part int, mode string, bayer_pattern string, width int, height int, planes int, header map<string,string>")


def read_fits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Pixels of FITS files: (source_file, part, plane_idx, y, x, v), part counting the units with an image."""
    return _decoded(spark, path, lambda data: [channels_first(v) for _, v in fits_units(data)])


def read_png(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _decoded(spark, path, lambda data: [png_pixels(data)])


def encode_frames(pixels: DataFrame, width: int, height: int, low: float, end: float, depth: int = 8, form: str = "png") -> DataFrame:
    """(frame_idx, file, size, planeCount, width, height): each frame quantised and encoded in its own group. Four planes
    (R, G, B, G) become three with the mean green."""
    top = (1 << depth) - 1

    def run(pdf):
        count = int(pdf["plane_idx"].max()) + 1
        a = np.full((count, height, width), np.nan)
        a[pdf["plane_idx"], pdf["y"], pdf["x"]] = pdf["v"].to_numpy(dtype=float, na_value=np.nan)
        if count == 4:
            a = np.stack((a[0], (a[1] + a[3]) / 2, a[2]))
        factor = (top + 1) / (end - low) if end != low else top + 1
        q = np.clip(np.rint(np.nan_to_num((a - low) * factor)), 0, top)
        data = (write_png if form == "png" else write_pnm)(q, depth)
        return pd.DataFrame({"frame_idx": [int(pdf["frame_idx"].iloc[0])], "file": [data], "size": [len(data)], "planeCount": [len(a)], "width": [width], "height": [height]})

    return pixels.groupBy("frame_idx").applyInPandas(run, "frame_idx int, file binary, size long, planeCount int, width int, height int")


#: Sources of each normalised header key, first non-null wins.
HEADER_SOURCES = {"exposure_time": ("ExposureTime", "EXPTIME", "EXPOSURE"), "f_number": ("FNumber", "APERTURE"), "focal_length": ("FocalLength", "FOCALLEN")}


#: The key that holds the sensitivity for each SensitivityType, and the keys of times with those of their subseconds.
SENSITIVITY = {1: "StandardOutputSensitivity", 2: "RecommendedExposureIndex", 3: "ISOSpeed", 4: "RecommendedExposureIndex", 5: "ISOSpeed", 6: "ISOSpeed", 7: "ISOSpeed"}
TIMES = (("DateTimeOriginal", "SubSecTimeOriginal"), ("DateTimeDigitized", "SubSecTimeDigitized"), ("DateTime", "SubSecTime"), ("DATE-OBS", None), ("DATEOBS", None), ("DATE", None))


def normalise_headers(frames: DataFrame, column: str = "exif") -> DataFrame:
    """Typed columns of an open header map: numbers by the first source that has one, the sensitivity by its type (else the
    photographic one), and the first time there is with its subseconds."""
    m = F.col(column)
    number = lambda n: F.expr(f"try_cast(`{column}`['{n}'] AS double)")
    out = frames.withColumns({k: F.coalesce(*map(number, names)) for k, names in HEADER_SOURCES.items()})
    kind, iso = number("SensitivityType"), F.coalesce(number("PhotographicSensitivity"), number("ISOSpeedRatings"))
    typed = F.lit(None).cast("double")
    for k, name in SENSITIVITY.items():
        typed = F.when(kind == k, number(name)).otherwise(typed)
    out = out.withColumn("iso_speed", F.when(kind.isNotNull(), typed).otherwise(iso))
    stamps = []
    for name, part in TIMES:
        text = F.regexp_replace(F.regexp_replace(m[name], r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3"), "T", " ")
        stamps.append(F.try_to_timestamp(text if part is None else F.when(m[part].isNotNull(), F.concat(text, F.lit("."), m[part])).otherwise(text)))
    return out.withColumn("datetime", F.coalesce(*stamps))


def pixel_resolution(unit: Column, resolution: Column) -> Column:
    """Pixels per millimetre of a focal-plane resolution: unit 2 inch, 3 centimetre, 4 millimetre, 5 micrometre."""
    return resolution / F.when(unit == 2, 25.4).when(unit == 3, 10.0).when(unit == 4, 1.0).when(unit == 5, 0.001)


def field_of_view(size_px: Column, px_per_mm: Column, focal_mm: Column) -> Column:
    """Degrees that a side of the sensor sees."""
    return F.degrees(2 * F.atan(size_px / px_per_mm / (2 * focal_mm)))
