"""CSV tables with plane markers, catalogues, and their writers."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _number(cell: str) -> float | None:
    try:
        v = float(cell)
    except ValueError:
        return None
    return None if v != v else v


def parse_planes(text: str) -> list[dict]:
    """Pixels of one file: `# name` opens a plane; a first row that is not all numbers after its label is the header (type,
    then columns); every other row is a label and values; cells that are no numbers are invalid."""
    out, plane, y, names, columns, kind = [], 0, 0, [], [], "table"
    header = True
    for row in csv.reader(io.StringIO(text)):
        if not row:
            continue
        if row[0].startswith("#"):
            if names or y:
                plane += 1
            names.append(row[0][1:].strip())
            y, header = 0, True
            continue
        if header:
            header = False
            if any(_number(c) is None for c in row[1:]):
                kind, columns = row[0], row[1:]
                continue
        for x, cell in enumerate(row[1:]):
            out.append({"plane_idx": plane, "plane": names[-1] if names else "", "type": kind, "y": y, "x": x, "line": row[0], "column": columns[x] if x < len(columns) else str(x), "v": _number(cell)})
        y += 1
    return out


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(frame_idx, plane_idx, plane, type, y, x, line, column, v) of the files under a path, one frame a file in path order."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))
    numbers = files.select("source_file").withColumn("frame_idx", F.row_number().over(Window.orderBy("source_file")) - 1)  # a row a file

    def run(parts):
        for pdf in parts:
            for name, text in zip(pdf["source_file"], pdf["text"], strict=True):
                rows = parse_planes(text)
                if rows:
                    yield pd.DataFrame(rows).assign(source_file=name)

    pixels = files.mapInPandas(run, "plane_idx int, plane string, type string, y int, x int, line string, column string, v double, source_file string")
    return pixels.join(numbers, "source_file").withColumn("frame_idx", F.col("frame_idx").cast("int"))


def csv_rows(pixels: DataFrame, label: str = "line", column: str = "column", kind: str = "table") -> DataFrame:
    """(frame_idx, n, row): the lines of the inverse file, whole rows whatever the width; a plane mark only with two planes or more."""
    cells = pixels.groupBy("frame_idx", "plane_idx", "y").agg(F.array_sort(F.collect_list(F.struct("x", F.coalesce(F.col("v").cast("string"), F.lit("")).alias("v"), F.col(column).alias("c")))).alias("cells"), F.min(label).alias("label"), F.min("plane").alias("plane"))
    text = F.concat_ws(",", F.col("label"), F.col("cells.v"))
    planes = pixels.groupBy("frame_idx").agg(F.countDistinct("plane_idx").alias("planes"))
    head = F.when(F.col("y") == 0, F.concat(F.when(F.col("planes") > 1, F.array(F.concat(F.lit("# "), "plane"))).otherwise(F.array().cast("array<string>")), F.array(F.concat_ws(",", F.lit(kind), F.col("cells.c"))))).otherwise(F.array().cast("array<string>"))
    rows = cells.join(planes, "frame_idx").select("frame_idx", "plane_idx", "y", F.posexplode(F.concat(head, F.array(text))).alias("part", "row"))
    return rows.select("frame_idx", "plane_idx", "y", "part", "row")


def write_csv(pixels: DataFrame, path: str, **names: str) -> None:
    """One folder of a text file for each frame."""
    rows = csv_rows(pixels, **names)
    rows.repartition("frame_idx").sortWithinPartitions("frame_idx", "plane_idx", "y", "part").select("frame_idx", "row").write.partitionBy("frame_idx").text(path)


def read_catalog(spark: SparkSession, path: str, names: tuple[str, str, str, str] = ("HIP", "RArad", "DErad", "Hpmag")) -> DataFrame:
    """(id, ra, dec, mag) of a tab-separated catalogue with # comments; rows with a bad number are dropped; ordered by id."""
    raw = spark.read.csv(path, sep="\t", comment="#", header=True)
    cast = lambda n, t: F.expr(f"try_cast(trim(`{n}`) AS {t})")
    out = raw.select(cast(names[0], "bigint").alias("id"), *[cast(n, "double").alias(a) for n, a in zip(names[1:], ("ra", "dec", "mag"), strict=True)])
    return out.dropna().orderBy("id")
