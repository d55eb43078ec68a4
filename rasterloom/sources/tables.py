"""Rasters, tables and point sets derived from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Planes, width and height of the two rasters.
LI_PLANES, LI_SIZE, EM_PLANES, EM_SIZE = 3, 32, 3, 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse stack of 32 x 32 frames of three planes with whole values; absent cells are invalid."""
    plane = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    keys = [(F.col("l_linenumber") - 1).alias("frame_idx"), plane.alias("plane_idx"), (F.col("l_orderkey") % 32).cast("int").alias("y"), (F.col("l_partkey") % 32).cast("int").alias("x")]
    return read(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.sum("l_quantity").alias("v"))


def raster_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense stack of small frames of three planes of 8 x 8 signed values; frames that lack a plane are left out."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "e"))
    out = e.select(F.floor(F.col("vec_id") / 3).cast("int").alias("frame_idx"), (F.col("vec_id") % 3).cast("int").alias("plane_idx"), F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"), F.col("e").cast("double").alias("v"))
    last = read(spark, sf_dir, "embeddings").agg(F.floor(F.count("*") / 3).cast("int").alias("n"))
    return out.join(F.broadcast(last), F.col("frame_idx") < F.col("n")).drop("n")  # one row


def table_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of users by hours with whole values, as pixels (y the user, x the hour)."""
    v = F.sum(F.round(F.col("value") * 100).cast("long")).cast("double")
    return read(spark, sf_dir, "events").groupBy(F.lit(0).alias("frame_idx"), F.lit(0).alias("plane_idx"), F.col("user_id").cast("int").alias("y"), F.hour("ts").alias("x")).agg(v.alias("v"))


def points_pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue-like point set: id, ra, dec, mag, and scattered image places x, y in frames of 1024 points."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(F.floor(k / 1024).cast("int").alias("frame_idx"), k.alias("id"), ((k * 37) % 360).cast("double").alias("ra"), ((k * 61) % 181 - 90).cast("double").alias("dec"), ((k * 13) % 100 / 10.0).cast("double").alias("mag"), ((k * k * 37 + k * 97) % 1021).cast("double").alias("x"), ((k * k * 53 + k * 11) % 1019).cast("double").alias("y"))


LI_SQL = """li AS (
    SELECT l_linenumber - 1 AS frame_idx, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS plane_idx,
           CAST(l_orderkey % 32 AS INT) AS y, CAST(l_partkey % 32 AS INT) AS x, SUM(l_quantity) AS v
    FROM lineitem GROUP BY ALL)"""
EM_SQL = """em AS (
    SELECT CAST(vec_id // 3 AS INT) AS frame_idx, CAST(vec_id % 3 AS INT) AS plane_idx, CAST(pos // 8 AS INT) AS y,
           CAST(pos % 8 AS INT) AS x, CAST(embedding[pos + 1] AS DOUBLE) AS v
    FROM embeddings, (SELECT unnest(range(64)) AS pos)
    WHERE vec_id // 3 < (SELECT count(*) // 3 FROM embeddings))"""
EV_SQL = """ev AS (
    SELECT 0 AS frame_idx, 0 AS plane_idx, CAST(user_id AS INT) AS y, CAST(extract(hour FROM ts) AS INT) AS x,
           CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS v FROM events GROUP BY ALL)"""
PT_SQL = """pt AS (
    SELECT CAST(c_custkey // 1024 AS INT) AS frame_idx, c_custkey AS id, CAST((c_custkey * 37) % 360 AS DOUBLE) AS ra, CAST((c_custkey * 61) % 181 - 90 AS DOUBLE) AS dec,
           ((c_custkey * 13) % 100) / 10.0::DOUBLE AS mag, CAST((c_custkey * c_custkey * 37 + c_custkey * 97) % 1021 AS DOUBLE) AS x, CAST((c_custkey * c_custkey * 53 + c_custkey * 11) % 1019 AS DOUBLE) AS y
    FROM customer)"""
