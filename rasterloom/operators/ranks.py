"""Order statistics of groups of any size: ranks by refinement of buckets, histograms with trimmed ends.

Each pass counts the values of all groups in buckets; partial aggregation keeps that to a few rows a group and task. No
group's values ever meet in one task, but for the few that remain about a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets of a pass, and values about a rank that are gathered in the end.
BUCKETS, GATHERED = 1024, 1 << 14


def _settled(df: DataFrame) -> DataFrame:
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def quantiles(pixels: DataFrame, keys: tuple[str, ...], qs: tuple[float, ...], buckets: int = BUCKETS, gathered: int = GATHERED) -> DataFrame:
    """(*keys, p): the interpolated quantiles of v in each group, exactly, as an array; groups without a valid value give no row.

    A rank's bucket is narrowed to the values that it holds, pass by pass, until they are few enough to gather; then they
    are sorted. Groups that are small from the start are gathered at once. NaN and infinity are not expected.
    """
    v = pixels.where("v is not null").select(*keys, "v")
    if (v.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= gathered:
        return v.groupBy(*keys).agg(F.percentile("v", F.array(*[F.lit(float(q)) for q in qs])).alias("p"))
    stats = v.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    ranks = [F.struct(F.lit(2 * k + up).alias("t"), (F.floor(at(q)) if not up else F.ceil(at(q))).cast("long").alias("rank")) for k, q in enumerate(qs) for up in (0, 1)]
    t = stats.select(*keys, "n", "lo", "hi", F.col("n").alias("held"), F.lit(0).cast("long").alias("below"), F.explode(F.array(*ranks)).alias("r")).select(*keys, "n", "lo", "hi", "held", "below", "r.t", "r.rank")
    t = _settled(t)
    while not t.where((F.col("held") > gathered) & (F.col("lo") < F.col("hi"))).isEmpty():
        wide = t.where((F.col("held") > gathered) & (F.col("lo") < F.col("hi")))
        b = F.least(F.lit(buckets - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets)).alias("b")
        counts = v.join(wide, list(keys)).where("v between lo and hi").groupBy(*keys, "t", b).agg(F.count("*").alias("c"), F.min("v").alias("blo"), F.max("v").alias("bhi"))
        run = F.sum("c").over(Window.partitionBy(*keys, "t").orderBy("b"))  # at most `buckets` rows
        found = counts.withColumn("run", run).join(wide, [*keys, "t"]).where("below + run > rank and below + run - c <= rank")
        found = found.select(*keys, "n", F.col("blo").alias("lo"), F.col("bhi").alias("hi"), F.col("c").alias("held"), (F.col("below") + F.col("run") - F.col("c")).alias("below"), "t", "rank")
        t = _settled(t.where((F.col("held") <= gathered) | (F.col("lo") == F.col("hi"))).unionByName(found))
    few = t.where("lo < hi")
    # ranks that share their values gather them once
    spans = few.groupBy(*keys, "lo", "hi", "below").agg(F.collect_set(F.struct("t", "rank")).alias("ranks"))
    held = v.join(spans, list(keys)).where("v between lo and hi").groupBy(*keys, "lo", "hi", "below", "ranks").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    got = held.select(*keys, "vs", "below", F.explode("ranks").alias("r")).select(*keys, "r.t", F.element_at("vs", (F.col("r.rank") - F.col("below") + 1).cast("int")).alias("value"))
    every = got.union(t.where("lo = hi").select(*keys, "t", F.col("lo").alias("value")))
    row = every.groupBy(*keys).agg(*[F.max(F.when(F.col("t") == k, F.col("value"))).alias(f"v{k}") for k in range(2 * len(qs))])
    part = lambda q: at(q) - F.floor(at(q))
    return row.join(stats.select(*keys, "n"), list(keys)).select(*keys, F.array(*[F.col(f"v{2 * k}") + (F.col(f"v{2 * k + 1}") - F.col(f"v{2 * k}")) * part(q) for k, q in enumerate(qs)]).alias("p"))


# --- histograms with trimmed ends --------------------------------------------------------------------------------


def _edge(k: Column, bins: int, log: bool) -> Column:
    """The k-th edge between lo and hi: even, or even in the logarithm after a linear map onto 0.1 to 1."""
    inner = F.col("lo") + ((F.pow(F.lit(10.0), k / bins - 1) - 0.1) * (F.col("hi") - F.col("lo")) / 0.9 if log else k * (F.col("hi") - F.col("lo")) / bins)
    return F.when(k <= 0, F.col("lo")).when(k >= bins, F.col("hi")).otherwise(inner)


def _bin(bins: int, log: bool) -> Column:
    """The bin of v between lo and hi, -1 below and `bins` from hi on; edges decide, not the rounded guess."""
    part = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    guess = F.floor(bins * (F.log10(part * 0.9 + 0.1) + 1)) if log else F.floor(part * bins)
    guess = F.greatest(F.lit(0), F.least(F.lit(bins - 1), guess))
    exact = guess - F.when(F.col("v") < _edge(guess, bins, log), 1).otherwise(0) + F.when(F.col("v") >= _edge(guess + 1, bins, log), 1).otherwise(0)
    return F.when(F.col("v") < F.col("lo"), -1).when(F.col("v") >= F.col("hi"), bins).otherwise(exact).cast("int")


def trimmed_ranges(pixels: DataFrame, bins: int = 1024, rounds: int = 64, keys: tuple[str, ...] = ("frame_idx", "plane_idx")) -> DataFrame:
    """(*keys, low, high, lo, hi, total): the extremes of each plane, and those without outliers.

    While bins at the lower end (logarithmic ones) or at the upper end (even ones) hold one value at most, the range is cut
    to where the first or last fuller bin begins or ends, for `rounds` rounds at most. Each round counts all planes at once.
    """
    v = pixels.where("v is not null").select(*keys, "v")
    r = _settled(v.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("total")))
    for _ in range(rounds):
        inside = v.join(r, list(keys)).where("v >= lo and v < hi")
        both = inside.select(*keys, F.explode(F.array(F.struct(F.lit(True).alias("log"), _bin(bins, True).alias("k")), F.struct(F.lit(False).alias("log"), _bin(bins, False).alias("k")))).alias("b")).select(*keys, "b.*")
        full = both.groupBy(*keys, "log", "k").agg(F.count("*").alias("n")).where("n > 1").groupBy(*keys).agg(F.min(F.when(F.col("log"), F.col("k"))).alias("first"), F.max(F.when(~F.col("log"), F.col("k"))).alias("last"))
        new = r.join(full, list(keys), "left").select(*keys, "low", "high", F.when(F.col("first") > 0, _edge(F.col("first"), bins, True)).otherwise(F.col("lo")).alias("lo"), F.when(F.col("last") < bins - 1, _edge(F.col("last") + 1, bins, False)).otherwise(F.col("hi")).alias("hi"), "total", ((F.col("first") > 0) | (F.col("last") < bins - 1)).alias("cut"))
        new = _settled(new)
        r = new.drop("cut")
        if new.where("cut and lo < hi").isEmpty():
            break
    return r


def trimmed_histogram(pixels: DataFrame, bins: int = 1024, rounds: int = 64, keys: tuple[str, ...] = ("frame_idx", "plane_idx")) -> DataFrame:
    """(*keys, low, high, n): the filled bins of each plane between the even and the logarithmic edges of its trimmed range,
    merged, and one bin for all values on either side of it. The upper edge of the last bin belongs to it."""
    v = pixels.where("v is not null").select(*keys, "v")
    r = trimmed_ranges(pixels, bins, rounds, keys)
    flat = F.col("lo") >= F.col("hi")
    j, k = F.when(flat, 0).otherwise(_bin(bins, False)), F.when(flat, 0).otherwise(_bin(bins, True))
    # a range that is not cut holds its own maximum
    last = ~flat & (F.col("v") == F.col("high")) & (F.col("hi") == F.col("high"))
    n = v.join(r, list(keys)).groupBy(*keys, "lo", "hi", F.col("low").alias("least"), F.col("high").alias("most"), F.when(last, bins - 1).otherwise(j).alias("j"), F.when(last, bins - 1).otherwise(k).alias("k")).agg(F.count("*").alias("n"))
    edge = lambda i, log: F.when(i < 0, F.col("least")).when(i > bins, F.col("most")).otherwise(_edge(i, bins, log))
    low = F.greatest(edge(F.col("j"), False), edge(F.col("k"), True))
    high = F.least(F.when(F.col("j") < 0, F.col("lo")).otherwise(edge(F.col("j") + 1, False)), F.when(F.col("k") < 0, F.col("lo")).otherwise(edge(F.col("k") + 1, True)))
    single = F.col("lo") >= F.col("hi")
    return n.select(*keys, F.when(single, F.col("least")).otherwise(low).alias("low"), F.when(single, F.col("hi")).otherwise(high).alias("high"), "n")


def trimmed_mode(histogram: DataFrame, keys: tuple[str, ...] = ("frame_idx", "plane_idx")) -> DataFrame:
    """(*keys, mode): the centre of the fullest bin, the lowest of equals."""
    return histogram.groupBy(*keys).agg(F.min_by((F.col("low") + F.col("high")) / 2, F.struct(-F.col("n"), "low")).alias("mode"))


def histogram_quantile(histogram: DataFrame, q: float, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """(*keys, value): the centre of the first bin at which the planes' counts together reach q of all."""
    w = Window.partitionBy(*keys)  # bins, not pixels
    run = histogram.withColumn("centre", (F.col("low") + F.col("high")) / 2).withColumns({"run": F.sum("n").over(w.orderBy("centre")), "total": F.sum("n").over(w)})
    return run.where(F.col("run") >= F.col("total") * q).groupBy(*keys).agg(F.min("centre").alias("value"))
