"""Exact copies by progressive refinement, in DataFrame functions only.

Texts are grouped by their length, then by a hash of their beginning, then by a hash of the whole of them; each step looks
only at what shares its group with something else. What survives the first two steps is told to the last one by a bitmap
of fixed size, so that whole texts are hashed where they lie and never travel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, sized, written

#: Characters of the beginning that the second step compares.
PREFIX = 64
#: Bits of the bitmap of surviving groups (8 MB), dealt out over rows of 4 KB. A chance hit only costs a hash.
BITS, ROW = 1 << 26, 1 << 15


def one_space(text: Column) -> Column:
    """The text with each run of white space replaced by one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def _bitmap(groups: DataFrame, key: Column) -> DataFrame:
    """(slot, bits): the groups' keys as a bitmap, at most BITS / ROW rows."""
    at = groups.select(F.pmod(key, F.lit(BITS)).alias("at"))
    return at.groupBy(F.expr(f"at div {ROW}").alias("slot")).agg(F.bitmap_construct_agg(F.expr(f"at % {ROW}")).alias("bits"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), form: Callable[[Column], Column] = one_space) -> DataFrame:
    """One row per document: id, the columns named in keep, keep_id (id of the row of the same text that stays),
    group_size, kept.

    Texts are the same where `form` makes them identical; null counts as empty. The smallest id stays, a null id last;
    of rows that share the smallest id exactly one. Other columns are ignored, an empty table gives no rows. A group of
    copies costs each task one row of a partial aggregate, and its rows meet its one result in a join that can be split.
    """
    text = form(F.coalesce(F.col(text_col), F.lit("")))
    marks = lambda t: (F.length(t).alias("length"), F.xxhash64(F.substring(t, 1, PREFIX)).alias("prefix"))
    body = docs.select(text.alias("text"))
    short = written(body.select(*marks(F.col("text"))), "marks")
    lengths = short.groupBy("length").agg(F.count("*").alias("n")).where("n > 1")
    suspects = short.join(sized(lengths.select("length")), "length", "left_semi").groupBy("length", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    bits = F.broadcast(_bitmap(suspects, F.xxhash64("length", "prefix")))

    names = [c if c not in ("text", "row", "at", "slot", "bits", "whole", "length", "prefix") else fresh(docs, f"kept_{c}") for c in keep]
    some = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], text.alias("text"))
    some = some.withColumn("at", F.pmod(F.xxhash64(*marks(F.col("text"))), F.lit(BITS)))
    some = some.join(bits, F.expr(f"at div {ROW}") == F.col("slot"), "left")
    hit = F.expr(f"bits is not null and shiftright(cast(conv(hex(substring(bits, cast((at % {ROW}) div 8 as int) + 1, 1)), 16, 10) as int), cast(at % 8 as int)) & 1 = 1")
    rows = some.select("id", *names, F.monotonically_increasing_id().alias("row"), F.when(hit, F.unhex(F.sha2("text", 256))).alias("whole"))
    rows = written(rows, "rows")

    met = rows.where("whole is not null")
    groups = met.groupBy("whole").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("least"), F.count("*").alias("n")).where("n > 1")
    alone = rows.where("whole is null").select("id", *names, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    found = met.join(sized(written(groups, "groups")), "whole", "left")
    one = F.col("n").isNull()
    found = found.select("id", *names, F.when(one, F.col("id")).otherwise(F.col("least.id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (one | (F.col("row") == F.col("least.row"))).alias("kept"))
    return alone.union(found).withColumnsRenamed(dict(zip(names, keep, strict=True)))
