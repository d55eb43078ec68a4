"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

A line is cut into threshold + 1 segments; of two lines within the threshold, one segment of the shorter one stands
unchanged in the longer one, shifted by a few places at most. So each line is indexed by its segments, keyed by its
length and the segment's number, and probed by its own substrings at the places where such a segment can stand for each
shorter length. Candidates are verified by a banded bit-parallel edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, sized, written
from .components import components

#: Characters from which a line may differ by all EDITS edits from a near duplicate; shorter ones by fewer, in proportion.
LEAST, EDITS = 24, 2
#: Lines that own a segment from which those that meet it are told apart by rings of cells instead, cells of a line, and
#: lines of which a task makes the keys of all rings (about 900 each).
HOT, CELLS, CROWD = 16, 32, 64


def lines(docs: DataFrame, id_col: str, text_col: str, least: int = 1) -> DataFrame:
    """(doc, copy, pos, line, h, len) of every line of at least `least` characters; copy tells apart the texts of one id,
    pos counts all lines from 0."""
    split = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("copy"), F.split(F.col(text_col), "\n").alias("lines"))
    every = split.select("doc", "copy", F.posexplode("lines").alias("pos", "line"))
    return every.select("doc", "copy", "pos", "line", F.length("line").alias("len")).where(F.col("len") >= least).withColumn("h", F.xxhash64("line"))


def _start(i: str, size: str, parts: int) -> str:
    """SQL of where part i of a line of this length starts (from 0): even parts, the longer ones last. Part `parts` is the end."""
    return f"({i} * (({size}) div {parts}) + greatest(0, {i} - {parts} + ({size}) % {parts}))"


def _key(i: str, size: str, parts: int, shift: str = "0") -> str:
    """SQL of the key of the substring where part i of a line of length `size` can stand, or NULL beyond the line's ends."""
    begin, end = f"{_start(i, size, parts)} + {shift}", f"{_start(f'({i} + 1)', size, parts)} + {shift}"
    return f"if({begin} >= 0 and {end} <= len, xxhash64({size}, {i}, substring(line, {begin} + 1, {end} - ({begin}))), null)"


def _places(edits: int) -> list[tuple[int, int, int]]:
    """(d, i, s): where part i of edits + 1 parts can stand, shifted by s, in a line longer by d; those of the part itself first.

    A part that is shifted by s within lines whose lengths differ by d needs |s| edits to its left and |d - s| to its
    right. Some part i has at most i edits to its left and edits - i to its right.
    """
    every = [(d, i, s) for d in range(edits + 1) for i in range(edits + 1) for s in range(-edits, edits + 1)]
    return sorted((p for p in every if abs(p[2]) <= p[1] and abs(p[0] - p[2]) <= edits - p[1]), key=lambda p: (p[0], abs(p[2])))


def classes(edits: int, least: int) -> list[tuple[int, int, int | None]]:
    """(k, low, high): shorter lines of low to high - 1 characters (high None: and more) link within k edits."""
    bounds = [max(least, -(-LEAST * k // edits)) for k in range(1, edits + 1)]
    return [(k, low, high) for k, low, high in zip(range(1, edits + 1), bounds, [*bounds[1:], None], strict=True) if high is None or low < high]


def segment_keys(once: DataFrame, edits: int, least: int) -> DataFrame:
    """(key, h, own) of each line's own segments (own = 1), and of its substrings where a segment of a shorter line, or a
    shifted one of an equally long line, can stand (own = 0). A key holds the shorter line's length and the segment's number."""
    places = [(k + 1, low + d, high + d if high else 1 << 31, d, i, s, int(d == s == 0)) for k, low, high in classes(edits, least) for d, i, s in _places(k)]
    at = F.explode(F.array(*[F.struct(*[F.lit(x).cast("int" if x < 1 << 31 else "long").alias(n) for n, x in zip(("parts", "low", "high", "d", "i", "s", "own"), p, strict=True)]) for p in places])).alias("at")
    spread = once.select("h", "line", "len", at).where("len >= at.low and len < at.high")
    spread = spread.select("h", "line", "len", "at.parts", "at.i", "at.s", "at.own", (F.col("len") - F.col("at.d")).alias("size"))
    return spread.select(F.expr(_key("i", "size", "parts", "s")).alias("key"), "h", "own").where("key is not null")


def ring_pairs(crowd: DataFrame, edits: int, least: int) -> DataFrame:
    """(h, h2) candidates among lines that share a segment with many others; h is the shorter line or as long.

    A line is cut into CELLS cells. A cell (the centre), its two neighbours, and so on up to the rest of the line on both
    sides are edits + 1 disjoint parts, so one of them stands whole in any line within the threshold: the rest at both
    ends, another part with each of its two cells shifted by a few places. Of all centres the one whose parts the fewest
    lines meet is taken: where the variants of one line differ, the parts about it are met only by those that differ there.
    """
    cells = f"greatest({2 * edits + 1}, least({CELLS}, size div 2))"
    cell = lambda i, shift: f"substring(line, {_start(i, 'size', cells)} + {shift} + 1, {_start(f'({i} + 1)', 'size', cells)} - {_start(i, 'size', cells)})"
    ends = f"substring(line, 1, {_start('(c - r + 1)', 'size', cells)}), substring(line, {_start('(c + r)', 'size', cells)} + d + 1, size)"
    far = range(-edits, edits + 1)
    met = [(d, r, s, t) for d in range(edits + 1) for r in range(edits) for s in far for t in far if abs(s) + abs(t - s) + abs(d - t) <= edits and (r or s == t)]
    met += [(d, edits, 0, d) for d in range(edits + 1)]

    # for a line longer by d, the two cells r places beside the centre c, shifted by s and by t; own: the line's own parts
    place = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip("drst", p, strict=True)]) for p in met])).alias("at")
    at = crowd.select("h", "line", "len", place).select("h", "line", "len", "at.*", (F.col("len") - F.col("at.d")).alias("size")).where(F.col("size") >= least)
    at = at.select("*", F.expr(f"explode(sequence({edits}, {cells} - {edits + 1}))").alias("c"))
    inside = f"{_start('(c - r)', 'size', cells)} + s >= 0 and {_start('(c + r + 1)', 'size', cells)} + t <= len"
    key = f"if(r = {edits}, xxhash64(size, c, r, {ends}), xxhash64(size, c, r, {cell('(c - r)', 's')}, if(r = 0, '', {cell('(c + r)', 't')})))"
    probe = written(at.where(inside).select(F.col("h").alias("h2"), "d", "c", F.expr("d = 0 and s = 0 and t = 0").alias("own"), F.expr(key).alias("key")), "probes")
    parts = probe.where("own").select(F.col("h2").alias("h"), "c", "key")
    counts = probe.groupBy("key").agg(F.count("*").alias("n"))
    centre = parts.join(counts, "key").groupBy("h", "c").agg(F.sum("n").alias("n")).groupBy("h").agg(F.min_by("c", F.struct("n", "c")).alias("c"))
    return parts.join(centre, ["h", "c"]).select("h", "key").join(probe.select("h2", "d", "key"), "key").where("h < h2 or (d > 0 and h > h2)").select("h", "h2")


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def edit_distance(a: str, b: str, edits: int) -> Column:
    """Edit distance of two strings (columns) up to `edits`, or a greater number; len(b) - len(a) lies within `edits`.

    One step per character of b updates a band of 2 edits + 1 rows as bits of a long: bit r of step j is row
    j - edits + r of the table. vp and vn mark where a row exceeds or falls below the one above it.
    """
    band = 2 * edits + 1
    full = (1 << band) - 1
    hits = " + ".join(f"if(j - {edits - r} between 1 and m and element_at(x, greatest(1, least(m, j - {edits - r}))) = element_at(y, j), {1 << r}L, 0L)" for r in range(band))
    d0 = f"((((e & s.vp) + s.vp) ^ s.vp) | e | s.vn) & {full}L"
    # on the lowest diagonal until row m, then along row m
    dist = f"s.d + if(j + {edits} <= m, if((d0 & {1 << (band - 1)}L) = 0, 1, 0), if((shiftright(hp, m - j + {edits}) & 1L) = 1, 1, 0) - if((shiftright(hn, m - j + {edits}) & 1L) = 1, 1, 0))"
    state = f"named_struct('vp', (hn | ({full}L & ~(shiftright(d0, 1) | hp))), 'vn', (shiftright(d0, 1) & hp), 'd', {dist})"
    step = _let(hits, "e", _let(d0, "d0", _let(f"(s.vn | ({full}L & ~(d0 | s.vp)))", "hp", _let("(d0 & s.vp)", "hn", state))))
    first = f"named_struct('vp', {full ^ ((1 << edits) - 1)}L, 'vn', 0L, 'd', least(m, {edits}))"
    fold = f"if(size(y) = 0, m, aggregate(sequence(1, size(y)), {first}, (s, j) -> {step}, s -> s.d))"
    chars = lambda c: f"filter(split({c}, ''), c -> c != '')"
    return F.expr(_let(chars(a), "x", _let(chars(b), "y", _let("size(x)", "m", fold))))


def middles(a: str, b: str, la: str, lb: str) -> tuple[str, str]:
    """SQL of a struct of the lengths that two strings (of la and lb characters) share at their beginnings (p) and then at
    their ends (s), and of what is left of string c of l characters given that struct as t. Distances do not change without the shared parts."""
    most = f"least({la}, {lb})"
    steps = f"transform(sequence(cast(floor(log2(greatest(1, {most}))) as int), 0, -1), k -> shiftleft(1, k))"
    prefix = f"aggregate({steps}, 0, (p, k) -> if(p + k <= {most} and substring({a}, p + 1, k) = substring({b}, p + 1, k), p + k, p))"
    suffix = f"aggregate({steps}, 0, (s, k) -> if(p + s + k <= {most} and substring({a}, {la} - s - k + 1, k) = substring({b}, {lb} - s - k + 1, k), s + k, s))"
    return _let(prefix, "p", f"named_struct('p', p, 's', {suffix})"), "substring({c}, t.p + 1, {l} - t.p - t.s)"


def near_lines(found: DataFrame, edits: int = EDITS, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(h, root) of the lines (of lines()) that link to others, root being shared by all that links reach; and (h, first,
    n), the first place and the count of every line.

    Two lines link within as many edits as the shorter one allows: `edits` from LEAST characters on, fewer in proportion
    below that. Lines that allow none are only grouped by their hash.
    """
    firsts = written(found.groupBy("h").agg(F.min(F.struct("doc", "copy", "pos")).alias("first"), F.count("*").alias("n")), "firsts")
    twice = firsts.where("n > 1").select("h", "first")
    once = found.join(sized(twice), "h", "left").where("first is null or struct(doc, copy, pos) = first").select("h", "line", "len")
    return components(line_links(once, edits, least), "h", "h2").withColumnsRenamed({"id": "h", "component": "root"}), firsts


def line_links(once: DataFrame, edits: int, least: int) -> DataFrame:
    """(h, h2) of the lines of at least `least` characters, each given once, that link (see near_lines)."""
    low = classes(edits, least)[0][1]
    within = Window.partitionBy("key")
    keys = segment_keys(once.where(F.col("len") >= low), edits, least)
    met = keys.withColumns({"n": F.count("*").over(within), "owners": F.sum("own").over(within)}).where("n > 1 and owners > 0")
    met = written(met.select("key", "h", "own", "owners"), "met")
    few = met.where(F.col("owners") <= HOT)
    pairs = few.where("own = 1").select("key", "h").join(few.select("key", F.col("h").alias("h2"), F.col("own").alias("both")), "key").where("h < h2 or (both = 0 and h > h2)").select("h", "h2")
    crowded = written(met.where(F.col("owners") > HOT).select("h").distinct(), "crowded")
    if not crowded.isEmpty():
        crowd = written(once.join(sized(crowded), "h", "left_semi").dropDuplicates(["h"]), "crowd")
        crowd = crowd.repartition(max(1, crowd.count() // CROWD))
        for k, bottom, top in classes(edits, least):
            pairs = pairs.union(ring_pairs(crowd if top is None else crowd.where(F.col("len") < top + k), k, bottom))
    pairs = written(pairs.distinct(), "pairs")
    wanted = pairs.select("h").union(pairs.select("h2")).distinct()
    texts = written(once.join(sized(wanted), "h", "left_semi").dropDuplicates(["h"]), "texts")
    both = pairs.join(texts.withColumnsRenamed({"line": "a", "len": "la"}), "h").join(texts.select(F.col("h").alias("h2"), F.col("line").alias("b"), F.col("len").alias("lb")), "h2")
    begin, end = _start("k", "la", "12"), _start("(k + 1)", "la", "12")
    alike = f"size(filter(sequence(0, 11), k -> contains(substring(b, greatest(0, {begin} - {edits}) + 1, {end} - {begin} + {2 * edits}), substring(a, {begin} + 1, {end} - {begin})))) >= {12 - edits}"
    shared, rest = middles("a", "b", "la", "lb")
    both = both.where("la < lb or (la = lb and h < h2)").where(alike).withColumn("t", F.expr(shared))
    both = both.select("h", "h2", "la", F.expr(rest.format(c="a", l="la")).alias("a"), F.expr(rest.format(c="b", l="lb")).alias("b"))
    both = written(both, "middles")  # or the filter would be pushed below, and the shared parts be sought once a use
    if edits > 1:  # the first and the last edit stand at the ends, so one of edits - 1 parts of what lies between is whole
        begin, end = _start("k", "(length(a) - 2)", str(edits - 1)), _start("(k + 1)", "(length(a) - 2)", str(edits - 1))
        both = both.where(f"length(a) < 3 or exists(sequence(0, {edits - 2}), k -> contains(b, substring(a, {begin} + 2, {end} - {begin})))")
    allowed = "case " + " ".join(f"when la >= {bottom} then {k}" for k, bottom, _ in reversed(classes(edits, least))) + " else 0 end"
    return written(both.where(edit_distance("a", "b", edits) <= F.expr(allowed)).select("h", "h2"), "links")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = 1) -> DataFrame:
    """(doc, copy, pos, first_doc, first_pos) of every line of at least `least` characters that repeats an earlier one.

    Lines are classed with equal ones and with those within `edits` edits (fewer for lines under LEAST characters, see
    near_lines), directly or through others; the first of a class, by document id, text (copy, a hash) and place, is not listed. Empty lines,
    null texts and rows with a null id take no part; rows that share an id and the text are one document, of which all stay alike. Lines are told apart by a 64-bit hash. Very long lines are compared whole.
    """
    found = lines(docs, id_col, text_col, least)
    near, firsts = near_lines(found, edits, least)
    classes = firsts.join(near, "h", "left").withColumn("root", F.coalesce("root", "h"))
    roots = classes.where("n > 1 or root != h").select("root").union(near.select("root")).distinct()
    some = classes.join(roots, "root", "left_semi")
    least_of = some.groupBy("root").agg(F.min("first").alias("least"))
    some = some.join(least_of, "root").select("h", "least")
    out = found.select("doc", "copy", "pos", "h").join(sized(some), "h").where("struct(doc, copy, pos) != least")
    return out.select("doc", "copy", "pos", F.col("least.doc").alias("first_doc"), F.col("least.pos").alias("first_pos"))


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = 1) -> DataFrame:
    """The documents without the lines that repeated_lines lists, columns as before; the other lines keep their order.

    A document that loses every line goes; one that had no text stays as it is.
    """
    key, copy, gone = (fresh(docs, x) for x in ("line_doc", "line_copy", "line_places"))
    places = repeated_lines(docs, id_col, text_col, edits, least).groupBy("doc", "copy").agg(F.collect_set("pos").alias(gone)).withColumnsRenamed({"doc": key, "copy": copy})
    out = docs.join(sized(written(places, "places")), (docs[id_col] == F.col(key)) & (F.xxhash64(docs[text_col]) == F.col(copy)), "left")
    text, whole = f"`{text_col}`", F.col(gone).isNull()
    # places are looked up as a set: a document costs its length, however many of its lines go
    kept = F.expr(_let(f"split({text}, '\n')", "x", f"transform(array_except(sequence(0, size(x) - 1), `{gone}`), i -> x[i])"))
    left = fresh(docs, "line_left")
    out = out.withColumn(left, F.when(~whole, kept)).where(whole | (F.size(left) > 0))
    return out.select(*[F.when(F.col(left).isNull(), docs[c]).otherwise(F.array_join(left, "\n")).alias(c) if c == text_col else docs[c] for c in docs.columns])
