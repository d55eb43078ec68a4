"""SimHash near-duplicates: fingerprints of word shingles, compared exactly in tiles.

Distinct fingerprints are dealt into blocks by the population counts of their two halves. Two blocks are compared only
if these counts differ by at most the radius in sum; each comparison is a numpy exclusive-or and bit count over tiles.
A pair of blocks hands back a star for each group that it links, not all pairs.

keep_one goes by the texts themselves: longer fingerprints of the sets of shingles propose pairs, compared exactly in
tiles among sets of similar sizes, and a pair links only if the sets' Jaccard similarity, taken exactly, is high enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, bound_batches, byte_texts, checkpointed, fresh, sized, written
from .components import components

#: Fingerprints in one block, and rows of it that meet another block at once.
BLOCK, TILE = 2048, 512
SEED = 42
#: Longs of a set's fingerprint, how many of them are compared first, and classes of sizes within one similarity ratio.
LONGS, FIRST, CLASSES = 4, 2, 4
#: Candidates of a set from which it is compared within blocks that carry the sets, and hashes of shingles in such a block.
DENSE, SET_LONGS = 32, 1 << 19
#: Standard deviations beyond the mean distance of sets just similar enough that still make a candidate.
MARGIN = 6.0


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """64-bit hashes of the word shingles of a lower-cased (A-Z) text, repeats included; a shorter text is one shingle."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, "<u8")
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(tokens) > words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8")


def fingerprint(text: bytes, words: int) -> int:
    """64-bit SimHash of the word shingles of a lower-cased (A-Z) text; 0 without words."""
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fingerprint long) of every document, whole texts, one pass without a shuffle. Null text: no words."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(parts: Batches) -> Batches:
        for b in parts:
            got = np.array([fingerprint(t, words) for t in byte_texts(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64), pa.int64())], names=["id", "fingerprint"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, fingerprint long")


def _star(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links u-v among n nodes, as (node, smallest node of its group) for the other nodes of each group."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            node = np.flatnonzero(label != np.arange(n))
            return node, label[node]
        label = new


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices (into a, into b) of the fingerprints that differ in at most radius bits; same: each pair of one block once."""
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(a), TILE):
        first = at if same else 0
        u, v = np.nonzero(np.bitwise_count(a[at : at + TILE, None] ^ b[None, first:]) <= radius)
        u, v = u + at, v + first
        if same:
            u, v = u[u < v], v[u < v]
        us.append(u)
        vs.append(v)
    return np.concatenate(us), np.concatenate(vs)


def fingerprint_links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """(u, v) ids that connect all fingerprints within the radius. nodes: (id long, fingerprint long), distinct fingerprints.

    Each pair of blocks gives at most as many rows as it has fingerprints: stars that keep every connection.
    """
    bound_batches(nodes.sparkSession)
    half = lambda shift: F.bit_count(F.shiftrightunsigned("fingerprint", shift).bitwiseAND(F.lit(0xFFFFFFFF))).cast("int")
    nodes = nodes.withColumns({"hi": half(32), "lo": half(0)})
    cells = nodes.groupBy("hi", "lo").count().select("hi", "lo", F.ceil(F.col("count") / BLOCK).cast("int").alias("salts"))
    cells = F.broadcast(checkpointed(cells))  # 33 x 33 rows at most
    salted = nodes.join(cells, ["hi", "lo"]).withColumn("salt", F.pmod(F.xxhash64("fingerprint", "id"), F.col("salts")).cast("int"))
    blocks = salted.groupBy("hi", "lo", "salt").agg(F.collect_list(F.struct("id", "fingerprint")).alias("rows"))
    blocks = checkpointed(blocks)
    steps = [(h, low) for h in range(radius + 1) for low in range(-radius, radius + 1) if h + abs(low) <= radius and (h, low) >= (0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(low).alias("l")) for h, low in steps]))
    left = blocks.select("hi", "lo", "salt", F.col("rows").alias("left"), step.alias("step"))
    left = left.select(F.col("hi").alias("hi0"), F.col("lo").alias("lo0"), F.col("salt").alias("salt0"), "left", (F.col("hi") + F.col("step.h")).alias("hi"), (F.col("lo") + F.col("step.l")).alias("lo"))
    left = left.join(cells, ["hi", "lo"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    own = (F.col("hi") == F.col("hi0")) & (F.col("lo") == F.col("lo0"))
    left = left.where(~own | (F.col("salt0") <= F.col("salt"))).withColumn("same", own & (F.col("salt0") == F.col("salt")))
    pairs = left.join(blocks, ["hi", "lo", "salt"]).select("left.id", "left.fingerprint", F.col("rows.id").alias("id2"), F.col("rows.fingerprint").alias("fingerprint2"), "same")

    def run(parts: Batches) -> Batches:
        for batch in parts:
            for i in range(batch.num_rows):
                ids, fps, ids2, fps2 = (np.asarray(batch.column(k)[i].values) for k in range(4))
                same = batch.column(4)[i].as_py()
                u, v = tile_links(fps.view(np.uint64), fps2.view(np.uint64), radius, same)
                if len(u):
                    all_ids = ids if same else np.concatenate((ids, ids2))
                    order = np.argsort(all_ids, kind="stable")  # the root of a star is the smallest id
                    place = np.empty_like(order)
                    place[order] = np.arange(len(order))
                    node, root = _star(place[u], place[v if same else v + len(ids)], len(order))
                    got = all_ids[order]
                    yield pa.RecordBatch.from_arrays([pa.array(got[node]), pa.array(got[root])], names=["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(id, fingerprint long, component): every document with its fingerprint and the smallest id reachable by links.

    Documents link when their fingerprints differ in at most radius bits; equal fingerprints (copies, and all texts
    without words) form one node before any comparison, so a group of copies costs one row. ids are longs; a row whose
    id is null keeps its fingerprint and takes part only through other rows' ids. An empty table gives no rows.
    """
    found = checkpointed(fingerprints(docs, id_col, text_col, words))
    nodes = found.groupBy("fingerprint").agg(F.min("id").alias("id")).where("id is not null")
    nodes = checkpointed(nodes)
    groups = components(fingerprint_links(nodes, radius), "u", "v")
    classes = nodes.join(groups, "id", "left").select("fingerprint", F.coalesce("component", "id").alias("component"))
    return found.join(classes, "fingerprint", "left").select("id", "fingerprint", "component")


def _set_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of LONGS longs of a set of distinct shingle hashes."""
    counts = np.zeros(64 * LONGS, dtype=np.int64)
    salts = np.arange(1, LONGS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(shingles), 1 << 13):
        z = shingles[at : at + (1 << 13), None] + salts
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        counts += np.unpackbits(z.view(np.uint8).reshape(len(z), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(shingles), bitorder="little").view("<u8")


def _key(text: bytes) -> int:
    """Signed 64-bit hash of a text's lower-cased words; 0 without words."""
    joined = b" ".join(text.lower().split())
    return int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).view(np.int64)) if joined else 0


def set_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(id, key, n, f0, f1, ...) of every document: hash of its words, distinct shingles, fingerprint of their set."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    names = ["id", "key", "n", *[f"f{k}" for k in range(LONGS)]]

    def run(parts: Batches) -> Batches:
        for b in parts:
            keys, sizes, prints = [], [], np.zeros((b.num_rows, LONGS), np.uint64)
            for i, text in enumerate(byte_texts(b.column(1))):
                found = np.unique(shingle_hashes(text, words))
                keys.append(_key(text))
                sizes.append(len(found))
                prints[i] = _set_fingerprint(found)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), *[pa.array(prints[:, k].copy().view(np.int64)) for k in range(LONGS)]], names=names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, key long, n int, " + ", ".join(f"f{k} long" for k in range(LONGS)))


def candidate_radius(bits: int, least: float) -> int:
    """Bits by which the fingerprints of two sets of this similarity differ, MARGIN standard deviations above the mean."""
    p = np.arccos(2 * least / (1 + least)) / np.pi
    return int(bits * p + MARGIN * np.sqrt(bits * p * (1 - p)))


def _block_pairs(nodes: DataFrame, least: float, fields: list[str], rows: Column) -> DataFrame:
    """(same, a_..., b_...): the arrays of `fields` of every two blocks of sets whose sizes do not rule out the similarity.

    Blocks hold sets of one class of sizes, dealt out by `rows`, the number of blocks that a class of `count` sets needs.
    """
    width = float(-np.log(least) / CLASSES)
    nodes = nodes.withColumn("size", F.floor(F.log("n") / width + 1e-9).cast("int"))
    cells = F.broadcast(checkpointed(nodes.groupBy("size").agg(F.count("*").alias("count"), F.max("n").alias("most")).select("size", F.ceil(rows).cast("int").alias("salts"))))
    salted = nodes.join(cells, "size").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int"))
    blocks = checkpointed(salted.groupBy("size", "salt").agg(F.collect_list(F.struct(*fields)).alias("rows")))
    left = blocks.select(F.col("size").alias("size0"), F.col("salt").alias("salt0"), F.col("rows").alias("left"), F.explode(F.sequence(F.lit(0), F.lit(CLASSES))).alias("step")).withColumn("size", F.col("size0") + F.col("step"))
    left = left.join(cells, "size").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    own = F.col("step") == 0
    left = left.where(~own | (F.col("salt0") <= F.col("salt"))).withColumn("same", own & (F.col("salt0") == F.col("salt")))
    return left.join(blocks, ["size", "salt"]).select("same", *[F.col(f"left.{c}").alias(f"a_{c}") for c in fields], *[F.col(f"rows.{c}").alias(f"b_{c}") for c in fields])


def _near_rows(a: list[np.ndarray], b: list[np.ndarray], same: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (in a, in b) of sets that may be similar and whose labels differ, and the bits by which they differ. a, b: key,
    label, n, f0, ...; each pair of one block once."""
    first, whole = candidate_radius(64 * FIRST, least), candidate_radius(64 * LONGS, least)
    fa, fb = ([x.view(np.uint64) for x in side[3 : 3 + LONGS]] for side in (a, b))
    us, vs = [], []
    for at in range(0, len(a[0]), TILE):
        apart = sum(np.bitwise_count(fa[k][at : at + TILE, None] ^ fb[k][None]) for k in range(FIRST))
        u, v = np.nonzero(apart <= first)
        u = u + at
        low, high = np.minimum(a[2][u], b[2][v]), np.maximum(a[2][u], b[2][v])
        ok = (a[1][u] != b[1][v]) & (low >= least * high - 1e-9) & (~np.bool_(same) | (u < v))
        us.append(u[ok])
        vs.append(v[ok])
    u, v = np.concatenate(us), np.concatenate(vs)
    far = sum(np.bitwise_count(x[u] ^ y[v]).astype(np.int16) for x, y in zip(fa, fb, strict=True))
    ok = far <= whole
    return u[ok], v[ok], far[ok]


FIELDS = ["key", "label", "n", *[f"f{k}" for k in range(LONGS)]]


def candidate_pairs(nodes: DataFrame, least: float, mode: str) -> DataFrame:
    """(u, v) keys of sets that may be similar and whose labels differ. nodes: (key, label, n, f0, ..., dense), n above 0.

    mode "near": of each pair of blocks, each node with its nearest and its smallest partner; "sparse": every pair of which one node at least is not dense; "count": for each node u, as v, how
    many candidates a pair of blocks has for it. Sets whose sizes alone rule out the similarity are not compared.
    """
    bound_batches(nodes.sparkSession)
    met = _block_pairs(nodes, least, [*FIELDS, "dense"], F.col("count") / BLOCK)
    width = len(FIELDS) + 1

    def run(parts: Batches) -> Batches:
        for batch in parts:
            for i in range(batch.num_rows):
                a, b = ([batch.column(1 + k + side * width)[i].values.to_numpy(zero_copy_only=False) for k in range(width)] for side in (0, 1))
                u, v, far = _near_rows(a, b, batch.column(0)[i].as_py(), least)
                if not len(u):
                    continue
                if mode == "count":
                    chosen, other = np.unique(np.concatenate((a[0][u], b[0][v])), return_counts=True)
                elif mode == "sparse":
                    ok = ~(a[-1][u] & b[-1][v])
                    chosen, other = a[0][u[ok]], b[0][v[ok]]
                else:
                    x, y, d = np.concatenate((a[0][u], b[0][v])), np.concatenate((b[0][v], a[0][u])), np.concatenate((far, far))
                    picks = []
                    for order in (np.lexsort((y, d, x)), np.lexsort((y, x))):
                        picks.append(order[np.concatenate(([True], x[order][1:] != x[order][:-1]))])
                    pick = np.unique(np.concatenate(picks))
                    chosen, other = y[pick], x[pick]
                yield pa.RecordBatch.from_arrays([pa.array(chosen, pa.int64()), pa.array(other, pa.int64())], names=["u", "v"])

    return met.mapInArrow(run, "u long, v long")


def shingle_sets(keys: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(key, shingles): sorted hashes of the distinct shingles of the texts of these keys, as a table."""
    ids = nodes.join(sized(keys), "key", "left_semi").select("id").distinct()
    bound_batches(docs.sparkSession)

    def run(parts: Batches) -> Batches:
        for b in parts:
            texts = byte_texts(b.column(0))
            sets = [np.sort(np.unique(shingle_hashes(t, words)).view(np.int64)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(_key, texts)), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sized(ids), "id", "left_semi")
    return written(found.select("text").mapInArrow(run, "key long, shingles array<long>").dropDuplicates(["key"]), "shingles")


def similar_pairs(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    """The pairs (u, v) of keys whose sets of shingles have at least this Jaccard similarity, taken from the texts."""
    wanted = pairs.select(F.col("u").alias("key")).union(pairs.select(F.col("v").alias("key"))).distinct()
    sets = shingle_sets(wanted, nodes, docs, id_col, text_col, words)
    # pairs are narrow: they meet their first sets by broadcast, so that a set with many partners is no hot key
    both = sized(pairs).join(sets.select(F.col("key").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("key").alias("v"), F.col("shingles").alias("b")), "v")
    both = both.select("u", "v", (F.size("a") + F.size("b")).alias("total"), F.size(F.array_intersect("a", "b")).alias("shared"))
    return both.where(F.col("shared") >= least * (F.col("total") - F.col("shared")) - 1e-9).select("u", "v")


def similar_dense(nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(u, v) keys that connect all similar sets among dense nodes, whose candidates are too many for a row each: blocks carry
    the sets themselves, and a pair of blocks hands back stars. Within it, sets that are linked already are not compared again."""
    bound_batches(nodes.sparkSession)
    met = _block_pairs(nodes.join(sets, "key"), least, [*FIELDS, "shingles"], F.col("count") * F.greatest(F.col("most") / SET_LONGS, F.lit(1 / BLOCK)))
    width = len(FIELDS) + 1

    def run(parts: Batches) -> Batches:
        for batch in parts:
            for i in range(batch.num_rows):
                same = batch.column(0)[i].as_py()
                a, b = ([batch.column(1 + k + side * width)[i].values for k in range(width)] for side in (0, 1))
                own, other = ([x.to_numpy(zero_copy_only=False) for x in side[:-1]] for side in (a, b))
                u, v, far = _near_rows(own, other, same, least)
                if not len(u):
                    continue
                keys = own[0] if same else np.concatenate((own[0], other[0]))
                sets_ = [x.values.to_numpy() for x in a[-1]] + ([] if same else [x.values.to_numpy() for x in b[-1]])
                v = v if same else v + len(own[0])
                group = list(range(len(keys)))

                def find(x: int) -> int:
                    while group[x] != x:
                        group[x] = group[group[x]]
                        x = group[x]
                    return x

                for x, y in zip(u[order := np.argsort(far, kind="stable")].tolist(), v[order].tolist(), strict=True):
                    p, q = find(x), find(y)
                    if p != q:
                        one, two = sets_[x], sets_[y]
                        at = np.searchsorted(two, one)
                        shared = int((two[np.minimum(at, len(two) - 1)] == one).sum())
                        if shared >= least * (len(one) + len(two) - shared) - 1e-9:
                            group[max(p, q)] = min(p, q)
                roots = np.array([find(x) for x in range(len(keys))])
                moved = np.flatnonzero(roots != np.arange(len(keys)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[moved], pa.int64()), pa.array(keys[roots[moved]], pa.int64())], names=["u", "v"])

    return met.mapInArrow(run, "u long, v long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """(id, component): every document with the smallest id that it reaches by links.

    Documents link when the Jaccard similarity of their sets of word shingles is at least `least`; texts of the same words
    (and all without words) are one node. Fingerprints only propose pairs: nearest ones first, so that most of a dense
    group is linked before the pairs that are still apart are all compared. Rows with null ids as in simhash_groups.
    """
    found = written(set_fingerprints(docs, id_col, text_col, words), "sets")
    prints = [f"f{k}" for k in range(LONGS)]
    nodes = checkpointed(found.groupBy("key").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", *prints)]).where("id is not null"))
    links, labels = None, nodes.select("key", F.col("key").alias("label"))
    for mode in ("near", "all"):
        labelled = nodes.where("n > 0").join(labels, "key").withColumn("dense", F.lit(False))
        more = None
        if mode == "all":
            counts = candidate_pairs(labelled, least, "count").groupBy(F.col("u").alias("key")).agg(F.sum("v").alias("c"))
            counts = checkpointed(counts)
            if counts.isEmpty():
                break
            dense = counts.where(F.col("c") > DENSE).select("key")
            if not dense.isEmpty():
                some = labelled.join(sized(dense), "key", "left_semi")
                more = similar_dense(some, shingle_sets(dense, nodes, docs, id_col, text_col, words), least)
            labelled = labelled.join(counts, "key").withColumn("dense", F.col("c") > DENSE).drop("c")
        pairs = written(candidate_pairs(labelled, least, "sparse" if mode == "all" else mode).select("u", "v").distinct(), "candidates")
        if not pairs.isEmpty():
            own = similar_pairs(pairs, nodes, docs, id_col, text_col, words, least)
            more = own if more is None else more.union(own)
        if more is None:
            break
        links = written(more if links is None else links.union(more), "similar")
        groups = components(links, "u", "v").withColumnsRenamed({"id": "key", "component": "label"})
        labels = checkpointed(nodes.select("key").join(groups, "key", "left").select("key", F.coalesce("label", "key").alias("label")))
    classes = nodes.join(labels, "key").select("key", "id", "label")
    least_ids = classes.groupBy("label").agg(F.min("id").alias("component"))
    return found.select("id", "key").join(classes.join(least_ids, "label").select("key", "component"), "key", "left").select("id", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """The documents with one of each group of similar_groups kept (that of the smallest id), columns as before.

    Rows that share an id are one document and stay or go together; rows with a null id are all kept.
    """
    mark = fresh(docs, "group_id")
    groups = checkpointed(similar_groups(docs, id_col, text_col, words, least).groupBy("id").agg(F.max(F.col("id") != F.col("component")).alias("gone")))
    gone = groups.where("gone").select(F.col("id").alias(mark))
    return docs.join(sized(gone), docs[id_col] == F.col(mark), "left_anti")
