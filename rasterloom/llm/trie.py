"""The prefix trie of conversations by union-find over the sorted neighbours' common prefixes.

Conversations are sorted by the hashes of their turns, so all that share a prefix stand together, and the trie is told by
how many turns each has in common with the one before it. Within a block of rows these edges are merged from the deepest
on: every merge makes a branching node. A block's nodes are complete but for those on the paths of its first and its last
row; what hangs off these is folded into weights on them, and the two paths stand for the block when it meets the next
one: first within a partition, then across all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, bound_batches, sized, written

#: Turns of a block; bounds what a task holds, beside a single conversation's hashes.
BLOCK = 1 << 17
HASH = 16

NODE = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("prefix", pa.binary()), ("parent", pa.binary()), ("parent_conv", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("n_ends", pa.int64()), ("joint", pa.bool_())])
WEIGHTS = ("n_convs", "least", "n_children", "n_leaves", "saved", "n_ends")
PATH = pa.schema([("part", pa.int64()), ("place", pa.int64()), ("key", pa.binary()), ("chars", pa.list_(pa.int64())), ("depths", pa.list_(pa.int64())), *[(w, pa.list_(pa.int64())) for w in WEIGHTS]])
END = pa.schema([("end_prefix", pa.binary()), ("end_conv", pa.int64())])
PARTS = {"node": pa.struct(list(NODE)), "path": pa.struct(list(PATH)), "end": pa.struct(list(END))}
_SQL = {pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}
SCHEMA = ", ".join(f"{name} struct<{', '.join(f'{f.name} {_SQL[f.type]}' for f in kind)}>" for name, kind in PARTS.items())


def turns(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): one row per conversation, its turns in order as structs of a 128-bit hash of role and text, as
    hexadecimal digits, and the text's code points.

    A null turn comes first, equal turns stand by role and hash. Null role or text count as empty; rows of no conversation
    (null) take no part. A conversation's hashes are gathered in one row, its texts are not.
    """
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in (role, text))
    mark = F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text)).alias("mark")
    some = messages.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).isNotNull().alias("some"), F.col(turn).alias("turn"), role.alias("role"), mark, F.length(text).cast("long").alias("chars"))
    rows = F.array_sort(F.collect_list(F.struct("some", F.coalesce("turn", F.lit(0)).alias("turn"), "role", "mark", "chars")))
    return some.groupBy("conv").agg(F.transform(rows, lambda x: F.struct(x["mark"].alias("mark"), x["chars"].alias("chars"))).alias("turns"))


@dataclass
class _Row:
    """A path from the root: hashes and code points of its turns, and the weights (by depth) that hang off its nodes."""

    key: bytes
    chars: list[int]
    weights: dict[int, list]

    @property
    def depth(self) -> int:
        return len(self.chars)


@dataclass
class _Tree:
    """A component: rows low to high share the prefix down to depth, whose node has gathered `sums` (see WEIGHTS) so far."""

    low: int
    high: int
    depth: int
    sums: list
    kids: list[dict] = field(default_factory=list)  # nodes whose parent this node is


def _join(a: list, b: list) -> list:
    return [a[0] + b[0], b[1] if a[1] is None else a[1] if b[1] is None else min(a[1], b[1]), *[x + y for x, y in zip(a[2:], b[2:], strict=True)]]


NOTHING = [0, None, 0, 0, 0, 0]


def _common(a: bytes, b: bytes) -> int:
    """Turns that two keys share at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // HASH
    low, high = 0, n // HASH
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low * HASH : mid * HASH] == b[low * HASH : mid * HASH] else (low, mid)
    return low


def merge_block(rows: list[_Row], carried: int, final: bool) -> tuple[list[dict], list[_Row]]:
    """Complete nodes of a block of sorted rows, and the paths (two at most) that stand for the block.

    The first `carried` rows stand for earlier blocks. With final there is nothing beyond the block: all nodes are complete.
    """
    shared = [0] + [_common(a.key, b.key) for a, b in zip(rows[:-1], rows[1:], strict=True)]
    prefixes, weights, owner = [], {}, []
    for i, row in enumerate(rows):
        own, names = (owner[: shared[i] + 1], prefixes[-1][: shared[i] + 1]) if i else ([], [b""])
        owner = own + [i] * (row.depth + 1 - len(own))
        for d in range(len(names), row.depth + 1):
            names.append(hashlib.blake2b(names[-1] + row.key[(d - 1) * HASH : d * HASH], digest_size=HASH).digest())
        prefixes.append(names)
        for d, w in row.weights.items():
            at = (owner[d], d)
            weights[at] = _join(weights.get(at, NOTHING), w)

    above, out, last = list(range(len(rows))), [], len(rows) - 1
    hung: tuple[dict, dict] = ({}, {})
    trees = [_Tree(i, i, row.depth, weights.get((i, row.depth), NOTHING)) for i, row in enumerate(rows)]

    def find(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    def close(t: _Tree) -> tuple[list, list[dict]]:
        """Ends a tree's node: what it adds to its parent, and the nodes whose parent that is."""
        d = t.depth
        if not final and (t.low == 0 or t.high == last):
            hung[t.low != 0][d] = t.sums
            return NOTHING, []
        n, least, children, leaves, saved, ends = t.sums
        leaves = leaves if children else 1
        saved += (n - 1) * rows[t.low].chars[d - 1] if d else 0
        names = prefixes[t.low]
        node = {"conv": least, "depth": d, "prefix": names[d], "parent": names[d - 1] if d else None, "parent_conv": None, "n_convs": n, "n_children": children, "n_leaves": leaves, "saved": saved, "n_ends": ends, "joint": t.low < carried}
        for kid in t.kids:
            kid["parent_conv"] = least
        out.append(node)
        return [n, least, 1, leaves, saved, 0], [node]

    def climb(t: _Tree, d: int) -> None:
        while t.depth > d:
            sums, t.kids = close(t)
            t.depth -= 1
            t.sums = _join(weights.get((t.low, t.depth), NOTHING), sums)

    for i in sorted(range(1, len(rows)), key=lambda i: -shared[i]):
        a, b = find(i - 1), find(i)
        for x in (a, b):
            climb(trees[x], shared[i])
        a, b = (a, b) if len(trees[a].kids) >= len(trees[b].kids) else (b, a)
        x, y = trees[a], trees[b]
        above[b] = a
        x.low, x.high, x.sums = min(x.low, y.low), max(x.high, y.high), _join(x.sums, y.sums)
        x.kids += y.kids
    root = trees[find(0)]
    climb(root, 0)
    close(root)
    if final:
        return out, []
    ends = [0] if rows[0].key == rows[last].key else [0, last]
    return out, [_Row(rows[k].key, rows[k].chars, hung[j]) for j, k in enumerate(ends)]


def _merge(rows: Iterator[_Row], final: bool) -> Iterator[tuple[list[dict], list[_Row]]]:
    """Nodes block by block, and at the end the paths that stand for all rows."""
    carried, block, size = 0, [], 0
    for row in rows:
        if size >= BLOCK and len(block) > carried:
            out, block = merge_block(block, carried, False)
            yield out, []
            carried, size = len(block), sum(r.depth for r in block)
        block.append(row)
        size += row.depth + 1
    if block:
        yield merge_block(block, carried, final)


def _batch(part: str, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows if name == part else [None] * len(rows), kind) for name, kind in PARTS.items()], names=list(PARTS))


def _sort_key(rows: Batches) -> Batches:
    """Nodes, end prefixes and remaining paths of a partition of sorted conversations."""
    part, ends = TaskContext.get().partitionId(), []

    def read() -> Iterator[_Row]:
        for batch in rows:
            for conv, key, chars in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                prefix = b""
                for d in range(len(chars)):
                    prefix = hashlib.blake2b(prefix + key[d * HASH : (d + 1) * HASH], digest_size=HASH).digest()
                ends.append({"end_prefix": prefix, "end_conv": conv})
                yield _Row(key, chars, {len(chars): [1, conv, 0, 0, 0, 1]})

    for nodes, paths in _merge(read(), final=False):
        yield _batch("node", nodes)
        yield _batch("end", ends)
        ends.clear()
        yield _batch("path", [_listed(part, k, p) for k, p in enumerate(paths)])


def _listed(part: int, place: int, row: _Row) -> dict:
    depths = sorted(row.weights)
    return {"part": part, "place": place, "key": row.key, "chars": row.chars, "depths": depths} | {w: [row.weights[d][k] for d in depths] for k, w in enumerate(WEIGHTS)}


def _across(batches: Batches) -> Batches:
    """Nodes of the paths that stand for the partitions, in their order."""

    def read() -> Iterator[_Row]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _Row(r["key"], r["chars"], {d: list(w) for d, *w in zip(r["depths"], *[r[w] for w in WEIGHTS], strict=True)})

    for nodes, _ in _merge(read(), final=True):
        yield pa.RecordBatch.from_pylist([n | {"joint": True} for n in nodes], NODE)


def _end_hashes(batches: Batches) -> Batches:
    """SHA-256 of the ids of each prefix, in their order; ids are hashed as they pass."""
    now, digest, out = None, None, []
    kind = pa.schema([("end_prefix", pa.binary()), ("ends", pa.string())])
    for batch in batches:
        for prefix, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if prefix == now:
                digest.update(f",{conv}".encode())
                continue
            if digest:
                out.append({"end_prefix": now, "ends": digest.hexdigest()})
            now, digest = prefix, hashlib.sha256(str(conv).encode())
        yield pa.RecordBatch.from_pylist(out, kind)
        out = []
    if digest:
        yield pa.RecordBatch.from_pylist([{"end_prefix": now, "ends": digest.hexdigest()}], kind)


def prefix_trie(paths: DataFrame, conv: str = "conv", turns: str = "turns") -> DataFrame:
    """One row per distinct prefix of the conversations, the empty one included: conv_id (its smallest member), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    paths has one row per conversation, with its turns as turns() gives them; an id stands once. A conversation without
    turns (or with null) is a member of the root alone. saved_tokens sums, over a node's subtree, the code points of a
    node's last text times its other members; ends_sha256 is the SHA-256 of the ids that end at the node, ascending,
    joined by commas. An empty table gives no rows. Conversations alike in millions stand in as many partitions as they
    fill, since the id is part of the order; only their ids pass one task, as a stream, for their one hash.
    """
    spark = paths.sparkSession
    bound_batches(spark)
    steps = F.coalesce(F.col(turns), F.array().cast(paths.schema[turns].dataType))
    some = paths.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv"), F.unhex(F.array_join(F.transform(steps, lambda t: t["mark"]), "")).alias("key"), F.transform(steps, lambda t: t["chars"]).alias("chars"))
    sorted_ = some.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    made = written(sorted_.mapInArrow(_sort_key, SCHEMA), "trie")
    across = made.where("path is not null").select("path.*").repartition(1).sortWithinPartitions("part", "place")
    schema = ", ".join(f"{f.name} {_SQL[f.type]}" for f in NODE)
    top = written(across.mapInArrow(_across, schema), "trie-top")
    nodes = made.where("node is not null").select("node.*").union(top)

    joint = nodes.where("joint").select(F.col("prefix").alias("upper"), F.col("conv").alias("upper_conv"))
    known = nodes.where("parent_conv is not null or depth = 0")
    open_ = nodes.where("parent_conv is null and depth > 0").join(sized(joint), F.col("parent") == F.col("upper"))
    nodes = known.union(open_.select(*[F.coalesce("parent_conv", "upper_conv").alias(c) if c == "parent_conv" else F.col(c) for c in known.columns]))
    ids = made.where("end is not null").select("end.*").repartition("end_prefix").sortWithinPartitions("end_prefix", "end_conv")
    ends = ids.mapInArrow(_end_hashes, "end_prefix binary, ends string")
    out = lambda df, ends: df.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), ends.alias("ends_sha256"))
    return out(nodes.where("n_ends = 0"), F.sha2(F.lit(""), 256)).union(out(nodes.where("n_ends > 0").join(ends, F.col("prefix") == F.col("end_prefix")), F.col("ends")))


def with_heads(paths: DataFrame, stride: int, most: int) -> DataFrame:
    """Conversations (of turns()) whose first h turns are those of conversation c - c % stride, h being crc32(c) % most."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    own = paths.select("conv", "turns", h.alias("h"), (F.col("conv") - F.col("conv") % stride).alias("base"))
    heads = paths.where(F.col("conv") % stride == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    rest = F.expr("slice(turns, h + 1, greatest(0, size(turns) - h))")
    head: Column = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return own.join(heads, "base", "left").select("conv", F.concat(head, rest).alias("turns"))
