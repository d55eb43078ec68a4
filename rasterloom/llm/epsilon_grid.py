"""Cosine similarity self-join of embeddings by epsilon grid order.

Unit vectors within cosine t lie within eps = sqrt(2 - 2 t). They are projected on leading principal directions (an
orthonormal projection never lengthens a distance), sorted by their grid cells of side eps, and cut into sequence
intervals. Two intervals are joined only if their bounding boxes come within eps, and recursively so for their halves; of
the one that comes first, only the vectors that lie within eps of the other's box travel there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, bound_batches, sized, written
from .components import components
from .simhash import _star

#: Rows of a sequence interval that is packed as one row, rows below which an interval is compared outright, and grid
#: dimensions that order the vectors; intervals meet by the cells of the first two.
BLOCK, LEAF, GRID = 1024, 128, 4


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_directions(vectors: DataFrame, column: str, size: int, count: int) -> np.ndarray:
    """size x count matrix of leading principal directions of all unit vectors; only size squared sums reach the driver."""

    def run(parts: Batches) -> Batches:
        total, first, n = np.zeros((size, size)), np.zeros(size), 0
        for b in parts:
            if b.num_rows:
                x = _unit(_matrix(b.column(0)))
                total, first, n = total + x.T @ x, first + x.sum(axis=0), n + len(x)
        if n:
            flat = np.concatenate((total.ravel(), first, [n]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "x"])

    sums = vectors.where(F.size(column) == size).select(column).mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))
    flat = np.zeros(size * size + size + 1)
    for i, x in sums.collect():
        flat[i] = x
    n = max(1.0, flat[-1])
    mean = flat[size * size : -1] / n
    _, axes = np.linalg.eigh(flat[: size * size].reshape(size, size) / n - np.outer(mean, mean))
    return axes[:, ::-1][:, :count]


def interval_join(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, least: float, eps: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (in a, in b) with a dot product of at least `least`; halves whose boxes lie over eps apart are skipped."""
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if i >= j or k >= m or (same and m <= i):
            continue
        gap = np.maximum(0, np.maximum(pa_[i:j].min(axis=0) - pb[k:m].max(axis=0), pb[k:m].min(axis=0) - pa_[i:j].max(axis=0)))
        if (gap * gap).sum() > eps * eps:
            continue
        if j - i <= LEAF and m - k <= LEAF:
            u, v = np.nonzero(a[i:j] @ b[k:m].T >= least)
            u, v = u + i, v + k
            if same:
                u, v = u[u < v], v[u < v]
            us.append(u)
            vs.append(v)
        elif j - i >= m - k:
            todo += [(i, (i + j) // 2, k, m), ((i + j) // 2, j, k, m)]
        else:
            todo += [(i, j, k, (k + m) // 2), (i, j, (k + m) // 2, m)]
    return np.concatenate(us), np.concatenate(vs)


def _intervals(nodes: DataFrame, axes: np.ndarray, eps: float, kind: str) -> DataFrame:
    """One row per sequence interval of the epsilon grid order: packed nodes, weights and vectors, bounds, and ranges of cells."""
    dims = axes.shape[1]
    grid = [f"c{k}" for k in range(min(GRID, dims))]

    def project(parts: Batches) -> Batches:
        for b in parts:
            cells = np.floor(_unit(_matrix(b.column(2))) @ axes / eps).astype(np.int32) if b.num_rows else np.zeros((0, dims), np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(cells[:, k]) for k in range(len(grid))]], names=["node", "part", "vector", "weight", *grid])

    def pack(parts: Batches) -> Batches:
        for b in parts:
            part = np.asarray(b.column(1).to_pylist(), dtype=object)
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                for at in range(lo, hi, BLOCK):
                    c = b.slice(at, min(BLOCK, hi - at))
                    x, nodes = _matrix(c.column(2)), c.column(0).to_numpy()
                    p, first, second = _unit(x) @ axes, c.column(4).to_numpy(), c.column(3 + min(2, len(grid))).to_numpy()
                    yield pa.RecordBatch.from_pylist([{"block": int(nodes[0]), "part": part[at], "nodes": nodes.tobytes(), "weights": c.column(3).to_numpy().tobytes(), "vectors": np.ascontiguousarray(x).tobytes(), "low": p.min(axis=0).tolist(), "high": p.max(axis=0).tolist(), "from0": int(first.min()), "to0": int(first.max()), "from1": int(second.min()), "to1": int(second.max())}], schema=packed)

    packed = pa.schema([("block", pa.int64()), ("part", pa.string()), ("nodes", pa.binary()), ("weights", pa.binary()), ("vectors", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("from0", pa.int32()), ("to0", pa.int32()), ("from1", pa.int32()), ("to1", pa.int32())])
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = nodes.select("node", "part", "vector", "weight").mapInArrow(project, f"node long, part string, vector {kind}, weight long, " + ", ".join(f"{c} int" for c in grid))
    ordered = cells.repartitionByRange(n, "part", *grid, "node").sortWithinPartitions("part", *grid, "node")
    return ordered.mapInArrow(pack, "block long, part string, nodes binary, weights binary, vectors binary, low array<double>, high array<double>, from0 int, to0 int, from1 int, to1 int")


def cosine_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, dims: int = 8) -> DataFrame:
    """(id, n_links, component) of every row: how many other rows link with it directly, and the smallest id it reaches.

    Rows link when their labels are equal and not null, their vectors have equal length and their cosine (double
    precision) is at least `least`. Null, zero or non-finite vectors link with nothing: 0 links, their own component; so
    do rows with a null id. Rows count one by one, also where ids repeat. Equal vectors of a label are one node with a
    weight, so copies count in n_links without being paired. A dense group hands back one star per pair of intervals and
    one count per node, never its pairs. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("vector"), F.col(label_col).cast("string").alias("label"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0), F.lit(False))
    good = rows.where(usable).withColumn("part", F.concat_ws(":", F.size("vector").cast("string"), "label")).withColumn("digest", F.xxhash64("vector"))
    nodes = good.groupBy("part", "digest", "vector").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    eps = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    sizes = [r[0] for r in nodes.select(F.size("vector")).distinct().collect()]  # lengths of vectors: a schema fact, one as a rule
    links = None
    for size in sizes:
        own = nodes.where(F.col("part").startswith(f"{size}:"))
        found = _links(own, principal_directions(own, "vector", size, min(dims, size)), least, eps, kind)
        links = found if links is None else links.union(found)
    if links is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    links = written(links, "links")
    groups = components(links.where("v is not null"), "u", "v").withColumnRenamed("id", "node")
    counts = links.where("v is null").groupBy("u").agg(F.sum("n").alias("n")).withColumnRenamed("u", "node")
    done = nodes.join(counts, "node", "left").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    done = done.select("part", "digest", "vector", "id", "group", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    least_ids = done.groupBy("group").agg(F.min("id").alias("component"))
    done = done.join(least_ids, "group").select("part", "digest", "vector", "n_links", "component")
    linked = good.join(done, ["part", "digest", "vector"]).select("id", "n_links", "component")
    return linked.union(rows.where(~usable).select("id", F.lit(0).cast("long"), "id"))


def _links(nodes: DataFrame, axes: np.ndarray, least: float, eps: float, kind: str) -> DataFrame:
    """(u, v, n): stars of linked nodes (v given), and weights of a node's partners (v null)."""
    raw = np.float32 if kind == "array<float>" else np.float64
    blocks = written(_intervals(nodes, axes, eps, kind), "intervals")
    meta = blocks.select("block", "part", "low", "high", "from0", "to0", "from1", "to1")
    over = lambda k, more: F.explode(F.sequence(F.col(f"from{k}") - more, F.col(f"to{k}") + more)).alias(f"cell{k}")
    left = meta.select("*", over(0, 1)).select("*", over(1, 1)).select("part", "cell0", "cell1", *[F.col(c).alias(f"{c}_a") for c in ("block", "low", "high", "from0", "from1")])
    right = meta.select("*", over(0, 0)).select("*", over(1, 0))
    gaps = F.zip_with(F.zip_with("low_a", "high", lambda x, y: x - y), F.zip_with("low", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    close = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x) <= eps * eps
    once = [F.col(f"cell{k}") == F.greatest(F.col(f"from{k}_a") - 1, F.col(f"from{k}")) for k in (0, 1)]
    pairs = left.join(right, ["part", "cell0", "cell1"]).where(once[0] & once[1] & (F.col("block_a") < F.col("block")) & close)
    pairs = written(pairs.select(F.col("block_a").alias("from"), F.col("block").alias("to"), "low", "high"), "meetings")
    data = ["nodes", "weights", "vectors"]
    opened = lambda r, ending="": (np.frombuffer(r[f"nodes{ending}"], np.int64), np.frombuffer(r[f"weights{ending}"], np.int64), np.frombuffer(r[f"vectors{ending}"], raw).reshape(-1, axes.shape[0]))

    def visit(parts: Batches) -> Batches:
        """Of an interval, the vectors that lie within eps of the box of the one it meets."""
        for batch in parts:
            for r in batch.to_pylist():
                ids, weight, x = opened(r)
                p = _unit(x) @ axes
                gap = np.maximum(0, np.maximum(np.array(r["low"]) - p, p - np.array(r["high"])))
                near = (gap * gap).sum(axis=1) <= eps * eps
                if near.any():
                    yield pa.RecordBatch.from_pylist([{"block": r["to"], "nodes_a": ids[near].tobytes(), "weights_a": weight[near].tobytes(), "vectors_a": x[near].tobytes()}])

    def compare(parts: Batches) -> Batches:
        for batch in parts:
            for r in batch.to_pylist():
                ids, weight, x = opened(r)
                a = b = _unit(x)
                every, shift, same = ids, 0, r["nodes_a"] is None
                if not same:
                    ids_a, weight_a, x_a = opened(r, "_a")
                    a, shift, every, weight = _unit(x_a), len(ids_a), np.concatenate((ids_a, ids)), np.concatenate((weight_a, weight))
                u, v = interval_join(a, b, a @ axes, b @ axes, least, eps, same)
                if not len(u):
                    continue
                v = v + shift
                sums = np.zeros(len(every), np.int64)
                np.add.at(sums, u, weight[v])
                np.add.at(sums, v, weight[u])
                order = np.argsort(every, kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                node, root = _star(place[u], place[v], len(order))
                some = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((every[order][node], every[some]))), pa.array([*every[order][root].tolist(), *[None] * len(some)], pa.int64()), pa.array(np.concatenate((np.zeros(len(node), np.int64), sums[some])))], names=["u", "v", "n"])

    parcels = blocks.select("block", *data).join(sized(pairs, 2 << 20), F.col("block") == F.col("from")).select("to", "low", "high", *data)
    parcels = parcels.mapInArrow(visit, "block long, nodes_a binary, weights_a binary, vectors_a binary")
    met = parcels.join(blocks.select("block", *data), "block").select(*[f"{c}_a" for c in data], *data)
    own = blocks.select(*[F.lit(None).cast("binary").alias(f"{c}_a") for c in data], *data)
    return met.union(own).mapInArrow(compare, "u long, v long, n long")
