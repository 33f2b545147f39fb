"""Centroid clustering by ball trees on integer vectors.

1. Every task builds metric trees over blocks of its own rows: a ball (node) stores its centre, radius, count and integer sum.
   Nothing is shuffled; the trees are a stored table, one row per block of about BLOCK_VALUES numbers.
2. A round compares balls with centroids from the root down.  A centroid that is farther from the centre, by over twice the
   radius, than another one can't be nearest to any vector of the ball (triangle inequality).  Where one centroid is left
   the whole ball is added by its count and sum; otherwise the halves are looked at, and in leaves every vector, exactly.
3. A task hands on one count and integer sum for each centroid; centroids (k rows) are made anew on the driver.

All sums and distances are exact integers; bounds are floating point with a margin that only keeps more centroids.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, store

#: Numbers of a block (4 MB), and rows of a leaf.
BLOCK_VALUES, LEAF_ROWS = 1 << 20, 24
#: What rounding may do to a distance, relative to it.
MARGIN = 1e-9


class BallTree:
    """A ball tree over integers x(n, d): nodes level by level, each a range of ``order``.

    start, stop: the range; parent; leaf: whether it isn't halved; radius: of the ball around sums / count.
    """

    def __init__(self, order, start, stop, parent, leaf, radius, sums):
        self.order, self.start, self.stop, self.parent, self.leaf, self.radius, self.sums = order, start, stop, parent, leaf, radius, sums

    @classmethod
    def grown(cls, x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> BallTree:
        order, values = np.arange(len(x)), x.astype(np.float64)
        nodes, sums = [], []
        todo = [(0, len(x), -1)]
        for start, stop, parent in todo:
            own = order[start:stop]
            total = x[own].sum(0, dtype=np.int64)
            rows = values[own]
            away = ((rows - total / len(own)) ** 2).sum(1)
            radius = math.sqrt(away.max()) * (1 + MARGIN)
            leaf = stop - start <= leaf_rows or radius == 0
            if not leaf:
                # Halves along the line from the vector farthest from the centre to the one farthest from that.
                one = rows[away.argmax()]
                two = rows[((rows - one) ** 2).sum(1).argmax()]
                half = len(own) // 2
                order[start:stop] = own[np.argpartition(rows @ (two - one), half)]
                todo += [(start, start + half, len(nodes)), (start + half, stop, len(nodes))]
            nodes.append((start, stop, parent, leaf, radius))
            sums.append(total)
        start, stop, parent, leaf, radius = (np.array(c) for c in zip(*nodes, strict=True))
        return cls(order, start, stop, parent, leaf, radius, np.array(sums, np.int64))

    def packed(self) -> list[bytes]:
        return [self.order.astype(np.int32).tobytes(), np.column_stack((self.start, self.stop, self.parent, self.leaf)).astype(np.int32).tobytes(), self.radius.tobytes(), self.sums.tobytes()]

    @classmethod
    def unpacked(cls, order: bytes, nodes: bytes, radius: bytes, sums: bytes, dims: int) -> BallTree:
        start, stop, parent, leaf = np.frombuffer(nodes, np.int32).reshape(-1, 4).T
        return cls(np.frombuffer(order, np.int32), start, stop, parent, leaf.astype(bool), np.frombuffer(radius), np.frombuffer(sums, np.int64).reshape(-1, dims))


def squares(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of z, exact."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(z).max(initial=0)))
    # Doubles hold all integers below 2^53.
    kind = np.float64 if 4 * x.shape[1] * largest**2 < 1 << 53 else np.int64
    x, z = x.astype(kind), z.astype(kind)
    return ((x * x).sum(1)[:, None] + (z * z).sum(1)[None, :] - 2 * (x @ z.T)).astype(np.int64)


def assign(tree: BallTree, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(balls, their centroid, rows, their centroid): maximal balls that have one nearest centroid, and the rows of leaves that don't.

    Together they are all rows, each once; the nearest centroid is the smaller number of equally near ones.
    """
    count = tree.stop - tree.start
    away = np.sqrt(((tree.sums[:, None, :] / count[:, None, None] - z[None, :, :]) ** 2).sum(2)) if len(z) * tree.sums.size <= 1 << 24 else np.sqrt(np.array([((c - z) ** 2).sum(1) for c in tree.sums / count[:, None]]))
    r = tree.radius[:, None]
    slack = MARGIN * (1 + away.max(1, keepdims=True) + r)
    alive = np.zeros(away.shape, bool)
    level = np.flatnonzero(tree.parent < 0)
    above = np.ones((len(level), len(z)), bool)
    children = np.argsort(tree.parent, kind="stable")
    parents = tree.parent[children]
    balls, leaves = [], []
    while len(level):
        nearest = np.where(above, away[level], np.inf).min(1, keepdims=True)
        alive[level] = above & (away[level] - r[level] <= nearest + r[level] + slack[level])
        one = alive[level].sum(1) == 1
        balls.append(level[one])
        rest = level[~one]
        leaves.append(rest[tree.leaf[rest]])
        rest = rest[~tree.leaf[rest]]
        first = np.searchsorted(parents, rest)
        level = np.sort(np.concatenate((children[first], children[first + 1]))) if len(rest) else rest
        above = alive[tree.parent[level]]
    balls, leaves = np.concatenate(balls), np.concatenate(leaves)
    sizes = count[leaves]
    at = np.repeat(tree.start[leaves] - np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(leaves) else leaves, sizes) + np.arange(sizes.sum())
    rows = tree.order[at]
    owner = np.empty(len(rows), np.int64)
    step = max(1, (1 << 22) // max(1, len(z)))
    leaf_of = np.repeat(leaves, sizes)
    for i in range(0, len(rows), step):
        d = squares(x[rows[i : i + step]], z)
        owner[i : i + step] = np.where(alive[leaf_of[i : i + step]], d, np.iinfo(np.int64).max).argmin(1)
    return balls, alive[balls].argmax(1), rows, owner


def _limit(dims: int) -> int:
    """Components up to this keep every squared distance below 2^63."""
    return math.isqrt((1 << 61) // max(1, dims)) - 1


def kept(vector: Column, dims: int, scale: int) -> Column:
    """Whether a vector takes part: dims components, none null, every one a finite number (and within _limit after scaling)."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < float(_limit(dims))))
    return F.coalesce((F.size(vector) == dims) & fits, F.lit(False))


def trees(table: DataFrame, dims: int, scale: int, vector: str = "embedding") -> DataFrame:
    """The stored trees over floor(scale * x) of the kept rows of (vec_id, vector): ids, x and a packed BallTree a row."""
    rows = table.where(kept(F.col(f"`{vector}`"), dims, scale)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
    most = max(1, BLOCK_VALUES // dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, held = [], [], 0

        def block(ids: pa.ChunkedArray, x: np.ndarray) -> pa.RecordBatch:
            tree = BallTree.grown(x)
            return pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), *[pa.array([b], pa.binary()) for b in (x.tobytes(), *tree.packed())]], ["ids", "x", "tree_order", "nodes", "radius", "sums"])

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                x = np.floor(scale * np.asarray(part.column(1).flatten(), np.float64)).reshape(-1, dims).astype(np.int32)
                ids.append(part.column(0))
                values.append(x)
                held += part.num_rows
                if held >= most:
                    yield block(pa.chunked_array(ids), np.concatenate(values))
                    ids, values, held = [], [], 0
        if held:
            yield block(pa.chunked_array(ids), np.concatenate(values))

    return store(arrow(rows, run, "ids array<bigint>, x binary, tree_order binary, nodes binary, radius binary, sums binary"), "ball-trees")


def _read(row: dict, dims: int) -> tuple[BallTree, np.ndarray]:
    return BallTree.unpacked(row["tree_order"], row["nodes"], row["radius"], row["sums"], dims), np.frombuffer(row["x"], np.int32).reshape(-1, dims)


def sums(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, place, total, count, whole): integer sums by centroid and component, its vectors, and those of them that came as whole balls."""
    shared = forest.sparkSession.sparkContext.broadcast(centroids)
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = shared.value
        total, count, whole = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                tree, x = _read({c: batch.column(c)[i].as_py() for c in batch.schema.names}, dims)
                balls, owner, rows, row_owner = assign(tree, x, z)
                np.add.at(total, owner, tree.sums[balls])
                np.add.at(whole, owner, (tree.stop - tree.start)[balls])
                np.add.at(total, row_owner, x[rows].astype(np.int64))
                count += np.bincount(row_owner, minlength=k)
        count += whole
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own].tolist(), pa.list_(pa.int64())), pa.array(count[own]), pa.array(whole[own])], ["cluster", "totals", "n", "whole"])

    rows = arrow(forest.select("x", "tree_order", "nodes", "radius", "sums"), run, "cluster int, totals array<bigint>, n bigint, whole bigint")
    spread = rows.select("cluster", "n", "whole", F.posexplode("totals").alias("place", "total"))
    return spread.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("count"), F.sum("whole").alias("whole"))


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means; those without vectors stay."""
    out = centroids.copy()
    # k * dims rows at most.
    for r in sums(forest, centroids).collect():
        out[r.cluster, r.place] = r.total // r["count"]
    return out


def members(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    shared = forest.sparkSession.sparkContext.broadcast(centroids)
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                tree, x = _read({c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "ids"}, dims)
                balls, owner, rows, row_owner = assign(tree, x, z)
                cluster = np.empty(len(x), np.int32)
                cluster[rows] = row_owner
                for ball, own in zip(balls, owner, strict=True):
                    cluster[tree.order[tree.start[ball] : tree.stop[ball]]] = own
                distance = ((x - z[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return arrow(forest.select("ids", "x", "tree_order", "nodes", "radius", "sums"), run, "vec_id bigint, cluster int, distance bigint")


def starts(table: DataFrame, k: int, dims: int, scale: int, seed: int, vector: str = "embedding") -> np.ndarray:
    """The k kept vectors with the smallest hashes of seed and vec_id, in ascending order of the hashes; rows without a vec_id last."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("long").cast("string")), 256)
    v = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(x.cast("double") * scale))
    rows = table.where(kept(F.col(f"`{vector}`"), dims, scale)).select(name.alias("h"), v.alias("v")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(-1, dims)


def cluster(table: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept row of (vec_id, vector).

    Null vectors, those of another length or with null or not finite components take no part; nor do those with a component so large
    that a squared distance doesn't fit a long.  Rows that repeat, or have no vec_id, count each.  With fewer than k vectors there are as many
    centroids as vectors.  Centroids (k * dims numbers) are held by the driver and every task.  Empty input: empty result.
    """
    z = starts(table, k, dims, scale, seed, vector)
    if not len(z):
        return table.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    forest = trees(table, dims, scale, vector)
    for _ in range(rounds):
        z = moved(forest, z)
    out = store(members(forest, z), "ball-members")
    per = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # One row for each of the k centroids.
    names = table.sparkSession.createDataFrame([(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(z.tolist())], "cluster int, centroid_sha256 string")
    found = {r.cluster: r.cluster_inertia for r in per.collect()}
    facts = names.join(F.broadcast(per), "cluster").withColumn("inertia", F.lit(sum(found.values())).cast("long"))
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
