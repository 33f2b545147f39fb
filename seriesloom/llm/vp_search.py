"""Nearest vectors by inner product: vantage-point trees, one per shard of bounded size.

1. Inner products become distances: with M the largest norm of all vectors, x is extended by sqrt(M^2 - |x|^2) and a query
   by 0, so |q - x|^2 = |q|^2 + M^2 - 2 q.x: the largest inner product is the least distance.
2. A top tree, fitted on a bounded sample (about SAMPLE_VALUES numbers, rows by hash of vec_id), routes every row to a leaf.  Leaves are
   cut into shards of about SHARD_ROWS by a hash of vec_id, so a large group of near copies is many shards.  Of equal vectors only
   the k + 1 smallest vec_ids can be in a result of k: the others search, but are not held twice.
3. Each shard gets a vantage-point tree: a node halves its vectors by the distance to a vantage point and keeps the least
   and largest distance of each half.  The index is a table of one row per shard.
4. A query first searches the shard whose centre is nearest; the distance to its k-th find is its radius.  By centre and extent
   of the shards (compared in blocks of CENTRES) it goes on to those whose lower bound, times ``factor``, is within the radius; inside a
   tree halves are left out by the same rule.  Factor 1 is exact: no half that can hold a nearer vector is left out.
5. What a factor loses depends on the data, so it is tuned: a bounded sample of queries is searched with all of FACTORS, and the largest that
   finds enough of what factor 1 finds is taken.

A task holds one shard and a block of about QUERIES queries.  Scores are computed anew on the original vectors, in double precision
and in the order of components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, one_per_id, store

#: Rows of a shard, rows of a leaf of its tree, and queries that meet a shard in one task.
SHARD_ROWS, LEAF_ROWS, QUERIES = 4096, 32, 4096
#: Numbers in the sample that the top tree is fitted on (16 MB); it has at most a leaf for every SAMPLE_LEAF rows of it.
SAMPLE_VALUES, SAMPLE_LEAF = 1 << 21, 16
#: Shards whose centres are broadcast at once.
CENTRES = 1 << 14
#: What rounding may do to a product, relative to the norms.
SLACK = 1e-9
#: Factors that are tried, the queries that try them, and the recall that a factor must have on these.
FACTORS, TRIED, RECALL = (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0), 64, 0.999


class Tree:
    """A vantage-point tree over points(n, d): nodes in preorder, leaves as ranges of ``order``.

    Row i of nodes: start and stop in order, the vantage point (a row of points), the node of the farther half (0 for a leaf; the
    nearer half's is i + 1), and the least and largest distance of each half to the vantage point.
    """

    def __init__(self, order: np.ndarray, nodes: np.ndarray):
        self.order, self.nodes = order, nodes
        self.start, self.stop, self.vantage, self.far = nodes[:, :4].astype(np.int64).T
        self.bounds = nodes[:, 4:]

    @classmethod
    def grown(cls, points: np.ndarray, leaf: int) -> Tree:
        order = np.arange(len(points))
        nodes: list[list[float]] = []
        todo = [(0, len(points), -1)]
        while todo:
            start, stop, parent = todo.pop()
            if parent >= 0:
                nodes[parent][3] = len(nodes)
            nodes.append([start, stop, 0, 0, 0, 0, 0, 0])
            if stop - start <= leaf:
                continue
            own = order[start:stop]
            x = points[own]
            # Distances to the vector farthest from the mean spread most.
            v = own[int(((x - x.mean(0)) ** 2).sum(1).argmax())]
            d = np.sqrt(((x - points[v]) ** 2).sum(1))
            half = len(own) // 2
            by = np.argpartition(d, half)
            order[start:stop], d = own[by], d[by]
            nodes[-1][2] = v
            nodes[-1][4:] = [d[:half].min(), d[:half].max(), d[half:].min(), d[half:].max()]
            todo += [(start + half, stop, len(nodes) - 1), (start, start + half, -1)]
        return cls(order, np.array(nodes, np.float64))

    def leaf_of(self, centres: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """The leaf that each query comes to by the nearer half; centres: the nodes' vantage points."""
        at = np.zeros(len(queries), np.int64)
        while len(live := np.flatnonzero(self.far[at])):
            node = at[live]
            d = np.sqrt(((queries[live] - centres[node]) ** 2).sum(1))
            middle = (self.bounds[node, 1] + self.bounds[node, 2]) / 2
            at[live] = np.where(d <= middle, node + 1, self.far[node])
        return at


def _extended(x: np.ndarray, most: float) -> np.ndarray:
    """x with a last component that gives every row the norm ``most``."""
    return np.column_stack((x, np.sqrt(np.maximum(most * most - (x * x).sum(1), 0))))


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first component to the last."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * y[:, j]
    return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of one length as a matrix of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(column), -1)


class Finds:
    """The k best (score, id) of each query: larger scores first, then smaller ids; never ``own``.  ``bound``: the score to reach."""

    def __init__(self, own: np.ndarray, queries: np.ndarray, bound: np.ndarray, factor: np.ndarray, k: int, most: float):
        self.own, self.q, self.factor, self.k, self.most = own, queries, factor, k, most
        self.square = (queries * queries).sum(1)
        self.bound = bound.copy()
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def radius(self, live: np.ndarray) -> np.ndarray:
        scale = self.square[live] + self.most**2
        return np.sqrt(np.maximum(scale - 2 * self.bound[live], 0) + SLACK * scale)

    def scan(self, live: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        if not len(live):
            return
        rough = self.q[live] @ x.T
        near = rough >= (self.bound[live] - SLACK * (np.sqrt(self.square[live]) * self.most))[:, None]
        near &= self.own[live][:, None] != ids[None, :]
        hit = np.flatnonzero(near.any(1))
        if not len(hit):
            return
        live, near = live[hit], near[hit]
        row, column = np.nonzero(near)
        found = np.full(near.shape, -np.inf)
        found[row, column] = _products(self.q[live[row]], x[column])
        scores = np.concatenate((self.scores[live], found), 1)
        names = np.concatenate((self.ids[live], np.where(near, ids[None, :], np.iinfo(np.int64).max)), 1)
        best = np.lexsort((names, -scores))[:, : self.k]
        self.scores[live], self.ids[live] = np.take_along_axis(scores, best, 1), np.take_along_axis(names, best, 1)
        self.bound[live] = np.maximum(self.bound[live], self.scores[live, -1])


def search_tree(tree: Tree, ids: np.ndarray, x: np.ndarray, most: float, finds: Finds) -> None:
    """Adds what the tree over x holds to finds: first each query's own leaf, then all halves that the rule doesn't leave out."""
    points, queries = _extended(x, most), np.column_stack((finds.q, np.zeros(len(finds.q))))
    centres = points[tree.vantage]
    home = tree.leaf_of(centres, queries)
    for leaf in np.unique(home):
        rows = tree.order[tree.start[leaf] : tree.stop[leaf]]
        finds.scan(np.flatnonzero(home == leaf), x[rows], ids[rows])
    todo = [(0, np.arange(len(queries)))]
    while todo:
        node, live = todo.pop()
        if not tree.far[node]:
            rows = tree.order[tree.start[node] : tree.stop[node]]
            finds.scan(live[home[live] != node], x[rows], ids[rows])
            continue
        d = np.sqrt(((queries[live] - centres[node]) ** 2).sum(1))
        radius, b = finds.radius(live), tree.bounds[node]
        for child, low, high in ((int(tree.far[node]), b[2], b[3]), (node + 1, b[0], b[1])):
            inside = live[finds.factor[live] * np.maximum(np.maximum(d - high, low - d), 0) <= radius]
            if len(inside):
                todo.append((child, inside))


def usable(v: Column | str) -> Column:
    """Whether a vector takes part: not null, not zero, every component a finite number."""
    v = F.col(v) if isinstance(v, str) else v
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _vectors(table: DataFrame, vector: str) -> DataFrame:
    rows = table.where(usable(f"`{vector}`")).where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
    return one_per_id(rows, "vec_id").withColumn("dim", F.size("v"))


def _first_copies(rows: DataFrame, k: int) -> DataFrame:
    """rows(vec_id, v) with the k + 1 smallest vec_ids of equal vectors: what a result of k can hold."""
    many = rows.groupBy(F.xxhash64("v").alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1)
    if not many.limit(1).count():
        return rows
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return rows.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")


def _build(rows: DataFrame, dim: int) -> DataFrame:
    """The index of rows(vec_id, v) of one dimension."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("most")).first()
    n, most = size.n, float(np.sqrt(size.most)) * (1 + SLACK)
    take = max(1, SAMPLE_VALUES // dim)
    sample = rows if n <= take else rows.where(F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(n)) < take)
    # About SAMPLE_VALUES numbers at most, whatever the table's size.
    table = sample.select("vec_id", "v").toArrow().sort_by("vec_id")
    points = _extended(_matrix(table["v"]), most)
    leaves = max(1, min(-(-n // SHARD_ROWS), len(points) // SAMPLE_LEAF))
    top = Tree.grown(points, -(-len(points) // leaves))
    route = rows.sparkSession.sparkContext.broadcast((top, points[top.vantage]))

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, centres = route.value
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("leaf", pa.array(tree.leaf_of(centres, _extended(_matrix(batch.column(1)), most)), pa.int64()))

    kind = rows.schema["v"].dataType.simpleString()
    routed = store(arrow(rows.select("vec_id", "v"), leaf, f"vec_id bigint, v {kind}, leaf bigint"), "vp-routed")
    # At most SAMPLE_VALUES / SAMPLE_LEAF rows.
    parts = F.broadcast(routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).alias("parts")))
    part = F.pmod(F.xxhash64("vec_id", F.lit(29)), F.col("parts"))
    placed = routed.join(parts, "leaf").select((F.col("leaf") * (1 << 32) + part).alias("shard"), "vec_id", "v")

    def grow(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        x = _matrix(group["v"])
        points = _extended(x, most)
        tree = Tree.grown(points, LEAF_ROWS)
        centre = points.mean(0)
        reach = np.sqrt(((points - centre) ** 2).sum(1))
        held = (group["vec_id"].to_numpy().tobytes(), x.tobytes(), tree.order.tobytes(), tree.nodes.tobytes(), centre.tobytes())
        return pa.table([[group["shard"][0].as_py()], [dim], [most], [group.num_rows], [reach.min()], [reach.max()], *[pa.array([b], pa.binary()) for b in held]], schema=_INDEX)

    return placed.groupBy("shard").applyInArrow(grow, _INDEX_DDL)


_INDEX_DDL = "shard bigint, dim int, most double, rows bigint, low double, high double, ids binary, x binary, tree_order binary, nodes binary, centre binary"
_INDEX = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("most", pa.float64()), ("rows", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), *[(c, pa.binary()) for c in ("ids", "x", "tree_order", "nodes", "centre")]])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_FOUND_DDL = "query_id bigint, vec_id bigint, score double"


def build(table: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """The index of (vec_id, vector) for results of up to k rows: one row per shard, stored in the shared folder.

    Vectors of different lengths have no inner product; each length gets trees of its own.  Null, zero and not finite vectors, and
    rows without a vec_id, are not indexed; of rows that share a vec_id the smallest vector is.  Empty input: empty index.
    """
    rows = store(_vectors(table, vector), "vp-vectors")
    held = store(_first_copies(rows, k), "vp-first-copies")
    dims = sorted(r.dim for r in held.select("dim").distinct().collect())
    out = held.sparkSession.createDataFrame([], _INDEX_DDL)
    for dim in dims:
        out = out.unionAll(_build(held.where(F.col("dim") == dim), dim))
    return store(out, "vp-index")


def _centres(index: DataFrame, dim: int) -> Iterator[tuple[np.ndarray, ...]]:
    """shard, most, low, high and centre of the shards of one dimension, in blocks of about CENTRES."""
    slim = index.where(F.col("dim") == dim).select("shard", "most", "low", "high", "centre")
    blocks = max(1, -(-slim.count() // CENTRES))
    for i in range(blocks):
        t = slim.where(F.pmod(F.xxhash64("shard"), F.lit(blocks)) == i).toArrow().sort_by("shard")
        if t.num_rows:
            yield *(t[c].to_numpy() for c in ("shard", "most", "low", "high")), np.frombuffer(b"".join(t["centre"].to_pylist())).reshape(t.num_rows, -1)


def _union(frames: list[DataFrame]) -> DataFrame:
    while len(frames) > 1:
        frames = [frames[i].unionAll(frames[i + 1]) if i + 1 < len(frames) else frames[i] for i in range(0, len(frames), 2)]
    return frames[0]


def _to_centres(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (q * q).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * (q @ centres[:, :-1].T)
    return np.sqrt(np.maximum(square, 0))


#: Columns of a query: its number, the vec_id that is no result (none: null), the vector, the factor and the score to reach.
_ASKED = ("query_id", "own", "v", "factor", "bound")


def _asked_ddl(kind: str) -> str:
    return f"query_id bigint, own bigint, v {kind}, factor double, bound double, shard bigint"


def _homes(queries: DataFrame, index: DataFrame, dim: int, kind: str) -> DataFrame:
    """queries(_ASKED) with the shard of the nearest centre."""
    frames = []
    for block in _centres(index, dim):
        shared = queries.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            shards, *_, centres = shared.value
            for batch in batches:
                if batch.num_rows:
                    d = _to_centres(_matrix(batch.column("v")), centres)
                    best = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _ASKED), pa.array(shards[best]), pa.array(d[np.arange(len(best)), best])], [*_ASKED, "shard", "d"])

        frames.append(arrow(queries.select(*_ASKED), run, _asked_ddl(kind) + ", d double"))
    both = _union(frames)
    if len(frames) > 1:
        rest = F.struct(*[F.first(c).alias(c) for c in _ASKED[1:]]).alias("rest")
        both = both.groupBy("query_id").agg(rest, F.min(F.struct("d", "shard"))["shard"].alias("shard")).select("query_id", "rest.*", "shard")
    return both.select(*_ASKED, "shard")


def _others(queries: DataFrame, index: DataFrame, dim: int, kind: str) -> DataFrame:
    """queries(_ASKED, home) with each other shard that the rule doesn't leave out."""
    frames = []
    for block in _centres(index, dim):
        shared = queries.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            shards, most, low, high, centres = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    q = _matrix(part.column("v"))
                    factor, bound, home = (part.column(c).to_numpy() for c in ("factor", "bound", "home"))
                    d = _to_centres(q, centres)
                    scale = (q * q).sum(1)[:, None] + most[None, :] ** 2
                    radius = np.sqrt(np.maximum(scale - 2 * bound[:, None], 0) + SLACK * scale)
                    goes = factor[:, None] * np.maximum(np.maximum(d - high, low - d) - SLACK * most, 0) <= radius
                    goes &= home[:, None] != shards[None, :]
                    who, where = np.nonzero(goes)
                    for i in range(0, len(who), 4096):
                        taken = part.take(pa.array(who[i : i + 4096]))
                        yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in _ASKED), pa.array(shards[where[i : i + 4096]])], [*_ASKED, "shard"])

        frames.append(arrow(queries.select(*_ASKED, "home"), run, _asked_ddl(kind)))
    return _union(frames)


def _visit(visits: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): up to k finds of each of visits(_ASKED, shard) in its shard, none under the bound."""
    blocks = store(visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("blocks")), "vp-blocks")
    left = index.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    of = blocks.select(F.col("shard").alias("at"), F.col("blocks").alias("parts"))
    right = visits.join(of, F.col("shard") == F.col("at")).select(*_ASKED, "at", F.pmod(F.xxhash64("query_id"), F.col("parts")).alias("part"))

    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        if not shard.num_rows or not asked.num_rows:
            return _FOUND.empty_table()
        row = shard.slice(0, 1).to_pylist()[0]
        ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["x"]).reshape(row["rows"], -1)
        tree = Tree(np.frombuffer(row["tree_order"], np.int64), np.frombuffer(row["nodes"]).reshape(-1, 8))
        out = []
        for at in range(0, asked.num_rows, QUERIES):
            part = asked.slice(at, QUERIES)
            # No vec_id is so small but one that a caller gave: it stands for none.
            own = part["own"].combine_chunks().fill_null(np.iinfo(np.int64).min).to_numpy()
            finds = Finds(own, _matrix(part["v"]), part["bound"].to_numpy(), part["factor"].to_numpy(), k, row["most"])
            search_tree(tree, ids, x, row["most"], finds)
            real = np.isfinite(finds.scores)
            out.append(pa.table([np.repeat(part["query_id"].to_numpy(), real.sum(1)), finds.ids[real], finds.scores[real]], schema=_FOUND))
        return pa.concat_tables(out)

    return left.groupBy("shard", "block").cogroup(right.groupBy("at", "part")).applyInArrow(run, _FOUND_DDL)


def _search(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of asked(query_id, own, v, dim, factor), stored."""
    kind = asked.schema["v"].dataType.simpleString()
    found = asked.sparkSession.createDataFrame([], _FOUND_DDL)
    for dim in sorted(r.dim for r in index.select("dim").distinct().collect()):
        own = asked.where(F.col("dim") == dim).withColumn("bound", F.lit(float("-inf")))
        first = store(_homes(own, index, dim, kind), "vp-homes")
        begun = store(_visit(first, index, k), "vp-found")
        full = begun.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        reached = F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(float("-inf")))
        bounded = first.drop("bound").join(full, "query_id", "left").select(*_ASKED[:-1], reached.alias("bound"), F.col("shard").alias("home"))
        more = store(_others(bounded, index, dim, kind), "vp-visits")
        found = found.unionAll(begun).unionAll(_visit(more, index, k))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return store(found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "vp-result")


def tuned_factor(index: DataFrame, table: DataFrame, k: int, recall: float = RECALL, vector: str = "embedding") -> tuple[float, dict[float, float]]:
    """The largest of FACTORS with that recall on a sample, and the recall of each: TRIED rows of table(vec_id, vector) by hash, against the whole index.

    What factor 1 finds is what brute force finds.  Without rows: factor 1.
    """
    rows = _vectors(table, vector).orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(TRIED)
    turn = F.posexplode(F.array(*[F.lit(f) for f in FACTORS])).alias("turn", "factor")
    tried = store(rows.select("vec_id", "v", "dim", turn).withColumn("query_id", F.monotonically_increasing_id()), "vp-tried")
    found = _search(index, tried.select("query_id", F.col("vec_id").alias("own"), "v", "dim", "factor"), k)
    found = found.join(tried.select("query_id", F.col("vec_id").alias("asked"), "factor"), "query_id").select("asked", "factor", "vec_id")
    exact = found.where(F.col("factor") == 1).select("asked", "vec_id")
    wanted = exact.count()
    hits = {r.factor: r.n for r in found.join(exact, ["asked", "vec_id"], "left_semi").groupBy("factor").agg(F.count(F.lit(1)).alias("n")).collect()}
    recalls = {f: hits.get(f, 0) / wanted if wanted else 0.0 for f in FACTORS}
    return max([1.0, *(f for f in FACTORS if recalls[f] >= recall)]), recalls


def search(index: DataFrame, queries: DataFrame, k: int, factor: float = 1.0, same: bool = True, vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each of queries(vec_id, vector) the k nearest that the index gives.

    same: the queries are rows of the indexed table, and a query's own vec_id is no result.  Queries that can't be used
    (see ``build``), or of a length that the index doesn't have, give no row; of queries that share a vec_id the smallest vector counts.
    """
    if factor < 1:
        raise ValueError("a factor under 1 leaves nothing out that factor 1 keeps; it must be 1 or more")
    asked = _vectors(queries, vector).select(F.col("vec_id").alias("query_id"), (F.col("vec_id") if same else F.lit(None).cast("long")).alias("own"), "v", "dim", F.lit(float(factor)).alias("factor"))
    return _search(index, store(asked, "vp-queries"), k)
