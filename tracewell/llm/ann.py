"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample of unit vectors: a node with many sample points is split by k-means into BRANCH
children, down to leaves of about LEAF_ROWS rows of the table, so leaves grow in number with the table as far as the sample allows. Every
row is indexed: it goes down to the leaf of the nearest centroids. A query walks the tree with a priority queue
of branches, nearest centroid first, and visits leaves until it has seen as many as calibration asks for (and enough rows).
Calibration holds out sample points, finds their true neighbours in the sample, and widens the number of leaves until the
share of them that is found reaches TARGET.

Rows and queries meet by block: a run of neighbouring leaves of BLOCK_ROWS rows in all, or a part of a leaf that holds more, so a leaf that
holds a third of all rows is many blocks. A query is sent once to each block that has a leaf it visits, with those leaves' numbers. A
task holds one block's rows and lets the queries pass by in batches; only rows of visited leaves are compared, in double precision.

Defined cases: rows whose id or vector is null, whose vector is zero or holds null or non-finite components take no part. Vectors of
another length have no cosine with a query's: each length is an index of its own (MOST_LENGTHS of them; more are an error). Equal scores go to the
smaller id. Repeated rows of an id count once, with the best score of its vectors. A table of fewer candidates than asked for gives all
of them; an empty one gives no rows. Columns of other names are not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

EVERY = 50  # rows whose id is divisible by this are the queries
NEAREST = 5
SAMPLE = 50_000  # rows that a tree is fitted on, at most
SAMPLE_NUMBERS = 8_000_000  # and numbers in them
BRANCH = 8
LEAF_ROWS = 64  # rows of the table that a leaf should hold
LEAST_POINTS = 8  # of the sample in a leaf that is split no further
TARGET = 0.93
CALIBRATION = 400
BLOCK_ROWS = 20_000
MOST_LENGTHS = 16


class Tree:
    """Nodes as arrays: each has its children's numbers and centroids; a leaf has its number."""

    def __init__(self, points: np.ndarray, leaf_points: int = LEAF_ROWS, seed: int = 5):
        self.children: list[list[int]] = [[]]
        self.centroids: list[np.ndarray | None] = [None]
        self.leaf = [-1]
        self.leaves = 0
        random, todo = np.random.default_rng(seed), [(0, points)]
        while todo:
            node, own = todo.pop()
            groups = self._split(own, random) if len(own) > leaf_points else []
            if len(groups) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            self.centroids[node] = np.stack([c for c, _ in groups])
            for _, part in groups:
                self.children[node].append(len(self.leaf))
                self.children.append([])
                self.centroids.append(None)
                self.leaf.append(-1)
                todo.append((self.children[node][-1], part))

    @staticmethod
    def _split(points: np.ndarray, random) -> list[tuple[np.ndarray, np.ndarray]]:
        centers = points[random.choice(len(points), min(BRANCH, len(points)), replace=False)]
        for _ in range(12):
            near = (points @ centers.T).argmax(axis=1)
            sums = np.stack([points[near == k].sum(axis=0) for k in range(len(centers))])
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centers = np.where(length > 0, sums / np.maximum(length, 1e-300), centers)
        near = (points @ centers.T).argmax(axis=1)
        return [(centers[k], points[near == k]) for k in range(len(centers)) if (near == k).any()]

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector."""
        out, todo = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            near = (points[rows] @ self.centroids[node].T).argmax(axis=1)
            todo += [(child, part) for k, child in enumerate(self.children[node]) if len(part := rows[near == k])]
        return out

    def walk(self, query: np.ndarray):
        """Leaves in the order of a best-bin-first search."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while self.leaf[node] < 0:
                near = self.centroids[node] @ query
                best = int(near.argmax())
                for k, child in enumerate(self.children[node]):
                    if k != best:
                        heapq.heappush(queue, (-float(near[k]), child))
                node = self.children[node][best]
            yield self.leaf[node]


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def scaled(points: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square over- or underflows; their cosines stay as they are."""
    return np.ldexp(points, -np.frexp(np.abs(points).max(axis=1, keepdims=True))[1])


def unit(points: np.ndarray) -> np.ndarray:
    points = scaled(points)
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def calibrate(tree: Tree, points: np.ndarray, nearest: int = NEAREST, target: float = TARGET) -> int:
    """Leaves to visit so that held-out points find ``target`` of their true neighbours in the sample."""
    some = np.linspace(0, len(points) - 1, min(CALIBRATION, len(points))).astype(int)
    leaf, ranks = tree.assign(points), []
    for i in np.unique(some):
        near = points @ points[i]
        near[i] = -2
        true = np.argpartition(-near, min(nearest, len(near) - 1))[:nearest]
        place = {x: k for k, x in enumerate(tree.walk(points[i]))}
        ranks += [place[x] for x in leaf[true].tolist()]
    return max(1, int(np.quantile(ranks, target, method="higher")) + 1) if ranks else 1


def fit(rows: DataFrame, size: int) -> tuple[Tree, int]:
    """(tree, leaves to visit) from a sample of (vec_id, v) rows of one length."""
    most = max(1000, min(SAMPLE, SAMPLE_NUMBERS // size))
    # as common.bounded_sample, but of ids: copies of a row would fill the sample and pass for its neighbours
    near = F.xxhash64("vec_id").bitwiseAND(F.lit(2**52 - 1)) / float(2**52)
    ids = rows.agg(F.count_distinct("vec_id")).first()[0]
    sample = rows.where(near <= (1.1 * most + 20) / max(1, ids)).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(near, "vec_id").limit(most)
    found = sample.orderBy("vec_id").toPandas()  # SAMPLE rows at most
    points = unit(np.stack(found["v"].to_numpy()).astype(np.float64))
    tree = Tree(points, max(LEAST_POINTS, LEAF_ROWS * len(points) // max(1, ids)))
    return tree, calibrate(tree, points)


def numbers(column: pa.Array, size: int) -> np.ndarray:
    """An Arrow column of arrays of ``size`` numbers as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


class Block:
    """Rows of a block by leaf, with their ids."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: np.ndarray):
        order = np.lexsort((ids, leaf))
        self.ids, self.rows, leaf = ids[order], scaled(rows[order]), leaf[order]
        self.length = np.sqrt((self.rows * self.rows).sum(axis=1))
        self.leaves, at = np.unique(leaf, return_index=True)
        self.at = np.append(at, len(leaf))
        self.by_id = np.argsort(self.ids, kind="stable")
        self.first = np.flatnonzero(np.diff(self.ids[self.by_id], prepend=self.ids[self.by_id[0]] - 1))  # of each id

    def best(self, queries: np.ndarray, ids: np.ndarray, leaves: list, nearest: int) -> list[list[tuple[float, int]]]:
        """(score, id) of the nearest rows of each query in the leaves that it visits, in order. Scores are summed alike for equal
        vectors, whatever the block."""
        out = []
        for start in range(0, len(queries), 256):
            part = scaled(queries[start : start + 256])
            length = np.sqrt((part * part).sum(axis=1))
            near = np.full((len(part), len(self.rows)), -np.inf)
            wants = [np.isin(self.leaves, x) for x in leaves[start : start + 256]]
            for k, (low, high) in enumerate(zip(self.at[:-1], self.at[1:], strict=True)):
                some = np.flatnonzero([w[k] for w in wants])
                if len(some):
                    near[some, low:high] = (part[some] @ self.rows[low:high].T) / (length[some, None] * self.length[None, low:high])
            near[ids[start : start + 256, None] == self.ids[None, :]] = -np.inf
            k = min(nearest, len(self.first))
            each = near if len(self.first) == len(self.ids) else np.maximum.reduceat(near[:, self.by_id], self.first, axis=1)  # an id's best
            floor = -np.partition(-each, k - 1, axis=1)[:, k - 1] - 1e-9
            for i in range(len(part)):
                some = np.flatnonzero((near[i] >= floor[i]) & (near[i] > -np.inf))
                score = (part[i] * self.rows[some]).sum(axis=1) / (length[i] * self.length[some])
                seen: dict[int, float] = {}
                for j in np.lexsort((self.ids[some], -score)):
                    seen.setdefault(int(self.ids[some[j]]), float(score[j]))
                    if len(seen) == nearest:
                        break
                out.append([(s, x) for x, s in seen.items()])
        return out


def blocks_of(counts: dict[int, int], most: int | None = None) -> dict[int, tuple[int, int]]:
    """leaf -> (first block, parts): neighbouring leaves share a block of ``most`` rows; a leaf of more rows has parts of its own."""
    most = most or BLOCK_ROWS
    out, block, held = {}, 0, 0
    for leaf in sorted(counts):
        n = counts[leaf]
        if held and held + n > most:
            block, held = block + 1, 0
        parts = -(-n // most)
        out[leaf] = (block, parts)
        if parts > 1:
            block, held = block + parts, 0
        else:
            held += n
    return out


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` against ``vectors``, both of (vec_id, v)."""
    lengths = [r[0] for r in vectors.groupBy(F.size("v").alias("n")).agg(F.count("*")).orderBy("n").limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if not lengths else None
    for n in lengths:
        found = _search(vectors.where(F.size("v") == n), queries.where(F.size("v") == n), n, nearest)
        out = found if out is None else out.union(found)
    return out


def _search(vectors: DataFrame, queries: DataFrame, size: int, nearest: int) -> DataFrame:
    tree, visits = fit(vectors, size)
    shared = vectors.sparkSession.sparkContext.broadcast(tree)  # bounded by the sample

    def down(batches):
        for b in batches:
            leaf = shared.value.assign(unit(numbers(b.column("v"), size))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(leaf, pa.int64())], names=["vec_id", "v", "leaf"])

    own = vectors.select("vec_id", "v").dropDuplicates(["vec_id", "v"])
    indexed = common.materialize(own.mapInArrow(common.tidied(down), "vec_id long, v array<double>, leaf long"), "ann-index")
    blocks = blocks_of(dict(indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect()))  # a row for each leaf
    homes = indexed.groupBy("vec_id").agg(F.min("leaf").alias("leaf"))  # an id counts in one leaf alone
    known = dict(homes.groupBy("leaf").agg(F.count("*").alias("n")).collect())  # a row for each leaf

    def visit(batches):
        """A row for each block that a query goes to, with the leaves that it visits there."""
        for b in batches:
            ids, vectors, block, leaves = [], [], [], []
            for i, v, whole in zip(b.column("vec_id").to_pylist(), unit(numbers(b.column("v"), size)) if b.num_rows else [], b.column("v"), strict=True):
                seen, held, goes = 0, 0, {}
                for leaf in shared.value.walk(v):
                    seen, held = seen + 1, held + known.get(leaf, 0)
                    if leaf in blocks:
                        for part in range(blocks[leaf][1]):
                            goes.setdefault(blocks[leaf][0] + part, []).append(leaf)
                    if seen >= visits and held > nearest:
                        break
                for to, own in goes.items():
                    ids.append(i)
                    vectors.append(whole)
                    block.append(to)
                    leaves.append(own)
            made = [pa.array(block, pa.int64()), pa.array([1] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array([x.as_py() for x in vectors], pa.list_(pa.float64())), pa.array(leaves, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, names=["block", "asks", "id", "v", "leaves"])

    shape = "block long, asks int, id long, v array<double>, leaves array<long>"
    places = vectors.sparkSession.createDataFrame([(leaf, *x) for leaf, x in blocks.items()], "leaf long, first long, parts long")  # a row for each leaf
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    rows = indexed.join(F.broadcast(places), "leaf").select((F.col("first") + part).alias("block"), F.lit(0).alias("asks"), F.col("vec_id").alias("id"), "v", F.array("leaf").alias("leaves"))
    asked = queries.select("vec_id", "v").mapInArrow(common.tidied(visit), shape)

    def meet(batches):
        """Rows of a block come first and are held; its queries then pass by."""
        at, held, block = None, [], None
        for b in batches:
            keys, asks = b.column("block").to_numpy(), b.column("asks").to_numpy()
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(asks) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if low == high:
                    continue
                if keys[low] != at:
                    at, held, block = keys[low], [], None
                some = b.slice(low, high - low)
                ids, matrix = some.column("id").to_numpy(), numbers(some.column("v"), size)
                if not asks[low]:
                    held.append((ids.copy(), matrix.copy(), some.column("leaves").flatten().to_numpy().copy()))
                    continue
                if block is None and held:
                    block, held = Block(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                if block is not None:
                    near = block.best(matrix, ids, some.column("leaves").to_pylist(), nearest)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([[{"far": -s, "vec_id": x} for s, x in n] for n in near], pa.list_(pa.struct([("far", pa.float64()), ("vec_id", pa.int64())])))], names=["query_id", "found"])

    met = rows.union(asked).repartition("block").sortWithinPartitions("block", "asks")
    met = met.mapInArrow(common.tidied(meet), "query_id long, found array<struct<far:double,vec_id:long>>")
    met = met.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))  # a short list for each block visited
    none = F.array().cast("array<struct<far:double,vec_id:long>>")
    top = F.aggregate("found", none, lambda a, x: F.when((F.size(a) >= nearest) | F.exists(a, lambda y: y["vec_id"] == x["vec_id"]), a).otherwise(F.array_append(a, x)))  # an id's best
    ranked = met.select("query_id", F.posexplode(top).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def usable_rows(table: DataFrame) -> DataFrame:
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable_rows(common.read(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
