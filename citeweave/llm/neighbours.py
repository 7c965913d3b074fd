"""Approximate nearest neighbours by a forest of random-projection trees.

Every tree cuts space by hyperplanes between two random points at the median of a sample,
down to small leaves. The forest is fitted on at most ``sample_rows`` vectors (those with
the smallest hashes of their id), and every vector is put into its leaf of every tree. A
query walks all trees through one priority queue, the nearest side of any cut first, until
the leaves it has met hold ``search_share`` of the sample (each sample vector counted once,
in however many leaves it was met), ``search_least`` vectors at least; all vectors in these leaves are ranked by their exact
distance. Vectors without clusters need a large share for a high recall, clustered ones a
small one.

Equal vectors are one entry with their ``k + 1`` smallest ids, which are all that a result
can hold. Vectors are dealt into slices with the numbers of their leaves beside them, and
queries, with the leaves that they reach, into parts; a task ranks one slice for one part.
So a vector is shuffled once for some thousands of queries, not once for each tree, and no
task needs all vectors or all queries.

Defined cases: vectors that are null, empty or zero, or hold a null or a non-finite
component, take no part, nor do rows with a null id or vectors whose length isn't the
most frequent one (the smaller of equals). Ties go to the smaller id. A row that stands
twice is one vector. Other columns are not looked at. Without vectors or queries the
result is empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.llm.common import slices, stored

# Vectors and queries that one task ranks against each other, about.
SLICE_VECTORS = 8192
PART_QUERIES = 4096


class Tree:
    """Cuts as arrays: node i has ``normals[i] · x > offsets[i]``; leaves are ~number.

    ``members`` are the sample rows in each leaf.
    """

    def __init__(self, vectors: np.ndarray, leaf: int, random: np.random.Generator):
        normals, offsets, children, members = [], [], [], []
        todo = [(np.arange(len(vectors)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            if len(rows) > leaf:
                a, b = vectors[random.choice(rows, 2, replace=False)]
                normal = (a - b) / (np.linalg.norm(a - b) or 1.0)
                heights = vectors[rows] @ normal
                middle = np.median(heights)
                above = heights > middle
                if above.any() and not above.all():
                    name = len(normals)
                    normals.append(normal)
                    offsets.append(middle)
                    children.append([0, 0])
                    todo.append((rows[~above], name, 0))
                    todo.append((rows[above], name, 1))
                    if parent is not None:
                        children[parent][side] = name
                    continue
            if parent is not None:
                children[parent][side] = ~len(members)
            members.append(rows)
        dim = vectors.shape[1]
        self.normals = np.array(normals, np.float32).reshape(-1, dim)
        self.offsets = np.array(offsets, np.float32)
        self.children = np.array(children, np.int64).reshape(-1, 2)
        self.members = members

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector."""
        if not len(self.normals):
            return np.zeros(len(vectors), np.int64)
        node = np.zeros(len(vectors), np.int64)
        going = np.arange(len(vectors))
        while len(going):
            at = node[going]
            heights = np.einsum("ij,ij->i", self.normals[at], vectors[going])
            node[going] = self.children[at, (heights > self.offsets[at]).astype(np.int64)]
            going = going[node[going] >= 0]
        return ~node


class Forest:
    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 11):
        random = np.random.default_rng(seed)
        sample = sample.astype(np.float32)
        self.size = len(sample)
        self.trees = [Tree(sample, leaf, random) for _ in range(trees)]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree."""
        return np.stack([tree.leaves(vectors) for tree in self.trees], 1).astype(np.int32)

    def probe(self, queries: np.ndarray, search: int) -> list[list[tuple[int, int]]]:
        """Per query the (tree, leaf) pairs that one queue over all trees reaches."""
        queries = queries.astype(np.float32)
        bases = np.cumsum([0, *(len(tree.normals) for tree in self.trees)]).tolist()
        normals = np.concatenate([tree.normals for tree in self.trees])
        offsets = np.concatenate([tree.offsets for tree in self.trees])
        heights = queries @ normals.T - offsets
        children = [tree.children.tolist() for tree in self.trees]
        out = []
        for row in heights:
            row, found, seen, held = row.tolist(), [], np.zeros(self.size, bool), 0
            queue = [(-np.inf, t, 0 if own else ~0) for t, own in enumerate(children)]
            heapq.heapify(queue)
            while queue and held < search:
                cost, t, node = heapq.heappop(queue)
                if node < 0:
                    found.append((t, ~node))
                    rows = self.trees[t].members[~node]
                    held += len(rows) - int(seen[rows].sum())
                    seen[rows] = True
                    continue
                height = row[bases[t] + node]
                low, high = children[t][node]
                heapq.heappush(queue, (max(cost, height), t, low))
                heapq.heappush(queue, (max(cost, -height), t, high))
            out.append(found)
        return out


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _stack(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _index(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in slices(batches, 2048):
            vectors = _stack(batch.column("vector"), dim).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(forest.leaves(vectors)), pa.list_(pa.int32())),
                    batch.column("ids"),
                    batch.column("vector"),
                ],
                names=["leaves", "ids", "vector"],
            )

    return run


def _probes(shared, dim: int, search: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in slices(batches, 256):
            found = forest.probe(_stack(batch.column("vector"), dim), search)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([np.array(f, np.int32).ravel() for f in found], pa.list_(pa.int32())),
                    batch.column("query"),
                    batch.column("vector"),
                ],
                names=["probes", "query", "vector"],
            )

    return run


def nearest(
    query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest distinct ids by exact distance, ties to smaller ids."""
    distance = np.empty(len(vectors))
    for at in range(0, len(vectors), 8192):
        gap = vectors[at : at + 8192] - query
        distance[at : at + 8192] = np.sqrt((gap * gap).sum(axis=1))
    order = np.lexsort((ids, distance))
    ids, distance = ids[order], distance[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[first], distance[first]


def _rank(dim: int, k: int):
    def run(index: pa.Table, probes: pa.Table) -> pa.Table:
        found = {"query": [], "vec_id": [], "score": []}
        if index.num_rows and probes.num_rows:
            lists = index.column("ids").combine_chunks()
            per = np.diff(lists.offsets.to_numpy())
            ids = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(index.num_rows), per)
            vectors = _stack(index.column("vector"), dim).astype(float)
            leaves = _stack(index.column("leaves"), len(index.column("leaves")[0]))
            queries = _stack(probes.column("vector"), dim).astype(float)
            most = int(leaves.max()) + 1
            for row, query in enumerate(probes.column("query").to_pylist()):
                pairs = np.array(probes.column("probes")[row].as_py()).reshape(-1, 2)
                reached = np.zeros((leaves.shape[1], most), bool)
                pairs = pairs[pairs[:, 1] < most]
                reached[pairs[:, 0], pairs[:, 1]] = True
                met = reached[np.arange(leaves.shape[1]), leaves].any(axis=1)
                mine = np.flatnonzero(met[owner])
                nearby, scores = nearest(queries[row], vectors[owner[mine]], ids[mine], k)
                found["query"].append(np.full(len(nearby), query))
                found["vec_id"].append(nearby)
                found["score"].append(scores)
        kinds = {"query": np.int64, "vec_id": np.int64, "score": float}
        return pa.table(
            {n: np.concatenate([np.empty(0, kinds[n]), *v]).astype(kinds[n]) for n, v in found.items()}
        )

    return run


def search_neighbours(
    spark: SparkSession,
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    trees: int = 16,
    leaf: int = 32,
    search_share: float = 0.5,
    search_least: int = 1500,
    sample_rows: int = 50_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k nearest other rows found.

    ``is_query`` is a condition on ``vec_id``. With more rows than the sample has, leaves
    hold proportionally more; raise ``sample_rows`` with the table to keep them small.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")
    )
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.orderBy(F.desc("n"), "dim").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return spark.createDataFrame([], empty)
    dim = usual["dim"]
    rows = rows.where(F.size("vector") == dim)

    same = Window.partitionBy("vector").orderBy("vec_id")
    firsts = rows.dropDuplicates(["vec_id", "vector"])
    firsts = firsts.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    entries = firsts.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = stored(spark, entries, "entries")

    sample = entries.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(sample_rows)
    sample = np.array(sample.select("vector").toArrow().column(0).combine_chunks().flatten())
    sample = sample.reshape(-1, dim)
    shared = spark.sparkContext.broadcast(Forest(sample, trees, leaf))
    search = max(search_least, round(search_share * len(sample)))

    kind = dict(rows.dtypes)["vector"]
    asked = rows.where(is_query).groupBy("vector").agg(F.min("vec_id").alias("query"))
    asked = stored(spark, asked, "asked")
    n_slices = 1 + entries.count() // SLICE_VECTORS
    n_parts = 1 + asked.count() // PART_QUERIES

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))

    index = entries.mapInArrow(
        _index(shared, dim), f"leaves array<int>, ids array<bigint>, vector {kind}"
    ).select(F.pmod(F.xxhash64("ids"), F.lit(n_slices)).alias("slice"), every(n_parts).alias("part"), "*")
    tasks = spark.sparkContext.defaultParallelism
    probes = asked.repartition(tasks, "query").mapInArrow(
        _probes(shared, dim, search), f"probes array<int>, query long, vector {kind}"
    ).select(every(n_slices).alias("slice"), F.pmod(F.xxhash64("query"), F.lit(n_parts)).alias("part"), "*")
    found = (
        index.groupBy("slice", "part")
        .cogroup(probes.groupBy("slice", "part"))
        .applyInArrow(_rank(dim, k + 1), "query long, vec_id long, score double")
    )
    nearest_first = Window.partitionBy("query").orderBy("score", "vec_id")
    found = found.withColumn("n", F.row_number().over(nearest_first)).where(F.col("n") <= k + 1)

    names = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    names = names.join(asked, "vector").select("query_id", "query")
    own = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = names.join(found.drop("n"), "query").where("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
