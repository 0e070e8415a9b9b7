"""Nearest neighbours by largest inner product from a forest of random-projection trees.

Trees are grown on a bounded sample of vectors. A node splits its part of the sample at the
median along the difference of two of its vectors. All vectors are then indexed: each goes down
every tree to one leaf, and leaves are dealt over the cluster. A query walks all trees through
one shared priority queue, nearest side first, the other side waiting with its distance to the
plane, until the leaves it has reached hold the wanted share of rows. Leaves and the queries that
reach them meet in blocks; each block scores its candidates exactly, in double precision, and
passes on every query's best ``k``.

The share is set at fitting time: the smallest that reached RECALL_AIM on queries within the
sample, against brute force over the sample. Inner products are brought to distances by one more
coordinate, which levels the norms; scores are of the original vectors.

Rows: vectors that are null, zero, or hold null or non-finite components, or whose length is not
the most common one of the sample, take no part. Ties go to the smaller id, equal vectors get
equal scores. Rows that share an id are rows of their own where their vectors differ; a row that
repeats both counts once. A query's candidates are the rows of other ids.
With fewer than k candidates in reach the whole table is searched. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from dyadica.llm.common import arrow_schema

# Trees are grown on at most so many vectors, those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
TREES = 3
# Leaves hold at least so many vectors of the sample; one for so many rows is aimed at.
LEAST_LEAF = 32
LEAF_ROWS = 800
SAMPLE_QUERIES = 200
RECALL_AIM = 0.975
# Neighbouring leaves of a tree form a group of at most about so many numbers; a leaf beyond that
# is cut into blocks of that size. Queries that reach a group meet it in blocks of so many.
GROUP_VALUES = 1 << 20
BLOCK_QUERIES = 1024
# Products of this much less than the k-th best may be better when summed exactly.
SLACK = 1e-9
SEED = 20


@dataclass
class Tree:
    """Nodes in arrays: a plane, its offset, and the two children; leaves are negative."""

    plane: np.ndarray
    offset: np.ndarray
    left: np.ndarray
    right: np.ndarray
    n_leaves: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        if not len(self.offset):
            return at
        open_ = np.arange(len(x))
        while len(open_):
            node = at[open_]
            side = np.einsum("ij,ij->i", x[open_], self.plane[node]) > self.offset[node]
            at[open_] = np.where(side, self.right[node], self.left[node])
            open_ = open_[at[open_] >= 0]
        return -at - 1


def grow(sample: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    planes, offsets, lefts, rights = [], [], [], []
    n_leaves = 0

    def split(rows: np.ndarray, level: int) -> int:
        nonlocal n_leaves
        if level < depth and len(rows) >= 2 * LEAST_LEAF:
            for _ in range(4):
                a, b = rng.choice(rows, 2, replace=False)
                plane = sample[a] - sample[b]
                norm = np.linalg.norm(plane)
                if norm > 0:
                    along = sample[rows] @ (plane / norm)
                    cut = float(np.median(along))
                    high = along > cut
                    if high.any() and not high.all():
                        node = len(planes)
                        planes.append(plane / norm)
                        offsets.append(cut)
                        lefts.append(0)
                        rights.append(0)
                        lefts[node] = split(rows[~high], level + 1)
                        rights[node] = split(rows[high], level + 1)
                        return node
        n_leaves += 1
        return -n_leaves

    split(np.arange(len(sample)), 0)
    width = sample.shape[1]
    return Tree(
        np.asarray(planes).reshape(-1, width), np.asarray(offsets), np.asarray(lefts, dtype=np.int64),
        np.asarray(rights, dtype=np.int64), n_leaves,
    )


@dataclass
class Forest:
    width: int
    largest: float
    trees: list[Tree]
    share: float = 1.0

    def level(self, x: np.ndarray) -> np.ndarray:
        """Vectors with one more coordinate, by which all reach the same norm."""
        rest = np.sqrt(np.maximum(self.largest - np.einsum("ij,ij->i", x, x), 0.0))
        return np.hstack([x, rest[:, None]])

    def reach(self, queries: np.ndarray, sizes: list[np.ndarray], rows: float) -> list[list[tuple[int, int]]]:
        """The (tree, leaf) of every query, in the order of the shared queue, until they hold
        ``rows`` rows."""
        x = np.hstack([queries, np.zeros((len(queries), 1))])
        norm = np.linalg.norm(queries, axis=1, keepdims=True)
        x *= np.sqrt(self.largest) / np.where(norm > 0, norm, 1.0)
        sides = [x @ t.plane.T - t.offset if len(t.offset) else None for t in self.trees]
        out = []
        for q in range(len(x)):
            queue = [(0.0, t, 0 if len(tree.offset) else -1) for t, tree in enumerate(self.trees)]
            heapq.heapify(queue)
            found, held = [], 0
            while queue and held < rows:
                far, t, node = heapq.heappop(queue)
                tree = self.trees[t]
                while node >= 0:
                    side = sides[t][q, node]
                    near, other = (tree.right, tree.left) if side > 0 else (tree.left, tree.right)
                    heapq.heappush(queue, (max(far, abs(side)), t, int(other[node])))
                    node = int(near[node])
                found.append((t, -node - 1))
                held += int(sizes[t][-node - 1])
            out.append(found)
        return out


def fit(vectors: DataFrame, k: int) -> Forest | None:
    """Grow the forest on the sample and set its share. Only the sample reaches the driver."""
    n = vectors.count()
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vec").toPandas()["vec"].tolist()
    if not rows:
        return None
    lengths, counts = np.unique([len(r) for r in rows], return_counts=True)
    width = int(lengths[np.argmax(counts)])
    sample = np.asarray([r for r in rows if len(r) == width], dtype=np.float64)
    largest = vectors.filter(F.size("vec") == width).agg(
        F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    ).first()[0]
    forest = Forest(width, float(largest), [])
    leveled = forest.level(sample)
    rng = np.random.default_rng(SEED)
    depth = max(0, int(np.ceil(np.log2(max(1, n) / LEAF_ROWS))))
    forest.trees = [grow(leveled, depth, rng) for _ in range(TREES)]
    forest.share = _share(forest, sample, leveled, k, rng)
    return forest


def _share(forest: Forest, sample: np.ndarray, leveled: np.ndarray, k: int, rng: np.random.Generator) -> float:
    """The smallest share of rows at which sampled queries find RECALL_AIM of their neighbours."""
    n = len(sample)
    if n <= 2 * k:
        return float(TREES)
    picked = rng.choice(n, min(SAMPLE_QUERIES, n), replace=False)
    leaves = [t.leaves(leveled) for t in forest.trees]
    sizes = [np.bincount(x, minlength=t.n_leaves) for x, t in zip(leaves, forest.trees, strict=True)]
    product = sample[picked] @ sample.T
    product[np.arange(len(picked)), picked] = -np.inf
    best = np.argsort(-product, axis=1, kind="stable")[:, :k]
    order = forest.reach(sample[picked], sizes, float("inf"))
    needed = np.empty(best.shape)
    for q, path in enumerate(order):
        first = [np.full(t.n_leaves, np.inf) for t in forest.trees]
        held = 0
        for t, leaf in path:
            first[t][leaf] = held
            held += sizes[t][leaf]
        needed[q] = np.min([first[t][leaves[t][best[q]]] for t in range(len(first))], axis=0)
    return float(min(TREES, np.quantile(needed, RECALL_AIM) / n + 1e-6))


def valid(df: DataFrame, id: str, vector: str) -> DataFrame:
    """Rows that take part, as (id, vec array of double)."""
    vec = F.col(vector).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    some = F.exists(vec, lambda x: x != 0)
    return df.select(F.col(id).cast("bigint").alias("id"), vec.alias("vec")).filter(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & some
    )


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.asarray(column.flatten()).reshape(batch.num_rows, -1).astype(np.float64, copy=False)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, forest: Forest | None = None) -> DataFrame:
    """The ``k`` nearest rows of every query: query_id, rank, vec_id, score.

    ``vectors`` and ``queries`` are (id, vec), as ``valid`` gives them.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    forest = forest or fit(vectors, k)
    if forest is None:
        return spark.createDataFrame([], result)
    held = spark.sparkContext.broadcast(forest)  # at most 2 * SAMPLE_ROWS / LEAST_LEAF planes a tree
    width = forest.width
    vectors = vectors.filter(F.size("vec") == width)
    queries = queries.filter(F.size("vec") == width)

    leaf_kind = arrow_schema("tree int, leaf int, id long, vec array<double>")

    def to_leaves(batches):
        f = held.value
        for b in batches:
            if b.num_rows:
                x = f.level(_matrix(b, "vec"))
                for t, tree in enumerate(f.trees):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(tree.leaves(x).astype(np.int32)),
                         b.column(0), b.column(1)], schema=leaf_kind)

    placed = vectors.select("id", "vec").mapInArrow(to_leaves, "tree int, leaf int, id long, vec array<double>")
    # One number a leaf: bounded by the number of leaves.
    per_leaf = {(r.tree, r.leaf): r.n for r in placed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_rows = sum(v for (t, _), v in per_leaf.items() if t == 0)
    sizes = [np.array([per_leaf.get((t, leaf), 0) for leaf in range(tree.n_leaves)]) for t, tree in enumerate(forest.trees)]
    wanted = max(forest.share * n_rows, 4.0 * k * TREES)
    if n_rows <= 4 * k * TREES:
        wanted = float("inf")

    # Leaves in the order of their tree are neighbours, so a query mostly reaches a few groups.
    most = max(1024, GROUP_VALUES // width)
    groups, n_groups = [], 0
    for own in sizes:
        of, filled = np.zeros(len(own), dtype=np.int32), 0
        for leaf, n in enumerate(own):
            if filled and filled + n > most:
                n_groups, filled = n_groups + 1, 0
            of[leaf], filled = n_groups, filled + int(n)
        groups.append(of)
        n_groups += 1
    group_rows = np.zeros(n_groups, dtype=np.int64)
    for of, own in zip(groups, sizes, strict=True):
        np.add.at(group_rows, of, own)

    reach_schema = "group int, id long, vec array<double>, leaves array<int>"
    reach_kind = arrow_schema(reach_schema)

    def to_reached(batches):
        f = held.value
        for b in batches:
            if not b.num_rows:
                continue
            row, group, leaves = [], [], []
            for q, path in enumerate(f.reach(_matrix(b, "vec"), sizes, wanted)):
                by_group: dict[int, list[int]] = {}
                for t, leaf in path:
                    by_group.setdefault(int(groups[t][leaf]), []).append(leaf)
                row += [q] * len(by_group)
                group += by_group
                leaves += by_group.values()
            for start in range(0, len(row), 20_000):
                part = slice(start, start + 20_000)
                take = pa.array(row[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[part], pa.int32()), b.column(0).take(take), b.column(1).take(take),
                     pa.array(leaves[part], pa.list_(pa.int32()))], schema=reach_kind)

    reached = queries.select("id", "vec").mapInArrow(to_reached, reach_schema)
    visits = {r.group: r.n for r in reached.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Every block of a group's rows meets every block of the queries that reach it.
    n_a = [int(-(-n // most)) for n in group_rows]
    n_b = [-(-visits.get(g, 0) // BLOCK_QUERIES) for g in range(n_groups)]
    of_leaf = [(t, leaf, int(g), n_a[g], n_b[g]) for t, of in enumerate(groups) for leaf, g in enumerate(of)]
    leaf_table = F.broadcast(spark.createDataFrame(of_leaf, "tree int, leaf int, group int, n_a int, n_b int"))
    group_table = F.broadcast(spark.createDataFrame([(g, n_a[g], n_b[g]) for g in range(n_groups)], "group int, n_a int, n_b int"))
    spread = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows_at = (
        placed.join(leaf_table, ["tree", "leaf"]).filter("n_b > 0")
        .withColumn("a", spread(F.col("n_a"))).withColumn("b", every(F.col("n_b")))
        .select("group", "a", "b", "id", "vec", "leaf")
    )
    queries_at = (
        reached.join(group_table, "group").filter("n_a > 0")
        .withColumn("b", spread(F.col("n_b"))).withColumn("a", every(F.col("n_a")))
        .select("group", "a", "b", "id", "vec", "leaves")
    )
    best_kind = arrow_schema("query_id long, vec_id long, score double")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return best_kind.empty_table()
        left, right = left.combine_chunks().to_batches()[0], right.combine_chunks().to_batches()[0]
        ids, x = np.asarray(left.column("id")), _matrix(left, "vec")
        q_ids, q = np.asarray(right.column("id")), _matrix(right, "vec")
        known, leaf = np.unique(np.asarray(left.column("leaf")), return_inverse=True)
        reaches = np.array([np.isin(known, leaves) for leaves in right.column("leaves").to_pylist()])
        out_q, out_v, out_s = [], [], []
        for start in range(0, len(q), 128):
            part = slice(start, start + 128)
            product = q[part] @ x.T
            product[~reaches[part][:, leaf] | (q_ids[part, None] == ids[None, :])] = -np.inf
            for row, near in enumerate(product, start):
                if len(ids) > k:
                    near_k = np.partition(near, len(near) - k)[-k]
                    cand = np.flatnonzero((near >= near_k - SLACK * max(1.0, abs(near_k))) & (near > -np.inf))
                else:
                    cand = np.flatnonzero(near > -np.inf)
                score = np.sum(x[cand] * q[row], axis=1)
                top = np.lexsort((ids[cand], -score))[:k]
                out_q.append(np.full(len(top), q_ids[row]))
                out_v.append(ids[cand][top])
                out_s.append(score[top])
        return pa.table([np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)], schema=best_kind)

    key = ["group", "a", "b"]
    met = rows_at.groupBy(*key).cogroup(queries_at.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")
    # A row reached through several trees has one score, so its copies share a rank.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k)
    return ranked.groupBy("query_id", "rank", "vec_id").agg(F.first("score").alias("score")).select(
        "query_id", "rank", "vec_id", "score")
