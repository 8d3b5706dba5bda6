"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree has two levels of fitting. Its top, of at most TOP leaves, is fitted to a bounded sample on the driver; below
each top leaf that holds many vectors a tree of its own is fitted inside Spark to a bounded sample of that leaf, so
leaves grow with the table. Every vector is indexed. A query walks a tree through a priority queue, nearest centroid
first, and visits leaves until their number, calibrated on sample queries against brute force, is reached; it walks
the own trees of the top leaves that it visits where their vectors are.

Neighbouring top leaves make up parts of equal size. Vectors are sent once, to their part, and a query once to each
part in which it visits leaves; what leaves a part are a query's k best in it.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2), where M is the largest norm.
"""

from __future__ import annotations

import heapq
import math
import pickle
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import quoted, stage

BRANCH = 8
#: Leaves of the top tree, about; and vectors to which the tree of one top leaf is fitted, about.
TOP, LOCAL_SAMPLE = 1024, 8192
#: Vectors of a part, about, once there are more parts than twice the cores; vectors and queries multiplied at a time.
PART, _VECTORS, _QUERIES = 200_000, 8192, 1024


@dataclass
class Node:
    centroids: np.ndarray
    children: list = field(default_factory=list)  # Node, or the number of a leaf


@dataclass
class Tree:
    root: Node
    leaves: int
    norm: float  # the largest norm of all vectors

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the coordinate that turns inner products into distances."""
        return np.concatenate([x, np.sqrt(np.maximum(self.norm**2 - (x**2).sum(axis=1), 0))[:, None]], axis=1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each (lifted) vector: the nearest centroid at each level."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            near = _distances(x[rows], node.centroids).argmin(axis=1)
            for k, child in enumerate(node.children):
                mine = rows[near == k]
                if isinstance(child, Node):
                    todo.append((child, mine))
                else:
                    out[mine] = child
        return out

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        query = np.append(query, 0.0)
        queue, tick = [(0.0, 0, self.root)], 0
        while queue:
            _, _, node = heapq.heappop(queue)
            if not isinstance(node, Node):
                yield node
                continue
            for d, child in zip(_distances(query[None], node.centroids)[0].tolist(), node.children):
                tick += 1
                heapq.heappush(queue, (d, tick, child))


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, less the queries' own norms."""
    return (centroids**2).sum(axis=1)[None] - 2 * x @ centroids.T


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _distances(x, centroids).argmin(axis=1)
        for j in range(k):
            mine = x[near == j]
            centroids[j] = mine.mean(axis=0) if len(mine) else x[rng.integers(len(x))]
    return centroids, _distances(x, centroids).argmin(axis=1)


def fit_tree(sample: np.ndarray, norm: float, leaves: int, seed: int = 5) -> Tree:
    """Splits the sample by k-means, level by level, until parts hold about len(sample) / leaves vectors."""
    rng = np.random.default_rng(seed)
    tree = Tree(Node(np.zeros((1, sample.shape[1] + 1))), 0, norm)
    most = max(1, len(sample) // max(1, leaves))

    def grow(x: np.ndarray) -> Node:
        centroids, near = _k_means(x, min(BRANCH, len(x)), rng)
        node = Node(centroids)
        for k in range(len(centroids)):
            mine = x[near == k]
            if len(mine) > most and len(mine) > BRANCH and len(mine) < len(x):
                node.children.append(grow(mine))
            else:
                node.children.append(tree.leaves)
                tree.leaves += 1
        return node

    tree.root = grow(tree.lifted(sample))
    return tree


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


class _Best:
    """The k best candidates of each of a list of queries, as blocks of vectors pass."""

    def __init__(self, rids: np.ndarray, queries: np.ndarray, k: int):
        self.rids, self.queries, self.k = rids, queries, k
        self.least = np.full(len(rids), -np.inf)  # the k-th best score so far
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, which: np.ndarray, rids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, *more: np.ndarray) -> None:
        """Scores vectors for the queries `which`; `more` are further columns to keep of the vectors."""
        order = np.argsort(rids)
        for lo in range(0, len(which), _QUERIES):
            q = which[lo : lo + _QUERIES]
            rough = self.queries[q] @ vectors.T
            own = np.minimum(np.searchsorted(rids, self.rids[q], sorter=order), len(rids) - 1)
            same = rids[order[own]] == self.rids[q]
            rough[np.flatnonzero(same), order[own[same]]] = -np.inf
            bar = self.least[q]
            if rough.shape[1] > self.k:
                bar = np.maximum(bar, np.partition(rough, rough.shape[1] - self.k, axis=1)[:, rough.shape[1] - self.k])
            # with all that rounding might tie with the last
            i, j = np.nonzero((rough >= np.where(np.isinf(bar), bar, bar - 1e-9 * np.maximum(1.0, np.abs(bar)))[:, None]) & (rough > -np.inf))
            exact = (vectors[j] * self.queries[q[i]]).sum(axis=1)  # one sum for equal vectors, wherever they stand
            self.held.append((q[i], exact, ids[j], *(m[j] for m in more)))
            self.n += len(i)
            if self.n > 1 << 20:
                self._cut()

    def _cut(self) -> None:
        columns = [np.concatenate(c) for c in zip(*self.held)]
        order = np.lexsort((columns[2], -columns[1], columns[0]))
        columns = [c[order] for c in columns]
        begin = np.searchsorted(columns[0], columns[0])
        rank = np.arange(len(begin)) - begin
        last = rank == self.k - 1
        self.least[columns[0][last]] = columns[1][last]
        self.held, self.n = [tuple(c[rank < self.k] for c in columns)], int((rank < self.k).sum())

    def result(self) -> tuple[np.ndarray, ...] | None:
        """(query, score, id, ...) of the k best of each query, or None."""
        if not self.held:
            return None
        self._cut()
        return self.held[0]


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): doubles of vectors with an id, of the commonest length, that are finite and not zero."""
    v = F.col(quoted(vector_col)).cast("array<double>")
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (dims["d"] if dims else 0))


_FOUND = "rid long, query_id long, vec_id long, score double"


def nearest(
    vectors: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    recall: float = 0.95,
    sample: int = 20_000,
    calibration: int = 200,
    leaf_size: int = 1_000,
    top: int = TOP,
) -> DataFrame:
    """One row per query and neighbour: query_id, rank (from 1), vec_id, score (inner product in doubles).

    Queries are the rows where `is_query` (a Column over id) holds; a query's candidates are all rows but itself, so
    rows that share an id are queries and candidates each of their own, and two lists go by one query_id. The top tree
    is fitted to at most `sample` vectors and calibrated with at most `calibration` queries, the smallest by hash;
    every vector is indexed. Ties go to the smaller id. Null, zero and non-finite vectors, vectors of another length
    than the commonest and null ids take no part; an empty table gives an empty table.

    A query whose visited leaves hold fewer than k candidates, though there are more, visits all leaves.

    Of equal vectors only the k + 1 smallest ids can be among a query's k nearest, so only those are scored.
    """
    spark = vectors.sparkSession

    @F.pandas_udf("struct<v binary, norm double>")
    def packed(s: pd.Series) -> pd.DataFrame:
        x = [np.asarray(v, dtype=np.float64) for v in s]
        return pd.DataFrame({"v": [v.tobytes() for v in x], "norm": [float(np.sqrt((v * v).sum())) for v in x]})

    rows = usable_vectors(vectors, id_col, vector_col).select(F.monotonically_increasing_id().alias("rid"), "id", packed("v").alias("p"))
    rows = stage(rows.select("rid", "id", "p.*"), "vectors")
    total = rows.agg(F.max("norm").alias("m"), F.count("*").alias("n")).first()
    some = rows.orderBy(F.xxhash64("rid"), "rid").limit(sample).select("v").collect()  # `sample` rows
    if not some:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = fit_tree(_matrix([r["v"] for r in some]), float(total["m"]), min(top, max(8, total["n"] // leaf_size)))
    shared = spark.sparkContext.broadcast(tree)

    @F.pandas_udf("int")
    def top_leaf(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.leaf_of(shared.value.lifted(_matrix(list(v)))) if len(v) else [], dtype="int32")

    alike = Window.partitionBy("v").orderBy("id", "rid")
    kept = rows.withColumn("copy", F.row_number().over(alike)).where(F.col("copy") <= k + 1)
    indexed = stage(kept.select("rid", "id", "v", top_leaf("v").alias("top")), "leaves")
    count = np.zeros(tree.leaves, dtype=np.int64)
    for r in indexed.groupBy("top").agg(F.count("*").alias("n")).collect():  # a row per top leaf
        count[r["top"]] = r["n"]
    trees = _local_trees(indexed, count, float(total["m"]), leaf_size)
    queries = rows.where(is_query).select("rid", "id", "v")
    visits, within = _calibrate(tree, trees, indexed, queries, k, recall, calibration)
    # top leaf t lies in parts first[t] to last[t]
    total_kept = int(count.sum())
    n_parts = max(2 * spark.sparkContext.defaultParallelism, total_kept // PART)
    begin = np.cumsum(count) - count
    first, last = begin * n_parts // total_kept, np.maximum(begin, begin + count - 1) * n_parts // total_kept
    plan = spark.sparkContext.broadcast((count, first, last))

    @F.pandas_udf("int")
    def part_of(top: pd.Series, rid: pd.Series) -> pd.Series:
        t = top.to_numpy()
        _, first, last = plan.value
        return pd.Series(first[t] + rid.to_numpy() % (last[t] - first[t] + 1)).astype("int32")

    def visited(visits: int):
        @F.pandas_udf("array<struct<part:int,tops:array<int>>>")
        def to_visit(q: pd.Series) -> pd.Series:
            tree, (count, first, last) = shared.value, plan.value
            out = []
            for query in _matrix(list(q)) if len(q) else ():
                found, seen, mine = 0, 0, {}
                for leaf in tree.visits(query):
                    if seen >= visits and found > k:
                        break
                    seen += 1
                    found += count[leaf]
                    for part in range(first[leaf], last[leaf] + 1) if count[leaf] else ():
                        mine.setdefault(part, []).append(leaf)
                out.append([{"part": int(p), "tops": tops} for p, tops in mine.items()])
            return pd.Series(out)

        return to_visit

    none = F.lit(None).cast("array<int>")
    stored = indexed.select(part_of("top", "rid").alias("part"), F.lit(2).alias("kind"), "top", "rid", "id", "v", none.alias("tops"))
    if trees is not None:
        copies = spark.createDataFrame([(t, p) for t in np.flatnonzero(count).tolist() for p in range(int(first[t]), int(last[t]) + 1)], "top int, part int")  # at most parts and top leaves together
        stored = stored.unionByName(trees.join(F.broadcast(copies), "top").select("part", F.lit(0).alias("kind"), "top", F.lit(0).cast("long").alias("rid"), F.lit(0).cast("long").alias("id"), F.col("tree").alias("v"), none.alias("tops")))
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")

    def ranked(queries: DataFrame, visits: int, within: int) -> DataFrame:
        asked = queries.withColumn("t", F.explode(visited(visits)("v"))).select("t.part", F.lit(1).alias("kind"), F.lit(-1).alias("top"), "rid", "id", "v", "t.tops")
        dealt = asked.unionByName(stored).repartition("part").sortWithinPartitions("part", "kind", "top")
        return dealt.mapInArrow(_search(k, within), _FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    found = stage(ranked(queries, visits, within), "near")
    # leaves that were visited may hold fewer than k: such queries visit all
    whole = found.groupBy("rid").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, total["n"] - 1)).select("rid")
    short = queries.join(whole, "rid", "left_anti") if total["n"] > 1 else queries.limit(0)
    if not short.isEmpty():
        found = found.join(whole, "rid", "left_semi").unionByName(ranked(short, tree.leaves, sys.maxsize).select(*found.columns))
    return found.select("query_id", "rank", "vec_id", "score")


def _local_trees(indexed: DataFrame, count: np.ndarray, norm: float, leaf_size: int) -> DataFrame | None:
    """(top, tree) of the top leaves that hold many vectors, each fitted to a sample of its own; None if there are none."""
    large = np.flatnonzero(count > 4 * leaf_size)
    if not len(large):
        return None
    steps = [(int(t), max(1, int(count[t]) // LOCAL_SAMPLE), int(count[t]) // leaf_size) for t in large]  # at most a row per top leaf
    plan = indexed.sparkSession.createDataFrame(steps, "top int, step long, leaves long")
    some = indexed.join(F.broadcast(plan), "top").where(F.pmod(F.xxhash64("rid"), "step") == 0)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        made = fit_tree(_matrix(list(rows["v"])), norm, int(rows["leaves"].iloc[0]), seed=7)
        return pd.DataFrame({"top": [rows["top"].iloc[0]], "tree": [pickle.dumps(made)]})

    return stage(some.select("top", "leaves", "v").groupBy("top").applyInPandas(fit, "top int, tree binary"), "trees")


class _Part:
    """Trees, queries and, as they pass, vectors of one part."""

    def __init__(self, k: int, within: int):
        self.k, self.within = k, within
        self.trees: dict[int, Tree] = {}
        self.asked: list[tuple] = []
        self.best: _Best | None = None

    def ask(self, rids: np.ndarray, ids: np.ndarray, v: list[bytes], tops: list[list[int]]) -> None:
        self.asked.append((rids, ids, _matrix(v), tops))

    def _ready(self) -> None:
        rids, self.ids, queries = (np.concatenate([a[c] for a in self.asked]) for c in range(3))
        self.best = _Best(rids, queries, self.k)
        self.of_top: dict[int, list[int]] = {}
        for q, tops in enumerate(t for a in self.asked for t in a[3]):
            for top in tops:
                self.of_top.setdefault(top, []).append(q)
        self.now, self.of_leaf = None, {}

    def score(self, top: int, rids: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        if not self.asked:
            return
        if self.best is None:
            self._ready()
        which = self.of_top.get(top)
        if not which:
            return
        tree = self.trees.get(top)
        if tree is None:
            self.best.add(np.array(which), rids, ids, x)
            return
        if self.now != top:
            self.now, self.of_leaf = top, {}
            for q in which:
                for _, leaf in zip(range(self.within), tree.visits(self.best.queries[q])):
                    self.of_leaf.setdefault(leaf, []).append(q)
        leaf = tree.leaf_of(tree.lifted(x))
        order = np.argsort(leaf, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
            visitors = self.of_leaf.get(int(leaf[mine[0]]))
            if visitors:
                self.best.add(np.array(visitors), rids[mine], ids[mine], x[mine])

    def found(self) -> tuple[np.ndarray, ...] | None:
        made = self.best.result() if self.best else None
        return None if made is None else (self.best.rids[made[0]], self.ids[made[0]], made[2], made[1])


def _search(k: int, within: int):
    """Rows (part, kind, top, rid, id, v, tops) sorted by the first three, of kinds 0: a top leaf's tree, 1: queries, 2: vectors; to each query's k best in the part."""
    schema = pa.schema([("rid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part = None, _Part(k, within)
        held: list[tuple] = []  # vectors of one top leaf, scored together

        def score() -> None:
            if held:
                part.score(held[0][0], *(np.concatenate([h[c] for h in held]) for c in (1, 2, 3)))
                held.clear()

        def close() -> Iterator[pa.RecordBatch]:
            score()
            made = part.found()
            if made is not None:
                yield pa.record_batch([pa.array(c) for c in made], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            marks = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            rids, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                now, kind, top = marks[:, lo].tolist()
                if now != key:
                    yield from close()
                    key, part = now, _Part(k, within)
                v = b.column(5)[lo:hi].to_pylist()
                if kind == 0:
                    part.trees[top] = pickle.loads(v[0])
                elif kind == 1:
                    part.ask(rids[lo:hi], ids[lo:hi], v, b.column(6)[lo:hi].to_pylist())
                else:
                    if held and (held[0][0] != top or sum(len(h[1]) for h in held) >= _VECTORS):
                        score()
                    held.append((top, rids[lo:hi], ids[lo:hi], _matrix(v)))
        yield from close()

    return run


def brute_force(indexed: DataFrame, rids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(query, rid, top, v, score) of the k best of all indexed rows for a bounded set of queries, told by place."""
    shared = indexed.sparkSession.sparkContext.broadcast((rids, queries))
    schema = pa.schema([("query", pa.int64()), ("rid", pa.int64()), ("id", pa.int64()), ("top", pa.int32()), ("v", pa.binary()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(*shared.value, k)
        for b in batches:
            for lo in range(0, b.num_rows, _VECTORS):
                part = b.slice(lo, _VECTORS)
                mine, ids, tops = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
                v = part.column(2).to_pylist()
                best.add(np.arange(len(shared.value[0])), mine, ids, _matrix(v), mine, tops, np.array(v, dtype=object))
        made = best.result()
        if made is not None:
            q, score, ids, mine, tops, v = made
            yield pa.record_batch([pa.array(q), pa.array(mine), pa.array(ids), pa.array(tops), pa.array(list(v), type=pa.binary()), pa.array(score)], schema=schema)

    made = indexed.select("rid", "id", "v", "top").mapInArrow(run, "query long, rid long, id long, top int, v binary, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _calibrate(tree: Tree, trees: DataFrame | None, indexed: DataFrame, queries: DataFrame, k: int, recall: float, sample: int) -> tuple[int, int]:
    """The fewest top leaves, and leaves of their own trees, by which sample queries find `recall` of their true neighbours."""
    some = queries.orderBy(F.xxhash64("rid"), "rid").limit(sample).collect()  # `sample` rows
    if not some:
        return 1, 1
    x = _matrix([r["v"] for r in some])
    near = brute_force(indexed, np.array([r["rid"] for r in some], dtype=np.int64), x, k).collect()  # k rows a query
    at = [{leaf: n for n, leaf in enumerate(tree.visits(v), 1)} for v in x]
    level = recall if trees is None else math.sqrt(recall)
    visits = _least([at[r["query"]][r["top"]] for r in near], level)
    if trees is None:
        return visits, 1
    pairs = indexed.sparkSession.createDataFrame([(r["top"], x[r["query"]].tobytes(), r["v"]) for r in near], "top int, q binary, v binary")

    def places(found: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found) and len(trees):
            tree = pickle.loads(trees["tree"].iloc[0])
            leaves = tree.leaf_of(tree.lifted(_matrix(list(found["v"]))))
            for q, leaf in zip(_matrix(list(found["q"])), leaves):
                out.append(next(n for n, other in enumerate(tree.visits(q), 1) if other == leaf))
        return pd.DataFrame({"place": np.array(out, dtype=np.int64)})

    found = pairs.groupBy("top").cogroup(trees.groupBy("top")).applyInPandas(places, "place long").collect()  # k rows a query
    return visits, _least([r["place"] for r in found], level)


def _least(places: list[int], share: float) -> int:
    """The least number that `share` of the places do not pass; 1 if there are none."""
    ordered = sorted(places)
    return ordered[min(len(ordered) - 1, math.ceil(share * len(ordered)) - 1)] if ordered else 1
