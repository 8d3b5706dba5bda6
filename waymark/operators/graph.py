"""Graph operators over directed edge tables (edge_id, src, dst, ...).

Components, reachability and shortest costs are rounds of joins with pre-aggregated minima; each round is written to
the checkpoint folder, so lineage stays short and lost executors cost one round. Routes of single requests are in
search.py.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; the folder is the session's, or a temporary one where a local session sets none.

    Spark keeps the estimated size of what was written, which joins multiply: where each round joins the one before,
    its digits double, and the driver's memory with them. An estimate beyond what can be told is dropped here.
    """
    spark = df.sparkSession
    _shared(spark)
    out = df.checkpoint()
    plan = out._jdf.queryExecution().logical()
    if plan.stats().sizeInBytes().bit_length() < 63:
        return out
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.rdd(), out._jdf.schema(), False), spark)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, beside the checkpoints."""
    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _shared(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = context.getConf().get("spark.checkpoint.dir")
        if not base and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="waymark-checkpoint-"))
    return context.getCheckpointDir()


def active_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("uid")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("uid"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("uid").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def _stars(links: DataFrame) -> DataFrame:
    """One round: nodes above a node move to its least neighbour, then each node's lower neighbours to the least of them."""
    both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    least = both.groupBy("high").agg(F.min("low").alias("m")).select("high", F.least("high", "m").alias("m"))
    up = both.join(least, "high").where("low > high").select(F.col("low").alias("high"), F.col("m").alias("low")).distinct()
    least = up.groupBy("high").agg(F.min("low").alias("m"))
    down = up.join(least, "high").where("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
    return down.unionByName(least.select("high", F.col("m").alias("low"))).distinct()


def _print(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(uid, component): weakly connected components, named by their smallest node.

    Rounds of star operations, about as many as the logarithm of the graph's size, however long its paths are.
    """
    links = checkpoint(edges.where("src <> dst").select(F.greatest("src", "dst").alias("high"), F.least("src", "dst").alias("low")).distinct())
    before, after = None, _print(links)
    while after != before:
        links = checkpoint(_stars(links))
        before, after = after, _print(links)
    stars = links.select(F.col("high").alias("uid"), F.col("low").alias("component"))
    return active_nodes(edges).join(stars, "uid", "left").select("uid", F.coalesce("component", "uid").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("nodes"))


#: Upper ends of the size buckets; the last has none.
SIZE_BUCKETS = (1, 2, 5, 10, 50, 100, 1000)


def size_bucket(size: Column, ends: tuple = SIZE_BUCKETS) -> Column:
    out = F.lit(len(ends))
    for k, end in reversed(list(enumerate(ends))):
        out = F.when(size <= end, k).otherwise(out)
    return out


def reachable(edges: DataFrame, sources: DataFrame, hops: int | None = None) -> DataFrame:
    """(source, uid, hops): nodes reached along edges, with the fewest hops; by frontiers."""
    seen = sources.select(F.col("uid").alias("source"), "uid", F.lit(0).alias("hops"))
    frontier, n = seen, 0
    steps = edges.select("src", "dst").distinct()
    while hops is None or n < hops:
        n += 1
        made = frontier.join(steps, frontier.uid == steps.src).select("source", F.col("dst").alias("uid")).distinct()
        frontier = checkpoint(made.join(seen, ["source", "uid"], "left_anti").withColumn("hops", F.lit(n)))
        if frontier.isEmpty():
            break
        seen = checkpoint(seen.unionByName(frontier))
    return seen


def shortest_costs(edges: DataFrame, sources: DataFrame, weight: str, most: float | None = None) -> DataFrame:
    """(source, uid, cost): least costs along edges, by rounds of relaxation; `most` bounds the search."""
    cost = sources.select(F.col("uid").alias("source"), "uid", F.lit(0.0).alias("cost"))
    steps = checkpoint(edges.groupBy("src", "dst").agg(F.min(weight).alias("w")))
    frontier = cost
    while True:
        made = frontier.join(steps, frontier.uid == steps.src).select("source", F.col("dst").alias("uid"), (F.col("cost") + F.col("w")).alias("new"))
        made = made if most is None else made.where(F.col("new") <= most)
        made = made.groupBy("source", "uid").agg(F.min("new").alias("new"))
        both = cost.join(made, ["source", "uid"], "full")
        both = checkpoint(both.select("source", "uid", F.least("cost", "new").alias("best"), (F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new") < F.col("cost")))).alias("better")))
        cost = both.select("source", "uid", F.col("best").alias("cost"))
        frontier = both.where("better").select("source", "uid", F.col("best").alias("cost"))
        if frontier.isEmpty():
            return cost


#: Links of a component whose bridges one task finds.
TASK_LINKS = 100_000


def bridges(links: DataFrame, most: int = TASK_LINKS) -> DataFrame:
    """(a, b) of undirected links whose loss parts what they join; links (a, b) that stand twice are none.

    Components of at most `most` links are dealt to tasks, about as many links to each, and walked there; larger ones
    go through rounds.
    """
    pairs = links.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))
    pairs = checkpoint(pairs)
    labels = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("uid").alias("a"), "component")
    placed = checkpoint(pairs.join(labels, "a"))
    large = checkpoint(placed.groupBy("component").agg(F.count("*").alias("links")).where(F.col("links") > most).select("component"))
    groups = placed.count() // TASK_LINKS + 4 * links.sparkSession.sparkContext.defaultParallelism
    small = placed.join(large, "component", "left_anti").withColumn("group", F.pmod(F.xxhash64("component"), F.lit(groups)))
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    found = small.repartition(groups, "group").groupBy("group").applyInPandas(_bridges_in, f"a {kinds['a']}, b {kinds['b']}")
    if large.isEmpty():
        return found
    return found.unionByName(_bridges_by_rounds(checkpoint(placed.join(large, "component", "left_semi").select("a", "b", "n")), large))


def _bridges_in(links: pd.DataFrame) -> pd.DataFrame:
    """Bridges of some whole components: links below which no other link leads up, told by one walk in depth."""
    ends = links[["a", "b"]].to_numpy()
    nodes, at = np.unique(ends, return_inverse=True)
    near: list[list[tuple[int, int]]] = [[] for _ in nodes]
    for k, (u, v) in enumerate(at.reshape(ends.shape).tolist()):
        near[u].append((v, k))
        near[v].append((u, k))
    seen, low, count = [0] * len(nodes), [0] * len(nodes), 0
    found = []
    for root in range(len(nodes)):
        if seen[root]:
            continue
        count += 1
        seen[root] = low[root] = count
        stack = [(root, -1, iter(near[root]))]
        while stack:
            u, came, rest = stack[-1]
            for v, k in rest:
                if not seen[v]:
                    count += 1
                    seen[v] = low[v] = count
                    stack.append((v, k, iter(near[v])))
                    break
                if k != came:
                    low[u] = min(low[u], seen[v])
            else:
                stack.pop()
                if stack:
                    above = stack[-1][0]
                    low[above] = min(low[above], low[u])
                    if low[u] > seen[above]:
                        found.append(came)
    kept = links.iloc[found]
    return kept.loc[kept["n"] == 1, ["a", "b"]]


def _bridges_by_rounds(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Bridges of pairs (a, b, n) in components named by `roots`.

    A forest is grown from each component's smallest node, round by round. Every link outside it marks its two ends
    with its own random number; combined by exclusive or from the leaves up, the marks below a link of the forest are
    zero just if no other link passes it by, but for a chance of 2**-64.
    """
    both = checkpoint(pairs.select("a", "b").union(pairs.select("b", "a")))
    grown, depth = checkpoint(roots.select(F.col("component").alias("uid"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth"))), 0
    rounds = [grown]
    while True:
        depth += 1
        near = rounds[-1].join(both, F.col("uid") == F.col("a")).groupBy(F.col("b").alias("uid")).agg(F.min("a").alias("parent"))
        near = checkpoint(near.join(grown, "uid", "left_anti").withColumn("depth", F.lit(depth)))
        if near.isEmpty():
            break
        rounds.append(near)
        grown = checkpoint(grown.unionByName(near))
    tree = grown.where("parent is not null").select(F.least("uid", "parent").alias("a"), F.greatest("uid", "parent").alias("b"), F.col("uid").alias("below"))
    outside = pairs.join(tree, ["a", "b"], "left").withColumn("more", F.col("n") - F.when(F.col("below").isNotNull(), 1).otherwise(0)).where("more > 0")
    number = F.xxhash64("a", "b")
    ends = outside.select(F.explode(F.array("a", "b")).alias("uid"), number.alias("mark"))
    marks = ends.groupBy("uid").agg(F.bit_xor("mark").alias("mark"))
    held = None  # marks of the round below, by the parent that gathers them
    sums = []
    # a link that stands twice is passed by its own double
    doubled = pairs.where("n > 1").select("a", "b")
    for k in range(len(rounds) - 1, 0, -1):
        rows = rounds[k].join(marks, "uid", "left").select("uid", "parent", F.coalesce("mark", F.lit(0).cast("long")).alias("mark"))
        if held is not None:
            rows = rows.join(held, "uid", "left").select("uid", "parent", F.col("mark").bitwiseXOR(F.coalesce("below", F.lit(0).cast("long"))).alias("mark"))
        rows = checkpoint(rows)
        sums.append(rows)
        held = rows.groupBy(F.col("parent").alias("uid")).agg(F.bit_xor("mark").alias("below"))
    if not sums:
        return pairs.select("a", "b").limit(0)
    found = sums[0]
    for more in sums[1:]:
        found = found.unionByName(more)
    return found.where("mark = 0").select(F.least("uid", "parent").alias("a"), F.greatest("uid", "parent").alias("b")).join(doubled, ["a", "b"], "left_anti")
