"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.session import cut as cut_once
from quillgraph.functions.session import gathered
from quillgraph.operators.skew import SHARES, look_up

cut = partial(cut_once, in_loop=True)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every endpoint; the component is its smallest node.

    Every round points each node to the least of itself and its neighbours in a hashed order (so that
    a chain of rising ids shrinks by a constant factor instead of shifting; every round has the same
    plan, which is compiled once), follows the pointers a few steps, and relabels and de-duplicates the edges until none is left.
    Least neighbours are pre-aggregated before the shuffle, and the pointers of hubs (fewer than
    SHARES nodes of the highest degree) are broadcast, so a hub costs no single task. Rounds are
    checkpointed in the shared folder; links and labels stay on the executors. Null endpoints and
    self loops only make their node known.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    alone = e.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    most = e.count()
    e = cut(gathered(e.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), most))
    place = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    steps: list[DataFrame] = []
    while n := e.count():
        if len(steps) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(place("b")).alias("m"), F.count("*").alias("degree"))
        near = gathered(near.select(F.col("a").alias("node"), F.least(place("a"), F.col("m"))["id"].alias("up"), "degree"), 2 * n)
        # A node is pointed at as often as its degree says, at most.
        step = near.select(F.col("node").alias("k"), F.col("up").alias("top"), "degree")
        hubs = step.where(F.col("degree") > max(1, 2 * n // SHARES)).drop("degree")
        up = cut(gathered(look_up(near.select("node", "up"), "up", step.drop("degree"), "k", hubs).select("node", F.col("top").alias("up")), 2 * n))
        steps.append(up)
        left = up.select(F.col("node").alias("ka"), F.col("up").alias("na"))
        right = up.select(F.col("node").alias("kb"), F.col("up").alias("nb"))
        e = gathered(e.join(left, F.col("a") == F.col("ka")), n).join(right, F.col("b") == F.col("kb")).where("na <> nb")
        e = cut(gathered(gathered(e.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")), n).distinct(), n))
    if not steps:
        return alone.select("node", F.col("node").alias("component"))
    labels = steps[0].select("node", F.col("up").alias("root"))
    for up in steps[1:]:
        labels = labels.join(up.select(F.col("node").alias("k"), "up"), F.col("root") == F.col("k"), "left").select("node", F.coalesce("up", "root").alias("root"))
    labels = cut(gathered(labels, 2 * most))
    # Materialised, so that Spark can split a large component's side of the join.
    least = cut(gathered(labels.groupBy("root").agg(F.min("node").alias("component")).select(F.col("root").alias("kr"), "component"), most))
    found = labels.join(least, F.col("root") == F.col("kr")).select(F.col("node").alias("k"), "component")
    return alone.join(found, F.col("node") == F.col("k"), "left").select("node", F.coalesce("component", "node").alias("component"))
