"""Graphs: what paths lead to, in rounds that double, and orders of graphs with shared children."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.trees import cut


def _squared(step: DataFrame) -> DataFrame:
    """Pairs at the ends of two steps."""
    return cut(step.select("src", F.col("dst").alias("_mid")).join(step.select(F.col("src").alias("_mid"), "dst"), "_mid").select("src", "dst").distinct())


def closure(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """All (src, dst) that a path leads to; cycles are fine, nulls lead nowhere.

    After a round all paths of twice the length are known: those known before
    go on by a step that stands for the paths of exactly the longest length.
    Paths of any length end in as many rounds as the length has binary digits,
    and two more.
    """
    step = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    found = [step]
    while True:
        known = reduce(DataFrame.union, found)
        longer = step.select("src", F.col("dst").alias("_mid")).join(known.select(F.col("src").alias("_mid"), "dst"), "_mid").select("src", "dst").distinct()
        new = cut(longer.join(known, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return known
        found.append(new)
        step = _squared(step)


def _meetings(step: DataFrame) -> int:
    """How many pairs of steps meet: what squaring joins, before equal pairs count once."""
    outs = step.groupBy(F.col("src").alias("_mid")).agg(F.count("*").alias("_out"))
    ins = step.groupBy(F.col("dst").alias("_mid")).agg(F.count("*").alias("_in"))
    return outs.join(ins, "_mid").agg(F.sum(F.col("_out") * F.col("_in"))).first()[0] or 0


def reached(start: DataFrame, edges: DataFrame, by: list[str], node: str, src: str, dst: str, growth: int = 4) -> DataFrame:
    """(by, node): what paths of any length lead to from each of ``start`` (by, node), itself included; cycles are fine.

    Rounds double as in ``closure``: what is known goes on by a step that
    stands for all paths of the next power of two.  In a graph that branches
    such steps become many more than its edges; so the step is squared only
    while that joins at most ``growth`` times as many rows as there are edges.
    From then on what is new of a round goes on by the step at hand, until
    nothing is new: paths that are no multiple of the step begin with a
    shorter one, which is known.  No result depends on ``growth``.
    """
    step = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    most, doubling = growth * step.count(), True
    new = cut(start.select(*by, node).distinct())
    seen = [new]
    pair = F.struct(*by, node)  # within a struct nulls are equal
    while True:
        known = reduce(DataFrame.union, seen)
        onward = known if doubling else new
        further = onward.join(step, F.col(node) == F.col("src")).select(*by, F.col("dst").alias(node)).distinct()
        new = cut(further.withColumn("_pair", pair).join(known.select(pair.alias("_pair")), "_pair", "left_anti").drop("_pair"))
        if new.isEmpty():
            return known
        seen.append(new)
        doubling = doubling and _meetings(step) <= most
        if doubling:
            step = _squared(step)


def layers(nodes: DataFrame, edges: DataFrame, node: str, parent: str, child: str) -> DataFrame:
    """(node, layer, error): children before parents, by the longest way down: 0 without children, else one more than the highest child.

    A round hands the last layer to the parents of its nodes, and those whose
    children are all done are the next; parents with some children left wait
    with their count.  So a round shuffles what it changes, and reads the
    edges, each with how many children its parent has.  Nodes on a cycle, or
    above one, are never done: they have no layer, and an error.  Edges to or
    from other nodes than ``nodes`` count for nothing; a node may have many
    parents.
    """
    every = cut(nodes.select(F.col(node).alias("node")).distinct())
    ends = edges.select(F.col(parent).alias("parent"), F.col(child).alias("child")).distinct()
    ends = cut(ends.join(every.select(F.col("node").alias("parent")), "parent", "left_semi").join(every.select(F.col("node").alias("child")), "child", "left_semi"))
    below = ends.groupBy("parent").agg(F.count("*").alias("_all"))
    open_ = cut(ends.join(below, "parent"))
    ready = cut(every.join(below.select(F.col("parent").alias("node")), "node", "left_anti"))
    done, waiting = [], open_.limit(0).select("parent", "_all", F.lit(1).cast("bigint").alias("_done"))
    while not ready.isEmpty():
        done.append(ready.select("node", F.lit(len(done)).cast("bigint").alias("layer"), F.lit(None).cast("string").alias("error")))
        given = open_.join(ready.select(F.col("node").alias("child")), "child").select("parent", "_all", F.lit(1).cast("bigint").alias("_done"))
        held = cut(given.union(waiting).groupBy("parent", "_all").agg(F.sum("_done").alias("_done")))
        ready = held.where("_done = _all").select(F.col("parent").alias("node"))
        waiting = held.where("_done < _all")
    out = reduce(DataFrame.union, done) if done else every.limit(0).select("node", F.lit(None).cast("bigint").alias("layer"), F.lit(None).cast("string").alias("error"))
    rest = every.join(out.select(F.col("node").alias("_node")), F.col("node").eqNullSafe(F.col("_node")), "left_anti")
    return out.union(rest.select("node", F.lit(None).cast("bigint").alias("layer"), F.lit("on or above a cycle").alias("error"))).withColumnRenamed("node", node)


def closed_post_order(paths: DataFrame, chosen: DataFrame, by: list[str]) -> DataFrame:
    """The chosen nodes of a forest and all above them, children before parents: (by, node, path, place).

    paths: what ``trees.paths`` gives, with the columns ``by``; chosen: (node).
    """
    from quern.operators.trees import post_order

    wanted = paths.join(chosen.select(F.col("node").alias("_chosen")).distinct(), F.col("node") == F.col("_chosen")).select(F.explode("path").alias("_wanted")).distinct()
    return post_order(paths.join(wanted, F.col("node") == F.col("_wanted")).select(*by, "node", "path"), by)
