"""Parts of objects at all heights.

The parts of an object above a height are its pixels above it that hang together. Lowering the height, parts grow
and meet at saddles. Every pixel follows its highest neighbour to a peak; neighbouring pixels of different peaks give the
saddles; a part that counts too little above its highest saddle joins the part beyond it. What is left are the parts that count,
the cores, and the saddles between them: enough to read off the parts of every height without looking at pixels again.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteframe.core import cut_lineage, discard

STRIDE = 1 << 20  # larger than any image side
#: Half of the places around a pixel; every pair of neighbours is met once.
AHEAD = {4: ((0, 1), (1, 0)), 8: ((0, 1), (1, -1), (1, 0), (1, 1))}


def pixel_id() -> Column:
    return F.col("y").cast("long") * STRIDE + F.col("x")


def neighbouring(px: DataFrame, keys: Sequence[str], neighbours: int = 8) -> DataFrame:
    """Pairs (a, b) of neighbouring pixels of one object with their heights; `px` has the keys, y, x and height."""
    offers = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in AHEAD[neighbours]])
    nodes = px.select(*keys, "y", "x", pixel_id().alias("b"), F.col("height").alias("hb"))
    offered = px.select(*keys, "y", "x", pixel_id().alias("a"), F.col("height").alias("ha"), F.explode(offers).alias("_o")).select(
        *keys, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"), "a", "ha")
    return offered.join(nodes, [*keys, "y", "x"]).select(*keys, "a", "ha", "b", "hb")


def follow(hooks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(node, root): the end of the chain of pointers (node, to) from every node; ends point at themselves.

    A round looks up four steps at once.
    """
    def twice(t: DataFrame) -> DataFrame:
        return t.join(t.select(*keys, F.col("node").alias("to"), F.col("to").alias("_n")), [*keys, "to"]).select(*keys, "node", F.col("_n").alias("to"))

    while True:
        two = twice(hooks)
        four = two.join(two.select(*keys, F.col("node").alias("to"), F.col("to").alias("_n")), [*keys, "to"]).select(
            *keys, "node", F.col("to").alias("_old"), F.col("_n").alias("to"))
        done = cut_lineage(four, hooks)
        if done.filter("_old <> to").isEmpty():
            return done.select(*keys, "node", F.col("to").alias("root"))
        path = done._siteframe_path
        hooks = done.drop("_old")
        hooks._siteframe_path = path


def cores(px: DataFrame, keys: Sequence[str], pairs: DataFrame, least_area: int = 1) -> tuple[DataFrame, DataFrame]:
    """Cores of objects and the saddles between them.

    `px` has the keys of an object, y, x, height, weight and `least`. A part counts if its pixels above its highest
    saddle are `least_area` at least and weigh `least` at least. Returns (keys, y, x, core) of every pixel and (keys, a, b, saddle).
    """
    keys = list(keys)
    offers = pairs.select(*keys, F.col("a").alias("node"), F.struct(F.col("hb").alias("h"), (-F.col("b")).alias("i")).alias("e")).unionByName(
        pairs.select(*keys, F.col("b").alias("node"), F.struct(F.col("ha").alias("h"), (-F.col("a")).alias("i")).alias("e")))
    own = px.select(*keys, pixel_id().alias("node"), F.struct(F.col("height").alias("h"), (-pixel_id()).alias("i")).alias("e"))
    up = offers.unionByName(own).groupBy(*keys, "node").agg((-F.max("e")["i"]).alias("to"))
    peaks = follow(cut_lineage(up), keys)
    at = lambda t, name: t.select(*keys, F.col("node").alias(name), F.col("root").alias(f"r{name}"))

    def between(edges: DataFrame, roots: DataFrame) -> DataFrame:
        moved = edges.join(at(roots, "a"), [*keys, "a"]).join(at(roots, "b"), [*keys, "b"]).filter("ra <> rb")
        return moved.groupBy(*keys, F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.max("saddle").alias("saddle"))

    edges = cut_lineage(between(pairs.select(*keys, "a", "b", F.least("ha", "hb").alias("saddle")), peaks))
    nodes = px.select(*keys, "y", "x", pixel_id().alias("node"), "height", "weight", "least").join(peaks, [*keys, "node"])
    steps = cut_lineage(nodes.groupBy(*keys, F.col("root").alias("node"), "height").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.max("least").alias("least")))
    moves = []
    while True:
        ends = edges.select(*keys, F.col("a").alias("node"), F.struct("saddle", (-F.col("a")).alias("i"), (-F.col("b")).alias("j"), F.col("b").alias("to")).alias("e"))
        ends = ends.unionByName(edges.select(*keys, F.col("b").alias("node"), F.struct("saddle", (-F.col("a")).alias("i"), (-F.col("b")).alias("j"), F.col("a").alias("to")).alias("e")))
        best = ends.groupBy(*keys, "node").agg(F.max("e").alias("e"))
        higher = F.col("height") > F.col("e.saddle")
        judged = steps.join(best, [*keys, "node"], "left").groupBy(*keys, "node").agg(
            F.max("e.to").alias("to"), F.sum(F.when(higher, F.col("n"))).alias("area"), F.sum(F.when(higher, F.col("w"))).alias("w"), F.max("least").alias("least"))
        weak = F.col("to").isNotNull() & ((F.coalesce("area", F.lit(0)) < least_area) | (F.coalesce("w", F.lit(0)) < F.col("least")))
        hooks = cut_lineage(judged.select(*keys, "node", F.when(weak, F.col("to")).otherwise(F.col("node")).alias("to")))
        if hooks.filter("node <> to").isEmpty():
            discard(hooks)
            break
        back = hooks.select(*keys, F.col("node").alias("to"), F.col("to").alias("_b"))
        single = hooks.join(back, [*keys, "to"]).select(*keys, "node", F.when(
            (F.col("_b") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to")).alias("to"))
        roots = follow(cut_lineage(single, hooks), keys)
        moves.append(roots)
        edges = cut_lineage(between(edges, roots), edges)
        steps = cut_lineage(steps.join(roots, [*keys, "node"]).groupBy(*keys, F.col("root").alias("node"), "height").agg(
            F.sum("n").alias("n"), F.sum("w").alias("w"), F.max("least").alias("least")), steps)
    whole = nodes.select(*keys, "y", "x", F.col("root").alias("core"))
    for roots in moves:
        whole = whole.join(roots.select(*keys, F.col("node").alias("core"), "root"), [*keys, "core"]).select(*keys, "y", "x", F.col("root").alias("core"))
    return whole, edges


def split_order(saddles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For every core the splits that lie above it, from the whole object on: (keys, core, nodes, sides).

    An object splits first at its lowest saddle that no higher one goes around, then each side by itself. Both
    sides of the same split have the same node and side 0 or 1. Objects with one core have no rows. A row holds the saddles of one
    object, about three for each core.
    """
    listed = saddles.groupBy(*keys).agg(F.collect_list(F.struct("a", "b", "saddle")).alias("_s"))

    @F.pandas_udf("array<struct<core: long, nodes: array<int>, sides: array<int>>>")
    def orders(a: pd.Series, b: pd.Series, saddle: pd.Series) -> pd.Series:
        return pd.Series([split_tree(list(zip(x.tolist(), y.tolist(), z.tolist()))) for x, y, z in zip(a, b, saddle)])

    found = listed.select(*keys, F.explode(orders("_s.a", "_s.b", "_s.saddle")).alias("_o"))
    return found.select(*keys, "_o.core", "_o.nodes", "_o.sides")


def split_tree(saddles: list[tuple]) -> list[dict]:
    """Cores with the splits above them, from saddles (a, b, height) of one object: highest saddles join first."""
    parts = {c: (c, [c]) for a, b, _ in saddles for c in (a, b)}  # core -> tree, members
    for a, b, _ in sorted(saddles, key=lambda e: (-e[2], e[0], e[1])):
        one, two = parts[a], parts[b]
        if one is not two:
            if min(two[1]) < min(one[1]):
                one, two = two, one
            joined = ((one[0], two[0]), one[1] + two[1])
            for c in joined[1]:
                parts[c] = joined
    rows, count = [], 0
    stack = [(tree, [], []) for tree, _ in {id(p): p for p in parts.values()}.values()]
    while stack:
        tree, nodes, sides = stack.pop()
        if isinstance(tree, tuple):
            count += 1
            stack += [(t, [*nodes, count], [*sides, s]) for s, t in enumerate(tree)]
        else:
            rows.append({"core": tree, "nodes": nodes, "sides": sides})
    return rows
