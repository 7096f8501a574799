"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, with merged results.

Different vectors are dealt to shards of bounded size. A shard is one row of a table: its vectors and one flat array of
neighbours per layer. Distinct queries go to every shard in blocks, all queries of a block walk through the graph in step,
and the best of the shards are merged. Nearness is the inner product: vectors get one more component that makes them equally long, so
that the largest inner product with a query is the smallest distance, for which such graphs are made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteframe.core import cut_lineage, discard
from siteframe.llm.common import prepare

#: Vectors of a shard, and bytes of its vectors, at most on average.
SHARD_ROWS, SHARD_BYTES = 4096, 32 << 20
#: Queries that visit a shard together.
QUERY_BLOCK = 4096
#: Neighbours of a node in upper layers; the lowest layer has twice as many.
LINKS = 16
#: Nodes that a walk keeps while the graph is built and searched.
BUILD_BEAM, SEARCH_BEAM = 64, 96
#: Nodes that are linked at once; they do not see each other.
BATCH = 256
#: Lists of shard results that are merged at once.
FAN = 64


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The `width` nodes of largest inner product that best-first walks from `entry` find, unordered; -1 where there are fewer.

    All queries take one step at a time together: each opens its best node that is not open yet.
    """
    count, n = len(q), len(x)
    ids = np.full((count, width), -1, np.int32)
    near = np.full((count, width), -np.inf, np.float32)
    shut = np.zeros((count, width), bool)
    seen = np.zeros((count, n), bool)
    rows = np.arange(count)
    ids[:, 0], near[:, 0], shut[:, 0] = entry, np.einsum("ij,ij->i", x[entry], q), True
    seen[rows, entry] = True
    while rows.size:
        best = np.where(shut[rows], near[rows], -np.inf)
        at = best.argmax(1)
        alive = best[np.arange(len(rows)), at] > -np.inf
        rows, at = rows[alive], at[alive]
        if not rows.size:
            break
        shut[rows, at] = False
        around = links[ids[rows, at]]
        new = around >= 0
        new &= ~seen[rows[:, None], around]
        r, c = np.nonzero(new)
        to, who = around[r, c], rows[r]
        seen[who, to] = True
        score = np.full(around.shape, -np.inf, np.float32)
        score[r, c] = np.einsum("ij,ij->i", x[to], q[who])
        all_near = np.concatenate([near[rows], score], 1)
        top = np.argpartition(-all_near, width - 1, 1)[:, :width]
        near[rows] = np.take_along_axis(all_near, top, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], around], 1), top, 1)
        shut[rows] = np.take_along_axis(np.concatenate([shut[rows], new], 1), top, 1)
    ids[near == -np.inf] = -1
    return ids, near


def choose(x: np.ndarray, near: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Neighbours of nodes among candidates: nearest first, those that are nearer to the node than to one chosen before; the rest fills up."""
    out = np.full((len(ids), count), -1, np.int32)
    for a in range(0, len(ids), 256):
        order = np.argsort(-near[a:a + 256], 1, kind="stable")
        part, own = np.take_along_axis(ids[a:a + 256], order, 1), np.take_along_axis(near[a:a + 256], order, 1)
        valid = part >= 0
        v = x[part]
        between = v @ v.transpose(0, 2, 1)
        kept = np.zeros(part.shape, bool)
        held = np.zeros(len(part), np.int32)
        for j in range(part.shape[1]):
            hidden = (kept & (between[:, j] > own[:, j, None])).any(1)
            kept[:, j] = valid[:, j] & ~hidden & (held < count)
            held += kept[:, j]
        first = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)), 1, kind="stable")[:, :count]
        taken = np.where(np.take_along_axis(valid, first, 1), np.take_along_axis(part, first, 1), -1)
        out[a:a + 256, :taken.shape[1]] = taken
    return out


def link_back(x: np.ndarray, links: np.ndarray, sources: np.ndarray) -> None:
    """Link the neighbours of `sources` back to them; a node with too many neighbours chooses again."""
    width = links.shape[1]
    r, c = np.nonzero(links[sources] >= 0)
    to, by = links[sources][r, c], sources[r]
    near = np.einsum("ij,ij->i", x[to], x[by])
    order = np.lexsort((-near, to))
    to, by = to[order], by[order]
    nodes, start = np.unique(to, return_index=True)
    place = np.arange(len(to)) - np.repeat(start, np.diff(np.append(start, len(to))))
    most = place < width
    coming = np.full((len(nodes), width), -1, np.int32)
    coming[np.searchsorted(nodes, to[most]), place[most]] = by[most]
    both = np.concatenate([links[nodes], coming], 1)
    valid = both >= 0
    packed = np.take_along_axis(both, np.argsort(~valid, 1, kind="stable"), 1)
    links[nodes] = packed[:, :width]
    over = np.nonzero(valid.sum(1) > width)[0]
    for a in range(0, len(over), 256):
        part = over[a:a + 256]
        near = np.einsum("ijk,ik->ij", x[packed[part]], x[nodes[part]])
        near[packed[part] < 0] = -np.inf
        links[nodes[part]] = choose(x, near, packed[part], width)


def descend(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray) -> np.ndarray:
    """The entry of each query into the layer below `layers`, which are given from the lowest to the highest."""
    entry = np.zeros(len(q), np.int64)
    for links in reversed(layers):
        entry = walk(x, links, q, entry, 1)[0][:, 0].astype(np.int64)
    return entry


def build(x: np.ndarray) -> list[np.ndarray]:
    """Flat neighbour arrays of all layers, lowest first. Layer l has the first n / LINKS**l nodes, whose order must be random.

    The upper layers stand before a lower one is built, in batches that grow with the graph.
    """
    sizes = [len(x)]
    while sizes[-1] > LINKS:
        sizes.append(-(-sizes[-1] // LINKS))
    layers: list[np.ndarray] = []
    for level in range(len(sizes) - 1, -1, -1):
        n, width, above = sizes[level], LINKS * (1 if level else 2), len(layers[0]) if layers else 0
        links = np.full((n, width), -1, np.int32)
        done = 1
        while done < n:
            upto = min(n, done + min(done, BATCH))
            if done < above < upto:
                upto = above
            batch = np.arange(done, upto)
            entry = descend(x, layers, x[batch]) if done >= above else np.zeros(len(batch), np.int64)
            found, near = walk(x, links, x[batch], entry, BUILD_BEAM)
            links[batch] = choose(x, near, found, width)
            link_back(x, links, batch)
            done = upto
        layers.insert(0, links)
    return layers


def even_length(v: np.ndarray) -> np.ndarray:
    """Vectors with a component that makes them as long as the longest one, scaled to length one."""
    v = v / max(np.abs(v).max(), 1e-300)
    squares = (v * v).sum(1)
    most = squares.max()
    return (np.concatenate([v, np.sqrt(np.maximum(most - squares, 0))[:, None]], 1) / np.sqrt(most)).astype(np.float32)


def exact(v: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up component by component, so that equal vectors give equal sums."""
    out = np.zeros(ids.shape)
    for j in range(v.shape[1]):
        out += v[ids, j] * q[:, j, None]
    return out


def search(v: np.ndarray, x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and exact inner products of what a walk finds for every query; -1 and -inf where there are fewer."""
    flat = np.concatenate([q / np.abs(q).max(1, keepdims=True), np.zeros((len(q), 1))], 1).astype(np.float32)
    ids, _ = walk(x, layers[0], flat, descend(x, layers[1:], flat), min(width, max(len(x), 1)))
    near = exact(v, q, np.maximum(ids, 0))
    near[ids < 0] = -np.inf
    return ids, near


def _members(ids: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(ids.to_numpy()).astype(np.int64), np.cumsum([0, *map(len, ids)]).astype(np.int64)


SHARD = "dim int, shard int, n int, vectors binary, ids binary, upto binary, layers array<binary>"


def _build(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["deal", "class"])
    v = np.stack(part["vector"].to_numpy()).astype(np.float64)
    ids, upto = _members(part["ids"])
    layers = build(even_length(v))
    row = (part["dim"].iloc[0], part["shard"].iloc[0], len(v), v.tobytes(), ids.tobytes(), upto.tobytes(), [a.tobytes() for a in layers])
    return pd.DataFrame([row], columns=["dim", "shard", "n", "vectors", "ids", "upto", "layers"])


def _search(top: int, width: int):
    def run(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(queries):
            return pd.DataFrame({"query": [], "shard": [], "scores": [], "ids": []})
        row = shard.iloc[0]
        n = int(row["n"])
        v = np.frombuffer(row["vectors"]).reshape(n, -1)
        ids, upto = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["upto"], np.int64)
        layers = [np.frombuffer(a, np.int32).reshape(-1, LINKS * (1 if i else 2)) for i, a in enumerate(row["layers"])]
        nodes, near = search(v, even_length(v), layers, np.stack(queries["vector"].to_numpy()).astype(np.float64), width)
        scores, names = [], []
        for found, score in zip(nodes, near):
            ok = found >= 0
            found, score = found[ok], score[ok]
            first = np.lexsort((ids[upto[found]], -score))[:top]
            found, score = found[first], score[first]
            lengths = upto[found + 1] - upto[found]
            who = np.concatenate([ids[upto[f]:upto[f + 1]] for f in found])
            score = np.repeat(score, lengths)
            first = np.lexsort((who, -score))[:top]
            scores.append(score[first])
            names.append(who[first])
        return pd.DataFrame({"query": queries["query"], "shard": row["shard"], "scores": scores, "ids": names})

    return run


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, not zero, no component null or not finite."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, odd) & F.exists(vector, lambda c: c != 0), F.lit(False))


def vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, vector, dim) of the rows that take part, once for each id."""
    v = F.col(embedding).cast("array<double>")
    rows = table.select(F.col(vec_id).cast("long").alias("id"), v.alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    # Adding zero makes a negative zero a plain one.
    one = rows.groupBy("id").agg(F.min("vector").alias("vector"))
    return one.select("id", F.transform("vector", lambda c: c + F.lit(0.0)).alias("vector"), F.size("vector").alias("dim"))


def _tasks(groups: int | None) -> int:
    """Partitions for so many groups of work: enough that few groups share one."""
    return max(1, min(4 * (groups or 0), 20_000))


def index(rows: DataFrame, top: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Graphs of all different vectors of `rows` (id, vector, dim), a shard a row.

    Equal vectors are one node. It lists the smallest `top` ids of its rows; no search for `top` rows can return more of them.
    """
    order = Window.partitionBy("dim", "vector").orderBy("id")
    few = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    classes = few.groupBy("dim", "vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("class", F.col("ids")[0])
    classes = cut_lineage(classes)
    room = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(F.lit(SHARD_BYTES) / (F.col("dim") * 8))))
    shards = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select("dim", F.ceil(F.col("n") / room).alias("shards"))
    dealt = classes.join(shards, "dim").withColumn("deal", F.xxhash64("class")).withColumn(
        "shard", F.pmod("deal", "shards").cast("int")).drop("shards")
    # A shard is little data and much work: shards are dealt out before small partitions are merged.
    tasks = _tasks(shards.agg(F.sum("shards")).first()[0])
    graphs = cut_lineage(dealt.repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInPandas(_build, SHARD))
    discard(classes)
    return graphs


def nearest(table: DataFrame, wanted: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
            shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest found for every row for which `wanted`, a condition on `id`, holds.

    Score is the inner product in double precision; equal scores go by the smaller id, a row is not its own candidate.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without id; repeated
    rows count once, and of different vectors of one id the smallest in array order counts. Vectors of different
    lengths do not meet. With fewer than `k` candidates all are found; empty tables give no rows, other columns are ignored.
    """
    prepare(table.sparkSession)
    rows = cut_lineage(vectors(table, vec_id, embedding))
    top = k + 1
    graphs = index(rows, top, shard_rows)
    asked = rows.filter(wanted).withColumn("query", F.sha2(F.array_join(F.col("vector").cast("array<string>"), ","), 256))
    asked = cut_lineage(asked)
    distinct = asked.groupBy("dim", "query").agg(F.first("vector").alias("vector"))
    sizes = graphs.groupBy("dim").agg(F.max("shard").alias("last"))
    blocks = distinct.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("blocks"))
    blocks = cut_lineage(blocks.join(sizes, "dim"))
    visits = (distinct.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("query"), "blocks").cast("int"))
              .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("last")))).select("dim", "shard", "block", "query", "vector"))
    copies = graphs.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "last")
    keys = ["dim", "shard", "block"]
    tasks = _tasks(blocks.agg(F.sum((F.col("last") + 1) * F.col("blocks"))).first()[0])
    found = copies.repartition(tasks, *keys).groupBy(*keys).cogroup(visits.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(
        _search(top, max(beam, top)), "query string, shard int, scores array<double>, ids array<long>")
    lists = cut_lineage(found.select("query", F.col("shard").alias("g"), F.zip_with(
        "scores", "ids", lambda s, i: F.struct((-s).alias("s"), i.alias("i"))).alias("found")))
    most = blocks.agg(F.coalesce(F.max("last"), F.lit(0)).alias("m")).first()["m"] + 1
    best = F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, top).alias("found")
    while most > FAN:
        groups = -(-most // FAN)
        lists = cut_lineage(lists.groupBy("query", F.pmod("g", F.lit(groups)).alias("g")).agg(best), lists)
        most = groups
    merged = lists.groupBy("query").agg(best)
    own = asked.select(F.col("id").alias("query_id"), "query").join(merged, "query")
    others = F.slice(F.filter("found", lambda f: f["i"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(others).alias("at", "f"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("f.i").alias("vec_id"), (-F.col("f.s")).alias("score"))
