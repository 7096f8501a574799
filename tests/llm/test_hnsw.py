import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from siteframe.llm import catalog, hnsw


def product(a, b):
    """Added up one by one: sum() of floats keeps what single additions lose."""
    s = 0.0
    for x, y in zip(a, b):
        s += x * y
    return s


def plain_nearest(rows, wanted, k):
    """Exact search with sums component by component."""
    out = {}
    kept = {i: np.array(v, float) for i, v in rows if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for q in filter(wanted, kept):
        scores = []
        for i, v in kept.items():
            if i != q and len(v) == len(kept[q]):
                scores.append((-product(v.tolist(), kept[q].tolist()), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    assert got.keys() == {q for q, rows in want.items() if rows}
    hits = [len({i for i, _ in got[q]} & {i for i, _ in rows}) / len(rows) for q, rows in want.items() if rows]
    return float(np.mean(hits))


def test_query_recall_and_scores(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = plain_nearest(rows, lambda i: i % 20 == 0, 20)
    got = found(catalog.op12_neighbours(spark, folder))
    assert recall(got, want) >= 0.98
    vectors = dict(rows)
    for q, hits in got.items():
        assert len(hits) == 20 and q not in {i for i, _ in hits}
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0]))
        for i, s in hits[:3]:
            assert s == product(vectors[i], vectors[q])


@pytest.mark.parametrize("shard_rows, block", [(300, 7), (10_000, 4096)])
def test_shards_blocks_and_lengths(spark, shard_rows, block):
    """Vectors of different length and norm: the largest inner product, not the smallest angle."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 24)) * rng.uniform(0.2, 3, (1500, 1))
    rows = [(int(i), [float(x) for x in r]) for i, r in enumerate(v)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(hnsw.nearest(table, F.col("id") % 20 == 0, 20, shard_rows=shard_rows, query_block=block))
    assert recall(got, plain_nearest(rows, lambda i: i % 20 == 0, 20)) >= 0.95


def test_many_shards_merge_in_steps(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "FAN", 2)
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in r]) for i, r in enumerate(rng.normal(size=(400, 8)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(hnsw.nearest(table, F.col("id") % 50 == 0, 10, shard_rows=20))
    assert recall(got, plain_nearest(rows, lambda i: i % 50 == 0, 10)) >= 0.98


def test_copies_and_odd_rows(spark):
    """A third of the rows hold one vector; ties go by id; rows that take no part; vectors of another length."""
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 0.5, 0.0]) for i in range(0, 150)] + [(1000 + i, [float(x) for x in r]) for i, r in enumerate(rng.normal(size=(200, 3)))]
    rows += [(2000, None), (2020, []), (2040, [0.0, -0.0, 0.0]), (2060, [1.0, None, 2.0]), (2080, [nan, 1.0, 1.0]), (2100, [inf, 1.0, 1.0]),
             (2120, [1.0, 2.0]), (2121, [2.0, 1.0]), (2140, [5.0]), (None, [1.0, 0.5, 0.0]), (3000, [-1.0, -0.5, -0.0])]
    want = plain_nearest(rows, lambda i: i % 20 == 0, 20)
    table = spark.createDataFrame(rows + [(0, [1.0, 0.5, 0.0])], "vec_id long, embedding array<double>")
    table = table.select("*", *[F.lit(f"x {c}").alias(c) for c in ("id", "vector", "dim", "class", "shard", "deal", *odd.CLASHING)])
    got = found(hnsw.nearest(table, F.col("id") % 20 == 0, 20))
    assert got == {q: rows for q, rows in want.items() if rows}
    assert got[2120] == [(2121, 4.0)] and 2140 not in got
    assert hnsw.nearest(table.filter("false"), F.col("id") % 20 == 0).isEmpty()


def test_graph_layers_are_flat_and_within_bounds():
    v = hnsw.even_length(np.random.default_rng(6).normal(size=(700, 10)))
    layers = hnsw.build(v)
    assert [len(a) for a in layers] == [700, 44, 3]
    for level, links in enumerate(layers):
        assert links.shape[1] == hnsw.LINKS * (1 if level else 2) and links.max() < len(links)
        for node, row in enumerate(links):
            row = row[row >= 0]
            assert node not in row and len(set(row)) == len(row)
