import math
import re

import odd
import pytest
from pyspark.sql import functions as F

from siteframe.llm import catalog, mixture


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        left = [s for s in names if s not in full]
        level = (total - sum(cap * sizes[s] for s in full)) / sum(weight[s] for s in left) if left else 0
        over = {s for s in left if weight[s] * level > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, texts):
    sizes, targets, most = {}, {}, {}
    for source, text in texts:
        sizes[source] = sizes.get(source, 0) + words(text)
        most[source] = max(most.get(source, 0), words(text))
    targets = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], targets[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= most[s] + 1


def test_query_meets_its_targets(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    check(mixture.mix(docs).collect(), [(r["source"], r["text"]) for r in docs.collect()])
    assert odd.same_rows(catalog.op5_mix(spark, folder), catalog.op5_mix(spark, folder))


def test_odd_rows(spark):
    docs = odd.docs(spark)
    rows = mixture.mix(docs).collect()
    assert len(rows) == len(odd.DOCS)
    check(rows, [(d[3], d[1]) for d in odd.DOCS])
    assert mixture.mix(odd.empty(spark)).isEmpty() and mixture.apply_mix(odd.empty(spark)).isEmpty()
    none = docs.withColumn("text", F.lit(None).cast("string"))
    assert mixture.mix(none).filter("taken <> 0 or target <> 0").isEmpty()


def test_apply_gives_each_row_its_copies(spark):
    docs = odd.docs(spark)
    planned, applied = mixture.mix(docs), mixture.apply_mix(docs)
    assert set(applied.columns) == set(docs.columns) | {"source_size", "target"}
    assert applied.agg(F.sum("taken")).first()[0] == planned.agg(F.sum("taken")).first()[0]
    assert applied.count() == planned.filter("copies > 0").count()


def test_priors_tilt(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), "a" if i % 3 else "b", 0.5 if i % 2 else 1.0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    got = mixture.mix(docs, prior="weight").join(docs.select("doc_id", "weight"), "doc_id").collect()
    for s in "ab":
        mine = [r for r in got if r["source"] == s]
        target = mine[0]["target"]
        assert math.isclose(sum(r["rate"] * r["size"] for r in mine), target, rel_tol=1e-6)
        assert abs(sum(r["taken"] for r in mine) - target) <= 12
        low, high = ({r["rate"] for r in mine if r["weight"] == w} for w in (0.5, 1.0))
        assert math.isclose(max(high), min(2.0, 2 * max(low)), rel_tol=1e-6)


def test_hot_size_is_spread(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BUCKET", 8)
    rows = [(i, "a b c", "s") for i in range(500)] + [(i, "a b c d", "t") for i in range(500, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(mixture.mix(docs).collect(), [(r[2], r[1]) for r in rows])


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 70}, {"x": 4}, {"a": 0, "b": 0}, {"a": 1, "b": 1, "c": 1, "d": 10**9}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixture.source_targets(table).collect()}
    want = plain_targets(sizes)
    assert set(got) == set(want) and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)
