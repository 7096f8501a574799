import math
import re
from collections import Counter

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from siteframe.llm import bitsliced, catalog


def plain_terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain_rank(docs, items, k=20):
    """Every document scored for every item."""
    held = [(d, Counter(plain_terms(t)), len(plain_terms(t))) for d, t in docs]
    held = [h for h in held if h[2]]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = {}
    for item in {i for i, _ in items}:
        wanted = Counter(t for text in {t for i, t in items if i == item} for t in plain_terms(text))
        scores = []
        for d, c, n in held:
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, r in wanted.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        if scores:
            out[item] = [(d, -s) for s, _, _, d in sorted(scores)[:k]]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    for rows in out.values():
        assert sorted(r for r, _, _ in rows) == list(range(1, len(rows) + 1))
    return {i: [(d, s) for _, d, s in sorted(rows)] for i, rows in out.items()}


def made_up(seed=1, count=900):
    """Documents of very different length with frequent and rare words, copies and a word that is in all of them."""
    rng = np.random.default_rng(seed)
    docs = []
    for i in range(count):
        n = int(rng.choice([3, 20, 200, 4000], p=[0.3, 0.5, 0.19, 0.01]))
        words = [f"w{int(x)}" for x in rng.zipf(1.4, n) % 5000]
        docs.append((i, " ".join(["Every", *words])))
    docs += [(count + i, docs[7][1]) for i in range(count // 3)]
    items = [(j, " ".join(f"W{int(x)}" for x in rng.zipf(1.3, 30) % 5000)) for j in range(25)] + [(100, "every"), (101, "every every w1"), (102, "nowhere")]
    return docs, items


@pytest.mark.parametrize("part_terms", [bitsliced.PART_TERMS, 90])
def test_against_brute_force(spark, part_terms):
    docs, items = made_up()
    got = found(bitsliced.rank(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                               spark.createDataFrame(items, "item_id long, text string"), part_terms=part_terms))
    assert got == plain_rank(docs, items)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert found(catalog.op13_lexical_search(spark, folder)) == plain_rank(docs, items)


def test_odd_rows(spark):
    items = [(1, odd.WORDS), (1, odd.WORDS), (1, "one"), (None, "GRÖSSE größe und"), (2, None), (3, ""), (4, "word3 word3 of1"), (5, "absent")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit("x")).withColumn("term", F.lit("y"))
    docs = odd.docs(spark)
    got = found(bitsliced.rank(docs.select("*", F.lit(1).alias("doc"), F.lit(2).alias("__text")), bench))
    assert got == plain_rank([(d, t) for d, t, *_ in odd.DOCS], items)
    assert bitsliced.rank(odd.empty(spark), bench).isEmpty() and bitsliced.rank(docs, bench.filter("false")).isEmpty()
    by_name = bitsliced.rank(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), bench)
    assert by_name.schema["doc_id"].dataType.simpleString() == "string" and not by_name.isEmpty()


def test_bounds_are_never_below_the_scores():
    docs, items = made_up(2, 300)
    held = [(d, Counter(plain_terms(t))) for d, t in docs]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t.encode() for _, c in held for t in c)
    rows = [(i, t.encode(), r) for i, text in items for t, r in Counter(plain_terms(text)).items()]
    group = bitsliced.Items(rows, df, n_docs, n_terms)
    lookup = group.lookup()
    block = bitsliced._Block(9)
    known = bitsliced._Hashes()
    for d, c in held:
        tf = np.array(list(c.values()))
        tiers = np.frexp(tf)[1]
        place = np.repeat(np.arange(len(tf)), tiers)
        tier = np.arange(tiers.sum()) - np.repeat(np.cumsum(tiers) - tiers, tiers)
        block.add(d, int(tf.sum()), int(tf.max()), np.array([known[t.encode()] for t in c], np.uint64)[place], tier)
    bits, _, n, most, slices, *_ = block.row()
    upper = bitsliced.bounds(group, bits, np.array(n), np.array(most), slices)
    loose = 0
    for i, name in enumerate(group.names):
        for j, (_, c) in enumerate(held):
            m = 75 + (25 * n[j] * n_docs) // n_terms
            score = sum(w * ((10 ** 9 * c[t.decode()]) // (1000 * c[t.decode()] + 12 * m)) for t, w in lookup[name].items() if t.decode() in c)
            assert upper[i, j] >= score
            loose += upper[i, j] > 2 * score + 10 ** 6
    assert loose < 0.2 * upper.size
