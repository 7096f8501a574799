import numpy as np
import odd
import pytest
import xxhash
from pyspark.sql import functions as F

from siteframe.llm import catalog, simhash


def plain_fingerprint(text, words=4):
    tokens = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not tokens:
        return 0
    k = min(words, len(tokens))
    hashes = [xxhash.xxh64_intdigest(b" ".join(tokens[i:i + k]), 42) for i in range(len(tokens) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, bits=4):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    least = {}
    for i, name in enumerate(ids):
        if name is not None:
            least[root(i)] = min(least.get(root(i), name), name)
    return [least.get(root(i)) for i in range(len(ids))]


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want_print = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    want = dict(zip(want_print, plain_components(list(want_print.values()), list(want_print)), strict=True))
    got = catalog.op6_simhash(spark, folder).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {k: f"{v:016x}" for k, v in want_print.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == want


@pytest.mark.parametrize("crowd", [64, 2])
def test_links_of_a_dense_ball(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(1)
    values = {int(rng.integers(0, 2**63)) for _ in range(40)}
    for center in list(values)[:4]:
        for _ in range(40):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            values.add(center ^ sum(1 << int(b) for b in flips))
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in sorted(values)]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    masked = {v: v & (1 << 64) - 1 for v in signed}
    assert all((masked[e["a"]] ^ masked[e["b"]]).bit_count() <= 4 for e in edges)
    parent = {v: v for v in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        parent[root(e["a"])] = root(e["b"])
    want = plain_components([masked[v] for v in signed], signed)
    got = {}
    for v in signed:
        got.setdefault(root(v), []).append(v)
    assert sorted(map(sorted, got.values())) == sorted(
        sorted(v for v, w in zip(signed, want, strict=True) if w == c) for c in set(want))


def test_odd_rows(spark):
    got = simhash.components(odd.docs(spark))
    rows = got.collect()
    prints = [plain_fingerprint(r[1]) for r in odd.DOCS]
    want = plain_components(prints, [r[0] for r in odd.DOCS])
    assert sorted((str(r["doc_id"]), r["fp"] & (1 << 64) - 1, str(r["component_id"])) for r in rows) == sorted(
        (str(d[0]), p, str(c)) for d, p, c in zip(odd.DOCS, prints, want, strict=True))
    assert simhash.components(odd.empty(spark)).isEmpty()


def test_one_of_each(spark):
    docs = odd.docs(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((str(r["doc_id"]) for r in kept.collect()))
    # 1, 1 and 2 are copies, 3 to 5 have no words, 9 and 10 are copies; the rows without id share 17 of 18 shingles with 1.
    assert ids == sorted(["1", "3", "6", "7", "8", "9"])
    assert simhash.one_of_each(odd.empty(spark)).isEmpty()
    once = simhash.one_of_each(docs.filter("doc_id > 5").withColumn("extra", F.lit(1)))
    assert sorted(r["doc_id"] for r in once.collect()) == [6, 7, 8, 9]


def shingles(text, words=5):
    tokens = text.lower().split()
    return {tuple(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))}


def edited(rng, tokens, share):
    return " ".join(t if rng.random() > share else f"new{rng.integers(10**6)}" for t in tokens)


@pytest.mark.parametrize("together", [2048, 20])
def test_similar_against_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(simhash, "TOGETHER", together)
    rng = np.random.default_rng(3)
    rows = []
    for size in (120, 300, 900):
        for group in range(6):
            tokens = [f"w{rng.integers(5000)}" for _ in range(size)]
            rows += [" ".join(tokens)] + [edited(rng, tokens, (0.005, 0.01, 0.03, 0.08)[i % 4]) for i in range(12 if group else 60)]
    sets = [shingles(t) for t in rows]
    alike = [(i, j) for i in range(len(rows)) for j in range(i)
             if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(alike) > 300
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    of = {r["doc_id"]: r["component_id"] for r in simhash.similar(table).collect()}
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in alike:
        parent[root(i)] = root(j)
    assert len(of) == len(rows)
    assert sum(of[i] == of[j] for i, j in alike) >= 0.97 * len(alike)
    assert all(root(i) == root(c) for i, c in of.items())  # nothing is tied that is not similar


def test_rows_are_tied_once():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 8).astype(np.uint64)
    prints = np.array([base ^ (np.uint64(1) << rng.integers(0, 60, 8).astype(np.uint64)) for _ in range(50)])
    tied, apart = simhash.tie(prints, 57, 98)
    assert len(tied) == 49 and apart == []


def wide_nodes(spark, prints):
    rows = [(i, p.view(np.int32).tolist()) for i, p in enumerate(prints)]
    return spark.createDataFrame(rows, "node long, blocks array<int>")


def flipped(rng, base, n):
    bits = np.unpackbits(base.view(np.uint8))
    bits[32 + rng.choice(480, n, replace=False)] ^= 1  # the first block stays: all meet at its anchors
    return np.packbits(bits).view(np.uint64)


def test_no_link_of_a_crowd_is_lost(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TOGETHER", 8)
    monkeypatch.setattr(simhash, "PIVOTS", 0)
    rng = np.random.default_rng(5)
    first = rng.integers(0, 2**63, 8).astype(np.uint64)
    prints = []
    for _ in range(40):  # forty pairs, unlike each other, that meet by one block only: five bits differ in all others
        base = flipped(rng, first, 240)
        bits = np.unpackbits(base.view(np.uint8))
        for block in range(32, 512, 32):
            bits[block + rng.choice(32, 5, replace=False)] ^= 1
        prints += [base, np.packbits(bits).view(np.uint64)]
    prints += [flipped(rng, first, 15) for _ in range(30)]
    found = {(r["a"], r["b"]) for r in simhash.similar_links(wide_nodes(spark, prints), 0.8).collect()}
    assert {(2 * i, 2 * i + 1) for i in range(40)} <= found


def test_texts_that_meet_by_chance_go_no_further(spark, monkeypatch):
    written = []
    cut = simhash.cut_lineage
    monkeypatch.setattr(simhash, "cut_lineage", lambda df, *a: written.append(cut(df, *a)) or written[-1])
    monkeypatch.setattr(simhash, "discard", lambda df: None)
    rng = np.random.default_rng(6)
    prints = []
    for _ in range(20):
        base = rng.integers(0, 2**63, 8).astype(np.uint64)
        prints += [base, flipped(rng, base, 240)]
    base = rng.integers(0, 2**63, 8).astype(np.uint64)
    prints += [base, flipped(rng, base, 40)]
    found = {(r["a"], r["b"]) for r in simhash.similar_links(wide_nodes(spark, prints), 0.8).collect()}
    assert found == {(40, 41)}
    members = next(t for t in written if "parts" in t.columns)
    assert members.select("node").distinct().count() <= 6
