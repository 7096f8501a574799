import hashlib
import zlib
from collections import defaultdict

import odd
import pytest
from pyspark.sql import functions as F

from siteframe.llm import bursttrie, catalog

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    """The nodes as the contract words them, from all prefixes of all rebuilt conversations."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[conv].append((turn is not None, turn or 0, key, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, below = set(), {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(below[c][0] for c in children[p]) or 1
        saved = sum(below[c][1] for c in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        below[p] = leaves, saved
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves, saved, digest))
    return out


def found(table, **limits):
    nodes = bursttrie.trie(bursttrie.rebuilt(bursttrie.sequences(table)), **limits).collect()
    rows = [(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in nodes]
    assert len(rows) == len(set(rows))
    return set(rows)


def branching():
    rows = []
    for c in range(0, 700):
        for turn in range(c % 9):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", f"t{turn} {(c >> turn) % 2}" if turn > 2 else "shared text"))
    return rows


def hot():
    """A third of all conversations are copies, over several digest pieces; ids far apart, negative and beyond 2 ** 53."""
    rows = [(3000 + 7 * i, t, "user", f"copy {t}") for i in range(400) for t in range(7)]
    rows += [(2 ** 60 + 100 * i, t, "user", f"{i} {t}") for i in range(5) for t in range(3)] + [(-150, 0, "user", "minus"), (-100, 0, "user", "base")]
    return rows


ODD = [(1, 0, None, "x"), (1, 1, "user", None), (1, None, "", ""), (1, None, "b", "ü€😀"), (1, 1, "user", None), (2, 0, "user", "a"), (2, 0, "user", "a"),
       (200, 3, "a:b", "c"), (200, 2, "a", "b:c"), (203, 1, "user", "long " * 5000), (None, 0, "user", "nobody"), (4, 0, "user", "")]


@pytest.mark.parametrize("rows", [branching(), hot(), ODD], ids=["branching", "hot", "odd"])
def test_against_brute_force(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    assert found(table) == plain_trie(rows)
    # Every container bursts, and some of them.
    assert found(table, container_turns=0, container_suffixes=1) == plain_trie(rows)
    assert found(table, container_turns=200, container_suffixes=8) == plain_trie(rows)


def test_empty_and_other_columns(spark):
    table = spark.createDataFrame(ODD, SCHEMA)
    extra = table.select("*", *[F.lit(f"x {c}").alias(c) for c in ("conv", "head", "ids", "key", "depth", "path", "n", "at", "id", *odd.CLASHING)])
    assert found(extra) == plain_trie(ODD)
    assert found(table.filter("false")) == set()
    assert found(table.filter("conv_id is null")) == set()


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
           for r in catalog.op11_prefix_trie(spark, folder).collect()}
    assert got == plain_trie(rows)


def test_sweep_streams_containers():
    """Containers come one after another; the stack is empty between them."""
    a, b, c = b"a" * 16, b"b" * 16, b"c" * 16
    rows = [(b"1", 1, 7, [b""], [a], [3], 2, 7, "e1"), (b"1", 1, 7, [b""], [a, b], [3, 5], 1, 8, "e2"), (b"1", 1, 7, [b""], [a, c], [3, 4], 3, 9, "e3"),
            (b"2", 0, None, [], [], [], 1, 1, "e4")]
    nodes = [n for out in bursttrie.sweep(rows) for n in out]
    assert sorted(nodes, key=str) == sorted([
        (8, 2, 7, 1, 0, 1, 0, "e2", None), (9, 2, 7, 3, 0, 1, 8, "e3", None), (7, 1, 7, 6, 2, 2, 5 * 3 + 8, "e1", [b""]), (1, 0, None, 1, 0, 1, 0, "e4", [])], key=str)
