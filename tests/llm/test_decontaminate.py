import hashlib
import re

import odd
import pytest

from siteframe.llm import catalog, decontaminate


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_hits(text, items, size=13):
    words, hit, found = plain_words(text), set(), set()
    for name, item in items:
        ws = plain_words(item)
        n = min(size, len(ws))
        wanted = {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i:i + n]) in wanted:
                hit |= set(range(i, i + n))
                found.add(name)
    return len(words), len(hit), sorted(map(str, found))


ITEMS = [(1, " ".join(f"q{i}" for i in range(20))), (2, "Short ITEM"), (3, None), (4, "..."), (10, "ünï, café!"), (2, "Short ITEM"), (None, "nameless thing"),
         (11, " ".join(f"q{i}" for i in range(7, 22)))]
TEXTS = ["", None, "a short item here", "SHORT-item! short item", "x " + " ".join(f"q{i}" for i in range(3, 17)) + " y", "ÜNÏ café ünï café",
         " ".join(f"q{i}" for i in range(12)), " ".join(f"q{i}" for i in range(22)) * 2, "nameless thing", " ".join(f"q{i}" for i in range(20)) + " z" * 900]


@pytest.mark.parametrize("part_words", [decontaminate.PART_WORDS, 8])
def test_against_brute_force(spark, part_words):
    docs = spark.createDataFrame(list(enumerate(TEXTS + TEXTS[:3])), "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.report(docs, bench, part_words=part_words).collect()}
    assert len(got) == len(TEXTS) + 3
    named = [("" if k is None else k, t) for k, t in ITEMS]
    for i, text in enumerate(TEXTS + TEXTS[:3]):
        n, hit, items = plain_hits(text, named)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (n, hit, items), text
        assert got[i]["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in catalog.op9_decontamination(spark, folder).collect():
        n, hit, found = plain_hits(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_removal(spark):
    docs = spark.createDataFrame([(1, "Keep this. A short item, and more.", "x"), (2, "clean text", "y"), (3, None, "z"),
                                  (4, "short item " + "w " * 100, "z")], "doc_id long, text string, items string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[1] == "Keep this. A and more." and cut[2] == "clean text" and cut[3] is None and cut[4] == "w " * 100
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, bench, remove="all")


def test_odd_rows(spark):
    docs, bench = odd.docs(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.report(docs, bench).count() == len(odd.DOCS)
    assert odd.same_rows(decontaminate.decontaminate(docs, bench), docs)
    assert odd.same_rows(decontaminate.decontaminate(docs, bench.filter("false")), docs)
    assert decontaminate.report(odd.empty(spark), bench).isEmpty()
