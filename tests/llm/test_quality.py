import re

import odd
from pyspark.sql import functions as F

from siteframe.llm import quality

LINE = "subscribe to our weekly newsletter now and never miss a story"


def plain_repeats(text, window=8):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(words) - window + 1):
        places.setdefault(tuple(words[i:i + window]), []).append(i)
    return len({i + k for at in places.values() if len(at) > 1 for i in at for k in range(window)})


def test_repeated_words():
    texts = ["", "a b c", "a b c d e f g h a b c d e f g h", "x " * 40, " ".join(str(i % 9) for i in range(60)), "p q " * 3 + odd.WORDS,
             odd.WORDS + " " + odd.WORDS, "a b c d e f g", "a b c d e f g h"]
    got = quality.repeated_words([t.encode().split() for t in texts])
    assert got.tolist() == [plain_repeats(t) for t in texts]


def site(spark, texts, host="h", start=0):
    return spark.createDataFrame([(start + i, t, "en", host, len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")


def own(i, n=30):
    """A line of its own: digits would count as equal."""
    return " ".join(f"w{i}x{k}" for k in range(n)).translate(str.maketrans("0123456789", "abcdefghij"))


def test_frequent_line_is_cut_and_depleted_documents_go(spark):
    texts = [f"{own(i)}\n{LINE}\n{own(i + 1000)}" for i in range(30)] + [f"{LINE}\nshort text {own(i + 2000, 2)}" for i in range(5)]
    docs = site(spark, texts)
    kept = {r["doc_id"]: r for r in quality.clean(docs).collect()}
    assert set(kept) == set(range(30))
    assert kept[3]["text"] == f"{own(3)}\n{own(1003)}" and kept[3]["n_chars"] == len(kept[3]["text"])
    judged = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert judged[0]["removed_words"] == 11 and judged[0]["kept"] and not judged[31]["kept"]


def test_copies_are_no_frequent_lines(spark):
    base = "\n".join(own(k) for k in range(8))
    exact = [base] * 40
    near = ["\n".join(own(k + 100) + (f" {own(i + 9000, 1)}" if k == i % 8 else "") for k in range(8)) for i in range(40)]
    docs = site(spark, exact + near + [own(i) for i in range(500, 520)])
    judged = quality.judge(docs)
    assert judged.filter("removed_words > 0 or not kept").isEmpty()


def test_limit_is_of_the_host(spark):
    few = [f"{own(i)}\n{LINE}" for i in range(5)]
    docs = site(spark, few, "a").unionByName(site(spark, [f"{own(i + 50)}\n{LINE}" for i in range(5)], "b", 100))
    assert quality.judge(docs).filter("removed_words > 0").isEmpty()


def test_odd_rows(spark):
    docs = odd.docs(spark)
    got = quality.judge(docs).collect()
    assert len(got) == len(odd.DOCS)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["n_words"] == by[4]["n_words"] == by[5]["n_words"] == 0 and by[3]["base_failed"] and not by[3]["kept"]
    assert by[6]["n_words"] == 60_000 and by[6]["n_repeat_words"] == plain_repeats(odd.LONG)
    assert by[8]["word_chars"] == len("GrößeundStraßefüralle")
    assert by[1]["kept"] and by[2]["kept"]
    clean = quality.clean(docs)
    assert clean.columns == docs.columns
    assert clean.count() == sum(bool(r["kept"]) for r in got)
    assert quality.judge(odd.empty(spark)).isEmpty() and quality.clean(odd.empty(spark)).isEmpty()


def test_duplicate_lines_and_symbols(spark):
    docs = site(spark, ["a b\na b\n\n\n \na b \nc #$|<", "x" * 10 + "\r\nx\r\nx\r"])
    a, b = quality.judge(docs).orderBy("doc_id").select("n_dup_lines", "n_symbols", "n_words").collect()
    assert tuple(a) == (1, 4, 8) and tuple(b) == (1, 0, 3)
    assert docs.select(F.max("doc_id")).first()[0] == 1


def test_templates_of_several_lines(spark):
    lines = [f"{LINE} {own(7000 + k, 3)}" for k in range(15)]
    docs, expected, start = None, {}, 0
    for shared, alone in ((2, 1), (3, 1), (5, 1), (5, 3), (5, 10)):
        host = f"{shared}-{alone}"
        texts = ["\n".join([*lines[:shared], *[own(start + 20 * i + k, 12) for k in range(alone)]]) for i in range(60)]
        table = site(spark, texts, host, start)
        docs = table if docs is None else docs.unionByName(table)
        expected[host] = shared
        start += 2000
    found = quality.frequent_lines(quality.measure(docs)).groupBy("host").count().collect()
    assert {r["host"][1:]: r["count"] for r in found} == expected


def test_signatures_of_copies_and_short_texts():
    words = [own(i, 200).split() for i in range(2)]
    copy = [*words[0][:100], "x", *words[0][101:]]
    a, b, c, short, none = quality.signatures([[w.encode() for w in t] for t in (words[0], copy, words[1], ["one", "two"], [])], quality.WordCodes())
    assert sum(x == y for x, y in zip(a, b, strict=True)) >= 12 and not set(a) & set(c)
    assert len(short) == quality.SIGNS and none is None
    assert quality.signatures([[b"one", b"two"]], quality.WordCodes()) == [short]
