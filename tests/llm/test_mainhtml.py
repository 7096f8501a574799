import math
import random
import time

import numpy as np
import odd
from pyspark.sql import functions as F

from siteframe.llm import catalog, mainhtml

LONG = "This is a long paragraph of the story, with many words in it that tell what happened on that day and why it mattered."


def test_article_is_kept_whole():
    html = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- c --><div class="ad">Buy &amp; save {LONG}</div>
    <article><h1>Head&amp;line</h1><p><b>{LONG}<br><p>Short.</p><div class="ad-slot">advert</div><p>A&nbsp;b
      c &lt;d&gt; in<i>li</i>ne</p><form>Name <input></form><aside>side</aside></article>
    <div class="cookie-notice">cookies {LONG}</div><section id="comments"><article>{LONG}</article><p>{LONG}</p></section><footer>&copy; {LONG}</footer></body></html>"""
    assert mainhtml.main_text(html) == f"Head&line {LONG} Short. A b c <d> inline"


def test_page_without_article_marks():
    story = "".join(f"<p>{LONG} {i}</p>" for i in range(6))
    html = f"<body><div id='menu'><a>Home</a> <a>About</a></div><div class='page'><div class='links'><a>x</a><a>y</a></div><div class='text'><h2>Title</h2>{story}<p>End.</p></div><div class='sidebar'>{LONG}</div></div>"
    assert mainhtml.main_text(html) == " ".join(["Title", *[f"{LONG} {i}" for i in range(6)], "End."])


def test_small_cases():
    assert mainhtml.main_text("") == "" and mainhtml.main_text("<nav>menu</nav>") == ""
    assert mainhtml.main_text("just text") == "just text"
    assert mainhtml.main_text("<article>a</article><article>b</article>") in ("a b", "a", "b")
    assert mainhtml.main_text("<article><p>a<p>b</article") == "a b"
    assert mainhtml.main_text("<div hidden>x</div><main>y</main>") == "y"
    assert mainhtml.main_text("<p>&#x41;&eacute;&unknown;</p>") == "Aé&unknown;"
    assert mainhtml.main_text("<article>a <span class='ad'>buy</span><b>b</b><div class='user-comments-list'>c</div></article>") == "a b"
    assert mainhtml.main_text("<div class='no-sidebar has-ads'>" + LONG + "</div>") == LONG
    assert mainhtml.main_text("<p>a</p>" * 20_000).count("a") == 20_000


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in catalog.op3_main_text(spark, folder).collect():
        inner = html[r["page_id"]].split("<article>")[1].split("</article>")[0]
        for tag in ("h1", "p", "br"):
            inner = inner.replace(f"<{tag}>", " ").replace(f"</{tag}>", " ")
        plain = inner.replace("<b>", "").replace("</b>", "").replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&#x27;", "'").replace("&amp;", "&")
        assert r["text"] == " ".join(plain.split()) and r["n_chars"] == len(r["text"])


def test_odd_rows(spark):
    docs = odd.docs(spark).withColumnRenamed("text", "html").withColumn("text", F.lit("clash"))
    got = mainhtml.extract(docs, [F.col("doc_id")]).collect()
    assert len(got) == len(odd.DOCS)
    by = {r["doc_id"]: r["text"] for r in got}
    assert by[3] == by[4] == by[5] == "" and by[6] == odd.LONG and by[1] == odd.WORDS
    assert mainhtml.extract(docs.filter("false"), [F.col("doc_id")]).isEmpty()


def test_small_sibling_with_content_is_kept():
    # Short lines make the lower cluster, all long ones are content.
    story = "<p>Short.</p>" * 8 + f"<p>{LONG}</p>" * 24
    body, whole = " ".join(["Short."] * 8 + [LONG] * 24), LONG.replace("story", "ending")
    menu = "<div id='menu'><a>Home</a> <a>About</a></div>"
    split = f"<body>{menu}<article>{story}</article><article><p>{whole}</p></article></body>"
    unmarked = f"<body>{menu}<div class='text'><div>{story}</div><div><p>{whole}</p></div></div></body>"
    assert mainhtml.main_text(split) == mainhtml.main_text(unmarked) == f"{body} {whole}"


def test_marks_that_mislead():
    assert LONG in mainhtml.main_text(f"<article><p>a</p></article><div class='content'><p>{LONG}</p></div>")
    assert mainhtml.main_text(f"<body><div><p>{LONG}</p></div><div><p>ok</p></div></body>") == f"{LONG} ok"
    assert mainhtml.main_text(f"<h1>Title</h1><div><p>{LONG}</p></div><div><a href='/'>other</a> <a href='/x'>pages</a></div>") == f"Title {LONG}"
    assert mainhtml.main_text(f"<div id='form-of-life'><p>{LONG}</p></div>") == LONG
    assert mainhtml.main_text(f"<main><p>{LONG}</p><div class='related-work'>r</div><div class='search-results'>s</div><div class='related-box'>b</div></main>") == f"{LONG} r s"


def test_deep_pages_take_linear_time():
    for html in ("<div>x" * 20_000, "<i>" * 16_000 + "</p>" * 16_000 + "x", "<ul><li>a" * 10_000):
        began = time.time()
        assert mainhtml.main_text(html).replace(" ", "") in ("x" * 20_000, "x", "a" * 10_000)
        assert time.time() - began < 5


def test_ratio_smoothing_and_clusters_against_plain_version():
    rng = random.Random(4)
    for _ in range(60):
        lines = [mainhtml.Line(words="w" * rng.choice((1, 5, 40, 300)), tags=rng.randrange(6)) for _ in range(rng.randrange(1, 30))]
        raw = [len(x.words) / max(1, x.tags) for x in lines]
        weights = {k: math.exp(-k * k / 2) for k in range(-3, 4)}
        plain = [sum(w * raw[min(max(i + k, 0), len(raw) - 1)] for k, w in weights.items()) / sum(weights.values()) for i in range(len(raw))]
        smooth = mainhtml.ratios(lines)
        assert np.allclose(smooth, plain)
        low, high = min(plain), max(plain)
        for _ in range(1000):
            near_high = [v > (low + high) / 2 for v in plain]
            groups = [[v for v, h in zip(plain, near_high, strict=True) if h == side] for side in (False, True)]
            if not all(groups):
                break
            low, high = (sum(g) / len(g) for g in groups)
        assert abs(mainhtml.threshold(smooth) - (low + high) / 2) < 1e-6
