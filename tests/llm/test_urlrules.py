import re

import odd
from pyspark.sql import functions as F

from siteframe.llm import catalog, urlrules

URLS = ["http://Example.NET/en/1", "https://m.example.net/en", "https://x.example.net/fr/1?a#b", "ftp://net/", "http://net", "http://bnet/", "http://a.com/", None, "", "nothing",
        "http://example.com/de/", "http://example.com/de", "http://example.com/DE/", "http://a.org/fr/x", "http://org/fr/", "http://example.com:80/de/", "http://u@net/x",
        "http://ads.example.com/x", "http://a.com/login", "http://a.com/login/x", "http://a.com/mylogin", "http://a.com/x.exe", "http://a.com/x.exe/", "http://a.com/wiki/casino",
        "http://a.com/casino", "http://é.net/é", "http://a.com/x\n", "a://b://net/", "http://a.com/help/login", "://net/p", "http://a.com?x=/casino", "http://a.com/" + "x/" * 20000 + "casino"]


def plain(url, rules):
    head, found, rest = (url or "").partition("://")
    host = re.match("[^/?#]*", rest)[0] if found else ""
    path = re.match("[^?#]*", rest[len(host):])[0] if found else ""
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for r in rules:
        if r.host_rule:
            name, slash, prefix = r.name.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith(slash + prefix):
                fits.append(r)
    if fits:
        best = max(fits, key=lambda r: r.length)
        return host, path, best.name, best.action
    actions = {r.action for r in rules if not r.host_rule and re.search(r.regex.replace("\\z", "\\Z"), host + path)}
    return host, path, None, "block" if actions == {"block"} else "allow"


def test_against_all_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").select(
        "*", *[F.lit(1).alias(c) for c in ("host", "path", "token", "rule", "number", "name", "regex", "found")])
    rules = urlrules.compile_rules()
    got = {r["page_id"]: r for r in urlrules.judge(pages).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == plain(url, rules), url
    assert got[23]["verdict"] == "allow" and got[24]["verdict"] == "block"


def test_tokens_are_those_of_every_match():
    assert urlrules.pattern_tokens("||example.net/en/") == ["example", "net", "en"]
    assert urlrules.pattern_tokens("||example.com/de") == ["example", "com"]
    assert urlrules.pattern_tokens("casino") == [] and urlrules.pattern_tokens("^casino^") == ["casino"]
    assert urlrules.pattern_tokens("||ad*.net^") == ["net"] and urlrules.pattern_tokens(".exe|") == ["exe"]
    rules = {r.name: r.token for r in urlrules.compile_rules()}
    assert rules["example.net/en/"] == "en" and rules["net/"] == "net"


def test_many_rules_and_rules_without_token(spark):
    rules = urlrules.compile_rules([("block", f"h{i}.net/") for i in range(300)], [("block", "spam"), ("allow", "*nospam*")])
    pages = spark.createDataFrame([(1, "http://h7.net/x"), (2, "http://h7.com/aspamb"), (3, "http://h8.com/nospam"), (4, "http://x/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urlrules.judge(pages, rules).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_repeats_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://net/"), (1, "http://net/"), (None, "http://net/")], "page_id long, url string")
    assert urlrules.judge(pages).filter("rule = 'net/'").count() == 3
    assert urlrules.judge(pages.filter("false")).isEmpty()
    assert catalog.op2_url_filter(spark, "/root/testdata/sf0.001").count() == 50 and odd.CLASHING
