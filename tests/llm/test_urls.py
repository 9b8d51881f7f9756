import math
import re
import time
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from changelens.llm import urls
from changelens.llm.queries import URL_RULES


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 2) for i, u, h in rows], "page_id long, url string, html string, word string, n int")


URLS = {
    "https://Shop.EXAMPLE.com/en/7?x=1#y": ("shop.example.com", "/en/7", "example.com/en/", "block"),
    "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    "http://a.www.example.com/en/x": ("a.www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://notexample.com/en/1": ("notexample.com", "/en/1", "com/", "allow"),
    "http://example.com/EN/1": ("example.com", "/EN/1", "com/", "allow"),
    "http://example.com": ("example.com", "", None, None),
    "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"),
    "//x.net/fr/1": ("", "", None, None),
    "a://b://c/d": ("b:", "//c/d", None, None),
    "": ("", "", None, None),
    "http://?q=/x": ("", "", None, None),
    "http://Ünï.com/é/#": ("Ünï.com", "/é/", "com/", "allow"),
}


def test_parts_and_rules(spark):
    host, path = urls.url_parts(F.col("u"))
    rule, verdict = urls.matching_rule(F.col("h"), F.col("p"), URL_RULES)
    df = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", host.alias("h"), path.alias("p"))
    got = {r["u"]: (r["h"], r["p"], r["rule"], r["v"]) for r in df.select("*", rule.alias("rule"), verdict.alias("v")).collect()}
    assert got == URLS


def test_best_split_is_the_best_of_all():
    counts = {"free": 40, "bets": 9, "fre": 2, "ebets": 1, "ee": 3, "b": 5, "et": 2, "s": 7}
    total = sum(counts.values())

    def cost(word):
        n = counts.get(word)
        return math.log(total / n) if n else math.log(total / 10) + len(word) * math.log(10)

    for name in ("freebets", "betsfree", "eebs", "qqq", "f"):
        known = {(i, j): counts[name[i:j]] for i, j in combinations(range(len(name) + 1), 2) if name[i:j] in counts}
        splits = []
        for k in range(len(name)):
            for cuts in combinations(range(1, len(name)), k):
                ends = [0, *cuts, len(name)]
                splits.append(sum(cost(name[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)))
        got = urls.best_split(name, known, total, 20)
        assert "".join(got) == name and sum(map(cost, got)) == pytest.approx(min(splits))


def pages():
    rows = [(i, f"http://m.goodnews{i % 3}.example.com/de/{i}", "<p>good news today</p>") for i in range(20)]
    rows += [(100 + i, f"http://freebets.site.net/{('es', 'fr')[i % 2]}/win/{i}", "<b>free bets win</b>") for i in range(20)]
    rows += [(200, "http://freebets.org/win/1", "free <i>bets</i>"), (201, "http://goodnews.org/de/x", None), (202, None, "x")]
    return rows + [(200, "http://freebets.org/win/1", "free <i>bets</i>"), (None, "no url", "")]


def test_verdicts_equal_a_plain_reading(spark):
    rows = pages()
    got = urls.judged_urls(table(spark, rows), URL_RULES).collect()
    assert len(got) == len(rows)
    words = Counter()
    for _, _, h in rows:
        words.update(w for w in re.findall(r"[^\W\d_]+", re.sub("<[^>]*>", " ", (h or "").lower())))
    total = sum(words.values())

    def features(host, path):
        out = []
        for t in re.findall(r"[^\W\d_]+|[0-9]+", host):
            if t[0].isdigit():
                out.append("host:#")
                continue
            known = {(i, j): words[t[i:j]] for i, j in combinations(range(len(t) + 1), 2) if t[i:j] in words}
            out += ["host:" + w for w in urls.best_split(t, known, total, 20)]
        return out + ["path:" + ("#" if t[0].isdigit() else t) for t in re.findall(r"[^\W\d_]+|[0-9]+", path.lower())]

    counts, pages_of = {"allow": Counter(), "block": Counter(), None: Counter()}, Counter()
    for r in got:
        decided = r["verdict"] if r["rule"] else None
        counts[decided].update(features(r["host"], r["path"]))
        pages_of[decided] += 1
    size = len(set().union(*counts.values()))
    sums = {v: sum(counts[v].values()) + size for v in ("allow", "block")}
    for r in got:
        if r["rule"] is None:
            score = math.log((pages_of["block"] + 1) / (pages_of["allow"] + 1)) + sum(
                math.log((counts["block"][f] + 1) / sums["block"]) - math.log((counts["allow"][f] + 1) / sums["allow"])
                for f in features(r["host"], r["path"])
            )
            assert r["score"] == pytest.approx(score, abs=1e-4)
            assert r["verdict"] == ("block" if r["score"] > 0 else "allow")
    by_id = {r["page_id"]: r["verdict"] for r in got}
    assert by_id[200] == "block" and by_id[201] == "allow"


def test_without_decided_pages_and_empty(spark):
    rows = urls.judged_urls(table(spark, [(1, "http://x.org/a", None), (2, None, None)]), URL_RULES).collect()
    assert {(r["verdict"], r["score"]) for r in rows} == {("allow", 0.0)}
    assert urls.judged_urls(table(spark, []), URL_RULES).collect() == []


def test_visible_text(spark):
    pages = {
        "a<script>x</SCRIPT>b": "a b", "a<style t=1>x\ny</style>b<p>c</p>": "a b c", "a<script>b": "a b",
        "<scripts>a</scripts>": "a", "a</script>b": "a b", "<style><script>x</script>y</style>z": "z", None: "", "1 < 2 <b>x</b>": "1 < 2 x",
    }
    df = spark.createDataFrame([(h,) for h in pages], "h string")
    got = {r["h"]: " ".join((r["t"] or "").split()) for r in df.select("h", urls.visible_text(F.col("h")).alias("t")).collect()}
    assert got == pages


@pytest.mark.parametrize("piece", ["<script>", "<style x", "<", "<script></style>"])
def test_a_long_page_of_open_tags_takes_linear_time(spark, piece):
    html = piece * (1_000_000 // len(piece)) + " end"
    begin = time.time()
    words = urls.page_words(table(spark, [(1, "u", html)]), 20).collect()
    assert time.time() - begin < 10 and "end" in {r["word"] for r in words}


def test_small_and_large_word_tables_agree(spark, monkeypatch):
    rows = [*pages(), (300, f"http://{'ab' * 3000}.org/{'x' * 20_000}", "<p>" * 20_000)]
    first = sorted(map(str, urls.judged_urls(table(spark, rows), URL_RULES).collect()))
    monkeypatch.setattr(urls, "_BROADCAST_ROWS", 0)
    assert sorted(map(str, urls.judged_urls(table(spark, rows), URL_RULES).collect())) == first
