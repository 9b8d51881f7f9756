"""URL filters: rules for hosts and paths, and a word model where no rule fits.

Host names are cut into words: among all ways to split a name, unigram Viterbi picks
the one whose words are likeliest, with word counts from the visible text of all
pages; an unknown word of k letters counts 10 / (N * 10^k). Multinomial naive Bayes
then scores host words and path tokens, learned from the pages that rules decide. Log
ratios are rounded to a multiple of 2^-20, so that sums don't depend on their order.

Words reach names by a join on the name's substrings (at most `longest` per letter):
words of more letters are not counted, and a longer name is always split. Names, hosts
and urls are worked on once each, however many pages have them. The vocabulary and the
weights of features are broadcast while they have at most 500,000 rows, because some
words and features are very frequent, and are joined by exchange beyond that.

Defined results: a null url, or one without "://", has an empty host and path; no rule
fits these and only the share of blocked pages speaks for them; without any page that
a rule decides all scores are 0; a score of 0 or less allows; repeated rows get equal
verdicts; a null html has no words; html, hosts and paths of any length are read whole;
scripts and styles count up to their closing tag, an opening one that nothing closes is a
tag like others; ids may be null; an empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import let, pinned, slices

# (verdict, host, path)
Rule = tuple[str, str, str]
_SCALE = 1 << 20
_BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    return (
        F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")),
        F.coalesce(path, F.lit("")),
    )


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (host and path written together), and its verdict."""
    names = verdicts = F.lit(None).cast("string")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        names = F.when(fits, rule_host + rule_path).otherwise(names)
        verdicts = F.when(fits, verdict).otherwise(verdicts)
    return names, verdicts


def _without(html: Column, kind: str) -> Column:
    """The text without elements of a kind; an opening tag that nothing closes stays."""

    def kept(parts: Column) -> Column:
        last = F.size(parts) - 1
        return F.transform(
            parts, lambda p, i: F.when(i < last, F.regexp_replace(p, rf"(?is)<{kind}\b.*", " ")).otherwise(p)
        )

    return F.array_join(let(F.split(html, f"(?i)</{kind}>", -1), kept), " ")


def visible_text(html: Column) -> Column:
    """The text of a page without scripts, styles and tags. Whatever precedes a closing tag
    is searched once for its opening tag, so many unclosed ones cost no more than few."""
    return F.regexp_replace(_without(_without(html, "script"), "style"), "<[^<>]*>", " ")


def page_words(pages: DataFrame, longest: int) -> DataFrame:
    """word and n: counts over the visible text of all pages, added up before the shuffle.
    Words of more than `longest` letters are left out."""
    words = F.split(F.lower(visible_text(F.col("html"))), r"\P{L}+")
    return (
        pages.select(F.explode(words).alias("word"))
        .where(F.length("word").between(1, longest))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _small(table: DataFrame, rows: int) -> DataFrame:
    """The table, broadcast if it is small: what it is joined with has very frequent keys."""
    return F.broadcast(table) if rows <= _BROADCAST_ROWS else table


def best_split(name: str, known: dict[tuple[int, int], int], total: int, longest: int) -> list[str]:
    """Unigram Viterbi: known has the count of the word at (start, end)."""
    best = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - longest), end):
            n = known.get((start, end))
            cost = math.log(total / n) if n else math.log(max(total, 1) / 10) + (end - start) * math.log(10)
            options.append((best[start][0] + cost, start))
        best.append(min(options))
    words, end = [], len(name)
    while end:
        start = best[end][1]
        words.append(name[start:end])
        end = start
    return words[::-1]


def segmented_names(names: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """name and words of distinct names of letters."""
    total = int(words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    starts = F.sequence(F.lit(0), F.length("name") - 1)
    parts = names.select("name", F.explode(starts).alias("start")).select(
        "name", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("name") - F.col("start")))).alias("size")
    )
    parts = parts.withColumn("word", F.substring(F.col("name"), F.col("start") + 1, F.col("size")))
    words = _small(words, words.count())
    found = parts.join(words, "word").groupBy("name").agg(F.collect_list(F.struct("start", "size", "n")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cut = [
                best_split(name, {(k["start"], k["start"] + k["size"]): k["n"] for k in known or ()}, total, longest)
                for name, known in zip(*(c.to_pylist() for c in batch.columns), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.list_(pa.string()))], ["name", "words"])

    return names.join(found, "name", "left").select("name", "known").mapInArrow(run, "name string, words array<string>")


def host_words(hosts: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """host and its words, names of letters cut, digits as one token."""
    tokens = F.regexp_extract_all("host", F.lit(r"\p{L}+|[0-9]+"), F.lit(0))
    listed = hosts.select("host", F.posexplode(tokens).alias("at", "name"))
    letters = ~F.col("name").rlike("^[0-9]")
    cut = segmented_names(listed.where(letters).select("name").distinct(), words, longest)
    joined = listed.join(cut, "name", "left").select(
        "host", F.struct("at", F.coalesce("words", F.array(F.lit("#"))).alias("words")).alias("part")
    )
    parts = joined.groupBy("host").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return parts.select("host", F.flatten(F.transform("parts", lambda p: p["words"])).alias("words"))


def _features(urls: DataFrame, hosts: DataFrame) -> DataFrame:
    """host, path and feature: a row per host word and path token."""
    tokens = F.transform(
        F.regexp_extract_all(F.lower("path"), F.lit(r"\p{L}+|[0-9]+"), F.lit(0)),
        lambda t: F.concat(F.lit("path:"), F.when(t.rlike("^[0-9]"), "#").otherwise(t)),
    )
    named = F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("host:"), w))
    return urls.join(hosts, "host", "left").withColumn("feature", F.explode(F.concat(named, tokens))).drop("words")


def judged_urls(pages: DataFrame, rules: Sequence[Rule], longest: int = 20) -> DataFrame:
    """Per page: page_id, host, path, rule (null if none fits), score (null with a rule)
    and verdict."""
    host, path = url_parts(F.col("url"))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, decided = matching_rule(F.col("host"), F.col("path"), rules)
    placed = pinned(placed.withColumns({"rule": rule, "decided": decided}))
    urls = pinned(placed.groupBy("host", "path").agg(F.first("decided").alias("decided"), F.count(F.lit(1)).alias("pages")))
    words = page_words(pages, longest)
    hosts = host_words(urls.select("host").distinct(), pinned(words), longest)
    features = pinned(_features(urls, hosts))
    sides = [F.sum(F.when(F.col("decided") == v, F.col("pages")).otherwise(0)) for v in ("allow", "block")]
    counts = features.groupBy("feature").agg(*[s.alias(n) for s, n in zip(sides, ("allow", "block"), strict=True)])
    total = counts.agg(F.count(F.lit(1)), F.sum("allow"), F.sum("block")).first()
    known = urls.agg(*sides).first()
    n_allow, n_block = ((total[i] or 0) + total[0] for i in (1, 2))
    prior = math.log((known[1] + 1) / (known[0] + 1)) if known[0] or known[1] else 0.0
    ratio = F.log((F.col("block") + 1) / F.lit(float(max(n_block, 1)))) - F.log((F.col("allow") + 1) / F.lit(float(max(n_allow, 1))))
    weights = counts.select("feature", F.round(ratio * _SCALE).cast("long").alias("weight"))
    if not (known[0] or known[1]):
        weights = weights.withColumn("weight", F.lit(0).cast("long"))
    scores = features.where("decided is null").join(_small(weights, total[0]), "feature").groupBy("host", "path").agg(F.sum("weight").alias("sum"))
    start = round(prior * _SCALE)
    scored = placed.join(scores, ["host", "path"], "left")
    score = F.when(F.col("decided").isNull(), (F.coalesce("sum", F.lit(0)) + start) / _SCALE)
    verdict = F.coalesce("decided", F.when(score > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", score.alias("score"), verdict.alias("verdict"))
