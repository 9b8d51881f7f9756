"""Personal data: base patterns, and terms that give protected entities away.

DataFrame functions only. Patterns find the base spans. Each base value (an
address, a number) is a protected entity e. For words t next to it the corpus
tells how much t reveals: with p(e) the share of documents that hold e and
p(e|t) the share of documents holding t in which t stands next to e,

    disclosure(e, t) = PMI(e, t) / IC(e) = 1 - log p(e|t) / log p(e),

1 if t never occurs without e, 0 if t says nothing. Words that stand by e in
`min_contexts` different surroundings and disclose `generalise_at` or more are
spans of kind `term` in the documents that hold e: they are replaced by their
kind, or removed from `remove_at` on. All documents count for p(e) and p(t).

Defined results: null and empty texts have no spans; repeated rows get equal
results and count as often as they occur; ids may be null; without documents the
result is empty. Columns but doc_id and text are ignored, or passed through by
`sanitised`. Positions are code points, ends exclusive.

The patterns are those of the contract, with bounds that keep them linear on
long runs: possessive repeats where nothing could be given back, and starts only
where a run begins or the previous match ended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import pinned

# Kinds and patterns of base spans, in the order in which they are listed.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be worth running.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"(?:[0-9][\x20-]?){12}[0-9]", "phone": r"\+[0-9]"}
_LETTERS = r"\p{L}+"
_BLOCK = 256


@dataclass(frozen=True)
class Disclosure:
    """window: words looked at on either side of an entity; min_letters: of a term."""

    window: int = 8
    min_letters: int = 3
    min_contexts: int = 3
    generalise_at: float = 0.8
    remove_at: float = 0.95


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once: lambdas would compute it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, fold) -> Column:
    """For each element of a bound array the fold (from 0) of those before it, in blocks so
    that the work per element is bounded by the block and the number of blocks."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), fold),
    )

    def starts(bound: Column) -> Column:
        return F.transform(bound, lambda _, b: F.aggregate(F.slice(bound, F.lit(1), b), F.lit(0), fold))

    def inside(bound: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(values) - 1),
            lambda i: fold(
                F.get(bound, F.floor(i / _BLOCK).cast("int")),
                F.aggregate(F.slice(values, i - i % _BLOCK + 1, i % _BLOCK), F.lit(0), fold),
            ),
        )

    every = _let(blocks, lambda bound: _let(starts(bound), inside))
    return F.when(F.size(values) > 0, every).otherwise(F.array().cast("array<int>"))


def _matches(text: Column, pattern: str) -> Column:
    """start, end, value, left and right (text up to the neighbouring matches) of each match."""
    cut = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")
    )

    def spans(parts: Column) -> Column:
        hits, gaps = parts["hits"], parts["gaps"]
        steps = F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h))

        def span(offsets: Column):
            def made(hit: Column, i: Column) -> Column:
                start = F.get(offsets, i) + F.length(F.get(gaps, i))
                return F.struct(
                    start.alias("start"),
                    (start + F.length(hit)).alias("end"),
                    hit.alias("value"),
                    F.get(gaps, i).alias("left"),
                    F.get(gaps, i + 1).alias("right"),
                )

            return made

        return _let(steps, lambda s: _let(_before(s, lambda a, b: a + b), lambda o: F.transform(hits, span(o))))

    return _let(cut, spans)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    reverse = F.reverse(digits)
    values = F.transform(
        F.sequence(F.lit(0), F.length(digits) - 1),
        lambda i: F.substring(reverse, i + 1, F.lit(1)).cast("int") * (1 + i % 2),
    )
    return F.aggregate(values, F.lit(0), lambda total, v: total + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(13, 19), _let(_digits(value), _luhn)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _context(left: Column, right: Column, settings: Disclosure) -> Column:
    """Distinct words near a match, lower-cased; words that the cut may have torn are left out."""
    reach = 25 * settings.window
    tail = F.regexp_replace(F.lower(F.right(left, F.lit(reach))), rf"^{_LETTERS}", " ")
    head = F.regexp_replace(F.lower(F.left(right, F.lit(reach))), rf"{_LETTERS}$", " ")
    before = F.regexp_extract_all(tail, F.lit(_LETTERS), F.lit(0))
    after = F.regexp_extract_all(head, F.lit(_LETTERS), F.lit(0))
    near = F.concat(
        F.slice(before, F.greatest(F.size(before) - settings.window + 1, F.lit(1)), F.lit(settings.window)),
        F.slice(after, F.lit(1), F.lit(settings.window)),
    )
    return F.array_sort(F.array_distinct(F.filter(near, lambda w: F.length(w) >= settings.min_letters)))


def base_spans(docs: DataFrame, settings: Disclosure | None = None) -> DataFrame:
    """doc_id, holder (key of the text, null without spans), text (null without spans)
    and one array per kind of (start, end, value, near)."""
    settings = settings or Disclosure()
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def spans(kind: str) -> Column:
        found = F.filter(_matches(F.col("text"), PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        hint = F.contains(F.col("text"), F.lit("@")) if kind == "email" else F.col("text").rlike(_HINTS[kind])
        kept = F.transform(
            found,
            lambda m: F.struct(
                m["start"].alias("start"),
                m["end"].alias("end"),
                F.concat(F.lit(f"{kind}:"), F.lower(m["value"])).alias("entity"),
                _context(m["left"], m["right"], settings).alias("near"),
            ),
        )
        none = F.array().cast("array<struct<start:int,end:int,entity:string,near:array<string>>>")
        return F.when(hint, kept).otherwise(none).alias(kind)

    rows = given.select("doc_id", "text", *[spans(kind) for kind in PATTERNS])
    some = F.greatest(*[F.size(kind) for kind in PATTERNS]) > 0
    return rows.select(
        "doc_id",
        F.when(some, F.sha2("text", 256)).alias("holder"),
        F.when(some, F.col("text")).alias("text"),
        *PATTERNS,
    )


def disclosing_terms(docs: DataFrame, found: DataFrame, settings: Disclosure | None = None) -> DataFrame:
    """entity, term and disclosure of the words that give an entity away.

    `found` are the base spans of all documents of `docs`, pinned. Words are
    counted over all documents, once for each, and added up before the shuffle.
    """
    settings = settings or Disclosure()
    total = found.count()
    spans = F.concat(*[F.col(kind) for kind in PATTERNS])
    held = (
        found.where("holder is not null")
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", F.explode(spans).alias("s"))
        .select("row", "s.entity", "s.near")
    )
    entities = held.groupBy("entity").agg(F.count_distinct("row").alias("n_entity"))
    surroundings = held.groupBy("entity", "near").agg(F.count_distinct("row").alias("rows"))
    joint = (
        surroundings.select("entity", F.explode("near").alias("term"), "rows")
        .groupBy("entity", "term")
        .agg(F.count(F.lit(1)).alias("contexts"), F.sum("rows").alias("n_both"))
        .where(F.col("contexts") >= settings.min_contexts)
    )
    words = F.array_distinct(F.split(F.lower("text"), r"\P{L}+"))
    counts = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    given = F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))
    share = F.when(
        F.col("n_entity") < total, 1 - F.log(given) / F.log(F.col("n_entity") / F.lit(float(max(total, 1))))
    ).otherwise(0.0)
    return (
        joint.join(entities, "entity")
        .join(counts, "term")
        .select("entity", "term", share.alias("disclosure"))
        .where(F.col("disclosure") >= settings.generalise_at)
    )


def all_spans(docs: DataFrame, settings: Disclosure | None = None) -> DataFrame:
    """doc_id, holder, text (null without spans), the base spans by kind, and term
    spans (start, end, removed) that overlap no base span."""
    settings = settings or Disclosure()
    found = pinned(base_spans(docs, settings))
    telling = disclosing_terms(docs, found, settings)
    entities = F.array_distinct(F.transform(F.concat(*[F.col(kind) for kind in PATTERNS]), lambda s: s["entity"]))
    by_text = (
        found.where("holder is not null")
        .select("holder", F.explode(entities).alias("entity"))
        .distinct()
        .join(telling, "entity")
        .groupBy("holder", "term")
        .agg(F.max("disclosure").alias("disclosure"))
        .groupBy("holder")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("terms"))
    )
    marked = found.where("holder is not null").join(by_text, "holder", "left")
    base = F.concat(*[F.col(kind) for kind in PATTERNS])
    words = F.transform(
        _matches(F.col("text"), _LETTERS),
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.col("terms")[F.lower(m["value"])].alias("share")),
    )
    telling_words = _let(
        base,
        lambda spans: F.filter(
            F.filter(words, lambda w: w["share"].isNotNull()),
            lambda w: ~F.exists(spans, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])),
        ),
    )
    terms = F.when(
        F.col("terms").isNotNull(),
        F.transform(
            telling_words,
            lambda w: F.struct(
                w["start"].alias("start"), w["end"].alias("end"), (w["share"] >= settings.remove_at).alias("removed")
            ),
        ),
    )
    none = F.array().cast("array<struct<start:int,end:int,removed:boolean>>")
    columns = ["doc_id", "holder", "text", *PATTERNS]
    with_terms = marked.select(*columns, F.coalesce(terms, none).alias("term"))
    return with_terms.unionByName(found.where("holder is null").select(*columns, none.alias("term")))


def _written(kind: str) -> Column:
    return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def span_report(docs: DataFrame, settings: Disclosure | None = None) -> DataFrame:
    """Per document: doc_id, counts by kind, base_sha256 and spans."""
    base = F.concat(*[_written(kind) for kind in PATTERNS])
    return all_spans(docs, settings).select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in PATTERNS],
        F.size("term").cast("long").alias("n_term"),
        F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(base, _written("term"))).alias("spans"),
    )


def masked(text: Column, marks: Column) -> Column:
    """The text with the union of all marks (start, end, label) replaced, each stretch
    by the label of its first mark."""
    def whole(ordered: Column, reach: Column) -> Column:
        def piece(mark: Column, i: Column) -> Column:
            done = F.get(reach, i)
            clear = F.substring(text, done + 1, F.greatest(mark["start"] - done, F.lit(0)))
            return F.when((mark["start"] >= done), F.concat(clear, mark["label"])).otherwise(F.lit(""))

        last = F.array_max(F.transform(ordered, lambda m: m["end"]))
        rest = F.substring(text, last + 1, F.length(text))
        return F.concat(F.array_join(F.transform(ordered, piece), ""), rest)

    def with_reach(ordered: Column) -> Column:
        ends = F.transform(ordered, lambda m: m["end"])
        reach = _let(ends, lambda e: _before(e, lambda a, b: F.greatest(a, b)))
        return _let(reach, lambda r: whole(ordered, r))

    return F.when(F.size(marks) > 0, _let(F.array_sort(marks), with_reach)).otherwise(text)


def sanitised(docs: DataFrame, settings: Disclosure | None = None) -> DataFrame:
    """The documents with personal data masked; columns as in `docs`. Texts without any
    are passed as they are; only rows with spans go through the join with the masks."""
    def labelled(kind: str) -> Column:
        def mark(s: Column) -> Column:
            label = F.when(s["removed"], "").otherwise("[term]") if kind == "term" else F.lit(f"[{kind}]")
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), label.alias("label"))

        return F.transform(F.col(kind), mark)

    marks = F.concat(*map(labelled, [*PATTERNS, "term"]))
    clean = (
        all_spans(docs, settings)
        .where("holder is not null")
        .select(F.col("holder").alias("__pii_holder"), masked(F.col("text"), marks).alias("__pii_text"))
        .dropDuplicates(["__pii_holder"])
    )
    hinted = F.coalesce(
        F.contains(docs["text"], F.lit("@")) | docs["text"].rlike("|".join(_HINTS[k] for k in ("ip", "card", "phone"))),
        F.lit(False),
    )
    keyed = docs.where(hinted).withColumn("__pii_key", F.sha2(docs["text"], 256))
    columns = [
        F.coalesce("__pii_text", "text").alias("text") if c == "text" else F.col(c) for c in docs.columns
    ]
    mended = keyed.join(clean, F.col("__pii_key") == F.col("__pii_holder"), "left").select(*columns)
    return mended.unionByName(docs.where(~hinted))
