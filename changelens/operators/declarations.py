"""Declarations of Go files, by one pass over brackets with their depth.

The text is taken through array functions that are linear in its length:

1. comments, strings and runes are blanked, their line ends kept;
2. the rest is cut behind every bracket, and running sums give each piece its depth and
   the line it begins on;
3. pieces at depth 0 with what their bracket encloses are the segments of the file: a
   header is one or more neighbouring segments, however its lines are broken and whatever
   is nested in it. Type groups are cut into segments of their own in the same way.

Methods meet their types by sorting both by name, not by comparing each with each.

Limits: local type groups are not looked into, and behind a closing bracket that is
missing nothing is at depth 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions import text

_BLANKED = (
    r"//[^\n]*+|/\*(?s:.*?)\*/|`[^`]*+`"
    r'|"(?:\\.|[^"\\\n])*+"'
    r"|'(?:\\.|[^'\\\n]){1,8}'"
)
_WORD = r"[\p{L}_][\p{L}\p{Nd}_]*+"
_BEGIN = r"(?:^|[\n;}])\s*"
_FUNCTION = rf"{_BEGIN}func\s+({_WORD})\s*$"
_RECEIVER = rf"{_BEGIN}func\s*$"
_METHOD = rf"^\s*({_WORD})\s*$"
_STRUCT = rf"\btype\s+({_WORD})\s*(?:=\s*)?\bstruct\s*$"
_GENERIC = rf"{_BEGIN}type\s+({_WORD})\s*$"
_GROUP = rf"{_BEGIN}type\s*$"
_GROUPED = rf"(?:^|[\n;}}])\s*({_WORD})\s*(?:=\s*)?\bstruct\s*$"
_GROUPED_GENERIC = rf"(?:^|[\n;}}])\s*({_WORD})\s*$"
_PLAIN_STRUCT = r"^\s*struct\s*$"
_TYPE_PARAMETERS = rf"^\s*{_WORD}(?:\s*,\s*{_WORD})*+\s+[^\s\]]"
# A receiver counts if it is a name or a pointer to one, without type parameters.
_RECEIVER_TYPE = rf"^\s*(?:{_WORD}\s+)?\*?\s*({_WORD})\s*\)$"
# First words of unnamed parameters that consist of two words.
_TYPE_WORDS = r"^(?:chan|func|map|interface|struct)\b"
_NAMED = rf"^{_WORD}\s+\S"


def blanked(content: Column) -> Column:
    """The text with comments, strings and runes replaced by their line ends."""
    outside = F.split(content, _BLANKED, -1)
    ends = F.transform(F.regexp_extract_all(content, F.lit(_BLANKED), F.lit(0)), lambda hit: F.regexp_replace(hit, r"[^\n]+", ""))
    return F.array_join(F.flatten(F.zip_with(outside, ends, lambda a, b: F.array(a, F.coalesce(b, F.lit(" "))))), " ")


def _balance(piece: Column) -> Column:
    last = F.right(piece, F.lit(1))
    opening, closing = last.isin("(", "[", "{"), last.isin(")", "]", "}")
    return F.when(opening, 1).when(closing, -1).otherwise(0)


def _pieces(source: Column) -> Column:
    """The text cut behind every bracket."""
    return F.split(source, r"(?<=[()\[\]{}])", -1)


def _depths(pieces: Column) -> Column:
    """Open brackets before each piece."""
    return text.sums_before(F.transform(pieces, _balance))


def _lines(pieces: Column) -> Column:
    """Line ends before each piece."""
    return text.sums_before(F.transform(pieces, text.newline_count))


def _outer(depths: Column) -> Column:
    """Indices of the pieces that no bracket encloses."""
    return F.filter(text.indices(F.size(depths)), lambda i: F.get(depths, i) <= 0)


def _segments(pieces: Column, tops: Column, lines: Column) -> Column:
    """lead (text up to an opening bracket), open, inner (what follows, up to the closing
    bracket and with it) and line (on which the lead begins, from 0), for each bracket that
    is not inside another one."""

    def made(at: Column, k: Column) -> Column:
        after = F.coalesce(F.get(tops, k + 1), F.size(pieces))
        whole = F.get(pieces, at)
        return F.struct(
            F.left(whole, F.length(whole) - 1).alias("lead"),
            F.right(whole, F.lit(1)).alias("open"),
            F.array_join(F.slice(pieces, at + 2, after - at - 1), "").alias("inner"),
            F.get(lines, at).alias("line"),
        )

    return F.transform(tops, made)


def _parts(parameters: Column) -> Column:
    """The parts of a parameter list between commas that are not nested in brackets."""

    def cut(pieces: Column) -> Column:
        kept = F.transform(pieces, lambda p: F.when(F.right(p, F.lit(1)) == ",", F.left(p, F.length(p) - 1)).otherwise(p))

        def joined(depth: Column) -> Column:
            ends = F.filter(
                text.indices(F.size(pieces)),
                lambda i: (i == F.size(pieces) - 1) | ((F.get(depth, i) <= 0) & (F.right(F.get(pieces, i), F.lit(1)) == ",")),
            )
            return text.let(
                ends,
                lambda e: F.transform(
                    e,
                    lambda end, k: text.trim_space(
                        F.array_join(
                            F.slice(
                                kept,
                                F.when(k > 0, F.get(e, k - 1) + 2).otherwise(1),
                                end - F.when(k > 0, F.get(e, k - 1)).otherwise(-1),
                            ),
                            "",
                        )
                    ),
                ),
            )

        return text.let(text.sums_before(F.transform(pieces, _balance), 1), joined)

    return F.filter(text.let(F.split(parameters, r"(?<=[()\[\]{},])", -1), cut), lambda part: part != "")


def arguments(parameters: Column) -> Column:
    """Names in a parameter list; a list of types only has none."""

    def named(part: Column) -> Column:
        return F.rlike(part, F.lit(_NAMED)) & ~F.rlike(part, F.lit(_TYPE_WORDS))

    def names(parts: Column) -> Column:
        words = F.transform(parts, lambda part: F.regexp_extract(part, rf"^({_WORD})", 1))
        return F.when(F.exists(parts, named), words).otherwise(F.array().cast("array<string>"))

    return text.let(_parts(parameters), names)


def _found(kind: str, name: Column, line: Column, parameters: Column | None = None, receiver: Column | None = None) -> Column:
    empty = F.lit("")
    return F.struct(
        line.cast("int").alias("line"), F.lit(kind).alias("kind"), name.alias("name"),
        (empty if parameters is None else parameters).alias("parameters"),
        (empty if receiver is None else receiver).alias("receiver"),
    )


def _line_of(segment: Column, pattern: str) -> Column:
    """Line, from 1, of the last line of a lead that matches from `pattern` on."""
    before = F.regexp_replace(segment["lead"], pattern, "")
    head = F.substring(segment["lead"], F.length(before) + 1, F.length(segment["lead"]))
    gap = F.regexp_extract(head, r"^[\n;}]?\s*", 0)
    return segment["line"] + text.newline_count(before) + text.newline_count(gap) + 1


def _without_bracket(inner: Column) -> Column:
    return F.left(inner, F.length(inner) - 1)


def _structs(found: Column, plain: str, generic: str, offset: Column) -> Column:
    """Struct types whose header begins in a segment that matches `plain` or `generic`."""

    def at(i: Column) -> Column:
        here, after = F.get(found, i), F.get(found, i + 1)
        direct = (here["open"] == "{") & F.rlike(here["lead"], F.lit(plain))
        parametric = (
            (here["open"] == "[") & F.rlike(here["lead"], F.lit(generic)) & F.rlike(here["inner"], F.lit(_TYPE_PARAMETERS))
            & F.coalesce((after["open"] == "{") & F.rlike(after["lead"], F.lit(_PLAIN_STRUCT)), F.lit(False))
        )
        return (
            F.when(direct, _found("class", F.regexp_extract(here["lead"], plain, 1), _name_line(here, plain) + offset))
            .when(parametric, _found("class", F.regexp_extract(here["lead"], generic, 1), _name_line(here, generic) + offset))
        )

    return F.filter(F.transform(text.indices(F.size(found)), at), lambda d: d.isNotNull())


def _name_line(segment: Column, pattern: str) -> Column:
    """Line, from 1, on which the name stands that `pattern` finds at the end of the lead."""
    tail = F.regexp_extract(segment["lead"], pattern, 0)
    behind = F.regexp_extract(tail, rf"(?:(?!{_WORD}\s*(?:=\s*)?(?:\bstruct\s*)?$)(?s:.))*({_WORD}(?s:.*))$", 1)
    return segment["line"] + text.newline_count(segment["lead"]) - text.newline_count(behind) + 1


def _functions(found: Column) -> Column:
    def at(i: Column) -> Column:
        here, second, third = (F.get(found, i + k) for k in range(3))
        generic = (here["open"] == "[") & F.coalesce(F.rlike(second["lead"], F.lit(r"^\s*$")) & (second["open"] == "("), F.lit(False))
        plain = F.rlike(here["lead"], F.lit(_FUNCTION))
        method = (here["open"] == "(") & F.rlike(here["lead"], F.lit(_RECEIVER)) & F.coalesce(
            (second["open"] == "(") & F.rlike(second["lead"], F.lit(_METHOD)), F.lit(False)
        )
        name, line = F.regexp_extract(here["lead"], _FUNCTION, 1), _line_of(here, _FUNCTION)
        receiver = F.regexp_extract(here["inner"], _RECEIVER_TYPE, 1)
        return (
            F.when(plain & (here["open"] == "("), _found("function", name, line, _without_bracket(here["inner"])))
            .when(plain & generic, _found("function", name, line, _without_bracket(second["inner"])))
            .when(
                method,
                _found(
                    "function", F.regexp_extract(second["lead"], _METHOD, 1), _line_of(here, _RECEIVER),
                    _without_bracket(second["inner"]), receiver,
                ),
            )
        )

    return F.filter(F.transform(text.indices(F.size(found)), at), lambda d: d.isNotNull())


def _local_structs(found: Column) -> Column:
    """Struct types declared inside function bodies, at any depth."""
    pattern = rf"(?<![\p{{L}}\p{{Nd}}_])type\s+({_WORD})\s*(?:=\s*)?\bstruct\s*(?=\{{)"

    def of(segment: Column) -> Column:
        body, before = segment["inner"], segment["line"] + text.newline_count(segment["lead"])
        hits, gaps = F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), F.split(body, pattern, -1)

        def made(pair: Column) -> Column:
            hit, gap = pair["hit"], pair["gap"]
            lines = F.transform(hit, lambda h, i: text.newline_count(F.get(gap, i)) + text.newline_count(h))

            def each(starts: Column) -> Column:
                return F.transform(
                    hit,
                    lambda h, i: _found(
                        "class", F.regexp_extract(h, pattern.replace(r"(?=\{)", ""), 1),
                        before + F.get(starts, i) + text.newline_count(F.get(gap, i)) + text.newline_count(F.regexp_extract(h, r"^type\s+", 0)) + 1,
                    ),
                )

            return text.let(text.sums_before(lines, 2), each)

        return text.let(F.struct(hits.alias("hit"), gaps.alias("gap")), made)

    bodies = F.filter(found, lambda s: (s["open"] == "{") & F.rlike(s["inner"], F.lit(pattern)))
    return F.flatten(F.transform(bodies, of))


def _group_pieces(found: Column) -> Column:
    """Line and pieces of the inside of each type group."""
    groups = F.filter(found, lambda s: (s["open"] == "(") & F.rlike(s["lead"], F.lit(_GROUP)))
    return F.transform(
        groups,
        lambda g: F.struct(
            (g["line"] + text.newline_count(g["lead"])).alias("line"), _pieces(_without_bracket(g["inner"])).alias("pieces")
        ),
    )


def with_declarations(files: DataFrame, source: Column, out: str) -> DataFrame:
    """Add `out`: functions and then struct types of a source text, each in order: line,
    kind, name, parameters, receiver; null for a null source.

    Every step is a column of its own, which the next one names several times, so that no
    step runs twice."""
    group = F.struct
    steps = {
        "_pieces": _pieces(blanked(source)),
        "_depths": _depths(F.col("_pieces")),
        "_lines": _lines(F.col("_pieces")),
        "_tops": _outer(F.col("_depths")),
        "_found": _segments(F.col("_pieces"), F.col("_tops"), F.col("_lines")),
        "_groups": _group_pieces(F.col("_found")),
        "_measured": F.transform(
            "_groups",
            lambda g: group(
                g["line"].alias("line"), g["pieces"].alias("pieces"), _depths(g["pieces"]).alias("depths"), _lines(g["pieces"]).alias("lines")
            ),
        ),
        "_parts": F.transform(
            "_measured",
            lambda g: group(
                g["line"].alias("line"),
                text.let(_outer(g["depths"]), lambda tops: _segments(g["pieces"], tops, g["lines"])).alias("found"),
            ),
        ),
        "_grouped": F.flatten(F.transform("_parts", lambda g: _structs(g["found"], _GROUPED, _GROUPED_GENERIC, g["line"]))),
        "_types": F.concat(_structs(F.col("_found"), _STRUCT, _GENERIC, F.lit(0)), F.col("_grouped"), _local_structs(F.col("_found"))),
        out: F.concat(_functions(F.col("_found")), F.array_sort("_types")),
    }
    for name, value in steps.items():
        files = files.withColumn(name, value)
    return files.drop(*[name for name in steps if name != out])


def with_methods(
    symbols: Column, type_of: Callable[[Column], Column], receiver_of: Callable[[Column], Column]
) -> Column:
    """The symbols in their order, types with the names of the methods that have them as
    receiver. `type_of` and `receiver_of` give a symbol's name as a type or its receiver,
    '' if it is none.

    Types and methods are sorted by that name; what belongs together is then neighbours."""
    keyed = F.transform(
        symbols,
        lambda s, i: F.struct(
            F.when(type_of(s) != "", type_of(s)).otherwise(receiver_of(s)).alias("key"),
            (type_of(s) == "").alias("is_method"), i.alias("at"), s.alias("symbol"),
        ),
    )

    def grouped(rows: Column) -> Column:
        starts = F.filter(text.indices(F.size(rows)), lambda i: (i == 0) | (F.get(rows, i)["key"] != F.get(rows, i - 1)["key"]))

        def group(bound: Column) -> Column:
            def filled(start: Column, k: Column) -> Column:
                mine = F.slice(rows, start + 1, F.coalesce(F.get(bound, k + 1), F.size(rows)) - start)

                def own(held: Column) -> Column:
                    methods = F.transform(F.filter(held, lambda r: r["is_method"]), lambda r: r["symbol"]["name"])
                    return text.let(
                        methods,
                        lambda names: F.transform(
                            held,
                            lambda r: F.struct(
                                r["at"].alias("at"),
                                F.when(~r["is_method"], r["symbol"].withField("methods", names)).otherwise(r["symbol"]).alias("symbol"),
                            ),
                        ),
                    )

                return text.let(mine, own)

            return F.flatten(F.transform(bound, filled))

        return text.let(starts, group)

    named = F.array_sort(F.filter(keyed, lambda r: r["key"] != ""))
    others = F.transform(F.filter(keyed, lambda r: r["key"] == ""), lambda r: F.struct(r["at"].alias("at"), r["symbol"].alias("symbol")))
    return F.transform(F.array_sort(F.concat(text.let(named, grouped), others)), lambda r: r["symbol"])
