"""Text expressions: lines, fields, trimming, capitalisation, numbers, look-ups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def lines(text: Column) -> Column:
    """All lines, trailing empty ones included."""
    return F.split(text, "\n", -1)


def trim_space(text: Column) -> Column:
    """Strip every kind of whitespace on both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def fields(text: Column) -> Column:
    """Whitespace-separated fields; empty text gives one empty field."""
    return F.split(trim_space(text), r"\s+", -1)


def field(text: Column, index: int) -> Column:
    """The zero-based field, null when there are fewer."""
    return F.get(fields(text), F.lit(index))


def trim_suffix(text: Column, suffix: str) -> Column:
    """Remove one literal suffix when it is there."""
    cut = F.substring(text, F.lit(1), F.length(text) - len(suffix))
    return F.when(F.endswith(text, F.lit(suffix)), cut).otherwise(text)


def trim_prefix(text: Column, prefix: str) -> Column:
    """Remove one literal prefix when it is there."""
    cut = F.substring(text, F.lit(len(prefix) + 1), F.length(text))
    return F.when(F.startswith(text, F.lit(prefix)), cut).otherwise(text)


def capitalize(text: Column) -> Column:
    """Upper-case the first character and leave the rest alone."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def number(text: Column) -> Column:
    """DOUBLE of a plain decimal number, null for anything else."""
    return F.when(F.rlike(text, F.lit(NUMBER)), text.try_cast("double"))


def percent(text: Column) -> Column:
    """DOUBLE of a number with an optional percent sign."""
    return number(trim_suffix(text, "%"))


def rfc3339(time: Column) -> Column:
    """Time text of a UTC wall-clock time."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def unix_seconds(time: Column) -> Column:
    """Seconds since 1970 of a UTC wall-clock time, whatever the session's time zone."""
    days = F.datediff(time, F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    """Value of a small fixed table held in the plan as a literal map."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), default)


def fill(template: str, **values: Column) -> Column:
    """Put column values into the {name} places of a template."""
    return reduce(
        lambda text, item: F.replace(text, F.lit("{" + item[0] + "}"), item[1]),
        values.items(),
        F.lit(template),
    )


def unless_zero(value: Column) -> Column:
    """The value, null in place of 0; evaluates the value once."""
    return F.get(F.filter(F.array(value), lambda x: x != 0), F.lit(0))


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indices(n: Column) -> Column:
    """0 to n - 1 as an array, empty if n is 0 or less."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


_BLOCK = 64


def sums_before(values: Column, levels: int = 3) -> Column:
    """For each element of an array of integers the sum of those before it.

    Sums run over blocks, and over blocks of blocks, so an element costs a block's length
    per level at most."""

    def summed(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda total, v: total + v)

    if not levels:
        return F.transform(values, lambda _, i: summed(F.slice(values, F.lit(1), i)))

    def blocks(bound: Column) -> Column:
        many = F.ceil(F.size(bound) / _BLOCK).cast("int")
        return F.transform(indices(many), lambda b: summed(F.slice(bound, b * _BLOCK + 1, F.lit(_BLOCK))))

    def inside(bound: Column, starts: Column) -> Column:
        def before(_: Column, i: Column) -> Column:
            rest = i % _BLOCK
            return F.get(starts, F.floor(i / _BLOCK).cast("int")) + summed(F.slice(bound, i - rest + 1, rest))

        return F.transform(bound, before)

    return let(values, lambda v: let(let(blocks(v), lambda b: sums_before(b, levels - 1)), lambda starts: inside(v, starts)))


def first_parsed(candidates: Column) -> Column:
    """First non-null element of an array."""
    return F.get(F.filter(candidates, lambda x: x.isNotNull()), F.lit(0))


def last_parsed(candidates: Column) -> Column:
    """Last non-null element of an array."""
    return F.get(F.reverse(F.filter(candidates, lambda x: x.isNotNull())), F.lit(0))


def https_url(url: Column) -> Column:
    """Repository address in https form; surrounding space is dropped."""
    return F.regexp_replace(trim_space(url), r"^git@([^:]*):", "https://$1/")


def glob_regex(globs: tuple[str, ...] | list[str]) -> str:
    """One regular expression for a list of globs.

    A glob without a slash is matched against the base name, one with a slash
    against the beginning of the path or of any directory in it.
    """
    special = set(".^$+{}[]()|\\")
    parts = []
    for glob in globs:
        body = "".join(
            "[^/]*" if ch == "*" else "[^/]" if ch == "?" else "\\" + ch if ch in special else ch
            for ch in glob
        )
        if "/" in glob:
            parts.append("(?:^|/)" + body.removesuffix("[^/]*"))
        else:
            parts.append("(?:^|/)" + body + "$")
    return "|".join(parts)
