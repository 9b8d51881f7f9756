"""Stored model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCED = r"(?m)^[ \t]*```[^\n]*\n((?s:.*?))(?:\n?^[ \t]*```[ \t]*$|\n?\z)"

RESPONSE_SCHEMA = (
    "id STRING, type STRING, role STRING, model STRING, "
    "content ARRAY<STRUCT<type: STRING, text: STRING>>, "
    "usage STRUCT<input_tokens: BIGINT, output_tokens: BIGINT>"
)


def parse_response(body: Column) -> Column:
    return F.from_json(body, RESPONSE_SCHEMA)


def text_blocks(response: Column) -> Column:
    """Text of all blocks of type text, one after the other."""
    kept = F.filter(response["content"], lambda block: block["type"] == "text")
    return F.coalesce(F.array_join(F.transform(kept, lambda block: block["text"]), ""), F.lit(""))


def first_block(response: Column) -> Column:
    """Text of the first block, whatever its type."""
    return F.coalesce(F.get(response["content"], F.lit(0))["text"], F.lit(""))


def fenced_code(answer: Column) -> Column:
    """The fenced code of an answer without its fences, blocks joined by a newline.

    A fence begins a line, indented or not, and ends at the next line that is only a
    fence; an answer that was cut off inside a block keeps what it has of it.
    """
    return F.array_join(F.regexp_extract_all(answer, F.lit(FENCED), F.lit(1)), "\n")
