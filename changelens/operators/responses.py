"""Stored model responses: text, code, tokens and reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.config import JobConfig
from changelens.operators.ordered import carry_forward
from changelens.sources.responses import fenced_code, first_block, parse_response, text_blocks


def response_texts(rows: DataFrame) -> DataFrame:
    """Text of all text blocks, text of the first block and the fenced code."""
    keep = [c for c in rows.columns if c != "body"]
    parsed = rows.select(*keep, parse_response(F.col("body")).alias("response"))
    return parsed.select(
        *keep,
        text_blocks(F.col("response")).alias("answer"),
        first_block(F.col("response")).alias("first_answer"),
    ).withColumn("code", fenced_code(F.col("answer")))


def token_totals(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    usage = parse_response(F.col("body"))["usage"]
    return (
        rows.select(*keys, usage.alias("usage"))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n_responses"),
            F.sum("usage.input_tokens").alias("input_tokens"),
            F.sum("usage.output_tokens").alias("output_tokens"),
        )
    )


def cached_answers(
    requests: DataFrame, answers: DataFrame, config: JobConfig = JobConfig()
) -> DataFrame:
    """For every request the newest earlier answer to the same prompt, if young enough.

    `requests` holds (request_id, ts, prompt), `answers` (request_id, ts,
    prompt, answer), one row per request_id and ts. Both are laid on one time line per
    prompt digest, so a prompt that is asked very often does not multiply rows. The line
    carries ids; the texts of the answers that are used are joined last.
    """
    digest = F.sha2("prompt", 256).alias("digest")
    line = answers.select("request_id", "ts", digest, F.lit(0).alias("side")).unionByName(
        requests.select("request_id", "ts", digest, F.lit(1).alias("side"))
    )
    known = F.when(F.col("side") == 0, F.struct("ts", "request_id"))
    found = carry_forward(
        line, ["digest"], ["ts", "side", "request_id"], known, "hit"
    ).where(F.col("side") == 1)
    young = F.coalesce(
        F.col("hit.ts") >= F.col("ts") - F.expr(f"INTERVAL '{config.cache_hours}' HOUR"), F.lit(False)
    )
    asked = found.select(
        "request_id", "ts", young.alias("is_hit"),
        F.when(young, F.col("hit.request_id")).alias("answer_id"), F.when(young, F.col("hit.ts")).alias("answer_ts"),
    )
    texts = answers.select(F.col("request_id").alias("answer_id"), F.col("ts").alias("answer_ts"), "answer")
    return asked.join(texts, ["answer_id", "answer_ts"], "left").select("request_id", "ts", "is_hit", "answer")
