"""Answers of hosted models as tables: text and tokens of a reply, classes of errors. No request is made here."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_PARTS = "array<struct<text: string, thought: boolean>>"
_BLOCKS = "array<struct<type: string, text: string>>"


def _tokens(body: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(body, path).try_cast("bigint"), F.lit(0))


def parsed(form: Column, body: Column) -> Column:
    """struct<text, model, input_tokens, output_tokens, finish_reason, error, retryable> of a reply with status 200.

    form: 'gemini', 'anthropic', anything else is the chat completions format. Thoughts are not text. A reply without
    an answer has an error.
    """
    at = lambda path: F.get_json_object(body, path)
    joined = lambda texts: F.coalesce(F.array_join(texts, ""), F.lit(""))
    parts = F.filter(F.from_json(at("$.candidates[0].content.parts"), _PARTS), lambda p: ~F.coalesce(p["thought"], F.lit(False)))
    blocks = F.filter(F.from_json(at("$.content"), _BLOCKS), lambda b: b["type"] == "text")
    blocked, failed = at("$.promptFeedback.blockReason"), at("$.error")
    nothing = F.lit(None).cast("string")

    def answer(text: Column, model: Column, given: Column, made: Column, finish: Column, error: Column, retryable: Column) -> Column:
        kept = F.when(error.isNull(), text)
        return F.struct(kept.alias("text"), model.alias("model"), given.alias("input_tokens"), made.alias("output_tokens"), finish.alias("finish_reason"), error.alias("error"), F.when(error.isNotNull(), retryable).alias("retryable"))

    gemini = answer(
        joined(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit("")))),
        nothing,
        _tokens(body, "$.usageMetadata.promptTokenCount"),
        _tokens(body, "$.usageMetadata.candidatesTokenCount"),
        at("$.candidates[0].finishReason"),
        F.when(blocked.isNotNull(), F.concat(F.lit("blocked: "), blocked)).when(at("$.candidates[0]").isNull(), "no candidates"),
        blocked.isNull(),
    )
    anthropic = answer(joined(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit("")))), at("$.model"), _tokens(body, "$.usage.input_tokens"), _tokens(body, "$.usage.output_tokens"), at("$.stop_reason"), nothing, F.lit(True))
    chat = answer(
        F.coalesce(at("$.choices[0].message.content"), F.lit("")),
        at("$.model"),
        _tokens(body, "$.usage.prompt_tokens"),
        _tokens(body, "$.usage.completion_tokens"),
        at("$.choices[0].finish_reason"),
        F.when(failed.isNotNull() & (failed != ""), F.concat(F.lit("error: "), failed)).when(at("$.choices[0]").isNull(), "no choices"),
        F.lit(True),
    )
    return F.when(form == "gemini", gemini).when(form == "anthropic", anthropic).otherwise(chat)


def error_class(status: Column, body: Column, retry_after: Column) -> Column:
    """struct<retryable, message, retry_after, hint> of an error reply. retry_after: the header as it stands."""
    said = F.coalesce(F.nullif(F.get_json_object(body, "$.error.message"), F.lit("")), F.when(~F.coalesce(F.get_json_object(body, "$.error"), F.lit("")).startswith("{"), F.nullif(F.get_json_object(body, "$.error"), F.lit(""))), F.left(body, F.lit(400)))
    low = F.lower(said)
    place = low.contains("location") | low.contains("region") | low.contains("country")
    hint = (
        F.when(status.isin(401, 403) & place, "not offered at this location: try another provider")
        .when(status.isin(401, 403), "check the key")
        .when(status == 404, "check the name of the model")
        .when(status == 429, "lower the requests per minute, or wait")
    )
    return F.struct(((status == 429) | (status >= 500)).alias("retryable"), said.alias("message"), retry_after.try_cast("double").alias("retry_after"), hint.alias("hint"))
