"""Decisions of an inference client as columns: classification, retries, budgets, contracts.

The calls themselves are a plug-in (``folio.plans.interpret``); what is decided about them is data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses worth a retry, and limits of a call.
RETRYABLE = (429, 502, 503, 504)
RETRY_CODES = ("transport-error", "transport-timeout", "response-body-truncated", "http-retryable")
IMAGE_RESERVE, SAFETY_MARGIN, INEXACT_CEILING, RETRY_AFTER_CAP = 2048, 512, 0.85, 60.0


def http_class(status: Column) -> Column:
    return F.when(status == 200, F.lit(None).cast("string")).when(status.isin(*RETRYABLE), "http-retryable").when(status >= 500, "http-server-error").otherwise("http-client-error")


def may_retry(code: Column, attempt: Column, max_attempts: Column, server_errors_before: Column) -> Column:
    """Never after the last attempt; a server error once; transport troubles and retryable statuses always."""
    again = code.isin(*RETRY_CODES) | ((code == "http-server-error") & (server_errors_before < 1))
    return F.coalesce((attempt < max_attempts) & again, F.lit(False))


def backoff_seconds(attempt: Column, base: float = 1.0, retry_after: Column | None = None) -> Column:
    """base * 2 ** (attempt - 1), or what the server asks for, up to a cap."""
    wait = F.lit(base) * F.pow(F.lit(2.0), attempt - 1)
    if retry_after is None:
        return wait
    asked = F.least(F.greatest(retry_after.cast("double"), F.lit(0.0)), F.lit(RETRY_AFTER_CAP))
    return F.when(retry_after.isNotNull(), asked).otherwise(wait)


def required_tokens(input_tokens: Column, image_tokens: Column, output_tokens: Column, margin: Column) -> Column:
    return input_tokens + image_tokens + output_tokens + margin


def budget_error(required: Column, context: Column, exact: Column) -> Column:
    """null if a request fits, else the code."""
    return F.when(required > context, "context-budget-exceeded").when(~exact & (required > context * F.lit(INEXACT_CEILING)), "context-budget-indeterminate")


def static_error(context: Column, output_tokens: Column, margin: Column) -> Column:
    return F.when(context <= output_tokens + margin, "static-context-impossible")


def token_contract(text_status: Column, text_tokens: Column, image_tokens: Column, template_status: Column, plain_on: Column, plain_off: Column) -> Column:
    """Which way of counting a server supports: 404 on counting falls back to template and tokenize, equal
    prompts with and without the switch to an estimate; any other failure stops calibration."""
    counted = F.when(image_tokens > text_tokens, "multimodal-input-tokens").otherwise("text-only-input-tokens")
    template = F.when(template_status == 404, "estimate-only").when(template_status != 200, "token-counting-calibration-failed").when(plain_on == plain_off, "estimate-only").otherwise("apply-template-tokenize")
    return F.when(text_status == 200, counted).when(text_status == 404, template).otherwise("token-counting-calibration-failed")


def attempt_problem(succeeded: Column, attempt: Column, error_code: Column, body_kept: Column) -> Column:
    """Whether an attempt's record contradicts itself."""
    bad = (attempt < 1) | (succeeded & (error_code.isNotNull() | body_kept)) | (~succeeded & error_code.isNull())
    return F.coalesce(bad, F.lit(True))


def attempt_rollup(attempts: DataFrame) -> DataFrame:
    """Per page: attempts, failed ones, total latency (null if none was taken)."""
    return attempts.groupBy("book_id", "page_index").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(~F.col("succeeded")).alias("failed_attempts"),
        F.nullif(F.sum(F.coalesce("elapsed_ms", F.lit(0))), F.lit(0)).alias("elapsed_ms"),
    )


def text_only(messages: Column) -> Column:
    """Content parts without images, in order."""
    return F.filter(messages, lambda p: p["type"] != "image_url")


def content_error(body: Column) -> Column:
    """What is wrong with a completion's body: null, or the code."""
    envelope = F.from_json(body, "STRUCT<choices: ARRAY<STRUCT<finish_reason: STRING, message: STRUCT<content: STRING, reasoning_content: STRING>>>>")
    first = F.get(envelope["choices"], F.lit(0))
    content = first["message"]["content"]
    return (
        F.when(F.json_object_keys(body).isNull(), "invalid-http-response")
        .when(envelope["choices"].isNull(), "invalid-completion-envelope")
        .when(F.size(envelope["choices"]) == 0, "empty-response")
        .when(first["finish_reason"] == "length", "output-token-limit")
        .when(F.coalesce(F.trim(content), F.lit("")) == "", "empty-response")
        .when(F.coalesce(F.trim(first["message"]["reasoning_content"]), F.lit("")) != "", "unexpected-reasoning-content")
        .when(F.json_object_keys(content).isNull(), "invalid-json")
    )


def build_id(build_info: Column, commit: Column, number: Column) -> Column:
    """The first of: trimmed build info, commit, number."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(some(build_info), some(commit), number.cast("string"))


def relocation_error(old_sha: Column, new_sha: Column) -> Column:
    """A moved file is accepted only if both hashes are known and equal."""
    known = F.coalesce((old_sha != "") & (new_sha != ""), F.lit(False))
    return F.when(~known | (old_sha != new_sha), "inference-relocation-rejected")


def probe_outcome(status: Column, attempt: Column, frozen: Column) -> Column:
    """What a counting probe's answer means: counted, unsupported (404), retry (first trouble on the way or
    at the server; null status: no answer), or the code. A contract in force reports drift, discovery fails."""
    transient = status.isNull() | status.isin(*RETRYABLE) | (status >= 500)
    gone = F.when(frozen, "context-budget-probe-unavailable").otherwise("token-counting-calibration-failed")
    other = F.when(frozen, "token-counting-contract-drift").otherwise("token-counting-calibration-failed")
    return F.when(status == 200, "counted").when(transient & (attempt < 2), "retry").when(transient, gone).when((status == 404) & ~frozen, "unsupported").otherwise(other)


def request_summary(model: Column, max_tokens: Column, schema: Column, parts: Column) -> Column:
    """What is logged of a request: no content, but whether it held an image, and the schema's hash."""
    return F.struct(
        F.lit("json_schema").alias("format"), F.exists(parts, lambda p: p["type"] == "image_url").alias("include_image"), max_tokens.alias("max_tokens"), model.alias("model"), F.sha2(schema, 256).alias("schema_sha256")
    )
