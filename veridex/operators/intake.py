"""Requests for audits as raw bodies: each is either an audit to create or is kept with its status and what is wrong."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .research import LIMITS

# What JavaScript takes for blanks; the fields of a request; limits and answers of the two endpoints.
BLANK = "^[\\t\\n\\u000B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]*$"
FIELDS = ("document", "mode")
GUEST, LIVE = "guest", "live"


@dataclass(frozen=True)
class Endpoint:
    most_body: int
    too_large: str
    modes: tuple[str, ...]
    wrong_mode: str
    accepted: int
    default_mode: str | None = None
    most_document: int | None = None


SERVICE = Endpoint(200_000, "request body exceeds 200000 bytes", tuple(LIMITS), "mode must be quick, deep, or high_stakes; this endpoint is live only", 202)
PUBLIC = Endpoint(13_000, "request body is too large", ("quick",), "public Live audits support quick mode only", 200, "quick", 12_000)

#: kind: invalid, other (JSON, but no object) or object; for objects the first field that isn't known, and whether mode is there.
PARSED = "kind string, unsupported string, document string, mode string, has_mode boolean"


def _refuse(constant: str):
    raise ValueError(f"{constant} isn't JSON")


def _text(value) -> str | None:
    """A JSON string with unpaired surrogates replaced; None for anything else."""
    return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if isinstance(value, str) else None


def _parsed(body: str | None):
    try:
        value = json.loads(body or "", parse_constant=_refuse)
    except (ValueError, RecursionError):
        return "invalid", None, None, None, False
    if not isinstance(value, dict):
        return "other", None, None, None, False
    return "object", next((_text(k) for k in value if k not in FIELDS), None), _text(value.get("document")), _text(value.get("mode")), "mode" in value


def parsed(body: Column) -> Column:
    """PARSED of each body; JSON as its grammar has it: nothing after the value, no NaN, the last of repeated fields."""

    def each(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_parsed(b) for b in bodies], columns=[c.split(" ")[0] for c in PARSED.split(", ")])

    return F.pandas_udf(each, PARSED)(body)


def judged(requests: DataFrame, endpoint: Endpoint = SERVICE) -> DataFrame:
    """requests (body, content_type, declared_bytes and any others) without these three, with status, error, document and mode.

    The first rule that a request breaks, in order: media type, declared and real size, JSON, an object, known fields, a document that
    isn't blank, its size, a mode. document and mode are null where error isn't. No row is dropped: a null body is an empty one, a null type
    a wrong one, a null length none. Bodies over the limit aren't parsed."""
    media = F.lower(F.trim(F.substring_index("content_type", ";", 1)))
    too_large = (F.coalesce(F.col("declared_bytes"), F.lit(0)) > endpoint.most_body) | (F.coalesce(F.octet_length("body"), F.lit(0)) > endpoint.most_body)
    p = F.col("_parsed")
    blank = p["document"].isNull() | p["document"].rlike(BLANK)
    mode = F.when(~p["has_mode"] & F.lit(endpoint.default_mode is not None), endpoint.default_mode).otherwise(p["mode"])
    rules = [
        (~F.coalesce(media == "application/json", F.lit(False)), 415, F.lit("content-type must be application/json")),
        (too_large, 413, F.lit(endpoint.too_large)),
        (F.lit(endpoint.most_document is None) & (F.coalesce(F.octet_length("body"), F.lit(0)) == 0), 400, F.lit("request body must contain JSON")),
        (p["kind"] == "invalid", 400, F.lit("request body contains invalid JSON")),
        (p["kind"] == "other", 400, F.lit("request body must be a JSON object")),
        (p["unsupported"].isNotNull(), 400, F.concat(F.lit("unsupported field: "), p["unsupported"])),
        (blank, 400, F.lit("document must be a non-empty string")),
    ]
    if endpoint.most_document is not None:
        rules.append((F.octet_length(p["document"]) > endpoint.most_document, 413, F.lit(f"document exceeds {endpoint.most_document} bytes")))
    rules.append((~F.coalesce(mode.isin(*endpoint.modes), F.lit(False)), 400, F.lit(endpoint.wrong_mode)))
    out = requests.withColumn("_parsed", parsed(F.when(~too_large, F.col("body"))))
    found = F.coalesce(*[F.when(when, F.struct(F.lit(status).alias("status"), why.alias("error"))) for when, status, why in rules])
    out = out.withColumn("_found", found)
    fine = F.col("_found").isNull()
    return out.select(
        *[c for c in requests.columns if c not in ("body", "content_type", "declared_bytes")], F.coalesce("_found.status", F.lit(endpoint.accepted)).alias("status"), F.col("_found.error").alias("error"),
        F.when(fine, p["document"]).alias("document"), F.when(fine, mode).alias("mode"),
    )


def requests(spark: SparkSession, path: str) -> DataFrame:
    """Files of one JSON body a line as requests, each with its file; bad lines too, for judged() to name."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"), F.lit("application/json").alias("content_type"), F.lit(None).cast("bigint").alias("declared_bytes"))


def visible(audits: DataFrame) -> DataFrame:
    """Audits that the guests' endpoint shows: live ones of the guests' workspace."""
    return audits.where((F.col("mode") == LIVE) & (F.col("workspace_id") == GUEST))


def of_mode(value: Column, mode: str) -> Column:
    """value of mode, or an error: demo and live audits don't run in each other's place; null counts as the mode asked for."""
    return F.when(value.isNull() | (value == mode), F.lit(mode)).otherwise(F.raise_error(F.concat(F.lit(f"only {mode} audits run here, not "), value)))
