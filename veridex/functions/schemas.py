"""JSON schemas as a provider takes them: without the keywords that it doesn't know."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The keywords that the provider knows; those whose value maps names of any kind to schemas.
KNOWN = ("$id", "$defs", "$ref", "$anchor", "type", "format", "title", "description", "enum", "items", "prefixItems", "minItems", "maxItems", "minimum", "maximum", "anyOf", "oneOf", "properties", "additionalProperties", "required")
NAMING = ("properties", "$defs")


def _kept(node, naming: bool = False):
    """node without unknown keywords; under `naming` its keys are names, which all stay."""
    if isinstance(node, list):
        return [_kept(x) for x in node]
    if not isinstance(node, dict):
        return node
    return {k: _kept(v, not naming and k in NAMING and isinstance(v, dict)) for k, v in node.items() if naming or k in KNOWN}


def known_keywords(schema: Column) -> Column:
    """Each JSON schema with its known keywords only, at any depth, keys in their order, written without blanks; null if it isn't JSON or nests beyond Python's depth."""

    def each(schemas: pd.Series) -> pd.Series:
        out = []
        for s in schemas:
            try:
                out.append(json.dumps(_kept(json.loads(s)), ensure_ascii=True, separators=(",", ":")))
            except (TypeError, ValueError, RecursionError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(each, "string")(schema)
