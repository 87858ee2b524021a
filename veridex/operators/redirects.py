"""Redirects followed over a relation of responses, and what may be read at their end."""

from __future__ import annotations

from functools import reduce
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from .graph import kept


def resolved(base: Column, location: Column) -> Column:
    """location as seen from base, without a fragment; null where it has no form of a URL."""

    def each(b: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(b, at, strict=True):
            try:
                out.append(None if x is None or y is None else urljoin(x, y).partition("#")[0])
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    whole = location.rlike(r"(?i)^https?://[a-z0-9.-]+(:\d+)?([/?][^#\s]*)?$") & ~location.contains("/.")
    return F.when(whole, location).otherwise(F.pandas_udf(each, "string")(base, location))


def followed(requests: DataFrame, responses: DataFrame, most: int = U.MOST_REDIRECTS) -> DataFrame:
    """(url, final_url, hops, error) of each url of requests, once. responses: (url, status, location, content_type, n_bytes), one a url.

    All urls go a step together; a step joins only those that are still being sent on, and there are `most` + 1 steps at most. error is
    null where the end is a page that may be read: the chain ends, no url comes twice, each is safe, and type and size are allowed.
    """
    start = requests.select("url").distinct()
    front = start.select("url", F.col("url").alias("at"), F.array("url").alias("path"), U.unsafe_reason(F.col("url")).alias("error"))
    ended = [front.where("error is not null").select("url", "at", F.lit(0).alias("hops"), "error")]
    front = front.where("error is null").drop("error")
    answers = responses.select(F.col("url").alias("at"), "status", "location", "content_type", "n_bytes")
    for hop in range(most + 1):
        got = front.join(answers, "at", "left")
        sent_on = F.coalesce(F.col("status").between(300, 399) & (F.col("location") != ""), F.lit(False))
        there = got.where(~sent_on)
        problem = F.when(F.col("status").isNull(), "no response").otherwise(U.fetch_problem(F.col("content_type"), F.col("n_bytes"), F.lit(hop), F.lit(False)))
        ended.append(there.select("url", "at", F.lit(hop).alias("hops"), problem.alias("error")))
        sent = got.where(sent_on).withColumn("next", resolved(F.col("at"), F.col("location")))
        error = (
            F.when(F.lit(hop >= most), "too many redirects").when(F.col("next").isNull(), "invalid redirect location")
            .when(U.unsafe_reason(F.col("next")).isNotNull(), U.unsafe_reason(F.col("next"))).when(F.array_contains("path", F.col("next")), "redirect loop")
        )
        sent = kept(sent.withColumn("error", error).select("url", "at", "next", "path", "error"))
        ended.append(sent.where("error is not null").select("url", "at", F.lit(hop).alias("hops"), "error"))
        front = sent.where("error is null").select("url", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"))
        if not front.limit(1).count():
            break
    return reduce(DataFrame.unionByName, ended).select("url", F.col("at").alias("final_url"), "hops", "error")
