"""Preference formatting of chat (operator 4).

A preference pair is two conversations, chosen and rejected. Their longest
common prefix of turns (same role and text, null equal to null) is rendered
once, as the prompt; what follows in each is its completion. A prompt that ends
where a completion starts with an assistant turn gets the assistant's header,
so both completions start with the reply itself. Each completion comes with a
mask: the spans of its characters that are trained on, which are the texts of
assistant turns and their end marks.

Rendering is `<|role|>\\n` + text + `<|end|>\\n` for each turn; marks in a text are
rendered as ordinary text with a zero-width joiner, so they can't end a turn.
Turns go by number, then role, then text, nulls first; equal turns of a
conversation stay. A null role is `unknown`, a null text is empty. A side
without turns, or pairs without any difference, have an empty completion and
an empty mask. All is DataFrame code; a conversation's turns make one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io

# The rendering's marks.
END, JOINER = "<|end|>\n", "‍"


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"))


def body(text: Column) -> Column:
    return F.concat(F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<" + JOINER + "|")), F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t["role"]), body(t["text"]))), "")


def common_turns(a: Column, b: Column) -> Column:
    """The length of the longest common prefix of two arrays of (role, text)."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(i <= n, F.element_at(a, i).eqNullSafe(F.element_at(b, i))).otherwise(False))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, n).otherwise(first - 1).cast("int")


def completion(turns: Column, shared: Column, headed: Column) -> Column:
    """Struct of text and mask (spans of code points) of the turns after the shared ones; headed: the prompt has the first one's header."""
    rest = F.slice(turns, shared + 1, F.greatest(F.size(turns) - shared, F.lit(0)))
    parts = F.transform(rest, lambda t, i: F.struct(F.when(headed & (i == 0), F.lit("")).otherwise(header(t["role"])).alias("head"), body(t["text"]).alias("body"), (t["role"] == "assistant").alias("own")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + F.length(p["head"])
        z = a + F.length(p["body"])
        span = F.array(F.struct(a.cast("bigint").alias("start"), z.cast("bigint").alias("end")))
        return F.struct(z.cast("bigint").alias("at"), F.when(F.coalesce(p["own"], F.lit(False)), F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    return F.struct(F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"])), "").alias("text"), F.aggregate(parts, start, step)["mask"].alias("mask"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs: chosen, rejected (arrays of struct role, text) and other columns,
    which stay. Adds n_common, prompt, chosen_completion, rejected_completion
    (structs of text and mask); columns of those names give way."""
    added = ("n_common", "prompt", "chosen_completion", "rejected_completion")
    src = pairs.drop(*added).withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected")))
    after = lambda c: F.try_element_at(F.col(c), F.col("n_common") + 1)["role"]
    headed = F.coalesce((after("chosen") == "assistant") & (after("rejected") == "assistant"), F.lit(False))
    prompt = F.concat(rendered(F.slice("chosen", F.lit(1), F.col("n_common"))), F.when(headed, header(F.lit("assistant"))).otherwise(F.lit("")))
    return src.withColumns({"prompt": prompt, "chosen_completion": completion(F.col("chosen"), F.col("n_common"), headed), "rejected_completion": completion(F.col("rejected"), F.col("n_common"), headed)})


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) from rows (conv_id, turn, role, text)."""
    t = F.struct("turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(t)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def with_worse_reply(convs: DataFrame) -> DataFrame:
    """Pairs from single conversations: rejected has the last assistant turn's
    text cut to its first half (of code points, rounded down). Conversations
    without an assistant turn are rejected as they are."""
    last = F.aggregate(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)), F.lit(0), lambda acc, v: F.coalesce(v, acc))
    worse = lambda t: F.struct(t["role"].alias("role"), F.substring(t["text"], F.lit(1), F.floor(F.length(t["text"]) / 2).cast("int")).alias("text"))
    return convs.withColumn("_last", last).select("conv_id", F.col("turns").alias("chosen"), F.transform("turns", lambda t, i: F.when(i + 1 == F.col("_last"), worse(t)).otherwise(t)).alias("rejected"))


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = format_pairs(with_worse_reply(conversations(_io.table(spark, sf_dir, "conversations"))))
    spans = lambda c: F.array_join(F.transform(F.col(c)["mask"], lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return p.select(
        "conv_id", F.size("chosen").cast("bigint").alias("n_turns"), F.col("n_common").cast("bigint").alias("n_common"), F.sha2("prompt", 256).alias("prompt_sha256"),
        F.sha2(F.col("chosen_completion")["text"], 256).alias("chosen_sha256"), spans("chosen_completion").alias("chosen_mask"),
        F.sha2(F.col("rejected_completion")["text"], 256).alias("rejected_sha256"), spans("rejected_completion").alias("rejected_mask"),
    )


SQL = """
WITH numbered AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS shown, role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM conversations
), ends AS (
  SELECT conv_id, count(*) AS n_turns, max(n) FILTER (WHERE role = 'assistant') AS last FROM numbered GROUP BY conv_id
), sides AS (
  SELECT d.*, e.n_turns, e.last, s.side,
         CASE WHEN s.side = 'r' AND d.n = e.last THEN substr(d.text, 1, length(d.text) // 2) ELSE d.text END AS said
  FROM numbered d JOIN ends e ON d.conv_id IS NOT DISTINCT FROM e.conv_id CROSS JOIN (VALUES ('c'), ('r')) s(side)
), shared AS (
  SELECT conv_id, coalesce(min(n) FILTER (WHERE side = 'r' AND said <> text) - 1, any_value(n_turns)) AS n_common FROM sides GROUP BY conv_id
), parts AS (
  SELECT s.conv_id, s.side, s.n, s.n_turns, h.n_common, s.role,
         '<|' || s.shown || '|>' || chr(10) AS head, replace(s.said, '<|', '<' || chr(8205) || '|') || '<|end|>' || chr(10) AS body
  FROM sides s JOIN shared h ON s.conv_id IS NOT DISTINCT FROM h.conv_id
), prompts AS (
  SELECT conv_id, any_value(n_turns) AS n_turns, any_value(n_common) AS n_common,
         coalesce(string_agg(head || body, '' ORDER BY n) FILTER (WHERE n <= n_common), '')
         || CASE WHEN any_value(n_common) < any_value(n_turns) THEN '<|assistant|>' || chr(10) ELSE '' END AS prompt
  FROM parts WHERE side = 'c' GROUP BY conv_id
), rest AS (
  SELECT conv_id, side, n, role, body, CASE WHEN n = n_common + 1 THEN '' ELSE head END AS head FROM parts WHERE n > n_common
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, side ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a FROM rest
), done AS (
  SELECT conv_id, side, string_agg(head || body, '' ORDER BY n) AS text,
         coalesce(string_agg(CAST(a AS BIGINT) || '-' || CAST(a + length(body) AS BIGINT), ',' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS mask
  FROM placed GROUP BY conv_id, side
)
SELECT p.conv_id, CAST(p.n_turns AS BIGINT) AS n_turns, CAST(p.n_common AS BIGINT) AS n_common, sha256(p.prompt) AS prompt_sha256,
       sha256(coalesce(c.text, '')) AS chosen_sha256, coalesce(c.mask, '') AS chosen_mask,
       sha256(coalesce(r.text, '')) AS rejected_sha256, coalesce(r.mask, '') AS rejected_mask
FROM prompts p LEFT JOIN done c ON c.side = 'c' AND p.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN done r ON r.side = 'r' AND p.conv_id IS NOT DISTINCT FROM r.conv_id
"""
