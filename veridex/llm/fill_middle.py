"""Fill-in-middle transformation by escaped marker injection (operator 11).

A text is cut into units that a regular expression matches from left to right.
Nothing lists the units: a delimiter that can't occur (it is escaped first) is
appended after each of them, so its count is the number of units,
`substring_index` takes the first k of them, and what follows by length is the
rest. The parts are unescaped and assembled. All of it is built-in SQL
functions in one projection: no shuffle, no Python, and a row needs memory for
a few copies of its own text.

Where the cuts are, whether a row is rearranged and in which form follow from
a hash of its id, so reruns and any partitioning give the same rows.

Null text is empty text; empty text, and text that holds one of the markers,
stays plain. A null id hashes as an empty one. Equal ids cut by the same hash,
each text on its own; repeated rows give equal rows. Columns of the input are
carried by `fill_in_middle`; one named as a result gives way to it. An empty
table gives no rows. Strings are taken to be valid UTF-8.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io

LINES = r"[^\n]*\n|[^\n]+"
#: The delimiter, the escape, and what stand for them in escaped text.
MARK, ESCAPE = "\x01", "\x02"
_MARK_AS, _ESCAPE_AS = ESCAPE + "m", ESCAPE + "e"


@dataclass(frozen=True)
class Form:
    """prefix, suffix, middle: markers. of_100: rows of a hundred that are rearranged; spm_of_100: of those, the ones that begin with the suffix."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    of_100: int = 100
    spm_of_100: int = 50
    seed: int = 7
    unit: str = LINES


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(_ESCAPE_AS)), F.lit(MARK), F.lit(_MARK_AS))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_MARK_AS), F.lit(MARK)), F.lit(_ESCAPE_AS), F.lit(ESCAPE))


def marked(text: Column, unit: str = LINES) -> Column:
    """text, escaped, with the delimiter after each unit."""
    return F.regexp_replace(escaped(text), f"({unit})", f"$1{MARK}")


def count_units(marked_text: Column) -> Column:
    return F.length(marked_text) - F.length(F.replace(marked_text, F.lit(MARK), F.lit("")))


def hashes(doc_id: Column, seed: int, n: int = 4) -> list[Column]:
    """The first n 32-bit numbers of sha256 of `seed:doc_id`."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(n)]


def assembled(form: Column, prefix: Column, middle: Column, suffix: Column, f: Form) -> Column:
    p, s, m = F.lit(f.prefix), F.lit(f.suffix), F.lit(f.middle)
    return F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle))


def restored(output: Column, form: Column, f: Form = Form()) -> Column:
    """The text that `output` was made of. Markers don't occur in the parts, so each ends where the next marker begins."""

    def parts(one: str, two: str, three: str) -> tuple[Column, Column, Column]:
        first = F.substring_index(F.substr(output, F.lit(len(one) + 1)), two, 1)
        rest = F.substr(output, F.lit(len(one) + len(two) + 1) + F.length(first))
        second = F.substring_index(rest, three, 1)
        return first, second, F.substr(rest, F.lit(len(three) + 1) + F.length(second))

    prefix, suffix, middle = parts(f.prefix, f.suffix, f.middle)
    suffix_2, prefix_2, middle_2 = parts(f.suffix, f.prefix, f.middle)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_2, middle_2, suffix_2)).otherwise(output)


def fill_in_middle(docs: DataFrame, f: Form = Form(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs and n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output.

    The prefix ends after min(h1, h2) modulo n + 1 units, the middle after the
    larger; form comes from h3 and h4."""
    results = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [c for c in docs.columns if c not in results]
    names = {c: f"c{k}" for k, c in enumerate(kept)}  # so that names of steps can't clash
    src = docs.select(*[F.col(f"`{c}`").alias(names[c]) for c in kept])
    text, steps = F.coalesce(F.col(names[text_col]).cast("string"), F.lit("")), "s_text s_marked s_h s_n s_form s_lo s_hi s_head s_front s_prefix s_middle s_suffix".split()
    h = F.array(*hashes(F.col(names[id_col]), f.seed))
    holds = F.lit(False)
    for marker in (f.prefix, f.suffix, f.middle):
        holds = holds | F.contains("s_text", F.lit(marker))
    at = lambda k: F.col("s_h")[k] % (F.col("s_n") + 1)
    plain = (F.col("s_text") == "") | holds | (F.col("s_h")[2] % 100 >= f.of_100)
    bare = lambda c: F.replace(F.col(c), F.lit(MARK), F.lit(""))
    out = (
        src.withColumn("s_text", text).withColumn("s_marked", marked(F.col("s_text"), f.unit)).withColumn("s_h", h)
        .withColumn("s_n", count_units(F.col("s_marked")).cast("bigint"))
        .withColumn("s_form", F.when(plain, "plain").when(F.col("s_h")[3] % 100 < f.spm_of_100, "spm").otherwise("psm"))
        .withColumn("s_lo", F.least(at(0), at(1)).cast("int")).withColumn("s_hi", F.greatest(at(0), at(1)).cast("int"))
        # the first s_hi units, and of these the first s_lo, each unit with its delimiter but the last
        .withColumn("s_head", F.expr(f"substring_index(s_marked, '{MARK}', s_hi)")).withColumn("s_front", F.expr(f"substring_index(s_head, '{MARK}', s_lo)"))
        .withColumn("s_prefix", unescaped(bare("s_front")))
        .withColumn("s_middle", unescaped(F.replace(F.substr("s_head", F.length("s_front") + 1), F.lit(MARK), F.lit(""))))
        .withColumn("s_suffix", unescaped(F.replace(F.substr("s_marked", F.length("s_head") + 1), F.lit(MARK), F.lit(""))))
    )
    chars = lambda c: F.when(F.col("s_form") != "plain", F.length(c)).cast("bigint")
    built = F.coalesce(assembled(F.col("s_form"), F.col("s_prefix"), F.col("s_middle"), F.col("s_suffix"), f), F.col("s_text"))
    out = out.select(*names.values(), F.col("s_n").alias("n"), F.col("s_form").alias("form"), chars("s_prefix").alias("prefix_chars"), chars("s_middle").alias("middle_chars"), built.alias("output"))
    return out.toDF(*kept, *results)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _io.table(spark, sf_dir, "documents").select("doc_id", "text")
    out, sha = fill_in_middle(docs), lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM t
),
k AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM u
),
c AS (
  SELECT doc_id, text, n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
    array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
    array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
  FROM k
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
