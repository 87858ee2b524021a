"""Text as Column functions: normal form, tokens, shingles, quotes, ids, sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. The least length of a quotation, and the form of ids, are our own choice.
LEAST_QUOTE, ID_HEX, ID_SEPARATOR = 20, 16, "|"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f's lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def normalize(s: Column) -> Column:
    """Lower case, apostrophes deleted, everything but letters and digits to single blanks."""
    plain = F.regexp_replace(F.lower(s), "['’]", "")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def tokens(s: Column) -> Column:
    return F.filter(F.split(normalize(s), " "), lambda t: t != "")


def grams(t: Column, k: int) -> Column:
    """All runs of k of an array's words, joined by blanks; none for shorter arrays."""
    none = F.array().cast("array<string>")
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - k + 1), lambda i: F.array_join(F.slice(t, i, F.lit(k)), " "))
    return let(t, lambda t: F.when(F.size(t) >= k, runs(t)).otherwise(none))


def shingles(s: Column, k: int = 3) -> Column:
    """Distinct runs of k tokens; none for shorter texts."""
    return F.array_distinct(grams(tokens(s), k))


def jaccard(a: Column, b: Column) -> Column:
    """0 for two empty sets, so that blank pages don't merge."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def quotes(s: Column) -> Column:
    found = F.regexp_extract_all(s, F.lit("[\"“]([^\"“”]+)[\"”]"), F.lit(1))
    return F.filter(found, lambda q: F.length(q) >= LEAST_QUOTE)


def hash_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws(ID_SEPARATOR, *parts), 256), 1, ID_HEX))


def sentences(s: Column) -> Column:
    """Spans ended by . ? ! and white space, or by line breaks; trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(s, r"(?<=[.?!])\s+|\n+"), lambda x: F.trim(x)), lambda x: x != "")


def numeric_segments(s: Column) -> Column:
    """Segments at . ! ? and ; that aren't inside a number."""
    return F.filter(F.transform(F.split(s, r"(?<!\d)\.|\.(?!\d)|[!?;]"), lambda x: F.trim(x)), lambda x: x != "")


def stem(token: Column) -> Column:
    """A token without its plural ending: ies to y (from 5 letters), s (from 4, but not ss)."""
    return F.when(~token.rlike("[a-z]"), token).when((F.length(token) > 4) & token.endswith("ies"), F.concat(F.regexp_replace(token, "ies$", ""), F.lit("y"))).when((F.length(token) > 3) & token.endswith("s") & ~token.endswith("ss"), F.regexp_replace(token, "s$", "")).otherwise(token)


def contains_words(text: Column, phrase: Column) -> Column:
    """Whether phrase's tokens stand consecutively in text; an empty phrase never does."""
    p = normalize(phrase)
    return (p != "") & F.concat(F.lit(" "), normalize(text), F.lit(" ")).contains(F.concat(F.lit(" "), p, F.lit(" ")))


def polished(excerpt: Column) -> Column:
    """An excerpt as one sentence: blanks single, capitalised, ended by a mark;
    null if it is several sentences, or has ; or :, or nothing but marks."""
    t = F.trim(F.regexp_replace(excerpt, r"\s+", " "))
    parts = F.filter(F.split(t, r"[.!?]+(?:\s+|$)"), lambda x: F.trim(x) != "")
    t = F.regexp_replace(t, ",$", "")
    t = F.when(t.rlike("^[a-z]"), F.concat(F.upper(F.substring(t, 1, 1)), t.substr(F.lit(2), F.length(t)))).otherwise(t)
    ended = F.when(t.rlike(r"""[.!?]["')\]]?$"""), t).otherwise(F.concat(t, F.lit(".")))
    return F.when((F.size(parts) == 1) & ~excerpt.rlike("[;:]"), ended)
