"""Arithmetic checks as Column functions over a map of named inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How far a claimed result may be off.
TOLERANCE, FLOOR = 0.02, 1e-9


def plain(x: float) -> str:
    """The shortest text of a double, in JavaScript's form."""
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    mantissa, _, exponent = repr(float(x)).partition("e")
    if not exponent:
        return mantissa
    e = int(exponent)
    digits = mantissa.replace(".", "").lstrip("-")
    if -7 < e < 0:
        return ("-" if x < 0 else "") + "0." + "0" * (-e - 1) + digits
    return f"{mantissa.removesuffix('.0')}e{'+' if e > 0 else '-'}{abs(e)}"


def significant(x: Column) -> Column:
    """x to 12 significant digits."""
    return F.format_string("%.11e", x.cast("double")).try_cast("double")  # null is printed as text


def kahan_sum(inputs: Column) -> Column:
    """The values' compensated sum in the order of their keys."""
    values = F.transform(F.array_sort(F.map_entries(inputs)), lambda e: e["value"])

    def step(acc: Column, v: Column) -> Column:
        y = v - acc["c"]
        t = acc["s"] + y
        return F.struct(t.alias("s"), ((t - acc["s"]) - y).alias("c"))

    return F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), step)["s"]


def computed(kind: Column, inputs: Column) -> Column:
    """The exact result of a calculation; null where an input is missing or a divisor is 0."""
    v = lambda k: F.try_element_at(inputs, F.lit(k))
    over = lambda a, b: F.when(b != 0, a / b)
    n = F.size(inputs)
    out = (
        F.when(kind == "percent_change", over(v("to") - v("from"), v("from")) * 100)
        .when(kind == "ratio", over(v("numerator"), v("denominator")))
        .when(kind == "market_share", over(v("part"), v("whole")) * 100)
        .when(kind == "average", F.when(n > 0, kahan_sum(inputs) / n))
        .when(kind == "total", F.when(n > 0, kahan_sum(inputs)))
        .when(kind == "unit_conversion", v("value") * v("factor"))
        .when(kind == "date_interval", v("end") - v("start"))
    )
    return F.when(~F.isnan(out) & (F.abs(out) != float("inf")), out)


def approximately(a: Column, b: Column) -> Column:
    """Equal within 2 % of the larger magnitude."""
    return F.abs(a - b) <= F.greatest(F.lit(FLOOR), F.lit(TOLERANCE) * F.greatest(F.abs(a), F.abs(b)))


def matches(kind: Column, result: Column, claimed: Column) -> Column:
    """Whether a claimed result agrees; null if there is nothing to check. A
    claim of no negative change or interval leaves the direction open."""
    undirected = kind.isin("percent_change", "date_interval") & (claimed >= 0)
    return F.when(result.isNotNull() & claimed.isNotNull(), approximately(F.when(undirected, F.abs(result)).otherwise(result), claimed))


# Words of direction.
UP = "increase increased increasing rose rise rising grew grown growth gain gained up".split()
DOWN = "decrease decreased decreasing fell fall falling decline declined drop dropped down reduction reduced".split()


def direction(text: Column) -> Column:
    """increase, decrease or unknown, from the words of a claim."""
    says = lambda words: text.rlike(rf"(?i)(?<![A-Za-z0-9_])({'|'.join(words)})(?![A-Za-z0-9_])")
    return F.when(says(UP) & ~says(DOWN), "increase").when(says(DOWN) & ~says(UP), "decrease").otherwise("unknown")


def numbers(text: Column) -> Column:
    """The numbers of a text, in order: thousands separators, decimals, exponents and signs taken in."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\w.])([+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][+-]?\d+)?)"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))
