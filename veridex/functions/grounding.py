"""Whether a numeric relation is really said: quantities in text, the roles they play, and their units.

A relation has a kind, named inputs and a claimed result. Each kind has its own
way of being said: `from x to y`, two neighbours around a separator, an average
or total of several, or a product. `mentions` finds all of these in a sentence;
`said` asks whether one of them has the relation's numbers, in their roles, and
units that agree. All of it works on one text, so it runs over Arrow batches
and is aggregated afterwards (operators/numeric.py).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

from . import numeric as N

# Blanks, any character of a line, and numbers, as ECMAScript has them.
WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
ANY = r"[^\n\r\u2028\u2029]"
_BLANKS = "".join(c for c in map(chr, range(0x10000)) if re.match(WS, c, re.A))


def _rx(pattern: str, case: bool = False) -> re.Pattern[str]:
    return re.compile(pattern.replace("~s", WS).replace("~.", ANY), re.A if case else re.A | re.I)


NUMBER = _rx(r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:e[-+]?\d+)?")

# Inputs of each kind of relation; None: all of them, by name.
INPUTS = {"percent_change": ("from", "to"), "ratio": ("numerator", "denominator"), "market_share": ("part", "whole"), "unit_conversion": ("value", "factor"), "date_interval": ("start", "end"), "average": None, "total": None, "none": ()}
# Words that say a relation of this kind is meant.
CUES = {
    "percent_change": _rx(r"%|\b(percent|percentage|increase|increased|rose|rise|grew|growth|decrease|decreased|fell|fall|decline|declined|drop|dropped|change|changed)\b"),
    "ratio": _rx(r"\bratio\b|[:/]|\bout of\b"),
    "market_share": _rx(r"%|\b(percent|percentage|share|portion|market)\b"),
    "average": _rx(r"\b(average|mean)\b"),
    "total": _rx(r"\b(total|sum|combined|altogether|in all)\b|\+"),
    "unit_conversion": _rx(r"\b(convert|converted|conversion|equivalent|equals|equal to|factor)\b|="),
    "date_interval": _rx(r"\b(year|years|month|months|week|weeks|day|days|date|duration|elapsed|interval)\b"),
}
# Scales, currencies and units, in the order in which they are tried.
SCALES = {"thousand": 1e3, "k": 1e3, "million": 1e6, "m": 1e6, "billion": 1e9, "b": 1e9, "trillion": 1e12, "t": 1e12}
SYMBOLS = {"$": "usd", "€": "eur", "£": "gbp", "¥": "jpy"}
CURRENCY_WORDS = (("usd|dollars?", "usd"), ("eur|euros?", "eur"), (r"gbp|pounds?~s+sterling", "gbp"), ("jpy|yen", "jpy"), ("cad", "cad"), ("aud", "aud"), ("cny|yuan", "cny"), ("inr|rupees?", "inr"))
UNITS = (
    ("mass", "kg", "kilograms?|kg"), ("mass", "mg", "milligrams?|mg"), ("mass", "g", "grams?|g"), ("mass", "lb", "pounds?|lbs?"), ("mass", "oz", "ounces?|oz"),
    ("length", "km", "kilomet(?:er|re)s?|km"), ("length", "cm", "centimet(?:er|re)s?|cm"), ("length", "mm", "millimet(?:er|re)s?|mm"), ("length", "m", "met(?:er|re)s?|m"),
    ("length", "mile", "miles?|mi"), ("length", "foot", "feet|foot|ft"), ("length", "inch", "inches?|in"), ("length", "yard", "yards?|yd"),
    ("volume", "l", "lit(?:er|re)s?|l"), ("volume", "ml", "millilit(?:er|re)s?|ml"),
    ("time", "time", "years?|months?|weeks?|days?|hours?|minutes?|seconds?|ms"), ("percentage", "percent", "%|percent(?:age)?"),
)
NO_UNITS = frozenset("a an and as at by decrease decreased equals equal fell from increase increased is of or out over percent percentage rose the to was were".split())

_CODE = _rx(r"\b(USD|EUR|GBP|JPY|CAD|AUD|CNY|INR)~s*$")
_SYMBOL = _rx(r"([$€£¥])~s*$")
_SCALE_WORD = _rx(r"~s*(thousand|million|billion|trillion)\b")
_SCALE_CAPITAL, _SCALE_LETTER = _rx(r"~s*([KMBT])\b", case=True), _rx(r"~s*([kmbt])\b")
_SUFFIXES = tuple((_rx(rf"~s*(?:{words})\b"), ("currency", unit)) for words, unit in CURRENCY_WORDS) + tuple((_rx(rf"~s*(?:{words})\b"), (kind, unit)) for kind, unit, words in UNITS)
_NOUN = _rx(r"~s*([A-Za-z][A-Za-z-]*)\b")
Unit = tuple[str, str, float]


class Quantity(NamedTuple):
    """A number of a text, with its place."""

    value: float
    start: int
    end: int
    text: str

    def before(self, n: int) -> str:
        return self.text[max(0, self.start - n) : self.start]

    def after(self, n: int) -> str:
        return self.text[self.end : self.end + n]

    @property
    def unit(self) -> Unit | None:
        """(dimension, unit, scale) of the words around the number; None if there are none."""
        ahead, follows = self.before(24), self.after(48)
        if m := _SYMBOL.search(ahead):
            money = SYMBOLS[m[1]]
        else:
            money = m[1].lower() if (m := _CODE.search(ahead)) else None
        m = _SCALE_WORD.match(follows) or _SCALE_CAPITAL.match(follows) or (money and _SCALE_LETTER.match(follows))
        scale = SCALES[m[1].lower()] if m else 1.0
        if money:
            return "currency", money, scale
        rest = follows[m.end() :] if m else follows
        for pattern, (dimension, unit) in _SUFFIXES:
            if pattern.match(rest):
                return dimension, unit, scale
        if (m := _NOUN.match(rest)) and (noun := singular(m[1])) not in NO_UNITS:
            return "count", noun, scale
        return ("scaled_quantity", "quantity", scale) if scale != 1 else None


def singular(noun: str) -> str:
    low = noun.lower()
    if low == "people":
        return "person"
    if len(low) > 4 and low.endswith("ies"):
        return low[:-3] + "y"
    return low[:-1] if len(low) > 3 and low.endswith("s") and not low.endswith("ss") else low


def quantities(text: str) -> list[Quantity]:
    found = (Quantity(float(m[0].replace(",", "")), m.start(), m.end(), text) for m in NUMBER.finditer(text))
    return [q for q in found if math.isfinite(q.value)]


_STOP = re.compile(r"(?<![0-9])\.|\.(?![0-9])|[!?;]")


def sentences(text: str) -> list[str]:
    """Segments at . ! ? and ; that don't stand inside a number."""
    return [x for x in (part.strip(_BLANKS) for part in _STOP.split(text)) if x]


class Mention(NamedTuple):
    """Operands of a relation, in order, and numbers of which one may be its result."""

    operands: list[Quantity]
    results: list[Quantity]


_FROM_TO = _rx(r"\bfrom\b(~.{0,80}?)\bto\b(~.{0,80})")
_BETWEEN = {"ratio": _rx(r"[:/]|\bto\b|\bout of\b"), "market_share": _rx(r"[/]|\bout of\b|\bof\b")}
_LISTED = {kind: (_rx(rf"\b(?:{words})~s+of\b(~.{{1,120}}?)\b(?:is|was|equals?)\b(~.{{0,40}})"), _rx(rf"\b(?:{words})~s+of\b([^=]{{1,120}})=(~.{{0,40}})")) for kind, words in (("average", "average|mean"), ("total", "total|sum"))}
_SUM = _rx(r"(~.{1,120})=(~.{0,40})")
_EQUALS, _TIMES = _rx(r"=|\bequals?\b"), _rx(r"\*|×|\bmultiplied~s+by\b")


def mentions(kind: str, sentence: str) -> Iterator[Mention]:
    """Every place of a sentence that is built as relations of this kind are."""
    if kind in ("percent_change", "date_interval"):
        for m in _FROM_TO.finditer(sentence):
            left, right = quantities(m[1]), quantities(m[2])
            if left and right:
                yield Mention([left[-1], right[0]], [])
    elif kind in _BETWEEN:
        every = quantities(sentence)
        for a, b in zip(every, every[1:], strict=False):
            if _BETWEEN[kind].search(sentence[a.end : b.start]):
                yield Mention([a, b], [])
    elif kind in _LISTED:
        for pattern in _LISTED[kind]:
            for m in pattern.finditer(sentence):
                yield Mention(quantities(m[1]), quantities(m[2]))
        if kind == "total":
            for m in _SUM.finditer(sentence):
                if "+" in m[1]:
                    yield Mention(quantities(m[1]), quantities(m[2]))
    elif kind == "unit_conversion":
        for m in _EQUALS.finditer(sentence):
            factors, product = quantities(sentence[: m.start()]), quantities(sentence[m.end() :])
            linked = len(factors) - 1
            while linked > 0 and _TIMES.search(sentence[factors[linked - 1].end : factors[linked].start]):
                linked -= 1
            yield Mention(factors[max(linked, 0) :], product[:1])


def _is(kind: str, m: Mention, inputs: dict[str, float], claimed: float | None) -> bool:
    """Whether a mention has the relation's numbers in their roles."""
    values, names = [q.value for q in m.operands], INPUTS[kind]
    if kind in _LISTED:
        return sorted(values) == sorted(inputs.values()) and any(q.value == claimed for q in m.results)
    if kind == "unit_conversion":
        return len(values) == 2 and sorted(values) == sorted(inputs[k] for k in names) and [q.value for q in m.results] == [claimed]
    return values == [inputs[k] for k in names]


def _agree(m: Mention, claimed: float | None) -> bool:
    """Whether operands, and the claimed result if it is among the results, have one unit and scale."""
    units = [q.unit for q in m.operands] + [q.unit for q in m.results if q.value == claimed][:1]
    return all(u == units[0] for u in units)


def said(kind: str, inputs: dict[str, float], claimed: float | None, text: str) -> tuple[bool, bool]:
    """(roles, units): whether the text says the relation, and with units that agree."""
    names = INPUTS[kind]
    if names == () or (names and any(inputs.get(k) is None for k in names)) or (claimed is None and (kind in _LISTED or kind == "unit_conversion")):
        return kind == "none", kind == "none"
    hits = [[m for m in mentions(kind, s) if _is(kind, m, inputs, claimed)] for s in sentences(text)]
    hits = [x for x in hits if x]
    if kind == "date_interval":
        return bool(hits) and dated(text, inputs["start"], inputs["end"]), True
    if not hits or kind == "unit_conversion":
        return bool(hits), bool(hits)
    if kind == "percent_change":
        return True, _agree(hits[0][0], None)
    if kind in _BETWEEN:
        return True, any(_agree(x[0], None) for x in hits)
    return True, any(_agree(m, claimed) for x in hits for m in x)


_TIME_AHEAD, _TIME_AFTER = _rx(r"\b(?:year|month|week|day)s?~s*$"), _rx(r"~s*(?:year|month|week|day)s?\b")
# Marks of a quantity that can't be a date.
_MEASURE_AHEAD = _rx(r"(?:[$€£¥]|(?:usd|eur|gbp|jpy|cad|aud|cny|inr)~s*)$")
_MEASURE_AFTER = _rx(
    r"~s*(?:%|[$€£¥]|(?:usd|eur|gbp|jpy|cad|aud|cny|inr|dollars?|euros?|pounds?|yen|yuan|rupees?|thousand|million|billion|trillion|[kmbt]|mm|cm|km|meters?|metres?|inches?|feet|foot|yards?|miles?|mg|kg|grams?|lbs?|ounces?"
    r"|liters?|litres?|ml|gallons?|mph|kph|watts?|kw|mw|gw|volts?|units?)\b)"
)


def dated(text: str, start: float, end: float) -> bool:
    """Whether two numbers of a text can be dates: years of four digits, or numbers beside words of time; no measures."""
    own = [q for q in quantities(text) if q.value in (start, end)]
    if any(_MEASURE_AHEAD.search(q.before(24)) or _MEASURE_AFTER.match(q.after(24)) for q in own):
        return False
    timed = {q.value for q in own if _TIME_AHEAD.search(q.before(16)) or _TIME_AFTER.match(q.after(16))}
    return all(x == int(x) and 1000 <= x <= 9999 for x in (start, end)) or {start, end} <= timed


_RESULT_AFTER = {k: _rx(r"~s*(?:%|percent(?:age)?\b)") for k in ("percent_change", "market_share")} | {"date_interval": _rx(r"~s*-?~s*(?:year|month|week|day)s?\b")}
_RESULT_AHEAD = _rx(r"(?:\bis\b|\bwas\b|\bequals?\b|=)~s*$")


def asserted(kind: str, claimed: float | None, text: str) -> bool:
    """Whether a claim gives the number as the relation's result: by what follows or precedes it."""
    own = [q for q in quantities(text) if q.value == claimed]
    if claimed is None or kind not in (*_RESULT_AFTER, "ratio"):
        return True
    if kind == "ratio":
        return any(_RESULT_AHEAD.search(q.before(32)) for q in own)
    return any(_RESULT_AFTER[kind].match(q.after(32)) for q in own)


def used(kind: str, inputs: dict[str, float]) -> list[str]:
    names = INPUTS.get(kind, ())
    return sorted(inputs, key=lambda k: k.encode("utf-16-be")) if names is None else list(names)


def rounded(x: float) -> float:
    return float(f"{x:.11e}")


def shown(x: float) -> str:
    """A number as ECMAScript prints it, fractions to 12 digits."""
    return N.plain(x if x == int(x) else rounded(x))


# How a calculation is written.
_WRITTEN = {"percent_change": "({1} - {0}) / {0} * 100", "ratio": "{0} / {1}", "market_share": "{0} / {1} * 100", "unit_conversion": "{0} * {1}", "date_interval": "{1} - {0}"}


def compute(kind: str, inputs: dict[str, float]) -> tuple[float | None, str]:
    """(exact result, how it was got), or (None, '') if an input is missing or the result isn't finite."""
    names = used(kind, inputs)
    values = [inputs.get(k) for k in names]
    if not values or any(v is None or not math.isfinite(v) for v in values):
        return None, ""
    if INPUTS[kind] is None:
        total = lost = 0.0
        for v in values:  # compensated
            step = v - lost
            new = total + step
            lost, total = new - total - step, new
        exact = total / len(values) if kind == "average" else total
        listed = " + ".join(map(shown, values))
        how = f"({listed}) / {len(values)}" if kind == "average" else listed
    else:
        a, b = values
        try:
            exact = {"percent_change": lambda: (b - a) / a * 100, "ratio": lambda: a / b, "market_share": lambda: a / b * 100, "unit_conversion": lambda: a * b, "date_interval": lambda: b - a}[kind]()
        except ZeroDivisionError:
            return None, ""
        how = _WRITTEN[kind].format(shown(a), shown(b))
    return (exact, f"{how} = {shown(rounded(exact))}") if math.isfinite(exact) else (None, "")
