"""Model-backed steps: a provider answers structured requests, row by row, over Arrow batches.

A provider is any picklable callable of (purpose, inputs) that returns a dict
or raises; inputs are a dict of strings. `ask` never fails a job: an answer that
raises, or lacks a field, leaves null fields and an `error`, so one claim's
failure stays its own (`isolated`). Answers are coerced to the purpose's
fields; values outside a closed list count as errors.

`TextDerived` needs no model: it reads claims and pages word by word, and serves
evaluation and tests. A provider that calls a service is the user's own.
"""

from __future__ import annotations

import re
import time
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grounding as G

Provider = Callable[[str, dict[str, str]], dict]

# The fields of each purpose's answer, and what closed fields may say.
FIELDS = {
    "research_plan": "supporting_queries array<string>, skeptic_queries array<string>",
    "investigator_assess": "relevant boolean, supports boolean, excerpt string, relevance string, reasoning string",
    "investigator_revise": "queries array<string>",
    "skeptic_assess": "relevant boolean, stance string, excerpt string, relevance string, reasoning string",
    "skeptic_revise": "queries array<string>",
    "source_quality": "source_type string, directness string, independence string, methodology_visible boolean, promotional boolean, strengths array<string>, weaknesses array<string>",
    "citation_assessment": "relation string, explanation string, same_entity boolean, same_metric boolean, same_period boolean, same_population boolean, claim_stronger_than_source boolean, qualifiers_omitted boolean",
    "numeric_extract": "kind string, inputs map<string,double>, claimed_result double, explanation string",
    "conflict_analysis": "cause string, reconciled boolean, explanation string",
    "claim_dependencies": "dependencies array<struct<source:string,target:string,kind:string>>",
    "revision": "replacement string, citations array<string>",
}
CLOSED = {
    "relevance": ("strong", "weak"), "stance": ("contradicts", "qualifies", "none"), "directness": ("direct", "indirect", "contextual"), "independence": ("independent", "derived", "unknown"),
    "source_type": ("primary", "press_release", "news", "blog", "encyclopedia", "academic", "gov", "unknown"),
    "relation": ("direct_support", "partial_support", "qualification", "direct_contradiction", "context_only", "irrelevant"), "kind": tuple(G.INPUTS),
    "cause": ("different_period", "different_definition", "different_population", "different_region", "preliminary_vs_final", "global_vs_segment", "correction", "superseding", "different_methodology", "genuine_dispute", "none"),
}
#: Fields that may be null.
OPTIONAL = ("claimed_result", "methodology_visible")
_FINAL = re.compile(r"blocked|private address|loopback|metadata|unsupported (?:scheme|protocol|content type)|credentials|response too large|redirect loop|too many redirects|no scripted response|no fixture", re.I)


class InvalidAnswer(ValueError):
    """An answer that isn't of its purpose's form; asking again wouldn't help."""


def retryable(error: Exception) -> bool:
    """Whether a failed call may be tried again: not if it timed out, its answer has the wrong form, or its target is refused."""
    return not isinstance(error, InvalidAnswer | TimeoutError) and not _FINAL.search(str(error))


def checked(purpose: str, answer: dict) -> dict:
    """The answer's fields, all there and within their lists."""
    out = {}
    for field in FIELDS[purpose].split(", "):
        name = field.split(" ")[0]
        value = answer.get(name)
        if value is None and name not in OPTIONAL:
            raise InvalidAnswer(f"{purpose}: {name} is missing")
        if name in CLOSED and value not in CLOSED[name]:
            raise InvalidAnswer(f"{purpose}: {value!r} is no {name}")
        out[name] = value
    return out


def attempted(provider: Provider, purpose: str, inputs: dict[str, str], most_attempts: int = 2, pause: float = 0.0) -> tuple[dict | None, str | None, int]:
    """(answer, error, attempts) of a request, tried again while that may help."""
    for attempt in range(1, most_attempts + 1):
        try:
            return checked(purpose, provider(purpose, inputs)), None, attempt
        except Exception as error:
            if attempt == most_attempts or not retryable(error):
                return None, str(error).strip() or "the call failed without an error message", attempt
            time.sleep(pause)
    raise AssertionError


def ask(rows: DataFrame, purpose: str, provider: Provider, inputs: dict[str, Column], most_attempts: int = 2) -> DataFrame:
    """rows with `answer` (FIELDS of the purpose; null fields where the call failed), `error` and `attempts`. inputs: strings by name; null is ''."""
    names = [f.split(" ")[0] for f in FIELDS[purpose].split(", ")]

    def each(asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in asked.to_dict("records"):
            answer, error, n = attempted(provider, purpose, {k: v or "" for k, v in row.items()}, most_attempts)
            out.append({**{k: (answer or {}).get(k) for k in names}, "error": error, "attempts": n})
        return pd.DataFrame(out, columns=[*names, "error", "attempts"])

    schema = ", ".join(f"{f.split(' ')[0]}: {f.split(' ', 1)[1]}" for f in [*re.split(r", (?=[a-z_]+ )", FIELDS[purpose]), "error string", "attempts int"])
    said = F.pandas_udf(each, f"struct<{schema}>")(F.struct(*[F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in inputs.items()]))
    full = rows.withColumn("_said", said)
    return full.withColumn("answer", F.struct(*[F.col(f"_said.{n}").alias(n) for n in names])).withColumn("error", F.col("_said.error")).withColumn("attempts", F.col("_said.attempts")).drop("_said")


class Scripted:
    """Answers from a table: {purpose: {input text: answer}}; what isn't there is an error."""

    def __init__(self, answers: dict[str, dict[str, dict]]):
        self.answers = answers

    def __call__(self, purpose: str, inputs: dict[str, str]) -> dict:
        for text in inputs.values():
            if text in self.answers.get(purpose, {}):
                return self.answers[purpose][text]
        raise KeyError(f"no scripted response for {purpose}")


# ---- answers derived from the text -------------------------------------------------

_NEGATION = re.compile(r"\b(?:not|never|false|incorrect|did not|does not)\b", re.I | re.A)
_FILING, _NEWS = re.compile(r"\b(?:audited|filing|official record|dataset)\b", re.A), re.compile(r"\b(?:news|journal|newspaper|report)\b", re.A)
_CHANGE = re.compile(r"\bfrom\b[^0-9+\-]*([+\-]?[0-9]+(?:\.[0-9]+)?)[^\n]{0,80}?\bto\b[^0-9+\-]*([+\-]?[0-9]+(?:\.[0-9]+)?)", re.I | re.A)
_PERCENT = re.compile(r"([+\-]?[0-9]+(?:\.[0-9]+)?)\s*(?:%|percent(?:age)?)\s+(?:increase|decrease|change)", re.I)


def plain(text: str) -> str:
    return re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", text).lower()).strip()


def token_overlap(claim: str, excerpt: str) -> float:
    """Share of the claim's words (of two letters at least) that the excerpt has."""
    asked = {w for w in plain(claim).split() if len(w) > 1}
    return len(asked & set(plain(excerpt).split())) / len(asked) if asked else 0.0


def queries_for(claim: str) -> dict[str, str]:
    return {"supporting": f"evidence {claim}", "skeptic": f"challenge {claim}"}


class TextDerived:
    """A deterministic provider: overlap, negation and numbers of the texts it is given."""

    def __call__(self, purpose: str, inputs: dict[str, str]) -> dict:
        answer = getattr(self, purpose, None)
        if answer is None:
            raise NotImplementedError(f"no scripted response: {purpose}")
        return answer(**inputs)

    def research_plan(self, claim: str, **_) -> dict:
        q = queries_for(claim)
        return {"supporting_queries": [q["supporting"]], "skeptic_queries": [q["skeptic"]]}

    @staticmethod
    def _line(content: str) -> str:
        return next((x.strip() for x in content.split("\n") if x.strip()), "")

    def investigator_assess(self, claim: str, content: str, **_) -> dict:
        line = self._line(content)
        relevant = token_overlap(claim, line) >= 0.5
        supports = relevant and not _NEGATION.search(line)
        return {"relevant": relevant, "supports": supports, "excerpt": line if supports else "", "relevance": "strong" if plain(claim) in plain(line) else "weak", "reasoning": "the page says so" if supports else "the page doesn't establish it"}

    def skeptic_assess(self, claim: str, content: str, **_) -> dict:
        line = self._line(content)
        relevant = token_overlap(claim, line) >= 0.5
        against = relevant and bool(_NEGATION.search(line))
        return {"relevant": relevant, "stance": "contradicts" if against else "none", "excerpt": line if against else "", "relevance": "strong" if against else "weak", "reasoning": "the page negates it" if against else "no counterevidence"}

    def source_quality(self, title: str, content: str, **_) -> dict:
        filing, news = _FILING.search(f"{title} {content}".lower()), _NEWS.search(title.lower())
        kind = "primary" if filing else "news" if news else "unknown"
        return {"source_type": kind, "directness": "direct", "independence": "independent", "methodology_visible": True if filing else None, "promotional": False, "strengths": ["a first-party record" if filing else "says it directly"], "weaknesses": []}

    def citation_assessment(self, claim: str, excerpt: str, **_) -> dict:
        seen = {q.value for q in G.quantities(excerpt)}
        overlap, direct = token_overlap(claim, excerpt), plain(claim) in plain(excerpt)
        same = overlap >= 0.5
        relation = "direct_contradiction" if same and _NEGATION.search(excerpt) else "direct_support" if direct else "partial_support" if same else "irrelevant"
        stronger = any(q.value not in seen for q in G.quantities(claim)) or (not direct and overlap < 0.85)
        return {"relation": relation, "explanation": "by words in common", "same_entity": same, "same_metric": same, "same_period": True, "same_population": True, "claim_stronger_than_source": stronger, "qualifiers_omitted": False}

    def numeric_extract(self, claim: str, **_) -> dict:
        change, percent = _CHANGE.search(claim), _PERCENT.search(claim)
        if not change or not percent:
            return {"kind": "none", "inputs": {}, "claimed_result": None, "explanation": "no explicit relation"}
        return {"kind": "percent_change", "inputs": {"from": float(change[1]), "to": float(change[2])}, "claimed_result": float(percent[1]), "explanation": "a change from one value to another"}

    def revision(self, trace: str, citations: str, **_) -> dict:
        m = re.match(r"(.+?[.!?])(?:\s|$)", trace.strip(), re.S)
        ids = [x for x in citations.split(",") if x]
        if not m or not ids:
            raise InvalidAnswer("no grounded revision can be derived")
        return {"replacement": m[1].strip(), "citations": ids}


# ---- steps over relations ----------------------------------------------------------


def plans(claims: DataFrame, provider: Provider) -> DataFrame:
    """claims (claim_id, text) with their queries: one to six of each kind, of three characters at least; others are an error."""
    a = ask(claims, "research_plan", provider, {"claim": F.col("text")})
    fits = lambda c: F.coalesce((F.size(c) >= 1) & (F.size(c) <= 6) & F.forall(c, lambda q: F.length(F.trim(q)) >= 3), F.lit(False))
    ok = fits(F.col("answer.supporting_queries")) & fits(F.col("answer.skeptic_queries"))
    return a.withColumn("error", F.when(F.col("error").isNull() & ~ok, "queries are missing, too many or too short").otherwise(F.col("error")))


def dependencies(documents: DataFrame, claims: DataFrame, provider: Provider) -> DataFrame:
    """(source, target, kind) edges between known, different claims of a document. claims: document_id, claim_id, text; documents: document_id, listing."""
    found = ask(documents, "claim_dependencies", provider, {"listing": F.col("listing")}).select("document_id", F.explode_outer("answer.dependencies").alias("d")).select("document_id", "d.*").where("source <> target")
    ids = lambda c: claims.select("document_id", F.col("claim_id").alias(c)).distinct()
    return found.join(ids("source"), ["document_id", "source"], "left_semi").join(ids("target"), ["document_id", "target"], "left_semi").select("document_id", "source", "target", "kind")


def isolated(results: DataFrame, error: Column) -> DataFrame:
    """results (claim_id, verdict, confidence, required_correction) with failed claims turned into failed verdicts; the job goes on."""
    failed = error.isNotNull()
    return results.withColumns({
        "verdict": F.when(failed, "failed").otherwise(F.col("verdict")), "confidence": F.when(failed, "low").otherwise(F.col("confidence")),
        "required_correction": F.when(failed, "Remove or retry this claim because its audit failed.").otherwise(F.col("required_correction")),
    })
