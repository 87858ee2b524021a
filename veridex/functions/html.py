"""HTML as Column functions: readable text, links, sanitising, instruction detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, sentences

_L, _R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"  # ASCII word boundaries


def _words(*alternatives: str) -> str:
    return f"{_L}({'|'.join(alternatives)}){_R}"


_GAP = "[^.?!]*"
# What reads as an instruction, in order; the first that matches names the kind.
INSTRUCTIONS = (
    ("exfiltration", _words("send", "forward", "email", "leak", "exfiltrate", "post") + _GAP + _words("system prompt", "api key", "secret", "token", "credential", "password")),
    ("exfiltration", _words("send", "forward", "email") + _GAP + _L + r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}" + _R),
    ("role_override", _words("you are now") + "|" + _words("act as") + _GAP + _words("unrestricted", "jailbroken", "dan") + "|" + _words("from now on you (are|will)")),
    ("instruction_injection", _words("ignore", "disregard", "forget", "override") + _GAP + _words("previous", "prior", "earlier", "above", "all") + _GAP + _words("instruction", "instructions", "prompt", "rules", "context")),
    ("instruction_injection", _words("mark", "rate", "classify", "label", "treat", "flag") + _GAP + _words("this", "the") + _GAP + f"(?:{_words('source', 'article', 'page', 'document', 'claim')})?" + _GAP + _L + "(as )?" + "(credible|trusted|trustworthy|verified|reliable|accurate|true)" + _R),
    ("instruction_injection", _words("do not", "don't", "never") + _GAP + _words("flag", "report", "mention", "quarantine", "warn", "contradict")),
    ("instruction_injection", _L + r"new (instructions?|system prompt|task)" + _R + r"\s*:"),
    ("role_override", _L + r"system\s*:\s*"),
)
_SPACE = r"[\s ]"
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
_HIDDEN = r"""(?is)<([a-z0-9]+)(?![A-Za-z0-9_])[^>]*(?:style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)[^"']*["']|(?<![A-Za-z0-9_])hidden(?![A-Za-z0-9_])|aria-hidden\s*=\s*["']true["'])[^>]*>(.*?)</\1>"""


#: A word that each of INSTRUCTIONS needs: most sentences have none and are done.
_ANY = "(?i)" + _words("send", "forward", "email", "leak", "exfiltrate", "post", "you are now", "act as", "from now on you", "ignore", "disregard", "forget", "override", "mark", "rate", "classify", "label", "treat", "flag", "do not", "don't", "never", "new", "system")


def instruction(span: Column) -> Column:
    """The kind of instruction a span reads as, or null."""
    out = F.when(~span.rlike(_ANY), F.lit(None))
    for kind, pattern in INSTRUCTIONS:
        hit = span.rlike("(?i)" + pattern)
        out = out.when(hit, kind)
    return out


def entities(s: Column) -> Column:
    for name, char in ENTITIES:
        s = F.regexp_replace(s, f"(?i){name}", char)
    return s


def _trim(s: Column) -> Column:
    return F.regexp_replace(s, rf"^{_SPACE}+|{_SPACE}+$", "")


def title(html: Column) -> Column:
    return _trim(F.regexp_replace(entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), rf"{_SPACE}+", " "))


def links(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a(?![A-Za-z0-9_])[^>]*href\s*=\s*["']([^"']+)["']"""), F.lit(1))
    return F.array_distinct(F.filter(found, lambda h: h.rlike("(?i)^https?://")))


def readable(html: Column) -> Column:
    """Text with paragraph breaks, without markup, scripts, styles and comments."""
    t = html
    for pattern, to in (
        (r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"(?s)<!--.*?-->", " "),
        (r"(?i)</(p|div|section|article|h[1-6]|li|tr|ul|ol|table|blockquote)\s*>", "\n"), (r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", " "),
    ):
        t = F.regexp_replace(t, pattern, to)
    t = entities(t)
    for pattern, to in ((r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
        t = F.regexp_replace(t, pattern, to)
    return _trim(t)


def sanitized(content: Column) -> Column:
    """Struct of clean text and safety events (kind, excerpt, action), in order:
    scripts, comments, hidden elements, sentences that read as instructions."""
    none = F.array().cast("array<struct<kind:string,excerpt:string,action:string>>")
    event = lambda kind, excerpt, action: F.struct(kind.alias("kind"), excerpt.alias("excerpt"), F.lit(action).alias("action"))
    active = content.rlike(r"(?i)<(script|style)(?![A-Za-z0-9_])")
    scripts = F.when(active, F.array(event(F.lit("script_stripped"), F.lit("active <script>/<style> markup"), "sanitized"))).otherwise(none)
    t = F.regexp_replace(content, r"(?is)<(script|style)(?![A-Za-z0-9_])[^>]*>.*?</\1>", " ")
    comments = F.filter(F.regexp_extract_all(t, F.lit(r"(?s)<!--(.*?)-->"), F.lit(1)), lambda c: instruction(c).isNotNull())
    hidden_comments = F.transform(comments, lambda c: event(F.lit("hidden_content"), _trim(c), "quarantined"))
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    elements = F.transform(F.regexp_extract_all(t, F.lit(_HIDDEN), F.lit(2)), lambda x: event(F.lit("hidden_content"), _trim(F.regexp_replace(x, "<[^>]+>", " ")), "quarantined"))
    t = F.regexp_replace(t, _HIDDEN, " ")
    for pattern, to in ((r"<[^>]+>", " "), (r"(?i)&nbsp;", " "), (r"(?i)&amp;", "&"), (r"[ \t]+", " "), (rf"{_SPACE}*\n{_SPACE}*", "\n")):
        t = F.regexp_replace(t, pattern, to)
    judged = F.transform(sentences(_trim(t)), lambda s: F.struct(s.alias("s"), instruction(s).alias("kind")))

    def told(j: Column) -> Column:
        quarantined = F.transform(F.filter(j, lambda x: x["kind"].isNotNull()), lambda x: event(x["kind"], x["s"], "quarantined"))
        clean = F.array_join(F.transform(F.filter(j, lambda x: x["kind"].isNull()), lambda x: x["s"]), " ")
        return F.struct(clean.alias("clean"), F.concat(scripts, hidden_comments, elements, quarantined).alias("events"))

    return let(judged, told)
