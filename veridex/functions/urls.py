"""URLs as Column functions: canonical form, publisher, what may not be fetched."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import quote, unquote_plus, unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tracking parameters, what pages may be, limits of a fetch, default ports, and the characters that each part of a URL keeps as they are.
TRACKING = r"(?i)^(utm_.*|fbclid|gclid|mc_eid|igshid|ref|ref_src)$"
CONTENT_TYPES = ("text/html", "text/plain", "application/xhtml+xml")
MOST_BYTES, MOST_REDIRECTS = 2_000_000, 5
PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}
_PATH_SAFE, _QUERY_SAFE, _USER_SAFE = "!$%&'()*+,-./:;=@[]|\\^_~", "!$%&()*+,-./:;=?@[]\\^_`{|}~", "!$%&'()*+,-._~"
_FORM_SAFE = "*-._"
_URL = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):(.*)$", re.S)
_NO_HOST = re.compile(r"[\x00-\x20\x7f\"#%/:<>?@\[\\\]^`{|}]")


def _host(raw: str) -> str | None:
    """A host as URL parsers write it; None if it is none."""
    if raw.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]" if raw.endswith("]") else None
        except ValueError:
            return None
    try:
        name = unquote_to_bytes(raw).decode()
        name = name.lower() if name.isascii() else name.encode("idna").decode().lower()
    except (UnicodeError, ValueError):
        return None
    if not name or _NO_HOST.search(name):
        return None
    labels = name.removesuffix(".").split(".")
    if not re.fullmatch(r"[0-9]+|0x[0-9a-f]*", labels[-1]):
        return name
    numbers = []
    for x in labels:  # an IPv4 address: the last number fills what is left
        try:
            numbers.append(int(x[2:] or "0", 16) if x.startswith("0x") else int(x, 8) if len(x) > 1 and x[0] == "0" else int(x))
        except ValueError:
            return None
    if len(numbers) > 4 or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def _path(raw: str) -> str:
    out: list[str] = []
    parts = raw.replace("\\", "/").split("/")[1:] if raw[:1] in ("/", "\\") else [raw]
    for i, part in enumerate(parts):
        plain, last = re.sub("(?i)%2e", ".", part), i == len(parts) - 1
        if plain == "..":
            out = out[:-1] + [""] * last
        elif plain == ".":
            out += [""] * last
        else:
            out.append(quote(part, safe=_PATH_SAFE))
    return "/" + "/".join(out)


def _query(raw: str) -> str | None:
    """A query without tracking parameters; written anew, as forms are, if it had any; None if nothing is left."""
    pairs = [p.partition("=") for p in raw.split("&") if p]
    keys = [unquote_plus(k, errors="replace") for k, _, _ in pairs]
    if not any(re.match(TRACKING, k) for k in keys):
        return quote(raw, safe=_QUERY_SAFE).replace("'", "%27")
    form = lambda x: quote(x, safe=_FORM_SAFE).replace("~", "%7E").replace("%20", "+")
    kept = [f"{form(k)}={form(unquote_plus(v, errors='replace'))}" for k, (_, _, v) in zip(keys, pairs, strict=True) if not re.match(TRACKING, k)]
    return "&".join(kept) or None


def canonical_text(url: str) -> str:
    """A URL as URL parsers write it, without fragment, tracking parameters and slashes at the path's end; text that is no URL stays."""
    m = _URL.match(re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(33))))))
    if not m:
        return url
    scheme, rest = m[1].lower(), m[2].partition("#")[0]
    if scheme not in PORTS:
        return f"{scheme}:{rest}"
    front, mark, query = rest.lstrip("/\\").partition("?")
    cut = re.search(r"[/\\]", front)
    authority, path = (front[: cut.start()], front[cut.start() :]) if cut else (front, "")
    user, at, where = authority.rpartition("@")
    name, _, port = (where, "", "") if where.endswith("]") else where.rpartition(":") if ":" in where and "]" not in where.rpartition(":")[2] else (where, "", "")
    host = _host(name)
    if host is None or (port and (not re.fullmatch("[0-9]+", port) or int(port) > 65535)):
        return url
    login, colon, password = user.partition(":")
    login, password = quote(login, safe=_USER_SAFE), quote(password, safe=_USER_SAFE)
    front = f"{login}{':' + password if password else ''}@" if login or password else ""
    number = f":{int(port)}" if port and int(port) != PORTS[scheme] else ""
    path = _path(path or "/")
    path = (re.sub("/+$", "", path) or "/") if len(path) > 1 else path
    query = _query(query) if mark else None
    return f"{scheme}://{front}{host}{number}{path}{'' if query is None else '?' + query}"


def canonical(url: Column) -> Column:
    """canonical_text over Arrow batches: parsing, percent-encoding and dot segments have no built-in form."""

    def each(s: pd.Series) -> pd.Series:
        return pd.Series([None if u is None else canonical_text(u) for u in s], dtype=object)

    return F.pandas_udf(each, "string")(url)


def fetch_problem(content_type: Column, n_bytes: Column, n_redirects: Column, repeated: Column) -> Column:
    """Why a fetched page is no page; null if it is one. repeated: whether a redirect led where one had been before."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return (
        F.when(repeated, "redirect loop").when(n_redirects > MOST_REDIRECTS, "too many redirects")
        .when(~kind.isin(*CONTENT_TYPES), F.concat(F.lit("unsupported content type "), kind)).when(n_bytes > MOST_BYTES, "response too large")
    )


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def publisher(url: Column, given: Column | None = None) -> Column:
    """What is given, or else the host without www."""
    own = F.when(host(url) != "", F.regexp_replace(host(url), r"^www\.", "")).otherwise(F.lit("unknown"))
    return own if given is None else F.coalesce(given, own)


def is_http(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://[^/?#]+")


def blocked_ipv4(ip: Column) -> Column:
    p = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("int"))
    a, b, c = (F.try_element_at(p, F.lit(i)) for i in (1, 2, 3))
    shape = ip.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") & F.forall(p, lambda x: x <= 255)
    ranges = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 100) & b.between(64, 127)) | ((a == 192) & (b == 0) & (c == 0))
    )
    return F.coalesce(shape & ranges, F.lit(False))


def blocked_ipv6(ip: Column) -> Column:
    """Loopback, unspecified, unique-local, link-local, and blocked IPv4 inside."""
    low = F.lower(F.regexp_replace(ip, r"^\[|\]$", ""))
    inner = F.regexp_extract(low, r"(?:::ffff:|::)((?:\d{1,3}\.){3}\d{1,3})$", 1)
    first = F.coalesce(F.conv(F.nullif(F.substring_index(low, ":", 1), F.lit("")), 16, 10).try_cast("long"), F.lit(0))
    ranges = low.isin("::1", "::") | first.between(0xFC00, 0xFDFF) | first.between(0xFE80, 0xFEBF)
    return low.contains(":") & F.when(inner != "", blocked_ipv4(inner)).otherwise(ranges)


def unsafe_reason(url: Column) -> Column:
    """Why a URL may not be fetched; null if it may."""
    h = F.regexp_replace(host(url), r"^\[|\]$", "")
    return (
        F.when(~F.coalesce(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.lit(False)), "invalid URL")
        .when(~url.rlike(r"(?i)^https?://"), "unsupported scheme")
        .when(url.rlike(r"^[^/]*//[^/?#]*@"), "embedded credentials")
        .when((h == "localhost") | h.endswith(".localhost"), "blocked host")
        .when(blocked_ipv4(h) | blocked_ipv6(h), "blocked address")
    )
