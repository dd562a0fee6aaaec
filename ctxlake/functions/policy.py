"""Policies and reductions over URLs, addresses, scripts and HTML, as column expressions."""

from __future__ import annotations

import ipaddress
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

# --- URLs

SCHEMES, PORTS = ("http", "https"), ("", "80", "443")


def url_parts(url: Column) -> dict[str, Column]:
    """scheme (lower-cased), host (lower-cased, without credentials) and port of an absolute URL, '' where there is none."""
    scheme = F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_replace(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), "^.*@", "")
    return {"scheme": scheme, "host": F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1)), "port": F.regexp_extract(authority, r":([0-9]*)$", 1)}


def url_verdict(url: Column) -> Column:
    """allowed, bad-url, scheme-blocked or port-blocked. Credentials don't matter: they are never sent."""
    p = url_parts(url)
    bad = F.coalesce((p["scheme"] == "") | (p["scheme"].isin(*SCHEMES) & (p["host"] == "")), F.lit(True))
    return F.when(bad, "bad-url").when(~p["scheme"].isin(*SCHEMES), "scheme-blocked").when(~p["port"].isin(*PORTS), "port-blocked").otherwise("allowed")


def looks_like_html(content_type: Column, body: Column) -> Column:
    return F.coalesce(F.lower(content_type).contains("html"), F.lit(False)) | body.rlike(r"(?i)^\s*<(!doctype html|html)\b")


# --- addresses

#: (network, reason); the first that holds an address counts.
BLOCKED_V4 = [
    ("0.0.0.0/8", "this host"), ("10.0.0.0/8", "private"), ("100.64.0.0/10", "carrier-grade NAT"), ("127.0.0.0/8", "loopback"), ("169.254.0.0/16", "link-local"),
    ("172.16.0.0/12", "private"), ("192.0.0.0/24", "protocol assignments"), ("192.0.2.0/24", "documentation"), ("192.168.0.0/16", "private"), ("198.18.0.0/15", "benchmarking"),
    ("198.51.100.0/24", "documentation"), ("203.0.113.0/24", "documentation"), ("224.0.0.0/4", "multicast"), ("240.0.0.0/4", "reserved"),
]
_RANGES = [(int(n.network_address), int(n.broadcast_address), reason) for n, reason in ((ipaddress.ip_network(n), r) for n, r in BLOCKED_V4)]
V4 = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"


def v4_number(ip: Column) -> Column:
    """An IPv4 address as a number, null if it isn't one."""
    parts = [F.nullif(F.regexp_extract(ip, V4, i), F.lit("")).cast("long") for i in (1, 2, 3, 4)]
    return F.when(ip.rlike(V4) & (F.greatest(*parts) <= 255), parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3])


def v4_reason(number: Column) -> Column:
    """Why an IPv4 address (a number) is blocked, null if it isn't."""
    return F.coalesce(*(F.when(number.between(low, high), reason) for low, high, reason in _RANGES))


def _v4_reason(n: int) -> str | None:
    return next((reason for low, high, reason in _RANGES if low <= n <= high), None)


def v6_reason(ip: str) -> tuple[bool, str | None]:
    """Whether a text is an IPv6 address, and why it is blocked, if it is. Embedded IPv4 addresses are judged as such."""
    text = ip.lower().split("%")[0].removeprefix("[").removesuffix("]")
    try:
        n = int(ipaddress.IPv6Address(text))
    except ValueError:
        return False, None
    low = n & 0xFFFFFFFF
    if n >> 32 == 0xFFFF:
        return True, _v4_reason(low) or "IPv4-mapped"
    if n >> 32 == 0:
        return True, {0: "unspecified", 1: "loopback"}.get(n) or _v4_reason(low) or "IPv4-compatible"
    if n >> 32 == 0x0064FF9B << 64:
        return True, _v4_reason(low) or "NAT64"
    for bits, prefix, reason in ((7, 0xFC >> 1, "unique-local"), (10, 0xFE80 >> 6, "link-local"), (8, 0xFF, "multicast")):
        if n >> (128 - bits) == prefix:
            return True, reason
    return True, None


@F.arrow_udf(StructType().add("valid", BooleanType()).add("reason", StringType()))
def _v6(ips: pa.Array) -> pa.Array:
    got = [v6_reason(x) if x else (False, None) for x in ips.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.bool_()), pa.array([g[1] for g in got], pa.string())], ["valid", "reason"])


def address_verdict(ip: Column) -> Column:
    """struct<family, blocked, reason> of an address; what can't be parsed is blocked."""
    n, six = v4_number(ip), _v6(ip)
    four = F.struct(F.lit(4).alias("family"), v4_reason(n).isNotNull().alias("blocked"), v4_reason(n).alias("reason"))
    other = F.struct(F.when(six["valid"], 6).otherwise(0).alias("family"), (~six["valid"] | six["reason"].isNotNull()).alias("blocked"), F.when(six["valid"], six["reason"]).otherwise("not an address").alias("reason"))
    return F.when(n.isNotNull(), four).otherwise(other)


# --- scripts

_CORE = r"['\"](?:node:)?(?:dgram|http|http2|https|net|tls)['\"]"
#: (label, pattern) of what reaches for the network; the first that matches is named.
NETWORK_USES = [
    ("curl", r"\bcurl\b"), ("wget", r"\bwget\b"), ("nc", r"\bnc\b"), ("fetch", r"\bfetch\(\s*['\"`]https?:"), ("requests", r"\brequests\.(delete|get|head|patch|post|put|request)\b"),
    ("urllib", r"\burllib\.request\b"), ("http.client", r"\bhttp\.client\b"), ("net.connect", r"\bnet\.connect\b"), ("Net::HTTP", r"\bNet::HTTP\b"), ("open-uri", r"\bopen-uri\b|\bURI\.open\b"),
    ("net/http", r"\bhttp\.(Client|Get|Head|NewRequest|Post)\b"), ("net.Dial", r"\bnet\.Dial\b"), ("file_get_contents", r"\bfile_get_contents\s*\(\s*['\"]https?:"), ("php curl", r"\bcurl_(exec|init)\b"),
    ("fsockopen", r"\bfsockopen\b"), ("perl", r"\bLWP\b|\bIO::Socket\b"), ("HttpClient", r"\bHttpClient\b|\bWebClient\b"), ("socket.connect", r"\bsocket\.connect\b"), ("/dev/tcp", r"/dev/(?:tcp|udp)/"),
    ("node module", rf"\b(?:require|import)\(\s*{_CORE}\s*\)"), ("node import", rf"\bfrom\s+{_CORE}"), ("node http", r"\bhttps?\.(?:get|request)\b"), ("download.file", r"\bdownload\.file\s*\("),
    ("R url", r"\burl\s*\(\s*['\"]https?:"), ("R http", r"\bhttr\b|\bRCurl\b|\bcurl(?:GET|POST|PerformGet)\b"), ("erlang", r":httpc\b|:gen_tcp\b|:gen_udp\b|:ssl\.connect\b"), ("elixir", r"\bHTTPoison\b|\bFinch\b|\bTesla\b|\bReq\.(?:get|post|request)\b"),
]


def network_use(script: Column) -> Column:
    """The label of the first rule that a script breaks, null if it breaks none."""
    return F.coalesce(*(F.when(script.rlike(pattern), label) for label, pattern in NETWORK_USES))


# --- HTML

ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&amp;": "&"}
#: (pattern, replacement), in order.
_TO_TEXT = [
    (r"(?s)<!--.*?-->", ""), (r"(?is)<script\b.*?</script>", " "), (r"(?is)<style\b.*?</style>", " "), (r"(?is)<head\b.*?</head>", " "),
    (r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "$2 ($1)"), (r"(?i)<h[1-6]\b[^>]*>", "\n\n# "), (r"(?i)</h[1-6]>", "\n"), (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)</(?:article|blockquote|div|ol|p|pre|section|table|tr|ul)>", "\n"), (r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", ""),
]


def _character(m: re.Match) -> str:
    n = int(m[1], 16) if m[1] else int(m[2])
    return chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else ""


@F.arrow_udf(StringType())
def _numeric(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else re.sub("&#(?:x([0-9a-fA-F]+)|([0-9]+));", _character, t) for t in texts.to_pylist()], pa.string())


def entities_decoded(text: Column) -> Column:
    """Numeric entities, then the named ones of ENTITIES; others stay. Python takes part only where there are numeric ones.
    A decoded ampersand begins no new entity."""
    out = F.when(text.rlike("&#(x[0-9a-fA-F]+|[0-9]+);"), _numeric(text)).otherwise(text)
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def html_text(html: Column) -> Column:
    """An HTML document as plain text: links as ``text (url)``, headings after ``#``, list items after ``-``."""
    out = html
    for pattern, replacement in _TO_TEXT:
        out = F.regexp_replace(out, pattern, replacement)
    out = F.regexp_replace(entities_decoded(out), "[ \t\f\x0b]+", " ")
    lines = F.transform(F.split(out, "\n"), lambda x: F.btrim(x, F.lit(" \r ")))
    return F.btrim(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), F.lit(" \n\r\t"))


# --- names


def release_number(tag: Column) -> Column:
    """array<int> of a release tag like v1.2.3, null for other tags: the greatest is the latest."""
    parts = [F.regexp_extract(tag, r"^v?([0-9]+)\.([0-9]+)\.([0-9]+)$", i) for i in (1, 2, 3)]
    return F.when(tag.rlike(r"^v?[0-9]+\.[0-9]+\.[0-9]+$"), F.array(*(p.try_cast("int") for p in parts)))


def remote_tags(listing: Column) -> Column:
    """The tags in a listing of remote references, without peeled ones."""
    return F.filter(F.transform(F.split(listing, "\n"), lambda x: F.regexp_extract(x, r"refs/tags/([^\s^]+)$", 1)), lambda x: x != "")


def requirement_name(spec: Column) -> Column:
    """The name in a PEP 508 requirement."""
    return F.element_at(F.split(F.trim(spec), r"[<=>!~;\[\s]", 2), 1)


def safe_path(path: Column) -> Column:
    """Relative, inside its root and without control characters."""
    return (path != "") & ~path.rlike(r"[\x00-\x1f\x7f]") & ~path.rlike(r"^(/|\\|[A-Za-z]:)") & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)")
