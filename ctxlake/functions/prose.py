"""Prose: compression that keeps code, URLs and names, and checks of what compression changed."""

from __future__ import annotations

import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: Never changed: fenced and inline code, URLs, paths, CONSTANT_NAMES, calls and version numbers.
KEPT = [re.compile(p, f) for p, f in ((r"```.*?```", re.S), (r"`[^`\n]+`", 0), (r"\bhttps?://\S+", re.I), (r"\b[\w.-]*[/\\][\w.\-/\\]+", re.A), (r"\b[A-Z][A-Za-z0-9]*(?:_[A-Z][A-Za-z0-9]*)+\b", 0), (r"\b\w+\.\w+(?:\.\w+)*\(\)?", re.A), (r"[A-Za-z_]\w*\s*\([^)]*\)", re.A), (r"\b\d+\.\d+\.\d+\b", re.A))]
_LEADERS = re.compile(r"^(?:i can|i will|i'?d|i'?ll|let me|let'?s|we can|we will|you can)\s+", re.I | re.M)
_POLITE = re.compile(r"\b(?:certainly|happy to|i'?d be happy|kindly|of course|please|sure|thank you|thanks)\b[,.]?\s*", re.I)
_HEDGES = re.compile(r"\b(?:could potentially|i think|in my opinion|it appears|it seems|maybe|might|perhaps|would like to)\b\s*", re.I)
_FILLERS = re.compile(r"\b(?:actually|basically|essentially|just|literally|quite|really|simply|very)\b", re.I)
_ARTICLES = re.compile(r"\b(?:an?|the)\s+(?=[a-z])", re.I)
_MASK = re.compile("\0([0-9]+)\0")


def _shorter(text: str) -> str:
    for pattern in (_LEADERS, _POLITE, _HEDGES, _FILLERS, _ARTICLES):
        text = pattern.sub("", text)
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"\s+([,.;:!?])", r"\1", re.sub(r"[ \t]{2,}", " ", text)))
    return re.sub(r"(^|[.!?]\s+)([a-z])", lambda m: m[1] + m[2].upper(), text).strip()


def compress(text: str) -> str:
    """Without leaders, politeness, hedges, fillers and articles; what KEPT names stays as it is."""
    held: list[str] = []

    def mask(m: re.Match) -> str:
        held.append(m[0])
        return f"\0{len(held) - 1}\0"

    for pattern in KEPT:
        text = pattern.sub(mask, text)
    out, before = _shorter(text), None
    for _ in range(len(held) + 2):
        if out == before:
            break
        before, out = out, _MASK.sub(lambda m: held[int(m[1])] if int(m[1]) < len(held) else "", out)
    return out


def compress_fields(value, fields: frozenset[str] = frozenset({"description"})):
    """JSON data with the texts of such fields compressed, at any depth."""
    if isinstance(value, list):
        return [compress_fields(x, fields) for x in value]
    if isinstance(value, dict):
        return {k: compress(x) if k in fields and isinstance(x, str) else compress_fields(x, fields) for k, x in value.items()}
    return value


def compressed(text: Column) -> Column:
    """struct<text, before, after> of each text."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else compress(t) for t in texts.to_pylist()], pa.string())

    out = run(text)
    return F.struct(out.alias("text"), F.length(text).alias("before"), F.length(out).alias("after"))


def compressed_json(text: Column, fields: tuple[str, ...] = ("description",)) -> Column:
    """JSON texts with the described fields compressed; what isn't JSON stays."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append(None if t is None else json.dumps(compress_fields(json.loads(t), frozenset(fields)), ensure_ascii=False))
            except (ValueError, RecursionError):
                out.append(t)
        return pa.array(out, pa.string())

    return run(text)


# --- files

PROSE_ENDINGS = "markdown md rst tex txt typ typst".split()
CONFIG_ENDINGS = "cfg env ini json toml yaml yml".split()
CODE_ENDINGS = "bash c cpp css csv dockerfile go h hpp html java js jsx kt lock lua makefile php py rb rs scss sh sql swift ts tsx xml zsh".split()
CODE_NAMES = "brewfile cmakelists.txt containerfile dockerfile gemfile gnumakefile jenkinsfile justfile makefile procfile rakefile vagrantfile".split()
_CODE_LINE = "|".join((r"\s*(?:import |from .+ import |require\(|const |let |var )", r"\s*(?:async function |class |def |export |function )", r"\s*(?:(?:for|if|switch|while)\s*\(|try\s*\{)", r"\s*[\}\]\);]+\s*$", r"\s*@\w+", r'\s*"[^"]+"\s*:\s*', r"""\s*\w+\s*=\s*[{\[("']"""))


def file_type(path: Column, text: Column) -> Column:
    """natural_language, code, config or unknown: by name, then ending, then, without an ending, the first fifty lines."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    end = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    lines = F.slice(F.split(text, "\r\n|\r|\n"), 1, 50)
    filled = F.filter(lines, lambda x: F.trim(x) != "")
    share = lambda rows, pattern: F.try_divide(F.size(F.filter(rows, lambda x: x.rlike(pattern))), F.size(rows))
    top = F.filter(F.slice(lines, 1, 30), lambda x: F.trim(x) != "")
    yaml = F.coalesce(share(top, r"^\s*(?:---|\w[\w\s]*:\s|- .*:)"), F.lit(0.0)) > 0.6
    by_text = F.when(F.startswith(text, F.lit("#!")), "code").when(F.try_parse_json(F.substring(text, 1, 10000)).isNotNull(), "config").when(yaml, "config").when(F.coalesce(share(filled, f"^(?:{_CODE_LINE})"), F.lit(0.0)) > 0.4, "code").otherwise("natural_language")
    named = F.when(name.isin(*CODE_NAMES) | name.rlike(r"^(containerfile|dockerfile)\."), "code").when(name.rlike(r"^(constraints|requirements)[\w.\-]*\.txt$"), "config")
    ended = F.when(end.isin(*PROSE_ENDINGS), "natural_language").when(end.isin(*CONFIG_ENDINGS), "config").when(end.isin(*CODE_ENDINGS), "code").when(end != "", "unknown")
    return F.coalesce(named, ended, F.when(text.isNull(), "unknown").otherwise(by_text))


def compressible(path: Column, text: Column) -> Column:
    """Natural language that isn't the backup of a compressed file."""
    return (file_type(path, text) == "natural_language") & ~F.endswith(path, F.lit(".original.md"))


_SECRET_NAME = r"(?i)^(\.env(\..+)?|\.netrc|credentials(\..+)?|secrets?(\..+)?|passwords?(\..+)?|id_(rsa|dsa|ecdsa|ed25519)(\.pub)?|authorized_keys|known_hosts|.*\.(asc|cer|crt|gpg|jks|key|keystore|p12|pem|pfx))$"


def sensitive_path(path: Column) -> Column:
    """Whether a file's name or folders say that it holds secrets."""
    parts = F.transform(F.split(path, "/"), F.lower)
    name = F.element_at(F.split(path, "/"), -1)
    bare = F.regexp_replace(F.lower(name), r"[_\-\s.]", "")
    return name.rlike(_SECRET_NAME) | F.arrays_overlap(parts, F.array(*map(F.lit, (".aws", ".docker", ".gnupg", ".kube", ".ssh")))) | bare.rlike("accesskey|apikey|credential|passwd|password|privatekey|secret|token")


def frontmatter(text: Column) -> Column:
    """struct<head, body>: a leading block between lines of three dashes, and the rest."""
    head = F.regexp_extract(text, r"(?s)^(---\r?\n.*?\r?\n---\r?\n)", 1)
    return F.struct(head.alias("head"), F.substring(text, F.length(head) + 1, F.length(text)).alias("body"))


def unwrapped(text: Column) -> Column:
    """A text without the one fence around all of it."""
    pattern = r"(?s)\A\s*(`{3,}|~{3,})[^\n]*\n(.*)\n\1\s*\z"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 2)).otherwise(text)


# --- validation

_FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})(.*)$", re.A)
URL, PATH = r"https?://[^\s)]+", r"(?:\./|\.\./|/|[A-Za-z]:\\)[\w\-/\\.]+|[\w\-.]+[/\\][\w\-/\\.]+"


def fenced_blocks(text: str) -> list[str]:
    """Closed fenced blocks with their fences; a fence is closed by one of its kind that is as long and bare."""
    out, block, mark = [], [], ""
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if mark:
            block.append(line)
            if m and m[1][0] == mark[0] and len(m[1]) >= len(mark) and not m[2].strip():
                out.append("\n".join(block))
                mark = ""
        elif m:
            block, mark = [line], m[1]
    return out  # what follows an unclosed fence belongs to it and counts as nothing


def inline_code(text: str) -> list[str]:
    for fence in ("```", "~~~"):
        text = re.sub(rf"^{fence}.*?^{fence}", "", text, flags=re.M | re.S)
    return re.findall("`([^`]+)`", text)


def parts_of(text: str) -> dict:
    """What validation compares: headings, fenced blocks, URLs, paths, bullets and inline code."""
    return {"headings": [(a, b.strip()) for a, b in re.findall(r"^(#{1,6})\s+(.*)", text, re.M)], "blocks": fenced_blocks(text), "urls": set(re.findall(URL, text)), "paths": set(re.findall(PATH, text)), "bullets": len(re.findall(r"^\s*[-*+]\s+", text, re.M)), "code": Counter(inline_code(text))}


def problems(before: str, after: str) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a compressed text, by its original."""
    a, b = parts_of(before), parts_of(after)
    errors = ["heading count"] * (len(a["headings"]) != len(b["headings"])) + ["code blocks"] * (a["blocks"] != b["blocks"]) + ["urls"] * (a["urls"] != b["urls"]) + ["inline code lost"] * bool(a["code"] - b["code"])
    warnings = ["headings"] * (a["headings"] != b["headings"]) + ["paths"] * (a["paths"] != b["paths"])
    warnings += ["bullets"] * bool(a["bullets"] and abs(a["bullets"] - b["bullets"]) / a["bullets"] > 0.15) + ["inline code added"] * bool(b["code"].keys() - a["code"].keys())
    return errors, warnings


@F.arrow_udf(StructType().add("errors", ArrayType(StringType())).add("warnings", ArrayType(StringType())))
def validated(before: pa.Array, after: pa.Array) -> pa.Array:
    got = [problems(x or "", y or "") for x, y in zip(before.to_pylist(), after.to_pylist())]
    kind = pa.list_(pa.string())
    return pa.StructArray.from_arrays([pa.array([g[0] for g in got], kind), pa.array([g[1] for g in got], kind)], ["errors", "warnings"])
