"""Column expressions over text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the ranking ignores.
STOPWORDS = tuple("a an and are as at be but by for from has have he in is it its not of on or that the their they this to was we were will with you your".split())
BLANKS = " \t\n\r\f\x0b"


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores in any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def words_of(text: str) -> list[str]:
    """word_tokens() of a plain string."""
    return re.findall(r"\w+", text.lower())


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def identifier_tokens(name: Column) -> Column:
    """Tokens of an identifier; camel case parts words."""
    return ascii_tokens(F.regexp_replace(name, "([a-z0-9])(?=[A-Z])", "$1 "))


def identifier_words(text: str) -> list[str]:
    """identifier_tokens() of a plain string."""
    return re.findall("[a-z0-9]+", re.sub("(?<=[a-z0-9])(?=[A-Z])", " ", text).lower())


def trigrams(name: Column) -> Column:
    """Distinct trigrams of a lower-cased name, or the name itself if it is shorter."""
    low = F.lower(name)
    grams = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: low.substr(i, F.lit(3)))
    return F.when(F.length(low) < 3, F.when(low != "", F.array(low)).otherwise(F.array().cast("array<string>"))).otherwise(F.array_distinct(grams))


CODE_MARKS = r"(?m)\b(class|const|def|export|fn|function|import|INSERT|let|package|SELECT|var)\b|[{};]\s*$"
PROSE_MARKS, HEADINGS = r"(?i)\b(and|from|that|the|this|with)\b", r"(?m)^#{1,6}\s+\S+"


def content_kind(text: Column) -> Column:
    """code, prose or mixed, by counts of fences, keywords, line ends, headings and common words."""
    n = lambda pattern: F.regexp_count(text, F.lit(pattern))
    code = F.when(n("```") >= 2, 8).otherwise(0) + F.least(n(CODE_MARKS), F.lit(20))
    prose = F.least(n(HEADINGS) + n(PROSE_MARKS), F.lit(30))
    return F.when((code >= 6) & (prose >= 8), "mixed").when(code >= 6, "code").otherwise("prose")


MARKDOWN = (r"(?m)^#{1,6}\s+\S", "```", r"(?m)^\s*[-*+]\s+\S", r"\[.+\]\(.+\)")


def looks_like_markdown(text: Column) -> Column:
    """Headings, fences, or list items together with links."""
    heading, fence, item, link = (text.rlike(p) for p in MARKDOWN)
    return heading | fence | (item & link)


def doc_id(source: Column, text: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat(source, F.lit("\0"), text), 256), 1, 16))


def token_estimate(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4).cast("long")


#: (class, pattern); the first that matches the lower-cased summary counts.
ERROR_CLASSES = [
    ("timeout", r"\btimed?[\s-]?out\b|timeout|deadline exceeded"),
    ("network", "dns|econn|fetch|network|refused|socket|ssrf|unreachable"),
    ("permission", "denied|eacces|forbidden|permission|unauthor"),
    ("not-found", r"404|enoent|missing|no such|not[\s-]?found"),
    ("syntax", "invalid|parse|syntax|unexpected token"),
    ("runtime", r"enoexec|not installed|runtime[\s-]?not[\s-]?available|spawn"),
    ("runtime-error", r"exception|exit\s*(code)?\s*[1-9]|failed|non-?zero|traceback"),
]


def error_class(text: Column) -> Column:
    """The first class whose pattern matches, or other."""
    low = F.lower(text)
    return F.coalesce(*(F.when(low.rlike(pattern), name) for name, pattern in ERROR_CLASSES), F.lit("other"))


#: Kinds of events, the most important first; others come after them.
TIERS = [("decision", "error", "rule"), ("edit", "file_edit", "file_write", "task", "write"), ("exec", "file_read", "git", "intent", "tool"), ("cwd", "env", "skill", "subagent", "turn")]


def tier(kind: Column) -> Column:
    """Priority of an event kind, 0 to 3, 4 for unknown ones."""
    return F.coalesce(*(F.when(kind.isin(*kinds), i) for i, kinds in enumerate(TIERS)), F.lit(len(TIERS)))


def one_line(text: Column, most: int = 240) -> Column:
    """White space collapsed and trimmed, at most ``most`` characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def lines_of_code(text: Column) -> Column:
    """Lines of the fenced blocks, or of the whole text if it has none, that are neither blank nor comments."""
    fenced = F.regexp_extract_all(text, F.lit(r"(?s)```[a-zA-Z0-9_+-]*\r?\n(.*?)```"), F.lit(1))
    code = F.regexp_replace(F.when(F.size(fenced) > 0, F.array_join(fenced, "\n")).otherwise(text), r"(?s)/\*.*?\*/", "")
    return F.size(F.filter(F.split(code, "\n"), lambda x: x.rlike(r"\S") & ~x.rlike(r"^\s*(//|#|/\*|\*)"))).cast("long")


def ansi_stripped(text: Column) -> Column:
    """Without terminal escape sequences."""
    return F.regexp_replace(text, r"\x1b\[[0-9;?]*[ -/]*[@-~]", "")
