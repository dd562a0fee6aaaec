"""Files of a tree as rows, with ignore rules and read guards; text formats that describe repositories and sessions."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxlake.functions import extract

#: Folders that are never entered, whatever other rules say.
PRUNED = ("__pycache__", ".cache", ".git", ".mypy_cache", ".next", ".pytest_cache", ".tox", ".venv", "build", "coverage", "dist", "node_modules", "target", "vendor", "venv")
BINARY_ENDINGS = "7z a avi bz2 class db dll dylib eot exe gif gz ico jar jpeg jpg mov mp3 mp4 o pdf png so sqlite sqlite3 tar ttf wasm webp woff woff2 xz zip".split()
MOST_FILES, MOST_TEXT_BYTES, SNIFFED = 200, 262_144, 8192


def _system(root: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), os.path.realpath(urlparse(root).path)) if urlparse(root).scheme in ("", "file") else fs.FileSystem.from_uri(root)


def _listed(system: fs.FileSystem, base: str, folder: str) -> Iterator[tuple[str, int, int]]:
    """(path, size, mtime) of the files below a folder of the tree ``base``. Pruned and hidden folders aren't entered, nor
    are links, so that nothing outside is taken for a file of the tree."""
    local = isinstance(system, fs.LocalFileSystem)
    waiting = [folder]
    while waiting:
        for info in sorted(system.get_file_info(fs.FileSelector(waiting.pop())), key=lambda i: i.path):
            if local and os.path.islink(info.path):
                continue
            if info.type == fs.FileType.Directory and info.base_name not in PRUNED and not info.base_name.startswith("."):
                waiting.append(info.path)
            elif info.type == fs.FileType.File:
                yield info.path[len(base) :].lstrip("/"), info.size, info.mtime_ns or 0


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime) of the files below ``root``, a local folder or any URI that Arrow reads; paths are relative. The
    root's own folders are listed by tasks. (Spark's own file index hides names that begin with a dot or underscore.)"""
    system, base = _system(root)
    top = system.get_file_info(fs.FileSelector(base))
    local = isinstance(system, fs.LocalFileSystem)
    own = [(i.base_name, i.size, i.mtime_ns or 0) for i in top if i.type == fs.FileType.File and not (local and os.path.islink(i.path))]
    folders = [(i.path,) for i in top if i.type == fs.FileType.Directory and i.base_name not in PRUNED and not i.base_name.startswith(".") and not (local and os.path.islink(i.path))]
    kind = "path string, size long, mtime long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = _system(root)[0]
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = list(_listed(here, base, folder))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, (pa.string(), pa.int64(), pa.int64()))], ["path", "size", "mtime"])

    below = spark.createDataFrame(folders, "folder string").repartition(max(1, min(len(folders), 1000))).mapInArrow(run, kind)
    return spark.createDataFrame(own, kind).unionByName(below)


def with_content(files: DataFrame, root: str, most: int = extract.MOST_BYTES) -> DataFrame:
    """``files`` (path, size, mtime) with content, null where a file is larger than ``most`` bytes or can't be read. Filter
    first: only the rows that remain are read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(root)
        for batch in batches:
            for at in range(batch.num_rows):
                path, size = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                try:
                    with system.open_input_stream(f"{base}/{path}") as source:
                        body = source.read() if size <= most else None
                except OSError:
                    body = None
                yield pa.RecordBatch.from_arrays([*(c.slice(at, 1) for c in batch.columns), pa.array([body], pa.binary())], ["path", "size", "mtime", "content"])

    return files.select("path", "size", "mtime").mapInArrow(run, "path string, size long, mtime long, content binary")


# --- ignore rules


def glob_regex(pattern: str) -> str:
    """A glob over paths as a regular expression: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` within a name."""
    out = []
    for m in re.finditer(r"(\*\*/)|(\*\*)|(\*)|(\?)|\[(!?)([^\]]*)\]|(.)", pattern, re.S):
        if m[1]:
            out.append("(?:.*/)?")
        elif m[2]:
            out.append(".*")
        elif m[3]:
            out.append("[^/]*")
        elif m[4]:
            out.append("[^/]")
        elif m[6] is not None:
            inner = m[6].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{'^' if m[5] else ''}{inner}]" if inner else re.escape(m[0]))
        else:
            out.append(re.escape(m[7]))
    return "".join(out)


def ignore_rule(line: str, base: str = "") -> tuple[bool, bool, str] | None:
    """(ignores, folders only, regular expression) of a line of an ignore file that lies in ``base``; None for blank lines
    and comments. A slash inside anchors the rule to the file's folder."""
    line = line.rstrip()
    if not line or line.startswith("#"):
        return None
    ignores, line = not line.startswith("!"), line.removeprefix("!")
    folders, line = line.endswith("/"), line.rstrip("/")
    if not line:
        return None
    anywhere = "" if "/" in line else "(?:.*/)?"
    return ignores, folders, f"^{re.escape(base)}{anywhere}{glob_regex(line.lstrip('/'))}$"


def ignore_rules(files: DataFrame, names: tuple[str, ...] = (".gitignore", ".ignore")) -> list[tuple[bool, bool, str]]:
    """All rules of a tree, folders before their subfolders and ``names`` in their order, so that the last that fits
    decides. There are as many as people wrote, so they come to the driver."""
    found = files.where(F.element_at(F.split("path", "/"), -1).isin(*names)).select("path", F.decode("content", "UTF-8").alias("text")).collect()
    place = lambda r: (r.path.split("/")[:-1], names.index(r.path.split("/")[-1]))
    rules = (ignore_rule(line, "".join(p + "/" for p in place(r)[0])) for r in sorted(found, key=place) for line in r.text.splitlines())
    return [r for r in rules if r]


def _verdict(path: Column, folder: bool, rules: list[tuple[bool, bool, str]]) -> Column:
    fits = [F.when(path.rlike(regex), ignores) for ignores, folders, regex in reversed(rules) if folder or not folders]
    return F.coalesce(*fits, F.lit(False))


def ignored(path: Column, rules: list[tuple[bool, bool, str]], pruned: tuple[str, ...] = PRUNED) -> Column:
    """Whether a file is left out: it or a folder above it by the rules, or a folder that is pruned or hidden."""
    parts = F.split(path, "/")
    names = F.slice(parts, 1, F.size(parts) - 1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    folders = F.slice(above, 1, F.size(parts) - 1)
    hidden = F.exists(names, lambda n: n.isin(*pruned) | F.startswith(n, F.lit(".")))
    return hidden | F.exists(folders, lambda f: _verdict(f, True, rules)) | _verdict(path, False, rules)


def source_files(files: DataFrame, rules: list[tuple[bool, bool, str]] | None = None) -> DataFrame:
    """Files of a tree that symbols can be extracted from, by name and ending, without those that are ``ignored``."""
    rules = ignore_rules(files) if rules is None else rules
    name = F.element_at(F.split("path", "/"), -1)
    end = F.lower(F.regexp_extract(name, r"^.*[^.].*?(\.[^.]*)$", 1))
    known = end.isin(*extract.ENDINGS) | name.isin(*extract.MANIFESTS)
    return files.where(known & ~ignored(F.col("path"), rules))


def readable(content: Column, size: Column) -> Column:
    """Neither too large nor binary: no NUL among the first bytes."""
    return (size <= extract.MOST_BYTES) & ~F.contains(F.substring(content, 1, SNIFFED), F.lit(b"\0"))


def is_binary(path: Column, content: Column) -> Column:
    end = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return end.isin(*BINARY_ENDINGS) | F.coalesce(F.contains(F.substring(content, 1, SNIFFED), F.lit(b"\0")), F.lit(True))


def store_files(files: DataFrame, most: int = MOST_FILES, most_bytes: int = MOST_TEXT_BYTES) -> DataFrame:
    """(path, status, truncated, text): the first ``most`` files, level by level and sorted by name, as a store takes them;
    status is indexed, binary or empty, and texts of more than most_bytes bytes are cut to so many characters."""
    parts = F.split("path", "/")
    kept = files.where(~F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda n: n.isin(*PRUNED)))
    # Level by level: a folder's files come before those of any deeper folder.
    first = kept.orderBy(F.size(parts), F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)).limit(most)
    rows = first.withColumn("binary", is_binary(F.col("path"), F.col("content"))).withColumn("text", F.when(~F.col("binary"), F.decode("content", "UTF-8")))
    status = F.when(F.col("binary"), "binary").when(F.trim(F.regexp_replace("text", r"\s", "")) == "", "empty").otherwise("indexed")
    over = F.coalesce(F.octet_length("text") > most_bytes, F.lit(False))
    return rows.select("path", status.alias("status"), over.alias("truncated"), F.when(over, F.substring("text", 1, most_bytes)).otherwise(F.col("text")).alias("text"))


# --- repositories and sessions


def valid_ref(ref: str) -> bool:
    """A plain revision word: no option, white space or NUL."""
    return bool(ref) and not ref.startswith("-") and not re.search(r"[ \t\r\n\0]", ref)


def changed_names(diff: Column) -> Column:
    """The paths of a listing of changed names."""
    return F.filter(F.transform(F.split(diff, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def numstat(diff: DataFrame) -> DataFrame:
    """(added, deleted, path) of ``diff`` (text), a listing of changed lines per file; binary files have nulls."""
    line = F.explode(F.split("text", "\n")).alias("line")
    rows = diff.select(line).where(F.col("line").rlike(r"^(\d+|-)\t(\d+|-)\t.+"))
    n = lambda i: F.regexp_extract("line", r"^(\S+)\t(\S+)\t(.+)$", i)
    return rows.select(n(1).try_cast("long").alias("added"), n(2).try_cast("long").alias("deleted"), n(3).alias("path"))


def worktrees(listing: DataFrame) -> DataFrame:
    """(path, head, branch, bare, detached) of ``listing`` (text), blocks of lines between blank ones."""
    block = F.explode(F.filter(F.split("text", r"\n\s*\n"), lambda b: F.trim(b) != "")).alias("block")
    got = lambda key: F.nullif(F.regexp_extract("block", rf"(?m)^{key} (.*)$", 1), F.lit("")).alias({"worktree": "path", "HEAD": "head"}.get(key, key))
    return listing.select(block).select(got("worktree"), got("HEAD"), got("branch"), F.col("block").rlike(r"(?m)^bare$").alias("bare"), F.col("block").rlike(r"(?m)^detached$").alias("detached"))


def pull_requests(listing: DataFrame) -> DataFrame:
    """(number, title, author, branch, updated, url) of ``listing`` (json), arrays of open pull requests."""
    kind = "array<struct<number: int, title: string, author: struct<login: string>, headRefName: string, updatedAt: string, url: string>>"
    return listing.select(F.explode(F.from_json("json", kind)).alias("p")).selectExpr("p.number", "p.title", "p.author.login author", "p.headRefName branch", "p.updatedAt updated", "p.url")


def pull_request_files(views: DataFrame) -> DataFrame:
    """(number, file) of ``views`` (json), one pull request each with its files."""
    return views.select(F.from_json("json", "number int, files array<struct<path: string>>").alias("p")).select("p.number", F.explode("p.files.path").alias("file")).where("file is not null and number >= 1")


def transcripts(lines: DataFrame) -> DataFrame:
    """(session, output_tokens, turns, model) of ``lines`` (session, at, line), JSON lines: sums over the assistant's turns
    with usage, and the first model that is named. Lines that aren't JSON are left out."""
    entry = F.from_json("line", "type string, message struct<model: string, usage: struct<output_tokens: long>>")
    rows = lines.select("session", "at", entry.alias("e")).where("e.type = 'assistant' and e.message.usage is not null")
    model = F.min(F.when(F.coalesce("e.message.model", F.lit("")) != "", F.struct("at", F.col("e.message.model").alias("model"))))
    return rows.groupBy("session").agg(F.sum(F.coalesce("e.message.usage.output_tokens", F.lit(0))).alias("output_tokens"), F.count("*").alias("turns"), model["model"].alias("model"))


def compressed_pairs(files: DataFrame) -> DataFrame:
    """(folder, name, original_size, compressed_size) of ``files`` (path, size): originals beside smaller compressed ones."""
    folder, name = F.regexp_extract("path", "^(.*/)?[^/]*$", 1), F.element_at(F.split("path", "/"), -1)
    rows = files.select(folder.alias("folder"), name.alias("file"), "size")
    before = rows.where(F.endswith("file", F.lit(".original.md"))).selectExpr("folder", "regexp_replace(file, '[.]original[.]md$', '') name", "size original_size")
    after = rows.where(F.endswith("file", F.lit(".md")) & ~F.endswith("file", F.lit(".original.md"))).selectExpr("folder", "regexp_replace(file, '[.]md$', '') name", "size compressed_size")
    return before.join(after, ["folder", "name"]).where("original_size > compressed_size")


def tags(spark: SparkSession, text: str | None) -> DataFrame:
    """(id, tag) of a JSON object of tags; malformed texts and unknown tags have none."""
    try:
        found = json.loads(text or "")
    except (ValueError, RecursionError):
        found = {}
    rows = [(k, v) for k, v in found.items() if v in ("preferred", "contested")] if isinstance(found, dict) else []
    return spark.createDataFrame(rows, "id string, tag string")


def retagged(tags: DataFrame, resolved: DataFrame) -> DataFrame:
    """``tags`` (id, tag) after changes ``resolved`` (id, tag): a null tag clears one, and null ids, unknown names, do nothing."""
    known = resolved.where("id is not null")
    return tags.join(known.select("id"), "id", "left_anti").unionByName(known.where("tag is not null").select("id", "tag"))


def requests(lines: DataFrame) -> DataFrame:
    """(id, method, params, error) of ``lines`` (line), JSON-RPC requests: -32700 for what isn't JSON, -32600 for what isn't
    a request."""
    entry = F.try_parse_json("line")
    get = lambda key: F.try_variant_get(entry, f"$.{key}", "string")
    ok = (get("jsonrpc") == "2.0") & get("method").isNotNull()
    return lines.select(get("id").alias("id"), get("method").alias("method"), get("params").alias("params"), F.when(entry.isNull(), -32700).when(~F.coalesce(ok, F.lit(False)), -32600).alias("error"))
