"""Session events: extraction from tool payloads, priority order, snapshots within a byte budget, and guides.

Payloads are JSON in a column. Events are rows (session, seq, ts, kind, summary). Extraction is column expressions. A
snapshot is a greedy walk that later, smaller events may still enter, so it is folded per session, in columns; since of the
events of one tier and one line length only as many as fill the budget can ever enter, no more of them are brought together,
and a session of any length gives a bounded group. snapshot_text() and guide_text() say the same of one session in Python.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxlake.functions.text import error_class, one_line, tier

SNAPSHOT_BYTES, GUIDE_BYTES, GUIDE_SHARE = 2048, 600, 0.35
EDITS = ("edit", "write", "file_write", "file_edit")
_EDITORS = "ApplyPatch CreateFile Delete DeleteFile Edit MultiEdit NotebookEdit StrReplace Write".split()
HINTS = ("# decisions, errors, rules", "# changes and tasks", "# actions and reads", "# context", "# other")


# --- payloads


def _at(payload: Column, *paths: str) -> Column:
    """The first of the paths that isn't null."""
    return F.coalesce(*(F.get_json_object(payload, p) for p in paths))


def _filled(payload: Column, *paths: str) -> Column:
    """The first of the paths that isn't empty, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object(payload, p)), F.lit("")) for p in paths))


def tool(payload: Column) -> Column:
    return F.coalesce(F.get_json_object(payload, "$.tool_name"), F.lit(""))


def output_text(payload: Column) -> Column:
    """What the tool gave: text as it is, anything else as JSON, '' for nothing."""
    return F.coalesce(_at(payload, "$.tool_response", "$.tool_output", "$.output", "$.stdout"), F.lit(""))


def source_label(payload: Column) -> Column:
    """tool:path, or the tool."""
    name = F.coalesce(F.get_json_object(payload, "$.tool_name"), F.lit("tool"))
    return F.concat_ws(":", name, _filled(payload, "$.tool_input.file_path", "$.tool_input.path", "$.tool_input.pattern"))


def edited_files(payload: Column) -> Column:
    """Paths that an editing tool touched, each once, in order."""
    edits = F.from_json(F.get_json_object(payload, "$.tool_input.edits"), "array<struct<file_path: string, path: string>>")
    own = F.array(_filled(payload, "$.tool_input.file_path", "$.tool_input.path", "$.tool_input.target", "$.tool_input.notebook_path"))
    more = F.transform(F.coalesce(edits, F.array().cast("array<struct<file_path: string, path: string>>")), lambda e: F.trim(F.coalesce(F.nullif(e.file_path, F.lit("")), e.path)))
    paths = F.array_distinct(F.filter(F.concat(own, more), lambda p: p.isNotNull() & (p != "")))
    return F.when(tool(payload).isin(*_EDITORS) | tool(payload).rlike("(?i)create|delete|edit|patch|write"), paths).otherwise(F.array().cast("array<string>"))


def errors(payload: Column) -> Column:
    """What went wrong: the flag, up to three lines of the first forty (the flag counts), and the exit code."""
    text = output_text(payload)
    flagged = F.coalesce(_at(payload, "$.is_error") == "true", F.lit(False)) | F.coalesce(_at(payload, "$.isError") == "true", F.lit(False))
    flag = F.when(flagged, F.array(one_line(F.when(text != "", text).otherwise("tool reported is_error")))).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.slice(F.split(text, "\n"), 1, 40), lambda x: x.rlike(r"(?i)\b(error|exception|failed|fatal|traceback)\b") & ~x.rlike("(?i)0 error"))
    # A hit is taken before the count is looked at, so a flagged call has up to two lines more, others three.
    some = F.transform(F.slice(lines, 1, F.when(flagged, 2).otherwise(3)), lambda x: one_line(x))
    code = F.get_json_object(payload, "$.exit_code").try_cast("int")
    exit_ = F.when((text != "") & (code != 0), F.array(one_line(F.concat(F.lit("exit "), code, F.lit(": "), F.substring(text, 1, 120))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(flag, F.when(text != "", some).otherwise(F.array().cast("array<string>")), exit_))


def git_summary(payload: Column) -> Column:
    """The command and the first lines of its output, null for other commands."""
    command, text = F.coalesce(F.get_json_object(payload, "$.tool_input.command"), F.lit("")), F.trim(output_text(payload))
    head = F.array_join(F.slice(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 1, 6), " | ")
    said = F.when(text == "", F.concat(F.lit("git: "), F.substring(command, 1, 80))).otherwise(F.concat(F.lit("git "), F.substring(F.regexp_replace(command, r"^git\s+", ""), 1, 40), F.lit(": "), head))
    return F.when(tool(payload).isin("Bash", "Shell") & command.rlike(r"\bgit\b"), one_line(said))


_DECISION = r"(?i)^\s*(?:decision|decided|chose|we(?:'| a)?re going with)\s*[:—-]\s*(.+)$"


def decisions(payload: Column) -> Column:
    """Up to two lines that state a decision."""
    lines = F.filter(F.split(output_text(payload), "\n"), lambda x: x.rlike(_DECISION))
    return F.transform(F.slice(lines, 1, 2), lambda x: one_line(F.regexp_extract(x, _DECISION, 1)))


def events_of(payload: Column) -> Column:
    """array<struct<kind, summary>>: edits, then errors, git and decisions."""
    as_ = lambda kind, items: F.transform(items, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("summary")))
    git = F.filter(F.array(git_summary(payload)), lambda s: s.isNotNull())
    return F.concat(as_("file_edit", F.transform(edited_files(payload), lambda p: F.concat(F.lit("edited "), p))), as_("error", errors(payload)), as_("git", git), as_("decision", decisions(payload)))


def extract_events(payloads: DataFrame) -> DataFrame:
    """(session, ts, kind, summary) of ``payloads`` (session, ts, payload), static or streaming."""
    return payloads.select("session", "ts", F.explode(events_of(F.col("payload"))).alias("e")).select("session", "ts", "e.kind", "e.summary")


READERS = ("Cat", "Glob", "Grep", "Read", "View")


def deny(payload: Column, size: Column, threshold: int = 102_400) -> Column:
    """Why a call is refused where routing is enforced: web-fetch, network-cli, bash-dump or large-read; else null. size: of the file that it reads."""
    command = F.coalesce(F.get_json_object(payload, "$.tool_input.command"), F.lit(""))
    bash = tool(payload) == "Bash"
    heavy = command.rlike(r"(?i)\bcat\s+[^|;\n]+\.(json|log|md|txt)\b") | command.rlike(r"(?i)\bfind\b.*-type\s+f")
    path = _filled(payload, "$.tool_input.file_path", "$.tool_input.path")
    return F.when(tool(payload) == "WebFetch", "web-fetch").when(bash & command.rlike(r"\bcurl\b|\bwget\b"), "network-cli").when(bash & heavy, "bash-dump").when((tool(payload) == "Read") & path.isNotNull() & (size > threshold), "large-read")


def nudges(payload: Column, size: Column, threshold: int = 102_400, soft: int = 32_768, graph: bool = False) -> Column:
    """Hints for a call that goes on: an array of web-fetch, network-cli, bash-dump, large-read, long-read, graph."""
    command = F.coalesce(F.get_json_object(payload, "$.tool_input.command"), F.lit(""))
    bash, read = tool(payload) == "Bash", (tool(payload) == "Read") & _filled(payload, "$.tool_input.file_path", "$.tool_input.path").isNotNull()
    dump = command.rlike(r"(?i)\bcat\s+\S+\.(json|log|txt)\b|\bfind\b.*-type\s+f|\bjournalctl\b")
    network = command.rlike(r"\bcurl\b|\bwget\b")
    own = [F.when(tool(payload) == "WebFetch", "web-fetch"), F.when(bash & network, "network-cli").when(bash & dump, "bash-dump"), F.when(read & (size > threshold), "large-read").when(read & (size > soft), "long-read")]
    listed = F.filter(F.array(*own), lambda x: x.isNotNull())
    first = F.lit(graph) & tool(payload).isin(*READERS) & ~F.exists(listed, lambda x: x.isin("large-read", "long-read"))
    return F.when(first, F.concat(listed, F.array(F.lit("graph")))).otherwise(listed)


def switch(prompt: Column, kinds: dict[str, list[str]]) -> Column:
    """struct<kind, mode, default_mode> of a prompt like ``/ctx lean ultra`` or ``/ctx lean default ultra``; modes that a
    kind doesn't have are null, and other prompts too."""
    text = F.lower(F.trim(prompt))
    one = rf"^[/@$]ctx\s+({'|'.join(kinds)})\b(?:\s+(default))?\s*([a-z-]+)?"
    kind, default, mode = (F.regexp_extract(text, one, i) for i in (1, 2, 3))
    known = F.coalesce(*(F.when((kind == k) & mode.isin(*m), mode) for k, m in kinds.items()))
    return F.when(text.rlike(one), F.struct(kind.alias("kind"), F.when(default == "", known).alias("mode"), F.when(default != "", known).alias("default_mode")))


def switched_off(prompt: Column, kinds: list[str]) -> Column:
    """The kind that a prompt ends, ``all`` for all of them, else null."""
    text = F.regexp_replace(F.lower(F.trim(prompt)), r"[.!?\s]+$", "")
    return F.when(text.isin("normal mode", "stop ctx"), "all").otherwise(F.nullif(F.regexp_extract(text, rf"^(?:deactivate|disable|stop|turn off)\s+(?:ctx[- ]?)?({'|'.join(kinds)})$", 1), F.lit("")))


def switched_on(prompt: Column, kinds: list[str]) -> Column:
    """The kind that a prompt asks for in words, else null."""
    text, names = F.lower(F.trim(prompt)), "|".join(kinds)
    asks = rf"\b(?:activate|enable|start|turn on)\b.*\b({names})\b|\b({names})\s+mode\b"
    return F.when(~text.rlike(r"\b(deactivate|disable|stop|turn off)\b"), F.nullif(F.concat(F.regexp_extract(text, asks, 1), F.regexp_extract(text, asks, 2)), F.lit("")))


# --- the log


def checked(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with whole ts and trimmed kind, rejected): ts must be finite, kind and summary not blank."""
    ts = F.col("ts").cast("double")
    good = F.coalesce(~F.isnan(ts) & (F.abs(ts) != float("inf")) & (F.trim("kind") != "") & (F.trim("summary") != ""), F.lit(False))
    return events.where(good).withColumn("ts", ts.cast("long")).withColumn("kind", F.trim("kind")), events.where(~good)


def in_order(events: DataFrame) -> DataFrame:
    """``events`` with tier and place: by tier, the latest first, of those the last to arrive."""
    own = Window.partitionBy("session").orderBy("tier", F.desc("ts"), F.desc("seq"))
    return events.withColumn("tier", tier(F.col("kind"))).withColumn("place", F.row_number().over(own))


def event_line() -> Column:
    label = F.when(F.col("kind") == "error", F.concat(F.lit("error:"), error_class(F.col("summary")))).otherwise(F.col("kind"))
    return F.concat(F.lit("\n["), label, F.lit("] "), one_line(F.col("summary")), F.lit(" @"), F.col("ts").cast("long"))


def size(text: str) -> int:
    return len(text.encode())


def snapshot_text(lines: list[tuple[int, str]], total: int, ts: int, most: int, guide: str | None = None, hints: tuple[str, ...] = HINTS) -> str:
    """The snapshot of lines (tier, text) in order, of ``total`` events: a header, each tier's hint before its first line,
    all lines that still fit, and how many others there are; a guide fills what room is left."""
    header = f"session snapshot @{ts}: {total} event(s)"
    parts, used, taken, last = [], size(header), 0, None
    for level, line in lines:
        hint = f"\n{hints[min(level, len(hints) - 1)]}" if level != last else ""
        if used + size(hint) + size(line) <= most:
            parts += [hint] * bool(hint) + [line]
            used, taken, last = used + size(hint) + size(line), taken + 1, level
    omitted = total - taken
    if omitted:
        mark = lambda: f"\n(+{omitted} more event(s) in the store)"
        while parts and used + size(mark()) > most:
            used -= size(parts.pop())
            omitted += 1
        if used + size(mark()) <= most:
            parts.append(mark())
            used += size(parts[-1])
    if guide and guide.strip() and most - used > 40:
        text = "\n" + guide.strip()
        while size(text) > most - used:
            text = text[:-8]
        if len(text.strip()) > 20:
            parts.insert(0, text)
    return header + "".join(parts)


def guide_text(counts: dict[str, int], recent: dict[str, list[str]], most: int = GUIDE_BYTES, stats: str | None = None) -> str:
    """A short account: how many events there are of each group and the last of them; detail goes first if it is long."""
    lines = ["## Session guide", f"Events: {counts['all']} (decisions {counts['decision']}, errors {counts['error']}, edits {counts['edit']}, git {counts['git']})."]
    lines += [stats] if stats else []
    for title, group in (("Decisions:", "decision"), ("Errors:", "error"), ("Files touched:", "edit"), ("Git:", "git")):
        lines += [title, *(f"- {x}" for x in recent[group])] if recent.get(group) else []
    lines.append("Details are in the event log.")
    while size("\n".join(lines)) > most and len(lines) > 3:
        del lines[2]
    return "\n".join(lines) if size("\n".join(lines)) <= most else "\n".join(lines)[:most]


LAST = {"decision": 3, "error": 3, "edit": 5, "git": 2}
TITLES = {"decision": "Decisions:", "error": "Errors:", "edit": "Files touched:", "git": "Git:"}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _strings(*items: Column | str) -> Column:
    return F.array(*(F.lit(x) if isinstance(x, str) else x for x in items)).cast("array<string>")


def _stripped(text: Column) -> Column:
    """str.strip() as a column."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def guide_column(counts: dict[str, Column], recent: Column, most: int) -> Column:
    """guide_text() as a column; recent: array<struct<g, said>> in order."""
    n = {k: c.cast("string") for k, c in counts.items()}
    head = F.concat(F.lit("## Session guide\nEvents: "), n["all"], F.lit(" (decisions "), n["decision"], F.lit(", errors "), n["error"], F.lit(", edits "), n["edit"], F.lit(", git "), n["git"], F.lit(")."))

    def section(title: str, group: str) -> Column:
        listed = F.transform(F.filter(recent, lambda x: x.g == group), lambda x: F.concat(F.lit("- "), F.coalesce(x.said, F.lit("None"))))
        return _let(listed, lambda own: F.when(F.size(own) > 0, F.concat(_strings(title), own)).otherwise(_strings()))

    details = F.concat(*(section(title, group) for group, title in TITLES.items()), _strings("Details are in the event log."))

    def shortened(head: Column, details: Column) -> Column:
        text = lambda i: F.concat_ws("\n", head, F.slice(details, i, F.size(details)))
        fits = F.filter(F.sequence(F.lit(1), F.size(details)), lambda i: (i == F.size(details)) | (F.octet_length(text(i)) <= most))
        return _let(text(fits[0]), lambda t: F.when(F.octet_length(t) <= most, t).otherwise(F.substring(t, 1, most)))

    return _let(head, lambda h: _let(details, lambda d: shortened(h, d)))


def snapshot_column(lines: Column, total: Column, guide: Column, ts: int, most: int, hints: tuple[str, ...] = HINTS) -> Column:
    """snapshot_text() as a column; lines: array<struct<tier, line>> in order."""
    header = F.concat(F.lit(f"session snapshot @{ts}: "), total.cast("string"), F.lit(" event(s)"))
    hint_of = lambda level: F.element_at(_strings(*(f"\n{h}" for h in hints)), F.least(level, F.lit(len(hints) - 1)) + 1)
    mark = lambda n: F.concat(F.lit("\n(+"), n.cast("string"), F.lit(" more event(s) in the store)"))

    def enter(a: Column, x: Column) -> Column:
        own = F.when(x.tier != a["last"], _strings(hint_of(x.tier), x.line)).otherwise(_strings(x.line))
        used = a.used + F.octet_length(x.line) + F.when(x.tier != a["last"], F.octet_length(hint_of(x.tier))).otherwise(0)
        return F.when(used <= most, F.struct(used.alias("used"), (a.taken + 1).alias("taken"), x.tier.alias("last"), F.concat(a.parts, own).alias("parts"))).otherwise(a)

    def leave(a: Column, part: Column) -> Column:
        full = a.used + F.octet_length(mark(a.omitted)) > most
        return F.when((a.omitted > 0) & full, F.struct((a.used - F.octet_length(part)).alias("used"), (a.popped + 1).alias("popped"), (a.omitted + 1).alias("omitted"))).otherwise(a)

    def told(room: Column) -> Column:
        """The guide cut by eights to the room, or nothing."""
        cut = lambda t: _let(F.filter(F.sequence(F.length(t), F.lit(-7), F.lit(-8)), lambda n: F.octet_length(F.substring(t, F.lit(1), n)) <= room)[0], lambda n: F.substring(t, F.lit(1), n))
        some = _let(F.concat(F.lit("\n"), _stripped(guide)), lambda t: _let(cut(t), lambda t: F.when(F.length(_stripped(t)) > 20, t).otherwise("")))
        return F.when((room > 40) & (_stripped(guide) != ""), some).otherwise("")

    def ended(s: Column, e: Column) -> Column:
        shown = (e.omitted > 0) & (e.used + F.octet_length(mark(e.omitted)) <= most)
        end = F.when(shown, mark(e.omitted)).otherwise("")
        return F.concat(header, told(most - e.used - F.octet_length(end)), F.array_join(F.slice(s.parts, F.lit(1), F.size(s.parts) - e.popped), ""), end)

    none = F.struct(F.octet_length(header).alias("used"), F.lit(0).alias("taken"), F.lit(-1).alias("last"), _strings().alias("parts"))
    walked = F.aggregate(lines, none, enter)
    pops = lambda s: F.aggregate(F.reverse(s.parts), F.struct(s.used.alias("used"), F.lit(0).alias("popped"), (total - s.taken).alias("omitted")), leave)
    return _let(walked, lambda s: _let(pops(s), lambda e: ended(s, e)))


def _recent(events: DataFrame) -> tuple[DataFrame, dict[str, Column], Column]:
    """``events`` with what a guide needs, and its counts and last few events of each group as aggregates of a session."""
    group = F.when(F.col("kind").isin(*EDITS), "edit").when(F.col("kind").isin("decision", "error", "git"), F.col("kind"))
    last = Window.partitionBy("session", "g").orderBy(F.desc("seq"))
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in LAST.items() for x in kv)), F.col("g"))
    said = F.when(F.col("kind") == "error", F.concat(F.lit("["), error_class(F.col("summary")), F.lit("] "), one_line(F.col("summary")))).otherwise(one_line(F.col("summary")))
    rows = events.withColumn("g", group).withColumn("late", F.row_number().over(last) <= limit)
    counts = {"all": F.count("*"), **{k: F.count_if(F.col("g") == k) for k in LAST}}
    return rows, counts, F.array_sort(F.collect_list(F.when(F.col("late"), F.struct("seq", "g", said.alias("said")))))


def guides(events: DataFrame, most: int = GUIDE_BYTES) -> DataFrame:
    """(session, guide): only the last few events of each group are brought together."""
    rows, counts, recent = _recent(events)
    whole = rows.groupBy("session").agg(*(c.alias(k) for k, c in counts.items()), recent.alias("recent"))
    return whole.select("session", guide_column({k: F.col(k) for k in counts}, F.col("recent"), most).alias("guide"))


def snapshots(events: DataFrame, ts: int = 0, most: int = SNAPSHOT_BYTES, with_guide: bool = True) -> DataFrame:
    """(session, ts, events, body, bytes) of every session."""
    rows = in_order(events).withColumn("line", event_line())
    same = Window.partitionBy("session", "tier", F.octet_length("line")).orderBy("place")
    able = F.row_number().over(same) <= F.floor(most / F.octet_length("line"))
    rows, counts, recent = _recent(rows.withColumn("able", able)) if with_guide else (rows.withColumn("able", able), {"all": F.count("*")}, None)
    lines = F.array_sort(F.collect_list(F.when(F.col("able"), F.struct("place", "tier", "line"))))
    whole = rows.groupBy("session").agg(*(c.alias(k) for k, c in counts.items()), lines.alias("lines"), *([recent.alias("recent")] if with_guide else []))
    budget = min(GUIDE_BYTES, int(most * GUIDE_SHARE))
    guide = guide_column({k: F.col(k) for k in counts}, F.col("recent"), budget) if with_guide else F.lit(None).cast("string")
    # Each row is packed by itself in the JVM: batches of rows in Python took memory by their lines.
    body = _let(guide, lambda g: snapshot_column(F.col("lines"), F.col("all"), g, ts, most))
    return whole.select("session", F.lit(ts).cast("long").alias("ts"), F.col("all").alias("events"), body.alias("body")).withColumn("bytes", F.octet_length("body").cast("long"))


def restored(saved: DataFrame, memory: list[str]) -> DataFrame:
    """``saved`` snapshots with pointers to files of the project's memory, which are named and never read."""
    names = "; ".join(f"{n.strip()} (present, read on demand)" for n in memory if n.strip())
    return saved.withColumn("body", F.concat("body", F.lit(f"\n# project memory: {names}"))) if names else saved


def payload(**fields) -> str:
    """A payload as its JSON, for tests and fixtures."""
    return json.dumps(fields)
