"""Chat formatting by schema fingerprints, in DataFrame operations only.

A record is JSON. Its nested field paths are sorted and hashed, and the hash selects a layout, which says declaratively
where roles and texts are. Paths go as deep as layouts do: ``a`` for a field, ``a[]`` for a list and ``a{}`` for an object
there, ``a[].b`` for the fields of a list's objects, and so on. Fields that no layout knows are ignored, as are null ones;
but a known field that holds a list or an object where layouts have a text gives a path that no layout has, and so does
any other field inside the parts of a message's content, as that of an image. Layouts turn into canonical turns (role,
text), and a template turns those into one string with a loss mask over the assistant's texts:

    ### role:
    text</turn>

Inside texts and roles ``\\``, ``#`` and ``<`` (in roles also ``:`` and line feeds) become two-character codes that start
with a backslash, so that the template's marks occur nowhere else and the string reads back exactly.

Null texts and roles count as empty. Turns are in the order of (turn, role, text), so that ties and repeated rows have
one result. A record that no layout fits, or that isn't JSON, has null turns and a null format. Each row with a null
conv_id is a conversation of its own. Results are the columns given and named in the docstrings; where the input has
columns of these names, they are replaced, and all its other columns stay as they are. A conversation is one output row,
so its rows come together in one task. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlake.llm.columns import literal, running, unused


def _text(v: str) -> str:
    return f"coalesce(try_variant_get({v}, '$', 'string'), '')"


def _items(v: str) -> str:
    """The objects of a list, as maps."""
    return f"filter(transform(try_variant_get({v}, '$', 'array<variant>'), o -> try_variant_get(o, '$', 'map<string,variant>')), o -> o is not null)"


def _content(v: str) -> str:
    """A text, or the texts of a list of parts."""
    parts = f"concat_ws('', transform({_items(v)}, q -> {_text("q['text']")}))"
    return f"if(startswith(schema_of_variant({v}), 'ARRAY'), {parts}, {_text(v)})"


_PAIR = "named_struct('role', {0}, 'text', {1})"
_MAPPED = "coalesce(element_at(map('human', 'user', 'gpt', 'assistant', 'chatgpt', 'assistant', 'bot', 'assistant'), {0}), {0})"
_M = "{m}['%s']"


def _turns(field: str, role: str, text: str, mapped: bool = False) -> str:
    name = _text(f"x['{role}']")
    return f"transform({_items(_M % field)}, x -> {_PAIR.format(_MAPPED.format(name) if mapped else name, _content(f"x['{text}']"))})"


def _two(user: str, answer: str) -> str:
    return f"array({_PAIR.format("'user'", user)}, {_PAIR.format("'assistant'", _text(_M % answer))})"


_SYSTEM = f"if({_M % 'system'} is null, array(), array({_PAIR.format("'system'", _text(_M % 'system'))}))"
_MESSAGE = ("[].content", "[].role", "[].content[]", "[].content[].text", "[].content[].type")
_MORE = "if({0} = '', '', {1})"
#: name: (required paths, optional paths, SQL for array<struct<role, text>> from the record's fields {m}).
LAYOUTS: dict[str, tuple[tuple[str, ...], tuple[str, ...], str]] = {
    "messages": (("messages", "messages[]"), ("system", *(f"messages{p}" for p in _MESSAGE)), _turns("messages", "role", "content")),
    "conversations": (("conversations", "conversations[]"), ("system", "conversations[].from", "conversations[].value"), _turns("conversations", "from", "value", True)),
    "instruction": (("instruction", "output"), ("input", "system"), _two(f"concat({_text(_M % 'instruction')}, {_MORE.format(_text(_M % 'input'), f"concat('\\n\\n', {_text(_M % 'input')})")})", "output")),
    "prompt_response": (("prompt", "response"), ("system",), _two(_text(_M % "prompt"), "response")),
    "prompt_completion": (("completion", "prompt"), ("system",), _two(_text(_M % "prompt"), "completion")),
    "turns_response": (("prompt", "prompt[]", "response"), ("system", *(f"prompt{p}" for p in _MESSAGE)), f"concat({_turns('prompt', 'role', 'content')}, array({_PAIR.format("'assistant'", _text(_M % 'response'))}))"),
    "turns_completion": (("completion", "prompt", "prompt[]"), ("system", *(f"prompt{p}" for p in _MESSAGE)), f"concat({_turns('prompt', 'role', 'content')}, array({_PAIR.format("'assistant'", _text(_M % 'completion'))}))"),
    "question_answer": (("answer", "question"), ("context", "system"), _two(f"concat({_MORE.format(_text(_M % 'context'), f"concat({_text(_M % 'context')}, '\\n\\n')")}, {_text(_M % 'question')})", "answer")),
}
VOCABULARY = sorted({p for need, may, _ in LAYOUTS.values() for p in (*need, *may)})


def _hash(paths: str) -> str:
    return f"sha2(array_join({paths}, '\\n'), 256)"


def _selector() -> str:
    """SQL for a map from every fingerprint that a layout takes to the layout's name."""
    entries = []
    for name, (need, may, _) in LAYOUTS.items():
        for k in range(len(may) + 1):
            for extra in combinations(may, k):
                paths = ", ".join(map(literal, sorted((*need, *extra))))
                entries.append(f"{_hash(f'array({paths})')}, '{name}'")
    return f"map({', '.join(entries)})"


def _kind(v: str, path: str) -> str:
    """SQL for the path of a value that is a list or an object, in an array of its own."""
    return f"case substr(schema_of_variant({v}), 1, 5) when 'ARRAY' then array(concat({path}, '[]')) when 'OBJEC' then array(concat({path}, '{{}}')) else array() end"


def _paths(m: str) -> str:
    """SQL for the sorted paths of a record's fields {m}, a map<string, variant> without nulls."""
    known = f"array({', '.join(map(literal, VOCABULARY))})"
    roots = f"array({', '.join(sorted({literal(p.partition('[')[0]) for p in VOCABULARY}))})"
    fields = f"filter(map_entries({m}), e -> array_contains({roots}, e.key))"
    own = f"flatten(transform({fields}, e -> concat(array(e.key), {_kind('e.value', 'e.key')})))"
    # Per list element: its known fields, what is nested in them, and all fields of nested parts.
    part = "flatten(transform({0}, q -> transform(map_keys(q), k -> concat({1}, '[].', k))))"
    path = "concat(e.key, '[].', f.key)"
    inner = f"flatten(transform(filter(map_entries(x), f -> array_contains({known}, {path}) and schema_of_variant(f.value) <> 'VOID'), f -> concat(array({path}), {_kind('f.value', path)}, coalesce({part.format(_items('f.value'), path)}, array()))))"
    nested = f"flatten(transform({fields}, e -> coalesce(flatten(transform({_items('e.value')}, x -> {inner})), array())))"
    return f"array_sort(array_distinct(concat({own}, {nested})))"


def canonical(records: DataFrame, json_col: str = "record") -> DataFrame:
    """``records`` with fingerprint, layout and turns."""
    m, paths = unused(records, "fields"), unused(records, "paths")
    # A null value, as an absent optional field often has, is no field.
    fields = f"map_filter(from_json(`{json_col}`, 'map<string,variant>'), (k, v) -> schema_of_variant(v) <> 'VOID')"
    step = records.withColumn(m, F.expr(fields)).withColumn(paths, F.expr(_paths(m)))
    step = step.withColumn("fingerprint", F.expr(_hash(paths))).withColumn("layout", F.expr(f"try_element_at({_selector()}, fingerprint)"))
    cases = " ".join(f"when '{name}' then concat({_SYSTEM.format(m=m)}, {sql.format(m=m)})" for name, (_, _, sql) in LAYOUTS.items())
    return step.withColumn("turns", F.expr(f"case layout {cases} end")).drop(m, paths)


def _escape(x: str, role: bool = False) -> str:
    codes = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")] + [(":", "\\c"), ("\n", "\\n")] * role
    for raw, code in codes:
        x = f"replace({x}, {literal(raw)}, {literal(code)})"
    return x


def _unescape(x: str) -> str:
    for raw, code in (("#", "\\h"), ("<", "\\l"), (":", "\\c"), ("\n", "\\n"), ("\\", "\\b")):
        x = f"replace({x}, {literal(code)}, {literal(raw)})"
    return x


END = "</turn>\n"


def render(rows: DataFrame) -> DataFrame:
    """``rows`` with formatted and loss_mask: for each turn the range of code points under the loss, empty for others."""
    heads = f"concat('### ', {_escape('t.role', True)}, ':\\n')"
    parts = f"transform(turns, t -> named_struct('head', {heads}, 'body', {_escape('t.text')}, 'loss', t.role = 'assistant'))"
    own = unused(rows, "parts")
    rows = rows.withColumn(own, F.expr(parts))
    ranges = running(f"transform({own}, (p, i) -> named_struct('gap', cast(length(p.head) + if(i > 0, {len(END)}, 0) as bigint), 'size', cast(length(p.body) as bigint)))")
    formatted = f"concat_ws('', transform({own}, p -> concat(p.head, p.body, {literal(END)})))"
    rows = rows.withColumn("formatted", F.expr(f"if({own} is null, null, {formatted})"))
    return rows.withColumn("loss_mask", F.expr(f"zip_with({ranges}, {own}, (r, p) -> named_struct('start', r.start, 'end', if(p.loss, r.end, r.start)))")).drop(own)


def read_back(rows: DataFrame) -> DataFrame:
    """``rows`` with read_turns and loss_text, from formatted and loss_mask alone."""
    pieces = f"filter(split(formatted, {literal('</turn>' + chr(10))}, -1), x -> x <> '')"
    own, at = unused(rows, "pieces"), unused(rows, "at")
    rows = rows.withColumn(own, F.expr(f"transform({pieces}, x -> named_struct('role', substr(substring_index(x, ':', 1), 5), 'body', substr(x, length(substring_index(x, ':', 1)) + 3)))"))
    ranges = running(f"transform({own}, (p, i) -> named_struct('gap', cast(length(p.role) + 6 + if(i > 0, {len(END)}, 0) as bigint), 'size', cast(length(p.body) as bigint)))")
    rows = rows.withColumn(at, F.expr(ranges))
    rows = rows.withColumn("read_turns", F.expr(f"transform({own}, p -> named_struct('role', {_unescape('p.role')}, 'text', {_unescape('p.body')}))"))
    masked = f"zip_with({own}, zip_with({at}, loss_mask, (a, m) -> named_struct('from', m.start - a.start, 'n', m.end - m.start)), (p, m) -> substr(p.body, cast(m.from + 1 as int), cast(m.n as int)))"
    return rows.withColumn("loss_text", F.expr(_unescape(f"concat_ws('', {masked})"))).drop(own, at)


def from_turns(conversations: DataFrame) -> DataFrame:
    """One record per conversation from rows of (conv_id, turn, role, text)."""
    rows = conversations.selectExpr("cast(conv_id as long) conv_id", "turn", "coalesce(cast(role as string), '') role", "coalesce(cast(text as string), '') text")
    grouped = rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    alone = rows.where("conv_id is null").select("conv_id", F.array(F.struct("turn", "role", "text")).alias("t"))
    return grouped.unionByName(alone).select("conv_id", F.expr("to_json(named_struct('messages', transform(t, x -> named_struct('role', x.role, 'content', x.text))))").alias("record"))


def format_records(records: DataFrame, json_col: str = "record") -> DataFrame:
    """``records`` with fingerprint, layout, turns, formatted and loss_mask."""
    return render(canonical(records, json_col))


def digest(formatted: DataFrame) -> DataFrame:
    """The digest columns, read back from the formatted strings."""
    return read_back(formatted).select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.expr("sha2(concat_ws('', transform(read_turns, t -> concat(t.role, '\\n', t.text, '\\n'))), 256)").alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )
