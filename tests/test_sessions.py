"""Session events and snapshots, against facts stated by hand and a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from ctxlake import streaming
from ctxlake.functions import text as T
from ctxlake.operators import sessions as S
from ctxlake.sources import exports


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_error_classes_and_tiers(spark):
    said = ["Request timed out", "deadline exceeded", "ECONNREFUSED 1.2.3.4", "EACCES: permission denied", "ENOENT: no such file", "Unexpected token } in JSON", "runtime not available", "exit code 2", "Traceback (most recent call last)", "all good"]
    assert column(spark, said, T.error_class) == ["timeout", "timeout", "network", "permission", "not-found", "syntax", "runtime", "runtime-error", "runtime-error", "other"]
    kinds = ["decision", "error", "rule", "edit", "write", "file_edit", "task", "tool", "exec", "git", "intent", "cwd", "turn", "unheard"]
    assert column(spark, kinds, T.tier) == [0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 4]
    assert column(spark, ["  a \n\t b  ", "x" * 300], T.one_line) == ["a b", "x" * 240]


P = S.payload
PAYLOADS = [
    P(tool_name="Edit", tool_input={"file_path": " a.py ", "edits": [{"file_path": "b.py"}, {"path": "a.py"}, {}]}, tool_response="done"),
    P(tool_name="Bash", tool_input={"command": "git status -s"}, tool_response=" M a.py\n\n?? b.py\n"),
    P(tool_name="Bash", tool_input={"command": "make"}, tool_response="ok\nfatal: broke\n0 errors\nfailed twice\nError one\nerror two", exit_code=2),
    P(tool_name="X", is_error=True, tool_response="boom error here\nsecond failed\nthird failed"),
    P(tool_name="X", is_error=True),
    P(tool_name="Think", tool_response={"k": 1}, output="no"),
    P(tool_name="Think", tool_response="Decision: use X\nWe're going with: Y\nDECISION - Z"),
    P(tool_name="my_patch_tool", tool_input={"path": "p"}),
    "not json",
    None,
]


def test_extraction(spark):
    events = column(spark, PAYLOADS, S.events_of)
    flat = [[(e.kind, e.summary) for e in x or []] for x in events]
    assert flat[0] == [("file_edit", "edited a.py"), ("file_edit", "edited b.py")]
    assert flat[1] == [("git", "git status -s: M a.py | ?? b.py")]
    assert flat[2] == [("error", x) for x in ("fatal: broke", "failed twice", "Error one", "exit 2: ok fatal: broke 0 errors failed twice Error one error two")]
    assert flat[3] == [("error", "boom error here second failed third failed"), ("error", "boom error here"), ("error", "second failed")]
    assert flat[4] == [("error", "tool reported is_error")] and flat[5] == [] and flat[7] == [("file_edit", "edited p")] and flat[8] == [] == flat[9]
    assert flat[6] == [("decision", "use X"), ("decision", "Y")]
    assert column(spark, PAYLOADS[:1] + PAYLOADS[5:6], S.source_label) == ["Edit:a.py", "Think"] and column(spark, PAYLOADS[5:6], S.output_text) == ['{"k":1}']


def test_routing_and_switches(spark):
    calls = [P(tool_name="WebFetch"), P(tool_name="Bash", tool_input={"command": "curl x"}), P(tool_name="Bash", tool_input={"command": "cat big.log | head"}), P(tool_name="Read", tool_input={"file_path": "a"}), P(tool_name="Bash", tool_input={"command": "ls"})]
    assert column(spark, calls, lambda p: S.deny(p, F.lit(200_000))) == ["web-fetch", "network-cli", "bash-dump", "large-read", None]
    assert column(spark, calls, lambda p: S.nudges(p, F.lit(40_000), graph=True)) == [["web-fetch"], ["network-cli"], ["bash-dump"], ["long-read"], []]
    kinds = {"lean": ["lite", "ultra"], "signal": ["full"]}
    got = column(spark, ["/ctx lean ultra", "@ctx signal default full", "/ctx lean nope", "hello"], lambda p: S.switch(p, kinds))
    assert [g and tuple(g) for g in got] == [("lean", "ultra", None), ("signal", None, "full"), ("lean", None, None), None]
    assert column(spark, ["Stop ctx!", "turn off signal", "stop it"], lambda p: S.switched_off(p, list(kinds))) == ["all", "signal", None]
    assert column(spark, ["please enable lean", "signal mode", "stop lean mode", "x"], lambda p: S.switched_on(p, list(kinds))) == ["lean", "signal", None, None]


def plain_snapshot(events, ts, most, guide=None):
    """All events walked one by one."""
    level = lambda k: next((i for i, t in enumerate(T.TIERS) if k in t), 4)
    order = sorted(events, key=lambda e: (level(e[2]), -e[1], -e[0]))
    return S.snapshot_text([(level(k), f"\n[{k}] {' '.join(s.split())[:240]} @{t}") for _, t, k, s in order], len(events), ts, most, guide)


def test_snapshots_against_a_plain_walk(spark):
    rng = random.Random(2)
    rows = [("tools", i, 100 + i, "tool", f"call {i}") for i in range(60)] + [("tools", 60, 1, "decision", "use postgres")]
    rows += [("long", i, i, "tool", "z" * 230 + str(i)) for i in range(200)]
    rows += [("mixed", i, rng.randint(0, 50), rng.choice(["decision", "edit", "git", "cwd", "odd"]), "w" * rng.randint(1, 90)) for i in range(400)]
    df = spark.createDataFrame(rows, "session string, seq long, ts long, kind string, summary string")
    for most in (60, 300, 2048):
        got = {r.session: r for r in S.snapshots(df, 7, most, with_guide=False).collect()}
        for name in ("tools", "long", "mixed"):
            own = [r[1:] for r in rows if r[0] == name]
            assert got[name].body == plain_snapshot(own, 7, most) and got[name].bytes <= most and got[name].events == len(own)
    tools = {r.session: r for r in S.snapshots(df, 7, 300).collect()}["tools"].body
    assert "use postgres" in tools and "more event(s)" in tools
    guide = {r.session: r.guide for r in S.guides(df).collect()}
    assert "decisions 1" in guide["tools"] and "- use postgres" in guide["tools"] and all(S.size(x) <= 600 for x in guide.values())
    full = S.snapshots(df).where("session = 'tools'")
    assert "## Session guide" in full.first().body and full.first().bytes <= 2048
    assert "NOTES.md (present" in S.restored(full, ["NOTES.md", " "]).first().body


def test_appends_are_checked(spark):
    rows = [(1.9, " tool ", "x"), (float("nan"), "tool", "x"), (2.0, " ", "x"), (2.0, "tool", None), (None, "tool", "x")]
    good, bad = S.checked(spark.createDataFrame(rows, "ts double, kind string, summary string"))
    assert [tuple(r) for r in good.collect()] == [(1, "tool", "x")] and bad.count() == 4


def test_streamed_payloads_reach_the_log_once(spark, tmp_path):
    rows = [("s", 1, "PostToolUse", PAYLOADS[0]), ("s", 2, "Stop", "{}"), ("s", 3, "Other", PAYLOADS[0])]
    for part in ("one", "two"):
        spark.createDataFrame(rows, "session string, ts long, event string, payload string").write.mode("append").json(f"{tmp_path}/in")
        streaming.log_events(streaming.payloads(spark, f"{tmp_path}/in"), f"{tmp_path}/log", f"{tmp_path}/state").awaitTermination()
        log = exports.read_events(spark, f"{tmp_path}/log")
        assert log.count() == {"one": 3, "two": 6}[part]
    assert sorted({r.kind for r in log.collect()}) == ["file_edit", "turn"]
    big = spark.createDataFrame([("s", 1, "PostToolUse", P(tool_name="R", output="x" * 200_000)), rows[0]], "session string, ts long, event string, payload string")
    assert [r.source for r in streaming.offloaded(big).collect()] == ["R"]
    exports.append_events(log, f"{tmp_path}/other")
    assert exports.read_events(spark, f"{tmp_path}/other").count() == 6


def test_snapshots_in_columns_equal_the_python_walk_with_guides(spark):
    rng = random.Random(5)
    kinds = ["decision", "edit", "git", "cwd", "odd", "error", "tool"]
    said = lambda: rng.choice(["é", "w", " x", "日本 "]) * rng.randint(1, 60) + rng.choice(["", " timeout", "\n\tend "])
    rows = [(f"s{i % 30}" if i % 30 else None, i, rng.randint(0, 50), rng.choice(kinds), said()) for i in range(900)] + [("one", 1000, 5, "tool", "x"), ("blank", 1001, 5, "error", None)]
    df = spark.createDataFrame(rows, "session string, seq long, ts long, kind string, summary string")
    text = {r.seq: r[1:] for r in df.select("seq", T.error_class(F.col("summary")), T.one_line(F.col("summary"))).collect()}
    lines = {}
    for r in S.in_order(df).withColumn("line", S.event_line()).orderBy("session", "place").collect():
        lines.setdefault(r.session, []).append((r.tier, r.line))
    for most in (20, 60, 120, 300, 700, 2048, 9000):
        snapshots = S.snapshots(df, 7, most)
        assert "Python" not in snapshots._jdf.queryExecution().executedPlan().toString()
        got, budget = {r.session: r for r in snapshots.collect()}, min(S.GUIDE_BYTES, int(most * S.GUIDE_SHARE))
        guide = {r.session: r.guide for r in S.guides(df, budget).collect()}
        assert len(got) == len(guide) == 32 and None in got
        for name, own in lines.items():
            walk = [x for x in own if x[1] is not None]
            assert got[name].body == S.snapshot_text(walk, len(own), 7, most, guide[name]) and got[name].bytes == S.size(got[name].body)
            assert guide[name] == plain_guide([r for r in rows if r[0] == name], text, budget)


def plain_guide(events, text, most):
    """All events walked one by one, in Python; text: by seq, the error class and the summary on one line."""
    group = lambda k: "edit" if k in S.EDITS else k if k in ("decision", "error", "git") else None
    counts, recent = {"all": len(events)} | dict.fromkeys(S.LAST, 0), {}
    for _, seq, _, k, said in sorted(events, key=lambda e: e[1]):
        if g := group(k):
            counts[g] += 1
            recent.setdefault(g, []).append(None if said is None else f"[{text[seq][0]}] {text[seq][1]}" if g == "error" else text[seq][1])
    return S.guide_text(counts, {g: x[-S.LAST[g] :] for g, x in recent.items()}, most)
