import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ctxlake.llm import chat, decontam, hostrules, licenses, quality, secretscan, urlrules, words
from ctxlake.llm.common import join_hot, staged
from ctxlake.sources import table


def test_every_license_template_is_found_as_a_header(spark):
    rows = [(i, f"d{i}/x.py", f"first line\n# {body}\nlast line") for i, (_, body) in enumerate(licenses.TEMPLATES)]
    rows += [(1000, "open/LICENSE", "Released under the MIT License."), (1001, "open/x.py", "code\nAll rights reserved."), (1002, "open/y.py", "code")]
    rows += [(1003, "bsd/x.py", "Copyright 2015 Ann.\nAll rights reserved.\nRedistribution and use in source and binary forms, with or without")]
    rows += [(1004, "two/NOTICE", "All rights reserved."), (1005, "two/LICENSE", "Released under the MIT license, as it is"), (1006, "two/x.py", None)]
    rows += [(1007, "no/x.py", "All rights reserved.\nReleased under the MIT license, maybe\nProprietary and confidential. All rights reserved.")]
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i] for i in range(len(licenses.TEMPLATES))] == [(name, "header") for name, _ in licenses.TEMPLATES]
    assert got[1001] == ("Proprietary", "header") and got[1002] == ("MIT", "inherited")
    assert got[1003] == ("BSD-3-Clause", "header") and got[1006] == ("MIT", "inherited")
    assert got[1007] == ("Proprietary", "header")


def plain_profile(text):
    """A text's table rows and weights, one word at a time."""
    out, ws, n = Counter(), (text or "").encode().split(), 0
    h = {w: words.hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in ws}
    for w in ws:
        marks = np.frombuffer(b" " + w + b" ", np.uint8)
        own = [int(r) for rows, ok in quality.grams(marks) for r in rows[ok]] + [int(quality.rows_of(np.array([h[w]]))[0])]
        assert len(own) == 3 * len(w) + 1
        out.update({r: c / len(own) for r, c in Counter(own).items()})
        n += 1
    for a, b in zip(ws, ws[1:]):
        for r in quality.rows_of(quality.doubled(np.array([h[a], h[b]]), np.array([2]), None)[0]).tolist():
            out[r] += 1
            n += 1
    return {r: w / n for r, w in out.items()}


def test_features_against_one_word_at_a_time(monkeypatch):
    rng = random.Random(4)
    texts = [None, "", " \n", "x", "a a a b", "ab" * 29 + "yz " + "q" * 61, "日本語" * 40 + " é", *("".join(rng.choices("ab é\n", k=rng.randint(0, 80))) for _ in range(60))]
    weights = np.random.default_rng(0).normal(size=1 << quality.TABLE_BITS).astype(np.float32)
    for piece in (3, 17, 1 << 21):
        monkeypatch.setattr(words, "PIECE", piece)
        got = quality.scores(pa.array(texts, pa.string()), weights, 0.25)
        for text, score in zip(texts, got.tolist()):
            want = plain_profile(text)
            rows, share = quality.profile(text)
            assert dict(zip(rows.tolist(), share.tolist())) == pytest.approx(want, rel=1e-5)
            assert score == pytest.approx(1 / (1 + np.exp(-sum(weights[r] * w for r, w in want.items()) - 0.25)), rel=1e-5)


def test_one_text_that_does_not_fit_ends_nothing(spark, monkeypatch):
    monkeypatch.setattr(quality, "MOST_CHARS", 3000)
    rows = [(i, ("good word " if i % 2 else "junk$$$ %%% ") * (500 if i in (3, 6) else 2)) for i in range(60)]
    docs = spark.createDataFrame([*rows, rows[1]], "doc_id long, text string").withColumn("__score", F.lit(1))
    truth = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = quality.classify(docs, truth).collect()
    assert len(got) == 61 and all(r.predicted == r.doc_id % 2 for r in got)
    one = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in quality.classify(docs, one).collect())
    assert quality.keep_good(docs, truth).columns == docs.columns and {r.doc_id for r in quality.keep_good(docs, truth).collect()} == set(range(1, 60, 2))


def test_held_out_quality_of_a_larger_table(spark):
    """Balanced accuracy, which a model that always answers alike can't pass: it gets 0.5."""
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    rows = quality.classify(docs, labels).where("held_out").join(labels, "doc_id").collect()
    share = lambda y: np.mean([r.predicted == y for r in rows if r.quality == y])
    assert (share(0) + share(1)) / 2 >= 0.95


def test_what_stands_behind_byte_60_of_a_word_is_learned():
    rng = random.Random(6)
    head = "天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往"
    kinds = ["秋收冬藏閏餘成歲律呂調陽", "雲騰致雨露結為霜金生麗水"]
    text = lambda y: head + "".join(rng.choices(kinds[y], k=60))
    labels = [i % 2 for i in range(200)]
    model = quality.train([text(y) for y in labels], labels)
    scores = quality.scores(pa.array([text(y) for y in labels]), *model)  # new texts, so only n-grams tell
    assert all((s > 0.5) == (y == 1) for s, y in zip(scores, labels))


def test_fields_that_no_layout_knows_leave_the_layout(spark):
    m, c = '"messages":[{"role":"user","content":"q"}]', '"conversations":[{"from":"human","value":"q"}]'
    q = ("user", "q")
    want = {f'{{{m},"tags":["a","b"]}}': [q], f'{{{m},"scores":[1,2]}}': [q], f'{{{m},"t":[null,{{"a":1}}]}}': [q], f'{{{c},"w":[0.5]}}': [q], f'{{{m},"system":"[be brief]"}}': [("system", "[be brief]"), q], '{"messages":[{"role":"user","content":"q"},null]}': [q]}
    parts = '[{"type":"text","text":"a"},{"type":"text","text":"b"}]'
    want |= {f'{{"messages":[{{"role":"user","content":{parts}}},{{"role":"assistant","content":"[c]","weight":1}}]}}': [("user", "ab"), ("assistant", "[c]")], '{"prompt":[{"role":"user","content":"hi"}],"response":"r"}': [("user", "hi"), ("assistant", "r")]}
    want |= {'{"instruction":"i","input":"","output":"o"}': [("user", "i"), ("assistant", "o")], '{"instruction":"i","input":"j","output":"o","system":"s"}': [("system", "s"), ("user", "i\n\nj"), ("assistant", "o")], '{"question":"q","context":"c","answer":"a"}': [("user", "c\n\nq"), ("assistant", "a")], f'{{{c},"id":3}}': [q], '{"prompt":"[\\"a\\"]","completion":"x"}': [("user", '["a"]'), ("assistant", "x")]}
    rows = chat.format_records(spark.createDataFrame([(k,) for k in want], "record string")).collect()
    assert {r.record: r.turns and [tuple(t) for t in r.turns] for r in rows} == want and all(r.formatted for r in rows)


def test_removal_in_blocks_is_the_same(spark, monkeypatch):
    w = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(w[5:17])), (2, " ".join(w[12:24])), (3, " ".join(w[:5] + w[24:30]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(w), 7), (1, "clean", 7), (None, None, 7), (2, " ".join(w[5:17]), 7)], "doc_id long, text string, n_chars int")
    key = lambda: sorted(map(repr, decontam.remove(docs, bench, least_items=9).collect()))
    one = key()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 10)
    assert key() == one and any("w4 " in r and "w12" not in r for r in one)


def test_words_are_whole_in_every_piece(monkeypatch):
    rng = random.Random(1)
    plain = lambda w: int(words.hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    for piece in (1, 5, 64, 1 << 21):
        monkeypatch.setattr(words, "PIECE", piece)
        for _ in range(200):
            texts = [rng.choice([None, "", "".join(rng.choices("abC \n\té", k=rng.randint(0, 12))), "x" * rng.randint(60, 90) + " y"]) for _ in range(5)]
            h, n = words.word_hashes(pa.array(texts, pa.string()).slice(1))
            ws = [(t or "").encode().lower().split() for t in texts[1:]]
            assert h.tolist() == [plain(w) for t in ws for w in t] and n.tolist() == [len(t) for t in ws]


def test_a_test_set_in_blocks_decides_on_whole_documents(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "a b c d"), (2, "x y z"), (3, "a b c d"), (None, "q r s"), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "q x a b c d y z r", 7), (2, "x y z q r s", 7)], "doc_id long, text string, __seen int")
    one = sorted(map(tuple, decontam.remove(docs, bench, 3, 3).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 3)
    assert sorted(map(tuple, decontam.remove(docs, bench, 3, 3).collect())) == one == [(1, "q x  y z r", 7), (2, " q r s", 7)]


def test_records_that_no_layout_fits_and_names_that_clash(spark):
    odd = ['{"prompt":{"a":1},"response":"r"}', '{"prompt":["a"],"response":{"x":"r"}}', '{"messages":{"role":"user"}}', '{"messages":[{"role":"user","content":[{"type":"image","image_url":"u"}]}]}', '{"messages":[{"role":"user","content":{"a":1}}]}', "[]", "1", "", None, "{", '{"messages":null}']
    df = spark.createDataFrame([(r, 1, 2, 3, 4) for r in [*odd, '{"messages":[]}']], "record string, m int, l int, turns int, fields int")
    got = chat.format_records(df).collect()
    assert all(r.m == 1 and r.l == 2 and r.fields == 4 for r in got) and len(got) == len(odd) + 1
    assert {r.record: r.formatted for r in got} == {**dict.fromkeys(odd), '{"messages":[]}': ""}
    long = "x#<" * 300_000
    [r] = chat.digest(chat.format_records(chat.from_turns(spark.createDataFrame([(1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")))).collect()
    assert r.loss_chars == len(long) and r.loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    nulls = spark.createDataFrame([(None, 1, "user", "a"), (None, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    assert chat.from_turns(nulls).count() == 2 and chat.digest(chat.format_records(chat.from_turns(nulls.limit(0)))).count() == 0


def test_urls_mine_what_labels_tell(spark):
    """Planted: URLs of one host and of one query name are bad; the rest are as bad as all."""
    rng = random.Random(3)
    rows, bad = [], []
    for i in range(1200):
        host, name = rng.choice(["a.spam-farm.example.com", "b.fine.example.com", "c.fine.example.com"]), rng.choice(["aff=1", "page=2", "page=3&x=y&z=w&q=r"])
        p = 0.9 if "spam" in host or name == "aff=1" else 0.1
        rows.append((i, f"http://{host}/en/{i}?{name}"))
        bad.append((i, 1, int(rng.random() < p)))
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([*bad, bad[0], (5, 1, None)], "doc_id long, quality int, toxic int")
    parsed = urlrules.parse(pages).withColumn("row", F.col("page_id"))
    rules = {r.rule: r for r in urlrules.mine(parsed, labels, min_lift=1.5).collect()}
    truth, sets = {i: t for i, _, t in bad}, {r.page_id: set(r.tokens) for r in parsed.collect()}
    base = sum(truth.values()) / len(truth)
    assert rules and any("spam-farm" in r for r in rules) and any("aff" in r for r in rules)
    for r in rules.values():
        own = [i for i, s in sets.items() if set(r.tokens) <= s]
        assert r.confidence == pytest.approx(sum(truth[i] for i in own) / len(own)) and len(own) >= 8 and r.confidence > base
        assert not any(set(o.tokens) < set(r.tokens) and o.confidence >= r.confidence for o in rules.values())
    got = {r.page_id: r for r in urlrules.filter_urls(pages, labels, [], min_lift=1.5).collect()}
    for i, s in sets.items():
        fits = [(r.confidence, r.rule) for r in rules.values() if set(r.tokens) <= s]
        assert got[i].verdict == ("block" if fits else "allow") and (not fits or got[i].mined_rule == max(fits)[1])
    noise = spark.createDataFrame([(i, 1, int(rng.random() < 0.25)) for i in range(1200)], "doc_id long, quality int, toxic int")
    assert not urlrules.mine(parsed, noise).count()


def test_host_verdicts_against_plain_python(spark):
    rng = random.Random(8)
    good, junk = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, junk if rng.random() < {"bad": 0.9, "half": 0.5, None: 0.95}.get(h, 0.1) else good, h) for i, h in enumerate(rng.choices([None, "bad", "half", *(f"h{j}" for j in range(20))], k=2000))]
    rows.append((5000, junk, "one"))
    got = hostrules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, host string").withColumns({"n": F.lit(1), "key": F.lit(2)}), "host").collect()
    counts = {}
    for _, t, h in rows:
        n, f = counts.get(h, (0, 0))
        counts[h] = (n + 1, f + (t == junk))
    rates = [f / n for n, f in counts.values()]
    mean = sum(rates) / len(rates)
    own = max(1e-9, sum((r - mean) ** 2 for r in rates) / len(rates) - mean * (1 - mean) * sum(1 / n for n, _ in counts.values()) / len(rates))
    weight = min(1e6, max(2.0, mean * (1 - mean) / own - 1))
    dropped = set()
    for h, (n, f) in counts.items():
        rate = (f + mean * weight) / (n + weight)
        if rate - 1.645 * (rate * (1 - rate) / (n + weight + 1)) ** 0.5 > 0.5:
            dropped.add(h)
    assert dropped == {"bad", None} and len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50) and r.kept == (not r.base_failed and r.host not in dropped) and (r.host_verdict == "drop") == (r.host in dropped)


def test_ownership_decides_what_is_live(spark):
    """Against counts by hand: many owners, many repositories of one owner, and one owner's own."""
    rows = [(i, f"AKIA{i % 3:016d}", f"o{i % 3}" if i % 3 else f"p{i}") for i in range(90)] + [(i, "AKIAOWNSECRET00000X y", "o1") for i in range(100, 103)]
    rows += [rows[-1], (None, "AKIAOWNSECRET00000X y", None), (7777, None, "o1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("text_hash", "repo", "owner", "live_id", "hash")})
    owners, repos = {}, {}
    for i, t, o in rows:
        if t:
            owners.setdefault(t[:20].strip(), set()).add(o)
            repos.setdefault(t[:20].strip(), set()).add(i)
    live = {t for t in owners if len(owners[t]) <= 2 and len(repos[t]) <= 20}
    assert live == {"AKIAOWNSECRET00000X"}
    for r in secretscan.scan(df).collect():
        assert len(r.weighed) == (r.doc_id != 7777) and all(s.live == (100 <= (101 if r.doc_id is None else r.doc_id) < 103) for s in r.weighed)
    out = secretscan.redact(df)
    assert out.columns == df.columns and sorted(r.text or "" for r in out.collect()) == sorted((t or "").replace("AKIAOWNSECRET00000X", "[secret]") for _, t, _ in rows)


def test_hot_keys_join_as_others_do(spark):
    big = spark.createDataFrame([(i, i % 5 if i % 2 else 0) for i in range(200)], "row long, key long")
    small = staged(big.groupBy("key").agg(F.count("*").alias("n")).where("key <> 3"), "small")
    want = sorted(map(tuple, big.join(small, "key").collect()))
    for hot, most in ((10**6, 100), (50, 100), (10, 1), (1, 100)):
        got = join_hot(big, small, "key", "n", hot, most)
        assert sorted(map(tuple, got.select("key", "row", "n").collect())) == want
