"""Queries against SQL, brute force and whole-text tokenizing."""

import glob
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ctxlake.llm import common, licenses, packing, queries
from ctxlake.sources import table

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        db.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    cur = db.execute(queries.ORACLE[name])
    columns = [c[0] for c in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    got = queries.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(columns) and want
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == want


def plain_licenses(rows, least=licenses.LEAST):
    """Every passage against every template, every file against every folder above it."""
    words = lambda t: Counter(re.findall(licenses.WORD, t.lower()))
    cue, name = re.compile(licenses.CUE), re.compile(licenses.FILE_NAME)
    own = []
    for _, path, text in rows:
        lines = {x for x in (text or "").split("\n") if cue.search(x)}
        is_file = bool(path and name.search(path.split("/")[-1]))
        own.append((is_file, lines | ({text} if is_file and text is not None else set())))
    counts = Counter(p for _, ps in own for p in ps)
    vectors = [(words(p), n) for p, n in counts.items()] + [(words(b), 1) for _, b in licenses.TEMPLATES]
    total, df = sum(n for _, n in vectors), Counter()
    for v, n in vectors:
        for w in v:
            df[w] += n
    weigh = lambda v: {w: k * (math.log((total + 1) / (df[w] + 1)) + 1) for w, k in v.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(lic, weigh(words(b))) for lic, b in licenses.TEMPLATES]

    def best(p):
        v = weigh(words(p))
        scored = [(-round(sum(x * t.get(w, 0) for w, x in v.items()) / norm(v) / norm(t), 6), lic) for lic, t in templates] if v else []
        return min((s for s in scored if -s[0] >= least), default=None)

    out = []
    for (_, path, _), (is_file, ps) in zip(rows, own):
        found = [(lic == "Proprietary" and not re.search(licenses.CLOSED, p), s, lic) for p in ps if (b := best(p)) for s, lic in [b]]
        out.append((is_file, min(found, default=None), path))
    result = {}
    for (i, path, _), (is_file, found, _) in zip(rows, out):
        if found:
            result[i] = (found[2], "file" if is_file else "header")
            continue
        folder, got = (path.rsplit("/", 1)[0] if "/" in path else "") if path is not None else None, None
        while folder is not None and got is None:
            got = min(((f, p) for file, f, p in out if file and f and (p.rsplit("/", 1)[0] if "/" in p else "") == folder), default=None)
            folder = None if folder == "" else folder.rsplit("/", 1)[0] if "/" in folder else ""
        result[i] = (got[0][2], "inherited") if got else (None, "none")
    return result


def test_licenses_against_plain_python(spark, monkeypatch):
    rng = random.Random(6)
    lines = [b for _, b in licenses.TEMPLATES] + ["code here", "Copyright 2020 Ann", "Licensed for nobody", "x = 1", "All rights reserved.", "this software is free"]
    mangled = lambda x: " ".join(w for w in x.split() if rng.random() > 0.2)
    rows = []
    for i in range(150):
        folder = "/".join(rng.choices(["a", "b", "c"], k=rng.randint(0, 3)))
        base = rng.choice(["LICENSE", "x.py", f"f{i}.txt", "COPYING.md"])
        text = rng.choice([None, "", "\n".join(mangled(rng.choice(lines)) if rng.random() < 0.5 else rng.choice(lines) for _ in range(rng.randint(1, 3)))])
        rows.append((i, rng.choice([None, f"{folder}/{base}".lstrip("/"), f"{folder}/{base}".lstrip("/")]), text))
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    want = plain_licenses(rows)
    assert {o for _, o in want.values()} == {"file", "header", "inherited", "none"}
    for hot in (100_000, 1):
        monkeypatch.setattr(common.join_hot, "__defaults__", (hot, common.SMALL))
        assert {r.doc_id: (r.license, r.origin) for r in licenses.scan(df).collect()} == want
    assert licenses.scan(df.limit(0)).count() == 0


def test_packed_documents_equal_whole_texts(spark):
    """Every document's pieces, ids and places; and no more sequences than the least possible and one per task."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    docs = table(spark, DIR, "documents").select("doc_id", "text").collect()
    rows = queries.op1_best_fit_packing(spark, DIR).collect()
    pieces, filled = {}, Counter()
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        filled[r.sequence_id] += r.length
    total = 0
    for d in docs:
        ids = np.array([*tok.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces[d.doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.pieces(len(ids), 1024))]
        total += len(ids)
    floor = -(-total // 1024)
    assert max(filled.values()) <= 1024 and len(filled) <= 1.02 * floor + docs.__len__() // 100 + 2
    with_ids = packing.sequences(packing.pack(table(spark, DIR, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)).collect()
    assert all(len(r.ids) == 4 * r.length for r in with_ids) and sum(r.length for r in with_ids) == total


def test_long_texts_are_encoded_in_parts(monkeypatch):
    import pyarrow as pa

    texts = ["ab cd, " * 60 + "x", None, "é  b\n" * 40, "w" * 90]
    enc = common.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"), 500)
    whole = [bytes(x) for x in enc.encode(pa.array(texts), 2)]
    monkeypatch.setattr(common, "LONG_TEXT", 40)
    assert [bytes(x) for x in enc.encode(pa.array(texts), 2)] == whole
