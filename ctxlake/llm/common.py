"""What the operators share: the scratch folder, staged tables, text units and the unit-cached tokenizer."""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
import tempfile
import uuid
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach, from ``spark.checkpoint.dir``; where that is unset (tests), one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ctxlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/ctxlake/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and outlives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ctxlake_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete the files behind staged()."""
    path = getattr(df, "_ctxlake_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a side that may be broadcast, and rows of one key that a sort-merge join shouldn't bring into one task.
SMALL, HOT = 50_000, 100_000


def small_side(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df`` (staged: it is counted) with a broadcast hint if it has ``most`` rows or fewer."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def join_hot(big: DataFrame, small: DataFrame, key: str, weight: str, hot: int = HOT, most: int = SMALL) -> DataFrame:
    """``big`` joined with ``small`` on ``key``. ``small`` (staged) has one row per key and in ``weight`` how many rows of
    ``big`` have it: keys of ``hot`` rows or more, which are few, are broadcast, so that only the others are shuffled."""
    heavy = small.where(F.col(weight) >= hot)
    n = heavy.limit(most + 1).count()
    if not n or n > most:
        return big.join(small, key)
    rest = big.join(F.broadcast(heavy.select(key)), key, "left_anti").join(small.where(F.col(weight) < hot), key)
    return big.join(F.broadcast(heavy), key).unionByName(rest)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


#: A unit may be cut before a space that stands between two characters that aren't white space.
_SAFE = re.compile(r"(?<=\S)(?= \S)")


def _plain(text: str) -> bool:
    """All white space is single spaces and line feeds between words. Other white space isn't printable."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or not text or text[0] in " \n" or text[-1] in " \n":
        return False
    return text.replace("\n", "").isprintable()


#: Bytes of texts that are encoded together (the more, the more units are met once), and of a text that comes in parts.
_MARKS, TOGETHER, LONG_TEXT = ".,!?;:*#%$&|", 10 << 20, 8 << 20

_ENDS = frozenset(_MARKS)


class UnitEncoder:
    """Token ids of texts. Texts are cut into units where tokenizers that split on white space always cut, so that units
    encode alone as they do in place: a space joins the unit after it, and where all white space is single spaces and
    line feeds between words, line feeds are units of their own; other texts are only cut between a non-space and a
    space that a non-space follows. Arrow finds a batch's distinct units; each goes through the tokenizer once while it
    stays in the cache, which holds two generations of at most ``entries`` units each. New units are encoded many at a
    time, joined by a separator that the tokenizer turns into one id of its own; which one is tried out at the start."""

    def __init__(self, path: str, entries: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.entries, self.young, self.old = entries, {}, {}
        self.sep, self.sep_id, self.long = None, None, []
        one = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        for sep in ("\n", " \x01 "):
            s = one("a" + sep + "b")[len(one("a")) : -len(one("b"))]
            if len(s) == 1 and one(sep.join(("a", " b,", "c!", " d"))) == [*one("a"), *s, *one(" b,"), *s, *one("c!"), *s, *one(" d")]:
                self.sep, self.sep_id = sep, s[0]
                break
        steps = json.loads(self.tok.to_str())
        kinds = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])]
        #: The tokenizer itself lowers all letters and drops white space, so units may do so before they are compared.
        self.folds = "Lowercase" in kinds and one("Ab,\n Cd") == one("ab, cd") == [*one("ab,"), *one("cd")]

    def _fill(self, new: list[str], known: dict[str, bytes]) -> None:
        plain, odd = [], []
        for a, b in slices(len(new), 512):
            part = new[a:b]
            # Where units hold no blanks at all, one look at a whole slice says that all of them are plain.
            if self.folds and self.sep and all(part) and max(map(len, part)) <= 64 and (all_ := "".join(part)).isprintable() and " " not in all_:
                plain += part
                continue
            for u in part:
                bare = u[1:] if u[:1] == " " else u
                (plain if self.sep and len(u) <= 64 and bare.isprintable() and bare and " " not in bare else odd).append(u)
        for a, b in slices(len(plain), 512):
            part = plain[a:b]
            ids = np.asarray(self.tok.encode_batch_fast([self.sep.join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(ids == self.sep_id)
            if len(cut) != len(part) - 1:
                odd += part
                continue
            raw, ends = ids.tobytes(), (cut * 4).tolist()
            for u, x, y in zip(part, [0, *(e + 4 for e in ends)], [*ends, len(raw)]):
                known[u] = raw[x:y]
        for u, e in zip(odd, self.tok.encode_batch_fast(odd, add_special_tokens=False)):
            known[u] = array("I", e.ids).tobytes()
        self.long += [u for u in odd if len(u) > 64]

    def _known(self, distinct: list[str]) -> list[bytes]:
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}
        known, old = self.young, self.old
        new = [u for u in distinct if u not in known]
        if old:
            kept = [u for u in new if u in old]
            known.update(zip(kept, map(old.__getitem__, kept)))
            new = [u for u in new if u not in known]
        # Marks after a Latin letter are a token run of their own: encode the stem, which more units share.
        ended = {}
        for u in new:
            if u[-1:] in _ENDS:
                stem = u.rstrip(_MARKS)
                if stem[-1:].isalpha() and stem[-1] < "\u0250":
                    ended[u] = stem
        parts = {x for u, stem in ended.items() for x in (stem, u[len(stem) :])}
        self.long = [u for u in ended if len(u) > 64]
        self._fill(list(parts.union(new).difference(ended).difference(known)), known)
        for u, stem in ended.items():
            known[u] = known[stem] + known[u[len(stem) :]]
        out = list(map(known.__getitem__, distinct))
        for u in self.long:
            known.pop(u, None)
        return out

    def encode(self, texts: pa.Array, end: int | None = None) -> list[memoryview]:
        """The ids of each text (null: none) as little-endian uint32. end: an id to append to each. Texts of more than
        LONG_TEXT bytes are encoded in parts, so that what is held besides ids doesn't grow with them."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        if not len(sizes) or sizes.max() <= LONG_TEXT:
            return self._encode(texts, end)
        long = np.flatnonzero(sizes > LONG_TEXT)
        out = self._encode(pc.if_else(pa.array(sizes > LONG_TEXT), "", texts), end)
        for i in long.tolist():
            text, ids, a = texts[i].as_py(), [], 0
            while a < len(text):
                found = _SAFE.search(text, a + LONG_TEXT // 4) if a + LONG_TEXT // 4 < len(text) else None
                b = found.start() if found else len(text)
                ids.append(bytes(self._encode(pa.array([text[a:b]], texts.type))[0]))
                a = b
            out[i] = memoryview(b"".join([*ids, out[i]]))
        return out

    def _encode(self, texts: pa.Array, end: int | None = None) -> list[memoryview]:
        if self.folds:  # white space is dropped, so any of it may part units
            rows, plain = [None] * len(texts), texts.is_valid().to_numpy(zero_copy_only=False)
        else:
            rows = texts.to_pylist()
            plain = np.array([t is not None and _plain(t) for t in rows], bool)
        marked = pc.if_else(pa.array(plain), texts, "")
        if self.folds:
            lists = pc.split_pattern(pc.replace_substring(pc.ascii_lower(marked), "\n", " "), " ")
        else:
            lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(marked, " ", "\x01 "), "\n", "\x01\n\x01"), "\x01")
        odd = [[] if p or not t else _SAFE.split(t) for p, t in zip(plain, rows)]
        per_row = np.where(plain, pc.list_value_length(lists).to_numpy(zero_copy_only=False), [len(o) for o in odd])
        if plain.all():
            flat = lists.flatten()
        else:
            kept = lists.filter(pa.array(plain)).flatten()
            flat = pa.concat_arrays([kept, pa.array([u for o in odd for u in o], kept.type)])
        coded = flat.dictionary_encode()
        raw = self._known(coded.dictionary.to_pylist())
        n_ids = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        first = np.cumsum(n_ids) - n_ids
        raw.append(b"" if end is None else np.array([end], "<u4").tobytes())
        book = np.frombuffer(b"".join(raw), "<u4")
        which = coded.indices.to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])  # rows as flat has them
        upto = np.cumsum(per_row[order])
        starts, sizes = first[which], n_ids[which]
        if end is not None:
            starts, sizes = np.insert(starts, upto, len(book) - 1), np.insert(sizes, upto, 1)
            upto = upto + np.arange(1, len(upto) + 1)
        ends = np.cumsum(sizes)
        # Places in the book fit 32 bits, which halves the largest arrays here.
        kind = np.int32 if len(book) < 1 << 31 and (not len(ends) or ends[-1] < 1 << 31) else np.int64
        ids = book[np.repeat((starts - (ends - sizes)).astype(kind), sizes) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=kind)]
        cuts = 4 * np.concatenate([[0], ends])[np.concatenate([[0], upto])]
        view = memoryview(ids.astype("<u4", copy=False)).cast("B")
        out: list[memoryview] = [view[:0]] * len(rows)
        for row, x, y in zip(order.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            out[row] = view[x:y]
        return out


_user = [""]


def fresh(user: str) -> None:
    """Python workers serve one operator after another. Called as a task begins: where the last one was another's, what
    that kept is dropped and freed pages go back, so that an executor never holds several operators' memory."""
    if _user[0] != user:
        _user[0] = user
        _encoders.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One per Python worker and vocabulary file."""
    fresh(path)
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def slices(n: int, size: int) -> Iterable[tuple[int, int]]:
    return ((i, min(i + size, n)) for i in range(0, n, size))
