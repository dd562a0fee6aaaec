"""Column expressions that several native operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame

BLOCK = 512


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def running(pairs: str) -> str:
    """SQL for the ranges [start, end) that an array of struct<gap: long, size: long> lays end to end: each begins gap
    after the last one's end. Sums go over blocks first, so that long arrays don't cost their length squared."""
    blocks = f"transform(sequence(0, (size({pairs}) - 1) div {BLOCK}), b -> slice({pairs}, b * {BLOCK} + 1, {BLOCK}))"
    sums = f"transform({blocks}, bl -> aggregate(bl, 0L, (a, x) -> a + x.gap + x.size))"
    firsts = f"aggregate({sums}, array(0L), (a, s) -> concat(a, array(element_at(a, -1) + s)))"
    step = "named_struct('at', a.at + x.gap + x.size, 'out', concat(a.out, array(named_struct('start', a.at + x.gap, 'end', a.at + x.gap + x.size))))"
    none = "cast(array() as array<struct<start: bigint, end: bigint>>)"
    inner = f"zip_with({blocks}, slice({firsts}, 1, (size({pairs}) - 1) div {BLOCK} + 1), (bl, f) -> aggregate(bl, named_struct('at', f, 'out', {none}), (a, x) -> {step}, a -> a.out))"
    return f"if(size({pairs}) > 0, flatten({inner}), {none})"


def literal(text: str) -> str:
    """A SQL string literal, taken as it stands."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
