"""From source files to a symbol graph: extraction, nodes, name resolution and incremental rebuilds.

Files are rows (path, content). Symbols are rows (file, pos, name, kind, line, refs, inherits, implements), where pos is
their place in the file. Nodes are rows (id, name, kind, file, line, ord), edges (source, target, relation, provenance,
ord); ord sorts them as they would be inserted one by one, without a global numbering.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxlake.functions import extract

MOST_TARGETS = 8
SYMBOL = "name string, kind string, line int, refs array<string>, inherits array<string>, implements array<string>"
SYMBOLS = f"file string, pos int, {SYMBOL}"
_ARROW = pa.schema([("file", pa.string()), ("pos", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), *((n, pa.list_(pa.string())) for n in ("refs", "inherits", "implements"))])


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(p.as_py(), i, *s) for p, c in zip(batch.column(0), batch.column(1)) for i, s in enumerate(extract.symbols(p.as_py(), c.as_py()))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(_ARROW), _ARROW)], schema=_ARROW)


def extract_symbols(files: DataFrame) -> DataFrame:
    """The symbols of ``files`` (path, content). Files that have none give no rows; null paths and contents neither."""
    rows = files.where("path is not null").selectExpr("cast(path as string) path", "cast(content as binary) content")
    return rows.mapInArrow(_extract, SYMBOLS)


def walk_key(path: str = "file") -> str:
    """SQL for an array that sorts paths as a sorted walk visits them: a folder's files before its subfolders."""
    return f"transform(split({path}, '/'), (x, i) -> concat(if(i = size(split({path}, '/')) - 1, '0', '1'), x))"


_STEM = "regexp_replace(element_at(split(file, '/'), -1), '(?<=[^.])\\\\.[^.]*$', '')"


def identified(symbols: DataFrame) -> DataFrame:
    """``symbols`` with key and id. A name's first symbol in a file is file::name, others end with their line."""
    own = Window.partitionBy("file", "name").orderBy("pos")
    base = F.concat_ws("::", "file", "name")
    return symbols.withColumn("key", F.expr(walk_key())).withColumn("id", F.when(F.row_number().over(own) == 1, base).otherwise(F.concat_ws("@", base, "line")))


def nodes_of(rows: DataFrame) -> DataFrame:
    """One node per file with symbols, and one per distinct id of identified()."""
    modules = rows.select("file", "key").distinct().selectExpr("file id", f"{_STEM} name", "'module' kind", "file", "1 line", "key", "-1 pos")
    everything = modules.unionByName(rows.select("id", "name", "kind", "file", "line", "key", "pos"))
    first = everything.groupBy("id").agg(F.min(F.struct(F.struct("key", "pos").alias("ord"), "name", "kind", "file", "line")).alias("n"))
    return first.select("id", "n.name", "n.kind", "n.file", "n.line", "n.ord")


_ORD = "struct<turn: int, key: array<string>, pos: int, ref: int, across: int, to_key: array<string>, to_pos: int>"


def resolve(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from references to definitions of that short name: those of the same file, and those of other files where
    at most MOST_TARGETS definitions share the name. Names of more are never joined across files, so no key explodes."""
    defs = nodes.where("kind not in ('import', 'dependency')").select(F.col("id").alias("target"), F.col("kind").alias("to_kind"), F.col("file").alias("to_file"), F.col("ord.key").alias("to_key"), F.col("ord.pos").alias("to_pos"), F.expr("substring_index(name, '.', -1)").alias("ref"))
    few = defs.groupBy("ref").count().where(F.col("count") <= MOST_TARGETS).select("ref")
    refs = rows.select("file", "key", "pos", "id", "kind", "inherits", "implements", F.posexplode(F.array_distinct("refs")).alias("at", "ref"))
    same = refs.join(defs.withColumnRenamed("to_file", "file"), ["file", "ref"]).withColumn("across", F.lit(0))
    across = refs.join(defs.join(few, "ref"), "ref").where("file <> to_file").drop("to_file").withColumn("across", F.lit(1))
    relation = F.expr("""case when array_contains(inherits, ref) then 'inherits' when array_contains(implements, ref) then 'implements'
        when kind = 'import' then 'imports' when kind = 'dependency' then 'depends_on' when to_kind in ('function', 'method') then 'calls' else 'references' end""")
    ord_ = F.expr(f"cast(struct(1, key, pos, at, across, to_key, to_pos) as {_ORD})")
    return same.unionByName(across).select(F.col("id").alias("source"), "target", relation.alias("relation"), F.when(F.col("across") == 0, "EXTRACTED").otherwise("INFERRED").alias("provenance"), ord_.alias("ord"))


def first_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The first edge per (source, target, relation), without self-edges and loose ends."""
    ids = nodes.select("id")
    whole = edges.where("source <> target").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return whole.groupBy("source", "target", "relation").agg(F.min(F.struct("ord", "provenance")).alias("e")).select("source", "target", "relation", "e.provenance", "e.ord")


def build(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the symbols of any number of files."""
    rows = identified(symbols)
    nodes = nodes_of(rows)
    own = rows.select(F.col("file").alias("source"), F.col("id").alias("target"), "kind", "key", "pos")
    edge = lambda relation, k: own.select("source", "target", F.lit(relation).alias("relation"), F.lit("EXTRACTED").alias("provenance"), F.expr(f"cast(struct(0, key, pos, {k}, 0, key, pos) as {_ORD})").alias("ord"), "kind")
    structure = edge("defines", 0).unionByName(edge("depends_on", 1).where("kind = 'dependency'")).drop("kind")
    return nodes, first_edges(structure.unionByName(resolve(rows, nodes)), nodes)


def file_hash(content: str = "content") -> str:
    """SQL: the SHA-256 of a file's bytes, '' where they are missing or too many to be read."""
    return f"if({content} is null or octet_length({content}) > {extract.MOST_BYTES}, '', sha2({content}, 256))"


INDEX = f"path string, size long, mtime long, sha256 string, symbols array<struct<{', '.join(f'{n}: {t}' for n, t in (x.split(' ', 1) for x in SYMBOL.split(', ')))}>>"


def refresh(files: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The new index (path, size, mtime, sha256, symbols, reused) of ``files`` (path, size, mtime, content). A file whose size and mtime are
    those of the old ``index`` keeps its symbols unread; one of the same size and hash keeps them too; all others are
    extracted anew. Files without symbols stay in the index; deleted ones leave it."""
    spark = files.sparkSession
    old = (index if index is not None else spark.createDataFrame([], INDEX)).select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("sha256").alias("old_sha"), F.col("symbols").alias("old_symbols"))
    met = files.join(old, "path", "left").withColumn("same", F.expr("size <=> old_size and mtime <=> old_mtime"))
    met = met.withColumn("sha256", F.expr(f"if(same, old_sha, {file_hash()})")).withColumn("reused", F.expr("same or (size <=> old_size and old_sha <> '' and sha256 = old_sha)"))
    kept = met.where("reused").selectExpr("path", "size", "mtime", "sha256", "old_symbols symbols", "true reused")
    new = met.where("not reused").select("path", "size", "mtime", "sha256", "content")
    found = extract_symbols(new).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct("name", "kind", "line", "refs", "inherits", "implements").alias("s")))).alias("own"))
    fresh = new.drop("content").join(found, F.col("path") == F.col("file"), "left").selectExpr("path", "size", "mtime", "sha256", "coalesce(transform(own, x -> x.s), array()) symbols", "false reused")
    return kept.unionByName(fresh)


def symbols_of(index: DataFrame) -> DataFrame:
    """The symbols that an index holds, as extract_symbols() gives them."""
    return index.select(F.col("path").alias("file"), F.posexplode("symbols").alias("pos", "s")).select("file", "pos", "s.*")


def changed(files: DataFrame, index: DataFrame) -> bool:
    """Whether ``files`` (path, size, content) differ from the ``index`` in any size or hash, or in which there are. An
    empty index counts as changed."""
    now = files.selectExpr("path", "size", f"{file_hash()} sha256")
    was = index.selectExpr("path", "size old_size", "sha256 old_sha")
    differs = now.join(was, "path", "full").where("not (size <=> old_size and sha256 <=> old_sha)")
    return bool(differs.limit(1).count()) or not index.limit(1).count()


def module_name(spec: str, style: str = "path") -> str:
    """What an import names: by path (``./a/b.js`` is b), or the last segment by ``::``, ``.`` or a backslash."""
    return extract.by_path(spec) if style == "path" else extract.last_of(style)(spec)


def stamp(nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """``nodes`` with the community (id, community) of each, null where it has none."""
    return nodes.drop("community").join(communities.select("id", "community"), "id", "left")
