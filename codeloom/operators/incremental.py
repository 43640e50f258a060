"""Snapshots: update plans, symbol diffs, replacement and deletion of files."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import CodeGraph
from .rank import signature_sums

COMPARED = ("name", "qualified_name", "kind", "file_path", "line", "col", "visibility", "signature", "source")


def update_plan(discovered: DataFrame, state: DataFrame) -> DataFrame:
    """(path, change): Added, Modified or Deleted by content hash; unchanged files give no row. One join on the path."""
    new, old = discovered.select("path", F.col("hash").alias("new")), state.select("path", F.col("hash").alias("old"))
    change = F.when(F.col("old").isNull(), "Added").when(F.col("new").isNull(), "Deleted").when(F.col("old") != F.col("new"), "Modified")
    return new.join(old, "path", "full").select("path", change.alias("change")).where("change is not null")


def symbol_diff(old: DataFrame, new: DataFrame, old_dependencies: DataFrame | None = None, new_dependencies: DataFrame | None = None) -> DataFrame:
    """(id, change): symbols added, removed, or modified in a column or, where edges are given, in their signature."""

    def side(symbols: DataFrame, edges: DataFrame | None) -> DataFrame:
        content = F.sha2(F.to_json(F.struct(*COMPARED), {"ignoreNullFields": "false"}), 256)
        s = symbols.select("id", content.alias("content"))
        if edges is None:
            return s.withColumn("edges", F.lit(""))
        signed = signature_sums(edges).select(F.col("from_symbol").alias("id"), F.sha2(F.to_json("signature"), 256).alias("edges"))
        return s.join(signed, "id", "left").withColumn("edges", F.coalesce("edges", F.lit("")))

    a, b = side(old, old_dependencies).alias("a"), side(new, new_dependencies).alias("b")
    change = F.when(F.col("a.content").isNull(), "added").when(F.col("b.content").isNull(), "removed").when((F.col("a.content") != F.col("b.content")) | (F.col("a.edges") != F.col("b.edges")), "modified")
    return a.join(b, "id", "full").select("id", change.alias("change")).where("change is not null")


def upsert_symbols(symbols: DataFrame, rows: DataFrame) -> DataFrame:
    """Symbols after ``rows`` (with ``ordinal``, the later the larger) were written: the last row of a qualified name."""
    both = symbols.withColumn("ordinal", F.lit(-1).cast("long")).unionByName(rows.withColumn("ordinal", F.col("ordinal").cast("long")))
    last = Window.partitionBy("qualified_name").orderBy(F.desc("ordinal"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "ordinal")


def _without(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_anti")


def delete_files(graph: CodeGraph, paths: list[str]) -> CodeGraph:
    """The graph without the files: their symbols, imports and states, edges from them, and edges that touch their
    symbols."""
    gone = graph.symbols.where(F.col("file_path").isin(paths)).select("id")
    edges = _without(_without(graph.dependencies.where(~F.col("from_file").isin(paths)), "from_symbol", gone), "to_symbol", gone)
    keep = lambda t, c: None if t is None else t.where(~F.col(c).isin(paths))
    return CodeGraph(keep(graph.symbols, "file_path"), edges, keep(graph.imports, "file_path"), keep(graph.file_state, "path"))


def replace_file(graph: CodeGraph, path: str, symbols: DataFrame, dependencies: DataFrame, imports: DataFrame | None = None, state: DataFrame | None = None) -> CodeGraph:
    """The graph with all rows of a file replaced. Edges into symbols that are still there survive; edges that touch
    symbols that disappeared go."""
    old = graph.symbols.where(F.col("file_path") == path).select("id")
    gone = old.join(symbols.select("id"), "id", "left_anti")
    edges = _without(_without(graph.dependencies.where(F.col("from_file") != path), "from_symbol", gone), "to_symbol", gone).unionByName(dependencies)

    def swap(t: DataFrame | None, c: str, new: DataFrame | None) -> DataFrame | None:
        return t if t is None or new is None else t.where(F.col(c) != path).unionByName(new)

    return CodeGraph(swap(graph.symbols, "file_path", symbols), edges, swap(graph.imports, "file_path", imports), swap(graph.file_state, "path", state))


def apply_diff(graph: CodeGraph, new: CodeGraph, paths: list[str]) -> CodeGraph:
    """The graph after ``paths`` were scanned again as ``new``: symbols by diff, edges of changed symbols anew, imports
    and states of the files replaced."""
    old_symbols = graph.symbols.where(F.col("file_path").isin(paths))
    own = graph.dependencies.join(old_symbols.select(F.col("id").alias("from_symbol")), "from_symbol", "left_semi")
    diff = symbol_diff(old_symbols, new.symbols, own, new.dependencies)
    removed, changed = diff.where("change = 'removed'").select("id"), diff.where("change <> 'removed'").select("id")
    kept = _without(_without(graph.dependencies, "from_symbol", diff.select("id")), "to_symbol", removed)
    fresh = new.dependencies.join(changed.select(F.col("id").alias("from_symbol")), "from_symbol", "left_semi")
    swap = lambda t, c, n: t if t is None or n is None else t.where(~F.col(c).isin(paths)).unionByName(n)
    return CodeGraph(swap(graph.symbols, "file_path", new.symbols), kept.unionByName(fresh), swap(graph.imports, "file_path", new.imports), swap(graph.file_state, "path", new.file_state))


def cleared(graph: CodeGraph) -> CodeGraph:
    return replace(graph, **{n: t.limit(0) for n, t in graph.tables().items()})


def orphans(graph: CodeGraph) -> DataFrame:
    """Symbols outside the project that no edge touches."""
    outside = graph.symbols.where(F.col("source") != "local")
    return _without(_without(outside, "id", graph.dependencies.select("from_symbol")), "id", graph.dependencies.select("to_symbol"))
