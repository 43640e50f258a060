"""Bounded traversals of the dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..storage import cut

#: No walk goes deeper: the number of walks can grow with each step.
MAX_DEPTH = 10
#: Nodes of a frontier that the scan of the edges is told of.
FEW = 500
DIRECTIONS = ("outgoing", "incoming")


def _check(depth: int, direction: str = "outgoing") -> None:
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"max_depth must be from 0 to {MAX_DEPTH}")
    if direction not in DIRECTIONS:
        raise ValueError("direction must be outgoing or incoming")


def oriented(dependencies: DataFrame, direction: str) -> DataFrame:
    """(src, dst, kind): the edges in the direction of travel."""
    a, b = ("from_symbol", "to_symbol") if direction == "outgoing" else ("to_symbol", "from_symbol")
    return dependencies.select(F.col(a).alias("src"), F.col(b).alias("dst"), "kind")


def step(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges out of ``frontier`` (node, ...), a table that was written, with its columns. A frontier of up to FEW nodes
    reaches the scan of the edges as a list of ids, so that only the row groups that may hold them are read."""
    few = [r.node for r in frontier.select("node").limit(FEW + 1).collect()]
    return frontier.join(edges.where(F.col("src").isin(few)) if len(few) <= FEW else edges, F.col("node") == F.col("src"))


def walks(graph: CodeGraph, seeds: DataFrame, max_depth: int, direction: str = "outgoing") -> DataFrame:
    """(seed, symbol_id, depth, dep_kind, walks): all walks from seeds(id), walks that agree in these counted together.

    Counting before each join keeps a level at most as large as the nodes it reaches, where one row a walk would grow
    with the product of the degrees. Each level is written before the next reads it, so that the work is one join a level
    and a level without rows is the last."""
    _check(max_depth, direction)
    edges = oriented(graph.dependencies, direction)
    level = cut(seeds.select(F.col("id").alias("seed"), F.col("id").alias("symbol_id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("dep_kind"), F.lit(1).cast("long").alias("walks")))
    out = level
    for depth in range(1, max_depth + 1):
        ends = level.groupBy("seed", F.col("symbol_id").alias("node")).agg(F.sum("walks").alias("walks"))
        reached = step(ends, edges).groupBy("seed", "dst", "kind").agg(F.sum("walks").alias("walks"))
        level = cut(reached.select("seed", F.col("dst").alias("symbol_id"), F.lit(depth).alias("depth"), F.col("kind").alias("dep_kind"), "walks"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def _named(rows: DataFrame, graph: CodeGraph) -> DataFrame:
    """Inner join: ids that are no symbol's are dropped."""
    return rows.join(graph.symbols.select(F.col("id").alias("symbol_id"), "name", "qualified_name", "file_path"), "symbol_id")


def chain(graph: CodeGraph, symbol_id: str, max_depth: int = 3, direction: str = "outgoing", distinct: bool = False) -> DataFrame:
    """The dependency chain of a symbol, itself at depth 0: a row for each walk, ordered by depth and name; cycles repeat
    until max_depth. ``distinct``: a row for each symbol at its least depth, with the least kind into it there."""
    start = graph.symbols.where(F.col("id") == symbol_id).select("id")
    if distinct:
        return min_depths(graph, start, max_depth, direction)
    rows = _named(walks(graph, start, max_depth, direction), graph)
    each = rows.select("symbol_id", "name", "qualified_name", "file_path", "depth", "dep_kind", F.explode(F.sequence(F.lit(1).cast("long"), "walks")).alias("_walk"))
    return each.drop("_walk").orderBy("depth", "name", "symbol_id", "dep_kind")


def min_depths(graph: CodeGraph, seeds: DataFrame, max_depth: int, direction: str) -> DataFrame:
    rows = walks(graph, seeds, max_depth, direction).groupBy("symbol_id").agg(F.min(F.struct("depth", "dep_kind")).alias("best"))
    return _named(rows.select("symbol_id", "best.depth", "best.dep_kind"), graph).select("symbol_id", "name", "qualified_name", "file_path", "depth", "dep_kind").orderBy("depth", "name", "symbol_id")


def impact_radius(graph: CodeGraph, files: list[str], max_depth: int = 3) -> DataFrame:
    """Symbols that reach a symbol of ``files``, at their least depth above 0, with the least kind of an edge there."""
    seeds = graph.symbols.where(F.col("file_path").isin(files)).select("id")
    edges = oriented(graph.dependencies, "incoming")
    _check(max_depth)
    level, out = cut(seeds.select(F.col("id").alias("node")).distinct()), None
    for depth in range(1, max_depth + 1):
        reached = cut(step(level, edges).groupBy("dst").agg(F.min("kind").alias("dep_kind")).select(F.col("dst").alias("symbol_id"), F.lit(depth).alias("depth"), "dep_kind"))
        if reached.isEmpty():
            break
        out = reached if out is None else out.unionByName(reached)
        level = reached.select(F.col("symbol_id").alias("node"))
    if out is None:
        out = seeds.limit(0).select(F.col("id").alias("symbol_id"), F.lit(0).alias("depth"), F.lit("").alias("dep_kind"))
    best = out.groupBy("symbol_id").agg(F.min(F.struct("depth", "dep_kind")).alias("best")).select("symbol_id", "best.depth", "best.dep_kind")
    return _named(best, graph).select("symbol_id", "name", "qualified_name", "file_path", "depth", "dep_kind")


def shortest_path(graph: CodeGraph, source: str, target: str, max_depth: int = 5) -> DataFrame:
    """(depth, symbol_id, name, qualified_name, dep_kind): the nodes of a shortest path over all kinds of edges, each with
    the kind of the edge into it; the source alone if it is the target; no rows if there is no path in max_depth.

    Level-synchronous: each level joins the frontier with the edges and drops what was visited. Among parents of the
    level before, the one of least id is taken, then the least kind. Levels are written to the shared folder; the driver
    sees one row a level."""
    _check(max_depth)
    spark = graph.symbols.sparkSession
    edges = oriented(graph.dependencies, "outgoing")
    frontier = cut(graph.symbols.where(F.col("id") == source).select(F.col("id").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("kind")))
    levels = [frontier]
    known = graph.symbols.where(F.col("id").isin(source, target)).select("id").distinct().count() == len({source, target})
    while known and levels[-1].where(F.col("node") == target).isEmpty():
        if len(levels) > max_depth:
            known = False
            break
        visited = levels[0].select("node")
        for level in levels[1:]:
            visited = visited.union(level.select("node"))
        found = step(frontier.select("node"), edges).groupBy("dst").agg(F.min(F.struct("src", "kind")).alias("m"))
        frontier = cut(found.select(F.col("dst").alias("node"), "m.src", "m.kind").withColumnRenamed("src", "parent").join(visited, "node", "left_anti"))
        if frontier.isEmpty():
            known = False
            break
        levels.append(frontier)
    path, node = [], target
    for depth in range(len(levels) - 1, -1, -1) if known else ():
        row = levels[depth].where(F.col("node") == node).first()
        path.append((depth, node, row.kind))
        node = row.parent
    found = spark.createDataFrame(path, "depth int, symbol_id string, dep_kind string")
    return found.join(graph.symbols.select(F.col("id").alias("symbol_id"), "name", "qualified_name"), "symbol_id").select("depth", "symbol_id", "name", "qualified_name", "dep_kind").orderBy("depth")


def direct_neighbours(graph: CodeGraph, symbol_id: str, direction: str, limit: int) -> DataFrame:
    """Symbols one edge away, the symbol itself left out, each once with its least kind, by name; the first ``limit``."""
    edges = oriented(graph.dependencies, direction).where((F.col("src") == symbol_id) & (F.col("dst") != symbol_id))
    once = edges.groupBy("dst").agg(F.min("kind").alias("dep_kind")).withColumnRenamed("dst", "symbol_id")
    return _named(once, graph).select("symbol_id", "name", "qualified_name", "file_path", "dep_kind").orderBy("name", "symbol_id").limit(limit)


def edges_of(graph: CodeGraph, *, source: str | None = None, target: str | None = None, file: str | None = None) -> DataFrame:
    """Edges by source, target or file; the filters reach the scan."""
    d = graph.dependencies
    for column, value in (("from_symbol", source), ("to_symbol", target), ("from_file", file)):
        d = d if value is None else d.where(F.col(column) == value)
    return d


def same_file(graph: CodeGraph, symbol_id: str, limit: int) -> DataFrame:
    """Other symbols of the symbol's file: public ones first, then by line and name."""
    s = graph.symbols
    own = s.where(F.col("id") == symbol_id).select("file_path")
    rest = s.join(own, "file_path", "left_semi").where(F.col("id") != symbol_id)
    return rest.orderBy(F.desc(F.col("visibility") == "public"), "line", "name", "id").limit(limit).select("id", "name", "qualified_name", "visibility", "line")


def resolve_identifier(graph: CodeGraph, text: str, candidates: int = 5) -> DataFrame:
    """(id, qualified_name, tier, matches): the symbol with this id, else with this qualified name, else the symbols with
    this name, at most ``candidates`` of them by qualified name; matches counts all of that tier."""
    if not text.strip():
        raise ValueError("interface must not be empty")
    s = graph.symbols
    tier = F.when(F.col("id") == text, 0).when(F.col("qualified_name") == text, 1).when(F.col("name") == text, 2)
    hits = s.where((F.col("id") == text) | (F.col("qualified_name") == text) | (F.col("name") == text)).select("id", "qualified_name", tier.alias("tier"))
    by = hits.groupBy("tier").agg(F.count(F.lit(1)).alias("matches"))
    best = by.agg(F.min(F.struct("tier", "matches")).alias("b")).select("b.tier", "b.matches")
    return hits.join(F.broadcast(best), "tier").orderBy("qualified_name").limit(candidates).select("id", "qualified_name", "tier", "matches")  # one row is broadcast


def resolve_one(graph: CodeGraph, text: str) -> str:
    """The id that ``text`` stands for; ValueError if there is none or more than one."""
    rows = resolve_identifier(graph, text).collect()
    if not rows:
        raise ValueError(f"symbol not found: {text}")
    if rows[0].matches > 1:
        raise ValueError(f"ambiguous symbol {text}; candidates: " + ", ".join(r.qualified_name for r in rows))
    return rows[0].id


def bridge_edges(graph: CodeGraph, ids: list[str], max_depth: int = 3) -> DataFrame:
    """(from_symbol, to_symbol): the edges of shortest paths between consecutive ids, each once."""
    out = graph.symbols.sparkSession.createDataFrame([], "from_symbol string, to_symbol string")
    for a, b in zip(ids, ids[1:], strict=False):
        nodes = [r.symbol_id for r in shortest_path(graph, a, b, max_depth).collect()]
        if len(nodes) > 1:
            out = out.union(graph.symbols.sparkSession.createDataFrame(list(zip(nodes, nodes[1:], strict=False)), out.schema))
    return out.distinct()


def workflow_candidates(graph: CodeGraph, seeds: DataFrame, max_depth: int) -> DataFrame:
    """Local functions and methods outside test files that seeds(id) reach or are reached from, at their least depth."""
    both = walks(graph, seeds, max_depth, "outgoing").unionByName(walks(graph, seeds, max_depth, "incoming"))
    depths = both.groupBy(F.col("symbol_id").alias("id")).agg(F.min("depth").alias("depth"))
    path = F.col("file_path")
    test = path.contains("/tests/") | path.contains("test/") | path.contains("_test.") | path.endswith(".spec.ts") | path.endswith(".test.ts")
    kept = graph.symbols.where(F.col("kind").isin("function", "method") & (F.col("source") == "local") & ~test)
    return kept.join(depths, "id").select("id", "name", "qualified_name", "file_path", "line", "depth").orderBy("depth", "file_path", "line", "qualified_name")


def both_directions(graph: CodeGraph, symbol_id: str, max_depth: int) -> DataFrame:
    """(symbol_id, in_depth, out_depth): least depths in each direction, null where a direction does not reach."""
    start = graph.symbols.where(F.col("id") == symbol_id).select("id")
    side = lambda d, n: walks(graph, start, max_depth, d).groupBy("symbol_id").agg(F.min("depth").alias(n))
    return side("incoming", "in_depth").join(side("outgoing", "out_depth"), "symbol_id", "full")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: what an upsert leaves."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
