"""The endpoints as Python functions over a project: scan, search, walk, explain."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import CodeGraph
from .manifest import Manifest
from .operators import context, incremental, rank, resolve, search, traverse
from .sources import extract, files
from .storage import cut
from .streaming import watch

KINDS = ("find_interfaces", "get_interface", "get_dependencies", "get_call_chain", "get_file_interfaces")


class ScanCancelled(RuntimeError):
    """A scan was asked to stop."""


class Project:
    """A scanned project. Reads work on one graph; a scan replaces it."""

    def __init__(self, graph: CodeGraph, root: str = "", settings: files.Settings = files.Settings()):
        self.graph, self.root, self.settings = graph, root, settings
        self.parsed: DataFrame | None = None  # what was found in each file, with its hash, as long as the file stays as it is
        self.read_files = 0  # files that the last scan parsed
        self.scanned_at = 0  # when that began, in seconds
        self._cancelled, self._index = False, None
        self.manifest: Manifest | None = None

    @classmethod
    def scan(cls, spark: SparkSession, root: str, settings: files.Settings = files.Settings()) -> Project:
        """Reads, parses and resolves all files under ``root``."""
        project = cls(CodeGraph.empty(spark), root, settings)
        project.rebuild(spark)
        return project

    @classmethod
    def open(cls, spark: SparkSession, manifest: Manifest, id: str) -> Project:
        """Scans a project of a registry, with its settings, and notes its counts there."""
        e = manifest.entries[id]
        project = cls.scan(spark, e.path, e.settings)
        project.manifest = manifest
        manifest.scanned(id, project.get_scan_status())
        manifest.save()
        return project

    def cancel(self) -> None:
        """Asks a scan under way to stop: it does so before its next step, and the graph stays as it was."""
        self._cancelled = True

    def _step(self) -> None:
        if self._cancelled:
            self._cancelled = False
            raise ScanCancelled(self.root)

    def rebuild(self, spark: SparkSession) -> None:
        """Scans everything anew."""
        self._cancelled = False
        self._take(spark, None, files.listed(spark, self.root, self.settings))

    def _take(self, spark: SparkSession, kept: DataFrame | None, found: DataFrame) -> None:
        """Parses the files of ``found``, and makes the graph of them and of the parsed rows that are ``kept``."""
        self._step()
        self.scanned_at = int(time.time())
        content = cut(files.read(spark, found))
        self.read_files = content.count()
        new = extract.extract(content).join(content.select("path", "hash", "last_modified"), "path")
        parsed = cut(new if kept is None else new.unionByName(kept))
        self._step()
        graph, raw = extract.tables(parsed)
        symbols, imports, raw, edges = cut(graph.symbols), cut(graph.imports), cut(raw), None
        outside = symbols.limit(0)
        for language in sorted(r.language for r in raw.select("language").distinct().collect()):
            self._step()
            own = raw.where(F.col("language") == language).drop("language")
            done = resolve.resolve(symbols, own, imports, language)
            tagged = cut(done.tagged)
            part = resolve.split(tagged)
            outside = outside.unionByName(part.non_local)
            edges = part.resolved if edges is None else edges.unionByName(part.resolved)
        self.parsed = parsed
        every = symbols.unionByName(cut(outside).dropDuplicates(["qualified_name"]))
        self.graph = CodeGraph(cut(every), graph.dependencies if edges is None else cut(edges), imports, graph.file_state)

    def refresh(self, spark: SparkSession) -> DataFrame:
        """Takes up what was added, modified or deleted since the last scan; the plan. Only files that are new or whose time
        differs are opened, or whose time is too near the last scan's to tell; of these, only such with another hash are
        parsed. All raw dependencies are resolved again, so that edges into symbols that come back come back as well."""
        self._cancelled = False
        if self.parsed is None:
            self.rebuild(spark)
            return incremental.update_plan(self.graph.file_state, self.graph.file_state.limit(0))
        before = self.parsed.select("path", F.col("hash").alias("old"), F.col("last_modified").alias("then"))
        latest = min(self.parsed.agg(F.max("last_modified")).first()[0] or 0, self.scanned_at)
        found = cut(files.listed(spark, self.root, self.settings))
        doubtful = found.join(before, "path", "left").where(F.col("then").isNull() | (F.col("then") != F.col("last_modified")) | (F.col("last_modified") >= latest - 2))
        hashed = cut(files.read(spark, doubtful.select(*found.columns)).select("path", "hash"))
        now = found.join(hashed, "path", "left").join(before, "path", "left").select("path", F.coalesce("hash", "old").alias("hash"))
        plan = cut(incremental.update_plan(now, self.parsed.select("path", "hash")))
        if not plan.isEmpty():
            gone = plan.select("path")
            self._take(spark, self.parsed.join(gone, "path", "left_anti"), found.join(gone, "path", "left_semi"))
        return plan

    def watcher(self, spark: SparkSession) -> watch.Watcher:
        """What a stream of changes is to call (``streaming.watch.watch(changes, project.watcher(spark).changed, ...)``)."""
        return watch.Watcher(lambda: self.refresh(spark), self.settings.idle_minutes * 60.0)

    def index(self) -> search.SearchIndex:
        """The search index of the graph, made when it is first asked for and again after a scan."""
        if self._index is None or self._index[0] is not self.graph:
            self._index = (self.graph, search.SearchIndex.build(self.graph.symbols))
        return self._index[1]

    def find_interfaces(self, query: str, limit: int = search.DEFAULT_LIMIT) -> DataFrame:
        return search.find_interfaces(self.graph, query, limit, self.index())

    def get_interface(self, symbol: str) -> DataFrame:
        return self.graph.symbols.where(F.col("id") == traverse.resolve_one(self.graph, symbol))

    def get_dependencies(self, symbol: str, direction: str = "outgoing", max_depth: int = 3) -> DataFrame:
        at = traverse.resolve_one(self.graph, symbol)
        if direction not in ("outgoing", "incoming", "both"):
            raise ValueError("direction must be one of: outgoing, incoming, both")
        sides = [traverse.chain(self.graph, at, max_depth, d).withColumn("direction", F.lit(d)) for d in (("outgoing", "incoming") if direction == "both" else (direction,))]
        return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])

    def get_call_chain(self, source: str, target: str, max_depth: int = 5) -> DataFrame:
        return traverse.shortest_path(self.graph, traverse.resolve_one(self.graph, source), traverse.resolve_one(self.graph, target), max_depth)

    def get_file_interfaces(self, file: str) -> DataFrame:
        return self.graph.symbols.where(F.col("file_path") == file).orderBy("line", "col", "name")

    def list_project_interfaces(self) -> DataFrame:
        return self.graph.scan("symbols")

    def get_verification_context(self, symbol: str) -> dict[str, DataFrame]:
        return context.verification_context(self.graph, symbol)

    def get_project_overview(self, symbol_limit: int | None = None, edge_limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        return rank.overview(self.graph, symbol_limit, edge_limit)

    def get_task_context(self, question: str | None = None, **given) -> dict[str, DataFrame]:
        return context.task_context(self.graph, question, **given)

    def analyze_workflow_context(self, question: str, **given) -> dict[str, DataFrame]:
        return self.get_task_context(question, mode="workflow", **given)

    def analyze_change_impact(self, question: str | None = None, **given) -> dict[str, DataFrame]:
        return self.get_task_context(question, mode="impact", **given)

    def analyze_behavior_context(self, question: str | None = None, **given) -> dict[str, DataFrame]:
        return self.get_task_context(question, mode="behavior", **given)

    def locate_relevant_code(self, question: str | None = None, **given) -> dict[str, DataFrame]:
        return self.get_task_context(question, mode="locate", **given)

    def list_projects(self) -> DataFrame:
        """The registry that the project was opened from, or the project alone."""
        if self.manifest is not None:
            return self.manifest.table()
        return self.graph.symbols.sparkSession.createDataFrame([(self.root.rstrip("/").rpartition("/")[2], self.root)], "name string, path string")

    def get_scan_status(self) -> DataFrame:
        return self.graph.stats()

    def batch_query(self, queries: list[dict]) -> list[dict]:
        """Runs queries of five kinds ({"kind": ..., arguments}) in order; an error concerns only its own item."""
        out = []
        for q in queries:
            arguments = {k: v for k, v in q.items() if k != "kind"}
            try:
                if q.get("kind") not in KINDS:
                    raise ValueError(f"unknown kind: {q.get('kind')}")
                out.append({"status": "ok", "result": getattr(self, q["kind"])(**arguments)})
            except (ValueError, TypeError) as e:
                out.append({"status": "error", "error": str(e)})
        return out

    def resource(self, uri: str):
        """``projects``, ``interfaces``, ``interface/NAME``, ``interface/NAME/dependencies``, ``status``."""
        parts = uri.strip("/").split("/")
        if parts == ["projects"]:
            return self.list_projects()
        if parts == ["interfaces"]:
            return self.list_project_interfaces()
        if parts == ["status"]:
            return self.get_scan_status()
        if parts[0] == "interface" and len(parts) >= 2:
            return self.get_dependencies("/".join(parts[1:-1])) if parts[-1] == "dependencies" else self.get_interface("/".join(parts[1:]))
        raise ValueError(f"unknown resource: {uri}")
