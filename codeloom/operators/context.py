"""Scene inference, workflow phases and task-context packages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence
from ..functions.evidence import any_of
from ..graph import CodeGraph
from ..storage import cut
from . import rank, search, traverse

#: Scenes in the order that decides ties, and the terms of each rule.
SCENES = ("locate", "behavior", "impact", "workflow", "call_chain", "watcher")
BEHAVIOR = ("why", "failure", "error", "panic", "race", "为什么", "失败", "报错", "panic", "时序", "竞态", "升级")
IMPACT = ("impact", "refactor", "risk", "rename", "change", "modify", "影响", "重构", "风险", "改", "修改")
CHAIN = ("call chain", "path", "delegate", "through", "from", "to", "调用链", "路径", "链路", "从", "到")
WATCHER = ("watcher", "refresh", "updated", "reindex", "rescan", "刷新", "更新", "重扫", "索引")
LOCATE = ("where", "who calls", "defined", "which file", "which files", "哪里", "谁调用", "在哪", "哪些文件")
STATUS = ("queued", "running", "waitingapproval", "waiting approval", "blocked", "stuck", "排队", "队列", "运行", "卡住", "停留", "状态")
TRANSITION = ("after", "still", "enter", "into", "transition", "flow", "resume", "dispatch", "through", "之后", "通过后", "仍然", "进入", "流转", "恢复", "调度")
SCHEDULING = ("approval", "approve", "resume", "dispatch", "scheduler", "worker", "claim", "queue", "queued", "admit", "dispatchable", "execution", "turn", "审批", "通过", "恢复", "调度", "执行")
APPROVAL_WORDS, QUEUE_WORDS = ("approval", "审批"), ("queue", "queued", "排队", "队列")
BOUNDARY_FILES = ("control-plane", "server", "cli", "platform", "rpc", "sdk")
INTERNAL_FILES = ("store", "core_flow_service", "flow", "execution", "scheduler", "runtime")


@dataclass(frozen=True)
class Rule:
    """Points for a symbol one of whose columns has, is, begins or ends with one of the terms. What ``counts`` shows that
    the symbol belongs to the phase at all."""

    columns: tuple[str, ...]
    how: str
    terms: tuple[str, ...]
    points: int
    counts: bool = False

    def test(self) -> Column:
        compare = {"has": Column.contains, "is": Column.__eq__, "begins": Column.startswith, "ends": Column.endswith}[self.how]
        return reduce(Column.__or__, (compare(F.lower(c), F.lit(t)) for c in self.columns for t in self.terms))


def _named(*terms: str) -> tuple[Rule, ...]:
    """What each search term gives: in the name, as the name, in the qualified name, in the path."""
    each = lambda t: (Rule(("name",), "has", (t,), 6, True), Rule(("name",), "is", (t,), 8, True), Rule(("qualified_name",), "has", (t,), 3, True), Rule(("file_path",), "has", (t,), 1))
    return tuple(r for t in terms for r in each(t))


@dataclass(frozen=True)
class Phase:
    key: str
    question: tuple[str, ...]
    search: tuple[str, ...]
    priority: tuple[str, ...]
    rules: tuple[Rule, ...] = ()
    support: str = ""


#: Phases in order, their terms, and the points of their rules.
PHASES = (
    Phase("approval", ("approval", "approve", "审批", "通过"), ("approve_pending_approval", "approval_resolve", "approval", "approve"), ("approve_pending_approval", "approval_resolve"),
          (Rule(("name",), "has", ("approve", "approval"), 4, True), Rule(("file_path",), "has", ("store",), 3), Rule(("file_path",), "has", ("runtime",), 2), Rule(("name",), "has", ("deny",), -3)), "approval_resolve"),
    Phase("resume", ("resume", "恢复"), ("resume_approved_execution", "resume", "approved"), ("resume_approved_execution",), (Rule(("name",), "has", ("resume",), 4, True), Rule(("name",), "has", ("approved_execution",), 4, True))),
    Phase("dispatch", ("dispatch", "running", "进入", "运行", "调度"), ("dispatch_execution", "dispatch", "prepare_execution_dispatch", "prepare"), ("dispatch_execution", "prepare_execution_dispatch"),
          (Rule(("name",), "has", ("dispatch_execution",), 8, True), Rule(("name",), "is", ("dispatch_execution",), 4), Rule(("name",), "has", ("prepare_execution_dispatch",), 5, True), Rule(("name",), "is", ("prepare_execution_dispatch",), -2),
           Rule(("name",), "begins", ("prepare_",), -1)), "prepare_execution_dispatch"),
    Phase("queue", ("queue", "queued", "排队", "队列", "停留"), ("next_conflict_queue_head", "queue_for_conflict", "queue", "queued", "conflict"), ("next_conflict_queue_head", "queue_for_conflict"),
          (Rule(("name",), "has", ("next_conflict_queue_head",), 8, True), Rule(("name",), "has", ("queue_for_conflict",), 6, True), Rule(("name",), "has", ("queue", "queued", "head"), 4, True)), "queue_for_conflict"),
    Phase("scheduler", ("scheduler", "claim", "worker", "admit", "调度"), ("admit", "dispatchable_head", "dispatchable", "claim", "scheduler"), ("admit", "dispatchable_head"),
          (Rule(("name",), "has", ("admit", "dispatchable"), 0, True), Rule(("name",), "has", ("admit",), 5, True), Rule(("name",), "has", ("dispatchable_head",), 4, True)), "dispatchable_head"),
)
#: Points of a symbol whose name or path tells of scheduling, by phase.
SCHEDULES = {"dispatch": -3, "scheduler": 4}
#: Points of a priority term by its place: as the name; the end of a qualified name gives 2 less, a part of the name 4.
PRIORITIES = (12, 9, 6)
BUDGETS = {
    "lean": {"primary_symbols": 3, "primary_files": 3, "related_files": 3, "direct_neighbors": 3, "same_file_symbols": 2, "source_snippets": 0, "workflow_symbols": 5, "workflow_depth": 2},
    "normal": {"primary_symbols": 5, "primary_files": 5, "related_files": 5, "direct_neighbors": 5, "same_file_symbols": 3, "source_snippets": 2, "workflow_symbols": 7, "workflow_depth": 3},
    "wide": {"primary_symbols": 8, "primary_files": 8, "related_files": 8, "direct_neighbors": 8, "same_file_symbols": 4, "source_snippets": 4, "workflow_symbols": 10, "workflow_depth": 4},
}


def budget(requested: str | None, scene: str, snippets: bool = False) -> tuple[str, bool, dict[str, int]]:
    """(budget, whether it was widened, its limits). A lean budget becomes a normal one for a workflow, and for behavior
    with snippets."""
    name = (requested or "lean").strip().lower() or "lean"
    if name not in BUDGETS:
        raise ValueError("budget must be one of: lean, normal, wide")
    wider = name == "lean" and (scene == "workflow" or (scene == "behavior" and snippets))
    name = "normal" if wider else name
    return name, wider, BUDGETS[name] | ({} if snippets else {"source_snippets": 0})


def workflow_score(question: Column) -> Column:
    has = lambda terms: any_of(question, terms)
    return F.when(has(STATUS) & has(TRANSITION), 4).otherwise(0) + F.when(has(SCHEDULING) & has(TRANSITION), 3).otherwise(0) + F.when(has(APPROVAL_WORDS) & has(QUEUE_WORDS), 2).otherwise(0)


def scene_scores(question: Column, symbols: Column, files: Column, previous: Column) -> dict[str, Column]:
    q = F.lower(F.coalesce(question, F.lit("")))
    points = lambda c, n: F.when(c, n).otherwise(0)
    prior = {s: points(F.coalesce(previous == s, F.lit(False)), 1) for s in SCENES}
    one = points(symbols == 1, 1)
    return {
        "locate": F.lit(1) + points(any_of(q, LOCATE), 2) + one + points((files > 0) & (symbols == 0), 2) + prior["locate"],
        "behavior": points(any_of(q, BEHAVIOR), 3) + prior["behavior"],
        "impact": points(any_of(q, IMPACT), 3) + one + prior["impact"],
        "workflow": workflow_score(q) + prior["workflow"],
        "call_chain": points(any_of(q, CHAIN), 3) + points(symbols >= 2, 3) + prior["call_chain"],
        "watcher": points(any_of(q, WATCHER), 3) + prior["watcher"],
    }


def infer_scene(question: Column, symbols: Column | None = None, files: Column | None = None, previous: Column | None = None) -> Column:
    """struct(scene, confidence): the scene with most points, ties in the order of SCENES."""
    symbols, files = (F.lit(0) if c is None else c for c in (symbols, files))
    previous = F.lit(None).cast("string") if previous is None else previous
    scores = scene_scores(question, symbols, files, previous)
    ranked = F.array_sort(F.array(*(F.struct((-scores[s]).alias("points"), F.lit(k).alias("k"), F.lit(s).alias("scene")) for k, s in enumerate(SCENES))))
    gap = ranked[1]["points"] - ranked[0]["points"]
    sure = 0.56 + gap * 0.06 + F.when(symbols > 0, 0.08).otherwise(0.0) + F.when(files > 0, 0.04).otherwise(0.0)
    return F.struct(ranked[0]["scene"].alias("scene"), F.greatest(F.lit(0.4), F.least(F.lit(0.9), sure)).alias("confidence"))


def phase_score(phase: Phase) -> Column:
    """How well a symbol plays a phase: points for its terms, its kind and its place, less 8 where nothing counts."""
    name, qualified, path = F.lower("name"), F.lower("qualified_name"), F.lower("file_path")
    rules = _named(*phase.search) + phase.rules
    points = lambda test, n, other=0: F.when(test, n).otherwise(other)
    best = [(t, PRIORITIES[min(k, len(PRIORITIES) - 1)]) for k, t in enumerate(phase.priority)]
    prior = [F.when(name == t, n).when(qualified.endswith(f"::{t}"), n - 2).when(name.contains(t), n - 4).otherwise(0) for t, n in best]
    place = points(any_of(path, BOUNDARY_FILES) | qualified.contains("router"), -6) + points(any_of(path, INTERNAL_FILES), 3) + points(evidence.is_probably_test_file(), -6)
    kind = points(F.col("kind").isin("function", "method"), 3, -5) + points(evidence.is_exported(), 1) + points(evidence.is_local(), 0, -6)
    schedules = points(any_of(name, ("admit", "dispatchable")) | path.contains("scheduler"), SCHEDULES.get(phase.key, 0))
    belongs = reduce(Column.__or__, [r.test() for r in rules if r.counts] + [p > 0 for p in prior])
    return reduce(Column.__add__, [points(r.test(), r.points) for r in rules] + prior) + place + kind + schedules + points(belongs, 0, -8)


def active_phases(question: str) -> list[Phase]:
    q = question.lower()
    return [p for p in PHASES if any(t in q for t in p.question)]


def pick_phases(candidates: DataFrame, phases=PHASES, support: int = 1) -> DataFrame:
    """(phase, id, role, score): for each phase in order the best candidate with points that no phase has taken, then per
    phase, resume apart, up to ``support`` of those left, by a score of their own: the phase's points, less the depth,
    5 more in the file of the phase's choice and 4 for the phase's supporting name. Ties: depth, file, line, qualified name.

    candidates: symbols with ``depth``. A phase loses candidates only to the choices of others, of which there are
    ``taken`` at most, so that its first taken + support rows hold what it chooses; these are ordered on the driver."""
    spark, taken = candidates.sparkSession, len(phases) * (1 + support)
    scores = F.inline(F.array(*(F.struct(F.lit(k).alias("k"), phase_score(p).alias("score")) for k, p in enumerate(phases))))
    rows = candidates.select("id", "name", "qualified_name", "file_path", "line", "depth", scores)
    ties = ("depth", "file_path", "line", "qualified_name")

    def first(found: DataFrame) -> list:
        keep = Window.partitionBy("k").orderBy(F.desc("score"), *ties)
        return found.where("score > 0").withColumn("n", F.row_number().over(keep)).where(F.col("n") <= taken + support).orderBy("k", "n").collect()

    used, chosen, out = set(), {}, []
    for r in first(rows):
        if r.k not in chosen and r.id not in used:
            used.add(r.id)
            chosen[r.k] = r
            out.append((phases[r.k].key, r.id, "primary", r.score))
    helped = [(k, r.file_path, phases[k].support or None) for k, r in chosen.items() if phases[k].key != "resume"]
    own = F.broadcast(spark.createDataFrame(helped, "k int, own_file string, helper string"))  # a row for each phase
    near = F.when(F.col("file_path") == F.col("own_file"), 5).otherwise(0) + F.when(F.lower("name").contains(F.col("helper")), 4).otherwise(0)
    given: dict[int, int] = {}
    for r in first(rows.join(own, "k").withColumn("score", F.col("score") - F.col("depth") + near)) if helped else ():
        if given.get(r.k, 0) < support and r.id not in used:
            used.add(r.id)
            given[r.k] = given.get(r.k, 0) + 1
            out.append((phases[r.k].key, r.id, "support", r.score))
    return spark.createDataFrame(out, "phase string, id string, role string, score int")


def seed_phases(symbols: DataFrame, question: str, per_term: int = 8, index: search.SearchIndex | None = None) -> DataFrame:
    """(phase, id, score): of each phase that a question speaks of, the function or method that plays it best among the
    first ``per_term`` finds of each of its search terms. Ties: file, line, qualified name. No phase, no rows."""
    active = active_phases(question)
    local = symbols.where(F.col("kind").isin("function", "method") & evidence.is_local() & ~evidence.is_test_symbol())
    out, index = None, index or (search.SearchIndex.build(symbols) if active else None)
    for p in active:
        found = reduce(DataFrame.unionByName, (search.search(symbols, t, per_term, index).select("id") for t in p.search)).distinct()
        best = local.join(found, "id").select("id", phase_score(p).alias("score"), "file_path", "line", "qualified_name").where("score > 0")
        best = best.orderBy(F.desc("score"), "file_path", "line", "qualified_name").limit(1).select(F.lit(p.key).alias("phase"), "id", "score")
        out = best if out is None else out.unionByName(best)
    return symbols.limit(0).select(F.lit("").alias("phase"), "id", F.lit(0).alias("score")) if out is None else out


def workflow_files(graph: CodeGraph, picked: DataFrame, bridges: DataFrame, limit: int) -> DataFrame:
    """(file_path, symbols, reasons): the files of the phases' symbols, of their supports and of the bridges between them, by
    the number of distinct symbols and by path."""
    ends = bridges.select("from_symbol").union(bridges.select("to_symbol")).toDF("id").withColumn("reason", F.lit("bridge"))
    parts = picked.select("id", F.concat("role", F.lit(" of "), "phase").alias("reason")).unionByName(ends)
    return _files(graph, parts, limit)


def chain_files(graph: CodeGraph, path: DataFrame, limit: int) -> DataFrame:
    """(file_path, symbols, reasons): the files of a path's nodes."""
    return _files(graph, path.select(F.col("symbol_id").alias("id"), F.lit("path").alias("reason")), limit)


def _files(graph: CodeGraph, parts: DataFrame, limit: int) -> DataFrame:
    rows = graph.symbols.select("id", "file_path").join(parts, "id").groupBy("file_path").agg(F.countDistinct("id").alias("symbols"), F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))
    return rows.orderBy(F.desc("symbols"), "file_path").limit(limit)


def verification_context(graph: CodeGraph, symbol: str, neighbours: int = 8, siblings: int = 4, files: int = 6) -> dict[str, DataFrame]:
    """What to look at before a symbol is changed or removed, a DataFrame for each section."""
    at = traverse.resolve_one(graph, symbol)
    callers, callees = (traverse.direct_neighbours(graph, at, d, neighbours) for d in ("incoming", "outgoing"))
    own = graph.symbols.where(F.col("id") == at).join(rank.degrees(graph.symbols, graph.dependencies), "id")
    i, o = F.col("incoming"), F.col("outgoing")
    summary = own.select(
        "id", "name", "qualified_name", evidence.is_exported().alias("exported"), evidence.symbol_role().alias("role"), evidence.dynamic_risk().alias("dynamic_risk"), evidence.risk_factors().alias("risk_factors"),
        F.round(evidence.confidence(i, o), 6).alias("confidence"), evidence.assessment(i).alias("assessment"), evidence.assessment_note(evidence.assessment(i)).alias("note"), evidence.verification_hints(i, o).alias("hints"),
        evidence.search_terms().alias("search_terms"), evidence.verification_plan((i > 0) | (o > 0)).alias("plan"),
    )
    return {"evidence": summary, "callers": callers, "callees": callees, "same_file": traverse.same_file(graph, at, siblings), "files": rank.related_files(graph, at).limit(files)}


@dataclass
class Anchors:
    """What a question is about: symbols, each once, with where they came from, and files. What led nowhere costs."""

    symbols: list[str] = field(default_factory=list)
    origins: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    penalties: list[str] = field(default_factory=list)

    def add(self, symbol: str | None, origin: str) -> None:
        if symbol and symbol not in self.symbols:
            self.symbols.append(symbol)
            self.origins.append(origin)

    def look_up(self, graph: CodeGraph, text: str, origin: str) -> None:
        try:
            self.add(traverse.resolve_one(graph, text), origin)
        except ValueError as e:
            self.penalties.append(str(e))

    def add_file(self, file: str | None) -> None:
        if file and file not in self.files:
            self.files.append(file)


def anchors(graph: CodeGraph, question: str | None = None, symbols: Sequence[str] = (), files: Sequence[str] = (), workspace: dict | None = None, runtime: dict | None = None, conversation: dict | None = None) -> Anchors:
    """The anchors of a request, in order of precedence: given symbols and files; the workspace's selection, looked up in
    its active file first, then the active and recent files; the symbols of a stack trace; the targets of the conversation
    before. Without a symbol from these: the one nearest to the selected line of the active file, and without that the one
    that the question names."""
    found, w = Anchors(), workspace or {}
    for s in symbols:
        found.look_up(graph, s, "symbols")
    for f in files:
        found.add_file(f)
    active, line = w.get("active_file"), w.get("selection_line")
    if selected := w.get("selection_symbol"):
        own = rank.nearest_to_line(graph.symbols, active, line or 1, selected).first() if active else None
        found.add(own.id, "selection") if own else found.look_up(graph, selected, "selection")
    for f in (active, *w.get("recent_files", ())):
        found.add_file(f)
    for s in (runtime or {}).get("stacktrace_symbols", ()):
        found.look_up(graph, s, "stack trace")
    for s in (conversation or {}).get("previous_targets", ()):
        found.look_up(graph, s, "conversation")
    if not found.symbols and active and line:
        nearest = rank.nearest_to_line(graph.symbols, active, line).first()
        found.add(nearest and nearest.id, "nearest line")
    if not found.symbols and question:
        named = search.question_anchor(graph, question).first()
        found.add(named and named.id, "question")
        if not named:
            found.penalties.append("the question names no symbol")
    return found


def file_sections(graph: CodeGraph, files: Sequence[str], limits: dict[str, int]) -> dict[str, DataFrame]:
    """The indexed state of files, missing ones too, and their first symbols."""
    spark, some = graph.symbols.sparkSession, list(files)[: limits["primary_files"]]
    asked = spark.createDataFrame([(f, k) for k, f in enumerate(some)], "file_path string, place int")
    counts = graph.symbols.join(F.broadcast(asked), "file_path").groupBy("file_path").agg(F.count(F.lit(1)).alias("symbols"))  # the given files
    out = asked.join(counts, "file_path", "left").withColumn("symbols", F.coalesce("symbols", F.lit(0)))
    if graph.file_state is not None:
        out = out.join(graph.file_state.select(F.col("path").alias("file_path"), "status", "error_message"), "file_path", "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    held = graph.symbols.join(F.broadcast(asked), "file_path").orderBy("place", "line", "col", "name").limit(limits["primary_symbols"])
    return {"primary_files": out.orderBy("place").drop("place"), "primary_symbols": held.drop("place")}


def snippets_of(graph: CodeGraph, ids: Sequence[str], texts: DataFrame, limit: int) -> DataFrame:
    """(id, file_path, line, snippet, tokens) of the first ``limit`` ids; texts: (path, text)."""
    from ..sources import files

    wanted = graph.symbols.where(F.col("id").isin(list(ids)[:limit]))
    rows = wanted.join(texts.select(F.col("path").alias("file_path"), "text"), "file_path")
    made = rows.withColumn("snippet", files.snippet(F.col("text"), F.col("line"))).where("snippet is not null")
    return made.select("id", "file_path", "line", "snippet", evidence.token_estimate(F.col("snippet")).alias("tokens"))


#: How much a built package adds to the confidence in the scene, by scene, and what each penalty takes away.
GAINS, PENALTY = {"watcher": 0.08, "workflow": 0.06, "call_chain": 0.06}, 0.04


def task_context(
    graph: CodeGraph, question: str | None = None, symbols: Sequence[str] = (), files: Sequence[str] = (), mode: str = "auto", budget_name: str | None = None, previous: str | None = None, snippets: bool = False,
    workspace: dict | None = None, runtime: dict | None = None, conversation: dict | None = None, texts: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """A context package for a question: its scene, its anchors and what stands near them, a DataFrame for each section.

    Anchors come from the request (``anchors``). A scene without the anchors that it needs gives the status needs_anchor
    and what it lacks. The anchors are few and named on the driver; neighbourhoods are looked up in Spark. ``texts`` (path,
    text) gives snippets, where they are asked for."""
    wanted = (mode or "auto").strip().lower() or "auto"
    if wanted not in (*SCENES, "auto"):
        raise ValueError("mode must be one of: auto, locate, behavior, impact, workflow, call_chain, watcher")
    spark = graph.symbols.sparkSession
    found = anchors(graph, question, symbols, files, workspace, runtime, conversation)
    previous = previous or (conversation or {}).get("previous_scene")
    if wanted == "auto":
        row = spark.createDataFrame([(question, len(found.symbols), len(found.files), previous)], "q string, s int, f int, p string").select(infer_scene(F.col("q"), F.col("s"), F.col("f"), F.col("p")).alias("x")).first().x
        scene, sure = row.scene, row.confidence
    else:
        scene, sure = wanted, 0.92
    name, wider, limits = budget(budget_name, scene, snippets)
    sections, lacks = _sections(graph, scene, question, found, limits)
    if sections and texts is not None and limits["source_snippets"] and found.symbols:
        sections["source_snippets"] = snippets_of(graph, found.symbols, texts, limits["source_snippets"])
    penalties = found.penalties + ([lacks] if lacks else [])
    confidence = max(0.1, min(0.98, sure + (GAINS.get(scene, 0.0) if sections else 0.0) - PENALTY * len(penalties)))
    summary = [("ready" if sections else "needs_anchor", scene, name, wider, float(confidence), found.symbols, found.origins, found.files, penalties)]
    sections["summary"] = spark.createDataFrame(summary, "status string, scene string, budget string, widened boolean, confidence double, anchors array<string>, origins array<string>, files array<string>, penalties array<string>")
    return sections


def _sections(graph: CodeGraph, scene: str, question: str | None, found: Anchors, limits: dict[str, int]) -> tuple[dict[str, DataFrame], str | None]:
    """(the sections of a scene, what it lacks)."""
    if scene == "watcher":
        return (file_sections(graph, found.files, limits), None) if found.files else ({}, "a watcher's state needs a file")
    if scene == "workflow":
        phases = active_phases(question or "") or list(PHASES)
        seeds = seed_phases(graph.symbols, question or "").select("id")
        start = cut(seeds.union(graph.symbols.where(F.col("id").isin(found.symbols)).select("id")).distinct())
        if start.isEmpty():
            return {}, "a workflow needs a symbol, or a question that speaks of its phases"
        candidates = traverse.workflow_candidates(graph, start, limits["workflow_depth"]).select("id", "depth").join(graph.symbols, "id")
        picked = pick_phases(cut(candidates), tuple(phases))
        order = [r.id for r in picked.where("role = 'primary'").collect()]
        bridges = cut(traverse.bridge_edges(graph, order, limits["workflow_depth"]))
        return {"phases": picked, "bridges": bridges, "files": workflow_files(graph, picked, bridges, limits["related_files"])}, None
    if scene == "call_chain":
        if len(found.symbols) < 2:
            return {}, "a call chain needs two symbols"
        path = cut(traverse.shortest_path(graph, found.symbols[0], found.symbols[1], 5))
        return {"path": path, "files": chain_files(graph, path, limits["related_files"])}, None
    if found.symbols:
        at = found.symbols[0]
        near = {k: traverse.direct_neighbours(graph, at, d, limits["direct_neighbors"]) for k, d in (("callers", "incoming"), ("callees", "outgoing"))}
        near["same_file"] = traverse.same_file(graph, at, limits["same_file_symbols"])
        near["files"] = rank.related_files(graph, at).limit(limits["related_files"])
        if scene == "impact":
            own = graph.symbols.where(F.col("id") == at).join(rank.degrees(graph.symbols, graph.dependencies), "id")
            count = near["files"].count()
            near["risk"] = own.select("id", evidence.impact_risk(F.col("incoming"), F.col("outgoing"), F.lit(count)).alias("risk"), evidence.impact_reasons(F.col("incoming"), F.col("outgoing"), F.lit(count)).alias("reasons"))
        return near, None
    if found.files and scene == "locate":
        return file_sections(graph, found.files, limits), None
    return {}, "add a symbol" if scene != "locate" else "add a symbol or a file"
