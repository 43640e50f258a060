import pytest
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.api import Project
from codeloom.graph import CodeGraph, symbol_id
from codeloom.operators import incremental, rank, resolve, search, traverse
from codeloom.sources import extract, files
from codeloom.streaming import watch


def graph(spark, edges, names="abcdef"):
    s = [(n, n, f"f.py::{n}", "function", "f.py", k, 1, "public", None, "local") for k, n in enumerate(names)]
    return CodeGraph(spark.createDataFrame(s, schema.SYMBOLS), spark.createDataFrame([(a, b, "f.py", 1, k) for a, b, k in edges], schema.DEPENDENCIES))


def test_walks_repeat_and_cycles_stop_at_depth(spark):
    g = graph(spark, [("a", "b", "call"), ("b", "a", "call"), ("a", "c", "call"), ("c", "b", "inherit")])
    rows = [(r.depth, r.name) for r in traverse.chain(g, "a", 3).collect()]
    assert rows == [(0, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "c")]
    assert [(r.depth, r.name) for r in traverse.chain(g, "a", 3, distinct=True).collect()] == [(0, "a"), (1, "b"), (1, "c")]
    assert [r.name for r in traverse.chain(g, "b", 1, "incoming").collect()] == ["b", "a", "c"]
    with pytest.raises(ValueError):
        traverse.chain(g, "a", 99)


def test_shortest_path(spark):
    g = graph(spark, [("a", "b", "call"), ("b", "c", "call"), ("c", "a", "call"), ("a", "d", "type_use"), ("d", "e", "call"), ("c", "e", "inherit")])
    assert [(r.depth, r.name, r.dep_kind) for r in traverse.shortest_path(g, "a", "e").collect()] == [(0, "a", None), (1, "d", "type_use"), (2, "e", "call")]
    assert [r.name for r in traverse.shortest_path(g, "a", "a").collect()] == ["a"]
    assert traverse.shortest_path(g, "e", "a").isEmpty()
    assert traverse.shortest_path(g, "a", "e", 1).isEmpty()


def test_degrees_ignore_self_loops(spark):
    g = graph(spark, [("a", "a", "call"), ("a", "b", "call"), ("a", "b", "call"), ("b", "x", "call")])
    found = {r.id: (r.incoming, r.outgoing) for r in rank.degrees(g.symbols, g.dependencies).collect()}
    assert found["a"] == (0, 2) and found["b"] == (2, 0) and found["c"] == (0, 0)


def test_search_prefers_exact_names_and_falls_back(spark):
    s = [(n, n, f"{p}::{n}", "function", p, 1, 1, "public", None, "local") for n, p in (("process_data", "a.py"), ("DataProcessor", "b.py"), ("process", "c.py"), ("other", "d.py"))]
    symbols = spark.createDataFrame(s, schema.SYMBOLS)
    assert [r.name for r in search.search(symbols, "process").collect()] == ["process", "process_data", "DataProcessor"]
    assert [r.name for r in search.search(symbols, "process", 1).collect()] == ["process"]
    assert [r.name for r in search.search(symbols, "%").collect()] == []
    with pytest.raises(ValueError):
        search.search(symbols, "x", 0)


def test_resolver_tiers(spark):
    s = [("h1", "helper", "lib.py::helper", "function", "lib.py"), ("m", "main", "app.py::main", "function", "app.py"), ("d1", "dup", "x.py::dup", "function", "x.py"), ("d2", "dup", "y.py::dup", "function", "y.py")]
    symbols = spark.createDataFrame([(*x, 1, 1, "public", None, "local") for x in s], schema.SYMBOLS)
    raw = spark.createDataFrame([("app.py::main", t, "app.py", k, "call") for k, t in enumerate(("h", "dup", "len", "nope", "req.get"))] + [("gone", "helper", "app.py", 9, "call")], schema.DEPENDENCIES)
    imports = spark.createDataFrame([("lib.py::helper", "h", "app.py", 1, "alias"), ("requests::get", None, "app.py", 2, "named")], schema.IMPORTS)
    found = {r.to_symbol: r.tier for r in resolve.resolve(symbols, raw, imports).tagged.where("from_line < 9").collect()}
    assert found == {"h": "import_exact", "dup": "unresolved", "len": "builtin", "nope": "unresolved", "req.get": "external"}


def test_replace_keeps_edges_into_stable_symbols(spark):
    g = graph(spark, [])
    s = g.symbols.withColumn("file_path", F.when(F.col("id").isin("a", "b"), "one.py").otherwise("two.py"))
    e = spark.createDataFrame([("c", "a", "two.py", 1, "call"), ("c", "b", "two.py", 2, "call"), ("a", "d", "one.py", 1, "call")], schema.DEPENDENCIES)
    out = incremental.replace_file(CodeGraph(s, e), "one.py", s.where("id = 'a'"), e.limit(0))
    assert [(r.from_symbol, r.to_symbol) for r in out.dependencies.collect()] == [("c", "a")]


def test_upsert_keeps_the_last(spark):
    g = graph(spark, [])
    rows = g.symbols.where("id = 'a'").withColumn("ordinal", F.lit(1)).unionByName(g.symbols.where("id = 'a'").withColumn("name", F.lit("last")).withColumn("ordinal", F.lit(2)))
    out = incremental.upsert_symbols(g.symbols, rows)
    assert out.count() == 6 and out.where("id = 'a'").first().name == "last"


def test_snapshots_reopen(spark, tmp_path):
    g = graph(spark, [("a", "b", "call")])
    full = CodeGraph(g.symbols, g.dependencies, spark.createDataFrame([], schema.IMPORTS), spark.createDataFrame([], schema.FILE_STATE))
    full.save(str(tmp_path), 1)
    full.save(str(tmp_path), 2)
    assert {r.metric: r.value for r in CodeGraph.load(spark, str(tmp_path)).stats().collect()}["symbols"] == 6


FIXTURES = {
    "python": ("from a.b import c as d\nclass Greeter(Base):\n    def hi(self):\n        return d(1)\n", "Greeter", 1),
    "rust": ("use a::{b, c as d};\npub struct User { name: String }\nimpl User { pub fn hi(&self) { b::run(1); } }\nfn main() { println!(\"x\"); }\n", "main", 2),
    "typescript": ("import { a as b } from './x';\nexport class UserService extends Base implements Repo {\n  run(x: number) {\n    return b(x);\n  }\n}\n", "UserService", 1),
    "javascript": ("import { a as b } from './x';\nexport class UserService {\n  run(x) {\n    return b(x);\n  }\n}\nfunction go() { return b(2); }\n", "UserService", 1),
    "java": ("import a.B;\nimport static a.C.help;\npublic class UserService implements Repo {\n  private void run(int x) {\n    help(x);\n  }\n}\n", "UserService", 2),
    "csharp": ("using System;\nusing A = B.C;\npublic class UserService : IRepo {\n  public void Run(int x) {\n    Help(x);\n  }\n}\n", "UserService", 2),
    "kotlin": ("import a.b\nimport a.c as d\nimport a.*\nclass UserService : Repo {\n  fun run(x: Int) {\n    help(x)\n  }\n}\n", "UserService", 3),
    "php": ("<?php\nuse A\\B;\nuse A\\C as D;\nuse E;\nclass UserService extends Base {\n  public function run($x) {\n    help($x);\n  }\n}\n", "UserService", 3),
    "ruby": ("require 'json'\nclass UserService < Base\n  include Mixin\n  def run(x)\n    help(x)\n  end\nend\n", "UserService", 1),
    "swift": ("import Foundation\nstruct InMemoryRepo: Repo {\n  func run(x: Int) {\n    help(x)\n  }\n}\n", "InMemoryRepo", 1),
    "objc": ("#import <Foundation/Foundation.h>\n#import \"A.h\"\n@interface Calculator : NSObject\n@end\nint main(int a) {\n  NSLog(a);\n  return 0;\n}\n", "Calculator", 2),
    "go": ("package main\nimport (\n\tf \"fmt\"\n\t. \"strings\"\n)\nfunc FormatName(x string) string {\n\treturn ToUpper(x)\n}\n", "FormatName", 2),
    "c": ("#include <stdio.h>\n#include \"a.h\"\nstatic int helper(int a) { return a; }\nint run(void) {\n  return helper(1);\n}\n", "run", 2),
    "cpp": ("#include <a>\n#include \"b.h\"\nnamespace n {\nclass UserService : public Base {\n public:\n  int run(int x) { return help(x); }\n};\n}\n", "UserService", 2),
}


@pytest.mark.parametrize("language", FIXTURES)
def test_extraction(language):
    text, symbol, imports = FIXTURES[language]
    p = extract.parse(f"src/sample.{language}", text, language)
    assert p.error_count == 0 and symbol in [s["name"] for s in p.symbols] and len(p.imports) == imports and p.dependencies


def test_project_end_to_end(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "lib.py").write_text("def helper(x):\n    return len(x)\n")
    (tmp_path / "src" / "app.py").write_text("from src.lib import helper\n\ndef entry():\n    return helper([])\n")
    (tmp_path / "src" / "test_app.py").write_text("def test_it():\n    pass\n")
    p = Project.scan(spark, str(tmp_path))
    assert {r.name for r in p.get_dependencies("entry", max_depth=1).collect()} == {"entry", "helper"}
    assert p.refresh(spark).isEmpty()
    (tmp_path / "src" / "app.py").write_text("def entry():\n    return 1\n")
    assert [(r.path, r.change) for r in p.refresh(spark).collect()] == [("src/app.py", "Modified")]
    assert {r.name for r in p.get_dependencies("entry").collect()} == {"entry"}
    assert [x["status"] for x in p.batch_query([{"kind": "get_interface", "symbol": "entry"}, {"kind": "get_interface", "symbol": "none"}])] == ["ok", "error"]
    assert p.get_task_context("who calls helper?")["summary"].first().status == "ready"


def test_paths(spark):
    rows = [("tests/a.py", True), ("src/a_test.go", True), ("src/Foo.java", False), ("src/FooTest.java", True)]
    df = spark.createDataFrame(rows, "path string, want boolean")
    assert df.where(files.is_test_path(F.col("path")) != F.col("want")).isEmpty()
    with pytest.raises(ValueError):
        files.validate_path("/a", "../b")


def test_debounce_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a", "Added"), ("2024-01-01 00:00:00.4", "a", "Modified"), ("2024-01-01 00:00:05", "a", "Deleted"), ("2024-01-01 00:01:00", "z", "Added")]
    spark.createDataFrame(rows, "ts string, path string, change string").selectExpr("cast(ts as timestamp) ts", "path", "change").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("ts timestamp, path string, change string").parquet(str(tmp_path / "in"))
    watch.watch(stream, lambda df, n: seen.extend((r.path, r.change) for r in df.collect()), str(tmp_path / "state")).awaitTermination()
    assert sorted(seen) == [("a", "Added"), ("a", "Deleted")]


def test_imports_resolve_across_files(spark, tmp_path):
    """The same name twice in a project: the import decides. Barrels pass names on, and a cycle of them ends."""
    (tmp_path / "src" / "deep").mkdir(parents=True)
    write = lambda name, text: (tmp_path / "src" / name).write_text(text)
    write("shared.ts", "export function formatName(x: string) {\n  return x;\n}\n")
    write("other.ts", "export function formatName(x: string) {\n  return x;\n}\nexport function twice(x: string) {\n  return x;\n}\n")
    write("barrel.ts", "export { formatName as shown } from './shared';\nexport * from './loop';\n")
    write("loop.ts", "export * from './barrel';\nexport { twice } from './other';\n")
    write("service.ts", "import { formatName as f } from './shared';\nimport { shown } from './barrel';\nimport { twice } from './barrel';\nexport function greet(x: string) {\n  f(x);\n  shown(x);\n  return twice(x);\n}\n")
    write("a.py", "def helper(x):\n    return x\n")
    write("b.py", "def helper(x):\n    return x\n")
    write("deep/c.py", "from ..a import helper\nfrom . import d\n\ndef run(x):\n    return helper(x)\n")
    p = Project.scan(spark, str(tmp_path))
    names = p.graph.symbols.select(F.col("id").alias("to_symbol"), F.col("qualified_name").alias("to"))
    found = {(r["from"], r["to"]) for r in p.graph.dependencies.join(names, "to_symbol").join(p.graph.symbols.select(F.col("id").alias("from_symbol"), F.col("qualified_name").alias("from")), "from_symbol").collect()}
    assert found == {("src/service.ts::greet", "src/shared.ts::formatName"), ("src/service.ts::greet", "src/other.ts::twice"), ("src/deep/c.py::run", "src/a.py::helper")}
    assert p.graph.symbols.where("source <> 'local'").isEmpty()


def test_only_changed_files_are_parsed_again(spark, tmp_path):
    import os

    (tmp_path / "tmp" / "p" / "rr" / "node_modules").mkdir(parents=True)
    root = tmp_path / "tmp" / "p" / "rr"
    for k in range(6):
        (root / f"m{k}.py").write_text(f"def f{k}():\n    return f{(k + 1) % 6}()\n")
    (root / "node_modules" / "big.js").write_text("function hidden() {}\n")
    (root / "broken.py").write_text("def fine():\n    return f1()\n\ndef bad(:\n")
    for f in root.glob("*.py"):
        os.utime(f, (1_700_000_000, 1_700_000_000))
    os.utime(root / "m5.py", (1_700_009_000, 1_700_009_000))
    p = Project.scan(spark, str(root))
    assert p.read_files == 7 and {r.file_path for r in p.graph.symbols.collect()} == {"broken.py", *(f"m{k}.py" for k in range(6))}
    assert p.graph.file_state.where("status = 'failed'").select("path").first().path == "broken.py"
    assert [r.path for r in files.discover(spark, str(root)).collect()] == sorted(["broken.py", *(f"m{k}.py" for k in range(6))])
    (root / "m2.py").write_text("def f2():\n    return 1\n")
    os.utime(root / "m2.py", (1_700_009_999, 1_700_009_999))
    (root / "m4.py").unlink()
    seen = p.watcher(spark)
    seen.changed()
    assert p.read_files == 1 and seen.scans == 1
    names = {r.id: r.name for r in p.graph.symbols.collect()}
    assert {(names[r.from_symbol], names[r.to_symbol]) for r in p.graph.dependencies.collect()} == {("f0", "f1"), ("f1", "f2"), ("f5", "f0"), ("fine", "f1")}
    p.cancel()
    from codeloom.api import ScanCancelled

    with pytest.raises(ScanCancelled):
        p._step()


def test_watcher_pauses_and_catches_up():
    now, scans = [0.0], []

    def refresh():
        scans.append(now[0])
        if len(scans) == 1:
            w.changed()  # a change during a scan leaves the project dirty

    w = watch.Watcher(refresh, 300, lambda: now[0])
    w.changed()
    assert len(scans) == 2 and not w.dirty
    now[0] = 299
    assert not w.idle()
    now[0] = 400
    assert w.idle() and w.paused
    w.changed()
    assert len(scans) == 2
    w.resume()
    assert len(scans) == 3 and not w.needs_resync


def test_supports_are_ranked_by_their_own_score(spark):
    """A symbol in the file of a phase's choice outranks ones with more points elsewhere."""
    from codeloom.operators import context

    rows = [("top", "next_conflict_queue_head", "q/a.rs", 0)] + [(f"far{k}", f"queue_{k}_queued", f"q/z{k}.rs", 0) for k in range(30)] + [("near", "queue_one", "q/a.rs", 0), ("late", "queue_two", "q/a.rs", 3)]
    data = [(i, n, f"{p}::{n}", "function", p, k, "private", "local", d) for k, (i, n, p, d) in enumerate(rows)]
    symbols = spark.createDataFrame(data, "id string, name string, qualified_name string, kind string, file_path string, line int, visibility string, source string, depth int")
    queue = [p for p in context.PHASES if p.key == "queue"]
    score = {r.id: r.s for r in symbols.select("id", context.phase_score(queue[0]).alias("s")).collect()}
    picked = [(r.id, r.role, r.score) for r in context.pick_phases(symbols, queue).collect()]
    best = max(((score[i] - d + 5 * (p == "q/a.rs"), i) for i, n, p, d in rows if i != "top"), key=lambda x: x[0])
    assert picked == [("top", "primary", score["top"]), (best[1], "support", best[0])]


def test_anchors_by_precedence(spark):
    from codeloom.operators import context

    g = graph(spark, [("a", "b", "call")])
    g = CodeGraph(g.symbols, g.dependencies, None, spark.createDataFrame([("f.py", "h", 1, "ok", None)], schema.FILE_STATE))
    found = context.anchors(g, "what of e?", ("a", "zz"), (), {"selection_symbol": "b", "active_file": "f.py", "selection_line": 1}, {"stacktrace_symbols": ["c"]}, {"previous_targets": ["d", "a"]})
    names = {r.id: r.name for r in g.symbols.collect()}
    assert [names[i] for i in found.symbols] == ["a", "b", "c", "d"] and found.origins == ["symbols", "selection", "stack trace", "conversation"] and found.files == ["f.py"] and len(found.penalties) == 1
    assert context.anchors(g, None, workspace={"active_file": "f.py", "selection_line": 4}).origins == ["nearest line"]
    out = context.task_context(g, mode="watcher", files=("f.py", "gone.py"))
    assert [(r.file_path, r.symbols, r.status) for r in out["primary_files"].collect()] == [("f.py", 6, "ok"), ("gone.py", 0, "missing")]
    texts = spark.createDataFrame([("f.py", "\n".join(f"line {k}" for k in range(12)))], "path string, text string")
    out = context.task_context(g, mode="locate", symbols=("a",), snippets=True, budget_name="normal", texts=texts)
    assert out["source_snippets"].first().tokens > 0 and out["summary"].first().status == "ready"
    assert context.task_context(g, mode="call_chain", symbols=("a",))["summary"].first().status == "needs_anchor"
    assert context.task_context(g, mode="call_chain", symbols=("a", "b"))["files"].first().symbols == 2


def test_settings_in_toml_and_json5():
    json5 = "{ // a comment\n  exclude: ['dist/**', \"it's/**\",],\n  include_tests: true, /* minutes */ idle_minutes: 0x0A,\n}"
    toml = "[scan]\nexclude = ['dist/**', \"it's/**\"]\ninclude_tests = true\nidle_minutes = 10\n"
    assert files.Settings.load(json5) == files.Settings.load(toml) == files.Settings(exclude=("dist/**", "it's/**"), include_tests=True, idle_minutes=10)
    assert files.Settings.load("{scan: {idle_minutes: +7}}").idle_minutes == 7
    for wrong in ("{idle_minutes: 0}", "{nothing: 1}", "{languages: ['cobol']}"):
        with pytest.raises(ValueError):
            files.Settings.load(wrong)


def test_registry_and_endpoints(spark, tmp_path):
    import json
    import shutil
    import threading
    import urllib.request

    from codeloom.__main__ import answer, server
    from codeloom.manifest import Manifest

    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.py").write_text("def low():\n    return 1\n\ndef high():\n    return low()\n")
    m = Manifest(spark, str(tmp_path / "projects.json"))
    ids = [m.add(str(tmp_path / name), settings=files.Settings(exclude=())).id for name in ("one", "two")]
    m.save()
    p = Project.open(spark, Manifest(spark, str(tmp_path / "projects.json")), ids[0])
    again = Manifest(spark, str(tmp_path / "projects.json"))
    assert [(e.name, e.counts.get("symbols")) for e in again.list()] == [("one", 2), ("two", None)]
    shutil.rmtree(tmp_path / "two")
    assert [e.name for e in again.prune()] == ["two"] and len(again.list()) == 1
    assert [r["name"] for r in answer(p, "find", ["low"])] == ["low"] and [r["name"] for r in answer(p, "chain", ["high", "low"])] == ["high", "low"]
    http = server(spark, p, 0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    get = lambda path: json.load(urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}{path}"))
    try:
        assert [r["name"] for r in get("/interface/high/dependencies")] == ["high", "low"] and len(get("/interfaces")) == 2 and [r["name"] for r in get("/projects")] == ["one", "two"]
        with pytest.raises(urllib.error.HTTPError):
            get("/nowhere")
    finally:
        http.shutdown()


def test_search_with_an_index_is_search_by_a_scan(spark):
    names = ["process_data", "DataProcessor", "process", "data_process_data", "other", "pre_process", "datum", "über_daten"]
    symbols = spark.createDataFrame([(str(k), n, f"src/{n[:3]}.py::{n}", "function", f"src/{n[:3]}.py", 1, 1, "public", None, "local") for k, n in enumerate(names)], schema.SYMBOLS)
    index = search.SearchIndex.build(symbols)
    for query in ("process", "data", "process_data", "src pro", "data_process", "py data", "über", "%", "zzz"):
        scan, held = (sorted(map(tuple, x.collect())) for x in (search.search_prefix(symbols, query), index.matching(query)))
        assert scan == held, query


def test_scans_and_appends(spark):
    g = graph(spark, [("b", "a", "call"), ("a", "b", "call")])
    more = g.append(spark.createDataFrame([("a", "c", "e.py", 9, "call")], schema.DEPENDENCIES), spark.createDataFrame([("x", None, "e.py", 1, "named")], schema.IMPORTS))
    assert [(r.from_file, r.from_symbol) for r in more.scan("dependencies").collect()] == [("e.py", "a"), ("f.py", "a"), ("f.py", "b")]
    assert more.scan("imports").count() == 1 and [r.name for r in more.scan("symbols").collect()] == list("abcdef")


def test_scripts_keep_what_follows_a_regular_expression():
    text = "export class A {\n  one(x: string) {\n    return x.split(/[/*'\"]/).length / 2;\n  }\n  two(y: number) {\n    return `a ${fmt(y)} {`;\n  }\n}\n"
    p = extract.parse("a.ts", text, "typescript")
    assert [s["qualified_name"] for s in p.symbols] == ["a.ts::A", "a.ts::A::one", "a.ts::A::two"] and p.error_count == 0
    assert [(d["from_symbol"], d["to_symbol"]) for d in p.dependencies] == [("a.ts::A::one", "split"), ("a.ts::A::two", "fmt")]


def test_star_graph_is_projected_where_it_is_read(spark, sf):
    from codeloom import storage
    from codeloom.plans import queries

    before = len(storage._written)
    for name in ("edges_by_source", "related_files", "adjacency_weights", "confidence", "overview_totals"):
        queries.QUERIES[name](spark, sf)
    assert len(storage._written) == before  # no copy of the graph


def test_adjacency_counts_a_pair_in_both_orders(spark):
    g = graph(spark, [("a", "b", "call"), ("b", "a", "call"), ("b", "c", "call"), ("d", "d", "call")])
    assert rank.adjacency(g.dependencies)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1  # shuffled once
    found = sorted((r.a, r.b, r.weight) for r in rank.adjacency(g.dependencies).collect())
    assert found == [("a", "b", 2), ("b", "a", 2), ("b", "c", 1), ("c", "b", 1), ("d", "d", 2)]


def test_overview_shows_other_ids_and_leaves_out_tests(spark):
    s = [(n, n, f"f.py::{n}", "function", "f.py", k, 1, "public", None, "local") for k, n in enumerate(("a", "b", "c", "test_d"))]
    e = [("a", "b", "f.py", 1, "call"), ("b", "c", "f.py", 1, "call"), ("test_d", "a", "f.py", 1, "call"), ("c", "c", "f.py", 1, "call")]
    g = CodeGraph(spark.createDataFrame(s, schema.SYMBOLS), spark.createDataFrame(e, schema.DEPENDENCIES))
    shown = F.upper("qualified_name")
    for closed in (False, True):
        nodes, edges, totals = rank.overview(g, closed=closed, shown=shown)
        assert sorted((r.id, r.degree) for r in nodes.collect()) == [("F.PY::A", 1), ("F.PY::B", 2), ("F.PY::C", 1)]
        assert [(r.from_symbol, r.to_symbol) for r in edges.collect()] == [("F.PY::A", "F.PY::B"), ("F.PY::B", "F.PY::C")]
        assert tuple(totals.first()) == (3, 1, 2)


def test_language_resolvers_read_their_sources_as_tables(spark, sf):
    from codeloom.plans import queries

    plan = queries.QUERIES["resolve_javascript"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("part.parquet") + plan.count("p_partkey#") <= 60 and plan.count("Join Cross") <= 1  # of the raw rows alone


@pytest.mark.parametrize("few", [0, 50_000])
def test_resolving_names_is_resolving_by_joins(spark, monkeypatch, few):
    monkeypatch.setattr(resolve, "FEW", few)
    named = [("a.py", "main"), ("a.py", "near"), ("a.py", "twin"), ("b.py", "twin"), ("b.py", "far"), ("c.py", "far"), ("c.py", "only"), ("c.py", "len"), ("d.py", "len")]
    names = spark.createDataFrame([(f"{f}::{n}#{k}", n, f"{f}::{n}#{k}", "function", f, 1, 1, "public", None, "local") for k, (f, n) in enumerate(named)], schema.SYMBOLS)
    hashed = names.withColumn("id", symbol_id(F.col("id")))
    asked = ("near", "twin", "far", "only", "len", "nope", "x.only", "far!", "", "print", "bound", "::")
    raw = spark.createDataFrame([(f"{f}::{n}#{k}", t, f, line, "call") for k, (f, n) in enumerate(named) for line, t in enumerate(asked)], schema.DEPENDENCIES)
    sources = (("b.py::far#4", "far", 3), ("c.py::far#5", "far", 3), ("c.py::only#6", "bound", 1), ("b.py::twin#3", "bound", 2))
    imports = spark.createDataFrame([(s, alias, f, line, "alias") for f in ("a.py", "d.py") for s, alias, line in sources], schema.IMPORTS)
    tiers = ("same_file", "import_exact", "unique_name")
    row = ["from_symbol", "to_symbol", "from_line", "tier"]
    want = resolve.resolve(hashed, raw, imports, tiers=tiers).tagged.select(*row, "to_id")
    short = raw.withColumn("from_symbol", F.expr("substr(from_symbol, length(from_file) + 3)"))
    made = resolve.resolve_names(names, short, imports)
    whole = F.concat("from_file", F.lit("::"), "from_symbol").alias("from_symbol")
    found = made.tagged.select(whole, *row[1:], F.when(F.col("tier") != "builtin", symbol_id(F.col("to_id"))).otherwise(symbol_id(F.col("synthetic"))).alias("to_id"))
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows.collect())
    got, expected = key(found), key(want)
    assert [(*r[:4], r[4] if r[3] != "unresolved" else "None") for r in got] == expected and {r[3] for r in got} == {*tiers, "builtin", "unresolved"}
    assert made.non_local.count() == 2 and made.unresolved.count() == sum(r[3] == "unresolved" for r in got)


@pytest.mark.parametrize("few", [0, 50_000])
def test_index_holds_each_token_of_a_symbol_once(spark, monkeypatch, few):
    monkeypatch.setattr(search, "FEW", few)
    s = [(f"id{k}", n, f"{f}::{n}", "function", f, 1, 1, "public", None, "local") for k, (n, f) in enumerate((("a_b_a_b", "a/b.py"), ("b_a", "b/b/b.py"), ("ab", "a.py"), ("_", "-")))]
    symbols = spark.createDataFrame(s, schema.SYMBOLS)
    index = search.SearchIndex.build(symbols)
    assert index.postings.columns == ["row", "token", "places"] and index.postings.groupBy("row", "token").count().where("count > 1").isEmpty()
    for query in ("a", "b", "a_b", "b_a", "a_b_a", "b_b", "py_a", "py a b", "ab", "_"):
        scan, held = (sorted(map(tuple, x.collect())) for x in (search.search_prefix(symbols, query), index.matching(query)))
        assert scan == held, query
