"""The resolver's cascades, language by language, over sources that the part table stands for. Each part is a folder with a
file of a type, its method, a function, and types that other files have as well, a file of a type that every folder has,
and a file in a folder of its own with a type that two have."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import symbol_id
from ..operators import resolve
from ..storage import cut

EXTENSIONS = {"python": "py", "typescript": "ts", "javascript": "js", "java": "java", "csharp": "cs", "kotlin": "kt", "php": "php", "ruby": "rb", "swift": "swift", "objc": "m", "c": "c", "cpp": "cpp", "rust": "rs", "go": "go"}
BUILTIN = {"python": "len", "typescript": "parseInt", "javascript": "setTimeout", "java": "Math", "csharp": "Console", "kotlin": "listOf", "php": "strlen", "ruby": "puts", "swift": "fatalError", "objc": "NSLog", "rust": "vec!", "go": "append"}
NEXT, FAR, WIDE = "((k + 1) % n)", "((k + 3) % n)", "((k + 5) % n)"


def _file(x: str, language: str, folder: str = "b", name: str = "P") -> str:
    return f"'src/{folder}' || {x} || '/{name}' || {x} || '.{EXTENSIONS[language]}'"


def _pair(x: str) -> str:
    """A number that two neighbouring files share."""
    return f"({x} - {x} % 2)"


@dataclass(frozen=True)
class Case:
    """A dependency that every file's method has, as SQL over k and n: its target, the import beside it, and what the
    resolver is to make of it: the tier and the qualified name."""

    target: str
    tier: str
    wanted: str | None = None
    imported: tuple[str, str] | None = None  # source, kind


def _module(x: str, language: str, name: str | None = None, folder: str = "b", file: str = "P") -> str:
    """The text of an import of a file of x, or of a name in it."""
    if language in ("typescript", "javascript", "ruby", "c", "cpp", "objc"):
        head, between, link, end = f"../{folder}", f"/{file}", "::", " || '.h'" if language in ("c", "cpp", "objc") else ""
    elif language in ("python", "rust"):
        head, between, link, end = f"{'src' if language == 'python' else 'crate'}::{folder}", f"::{file}", "::", ""
    else:
        dot = "\\" if language == "php" else "."
        head, between, link, end = f"src{dot}{folder}", f"{dot}{file}", "::" if language == "java" else dot, ""
    return f"'{head}' || {x} || '{between}' || {x}{end}" + (f" || '{link}' || {name}" if name else "")


def cases(language: str) -> list[Case]:
    file = lambda x: _file(x, language)
    inside = lambda x, name: f"{file(x)} || '::' || {name}"
    group = lambda name: f"{_file(WIDE, language, 'g', 'G')} || '::' || {name}"
    whole = (_module(WIDE, language, None, "g", "G"), "glob")
    own, near, twin, grouped = "'P' || k", f"'P' || {NEXT}", f"'Twin' || {_pair(FAR)}", f"'Group' || {_pair(WIDE)}"
    paths = language in ("rust", "go")
    out = [
        Case("'Shared'", "import_glob", inside(FAR, "'Shared'")) if language == "ruby" else Case("'Shared'", "path" if paths else "same_file", inside("k", "'Shared'")), Case(f"'only' || {NEXT}", "unique_name", inside(NEXT, f"'only' || {NEXT}")), Case("'missing' || k", "unresolved"),
        Case("'P' || ((k + 7) % n)", "unique_name", inside("((k + 7) % n)", "'P' || ((k + 7) % n)")),
        Case("'Local'", "same_package", f"'src/b' || k || '/Local.{EXTENSIONS[language]}::Local'") if language in ("java", "csharp", "kotlin", "php") else Case("'locally'", "unresolved"),
    ]
    if language in BUILTIN:
        out.append(Case(f"'{BUILTIN[language]}'", "builtin", f"'<builtin>::{BUILTIN[language]}'"))
    if language in ("python", "typescript", "javascript"):
        out += [Case(near, "import_exact", inside(NEXT, near), (_module(NEXT, language, near), "named")), Case(twin, "import_exact", inside(FAR, twin), (_module(FAR, language, twin), "named"))]
        out += [Case(grouped, "import_glob", group(grouped), whole), Case("'Outer' || k", "external", "'<external>::lib::Outer' || k", ("'lib::Outer' || k", "named"))]
    elif language in ("java", "csharp", "kotlin", "php"):
        dot = "\\" if language == "php" else "."
        out.append(Case(near, "import_exact", inside(NEXT, near), (_module(NEXT, language), "alias" if language == "csharp" else "named")))
        out.append(Case(twin, "import_exact", inside(FAR, twin), (_module(FAR, language, twin), "named")) if language != "csharp" else Case(twin, "unresolved"))
        out += [Case(grouped, "import_glob", group(grouped), (f"'src{dot}g' || {WIDE}", "glob")), Case("'Outer' || k", "external", f"'<external>::lib{dot}Outer' || k", (f"'lib{dot}Outer' || k", "named"))]
    elif language in ("c", "cpp", "objc", "ruby"):
        kind = "glob" if language == "ruby" else "named"
        out += [Case(twin, "import_glob", inside(FAR, twin), (_module(FAR, language), kind)), Case(grouped, "import_glob", group(grouped), (whole[0], kind))]
        if language == "objc":
            out.append(Case("'run'", "sibling", inside("k", f"{own} || '::run'")))
        if language == "ruby":
            out.append(Case(f"'P' || {NEXT} || '::VALUE'", "suffix", inside(NEXT, f"{near} || '::VALUE'")))
    elif language == "swift":
        out += [Case(f"'P' || {NEXT} || '.run'", "suffix_only", inside(NEXT, f"{near} || '::run'")), Case("'Lib.make'", "external", "'<external>::Lib::make'", ("'Lib'", "glob")), Case("'Outer' || k", "external", "'<external>::Lib::Outer' || k")]
    elif language == "rust":
        out += [Case(near, "path", inside(NEXT, near), (_module(NEXT, language, near), "named")), Case(twin, "path", inside(FAR, twin), (_module(FAR, language, twin), "named")), Case(grouped, "path", group(grouped), whole)]
        out += [Case("'self.run'", "receiver", inside("k", f"{own} || '::run'")), Case("'self.next.run'", "receiver", inside(NEXT, f"{near} || '::run'")), Case("'Self::run'", "path", inside("k", f"{own} || '::run'"))]
        out += [Case(f"'super::P' || k || '::only' || k", "path", inside("k", "'only' || k")), Case(f"'P' || {WIDE} || '::run'", "method_suffix", inside(WIDE, f"'P' || {WIDE} || '::run'")), Case("'std::mem::swap'", "external", "'<external>::std::mem::swap'")]
    if language == "go":
        out.append(Case("'arg.run'", "receiver", inside(NEXT, f"{near} || '::run'")))
    return out


def sources(spark: SparkSession, sf_dir: str, language: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, raw dependencies, imports) of the files."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    rows = parts.crossJoin(F.broadcast(parts.agg(F.count(F.lit(1)).alias("n"))))  # one row
    rows = rows.withColumns({"file_path": F.expr(_file("k", language)), "local": F.expr(f"'src/b' || k || '/Local.{EXTENSIONS[language]}'"), "group": F.expr(_file("k", language, "g", "G"))})
    near = f"'P' || {NEXT}"
    made = [
        ("'P' || k", "'P' || k", "class", "NULL"), ("'P' || k || '::run'", "'run'", "method", f"'(arg: &' || {near} || ')'"), ("'only' || k", "'only' || k", "function", "NULL"), ("'Shared'", "'Shared'", "class", "NULL"),
        (f"'Twin' || {_pair('k')}", f"'Twin' || {_pair('k')}", "class", "NULL"), ("'P' || k || '::VALUE'", "'VALUE'", "constant", "NULL"),
        ("'P' || k || '::next'", "'next'", "property", f"'Box<' || {near} || '>'"), ("'Local'", "'Local'", "class", "NULL"), (f"'Group' || {_pair('k')}", f"'Group' || {_pair('k')}", "class", "NULL"),
    ]
    structs = ", ".join(f"named_struct('at', {'local' if 'Local' in t else 'group' if 'Group' in t else 'file_path'}, 'tail', {t}, 'name', {n}, 'kind', '{kind}', 'signature', CAST({s} AS STRING), 'line', {i})" for i, (t, n, kind, s) in enumerate(made))
    symbols = rows.select(F.expr(f"inline(array({structs}))")).withColumnRenamed("at", "file_path").withColumn("qualified_name", F.concat("file_path", F.lit("::"), "tail"))
    symbols = symbols.select(symbol_id(F.col("qualified_name")).alias("id"), "name", "qualified_name", "kind", "file_path", "line", F.lit(1).alias("col"), F.lit("public").alias("visibility"), "signature", F.lit("local").alias("source"))
    found = cases(language)
    quoted = lambda e: e.replace("\\", "\\\\")  # noqa: E731 - a backslash in Spark's strings
    targets = ", ".join(f"named_struct('to_symbol', {quoted(c.target)}, 'from_line', {i})" for i, c in enumerate(found))
    raw = rows.select(F.concat("file_path", F.lit("::P"), F.col("k").cast("string"), F.lit("::run")).alias("from_symbol"), F.col("file_path").alias("from_file"), F.expr(f"inline(array({targets}))")).withColumn("kind", F.lit("call"))
    imported = ", ".join(f"named_struct('source', {quoted(c.imported[0])}, 'line', {i}, 'kind', '{c.imported[1]}')" for i, c in enumerate(found) if c.imported)
    imports = rows.select("file_path", F.expr(f"inline(array({imported}))" if imported else "inline(array(named_struct('source', 'none', 'line', 0, 'kind', 'reexport_named')))"))
    return symbols, raw.select("from_symbol", "to_symbol", "from_file", "from_line", "kind"), imports.withColumn("alias", F.lit(None).cast("string"))


def language_query(language: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        symbols, raw, imports = sources(spark, sf_dir, language)
        # the tiers read these a dozen times: as tables each is a scan, not a plan of its own to hold and compile
        return resolve.resolve(cut(symbols), raw, cut(imports), language).tagged.select("from_symbol", "from_line", "tier", "to_id")

    return run


def language_sql(language: str) -> str:
    """What is wanted of every case, in SQL."""
    each = " UNION ALL ".join(f"SELECT {_file('k', language)} || '::P' || k || '::run' AS from_symbol, {i} AS from_line, '{c.tier}' AS tier, {f'sha256({c.wanted})' if c.wanted else 'NULL'} AS to_id FROM p" for i, c in enumerate(cases(language)))
    return f"WITH p AS (SELECT p_partkey AS k, count(*) OVER () AS n FROM part) {each}"
