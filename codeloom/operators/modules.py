"""Modules: the files that an import can mean, what a file exports, and what imports bind to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import symbol_id
from ..storage import cut

#: Extensions that a module or include may have.
SCRIPT_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
INCLUDES = {"c": ("h", "c"), "cpp": ("h", "hh", "hpp", "hxx", "cc", "cpp", "cxx"), "objc": ("h", "m")}
RUBY_EXTENSIONS = ("rb", "rake")
#: Of languages whose imports name types by dotted paths: the separator, the extension, and the kinds that a file's top
#: level gives to others.
TYPE_PATHS = {
    "java": (".", "java", ("class", "interface", "enum")),
    "csharp": (".", "cs", ("class", "interface", "struct", "enum")),
    "kotlin": (".", "kt", ("class", "interface", "enum", "function", "property", "constant")),
    "php": ("\\", "php", ("class", "interface", "trait", "enum", "function", "constant")),
}
RUBY_EXPORTS = ("class", "module", "function", "constant")
MEMBERS = ("method", "property", "constant")
#: Rounds that names may be passed on before they settle; more can only be a cycle that keeps changing its mind.
ROUNDS = 64

#: Imports of single names.
BINDING = "kind in ('named', 'alias', 'self')"
_NO_PATHS = "array<string>"


def folder_of(file: Column) -> Column:
    """The folder with a slash at its end, or nothing."""
    return F.regexp_extract(file, "^(.*/)?[^/]*$", 1)


def normalise(path: Column) -> Column:
    """A path without ``.`` and ``..``."""

    def step(done: Column, part: Column) -> Column:
        back = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin("", "."), done).when(part == "..", back).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast(_NO_PATHS), step), "/")


def has_extension(path: Column) -> Column:
    return path.rlike(r"[^/.][^/]*\.[^/.]+$")


def _sorted(paths: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(paths, lambda p: p.isNotNull() & (p != ""))))


def script_candidates(file: Column, source: Column) -> Column:
    """Files that a TypeScript or JavaScript module can mean, sorted: relative to the file, or from the root after a
    slash; as it is if it has an extension, else twelve; none for modules by name."""
    base = normalise(F.when(source.startswith("/"), source).otherwise(F.concat(folder_of(file), source)))
    each = F.array(*(F.concat(base, F.lit(f"{middle}.{e}")) for e in SCRIPT_EXTENSIONS for middle in ("", "/index")))
    found = F.when(has_extension(base), F.array(base)).otherwise(F.array_sort(each))
    return F.when(source.startswith(".") | source.startswith("/"), found).otherwise(F.array().cast(_NO_PATHS))


def python_candidates(file: Column, source: Column) -> Column:
    """Files that a Python module (dots as ``::``, leading ones for relative levels) can mean, sorted."""
    level = (F.char_length(F.regexp_extract(source, "^((?:::)*)", 1)) / 2).cast("int")
    folders = F.filter(F.split(folder_of(file), "/"), lambda p: p != "")
    up = F.array_join(F.slice(folders, 1, F.greatest(F.size(folders) - F.greatest(level - 1, F.lit(0)), F.lit(0))), "/")
    inner = F.replace(F.regexp_replace(source, "^(::)+", ""), F.lit("::"), F.lit("/"))
    under = lambda head: F.concat_ws("/", F.when(head != "", head), F.when(inner != "", inner))
    top = F.coalesce(F.try_element_at(folders, F.lit(1)), F.lit(""))
    bases = F.when(level > 0, F.array(under(up))).otherwise(F.array(under(top), inner))
    return _sorted(F.flatten(F.transform(bases, lambda b: F.array(F.when(b != "", F.concat(b, F.lit(".py"))), F.concat_ws("/", F.when(b != "", b), F.lit("__init__.py"))))))


def include_candidates(file: Column, source: Column, language: str) -> Column:
    """Files that an include can mean: beside the file and from the root, as written and with companion extensions."""
    bases = F.array(normalise(F.concat(folder_of(file), source)), normalise(source))
    stem = lambda b: F.when(has_extension(b), F.regexp_replace(b, r"\.[^./]*$", "")).otherwise(b)
    each = lambda b: F.array(F.when(has_extension(b), b), *(F.concat(stem(b), F.lit(f".{e}")) for e in INCLUDES[language]))
    return _sorted(F.flatten(F.transform(F.filter(bases, lambda b: b != ""), each)))


def ruby_candidates(file: Column, source: Column) -> Column:
    """Files that ``require`` can mean: relative ones beside the file, others from the root or beside it."""
    beside = normalise(F.concat(folder_of(file), source))
    bases = F.when(source.startswith("./") | source.startswith("../"), F.array(beside)).otherwise(F.array(normalise(source), beside))
    return _sorted(F.flatten(F.transform(bases, lambda b: F.when(has_extension(b), F.array(b)).otherwise(F.array(*(F.concat(b, F.lit(f".{e}")) for e in RUBY_EXTENSIONS))))))


def candidates(file: Column, source: Column, language: str) -> Column:
    """What a module's name can mean in a language: the files that its rule makes of it, and a file that is called so."""
    if language in ("typescript", "javascript"):
        found = script_candidates(file, source)
    elif language == "python":
        found = python_candidates(file, source)
    elif language == "ruby":
        found = ruby_candidates(file, source)
    elif language in INCLUDES:
        found = include_candidates(file, source, language)
    else:
        found = F.array().cast(_NO_PATHS)
    return F.array_distinct(F.concat(found, F.array(source)))


def bound_name(source: Column, alias: Column) -> Column:
    return F.coalesce(alias, F.regexp_extract(source, r"([^.:/\\]+)[.:/\\]*$", 1))


def unique_by(symbols: DataFrame, *keys: str) -> DataFrame:
    """(keys, id): symbols that are the only one with their keys. Pre-aggregated, so that a hot key is one row."""
    return symbols.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")


def split_source(rows: DataFrame) -> DataFrame:
    """Adds module and target_name, what stands before and after the last ``::`` of source; rows without one are left out."""
    parts = r"^(.*)::([^:]+)$"
    return rows.where(F.col("source").rlike(parts)).withColumns({"module": F.regexp_extract("source", parts, 1), "target_name": F.regexp_extract("source", parts, 2)})


def passed_on(imports: DataFrame, language: str) -> DataFrame:
    """(module, name, target_module, target_name, line): what files export again; of globs name and target_name are ``*``."""
    named = split_source(imports.where("kind in ('reexport_named', 'reexport_alias')")).withColumn("name", bound_name(F.col("source"), F.col("alias")))
    globs = imports.where("kind = 'reexport_glob'").select(*imports.columns, F.col("source").alias("module"), F.lit("*").alias("target_name"), F.lit("*").alias("name"))
    both = named.unionByName(globs)
    return both.select(F.col("file_path").alias("module"), "name", F.explode(candidates(F.col("file_path"), F.col("module"), language)).alias("target_module"), "target_name", "line").distinct()


def exports(symbols: DataFrame, hops: DataFrame) -> DataFrame:
    """(module, name, id): what a name of a file finally stands for. A file's own symbol, if it is the only one of that
    name, comes first; else the first import, by line and path, that passes the name on and leads to a symbol.

    Each round looks a name up where its hops lead by the answers of the round before, until none changes. A cycle alone
    leads nowhere. Rounds are as many as the longest chain of hops; an error says so where they exceed ROUNDS."""
    own = unique_by(symbols, "file_path", "name").withColumnRenamed("file_path", "module")
    if hops.isEmpty():
        return own
    best, before = cut(own), None
    named, globs = hops.where("name <> '*'"), hops.where("name = '*'").select("module", "target_module", "line")
    for _ in range(ROUNDS):
        known = best.select(F.col("module").alias("target_module"), F.col("name").alias("target_name"), "id")
        through = named.join(known, ["target_module", "target_name"]).select("module", "name", "line", "target_module", "id")
        through = through.unionByName(globs.join(known, "target_module").select("module", F.col("target_name").alias("name"), "line", "target_module", "id"))
        first = through.groupBy("module", "name").agg(F.min_by("id", F.struct("line", "target_module", "id")).alias("id"))
        best = cut(own.unionByName(first.join(own, ["module", "name"], "left_anti")))
        mark = best.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(module, name, id))")).first()
        if mark == before:
            return best
        before = mark
    raise RuntimeError(f"exports did not settle in {ROUNDS} rounds")


def reexports(hops: DataFrame) -> DataFrame:
    """(module, name, target_module, target_name): every place that an exported name passes through, hop by hop until no
    new one is found. hops: the same columns, name ``*`` for globs. A place that was seen is not followed twice."""
    each = hops.select("module", "name", "target_module", "target_name").distinct()
    frontier, done = cut(each), []
    while not frontier.isEmpty():
        done.append(frontier)
        step = frontier.alias("a").join(each.alias("b"), (F.col("a.target_module") == F.col("b.module")) & ((F.col("b.name") == "*") | (F.col("b.name") == F.col("a.target_name"))))
        onward = F.when(F.col("b.name") == "*", F.col("a.target_name")).otherwise(F.col("b.target_name"))
        new = step.select("a.module", "a.name", F.col("b.target_module").alias("target_module"), onward.alias("target_name")).distinct()
        for d in done:
            new = new.join(d, ["module", "name", "target_module", "target_name"], "left_anti")
        frontier = cut(new)
    out = each if not done else done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def import_bindings(symbols: DataFrame, exported: DataFrame, imports: DataFrame, language: str) -> DataFrame:
    """(file_path, bound, id): what imports of single names bind: the symbol whose qualified name an import is, or else of
    the files that a module can mean the first, by path, that exports the name. Of imports that bind the same name in a
    file the last line wins."""
    named = split_source(imports.where(BINDING)).where("target_name <> 'default'")
    asked = named.select("file_path", bound_name(F.col("source"), F.col("alias")).alias("bound"), "target_name", "source", "line", F.explode(candidates(F.col("file_path"), F.col("module"), language)).alias("candidate"))
    hits = asked.join(exported.select(F.col("module").alias("candidate"), F.col("name").alias("target_name"), "id"), ["candidate", "target_name"]).select("file_path", "bound", "line", "source", "candidate", "id")
    whole = named.join(symbols.select(F.col("qualified_name").alias("source"), "id"), "source").select("file_path", bound_name(F.col("source"), F.col("alias")).alias("bound"), "line", "source", F.lit("").alias("candidate"), "id")
    first = hits.unionByName(whole).groupBy("file_path", "bound", "line", "source").agg(F.min_by("id", "candidate").alias("id"))
    return first.groupBy("file_path", "bound").agg(F.max_by("id", F.struct("line", "id")).alias("id"))


def named_bindings(imports: DataFrame) -> DataFrame:
    """(file_path, bound, id): ``import_bindings`` where every import is one of a symbol by its qualified name, and that is
    its id. Of imports on the last line the one with the greatest hash wins, as by hashed ids."""
    named = imports.where(BINDING).select("file_path", bound_name(F.col("source"), F.col("alias")).alias("bound"), "source", "line")
    return named.groupBy("file_path", "bound").agg(F.max_by("source", F.struct("line", F.unhex(symbol_id(F.col("source"))))).alias("id"))


def glob_modules(imports: DataFrame, language: str, kinds: tuple[str, ...] = ("glob",)) -> DataFrame:
    """(file_path, source, module): the files that a file imports all names of."""
    rows = imports.where(F.col("kind").isin(*kinds))
    return rows.select("file_path", "source", F.explode(candidates(F.col("file_path"), F.col("source"), language)).alias("module")).distinct()


def glob_bindings(exported: DataFrame, modules: DataFrame, asked: DataFrame) -> DataFrame:
    """(file_path, bound, id): of the names that files ask for (file_path, bound), those that the modules a file imports
    whole give one meaning; a name with two is no one's. Only names that are asked for meet the modules, so that a large
    module costs no more than its use."""
    wanted = asked.distinct().join(modules.select("file_path", "module").distinct(), "file_path")
    hits = wanted.join(exported.select("module", F.col("name").alias("bound"), "id"), ["module", "bound"])
    return hits.groupBy("file_path", "bound").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")


def suffixes(paths: DataFrame) -> DataFrame:
    """(suffix, file_path): every suffix of each distinct path, so that "ends with" is an equi-join."""
    parts = F.split("file_path", "/")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "/"))
    return paths.select("file_path").distinct().select(F.explode(each).alias("suffix"), "file_path")


def top_level(symbols: DataFrame, language: str) -> DataFrame:
    """The symbols that a file's top level gives to others."""
    return symbols.where(F.col("kind").isin(*TYPE_PATHS[language][2]) & (F.col("qualified_name") == F.concat("file_path", F.lit("::"), "name")))


def type_bindings(symbols: DataFrame, imports: DataFrame, language: str) -> DataFrame:
    """(file_path, bound, source, id): imports of Java, C#, Kotlin and PHP that name something in the project.

    ``a.b.C`` is the top-level C of the first file, by path, that is or ends in a/b/C with the language's extension. Java's
    ``a.b.C::m`` is the only m of such a file and nothing else. In Kotlin and PHP, what is no top-level name may be the only
    one of its name in the file of the type before it, or else in the folder that what stands before it names."""
    extension = TYPE_PATHS[language][1]
    slashed = lambda c: F.regexp_replace(c, r"[.\\]" if language == "php" else r"\.", "/")
    named = imports.where(BINDING).select("file_path", bound_name(F.col("source"), F.col("alias")).alias("bound"), "source", "line")
    head, member = F.regexp_extract("source", "^(.*)::[^:]*$", 1), F.regexp_extract("source", "::([^:]*)$", 1)
    named = named.withColumns({"path": F.when(F.col("source").contains("::"), slashed(head)).otherwise(slashed(F.col("source"))), "static": F.when(F.col("source").contains("::"), member)})
    last, before = F.regexp_extract("path", "([^/]*)$", 1), F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    files = suffixes(symbols).withColumnRenamed("file_path", "target")
    unique_top, unique_any = unique_by(top_level(symbols, language), "file_path", "name"), unique_by(symbols, "file_path", "name")

    def found(rows: DataFrame, path: Column, name: Column, among: DataFrame, step: int) -> DataFrame:
        asked = rows.select("file_path", "bound", "source", "line", F.concat(path, F.lit(f".{extension}")).alias("suffix"), name.alias("name"))
        return asked.join(files, "suffix").join(among.withColumnRenamed("file_path", "target"), ["target", "name"]).select("file_path", "bound", "source", "line", F.lit(step).alias("step"), "target", "id")

    hits = found(named.where("static is null"), F.col("path"), last, unique_top, 0)
    if language == "java":
        hits = hits.unionByName(found(named.where("static is not null"), F.col("path"), F.col("static"), unique_any, 0))
    if language in ("kotlin", "php"):
        hits = hits.unionByName(found(named.where(before != ""), before, last, unique_any, 1))
        asked = named.where(before != "").select("file_path", "bound", "source", "line", before.alias("package"), last.alias("name"))
        inside = asked.join(package_exports(symbols, language), ["package", "name"])
        one = inside.groupBy("file_path", "bound", "source", "line").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1")
        hits = hits.unionByName(one.select("file_path", "bound", "source", "line", F.lit(2).alias("step"), F.lit("").alias("target"), "id"))
    first = hits.groupBy("file_path", "bound", "source", "line").agg(F.min_by("id", F.struct("step", "target")).alias("id"))
    return first.groupBy("file_path", "bound").agg(F.max_by(F.struct("source", "id"), "line").alias("b")).select("file_path", "bound", "b.source", "b.id")


def package_exports(symbols: DataFrame, language: str) -> DataFrame:
    """(package, name, id): the top-level symbols of the files of every folder, under each suffix of the folder's path."""
    top = top_level(symbols, language).withColumn("folder", F.regexp_replace(folder_of(F.col("file_path")), "/$", "")).where("folder <> ''")
    under = suffixes(top.select(F.col("folder").alias("file_path"))).toDF("package", "folder")
    return under.join(top.select("folder", "name", "id"), "folder").select("package", "name", "id")


def type_globs(symbols: DataFrame, imports: DataFrame, language: str) -> tuple[DataFrame, DataFrame]:
    """(modules, exported) for ``glob_bindings``: imports of all of a package, or of all members of a type. Modules are
    packages by their path and types by the file and name."""
    extension = TYPE_PATHS[language][1]
    slash = F.regexp_replace("source", r"[.\\]" if language == "php" else r"\.", "/")
    globs = imports.where("kind = 'glob'").select("file_path", "source", slash.alias("path")).distinct()
    packages = package_exports(symbols, language).select(F.col("package").alias("module"), "name", "id")
    members = symbols.where(F.col("kind").isin(*MEMBERS)).withColumn("owner", F.regexp_extract("qualified_name", "^(.*)::[^:]*$", 1)).where("owner <> file_path")
    types = globs.withColumn("suffix", F.concat("path", F.lit(f".{extension}"))).join(suffixes(symbols).withColumnRenamed("file_path", "target"), "suffix")
    owned = types.select("file_path", "source", F.concat("target", F.lit("::"), F.regexp_extract("path", "([^/]*)$", 1)).alias("module"))
    return globs.select("file_path", "source", F.col("path").alias("module")).unionByName(owned), packages.unionByName(members.select(F.col("owner").alias("module"), "name", "id"))
