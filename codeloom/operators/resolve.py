"""The resolver: textual targets of raw dependencies become symbols. Every tier proposes symbols for the distinct targets by
an equi-join, and of all that is proposed for a target the first tier's stands."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import symbol_id
from ..schema import SYNTHETIC_KINDS
from ..storage import cut
from . import modules, rustpaths
from .modules import bound_name, unique_by
from .rustpaths import KEY

#: Names that each language has built in.
BUILTINS = {
    "rust": ("assert!", "assert_eq!", "assert_ne!", "dbg!", "eprint!", "eprintln!", "format!", "panic!", "print!", "println!", "todo!", "unimplemented!", "vec!", "write!", "writeln!"),
    "python": ("bool", "dict", "enumerate", "filter", "float", "int", "len", "list", "map", "max", "min", "open", "print", "range", "set", "sorted", "str", "sum", "super", "tuple", "zip"),
    "typescript": ("Array", "BigInt", "Boolean", "Date", "JSON", "Map", "Math", "Number", "Promise", "RegExp", "Set", "String", "clearInterval", "clearTimeout", "parseFloat", "parseInt", "queueMicrotask", "setInterval", "setTimeout"),
    "java": ("Boolean", "Byte", "Class", "Double", "Exception", "Float", "Integer", "Long", "Math", "Object", "RuntimeException", "Short", "String", "StringBuilder", "StringBuffer", "System", "Thread"),
    "csharp": ("Array", "Boolean", "Console", "DateTime", "Decimal", "Double", "Exception", "Guid", "Int32", "Int64", "Math", "Object", "String", "StringBuilder", "Task", "ValueTask"),
    "kotlin": ("Any", "Array", "Boolean", "Double", "Float", "Int", "Long", "Nothing", "String", "Unit", "check", "emptyList", "emptyMap", "emptySet", "listOf", "mapOf", "print", "println", "require", "runCatching", "setOf"),
    "php": ("array_filter", "array_map", "array_merge", "array_reduce", "count", "explode", "implode", "in_array", "is_array", "is_null", "json_decode", "json_encode", "sprintf", "strlen", "strtolower", "strtoupper", "substr", "trim"),
    "ruby": ("Array", "File", "Hash", "String", "Time", "p", "pp", "print", "puts"),
    "swift": ("Any", "Array", "Bool", "Dictionary", "Double", "Error", "Float", "Int", "Never", "Optional", "Result", "Set", "String", "Task", "UInt", "fatalError", "print"),
    "objc": ("NSLog",),
    "go": ("append", "cap", "clear", "close", "complex", "copy", "delete", "imag", "len", "make", "max", "min", "new", "panic", "print", "println", "real", "recover"),
}
BUILTINS["javascript"] = BUILTINS["typescript"]
RUST_STANDARD = ("std", "core", "alloc")
#: Rows of what names mean that a join broadcasts.
FEW = 50_000

#: The tiers of each language, the first to propose a symbol wins. A tier ending in _full takes the whole target, the
#: others what remains of it after the last separator.
SCRIPT = ("same_file", "import_exact", "import_glob", "unique_name")
TYPED = ("same_file", "import_exact", "import_glob", "same_package", "unique_name")
PATHS = ("receiver", "path", "method_suffix", "same_file_full", "unique_name_full")
CASCADES = {
    "python": SCRIPT, "typescript": SCRIPT, "javascript": SCRIPT, "java": TYPED, "csharp": TYPED, "kotlin": TYPED, "php": TYPED,
    "ruby": ("import_glob_full", "suffix", "same_file_full", "same_file", "import_glob", "unique_name"), "swift": ("suffix_only", "same_file_full", "same_file", "unique_name"),
    "objc": ("sibling", "same_file", "import_glob", "unique_name"), "c": ("same_file", "import_glob", "unique_name"), "cpp": ("same_file", "import_glob", "unique_name"), "rust": PATHS, "go": PATHS,
}


def bare(target: Column, language: str = "python") -> Column:
    """The last name of a target: what follows its last dot or colon, in PHP also backslash, without marks at the end."""
    marks = r".:\\" if language == "php" else ".:"
    return F.regexp_extract(F.regexp_replace(target, "!+$", ""), rf"([^{marks}]+)[{marks}]*$", 1)


def builtin(target: Column, language: Column) -> Column:
    """Whether a target is built in: Rust compares it as it is, other languages without exclamation marks."""
    trimmed = F.trim(target)
    plain = F.regexp_replace(trimmed, "!+$", "")
    out = F.lit(False)
    for name, listed in BUILTINS.items():
        out = F.when(language == name, (trimmed if name == "rust" else plain).isin(*listed)).otherwise(out)
    return out


def suffix_index(symbols: DataFrame) -> DataFrame:
    """(suffix, id): every ``::`` suffix of a qualified name that only one symbol has."""
    parts = F.split("qualified_name", "::")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "::"))
    return unique_by(symbols.select(F.explode(suffixes).alias("suffix"), "id"), "suffix")


@dataclass
class Scope:
    """What the tiers of one language look at; imported and globbed are there if the language has such tiers."""

    language: str
    symbols: DataFrame
    imports: DataFrame
    keys: DataFrame  # KEY, target, bare, owner
    exported: DataFrame | None = None  # module, name, id
    exact: DataFrame | None = None  # file_path, bound, id
    globs: DataFrame | None = None  # file_path, source, module

    @classmethod
    def of(cls, language: str, symbols: DataFrame, imports: DataFrame, raw: DataFrame) -> Scope:
        target = F.regexp_replace("to_symbol", "!+$", "")
        owner = F.regexp_extract(F.expr("substr(from_symbol, length(from_file) + 3)"), "^(.*)::[^:]*$", 1)
        keys = cut(raw.select(*KEY).distinct().select(*KEY, target.alias("target"), bare(F.col("to_symbol"), language).alias("bare"), owner.alias("owner")).where("bare <> ''"))
        out = cls(language, symbols, imports, keys)
        if language in ("python", "typescript", "javascript"):
            out.exported = modules.exports(symbols, modules.passed_on(imports, language))
            out.exact = modules.import_bindings(symbols, out.exported, imports, language)
            out.globs = modules.glob_modules(imports, language)
        elif language in modules.TYPE_PATHS:
            out.exact = modules.type_bindings(symbols, imports, language)
            out.globs, out.exported = modules.type_globs(symbols, imports, language)
        elif language == "ruby":
            public = symbols.where(F.col("kind").isin(*modules.RUBY_EXPORTS))
            names = unique_by(public, "file_path", "name").withColumnRenamed("file_path", "module")
            paths = public.select(F.col("file_path").alias("module"), F.expr("substr(qualified_name, length(file_path) + 3)").alias("name"), "id")
            out.exported, out.globs = names.unionByName(paths).distinct(), modules.glob_modules(imports, language)
        elif language in modules.INCLUDES:
            out.exported = unique_by(symbols, "file_path", "name").withColumnRenamed("file_path", "module")
            out.globs = modules.glob_modules(imports, language, ("named", "glob", "alias"))
        return out

    def propose(self, tier: str) -> DataFrame:
        """(KEY, order, id): what a tier makes of the targets; of several proposals the least order stands."""
        name = F.col("target" if tier.endswith("_full") else "bare")
        keys, kind = self.keys.withColumn("name", name), tier.removesuffix("_full")
        in_file = keys.withColumnRenamed("from_file", "file_path")
        if kind == "same_file":
            hits = in_file.join(unique_by(self.symbols, "file_path", "name"), ["file_path", "name"]).withColumnRenamed("file_path", "from_file")
        elif kind == "import_exact":
            hits = in_file.join(self.exact.withColumnRenamed("bound", "name"), ["file_path", "name"]).withColumnRenamed("file_path", "from_file")
        elif kind == "import_glob":
            found = modules.glob_bindings(self.exported, self.globs, in_file.select("file_path", F.col("name").alias("bound")))
            hits = in_file.join(found.withColumnRenamed("bound", "name"), ["file_path", "name"]).withColumnRenamed("file_path", "from_file")
        elif kind == "same_package":
            file = F.concat(modules.folder_of(F.col("from_file")), "name", F.lit(f".{modules.TYPE_PATHS[self.language][1]}"))
            hits = keys.withColumn("file_path", file).join(unique_by(modules.top_level(self.symbols, self.language), "file_path", "name"), ["file_path", "name"])
        elif kind == "unique_name":
            hits = keys.join(unique_by(self.symbols, "name"), "name")
        elif kind == "sibling":
            hits = keys.where("owner <> ''").withColumn("qualified_name", F.concat_ws("::", "from_file", "owner", "bare")).join(self.symbols.select("qualified_name", "id"), "qualified_name")
        elif kind in ("suffix", "suffix_only"):
            known = self.symbols.where(F.col("kind").isin(*modules.RUBY_EXPORTS)) if self.language == "ruby" else self.symbols
            mark, path = ("::", F.col("target")) if kind == "suffix" else (".", F.replace("target", F.lit("."), F.lit("::")))
            hits = keys.where(F.col("target").contains(mark)).withColumn("suffix", path).join(suffix_index(known), "suffix")
        elif kind == "receiver":
            hits = rustpaths.receiver_owners(self.keys, self.symbols).join(rustpaths.method_suffixes(self.symbols), "path")
        elif kind == "method_suffix":
            hits = keys.withColumn("path", F.trim("target")).join(rustpaths.method_suffixes(self.symbols), "path")
        else:
            made = rustpaths.path_candidates(self.keys, *rustpaths.import_paths(self.imports))
            return made.join(rustpaths.symbol_paths(self.symbols).withColumnRenamed("path", "candidate"), "candidate").select(*KEY, F.col("candidate").alias("order"), "id")
        return hits.select(*KEY, F.lit("").alias("order"), "id")

    def outside(self) -> Iterator[DataFrame]:
        """(KEY, external): targets that imports say are not of the project, the surest first."""
        keys = self.keys.withColumnRenamed("from_file", "file_path")
        only = lambda rows: rows.groupBy("from_symbol", "file_path", "to_symbol").agg(F.count_distinct("external").alias("n"), F.min("external").alias("external")).where("n = 1").select("from_symbol", F.col("file_path").alias("from_file"), "to_symbol", "external")
        named = self.imports.where(modules.BINDING).select("file_path", bound_name(F.col("source"), F.col("alias")).alias("bare"), "source")
        globs = self.imports.where("kind = 'glob'").select("file_path", "source")
        upper = F.col("bare").rlike("^[A-Z]")
        if self.language in ("python", "typescript", "javascript", "go"):
            inside = {"python": F.col("source").startswith("::"), "go": F.col("source") == ""}.get(self.language, F.col("source").startswith(".") | F.col("source").startswith("/"))
            yield only(keys.join(named.where(~inside), ["file_path", "bare"]).withColumn("external", F.col("source")))
            if self.globs is not None:  # a module that is a file of the project is not outside it
                held = self.globs.join(self.symbols.select(F.col("file_path").alias("module")).distinct(), "module", "left_semi")
                globs = globs.join(held.select("file_path", "source"), ["file_path", "source"], "left_anti")
            yield only(keys.join(globs.where(~inside), "file_path").withColumn("external", F.concat("source", F.lit("::"), "bare")))
        elif self.language in modules.TYPE_PATHS:
            foreign = named.join(self.exact.select("file_path", F.col("bound").alias("bare"), "source"), ["file_path", "bare", "source"], "left_anti")
            yield only(keys.join(foreign, ["file_path", "bare"]).withColumn("external", F.col("source")))
            if self.language != "php":
                held = self.globs.join(self.exported.select("module").distinct(), "module", "left_semi")
                link = F.when(F.lit(self.language == "java") & F.col("source").rlike(r"(^|\.)[A-Z][^.]*$"), "::").otherwise(".")
                foreign = globs.join(held.select("file_path", "source"), ["file_path", "source"], "left_anti")
                yield only(keys.join(foreign, "file_path").withColumn("external", F.concat("source", link, "bare")))
        elif self.language == "rust":
            exact, whole = rustpaths.import_paths(self.imports)
            first, rest = F.regexp_extract("target", "^(.*?)(::|$)", 1), F.regexp_extract("target", "^.*?(::.*)$", 1)
            imported = keys.withColumns({"bound": first, "rest": rest}).join(exact, ["file_path", "bound"])
            yield only(imported.withColumn("external", F.concat("path", "rest")).where("not local"))
            yield only(keys.where(F.col("target").contains("::") & first.isin(*RUST_STANDARD)).withColumn("external", F.col("target")))
            short = keys.where(~F.col("target").contains("::")).join(whole, "file_path")
            yield only(short.where("not local").withColumn("external", F.concat("module", F.lit("::"), "target")))
        elif self.language == "swift":
            dotted = keys.where(F.col("target").contains(".")).withColumn("head", F.regexp_extract("target", r"^([^.]*)", 1))
            known = dotted.join(self.symbols.select(F.col("name").alias("head")), "head", "left_semi").join(globs.withColumnRenamed("source", "head"), ["file_path", "head"], "left_anti")
            yield only(dotted.join(known.select("from_symbol", "file_path", "to_symbol"), ["from_symbol", "file_path", "to_symbol"], "left_anti").withColumn("external", F.replace("target", F.lit("."), F.lit("::"))))
            yield only(keys.where(upper).join(globs, "file_path").withColumn("external", F.concat("source", F.lit("::"), "bare")))
        elif self.language == "objc":
            heads = self.imports.select("file_path", F.split("source", "/")[0].alias("head")).where("head <> '' and not head like '%.h'")
            yield only(keys.where(upper).join(heads, "file_path").withColumn("external", F.concat("head", F.lit("::"), "bare")))


@dataclass
class Resolution:
    """resolved: edges; non_local: synthetic symbols; unresolved: raw rows. ``tagged`` has all raw rows with their tier."""

    tagged: DataFrame
    resolved: DataFrame
    non_local: DataFrame
    unresolved: DataFrame


def resolve(symbols: DataFrame, raw: DataFrame, imports: DataFrame, language: str = "python", tiers: tuple[str, ...] | None = None) -> Resolution:
    """Resolves raw dependencies of a language by its cascade, or by those of its ``tiers`` that are given; what no tier
    names may be built in or, by its file's imports, external; the rest is unresolved.

    Proposals are made once for each distinct (source, file, target), and all tiers' are settled by one aggregation, so
    that neither a hot name nor a file with many imports multiplies rows."""
    source = symbols.select(F.col("qualified_name").alias("from_symbol"), F.col("id").alias("from_id"))
    rows = raw.join(source, "from_symbol", "left")
    scope = Scope.of(language, symbols, imports, rows.where("from_id is not null"))
    wanted = CASCADES[language] if tiers is None else tiers
    best = None
    for k, tier in enumerate(wanted):
        made = scope.propose(tier).select(*KEY, F.struct(F.lit(k).alias("k"), F.col("order"), F.col("id"), F.lit(tier.removesuffix("_full")).alias("tier")).alias("p"))
        best = made if best is None else best.unionByName(made)
    best = best.groupBy(*KEY).agg(F.min("p").alias("p"))
    if language == "swift" and "suffix_only" in wanted:  # a dotted target that is no suffix is nothing else either
        best = best.where((F.col("p.tier") == "suffix_only") | ~F.col("to_symbol").contains("."))
    outside = None
    for k, found in enumerate(scope.outside()):
        made = found.select(*KEY, F.struct(F.lit(k).alias("k"), F.col("external")).alias("e"))
        outside = made if outside is None else outside.unionByName(made)
    rows = rows.join(best, list(KEY), "left")
    rows = rows.join(outside.groupBy(*KEY).agg(F.min("e.k").alias("k"), F.min("e").alias("e")), list(KEY), "left") if outside is not None else rows.withColumn("e", F.lit(None).cast("struct<external: string>"))
    tier = F.when(F.col("from_id").isNull(), "unresolved").when(F.col("p").isNotNull(), F.col("p.tier")).when(builtin(F.col("to_symbol"), F.lit(language)), "builtin").when(F.col("e").isNotNull(), "external").otherwise("unresolved")
    name = F.when(tier == "builtin", F.concat(F.lit("<builtin>::"), F.trim("to_symbol"))).when(tier == "external", F.concat(F.lit("<external>::"), F.col("e.external")))
    tagged = rows.select("from_id", "from_symbol", "to_symbol", "from_file", "from_line", "kind", tier.alias("tier"), F.when(tier != "unresolved", F.coalesce("p.id", symbol_id(name))).alias("to_id"), name.alias("synthetic"))
    return split(tagged)


def resolve_names(symbols: DataFrame, raw: DataFrame, imports: DataFrame, language: str = "python", tiers: tuple[str, ...] = ("same_file", "import_exact", "unique_name")) -> Resolution:
    """``resolve`` for closed graphs whose ids are their qualified names, and for tiers that look at a file and a name alone:
    every from_symbol of ``raw`` is a symbol, under any name that its file completes, and every import one of a symbol
    by its qualified name, so that nothing is external. Callers hash the ids that they return.

    A row of raw moves once, to the names that its file knows, at its own width: what a name means is settled beside it,
    for names that are asked for, and broadcast where it is FEW rows by count."""
    target = F.col("to_symbol")
    plain = ~(target.contains(".") | target.contains(":") | target.contains("!") | (target == ""))
    plain = plain & ~target.contains("\\") if language == "php" else plain
    rows = raw.withColumn("bare", F.when(plain, target).otherwise(F.nullif(bare(target, language), F.lit(""))))
    if {"same_file", "unique_name"} & set(tiers):
        asked = rows.select(F.col("bare").alias("name")).distinct()
        symbols = cut(symbols.select("name", "file_path", "id").join(asked, "name", "left_semi"), True, "zstd")
    made = {
        "same_file": lambda: unique_by(symbols.select(F.col("file_path").alias("from_file"), F.col("name").alias("bare"), "id"), "from_file", "bare"),
        "import_exact": lambda: modules.named_bindings(imports).toDF("from_file", "bare", "id"),
        "unique_name": lambda: unique_by(symbols.select(F.col("name").alias("bare"), "id"), "bare"),
    }
    for t in tiers:
        found = cut(made[t]().withColumnRenamed("id", t), True, "zstd")
        found = F.broadcast(found) if found.count() <= FEW else found.hint("merge")  # never by the size of its files
        rows = rows.join(found, ["bare"] if t == "unique_name" else ["from_file", "bare"], "left")
    settled = F.coalesce(*(F.when(F.col(t).isNotNull(), F.lit(t)) for t in tiers))
    inner = F.trim(target) if language == "rust" else F.regexp_replace(F.trim(target), "!+$", "")
    tier = F.coalesce(settled, F.when(inner.isin(*BUILTINS.get(language, ())), "builtin"), F.lit("unresolved"))
    name = F.when(tier == "builtin", F.concat(F.lit("<builtin>::"), F.trim("to_symbol")))
    tagged = rows.select(F.col("from_symbol").alias("from_id"), "from_symbol", "to_symbol", "from_file", "from_line", "kind", tier.alias("tier"), F.coalesce(*tiers, name).alias("to_id"), name.alias("synthetic"))
    return split(tagged, inner.isin(*BUILTINS.get(language, ())))


def split(tagged: DataFrame, outer: Column | None = None) -> Resolution:
    """Rows with their tiers as edges, synthetic symbols and what is left. Callers that read more than one of these write
    the tagged rows first. ``outer``: what holds for all rows of synthetic symbols and is known before their tier."""
    made = tagged.where("synthetic is not null") if outer is None else tagged.where(outer).where("synthetic is not null")
    resolved = tagged.where("tier <> 'unresolved'").select(F.col("from_id").alias("from_symbol"), F.col("to_id").alias("to_symbol"), "from_file", "from_line", "kind")
    return Resolution(tagged, resolved, synthetic_symbols(made), tagged.where("tier = 'unresolved'").select("from_symbol", "to_symbol", "from_file", "from_line", "kind"))


def synthetic_symbols(tagged: DataFrame) -> DataFrame:
    """One symbol for each thing outside the project; of several kinds of edges into it the first decides its kind."""
    kind = F.create_map(*(F.lit(x) for kv in SYNTHETIC_KINDS.items() for x in kv))[F.min("kind")]
    each = tagged.groupBy(F.col("synthetic").alias("qualified_name")).agg(kind.alias("kind"))
    path = F.regexp_extract("qualified_name", "^(<[a-z]+>)", 1)
    return each.select(
        symbol_id(F.col("qualified_name")).alias("id"), F.element_at(F.split("qualified_name", "::"), -1).alias("name"), "qualified_name", "kind", path.alias("file_path"), F.lit(1).alias("line"), F.lit(1).alias("col"), F.lit("public").alias("visibility"),
        F.lit(None).cast("string").alias("signature"), F.regexp_extract(path, "<([a-z]+)>", 1).alias("source"),
    )
