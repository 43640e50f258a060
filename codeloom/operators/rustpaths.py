"""Rust paths and receivers, which Go shares: absolute paths of symbols and targets, and the types of receivers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .modules import BINDING, bound_name

KEY = ("from_symbol", "from_file", "to_symbol")


def module_path(file: Column) -> Column:
    """The module of a file, from the crate's root: ``src/a/b.rs`` and ``src/a/b/mod.rs`` are a::b, the roots nothing."""
    inner = F.regexp_replace(file, "^src/", "")
    inner = F.regexp_replace(F.regexp_replace(inner, r"\.rs$", ""), "/mod$", "")
    return F.when(inner.isin("lib", "main", "mod") & file.rlike(r"^(src/)?(lib|main|mod)\.rs$"), "").otherwise(F.replace(inner, F.lit("/"), F.lit("::")))


def under(module: Column, path: Column) -> Column:
    return F.when(module == "", path).otherwise(F.concat(module, F.lit("::"), path))


def absolute(path: Column, module: Column) -> Column:
    """``path``, seen from ``module``, from the crate's root: after crate:: as it is, after self:: inside the module, after
    each super:: one module up. Other paths stay as they are."""
    levels = F.regexp_count(F.regexp_extract(path, "^((?:super::)*)", 1), F.lit("super::"))
    parts = F.split(module, "::")
    above = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - levels, F.lit(0))), "::")
    rest = F.regexp_replace(path, "^(super::)+", "")
    return F.when(path.startswith("crate::"), F.substring(path, 8, 1 << 30)).when(path.startswith("self::"), under(module, F.substring(path, 7, 1 << 30))).when(path.startswith("super::"), under(above, rest)).otherwise(path)


def symbol_paths(symbols: DataFrame) -> DataFrame:
    """(path, id): every symbol under its path from the crate's root. Of symbols that share one, the last in the files."""
    rows = symbols.select(under(module_path(F.col("file_path")), F.expr("substr(qualified_name, length(file_path) + 3)")).alias("path"), "id", F.struct("file_path", "line", "col", "id").alias("place"))
    return rows.groupBy("path").agg(F.max_by("id", "place").alias("id"))


def import_paths(imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((file_path, bound, path, local), (file_path, module, local)): what single imports bind to, the last line winning,
    and the modules that a file imports whole, both from the crate's root; local says whether the import began there."""
    local = F.col("source").rlike("^(crate|self|super)(::|$)")
    seen = imports.withColumns({"path": absolute(F.col("source"), module_path(F.col("file_path"))), "local": local})
    named = seen.where(BINDING).select("file_path", bound_name(F.col("source"), F.col("alias")).alias("bound"), "path", "local", "line")
    last = named.groupBy("file_path", "bound").agg(F.max(F.struct("line", "path", "local")).alias("last"))
    return last.select("file_path", "bound", "last.path", "last.local"), seen.where("kind = 'glob'").select("file_path", F.col("path").alias("module"), "local").distinct()


def path_candidates(keys: DataFrame, exact: DataFrame, globs: DataFrame) -> DataFrame:
    """(KEY, candidate) of keys(KEY, target, owner): the paths that a target can mean. With ``::``: inside the owner for
    Self, behind an import of its first name, seen from the module, and inside the module. Else: what an import binds, in
    a module imported whole, and inside the module."""
    module = module_path(F.col("from_file"))
    target = F.col("target")
    long = target.contains("::")
    relative = target.rlike("^(crate|self|super)::")
    own = F.array(
        F.when(long & target.startswith("Self::") & (F.col("owner") != ""), under(module, F.concat("owner", F.substring(target, 5, 1 << 30)))),
        F.when(long, absolute(target, module)), F.when(~long | (~relative & (module != "")), under(module, target)), F.when(~long, target),
    )
    made = keys.select(*KEY, F.explode(F.filter(own, lambda c: c.isNotNull())).alias("candidate"))
    first, rest = F.regexp_extract("target", "^(.*?)(::|$)", 1), F.regexp_extract("target", "^.*?(::.*)$", 1)
    imported = keys.withColumns({"bound": first, "rest": rest}).join(exact.withColumnRenamed("file_path", "from_file"), ["from_file", "bound"])
    made = made.unionByName(imported.select(*KEY, F.concat("path", "rest").alias("candidate")))
    whole = keys.where(~F.col("target").contains("::")).join(globs.withColumnRenamed("file_path", "from_file"), "from_file")
    return made.unionByName(whole.select(*KEY, F.concat("module", F.lit("::"), "target").alias("candidate")))


def primary_type(text: Column) -> Column:
    """The last capitalised name in a type's text, which references, containers and lifetimes surround; null if none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_'])([A-Z][A-Za-z0-9_]*)"), 1), F.lit(-1))


def receiver_owners(keys: DataFrame, symbols: DataFrame) -> DataFrame:
    """(KEY, path): of targets with a receiver, ``self.field.method`` or ``parameter.field.method``, the owner of the method
    and its name. The receiver's type is the owner of the calling method, or the parameter's in its signature; fields lead
    on by the types of properties that have one."""
    parts = F.filter(F.transform(F.split("target", r"\."), lambda p: F.trim(p)), lambda p: p != "")
    rows = keys.where(F.col("target").contains(".")).withColumn("parts", parts).where("size(parts) > 1")
    signed = symbols.select(F.col("qualified_name").alias("from_symbol"), "signature").where("signature is not null")
    rows = rows.join(signed, "from_symbol", "left")
    given = F.expr(r"regexp_extract(signature, concat('(?:^|[(,\\s])(?:mut\\s+)?\\Q', parts[0], '\\E\\s*:\\s*(.*?)(?=,\\s*(?:mut\\s+)?\\w+\\s*:|$)'), 1)")
    start = F.when(F.col("parts")[0] == "self", F.when(F.col("owner") != "", F.col("owner"))).otherwise(F.when(F.col("signature").isNotNull(), primary_type(given)))
    rows = rows.select(*KEY, "parts", start.alias("at")).where("at is not null")
    typed = symbols.where("kind = 'property'").select(F.expr("substr(qualified_name, length(file_path) + 3)").alias("field"), primary_type(F.col("signature")).alias("type")).where("type is not null")
    typed = typed.groupBy("field").agg(F.count_distinct("type").alias("n"), F.min("type").alias("type")).where("n = 1").drop("n")
    longest = rows.agg(F.max(F.size("parts"))).first()[0] or 0
    for k in range(1, longest - 1):  # as many joins as the longest chain has fields
        going = F.size("parts") > k + 1
        stepped = rows.withColumn("field", F.when(going, F.concat("at", F.lit("::"), F.col("parts")[k]))).join(typed, "field", "left")
        rows = stepped.select(*KEY, "parts", F.when(going, F.col("type")).otherwise(F.col("at")).alias("at")).where("at is not null")
    return rows.select(*KEY, F.concat("at", F.lit("::"), F.element_at("parts", -1)).alias("path"))


def method_suffixes(symbols: DataFrame) -> DataFrame:
    """(path, id): methods by what follows the file in their names, where only one has it."""
    rows = symbols.where("kind = 'method'").select(F.expr("substr(qualified_name, length(file_path) + 3)").alias("path"), "id")
    return rows.groupBy("path").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
