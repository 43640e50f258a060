"""Sources in all languages, one file for each part, and what extraction is to find in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import extract
from .languages import EXTENSIONS

#: For each language a text, in which {k} is the part's number, and the rows to find: symbols (name below the file, kind,
#: visibility, line), edges (target, kind, source below the file, line) and imports (source, kind, alias, line).
SOURCES: dict[str, tuple[str, tuple[tuple, ...]]] = {
    "python": (
        'from a.b import c{k} as d{k}\nfrom ..up import *\nimport os\nclass Greeter{k}(Base{k}):\n    def hi{k}(self):\n        return d{k}(1)\n    def _own(self):\n        pass\ndef top{k}(x):\n    return x.run{k}()\n',
        (
            ('symbol', 'Greeter{k}', 'class', 'public', 4),
            ('symbol', 'Greeter{k}::hi{k}', 'method', 'public', 5),
            ('symbol', 'Greeter{k}::_own', 'method', 'private', 7),
            ('symbol', 'top{k}', 'function', 'public', 9),
            ('edge', 'Base{k}', 'inherit', 'Greeter{k}', 4),
            ('edge', 'd{k}', 'call', 'Greeter{k}::hi{k}', 6),
            ('edge', 'run{k}', 'call', 'top{k}', 10),
            ('import', 'a::b::c{k}', 'alias', 'd{k}', 1),
            ('import', '::::up', 'glob', '', 2),
            ('import', 'os', 'named', '', 3),
        ),
    ),
    "rust": (
        'use crate::a::{b{k}, c as d{k}};\nuse std::fmt::*;\npub struct User{k} {\n    pub name: Box<Repo{k}>,\n}\npub enum Kind{k} {\n    First,\n    Second(u32),\n}\nimpl User{k} {\n    pub fn hi(&self) {\n        b{k}::run(1);\n    }\n}\nfn main{k}() {\n    println!("x");\n}\nconst LIMIT: u32 = 1;\n',
        (
            ('symbol', 'User{k}', 'struct', 'public', 3),
            ('symbol', 'User{k}::name', 'property', 'public', 4),
            ('symbol', 'Kind{k}', 'enum', 'public', 6),
            ('symbol', 'Kind{k}::First', 'enum_variant', 'public', 7),
            ('symbol', 'Kind{k}::Second', 'enum_variant', 'public', 8),
            ('symbol', 'User{k}::hi', 'method', 'public', 11),
            ('symbol', 'main{k}', 'function', 'private', 15),
            ('symbol', 'LIMIT', 'constant', 'private', 18),
            ('edge', 'b{k}::run', 'call', 'User{k}::hi', 12),
            ('edge', 'println!', 'call', 'main{k}', 16),
            ('import', 'crate::a::b{k}', 'named', '', 1),
            ('import', 'crate::a::c', 'alias', 'd{k}', 1),
            ('import', 'std::fmt', 'glob', '', 2),
        ),
    ),
    "typescript": (
        "import { a{k} as b{k} } from './x';\nexport * from './barrel{k}';\nexport class Service{k} extends Base{k} implements Repo{k} {\n  private count: number = 0;\n  run{k}(x: number) {\n    const re = /[/*]/;\n    return `v ${b{k}(x)} it's`;\n  }\n  after(y: string) {\n    return new Thing{k}();\n  }\n}\nexport function go{k}(x: string) {\n  return x;\n}\nexport interface Repo{k} {\n}\nexport type Id{k} = string;\n",
        (
            ('symbol', 'Service{k}', 'class', 'public', 3),
            ('symbol', 'Service{k}::count', 'property', 'private', 4),
            ('symbol', 'Service{k}::run{k}', 'method', 'private', 5),
            ('symbol', 'Service{k}::after', 'method', 'private', 9),
            ('symbol', 'go{k}', 'function', 'public', 13),
            ('symbol', 'Repo{k}', 'interface', 'public', 16),
            ('symbol', 'Id{k}', 'type_alias', 'public', 18),
            ('edge', 'Base{k}', 'inherit', 'Service{k}', 3),
            ('edge', 'Repo{k}', 'implement', 'Service{k}', 3),
            ('edge', 'Thing{k}', 'type_use', 'Service{k}::after', 10),
            ('edge', 'b{k}', 'call', 'Service{k}::run{k}', 7),
            ('import', './x::a{k}', 'alias', 'b{k}', 1),
            ('import', './barrel{k}', 'reexport_glob', '', 2),
        ),
    ),
    "javascript": (
        "import { a{k} } from './x';\nexport class Service{k} {\n  run(x) {\n    return a{k}(x);\n  }\n}\nfunction go{k}() {\n  return helper{k}(2);\n}\n",
        (
            ('symbol', 'Service{k}', 'class', 'public', 2),
            ('symbol', 'Service{k}::run', 'method', 'private', 3),
            ('symbol', 'go{k}', 'function', 'private', 7),
            ('edge', 'a{k}', 'call', 'Service{k}::run', 4),
            ('edge', 'helper{k}', 'call', 'go{k}', 8),
            ('import', './x::a{k}', 'named', '', 1),
        ),
    ),
    "java": (
        'import a.B{k};\nimport static a.C.help{k};\nimport a.d.*;\npublic class Service{k} extends Base{k} implements Repo{k} {\n  private void run{k}(int x) {\n    help{k}(x);\n    new Thing{k}();\n  }\n}\ninterface Repo{k} {\n}\n',
        (
            ('symbol', 'Service{k}', 'class', 'public', 4),
            ('symbol', 'Service{k}::run{k}', 'method', 'private', 5),
            ('symbol', 'Repo{k}', 'interface', 'private', 10),
            ('edge', 'Base{k}', 'inherit', 'Service{k}', 4),
            ('edge', 'Repo{k}', 'implement', 'Service{k}', 4),
            ('edge', 'Thing{k}', 'type_use', 'Service{k}::run{k}', 7),
            ('edge', 'help{k}', 'call', 'Service{k}::run{k}', 6),
            ('import', 'a.B{k}', 'named', '', 1),
            ('import', 'a.C::help{k}', 'named', '', 2),
            ('import', 'a.d', 'glob', '', 3),
        ),
    ),
    "csharp": (
        'using System;\nusing A{k} = B.C{k};\npublic class Service{k} : IRepo{k} {\n  public void Run{k}(int x) {\n    Help{k}(x);\n    var t = new Thing{k}();\n  }\n}\npublic interface IRepo{k} {\n}\n',
        (
            ('symbol', 'Service{k}', 'class', 'public', 3),
            ('symbol', 'Service{k}::Run{k}', 'method', 'public', 4),
            ('symbol', 'IRepo{k}', 'interface', 'public', 9),
            ('edge', 'IRepo{k}', 'implement', 'Service{k}', 3),
            ('edge', 'Thing{k}', 'type_use', 'Service{k}::Run{k}', 6),
            ('edge', 'Help{k}', 'call', 'Service{k}::Run{k}', 5),
            ('import', 'System', 'glob', '', 1),
            ('import', 'B.C{k}', 'alias', 'A{k}', 2),
        ),
    ),
    "kotlin": (
        'import a.b{k}\nimport a.c as d{k}\nimport a.*\nclass Service{k} : Repo{k} {\n  fun run{k}(x: Int) {\n    help{k}(x)\n    Thing{k}()\n  }\n}\ninterface Repo{k} {\n}\nprivate fun top{k}() {\n}\n',
        (
            ('symbol', 'Service{k}', 'class', 'public', 4),
            ('symbol', 'Service{k}::run{k}', 'method', 'public', 5),
            ('symbol', 'Repo{k}', 'interface', 'public', 10),
            ('symbol', 'top{k}', 'function', 'private', 12),
            ('edge', 'Repo{k}', 'implement', 'Service{k}', 4),
            ('edge', 'help{k}', 'call', 'Service{k}::run{k}', 6),
            ('edge', 'Thing{k}', 'type_use', 'Service{k}::run{k}', 7),
            ('import', 'a.b{k}', 'named', '', 1),
            ('import', 'a.c', 'alias', 'd{k}', 2),
            ('import', 'a', 'glob', '', 3),
        ),
    ),
    "php": (
        '<?php\nuse A\\B{k};\nuse A\\C as D{k};\nclass Service{k} extends Base{k} implements Repo{k} {\n  private function run{k}($x) {\n    help{k}($x);\n    $y = new Thing{k}();\n  }\n}\nfunction top{k}() {\n}\n',
        (
            ('symbol', 'Service{k}', 'class', 'public', 4),
            ('symbol', 'Service{k}::run{k}', 'method', 'private', 5),
            ('symbol', 'top{k}', 'function', 'public', 10),
            ('edge', 'Base{k}', 'inherit', 'Service{k}', 4),
            ('edge', 'Repo{k}', 'implement', 'Service{k}', 4),
            ('edge', 'Thing{k}', 'type_use', 'Service{k}::run{k}', 7),
            ('edge', 'help{k}', 'call', 'Service{k}::run{k}', 6),
            ('import', 'A\\B{k}', 'named', '', 2),
            ('import', 'A\\C', 'alias', 'D{k}', 3),
        ),
    ),
    "ruby": (
        "require 'json{k}'\nrequire_relative 'lib/x{k}'\nclass Service{k} < Base{k}\n  include Mixin{k}\n  def run{k}(x)\n    help{k}(x)\n    Thing{k}.new\n  end\nend\nmodule Tools{k}\nend\n",
        (
            ('symbol', 'Service{k}', 'class', 'public', 3),
            ('symbol', 'Service{k}::run{k}', 'method', 'public', 5),
            ('symbol', 'Tools{k}', 'module', 'public', 10),
            ('edge', 'Base{k}', 'inherit', 'Service{k}', 3),
            ('edge', 'Thing{k}', 'type_use', 'Service{k}::run{k}', 7),
            ('edge', 'Mixin{k}', 'implement', 'Service{k}', 4),
            ('edge', 'help{k}', 'call', 'Service{k}::run{k}', 6),
            ('import', 'json{k}', 'glob', '', 1),
            ('import', 'lib/x{k}', 'glob', '', 2),
        ),
    ),
    "swift": (
        'import Foundation\nstruct Store{k}: Repo{k} {\n  func run{k}(x: Int) {\n    help{k}(x)\n    Thing{k}()\n  }\n}\nprotocol Repo{k} {\n}\nprivate func top{k}() {\n}\n',
        (
            ('symbol', 'Store{k}', 'struct', 'public', 2),
            ('symbol', 'Store{k}::run{k}', 'method', 'public', 3),
            ('symbol', 'Repo{k}', 'interface', 'public', 8),
            ('symbol', 'top{k}', 'function', 'private', 10),
            ('edge', 'Repo{k}', 'inherit', 'Store{k}', 2),
            ('edge', 'help{k}', 'call', 'Store{k}::run{k}', 4),
            ('edge', 'Thing{k}', 'type_use', 'Store{k}::run{k}', 5),
            ('import', 'Foundation', 'glob', '', 1),
        ),
    ),
    "objc": (
        '#import <Foundation/Foundation.h>\n#import "A{k}.h"\n@interface Calc{k} : NSObject\n@end\n@protocol Repo{k}\n@end\nint main{k}(int a) {\n  NSLog(a);\n  return 0;\n}\n',
        (
            ('symbol', 'Calc{k}', 'class', 'public', 3),
            ('symbol', 'Repo{k}', 'interface', 'public', 5),
            ('symbol', 'main{k}', 'function', 'public', 7),
            ('edge', 'NSObject', 'inherit', 'Calc{k}', 3),
            ('edge', 'NSLog', 'call', 'main{k}', 8),
            ('import', 'Foundation/Foundation.h', 'named', '', 1),
            ('import', 'A{k}.h', 'named', '', 2),
        ),
    ),
    "go": (
        'package main\nimport (\n\tf{k} "fmt"\n\t. "strings"\n\t"os"\n)\ntype Store{k} struct {\n}\nfunc (s *Store{k}) Run{k}(x string) string {\n\treturn ToUpper(x)\n}\nfunc helper{k}() {\n\thelp.Go{k}()\n}\n',
        (
            ('symbol', 'Store{k}', 'struct', 'public', 7),
            ('symbol', 'Store{k}::Run{k}', 'method', 'public', 9),
            ('symbol', 'helper{k}', 'function', 'private', 12),
            ('edge', 'ToUpper', 'call', 'Store{k}::Run{k}', 10),
            ('edge', 'help.Go{k}', 'call', 'helper{k}', 13),
            ('import', 'fmt', 'alias', 'f{k}', 3),
            ('import', 'strings', 'glob', '', 4),
            ('import', 'os', 'named', '', 5),
        ),
    ),
    "c": (
        '#include <stdio.h>\n#include "a{k}.h"\nstruct node{k} {\n  int v;\n};\nenum color{k} {\n  RED{k},\n  BLUE{k} = 2\n};\nstatic int helper{k}(int a) {\n  return a;\n}\nint run{k}(void) {\n  return helper{k}(1);\n}\n',
        (
            ('symbol', 'node{k}', 'struct', 'public', 3),
            ('symbol', 'color{k}', 'enum', 'public', 6),
            ('symbol', 'color{k}::RED{k}', 'enum_variant', 'public', 7),
            ('symbol', 'color{k}::BLUE{k}', 'enum_variant', 'public', 8),
            ('symbol', 'helper{k}', 'function', 'private', 10),
            ('symbol', 'run{k}', 'function', 'public', 13),
            ('edge', 'helper{k}', 'call', 'run{k}', 14),
            ('import', 'stdio.h', 'named', '', 1),
            ('import', 'a{k}.h', 'named', '', 2),
        ),
    ),
    "cpp": (
        '#include "b{k}.h"\nnamespace n{k} {\nclass Service{k} : public Base{k} {\n public:\n  int run{k}(int x) {\n    return help{k}(x);\n  }\n};\n}\nint top{k}(int x) {\n  return x;\n}\n',
        (
            ('symbol', 'n{k}', 'module', 'public', 2),
            ('symbol', 'Service{k}', 'class', 'public', 3),
            ('symbol', 'Service{k}::run{k}', 'method', 'public', 5),
            ('symbol', 'top{k}', 'function', 'public', 10),
            ('edge', 'Base{k}', 'inherit', 'Service{k}', 3),
            ('edge', 'help{k}', 'call', 'Service{k}::run{k}', 6),
            ('import', 'b{k}.h', 'named', '', 1),
        ),
    ),
}


def files(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """(path, language, text) of the files."""
    k = F.col("p_partkey").cast("string")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select(F.concat(F.lit("src/f"), k, F.lit(f".{EXTENSIONS[language]}")).alias("path"), F.lit(language).alias("language"), F.replace(F.lit(SOURCES[language][0]), F.lit("{k}"), k).alias("text"))


def extraction_query(language: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parsed = extract.extract(files(spark, sf_dir, language))
        below = lambda name: F.expr(f"substr({name}, length(path) + 3)")
        row = lambda what, *cols: F.struct(F.lit(what).alias("what"), *(c.alias(n) for n, c in zip(("a", "b", "c", "line"), cols, strict=True)))
        s = parsed.select("path", F.explode("symbols").alias("s")).select("path", "s.*").select("path", row("symbol", below("qualified_name"), F.col("kind"), F.col("visibility"), F.col("line")).alias("r"))
        d = parsed.select("path", F.explode("dependencies").alias("d")).select("path", "d.*").select("path", row("edge", F.col("to_symbol"), F.col("kind"), below("from_symbol"), F.col("line")).alias("r"))
        i = parsed.select("path", F.explode("imports").alias("i")).select("path", "i.*").select("path", row("import", F.col("source"), F.col("kind"), F.coalesce("alias", F.lit("")), F.col("line")).alias("r"))
        return s.unionByName(d).unionByName(i).select("path", "r.*")

    return run


def extraction_sql(language: str) -> str:
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(quote, row)) + ")" for row in SOURCES[language][1])
    fill = lambda c: f"replace({c}, '{{k}}', p_partkey::VARCHAR) AS {c}"
    return f"SELECT 'src/f' || p_partkey || '.{EXTENSIONS[language]}' AS path, what, {fill('a')}, b, {fill('c')}, line FROM part, (VALUES {values}) v(what, a, b, c, line)"
