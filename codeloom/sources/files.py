"""Source files: discovery, predicates, hashes, snippets."""

from __future__ import annotations

import json
import posixpath
import re
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EXTENSIONS, LANGUAGES

#: Folders left out by default, and what marks a test file.
DEFAULT_EXCLUDE = (
    "target/**", "node_modules/**", ".git/**", ".research/**", ".cache/**", "dist/**", "build/**", "out/**", "coverage/**", "artifacts/**", "tmp/**", ".tmp/**", "temp/**", "venv/**", ".venv/**", "__pycache__/**",
)
TEST_PREFIXES, TEST_FOLDERS = ("tests/", "spec/", "Tests/", "src/test/"), ("/tests/", "/spec/", "/Tests/", "/src/test/")
TEST_SUFFIXES = (
    "_test.rs", ".test.rs", "_test.go", "_tests.go", ".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx", ".test.js", ".spec.js", ".test.jsx", ".spec.jsx", "Test.java", "Tests.java", "Test.cs", "Tests.cs", "Test.kt", "Tests.kt",
    "Test.php", "Tests.php", "_test.rb", "_spec.rb", "Tests.swift", "Tests.m", "_test.py",
)
BEFORE, AFTER = 1, 8


@dataclass(frozen=True)
class Settings:
    include: tuple[str, ...] = ("**/*",)
    exclude: tuple[str, ...] = DEFAULT_EXCLUDE
    include_tests: bool = False
    languages: tuple[str, ...] = LANGUAGES
    extension_map: dict[str, str] = field(default_factory=dict)
    idle_minutes: int = 5

    def __post_init__(self):
        wrong = [x for x in (*self.languages, *self.extension_map.values()) if x not in LANGUAGES]
        if wrong:
            raise ValueError(f"unknown language: {wrong[0]}")
        if self.idle_minutes <= 0:
            raise ValueError("idle_minutes must be greater than 0")

    @classmethod
    def load(cls, text: str) -> Settings:
        """Settings from TOML (its table ``scan``) or from JSON5 (an object, or its member ``scan``)."""
        import tomllib

        found = json5(text) if text.lstrip().startswith(("{", "//", "/*")) else tomllib.loads(text)
        given = found.get("scan", {} if not text.lstrip().startswith(("{", "//", "/*")) else found)
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown setting: {min(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def json5(text: str):
    """JSON with comments, single quotes, bare keys, trailing commas, hexadecimal numbers and plus signs."""
    token = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<mark>[{}\[\]:,])|(?P<word>[^\s{}\[\]:,"'/]+)""", re.S)
    out, at = [], 0
    while at < len(text):
        m = token.match(text, at)
        if not m:
            raise ValueError(f"unexpected character at {at}")
        at = m.end()
        if m["string"]:
            inner = re.sub(r"\\\n", "", m["string"][1:-1])
            inner = re.sub(r"\\'", "'", inner)
            out.append('"' + re.sub(r'(?<!\\)"', '\\\\"', inner) + '"')
        elif m["mark"]:
            if m["mark"] in "}]" and out and out[-1] == ",":
                out.pop()
            out.append(m["mark"])
        elif m["word"]:
            w = m["word"].lstrip("+")
            key = re.match(r"\s*:", text[at:])
            w = str(int(w, 16)) if re.fullmatch(r"-?0[xX][0-9a-fA-F]+", w) else re.sub(r"\.$", ".0", re.sub(r"^(-?)\.", r"\g<1>0.", w)) if re.fullmatch(r"-?[\d.]+", w) else w
            out.append(json.dumps(m["word"]) if key else w)
    return json.loads("".join(out))


def glob_to_regex(glob: str) -> str:
    """``**`` crosses folders, ``*`` and ``?`` don't; braces list alternatives. Anchored at both ends."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}.get(c) or re.escape(c)
            i += 1
    return f"^{out}$"


def matches_any(path: Column, globs) -> Column:
    return path.rlike("|".join(map(glob_to_regex, globs))) if globs else F.lit(False)


def is_test_path(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    out = name.startswith("test_")
    for p in TEST_PREFIXES:
        out |= path.startswith(p)
    for p in TEST_FOLDERS:
        out |= path.contains(p)
    for s in TEST_SUFFIXES:
        out |= name.endswith(s)
    return out


def language_of(path: Column, overrides: dict[str, str] | None = None) -> Column:
    """The language by the extension, whatever its case; overrides come with or without a dot."""
    known = EXTENSIONS | {k.lower().lstrip("."): v for k, v in (overrides or {}).items()}
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def should_scan(path: Column, settings: Settings) -> Column:
    language = language_of(path, settings.extension_map)
    tests = F.lit(True) if settings.include_tests else ~is_test_path(path)
    return matches_any(path, settings.include) & ~matches_any(path, settings.exclude) & tests & F.coalesce(language.isin(*settings.languages), F.lit(False))


def _qualified(spark: SparkSession, root: str) -> str:
    """``root`` as the file system writes it in the paths of its files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def listed(spark: SparkSession, root: str, settings: Settings = Settings()) -> DataFrame:
    """(path, last_modified, language, location) of the files to scan under ``root``, by path. No file is opened."""
    if not root:
        raise ValueError("root must not be empty")
    head = _qualified(spark, root) + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime")
    at = raw.where(F.col("path").startswith(head)).select(F.expr(f"substr(path, {len(head) + 1})").alias("path"), "modificationTime", F.col("path").alias("location"))
    kept = at.where(should_scan(F.col("path"), settings))
    return kept.select("path", F.unix_timestamp("modificationTime").alias("last_modified"), language_of(F.col("path"), settings.extension_map).alias("language"), "location").orderBy("path")


def read(spark: SparkSession, found: DataFrame) -> DataFrame:
    """(path, hash, last_modified, language, text) of ``listed`` files: these are read, and no others. Their places pass
    through the driver, whose file index holds every file's anyway. Bytes that are no UTF-8 become replacement marks."""
    schema = "path string, hash string, last_modified long, language string, text string"
    places = [re.sub(r"([\\\[\]{}*?])", r"\\\1", r.location) for r in found.select("location").toLocalIterator()]
    if not places:
        return spark.createDataFrame([], schema)
    content = spark.read.format("binaryFile").load(places).select(F.col("path").alias("location"), "content")
    rows = found.join(content, "location")
    return rows.select("path", F.sha2("content", 256).alias("hash"), "last_modified", "language", F.decode("content", "UTF-8").alias("text")).orderBy("path")


def discover(spark: SparkSession, root: str, settings: Settings = Settings()) -> DataFrame:
    """(path, hash, last_modified, language, text): the files to scan under ``root``, by path relative to it. What settings
    exclude is listed but never opened."""
    return read(spark, listed(spark, root, settings))


def snippet(text: Column, line: Column) -> Column:
    """Lines line-1 to line+8 of a text, as far as it has them; null where that is empty."""
    lines = F.split(text, "\n")
    first = F.greatest(line - BEFORE, F.lit(1))
    taken = F.array_join(F.slice(lines, first, F.greatest(line + AFTER - first + 1, F.lit(0))), "\n")
    return F.when(taken != "", taken)


def validate_path(root: str, path: str) -> str:
    """``path`` under ``root``, normalised; ValueError if it leads outside."""
    full = posixpath.normpath(posixpath.join(root, path))
    if full != root.rstrip("/") and not full.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"path is outside the project: {path}")
    return full
