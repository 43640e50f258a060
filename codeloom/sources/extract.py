"""Extraction: source text to symbols, raw dependencies and imports. Python by its own grammar, other languages by a
lexer that knows their keywords, braces, strings and comments."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import CodeGraph, symbol_id

SYMBOL = "struct<name: string, qualified_name: string, kind: string, line: int, col: int, visibility: string, signature: string>"
EDGE = "struct<from_symbol: string, to_symbol: string, line: int, kind: string>"
IMPORT = "struct<source: string, alias: string, line: int, kind: string>"
PARSED = f"path string, language string, symbols array<{SYMBOL}>, dependencies array<{EDGE}>, imports array<{IMPORT}>, error_count int"


@dataclass
class Parsed:
    path: str
    symbols: list[dict] = field(default_factory=list)
    dependencies: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    error_count: int = 0

    def symbol(self, name: str, kind: str, line: int, col: int, visibility: str, parent: str | None = None, signature: str | None = None) -> str:
        qualified = "::".join(x for x in (self.path, parent, name) if x)
        self.symbols.append({"name": name, "qualified_name": qualified, "kind": kind, "line": line, "col": col, "visibility": visibility, "signature": signature})
        return qualified

    def edge(self, source: str | None, target: str, line: int, kind: str) -> None:
        if source and target:
            self.dependencies.append({"from_symbol": source, "to_symbol": target, "line": line, "kind": kind})

    def imported(self, source: str, line: int, kind: str = "named", alias: str | None = None) -> None:
        self.imports.append({"source": source, "alias": alias, "line": line, "kind": kind})


def _recovered(text: str) -> tuple[ast.Module, int]:
    """(the tree, errors). A line that the grammar rejects is blanked, or becomes ``pass`` where a block would be empty, and
    the rest parsed again: a file with errors keeps what is sound in it."""
    lines, errors = text.replace("\0", " ").split("\n"), 0
    while True:
        try:
            return ast.parse("\n".join(lines)), errors
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            errors += 1
            at = min(max((getattr(e, "lineno", None) or 1) - 1, 0), len(lines) - 1)
            if "expected an indented block" in str(e):
                opener = next((k for k in range(at - 1, -1, -1) if lines[k].rstrip().endswith(":")), at)
                lines[opener] += " pass"
                continue
            while at > 0 and not lines[at].strip():
                at -= 1
            if not lines[at].strip() or errors > len(lines):
                return ast.Module([], []), errors
            lines[at] = ""


def parse_python(path: str, text: str) -> Parsed:
    out = Parsed(path)
    tree, out.error_count = _recovered(text)

    def name_of(node: ast.expr) -> str:
        return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else ""

    def visit(node: ast.AST, parent: str | None, source: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                returns = f" -> {ast.unparse(child.returns)}" if child.returns else ""
                hidden = "private" if child.name.startswith("_") else "public"
                at = out.symbol(child.name, "method" if parent else "function", child.lineno, child.col_offset + 1, hidden, parent, f"{child.name}({ast.unparse(child.args)}){returns}")
                visit(child, parent, at)
            elif isinstance(child, ast.ClassDef):
                at = out.symbol(child.name, "class", child.lineno, child.col_offset + 1, "public", parent)
                for base in child.bases:
                    out.edge(at, name_of(base), child.lineno, "inherit")
                visit(child, child.name if not parent else f"{parent}::{child.name}", at)
            elif isinstance(child, ast.Import):
                for a in child.names:
                    out.imported(a.name.replace(".", "::"), child.lineno, "alias" if a.asname else "named", a.asname)
            elif isinstance(child, ast.ImportFrom):
                module = "::" * child.level + (child.module or "").replace(".", "::")
                for a in child.names:
                    if a.name == "*":
                        out.imported(module, child.lineno, "glob")
                    else:
                        out.imported(f"{module}::{a.name}", child.lineno, "alias" if a.asname else "named", a.asname)
            else:
                if isinstance(child, ast.Call):
                    out.edge(source, name_of(child.func), child.lineno, "call")
                visit(child, parent, source)

    visit(tree, None, None)
    return out


#: A regular expression of a script: a slash where a value may begin.
SCRIPT_REGEX = r"(?:(?<=[(,=:\[!&|?{};\n])|(?<=[(,=:\[!&|?{};] )|(?<=return ))/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/"


def _spaces(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def _template(text: str) -> str:
    """A template literal with what stands in its ``${}`` kept."""
    out, at = "", 0
    while (start := text.find("${", at)) >= 0:
        depth, end = 1, start + 2
        while end < len(text) and depth:
            depth += (text[end] == "{") - (text[end] == "}")
            end += 1
        out += _spaces(text[at : start + 2]) + text[start + 2 : end - 1] + " "
        at = end
    return out + _spaces(text[at:])


def blank(text: str, hash_comments: bool, quotes: str) -> tuple[str, int]:
    """The text with strings, comments and, where there are templates, regular expressions blanked out, line breaks kept,
    and how many brackets have no partner."""
    comment = r"#[^\n]*" if hash_comments else r"//[^\n]*|/\*.*?(?:\*/|\Z)"
    string = "|".join(rf"{q}(?:\\.|[^{q}\\{'' if q == '`' else chr(10)}])*{q}" for q in quotes)
    script = "`" in quotes and "\"'`" == quotes

    def keep(m: re.Match) -> str:
        first = m[0][0]
        if first in "#/":
            return _spaces(m[0])
        return _template(m[0]) if first == "`" and script else first + _spaces(m[0][1:-1]) + m[0][-1]

    plain = re.sub("|".join([comment, *([SCRIPT_REGEX] if script else []), string]), keep, text, flags=re.S)
    return plain, sum(abs(plain.count(a) - plain.count(b)) for a, b in ("{}", "()", "[]"))


@dataclass(frozen=True)
class Language:
    """Declarations as (pattern with the groups name and, if any, owner and bases, kind), in order of precedence."""

    declarations: tuple[tuple[str, str], ...]
    imports: tuple[tuple[str, str], ...] = ()
    containers: tuple[str, ...] = ("class", "struct", "interface", "trait", "enum", "module")
    public: str = r"\bpublic\b"
    protected: str = r"\bprotected\b"
    default: str = "private"
    hash_comments: bool = False
    ends: bool = False  # blocks end with a keyword
    quotes: str = "\"'"
    new: str = r"\bnew\s+([A-Za-z_]\w*)"
    capital_calls: bool = False  # a call of a capitalised name makes an object
    mixins: str = ""


_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|async|readonly|const|virtual|export|default|declare|data|partial|extern|inline|suspend|lateinit|companion|fileprivate|mutating|required|convenience)\s+)*"
_FN = r"(?P<name>[A-Za-z_]\w*)\s*(?:<[^>\n]*>)?\s*\((?P<args>[^;{{}}]*?)\)"
_C_FN = r"^(?P<head>[A-Za-z_][\w\s\*&:<>,]*?[\s\*&])(?P<owner>\w+::)?(?P<name>~?[A-Za-z_]\w*)\s*\((?P<args>[^;{}]*)\)\s*(?:const\s*|noexcept\s*|override\s*)*(?=\{)"
_BASES = r"(?:\s*<[^>{\n]*>)?(?P<bases>[^{;\n]*)"

LANGUAGES: dict[str, Language] = {
    "rust": Language(
        ((r"\bfn\s+(?P<name>\w+)\s*(?:<[^>]*>)?\((?P<args>[^)]*)\)", "function"), (r"\bstruct\s+(?P<name>\w+)", "struct"), (r"\benum\s+(?P<name>\w+)", "enum"), (r"\btrait\s+(?P<name>\w+)", "trait"), (r"\btype\s+(?P<name>\w+)", "type_alias"),
         (r"\bmod\s+(?P<name>\w+)", "module"), (r"\bmacro_rules!\s*(?P<name>\w+)", "macro"), (r"\bconst\s+(?P<name>\w+)\s*:", "constant"), (r"\bstatic\s+(?:mut\s+)?(?P<name>\w+)\s*:", "variable"), (r"\bimpl(?:\s*<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(?P<name>\w+)", "impl"),
         (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?P<name>[a-z_]\w*)\s*:\s*(?P<args>[^\n;={}]+?),?\s*$", "property"), (r"^\s*(?P<name>[A-Z]\w*)\s*(?:\([^)\n]*\)|\{[^}\n]*\})?\s*(?:=\s*[^,\n]+)?,?\s*$", "enum_variant")),
        ((r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", "use"),), ("struct", "trait", "enum", "impl"), r"\bpub\b(?!\s*\()", r"\bpub\s*\(", quotes='"', new=""),
    "go": Language(
        ((r"^func\s*\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*(?P<name>\w+)\s*\((?P<args>[^)]*)\)", "method"), (r"^func\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\((?P<args>[^)]*)\)", "function"), (r"^type\s+(?P<name>\w+)\s+struct", "struct"), (r"^type\s+(?P<name>\w+)\s+interface", "interface"),
         (r"^type\s+(?P<name>\w+)", "type_alias"), (r"^const\s+(?P<name>\w+)", "constant"), (r"^var\s+(?P<name>\w+)", "variable")),
        ((r'^\s*(?:import\s+)?((?:[\w.]+\s+)?"[^"\n]+")\s*$', "go"),), (), default="upper", quotes="\"`'", new=""),
    "c": Language(
        ((r"^\s*typedef\b[^;{]*?\b(?P<name>\w+)\s*;", "type_alias"), (r"^\s*(?:typedef\s+)?struct\s+(?P<name>\w+)\s*(?=\{)", "struct"), (r"^\s*(?:typedef\s+)?enum\s+(?P<name>\w+)\s*(?=\{)", "enum"), (_C_FN, "function"), (r"^\s*#define\s+(?P<name>\w+)", "constant"), (r"^\s*(?P<name>[A-Za-z_]\w*)\s*(?:=\s*[^,\n]+)?,?\s*$", "enum_variant")),
        ((r'^\s*#\s*include\s*[<"]([^>"]+)[>"]', "named"),), ("enum",), default="static", new=""),
    "cpp": Language(
        ((r"\bnamespace\s+(?P<name>\w+)", "module"), (rf"\bclass\s+(?P<name>\w+){_BASES}(?=\{{)", "class"), (rf"\bstruct\s+(?P<name>\w+){_BASES}(?=\{{)", "struct"), (r"\benum\s+(?:class\s+)?(?P<name>\w+)", "enum"), (r"\busing\s+(?P<name>\w+)\s*=", "type_alias"),
         (_C_FN.replace("^(", r"^\s*("), "function")),
        ((r'^\s*#\s*include\s*[<"]([^>"]+)[>"]', "named"),), ("class", "struct"), default="public"),
    "java": Language(
        ((rf"\bclass\s+(?P<name>\w+){_BASES}", "class"), (rf"\binterface\s+(?P<name>\w+){_BASES}", "interface"), (r"\benum\s+(?P<name>\w+)", "enum"), (rf"\brecord\s+(?P<name>\w+){_BASES}", "class"),
         (r"^\s*(?:[\w<>\[\],.?@]+\s+)*(?P<name>[A-Za-z_]\w*)\s*\((?P<args>[^;{}()]*)\)\s*(?:throws\s+[\w., ]+)?(?=\{)", "function"),
         (r"^\s*(?:[\w<>\[\],.?@]+\s+)+(?P<name>[A-Za-z_]\w*)\s*\((?P<args>[^;{}()]*)\)\s*(?:throws\s+[\w., ]+)?(?=;)", "function"), (r"^\s*(?:\w+\s+)*static\s+final\s+[\w<>\[\]]+\s+(?P<name>\w+)\s*=", "constant"),
         (r"^\s*(?:private|public|protected)\s+(?:static\s+|final\s+)*[\w<>\[\],.]+\s+(?P<name>\w+)\s*[;=]", "property")),
        ((r"^\s*import\s+((?:static\s+)?[\w.*]+)\s*;", "java"),)),
    "csharp": Language(
        ((rf"\bclass\s+(?P<name>\w+){_BASES}", "class"), (rf"\binterface\s+(?P<name>\w+){_BASES}", "interface"), (rf"\bstruct\s+(?P<name>\w+){_BASES}", "struct"), (r"\benum\s+(?P<name>\w+)", "enum"),
         (r"^\s*(?:[\w<>\[\],.?]+\s+)+(?P<name>[A-Za-z_]\w*)\s*(?:<\w+>)?\((?P<args>[^;{}()]*)\)\s*(?=[{;]|=>)", "function"), (r"\bconst\s+\w+\s+(?P<name>\w+)\s*=", "constant"), (r"^\s*(?:public|private|protected|internal)\s+(?:\w+\s+)*[\w<>\[\],.?]+\s+(?P<name>\w+)\s*(?:\{\s*get|;|=)", "property")),
        ((r"^\s*using\s+(?:static\s+)?((?:\w+\s*=\s*)?[\w.]+)\s*;", "csharp"),)),
    "kotlin": Language(
        ((rf"\binterface\s+(?P<name>\w+){_BASES}", "interface"), (r"\benum\s+class\s+(?P<name>\w+)", "enum"), (rf"\b(?:class|object)\s+(?P<name>\w+){_BASES}", "class"), (r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<name>\w+)\s*\((?P<args>[^)]*)\)", "function"),
         (r"\bconst\s+val\s+(?P<name>\w+)", "constant"), (r"^\s*(?:private |public |protected |override |lateinit )*va[lr]\s+(?P<name>\w+)", "property")),
        ((r"^\s*import\s+([\w.*]+(?:\s+as\s+\w+)?)", "kotlin"),), default="public", public=r"\bpublic\b", new="", capital_calls=True),
    "php": Language(
        ((rf"\bclass\s+(?P<name>\w+){_BASES}", "class"), (rf"\binterface\s+(?P<name>\w+){_BASES}", "interface"), (r"\btrait\s+(?P<name>\w+)", "trait"), (r"\benum\s+(?P<name>\w+)", "enum"), (r"\bfunction\s+&?(?P<name>\w+)\s*\((?P<args>[^)]*)\)", "function"),
         (r"\bconst\s+(?P<name>\w+)\s*=", "constant"), (r"^\s*(?:public|private|protected)\s+(?:static\s+|readonly\s+)*(?:\??[\w\\]+\s+)?\$(?P<name>\w+)", "property")),
        ((r"^\s*use\s+([\w\\]+(?:\s+as\s+\w+)?)\s*;", "php"),), default="public", new=r"\bnew\s+\\?([A-Za-z_]\w*)"),
    "ruby": Language(
        ((r"^\s*class\s+(?P<name>\w+)(?P<bases>\s*<\s*[\w:]+)?", "class"), (r"^\s*module\s+(?P<name>\w+)", "module"), (r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!]?)", "function"), (r"^\s*(?P<name>[A-Z][A-Z0-9_]*)\s*=", "constant")),
        ((r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", "glob"),), ("class", "module"), default="public", hash_comments=True, ends=True, new=r"\b([A-Z]\w*)\.new\b", mixins=r"^\s*(?:include|extend|prepend)\s+([A-Z]\w*)"),
    "swift": Language(
        ((rf"\bprotocol\s+(?P<name>\w+){_BASES}", "interface"), (rf"\b(?:class|actor|extension)\s+(?!func\b|var\b)(?P<name>\w+){_BASES}", "class"), (rf"\bstruct\s+(?P<name>\w+){_BASES}", "struct"), (rf"\benum\s+(?P<name>\w+){_BASES}", "enum"), (r"\bfunc\s+(?P<name>\w+)\s*(?:<[^>]*>)?\((?P<args>[^)]*)\)", "function")),
        ((r"^\s*import\s+(\w+)", "glob"),), default="public", quotes='"', new="", capital_calls=True),
    "objc": Language(
        ((r"@protocol\s+(?P<name>\w+)(?P<bases>\s*<[^>]*>)?", "interface"), (r"@(?:interface|implementation)\s+(?P<name>\w+)(?P<bases>\s*:\s*\w+)?", "class"), (r"^\s*[-+]\s*\([^)]*\)\s*(?P<name>\w+)", "method"), (_C_FN, "function")),
        ((r'^\s*#\s*(?:import|include)\s*[<"]([^>"]+)[>"]', "named"),), (), default="public", new=""),
    "typescript": Language(
        ((r"\bclass\s+(?P<name>\w+)" + _BASES, "class"), (r"\binterface\s+(?P<name>\w+)" + _BASES, "interface"), (r"^\s*(?:export\s+)?type\s+(?P<name>\w+)", "type_alias"), (r"\bfunction\s*\*?\s+(?P<name>\w+)\s*(?:<[^>]*>)?\((?P<args>[^)]*)\)", "function"),
         (r"\b(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=\n]+)?=>", "function"), (r"^(?:export\s+)?const\s+(?P<name>\w+)", "constant"), (r"^(?:export\s+)?(?:let|var)\s+(?P<name>\w+)", "variable"),
         (r"^\s+(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b)\w+)\s*(?:<[^>]*>)?\((?P<args>[^;{}()]*)\)\s*(?::[^{;\n]+)?(?=\{)", "function"),
         (r"^\s+(?:(?:public|private|protected|static|readonly)\s+)+(?P<name>\w+)\s*[?!]?\s*[:=;]", "property")),
        ((r"^\s*((?:import|export)\s[^;'\"]*?from\s*['\"][^'\"\n]+['\"])", "script"),), default="exported", quotes="\"'`"),
}
LANGUAGES["javascript"] = LANGUAGES["typescript"]
NOT_CALLS = frozenset("if for while switch catch return function sizeof match loop fn func fun def elsif elif unless until case when do else and or not in is as await yield throw new super defined typeof guard let var val isset unset echo print_r array list foreach using lock fixed nameof".split())


def _use(text: str) -> Iterator[tuple[str, str, str | None]]:
    """The leaves of a Rust use tree: (path, kind, alias)."""
    text = re.sub(r"\s+", " ", text).strip()
    if m := re.match(r"^(.*?)\{(.*)\}$", text):
        depth, part = 0, ""
        for c in m[2] + ",":
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                if part.strip():
                    yield from _use(m[1].strip() + part.strip())
                part = ""
            else:
                part += c
    elif m := re.match(r"^(.*)::\*$", text):
        yield m[1], "glob", None
    elif m := re.match(r"^(.*)::self(?:\s+as\s+(\w+))?$", text):
        yield m[1], "self", m[2]
    elif m := re.match(r"^(.*)\s+as\s+(\w+)$", text):
        yield m[1], "alias", m[2]
    else:
        yield text, "named", None


def _imports(how: str, text: str) -> Iterator[tuple[str, str, str | None]]:
    """(source, kind, alias) of an import statement."""
    text = text.strip()
    if how == "use":
        yield from _use(text)
    elif how == "go":
        alias, _, source = text.rpartition(" ")
        yield source.strip('"'), {"": "named", ".": "glob"}.get(alias.strip(), "alias"), alias.strip() if alias.strip() not in ("", ".") else None
    elif how == "java":
        source = re.sub(r"^static\s+", "", text)
        glob, static = source.endswith(".*"), source != text
        source = source.removesuffix(".*")
        yield ("::".join(source.rsplit(".", 1)) if static and not glob else source), "glob" if glob else "named", None
    elif how == "csharp":
        alias, equals, source = text.rpartition("=")
        yield source.strip(), "alias" if equals else "glob", alias.strip() or None
    elif how in ("kotlin", "php"):
        source, _, alias = re.sub(r"\s+", " ", text).partition(" as ")
        yield source.removesuffix(".*"), "glob" if source.endswith(".*") else "alias" if alias else "named", alias or None
    elif how == "script":
        again = "reexport_" if text.startswith("export") else ""
        names, module = re.match(r"(?s)(?:import|export)\s+(?:type\s+)?(.*?)\s*from\s*['\"]([^'\"]+)['\"]", text).groups()
        listed = re.search(r"(?s)\{(.*?)\}", names)
        for part in (listed[1].split(",") if listed else ()):
            name, _, alias = re.sub(r"\s+", " ", part.strip()).partition(" as ")
            if name:
                yield f"{module}::{name}", again + ("alias" if alias else "named"), alias or None
        rest = re.sub(r"(?s)\{.*?\}", "", names).strip(" ,")
        if m := re.match(r"\*\s*(?:as\s+(\w+))?", rest):
            yield module, again + ("alias" if m[1] else "glob"), m[1]
        elif rest:
            yield f"{module}::default", "alias", rest
    else:
        yield text, how, None


def parse_lexed(path: str, text: str, language: str) -> Parsed:
    spec, out = LANGUAGES[language], Parsed(path)
    plain, out.error_count = blank(text, spec.hash_comments, spec.quotes)
    line_of = lambda at: plain.count("\n", 0, at) + 1
    column_of = lambda at: at - plain.rfind("\n", 0, at)
    for pattern, how in spec.imports:
        for m in re.finditer(pattern, text, re.M):
            if plain[m.start() : m.end()].strip():
                for source, kind, alias in _imports(how, m[1]):
                    out.imported(source, line_of(m.start(1)), kind, alias)
    taken, found = [], []
    for pattern, kind in spec.declarations:
        for m in re.finditer(pattern, plain, re.M):
            at = m.start("name")
            if m["name"] in NOT_CALLS or any(a <= at < b for a, b in taken):
                continue
            if kind == "function" and re.match(r"\s*(return|else|throw|new|await|case)\b", m[0]):
                continue
            taken.append((at, m.end("name")))
            found.append((at, m, kind))
    found.sort(key=lambda x: x[0])
    scopes: list[tuple[int, int, str, str, str]] = []  # start, end, name, kind, qualified name
    calls = re.compile(r"((?:[A-Za-z_]\w*(?:::|\.|->))*[A-Za-z_]\w*!?)\s*\(" if language != "objc" else r"(?:\[\s*[\w\]\[ ]+?\s+(\w+)\s*[\]:])|\b([A-Za-z_]\w*)\s*\(")
    inside = {"enum_variant": "enum"} | ({"property": "struct"} if language == "rust" else {})
    for at, m, kind in found:
        if kind in inside and (not (held := [x for x in scopes if x[0] <= at < x[1]]) or held[-1][3] != inside[kind]):
            continue
        start = m.end()
        end = _block_end(plain, start, spec, m.start("name"), kind)
        outer = [s for s in scopes if s[0] <= at < s[1]]
        owner = next((s for s in reversed(outer) if s[3] in spec.containers), None)
        given = (m.groupdict().get("owner") or "").rstrip(":") or None
        parent = given or (owner[2] if owner else None)
        if language == "objc" and kind == "method":
            before = [f for f in found if f[2] in ("class", "interface") and f[0] < at]
            parent = before[-1][1]["name"] if before else None
        if kind == "impl":
            scopes.append((start, end, m["name"], "impl", ""))
            continue
        kind = "method" if kind == "function" and parent and language != "go" else kind
        statement = plain[max(plain.rfind(c, 0, at) for c in "\n;{}") + 1 : at]
        visibility = "public" if kind == "enum_variant" else _visibility(spec, statement, m["name"])
        args = m.groupdict().get("args")
        qualified = out.symbol(m["name"], kind, line_of(at), column_of(at), visibility, parent, re.sub(r"\s+", " ", args).strip() if args is not None else None)
        for target, how in _supertypes(language, m.groupdict().get("bases") or "", kind):
            out.edge(qualified, target, line_of(at), how)
        if end > start:
            scopes.append((start, end, m["name"], kind, qualified))
    bodies = [s for s in scopes if s[4]]

    def source_of(at: int) -> str | None:
        inside = [s for s in bodies if s[0] <= at < s[1]]
        return inside[-1][4] if inside else None

    made = set()
    for m in re.finditer(spec.new, plain) if spec.new else ():
        made.add(m.start(1))
        out.edge(source_of(m.start()), m[1], line_of(m.start()), "type_use")
    for m in re.finditer(spec.mixins, plain, re.M) if spec.mixins else ():
        out.edge(source_of(m.start(1)), m[1], line_of(m.start(1)), "implement")
    for m in calls.finditer(plain):
        at = m.start(m.lastindex)
        target = m[m.lastindex]
        if target in NOT_CALLS or at in made or any(a <= at + len(target) - 1 < b for a, b in taken):
            continue
        if language not in ("rust", "go", "ruby", "swift"):
            target = re.split(r"::|\.|->", target)[-1]
        if target in NOT_CALLS:
            continue
        out.edge(source_of(at), target, line_of(at), "type_use" if spec.capital_calls and target[:1].isupper() else "call")
    return out


def _block_end(plain: str, start: int, spec: Language, name: int, kind: str) -> int:
    """Where the block that a declaration opens ends; its start if it opens none before its statement ends."""
    if kind in ("constant", "variable", "property", "type_alias", "macro", "enum_variant"):
        return start
    if spec.ends:
        indent = re.match(r"[ \t]*", plain[plain.rfind("\n", 0, name) + 1 :])[0]
        m = re.compile(rf"^{indent}end\b", re.M).search(plain, start)
        return m.start() if m else len(plain)
    stop = re.compile(r"[{;]" if spec.default != "public" or spec.quotes != '"' else r"[{;]|\n\s*\n").search(plain, start - 1 if plain[start - 1 : start] == "{" else start)
    if not stop or stop[0] != "{":
        return start
    depth = 0
    for m in re.compile(r"[{}]").finditer(plain, stop.start()):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(plain)


def _visibility(spec: Language, statement: str, name: str) -> str:
    if spec.default == "upper":
        return "public" if name[:1].isupper() else "private"
    if spec.default == "static":
        return "private" if re.search(r"\bstatic\b", statement) else "public"
    if re.search(r"\b(private|fileprivate)\b", statement):
        return "private"
    if re.search(spec.protected, statement):
        return "protected"
    if re.search(spec.public, statement) or (spec.default == "exported" and re.search(r"\bexport\b", statement)):
        return "public"
    return "private" if spec.default == "exported" else spec.default


def _supertypes(language: str, bases: str, kind: str) -> Iterator[tuple[str, str]]:
    names = lambda x: re.findall(r"[A-Za-z_][\w.\\:]*", re.sub(r"<[^>]*>|\([^)]*\)", "", x))
    last = lambda x: re.split(r"[.\\]|::", x)[-1]
    if language in ("java", "typescript", "javascript", "php"):
        for word, how in (("extends", "inherit"), ("implements", "implement")):
            if m := re.search(rf"\b{word}\b(.*?)(?=\bextends\b|\bimplements\b|$)", bases, re.S):
                for n in names(m[1]):
                    yield last(n), how
    elif language == "cpp":
        for n in names(re.sub(r"\b(public|private|protected|virtual|final)\b", "", bases)):
            yield last(n), "inherit"
    elif language == "csharp":
        for k, n in enumerate(names(bases.partition(":")[2].partition(" where ")[0])):
            like = re.match(r"I[A-Z]", last(n))
            yield last(n), "inherit" if kind == "interface" or (k == 0 and not like) else "implement"
    elif language == "kotlin":
        for n in (x.strip() for x in re.sub(r"^\s*\([^)]*\)", "", bases).partition(":")[2].split(",") if x.strip()):
            if found := names(n):
                yield last(found[0]), "inherit" if kind == "interface" or "(" in n else "implement"
    elif language in ("swift", "ruby", "objc"):
        for n in names(bases):
            yield last(n), "inherit"


def parse(path: str, text: str | None, language: str) -> Parsed:
    if text is None:
        return Parsed(path, error_count=1)
    return parse_python(path, text) if language == "python" else parse_lexed(path, text, language)


def extract(files: DataFrame) -> DataFrame:
    """One row for each file (path, language, text) with what was found in it. Files are dealt to tasks by their path, as
    a few folders may hold the large ones."""

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(PARSED))

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            made = [(r, parse(r["path"], r["text"], r["language"])) for r in rows]
            data = [{"path": r["path"], "language": r["language"], "symbols": p.symbols, "dependencies": p.dependencies, "imports": p.imports, "error_count": p.error_count} for r, p in made]
            yield pa.RecordBatch.from_pylist(data, schema)

    return files.select("path", "language", "text").where("language is not null").repartition("path").mapInArrow(run, PARSED)


def tables(parsed: DataFrame) -> tuple[CodeGraph, DataFrame]:
    """(a graph of symbols, imports and file states, raw dependencies). A file with errors is marked failed, and what was
    found in it is kept; of symbols that share a qualified name the last stays."""
    from ..operators.traverse import latest

    s = parsed.select("path", F.posexplode("symbols").alias("ordinal", "s")).select(F.col("path").alias("file_path"), "ordinal", "s.*")
    symbols = latest(s, "qualified_name", "ordinal").select(symbol_id(F.col("qualified_name")).alias("id"), "name", "qualified_name", "kind", "file_path", "line", "col", "visibility", "signature", F.lit("local").alias("source"))
    raw = parsed.select("path", "language", F.explode("dependencies").alias("d")).select("d.from_symbol", "d.to_symbol", F.col("path").alias("from_file"), F.col("d.line").alias("from_line"), "d.kind", "language")
    imports = parsed.select("path", F.explode("imports").alias("i")).select("i.source", "i.alias", F.col("path").alias("file_path"), "i.line", "i.kind")
    state = parsed.select(
        "path", "hash", "last_modified", F.when(F.col("error_count") > 0, "failed").otherwise("ok").alias("status"),
        F.when(F.col("error_count") > 0, F.concat(F.lit("encountered "), F.col("error_count").cast("string"), F.lit(" parse error nodes"))).alias("error_message"),
    )
    return CodeGraph(symbols, raw.limit(0).drop("language"), imports, state), raw
