"""Schemas and enumerations of the graph tables."""

from __future__ import annotations

SYMBOLS = "id string, name string, qualified_name string, kind string, file_path string, line int, col int, visibility string, signature string, source string"
DEPENDENCIES = "from_symbol string, to_symbol string, from_file string, from_line int, kind string"
IMPORTS = "source string, alias string, file_path string, line int, kind string"
FILE_STATE = "path string, hash string, last_modified long, status string, error_message string"
RAW_DEPENDENCIES = DEPENDENCIES

#: The spellings that tables store.
SYMBOL_KINDS = ("function", "method", "class", "struct", "enum", "enum_variant", "interface", "trait", "type_alias", "module", "constant", "variable", "property", "macro")
TYPE_KINDS = ("class", "struct", "enum", "interface", "trait", "type_alias", "module")
VISIBILITIES = ("public", "private", "protected")
SOURCES = ("local", "external", "builtin")
DEPENDENCY_KINDS = ("call", "inherit", "implement", "type_use", "import")
IMPORT_KINDS = ("named", "glob", "self", "alias", "reexport_named", "reexport_glob", "reexport_alias")
LANGUAGES = ("rust", "typescript", "javascript", "java", "csharp", "kotlin", "php", "ruby", "swift", "objc", "python", "go", "c", "cpp")
EXTENSIONS = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java", "cs": "csharp", "kt": "kotlin", "kts": "kotlin",
    "php": "php", "phtml": "php", "rb": "ruby", "rake": "ruby", "swift": "swift", "m": "objc", "py": "python", "pyi": "python", "go": "go", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp",
}
#: The kind of a node that stands for something outside the project, by the kind of the edge into it.
SYNTHETIC_KINDS = {"call": "function", "inherit": "class", "implement": "interface", "type_use": "type_alias", "import": "module"}
