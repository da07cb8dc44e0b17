"""Small tables of fixed facts: languages, file types, import patterns, names that are no calls, ignored paths, stages."""

from __future__ import annotations

# Suffixes of each language.
SUFFIXES = {
    "python": [".py", ".pyi"],
    "java": [".java"],
    "javascript": [".js", ".jsx", ".mjs"],
    "typescript": [".ts", ".tsx"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hh"],
    "go": [".go"],
    "rust": [".rs"],
}

# Suffixes of each file type; a suffix of a language is code as well.
CODE_SUFFIXES = [".py", ".java", ".js", ".ts", ".go", ".rs", ".cpp", ".c", ".h", ".hpp", ".cs", ".rb", ".php", ".swift", ".kt", ".scala", ".r", ".m", ".mm", ".groovy", ".clj", ".erl", ".ex", ".exs"]
DOC_SUFFIXES = [".md", ".rst", ".txt", ".adoc", ".org"]
CONFIG_SUFFIXES = [".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".properties", ".xml", ".env"]

# Paths that are left out unless others are given.
EXCLUDED_PATHS = ["node_modules/**", ".git/**", "__pycache__/**", "*.min.js", "*.min.css", "dist/**", "build/**", ".idea/**", ".vscode/**", "*.pyc", "*.class", "target/**", "vendor/**"]

# The module named by an import, by language.
IMPORT_PATTERNS = {
    "python": [r"^\s*import\s+([\w.]+)", r"^\s*from\s+([\w.]+)\s+import"],
    "java": [r"^\s*import\s+([\w.]+)"],
    "kotlin": [r"^\s*import\s+([\w.]+)"],
    "javascript": [r"^\s*import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]", r"require\(['\"]([^'\"]+)['\"]\)"],
    "typescript": [r"^\s*import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]", r"require\(['\"]([^'\"]+)['\"]\)"],
    "go": [r"import\s*\(?\s*[\"']([^\"']+)[\"']"],
    "rust": [r"^\s*use\s+([\w:]+)", r"^\s*extern\s+crate\s+(\w+)"],
    "c": [r"#\s*include\s+[\"<]([^\">]+)[\">]"],
    "cpp": [r"#\s*include\s+[\"<]([^\">]+)[\">]"],
}

# Extensions that an import's last part is tried with, in this order.
IMPORT_EXTENSIONS = [".py", ".java", ".js", ".ts", ".go", ".rs", ".c", ".h", ".cpp", ".hpp"]

# Names before a parenthesis that are no calls of interest.
CALL_PATTERN = r"(?<!\w)([a-zA-Z_]\w*)\s*\("
NOT_CALLS = ["if", "while", "for", "switch", "catch", "return", "print", "println", "printf", "len", "range", "enumerate", "map", "filter", "reduce", "sorted", "reversed", "int", "str", "float", "bool", "list", "dict", "set", "tuple", "new", "sizeof", "typeof", "instanceof"]

# Names before a parenthesis that are no calls of interest in the rich calls, by language.
_C_STOPS = ["if", "while", "for", "switch", "catch", "return", "sizeof", "typeof", "offsetof"]
_JS_STOPS = ["if", "while", "for", "switch", "catch", "return", "typeof", "instanceof", "void", "delete", "new", "require", "console"]
RICH_STOPS = {
    "python": ["if", "while", "for", "switch", "catch", "return", "print", "println", "printf", "len", "range", "enumerate", "map", "filter", "reduce", "sorted", "reversed", "int", "str", "float", "bool", "list", "dict", "set", "tuple", "super", "self", "cls"],
    "java": ["if", "while", "for", "switch", "catch", "return", "new", "sizeof", "typeof", "instanceof", "synchronized", "assert"],
    "javascript": _JS_STOPS,
    "typescript": _JS_STOPS,
    "c": _C_STOPS,
    "cpp": ["if", "while", "for", "switch", "catch", "return", "sizeof", "typeof", "decltype", "new", "delete", "static_cast", "dynamic_cast", "const_cast", "reinterpret_cast"],
    "go": ["if", "for", "switch", "return", "panic", "make", "len", "cap", "append", "copy", "delete", "close", "complex", "real", "imag"],
    "rust": ["if", "while", "for", "match", "return", "loop", "Some", "None", "Ok", "Err", "Box", "Vec", "println", "print", "format", "panic", "todo", "unimplemented"],
}

# The stages of a build, in order, and their weights.
STAGES = [("structure_graph_build", 1, 3.0), ("dependency_graph_build", 2, 2.0), ("semantic_analysis", 3, 2.0), ("module_detection", 4, 1.5), ("vector_db_store", 5, 1.5)]

# The collection that holds the vectors of each label.
COLLECTIONS = {"File": "file_summary", "Class": "class_summary", "Method": "method_summary", "Module": "semantic_summary", "Workflow": "semantic_summary"}
CODE_COLLECTIONS = {"Class": "class_code", "Method": "method_code"}
DETAIL_COLLECTION = "semantic_detail"
ALL_COLLECTIONS = sorted({*COLLECTIONS.values(), *CODE_COLLECTIONS.values(), DETAIL_COLLECTION})

# Declarations by language as (kind, symbol type, pattern of a line, group of the name). Kind "scope" only names a parent.
_JS = [
    ("class", "class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", 1),
    ("function", "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(\w+)", 1),
    ("function", "function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::.*)?=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*(?::\s*[\w<>\[\]| ]+)?=>", 1),
    ("member", "method", r"^\s*(?:(?:static|async|get|set|public|private|protected|readonly|override)\s+)*(?!(?:if|for|while|switch|catch|function|return|else|do|try|new)\b)(\w+)\s*(?:<[^>]*>)?\((?:[^;]*\{\s*\}?\s*$|[^;)]*$)", 1),
]
_C = [
    ("class", "struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)\s*\{", 1),
    ("typedef", "struct", r"^\s*typedef\s+struct\s*()\{", 1),
    ("function", "function", r"^\s*(?!(?:else|return|if|for|while|switch|do|typedef|new|delete|throw|namespace|using|public|private|protected)\b)(?:[\w~][\w:<>,~&\*]*[\s\*&]+)+\*?(\w+)\s*\([^;]*$", 1),
]
DECLARATIONS = {
    "python": [("class", "class", r"^\s*class\s+(\w+)", 1), ("function", "function", r"^\s*(?:async\s+)?def\s+(\w+)", 1)],
    "java": [
        ("class", "class", r"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*class\s+(\w+)", 1),
        ("class", "interface", r"^\s*(?:(?:public|private|protected|static|sealed)\s+)*interface\s+(\w+)", 1),
        ("member", "method", r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s*)?(?!(?:public|private|protected|static|final|abstract|new|return|else|throw)\b)[\w.]+(?:<[^()]*>)?(?:\[\])*\s+(?!(?:if|for|while|switch|catch)\b)(\w+)\s*\([^;]*$", 1),
    ],
    "javascript": _JS,
    "typescript": [*_JS, ("class", "interface", r"^\s*(?:export\s+)?(?:default\s+)?interface\s+(\w+)", 1)],
    "c": _C,
    "cpp": [*_C, ("class", "class", r"^\s*(?:template\s*<[^>]*>\s*)?class\s+(\w+)[^;]*$", 1)],
    "go": [
        ("class", "struct", r"^type\s+(\w+)\s+struct\b", 1),
        ("class", "interface", r"^type\s+(\w+)\s+interface\b", 1),
        ("function", "function", r"^func\s+(\w+)\s*[\(\[]", 1),
        ("receiver", "method", r"^func\s*\(\s*\w*\s*\*?(\w+)[^)]*\)\s*(\w+)", 2),
    ],
    "rust": [
        ("class", "struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", 1),
        ("class", "enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)", 1),
        ("class", "trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)", 1),
        ("scope", "impl", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)", 1),
        ("function", "function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe)\s+)*fn\s+(\w+)", 1),
    ],
}

#: Languages in which indentation closes a declaration, not braces.
BY_INDENT = {"python"}


def register_language(name: str, suffixes: list[str], declarations: list[tuple[str, str, str, int]], imports: list[str] | None = None, stops: list[str] | None = None, by_indent: bool = False) -> None:
    """Add a language, or replace one: its suffixes (with or without the dot, in any case), patterns of declarations as in DECLARATIONS and of imports, and names
    that are no calls. A suffix belongs to one language: the last that was registered."""
    own = [s.lower() if s.startswith(".") else f".{s.lower()}" for s in suffixes]
    for language, known in SUFFIXES.items():
        SUFFIXES[language] = [s for s in known if s not in own]
    SUFFIXES[name], DECLARATIONS[name] = own, [*declarations]
    for table, value in ((IMPORT_PATTERNS, imports), (RICH_STOPS, stops)):
        if value is not None:
            table[name] = [*value]
    (BY_INDENT.add if by_indent else BY_INDENT.discard)(name)


def supported_languages() -> list[str]:
    return sorted(DECLARATIONS)


def supported_extensions() -> list[str]:
    return sorted(s for some in SUFFIXES.values() for s in some)


def language_of_extension(extension: str) -> str | None:
    """The language of an extension, with or without the dot, in any case."""
    wanted = f".{extension.lower().removeprefix('.')}"
    return next((language for language, suffixes in SUFFIXES.items() if wanted in suffixes), None)
