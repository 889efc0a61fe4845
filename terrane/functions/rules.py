"""Word lists, limits and lookup tables the results depend on."""

# Directories never scanned for source.
SKIP_DIRS = [
    ".venv", "venv", "env", "node_modules", "__pycache__", ".git", ".pytest_cache",
    "build", "dist", "eggs", ".eggs", "site-packages", ".tox", ".coverage", "htmlcov",
    ".mypy_cache", ".ruff_cache", ".pytest", "migrations", ".vscode", ".idea", ".DS_Store",
    "__snapshots__", ".next", ".nuxt", ".svelte-kit", ".turbo", ".parcel-cache",
]
DOT_NAMES_KEPT = [".github", ".gitignore"]

# Directories and file suffixes dropped from archives.
ARCHIVE_SKIP_DIRS = [
    ".venv", "venv", "env", "__pycache__", "node_modules", ".git", "uploaded_workspaces",
    ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "dist", "build",
]
ARCHIVE_SKIP_SUFFIXES = [".pyc", ".pyo", ".pyd", ".so", ".dll"]
ROOT_IGNORED = ["workspace_manifest.json", "graph_store", "__MACOSX"]

# Source suffixes and languages.
SOURCE_SUFFIXES = [".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"]
JS_SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
LANGUAGE_BY_SUFFIX = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".json": "json", ".md": "markdown", ".css": "css", ".html": "html",
    ".yml": "yaml", ".yaml": "yaml",
}

# Extensions tried when a reference names no file exactly.
REF_KNOWN_EXTENSIONS = [".py", ".ts", ".tsx", ".js", ".jsx", ".json", ".html", ".css", ".md"]
REF_PATH_EXTENSIONS = ["", ".py", ".ts", ".tsx", ".js", ".jsx", ".json", ".html", ".css"]
REF_NAME_EXTENSIONS = ["", ".py", ".ts", ".tsx", ".js", ".jsx"]

# Identifiers that are not symbols.
SYNTAX_DUMP_MARKERS = ["Call(", "BoolOp(", "Subscript(", "Attribute(", "Load(", "Store(", "<ast."]
NOISE_SEGMENTS = [
    ".venv", "venv", "env", "node_modules", "site-packages", "__pycache__", ".git", ".tox",
    ".mypy_cache", ".ruff_cache", ".pytest_cache", ".next", ".nuxt", ".svelte-kit", "dist", "build",
]
STRING_METHODS = [
    "strip", "lstrip", "rstrip", "replace", "lower", "upper", "startswith", "endswith", "split", "join", "format",
]

# JavaScript words that look like calls or methods.
JS_NOT_CALLS = ["if", "for", "while", "switch", "catch", "function", "return", "import", "require"]
JS_NOT_METHODS = ["constructor", "if", "for", "while", "switch", "catch"]

# JavaScript and TypeScript patterns.
JS_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
JS_IMPORT = r"""(?m)^\s*(?:import|export)\s+(?:[^;]*?)\s+from\s+['"]([^'"]+)['"]"""
JS_REQUIRE = r"""require\(\s*['"]([^'"]+)['"]\s*\)"""
JS_DYNAMIC = r"""import\(\s*['"]([^'"]+)['"]\s*\)"""
JS_CLASS = rf"^\s*(?:export\s+)?(?:default\s+)?class\s+({JS_NAME})(?:\s+extends\s+({JS_NAME}))?\b"
JS_FUNCTION = rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+({JS_NAME})\b"
JS_ARROW = rf"^\s*(?:export\s+)?(?:const|let|var)\s+({JS_NAME})\s*=\s*(?:async\s+)?(?:\([^)]*\)|{JS_NAME})\s*=>"
JS_METHOD = rf"(?m)^\s+({JS_NAME})\s*\([^)]*\)\s*\{{"
JS_CALL = rf"({JS_NAME})\s*\("

# Graph build and risk bands.
BUILDER_VERSION = 2
RISK_HIGH = {"coupling": 30, "complexity": 25}
RISK_MEDIUM = {"coupling": 12, "complexity": 10}
EDGE_TYPES_BY_LEVEL = {
    1: ["imports"],
    2: ["imports", "contains", "inherits"],
    3: ["imports", "contains", "inherits", "calls"],
}
# Edge kept when several kinds join one ordered pair, strongest first.
EDGE_PRECEDENCE = ["contains", "inherits", "imports", "calls"]

# Framework rules in order (manifest, needle, framework, project type, language or None).
FRAMEWORK_RULES = [
    ("package.json", "next", "Next.js", "frontend", None),
    ("package.json", "react", "React", "frontend", None),
    ("package.json", "react-dom", "React", "frontend", None),
    ("package.json", "vue", "Vue", "frontend", None),
    ("package.json", "@angular/core", "Angular", "frontend", None),
    ("package.json", "svelte", "Svelte", "frontend", None),
    ("package.json", "astro", "Astro", "frontend", None),
    ("package.json", "nuxt", "Nuxt", "frontend", None),
    ("package.json", "@nestjs/core", "NestJS", "backend", None),
    ("package.json", "express", "Express", "backend", None),
    ("package.json", "fastify", "Fastify", "backend", None),
    ("package.json", "koa", "Koa", "backend", None),
    ("requirements.txt", "fastapi", "FastAPI", "backend", "python"),
    ("requirements.txt", "django", "Django", "backend", "python"),
    ("requirements.txt", "flask", "Flask", "backend", "python"),
    ("pyproject.toml", "fastapi", "FastAPI", "backend", "python"),
    ("pyproject.toml", "django", "Django", "backend", "python"),
    ("pyproject.toml", "flask", "Flask", "backend", "python"),
    ("manage.py", None, "Django", "backend", "python"),
    ("angular.json", None, "Angular", "frontend", None),
    ("next.config.js", None, "Next.js", "frontend", None),
    ("next.config.mjs", None, "Next.js", "frontend", None),
    ("vite.config.js", None, "Vite", "frontend", None),
    ("vite.config.ts", None, "Vite", "frontend", None),
]

# Chunking, retrieval and prompt budgets.
CHUNK_TOKENS, CHUNK_OVERLAP = 512, 64
MERGE_MIN_TOKENS, MERGE_MAX_TOKENS = 100, 512
VECTOR_DIM = 384
TOKEN_BUDGETS = {
    "explain": {"file": 60_000, "chunks": 8_000, "graph": 2_000},
    "refactor": {"file": 100_000, "chunks": 8_000, "graph": 2_000},
    "teach": {"file": 20_000, "chunks": 6_000, "graph": 2_000},
    "evaluate": {"file": 0, "chunks": 4_000, "graph": 0},
}
TRUNCATION_MARK = "\n\n# ... truncated to fit context budget ..."
COMPLEXITY_WORDS = ["if", "for", "while", "catch", "switch", "case"]
COMPLEXITY_MARKS = ["&&", "||", "?"]

# Learner model.
TOPICS = ["auth", "api", "database", "ui", "validation", "error", "test", "cache"]
LEVELS = ["beginner", "intermediate", "advanced"]
ADVANCED_ABOVE, INTERMEDIATE_ABOVE = 50, 20
UNDERSTOOD_FROM, CONFUSED_TO = 0.75, 0.35
SESSION_HOURS = 2
