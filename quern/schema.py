"""Table layouts and default settings."""

from __future__ import annotations

#: BM25, rank fusion and result sizes.
K1, B = 1.5, 0.75
RRF_K, W_VECTOR, W_KEYWORD, W_GRAPH = 60, 1.0, 1.0, 0.5
SEARCH_LIMIT, USAGE_LIMIT, DEFINITION_LIMIT, KEYWORD_LIMIT, USAGE_CAP = 5, 50, 20, 10, 50
#: Oversized blocks.
BLOCK_CHARS, OVERLAP = 2048, 0.15
#: Workspace scan.
FILE_BYTES, SNIFF_BYTES = 1_000_000, 8192
DIMENSIONS = 384

FILES = "repo string, file string, size long, mtime double, language string, content binary"
STATE = "repo string, file string, sha256 string, size long, mtime double"
BLOCKS = "repo string, file string, language string, block_type string, name string, class_chain string, start_line int, end_line int, code string, docstring string, block_pos int"
CALLS = "repo string, file string, language string, callee string, callee_norm string, line int, preview string, pos int"
CHUNKS = (
    "id string, document string, repo string, file string, type string, class_chain string, name string, language string, "
    "start_line int, end_line int, content_hash string, docstring string"
)

# Directories that a scan never enters.
IGNORED_DIRS = frozenset({
    ".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", ".tox", ".nox", "dist", "build", "target", "bin", "obj", "vendor",
    "out", ".gradle", ".next", ".nuxt", ".turbo", ".output", "coverage", ".chroma", ".idea", ".vscode",
})

# Language names and their file extensions.
EXTENSIONS = {
    "python": (".py",), "typescript": (".ts", ".mts", ".cts"), "tsx": (".tsx",), "javascript": (".js", ".jsx", ".mjs", ".cjs"), "go": (".go",),
    "rust": (".rs",), "c_sharp": (".cs",), "java": (".java",), "c": (".c", ".h"), "cpp": (".cpp", ".hpp", ".cc", ".cxx", ".hh", ".hxx"),
    "kotlin": (".kt", ".kts"), "swift": (".swift",),
}
LANGUAGE_OF = {e: name for name, es in EXTENSIONS.items() for e in es}
