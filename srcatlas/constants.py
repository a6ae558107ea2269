"""Fixed values that must equal the behaviour being reproduced.

Everything in this module is data, not logic: lists of names, extensions,
labels and defaults stated plainly, in natural order. Operators read them as
parameters, so a caller can pass other lists.
"""

from __future__ import annotations

from importlib import resources

# --- fixed values: ingest file policy -------------------------------------

# Directory names that exclude a file when any part of its relative path
# equals one of them (the file name itself counts as a part).
INGEST_SKIP_DIRS = [
    ".git", ".svn", ".hg", ".bzr", "__pycache__", ".pytest_cache", ".tox",
    ".coverage", "node_modules", ".npm", ".yarn", ".venv", "venv", "env",
    ".env", "dist", "build", "target", "out", ".idea", ".vscode", ".vs",
    ".eclipse", ".cache", ".tmp", "tmp", "temp", "logs", "log", ".docker",
    "docker", ".terraform", ".vagrant", "vendor", "packages",
]

# Binary file extensions (lower case, without the dot).
INGEST_BINARY_EXT = [
    "png", "jpg", "jpeg", "gif", "bmp", "tiff", "ico", "webp", "pdf", "doc",
    "docx", "xls", "xlsx", "ppt", "pptx", "zip", "tar", "gz", "rar", "7z",
    "bz2", "xz", "exe", "dll", "so", "dylib", "msi", "deb", "rpm", "mp3",
    "mp4", "avi", "mov", "wav", "flac", "ogg", "bin", "dat", "db", "sqlite",
    "sqlite3", "woff", "woff2", "ttf", "otf", "eot", "pyc", "pyo", "pyd",
    "class", "jar", "o", "obj", "lib", "a", "out", "iso", "dmg", "img", "vdi",
    "vmdk",
]

# File names skipped at ingest, as written (mixed case).
INGEST_SKIP_NAMES = [
    ".gitignore", ".gitattributes", ".gitmodules", ".dockerignore",
    "Dockerfile", ".env", ".env.local", ".env.production",
    "package-lock.json", "yarn.lock", "poetry.lock", "Pipfile.lock",
    "requirements.txt", ".DS_Store", "Thumbs.db", "desktop.ini", "LICENSE",
    "COPYING", "COPYRIGHT", "CHANGELOG", "HISTORY", "NEWS",
]

# Suffixes that keep a dotfile.
DOTFILE_ALLOWED_EXT = ["py", "js", "ts", "java", "cpp", "c", "h"]

INGEST_MAX_BYTES = 100 * 1024 * 1024
SNIFF_BYTES = 1024
MIN_PRINTABLE_SHARE = 0.7
MIN_CONTENT_CHARS = 10

# --- fixed values: digest file policy --------------------------------------

DIGEST_BINARY_EXT = [
    "png", "jpg", "jpeg", "gif", "bmp", "tiff", "ico", "pdf", "doc", "docx",
    "xls", "xlsx", "ppt", "pptx", "zip", "tar", "gz", "rar", "7z", "exe",
    "dll", "so", "dylib", "mp3", "mp4", "avi", "mov", "wav", "bin", "dat",
    "db", "sqlite",
]
DIGEST_SKIP_DIRS = [
    ".git", "__pycache__", "node_modules", ".venv", "venv", ".pytest_cache",
    ".tox", "dist", "build", ".idea", ".vscode", ".vs", "target", "bin", "obj",
]
DIGEST_MAX_BYTES = 50 * 1024 * 1024

# --- fixed values: lenient loader policy -----------------------------------

LENIENT_BINARY_EXT = [
    "png", "jpg", "gif", "bmp", "tiff", "pdf", "doc", "docx", "xls", "xlsx",
    "ppt", "pptx", "zip", "tar", "gz", "rar", "7z", "exe", "dll", "so",
    "dylib", "mp3", "mp4", "avi", "mov", "wav", "bin", "dat", "db", "sqlite",
]
LENIENT_MAX_BYTES = 10 * 1024 * 1024

# --- fixed values: size classes ---------------------------------------------

SIZE_SMALL_MAX = 1024 * 1024          # < 1 MB  -> small
SIZE_MEDIUM_MAX = 50 * 1024 * 1024    # < 50 MB -> medium
SIZE_LARGE_MAX = 500 * 1024 * 1024    # < 500 MB -> large, else xlarge
BYTES_PER_ESTIMATED_CHUNK = 2000

# --- fixed values: chunking --------------------------------------------------

CHUNK_SIZE = 2000
CHUNK_OVERLAP = 200
RECURSIVE_SEPARATORS = ["\n\n", "\n", " ", ""]

# --- fixed values: chunk categories ------------------------------------------

CODE_EXT = ["py", "js", "ts", "java", "cpp", "c", "go", "rs", "php", "rb"]
CONFIG_EXT = ["toml", "yaml", "yml", "json", "ini", "cfg", "conf"]
DOCS_EXT = ["md", "rst", "txt", "adoc"]
REQUIREMENT_FILES = ["requirements.txt", "setup.py", "pyproject.toml", "package.json"]

# Samples kept per category, in category order.
SAMPLE_LIMITS = {"code": 15, "config": 5, "docs": 8, "requirements": 3, "tests": 5, "other": 2}
CATEGORY_ORDER = ["code", "config", "docs", "tests", "requirements", "other"]
REPORT_SAMPLES = 3
REPORT_SAMPLE_CHARS = 400

# --- fixed values: code facts -------------------------------------------------

# Extension -> language.
LANGUAGES = {
    "py": "Python", "js": "JavaScript", "ts": "TypeScript", "java": "Java",
    "cpp": "C++", "c": "C", "go": "Go", "rs": "Rust", "php": "PHP",
    "rb": "Ruby", "cs": "C#",
}

# Lower-case substring -> framework label.
FRAMEWORKS = {
    "django": "Django", "flask": "Flask", "fastapi": "FastAPI",
    "react": "React", "vue": "Vue.js", "angular": "Angular",
    "spring": "Spring", "express": "Express.js", "langchain": "LangChain",
    "ollama": "Ollama", "tensorflow": "TensorFlow", "pytorch": "PyTorch",
    "pandas": "Pandas", "numpy": "NumPy", "sklearn": "Scikit-learn",
}

WEB_FRAMEWORKS = ["Django", "Flask", "FastAPI"]
FRONTEND_FRAMEWORKS = ["React", "Vue.js", "Angular"]
ML_FRAMEWORKS = ["TensorFlow", "PyTorch"]

# Architecture labels, in decision order.
ARCH_WEB = "Web API/Service"
ARCH_FRONTEND = "Frontend Application"
ARCH_AI = "AI/LLM Application"
ARCH_ML = "Machine Learning"
ARCH_CLI = "Command Line Tool"
ARCH_OO = "Object-Oriented Library"
ARCH_APP = "Application/Script"
ARCH_LIB = "Library/Package"
OO_CLASS_THRESHOLD = 10

# Regular expressions for code facts (Python semantics of the originals; the
# character classes are written out so Java and RE2 agree on them).
WORD = r"[\p{L}\p{N}_]"
FUNCTION_RE = r"def\s+(" + WORD + r"+)\s*\([^)]*\):"
CLASS_RE = r"class\s+(" + WORD + r"+).*?:"
IMPORT_RE = r"(?:from\s+(\S+)\s+)?import\s+([^\n]+)"
ROUTE_RE = r"""@app\.route\(["']([^"']+)["']"""
ROUTER_RE = r"""@router\.(get|post|put|delete)\(["']([^"']+)["']"""
APP_METHOD_RE = r"""app\.(get|post|put|delete)\(["']([^"']+)["']"""

# Report caps.
REPORT_MAX_DEPENDENCIES = 10
REPORT_MAX_CLASSES = 10
REPORT_MAX_FUNCTIONS = 15

# --- fixed values: review and placeholders -----------------------------------

DEFAULT_SCORE = 70
TARGET_SCORE = 85
MAX_ROUNDS = 3
SCORE_PATTERNS = [r"SCORE:\s*(\d+)", r"Score:\s*(\d+)", r"score:\s*(\d+)", r"(\d+)/100", r"(\d+)%"]

PLACEHOLDER_RE = r"\{\{.*?\}\}"
PLACEHOLDER_PHRASES = [
    "{{", "}}", "Describe the", "Explain the", "List the", "repository-url",
    "project-directory", "Programming language and version", "Framework used",
    "Database system",
]
# Phrase -> issue line of the placeholder report, in report order.
PLACEHOLDER_ISSUES = [
    ("{{", "Template placeholder syntax found"),
    ("Describe the", "Template instruction text found"),
    ("Explain the", "Template instruction text found"),
    ("repository-url", "Generic URL placeholder found"),
    ("Programming language and version", "Generic language placeholder found"),
]
PLACEHOLDER_REPORT_LIMIT = 5
PLACEHOLDER_REPORT_HEADER = "PLACEHOLDER ISSUES DETECTED:"
PLACEHOLDER_REPORT_OK = "NO PLACEHOLDER ISSUES DETECTED - Documentation appears to use actual project content"

# Placeholder -> context field used to fill it.
PLACEHOLDER_FILLS = [
    ("{{Project Name}}", "repo_name"),
    ("{{Programming language and version}}", "languages"),
    ("{{Framework used}}", "frameworks"),
    ("{{repository-url}}", "repo_source"),
    ("{{project-directory}}", "project_dir"),
]

PREAMBLE_PREFIXES = ["Here", "I'll", "Based on"]

# --- fixed values: vectors and keywords ----------------------------------------

EMBEDDING_DIM = 768
KEYWORDS_TOP_N = 10
PREVIEW_CHARS = 500
RECENT_REPOS = 5
CHUNK_DISTRIBUTION_TOP = 10


def default_stop_words() -> list[str]:
    """English stop words shipped with the package (Spark ML's default list)."""
    text = resources.files("srcatlas.data").joinpath("stopwords_en.txt").read_text("utf-8")
    return [w for w in text.splitlines() if w]

# --- context and report ------------------------------------------------------------
#: Lists that a context declares and nothing fills.
UNFILLED_CONTEXT = ["dependencies", "main_modules", "entry_points", "database_models"]
#: First lines of the analysis report; ``{slot}`` is filled in.
REPORT_HEAD = [
    "REPOSITORY INFORMATION:",
    "- Name: {repo_name}",
    "- Source: {repo_source}",
    "- Architecture Type: {architecture_type}",
    "- Total Files Analyzed: {total_documents}",
    "- Total Code Chunks: {total_chunks}",
    "",
    "TECHNOLOGY STACK:",
    "- Languages: {languages}",
    "- Frameworks: {frameworks}",
    "- Key Dependencies: {dependencies}",
    "",
    "CODE STRUCTURE ANALYSIS:",
    "- Key Classes: {key_classes}",
    "- Key Functions: {key_functions}",
    "- API Endpoints: {api_endpoints} found",
    "- Configuration Files: {config_files} found",
    "",
]
