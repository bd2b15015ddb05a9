"""Results depend on exactly these lists, patterns and numbers."""

# ---- scanning ---------------------------------------------------------------------------------
LANGUAGE_BY_SUFFIX = {
    ".py": "python",
    ".js": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".mts": "typescript",
    ".cts": "typescript",
    ".tsx": "tsx",
}
DECLARATION_ENDINGS = (".d.ts", ".d.mts", ".d.cts")
BUNDLE_ENDINGS = (".min.js", ".bundle.js")
SKIPPED_DIRS = (
    ".git", "dist", "build", "vendor", ".venv", "venv", "__pycache__", "coverage", ".next",
    ".cache", "bower_components", ".tox", "site-packages", "generated", "__generated__",
)
SKIPPED_DIRS_OUTSIDE_GIT = (*SKIPPED_DIRS, "node_modules")
MAX_FILE_BYTES = 1_000_000
MINIFIED_HEAD_BYTES = 4096
MINIFIED_MIN_HEAD = 2000
MINIFIED_LINE_BYTES = 1000

# ---- splitting --------------------------------------------------------------------------------
MAX_CHARS = 2500
INDEX_MIN_CHARS = 60
SIGNATURE_CHARS = 300

# ---- words and anchors (Java and RE2 spelling; \p{Nd} is what \d means for Unicode text) ----------
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+"
CASE_PARTS = r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\p{Nd}+"
QUOTED = "\"[^\"\\n]{3,}\"|'[^'\\n]{3,}'|`[^`\\n]{3,}`"
WORD_IN_QUERY = r"[A-Za-z_][A-Za-z0-9_]*"
DOTTED = (r"(?<![\p{L}\p{N}_])[A-Za-z_][\p{L}\p{N}_]*(?:\.[A-Za-z_][\p{L}\p{N}_]*)+"
          r"(?![\p{L}\p{N}_])")
STOP_WORDS = (
    "the", "a", "an", "of", "to", "in", "is", "and", "or", "for", "it", "this", "that", "where",
    "what", "how", "does", "do", "which", "when", "from", "by", "on", "are", "be", "with", "as",
    "at", "its",
)
WHITESPACE = r"[\p{Z}\x09-\x0d\x1c-\x1f\x85]"  # what str.strip(), str.isspace() and \s cover

# ---- test files and test questions ---------------------------------------------------------------
TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs", "e2e", "__mocks__", "__fixtures__", "testdata")
TEST_FILE = r"(\.|_)(test|spec)\.[a-z]+$|^test_[^/]*\.py$|_test\.py$|^conftest\.py$"
TEST_INTENT = (r"(?<![\p{L}\p{N}_])(tests?|specs?|testing|fixtures?|mocks?|stubs?|assert[\p{L}\p{N}_]*|e2e|pytest|jest"
               r"|mocha|vitest)(?![\p{L}\p{N}_])")
SCOPE_MODES = ("auto", "include", "exclude")

# ---- ranking ------------------------------------------------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
LITERAL_BONUS = 2.0
RRF_K = 60
LANE_DEPTH = 100
POOL = 50
BETA = 0.7
GAMMA = 0.25
TOP_K = 10
MIN_SPAN = 1e-9
UNIT_TOLERANCE = 1e-3
ZERO_NORM = 1e-6
CLIP_NORM = 1e-12
GRID_BETAS = (0.5, 0.7, 1.0)
GRID_GAMMAS = (0.0, 0.25, 0.5)
GRID_POOLS = (10, 20, 50)
ABSENT_RANK_REPO = 99
ABSENT_RANK_BENCHMARK = 10**6
BENCHMARK_DEPTH = 200

# ---- presentation ---------------------------------------------------------------------------------
CARD_LINES = 14
LOG_LINES = 8
MODULE_LABEL = "(module level)"
CARD_LANGUAGE_BY_SUFFIX = {**LANGUAGE_BY_SUFFIX, ".jsx": "jsx"}
GITHUB_LINK = r"^(?:https?://)?(?:www\.)?github\.com/([\w.-]+)/([\w.-]+?)(?:\.git)?/?(?:[#?].*)?$"
