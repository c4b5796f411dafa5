"""Word lists, lookup tables, limits and formats.

Everything in this file is data the results depend on. It is stated plainly so
that a reader can check it; no logic lives here.
"""

from __future__ import annotations

# ---------------------------------------------------------------- file policy
# A file under any folder with one of these names is never read.
HARD_EXCLUDED_SEGMENTS = [
    ".git", "node_modules", "dist", "build", "vendor", ".venv", "__pycache__",
]

# Default include and exclude globs and limits of a scan.
DEFAULT_INCLUDE_GLOBS = ["**/*"]
DEFAULT_EXCLUDE_GLOBS = [
    ".git/**", "node_modules/**", "dist/**", "build/**",
    ".venv/**", "__pycache__/**", "vendor/**", "tests/fixtures/**",
]
DEFAULT_MAX_FILE_BYTES = 1_000_000
DEFAULT_MAX_FILES = 25_000

# Sub-paths the Python scanner leaves out of its report.
DEFAULT_REPORT_EXCLUDES = [
    ".git", "node_modules", "dist", ".venv", "__pycache__", "tests/fixtures",
]

# File suffix to language.
LANGUAGE_BY_SUFFIX = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript",
    ".jsx": "JavaScript", ".java": "Java", ".go": "Go", ".rs": "Rust", ".cs": "C#",
}

# File names with a meaning.
LOCKFILE_NAMES = [
    "uv.lock", "poetry.lock", "Pipfile.lock", "requirements.txt", "package-lock.json",
    "pnpm-lock.yaml", "yarn.lock", "Cargo.lock", "go.sum",
]
ENTRY_POINT_NAMES = [
    "main.py", "app.py", "server.py", "index.js", "server.js", "main.ts", "manage.py",
]
NPM_MANIFEST = "package.json"
PIP_MANIFEST = "requirements.txt"
PYPROJECT_MANIFEST = "pyproject.toml"
MAVEN_MANIFEST = "pom.xml"
ECOSYSTEM_BY_MANIFEST = {
    NPM_MANIFEST: "npm", PIP_MANIFEST: "pip", PYPROJECT_MANIFEST: "python", MAVEN_MANIFEST: "maven",
}

# Dependency name to framework; the second list may also be found as a word in Python manifests.
FRAMEWORK_BY_DEPENDENCY = {
    "express": "Express", "nestjs": "NestJS", "next": "Next.js", "react": "React",
    "fastapi": "FastAPI", "django": "Django", "flask": "Flask", "spring-boot": "Spring Boot",
}
PYTHON_FRAMEWORK_WORDS = ["fastapi", "django", "flask"]

# Top-level folder to (purpose, confidence), and the default.
FOLDER_PURPOSES = {
    "src": ("Core application source", 0.95),
    "api": ("API handlers and endpoints", 0.85),
    "routes": ("Route/controller definitions", 0.85),
    "services": ("Service/business logic layer", 0.85),
    "models": ("Domain and data models", 0.85),
    "tests": ("Test suites", 0.9),
    ".": ("Repository root and entry assets", 0.6),
}
DEFAULT_FOLDER_PURPOSE = ("General project assets", 0.5)

# Layout hint labels.
HINT_CONTAINER = "containerized-runtime"
HINT_LAYERED = "layered-service-structure"
HINT_ROUTES = "route-controller-pattern"

# ------------------------------------------------------------ evidence labels
# Formats and labels that enter content-addressed ids and keyword search.
ENTRY_SUMMARY_PREFIX = "Entrypoint candidate: "
MANIFEST_SUMMARY_PREFIX = "Dependency manifest detected: "
SEMGREP_DEFAULT_SUMMARY = "Semgrep finding"
BANDIT_DEFAULT_SUMMARY = "Bandit finding"
VULNERABLE_INFIX = " vulnerable to "
ENTRY_CONFIDENCE = 0.75
MANIFEST_CONFIDENCE = 0.7
SEMGREP_CONFIDENCE = 0.9
BANDIT_CONFIDENCE = 0.85
OSV_CONFIDENCE = 0.9
UNKNOWN = "unknown"

# Allowed labels, in rank order where a rank exists.
SEVERITIES = ["Critical", "High", "Medium", "Low"]
DEPENDENCY_SEVERITIES = ["Critical", "High", "Medium", "Low", "Unknown"]
PRIORITIES = ["P0", "P1", "P2"]
CATEGORIES = ["architecture", "security", "performance"]
STATUSES = ["confirmed", "suspected", "not_applicable", "insufficient_evidence", "failed"]
ACTIONABLE_STATUSES = ["confirmed", "suspected"]
HIDDEN_STATUSES = ["not_applicable", "insufficient_evidence"]
SOURCE_TYPES = ["github_url", "local_path"]
STAGES = ["scanner", "architecture", "security", "performance", "roadmap"]
FLOW_NODES = ["start", "scanner", "architecture", "security", "performance", "roadmap"]
TERMINAL_STATES = ["completed", "failed"]

# Scanner exit codes.
SUCCESS_EXIT_CODES = [0, 1]
UNAVAILABLE_EXIT_CODES = {"osv-scanner": [128]}

# Spellings of severities and statuses seen in model output.
SEVERITY_SPELLINGS = {
    "low": "Low", "medium": "Medium", "high": "High", "critical": "Critical", "unknown": "Medium",
    "n/a": "Medium", "na": "Medium", "none": "Medium", "info": "Low", "informational": "Low",
}
STATUS_SPELLINGS = {
    "confirmed": "confirmed", "suspected": "suspected", "not_applicable": "not_applicable",
    "n/a": "not_applicable", "na": "not_applicable",
    "insufficient_evidence": "insufficient_evidence", "insufficient": "insufficient_evidence",
    "unknown": "suspected", "failed": "failed",
}
DEPENDENCY_SEVERITY_SPELLINGS = {
    "low": "Low", "medium": "Medium", "high": "High", "critical": "Critical",
}
PROVIDER_SPELLINGS = {
    "openai": "openai", "lmstudio": "lm_studio", "lm-studio": "lm_studio", "lm_studio": "lm_studio",
}

# Ignore files inside a tree, weakest first.
IGNORE_FILES = [".gitignore", ".ignore", ".rgignore"]

# Lines and entries that count as direct dependencies of a manifest.
LINE_BREAK_PATTERN = "\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"
COMMENT_MARK = "#"
PYPROJECT_ENTRY_PATTERN = r'(?md)^\s*"[A-Za-z0-9_.\-]+'
MAVEN_ENTRY = "<dependency>"

# What follows a tool's name when it gave no result.
TOOL_NOT_FOUND = " not found"
TOOL_TIMED_OUT = " timed out"
TOOL_FAILED = " failed"
TOOL_NO_CONTEXT = " reported unavailable scan context"
TOOL_NOT_JSON = " produced non-JSON output"

# Evidence selection of the branches.
SECURITY_SOURCES = ["semgrep", "bandit", "osv"]
SECURITY_SIGNALS = ["secret", "vuln", "auth", "route"]
ARCHITECTURE_SIGNALS = ["entrypoint", "route", "config"]
PERFORMANCE_SIGNAL = "perf_hotspot"
PERFORMANCE_WORDS = ["n+1", "synchronous", "sync", "pagination", "cache", "payload", "latency"]

# Limits of the compacted context and of the token budgets.
DEFAULT_EVIDENCE_TOTAL = 300
DEFAULT_EVIDENCE_PER_SOURCE = {"bandit": 120, "semgrep": 120, "osv": 120, "scanner_heuristic": 80}
DEFAULT_DEPENDENCY_FINDINGS = 60
MINIMAL_DEPENDENCY_FINDINGS = 20
DEFAULT_TOKEN_BUDGETS = {
    "scanner": 8000, "architecture": 6000, "security": 6000, "performance": 6000, "roadmap": 6000,
}
TOKEN_PATTERN = "[A-Za-z0-9_]+"
TOOL_DETAILS_LIMIT = 500
MINIMAL_MODE = "minimal"
MINIMAL_NOTE = "Context reduced to fit branch token budget."

# Redaction patterns in the order they apply; True keeps the label in group 1.
REDACTED = "[REDACTED]"
REDACTION_PATTERNS = [
    ("secret_key", r"\bsk-[A-Za-z0-9:_-]{16,}\b", False),
    ("trace_public_key", r"\bpk-lf-[A-Za-z0-9:_-]{8,}\b", False),
    ("trace_secret_key", r"\bsk-lf-[A-Za-z0-9:_-]{8,}\b", False),
    ("bearer", r"(?i)\b(authorization\s*:\s*bearer\s+)[A-Za-z0-9._:-]+\b", True),
    ("api_key", r"(?i)\b(api[-_ ]?key\s*[=:]\s*)[\"']?[A-Za-z0-9._:-]{8,}[\"']?", True),
    ("token", r"(?i)\b(token\s*[=:]\s*)[\"']?[A-Za-z0-9._:-]{8,}[\"']?", True),
]
#: Parts in lower case, one of which is in every match of the patterns above.
REDACTION_ANCHORS = ["sk-", "pk-lf-", "bearer", "key", "token"]

# Hosting URL, group 2 is the repository name.
HOSTING_URL_PATTERN = r"github\.com[:/]([^/]+)/([^/.]+)"

# Timelines and status names of reports.
TIMELINE_BY_PRIORITY = {
    "P0": "immediate_1_2_days", "P1": "short_term_1_2_weeks", "P2": "medium_term_1_2_months",
}
ROADMAP_EFFORT = "Medium"
TOOLING_STATUS = {"completed": "completed", "unavailable": "tooling_unavailable"}
TOOLING_STATUS_DEFAULT = "tool_execution_failed"
FAILED_FINDING_LABEL = "analysis_finding_failed"

# Headings of the Markdown report, in order.
REPORT_HEADINGS = [
    "# Repository Analysis Report",
    "## Analysis Stage Status",
    "## Scanner Tooling Status",
    "## Repository Overview",
    "## Architecture Summary",
    "## Key Components / Modules",
    "## Security Risks",
    "## Performance & Scalability Risks",
    "## Roadmap / Improvement Plan",
    "## Summary Table (Top 10 issues)",
]
SUMMARY_TABLE_HEADER = "| # | Category | Severity | Issue | Status |"
SUMMARY_TABLE_RULE = "|---|---|---|---|---|"
NO_FINDINGS_LINE = "- No findings."
NO_ROADMAP_LINE = "- No roadmap items generated."
NO_TOOLING_LINE = "- No scanner tool executions recorded."
NO_MODULES_LINE = "- No module boundaries detected."

# Checks as (check id, severity, keywords).
SECURITY_CHECKS = [
    ("hardcoded-secrets", "High", ["secret", "token", "api key", "apikey", "credential"]),
    ("unsafe-config-practices", "Medium", ["debug", "insecure", "cors", "allow all", "unsafe config"]),
    ("missing-input-validation", "High", ["input validation", "unsanitized", "tainted", "user input"]),
    ("sql-injection-patterns", "High", ["sql injection", "raw sql", "execute(", "query concatenation"]),
    ("insecure-jwt-usage", "High", ["jwt", "none algorithm", "weak signing", "token verify"]),
    ("weak-password-storage", "High", ["plaintext password", "md5", "sha1", "weak hash", "password storage"]),
    ("exposed-admin-endpoints", "High", ["admin", "management endpoint", "internal endpoint", "/admin"]),
    ("dependency-vulnerabilities", "Medium", ["vulnerable", "dependency", "osv", "cve", "ghsa"]),
]
PERFORMANCE_CHECKS = [
    ("heavy-sync-operations", "Medium", ["synchronous", "sync", "blocking", "await-less"]),
    ("n-plus-one-query-patterns", "High", ["n+1", "multiple query", "query per item", "loop query"]),
    ("missing-caching-opportunities", "Medium", ["cache", "no cache", "recompute", "repeat query"]),
    ("large-payload-risks", "Medium", ["payload", "large response", "serialize", "memory growth"]),
    ("db-indexing-hints", "Medium", ["index", "full scan", "table scan", "order by"]),
    ("loop-and-io-hotspots", "Medium", ["loop", "file io", "read file", "write file", "iterative"]),
    ("missing-pagination-in-apis", "High", ["pagination", "list endpoint", "all records", "offset", "limit"]),
]
