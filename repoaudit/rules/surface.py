"""Which files each audit looks at, and how paths are classified. Fixed values."""

from __future__ import annotations

CODE = [".py", ".pyi", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
VCS_AND_CACHE_DIRS = [".git", ".hg", ".svn", ".venv", "venv", "__pycache__", "node_modules", "dist", "build"]

# surface name -> skipped directories, suffixes, always included names, size limit, dot directories pruned
SURFACES = {
    "cleanup": {
        "skip": [
            ".git", ".hg", ".svn", "node_modules", ".venv", "venv", "env", ".mypy_cache", ".pytest_cache",
            ".ruff_cache", ".tox", "dist", "build", "target", "out", "coverage", ".next", ".turbo", ".cache",
            ".idea", ".vscode", "vendor", "__pycache__", "generated", ".repo-harness",
        ],
        "suffixes": CODE + [
            ".md", ".mdx", ".rst", ".txt", ".adoc", ".yaml", ".yml", ".json", ".toml", ".ini", ".cfg",
            ".sh", ".bash", ".zsh",
        ],
        "names": [
            "package.json", "pnpm-workspace.yaml", "yarn.lock", "package-lock.json", "tsconfig.json",
            "pyproject.toml", "requirements.txt", "setup.py", "poetry.lock", "Pipfile", "mkdocs.yml",
            "docusaurus.config.js", "docusaurus.config.ts", "sidebars.js", "sidebars.ts",
        ],
        "prune_dot_dirs": True,
    },
    "structure": {
        "skip": VCS_AND_CACHE_DIRS + [
            ".mypy_cache", ".pytest_cache", ".ruff_cache", ".repo-harness", ".next", ".turbo", ".idea", ".vscode",
        ],
        "suffixes": CODE + [".json", ".yaml", ".yml", ".toml", ".ini", ".md", ".sh"],
        "names": [
            "pyproject.toml", "requirements.txt", "requirements-dev.txt", "package.json", "pnpm-workspace.yaml",
            "setup.py", "setup.cfg", "Pipfile", "poetry.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock",
        ],
    },
    "distributed-side-effects": {
        "skip": [],
        "suffixes": [".py", ".pyi", ".ts", ".tsx", ".js", ".jsx", ".json", ".yaml", ".yml", ".toml", ".ini"],
        "names": [],
        "first_party_only": True,
    },
    "error-governance": {
        "skip": VCS_AND_CACHE_DIRS + [
            ".next", ".nuxt", ".turbo", ".cache", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "coverage",
            ".repo-harness", "vendor", "target", "out", ".idea", ".vscode",
        ],
        "suffixes": CODE + [".json", ".yaml", ".yml", ".toml", ".ini", ".md", ".mdx", ".rst"],
        "names": [],
    },
    "silent-failure": {
        "skip": [
            ".git", ".hg", ".svn", ".idea", ".vscode", ".next", ".repo-harness", "__pycache__", "node_modules",
            "dist", "build", "coverage", "target", "vendor", ".venv", "venv", "site-packages", ".mypy_cache",
            ".pytest_cache", ".ruff_cache",
        ],
        "suffixes": [".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"],
        "names": [],
        "reject_minified": True,
    },
    "contracts": {
        "skip": VCS_AND_CACHE_DIRS + [".mypy_cache", ".pytest_cache", ".ruff_cache", ".repo-harness", ".next", ".turbo"],
        "suffixes": [
            ".py", ".pyi", ".ts", ".tsx", ".js", ".jsx", ".json", ".yaml", ".yml", ".toml", ".md", ".graphql", ".gql",
        ],
        "names": ["CODEOWNERS", "pyproject.toml", "package.json", "tsconfig.json"],
    },
    "durable-agents": {
        "skip": VCS_AND_CACHE_DIRS + [".mypy_cache", ".pytest_cache", ".ruff_cache", ".repo-harness"],
        "suffixes": [".py", ".toml", ".json", ".yaml", ".yml", ".md"],
        "names": ["README.md", "AGENTS.md", "CODEOWNERS", "pyproject.toml"],
    },
    "module-shape": {"skip": [], "suffixes": [".py", ".ts", ".tsx"], "names": [], "first_party_only": True},
    "pythonic-ddd-drift": {"skip": [], "suffixes": [".py"], "names": [], "first_party_only": True},
    "api-surfaces": {
        "skip": VCS_AND_CACHE_DIRS + [
            ".next", ".nuxt", ".turbo", ".cache", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "coverage",
            ".repo-harness", "vendor", "target", "out", ".idea", ".vscode",
        ],
        "suffixes": CODE + [
            ".sh", ".yaml", ".yml", ".json", ".toml", ".ini", ".cfg", ".conf", ".env", ".txt", ".properties", ".lock", ".xml",
            ".md", ".mdx", ".rst",
        ],
        "names": [],
    },
    "text": {
        "skip": VCS_AND_CACHE_DIRS,
        "suffixes": CODE + [
            ".md", ".mdx", ".rst", ".txt", ".adoc", ".yaml", ".yml", ".json", ".jsonc", ".toml", ".ini", ".cfg", ".sh",
            ".bash", ".zsh", ".html", ".css", ".scss", ".vue", ".svelte", ".lock",
        ],
        "names": [
            "CODEOWNERS", "Makefile", "justfile", "Pipfile", ".npmrc", ".flake8", ".bandit", ".gitignore", ".env",
            ".eslintrc", ".prettierrc",
        ],
        "first_party_only": True,
    },
    "doc-links": {
        "skip": [
            ".git", "node_modules", ".venv", "venv", "dist", "build", "target", "coverage", ".next", ".cache",
            ".repo-harness", "vendor", "__pycache__",
        ],
        "suffixes": [".md", ".mdx", ".html", ".htm"],
        "names": [],
        "prune_dot_dirs": True,
    },
}

# trees that tools install next to a repository: counted, never reported on
FOREIGN_RUNTIME_PATH = r"(?:^|/)\.council-runtime/(?:.*/)?site-packages/"

LANGUAGE_BY_SUFFIX = {
    ".py": "Python", ".pyi": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript",
    ".tsx": "TypeScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".md": "Markdown", ".mdx": "Markdown",
    ".rst": "RST", ".adoc": "AsciiDoc", ".yaml": "YAML", ".yml": "YAML", ".json": "JSON", ".toml": "TOML",
    ".ini": "Config", ".cfg": "Config", ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell",
}
APPLICATION_LANGUAGE_BY_SUFFIX = {
    ".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript",
    ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
}
NON_SOURCE_LANGUAGES = ["Markdown", "RST", "AsciiDoc", "YAML", "JSON", "TOML", "Config", "Shell", "SQL"]
DOC_SUFFIXES = [".md", ".mdx", ".rst", ".txt", ".adoc"]

MANIFEST_KIND = {
    "package.json": "node", "pnpm-workspace.yaml": "node", "yarn.lock": "node", "package-lock.json": "node",
    "tsconfig.json": "typescript", "pyproject.toml": "python", "requirements.txt": "python", "setup.py": "python",
    "poetry.lock": "python", "Pipfile": "python", "mkdocs.yml": "docs", "docusaurus.config.js": "docs",
    "docusaurus.config.ts": "docs", "sidebars.js": "docs", "sidebars.ts": "docs", ".github/workflows": "ci",
}
DOC_ROOT_NAMES = ["docs", "documentation", "wiki"]
TOOLS_FOR_JS = ["tsc", "eslint", "knip", "ast-grep"]
TOOLS_FOR_PYTHON = ["ruff", "basedpyright", "tach"]
TOOLS_FOR_DOCS = ["lychee", "vale", "built-in-link-check"]

# root lock or manifest file -> package manager, in report order
PACKAGE_MANAGERS = [
    ("pnpm-lock.yaml", "pnpm"), ("package-lock.json", "npm"), ("yarn.lock", "yarn"), ("poetry.lock", "poetry"),
    ("Pipfile", "pipenv"), ("requirements.txt", "pip"),
]
WORKSPACE_PARENTS = ["packages", "apps", "libs", "services", "modules"]
NON_SOURCE_ROOTS = ["tests", "test", "docs", ".github", "scripts"]

GENERATED_PARTS = ["generated", "vendor", "vendors", "__generated__", ".generated", "gen"]
MIGRATION_PARTS = ["migrations", "alembic", "versions"]
TEST_PATH = (
    r"/(?:tests|test|__tests__|spec)/|/test_[^/]*\z|_test\.py\z|\.(?:test|spec)\.tsx?\z"
)
BOUNDARY_PATH = r"(?i:api|http|transport|serializer|schema|dto|parser|validation|validator|tests?|migrations?)"
CI_CONFIG_PATH = (
    r"^\.github/workflows/[^/]*\.y[^/]*ml\z|^\.circleci/config\.yml\z|^\.gitlab-ci\.yml\z|^azure-pipelines\.yml\z"
)
ENTRYPOINT_NAMES = ["main.py", "app.py", "bootstrap.py", "container.py", "__main__.py"]
CONTEXT_MARKERS = ["contexts", "bounded_contexts"]
FRONTEND_SUFFIXES = [".tsx", ".jsx", ".vue", ".svelte"]

RESPONSIBILITY_IMPORTS = {
    "http": [
        "fastapi", "flask", "starlette", "django.http", "aiohttp", "httpx", "requests", "express", "next/server",
        "hono", "koa",
    ],
    "db": [
        "sqlalchemy", "django.db", "psycopg", "asyncpg", "peewee", "pymongo", "motor", "alembic", "typeorm",
        "prisma", "sequelize", "mongoose", "drizzle", "knex",
    ],
    "schema": ["pydantic", "marshmallow", "dataclasses_json", "zod", "yup", "io-ts", "valibot"],
    "worker": ["celery", "dramatiq", "rq", "arq", "bullmq", "bull"],
    "cli": ["click", "typer", "argparse", "commander", "yargs"],
    "ui": [
        "react", "react-dom", "preact", "vue", "solid-js", "svelte", "next/link", "next/navigation", "next/image",
        "next/router",
    ],
}
RESPONSIBILITY_MARKERS = {
    "http": [
        "api", "apis", "route", "routes", "router", "routers", "endpoint", "endpoints", "controller", "controllers",
    ],
    "db": ["db", "database", "databases", "model", "models", "repository", "repositories", "orm", "query", "queries"],
    "schema": ["schema", "schemas", "serializer", "serializers", "dto", "dtos", "type", "types"],
    "worker": [
        "worker", "workers", "job", "jobs", "task", "tasks", "consumer", "consumers", "queue", "queues", "webhook",
        "webhooks", "cron",
    ],
    "cli": ["cli", "cmd", "command", "commands", "bin"],
    "ui": [
        ".tsx", "ui", "view", "views", "page", "pages", "screen", "screens", "layout", "layouts", "component",
        "components", "hook", "hooks",
    ],
}
