"""Names, extensions and manifests that identify languages, frameworks and tools."""

# --- Fixed values: file inventory. ---

IGNORED_DIRECTORIES = (
    ".git", ".github", ".gitlab", ".hg", ".svn", ".idea", ".vscode", ".pytest_cache", ".mypy_cache", ".ruff_cache",
    ".tox", ".nox", ".next", ".nuxt", ".output", ".parcel-cache", ".turbo", ".cache", ".gradle", ".dart_tool",
    ".terraform", ".serverless", "__pycache__", "venv", ".venv", "env", ".env", "node_modules", "vendor",
    "bower_components", "jspm_packages", "dist", "build", "out", "target", "coverage", "htmlcov", "site-packages",
    "Pods", "DerivedData", "bin", "obj", "logs", "tmp", "temp", "uploads", "storage",
)
IGNORED_FILES = (
    ".DS_Store", "Thumbs.db", "desktop.ini", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock",
    "poetry.lock", "Pipfile.lock", "Cargo.lock",
)
ANALYSIS_EXCLUDED_DIRECTORIES = (
    ".git", ".idea", ".vscode", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "venv", ".venv", "env",
    "node_modules", "dist", "build", "coverage", "htmlcov", "migrations",
)
ANALYSIS_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java",
}

EXTENSION_LANGUAGES = {
    ".py": "Python", ".pyw": "Python", ".js": "JavaScript", ".cjs": "JavaScript", ".mjs": "JavaScript",
    ".jsx": "JavaScript", ".ts": "TypeScript", ".cts": "TypeScript", ".mts": "TypeScript", ".tsx": "TypeScript",
    ".java": "Java", ".kt": "Kotlin", ".kts": "Kotlin", ".php": "PHP", ".go": "Go", ".cs": "C#", ".fs": "F#",
    ".fsx": "F#", ".dart": "Dart", ".rs": "Rust", ".rb": "Ruby", ".swift": "Swift", ".scala": "Scala",
    ".groovy": "Groovy", ".c": "C", ".h": "C/C++ Header", ".cc": "C++", ".cpp": "C++", ".cxx": "C++",
    ".hpp": "C++ Header", ".html": "HTML", ".htm": "HTML", ".css": "CSS", ".scss": "SCSS", ".sass": "Sass",
    ".less": "Less", ".sql": "SQL", ".graphql": "GraphQL", ".gql": "GraphQL", ".proto": "Protocol Buffers",
    ".xml": "XML", ".json": "JSON", ".jsonc": "JSON", ".yaml": "YAML", ".yml": "YAML", ".toml": "TOML", ".ini": "INI",
    ".cfg": "Configuration", ".conf": "Configuration", ".properties": "Properties", ".env": "Environment",
    ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell", ".ps1": "PowerShell", ".bat": "Batch", ".cmd": "Batch",
    ".dockerfile": "Dockerfile",
}
SPECIAL_FILES = {
    "Dockerfile": "Dockerfile", "dockerfile": "Dockerfile", "Makefile": "Makefile", "makefile": "Makefile",
    "Procfile": "Procfile", "Jenkinsfile": "Jenkins", "Vagrantfile": "Ruby", "Gemfile": "Ruby", "Rakefile": "Ruby",
    "Podfile": "Ruby", "requirements.txt": "Python Requirements", "pyproject.toml": "Python Configuration",
    "Pipfile": "Python Configuration", "setup.py": "Python", "setup.cfg": "Python Configuration",
    "package.json": "Node.js Manifest", "tsconfig.json": "TypeScript Configuration", "composer.json": "PHP Manifest",
    "pom.xml": "Maven", "build.gradle": "Gradle", "build.gradle.kts": "Gradle", "settings.gradle": "Gradle",
    "settings.gradle.kts": "Gradle", "go.mod": "Go Module", "go.sum": "Go Module", "Cargo.toml": "Rust Manifest",
    "pubspec.yaml": "Dart Manifest", "pubspec.yml": "Dart Manifest", "web.config": "ASP.NET Configuration",
    "appsettings.json": "ASP.NET Configuration", "openapi.json": "OpenAPI", "openapi.yaml": "OpenAPI",
    "openapi.yml": "OpenAPI", "swagger.json": "OpenAPI", "swagger.yaml": "OpenAPI", "swagger.yml": "OpenAPI",
}
SOURCE_LANGUAGES = (
    "Python", "JavaScript", "TypeScript", "Java", "Kotlin", "PHP", "Go", "C#", "F#", "Dart", "Rust", "Ruby", "Swift",
    "Scala", "Groovy", "C", "C++", "C/C++ Header", "C++ Header",
)

# --- Fixed values: technology detection. ---

TECHNOLOGY_IGNORED_DIRECTORIES = (
    ".git", ".svn", ".hg", ".idea", ".vscode", "__pycache__", ".pytest_cache", ".mypy_cache", ".next", ".nuxt",
    "node_modules", "vendor", "venv", ".venv", "dist", "build", "coverage", "target",
)
# Languages in tie-break order, with the weight of each extension and the bonus of each manifest.
LANGUAGE_WEIGHTS = (
    ("Python", {".py": 5}, {"requirements.txt": 10, "pyproject.toml": 10}),
    ("JavaScript", {".js": 4, ".jsx": 5, ".mjs": 4, ".cjs": 4}, {"package.json": 6}),
    ("TypeScript", {".ts": 5, ".tsx": 5}, {"tsconfig.json": 15}),
    ("Java", {".java": 5}, {"pom.xml": 15, "build.gradle": 10}),
    ("Kotlin", {".kt": 5, ".kts": 4}, {"build.gradle.kts": 15}),
    ("C#", {".cs": 5}, {}),
    ("PHP", {".php": 5}, {"composer.json": 15}),
    ("Go", {".go": 5}, {"go.mod": 15}),
    ("Ruby", {".rb": 5}, {}),
    ("Dart", {".dart": 5}, {"pubspec.yaml": 15}),
    ("Rust", {".rs": 5}, {"cargo.toml": 15}),
    ("C++", {".cpp": 5, ".cc": 5, ".hpp": 3}, {}),
    ("C", {".c": 5, ".h": 2}, {}),
)
PYTHON_MANIFESTS = ("requirements.txt", "pyproject.toml", "Pipfile", "poetry.lock")
PYTHON_FRAMEWORKS = ("FastAPI", "Flask", "Django", "Starlette", "Sanic", "Tornado")
PYTHON_REQUIREMENT = r'(?im)^\s*{name}\s*(?:==|>=|~=|\^)?\s*([0-9][^\s;,\"]*)?'
PYTHON_IMPORTS = {
    "FastAPI": ("from fastapi import", "import fastapi"),
    "Flask": ("from flask import", "import flask"),
    "Django": ("from django", "import django"),
}
NODE_SECTIONS = ("dependencies", "devDependencies", "peerDependencies")
NODE_FRAMEWORKS = {
    "next": "Next.js", "express": "Express", "@nestjs/core": "NestJS", "react": "React", "@angular/core": "Angular",
    "vue": "Vue", "nuxt": "Nuxt", "svelte": "Svelte", "@sveltejs/kit": "SvelteKit", "fastify": "Fastify",
    "koa": "Koa", "hapi": "Hapi", "@hapi/hapi": "Hapi", "react-native": "React Native",
}
PHP_SECTIONS = ("require", "require-dev")
PHP_FRAMEWORKS = {"laravel/framework": "Laravel", "symfony/framework-bundle": "Symfony", "slim/slim": "Slim"}
SPRING_VERSION = r"<(?:\w+:)?spring-boot\.version[^>]*>([^<]+)<"
GRADLE_VERSION = r"org\.springframework\.boot[\"']?\s+version\s+[\"']([^\"']+)"
DOTNET_MARKERS = ("Microsoft.NET.Sdk.Web", "Microsoft.AspNetCore")
DOTNET_VERSION = r"<TargetFramework>([^<]+)</TargetFramework>"
FLUTTER_KEY = r"(?m)^\s*flutter\s*:"
DART_SDK = r"(?s)environment\s*:\s*.*?sdk\s*:\s*[\"']?([^\"'\n]+)"
VERSION_PREFIX = r"^[~^<>=\s]+"
FRAMEWORK_PRIORITY = (
    "FastAPI", "Django", "Flask", "Spring Boot", "NestJS", "Next.js", "Express", "Laravel", "Symfony", "ASP.NET Core",
    "Flutter", "React Native", "Angular", "Vue", "Nuxt", "React", "Fastify", "Koa", "Hapi", "SvelteKit", "Svelte",
    "Starlette", "Sanic", "Tornado", "Slim",
)
KNOWN_MANIFESTS = (
    "requirements.txt", "pyproject.toml", "pipfile", "poetry.lock", "package.json", "package-lock.json", "yarn.lock",
    "pnpm-lock.yaml", "pom.xml", "build.gradle", "build.gradle.kts", "composer.json", "go.mod", "cargo.toml",
    "pubspec.yaml", "gemfile", "dockerfile", "docker-compose.yml", "docker-compose.yaml",
)
DOCKER_FILES = ("dockerfile", "docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")
KUBERNETES_FILES = ("deployment.yaml", "deployment.yml", "service.yaml", "service.yml", "ingress.yaml", "ingress.yml")
OPENAPI_FILES = ("openapi.json", "openapi.yaml", "openapi.yml", "swagger.json", "swagger.yaml", "swagger.yml")
