"""Word lists, patterns, labels and thresholds whose exact value decides results."""

# Percentile points.
POINTS = {"p50": 0.50, "p95": 0.95, "p99": 0.99}

# Preset baselines: operation -> (target, p50, p95, p99, regression threshold in percent).
PRESET_BASELINES = {
    "classification": (50, 30, 45, 50, 20.0),
    "tree_query": (500, 300, 450, 500, 20.0),
    "tool_execution": (200, 100, 180, 200, 20.0),
    "file_operations": (10, 5, 8, 10, 20.0),
    "cache_lookup": (1, 0, 1, 1, 50.0),
}

# Log levels by severity.
LEVELS = {"Debug": 0, "Info": 1, "Warn": 2, "Error": 3}

# Error type -> any of these in the lower-cased message, first match wins.
ERROR_TYPES = {
    "Network": ["network", "connection"],
    "Timeout": ["timeout", "timed out"],
    "Parse": ["parse", "invalid"],
    "ComplexityExceeded": ["complexity", "too complex"],
    "ProviderUnavailable": ["unavailable", "not available"],
    "IoError": ["io", "file"],
    "RateLimit": ["rate limit", "too many requests"],
}

# Error type -> (retry strategy, base delay in ms).
RETRY = {
    "Network": ("ExponentialBackoff", 100),
    "Timeout": ("ExponentialBackoff", 200),
    "RateLimit": ("ExponentialBackoff", 1000),
    "Parse": ("Immediate", 0),
    "ComplexityExceeded": ("SimplifiedPrompt", 0),
    "ProviderUnavailable": ("AlternativeProvider", 0),
}

# Command risk: patterns over the lower-cased command, most severe level first.
RISK = {
    "Critical": [
        r"rm\s+(-[rf]+\s+)*/?$", r"rm\s+(-[rf]+\s+)*/\*", r":\(\)\s*\{\s*:\|:\s*&\s*\}\s*;", r"mkfs\.",
        r"dd\s+if=[^\s]*\sof=/dev/[sh]d[a-z]", r">\s*/dev/[sh]d[a-z]", r"chmod\s+(-R\s+)?777\s+/", r"/etc/shadow", r"/etc/sudoers",
    ],
    "High": [
        r"\bsudo\b", r"\bsu\s+-", r"\bdoas\b", r"\bpkexec\b", r"dd\s+if=", r"systemctl\s+(stop|disable|mask)", r"service\s+\w+\s+stop",
        r"iptables\s+-F", r"ufw\s+disable", r"shutdown", r"reboot", r"init\s+[06]", r"halt", r"poweroff",
    ],
    "Medium": [
        r"rm\s+(-[rf]+)", r"chmod\s+(-R\s+)?[0-7]{3}", r"chown\s+-R", r"git\s+push\s+[^\s]*\s+--force", r"git\s+reset\s+--hard",
        r"git\s+clean\s+-[fd]+", r"DROP\s+(DATABASE|TABLE)", r"TRUNCATE\s+TABLE", r"DELETE\s+FROM\s+\w+\s*;?\s*$", r"docker\s+rm\s+-f",
        r"docker\s+system\s+prune", r"docker\s+volume\s+rm", r"curl\s+[^\s]*\s*\|\s*(ba)?sh", r"wget\s+[^\s]*\s*\|\s*(ba)?sh",
    ],
    "Low": [
        r"rm\s+", r"mv\s+", r"cp\s+.*-[rf]", r"chmod\s+", r"chown\s+", r"npm\s+install\s+-g", r"pip\s+install\s+--system",
        r"cargo\s+install", r"apt\s+(install|remove|purge)", r"apt-get\s+(install|remove|purge)", r"pacman\s+-[SR]",
        r"brew\s+(install|uninstall)",
    ],
}

# Commands refused when they occur anywhere in the text.
BLOCKED_COMMANDS = ["rm -rf /", "rm -rf /*", "mkfs", "dd if=/dev", ":(){:|:&};:", "chmod -R 777 /"]

# Simple commands: word -> action, in order.
SIMPLE_COMMANDS = {
    "exit": "Exit", "quit": "Exit", "bye": "Exit", "help": "Help", "?": "Help", "clear": "ClearHistory", "history": "ShowHistory",
    "status": "ShowStatus", "ls": "ListFiles", "list": "ListFiles", "salir": "Exit", "chao": "Exit", "ayuda": "Help",
    "limpiar": "ClearHistory", "historial": "ShowHistory", "estado": "ShowStatus", "listar": "ListFiles", "archivos": "ListFiles",
}
GENERATE_WORDS = ["genera", "generate", "crea una función", "create a function", "escribe una clase", "write a class"]
GENERATED_THINGS = ["función", "function", "clase", "class", "struct", "método"]
# Language of a request -> any of these, first match wins.
REQUEST_LANGUAGES = {
    "rust": ["rust", ".rs"], "python": ["python", ".py"], "javascript": ["javascript", ".js"],
    "typescript": ["typescript", ".ts"], "go": ["go ", "golang"],
}
REQUEST_PATH_ENDS = [".rs", ".py", ".js", ".ts", ".go", ".java"]

# Query complexity.
CASUAL_STARTS = ["hola", "hello", "hi", "hey", "buenos días", "good morning", "qué tal", "how are you", "cómo estás", "gracias", "thank", "thanks"]
DEFINITION_WORDS = ["qué es", "what is", "define", "definition"]
CODE_WORDS = [
    "código", "code", "función", "function", "clase", "class", "archivo", "file", "módulo", "module", "struct", "estructura",
    ".rs", ".py", ".js", ".ts", ".go", ".java", ".cpp", ".c", ".h", "src/", "lib/", "main", "mod.rs", "lib.rs",
    "implementación", "implementation", "método", "method", "variable", "trait", "interface", "tipo", "type",
]
PROJECT_WORDS = [
    "este proyecto", "this project", "el proyecto", "the project", "este código", "this code", "el código", "the code",
    "esta aplicación", "this application", "la aplicación", "the application", "este programa", "this program", "el programa",
    "the program", "este repositorio", "this repository", "this repo", "el repositorio", "the repository", "the repo",
    "analiza este", "analyze this", "analiza el", "analyze the", "revisa este", "review this", "explica este", "explain this",
]

# Intent -> keywords, first match wins; an intent may appear twice.
INTENTS = [
    ("SearchCode", ["busca", "encuentra", "localiza", "dónde", "donde", "search", "find", "locate", "where"]),
    ("ReadCode", ["lee", "muestra", "abre", "cat", "ver", "read", "show", "open", "display", "contenido"]),
    ("AnalyzeCode", ["analiza", "revisa", "examina", "check", "analyze", "review", "examine", "inspect"]),
    ("BrowseFiles", ["lista", "ls", "archivos", "directorio", "list", "files", "directory", "carpeta", "folder"]),
    ("Explain", ["qué hace", "cómo funciona", "explica", "por qué", "what does", "how does", "explain", "why"]),
    ("ModifyCode", ["refactoriza", "mejora", "cambia", "modifica", "edita", "refactor", "improve", "change", "modify", "edit", "update", "actualiza"]),
    ("RunTests", ["test", "prueba", "ejecuta test", "tests", "testing", "run test"]),
    ("GitOps", ["git", "commit", "diff", "status", "branch", "push", "pull", "merge"]),
    ("ModifyCode", ["crea", "escribe", "genera", "create", "write", "generate", "nuevo", "new"]),
    ("ModifyCode", ["ejecuta", "corre", "run", "execute", "comando", "command", "shell", "terminal"]),
]
# Path in a request: the first of these patterns that matches.
REQUEST_PATHS = [r"[\w/]+\.(rs|py|ts|js|go|java|cpp|c|h)", r"src/[\w/]+", r"[\w/]+/[\w/]+"]

EXPLAIN_PHRASES = [
    "explica", "explícame", "explicame", "de qué se trata", "de que se trata", "analiza el repositorio", "qué hace este proyecto",
    "que hace este proyecto", "what does this project do", "explain this repository", "explain the project",
    "analyze the repository", "describe the project",
]

VAGUE_PHRASES = [
    "no puedo", "no sé", "no tengo", "necesito más", "especifica", "podrías ser más específico", "no está claro", "no entiendo",
    "sin más contexto", "sin información",
    "i cannot", "i can't", "i don't know", "i don't have", "i need more", "please specify", "could you be more specific", "not clear",
    "unclear", "i don't understand", "without more context", "without information", "i'm unable", "cannot perform", "let me know if",
]

# Natural language to action.
ACTION_READ = [
    "lee ", "leer ", "read ", "muestra ", "mostrar ", "show ", "abre ", "abrir ", "open ", "ver ", "cat ", "contenido ", "dame ",
    "muestrame ", "muéstrame ", "enseña ", "enseñame ", "visualiza ", "imprime ", "print ",
]
ACTION_READ_STARTS = ["lee", "ver"]
ACTION_LIST = [
    "lista", "listar", "list", "ls", "archivos", "files", "directorio", "directory", "carpeta", "folder", "qué hay", "que hay",
    "what's in", "whats in", "what is in", "muestra la estructura", "estructura del proyecto", "tree", "contenido de la carpeta", "files in",
]
ACTION_EXEC = [
    "ejecuta", "ejecutar", "run ", "exec", "corre ", "correr ", "compila", "compilar", "build", "construye", "construir", "cargo", "npm",
    "make", "yarn", "pnpm",
]
ACTION_TEST = ["test", "prueba", "pruebas", "testing", "spec"]
ACTION_GIT = ["git ", "commit", "status", "diff", "branch", "push", "pull", "log"]
GIT_COMMANDS = [
    ("git status", ["status", "estado"]), ("git diff", ["diff", "cambios"]),
    ("git log --oneline -10", ["log", "historial", "commits"]), ("git branch", ["branch", "rama"]),
]
ACTION_SEARCH = ["busca", "buscar", "search", "encuentra", "encontrar", "find", "grep", "localiza"]
ACTION_STRUCTURE = ["estructura", "structure", "arquitectura", "architecture", "organización", "organization", "cómo está organizado"]
ACTION_ANALYSE = ["analiza", "analyze", "revisa", "review", "problemas", "issues", "errores en el código"]
ACTION_ANALYSE_OBJECTS = ["código", "code", "proyecto"]
ACTION_DEPENDENCIES = ["dependencias", "dependencies", "librerías", "libraries", "paquetes", "packages", "crates"]
ACTION_MAIN = ["código principal", "main code", "punto de entrada", "entry point", "archivo principal", "main file"]
ACTION_DOCS = ["documentación", "documentation", "readme", "cómo usar", "how to use", "guía", "guide"]
MESSAGE_COMMANDS = [
    ("cargo build", ["cargo build", "compila"]), ("cargo run", ["cargo run", "ejecuta el proyecto"]),
    ("cargo test", ["cargo test", "corre los tests", "run tests"]), ("cargo check", ["cargo check"]), ("npm install", ["npm install"]),
]

QUOTED_COMMAND = r"""["`']([^"`']+)["`']"""
# Path in a message: dotted name, word after a preposition, slashed path.
MESSAGE_PATHS = [
    r"[\w./\-]+\.[\w]+",
    r"""(?:en|in|from|de|la carpeta|folder|directory|directorio)\s+["']?([^\s"']+)["']?""",
    r"((?:\./|\.\./)?\w+(?:/\w+)*)",
]

# Task planning: type -> words, first match wins.
TASK_TYPES = {
    "Analysis": ["analyz", "understand", "review", "check"],
    "Research": ["read", "find", "search", "look", "gather"],
    "Implementation": ["write", "create", "implement", "add", "modify", "update", "fix"],
    "Testing": ["test", "verify", "validate", "run"],
    "Review": ["refactor", "clean", "optimize"],
    "Execution": ["execute", "command", "shell", "install", "build"],
    "Documentation": ["document", "readme", "comment"],
    "Planning": ["plan", "design", "architect"],
}
# (task type, words or None for always, tool), first match wins.
TASK_TOOLS = [
    ("Research", ["file", "read"], "read_file"), ("Research", ["director", "list", "find"], "list_directory"),
    ("Research", ["search", "grep"], "search_in_files"), ("Research", ["index", "project"], "index_project"),
    ("Implementation", ["write", "create", "modify"], "write_file"), ("Testing", ["lint", "check"], "run_linter"),
    ("Testing", ["test", "cargo test"], "execute_shell"), ("Execution", None, "execute_shell"),
    ("Analysis", ["code", "function", "class"], "analyze_code"), ("Analysis", ["depend"], "analyze_dependencies"),
    ("Analysis", ["git"], "git_tool"),
]
EFFORT_COMPLEX = ["refactor", "redesign", "migrate", "complete"]
EFFORT_LARGE = ["implement", "create new", "build"]
EFFORT_BY_TYPE = {
    "Research": "Small", "Analysis": "Small", "Documentation": "Medium", "Testing": "Small", "Execution": "Trivial",
    "Review": "Medium", "Planning": "Small",
}

# Language by file name, then by extension.
LANGUAGE_BY_NAME = {
    "Cargo.toml": "Rust", "Cargo.lock": "Rust", "package.json": "JavaScript", "package-lock.json": "JavaScript",
    "tsconfig.json": "TypeScript", "pyproject.toml": "Python", "setup.py": "Python", "requirements.txt": "Python",
    "Makefile": "Make", "makefile": "Make", "Dockerfile": "Docker", "docker-compose.yml": "Docker",
    "docker-compose.yaml": "Docker", ".gitignore": "Git", ".gitattributes": "Git",
}
LANGUAGE_BY_EXTENSION = {
    "rs": "Rust", "py": "Python", "pyi": "Python", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript",
    "mts": "TypeScript", "cts": "TypeScript", "tsx": "React", "jsx": "React", "go": "Go", "java": "Java", "kt": "Kotlin",
    "kts": "Kotlin", "c": "C", "h": "C", "cpp": "C++", "cc": "C++", "cxx": "C++", "hpp": "C++", "cs": "C#", "rb": "Ruby",
    "php": "PHP", "swift": "Swift", "scala": "Scala", "lua": "Lua", "r": "R", "sql": "SQL", "sh": "Shell", "bash": "Shell",
    "zsh": "Shell", "ps1": "PowerShell", "html": "HTML", "htm": "HTML", "css": "CSS", "scss": "CSS", "sass": "CSS", "less": "CSS",
    "json": "JSON", "yaml": "YAML", "yml": "YAML", "toml": "TOML", "xml": "XML", "md": "Markdown", "markdown": "Markdown",
    "txt": "Text", "vue": "Vue", "svelte": "Svelte", "elm": "Elm", "ex": "Elixir", "exs": "Elixir", "erl": "Erlang",
    "hrl": "Erlang", "hs": "Haskell", "ml": "OCaml", "mli": "OCaml", "clj": "Clojure", "cljs": "Clojure", "cljc": "Clojure",
    "nim": "Nim", "zig": "Zig", "v": "V", "dart": "Dart", "proto": "Protobuf", "graphql": "GraphQL", "gql": "GraphQL",
}
CONFIG_NAME_PARTS = ["config", "settings", "docker-compose"]
CONFIG_EXTENSIONS = ["toml", "yaml", "yml", "ini"]
DOC_EXTENSIONS = ["md", "txt", "rst", "adoc"]
DOC_NAMES = ["readme", "changelog", "license", "contributing", "authors"]
DATA_EXTENSIONS = ["json", "csv", "xml", "sql"]
BINARY_EXTENSIONS = [
    "exe", "dll", "so", "dylib", "bin", "o", "a", "lib", "png", "jpg", "jpeg", "gif", "ico", "svg", "woff", "woff2", "ttf", "eot",
    "pdf", "zip", "tar", "gz", "rar", "7z",
]
UNSEARCHED_EXTENSIONS = [
    "exe", "dll", "so", "dylib", "bin", "o", "a", "lib", "png", "jpg", "jpeg", "gif", "ico", "svg", "woff", "woff2", "ttf", "eot",
    "pdf", "zip", "tar", "gz", "rar", "7z", "mp3", "mp4", "wav", "avi", "mov", "mkv",
]
KEY_FILES = [
    "readme.md", "cargo.toml", "package.json", "main.rs", "lib.rs", "mod.rs", "index.js", "index.ts", "app.py", "main.py", "main.go",
    "pom.xml", "build.gradle", "makefile", "dockerfile",
]
KEY_FILE_ENDS = ["mod.rs", "/main.rs"]
KEY_FILE_PARTS = ["src/lib", "src/main"]

# Decision tokens of cyclomatic complexity, each occurrence counts one.
DECISION_TOKENS = ["if ", "else if", "elif ", "while ", "for ", "case ", "catch ", "&&", "||", "?", "match ", "when "]
CALL_EXCLUSIONS = ["if", "while", "for", "match", "switch", "catch"]
SLASH_COMMENT_LANGUAGES = ["Rust", "JavaScript", "TypeScript", "Java", "C", "C++", "Go", "C#"]
HASH_COMMENT_LANGUAGES = ["Python", "Ruby"]

# Framework checks by manifest: substring -> name.
RUST_FRAMEWORKS = {
    "tokio": "Tokio", "actix": "Actix", "axum": "Axum", "rocket": "Rocket", "warp": "Warp", "serde": "Serde", "diesel": "Diesel",
    "sqlx": "SQLx", "clap": "Clap", "ratatui": "Ratatui",
}
SCRIPT_FRAMEWORKS = {
    "react": "React", "vue": "Vue", "angular": "Angular", "next": "Next.js", "nuxt": "Nuxt", "express": "Express",
    "fastify": "Fastify", "nest": "NestJS", "prisma": "Prisma", "mongoose": "Mongoose",
}
PYTHON_FRAMEWORKS = {
    "django": "Django", "flask": "Flask", "fastapi": "FastAPI", "sqlalchemy": "SQLAlchemy", "pytest": "Pytest", "pandas": "Pandas",
    "numpy": "NumPy", "torch": "PyTorch", "tensorflow": "TensorFlow",
}
IMPORTANT_FILES = {
    "README.md": ("Readme", "Project documentation"), "README.rst": ("Readme", "Project documentation"),
    "LICENSE": ("License", "License file"), "LICENSE.md": ("License", "License file"), "CHANGELOG.md": ("Changelog", "Change history"),
    "CHANGES.md": ("Changelog", "Change history"), "Cargo.toml": ("ManifestPackage", "Rust package manifest"),
    "package.json": ("ManifestPackage", "Node.js package manifest"), "pyproject.toml": ("ManifestPackage", "Python package manifest"),
    "go.mod": ("ManifestPackage", "Go module file"), "Dockerfile": ("DockerFile", "Docker configuration"),
    "docker-compose.yml": ("DockerFile", "Docker Compose configuration"), ".github/workflows": ("CiConfig", "GitHub Actions"),
    ".gitlab-ci.yml": ("CiConfig", "GitLab CI"), "Makefile": ("BuildScript", "Build automation"), "build.rs": ("BuildScript", "Rust build script"),
}
REQUIREMENT_OPERATORS = ["==", ">=", "<=", "~=", "!=", ">", "<"]

# Git change letters and working-tree codes (type, priority).
CHANGE_TYPES = {"A": "Added", "M": "Modified", "D": "Deleted", "R": "Renamed", "C": "Copied"}
WORKTREE_CODES = {
    "A ": ("Added", 0.9), " A": ("Added", 0.9), "M ": ("Modified", 1.0), " M": ("Modified", 1.0), "MM": ("Modified", 1.0),
    "D ": ("Deleted", 0.7), " D": ("Deleted", 0.7), "??": ("Untracked", 0.6),
}

# Retrieval.
SIMILARITY_THRESHOLD = 0.3
CANDIDATES = 50
FUZZY_THRESHOLD = 0.85
FUZZY_CACHE = 100
