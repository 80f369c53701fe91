"""File names, extensions, patterns and signatures as data.  Fixed values: names that tools themselves define."""

from __future__ import annotations

#: Language by file name, then by extension.
LANGUAGE_BY_NAME = {"dockerfile": "dockerfile", "makefile": "makefile", "gemfile": "ruby", "rakefile": "ruby", "cmakelists.txt": "cmake", "jenkinsfile": "groovy"}
LANGUAGE_BY_EXTENSION = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".mjs": "javascript", ".cjs": "javascript", ".mts": "typescript", ".cts": "typescript",
    ".vue": "vue", ".svelte": "svelte", ".py": "python", ".go": "go", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".rb": "ruby",
    ".php": "php", ".cs": "csharp", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".rs": "rust", ".swift": "swift", ".sql": "sql",
    ".sh": "shell", ".bash": "shell", ".yml": "yaml", ".yaml": "yaml", ".json": "json", ".toml": "toml", ".md": "markdown", ".mdx": "markdown",
    ".html": "html", ".css": "css", ".scss": "scss", ".graphql": "graphql", ".gql": "graphql", ".prisma": "prisma", ".proto": "protobuf", ".tf": "terraform", ".ex": "elixir", ".exs": "elixir", ".dart": "dart", ".lua": "lua",
}

CONFIG_NAMES = [
    "package.json", "tsconfig.json", "jsconfig.json", "pyproject.toml", "setup.cfg", "setup.py", "requirements.txt", "pipfile", "poetry.toml", "go.mod", "go.sum",
    "cargo.toml", "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "gemfile", "composer.json", "dockerfile", "docker-compose.yml", "docker-compose.yaml",
    "makefile", "justfile", "taskfile.yml", ".eslintrc", ".eslintrc.json", ".prettierrc", ".editorconfig", ".babelrc", ".gitignore", ".dockerignore", "tox.ini", "pytest.ini", "mix.exs", "deno.json",
]

#: Files of secrets, which are never read, and templates without values, which are.
SECRETS = [
    ".env", ".env.*", "!.env.example", "!.env.sample", "!.env.template", "!*.env.example", "!*.env.sample", "!*.env.template", "*.pem", "*.key", "*.p12", "*.pfx", "id_rsa*",
]

#: Default ignore patterns in the syntax of ignore files; the last that matches decides, ! takes back.
IGNORED = [
    *SECRETS,
    "node_modules/", "bower_components/", "vendor/", "third_party/", ".git/", ".svn/", ".hg/", "dist/", "build/", "out/", "target/", ".next/", ".nuxt/", ".output/", ".svelte-kit/",
    "coverage/", ".nyc_output/", "__pycache__/", "*.pyc", "*.pyo", ".venv/", "venv/", "env/", ".tox/", ".mypy_cache/", ".pytest_cache/", ".ruff_cache/", "*.egg-info/", ".gradle/", ".idea/", ".vscode/",
    ".cache/", ".parcel-cache/", ".turbo/", "tmp/", "temp/", "logs/", "*.log", "*.min.js", "*.min.css", "*.map", "*.bundle.js", "*.snap", "*.lock", "package-lock.json", "pnpm-lock.yaml",
    "*.png", "*.jpg", "*.jpeg", "*.gif", "*.webp", "*.ico", "*.svg", "*.bmp", "*.tiff", "*.mp3", "*.mp4", "*.wav", "*.avi", "*.mov", "*.webm", "*.pdf", "*.zip", "*.gz", "*.tar", "*.tgz", "*.7z", "*.rar", "*.jar", "*.war",
    "*.class", "*.exe", "*.dll", "*.so", "*.dylib", "*.o", "*.a", "*.bin", "*.wasm", "*.woff", "*.woff2", "*.ttf", "*.eot", "*.otf", "*.db", "*.sqlite", "*.sqlite3", "*.parquet", ".DS_Store", "Thumbs.db",
]

GENERATED_MARKERS = ["@generated", "do not edit", "auto-generated", "autogenerated", "generated by"]
VENDORED = ["node_modules/", "vendor/", "third_party/", "third-party/", "bower_components/", "site-packages/"]

#: Roles by the first pattern that finds the path, in this order.
ROLE_BY_PATH: list[tuple[str, str]] = [
    ("test", r"(?i)(?:^|/)(?:tests?|__tests__|specs?|e2e)/|[._-](?:test|spec)\.[a-z]+$|(?:^|/)test_[^/]*\.py$|_test\.go$"),
    ("migration", r"(?i)(?:^|/)migrations?/|(?:^|/)alembic/"),
    ("asset", r"(?i)(?:^|/)(?:assets|static|public)/.*\.(?:css|svg|json|txt|html)$"),
    ("route", r"(?i)(?:^|/)routes?/|[._-](?:routes?|router)\.[a-z]+$|(?:^|/)(?:src|app|server|pages)/(?:.*/)?api/"),
    ("controller", r"(?i)(?:^|/)controllers?/|[._-]?controller\.[a-z]+$"),
    ("middleware", r"(?i)(?:^|/)middlewares?/|[._-]?middleware\.[a-z]+$"),
    ("service", r"(?i)(?:^|/)services?/|[._-]?service\.[a-z]+$"),
    ("repository", r"(?i)(?:^|/)(?:repositories|repos?|dao)/|[._-]?repository\.[a-z]+$"),
    ("model", r"(?i)(?:^|/)(?:models?|entities|schemas?)/|[._-](?:model|entity|schema)\.[a-z]+$|\.prisma$"),
    ("component", r"(?i)(?:^|/)components?/"),
    ("hook", r"(?:^|/)hooks?/|(?:^|/)use[A-Z]\w*\.[jt]sx?$"),
    ("util", r"(?i)(?:^|/)(?:utils?|helpers?|lib|common|shared)/|[._-](?:util|helper)s?\.[a-z]+$"),
    ("config", r"(?i)(?:^|/)(?:config|settings)/|\.config\.[a-z]+$|(?:^|/)\.[a-z]+rc(?:\.[a-z]+)?$|(?:^|/)(?:settings|config)\.[a-z]+$"),
    ("worker", r"(?i)(?:^|/)(?:workers?|jobs?|queues?|tasks?)/|[._-](?:worker|job)\.[a-z]+$"),
    ("auth", r"(?i)(?:^|/)auth/|[._-]?auth\.[a-z]+$"),
    ("style", r"(?i)\.(?:css|scss|sass|less)$"),
    ("markup", r"(?i)\.(?:html?|md|mdx)$"),
]
ROLE_BY_CONTENT: list[tuple[str, str]] = [
    ("controller", r"@(?:Rest)?Controller\b"),
    ("service", r"@(?:Injectable|Service)\b"),
    ("route", r"(?:app|router)\.(?:get|post|put|patch|delete)\s*\(\s*[\"'`]/|@(?:app|router)\.(?:get|post|put|patch|delete|route)\("),
    ("component", r"return\s*\(?\s*<[A-Za-z]"),
]
ROLE_ENTRY = (r"(?i)(?:^|/)(?:index|main|app|server)\.[a-z]+$", r"\.listen\s*\(|createRoot\s*\(|__main__|uvicorn\.run|func main\(")
#: Roles for ties, most telling first; the weak ones win only alone.
ROLE_PRIORITY = ["controller", "route", "service", "repository", "model", "middleware", "component", "hook", "worker", "auth", "migration", "entry", "barrel", "config", "util", "style", "markup", "asset", "test", "unknown"]
WEAK_ROLES = ["test", "config", "util", "style", "markup", "asset", "unknown"]

#: Stack signatures: group, name, kind of evidence, value.
SIGNATURES: list[tuple[str, str, str, str]] = [
    *[("framework", n, "name", v) for n, v in [("React", "react"), ("Next.js", "next"), ("Vue", "vue"), ("Nuxt", "nuxt"), ("Svelte", "svelte"), ("Angular", "@angular/core"), ("Express", "express"), ("Fastify", "fastify"), ("NestJS", "@nestjs/core"), ("Koa", "koa"), ("Hono", "hono"), ("Remix", "@remix-run/react"), ("Astro", "astro"), ("Electron", "electron"), ("React Native", "react-native"), ("Django", "django"), ("Flask", "flask"), ("FastAPI", "fastapi"), ("Rails", "rails"), ("Laravel", "laravel/framework"), ("Spring Boot", "org.springframework.boot"), ("Gin", "github.com/gin-gonic/gin")]],
    *[("test", n, "name", v) for n, v in [("Jest", "jest"), ("Vitest", "vitest"), ("Mocha", "mocha"), ("Cypress", "cypress"), ("Playwright", "@playwright/test"), ("Testing Library", "@testing-library/react"), ("Supertest", "supertest"), ("AVA", "ava"), ("pytest", "pytest"), ("Hypothesis", "hypothesis"), ("RSpec", "rspec"), ("PHPUnit", "phpunit/phpunit"), ("JUnit", "junit"), ("Testify", "github.com/stretchr/testify"), ("xUnit", "xunit")]],
    *[("database", n, "name", v) for n, v in [("PostgreSQL", "pg"), ("PostgreSQL", "psycopg2"), ("MySQL", "mysql2"), ("SQLite", "sqlite3"), ("SQLite", "better-sqlite3"), ("MongoDB", "mongodb"), ("MongoDB", "mongoose"), ("Redis", "redis"), ("Redis", "ioredis"), ("Prisma", "@prisma/client"), ("TypeORM", "typeorm"), ("Sequelize", "sequelize"), ("Drizzle", "drizzle-orm"), ("Knex", "knex"), ("SQLAlchemy", "sqlalchemy"), ("Elasticsearch", "@elastic/elasticsearch")]],
    *[("service", n, k, v) for n, k, v in [("AWS", "prefix", "@aws-sdk/"), ("AWS", "name", "boto3"), ("Google Cloud", "prefix", "@google-cloud/"), ("Azure", "prefix", "@azure/"), ("Stripe", "name", "stripe"), ("Twilio", "name", "twilio"), ("SendGrid", "name", "@sendgrid/mail"), ("Sentry", "prefix", "@sentry/"), ("Datadog", "name", "dd-trace"), ("Firebase", "name", "firebase"), ("Supabase", "name", "@supabase/supabase-js"), ("Kafka", "name", "kafkajs"), ("RabbitMQ", "name", "amqplib"), ("GraphQL", "name", "graphql"), ("OpenTelemetry", "prefix", "@opentelemetry/"), ("Celery", "name", "celery")]],
    *[("auth", n, "name", v) for n, v in [("Passport", "passport"), ("JWT", "jsonwebtoken"), ("JWT", "jose"), ("JWT", "pyjwt"), ("NextAuth", "next-auth"), ("Clerk", "@clerk/nextjs"), ("Auth0", "auth0"), ("bcrypt", "bcrypt"), ("bcrypt", "bcryptjs"), ("Argon2", "argon2"), ("Lucia", "lucia"), ("Devise", "devise")]],
]
