"""Static detection rules.

Ids, categories, types, severities, confidences and numbers of weaknesses are fixed values.  Patterns are our own, written for
each rule's purpose, for Python's ``re``; the four words of ``quality.todo-marker`` are fixed values too; where a rule names one call (``bug.async-foreach``, ``perf.json-deep-clone``,
``quality.console-log``) hardly another pattern is possible.
"""

from __future__ import annotations

from typing import NamedTuple

JS = ("javascript", "typescript", "jsx", "tsx", "vue", "svelte")
ANY: tuple[str, ...] = ()


class Rule(NamedTuple):
    id: str
    category: str
    type: str
    severity: str
    confidence: float
    cwe: str | None
    languages: tuple[str, ...]
    skip_tests: bool
    pattern: str
    unless: str | None = None
    message: str = ""


_SQL = r"(?:select\b.{0,200}\bfrom|insert\s+into|update\s+\w+\s+set|delete\s+from)"
_REQ = r"(?:req|request|ctx|context)\.(?:body|query|params|headers|cookies)"

RULES: list[Rule] = [
    Rule("sec.sql-injection.template", "security", "sql-injection", "critical", 0.85, "CWE-89", JS, False, rf"(?is)\b(?:query|execute|raw|\$queryRawUnsafe|\$executeRawUnsafe)\s*\(\s*`[^`]*?{_SQL}[^`]*?\$\{{"),
    Rule("sec.sql-injection.concat", "security", "sql-injection", "critical", 0.9, "CWE-89", ANY, False, rf"""(?i)(["'])(?:(?!\1)[^\n])*?{_SQL}(?:(?!\1)[^\n])*\1\s*\+\s*(?!(?-i:[A-Z][A-Z0-9_]*)\b)[a-z_$]"""),
    Rule("sec.sql-injection.python", "security", "sql-injection", "critical", 0.85, "CWE-89", ("python",), False, rf"""(?is)\.execute(?:many)?\s*\(\s*(?:f["']{{1,3}}[^"']*?{_SQL}[^"']*?\{{|["'][^"']*?{_SQL}[^"']*?["']\s*(?:%\s*\(?\w|\.format\())"""),
    Rule("sec.command-injection", "security", "command-injection", "critical", 0.85, "CWE-78", JS, False, r"""\b(?:exec|execSync|spawn|spawnSync)\s*\(\s*(?:`[^`]*\$\{|["'][^"'\n]*["']\s*\+)"""),
    Rule("sec.command-injection.python", "security", "command-injection", "high", 0.8, "CWE-78", ("python",), False, r"""\bos\.(?:system|popen)\s*\(\s*(?:f["']|[^)\n]*["']\s*[+%]|\w+\s*[+%)])|\bsubprocess\.\w+\s*\([^)\n]*shell\s*=\s*True"""),
    Rule("sec.eval", "security", "code-injection", "high", 0.8, "CWE-95", ANY, True, r"""(?<![\w.$])(?:eval|new\s+Function)\s*\(\s*(?!["'`)])"""),
    Rule("sec.xss.dangerously-set-html", "security", "xss", "high", 0.75, "CWE-79", JS, False, r"dangerouslySetInnerHTML|\.innerHTML\s*=\s*(?![\"'`])|\bv-html\s*=", r"(?i)sanitiz|purify|escapeHtml"),
    Rule("sec.path-traversal", "security", "path-traversal", "high", 0.8, "CWE-22", JS, False, rf"(?:path\.(?:join|resolve)|readFile(?:Sync)?|createReadStream|sendFile|unlink(?:Sync)?)\s*\([^;\n]*{_REQ}"),
    Rule("sec.ssrf", "security", "ssrf", "high", 0.75, "CWE-918", JS, False, rf"(?:\bfetch|axios(?:\.\w+)?|got(?:\.\w+)?|https?\.(?:get|request))\s*\(\s*(?:`[^`]*\$\{{\s*)?{_REQ}"),
    Rule("sec.jwt.decode-without-verify", "security", "broken-authentication", "critical", 0.9, "CWE-347", ANY, True, r"\b(?:jwt|jsonwebtoken)\.decode\s*\((?![^)\n]*verify)|\bverify_signature[\"']?\s*[:=]\s*(?:False|false)"),
    Rule("sec.jwt.alg-none", "security", "broken-authentication", "critical", 0.95, "CWE-347", ANY, False, r"""(?i)\balg(?:orithms?)?["']?\s*[:=]\s*\[?\s*["']none["']"""),
    Rule("sec.weak-hash", "security", "weak-cryptography", "high", 0.7, "CWE-327", ANY, False, r"""(?i)createHash\s*\(\s*["'](?:md5|sha-?1)["']|\bhashlib\.(?:md5|sha1)\s*\(|MessageDigest\.getInstance\s*\(\s*["'](?:MD5|SHA-?1)["']|\bmd5\.(?:New|Sum)\b|\bDigest::(?:MD5|SHA1)\b"""),
    Rule("sec.insecure-random", "security", "weak-cryptography", "high", 0.75, "CWE-338", ANY, False, r"(?i)(?:token|secret|password|passwd|session|nonce|otp|salt|api_?key|csrf|reset)\w*\s*[:=][^;\n]*(?:Math\.random\s*\(|\brandom\.(?:random|randint|choice)\s*\(|\brand\(\))"),
    Rule("sec.insecure-random.id-idiom", "security", "weak-cryptography", "high", 0.8, "CWE-338", JS, False, r"Math\s*\.\s*random\s*\(\s*\)\s*\)?\s*\.\s*toString\s*\(\s*[1-9]\d?\s*\)"),
    Rule("sec.cors.wildcard", "security", "insecure-cors", "medium", 0.8, "CWE-942", ANY, False, r"""(?i)access-control-allow-origin["']?\s*[,:]\s*["']\*["']|\borigin\s*:\s*["']\*["']|allow_origins\s*=\s*\[\s*["']\*["']"""),
    Rule("sec.cors.reflect", "security", "insecure-cors", "high", 0.85, "CWE-942", ANY, False, r"(?i)access-control-allow-origin[\"']\s*,\s*(?:req|request|ctx)\.\S*origin|\borigin\s*:\s*true\b"),
    Rule("sec.tls-disabled", "security", "insecure-transport", "high", 0.9, "CWE-295", ANY, False, r"""rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED["']?\]?\s*[:=]\s*["']?0|\bverify\s*=\s*False\b|InsecureSkipVerify\s*:\s*true|CERT_NONE\b"""),
    Rule("sec.sensitive-logging", "security", "sensitive-data-exposure", "medium", 0.7, "CWE-532", ANY, False, r"(?i)\b(?:console\.\w+|log(?:ger|ging)?\.\w+|print(?:ln)?)\s*\([^)\n]*\b(?:password|passwd|secret|api_?key|access_?token|private_?key|credit_?card|ssn)\b"),
    Rule("sec.unsafe-deserialization", "security", "unsafe-deserialization", "high", 0.85, "CWE-502", ANY, False, r"\bpickle\.loads?\s*\(|\byaml\.load\s*\((?![^)\n]*Safe)|\bmarshal\.loads\s*\(|\bunserialize\s*\(|new\s+ObjectInputStream\s*\("),
    Rule("sec.mass-assignment", "security", "mass-assignment", "high", 0.75, "CWE-915", JS, False, r"\.(?:create|update|updateMany|insert|assign)\s*\(\s*(?:\{\s*(?:data\s*:\s*)?)?(?:\.\.\.)?\s*(?:req|request)\.body\s*[,)}]"),
    Rule("sec.debug-endpoint", "security", "debug-endpoint", "medium", 0.7, "CWE-489", ANY, True, r"""(?i)["'`]/(?:debug|__debug__|phpinfo|actuator/env|test-only)\b[^"'`]*["'`]|\bapp\.run\([^)\n]*debug\s*=\s*True|^\s*DEBUG\s*=\s*True\b"""),
    Rule("sec.password.plaintext-lookup", "security", "plaintext-password", "critical", 0.8, "CWE-256", JS, True, r"(?s)\bfind(?:One|First|Unique)?\s*\(\s*\{[^}]{0,200}\bpassword\s*(?::\s*[\w.]+)?\s*[,}]", r"(?i)hash|bcrypt|argon|select\s*:"),
    Rule("sec.mass-assignment.constructor", "security", "mass-assignment", "high", 0.75, "CWE-915", JS, True, r"new\s+[A-Z]\w*\s*\(\s*(?:\{\s*\.\.\.\s*)?(?:req|request)\.body\s*[)}]"),
    Rule("sec.cors.default-open", "security", "insecure-cors", "medium", 0.7, "CWE-942", JS, True, r"\.use\s*\(\s*cors\s*\(\s*\)\s*\)"),
    Rule("sec.nosql-injection.where", "security", "nosql-injection", "critical", 0.85, "CWE-943", JS, True, r"""["']?\$where["']?\s*:\s*(?:`[^`]*\$\{|["'][^"'\n]*["']\s*\+|(?:req|request)\.)"""),
    Rule("sec.secret.hardcoded-literal", "security", "hardcoded-secret", "high", 0.75, "CWE-798", ANY, True, r"""(?i)\b\w*(?:secret|password|passwd|api_?key|auth_?token|private_?key)\w*["']?\s*[:=]\s*["'][^"'\s$<{]{8,}["']""", r"(?i)process\.env|os\.environ|getenv|example|placeholder|changeme|your[-_]|xxxx|dummy|\.(?:md|test|spec)\b"),
    Rule("sec.cookie.insecure-flags", "security", "insecure-cookie", "medium", 0.75, "CWE-614", JS, True, r"\b(?:httpOnly|secure)\s*:\s*false\b"),
    Rule("sec.command-injection.java", "security", "command-injection", "critical", 0.8, "CWE-78", ("java", "kotlin", "scala"), True, r"getRuntime\(\)\s*\.\s*exec\s*\(\s*(?![\"'][^\"'\n]*[\"']\s*\))|new\s+ProcessBuilder\s*\([^)\n]*\+"),
    Rule("sec.command-injection.go", "security", "command-injection", "high", 0.7, "CWE-78", ("go",), True, r"""exec\.Command(?:Context)?\s*\([^)\n]*(?:["'](?:ba)?sh["']\s*,\s*["']-c["']|fmt\.Sprintf|\+)""", r"(?i)_test\.go"),
    Rule("sec.xss.go-template-html", "security", "xss", "high", 0.75, "CWE-79", ("go",), True, r"template\.(?:HTML|JS|URL)\s*\(\s*(?![\"`])"),
    Rule("sec.weak-hash.bare-call", "security", "weak-hash", "critical", 0.85, "CWE-327", ("python",), True, r"(?<![\w.])(?:md5|sha1)\s*\(\s*\w*(?:pass|pwd|secret|token)\w*"),
    Rule("sec.sql-injection.php", "security", "sql-injection", "critical", 0.85, "CWE-89", ("php",), True, rf"""(?i)["']\s*{_SQL}[^"'\n]*(?:\$_(?:GET|POST|REQUEST|COOKIE)|["']\s*\.\s*\$|\$\w+)"""),
    Rule("sec.unsafe-reflection.ruby", "security", "unsafe-reflection", "critical", 0.85, "CWE-470", ("ruby",), True, r"params\[[^\]]+\][^\n]{0,40}\.(?:constantize|safe_constantize)|\b(?:public_)?send\s*\(?\s*params\["),
    Rule("sec.unsafe-deserialization.ruby", "security", "unsafe-deserialization", "critical", 0.85, "CWE-502", ("ruby",), True, r"\bMarshal\.load\b|\bYAML\.load\b(?!_)|\bOj\.load\b"),
    Rule("sec.xss.ruby-html-safe", "security", "xss", "high", 0.8, "CWE-79", ("ruby",), True, r"\.html_safe\b|\braw\s*\(?\s*(?:params|@)"),
    Rule("sec.sql-injection.ruby", "security", "sql-injection", "critical", 0.85, "CWE-89", ("ruby",), True, r"""\.(?:where|find_by_sql|order|joins|execute|pluck)\s*\(?\s*["'][^"'\n]*#\{"""),
    Rule("sec.command-injection.php", "security", "command-injection", "critical", 0.85, "CWE-78", ("php",), True, r"(?<![\w>:])(?:exec|shell_exec|system|passthru|popen|proc_open)\s*\([^)\n]*\$"),
    Rule("sec.sql-injection.csharp", "security", "sql-injection", "critical", 0.8, "CWE-89", ("csharp",), True, rf"""(?i)(?:\$@?["'][^"'\n]*{_SQL}[^"'\n]*\{{|["']\s*{_SQL}[^"'\n]*["']\s*\+)""", r"(?i)FromSqlInterpolated|nameof"),
    Rule("sec.unsafe-deserialization.dotnet", "security", "unsafe-deserialization", "critical", 0.85, "CWE-502", ("csharp",), True, r"new\s+(?:BinaryFormatter|SoapFormatter|NetDataContractSerializer|LosFormatter)\s*\(|TypeNameHandling\.(?:All|Auto|Objects)"),
    Rule("bug.empty-catch", "bug", "swallowed-exception", "medium", 0.9, None, ANY, True, r"\bcatch\b[^{};\n]{0,120}\{\s*\}|(?m:^[ \t]*except\b[^\n]*:[ \t]*(?:#[^\n]*)?\s*(?:pass|\.\.\.)[ \t]*(?:#[^\n]*)?$)"),
    Rule("bug.async-foreach", "bug", "async-misuse", "high", 0.9, None, JS, False, r"\.forEach\s*\(\s*async\b"),
    Rule("bug.assignment-in-condition", "bug", "incorrect-condition", "high", 0.85, None, ANY, False, r"\bif\s*\(\s*[\w.]+\s*=\s*(?![=>~])[^=()\n]+\)"),
    Rule("bug.parseint-no-radix", "bug", "type-mismatch", "low", 0.85, None, JS, False, r"(?<![\w$])parseInt\((?:[^(),\n]|\([^()\n]*\))+\)"),
    Rule("bug.bare-except", "bug", "error-handling", "medium", 0.9, None, ("python",), False, r"(?m)^\s*except\s*:"),
    Rule("bug.mutable-default-arg", "bug", "incorrect-state", "high", 0.95, None, ("python",), False, r"\bdef\s+\w+\s*\([^)]*=\s*(?:\[\s*\]|\{\s*\}|set\(\))"),
    Rule("bug.go-ignored-error", "bug", "error-handling", "medium", 0.85, None, ("go",), True, r"(?m)^\s*(?:\w+\s*,\s*)?_\s*:?=\s*\w[\w.]*\("),
    Rule("bug.non-null-assertion", "bug", "null-dereference", "medium", 0.6, None, ("typescript", "tsx"), True, r"[\w\])]!\.\w"),
    Rule("bug.floating-promise", "bug", "async-misuse", "medium", 0.6, None, JS, True, r"(?m)^\s*(?!return\b|await\b|void\b)[\w.]+\.(?:save|sendMail|sendEmail|publish|enqueue)\([^;\n]*\);?\s*$"),
    Rule("perf.await-in-loop", "performance", "sequential-await", "medium", 0.8, None, JS, False, r"\b(?:for|while)\s*\([^\n]*\{[^{}]*?(?:\{[^{}]*\}[^{}]*?){0,3}\bawait\s"),
    Rule("perf.select-star", "performance", "unbounded-query", "medium", 0.7, None, ANY, False, r"(?i)[\"'`]\s*select\s+\*\s+from\b(?![^\"'`]*\blimit\b)"),
    Rule("perf.findmany-unbounded", "performance", "unbounded-query", "medium", 0.6, None, JS, True, r"\.findMany\s*\(\s*(?:\)|\{(?![^}]*\btake\b)[^}]*\}\s*\))"),
    Rule("perf.sync-fs-in-handler", "performance", "blocking-io", "medium", 0.75, None, JS, True, r"\b(?:access|append|copy|exists|mkdir|read|readdir|rename|rm|stat|unlink|write)(?:File)?Sync\s*\(", r"(?i)(?:^|/)(?:scripts?|bin|cli|config|tools?)/|\.config\."),
    Rule("perf.json-deep-clone", "performance", "inefficient-algorithm", "low", 0.85, None, JS, False, r"JSON\.parse\s*\(\s*JSON\.stringify\s*\("),
    Rule("perf.barrel-import", "performance", "bundle-size", "low", 0.8, None, JS, False, r"""import\s+(?:\w+|\*\s+as\s+\w+)\s+from\s+["'](?:lodash|moment|rxjs|@mui/material|@mui/icons-material|antd)["']"""),
    Rule("perf.react-effect-no-deps", "performance", "react-rerender", "medium", 0.85, None, ("tsx", "jsx", "typescript", "javascript"), False, r"(?s)\buseEffect\s*\(\s*(?:async\s*)?\(\)\s*=>\s*\{(?:(?!useEffect).){0,600}?\n?\s*\}\s*\)\s*;?"),
    Rule("quality.todo-marker", "quality", "unfinished-work", "info", 1.0, None, ANY, True, r"(?<!\w)(?:TODO|FIXME|HACK|XXX)(?:\([^()\n]{1,40}\))?(?=[-:\s]|$)"),
    Rule("quality.console-log", "quality", "debug-output", "info", 0.9, None, JS, True, r"\bconsole\.(?:log|debug)\s*\("),
]

#: Secret formats: id, label, severity, pattern whose first group (or all) is the secret.
SECRETS: list[tuple[str, str, str, str]] = [
    ("secret.aws-access-key", "cloud access key id", "critical", r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b"),
    ("secret.github-token", "code host token", "critical", r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b"),
    ("secret.private-key", "private key", "critical", r"(-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----)"),
    ("secret.slack-token", "chat token", "high", r"\b(xox[abprs]-[A-Za-z0-9-]{10,})\b"),
    ("secret.stripe-key", "payment key", "critical", r"\b([rs]k_live_[A-Za-z0-9]{16,})\b"),
    ("secret.database-url", "database URL with password", "high", r"\b((?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s:@/\"']+:[^\s@/\"']{3,}@[^\s\"']+)"),
    ("secret.generic", "assigned secret", "medium", r"""(?i)\b[\w-]*(?:secret|token|passw(?:or)?d|api[-_]?key)[\w-]*["']?\s*[:=]\s*["']([^\s"']{12,})["']"""),
]

#: What makes a found secret a placeholder or a reference.
NOT_SECRET = r"(?i)^(?:.*(?:your|example|changeme|placeholder|dummy|sample|xxxx|\*{3,}|<[^>]*>|\$\{).*|(?:process\.env|os\.environ|env\.).*)$"
