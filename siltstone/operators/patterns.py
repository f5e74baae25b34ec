"""Patterns, titles and rules that results must share with other scanners."""

#: Patterns over code lines: severity, category, pattern, title.
STATIC = [
    ("Critical", "CodeExecution", r"""eval\s*\([^"'][^)]*\)""", "Dynamic eval() detected"),
    ("Critical", "CodeExecution", r"(?i)new\s+Function\s*\(", "Function constructor with dynamic string"),
    ("Critical", "Obfuscation", r"Buffer\.from\s*\(.*(?:eval|Function)", "Buffer.from + eval/Function obfuscation"),
    ("Critical", "ProcessSpawn", r"""child_process['")\]]\s*\.\s*(?:exec|execSync|spawn|spawnSync|execFile|fork)\s*\(""", "child_process exec/spawn call"),
    ("Critical", "ProcessSpawn", r"(?:curl|wget)\s+[^\|]*\|\s*(?:bash|sh)\b", "Pipe-to-shell pattern (curl|bash)"),
    ("High", "ProcessSpawn", r"""require\s*\(\s*['"]child_process['"]\s*\)""", "require('child_process')"),
    ("High", "ProcessSpawn", r"""import\s+.*from\s+['"]child_process['"]\s*""", "import from 'child_process'"),
    ("High", "EnvAccess", r"process\.env\b.*process\.env\b", "Environment variable harvesting"),
    ("High", "FileSystemAccess", r"""fs\.readFileSync\s*\(\s*['"](?:/etc/passwd|/etc/shadow|~/.ssh|~/.aws|~/.npmrc)""", "Sensitive file read"),
    ("High", "NetworkAccess", r"(?:net\.connect|dgram\.createSocket)\s*\(", "Raw network socket"),
    ("Medium", "NetworkAccess", r"""https?\.request\s*\(\s*['"]https?://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}""", "HTTP request to hardcoded IP"),
    ("Medium", "NetworkAccess", r"dns\.(?:lookup|resolve)\s*\(", "DNS lookup/resolve"),
    ("Medium", "FileSystemAccess", r"fs\.writeFileSync\s*\(", "Synchronous file write"),
    ("Medium", "NetworkAccess", r"new\s+WebSocket\s*\(", "WebSocket connection"),
    ("Medium", "Obfuscation", r"crypto\.createDecipher\s*\(", "Crypto decipher usage"),
    ("Low", "NetworkAccess", r"""fetch\s*\([^"'][^)]*\)""", "fetch() with dynamic URL"),
    ("Low", "NetworkAccess", r"XMLHttpRequest", "XMLHttpRequest usage"),
    ("Low", "FileSystemAccess", r"fs\.(?:readFileSync|readFile)\s*\(", "File read operation"),
]
#: Paths in which a pattern is expected: category, severity (None: any), parts, whether case counts.
EXPECTED = [
    ("EnvAccess", None, ("config", "env", "proxy", "defaults", "helpers", "utils", "settings"), False),
    ("NetworkAccess", "Low", ("adapters/", "transport/", "request", "http", "fetch", "xhr", "client"), False),
    ("FileSystemAccess", "Low", ("scripts/", "test/", "tests/", "__tests__/", "build/"), True),
]
LONG_HEX = r"[0-9a-fA-F]{50,}"
LONG_BASE64 = r"[A-Za-z0-9+/]{100,}={0,2}"
ESCAPES = r"(?:\\x[0-9a-fA-F]{2}){4,}|(?:\\u[0-9a-fA-F]{4}){4,}"
#: Patterns that are new in a version: severity, category, pattern, title.
NEWLY = [
    ("Critical", "CodeExecution", r"eval\s*\(", "New eval() usage added between versions"),
    ("Critical", "CodeExecution", r"(?i)new\s+Function\s*\(", "New Function() constructor added between versions"),
    ("Critical", "Obfuscation", r"Buffer\.from\s*\(.*(?:eval|Function)", "New Buffer.from+eval pattern added between versions"),
    ("Critical", "ProcessSpawn", r"child_process", "New child_process usage added between versions"),
    ("High", "NetworkAccess", r"https?\.request\s*\(", "New http.request() added between versions"),
    ("High", "NetworkAccess", r"\bfetch\s*\(", "New fetch() call added between versions"),
    ("High", "NetworkAccess", r"dns\.(?:lookup|resolve)\s*\(", "New DNS lookup added between versions"),
]
ESCAPE_RUN = r"\\x[0-9a-fA-F]{2}(?:\\x[0-9a-fA-F]{2}){7,}"
DANGEROUS_SCRIPT = r"(?:curl|wget|bash|sh\s+-c|node\s+-e|eval\s|https?://)"
SCRIPT_FILE = r"node\s+([^\s;&|]+\.(?:js|cjs|mjs))"
SAFE_SCRIPTS = ("husky", "husky install", "lint-staged", "patch-package", "ngcc", "prebuild-install", "node-gyp rebuild", "tsc", "tsc --build")

_BUILD = ("dist/", "build/", "esm/", "cjs/", "umd/")
#: Built-in rules: id, name, severity, category, pattern, file glob, excluded paths. The ids' prefix is ours.
RULES = [
    ("RULE-001", "Eval with encoded payload", "critical", "code_execution", r"eval\s*\(\s*(?:atob|Buffer\.from)\s*\(", "*.js", ("node_modules/", "*.min.js", *_BUILD)),
    ("RULE-002", "Function constructor abuse", "critical", "code_execution", r"new\s+Function\s*\(.*\+.*\)", "*.js", ("node_modules/", "*.min.js", *_BUILD)),
    ("RULE-003", "child_process with dynamic command", "critical", "process_spawn", r"""child_process['")\]]\s*\.\s*(?:exec|execSync|spawn|spawnSync|execFile|fork)\s*\(""", "*.js", ("node_modules/", "test/", *_BUILD)),
    ("RULE-004", "Remote script execution via curl/wget", "critical", "process_spawn", r"(?:curl|wget)\s+[^|]*\|\s*(?:sh|bash|node|python)", None, ("node_modules/", *_BUILD)),
    ("RULE-005", "Bulk environment variable access", "high", "env_access", r"(?:JSON\.stringify|Object\.(?:keys|values|entries))\s*\(\s*process\.env\s*\)", "*.js", ("node_modules/", "test/", *_BUILD)),
    ("RULE-006", "Reading sensitive home directory files", "high", "file_system_access", r"(?:readFile|readFileSync|createReadStream)\s*\([^)]*(?:\.ssh|_netrc|\.npmrc|\.bash_history|\.aws|\.gnupg)", "*.js", ("node_modules/", "test/", *_BUILD)),
    ("RULE-007", "Crypto mining indicators", "critical", "suspicious", r"(?:stratum\+tcp://|cryptonight|coinhive|minergate|xmrig|monero\.crypto-pool)", None, ("node_modules/", *_BUILD)),
    ("RULE-008", "Reverse shell pattern", "critical", "network_access", r"(?:net\.Socket|new\s+Socket).*(?:pipe|write).*(?:child_process|spawn|exec)|(?:child_process|spawn|exec).*(?:net\.Socket|new\s+Socket).*pipe", "*.js", ("node_modules/", "test/", *_BUILD)),
    ("RULE-009", "Data exfiltration pattern", "high", "network_access", r"(?:Buffer\.from|btoa|encodeURIComponent)\s*\([^)]*\).*(?:https?\.request|fetch|axios|got)\s*\(", "*.js", ("node_modules/", "test/", *_BUILD)),
    ("RULE-010", "Prototype pollution", "medium", "suspicious", r"__proto__\s*(?:\[|=)", "*.js", ("node_modules/", "test/", *_BUILD, "*.min.js")),
]
#: Texts of which a match of the pattern holds at least one; patterns without an entry may match anything.
NEEDED = {pattern: ("(",) for pattern in [p for _, _, p, _ in STATIC] + [p for _, _, _, _, p, _, _ in RULES]} | {
    STATIC[4][2]: ("|",),
    STATIC[6][2]: ("process",),
    STATIC[7][2]: ("process",),
    STATIC[16][2]: ("XMLHttpRequest",),
    RULES[3][4]: ("|",),
    RULES[6][4]: ("stratum+tcp://", "cryptonight", "coinhive", "minergate", "xmrig", "monero.crypto-pool"),
    RULES[7][4]: ("Socket",),
    RULES[9][4]: ("__proto__",),
}
#: Severity and category words of rule files; others mean Info and Suspicious.
RULE_SEVERITY = {"critical": "Critical", "high": "High", "medium": "Medium", "low": "Low", "info": "Info"}
RULE_CATEGORY = {"code_execution": "CodeExecution", "network_access": "NetworkAccess", "file_system_access": "FileSystemAccess", "filesystem_access": "FileSystemAccess", "process_spawn": "ProcessSpawn", "obfuscation": "Obfuscation", "install_script": "InstallScript", "env_access": "EnvAccess", "maintainer_change": "MaintainerChange", "dependency_risk": "DependencyRisk"}

#: Popular packages, in the order in which names are compared with them.
TOP_PACKAGES = "react express lodash axios chalk commander debug dotenv fs-extra glob inquirer jest moment mongoose next nodemon prettier socket.io typescript uuid webpack yargs bluebird body-parser cheerio cors dayjs eslint fastify helmet jsonwebtoken knex luxon marked mysql2 nanoid passport pg pino ramda redis rimraf rxjs semver sequelize sharp underscore validator vue zod".split()
#: Generic fragments of names that language models invent.
FRAGMENTS = "utils-helper data-processor string-formatter json-utils file-helper array-utils object-helper math-helper date-utils config-helper log-helper http-helper api-helper parse-helper format-helper convert-helper validate-helper transform-utils common-utils simple-utils".split()
#: Real packages whose names are near to popular ones.
LEGITIMATE = "preact reakt rax inferno mithril chokidar chalk-cli expressjs koa hapi fastify restify micro polka morgan cors helmet pino-pretty".split()
