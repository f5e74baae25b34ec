"""Structural checks: calls, chains, literals and scopes of script files, over their tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.functions import storage, text
from siltstone.operators import tokens
from siltstone.operators.code import scripts

# What is looked for, and severity, category and title of what is found.
SPAWNERS = ["exec", "execSync", "spawn", "spawnSync", "execFile", "execFileSync", "fork"]
SENSITIVE_PATHS = ["/etc/passwd", "/etc/shadow", "~/.ssh", "~/.aws", "~/.npmrc", ".env", ".git/config", "/etc/hosts"]
ENV_NETWORK = ["fetch(", "http.request", "https.request", "XMLHttpRequest", "axios", ".post(", "request("]
ENCODED_NETWORK = ["fetch(", "http.request", "https.request", "request("]
VM_CALLS = ["vm.runInNewContext", "vm.createScript", "vm.runInThisContext"]
DEEP_CALLS, LEAST_CHARS, SHOWN = 5, 4, 120
FOUND = {
    "eval": ("Critical", "CodeExecution", "Dynamic eval() detected (AST-verified)"),
    "function": ("Critical", "CodeExecution", "new Function() with dynamic arguments (AST-verified)"),
    "spawn": ("Critical", "ProcessSpawn", "child_process.%s() call chain (AST-verified)"),
    "import": ("Critical", "ProcessSpawn", "Dynamic import('child_process') (AST-verified)"),
    "read": ("High", "FileSystemAccess", "Read of sensitive file path (AST-verified)"),
    "env": ("High", "EnvAccess", "process.env access with network call in same scope (AST-verified)"),
    "encoded": ("High", "NetworkAccess", "Base64 encode then exfiltrate pattern (AST-verified)"),
    "deep": ("High", "Obfuscation", "Deeply nested function calls (%s levels, AST-verified)"),
    "computed": ("High", "Obfuscation", "Computed array index used as function call (AST-verified)"),
    "chars": ("High", "Obfuscation", "Single-char string concatenation (%s chars, AST-verified)"),
    "binding": ("Medium", "Suspicious", "process.binding() call (AST-verified)"),
    "vm": ("Medium", "CodeExecution", "VM code execution API (AST-verified)"),
    "intercept": ("Medium", "Suspicious", "%s used to intercept module loading (AST-verified)"),
}
#: What a finding of each check means.
MEANING = {
    "eval": "Text that isn't a literal is run as code",
    "function": "A function is made from text that isn't a literal",
    "spawn": "A command is started through child_process without a name for it",
    "import": "child_process is loaded while the code runs",
    "read": "A file that holds accounts or keys is read: ",
    "env": "A function reads the environment and calls the network",
    "encoded": "A scope encodes data as base64 and calls the network",
    "deep": "Results of calls are called again and again, as packed code does",
    "computed": "What is called is picked from an array by a number or an expression",
    "chars": "A text is put together from single characters",
    "binding": "Internals of the runtime are asked for",
    "vm": "Code is compiled and run by the vm module",
    "intercept": "Loading of modules may be intercepted",
}
#: Files without any of these can have no finding, so they aren't split.
MARKS = r"\beval\b|Function|child_process|readFile|process|toString|vm\.|Proxy|Reflect|\)\s*\(|\]\s*\(|['\"].['\"]\s*\+"


def _any(t: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (t.contains(p) for p in parts))


def _site(df: DataFrame, check: str, line: str, word: Column | None, *cuts: tuple[str | Column, str | Column]) -> DataFrame:
    """(f, check, line, word, cuts): something to be judged by texts, of which the first is shown."""
    at = lambda x: F.col(x) if isinstance(x, str) else x
    spans = F.array(*(F.struct(at(a).cast("int").alias("a"), at(b).cast("int").alias("b")) for a, b in cuts))
    return df.select("f", F.lit(check).alias("check"), F.col(line).alias("line"), (F.lit(None) if word is None else word).cast("string").alias("word"), spans.alias("cuts"))


def _of_calls(found: DataFrame) -> list[DataFrame]:
    """Checks of one call at a time."""
    string = F.coalesce((F.col("first.kind") == "s") & (F.col("first.then").isNull() | (F.col("first.then") == ",")), F.lit(False))
    member = F.coalesce(F.col("sign").isin(".", "?."), F.lit(False))
    bare = (F.col("nth_call") == 1) & ~member & (F.col("head") == F.col("name"))
    call = found.where(~F.col("made"))
    whole, callee = ("start", "end"), ("start", "open")
    return [
        _site(call.where(bare & (F.col("name") == "eval") & ~string), "eval", "open_line", None, whole),
        _site(found.where(F.col("made") & bare & (F.col("name") == "Function") & F.col("loose")), "function", "line", None, ("new_off", "end")),
        _site(call.where(member & F.col("name").isin(*SPAWNERS)), "spawn", "line", F.col("name"), whole, ("start", "sign_off")),
        _site(call.where(bare & (F.col("name") == "import")), "import", "line", None, whole),
        _site(call.where(string), "read", "line", None, whole, callee, ("first.off", "first.end")),
        _site(call.where(F.col("deep") > DEEP_CALLS), "deep", "line", F.col("deep"), whole),
        _site(call.where(member), "binding", "line", None, whole, callee),
        _site(call.where(member), "vm", "line", None, whole, callee),
    ]


def _of_scopes(rows: DataFrame, found: DataFrame) -> list[DataFrame]:
    """Checks of what stands near network calls: the nearest function around it, or for encoded data the file without one."""
    env = rows.where("not m and t = 'env' and p1 = '.' and p2 = 'process' and chain.off = o2").select("f", F.col("o2").alias("at"), F.col("chain.line").alias("line"), "end")
    encoded = found.where(~F.col("made") & F.col("sign").isin(".", "?."))
    around = tokens.ancestors(tokens.functions(rows).select("f", "start", "end", F.lit("F").alias("kind"), F.lit(0).alias("rank")), env.select("f", "at").unionByName(encoded.select("f", F.col("start").alias("at"))))
    nearest = around.select("f", "at", F.get("around", F.size("around") - 1).alias("scope"))
    of_env = env.join(nearest, ["f", "at"]).where("scope is not null")
    of_encoded = encoded.withColumn("at", F.col("start")).join(nearest, ["f", "at"])
    begin, stop = F.coalesce(F.col("scope.start"), F.lit(0)), F.coalesce(F.col("scope.end"), F.lit(tokens.MOST_BYTES))
    return [
        _site(of_env, "env", "line", None, ("at", "end"), (begin, stop)),
        _site(of_encoded, "encoded", "line", None, ("start", "end"), ("start", "open"), ("start", "sign_off"), (begin, stop)),
    ]


def _of_values(rows: DataFrame) -> list[DataFrame]:
    """Checks of indices, sums of characters and members of Proxy and Reflect."""
    t, kind = F.col("t"), F.col("kind")
    # An index is judged by what its brackets hold, which the row inside them knows.
    inside = Window.partitionBy("f", "level", "par.i")
    told = rows.select(
        "f", "i", "m", "t", "joins", "chain", "next",
        F.sum((~F.col("m")).cast("int")).over(inside).alias("n"),
        F.max((~F.col("m") & t.isin(*tokens.BINARY) & F.col("p1").isNotNull())).over(inside).alias("binary"),
        F.max((~F.col("m") & t.isin("?", "=", "=>", ","))).over(inside).alias("other"),
    )
    called = F.when(~F.col("m") & (t == "[") & F.col("joins") & (F.col("next.t") == "(") & (F.col("chain.before") != "new"), F.struct(F.col("chain.off").alias("start"), F.col("chain.line").alias("line"), F.col("next.end").alias("end")))
    index = F.when(F.col("m") & ~F.col("other"), ((F.col("n") == 1) & (F.col("next.kind") == "n")) | F.col("binary") | F.col("next.t").isin(*tokens.UNARY))
    both = told.groupBy("f", "i").agg(F.max(called).alias("c"), F.max(index).alias("index")).where("c is not null and index").select("f", "c.*")
    # Sums of characters: each goes on from the one two places before.
    here = Window.partitionBy("f", "level").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    char = lambda c: F.coalesce(c.rlike("^(['\"])[^'\"]['\"]$"), F.lit(False))
    single = (kind == "s") & char(t)
    goes_on = single & F.coalesce((F.col("p1") == "+") & char(F.col("p2")), F.lit(False))
    starts = single & ~goes_on
    counted = rows.where("not m").select("f", "i", "level", "end", "next", single.alias("single"), F.sum(single.cast("int")).over(here).alias("singles"), F.last(F.when(starts, F.struct("off", "line", F.coalesce("p1", F.lit("")).alias("before"))), ignorenulls=True).over(here).alias("first"), starts.alias("starts"))
    summed = counted.select("*", (F.col("singles") - F.last(F.when(F.col("starts"), F.col("singles")), ignorenulls=True).over(here) + 1).alias("count"))
    sums = summed.where("single").where((F.col("count") >= LEAST_CHARS) & ~F.col("first.before").isin("+", "-", "*", "/", "%", "**") & ~F.coalesce(F.col("next.t"), F.lit("")).isin(".", "?.", "[", "(", "*", "/", "%", "**"))
    # Members: what their parent is decides on the text that is looked at.
    members = rows.where(F.col("p1").isin(".", "?.") & F.col("p2").isin("Proxy", "Reflect") & (F.col("chain.off") == F.col("o2")))
    argument = F.col("par.t").eqNullSafe("(") & F.coalesce(F.col("p3").isNull() | (F.col("p3") == ","), F.lit(True)) & F.coalesce(F.col("next.t").isNull() | (F.col("next.t") == ","), F.lit(True))
    a, b = F.when(argument, F.col("par.off")).otherwise(F.col("o2")), F.when(argument, F.col("par.end")).otherwise(F.coalesce(F.col("next.end"), F.col("end")))
    return [
        _site(both, "computed", "line", None, ("start", "end")),
        _site(sums.select("*", "first.off", "first.line"), "chars", "line", F.col("count"), ("off", "end")),
        _site(members, "intercept", "line", F.col("p2"), (a, b)),
    ]


def _holds() -> Column:
    """Whether a site's texts make it a finding."""
    check, t = F.col("check"), lambda k: F.get("texts", F.lit(k))
    module = t(1).contains("child_process") & (t(1).contains("require") | t(1).contains("import"))
    return (
        F.when(check == "spawn", module)
        .when(check == "import", t(0).contains("child_process"))
        .when(check == "read", t(1).contains("readFile") & _any(t(2), SENSITIVE_PATHS))
        .when(check == "binding", t(1).contains("process.binding"))
        .when(check == "vm", _any(t(1), VM_CALLS))
        .when(check == "env", _any(t(1), ENV_NETWORK))
        .when(check == "encoded", t(1).contains("toString") & t(2).contains("Buffer.from") & t(0).contains("base64") & _any(t(3), ENCODED_NETWORK))
        .when(check == "intercept", t(0).contains("require") | t(0).contains("import"))
        .otherwise(F.lit(True))
    )


def syntax(files: DataFrame) -> DataFrame:
    """Structural findings of scripts of at most 1 MiB. Calls, chains and scopes may span lines."""
    small = scripts(files, "js|cjs|mjs|ts|tsx").where((F.octet_length("content") <= tokens.MOST_BYTES) & F.col("content").rlike(MARKS))
    rows = storage.stored(tokens.units(small), "tokens")
    found = tokens.calls(rows)
    sites = reduce(DataFrame.unionByName, [*_of_calls(found), *_of_scopes(rows, found), *_of_values(rows)])
    judged = tokens.texts(rows, sites).where(_holds())
    check = F.col("check")
    value = lambda k: schema._case(check, [(c, v[k]) for c, v in FOUND.items()])
    title = F.replace(value(2), F.lit("%s"), F.coalesce("word", F.lit("")))
    path = reduce(lambda rest, p: F.when(F.get("texts", F.lit(2)).contains(p), F.lit(p)).otherwise(rest), reversed(SENSITIVE_PATHS), F.lit(""))
    about = F.concat(schema._case(check, list(MEANING.items())), F.when(check == "read", path).otherwise(F.lit("")))
    order = schema._case(check, [(c, k) for k, c in enumerate(FOUND)])
    seq = F.get("cuts", F.lit(0))["a"].cast("long") * 100 + order
    return schema.findings(judged, "syntax", value(0), value(1), title, about, F.col("path"), F.col("line"), text.truncate(F.get("texts", F.lit(0)), SHOWN), seq)
