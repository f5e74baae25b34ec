"""Data flow: values from the environment, from files with secrets and from the network, followed to calls that use them.

Statements, declarators, assignments and functions are intervals of tokens (``tokens``). A scope is a function's
body or the file. Statements belong to every scope around them up to the next statement around them, so a
declared function's statements count in its own scope and in the scopes that it is declared in. A definition
is tainted if its value is a source, or if its text holds the name of a variable that was tainted before it in
its scope. That closure is a semi-naive fixpoint: each round joins the facts that the last round found with the
uses of their names, and an anti join keeps what is new; it takes as many rounds as the longest chain of
variables. Kinds come down the chains by pointer doubling.

Names are found in texts by their last GRAM characters, in an equi-join with the texts' own n-grams. What was
tainted before an offset is the last row before it in a window over a name's facts and uses. Nothing is
compared in pairs.

Defined cases: taint isn't cleared; a later definition changes a variable's kind. Of several tainted names in a
text the one equal to it counts, or else the one that was tainted first. A call is examined once for each
statement around it and each of that statement's scopes, and the right side of an assignment twice, so findings
repeat as often. A call whose result is called at once is not examined. Null contents and repeated rows are as
``tokens`` has them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.functions import storage, text
from siltstone.operators import tokens
from siltstone.operators.code import scripts

# What makes a source or a sink, and severity and title of what is found.
SENSITIVE = [".npmrc", ".ssh", ".aws", ".env", ".netrc", ".git/config", "/etc/passwd", "/etc/shadow", "credentials", ".gnupg"]
NETWORK_TEXT = ["http.get(", "http.request(", "https.get(", "https.request(", "axios(", "axios.get(", "axios.post(", "got(", "got.get(", "request(", "XMLHttpRequest"]
NETWORK_CALLEE = ["http.get", "http.request", "https.get", "https.request", "axios", "got"]
NETWORK_ENDS = [".get", ".post", ".put", ".request"]
EXEC_CALLEE = ["exec(", "execSync", "spawn", "execFile"]
FOUND = {
    "env": ("Critical", "Data exfiltration: process.env sent over network"),
    "credentials": ("Critical", "Credential theft: sensitive file sent over network"),
    "url": ("Critical", "Data exfiltration: tainted data in network URL"),
    "eval": ("Critical", "Tainted data passed to eval/Function"),
    "command": ("Critical", "Tainted data passed to child_process execution"),
    "exec": ("High", "Tainted data passed to child_process execution"),
    "dropper": ("High", "Dropper: network data written to file"),
    "near": ("High", "Credential data used near network context"),
}
#: What a finding of each kind means.
MEANING = {
    "env": "Variables of the environment leave over the network",
    "credentials": "A file with keys or accounts leaves over the network",
    "url": "Data from the environment or a secret file is part of a request",
    "eval": "Data from outside is run as code",
    "command": "Data from the network becomes a command",
    "exec": "Data from outside becomes a command",
    "dropper": "Data from the network is written to a file",
    "near": "A secret file's data stands next to a network call",
}
#: Names are looked up by so many last characters.
GRAM = 4
#: Files without a source can have no finding.
MARKS = r"process\.env|child_process|readFile|fetch|http|axios|got|request|XMLHttpRequest"
#: A function's place among intervals that start together: after all statements.
_INNER = 1 << 30
_WIDE = 1 << 21


def _any(t: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (t.contains(p) for p in parts))


def _network_text(t: Column) -> Column:
    return t.startswith("fetch(") | t.startswith("fetch (") | _any(t, NETWORK_TEXT)


def source(t: Column) -> Column:
    """The kind of source that a value's text is, or null."""
    waited = F.regexp_replace(t, r"^(await\s+)+", "")
    return (
        F.when(t.contains("process.env"), "EnvData")
        .when(t.contains("child_process") & (t.contains("require") | t.contains("import")), "ProcessHandle")
        .when(t.contains("readFile") & _any(t, SENSITIVE), "Credentials")
        .when(_network_text(t) | _network_text(waited), "NetworkData")
    )


def _span(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))


def _key(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.cast("long") * _WIDE + b.cast("long")


def statements(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declarations and expressions (f, start, end, stop, line, kind, rank), and definitions (f, at, name_to, from, to)."""
    t = F.col("t")
    inside = rows.where("not m and ctx = 'b'")
    plain = inside.where("not (kind = 'p' and t = ';')")
    words = ["const", "let", "var"]
    heads = F.array_sort(F.collect_list(F.when(~F.col("joins"), F.struct("i", "t", "off", "end"))))
    closing = (F.col("kind") == "p") & (t == ";")
    whole = inside.groupBy("f", "level", "statement").agg(
        F.min(F.when(~closing, F.struct("i", "off", "line", "t", "kind", F.col("next.t").alias("next")))).alias("first"),
        F.max(F.when(~closing, F.col("end"))).alias("end"),
        F.max("end").alias("stop"),
        F.max(t == ",").alias("comma"),
        heads.alias("heads"),
    )
    first, second = F.col("first"), F.get("heads", F.lit(1))
    declares = first["t"].isin(*words) | ((first["t"] == "export") & first["next"].isin(*words))
    called = (first["t"] == "import") & F.coalesce(first["next"] == "(", F.lit(False))
    other = (first["t"].isin(*tokens.OTHER) & ~called) | ((first["t"] == "{") & (first["kind"] == "p")) | ((first["t"] == "async") & F.coalesce(first["next"] == "function", F.lit(False)))
    assigns = F.coalesce((second["t"] == "=") & ~F.col("comma"), F.lit(False))
    kind = F.when(declares, "D").when(other, None).when(assigns, "A").otherwise("E")
    known = whole.withColumn("kind", kind).where("kind is not null and first is not null").select("f", "level", "statement", first["off"].alias("start"), "end", "stop", first["line"].alias("line"), "kind", F.when(kind == "A", second["off"]).alias("name_to"), F.when(kind == "A", second["end"]).alias("from"))
    parts = plain.join(known.where("kind = 'D'").select("f", "level", "statement"), ["f", "level", "statement"], "left_semi")
    named = parts.where(~t.isin("export", ",", *words)).groupBy("f", "level", "statement", "part").agg(F.min("off").alias("at"), F.max("end").alias("to"), F.min(F.when((t == "=") & (F.col("kind") == "p"), F.struct("off", "end"))).alias("eq"))
    declared = named.where("eq is not null").select("f", "at", F.col("eq.off").alias("name_to"), F.col("eq.end").alias("from"), "to")
    assigned = known.where("kind = 'A'").select("f", F.col("start").alias("at"), "name_to", "from", F.col("end").alias("to"))
    return known.select("f", "start", "end", "stop", "line", "kind", F.coalesce("from", F.lit(0)).alias("rank")), declared.unionByName(assigned)


def _scopes(around: Column, at: Column) -> Column:
    """The scopes of the statement at a place (from 1) of what is around something."""
    before = F.slice(around, 1, at - 1)
    last = F.coalesce(F.array_max(F.transform(before, lambda x, i: F.when(x["kind"] != "F", i + 1).otherwise(0))), F.lit(0))
    inner = F.transform(F.slice(before, last + 1, F.size(before) - last), lambda x: _key(x["start"], x["end"]))
    return F.when(last == 0, F.concat(F.array(F.lit(-1).cast("long")), inner)).otherwise(inner)


def _examined(sites: DataFrame) -> DataFrame:
    """``sites`` (f, at, around, ...) once for each statement around them, each of its scopes, and each time that
    it is looked at there: only definitions before ``limit`` count."""
    around = F.col("around")
    looks = lambda x: F.when(x["kind"] == "D", F.array(F.col("at"))).when((x["kind"] == "A") & (F.col("at") >= x["rank"]), F.array(x["start"], x["start"] + 1)).otherwise(F.array(x["start"]))
    each = F.flatten(F.transform(around, lambda x, i: F.when(x["kind"] == "F", F.array().cast("array<struct<scope:bigint,limit:int>>")).otherwise(F.flatten(F.transform(_scopes(around, i + 1), lambda s: F.transform(looks(x), lambda y: F.struct(s.alias("scope"), y.cast("int").alias("limit"))))))))
    return sites.withColumn("x", F.explode(each)).select(*[c for c in sites.columns if c != "around"], "x.scope", "x.limit")


def _held(spans: DataFrame, names: DataFrame) -> DataFrame:
    """(f, tid, name, exact): which of a file's variable names each of its texts (f, tid, text) holds."""
    size = F.length("text")
    of_size = lambda k: F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(F.col("text"), i, F.lit(k)))
    grams = F.array_distinct(F.flatten(F.array(*map(of_size, range(1, GRAM + 1)))))
    each = spans.where(size > 0).select("f", "tid", F.explode(grams).alias("key"))
    near = each.join(names.select("f", "name", F.right("name", F.lit(GRAM)).alias("key")), ["f", "key"]).groupBy("f", "tid").agg(F.collect_set("name").alias("names"))
    found = spans.join(near, ["f", "tid"])
    return found.select("f", "tid", F.explode(F.filter("names", lambda n: F.contains(F.col("text"), n))).alias("name"), "text").select("f", "tid", "name", (F.col("name") == F.col("text")).alias("exact"))


def _before(asked: DataFrame, held: DataFrame, facts: DataFrame) -> DataFrame:
    """For each (f, scope, limit, tid) the fact that counts: (..., since, name), where since is the offset of the
    tainted name's latest fact before the limit."""
    key = ["f", "scope", "name"]
    uses = asked.select("f", "scope", "limit", "tid").distinct().join(held, ["f", "tid"]).select(*key, F.col("limit").alias("pos"), F.lit(0).alias("step"), "tid", "exact")
    both = uses.unionByName(facts.select(*key, "pos", F.lit(1).alias("step")), allowMissingColumns=True)
    order = Window.partitionBy(*key).orderBy("pos", "step").rowsBetween(Window.unboundedPreceding, 0)
    fact = F.when(F.col("step") == 1, F.col("pos"))
    seen = both.select("*", F.min(fact).over(order).alias("first"), F.max(fact).over(order).alias("since")).where("step = 0 and since is not null")
    best = F.min_by(F.struct("since", "name"), F.struct(~F.col("exact"), "first", "name"))
    return seen.groupBy("f", "scope", F.col("pos").alias("limit"), "tid").agg(best.alias("b")).select("f", "scope", "limit", "tid", "b.since", "b.name")


def _tainted(defs: DataFrame, held: DataFrame) -> DataFrame:
    """Facts (f, scope, pos, name, kind) from definitions (f, scope, pos, name, kind or null, tid)."""
    known = storage.stored(defs.where("kind is not null").select("f", "scope", "pos", "name", "kind"), "sources")
    edges = storage.stored(defs.where("kind is null").join(held.withColumnRenamed("name", "via"), ["f", "tid"]).select("f", "scope", "pos", "name", "via", "tid"), "edges")
    facts, latest = known.select("f", "scope", "pos", "name"), known
    while True:
        since = latest.groupBy("f", "scope", F.col("name").alias("via")).agg(F.min("pos").alias("since"))
        reached = edges.join(since, ["f", "scope", "via"]).where("since < pos").select("f", "scope", "pos", "name").distinct()
        latest = storage.stored(reached.join(facts, ["f", "scope", "pos", "name"], "left_anti"), "facts")
        if latest.isEmpty():
            break
        facts = facts.unionByName(latest)
    passed = facts.join(edges, ["f", "scope", "pos", "name"]).select("f", "scope", F.col("pos").alias("limit"), "tid", F.col("name").alias("target")).distinct()
    chosen = _before(passed, held, facts).join(passed, ["f", "scope", "limit", "tid"])
    above = chosen.select("f", "scope", F.col("limit").alias("pos"), F.col("target").alias("name"), F.col("since").alias("up"), F.col("name").alias("up_name"))
    open_ = storage.stored(above, "above")
    while not open_.isEmpty():  # each round, a fact's parent becomes its parent's parent
        ends = known.select("f", "scope", F.col("pos").alias("up"), F.col("name").alias("up_name"), "kind")
        ups = open_.select("f", "scope", F.col("pos").alias("up"), F.col("name").alias("up_name"), F.col("up").alias("up2"), F.col("up_name").alias("up_name2"))
        key = ["f", "scope", "up", "up_name"]
        stepped = storage.stored(open_.join(ends, key, "left").join(ups, key, "left").select("f", "scope", "pos", "name", "kind", F.coalesce("up2", "up").alias("up"), F.coalesce("up_name2", "up_name").alias("up_name")), "steps")
        known = known.unionByName(stepped.where("kind is not null").select(*known.columns))
        open_ = stepped.where("kind is null").drop("kind")
    return known


def dataflow(files: DataFrame) -> DataFrame:
    """Flows from sources to sinks in scripts of at most 1 MiB."""
    small = scripts(files, "js|cjs|mjs").where((F.octet_length("content") <= tokens.MOST_BYTES) & F.col("content").rlike(MARKS))
    rows = storage.stored(tokens.units(small), "tokens")
    states, defined = statements(rows)
    states = storage.stored(states, "statements")
    whole = F.btrim(F.get("texts", F.lit(1)), F.lit(" \t\r\n"))
    values = tokens.texts(rows, defined.select("f", "at", _key("from", "to").alias("tid"), F.array(_span("at", "name_to"), _span("from", "to")).alias("cuts")))
    defs = storage.stored(values.select("f", "at", "tid", F.btrim(F.get("texts", F.lit(0)), F.lit(" \t\r\n")).alias("name"), whole.alias("text"), source(whole).alias("kind")).where("name != ''"), "definitions")

    calls = tokens.calls(rows).where("not made and not coalesce(next = '(', false)")
    cuts = F.array(_span("start", "end"), _span("start", "open"), _span("open", "end"))
    said = tokens.texts(rows, calls.select("f", "start", "end", "open", "line", cuts.alias("cuts")))
    callee, call_text, args = F.btrim(F.get("texts", F.lit(1)), F.lit(" \t\r\n")), F.get("texts", F.lit(0)), F.get("texts", F.lit(2))
    ends = reduce(lambda a, b: a | b, (callee.endswith(e) for e in NETWORK_ENDS))
    sinks = F.struct(
        (callee.isin("fetch", "request") | ends | _any(callee, NETWORK_CALLEE)).alias("network"),
        callee.isin("eval", "Function").alias("eval"),
        (callee.isin("exec") | _any(callee, EXEC_CALLEE)).alias("exec"),
        callee.contains("writeFile").alias("write"),
    )
    sites = storage.stored(said.select("f", "package", "version", "path", F.col("start").alias("at"), "line", sinks.alias("sink"), call_text.alias("text"), args.alias("args"), _key("start", "end").alias("tid"), _key("open", "end").alias("args_tid")).where("sink.network or sink.eval or sink.exec or sink.write"), "sinks")
    nested = tokens.texts(rows, states.where("kind != 'D'").select("f", "start", "stop", "line", F.array(_span("start", "stop")).alias("cuts")))
    near = storage.stored(nested.select("f", "package", "version", "path", F.col("start").alias("at"), "line", F.get("texts", F.lit(0)).alias("text"), _key("start", "stop").alias("tid")).where(_network_text(F.col("text"))), "near")

    intervals = states.select("f", "start", "end", "kind", "rank").unionByName(tokens.functions(rows).select("f", "start", "end", F.lit("F").alias("kind"), F.lit(_INNER).alias("rank")))
    around = storage.stored(tokens.ancestors(intervals, defs.select("f", "at").unionByName(sites.select("f", "at")).unionByName(near.select("f", "at"))), "around")
    placed = defs.join(around, ["f", "at"]).select("*", F.explode(_scopes(F.col("around"), F.size("around"))).alias("scope"))
    by_call = storage.stored(_examined(sites.join(around, ["f", "at"])), "examined")
    outside = F.slice(F.col("around"), 1, F.size("around") - 1)
    by_statement = storage.stored(_examined(near.join(around, ["f", "at"]).withColumn("around", outside)), "examined-near")

    asked = reduce(DataFrame.unionByName, [defs.select("f", "tid", "text"), sites.select("f", "tid", "text"), sites.select("f", F.col("args_tid").alias("tid"), F.col("args").alias("text")), near.select("f", "tid", "text")])
    held = storage.stored(_held(asked.dropDuplicates(["f", "tid"]), defs.select("f", "name").distinct()), "held")
    facts = _tainted(placed.select("f", "scope", F.col("at").alias("pos"), "name", "kind", "tid"), held)
    facts = storage.stored(facts, "tainted")

    questions = reduce(DataFrame.unionByName, [by_call.select("f", "scope", "limit", "tid"), by_call.select("f", "scope", "limit", F.col("args_tid").alias("tid")), by_statement.select("f", "scope", "limit", "tid")])
    told = _before(questions, held, facts).join(facts.select("f", "scope", F.col("pos").alias("since"), "name", "kind"), ["f", "scope", "since", "name"]).select("f", "scope", "limit", "tid", "kind")
    told = storage.stored(told, "told")
    of_args = told.select("f", "scope", "limit", F.col("tid").alias("args_tid"), F.col("kind").alias("by_args"))
    judged = by_call.join(of_args, ["f", "scope", "limit", "args_tid"], "left").join(told, ["f", "scope", "limit", "tid"], "left")
    by_args, by_text, sink = F.col("by_args"), F.col("kind"), F.col("sink")
    rule = F.array_compact(
        F.array(
            F.when(sink["network"], F.when(by_args == "EnvData", "env").when(by_args == "Credentials", "credentials").when(by_args.isNull() & by_text.isin("EnvData", "Credentials"), "url")),
            F.when(sink["eval"] & by_args.isNotNull(), "eval"),
            F.when(sink["exec"] & by_args.isNotNull(), F.when(by_args == "NetworkData", "command").otherwise("exec")),
            F.when(sink["write"] & (by_args == "NetworkData"), "dropper"),
        )
    )
    shown = ["package", "version", "path", "at", "line", "text", "kind"]
    calls_found = judged.withColumn("kind", F.coalesce("by_args", "kind")).select(*shown, F.explode(rule).alias("rule"))
    near_found = by_statement.join(told, ["f", "scope", "limit", "tid"]).where("kind = 'Credentials'").select(*shown, F.lit("near").alias("rule"))
    found = calls_found.unionByName(near_found)
    value = lambda k: schema._case("rule", [(r, v[k]) for r, v in FOUND.items()])
    about = F.concat(schema._case("rule", list(MEANING.items())), F.lit(" ("), "kind", F.lit(")"))
    return schema.findings(found, "dataflow", value(0), "DataFlow", value(1), about, F.col("path"), F.col("line"), text.truncate(F.col("text"), 120), F.col("at"))
