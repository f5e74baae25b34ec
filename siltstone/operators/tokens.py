"""Script files as nested sets of tokens.

One regular expression splits a file into tokens. Running sums give each its offset, line and depth
of brackets, and windows over (depth, place) give each bracket its partner and each token its
neighbours inside the same brackets. So calls, arguments, statements and functions are intervals of
offsets, and what encloses what follows from their order. There is no grammar: what a bracket or a
line feed means is told from its neighbours. All windows are over one file, and a file has at most
MOST_BYTES; rows are dealt out by file once, and all steps use that.

Tokens hold short texts only. A file's content travels with its first row and meets the intervals
whose text is asked for at the end (``texts``).

Defined cases: a null content counts as empty; a repeated file row counts once; brackets without a
partner end where the file ends; code inside the ``${}`` of a template is text of the template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The size limit of the structural analyzers; a fixed value.
MOST_BYTES = 1_048_576
_SIGNS = r"=>|\.\.\.|\?\.(?!\d)|>>>=|<<=|>>=|>>>|\*\*=|&&=|\|\|=|\?\?=|[=!]==|[=!]=|<=|>=|&&|\|\||\?\?|\+\+|--|\*\*|<<|>>|[-+*/%&|^]="
#: A pattern literal stands where a value is due, which the sign or word before it tells.
_PATTERN = r"(?<=[=(,:;!&|?{}\[+\-*%<>~^\n]\s{0,8}|\breturn\s{1,4}|\A\s{0,8})/(?![*/])[^/\n]{1,200}+/[a-z]*+"
#: White space before a token belongs to it, so tokens cover the file. Escapes are masked beforehand.
TOKEN = rf"\s*+(?://[^\n]*+|/\*[\s\S]*?(?:\*/|\z)|\"[^\"\n]*+\"?|'[^'\n]*+'?|`[^`]*+`?|{_PATTERN}|[\p{{L}}_$#@][\p{{L}}\p{{N}}_$]*+|[0-9][\w.]*+|{_SIGNS}|\S)"
_WHITE = " \t\n\x0b\x0c\r"
CONTROL = ["if", "for", "while", "with", "switch", "catch"]
#: Words after which a value, not a call's arguments, follows.
PREFIX = ["return", "typeof", "await", "in", "of", "new", "delete", "void", "throw", "case", "do", "else", "yield", "instanceof", "const", "let", "var", "default", "export", "extends"]
#: Words that begin statements which are neither declarations nor expressions.
OTHER = ["return", "throw", "if", "for", "while", "do", "switch", "case", "default", "try", "catch", "finally", "else", "function", "class", "import", "export", "break", "continue", "with", "debugger"]
BINARY = ["+", "-", "*", "/", "%", "**", "&", "|", "^", "<<", ">>", ">>>", "&&", "||", "??", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "in", "instanceof"]
UNARY = ["-", "+", "~", "!", "typeof", "void", "delete"]
_KEY = ["package", "version", "path"]


def _split(files: DataFrame) -> DataFrame:
    """(f, i, raw; package, version, path, content with token 0, which is empty)."""
    content = F.coalesce("content", F.lit(""))
    masked = F.regexp_replace(F.regexp_replace(content, r"\\\n", "\x01\n"), r"\\[^\n]", "\x01\x01")
    raws = F.concat(F.array(F.lit("")), F.regexp_extract_all(masked, F.lit(TOKEN), F.lit(0)))
    f = F.unhex(F.md5(F.to_json(F.struct(*_KEY, content.alias("content")))))
    each = files.select(*_KEY, content.alias("content"), f.alias("f"), F.posexplode(raws).alias("i", "raw"))
    first = lambda c: F.when(F.col("i") == 0, F.col(c)).alias(c)
    return each.select("f", "i", "raw", *(first(c) for c in [*_KEY, "content"])).repartition("f").dropDuplicates(["f", "i"])


def _placed(split: DataFrame) -> DataFrame:
    """Tokens without comments, with offset, end, line, kind and short text ``t``.

    Kinds: w(ord), n(umber), s(tring), t(emplate), r (pattern), p(unctuation), f for the file itself.
    ``nl``: a line ended before it; ``a1``, ``a2``, ``a3``: the tokens before it."""
    order = Window.partitionBy("f").orderBy("i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    feeds = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    body = F.ltrim(F.col("raw"), F.lit(_WHITE))
    lead = F.length("raw") - F.length(body)
    off = F.coalesce(F.sum(F.length("raw")).over(before), F.lit(0)) + lead
    line = 1 + F.coalesce(F.sum(feeds(F.col("raw"))).over(before), F.lit(0)) + feeds(F.col("raw")) - feeds(body)
    rows = split.select("f", "i", *_KEY, "content", body.alias("body"), off.cast("int").alias("off"), (off + F.length(body)).cast("int").alias("end"), line.cast("int").alias("line"), (line + feeds(body)).cast("int").alias("last_line"))
    b = F.col("body")
    kind = (
        F.when(F.col("i") == 0, "f")
        .when(b.rlike(r"^(//|/\*)"), "c")
        .when(b.rlike("^[\"']"), "s")
        .when(b.startswith("`"), "t")
        .when(b.rlike(r"^/[^=]"), "r")
        .when(b.rlike("^[0-9]"), "n")
        .when(b.rlike(r"^[\p{L}_$#@]"), "w")
        .otherwise("p")
    )
    t = F.when(F.col("kind").isin("w", "p", "n"), F.left("body", F.lit(64))).when((F.col("kind") == "s") & (F.octet_length("body") == 3), F.col("body")).otherwise("")
    kept = rows.withColumn("kind", kind).where("kind != 'c'").withColumn("t", t)
    lags = [F.coalesce(F.lag("t", k).over(order), F.lit("")).alias(f"a{k}") for k in (1, 2, 3)]
    return kept.select("f", "i", *_KEY, "content", "off", "end", "line", "kind", "t", (F.col("line") > F.lag("last_line").over(order)).alias("nl"), *lags)


def _context(t: Column) -> Column:
    """What a bracket holds: b(lock of statements), c(lass body) or e(xpressions)."""
    a1, a2, a3 = F.col("a1"), F.col("a2"), F.col("a3")
    block = a1.isin(")", "=>", "else", "do", "try", "finally", "catch", ";", "{", "}", "") | ((a2 == ":") & (a3 == ")"))
    return F.when((t == "{") & ((a1 == "class") | a2.isin("class", "extends", "implements")), "c").when((t == "{") & block, "b").otherwise("e")


def units(files: DataFrame) -> DataFrame:
    """One row for each token but closing brackets, and one more (``m``) inside each opening bracket.

    ``level`` is the depth that the row is at; ``end`` of an opening bracket is after its partner.
    ``p1`` to ``p4`` are the neighbours before it, ``o1`` to ``o3`` their offsets; ``next`` is the one after. ``chain``: where the member chain
    that the row belongs to begins, as (i, off, line, t, kind, and the neighbour before). ``ctx`` is
    what the surrounding bracket holds, ``par`` and ``par_t`` that bracket. ``statement`` and ``part`` number what
    is between semicolons, and between these or commas."""
    placed = _placed(_split(files))
    t = F.col("t")
    delta = F.when(t.isin("(", "[", "{") & (F.col("kind") == "p"), 1).when(t.isin(")", "]", "}") & (F.col("kind") == "p"), -1).otherwise(0)
    by_place = Window.partitionBy("f").orderBy("i")
    rows = placed.withColumn("delta", delta).withColumn("level", F.sum("delta").over(by_place) - F.greatest("delta", F.lit(0)))
    by_level = Window.partitionBy("f", "level").orderBy("i")
    size = F.max("end").over(Window.partitionBy("f"))
    partner = F.when(F.lead("delta").over(by_level) == -1, F.lead("end").over(by_level)).otherwise(size)
    paired = rows.withColumn("end", F.when(F.col("delta") == 1, partner).when(F.col("kind") == "f", size).otherwise(F.col("end"))).where("delta >= 0").withColumn("own_ctx", _context(t))
    both = F.when(F.col("delta") == 1, F.array(F.struct(F.col("level").alias("at"), F.lit(False).alias("m")), F.struct((F.col("level") + 1).alias("at"), F.lit(True).alias("m")))).otherwise(F.array(F.struct(F.col("level").alias("at"), (F.col("kind") == "f").alias("m"))))
    spread = paired.withColumn("x", F.explode(both)).withColumn("level", F.col("x.at")).withColumn("m", F.col("x.m")).drop("x", "delta")

    m = F.col("m")
    here = Window.partitionBy("f", "level").orderBy("i")
    running = here.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda cond, value: F.last(F.when(cond, value), ignorenulls=True).over(running)
    # Neighbours never reach across the row of the bracket around them.
    marks = [F.lag("m", k).over(here) for k in (1, 2, 3, 4)]
    inside = [~F.coalesce(marks[0], F.lit(True))]
    for x in marks[1:]:
        inside.append(inside[-1] & ~F.coalesce(x, F.lit(True)))
    near = spread.select(
        "*",
        *(F.when(inside[k] & ~m, F.lag("t", k + 1).over(here)).alias(f"p{k + 1}") for k in range(4)),
        F.when(inside[0] & ~m, F.lag("kind").over(here)).alias("k1"),
        *(F.when(inside[k] & ~m, F.lag("off", k + 1).over(here)).alias(f"o{k + 1}") for k in range(3)),
        F.when(~F.coalesce(F.lead("m").over(here), F.lit(True)), F.struct(F.lead("t").over(here).alias("t"), F.lead("kind").over(here).alias("kind"), F.lead("off").over(here).alias("off"), F.lead("end").over(here).alias("end"))).alias("next"),
        F.when(~F.coalesce(F.lead("m", 2).over(here), F.lit(True)) & ~F.coalesce(F.lead("m").over(here), F.lit(True)), F.lead("t", 2).over(here)).alias("next2"),
        last(m, F.struct("i", "t", F.col("own_ctx").alias("ctx"), "off", "end")).alias("par"),
    )
    p1, k1 = F.col("p1"), F.col("k1")
    is_open = k1.eqNullSafe("p") & p1.isin("(", "[")
    value = (k1.isin("w") & ~p1.isin(*PREFIX)) | k1.isin("n", "s", "t", "r") | is_open
    control = lambda p: F.coalesce(p.isin(*CONTROL), F.lit(False))
    joins = (t.isin(".", "?.") & p1.isNotNull()) | F.coalesce(p1.isin(".", "?."), F.lit(False)) | ((t.isin("(", "[") & (F.col("kind") == "p") | (F.col("kind") == "t")) & F.coalesce(value, F.lit(False)))
    ctx = F.when(F.col("par.t") == "", "b").otherwise(F.col("par.ctx"))
    block_end = F.coalesce((p1 == "{") & ((F.col("p2") == "(") & control(F.col("p3")) | F.col("p2").isin("else", "do", "try", "finally", "catch")), F.lit(False))
    headed = F.coalesce((p1 == "(") & control(F.col("p2")) & ~F.col("p2").isin("switch", "catch"), F.lit(False)) | F.coalesce(p1.isin("else", "do", "try"), F.lit(False))
    labelled = F.coalesce((p1 == ":") & ((F.col("p3") == "case") | (F.col("p2") == "default")), F.lit(False))
    ended = k1.isin("n", "s", "t", "r") | (k1.eqNullSafe("p") & p1.isin("(", "[", "{", "++", "--")) | (k1.eqNullSafe("w") & ~p1.isin(*PREFIX))
    carries = ((F.col("kind") == "p") & ~t.isin("{", "!", "~", "++", "--")) | t.isin("in", "instanceof", "of", "as") | (F.col("kind") == "t")
    fed = F.col("nl") & ctx.isin("b", "c") & F.coalesce(ended, F.lit(False)) & ~carries
    begins = m | p1.isNull() | F.coalesce(p1 == ";", F.lit(False)) | block_end | headed | labelled | fed
    told = near.withColumn("ctx", ctx).withColumn("joins", ~m & joins).withColumn("begins", begins).withColumn("splits", begins | F.coalesce(p1 == ",", F.lit(False)))
    count = lambda c: F.sum(F.col(c).cast("int")).over(running)
    paren = ~m & F.col("joins") & (t == "(")
    chained = told.select(
        "*",
        last(~F.col("joins"), F.struct("i", "off", "line", "t", "kind", F.coalesce("p1", F.lit("")).alias("before"), F.col("o1").alias("before_off"))).alias("chain"),
        count("begins").alias("statement"),
        count("splits").alias("part"),
        F.sum(paren.cast("int")).over(running).alias("parens"),
        F.sum((~m).cast("int")).over(running).alias("n"),
    )
    again = chained.select("*", last(~F.col("joins"), F.col("parens")).alias("parens_before"), last(~paren, F.col("n")).alias("row_before"))
    return again.select(
        "f", "i", *_KEY, "content", "m", "level", "kind", "t", "off", "end", "line", "nl", "own_ctx", "ctx", "joins", "chain", "statement", "part", "p1", "p2", "p3", "p4", "o1", "o2", "o3", "next", "next2",
        "par", (F.col("parens") - F.col("parens_before")).alias("nth_call"), (F.col("n") - F.coalesce("row_before", F.lit(0))).alias("calls_in_row"),
    )


def calls(rows: DataFrame) -> DataFrame:
    """(f, i, start, line, open, open_line, end, callee_end, ...): calls, each an interval from the start of its
    callee to its closing bracket. ``made``: it is the call of a ``new``. ``name``, ``sign``, ``sign_off``: the last
    name of the callee and the sign before it; ``deep``: calls that its callee consists of; what its arguments begin with and hold."""
    c = F.col("chain")
    outer = (F.col("t") == "(") & (F.col("kind") == "p") & F.col("joins") & ~c["t"].isin(*CONTROL, "function", "super") & (c["before"] != "function") & ~((c["before"] == "*") & (F.col("p3") == "function"))
    site = F.struct(c["off"].alias("start"), c["before_off"].alias("new_off"), c["line"].alias("line"), c["t"].alias("head"), c["kind"].alias("head_kind"), c["before"].alias("before"), F.col("nth_call"), F.col("calls_in_row"), F.col("off").alias("open"), F.col("line").alias("open_line"), F.col("end").alias("end"), F.col("p1").alias("name"), F.col("p2").alias("sign"), F.col("o2").alias("sign_off"), F.col("next.t").alias("next"))
    inner = F.struct(F.col("next.kind").alias("kind"), F.col("next.off").alias("off"), F.col("next.end").alias("end"), F.col("next2").alias("then"))
    loose = F.max((~F.col("m") & (F.col("kind") != "s") & (F.col("t") != ","))).over(Window.partitionBy("f", "level", "par.i"))
    marked = rows.withColumn("loose", loose)
    both = marked.groupBy("f", "i").agg(F.max(F.when(~F.col("m") & outer, site)).alias("site"), F.max(F.when(F.col("m"), inner)).alias("first"), F.max(F.when(F.col("m"), F.col("loose"))).alias("loose"))
    found = both.where("site is not null").select("f", "i", "site.*", "first", "loose")
    method = (F.col("next").eqNullSafe("{")) & (F.col("sign").isNull() | ~F.col("sign").isin(".", "?.")) & (F.col("nth_call") == 1)
    made = (F.col("before") == "new") & (F.col("nth_call") == 1)
    return found.where(~method).withColumn("made", made).withColumn("deep", F.col("calls_in_row") - 1)


def functions(rows: DataFrame) -> DataFrame:
    """(f, start, end, body, body_end): declared functions, function expressions, methods and arrow functions."""
    t, p1, p2 = F.col("t"), F.col("p1"), F.col("p2")
    word = F.coalesce(p2.isin("function"), F.lit(False))
    named = F.coalesce((F.col("p3") == "function") | (F.col("p4") == "function"), F.lit(False))
    start = F.when(p1 == "=>", F.col("o2")).when(word, F.col("o2")).when(named, F.col("o3")).otherwise(F.col("o2"))
    body = (t == "{") & (F.col("own_ctx") == "b") & ((p1 == "=>") | ((p1 == "(") & (word | named | (p2.rlike(r"^[\p{L}_$#]") & ~p2.isin(*CONTROL)))))
    braced = rows.where(~F.col("m") & body).select("f", start.alias("start"), "end", F.col("off").alias("body"), F.col("end").alias("body_end"))
    bare = F.when((t == "=>") & (F.col("next.t") != "{") & F.col("o1").isNotNull(), F.struct(F.col("o1").alias("start"), F.col("next.off").alias("body")))
    parts = rows.where("not m").groupBy("f", "level", "part").agg(F.max("end").alias("end"), F.collect_list(bare).alias("bare"))
    arrows = parts.select("f", "end", F.explode("bare").alias("b")).select("f", "b.start", "end", "b.body", F.col("end").alias("body_end"))
    return braced.unionByName(arrows).where("start is not null")


def ancestors(intervals: DataFrame, sites: DataFrame) -> DataFrame:
    """(f, at, around): for each site at an offset, the intervals (f, start, end, kind, rank) around it, outermost
    first. Of intervals that start together the longer one is the outer one, or the one of lower rank.

    Depth is a running sum over starts and ends. A site is a row at each depth up to its own, where the latest
    start of that depth is what encloses it; so nothing is compared in pairs."""
    none = F.lit(None)
    starts = intervals.select("f", F.col("start").alias("pos"), F.lit(1).alias("step"), F.struct("start", "end", "kind", "rank").alias("x"), none.cast("int").alias("at"))
    ends = intervals.select("f", F.col("end").alias("pos"), F.lit(0).alias("step"), none.cast("struct<start:int,end:int,kind:string,rank:int>").alias("x"), none.cast("int").alias("at"))
    asked = sites.select("f", F.col("at").alias("pos"), F.lit(2).alias("step"), none.cast("struct<start:int,end:int,kind:string,rank:int>").alias("x"), F.col("at").cast("int")).distinct()
    order = [F.asc("pos"), F.asc("step"), F.desc("x.end"), F.asc("x.rank")]
    change = F.when(F.col("step") == 1, 1).when(F.col("step") == 0, -1).otherwise(0)
    depth = F.sum(change).over(Window.partitionBy("f").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = starts.unionByName(ends).unionByName(asked).withColumn("depth", depth).where("step > 0")
    at_depths = F.when(F.col("step") == 1, F.array("depth")).when(F.col("depth") > 0, F.sequence(F.lit(1).cast("long"), F.col("depth"))).otherwise(F.array(F.lit(0).cast("long")))
    spread = rows.withColumn("depth", F.explode(at_depths))
    last = F.last("x", ignorenulls=True).over(Window.partitionBy("f", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = spread.withColumn("x", F.when(F.col("depth") > 0, last)).where("step = 2")
    return found.groupBy("f", "at").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("depth", "x")))), lambda r: r["x"]).alias("around"))


def texts(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (f, cuts, ...) with package, version, path, and ``texts``: what stands between the offsets of each cut."""
    other = [c for c in spans.columns if c != "f"]
    file = rows.where("kind = 'f' and m").select("f", F.struct(*_KEY, "content").alias("file"))
    asked = spans.select("f", F.struct(*other).alias("span"))
    both = file.unionByName(asked, allowMissingColumns=True)
    gathered = both.groupBy("f").agg(F.max("file").alias("file"), F.collect_list("span").alias("spans"))
    cut = gathered.select("f", "file", F.explode("spans").alias("s"))
    found = F.transform("s.cuts", lambda c: F.substring(F.col("file.content"), c["a"] + 1, c["b"] - c["a"]))
    return cut.select("f", *(F.col(f"file.{c}").alias(c) for c in _KEY), *(F.col(f"s.{c}").alias(c) for c in other), found.alias("texts"))
