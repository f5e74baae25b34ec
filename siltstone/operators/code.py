"""Findings from code lines: patterns, obfuscation and rules.

Every operator takes ``files(package, version, path, content)`` and applies path filters before lines
are exploded. Patterns that are known when the plan is built are literals of one projection, so a
line is visited once and no join is needed; rules given as a DataFrame are joined instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.functions import comments, text
from siltstone.operators import patterns


def scripts(files: DataFrame, extensions: str = "js|cjs|mjs|ts|tsx|jsx") -> DataFrame:
    """Files with one of the extensions, neither minified nor in a directory of build output."""
    path = F.col("path")
    return files.where(text.extension(path).rlike(f"^({extensions})$") & ~text.minified(path) & ~text.built(path))


def to_lines(files: DataFrame, strip: bool = False) -> DataFrame:
    """(package, version, path, line, raw[, code]); ``code`` is the line without comments."""
    if not strip:
        return files.select("package", "version", "path", F.posexplode(text.lines(F.col("content"))).alias("line", "raw")).withColumn("line", F.col("line") + 1)
    both = files.select("package", "version", "path", "content", comments.stripped_content(F.col("content")).alias("code"))
    zipped = both.select("package", "version", "path", F.posexplode(F.arrays_zip(text.lines(F.col("content")).alias("raw"), text.lines(F.col("code")).alias("code"))).alias("line", "z"))
    # A comment that ends the content takes the last line's text, but not the line.
    return zipped.select("package", "version", "path", (F.col("line") + 1).alias("line"), "z.raw", F.coalesce("z.code", F.lit("")).alias("code"))


def _expected(path: Column, severity: str, category: str) -> Column:
    out = F.lit(False)
    for of, level, parts, exact in patterns.EXPECTED:
        if of == category and level in (None, severity):
            where = path if exact else F.lower(path)
            for p in parts:
                out = out | where.contains(p)
    return out


def _hit(i: int, severity: str, category: str, title: str, pattern: str | None = None) -> Column:
    return F.struct(F.lit(i).alias("i"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(title).alias("title"), F.lit(pattern).cast("string").alias("pattern"))


def _mask(checks: list[Column]) -> Column:
    """A bit for each check that holds. Plain arithmetic stays in generated code, where an array of
    hits would not; hits are made for the few lines with a bit only."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(checks):
        out = out + F.when(c, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return out


def _gated(on: Column, tried: list[str], bits: Column) -> Column:
    """``bits`` where the text holds what one of the patterns needs, else 0: most lines are told by a few plain searches."""
    if not all(p in patterns.NEEDED for p in tried):
        return bits
    holds = reduce(lambda a, b: a | b, (on.contains(x) for x in dict.fromkeys(x for p in tried for x in patterns.NEEDED[p])), F.lit(False))
    return F.when(holds, bits).otherwise(F.lit(0).cast("long"))


def _chosen(mask: Column, hits: list[Column]) -> Column:
    return F.filter(F.array(*hits), lambda h: F.getbit(mask, h["i"]) == 1)


def _static_mask(code: Column, path: Column, table: list[tuple] = patterns.STATIC) -> Column:
    """The table's patterns that a line without comments matches."""
    bits = _mask([code.rlike(pattern) & ~_expected(path, severity, category) for severity, category, pattern, _ in table])
    return _gated(code, [pattern for _, _, pattern, _ in table], F.when((text.trimmed(code) != "") & ~code.rlike(r"^\s*(//|#)"), bits).otherwise(F.lit(0).cast("long")))


def _static_hits(table: list[tuple] = patterns.STATIC) -> list[Column]:
    return [_hit(i, severity, category, title, pattern) for i, (severity, category, pattern, title) in enumerate(table)]


#: The bit of dense lines, which no pattern tells.
_DENSE = 1 << 2


def _obfuscation_mask(raw: Column) -> Column:
    """The bits of all checks; _DENSE for lines that may be dense."""
    integrity = text.trimmed(raw).startswith('"integrity"') | text.trimmed(raw).startswith('"sha')
    size = F.octet_length(raw)
    unbroken = (size >= 50) & raw.rlike("[^ ]{50}")  # told sooner than runs of a class, which start again at each sign
    return _mask([unbroken & raw.rlike(patterns.LONG_HEX), unbroken & raw.rlike(patterns.LONG_BASE64) & ~integrity, (size > 100) & text.maybe_dense(raw), raw.contains("\\") & raw.rlike(patterns.ESCAPES), size > 500])


def _dense_told(marked: DataFrame, mask: str) -> DataFrame:
    """Rows with _DENSE in ``mask`` for the dense lines only. Only lines that may be dense are taken to Python.

    Masks of 0 are left, as they give no hits: a filter on what Python told would make Spark ask it twice."""
    may = F.col(mask).bitwiseAND(F.lit(_DENSE)) != 0
    told = marked.withColumn("entropy", text.byte_entropy(F.when(may, F.col("raw"))))
    return told.withColumn(mask, F.col(mask) - F.when(may & (F.col("entropy") <= 5.5), F.lit(_DENSE)).otherwise(F.lit(0)))


_OBFUSCATION = [
    ("Critical", "Long hex string detected", patterns.LONG_HEX),
    ("High", "Long base64 string detected", patterns.LONG_BASE64),
    ("High", "High entropy line", None),
    ("Medium", "Excessive string escaping", patterns.ESCAPES),
    ("Low", "Minified code in non-minified file", None),
]


def _obfuscation_hits() -> list[Column]:
    return [_hit(i, severity, "Obfuscation", title, pattern) for i, (severity, title, pattern) in enumerate(_OBFUSCATION)]


def _excluded(path: Column, low: Column, excludes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for e in excludes:
        out = out | low.contains(e.lower())
        if any(c in e for c in "*?["):  # without wildcards a glob says no more than the part of a path
            out = out | text.basename(path).rlike(text.glob_pattern(e)) | path.rlike(text.glob_pattern(e))
    return out


def _rule_uses(path: Column, rules: list[tuple]) -> Column:
    """For each rule, whether it applies to a path. The path and its lower case are bound once, as each rule tries them several times."""
    uses = lambda p: F.array(*((F.lit(True) if not glob else text.basename(p["path"]).rlike(text.glob_pattern(glob))) & ~_excluded(p["path"], p["low"], tuple(excludes)) for *_, glob, excludes in rules))
    return F.get(F.transform(F.transform(F.array(path), lambda x: F.struct(x.alias("path"), F.lower(x).alias("low"))), uses), F.lit(0))


def _rule_mask(raw: Column, use: Column, rules: list[tuple]) -> Column:
    return _gated(raw, [rule[4] for rule in rules], _mask([F.get(use, F.lit(i)) & raw.rlike(rule[4]) for i, rule in enumerate(rules)]))


def _rule_hits(rules: list[tuple]) -> list[Column]:
    word = lambda c: c.lower().replace("-", "_").replace(" ", "_")
    return [_hit(i, patterns.RULE_SEVERITY.get(severity.lower(), "Info"), patterns.RULE_CATEGORY.get(word(category), "Suspicious"), f"[{id_}] {name}", pattern) for i, (id_, name, severity, category, pattern, _, _) in enumerate(rules)]


#: What a finding of a category means.
_MEANING = {
    "CodeExecution": "Text is run as code, which may come from anywhere",
    "NetworkAccess": "The package talks to the network",
    "FileSystemAccess": "The package reaches into the file system",
    "ProcessSpawn": "The package starts other programs",
    "Obfuscation": "The code hides what it does",
    "EnvAccess": "The environment, where secrets are kept, is read",
    "Suspicious": "This is seldom needed in a library",
}


def _about(on: Column) -> Column:
    """A hit's description: what its category means, where it is, and the text that matched."""
    matched = F.regexp_substr(on, F.col("h.pattern"))
    meaning = schema._case(F.col("h.category"), list(_MEANING.items()), "A pattern matched")
    size = F.concat(F.lit(" ("), F.octet_length("raw").cast("string"), F.lit(" bytes)"))
    return F.concat(meaning, F.lit(", line "), F.col("line").cast("string"), F.coalesce(F.concat(F.lit(": "), text.truncate(matched, 60)), size))


def _found(rows: DataFrame, analyzer: str, mask: Column, hits: list[Column], width: int, seq: Column, on: str = "raw") -> DataFrame:
    marked = rows.withColumn("mask", mask).where("mask != 0")
    if analyzer == "obfuscation":
        marked = _dense_told(marked, "mask")
    each = marked.select("package", "version", "path", "line", "raw", *({on} - {"raw"}), F.explode(_chosen(F.col("mask"), hits)).alias("h"))
    return schema.findings(each, analyzer, F.col("h.severity"), F.col("h.category"), F.col("h.title"), _about(F.col(on)), F.col("path"), F.col("line"), text.truncate(F.col("raw"), width), seq)


def _seq(by: str) -> Column:
    line, i = F.col("line").cast("long"), F.col("h.i").cast("long")
    return {"static": line * 100 + i, "obfuscation": line * 10 + i, "rules": i * 1_000_000_000 + line}[by]


def static_code(files: DataFrame, table: list[tuple] = patterns.STATIC) -> DataFrame:
    """Dangerous calls outside comments."""
    return _found(to_lines(scripts(files), strip=True), "static-code", _static_mask(F.col("code"), F.col("path"), table), _static_hits(table), 100, _seq("static"), "code")


def obfuscation(files: DataFrame) -> DataFrame:
    """Encoded or dense lines, comments included; the checks are independent."""
    lines = to_lines(scripts(files, "js|cjs|mjs|ts|tsx|jsx|json"))
    return _found(lines, "obfuscation", _obfuscation_mask(F.col("raw")), _obfuscation_hits(), 100, _seq("obfuscation"))


def rule_matches(files: DataFrame, rules: list[tuple] = patterns.RULES) -> DataFrame:
    """Findings of rules (id, name, severity, category, pattern, file glob, excluded paths) that are
    known when the plan is built, at most 63: one projection over the lines of all files."""
    flagged = files.withColumn("use", _rule_uses(F.col("path"), rules)).where(F.exists("use", lambda x: x))
    lines = flagged.select("package", "version", "path", "use", F.posexplode(text.lines(F.col("content"))).alias("line", "raw")).withColumn("line", F.col("line") + 1)
    return _found(lines, "rules", _rule_mask(F.col("raw"), F.col("use"), rules), _rule_hits(rules), 120, _seq("rules"))


def line_findings(files: DataFrame, rules: list[tuple] = patterns.RULES) -> DataFrame:
    """What ``static_code``, ``obfuscation`` and ``rule_matches`` find, from one pass over the lines."""
    path, content, raw = F.col("path"), F.col("content"), F.col("raw")
    plain = ~text.minified(path) & ~text.built(path)
    wanted = files.select("package", "version", "path", "content", (plain & text.extension(path).rlike("^(js|cjs|mjs|ts|tsx|jsx)$")).alias("is_code"), (plain & text.extension(path).rlike("^(js|cjs|mjs|ts|tsx|jsx|json)$")).alias("is_data"), _rule_uses(path, rules).alias("use"))
    used = ["package", "version", "path", "is_code", "is_data", "use"]
    both = wanted.where(F.col("is_data") | F.exists("use", lambda x: x)).select(*used, "content", F.when(F.col("is_code"), comments.stripped_content(content)).otherwise(content).alias("code"))
    zipped = both.select(*used, F.posexplode(F.arrays_zip(text.lines(content).alias("raw"), text.lines(F.col("code")).alias("code"))).alias("line", "z"))
    lines = zipped.select(*used, (F.col("line") + 1).alias("line"), F.col("z.raw").alias("raw"), F.coalesce("z.code", F.lit("")).alias("code"))
    none = F.lit(0).cast("long")
    masks = [F.when(F.col("is_code"), _static_mask(F.col("code"), path)).otherwise(none), F.when(F.col("is_data"), _obfuscation_mask(raw)).otherwise(none), _rule_mask(raw, F.col("use"), rules)]
    marked = _dense_told(lines.withColumns({f"m{k}": m for k, m in enumerate(masks)}).where("m0 != 0 or m1 != 0 or m2 != 0"), "m1")
    tables = (_static_hits(), _obfuscation_hits(), _rule_hits(rules))
    part = lambda k: F.transform(_chosen(F.col(f"m{k}"), tables[k]), lambda h: F.struct(F.lit(k).alias("k"), *(h[c].alias(c) for c in ("i", "severity", "category", "title", "pattern"))))
    each = marked.select("package", "version", "path", "line", "raw", "code", F.explode(F.concat(part(0), part(1), part(2))).alias("h"))
    k = F.col("h.k")
    analyzer = F.when(k == 0, "static-code").when(k == 1, "obfuscation").otherwise("rules")
    snippet = F.when(k == 2, text.truncate(raw, 120)).otherwise(text.truncate(raw, 100))
    seq = F.when(k == 0, _seq("static")).when(k == 1, _seq("obfuscation")).otherwise(_seq("rules"))
    return schema.findings(each, analyzer, F.col("h.severity"), F.col("h.category"), F.col("h.title"), _about(F.when(k == 0, F.col("code")).otherwise(raw)), path, F.col("line"), snippet, seq)


#: Characters of a literal by which rules and lines meet.
GRAM = 4
#: Characters of a literal that hold a whole one of every GRAM-th n-gram wherever they stand.
LEAST = 2 * GRAM - 1
#: Bytes of rules, as text, that are sent to all executors.
BROADCAST_BYTES = 8 << 20
#: Signs that a pattern may hold escaped, the escape's own first; each has a stand-in that is no character.
_SIGNS = "\\.()[]{}|?*+^$/-\"'`=:;,<>!@#%&~ "
_STAND_INS = "".join(chr(0xFDD0 + i) for i in range(len(_SIGNS)))
_TIMES = r"(?:[?*+]|\{[^}]*\})[?+]?"


def required_literal(pattern: Column) -> Column:
    """The longest text that every match of a pattern holds, or null if none of GRAM characters is found.

    Only what can't be optional counts: alternatives, groups, classes, flags, and characters with a
    quantifier that allows none are left out, and other signs end a text."""
    gap = "\x00"
    p = pattern
    for sign, stand_in in zip(_SIGNS, _STAND_INS, strict=True):
        p = F.replace(p, F.lit(f"\\{sign}"), F.lit(stand_in))
    p = F.regexp_replace(p, r"\\(?:[xu][0-9A-Fa-f]{2,4}|[pP]\{[^}]*\}|.)", gap)
    p = F.regexp_replace(p, rf"\[\^?\]?[^\]]*\](?:{_TIMES})?", gap)
    for _ in range(6):  # groups from the inside out
        p = F.regexp_replace(p, rf"\([^()]*\)(?:{_TIMES})?", gap)
    p = F.regexp_replace(F.regexp_replace(p, r".(?:[?*]|\{[^}]*\})[?+]?", gap), r"\+[?+]?|[.^$]", gap)
    runs = F.filter(F.split(F.translate(p, _STAND_INS, _SIGNS), gap), lambda x: F.length(x) >= GRAM)
    longest = F.array_max(F.transform(runs, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    return F.when(~pattern.rlike(r"\(\?[a-zA-Z]") & ~p.rlike(r"[|()\[\]{}]"), longest)


def rule_joins(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for rules (id, name, severity, category, pattern, file_regex, exclude_paths) that come
    as a DataFrame, of any size. ``severity`` and ``category`` hold the names of findings.

    A rule whose pattern needs a literal of LEAST characters meets the lines that may match in an equi-join: of
    a line every GRAM-th n-gram is taken, of a literal the first GRAM of all its n-grams, so each occurrence of the literal
    covers a pair of equal ones. The pair at its first occurrence counts, and only then the pattern is tried. The rules' size is measured: up to
    BROADCAST_BYTES of them are broadcast, so that lines stay where they are, and beyond that a line moves once for
    each of its n-grams. Other rules are tried on every line, in a nested loop. Null patterns
    match nothing; repeated rules give repeated findings."""
    path, raw, literal = F.col("path"), F.col("raw"), F.col("literal")
    known = rules.where("pattern is not null").withColumn("literal", required_literal(F.col("pattern")))
    size = known.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*known.columns)))), F.lit(0))).first()[0]
    sent = F.broadcast if size <= BROADCAST_BYTES else lambda df: df
    lines = to_lines(files)
    allowed = F.coalesce(F.rlike(text.basename(path), F.col("file_regex")), F.lit(True)) & ~F.exists(F.coalesce("exclude_paths", F.array().cast("array<string>")), lambda e: F.contains(F.lower(path), F.lower(e)))
    matches = allowed & F.rlike(raw, F.col("pattern"))
    cut = lambda t, at: F.transform(at, lambda i: F.substring(t, i, F.lit(GRAM)))
    keyed = lines.where(F.length(raw) >= LEAST).withColumn("gram", F.explode(F.array_distinct(F.regexp_extract_all(raw, F.lit(f"(?s).{{{GRAM}}}"), F.lit(0)))))
    long = F.coalesce(F.length(literal) >= LEAST, F.lit(False))
    by_literal = known.where(long).withColumn("gram", F.explode(F.array_distinct(cut(literal, F.sequence(F.lit(1), F.lit(GRAM))))))
    first = F.call_function("instr", raw, literal)
    block = first + (GRAM - (first - 1) % GRAM) % GRAM
    indexed = keyed.join(sent(by_literal), "gram").where((first > 0) & (F.col("gram") == F.substring(raw, block, F.lit(GRAM)))).where(matches)
    looped = lines.join(sent(known.where(~long)), F.coalesce(F.contains(raw, literal), F.lit(True)) & matches).drop("literal")
    found = indexed.select(looped.columns).unionByName(looped)
    return schema.findings(found, "rules", F.col("severity"), F.col("category"), F.concat(F.lit("["), "id", F.lit("] "), "name"), "a rule matched", path, F.col("line"), text.truncate(raw, 120), F.col("line"))
