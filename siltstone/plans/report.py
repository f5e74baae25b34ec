"""Scores, reports and what is written from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.functions import storage


def score(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    """The capped sum of weights, added in the order of severity: the tenths of low findings are
    folded one after the other, since their sum isn't exact in binary. More than 101 of them exceed the cap."""
    whole = 3.0 * critical + 1.5 * high + 0.5 * medium
    return F.least(F.aggregate(F.array_repeat(F.lit(0.1), F.least(low, F.lit(101)).cast("int")), whole.cast("double"), lambda a, x: a + x), F.lit(10.0))


def label(points: Column) -> Column:
    return F.when(points < 1, "Clean").when(points < 3, "Low").when(points < 5, "Medium").when(points < 7, "High").otherwise("Critical")


def ignored(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings that no ignore rule names: by part of the category's display name or of the title, or
    by the severity. ``rules`` (rule) come from a file that a person writes.

    Rules are tried on the distinct kinds of findings, and the findings themselves, which are written once, are joined by their kind."""
    findings = storage.stored(findings, "findings")
    r = rules.select(F.lower("rule").alias("__rule")).where("__rule is not null")
    hit = F.contains(F.lower(schema.category_display()), F.col("__rule")) | F.contains(F.lower("title"), F.col("__rule")) | (F.lower("severity") == F.col("__rule"))
    kinds = findings.select("category", "title", "severity").distinct().join(r, hit, "left_semi")
    return findings.join(kinds, ["category", "title", "severity"], "left_anti")


def scores(packages: DataFrame, findings: DataFrame) -> DataFrame:
    """(package, version, n_critical, n_high, n_medium, n_low, n_info, risk_score, risk_label) for every
    package, clean ones too. Counts are summed before the shuffle; findings aren't gathered."""
    return scored(packages, findings.select("package", "version", "severity", F.lit(1).alias("n")))


def scored(packages: DataFrame, counted: DataFrame) -> DataFrame:
    """The same from numbers ``n`` of findings by (package, version, severity), which may stand in several rows."""
    return _pointed(packages, counted.groupBy("package", "version").agg(*_counts(F.col("n"))))


def _counts(n: Column) -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col("severity") == s, n)), F.lit(0)).cast("long").alias(f"n_{s.lower()}") for s in ("Critical", "High", "Medium", "Low", "Info")]


def _pointed(packages: DataFrame, per: DataFrame) -> DataFrame:
    """Every package with its row of counts in ``per``, zeros if it has none, and its score."""
    names = [f"n_{s}" for s in ("critical", "high", "medium", "low", "info")]
    filled = packages.select("package", "version").distinct().join(per, ["package", "version"], "left").fillna(0, names)
    pointed = filled.withColumn("risk_score", score(*(F.col(f"n_{s}") for s in ("critical", "high", "medium", "low"))))
    return pointed.withColumn("risk_label", label(F.col("risk_score")))


def _analyzer() -> Column:
    return F.array_position(F.array(*map(F.lit, schema.ANALYZERS)), F.col("analyzer"))


def ordered(findings: DataFrame) -> DataFrame:
    """``pos``: a finding's place in its report, by severity, analyzer and the analyzer's order."""
    order = Window.partitionBy("package", "version").orderBy(schema.severity_rank().desc(), _analyzer(), "seq", "file", "line", "title")
    return findings.withColumn("pos", F.row_number().over(order))


def reports(packages: DataFrame, findings: DataFrame) -> DataFrame:
    """``scores`` with each package's findings as an ordered array, from one pass over the findings."""
    rest = [c for c in schema.COLUMNS if c not in ("package", "version")]
    first = ["seq", "file", "line", "title"]
    item = F.struct((-schema.severity_rank()).alias("r"), _analyzer().alias("a"), *first, *(c for c in rest if c not in first))
    placed = F.transform(F.sort_array(F.collect_list(item)), lambda f, i: F.struct((i + 1).alias("pos"), *(f[c].alias(c) for c in rest))).alias("findings")
    per = findings.groupBy("package", "version").agg(*_counts(F.lit(1)), placed)
    return _pointed(packages, per).withColumn("findings", F.coalesce("findings", F.array().cast(per.schema["findings"].dataType)))


def as_json(reported: DataFrame) -> DataFrame:
    """(package, version, json), a document for each report."""
    items = F.transform("findings", lambda f: F.struct(*(f[c].alias(c) for c in ("severity", "category", "title", "description", "file", "line", "snippet"))))
    return reported.select("package", "version", F.to_json(F.struct(F.col("package").alias("package_name"), "version", items.alias("findings"), "risk_score", "risk_label"), {"ignoreNullFields": "false"}).alias("json"))


def sarif_rules(findings: DataFrame, prefix: str = "siltstone") -> DataFrame:
    """(rule_id, name, level): a rule for each category, its level that of the category's first finding."""
    place = F.struct((-schema.severity_rank()).alias("r"), F.array_position(F.array(*map(F.lit, schema.ANALYZERS)), F.col("analyzer")).alias("a"), "package", "version", "seq")
    first = findings.groupBy("category").agg(F.min_by("severity", place).alias("severity"))
    return first.select(F.concat(F.lit(prefix + "/"), schema.category_rule()).alias("rule_id"), schema.category_display().alias("name"), schema.severity_level().alias("level"))


def sarif_results(findings: DataFrame, prefix: str = "siltstone") -> DataFrame:
    """(package, version, rule_id, level, message, uri, start_line) for every finding."""
    return findings.select("package", "version", F.concat(F.lit(prefix + "/"), schema.category_rule()).alias("rule_id"), schema.severity_level().alias("level"), F.col("description").alias("message"), F.coalesce("file", F.concat("package", F.lit("@"), "version")).alias("uri"), F.coalesce("line", F.lit(1)).alias("start_line"))


SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def as_sarif(reported: DataFrame, prefix: str = "siltstone") -> DataFrame:
    """(package, version, sarif): a SARIF 2.1.0 run for each report, clean ones too; results in the
    order of the report, rules in the order of their ids with the level of their first finding."""
    rule = lambda f: F.concat(F.lit(prefix + "/"), schema.category_rule(f["category"]))
    uri = lambda f: F.coalesce(f["file"], F.concat(F.col("package"), F.lit("@"), F.col("version")))
    place = lambda f: F.struct(F.struct(F.struct(uri(f).alias("uri")).alias("artifactLocation"), F.struct(F.coalesce(f["line"], F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    results = F.transform("findings", lambda f: F.struct(rule(f).alias("ruleId"), schema.severity_level(f["severity"]).alias("level"), F.struct(f["description"].alias("text")).alias("message"), F.array(place(f)).alias("locations")))
    names = F.array_distinct(F.transform("findings", lambda f: f["category"]))
    first = lambda c: F.get(F.filter("findings", lambda f: f["category"] == c), F.lit(0))["severity"]
    rules = F.array_sort(F.transform(names, lambda c: F.struct(F.concat(F.lit(prefix + "/"), schema.category_rule(c)).alias("id"), schema.category_display(c).alias("name"), F.struct(schema.category_display(c).alias("text")).alias("shortDescription"), F.struct(schema.severity_level(first(c)).alias("level")).alias("defaultConfiguration"))))
    run = F.struct(F.struct(F.struct(F.lit(prefix).alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), results.alias("results"))
    return reported.select("package", "version", F.to_json(F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def sarif_run(findings: DataFrame, prefix: str = "siltstone") -> DataFrame:
    """(package, version, pos, text): one SARIF run over the findings of many reports, in pieces.

    Joined in the order of package, version and pos the pieces are one JSON document: a head with the rules, which are as few as
    categories, a piece for each finding, and a tail; head and tail have nulls, and positions below and above all others. A rule's level is that of its first finding.
    No row holds more than one finding. What is read for the head, for the first place and for the pieces is written once."""
    placed = storage.stored(ordered(findings).select("package", "version", "pos", "severity", "category", "description", "file", "line"), "placed")
    at = F.struct("package", "version", "pos")
    first = placed.groupBy("category").agg(F.min_by("severity", at).alias("severity"), F.min(at).alias("at"))
    rule = F.struct(F.concat(F.lit(prefix + "/"), schema.category_rule()).alias("id"), schema.category_display().alias("name"), F.struct(schema.category_display().alias("text")).alias("shortDescription"), F.struct(schema.severity_level().alias("level")).alias("defaultConfiguration"))
    driver = F.struct(F.lit(prefix).alias("name"), F.coalesce(F.array_sort(F.collect_list(rule)), F.array().cast(first.select(F.array(rule)).schema[0].dataType)).alias("rules"))
    edge = lambda pos: [F.lit(None).cast("string").alias("package"), F.lit(None).cast("string").alias("version"), F.lit(pos).alias("pos")]
    head = first.agg(driver.alias("driver")).select(*edge(-1), F.concat(F.lit(f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":'), F.to_json("driver"), F.lit('},"results":[')).alias("text"))
    tail = findings.sparkSession.range(1).select(*edge(1), F.lit("]}]}").alias("text"))
    uri = F.coalesce("file", F.concat("package", F.lit("@"), "version"))
    place = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct(F.coalesce("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.to_json(F.struct(F.concat(F.lit(prefix + "/"), schema.category_rule()).alias("ruleId"), schema.severity_level().alias("level"), F.struct(F.col("description").alias("text")).alias("message"), F.array(place).alias("locations")))
    # Every finding but the very first one, which its category's row knows, follows a comma.
    begins = first.agg(F.min("at").alias("begin")).select("begin.*").withColumn("begins", F.lit(True))
    marked = placed.withColumn("text", result).join(begins, ["package", "version", "pos"], "left")
    body = marked.select("package", "version", "pos", F.concat(F.when(F.col("begins"), "").otherwise(","), "text").alias("text"))
    return head.unionByName(body).unionByName(tail)


def write_sarif(run: DataFrame, path: str) -> None:
    """The pieces of a ``sarif_run`` as text files, which joined in the order of their names are the document."""
    edge = F.when(F.col("package").isNull(), F.col("pos")).otherwise(F.lit(0))
    run.orderBy(edge, "package", "version", "pos").select("text").write.text(path)


def buckets(scored: DataFrame) -> DataFrame:
    """(bucket, n): critical, high, medium, and clean with low."""
    bucket = F.when(F.col("risk_label").isin("Low", "Clean"), "clean").otherwise(F.lower("risk_label"))
    return scored.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def summary(reported: DataFrame) -> DataFrame:
    """(package, version, risk_label, risk_score, line): a report's first two titles."""
    titles = F.array_join(F.slice(F.transform("findings", lambda f: f["title"]), 1, 2), ", ")
    return reported.select("package", "version", "risk_label", "risk_score", F.when(F.size("findings") == 0, "no details").otherwise(titles).alias("line"))


def terminal(reported: DataFrame) -> DataFrame:
    """(package, version, text): a report as text, a line for each finding."""
    rows = F.transform("findings", lambda f: F.concat(F.lit("  ["), F.upper(f["severity"]), F.lit("] "), schema.category_display(f["category"]), F.lit(": "), f["title"], F.coalesce(F.concat(F.lit(" ("), f["file"], F.coalesce(F.concat(F.lit(":"), f["line"].cast("string")), F.lit("")), F.lit(")")), F.lit(""))))
    head = F.concat("package", F.lit("@"), "version", F.lit(" "), F.upper("risk_label"))
    return reported.select("package", "version", F.array_join(F.concat(F.array(head), rows), "\n").alias("text"))


def exit_code(scored: DataFrame) -> DataFrame:
    """(code): 1 if any report is High or Critical, else 0."""
    return scored.agg(F.coalesce(F.max(F.col("risk_label").isin("High", "Critical").cast("int")), F.lit(0)).alias("code"))


def gate(scored: DataFrame, force: bool = False) -> DataFrame:
    """(package, version, risk_label, approved): whether an install may go on without asking."""
    return scored.select("package", "version", "risk_label", (F.lit(force) | ~F.col("risk_label").isin("High", "Critical")).alias("approved"))


def fresh(cache: DataFrame, now: Column, seconds: int = 86_400, rules_hash: str | None = None) -> DataFrame:
    """Cached reports that aren't older than ``seconds``, the newest of each package version."""
    kept = cache.where(F.unix_timestamp(now) - F.unix_timestamp("saved_at") <= seconds)
    if rules_hash is not None:
        kept = kept.where(F.col("rules_hash") == rules_hash)
    rest = [c for c in kept.columns if c != "saved_at"]
    best = kept.groupBy("package", "version").agg(F.max(F.struct("saved_at", *rest)).alias("r"))
    return best.select(*(F.col(f"r.{c}").alias(c) for c in kept.columns))


def pending(packages: DataFrame, cached: DataFrame) -> DataFrame:
    """Packages without a cached report."""
    return packages.join(cached.select("package", "version"), ["package", "version"], "left_anti")
