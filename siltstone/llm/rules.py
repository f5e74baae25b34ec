"""Host-level quality rules, in DataFrame operations only.

Every text is measured; rules turn measures into failures. Failures are aggregated by host, each
host's rate is shrunk towards an empirical beta prior (fitted to the hosts' rates by moments), and
hosts that almost surely fail at more than twice the corpus's odds lose all their documents.

Defined cases: a null text has no words and so fails; a null host is a host of its own; repeated
rows count and are returned each; null ids stay; with fewer than two hosts, or hosts of equal
rates, the prior is the corpus rate with one document's weight; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import stored

#: Characters between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: A host is bad if the odds of failing are above this many times the corpus's, even at the rate that lies this many
#: standard deviations of the posterior below its mean (a chance of one in twenty).
WORST_ODDS, DEVIATIONS = 2.0, 1.645
#: Least and most weight of the prior, in documents.
PRIOR_WEIGHT = (1.0, 1000.0)


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id_col, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) for every row.

    Windows are compared as hashes first; only texts with two equal hashes compare the words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spoken = F.filter(F.split("text", "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    worded = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text")).select(
        "id",
        "host",
        F.length(text).alias("n_chars"),
        _without(text, SPACES).cast("long").alias("word_chars"),
        _without(text, SYMBOLS).alias("plain_chars"),
        F.when(_without(text, SPACES) > 0, F.split(F.btrim(text, F.lit(SPACES)), r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")).alias("w"),
        spoken.alias("lines"),
    )
    at = F.sequence(F.lit(0), F.size("w") - WINDOW)
    hashed = worded.select(
        "id", "host", "n_chars", "word_chars", "plain_chars", "w",
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") > WINDOW, F.transform(at, lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(WINDOW))))).alias("h"),
    )
    twice = F.size("h") > F.size(F.array_distinct("h"))
    windows = F.transform(at, lambda i: F.struct(F.array_join(F.slice("w", i + 1, WINDOW), " ").alias("words"), i.alias("at")))
    keep = ("id", "host", "n_chars", "word_chars", "plain_chars", "n_lines", "n_dup_lines", "n_words")
    sorted_ = hashed.withColumns({"n_words": F.size("w").cast("long"), "s": F.when(twice, F.sort_array(windows))}).select(*keep, "s")
    same = lambda x, j: (x["words"] == F.get("s", j)["words"])
    starts = sorted_.select(*keep, F.sort_array(F.transform(F.filter("s", lambda x, i: F.when(i > 0, same(x, i - 1)).otherwise(False) | F.coalesce(same(x, i + 1), F.lit(False))), lambda x: x["at"])).alias("p"))
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("p", i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    return starts.select(
        F.col("id").alias(id_col),
        "host",
        "n_words",
        "word_chars",
        (F.col("n_chars") - F.col("plain_chars")).cast("long").alias("n_symbols"),
        F.col("n_lines").cast("long").alias("n_lines"),
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"
#: A document fails if a base rule or one of these holds.
FAILED = f"({BASE_FAILED}) or 10 * n_symbols > 3 * n_words or 2 * n_dup_lines > n_lines or word_chars < 2 * n_words or word_chars > 15 * n_words"


def hosts(measured: DataFrame, worst: float = WORST_ODDS, deviations: float = DEVIATIONS) -> DataFrame:
    """(host, n_docs, n_failed, rate, low_rate, host_ok): failures by host, the shrunk rate, what it is at least, and
    the verdict. Hosts that differ by chance only all pass. The driver reads one row, the prior's moments."""
    per = measured.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.expr(f"if({FAILED}, 1, 0)")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    failed, docs, spread = per.agg(F.sum("n_failed"), F.sum("n_docs"), F.var_samp(raw)).first()
    mean = failed / docs if docs else 0.0
    weight = mean * (1 - mean) / spread - 1 if spread else PRIOR_WEIGHT[0]
    weight = min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
    rate = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    low = F.col("rate") - deviations * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n_docs") + F.lit(weight + 1)))
    limit = worst * mean / (1 - mean + worst * mean)
    judged = per.select("host", "n_docs", "n_failed", rate.alias("rate")).withColumn("low_rate", low)
    return judged.withColumn("host_ok", F.col("low_rate") <= F.lit(limit))


def verdicts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The measures of every row, with base_failed and kept. Texts are read once: their measures
    are written to the shared folder, summed by host there, and joined with the hosts' verdicts."""
    measured = stored(spark, measure(docs, id_col, text_col, host_col), "measures")
    judged = hosts(measured).select(F.col("host").alias("__host"), "host_ok", "rate", "low_rate")
    joined = measured.join(judged, F.col("host").eqNullSafe(F.col("__host")))
    return joined.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop("__host")
