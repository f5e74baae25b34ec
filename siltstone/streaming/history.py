"""Versions of packages on a stream: the last two of each are kept as state, compared and scored.

``published`` is a stream of (package, version, publish_ts, maintainers array<struct<name, email>>). A package's state is
two entries, however many versions it has; late and repeated rows leave it as a batch over all rows would. With a
``ttl_ms`` a package's state ends that long after its last change, and the next version of it counts as a first one; such
a stream looks for ended states all the time, so it runs until it is stopped and can't be ``collected``.
The operator needs the RocksDB state store, which ``prepared`` sets for a session.

Defined cases: rows without package or version are left out; a null publish_ts comes before all others; of rows
with one version and time the first that is read counts; null maintainers stay null; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstone.functions import storage
from siltstone.operators import metadata
from siltstone.operators import versions as versions_of
from siltstone.plans import report

_PEOPLE = "array<struct<name: string, email: string>>"
_ENTRY = "last_ts string, last_version string, last_people string, prev_ts string, prev_version string, prev_people string"
_OUT = f"package string, {_ENTRY}"
_FIELDS = [x.split()[0] for x in _ENTRY.split(", ")]


class LastTwo(StatefulProcessor):
    """The last two versions of a package by (publish_ts, version)."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.two = handle.getValueState("two", _ENTRY, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.two.get() or ()) if self.two.exists() else ()
        kept = [before[k : k + 3] for k in (0, 3) if before and before[k + 1] is not None]
        for frame in rows:
            for row in zip(frame["publish_ts"], frame["version"], frame["people"], strict=True):
                at = (row[0] or "", row[1])
                if any((k[0] or "", k[1]) == at for k in kept):
                    continue
                kept = sorted([*kept, row], key=lambda k: (k[0] or "", k[1]), reverse=True)[:2]
        after = tuple(x for k in [*kept, (None,) * 3][:2] for x in k)
        if after != before:
            self.two.update(after)
            yield pd.DataFrame([(key[0], *after)], columns=["package", *_FIELDS], dtype="object")

    def close(self) -> None:
        pass


def prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def last_two(published: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A row with a package's last two versions whenever they change: (package, last and prev, each a struct of
    publish_ts, version, maintainers; prev null for a first version)."""
    rows = published.where("package is not null and version is not null").select(F.col("package").cast("string").alias("package"), "version", F.col("publish_ts").cast("string").alias("publish_ts"), F.to_json("maintainers").alias("people"))
    module = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(module)  # workers need not import this package
    try:
        changed = rows.groupBy("package").transformWithStateInPandas(LastTwo(ttl_ms), _OUT, "Append", "ProcessingTime" if ttl_ms else "None")
    finally:
        cloudpickle.unregister_pickle_by_value(module)
    entry = lambda side: F.struct(F.col(f"{side}_ts").alias("publish_ts"), F.col(f"{side}_version").alias("version"), F.from_json(f"{side}_people", _PEOPLE).alias("maintainers"))
    return changed.select("package", F.when(F.col("prev_version").isNotNull(), entry("prev")).alias("prev"), entry("last").alias("last"))


def current(changes: DataFrame) -> DataFrame:
    """Of a table of ``last_two``'s rows each package's newest: its last two only ever move forward."""
    time = F.struct(F.coalesce("last.publish_ts", F.lit("")), "last.version", F.coalesce("prev.publish_ts", F.lit("")), F.coalesce("prev.version", F.lit("")))
    return changes.groupBy("package").agg(F.max_by(F.struct("prev", "last"), time).alias("c")).select("package", "c.*")


def pairs(two: DataFrame) -> DataFrame:
    """``last_two``'s rows, stream or table, as ``metadata.maintainer_changes`` takes them."""
    return two.where("prev.maintainers is not null").select("package", F.col("last.version").alias("version"), F.col("prev.maintainers").alias("old"), F.coalesce("last.maintainers", F.array().cast(_PEOPLE)).alias("new"), F.col("last.publish_ts").alias("ts"))


def maintainer_findings(published: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Changes of maintainers as they are published, as a stream of findings."""
    return metadata.maintainer_changes(pairs(last_two(published, ttl_ms)))


def collected(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what its source holds now, into a table of the shared folder, and reads that."""
    spark = prepared(stream.sparkSession)
    base = storage.fresh(spark, name)
    stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def diff_sink(files: str, out: str):
    """For ``foreachBatch`` over ``last_two``: findings from a package's last two versions, whose files (package, version,
    path, content) are in the Parquet table ``files`` before the version is published. A batch that
    is run again replaces its folder."""

    def write(two: DataFrame, batch: int) -> None:
        spark = two.sparkSession
        # A package that changed several times in a batch has one row here, so a finding comes once.
        pair = two.where("prev is not null").select("package", F.col("prev.version").alias("old_version"), F.col("last.version").alias("new_version")).persist()
        contents = spark.read.parquet(files)
        of = lambda which: contents.join(pair.select("package", F.col(which).alias("version")), ["package", "version"], "left_semi").select("package", "path", "content")
        versions_of.diff(of("old_version"), of("new_version"), pair).write.mode("overwrite").parquet(f"{out}/batch={batch}")
        pair.unpersist()

    return write


def score_sink(out: str):
    """For ``foreachBatch`` over a stream of findings: their numbers by version and severity, a folder a batch."""

    def write(found: DataFrame, batch: int) -> None:
        found.groupBy("package", "version", "severity").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return write


def scores(packages: DataFrame, counted: DataFrame) -> DataFrame:
    """``report.scores`` from what ``score_sink`` wrote: the numbers of all batches are added up."""
    return report.scored(packages, counted.select("package", "version", "severity", "n"))
