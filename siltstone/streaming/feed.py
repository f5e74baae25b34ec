"""Continuous scans of a feed of package files.

Line analyzers keep no state, so they run on a stream as they are; repeated publications within the
cache's lifetime are dropped by a watermark. What compares versions is in ``streaming.history``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import code


def fresh_files(feed: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """``feed``: package, version, path, content, published_at; each path of a version once in ``ttl``."""
    return feed.withWatermark("published_at", ttl).dropDuplicatesWithinWatermark(["package", "version", "path"])


def findings(feed: DataFrame, ttl: str = "24 hours") -> DataFrame:
    return code.static_code(fresh_files(feed, ttl))


def line_findings(feed: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """Findings of every analyzer of lines: dangerous calls, obfuscation and rules, from one pass."""
    return code.line_findings(fresh_files(feed, ttl))


def counts(feed: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Publications by window and package."""
    return feed.withWatermark("published_at", late).groupBy(F.window("published_at", window), "package").agg(F.count("*").alias("n"))
