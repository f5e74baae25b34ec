"""Every registered query over the smallest tables, against its SQL where it has one."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siltstone.functions import storage, text
from siltstone.operators import patterns
from siltstone.plans import queries as own
from siltstone.plans import report

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def normal(v):
    if v is None or v != v:
        return ""
    return repr(round(v, 9)) if isinstance(v, float) else str(v)[:19] if hasattr(v, "year") else str(v)


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_equals_sql(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(normal, r)) for r in df.select(*columns).collect())
    result = duck.execute(own.ORACLES[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert got == sorted(tuple(normal(r[i]) for i in at) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLES)))
def test_runs(spark, name):
    assert own.QUERIES[name](spark, SF).count() > 0


def test_dependency_risks_of_all_parts(spark):
    parts = {r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()}
    n = len(parts)
    want = []
    for root in parts:
        reached, level = set(), {root}
        for _ in range(3):
            level = {b for a in level & parts for b in ((2 * a + 1) % n, 3 * a % n, a // 2)} - reached
            reached |= level
        for b in reached & parts:
            want += [(str(root), "High", f"Transitive dependency has install scripts: {b}@1.0.0")] * (b % 19 == 0)
            want += [(str(root), "Medium", f"Transitive dependency is deprecated: {b}@1.0.0")] * (b % 13 == 0)
            want += [(str(root), "High", f"Transitive dependency is very new: {b}@1.0.0")] * (b % 34 == 0)
    got = own.QUERIES["dependency_risks"](spark, SF).select("package", "severity", "title").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({r[0] for r in want}) > 40


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream(spark, tmp_path):
    from siltstone.streaming import feed

    rows = [("p", "1", "i.js", "eval(x)", "2026-01-01 00:00:00"), ("p", "1", "i.js", "eval(x)", "2026-01-01 01:00:00"), ("q", "1", "j.js", "ok", "2026-01-01 00:00:00")]
    schema = "package string, version string, path string, content string, published_at timestamp"
    spark.createDataFrame(rows, schema.replace("timestamp", "string")).selectExpr("package", "version", "path", "content", "cast(published_at as timestamp) published_at").write.parquet(str(tmp_path / "in"))
    stream = feed.findings(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("feed_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["title"] for r in spark.table("feed_out").collect()] == ["Dynamic eval() detected"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_binaries_are_dealt_out(spark):
    # A small file is one task, and its rows' binaries took a task for each pass before.
    assert own.QUERIES["binary_entropy"](spark, SF).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_dependencies_are_not_broadcast(spark):
    # The files of ten packages a part were taken for a small table, whatever their number.
    assert "Broadcast" not in plan_of(own.QUERIES["dependency_limits"](spark, SF))


def test_trees_are_a_row_each(spark, monkeypatch):
    # Six dependencies of each package, and all packages of all trees, were written a row each before.
    rows, stored = [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name: (lambda out: rows.append(out.count()) or out)(stored(df, name)))
    own.QUERIES["dependency_limits"](spark, SF)
    # Ten packages a part, and a root by its own specifier.
    assert rows and max(rows) <= 11 * spark.read.parquet(f"{SF}/part.parquet").count()


def test_trees_begin_with_their_own_lists(spark, monkeypatch):
    # Roots were joined to their numbers and then to their lists, and lists moved by the root's name, before.
    plans, stored = [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name: (name == "trees" and plans.append(plan_of(df))) or stored(df, name))
    own.QUERIES["dependency_risks"](spark, SF)
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1, 4, 4] and not any("hashpartitioning(root" in p for p in plans[1:])


@pytest.mark.parametrize("reads, made", [(1, lambda spark, found: report.reports(*found)), (0, lambda spark, found: report.sarif_run(found[1])), (0, lambda spark, found: report.ignored(found[1], spark.createDataFrame([("low",)], "rule string")))])
def test_lines_are_read_once(spark, reads, made):
    # Reports read all lines twice before, a SARIF run three times and for its order again.
    assert plan_of(made(spark, own._found(spark, SF))).count("ArrowEvalPython") == reads


def test_lines_that_may_be_dense(spark):
    rng = random.Random(3)
    signs = [chr(c) for c in range(33, 127)] + list("éüñж漢")
    lines = ["".join(rng.choices(signs if rng.random() < share else "abcdefghijklmnopqrstuvwxyz ", k=1)[0] for _ in range(400)) for share in [k / 40 for k in range(41)] for _ in range(5)]
    rows = spark.createDataFrame([(x,) for x in lines], "t string").select(text.maybe_dense(F.col("t")), text.byte_entropy("t")).collect()
    assert all(may for may, entropy in rows if entropy > 5.5) and not all(may for may, _ in rows)


def test_needed_texts():
    assert all(p in patterns.NEEDED for p in [s[2] for s in patterns.STATIC] + [r[4] for r in patterns.RULES])


def test_grams_of_a_line_in_one_pass(spark):
    # Substrings by place count characters from the line's start, so a line cost the square of its length before.
    assert "regexp_extract_all(" in plan_of(own.QUERIES["rule_join"](spark, SF))


def test_addresses_are_read_once_a_package(spark):
    # The filter on a package's address was pushed below the distinct that packages are made by, to each of their files, before.
    for name in ("provenance", "provenance_listing"):
        assert "github" not in plan_of(own.QUERIES[name](spark, SF))
