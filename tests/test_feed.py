"""Streams that compare versions, and archives as a data source."""

import hashlib
import io
import tarfile
import time

import pytest
from pyspark.sql import functions as F

from siltstone.operators import code, metadata
from siltstone.operators import versions as versions_of
from siltstone.plans import report
from siltstone.sources import archives
from siltstone.sources import packages as sources
from siltstone.streaming import feed, history

PUBLISHED = "package string, version string, publish_ts string, maintainers array<struct<name: string, email: string>>, `Prev` int"
FILES = "package string, version string, path string, content string, published_at string"


def arrivals(spark, folder, batches, schema):
    """A table of one file a batch, and the stream that reads them one by one."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder), spark.read.parquet(folder)


def published(spark, tmp_path):
    a, z = [("a", "a@x.example")], [("z", "z@x.example")]
    batches = [
        [("p", "1", "2026-01-01", a, 1), ("p", "2", "2026-01-02", a, 1), ("q", "1", "2026-01-01", None, 1), (None, "1", "t", None, 1), ("p", None, "t", a, 1)],
        [("p", "1", "2026-01-01", a, 2), ("p", "0", "2025-01-01", z, 2), ("p", "3", "2026-01-03", [("b", "b@x.example"), ("c", None)], 2)],
        [("p", "2.5", "2026-01-02T5", [("c", "c@y.example")], 3), ("q", "0", None, [("n", None)], 3), ("r", "1", "t", [], 3), ("p", "3", "2026-01-03", [("b", "b@x.example"), ("c", None)], 3)],
    ]
    return arrivals(spark, str(tmp_path / "in"), batches, PUBLISHED)


def test_last_two_of_a_stream(spark, tmp_path):
    stream, table = published(spark, tmp_path)
    changes = history.collected(history.last_two(stream), "t")
    assert changes.where("package = 'p'").count() == 3  # no row for what changes nothing
    columns = ("package", "prev", "last")
    got = {r["package"]: tuple(r) for r in history.current(changes).select(*columns).collect()}
    want = {r["package"]: tuple(r) for r in metadata.last_two(table.where("package is not null and version is not null")).select(*columns).collect()}
    assert got == want and set(got) == {"p", "q", "r"} and got["p"][1]["version"] == "2.5"
    titles = {(r["package"], r["title"]) for r in metadata.maintainer_changes(history.pairs(history.current(changes))).collect()}
    assert titles == {("p", "New maintainer added"), ("p", "New maintainer added recently"), ("q", "Complete ownership transfer")} - {("q", "Complete ownership transfer")}
    assert history.last_two(stream.where("false")).isStreaming


def test_stream_of_maintainer_findings(spark, tmp_path):
    stream, _ = published(spark, tmp_path)
    history.prepared(spark)
    want = {("3", "Complete ownership transfer"), ("3", "New maintainer added")}
    query = history.maintainer_findings(stream, ttl_ms=3_600_000).writeStream.format("memory").queryName("people").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    ends = time.monotonic() + 60
    while time.monotonic() < ends and not {(r["version"], r["title"]) for r in spark.table("people").where("package = 'p'").collect()} >= want:
        time.sleep(0.5)
    query.stop()
    assert {(r["version"], r["title"]) for r in spark.table("people").where("package = 'p'").collect()} >= want


def test_diff_of_a_stream(spark, tmp_path):
    stream, table = published(spark, tmp_path)
    contents = [("p", v, "index.js", f"{body}\n") for v, body in (("1", "ok"), ("2", "ok"), ("2.5", "ok"), ("3", "eval(x)"))] + [("p", "3", "payload.js", "1"), ("q", "0", "i.js", "1"), ("q", "1", "i.js", "require('child_process')")]
    spark.createDataFrame(contents, "package string, version string, path string, content string").write.parquet(str(tmp_path / "files"))
    out = str(tmp_path / "out")
    write = history.diff_sink(str(tmp_path / "files"), out)
    history.prepared(spark)
    history.last_two(stream).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    files = spark.read.parquet(str(tmp_path / "files"))
    two = metadata.last_two(table.where("package is not null and version is not null")).where("prev is not null").select("package", F.col("prev.version").alias("old_version"), F.col("last.version").alias("new_version"))
    of = lambda c: files.join(two.select("package", F.col(c).alias("version")), ["package", "version"], "left_semi")
    want = {tuple(r) for r in versions_of.diff(of("old_version"), of("new_version"), two).drop("description").collect()}
    got = {tuple(r) for r in spark.read.parquet(out).where("batch = 2").drop("batch", "description").collect()}
    assert got == want and {t[5] for t in got if t[0] == "p"} and any(t[0] == "q" for t in got)
    again = spark.read.parquet(out).count()
    write(history.current(history.collected(history.last_two(stream), "t")), 2)
    assert spark.read.parquet(out).count() == again


def test_scores_of_a_stream(spark, tmp_path):
    at = "2026-01-01 00:00:00"
    batches = [[("p", "1", "i.js", "eval(x)", at), ("q", "1", "i.js", "ok", at)], [("p", "1", "i.js", "eval(x)", at), ("p", "1", "j.js", "fetch(u)\neval(y)", at)], [("q", "1", "k.js", 'var h = "' + "0123456789abcdef" * 8 + '";', at), ("r", "1", "n.js", None, at)]]
    stream, table = arrivals(spark, str(tmp_path / "in"), batches, FILES)
    timed = stream.withColumn("published_at", F.col("published_at").cast("timestamp"))
    out = str(tmp_path / "out")
    feed.line_findings(timed).writeStream.foreachBatch(history.score_sink(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, history.scores(table, spark.read.parquet(out)).collect()))
    assert got == sorted(map(tuple, report.scores(table, code.line_findings(table.distinct())).collect()))
    assert {r[0]: r[-1] for r in got}["r"] == "Clean" and len(got) == 3


def archive(*members, mode="w:gz"):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode=mode) as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("package/link.js")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        tar.addfile(link)
    return buffer.getvalue()


@pytest.fixture
def folder(tmp_path):
    put = {
        "left/-/left-1.0.0.tgz": archive(("package/index.js", b"eval(x)"), ("package/empty.js", b"")),
        "left/-/left-1.1.0.tgz": archive(("package/index.js", bytes(range(256)) * 40)),
        "@scope/core/-/core-2.0.0-rc.1.tgz": archive(("package/i.js", b"1"), ("package/i.js", b"2")),
        "flat-pkg-0.3.0.tar": archive(("package/a.wasm", b"\0asm"), mode="w"),
        "broken/-/broken-1.0.0.tgz": b"no archive",
        "cut/-/cut-1.0.0.tgz": archive(("package/a.js", b"a"), ("package/b.js", b"".join(hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(2_000))))[:-9_000],
        "none/-/none-1.0.0.tgz": b"",
        "notes.txt": b"x",
    }
    for path, data in put.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    return str(tmp_path)


def test_archive_source(spark, folder):
    entries = archives.read(spark, folder, partBytes="1000", targetBytes="2000")
    assert entries.rdd.getNumPartitions() > 1
    good = {(r["package"], r["version"], r["path"], bytes(r["data"])) for r in archives.whole(entries.where("error is null")).collect()}
    assert good == {("left", "1.0.0", "package/index.js", b"eval(x)"), ("left", "1.0.0", "package/empty.js", b""), ("left", "1.1.0", "package/index.js", bytes(range(256)) * 40), ("@scope/core", "2.0.0-rc.1", "package/i.js", b"1"), ("@scope/core", "2.0.0-rc.1", "package/i.js", b"2"), ("flat-pkg", "0.3.0", "package/a.wasm", b"\0asm"), ("cut", "1.0.0", "package/a.js", b"a")}
    assert {r["package"] for r in entries.where("error is not null").collect()} == {"broken", "cut", "none"}
    assert entries.where("part > 0").agg(F.max(F.length("data"))).first()[0] <= 1000
    assert entries.where("package = 'left'").count() == 13 and entries.count() > 20  # what one query filters, the next reads
    named = archives.read(spark, folder, packages="left,@scope/core")
    assert {r["package"] for r in named.select("package").collect()} == {"left", "@scope/core"}
    scripts = sources.script_files(sources.rooted(sources.safe(archives.whole(named))))
    assert {(r["package"], r["path"]) for r in scripts.collect()} == {("left", "index.js"), ("left", "empty.js"), ("@scope/core", "i.js")}


def test_archive_source_without_archives(spark, tmp_path):
    assert archives.read(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="gone"):
        archives.read(spark, str(tmp_path / "gone")).count()


def test_pack(spark, tmp_path):
    rows = [(f"package/f{i}.js", bytes([i % 256]) * i) for i in range(300)] + [("package/null.js", None)]
    df = spark.createDataFrame(rows, "path string, data binary").repartition(3)
    assert archives.pack(df, str(tmp_path / "a"), most_bytes=5_000) > 6
    got = {r["path"]: bytes(r["data"]) for r in archives.whole(archives.read(spark, str(tmp_path / "a"), partBytes="64")).collect()}
    assert got == {p: d or b"" for p, d in rows}
    assert archives.pack(df, str(tmp_path / "a"), most_bytes=5_000) and archives.read(spark, str(tmp_path / "a")).count() == 301
