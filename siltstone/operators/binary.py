"""Findings from binary files (package, version, path, data)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.functions import text

#: Fixed values.
NATIVE, WASM = ("node", "exe", "dll", "so", "dylib"), ("wasm",)
SHELLS = ("/bin/sh", "/bin/bash", "/bin/zsh", "cmd.exe", "powershell", "command.com")
CREDENTIALS = ("AWS_SECRET", "AWS_ACCESS_KEY", "NPM_TOKEN", "npm_token", "password", "passwd", ".npmrc", ".ssh/", "id_rsa", "id_ed25519", "GITHUB_TOKEN", "GH_TOKEN", "PRIVATE_KEY")
URLS = ("http://", "https://", "ftp://", "ws://", "wss://")


def strings(binaries: DataFrame) -> DataFrame:
    """(package, version, path, pos, s): runs of four or more printable ASCII characters."""
    return binaries.select("package", "version", "path", F.posexplode(_runs(F.col("data"))).alias("pos", "s"))


def _runs(data: Column) -> Column:
    return F.regexp_extract_all(F.decode(data, "ISO-8859-1"), F.lit("[ -~]{4,}"), F.lit(0))


def scan(binaries: DataFrame) -> DataFrame:
    """Each binary is read once: its findings are one array, from its path, its strings and its entropy."""
    ext = F.lower(text.extension(F.col("path")))
    known = binaries.where(ext.isin(*NATIVE, *WASM))
    native = ext.isin(*NATIVE)
    size, path = F.octet_length("data"), F.col("path")
    families = [("Shell command in binary: ", SHELLS), ("Credential string in binary: ", CREDENTIALS), ("URL embedded in binary: ", URLS)]
    holds = lambda s, words: reduce(lambda a, b: a | b, (s.contains(w) for w in words))
    finding = lambda severity, title, about, seq, snippet=F.lit(None): F.struct(severity.alias("severity"), title.alias("title"), about.alias("about"), snippet.cast("string").alias("snippet"), seq.cast("long").alias("seq"))
    string = lambda r, i, title: finding(F.lit("Critical"), F.concat(F.lit(title), path), F.concat(F.lit("String "), r["at"].cast("string"), F.lit(" of the binary: "), text.truncate_bytes(r["s"], 60)), F.lit(i) * 1_000_000 + r["at"], text.truncate_bytes(r["s"], 100))
    runs = F.filter(F.transform(_runs(F.col("data")), lambda x, k: F.struct((k + 1).alias("at"), x.alias("s"))), lambda r: holds(r["s"], (*SHELLS, *CREDENTIALS, *URLS)))
    of_strings = F.flatten(F.transform(runs, lambda r: F.array_compact(F.array(*(F.when(holds(r["s"], words), string(r, i, title)) for i, (title, words) in enumerate(families))))))
    of_kind = finding(F.when(native, "High").otherwise("Medium"), F.concat(F.when(native, "Native binary file: ").otherwise("WebAssembly file: "), path), F.concat(F.lit("Compiled code, "), size.cast("string"), F.lit(" bytes, that no source shows")), F.lit(0))
    dense = finding(F.lit("High"), F.concat(F.lit("High-entropy binary: "), path), F.concat(F.format_number("entropy", 2), F.lit(" bits a byte: packed or encrypted content")), F.lit(9_000_000))
    told = known.withColumn("entropy", text.byte_entropy(F.when(size > 1024, F.col("data"))))
    all_ = F.concat(F.array(of_kind), F.coalesce(of_strings, F.array().cast(known.select(F.array(finding(*map(F.lit, ("", "", "", 0))))).schema[0].dataType)), F.array_compact(F.array(F.when(F.col("entropy") > 7.5, dense))))
    each = told.select("package", "version", "path", F.explode(all_).alias("f"))
    return schema.findings(each, "binary", F.col("f.severity"), "BinaryFile", F.col("f.title"), F.col("f.about"), path, None, F.col("f.snippet"), F.col("f.seq"))
