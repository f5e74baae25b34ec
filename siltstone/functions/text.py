"""Scalar functions over text, as Column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = " \t\n\r\x0b\x0c"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def truncate(text: Column, most: int) -> Column:
    """Trimmed; more than ``most`` characters are cut and marked."""
    t = trimmed(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(most)), F.lit("...")))


def truncate_bytes(text: Column, most: int) -> Column:
    """Untrimmed; more than ``most`` bytes are cut to ``most`` characters and marked."""
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), F.lit("...")))


def lines(content: Column) -> Column:
    """Lines as an array: split at line feeds, one carriage return cut from each, no empty last line."""
    body = F.when(content.endswith("\n"), F.left(content, F.length(content) - 1)).otherwise(content)
    rows = F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))
    cut = F.transform(rows, lambda x: F.when(x.endswith("\r"), F.left(x, F.length(x) - 1)).otherwise(x))
    return F.when(content.contains("\r"), cut).otherwise(rows)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """After the last dot of the file name; empty without one or where it only leads the name."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)


def built(path: Column) -> Column:
    """Whether a directory of build output holds the path, in any case: no sign but ASCII capitals has one of these letters in lower case."""
    return path.rlike("(?i)(^|/)(dist|bundle|build|umd|cjs|esm)/")


def minified(path: Column) -> Column:
    return basename(path).contains(".min.")


#: Bytes of texts whose histograms are counted at one time.
COUNT_BYTES = 1 << 20


@F.arrow_udf(T.DoubleType())
def byte_entropy(data: pa.Array) -> pa.Array:
    """Shannon entropy in bits of the bytes of a text or a binary; 0 if empty or null.

    Histograms are made of many short texts at one time, and of a long one in pieces."""
    v = data.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(v.buffers()[1], np.int64)[v.offset : v.offset + len(v) + 1]
    held = np.frombuffer(v.buffers()[2] or b"", np.uint8)
    out, lo = np.zeros(len(v)), 0
    while lo < len(v):
        hi = max(lo + 1, min(lo + 1024, int(np.searchsorted(ends, ends[lo] + COUNT_BYTES, "right")) - 1))
        sizes = np.diff(ends[lo : hi + 1])
        if hi == lo + 1:
            pieces = range(int(ends[lo]), int(ends[hi]), COUNT_BYTES)
            counts = sum((np.bincount(held[k : min(k + COUNT_BYTES, int(ends[hi]))], minlength=256) for k in pieces), np.zeros(256, np.int64))[None]
        else:
            counts = np.bincount(np.repeat(np.arange(hi - lo) << 8, sizes) + held[ends[lo] : ends[hi]], minlength=(hi - lo) << 8).reshape(-1, 256)
        p = counts / np.maximum(sizes, 1)[:, None]
        out[lo:hi] = -(p * np.log2(p, out=np.zeros_like(p), where=p > 0)).sum(axis=1) + 0.0
        lo = hi
    return pa.array(out)


def maybe_dense(text: Column) -> Column:
    """False only for texts whose bytes have an entropy below 5.5: with 91 of 100 bytes or more among a
    to z and the space it is 5.47 bits at most (0.437 for the share, 0.91 log2 27 and 0.09 log2 229)."""
    return 100 * F.octet_length(F.regexp_replace(text, "[a-z ]+", "")) > 9 * F.octet_length(text)


def glob_pattern(glob: str) -> str:
    """A file-name glob (* ? [..]) as a regular expression for whole strings."""
    import re

    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            while glob[i : i + 1] == "*":
                i += 1
            out += ".*"
            continue
        if c == "?":
            out += "."
        elif close > 0:
            body = glob[i + 1 : close]
            out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"
