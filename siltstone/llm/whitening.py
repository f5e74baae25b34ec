"""Whitening of embeddings from column aggregates.

One aggregation counts the vectors and sums each dimension; a second one, whose SQL expressions are
generated, sums the centred product of every pair of dimensions of the upper triangle. Both give one
row, whose width is set by the number of dimensions alone. The driver assembles the covariance from
it and LAPACK decomposes it; projecting is arithmetic over arrays.

Entries become whole numbers first: x = floor(SCALE * c) + SHIFT. Centring takes away the whole
number next to the mean, so products are whole and their sums are exact, in whatever order they
come, up to 2**53; the rest of the mean, less than one half, is taken out of the covariance after.

Defined cases: a vector that is null, or holds null or non-finite entries, is left out, and so is one
shorter than the longest, whose missing entries count as null; repeated rows count each; a null id
stays null; a component without variance can't be whitened and isn't returned; an empty table, or
one without such vectors, gives an empty result; a deviation too large for a long is null; scaled entries
beyond MOST, either way, count as MOST;
other columns are ignored. More pairs than PAIRS are summed in several aggregations.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
MOST = float(1 << 61)
#: Components that are returned at most.
COMPONENTS = 8
#: Pairs of dimensions in one aggregation.
PAIRS = 8192
#: A component with less than this share of the variance has none but for rounding.
NO_VARIANCE = 1e-12


@dataclass
class Model:
    """What fitting learns: counts, sums, and the components as columns of ``vectors``."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def centres(self) -> list[int]:
        """The whole numbers next to the means."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    @property
    def offsets(self) -> list[float]:
        """What the means are more than that."""
        return [(s - c * self.n) / self.n for s, c in zip(self.sums, self.centres, strict=True)]


def usable(embeddings: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of the vectors that are whole, and their number of dimensions."""
    vector = F.col(column).cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    whole = embeddings.select("vec_id", vector.alias("v")).where(F.col("v").isNotNull() & F.forall("v", finite))
    d = whole.agg(F.max(F.size("v"))).first()[0] or 0
    entry = lambda v: F.floor(F.least(F.greatest(v * SCALE, F.lit(-MOST)), F.lit(MOST))) + SHIFT
    return whole.where(F.size("v") == d).select("vec_id", F.transform("v", entry).alias("x")), d


@contextmanager
def _small_methods(spark: SparkSession) -> Iterator[None]:
    """Whole-stage code of thousands of sums is one method too long for the JVM to compile, so it is interpreted. For
    the actions inside, Spark uses its form of many small methods: a third of the time for each row."""
    key = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _pair_sums(terms: DataFrame) -> np.ndarray:
    """The sums of products of every pair of columns, as a symmetric matrix."""
    names = terms.columns
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    out = np.zeros((len(names), len(names)))
    for lo in range(0, len(pairs), PAIRS):
        part = pairs[lo : lo + PAIRS]
        with _small_methods(terms.sparkSession):
            got = terms.selectExpr(*(f"sum({names[i]} * {names[j]}) as p{k}" for k, (i, j) in enumerate(part))).first()
        for (i, j), value in zip(part, got, strict=True):
            out[i, j] = out[j, i] = value
    return out


def fit(rows: DataFrame, d: int) -> Model | None:
    """Components of all ``rows`` that ``usable`` gave; None if there are none."""
    if d == 0:
        return None
    with _small_methods(rows.sparkSession):
        n, *sums = rows.selectExpr("count(*)", *(f"sum(cast(x[{i}] as decimal(20, 0)))" for i in range(d))).first()
    model = Model(n, [int(s) for s in sums], np.zeros(0), np.zeros((d, 0)), 0.0)
    products = _pair_sums(rows.selectExpr(*(f"cast(x[{i}] - {c}L as double) as t{i}" for i, c in enumerate(model.centres))))
    rest = np.array(model.offsets)
    covariance = products / n - np.outer(rest, rest)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    model.trace = float(np.trace(covariance))
    keep = [k for k in range(min(COMPONENTS, d)) if values[k] > NO_VARIANCE * model.trace]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)])
    model.values, model.vectors = values[keep], (vectors * signs)[:, keep]
    return model


def _literal(values: Iterable[float | int], kind: str) -> Column:
    return F.array(*(F.lit(str(v)).cast(kind) for v in values))


def project(rows: DataFrame, model: Model) -> DataFrame:
    """(vec_id, deviation, w1, w2, ...): exact squared deviations, and whitened coordinates."""
    whole = "decimal(38, 0)"
    gaps = F.zip_with("x", _literal(model.sums, whole), lambda x, s: (x.cast("decimal(20, 0)") * F.lit(model.n).cast("decimal(18, 0)")).cast(whole) - s)
    squares = F.aggregate(gaps, F.lit(0).cast(whole), lambda total, g: F.try_add(total, F.try_multiply(g, g).cast(whole)).cast(whole))
    centred = F.zip_with(F.zip_with("x", _literal(model.centres, "long"), lambda x, c: (x - c).cast("double")), F.array(*map(F.lit, model.offsets)), lambda y, r: y - r)
    dot = lambda k: F.aggregate(F.zip_with("y", F.array(*map(F.lit, model.vectors[:, k].tolist())), lambda y, v: y * v), F.lit(0.0), lambda total, p: total + p)
    ready = rows.select("vec_id", squares.try_cast("long").alias("deviation"), centred.alias("y"))
    return ready.select("vec_id", "deviation", *((dot(k) / float(np.sqrt(model.values[k]))).alias(f"w{k + 1}") for k in range(len(model.values))))


def identity_error(projected: DataFrame, n: int, components: int) -> float:
    """The largest absolute entry of the whitened covariance minus the identity."""
    names = [f"w{k + 1}" for k in range(components)]
    means = [float(m) for m in projected.selectExpr(*(f"avg({w})" for w in names)).first()]
    products = _pair_sums(projected.selectExpr(*(f"{w} - {m!r}D as {w}" for w, m in zip(names, means, strict=True))))
    return float(np.abs(products / n - np.eye(components)).max())


def whiten(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each whole
    vector and component."""
    schema = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    rows, d = usable(embeddings, column)
    model = fit(rows, d)
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], schema.format(kind))
    projected = project(rows, model)
    error = identity_error(projected, model.n, len(model.values))
    one = lambda k: F.struct(F.lit(k + 1).alias("component"), F.col(f"w{k + 1}").alias("whitened"), F.lit(float(model.values[k] / model.trace)).alias("explained"))
    each = projected.select("vec_id", "deviation", F.explode(F.array(*(one(k) for k in range(len(model.values))))).alias("c"))
    return each.select("vec_id", "c.component", F.lit(model.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error"))
