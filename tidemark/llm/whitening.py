"""Whitening of embeddings by their principal components.

Entries are made whole numbers, so that equal vectors are found exactly. Equal vectors are grouped with
their counts, a pass over the distinct ones gives sums, another the weighted covariance as products of
centred blocks; its eigenvectors whiten each distinct vector once, and the rows look theirs up. Vectors
held by a thousandth of all rows or more, of which there are a thousand at most, are broadcast; the
others meet their rows in a shuffle in which no key is large.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

#: Entries are floored multiples of 1 / SCALE.
SCALE = 256
COMPONENTS = 4
#: Distinct vectors that a task multiplies at once.
BLOCK_ROWS = 4096
#: A vector of more rows than one in so many is joined by broadcast, so at most so many are.
HOT_PART = 1000
#: Entries beyond this are cut to it; 2**31 leaves the exact sums of 2**30 vectors within 64 bits.
LARGEST = 2**31


@dataclass(frozen=True)
class Fit:
    """Sums and components of the fit list: distinct vectors, each weighted."""

    dims: int
    n: int
    sums: list[int]
    values: list[float]
    vectors: list[list[float]]
    trace: float


def whole_entries(vector: str | Column) -> Column:
    """floor(SCALE * entry) as longs; null for vectors that are null or hold null or non-finite
    entries, or have none."""
    c = F.col(vector) if isinstance(vector, str) else vector
    most = F.lit(float(LARGEST))

    def finite(e: Column) -> Column:
        d = e.cast("double")
        return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))

    def whole(e: Column) -> Column:
        return F.floor(F.greatest(-most, F.least(most, e.cast("double") * SCALE))).cast("long")

    return F.when(F.coalesce(F.forall(c, finite), F.lit(False)) & (F.size(c) > 0), F.transform(c, whole))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Vectors (rows, dims) and weights of batches with columns x and weight."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            flat = part.column("x").flatten().to_numpy(zero_copy_only=False)
            yield flat.reshape(part.num_rows, -1), part.column("weight").to_numpy(zero_copy_only=False), part


def _gathered(partial: DataFrame, what: str) -> np.ndarray:
    """Sum over tasks of the entries (i, value), by i; as many as one task has, whatever the rows."""
    rows = partial.groupBy("i").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(rows), object if what == "exact" else float)
    for r in rows:
        out[r.i] = int(r.value) if what == "exact" else r.value
    return out


def _sums(fit_list: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Total weight, and the weighted sum of each dimension, exactly."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (dims + 1)
        for x, weight, _ in _blocks(batches):
            # Halves keep the sums of a block within 64 bits.
            low, high = x & 0xFFFF, x >> 16
            for part, shift in ((low, 0), (high, 16)):
                for i, s in enumerate((part * weight[:, None]).sum(axis=0).tolist()):
                    total[i] += s << shift
            total[dims] += int(weight.sum())
        yield pa.RecordBatch.from_pydict(
            {"i": pa.array(range(dims + 1), pa.int32()), "value": pa.array([str(t) for t in total])}
        )

    rows = fit_list.select("x", "weight").mapInArrow(added, "i int, value string")
    sums = _gathered(rows.select("i", F.col("value").cast("decimal(38,0)").alias("value")), "exact")
    return (int(sums[dims]), sums[:dims].tolist()) if len(sums) else (0, [0] * dims)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: longs where they fit, else Python's integers."""
    limit = max(int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0), 1)
    if limit < 2**62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _squares(apart: np.ndarray) -> list[int]:
    """Exact sums of squares, by row."""
    most = int(np.abs(apart).max(initial=0))
    if apart.shape[1] * most * most < 2**63:
        return (apart * apart).sum(axis=1).tolist()
    return [sum(d * d for d in row) for row in apart.tolist()]


def _covariance(fit_list: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    dims = len(sums)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for x, weight, _ in _blocks(batches):
            apart = centred(x, n, sums).astype(float) / n
            total += (apart * weight[:, None]).T @ apart
        yield pa.RecordBatch.from_pydict(
            {"i": pa.array(range(dims * dims), pa.int32()), "value": pa.array(total.ravel())}
        )

    total = _gathered(fit_list.select("x", "weight").mapInArrow(multiplied, "i int, value double"), "float")
    return total.reshape(dims, dims) / n


def fit(fit_list: DataFrame, dims: int, components: int = COMPONENTS) -> Fit:
    """Components of ``fit_list`` (x, weight), vectors of ``dims`` entries; the driver holds dims**2
    numbers. An eigenvalue that is nothing but rounding counts as 0."""
    n, sums = _sums(fit_list, dims)
    values, vectors = np.linalg.eigh(_covariance(fit_list, n, sums))
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(values.sum())
    least = max(trace, 0.0) * dims * np.finfo(float).eps
    kept = [float(v) if v > least else 0.0 for v in values[order]]
    axes = vectors[:, order].T
    top = np.abs(axes).argmax(axis=1)
    axes = axes * np.sign(axes[np.arange(len(axes)), top])[:, None]
    return Fit(dims, n, sums, kept, axes.tolist(), trace)


def whiten_distinct(distinct: DataFrame, model: Fit) -> DataFrame:
    """``distinct`` (key, x, weight) to key, weight, ``deviation`` (sum of (n*x - sums)**2 over dimensions, null
    beyond 64 bits) and ``whitened``, one entry a component, null where its eigenvalue is 0."""

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = [1 / np.sqrt(v) if v else np.nan for v in model.values]
        axes = np.array(model.vectors).reshape(len(scale), model.dims).T
        for x, _, part in _blocks(batches):
            apart = centred(x, model.n, model.sums)
            squares = _squares(apart)
            white = (apart.astype(float) / model.n) @ axes * np.array(scale)
            flat = pa.array(white.ravel(), mask=np.isnan(white.ravel()))
            ends = np.arange(len(white) + 1, dtype=np.int32) * len(scale)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"),
                    part.column("weight"),
                    pa.array([s if s < 2**63 else None for s in squares], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), flat),
                ],
                names=["key", "weight", "deviation", "whitened"],
            )

    schema = "key binary, weight long, deviation long, whitened array<double>"
    return distinct.select("key", "x", "weight").mapInArrow(projected, schema)


def identity_error(white: DataFrame, components: list[int]) -> float | None:
    """Largest absolute entry of the weighted covariance of ``whitened``, centred, minus the identity."""
    if not components:
        return None
    w = F.col("weight")
    y = [F.col("whitened")[c] for c in components]
    n, *sums = white.agg(F.sum(w), *[F.sum(w * c) for c in y]).first()
    apart = [c - F.lit(s / n) for c, s in zip(y, sums)]
    pairs = [(a, b) for a in range(len(y)) for b in range(a, len(y))]
    products = white.agg(*[F.sum(w * apart[a] * apart[b]) for a, b in pairs]).first()
    return max(abs(p / n - (a == b)) for p, (a, b) in zip(products, pairs))


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
    by_count: bool = False,
) -> DataFrame:
    """The id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained and
    identity_error, for each row and component.

    The fit list holds each distinct vector of whole entries once, or as often as rows hold it if
    ``by_count``. Rows whose vector is null, empty or holds null or non-finite entries are left out.
    Vectors of another length than most have (of ties the longest) take no part in the fit and keep
    rows with null figures. Where all vectors are equal, or lie in fewer dimensions than there are
    components, ``whitened`` is null for the components without spread, ``explained`` 0 (null where
    nothing has any), and identity_error judges the others. Entries beyond LARGEST / SCALE count as
    that. Null and repeated ids and repeated rows keep their rows; other columns are not looked at; an
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    whole = vectors.select(F.col(id_col).alias("id"), whole_entries(vector).alias("x")).where("x IS NOT NULL")
    digest = F.unhex(F.sha2(F.col("x").cast("string").cast("binary"), 256))
    rows = staged(whole.withColumn("key", digest), "whole-vectors")
    distinct = staged(rows.groupBy("key", "x").agg(F.count(F.lit(1)).alias("count")), "distinct-vectors")
    lengths = (
        distinct.groupBy(F.size("x").alias("dims"))
        .agg(F.sum("count").alias("rows"))
        .agg(F.max(F.struct("rows", "dims")).alias("most"), F.sum("rows").alias("rows"))
        .first()
    )
    schema = (
        "component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    if lengths.most is None:
        return spark.createDataFrame([], f"id string, {schema}").select(
            F.lit(None).cast(vectors.schema[id_col].dataType).alias(id_col), *[c.split()[0] for c in schema.split(", ")]
        )
    fit_list = distinct.where(F.size("x") == lengths.most.dims).withColumn(
        "weight", F.col("count") if by_count else F.lit(1).cast("long")
    )
    model = fit(fit_list, lengths.most.dims, components)
    white = staged(whiten_distinct(fit_list, model), "white-vectors")
    spread = [c for c, v in enumerate(model.values) if v]
    error = identity_error(white, spread)

    # Vectors of many rows are few, so their rows need no shuffle.
    hot = distinct.where(F.col("count") * HOT_PART > lengths.rows).select("key")
    figures = white.select("key", "deviation", "whitened")
    keyed = rows.select("id", "key")
    looked_up = (
        keyed.join(F.broadcast(hot), "key", "left_semi")
        .join(F.broadcast(figures.join(F.broadcast(hot), "key", "left_semi")), "key", "left")
        .unionByName(keyed.join(F.broadcast(hot), "key", "left_anti").join(figures, "key", "left"))
    )

    parts = F.array(
        *[
            F.struct(
                F.lit(c + 1).alias("component"),
                F.col("whitened")[c].alias("whitened"),
                F.lit(v / model.trace if model.trace > 0 else None).cast("double").alias("explained"),
            )
            for c, v in enumerate(model.values)
        ]
    )
    fitted = F.col("whitened").isNotNull()
    return looked_up.select(
        F.col("id").alias(id_col),
        F.when(fitted, F.lit(model.n)).cast("long").alias("n"),
        "deviation",
        F.when(fitted, F.lit(error)).cast("double").alias("identity_error"),
        F.when(fitted, F.lit(True)).alias("fitted"),
        F.explode(parts).alias("part"),
    ).select(
        id_col,
        "part.component",
        "n",
        "deviation",
        "part.whitened",
        F.when(F.col("fitted"), F.col("part.explained")).alias("explained"),
        "identity_error",
    )
