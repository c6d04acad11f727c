"""Matrices of cells by times as packed series: products without a join of cells with cells.

A row holds a cell's whole series. A task turns its rows into dense slices, multiplies and adds up there; what it
hands on has the size of the product, whatever the number of cells, and products of tasks are added as a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a dense slice.
SLICE = 1 << 21
#: Times that may be numbered on the driver.
MOST_TIMES = 1 << 17


def numbered(df: DataFrame, column: str, most: int = MOST_TIMES) -> list:
    """The distinct values of a column in their order; refused above ``most``."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} values of {column}")
    return found


def pack(df: DataFrame, rows: list[str], column: str, values: list, value: str = "value") -> DataFrame:
    """(rows, series): a row a cell, whose series has (place of the column's value, value); NULL counts as nothing."""
    kind = df.schema[column].dataType.simpleString()
    places = df.sparkSession.createDataFrame(list(zip(values, range(len(values)), strict=True)), f"_c {kind}, _k int")
    placed = df.where(F.col(value).isNotNull()).join(F.broadcast(places), F.col(column) == F.col("_c"))
    return placed.groupBy(*rows).agg(F.collect_list(F.struct(F.col("_k").alias("k"), F.col(value).cast("double").alias("x"))).alias("series"))


def dense(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch of packed rows with their matrices; values at one place add up."""
    step = max(1, SLICE // max(1, width))
    for lo in range(0, batch.num_rows, step):
        part = batch.slice(lo, step)
        series = part.column(part.num_columns - 1)
        inner, sizes = series.flatten(), series.value_lengths().to_numpy()
        out = np.zeros((part.num_rows, width))
        np.add.at(out, (np.repeat(np.arange(part.num_rows), sizes), inner.field(0).to_numpy()), inner.field(1).to_numpy())
        yield part, out


def summed_product(packed: DataFrame, width: int, make: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``make``(slice), a flat array of ``size`` numbers, over all slices: by task, then in parts, then all."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for _, x in dense(batch, width):
                total += make(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    parts = packed.select("series").mapInArrow(multiply, "sum binary")
    # as many parts as their bytes need: adaptive execution brings small ones together
    parts = parts.repartition(F.spark_partition_id()).mapInArrow(add, "sum binary")
    total = np.zeros(size)
    for r in parts.toLocalIterator():
        total += np.frombuffer(bytes(r[0]))
    return total


def gram_matrix(packed: DataFrame, width: int) -> np.ndarray:
    """Products of all pairs of columns, summed over rows."""
    return summed_product(packed, width, lambda x: (x.T @ x).reshape(-1), width * width).reshape(width, width)


def leading_columns(packed: DataFrame, width: int, modes: int, tolerance: float = 1e-10, most_rounds: int = 60, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """The leading eigenvalues and eigenvectors (over columns) of the Gram matrix, and its trace, without the matrix itself.

    Randomized subspace iteration that keeps its earlier blocks (block Krylov): each round is one pass over the packed rows, which
    multiplies a few vectors by the matrix. Rounds end when the residuals are below ``tolerance`` times the first eigenvalue.
    """
    block = min(width, modes + 4)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, block)))[0]
    basis, image = np.zeros((width, 0)), np.zeros((width, 0))
    trace = 0.0
    for _ in range(most_rounds):
        n = q.shape[1]
        got = summed_product(packed, width, lambda x, q=q: np.append((x.T @ (x @ q)).reshape(-1), (x * x).sum()), width * n + 1)
        z, trace = got[:-1].reshape(width, n), float(got[-1])
        basis, image = np.hstack([basis, q]), np.hstack([image, z])
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:modes], vectors[:, ::-1][:, :modes]
        lead = basis @ vectors
        far = np.linalg.norm(image @ vectors - lead * values, axis=0)
        # what the matrix adds to the space that is there; twice, against rounding
        for _ in range(2):
            z = z - basis @ (basis.T @ z)
        u, s, _ = np.linalg.svd(z, full_matrices=False)
        q = u[:, s > 1e-13 * max(trace, 1e-300)]
        if (far <= tolerance * max(values[0], 1e-300)).all() or not q.shape[1] or basis.shape[1] >= width:
            break
    else:
        raise ValueError(f"no convergence in {most_rounds} rounds")
    return values, lead, trace


def times_columns(packed: DataFrame, rows: list[str], columns: np.ndarray) -> DataFrame:
    """(rows, mode, loading): each row's series times each column of a matrix; modes count from 1."""
    width, modes = columns.shape

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in dense(batch, width):
                got = x @ columns
                place = pa.array(np.repeat(np.arange(part.num_rows), modes))
                keys = [part.column(k).take(place) for k in range(len(rows))]
                mode = pa.array(np.tile(np.arange(1, modes + 1, dtype=np.int32), part.num_rows))
                yield pa.RecordBatch.from_arrays([*keys, mode, pa.array(got.reshape(-1))], [*rows, "mode", "loading"])

    kinds = [f"{c} {packed.schema[c].dataType.simpleString()}" for c in rows]
    return packed.select(*rows, "series").mapInArrow(multiply, ", ".join([*kinds, "mode int", "loading double"]))
