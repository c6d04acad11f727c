"""Block bootstrap on sufficient statistics.

Weights are alike within a block, so that sums are made by block once and every replicate weighs those: the sums of a
key's blocks are packed in one row, and all its replicates are one product with the counts of draws.

Counts are made where they are needed. A replicate's counts are multinomial, and a tree of conditional binomials over ranges of
blocks gives them: how many of a range's draws fall into its left half is one keyed number by inversion. They are the same
everywhere, whatever the partitions, and no table of them passes through the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import cut

#: Replicates that share a hash, each with 32 bits of it; and numbers of a dense slice.
LANES, SLICE = 4, 1 << 21


def keyed_uniforms(replicates: np.ndarray, *keys: str) -> np.ndarray:
    """(key, replicate): numbers in (0, 1) by md5 of ``key`` and of the replicate over LANES; a key is ``seed|{}|rest``."""
    groups = range(int(replicates[0]) // LANES, int(replicates[-1]) // LANES + 1)
    raw = b"".join(hashlib.md5(key.format(g).encode()).digest() for key in keys for g in groups)
    found = (np.frombuffer(raw, ">u4").reshape(len(keys), -1) + 0.5) / 4294967296.0
    return found[:, replicates - groups[0] * LANES]


@lru_cache(maxsize=1 << 14)
def _cumulated(n: int, p: float) -> tuple[int, np.ndarray]:
    """The binomial distribution function from the first place that matters on: ten deviations hold all that 32 bits can tell."""
    wide = 10 * math.sqrt(n * p * (1 - p)) + 10
    low, high = max(0, math.floor(n * p - wide)), min(n, math.ceil(n * p + wide))
    # one term by logarithms, its neighbours by their ratio
    k = np.arange(low, high)
    steps = np.concatenate([[0.0], np.cumsum(np.log((n - k) / (k + 1) * (p / (1 - p))))])
    first = math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) + low * math.log(p) + (n - low) * math.log1p(-p)
    return low, np.cumsum(np.exp(first + steps))


def binomials(n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """The least k whose distribution function reaches u, for each n and u."""
    out = np.zeros(n.shape, np.int64)
    order = np.argsort(n, axis=None, kind="stable")
    values, starts = np.unique(n.reshape(-1)[order], return_index=True)
    for value, lo, hi in zip(values.tolist(), starts, [*starts[1:], len(order)], strict=True):
        if value:
            at = order[lo:hi]
            first, cumulated = _cumulated(value, p)
            out.reshape(-1)[at] = first + np.minimum(np.searchsorted(cumulated, u.reshape(-1)[at]), len(cumulated) - 1)
    return out


@lru_cache(maxsize=4)
def draw_counts(seed: int, first: int, last: int, blocks: int) -> np.ndarray:
    """(replicate, block): how often each replicate from ``first`` to ``last`` draws each of ``blocks`` blocks, as many draws as blocks; replicate 0 is the sample as it is.

    A worker keeps the counts between tasks: two bytes a replicate and block.
    """
    replicates = np.arange(first, last + 1)
    size = 1 << max(0, blocks - 1).bit_length()
    counts, starts = np.full((1, len(replicates)), blocks, np.int64), np.zeros(1, np.int64)
    while size > 1:
        half = size // 2
        left, total = np.minimum(blocks, starts + half) - starts, np.minimum(blocks, starts + size) - starts
        taken = counts.copy()
        for share in np.unique(left[left < total] / total[left < total]).tolist():
            at = np.flatnonzero((left < total) & (left / total == share))
            u = keyed_uniforms(replicates, *(f"{seed}|{{}}|{size}|{s}" for s in starts[at].tolist()))
            taken[at] = binomials(counts[at], share, u)
        right = left < total
        counts, starts = np.concatenate([taken, (counts - taken)[right]]), np.concatenate([starts, starts[right] + half])
        size = half
    out = np.zeros((len(replicates), blocks), np.uint16)
    out[:, starts] = counts.T
    out[replicates == 0] = 1
    return out


@dataclass(frozen=True)
class Draws:
    """Blocks with their places (block, k), how many there are, and the replicates that are drawn from them."""

    blocks: DataFrame
    count: int
    replicates: int
    seed: int


def block_numbers(blocks: DataFrame, block: str = "block") -> DataFrame:
    """Blocks with numbers 0..n-1 in their order; there is a row a block: a calendar's months, seasons or inits."""
    distinct = blocks.select(block).distinct()
    return distinct.withColumn("k", F.row_number().over(Window.orderBy(block)) - 1)


def draws(rows: DataFrame, replicates: int = 1000, seed: int = 0, block: str = "block") -> Draws:
    """Replicates of the blocks that ``rows`` have. Only their number reaches the driver."""
    numbered = cut(block_numbers(rows.where(F.col(block).isNotNull()), block).select(F.col(block).alias("block"), "k"))
    return Draws(numbered, numbered.count(), replicates, seed)


def weights(drawn: Draws) -> DataFrame:
    """(replicate, block, weight) of the blocks that each replicate draws; replicate 0 is the sample as it is."""
    count, seed = drawn.count, drawn.seed

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids = batch.column(0).slice(at, 64).to_numpy()
                counts = draw_counts(seed, int(ids[0]), int(ids[-1]), count)
                r, k = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array((ids[r]).astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(counts[r, k].astype(np.int32))], ["replicate", "k", "weight"])

    found = drawn.blocks.sparkSession.range(drawn.replicates + 1 if count else 0).mapInArrow(make, "replicate int, k int, weight int")
    return found.join(drawn.blocks, "k").select("replicate", "block", "weight")


def pair_sums(df: DataFrame, by: list[str], f: str, o: str) -> DataFrame:
    """The six sums of a correlation."""
    x, y = F.col(f), F.col(o)
    whole = df.where(x.isNotNull() & y.isNotNull())
    return whole.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("f"), F.sum(y).alias("o"), F.sum(x * x).alias("ff"), F.sum(y * y).alias("oo"), F.sum(x * y).alias("fo"))


SUMS = ("n", "f", "o", "ff", "oo", "fo")


def _packed(sums: DataFrame, drawn: Draws, by: list[str], columns: tuple[str, ...], block: str) -> DataFrame:
    placed = sums.join(drawn.blocks.withColumnRenamed("block", "_b"), F.col(block) == F.col("_b"))
    return placed.groupBy(*by).agg(F.collect_list(F.struct("k", *columns)).alias("packed"))


def _products(batch: pa.RecordBatch, drawn: tuple[int, int, int], columns: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch of packed rows with their (rows, columns, replicates)."""
    seed, replicates, count = drawn
    counts = draw_counts(seed, 0, replicates, count)
    step = max(1, SLICE // (len(columns) * max(count, replicates + 1)))
    tile = max(1, SLICE // max(count, 1))
    for lo in range(0, batch.num_rows, step):
        part = batch.slice(lo, step)
        packed = part.column(part.num_columns - 1)
        inner, sizes = packed.flatten(), packed.value_lengths().to_numpy()
        held = np.zeros((part.num_rows, len(columns), count))
        row, place = np.repeat(np.arange(part.num_rows), sizes), inner.field(0).to_numpy()
        for k in range(len(columns)):
            held[row, k, place] = inner.field(k + 1).to_numpy(zero_copy_only=False)
        yield part, np.concatenate([held @ counts[r : r + tile].T.astype(float) for r in range(0, replicates + 1, tile)], axis=2)


def replicate_sums(sums: DataFrame, drawn: Draws, by: list[str], columns: tuple[str, ...], block: str = "block") -> DataFrame:
    """(by, replicate, columns): the sums of each replicate, from sums by block."""
    packed = _packed(sums, drawn, by, columns, block)
    given, n = (drawn.seed, drawn.replicates, drawn.count), drawn.replicates + 1

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, got in _products(batch, given, columns):
                keys = [part.column(k).take(pa.array(np.repeat(np.arange(part.num_rows), n))) for k in range(len(by))]
                replicate = pa.array(np.tile(np.arange(n, dtype=np.int32), part.num_rows))
                yield pa.RecordBatch.from_arrays([*keys, replicate, *(pa.array(got[:, k].reshape(-1)) for k in range(len(columns)))], [*by, "replicate", *columns])

    kinds = [f"{c} {packed.schema[c].dataType.simpleString()}" for c in by]
    return packed.mapInArrow(multiply, ", ".join([*kinds, "replicate int", *(f"{c} double" for c in columns)]))


def replicate_regional_correlation(sums: DataFrame, drawn: Draws, by: list[str], cells: DataFrame, block: str = "block", least: float = 1e-9) -> DataFrame:
    """(by, region, replicate, r): in each replicate the correlation of every cell, then its mean over the region's cells that have one.

    ``sums`` are those of ``pair_sums`` by block, ``by`` and cell; ``cells`` has (cell, region, weight), a row for each region that holds
    the cell. A cell whose variances are not above ``least`` of its mean squares has no correlation. A task adds up its
    cells, so that what is shuffled grows with the number of regions and not with the grid.
    """
    placed = cells.groupBy("cell").agg(F.collect_list(F.struct("region", "weight")).alias("regions"))
    packed = _packed(sums, drawn, [*by, "cell"], SUMS, block).join(placed, "cell").select(*by, "regions", "packed")
    given, count = (drawn.seed, drawn.replicates, drawn.count), drawn.replicates + 1

    def correlate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(k).type for k in range(len(by))]
            for part, got in _products(batch, given, SUMS):
                n, f, o, ff, oo, fo = np.moveaxis(got, 1, 0)
                with np.errstate(invalid="ignore", divide="ignore"):
                    vf, vo = ff / n - (f / n) ** 2, oo / n - (o / n) ** 2
                    fits = (n > 1) & (vf > least * ff / n) & (vo > least * oo / n)
                    r = np.where(fits, (fo / n - f / n * (o / n)) / np.sqrt(np.where(fits, vf * vo, 1)), 0)
                for k, (*key, regions) in enumerate(zip(*(part.column(c).to_pylist() for c in range(len(by) + 1)), strict=True)):
                    for x in regions:
                        held = totals.setdefault((*key, x["region"]), np.zeros((2, count)))
                        held += x["weight"] * np.stack([r[k], fits[k]])
        if totals:
            keys = pa.array(np.repeat(np.arange(len(totals)), count))
            names = [pa.array(list(c), t).take(keys) for c, t in zip(zip(*totals, strict=True), [*types, pa.string()], strict=True)]
            values = np.concatenate(list(totals.values()), 1)
            yield pa.RecordBatch.from_arrays([*names, pa.array(np.tile(np.arange(count, dtype=np.int32), len(totals))), pa.array(values[0]), pa.array(values[1])], [*by, "region", "replicate", "wr", "w"])

    schema = ", ".join([*(f"{c} {packed.schema[c].dataType.simpleString()}" for c in by), "region string, replicate int, wr double, w double"])
    parts = packed.mapInArrow(correlate, schema).groupBy(*by, "region", "replicate").agg(F.sum("wr").alias("wr"), F.sum("w").alias("w"))
    return parts.select(*by, "region", "replicate", F.try_divide("wr", "w").alias("r"))


def redrawn_events(groups: DataFrame, by: list[str], replicates: int = 1000, seed: int = 0) -> DataFrame:
    """(by, replicate, events, cases): outcomes drawn again as if the probabilities were right.

    ``groups`` has (by, a, n, cases): how many cases have the probability a / n. Each replicate's events of a group are one binomial number by
    inversion, so that no case becomes a row a replicate; the groups are as many as ensembles have counts.
    """

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.arange(1, replicates + 1)
        for batch in batches:
            a, n, cases = (batch.column(len(by) + k).to_pylist() for k in range(3))
            for row in range(batch.num_rows):
                u = keyed_uniforms(ids, f"{seed}|{{}}|{a[row]}|{n[row]}")[0]
                share = a[row] / n[row]
                events = binomials(np.full(replicates, cases[row]), share, u) if 0 < share < 1 else np.full(replicates, round(cases[row] * share))
                keys = [batch.column(k).slice(row, 1).take(pa.array(np.zeros(replicates, np.int64))) for k in range(len(by))]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(ids.astype(np.int32)), pa.array(events), pa.array(np.full(replicates, cases[row]))], [*by, "replicate", "events", "cases"])

    kinds = [f"{c} {groups.schema[c].dataType.simpleString()}" for c in by]
    one = groups.select(*by, F.col("a").cast("long").alias("a"), F.col("n").cast("long").alias("n"), F.col("cases").cast("long").alias("cases"))
    found = one.mapInArrow(draw, ", ".join([*kinds, "replicate int, events long, cases long"]))
    return found.groupBy(*by, "replicate").agg(F.sum("events").alias("events"), F.sum("cases").alias("cases"))


def intervals(scores: DataFrame, by: list[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """The sample's value (replicate 0) and exact percentiles over the other replicates."""
    own, other = F.col("replicate") == 0, F.when(F.col("replicate") > 0, F.col(value))
    return scores.groupBy(*by).agg(F.max(F.when(own, F.col(value))).alias("value"), F.percentile(other, F.lit(low)).alias("low"), F.percentile(other, F.lit(high)).alias("high"))


def paired_difference(scores: DataFrame, a: str, b: str, keys: list[str], value: str) -> DataFrame:
    """a minus b on the same replicates: value, interval, significance and the share above 0; one pass over the replicates, and one over their differences. Differences within 1e-9 of 0 are rounding."""
    of = lambda m: F.max(F.when(F.col("model") == m, F.col(value)))
    d = scores.groupBy("replicate", *keys).agg((of(a) - of(b)).alias("d"))
    own, other = F.col("replicate") == 0, F.when(F.col("replicate") > 0, F.col("d"))
    out = d.groupBy(*keys).agg(
        F.max(F.when(own, F.col("d"))).alias("value"), F.percentile(other, F.lit(0.025)).alias("low"), F.percentile(other, F.lit(0.975)).alias("high"),
        F.avg((other > 1e-9).cast("double")).alias("p_gt0"),
    )
    return out.withColumn("significant", (F.col("low") > 1e-9) | (F.col("high") < -1e-9))
