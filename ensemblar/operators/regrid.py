"""Regridding: every method is two axes of weights (src, dst, w), applied as gather and dot.

Weights are separable, so that a table is built for each axis from its sorted coordinates. Axes are as long as a grid has
rows or columns; they are given as lists. Fields are packed by tiles of target latitudes: a tile gets the source rows that
its targets need, and all its targets are made in the task that has it.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Axis = list[tuple[int, int, float]]


def linear_axis(src: list[float], dst: list[float], period: float | None = None) -> Axis:
    """(src index, dst index, weight) of linear interpolation. With ``period`` it goes round; otherwise targets beyond the ends take the last row."""
    order = sorted(range(len(src)), key=src.__getitem__)
    xs = [src[k] for k in order]
    out: Axis = []
    for j, x in enumerate(dst):
        if period is not None:
            x = (x - xs[0]) % period + xs[0]
        i = bisect_right(xs, x) - 1
        if period is None and (i < 0 or i == len(xs) - 1):
            out.append((order[max(i, 0)], j, 1.0))
            continue
        right = (i + 1) % len(xs)
        gap = xs[right] - xs[i] + (period if right == 0 else 0)
        w = (x - xs[i]) / gap
        out += [(order[k], j, v) for k, v in ((i, 1 - w), (right, w)) if v]
    return out


def nearest_axis(src: list[float], dst: list[float], period: float | None = None) -> Axis:
    def far(a: float, b: float) -> float:
        d = abs(a - b)
        return d if period is None else min(d % period, period - d % period)

    return [(min(range(len(src)), key=lambda i: (far(src[i], x), i)), j, 1.0) for j, x in enumerate(dst)]


def overlap_axis(src: list[tuple[float, float]], dst: list[tuple[float, float]], area) -> Axis:
    """Weights by the share of each target's extent, measured by ``area``, that a source covers."""
    out: Axis = []
    for j, (a, b) in enumerate(dst):
        found = [(i, area(min(b, d)) - area(max(a, c))) for i, (c, d) in enumerate(src) if min(b, d) > max(a, c)]
        total = sum(w for _, w in found)
        out += [(i, j, w / total) for i, w in found]
    return out


def conservative_axes(src_lat, dst_lat, src_lon, dst_lon) -> tuple[Axis, Axis]:
    """First-order conservative weights from cell bounds: sines of latitude, degrees of longitude."""
    return overlap_axis(src_lat, dst_lat, lambda x: math.sin(math.radians(x))), overlap_axis(src_lon, dst_lon, lambda x: x)


class Rows:
    """An axis as compressed rows: for each target its sources and weights, side by side; short rows repeat a source with weight 0."""

    def __init__(self, axis: Axis) -> None:
        by: dict[int, dict[int, float]] = {}
        for i, j, w in axis:
            held = by.setdefault(j, {})
            held[i] = held.get(i, 0.0) + w
        self.targets = np.array(sorted(by), np.int32)
        width = max((len(x) for x in by.values()), default=1)
        rows = [list(by[j].items()) for j in self.targets.tolist()]
        self.sources = np.array([[x[k][0] if k < len(x) else x[0][0] for k in range(width)] for x in rows], np.int64).reshape(-1, width)
        self.weights = np.array([[x[k][1] if k < len(x) else 0.0 for k in range(width)] for x in rows]).reshape(-1, width)

    def part(self, lo: int, hi: int) -> Rows:
        out = Rows([])
        out.targets, out.sources, out.weights = self.targets[lo:hi], self.sources[lo:hi], self.weights[lo:hi]
        return out

    def apply(self, x: np.ndarray, at: np.ndarray, axis: int) -> np.ndarray:
        """Weighted sums along an axis whose places are ``at[source]``."""
        x = np.moveaxis(x, axis, -1)
        out = np.zeros((*x.shape[:-1], len(self.targets)))
        for k in range(self.sources.shape[1]):
            out += x[..., at[self.sources[:, k]]] * self.weights[:, k]
        return np.moveaxis(out, -1, axis)


def regrid(df: DataFrame, lat: Axis, lon: Axis, keys: list[str], tile: int = 16) -> DataFrame:
    """(keys, jlat, jlon, value): sum(w * value) of (ilat, ilon, value) for each target; NULL if a source with weight is missing, stands twice or is NULL.

    Targets without any source have no row. Source rows go to the tiles of ``tile`` target latitudes that need them, packed where they lie:
    what is shuffled is a row a tile and field, of the tile's own cells and the few rows beside it. Take the ensemble mean first where
    only the mean is needed: both are linear.
    """
    rows, columns = Rows(lat), Rows(lon)
    tiles = [rows.part(k, k + tile) for k in range(0, len(rows.targets), tile)]
    needs = [sorted(set(t.sources[t.weights != 0].tolist())) for t in tiles]
    used = sorted(set(columns.sources[columns.weights != 0].tolist()))
    of_row: dict[int, list[int]] = {}
    for k, need in enumerate(needs):
        for i in need:
            of_row.setdefault(i, []).append(k)
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in keys]
    schema = ", ".join([*kinds, "jlat int, jlon int, value double"])
    if not of_row or not used:
        return df.sparkSession.createDataFrame([], schema)
    # for each source row the tiles that need it, as one literal
    places = F.array(*(F.array(*map(F.lit, of_row.get(i, []))).cast("array<int>") for i in range(max(of_row) + 1)))
    cell = F.struct(F.col("ilat").cast("int").alias("ilat"), F.col("ilon").cast("int").alias("ilon"), F.col("value").cast("double").alias("value"))
    inside = df.where(F.col("ilat").between(0, max(of_row)) & F.col("ilon").between(used[0], used[-1]))
    placed = inside.select(*keys, F.explode(F.get(places, F.col("ilat"))).alias("tile"), cell.alias("cell"))
    packed = placed.groupBy(*keys, "tile").agg(F.collect_list("cell").alias("cells"))
    # sources that have no weight stand at the last place, which is empty
    column_at = np.full(max(int(columns.sources.max()), used[-1]) + 1, len(used), np.int64)
    column_at[used] = np.arange(len(used))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                one = batch.slice(n, 1)
                k = one.column(len(keys))[0].as_py()
                cells = one.column(len(keys) + 1).flatten()
                i, c, v = cells.field(0).to_numpy(), cells.field(1).to_numpy(), cells.field(2).to_numpy(zero_copy_only=False)
                row_at = np.full(int(rows.sources.max()) + 1, len(needs[k]), np.int64)
                row_at[needs[k]] = np.arange(len(needs[k]))
                seen, held = np.zeros((2, len(needs[k]) + 1, len(used) + 1))
                np.add.at(seen, (row_at[i], column_at[c]), 1.0)
                np.add.at(held, (row_at[i], column_at[c]), v)
                seen[:, -1] = held[:, -1] = 0.0
                there, bad = (seen > 0).astype(float), ((seen != 1) | np.isnan(held)).astype(float)

                def both(x: np.ndarray, k: int = k, row_at: np.ndarray = row_at) -> np.ndarray:
                    return tiles[k].apply(columns.apply(x, column_at, 1), row_at, 0)

                bad[:, -1] = bad[-1] = 0.0
                made = both(np.where(bad > 0, 0.0, held))
                share = tiles[k].weights.sum(1)[:, None] * columns.weights.sum(1)[None, :]
                null = (both(bad) > 0) | (np.round(share, 9) != 1)
                jlat, jlon = np.nonzero(both(there) > 0)
                out = pa.array(made[jlat, jlon], mask=null[jlat, jlon])
                names = [one.column(x).take(pa.array(np.zeros(len(jlat), np.int64))) for x in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*names, pa.array(tiles[k].targets[jlat]), pa.array(columns.targets[jlon]), out], [*keys, "jlat", "jlon", "value"])

    return packed.mapInArrow(work, schema)


def block_mean(df: DataFrame, keys: list[str], size: int, n_lat: int, n_lon: int) -> DataFrame:
    """Means of size x size cells; what is left over at the ends is trimmed."""
    kept = df.where((F.col("ilat") < n_lat // size * size) & (F.col("ilon") < n_lon // size * size))
    block = lambda c: F.floor(F.col(c) / size).cast("int")
    return kept.groupBy(*keys, block("ilat").alias("jlat"), block("ilon").alias("jlon")).agg(F.avg("value").alias("value"))
