"""Masks and regions over integer grid cells (ilat, ilon)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The regions' latitude bounds.
REGIONS = {"global": (-90.0, 90.0), "tropics": (-20.0, 20.0), "NH": (20.0, 90.0), "SH": (-90.0, -20.0)}

# The bands of maps that also have land, ocean and the extratropics; a bound belongs to both sides.
MAP_REGIONS = {"global": (-90.0, 90.0), "tropics": (-30.0, 30.0), "NH": (30.0, 90.0), "SH": (-90.0, -30.0)}
EXTRATROPICS = 30.0


def cell_region(cells: DataFrame, regions: dict[str, tuple[float, float]] = REGIONS) -> DataFrame:
    """(cell, region), a row for each latitude band that holds the cell; bands may overlap."""
    bands = F.array(*(F.struct(F.lit(n).alias("region"), F.lit(a).alias("south"), F.lit(b).alias("north")) for n, (a, b) in regions.items()))
    return cells.select("*", F.explode(bands).alias("b")).where(F.col("lat").between(F.col("b.south"), F.col("b.north"))).select("cell", "ilat", "ilon", "lat", "lon", "b.region")


def all_regions(cells: DataFrame, mask: DataFrame, n_lat: int, n_lon: int, land: float = 0.5, core: float = 0.99, around: float = 0.5) -> DataFrame:
    """(cell, lat, region) of every region: bands, extratropics, land, ocean and the interior of land. ``mask``: (ilat, ilon, lsm)."""
    bands = cell_region(cells, MAP_REGIONS).select("cell", "lat", "region")
    outer = cells.where(F.abs("lat") >= EXTRATROPICS).select("cell", "lat", F.lit("extratropics").alias("region"))
    surface = F.when(F.col("lsm") >= land, "land").otherwise("ocean").alias("region")
    split = cells.join(mask.select("ilat", "ilon", "lsm"), ["ilat", "ilon"]).select("cell", "lat", surface)
    interior = cells.join(land_interior(mask, n_lat, n_lon, core, around), ["ilat", "ilon"]).select("cell", "lat", F.lit("land_interior").alias("region"))
    return bands.unionByName(outer).unionByName(split).unionByName(interior)


def haloed(df: DataFrame, value: str, tile: int = 32, halo: int = 1) -> DataFrame:
    """(tile, cells): a row for each tile of ``tile`` latitudes, with its cells (ilat, ilon, x) and those of the ``halo`` rows beside it."""
    own, place = F.floor(F.col("ilat") / tile).cast("int"), F.pmod(F.col("ilat"), F.lit(tile))
    tiles = F.array_compact(F.array(own, F.when(place < halo, own - 1), F.when(place >= tile - halo, own + 1)))
    cell = F.struct(F.col("ilat").cast("int").alias("ilat"), F.col("ilon").cast("int").alias("ilon"), F.col(value).cast("double").alias("x"))
    return df.select(F.explode(tiles).alias("tile"), cell.alias("cell")).groupBy("tile").agg(F.collect_list("cell").alias("cells"))


def stencil(df: DataFrame, value: str, keep: Callable[[np.ndarray], np.ndarray], n_lon: int | None = None, tile: int = 32) -> DataFrame:
    """(ilat, ilon) of the places that ``keep`` finds in a tile's field, NaN where there is no value.

    ``keep`` takes the field with a row above and below and a column on either side, and gives true or false for each place within. Columns wrap at
    ``n_lon``; without it places beside the grid are among them. A cell is copied to the neighbouring tile only in the rows at its edge.
    """
    beside = 0 if n_lon else 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                first = batch.column(0)[n].as_py() * tile
                cells = batch.slice(n, 1).column(1).flatten()
                i, j, x = (cells.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                width = n_lon or int(j.max()) + 1
                field = np.full((tile + 2, width + 2 + 2 * beside), np.nan)
                field[i - first + 1, j + 1 + beside] = x
                if n_lon:
                    field[:, 0], field[:, -1] = field[:, -2].copy(), field[:, 1].copy()
                lat, lon = np.nonzero(keep(field))
                yield pa.RecordBatch.from_arrays([pa.array((lat + first).astype(np.int32)), pa.array((lon - beside).astype(np.int32))], ["ilat", "ilon"])

    return haloed(df, value, tile).mapInArrow(work, "ilat int, ilon int")


def dilated_missing(df: DataFrame, tile: int = 32) -> DataFrame:
    """(ilat, ilon) of cells that never have a value, and of their four neighbours; longitude does not wrap."""
    never = df.groupBy("ilat", "ilon").agg((F.count("value") == 0).cast("double").alias("_never"))

    def keep(x: np.ndarray) -> np.ndarray:
        y = x == 1
        return y[1:-1, 1:-1] | y[:-2, 1:-1] | y[2:, 1:-1] | y[1:-1, :-2] | y[1:-1, 2:]

    return stencil(never, "_never", keep, None, tile)


def land_interior(mask: DataFrame, n_lat: int, n_lon: int, core: float = 0.99, around: float = 0.5, tile: int = 32) -> DataFrame:
    """(ilat, ilon) of cells of at least ``core`` land whose eight neighbours are at least ``around``; longitude wraps at ``n_lon``, rows beyond the poles repeat the last of ``n_lat``."""

    def keep(x: np.ndarray) -> np.ndarray:
        rows, columns = x.shape[0] - 2, x.shape[1] - 2
        low = np.nan_to_num(x, nan=np.inf)  # a row that a pole repeats is among the neighbours already
        least = np.minimum.reduce([low[a : a + rows, b : b + columns] for a in range(3) for b in range(3)])
        return (x[1:-1, 1:-1] >= core) & (least >= around)

    return stencil(mask.where(F.col("ilat").between(0, n_lat - 1)), "lsm", keep, n_lon, tile)


def screen_cases(cases: DataFrame, least: float) -> DataFrame:
    """Cases whose truth and every member are at least ``least``; no member may be missing."""
    return cases.where((F.col("obs") >= least) & (F.col("n") == F.col("n_all")) & (F.array_min("xs") >= least))
