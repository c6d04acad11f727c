"""Queries of regions beyond latitude bands, first inits and chosen levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, masks, scores
from ..sources import readers
from .align_queries import LSM, _lsm
from .registry import Tables, query, rounded
from .score_queries import TCC, _tcc


@query("j10_all_regions", f"with {LSM}, {TCC}, inner_land as (select c.cell from (select m.cell, m.ilat, m.ilon from lsm m where m.lsm >= 0.9) c, (values (-1), (0), (1)) x(a), (values (-1), (0), (1)) y(b) join lsm l on l.ilat = least(greatest(c.ilat + a, 0), 5) and l.ilon = (c.ilon + b + 4) % 4 group by 1 having min(l.lsm) >= 0.8), member as (select cell, lat, 'global' as region from cells union all select cell, lat, 'tropics' from cells where lat between -30 and 30 union all select cell, lat, 'NH' from cells where lat >= 30 union all select cell, lat, 'SH' from cells where lat <= -30 union all select cell, lat, 'extratropics' from cells where abs(lat) >= 30 union all select c.cell, c.lat, case when lsm >= 0.9 then 'land' else 'ocean' end from cells c join lsm l on l.cell = c.cell union all select cell, lat, 'land_interior' from cells join inner_land using (cell)) select model, week, region, count(tcc) as n_cells, round(sum(cos(radians(lat)) * tcc) / sum(case when tcc is not null then cos(radians(lat)) end), 4) as tcc from tcc join member using (cell) group by 1, 2, 3")
def all_regions(t: Tables) -> DataFrame:
    """Regional means of the correlation map over bands, extratropics, land, ocean and the interior of land."""
    regions = F.broadcast(masks.all_regions(t.cells, _lsm(t), 6, 4, 0.9, 0.9, 0.8))  # at most five rows for each of 24 cells
    mean = scores.weighted_mean(F.col("tcc"), F.cos(F.radians("lat")))
    return rounded(_tcc(t).join(regions, "cell").groupBy("model", "week", "region").agg(F.count("tcc").alias("n_cells"), mean.alias("tcc")))


@query("t2_first_inits", "with r as (select *, dense_rank() over (partition by model order by init_date) as k from fc) select model, init_date, count(*) as n, round(avg(value), 4) as value from r where k <= 30 group by 1, 2")
def first_inits(t: Tables) -> DataFrame:
    """Each model's first thirty inits."""
    return rounded(align.first_inits(t.fc, 30, ["model"]).groupBy("model", "init_date").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")))


@query("p1_level_selection", "select 'forecast' as side, cell, round(avg(value * 2), 4) as value from fc group by 2 union all select 'truth', cell, round(avg(value), 4) from obs group by 2")
def level_selection(t: Tables) -> DataFrame:
    """One level of each side, forecasts in hPa and truth in Pa."""
    fc = t.fc.select("model", "init_date", "lead_day", "cell", "number", F.col("value").alias("t_500"), (F.col("value") * 2).alias("t_850"))
    fc = align.select_level(readers.stacked_levels(fc, "t", [500, 850], ["cell"]), 850.0)
    truth = t.obs.select("cell", F.col("value").alias("t_85000"), (F.col("value") * 3).alias("t_50000"))
    truth = align.select_level(readers.stacked_levels(truth, "t", [50000, 85000], ["cell"]), 85000.0)
    both = fc.withColumn("side", F.lit("forecast")).unionByName(truth.withColumn("side", F.lit("truth")))
    return rounded(both.groupBy("side", "cell").agg(F.avg("value").alias("value")))
