"""Scores from a cube of sums that merge.

Sums of products by init, lead and region are made once. Every score of every subset of inits, and of leads and regions together,
comes from adding them up: no pair of forecast and truth is read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = ("n", "w", "wf", "wo", "wff", "woo", "wfo", "wee")


def score_cube(pairs: DataFrame, by: list[str], sides: list[tuple[str, str]], weight: Column | None = None) -> DataFrame:
    """(by, SUMS) of forecast and truth columns; several ``sides`` of a row, such as both indices of a pair, count as one vector. Rows that lack one are left out."""
    whole = pairs.where(reduce(lambda a, b: a & b, (F.col(f).isNotNull() & F.col(o).isNotNull() for f, o in sides)))
    w = F.lit(1.0) if weight is None else weight
    total = lambda make: F.sum(w * reduce(lambda a, b: a + b, (make(F.col(f), F.col(o)) for f, o in sides)))
    made = {"wf": lambda f, o: f, "wo": lambda f, o: o, "wff": lambda f, o: f * f, "woo": lambda f, o: o * o, "wfo": lambda f, o: f * o, "wee": lambda f, o: (f - o) * (f - o)}
    return whole.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), *(total(m).alias(c) for c, m in made.items()))


def merged(cube: DataFrame, by: list[str]) -> DataFrame:
    """The cube of coarser keys."""
    return cube.groupBy(*by).agg(*(F.sum(c).alias(c) for c in SUMS))


def subset_cube(cube: DataFrame, subsets: DataFrame, by: list[str], key: str = "init_date") -> DataFrame:
    """(subset, by, SUMS): of each subset (subset, key) the sums of its inits."""
    return merged(cube.join(subsets, key), ["subset", *by])


def scores_of(cube: DataFrame) -> DataFrame:
    """The cube with acc (uncentred), cor (centred), rmse and bias; NULL where they aren't defined."""
    c = F.col
    mean = lambda x: F.try_divide(c(x), c("w"))
    vf, vo = mean("wff") - mean("wf") * mean("wf"), mean("woo") - mean("wo") * mean("wo")
    return cube.withColumns({
        "acc": F.when(c("n") > 1, F.try_divide(c("wfo"), F.sqrt(c("wff") * c("woo")))),
        "cor": F.when((c("n") > 1) & (vf > 0) & (vo > 0), (mean("wfo") - mean("wf") * mean("wo")) / F.sqrt(vf) / F.sqrt(vo)),
        "rmse": F.sqrt(mean("wee")),
        "bias": mean("wf") - mean("wo"),
    })


def subsets_of(cube: DataFrame, months: dict[str, list[int]], models: int, key: str = "init_date") -> DataFrame:
    """(subset, key): all inits, those of some months by name, and those that ``models`` models have, from the cube's own keys."""
    dates = cube.groupBy(key).agg(F.count_distinct("model").alias("_m"))
    named = [F.lit("all"), F.when(F.col("_m") == models, "common"), *(F.when(F.month(key).isin(ms), name) for name, ms in months.items())]
    return dates.select(F.explode(F.array_compact(F.array(*named))).alias("subset"), key)
