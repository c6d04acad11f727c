"""A registry of queries with their SQL, and the views that both sides read.

Views are derived from the given tables and grow with them:
``fc``: forecasts, one row for each model, init, lead, cell and member, from orders and their lines;
``obs``: truth by valid date and cell, from lines by ship date;
``cells``: a coarse grid, six rows of latitude by four of longitude.
Values are square roots of prices, so that ties are rare. Some members are missing.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VIEWS = {
    "cells": "select range::int as cell, (range % 6)::int as ilat, (range // 6)::int as ilon, -75.0::double + 30.0::double * (range % 6) as lat, 90.0::double * (range // 6) as lon from range(24)",
    "lines": "select l_orderkey, l_linenumber, avg(case when l_orderkey % 97 = 0 and l_linenumber = 2 then null else sqrt(l_extendedprice) end) as value from lineitem group by 1, 2",
    "fc": "select case when o_orderkey % 3 = 0 then 'B' else 'A' end as model, cast(o_orderdate as date) as init_date, ((o_orderkey // 3) % 42 + 1)::int as lead_day, (o_custkey % 24)::int as cell, (l_linenumber - 1)::int as number, avg(value) as value from orders join lines on l_orderkey = o_orderkey group by 1, 2, 3, 4, 5",
    "obs": "select cast(l_shipdate as date) as valid_date, (l_suppkey % 24)::int as cell, avg(sqrt(l_extendedprice)) as value from lineitem group by 1, 2",
    "cases": "select f.model, f.init_date, f.lead_day, f.cell, list_sort(list(f.value) filter (f.value is not null)) as xs, count(f.value) as n, count(*) as n_all, avg(f.value) as mean, any_value(o.value) as obs from fc f join obs o on o.valid_date = f.init_date + f.lead_day and o.cell = f.cell group by 1, 2, 3, 4",
    "daily": "select valid_date, avg(value) as value from obs group by 1",
    "weekly": "select model, init_date, cell, ceil(lead_day / 7.0)::int as week, avg(mean) as fa, avg(obs) as oa from cases group by 1, 2, 3, 4",
    "rmm": "select model, init_date, lead_day, number, (avg(value) - 150) / 60 as rmm1, (avg(value * cos(radians(cell * 15.0))) + 5) / 60 as rmm2 from fc where value is not null group by 1, 2, 3, 4",
    "rmm_obs": "select valid_date, (avg(value) - 150) / 60 as o1, (avg(value * cos(radians(cell * 15.0))) + 5) / 60 as o2 from obs group by 1",
    "ev6": "select event_type, time_bucket(interval '6 hours', ts, timestamp '2000-01-01') as valid_time, avg(sqrt(value)) as value from events group by 1, 2",
}


def uniform_sql(keys: str) -> str:
    """The keyed uniform number in DuckDB."""
    return f"(('0x' || substr(md5(concat_ws('|', {keys})), 1, 8))::bigint / 4294967296.0::double)"


def query(name: str, sql: str | None = None):
    """Registers a query that takes Tables; ``sql`` may read the views and start with WITH."""

    def add(make: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        QUERIES[name].__doc__ = make.__doc__
        if sql is not None:
            SQL[name] = with_views(sql)
        return make

    return add


def with_views(sql: str) -> str:
    """The statement with the views that it needs in front."""
    needed: list[str] = []

    def need(text: str) -> None:
        for v in VIEWS:
            if v not in needed and re.search(rf"\b{v}\b", text):
                need(VIEWS[v])
                if v not in needed:
                    needed.append(v)

    need(sql)
    own = sql.strip()
    parts = [f"{v} as ({VIEWS[v]})" for v in needed]
    for head in ("with recursive ", "with "):
        if own.lower().startswith(head):
            return head + ", ".join([*parts, own[len(head) :]])
    return ("with " + ", ".join(parts) + " " if parts else "") + own


class Tables:
    """The views in Spark."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def cells(self) -> DataFrame:
        n = F.col("id")
        return self.spark.range(24).select(
            n.cast("int").alias("cell"), (n % 6).cast("int").alias("ilat"), F.floor(n / 6).cast("int").alias("ilon"),
            (-75.0 + 30.0 * (n % 6)).alias("lat"), (90.0 * F.floor(n / 6)).alias("lon"),
        )

    @property
    def fc(self) -> DataFrame:
        value = F.when(~((F.col("l_orderkey") % 97 == 0) & (F.col("l_linenumber") == 2)), F.sqrt("l_extendedprice"))
        lines = self.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.avg(value).alias("value"))
        key = F.col("o_orderkey")
        keyed = self.table("orders").join(lines, key == F.col("l_orderkey")).select(
            F.when(key % 3 == 0, "B").otherwise("A").alias("model"), F.col("o_orderdate").cast("date").alias("init_date"),
            (F.floor(key / 3) % 42 + 1).cast("int").alias("lead_day"), (F.col("o_custkey") % 24).cast("int").alias("cell"),
            (F.col("l_linenumber") - 1).cast("int").alias("number"), "value",
        )
        return keyed.groupBy("model", "init_date", "lead_day", "cell", "number").agg(F.avg("value").alias("value"))

    @property
    def obs(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_shipdate").cast("date").alias("valid_date"), (F.col("l_suppkey") % 24).cast("int").alias("cell")).agg(F.avg(F.sqrt("l_extendedprice")).alias("value"))

    @property
    def cases(self) -> DataFrame:
        """Forecast members and truth by case."""
        from ..operators.align import ensemble_cases

        return ensemble_cases(self.fc, self.obs, ["model", "init_date", "lead_day", "cell"])

    @property
    def daily(self) -> DataFrame:
        return self.obs.groupBy("valid_date").agg(F.avg("value").alias("value"))

    @property
    def weekly(self) -> DataFrame:
        week = F.ceil(F.col("lead_day") / 7).cast("int")
        return self.cases.groupBy("model", "init_date", "cell", week.alias("week")).agg(F.avg("mean").alias("fa"), F.avg("obs").alias("oa"))

    @property
    def rmm(self) -> DataFrame:
        return self.index_pair(self.fc)

    def index_pair(self, fc: DataFrame) -> DataFrame:
        """Two indices of each member's field: its mean and its first harmonic over cells."""
        second = (F.avg(F.col("value") * F.cos(F.radians(F.col("cell") * 15.0))) + 5) / 60
        return fc.where("value is not null").groupBy("model", "init_date", "lead_day", "number").agg(((F.avg("value") - 150) / 60).alias("rmm1"), second.alias("rmm2"))

    @property
    def rmm_obs(self) -> DataFrame:
        second = (F.avg(F.col("value") * F.cos(F.radians(F.col("cell") * 15.0))) + 5) / 60
        return self.obs.groupBy("valid_date").agg(((F.avg("value") - 150) / 60).alias("o1"), second.alias("o2"))

    @property
    def ev6(self) -> DataFrame:
        return self.table("events").groupBy("event_type", F.window("ts", "6 hours").start.alias("valid_time")).agg(F.avg(F.sqrt("value")).alias("value"))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to ``digits`` places, so that the order of additions does not show."""
    return df.select(*(F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))
