"""Queries on small tables made for one case each, against their SQL or numbers known beforehand."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pytest

from compare import rows
from ensemblar.plans.catalog import QUERIES, SQL


def order_key(lead_day, turn, missing=False):
    """A key of model A whose lead is ``lead_day``; line 2 of keys divisible by 97 is missing."""
    return next(k for k in range(1 + 126 * 97 * turn, 126 * 97 * (turn + 1)) if k % 3 and k // 3 % 42 + 1 == lead_day and (k % 97 == 0) == missing)


@pytest.fixture
def tables(spark, tmp_path):
    def make(forecasts, truth):
        """forecasts: (init, lead_day, cell, value or None), one member each; truth: (valid date, cell, value)."""
        orders, lines = [], []
        for k, (init, lead, cell, value) in enumerate(forecasts):
            key = order_key(lead, k, value is None)
            orders.append((key, cell, pd.Timestamp(init)))
            lines.append((key, 2, 25, (value or 1.0) ** 2, pd.Timestamp("1990-01-01")))
        # lines of no order
        lines += [(-1 - k, 1, cell, value**2, pd.Timestamp(day)) for k, (day, cell, value) in enumerate(truth)]
        pd.DataFrame(orders, columns=["o_orderkey", "o_custkey", "o_orderdate"]).astype({"o_orderdate": "datetime64[us]"}).to_parquet(tmp_path / "orders.parquet")
        names = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate"]
        pd.DataFrame(lines, columns=names).astype({"l_shipdate": "datetime64[us]", "l_extendedprice": "float64"}).to_parquet(tmp_path / "lineitem.parquet")
        con = duckdb.connect()
        for t in ("orders", "lineitem"):
            con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
        return SimpleNamespace(query=lambda name: QUERIES[name](spark, str(tmp_path)).toPandas(), sql=lambda name: con.sql(SQL[name]).df())

    return make


def test_onset_missing_value_is_not_dry(tables):
    # 5 x 8.5 is over the threshold of 40; with the missing cell as dry, the first day would have 4.25
    init = dt.date(1996, 5, 1)
    t = tables([(init, 1, 6, None)] + [(init, d, 0, 158.5) for d in range(1, 6)], [])
    got = t.query("w4_member_onset")
    assert got.values.tolist() == [[1.0, 1]]
    assert rows(got) == rows(t.sql("w4_member_onset"))


def test_regional_acc_squares_of_what_each_side_has(tables):
    # two cells of a band, one of them without a forecast: its truth counts in the truth's squares
    days = [dt.date(1996, 5, 2), dt.date(1997, 5, 3)]
    truth = [(days[0], 4, 160.0), (days[1], 4, 130.0), (days[0], 10, 190.0), (days[1], 10, 120.0)]
    t = tables([(dt.date(1996, 5, 1), 1, 4, 170.0), (dt.date(1996, 5, 1), 1, 10, None)], truth)
    got = t.query("a14_regional_acc")
    assert rows(got) == rows(t.sql("a14_regional_acc"))
    assert set(got["acc"]) == {0.3939}  # 15 / sqrt(15² + 35²), not 1


def test_regional_acc_halfway_means(tables):
    # fields of one cell have 1 or -1; over 64 inits the mean may lie halfway between two roundings
    random = np.random.default_rng(3)
    forecasts, truth = [], []
    for year in range(1938, 2002):
        for lead in range(1, 31):
            f, o = random.uniform(80, 220, 2).round(3).tolist()
            forecasts.append((dt.date(year, 1, 1), lead, 0, f))
            truth.append((dt.date(year, 1, 1) + dt.timedelta(days=lead), 0, o))
    t = tables(forecasts, truth)
    got = t.query("a14_regional_acc")
    whole = (got["acc"] * 32).round()
    assert (got["n_inits"] == 64).all() and (whole % 2 == 1).any()
    halfway = Decimal("0.0001")
    assert got["acc"].tolist() == [float((Decimal(int(x)) / 32).quantize(halfway, ROUND_HALF_UP)) for x in whole]
