"""Rows of a stream are held in packs."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ensemblar.plans import file_queries, registry
from ensemblar.streaming import accumulate


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(accumulate, "PACK", 3)
    monkeypatch.setattr(accumulate, "HELD", 20)


def test_a_pack_a_key(few):
    when = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)
    rows = [{"model": m, "init": i, "x": k, "rows": 4, "arrived": when} for k in range(4) for m in ("A", None) for i in (1, 2)]
    schema = pa.schema([("model", pa.string()), ("init", pa.int32()), ("x", pa.int64()), ("rows", pa.int64()), ("arrived", pa.timestamp("us", "UTC"))])
    batches = [pa.RecordBatch.from_pylist(rows[:7], schema), pa.RecordBatch.from_pylist(rows[7:], schema)]
    packs = [p for b in accumulate._packs(["model", "init"], "rows")(batches) for p in b.to_pylist()]
    assert sorted((p["model"] or "", p["init"], p["n"], p["expected"]) for p in packs) == sorted((m, i, n, 4) for m in ("A", "") for i in (1, 2) for n in (3, 1))
    back = [r for p in packs for r in accumulate._unpacked([p["pack"]]).to_pylist()]
    assert sorted(back, key=str) == sorted(({k: v for k, v in r.items() if k != "arrived"} for r in rows), key=str)


def test_values_and_the_first_of_rows_alike(spark, tmp_path):
    big = (1 << 60) + 1
    schema = "model string, init_date date, number int, large long, value double, rows int"
    init = dt.date(2001, 1, 1)
    parts = [
        [("A", init, 1, big, 0.5, 3), ("A", init, None, None, None, 3), ("B", init, 1, 5, 1.5, 2)],
        [("A", init, 1, 7, 9.0, 3), ("A", init, 2, big + 2, 2.5, 3)],
    ]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = accumulate.forecast_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        held = accumulate.whole_inits(stream, ["model", "init_date"], ["number"], "rows")
        accumulate.run_available(held, str(tmp_path / "checkpoint"), str(tmp_path / "out"))
    got = accumulate.ScoreStore(spark, str(tmp_path / "out")).read().drop("variant")
    assert dict(got.dtypes) == {"model": "string", "init_date": "date", "number": "int", "large": "bigint", "value": "double", "rows": "int", "whole": "boolean"}
    rows = sorted(map(tuple, got.select("model", "init_date", "number", "large", "value", "rows", "whole").collect()), key=str)
    assert rows == sorted([("A", init, 1, big, 0.5, 3, True), ("A", init, None, None, None, 3, True), ("A", init, 2, big + 2, 2.5, 3, True)], key=str)


def test_truth_is_made_once(spark, sf_dir, monkeypatch):
    """Forecast and truth are made once, whatever the number of runs and batches."""
    made = []
    monkeypatch.setattr(registry.Tables, "obs", property(lambda t, get=registry.Tables.obs.fget: made.append("obs") or get(t)))
    monkeypatch.setattr(accumulate, "run_available", lambda rows, checkpoint, path, make: accumulate.ScoreStore(spark, path).publish(make(file_of(spark, path)), str(len(made))))
    file_queries.streamed_rank_counts(registry.Tables(spark, sf_dir)).agg(F.sum("count")).collect()
    assert made == ["obs"]


def file_of(spark, path):
    return spark.read.parquet(path.removesuffix("/out") + "/in")
