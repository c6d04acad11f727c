"""Canonical schemas. Values are DOUBLE; missing is NULL, never NaN; cells are integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fields(text: str) -> T.StructType:
    kinds = {"string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType(), "int": T.IntegerType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split() for x in text.split(", "))])


FORECAST = _fields("model string, variable string, init_date date, number int, lead_day int, lat double, lon double, value double")
ANALYSIS = _fields("variable string, valid_time timestamp, lat double, lon double, value double")
VAR_CONFIG = _fields("model string, variable string, model_var string, era5_var string, level double, era5_level double, model_scale double, era5_scale double")
TRUTH_RULE = _fields("model string, variable string, convention string, offset_days int")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every float column; Spark's aggregates skip NULL but carry NaN on."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*(F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema))
