"""Tables that are stored once by the keys that everything joins them on.

Truth is joined on (valid_date, cell) and a climatology on (doy, cell) by every score of every model. Stored in buckets of those
keys and sorted within them, they are read as they lie: only the forecast side of a join is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..shared import shared_path

TRUTH, CLIMATOLOGY = ["valid_date", "cell"], ["doy", "cell"]


def store_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Writes ``df`` as table ``name`` in buckets of ``keys`` and reads it; a table of that name is replaced.

    ``buckets`` should be that of the shuffles that meet it (by default the session's), so that neither side of a join moves to the other's
    number. The files stand under ``path``, or in the shared folder.
    """
    spark = df.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a task writes whole buckets: as many files as buckets
    rows = df.repartition(count, *keys)
    spark.sql(f"drop table if exists {name}")
    rows.write.format("parquet").bucketBy(count, *keys).sortBy(*keys).option("path", path or shared_path(spark, name)).saveAsTable(name)
    return spark.table(name)
