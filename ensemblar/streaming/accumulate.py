"""Rank counts and window means from streams of new files.

Each micro-batch is a variant of a score store, named by its number: a batch that is run again replaces itself and nothing
else, and readers see whole batches only. Counts are additive: the sum over batches equals the batch query's. Inits whose members come in
several files, in any order, are held as state until they are whole. What needs all inits at once, such as the
leave-one-year-out bias, is not for streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.align import ensemble_cases
from ..operators.scores import ranked
from ..sources.sinks import ScoreStore


def run_available(stream: DataFrame, checkpoint: str, path: str, make: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Takes the files that are new since the checkpoint and ends; ``make`` of each batch's rows goes to the store at ``path``.

    Windowed aggregations come in update mode: only rows that changed.
    """

    def write(df: DataFrame, batch: int) -> None:
        ScoreStore(df.sparkSession, path).publish(make(df) if make else df, str(batch))

    with _state_store(stream.sparkSession):
        query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    return query


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """RocksDB for streams that start here: the store of timers and of lists that grow; the session's choice comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Days after the newest file in which an older one may still come; the file source itself takes none that is older.
LATE_DAYS = 7


def forecast_stream(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    """Forecast rows as files come in, with the time at which their file was written, ``arrived``."""
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("maxFileAge", f"{LATE_DAYS}d").parquet(path)
    return read.withColumn("arrived", F.col("_metadata.file_modification_time")).withWatermark("arrived", f"{LATE_DAYS} days")


#: Rows that are sorted into packs at once, and rows of a pack at most.
HELD, PACK = 1 << 19, 1 << 16


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(packs: Iterable[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in packs]).combine_chunks()


def _packs(keys: list[str], expected: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows to packs: a row for each key and time of arrival with its number of rows, what it expects, and the rows in Arrow's format."""
    by = [*keys, "arrived"]

    def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        order = pc.sort_indices(table.select(by), [(c, "ascending") for c in by])
        table = table.take(order).combine_chunks()
        # a pack starts where a key differs from that of the row before
        begins = np.zeros(len(table), bool)
        begins[:1] = True
        for c in by:
            codes = table[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            begins[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(begins)
        starts = np.unique(np.concatenate([np.arange(a, z, PACK) for a, z in zip(starts, [*starts[1:], len(table)], strict=True)]))
        sizes = np.diff([*starts, len(table)])
        rows = table.drop_columns("arrived")
        parts = [rows.slice(a, n) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        most = [pc.max(p[expected]).as_py() for p in parts]
        whole = table.select(by).take(pa.array(starts))
        for name, values in (("n", pa.array(sizes, pa.int64())), ("expected", pa.array(most, pa.int64())), ("pack", pa.array(map(_packed, parts), pa.binary()))):
            whole = whole.append_column(name, values)
        yield from whole.to_batches()

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= HELD:
                yield from out(held)
                held, n = [], 0
        if n:
            yield from out(held)

    return pack


class _Held(StatefulProcessor):
    """Holds a key's packs of rows until there are as many rows as it expects, or a timer ends the wait."""

    def __init__(self, same: list[str], wait: int) -> None:
        self.same, self.wait = same, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "pack binary")
        # rows held; -1 once they have gone on
        self.count = handle.getValueState("count", "n long")

    def _distinct(self, packs: list[bytes]) -> pa.Table:
        """The first of the rows that are alike."""
        rows = _unpacked(packs)
        table = pa.table({f"k{i}": rows[c] for i, c in enumerate(self.same)})
        if any(pa.types.is_nested(t) for t in table.schema.types):
            first: dict[str, int] = {}
            for i, r in enumerate(table.to_pylist()):
                first.setdefault(repr(r), i)
            return rows.take(pa.array(list(first.values()), pa.int64()))
        firsts = table.append_column("at", pa.array(np.arange(len(rows)))).group_by(table.column_names).aggregate([("at", "min")])["at_min"]
        return rows if len(firsts) == len(rows) else rows.take(firsts.take(pc.sort_indices(firsts)))

    def _out(self, rows: pa.Table, whole: bool) -> Iterator[Row]:
        yield from (Row(pack=_packed(rows.slice(a, PACK)), whole=whole) for a in range(0, len(rows), PACK))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        state = self.count.get()
        n = state[0] if state else 0
        if n < 0:
            return
        new = list(rows)
        if not n:
            self.handle.registerTimer(int(max(r["arrived"] for r in new).timestamp() * 1000) + self.wait)
        expected = max((r["expected"] for r in new if r["expected"] is not None), default=None)
        packs, n_new = [(bytes(r["pack"]),) for r in new], sum(r["n"] for r in new)
        if expected is None or n + n_new < expected:
            self.held.appendList(packs)
            self.count.update((n + n_new,))
            return
        found = self._distinct([p for (p,) in ([*self.held.get(), *packs] if n else packs)])
        if len(found) < expected:  # some came twice
            self.held.put([(_packed(found.slice(a, PACK)),) for a in range(0, len(found), PACK)])
            self.count.update((len(found),))
            return
        self.held.clear()
        self.count.update((-1,))
        yield from self._out(found, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        state = self.count.get()
        if state and state[0] > 0:
            rows = self._distinct([p for (p,) in self.held.get()])
            self.held.clear()
            self.count.update((-1,))
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.wait)
            yield from self._out(rows, False)
        else:
            self.count.clear()

    def close(self) -> None:
        pass


def _unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of packs, with ``whole``."""
    for batch in batches:
        for pack, whole in zip(batch["pack"].to_pylist(), batch["whole"].to_pylist(), strict=True):
            rows = _unpacked([pack])
            yield from rows.append_column("whole", pa.array([whole] * len(rows), pa.bool_())).to_batches()


def whole_inits(stream: DataFrame, keys: list[str], same: list[str], expected: str, wait_days: int = 30) -> DataFrame:
    """The rows of ``forecast_stream`` once all of their key are there, with ``whole``; arrival is left behind.

    ``expected`` is a column with the number of rows that the key will have; rows alike in ``same`` count once, the first stays. A key goes
    on once: rows that come again later are left out. One that isn't whole ``wait_days`` after its first file (by the times of files, so that
    a second run decides alike) goes on as it is, with whole = false. What the state holds is what is not whole yet; keys by
    init, lead and a tile of cells keep one key's rows few where fields are large. Rows are shuffled and held in packs, one a key where a
    task's files hold it together, so that Python handles packs and not rows.
    """
    rows = stream.select(*keys, *(c for c in stream.columns if c not in keys))
    by = [rows.schema[c] for c in [*keys, "arrived"]]
    # with its metadata arrival stays the watermark's column
    kind = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in by] + [T.StructField("n", T.LongType()), T.StructField("expected", T.LongType()), T.StructField("pack", T.BinaryType())])
    packs = rows.mapInArrow(_packs(keys, expected), kind)
    held = packs.groupBy(*keys).transformWithState(_Held(same, wait_days * 86_400_000), "pack binary, whole boolean", "Update", "EventTime")
    out = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema if f.name != "arrived"] + [T.StructField("whole", T.BooleanType())])
    return held.mapInArrow(_unpack, out)


def rank_counts(rows: DataFrame, truth: DataFrame, keys: list[str], by: list[str], seed: int = 0) -> DataFrame:
    """Counts by rank of a batch of forecast rows; its members are packed before truth is joined."""
    return ranked(ensemble_cases(rows, truth, keys), [k for k in keys if k not in by], seed).groupBy(*by, "n", "rank").agg(F.count(F.lit(1)).alias("count"))


def summed(spark: SparkSession, path: str, by: list[str], count: str = "count") -> DataFrame:
    """The batches' counts together."""
    return ScoreStore(spark, path).read().groupBy(*by).agg(F.sum(count).alias(count))


def latest(spark: SparkSession, path: str, by: list[str], columns: list[str]) -> DataFrame:
    """Of each key the row that the last batch gave."""
    newest = F.max_by(F.struct(*columns), F.col("variant").cast("long")).alias("_x")
    return ScoreStore(spark, path).read().groupBy(*by).agg(newest).select(*by, "_x.*")


def six_hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Means of event values in six-hour windows, for update mode. Rows over ``late`` behind the newest are left out once their window's state has gone."""
    windowed = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", "6 hours"))
    return windowed.agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")).select("event_type", F.col("window.start").alias("valid_time"), "value", "n")
