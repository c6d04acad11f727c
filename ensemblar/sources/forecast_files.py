"""Forecast files as a data source: ``spark.read.format("forecast_files")``.

Init, member and lead stand in the names of files or folders. Files are listed before any is read, filters on those three go into
the list, and what is left is dealt out one partition an init. Columns of a file that stand in its name as well are taken from the name.

    register(spark)
    spark.read.format("forecast_files").option("layout", "flat_files").load(path).where("init_date = date'2020-01-01' and number < 5")
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

#: Patterns of the layouts' paths below the root; groups are columns.
LAYOUTS = {
    "seed_dirs": r"init_date=(?P<init_date>[^/]+)/seed=(?P<seed>\d+)/[^/]+$",
    "nested": r"init_date=(?P<init_date>[^/]+)/number=(?P<number>\d+)/lead_day=(?P<lead_day>\d+)(?:/[^/]+|\.\w+)$",
    "flat_files": r"(?:^|/)[^/]*_(?P<init_date>\d{8})(?P<hour>\d{2})_ens_(?P<number>\d+)\.\w+$",
    "member_dirs": r"number=(?P<number>\d+)/[^/]+$",
}


def _date(text: str) -> dt.date:
    return dt.date.fromisoformat(text)  # with or without hyphens


KINDS: dict[str, tuple[pa.DataType, Callable[[str], object]]] = {"init_date": (pa.date32(), _date), "seed": (pa.int32(), int), "number": (pa.int32(), int), "lead_day": (pa.int32(), int), "hour": (pa.int32(), int)}


def _parquet(fs: pafs.FileSystem, path: str, columns: list[str] | None) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    with fs.open_input_file(path) as f:
        file = pq.ParquetFile(f)
        have = None if columns is None else [c for c in columns if c in file.schema_arrow.names]
        for batch in file.iter_batches(batch_size=65_536, columns=have):
            yield batch


def _csv(fs: pafs.FileSystem, path: str, columns: list[str] | None) -> Iterator[pa.RecordBatch]:
    import pyarrow.csv as pc

    with fs.open_input_file(path) as f:
        table = pc.read_csv(f)
        yield from table.select([c for c in table.column_names if columns is None or c in columns]).to_batches()


def _feather(fs: pafs.FileSystem, path: str, columns: list[str] | None) -> Iterator[pa.RecordBatch]:
    with fs.open_input_file(path) as f, pa.ipc.open_file(f) as file:
        for k in range(file.num_record_batches):
            batch = file.get_batch(k)
            yield batch.select([c for c in batch.schema.names if columns is None or c in columns])


def _parquet_schema(fs: pafs.FileSystem, path: str) -> pa.Schema:
    import pyarrow.parquet as pq

    with fs.open_input_file(path) as f:
        return pq.read_schema(f)


#: How files are read, by codec; add a format's reader here: (file system, path, columns or None for all) -> record batches.
CODECS: dict[str, Callable[[pafs.FileSystem, str, list[str] | None], Iterator[pa.RecordBatch]]] = {"parquet": _parquet, "csv": _csv, "feather": _feather}


@dataclass
class Named:
    """A file and what its name says."""

    path: str
    keys: dict[str, object]


@dataclass
class Init(InputPartition):
    """The files of one init."""

    files: list[Named]


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (pafs.LocalFileSystem(), path)


def listed(path: str, layout: str) -> list[Named]:
    """The files below a path that a layout fits, in the order of what their names say."""
    fs, root = _file_system(path)
    pattern, found = re.compile(LAYOUTS[layout]), []
    for info in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
        if info.type == pafs.FileType.File and not info.base_name.startswith(("_", ".")) and (m := pattern.search(info.path[len(root) :].lstrip("/"))):
            found.append(Named(info.path, {k: KINDS[k][1](v) for k, v in m.groupdict().items()}))
    return sorted(found, key=lambda f: (*f.keys.values(), f.path))


def _test(f: Filter, keys: dict[str, object]) -> bool:
    """Whether a file with these keys can hold rows that fit."""
    if isinstance(f, Not):
        return not _test(f.child, keys)
    value = keys[f.attribute[0]]
    if isinstance(f, IsNotNull):
        return True
    if isinstance(f, In):
        return value in f.value
    operation = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}[type(f)]
    return getattr(value, operation)(f.value)


class ForecastReader(DataSourceReader):
    """Reads the files that the filters leave, an init a partition."""

    def __init__(self, path: str, files: list[Named], codec: str, schema: StructType, most_files: int) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.files, self.codec, self.most_files = path, files, codec, most_files
        self.schema = to_arrow_schema(schema)
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        names = set(self.files[0].keys) if self.files else set()
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            if isinstance(inner, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)) and inner.attribute[0] in names and len(inner.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        kept = [f for f in self.files if all(_test(x, f.keys) for x in self.filters)]
        by_init: dict[object, list[Named]] = {}
        for f in kept:
            by_init.setdefault(f.keys.get("init_date", f.keys.get("number")), []).append(f)
        self.files = []  # a task needs its own alone
        return [Init(files[k : k + self.most_files]) for files in by_init.values() for k in range(0, len(files), self.most_files)]

    def read(self, partition: Init) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing is left of the list
            return
        fs = _file_system(self.path)[0]
        for file in partition.files:
            own = [f.name for f in self.schema if f.name not in file.keys]
            for batch in CODECS[self.codec](fs, file.path, own):
                columns = []
                for f in self.schema:
                    if f.name in file.keys:
                        columns.append(pa.array([file.keys[f.name]], f.type).take(pa.nulls(0, pa.int64()) if not batch.num_rows else pa.array([0] * batch.num_rows)))
                    elif f.name in batch.schema.names:
                        columns.append(batch.column(f.name).cast(f.type))
                    else:
                        columns.append(pa.nulls(batch.num_rows, f.type))
                yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


class ForecastFiles(DataSource):
    """Options: path; layout, one of LAYOUTS; codec, one of CODECS (parquet); files_per_task, of one init (64). Without a schema, that of the first file and of the names."""

    @classmethod
    def name(cls) -> str:
        return "forecast_files"

    def _listed(self) -> list[Named]:
        if self.options.get("layout") not in LAYOUTS:
            raise ValueError(f"unknown layout {self.options.get('layout')!r}; there are {sorted(LAYOUTS)}")
        if self.options.get("codec", "parquet") not in CODECS:
            raise ValueError(f"unknown codec {self.options['codec']!r}; there are {sorted(CODECS)}")
        return listed(self.options["path"], self.options["layout"])

    def schema(self) -> StructType:
        files = self._listed()
        if not files:
            raise ValueError(f"no files of layout {self.options['layout']} under {self.options['path']}; give a schema")
        fs = _file_system(self.options["path"])[0]
        codec = self.options.get("codec", "parquet")
        own = _parquet_schema(fs, files[0].path) if codec == "parquet" else next(CODECS[codec](fs, files[0].path, None)).schema
        fields = [pa.field(f.name, f.type) for f in own if f.name not in files[0].keys] + [pa.field(k, KINDS[k][0]) for k in files[0].keys]
        return from_arrow_schema(pa.schema(fields))

    def reader(self, schema: StructType) -> DataSourceReader:
        return ForecastReader(self.options["path"], self._listed(), self.options.get("codec", "parquet"), schema, int(self.options.get("files_per_task", 64)))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it take filters."""
    spark.dataSource.register(ForecastFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
