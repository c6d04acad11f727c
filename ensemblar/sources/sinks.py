"""Sinks for scores and tables.

A score store replaces what it holds at once: data is written beside what is there, and one small manifest, put in
place by a rename that can't overwrite, says which folders count. Readers follow the newest manifest, so that a job that
dies before its commit leaves the former scores as they were.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Manifests that are kept: readers that have begun with one of them still find its folders.
KEPT = 3


class ScoreStore:
    """Scores by variant under one path, on any file system that Spark reaches.

    ``data/variant=<name>/run=<id>/`` holds Parquet, ``manifests/<version>.json`` which run of each variant counts. Of two
    writers that commit at once one takes the next version, and the other reads it and tries again; each replaces its own variant only.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> tuple[int, dict[str, str]]:
        """The newest version, and the run of each variant; version 0 is the empty store."""
        versions = self._versions()
        if not versions:
            return 0, {}
        stream = self._fs.open(self._at("manifests", f"{versions[-1]:012}.json"))
        try:
            return versions[-1], json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def write(self, df: DataFrame, variant: str, partitions: list[str] | None = None) -> str:
        """Writes a run beside what is there; nobody sees it before it is committed."""
        run = uuid.uuid4().hex
        writer = df.write.partitionBy(*partitions) if partitions else df.write
        writer.parquet(self._run(variant, run))
        return run

    def _run(self, variant: str, run: str) -> str:
        return f"{self.path}/data/variant={quote(variant, safe='')}/run={run}"

    def commit(self, runs: dict[str, str | None]) -> int:
        """Makes runs count, all at once, and returns the version; a variant whose run is None goes."""
        while True:
            version, held = self.manifest()
            new = {k: v for k, v in {**held, **runs}.items() if v is not None}
            beside = self._at("manifests", f".{uuid.uuid4().hex}")
            out = self._fs.create(beside)
            out.write(json.dumps(new, sort_keys=True).encode())
            out.close()
            done = self._placed(beside, self._at("manifests", f"{version + 1:012}.json"))
            self._fs.delete(beside, False)
            if done:
                return version + 1

    def _placed(self, beside, target) -> bool:
        """Gives a file its name unless another has it. Renames of shared file systems do so; on one machine, where they overwrite, a link does."""
        if self._fs.getUri().getScheme() == "file":
            try:
                os.link(beside.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        try:
            return not self._fs.exists(target) and self._fs.rename(beside, target)
        except Py4JJavaError:
            if not self._fs.exists(target):
                raise
            return False

    def publish(self, df: DataFrame, variant: str, partitions: list[str] | None = None) -> int:
        """Writes and commits: the variant is the old one until it is the new one."""
        return self.commit({variant: self.write(df, variant, partitions)})

    def variants(self) -> list[str]:
        return sorted(self.manifest()[1])

    def read(self, variants: list[str] | None = None) -> DataFrame:
        """The rows of all variants, or of some, with ``variant``; one scan over the folders that count."""
        held = self.manifest()[1]
        missing = sorted(set(variants or []) - set(held))
        if missing or not held:
            raise ValueError(f"no scores of {missing or 'any variant'} under {self.path}")
        folders = [self._run(v, held[v]) for v in sorted(held) if variants is None or v in variants]
        found = self.spark.read.option("basePath", f"{self.path}/data").option("mergeSchema", True).parquet(*folders)
        return found.drop("run").withColumn("variant", F.col("variant").cast("string"))

    def vacuum(self) -> int:
        """Removes older manifests and the runs that none of the rest names; how many runs went. Not while a writer is between write and commit."""
        versions = self._versions()
        keep: set[str] = set()
        for v in versions[-KEPT:]:
            stream = self._fs.open(self._at("manifests", f"{v:012}.json"))
            keep |= {f"{quote(k, safe='')}/{r}" for k, r in json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))).items()}
            stream.close()
        for v in versions[:-KEPT]:
            self._fs.delete(self._at("manifests", f"{v:012}.json"), False)
        gone = 0
        for variant in self._names("data"):
            for run in self._names(f"data/{variant}"):
                if run.startswith("run=") and f"{variant.removeprefix('variant=')}/{run.removeprefix('run=')}" not in keep:
                    self._fs.delete(self._at("data", variant, run), True)
                    gone += 1
        return gone


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A long table as CSV with a header, or as Parquet."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)
