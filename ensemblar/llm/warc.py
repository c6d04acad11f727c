"""WARC archives with a two-level capture index.

Archives are gzip members, one a record, so that a record can be read by range.
The index holds a line for each capture, sorted by reversed-host key, in compressed
blocks; each index file ends with a sparse directory of its blocks' first keys. A
lookup finds the index file by its first key, searches the directory, then the block,
then reads the record's range.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_path
from .urls import host_and_path

RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Index lines in a block; bytes after which an archive is closed and another begun.
BLOCK_LINES, ARCHIVE_BYTES = 256, 1 << 30
#: A table of this many bytes at most is broadcast.
SMALL = 8 << 20


def capture_key(url: Column, record_id: Column) -> Column:
    """Host reversed by labels, then path and query, then the id: captures of a host stand together."""
    host, path = host_and_path(url)
    rest = F.regexp_extract(url, r"\?[^#]*", 0)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path, F.coalesce(rest, F.lit("")), F.lit(" "), F.coalesce(record_id.cast("string"), F.lit("null")))


def write_record(kind: str, record_id: str, url: str | None, payload: bytes, digest: str, date: str, refers_to: str | None = None, refers_url: str | None = None) -> bytes:
    """One gzip member. A revisit holds the digest and the reference, but no payload. Urls hold no line breaks."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url}")
    if kind == REVISIT:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {refers_url}")
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    else:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    text = "WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n"
    tool = zlib.compressobj(4, zlib.DEFLATED, 31)
    return tool.compress(text.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n") + tool.flush()


def read_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case, and the payload behind the HTTP header. ValueError where the record is damaged."""
    tool = zlib.decompressobj(31)
    try:
        data = tool.decompress(member)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = {k.lower(): v.removeprefix(" ") for k, _, v in (x.partition(":") for x in lines)}
    length = int(fields.get("content-length", -1))
    if not tool.eof or not first.startswith("WARC/1.") or not gap or rest[length:] != b"\r\n\r\n":
        raise ValueError("no whole record here")
    return fields, rest[:length].partition(b"\r\n\r\n")[2]


class Archive:
    """Writes records one after another; files are closed and named by their content's writer, so that a repeated task leaves its own."""

    def __init__(self, folder: str) -> None:
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.base, recursive=True)
        self.out, self.at, self.name = None, 0, ""

    def add(self, member: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= ARCHIVE_BYTES:
            self.close()
            self.name = f"{self.base}/{uuid.uuid4().hex}.warc.gz"
            self.out, self.at = self.fs.open_output_stream(self.name, compression=None), 0
        place = (self.name, self.at, len(member))
        self.out.write(member)
        self.at += len(member)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class Ranges:
    """Range reads with a few files held open."""

    def __init__(self, folder: str, most: int = 32) -> None:
        self.fs, _ = pafs.FileSystem.from_uri(folder)
        self.open: OrderedDict[str, object] = OrderedDict()
        self.most = most

    def size(self, path: str) -> int:
        return self._file(path).size()

    def read(self, path: str, offset: int, length: int) -> bytes:
        return self._file(path).read_at(length, offset)

    def _file(self, path: str):
        if path not in self.open:
            self.open[path] = self.fs.open_input_file(path)
            if len(self.open) > self.most:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(path)
        return self.open[path]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for every row and returns the captures (key, path, offset, length).

    Of rows with equal payloads of ``least`` bytes or more, those with the smallest id
    (one, unless rows repeat) are responses and the others revisits of it. Null payloads
    count as empty; null ids and urls are written as such, and a group of null ids alone has responses only. The captures are cut from their
    lineage, so that they name files of tasks that ended well.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.replace(F.replace(url_col, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "key": capture_key(F.col("url"), F.col("id"))})
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("head"), F.min_by("url", "id").alias("head_url"), F.count(F.lit(1)).alias("n"), F.max(F.octet_length("url")).alias("w"))
    firsts = cut(firsts.where("n > 1"))
    size = firsts.agg(F.sum(F.lit(100) + F.coalesce("w", F.lit(0)))).first()[0] or 0
    firsts = firsts.select("digest", "head", "head_url")
    marked = rows.join(F.broadcast(firsts) if size <= SMALL else firsts, "digest", "left")
    kind = F.when(F.col("head").isNull() | (F.col("id") == F.col("head")), RESPONSE).otherwise(REVISIT)
    marked = marked.select("key", F.col("id").cast("string").alias("id"), "url", "payload", "digest", F.coalesce(kind, F.lit(REVISIT)).alias("kind"), F.col("head").cast("string").alias("head"), "head_url")

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive = Archive(folder)
        places = []
        for batch in batches:
            for r in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                again = r.kind == REVISIT
                member = write_record(r.kind, r.id if r.id is not None else "null", r.url, b"" if again else bytes(r.payload), r.digest, date, r.head if again else None, r.head_url if again else None)
                places.append((r.key, *archive.add(member)))
        archive.close()
        yield pd.DataFrame(places, columns=["key", "path", "offset", "length"])

    return cut(marked.mapInPandas(write, "key string, path string, offset long, length long"))


def write_index(captures: DataFrame, folder: str, shards: int | None = None) -> list[tuple[str, str]]:
    """Writes the sorted index and returns (first key, path) of its files, of which there are ``shards`` at most."""
    shards = shards or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        path, lines, directory, at, out = f"{base}/{uuid.uuid4().hex}.idx", [], [], 0, None

        def flush() -> None:
            nonlocal lines, at, out
            out = out or fs.open_output_stream(path, compression=None)
            data = zlib.compress(json.dumps(lines).encode())
            directory.append((lines[0][0], at, len(data)))
            out.write(data)
            lines, at = [], at + len(data)

        for batch in batches:
            for row in batch.itertuples(index=False):
                lines.append(list(row))
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail + len(tail).to_bytes(8, "little"))
            out.close()
            yield pd.DataFrame({"first": [directory[0][0]], "path": [path]})

    ordered = captures.select("key", "path", "offset", "length").repartitionByRange(shards, "key").sortWithinPartitions("key", "path", "offset")
    return sorted((r["first"], r["path"]) for r in ordered.mapInPandas(write, "first string, path string").collect())


class CaptureIndex:
    """Finds captures by key."""

    def __init__(self, files: list[tuple[str, str]], folder: str) -> None:
        self.files, self.ranges = files, Ranges(folder)
        self.firsts = [f.encode("utf-8", "surrogatepass") for f, _ in files]
        self.held: OrderedDict[object, list] = OrderedDict()

    def _part(self, path: str, offset: int, length: int) -> list:
        at = (path, offset)
        if at not in self.held:
            rows = json.loads(zlib.decompress(self.ranges.read(path, offset, length)))
            self.held[at] = [(r[0].encode("utf-8", "surrogatepass"), *r[1:]) for r in rows]
            if len(self.held) > 16:
                self.held.popitem(last=False)
        self.held.move_to_end(at)
        return self.held[at]

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(path, offset, length) of every capture with this key."""
        wanted = key.encode("utf-8", "surrogatepass")
        shard = bisect_right(self.firsts, wanted) - 1
        if shard < 0:
            return
        path = self.files[shard][1]
        size = self.ranges.size(path)
        tail = int.from_bytes(self.ranges.read(path, size - 8, 8), "little")
        directory = self._part(path, size - 8 - tail, tail)
        block = max(0, bisect_left(directory, (wanted,)) - 1)
        while block < len(directory) and directory[block][0] <= wanted:
            lines = self._part(path, *directory[block][1:])
            for line in lines[bisect_left(lines, (wanted,)) :]:
                if line[0] != wanted:
                    return
                yield line[1:]
            block += 1


def fetch(keys: DataFrame, files: list[tuple[str, str]], folder: str, key_col: str = "key") -> DataFrame:
    """(key, id, url, record_type, refers_to, refers_url, digest, payload) of every capture of the distinct keys.

    ``files`` is as long as the index has files. Keys are looked up in order, so that neighbours share blocks.
    """
    found = keys.sparkSession.sparkContext.broadcast(files)

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, records = CaptureIndex(found.value, folder), Ranges(folder)
        names = ["key", "id", "url", "record_type", "refers_to", "refers_url", "digest", "payload"]
        page = lambda x: None if x is None else x.removeprefix("<urn:page:").removesuffix(">")
        for batch in batches:
            rows, size = [], 0
            for key in batch[key_col]:
                for path, offset, length in index.find(key):
                    f, payload = read_record(records.read(path, offset, length))
                    again = f["warc-type"] == REVISIT
                    rows.append((key, page(f["warc-record-id"]), f.get("warc-target-uri"), f["warc-type"], page(f.get("warc-refers-to")), f.get("warc-refers-to-target-uri"), f["warc-payload-digest"].removeprefix("sha256:"), None if again else payload))
                    size += len(payload)
                    if size > 1 << 24:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=names, dtype=object)

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.select(key_col).distinct().repartitionByRange(n, key_col).sortWithinPartitions(key_col)
    return ordered.mapInPandas(read, "key string, id string, url string, record_type string, refers_to string, refers_url string, digest string, payload binary")


def archive_and_read_back(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, folder: str | None = None) -> DataFrame:
    """Writes archives and index to ``folder`` (a new one in the shared folder if not given), then looks up every row's key and reads its record.

    (id_col, payload_bytes, payload_digest, record_type, refers_to, archived_url) for every row; a
    revisit's payload is read from the response that it refers to. Repeated rows
    each have a record and a row. An empty table gives an empty result.
    """
    folder = folder or shared_path(pages.sparkSession, "warc")
    captures = write_archives(pages, f"{folder}/archives", id_col, url_col, payload_col, least)
    files = write_index(captures, f"{folder}/index")
    seen = ["key", "id", "url", "record_type", "refers_to", "refers_url", "digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("sum")]
    read = cut(fetch(captures, files, folder).select(*seen))
    again = read.where(F.col("record_type") == REVISIT).withColumn("target", capture_key(F.col("refers_url"), F.col("refers_to")))
    # rows may repeat the response's id and url, with this payload or another
    targets = fetch(again.select("target"), files, folder, "target").select(F.col("key").alias("target"), F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("sum")).distinct()
    again = again.drop("bytes", "sum").join(targets.withColumn("digest", F.col("sum")), ["target", "digest"], "left")
    kind = pages.schema[id_col].dataType
    whole = read.where(F.col("record_type") == RESPONSE).unionByName(again.drop("target").select(*read.columns))
    back = lambda c: F.when(F.col(c) != "null", F.col(c)).cast(kind)
    return whole.select(back("id").alias(id_col), F.col("bytes").alias("payload_bytes"), F.col("sum").alias("payload_digest"), "record_type", back("refers_to").alias("refers_to"), F.col("url").alias("archived_url"))
