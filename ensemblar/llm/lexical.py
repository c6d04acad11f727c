"""Ranked lexical search by range-maximum sparse tables.

Documents are gathered in chunks ordered by id, where they lie. A chunk keeps, for each term that the queries
hold, the list of its documents with their impacts (what the term adds to the score, apart from its
weight), and a sparse table over each list that gives the largest impact of any interval and the
document that has it. A query begins with the whole chunk as one interval. The best interval is split at the
document that its strongest term points to; that document is scored, and the two rests are bounded by the sum of
their terms' maxima. Intervals that can't enter the best k any more are dropped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: What stands in a term: 0-9, a-z and all bytes from 0x80 on; A-Z are lowered and every other byte parts terms.
FOLD = bytes(b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: A chunk's documents and postings at most (one document with more is a chunk of its own), and bytes of query texts that are searched in one pass.
CHUNK_DOCS, CHUNK_POSTINGS, QUERY_BYTES = 1 << 13, 1 << 19, 4 << 20
#: Intervals that are split side by side, and parts that a query's finds are dealt out to before they meet.
WIDTH, SALTS = 96, 256
#: The document's place stands in the low bits of a table's entry.
PLACE = 20
MASK = (1 << PLACE) - 1
CHUNK = "docs long, words long, terms array<int>, sizes array<int>, ids binary, no_id binary, lengths binary, places binary, counts binary"


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in order, with repeats."""
    return (text or b"").translate(FOLD).split()


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


CHUNK_ARROW = pa.schema([("docs", pa.int64()), ("words", pa.int64()), ("terms", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), *((n, pa.binary()) for n in ("ids", "no_id", "lengths", "places", "counts"))])


def chunks(docs: DataFrame, terms: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", most_docs: int = CHUNK_DOCS, most_postings: int = CHUNK_POSTINGS) -> DataFrame:
    """Posting lists of the numbered ``terms``, a row for each chunk of a partition's documents.

    docs and words count all documents that have terms, and their terms; the lists hold those with a query's term, by id, null ids last.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bool, int, int, list[tuple[int, int]]]] = []
        total = seen = words = 0

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda d: d[:3])
            term = np.fromiter((t for d in held for t, _ in d[3]), np.int32, total)
            count = np.fromiter((c for d in held for _, c in d[3]), np.int64, total)
            place = np.repeat(np.arange(len(held), dtype=np.int32), [len(d[3]) for d in held]) if held else np.empty(0, np.int32)
            order = np.argsort(term, kind="stable")
            names, sizes = np.unique(term, return_counts=True)
            row = {"docs": seen, "words": words, "terms": names.tolist(), "sizes": sizes.tolist(), "places": place[order].tobytes(), "counts": count[order].tobytes()}
            row |= {"ids": np.array([d[1] for d in held], np.int64).tobytes(), "no_id": np.array([d[0] for d in held], np.bool_).tobytes(), "lengths": np.array([d[2] for d in held], np.int64).tobytes()}
            return _arrow([row], CHUNK_ARROW)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, text in zip(ids, batch.column(1).cast(pa.binary()), strict=True):
                found = terms_of(text.as_py())
                hits = [(terms[t], c) for t, c in Counter(found).items() if t in terms]
                if hits:
                    if held and (total + len(hits) > most_postings or len(held) >= most_docs):
                        yield flush()
                        held.clear()
                        total = seen = words = 0
                    held.append((i is None, i or 0, len(found), hits))
                    total += len(hits)
                seen, words = seen + bool(found), words + len(found)
        if seen:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(gather, CHUNK)


class Tables:
    """A chunk's posting lists, laid end to end, with one sparse table over them; ranges never leave a list."""

    def __init__(self, row: dict, documents: int, words: int) -> None:
        self.ids, self.no_id = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["no_id"], np.bool_)
        self.places, counts = np.frombuffer(row["places"], np.int32), np.frombuffer(row["counts"], np.int64)
        sizes = np.array(row["sizes"], np.int64)
        ends = np.cumsum(sizes)
        self.lists = {t: (int(e - n), int(e)) for t, n, e in zip(row["terms"], sizes, ends, strict=True)}
        # whole numbers of any size: length times documents may pass 64 bits
        m = np.array([75 + 25 * n * documents // words for n in np.frombuffer(row["lengths"], np.int64).tolist()], np.int64)
        impact = 1_000_000_000 * counts // (1000 * counts + 12 * m[self.places])
        first = impact << PLACE | (MASK - self.places)  # the largest impact, and of these the first document
        levels = int(sizes.max(initial=1)).bit_length()
        # the entry behind the end stands for an empty range
        self.best = np.zeros((levels, len(first) + 1), np.int64)
        self.best[0, :-1] = first
        for k in range(1, levels):
            half, n = 1 << (k - 1), len(first) - (1 << k) + 1
            np.maximum(self.best[k - 1, :n], self.best[k - 1, half : half + n], out=self.best[k, :n])
        self.log = np.array([0, *(n.bit_length() - 1 for n in range(1, len(self.ids) + 2))], np.int64)

    def search(self, weights: list[tuple[int, int]], top: list[tuple[int, bool, int]], k: int) -> list[tuple[int, bool, int]]:
        """The best ``k`` of ``top`` and of this chunk as (-score, no id, id), for (term, weight) of one query."""
        weights = [(self.lists[t], w) for t, w in weights if t in self.lists]
        if not weights:
            return top
        begin = np.array([x[0] for x, _ in weights])[:, None]
        weight = np.array([w for _, w in weights], np.int64)[:, None]
        n, end = len(self.ids), self.best.shape[1] - 1

        def ranges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Bound and splitting place of intervals given by the ends of each term's range."""
            size = b - a
            level = self.log[size]
            empty = size == 0
            left, right = np.where(empty, end, begin + a), np.where(empty, end, begin + b - (1 << level))
            found = np.maximum(self.best[level, left], self.best[level, right])
            adds = (found >> PLACE) * weight
            strongest = adds.argmax(0)
            return adds.sum(0), MASK - (found[strongest, np.arange(found.shape[1])] & MASK)

        full = len(top) >= k
        whole = np.array([[e - b] for (b, e), _ in weights])
        bound, split = ranges(np.zeros_like(whole), whole)
        if full and bound[0] < -top[-1][0]:
            return top
        # how many of a term's documents stand before each place
        before = np.zeros((len(weights), n + 1), np.int32)
        for row, ((b, e), _) in enumerate(weights):
            before[row, self.places[b:e] + 1] = 1
        np.cumsum(before, axis=1, out=before)
        low, high = np.array([0]), np.array([n])
        while len(bound):
            if len(top) >= k:
                least, no_id, last = top[-1]
                # equal scores go by id: those behind the last can't enter
                open_ = (bound > -least) | ((bound == -least) & ((self.no_id[low] < no_id) | ((self.no_id[low] == no_id) & (self.ids[low] <= last))))
                bound, split, low, high = bound[open_], split[open_], low[open_], high[open_]
                if not len(bound):
                    break
            if len(bound) > WIDTH:
                order = np.argpartition(bound, len(bound) - WIDTH)
                rest, now = order[:-WIDTH], order[-WIDTH:]
            else:
                rest, now = np.empty(0, np.int64), np.arange(len(bound))
            at, lo, hi = split[now], low[now], high[now]
            a, b = before[:, at], before[:, at + 1]
            scores = ((self.best[0, np.where(b > a, begin + a, end)] >> PLACE) * weight).sum(0)
            new = zip((-scores).tolist(), self.no_id[at].tolist(), self.ids[at].tolist(), strict=True)
            least = top[-1] if len(top) >= k else None
            top = sorted([*top, *(x for x in new if least is None or x < least)])[:k]
            lows, highs = np.concatenate([lo, at + 1]), np.concatenate([at, hi])
            some = lows < highs
            lows, highs = lows[some], highs[some]
            bounds, splits = ranges(before[:, lows], before[:, highs])
            some = bounds > 0
            bound, split, low, high = (np.concatenate([x[rest], y[some]]) for x, y in ((bound, bounds), (split, splits), (low, lows), (high, highs)))
        return top


def _pass(docs: DataFrame, texts: list[bytes | None], k: int, id_col: str, text_col: str, most_docs: int, most_postings: int) -> DataFrame:
    """(query, score, id, no_id): of each task the best ``k`` documents of each query, in at most two passes over compact lists."""
    counted = [Counter(terms_of(t)) for t in texts]
    numbers = {t: n for n, t in enumerate(sorted({t for c in counted for t in c}))}
    lists = cut(chunks(docs, numbers, id_col, text_col, most_docs, most_postings))
    documents, words = lists.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    found = lists.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes")).collect()  # a row a term of the queries
    weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for t, df in found}
    queries = [[(numbers[t], c * weight[numbers[t]]) for t, c in q.items() if weight.get(numbers[t], 0) > 0] for q in counted]
    out = pa.schema([("query", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("no_id", pa.bool_())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: list[list] = [[] for _ in queries]
        for batch in batches:
            for n in range(batch.num_rows):
                tables = Tables(batch.slice(n, 1).to_pylist()[0], documents, words)
                for q, weights in enumerate(queries):
                    tops[q] = tables.search(weights, tops[q], k)
        yield _arrow([{"query": q, "score": -s, "id": i, "no_id": x} for q, top in enumerate(tops) for s, x, i in top], out)

    return lists.where(F.size("terms") > 0).mapInArrow(search, "query int, score long, id long, no_id boolean")


def rank_documents(
    docs: DataFrame, queries: DataFrame, k: int = 20, query_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", query_text: str = "text",
    most_docs: int = CHUNK_DOCS, most_postings: int = CHUNK_POSTINGS, query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """(query_col, rank, id_col, score): the ``k`` documents of ``docs`` with the highest score above zero for each row of ``queries``.

    All documents are searched for every query. Queries are read in blocks of ``query_bytes`` of text; each
    block is a pass over the documents, so that what a task holds is bounded whatever the
    number of queries. Ids are whole numbers; equal scores go by ascending id, null ids last. Null, empty and
    termless texts are no documents and, as queries, have no rows. Rows that repeat an id are documents of their own, and
    rows that repeat a query are ranked apart. Texts of any length are read whole. Other columns, whatever
    their names, are ignored; an empty table gives an empty result.
    """
    spark, found = docs.sparkSession, None
    block: list = []
    schema = queries.select(F.lit(0).alias("query"), F.col(query_col).alias("item")).schema

    def ranked(rows: list) -> DataFrame:
        best = _pass(docs, [r[1].encode("utf-8", "surrogatepass") if r[1] is not None else None for r in rows], k, id_col, text_col, most_docs, most_postings)
        order = [F.desc("score"), F.asc("no_id"), F.asc("id")]
        # a query's finds meet in parts first
        salted = best.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        part = Window.partitionBy("query", "salt").orderBy(*order)
        salted = salted.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k).drop("rank", "salt")
        best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, r[0]) for n, r in enumerate(rows)], schema)
        return best.join(F.broadcast(names), "query").select(F.col("item").alias(query_col), "rank", F.when(~F.col("no_id"), F.col("id")).alias(id_col), "score")

    size = 0
    for row in queries.select(F.col(query_col), F.col(query_text)).toLocalIterator():
        n = len((row[1] or "").encode("utf-8", "surrogatepass"))
        if block and size + n > query_bytes:
            found = ranked(block) if found is None else found.union(ranked(block))
            block, size = [], 0
        block.append(row)
        size += n
    if block or found is None:
        found = ranked(block) if found is None else found.union(ranked(block))
    return found
