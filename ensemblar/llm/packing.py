"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Items of one length are alike, so the instance is the number of items of each
length: as many numbers as the capacity, whatever the corpus. The plan is made
on those, in groups of alike sequences; Spark ranks the pieces within their
length and looks up each one's place.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytebpe
from .common import cut

Group = tuple[int, list[tuple[int, int]]]
#: Items of one length that are ranked in one part.
RANKED = 1 << 16


def _smallest(left: np.ndarray, n: int, above: int = 0) -> list[int]:
    """The ``n`` smallest items longer than ``above``, with repeats."""
    out: list[int] = []
    for size in np.flatnonzero(left[above + 1 :])[:n].tolist():
        out += [size + above + 1] * int(min(n, left[size + above + 1]))
    return out[:n]


def dominating_set(left: np.ndarray, size: int) -> tuple[int, ...] | None:
    """The items that stand with one of ``size`` in some best solution, by Martello and Toth's rules; None where no rule decides.

    ``left`` counts items by length, that one taken out. A set dominates if what any other set puts beside the item could be put in the places
    of this one's: nothing fits beside it; one item does, and this is the longest; two do, and this one is as long as the best two
    together; or these are the longest that fits and one that of any two that fit together the shorter doesn't exceed.
    """
    room = len(left) - 1 - size
    fits = np.flatnonzero(left[: room + 1])
    if not len(fits):
        return ()
    longest = int(fits[-1])
    low = _smallest(left, 3)
    if longest == room or len(low) < 2 or low[0] + low[1] > room:
        return (longest,)
    if len(low) == 3 and sum(low) <= room:
        return None
    # the longest and what then fits
    left[longest] -= 1
    beside = np.flatnonzero(left[: room - longest + 1])
    left[longest] += 1
    second = int(beside[-1]) if len(beside) else 0
    longer = _smallest(left, 2, second)
    if second and (len(longer) < 2 or sum(longer) > room):
        return (longest, second)
    # the best two that fit together, by two ends that approach
    i, j, best = 0, len(fits) - 1, 0
    while i <= j:
        both = int(fits[i] + fits[j])
        if both > room or (i == j and left[fits[i]] < 2):
            j -= 1
        else:
            best = max(best, both)
            i += 1
    return (longest,) if longest >= best else None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Group], dict[int, int]]:
    """Sets that some best solution holds, as (sequences, [(length, items in each)]), and the counts left: Martello and Toth's reduction.

    Alike items are fixed together as long as at least three of each length stay, as no rule asks for more than that.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    fixed: list[Group] = []

    def take(n: int, *sizes: int) -> None:
        each = Counter(sizes)
        for s, k in each.items():
            left[s] -= n * k
        fixed.append((int(n), sorted(each.items(), reverse=True)))

    if left[capacity]:
        take(left[capacity], capacity)
    for size in range(capacity - 1, (capacity - 1) // 2, -1):
        other = capacity - size
        n = left[size] // 2 if other == size else min(left[size], left[other])
        if n and other <= size:
            take(n, size, other)
    changed = True
    while changed:
        changed = False
        for size in np.flatnonzero(left)[::-1].tolist():
            while left[size]:
                left[size] -= 1
                beside = dominating_set(left, size)
                left[size] += 1
                if beside is None:
                    break
                each = Counter((size, *beside))
                take(max(1, min((int(left[s]) - 3) // k for s, k in each.items())), size, *beside)
                changed = True
    return fixed, {int(s): int(left[s]) for s in np.flatnonzero(left)}


def best_fit(counts: dict[int, int], capacity: int) -> list[Group]:
    """Best-fit decreasing over counts: each item goes where the least room is left that takes it."""
    rooms: dict[int, list[Group]] = defaultdict(list)
    for size in sorted(counts, reverse=True):
        n, room = counts[size], size
        while n:
            while room <= capacity and not rooms[room]:
                room += 1
            m, held = rooms[room].pop() if room <= capacity else (n, [])
            free = min(room, capacity)
            each = free // size
            full = min(m, n // each)
            if full:
                rooms[free - each * size].append((full, [*held, (size, each)]))
            n -= full * each
            if full < m and n:
                rooms[free - n * size].append((1, [*held, (size, n)]))
                n, full = 0, full + 1
            if full < m and held:
                rooms[free].append((m - full, held))
    return [g for groups in rooms.values() for g in groups]


def plan(counts: dict[int, int], capacity: int) -> list[Group]:
    """Groups of alike sequences that hold every item once."""
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


class Places:
    """Where the item of a length and a rank goes."""

    def __init__(self, groups: list[Group]) -> None:
        given: dict[int, int] = defaultdict(int)
        rows, first = [], 0
        for n, held in groups:
            offset = 0
            for size, each in held:
                rows.append((size, given[size], first, each, offset))
                given[size] += n * each
                offset += size * each
            first += n
        rows.sort()
        self.size, self.low, self.first, self.each, self.offset = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5
        self.key = (self.size << 44) + self.low
        self.sequences = first

    def __call__(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (size << 44) + rank, side="right") - 1
        turn, within = np.divmod(rank - self.low[at], self.each[at])
        return self.first[at] + turn, self.offset[at] + within * size


def pack(items: DataFrame, length_col: str = "length", capacity: int = 2048, order: list[str] | None = None, ranked: int = RANKED) -> DataFrame:
    """``items`` with sequence_id and offset: gapless places from 0 in sequences of at most ``capacity``.

    Lengths must lie between 1 and ``capacity``; other rows, null lengths among them, fail. ``items`` should be cut from its lineage, as it is read
    more than once. ``order`` names columns that make the places repeatable. Items of one length are ranked in parts of about
    ``ranked`` rows, as many as their number asks for. Columns of ``items`` named sequence_id or offset are replaced, others may have any name;
    repeated rows are items of their own; an empty table gives an empty result.
    """
    spark = items.sparkSession
    n = F.col(f"`{length_col}`").cast("long")
    checked = F.when(n.between(1, capacity), n).otherwise(F.raise_error(F.lit(f"{length_col} is not between 1 and {capacity}")).cast("long"))
    item, by = F.struct(*(F.col(f"`{c}`") for c in items.columns)), F.struct(*(F.col(f"`{c}`") for c in order or [length_col]))
    marked = items.select(checked.alias("size"), by.alias("by"), item.alias("item"))
    counts = {r[0]: r[1] for r in marked.groupBy("size").count().collect()}  # a row a length, capacity at most
    parts = F.array(*(F.lit(-(-counts.get(size, 0) // ranked) or 1) for size in range(1, capacity + 1)))
    marked = marked.withColumn("part", F.pmod(F.xxhash64("by"), F.element_at(parts, F.col("size").cast("int"))).cast("int"))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = marked.groupBy("size", "part").count()
    cells = cut(cells.select("size", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")))
    places = spark.sparkContext.broadcast(Places(plan(counts, capacity)))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places.value(size.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    within = F.row_number().over(Window.partitionBy("size", "part").orderBy("by")) - 1
    placed = marked.withColumn("rank", within).join(cells, ["size", "part"]).select("item", place("size", F.col("rank") + F.col("base")).alias("place"))
    return placed.select(*(F.col(f"item.`{c}`") for c in items.columns if c not in ("sequence_id", "offset")), "place.sequence_id", "place.offset")


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids]): every text's ids and one end id, cut where they are longer than ``capacity``.

    All pieces but the first are full. Null and empty texts have the end id
    alone. ids_crc32 is of the ids as little-endian unsigned 32-bit integers.
    """
    path = path or bytebpe.default_path()
    kind = "array<struct<piece:int,start:long,length:long,ids_crc32:long" + (",ids:array<int>>>" if with_ids else ">>")

    @F.pandas_udf(kind)
    def of(texts: pd.Series) -> pd.Series:
        bpe, end = bytebpe.load(path), np.array([end_id], "<u4").tobytes()
        out = []
        for text in texts:
            data = bpe.encode(text or "") + end
            total = len(data) // 4
            first = total % capacity or capacity
            starts = [0, *range(first, total, capacity)]
            pieces = []
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], total], strict=True)):
                part = data[4 * a : 4 * b]
                pieces.append({"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(part)})
                if with_ids:
                    pieces[-1]["ids"] = np.frombuffer(part, "<u4").astype(np.int32)
            out.append(pieces)
        return pd.Series(out)

    return docs.select(F.col(id_col), F.explode(of(F.col(text_col))).alias("p")).select(id_col, "p.*")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of every row of ``docs`` with sequence_id and offset, in as few sequences as the method finds.

    Null texts count as empty. Repeated rows and null ids are packed as any
    other. Other columns are ignored; an empty table gives an empty result.
    ``with_ids`` keeps the token ids of each piece.
    """
    pieces = cut(token_pieces(docs, id_col, text_col, capacity, end_id, path, with_ids))
    return pack(pieces, "length", capacity, [id_col, "piece", "length", "ids_crc32"])
