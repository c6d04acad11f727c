"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint is the bitwise majority of the 64-bit hashes of its
word shingles. Two fingerprints link at ``radius`` or fewer differing bits.
Links come from multi-index hashing: the fingerprint is cut into segments, one
table is kept per segment, a small Hamming ball around each segment's value is
enumerated and looked up, and the whole distance is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import connected_components

#: Shingle hashes unpacked to bits at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint as an unsigned integer; zero where there are no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(joined, seed)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        stops = ends[width - 1 :].tolist()
        hashes = [digest(joined[i:j], seed) for i, j in zip(starts[: len(stops)].tolist(), stops, strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.array(hashes[at : at + CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): fp is the fingerprint's bits as a signed long, zero for null and wordless texts."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(t, width, seed) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("fp"))


def _segments(bits: int, radius: int, count: int) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) of each segment.

    If every segment differed by more than its radius, the distance would be
    above ``radius``: the first radius % count + 1 segments take radius // count,
    the others one less (those below zero are not needed).
    """
    each, rest = divmod(radius, count)
    cuts = [bits * k // count for k in range(count + 1)]
    plan = [(cuts[k], cuts[k + 1] - cuts[k], each if k <= rest else each - 1) for k in range(count)]
    return [x for x in plan if x[2] >= 0]


def _probes(plan: list[tuple[int, int, int]]) -> str:
    """SQL that makes a row (seg, mask, high) for each mask of each segment's ball, moved to its place in the word."""
    rows = []
    for seg, (shift, width, radius) in enumerate(plan):
        for n in range(radius + 1):
            for places in combinations(range(width), n):
                mask = sum(1 << (p + shift) for p in places)
                high = 1 << (max(places) + shift) if places else 0
                rows.append(f"named_struct('seg', {seg}, 'mask', {_signed(mask)}, 'high', {_signed(high)})")
    return f"inline(array({', '.join(rows)}))"


def _signed(x: int) -> str:
    x = x - (1 << 64) if x >= 1 << 63 else x
    return "(-9223372036854775807L - 1L)" if x == -(1 << 63) else f"{x}L"


def hamming_links(points: DataFrame, fp: str = "fp", radius: int = 2, segments: int = 2, bucket_limit: int = 64, carry: str | None = None) -> DataFrame:
    """Links (a, b) between distinct 64-bit values of column ``fp`` whose components are those of all pairs at ``radius`` or fewer bits.

    Each link is such a pair. ``carry`` names a column of ``points`` that comes along as a_carry and b_carry.
    Of a pair that differs inside a segment, only the side that has the mask's
    highest bit set looks it up, which halves the probes. For radius 2, table
    buckets of more than ``bucket_limit`` values are handled apart and exactly:
    whoever stands in such a bucket or looks it up enumerates the whole
    word's ball of radius 1, and those that share a point (65 values at most,
    each two bits apart at most) are linked as a star. For
    other radii every bucket is joined.
    """
    plan = _segments(64, radius, segments)
    values = points.select(F.struct(F.col(fp).alias("fp"), (F.col(carry) if carry else F.lit(None)).alias("carry")).alias("p")).where("p.fp is not null")
    part = "element_at(array(%s), seg + 1)" % ", ".join(_signed(((1 << w) - 1) << s) for s, w, _ in plan)
    table = values.select("p", F.expr(f"explode(array({', '.join(map(str, range(len(plan))))})) as seg"))
    table = table.select("seg", F.expr(f"p.fp & {part}").alias("key"), F.col("p").alias("b"))
    probes = values.select("p", F.expr(_probes(plan))).where("mask = 0 or p.fp & high != 0")
    probes = probes.select("seg", F.expr(f"(p.fp ^ mask) & {part}").alias("key"), F.col("p").alias("a"), (F.col("mask") == 0).alias("same"))
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius
    heavy = None
    if radius == 2:
        heavy = cut(table.groupBy("seg", "key").count().where(F.col("count") > bucket_limit).select("seg", "key"))
        if heavy.isEmpty():
            heavy = None
    light = probes if heavy is None else probes.join(heavy, ["seg", "key"], "left_anti")
    links = light.join(table, ["seg", "key"]).where("not same or a.fp < b.fp").where(close).select("a", "b")
    if heavy is not None:
        crowd = probes.join(heavy, ["seg", "key"], "left_semi").select(F.col("a").alias("p")).distinct()
        ball = ", ".join(["0L", *(_signed(1 << k) for k in range(64))])
        shared = crowd.select("p", F.expr(f"explode(array({ball})) as mask")).groupBy(F.expr("p.fp ^ mask").alias("point"))
        stars = shared.agg(F.min("p").alias("a"), F.collect_list("p").alias("all")).where(F.size("all") > 1)
        links = links.union(stars.select("a", F.explode("all").alias("b")).where("a.fp != b.fp").where(close))
    return links.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"), *([F.col("a.carry").alias("a_carry"), F.col("b.carry").alias("b_carry")] if carry else []))


def _name(low: Column, node: Column) -> Column:
    """A node's name in a graph: names are in the order of the smallest id, so that a component's least name holds its id; null ids come last."""
    return F.struct(low.isNull().alias("none"), low.alias("low"), node.alias("node"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, seed: int = 42
) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``.

    fingerprint: 16 lower-case hex digits. component_id: the smallest id
    reachable over links, the row's own included. Null, empty and wordless texts
    have fingerprint zero and link as any other; a text of any length is read whole. Equal fingerprints meet once,
    as one node, however many rows have them. Repeated rows each get a
    row. Null ids get the component of their fingerprint, but never name one
    (a component of null ids alone is null). Other columns, whatever their names, are ignored; an
    empty table gives an empty result.
    """
    marked = cut(fingerprints(docs, id_col, text_col, width, seed))
    nodes = cut(marked.groupBy("fp").agg(F.min("id").alias("low")))
    links = hamming_links(nodes, "fp", radius, carry="low")
    roots = connected_components(links.select(_name(F.col("a_carry"), F.col("a")).alias("a"), _name(F.col("b_carry"), F.col("b")).alias("b")))
    roots = roots.select(F.col("node.node").alias("fp"), F.col("root.low").alias("root"), F.lit(True).alias("linked"))
    named = nodes.join(roots, "fp", "left").select("fp", F.when(F.col("linked"), F.col("root")).otherwise(F.col("low")).alias("component_id"))
    return marked.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Odd numbers that make a wide fingerprint's lanes out of one hash of a shingle.
LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def wide_fingerprint(words: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """Four independent 64-bit fingerprints of the distinct shingles of ``width`` words; zeros where there are no words.

    Each shingle counts once, so that the number of differing bits of the four follows the similarity of the two sets.
    """
    if not words:
        return np.zeros(4, np.int64)
    shingles = {b" ".join(words)} if len(words) < width else set(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, seed) for x in shingles), np.uint64, len(shingles))
    out = np.zeros(4, np.uint64)
    for k, odd in enumerate(LANES):
        mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(odd)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(LANES[k - 1])
        mixed ^= mixed >> np.uint64(32)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(mixed), CHUNK):
            ones += np.unpackbits(mixed[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > len(mixed), bitorder="little").view("<u8")[0]
    return out.view(np.int64)


#: Bits of a segment of the wide fingerprint, and the words of one signature as columns.
SEGMENT = 32
WIDE = tuple(f"w{k}" for k in range(4))
LONG = tuple(f"s{k}" for k in range(4))


#: Members of one part of a bucket; larger buckets are compared part by part.
PART = 2048
CUTS = ", ".join(f"{(2 * k + h) << SEGMENT}L | (shiftrightunsigned({w}, {SEGMENT * h}) & 4294967295L)" for k, w in enumerate(WIDE) for h in range(2))
#: Masks move a bit that is set; the pair's other side stands at the place moved to.
MASKS = ", ".join(f"{1 << b}L" for b in range(SEGMENT))


def _compared(rows: DataFrame, nodes: DataFrame, radius: int, part: int) -> DataFrame:
    """Links (a, b) between members of a bucket: rows are (key, own, node, root), and those that stand in the bucket themselves (own) meet all others in it.

    Every such pair is compared, unless both are in one component already (``root``): a link is only handed on where it joins
    two. A bucket of more than ``part`` members is dealt out, and each two parts meet in a task of their own. ``nodes`` has (node, name, s0..s3), which
    only members of buckets that may join something are given.
    """
    count = lambda own: F.count_if(F.col("own") == own)
    open_ = rows.groupBy("key").agg(count(True).alias("t"), count(False).alias("p"), F.min("root").alias("low"), F.max("root").alias("high"))
    open_ = open_.where("t > 0 and low < high").select("key", F.ceil(F.col("t") / part).cast("int").alias("t"), F.ceil(F.col("p") / part).cast("int").alias("p"))
    at = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    whole, t, p = F.col("t") + F.col("p"), F.col("t"), F.col("p")
    every = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    own = F.transform(every(whole), lambda j: F.least(at(t), j) * whole + F.greatest(at(t), j))
    others = F.transform(every(t), lambda i: i * whole + t + at(p))
    job = F.when((t == 1) & (p <= 1), F.array(F.lit(0))).when(F.col("own"), own).otherwise(others)
    dealt = rows.join(open_, "key").join(nodes, "node").select("key", F.explode(job).alias("job"), F.struct("name", "root", "own", *LONG).alias("member"))
    jobs = dealt.groupBy("key", "job").agg(F.collect_list("member").alias("members")).where(F.size("members") > 1)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0).flatten()
            ends = np.cumsum(batch.column(0).value_lengths().to_numpy())
            name, roots = members.field(0), members.field(1).to_numpy()
            owns = members.field(2).to_numpy(zero_copy_only=False)
            prints = np.stack([members.field(3 + k).to_numpy() for k in range(len(LONG))], axis=1).view(np.uint64)
            left, right = [], []
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                root, print_ = roots[lo:hi].copy(), prints[lo:hi]
                for i in np.flatnonzero(owns[lo:hi]).tolist():
                    near = np.bitwise_count(print_ ^ print_[i]).sum(1) <= radius
                    near &= root != root[i]
                    while near.any():
                        j = int(near.argmax())
                        left.append(lo + i)
                        right.append(lo + j)
                        root[root == root[j]] = root[i]
                        near &= root != root[i]
            yield pa.RecordBatch.from_arrays([name.take(pa.array(left, pa.int64())), name.take(pa.array(right, pa.int64()))], ["a", "b"])

    kind = nodes.schema["name"].dataType.simpleString()
    return jobs.select("members").mapInArrow(links, f"a {kind}, b {kind}")


def wide_links(nodes: DataFrame, base: DataFrame | None = None, radius: int = 48, part: int = PART) -> DataFrame:
    """Links (a, b) between the names of nodes (name, node, w0..w3, s0..s3), whose components, with the links of ``base``, are those of the whole rule.

    The rule is about a pair alone: the w words, cut into eight segments of 32 bits, agree in one of them up to one bit, and
    the s words differ at ``radius`` or fewer of 256 bits. Two values at 15 bits or fewer of the w words always agree so in a segment.
    Multi-index hashing: first all that stand at the same place of a segment meet; then the ball of radius 1 around each
    segment is looked up, for what doesn't belong together yet. No bucket is cut short, and none needs one task.
    """
    prints = nodes.select("node", "name", *LONG)
    stands = nodes.select(F.expr(f"explode(array({CUTS})) as key"), F.lit(True).alias("own"), "node", F.col("node").alias("root"))
    found = cut(_compared(stands, prints, radius, part))
    links = found if base is None else base.union(found)
    roots = connected_components(links).select(F.col("node.node").alias("node"), F.col("root.node").alias("root"))
    placed = cut(nodes.join(roots, "node", "left").select(F.expr(f"array({CUTS}) as keys"), "node", F.coalesce("root", "node").alias("root")))
    stands = placed.select(F.explode("keys").alias("key"), F.lit(True).alias("own"), "node", "root")
    looks = placed.select(F.explode("keys").alias("at"), "node", "root").select("*", F.expr(f"explode(array({MASKS})) as mask")).where("at & mask != 0")
    # only where something stands that doesn't belong to who looks
    there = stands.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    met = looks.select(F.expr("at ^ mask").alias("key"), "node", "root").join(there, "key").where("low != root or high != root")
    met = cut(met.select("key", F.lit(False).alias("own"), "node", "root"))
    beside = stands.join(met.select("key").distinct(), "key", "left_semi")
    return found.union(cut(_compared(met.union(beside), prints, radius, part)))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 48, keep: list[str] | None = None, part: int = PART) -> DataFrame:
    """(id_col, kept columns, component_id, stays) for every row of ``docs``, where texts link as in ``near_duplicates``, or at ``radius`` of the
    256 bits of a fingerprint of their distinct five-word shingles if that of their distinct words agrees in a segment (see ``wide_links``); 48 bits
    hold nearly all texts of a similarity of 0.8 or more. Components are exactly those of this rule, however many texts stand together.

    stays: the row is the one of its component that a corpus keeps: it has the component's id, and of texts that share that id the
    one that gives the component its name. Rows that repeat an id and a text alike have it alike. Null, empty
    and wordless texts are alike. Null ids never name a component that has another id; of a component of null ids, rows of one text stay. Other
    columns, whatever their names, are ignored but for ``keep``; an empty table gives an empty result.
    """
    keep = keep or []

    @F.pandas_udf("struct<" + ",".join(f"{c}:long" for c in ("fp", *WIDE, *LONG)) + ">")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = np.empty((len(texts), 9), np.int64)
        for k, text in enumerate(texts):
            words = _words(text)
            out[k, 0] = np.uint64(fingerprint(text)).astype(np.int64)
            out[k, 1:5], out[k, 5:] = wide_fingerprint(words, 1), wide_fingerprint(words, 5)
        return pd.DataFrame(out, columns=["fp", *WIDE, *LONG])

    prints = ["fp", *WIDE, *LONG]
    marked = docs.select(F.col(id_col).alias("id"), F.struct(*keep).alias("kept") if keep else F.lit(None).alias("kept"), of(F.col(text_col)).alias("p"))
    marked = cut(marked.select("id", "kept", "p.*"))
    # numbers are given after the checkpoint, whose partitions stay as they are
    nodes = cut(marked.groupBy(*prints).agg(F.min("id").alias("low"))).withColumn("node", F.monotonically_increasing_id())
    name = _name(F.col("low"), F.col("node"))
    narrow = nodes.groupBy("fp").agg(F.min(name).alias("head"))
    base = nodes.join(narrow, "fp").select(name.alias("a"), F.col("head").alias("b")).where("a != b")
    base = cut(base.union(hamming_links(narrow, "fp", carry="head").select("a_carry", "b_carry")))
    links = base.union(wide_links(nodes.select(name.alias("name"), "node", *WIDE, *LONG), base, radius, part))
    roots = connected_components(links).select(F.col("node.node").alias("node"), "root")
    named = nodes.join(roots, "node", "left").select(*prints, F.coalesce("root", name).alias("root"), "node")
    named = named.select(*prints, F.col("root.low").alias("component_id"), (F.col("root.node") == F.col("node")).alias("first"))
    found = marked.join(named, prints)
    return found.select(F.col("id").alias(id_col), *(F.col(f"kept.{c}").alias(c) for c in keep), "component_id", (F.col("first") & F.col("id").eqNullSafe(F.col("component_id"))).alias("stays"))
