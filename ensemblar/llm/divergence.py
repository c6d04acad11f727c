"""Source divergence audit: how far each source's words lie from those of its language and of its other sources.

The vocabulary of a language is a minimal acyclic transducer, built from its sorted kept terms: a term's path adds up
to its lexicographic ordinal. Texts are counted twice. The first pass finds the terms that enough documents hold;
the second streams all texts through the transducers and counts ordinals, which are small and whose
order is that of the terms, so that ties need no text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: What stands in a term: a-z and all bytes from 0x80 on; A-Z are lowered and every other byte parts terms.
FOLD = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Terms that every task holds at most, and bytes of the longest of them; the rest meet their counts by a join.
HELD, LONGEST = 1 << 20, 64
#: Terms of one transducer, entries that a task gathers before it hands them on, words whose ordinals it remembers, terms that are compared at once, and cells of a matrix.
SHARD, GATHERED, REMEMBERED, BLOCK, CELLS = 1 << 16, 1 << 18, 1 << 19, 1 << 12, 1 << 21
SCALE_STEPS = (1000, 1000, 1000)  # 10^9 by long division, so that products stay within 64 bits


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in order, with repeats."""
    return (text or b"").translate(FOLD).split()


class Transducer:
    """A minimal acyclic transducer from sorted terms to 0, 1, 2, ...

    Arcs are sorted by (state, byte). An arc's output is the number of terms that end or branch off before it.
    """

    def __init__(self, arcs: np.ndarray, targets: np.ndarray, outputs: np.ndarray, final: np.ndarray) -> None:
        self.arcs, self.targets, self.outputs, self.final = arcs, targets, outputs, final

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """Of strictly ascending terms; states that hold the same endings are one."""
        register: dict[tuple, int] = {}
        path: list[list] = [[False, []]]
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                ends, arcs = path.pop()
                state = register.setdefault((ends, tuple(arcs)), len(register))
                path[-1][1].append((last[len(path) - 1], state))

        for term in terms:
            if term <= last and (last or path[0][0]):
                raise ValueError("terms must ascend")
            common, most = 0, min(len(term), len(last))
            while common < most and term[common] == last[common]:
                common += 1
            close(common)
            path += [[False, []] for _ in term[common:]]
            path[-1][0] = True
            last = term
        close(0)
        register.setdefault((path[0][0], tuple(path[0][1])), len(register))
        # a state comes after those that its arcs lead to; the root is last
        below, rows = [], []
        for state, (ends, arcs) in enumerate(register):
            total = int(ends)
            for byte, target in arcs:
                rows.append((state << 8 | byte, target, total))
                total += below[target]
            below.append(total)
        table = np.array(rows, np.int64).reshape(-1, 3)
        return cls(table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32), np.array([s[0] for s in register], np.bool_))

    def __len__(self) -> int:
        return len(self.final)

    def ordinals(self, words: list[bytes]) -> np.ndarray:
        """The ordinal of each word, -1 where it isn't a term; all words step side by side, a byte at a time."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        state, found = np.full(len(words), len(self.final) - 1, np.int64), np.zeros(len(words), np.int64)
        alive = np.arange(len(words)) if len(self.arcs) else np.flatnonzero(lengths == 0)
        found[np.setdiff1d(np.arange(len(words)), alive, assume_unique=True)] = -1
        going = alive[lengths[alive] > 0]
        step = 0
        while len(going):
            key = state[going] << 8 | data[starts[going] + step]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            fits = self.arcs[at] == key
            found[going[~fits]] = -1
            going, at = going[fits], at[fits]
            state[going] = self.targets[at]
            found[going] += self.outputs[at]
            step += 1
            going = going[lengths[going] > step]
        found[(found >= 0) & ~self.final[state]] = -1
        return found

    def to_bytes(self) -> list[bytes]:
        return [x.tobytes() for x in (self.arcs, self.targets, self.outputs, self.final)]

    @classmethod
    def from_bytes(cls, parts: list[bytes]) -> Transducer:
        return cls(*(np.frombuffer(p, t) for p, t in zip(parts, (np.int64, np.int32, np.int32, np.bool_), strict=True)))


def _texts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))


def document_counts(texts: DataFrame) -> DataFrame:
    """(lang, term, df): how many rows of the language hold the term."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                counts = held[lang]
                size -= len(counts)
                counts.update(set(terms_of(text.as_py())))
                size += len(counts)
                if size >= GATHERED:
                    yield from flush(held)
                    held.clear()
                    size = 0
        yield from flush(held)

    def flush(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            if counts:
                names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(counts), np.int8)), pa.array([lang])).dictionary_decode()
                yield pa.RecordBatch.from_arrays([names, pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["lang", "term", "df"])

    return texts.select("lang", "text").mapInArrow(gather, "lang string, term binary, df long").groupBy("lang", "term").agg(F.sum("df").alias("df"))


def vocabulary(texts: DataFrame, least: int = 3) -> DataFrame:
    """(lang, term, df, ordinal) of the terms in ``least`` documents of their language or more; ordinals count from 0 in the order of the bytes.

    Terms are sorted by range, numbered within each partition and moved by what stands in the partitions before: one number a partition and language reaches the driver.
    """
    kept = cut(document_counts(texts).where(F.col("df") >= least).orderBy("lang", "term"))
    parts = sorted((r.lang, r.part, r["count"]) for r in kept.groupBy(F.spark_partition_id().alias("part"), "lang").count().collect())
    base: dict[tuple[int, str], int] = {}
    total: Counter = Counter()
    for lang, part, n in parts:
        base[part, lang] = total[lang]
        total[lang] += n

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            out = []
            for part, lang in zip(batch.column("part").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                out.append(base[part, lang] + seen[lang])
                seen[lang] += 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int64())], ["lang", "term", "df", "ordinal"])

    return kept.select("lang", "term", "df", F.spark_partition_id().alias("part")).mapInArrow(number, "lang string, term binary, df long, ordinal long")


def transducers(terms: DataFrame) -> DataFrame:
    """(lang, first, ordinals, parts): transducers of ``SHARD`` terms at most over (lang, term, ordinal), which lie in order within each partition."""
    schema = pa.schema([("lang", pa.string()), ("first", pa.binary()), ("ordinals", pa.binary()), ("parts", pa.list_(pa.binary()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, held, ordinals = None, [], []

        def made() -> pa.RecordBatch:
            row = {"lang": lang, "first": held[0], "ordinals": np.array(ordinals, np.int64).tobytes(), "parts": Transducer.build(held).to_bytes()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for name, term, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (name != lang or len(held) >= SHARD):
                    yield made()
                    held, ordinals = [], []
                lang = name
                held.append(term)
                ordinals.append(n)
        if held:
            yield made()

    return terms.select("lang", "term", "ordinal").mapInArrow(build, "lang string, first binary, ordinals binary, parts array<binary>")


class Vocabulary:
    """The transducers of a language, by their first terms."""

    def __init__(self, shards: list[tuple[bytes, bytes, list[bytes]]]) -> None:
        shards = sorted(shards, key=lambda s: s[0])
        self.first = [s[0] for s in shards]
        self.shards = [(np.frombuffer(s[1], np.int64), Transducer.from_bytes(s[2])) for s in shards]

    def ordinals(self, words: list[bytes]) -> np.ndarray:
        """The ordinal of each word, -1 where no transducer holds it."""
        out = np.full(len(words), -1, np.int64)
        if len(self.first) < 2:
            places = [np.arange(len(words))] * len(self.first)
        else:
            own = np.fromiter((bisect_right(self.first, w) - 1 for w in words), np.int64, len(words))
            places = [np.flatnonzero(own == k) for k in range(len(self.first))]
        for at, (ordinals, transducer) in zip(places, self.shards, strict=True):
            if len(at):
                found = transducer.ordinals([words[k] for k in at.tolist()] if len(at) < len(words) else words)
                out[at[found >= 0]] = ordinals[found[found >= 0]]
        return out


def recount(texts: DataFrame, vocab: DataFrame, least: int = 3, held: int = HELD) -> DataFrame:
    """(lang, source, ordinal, count) of the vocabulary's terms in all texts, and a row of ordinal -1 and count 0 for each group.

    Every task holds the transducers of the ``held`` terms of the highest document counts and streams its texts through
    them; a batch's equal words go through together. The words that no transducer knows go on only where rarer or
    longer terms are kept, and meet those by a join.
    """
    short = F.octet_length("term") <= LONGEST
    level = F.floor(F.log2(F.col("df"))).cast("int")
    sizes = dict(vocab.where(short).groupBy(level.alias("level")).count().collect())  # 64 rows at most
    lowest, room = 64, held
    while lowest > 0 and room >= sizes.get(lowest - 1, 0):
        lowest -= 1
        room -= sizes.get(lowest, 0)
    inside = short & (F.col("df") >= 2.0**lowest)
    rest = cut(vocab.where(~inside))
    longer, rarer = not rest.where(~short).isEmpty(), not rest.where(short).isEmpty()
    shards = defaultdict(list)
    for r in transducers(vocab.where(inside)).collect():  # bounded by ``held`` terms of LONGEST bytes
        shards[r.lang].append((bytes(r.first), bytes(r.ordinals), [bytes(p) for p in r.parts]))
    sent = texts.sparkSession.sparkContext.broadcast(dict(shards))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies: dict[str, Vocabulary] = {}
        known: dict[str, dict[bytes, int]] = defaultdict(dict)
        gathered: dict[tuple[str, str], Counter] = defaultdict(Counter)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if sum(map(len, known.values())) > REMEMBERED:
                known.clear()
            for lang in {lang for lang, _ in gathered}:
                if lang not in vocabularies:
                    vocabularies[lang] = Vocabulary(sent.value.get(lang, []))
                # sources share most words, which go through the transducers once
                new = list({w for (x, _), counts in gathered.items() if x == lang for w in counts if w not in known[lang]})
                known[lang].update(zip(new, vocabularies[lang].ordinals(new).tolist(), strict=True))
            for (lang, source), counts in gathered.items():
                words, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
                found = np.fromiter(map(known[lang].__getitem__, words), np.int64, len(words))
                at = found >= 0
                unknown = [k for k in np.flatnonzero(~at).tolist() if (longer if len(words[k]) > LONGEST else rarer)] if longer or rarer else []
                ordinals = np.concatenate([[-1], found[at], np.full(len(unknown), -1)]).astype(np.int64)
                count = np.concatenate([[0], n[at], n[unknown]]).astype(np.int64)
                terms = pa.concat_arrays([pa.nulls(len(ordinals) - len(unknown), pa.binary()), pa.array([words[k] for k in unknown], pa.binary())])
                same = pa.array(np.zeros(len(ordinals), np.int8))
                names = [pa.DictionaryArray.from_arrays(same, pa.array([x])).dictionary_decode() for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(ordinals), terms, pa.array(count)], ["lang", "source", "ordinal", "term", "count"])
            gathered.clear()

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.binary()), strict=True):
                counts = gathered[lang, source]
                size -= len(counts)
                counts.update(terms_of(text.as_py()))
                size += len(counts)
                if size >= GATHERED:
                    yield from flush()
                    size = 0
        yield from flush()

    streamed = texts.mapInArrow(stream, "lang string, source string, ordinal long, term binary, count long")
    if longer or rarer:
        streamed = cut(streamed)
    total = lambda df, *by: df.groupBy("lang", "source", *by).agg(F.sum("count").alias("count"))
    known = total(streamed.where("term is null"), "ordinal")
    if not (longer or rarer):
        return known
    unknown = total(streamed.where("term is not null"), "term").join(rest, ["lang", "term"])
    return known.union(unknown.select("lang", "source", "ordinal", "count"))


def _share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / whole) exactly, for whole below 9 * 10^15."""
    out, rest = np.zeros_like(count), count + 1
    for step in SCALE_STEPS:
        part, rest = np.divmod(rest * step, whole)
        out = out * step + part
    return out + 1


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = 3, top: int = 200, held: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of ``docs``.

    Part ``pair``: the distance to each other source of the language, summed over all kept terms (0 without any). Part ``term``: the ``top`` kept
    terms that the source has and holds a larger share of than its language. Shares are smoothed by one occurrence a
    term and are whole numbers in 10^-9; the distance is floor((p-q)^2/q). Ranks go by value, then by item in the order of its bytes.

    Null lang, source and text are empty; empty texts make their group occur. Repeated rows are documents of their own, texts of any
    length are read whole, other columns, whatever their names, are ignored, and an empty table gives an empty result.
    """
    texts = _texts(docs, lang, source, text)
    vocab = cut(vocabulary(texts, least))
    cells = cut(recount(texts, vocab, least, held))
    groups = cells.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    kept = vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    # a language's sources stand beside each of its blocks of terms
    of_lang = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups"), F.sum("n").alias("total")).join(kept, "lang")
    blocks = of_lang.select(F.col("lang").alias("of"), "groups", "total", "kept", F.explode(F.sequence(F.lit(0), F.floor((F.col("kept") - 1) / BLOCK))).alias("at"))
    out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("ordinal", pa.int64()), ("value", pa.int64())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        head = right.to_pylist()[0]
        names, kept_, base = [g["source"] for g in head["groups"]], head["kept"], head["at"] * BLOCK
        at = {name: k for k, name in enumerate(names)}
        width = min(BLOCK, kept_ - base)
        row = np.fromiter((at[s] for s in left["source"].to_pylist()), np.int64, left.num_rows)
        column, count = left["ordinal"].to_numpy() - base, left["count"].to_numpy()
        whole = np.array([[g["n"] + kept_] for g in head["groups"]], np.int64)
        pairs = np.zeros((len(names), len(names)), np.int64)
        best: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in names]
        step = max(1, CELLS // len(names))
        for lo in range(0, width, step):
            hi = min(width, lo + step)
            here = (column >= lo) & (column < hi)
            counts = np.zeros((len(names), hi - lo), np.int64)
            counts[row[here], column[here] - lo] = count[here]
            p, q = _share(counts, whole), _share(counts.sum(0), np.int64(head["total"] + kept_))
            for k in range(len(names)):
                pairs[k] += _distance(p[k], p).sum(1)
                mine = np.flatnonzero((counts[k] > 0) & (p[k] > q))
                best[k].append((_distance(p[k][mine], q[mine]), mine + lo + base))
        sources, items, ordinals, values = [], [], [], []
        for k, name in enumerate(names):
            value, ordinal = (np.concatenate(x) for x in zip(*best[k], strict=True))
            first = np.lexsort((ordinal, -value))[:top]
            sources += [name] * (len(names) - 1 + len(first))
            items += names[:k] + names[k + 1 :] + [None] * len(first)
            ordinals += [None] * (len(names) - 1) + ordinal[first].tolist()
            values += np.delete(pairs[k], k).tolist() + value[first].tolist()
        return pa.Table.from_arrays([pa.array([head["of"]] * len(sources), pa.string()), pa.array(sources, pa.string()), pa.array(items, pa.string()), pa.array(ordinals, pa.int64()), pa.array(values, pa.int64())], schema=out)

    counted = cells.where("ordinal >= 0").select("lang", F.floor(F.col("ordinal") / BLOCK).alias("block"), "source", "ordinal", "count")
    found = counted.groupBy("lang", "block").cogroup(blocks.groupBy("of", "at")).applyInArrow(compare, "lang string, source string, item string, ordinal long, value long")
    found = cut(found)
    # pairs of a language without kept terms are zero
    none = groups.alias("a").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source != item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = found.where("item is not null").select("lang", "source", "item", "value").union(none).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by = Window.partitionBy("lang", "source")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by.orderBy(F.desc("value"), "item")).alias("rank"))
    terms = found.where("ordinal is not null").withColumn("rank", F.row_number().over(by.orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= top)
    terms = terms.drop("item").join(vocab.select("lang", "ordinal", F.decode("term", "UTF-8").alias("item")), ["lang", "ordinal"])
    return pairs.union(terms.select("lang", "source", F.lit("term"), "item", "value", "rank"))
