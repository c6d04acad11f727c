"""Language-model scores of whole documents: smoothed unigrams, and a gated recurrent model.

Words are counted over all training documents in Spark. The most frequent ones
are held in a table of bounded size that every task has. The counts of the rest are
joined to the documents by word; those words are rare, so that the join has no hot key.
The recurrent model predicts its words one by one and all others as one class, whose
words share by smoothed counts, so that its probabilities sum to one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_bucket
from .gru import Gru, classes

#: The end of a text as a word; no word is empty.
END = b""
#: Words counted at once in a task, tokens scored at once, tokens learnt from at once.
HELD, CHUNK, LEARNT = 300_000, 4_000_000, 1 << 20
#: Texts that a task learns from side by side, and models averaged at once.
STREAMS, FAN_IN = 1024, 32
#: Bytes of the words of over 64 bytes that every task holds at most.
LONG_BYTES = 8 << 20


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) stretches without ASCII white space, then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, c long) over all rows."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        ends = 0

        def out() -> Iterator[pa.RecordBatch]:
            own = pa.table({"word": pa.array([END] if ends else [], pa.binary()), "c": pa.array([ends] if ends else [], pa.int64())})
            table = pa.concat_tables([*held, own])
            if len(held) > 1:
                table = table.group_by("word").aggregate([("c", "sum")]).rename_columns({"c_sum": "c"})
            yield from table.select(["word", "c"]).to_batches()

        for batch in batches:
            found, sizes = split_words(batch.column(0))
            counts = found.value_counts()
            held.append(pa.table({"word": counts.field(0).cast(pa.binary()), "c": counts.field(1)}))
            ends += len(sizes)
            if sum(map(len, held)) > HELD:
                yield from out()
                held, ends = [], 0
        yield from out()

    counted = docs.select(text_col).mapInArrow(count, "word binary, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one text after another and without ends, and the number of each text's."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found, sizes = pc.list_flatten(parts), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    there = pc.binary_length(found).to_numpy(zero_copy_only=False) > 0
    if there.all():
        return found, sizes
    before = np.concatenate([[0], np.cumsum(there)])
    ends = np.cumsum(sizes)
    return found.filter(pa.array(there)), before[ends] - before[ends - sizes]


class Vocabulary:
    """The end and the most frequent words, falling by count; the first ``n_model`` are the recurrent model's."""

    def __init__(self, names: list[bytes], counts: list[int], n_model: int, n_extra: int, total: int, distinct: int) -> None:
        self.names, self.has_end = pa.array(names, pa.binary()).cast(pa.string()), END in names[:1]
        self.counts = np.array(counts, np.float64)
        self.n_model, self.n_extra = min(n_model, len(names)), n_extra
        self.total, self.distinct = total, distinct
        own = np.arange(len(names))
        self.mark = np.where(own < self.n_model, own, self.extra(self.names))
        self.end_mark = self.mark[0] if self.has_end else self.extra(pa.array([""]))[0]
        self.log_count = np.log10(self.counts + 0.1)
        self.log_all = math.log10(total + 0.1 * (distinct + 1))
        # words outside the model, and the unseen one
        self.log_rest = math.log10(max(0.0, total - self.counts[: self.n_model].sum()) + 0.1 * (distinct - self.n_model + 1))

    def extra(self, words: pa.Array) -> np.ndarray:
        """The input marks of words outside the model, by their endings."""
        if not len(words):
            return np.zeros(0, np.int64)
        words = words.cast(pa.large_string())
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        edge = np.zeros(1, np.uint8)
        data = np.concatenate([edge, np.frombuffer(words.buffers()[2] or b"", np.uint8), edge])
        last, size = ends[1:], np.diff(ends)
        ending = np.where(size > 0, data[last], 0).astype(np.int64) * 256 + np.where(size > 1, data[np.maximum(last - 1, 0)], 0)
        return self.n_model + ending * 40503 % 65536 * self.n_extra // 65536

    def marks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The mark of each token, as ``tokens`` gives it, and the number of each text's; only the model's words are looked up."""
        words, sizes = split_words(texts)
        mark = pc.fill_null(pc.index_in(words, self.names.slice(0, self.n_model)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        other = mark < 0
        mark[other] = self.extra(words.filter(pa.array(other)))
        return np.insert(mark, np.cumsum(sizes), self.end_mark), sizes + 1

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Of all texts, each with its end: the place of each token or -1, its mark, the number of each text's; the words without a place and their numbers."""
        words, sizes = split_words(texts)
        coded = words.dictionary_encode()
        turn = coded.indices.to_numpy(zero_copy_only=False)
        place = pc.fill_null(pc.index_in(coded.dictionary, self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        mark = np.where(place < 0, self.extra(coded.dictionary), self.mark[place] if len(self.mark) else 0)
        ends = np.cumsum(sizes)
        places = np.insert(place[turn], ends, 0 if self.has_end else -1)
        strange = place[turn] < 0
        before = np.concatenate([[0], np.cumsum(strange)])
        return places, np.insert(mark[turn], ends, self.end_mark), sizes + 1, words.filter(pa.array(strange)), before[ends] - before[ends - sizes]


def _inputs(marks: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The input before each token of texts one after another, and where texts begin."""
    first = np.zeros(len(marks), bool)
    first[np.cumsum(sizes) - sizes] = True
    out = np.roll(marks, 1)
    out[first] = start
    return out, first


def train(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", id_col: str = "doc_id", most_tokens: int | None = None, most_classes: int = 48, hidden: int = 24, rounds: int = 4) -> Gru:
    """Fits the recurrent model on every text of ``docs``.

    Each row belongs to one of ``rounds`` by a hash, so that each text is learnt from once. In a round every
    task goes on from the parameters of the last one over its rows of the round; the results, of fixed size, are
    averaged by numbers of tokens, FAN_IN of them at a time until one is left. ``most_tokens``, where given, ends a task's
    learning in a round. The model depends on how the rows are dealt out to tasks. ``trained`` of the model
    is the number of tokens that it learnt from.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    starts, n_extra = classes(vocabulary.counts[: vocabulary.n_model], most_classes), vocabulary.n_extra
    model = Gru(starts, n_extra, hidden)
    model.trained = 0
    names = sorted(model.params)
    shapes = [model.params[k].shape for k in names]
    sizes = np.cumsum([math.prod(x) for x in shapes])

    def flat(*parts: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([p[k].reshape(-1) for p in parts for k in names]).astype(np.float32)

    def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
        return {k: part.reshape(shape).copy() for k, shape, part in zip(names, shapes, np.split(x, sizes[:-1]), strict=True)}

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        weights = table["n"].to_pylist()
        total = np.zeros(2 * int(sizes[-1]))
        for n, p in zip(weights, table["p"], strict=True):
            total += n * np.frombuffer(p.as_buffer(), "<f4")
        held = (total / sum(weights)).astype("<f4").tobytes()
        return pa.table({"part": pa.array([table["part"][0].as_py() // FAN_IN], pa.int32()), "n": pa.array([sum(weights)], pa.int64()), "p": pa.array([held], pa.binary())})

    def learner(now: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, own = shared.value, Gru(starts, n_extra, hidden)
            own.params, seen = map(unflat, np.split(np.frombuffer(now.value, "<f4"), 2))
            ids, target, first, n, done = [], [], [], 0, 0

            def take() -> None:
                own.train(np.concatenate(ids), np.concatenate(target), np.concatenate(first), min(STREAMS, max(16, n // 1024)), seen=seen)

            for batch in batches:
                if most_tokens is not None and n + done >= most_tokens:
                    continue
                marks, sizes = known.marks(batch.column(0))
                inputs, starting = _inputs(marks, sizes, own.start_mark)
                ids.append(inputs)
                target.append(marks)
                first.append(starting)
                n += len(marks)
                if n >= LEARNT:
                    take()
                    ids, target, first, n, done = [], [], [], 0, done + n
            if ids:
                take()
            if n + done:
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n + done], pa.int64()), pa.array([flat(own.params, seen).tobytes()], pa.binary())], ["part", "n", "p"])

        return learn

    state = flat(model.params, model.no_slopes()).tobytes()
    kind = "part int, n long, p binary"
    tasks = docs.rdd.getNumPartitions()
    for k in range(rounds):
        now = spark.sparkContext.broadcast(state)
        rows = docs.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(rounds)) == k).select(text_col)
        parts, many = rows.mapInArrow(learner(now), kind), tasks
        while many > 1:
            parts, many = parts.withColumn("slot", F.floor(F.col("part") / FAN_IN)).groupBy("slot").applyInArrow(mean, kind), -(-many // FAN_IN)
        found = parts.collect()
        if found:
            state, model.trained = bytes(found[0]["p"]), model.trained + found[0]["n"]
    model.params = unflat(np.frombuffer(state, "<f4")[: sizes[-1]])
    return model


def frequent_words(counts: DataFrame, most_words: int, most_bytes: int = LONG_BYTES) -> tuple[list[bytes], list[int]]:
    """The most frequent of (word, c) and their counts: ``most_words`` words of 64 bytes at most, the end first, then by falling count, then by bytes; and behind
    them longer words, as many of the highest counts as have ``most_bytes`` bytes together.

    The least count that is kept comes from histograms of counts, and where only some of the words of that count are kept, the last of these from
    histograms of their beginnings: no task sorts more words than it hands on, and the driver gets what every task will hold.
    """
    size, level = F.octet_length("word"), F.floor(F.log2("c") * 8).cast("int")
    short = counts.where((size > 0) & (size <= 64))
    room = most_words - counts.where(size == 0).count()
    # whole levels, then whole counts of the level that doesn't fit, then whole beginnings of the words of the count that doesn't
    steps = [level, F.col("c"), *(F.substring("word", k, 2) for k in range(1, 64, 2))]
    taken, within = F.lit(False), F.lit(True)
    for k, step in enumerate(steps):
        sizes = [tuple(r) for r in short.where(within).groupBy(step.alias("step")).count().collect()]
        sizes.sort(reverse=k < 2)
        fits = 0
        while fits < len(sizes) and sizes[fits][1] <= room:
            room -= sizes[fits][1]
            fits += 1
        if fits:
            taken |= within & (step >= F.lit(sizes[fits - 1][0]) if k < 2 else step <= F.lit(sizes[fits - 1][0]))
        if room <= 0 or fits == len(sizes):
            break
        within &= step == F.lit(sizes[fits][0])
    long = counts.where(size > 64)
    least = 1 << 30
    for lev, total in sorted((tuple(r) for r in long.groupBy(level.alias("level")).agg(F.sum(size)).collect()), reverse=True):
        most_bytes -= total
        if most_bytes < 0:
            break
        least = lev
    kept = short.where(taken).union(counts.where(size == 0)).union(long.where(level >= least)).collect()
    found = sorted(((bytes(w), c) for w, c in kept), key=lambda x: (len(x[0]) > 64, len(x[0]) > 0, -x[1], x[0]))
    return [w for w, _ in found], [c for _, c in found]


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, table_words: int = 1 << 18, model_words: int = 2048, n_extra: int = 64, **options) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Rows whose crc32(id as text) mod ``folds`` is not 0 are the training
    documents; null ids count as the text 'null'. Null and empty texts are an end alone.
    Both scores are log10 probabilities of the whole text, its end included. Repeated
    rows each get a row and each count. With no training row every probability is
    that of an unseen word. ``table_words`` and ``model_words`` bound the table of frequent
    words and the recurrent model; no word's count is approximated.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    training = rows.where(id_bucket(F.col("id"), folds) != 0)
    counts = cut(count_words(training))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    vocabulary = Vocabulary(*frequent_words(counts, table_words), model_words, n_extra, total, distinct)
    model = train(training, vocabulary, "text", "id", **options)
    shared = spark.sparkContext.broadcast((vocabulary, model))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, net = shared.value
        held: list[tuple] = []
        n = 0

        def out() -> pa.RecordBatch:
            ids, outs, places, marks, sizes, rare, n_rare = zip(*held, strict=True)
            places, marks, sizes, n_rare = map(np.concatenate, (places, marks, sizes, n_rare))
            inputs, _ = _inputs(marks, sizes, net.start_mark)
            logs = net.score(inputs, marks, sizes) / math.log(10)
            begin = np.cumsum(sizes) - sizes
            there = places >= 0
            safe = np.where(there, places, 0)
            each = known.log_count[safe] if len(known.log_count) else np.zeros(len(places))
            base = np.add.reduceat(np.where(there, each, 0), begin)
            # words of the table outside the model; those outside the table are joined
            logs += np.add.reduceat(np.where(places >= known.n_model, each - known.log_rest, 0), begin)
            if not known.has_end:  # nothing was learnt
                base, logs = base - 1, logs - 1 - known.log_rest
            found = np.add.reduceat(there.astype(np.int64), begin)
            words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_rare)]), pa.int32()), pa.concat_arrays(rare))
            columns = [pa.concat_arrays(ids), pa.concat_arrays(outs), pa.array(sizes, pa.int64()), pa.array(found), pa.array(base, pa.float64()), pa.array(logs, pa.float64()), words]
            return pa.RecordBatch.from_arrays(columns, ["id", "held_out", "n_tokens", "found", "base", "logs", "rare"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, outs, texts = batch.columns
            places, marks, sizes, rare, n_rare = known.tokens(texts)
            held.append((ids, outs, places.astype(np.int32), marks.astype(np.int32), sizes, rare, n_rare))
            n += len(marks)
            if n >= CHUNK:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    kind = docs.schema[id_col].dataType.simpleString()
    passed = rows.select("id", (id_bucket(F.col("id"), folds) == 0).alias("held_out"), "text")
    passed = passed.mapInArrow(score, f"id {kind}, held_out boolean, n_tokens long, found long, base double, logs double, rare array<string>")
    # row numbers are given after the checkpoint, whose partitions stay as they are
    passed = cut(passed).withColumn("row", F.monotonically_increasing_id())
    rare = passed.select("row", F.explode("rare").alias("word"))
    joined = rare.join(counts.select(F.col("word").cast("string").alias("word"), "c"), "word", "left")
    sums = joined.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.count("c").alias("known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("log"))
    whole = passed.drop("rare").join(sums, "row", "left").na.fill(0, ["n", "known", "log"])
    return whole.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("found") + F.col("known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("log") - F.col("n_tokens") * vocabulary.log_all).alias("base_score"),
        (F.col("logs") + F.col("log") - F.col("n") * vocabulary.log_rest).alias("score"),
    )
