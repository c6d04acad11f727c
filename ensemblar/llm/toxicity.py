"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of w[i] + sum over pairs of <v[i], v[j]>) over the
terms of a text. The pair term learns combinations, such as an insult
beside the mention of a group, that a sum of weights misses. A text is a vector of
length one over its terms. All buckets that enough labelled texts hold are learnt, those too
that tell nothing by themselves; those that do weigh more. The sample of labelled rows is bounded.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_bucket

#: ASCII letters and digits and all other bytes stay; the rest of ASCII parts terms.
_PART = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


#: Bytes of the word beginnings that are terms too, so that a stem counts whatever follows it.
BEGINNINGS = (4, 5, 6, 7)


def terms(text: str | None, bits: int) -> np.ndarray:
    """The distinct hash buckets of the text's words and of their beginnings."""
    words = set((text or "").encode("utf-8", "surrogatepass").lower().translate(_PART).split())
    for n in BEGINNINGS:
        words |= {b"^" + w[:n] for w in words if len(w) > n and w[0] != 94}
    return np.unique(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & ((1 << bits) - 1))


#: Entries of a batch of texts that are scored at once.
HELD = 1 << 20


@dataclass
class FactorizationMachine:
    """buckets (sorted), what a term of each counts, their weights and factors, and the bias."""

    bits: int
    buckets: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    factors: np.ndarray
    bias: float

    def place(self) -> np.ndarray:
        """For each bucket its row, or -1."""
        rows = np.full(1 << self.bits, -1, np.int32)
        rows[self.buckets] = np.arange(len(self.buckets))
        return rows

    def margins(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The log-odds of texts whose terms' rows are given one text after another."""
        return _forward(self.scale, self.weight, self.factors, self.bias, flat, sizes)[0]

    def score(self, rows: np.ndarray) -> float:
        """The probability for the rows of one text's terms."""
        return float(_sigmoid(self.margins(np.asarray(rows, np.int64), np.array([len(rows)])))[0])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _forward(scale: np.ndarray, w: np.ndarray, v: np.ndarray, bias: float, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Margins, and for slopes: what each term counts in its text, sums of factors by text, and each term's factors, both by what they count."""
    if not len(sizes):
        return np.zeros(0), np.zeros(0), np.zeros((0, v.shape[1])), np.zeros((0, v.shape[1]))
    text = np.repeat(np.arange(len(sizes)), sizes)
    x = scale[flat]
    x = x / np.sqrt(np.bincount(text, x * x, len(sizes)))[text]
    own = v[flat] * x[:, None]
    total = np.stack([np.bincount(text, c, len(sizes)) for c in own.T], 1)
    squares = np.bincount(text, (own * own).sum(1), len(sizes))
    return bias + np.bincount(text, w[flat] * x, len(sizes)) + 0.5 * ((total * total).sum(1) - squares), x, total, own


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _descend(scale: np.ndarray, flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, m: int, learnt: np.ndarray, k: int, steps: int, batch: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """AdaGrad on the logistic loss of batches of the ``learnt`` texts; both classes weigh alike."""
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(m), rng.normal(0, 0.05, (m, k)), 0.0
    seen_w, seen_v, seen_b = np.full(m, 1e-4), np.full((m, k), 1e-4), 1e-4
    ones = y[learnt].sum()
    share = np.where(y > 0, 0.5 / max(1, ones), 0.5 / max(1, len(learnt) - ones)) * len(learnt)
    starts, order = np.cumsum(sizes) - sizes, np.zeros(0, np.int64)
    for _ in range(steps):
        if not len(order):
            order = rng.permutation(learnt)
        rows, order = order[:batch], order[batch:]
        n = sizes[rows]
        places = flat[_spans(starts[rows], n)]
        z, x, total, own = _forward(scale, w, v, bias, places, n)
        g = share[rows] * (_sigmoid(z) - y[rows]) / len(rows)
        text = np.repeat(np.arange(len(rows)), n)
        gx = g[text] * x
        slope = np.bincount(places, gx, m)
        pairs = gx[:, None] * (total[text] - own)
        slopes = np.stack([np.bincount(places, c, m) for c in pairs.T], 1)
        seen_w += slope * slope
        seen_v += slopes * slopes
        seen_b += g.sum() ** 2
        w -= rate * slope / np.sqrt(seen_w)
        v -= rate * slopes / np.sqrt(seen_v)
        bias -= rate * g.sum() / np.sqrt(seen_b)
    return w, v, bias


def telling(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, m: int, learnt: np.ndarray, sure: float = 6.0, least: float = 0.05) -> np.ndarray:
    """What a term of each bucket counts: (z / sure)^2, z being the standard score of the gap between the shares of the classes' ``learnt`` rows with it, but ``least`` to 1.

    It makes known signs weigh more than chance; no bucket is left out.
    """
    n1, n0 = (y[learnt] > 0).sum(), (y[learnt] == 0).sum()
    if not n1 or not n0:
        return np.ones(m)
    ends = np.cumsum(sizes)
    c1, c0 = np.zeros(m), np.zeros(m)
    for k in np.flatnonzero(learnt):  # a text has a bucket once
        (c1 if y[k] > 0 else c0)[flat[ends[k] - sizes[k] : ends[k]]] += 1
    c = c1 + c0
    share = c / (n1 + n0)
    gap = c1 / n1 - c0 / n0
    z2 = gap * gap / np.maximum(1e-12, share * (1 - share) * (1 / n1 + 1 / n0))
    return np.clip(z2 / sure**2, least, 1)


def fit(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, bits: int, buckets: np.ndarray, k: int = 4, steps: int = 300, batch: int = 128, rate: float = 0.3, seed: int = 0) -> FactorizationMachine:
    """A machine for texts whose terms are rows of ``buckets``, given one text after another.

    A fifth of the rows is not learnt from; the bias is moved to where their classes fall apart best.
    """
    if not (len(buckets) and 0 < y.sum() < len(y)):
        return FactorizationMachine(bits, buckets[:0], np.zeros(0), np.zeros(0), np.zeros((0, 1)), -2.0)
    m, starts = len(buckets), np.cumsum(sizes) - sizes
    turn = np.random.default_rng(seed + 1).permutation(len(y)) % 5
    other = np.flatnonzero(turn == 0)
    scale = telling(flat, sizes, y, m, turn > 0)
    w, v, bias = _descend(scale, flat, sizes, y, m, np.flatnonzero(turn), k, steps, batch, rate, seed)
    z, truth = _forward(scale, w, v, bias, flat[_spans(starts[other], sizes[other])], sizes[other])[0], y[other]
    share = np.where(truth > 0, 0.5 / max(1, truth.sum()), 0.5 / max(1, len(truth) - truth.sum())) * (0 < truth.sum() < len(truth))
    low, high = -4.0, 4.0
    for _ in range(40):  # the loss is convex in the shift
        shift = (low + high) / 2
        low, high = (shift, high) if (share * (_sigmoid(z + shift) - truth)).sum() < 0 else (low, shift)
    shift *= share.any()
    return FactorizationMachine(bits, buckets, scale, w.astype(np.float32), v.astype(np.float32), float(bias + shift))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = 18, per_class: int = 3000, least_share: float = 0.0025, **options) -> FactorizationMachine:
    """A model from labelled rows.

    ``per_class`` rows of each label, those with the smallest id hashes, bound
    the sample, so that its join with ``docs`` moves no text. Buckets that less than ``least_share`` of its rows
    hold (one row, in small samples) are left out, whatever the labels of those rows. Ids with
    both labels count as positive; null labels are left out. ``options`` are those of ``fit``.
    """
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    # a row is 12 bytes, and each partition hands on per_class of them at most
    parts = [named.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (1, 0)]
    sample = cut(parts[0].union(parts[1]))

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([terms(t, bits).astype("<i4").tobytes() for t in texts])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(sample), "id")
    rows = texts.select("y", of("t").alias("terms")).dropDuplicates(["terms", "y"]).orderBy("terms", "y")
    held = rows.toArrow()  # 2 * per_class rows of 2^bits numbers, at most
    sizes = pc.binary_length(held["terms"]).to_numpy().astype(np.int64) // 4
    flat = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x.as_buffer(), "<i4") for x in held["terms"])])
    truth = held["y"].to_numpy().astype(np.float64)
    del held
    counts = np.bincount(flat, minlength=1 << bits)
    buckets = np.flatnonzero(counts >= max(2, least_share * len(sizes)))
    place = np.full(1 << bits, -1, np.int32)
    place[buckets] = np.arange(len(buckets))
    flat = place[flat]
    there = flat >= 0
    before = np.concatenate([[0], np.cumsum(there)])
    ends = np.cumsum(sizes)
    return fit(flat[there], before[ends] - before[ends - sizes], truth, bits, buckets, **options)


def score(text: Column, model: FactorizationMachine) -> Column:
    """The model's probability for each text; null counts as empty."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        place, out, rows, held = model.place(), [np.zeros(0)], [], 0

        def take() -> None:
            sizes = np.array([len(r) for r in rows], np.int64)
            out.append(_sigmoid(model.margins(np.concatenate(rows).astype(np.int64), sizes)))
            rows.clear()

        for t in texts:
            found = place[terms(t, model.bits)]
            rows.append(found[found >= 0])
            held += len(rows[-1])
            if held >= HELD:
                take()
                held = 0
        if rows:
            take()
        return pd.Series(np.concatenate(out))

    return of(text)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, keep: list[str] | None = None, **options) -> DataFrame:
    """(id_col, kept columns, held_out, score, predicted) for every row of ``docs``.

    Rows whose crc32(id as text) mod ``folds`` is 0 are held out: no label of theirs is
    learnt. Null and empty texts are scored by the bias alone. Null ids
    count as the text 'null'. Repeated rows each get a row; an empty table or
    no label of one class gives a model of the bias alone.
    """
    model = train(docs, labels.where(id_bucket(F.col(id_col), folds) != 0), id_col, text_col, label_col, **options)
    names = [id_col, *(keep or [])]
    scored = docs.select(*names, (id_bucket(F.col(id_col), folds) == 0).alias("held_out"), score(F.col(text_col), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
