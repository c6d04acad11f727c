"""What the language model does once and not again for each token."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ensemblar.llm import lm
from ensemblar.llm.gru import Gru

TEXTS = ["a b a", None, "", "  Ünder a\tb", "c é 🙂 c", "a", "zz b c a"]


def test_learning_looks_up_the_models_words_alone(monkeypatch):
    sizes = []
    monkeypatch.setattr(lm.pc, "index_in", lambda x, value_set, get=pc.index_in: sizes.append(len(value_set)) or get(x, value_set))
    for names, counts in (([b"", b"a", b"b", b"c", b"zz", b"x"], [7, 5, 3, 3, 1, 1]), ([], [])):
        known = lm.Vocabulary(names, counts, 3, 8, sum(counts), len(names))
        for texts in (pa.array(TEXTS), pa.array(TEXTS).slice(2), pa.array(["", None]), pa.array([], pa.string())):
            _, marks, n, _, _ = known.tokens(texts)
            sizes.clear()
            got, got_n = known.marks(texts)
            assert got.tolist() == marks.tolist() and got_n.tolist() == n.tolist()
            assert sizes == [known.n_model]


def test_words_are_counted_over_batches_of_any_size(spark, monkeypatch):
    docs = spark.createDataFrame([(t,) for t in TEXTS * 30], "text string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        found = lm.count_words(docs).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = Counter(w for t in TEXTS * 30 for w in lm.words(t))
    assert {bytes(r["word"]): r["c"] for r in found} == want and len(found) == len(want)


def test_step_is_a_gated_recurrent_step():
    net = Gru(np.array([0, 2, 4]), n_extra=2, hidden=3, seed=1)
    net.params = {k: v.astype(np.float64) * 3 for k, v in net.params.items()}
    h, ids, p = np.random.default_rng(0).normal(size=(5, 3)), np.array([0, 3, 6, 1, 1]), net.params
    x, sigmoid = p["inputs"][ids], lambda v: 1 / (1 + np.exp(-v))
    u, r = np.split(sigmoid(h @ p["gates"] + x[:, :6]), 2, axis=1)
    want = h + u * (np.tanh(r * (h @ p["state"]) + x[:, 6:]) - h)
    parts = net.parts()
    assert all(a.flags.c_contiguous for a in parts)
    assert np.allclose(net.step(ids, h, parts)[0], want) and np.allclose(net.step(ids, h)[0], want)
