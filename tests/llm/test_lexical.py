"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from ensemblar.llm import lexical

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def texts(rng, n):
    words = ["the", "of", "In", "Ünï", "42", "漢字", *(f"w{k}" for k in range(120))]
    weights = [60, 40, 30, 5, 5, 5, *(20 / (k + 1) for k in range(120))]
    made = [" ".join(rng.choices(words, weights, k=int(rng.expovariate(1 / 12)))) + rng.choice(["", ".", "-the!"]) for _ in range(n)]
    return made + [made[0], made[0], made[1].upper(), "", "   ", "!?", None, "word " * 20_000 + "w5"]


@pytest.mark.parametrize("most_docs,most_postings,query_bytes", [(1 << 13, 1 << 19, 4 << 20), (7, 1 << 19, 150), (50, 60, 1)])
def test_ranks_equal_brute_force(spark, most_docs, most_postings, query_bytes):
    rng = random.Random(5)
    made = texts(rng, 300)
    ids = [rng.randrange(10_000) for _ in made]
    ids[3] = ids[4] = None
    ids[7] = ids[8]
    docs = list(zip(ids, made, strict=True))
    docs.append(docs[0])
    items = [(1, made[5]), (2, "The the of w1 nowhere"), (3, None), (4, ""), (5, made[0]), (5, made[1]), (None, "w2 w3 w2"), (7, " ".join(f"w{k}" for k in range(60))), (8, "nowhere at all zzz")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, query string, score int").repartition(3)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    got = lexical.rank_documents(d, q, 20, most_docs=most_docs, most_postings=most_postings, query_bytes=query_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 20)


def test_all_tie(spark):
    docs = [(k, "same words here") for k in range(500, 0, -1)] + [(900, "other words")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    q = spark.createDataFrame([(1, "here same")], "item_id long, text string")
    assert [r.doc_id for r in lexical.rank_documents(d, q, 20, most_docs=64).orderBy("rank").collect()] == list(range(1, 21))


def test_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id int, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank_documents(d.limit(0), q).count() == lexical.rank_documents(d, q.limit(0)).count() == 0
