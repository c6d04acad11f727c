"""The divergence audit against plain counting, and the transducer against a sorted list."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ensemblar.llm import divergence

PATTERN = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, least=3, top=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        df[lang].update(set(terms(text)))
        counts[lang, source].update(terms(text))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in df[lang].items() if n >= least), key=str.encode)
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        whole = sum(n.values()) + len(kept)
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 1) // whole for t in kept}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (n[s] + len(kept)) for t in kept} for s in sources}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources - {s}]
            own = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def made(rng, n):
    words = ["the", "THE", "ünï", "漢字", "x1y", "a", "ab", "abc", "z" * 70, "q" * 300, *("".join(rng.choices("abcde", k=rng.randrange(1, 7))) for _ in range(150))]
    rows = [(rng.choice(["en", "de", "x"]), rng.choice(["s1", "s2", "s10", "Z", "é"]), " ".join(rng.choices(words, k=rng.randrange(30)))) for _ in range(n)]
    return rows + [rows[0], rows[0], (None, None, "ab ab"), (None, "s1", None), ("no", "s1", "only once"), ("no", "s2", ""), ("one", "s", "word word"), ("en", "s1", "the " * 30_000)]


@pytest.mark.parametrize("held", [1 << 20, 40, 0])
def test_audit_equals_plain_counting(spark, held):
    rows = made(random.Random(4), 200)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, ordinal int").repartition(3)
    got = divergence.audit(df, held=held, top=20)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, top=20)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
    only = spark.createDataFrame([("en", "a", ""), ("en", "b", None)], "lang string, source string, text string")
    assert sorted(map(tuple, divergence.audit(only).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_transducer():
    rng = random.Random(6)
    for alphabet, n in ((b"ab", 60), (bytes(range(256)), 400), (b"abcdefgh", 3000)):
        words = sorted({bytes(rng.choices(alphabet, k=rng.randrange(9))) for _ in range(n)})
        for kept in (words, [w for w in words if w], words[:1], []):
            t = divergence.Transducer.from_bytes(divergence.Transducer.build(kept).to_bytes())
            asked = words + [w + b"x" for w in words] + [w[:-1] for w in words]
            at = {w: k for k, w in enumerate(kept)}
            assert t.ordinals(asked).tolist() == [at.get(w, -1) for w in asked]
    # endings are shared: 2^12 words of equal length need a state a letter
    full = [format(k, "012b").encode() for k in range(1 << 12)]
    assert len(divergence.Transducer.build(full)) == 13
    with pytest.raises(ValueError):
        divergence.Transducer.build([b"b", b"a"])


def test_vocabulary_of_several_transducers():
    words = sorted({str(k * 7919 % 10007).encode() for k in range(3000)})
    shards = []
    for lo in range(0, len(words), 700):
        part = words[lo : lo + 700]
        shards.append((part[0], (np.arange(len(part), dtype=np.int64) + lo).tobytes(), divergence.Transducer.build(part).to_bytes()))
    random.Random(1).shuffle(shards)
    asked = [b"", b"~", *words, *(w + b"0x" for w in words)]
    at = {w: k for k, w in enumerate(words)}
    assert divergence.Vocabulary(shards).ordinals(asked).tolist() == [at.get(w, -1) for w in asked]


def test_shares_are_exact():
    rng = random.Random(8)
    whole = [rng.randrange(1, 9 * 10**15) for _ in range(2000)]
    count = [rng.randrange(w) for w in whole]
    got = divergence._share(np.array(count), np.array(whole)).tolist()
    assert got == [1 + 10**9 * (c + 1) // w for c, w in zip(count, whole, strict=True)]
