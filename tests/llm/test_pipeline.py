"""The pipeline and the registered queries against brute force on the smallest tables."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import connect, rows
from ensemblar.llm import queries, secret_scan, simhash
from test_llm_operators import wide_rule


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", F.lit("extra"))
    columns = docs.columns
    odd = spark.createDataFrame([(900001, None, "en", "s", 0, "e"), (900002, "", "en", "s", 0, "e"), (None, "alone here", "en", "s", 10, "e")], docs.schema)
    docs = docs.union(odd).union(docs.where("doc_id = 3"))
    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert kept.columns == columns and kept.where("doc_id >= 900001").count() == 2
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert kept.columns == columns
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    wide = {i: [[int(x) & 2**64 - 1 for x in simhash.wide_fingerprint((t or "").encode().lower().split(), n)] for n in (1, 5)] for i, t in texts.items()}
    ids = sorted(prints)

    def heads(links):
        root = {i: i for i in ids}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for n, i in enumerate(ids):
            for j in ids[:n]:
                if links(i, j):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        return {i for i in ids if find(i) == i}

    narrow = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2
    far = lambda i, j: wide_rule((wide[i][0], wide[j][0]), (wide[i][1], wide[j][1]))
    got = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert len(set(got)) == len(got) and heads(lambda i, j: narrow(i, j) or far(i, j)) == set(got) < heads(narrow)
    clean = {r.doc_id: r for r in corpus_pipeline.redact_secrets(spark, docs, sf_dir).collect()}
    for i, t in texts.items():
        spans = secret_scan.find_secrets(t)[0]
        assert (clean[i].text == t) == (not spans)
        assert clean[i].n_chars == (len(clean[i].text) if clean[i].text is not None else 0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_near_copies_go_by_row(spark, sf_dir):
    x, y, z = "some text that stands twice " * 9, "a wholly different one " * 9, "without any name " * 9
    rows = [(3, x), (5, x), (5, y), (None, x), (None, z), (None, z), (None, z), (7, x.upper()), (8, None), (9, ""), (8, None), (3, x)]
    docs = spark.createDataFrame([(i, t, "digest", 1) for i, t in rows], "doc_id long, text string, digest string, id int")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, x), (5, y), (None, z), (8, None)], key=str)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    total = out.agg(F.sum("length"), F.count_distinct("sequence_id"), F.count_distinct("doc_id")).first()
    assert total[1] >= -(-total[0] // 2048) and total[1] <= -(-total[0] // 2048) + 2 and 0 < total[2] <= 200


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir).toPandas()
    want = connect(sf_dir).sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"op12_lexical", "op13_divergence"}))
def test_every_row_is_there(spark, sf_dir, name):
    source = {"op2_url_filter": "pages", "op4_warc": "pages", "op7_covertree": "embeddings", "op11_chat": "conversations"}.get(name, "documents")
    got = queries.queries()[name](spark, sf_dir)
    key = got.columns[0]
    want = sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/{source}.parquet").select(key).collect())
    if name == "op11_chat":  # a row a conversation, and one more
        want = sorted({-1, *want})
    have = [r[0] for r in got.select(key).collect()]
    assert sorted(set(have) if name == "op3_packing" else have) == want
    if name == "op3_packing":  # pieces of a document are numbered without a gap
        pieces = got.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("piece").alias("d"), F.max("piece").alias("m"))
        assert pieces.where("n != d or n != m + 1").isEmpty()


def test_toxic_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows_ = [r for r in queries.op6_toxicity(spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    assert rows_ and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows_)
    assert sum(r.predicted == labels[r.doc_id] for r in rows_) / len(rows_) > 0.9
