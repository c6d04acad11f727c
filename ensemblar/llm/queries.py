"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, covertree, divergence, lexical, lm, ogg, secret_scan, sentencepieces, toxicity
from .common import table
from .packing import pack_documents
from .simhash import near_duplicates
from .urls import ALLOW, BLOCK, filter_urls
from .warc import archive_and_read_back

#: The rules of op2, as (verdict, host/path).
URL_RULES = [(BLOCK, "com/en/"), (ALLOW, "example.com/en/7"), (ALLOW, "net/de/"), (BLOCK, "example.net/de/8"), (BLOCK, "org/es/")]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2, seed=42)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives."""
    return archive_and_read_back(table(spark, sf_dir, "pages"), least=100)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the secrets in every document."""
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: ~x["decoded"])
    counts = [secret_scan.count_kind(base, k).alias(f"n_{k}") for k in secret_scan.KINDS]
    digest = F.sha2(secret_scan.listed(base), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secret_scan.listed(F.col("spans")).alias("spans"), "layers", "cut_off")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt outside the held-out fifth."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5)


def op7_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.9."""
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", sentencepieces.encode(F.col("text")).alias("ids"))
    decoded = docs.withColumn("decoded", sentencepieces.decode(F.col("ids")))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's Ogg file and of the payload read back from it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", ogg.to_media(F.col("text")).alias("media"))
    read = docs.withColumn("read", ogg.from_media(F.col("media")))
    payload = F.col("read.payload")
    return read.select(
        "doc_id",
        F.col("read.n_bytes").alias("n_bytes"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("read.feature").alias("feature"),
    )


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and recurrent log-probabilities of every document."""
    return lm.score_documents(table(spark, sf_dir, "documents"), folds=10)

def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation as read back from its formatted text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    turns = turns.union(spark.range(2).select(F.lit(-1), "id", F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")), F.lit(tricky)))
    out = chat.format_conversations(turns).withColumn("whole", chat.formatted(F.col("segments")))
    out = out.withColumn("read", chat.read_back(F.col("whole"))).withColumn("learnt", chat.learnt(F.col("segments")))
    lines = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("whole").cast("long").alias("formatted_chars"),
        "valid",
        "first_bad_turn",
    )



def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents of highest score for every benchmark item."""
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between sources, and the terms that set each apart from its language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_url_filter, op3_packing, op4_warc, op5_secrets, op6_toxicity, op7_covertree, op8_sentencepiece, op9_ogg, op10_lm, op11_chat, op12_lexical, op13_divergence)
    return {f.__name__: f for f in found}


#: Equal payloads of 100 bytes or more refer to the smallest page_id.
WARC_SQL = r"""
with p as (select page_id, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') as url, encode(coalesce(html, '')) as b from pages),
d as (select page_id, url, octet_length(b) as n, sha256(b) as s from p),
h as (select s, min(page_id) as head from d where n >= 100 group by 1)
select page_id, n::bigint as payload_bytes, d.s as payload_digest,
       case when head is null or head = page_id then 'response' else 'revisit' end as record_type,
       case when head <> page_id then head end as refers_to, url as archived_url
from d left join h on h.s = d.s and d.n >= 100
"""

#: Every pair is compared; components by reachability.
COVERTREE_SQL = r"""
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
u as (select vec_id, e, sqrt(list_inner_product(e, e)) as n from v),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r as (select vec_id as a, vec_id as b from u union select r.a, l.b from r join l on l.a = r.b),
c as (select a, min(b) as c from r group by 1),
k as (select a, count(*) as n from l group by 1)
select vec_id, coalesce(k.n, 0)::bigint as n_links, c.c as component_id, c.c = vec_id as kept
from u join c on c.a = vec_id left join k on k.a = vec_id
"""

#: Lengths from marks and from the characters that escaping adds; the machine by neighbouring roles.
CHAT_SQL = r"""
with t as (select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c as (select unnest(['<s>', '</s>', '[SYS]', '[/SYS]', '[INST]', '[/INST]', '[ANS]', '[ROLE]', '[TEXT]', '[/ROLE]', chr(92)]) as mark),
e as (select conv_id, turn, role, text, lag(role, 1, 'start') over (partition by conv_id order by turn) as before,
  (select sum((length(text) - length(replace(text, mark, ''))) // length(mark)) from c) as more from t),
k as (select *, (before || ' ' || role) in ('start system', 'start user', 'system user', 'user assistant', 'assistant user') as fits from e)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  (3 + sum(length(text) + more + case role when 'system' then 13 when 'user' then 15 else 11 end))::bigint as formatted_chars,
  bool_and(fits) as valid, min(turn) filter (not fits) as first_bad_turn
from k group by 1
"""

#: Every document that shares a term with an item is scored.
LEXICAL_SQL = r"""
with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
i as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
c as (select doc_id, term, count(*) as tf from t group by 1, 2),
s as (select count(distinct doc_id) as n_docs, count(*) as n_words from t),
d as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from c, s group by 1),
m as (select doc_id, 75 + (25 * count(*) * any_value(n_docs)) // any_value(n_words) as m from t, s group by 1),
r as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score from i join c using (term) join d using (term) join m using (doc_id) group by 1, 2),
k as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from r where score > 0)
select item_id, rank, doc_id, score from k where rank <= 20
"""

#: Every group has every kept term of its language.
DIVERGENCE_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
t as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term from t group by 1, 2 having count(distinct r) >= 3),
v as (select lang, count(*) as v from k group by 1),
c as (select lang, source, term, count(*) as n from t semi join k using (lang, term) group by 1, 2, 3),
g as (select lang, source, coalesce(sum(n), 0) as n from (select distinct lang, source from d) left join c using (lang, source) group by 1, 2),
a as (select lang, sum(n) as n from g group by 1),
p as (select lang, g.source, k.term, coalesce(c.n, 0) as n, (1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.n + v))::bigint as p from g join v using (lang) join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (select lang, term, (1 + (1000000000 * (sum(p.n) + 1)) // (any_value(a.n) + any_value(v)))::bigint as q from p join a using (lang) join v using (lang) group by 1, 2),
s as (select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // y.p) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by 1, 2, 3),
o as (select x.lang, x.source, y.source as item from g x join g y on x.lang = y.lang and x.source <> y.source),
u as (select lang, source, 'pair' as part, item, coalesce(value, 0)::bigint as value from o left join s using (lang, source, item)
  union all select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p join q using (lang, term) where n > 0 and p > q),
f as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from u)
select lang, source, part, item, value, rank from f where part = 'pair' or rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express: no trained model, tokenizer or XXH64."""
    return {"op4_warc": WARC_SQL, "op7_covertree": COVERTREE_SQL, "op11_chat": CHAT_SQL, "op12_lexical": LEXICAL_SQL, "op13_divergence": DIVERGENCE_SQL}
