"""URL filters: longest matching rule, else a logistic regression on hashed character n-grams.

Everything is DataFrame and SQL functions. The model is a weight for each hash
bucket; it is fitted by full-batch AdaGrad steps, each one small aggregation over
the labelled table, and applied as an expression, so that scoring the
whole table needs no shuffle.
"""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BLOCK, ALLOW = "block", "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end.

    Both are empty for null and where there is no ``://``.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits.

    A rule is (verdict, ``host/path``). It fits its host and all subdomains
    where the path starts with the rule's. Rules of equal length: the first.
    """
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def ngram_buckets(host: Column, path: Column, n: int = 3, dims: int = 4096) -> Column:
    """The distinct hash buckets of the character n-grams of host and path, which are told apart."""

    def grams(mark: str, text: Column) -> Column:
        chars = F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != "")
        last = F.greatest(F.size(chars) - n, F.lit(0))
        hashed = lambda i: F.pmod(F.xxhash64(F.lit(mark), F.concat_ws("", F.slice(chars, i + 1, n))), F.lit(dims)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), hashed)

    return F.array_distinct(F.concat(grams("h", host), grams("p", path)))


def _probability(buckets: Column, weights: list[float], bias: float) -> Column:
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(buckets, F.lit(float(bias)), lambda acc, i: acc + F.element_at(table, i + 1))
    return 1 / (1 + F.exp(-total))


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", dims: int = 4096, n: int = 3, max_labelled: int = 4000, steps: int = 12, rate: float = 0.5) -> tuple[list[float], float]:
    """Bucket weights and bias of P(blocked | url).

    ``labelled`` is a small table; of a larger one the ``max_labelled`` distinct
    urls with the smallest hashes are taken. With no labelled row all weights
    are zero. A url with both labels counts for each.
    """
    rows = labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("y"))
    rows = rows.where("url is not null and y is not null").distinct()
    rows = rows.orderBy(F.xxhash64("url"), "url", "y").limit(max_labelled)
    rows = cut(rows.select(ngram_buckets(*host_and_path(F.col("url")), n, dims).alias("buckets"), "y"))
    weights, seen, bias, bias_seen = [0.0] * dims, [1e-8] * dims, 0.0, 1e-8
    for _ in range(steps):
        slope = rows.select("buckets", (_probability(F.col("buckets"), weights, bias) - F.col("y")).alias("g"))
        # one row a bucket, dims at most; -1 is the bias
        sums = slope.select(F.explode(F.concat(F.array(F.lit(-1)), "buckets")).alias("i"), "g").groupBy("i").agg(F.avg("g") * F.count("g"), F.count("g")).collect()
        if not sums:
            break
        count = max(c for i, _, c in sums if i == -1)
        for i, g, _ in sums:
            g /= count
            if i < 0:
                bias_seen += g * g
                bias -= rate * g / math.sqrt(bias_seen)
            else:
                seen[i] += g * g
                weights[i] -= rate * g / math.sqrt(seen[i])
    return weights, bias


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", dims: int = 4096, n: int = 3, max_labelled: int = 4000) -> DataFrame:
    """(id_col, host, path, rule, verdict, p_block) for every row of ``pages``.

    ``labelled`` is the small labelled url table (url, blocked). Without
    one, the urls that a rule decides are the labelled table. A rule's verdict
    stands; elsewhere the url is blocked where p_block is over one half. Null
    and malformed urls have empty host and path, fit no rule and are judged by
    the model like any other. Repeated rows each get a row; other columns
    are ignored; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rule, says = match_rules(F.col("host"), F.col("path"), rules)
    ruled = parts.select("*", rule.alias("rule"), says.alias("says"))
    if labelled is None:
        labelled = ruled.where("says is not null").select("url", (F.col("says") == BLOCK).alias("blocked"))
    weights, bias = fit(labelled, "url", "blocked", dims, n, max_labelled)
    scored = ruled.select("*", _probability(ngram_buckets(F.col("host"), F.col("path"), n, dims), weights, bias).alias("p_block"))
    verdict = F.coalesce("says", F.when(F.col("p_block") > 0.5, BLOCK).otherwise(ALLOW))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "p_block")
