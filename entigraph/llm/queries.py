"""The corpus operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.llm import bpe, embedding_dedup, html_extract, language_id, packing, quality_rules, simhash_dedup, token_counts, toxicity, warc
from entigraph.llm.common import load
from entigraph.plans.workspace import saved

RANKS = "byte_bpe_50k.tiktoken"
VOCABULARY = "byte_bpe_50k.json"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(load(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(load(spark, sf_dir, "documents"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.written_and_read(load(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(load(spark, sf_dir, "documents"))


def _hosts_by_length(docs: DataFrame) -> DataFrame:
    """Documents with a host derived from them, so that some hosts fail: short texts have one of their own in each source."""
    return docs.withColumn("source", F.concat_ws("/", "source", F.when(F.length("text") < 160, "short").when(F.rlike("text", F.lit(r"[%*$&#]{3}")), "signs")))


def quality_of_failing_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_hosts_by_length(load(spark, sf_dir, "documents"))).select("doc_id", "base_failed", "kept")


def quality_host_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each derived host's verdict, and its rates to six digits."""
    rules = saved(quality_rules.document_rules(_hosts_by_length(load(spark, sf_dir, "documents"))), "rules")
    rates = quality_rules.host_verdicts(rules)
    return rates.select(F.col("_host").alias("host"), *(F.round(c, 6).alias(c) for c in rates.columns if c.endswith("_rate")), F.col("_bad").alias("bad"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(load(spark, sf_dir, "embeddings"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash_dedup.fingerprint_groups(load(spark, sf_dir, "documents"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
k AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN k USING (vec_id)
"""


#: Hosts derived as in the query; the rates by the textbook's two parameters of a beta distribution, alpha and beta.
_HOSTS_SQL = r"""
WITH d AS (SELECT doc_id, concat_ws('/', source, CASE WHEN length(text) < 160 THEN 'short' WHEN regexp_matches(text, '[%*$&#]{3}') THEN 'signs' END) AS host, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
windows AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 6))) AS i FROM d) WHERE i + 7 <= len(w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 8) r(k) GROUP BY doc_id),
b AS (SELECT doc_id, host, len(w) < 20 AS words, 100 * coalesce(rep.n, 0) > 30 * len(w) AS repeats,
  10 * length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) > len(w) AS symbols, 10 * coalesce(lines.n, 0) > len(w) AS lines_
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
u AS (UNPIVOT (SELECT host, count(*) AS n, avg(words::INT) AS words, avg(repeats::INT) AS repeats, avg(symbols::INT) AS symbols, avg(lines_::INT) AS lines FROM b GROUP BY host) ON words, repeats, symbols, lines INTO NAME rule VALUE share),
q AS (SELECT rule, avg(share) AS m, var_pop(share) - avg(share) * (1 - avg(share)) * avg(1.0 / n) AS v FROM u GROUP BY rule),
a AS (SELECT rule, m * s AS alpha, (1 - m) * s AS beta FROM (SELECT rule, m, CASE WHEN v > 0 THEN least(10000, greatest(1, m * (1 - m) / v - 1)) ELSE 10000 END AS s FROM q)),
r AS (SELECT host, rule, (alpha + share * n) / (alpha + beta + n) AS rate FROM u JOIN a USING (rule)),
h AS (SELECT host, max(rate) FILTER (rule = 'words') AS words_rate, max(rate) FILTER (rule = 'repeats') AS repeats_rate, max(rate) FILTER (rule = 'symbols') AS symbols_rate, max(rate) FILTER (rule = 'lines') AS lines_rate, max(rate) > 0.5 AS bad FROM r GROUP BY host)
"""
_HOST_RATES_SQL = _HOSTS_SQL + "SELECT host, round(words_rate, 6) AS words_rate, round(repeats_rate, 6) AS repeats_rate, round(symbols_rate, 6) AS symbols_rate, round(lines_rate, 6) AS lines_rate, bad FROM h"
_FAILING_HOSTS_SQL = _HOSTS_SQL + "SELECT doc_id, words OR repeats AS base_failed, NOT (words OR repeats OR bad) AS kept FROM b JOIN h USING (host)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_html_extraction, op2_language_id, op3_bpe_round_trip, op4_warc_archive, op5_best_fit_packing)
    own += (op6_quality_rules, op7_token_counts, op8_toxicity, op9_embedding_dedup, op10_simhash_dedup, quality_of_failing_hosts, quality_host_rates)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    hosts = {"quality_of_failing_hosts": _FAILING_HOSTS_SQL, "quality_host_rates": _HOST_RATES_SQL}
    return hosts | {"op4_warc_archive": warc.ORACLE_SQL, "op6_quality_rules": quality_rules.ORACLE_SQL, "op9_embedding_dedup": _EMBEDDINGS_SQL}
