"""Quality rules per document and verdicts per host, in built-in SQL functions only.

Per document: words, characters in words, symbols, repeated lines, and words
that lie in an 8-word window found twice or more.  A document fails the base
rules if it has too few words or too many repeated ones.  Per host and rule (few
words, repeated words, symbols, repeated lines): the share of failures is shrunk
towards the rule's beta prior, whose mean and strength are fitted to the hosts
themselves by moments, so that a host with few documents is judged by the
corpus; documents of a host that has any shrunk rate above the limit go.

Windows are compared by a 64-bit hash of their words' hashes within one text.

Defined results: a null text has no words and fails; a null host has no
verdict, its documents are judged by the base rules alone; repeated rows are
judged one by one; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entigraph.llm.common import looked_up
from entigraph.plans.workspace import saved

WHITE = r"[\x20\x09-\x0D]+"
WORD_CHARACTER = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Bounds of the prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 10_000.0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column, window: int) -> Column:
    """How many words lie in a window that occurs at least twice."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(placed, lambda s: _let(F.sort_array(F.transform(F.filter(s, lambda x, j: _twice(s, x, j)), lambda x: x["i"])), steps))

    def _twice(s: Column, x: Column, j: Column) -> Column:
        before = F.when(j > 0, F.get(s, j - 1)["h"])
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False))

    def steps(d: Column) -> Column:
        new = F.transform(d, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(d, j + 1) - x, F.lit(window))))
        return F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)

    none = F.lit(0).cast("long")
    by_windows = _let(hashes, lambda h: _let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), none).otherwise(covered(w))))
    return F.when(F.size(words) <= window, none).otherwise(by_windows)


def document_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """key, host, counts and ``base_failed`` of each document."""
    body = F.coalesce(F.col(text), F.lit(""))

    def measured(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeated_words(words, WINDOW).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD_CHARACTER))
    rows = docs.select(
        F.col(key),
        F.col(host).alias("_host"),
        _let(F.array_remove(F.split(body, WHITE), ""), measured).alias("_m"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    n, repeated = F.col("_m.n_words"), F.col("_m.n_repeat_words")
    failed = (n < least_words) | (100 * repeated > most_repeated * n)
    return rows.select(key, "_host", n.alias("n_words"), F.col("_m.word_chars").alias("word_chars"), "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"), failed.alias("base_failed"))


def rule_failures() -> dict[str, Column]:
    """The rules that hosts are judged by, each a condition on a document's counts."""
    return {
        "words": F.col("n_words") < 20,
        "repeats": 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "lines": 10 * F.col("n_dup_lines") > F.col("n_words"),
    }


def host_verdicts(rules: DataFrame, limit: float = 0.5) -> DataFrame:
    """``_host``, the shrunk rate of each rule's failures, and whether any is above ``limit``.

    Each rule has a prior of its own, fitted by moments to the rates of all hosts.
    """
    failures = rule_failures()
    hosts = rules.where("_host is not null").groupBy("_host").agg(F.count(F.lit(1)).alias("n"), *(F.sum(failed.cast("long")).alias(rule) for rule, failed in failures.items()))
    hosts = saved(hosts, "hosts")
    moments = [x for r in failures for x in (F.avg(F.col(r) / F.col("n")).alias(f"m_{r}"), F.var_pop(F.col(r) / F.col("n")).alias(f"v_{r}"))]
    row = hosts.agg(F.avg(1 / F.col("n")).alias("i"), *moments).first()  # one row
    rates = {}
    for rule in failures:
        m, v, i = (row[x] or 0.0 for x in (f"m_{rule}", f"v_{rule}", "i"))
        between = v - m * (1 - m) * i  # what is left of the variance after chance within hosts
        strength = min(STRONGEST, max(WEAKEST, m * (1 - m) / between - 1)) if between > 0 else STRONGEST
        rates[rule] = (F.col(rule) + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select("_host", *(rate.alias(f"{rule}_rate") for rule, rate in rates.items()), (F.greatest(*rates.values()) > limit).alias("_bad"))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", limit: float = 0.5) -> DataFrame:
    """key, counts, ``base_failed`` and ``kept`` of each document."""
    rules = saved(document_rules(docs, key, text, host), "rules")
    bad = host_verdicts(rules, limit).where("_bad").select("_host", "_bad")
    done = looked_up(rules, saved(bad, "bad-hosts"), "_host", F.col(key))
    kept = ~F.col("base_failed") & ~F.coalesce("_bad", F.lit(False))
    return done.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 6))) AS i FROM d) WHERE i + 7 <= len(w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 8) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
f AS (SELECT source, r.rule, CASE r.rule WHEN 1 THEN n_words < 20 WHEN 2 THEN 100 * n_repeat_words > 30 * n_words WHEN 3 THEN 10 * n_symbols > n_words ELSE 10 * n_dup_lines > n_words END AS failed
  FROM b, (VALUES (1), (2), (3), (4)) r(rule) WHERE source IS NOT NULL),
h AS (SELECT rule, source, count(*) AS n, CAST(count(*) FILTER (failed) AS DOUBLE) AS k FROM f GROUP BY rule, source),
s AS (SELECT rule, avg(k / n) AS mean, var_pop(k / n) AS spread, avg(1.0 / n) AS per FROM h GROUP BY rule),
p AS (SELECT rule, mean, CASE WHEN spread > mean * (1 - mean) * per THEN least(10000.0, greatest(1.0, mean * (1 - mean) / (spread - mean * (1 - mean) * per) - 1)) ELSE 10000.0 END AS strength FROM s),
bad AS (SELECT DISTINCT source FROM h JOIN p USING (rule) WHERE (k + mean * strength) / (n + strength) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(source NOT IN (SELECT source FROM bad), true) AS kept
FROM b
"""
