"""Quality rules whose cutoffs bound the share of good documents that they reject.

A rule rejects a document when its ratio exceeds the cutoff of the document's stratum.  Cutoffs come from labelled
documents.  For each rule and stratum the candidate cutoffs are tested from the most lenient to the strictest: with
``n`` good labelled documents of which ``k`` would be rejected, a cutoff is certified while the exact binomial
probability of at most ``k`` rejections, were the true rate ``ALPHA`` / rules, is at most ``DELTA`` / (rules x strata)
(the Clopper-Pearson upper bound is then below that rate).  Testing in this order needs no correction within the
sequence; the division is Bonferroni's over all sequences.  So with probability 1 - ``DELTA`` no stratum loses more than
``ALPHA`` of its good documents to all rules together.  Of the certified cutoffs, that which rejects most bad minus good
labelled documents is taken, the most lenient of equals; where that is not above zero, or nothing is certified, as with
few labels, the rule is off in that stratum.

Defined results: a null or empty text has all ratios 0 and is kept; a null stratum is a stratum; documents without a
label, or with a null one, do not calibrate; repeated rows each count; empty tables give an empty result; extra columns
pass through, and those that clash with new names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from . import features
from .columns import append, dropping
from .store import cut

ALPHA, DELTA, STEPS = 0.02, 0.05, 100
#: Each rule's ratio: numerator and denominator among the counts.
RULES = {"upper": ("n_upper", "n_letters"), "symbol": ("n_symbols", "n_chars"), "repeat": ("n_repeats", "n_words"), "number": ("n_numbers", "n_chars"), "line": ("n_repeated_lines", "n_lines")}
_COUNTS = sorted({c for pair in RULES.values() for c in pair})


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts that the rules use."""
    at = [features.NAMES.index(c) for c in _COUNTS]
    return append(df, text, [StructField(c, LongType()) for c in _COUNTS], lambda texts: [pa.array(x) for x in features.measure_texts(texts)[:, at].T])


def ratio(rule: str) -> Column:
    """A rule's ratio as an expression over the counts."""
    a, b = RULES[rule]
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """Probability of at most k of n at rate p."""
    return min(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k + 1)))


def choose(good: np.ndarray, bad: np.ndarray, families: int, alpha: float, delta: float, rules: int) -> int | None:
    """Index of the cutoff of one rule in one stratum, from counts of documents by the number of cutoffs they exceed."""
    n, best, gain = int(good.sum()), None, 0
    for j in range(len(good) - 2, -1, -1):  # cutoff j rejects those that exceed more than j cutoffs
        k, hit = int(good[j + 1 :].sum()), int(bad[j + 1 :].sum())
        if not n or binomial_cdf(k, n, alpha / rules) > delta / families:
            break
        if hit - k > gain:
            best, gain = j, hit - k
    return best


def calibrate(counted: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id", quality: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str | None, str], float]:
    """Cutoffs by stratum and rule, from counted documents and their labels (1 good, 0 bad)."""
    use = labels.where(F.col(quality).isNotNull()).select(F.col(doc_id).alias("__id"), (F.col(quality) > 0).alias("__good"))
    rows = counted.select(F.col(doc_id).alias("__id"), F.col(stratum).alias("__stratum"), *_COUNTS).join(use, "__id")
    exceeded = F.array(*[F.struct(F.lit(r).alias("rule"), F.least(F.ceil(ratio(r) * STEPS), F.lit(STEPS + 1)).cast("int").alias("bin"), ratio(r).alias("x")) for r in RULES])
    each = rows.select("__stratum", "__good", F.explode(exceeded).alias("e")).select("__stratum", "__good", "e.rule", "e.x", "e.bin")
    # number of cutoffs 0/STEPS .. STEPS/STEPS below the ratio, free of the product's rounding
    grid = lambda j: F.greatest(j, F.lit(0)) / F.lit(STEPS)
    bins = F.when(F.col("x") <= 0, 0).when((F.col("bin") > 0) & (F.col("x") <= grid(F.col("bin") - 1)), F.col("bin") - 1).when((F.col("bin") <= STEPS) & (F.col("x") > grid(F.col("bin"))), F.col("bin") + 1).otherwise(F.col("bin"))
    table = each.groupBy("__stratum", "rule", "__good", bins.alias("bin")).count().collect()  # strata x rules x cutoffs
    strata = {r[0] for r in table}
    found = {}
    for s in strata:
        for rule in RULES:
            good, bad = np.zeros(STEPS + 2, np.int64), np.zeros(STEPS + 2, np.int64)
            for r in table:
                if r[0] == s and r[1] == rule:
                    (good if r[2] else bad)[r[3]] += r[4]
            if (j := choose(good, bad, len(strata) * len(RULES), alpha, delta, len(RULES))) is not None:
                found[s, rule] = j / STEPS
    return found


def kept(counted: DataFrame, cutoffs: dict[tuple[str | None, str], float], stratum: str = "lang") -> DataFrame:
    """The documents that no rule of their stratum rejects."""
    fires = F.lit(False)
    for (s, rule), c in cutoffs.items():
        fires |= F.col(stratum).eqNullSafe(F.lit(s)) & (ratio(rule) > F.lit(c))
    return counted.where(~fires)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that the rules keep, with its ratios."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    counted = cut(dropping(with_counts(docs), "text"))
    cutoffs = calibrate(counted, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return kept(counted, cutoffs).select("doc_id", "lang", *[F.round(ratio(r), 9).alias(f"{r}_ratio") for r in RULES])


def sql(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """The query in DuckDB's SQL."""
    n = len(RULES)
    ratios = ", ".join(f"{a}::DOUBLE / greatest({b}, 1) AS {r}" for r, (a, b) in RULES.items())
    symbols = "".join("\\" + c if c in "\\^]-" else c for c in features.SYMBOLS)
    return f"""
WITH parts AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS l FROM documents),
counts AS (
  SELECT doc_id, lang, length(t) AS n_chars, length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper,
    length(regexp_replace(t, '[^\\p{{N}}]+', '', 'g')) AS n_numbers, length(regexp_replace(t, '[^{symbols}]+', '', 'g')) AS n_symbols, len(w) AS n_words,
    len(list_filter(list_zip(w[2:], w[:-2]), lambda p: p[1] = p[2])) AS n_repeats, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_repeated_lines FROM parts),
ratios AS (SELECT doc_id, lang, {ratios} FROM counts),
tall AS (SELECT doc_id, lang, u.rule AS rule, u.x AS x FROM (SELECT doc_id, lang, unnest([{", ".join(f"{{'rule': '{r}', 'x': {r}}}" for r in RULES)}]) AS u FROM ratios)),
held AS (SELECT tall.lang, tall.rule, tall.x, quality > 0 AS good FROM tall JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
families AS (SELECT count(DISTINCT coalesce(lang, chr(0))) * {n} AS m FROM held),
tried AS (
  SELECT lang, rule, j, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND x > j::DOUBLE / {STEPS}) AS k,
    count(*) FILTER (WHERE NOT good AND x > j::DOUBLE / {STEPS}) - count(*) FILTER (WHERE good AND x > j::DOUBLE / {STEPS}) AS gain
  FROM held, (SELECT unnest(generate_series(0, {STEPS})) AS j) GROUP BY ALL),
tail AS (
  SELECT *, n > 0 AND least(1.0, list_sum(list_transform(generate_series(0, k),
    lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({alpha / n!r}) + (n - i) * ln({1 - alpha / n!r}))))) <= {delta} / m AS sure
  FROM tried, families WHERE n > 0 AND k <= n * {alpha / n!r}),
strict AS (SELECT t.lang, t.rule, max(CASE WHEN s.sure IS NULL OR NOT s.sure THEN t.j END) AS first_bad FROM tried t LEFT JOIN tail s ON s.lang IS NOT DISTINCT FROM t.lang AND s.rule = t.rule AND s.j = t.j GROUP BY ALL),
cutoffs AS (
  SELECT tail.lang, tail.rule, arg_max(tail.j, tail.gain * 1000 + tail.j) AS j FROM tail JOIN strict ON strict.lang IS NOT DISTINCT FROM tail.lang AND strict.rule = tail.rule
  WHERE sure AND tail.j > coalesce(first_bad, -1) AND gain > 0 GROUP BY ALL)
SELECT doc_id, lang, {", ".join(f"round({r}, 9) AS {r}_ratio" for r in RULES)} FROM ratios r
WHERE NOT EXISTS (SELECT 1 FROM tall JOIN cutoffs c ON c.lang IS NOT DISTINCT FROM tall.lang AND c.rule = tall.rule WHERE tall.doc_id = r.doc_id AND tall.x > c.j::DOUBLE / {STEPS})"""
