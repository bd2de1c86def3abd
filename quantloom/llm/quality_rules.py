"""Operator 9: document rules, and host verdicts from shrunken failure rates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import common


#: Rejected hosts up to this number are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000


@dataclass(frozen=True)
class RuleLimits:
    min_words: int = 10
    repeat_percent: int = 20  # words in repeated windows, of all words
    window: int = 5
    dup_lines_percent: int = 50  # lines equal to an earlier one, of all words
    symbols_percent: int = 50  # symbols, of all words
    host_rate: float = 0.5  # a host is rejected beyond this shrunken rate


def rule_counts(docs: DataFrame, limits: RuleLimits = RuleLimits(), text_column: str = "text") -> DataFrame:
    """The frame's rows with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long).

    Null texts have no words. n_repeat_words counts the words that lie in a window of `window` words
    found at two places of the text or more. Windows are compared by a 64-bit hash of their words'
    64-bit hashes, within one text only. Columns of those names, and names that begin with
    `__rule`, are replaced.
    """
    text, n = common.empty_text(text_column), limits.window
    out = docs.withColumn("__rule_words", F.filter(F.split(text, common.SPACE), lambda w: w != ""))
    out = out.withColumn("__rule_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumns({
        "n_words": F.size("__rule_words").cast("long"),
        "word_chars": F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size("__rule_lines") - F.size(F.array_distinct("__rule_lines"))).cast("long"),
        "__rule_words": F.transform("__rule_words", lambda w: F.xxhash64(w)),
    }).drop("__rule_lines")
    nth = ", ".join(["x", *(f"get(__rule_words, i + {k})" for k in range(1, n))])
    out = out.withColumn("__rule_windows", F.expr(f"filter(transform(__rule_words, (x, i) -> if(i + {n} <= size(__rule_words), xxhash64({nth}), null)), x -> x is not null)"))
    # Texts without a repeated window, nearly all of them, skip the sort.
    out = out.withColumn("__rule_sorted", F.expr("if(size(array_distinct(__rule_windows)) < size(__rule_windows), array_sort(transform(__rule_windows, (x, i) -> struct(x, i))), null)"))
    out = out.withColumn("__rule_at", F.expr("array_sort(transform(filter(__rule_sorted, (s, k) -> s.x <=> get(__rule_sorted, k - 1).x or s.x <=> get(__rule_sorted, k + 1).x), s -> s.i))"))
    covered = f"aggregate(__rule_at, named_struct('seen', 0, 'n', 0L), (a, p) -> named_struct('seen', p + {n}, 'n', a.n + least({n}, p + {n} - a.seen)), a -> a.n)"
    out = out.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long"))
    return out.drop("__rule_words", "__rule_windows", "__rule_sorted", "__rule_at")


def _failed(limits: RuleLimits) -> tuple:
    base = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))
    more = (100 * F.col("n_dup_lines") > limits.dup_lines_percent * F.col("n_words")) | (100 * F.col("n_symbols") > limits.symbols_percent * F.col("n_words"))
    return base, base | more


def host_verdicts(failures: DataFrame, host: str, failed: str, limits: RuleLimits = RuleLimits()) -> DataFrame:
    """One row per non-null host: docs, failures, its failure rate shrunk by a beta prior, the verdict.

    The prior has the mean and spread of the hosts' own rates (moments); where they don't differ it
    weighs as much as a thousand documents.
    """
    hosts = failures.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("host_docs"), F.sum(F.col(failed).cast("long")).alias("host_failures"))
    rate = F.col("host_failures") / F.col("host_docs")
    mean, spread = hosts.agg(F.avg(rate), F.var_pop(rate)).first()  # one row
    mean, spread = mean or 0.0, spread or 0.0
    weight = min(1000.0, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1000.0
    shrunk = (F.col("host_failures") + mean * weight) / (F.col("host_docs") + weight)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > limits.host_rate)


def quality_rules(docs: DataFrame, limits: RuleLimits = RuleLimits(), id_column: str = "doc_id", host_column: str = "source", text_column: str = "text") -> DataFrame:
    """One row per input row: its id, the counts of rule_counts(), base_failed, host_rejected and kept.

    A document is kept if it passes the base rules (enough words, few of them in repeated windows)
    and its host isn't rejected. A host's failures are those of all its documents under all rules.
    Null hosts get no verdict. Repeated ids stay separate rows; an empty table gives an empty result.
    Counts are written to the shared folder once and read for both the hosts and the join, so texts
    are never shuffled.
    """
    base, failed = _failed(limits)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(host_column).alias("host"), F.col(text_column).alias("text"))
    rows = rule_counts(rows, limits).drop("text").withColumns({"base_failed": base, "failed": failed})
    rows = common.materialise(rows, "rule-counts")
    hosts = host_verdicts(rows, "host", "failed", limits).select("host", "host_rejected")
    out = rows.join(hosts, "host", "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))


def keep_quality(docs: DataFrame, limits: RuleLimits = RuleLimits(), host_column: str = "source", text_column: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that quality_rules() keeps.

    The rules run once: rows that pass the base rules are written beside each row's host and failure,
    both are read back for the hosts' rates, and only rejected hosts are joined, so texts are not
    shuffled unless rejected hosts are too many to broadcast.
    """
    base, failed = _failed(limits)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text_column).alias("__text"), F.col(host_column).alias("__host"))
    rows = rule_counts(rows, limits, "__text").select("__host", failed.alias("__failed"), F.when(~base, F.col("__row")).alias("__row"))
    rows = common.materialise(rows, "rule-rows")
    rejected = common.materialise(host_verdicts(rows, "__host", "__failed", limits).where("host_rejected").select("__host"), "rejected-hosts")
    rejected = F.broadcast(rejected) if rejected.count() <= BROADCAST_HOSTS else rejected
    return rows.where("__row is not null").join(rejected, "__host", "left_anti").select("__row.*")


#: The same over all of `documents`, for DuckDB.
SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS win
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 5) AS s(k) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
h AS (
  SELECT source, count(*) AS n,
    count_if(base_failed OR 100 * n_dup_lines > 50 * n_words OR 100 * n_symbols > 50 * n_words) AS bad
  FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 THEN least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS k FROM p),
z AS (SELECT source, (bad + m * k) / (n + k) > 0.5 AS host_rejected FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(host_rejected, false) AS host_rejected, NOT base_failed AND NOT coalesce(host_rejected, false) AS kept
FROM b LEFT JOIN z ON b.source = z.source
"""
