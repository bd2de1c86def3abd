"""Parquet sinks that can be run again: content hashes per partition, and only what changed is overwritten."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.sources.scratch import written

c = F.col
#: Hexadecimal digits of a row's digest that make one summed word; four words of sixty bits.
_WORDS, _DIGITS = 4, 15


def row_text(columns: Sequence[str]) -> Column:
    """A row as one text: columns by name, each with the length of its value, so that no two rows read alike.
    Null is told from an empty text."""
    value = lambda name: c(name).cast("string")
    part = lambda name: F.coalesce(F.concat(F.char_length(value(name)).cast("string"), F.lit(":"), value(name)), F.lit("~"))
    return F.concat_ws(",", *[part(name) for name in sorted(columns)])


def digest_sums(columns: Sequence[str]) -> list[Column]:
    """Aggregates w1 to w4: sums of the words of the rows' sha256. Order plays no part, repeats count, and
    partial sums combine before the shuffle."""
    digest = F.sha2(row_text(columns), 256)
    word = lambda i: F.conv(F.substring(digest, 1 + i * _DIGITS, _DIGITS), 16, 10).cast("decimal(20,0)")
    return [F.sum(word(i)).alias(f"w{i + 1}") for i in range(_WORDS)]


def hash_of_sums(rows: Column) -> Column:
    """The content hash from a number of rows and the sums w1 to w4."""
    return F.sha2(F.concat_ws("|", rows.cast("string"), *[F.coalesce(c(f"w{i + 1}"), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(_WORDS)]), 256)


def content_hashes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, n_rows, content_hash: the same for the same rows in whatever order, files or partitions."""
    sums = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *digest_sums(df.columns))
    return sums.select(*by, "n_rows", hash_of_sums(c("n_rows")).alias("content_hash"))


def compare(now: DataFrame, before: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """by, n_rows, content_hash, action: new, changed, unchanged, or absent where only `before` has it."""
    if before is None:
        return now.withColumn("action", F.lit("new"))
    old = before.select(*by, c("content_hash").alias("_old"), c("n_rows").alias("_n"))
    pairs = now.join(old, list(by), "full")
    action = F.when(c("_old").isNull(), "new").when(c("content_hash").isNull(), "absent").when(c("_old") == c("content_hash"), "unchanged").otherwise("changed")
    return pairs.select(*by, F.coalesce("n_rows", "_n").alias("n_rows"), F.coalesce("content_hash", "_old").alias("content_hash"), action.alias("action"))


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replaces the partitions that `df` has rows of, and no others. Run twice, it leaves the same rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def upsert(df: DataFrame, path: str, by: Sequence[str], before: DataFrame | None = None) -> DataFrame:
    """Writes the partitions whose content is not that of `before`; returns what became of each.

    `before` is an earlier result of this function. Keys may not be null."""
    report = written(compare(content_hashes(df, by), before, by), "upsert")
    touched = report.where(c("action").isin("new", "changed")).select(*by)
    overwrite_partitions(df.join(touched, list(by), "left_semi"), path, by)
    return report
