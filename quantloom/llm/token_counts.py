"""Operator 6: token counts from a digest cache."""

from __future__ import annotations

import hashlib
import importlib.metadata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import common


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the library's version: counts are kept under it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library} {importlib.metadata.version(library)}".encode()).hexdigest()


def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from quantloom.llm.tokens import chunk_encoder

    encoder = chunk_encoder(path)
    return lambda texts: [len(x) // 4 for x in encoder.encode(texts)]


def _cache(spark: SparkSession, folder: str, version: str) -> DataFrame | None:
    """Digests and counts kept for this version, or None while there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version={version}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("digest binary, n_tokens long").parquet(f"{folder}/version={version}")


def token_counts(docs: DataFrame, tokenizer: str, cache_folder: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row's whole text.

    A text's digest is the SHA-256 of its UTF-8 bytes; the only normalisation is that a null text
    counts as empty, since any other could change a count. Distinct digests that the cache of this
    tokenizer version lacks are encoded once and appended; then all rows join the cache. Copies are
    reduced to one per task before the shuffle, so a text that a third of the rows share costs no
    more than another. Repeated ids stay separate rows.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    common.small_batches(spark)
    digest = F.unhex(F.sha2(common.empty_text(text_column), 256))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), digest.alias("digest"), F.octet_length(common.empty_text(text_column)).cast("long").alias("n_bytes"))
    texts = docs.select(digest.alias("digest"), common.empty_text(text_column).alias("text"))
    kept = _cache(spark, cache_folder, version)
    if kept is not None:
        # Digests first: texts that are known are not shuffled.
        missing = common.materialise(rows.select("digest").distinct().join(kept, "digest", "left_anti"), "missing-digests")
        texts = texts.join(missing, "digest", "left_semi")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(tokenizer)
        for batch in batches:
            yield pd.DataFrame({"digest": batch["digest"], "n_tokens": counter(batch["text"].tolist())})

    counted = texts.dropDuplicates(["digest"]).mapInPandas(count, "digest binary, n_tokens long")
    counted.write.mode("append").parquet(f"{cache_folder}/version={version}")
    # Two runs at once may both append a digest; they agree on its count.
    kept = _cache(spark, cache_folder, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    out = rows.join(kept, "digest", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
