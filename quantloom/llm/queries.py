"""Queries of this subpackage, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import common, fill_in_middle, quality_rules

#: Where the public tokenizer files are; a parameter of the operators.
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.token_files import read_token_files, write_token_files

    folder = common.shared_folder(spark, "token-files")
    write_token_files(common.documents(spark, sf_dir), tokenizer(BYTE_BPE), folder, end_id=0)
    return read_token_files(spark, folder)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.suffix_dedup import removal_report

    return removal_report(common.documents(spark, sf_dir))


def op3_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.embedding_links import embedding_links

    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.secret_scan import secret_report

    return secret_report(common.documents(spark, sf_dir))


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.bpe_automaton import encode_report

    return encode_report(common.documents(spark, sf_dir), tokenizer(BYTE_BPE))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.token_counts import token_counts

    return token_counts(common.documents(spark, sf_dir), tokenizer(PIECE_BPE), common.stable_folder(spark, "token-counts"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm import language_id

    docs = common.documents(spark, sf_dir)
    return language_id.identify(docs, language_id.train(docs))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.jaccard_join import JaccardSettings, jaccard_groups

    return jaccard_groups(common.documents(spark, sf_dir), JaccardSettings(words=3, percent=90))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.quality_rules import quality_rules

    return quality_rules(common.documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.packing import pack

    return pack(common.documents(spark, sf_dir), tokenizer(BYTE_BPE), end_id=2, capacity=1024)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.whitening import whitening_report

    return whitening_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.middle_report(common.documents(spark, sf_dir))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm import quality_classifier

    docs = common.documents(spark, sf_dir)
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.classify_quality(docs, model)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_embedding_links": op3_embedding_links,
    "op4_secret_scan": op4_secret_scan,
    "op5_bpe_automaton": op5_bpe_automaton,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality_rules": op9_quality_rules,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_quality_classifier": op13_quality_classifier,
}

ORACLES: dict[str, str] = {
    "op9_quality_rules": quality_rules.SQL,
    "op12_fill_in_middle": fill_in_middle.SQL,
}
