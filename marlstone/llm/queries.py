"""The registered queries of the ten components and the pipeline, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bytebpe, exactdup, linededup, neardup, packing, pii, quality, tokenfiles, urlfilter


def _text(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def _bytes(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_report(table(spark, sf_dir, "documents"))


def op2_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_boilerplate(table(spark, sf_dir, "pages"), "page_id", linededup.host_of("url"), linededup.html_lines("html"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), _text("word_bpe_49k.json"))


def op5_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encode_texts(table(spark, sf_dir, "documents"), _bytes("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_digest(table(spark, sf_dir, "documents"), _text("word_bpe_49k.json"))


def op8_progressive_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_groups(table(spark, sf_dir, "documents"), digest=True)


def op9_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_contextual_pii, op2_attention_quality, op3_site_lines, op4_best_fit_packing, op5_url_ratio, op6_byte_level_bpe, op7_token_files, op8_progressive_exact, op9_anisotropic_ann, op10_bag_minhash, pipeline)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op3_site_lines": linededup.OP3_SQL, "op8_progressive_exact": exactdup.OP8_SQL}
