"""The thin queries opN_<name>: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, sharding, topk_search, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_records import digests

    return digests(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import digests

    return digests(_table(spark, sf_dir, "pages"), least=0)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(_table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import top5

    return top5(_table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=24)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import digests

    return digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import digests

    return digests(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import digests

    return digests(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_records, op2_language_id, op3_topk_search, op4_bpe, op5_warc, op6_token_counts, op7_sharding, op8_decontaminate, op9_simhash, op10_suffix_dedup)}
ORACLE_SQL: dict[str, str] = {"op3_topk_search": topk_search.ORACLE, "op5_warc": warc.ORACLE, "op7_sharding": sharding.ORACLE, "op8_decontaminate": decontaminate.ORACLE}
