"""Driver queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import chat, decontaminate, divergence, language, minhash, mixing, pseudonyms, quality, repeats, resampling, simhash, sstable, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


@query
def op6_substring_dedup(spark, sf_dir):
    found = repeats.remove_repeats(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op2_quality_rules(spark, sf_dir):
    return quality.judge(spark, table(spark, sf_dir, "documents")).drop("rejected_by")


ORACLE_SQL["op2_quality_rules"] = quality.SQL


@query
def op4_url_filters(spark, sf_dir):
    return urls.judge(spark, table(spark, sf_dir, "pages"), urls.RULES)


ORACLE_SQL["op4_url_filters"] = urls.SQL


@query
def op5_benchmark_decontamination(spark, sf_dir):
    return decontaminate.matches(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op5_benchmark_decontamination"] = decontaminate.SQL


@query
def op7_source_mixing(spark, sf_dir):
    mixed = mixing.mix(spark, table(spark, sf_dir, "documents"))
    taken = (F.col("mix_size") * F.col("mix_copies")).alias("taken")
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken)


@query
def op9_token_tables(spark, sf_dir):
    return tokens(spark, table(spark, sf_dir, "documents"))


def tokens(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the shards and digests what is read back from them."""
    import public_tokenizers

    folder = sstable.Scratch(spark, "tokens").path("shards")
    found = sstable.read(spark, sstable.write(spark, docs, folder, tokenizer or public_tokenizers.path("byte_bpe_50k.json")))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op1_language_id(spark, sf_dir):
    return language.identify(spark, table(spark, sf_dir, "documents"))


#: Stands in for a secret that a real run passes in.
PSEUDONYM_KEY = "lorespark-example-key"


@query
def op8_pii_pseudonyms(spark, sf_dir):
    found = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return found.select("doc_id", "text", F.size("pii").cast("long").alias("n_replaced"))


@query
def op13_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


@query
def op11_source_divergence(spark, sf_dir):
    return divergence.audit(spark, table(spark, sf_dir, "documents"))


ORACLE_SQL["op11_source_divergence"] = divergence.SQL


@query
def op12_importance_resampling(spark, sf_dir):
    return resampling.resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op12_importance_resampling"] = resampling.SQL


@query
def op3_chat_formatting(spark, sf_dir):
    return chat.link(spark, chat.with_tools(table(spark, sf_dir, "conversations")))


ORACLE_SQL["op3_chat_formatting"] = chat.SQL
