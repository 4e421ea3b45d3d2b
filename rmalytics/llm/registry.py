"""Registered queries of the package, with their parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rmalytics.llm import oracle
from rmalytics.llm.exact_dedup import exact_dedup
from rmalytics.llm.fill_in_middle import fill_in_middle, restored
from rmalytics.llm.hard_negatives import hard_negatives
from rmalytics.llm.jaccard_join import jaccard_components
from rmalytics.llm.piece_tokens import piece_tokens
from rmalytics.llm.pseudonyms import pseudonyms
from rmalytics.llm.quality_rules import quality_rules
from rmalytics.llm.sharding import shard_rows
from rmalytics.llm.source_mixing import mix_sources
from rmalytics.llm.token_binary import ids_crc32, token_binary
from rmalytics.llm.token_counts import token_counts
from rmalytics.llm.topk_search import top_k
from rmalytics.llm.warc_bundles import warc_bundles

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
END_ID = 2
#: of the registered query; users give a secret of their own
PSEUDONYM_KEY = b"registered query"


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms(_read(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(spark, _read(spark, sf_dir, "documents"), F.array("source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, _read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, _read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_bundles(spark, _read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_crc32(token_binary(spark, _read(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), end_id=END_ID))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(spark, _read(spark, sf_dir, "documents"))


def op10_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_tokens(_read(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, _read(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(_read(spark, sf_dir, "documents"))
    whole = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark, _read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=moved)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pseudonyms": op1_pseudonyms,
    "op2_source_mixing": op2_source_mixing,
    "op3_topk_search": op3_topk_search,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc_bundles": op6_warc_bundles,
    "op7_token_counts": op7_token_counts,
    "op8_token_binary": op8_token_binary,
    "op9_sharding": op9_sharding,
    "op10_piece_tokens": op10_piece_tokens,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE: dict[str, str] = {
    "op3_topk_search": oracle.TOP_K,
    "op5_quality_rules": oracle.QUALITY,
    "op6_warc_bundles": oracle.WARC,
    "op11_exact_dedup": oracle.EXACT,
    "op12_fill_in_middle": oracle.MIDDLE,
    "op13_hard_negatives": oracle.NEGATIVES,
}
