"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.llm import ann, bpe, compaction, decontaminate, html_text, jaccard, language, license_scan, prefix_trie, substrings, token_counts, token_files, vector_codes
from quartzite.llm.common import fresh, table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary())
    return token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op8_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, docs = compaction.ShardStore(spark, fresh(spark, "shards")), table(spark, sf_dir, "documents")
    compaction.append_arrivals(store, docs, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(16)))
    return store.read(like=docs.withColumn("arrival", F.lit(0))).select("doc_id", "arrival", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP8_SQL = """
SELECT doc_id, CAST(coalesce(doc_id, 0) % 16 AS INTEGER) AS arrival, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents
"""


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_suffix_dedup, op3_token_counts, op4_jaccard_join, op5_language, op6_token_files, op7_nearest, op8_compaction, op9_html_text, op10_bpe, op11_license_scan, op12_prefix_trie, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontaminate.ORACLE_SQL, "op2_suffix_dedup": substrings.ORACLE_SQL, "op4_jaccard_join": jaccard.ORACLE_SQL, "op8_compaction": OP8_SQL, "op11_license_scan": license_scan.ORACLE_SQL, "op12_prefix_trie": prefix_trie.ORACLE_SQL, "op13_vector_codes": vector_codes.ORACLE_SQL}
