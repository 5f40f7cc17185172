"""The queries of this subpackage: ``queries()`` and, where DuckDB can say the same, ``oracle_sql()``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import bpe, chat, html, langid, minhash, mixing, multiindex, ngram, phrases, projections, segments, spelling, warc
from panelwright.llm.base import small_batches

#: The vocabulary of op8, a parameter of its operator.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in ("documents", "pages"):
        small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_and_read(table(spark, sf_dir, "pages"), with_payload=False)
    return found.select(F.col("capture_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    control = f"{chat.END}{chat.START}assistant ok"
    rows = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"))
    extra = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.lit(control).alias("text"))
    return chat.digests(turns.union(extra))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages").select("page_id", "html"))
    return found.select("page_id", F.char_length("text").cast("long").alias("n_chars"), "text")


def op4_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mixing.replicate(docs)


def op6_trie_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score_documents(table(spark, sf_dir, "documents"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_multi_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_suffix_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc_index, op2_chat_windows, op3_html_text, op4_segment_topk, op5_poisson_mixing, op6_trie_scoring, op7_minhash_dedup, op8_bpe_codec, op9_multi_index_dedup, op10_language_id, op11_suffix_sigma, op12_projected_neighbours, op13_spelling_variants)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_index": warc.oracle(), "op2_chat_windows": chat.oracle(), "op4_segment_topk": segments.oracle(), "op5_poisson_mixing": mixing.oracle(), "op7_minhash_dedup": minhash.oracle(), "op9_multi_index_dedup": multiindex.oracle(), "op11_suffix_sigma": phrases.oracle(), "op13_spelling_variants": spelling.oracle()}
