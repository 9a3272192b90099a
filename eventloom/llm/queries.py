"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from eventloom.llm import ann, chat, fim, jaccard, media, merkle, mixing, packing, quality, secrets, tokenfile, vafile, wrappers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op2_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_documents(tokenfile.written_segments(table(spark, sf_dir, "documents")))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    features = media.media_features(media.stored_media(docs))
    return media.resolved(media.interleaved(media.pages_of(docs)), features).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption"
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan(table(spark, sf_dir, "documents")))


def op10_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.linked_conversations(table(spark, sf_dir, "conversations"))
    return found.withColumn("errors", F.array_join("errors", ", "))


def op4_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_components(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_vector_approximation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_proofs(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_projected_neighbours,
        op2_range_coded_ids,
        op3_mix_sources,
        op4_wrapper_induction,
        op5_best_fit_packing,
        op6_attention_quality,
        op7_ngram_jaccard_join,
        op8_media_columns,
        op9_secret_scan,
        op10_tool_links,
        op11_fill_in_middle,
        op12_vector_approximation,
        op13_merkle_manifest,
    )
}
ORACLE_SQL = {"op3_mix_sources": mixing.SQL, "op10_tool_links": chat.SQL, "op11_fill_in_middle": fim.SQL, "op12_vector_approximation": vafile.SQL, "op13_merkle_manifest": merkle.SQL}
