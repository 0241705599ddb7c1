"""The llm queries by name, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from waystone.llm import alignment, contextual, counts, language, order_minhash, packing, periodic, quality, replay, secret_scan, spotsigs, topk, wavelet
from waystone.llm.shared import shared_dir, table


#: Vocabulary files by name: each worker finds them in its own place of the public files.
BYTE_BPE, MULTI_BPE, WORD_BPE, PIECE_BPE = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_wavelet_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    wavelet.write_shards(table(spark, sf_dir, "documents"), path, BYTE_BPE)
    return wavelet.read_documents(spark, path)


def op6_merge_replay_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.encode_documents(table(spark, sf_dir, "documents"), MULTI_BPE)


def op7_lsa_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_classes(table(spark, sf_dir, "documents"))


def op3_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op4_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_report(table(spark, sf_dir, "documents"))


def op10_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), WORD_BPE)


def op11_basic_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents")).drop("runs")


def op12_fragment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def op13_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contextual.report(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_wavelet_token_ids, op2_order_minhash, op3_byte_cnn_language, op4_segment_top_k, op5_randomness_secrets,
    op6_merge_replay_bpe, op7_lsa_quality_votes, op8_histogram_packing, op9_spotsigs, op10_pretoken_counts,
    op11_basic_factors, op12_fragment_alignment, op13_bootstrapped_pii,
)
QUERIES = {f.__name__: f for f in OPERATORS}
SQL: dict[str, str] = {
    "op4_segment_top_k": """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v
    from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
    select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
    from v q join v c on q.vec_id <> c.vec_id
    where q.vec_id % 20 = 0
), ranked as (
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
    from pairs
)
select query_id, rank, vec_id, score from ranked where rank <= 20
""",
}
