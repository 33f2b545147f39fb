"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import ball_trees, decontam, gru_lm, kd_sharding, langid, line_dedup, minhash, mixing, quality, resampling, token_files, vp_search, warc
from .common import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_pages(_table(spark, sf_dir, "pages"), path)
    return warc.page_digests(warc.assemble(warc.read_records(spark, path, payload=False)))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).select(*quality.RESULT)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(_table(spark, sf_dir, "documents"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_files.write(_table(spark, sf_dir, "documents"), path)
    return token_files.digests(token_files.read(spark, path))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.judge_lines(_table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs.where(~F.coalesce(held_out, F.lit(False))))
    return langid.predict(docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))), model, keep=("doc_id", "held_out"))


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.document_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    index, queries = vp_search.build(vectors, 20), vectors.where("vec_id % 20 = 0")
    return vp_search.search(index, queries, 20, vp_search.tuned_factor(index, queries, 20)[0])


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_ball_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_trees.cluster(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_warc, op2_mixing, op3_quality, op4_minhash, op5_lm, op6_token_ids, op7_line_dedup, op8_langid, op9_kd_sharding, op10_decontamination, op11_vp_trees, op12_resampling, op13_ball_trees)
    return {f.__name__: f for f in found}
