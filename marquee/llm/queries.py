"""The registered queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import collocations, cover_tree, langid, licences, line_dedup, mixing, ngram_join, nn_descent, packing, periodic, sharding, substring_dedup, warc
from marquee.llm.pipeline import run
from marquee.llm.shared import removed, settled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "op1", lambda: ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents")).drop("tag", "kept"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(docs, where=~F.col("held_out"))
    return langid.identify(docs, model, carry=["doc_id", "held_out"])


def op3_jump_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "op3", lambda: sharding.shard(table(spark, sf_dir, "documents"), shards=16))


def op4_cover_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "op4", lambda: cover_tree.embedding_dedup(table(spark, sf_dir, "embeddings")))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "op5", lambda: mixing.mix_sources(table(spark, sf_dir, "documents")).drop("tag"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "op6", lambda: packing.best_fit_packing(table(spark, sf_dir, "documents")))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).drop("found")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "op8", lambda: substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256"))


def op9_nn_descent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "op9", lambda: nn_descent.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0))


def op10_warc_dictionary_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    def told() -> DataFrame:
        folders.append(warc.write(table(spark, sf_dir, "pages")))
        return warc.read(spark, folders[0]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

    folders: list[str] = []
    try:
        return settled(spark, "op10", told)
    finally:  # the result is a table by now
        for folder in folders:
            removed(spark, folder)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "op11", lambda: collocations.collocations(table(spark, sf_dir, "documents")))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "op12", lambda: line_dedup.line_dedup(table(spark, sf_dir, "documents")).drop("kept_text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"), plant=True).drop("runs", "collapsed_text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_ngram_jaccard_join, op2_language_id, op3_jump_hash_sharding, op4_cover_tree_dedup, op5_source_mixing, op6_best_fit_packing, op7_licence_scan, op8_substring_dedup, op9_nn_descent_search, op10_warc_dictionary_archive, op11_phrase_collocations, op12_line_dedup, op13_periodic_runs, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from marquee.llm.oracle import SQL

    return SQL
