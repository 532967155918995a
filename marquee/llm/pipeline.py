"""From raw documents to packed training sequences.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the docs of
the next. All but the last return the columns of ``documents``.

Rows that repeat a document's id and text are one document from the second
stage on; rows of one id with different texts, and rows with a null id, are
documents of their own in every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import langid, mixing, ngram_join, packing, substring_dedup
from marquee.llm.shared import cut, settled, tagged
from marquee.operators.relational import first_wins

#: Documents whose language is less certain than this are rejected.
LEAST_SCORE = 0.4


def named(docs: DataFrame, *contents: str) -> tuple[DataFrame, bool]:
    """The documents as ``doc``, and their names ``doc_id`` and ``tag``."""
    held = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), docs["doc_id"].cast("long").alias("doc_id"), *[docs[c].cast("string").alias(c) for c in contents])
    rows, repeated = tagged(held, "doc_id", *contents)
    return rows.select("doc", "doc_id", "tag"), repeated


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the languages of the labels; rejects those
    without a letter and those that no language is likely for."""
    model = langid.train(docs, where=~langid.held_out(F.col("doc_id")))
    told = langid.identify(docs, model, pred="__lang", score="__score")
    return told.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= LEAST_SCORE)).drop("__lang", "__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays,
    and of rows that repeat it one. Rows with a null id take no part and stay."""
    gone = settled(spark, "gone", lambda: ngram_join.ngram_jaccard_join(docs).where("not kept").select(F.col("doc_id").alias("gone"), F.col("tag").alias("gone_tag")).distinct())
    rows, repeated = named(docs, "text")
    rows = rows.join(gone, (rows["doc_id"] == gone["gone"]) & (rows["tag"] == gone["gone_tag"]), "left_anti")
    if repeated:
        once = first_wins(rows.where("doc_id is not null"), ["doc_id", "tag"], [F.to_json("doc")])
        rows = once.unionByName(rows.where("doc_id is null"))
    return rows.select("doc.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 20-word windows go. A text that loses words becomes its kept
    words joined by blanks; a document that loses all goes."""
    rows = substring_dedup.substring_dedup(docs, carry=docs.columns).where("n_removed = 0 or n_removed < n_words")
    whole = F.col("n_removed") == 0
    return rows.select(
        "doc_id",
        F.when(whole, F.col("carried.text")).otherwise(F.col("kept_text")).alias("text"),
        "carried.lang",
        "carried.source",
        F.when(whole, F.col("carried.n_chars")).otherwise(F.length("kept_text").cast("long")).alias("n_chars"),
    )


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples the documents so that sources, languages and topics meet their
    target shares of tokens. Each document is judged by its own cell, also where
    its id is null or repeats."""
    kept = mixing.mix_sources(docs).where("kept").select(F.col("doc_id").cast("long").alias("kid"), F.col("tag").alias("ktag"))
    rows, _ = named(docs, "text", "source", "lang")
    return rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kid")) & (F.col("tag") == F.col("ktag")), "left_semi").select("doc.*")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; documents
    without a word have one piece of no tokens, without a sequence."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mixing", mixed_sources),
    ("best_fit_packing", packed_sequences),
]
#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; only the last one's table stays."""

    def packed() -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in STAGES:
            docs = settled(spark, name, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        return docs

    return settled(spark, "pipeline", packed)
