"""The pipeline's stages against brute force on their own inputs."""

from pyspark.sql import functions as F

from marquee.llm import mixing, packing
from marquee.llm import pipeline as cp
from tests.llm.test_documents import WORD, check_bins, dedup_brute, frame, jaccard_brute, odd_texts


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES:
        before = rows_of(docs)
        out = cp.cut(stage(spark, docs, sf_dir), name)
        if name != "best_fit_packing":
            assert out.columns == columns
        if name == "language_id":
            assert rows_of(out) and len(rows_of(out)) >= 0.99 * len(before)
        if name == "ngram_jaccard_join":
            want = jaccard_brute([r[1] for r in before], [r[0] for r in before])
            assert {r[0] for r in rows_of(out)} == {i for i, (c, _) in want.items() if i == c}
        if name == "substring_dedup":
            want, old = dedup_brute(before), dict(before)
            assert {r[0] for r in rows_of(out)} == {i for i, (n, gone, _) in want.items() if not n or gone < n}
            for i, t in rows_of(out):
                assert t == old[i] if not want[i][1] else len(t.split(" ")) == want[i][0] - want[i][1]
        if name == "source_mixing":
            kept = {r["doc_id"] for r in mixing.mix_sources(docs).where("kept").collect()}
            assert {r[0] for r in rows_of(out)} == kept and kept < {r[0] for r in before}
        if name == "best_fit_packing":
            check_bins(out.collect(), {i: len(WORD.findall(t)) + 1 for i, t in before}, packing.LENGTHS)
        docs = out


def test_odd_documents_pass(spark):
    docs = frame(spark, odd_texts()).select("doc_id", "text", "lang", "source", "n_chars", "key", F.lit(1).alias("score"), F.lit("x").alias("gone"), F.lit(2).alias("kid"))
    for _, stage in cp.STAGES:
        docs = cp.cut(stage(spark, docs, ""), "odd")
    assert docs.count() > 0


def test_the_driver_finds_the_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert corpus_pipeline.STAGES == cp.STAGES and corpus_pipeline.run is cp.run and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
