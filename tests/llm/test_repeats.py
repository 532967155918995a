"""Rows that repeat an id, with equal and with different contents."""

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from marquee.llm import cover_tree, langid, mixing, ngram_join, nn_descent, packing, pipeline, substring_dedup, warc
from marquee.llm.shared import cut, tagged
from tests.llm.test_documents import WORD, check_bins, dedup_brute, frame, jaccard_brute
from tests.llm.test_vectors_pages import link_brute, pages_frame, search_brute, vectors_frame


def texts():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    x, y, z = (rng.choice(words, 120).tolist() for _ in range(3))
    near = [*x]
    near[60] = "other"
    return " ".join(x), " ".join(y), " ".join(z), " ".join(near)


def documents():
    x, y, z, near = texts()
    return [(1, x), (1, y), (2, x), (3, f"{y} more"), (1, x), (4, near), (4, z), (5, "short"), (5, x), (6, z), (6, None), (6, None), (7, ""), (1, "")]


def docs_frame(spark, rows):
    return frame(spark, [t for _, t in rows], [i for i, _ in rows])


def hashed(spark, rows):
    """A hash of the text for each row, as the operators take it."""
    return [r[0] for r in spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "k int, t string").select("k", F.xxhash64("t").alias("h")).orderBy("k").select("h").collect()]


def test_tagged(spark):
    rows = documents()
    got, repeated = tagged(docs_frame(spark, rows), "doc_id", "text")
    told = {}
    for r in got.collect():
        told.setdefault((r["doc_id"], r["tag"]), set()).add(r["text"])
    assert repeated and len(told) == len(set(rows)) and all(len(v) == 1 for v in told.values())
    assert {t for (i, t) in told if i in (2, 3, 7)} == {0}
    got, repeated = tagged(docs_frame(spark, [(1, "a"), (2, "a"), (None, "a"), (None, "b")]), "doc_id", "text")
    assert not repeated and sorted(r["tag"] == 0 for r in got.collect()) == [False, False, True, True]


def test_ngram_join(spark):
    rows = documents()
    brute = jaccard_brute([t for _, t in rows], range(len(rows)))
    groups = {}
    for k, (root, _) in brute.items():
        groups.setdefault(root, []).append(rows[k][0])
    want = sorted((rows[k][0], min(groups[root]), n) for k, (root, n) in brute.items())
    got = ngram_join.ngram_jaccard_join(docs_frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want


def test_substring_dedup(spark):
    rows = documents()
    tags = hashed(spark, rows)
    distinct = sorted({(i, h, t) for (i, t), h in zip(rows, tags, strict=True)}, key=lambda r: r[:2])
    brute = dedup_brute([(k, t) for k, (_, _, t) in enumerate(distinct)])
    told = {(i, t): brute[k] for k, (i, _, t) in enumerate(distinct)}
    got = substring_dedup.substring_dedup(docs_frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted((i, *told[i, t]) for i, t in rows)
    long = substring_dedup.substring_dedup(docs_frame(spark, [(1, texts()[0]), (2, texts()[0]), (2, "two words")])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in long) == [(1, 0), (2, 0), (2, 120)]


def vectors():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 64)).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    near = [(base[k % 5] + rng.normal(size=64) * 0.02).astype(np.float32).astype(float).tolist() for k in range(10)]
    return rows + [(0, base[7].tolist()), (0, base[0].tolist()), (3, near[0]), (3, near[1]), *[(100 + k % 3, v) for k, v in enumerate(near)], (100, None), (0, [0.0] * 64)]


def test_embedding_dedup(spark):
    rows = vectors()
    brute = link_brute([(k, v) for k, (_, v) in enumerate(rows)])
    names = {}
    for k, (_, root, _) in brute.items():
        names[root] = min(rows[k][0], names.get(root, rows[k][0]))
    want = sorted((rows[k][0], n, names[root], rows[k][0] == names[root]) for k, (n, root, _) in brute.items())
    got = cover_tree.embedding_dedup(vectors_frame(spark, rows)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == want


def test_nearest_neighbours(spark):
    rows = vectors()
    ids = [i for i, _ in rows]
    want = {}
    for k, found in search_brute([(k, v) for k, (_, v) in enumerate(rows)], lambda k: ids[k] % 100 == 0, len(rows)).items():
        best = want.setdefault(ids[k], {})
        for other, d in found:
            if ids[other] != ids[k]:
                best[ids[other]] = min(d, best.get(ids[other], np.inf))
    got = {}
    for r in nn_descent.nearest_neighbours(vectors_frame(spark, rows), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want) == {0, 100}
    for q, found in got.items():
        best = sorted(want[q].items(), key=lambda x: (x[1], x[0]))[:10]
        assert [(f[0], f[1]) for f in found] == [(k + 1, b[0]) for k, b in enumerate(best)]
        assert np.allclose([f[2] for f in found], [b[1] for b in best])


def test_warc(spark):
    a, b = "a" * 150, "b" * 150
    rows = [(5, "u", a), (7, "u", a), (7, "u", b), (7, "u", "small"), (8, "u", b), (8, "u", b), (5, "u", a)]
    got = warc.read(spark, warc.write(pages_frame(spark, rows))).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(5, sha(a), "response", None)] * 2 + [(7, sha(a), "revisit", 5), (7, sha(b), "response", None), (7, sha("small"), "response", None)] + [(8, sha(b), "revisit", 7)] * 2
    assert sorted(((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
    assert {sha(bytes(r["payload"]).decode()) for r in got if r["payload"] is not None} == {sha(a), sha(b), sha("small")}


def test_packing_and_mixing(spark):
    rows = [(None, f"{'w ' * (i % 50)}end") for i in range(500)] + [(1, "one two")] * 300
    docs = docs_frame(spark, rows)
    out = packing.best_fit_packing(docs)
    assert out.count() == len(rows) and out.where("bin_offset + tokens > bin_length").isEmpty()
    told = mixing.mix_sources(docs).collect()
    assert len(told) == len(rows) and len({r["kept"] for r in told if r["doc_id"] is None}) == 2
    assert Counter(r["kept"] for r in told if r["doc_id"] == 1).most_common(1)[0][1] == 300


def test_langid_sample(spark):
    rows = [(1, "der hund und die katze"), (1, "the dog and the cat"), (2, "der baum"), (2, "der baum"), (3, "the tree")]
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows], ["de", "en", "de", "de", "en"])
    model = langid.train(docs)
    assert model.languages == ["de", "en"]
    assert sorted(r["lang_pred"] for r in langid.identify(docs, model).collect()) == ["de"] * 3 + ["en"] * 2


def test_langid_languages_bound(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    docs = frame(spark, ["eins zwei", "drei vier", "one two", "three four", "un deux"], langs=["de", "de", "en", "en", "fr"])
    assert langid.train(docs).languages == ["de", "en"]


def test_stages(spark):
    x, y, z, near = texts()
    rows = [(1, x), (1, x), (1, y), (2, near), (3, z), (3, z), (None, x), (None, x), (4, "two words"), (4, z + " and a tail of some more words")]
    docs = docs_frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    stages = dict(pipeline.STAGES)
    near_out = cut(stages["ngram_jaccard_join"](spark, docs, ""), "near")
    assert near_out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in near_out.collect()) == Counter([(1, x), (1, y), (3, z), (None, x), (None, x), (4, "two words")])
    passages = cut(stages["substring_dedup"](spark, docs, ""), "passages").collect()
    brute = {(r["doc_id"], r["n_words"]): r["kept_text"] for r in substring_dedup.substring_dedup(docs).collect()}
    assert Counter(r["text"] for r in passages if r["doc_id"] == 4) == Counter(["two words", brute[4, 127]])
    told = mixing.mix_sources(docs).where("kept").collect()
    mixed = cut(stages["source_mixing"](spark, docs, ""), "mixed")
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(r["doc_id"] for r in told)
    packed = cut(stages["best_fit_packing"](spark, docs, ""), "packed").collect()
    assert sum(r["tokens"] for r in packed) == sum(len(WORD.findall(t)) + 1 for _, t in rows)
    unique = docs_frame(spark, list(enumerate(t for _, t in rows)))
    check_bins(packing.best_fit_packing(unique).collect(), {k: len(WORD.findall(t)) + 1 for k, (_, t) in enumerate(rows)}, packing.LENGTHS)
    kept = stages["language_id"](spark, docs, "")
    assert kept.columns == docs.columns and kept.count() <= len(rows)
