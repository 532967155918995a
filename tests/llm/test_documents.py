"""Operators on documents against brute force, and their corner cases."""

import hashlib
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marquee.llm import kernels, langid, licences, mixing, ngram_join, packing, queries, repeats, sharding, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, part int, id int, w long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, ids=None, langs=None):
    ids = list(range(len(texts))) if ids is None else ids
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, "src1", None if t is None else len(t), "x", 1, 7, 3) for i, t, g in zip(ids, texts, langs, strict=True)], SCHEMA)


def odd_texts():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    base = rng.choice(words, 200).tolist()
    near = [*base]
    near[100] = "other"
    long = rng.choice(words, 20000).tolist()
    return [None, "", "  \n ", "one", "one two three", "one two three", " ".join(base), " ".join(near), " ".join(base), "\n".join(base), " ".join(long), " ".join(long[:9000]), "é à ü ß", "123 456", " ".join(base[:60] + words[:40]), " ".join(["same"] * 300), "\xa0".join(base), " ".join(base[:30])]


def jaccard_brute(texts, ids):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = WORD.findall(t or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    where = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    n, root = Counter(), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        both = Counter(j for x in sets[i] for j in where[x] if j > i)
        for j, b in both.items():
            if b >= 0.8 * (len(sets[i]) + len(sets[j]) - b) - 1e-9:
                n[i] += 1
                n[j] += 1
                a, c = sorted((find(i), find(j)))
                root[c] = a
    return {i: (find(i), n[i]) for i in ids}


def joined(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


def test_ngram_join_brute(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    assert joined(queries.op1_ngram_jaccard_join(spark, sf_dir)) == jaccard_brute([r[1] for r in rows], [r[0] for r in rows])


@pytest.mark.parametrize("block", [4096, 3])
def test_ngram_join_odd(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    texts = odd_texts()
    rng = np.random.default_rng(3)
    base = [f"v{i}" for i in rng.integers(0, 999, 150)]
    for k in range(12):
        t = [*base]
        t[int(rng.integers(150))] = f"new{k}"
        texts.append(" ".join(t))
    got = ngram_join.ngram_jaccard_join(frame(spark, [*texts, "x y z", "x y z"], [*range(len(texts)), None, None]))
    told = got.collect()
    assert sum(r["doc_id"] is None for r in told) == 2
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in told if r["doc_id"] is not None} == jaccard_brute(texts, range(len(texts)))


def test_ngram_join_empty(spark):
    assert ngram_join.ngram_jaccard_join(frame(spark, [])).collect() == []


def test_posterior_prunes_only_the_unlikely():
    least = ngram_join.least_matches(0.8)
    assert least == sorted(least) and 0 < least[0] < 13 and least[-1] < 52


def dedup_brute(rows, window=20):
    first, words = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        words[i] = WORD.findall(t or "")
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), (i, p))
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != (i, p):
                gone.update(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup_brute(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in queries.op8_substring_dedup(spark, sf_dir).collect()}
    assert got == dedup_brute(rows)


def test_substring_dedup_odd(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 500)
    texts = odd_texts()
    ids = [int(x) for x in np.random.default_rng(0).permutation(len(texts)) * 3]
    told = substring_dedup.substring_dedup(frame(spark, [*texts, texts[6]], [*ids, None])).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in told if r["doc_id"] is not None} == dedup_brute(list(zip(ids, texts, strict=True)))
    assert [r["n_removed"] for r in told if r["doc_id"] is None] == [0]
    for r in told:
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert sum(b - a for a, b in spans) == r["n_removed"] and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert substring_dedup.substring_dedup(frame(spark, [])).collect() == []
    twice = substring_dedup.substring_dedup(frame(spark, [texts[6], texts[6]], [5, 5])).collect()
    assert [r["n_removed"] for r in twice] == [dedup_brute([(5, texts[6])])[5][1]] * 2


def test_window_hashes_are_equal_for_equal_windows():
    t = pa.array(["a b c d e f a b c", "x a b c", "ab c d", None])
    data, offs = kernels.raw(t)
    s, e, rows = kernels.word_bounds(data, offs)
    h, at = kernels.window_hashes(kernels.word_hashes(data, s, e), rows, 3)
    words = WORD.findall("a b c d e f a b c x a b c ab c d")
    assert len(h) == 7 + 2 + 1
    assert {(i, j) for i in range(len(h)) for j in range(i) if h[i] == h[j]} == {(i, j) for i in range(len(h)) for j in range(i) if words[at[i] : at[i] + 3] == words[at[j] : at[j] + 3]}


def test_language_id_held_out(spark, sf_dir):
    langs = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op2_language_id(spark, sf_dir).collect()
    assert len(rows) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in out]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_odd(spark):
    texts = odd_texts()
    docs = frame(spark, texts, [None, *range(1, len(texts))], ["en", None] * (len(texts) // 2))
    model = langid.train(docs)
    rows = langid.identify(docs.withColumnRenamed("part", "score"), model).collect()
    assert len(rows) == len(texts) and len(rows[0]) == 10
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    none = langid.train(frame(spark, []))
    assert [r["lang_pred"] for r in langid.identify(frame(spark, ["some text"]), none).collect()] == ["und"]


def test_language_id_long_texts(spark, monkeypatch):
    """Texts beyond the sample's budget neither end it nor take a language out."""
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 64 * 1024)
    words = {"de": "der hund und die katze gehen nicht in das haus ".split(), "en": "the dog with a cat went through this house ".split(), "fr": "le chien avec une chatte qui va dans cette maison ".split()}
    rng = np.random.default_rng(0)
    texts, langs = [], []
    for i in range(90):
        g = ("de", "en", "fr")[i % 3]
        langs.append(g)
        texts.append(" ".join(rng.choice(words[g], 20000 if g == "fr" or i % 9 < 6 else 40)))
    docs = frame(spark, texts, langs=langs)
    model = langid.train(docs)
    assert model.languages == ["de", "en", "fr"]
    assert [r["lang_pred"] for r in sorted(langid.identify(docs, model).collect(), key=lambda r: r["doc_id"])] == langs
    assert langid.within([("a", 10), ("a", 70_000), ("b", 90_000), ("b", 80_000), ("a", 20)], [0, 1, 2, 3, 4]) == [0, 3, 4]


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark):
    texts = [*odd_texts(), *[f"t {i % 40}" for i in range(400)]]
    ids = [None, None, *range(-3, len(texts) - 5)]
    docs = frame(spark, texts, ids)
    rows = sharding.shard(docs).collect()
    keys = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("doc_id")).collect()}
    for n in (1, 16, 17, 200):
        got = docs.select("doc_id", sharding.jump_hash(F.xxhash64("doc_id"), n).alias("s")).collect()
        assert all(r["s"] == jump(keys[r["doc_id"]] & (2**64 - 1), n) for r in got)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
        assert r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
    assert set(by) <= set(range(16))
    assert all(r["shard"] == jump((r["doc_id"] or 0) & (2**64 - 1), 16) for r in rows)
    assert all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in by.values())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts, strict=True))
    assert sharding.shard(frame(spark, [])).collect() == []


def test_rake_meets_targets():
    rng = np.random.default_rng(0)
    cells = rng.integers(1, 1000, (4, 3, 5)).astype(float)
    targets = [rng.dirichlet(np.ones(n)) for n in cells.shape]
    w = mixing.rake(cells, targets)
    for axis, t in enumerate(targets):
        assert np.allclose(w.sum(tuple(a for a in range(3) if a != axis)), t, atol=1e-6)
    # odds ratios stay those of the cells
    assert np.isclose(w[0, 0, 0] * w[1, 1, 0] / (w[0, 1, 0] * w[1, 0, 0]), cells[0, 0, 0] * cells[1, 1, 0] / (cells[0, 1, 0] * cells[1, 0, 0]))
    p = mixing.probabilities(cells, w, 0.5)
    assert p.max() <= 1 and np.isclose((p * cells).sum(), 0.5 * cells.sum())


def test_mixing(spark, sf_dir):
    rows = queries.op5_source_mixing(spark, sf_dir).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(docs)
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["tokens"] == len(WORD.findall(d["text"])) and r["source_cell"] == d["source"] and r["lang_cell"] == d["lang"]
        assert 0 <= r["probability"] <= 1
    total = sum(r["tokens"] for r in rows)
    assert abs(sum(r["tokens"] * r["probability"] for r in rows) / total - mixing.SHARE) < 0.01
    odd = mixing.mix_sources(frame(spark, odd_texts(), [None, *range(1, len(odd_texts()))], [None, "xx"] * (len(odd_texts()) // 2))).collect()
    assert len(odd) == len(odd_texts()) and {r["lang_cell"] for r in odd} == {"other"}
    assert not any(r["kept"] for r in odd if r["doc_id"] is None)
    assert mixing.mix_sources(frame(spark, [])).collect() == []


def expected_marginals(rows):
    taken = sum(r["tokens"] * r["probability"] for r in rows)
    out = {k: Counter() for k in ("source", "lang", "topic")}
    for r in rows:
        for k in out:
            out[k][r[f"{k}_cell"]] += r["tokens"] * r["probability"] / taken
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_mixing_expects_the_targets(spark, hot):
    """The given tables, and a third of the rows in one source."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    if hot:
        docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").otherwise(F.col("source")))
    rows = mixing.mix_sources(docs).collect()
    for k, got in expected_marginals(rows).items():
        rest = sum(r["tokens"] for r in rows if r[f"{k}_cell"] == mixing.OTHER) / sum(r["tokens"] for r in rows)
        given = mixing.TARGETS.get(k) or dict.fromkeys({r[f"{k}_cell"] for r in rows} - {mixing.OTHER}, 1.0)
        want = {v: t / sum(given.values()) * (1 - rest) for v, t in given.items()} | {mixing.OTHER: rest}
        assert set(got) <= set(want) and all(abs(got[v] - t) < 1e-5 for v, t in want.items())
    share = sum(r["tokens"] * r["probability"] for r in rows) / sum(r["tokens"] for r in rows)
    assert abs(share - rows[0]["expected_share"]) < 1e-9 and rows[0]["target_gap"] < 1e-5
    # a source has too few tokens for the whole share: as many are taken as it allows, to a hundredth
    own = Counter()
    for r in rows:
        own[r["source_cell"]] += r["tokens"]
    least = min(own.values()) * len(own) / sum(own.values())
    assert (least < mixing.SHARE) == hot and min(least, mixing.SHARE) * 0.99 < share <= min(least, mixing.SHARE) + 1e-6


def test_probabilities_hold_full_cells():
    rng = np.random.default_rng(3)
    cells = rng.integers(1, 1000, (4, 3, 5)).astype(float)
    cells[0] *= 10
    w = mixing.rake(cells, [np.full(n, 1 / n) for n in cells.shape])
    for share in (0.1, 0.2, 0.6):
        p = mixing.probabilities(cells, w, share, np.zeros_like(cells))
        x = p * cells / (p * cells).sum()
        assert p.min() >= 0 and p.max() <= 1 and (p * cells).sum() <= share * cells.sum() * (1 + 1e-6)
        assert all(np.allclose(x.sum(tuple(a for a in range(3) if a != axis)), 1 / n, atol=1e-5) for axis, n in enumerate(cells.shape))
    # two languages in one source alone: no share has the targets, the nearest are those of the rake
    apart = np.array([[[5.0], [7.0]], [[30.0], [0.0]]])
    p = mixing.probabilities(apart, mixing.rake(apart, [np.array([0.2, 0.8]), np.array([0.5, 0.5]), np.ones(1)]), 0.5)
    assert np.isfinite(p).all() and p.max() <= 1 and p[1, 1, 0] == 0


def check_bins(rows, words, lengths):
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        if r["bin"] is not None:
            bins[r["bin_group"], r["bin"]].append(r)
        docs[r["doc_id"]].append(r)
    for b in bins.values():
        b = sorted(b, key=lambda r: r["bin_offset"])
        size = b[0]["bin_length"]
        assert [r["bin_offset"] for r in b] == [0, *np.cumsum([r["tokens"] for r in b])[:-1].tolist()]
        used = sum(r["tokens"] for r in b)
        assert used <= size == min(c for c in lengths if c >= used) and {r["bin_length"] for r in b} == {size}
    for i, n in words.items():
        own = sorted(docs[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["tokens"] for r in own) == n
        assert [r["start"] for r in own] == [k * lengths[-1] for k in range(len(own))]
        assert (own[0]["bin"] is None) == (n == 0)
    return sum(b[0]["bin_length"] for b in bins.values())


def test_packing(spark, sf_dir, monkeypatch):
    rows = queries.op6_best_fit_packing(spark, sf_dir).collect()
    words = {r[0]: len(WORD.findall(r[1])) + 1 for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    size = check_bins(rows, words, packing.LENGTHS)
    assert sum(words.values()) / size > 0.9
    monkeypatch.setattr(packing, "GROUP_TOKENS", 5000)
    texts = odd_texts()
    n = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    rows = packing.best_fit_packing(frame(spark, texts)).collect()
    check_bins(rows, {i: x + (x > 0) for i, x in n.items()}, packing.LENGTHS)
    assert len({r["bin_group"] for r in rows}) > 1
    assert packing.best_fit_packing(frame(spark, [])).collect() == []
    assert len(packing.best_fit_packing(frame(spark, ["a b", "a b", "c"], [None, None, 1])).collect()) == 3


def test_packing_is_best_fit():
    where, final = packing.pack([500, 300, 200, 12], (512, 1024))
    assert sorted(final) in ([512, 512], [1024]) and len(where) == 4
    assert packing.fill([400, 300, 200, 100], (512,), 512)[:2] == ([0, 1, 1, 0], [512, 512])


def test_licences(spark, sf_dir):
    patterns = {"GPL": "GNU General Public License", "CC-BY-NC": "CC BY-NC 4.0", "MIT": "MIT License", "Apache-2.0": "Apache License, Version 2.0", "proprietary": "ll rights reserved"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r[0]: {f for f, p in patterns.items() if p in r[1]} for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: set(filter(None, r["families"].split(","))) for r in queries.op7_licence_scan(spark, "/root/testdata/sf0.01").collect()}
    assert any(want.values()) and got == want


def test_licences_odd(spark):
    texts = [*odd_texts(), "Released under the MIT License.\nplain words here", "x\n\nLicensed under the Apache License, Version 2.0.", "Drivers need a license to work in the public domain of general version 2.0 code"]
    model = licences.train([])
    rows = sorted(licences.scan(frame(spark, texts), model).collect(), key=lambda r: r["doc_id"])
    n = len(odd_texts())
    assert [r["licence"] for r in rows[:n]] == [None] * n
    assert [r["licence"] for r in rows[n:]] == ["MIT", "Apache-2.0", None]
    assert [r["n_paragraphs"] for r in rows] == [sum(bool(re.search(r"[0-9A-Za-z\u0080-￿]", x)) for x in (t or "").split("\n")) for t in texts]
    assert licences.scan(frame(spark, []), model).collect() == []
    assert len(licences.scan(frame(spark, ["a b", "a b"], [None, None]), model).collect()) == 2


HEADERS = {
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


@pytest.mark.parametrize("width", [45, 72, 80])
def test_licences_wrapped(spark, width):
    """Headers alone, between blank lines, as comments amid code, and two in one paragraph."""
    texts, want = [], []
    for family, header in HEADERS.items():
        lines = textwrap.wrap(header, width)
        code = ["int main(void) {", "  return 0;", "}"]
        mit = ["Released under the MIT", "License."]
        for some, families in ((lines, family), (["A title", "", *lines, "", "plain words"], family), ([*code, *[f" * {x}" for x in lines], *code * 50], family), ([*mit, "some words of the text", *lines], ",".join(sorted([family, "MIT"])))):
            texts.append("\n".join(some))
            want.append(families)
    texts += ["Released under\n\nthe MIT License", "This program is free software:\nplain words of the text"]
    rows = sorted(licences.scan(frame(spark, texts), licences.train([])).collect(), key=lambda r: r["doc_id"])
    assert [r["families"] for r in rows][: len(want)] == want
    assert [r["licence"] for r in rows][len(want) :] == [None, None]
    assert rows[0]["found"][0]["line"] == 0 and rows[0]["found"][0]["lines"] > 1
    sampled = licences.sample_lines(frame(spark, texts[1:2]), "doc_id", "text")
    assert {"A title", "plain words"} <= set(sampled) and not set(sampled) & set(texts[0].split("\n")[: rows[0]["found"][0]["lines"]])


def slow_ipf(cells, targets, rounds=400):
    """Raking on a dict of cells, marginal by marginal."""
    total = sum(cells.values())
    w = {k: v / total for k, v in cells.items()}
    for _ in range(rounds):
        for axis, t in enumerate(targets):
            have = Counter()
            for k, v in w.items():
                have[k[axis]] += v
            w = {k: v * t[k[axis]] / have[k[axis]] for k, v in w.items()}
    return w


def test_mixing_weights_are_those_of_a_slow_fit(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix_sources(docs, share=0.1).collect()
    cells = Counter()
    for r in rows:
        cells[r["source_cell"], r["lang_cell"], r["topic_cell"]] += r["tokens"]
    cells = {k: v for k, v in cells.items() if v}
    total = sum(cells.values())
    targets = []
    for axis, k in enumerate(("source", "lang", "topic")):
        own = Counter()
        for c, v in cells.items():
            own[c[axis]] += v / total
        want = mixing.TARGETS.get(k) or dict.fromkeys(own, 1.0)
        there = {v: want[v] for v in own if v in want}
        rest = 1 - own.get("other", 0.0)
        targets.append({v: rest * x / sum(there.values()) for v, x in there.items()} | ({"other": own["other"]} if "other" in own else {}))
    slow = slow_ipf(cells, targets)
    for r in rows:
        c = r["source_cell"], r["lang_cell"], r["topic_cell"]
        if c in slow:
            assert np.isclose(r["weight"], slow[c] / (cells[c] / total), rtol=1e-4)
    got = expected_marginals(rows)
    for axis, k in enumerate(("source", "lang", "topic")):
        assert all(abs(got[k][v] - t) < 0.01 for v, t in targets[axis].items())
    assert all(abs(r["target_gap"]) < 0.01 for r in rows[:1])


def test_mixing_takes_topics_of_the_table(spark):
    docs = frame(spark, ["a b c d"] * 40, langs=["en", "de"] * 20).withColumn("subject", F.expr("case when doc_id % 4 < 3 then 'news' end"))
    rows = mixing.mix_sources(docs, topic_col="subject", targets={"lang": {"en": 1.0, "de": 1.0}}).collect()
    assert Counter(r["topic_cell"] for r in rows) == Counter({"news": 30, "other": 10})


def slow_fill(items, lengths, longest):
    """Best fit by looking at every open bin."""
    bins, where, rest = [], [], sum(items)
    for n in items:
        fit = [(size - used, b) for b, (size, used) in enumerate(bins) if size - used >= n]
        if fit:
            b = min(fit)[1]
        else:
            able = [c for c in lengths if c >= n]
            some = [c for c in able if c <= longest] or able[:1]
            b = len(bins)
            bins.append([min(some, key=lambda c: (packing.cost(c) / min(c, rest), c)), 0])
        bins[b][1] += n
        where.append(b)
        rest -= n
    return where, [min(c for c in lengths if c >= used) for _, used in bins]


def test_packing_is_best_fit_beside_a_slow_one():
    rng = np.random.default_rng(4)
    for _ in range(60):
        items = sorted(rng.integers(1, 65, int(rng.integers(1, 80))).tolist(), reverse=True)
        lengths = (8, 16, 32, 64)
        slow = [slow_fill(items, lengths, c) for c in lengths]
        for c, (where, final) in zip(lengths, slow, strict=True):
            assert packing.fill(items, lengths, c) == (where, final, sum(map(packing.cost, final)))
        assert sum(map(packing.cost, packing.pack(items, lengths)[1])) == min(sum(map(packing.cost, f)) for _, f in slow)


def test_language_scores_are_those_of_the_dense_kernel():
    """The product with one matrix is K(x, L) K(L, L)^(-1/2) and the ridge."""
    texts = ["der hund und die katze", "the dog and the cat", "das haus ist alt", "this house is old", "und die", "and the"]
    labels = ["de", "en"] * 3
    model = langid.fit(texts, labels)

    def kernel(a, b):
        a, b = set(langid.presence(pa.array([a]))[0].tolist()), set(langid.presence(pa.array([b]))[0].tolist())
        return len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))

    marks = [texts[i] for i in np.lexsort(([labels.index(x) for x in labels], [0, 0, 1, 1, 2, 2]))]
    gram = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(gram)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    phi = np.array([[kernel(t, m) for m in marks] for t in texts]) @ root
    target = np.where(np.array(labels)[:, None] == np.array(["de", "en"]), 1.0, -1.0)
    mean, middle = phi.mean(0), target.mean(0)
    ridge = np.linalg.solve((phi - mean).T @ (phi - mean) + langid.RIDGE * len(texts) * np.eye(len(marks)), (phi - mean).T @ (target - middle))
    new = ["die alte katze", "an old cat", "haus"]
    dense = np.array([[kernel(t, m) for m in marks] for t in new]) @ root @ ridge + middle - mean @ ridge
    z = np.exp(model.sharpness * dense - (model.sharpness * dense).max(1, keepdims=True))
    assert np.allclose(langid.scores(model, pa.array(new)), z / z.sum(1, keepdims=True), atol=1e-4)
    # n-grams of 2 to 4 bytes, each once: "die" has 4 + 3 + 2 of them with its blanks
    assert len(langid.presence(pa.array(["die"]))[0]) == 9 and len(langid.presence(pa.array(["die die"]))[0]) == 9 + 3
