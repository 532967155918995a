"""Collocations, line dedup and periodic runs against brute force, and their
corner cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marquee.llm import collocations, licences, line_dedup, nn_descent, periodic, queries, repeats, sharding, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, part int, id int, tag long, phrase string, n long"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """rows: (doc_id, text, lang)"""
    return spark.createDataFrame([(i, t, g, "s", 1, "k", 1, 2, 3, "p", 4) for i, t, g in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def collocation_brute(rows, least, top, share=80):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in some.items():
            score, cut = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in some.items())
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), " ".join(p), c[p[:cut]], c[p[cut:]]))
        out += [(lang, r, p, -a, x, y, n[lang], -s) for r, (s, a, _, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def words(rng, n, vocabulary):
    return [f"w{int(x)}" for x in rng.zipf(1.4, n) % vocabulary]


@pytest.mark.parametrize("bits", [9, 29])
def test_collocations(spark, monkeypatch, bits):
    """Also with a sketch of so few cells that nearly every phrase passes it."""
    monkeypatch.setattr(collocations, "LEAST_BITS", 9)
    monkeypatch.setattr(collocations, "MOST_BITS", bits)
    rng = np.random.default_rng(5)
    signs = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "\x0c", "! ", "?", ";x:", "\xa0"]
    rows = [(1, None, "en"), (2, "", "en"), (3, " \t. ,\n", None), (4, "Only", None), (5, "É ÀB ab. éé", "fr")]
    for i in range(40):
        w = words(rng, 60, 40)
        at = rng.choice(len(signs), 60, p=[0.7] + [0.3 / 12] * 12)
        rows.append((i, "".join(x.upper() + signs[k] if k % 3 else x + signs[k] for x, k in zip(w, at, strict=True)), [None, "en", "und", "de"][i % 4]))
    rows += [(7, "New York City hall", "en")] * 12 + [(8, "a a a a a a a a", "es")] * 3
    for least, top in ((8, 2000), (3, 5)):
        got = collocations.collocations(frame(spark, rows), least=least, top=top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == collocation_brute(rows, least, top)
    assert collocations.collocations(frame(spark, [])).collect() == []


def test_collocation_score_is_exact(spark):
    """2000000 * a passes 64 bits."""
    import pyspark.sql.functions as F

    a, total = 9_000_000_000_000_000_001, 9_100_000_000_000_000_007
    score = F.expr("cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0)) div cast(t as decimal(20,0))")
    assert spark.createDataFrame([(a, total)], "a long, t long").select(score.alias("s")).first()["s"] == 2_000_000 * a // total


def line_brute(rows, shortest=10):
    docs = {}
    for i, text, _ in rows:
        docs[(i, text)] = (text or "").split("\n")
    holders = defaultdict(set)
    key = {}
    for d, lines in docs.items():
        for x in lines:
            key[x] = lower(x.strip(" \t\n\x0b\x0c\r"))
            if d[0] is not None:
                holders[key[x]].add(d)
    out = {}
    for d, lines in docs.items():
        gone = [d[0] is not None and len(key[x]) >= shortest and len(holders[key[x]]) > 1 and min(holders[key[x]], key=lambda h: h[0]) != d for x in lines]
        out[d[0], d[1]] = (len(lines), sum(gone), sha("\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("piece", [8 << 20, 1])
def test_line_dedup(spark, monkeypatch, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    rng = np.random.default_rng(2)
    pool = [" ".join(words(rng, int(rng.integers(0, 6)), 9)) for _ in range(60)] + ["", "  ", "\x0b", "Ein langer Satz", " ein LANGER satz\t", "ééééééééé", "éééééééééé", "\xa0\xa0abcdefgh\xa0", "123456789", "1234567890"]
    rows = [(None, "1234567890\nein langer satz", "en"), (0, None, "en"), (1, "", "en"), (2, "\n", "en"), (3, "\n\n1234567890\n", None)]
    rows += [(10 + i, "\n".join(rng.choice(pool, int(rng.integers(1, 25)))), "en") for i in range(60)]
    rows += [(10, rows[5][1], "fr"), (200, rows[7][1], "de"), (201, "\n".join(["Ein langer Satz"] * 3000), "de")]
    got = line_dedup.line_dedup(frame(spark, rows))
    want = line_brute(rows)
    told = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got.collect()), key=repr)
    assert told == sorted(((i, *want[i, t]) for i, t, _ in rows), key=repr)
    assert line_dedup.line_dedup(frame(spark, [])).collect() == []


def test_line_dedup_ids_that_repeat(spark):
    rows = [(5, "a shared line\nb", "en"), (5, "a shared line\nc", "en"), (6, "a shared line", "en"), (6, "a shared line", "en")]
    got = sorted((r["doc_id"], r["n_dropped"]) for r in line_dedup.line_dedup(frame(spark, rows)).collect())
    assert got == [(5, 0), (5, 1), (6, 1), (6, 1)]


def test_bitmaps():
    for dropped in ([0], [7], [8], [3, 9, 800]):
        keep = line_dedup.kept_lines(line_dedup.bitmap(np.array(dropped)), 1000)
        assert np.flatnonzero(~keep).tolist() == dropped


def runs_brute(w, shortest=24, copies=3):
    found = {}
    for p in range(1, len(w) // copies + 1):
        s = None
        for i in range(len(w) - p + 1):
            same = i + p < len(w) and w[i] == w[i + p]
            if same and s is None:
                s = i
            if not same and s is not None:
                if i - s + p >= max(shortest, copies * p):
                    found.setdefault((s, i - s + p), p)
                s = None
    return sorted((s, n, p) for (s, n), p in found.items())


def periodic_brute(i, text, plant):
    w = BLANK.findall(text or "")
    n = len(w)
    if plant and i is not None and n:
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    runs = sorted(runs_brute(w), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    left = [x for k, x in enumerate(w) if not any(s + q <= k < s + m for s, m, q in runs)]
    return (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(left)))


def test_runs_of_texts_with_many_pairs(monkeypatch):
    """Those get suffix arrays of their own."""
    monkeypatch.setattr(periodic, "PAIRS", 40)
    rng = np.random.default_rng(6)
    for _ in range(60):
        w = rng.integers(0, int(rng.integers(1, 3)), int(rng.integers(30, 200)))
        rows = np.array([0, 0, len(w) // 3, len(w), len(w)])
        text, start, end, p = periodic.runs(w, rows, 6, 3)
        for k in range(4):
            own = text == k
            got = sorted(zip(start[own].tolist(), (end - start)[own].tolist(), p[own].tolist(), strict=True))
            assert got == runs_brute(w[rows[k] : rows[k + 1]].tolist(), 6, 3)


def test_periodic_runs(spark):
    rng = np.random.default_rng(4)
    texts = [None, "", " \n", "one", "x " * 23, "x " * 24, "x\x0b" * 300, "a b " * 40 + "a", "a b a b c " * 9]
    for _ in range(120):
        n = int(rng.integers(1, 150))
        w = words(rng, n, int(rng.integers(1, 6)))
        a, p = int(rng.integers(0, n)), int(rng.integers(1, 20))
        texts.append(" ".join(w[:a] + (w[a:] * 150)[:p] * int(rng.integers(1, 9)) + w[: a // 2]))
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "y " * 50, "en"), (7, texts[7], "en")]
    for plant in (False, True):
        got = periodic.periodic_runs(frame(spark, rows), plant=plant)
        told = sorted([tuple(r)[:8] for r in got.collect()], key=repr)
        assert told == sorted([(i, *periodic_brute(i, t, plant)) for i, t, _ in rows], key=repr)
    assert periodic.periodic_runs(frame(spark, [])).collect() == []


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for n in [1, 2, 3, *rng.integers(4, 200, 40)]:
        w = rng.integers(0, int(rng.integers(1, 6)), n)
        place, rank, common = periodic.suffix_array(w)
        x = w.tolist()
        assert place.tolist() == sorted(range(n), key=lambda i: x[i:])
        least = periodic.Minima(common)
        for a, b in rng.integers(0, n, (20, 2)):
            a, b = min(a, b), max(a, b)
            assert least(np.array([a]), np.array([b]))[0] == common[a : b + 1].min()


def test_windows_have_two_hashes():
    from marquee.llm.substring_dedup import windows

    hi, lo, doc, pos = windows(3)(pa.array(["a b c d", None, "a b c"]))
    assert doc.tolist() == [0, 0, 2] and pos.tolist() == [0, 1, 0]
    assert hi[0] == hi[2] and lo[0] == lo[2] and len({*hi.tolist(), *lo.tolist()}) == 4
    # keys that share their first 64 bits are told apart by the others
    same = np.array([9, 9, 9], np.uint64)
    ids, tags, at = np.array([1, 2, 3]), np.zeros(3, np.int64), np.zeros(3, np.int32)
    assert repeats.again(same, np.array([5, 6, 5], np.uint64), ids, tags, at, True).tolist() == [2]


def test_registered(spark, sf_dir):
    for name in ("op11_phrase_collocations", "op12_line_dedup", "op13_periodic_runs"):
        assert name in queries.queries() and name in queries.oracle_sql()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    few = docs[:40] + [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 10 == 0]
    assert all(got[d["doc_id"]] == periodic_brute(d["doc_id"], d["text"], True) for d in few)


def test_slices_round_trip():
    from marquee.llm.substring_dedup import windows

    texts = pa.array([" ".join(f"w{i}" for i in range(k, k + 40)) for k in range(0, 300, 25)])
    ids = pa.array(np.arange(len(texts)) * 7)
    batch = pa.record_batch([ids, pa.array(np.zeros(len(texts), np.int64)), texts], names=["id", "tag", "text"])
    (out,) = repeats.slices(windows(20), 8, 8 << 20, False)(iter([batch]))
    told = set()
    for r in range(out.num_rows):
        if out.column("keys")[r].as_buffer().size:
            hi, lo, i, t, pos = repeats.opened(out.column("keys")[r].as_buffer(), out.column("rest")[r].as_buffer(), repeats.width(8))
            part = np.uint64(out.column("part")[r].as_py()) << np.uint64(56)
            told |= set(zip((hi | part).tolist(), lo.tolist(), i.tolist(), pos.tolist(), strict=True))
    hi, lo, doc, pos = windows(20)(texts)
    first = {}
    for h, x, d, p in zip(hi.tolist(), lo.tolist(), doc.tolist(), pos.tolist(), strict=True):
        first.setdefault(h, (h, x & 0xFFFFFFFF, 7 * d, p))
    assert told == set(first.values())


def recall_of(graph, x, k):
    hit = total = 0
    ids = sorted(x)
    m = np.stack([x[i] for i in ids])
    for r in graph.collect():
        d = ((m - x[r["id"]]) ** 2).sum(1)
        true = [ids[p] for p in np.argsort(d, kind="stable") if ids[p] != r["id"]][:k]
        hit += len(set(true) & set(np.frombuffer(r["ids"], np.int64)[:k].tolist()))
        total += len(true)
    return hit / total


def test_descent_makes_the_graph(spark):
    """The graph starts poor; the rounds find the neighbours."""
    rng = np.random.default_rng(8)
    x = {i: v for i, v in enumerate(rng.normal(size=(3000, 24)))}
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "id long, x array<double>")
    assert recall_of(nn_descent.first_graph(nodes), x, 10) < 0.5
    assert recall_of(nn_descent.neighbour_graph(nodes), x, 10) > 0.9


def test_what_parts_tell_each_other_is_packed(spark, monkeypatch):
    """A row for each pair of parts, not one for each node or link."""
    written, cut = [], nn_descent.cut
    monkeypatch.setattr(nn_descent, "cut", lambda df, name: written.append((name, cut(df, name))) or written[-1][1])
    monkeypatch.setattr(nn_descent, "PART", 100, raising=False)
    x = {i: v for i, v in enumerate(np.random.default_rng(5).normal(size=(900, 16)))}
    graph = nn_descent.neighbour_graph(spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "id long, x array<double>"))
    assert recall_of(graph, x, 10) > 0.9
    rounds = [df.count() for name, df in written if name == "graph"][1:]  # without the first graph
    assert rounds and max(rounds) <= 9 + 9 * 9


def test_few_ids_of_many_vectors(spark):
    """More vectors of the nearest ids than a beam holds: the others are found
    all the same."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 8)) * 50
    rows = [(i, (centres[i] + rng.normal(size=8)).tolist()) for i in range(20) for _ in range(120)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in nn_descent.nearest_neighbours(df, F.col("vec_id") < 3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in range(3):
        own = np.array([v for i, v in rows if i == q])
        d = {i: min(np.sqrt(((own - np.array(v)) ** 2).sum(1)).min() for j, v in rows if j == i) for i in range(20) if i != q}
        want = sorted(d.items(), key=lambda x: (x[1], x[0]))[:10]
        assert [i for i, _ in got[q]] == [i for i, _ in want]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want], atol=1e-12)


def test_record_ids(spark):
    """Unique, and references name the response of their digest."""
    a, b = "<p>" + "a" * 200, "<p>" + "b" * 200
    rows = [(7, "u", a), (7, "u", b), (8, "v", a), (8, "v", b), (9, "w", a), (9, "w", a), (7, "u", a), (None, "n", a), (None, "n", a), (None, None, None), (None, None, "")]
    folder = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    heads = [h for r in spark.read.format("binaryFile").load(folder).collect() for h, _ in warc.records(bytes(r["content"]))]
    ids = {h["WARC-Record-ID"]: h for h in heads}
    assert len(ids) == len(heads) == len(rows)
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 4
    for h in revisits:
        to = ids[h["WARC-Refers-To"]]
        assert to["WARC-Type"] == "response" and to["X-Page-Id"] == h["X-Refers-To-Page-Id"] == "7" and to["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]


def test_shards_split_an_id_that_many_rows_share(spark, monkeypatch):
    seen = []
    cut = sharding.cut
    monkeypatch.setattr(sharding, "cut", lambda df, name: seen.append(cut(df, name)) or seen[-1])
    rows = [(None, "same", "en")] * 4000 + [(i, f"t{i}", "en") for i in range(4000)]
    got = sharding.shard(frame(spark, rows), 4).collect()
    assert max(r["count"] for r in seen[0].groupBy("part").count().collect()) < 2000
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_licence_notices_of_other_wordings(spark):
    """Usual variants are found; plain text with the same words is not."""
    lines = {
        "Licensed under Creative Commons BY-SA 3.0.": "CC-BY-SA",
        "Published under the Apache License 2.0": "Apache-2.0",
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose": "ISC",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY': "MIT",
        "This is free and unencumbered software released into the public domain.": "Unlicense",
        "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
        "made available under the terms of the Eclipse Public License 2.0": "EPL-2.0",
        "SPDX-License-Identifier: BSD-2-Clause": "BSD",
        "a permission of the author to copy a license for the software of the public library": None,
    }
    got = {r["doc_id"]: r["licence"] for r in licences.scan(frame(spark, [(i, x, "en") for i, x in enumerate(lines)]), licences.train([])).collect()}
    assert [got[i] for i in range(len(lines))] == list(lines.values())
