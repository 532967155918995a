"""Operators on embeddings and pages against brute force, and corner cases."""

import hashlib
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import cover_tree, nn_descent, queries, warc


def vectors_frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, cell string")


def valid(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def link_brute(rows, threshold=0.9):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and valid(v)]
    root, n = {i: i for i, _ in rows if i is not None}, {i: 0 for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(ok):
        for j, y in ok[:a]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                n[i] += 1
                n[j] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (n[i], find(i), find(i) == i) for i in root}


def odd_vectors():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + k, (base[3] + rng.normal(size=8) * 0.05).tolist()) for k in range(60)]
    rows += [(200 + k, (base[5] + rng.normal(size=8) * 0.3).tolist()) for k in range(60)]
    rows += [(300 + k, base[7].tolist()) for k in range(30)]
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [float("nan")] + [1.0] * 7), (404, [float("inf")] + [1.0] * 7), (405, [None] + [1.0] * 7), (406, [1.0] * 3), (407, [1.0] * 3), (408, (base[7] * 5).tolist())]
    return rows


def told(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect() if r["vec_id"] is not None}


@pytest.mark.parametrize("chunk", [2048, 16])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_cover_tree_odd(spark, monkeypatch, chunk, kind):
    monkeypatch.setattr(cover_tree, "CHUNK", chunk)
    rows = odd_vectors()
    if kind == "float":
        rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = vectors_frame(spark, [*rows, (None, [1.0] * 8)], kind)
    got = cover_tree.embedding_dedup(df)
    assert told(got) == link_brute(rows)
    assert [tuple(r)[1:] for r in got.where("vec_id is null").collect()] == [(None, None, False)]


def test_cover_tree_tables(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    rng = np.random.default_rng(2)
    rows += [(10_000 + k, (np.array(rows[k % 7][1]) + rng.normal(size=64) * 0.03).tolist()) for k in range(100)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert told(cover_tree.embedding_dedup(vectors_frame(spark, rows))) == link_brute(rows)
    assert cover_tree.embedding_dedup(vectors_frame(spark, [])).collect() == []
    assert told(cover_tree.embedding_dedup(vectors_frame(spark, [(1, None), (2, [0.0])]))) == {1: (0, 1, True), 2: (0, 2, True)}


def test_tree_levels_nest():
    x = cover_tree.unit(np.random.default_rng(0).normal(size=(300, 4)))
    t = cover_tree.Tree(x)
    for (c, s, e, r, _), radius in zip(t.levels[1:-1], cover_tree.LEVELS, strict=True):
        assert (np.concatenate([np.arange(a, b) for a, b in zip(s, e, strict=True)]) == np.arange(300)).all()
        assert (r <= radius + 1e-6).all() and ((s <= c) & (c < e)).all()


def test_levels_that_do_not_differ_are_held_once():
    """Vectors far from each other: a chunk's tree is small beside its vectors,
    and their pairs are multiplied once, not once a level."""
    x = cover_tree.unit(np.random.default_rng(0).normal(size=(400, 256)))
    t, u = cover_tree.Tree(x[:200]), cover_tree.Tree(x[200:])
    assert [len(level[0]) for level in t.levels] == [1] + [200] * 6
    assert len(pickle.dumps(t.levels)) < 0.1 * 4 * x[:200].size
    multiplied = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            multiplied.append(len(self) * other.shape[1])
            return np.asarray(self) @ np.asarray(other)

    t.x32 = t.x32.view(Counted)
    assert cover_tree.traverse(t, u, 0.447)[0] == [] and max(multiplied) == 200 * 200 and sum(multiplied) < 1.1 * 200 * 200


def test_chunks_travel_once_a_tile(spark, monkeypatch):
    """As often as there are tiles, however many chunks they meet."""
    written = {}
    monkeypatch.setattr(cover_tree, "CHUNK", 16)
    monkeypatch.setattr(cover_tree, "TILES", 3, raising=False)
    cut = cover_tree.cut
    monkeypatch.setattr(cover_tree, "cut", lambda df, name: written.setdefault(name, cut(df, name)) if name in ("chunks", "met") else cut(df, name))
    rng = np.random.default_rng(4)
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(rng.normal(size=(300, 16)))]
    rows += [(1000 + k, [float(np.float32(x + 0.05)) for x in rows[k][1]]) for k in range(100)]
    assert told(cover_tree.embedding_dedup(vectors_frame(spark, rows))) == link_brute(rows)
    chunks, met = written["chunks"].count(), written["met"]
    sent = met.selectExpr("i", "j", "a AS cell", "pa AS part").union(met.selectExpr("i", "j", "b", "pb")).distinct().count()
    assert chunks > 20 and met.select("i", "j").distinct().count() == 6 and sent <= 3 * chunks


def search_brute(rows, asked, k=10):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and valid(v) and len(v) == 64]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    out = {}
    for i, v in ok:
        if asked(i):
            d = np.sqrt(((x - v) ** 2).sum(1))
            o = [p for p in np.lexsort((ids, d)) if ids[p] != i][:k]
            out[i] = [(int(ids[p]), float(d[p])) for p in o]
    return out


def test_nn_descent(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "CHUNK", 256)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    rows += [(5000 + k, rows[100][1]) for k in range(15)] + [(6000, None), (6100, [0.0] * 64), (6200, [float("nan")] * 64)]
    want = search_brute(rows, lambda i: i % 100 == 0)
    got = {}
    for r in nn_descent.nearest_neighbours(vectors_frame(spark, rows), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    x = {i: np.array(v, float) for i, v in rows if valid(v)}
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, 11))
        assert [f[1:] for f in found] == [f[1:] for f in sorted(found, key=lambda f: (f[2], f[1]))]
        assert all(np.isclose(f[2], np.linalg.norm(x[q] - x[f[1]]), atol=1e-12) for f in found)
    recall = np.mean([len({f[1] for f in got[q]} & {w[0] for w in want[q]}) / 10 for q in want])
    assert recall >= 0.9


def test_nn_descent_widens_the_beam(spark, monkeypatch):
    """A beam that finds too little grows until the check passes."""
    monkeypatch.setattr(nn_descent, "BEAM", 4)
    monkeypatch.setattr(nn_descent, "ENTRIES", 4)
    monkeypatch.setattr(nn_descent, "CHUNK", 64)
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 64)))]
    want = search_brute(rows, lambda i: i % 100 == 0)
    got = {}
    for r in nn_descent.nearest_neighbours(vectors_frame(spark, rows, "double"), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & {w[0] for w in want[q]}) / 10 for q in want]) >= 0.9


def test_nn_descent_small(spark):
    rows = [(0, [1.0] * 64), (100, [2.0] * 64), (7, [1.0] * 64), (None, [3.0] * 64)]
    got = sorted(tuple(r) for r in nn_descent.nearest_neighbours(vectors_frame(spark, rows), F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 7, 0.0), (0, 2, 100, 8.0), (100, 1, 0, 8.0), (100, 2, 7, 8.0)]
    assert nn_descent.nearest_neighbours(vectors_frame(spark, []), F.col("vec_id") == 0).collect() == []
    assert nn_descent.nearest_neighbours(vectors_frame(spark, [(0, [1.0])]), F.col("vec_id") == 0).collect() == []


def pages_frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, first int")


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 20_000)
    same = "<p>é " + "same " * 50
    rows = [(i, f"http://x/{i}", f"<html>{i} " + "words and words " * (i % 90)) for i in range(300)]
    rows += [(1000, None, same), (990, "http://a\r\nb", same), (1001, "u", same), (2000, "u", None), (2001, "u", ""), (2002, "u", "short"), (2003, "u", "short"), (None, "u", same), (3000, "u", "x" * 300_000), (3001, "u", "x" * 300_000), (4000, "u", "y" * 200), (4000, "u", "y" * 200)]
    folder = warc.write(pages_frame(spark, rows))
    got = warc.read(spark, folder).collect()
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = i is not None and len(b) >= 100 and first[h] != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None, None if again else b))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"] if r["payload"] is None else bytes(r["payload"])) for r in got), key=str) == sorted(want, key=str)


def test_warc_empty(spark):
    assert warc.read(spark, warc.write(pages_frame(spark, []))).collect() == []


def test_dictionary_leads_the_archive(spark):
    samples = [f"<html><body>{i} common words of every page {i * 7} and more of them</body></html>".encode() * 3 for i in range(400)]
    d = warc.train(samples)
    assert d and warc.lead(d)[:4] == bytes([0x5D, 0x2A, 0x4D, 0x18])
    assert warc.lead(b"") == b""


def test_queries_on_tables(spark, sf_dir):
    assert queries.op9_nn_descent_search(spark, sf_dir).count() == 50
    assert queries.op10_warc_dictionary_archive(spark, sf_dir).count() == 50
    assert queries.op4_cover_tree_dedup(spark, sf_dir).count() == 500
