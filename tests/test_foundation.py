"""Resolution, retrieval, graphs, the board and screenplays against brute force,
their corner cases and their plans."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import board, counters, graph, lineage, resolution, retrieval, screenplay
from marquee.plans import foundation
from marquee.sources.tables import Model


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def pieces(s):
    return {s[i : i + 3] for i in range(max(len(s) - 2, 1))}


@pytest.mark.parametrize("per_mille", [600, 800, 1000])
def test_near_names(spark, per_mille):
    rng = np.random.default_rng(1)
    names = ["", "a", "ab", "ab ", "abc", "mani ratnam", "mani rathnam", "maniratnam", "mani ratnam jr", "aaaaaaaa", "aaaaaaaaa", None, "mani ratnam"]
    for _ in range(60):
        base = "".join(rng.choice(list("abcde"), 14))
        names += [base, base[:5] + base[6:], base[:9] + "z" + base[9:]]
    got = {tuple(r) for r in resolution.near_names(spark.createDataFrame([(n, 1, "x") for n in names], "name string, size int, piece string"), per_mille).collect()}
    want, some = set(), sorted({n for n in names if n is not None})
    for i, a in enumerate(some):
        for b in some[i + 1 :]:
            x, y = pieces(a), pieces(b)
            both, e = len(x & y), edits(a, b)
            if 1000 * both >= per_mille * (len(x) + len(y) - both) and e <= 2:
                want.add((a, b, both, len(x | y), e))
    assert got == want


def test_near_names_of_any_length(spark):
    """The threshold lets long names lack more pieces than two edits touch."""
    rng = np.random.default_rng(2)
    names = []
    for n in (20, 45, 60, 61, 75, 120, 250):
        base = "".join(rng.choice(list("abcdefghijklmnop"), n))
        names += [base, base[:9] + "z" + base[10:], base[:9] + "z" + base[10:15] + base[16:], base + "zz", base[:14] + "zzz" + base[17:]]
    got = {tuple(r) for r in resolution.near_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    want, some = set(), sorted(names)
    for i, a in enumerate(some):
        for b in some[i + 1 :]:
            both, all_ = len(pieces(a) & pieces(b)), len(pieces(a) | pieces(b))
            if 1000 * both >= 800 * all_ and edits(a, b) <= 2:
                want.add((a, b, both, all_, edits(a, b)))
    assert got == want and {len(a) for a, *_ in want} >= {60, 75, 120, 250}


def test_few_numbered_names_meet_at_a_key(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(resolution, "cut", lambda df, name: written.setdefault(name, df.cache()))
    names = spark.range(4000).selectExpr("concat('customer#', lpad(id, 9, '0')) AS name")
    found = resolution.near_names(names).count()
    posted = written["posted"]
    sides = posted.groupBy("key", F.least("size", "other").alias("s"), F.greatest("size", "other").alias("o")).agg(F.count_if(F.expr("size <= other")).alias("small"), F.count_if(F.expr("size >= other")).alias("large"))
    met = sides.agg(F.sum(F.when(F.col("s") < F.col("o"), F.col("small") * F.col("large")).otherwise(F.expr("small * (small - 1) div 2")))).first()[0]
    assert found > 18000 and met < 10 * found, (found, met)


def test_clusters(spark):
    rows = [("p1", "Mani  Ratnam films"), ("p2", "mani ratnam films "), ("p3", "mani rathnam films"), ("p4", "someone else"), ("p5", None), ("p6", None)]
    got = {r["id"]: (r["cluster"], r["members"]) for r in resolution.resolved(spark.createDataFrame(rows, "id string, name string"), per_mille=700).collect()}
    assert got == {"p1": ("p1", 3), "p2": ("p1", 3), "p3": ("p1", 3), "p4": ("p4", 1), "p5": ("p5", 1), "p6": ("p6", 1)}
    assert resolution.resolved(spark.createDataFrame([], "id string, name string")).collect() == []


def test_no_pair_of_tables_in_the_plan(spark, sf_dir):
    for p in (plan(foundation.er_pairs(Model(spark, sf_dir))), plan(foundation.creative_engines(Model(spark, sf_dir)))):
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_chains(spark):
    links = [(k, k + 1) for k in range(100, 137)] + [(1, 2), (2, 3), (3, 1), (7, 8), (8, 7), (50, 51), (49, 51), (51, 52), (51, 60), (9, 9), (None, 4), (4, None), (50, 51)]
    got = {r["node"]: tuple(r)[1:] for r in graph.chains(spark.createDataFrame(links, "node long, next long")).collect()}
    for k in range(100, 138):
        assert got[k] == (100, k - 100, k + 1 if k < 137 else None, 38, False)
    assert {k: got[k] for k in (1, 2, 3)} == {1: (1, None, 2, 3, True), 2: (1, None, 3, 3, True), 3: (1, None, 1, 3, True)}
    assert got[7] == (7, None, 8, 2, True)
    assert got[49] == (49, 0, 51, 3, False) and got[51] == (49, 1, 52, 3, False) and got[52] == (49, 2, None, 3, False)
    assert got[50] == (50, 0, None, 1, False) and 60 not in got and 9 not in got and 4 not in got
    assert graph.chains(spark.createDataFrame([], "node long, next long")).collect() == []


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: written.append(name) or cut(df, name))
    n = 1000
    got = graph.chains(spark.createDataFrame([(k, k + 1) for k in range(n)], "node long, next long"))
    assert got.where("position = node and head = 0").count() == n + 1
    assert len(written) <= 2 * (math.ceil(math.log2(n)) + 2)


def test_personal_ranks_keep_their_mass(spark):
    rng = np.random.default_rng(3)
    edges = [(0, int(k)) for k in range(1, 400)] + [tuple(map(int, e)) for e in rng.integers(1, 400, (300, 2))]
    got = graph.personal_ranks(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(0,), (5,), (5,), (999,)], "seed long"), rounds=5, least=graph.UNITS // 2000)
    mass = defaultdict(dict)
    for r in got.collect():
        mass[r["seed"]][r["node"]] = r["mass"]
    assert {s: sum(m.values()) for s, m in mass.items()} == {0: graph.UNITS, 5: graph.UNITS, 999: graph.UNITS}
    assert mass[999] == {999: graph.UNITS}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for seed in (0, 5):
        kept, waits = Counter(), Counter({seed: graph.UNITS})
        for _ in range(5):
            k2, w2 = Counter(kept), Counter()
            for v, w in waits.items():
                part = w * 85 // (100 * len(near[v]))
                if part >= graph.UNITS // 2000:
                    k2[v] += w - part * len(near[v])
                    for u in near[v]:
                        w2[u] += part
                else:
                    w2[v] += w
            kept, waits = k2, w2
        assert mass[seed] == dict(kept + waits)


@pytest.mark.parametrize("block", [512, 7])
def test_shared_twice(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(o, m) for o in range(150) for m in {int(x) for x in rng.zipf(1.5, 6) % 60}]
    rows += [(o, 1000) for o in range(0, 600)]  # a member of most sets
    rows += [(3, 1000), (None, 1), (1, None)]
    sets = defaultdict(set)
    for o, m in rows:
        if o is not None and m is not None:
            sets[o].add(m)
    for least in (2, 3):
        want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least}
        assert {tuple(r) for r in graph.shared_twice(spark.createDataFrame(rows, "owner long, member long"), least).collect()} == want


def test_a_hub_proposes_no_pairs(spark, monkeypatch):
    """A member of every set is never among those that pairs come from."""
    seen = {}
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: seen.setdefault(name, cut(df, name)))
    rows = [(o, m) for o in range(300) for m in (9999, o // 2)]
    assert graph.shared_twice(spark.createDataFrame(rows, "owner long, member long")).count() == 150
    assert seen["prefix"].where("member = 9999").count() == 0 and seen["pairs"].count() == 150


def test_sets_that_share_one_member_are_not_proposed(spark, monkeypatch):
    seen = {}
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: seen.setdefault(name, cut(df, name)))
    rng = np.random.default_rng(4)
    rows = [(o, int(m)) for o in range(400) for m in rng.integers(0, 100, 8)]
    rows += [(o, m) for o in (1000, 1001) for m in range(100)]  # more than LARGE members
    sets = defaultdict(set)
    for o, m in rows:
        sets[o].add(m)
    want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 2}
    assert {tuple(r) for r in graph.shared_twice(spark.createDataFrame(rows, "owner long, member long")).collect()} == want
    assert seen["pairs"].count() <= len(want) + 10


def bm25(docs, queries, k):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D.,;:!?]+", (t or "").lower())
    tf = {d: Counter(words(t)) for d, t in docs}
    size = {d: sum(c.values()) for d, c in tf.items()}
    df = Counter(w for c in tf.values() for w in c)
    n, mean = float(len(docs)), sum(size.values()) / max(len(docs), 1)
    out = set()
    for q, t in queries:
        score = Counter()
        for w, times in Counter(words(t)).items():
            for d, c in tf.items():
                if w in c:
                    score[d] += times * math.floor(1e6 * math.log(1.0 + (n - df[w] + 0.5) / (df[w] + 0.5)) * (c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[d] / mean))))
        out |= {(q, d, s, r) for r, (d, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k], 1)}
    return out


@pytest.mark.parametrize("block", [1024, 5])
def test_lexical_ranks_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", block)
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % 50)
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, "w1 W1, w1."), (503, "w1 w1 w1")]
    queries = [(i, text(6)) for i in range(9)] + [(20, None), (21, "nowhere"), (22, "w1 w1")]
    index = retrieval.inverted_index(spark.createDataFrame(docs, "doc long, text string"))
    got = retrieval.lexical(index, spark.createDataFrame(queries, "query long, text string"), 7)
    assert {tuple(r) for r in got.collect()} == bm25(docs, queries, 7)
    none = retrieval.inverted_index(spark.createDataFrame([], "doc long, text string"))
    assert retrieval.lexical(none, spark.createDataFrame(queries, "query long, text string")).collect() == []


def test_handoffs_follow_no_pointers(spark, monkeypatch, sf_dir):
    links = [("a", "b"), ("a", "c"), ("d", "b"), ("b", "e"), ("e", "e"), ("x", "y"), ("y", "x"), (None, "a"), ("c", None), ("d", "f")]
    df = spark.createDataFrame(links, "node string, next string")
    want = graph.chains(df).where("next is not null").select("node", "next").collect()
    assert sorted(graph.successors(df).collect()) == sorted(want) and want
    from marquee.plans.registry import QUERIES

    monkeypatch.setattr(graph, "chains", lambda links: 1 / 0)
    assert QUERIES["gr_series_handoffs"](spark, sf_dir).count()


def test_lexical_ranks_write_no_postings(spark, monkeypatch):
    """Tables and shuffles hold queries and answers, no words of documents; rows
    that repeat an id are one document, as in the SQL."""
    import duckdb

    from marquee.checkpoints import cut
    from marquee.plans.foundation import RANKED

    tables = []
    monkeypatch.setattr(retrieval, "cut", lambda df, name: tables.append(cut(df, name)) or tables[-1])
    docs = [(i, f"w{i % 7} w{i % 5} x y w{i % 3} common") for i in range(300)] + [(3, "w1 w2"), (None, "w1 w5"), (None, "y"), (400, None)]
    queries = [(1, "w1 w2 common"), (2, "w4 w4 x"), (2, "y"), (None, "w6"), (3, "none")]
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    got = retrieval.lexical(retrieval.inverted_index(spark.createDataFrame(docs, "doc long, text string")), spark.createDataFrame(queries, "query long, text string"))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", queries)
    want = con.execute(f"WITH {RANKED} SELECT query, doc, score, rank FROM lexical").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert sum(t.count() for t in tables) < 30


@pytest.mark.parametrize("block", [4096, 3])
def test_semantic_ranks(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 6)).round(3)
    x[7] = x[8]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc long, x array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.rint(u @ u.T * 1e9).astype(int)
    want = {(q, d, int(s[q, d]), r) for q in range(8) for r, d in enumerate(sorted((d for d in range(50) if d != q), key=lambda d: (-s[q, d], d))[:4], 1)}
    got = retrieval.semantic(v, v.where("doc < 8").withColumnRenamed("doc", "query"), 4)
    assert {tuple(r) for r in got.collect()} == want
    assert retrieval.semantic(v, v.where("doc < 0").withColumnRenamed("doc", "query")).collect() == []


def test_scenes(spark):
    rng = np.random.default_rng(6)
    rows = [(1, t, s, x) for t, s, x in [(1, "user", "a b"), (2, "user", None), (2, "user", "z"), (3, None, "c\n\n d"), (5, None, "e"), (6, "user", "f"), (6, "tool", "g")]]
    rows += [(2, t, str(rng.choice(["user", "assistant"])), "one two") for t in range(3000) if t % 97] + [(None, 1, "user", "x"), (3, None, "user", "x")]
    df = spark.createDataFrame(rows, "script long, turn long, speaker string, text string")
    got = {(r["script"], r["turn"]): (r["speaker"], r["words"], r["lines"], r["scene"], r["run"]) for r in screenplay.scenes(df).collect()}
    one = {}
    for s, t, who, text in rows:
        if s is not None and t is not None:
            key = (who or "unknown", text or "")
            one[s, t] = min(one.get((s, t), key), key)
    scene = run = 0
    for s, t in sorted(one):
        if (s, t - 1) not in one:
            scene = scene + 1 if any(k[0] == s and k[1] < t for k in got if k < (s, t)) else 1
        if (s, t - 1) not in one or one[s, t - 1][0] != one[s, t][0]:
            run = run + 1 if any(k[0] == s and k[1] < t for k in got if k < (s, t)) else 1
        who, text = one[s, t]
        assert got[s, t] == (who, len(text.split()), sum(bool(x.strip(" ")) for x in text.split("\n")), scene, run)
    assert len(got) == len(one)
    assert screenplay.measures(df.where("false")).collect() == []


def test_board_expands_once(spark, sf_dir):
    p = plan(foundation.corpus_board(Model(spark, sf_dir)))
    assert len(re.findall(r"\bExpand\b", p)) == 1
    empty = spark.createDataFrame([], "film_id long, decade long, genre string, status string, dates int, writers int, directors int, cast int, links int")
    assert board.board(empty).where("titles > 0").collect() == []


def test_handoffs(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "node string, next string")
    crew = spark.createDataFrame([("a", "d:1"), ("a", "d:1"), ("a", "w:2"), ("b", "w:2"), ("b", "d:3"), ("b", None)], "work string, role string")
    assert {tuple(r) for r in lineage.handoffs(pairs, crew).select("node", "retained", "left", "joined", "kept_roles").collect()} == {("a", 1, 1, 1, "w:2"), ("b", 0, 2, 0, "")}


def test_fused(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query long, doc long, rank long")
    b = spark.createDataFrame([(1, 11, 1), (2, 12, 3)], "query long, doc long, rank long")
    got = {tuple(r) for r in retrieval.fused({"l": a, "s": b}).collect()}
    assert got == {(1, 11, 2, 1, 10**9 // 62 + 10**9 // 61, 1), (1, 10, 1, None, 10**9 // 61, 2), (2, 12, None, 3, 10**9 // 63, 1)}
    assert retrieval.semantic(spark.createDataFrame([(1, [1.0])], "doc long, x array<double>").where(retrieval.usable(F.col("x"))), spark.createDataFrame([(2, [1.0])], "query long, x array<double>")).count() == 1


def test_counters_merge_in_any_order(spark):
    rng = np.random.default_rng(7)
    rows = [(str(g), int(v)) for g, v in zip(rng.integers(0, 4, 900), rng.integers(0, 100_000, 900) % 70_001, strict=True)] + [("0", None), ("9", None), (None, 5), ("1", 0), ("1", 32_767), ("1", 32_768)]
    df = lambda r: spark.createDataFrame(r, "g string, v long")
    parts = [counters.delta(df(rows[a::3]), ["g"], "v") for a in range(3)]
    want = {g: (sum(x == g for x, _ in rows), len({v for x, v in rows if x == g and v is not None})) for g in {x for x, _ in rows}}
    for order in ((0, 1, 2), (2, 0, 1)):
        one = counters.merged(["g"], *(parts[i] for i in order))
        assert {r["g"]: (r["rows"], r["members"]) for r in counters.told(one, ["g"]).collect()} == want
    two = counters.merged(["g"], counters.merged(["g"], parts[1], parts[2]), parts[0])
    assert {r["g"]: (r["rows"], r["members"]) for r in counters.told(two, ["g"]).collect()} == want
    assert counters.told(counters.delta(df([]), ["g"], "v"), ["g"]).collect() == []


def linked(spark):
    """Stars, repeated and turned links, a link of a node with itself, a chain
    that is longer than labels go, and nulls."""
    stars = [(f"h{h}", f"n{h}.{i}") for h in range(6) for i in range(h + 2)]
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(20)]
    more = [(b, a) for a, b in stars[::3]] + stars[::4] + [("n5.0", "n5.1"), ("h0", "h0"), ("alone", "alone"), (None, "x"), ("x", None)]
    return spark.createDataFrame(stars + chain + more, "a string, b string")


@pytest.mark.parametrize(("cell", "least"), [(graph.CELL, graph.UNITS // 10**6), (30, graph.UNITS // 8)])
def test_ranks_of_small_cells_are_those_of_pushed_mass(spark, monkeypatch, cell, least):
    monkeypatch.setattr(graph, "CELL", cell)
    monkeypatch.setattr(graph, "WORK", 40)
    e = linked(spark)
    got = sorted(map(tuple, graph.personal_ranks(e, rounds=3, least=least).collect()))
    assert got == sorted(map(tuple, graph.pushed(e, graph.nodes(e.where("a <> b")), rounds=3, least=least).collect()))


def test_cells_share_no_node_with_the_rest(spark):
    cells, rest = graph.dealt(linked(spark))
    within = [{x for link in r["links"] for x in link} for r in cells.collect()]
    apart = {x for r in rest.collect() for x in r}
    assert apart == {f"c{i:02}" for i in range(21)}
    assert len(within) == 6 and sum(map(len, within)) == len(set().union(*within)) and not apart & set().union(*within)


def test_composite_similarity_of_large_cells(spark, sf_dir, monkeypatch):
    """What is too large to be one row is compared by joins, with the same result."""
    from marquee.plans.registry import QUERIES

    monkeypatch.setattr(graph, "CELL", 40)
    rows = QUERIES["gr_composite_similar"](spark, sf_dir)
    monkeypatch.setattr(graph, "CELL", 1 << 20)
    whole = QUERIES["gr_composite_similar"](spark, sf_dir)
    assert rows.columns == whole.columns and sorted(map(tuple, rows.collect())) == sorted(map(tuple, whole.collect()))


def test_an_index_is_made_and_read_in_its_row(spark, sf_dir):
    from marquee.functions import values
    from marquee.plans.registry import QUERIES

    rows = [(["b", "a", "b", "é", "a", "b"],), ([],), (None,), (["x"] * 3,)]
    index = spark.createDataFrame(rows, "words array<string>").select("words", values.inverted(F.col("words")).alias("i"))
    got = index.select("i", values.rebuilt_text(F.col("i"))).collect()
    assert [r[0] for r in got] == [{"a": [1, 4], "b": [0, 2, 5], "é": [3]}, {}, None, {"x": [0, 1, 2]}]
    assert [r[1] for r in got] == ["b a b é a b", "", "", "x x x"]
    assert "Exchange" not in QUERIES["prj7_indexed_works"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
