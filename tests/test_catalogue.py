"""Catalogue semantics on literals: nulls, ties, wild cards, quirks."""

import datetime as dt
import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marquee import checkpoints, schemas
from marquee.functions import text, values
from marquee.operators import catalogue, chunks, evidence, folding, lineage, merge, relational, selection, signals, upserts

D = dt.date


def films(spark, rows):
    return spark.createDataFrame(rows, schemas.FILM)


def genres(spark, rows):
    return spark.createDataFrame(rows, "film_id long, label string")


def credits(spark, rows):
    return spark.createDataFrame(rows, schemas.CREDIT)


def people(spark, n=9):
    return spark.createDataFrame([(i, f"P{i}") for i in range(n)], "person_id long, name string")


@pytest.fixture(scope="module")
def two(spark):
    f = films(spark, [(1, "Dark One", 140, D(2005, 6, 15), "published"), (2, "The Dark Two", 152, D(2008, 7, 18), "published"), (3, "Undated", 90, None, "published"), (4, "Hidden dark", 80, D(2001, 1, 1), "review")])
    g = genres(spark, [(1, "drama"), (1, "crime"), (2, "crime"), (2, "action"), (2, "drama"), (3, "drama")])
    c = credits(spark, [(1, 1, "director"), (2, 1, "director"), (2, 1, "writer"), (2, 2, "cast"), (1, 3, "cast")])
    return f, g, c


def test_search(spark, two):
    f, g, _ = two
    assert [r["id"] for r in catalogue.search(f, g, q="dark ").orderBy("id").collect()] == [1, 2]
    first = catalogue.search(f, g, limit=1).collect()
    assert [r["id"] for r in first] == [3]  # undated ones come first
    assert {r["id"] for r in catalogue.search(f, g, genre="CRI%").collect()} == {1, 2}
    assert [r["id"] for r in catalogue.search(f, g, decade=2005).orderBy("id").collect()] == [1, 2]
    assert [r["id"] for r in catalogue.search(f, g, decade=1996).collect()] == [1]
    assert catalogue.search(f, g, q="dark", offset=2).collect() == []
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}, {"decade": 1800}):
        with pytest.raises(ValueError):
            catalogue.search(f, g, **bad)


def test_signals_and_similar(spark, two):
    f, g, c = two
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "first long, second long")
    told = {(r["second"], r["label"]): (r["contribution"], r["evidence"]) for r in signals.pair_signals(pairs, f, g, c, people(spark)).collect()}
    assert told == {(2, "Shared genres"): (30.0, "crime, drama"), (3, "Shared genres"): (15.0, "drama"), (2, "Shared creative collaborators"): (12.0, "P1 (director/writer)"), (2, "Release era"): (14.0, "Released 3 years apart")}
    rows = signals.similar(1, f, g, c).collect()
    assert [(r["id"], r["score"]) for r in rows] == [(2, 56.0), (3, 15.0)]
    far = films(spark, [(1, "a", 1, D(2000, 1, 1), "published"), (2, "b", 1, D(2010, 1, 1), "published"), (3, "c", 1, D(2011, 1, 1), "published")])
    none = genres(spark, [])
    era = signals.pair_signals(pairs, far, none, credits(spark, []), people(spark)).collect()
    assert [(r["second"], r["contribution"]) for r in era] == [(2, 0.0)]  # a signal without points
    assert signals.similar(1, far, none, credits(spark, [])).collect() == []
    many = credits(spark, [(f_, p, "cast") for f_ in (1, 2) for p in range(6)])
    row = signals.pair_signals(pairs, far, none, many, people(spark)).where("label like '%collab%'").first()
    assert row["contribution"] == 35.0 and row["evidence"] == "P0 (cast), P1 (cast), P2 (cast), P3 (cast) and more"


def test_graph_is_truncated_by_roles(spark, two):
    rows = {r["source"]: r for r in catalogue.person_graph(two[2], people(spark)).where("film_id = 2").collect()}
    assert rows["person:1"]["label"] == "director/writer" and rows["person:1"]["position"] == 1
    assert all(r["truncated"] for r in rows.values())
    assert not any(r["truncated"] for r in catalogue.person_graph(two[2], people(spark)).where("film_id = 1").collect())


def test_filmography_puts_undated_last(spark, two):
    c = credits(spark, [(1, 1, "cast"), (3, 1, "cast"), (2, 1, "cast"), (2, 1, "writer")])
    assert [r["id"] for r in catalogue.filmography(two[0], c).orderBy("position").collect()] == [2, 1, 3]


def test_empty_health(spark):
    empty = films(spark, [])
    b = spark.createDataFrame([], "at timestamp")
    row = catalogue.health(empty, people(spark, 0) if False else people(spark), credits(spark, []), b, b, "at").first()
    assert (row["status"], row["films"], row["latest"]) == ("empty", 0, None)


def test_lineage(spark):
    e = spark.createDataFrame([("f1", "One", "film"), ("f2", "Two", "film"), ("b", "Book", "book")], "entity_id string, label string, kind string")
    a = spark.createDataFrame([("a1", "f1", "followed_by", "f2", None, "published"), ("a2", "f2", "follows", "f1", None, "resolved"), ("a3", "f1", "based_on", "b", None, "published"), ("a4", "f1", "based_on", "f2", None, "candidate"), ("a5", "f2", "based_on", "f1", None, "resolved")], schemas.ASSERTION)
    rows = [(r["entity_id"], r["relation_label"], r["target_id"], r["direction"], r["assertion_id"]) for r in lineage.edges(a, e).orderBy("entity_id", "position").collect()]
    assert rows == [("b", "Film adaptation", "f1", "incoming", "a3"), ("f1", "Film adaptation", "f2", "incoming", "a5"), ("f1", "Next installment", "f2", "outgoing", "a1"), ("f1", "Source material", "b", "outgoing", "a3"), ("f2", "Film adaptation", "f1", "outgoing", "a5"), ("f2", "Previous installment", "f1", "outgoing", "a2")]
    with pytest.raises(ValueError):
        lineage.edges(a, e, limit=31)


def cut(spark, content, p):
    rows = chunks.chunks(spark.createDataFrame([(content,)], "c string"), [], "c", p)
    return [r.asDict() for r in rows.orderBy("ordinal").collect()]


def test_chunk_literals(spark):
    p = chunks.Policy(10, 13, 3, 1)
    hens = "Six hens slept in the barn. A fox came by at noon. Nobody saw it cross the yard. The gate stood open. Then all the geese cried out."
    out = cut(spark, hens, p)
    # 7, 7, 7, 5 and 7 tokens: two that are 14 do not fit, 7 and 5 do
    assert [(c["ordinal"], c["tokens"], c["sentences"]) for c in out] == [(0, 7, 1), (1, 7, 1), (2, 12, 2), (3, 12, 2)]
    assert out[2]["content"] == "Nobody saw it cross the yard. The gate stood open." and out[3]["content"].startswith("The gate stood open. Then")
    assert {c["status"] for c in out} == {"eligible"}
    assert cut(spark, "Only a few words.", chunks.Policy(minimum_words=5))[0]["flags"] == ["below_minimum_words"]
    big = cut(spark, " ".join(["hay"] * 400) + "!", chunks.Policy(minimum_words=1))[0]
    assert (big["status"], big["flags"], big["tokens"]) == ("excluded", ["oversized_single_sentence"], 401)
    two = cut(spark, "Red and blue and green and grey. Cold and warm and wet and dry.", chunks.Policy(8, 12, 5, 1))
    assert [c["tokens"] for c in two] == [8, 8, 8]  # the overlap is left over behind a full chunk
    assert cut(spark, " \n ", p) == [] and cut(spark, None, p) == []
    for bad in ((0, 360, 50, 40), (300, 200, 50, 40), (300, 360, 300, 40), (300, 360, -1, 40)):
        with pytest.raises(ValueError):
            chunks.Policy(*bad)


def test_sentences_are_english(spark):
    rows = spark.createDataFrame([("Eins. Zwei.", "de"), ("One. Two?", "en")], "c string, lang string")
    assert chunks.sentences(rows.where("lang = 'en'"), [], "c", "lang").first()["s"] == ["One.", "Two?"]
    with pytest.raises(Exception, match="no sentence rule"):
        chunks.sentences(rows, [], "c", "lang").collect()


def test_spans_overlap():
    p = chunks.Policy(10, 12, 4, 1)
    assert chunks.spans([], p) == [] and chunks.spans([5, 5], p) == [(0, 2)]
    assert chunks.spans([5, 5, 5], p) == [(0, 2), (1, 3)]
    assert chunks.spans([6, 6, 7], p) == [(0, 2), (1, 2), (2, 3)]  # the overlap is left over behind a full chunk
    assert chunks.spans([3, 3, 9], p) == [(0, 2), (2, 3)]
    assert chunks.spans([20, 3], p) == [(0, 1), (0, 1), (1, 2)]


def test_chunk_dedup_and_report(spark):
    long = " ".join(f"word{i}" for i in range(50)) + "."
    p = spark.createDataFrame([("f", 1, long), ("g", 2, long), ("f", 3, "short."), ("f", 4, None)], "film string, doc_id long, content string")
    rows = chunks.deduplicated(chunks.chunks(p, ["film", "doc_id"], "content"), ["film", "doc_id", "ordinal"])
    assert {(r["doc_id"], r["status"]) for r in rows.collect()} == {(1, "eligible"), (2, "duplicate"), (3, "excluded")}
    r = chunks.report(rows, "film").first()
    assert (r["chunks"], r["eligible"], r["duplicate"], r["excluded"], r["below_minimum_words"], r["film_max"], r["films"], r["tokens_average"]) == (3, 1, 1, 1, 1, 1, 1, 51.0)
    assert chunks.report(rows.where("false"), "film").first()["tokens_average"] == 0.0


def one(spark, c, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(c(F.col("v"))).first()[0]


def test_normalisers(spark):
    assert one(spark, text.folded, "A  B\n c") == "a b c"
    assert one(spark, text.casefolded, "Straße  X") == "strasse x"
    assert one(spark, text.ascii_tokens, "Amélie: L'Été") == "amelie l ete" and one(spark, text.ascii_tokens, "東京") == ""
    assert one(spark, text.letters_only, "Été 2!") == "été2".replace("́", "")
    assert one(spark, text.nfc_collapsed, "é  x") == "é x"
    assert one(spark, text.slug, "  Été!! & Co") == "t-co" and one(spark, text.slug, "***") == "section"
    assert one(spark, text.clean_label, "  ") is None
    assert one(spark, text.entity_id, "http://www.wikidata.org/entity/Q42") == "Q42" and one(spark, text.entity_id, "x") is None
    assert one(spark, text.last_part, "https://openalex.org/W12/") == "W12"
    assert one(spark, text.word_count, "It's a well-known été") == 4
    for f in (text.folded, text.slug, text.word_count):
        one(spark, f, None)


def test_values(spark):
    assert [one(spark, values.strict_date, v) for v in ("2000-02-03T00:00:00Z", "2000", "2000-02-31", None)] == [D(2000, 2, 3), None, None, None]
    assert [one(spark, values.signed_year, v) for v in ("+1999-03-31T00:00:00Z", "1999-03-31", "-0044-01-01")] == [1999, None, 44]
    assert [one(spark, values.truncated, v) for v in ("90.9", "-1.5", "x")] == [90, -1, None]
    assert one(spark, values.map_labels, '{"a":"Z","b":"B"}') == ["B", "Z"] and one(spark, values.map_labels, "bad") == []
    assert one(spark, values.snak_id, '{"datavalue":{"value":{"id":"Q5"}}}') == "Q5" and one(spark, values.snak_id, '{"datavalue":{"value":"x"}}') is None
    assert one(spark, values.snak_year, '{"datavalue":{"value":{"time":"+2012-01-01T00:00:00Z"}}}') == 2012
    assert one(spark, values.rebuilt_text, {"is": [1], "this": [0, 2]}, "map<string,array<int>>") == "this is this"
    assert one(spark, values.rebuilt_text, None, "map<string,array<int>>") == ""


def test_wikitext(spark):
    wiki = "Before<!-- note\n--> the [[Flood (myth)|flood]]{{cite|{{date|1}}}}, '''Noah''' [[built]] an [https://example.org ark]<br />of <b>wood</b>{{end}}."
    assert one(spark, text.without_wikitext, wiki) == "Before the flood, Noah built an ark of wood."
    odd = "[[File:a.png|thumb|of [[b]]]] ]] }} [http://example.org] [[|c]] [[d|]] it''''s [[open"
    assert text.readable(odd) == "thumb|of b ]] }} [http://example.org] |c d| its [[open"
    assert one(spark, text.citation_markers, 'x<ref name="k">1</ref> y<ref>2</ref> z<ref name=k /> <ref name=m/><REF>\n</REF>') == ["k", "inline", "m"]
    assert one(spark, text.infobox_years, "| year = 1950\n|released = {{start|1987|6}} 19871 and 1986\n") == [1986, 1987]
    assert one(spark, lambda c: text.paragraphs_packed(c, 20), "Rain fell.\n\nThe sea rose higher.\n\nOn.") == ["Rain fell.", "The sea rose higher.", "On."]
    assert one(spark, text.paragraphs_packed, " Rain.\n \n[[Sun|Wind]].\n\n{{gone}}\n\n") == ["Rain.\n\n[[Sun|Wind]]."]
    assert text.packs([5, 5, 5, 30, 1], 12) == [0, 0, 1, 2, 3] and text.packs([], 9) == []
    page = "It began.\n==Voyage==\n[[Sea|Waves]] rose.\n===  The   raven ===\nIt left.\n=== Empty ===\n{{x}}\n== See also ==\n* a list\n=== More ===\nof it\n"
    got = spark.createDataFrame([(page,), (None,)], "t string").lateralJoin(text.WikiSections(F.col("t").outer())).orderBy("ordinal").collect()
    assert [(r["locator"], r["title"]) for r in got] == [("lead", "Lead"), ("voyage", "Voyage"), ("voyage/the-raven", "Voyage / The raven")]


def test_outline_skips():
    assert text.outline([2, 4, 5, 3, 2, 3], list("abcdef")) == [["a"], ["a", "b"], ["b", "c"], ["a", "d"], ["e"], ["e", "f"]]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, name string, v string")
    new = spark.createDataFrame([(2, "B", None), (3, "c", "y"), (3, "d", "z")], "id int, name string, v string")
    assert sorted(map(tuple, merge.insert_if_absent(old, new, ["id"], ["name"]).collect())) == [(1, "a", None), (2, "b", "x"), (3, "c", "y")]
    assert merge.insert_counts(old, new, ["id"]).first().asDict() == {"created": 1, "reused": 1}
    again = merge.insert_if_absent(old, new, ["id"], ["name"])
    assert merge.insert_counts(again, new, ["id"]).first()["created"] == 0
    first = new.dropDuplicates(["id"])
    assert {(r["id"], r["name"]) for r in merge.update_or_insert(old, first.where("id = 2"), ["id"], {"v": None}).collect()} == {(1, "a"), (2, "b")}
    e = "qid string, kind string, label string"
    up = merge.upgraded_entities(spark.createDataFrame([("Q1", "unknown_work", "Q1"), (None, "film", "n")], e), spark.createDataFrame([("Q1", "film", "Real"), ("Q1", "unknown_work", "A")], e))
    assert sorted(map(str, up.collect())) == sorted(map(str, spark.createDataFrame([("Q1", "film", "Real"), (None, "film", "n")], e).collect()))


def test_relational(spark):
    c = spark.createDataFrame([("Q1", 2000, 9), ("Q2", 2000, 8), ("Q3", 2000, 7), ("Q1", 2001, 9), ("Q4", 2001, 1)], "qid string, y int, links int")
    got = {(r["qid"], r["y"]) for r in relational.stratified(c, "y", [2000, 2001], 5, [F.desc("links"), "qid"], "qid").collect()}
    assert got == {("Q1", 2000), ("Q2", 2000), ("Q3", 2000), ("Q4", 2001)}
    out = spark.createDataFrame([("a", "failed", "v"), ("b", "done", "v"), ("c", "done", "w")], "k string, status string, version string")
    assert {r["k"] for r in relational.pending(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), out, "k", ("done",), "v").collect()} == {"a", "c"}


def test_constraints(spark):
    a = spark.createDataFrame([("a1", "s", "p", None, None, "published"), ("a2", "s", "p", "o", None, "odd")], schemas.ASSERTION)
    assert [r["key"] for r in schemas.has_target(a, "assertion_id", "object", "value_json").collect()] == ["a1"]
    assert [tuple(r) for r in schemas.violations(a, "assertion_id", {"status": F.col("status").isin(*schemas.ASSERTION_STATUS)}).collect()] == [("status", "a2")]
    d = spark.createDataFrame([("x", None), ("x", None), ("y", "1"), ("y", "1")], "k string, n string")
    assert [r["k"] for r in schemas.duplicates(d, "k", "n").collect()] == ["y"]
    assert {r["k"] for r in schemas.duplicates(d, "k", "n", null_safe=True).collect()} == {"x", "y"}
    assert [r["rule"] for r in schemas.longer_than(d, "k", k=0).collect()] == ["length_k"] * 4


def test_text_functions_send_no_ascii_to_python(spark, monkeypatch):
    texts = [None, "", " ", "a\x1c\x1fB\x0b\x0c c\r\n", "plain TEXT 9-8", "e\u0301 \u00a0x\u2003y ", "\ufb01 \u00c5ngstr\u00f6m\x85Z"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1)
    got = sorted(df.select("i", text.nfc_collapsed(F.col("t")), text.ascii_tokens(F.col("t"))).collect())
    tokens = lambda x: " ".join(re.findall("[a-z0-9]+", unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower()))
    assert [tuple(r) for r in got] == [(i, None, None) if x is None else (i, " ".join(unicodedata.normalize("NFC", x).split()), tokens(x)) for i, x in enumerate(texts)]
    seen = text.beside_ascii(F.col("t"), F.lit("plain"), lambda c: F.concat(F.lit("sent "), F.coalesce(c, F.lit("nothing"))))
    assert {r[0] for r in df.select(seen).collect()} == {"plain", "sent nothing", *("sent " + x for x in texts if x and not x.isascii())}
    monkeypatch.setattr(text, "ROWS", 3)
    for n in (0, 1, 7):
        assert text.composed.func(pa.array(["a  b", None] * n, pa.string())).to_pylist() == ["a b", None] * n


def test_text_functions_take_names_of_columns(spark):
    df = spark.createDataFrame([("Crème  Brûlée 2",), ("Plain, Text",), (None,)], "t string")
    for f in (text.ascii_tokens, text.nfc_collapsed):
        assert df.select(f("t").alias("x")).collect() == df.select(f(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in df.select(text.ascii_tokens("t").alias("x")).collect()] == ["creme brulee 2", "plain text", None]


def test_closure_has_no_last_level(spark):
    n = 67
    tree = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000)], "child long, parent long")
    got = {tuple(r) for r in lineage.closure(tree, "child", "parent").where("child = 0 or child >= 1000").collect()}
    assert got == {(0, i, i) for i in range(n + 1)} | {(1000, 1000, 0), (1000, 1001, 1), (1001, 1001, 0), (1001, 1000, 1)}


def test_closure_takes_leaves_through_no_round(spark, monkeypatch):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "d"), ("x", "x"), ("both", "a"), ("both", "d"), (None, "d"), ("d", None)] + [(f"leaf{i}", "a") for i in range(300)]
    tables = []
    monkeypatch.setattr(lineage, "cut", lambda df, name: tables.append(checkpoints.cut(df, name)) or tables[-1])
    got = sorted(map(tuple, lineage.closure(spark.createDataFrame(pairs, "child string, parent string"), "child", "parent").where("child is not null").collect()))
    up = {"a": {"a": 0, "b": 1, "c": 2, "d": 3}, "b": {"b": 0, "c": 1, "d": 2}, "c": {"c": 0, "d": 1}, "d": {"d": 0}, "x": {"x": 0, "d": 1}, "both": {"both": 0, "a": 1, "b": 2, "c": 3, "d": 1}}
    up |= {f"leaf{i}": {f"leaf{i}": 0, "a": 1, "b": 2, "c": 3, "d": 4} for i in range(300)}
    assert got == sorted((c, a, n) for c, of in up.items() for a, n in of.items())
    assert all(t.count() < 10 for t in tables[1:])  # the first one is the pairs


def test_templates_of_any_depth(spark):
    for depth in (1, 8, 9, 40):
        wiki = "before " + "{{a|" * depth + "x" + "}}" * depth + " {{open after"
        assert one(spark, text.without_wikitext, wiki) == "before {{open after"
    deep = "{{a|" * 12 + "}}" * 12
    assert one(spark, text.paragraphs_packed, f"One.\n\n{deep}\n\nTwo.") == ["One.\n\nTwo."]
    assert one(spark, text.without_wikitext, None) is None


def test_phrases_are_found_wherever_they_stand(spark):
    rng = random.Random(2)
    words = ["ab", "b", "abc", "ca", "bab", "c"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(60)]
    phrases = [(i, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(80)]
    phrases = [(i, (x[1:-1].strip() or "b") if i % 2 else x) for i, x in phrases]
    got = relational.phrase_matches(spark.createDataFrame(phrases, "i int, p string"), spark.createDataFrame(texts, "d int, t string"), "i", "p", "d", "t", 3)
    assert {tuple(r) for r in got.collect()} == {(i, d) for i, x in phrases for d, y in texts if x in y}
    none = spark.createDataFrame([], "i int, p string")
    assert relational.phrase_matches(none, spark.createDataFrame(texts, "d int, t string"), "i", "p", "d", "t", 3).collect() == []


def test_selection_checks(spark):
    rows = spark.createDataFrame([("Q1",), ("Q22",)], "qid string")
    assert selection.identifiers(rows, "qid", selection.ITEM).count() == 2
    for bad in ("q1", "Q1 }", "Q", None):
        with pytest.raises(Exception, match="not an identifier"):
            selection.identifiers(rows.union(spark.createDataFrame([(bad,)], "qid string")), "qid", selection.ITEM).collect()


def test_answers_need_passages(spark):
    definitions = spark.createDataFrame([("q1", "lead"), ("q2", "plot/end")], "question string, locator string")
    passages = spark.createDataFrame([("lead", 1), ("lead", 2)], "locator string, passage int")
    assert evidence.answer_evidence(definitions.where("question = 'q1'"), passages, "locator").count() == 2
    assert [r["locator"] for r in evidence.missing_locators(definitions, passages, "locator").collect()] == ["plot/end"]
    with pytest.raises(Exception, match="no passage at plot/end"):
        evidence.answer_evidence(definitions, passages, "locator").collect()


def test_comparison_errors(spark, two):
    f, g, c = two
    assert signals.compared(1, 2, f, g, c, people(spark)).count() == 3
    with pytest.raises(ValueError):
        signals.compared(1, 1, f, g, c, people(spark))
    with pytest.raises(LookupError):
        signals.compared(1, 99, f, g, c, people(spark))


def test_updates_take_one_row_of_a_key(spark):
    old = spark.createDataFrame([(1, "a")], "id int, v string")
    new = spark.createDataFrame([(1, "c"), (1, "b"), (2, "e"), (2, "d")], "id int, v string")
    assert sorted(map(tuple, merge.update_or_insert(old, new, ["id"], {"v": None}).collect())) == [(1, "b"), (2, "d")]


def test_upsert_policies(spark):
    old = spark.createDataFrame([("Q1", "One", "2000-01-01", 90, "US"), ("Q2", "Two", None, None, None)], "wikidata_id string, title string, release_date string, runtime int, countries string")
    new = spark.createDataFrame([("Q1", "Uno", None, 0, ""), ("Q2", "Dos", "2001-01-01", 95, "IN"), ("Q3", "Tres", None, 0, ""), ("Q3", "Three", None, 1, "")], old.schema)
    got = {r["wikidata_id"]: tuple(r)[1:] for r in upserts.upsert("film", old, new, "title").collect()}
    assert got == {"Q1": ("One", "2000-01-01", 90, "US", "reused"), "Q2": ("Two", "2001-01-01", 95, "IN", "reused"), "Q3": ("Three", None, 1, "", "created")}
    policy = "source_id int, mode string, rate int, notes string"
    after = upserts.upsert("access_policy", spark.createDataFrame([(1, "api", 30, "n")], policy), spark.createDataFrame([(1, "api", None, "x")], policy))
    assert [tuple(r) for r in after.collect()] == [(1, "api", None, "n", "reused")]
    keys = "object_id int, revision string, content_hash string, url string"
    snapshot = spark.createDataFrame([(1, None, "h", "u")], keys)  # a null revision is found again
    assert upserts.counters(upserts.upsert("snapshot", snapshot, snapshot)).first().asDict() == {"created": 0, "reused": 1}
    assert upserts.upsert("collection", spark.createDataFrame([], "code string"), spark.createDataFrame([("a",), ("a",)], "code string")).collect()[0].asDict() == {"code": "a", "disposition": "created"}


def test_folded_lists_ignore_nulls(spark):
    rows = spark.createDataFrame([("f", 1, "old", None, "US"), ("f", 2, "new", "2001", None), ("f", 2, "new", "2001", "IN"), ("g", 1, "only", None, None)], "film string, n int, title string, date string, place string")
    got = {r["film"]: r.asDict(recursive=True) for r in folding.folded_records(rows, "film", ["n"], ["title"], {"places": ("place",), "pairs": ("date", "place")}, "date", "place").collect()}
    assert got["f"] == {"film": "f", "title": "new", "first_release": "2001", "places": ["IN", "US"], "pairs": [{"date": "2001", "place": "IN"}], "releases": [{"date": "2001", "places": ["IN"]}]}
    assert (got["g"]["title"], got["g"]["first_release"], got["g"]["places"], got["g"]["releases"]) == ("only", None, None, None)
