"""Readers, sinks and the streaming ingest on small files."""

import gzip
import io
import json
import shutil
import tarfile

import pytest
from pyspark.sql import functions as F

from marquee.operators import relational, selection
from marquee.sources import readers, sinks
from marquee.streaming import ingest


def test_archive(spark, tmp_path):
    meta = "\n".join(["1\t/m/1\tFilm\t1999\t5\t90\t{\"/m/l\": \"English Language\"}\t{\"/m/c\": \"India\"}\t{\"/m/g\": \"Drama\", \"/m/h\": \"Action\"}", "2\t/m/2\tShort", "3\t/m/3\tOther\t\t\t\tbad\t{}\t{}"])
    plots = "1\told plot\nno tab\n1\tnew\tplot\n"
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, body in (("x/movie.metadata.tsv", meta), ("x/plot_summaries.txt", plots)):
            info = tarfile.TarInfo(name)
            info.size = len(body.encode())
            t.addfile(info, io.BytesIO(body.encode()))
    rows = readers.archive_rows(readers.tar_lines(spark, str(tmp_path / "a.tar.gz"), "metadata.tsv"))
    assert {(r["wikipedia_movie_id"], tuple(r["genres"])) for r in rows.collect()} == {("1", ("Action", "Drama")), ("3", ())}
    text = readers.keyed_text(readers.tar_lines(spark, str(tmp_path / "a.tar.gz"), "plot_summaries.txt"))
    assert [tuple(r) for r in text.collect()] == [("1", "new\tplot")]
    assert [r["plot"] for r in readers.english_with_plot(rows, text).collect()] == ["new\tplot"]
    assert gzip.open(tmp_path / "a.tar.gz").read(1)


def test_last_line_in_a_later_archive(spark, tmp_path):
    rows = [("x/plot_summaries.txt", f"{i}\t{text}") for i in range(200) for text in ("earlier", "last")]
    folder = str(tmp_path / "archives")
    # 21 bytes: archives end between the lines of a key, and lines start anew
    assert sinks.write_archives(spark.createDataFrame(rows, "member string, value string").coalesce(1), folder, 21) > 50
    text = readers.keyed_text(readers.tar_lines(spark, folder, "plot_summaries.txt"))
    assert {(r["key"], r["text"]) for r in text.collect()} == {(str(i), "last") for i in range(200)}


def test_title_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Series_Title,Released_Year,IMDB_Rating\nOne,1999,8\n ,2000,7\nTwo,PG,7\nThree, 2001 ,6\n", encoding="utf-8")
    assert [tuple(r) for r in readers.title_years(spark, str(tmp_path / "a.csv")).collect()] == [(1, "One", 1999), (2, "Three", 2001)]
    assert readers.title_years(spark, str(tmp_path / "a.csv"), limit=1).count() == 1
    (tmp_path / "b.csv").write_text("Title,Year\nx,1\n")
    with pytest.raises(ValueError):
        readers.title_years(spark, str(tmp_path / "b.csv"))


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"schema": "v1", "entries": [{"position": 1, "title": "A", "release_year": 1999}, {"position": 2, "title": "B", "wikidata_id": "Q2"}]}, indent=1))
    assert [(r["position"], r["wikidata_id"]) for r in readers.manifest(spark, str(tmp_path / "m.json"), "v1").collect()] == [(1, None), (2, "Q2")]
    assert readers.manifest(spark, str(tmp_path / "m.json"), "v1", limit=1).count() == 1
    with pytest.raises(ValueError):
        readers.manifest(spark, str(tmp_path / "m.json"), "v2")
    (tmp_path / "n.json").write_text(json.dumps({"schema": "other", "entries": []}))
    with pytest.raises(ValueError):  # one of two files
        readers.manifest(spark, str(tmp_path), "v1")


def lines(spark, *values):
    return spark.createDataFrame([(json.dumps(v),) for v in values], "value string")


def test_recorded_payloads(spark):
    b = readers.bindings(lines(spark, {"film": {"value": "http://x/Q1"}, "runtime": {"value": "90"}}, {"film": {"value": "y"}}), "film", "runtime")
    assert [tuple(r) for r in b.collect()] == [("http://x/Q1", "90"), ("y", None)]
    claim = {"mainsnak": {"datavalue": {"value": {"id": "Q5"}}}, "rank": "preferred"}
    e = readers.entities(lines(spark, {"entities": {"Q1": {"id": "Q1", "claims": {"P57": [claim, claim]}}, "Q9": {"id": "Q9", "missing": ""}}}, {"entities": [{"id": "Q2"}]}))
    assert sorted(r["qid"] for r in e.collect()) == ["Q1", "Q2"]
    assert [(r["locator"], r["rank"]) for r in readers.statements(e).orderBy("locator").collect()] == [("claims.P57[0]", "preferred"), ("claims.P57[1]", "preferred")]
    facts = readers.page_facts(lines(spark, {"page": {"title": "T", "pageid": 7, "revisions": [{"revid": 3}]}}))
    assert {tuple(r) for r in facts.collect()} == {("title", "T"), ("page_id", "7"), ("revision", "3")}


def test_works_and_robots(spark):
    films = spark.createDataFrame([("Q1",)], "qid string")
    schema = "external_id string, title string, canonical_url string, rights_scope string, published_on string, subjects array<struct<wikidata_id:string,role:string>>"
    w = spark.createDataFrame([("a", "T", "u", "metadata_link_only", "2001-01-01", [("Q1", "main")]), ("b", " ", "u", "full", "01/2001", [("Q9", "main")]), ("c", "T", "u", "metadata_link_only", None, [])], schema)
    assert {tuple(r) for r in readers.link_only_works(w, films).collect()} == {("b", "empty_title"), ("b", "rights_scope"), ("b", "published_on"), ("b", "unknown_subject"), ("c", "no_subject")}
    body = "User-agent: *\nAllow: /private/open\nDisallow: /private\n\nUser-agent: mybot\nDisallow: /\n"
    assert readers.robots_allow(200, body, "other", "/x") and not readers.robots_allow(200, body, "other", "/private/x") and readers.robots_allow(200, body, "other", "/private/open/x")
    assert not readers.robots_allow(200, body, "MyBot/1.0", "/x") and not readers.robots_allow(503, "", "x", "/") and not readers.robots_allow(404, "", "x", "/")
    sites = spark.createDataFrame([("https://a", 200, body), ("https://b", 404, ""), ("https://c", 200, None)], "site string, status int, body string")
    pages = spark.createDataFrame([("https://a/x",), ("https://a/private/x",), ("https://a/private/open/1",), ("https://b/x",), ("https://c/x",), ("https://d/x",), (None,)], "url string")
    told = {r["url"]: (r["allowed"], r["reason"]) for r in readers.access_decisions(pages, sites, "other/2").collect()}
    yes, no = (True, "allowed by robots.txt"), (False, "disallowed by robots.txt")
    assert told == {"https://a/x": yes, "https://a/private/x": no, "https://a/private/open/1": yes, "https://b/x": (False, "robots.txt returned HTTP 404"), "https://c/x": yes, "https://d/x": (False, "robots.txt was not retrieved"), None: (False, "robots.txt was not retrieved")}
    with pytest.raises(ValueError):
        readers.critical_manifest_json('{"works": 1}')


def test_critical_works(spark):
    films = spark.createDataFrame([("Q1",)], "qid string")
    schema = "external_id string, title string, canonical_url string, rights_scope string, published_on string, work_kind string, work_license string, language_code string, authors array<string>, source struct<name:string,url:string,source_type:string,license:string,rights_status:string>, subjects array<struct<wikidata_id:string,role:string>>"
    own = ("T", "u", "metadata_link_only", None)
    good = ("n", "u", "t", "l", "r")
    rows = [
        ("a", *own, "essay", "l", "en", ["A B"], good, [("Q1", "primary"), ("Q1", "context")]),
        ("b", *own, " ", "l", None, ["A", " "], good, [("Q1", "main")]),
        ("c", *own, "essay", "l", "en", None, ("n", "", "t", None, "r"), [("Q1", None)]),
        ("d", *own, "essay", "", "en", [None], None, [("Q9", "primary")]),
    ]
    want = {("b", "empty_work_kind"), ("b", "empty_language_code"), ("b", "authors"), ("b", "subject_role"), ("c", "authors"), ("c", "empty_source_url"), ("c", "empty_source_license"), ("c", "subject_role"), ("d", "empty_work_license"), ("d", "authors"), ("d", "unknown_subject")}
    want |= {("d", f"empty_source_{c}") for c in ("name", "url", "source_type", "license", "rights_status")}
    assert {tuple(r) for r in readers.critical_works(spark.createDataFrame(rows, schema), films).collect()} == want


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([("s", "one"), ("s", "two"), ("s", "one"), ("t", None)], "source string, body string")
    folder = str(tmp_path / "blobs")
    first = sinks.store_payloads(p, folder).collect()
    assert {r["disposition"] for r in first} == {"created"} and len(first) == 2
    again = sinks.store_payloads(p.union(spark.createDataFrame([("s", "three")], p.schema)), folder)
    assert sorted(r["disposition"] for r in again.collect()) == ["created", "reused", "reused"]
    assert len(list((tmp_path / "blobs").rglob("*.json"))) == 3 and not list((tmp_path / "blobs").rglob("_*"))
    uris = again.select("uri").union(spark.createDataFrame([(f"file://{folder}/none.json",), (None,), ("odd",)], "uri string"))
    (tmp_path / "blobs" / "s" / "forged.json").write_text("x")
    uris = uris.union(spark.createDataFrame([(f"file://{folder}/s/forged.json",)], "uri string"))
    read = sinks.read_payloads(uris).collect()
    assert {bytes(r["body"]).decode() for r in read if r["available"]} == {"one", "two", "three"} and sum(not r["available"] for r in read) == 4
    text, sha = sinks.manifest_text({"b": 1, "a": "é"})
    assert text.startswith('{\n  "a": "é"') and text.endswith("\n") and len(sha) == 64
    m = sinks.title_manifest(spark.createDataFrame([(2, "b"), (1, "a")], "position int, title string"), "v1", "h", rule="first")
    assert [e["title"] for e in m["entries"]] == ["a", "b"] and m["method"] == {"rule": "first"}
    assert spark.read.parquet(sinks.next_version(p, str(tmp_path / "t"))).count() == 4
    assert json.loads(sinks.report_text(spark.range(1).selectExpr("id", "date'2001-02-03' AS d"))) == {"id": 0, "d": "2001-02-03"}
    row = sinks.outcomes(spark.createDataFrame([("ok",), ("ok",), ("bad",)], "status string"), ("ok", "failed")).first()
    assert (row["total"], row["ok"], row["failed"]) == (3, 2, 0) and row["counted_at"] is not None


def test_ingest_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    paths = [str(tmp_path / x) for x in ("table", "ledger", "ckpt")]

    def drain(run):
        ingest.ingest(spark, str(src), "id long, v string", ["id"], *paths, run).awaitTermination()

    (src / "a.json").write_text('{"id": 1, "v": "a"}\n{"id": 2, "v": "b"}\n')
    (src / "b.json").write_text('{"id": 2, "v": "c"}\n{"id": 3, "v": "d"}\n')
    drain("r1")
    drain("r1")
    (src / "c.json").write_text('{"id": 3, "v": "e"}\n')
    drain("r2")
    assert sorted(r["id"] for r in spark.read.parquet(paths[0]).collect()) == [1, 2, 3]
    told = {r["run"]: (r["batches"], r["seen"], r["created"], r["reused"]) for r in ingest.runs(spark, paths[1]).collect()}
    assert told == {"r1": (2, 4, 3, 1), "r2": (1, 1, 0, 1)}


def test_ledger_of_a_failed_batch(spark, tmp_path, monkeypatch):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"id": 1, "v": "a"}\n')
    args = (spark, str(src), "id long, v string", ["id"], *[str(tmp_path / x) for x in ("table", "ledger", "ckpt")])

    def broken(*_):
        raise ValueError("broken")

    with monkeypatch.context() as m:
        m.setattr(ingest, "new_rows", broken)
        with pytest.raises(Exception, match="broken"):
            ingest.ingest(*args, "r1").awaitTermination()
    assert [(r["run"], r["batches"], r["status"]) for r in ingest.runs(spark, args[5]).collect()] == [("r1", 0, "failed")]
    ingest.ingest(*args, "r2").awaitTermination()
    assert sorted(r["status"] for r in spark.read.parquet(args[5]).collect()) == ["complete", "failed", "running", "running"]
    assert {(r["run"], r["batches"], r["status"]) for r in ingest.runs(spark, args[5]).collect()} == {("r1", 0, "failed"), ("r2", 1, "complete")}


def test_ledger_of_a_repeated_batch(spark, tmp_path):
    path = str(tmp_path / "ledger")
    spark.createDataFrame([("r", 0, 3, 0, 3, "complete", None), ("r", 0, 3, 2, 1, "complete", None), ("r", 0, 0, 0, 0, "running", None)], ingest.LEDGER).write.parquet(path)
    assert [tuple(r) for r in ingest.runs(spark, path).collect()] == [("r", 1, 3, 2, 1, "complete", None)]


def test_windowed_counts(spark, tmp_path):
    src = tmp_path / "ev"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T0{h}:30:00", "k": "x"}) for h in (1, 1, 2)))
    stream = spark.readStream.schema("ts timestamp, k string").json(str(src))
    q = ingest.windowed_counts(stream, "ts", "k").writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["n"] for r in spark.table("wc").orderBy(F.col("window.start")).collect()] == [2, 1]


def test_paced_client():
    from marquee.sources.endpoint import PacedClient, Unavailable, pages

    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    def client(*answers):
        it = iter(answers)
        return PacedClient(lambda q: next(it), sleep=sleep, clock=lambda: now[0])

    ok = (200, {}, '{"results": {"bindings": [{"a": {"value": "1"}}]}}')
    assert client((503, {}, ""), (502, {}, ""), ok).bindings("q") == [{"a": {"value": "1"}}]
    assert client((429, {"Retry-After": "7"}, ""), ok).query("q") and 7.0 in slept
    for answers in ([(403, {}, "")], [(503, {}, "")] * 4, [(429, {}, "")] * 4, [(500, {}, "")]):
        with pytest.raises(Unavailable):
            client(*answers).query("q")
    assert list(pages(["a", "b", "c"], 2)) == [["a", "b"], ["c"]]


def test_recorded_source(spark, tmp_path):
    from marquee.sources.endpoint import RecordedSource

    spark.dataSource.register(RecordedSource)
    (tmp_path / "r.json").write_text('{"results": {"bindings": [{"film": {"value": "Q1"}}, {"film": {"value": "Q2"}}]}}\n')
    rows = spark.read.format("recorded_bindings").option("path", str(tmp_path / "r.json")).load()
    assert [r[0] for r in readers.bindings(rows, "film").collect()] == ["Q1", "Q2"]


def test_bibliography(spark):
    from marquee.operators import bibliography as b

    raw = lines(spark, {"DOI": " 10.1/X ", "title": ["T"], "abstract": "secret", "author": [{"given": "A", "family": "B"}, {"family": "C"}], "published-print": {"date-parts": [[2001]]}}, {"title": ["no doi"]})
    w = raw.select(F.from_json("value", b.REGISTERED).alias("w")).select("w.*")
    got = b.registered_works(w).collect()
    assert len(got) == 1 and got[0]["doi"] == "10.1/x" and got[0]["authors"] == ["A B", "C"] and got[0]["url"] == "https://doi.org/10.1/x" and "abstract" not in got[0].asDict()
    raw = lines(spark, {"id": "https://openalex.org/W5/", "title": "On The Great Film", "abstract_inverted_index": {"great": [1], "the": [0], "film": [2]}, "authorships": [{"author": {"display_name": "X"}}, {"author": {}}], "primary_location": {"license": "cc"}})
    idx = b.indexed_works(raw.select(F.from_json("value", b.INDEXED).alias("w")).select("w.*"))
    row = idx.first()
    assert (row["work_id"], row["abstract"], row["authors"], row["open_access"]["license"]) == ("W5", "the great film", ["X"], "cc")
    entities = spark.createDataFrame([(1, "The Great Film"), (2, "Up"), (3, "Nowhere To Be"), (4, "Broken Title")], "entity_id long, title string")
    works = idx.select((F.substring("work_id", 2, 9).cast("long") - 4).alias("entity_id"), "work_id", "title", "abstract")
    held = spark.createDataFrame([], "entity_id long, work_id string")
    failed = spark.createDataFrame([(4,)], "entity_id long")
    out, fresh = b.discovered(entities, works, held, failed)
    assert {(r["entity_id"], r["status"]) for r in out.collect()} == {(1, "complete"), (2, "skipped_ambiguous"), (3, "no_candidates"), (4, "failed")}
    assert [(r["method"], r["score"]) for r in fresh.collect()] == [("title_and_abstract_phrase", 1.0)]
    assert b.discovered(entities, works, fresh.select("entity_id", "work_id"), failed)[1].count() == 0
    assert b.discovery_report(entities, out, fresh).first()["collection_films"] == 4


def test_titles_beyond_ascii_are_discovered(spark):
    from marquee.operators import bibliography as b

    entities = spark.createDataFrame([(1, "Les Misérables"), (2, "Plain Long Title"), (3, "Été"), (4, None)], "entity_id long, title string")
    works = spark.createDataFrame([(1, "W1", "On les miserables", None), (2, "W2", "Another", "of a plain, long title")], "entity_id long, work_id string, title string, abstract string")
    out, fresh = b.discovered(entities, works, spark.createDataFrame([], "entity_id long, work_id string"))
    assert {r["entity_id"]: r["status"] for r in out.collect()} == {1: "complete", 2: "complete", 3: "skipped_ambiguous", 4: "no_candidates"}
    assert {(r["entity_id"], r["method"]) for r in fresh.collect()} == {(1, "title_phrase"), (2, "title_and_abstract_phrase")}


def test_one_writer(spark, tmp_path):
    table = str(tmp_path / "table")
    with ingest.exclusive(spark, table):
        with pytest.raises(ingest.Busy), ingest.exclusive(spark, table):
            pass
    with ingest.exclusive(spark, table):
        pass
    assert not list(tmp_path.glob("*.lock"))


def test_command_line(spark, sf_dir):
    from marquee.__main__ import main

    out = io.StringIO()
    assert main(["q3_editions", sf_dir], out) == 0
    assert {"code", "display_name", "rank"} == set(json.loads(out.getvalue().splitlines()[0]))
    assert main(["none"], out) == 2 and "q1_health" in out.getvalue()


def test_keys_are_state_of_the_stream(spark, tmp_path):
    """Another start finds the state; a batch that comes again replaces its rows,
    and nothing of the table is read."""
    source, table, progress = (str(tmp_path / n) for n in ("in", "table", "progress"))
    schema = "id long, name string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
    put([(1, "a"), (2, "b"), (2, "b"), (None, "n")])
    ingest.keyed(spark, source, schema, ["id"], table, progress).awaitTermination()
    shutil.rmtree(table)  # what a batch adds does not depend on the table
    put([(2, "again"), (3, "c"), (None, "n2")])
    q = ingest.keyed(spark, source, schema, ["id"], table, progress)
    q.awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(table).select("id", "name").collect()] == [(3, "c")]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 4


def test_late_and_repeated_rows(spark, tmp_path):
    source, table, progress = (str(tmp_path / n) for n in ("in", "table", "progress"))
    schema = "id string, at timestamp, kind string"
    batches = [[("a", "2024-01-01 00:10:00", "x"), ("a", "2024-01-01 00:10:00", "x"), ("b", "2024-01-01 00:20:00", "x")], [("c", "2024-01-01 09:00:00", "x")], [("late", "2024-01-01 00:30:00", "x"), ("c", "2024-01-01 09:00:00", "x"), ("d", "2024-01-01 15:00:00", "x")], [("e", "2024-01-02 00:00:00", "x")]]
    for rows in batches:
        spark.createDataFrame(rows, "id string, at string, kind string").coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        out = ingest.late_counts(stream, "at", "kind", "id")
        out.writeStream.format("parquet").option("path", table).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    got = {(r["window"]["start"].hour, r["n"]) for r in spark.read.parquet(table).collect()}
    assert got == {(0, 2), (9, 1), (15, 1)}


def test_archives_of_tasks(spark, tmp_path):
    rows = [("x/a.tsv", f"{i}\té") if i % 3 else ("x/b.txt", None if i % 2 else str(i)) for i in range(900)]
    folder = str(tmp_path / "archives")
    assert sinks.write_archives(spark.createDataFrame(rows, "member string, value string").repartition(3), folder, 1500) > 3
    got = [r["value"] for name in ("a.tsv", "b.txt") for r in readers.tar_lines(spark, folder, name).collect()]
    assert sorted(got) == sorted(v or "" for _, v in rows)
    assert sinks.write_archives(spark.createDataFrame([], "member string, value string"), folder) in (0, 1, 2)


def test_equal_requests_are_answered_once(spark):
    entries = spark.createDataFrame([(1, "A", 2001), (2, "A", 2001), (3, "A", None), (4, None, 2001), (5, "B", 2001)], "position long, title string, release_year int")
    answers = spark.createDataFrame([("A", "en", 1, "Q2"), ("A", "en", 1, "Q1"), ("A", "wikipedia", 0, "Q1"), ("A 2001 film", "title_year", 0, "Q3"), ("A", "en", 10, "Q4"), ("A", "en", 0, None)], "query string, route string, place int, qid string")
    assert selection.requests(entries).count() == 4
    got = {tuple(r) for r in selection.candidates(entries, answers).collect()}
    own = {(1, "Q2", 0, 1), (1, "Q1", 0, 1), (1, "Q3", 3, 0)}
    assert got == own | {(2, *r[1:]) for r in own} | {(3, "Q2", 0, 1), (3, "Q1", 0, 1)}


def test_ties_of_candidates_go_to_the_smaller_item(spark):
    entries = spark.createDataFrame([(1, 2001)], "position long, release_year int")
    told = [(1, q, 0, 1, True, [2001], 1, None) for q in ("Q5", "Q4", "Q9", "Q3", "Q7")]
    rows = spark.createDataFrame(told, "position long, qid string, route int, place int, is_film boolean, years array<int>, title_score int, enwiki string")
    assert [r["qid"] for r in relational.resolved_candidates(entries, rows.coalesce(1)).collect()] == ["Q3"]
