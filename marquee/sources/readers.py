"""Readers of the catalogue's inputs: archives, manifests, recorded payloads."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator
from itertools import islice
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.values import map_labels

ARCHIVE_FIELDS = ("wikipedia_movie_id", "freebase_movie_id", "title", "release_date", "box_office", "runtime", "languages", "countries", "genres")


def tar_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(archive, line_no, value) of the members of tar.gz archives whose name ends
    so; lines are numbered through an archive, from 0.

    Archives come through the binary file source, one task each (2 GB packed at
    most, as that source has it); the member is unpacked line by line and never
    held as a whole."""

    def numbered(tar: tarfile.TarFile) -> Iterator[tuple[int, str]]:
        files = (tar.extractfile(m) for m in tar if m.isfile() and m.name.endswith(member))
        yield from enumerate(x.decode("utf-8", "replace").rstrip("\r\n") for f in files for x in f)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as tar:
                    lines = numbered(tar)
                    while batch := list(islice(lines, 10_000)):
                        yield pd.DataFrame(batch, columns=["line_no", "value"]).assign(archive=path)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, line_no long, value string")


def archive_rows(lines: DataFrame) -> DataFrame:
    """Film metadata of tab-separated lines with exactly nine fields."""
    f = F.split("value", "\t", -1)
    rows = lines.withColumn("f", f).where(F.size("f") == len(ARCHIVE_FIELDS)).select(*[F.col("f")[i].alias(n) for i, n in enumerate(ARCHIVE_FIELDS)])
    for c in ("languages", "countries", "genres"):
        rows = rows.withColumn(c, map_labels(F.col(c)))
    return rows


def english_with_plot(rows: DataFrame, plots: DataFrame) -> DataFrame:
    return rows.where(F.array_contains("languages", "English Language")).join(plots.select(F.col("key").alias("wikipedia_movie_id"), F.col("text").alias("plot")), "wikipedia_movie_id")


def keyed_text(lines: DataFrame) -> DataFrame:
    """(key, text) of lines key<TAB>text; the last line of a key stays, in the
    order of the archives' names and the lines in them; lines without a tab go."""
    parts = lines.withColumn("f", F.split("value", "\t", 2)).where(F.size("f") == 2)
    return parts.groupBy(F.col("f")[0].alias("key")).agg(F.max_by(F.col("f")[1], F.struct("archive", "line_no")).alias("text"))


def title_years(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(position, title, release_year) of a CSV with Series_Title and
    Released_Year; rows without a title or a year of digits go."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    names = [c.lstrip("﻿").strip() for c in rows.columns]
    missing = {"Series_Title", "Released_Year"} - set(names)
    if missing:
        raise ValueError(f"the file lacks {sorted(missing)}")
    rows = rows.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start")).toDF(*names, "__file")
    title, year = F.trim("Series_Title"), F.trim("Released_Year")
    rows = rows.where((title != "") & year.rlike(r"^\d+$")).select(title.alias("title"), year.cast("int").alias("release_year"), "__file")
    rows = in_file_order(rows, "position").select("position", "title", "release_year")
    return rows.where(F.col("position") <= limit) if limit else rows


def in_file_order(rows: DataFrame, name: str) -> DataFrame:
    """Rows (..., __file) numbered from 1 in the order of the files and the lines
    in them: each split of a file numbers its own behind the counts of those
    before it, which are as many as the splits."""
    rows = rows.withColumn("__line", F.monotonically_increasing_id()).withColumnRenamed("__file", "__part")
    counts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    turn = F.row_number().over(Window.partitionBy("__part").orderBy("__line"))
    return rows.withColumn("__turn", turn).join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__turn")).cast("int")).drop("__line", "__part", "__turn", "__before")


ENTRY = T.StructType([T.StructField(n, T.IntegerType() if n in ("position", "release_year") else T.StringType()) for n in ("position", "title", "release_year", "wikidata_id", "wikipedia_title", "evidence_url", "reason")])


def manifest(spark: SparkSession, path: str, tag: str, field: str = "entries", tag_field: str = "schema", limit: int | None = None) -> DataFrame:
    """The entries of JSON manifests, with ``limit`` the first of each. A file
    without the expected schema tag is an error."""
    doc = spark.read.option("multiLine", True).schema(T.StructType([T.StructField(tag_field, T.StringType()), T.StructField(field, T.ArrayType(ENTRY))])).json(path)
    if not doc.where(~F.col(tag_field).eqNullSafe(tag)).isEmpty() or doc.isEmpty():
        raise ValueError(f"not a manifest of {tag}")
    return doc.select(F.inline(F.slice(field, 1, limit) if limit else F.col(field)))


def bindings(rows: DataFrame, *names: str) -> DataFrame:
    """Columns of recorded query bindings {"name": {"value": "..."}}."""
    parsed = rows.withColumn("b", F.from_json("value", "map<string,struct<value:string>>"))
    return parsed.select(*[F.col("b")[n]["value"].alias(n) for n in names])


def entities(payloads: DataFrame) -> DataFrame:
    """(qid, entity) of recorded entity payloads, whether the entities come as
    a map or a list; missing ones go."""
    as_map = F.from_json(F.get_json_object("value", "$.entities"), "map<string,string>")
    as_list = F.from_json(F.get_json_object("value", "$.entities"), "array<string>")
    one = F.explode(F.coalesce(F.map_values(as_map), as_list))
    rows = payloads.select(one.alias("entity")).withColumn("qid", F.get_json_object("entity", "$.id"))
    return rows.where(F.col("qid").isNotNull() & F.get_json_object("entity", "$.missing").isNull()).select("qid", "entity")


def statements(entities_: DataFrame) -> DataFrame:
    """(qid, property, locator, value, qualifiers, rank): every statement of
    every claim, with its place."""
    claims = F.from_json(F.get_json_object("entity", "$.claims"), "map<string,array<string>>")
    rows = entities_.select("qid", F.explode(claims).alias("property", "list")).select("qid", "property", F.posexplode("list").alias("i", "s"))
    return rows.select("qid", "property", F.concat(F.lit("claims."), "property", F.lit("["), F.col("i").cast("string"), F.lit("]")).alias("locator"), F.get_json_object("s", "$.mainsnak").alias("value"), F.get_json_object("s", "$.qualifiers").alias("qualifiers"), F.get_json_object("s", "$.rank").alias("rank"))


def page_facts(pages: DataFrame) -> DataFrame:
    """Up to four facts of a recorded page payload, those that are set."""
    paths = {"title": "$.page.title", "wikibase_item": "$.page.pageprops.wikibase_item", "revision": "$.page.revisions[0].revid", "page_id": "$.page.pageid"}
    pairs = F.array(*[F.struct(F.lit(k).alias("property"), F.get_json_object("value", p).alias("value")) for k, p in paths.items()])
    return pages.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null")


def page_records(payloads: DataFrame) -> DataFrame:
    """(asked, page_id, title, revision, wikibase_item, url) of recorded page
    look-ups: the stable record of each page that is there. A title that was
    normalised or redirected on the way keeps the name that was asked for."""
    hops = "array<struct<`from`:string,`to`:string>>"
    q = F.from_json("value", f"query struct<normalized:{hops},redirects:{hops},pages:array<struct<pageid:long,title:string,missing:boolean,pageprops:struct<wikibase_item:string>,revisions:array<struct<revid:long>>>>>")["query"]
    rows = payloads.select(q.alias("q")).select("q.normalized", "q.redirects", F.explode("q.pages").alias("p")).where(~F.coalesce("p.missing", F.lit(False)) & F.col("p.pageid").isNotNull())

    def back(c: Column, hops_: Column) -> Column:
        met = F.filter(F.coalesce(hops_, F.array().cast(hops)), lambda h: h["to"] == c)
        return F.coalesce(F.get(met, 0)["from"], c)

    asked = back(back(F.col("p.title"), F.col("redirects")), F.col("normalized"))
    url = F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.translate("p.title", " ", "_"))
    return rows.select(asked.alias("asked"), F.col("p.pageid").alias("page_id"), F.col("p.title").alias("title"), F.get("p.revisions", 0)["revid"].alias("revision"), F.col("p.pageprops.wikibase_item").alias("wikibase_item"), url.alias("url"))


def link_only_works(works: DataFrame, films: DataFrame) -> DataFrame:
    """Violations (work, rule) of the works' own fields; critical_works has all
    rules of a manifest."""
    w = works.withColumn("work", F.coalesce("external_id", F.lit("?")))
    rules = F.array_compact(
        F.array(
            *[F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"empty_{c}")) for c in ("external_id", "title", "canonical_url")],
            F.when(~F.coalesce(F.col("rights_scope") == "metadata_link_only", F.lit(False)), F.lit("rights_scope")),
            F.when(F.col("published_on").isNotNull() & F.col("published_on").try_cast("date").isNull(), F.lit("published_on")),
            F.when(~F.coalesce(F.size("subjects") > 0, F.lit(False)), F.lit("no_subject")),
        )
    )
    own = w.select("work", F.explode(rules).alias("rule"))
    subjects = w.select("work", F.explode("subjects").alias("s"))
    unknown = subjects.join(films.select(F.col("qid").alias("known")), F.col("s.wikidata_id") == F.col("known"), "left_anti").select("work", F.lit("unknown_subject").alias("rule"))
    return own.union(unknown).distinct()


ROLES = ("primary", "comparison", "context")


def critical_works(works: DataFrame, films: DataFrame) -> DataFrame:
    """Violations (work, rule) of a manifest of critical works, with those of
    link_only_works; an empty result means that all of it may be taken. The
    columns ``source`` (a struct) and ``authors`` (an array of strings) and those
    of the kind, licence and language have to be there."""
    filled = lambda c: F.coalesce(c.rlike(r"\S"), F.lit(False))
    rules = F.array_compact(
        F.array(
            *[F.when(~filled(F.col(c)), F.lit(f"empty_{c}")) for c in ("work_kind", "work_license", "language_code")],
            *[F.when(~filled(F.col("source")[c]), F.lit(f"empty_source_{c}")) for c in ("name", "url", "source_type", "license", "rights_status")],
            F.when(~F.coalesce(F.forall("authors", filled), F.lit(False)), F.lit("authors")),
            F.when(F.exists("subjects", lambda s: ~F.coalesce(s["role"].isin(*ROLES), F.lit(False))), F.lit("subject_role")),
        )
    )
    more = works.select(F.coalesce("external_id", F.lit("?")).alias("work"), F.explode(rules).alias("rule"))
    return link_only_works(works, films).union(more).distinct()


def robots_allow(status: int | None, body: str | None, agent: str, url: str) -> bool:
    """Whether a page may be fetched; fails closed: without a readable file
    (status 200) nothing may."""
    if status != 200:
        return False
    rules = RobotFileParser()
    rules.parse((body or "").splitlines())
    return rules.can_fetch(agent, url)


def access_decisions(pages: DataFrame, sites: DataFrame, agent: str) -> DataFrame:
    """``pages (url)``, ``sites (site, status, body)`` (recorded robots.txt files,
    site being scheme and host) -> (url, allowed, reason). Rules are read once for each
    site of a batch; a page whose site was never asked is not allowed."""

    @F.pandas_udf("boolean")
    def allowed(status: pd.Series, body: pd.Series, url: pd.Series) -> pd.Series:
        parsed: dict[str, RobotFileParser] = {}
        out = []
        for s, b, u in zip(status, body, url, strict=True):
            if s != 200 or u is None:
                out.append(False)
                continue
            if (b or "") not in parsed:
                rules = parsed[b or ""] = RobotFileParser()
                rules.parse((b or "").splitlines())
            out.append(parsed[b or ""].can_fetch(agent, u))
        return pd.Series(out, dtype=bool)

    site = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1)
    known = sites.groupBy("site").agg(F.max(F.struct("status", "body")).alias("s")).select(F.col("site").alias("__site"), "s.status", "s.body")
    rows = pages.select("url").join(known, site == F.col("__site"), "left").withColumn("allowed", allowed("status", "body", "url"))
    reason = F.when(F.col("status").isNull(), "robots.txt was not retrieved").when(F.col("status") != 200, F.concat(F.lit("robots.txt returned HTTP "), F.col("status").cast("string"))).when(F.col("allowed"), "allowed by robots.txt").otherwise("disallowed by robots.txt")
    return rows.select("url", "allowed", reason.alias("reason"))


def critical_manifest_json(text: str) -> dict:
    doc = json.loads(text)
    if not isinstance(doc.get("works"), list) or not doc.get("manifest_version"):
        raise ValueError("not a manifest of critical works")
    return doc
