"""Queries of the evidence core, the folding of rows, selections, readers and
sinks, and their SQL. Where a statement is given in braces, Spark and DuckDB
read the same text as the operator's input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.checkpoints import removed
from marquee.functions import text, values
from marquee.operators import bibliography, catalogue, evidence, folding, lineage, relational, selection, signals
from marquee.plans.catalogue import SIGNALS, TARGET
from marquee.plans.registry import query
from marquee.plans.upserts import bare
from marquee.sources import endpoint, readers, sinks
from marquee.sources.tables import Model, with_model
from marquee.streaming import ingest

# ---- the evidence core -----------------------------------------------------------


@query("jn7_unprojected_targets", "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity >= 48 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def unprojected_targets(m: Model):
    return evidence.unprojected_targets(m.raw("lineitem").where("l_quantity >= 48"), "l_partkey", m.raw("part").where("p_size <= 25"), "p_partkey")


@query("jn8_member_passages", "SELECT l_orderkey, l_linenumber, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' AND l_quantity > 20")
def member_passages(m: Model):
    members = m.raw("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("entity"), "c_name")
    snapshots = m.raw("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("entity"))
    passages = m.raw("lineitem").where("l_quantity > 20").select("l_orderkey", "l_linenumber")
    return evidence.member_passages(passages, snapshots, members, "l_orderkey", "entity").select("l_orderkey", "l_linenumber", "c_name")


@query("jn9_latest_snapshot", "SELECT o_custkey AS entity, max_by(o_orderkey, printf('%s-%012d', strftime(o_orderdate, '%Y%m%d'), o_orderkey)) AS snapshot FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def latest_snapshot(m: Model):
    snapshots = m.raw("orders").where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("snapshot"), "o_orderdate")
    assertions = m.raw("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("snapshot"))
    return evidence.latest_snapshots(snapshots, assertions, "entity", "snapshot", "o_orderdate")


RUNS = "SELECT o_orderpriority AS run_id, o_orderkey AS snapshot_id FROM {orders}"
STATEMENTS = "SELECT l_orderkey AS snapshot_id, l_linenumber AS locator, l_partkey AS target FROM {lineitem}"


@query("jn10_run_assertions", f"SELECT * FROM ({bare(STATEMENTS)}) WHERE snapshot_id IN (SELECT snapshot_id FROM ({bare(RUNS)}) WHERE run_id = '1-URGENT')")
def run_assertions(m: Model):
    return evidence.run_assertions(m.sql(STATEMENTS), m.sql(RUNS), "1-URGENT")


@query("jn13_semi_chain", f"SELECT * FROM ({bare(STATEMENTS)}) WHERE snapshot_id IN (SELECT snapshot_id FROM ({bare(RUNS)}) WHERE run_id IN (SELECT o_orderpriority FROM orders GROUP BY 1 HAVING count(*) % 2 = 1))")
def completed_assertions(m: Model):
    runs = m.raw("orders").groupBy(F.col("o_orderpriority").alias("run_id")).agg(F.when(F.count(F.lit(1)) % 2 == 1, "complete").otherwise("failed").alias("status"))
    return evidence.completed_assertions(runs, m.sql(RUNS), m.sql(STATEMENTS))


@query("jn12_members_in_order", "SELECT c_custkey AS entity_id, c_name, o_orderkey AS position FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '5-LOW' ORDER BY o_orderkey LIMIT 50")
def members_in_order(m: Model):
    entities = m.raw("customer").select(F.col("c_custkey").alias("entity_id"), "c_name")
    memberships = m.raw("orders").select(F.col("o_orderpriority").alias("collection"), F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("position"))
    return evidence.members_in_order(entities, memberships, "5-LOW", 50)


@query("jn24_missing_locators", "SELECT DISTINCT conv_id, turn + 1 AS turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1)")
def missing_locators(m: Model):
    c = m.raw("conversations").select("conv_id", "turn")
    return evidence.missing_locators(c.select("conv_id", (F.col("turn") + 1).alias("turn")), c, "conv_id", "turn")


@query("jn24_answer_evidence", "SELECT c.conv_id, c.turn, d.role FROM conversations c JOIN conversations d ON d.conv_id = c.conv_id AND d.turn = c.turn // 2")
def answer_evidence(m: Model):
    c = m.raw("conversations")
    asked = c.select("conv_id", "turn", F.floor(F.col("turn") / 2).alias("at"))
    return evidence.answer_evidence(asked, c.select("conv_id", F.col("turn").alias("at"), "role"), "conv_id", "at").select("conv_id", "turn", "role")


@query(
    "q13_narrative_quality",
    """WITH p AS (SELECT conv_id, count(*) AS passages, count(DISTINCT role) AS sections, sum(len(regexp_extract_all(text, '[.]')))::BIGINT AS markers FROM conversations GROUP BY 1),
e AS (SELECT conv_id, turn, (SELECT count(*) FROM conversations d WHERE d.conv_id = c.conv_id AND d.role = 'user' AND d.turn < c.turn) AS links FROM conversations c WHERE role = 'assistant'),
a AS (SELECT conv_id, count(*) AS answers, sum(links)::BIGINT AS links, count(*) FILTER (links = 0) AS missing FROM e GROUP BY 1)
SELECT conv_id, passages, sections, markers, coalesce(answers, 0)::BIGINT AS answers, coalesce(links, 0)::BIGINT AS links, coalesce(missing, 0)::BIGINT AS missing, coalesce(answers > 0 AND missing = 0, false) AS pass FROM p LEFT JOIN a USING (conv_id)""",
)
def narrative_quality(m: Model):
    c = m.raw("conversations")
    name = F.concat_ws("-", "conv_id", "turn")
    answers = c.where("role = 'assistant'").select("conv_id", "turn", name.alias("answer_id"))
    links = answers.join(c.where("role = 'user'").select("conv_id", F.col("turn").alias("at")), "conv_id").where("at < turn").select("answer_id")
    return evidence.narrative_quality(c, answers, links, "conv_id", "role", F.size(F.regexp_extract_all("text", F.lit("[.]"), 0)))


# ---- folding -----------------------------------------------------------------------


@query(
    "ag4_fold",
    """SELECT l_partkey AS film, arg_max(l_linestatus || l_suppkey, (l_orderkey, l_linenumber, l_suppkey, l_linestatus)) AS title, min(l_shipdate)::DATE::VARCHAR AS first_release,
 string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS genres, count(DISTINCT (l_suppkey, l_returnflag))::BIGINT AS credits, count(DISTINCT l_orderkey % 50)::BIGINT AS relations, count(DISTINCT l_shipdate::DATE)::BIGINT AS releases,
 count(DISTINCT (l_shipdate::DATE, l_linestatus)) FILTER (l_linestatus = 'F')::BIGINT AS places FROM lineitem GROUP BY 1""",
)
def fold(m: Model):
    rows = m.raw("lineitem").select(F.col("l_partkey").alias("film"), F.concat("l_linestatus", "l_suppkey").alias("title"), "l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus", F.col("l_returnflag").alias("genre"), (F.col("l_orderkey") % 50).alias("related"), F.col("l_shipdate").cast("date").cast("string").alias("date"), F.when(F.col("l_linestatus") == "F", "F").alias("place"))
    out = folding.folded_records(rows, "film", ["l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus"], ["title"], {"genres": ("genre",), "credits": ("l_suppkey", "genre"), "relations": ("related",)}, "date", "place")
    places = F.aggregate("releases", F.lit(0).cast("long"), lambda a, r: a + F.size(r["places"]))
    return out.select("film", "title", "first_release", F.array_join("genres", ",").alias("genres"), *[F.size(c).cast("long").alias(c) for c in ("credits", "relations", "releases")], places.alias("places"))


@query("ag6_release_places", "SELECT o_custkey AS film, o_orderdate::DATE::VARCHAR AS date, coalesce(string_agg(DISTINCT place, ',' ORDER BY place), '') AS places FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS place FROM orders) GROUP BY 1, 2")
def release_places(m: Model):
    place = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    rows = m.raw("orders").select(F.col("o_custkey").alias("film"), F.col("o_orderdate").cast("date").cast("string").alias("date"), place.alias("place"))
    return folding.release_places(rows, ["film", "date"], "place").withColumn("places", F.array_join("places", ","))


@query("ag7_multimap", "SELECT p_name AS external, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS targets, count(DISTINCT p_brand)::INT AS n FROM part GROUP BY 1")
def multimap(m: Model):
    rows = m.raw("part").select(F.col("p_name").alias("external"), "p_brand")
    return folding.multimap(rows, "external", "p_brand").select("external", F.array_join("targets", ",").alias("targets"), F.size("targets").alias("n"))


@query("ag8_facts", "SELECT user_id, coalesce(string_agg(DISTINCT CASE WHEN event_type = 'click' THEN event_type END, ','), '') AS types, coalesce(string_agg(DISTINCT CASE WHEN event_type <> 'click' THEN day(ts)::VARCHAR END, ',' ORDER BY CASE WHEN event_type <> 'click' THEN day(ts)::VARCHAR END), '') AS days FROM events GROUP BY 1")
def facts(m: Model):
    click = F.col("event_type") == "click"
    rows = folding.facts(m.raw("events"), "user_id", {"types": F.when(click, F.col("event_type")), "days": F.when(~click, F.dayofmonth("ts").cast("string"))})
    return rows.select("user_id", F.array_join("types", ",").alias("types"), F.array_join("days", ",").alias("days"))


KINDS = ("ECONOMY", "LARGE", "MEDIUM")


@query("ag14_type_priority", "SELECT p_name AS target, arg_min(p_type, printf('%03d', CASE p_type " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " ELSE 99 END) || p_type) AS p_type FROM part GROUP BY 1")
def type_priority(m: Model):
    return folding.best_kind(m.raw("part").withColumnRenamed("p_name", "target"), "target", "p_type", KINDS)


@query("ag15_group_max_any", "SELECT o_custkey AS film, max(o_totalprice) AS sitelinks, min(o_orderpriority) AS runtime FROM orders GROUP BY 1")
def group_max_any(m: Model):
    rows = m.raw("orders").select(F.col("o_custkey").alias("film"), F.col("o_totalprice").alias("sitelinks"), F.col("o_orderpriority").alias("runtime"))
    return folding.most_and_any(rows, "film", "sitelinks", "runtime")


@query("prj9_header_merge", "SELECT c_custkey AS id, c_name AS name, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, c_mktsegment) AS label, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey")
def header_merge(m: Model):
    header = m.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("label"))
    rows = m.raw("orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("label"), "o_orderkey")
    return folding.merged_rows(header, rows, "id")


@query("wn9_keep_first", "SELECT conv_id, array_to_string(list(role ORDER BY f), ',') AS roles FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY 1, 2) GROUP BY 1")
def keep_first(m: Model):
    return folding.ordered_list(m.raw("conversations"), "conv_id", "turn", "role").select("conv_id", F.array_join("values", ",").alias("roles"))


@query("tk10_pages", "SELECT c_custkey, ((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 10)::BIGINT AS page FROM customer")
def pages(m: Model):
    return folding.numbered_pages(m.raw("customer"), ["c_nationkey"], ["c_custkey"], 10).select("c_custkey", "page")


@query("tk8_keyset_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey > 1000 ORDER BY o_orderkey LIMIT 40")
def keyset_page(m: Model):
    return folding.keyset_page(m.raw("orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 40)


@query("tk12_offset_page", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 30 OFFSET 60")
def offset_page(m: Model):
    return folding.offset_page(m.raw("part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 60, 30)


@query("jn28_optional", "SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)")
def optional(m: Model):
    return folding.with_optional(m.raw("documents").select("doc_id", "lang"), m.raw("labels").select("doc_id", "quality"), ["doc_id"])


@query("jn29_values", "SELECT p_partkey, p_name FROM part WHERE (p_brand, p_type) IN (SELECT p_brand, p_type FROM part WHERE p_size = 9)")
def given_values(m: Model):
    p = m.raw("part")
    return folding.with_values(p, p.where("p_size = 9"), "p_brand", "p_type").select("p_partkey", "p_name")


@query("st2_set_ops", "SELECT a.p_brand AS a, b.p_brand AS b, len(list_intersect(a.s, b.s))::INT AS both, len(list_distinct(list_concat(a.s, b.s)))::INT AS either FROM (SELECT p_brand, list(DISTINCT p_name) AS s FROM part GROUP BY 1) a JOIN (SELECT p_brand, list(DISTINCT p_name) AS s FROM part GROUP BY 1) b ON substr(a.p_brand, 1, 7) = substr(b.p_brand, 1, 7) AND a.p_brand < b.p_brand")
def set_ops(m: Model):
    s = folding.multimap(m.raw("part"), "p_brand", "p_name").withColumn("k", F.substring("p_brand", 1, 7))
    b = s.select("k", F.col("p_brand").alias("b"), F.col("targets").alias("t"))
    both, either = relational.set_sizes("targets", "t")
    return s.join(b, "k").where("p_brand < b").select(F.col("p_brand").alias("a"), "b", both.alias("both"), either.alias("either"))


@query("st6_difference", "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 30 EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal < 3000")
def difference(m: Model):
    return relational.difference(m.raw("lineitem").where("l_quantity > 30").select(F.col("l_suppkey").alias("k")), m.raw("supplier").where("s_acctbal < 3000").select(F.col("s_suppkey").alias("k")))


# ---- selections --------------------------------------------------------------------


@query("flt13_identifiers", "SELECT 'Q' || p_partkey AS qid, '/m/0' || lower(p_type) AS archive_id FROM part")
def identifiers(m: Model):
    rows = m.raw("part").select(F.concat(F.lit("Q"), "p_partkey").alias("qid"), F.concat(F.lit("/m/0"), F.lower("p_type")).alias("archive_id"))
    return selection.identifiers(selection.identifiers(rows, "qid", selection.ITEM), "archive_id", selection.ARCHIVE_ITEM)


@query("st5_all_identifiers", "SELECT 'Q' || p_partkey AS qid FROM part WHERE p_size < 9 UNION SELECT 'Q' || l_partkey FROM lineitem WHERE l_quantity < 3 UNION SELECT 'Q7' ORDER BY 1")
def all_identifiers(m: Model):
    q = lambda df, c: df.select(F.concat(F.lit("Q"), c).alias("qid"))
    return selection.all_identifiers(m.spark.range(1).select(F.lit("Q7").alias("qid")), q(m.raw("part").where("p_size < 9"), "p_partkey"), q(m.raw("lineitem").where("l_quantity < 3"), "l_partkey"))


@query("sc15_title_score", "SELECT p_partkey AS id, (lower(p_name) IN (lower(upper(p_name) || '  x'), lower(p_brand), CASE WHEN p_size % 3 = 0 THEN lower(p_name) END))::INT AS score FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 0 FROM part WHERE p_size % 3 <> 0")
def title_score(m: Model):
    names = F.array(F.concat(F.upper("p_name"), F.lit("  x")), F.col("p_brand"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), F.regexp_replace(F.upper("p_name"), " ", "  "))))
    return m.raw("part").select(F.col("p_partkey").alias("id"), selection.title_score(names, F.col("p_name")).alias("score"))


ENTRIES = "SELECT p_partkey AS position, p_name AS title, 1970 + p_size AS release_year FROM {part} WHERE p_size < 6"
ANSWERS = """SELECT p_name AS query, 'en' AS route, p_size AS place, 'Q' || p_partkey AS qid FROM {part} UNION ALL SELECT p_name, 'wikipedia', 50 - p_size, 'Q' || p_partkey FROM {part}
UNION ALL SELECT p_name || ' ' || (1970 + p_size) || ' film', 'title_year', 0, 'Q' || p_partkey FROM {part} WHERE p_type <> 'ECONOMY' UNION ALL SELECT p_name, 'multilingual', 1, cast(NULL AS string) FROM {part}"""
FOUND = f"""e AS ({bare(ENTRIES)}), w AS ({bare(ANSWERS)}),
c AS (SELECT position, title, release_year, qid, CASE w.route WHEN 'en' THEN 0 WHEN 'multilingual' THEN 1 WHEN 'wikipedia' THEN 2 ELSE 3 END AS route, place FROM e JOIN w ON place < 10 AND qid IS NOT NULL AND query = CASE WHEN w.route = 'title_year' THEN title || ' ' || release_year || ' film' ELSE title END),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY position, qid ORDER BY route, place) AS r FROM c) WHERE r = 1)"""


def found(m: Model):
    return selection.candidates(m.sql(ENTRIES), m.sql(ANSWERS))


@query("src10_candidates", f"WITH {FOUND} SELECT position, qid, route, place FROM found")
def candidates(m: Model):
    return found(m)


ITEMS = "SELECT 'Q' || p_partkey AS qid, p_type, p_brand, p_name, 1970 + p_size AS year, CASE WHEN p_partkey % 3 <> 0 THEN 'Page ' || p_partkey END AS enwiki FROM {part}"
FILM_TYPES = ("LARGE", "SMALL", "PROMO", "MEDIUM")


def items(m: Model):
    return m.sql(ITEMS).select("qid", F.array("p_type", "p_brand").alias("types"), F.array((F.col("year") - 1).cast("int"), F.col("year").cast("int")).alias("years"), F.array("p_brand", F.when(F.length("qid") % 2 == 0, F.upper("p_name"))).alias("names"), "enwiki")


def resolution(m: Model):
    """Each title and year resolved once, and given to all entries that ask it."""
    entries = m.sql(ENTRIES)
    asking = selection.requests(entries)
    told = selection.described(selection.answered(asking, m.sql(ANSWERS)), items(m), asking, FILM_TYPES)
    best = relational.resolved_candidates(asking.select("position", F.col("release_year").cast("int")), told).withColumnRenamed("position", "asked")
    return selection.same_request(entries, asking).join(best, "asked").drop("asked")


@query(
    "q16_title_resolution",
    f"""WITH {FOUND}, i AS ({bare(ITEMS)}),
d AS (SELECT f.*, i.enwiki, (length(f.qid) % 2 = 0 AND i.p_name = title)::INT AS score FROM found f JOIN i ON i.qid = f.qid WHERE i.p_type IN {FILM_TYPES} AND release_year BETWEEN year - 1 AND year),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY route > 0, score DESC, route, place, qid) AS rn FROM d) WHERE rn = 1)
SELECT e.position, b.qid, b.enwiki, CASE WHEN b.qid IS NULL THEN 'no film QID with matching release year after Wikidata and Wikipedia fallback' WHEN b.enwiki IS NULL THEN 'film QID has no English Wikipedia sitelink' END AS reason FROM e LEFT JOIN b ON b.position = e.position""",
)
def title_resolution(m: Model):
    return resolution(m).select("position", "qid", "enwiki", "reason")


CHOSEN = "SELECT o_orderkey AS position, year(o_orderdate) AS release_year FROM {orders}"
LINKED = "SELECT o_orderkey AS position, o_orderkey - o_orderkey % 40 AS qid FROM {orders} WHERE o_orderkey % 11 <> 0"
AUDIT = """f AS (SELECT l_orderkey AS qid, list(DISTINCT l_returnflag) AS types, list(DISTINCT year(l_shipdate)) AS years FROM lineitem GROUP BY 1),
w AS (SELECT o_orderkey AS position, year(o_orderdate) AS y FROM orders WHERE o_orderkey % 3 = 0),
a AS (SELECT e.position, l.qid, CASE WHEN l.qid IS NULL THEN '' ELSE concat_ws(';', CASE WHEN NOT coalesce(list_contains(types, 'R'), false) THEN 'not an accepted film type' END, CASE WHEN NOT coalesce(list_contains(years, release_year), false) AND NOT coalesce(w.y = release_year, false) THEN 'release year absent' END) END AS reasons
 FROM e LEFT JOIN l ON l.position = e.position LEFT JOIN f ON f.qid = l.qid LEFT JOIN w ON w.position = e.position),
audit AS (SELECT *, CASE WHEN qid IS NULL THEN 'missing' WHEN reasons <> '' THEN 'invalid' ELSE 'verified' END AS outcome FROM a)"""
AUDIT = f"e AS ({bare(CHOSEN)}), l AS ({bare(LINKED)}), {AUDIT}"


def audit(m: Model):
    sets = folding.facts(m.raw("lineitem").withColumnRenamed("l_orderkey", "qid"), "qid", {"types": F.col("l_returnflag"), "years": F.year("l_shipdate")})
    wiki = m.raw("orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("position"), F.array(F.year("o_orderdate")).alias("wiki_years"))
    return selection.audited(m.sql(CHOSEN), m.sql(LINKED), sets, wiki, ("R",))


@query("q14_selection_audit", f"WITH {AUDIT} SELECT position, qid, reasons, outcome FROM audit")
def selection_audit(m: Model):
    return audit(m).select("position", "qid", F.array_join("reasons", ";").alias("reasons"), "outcome")


@query("q14_audit_report", f"WITH {AUDIT} SELECT count(*)::BIGINT AS entries, count(*) FILTER (outcome = 'verified')::BIGINT AS verified, count(*) FILTER (outcome = 'missing')::BIGINT AS missing, count(*) FILTER (outcome = 'invalid')::BIGINT AS invalid, round(100.0::DOUBLE * count(*) FILTER (outcome = 'verified') / count(*), 2) AS coverage_percent, (count(qid) - count(DISTINCT qid))::BIGINT AS duplicate_qids, false AS pass FROM audit")
def audit_report(m: Model):
    return selection.audit_report(audit(m))


@query("jn22_manifest_facts", "SELECT o.o_orderkey AS position, l.qid, c_name FROM orders o LEFT JOIN (SELECT o_orderkey, o_custkey AS qid FROM orders WHERE o_orderstatus <> 'P') l ON l.o_orderkey = o.o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON l.qid = c_custkey")
def manifest_facts(m: Model):
    o = m.raw("orders")
    links = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("qid"))
    return selection.manifest_facts(o.select(F.col("o_orderkey").alias("position")), links, m.raw("customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("qid"), "c_name"))


SHELF = "(SELECT o_custkey AS qid, year(o_orderdate) AS y, max(o_totalprice) AS links FROM orders GROUP BY 1, 2)"


@query(
    "q17_shelf_memberships",
    f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY links DESC, qid) AS r FROM {SHELF} WHERE y BETWEEN 1992 AND 1998),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY y) AS f FROM t WHERE r <= 14 + CASE WHEN y - 1992 < 2 THEN 1 ELSE 0 END) WHERE f = 1)
SELECT 'shelf' AS collection, qid AS entity_id, row_number() OVER (ORDER BY y, links DESC, qid)::INT AS position, 'created' AS disposition FROM k""",
)
def shelf_memberships(m: Model):
    from marquee.operators import upserts

    c = m.raw("orders").groupBy(F.col("o_custkey").alias("qid"), F.year("o_orderdate").alias("y")).agg(F.max("o_totalprice").alias("links"))
    kept = relational.stratified(c, "y", list(range(1992, 1999)), 100, [F.desc("links"), "qid"], "qid")
    held = m.spark.createDataFrame([], "collection string, entity_id long, position int")
    return upserts.upsert("membership", held, selection.shelf(kept, "shelf", "qid", ["y", F.desc("links"), "qid"]), "position")


# ---- catalogue answers -----------------------------------------------------------------


@query(
    "q1_health_editions",
    with_model("films people credits", "SELECT (SELECT count(*) FROM films)::BIGINT AS films, (SELECT count(*) FROM people)::BIGINT AS people, (SELECT count(*) FROM credits)::BIGINT AS credits, (SELECT count(*) FROM region)::BIGINT AS sources, (SELECT strftime(max(o_orderdate), '%Y-%m-%d') FROM orders) AS latest, 'ready' AS status, (SELECT string_agg(lang, ',' ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'te' THEN 1 WHEN 'hi' THEN 2 WHEN 'ta' THEN 3 ELSE 99 END, lang) FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)) AS editions"),
)
def health_editions(m: Model):
    languages = m.raw("documents").where("lang is not null").select(F.col("lang").alias("code")).distinct().withColumn("display_name", F.concat(F.lit("Edition "), "code"))
    rows = catalogue.health(m.films(), m.people(), m.credits(), m.raw("region"), m.raw("orders"), "o_orderdate", languages)
    return rows.withColumn("latest", F.date_format("latest", "yyyy-MM-dd")).withColumn("editions", F.array_join(F.transform("editions", lambda e: e["code"]), ","))


@query("q6_compare_pair", with_model("films genres credits people", "SELECT label, contribution, evidence FROM sig", f"pairs AS (SELECT {TARGET} AS first, {TARGET + 1} AS second), " + SIGNALS))
def compare_pair(m: Model):
    return signals.compared(TARGET, TARGET + 1, m.films(), m.genres(), m.credits(), m.people()).select("label", "contribution", "evidence")


WORKS = "works AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN 'order:' || o_orderkey END AS entity_id, 'Work ' || o_orderkey AS title FROM orders WHERE o_orderkey % 3 <> 0)"
ROUTES = "routes AS (SELECT subject AS entity_id, object AS target_id, predicate, 'outgoing' AS direction, assertion_id FROM assertions WHERE status IN ('resolved', 'published') UNION ALL SELECT object, subject, predicate, 'incoming', assertion_id FROM assertions WHERE status IN ('resolved', 'published')), told AS (SELECT r.entity_id, target_id, e.label AS target_title, CASE WHEN predicate = 'part_of_series' THEN 'Series membership' WHEN (predicate = 'followed_by') = (direction = 'outgoing') THEN 'Next installment' ELSE 'Previous installment' END AS relation_label FROM routes r JOIN entities e ON e.entity_id = target_id), edges AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY relation_label, target_title, target_id) AS position FROM (SELECT DISTINCT * FROM told)) WHERE position <= 12)"


def works(m: Model) -> DataFrame:
    o = m.raw("orders").where("o_orderkey % 3 <> 0")
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("order:"), "o_orderkey")).alias("entity_id"), F.concat(F.lit("Work "), "o_orderkey").alias("title"))


@query("jn4_edges_with_films", with_model("entities assertions", "SELECT e.entity_id, position::INT AS position, relation_label, target_id, w.id AS film_id, w.title AS film_title FROM edges e LEFT JOIN works w ON w.entity_id = e.target_id", f"{WORKS}, {ROUTES}"))
def edges_with_films(m: Model):
    rows = lineage.with_films(lineage.edges(m.assertions(), m.entities()), works(m).where("entity_id is not null"))
    return rows.select("entity_id", "position", "relation_label", "target_id", F.col("target_film.id").alias("film_id"), F.col("target_film.title").alias("film_title"))


@query(
    "q7_film_lineage",
    with_model(
        "entities assertions",
        """SELECT id, coalesce(n, 0)::BIGINT AS routes, CASE WHEN w.entity_id IS NULL THEN 'This film has not yet been linked to the evidence core.' WHEN n IS NULL THEN 'No typed lineage route is available for this film yet.' ELSE n || ' source-backed lineage route' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' found.' END AS summary
 FROM works w LEFT JOIN (SELECT entity_id, count(*) AS n FROM edges GROUP BY 1) e ON e.entity_id = w.entity_id""",
        f"{WORKS}, {ROUTES}",
    ),
)
def film_lineage(m: Model):
    return lineage.summaries(works(m), lineage.edges(m.assertions(), m.entities()))


@query(
    "q8_film_provenance",
    with_model(
        "films credits",
        """SELECT f.id, string_agg(field || '@' || r_name, ';' ORDER BY field, r_name, ref) AS provenance FROM films f LEFT JOIN (SELECT film_id, role AS field, r_name, 's' || s_suppkey AS ref FROM credits JOIN supplier ON s_suppkey = person_id JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey) p ON p.film_id = f.id GROUP BY 1""",
    ),
)
def film_provenance(m: Model):
    sources = m.raw("region").select(F.col("r_regionkey").alias("source_id"), F.col("r_name").alias("source_name"))
    people = m.raw("supplier").join(m.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("person_id"), F.col("n_regionkey").alias("source_id"))
    rows = catalogue.provenance(m.credits().join(people, "person_id").select("film_id", F.col("role").alias("field_name"), "source_id", F.concat(F.lit("s"), "person_id").alias("reference")), sources)
    d = catalogue.details(m.films(), m.genres(), m.credits(), m.people(), m.aliases(), rows)
    return d.select("id", F.array_join(F.transform("provenance", lambda p: F.concat(p["field_name"], F.lit("@"), p["source_name"])), ";").alias("provenance"))


@query("q7_lineage_one", with_model("entities assertions", "SELECT e.entity_id, position::INT AS position, relation_label, target_id, target_title FROM edges e WHERE e.entity_id = 'order:13'", ROUTES))
def lineage_one(m: Model):
    """The point form: the edges of one entity."""
    return lineage.edges(m.assertions(), m.entities()).where("entity_id = 'order:13'").select("entity_id", "position", "relation_label", "target_id", "target_title")


@query("q8_film_one", with_model("films genres aliases", f"SELECT id, title, (SELECT string_agg(label, ', ' ORDER BY label) FROM (SELECT DISTINCT label FROM genres WHERE film_id = {TARGET})) AS genres, (SELECT string_agg(value, ';' ORDER BY value) FROM (SELECT DISTINCT value FROM aliases WHERE film_id = {TARGET})) AS aliases FROM films WHERE id = {TARGET}"))
def film_one(m: Model):
    """The point form: one film with its children."""
    d = catalogue.details(m.films(), m.genres(), m.credits(), m.people(), m.aliases()).where(F.col("id") == TARGET)
    return d.select("id", "title", F.array_join("genres", ", ").alias("genres"), F.array_join("aliases", ";").alias("aliases"))


@query("snk4_responses", with_model("films", """SELECT '{"id":' || id || ',"title":"' || title || '","release_date":' || coalesce('"' || release_date || '"', 'null') || '}' AS body FROM films"""))
def responses(m: Model):
    return catalogue.responses(m.films().select("id", "title", "release_date"))


# ---- scalars ------------------------------------------------------------------------


@query("sc1_casefolded", r"SELECT p_partkey AS id, lower(p_name) || ' strasse ' || p_brand_l AS s FROM (SELECT *, lower(p_brand) AS p_brand_l FROM part)")
def casefolded(m: Model):
    return m.raw("part").select(F.col("p_partkey").alias("id"), text.casefolded(F.concat(F.upper("p_name"), F.lit(" \t Straße\n "), "p_brand")).alias("s"))


@query("sc3_letters_only", r"SELECT doc_id, sha256(regexp_replace(lower(strip_accents(nfc_normalize(replace(text, 'ß', 'ss')))), '[^\p{L}\p{N}]', '', 'g')) AS h FROM documents")
def letters_only(m: Model):
    # what a decomposition leaves of accents is neither letter nor digit
    return m.raw("documents").select("doc_id", values.content_hash(text.letters_only(F.col("text"))).alias("h"))


@query("sc4_nfc_collapsed", r"SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(text || ' e' || chr(769)), '\s+', ' ', 'g'))) AS h FROM documents")
def nfc(m: Model):
    return m.raw("documents").select("doc_id", values.content_hash(text.nfc_collapsed(F.concat("text", F.lit(" é")))).alias("h"))


@query("sc12_attribution", "SELECT p_partkey AS id, p_name || ', ' || p_brand || ' — Source ' || p_type AS attribution FROM part")
def attribution(m: Model):
    from marquee.operators.upserts import attribution as joined

    return m.raw("part").select(F.col("p_partkey").alias("id"), joined(F.array(F.concat(F.lit(" "), "p_name"), F.concat("p_brand", F.lit("  "))), F.concat(F.lit("Source "), "p_type")).alias("attribution"))


@query("nm6_filled", "SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 THEN c_nationkey ELSE c_custkey % 5 + 100 END::BIGINT AS n, CASE WHEN c_nationkey % 2 = 0 THEN 'old' ELSE c_mktsegment END AS s FROM customer WHERE c_nationkey % 3 <> 0 OR c_nationkey <> 0 UNION ALL SELECT c_custkey, c_custkey % 5 + 100, CASE WHEN c_nationkey % 2 = 0 THEN 'old' ELSE c_mktsegment END FROM customer WHERE c_nationkey = 0")
def filled(m: Model):
    from pyspark.sql import types as T

    n = F.when(F.col("c_nationkey") % 3 == 0, F.col("c_nationkey").cast("long")).otherwise(F.lit(0))
    s = F.when(F.col("c_nationkey") % 2 == 0, F.lit("")).otherwise(F.col("c_mktsegment"))
    return m.raw("customer").select(F.col("c_custkey").alias("id"), F.coalesce(values.filled(n, T.LongType()), F.col("c_custkey") % 5 + 100).alias("n"), F.coalesce(values.filled(s, T.StringType()), F.lit("old")).alias("s"))


@query("prj8_snaks", "SELECT p_partkey AS id, CASE WHEN p_size % 3 <> 0 THEN 'Q' || p_size END AS item, CASE WHEN p_size % 4 <> 0 THEN 1900 + p_size END::INT AS year FROM part")
def snaks(m: Model):
    p = m.raw("part")
    item = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit('{"datavalue":{"value":{"id":"Q'), "p_size", F.lit('"}}}'))).otherwise(F.lit('{"datavalue":{"value":"text"}}'))
    time = F.when(F.col("p_size") % 4 != 0, F.concat(F.lit('{"datavalue":{"value":{"time":"+'), (1900 + F.col("p_size")).cast("string"), F.lit('-00-00T00:00:00Z"}}}'))).otherwise(F.lit('{"snaktype":"novalue"}'))
    return p.select(F.col("p_partkey").alias("id"), values.snak_id(item).alias("item"), values.snak_year(time).alias("year"))


@query("ag18_outcomes", "SELECT count(*)::BIGINT AS total, count(*) FILTER (event_type = 'click')::BIGINT AS click, count(*) FILTER (event_type = 'view')::BIGINT AS view FROM events")
def outcomes(m: Model):
    # the time of counting is no result
    return sinks.outcomes(m.raw("events"), ("click", "view"), "event_type").drop("counted_at")


# ---- readers and sinks: the tables as files of their kinds, read back --------------------


def archives(m: Model) -> str:
    """Films and plots as tar.gz archives, as the source comes; their folder."""
    k = F.col("p_partkey").cast("string")
    labels = lambda *pairs: F.to_json(F.create_map(*[x for key, value in pairs for x in (F.lit(key), value)]))
    language = F.when(F.col("p_size") % 2 != 0, "English Language").otherwise("French Language")
    head = F.concat_ws("\t", k, F.concat(F.lit("/m/"), k), "p_name", F.lit("1999"), F.lit(""), F.lit("90"), labels(("/m/l", language)), F.lit("{}"))
    genres = F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.concat(F.lit("\t"), labels(("/m/g", F.col("p_type")), ("/m/h", F.col("p_brand")))))
    plot = F.concat(k, F.lit("\tplot\tof "), "p_brand")
    plots = F.when(F.col("p_size") % 3 == 0, F.array(F.concat(k, F.lit("\tearlier plot")), F.concat(F.lit("no tab "), k), plot)).otherwise(F.array(plot))
    line = lambda member, value: F.struct(F.lit(member).alias("member"), value.alias("value"))
    each = F.concat(F.array(line("x/movie.metadata.tsv", F.concat(head, genres))), F.transform(plots, lambda x: line("x/plot_summaries.txt", x)))
    folder = sinks.new_folder(m.spark, "archives")
    sinks.write_archives(m.raw("part").repartition(4, "p_partkey").select(F.inline(each)), folder, 1 << 20)
    return folder


@query("src3_archive_rows", "SELECT p_partkey::VARCHAR AS wikipedia_movie_id, p_name AS title, array_to_string(list_sort([p_type, p_brand]), ',') AS genres FROM part WHERE p_partkey % 7 <> 0", writes=True)
def archive_rows(m: Model):
    rows = readers.archive_rows(readers.tar_lines(m.spark, archives(m), "metadata.tsv"))
    return rows.select("wikipedia_movie_id", "title", F.array_join("genres", ",").alias("genres"))


@query("src4_keyed_text", "SELECT p_partkey::VARCHAR AS key, 'plot' || chr(9) || 'of ' || p_brand AS text FROM part", writes=True)
def keyed_text(m: Model):
    return readers.keyed_text(readers.tar_lines(m.spark, archives(m), "plot_summaries.txt"))


@query("ar2_english_with_plot", "SELECT p_partkey::VARCHAR AS wikipedia_movie_id, 'plot' || chr(9) || 'of ' || p_brand AS plot FROM part WHERE p_partkey % 7 <> 0 AND p_size % 2 = 1", writes=True)
def english_with_plot(m: Model):
    at = archives(m)
    plots = readers.keyed_text(readers.tar_lines(m.spark, at, "plot_summaries.txt"))
    return readers.english_with_plot(readers.archive_rows(readers.tar_lines(m.spark, at, "metadata.tsv")), plots).select("wikipedia_movie_id", "plot")


def title_file(m: Model) -> str:
    """A list of titles as CSV, with a mark in front and rows that do not count."""
    k = F.col("p_partkey")
    title = F.when(k % 5 == 0, " ").otherwise(F.col("p_name")).alias("\ufeffSeries_Title")
    year = F.concat(F.lit(" "), F.when(k % 6 == 0, "PG").otherwise((F.col("p_size") + 1900).cast("string")), F.lit(" ")).alias("Released_Year")
    folder = sinks.new_folder(m.spark, "titles")
    m.raw("part").orderBy("p_partkey").select(title, year, F.lit(7).alias("Rating")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return folder


TITLES = "SELECT row_number() OVER (ORDER BY p_partkey)::INT AS position, p_name AS title, (1900 + p_size)::INT AS release_year FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 6 <> 0"


@query("src5_title_years", TITLES, writes=True)
def title_years(m: Model):
    return readers.title_years(m.spark, title_file(m))


@query("tk11_first_titles", f"SELECT * FROM ({TITLES}) WHERE position <= 20", writes=True)
def first_titles(m: Model):
    """The first 20 entries of a list."""
    return readers.title_years(m.spark, title_file(m), limit=20)


@query("src6_manifest", "SELECT p_partkey::INT AS position, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'Q' || p_partkey END AS wikidata_id FROM part", writes=True)
def manifest(m: Model):
    """Manifests of a thousand entries at most, a file each."""
    qid = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Q"), "p_partkey"))
    entry = F.struct(F.col("p_partkey").alias("position"), F.col("p_name").alias("title"), qid.alias("wikidata_id"))
    docs = m.raw("part").groupBy((F.col("p_partkey") / 1000).cast("long").alias("part")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    folder = sinks.new_folder(m.spark, "manifests")
    docs.select(F.to_json(F.struct(F.lit("v1").alias("schema"), "entries"), {"pretty": "true"}).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return readers.manifest(m.spark, folder, "v1").select("position", "title", "wikidata_id")


@query("src7_recorded_bindings", "SELECT 'http://x/Q' || c_custkey AS item, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS label FROM customer", writes=True)
def recorded_bindings(m: Model):
    """Recorded answers, one a line, in several files."""
    m.spark.dataSource.register(endpoint.RecordedSource)
    value = lambda c: F.struct(c.alias("value"))
    label = F.when(F.col("c_custkey") % 2 == 0, value(F.col("c_name")))
    binding = F.struct(value(F.concat(F.lit("http://x/Q"), "c_custkey")).alias("item"), label.alias("label"))
    answers = m.raw("customer").groupBy((F.col("c_custkey") / 10).cast("long").alias("page")).agg(F.collect_list(binding).alias("bindings"))
    folder = sinks.new_folder(m.spark, "answers")
    answers.repartition(4, "page").select(F.to_json(F.struct(F.struct("bindings").alias("results"))).alias("value")).write.text(folder)
    return readers.bindings(m.spark.read.format("recorded_bindings").option("path", folder).load(), "item", "label")


def entity_payloads(m: Model) -> DataFrame:
    """Recorded entity payloads: as a map for even keys, as a list otherwise,
    with the missing ones marked."""
    qid = F.concat(F.lit("Q"), "p_partkey")
    claim = F.concat(F.lit('{"mainsnak":{"datavalue":{"value":{"id":"'), "p_type", F.lit('"}}},"rank":"normal"}'))
    claims = F.concat(F.lit('"claims":{"P31":['), claim, F.lit(","), claim, F.lit("]}"))
    missing = F.when(F.col("p_size") % 5 == 0, F.lit(',"missing":""')).otherwise(F.lit(""))
    entity = F.concat(F.lit('{"id":"'), qid, F.lit('",'), claims, missing, F.lit("}"))
    body = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"entities":{"'), qid, F.lit('":'), entity, F.lit("}}"))).otherwise(F.concat(F.lit('{"entities":['), entity, F.lit("]}")))
    return m.raw("part").select(body.alias("value"))


@query("src8_entities", "SELECT 'Q' || p_partkey AS qid FROM part WHERE p_size % 5 <> 0")
def entities(m: Model):
    return readers.entities(entity_payloads(m)).select("qid")


@query("ar3_statements", "SELECT 'Q' || p_partkey AS qid, 'P31' AS property, 'claims.P31[' || i || ']' AS locator, p_type AS item, 'normal' AS rank FROM part, (VALUES (0), (1)) v(i) WHERE p_size % 5 <> 0")
def statements(m: Model):
    rows = readers.statements(readers.entities(entity_payloads(m)))
    return rows.select("qid", "property", "locator", values.snak_id(F.col("value")).alias("item"), "rank")


@query("ar4_page_facts", "SELECT 'title' AS property, 'T' || page_id AS value FROM pages UNION ALL SELECT 'page_id', page_id::VARCHAR FROM pages UNION ALL SELECT 'revision', (page_id * 3)::VARCHAR FROM pages WHERE page_id % 2 = 0")
def page_facts(m: Model):
    revisions = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(',"revisions":[{"revid":'), (F.col("page_id") * 3).cast("string"), F.lit("}]"))).otherwise(F.lit(""))
    payload = F.concat(F.lit('{"page":{"title":"T'), "page_id", F.lit('","pageid":'), "page_id", revisions, F.lit("}}"))
    return readers.page_facts(m.raw("pages").select(payload.alias("value")))


@query("src9_page_records", "SELECT 'a page ' || page_id AS asked, page_id, 'A page ' || page_id AS title, page_id * 7 AS revision, 'https://en.wikipedia.org/wiki/A_page_' || page_id AS url FROM pages WHERE page_id % 4 <> 0")
def page_records(m: Model):
    k = F.col("page_id").cast("string")
    missing = F.when(F.col("page_id") % 4 == 0, F.lit(',"missing":true')).otherwise(F.lit(""))
    page = F.concat(F.lit('{"pageid":'), k, F.lit(',"title":"A page '), k, F.lit('","revisions":[{"revid":'), (F.col("page_id") * 7).cast("string"), F.lit("}]"), missing, F.lit("}"))
    payload = F.concat(F.lit('{"query":{"normalized":[{"from":"a page '), k, F.lit('","to":"Page '), k, F.lit('"}],"redirects":[{"from":"Page '), k, F.lit('","to":"A page '), k, F.lit('"}],"pages":['), page, F.lit("]}}"))
    return readers.page_records(m.raw("pages").select(payload.alias("value"))).select("asked", "page_id", "title", "revision", "url")


@query("src11_answered", "SELECT 'r' || l_partkey AS title, l_linenumber + 6 AS place FROM lineitem WHERE l_linenumber + 6 < 10")
def answered(m: Model):
    rows = m.raw("lineitem").select(F.concat(F.lit("r"), "l_partkey").alias("title"), (F.col("l_linenumber") + 6).alias("place"))
    return bibliography.answered(rows, "indexed")


@query("snk1_store_payloads", "SELECT source, hash, source || '/' || substr(hash, 1, 2) || '/' || hash || '.json' AS place, CASE WHEN even THEN 'reused' ELSE 'created' END AS disposition FROM (SELECT 's' || page_id % 3 AS source, sha256(coalesce(html, '')) AS hash, bool_or(page_id % 2 = 0) AS even FROM pages GROUP BY 1, 2)", writes=True)
def store_payloads(m: Model):
    rows = m.raw("pages").select("page_id", F.concat(F.lit("s"), F.col("page_id") % 3).alias("source"), F.coalesce("html", F.lit("")).alias("body"))
    folder = sinks.new_folder(m.spark, "blobs")
    sinks.store_payloads(rows.where("page_id % 2 = 0"), folder)
    told = sinks.store_payloads(rows, folder)
    return told.select("source", "hash", F.regexp_extract("uri", r"([^/]+/[^/]+/[^/]+)$", 1).alias("place"), "disposition")


@query("src12_payload_reread", "SELECT page_id, CASE WHEN page_id % 6 <> 0 THEN octet_length(encode(html)) END::INT AS bytes, page_id % 6 <> 0 AS available FROM pages WHERE html IS NOT NULL", writes=True)
def payload_reread(m: Model):
    rows = m.raw("pages").where("html is not null").select("page_id", F.lit("s").alias("source"), F.col("html").alias("body"))
    stored = sinks.store_payloads(rows, sinks.new_folder(m.spark, "blobs"))
    uris = rows.select("page_id", F.sha2(F.col("body").cast("binary"), 256).alias("hash")).join(stored.select("hash", "uri"), "hash")
    lost = F.when(F.col("page_id") % 6 == 0, F.concat("uri", F.lit(".lost"))).otherwise(F.col("uri"))
    read = sinks.read_payloads(uris.select("page_id", lost.alias("uri")))
    return read.select("page_id", F.octet_length("body").alias("bytes"), "available")


@query(
    "snk2_manifest_hash",
    """SELECT r_name AS region, sha256('{' || chr(10) || '  "names": [' || chr(10) || string_agg('    "' || n_name || '"', ',' || chr(10) ORDER BY n_name) || chr(10) || '  ],' || chr(10) || '  "version": 1' || chr(10) || '}' || chr(10)) AS hash FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""",
)
def manifest_hash(m: Model):
    """The hash of each region's manifest of nations."""
    names = m.raw("nation").join(m.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region")).agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return names.select("region", sinks.manifest_hash(F.to_json(F.struct(F.lit(1).alias("version"), "names"))).alias("hash"))


INCOMING = "SELECT c_custkey AS id, c_name AS name FROM {customer} UNION ALL SELECT c_custkey, upper(c_name) FROM {customer} WHERE c_custkey % 3 = 0"


@query("sm1_ingest_runs", f"SELECT 'r1' AS run, 'complete' AS status, count(*)::BIGINT AS seen, count(DISTINCT id)::BIGINT AS created, (count(*) - count(DISTINCT id))::BIGINT AS reused FROM ({bare(INCOMING)}) UNION ALL SELECT 'r2', 'complete', 2 * count(*) FILTER (c_custkey < 100), 0, 2 * count(*) FILTER (c_custkey < 100) FROM customer", writes=True)
def ingest_runs(m: Model):
    """Files are drained page by page, a second start reads only what is new,
    and the ledger has the counters of both."""
    source, table, ledger, checkpoint = (sinks.new_folder(m.spark, n) for n in ("incoming", "table", "ledger", "progress"))
    schema = "id long, name string"
    m.sql(INCOMING).repartition(3, "id").write.mode("append").json(source)
    for run in ("r1", "r2"):
        ingest.drain(m.spark, source, schema, ["id"], table, ledger, checkpoint, run, 2)
        again = m.sql("SELECT c_custkey AS id, 'again' AS name FROM {customer} WHERE c_custkey < 100")
        again.union(again).coalesce(1).write.mode("append").json(source)
    return ingest.runs(m.spark, ledger).select("run", "status", "seen", "created", "reused")


@query("sm2_ingested_table", f"SELECT id FROM ({bare(INCOMING)}) GROUP BY 1", writes=True)
def ingested_table(m: Model):
    source, table, ledger, checkpoint = (sinks.new_folder(m.spark, n) for n in ("incoming", "table", "ledger", "progress"))
    m.sql(INCOMING).repartition(3).write.mode("append").json(source)
    ingest.ingest(m.spark, source, "id long, name string", ["id"], table, ledger, checkpoint, "r").awaitTermination()
    return ingest.read_or_empty(m.spark, table, "id long, name string").select("id")


@query(
    "q19_resolve_and_audit",
    f"""WITH {FOUND}, i AS ({bare(ITEMS)}),
d AS (SELECT f.*, i.enwiki, (length(f.qid) % 2 = 0 AND i.p_name = title)::INT AS score FROM found f JOIN i ON i.qid = f.qid WHERE i.p_type IN {FILM_TYPES} AND release_year BETWEEN year - 1 AND year),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY route > 0, score DESC, route, place, qid) AS rn FROM d) WHERE rn = 1)
SELECT count(*)::BIGINT AS entries, count(b.qid)::BIGINT AS resolved, (count(*) - count(b.qid))::BIGINT AS unresolved, count(DISTINCT b.qid)::BIGINT AS captured FROM e LEFT JOIN b ON b.position = e.position""",
    writes=True,
)
def resolve_and_capture(m: Model):
    """A list of titles and years, resolved to items whose payloads are captured."""
    resolved = resolution(m)
    qids = selection.all_identifiers(resolved.where("qid is not null").select("qid"))
    captured = sinks.store_payloads(qids.select(F.lit("items").alias("source"), F.concat(F.lit('{"id":"'), "qid", F.lit('"}')).alias("body")), sinks.new_folder(m.spark, "blobs"))
    n = resolved.agg(F.count(F.lit(1)).alias("entries"), F.count("qid").alias("resolved"), F.count_if(F.col("qid").isNull()).alias("unresolved"))
    return n.crossJoin(captured.agg(F.count_if(F.col("disposition") == "created").alias("captured")))  # one row each



@query("sm2_keyed_state", f"SELECT id FROM ({bare(INCOMING)}) GROUP BY 1", writes=True)
def keyed_state(m: Model):
    """Keys as state of the stream, over two starts: the second brings them all
    again and adds none."""
    source, table, checkpoint = (sinks.new_folder(m.spark, n) for n in ("incoming", "table", "progress"))
    for _ in range(2):
        m.sql(INCOMING).repartition(3).write.mode("append").json(source)
        ingest.keyed(m.spark, source, "id long, name string", ["id"], table, checkpoint, 2).awaitTermination()
    return m.spark.read.parquet(table).select("id")


@query("sm5_run_states", f"SELECT 'r1' AS run, 'failed' AS status, 0::BIGINT AS created, true AS has_error UNION ALL SELECT 'r2', 'complete', count(DISTINCT id)::BIGINT, false FROM ({bare(INCOMING)})", writes=True)
def run_states(m: Model):
    """A run whose table cannot be written fails and says why; the next one,
    from where it stopped, completes."""
    source, table, ledger, checkpoint = (sinks.new_folder(m.spark, n) for n in ("incoming", "table", "ledger", "progress"))
    m.sql(INCOMING).coalesce(1).write.json(source)
    sinks.put_text(table, "in the way")
    try:
        ingest.drain(m.spark, source, "id long, name string", ["id"], table, ledger, checkpoint, "r1")
    except Exception:  # noqa: BLE001 - the ledger has it
        pass
    removed(m.spark, table)
    ingest.drain(m.spark, source, "id long, name string", ["id"], table, ledger, checkpoint, "r2")
    return ingest.runs(m.spark, ledger).select("run", "status", "created", F.col("error").isNotNull().alias("has_error"))


@query(
    "prj7_registered_works",
    """SELECT '10.5/' || p_partkey AS doi, trim(p_name) AS title, CASE WHEN p_size % 2 = 0 THEN 'https://x/' || p_partkey ELSE 'https://doi.org/10.5/' || p_partkey END AS url, 1900 + p_size AS year,
 CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_brand || ' ' || p_type END AS author, 'http://l/' || p_size AS license FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0""",
)
def registered_works(m: Model):
    """Bibliographic fields of recorded works; without DOI or title they go."""
    k = F.col("p_partkey")
    doi = F.when(k % 5 == 0, F.when(k % 2 == 0, " ")).otherwise(F.concat(F.lit(" 10.5/"), k))
    title = F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit(" "), "p_name", F.lit(" ")), F.lit("other")))
    dated = F.struct(F.array(F.array((F.col("p_size") + 1900).cast("int"))).alias("date-parts"))
    empty = F.lit(None).cast(bibliography.DATE_PARTS)
    author = F.array(F.struct(F.col("p_brand").alias("given"), F.when(F.col("p_size") % 3 != 0, F.col("p_type")).otherwise("").alias("family")))
    raw = m.raw("part").select(
        doi.alias("DOI"), title.alias("title"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("https://x/"), k)).alias("URL"), F.lit("book").alias("type"), F.when(F.col("p_size") % 2 == 0, dated).otherwise(empty).alias("published"), dated.alias("published-print"), empty.alias("published-online"),
        author.alias("author"), F.lit(None).cast("array<string>").alias("container-title"), F.lit("p").alias("publisher"), F.array(F.struct(F.concat(F.lit("http://l/"), "p_size").alias("URL"))).alias("license"), F.lit(1).alias("is-referenced-by-count"), F.lit("never kept").alias("abstract"),
    )
    rows = bibliography.registered_works(raw)
    return rows.select("doi", "title", "url", F.get(F.get("published.date-parts", 0), 0).alias("year"), F.get("authors", 0).alias("author"), F.get("licenses", 0).alias("license"))


@query(
    "prj7_indexed_works",
    r"""SELECT 'W' || doc_id AS work_id, source AS title, array_to_string(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), ' ') AS abstract, lang AS author, doc_id % 2 = 0 AS is_oa, CASE WHEN doc_id % 3 = 0 THEN 'https://best/' || doc_id ELSE 'https://first/' || doc_id END AS page FROM documents WHERE text IS NOT NULL""",
)
def indexed_works(m: Model):
    """Works whose id ends a URL and whose abstract is rebuilt from its index."""
    index = values.inverted(F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
    k = F.col("doc_id").cast("string")
    place = lambda name: F.struct(F.concat(F.lit(f"https://{name}/"), k).alias("landing_page_url"), F.lit(None).cast("string").alias("license"), F.lit(None).cast("string").alias("pdf_url"))
    author = F.struct(F.struct(F.col("lang").alias("display_name")).alias("author"))
    none = F.struct(F.struct(F.lit("").alias("display_name")).alias("author"))
    raw = m.raw("documents").where("text is not null").select(
        F.concat(F.lit("https://works/W"), k, F.when(F.col("doc_id") % 2 == 0, "/").otherwise("")).alias("id"), F.col("source").alias("title"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("publication_date"), F.array(none, author).alias("authorships"),
        place("first").alias("primary_location"), F.when(F.col("doc_id") % 3 == 0, place("best")).alias("best_oa_location"), F.struct((F.col("doc_id") % 2 == 0).alias("is_oa"), F.lit("x").alias("oa_status")).alias("open_access"), F.col("lang").alias("language"), F.lit(0).alias("cited_by_count"), F.lit("article").alias("type"), index.alias("abstract_inverted_index"),
    )
    rows = bibliography.indexed_works(raw)
    return rows.select("work_id", "title", "abstract", F.get("authors", 0).alias("author"), F.col("open_access.is_oa").alias("is_oa"), F.col("open_access.landing_page_url").alias("page"))


@query(
    "flt15_access_decisions",
    r"""SELECT url, coalesce(status, 0) = 200 AND NOT (starts_with(path, '/private') AND NOT starts_with(path, '/private/open')) AND k % 7 <> 1 AS allowed,
 CASE WHEN status IS NULL THEN 'robots.txt was not retrieved' WHEN status <> 200 THEN 'robots.txt returned HTTP ' || status WHEN starts_with(path, '/private') AND NOT starts_with(path, '/private/open') OR k % 7 = 1 THEN 'disallowed by robots.txt' ELSE 'allowed by robots.txt' END AS reason
FROM (SELECT page_id % 7 AS k, 'https://s' || page_id % 7 || CASE page_id % 3 WHEN 0 THEN '/private/open/' WHEN 1 THEN '/private/' ELSE '/p/' END || page_id AS url, CASE page_id % 3 WHEN 0 THEN '/private/open/' WHEN 1 THEN '/private/' ELSE '/p/' END AS path,
 CASE page_id % 7 WHEN 0 THEN 404 WHEN 2 THEN 503 WHEN 3 THEN NULL ELSE 200 END AS status FROM pages)""",
)
def access_decisions(m: Model):
    """What recorded robots.txt files allow of every page; fails closed."""
    k = F.col("page_id") % 7
    path = F.when(F.col("page_id") % 3 == 0, "/private/open/").when(F.col("page_id") % 3 == 1, "/private/").otherwise("/p/")
    rows = m.raw("pages").select(F.concat(F.lit("https://s"), k, path, F.col("page_id")).alias("url"), k.alias("k"))
    body = F.when(F.col("k") == 1, "User-agent: marquee\nDisallow: /\n\nUser-agent: *\nAllow: /\n").otherwise("User-agent: *\nAllow: /private/open\nDisallow: /private\n")
    status = F.when(F.col("k") == 0, 404).when(F.col("k") == 2, 503).otherwise(200)
    sites = rows.select("k").distinct().where("k <> 3").select(F.concat(F.lit("https://s"), "k").alias("site"), status.alias("status"), body.alias("body"))
    return readers.access_decisions(rows.select("url"), sites, "Marquee/1.0")


@query(
    "flt16_critical_works",
    """WITH w AS (SELECT p_partkey AS k, 'w' || p_partkey AS work, p_size AS s FROM part)
SELECT work, 'empty_title' AS rule FROM w WHERE s % 5 = 0 UNION ALL SELECT work, 'rights_scope' FROM w WHERE s % 7 = 0 UNION ALL SELECT work, 'published_on' FROM w WHERE s % 3 = 0 UNION ALL SELECT work, 'no_subject' FROM w WHERE s % 11 = 0
UNION ALL SELECT work, 'unknown_subject' FROM w WHERE s % 11 <> 0 AND k % 4 = 0 AND k > 0 UNION ALL SELECT work, 'empty_work_kind' FROM w WHERE s % 13 = 0 UNION ALL SELECT work, 'authors' FROM w WHERE s % 17 = 0 UNION ALL SELECT work, 'empty_source_url' FROM w WHERE s % 19 = 0 UNION ALL SELECT work, 'subject_role' FROM w WHERE s % 11 <> 0 AND s % 23 = 0""",
)
def critical_works(m: Model):
    """Every rule that a work of a manifest breaks."""
    s, k = F.col("p_size"), F.col("p_partkey")
    text = lambda n, good: F.when(s % n == 0, " ").otherwise(good)
    subject = F.struct(F.concat(F.lit("Q"), F.when(k % 4 == 0, -k).otherwise(k)).alias("wikidata_id"), F.when(s % 23 == 0, "other").otherwise("primary").alias("role"))
    source = F.struct(F.lit("n").alias("name"), text(19, F.lit("u")).alias("url"), F.lit("t").alias("source_type"), F.lit("l").alias("license"), F.lit("r").alias("rights_status"))
    works = m.raw("part").select(
        F.concat(F.lit("w"), k).alias("external_id"), text(5, F.col("p_name")).alias("title"), F.lit("https://u").alias("canonical_url"), F.when(s % 7 != 0, "metadata_link_only").otherwise("full").alias("rights_scope"), F.when(s % 3 == 0, "99/2001").when(s % 2 == 0, "2001-01-01").alias("published_on"),
        F.when(s % 11 == 0, F.array().cast("array<struct<wikidata_id:string,role:string>>")).otherwise(F.array(subject)).alias("subjects"), text(13, F.lit("essay")).alias("work_kind"), F.lit("l").alias("work_license"), F.lit("en").alias("language_code"), source.alias("source"), F.array(text(17, F.lit("A")), F.lit("B")).alias("authors"),
    )
    return readers.critical_works(works, m.raw("part").select(F.concat(F.lit("Q"), k).alias("qid")))


@query("dt4_counted_at", "SELECT count(*)::BIGINT AS total, true AS counted_now FROM events")
def counted_at(m: Model):
    """A run's counters bear the time at which they were taken."""
    rows = sinks.outcomes(m.raw("events"), ("click",), "event_type")
    return rows.select("total", (F.abs(F.unix_seconds("counted_at") - F.unix_seconds(F.current_timestamp())) < 3600).alias("counted_now"))


@query("snk5_table_versions", "SELECT c_mktsegment AS segment, count(*)::BIGINT AS n FROM customer WHERE c_acctbal >= 0 GROUP BY 1", writes=True)
def table_versions(m: Model):
    """A table's next version is written beside the one that is read for it."""
    folder = sinks.new_folder(m.spark, "versions")
    first = sinks.next_version(m.raw("customer"), folder)
    second = sinks.next_version(m.spark.read.parquet(first).where("c_acctbal >= 0"), folder)
    return m.spark.read.parquet(second).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
