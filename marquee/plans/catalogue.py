"""Catalogue queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions.values import plural
from marquee.operators import catalogue, lineage, signals
from marquee.plans.registry import query
from marquee.sources.tables import Model, with_model

GENRES = "(SELECT film_id, string_agg(label, ', ' ORDER BY label) AS genres FROM (SELECT DISTINCT film_id, label FROM genres) GROUP BY film_id)"


def flat(items):
    """Genres as one string and the date as text, the same in every engine."""
    return items.withColumn("genres", F.array_join("genres", ", ")).withColumn("release_date", F.col("release_date").cast("string"))


TARGET = 13


@query(
    "q11_similar_films",
    with_model(
        "films genres credits",
        f"""SELECT f.id, f.title, least(100, s)::DOUBLE AS score, sg::BIGINT AS shared_genres, sp::BIGINT AS shared_people FROM (
 SELECT f.*, coalesce(g.n, 0) AS sg, coalesce(p.n, 0) AS sp,
  least(45, 15 * coalesce(g.n, 0)) + least(35, 12 * coalesce(p.n, 0)) + CASE WHEN abs(year(f.release_date) - year(t.release_date)) <= 10 THEN 20 - 2 * abs(year(f.release_date) - year(t.release_date)) ELSE 0 END AS s
 FROM films f CROSS JOIN (SELECT * FROM films WHERE id = {TARGET}) t
 LEFT JOIN (SELECT film_id, count(DISTINCT label) AS n FROM genres WHERE label IN (SELECT label FROM genres WHERE film_id = {TARGET}) GROUP BY 1) g ON g.film_id = f.id
 LEFT JOIN (SELECT film_id, count(DISTINCT person_id) AS n FROM credits WHERE person_id IN (SELECT person_id FROM credits WHERE film_id = {TARGET}) GROUP BY 1) p ON p.film_id = f.id
 WHERE f.status = 'published' AND f.id <> {TARGET}) f WHERE s > 0 ORDER BY s DESC, f.title, f.id LIMIT 8""",
    ),
)
def similar_films(m: Model):
    """The 8 films most like one film."""
    return signals.similar(TARGET, m.films(), m.genres(), m.credits()).select("id", "title", "score", "shared_genres", "shared_people")


PAIRS = "pairs AS (SELECT id AS first, id + 1 AS second FROM films)"
SIGNALS = """sig AS (
SELECT p.first, p.second, 'Shared genres' AS label, 0.45::DOUBLE AS weight, least(45, 15 * count(*))::DOUBLE AS contribution, string_agg(a.label, ', ' ORDER BY a.label) AS evidence
 FROM pairs p JOIN genres a ON a.film_id = p.first JOIN genres b ON b.film_id = p.second AND b.label = a.label GROUP BY 1, 2
UNION ALL
SELECT first, second, 'Shared creative collaborators', 0.35::DOUBLE, least(35, 12 * count(*))::DOUBLE, array_to_string(list_slice(list(told ORDER BY name, person_id), 1, 4), ', ') || CASE WHEN count(*) > 4 THEN ' and more' ELSE '' END
 FROM (SELECT p.first, p.second, n.name, n.person_id, n.name || ' (' || string_agg(DISTINCT r.role, '/' ORDER BY r.role) || ')' AS told
  FROM pairs p JOIN (SELECT DISTINCT film_id, person_id FROM credits) a ON a.film_id = p.first JOIN (SELECT DISTINCT film_id, person_id FROM credits) b ON b.film_id = p.second AND b.person_id = a.person_id
  JOIN credits r ON r.person_id = a.person_id AND r.film_id IN (p.first, p.second) JOIN people n ON n.person_id = a.person_id GROUP BY 1, 2, 3, 4) GROUP BY 1, 2
UNION ALL
SELECT first, second, 'Release era', 0.2::DOUBLE, (20 - 2 * gap)::DOUBLE, 'Released ' || gap || CASE WHEN gap = 1 THEN ' year' ELSE ' years' END || ' apart'
 FROM (SELECT p.first, p.second, abs(year(a.release_date) - year(b.release_date)) AS gap FROM pairs p JOIN films a ON a.id = p.first JOIN films b ON b.id = p.second) WHERE gap <= 10)"""


def consecutive(m: Model):
    return m.films().select(F.col("id").alias("first"), (F.col("id") + 1).alias("second"))


@query("q6_compare_signals", with_model("films genres credits people", "SELECT * FROM sig", f"{PAIRS}, {SIGNALS}"))
def compare_signals(m: Model):
    return signals.pair_signals(consecutive(m), m.films(), m.genres(), m.credits(), m.people())


@query(
    "q6_compare_summaries",
    with_model(
        "films genres credits people",
        """SELECT p.first, p.second, count(s.label)::BIGINT AS n, coalesce(sum(contribution), 0)::DOUBLE AS points,
 CASE WHEN count(s.label) = 0 THEN 'No direct metadata connection was found in the current catalog.' ELSE count(s.label) || ' evidence-backed connection' || CASE WHEN count(s.label) = 1 THEN '' ELSE 's' END || ' found.' END AS summary
 FROM pairs p LEFT JOIN sig s ON s.first = p.first AND s.second = p.second GROUP BY 1, 2""",
        f"{PAIRS}, {SIGNALS}",
    ),
)
def compare_summaries(m: Model):
    return signals.comparisons(consecutive(m), m.films(), m.genres(), m.credits(), m.people())


PAGE = "SELECT p.id, p.title, p.runtime, p.release_date::VARCHAR AS release_date, g.genres FROM page p LEFT JOIN " + GENRES + " g ON g.film_id = p.id"


def page_sql(where: str, limit: int, offset: int) -> str:
    return with_model("films genres", PAGE, f"page AS (SELECT * FROM films WHERE status = 'published' AND {where} ORDER BY release_date DESC NULLS FIRST, title, id LIMIT {limit} OFFSET {offset})")


@query("q4_film_search", page_sql("title ILIKE '%an%'", 24, 3))
def film_search(m: Model):
    return flat(catalogue.search(m.films(), m.genres(), q=" an ", limit=24, offset=3)).select("id", "title", "runtime", "release_date", "genres")


@query("q4_genre_decade", page_sql("id IN (SELECT film_id FROM genres WHERE label ILIKE 'brand#1_') AND release_date >= DATE '1985-01-01' AND release_date < DATE '1995-01-01'", 50, 0))
def genre_decade(m: Model):
    return flat(catalogue.search(m.films(), m.genres(), genre="brand#1_", decade=1985, limit=50)).select("id", "title", "runtime", "release_date", "genres")


CREDITS = "(SELECT film_id, string_agg(c.role || ':' || n.name, ';' ORDER BY c.role, n.name, n.person_id) AS credits FROM credits c JOIN people n ON n.person_id = c.person_id GROUP BY film_id)"


@query(
    "q8_film_detail",
    with_model(
        "films genres credits people aliases",
        f"""SELECT f.id, f.title, f.runtime, f.release_date::VARCHAR AS release_date, g.genres, c.credits, a.aliases FROM films f LEFT JOIN {GENRES} g ON g.film_id = f.id LEFT JOIN {CREDITS} c ON c.film_id = f.id
 LEFT JOIN (SELECT film_id, string_agg(value, ';' ORDER BY value) AS aliases FROM (SELECT DISTINCT film_id, value FROM aliases) GROUP BY 1) a ON a.film_id = f.id""",
    ),
)
def film_detail(m: Model):
    d = flat(catalogue.details(m.films(), m.genres(), m.credits(), m.people(), m.aliases()))
    told = F.array_join(F.transform("credits", lambda c: F.concat(c["role"], F.lit(":"), c["name"])), ";")
    return d.select("id", "title", "runtime", "release_date", "genres", told.alias("credits"), F.array_join("aliases", ";").alias("aliases"))


@query(
    "q9_filmography",
    with_model(
        "films credits",
        """SELECT person_id, row_number() OVER (PARTITION BY person_id ORDER BY release_date DESC NULLS LAST, title, id)::INT AS position, id, title, release_date::VARCHAR AS release_date
 FROM (SELECT DISTINCT person_id, film_id FROM credits) c JOIN films f ON f.id = c.film_id""",
    ),
)
def filmography(m: Model):
    return catalogue.filmography(m.films(), m.credits()).withColumn("release_date", F.col("release_date").cast("string"))


@query(
    "q10_person_graph",
    with_model(
        "credits people",
        """SELECT film_id, position::INT AS position, 'person:' || person_id AS source, 'film:' || film_id AS target, label, credits > least(people, 16) AS truncated FROM (
 SELECT *, row_number() OVER (PARTITION BY film_id ORDER BY rank, name, person_id) AS position, sum(n) OVER (PARTITION BY film_id) AS credits, count(*) OVER (PARTITION BY film_id) AS people
 FROM (SELECT c.film_id, c.person_id, n.name, min(CASE role WHEN 'director' THEN 0 WHEN 'writer' THEN 1 ELSE 2 END) AS rank, string_agg(role, '/' ORDER BY role) AS label, count(*) AS n FROM credits c JOIN people n ON n.person_id = c.person_id GROUP BY 1, 2, 3)) WHERE position <= 16""",
    ),
)
def person_graph(m: Model):
    return catalogue.person_graph(m.credits(), m.people())


EDGES = """both_ways AS (
 SELECT subject AS entity_id, object AS target_id, assertion_id, predicate, 'outgoing' AS direction FROM assertions WHERE status IN ('resolved', 'published')
 UNION ALL SELECT object, subject, assertion_id, predicate, 'incoming' FROM assertions WHERE status IN ('resolved', 'published')),
told AS (SELECT b.*, e.label AS target_title, e.kind AS target_kind, CASE WHEN predicate = 'part_of_series' THEN 'Series membership'
  WHEN (predicate = 'followed_by') = (direction = 'outgoing') THEN 'Next installment' ELSE 'Previous installment' END AS relation_label FROM both_ways b JOIN entities e ON e.entity_id = b.target_id),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, target_id, relation_label ORDER BY direction DESC, assertion_id) AS r FROM told) WHERE r = 1)"""


@query(
    "q7_lineage_edges",
    with_model("entities assertions", "SELECT entity_id, position::INT AS position, relation_label, direction, target_id, target_title, target_kind, assertion_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY relation_label, target_title, target_id) AS position FROM firsts) WHERE position <= 12", EDGES),
)
def lineage_edges(m: Model):
    return lineage.edges(m.assertions(), m.entities()).select("entity_id", "position", "relation_label", "direction", "target_id", "target_title", "target_kind", "assertion_id")


@query(
    "q7_lineage_summaries",
    with_model("entities assertions", "SELECT entity_id, n::BIGINT AS routes, n || ' source-backed lineage route' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' found.' AS summary FROM (SELECT entity_id, least(12, count(*)) AS n FROM firsts GROUP BY 1)", EDGES),
)
def lineage_summaries(m: Model):
    n = lineage.edges(m.assertions(), m.entities()).groupBy("entity_id").agg(F.count(F.lit(1)).alias("routes"))
    return n.withColumn("summary", F.concat(plural(F.col("routes"), "source-backed lineage route", "source-backed lineage routes"), F.lit(" found.")))


@query(
    "q5_entry_points",
    with_model(
        "entities assertions",
        """SELECT subject AS entity_id, e.label AS title, count(*)::BIGINT AS routes, count(*) FILTER (predicate IN ('follows', 'followed_by', 'part_of_series'))::BIGINT AS installments
 FROM assertions a JOIN entities e ON e.entity_id = a.subject WHERE status IN ('resolved', 'published') AND e.kind = 'film' GROUP BY 1, 2 ORDER BY installments DESC, routes DESC, title, entity_id LIMIT 6""",
    ),
)
def entry_points(m: Model):
    works = m.entities().where("kind = 'film'").select("entity_id", F.col("label").alias("title"))
    return lineage.entry_points(works, m.assertions()).select("entity_id", "title", "routes", "installments")


@query(
    "q1_health",
    with_model("films people credits", "SELECT (SELECT count(*) FROM films)::BIGINT AS films, (SELECT count(*) FROM people)::BIGINT AS people, (SELECT count(*) FROM credits)::BIGINT AS credits, (SELECT count(*) FROM region)::BIGINT AS sources, (SELECT strftime(max(o_orderdate), '%Y-%m-%d') FROM orders) AS latest, CASE WHEN (SELECT count(*) FROM films) > 0 THEN 'ready' ELSE 'empty' END AS status"),
)
def health(m: Model):
    return catalogue.health(m.films(), m.people(), m.credits(), m.raw("region"), m.raw("orders"), "o_orderdate").withColumn("latest", F.date_format("latest", "yyyy-MM-dd"))


def corpus(m: Model):
    """Customers as corpus records of their region, orders as documents."""
    nation = m.raw("nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("source_id"))
    status = F.when(F.col("c_mktsegment") == "BUILDING", "matched").when(F.col("c_mktsegment") == "MACHINERY", "review_required").otherwise("unmatched_no_target")
    records = m.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("record_id"), "source_id", status.alias("match_status"))
    return records, m.raw("orders").select(F.col("o_custkey").alias("record_id"))


@query(
    "q2_source_quality",
    """WITH r AS (SELECT c_custkey AS record_id, n_regionkey AS source_id, c_mktsegment AS s FROM customer JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT source_id, count(*) AS records, count(*) FILTER (s = 'BUILDING') AS matched, count(*) FILTER (s = 'MACHINERY') AS review_required FROM r GROUP BY 1),
d AS (SELECT source_id, count(*) AS narrative_documents FROM orders JOIN r ON o_custkey = record_id GROUP BY 1)
SELECT r_name AS name, coalesce(records, 0)::BIGINT AS records, coalesce(matched, 0)::BIGINT AS matched, coalesce(review_required, 0)::BIGINT AS review_required, coalesce(narrative_documents, 0)::BIGINT AS narrative_documents
FROM region LEFT JOIN n ON n.source_id = r_regionkey LEFT JOIN d ON d.source_id = r_regionkey""",
)
def source_quality(m: Model):
    sources = m.raw("region").select(F.col("r_regionkey").cast("long").alias("source_id"), F.col("r_name").alias("name"))
    return catalogue.source_quality(sources, *corpus(m)).drop("source_id")


@query("q3_editions", "SELECT code, 'Edition ' || code AS display_name, (CASE code WHEN 'en' THEN 0 WHEN 'te' THEN 1 WHEN 'hi' THEN 2 WHEN 'ta' THEN 3 ELSE 99 END)::INT AS rank FROM (SELECT DISTINCT lang AS code FROM documents)")
def editions(m: Model):
    return catalogue.editions(m.raw("documents").select(F.col("lang").alias("code")).distinct().withColumn("display_name", F.concat(F.lit("Edition "), "code")))


@query("q18_liveness", "SELECT 'ok' AS status")
def liveness(m: Model):
    return m.spark.range(1).select(F.lit("ok").alias("status"))


@query("prj2_provenance", "SELECT s_suppkey AS person_id, r_name AS source_name, n_name AS field_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def provenance(m: Model):
    sources = m.raw("region").select(F.col("r_regionkey").alias("source_id"), F.col("r_name").alias("source_name"))
    rows = m.raw("supplier").join(m.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("person_id"), F.col("n_regionkey").alias("source_id"), F.col("n_name").alias("field_name"))
    return catalogue.provenance(rows, sources).select("person_id", "source_name", "field_name")


@query("jn19_era_neighbours", with_model("films", "SELECT a.id, year(a.release_date)::INT AS year, (count(*) - 1)::BIGINT AS neighbours FROM films a JOIN films b ON abs(year(a.release_date) - year(b.release_date)) <= 10 GROUP BY 1, 2"))
def era_neighbours(m: Model):
    return signals.era_neighbours(m.films())


TREE = "tree AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION SELECT 'r' || r_regionkey, 'world' FROM region UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"


@query("jn30_hierarchy", with_model("", "SELECT child, ancestor, min(depth)::INT AS depth FROM up GROUP BY 1, 2", f"{TREE}, up AS (SELECT child, child AS ancestor, 0 AS depth FROM (SELECT child FROM tree UNION SELECT parent FROM tree) UNION ALL SELECT up.child, parent, depth + 1 FROM up JOIN tree ON tree.child = ancestor)"))
def hierarchy(m: Model):
    tree = m.raw("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    tree = tree.union(m.raw("region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit("world"))).union(m.raw("customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")))
    return lineage.closure(tree, "child", "parent")
