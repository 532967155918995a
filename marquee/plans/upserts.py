"""Queries of the write path, each with the key and the policy of its table.

The stored and the incoming rows are statements that Spark and DuckDB both
read; the merge itself is a full join in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from marquee.operators import upserts as up
from marquee.plans.registry import query
from marquee.sources.tables import Model


def bare(text: str) -> str:
    """The statement for DuckDB, where the tables have their names."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


#: What the schema says of each table, for the statements: its key; behind a bar
#: the columns that a filled incoming value replaces, behind another bar those
#: that any incoming value replaces.
RULES = {
    "film": "wikidata_id | release_date runtime countries",
    "release_event": "film_id release_date source_id reference",
    "external_relation": "film_id target type source_id",
    "person": "wikidata_id",
    "film_genre": "film_id genre_id",
    "film_credit": "film_id person_id role",
    "corpus_record": "source_id external_id",
    "narrative_document": "record_id document_type content_hash",
    "entity_alias": "entity_id value language kind",
    "source_record": "source_id external_id",
    "assertion": "subject predicate object value_json reference",
    "snapshot": "object_id revision content_hash",
    "run_snapshot": "run_id snapshot_id",
    "source_assertion": "snapshot_id locator extractor",
    "passage": "snapshot_id locator ordinal content_hash",
    "chunk": "configuration passage_id ordinal",
    "discovery_query": "entity_id provider version | | run_id status candidates",
    "discovery_candidate": "entity_id provider work_id",
    "membership": "collection entity_id",
    "critical_work": "source_id external_id",
    "work_subject": "source_id external_id entity_id role",
    "answer": "entity_id question_id version",
    "answer_evidence": "entity_id question_id passage_id",
    "data_source": "name",
    "access_policy": "source_id mode | | rate",
    "snapshot_entity": "wikidata_id",
    "source_object": "source_id external_id",
    "collection": "code",
}


def merge_sql(name: str, old: str, new: str, columns: str, order: str, prefix: str = "") -> str:
    """A full join of the table and the first incoming row of each key, as
    common table expressions ending in ``{prefix}merged``."""
    key, given, fresh = (x.split() for x in (RULES[name] + " | |").split("|")[:3])
    names = columns.split()
    rest = [c for c in names if c not in key]
    by = ", ".join([*order.split(), *names])

    def value(c: str) -> str:
        if c in fresh:
            return f"CASE WHEN n.turn_ = 1 THEN n.{c} ELSE o.{c} END AS {c}"
        if c in given:
            return f"CASE WHEN o.held THEN CASE WHEN n.turn_ = 1 AND n.{c} IS NOT NULL AND n.{c}::VARCHAR NOT IN ('', '0', '[]') THEN n.{c} ELSE o.{c} END ELSE n.{c} END AS {c}"
        return f"CASE WHEN o.held THEN o.{c} ELSE n.{c} END AS {c}"

    return f"""{prefix}old AS (SELECT *, true AS held FROM ({bare(old)})),
{prefix}new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {", ".join(key)} ORDER BY {by}) AS turn_ FROM ({bare(new)})) WHERE turn_ = 1),
{prefix}merged AS (SELECT {", ".join([*[f"CASE WHEN o.held THEN o.{k} ELSE n.{k} END AS {k}" for k in key], *map(value, rest)])}, CASE WHEN o.held IS NULL THEN 'created' WHEN n.turn_ = 1 THEN 'reused' ELSE 'kept' END AS disposition
 FROM {prefix}old o FULL JOIN {prefix}new n ON {" AND ".join(f"o.{k} IS NOT DISTINCT FROM n.{k}" for k in key)})"""


def plain(name: str, title: str, old: str, new: str, columns: str, order: str = "") -> None:
    """Registers the merge of one table as a query."""

    @query(title, f"WITH {merge_sql(name, old, new, columns, order)} SELECT * FROM merged")
    def merged(m: Model):
        return up.upsert(name, m.sql(old), m.sql(new), *order.split())


# ---- catalogue: films, people, releases, relations ---------------------------------

FILMS_OLD = "SELECT 'Q' || p_partkey AS wikidata_id, p_name AS title, CASE WHEN p_size % 4 <> 0 THEN '19' || (50 + p_size) || '-01-01' END AS release_date, CASE WHEN p_size % 3 <> 0 THEN p_size * 2 END AS runtime, p_brand AS countries FROM {part} WHERE p_partkey % 3 <> 0"
FILMS_NEW = "SELECT 'Q' || p_partkey AS wikidata_id, p_type || ' ' || p_name AS title, CASE WHEN p_size % 5 <> 0 THEN '20' || (10 + p_size) || '-02-02' END AS release_date, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS runtime, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_type END AS countries FROM {part} WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0"
FILM_COLUMNS = "wikidata_id title release_date runtime countries"
plain("film", "up1_films", FILMS_OLD, FILMS_NEW, FILM_COLUMNS, "title")


def film_merge(m: Model):
    return up.upsert("film", m.sql(FILMS_OLD), m.sql(FILMS_NEW), "title")


@query("up1_film_aliases", f"WITH {merge_sql('film', FILMS_OLD, FILMS_NEW, FILM_COLUMNS, 'title')} SELECT wikidata_id, title AS value, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS normalized_value, 'en' AS language FROM merged WHERE disposition = 'created'")
def film_aliases(m: Model):
    return up.aliases_of(film_merge(m), "title")


@query("up1_film_provenance", f"WITH {merge_sql('film', FILMS_OLD, FILMS_NEW, FILM_COLUMNS, 'title')} SELECT wikidata_id, unnest(['canonical_title', 'release_date', 'runtime_minutes', 'original_language_code', 'country_codes']) AS field_name, 'https://www.wikidata.org/wiki/' || wikidata_id AS reference FROM merged WHERE disposition = 'created'")
def film_provenance(m: Model):
    return up.provenance_of(film_merge(m), up.FILM_FIELDS)


PEOPLE_OLD = "SELECT 'Q' || s_suppkey AS wikidata_id, s_name AS name FROM {supplier} WHERE s_suppkey % 4 <> 1"
PEOPLE_NEW = "SELECT 'Q' || l_suppkey AS wikidata_id, 'Person  ' || l_returnflag || l_suppkey AS name FROM {lineitem} WHERE l_linenumber < 4"
plain("person", "up5_people", PEOPLE_OLD, PEOPLE_NEW, "wikidata_id name", "name")


@query("up5_person_aliases", f"WITH {merge_sql('person', PEOPLE_OLD, PEOPLE_NEW, 'wikidata_id name', 'name')} SELECT wikidata_id, name AS value, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS normalized_value, 'en' AS language, 'canonical_name' AS field_name, 'https://www.wikidata.org/wiki/' || wikidata_id AS reference FROM merged WHERE disposition = 'created'")
def person_aliases(m: Model):
    people = up.upsert("person", m.sql(PEOPLE_OLD), m.sql(PEOPLE_NEW), "name")
    return up.aliases_of(people, "name").join(up.provenance_of(people, up.PERSON_FIELDS), "wikidata_id")


EVENT = "SELECT l_partkey AS film_id, cast(cast(l_shipdate AS date) AS string) AS release_date, l_suppkey % 3 AS source_id, CASE WHEN l_suppkey % 5 <> 0 THEN 'r' || l_suppkey % 2 END AS reference, "
plain("release_event", "up2_release_events", EVENT + "min(l_returnflag) AS places FROM {lineitem} WHERE l_linenumber < 3 GROUP BY 1, 2, 3, 4", EVENT + "l_linestatus AS places FROM {lineitem} WHERE l_linenumber > 1", "film_id release_date source_id reference places", "places")
RELATION = "SELECT l_partkey AS film_id, 'Q' || l_orderkey % 50 AS target, CASE WHEN l_linenumber % 2 = 0 THEN 'based_on' ELSE 'follows' END AS type, l_suppkey % 2 AS source_id, "
plain("external_relation", "up3_external_relations", RELATION + "min(l_orderkey) AS reference FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY 1, 2, 3, 4", RELATION + "l_orderkey AS reference FROM {lineitem} WHERE l_returnflag <> 'N'", "film_id target type source_id reference", "reference")
plain("film_genre", "up6_film_genres", "SELECT p_partkey AS film_id, p_type AS genre_id, 1 AS source_id FROM {part} WHERE p_size % 2 = 0", "SELECT p_partkey AS film_id, p_type AS genre_id, 2 AS source_id FROM {part} UNION ALL SELECT p_partkey, p_brand, 2 FROM {part} UNION ALL SELECT p_partkey, p_brand, 3 FROM {part}", "film_id genre_id source_id", "source_id")
plain("film_credit", "up6_film_credits", "SELECT l_partkey AS film_id, l_suppkey AS person_id, l_returnflag AS role, min(l_orderkey) AS reference FROM {lineitem} WHERE l_linestatus = 'F' GROUP BY 1, 2, 3", "SELECT l_partkey AS film_id, l_suppkey AS person_id, l_returnflag AS role, l_orderkey AS reference FROM {lineitem}", "film_id person_id role reference", "reference")

# ---- corpus and evidence -------------------------------------------------------------

plain("corpus_record", "up7_corpus_records", "SELECT c_nationkey % 2 AS source_id, c_name AS external_id, c_mktsegment AS title FROM {customer} WHERE c_custkey % 2 = 0", "SELECT c_nationkey % 2 AS source_id, c_name AS external_id, lower(c_mktsegment) AS title FROM {customer}", "source_id external_id title", "title")
DOCUMENT = "SELECT conv_id AS record_id, role AS document_type, md5(text) AS content_hash, "
plain("narrative_document", "up7_narrative_documents", DOCUMENT + "min(turn) AS turn FROM {conversations} WHERE turn < 2 GROUP BY 1, 2, 3", DOCUMENT + "turn FROM {conversations}", "record_id document_type content_hash turn", "turn")
ALIAS = "SELECT p_partkey AS entity_id, p_name AS value, CASE WHEN p_size % 3 = 0 THEN 'en' END AS language, 'title' AS kind, "
plain("entity_alias", "up9_entity_aliases", ALIAS + "'old' AS origin FROM {part} WHERE p_size % 2 = 0", ALIAS + "'new' AS origin FROM {part} UNION ALL SELECT p_partkey, upper(p_name), 'en', 'credited_name', 'new' FROM {part}", "entity_id value language kind origin", "origin")
plain("source_record", "up10_source_records", "SELECT o_custkey % 7 AS source_id, 'e' || o_custkey AS external_id, min(o_orderkey) AS first_seen FROM {orders} WHERE o_orderstatus = 'F' GROUP BY 1, 2", "SELECT o_custkey % 7 AS source_id, 'e' || o_custkey AS external_id, o_orderkey AS first_seen FROM {orders}", "source_id external_id first_seen", "first_seen")

KINDS = "SELECT 'Q' || p_partkey AS entity_id, CASE WHEN p_size % 3 = 0 THEN 'unknown_work' ELSE 'film' END AS kind FROM {part} WHERE p_partkey % 5 <> 0"
RELATIONS = "SELECT 'Q' || l_orderkey % 100 AS subject, CASE l_linenumber % 3 WHEN 0 THEN 'based_on' ELSE 'follows' END AS predicate, 'Q' || l_partkey AS target, 'r' || l_suppkey % 2 AS reference FROM {lineitem}"
ASSERTIONS = "SELECT 'Q' || l_orderkey % 100 AS subject, 'follows' AS predicate, 'Q' || l_partkey AS object, cast(NULL AS string) AS value_json, 'r' || l_suppkey % 2 AS reference, 'film' AS object_kind, 'published' AS status FROM {lineitem} WHERE l_quantity < 5 GROUP BY 1, 2, 3, 4, 5, 6, 7"
REVIEWED = "SELECT subject, predicate, target AS object, cast(NULL AS string) AS value_json, reference, coalesce(kind, 'unknown_work') AS object_kind, CASE WHEN coalesce(kind, 'unknown_work') = 'unknown_work' THEN 'review_required' ELSE 'resolved' END AS status FROM (" + RELATIONS + ") r LEFT JOIN (" + KINDS + ") k ON k.entity_id = r.target"


@query("up11_assertions", f"WITH {merge_sql('assertion', ASSERTIONS, REVIEWED, 'subject predicate object value_json reference object_kind status', 'status')} SELECT * FROM merged")
def assertions(m: Model):
    return up.upsert("assertion", m.sql(ASSERTIONS), up.reviewed(m.sql(RELATIONS), m.sql(KINDS)), "status")


SNAPSHOTS = "SELECT page_id % 40 AS object_id, CASE WHEN page_id % 3 <> 0 THEN 'v' || page_id % 4 END AS revision, md5(coalesce(url, '')) AS content_hash, min(url) AS url FROM {pages} WHERE page_id % 4 = 0 GROUP BY 1, 2, 3"
CAPTURED = "SELECT page_id % 40 AS object_id, CASE WHEN page_id % 3 <> 0 THEN 'v' || page_id % 4 END AS revision, md5(coalesce(url, '')) AS content_hash, url, 'p' || page_id AS value FROM {pages} WHERE page_id % 2 = 0 UNION ALL SELECT page_id % 40, 'v', md5(coalesce(url, '')), url, 'q' || page_id FROM {pages} WHERE page_id % 5 = 0"
SNAP_MERGE = merge_sql("snapshot", SNAPSHOTS, f"SELECT object_id, revision, content_hash, url FROM ({CAPTURED})", "object_id revision content_hash url", "url")
SNAP_ID = """sha256('{"object_id":' || object_id || ',"revision":' || coalesce('"' || revision || '"', 'null') || ',"content_hash":"' || content_hash || '"}')"""


def capture(m: Model):
    links = m.spark.createDataFrame([], "run_id string, snapshot_id string, found string")
    held = m.spark.createDataFrame([], "snapshot_id string, locator string, extractor string, value string")
    return up.captured(m.sql(SNAPSHOTS), links, held, m.sql(CAPTURED), "run-1", "x1")


@query("up12_snapshots", f"WITH {SNAP_MERGE} SELECT * FROM merged")
def snapshots(m: Model):
    return capture(m)[0]


@query("up12_run_links", f"WITH {SNAP_MERGE} SELECT 'run-1' AS run_id, {SNAP_ID} AS snapshot_id, disposition AS found, 'created' AS disposition FROM merged WHERE disposition <> 'kept'")
def run_links(m: Model):
    return capture(m)[1]


@query("up24_metadata_assertions", f"WITH {SNAP_MERGE}, v AS (SELECT object_id, revision, content_hash, min(value) AS value FROM ({bare(CAPTURED)}) GROUP BY 1, 2, 3) SELECT {SNAP_ID.replace('object_id ', 'm.object_id ').replace('|| content_hash', '|| m.content_hash').replace('|| revision', '|| m.revision')} AS snapshot_id, 'metadata' AS locator, 'x1' AS extractor, value, 'created' AS disposition FROM merged m JOIN v ON v.object_id = m.object_id AND v.revision IS NOT DISTINCT FROM m.revision AND v.content_hash = m.content_hash WHERE disposition = 'created'")
def metadata_assertions(m: Model):
    return capture(m)[2]


PASSAGE = "SELECT conv_id % 20 AS snapshot_id, role AS locator, turn AS ordinal, md5(text) AS content_hash, "
plain("passage", "up13_passages", PASSAGE + "min(conv_id) AS record FROM {conversations} WHERE conv_id % 3 = 0 GROUP BY 1, 2, 3, 4", PASSAGE + "conv_id AS record FROM {conversations}", "snapshot_id locator ordinal content_hash record", "record")
plain("chunk", "up14_chunks", "SELECT 'c1' AS configuration, conv_id AS passage_id, turn AS ordinal, min(text) AS content FROM {conversations} WHERE role = 'user' GROUP BY 1, 2, 3", "SELECT 'c' || (1 + turn % 2) AS configuration, conv_id AS passage_id, turn AS ordinal, 'x' || text AS content FROM {conversations}", "configuration passage_id ordinal content", "content")
plain("discovery_query", "up15_discovery_queries", "SELECT user_id AS entity_id, event_type AS provider, 'v1' AS version, 'run-0' AS run_id, 'failed' AS status, cast(0 AS bigint) AS candidates FROM {events} WHERE event_id % 4 = 0 GROUP BY 1, 2", "SELECT user_id AS entity_id, event_type AS provider, CASE WHEN user_id % 9 = 0 THEN 'v2' ELSE 'v1' END AS version, 'run-1' AS run_id, CASE WHEN count(*) > 2 THEN 'complete' ELSE 'no_candidates' END AS status, count(*) AS candidates FROM {events} GROUP BY 1, 2, 3", "entity_id provider version run_id status candidates", "run_id")
plain("discovery_candidate", "up15_discovery_candidates", "SELECT user_id AS entity_id, event_type AS provider, 'W' || event_id % 9 AS work_id, min(event_id) AS seen FROM {events} WHERE event_id % 3 = 0 GROUP BY 1, 2, 3", "SELECT user_id AS entity_id, event_type AS provider, 'W' || event_id % 9 AS work_id, event_id AS seen FROM {events}", "entity_id provider work_id seen", "seen")
plain("membership", "up16_memberships", "SELECT o_orderpriority AS collection, o_custkey AS entity_id, min(o_orderkey) AS position FROM {orders} WHERE o_orderstatus = 'O' GROUP BY 1, 2", "SELECT o_orderpriority AS collection, o_custkey AS entity_id, o_orderkey AS position FROM {orders}", "collection entity_id position", "position")

WORKS_OLD = "SELECT p_size % 3 AS source_id, p_name AS external_id, min(p_brand) AS title, 'nobody' AS attribution_text FROM {part} WHERE p_size < 20 GROUP BY 1, 2"
WORKS_NEW = "SELECT p_size % 3 AS source_id, p_name AS external_id, p_brand AS title, p_type, 'S' || p_size % 3 AS source_name, p_partkey FROM {part}"


def works(m: Model):
    rows = m.sql(WORKS_NEW).withColumn("authors", F.array(F.concat(F.lit(" "), "p_type"), F.lit("A. Nother "))).withColumn("subjects", F.array(F.struct(F.col("p_partkey").alias("entity_id"), F.lit("primary").alias("role")), F.struct((F.col("p_partkey") % 10).alias("entity_id"), F.lit("context").alias("role"))))
    held = m.spark.createDataFrame([], "source_id int, external_id string, entity_id long, role string")
    return up.works_and_subjects(m.sql(WORKS_OLD), held, rows)


WORK_MERGE = merge_sql("critical_work", WORKS_OLD, f"SELECT source_id, external_id, title, p_type || ', A. Nother — ' || source_name AS attribution_text FROM ({WORKS_NEW})", "source_id external_id title attribution_text", "title")
SUBJECTS = "SELECT DISTINCT p_size % 3 AS source_id, p_name AS external_id, p_partkey AS entity_id, 'primary' AS role FROM part UNION SELECT p_size % 3, p_name, p_partkey % 10, 'context' FROM part"


@query("up17_critical_works", f"WITH {WORK_MERGE} SELECT * FROM merged")
def critical_works(m: Model):
    return works(m)[0]


@query("up17_work_subjects", f"SELECT *, 'created' AS disposition FROM ({SUBJECTS})")
def work_subjects(m: Model):
    return works(m)[1]


@query("up17_counts", f"WITH {WORK_MERGE} SELECT count(*) FILTER (disposition = 'created')::BIGINT AS works_created, count(*) FILTER (disposition = 'reused')::BIGINT AS works_reused, (SELECT count(*) FROM ({SUBJECTS}))::BIGINT AS subject_links_created FROM merged")
def work_counts(m: Model):
    return works(m)[2]


ENTITIES = "SELECT p_partkey AS entity_id, CASE WHEN p_size % 6 <> 0 THEN 'Q' || p_partkey END AS wikidata_id, CASE WHEN p_size % 2 = 0 THEN 'unknown_work' ELSE 'film' END AS kind, 'Q' || p_partkey AS label FROM {part}"
WAITING = "SELECT l_orderkey AS assertion_id, l_linenumber AS line, l_partkey AS object, 'unknown_work' AS object_kind, CASE WHEN l_returnflag = 'A' THEN 'published' ELSE 'review_required' END AS status FROM {lineitem}"
FOUND = "SELECT 'Q' || p_partkey AS wikidata_id, p_type AS kind, p_name AS label FROM {part} WHERE p_partkey % 3 = 0 UNION ALL SELECT 'Q-none', 'film', 'x' FROM {region}"


@query("up18_entities", f"WITH e AS ({bare(ENTITIES)}), f AS (SELECT DISTINCT * FROM ({bare(FOUND)})) SELECT entity_id, e.wikidata_id, coalesce(f.kind, e.kind) AS kind, coalesce(f.label, e.label) AS label FROM e LEFT JOIN f ON f.wikidata_id = e.wikidata_id")
def classified_entities(m: Model):
    return up.classified(m.sql(ENTITIES), m.sql(WAITING), m.sql(FOUND))[0]


@query("up18_assertions", f"WITH e AS ({bare(ENTITIES)}), f AS (SELECT DISTINCT * FROM ({bare(FOUND)})), k AS (SELECT entity_id, f.kind FROM e JOIN f ON f.wikidata_id = e.wikidata_id) SELECT assertion_id, line, object, CASE WHEN status = 'review_required' AND k.kind IS NOT NULL THEN k.kind ELSE object_kind END AS object_kind, CASE WHEN status = 'review_required' AND k.kind IS NOT NULL THEN 'resolved' ELSE status END AS status FROM ({bare(WAITING)}) a LEFT JOIN k ON k.entity_id = a.object")
def classified_assertions(m: Model):
    return up.classified(m.sql(ENTITIES), m.sql(WAITING), m.sql(FOUND))[1]


plain("answer", "up20_answers", "SELECT conv_id AS entity_id, 'q' || turn % 3 AS question_id, 'v1' AS version, min(text) AS answer FROM {conversations} WHERE conv_id % 2 = 0 GROUP BY 1, 2", "SELECT conv_id AS entity_id, 'q' || turn % 3 AS question_id, 'v1' AS version, text AS answer FROM {conversations} WHERE role = 'assistant'", "entity_id question_id version answer", "answer")
plain("data_source", "up22_data_sources", "SELECT n_name AS name, 'old' AS url FROM {nation} WHERE n_nationkey % 3 = 0", "SELECT n_name AS name, 'u' || n_nationkey AS url FROM {nation} UNION ALL SELECT r_name, 'r' FROM {region}", "name url", "url")
plain("access_policy", "up22_access_policies", "SELECT c_nationkey AS source_id, c_mktsegment AS mode, 30 AS rate, 'n' || min(c_custkey) AS notes FROM {customer} WHERE c_custkey % 5 = 0 GROUP BY 1, 2", "SELECT c_nationkey AS source_id, c_mktsegment AS mode, 60 + max(c_nationkey) AS rate, 'changed' AS notes FROM {customer} WHERE c_custkey % 3 = 0 GROUP BY 1, 2", "source_id mode rate notes", "rate")
ITEMS_OLD = "SELECT 'Q' || p_partkey AS wikidata_id, p_name AS label FROM {part} WHERE p_size % 5 = 0"
ITEMS_NEW = "SELECT 'Q' || l_partkey AS wikidata_id, CASE WHEN l_partkey % 4 = 0 THEN ' ' WHEN l_partkey % 4 = 1 THEN NULL ELSE 'Page ' || l_partkey END AS title FROM {lineitem}"


@query("up23_snapshot_entities", f"WITH {merge_sql('snapshot_entity', ITEMS_OLD, f'SELECT wikidata_id, coalesce(nullif(trim(title), {chr(39) * 2}), wikidata_id) AS label FROM ({ITEMS_NEW})', 'wikidata_id label', 'label')} SELECT * FROM merged")
def snapshot_entities(m: Model):
    return up.snapshot_entities(m.sql(ITEMS_OLD), m.sql(ITEMS_NEW))


plain("source_object", "up25_source_objects", "SELECT s_nationkey AS source_id, s_name AS external_id, 'page' AS kind FROM {supplier} WHERE s_suppkey % 3 = 0", "SELECT s_nationkey AS source_id, s_name AS external_id, 'entity' AS kind FROM {supplier} UNION ALL SELECT s_nationkey, lower(s_name), 'page' FROM {supplier}", "source_id external_id kind", "kind")
plain("collection", "up25_collections", "SELECT r_name AS code, 'first' AS title FROM {region} WHERE r_regionkey < 2", "SELECT r_name AS code, 'second' AS title FROM {region}", "code title", "title")


@query("up_rerun_counters", "SELECT unnest(['film', 'membership', 'source_record']) AS name, 0::BIGINT AS created")
def rerun_counters(m: Model):
    """A second run of the same input creates nothing."""
    runs = {
        "film": (FILMS_OLD, FILMS_NEW),
        "membership": ("SELECT o_orderpriority AS collection, o_custkey AS entity_id, o_orderkey AS position FROM {orders} WHERE o_orderkey < 0", "SELECT o_orderpriority AS collection, o_custkey AS entity_id, o_orderkey AS position FROM {orders}"),
        "source_record": ("SELECT o_custkey AS source_id, o_orderpriority AS external_id FROM {orders} WHERE o_orderkey < 0", "SELECT o_custkey AS source_id, o_orderpriority AS external_id FROM {orders}"),
    }
    out = None
    for name, (old, new) in runs.items():
        first = up.upsert(name, m.sql(old), m.sql(new)).drop("disposition")
        told = up.counters(up.upsert(name, first, m.sql(new))).select(F.lit(name).alias("name"), "created")
        out = told if out is None else out.union(told)
    return out
