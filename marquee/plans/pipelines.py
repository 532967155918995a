"""Pipeline queries (joins, aggregates, windows, merges, text) and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marquee import schemas
from marquee.functions import text, values
from marquee.operators import bibliography, chunks, merge, relational
from marquee.plans.registry import query
from marquee.sources.tables import Model, with_model

# ---- joins -----------------------------------------------------------------


@query("jn14_pending", "SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type IN ('click', 'view'))")
def pending(m: Model):
    outcomes = m.raw("events").select("user_id", F.col("event_type").alias("status"), F.lit("v1").alias("version"))
    return relational.pending(m.raw("customer").select(F.col("c_custkey").alias("user_id")), outcomes, "user_id", ("click", "view"), "v1")


@query(
    "jn15_reconcile_status",
    """WITH map AS (SELECT p_name AS external, count(DISTINCT p_brand) AS n, min(p_brand) AS one FROM part WHERE p_size < 4 GROUP BY 1),
rec AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 <> 0 THEN p_name END AS external FROM part)
SELECT id, rec.external, CASE WHEN rec.external IS NULL THEN 'unmatched_no_external_id' WHEN n IS NULL THEN 'unmatched_no_target' WHEN n = 1 THEN 'matched' ELSE 'review_required' END AS match_status, CASE WHEN n = 1 THEN one END AS matched FROM rec LEFT JOIN map ON map.external = rec.external""",
)
def reconcile_status(m: Model):
    p = m.raw("part")
    mapping = p.where("p_size < 4").select(F.col("p_name").alias("external"), F.col("p_brand").alias("target"))
    records = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 != 0, F.col("p_name")).alias("external"))
    return relational.reconciled(records, mapping, "external", "target").select("id", "external", "match_status", "matched")


@query("jn16_parents_by_id", "SELECT l_returnflag, n_name, count(*)::BIGINT AS n, sum(l_quantity) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def parents_by_id(m: Model):
    rows = m.raw("lineitem").join(m.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(m.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("l_returnflag", "n_name").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def phrase(c):
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


@query(
    "jn21_phrase_match",
    """WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents),
b AS (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS p FROM benchmark)
SELECT item_id, doc_id FROM b JOIN d ON contains(t, p)""",
)
def phrase_match(m: Model):
    texts = m.raw("documents").select("doc_id", phrase(F.col("text")).alias("t"))
    phrases = m.raw("benchmark").select("item_id", phrase(F.col("text")).alias("p"))
    return relational.phrase_matches(phrases, texts, "item_id", "p", "doc_id", "t", 4)


@query("prj10_correction_overlay", "SELECT p_partkey AS id, coalesce(n, p_name) AS title, p_name AS seed_title FROM part LEFT JOIN (SELECT p_partkey AS k, upper(p_name) AS n FROM part WHERE p_size = 7) ON k = p_partkey")
def correction_overlay(m: Model):
    p = m.raw("part")
    patches = p.where("p_size = 7").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("title"))
    return relational.overlaid(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), patches, "id", "title")


@query("jn5_semi_filter", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_filter(m: Model):
    o = m.raw("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return m.raw("customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


# ---- aggregates --------------------------------------------------------------


STATUSES = ("click", "view", "purchase")


@query("ag11_status_histogram", "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{s}')::BIGINT AS {s}" for s in STATUSES) + " FROM events GROUP BY 1")
def status_histogram(m: Model):
    return relational.histogram(m.raw("events"), ["user_id"], "event_type", STATUSES)


@query("ag12_coverage", "SELECT count(*)::BIGINT AS entries, count(*) FILTER (c_acctbal >= 0)::BIGINT AS verified, printf('%.2f', (100.0::DOUBLE * count(*) FILTER (c_acctbal >= 0) / count(*))::DOUBLE)::DOUBLE AS coverage_percent, (count(c_nationkey) - count(DISTINCT c_nationkey))::BIGINT AS duplicates FROM customer")
def coverage(m: Model):
    return relational.coverage(m.raw("customer"), F.col("c_acctbal") >= 0, "c_nationkey")


@query("ag17_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(m: Model):
    return m.raw("lineitem").select("l_returnflag", "l_linestatus").distinct()


# ---- windows, top-k, sets ------------------------------------------------------


@query("wn2_exact_dedup", "SELECT doc_id, sha256(text) AS hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id)::INT AS rank, CASE WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'eligible' END AS status FROM documents")
def exact_dedup(m: Model):
    return chunks.exact_copies(m.raw("documents").select("doc_id", "text"), "text", ["doc_id"])


YEARS = list(range(1992, 1999))


@query(
    "wn3_stratified_shelf",
    """WITH c AS (SELECT o_custkey AS qid, year(o_orderdate) AS y, max(o_totalprice) AS links FROM orders GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY links DESC, qid) AS r FROM c WHERE y BETWEEN 1992 AND 1998),
k AS (SELECT * FROM t WHERE r <= 14 + CASE WHEN y - 1992 < 2 THEN 1 ELSE 0 END)
SELECT qid, y::INT AS y, links FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY y) AS f FROM k) WHERE f = 1""",
)
def stratified_shelf(m: Model):
    c = m.raw("orders").groupBy(F.col("o_custkey").alias("qid"), F.year("o_orderdate").alias("y")).agg(F.max("o_totalprice").alias("links"))
    return relational.stratified(c, "y", YEARS, 100, [F.desc("links"), "qid"], "qid")


@query("wn5_latest", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest(m: Model):
    return relational.latest(m.raw("events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query("wn4_ordinals", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1)::INT AS ordinal FROM conversations")
def ordinals(m: Model):
    return relational.numbered(m.raw("conversations"), ["conv_id", "role"], ["turn"]).select("conv_id", "turn", "ordinal")


@query("st3_unpivot", "SELECT p_partkey AS id, 'brand' AS role, p_brand AS target FROM part UNION ALL SELECT p_partkey, 'kind', p_type FROM part UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part")
def unpivot(m: Model):
    return relational.unpivoted(m.raw("part").withColumnRenamed("p_partkey", "id"), ["id"], {"p_brand": "brand", "p_type": "kind", "p_size": "size"}, "role", "target")


ROUTES = "(SELECT p_name AS entry, p_partkey AS qid, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS place, 0 AS route FROM part WHERE p_size < 20 UNION ALL SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC), 1 FROM part)"


@query("st4_ordered_union", f"SELECT entry, qid, place::INT AS place, route::INT AS route FROM (SELECT *, row_number() OVER (PARTITION BY entry, qid ORDER BY route, place) AS r FROM {ROUTES}) WHERE r = 1")
def ordered_union(m: Model):
    p = m.raw("part").select(F.col("p_name").alias("entry"), F.col("p_partkey").alias("qid"), "p_size")
    w = Window.partitionBy("entry")
    first = p.where("p_size < 20").withColumn("place", F.row_number().over(w.orderBy("qid"))).drop("p_size")
    second = p.withColumn("place", F.row_number().over(w.orderBy(F.desc("qid")))).drop("p_size")
    return relational.union_in_order([first, second], ["entry"], "qid")


# ---- merges ------------------------------------------------------------------------


def old_customers(m: Model):
    return m.raw("customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))


def new_customers(m: Model):
    return m.raw("customer").where("c_custkey % 2 = 0 OR c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"), F.when(F.col("c_custkey") % 5 != 0, F.lit("NEW")).alias("segment"))


MERGE = "old AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS id, upper(c_name) AS name, CASE WHEN c_custkey % 5 <> 0 THEN 'NEW' END AS segment FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0)"


@query("up_insert_if_absent", f"WITH {MERGE} SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)")
def insert_if_absent(m: Model):
    return merge.insert_if_absent(old_customers(m), new_customers(m), ["id"], ["name"])


@query("up1_update_or_insert", f"WITH {MERGE} SELECT id, coalesce(old.name, new.name) AS name, CASE WHEN old.id IS NULL THEN new.segment ELSE coalesce(new.segment, old.segment) END AS segment FROM old FULL JOIN new USING (id)")
def update_or_insert(m: Model):
    return merge.update_or_insert(old_customers(m), new_customers(m), ["id"], {"segment": None})


@query("up12_dispositions", f"WITH {MERGE} SELECT id, CASE WHEN id IN (SELECT id FROM old) THEN 'reused' ELSE 'created' END AS disposition FROM new")
def dispositions(m: Model):
    return merge.dispositions(old_customers(m), new_customers(m), ["id"])


@query("up_insert_counts", f"WITH {MERGE} SELECT count(*) FILTER (id NOT IN (SELECT id FROM old))::BIGINT AS created, count(*) FILTER (id IN (SELECT id FROM old))::BIGINT AS reused FROM new")
def insert_counts(m: Model):
    return merge.insert_counts(old_customers(m), new_customers(m), ["id"])


ENTITIES = "old AS (SELECT CASE WHEN p_partkey % 11 <> 0 THEN 'Q' || p_partkey END AS qid, CASE WHEN p_size % 4 = 0 THEN 'unknown_work' ELSE 'film' END AS kind, CASE WHEN p_size % 3 = 0 THEN 'Q' || p_partkey ELSE p_name END AS label FROM part WHERE p_partkey % 2 = 0), new AS (SELECT 'Q' || p_partkey AS qid, CASE WHEN p_size % 5 = 0 THEN 'unknown_work' ELSE 'series' END AS kind, upper(p_name) AS label FROM part WHERE p_partkey % 3 = 0)"


def entity_tables(m: Model):
    p, q = m.raw("part"), F.concat(F.lit("Q"), "p_partkey")
    old = p.where("p_partkey % 2 = 0").select(F.when(F.col("p_partkey") % 11 != 0, q).alias("qid"), F.when(F.col("p_size") % 4 == 0, "unknown_work").otherwise("film").alias("kind"), F.when(F.col("p_size") % 3 == 0, q).otherwise(F.col("p_name")).alias("label"))
    new = p.where("p_partkey % 3 = 0").select(q.alias("qid"), F.when(F.col("p_size") % 5 == 0, "unknown_work").otherwise("series").alias("kind"), F.upper("p_name").alias("label"))
    return old, new


@query(
    "up8_entity_upgrade",
    f"""WITH {ENTITIES} SELECT coalesce(o.qid, n.qid) AS qid, CASE WHEN o.qid IS NULL THEN n.kind WHEN o.kind = 'unknown_work' AND n.kind IS NOT NULL THEN n.kind ELSE o.kind END AS kind,
CASE WHEN o.qid IS NULL THEN n.label WHEN o.label = o.qid AND n.label IS NOT NULL THEN n.label ELSE o.label END AS label FROM (SELECT * FROM old WHERE qid IS NOT NULL) o FULL JOIN new n ON o.qid = n.qid UNION ALL SELECT * FROM old WHERE qid IS NULL""",
)
def entity_upgrade(m: Model):
    return merge.upgraded_entities(*entity_tables(m))


@query(
    "up4_genre_adoption",
    """WITH old AS (SELECT DISTINCT CASE WHEN p_brand < 'Brand#3' THEN 'G' || p_brand END AS qid, p_brand AS label FROM part WHERE p_brand < 'Brand#4'), new AS (SELECT DISTINCT 'G' || p_brand AS qid, p_brand AS label FROM part)
SELECT label, CASE WHEN o.label IS NULL THEN n.qid ELSE coalesce(o.qid, n.qid) END AS qid FROM old o FULL JOIN new n USING (label)""",
)
def genre_adoption(m: Model):
    b = m.raw("part").select("p_brand").distinct()
    qid = F.concat(F.lit("G"), "p_brand")
    old = b.where("p_brand < 'Brand#4'").select(F.when(F.col("p_brand") < "Brand#3", qid).alias("qid"), F.col("p_brand").alias("label"))
    return merge.adopted_genres(old, b.select(qid.alias("qid"), F.col("p_brand").alias("label")))


@query("up21_repair", f"WITH {ENTITIES} SELECT o.qid, CASE WHEN kind = 'unknown_work' AND p.l IS NOT NULL THEN 'film' ELSE kind END AS kind, CASE WHEN kind = 'unknown_work' AND p.l IS NOT NULL AND label = o.qid THEN p.l ELSE label END AS label FROM old o LEFT JOIN (SELECT 'Q' || p_partkey AS q, p_name AS l FROM part WHERE p_type = 'PROMO') p ON p.q = o.qid")
def repair(m: Model):
    statements = m.raw("part").where("p_type = 'PROMO'").select(F.concat(F.lit("Q"), "p_partkey").alias("qid"), F.lit("P31").alias("property"), F.lit("Q11424").alias("value"), F.col("p_name").alias("label"))
    return merge.repaired(entity_tables(m)[0], statements, "Q11424")


# ---- scalars and text --------------------------------------------------------------


@query(
    "dt1_parse_date",
    """SELECT o_orderkey AS id, CASE WHEN regexp_matches(substr(v, 1, 10), '^\\d{4}-\\d{2}-\\d{2}$') THEN TRY_CAST(substr(v, 1, 10) AS DATE)::VARCHAR END AS d, TRY_CAST(nullif(regexp_extract('+' || v, '^[+-](\\d{4})-', 1), '') AS INT) AS y
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-31') ELSE strftime(o_orderdate, '%Y/%m/%d') END AS v FROM orders)""",
)
def parse_date(m: Model):
    d = F.col("o_orderdate")
    v = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "yyyy")).when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "yyyy-MM-dd'T00:00:00Z'")).when(F.col("o_orderkey") % 4 == 2, F.concat(F.date_format(d, "yyyy-MM"), F.lit("-31"))).otherwise(F.date_format(d, "yyyy/MM/dd"))
    return m.raw("orders").select(F.col("o_orderkey").alias("id"), values.strict_date(v).cast("string").alias("d"), values.signed_year(F.concat(F.lit("+"), v)).alias("y"))


@query("ar1_json_labels", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE json_extract_string(props, '$.k') END AS labels FROM events")
def json_labels(m: Model):
    bad = F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return m.raw("events").select("event_id", F.array_join(values.map_labels(bad), ",").alias("labels"))


@query("prj8_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 3")
def json_path(m: Model):
    k = F.get_json_object("props", "$.k").cast("long")
    return m.raw("events").select("event_id", k.alias("k")).where("k > 3")


@query("sc1_folded", r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS h FROM documents")
def folded(m: Model):
    return m.raw("documents").select("doc_id", values.content_hash(text.folded(F.col("text"))).alias("h"))


@query("sc2_ascii_tokens", r"SELECT doc_id, sha256(array_to_string(regexp_extract_all(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[a-z0-9]+'), ' ')) AS h FROM documents")
def ascii_tokens(m: Model):
    return m.raw("documents").select("doc_id", values.content_hash(text.ascii_tokens(F.col("text"))).alias("h"))


@query("sc5_slug", "SELECT p_partkey AS id, coalesce(nullif(trim(regexp_replace(lower(p_brand || ' / ' || p_name || '!'), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'section') AS slug FROM part")
def slugs(m: Model):
    return m.raw("part").select(F.col("p_partkey").alias("id"), text.slug(F.concat("p_brand", F.lit(" / "), "p_name", F.lit("!"))).alias("slug"))


@query("sc9_hash", "SELECT page_id, sha256(html) AS h, substr(sha256(html), 1, 2) AS shard FROM pages")
def hashes(m: Model):
    h = values.content_hash(F.col("html"))
    return m.raw("pages").select("page_id", h.alias("h"), F.substring(h, 1, 2).alias("shard"))


@query("sc10_canonical_json", """SELECT p_partkey AS id, sha256('{"brand":"' || p_brand || '","note":null,"size":' || p_size || '}') AS h FROM part""")
def canonical_json(m: Model):
    p = m.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.lit(None).cast("string").alias("note"), F.col("p_size").alias("size"))
    return p.select("id", values.content_hash(values.canonical_json("size", "brand", "note")).alias("h"))


@query("sc11_word_count", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_](?:[\p{L}\p{N}_''-]*[\p{L}\p{N}_])?'))::INT AS words FROM documents")
def word_counts(m: Model):
    return m.raw("documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query("nm1_truncated", "SELECT c_custkey AS id, trunc(c_acctbal)::INT AS n, TRY_CAST(c_mktsegment AS INT) AS none FROM customer")
def truncated(m: Model):
    return m.raw("customer").select(F.col("c_custkey").alias("id"), values.truncated(F.col("c_acctbal").cast("string")).alias("n"), values.truncated(F.col("c_mktsegment")).alias("none"))


@query("tx1_strip_markup", r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<script\b[^>]*>.*?</script>', ' ', 'gsi'), '<style\b[^>]*>.*?</style>', ' ', 'gsi'), '<[^>]+>', ' ', 'gs'), '\s+', ' ', 'g'))) AS h FROM pages")
def strip_markup(m: Model):
    return m.raw("pages").select("page_id", values.content_hash(text.without_markup(F.col("html"))).alias("h"))


@query("tx10_inverted_index", r"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(string_split(text, ' '))), ' ') AS words, text AS rebuilt FROM conversations")
def inverted_index(m: Model):
    w = m.raw("conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("p", "w"))
    index = w.groupBy("conv_id", "turn", "w").agg(F.collect_list("p").alias("ps")).groupBy("conv_id", "turn").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("conv_id", "turn", F.array_join(F.array_sort(F.map_keys("index")), " ").alias("words"), values.rebuilt_text(F.col("index")).alias("rebuilt"))


@query("flt9_licensed", with_model("passages", "SELECT film, count(*)::BIGINT AS n FROM passages WHERE license = 'CC BY-SA 4.0' AND attribution_url <> '' AND language = 'en' GROUP BY 1"))
def licensed(m: Model):
    return chunks.licensed(m.passages(), ("CC BY-SA 4.0",)).where("language = 'en'").groupBy("film").agg(F.count(F.lit(1)).alias("n"))


@query(
    "val_constraints",
    """SELECT rule, key FROM (
 SELECT 'price_positive' AS rule, o_orderkey::VARCHAR AS key FROM orders WHERE NOT o_totalprice > 1000
 UNION ALL SELECT 'status_known', o_orderkey::VARCHAR FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
 UNION ALL SELECT 'orphan', l_orderkey::VARCHAR FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
 UNION ALL SELECT 'duplicate', l_orderkey || '-' || l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
)
def constraints(m: Model):
    o, li = m.raw("orders"), m.raw("lineitem")
    rows = schemas.violations(o, "o_orderkey", {"price_positive": F.col("o_totalprice") > 1000, "status_known": F.col("o_orderstatus").isin("F", "O")})
    orphans = schemas.orphans(li, "l_orderkey", o.where("o_orderstatus <> 'P'").hint("shuffle_hash"), "o_orderkey").select(F.lit("orphan").alias("rule"), F.col("l_orderkey").cast("string").alias("key"))
    twice = schemas.duplicates(li, "l_orderkey", "l_linenumber").select(F.lit("duplicate").alias("rule"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"))
    return rows.union(orphans).union(twice)


# ---- bibliography --------------------------------------------------------------------


@query(
    "q15_discovery_quality",
    """WITH t AS (SELECT p_partkey AS e, p_name AS title, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS p FROM part),
w AS (SELECT t.*, CASE WHEN p_partkey % 3 = 0 THEN part.p_brand ELSE part.p_name || ' ' || p_type END AS wt, part.p_partkey AS k FROM t JOIN part ON part.p_partkey = t.e AND part.p_size < 40),
c AS (SELECT e FROM w WHERE length(p) >= 8 AND contains(trim(regexp_replace(lower(wt), '[^a-z0-9]+', ' ', 'g')), p)),
o AS (SELECT e, CASE WHEN length(p) < 8 THEN 'skipped_ambiguous' WHEN e IN (SELECT e FROM c) THEN 'complete' ELSE 'no_candidates' END AS status FROM t)
SELECT (SELECT count(*) FROM t)::BIGINT AS collection_films, count(*)::BIGINT AS checked, count(*) FILTER (status = 'complete')::BIGINT AS complete, count(*) FILTER (status = 'no_candidates')::BIGINT AS no_candidates, count(*) FILTER (status = 'skipped_ambiguous')::BIGINT AS skipped_ambiguous, 0::BIGINT AS failed, (SELECT count(*) FROM c)::BIGINT AS candidates FROM o""",
)
def discovery_quality(m: Model):
    p = m.raw("part")
    entities = p.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("title"))
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.concat_ws(" ", "p_name", "p_type"))
    works = p.where("p_size < 40").select(F.col("p_partkey").alias("entity_id"), F.concat(F.lit("W"), "p_partkey").alias("work_id"), name.alias("title"), F.lit(None).cast("string").alias("abstract"))
    held = m.spark.createDataFrame([], "entity_id long, work_id string")
    outcomes, fresh = bibliography.discovered(entities, works, held)
    return bibliography.discovery_report(entities, outcomes, fresh)


@query("flt11_safe_titles", "SELECT p_partkey AS id, length(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'))) >= 8 AS safe FROM part")
def safe_titles(m: Model):
    return m.raw("part").select(F.col("p_partkey").alias("id"), bibliography.safe_title(text.ascii_tokens("p_name")).alias("safe"))


@query("sm3_pending_after_failure", "SELECT DISTINCT user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.user_id = e.user_id AND d.event_type = 'purchase' AND d.value > 50)")
def pending_after_failure(m: Model):
    e = m.raw("events")
    done = e.where("value > 50").select("user_id", F.col("event_type").alias("status"), F.lit("v").alias("version"))
    return relational.pending(e.select("user_id").distinct(), done, "user_id", ("purchase",), "v")


@query("ag16_roles", with_model("credits", "SELECT film_id, person_id, string_agg(role, '/' ORDER BY role) AS roles FROM credits GROUP BY 1, 2"))
def roles(m: Model):
    from marquee.operators.catalogue import roles as joined

    return m.credits().groupBy("film_id", "person_id").agg(joined(F.col("role")).alias("roles"))


@query("prj11_manifest_entries", "SELECT row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT AS position, p_brand AS manifest, p_partkey AS id, sha256(p_brand || ':' || p_partkey) AS entry_hash FROM part")
def manifest_entries(m: Model):
    rows = relational.numbered(m.raw("part"), ["p_brand"], ["p_partkey"], "position", 1)
    return rows.select("position", F.col("p_brand").alias("manifest"), F.col("p_partkey").alias("id"), values.content_hash(F.concat_ws(":", "p_brand", "p_partkey")).alias("entry_hash"))


# ---- further joins, merges and text ------------------------------------------------------


@query(
    "up18_classification",
    f"""WITH {ENTITIES}, k AS (SELECT 'Q' || p_partkey AS qid, p_type AS kind, p_brand AS label FROM part WHERE p_size < 25)
SELECT o.qid, CASE WHEN o.kind = 'unknown_work' AND k.qid IS NOT NULL THEN k.kind ELSE o.kind END AS kind, CASE WHEN o.kind = 'unknown_work' AND k.qid IS NOT NULL THEN k.label ELSE o.label END AS label FROM old o LEFT JOIN k ON k.qid = o.qid WHERE o.qid IS NOT NULL""",
)
def classification(m: Model):
    old = entity_tables(m)[0].where("qid is not null")
    kinds = m.raw("part").where("p_size < 25").select(F.concat(F.lit("Q"), "p_partkey").alias("qid"), F.col("p_type").alias("kind"), F.col("p_brand").alias("label"))
    unknown = F.col("old_kind") == "unknown_work"
    known = kinds.join(old.select("qid"), "qid", "left_semi")
    return merge.update_or_insert(old, known, ["qid"], {"kind": unknown & F.col("new_kind").isNotNull(), "label": unknown & F.col("new_kind").isNotNull()})


@query("sc7_entity_ids", "SELECT p_partkey AS id, nullif(regexp_extract(u, '/(Q\\d+)$', 1), '') AS qid, nullif(trim(l), '') AS label, string_split(rtrim(u, '/'), '/')[-1] AS last FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'http://x/entity/Q' || p_partkey || '/' ELSE 'http://x/entity/Q' || p_partkey END AS u, CASE WHEN p_size % 5 = 0 THEN '  ' ELSE ' ' || p_name || ' ' END AS l FROM part)")
def entity_ids(m: Model):
    u = F.concat(F.lit("http://x/entity/Q"), "p_partkey", F.when(F.col("p_size") % 3 == 0, "/").otherwise(""))
    label = F.when(F.col("p_size") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    return m.raw("part").select(F.col("p_partkey").alias("id"), text.entity_id(u).alias("qid"), text.clean_label(label).alias("label"), text.last_part(u).alias("last"))
