"""Queries over wiki text and chunks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import text, values
from marquee.operators import chunks, lineage
from marquee.plans.registry import query
from marquee.sources.tables import Model, with_model

# ---- chunks ------------------------------------------------------------------

#: The chunker sentence by sentence, as a recursion: a is where the chunk that
#: is open begins, i how many sentences are read, a2 where its overlap begins.
CHUNKS = r"""flat AS (SELECT film, doc_id, trim(regexp_replace(nfc_normalize(content), '\s+', ' ', 'g')) AS t FROM passages WHERE license = 'CC BY-SA 4.0' AND language = 'en' AND attribution_url <> ''),
sent AS (SELECT film, doc_id, list_filter(string_split(regexp_replace(t, '([.?!]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM flat),
sized AS (SELECT *, list_transform(s, lambda x: len(regexp_extract_all(x, '[\p{L}\p{N}_]+(?:[''-][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]'))::BIGINT) AS n FROM sent WHERE len(s) > 0),
step AS (
 SELECT doc_id, n, 0 AS i, 0 AS a, []::STRUCT(a INT, b INT)[] AS done FROM sized
 UNION ALL
 SELECT doc_id, n, i + 1, CASE WHEN NOT shut AND NOT over THEN a WHEN cur2 + n[i + 1] > 360 THEN i ELSE a2 END,
  done || CASE WHEN shut OR over THEN [{'a': a, 'b': i}] ELSE [] END || CASE WHEN shut AND cur2 + n[i + 1] > 360 THEN [{'a': a2, 'b': i}] ELSE [] END
 FROM (SELECT *, coalesce(list_sum(n[a2 + 1 : i]), 0) AS cur2 FROM (SELECT *, cur >= 300 AND i > a AS shut, i > a AND cur < 300 AND cur + n[i + 1] > 360 AS over,
   coalesce(list_max(list_filter(range(a, i), lambda k: list_sum(n[k + 1 : i]) >= 50)), a)::INT AS a2 FROM (SELECT *, coalesce(list_sum(n[a + 1 : i]), 0) AS cur FROM step WHERE i < len(n))))),
ends AS (SELECT doc_id, done || [{'a': a, 'b': i}] AS done FROM step WHERE i = len(n)),
cuts AS (SELECT doc_id, unnest(done) AS c, unnest(range(len(done))) AS ordinal FROM ends),
made AS (SELECT film, doc_id, ordinal::INT AS ordinal, array_to_string(s[c.a + 1 : c.b], ' ') AS content, list_sum(n[c.a + 1 : c.b])::INT AS tokens, (c.b - c.a)::INT AS sentences, list_max(n[c.a + 1 : c.b]) > 360 AS big FROM cuts JOIN sized USING (doc_id)),
told AS (SELECT *, sha256(content) AS content_hash, len(regexp_extract_all(content, '[\p{L}\p{N}_](?:[\p{L}\p{N}_''-]*[\p{L}\p{N}_])?'))::INT AS words FROM made),
flagged AS (SELECT *, concat_ws(',', CASE WHEN words < 40 THEN 'below_minimum_words' END, CASE WHEN big THEN 'oversized_single_sentence' END) AS flags FROM told),
ranked AS (SELECT *, CASE WHEN flags <> '' THEN 'excluded' WHEN row_number() OVER (PARTITION BY content_hash, flags = '' ORDER BY film, doc_id, ordinal) > 1 THEN 'duplicate' ELSE 'eligible' END AS status FROM flagged),
chunk AS (SELECT * REPLACE (CASE WHEN status = 'duplicate' THEN 'exact_duplicate_content' ELSE flags END AS flags) FROM ranked)"""


def licensed_chunks(m: Model):
    p = chunks.licensed(m.passages(), ("CC BY-SA 4.0",)).where("language = 'en'")
    return chunks.deduplicated(chunks.chunks(p, ["film", "doc_id"], "content"), ["film", "doc_id", "ordinal"])


@query("tx8_chunks", with_model("passages", "SELECT film, doc_id, ordinal, content, content_hash, words, tokens, sentences, flags, status FROM chunk", CHUNKS))
def passage_chunks(m: Model):
    """Chunks of all licensed English passages, exact copies marked."""
    return licensed_chunks(m).withColumn("flags", F.array_join("flags", ",")).drop("duplicate_of")


@query(
    "wn2_duplicate_of",
    with_model(
        "passages",
        """SELECT c.film, c.doc_id, c.ordinal, f.film || '/' || f.doc_id || '/' || f.ordinal AS duplicate_of FROM chunk AS c JOIN (SELECT * FROM chunk WHERE status = 'eligible') AS f ON f.content_hash = c.content_hash WHERE c.status = 'duplicate'""",
        CHUNKS,
    ),
)
def duplicate_of(m: Model):
    """Every duplicate chunk and the first one of its content."""
    rows = licensed_chunks(m).where("status = 'duplicate' and array_contains(flags, 'exact_duplicate_content')")
    return rows.select("film", "doc_id", "ordinal", F.concat_ws("/", "duplicate_of.film", "duplicate_of.doc_id", "duplicate_of.ordinal").alias("duplicate_of"))


@query(
    "q12_chunk_report",
    with_model(
        "passages",
        """SELECT count(*)::BIGINT AS chunks, count(*) FILTER (status = 'eligible')::BIGINT AS eligible, count(*) FILTER (status = 'duplicate')::BIGINT AS duplicate, count(*) FILTER (status = 'excluded')::BIGINT AS excluded,
 count(*) FILTER (contains(flags, 'below_minimum_words'))::BIGINT AS below_minimum_words, count(*) FILTER (contains(flags, 'oversized_single_sentence'))::BIGINT AS oversized_single_sentence,
 coalesce(min(tokens) FILTER (status = 'eligible'), 0)::INT AS tokens_min, coalesce(max(tokens) FILTER (status = 'eligible'), 0)::INT AS tokens_max, coalesce(printf('%.2f', avg(tokens) FILTER (status = 'eligible'))::DOUBLE, 0)::DOUBLE AS tokens_average,
 (SELECT coalesce(min(n), 0) FROM per)::BIGINT AS film_min, (SELECT coalesce(max(n), 0) FROM per)::BIGINT AS film_max, (SELECT count(*) FROM per)::BIGINT AS films FROM chunk""",
        CHUNKS + ", per AS (SELECT film, count(*) AS n FROM chunk WHERE status = 'eligible' GROUP BY 1)",
    ),
)
def chunk_report(m: Model):
    return chunks.report(licensed_chunks(m), "film")


@query("tx6_sentences", with_model("passages", "SELECT doc_id, len(s)::INT AS sentences, list_sum(n)::BIGINT AS tokens FROM sized", CHUNKS))
def sentence_counts(m: Model):
    """Sentences and their tokens of all licensed English passages."""
    p = chunks.licensed(m.passages(), ("CC BY-SA 4.0",)).where("language = 'en'")
    s = chunks.sentences(p, ["doc_id"], "content", "language").where(F.size("s") > 0)
    return s.select("doc_id", F.size("s").alias("sentences"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"))


# ---- wiki text -----------------------------------------------------------------

SIGNS = "=[]{}<>|'"
BLANKS = " " * len(SIGNS)


@query(
    "tx2_sections",
    r"""WITH t AS (SELECT doc_id, string_split(translate(text, '=[]{}<>|''', '         '), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, l, i, trim(regexp_replace(substr(l[i + 1], 1, 20), '\s+', ' ', 'g')) AS name, trim(regexp_replace(substr(l[i - 1], 1, 20), '\s+', ' ', 'g')) AS above FROM (SELECT doc_id, l, unnest(range(1, len(l), 2)) AS i FROM t)),
p AS (SELECT doc_id, -1 AS i, ['Lead'] AS path, l[1] || CASE WHEN len(l) > 1 THEN chr(10) ELSE '' END AS content FROM t
 UNION ALL SELECT doc_id, i, CASE WHEN i % 4 = 1 THEN [name] ELSE [above, name] END, chr(10) || l[i + 1] || CASE WHEN i + 1 < len(l) THEN chr(10) || l[i + 2] ELSE '' END || CASE WHEN i + 2 < len(l) THEN chr(10) ELSE '' END FROM h)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS ordinal, array_to_string(list_transform(path, lambda x: coalesce(nullif(trim(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'section')), '/') AS locator, array_to_string(path, ' / ') AS title, sha256(content) AS hash
FROM p WHERE regexp_matches(content, '\S') AND (i < 0 OR lower(path[1]) NOT IN ('notes', 'references', 'external links', 'see also', 'bibliography', 'works cited'))""",
)
def sections(m: Model):
    """Sections of wiki pages made of each document's lines: every second line
    gives its beginning to a heading above it, in turn of two levels."""
    head = lambda x, mark: F.concat(F.lit(f"{mark} "), F.substring(x, 1, 20), F.lit(f" {mark}\n"), x)
    lines = F.transform(F.split(F.translate("text", SIGNS, BLANKS), "\n"), lambda x, i: F.when(i % 4 == 1, head(x, "==")).when(i % 4 == 3, head(x, "===")).otherwise(x))
    wiki = m.raw("documents").select("doc_id", F.array_join(lines, "\n").alias("wiki"))
    return wiki.lateralJoin(text.WikiSections(F.col("wiki").outer())).select("doc_id", "ordinal", "locator", "title", F.sha2("content", 256).alias("hash"))


def wikitext(m: Model):
    """Documents as wiki pages: every line a paragraph with a reference, some
    with links and templates."""
    flat = lambda x: F.trim(F.regexp_replace(F.translate(x, SIGNS, BLANKS), r"\s+", " "))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(flat(x), F.when(i % 3 == 0, F.concat(F.lit(' <ref name="r'), (i % 4).cast("string"), F.lit('" />'))).otherwise(" <ref>x</ref>"), F.when(i % 2 == 0, " [[A|b]] {{t|{{u}}}}").otherwise(" ''c'' [[d]]")))
    return m.raw("documents").select("doc_id", F.array_join(lines, "\n\n").alias("wiki"))


@query("tx1_wikitext", r"""SELECT doc_id, sha256(trim(regexp_replace(array_to_string(list_transform(string_split(translate(text, '=[]{}<>|''', '         '), chr(10)), lambda x: x || '  ' ), '~'), '\s+', ' ', 'g'))) AS h, len(string_split(text, chr(10)))::INT AS paragraphs FROM documents""")
def clean_wikitext(m: Model):
    """Markup around the text goes, the text stays; templates go to a depth
    that differs from page to page."""
    deep = (F.col("doc_id") % 14).cast("int")
    markup = F.concat(F.lit(" {{t|{{u}}}}"), F.repeat(F.lit("{{n|"), deep), F.repeat(F.lit("}}"), deep), F.lit(" <br/> <!-- n\n -->"))
    lines = F.transform(F.split(F.translate("text", SIGNS, BLANKS), "\n"), lambda x: F.concat(x, markup))
    wiki = m.raw("documents").select("doc_id", F.array_join(lines, "~").alias("wiki"), F.size(lines).alias("paragraphs"))
    return wiki.select("doc_id", values.content_hash(text.without_wikitext(F.col("wiki"))).alias("h"), "paragraphs")


@query(
    "tx3_paragraphs",
    r"""WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(translate(x, '=[]{}<>|''', '         '), '\s+', ' ', 'g'))) AS l FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, i, trim(l[i + 1] || CASE WHEN i % 3 = 0 THEN ' <ref name="r' || i % 4 || '" />' ELSE ' <ref>x</ref>' END || CASE WHEN i % 2 = 0 THEN ' [[A|b]] {{t|{{u}}}}' ELSE ' ''''c'''' [[d]]' END) AS raw,
  length(trim(regexp_replace(l[i + 1] || CASE WHEN i % 3 = 0 THEN ' ' ELSE ' x' END || CASE WHEN i % 2 = 0 THEN ' b ' ELSE ' c d' END, '\s+', ' ', 'g'))) AS n FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM l)),
k AS (SELECT doc_id, i, 0 AS pack, n AS total FROM p WHERE i = 0
 UNION ALL SELECT p.doc_id, p.i, CASE WHEN k.total + p.n > 1500 THEN k.pack + 1 ELSE k.pack END, CASE WHEN k.total + p.n > 1500 THEN p.n ELSE k.total + 1 + p.n END FROM k JOIN p ON p.doc_id = k.doc_id AND p.i = k.i + 1)
SELECT doc_id, pack::INT AS ordinal, (sum(n) + count(*) - 1)::INT AS size, sha256(string_agg(raw, chr(10) || chr(10) ORDER BY i)) AS hash FROM k JOIN p USING (doc_id, i) GROUP BY 1, 2""",
)
def packed_paragraphs(m: Model):
    """Paragraphs of each page packed to 1500 readable characters."""
    rows = wikitext(m).select("doc_id", F.posexplode(text.paragraphs_packed(F.col("wiki"))).alias("ordinal", "content"))
    return rows.select("doc_id", "ordinal", F.length(text.without_wikitext(F.col("content"))).alias("size"), values.content_hash(F.col("content")).alias("hash"))


@query("tx4_citations", "SELECT doc_id, array_to_string(list_filter(['r0', 'inline', 'r3', 'r2', 'r1'], lambda x: (x = 'r0') OR (x = 'inline' AND n > 1) OR (x = 'r3' AND n > 3) OR (x = 'r2' AND n > 6) OR (x = 'r1' AND n > 9)), ',') AS markers FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)")
def citations(m: Model):
    return wikitext(m).select("doc_id", F.array_join(text.citation_markers(F.col("wiki")), ",").alias("markers"))


@query("tx5_infobox_years", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN (1970 + p_size) || ',' || (1971 + p_size) WHEN 1 THEN '' WHEN 2 THEN '1899' ELSE (1970 + p_size)::VARCHAR END AS years FROM part")
def infobox_years(m: Model):
    y = lambda n: (F.col("p_size") + n).cast("string")
    kind = F.col("p_partkey") % 4
    line = F.when(kind == 0, F.concat(F.lit("| released = "), y(1971), F.lit(" (x), "), y(1970), F.lit(", again "), y(1971))).when(kind == 1, F.lit("| relaunched = 1999")).when(kind == 2, F.lit("|  RELEASED  =1899/12345"))
    line = line.otherwise(F.concat(F.lit("| Released = {{d|"), y(1970), F.lit("|5}} 120199")))
    return m.raw("part").select(F.col("p_partkey").alias("id"), F.array_join(text.infobox_years(F.concat(F.lit("{{Infobox\n| year = 1801\n"), line, F.lit("\n}} in 1950"))).cast("array<string>"), ",").alias("years"))


#: The labels and questions, one row for each kind of edge.
LINEAGE_COPY = """WITH e AS (SELECT l_orderkey, l_linenumber, ['based_on', 'follows', 'followed_by', 'part_of_series', 'inspired_by'][l_orderkey % 5 + 1] AS predicate, CASE WHEN l_suppkey % 2 = 0 THEN 'outgoing' ELSE 'incoming' END AS direction, CASE l_partkey % 3 WHEN 0 THEN 'film' WHEN 1 THEN 'book' END AS target_kind FROM lineitem),
r(p, d, f, relation_label, q) AS (VALUES ('based_on', NULL, true, 'Film adaptation', 1), ('based_on', NULL, false, 'Source material', 1), ('follows', 'incoming', NULL, 'Next installment', 2), ('followed_by', 'outgoing', NULL, 'Next installment', 2), ('follows', 'outgoing', NULL, 'Previous installment', 3), ('followed_by', 'incoming', NULL, 'Previous installment', 3), ('part_of_series', NULL, NULL, 'Series membership', 4), ('inspired_by', NULL, NULL, 'Related work', 5)),
w(q, writer_question) AS (VALUES (1, 'Which premise, character engine, or pressure system is carried across this adaptation?'), (2, 'What promise does this ending leave open, and how could the next story escalate it?'), (3, 'What story engine does this installment inherit, and what must it transform?'), (4, 'What is the repeatable story promise that holds this work inside the wider series?'), (5, 'What should a writer inspect in this source-backed relationship?'))
SELECT l_orderkey, l_linenumber, predicate, direction, target_kind, relation_label, writer_question FROM e JOIN r ON p = predicate AND (d IS NULL OR d = direction) AND (f IS NULL OR f = coalesce(target_kind = 'film', false)) JOIN w ON w.q = r.q"""


@query("prj6_lineage_copy", LINEAGE_COPY)
def lineage_copy(m: Model):
    """The label and the question of every kind of edge, over made-up edges."""
    kinds = F.array(*[F.lit(x) for x in ("based_on", "follows", "followed_by", "part_of_series", "inspired_by")])
    kind = F.when(F.col("l_partkey") % 3 == 0, "film").when(F.col("l_partkey") % 3 == 1, "book")
    e = m.raw("lineitem").select("l_orderkey", "l_linenumber", kinds[(F.col("l_orderkey") % 5).cast("int")].alias("predicate"), F.when(F.col("l_suppkey") % 2 == 0, "outgoing").otherwise("incoming").alias("direction"), kind.alias("target_kind"))
    return lineage.labelled(e)
