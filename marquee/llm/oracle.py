"""DuckDB SQL for those queries of this subpackage that SQL can express."""

SQL: dict[str, str] = {}
#: Removes the words of repeated 20-word windows, straight from the definition.
SQL["op8_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, p, array_to_string(list_slice(words, p, p + 19), ' ') AS seq FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS p FROM w WHERE len(words) >= 20)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY seq ORDER BY doc_id, p) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS i FROM rep, (SELECT unnest(range(0, 20)) AS k)),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""
#: Keys by a window over their documents.
SQL["op12_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
#: Every phrase of every piece, counted.
SQL["op11_phrase_collocations"] = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
g AS (SELECT lang, array_to_string(list_slice(words, i, i + k - 1), ' ') AS phrase, k FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS t(k))),
f AS MATERIALIZED (SELECT lang, phrase, k, string_split(phrase, ' ') AS words, count(*) AS f FROM g GROUP BY lang, phrase, k),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT lang, phrase, f AS a, cut, array_to_string(words[1:cut], ' ') AS x, array_to_string(words[cut + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
low AS (SELECT cuts.*, fx.f AS l, fy.f AS r, (2000000::HUGEINT * a) // (fx.f + fy.f) AS score FROM cuts JOIN f AS fx ON fx.lang = cuts.lang AND fx.phrase = x JOIN f AS fy ON fy.lang = cuts.lang AND fy.phrase = y
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY (2000000::HUGEINT * a) // (fx.f + fy.f), cut) = 1),
part AS (SELECT lang, array_to_string(list_slice(words, i, i + m - 1), ' ') AS phrase, max(f) AS f FROM (SELECT lang, words, f, m, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3)) AS t(m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN part ON part.lang = low.lang AND part.phrase = low.phrase WHERE part.f IS NULL OR 100 * part.f < 80 * low.a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
"""
#: Every pair of equal words, in islands of one distance.
SQL["op13_periodic_runs"] = r"""
WITH tab AS (SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) AS r(i)),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
h AS (SELECT doc_id, words, len(words) AS n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM d, tab),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
w AS (SELECT doc_id, n, i, words[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1] AS w FROM (SELECT *, unnest(range(n)) AS i FROM p)),
m AS (SELECT x.doc_id, y.i - x.i AS p, x.i FROM w AS x JOIN w AS y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM m) GROUP BY doc_id, p, island),
r AS (SELECT doc_id, start, length, min(p) AS period FROM s WHERE length >= greatest(24, 3 * p) GROUP BY ALL),
told AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS sha FROM r GROUP BY doc_id),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT h.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli, coalesce(sha, sha256('')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM h LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
SQL["op10_warc_dictionary_archive"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN d.payload_bytes >= 100 AND d.page_id <> f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.payload_bytes >= 100 AND d.page_id <> f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
#: Jump hashing by recursion and CRC-32 by bytes.
SQL["op3_jump_hash_sharding"] = """
WITH RECURSIVE jump AS (
  SELECT doc_id, n, (-1)::BIGINT AS b, 0::BIGINT AS j, doc_id::UHUGEINT AS k FROM documents, (VALUES (16), (17)) AS t(n)
  UNION ALL
  SELECT doc_id, n, j AS b, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((k // 8589934592)::DOUBLE + 1)))::BIGINT AS j, k
  FROM (SELECT doc_id, n, j, (k * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS k FROM jump WHERE j < n)),
shards AS (SELECT doc_id, max(b) FILTER (n = 16) AS shard, max(b) FILTER (n = 17) AS grown FROM jump WHERE j >= n GROUP BY doc_id),
tab AS (SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) AS r(i)),
bytes AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS l FROM documents),
crc AS (SELECT doc_id, size, xor(list_reduce(l, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS c FROM bytes, tab)
SELECT s.doc_id, size::BIGINT AS size, c::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard, (row_number() OVER (PARTITION BY shard ORDER BY s.doc_id) - 1)::BIGINT AS slot, grown::INT AS grown_shard
FROM shards s JOIN crc USING (doc_id)
"""
#: All pairs by their common shingles; groups by recursion.
SQL["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, p, p + 4), ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS p FROM w WHERE len(words) > 0)),
n AS (SELECT w.doc_id, count(sh.s) AS n FROM w LEFT JOIN sh ON sh.doc_id = w.doc_id GROUP BY 1),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y, c = p.n AND c = q.n AS same FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.r)
SELECT n.doc_id, (SELECT min(r) FROM reach WHERE reach.doc_id = n.doc_id) AS class_id, (SELECT count(*) FROM link WHERE x = n.doc_id)::BIGINT AS n_links,
  least(n.doc_id, (SELECT min(y) FROM link WHERE x = n.doc_id AND same)) AS copy_of, n.n::INT AS n_shingles FROM n
"""
#: All pairs of vectors.
SQL["op4_cover_tree_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 AND len(a.x) = len(b.x) WHERE list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = v.vec_id)::BIGINT AS n_links, (SELECT min(r) FROM reach WHERE reach.vec_id = v.vec_id) AS component_id, (SELECT min(r) FROM reach WHERE reach.vec_id = v.vec_id) = vec_id AS kept FROM v
"""
