"""DuckDB statements for the queries that SQL can express on whole small tables."""

from __future__ import annotations

# CRC-32: the table follows from the reflected polynomial 0xEDB88320, the digest folds over the bytes.
_CRC = """
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
)
"""

_GROWN = ", ".join(f"('0x' || substr(md5(k || '/{i}'), 1, 13))::BIGINT" for i in range(25))

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = "[^\\x20\\x09-\\x0D]+"
_FOLDED = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES: dict[str, str] = {
    "op6_rendezvous_sharding": f"""
WITH {_CRC},
bytes AS (
  SELECT doc_id, text, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h, coalesce(doc_id::VARCHAR, '') AS k FROM documents
),
summed AS (
  SELECT doc_id, n + 8 AS size, k,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda b: ('0x' || b)::BIGINT)),
                         lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS text_crc32
  FROM bytes, crc_table
),
scored AS (SELECT *, [{_GROWN}] AS u FROM summed),
placed AS (
  SELECT *, list_position(u[1:24], list_max(u[1:24])) - 1 AS shard, list_position(u, list_max(u)) - 1 AS grown_shard FROM scored
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k), 1, 2), doc_id, text_crc32, size) - 1 AS slot,
       grown_shard::INT AS grown_shard
FROM placed
""",
    "op5_wu_manber_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_FOLDED} AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_FOLDED} AS ws FROM benchmark),
p AS (SELECT DISTINCT item, least(len(ws), 8) AS n, array_to_string(list_slice(ws, i, i + least(len(ws), 8) - 1), ' ') AS k FROM b, unnest(range(1, greatest(len(ws) - 7, 1) + 1)) t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM p),
w AS (SELECT rid, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS k FROM d, sizes, unnest(range(1, len(ws) - n + 2)) t(i)),
h AS (SELECT rid, i, n, item FROM w JOIN p USING (n, k)),
words AS (SELECT rid, count(*) AS c FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
items AS (SELECT rid, count(*) AS c, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(words.c, 0)::BIGINT AS n_hit, coalesce(items.c, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(items.c, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
""",
    "op8_minhash_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS k FROM d, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT doc_id AS v, doc_id AS root FROM d UNION SELECT b, root FROM reach JOIN links ON a = v WHERE root < b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(root) AS root FROM reach GROUP BY v) m ON m.v = d.doc_id
""",
    "op9_suffix_array_dedup": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT rid, doc_id, i, substr(x, 2 * i - 1, 100) AS k FROM d, unnest(range(1, n - 48)) t(i)),
f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k),
c AS (SELECT rid, i FROM w JOIN f USING (k) WHERE first < doc_id),
b AS (SELECT rid, x, j, c.i FROM d JOIN (SELECT DISTINCT rid FROM c) USING (rid), unnest(range(1, n + 1)) t(j) LEFT JOIN c ON c.rid = d.rid AND c.i = j),
g AS (SELECT rid, x, j, coalesce(j - max(i) OVER (PARTITION BY rid ORDER BY j) < 50, false) AS gone FROM b),
e AS (SELECT *, lag(gone, 1, false) OVER (PARTITION BY rid ORDER BY j) AS before FROM g),
o AS (SELECT rid, count(*) FILTER (gone) AS removed, count(*) FILTER (gone AND NOT before) AS spans, sha256(unhex(coalesce(string_agg(substr(x, 2 * j - 1, 2), '' ORDER BY j) FILTER (NOT gone), ''))) AS kept FROM e GROUP BY rid)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, coalesce(kept, sha256(encode(t))) AS kept_sha256 FROM d LEFT JOIN o USING (rid)
""",
    "op10_substring_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
w AS (SELECT rid, doc_id, i, array_to_string(list_slice(ws, i, i + 49), ' ') AS k FROM d, unnest(range(1, len(ws) - 48)) t(i)),
f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k),
c AS (SELECT rid, i FROM w JOIN f USING (k) WHERE first < doc_id),
b AS (SELECT d.rid, ws[j] AS word, j, c.i FROM d JOIN (SELECT DISTINCT rid FROM c) s ON s.rid = d.rid, unnest(range(1, len(ws) + 1)) t(j) LEFT JOIN c ON c.rid = d.rid AND c.i = j),
g AS (SELECT rid, word, j, coalesce(j - max(i) OVER (PARTITION BY rid ORDER BY j) < 50, false) AS gone FROM b),
o AS (SELECT rid, count(*) FILTER (gone) AS removed, sha256(coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '')) AS kept FROM g GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(kept, sha256(array_to_string(ws, ' '))) AS kept_sha256 FROM d LEFT JOIN o USING (rid)
""",
}
