"""SQL twins for DuckDB."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM d, range(1, len(w) - 48) r(i)),
mine AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM win),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM mine, range(0, 50) x(o) WHERE first < doc_id),
words AS (SELECT doc_id, p, w[p] AS word FROM d, range(1, len(w) + 1) r(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p)
         GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS c, count(*) FILTER (q IS NULL) AS spans
      FROM (SELECT g.doc_id, h.p AS q FROM gone g LEFT JOIN gone h ON g.doc_id = h.doc_id AND h.p = g.p - 1)
      GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256, coalesce(spans, 0) AS n_spans
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k FROM d, range(0, len(h) // 2 - 49) r(i)),
mine AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM win),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM mine WHERE first < doc_id),
run AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END)
               OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
gone AS (SELECT doc_id, r, min(i) AS lo, max(i) + 50 AS hi FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, lo AS stop, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS start FROM gone
        UNION ALL SELECT d.doc_id, len(h) // 2, coalesce(max(hi), 0) FROM d LEFT JOIN gone USING (doc_id)
        GROUP BY d.doc_id, h),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY start) AS t
         FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(hi - lo) AS c, count(*) AS spans FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(c, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT {id} AS a, {id} AS b FROM {table} UNION SELECT a, y FROM reach JOIN e ON b = x),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) >= 5 THEN w[i:i + 4] ELSE w END, ' ') AS k
      FROM d, range(1, greatest(len(w) - 4, least(len(w), 1)) + 1) r(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id
      GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
      WHERE 100 * shared >= 75 * (nx.n + ny.n - shared)),
{_REACH.format(id='doc_id', table='documents')}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON a = d.doc_id
"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id
      WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
{_REACH.format(id='vec_id', table='embeddings')},
n AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n ON x = vec_id JOIN c ON a = vec_id
"""

# The checksum is reckoned byte by byte with the table of the reflected polynomial 0xEDB88320.
SHARDING = """
WITH tab AS (SELECT list(list_reduce(range(8), lambda a, x:
    CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) ORDER BY i) AS t FROM range(256) r(i)),
b AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
      FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1]), 4294967295),
        4294967295) AS text_crc32 FROM b, tab),
r AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS run,
        sum(size) OVER () AS total FROM c),
s AS (SELECT *, CAST((2 * run - size) * 40 // (2 * total) AS INT) AS shard FROM r)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard
    ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard FROM s
"""

ORACLES = {
    "op6_sharding": SHARDING,
    "op3_embedding_dedup": EMBEDDING_DEDUP,
    "op8_ngram_join": NGRAM_JOIN,
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op10_suffix_dedup": SUFFIX_DEDUP,
}
