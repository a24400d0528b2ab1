"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from .urls import LONG_SUFFIXES


def _crc_step(value: int, bits: int) -> int:
    """The reflected CRC-32 register after that many zero bits."""
    for _ in range(bits):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


#: For each half byte of the register: after 4 more bits, and after 256 more bytes.
_CRC_TABLE = ", ".join(str(_crc_step(v, 4)) for v in range(16))
_CRC_SKIP = "0"
for _k in range(8):
    _CRC_SKIP = f"xor({_CRC_SKIP}, ([{', '.join(str(_crc_step(v << 4 * _k, 2048)) for v in range(16))}])[1 + (c >> {4 * _k} & 15)])"

ORACLES: dict[str, str] = {}

ORACLES["op10_rendezvous_shards"] = """
WITH keyed AS (
  SELECT doc_id, text, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(strlen(text), 0)::BIGINT + 16 AS size FROM documents
), bytes AS (
  SELECT *, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM keyed
), starts AS (
  SELECT r, h, length(h) // 2 - 256 * ((length(h) // 2 - 1) // 256) AS head, unnest(range(0, (length(h) + 511) // 512)) AS i FROM bytes WHERE h <> ''
), chunks AS (
  SELECT r, i, CASE WHEN i = 0 THEN h[1:2 * head] ELSE h[2 * (head + 256 * (i - 1)) + 1:2 * (head + 256 * i)] END AS h FROM starts
), states AS (
  SELECT r, i, list_reduce(list_transform(range(1, length(h) + 1), lambda j: strpos('123456789ABCDEF', h[j - 1 + 2 * (j %% 2)])),
    lambda c, b: xor(c >> 4, ([%s])[1 + (xor(c, b) & 15)]), CASE WHEN i = 0 THEN 4294967295 ELSE 0 END::BIGINT) AS s FROM chunks
), ends AS (
  SELECT r, xor(list_reduce(list(s ORDER BY i), lambda c, b: xor(b, %s)), 4294967295) AS crc FROM states GROUP BY r
), summed AS (
  SELECT doc_id, k, size, coalesce(crc, 0)::BIGINT AS text_crc32 FROM bytes LEFT JOIN ends USING (r)
), drawn AS (
  SELECT *, list_transform(range(0, 41), lambda s:
      -ln((('0x' || substring(md5(k || ':' || (s // 4)::VARCHAR), (8 * (s %% 4) + 1)::INT, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0)) AS e
  FROM summed
), placed AS (
  SELECT *, list_position(e[1:40], list_min(e[1:40])) - 1 AS shard, e[41] < list_min(e[1:40]) AS moves,
    ('0x' || substring(md5(concat_ws(':', k, text_crc32::VARCHAR, size::VARCHAR)), 1, 8))::BIGINT %% 4096 AS part
  FROM drawn
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  (CASE WHEN moves THEN 40 ELSE shard END)::INTEGER AS grown_shard
FROM placed
""" % (_CRC_TABLE, _CRC_SKIP)

ORACLES["op8_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
), told AS (
  SELECT doc_id, max(CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), outcomes AS (
  SELECT host, bad FROM (SELECT host, try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})([^0-9]|$)', 1), '') AS BIGINT) AS doc FROM parts) JOIN told ON doc = doc_id
), named AS (
  SELECT *, regexp_replace(host, '^.*@', '') AS named, regexp_matches(regexp_replace(host, '^.*@', ''), '^([0-9.]+|\[[^\]]*\])(:[0-9]*)?$') AS address
  FROM (SELECT host, count(*) AS n, sum(bad) AS bad FROM outcomes GROUP BY host)
), labelled AS (
  SELECT *, string_split(regexp_replace(named, ':.*$', ''), '.') AS bare FROM named
), widths AS (
  SELECT *, CASE WHEN list_contains({LONG}, list_aggregate(bare[greatest(1, len(bare) - 1):], 'string_agg', '.')) THEN 2 ELSE 1 END AS wide FROM labelled
), hosts AS (
  SELECT host, n, bad, CASE WHEN address THEN regexp_replace(named, '([0-9\]]):[0-9]*$', '\1') ELSE list_aggregate(bare[greatest(1, len(bare) - wide):], 'string_agg', '.') END AS domain,
    CASE WHEN address THEN '' ELSE list_aggregate(bare[greatest(1, len(bare) - wide + 1):], 'string_agg', '.') END AS suffix FROM widths
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL
), suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL
), overall AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) AS m FROM suffixes
), s1 AS (SELECT s.*, m FROM suffixes s, overall
), p1 AS (SELECT 1 / least(greatest(coalesce(sum(bad * (bad - 1.0) - 2 * m * (n - 1.0) * bad + m * m * n * (n - 1.0)) / nullif(sum(m * (1 - m) * n * (n - 1.0)), 0), 0), 1 / 1001.0), 0.5) - 1 AS w FROM s1
), d1 AS (SELECT d.*, (s1.bad + w * m) / (s1.n + w) AS m FROM domains d JOIN s1 USING (suffix), p1
), p2 AS (SELECT 1 / least(greatest(coalesce(sum(bad * (bad - 1.0) - 2 * m * (n - 1.0) * bad + m * m * n * (n - 1.0)) / nullif(sum(m * (1 - m) * n * (n - 1.0)), 0), 0), 1 / 1001.0), 0.5) - 1 AS w FROM d1
), h1 AS (SELECT h.*, (d1.bad + w * m) / (d1.n + w) AS m FROM hosts h JOIN d1 USING (domain), p2
), p3 AS (SELECT 1 / least(greatest(coalesce(sum(bad * (bad - 1.0) - 2 * m * (n - 1.0) * bad + m * m * n * (n - 1.0)) / nullif(sum(m * (1 - m) * n * (n - 1.0)), 0), 0), 1 / 1001.0), 0.5) - 1 AS w FROM h1
), posterior AS (SELECT host, bad + w * m AS a, n - bad + w * (1 - m) AS b FROM h1, p3
), topped AS (SELECT *, a * ln(a / (a + b)) + b * ln(b / (a + b)) AS top FROM posterior
), points AS (SELECT exp(s - exp(-s)) AS t, ln(0.125::DOUBLE * (1 + exp(-s))) + s - exp(-s) AS w FROM (SELECT k * 0.125::DOUBLE AS s FROM range(-24, 57) r(k))
), sides AS (
  SELECT host, sum(exp(-a * ln(1 + exp(-t)) - b * (t + ln(1 + exp(-t))) - top + w)) AS above, sum(exp(-a * (t + ln(1 + exp(-t))) - b * ln(1 + exp(-t)) - top + w)) AS below
  FROM topped, points GROUP BY host
)
SELECT page_id, host, path, rule, CASE WHEN rule = 'example.net/en/' OR rule = 'org/fr/' THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN above / (above + below) >= 0.95 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN sides USING (host)
""".replace("{LONG}", str(list(LONG_SUFFIXES)))

ORACLES["op3_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, '')))) AS tie FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, source_size * 2.0::DOUBLE AS cap FROM sources
), levels AS (
  SELECT *, cap / w AS level, (SELECT sum(source_size)::BIGINT FROM sources) * 1.5::DOUBLE AS total, sum(w) OVER () AS all_w FROM weighed
), full_ones AS (
  SELECT *, sum(cap) OVER v + level * (all_w - sum(w) OVER v) <= total AS is_full FROM levels
  WINDOW v AS (ORDER BY level RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), shared AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE least(w * (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())
    / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (), cap) END AS target FROM full_ones
), ranked AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each_one,
    row_number() OVER (PARTITION BY d.source ORDER BY size, tie) - 1 AS rank,
    ('0x' || substring(md5('mix:' || coalesce(d.source, '')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS start
  FROM sized d JOIN shared s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, target,
  (least(floor((rank + 1) * each_one + start) - floor(rank * each_one + start), 2) * size)::BIGINT AS taken FROM ranked
"""

ORACLES["op6_warc_convert"] = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), owned AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS owner FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM owned
"""

ORACLES["op7_ball_tree_top_k"] = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""

ORACLES["op4_rp_forest_near_dedup"] = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
), roots AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN roots ON id = vec_id LEFT JOIN counts ON a = vec_id
"""

ORACLES["op1_line_dedup"] = r"""
WITH cut AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL
), said AS (
  SELECT doc_id, pos, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM cut
), filled AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM said WHERE words > 0
), met AS (
  SELECT a.doc_id, b.doc_id AS first_id, a.place - b.place AS apart, a.place, a.pos, a.words FROM filled a JOIN filled b ON a.s = b.s AND b.doc_id < a.doc_id
), runs AS (
  SELECT *, place - row_number() OVER (PARTITION BY doc_id, first_id, apart ORDER BY place) AS run FROM met
), blocks AS (
  SELECT doc_id, min(pos) AS low, max(pos) AS high FROM runs GROUP BY doc_id, first_id, apart, run HAVING sum(words) >= 25
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(low, high + 1)) AS pos FROM blocks
), told AS (
  SELECT doc_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS removed FROM gone GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM said ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, (CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END)::INTEGER AS n_lines, coalesce(removed, '') AS removed,
  CASE WHEN removed IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES["op9_fast_similarity_sketch"] = r"""
WITH RECURSIVE said AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM said
), held AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.id, w.b FROM reach r JOIN ways w ON r.other = w.a
), roots AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN roots ON id = doc_id
"""
