"""SQL (DuckDB) of the queries whose whole result SQL can express."""

from __future__ import annotations

from tamis.llm.centroids import CLUSTERS, DIMENSIONS, ROUNDS, SCALE, SEED
from tamis.llm.licenses import MARKS, TEMPLATES

_LITERALS = ", ".join(f"({at}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for at, (name, text) in enumerate(TEMPLATES))
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    """Words without punctuation at their edges."""
    marks = MARKS.replace("'", "''")
    bare = f"trim({_ASCII_LOWER.format(text)}, '{marks}' || chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    between = r"[!-/:-@\[-`{-~]*[\x20\x09-\x0D][\x09-\x0D\x20-/:-@\[-`{-~]*"
    return f"CASE WHEN {bare} = '' THEN [] ELSE regexp_split_to_array({bare}, '{between}') END"


LICENSES = rf"""
WITH templates(template, license, body) AS (VALUES {_LITERALS}),
t_words AS (SELECT template, license, {_words("body")} AS w FROM templates),
t_shingles AS (
  SELECT DISTINCT template, license, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM t_words)
),
t_sizes AS (SELECT template, count(*) AS n FROM t_shingles GROUP BY 1),
d_words AS (SELECT doc_id, row_number() OVER () AS r, {_words("coalesce(text, '')")} AS w FROM documents),
d_shingles AS (
  SELECT r, i - 1 AS place, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d_words WHERE len(w) >= 5)
),
hits AS (SELECT r, place, s, template, license, n FROM d_shingles JOIN t_shingles USING (s) JOIN t_sizes USING (template)),
placed AS (SELECT r, template, license, n, s, place // n AS window_at FROM hits UNION ALL
           SELECT r, template, license, n, s, place // n - 1 FROM hits WHERE place // n >= 1),
shares AS (SELECT r, license, count(DISTINCT s) / n AS share FROM placed GROUP BY r, template, license, n, window_at),
found AS (
  SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT license) AS n_licenses, max(share) AS containment
  FROM shares WHERE share >= 0.8 GROUP BY r
)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n_licenses, 0)::INTEGER AS n_licenses, coalesce(containment, 0.0)::DOUBLE AS containment
FROM d_words LEFT JOIN found USING (r)
"""

MIX = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat('0:', coalesce(doc_id::VARCHAR, ''))) AS key
  FROM documents
),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS top,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place
  FROM sized GROUP BY source
),
shares AS (
  SELECT *, top::DOUBLE / weight AS ratio,
         (sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rest,
         sum(weight) OVER (ORDER BY top::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS opened
  FROM by_source
),
first_open AS (
  SELECT rest, opened FROM shares WHERE NOT (top::DOUBLE * opened <= rest * weight) ORDER BY ratio, place LIMIT 1
),
targets AS (
  SELECT source, source_size,
         CASE WHEN top::DOUBLE * opened <= rest * weight THEN top::DOUBLE
              ELSE weight * (SELECT rest FROM first_open) / (SELECT opened FROM first_open) END AS target
  FROM shares
),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
),
rounds AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS n,
         CASE WHEN source_size > 0 THEN floor(target)::BIGINT % source_size ELSE 0 END AS r
  FROM placed
)
SELECT doc_id, size, source_size, target, (n * size + greatest(0, least(size, r - start)))::BIGINT AS taken FROM rounds
"""

ARCHIVES = r"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
told AS (
  SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
         CASE WHEN strlen(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS keeper
  FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keeper OR keeper IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN NULL ELSE keeper END AS refers_to
FROM told
"""

EXACT = f"""
WITH normalised AS (SELECT doc_id, {_ASCII_LOWER.format("coalesce(text, '')")} AS body FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM normalised WINDOW same AS (PARTITION BY body)
"""

_ASSIGN = """
a{0} AS MATERIALIZED (
  SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT r, c, list_sum(list_transform(list_zip(vectors.v, c{0}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM vectors, c{0}) GROUP BY r
)"""
_MOVE = """
m{0} AS MATERIALIZED (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY place)::BIGINT[] AS v
  FROM (
    SELECT c, place, sum(v[place])::HUGEINT AS s, count(*) AS n
    FROM a{0} JOIN vectors USING (r), range(1, {2} + 1) AS places(place) GROUP BY c, place
  ) GROUP BY c
),
c{1} AS MATERIALIZED (SELECT c, coalesce(m{0}.v, c{0}.v) AS v FROM c{0} LEFT JOIN m{0} USING (c))"""

CENTROIDS = f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = {DIMENSIONS}
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
  FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM vectors ORDER BY h, v LIMIT {CLUSTERS})
),{",".join(_ASSIGN.format(i) + "," + _MOVE.format(i, i + 1, DIMENSIONS) for i in range(ROUNDS))},{_ASSIGN.format(ROUNDS)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM vectors JOIN a{ROUNDS} USING (r) JOIN c{ROUNDS} USING (c)
"""

_TERMS = rf"regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED = f"""
WITH split AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS found FROM documents),
held AS (SELECT r, doc_id, len(found) AS n FROM split WHERE len(found) > 0),
stats AS (SELECT count(*) AS all_documents, sum(n) AS all_terms FROM held),
items AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS found FROM benchmark),
asked AS (SELECT q, unnest(found) AS term FROM items),
counted AS MATERIALIZED (
  SELECT r, term, count(*) AS tf
  FROM (SELECT r, unnest(found) AS term FROM split) WHERE term IN (SELECT term FROM asked) GROUP BY r, term
),
weights AS (
  SELECT term, floor(1000 * ln((2 * all_documents + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), stats
),
impacts AS (
  SELECT r, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * all_documents) // all_terms)) AS impact
  FROM counted JOIN held USING (r), stats
),
scores AS (SELECT q, r, sum(w * impact)::BIGINT AS score FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY q, r HAVING sum(w * impact) > 0),
ranked AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scores JOIN held USING (r))
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked JOIN items USING (q) WHERE rank <= 50
"""
