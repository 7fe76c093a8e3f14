"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from contactgraph.llm import url_filter

#: All windows are formed and compared by the MD5 of their words.
SUBSTRING_DEDUP = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM words WHERE len(w) >= 50
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM starts
), firsts AS (
  SELECT h, min(doc_id) AS first FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)
), hits AS (
  SELECT doc_id, i FROM windows JOIN firsts USING (h) WHERE doc_id > first
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hits
), places AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM words
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

#: Every source is sorted whole by rank; a document is taken as long as its middle
#: lies within the remainder.
SOURCE_MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 
    CAST(sum(CAST(floor(sqrt(size) * size * 1000) AS HUGEINT)) AS DOUBLE) / 1000 AS measured FROM sized GROUP BY source
), weighed AS (
  SELECT *, 2 * CAST(source_size AS DOUBLE) AS stop,
    CAST([3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM sums
), levels AS (
  SELECT *, stop / weight AS by_weight,
    (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(stop) OVER before, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY stop / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT *, least(stop, coalesce(weight * (
    SELECT level FROM levels WHERE level <= by_weight ORDER BY by_weight, level LIMIT 1
  ), stop)) AS target
  FROM levels
), plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
), goals AS (
  SELECT *, target - whole * source_size AS goal,
    CASE WHEN measured > 0 THEN (target - whole * source_size) / measured ELSE 0 END AS scale
  FROM plans
), drawn AS (
  SELECT d.*, g.source_size, g.target, g.whole, g.goal,
    CAST(CAST('0x' || substring(md5('42|' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u,
    least(greatest(scale * sqrt(size), CAST(1e-9 AS DOUBLE)), 1 - CAST(1e-9 AS DOUBLE)) AS p
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
), ranked AS (
  SELECT *, u * (1 - p) / (u * (1 - p) + (1 - u) * p) AS rank FROM drawn
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) - size / 2 AS middle
  FROM ranked
)
SELECT doc_id, size, source_size, target,
  CAST((whole + CASE WHEN goal > 0 AND middle <= goal THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM placed
"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


#: Every rule and every term is tried on every url.
URL_FILTER = rf"""
WITH rules(host, path, verdict) AS (VALUES {_values(url_filter.RULES)}),
vocabulary(term, weight) AS (VALUES {_values(url_filter.VOCABULARY.items())}),
rests AS (
  SELECT row_number() OVER () AS n, page_id, coalesce(url, '') AS url,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT n, page_id, url, regexp_extract(rest, '^[^/?#]*') AS raw,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rests
), lowered AS (
  SELECT *, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS scanned
  FROM parts
), fitting AS (
  SELECT p.n, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
  FROM lowered p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
), counted AS (
  SELECT p.n, v.term, v.weight, len(regexp_extract_all(
    regexp_replace(scanned, '([^\pL\pN])', '', 'g'), '(^|[^\pL\pN])' || v.term || '($|[^\pL\pN])')) AS hits
  FROM lowered p JOIN vocabulary v ON contains(p.scanned, v.term)
), summed AS (
  SELECT n, sum(CASE WHEN weight >= {url_filter.LIMIT} THEN hits ELSE 0 END) AS strict_hits,
    sum(CASE WHEN weight < {url_filter.LIMIT} THEN hits ELSE 0 END) AS soft_hits,
    count(*) FILTER (weight < {url_filter.LIMIT}) AS soft_terms, sum(weight) AS weight
  FROM counted WHERE hits > 0 GROUP BY n
)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN weight >= {url_filter.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(coalesce(strict_hits, 0) AS BIGINT) AS strict_hits, CAST(coalesce(soft_hits, 0) AS BIGINT) AS soft_hits,
  CAST(coalesce(soft_terms, 0) AS BIGINT) AS soft_terms, CAST(coalesce(weight, 0) AS BIGINT) AS weight
FROM lowered LEFT JOIN (SELECT * FROM fitting WHERE place = 1) USING (n) LEFT JOIN summed USING (n)
"""

#: Every anchor is scored against every row.
HARD_NEGATIVES = """
WITH good AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS other_id, b.label AS other_label,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM good a JOIN good b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE anchor_label = other_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id
WHERE anchor_label <> other_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def _leaf(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    told = [f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields]
    return f"sha256({' || '.join(told)})"


#: Every level of every tree is a step of a recursion, and so is every fold. The
#: checksum goes byte by byte through the table of its polynomial.
MERKLE_MANIFEST = f"""
WITH RECURSIVE bytes AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs
), leaves AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND doc_id IS NOT NULL AND xor(4294967295, list_reduce(
      [4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
      lambda c, d: xor(c >> 8, crcs[(xor(c, d) & 255) + 1]))) % 7 = 0
    THEN {_leaf("(n_chars + 1)")} END AS again
  FROM documents, bytes
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, n) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS size
  FROM leaves
), nodes(tree, level, pos, size, h) AS (
  SELECT tree, 0, pos, size, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM nodes WHERE size > 1 GROUP BY tree, level, pos // 2, size
), subroots AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1
), tops(level, pos, size, h) AS (
  SELECT 0, pos, size, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM tops WHERE size > 1 GROUP BY level, pos // 2, size
), steps AS (
  SELECT p.n, l.level AS step, (p.pos >> l.level) & 1 AS odd, s.h AS sibling
  FROM placed p JOIN (SELECT DISTINCT tree, level FROM nodes WHERE size > 1) l USING (tree)
    LEFT JOIN nodes s ON s.tree = p.tree AND s.level = l.level AND s.pos = xor(p.pos >> l.level, 1)
  UNION ALL
  SELECT p.n, 1000 + l.level, (r.pos >> l.level) & 1, s.h
  FROM placed p JOIN subroots r USING (tree) CROSS JOIN (SELECT DISTINCT level FROM tops WHERE size > 1) l
    LEFT JOIN tops s ON s.level = l.level AND s.pos = xor(r.pos >> l.level, 1)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY step) AS k FROM steps
), folds(n, k, h) AS (
  SELECT n, 0, coalesce(again, leaf) FROM placed
  UNION ALL
  SELECT f.n, f.k + 1, sha256(CASE WHEN sibling IS NULL THEN h WHEN odd = 1 THEN sibling || h ELSE h || sibling END)
  FROM folds f JOIN numbered s ON s.n = f.n AND s.k = f.k + 1
), proofs AS (
  SELECT n, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256 FROM steps GROUP BY n
), ends AS (
  SELECT n, arg_max(h, k) AS folded_root FROM folds GROUP BY n
)
SELECT doc_id, leaf, r.h AS subroot, t.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
  folded_root = t.h AS verified
FROM placed p JOIN subroots r USING (tree) JOIN ends USING (n) LEFT JOIN proofs USING (n), tops t WHERE t.size = 1
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_substring_dedup": SUBSTRING_DEDUP,
        "op6_source_mixing": SOURCE_MIXING,
        "op11_url_filter": URL_FILTER,
        "op12_hard_negatives": HARD_NEGATIVES,
        "op13_merkle_manifest": MERKLE_MANIFEST,
    }
