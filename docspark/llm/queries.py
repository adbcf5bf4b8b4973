"""The registered queries of this subpackage and their SQL."""

from .ann import op8_ann
from .centroids import op12_centroids
from .counting import op5_token_counts
from .fingerprints import op2_syncmers
from .language import op10_language
from .minhash import op1_minhash
from .mixing import op3_mixing
from .negatives import op13_hard_negatives
from .packing import op4_packing
from .pieces import op11_pieces
from .repeats import op7_substring_dedup, op9_suffix_dedup
from .secrets import op6_secrets

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_syncmers": op2_syncmers,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op6_secrets": op6_secrets,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_ann": op8_ann,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_language": op10_language,
    "op11_pieces": op11_pieces,
    "op12_centroids": op12_centroids,
    "op13_hard_negatives": op13_hard_negatives,
}

WORDS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i+19], ' ') ORDER BY doc_id, i) AS r FROM p),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM k WHERE r > 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1),
every AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS x FROM every ANTI JOIN gone USING (doc_id, j) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(x, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Bytes as pairs of hexadecimal digits.
BYTES_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS s FROM p),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM k) WHERE f < doc_id),
n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (first) AS runs FROM (SELECT doc_id, j - lag(j, 1, -9) OVER (PARTITION BY doc_id ORDER BY j) > 1 AS first FROM gone) GROUP BY 1),
every AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS j FROM d),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * j + 1, 2), '' ORDER BY j) AS h FROM every ANTI JOIN gone USING (doc_id, j) GROUP BY 1)
SELECT doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: All pairs of different texts that share a shingle, and what can be reached over those that are alike.
NEAR_SQL = r"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS x, min(doc_id) AS id FROM documents GROUP BY 1),
d AS (SELECT id, x, regexp_extract_all(lower(x), '[^\x20\x09-\x0D]+') AS w FROM t),
f AS (SELECT u, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(w)) AS u FROM documents JOIN d ON x = coalesce(text, '')) GROUP BY 1),
p AS (SELECT id, unnest(w) AS u, unnest(range(1, len(w) + 1)) AS i FROM d),
v AS (SELECT id, list(ln(1 + (SELECT count(*) FROM documents) / n) ORDER BY i) AS v FROM p JOIN f USING (u) GROUP BY 1),
r AS (SELECT id, w, v, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d JOIN v USING (id)),
s AS (SELECT id, array_to_string(w[i:i + k - 1], ' ') AS s, k, sum(list_sum(v[i:i + k - 1]) / k) AS weight FROM r GROUP BY ALL),
whole AS (SELECT id, sum(weight) AS weight FROM s GROUP BY 1),
shared AS (SELECT a.id AS a, b.id AS b, sum(least(a.weight, b.weight)) AS m FROM s AS a JOIN s AS b ON a.s = b.s AND a.k = b.k AND a.id < b.id GROUP BY 1, 2),
alike AS (SELECT a, b FROM shared JOIN whole AS x ON x.id = a JOIN whole AS y ON y.id = b WHERE m / (x.weight + y.weight - m) >= 0.8),
links AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
reached(id, other) AS (SELECT id, id FROM t UNION SELECT reached.id, b FROM reached JOIN links ON a = other),
class AS (SELECT id, min(other) AS group_id FROM reached GROUP BY 1),
placed AS (SELECT doc_id, group_id FROM documents JOIN t ON x = coalesce(text, '') JOIN class USING (id))
SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM placed
"""

#: Exact nearest ones; the graphs find all of them on these tables.
NEAREST_SQL = """
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, max(list_inner_product(a.e, b.e)) AS score FROM v AS a JOIN v AS b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def _lloyd_sql() -> str:
    """Plain Lloyd rounds, one after the other; sums of products of whole numbers are exact as doubles."""
    steps = [
        """v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x FROM v ORDER BY c LIMIT 16)",
    ]
    for i in range(4):
        steps.append(f"""d{i} AS (SELECT vec_id, c, v.x, (list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, k.x) + list_inner_product(k.x, k.x))::BIGINT AS d FROM v, c{i} AS k),
a{i} AS (SELECT vec_id, min_by(c, (d, c)) AS c, min(d) AS d, any_value(x) AS x FROM d{i} GROUP BY vec_id)""")
        if i < 3:
            steps.append(f"""m{i} AS (SELECT c, p, floor(sum(u) / count(*)) AS y FROM (SELECT c, unnest(x) AS u, unnest(range(64)) AS p FROM a{i}) GROUP BY c, p),
c{i + 1} AS (SELECT c, coalesce(y, x) AS x FROM c{i} LEFT JOIN (SELECT c, list(y ORDER BY p) AS y FROM m{i} GROUP BY c) USING (c))""")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, a.c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(k.x, lambda y: y::BIGINT), ',')) AS centroid_sha256
FROM a3 AS a JOIN c3 AS k ON k.c = a.c
"""


#: All products of the anchors with all rows.
NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS s FROM v AS a JOIN v AS b ON len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b AS p, s AS t FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT a AS anchor_id, p AS positive_id, (row_number() OVER w)::INT AS rank, b AS negative_id, t AS positive_score, s AS negative_score
FROM p JOIN s USING (a) WHERE NOT same AND 30 * t <= 100 * s AND 100 * s <= 90 * t WINDOW w AS (PARTITION BY a, p ORDER BY s DESC, b) QUALIFY row_number() OVER w <= 10
"""

#: doc_ids are taken as unique here, as they are in the tables.
ORACLE_SQL: dict[str, str] = {"op1_minhash": NEAR_SQL, "op7_substring_dedup": WORDS_SQL, "op8_ann": NEAREST_SQL, "op9_suffix_dedup": BYTES_SQL, "op12_centroids": _lloyd_sql(), "op13_hard_negatives": NEGATIVES_SQL}
