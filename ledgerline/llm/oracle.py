"""The queries of this subpackage that SQL can state, for DuckDB."""

from __future__ import annotations

_SECTION = r"(?:[^\n]+\n){1,7}[^\n]*\n*|[^\n]+|\n+"
_PARAGRAPH = r"[^\n]*\n+|[^\n]+"
_PIECE = r"(?s).{24,96}?[lrt.,;:!?][ \t\n\r\f]|.{1,96}"


def _tree(text: str) -> str:
    """A text's sections with their hashes: lists of paragraphs, lists of pieces."""
    return f"""list_transform(list_transform(regexp_extract_all({text}, '{_SECTION}'), lambda s:
      list_transform(list_transform(regexp_extract_all(s, '{_PARAGRAPH}'), lambda p: list_transform(regexp_extract_all(p, '{_PIECE}'), lambda x: md5(x))),
        lambda l: {{'h': md5(array_to_string(l, '')), 'l': list_transform(l, lambda x: base64(unhex(substr(x, 1, 12))))}})),
      lambda q: {{'h': md5(array_to_string(list_transform(q, lambda p: p.h), '')), 'q': q}})"""


def _written(tree: str) -> str:
    return f"""sha256(array_to_string(list_transform({tree}, lambda s: s.h), '')) || '|' || array_to_string(list_transform({tree}, lambda s:
      base64(unhex(substr(s.h, 1, 12))) || array_to_string(list_transform(s.q, lambda p: ',' || base64(unhex(substr(p.h, 1, 12))) || '.' || array_to_string(p.l, '.')), '')), ';')"""


def _leaves(tree: str) -> str:
    return f"list_distinct(flatten(flatten(list_transform({tree}, lambda s: list_transform(s.q, lambda p: p.l)))))"


OP11 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nx FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST)),
f AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(nx, 1, length(text) // 2) AS ed FROM e),
t AS (SELECT *, {_tree("text")} AS a, {_tree("ed")} AS b, {_tree("nx")} AS c FROM f),
w AS (SELECT *, {_written("a")} AS fa, {_written("b")} AS fb, {_written("c")} AS fc, {_leaves("a")} AS la, {_leaves("b")} AS lb, {_leaves("c")} AS lc FROM t),
x AS (SELECT *, len(list_intersect(la, lb)) AS ib, len(list_intersect(la, lc)) AS ic FROM w)
SELECT doc_id, length(text) AS n_chars, sha256(ed) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
  CASE WHEN text = ed THEN 1.0::DOUBLE ELSE ib / (len(la) + len(lb) - ib)::DOUBLE END AS near_edited, CASE WHEN text = nx THEN 1.0::DOUBLE ELSE ic / (len(la) + len(lc) - ic)::DOUBLE END AS near_next FROM x
"""

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"
_INTS = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE))"

OP12 = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_INTS} AS x FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_WHOLE}),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.x) = len(b.x)),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) AS n FROM s WHERE same QUALIFY n <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.n ORDER BY s.score DESC, s.vec_id, s.r) AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score QUALIFY rank <= 3
"""


def _clusters(rounds: int = 5, k: int = 40, salt: str = "2") -> str:
    distance = "CAST(list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.x) + list_dot_product(c.x, c.x) AS BIGINT)"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {_INTS} AS x FROM embeddings WHERE len(embedding) = 64 AND {_WHOLE})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT v.r, min({distance} * {k} + c.c) AS best FROM v, c{n} c GROUP BY v.r)")
        if n < rounds:
            steps.append(f"s{n} AS (SELECT a.best % {k} AS c, i, CAST(sum(CAST(v.x[i] AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM a{n} a JOIN v USING (r), range(1, 65) t(i) GROUP BY ALL)")
            steps.append(f"m{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS x FROM s{n} GROUP BY c)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (c))")
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT v.vec_id, CAST(a.best % {k} AS INTEGER) AS cluster, a.best // {k} AS distance, CAST(sum(a.best // {k}) OVER (PARTITION BY a.best % {k}) AS BIGINT) AS cluster_inertia, CAST(sum(a.best // {k}) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.c = a.best % {k}
"""
    )


OP13 = _clusters()
