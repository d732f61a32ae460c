"""DuckDB SQL of operators whose results don't depend on how they are reached."""

from __future__ import annotations


def repeats_sql(length: int = 100) -> str:
    """``suffixes.digests`` over ``documents``, for distinct keys that aren't null; bytes are pairs of hex digits."""
    return f"""
        WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        listed AS (SELECT doc_id, range(len(x) // 2 - {length - 1}) AS s, list_transform(range(len(x) // 2 - {length - 1}), lambda s: substring(x, 2 * s + 1, {2 * length})) AS string FROM texts),
        starts AS (SELECT doc_id, unnest(s) AS s, unnest(string) AS string FROM listed),
        ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY string ORDER BY doc_id, s) AS turn FROM starts),
        again AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= {length} THEN 0 ELSE 1 END AS new FROM ranked WHERE turn > 1),
        numbered AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS span FROM again),
        spans AS (SELECT doc_id, min(s) AS a, max(s) + {length} AS b FROM numbered GROUP BY doc_id, span),
        cuts AS (
            SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM spans
            UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
        kept AS (
            SELECT doc_id, string_agg(substring(x, 2 * a + 1, 2 * (coalesce(b, len(x) // 2) - a)), '' ORDER BY a) AS x
            FROM cuts JOIN texts USING (doc_id) GROUP BY doc_id),
        removed AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM spans GROUP BY doc_id)
        SELECT doc_id, CAST(len(t.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
            CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.x, t.x))) AS kept_sha256
        FROM texts AS t LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
    """


def near_sql(words: int = 5) -> str:
    """``near.near_classes`` at similarity 0.8 over ``documents``, for distinct keys that aren't null."""
    return f"""
        WITH RECURSIVE split AS (
            SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') AS w FROM documents),
        shingled AS (
            SELECT doc_id, list_sort(list_distinct(list_transform(
                range(greatest(len(w) - {words - 1}, least(len(w), 1))), lambda i: array_to_string(w[i + 1 : i + {words}], ' ')))) AS s
            FROM split),
        classed AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS rep, count(*) OVER (PARTITION BY s) AS copies FROM shingled WHERE len(s) > 0),
        sets AS (SELECT doc_id, s FROM classed WHERE doc_id = rep),
        items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
        shared AS (
            SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS n
            FROM items AS a JOIN items AS b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY ALL),
        linked AS (SELECT u, v FROM shared WHERE 5 * n >= 4 * (nu + nv - n)),
        edges AS (SELECT u, v FROM linked UNION ALL SELECT v, u FROM linked),
        reached AS (SELECT DISTINCT u AS a, u AS b FROM edges UNION SELECT r.a, e.v FROM reached AS r JOIN edges AS e ON e.u = r.b),
        roots AS (SELECT a AS rep, min(b) AS root FROM reached GROUP BY a),
        counted AS (SELECT u AS rep, count(*) AS links FROM edges GROUP BY u)
        SELECT doc_id, coalesce(root, rep, doc_id) AS class_id, coalesce(rep, doc_id) AS rep_id,
            CAST(coalesce(copies, 1) AS BIGINT) AS n_copies, CAST(coalesce(links, 0) AS BIGINT) AS n_links
        FROM shingled LEFT JOIN classed USING (doc_id) LEFT JOIN roots USING (rep) LEFT JOIN counted USING (rep)
    """
