"""The queries that SQL can express, for DuckDB.

Tokenizers, trained models and hash sketches have no SQL; those queries are tested against brute force.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_NOT_SPACE = r"'[^\x20\x09-\x0D]+'"

_DECONTAMINATE = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
item AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS name, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
pattern AS (
    SELECT DISTINCT name, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS k
    FROM (SELECT name, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
place AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM doc, (SELECT DISTINCT n FROM pattern) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, place.n, name FROM place JOIN pattern USING (n, k)),
word AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
name AS (
    SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT doc_id, name FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN name USING (doc_id)"""

_SUBSTRINGS = f"""
WITH doc AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_NOT_SPACE}) AS w FROM documents),
place AS MATERIALIZED (
    SELECT doc_id, i, hash(array_to_string(w[i:i + 34], ' ')) AS k
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM doc WHERE len(w) >= 35)),
twice AS (SELECT k FROM place GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM place WHERE k IN (SELECT k FROM twice)),
word AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS j FROM doc),
kept AS (
    SELECT doc_id, string_agg(t, ' ' ORDER BY j) AS text, count(*) AS n
    FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)"""

# The control strings and marks of the template in ``chat``.
_CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>"]


def _escaped(column: str) -> str:
    """Length after escaping: a backslash more for each backslash and each begin of a control string."""
    more = [f"(length({column}) - length(replace({column}, '{c}', ''))) / {len(c)}" for c in ["\\", *_CONTROL]]
    return f"length({column}) + " + " + ".join(more)


_CHAT = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
long AS (
    SELECT *, sum(8 + {_escaped("role")} + {_escaped("text")}) OVER (
                  PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS stop,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(stop) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars
FROM long GROUP BY conv_id"""

_NEAR = f"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_NOT_SPACE}) AS w FROM documents),
shingle AS MATERIALIZED (
    SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 1], ' ')) AS k
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM shingle a JOIN shingle b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (
    SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y
    WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS MATERIALIZED (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.least AS component_id, d.doc_id = m.least AS kept
FROM documents d
JOIN (SELECT x, min(y) AS least FROM reach GROUP BY x) m ON m.x = d.doc_id
LEFT JOIN size s ON s.doc_id = d.doc_id"""

_VECTOR = """
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0"""

_TOP_K = f"""
WITH vector AS MATERIALIZED ({_VECTOR}),
pair AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_dot_product(q.v, c.v), 0) AS BIGINT) AS score
    FROM vector q JOIN vector c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS place FROM pair)
WHERE place <= 5"""


def _centroids(k: int = 40, rounds: int = 5) -> str:
    parts = [
        f"vector AS MATERIALIZED (SELECT *, list_dot_product(v, v) AS vv FROM ({_VECTOR}) WHERE len(v) = 64)",
        f"""center0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m, vv AS mm
            FROM (SELECT *, sha256('2:' || vec_id) AS h FROM vector WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))""",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""near{i} AS MATERIALIZED (
            SELECT r, arg_min(c, (vv - 2 * list_dot_product(v, m) + mm, c)) AS c,
                   min(vv - 2 * list_dot_product(v, m) + mm) AS far
            FROM vector, center{i} GROUP BY r)"""
        )
        if i == rounds:
            break
        parts.append(
            f"""center{i + 1} AS MATERIALIZED (
            SELECT c, m, list_dot_product(m, m) AS mm FROM (
                SELECT c.c, coalesce(s.m, c.m) AS m FROM center{i} c LEFT JOIN (
                    SELECT c, list(floor(total / n) ORDER BY j) AS m FROM (
                        SELECT c, j, sum(v[j]) AS total, count(*) AS n
                        FROM near{i} JOIN vector USING (r), (SELECT unnest(range(1, 65)) AS j) GROUP BY c, j)
                    GROUP BY c) s ON s.c = c.c))"""
        )
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(far AS BIGINT) AS distance,
       CAST(sum(far) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(far) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(m, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM near{rounds} JOIN vector USING (r) JOIN center{rounds} USING (c)"""
    )


# CRC-32 of a decimal number, bit by bit: each byte is mixed in, then eight bits are shifted out.
_CRC32 = """xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
    flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                           lambda s: [CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"""

_TRIE = f"""
WITH said AS MATERIALIZED (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
           coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
talk AS MATERIALIZED (
    SELECT conv_id AS c, conv_id - conv_id % 20 AS base, {_CRC32} % 4 AS h FROM (SELECT DISTINCT conv_id FROM said)),
built AS (
    SELECT c, place, role, text FROM talk JOIN said ON conv_id = base AND place <= h
    UNION ALL SELECT c, place, role, text FROM talk JOIN said ON conv_id = c AND place > h),
prefix AS MATERIALIZED (
    SELECT c, CAST(0 AS BIGINT) AS d, '' AS k, CAST(0 AS BIGINT) AS words FROM talk
    UNION ALL
    SELECT c, row_number() OVER w,
           md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w),
           len(regexp_extract_all(text, {_NOT_SPACE}))
    FROM built WINDOW w AS (PARTITION BY c ORDER BY place ROWS UNBOUNDED PRECEDING)),
node AS MATERIALIZED (SELECT k, d, min(c) AS conv_id, count(*) AS n, any_value(words) AS words FROM prefix GROUP BY k, d),
link AS MATERIALIZED (
    SELECT DISTINCT p.k AS parent, q.k AS child FROM prefix p JOIN prefix q ON q.c = p.c AND q.d = p.d + 1),
below AS MATERIALIZED (SELECT DISTINCT p.k AS top, q.k AS k FROM prefix p JOIN prefix q ON q.c = p.c AND q.d >= p.d),
child AS (SELECT parent AS k, count(*) AS n_children FROM link GROUP BY parent),
tree AS (
    SELECT top AS k, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n - 1) * words) AS saved_tokens
    FROM below JOIN node USING (k) LEFT JOIN child USING (k) GROUP BY top),
ending AS (
    SELECT k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids
    FROM (SELECT c, arg_max(k, d) AS k FROM prefix GROUP BY c) GROUP BY k)
SELECT node.conv_id, node.d AS depth, p.conv_id AS parent_conv_id, node.n AS n_convs,
       coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN tree USING (k) LEFT JOIN child USING (k) LEFT JOIN ending USING (k)
LEFT JOIN link ON link.child = node.k LEFT JOIN node p ON p.k = link.parent"""

ORACLE: dict[str, str] = {
    "op1_decontaminate": _DECONTAMINATE,
    "op2_substring_dedup": _SUBSTRINGS,
    "op5_chat_format": _CHAT,
    "op9_near_dedup": _NEAR,
    "op11_top_k": _TOP_K,
    "op12_centroids": _centroids(),
    "op13_prefix_trie": _TRIE,
}
