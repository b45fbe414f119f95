"""SQL of the queries that SQL can express."""

OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

_GROUPS = ", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {5 * (3 - c)}) & 31)::INT + 1, 1)" for g in range(8) for c in range(4))
OP4 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS least FROM p)
SELECT page_id, payload_bytes, concat({_GROUPS}) AS payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to, true AS verified FROM d
"""

OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS shingle FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.reached)
SELECT n.doc_id, n.n AS n_shingles, c.component_id FROM n JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""


def op9() -> str:
    """The licence scan: templates as values, lines and paragraphs with their places, bigrams by list functions."""
    from nestframe.llm.licenses import TEMPLATES

    values = ", ".join("('{}', '{}')".format(name, body.replace("'", "''")) for name, body in TEMPLATES)
    words = r"list_transform(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), lambda w: CASE WHEN starts_with(w, 'licence') THEN 'license' || w[8:] ELSE w END)"
    space = r"[\s\x0B\p{Z}]"
    return rf"""
WITH t AS (SELECT license, {words.format("body")} AS w FROM (VALUES {values}) v(license, body)),
tb AS (SELECT license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM t),
l0 AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT doc_id, text, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM l0),
l2 AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM l1),
l3 AS (SELECT *, length(regexp_extract(line, '^{space}*')) AS lead, length(regexp_replace(regexp_replace(line, '^{space}+', ''), '{space}+$', '')) AS size FROM l2),
l4 AS (SELECT doc_id, text, i, size, pos + lead AS a, pos + lead + size AS z, sum((size = 0)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM l3),
units AS (SELECT doc_id, text, a, z FROM l4 WHERE size > 0 UNION SELECT doc_id, text, min(a), max(z) FROM l4 WHERE size > 0 GROUP BY doc_id, text, island),
w AS (SELECT doc_id, a, z, {words.format("substr(text, a + 1, z - a)")} AS w FROM units),
b AS (SELECT doc_id, a, z, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w),
m AS (SELECT doc_id, a, z, license, 2.0::DOUBLE * len(list_intersect(b.b, tb.b)) / (len(b.b) + len(tb.b)) AS dice FROM b JOIN tb ON len(b.b) BETWEEN len(tb.b) * 0.8 AND len(tb.b) * 1.25),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, a, z ORDER BY dice DESC, license) AS place FROM m WHERE dice >= 0.9)
SELECT doc_id, a::BIGINT AS "start", z::BIGINT AS "end", license, dice FROM r WHERE place = 1
"""
