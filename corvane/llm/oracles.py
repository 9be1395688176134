"""DuckDB SQL with the rows of the queries that SQL can express."""

#: Scores of every document for every item, without an index.
SEARCH = r"""
WITH words AS (
    SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), counted AS (
    SELECT doc, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM words WHERE len(terms) > 0
), whole AS (
    SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM counted
), asked AS (
    SELECT item_id, term, count(*) AS times
    FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
    GROUP BY item_id, text, term
), postings AS (
    SELECT doc, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc, unnest(terms) AS term FROM counted) GROUP BY doc, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), whole
), scored AS (
    SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN counted USING (doc), whole
    GROUP BY item_id, doc, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""

#: Levels of nodes by recursion; CRC-32 bit by bit; roots folded a level at a time.
MERKLE = r"""
WITH RECURSIVE rows AS (
    SELECT row_number() OVER () AS id, doc_id, source,
        CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id) END || coalesce(concat(strlen(source), ':' || source), '-') || coalesce(concat(strlen(lang), ':' || lang), '-')
        || CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars) END AS head,
        text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
        list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
            lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
    FROM documents
), leaves AS (
    SELECT id, doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END) AS leaf,
        CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', low) END) END AS changed
    FROM rows
), placed AS (
    SELECT id, doc_id, leaf, changed, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS i
    FROM leaves
), below AS (
    SELECT 0 AS level, g, i, leaf AS hash, CAST(NULL AS VARCHAR) AS preimage, count(*) OVER (PARTITION BY g) AS n FROM placed
    UNION ALL
    SELECT level + 1, g, i // 16, sha256(string_agg(hash, '' ORDER BY i)), string_agg(hash, '' ORDER BY i), CAST(ceil(n / 16) AS BIGINT) FROM below WHERE n > 1 GROUP BY level, g, i // 16, n
), subroots AS (
    SELECT g, level AS height, hash AS subroot FROM below WHERE n = 1
), above AS (
    SELECT 0 AS level, g AS i, subroot AS hash, CAST(NULL AS VARCHAR) AS preimage, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT level + 1, i // 16, sha256(string_agg(hash, '' ORDER BY i)), string_agg(hash, '' ORDER BY i), CAST(ceil(n / 16) AS BIGINT) FROM above WHERE n > 1 GROUP BY level, i // 16, n
), steps AS (
    SELECT p.id, b.level, CAST((p.i // CAST(pow(16, b.level - 1) AS BIGINT)) % 16 AS BIGINT) AS slot, b.preimage
    FROM placed p JOIN below b ON b.g = p.g AND b.level > 0 AND b.i = p.i // CAST(pow(16, b.level) AS BIGINT)
    UNION ALL
    SELECT p.id, s.height + a.level, CAST((p.g // CAST(pow(16, a.level - 1) AS BIGINT)) % 16 AS BIGINT), a.preimage
    FROM placed p JOIN subroots s USING (g) JOIN above a ON a.level > 0 AND a.i = p.g // CAST(pow(16, a.level) AS BIGINT)
), sides AS (
    SELECT id, level, preimage[:64 * slot] AS before, preimage[64 * slot + 65:] AS after FROM steps
), proofs AS (
    SELECT id, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM sides GROUP BY id
), fold AS (
    SELECT id, 0 AS level, coalesce(changed, leaf) AS hash FROM placed
    UNION ALL
    SELECT f.id, f.level + 1, sha256(s.before || f.hash || s.after) FROM fold f JOIN sides s ON s.id = f.id AND s.level = f.level + 1
), ends AS (
    SELECT id, arg_max(hash, level) AS folded_root FROM fold GROUP BY id
)
SELECT p.doc_id, p.leaf, s.subroot, r.hash AS root, coalesce(q.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.hash AS verified
FROM placed p JOIN subroots s USING (g) JOIN ends e USING (id) LEFT JOIN proofs q USING (id), (SELECT hash FROM above WHERE n = 1) r
"""
