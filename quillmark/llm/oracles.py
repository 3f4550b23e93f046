"""The SQL that the queries are checked with, where SQL can express them."""


def _crc32(text: str) -> str:
    """Unsigned crc32 of a string's UTF-8 bytes, bit by bit: a byte is put in before the first of its eight steps."""
    steps = f"""list_transform(range(4 * len(hex({text}))), lambda k:
        CASE WHEN k % 8 = 0 THEN ('0x' || substr(hex({text}), 2 * (k // 8) + 1, 2))::BIGINT ELSE 0 END)"""
    step = "xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))"
    return f"xor(list_reduce({steps}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295)"


ORACLES = {
    "op11_spelling": f"""
        WITH RECURSIVE found AS (
            SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS raw FROM documents
        ), lowered AS (
            SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
            FROM found WHERE length(raw) >= 6 GROUP BY ALL
        ), summed AS (
            SELECT run, n, {_crc32("(doc_id || ':' || run)")} AS h FROM lowered
        ), typed AS (
            SELECT n, CASE WHEN h % 199 = 0
                THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
            FROM summed
        ), words AS (
            SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
        ), shorter AS (
            SELECT word, spot, substr(word, 1, spot) || substr(word, spot + 2) AS rest
            FROM (SELECT word, unnest(range(length(word)))::INT AS spot FROM words)
        ), pairs AS (
            SELECT a.word, b.word AS near FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.spot = b.spot AND a.word <> b.word
            UNION SELECT s.word, w.word FROM shorter s JOIN words w ON w.word = s.rest
            UNION SELECT w.word, s.word FROM shorter s JOIN words w ON w.word = s.rest
        ), best AS (
            SELECT p.word, near, b.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
                row_number() OVER (PARTITION BY p.word ORDER BY b.n DESC, near) AS place
            FROM pairs p JOIN words b ON b.word = near
        ), forms AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
                CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
            FROM words w LEFT JOIN best b ON b.word = w.word AND place = 1
        ), steps AS (
            SELECT word, word AS root FROM forms
            UNION ALL
            SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL
        ), last AS (
            SELECT s.word, s.root FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NULL
        )
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN last USING (word)
    """,
    "op13_periodic_runs": f"""
        WITH own AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS own,
                {_crc32("doc_id::VARCHAR")} AS h
            FROM documents
        ), dealt AS (
            SELECT doc_id, own, h, len(own) AS n, h // 10 AS g, CASE WHEN len(own) > 0 THEN (h // 10) % len(own) END AS a FROM own
        ), words AS (
            SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
                THEN list_transform(range(n), lambda i: own[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END])
                ELSE own END AS words
            FROM dealt
        ), spots AS (
            SELECT doc_id, i, words[i + 1] AS word, CASE WHEN i + 6 <= n THEN array_to_string(words[i + 1:i + 6], ' ') END AS six
            FROM (SELECT doc_id, n, words, unnest(range(n)) AS i FROM words)
        ), met AS (
            SELECT a.doc_id, a.i, a.i - b.i AS period FROM spots a JOIN spots b ON a.doc_id = b.doc_id AND a.six = b.six AND b.i < a.i
        ), islands AS (
            SELECT doc_id, period, i, i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS island FROM met
        ), diagonals AS (
            SELECT doc_id, period, min(i) - period AS start, max(i) + 6 - min(i) AS matches FROM islands GROUP BY doc_id, period, island
        ), runs AS (
            SELECT doc_id, start, matches + period AS length, min(period) AS period FROM diagonals
            WHERE matches >= greatest(12 - period, period) GROUP BY doc_id, start, matches + period
        ), listed AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS all_runs
            FROM runs GROUP BY doc_id
        ), best AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS place FROM runs
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM spots s
            WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = s.doc_id AND s.i >= r.start + r.period AND s.i < r.start + r.length)
            GROUP BY doc_id
        )
        SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
            sha256(coalesce(all_runs, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
        FROM words w LEFT JOIN listed USING (doc_id) LEFT JOIN best b ON b.doc_id = w.doc_id AND place = 1
            LEFT JOIN kept k ON k.doc_id = w.doc_id
    """,
    "op10_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "op5_binary_search": """
        WITH bits AS (
            SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings
        ), codes AS (
            SELECT vec_id, sum(CASE WHEN x > 0 THEN 1::UBIGINT << i ELSE 0 END)::UBIGINT AS code FROM bits GROUP BY vec_id
        ), pairs AS (
            SELECT q.vec_id, r.vec_id AS neighbour_id, bit_count(xor(q.code, r.code))::INTEGER AS distance
            FROM codes q JOIN codes r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id))::INTEGER AS rank,
                neighbour_id, distance FROM pairs
        )
        SELECT * FROM ranked WHERE rank <= 10
    """,
    "op8_lines": r"""
        WITH split AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), l AS (
            SELECT doc_id, unnest(range(len(lines))) AS line_no, unnest(lines) AS line FROM split
        ), w AS (
            SELECT doc_id, line_no, doc_id * 1000000 + line_no AS place,
                list_filter(regexp_split_to_array(line, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS words
            FROM l
        ), c AS (
            SELECT words, len(words) AS n, min(place) AS place FROM w WHERE len(words) > 0 GROUP BY words
        ), spots AS (
            SELECT words, n, place, unnest(range(1, n + 1)) AS j FROM c WHERE n >= 10
        ), v AS (
            SELECT place, n, j, md5(array_to_string(words[:j - 1] || words[j + 1:], ' ')) AS rest FROM spots
        ), met AS (
            SELECT a.place, b.place AS other FROM v a JOIN v b ON a.rest = b.rest AND a.n = b.n AND a.j = b.j
            UNION ALL
            SELECT v.place, c.place FROM v JOIN c ON v.n = c.n + 1 AND v.rest = md5(array_to_string(c.words, ' '))
            UNION ALL
            SELECT c.place, v.place FROM v JOIN c ON v.n = c.n + 1 AND v.rest = md5(array_to_string(c.words, ' '))
        ), near AS (
            SELECT place, min(other) AS first FROM met WHERE other < place GROUP BY place
        ), known AS (
            SELECT words, coalesce(near.first, c.place) AS first, CASE WHEN near.first IS NULL THEN 0 ELSE 1 END AS distance
            FROM c LEFT JOIN near USING (place)
        ), done AS (
            SELECT doc_id, line_no, place, coalesce(first, place) AS first, distance FROM w LEFT JOIN known USING (words)
        )
        SELECT doc_id, line_no, place = first AS kept,
            CASE WHEN place <> first THEN first // 1000000 END AS first_doc_id,
            CASE WHEN place <> first THEN (first % 1000000)::INTEGER END AS first_line_no,
            CASE WHEN place <> first THEN distance END AS distance
        FROM done
    """,
}
