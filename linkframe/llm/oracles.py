"""SQL for DuckDB that gives the rows of the queries SQL can express."""

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WARC = """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    s AS (SELECT payload_digest, max(page_id) AS latest FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN latest <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN latest <> page_id THEN latest END AS refers_to
    FROM p LEFT JOIN s USING (payload_digest)"""

MERKLE = f"""
    WITH RECURSIVE d AS (
        SELECT row_number() OVER () AS i, *, CASE WHEN doc_id IS NOT NULL THEN xor(4294967295, list_reduce(
            list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
            lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 3 END AS turn
        FROM documents),
    cells AS (
        SELECT i, doc_id, lang, turn,
            concat(coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
                coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-')) AS head,
            coalesce(octet_length(encode(text)) || ':' || text, '-') AS body, coalesce(octet_length(encode(text)) || ':' || translate(text, '{UP}', '{LOW}'), '-') AS lowered
        FROM d),
    leaves AS (SELECT i, doc_id, lang, sha256(head || body) AS leaf, sha256(head || CASE WHEN turn = 0 THEN lowered ELSE body END) AS seen FROM cells),
    placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
    nodes(lang, level, pos, h, n) AS (
        SELECT lang, 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM placed
        UNION ALL
        SELECT lang, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 8, n),
    subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
    tops(level, pos, h, n) AS (
        SELECT 0, pos, h, n FROM subroots
        UNION ALL
        SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, pos // 8, n),
    steps AS (
        SELECT p.i, o.level AS step, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < o.pos), '') AS l, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > o.pos), '') AS r
        FROM placed p JOIN nodes o ON o.lang IS NOT DISTINCT FROM p.lang AND o.n > 1 AND o.pos = p.pos // CAST(8 ** o.level AS BIGINT)
        JOIN nodes s ON s.lang IS NOT DISTINCT FROM o.lang AND s.level = o.level AND s.pos // 8 = o.pos // 8 GROUP BY p.i, o.level
        UNION ALL
        SELECT p.i, 100 + o.level, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < o.pos), ''), coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > o.pos), '')
        FROM placed p JOIN subroots b ON b.lang IS NOT DISTINCT FROM p.lang JOIN tops o ON o.n > 1 AND o.pos = b.pos // CAST(8 ** o.level AS BIGINT)
        JOIN tops s ON s.level = o.level AND s.pos // 8 = o.pos // 8 GROUP BY p.i, o.level),
    paths AS (SELECT i, list(l || '|' || r ORDER BY step) AS path, string_agg(l || r, '' ORDER BY step) AS siblings FROM steps GROUP BY i),
    done AS (
        SELECT p.doc_id, p.leaf, b.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
            list_reduce(list_prepend(p.seen, coalesce(path, [])), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
        FROM placed p JOIN subroots b ON b.lang IS NOT DISTINCT FROM p.lang LEFT JOIN paths USING (i))
    SELECT *, folded_root = root AS verified FROM done"""

PHRASES = f"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    runs AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
    grams AS (
        SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM runs, range(1, 5) AS s(k) WHERE len(w) >= k),
    f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
    cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND n >= 30),
    halves AS (SELECT lang, phrase, n AS a, k, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM cand, range(1, 4) AS s(j) WHERE j < k),
    cuts AS (
        SELECT h.lang, h.phrase, a, j, p.n AS l, q.n AS r, CAST(CAST(2000000 AS HUGEINT) * a // (p.n + q.n) AS BIGINT) AS score
        FROM halves h JOIN f p ON p.lang = h.lang AND p.phrase = h.x JOIN f q ON q.lang = h.lang AND q.phrase = h.y),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    inner_ones AS (
        SELECT c.lang, unnest(list_transform(range(1, c.k - m + 2), lambda i: array_to_string(c.w[i:i + m - 1], ' '))) AS phrase, c.n FROM cand c, range(2, 4) AS s(m) WHERE m < c.k),
    around AS (SELECT lang, phrase, max(n) AS n FROM inner_ones GROUP BY ALL),
    kept AS (SELECT b.* FROM best b LEFT JOIN around o USING (lang, phrase) WHERE o.n IS NULL OR 100 * o.n < 80 * b.a),
    totals AS (SELECT lang, sum(len(w)) AS n FROM runs GROUP BY lang)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(t.n AS BIGINT) AS n, score
    FROM kept JOIN totals t USING (lang) QUALIFY rank <= 2000"""

CASCADE = """
    WITH t AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text FROM documents),
    base AS (
        SELECT i, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM t),
    lines AS (SELECT i, unnest(string_split(text, chr(10))) AS line FROM t),
    per_line AS (
        SELECT i, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (regexp_matches(line, '^[\\x20\\x09-\\x0D]*[-*•]')) AS bullets,
            count(*) FILTER (regexp_matches(line, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')) AS ellipses
        FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY i),
    spread AS (SELECT i, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM base),
    runs AS (SELECT i, p, word, lead(word) OVER d AS w2, lead(word, 2) OVER d AS w3 FROM spread WINDOW d AS (PARTITION BY i ORDER BY p)),
    twice AS (SELECT i, p FROM runs WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY i, word, w2, w3) > 1),
    covered AS (SELECT i, count(DISTINCT p + j) AS n_repeat_words FROM twice, range(3) AS s(j) GROUP BY i),
    top_word AS (SELECT i, max(n) AS top_word FROM (SELECT i, count(*) AS n FROM runs GROUP BY i, word) GROUP BY i),
    top_pair AS (SELECT i, max(n) AS top_pair FROM (SELECT i, count(*) AS n FROM runs WHERE w2 IS NOT NULL GROUP BY i, word, w2) GROUP BY i),
    counts AS (
        SELECT b.i, doc_id, text, w, len(w) AS n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_lines, bullets, ellipses, top_word, top_pair
        FROM base b LEFT JOIN per_line USING (i) LEFT JOIN covered USING (i) LEFT JOIN top_word USING (i) LEFT JOIN top_pair USING (i)),
    judged AS (
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
            2 * word_chars < 5 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
            OR length(regexp_replace(text, '[^A-Z]', '', 'g')) > length(regexp_replace(text, '[^a-z]', '', 'g')) OR 10 * length(regexp_replace(text, '[^0-9]', '', 'g')) > 3 * word_chars
            OR 4 * length(regexp_replace(text, '[^!]', '', 'g')) > n_words OR 5 * len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z\\x{80}-\\x{10FFFF}]'))) > n_words
            OR 100 * len(list_filter(w, lambda x: regexp_matches(x, '[.!?]$'))) < n_words OR 10 * bullets > 9 * n_lines OR 10 * ellipses > 3 * n_lines
            OR 10 * top_word > 3 * n_words OR 20 * top_pair > 2 * n_words AS rejected
        FROM counts)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
        CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM judged"""
