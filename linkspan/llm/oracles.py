"""DuckDB SQL for the operators that it can express."""

from linkspan.llm import quality, variants

_WORD = r"[^\x20\x09-\x0D]+"
#: What str.split() leaves whole.
_SOLID = r"[^\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

ORACLES = {
    "op6_quality": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents
        ), words AS (
            SELECT id, unnest(words) AS word, unnest(range(len(words))) AS place FROM d
        ), windows AS (
            SELECT id, place, concat(word, ' ', lead(word) OVER w, ' ', lead(word, 2) OVER w, ' ', lead(word, 3) OVER w, ' ', lead(word, 4) OVER w) AS shown, lead(word, 4) OVER w AS last
            FROM words WINDOW w AS (PARTITION BY id ORDER BY place)
        ), repeated AS (
            SELECT id, place, count(*) OVER (PARTITION BY id, shown) AS n FROM windows WHERE last IS NOT NULL
        ), covered AS (
            SELECT id, count(DISTINCT word) AS n FROM (SELECT id, place + unnest(range(5)) AS word FROM repeated WHERE n > 1) GROUP BY id
        ), lines AS (
            SELECT id, line, count(*) AS n FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY id, line
        ), parts AS (
            SELECT *, regexp_extract_all(line, '{_SOLID}') AS solid, len(regexp_extract_all(line, '{_WORD}')) AS n_words FROM lines
        ), measured AS (
            SELECT *, len(solid) AS n_solid, len(array_to_string(solid, '')) AS chars, len(regexp_replace(line, '[^\p{{L}}\p{{N}}\p{{M}}]', '', 'g')) AS alnum,
                len(array_to_string(regexp_extract_all(line, '{quality._BOILERPLATE.pattern}', 0, 'i'), '')) AS phrases FROM parts
        ), judged AS (
            SELECT *,
                chars - alnum > {quality.PUNCTUATION_SHARE} * chars
                OR (n_solid >= {quality.SHOUT_WORDS} AND regexp_matches(line, '\p{{Lu}}') AND NOT regexp_matches(line, '[\p{{Ll}}\p{{Lt}}]')
                    AND 2 * len(list_filter(solid, lambda w: w LIKE '%!')) >= n_solid)
                OR (n_solid <= {quality.NAVIGATION_WORDS} AND regexp_matches(line, '{quality._NAVIGATION.pattern}'))
                OR (phrases > 0 AND phrases >= {quality.BOILERPLATE_SHARE} * len(line)) AS bad
            FROM measured
        ), kept AS (
            SELECT id, sum(n - 1) AS dup, sum(CASE WHEN bad THEN 0 ELSE n_words END) AS words FROM judged GROUP BY id
        ), counted AS (
            SELECT doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(len(array_to_string(d.words, '')) AS BIGINT) AS word_chars,
                CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(coalesce(kept.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, coalesce(kept.words, 0) AS kept_words
            FROM d LEFT JOIN covered USING (id) LEFT JOIN kept USING (id)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed,
            NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words) AND kept_words >= {quality.KEEP_SHARE} * n_words AS kept
        FROM counted
    """,
    "op9_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    # base 32: every five hexadecimal digits are four letters
    "op10_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p
        )
        SELECT
            page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(1, 41, 5), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr(
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(sha, i, 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest,
            CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
        FROM f
    """,
    # crc32 by a table of 256 remainders; letters up to U+00FF are one or two bytes of UTF-8
    "op12_variants": rf"""
        WITH RECURSIVE t AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
        ), runs AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
        ), lowered AS (
            SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs WHERE length(run) >= {variants.MIN_LENGTH} GROUP BY ALL
        ), bytes AS (
            SELECT run, n, flatten(list_transform(string_split(concat(id, ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b FROM lowered
        ), hashed AS (
            SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, tab[CAST(xor(c & 255, x) + 1 AS BIGINT)])), 4294967295) AS h FROM bytes, t
        ), printed AS (
            SELECT n, CASE WHEN h % {variants.MISPRINT} = 0 THEN concat(substr(run, 1, CAST(h % length(run) AS BIGINT)), substr(run, CAST(h % length(run) + 2 AS BIGINT))) ELSE run END AS word FROM hashed
        ), v AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM printed WHERE length(word) >= {variants.MIN_LENGTH} GROUP BY word HAVING sum(n) >= {variants.MIN_COUNT}
        ), cut AS (
            SELECT word, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)
        ), near AS (
            SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT c.word, v.word FROM cut c JOIN v ON c.rest = v.word
            UNION SELECT v.word, c.word FROM cut c JOIN v ON c.rest = v.word
        ), best AS (
            SELECT a AS word, count(*) AS n_near, min({{'less': -v.n, 'word': encode(b)}}) AS near FROM near JOIN v ON v.word = b GROUP BY a
        ), formed AS (
            SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN -near.less >= {variants.FORM_FACTOR} * v.n THEN decode(near.word) END AS form,
                CASE WHEN -near.less >= {variants.FORM_FACTOR} * v.n THEN CAST(-near.less AS BIGINT) END AS form_n FROM v LEFT JOIN best USING (word)
        ), chain AS (
            SELECT word, form, coalesce(form, word) AS root FROM formed UNION SELECT chain.word, chain.form, formed.form FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NOT NULL
        ), last AS (
            SELECT chain.word, chain.root FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NULL
        )
        SELECT word, form, root, n, n_near, form_n FROM formed JOIN last USING (word)
    """,
}
