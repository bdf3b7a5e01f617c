"""The results of the queries that SQL can express, for DuckDB."""

_TEXTS = "SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL"
_TERMS = f"""
    WITH t AS ({_TEXTS}),
    w AS (SELECT chunk_id, text, unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) AS term FROM t),
    c AS (SELECT term, count(*)::BIGINT AS occurrences, count(DISTINCT (chunk_id, text))::BIGINT AS records FROM w GROUP BY term),
    m AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.5 * (SELECT count(*) FROM t) THEN 'common' END AS mark FROM c)"""

_LINES = """
    WITH r AS (SELECT DISTINCT chunk_id, text, nullif(regexp_replace(trim(cik), '^0+', ''), '') AS cik, nullif(upper(trim(ticker)), '') AS ticker FROM chunks WHERE text IS NOT NULL),
    known AS (SELECT ticker, min(cik) AS k FROM r WHERE cik IS NOT NULL AND ticker IS NOT NULL GROUP BY ticker),
    s AS (SELECT r.*, coalesce(r.cik, known.k, r.ticker) AS company FROM r LEFT JOIN known USING (ticker)),
    p AS (SELECT chunk_id, text, company, string_split(text, chr(10)) AS ls FROM s WHERE company IS NOT NULL),
    l AS (SELECT chunk_id, text, company, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM p),
    n AS (SELECT *, lower(trim(regexp_replace(line, '[ \\t]+', ' ', 'g'))) AS same FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
    f AS (SELECT company, same FROM n GROUP BY ALL HAVING count(DISTINCT chunk_id) >= 10)"""

_PAIRS = """
    WITH t AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL),
    w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM t),
    s AS (SELECT chunk_id, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS runs FROM w WHERE len(ws) >= 60),
    e AS (SELECT chunk_id, len(runs) AS n, unnest(runs) AS run FROM s),
    d AS (SELECT *, count(*) OVER (PARTITION BY run) AS often FROM e),
    -- two sets of which 0.7 is common share one of their rarest three tenths
    r AS (SELECT chunk_id, run FROM d QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY often, run) <= ceil(0.3 * n) + 1),
    c AS (SELECT DISTINCT a.chunk_id AS a, b.chunk_id AS b FROM r a JOIN r b ON a.run = b.run AND a.chunk_id < b.chunk_id),
    j AS (SELECT c.a, c.b, len(x.runs) AS na, len(y.runs) AS nb, len(list_intersect(x.runs, y.runs)) AS both_have FROM c JOIN s x ON x.chunk_id = c.a JOIN s y ON y.chunk_id = c.b)"""

_HIDDEN = r"[\x{00AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}\x{0300}-\x{036F}\x{FB00}-\x{FB06}\x{FF01}-\x{FF5E}]"
_MIXED = r"\p{Latin}[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}]\p{Latin}|(^|[^\p{Cyrillic}\p{Greek}])[асеорухѕіјАВЕКМНОРСТХЅІЈΑΒΕΖΗΙΚΜΝΟΡΤΥΧο]+([^\p{Cyrillic}\p{Greek}]|$)"

_WORD = r"[^ \t\n\r\f\v\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

ORACLE = {
    "p1_found": _TERMS + " SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p1_terms": _TERMS + " SELECT term, occurrences, records, mark FROM m",
    "p2_found": "SELECT DISTINCT chunk_id FROM chunks WHERE len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+')) > 400",
    "p4_found": f"""
        WITH v AS (SELECT 'chunks' AS table_name, chunk_id AS row_key, 'text' AS field_name, text AS v FROM chunks
            UNION SELECT 'eval_set', qa_id, 'question', question FROM eval_set UNION SELECT 'eval_set', qa_id, 'answer', answer FROM eval_set)
        SELECT DISTINCT table_name, row_key, field_name FROM v WHERE regexp_matches(v, '{_HIDDEN}') OR regexp_matches(v, '{_MIXED}')""",
    "p5_found": _PAIRS + " SELECT a AS chunk_id_a, b AS chunk_id_b FROM j WHERE both_have >= 0.7 * (na + nb - both_have)",
    "p6_found": _LINES + " SELECT DISTINCT n.chunk_id, n.line_no::BIGINT AS line_no FROM n JOIN f USING (company, same)",
    "p2_cover": f"WITH t AS ({_TEXTS}), w AS (SELECT chunk_id, len(regexp_extract_all(text, '{_WORD}+')) AS n FROM t) SELECT chunk_id, n::INT AS words, n::BIGINT AS covered, true AS kept FROM w WHERE n > 400",
    "p5_membership": _PAIRS.replace("WITH", "WITH RECURSIVE", 1) + """,
        k AS (SELECT a, b FROM j WHERE both_have >= 0.7 * (na + nb - both_have)), edge AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
        g AS (SELECT chunk_id, chunk_id AS r FROM s UNION SELECT edge.b, g.r FROM g JOIN edge ON edge.a = g.chunk_id)
        SELECT chunk_id, min(r) AS group_id FROM g GROUP BY chunk_id""",
    "p6_clean": _LINES + """,
        o AS (SELECT DISTINCT n.chunk_id, n.text, n.line_no FROM n JOIN f USING (company, same)), d AS (SELECT chunk_id, text, list(line_no) AS gone FROM o GROUP BY ALL), a AS (SELECT DISTINCT chunk_id, text FROM chunks)
        SELECT a.chunk_id AS item_id, coalesce(len(gone), 0)::INT AS removed_lines, CASE WHEN gone IS NULL THEN a.text ELSE array_to_string(list_filter(string_split(a.text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS clean_text FROM a LEFT JOIN d ON d.chunk_id = a.chunk_id AND d.text = a.text""",
}
