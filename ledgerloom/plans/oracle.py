"""SQL for DuckDB that gives the results of the queries of ``catalogue``."""

from ledgerloom.operators.cleaning import ITEM_TITLES

_W = r"\t-\r\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _strip(c):
    return f"regexp_replace({c}, '^[{_W}]+|[{_W}]+$', '', 'g')"


def _squeeze(c):
    return f"trim(regexp_replace({c}, '[{_W}]+', ' ', 'g'))"


def _words(c):
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '[{_W}]+'), lambda w: w <> '')"


def _missing(c):
    return f"({c} IS NULL OR {_strip(c)} = '')"


def _ticker(c):
    return f"nullif(upper({_strip(c)}), '')"


def _pipes(c):
    return f"list_filter(list_transform(string_split(coalesce({c}, ''), '|'), lambda x: {_strip('x')}), lambda x: x <> '')"


def _filed(c):
    v = _strip(c)
    return rf"(CASE WHEN regexp_full_match({v}, '\d{{4}}-\d{{2}}-\d{{2}}') THEN try_strptime({v}, '%Y-%m-%d') WHEN regexp_full_match({v}, '\d{{2}}/\d{{2}}/\d{{4}}') THEN try_strptime({v}, '%m/%d/%Y') END)::DATE"


_CHUNKS = f"chunk AS (SELECT DISTINCT * REPLACE ({_ticker('ticker')} AS ticker) FROM chunks)"
_TEXTS = f"txt AS (SELECT DISTINCT {_ticker('ticker')} AS ticker, chunk_id, filing_type, text FROM chunks WHERE {_ticker('ticker')} IS NOT NULL AND text IS NOT NULL)"
_QUESTIONS = f"q AS (SELECT DISTINCT * REPLACE ({_ticker('ticker')} AS ticker) FROM eval_set)"
_FIRST = ", ".join(f"{c} ASC NULLS LAST" for c in "ingested_at company ticker cik filing_type filing_date source_url local_raw_path raw_format local_markdown_path human_readable_format human_readable_warning".split())
_FILINGS = f"f AS (SELECT * REPLACE ({_ticker('ticker')} AS ticker), {_filed('filing_date')} AS filed FROM (SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY accession_number ORDER BY {_FIRST}) = 1))"
_LAST = ", ".join(
    f"{c} DESC NULLS LAST"
    for c in (
        "recorded_at schema_version ticker question_id category answerable question ground_truth source_doc_id source_doc_ids source_chunk_ids llm_answer retrieved_chunk_ids retrieved_doc_ids retrieval_scores retrieved_sections retrieved_filing_dates retrieval_k llm_model"
        " retrieval_status retrieval_error generation_status generation_error status"
    ).split()
)
_RESULTS = f"r AS (SELECT * FROM eval_results QUALIFY row_number() OVER (PARTITION BY run_fingerprint, qa_id, retriever ORDER BY {_LAST}) = 1)"
_TOKENS = r"list_filter(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+(?:[.-][\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+)*'), lambda w: w <> '')"
_MULTI = "(trim(coalesce(source_doc_id, '')) = '' OR trim(source_doc_id) LIKE '%\\_MULTI' ESCAPE '\\')"
_GOLD = f"CASE WHEN len({_pipes('source_doc_ids')}) > 0 THEN list_distinct({_pipes('source_doc_ids')}) WHEN {_MULTI} THEN []::VARCHAR[] ELSE [trim(source_doc_id)] END"


def _recall(g, x):
    return f"CASE WHEN ok AND len({g}) > 0 THEN round(len(list_intersect({g}, {x})) / len({g}), 6) END"


def _rank(g, x):
    return f"CASE WHEN ok AND len({g}) > 0 THEN coalesce(round(1.0 / list_min(list_filter(list_transform({g}, lambda v: list_position({x}, v)), lambda p: p > 0)), 6), 0.0) END"


_SCORED = f"""{_RESULTS},
    p AS (SELECT *, retrieval_status = 'ok' AS ok, {_GOLD} AS gold, list_distinct({_pipes('source_chunk_ids')}) AS gold_chunks, {_pipes('retrieved_doc_ids')} AS docs, {_pipes('retrieved_chunk_ids')} AS got,
        {_TOKENS.format('llm_answer')} AS a, {_TOKENS.format('ground_truth')} AS b, generation_status = 'ok' AND NOT {_missing('ground_truth')} AS answered FROM r),
    s AS (SELECT run_fingerprint, qa_id, retriever, {_ticker('ticker')} AS ticker, category, answerable, status,
        ok::INT::DOUBLE AS retrieval_success, (generation_status = 'ok')::INT::DOUBLE AS generation_success,
        {_recall('gold', 'docs')} AS document_recall_at_k, {_rank('gold', 'docs')} AS document_reciprocal_rank,
        {_recall('gold_chunks', 'got')} AS chunk_recall_at_k, {_rank('gold_chunks', 'got')} AS chunk_reciprocal_rank, NULL::DOUBLE AS cosine_sim,
        CASE WHEN answered THEN CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda y: y = w)), len(list_filter(b, lambda y: y = w))))) / (len(a) + len(b)), 4) END END AS word_overlap_f1,
        NULL::DOUBLE AS llm_score FROM p)"""
_METRICS = "retrieval_success generation_success document_recall_at_k document_reciprocal_rank chunk_recall_at_k chunk_reciprocal_rank cosine_sim word_overlap_f1 llm_score".split()
_LONG = f"{_SCORED}, l AS (" + " UNION ALL ".join(f"SELECT run_fingerprint, qa_id, retriever, category, '{m}' AS metric, {m} AS value FROM s" for m in _METRICS) + ")"
_DELTA = f"""{_LONG}, w AS (SELECT run_fingerprint, qa_id, category, metric, avg(value) FILTER (retriever = 'faiss') AS x, avg(value) FILTER (retriever = 'bm25') AS y FROM l GROUP BY ALL),
    dl AS (SELECT run_fingerprint, qa_id, category, metric, round(x - y, 6) AS delta, run_fingerprint || '/' || qa_id AS question FROM w WHERE x IS NOT NULL AND y IS NOT NULL)"""
_BM25 = f"""{_TEXTS}, {_QUESTIONS},
    tok AS (SELECT ticker, chunk_id, {_words('lower(text)')} AS w FROM txt),
    rec AS (SELECT ticker, chunk_id, len(w) AS dl, row_number() OVER (PARTITION BY ticker ORDER BY chunk_id) AS pos FROM tok),
    post AS (SELECT ticker, chunk_id, term, count(*) AS tf FROM (SELECT ticker, chunk_id, unnest(w) AS term FROM tok) GROUP BY ALL),
    tot AS (SELECT ticker, count(*) AS n, avg(dl) AS avgdl FROM rec GROUP BY ticker),
    raw AS (SELECT ticker, term, count(*) AS df, n, avgdl, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post JOIN tot USING (ticker) GROUP BY ticker, term, n, avgdl),
    fl AS (SELECT ticker, 0.25 * avg(raw) AS floor FROM raw GROUP BY ticker),
    term AS (SELECT ticker, term, df, n, avgdl, CASE WHEN raw < 0 THEN floor ELSE raw END AS idf FROM raw JOIN fl USING (ticker)),
    asked AS (SELECT qa_id, ticker, term, count(*) AS times FROM (SELECT qa_id, ticker, unnest({_words('lower(question)')}) AS term FROM q WHERE ticker IS NOT NULL) GROUP BY ALL),
    hit AS (SELECT qa_id, ticker, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN term USING (ticker, term) JOIN post USING (ticker, term) JOIN rec USING (ticker, chunk_id) GROUP BY ALL)"""
_FORMS = r"""fm AS (SELECT qa_id, list_transform(list_transform(regexp_extract_all(coalesce(question, ''), '(?i)\b(10[\s\x{00A0}]*[-–—]?[\s\x{00A0}]*[KQ]|8[\s\x{00A0}]*[-–—]?[\s\x{00A0}]*K)\b', 1), lambda x: regexp_replace(upper(x), '[^0-9KQ]+', '-')), lambda x: regexp_replace(x, '^(10|8)([KQ])$', '\1-\2')) AS found, coalesce(regexp_matches(question, '(?i)\b(?:compar(?:e|ed|ing|ison)|versus|vs\.?|relative\s+to)(?:\W|$)'), false) AS compares FROM q WHERE ticker IS NOT NULL),
    fo AS (SELECT qa_id, compares, list_filter(found, lambda x, i: list_position(found, x) = i) AS forms FROM fm)"""
_COSINE = "{} AS (SELECT a.vec_id AS query, b.vec_id AS key, b.label, a.label AS own, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0)"


def _stats(v, by=""):
    z = lambda e: f"coalesce(round({e}, 2), 0.0)::DOUBLE"
    return f"{by}count({v})::BIGINT AS n, {z(f'min({v})')} AS min, {z(f'quantile_cont({v}, 0.25)')} AS p25, {z(f'quantile_cont({v}, 0.5)')} AS median, {z(f'avg({v}) + 1e-9')} AS mean, {z(f'quantile_cont({v}, 0.75)')} AS p75, {z(f'max({v})')} AS max"


def _counts(table, rules):
    return " UNION ALL ".join(f"SELECT '{k}' AS metric, count(*) FILTER ({c})::BIGINT AS count FROM {table}" for k, c in rules.items())


def _gaps(table, name, fields, absent=()):
    def one(f, c):
        return f"SELECT '{name}' AS dataset, '{f}' AS field, count(*)::BIGINT AS rows, count(*) FILTER ({c})::BIGINT AS missing, CASE WHEN count(*) > 0 THEN round(100.0::DOUBLE * count(*) FILTER ({c}) / count(*), 2) ELSE 0.0 END AS missing_pct FROM {table}"

    return " UNION ALL ".join([one(f, "warnings IS NULL" if f == "warnings" else _missing(f"CAST({f} AS VARCHAR)")) for f in fields] + [one(f, "true") for f in absent])


_PAIRS = [(a, b) for i, a in enumerate(_METRICS[2:6] + ["word_overlap_f1"]) for b in (_METRICS[2:6] + ["word_overlap_f1"])[i + 1 :]]

_EVERY = "every AS (SELECT q.qa_id, txt.chunk_id, txt.filing_type, upper(trim(coalesce(txt.filing_type, ''))) AS form, coalesce(score, 0.0) AS score, forms, compares AND len(forms) > 1 AS need FROM q JOIN txt USING (ticker) JOIN fo ON fo.qa_id = q.qa_id LEFT JOIN hit ON hit.qa_id = q.qa_id AND hit.chunk_id = txt.chunk_id WHERE len(forms) = 0 OR list_contains(forms, upper(trim(txt.filing_type))))"

# the form of item headings, and the titles of items without one
_ITEM = r"(?i)^(item)\s+((?:[0-9]+[a-z]?|[ivx]+)(?:\s*\.\s*[0-9]+[a-z]?)?)(.*)$"
_TITLES = " ".join(f"WHEN '{n}' THEN '{t.replace(chr(39), chr(39) * 2)}'" for n, t in ITEM_TITLES.items())

ORACLE = {
    "chunk_documents": f"""
        WITH t AS (SELECT doc_id, {_words('text')} AS w FROM documents), s AS (SELECT doc_id, w, list_filter(range(0, len(w), 325), lambda s: s = 0 OR s + 75 < len(w)) AS st FROM t),
        e AS (SELECT doc_id, w, unnest(st) AS start, unnest(range(len(st))) AS i FROM s)
        SELECT doc_id, i::INT AS chunk_index, start::INT AS start_word, least(400, len(w) - start)::INT AS word_count, md5(array_to_string(w[start + 1 : start + 400], ' ')) AS text_md5 FROM e""",
    "chunk_profile": f"""WITH {_CHUNKS} SELECT ticker, filing_type, count(chunk_id)::BIGINT AS chunks, count(DISTINCT accession_number)::BIGINT AS filings, sum(word_count)::BIGINT AS total_words, round(avg(word_count) + 1e-9, 2) AS mean_words,
        round(median(word_count), 2)::DOUBLE AS median_words, min(word_count) AS min_words, max(word_count) AS max_words, count(*) FILTER (lower(section_heading) = 'unknown')::BIGINT AS unknown_sections FROM chunk GROUP BY ALL""",
    "chunk_word_stats": f"WITH {_CHUNKS} SELECT {_stats('word_count', 'ticker, ')} FROM chunk GROUP BY ticker",
    "length_stats": f"SELECT 'raw' AS what, {_stats('raw_length')} FROM cleaning_manifest UNION ALL SELECT 'cleaned', {_stats('cleaned_length')} FROM cleaning_manifest",
    "section_profile": f"WITH {_CHUNKS} SELECT section_heading, count(chunk_id)::BIGINT AS chunks, coalesce(array_to_string(list_sort(list(DISTINCT ticker) FILTER (ticker IS NOT NULL)), ', '), '') AS tickers, coalesce(array_to_string(list_sort(list(DISTINCT filing_type) FILTER (filing_type IS NOT NULL)), ', '), '') AS filing_types, round(100.0::DOUBLE * count(chunk_id) / (SELECT count(*) FROM chunk), 2) AS chunk_pct FROM chunk GROUP BY section_heading",
    "missingness": f"WITH {_CHUNKS} {_gaps('chunk', 'chunks', ['company', 'ticker', 'cik', 'filing_date', 'section_heading', 'text', 'word_count'], ['not_a_field'])} UNION ALL {_gaps('filings', 'filings', ['source_url', 'human_readable_warning', 'filing_date'])} UNION ALL {_gaps('cleaning_manifest', 'cleaning_manifest', ['raw_length', 'human_readable_warning', 'warnings'])}",
    "outlier_counters": _counts("chunks", {"empty_chunk_text_rows": _missing("text"), "oversized_chunks": "word_count > 400", "short_chunks_under_100_words": "word_count < 100"}) + " UNION ALL SELECT 'duplicate_chunk_ids', (count(*) - count(DISTINCT chunk_id))::BIGINT FROM chunks UNION ALL " + _counts("cleaning_manifest", {"low_retention_filings_under_15_pct": "cleaned_length / nullif(raw_length, 0) < 0.15", "human_readable_text_fallbacks": "human_readable_format = 'text'"}),
    "coverage": f"WITH {_CHUNKS} SELECT count(*)::BIGINT AS chunks, round(avg(word_count) + 1e-9, 2) AS mean_words, round(100.0::DOUBLE * count(*) FILTER (NOT {_missing('section_heading')} AND lower({_strip('section_heading')}) <> 'unknown') / count(*), 2) AS known_heading_pct FROM chunk",
    "retention": "SELECT accession_number, CASE WHEN raw_length > 0 THEN round(cleaned_length::DOUBLE / raw_length, 4) ELSE 0.0 END AS retained_ratio, coalesce(CASE WHEN raw_length <> 0 THEN round(100.0::DOUBLE * cleaned_length / raw_length, 2) ELSE 0.0 END, 0.0) AS retained_pct FROM cleaning_manifest",
    "filing_counts": f"WITH {_FILINGS} SELECT ticker, filing_type, count(*)::BIGINT AS filings FROM f GROUP BY ALL",
    "filing_counts_map": f"WITH {_FILINGS}, c AS (SELECT ticker, filing_type || '=' || count(*) AS p FROM f GROUP BY ticker, filing_type) SELECT ticker, array_to_string(list_sort(list(p) FILTER (p IS NOT NULL)), ',') AS filing_type_counts FROM c GROUP BY ticker",
    "filing_timeline": f"WITH {_FILINGS} SELECT ticker, min(filed)::VARCHAR AS first_filed, max(filed)::VARCHAR AS last_filed, count(*)::BIGINT AS filings FROM f WHERE filed IS NOT NULL GROUP BY ticker",
    "warning_counts": "SELECT warning, count(*)::BIGINT AS filings FROM (SELECT unnest(warnings) AS warning FROM cleaning_manifest) GROUP BY warning",
    "top_terms": f"WITH {_TEXTS}, c AS (SELECT ticker, term, count(*)::BIGINT AS n FROM (SELECT ticker, unnest({_words('lower(text)')}) AS term FROM txt) GROUP BY ALL) SELECT ticker, term, n FROM c QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY n DESC, term) <= 10",
    "distinct_filings": f"WITH {_FILINGS} SELECT accession_number, ticker, filing_type, filing_date, source_url, human_readable_warning FROM f",
    "latest_filings": f"WITH {_FILINGS} SELECT ticker, filing_type, accession_number, filing_date, row_number() OVER (PARTITION BY ticker, filing_type ORDER BY filed DESC, accession_number DESC)::INT AS rank FROM f WHERE filed <= DATE '2026-07-14' AND filing_type IN ('10-K', '10-Q', '8-K') QUALIFY rank <= 1",
    "filing_policy": f"""WITH {_FILINGS} SELECT ticker, count(DISTINCT accession_number)::BIGINT AS filings, count(*) FILTER (filed IS NULL OR filed > DATE '2026-07-14')::BIGINT AS late,
        count(DISTINCT accession_number) FILTER (filing_type = '10-K') = 1 AND count(DISTINCT accession_number) FILTER (filing_type = '10-Q') = 1 AND count(DISTINCT accession_number) FILTER (filing_type = '8-K') = 1 AND count(DISTINCT accession_number) = 3 AND late = 0 AS policy_met FROM f GROUP BY ticker""",
    "last_written": f"WITH {_RESULTS} SELECT run_fingerprint, qa_id, retriever, status, regexp_replace(regexp_replace(recorded_at::VARCHAR, '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS recorded_at FROM r",
    "resume_worklist": f"""WITH {_QUESTIONS}, {_RESULTS}, run AS (SELECT DISTINCT run_fingerprint, {_ticker('ticker')} AS ticker FROM eval_results), w AS (SELECT run.run_fingerprint, q.qa_id, v.retriever FROM q JOIN run USING (ticker), (VALUES ('bm25'), ('faiss')) v(retriever))
        SELECT run_fingerprint, qa_id, retriever FROM w ANTI JOIN (SELECT * FROM r WHERE status = 'ok') o USING (run_fingerprint, qa_id, retriever)""",
    "union_unique": "SELECT accession_number, count(*)::BIGINT AS rows, count(DISTINCT t)::BIGINT AS tables FROM (SELECT accession_number, 'f' AS t FROM filings UNION ALL SELECT accession_number, 'm' FROM cleaning_manifest) GROUP BY accession_number",
    "manifest_gaps": "SELECT DISTINCT accession_number FROM chunks WHERE accession_number IS NULL OR accession_number NOT IN (SELECT accession_number FROM cleaning_manifest WHERE accession_number IS NOT NULL)",
    "set_operations": f"WITH c AS (SELECT DISTINCT {_ticker('ticker')} AS ticker, filing_type FROM chunks), f AS (SELECT DISTINCT {_ticker('ticker')} AS ticker, filing_type FROM filings) SELECT *, 'both' AS side FROM (SELECT * FROM c INTERSECT SELECT * FROM f) UNION ALL SELECT *, 'chunks' FROM (SELECT * FROM c EXCEPT SELECT * FROM f) UNION ALL SELECT *, 'filings' FROM (SELECT * FROM f EXCEPT SELECT * FROM c)",
    "bm25_topk": f"WITH {_BM25}, a AS (SELECT q.qa_id, rec.chunk_id, coalesce(score, 0.0) AS score FROM q JOIN rec USING (ticker) LEFT JOIN hit ON hit.qa_id = q.qa_id AND hit.chunk_id = rec.chunk_id) SELECT qa_id, chunk_id, score, row_number() OVER (PARTITION BY qa_id ORDER BY score DESC, chunk_id)::INT AS rank FROM a QUALIFY rank <= 5",
    "bm25_term_stats": f"WITH {_BM25} SELECT ticker, term, df::BIGINT AS df, n::BIGINT AS n, round(avgdl, 6) AS avgdl, round(idf, 6) AS idf FROM term",
    "bm25_topk_filtered": f"WITH {_BM25}, {_FORMS}, {_EVERY} SELECT qa_id, chunk_id, filing_type, score, row_number() OVER (PARTITION BY qa_id ORDER BY score DESC, chunk_id)::INT AS rank FROM every QUALIFY rank <= 5",
    "bm25_topk_reserved": f"""WITH {_BM25}, {_FORMS}, {_EVERY}, a AS (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY score DESC, chunk_id) AS rank, row_number() OVER (PARTITION BY qa_id, form ORDER BY score DESC, chunk_id) AS best FROM every),
        c AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY qa_id ORDER BY CASE WHEN need AND best = 1 THEN list_position(forms, form) ELSE 1000000 END, rank) <= 5)
        SELECT qa_id, chunk_id, filing_type, score, row_number() OVER (PARTITION BY qa_id ORDER BY rank)::INT AS place FROM c""",
    "constraint_inference": f"WITH {_QUESTIONS}, {_FORMS} SELECT qa_id, array_to_string(forms, ',') AS forms, compares, compares AND len(forms) > 1 AS require_each FROM fo",
    "dense_topk": f"WITH {_COSINE.format('c')} SELECT query, key, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INT AS rank FROM c QUALIFY rank <= 5",
    "dense_topk_filtered": f"WITH {_COSINE.format('c')} SELECT query, key, score, label, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INT AS rank FROM c WHERE label IN (own % 10, (own + 1) % 10) QUALIFY rank <= 5",
    "dense_topk_reserved": f"""WITH {_COSINE.format('c')}, a AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, key) AS best FROM c WHERE label IN (own % 10, (own + 1) % 10)),
        k AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query ORDER BY CASE WHEN best = 1 THEN CASE WHEN label = own % 10 THEN 1 ELSE 2 END ELSE 1000000 END, rank) <= 5)
        SELECT query, key, label, score, row_number() OVER (PARTITION BY query ORDER BY rank)::INT AS place FROM k""",
    "embedding_norms": "WITH e AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS n FROM embeddings) SELECT vec_id, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS unit_norm, round(n, 6) AS norm FROM e",
    "neighbour_cosine": "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "prompt_context": f"""WITH {_BM25}, a AS (SELECT q.qa_id, rec.chunk_id, coalesce(score, 0.0) AS score FROM q JOIN rec USING (ticker) LEFT JOIN hit ON hit.qa_id = q.qa_id AND hit.chunk_id = rec.chunk_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY score DESC, chunk_id) AS rank FROM a QUALIFY rank <= 2),
        x AS (SELECT qa_id, string_agg('[Chunk ' || rank || '] ' || filing_type || ' (' || filing_date || ') - ' || coalesce(section_heading, 'unknown') || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS c FROM k JOIN (SELECT DISTINCT chunk_id, filing_type, filing_date, section_heading, text FROM chunks) USING (chunk_id) GROUP BY qa_id)
        SELECT qa_id, length(c)::INT AS length, md5(c) AS context_md5 FROM x""",
    "embedding_documents": f"WITH {_CHUNKS} SELECT chunk_id, md5(concat_ws(chr(10), " + ", ".join(f"CASE WHEN NOT {_missing(c)} AND lower({_strip(c)}) <> 'nan' THEN '{label}: ' || {_strip(c)} END" for label, c in (("Company", "company"), ("Ticker", "ticker"), ("Filing type", "filing_type"), ("Filing date", "filing_date"), ("Section", "section_heading"))) + ", 'Content:', text)) AS document_md5 FROM chunk WHERE text IS NOT NULL",
    "completed_answers": f"WITH {_QUESTIONS} SELECT qa_id, md5(answer) AS answer_md5 FROM q WHERE NOT {_missing('answer')}",
    "eval_violations": _counts("eval_set", {"qa_id_missing": _missing("qa_id"), "question_missing": _missing("question"), "source_doc_id_missing": _missing("source_doc_id"), "ticker_missing": _missing("ticker"), "category_out_of_range": "category IS NULL OR category NOT BETWEEN 1 AND 4", "answerable_unreadable": "answerable IS NULL", "answer_missing": _missing("answer")}) + " UNION ALL SELECT 'duplicate_qa_id', (count(*) - count(DISTINCT qa_id))::BIGINT FROM eval_set",
    "chunk_violations": _counts("chunks", {"chunk_id_missing": _missing("chunk_id"), "text_blank": _missing("text"), "ticker_missing": _missing("ticker"), "word_count_out_of_range": "word_count IS NULL OR word_count < 1 OR word_count > 400", "filed_after_cutoff": f"{_filed('filing_date')} > DATE '2026-07-14'", "date_unreadable": f"{_filed('filing_date')} IS NULL"}) + " UNION ALL SELECT 'duplicate_chunk_id', (count(*) - count(DISTINCT chunk_id))::BIGINT FROM chunks",
    "result_violations": _counts("eval_results", {"schema_version_wrong": "schema_version IS DISTINCT FROM 2", "fingerprint_missing": _missing("run_fingerprint"), "retriever_unknown": "retriever IS NULL OR retriever NOT IN ('bm25', 'faiss')", "status_inconsistent": "status IS DISTINCT FROM CASE WHEN retrieval_status = 'ok' AND generation_status = 'ok' THEN 'ok' WHEN retrieval_status = 'ok' AND generation_status = 'error' THEN 'generation_error' WHEN retrieval_status = 'error' AND generation_status = 'not_run' THEN 'retrieval_error' END", "k_below_one": "retrieval_k IS NULL OR retrieval_k < 1", "category_out_of_range": "category IS NULL OR category NOT BETWEEN 1 AND 4", "answerable_missing": "answerable IS NULL"}) + " UNION ALL SELECT 'duplicate_pair', (count(*) - count(DISTINCT (run_fingerprint, qa_id, retriever)))::BIGINT FROM eval_results",
    "gold_referential": f"WITH {_QUESTIONS}, {_FILINGS}, g AS (SELECT DISTINCT qa_id, unnest({_GOLD}) AS doc_id FROM q), a AS (SELECT DISTINCT concat_ws('_', ticker, {_strip('filing_type')}, {_strip('filing_date')}) AS doc_id FROM f) SELECT qa_id, doc_id FROM g ANTI JOIN a USING (doc_id)",
    "coverage_matrix": f"WITH {_QUESTIONS} SELECT ticker, question_id, max(CASE WHEN source_doc_id LIKE '%\\_MULTI' ESCAPE '\\' THEN 2 WHEN NOT {_missing('answer')} THEN 1 ELSE 0 END)::INT AS state FROM q GROUP BY ALL",
    "retrieval_metrics": f"WITH {_SCORED} SELECT run_fingerprint, qa_id, retriever, document_recall_at_k, document_reciprocal_rank, chunk_recall_at_k, chunk_reciprocal_rank FROM s",
    "token_f1": f"WITH {_SCORED} SELECT run_fingerprint, qa_id, retriever, word_overlap_f1 FROM s",
    "status_derivation": f"WITH {_RESULTS} SELECT retrieval_status, generation_status, status, CASE WHEN retrieval_status = 'ok' AND generation_status = 'ok' THEN 'ok' WHEN retrieval_status = 'ok' AND generation_status = 'error' THEN 'generation_error' WHEN retrieval_status = 'error' AND generation_status = 'not_run' THEN 'retrieval_error' END AS derived, count(*)::BIGINT AS n FROM r GROUP BY ALL",
    "metric_means": f"WITH {_SCORED}, c AS (SELECT *, CASE category WHEN 1 THEN 'Business' WHEN 2 THEN 'Financial / operations' WHEN 3 THEN 'Risk' WHEN 4 THEN 'Recent developments' END AS category_label FROM s) " + " UNION ALL ".join(f"SELECT '{name}' AS \"grouping\", retriever, {'ticker' if 'ticker' in name else 'NULL::VARCHAR'} AS ticker, {'category_label' if 'category' in name else 'NULL::VARCHAR'} AS category_label, {'answerable' if 'answerable' in name else 'NULL::BOOLEAN'} AS answerable, count(*)::BIGINT AS n, {', '.join(f'round(avg({m}) + 1e-9, 4) AS {m}' for m in _METRICS)} FROM c GROUP BY {name.replace('+', ', ')}" for name in ("retriever", "ticker+retriever", "category_label+retriever", "answerable+retriever")),
    "metric_availability": f"WITH {_LONG} SELECT retriever, metric, count(value)::BIGINT AS eligible, count(*)::BIGINT AS rows, round(count(value) / count(*), 4) AS share FROM l GROUP BY retriever, metric",
    "outcome_counts": f"WITH {_RESULTS} SELECT retriever, count(*) FILTER (status = 'ok')::BIGINT AS ok, count(*) FILTER (status = 'generation_error')::BIGINT AS generation_error, count(*) FILTER (status = 'retrieval_error')::BIGINT AS retrieval_error FROM r GROUP BY retriever",
    "metric_correlations": f"WITH {_SCORED} " + " UNION ALL ".join(f"SELECT retriever, '{a}' AS metric_a, '{b}' AS metric_b, CASE WHEN NOT isnan(corr({a}, {b})) THEN round(corr({a}, {b}), 5) END AS r FROM s GROUP BY retriever" for a, b in _PAIRS),
    "box_stats": f"""WITH {_LONG}, q AS (SELECT retriever, metric, count(value)::BIGINT AS n, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM l WHERE value IS NOT NULL GROUP BY ALL)
        SELECT q.retriever, q.metric, n, round(a, 6) AS p25, round(b, 6) AS median, round(c, 6) AS p75, round(min(value), 6) AS whisker_low, round(max(value), 6) AS whisker_high FROM q JOIN l ON l.retriever = q.retriever AND l.metric = q.metric AND value BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a) GROUP BY ALL""",
    "paired_deltas": f"WITH {_DELTA} SELECT run_fingerprint, qa_id, metric, delta FROM dl",
    "delta_extremes": f"""WITH {_DELTA}, m AS (SELECT metric, round(median(delta), 6) AS median_delta FROM dl GROUP BY metric), e AS (SELECT metric, 'low' AS side, row_number() OVER (PARTITION BY metric ORDER BY delta, question)::INT AS r, question, delta FROM dl QUALIFY r <= 2 UNION ALL SELECT metric, 'high', row_number() OVER (PARTITION BY metric ORDER BY delta DESC, question DESC)::INT AS r, question, delta FROM dl QUALIFY r <= 2)
        SELECT metric, side, r, question, delta, median_delta FROM e JOIN m USING (metric)""",
    "category_deltas": f"WITH {_DELTA} SELECT category, metric, count(*)::BIGINT AS n, round(avg(delta), 6) AS mean_delta, round(avg(delta) / CASE metric WHEN 'cosine_sim' THEN 2.0 WHEN 'llm_score' THEN 4.0 ELSE 1.0 END, 6) AS normalized_delta FROM dl GROUP BY category, metric",
    "pipe_lists": f"WITH {_RESULTS}, p AS (SELECT *, {_pipes('retrieved_doc_ids')} AS ds FROM r) SELECT run_fingerprint, qa_id, retriever, len({_pipes('retrieved_chunk_ids')})::INT AS chunks, array_to_string(list_filter(ds, lambda x, i: list_position(ds, x) = i), ';') AS docs, coalesce(round(list_sum(list_transform({_pipes('retrieval_scores')}, lambda x: coalesce(try_cast(x AS DOUBLE), 0.0))), 4), 0.0) AS score_sum FROM p",
    "identifiers": f"""WITH {_CHUNKS} SELECT chunk_id, CASE WHEN regexp_full_match({_strip('cik')}, '[0-9]+') THEN lpad(coalesce(nullif(regexp_replace({_strip('cik')}, '^0+', ''), ''), '0'), 10, '0') ELSE {_strip('cik')} END AS cik10,
        concat_ws('_', lower(ticker), regexp_replace(accession_number, '[^A-Za-z0-9]+', '', 'g'), lpad(chunk_index::VARCHAR, greatest(4, length(chunk_index::VARCHAR))::INT, '0')) AS made_id, concat_ws('_', ticker, {_strip('filing_type')}, {_strip('filing_date')}) AS doc_id,
        coalesce(nullif(regexp_replace(regexp_replace(company, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') AS file_name, {_filed('filing_date')}::VARCHAR AS filed FROM chunk""",
    "scoring_tokens": f"WITH {_RESULTS} SELECT run_fingerprint, qa_id, retriever, len({_TOKENS.format('llm_answer')})::INT AS tokens FROM r",
    "row_fingerprints": f"WITH {_CHUNKS} SELECT chunk_id, sha256(chunk_id || chr(31) || coalesce(text, '')) AS sha256 FROM chunk",
    "sequence_fingerprints": f"WITH {_CHUNKS} SELECT accession_number, sha256(string_agg(chunk_id, '|' ORDER BY chunk_index, chunk_id)) AS sha256, count(*)::BIGINT AS chunks FROM chunk GROUP BY accession_number",
    "quality_warnings": f"SELECT doc_id, array_to_string(list_filter([CASE WHEN length(t) = 0 THEN 'cleaned_text_is_empty' END, CASE WHEN contains(lower(t), '<table') THEN 'html_tables_flattened_to_text' END, CASE WHEN length(t) > 0 AND NOT contains(t, '## ') THEN 'no_section_headings_detected' END, CASE WHEN length(t) > 0 AND len({_words('t')}) < 100 THEN 'very_short_cleaned_text' END], lambda x: x IS NOT NULL), ',') AS warnings FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "normal_lines": rf"""WITH t AS (SELECT doc_id, string_split(regexp_replace(replace(replace(coalesce(text, ''), chr(160), ' '), chr(8203), ''), '\r\n|[\r\f\x{{0B}}\x{{1C}}\x{{1D}}\x{{1E}}\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, list_filter(list_transform(ls, lambda x: {_squeeze('x')}), lambda x: NOT regexp_full_match(lower(x), 'page [0-9]+|(page )?[0-9]+ of [0-9]+')) AS ls FROM t),
        j AS (SELECT doc_id, regexp_replace(array_to_string(ls, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g') AS s FROM l)
        SELECT doc_id, md5(s) AS lines_md5, len(string_split(s, chr(10)))::INT AS lines FROM j""",
    "item_headings": rf"""WITH h AS (SELECT DISTINCT section_heading, {_squeeze('section_heading')} AS line FROM chunks WHERE section_heading IS NOT NULL),
        p AS (SELECT *, regexp_extract(line, '{_ITEM}', ['label', 'no', 'rest']) AS m FROM h),
        n AS (SELECT *, nullif(upper(regexp_replace(m.no, '\s+', '', 'g')), '') AS number, nullif(trim({_squeeze('m.rest')}, ' .:'), '') AS title FROM p)
        SELECT section_heading, number, CASE WHEN number IS NOT NULL THEN m.label || ' ' || number || coalesce('. ' || coalesce(title, CASE number {_TITLES} END), '') END AS heading FROM n""",
    "section_windows": rf"""WITH {_CHUNKS}, w AS (SELECT accession_number, min(ticker) AS ticker, string_agg('## ' || coalesce(nullif({_squeeze('section_heading')}, ''), 'unknown') || chr(10) || text, chr(10) ORDER BY chunk_index, chunk_id) AS t FROM chunk WHERE text IS NOT NULL GROUP BY accession_number),
        p AS (SELECT accession_number, ticker, string_split(regexp_replace(chr(10) || t, '\n(## )', chr(1) || '\1', 'g'), chr(1)) AS ps FROM w),
        u AS (SELECT accession_number, ticker, unnest(ps) AS part, unnest(range(len(ps))) AS no FROM p),
        l AS (SELECT *, list_filter(list_transform(string_split(part, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS ls FROM u),
        s AS (SELECT *, coalesce(regexp_matches(ls[1], '^##(\s|$)'), false) AS headed FROM l),
        b AS (SELECT *, CASE WHEN headed THEN coalesce(nullif({_squeeze("regexp_replace(ls[1], '^##[[:space:]]*', '')")}, ''), 'unknown') ELSE 'unknown' END AS section_heading, array_to_string(CASE WHEN headed THEN ls[2:] ELSE ls END, chr(10) || chr(10)) AS body FROM s),
        k AS (SELECT *, {_words('body')} AS ws FROM b WHERE regexp_matches(body, '[A-Za-z]{{2,}}')),
        e AS (SELECT *, unnest(list_filter(range(0, len(ws), 325), lambda x: x = 0 OR x + 75 < len(ws))) AS st FROM k),
        i AS (SELECT *, row_number() OVER (PARTITION BY accession_number ORDER BY no, st) - 1 AS ix FROM e)
        SELECT accession_number, ix::INT AS chunk_index, concat_ws('_', lower({_strip('ticker')}), regexp_replace(accession_number, '[^A-Za-z0-9]+', '', 'g'), lpad(ix::VARCHAR, greatest(4, length(ix::VARCHAR))::INT, '0')) AS chunk_id, section_heading, least(400, len(ws) - st)::INT AS word_count, md5(array_to_string(ws[st + 1 : st + 400], ' ')) AS text_md5 FROM i""",
    "gold_beyond_latest": f"WITH {_QUESTIONS}, {_FILINGS}, g AS (SELECT DISTINCT qa_id, unnest({_GOLD}) AS doc_id FROM q), n AS (SELECT * FROM f WHERE filed <= DATE '2026-07-14' AND filing_type IN ('10-K', '10-Q', '8-K') QUALIFY row_number() OVER (PARTITION BY ticker, filing_type ORDER BY filed DESC, accession_number DESC) = 1), a AS (SELECT DISTINCT concat_ws('_', ticker, {_strip('filing_type')}, {_strip('filing_date')}) AS doc_id FROM n) SELECT qa_id, doc_id FROM g ANTI JOIN a USING (doc_id)",
    "chunks_beyond_latest": f"WITH {_FILINGS}, n AS (SELECT * FROM f WHERE filed <= DATE '2026-07-14' AND filing_type IN ('10-K', '10-Q', '8-K') QUALIFY row_number() OVER (PARTITION BY ticker, filing_type ORDER BY filed DESC, accession_number DESC) = 1) SELECT DISTINCT accession_number FROM chunks WHERE accession_number IS NULL OR accession_number NOT IN (SELECT accession_number FROM n)",
    "csv_round_trip": "SELECT DISTINCT qa_id, question_id, md5(question) AS question_md5, md5(nullif(answer, '')) AS answer_md5, nullif(ticker, '') AS ticker, category, CASE answerable WHEN true THEN 'true' WHEN false THEN 'false' END AS answerable, nullif(source_doc_ids, '') AS source_doc_ids FROM eval_set",
    "jsonl_round_trip": "SELECT DISTINCT chunk_id, chunk_index, md5(text) AS text_md5, section_heading, cik, word_count FROM chunks",
    "log_round_trip": f"WITH {_RESULTS} SELECT run_fingerprint, qa_id, retriever, status, md5(llm_answer) AS answer_md5 FROM r",
    "category_means": f"WITH {_SCORED}, g AS (SELECT c.category, v.retriever FROM (VALUES (1), (2), (3), (4)) c(category), (VALUES ('bm25'), ('faiss')) v(retriever)) SELECT g.category, g.retriever, count(s.qa_id)::BIGINT AS n, {', '.join(f'round(avg({m}) + 1e-9, 4) AS {m}' for m in _METRICS)} FROM g LEFT JOIN s ON s.category = g.category AND s.retriever = g.retriever GROUP BY g.category, g.retriever",
    "answerable_means": f"WITH {_SCORED}, g AS (SELECT c.answerable, v.retriever FROM (VALUES (true), (false)) c(answerable), (VALUES ('bm25'), ('faiss')) v(retriever)) SELECT g.answerable, g.retriever, count(s.qa_id)::BIGINT AS n, {', '.join(f'round(avg({m}) + 1e-9, 4) AS {m}' for m in _METRICS)} FROM g LEFT JOIN s ON s.answerable = g.answerable AND s.retriever = g.retriever GROUP BY g.answerable, g.retriever",
}
