"""Core operators on small cases with known results."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import providers
from ledgerloom.functions import text as T
from ledgerloom.operators import chunking, cleaning, dense, lexical, profile, scoring, selection, validation

from ledgerloom.sources import index_store


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column).first()[0]


def test_windows_cover_every_word_and_share_the_overlap(spark):
    rng = random.Random(1)
    for n, size, overlap in [(0, 4, 1), (1, 4, 1), (4, 4, 1), (10, 4, 1), (7, 3, 2), (25, 5, 0), *[(rng.randint(0, 40), 6, rng.randint(0, 5)) for _ in range(6)]]:
        words = [f"w{i}" for i in range(n)]
        got = one(spark, chunking.windows(T.words(F.col("t")), size, overlap), t=" ".join(words))
        assert [w.text.split() for w in got] == [words[w.start : w.start + size] for w in got]
        assert [w.start for w in got] == [s for s in range(0, n, size - overlap) if s == 0 or s + overlap < n]
        assert {x for w in got for x in w.text.split()} == set(words)


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (4, -1), (4, 4), (4, 5)])
def test_bad_windows(size, overlap):
    with pytest.raises(ValueError):
        chunking.check_window(size, overlap)


def test_sections(spark):
    text = "before it\n## Item 1. One\nfirst line\n\nsecond line\n## \nno heading\n## Page\n12\n"
    got = [(s.heading, s.body) for s in one(spark, chunking.sections(F.col("t")), t=text)]
    assert got == [("unknown", "before it"), ("Item 1. One", "first line\n\nsecond line"), ("unknown", "no heading")]
    assert one(spark, chunking.sections(F.col("t")), t=None) == [] and one(spark, chunking.sections(F.col("t")), t="") == []


def test_chunks_have_ids_and_stay_in_their_section(spark):
    df = spark.createDataFrame([("AA", "0001-2", "## A\naa bb cc dd ee\n## B\nxx yy"), ("AA", "3", None)], "ticker string, accession_number string, body string")
    got = chunking.chunk_texts(df, "body", 4, 1).orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.section_heading, r.text, r.word_count) for r in got] == [("aa_00012_0000", "A", "aa bb cc dd", 4), ("aa_00012_0001", "A", "dd ee", 2), ("aa_00012_0002", "B", "xx yy", 2)]


HTML = """<html><head><title>T</title><style>x{}</style></head><body><h1>Part <b>One</b></h1><script>no</script>
<div>Some&nbsp;text<br>next &amp; more</div><p style="Display : none">gone <b>gone</b></p><span hidden>gone</span><div aria-hidden="TRUE"><p>gone</p>gone</div>
<table><tr><td>a</td><td>1</td></tr></table><p>Page 3 of 9</p><p>17</p><p>open <b>tag</body></html>"""


def test_html_is_cleaned(spark):
    df = spark.createDataFrame([("html", HTML), ("text", "Item 1. Business\nfirst\nPage 2\nItem 1. Business\n\n\n\nbody"), ("html", None)], "f string, raw string")
    got = cleaning.clean_documents(df, "raw", "f").collect()
    assert got[0].cleaned_text.split("\n")[0] == "T" and "gone" not in got[0].cleaned_text and "no\n" not in got[0].cleaned_text
    assert "## Part One" in got[0].cleaned_text and "Some text\nnext & more" in got[0].cleaned_text and "a 1" in got[0].cleaned_text and "\n17\n" in got[0].cleaned_text and "Page 3" not in got[0].cleaned_text
    assert got[1].cleaned_text == "first\n## Item 1. Business\n\nbody" and "html_tables_flattened_to_text" in got[0].warnings
    assert got[2].warnings == ["cleaned_text_is_empty"]
    with pytest.raises(Exception, match="unsupported format"):
        cleaning.clean_documents(df.withColumn("f", F.lit("pdf")), "raw", "f").collect()


def test_headings_of_items(spark):
    cases = {
        "ITEM 8 . 01 .\n\nOther Events\nbody": "## ITEM 8.01. Other Events\n\nbody", "Item 5 of the agreement\nItem vision": "## Item 5. of the agreement\n## Item VI. sion",
        "a\n\nItem 2. x\n\nb\nItem 2. y\nc": "a\n\nb\n## Item 2. y\nc", "Item 8.01\nOther events.\nItem 9.01\nOther Events": "## Item 8.01. Other Events\n## Item 9.01. Financial Statements and Exhibits\nOther Events",
        "Item 8.01\nOther Events\nItem 8.01\nOther Events\nx": "Other Events\n## Item 8.01. Other Events\nx", "page 3\n3 of 9\n 17 \nPage 2 of 4\npage a": "17\npage a", "": "", "\n\n \n": "",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert {r.t: r.o for r in cleaning.with_headings(df, "t", "o").collect()} == cases


def test_hidden_elements_end_where_the_standard_ends_them():
    seen = lambda html: cleaning.html_text(html).split()
    assert seen("<div>one</div><p hidden>x<div>two</div><p>three</p>") == ["one", "two", "three"]
    assert seen("<table><tr><td hidden>a<td>b</tr><tr hidden><td>c<tr><td>d</table><p>after") == ["b", "d", "after"]
    assert seen("<ul><li hidden>h<ul><li>inner</ul><li>s</ul>end") == ["s", "end"]
    assert seen("<div><span hidden>z</div><p>shown <b>bold</p>") == ["shown", "bold"]
    assert seen("<div hidden>x<p>y</p><table><tr><td>z</div>still</td></table></div>out") == ["out"]
    assert seen("<p style='display: none'>a<br>b</p><h2>T <p>x</h2>c") == [cleaning.MARK, "T", "x", "c"]


def test_content_falls_back(spark):
    c = cleaning.content_of(F.col("h"), F.col("t"), F.col("m"))
    got = one(spark, c, h=None, t="plain", m=None)
    assert (got.raw, got.raw_format, got.readable, got.readable_format) == ("plain", "text", "plain", "text") and "markdown unavailable" in got.warning
    assert one(spark, c, h=" ", t=None, m=None).raw is None


def test_scalar_functions(spark):
    assert one(spark, T.form_mentions(F.col("q")), q="the 10 k, 8–K and 10-K / 10Q") == ["10-K", "8-K", "10-Q"]
    assert one(spark, T.form_mentions(F.col("q")), q="10  -  q\n10\u00a0K 110-K 10-Kx 8 -- K") == ["10-Q", "10-K"]
    made = spark.createDataFrame([(i,) for i in (7, 1234, 12345, 12346)], "i int").select(T.chunk_id(F.lit(" AA "), F.lit("x-1"), F.col("i")).alias("c"))
    assert [r.c for r in made.collect()] == ["aa_x1_0007", "aa_x1_1234", "aa_x1_12345", "aa_x1_12346"]
    assert [one(spark, T.compares(F.col("q")), q=q) for q in ("compare a", "A vs. B", "versus", "relative  to", "comparable")] == [True, True, True, True, False]
    assert [one(spark, T.parse_judge(F.col("q")), q=q) for q in ("5.", " 1 ", "Score: 5", "6")] == [5, 1, None, None]
    assert [one(spark, T.parse_boolean(F.col("q")), q=q) for q in ("Yes", "0", "maybe", None)] == [True, False, None, None]
    assert [one(spark, T.pad_cik(F.col("q")), q=q) for q in ("0001018724", "12", "000", "x1")] == ["0001018724", "0000000012", "0000000000", "x1"]
    assert one(spark, T.pipe_list(F.col("q")), q=" a | |b|") == ["a", "b"] and one(spark, T.pipe_list(F.col("q")), q=None) == []
    assert one(spark, T.safe_name(F.col("q")), q="//") == "unknown" and one(spark, T.safe_name(F.col("q")), q="A & B, Inc.") == "A-B-Inc."
    assert one(spark, T.scoring_tokens(F.col("q")), q="The 10-K says 3.14, café.") == ["the", "10-k", "says", "3.14", "café"]
    assert one(spark, T.is_missing(F.col("q")), q=" \t") and not one(spark, T.is_missing(F.col("q")), q="[]")


def test_scores(spark):
    f1 = scoring.token_f1(F.col("a"), F.col("b"))
    assert one(spark, f1, a="a a b", b="a b b") == 0.6667 and one(spark, f1, a="", b="x") == 0.0 and one(spark, f1, a="x", b="y") == 0.0
    gold, got = F.col("g"), F.col("r")
    assert one(spark, scoring.recall(gold, got), g=["d2", "d9"], r=["d1", "d2", "d2"]) == 0.5
    assert one(spark, scoring.reciprocal_rank(gold, got), g=["d2"], r=["d1", "d2"]) == 0.5 and one(spark, scoring.reciprocal_rank(gold, got), g=["x"], r=["d1"]) == 0.0
    assert one(spark, scoring.recall(gold, got), g=[], r=["a"]) is None
    docs = scoring.gold_documents(F.col("m"), F.col("s"))
    assert one(spark, docs, m=None, s="A_MULTI") == [] and one(spark, docs, m="x|y|x", s="A_MULTI") == ["x", "y"] and one(spark, docs, m="", s="d") == ["d"]
    status = scoring.overall_status(F.col("a"), F.col("b"))
    assert [one(spark, status, a=a, b=b) for a, b in (("ok", "ok"), ("ok", "error"), ("error", "not_run"), ("error", "ok"))] == ["ok", "generation_error", "retrieval_error", None]


def test_reserved_places(spark):
    rows = [("q", "K", 1), ("q", "K", 2), ("q", "Q", 3), ("q", "X", 4)]
    df = spark.createDataFrame(rows, "qid string, form string, rank int").withColumn("forms", F.array(F.lit("K"), F.lit("Q"))).withColumn("each", F.lit(True))
    got = selection.reserved_top_k(df, "qid", "form", "rank", 2, "forms", "each").orderBy("place").collect()
    assert [r.rank for r in got] == [1, 3]
    got = selection.reserved_top_k(df.withColumn("each", F.lit(False)), "qid", "form", "rank", 2, "forms", "each").orderBy("place").collect()
    assert [r.rank for r in got] == [1, 2]


def test_bm25_fills_up_with_records_that_score_nothing(spark):
    chunks = spark.createDataFrame([("A", f"c{i}", t) for i, t in enumerate(["cash flow", "risk", "cash cash", "", "other words"])] + [("B", "z", "cash")], "ticker string, chunk_id string, text string")
    asked = spark.createDataFrame([("q1", "A", "Cash"), ("q2", "A", "nothing"), ("q3", "C", "cash")], "qa_id string, ticker string, question string")
    got = lexical.ranked(asked, chunks, "ticker", "chunk_id", "text", "qa_id", "question", 4).collect()
    order = {q: [r.key for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] for q in ("q1", "q2", "q3")}
    assert order == {"q1": ["c2", "c0", "c1", "c3"], "q2": ["c0", "c1", "c2", "c3"], "q3": []}


def test_bm25_ranks_all_chunks_of_the_allowed_forms(spark, monkeypatch):
    texts = [("c0", "10-K", "cash flow"), ("c1", " 10-k ", "risk"), ("c2", "8-K", "board"), ("c3", "8-K", "vote"), ("c4", "10-Q", "cash cash"), ("c5", None, "other words"), ("c6", "10-Q", "more of it")]
    chunks = spark.createDataFrame([("A", *t) for t in texts], "ticker string, chunk_id string, filing_type string, text string")
    asked = spark.createDataFrame([("q1", "A", "Cash", ["10-K"]), ("q2", "A", "cash", ["10-Q", "8-K"]), ("q3", "A", "cash", []), ("q4", "A", "nothing", ["8-K"]), ("q5", "B", "cash", []), ("q6", "A", "", None)], "query string, part string, question string, allowed array<string>")
    records = lexical.records_of(chunks, "ticker", "chunk_id", "text", "filing_type")
    ids = lambda rows: {q: [r.key for r in sorted((r for r in rows if r["query"] == q), key=lambda r: (-r.score, r.key))] for q in ("q1", "q2", "q3", "q4", "q5", "q6")}
    for block in (256, 1):
        monkeypatch.setattr(lexical, "BLOCK_QUESTIONS", block)
        monkeypatch.setattr(lexical, "PASS_WEIGHTS", 400_000 if block > 1 else 2)
        assert ids(lexical.best_of_index(records, lexical.terms_of(records), asked, 2).collect()) == {"q1": ["c0", "c1"], "q2": ["c4", "c2"], "q3": ["c4", "c0"], "q4": ["c2", "c3"], "q5": [], "q6": ["c0", "c1"]}
        grouped = ids(lexical.best_of_index(records, lexical.terms_of(records), asked, 1, per_group=True).collect())
        assert grouped["q2"] == ["c4", "c2"] and grouped["q3"] == ["c4", "c0", "c2", "c5"]


def test_index_is_refused_for_other_chunks_or_settings(spark, tmp_path, monkeypatch):
    chunks = spark.createDataFrame([("A", "c0", "cash flow"), ("A", "c1", "risk"), ("A", "c2", "vote"), ("A", "c3", "board")], "ticker string, chunk_id string, text string")
    path, columns = str(tmp_path / "bm25"), ("ticker", "chunk_id", "text")
    lexical.build_index(chunks, *columns, path)
    records, terms = lexical.load_index(spark, path, lexical.source_fingerprint(chunks, *columns))
    asked = spark.createDataFrame([("q", "A", "risk")], "query string, part string, question string").withColumn("allowed", F.array().cast("array<string>"))
    assert lexical.best_of_index(records, terms, asked, 1).first().key == "c1"
    changed = chunks.withColumn("text", F.concat("text", F.lit(" x")))
    with pytest.raises(index_store.StaleIndexError, match="content"):
        lexical.load_index(spark, path, lexical.source_fingerprint(changed, *columns))
    with pytest.raises(index_store.StaleIndexError, match="no readable"):
        lexical.load_index(spark, str(tmp_path / "none"))
    monkeypatch.setattr(lexical, "K1", 2.0)
    with pytest.raises(index_store.StaleIndexError, match="k1"):
        lexical.load_index(spark, path)
    vectors = spark.createDataFrame([("A", "c0", [3.0, 4.0])], "ticker string, chunk_id string, vector array<float>")
    dense.build_index(vectors, "ticker", "chunk_id", "vector", str(tmp_path / "v"), "m", {"chunks": "1"})
    assert dense.load_index(spark, str(tmp_path / "v"), "m", {"chunks": "1"}).first().vector == pytest.approx([0.6, 0.8])
    with pytest.raises(index_store.StaleIndexError, match="embedding_model"):
        dense.load_index(spark, str(tmp_path / "v"), "other")
    with pytest.raises(ValueError, match="without a vector"):
        dense.build_index(vectors.unionByName(vectors.withColumn("vector", F.lit(None).cast("array<float>"))), "ticker", "chunk_id", "vector", str(tmp_path / "v"), "m", {})
    assert dense.load_index(spark, str(tmp_path / "v"), "m").count() == 1  # the former index stays


def test_dense_search_equals_brute_force_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], i % 3) for i in range(60)] + [(60, None, 1), (61, [0.0] * 6, 2)]
    df = spark.createDataFrame(rows, "id long, v array<float>, g int")
    monkeypatch.setattr(dense, "QUERY_BLOCK", 2)
    monkeypatch.setattr(dense, "PASS_NUMBERS", 18)
    asked = df.where("id < 5").withColumn("want", F.array(F.lit(0), F.lit(1)))
    got = dense.dense_top_k(df, "id", "v", asked, "id", "v", 4, group="g", allowed="want").collect()
    unit = lambda v: [x / (sum(y * y for y in v) ** 0.5 or 1) for x in v]
    f32 = {i: unit([__import__("struct").unpack("f", __import__("struct").pack("f", x))[0] for x in v]) for i, v, _ in rows if v and len(v) == 6}
    for q in range(5):
        want = sorted(((-round(sum(a * b for a, b in zip(f32[q], f32[i])), 6), i) for i in f32 if rows[i][2] in (0, 1)))[:4]
        assert [r.key for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == [i for _, i in want]
    assert dense.dense_top_k(df, "id", "v", df.where("id < 0"), "id", "v", 4).count() == 0
    with pytest.raises(ValueError, match="different lengths: 1, 6"):
        dense.dense_top_k(df.unionByName(spark.createDataFrame([(62, [1.0], 0)], df.schema)), "id", "v", asked, "id", "v", 4)


def test_log_keeps_the_last_row_and_resume_skips_done_work(spark):
    log = spark.createDataFrame([("q1", "bm25", 1, "generation_error"), ("q1", "bm25", 2, "ok"), ("q2", "bm25", 1, "retrieval_error"), ("q1", "bm25", 2, "ok")], "qa_id string, retriever string, no int, status string")
    assert {(r.qa_id, r.status) for r in selection.last_written(log, ["qa_id", "retriever"], ["no"]).collect()} == {("q1", "ok"), ("q2", "retrieval_error")}
    work = selection.open_work(spark.createDataFrame([("q1",), ("q2",)], "qa_id string"), ["bm25", "faiss"], log, ["qa_id"], ["no"])
    assert {(r.qa_id, r.retriever) for r in work.collect()} == {("q1", "faiss"), ("q2", "bm25"), ("q2", "faiss")}
    # an error behind an ok result opens the pair again
    later = log.unionByName(spark.createDataFrame([("q1", "bm25", 3, "generation_error")], log.schema))
    assert selection.open_work(spark.createDataFrame([("q1",)], "qa_id string"), ["bm25"], later, ["qa_id"], ["no"]).count() == 1


def test_rows_are_taken_once(spark):
    df = spark.createDataFrame([("a", "x", 2), ("a", "x", 1), ("b", "y", 3), (None, "z", 4), (None, "z", 4), ("c", None, None)], "k string, t string, n int")
    assert sorted(chunking.unique_rows(df, "k").collect(), key=str) == sorted([("a", "x", 1), ("b", "y", 3), (None, "z", 4), ("c", None, None)], key=str)
    assert chunking.distinct_rows(df, "k").count() == 5 and chunking.unique_rows(df.limit(0), "k").count() == 0


def test_reports(spark):
    df = spark.createDataFrame([("a", 1), ("", 5), (None, 400)], "t string, n int")
    got = {(r.field, r.missing, r.missing_pct) for r in profile.missingness(df, "x", ["t", "n", "none"]).collect()}
    assert got == {("t", 2, 66.67), ("n", 0, 0.0), ("none", 3, 100.0)}
    d = profile.describe(df, F.col("n")).first()
    assert (d.n, d.min, d.p25, d.median, d.p75, d.max) == (3, 1.0, 3.0, 5.0, 202.5, 400.0)
    assert profile.describe(df.limit(0), F.col("n")).first().max == 0.0
    report = validation.violations(df, {"blank": T.is_missing(F.col("t"))}, ["t"])
    assert {(r.metric, r["count"]) for r in report.collect()} == {("blank", 2), ("duplicate_key", 0)}
    with pytest.raises(ValueError, match="blank: 2"):
        validation.assert_clean(report)


def test_settings():
    assert validation.normalize_tickers([" aa ", "b.b"]) == ["AA", "B.B"] and validation.dataset_name([" AA ", "b.b"]) == "aa_b.b"
    for bad in ([], ["a b"], ["a", "A"]):
        with pytest.raises(ValueError):
            validation.normalize_tickers(bad)
    assert validation.top_k_setting(None, None) == 5 and validation.top_k_setting(None, "3") == 3 and validation.top_k_setting(7, "3") == 7
    for bad in (0, "x"):
        with pytest.raises(ValueError):
            validation.top_k_setting(bad, None)
    with pytest.raises(ValueError):
        validation.run_name("../x")


def test_providers_report_errors_and_make_nothing_up(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "t string").coalesce(1)
    def broken(texts):
        raise RuntimeError("no service")
    got = {r.t: r for r in providers.apply_provider(df, "t", "answer", "string", broken).collect()}
    assert got["a"].answer is None and got["a"].answer_status == "error" and "no service" in got["a"].answer_error and got[None].answer_status == "not_run"
    assert {r.answer for r in providers.apply_provider(df, "t", "answer", "string", lambda x: [y.upper() for y in x]).collect()} == {"A", None, "B"}
    assert {r.answer_status for r in providers.apply_provider(df, "t", "answer", "string", None).collect()} == {"not_run"}
    with pytest.raises(ValueError):
        providers.answer_text([" ", ""])
