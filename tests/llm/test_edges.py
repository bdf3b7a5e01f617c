"""Empty tables, nulls in every column, very long texts and clashing names for every corpus operator."""

import pytest

from ledgerloom.llm import encoding, languages, lookalike, mixing, near_duplicates, repeated_lines, responses, splitting, term_frequency, text_quality, truncation

# names that the operators use themselves
CLASHING = "chunk_id string, text string, cik string, ticker string, k string, t string, h string, n long, lines string, source string, item string, value string, a long, b long"


@pytest.fixture(scope="module")
def table(spark):
    rest = ("x", "y", "z", 1, "l", "s", "i", "v", 2, 3)
    rows = [("a", "one two", "7", "AA", *rest), ("a", "one two", "7", "AA", *rest), (None, None, None, None, *(None,) * 10), ("e", "", "7", None, *rest), (None, "  \n ", None, "aa", *rest), ("long", "word " * 300_000, "7", "AA", *rest)]
    return spark.createDataFrame(rows, CLASHING)


OPERATORS = {
    "terms": lambda df: term_frequency.term_frequencies(df, "chunk_id", "text"),
    "pieces": lambda df: splitting.split_oversized(df, "chunk_id", "text", "ticker"),
    "statistics": lambda df: text_quality.text_statistics(df, "chunk_id", "text", ("ticker",)),
    "forms": lambda df: lookalike.normalize_lookalikes(df, "chunk_id", ["text"], "x"),
    "pairs": lambda df: near_duplicates.near_duplicate_pairs(df, "chunk_id", "text"),
    "groups": lambda df: near_duplicates.near_duplicate_groups(df, "chunk_id", "text"),
    "lines": lambda df: repeated_lines.frequent_lines(df, "chunk_id", "text", "cik", "ticker"),
    "sequences": lambda df: repeated_lines.frequent_sequences(df, "chunk_id", "text", "cik", "ticker"),
    "clean": lambda df: repeated_lines.remove_repeated_lines(df, "chunk_id", "text", "cik", "ticker"),
    "defects": lambda df: responses.defective_pairs(df.selectExpr("*", "true AS ok"), ["chunk_id", "value"], "ticker", "text", "ok", "t", df.selectExpr("text", "ticker AS lang")),
    "ids": lambda df: encoding.encode_texts(df, "chunk_id", "text"),
    "cut": lambda df: truncation.truncation_evidence(df, "chunk_id", "text", "source", "n"),
}
ROWS = {"terms": 3, "pieces": 923, "statistics": 5, "forms": 5, "pairs": 0, "groups": 1, "lines": 0, "sequences": 0, "clean": 5, "defects": 4, "ids": 6, "cut": 5}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_have_a_defined_result(table, name):
    assert OPERATORS[name](table.limit(0)).count() == 0
    assert OPERATORS[name](table).count() == ROWS[name]


def test_mixtures_of_nothing(spark):
    docs = spark.createDataFrame([(1, "some words here", "zzz"), (2, None, "a"), (3, "", "a")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), (None, 1.0, 1)], "source string, target_share double, max_repeats int")
    for d, t, n in ((docs, targets, 2), (docs.limit(0), targets, 2), (docs, targets.limit(0), 0)):
        mixed, report = mixing.mixture(d, t, "doc_id", "text", "source")
        rows = report.collect()
        assert mixed.count() == 0 and len(rows) == n and all(r.tokens == 0 and r.actual_share == 0 for r in rows)


def test_languages_of_few_and_odd_labels(spark):
    odd = spark.createDataFrame([(None, "en"), ("too short", "en"), ("only one language has texts of any length here", "EN-us")], "text string, lang string")
    assert languages.sample(odd, "text", "lang") is None and languages.sample(odd.limit(0), "text", "lang") is None
    # scripts need no labels
    assert languages.differs(None, ["What drove revenue?", "What?", ""], ["Расходы на рекламу снизились", "сto", "x"]) == [True, False, False]
