"""Corpus operators against brute force, exact round trips and planted cases."""

import collections
import itertools
import random
import re
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import encoding, lookalike, mixing, near_duplicates, repeated_lines, responses, splitting, term_frequency, text_quality, truncation

DATA = "/root/testdata/sf0.001"
CHUNK = "chunk_id string, text string, cik string, ticker string, term string, k string"


def rows_of(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def chunks(spark, rows):
    return spark.createDataFrame([(i, t, c, k, "x", "y") for i, t, c, k in rows], CHUNK)


# 1
def test_term_counts_equal_brute_force(spark):
    rng = random.Random(1)
    words = ["the", "of", "alpha", "beta", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))]
    texts = [(f"c{i}", " ".join(rng.choice(words[:4] if rng.random() < 0.6 else words) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows = [(i, t, None, None) for i, t in texts] + [("c0", texts[0][1], None, None), ("n", None, None, None), ("e", "", None, None), (None, "Only Here x", None, None)]
    occurrences, records, n = collections.Counter(), collections.Counter(), 0
    for t in [t for _, t in texts] + ["", "Only Here x"]:
        found = re.findall("[a-z]{2,}", t.lower())
        occurrences.update(found)
        records.update(set(found))
        n += 1
    want = {(t, occurrences[t], c, "rare" if c < 3 else "common" if c > n / 2 else None) for t, c in records.items()}
    for share in (0.05, 0.0005):  # some terms light, or all heavy
        got = term_frequency.term_frequencies(chunks(spark, rows), "chunk_id", "text", heavy_share=share, light_entries=50)
        assert rows_of(got, "term", "occurrences", "records", "mark") == want


def test_term_counts_of_nothing(spark):
    assert term_frequency.term_frequencies(chunks(spark, []), "chunk_id", "text").count() == 0


# 2
@settings(max_examples=60, deadline=None)
@given(st.integers(0, 400), st.integers(5, 40), st.integers(0, 3), st.integers(0, 10**6))
def test_pieces_cover_the_text(n, limit, overlap, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["alpha", "beta.", "gamma", "delta,", "x"]) + rng.choice([" ", "\n", "\n\n", "  "]) for _ in range(n))
    words, pieces = text.split(), splitting.split_text(text, None, limit, overlap)
    assert sum(b - a for a, b, *_ in pieces) == len(words) + overlap * max(len(pieces) - 1, 0)
    for (_, b, *_), (c, *_) in itertools.pairwise(pieces):
        assert c == b - overlap
    for a, b, _, piece in pieces:
        assert b - a <= limit and piece.split() == words[a:b]


def test_split_prefers_a_topic_boundary_and_ignores_stored_counts(spark):
    left = " ".join("reactor turbine pressure cooling" for _ in range(70)) + "."
    right = " ".join("dividend shareholder payment register" for _ in range(70)) + "."
    df = spark.createDataFrame([("a", left + "\n" + right, "H", 3), ("a", left + "\n" + right, "H", 3), ("b", "short", None, 999), ("c", None, None, None), ("d", "", None, 1)], "id string, text string, head string, piece_no int")
    got = splitting.split_oversized(df, "id", "text", "head").orderBy("piece_no").collect()
    assert [r.item_id for r in got] == ["a", "a"] and got[0].end_word == 280 and got[0].boundary == "line"


# 4
CASES = {
    "ＡＢＣ １２３": "ABC 123", "résumé": "résumé", "so­ft​ly﻿": "softly", "a b c": "a b c", "oﬃce ﬁle": "office file",
    "аgrееmеnt with Аѕіа": "agreement with Asia", "«Жёлтый дом» plc": "«Жёлтый дом» plc", "и с ним": "и с ним", "“quoted” – it’s •": "“quoted” – it’s •",
    "Μέλισσα": "Μέλισσα", "株式会社（東京）、": "株式会社（東京）、", "": "", "naïve": "naïve", "𝐁𝐨𝐥𝐝": "Bold", "a\nb\tc": "a\nb\tc", "👩‍🔬": "👩‍🔬",
}


def test_lookalikes(spark):
    df = spark.createDataFrame([(str(i), x, None, "z") for i, x in enumerate(CASES)] + [("n", None, None, "z"), ("0", "ＡＢＣ １２３", None, "z")], "id string, v0 string, changed string, r string")
    got = {r.row_key: r for r in lookalike.normalize_lookalikes(df, "id", ["v0", "changed"], "t").where("field_name = 'v0'").collect()}
    for i, (x, want) in enumerate(CASES.items()):
        assert got[str(i)].normal_text == want, (x, got[str(i)].normal_text)
        assert got[str(i)].changed == (x != want)
    assert got["n"].normal_text is None and not got["n"].changed and len(got) == len(CASES) + 1
    assert lookalike.normalize_lookalikes(df.limit(0), "id", ["v0"], "t").count() == 0


# 5
def test_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = {}
    for i in range(120):
        texts[f"d{i:03}"] = words = [rng.choice(vocabulary) for _ in range(rng.randint(55, 120))]
        for j in range(rng.randint(0, 3)):
            copy = list(words)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts[f"d{i:03}{'abc'[j]}"] = copy
    texts = {k: " ".join(w) for k, w in texts.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if min(len(texts[a].split()), len(texts[b].split())) >= 60 and near_duplicates.similarity(texts[a], texts[b], 3) >= 0.7}
    rows = [(k, t, None, None) for k, t in texts.items()]
    df = chunks(spark, rows + rows[:5] + [("n", None, None, None), ("e", "", None, None)])
    got = rows_of(near_duplicates.near_duplicate_pairs(df, "chunk_id", "text"), "id_a", "id_b")
    assert not got - want and len(want - got) <= 0.01 * len(want) and len(want) > 50
    # groups are the components of these links
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        root[max(find(a), find(b))] = min(find(a), find(b))
    groups = rows_of(near_duplicates.near_duplicate_groups(df, "chunk_id", "text"), "item_id", "group_id")
    assert groups == {(k, find(k)) for k, t in texts.items() if len(t.split()) >= 60} or len(want - got)
    assert near_duplicates.near_duplicate_pairs(df.limit(0), "chunk_id", "text").count() == 0


def test_dense_regions_are_compared_in_blocks(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(100)]
    texts = {}
    for i in range(90):  # all alike enough to stand in the same regions
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts[f"d{i:03}"] = " ".join(words)
    want = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if near_duplicates.similarity(texts[a], texts[b], 3) >= 0.7}
    df = chunks(spark, [(k, t, None, None) for k, t in texts.items()])
    signed = near_duplicates.signatures(df, "chunk_id", "text", 3, 60)
    number = {r.c1: r.k for r in signed.select("c1", "k").collect()}
    for region in (4096, 40, 7):
        found = {tuple(sorted((number[r.a], number[r.b]))) for r in near_duplicates.candidates(signed, 0.7, region).collect()}
        held = {tuple(sorted((number[c1], number[c2]))) for c1, c2 in itertools.combinations(number, 2)}
        missed = {p for p in want & held if p not in found}
        assert len(missed) <= 0.01 * len(want), (region, len(missed), len(want))


def test_two_texts_of_one_id_lose_no_link(spark):
    rng = random.Random(13)
    one, two = (" ".join(f"{c}{rng.randrange(999)}" for _ in range(80)) for c in "ab")
    df = chunks(spark, [("x", one, None, None), ("x", two, None, None), ("y", one + " end", None, None), ("z", two + " end", None, None)])
    assert rows_of(near_duplicates.near_duplicate_pairs(df, "chunk_id", "text"), "id_a", "id_b") == {("x", "y"), ("x", "z")}


def test_forms_of_several_characters_and_selectors(spark):
    wanted = {"Part Ⅱ, Ⅷ and ⅳ": "Part II, VIII and iv", "step ① to ⑩ ⑵ ⒊": "step 1 to 10 (2) 3.", "non‑stop": "non‐stop", "ca\ufe0fsh a\ufe00 b\U000e0101": "cash a b", "a\ufe0f\u200db": "ab", "❤\ufe0f\u200d🔥 ☎\ufe0e 1\ufe0f\u20e3": None, "Brand™ № 5 ℠": None, "ﬁne oﬃce": "fine office"}
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(wanted)], "id string, t string")
    got = {int(r.row_key): (r.normal_text, r.changed) for r in lookalike.normalize_lookalikes(df, "id", ["t"], "x").collect()}
    assert got == {i: (b or a, b is not None) for i, (a, b) in enumerate(wanted.items())}


# 6
def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        lines = [f"own {i} {j}" for j in range(3)] + ["  Legal   NOTICE "] * (i % 2) + ["legal notice"] * (i % 3) + [""]
        rng.shuffle(lines)
        rows.append((f"c{i}", "\n".join(lines), ["0007", "7", None][i % 3], ["abc", " ABC ", "Abc"][i % 3]))
    rows += rows[:3] + [("n", None, "7", "abc"), ("z", "legal notice", None, None)]
    got = rows_of(repeated_lines.frequent_lines(chunks(spark, rows), "chunk_id", "text", "cik", "ticker"), "item_id", "line_no")
    want = {(i, n) for i, t, _, k in rows if t and k for n, x in enumerate(t.split("\n")) if " ".join(x.lower().split()) == "legal notice"}
    assert got == want and want
    clean = {r.item_id: r for r in repeated_lines.remove_repeated_lines(chunks(spark, rows), "chunk_id", "text", "cik", "ticker").collect()}
    assert all("egal" not in (r.clean_text or "").lower() for i, r in clean.items() if i != "z") and clean["n"].clean_text is None and clean["z"].clean_text == "legal notice"
    # records without an id, and two texts of one id, are cut by their own lines
    more = [(None, "first\nlegal notice\nlast", "7", "abc"), ("c0", "x\ny\nLEGAL notice\nz", "7", "abc"), (None, "  ", "7", "abc")]
    clean = rows_of(repeated_lines.remove_repeated_lines(chunks(spark, rows + more), "chunk_id", "text", "cik", "ticker"), "item_id", "removed_lines", "clean_text")
    assert {(None, 1, "first\nlast"), ("c0", 1, "x\ny\nz"), (None, 0, "  ")} <= clean


def test_sequences_of_lines(spark):
    rows = [(f"c{i}", f"a\nx{i}\nB\ny{i}\nc" if i < 12 else f"c\n{i}\na", "1", None) for i in range(15)]
    got = {(tuple(r.lines), r.records) for r in repeated_lines.frequent_sequences(chunks(spark, rows), "chunk_id", "text", "cik", "ticker").collect()}
    assert got == {(("a",), 15), (("b",), 12), (("c",), 15), (("a", "b"), 12), (("a", "c"), 12), (("b", "c"), 12), (("a", "b", "c"), 12)}


def test_sequences_of_any_length_and_repeated_lines(spark):
    rows = [(f"c{i}", f"a\nb\nx{i}\nc\nd\ne", "1", None) for i in range(11)]
    # behind b at 5, and a at 3, no first or last place of a line is the next one
    rows += [(f"r{i}", f"b\n{i} k\n{i} l\na\n{i} m\nb\n{i} n\nc\n{i} o\nb", "2", None) for i in range(10)]
    got = {(r.source, tuple(r.lines)): r.records for r in repeated_lines.frequent_sequences(chunks(spark, rows), "chunk_id", "text", "cik", "ticker").collect()}
    want = {("cik 1", s): 11 for n in range(1, 6) for s in itertools.combinations("abcde", n)}
    want |= {("cik 2", tuple(s)): 10 for s in ("a", "b", "c", "ab", "ac", "ba", "bb", "bc", "cb", "abb", "abc", "acb", "bab", "bac", "bbb", "bbc", "bcb", "abcb", "babc", "bacb", "babb", "bbcb", "babcb")}
    assert got == want


# 8
def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoding.TOKENIZER_PATH)
    t.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["", "  lead", "a" * 3000, " " * 700 + "x", "<|endoftext|> is text", "naïve 公司 ‍👩‍🔬 \x00\x7f", "don't we'll I'D", "\r\n\t\n x \n\n y  ", "".join(chr(rng.randrange(1, 0xD000)) for _ in range(4000)), "word" * 500]
    df = spark.createDataFrame([(i, x, "q") for i, x in enumerate([*texts, None, texts[1]])], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encoding.encode_texts(df, "doc_id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert got[len(texts)] == [] and len(got) == len(texts) + 2
    assert encoding.encode_texts(df.limit(0), "doc_id", "text").count() == 0


# 7
PAIRS = [
    ("q", "What drove the change in revenue during 2020?", "", True, "empty"),
    ("q", "What drove the change in revenue during 2020?", "Sources: []", True, "empty"),
    ("q", "What drove the change in revenue during 2020?", None, True, "empty"),
    ("q", "What drove the change in revenue during 2020?", "43.9%", True, None),
    ("q", "What drove the change in revenue during 2020?", "Yes.", True, None),
    ("q", "What drove the change in revenue during 2020?", "Q: What drove the change in revenue during 2020", True, "question_copy"),
    ("q", "What drove the change in revenue during 2020?", "On the question “What drove the change in revenue during 2020?”, sales of new products rose in Osaka.", True, None),
    ("q", "What drove the change in revenue during 2020?", "What drove the change in revenue during 2020?\nWhat drove the change in revenue during 2020?", True, "question_copy"),
    ("q", "What drove the change in revenue during 2020?", "I'm sorry, but I can't answer that.", True, "refusal"),
    ("q", "What drove the change in revenue during 2020?", "I'm sorry, but I can't answer that.", False, None),
    ("q", "What drove the change in revenue during 2020?", "The filing does not state revenue separately; however, in Wales sales of all the units climbed.", True, None),
    ("q", "What drove the change in revenue during 2020?", "We cannot predict whether tax changes will recur.", True, None),
    ("q", "What drove the change in revenue during 2020?", "Le chiffre d’affaires a progressé en raison de la hausse des prix.", True, "other_language"),
    ("q", "What drove the change in revenue during 2020?", "The registrant writes “Le chiffre d’affaires a progressé de la moitié.” in a note for readers abroad.", True, None),
    ("q", "What drove the change in revenue during 2020?", "Revenue rose because the company opened 12 sites and the", True, "truncated"),
    ("q", "What drove the change in revenue during 2020?", "- Revenue rose in Wales.\n- The company opened 12 si", True, "truncated"),
    ("q", "What drove the change in revenue during 2020?", "- Revenue rose in Wales\n- The company opened 12 sites\nSources: [Chunk 1]", True, None),
    ("q", "What drove the change in revenue during 2020?", "1. Backlog: €4.2 million\n2. Cost of sales: $6.7 million", True, None),
    (None, None, None, None, "empty"),
]


SPOKEN = {
    "en": "The company reported higher revenue in the second quarter because prices of services rose. Which risks does the filing describe for the segment? What drove the change in operating income during the period? Cost of sales and the backlog were twelve million lower.",
    "fr": "Le chiffre d’affaires de la société a baissé au cours de l’exercice en raison de la concurrence. Les charges de personnel ont progressé et la direction prévoit une hausse des prix dans ce secteur.",
    "es": "Los ingresos de la compañía aumentaron durante el ejercicio por la subida de los precios. La división de servicios advierte de riesgos por la pérdida de un proveedor y nuevas normas.",
}


def spoken(spark):
    return spark.createDataFrame([(t, k.upper() if k == "fr" else k) for k, t in SPOKEN.items()] + [(None, "en"), ("no label", None)], "text string, lang string")


def test_defects(spark):
    rows = [(f"r{i}", q, a, ok) for i, (_, q, a, ok, _) in enumerate(PAIRS)]
    df = spark.createDataFrame(rows + rows, "run string, q string, answer string, ok boolean")
    got = {r.run: r.defect for r in responses.defective_pairs(df, ["run"], "q", "answer", "ok", language_texts=spoken(spark)).collect()}
    assert got == {f"r{i}": p[4] for i, p in enumerate(PAIRS) if p[4]}
    assert responses.defective_pairs(df.limit(0), ["run"], "q", "answer", "ok").count() == 0


@pytest.mark.parametrize(
    ("answer", "defect"),
    [
        ("I'm sorry, but I can't answer that from the material provided.", "refusal"),
        ("I'm sorry, but I can't answer that from the material provided.\nSources: [Chunk 1]", "refusal"),
        ("We are not able to answer; I still cannot say which of the two plants was sold.", "refusal"),
        ("I'm sorry, but the excerpts that were provided do not contain the figure. However, I cannot determine it from another place in them.", "refusal"),
        ("I cannot determine revenue from these excerpts. " + "They treat the lease of the site in Wales and its terms. " * 8, "refusal"),
        ("The filing does not state revenue separately; however, in Wales sales of all the units climbed.", None),
    ],
)
def test_refusals_with_contrast_or_of_any_length(answer, defect):
    assert responses.rule_defect("What drove the change in revenue during 2020?", answer, True) == defect


def test_declining_where_it_is_right_has_no_defect_in_any_language(spark):
    asked = "¿Cómo cambiaron los ingresos de la compañía durante el ejercicio?"
    rows = [("right", asked, "I cannot determine revenue from these excerpts.", False), ("wrong", asked, "I cannot determine revenue from these excerpts.", True), ("english", asked, "Higher prices of services drove the change in revenue.", True), ("spanish", asked, "Los ingresos aumentaron por la subida de los precios.", True)]
    # letters that only imitate Latin ones make no Russian
    rows += [("imitated", "¿Cómo саmbіаrοn los ingreѕos de la compañía durаntе el ејеrсісіο?", "Los ingresos aumentaron por la subida de los precios.", True), ("figure", asked, "30.1 percent", True), ("asks", asked, f"The question asks: {asked}", True)]
    df = spark.createDataFrame(rows, "run string, q string, answer string, ok boolean")
    got = {r.run: r.defect for r in responses.defective_pairs(df, ["run"], "q", "answer", "ok", language_texts=spoken(spark)).collect()}
    assert got == {"wrong": "refusal", "english": "other_language", "asks": "question_copy"}


def test_wordings_of_refusals_are_learned(spark):
    rng = random.Random(6)
    things = ["a joint venture", "the code of conduct", "a supply agreement", "a note offering"]
    silent = lambda: f"The context is silent on {rng.choice(things)}. Further documents would be needed before answering."
    told = lambda: f"The {rng.choice(['media', 'health', 'devices'])} unit reported {rng.choice(things)} worth {rng.randint(2, 99)} million in its last period."
    rows = [(f"n{i}", f"q{i}", silent() if i % 2 else told(), False) for i in range(60)] + [(f"y{i}", f"p{i}", told(), True) for i in range(300)] + [("refused", "q", silent(), True)]
    df = spark.createDataFrame(rows, "run string, q string, answer string, ok boolean")
    assert {r.run: r.defect for r in responses.defective_pairs(df, ["run"], "q", "answer", "ok").collect()} == {"refused": "refusal"}


def asked_values(spark, values):
    return spark.createDataFrame([(v, 1, True) for v in values], "value string, n long, asked boolean")


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_neighbours_find_every_continued_value(spark, monkeypatch, adaptive):
    rng = random.Random(9)
    monkeypatch.setattr(responses, "RANGE_PREFIX", 6)
    values = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)  # adaptive execution puts all values into one partition
    try:
        got = rows_of(responses.continued(asked_values(spark, values)), "value", "more")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert got == {(v, sum(w != v and w.startswith(v) for w in values)) for v in values}


def test_neighbours_that_go_on_are_found_over_partition_edges(spark):
    values = ["Revenue rose 4.", "Revenue rose 4. It fell later.", *(f"Revenue rose 4. Sales {i:03} fell." for i in range(300)), "Revenue rose 4.5% in Wales.", "Costs fell.", "Costs fell. Sales rose."]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or all values come into one partition
    try:
        got = rows_of(responses.continued(asked_values(spark, values)).where("more > 0"), "value", "more", "onward")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert got == {("Revenue rose 4.", 302, True), ("Costs fell.", 1, False)}


def test_sentences_of_others_tell_truncated_responses(spark):
    places = ["Wales", "Osaka", "Nairobi"]
    whole = [f"In {places[i % 3]}, sales rose by {i}% despite price changes. The unit opened {i + 2} sites" for i in range(12)]
    rows = [(f"w{i}", f"q{i}", f"{t} in May.", None) for i, t in enumerate(whole)] + [(f"x{i}", f"r{i}", f"{t}\nThe plan is open to all of them.", None) for i, t in enumerate(whole)]
    # the last sentence is one that others end with, or is one that all others continue, or the ground truth does
    rows += [("complete", "a", "The unit opened 30 sites", None), ("in a figure", "b", "In Leeds, sales rose by 4.", None), ("in the truth", "c", "Zor ceased its business.", "Zor ceased its business.5 percent of it was sold."), ("own truth", "d", "Zor ceased its business.", "Zor ceased its business.")]
    df = spark.createDataFrame(rows, "run string, q string, answer string, truth string").selectExpr("*", "true AS ok")
    got = {r.run: r.evidence for r in responses.judged_pairs(df, ["run"], "q", "answer", "ok", "truth").collect()}
    assert got == {"in the truth": "neighbour"} or got == {"in the truth": "neighbour", "in a figure": "sentence"}


def test_neighbours_and_limits_tell_truncated_responses(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    rows = [
        ("figure", "q1", "Revenue in Wales rose by a good 4."), ("whole", "q1", "Revenue in Wales rose by a good 4.5% in all. It fell later."),
        ("sentence", "q1", "Revenue in Wales rose by a good 4.5% in all."),
        ("company", "q2", "The supplier was Zor Inc."), ("longer", "q2", "The supplier was Zor Inc. of Osaka."),
        ("other question", "q3", "Revenue in Wales rose by a good 4."), ("alone", "q3", "The supplier was Zor Inc."),
    ]
    # many answers of 160 characters cut in a word, one of them cut behind an abbreviation
    rows += [(f"cut {i}", f"p{i}", " ".join(word() for _ in range(30))[:157] + "xyz") for i in range(12)]
    rows += [("at limit", "q4", (" ".join(word() for _ in range(30))[:151] + " Zor Inc.")[-160:])]
    df = spark.createDataFrame(rows, "run string, q string, answer string").selectExpr("*", "true AS ok")
    got = {r.run for r in responses.defective_pairs(df, ["run"], "q", "answer", "ok").collect()}
    assert got == {"figure", "company", "at limit", *(f"cut {i}" for i in range(12))}


# 10
def test_truncation(spark):
    rng = random.Random(5)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(6, 14))).capitalize() + ". "
    rows, cut = [], set()
    for i in range(400):
        text = "".join(sentence() for _ in range(rng.randint(2, 22)))
        if i % 2 and len(text) > 900:
            text = text[:900]
            cut.add(i)
        rows.append((i, text if i in cut else text.strip(), "a" if i % 2 else "b", None))
    whole = ["See\nhttps://x.example/1", "Text here.\nSIGNATURES", "- one entry\n- two entries", "Total\t1\t2\nCost\t3\t4", "", None, "   "]
    rows += [(1000 + i, t, "b", 5) for i, t in enumerate(whole)]
    rows += [(2000, "The committee approved the plan and the", "b", None), (2001, "The committee approved the plan and the ...", "b", None), (2002, "The company leases a site in Wales, and the media unit plans to op", None, 900)]
    df = spark.createDataFrame(rows + rows[-3:], "doc_id long, text string, source string, n long")
    got = truncation.truncation_evidence(df, "doc_id", "text", "source", "n")
    found = {r.id for r in got.where("truncated").collect()}
    surely = {i for i in cut if not dict((r[0], r[1]) for r in rows)[i].rstrip().endswith(".")}
    assert surely | {2000, 2001, 2002} <= found and not found - cut - {2000, 2001, 2002}
    assert truncation.truncation_by_source(got).where("source = 'a'").first().limits == [900]
    assert truncation.truncation_evidence(df.limit(0), "doc_id", "text", "source", "n").count() == 0


def test_every_limit_of_a_source_is_found():
    import numpy as np

    rng = np.random.default_rng(4)
    natural = np.round(np.exp(rng.normal(6.8, 0.6, 3000))).astype(int)
    # a lower limit of one feed, the lump of another limit that fills more than twelve stretches, a higher one
    lump = 2000 + rng.integers(0, 40, 600)
    x, n = np.unique(np.concatenate([natural, np.full(60, 1300), lump, np.full(90, 3000)]), return_counts=True)
    found = truncation.find_limits(x.astype(float), n.astype(float))
    covered = lambda v: any(limit - width < v <= limit for limit, width, _ in found)
    assert covered(1300) and covered(3000) and all(covered(v) for v in range(2000, 2040))
    # only the limits, and no stretch twice
    assert all(1300 <= limit <= 1316 or 2000 <= limit <= 2056 or limit == 3000 for limit, _, _ in found)
    x, n = np.unique(natural, return_counts=True)
    assert truncation.find_limits(x.astype(float), n.astype(float)) == []


# 3
def test_rules_separate_kinds_and_survive_wrong_labels():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((900, len(text_quality.STATISTICS)))
    kinds = np.where(x[:, 3] > 0.9, "junk", np.where(x[:, 5] > 0.7, "table", "prose")).astype(object)
    labels = kinds.copy()
    labels[rng.choice(900, 18, replace=False)] = "table"
    rules = text_quality.induce_rules(x[:600], list(labels[:600]))
    said = np.full(300, "prose", object)
    left = np.ones(300, bool)
    for kind, conditions in rules:
        hit = left & text_quality._covers(conditions, x[600:])
        said[hit], left = kind, left & ~hit
    assert (said == kinds[600:]).mean() > 0.95


def test_statistics(spark):
    df = spark.createDataFrame([("a", "The cat sat.\n\nOn 2 mats", "k"), ("a", "The cat sat.\n\nOn 2 mats", "k"), ("n", None, "k"), ("e", " ", "k")], "id string, text string, n_words string")
    got = {r.item_id: r for r in text_quality.text_statistics(df, "id", "text").collect()}
    assert (got["a"].n_words, got["a"].n_lines, got["a"].ended_line_share, got["a"].figure_share) == (6, 2, 0.5, 0.1667) and got["n"].n_words == 0 and got["e"].mean_word_length is None
    labels = spark.createDataFrame([], "chunk_id string, kind string")
    assert rows_of(text_quality.kinds_of_text(df, "id", "text", labels), "kind") == {("prose",)}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_kinds_on_held_out_labels(spark):
    d = DATA.replace("0.001", "0.01")
    chunk, label = spark.read.parquet(f"{d}/chunks.parquet"), spark.read.parquet(f"{d}/chunk_labels.parquet")
    train = label.where("pmod(xxhash64(chunk_id), 3) > 0")
    got = text_quality.kinds_of_text(chunk, "chunk_id", "text", train).join(label.withColumnRenamed("kind", "said"), F_eq("item_id", "chunk_id")).where("pmod(xxhash64(chunk_id), 3) = 0")
    rows = got.select("kind", "said").collect()
    assert sum(r.kind == r.said for r in rows) >= 0.8 * len(rows)


def F_eq(a, b):
    from pyspark.sql import functions as F

    return F.col(a) == F.col(b)


# 9
def test_mixture_meets_its_quotas(spark):
    rng = random.Random(8)
    docs = [(i, "word " * rng.randint(1, 40), rng.choice(["a", "a", "a", "b", "c", "x"])) for i in range(900)]
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s in docs] + [(docs[0][0], docs[0][1], docs[0][2], 1), (5000, None, "a", 1), (5001, "", "b", 1), (5002, "w", None, 1)], "doc_id long, text string, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.35, 3), ("c", 0.2, 1), ("none", 0.05, 4)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mixture(df, targets, "doc_id", "text", "source", shard_tokens=2000)
    rows, said = mixed.collect(), {r.source: r for r in report.collect()}
    assert max(collections.Counter((r.id, r.copy_no) for r in rows).values()) == 1
    used = collections.Counter(r.id for r in rows)
    caps = {"a": 1, "b": 3, "c": 1}
    assert all(used[r.id] <= caps[r.source] for r in rows)
    total = sum(r.available_tokens for r in said.values())
    for s, share in (("a", 0.4), ("b", 0.35), ("c", 0.2)):
        goal = min(share * total, said[s].available_tokens * caps[s])
        assert goal - 60 <= said[s].tokens <= goal
    assert said["none"].tokens == 0 and not said["none"].reached
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.position)
    assert len(shards) > 5 and all(sorted(p) == list(range(len(p))) for p in shards.values())
    again = rows_of(mixing.mixture(df.repartition(3), targets, "doc_id", "text", "source", shard_tokens=2000)[0], "id", "copy_no", "shard", "position")
    assert again == {(r.id, r.copy_no, r.shard, r.position) for r in rows}


def test_many_shards_hold_disjoint_samples(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DRIVER_NODES", 8)
    monkeypatch.setattr(mixing, "EDGE_PARTS", 4)
    rng = random.Random(21)
    docs = [(i, "word " * rng.randint(5, 15), "big" if i % 4 else "small", 1) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 5)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mixture(df, targets, "doc_id", "text", "source", shard_tokens=500)
    rows, said = mixed.collect(), {r.source: r for r in report.collect()}
    assert max(collections.Counter((r.id, r.copy_no) for r in rows).values()) == 1
    uses = collections.Counter(r.id for r in rows if r.source == "small")
    assert max(uses.values()) <= 5 and abs(said["small"].actual_share - 0.5) < 0.01 and said["small"].reached and said["big"].reached
    per_shard = collections.Counter()
    for r in rows:
        per_shard[r.shard] += r.tokens
    n = -(-sum(per_shard.values()) // 500)
    # every shard is filled about alike, and holds both sources
    assert len(per_shard) == n > 50 and max(per_shard.values()) < 1000 and min(per_shard.values()) > 200
    both = collections.defaultdict(set)
    for r in rows:
        both[r.shard].add(r.source)
    assert sum(len(v) == 2 for v in both.values()) > 0.95 * n
    counts = [x[3] for x in mixing.split_blocks([30, 7, 0], 9, 3)]
    assert sum(c[0] for c in counts) == 30 and sum(c[1] for c in counts) == 7 and all(3 <= c.sum() <= 5 for c in counts)
    with pytest.raises(ValueError, match="sources with a target"):
        monkeypatch.setattr(mixing, "MAX_TARGETS", 1)
        mixing.mixture(df, targets, "doc_id", "text", "source")


def test_two_texts_of_one_id_are_split_apart(spark):
    long = lambda w: " ".join(f"{w}{i}" for i in range(30))
    df = spark.createDataFrame([("a", long("x")), ("a", long("y")), ("a", long("x"))], "id string, text string")
    got = splitting.split_oversized(df, "id", "text", None, 20, 4).collect()
    assert len(got) == 4 and all(len({w[0] for w in r.piece_text.split()}) == 1 for r in got)
