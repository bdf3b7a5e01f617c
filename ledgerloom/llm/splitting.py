"""Problem 2: cutting oversized texts at topic boundaries, with overlap.

Lexical-cohesion segmentation. The words on both sides of a possible boundary
are compared as blocks; where the similarity of the blocks has a valley, the
topic changes. Within the window of positions that keep a piece under the
limit, the deepest valley is chosen; the kind of boundary (heading, blank
line, line, sentence) adds to its depth, so that flat stretches are cut at the
most natural place. The next piece starts ``overlap`` words before the cut.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_arrow, record_key
from ledgerloom.operators.chunking import distinct_rows

#: Added to a valley's depth (0 to 2) for what stands at the boundary.
BOUNDARY_BONUS = {"heading": 0.8, "blank_line": 0.5, "line": 0.3, "sentence": 0.1, "word": -1.0}
PIECES = "item_id string, piece_no int, start_word int, end_word int, n_words int, boundary string, section_heading string, piece_text string"
_WORD = re.compile(r"\S+")
_SENTENCE_END = re.compile(r"[.!?。！？…][)\]\"'”’»]*$")
_CORE = re.compile(r"\w+")
_HEADING = re.compile(r"(?i)^(?:#+\s|item\s+\d|part\s+[ivx]+\b|note\s+\d)")


def _boundary(gap: str, before: str, next_line: str, heading: str) -> str:
    if "\n" in gap:
        line = " ".join(next_line.split()).casefold()
        if line and (line == heading or _HEADING.match(line)):
            return "heading"
        return "blank_line" if gap.count("\n") > 1 else "line"
    return "sentence" if _SENTENCE_END.search(before) else "word"


def _similarity(a: Counter, b: Counter) -> float:
    if not a or not b:
        return 0.0
    small, large = (a, b) if len(a) < len(b) else (b, a)
    dot = sum(n * large[t] for t, n in small.items() if t in large)
    return dot / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5


def split_text(text: str, heading: str | None, limit: int, overlap: int, block: int = 40) -> list[tuple[int, int, str, str]]:
    """(first word, word after the last, boundary at its end, text) of each piece; one piece if the text fits."""
    spans = [m.span() for m in _WORD.finditer(text)]
    n = len(spans)
    if n <= limit:
        return [(0, n, "end", text)] if n else []
    head = " ".join((heading or "").split()).casefold()
    cores = [t[0] if (t := _CORE.findall(text[a:b].lower())) else "" for a, b in spans]
    # words of one to three letters say little about the topic; figures count as one word
    cores = ["0" if c[:1].isdigit() else c if len(c) > 3 else "" for c in cores]

    def block_of(a: int, b: int) -> Counter:
        c = Counter(cores[max(a, 0) : min(b, n)])
        del c[""]
        return c

    def kind_at(cut: int) -> str:
        (a, b), (c, _) = spans[cut - 1], spans[cut]
        gap = text[b:c]
        end = text.find("\n", c)
        line = text[c : end if end >= 0 else len(text)] if "\n" in gap else ""
        return _boundary(gap, text[max(a, b - 12) : b], line, head)

    pieces, start = [], 0
    while n - start > limit:
        last = start + limit
        # at least half the room is used, and each piece moves on by more than the overlap
        first = start + max(limit // 2, overlap + 1)
        gaps = [(cut, kind) for cut in range(first, last + 1) if (kind := kind_at(cut)) != "word"]
        if not gaps:
            gaps = [(last, "word")]
        curve = [_similarity(block_of(cut - block, cut), block_of(cut, cut + block)) for cut, _ in gaps]
        best, chosen = None, None
        left_peak, peaks = 0.0, [0.0] * len(curve)
        for i in range(len(curve) - 1, -1, -1):
            peaks[i] = max(curve[i], peaks[i + 1] if i + 1 < len(curve) else 0.0)
        for i, (cut, kind) in enumerate(gaps):
            left_peak = max(left_peak, curve[i])
            depth = (left_peak - curve[i]) + (peaks[i] - curve[i]) + BOUNDARY_BONUS[kind]
            if best is None or depth >= best:
                best, chosen = depth, (cut, kind)
        cut, kind = chosen
        pieces.append((start, cut, kind, text[spans[start][0] : spans[cut - 1][1]]))
        start = cut - overlap
    pieces.append((start, n, "end", text[spans[start][0] : spans[n - 1][1]]))
    return pieces


def split_oversized(df: DataFrame, id_col: str, text_col: str, heading_col: str | None = None, limit: int = 400, overlap: int = 75) -> DataFrame:
    """The pieces of every item whose text has more than ``limit`` words.

    A word is a maximal run of characters other than white space. Pieces hold at
    most ``limit`` words and share exactly ``overlap`` words with the one
    before; together they hold the whole text. Items that fit, empty and null
    texts give no rows. Repeated rows of an id with one text give their pieces
    once, two texts of one id each its own; rows without an id are told apart by
    their text. A word longer than
    any bound stays whole. Stored word counts are not read.

    Returns item_id, piece_no from 0, start_word, end_word (exclusive), n_words,
    boundary, section_heading, piece_text.
    """
    if limit < 2 or not 0 <= overlap < limit - 1:
        raise ValueError("limit must be at least 2 and overlap below limit - 1")
    heading = F.col(heading_col).cast("string") if heading_col else F.lit(None).cast("string")
    # words are parted by at least one character, so shorter texts cannot exceed the limit: they never reach Python
    long = df.where(F.length(text_col) > 2 * limit).select(record_key(id_col, text_col).alias("k"), F.col(id_col).cast("string").alias("i"), heading.alias("h"), F.col(text_col).cast("string").alias("t"))
    long = distinct_rows(long, "k")

    def cut(batches):
        for batch in batches:
            out = [[] for _ in range(8)]
            for item, head, text in zip(*(batch.column(i).to_pylist() for i in range(1, 4)), strict=True):
                pieces = split_text(text, head, limit, overlap)
                if len(pieces) > 1:
                    for no, (a, b, kind, piece) in enumerate(pieces):
                        for column, value in zip(out, (item, no, a, b, b - a, kind, head, piece), strict=True):
                            column.append(value)
            types = [pa.string(), *[pa.int32()] * 4, pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return map_arrow(long, cut, PIECES)
