"""Problem 4: one form for text that looks the same.

DuckDB runs inside the Arrow batches of each task. Only values that hold a
suspicious character pass through the chain: invisible characters are removed,
unusual spaces and compatibility forms replaced (``translate``), accents
composed (``nfc_normalize``), and letters of other scripts that imitate Latin
ones replaced in words that mix scripts or hold nothing but imitations.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import batches_of, map_arrow
from ledgerloom.operators.chunking import distinct_rows

# fixed values: letters of other scripts and the Latin letters they imitate
IMITATIONS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "H", "Ԍ": "G", "Ӏ": "I",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "α": "a", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "յ": "j",
}
# fixed values: characters that show nothing; the two joiners and the selectors of emoji are kept where a script or an emoji needs them
INVISIBLE = r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}"
CONTROLS = r"\x00-\x08\x0E-\x1F\x7F-\x84\x86-\x9F"
JOINERS = r"\x{200C}\x{200D}"
TAKES_JOINERS = r"\p{Arabic}\p{Syriac}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Mongolian}\p{So}\x{FDD3}\x{1F3FB}-\x{1F3FF}"
# the characters of emoji that are no other symbols; behind them and symbols a variation selector is kept (as U+FDD3, U+FDD4 while others are removed)
TAKES_SELECTORS = r"\p{So}\x{203C}\x{2049}\x{2194}-\x{21AA}\x{25FD}-\x{25FE}\x{2934}-\x{2935}\x{3030}\x{1F3FB}-\x{1F3FF}"
SPACES = r"\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}"
CJK = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}"
LIGATURES = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFB00, 0xFB07)}
COMPATIBILITY_RANGES = ((0xFF01, 0xFF5F), (0xFF61, 0xFFEF), (0x1D400, 0x1D800), (0x2011, 0x2012), (0x2460, 0x24EA), (0x2160, 0x2180), (0x210A, 0x2132), (0x3000, 0x3001))


def _compatible() -> tuple[dict[str, str], dict[str, str]]:
    """Characters of the compatibility ranges with a form of one character, and with a longer one, from the Unicode data."""
    pairs = {chr(c): unicodedata.normalize("NFKC", chr(c)) for a, b in COMPATIBILITY_RANGES for c in range(a, b)}
    keep = {"™", "℠", "№", "Ω"}
    # the full-width macron has a space in its normal form
    pairs |= {"\uffe3": "\u00af"}
    pairs = {a: b for a, b in pairs.items() if a != b and b.isprintable() and a not in keep}
    return {a: b for a, b in pairs.items() if len(b) == 1}, LIGATURES | {a: b for a, b in pairs.items() if len(b) > 1}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def normal_form_sql(x: str) -> str:
    """DuckDB SQL for the string expression ``x`` without its hidden, padded and compatibility characters; null stays null."""
    compatible, longer = _compatible()
    joiners, held = "\u200c\u200d", "\ufdd0\ufdd1"
    selectors, kept = "\ufe0f\ufe0e", "\ufdd3\ufdd4"
    marker = "\ufdd2"
    # a full-width mark or space that follows CJK text is proper there
    cjk_mark = r"([" + CJK + r"，。、；：？！（）「」『』【】《》])([\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF5E}\x{3000}])"
    step = rf"regexp_replace({x}, '([0-9#*])\x{{FE0F}}(\x{{20E3}})', '\1{kept[0]}\2', 'g')"
    for selector, other in zip(selectors, kept, strict=True):
        step = rf"regexp_replace({step}, '([{TAKES_SELECTORS}]){selector}', '\1{other}', 'g')"
    for joiner, other in zip(joiners, held, strict=True):
        step = rf"regexp_replace({step}, '([{TAKES_JOINERS}]){joiner}', '\1{other}', 'g')"
    step = rf"regexp_replace({step}, '[{INVISIBLE}{JOINERS}{CONTROLS}]+', '', 'g')"
    step = f"translate({step}, '{held}{kept}', '{joiners}{selectors}')"
    step = rf"regexp_replace({step}, '[\x{{0085}}\x{{2028}}\x{{2029}}]', chr(10), 'g')"
    step = rf"regexp_replace({step}, '[{SPACES}]', ' ', 'g')"
    for _ in range(2):  # neighbouring marks share a character of context
        step = rf"regexp_replace({step}, {_quoted(cjk_mark)}, '\1{marker}\2', 'g')"

    def rest(p: str) -> str:
        return f"translate({p}, {_quoted(''.join(compatible))}, {_quoted(''.join(compatible.values()))})"

    # the first character after a marker stays, all others are translated
    step = f"array_to_string(list_transform(string_split({step}, '{marker}'), lambda p, i: CASE WHEN i = 1 THEN {rest('p')} ELSE p[1] || {rest('p[2:]')} END), '')"
    spelled = reduce(lambda s, kv: f"replace({s}, '{kv[0]}', '{kv[1]}')", longer.items(), "s")
    # few values hold one of them
    step = f"list_transform([{step}], lambda s: CASE WHEN regexp_matches(s, '[{''.join(longer)}]') THEN {spelled} ELSE s END)[1]"
    return f"nfc_normalize({step})"


def _letters_sql(x: str) -> str:
    """Imitating letters replaced in the words of ``x`` that mix scripts or hold imitations only, away from true words of that script."""
    foreign, latin = "".join(IMITATIONS), "".join(IMITATIONS.values())
    other = r"\p{Cyrillic}\p{Greek}\p{Armenian}"
    words = f"regexp_extract_all({x}, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+')"
    replaced = f"translate(w, {_quoted(foreign)}, {_quoted(latin)})"

    def true_word(w: str) -> str:
        return f"coalesce(regexp_matches(translate({w}, {_quoted(foreign)}, ''), '[{other}]'), false)"

    mixed = rf"(regexp_matches(w, '\p{{Latin}}') AND NOT {true_word('w')})"
    alone = f"(NOT {true_word('w')} AND NOT {true_word('ws[i - 2]')} AND NOT {true_word('ws[i + 2]')})"
    word = f"CASE WHEN NOT regexp_matches(w, '[{other}]') THEN w WHEN {mixed} OR {alone} THEN {replaced} ELSE w END"
    return f"(SELECT array_to_string(list_transform(ws, lambda w, i: {word}), '') FROM (SELECT {words} AS ws))"


def _query() -> str:
    suspicious = "[" + INVISIBLE + JOINERS + CONTROLS + r"\x{0085}\x{2028}\x{2029}" + SPACES + r"\x{0300}-\x{036F}\x{0340}-\x{0345}\x{037E}\x{0387}\x{1F71}-\x{1FFD}\x{2126}-\x{212B}\x{FB00}-\x{FB06}\x{3000}\x{FF01}-\x{FFEE}\x{1D400}-\x{1D7FF}\x{2011}\x{2460}-\x{24E9}\x{2160}-\x{217F}\x{210A}-\x{2131}\p{M}\p{Cyrillic}\p{Greek}\p{Armenian}" + "]"
    other = r"[\p{Cyrillic}\p{Greek}\p{Armenian}]"
    letters = _letters_sql("f")
    return f"""
        WITH v AS (SELECT *, regexp_matches(v, '{suspicious}') AS s FROM batch),
        f AS (SELECT r, v, {normal_form_sql('v')} AS f FROM v WHERE s),
        g AS (SELECT r, v, CASE WHEN regexp_matches(f, '{other}') THEN {letters} ELSE f END AS f FROM f)
        SELECT b.r, coalesce(g.f, b.v) AS normal, coalesce(g.f <> g.v, false) AS changed FROM v b LEFT JOIN g USING (r) ORDER BY b.r"""


def normalize_lookalikes(df: DataFrame, id_col: str, value_cols: list[str], table_name: str, only_changed: bool = False) -> DataFrame:
    """Each value of ``value_cols`` in its one form.

    Replaced are full-width and other compatibility letters, ligatures, accents
    written as marks of their own, invisible characters, unusual spaces, line
    separators other than line feeds, and letters that imitate Latin ones.
    Curly quotes, dashes, bullets, composed accents, line breaks, words truly in
    another script and full-width marks inside CJK text stay.

    Null values stay null and unchanged, empty ones empty. Repeated rows give
    one row; rows without an id are kept with a null key. An empty table gives no
    rows. Texts of any length are handled whole. Other columns are ignored.

    Returns table_name, row_key, field_name, normal_text, changed.
    """
    sql = _query()
    columns = [f"v{i}" for i in range(len(value_cols))]
    source = df.select(F.col(id_col).cast("string").alias("k"), *(F.col(c).cast("string").alias(a) for c, a in zip(value_cols, columns, strict=True)))
    # repeated rows are taken once before their texts are touched
    source = distinct_rows(source, "k")

    def run(batches):
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1})
        try:
            for large in batches:
                for part in batches_of(large):
                    n = part.num_rows
                    keys = part.column(0)
                    for i, field in enumerate(value_cols):
                        batch = pa.table({"r": pa.array(range(n), pa.int64()), "v": part.column(i + 1)})  # noqa: F841 read by the SQL
                        out = con.sql(sql).to_arrow_table()
                        got = pa.table({"row_key": keys, "field_name": pa.array([field] * n, pa.string()), "normal_text": out.column("normal").cast(pa.string()), "changed": out.column("changed")})
                        if only_changed:
                            got = got.filter(got.column("changed"))
                        yield from got.to_batches()
        finally:
            con.close()

    out = map_arrow(source, run, "row_key string, field_name string, normal_text string, changed boolean")
    return out.select(F.lit(table_name).alias("table_name"), "row_key", "field_name", "normal_text", "changed")
