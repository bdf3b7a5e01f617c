"""The language of short texts, by letter trigrams learned from texts that say their language.

A naive Bayes model over hashed trigrams of letters, fitted on a bounded sample
of labelled texts, whose labels may be wrong here and there: texts that the
first fit gives to another language than their label take no part in the second.
Texts of different scripts are told apart by their letters alone.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.lookalike import IMITATIONS

#: Labelled texts of a language that are used, by the order of their hash, and languages at most, the most frequent ones.
SAMPLE_TEXTS, SAMPLE_LANGUAGES = 400, 40
#: Slots of hashed trigrams; 64 k languages x 4 bytes each are broadcast.
SLOTS = 1 << 16
#: Log-odds by which a text must lean to another language than the question's.
MARGIN = 6.0
#: And by which each of its trigrams must, in the mean.
LEAN = 0.4
#: Words of letters without which a text in a script with spaces tells nothing: a bare figure has its unit or month.
LEAST_WORDS = 4
_FOLDED = {ord(a): b for a, b in IMITATIONS.items()}
_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])
_SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "HEBREW", "ARABIC", "DEVANAGARI", "THAI", "HANGUL", "HIRAGANA", "KATAKANA", "CJK")
_SCRIPT_OF: dict[str, str] = {}


def _script(c: str) -> str:
    if c not in _SCRIPT_OF:
        name = unicodedata.name(c, "").split(" ")[0].split("-")[0]
        _SCRIPT_OF[c] = "kana or Han" if name in ("HIRAGANA", "KATAKANA", "CJK") else name if name in _SCRIPTS else "other"
    return _SCRIPT_OF[c]


def plain(text: str) -> str:
    """``text`` in lower case and one form: compatibility forms, invisible characters and letters that imitate Latin ones inside Latin words are replaced."""
    t = unicodedata.normalize("NFKC", text)
    if t.isascii():
        return t.lower()
    t = "".join(c for c in t if unicodedata.category(c) != "Cf")
    words = t.split(" ")
    latin = sum(c.isascii() and c.isalpha() for c in t)
    for i, w in enumerate(words):
        folded = w.translate(_FOLDED)
        # a word that mixes scripts, or one of imitations alone in a Latin text
        if folded != w and (any(c.isascii() and c.isalpha() for c in w) or folded.isascii() and 2 * latin > len(t.replace(" ", ""))):
            words[i] = folded
    return " ".join(words).lower()


def script(text: str) -> str | None:
    """The script of most letters of a text of five letters or more."""
    counts: dict[str, int] = {}
    if text.isascii():
        return "LATIN" if sum(map(str.isalpha, text)) >= 5 else None
    for c in text:
        if c.isalpha():
            s = _script(c)
            # a syllable or character of these says as much as two letters
            counts[s] = counts.get(s, 0) + (2 if s in ("kana or Han", "HANGUL") else 1)
    if sum(counts.values()) < 5:
        return None
    best = max(counts, key=counts.get)
    return best if counts[best] * 2 > sum(counts.values()) else None


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slots of the letter trigrams of all texts, where each text's begin and the end)."""
    codes = [np.frombuffer((" " + t + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    ends = np.cumsum([0, *map(len, codes)])
    c = np.concatenate(codes) if codes else np.empty(0, np.uint32)
    c = np.where((c < 0x10000) & _LETTER[np.minimum(c, 0xFFFF)], c, 32).astype(np.uint64)
    if len(c) < 3:
        return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    x = c[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ c[2:] * np.uint64(0x165667B19E3779F9)
    slot = ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)
    # trigrams lie within a text and around a letter
    owner = np.searchsorted(ends, np.arange(len(slot)), "right") - 1
    keep = (c[1:-1] != 32) & (np.arange(len(slot)) + 2 < ends[owner + 1])
    begins = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(texts)))])
    return slot[keep], begins


class Languages:
    """Log-probabilities of trigram slots by language."""

    def __init__(self, names: list[str], weights: np.ndarray):
        self.names, self.weights = names, weights

    @classmethod
    def fit(cls, texts: list[str], labels: list[str]) -> Languages | None:
        names = sorted(set(labels))
        if len(names) < 2:
            return None
        slots, begins = trigrams([plain(t) for t in texts])
        of = np.array([names.index(x) for x in labels])
        used = np.ones(len(texts), bool)
        model = None
        for _ in range(2):
            counts = np.zeros((len(names), SLOTS))
            for i in np.flatnonzero(used):
                counts[of[i]] += np.bincount(slots[begins[i] : begins[i + 1]], minlength=SLOTS)
            # every language holds every slot a little, in one measure, so that unknown trigrams say nothing
            total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
            model = cls(names, np.log((counts / total + 2e-6) / (1 + 2e-6 * SLOTS)).astype(np.float32))
            scores = model.scores([plain(t) for t in texts])
            used = np.array([begins[i + 1] > begins[i] and scores[i].argmax() == of[i] for i in range(len(texts))])
        return model

    def scores(self, plain_texts: list[str]) -> np.ndarray:
        slots, begins = trigrams(plain_texts)
        out = np.zeros((len(plain_texts), len(self.names)))
        some = np.flatnonzero(begins[1:] > begins[:-1])
        if len(some):
            # a trigram's say is bounded, as names hold odd ones
            w = self.weights[:, slots]
            w = np.maximum(w, w.max(axis=0) - 4.0)
            out[some] = np.add.reduceat(w, begins[:-1][some], axis=1).T
        return out


def sample(df: DataFrame, text_col: str, label_col: str) -> Languages | None:
    """A model from at most ``SAMPLE_TEXTS`` labelled texts of each of ``SAMPLE_LANGUAGES`` labels; labels count in lower case up to a hyphen. None if fewer than two languages are labelled."""
    label = F.substring_index(F.lower(F.trim(F.col(label_col).cast("string"))), "-", 1)
    rows = df.select(F.col(text_col).cast("string").alias("t"), label.alias("l")).where("t IS NOT NULL AND l <> '' AND length(t) >= 20")
    named = [r.l for r in rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(SAMPLE_LANGUAGES).collect()]
    order = Window.partitionBy("l").orderBy(F.xxhash64("t"), "t")
    taken = rows.where(F.col("l").isin(named)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_TEXTS).select("t", "l").collect()
    return Languages.fit([r.t for r in taken], [r.l for r in taken]) if taken else None


def differs(model: Languages | None, questions: list[str], answers: list[str]) -> list[bool]:
    """For each pair whether the answer is surely in another language than the question; short and mixed texts tell nothing."""
    q, a = [plain(x) for x in questions], [plain(x) for x in answers]
    scripts = [(script(x), script(y)) for x, y in zip(q, a, strict=True)]
    out = [x is not None and y is not None and x != y for x, y in scripts]
    if model is None or not q:
        return out
    sq, sa = model.scores(q), model.scores(a)
    counts = np.diff(trigrams(a)[1])
    for i, (x, y) in enumerate(scripts):
        if not out[i] and x is not None and x == y and (x in ("kana or Han", "THAI") or sum(w.isalpha() for w in a[i].split()) >= LEAST_WORDS):
            asked = int(sq[i].argmax())
            lead = np.sort(sq[i])[-1] - np.sort(sq[i])[-2]
            out[i] = lead >= MARGIN / 2 and bool(sa[i].max() - sa[i][asked] >= max(MARGIN, LEAN * counts[i]))
    return out
