"""Problem 3: per-document text statistics, and rules on them that tell prose from lists, tables and junk.

The statistics are built-in expressions. An ordered rule list is induced from
labelled documents by incremental reduced-error pruning: for each kind rules
are grown on two thirds of the labels by information gain, pruned on the rest
while that does not raise their error, and kept until a rule would be wrong
more often than right. The learned thresholds become one CASE expression, so
the documents are judged without leaving the engine.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import record_key

# fixed values: words that make up a third of English prose
COMMON_WORDS = "the of and to in a that is was for on with by from our we as at or may be which this have an not are its if it were their has could in against under"
SYMBOLS = "|^~!;{}<>[]=_+*/\\�#@%&:"
STATISTICS = ("n_chars", "n_words", "n_lines", "mean_word_length", "words_per_line", "digit_share", "symbol_share", "title_share", "ended_line_share", "common_word_share", "distinct_word_share", "figure_share", "marked_line_share", "long_line_share", "n_short_lines", "longest_word")
LABEL_LIMIT = 20_000


def text_statistics(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Statistics of each text.

    Null, empty and blank texts have counts of 0 and shares of null. Repeated
    rows of an id with one text (and equal ``keep``) give one row; rows without
    an id keep a null id. Whole texts are read, whatever their length.

    Returns item_id, the columns of ``keep``, then: n_chars, n_words, n_lines
    (non-blank), mean_word_length, words_per_line, digit_share, symbol_share of the
    characters that aren't white space, title_share (words with a capital before small letters), ended_line_share
    (lines that end in a sentence mark), common_word_share, distinct_word_share,
    figure_share (words that are figures), marked_line_share (lines that begin
    with an entry mark), long_line_share (characters in lines of 100 or more),
    n_short_lines (non-blank, under 100 characters), longest_word.
    """
    text = F.coalesce(F.col("t"), F.lit(""))
    base = df.select(record_key(id_col, text_col).alias("__k"), F.col(id_col).cast("string").alias("item_id"), *keep, F.col(text_col).cast("string").alias("t"))
    base = base.withColumn("w", F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")).withColumn("l", F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    n, lines = F.size("w"), F.size("l")
    base = base.withColumn("c", F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    share = lambda x, of, digits=4: F.when(of > 0, F.round(x / of, digits))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    c = F.col("c")
    common = "|".join(dict.fromkeys(COMMON_WORDS.split()))
    out = base.select(
        "__k", "item_id", *keep,
        F.length(text).alias("n_chars"), n.alias("n_words"), lines.alias("n_lines"),
        share(c, n).alias("mean_word_length"), share(n, lines).alias("words_per_line"),
        share(without("0123456789"), c).alias("digit_share"), share(without(SYMBOLS), c).alias("symbol_share"),
        share(count(r"(?<![A-Za-z])[A-Z][a-z]"), n).alias("title_share"),
        share(count(r"""(?m)[.!?。！？]["'”’»)]{0,2}[ \t]*$"""), lines).alias("ended_line_share"),
        share(count(rf"(?i)(?<![a-z])(?:{common})(?![a-z])"), n).alias("common_word_share"),
        share(F.size(F.array_distinct("w")), n).alias("distinct_word_share"),
        share(count(r"(?<!\S)[(]?[$€£]?[0-9][0-9.,]*[)]?(?!\S)"), n).alias("figure_share"),
        share(count(r"(?m)^[ \t]*(?:[•*·–-]|\(?[0-9A-Za-z]{1,3}[.)])[ \t]"), lines).alias("marked_line_share"),
        share(F.aggregate("l", F.lit(0), lambda a, x: a + F.when(F.length(x) >= 100, F.length(x)).otherwise(0)), F.length(text)).alias("long_line_share"),
        F.aggregate("l", F.lit(0), lambda a, x: a + F.when(F.length(x) < 100, 1).otherwise(0)).alias("n_short_lines"),
        F.coalesce(F.array_max(F.transform("w", F.length)), F.lit(0)).alias("longest_word"),
    )
    return out.dropDuplicates(["__k", *keep]).drop("__k")


def _gain(p0: int, n0: int, p1: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Information gained on the ``p1`` right cases a condition keeps of ``p0`` right and ``n0`` wrong ones."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p1 > 0, p1 * (np.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))), -1.0)


def _covers(rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, low, t in rule:
        hit &= (x[:, f] <= t) if low else (x[:, f] > t)
    return hit


def _grow(x: np.ndarray, y: np.ndarray, most: int = 6) -> list[tuple[int, bool, float]]:
    rule, hit = [], np.ones(len(x), bool)
    while len(rule) < most and (~y[hit]).any():
        xs, ys = x[hit], y[hit]
        p0, n0, best = int(ys.sum()), int((~ys).sum()), (1e-9, None)
        if not p0:
            break
        for f in range(x.shape[1]):
            order = np.argsort(xs[:, f], kind="stable")
            v, p = xs[order, f], np.cumsum(ys[order])
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue
            right = p[cuts]
            wrong = cuts + 1 - right
            for low, gains in ((True, _gain(p0, n0, right, wrong)), (False, _gain(p0, n0, p0 - right, n0 - wrong))):
                i = int(gains.argmax())
                if gains[i] > best[0]:
                    best = (float(gains[i]), (f, low, float(round((v[cuts[i]] + v[cuts[i] + 1]) / 2, 6))))
        if best[1] is None:
            break
        rule.append(best[1])
        hit = _covers(rule, x)
    return rule


def induce_rules(x: np.ndarray, labels: list[str], default: str = "prose", seed: int = 5, max_rules: int = 12) -> list[tuple[str, list[tuple[int, bool, float]]]]:
    """Ordered (kind, conditions) by incremental reduced-error pruning; rarer kinds first, ``default`` for the rest. A condition is (column, at most, threshold)."""
    rng = np.random.default_rng(seed)
    labels_ = np.array(labels, dtype=object)
    kinds = sorted((k for k in set(labels) if k != default), key=lambda k: (labels.count(k), k))
    rules, rest = [], np.ones(len(x), bool)
    for kind in kinds:
        for _ in range(max_rules):
            idx = np.flatnonzero(rest)
            y = labels_[idx] == kind
            if y.sum() < 2:
                break
            # every third of either side, in random order, is kept for pruning
            grow = np.zeros(len(idx), bool)
            for side in (y, ~y):
                own = rng.permutation(np.flatnonzero(side))
                grow[own[: max(1, math.ceil(len(own) * 2 / 3))]] = True
            rule = _grow(x[idx[grow]], y[grow])
            xp, yp = x[idx[~grow]], y[~grow]

            def value(r, xp=xp, yp=yp):
                hit = _covers(r, xp)
                p, n = int((hit & yp).sum()), int((hit & ~yp).sum())
                return (p - n) / (p + n) if p + n else -1.0

            if len(yp):
                while len(rule) > 1:
                    options = [rule[:i] for i in range(1, len(rule))]
                    best = max(options, key=lambda r: (value(r), -len(r)))
                    if value(best) < value(rule):
                        break
                    rule = best
            hit = _covers(rule, x) & rest
            right = int((labels_[hit] == kind).sum())
            if not rule or not hit.any() or 2 * right <= hit.sum() or (len(yp) and value(rule) <= 0):
                break
            # a rule whose cases are no more than wrong labels make is none
            if right < max(2, 0.01 * (labels_ == kind).sum()):
                break
            rules.append((kind, rule))
            rest &= ~hit
    return rules


def apply_rules(rules, x: np.ndarray, default: str = "prose") -> np.ndarray:
    said, left = np.full(len(x), default, object), np.ones(len(x), bool)
    for kind, conditions in rules:
        hit = left & _covers(conditions, x)
        said[hit] = kind
        left &= ~hit
    return said


def best_rules(x: np.ndarray, labels: list[str], splits: int = 12, condition_cost: float = 0.5):
    """The rule list with the fewest wrong labels, plus ``condition_cost`` a condition, among those of ``splits`` random divisions into growing and pruning labels."""
    lists = [induce_rules(x, labels, seed=seed) for seed in range(splits)]
    wrong = lambda r: (apply_rules(r, x) != np.array(labels, object)).sum() + condition_cost * sum(len(c) for _, c in r)
    return min(lists, key=wrong) if len(x) else []


def rules_case(rules, names: tuple[str, ...] = STATISTICS, default: str = "prose") -> str:
    """The rule list as one SQL CASE expression; texts without words are ``prose``."""
    whens = [f"WHEN {' AND '.join(f'{names[f]} {"<=" if low else ">"} {t!r}D' for f, low, t in conditions)} THEN '{kind}'" for kind, conditions in rules]
    return f"CASE WHEN n_words = 0 THEN '{default}' {' '.join(whens)} ELSE '{default}' END"


def learn_kinds(statistics: DataFrame, labels: DataFrame, id_col: str, kind_col: str, label_limit: int = LABEL_LIMIT) -> str:
    """The CASE expression learned from ``labels``; of more than ``label_limit`` labelled ids, those of the least hashes are used."""
    wanted = labels.where(F.col(kind_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), F.col(kind_col).alias("kind")).distinct().orderBy(F.xxhash64("item_id"), "kind").limit(label_limit)
    rows = statistics.join(F.broadcast(wanted), "item_id").where("n_words > 0").orderBy("item_id", "kind").select("kind", *STATISTICS).collect()
    x = np.array([[float(v or 0) for v in r[1:]] for r in rows], float).reshape(len(rows), len(STATISTICS))
    return rules_case(best_rules(x, [r.kind for r in rows]))


def kinds_of_text(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str = "chunk_id", kind_col: str = "kind", keep: tuple[str, ...] = ()) -> DataFrame:
    """``text_statistics`` with kind, by rules learned from ``labels`` (of ids of ``df``).

    Without labels every text is ``prose``. The labels used are at most
    ``LABEL_LIMIT``, so their broadcast is bounded.
    """
    statistics = text_statistics(df, id_col, text_col, keep)
    labelled = df.where(F.col(text_col).isNotNull()).join(F.broadcast(labels.select(F.col(label_id).alias("__l")).distinct().orderBy(F.xxhash64("__l")).limit(LABEL_LIMIT)), F.col(id_col) == F.col("__l"), "left_semi")
    case = learn_kinds(text_statistics(labelled, id_col, text_col), labels, label_id, kind_col)
    return statistics.withColumn("kind", F.expr(case))
