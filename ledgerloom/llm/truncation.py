"""Problem 10: texts that were cut off, and how often each source cuts.

Lengths of texts, in characters and in bytes, with and without a mark or space
behind the cut, are counted per source. Where a length, or the stretch of a
word before it, holds more texts than its surroundings, it is a candidate
limit: a log-normal distribution of lengths, right-censored there, is fitted by
maximum likelihood, and the share of the texts at the limit that the
distribution does not expect there is the posterior that such a text was
censored.

What cut texts end like is learned from it: texts are a mixture of cut and whole
ones, each with its own shares of endings, of declared lengths beyond the text
and of marks behind it. Expectation maximization starts from the censoring
posteriors, which are the prior of the texts at a limit; others have that of
their source. The shares, and the sources' priors, follow the data, held by a
prior worth a few texts; the log-odds of a text are those of the mixture.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut_lineage

#: Widths of the stretch before a limit: cut at the limit itself, or back to the end of a word.
WIDTHS = (1, 16)
#: Texts at a limit are told from others with at least this posterior.
LEAST_POSTERIOR = 0.5
# fixed values: what is put behind a cut
CUT_MARK = r"(?iu)(?:\s{0,3}(?:\.{3,}|…|\[(?:\.{3}|…|more|truncated|continued)\]|\((?:\.{3}|…|more|truncated|continued)\)|\b(?:read|see|show) more|\bcontinue reading)){1,3}$"
#: White space and stray halves of characters; taken off with rtrim, as a pattern would try every run of them.
BLANKS = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff\ufffd"
#: Characters that hold how a text ends, and any marks behind it but long runs of points.
TAIL, MARKS = 80, 100
TERMINAL = r"""(?u)[.!?。！？｡।؟][)\]"'”’»」』]*$"""
# fixed values: words no sentence of their language ends with
OPEN_WORDS = (
    "a an the of in on at by for from with to and or but nor as than that which who whose into onto over under between because if while our its their his her my your this these those is are was were be been has have had may might can could will would shall should not no about against through during"
    " le la les un une des du de et ou à au aux dans par pour avec sur en que qui sa son ses leur ce cette est sont a été"
    " der die das den dem des ein eine einen einem einer und oder mit von vom zu zum zur im in auf für bei nach über durch aus ist sind wird wurde wegen"
    " el los las una del y o por para con sobre su sus se es son fue en al"
    " os as um uma da do das dos e ou por para com sobre seu sua na no nas nos ao"
    " и в во на с со по к из за о об от для при не что как его её их"
)
LIST_ENTRY = r"(?u)^\s*(?:[•*·▪◦‣–-]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)]|\([ivxl]{1,5}\))\s+\S"
TABLE_ROW = r"(?u)\t|\||\S {3,}\S|(?:\s(?:\(?[$€£]?[0-9][0-9.,]*[0-9]\)?|[—–-])){2,}$"
REFERENCE = r"(?iu)^\s*(?:https?://\S+|www\.\S+|[^:]{1,40}:\s*\S.{0,60}|(?:exhibit|page|note|item|part|form|appendix|schedule|annex)\s+[0-9ivx]+[0-9.]*[a-z]?|[^\s.]+(?:\s[^\s.]+){0,2}\s(?=\S*[A-Z])(?=\S*\d)[A-Z0-9/-]{4,}|\S+@\S+)$"
TURN = r"(?iu)^\s*(?:q|a|question|answer)\s*:"
ABBREVIATED = r"(?u)(?:\b(?:Inc|Corp|Co|Ltd|No|vs|approx|Mr|Ms|Dr|St|U\.S|N\.V|S\.A)\.|[$€£]\s?[0-9]{1,3}\.)$"


def _fit(lengths: np.ndarray, counts: np.ndarray, censored: float, limit: float) -> tuple[float, float]:
    """mu and sigma of a log-normal of the seen lengths and ``censored`` values known only to reach ``limit``; by expectation maximization."""
    x, n = np.log(lengths), counts.sum()
    m1, m2 = float((x * counts).sum()), float((x * x * counts).sum())
    mu = m1 / n
    sigma = max(math.sqrt(max(m2 / n - mu * mu, 0)), 0.05)
    cut = math.log(limit)
    for _ in range(60 if censored else 0):
        z = (cut - mu) / sigma
        tail = max(0.5 * math.erfc(z / math.sqrt(2)), 1e-12)
        hazard = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
        mean = mu + sigma * hazard
        square = mu * mu + sigma * sigma + sigma * (cut + mu) * hazard
        total = n + censored
        mu = (m1 + censored * mean) / total
        sigma = max(math.sqrt(max((m2 + censored * square) / total - mu * mu, 0)), 0.05)
    return mu, sigma


def _between(mu: float, sigma: float, a: float, b: float) -> float:
    cdf = lambda v: 0.5 * math.erfc(-(math.log(max(v, 0.5)) - mu) / sigma / math.sqrt(2))
    return max(cdf(b) - cdf(a), 0.0)


def find_limits(lengths: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, float]]:
    """(limit, width, posterior) of the limits of one source in one unit; lengths ascend.

    Every stretch that reaches beyond the median and holds enough texts is tried,
    the one furthest above its surroundings first. What a limit explains is taken
    out before the others are judged, so stretches that overlap it count for
    their own texts only. Texts above a limit, from another feed of the source or
    under a higher limit, are no objection to it.
    """
    total = counts.sum()
    cum = np.concatenate([[0], np.cumsum(counts)])
    median = lengths[np.searchsorted(cum[1:], total / 2)]
    # of so many stretches none should stand out so far by chance
    doubt = math.log(1000 * len(WIDTHS) * len(lengths))
    free, found, tried = np.ones(len(lengths), bool), [], []
    for width in WIDTHS:
        span = 12 * width + 60
        low = np.searchsorted(lengths, lengths - width, "right")
        near = np.searchsorted(lengths, lengths - span, "right"), np.searchsorted(lengths, lengths + 60, "right")
        # a limit that cuts most texts is their median; what lies below it is the bulk of the lengths
        tried.append((width, span, low, *near, lengths >= median))
    while True:
        left, taken = (np.concatenate([[0], np.cumsum(x)]) for x in (counts * free, ~free))
        best = None
        for width, span, low, first, last, enough in tried:
            at = left[1:] - left[low]
            places = np.maximum(width - (taken[1:] - taken[low]), 1)
            # what stands around the stretch counts as well as the fitted curve: a corpus may have lumps of its own
            around = (left[last] - left[first] - at) * places / span
            least = np.maximum(around, places / span)
            score = np.where(enough & (at > 1) & (around <= LEAST_POSTERIOR * at), at * np.log(np.maximum(at, 1) / least) - at + least, 0.0)
            i = int(np.argmax(score))
            if score[i] > doubt and (best is None or score[i] > best[0]):
                best = score[i], i, width, low, enough
        if best is None:
            return found
        i, narrow = best[1], best[2]
        best[4][i] = False
        explained = free.copy()
        # texts cut back to the end of a word or character before an exact limit belong to it
        for width, span, low, first, last, _ in tried:
            if width < narrow:
                continue
            at, places = left[i + 1] - left[low[i]], max(width - (taken[i + 1] - taken[low[i]]), 1)
            around = (left[last[i]] - left[first[i]] - at) * places / span
            seen = free.copy()
            seen[low[i] : i + 1] = False
            limit = float(lengths[i])
            # where nearly all texts stand at the limit no other length tells the distribution, and what stands around must do
            natural = around
            if counts[seen].sum() >= 3:
                mu, sigma = _fit(lengths[seen], counts[seen], float(at), limit - width + 1)
                natural = max(total * _between(mu, sigma, limit - width, limit) * places / width, around)
            posterior, expected = float(1 - natural / at), max(natural, places / span)
            if posterior >= LEAST_POSTERIOR and at * math.log(at / expected) - at + expected > doubt:
                own = low[i] + np.flatnonzero(free[low[i] : i + 1])
                found.append((int(lengths[own[-1]]), int(lengths[own[-1]] - lengths[own[0]]) + 1, round(min(posterior, 0.995), 4)))
                explained[own] = False
            elif width == narrow:
                break
        free = explained


def censoring_limits(features: DataFrame) -> DataFrame:
    """source, unit, limit, width, posterior from source and an array of lengths by unit; one small table of counts per source reaches a task."""
    counted = features.select("source", F.posexplode("lengths").alias("unit", "length")).where("length > 0").groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))

    def limits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("length")
        rows = find_limits(pdf["length"].to_numpy(np.float64), pdf["n"].to_numpy(np.float64))
        source, unit = pdf["source"].iloc[0], int(pdf["unit"].iloc[0])
        return pd.DataFrame([(source, unit, *r) for r in rows], columns=["source", "unit", "limit", "width", "posterior"])

    return counted.groupBy("source", "unit").applyInPandas(limits, "source string, unit int, limit int, width int, posterior double")


def _ending(core: Column, line: Column, before: Column, breaks: Column) -> Column:
    """What the last line is, read as if the text were whole; ``before`` is the line before it, ``breaks`` the number of line ends."""
    words = F.size(F.split(F.trim(line), r"(?U)\s+"))
    core = F.substring(core, -TAIL, TAIL)
    last_word = F.lower(F.regexp_extract(core, r"(?U)(\w+)$", 1))
    open_words = sorted(set(OPEN_WORDS.split()))
    # after a short line that ends in no sentence mark, a line without sentences is another entry of a list
    entries = (breaks >= 2) & (F.length(before) > 0) & (F.length(before) < 90) & ~F.substring(before, -TAIL, TAIL).rlike(TERMINAL) & (F.length(line) < 90) & ~line.rlike(r"(?u)\p{Ll}\.\s+\p{Lu}")
    small = F.regexp_count(line, F.lit(r"(?<!\S)\p{Ll}"))
    said = F.trim(F.regexp_replace(line, TURN, ""))
    cjk = line.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")
    return (
        F.when(core.rlike(ABBREVIATED), "abbreviation")
        .when(core.rlike(TERMINAL), "terminal")
        .when(core.rlike(r"(?u)[:;]$"), "colon")
        .when(last_word.isin(open_words) & ~line.rlike(r"\t|\||://"), "open word")
        .when(line.rlike(TURN) & ~(said.rlike(r"^\S*\d\S*(?:\s\S+){0,2}$|^\S+$") & line.rlike(r"(?i)^\s*a")), "fragment")
        .when((words <= 9) & line.rlike(REFERENCE), "reference")
        .when(line.rlike(LIST_ENTRY), "list entry")
        .when(core.rlike(r"[,$€£(“«-]$"), "open mark")
        .when(line.rlike(TABLE_ROW) & ~line.rlike(r"(?u)\p{Ll}\.\s+\p{Lu}"), "table row")
        .when(F.coalesce(entries, F.lit(False)), "list entry")
        .when((words > 8) | (F.length(line) > 70) | (cjk & (F.length(line) > 12)) | ((words >= 5) & (small >= 3)), "fragment")
        .otherwise("short line")
    )


# fixed values: shares of endings among cut texts and whole ones before any text is seen; texts that end like these are whole whatever else is known: they weren't cut within a sentence
CUT_SHARES = {"fragment": 0.72, "open word": 0.16, "open mark": 0.05, "abbreviation": 0.02, "short line": 0.02, "list entry": 0.01, "table row": 0.01, "colon": 0.01}
WHOLE_SHARES = {"fragment": 0.003, "open word": 0.0003, "open mark": 0.001, "abbreviation": 0.06, "short line": 0.22, "list entry": 0.33, "table row": 0.33, "colon": 0.05}
NEVER_CUT = ("terminal", "reference")
#: Texts the shares above are worth, and those of a source's prior; first shares of cut texts, declared lengths and marks among whole and cut ones.
SHARE_WORTH, PRIOR_WORTH, FIRST_PRIOR, FIRST_LONGER, FIRST_MARKED = 100.0, 40.0, 0.08, (0.01, 0.1), (0.005, 0.1)
ROUNDS = 12


class Mixture:
    """Shares of endings (by ``CUT_SHARES``), of declared lengths beyond the text and of marks, among whole (0) and cut (1) texts."""

    def __init__(self):
        self.endings = {e: (WHOLE_SHARES[e], CUT_SHARES[e]) for e in CUT_SHARES}
        self.longer, self.marked = FIRST_LONGER, FIRST_MARKED

    def log_odds(self, ending: str, longer: bool, marked: bool) -> float:
        """Of one text, without its prior."""
        odds = math.log(self.endings[ending][1] / self.endings[ending][0])
        for is_so, (whole, cut) in ((longer, self.longer), (marked, self.marked)):
            odds += math.log(cut / whole) if is_so else math.log((1 - cut) / (1 - whole))
        return odds

    def fit(self, cells: list[tuple[str, bool, bool, float | None, float]]) -> Mixture:
        """From (ending, longer, marked, posterior or None, texts); ``NEVER_CUT`` endings take no part."""
        cells = [c for c in cells if c[0] in self.endings]
        prior = FIRST_PRIOR
        for _ in range(ROUNDS):
            cut = []
            for ending, longer, marked, posterior, _ in cells:
                p = prior if posterior is None else posterior
                cut.append(1 / (1 + math.exp(-max(min(self.log_odds(ending, longer, marked) + math.log(p / (1 - p)), 50), -50))))
            n = np.array([c[4] for c in cells], float)
            r = np.array(cut)
            # what cut texts look like is learned where the lengths tell that texts were cut: elsewhere any share of an ending would do
            elsewhere = np.array([c[3] is None for c in cells], bool)
            weights = (n * (1 - r), n * r * ~elsewhere)
            total = [w.sum() + SHARE_WORTH for w in weights]
            of = lambda w, is_so: float(w[np.array([is_so(c) for c in cells], bool)].sum()) if cells else 0.0
            self.endings = {e: tuple((of(w, lambda c, e=e: c[0] == e) + SHARE_WORTH * first) / t for w, t, first in zip(weights, total, (WHOLE_SHARES[e], CUT_SHARES[e]), strict=True)) for e in CUT_SHARES}
            self.longer = tuple(min((of(w, lambda c: c[1]) + SHARE_WORTH * f) / t, 0.99) for w, t, f in zip(weights, total, FIRST_LONGER, strict=True))
            self.marked = tuple(min((of(w, lambda c: c[2]) + SHARE_WORTH * f) / t, 0.99) for w, t, f in zip(weights, total, FIRST_MARKED, strict=True))
            prior = (float((n * r)[elsewhere].sum()) + PRIOR_WORTH * FIRST_PRIOR) / (float(n[elsewhere].sum()) + PRIOR_WORTH) if cells else prior
        self.prior = min(max(prior, 1e-6), 0.5)
        return self

    def column(self) -> Column:
        """The log-odds without the prior, of columns ending, longer and marked; null for other endings."""
        odds = F.element_at(F.create_map(*[F.lit(x) for e, (whole, cut) in self.endings.items() for x in (e, math.log(cut / whole))]), F.col("ending"))
        for c, (whole, cut) in (("longer", self.longer), ("marked", self.marked)):
            odds = odds + F.when(F.col(c), math.log(cut / whole)).otherwise(math.log((1 - cut) / (1 - whole)))
        return odds


def truncation_evidence(df: DataFrame, id_col: str, text_col: str, source_col: str, declared_col: str | None = None) -> DataFrame:
    """Per record: the evidence that its text was cut, and whether it was.

    Null, empty and blank texts are whole. A text at a limit of its source that
    ends like a whole one is whole. Records without a source are judged as one
    source. Repeated rows give one row. ``declared_col`` holds the length the
    sender declared; nulls, noughts and shorter ones say nothing. Other columns
    are ignored; an empty table gives no rows.

    Returns id, source, ending, at_limit int (null: none), posterior double,
    log_odds double (null: it ends like no cut text), truncated boolean.
    """
    text = F.col("t")
    blanks = F.lit(BLANKS)
    bare = F.rtrim(F.regexp_replace(F.rtrim(text, blanks), r"(?:</?[a-zA-Z][^<>]{0,40}>){1,9}$", ""), blanks)
    # marks are looked for in the last characters; where all of these are marks, in the whole text
    tail = F.right("bare", F.lit(MARKS))
    left = F.regexp_replace(tail, CUT_MARK, "")
    marks_off = F.when((F.length("bare") > MARKS) & (left == ""), F.regexp_replace("bare", CUT_MARK, "")).otherwise(F.concat(F.left("bare", F.length("bare") - F.length(tail)), left))
    unmarked = F.rtrim(marks_off, blanks)
    declared = F.col(declared_col).cast("long") if declared_col else F.lit(None).cast("long")
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("t"), declared.alias("declared"))
    rows = rows.withColumn("bare", bare).withColumn("core", unmarked).withColumn("marked", F.coalesce(F.length("bare") > F.length("core"), F.lit(False)))
    # the last line without the sentences that end in it
    two = F.translate(F.substring_index(F.translate("core", "\r", ""), "\n", -2), "\u2028", "\n")
    rows = rows.withColumn("before", F.when(F.contains(two, F.lit("\n")), F.trim(F.substring_index(two, "\n", 1))))
    line = F.substring_index(F.substring_index("core", "\n", -1), "\r", -1)
    line = F.element_at(F.split(line, r"<br ?/?>|</?(?:p|div|li|tr|h[1-6])>"), -1)
    rows = rows.withColumn("line", F.coalesce(F.ltrim(line, blanks), F.lit("")))
    lengths = F.array(F.length("t"), F.octet_length("t"), F.length("core"), F.octet_length("core"))
    blank = F.coalesce(F.length("core") == 0, F.lit(True))
    features = rows.select(
        "id", F.coalesce("source", F.lit("")).alias("s"), "source", "marked", lengths.alias("lengths"), blank.alias("blank"),
        F.when(~blank, _ending(F.col("core"), F.col("line"), F.col("before"), F.length("core") - F.length(F.translate("core", "\n", "")))).alias("ending"),
        F.coalesce(F.col("declared") > F.octet_length("t") + F.greatest(F.lit(16), 0.02 * F.octet_length("t")), F.lit(False)).alias("longer"),
    )
    features = cut_lineage(features.distinct())
    limits = censoring_limits(features.where(~F.col("blank")).select(F.col("s").alias("source"), "lengths"))
    # one row a source, so that the join keeps the rows of the records
    by_source = limits.groupBy(F.col("source").alias("s")).agg(F.collect_list(F.struct("posterior", "unit", "limit", "width")).alias("limits"))
    at = F.filter("limits", lambda x: (F.element_at("lengths", x["unit"] + 1) <= x["limit"]) & (F.element_at("lengths", x["unit"] + 1) > x["limit"] - x["width"]))
    joined = cut_lineage(features.join(by_source, "s", "left").withColumn("at", F.array_max(at)).select("id", "s", "source", "blank", "marked", "longer", "ending", F.col("at.limit").alias("at_limit"), F.col("at.posterior").alias("posterior")))
    # the mixture is fitted to counts of a bounded number of cells: endings x 2 x 2 x rounded posteriors
    rounded = F.when(F.col("posterior").isNotNull(), F.greatest(F.least(F.round(F.col("posterior"), 1), F.lit(0.99)), F.lit(0.5)))
    cells = joined.where(~F.col("blank") & ~F.col("ending").isin(*NEVER_CUT)).groupBy("ending", "longer", "marked", rounded.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    mixture = Mixture().fit(sorted(((r.ending, r.longer, r.marked, r.p, float(r.n)) for r in cells), key=str))
    odds = F.when(~F.col("blank") & ~F.col("ending").isin(*NEVER_CUT), mixture.column())
    logit = lambda p: F.ln(p / (1 - p))
    expected = 1 / (1 + F.exp(-(odds + F.coalesce(logit(F.col("posterior")), F.lit(math.log(mixture.prior / (1 - mixture.prior)))))))
    # a source's prior: the share of cut texts the mixture expects among those at no limit
    elsewhere = F.col("posterior").isNull() & ~F.col("blank") & ~F.col("ending").isin(*NEVER_CUT)
    priors = joined.groupBy("s").agg(((F.coalesce(F.sum(F.when(elsewhere, expected)), F.lit(0.0)) + PRIOR_WORTH * mixture.prior) / (F.count_if(elsewhere) + PRIOR_WORTH)).alias("prior"))
    judged = joined.join(priors, "s").withColumn("log_odds", F.round(odds + logit(F.coalesce("posterior", "prior")), 4))
    return judged.select("id", "source", "ending", "at_limit", "posterior", "log_odds", F.coalesce(F.col("log_odds") > 0, F.lit(False)).alias("truncated"))


def truncation_by_source(evidence: DataFrame) -> DataFrame:
    """source, records, truncated, share, limits (those its records stand at), from ``truncation_evidence``."""
    return evidence.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count_if("truncated").alias("truncated"), F.round(F.count_if("truncated") / F.count(F.lit(1)), 6).alias("share"), F.array_sort(F.collect_set(F.when(F.col("truncated"), F.col("at_limit")))).alias("limits"))
