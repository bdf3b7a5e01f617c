"""Problem 7: broken prompt and response pairs, with the kind of their defect.

Responses are sorted by question and text, and so are the sentences and lines
that responses end in, without their names and figures, among all sentences and
lines of responses and ground truths. In the sorted order those that continue a
text stand just behind it: a response that another response or the ground truth
of its question continues within the sentence, and a last sentence that others
continue but none is complete with, is truncated. Lengths at which such
responses pile up show a length limit and decide for endings no other text
tells about; what is left is judged by its ending. Rules on copies, refusals and
languages tell the other defects: the wording of refusals is that of the
responses to questions that can't be answered, languages are learned from
labelled texts.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm import languages
from ledgerloom.llm.common import map_arrow
from ledgerloom.llm.truncation import ABBREVIATED, OPEN_WORDS
from ledgerloom.session import cut_lineage

# fixed values: contents that say nothing
EMPTY_WORDS = frozenset("none null nil nan na n/a undefined empty blank tbd missing unknown answer sources source response output".split())
# fixed values: openings of refusals
_REFUSAL = re.compile(
    r"""(?ix)
    \b(?:i|we)\s?(?:['’]m|\s+am|\s+are)\s+(?:sorry|afraid|unable|not\s+able|not\s+in\s+a\s+position)\b
    | \bi\s+(?:cannot|can\s?not|can['’]t|could\s+not|couldn['’]t|won['’]t|will\s+not|do\s+not|don['’]t|must|have\s+to)\s+(?:\w+\s+){0,2}(?:answer|determine|provide|give|help|assist|speculate|comment|find|say|tell|know|comply|respond|decline|have|share|confirm|identify|locate|see|discuss|offer)\b
    | ^\W*(?:sorry|apologies|unfortunately)\b
    | ^\W*unable\s+to\b
    | \bas\s+an?\s+(?:ai|artificial|language|assistant)\b
    | ^\W*(?:there\s+is\s+)?(?:insufficient|not\s+enough|no(?:\s+relevant)?)\s+(?:information|context|evidence|data|detail)
    | ^\W*(?:the|these|none\s+of\s+the|neither\s+of\s+the|no)\s+(?:\w+\s+){0,2}(?:excerpts?|chunks?|context|passages?|documents?|materials?|sources?|information|filings?|text)\b(?:\s+(?!however)\w+){0,3}?\s+(?:do(?:es)?\s+not|doesn['’]t|don['’]t|cannot|can['’]t|fails?\s+to|lacks?|address(?:es)?|contains?|mentions?)\b
    | \b(?:cannot|can['’]t|could\s+not|not\s+possible\s+to)\s+(?:be\s+)?(?:answer(?:ed)?|determined?)\b
    | ^\W*(?:je\s+(?:ne\s+(?:peux|sais|suis)|suis\s+désolé)|désolé|impossible\s+de|ich\s+kann\b.*\bnicht|leider|es\s+tut\s+mir\s+leid|lo\s+siento|no\s+puedo|no\s+es\s+posible|não\s+posso|desculpe|lamento|申し訳|к\s+сожалению|извините)
    """
)
# what follows one of these words may be an answer; a subject before it belongs to that clause
_CONTRAST = re.compile(r"(?i)\b((?:i|we)\s+)?(?:however|nevertheless|that said|but|still)\b[,;:]?\s+")
_SOURCES = re.compile(r"(?is)\bsources?\s*:\s*(?:\[[^\[\]]*\](?:\s*[,;]\s*)?)*\s*$")
_OPEN_SOURCES = re.compile(r"(?is)\bsources?\s*:\s*\[[^\]]*$")
_TERMINAL = re.compile(r"""[.!?。！？।؟][)\]"'”’»」』*_]*$""")
_ABBREVIATION = re.compile(ABBREVIATED)
_ITEM = re.compile(r"^\s*(?:[-•*·–]|\(?[0-9]{1,3}[.)]|\(?[a-z][.)])\s+")
_FIGURE = re.compile(r"\d")
_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|\"[^\"]*\"|„[^“”]*[“”]|「[^」]*」")
_OPEN = frozenset(OPEN_WORDS.split())
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def _letters(s: str) -> str:
    return " ".join(re.findall(r"\w+", s.lower()))


def _core(answer: str) -> str:
    return _SOURCES.sub("", re.sub(r"(?i)^\s*(?:answer|a|response)\s*:\s*", "", answer)).strip()


def _answers_yet(core: str) -> bool:
    """Whether a clause of more than five words behind a contrast answers, i.e. is no refusal itself."""
    marks = list(_CONTRAST.finditer(core))
    ends = [*(m.start() for m in marks[1:]), len(core)]
    for mark, end in zip(marks, ends, strict=bool(marks)):
        clause = core[mark.end() : end]
        if len(clause.split()) > 5 and not _REFUSAL.search((mark.group(1) or "") + clause):
            return True
    return False


#: A wording of refusals stands in this share of the responses to questions that can't be answered, three at least, and so many times oftener there than elsewhere; together such wordings hold this share of a refusal's words.
WORDING_SHARE, WORDING_LEAST, WORDING_RATIO, WORDING_COVER = 0.001, 3, 8.0, 0.6
#: Words of a wording.
WORDING = 3
_ANY_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def _runs(text: str) -> set[str]:
    words = _ANY_WORD.findall(_SOURCES.sub("", text).lower())
    return {" ".join(words[i : i + WORDING]) for i in range(len(words) - WORDING + 1)}


def _counted_runs(texts: DataFrame, only: frozenset[str] | None = None, entries: int = 300_000) -> DataFrame:
    """run, n of the runs of words, or of those in ``only``: how many texts hold each; a null run counts the texts."""

    def count(batches):
        held, texts = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                texts += 1
                runs = _runs(text)
                held.update(runs if only is None else runs & only)
                if len(held) >= entries:
                    yield pa.RecordBatch.from_pydict({"run": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
                    held.clear()
        yield pa.RecordBatch.from_pydict({"run": pa.array([*held, None], pa.string()), "n": pa.array([*held.values(), texts], pa.int64())})

    return map_arrow(texts, count, "run string, n long").groupBy("run").agg(F.sum("n").alias("n"))


def refusal_wordings(rows: DataFrame, answer: str, answerable: str) -> list[str]:
    """Runs of three words that stand in responses to questions that can't be answered, and much oftener there than in others.

    At most as many as ``1 / WORDING_SHARE`` mean responses hold: the runs of the
    first are counted, and only those frequent there in the others.
    """
    said = rows.where(F.col(answerable).isNotNull() & F.col(answer).isNotNull())
    there = cut_lineage(_counted_runs(said.where(~F.col(answerable)).select(answer)))
    without = there.where("run IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(WORDING_LEAST, WORDING_SHARE * without)
    often = {r.run: r.n for r in there.where(F.col("run").isNotNull() & (F.col("n") >= least)).collect()}
    if not often:
        return []
    elsewhere = {r.run: r.n for r in _counted_runs(said.where(F.col(answerable)).select(answer), frozenset(often)).collect()}
    given = elsewhere.get(None, 0)
    return [run for run, n in sorted(often.items()) if given and n / without >= WORDING_RATIO * (elsewhere.get(run, 0) + 1) / (given + 1)]


def declines(core: str, wordings: frozenset[str]) -> bool:
    """Whether a response, without its list of sources, declines: by its opening, or as most of its words stand in wordings of refusals."""
    if _REFUSAL.search(core) and not _answers_yet(core):
        return True
    if not wordings:
        return False
    words = _ANY_WORD.findall(core.lower())
    covered = [False] * len(words)
    for i in range(len(words) - WORDING + 1):
        if " ".join(words[i : i + WORDING]) in wordings:
            covered[i : i + WORDING] = [True] * WORDING
    return len(words) >= WORDING and sum(covered) >= WORDING_COVER * len(words)


def rule_defect(question: str | None, answer: str | None, answerable: bool | None, wordings: frozenset[str] = frozenset(), foreign: bool = False) -> str | None:
    """``empty``, ``question_copy``, ``refusal`` or, where ``foreign``, ``other_language``; None for others. Declining where that is right has no defect, in whatever language."""
    core = _core(answer or "")
    said = _letters(core)
    if not said or said in EMPTY_WORDS or said in {"n a", "no answer", "no response"}:
        return "empty"
    asked = _letters(question or "")
    if asked and f" {asked} " in f" {said} ":
        # up to four words beside the question, none of which is an answer
        left = f" {said} ".replace(" ", "  ").replace(f" {asked.replace(' ', '  ')} ", " ").split()
        if len(left) <= 4 and not any(w in ("yes", "no") or any(map(str.isdigit, w)) for w in left):
            return "question_copy"
    if asked and len(asked) > 20 and (said in asked and len(said) > 0.9 * len(asked)):
        return "question_copy"
    if declines(core, wordings):
        return "refusal" if answerable else None
    return "other_language" if foreign else None


def unfinished(answer: str | None) -> str | None:
    """How a response ends: ``whole``, ``open`` (it surely goes on), ``unclear`` or ``abbreviated`` (in a full stop that may be no end)."""
    text = (answer or "").strip()
    if _OPEN_SOURCES.search(text):
        return "open"
    bare = _SOURCES.sub("", text).strip()
    if bare != text:
        return "whole"
    if re.search(r"(?i)\n\s*(?:s|so|sou|sour|sourc|source|sources):?$", text):
        return "open"
    text = bare.strip()
    if len(text.split()) > 3 and _ABBREVIATION.search(text):
        return "abbreviated"
    if not text or _TERMINAL.search(text):
        return "whole"
    lines = [x for x in text.split("\n") if x.strip()]
    last = lines[-1]
    words = _WORDS.findall(last)
    if text.endswith((",", ";", "(", "–", "-", ":", "$", "€")) or words and last.endswith(words[-1]) and words[-1].lower() in _OPEN:
        return "open"
    if _ITEM.match(last):
        before = [x for x in lines[:-1] if _ITEM.match(x)]
        if not _ITEM.sub("", last).strip():
            return "open"
        if before:
            if all(_TERMINAL.search(x.strip()) for x in before):
                return "open"
            if all(": " in x for x in before) and not re.search(r": \S.*\d", last):
                return "open"
        return "unclear"
    if re.match(r"^\s*(?:[-•*]|\(?\d{1,3}[.)]?)\s*$", last):
        return "open"
    if len(text.split()) <= 6 and (_FIGURE.search(text) or len(text.split()) <= 3):
        return "whole" if not re.search(r"\.\d?$|\bUSD$|[$€]$", text) else "open"
    return "open"


_MARKER = re.compile(r"^\s*(?:[-•*·–]|\(?[0-9]{1,3}[.)]|\(?[a-z][.)]|#+)\s+")
_UNIT_END = re.compile(r"(?<=[.!?。！？])[)\]\"'”’»」]*(?:\s+(?=[^\W\d_a-zа-я]|[\d“\"«$€£(-])|(?<=[。！？])(?=\S))|\n+")
_SHAPED = re.compile(r"(?P<figure>(?:USD\s|[$€£¥]\s?)?\d(?:[\d.,:/-]*\d)?(?:\s?%)?|[$€£¥])|(?P<name>\b[A-ZÀ-ÖØ-ÞА-Я][\w'’&-]*(?:\s+(?:&\s+)?[A-ZÀ-ÖØ-ÞА-Я][\w'’&-]*)*)")


def shape(unit: str) -> str:
    """A sentence or line without its marker, figures as ``#`` and names as ``N``; its first word in lower case unless it opens a name."""
    u = " ".join(_MARKER.sub("", unit).split())
    first, _, rest = u.partition(" ")
    if first[1:].islower() and not rest[:1].isupper():
        u = first.lower() + (" " + rest if rest else "")
    return _SHAPED.sub(lambda m: "#" if m["figure"] else "N", u)


def shapes(text: str) -> list[str]:
    """The shapes of the sentences and lines of a text, in order."""
    return [s for u in _UNIT_END.split(text) if u and (s := shape(u))]


def goes_on(said: str, rest: str) -> bool:
    """Whether ``rest`` goes on within the word, figure or sentence in which ``said`` ends; scripts without spaces tell nothing."""
    last, first = said[-1], rest[0]
    joined = first.isalnum() and first < "⺀"
    if last in ".!?":
        return joined or first in ",;" or rest.lstrip(" ")[:1].islower()
    if last.isalnum() and last < "⺀":
        return joined or last.isdigit() and re.match(r"[.,]\d", rest) is not None
    return False


#: Characters by which values are put into ranges; only shorter values may be continued in another range.
RANGE_PREFIX = 200


def continued(values: DataFrame) -> DataFrame:
    """Of the distinct values asked for, how many rows hold a longer value that begins with it: value, more bigint, onward boolean (one of them ``goes_on``).

    ``values``: value, n (rows that hold it), asked. They are sorted over all
    partitions, by ranges of their first ``RANGE_PREFIX`` characters and whole
    within them. Values that continue one follow it without a gap, so a task
    holds the values that the last one continues and no others. Of these, the
    ones shorter than the prefix, at the end of a partition, are compared with
    the partitions behind it: a bounded number of bytes a partition.
    """
    prefix = F.substring("value", 1, RANGE_PREFIX)
    ordered = values.where("value <> ''").groupBy("value").agg(F.sum("n").alias("n"), F.max("asked").alias("asked")).withColumn("p", prefix).repartitionByRange("p").sortWithinPartitions("p", "value").select("value", "n", "asked")

    def compare(batches):
        from pyspark import TaskContext

        no, held, first = TaskContext.get().partitionId(), [], True

        def batch_of(rows):
            values, more, on, kinds = zip(*rows, strict=True)
            return pa.RecordBatch.from_pydict({"value": pa.array(values, pa.string()), "more": pa.array(more, pa.int64()), "onward": pa.array(on, pa.bool_()), "place": pa.array(kinds, pa.string()), "part": pa.array([no] * len(values), pa.int32())})

        for batch in batches:
            rows = []
            for value, n, asked in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if first:
                    rows.append((value[:RANGE_PREFIX], 0, False, "first"))
                    first = False
                while held and not value.startswith(held[-1][0]):
                    rows.append((*held.pop(), "inner"))
                for one in held:
                    one[1], one[2] = one[1] + n, one[2] or goes_on(one[0], value[len(one[0]) :])
                if asked:
                    held.append([value, 0, False])
            if rows:
                yield batch_of(rows)
        if held:
            yield batch_of([(*one, "last" if len(one[0]) < RANGE_PREFIX else "inner") for one in held])

    kept = cut_lineage(map_arrow(ordered, compare, "value string, more long, onward boolean, place string, part int"))
    edges = kept.where("place <> 'inner'").select("part", "place", "value").collect()
    firsts = sorted((r.part, r.value) for r in edges if r.place == "first")
    following = dict(zip((p for p, _ in firsts), firsts[1:], strict=False))
    over = sorted((r.part, r.value) for r in edges if r.place == "last" and r.part in following and following[r.part][1].startswith(r.value))
    found = kept.where("place <> 'first'").select("value", "more", "onward")
    if not over:
        return found

    # these few are counted anew over all values, as ranges may be cut elsewhere when they are made again
    asked_again = {a for _, a in over}

    def look(batches):
        sizes, more, on = sorted({len(a) for a in asked_again}), {}, set()
        for batch in batches:
            for value, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for size in sizes:
                    if size < len(value) and (a := value[:size]) in asked_again:
                        more[a] = more.get(a, 0) + n
                        if goes_on(a, value[size:]):
                            on.add(a)
        yield pa.RecordBatch.from_pydict({"value": pa.array(list(more), pa.string()), "more": pa.array(list(more.values()), pa.int64()), "onward": pa.array([a in on for a in more], pa.bool_())})

    again = map_arrow(values.select("value", "n"), look, "value string, more long, onward boolean").groupBy("value").agg(F.sum("more").alias("more"), F.max("onward").alias("onward"))
    known = F.col("value").isin(sorted(asked_again))
    return found.where(~known).unionByName(again)


def length_limits(judged: DataFrame) -> DataFrame:
    """limit: the lengths at which responses known as truncated pile up, beyond what the lengths around let expect.

    What a length would hold is the mean of the four on either side; the excess
    must be what chance gives once in a thousand sets of lengths. Equal answers
    count once.
    """
    spikes = judged.where("cut").select("answer").distinct().groupBy(F.length("answer").alias("n")).agg(F.count(F.lit(1)).alias("x"))
    around = spikes.select("x", F.col("n").alias("m"), F.explode(F.sequence(F.col("n") - 4, F.col("n") + 4)).alias("n"))
    at, near = F.coalesce(F.sum(F.when(F.col("m") == F.col("n"), F.col("x"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("m") != F.col("n"), F.col("x"))), F.lit(0)) / 8
    counted = around.groupBy("n").agg(at.alias("at"), F.greatest(near, F.lit(0.125)).alias("near"))
    lengths = F.greatest(F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))), F.lit(1))  # one row a length
    excess = F.col("at") * F.log(F.col("at") / F.col("near")) - F.col("at") + F.col("near")
    return counted.where("at > near").withColumn("lengths", lengths).where(excess > F.log(1000 * F.col("lengths"))).select(F.col("n").alias("limit"))


#: A shape's share of endings among the rows that hold it or continue it, below which it isn't taken as an end of its own.
NATURAL_SHARE = 0.2


def judged_pairs(df: DataFrame, key_cols: list[str], question_col: str, answer_col: str, answerable_col: str, truth_col: str | None = None, language_texts: DataFrame | None = None, language_cols: tuple[str, str] = ("text", "lang")) -> DataFrame:
    """``defective_pairs`` with ``evidence``, what decided: ``rule``, ``sources``, ``neighbour``, ``sentence``, ``length`` or ``ending``."""
    keys = [f"__k{i}" for i in range(len(key_cols))]
    truth = F.col(truth_col).cast("string") if truth_col else F.lit(None).cast("string")
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(key_cols, keys, strict=True)), F.col(question_col).cast("string").alias("q"), F.col(answer_col).cast("string").alias("answer"), F.col(answerable_col).cast("boolean").alias("ok"), truth.alias("truth")).distinct()
    context = df.sparkSession.sparkContext
    model = context.broadcast(languages.sample(language_texts, *language_cols) if language_texts is not None else None)
    wordings = context.broadcast(frozenset(refusal_wordings(rows, "answer", "ok")))

    def judge(batches):
        n, said = len(keys), wordings.value
        for batch in batches:
            q, a, ok, truths = (batch.column(n + i).to_pylist() for i in range(4))
            cores = [_core(x or "") for x in a]
            foreign = languages.differs(model.value, [x or "" for x in q], [_QUOTED.sub(" ", c) for c in cores])
            defects = [rule_defect(*x, said, f) for *x, f in zip(q, a, ok, foreign, strict=True)]
            endings = [unfinished(x) for x in a]
            units = [[] if d else shapes(c) for d, c in zip(defects, cores, strict=True)]
            # declined or broken responses tell nothing about endings; answers to one question are neighbours, their lists of sources taken off
            asked = [hashlib.md5((x or "").encode()).hexdigest() for x in q]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(n)), batch.column(n + 1), pa.array(defects, pa.string()), pa.array(endings, pa.string()), pa.array([bool(_SOURCES.search(x or "")) for x in a]),
                    pa.array([None if d else x + c for x, c, d in zip(asked, cores, defects, strict=True)], pa.string()), pa.array([x + t if (t := _core(y or "")) else None for x, y in zip(asked, truths, strict=True)], pa.string()),
                    pa.array([u[-1] if u else None for u in units], pa.string()), pa.array([u[:-1] for u in units], pa.list_(pa.string())), pa.array([shapes(_core(t or "")) for t in truths], pa.list_(pa.string())),
                ],
                [*keys, "answer", "defect", "ending", "sourced", "core", "truth", "last", "inner", "true_units"],
            )

    kinds = dict(rows.dtypes)
    judged = cut_lineage(map_arrow(rows, judge, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", answer string, defect string, ending string, sourced boolean, core string, truth string, last string, inner array<string>, true_units array<string>"))
    plain = judged.where("defect IS NULL")
    # complete: sentences and lines with more behind them in their text, and those of ground truths; ends: the last ones of responses
    complete = judged.select(F.explode(F.concat("inner", F.when(F.length("truth") > 0, F.col("true_units")).otherwise(F.array().cast("array<string>")))).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("complete"))
    ends = plain.where("last IS NOT NULL AND NOT sourced").groupBy(F.col("last").alias("value")).agg(F.count(F.lit(1)).alias("ends"))
    held = lambda p, v: F.concat(F.lit(p), v)
    values = (
        complete.select(held("s", "value").alias("value"), F.col("complete").alias("n"), F.lit(False).alias("asked"))
        .unionByName(ends.select(held("s", "value").alias("value"), F.col("ends").alias("n"), F.lit(True).alias("asked")))
        .unionByName(plain.where("core IS NOT NULL").select(held("a", "core").alias("value"), F.lit(1).cast("long").alias("n"), (~F.col("sourced")).alias("asked")))
        .unionByName(judged.where("truth IS NOT NULL").select(held("a", "truth").alias("value"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("asked")))
    )
    more = cut_lineage(continued(values))
    told = ends.join(complete, "value", "left").join(more.select(F.expr("substring(value, 2)").alias("value"), "more", F.left("value", F.lit(1)).alias("kind")).where("kind = 's'").drop("kind"), "value", "left")
    whole, others = F.coalesce("complete", F.lit(0)), F.coalesce("more", F.lit(0))
    natural = (F.col("ends") + whole) >= NATURAL_SHARE * (F.col("ends") + whole + others)
    sentence = F.when(whole >= F.greatest(F.lit(1), 0.01 * others), "whole").when((others > 0) & ~natural, "cut")
    told = told.select(F.col("value").alias("last"), sentence.alias("sentence"))
    nexts = more.where("onward AND value LIKE 'a%'").select(F.expr("substring(value, 2)").alias("core"), F.lit(True).alias("onward"))
    open_ = plain.where("NOT sourced").select(*keys, "answer", "ending", "core", "last").join(told, "last", "left").join(nexts, "core", "left")
    ended = F.col("ending") == "open"
    evidence = (
        F.when(F.col("answer").rlike(r"(?is)\bsources?\s*:\s*\[[^\]]*$|\n\s*s(?:o(?:u(?:r(?:c(?:es?)?)?)?)?)?:?\s*$"), "sources")
        .when(F.coalesce("onward", F.lit(False)), "neighbour")
        .when(F.col("sentence") == "cut", "sentence")
        .when(F.col("sentence") == "whole", F.lit(None).cast("string"))
        .when(ended, "ending")
    )
    weighed = open_.withColumn("evidence", evidence).withColumn("cut", F.col("evidence").isNotNull())
    limits = length_limits(weighed)
    # a length limit decides where neither another text nor the ending does
    weighed = weighed.join(limits, F.length("answer") == F.col("limit"), "left").withColumn("evidence", F.when(F.col("evidence").isNull() & F.col("sentence").isNull() & F.col("limit").isNotNull() & F.col("ending").isin("unclear", "abbreviated"), "length").otherwise(F.col("evidence")))
    found = judged.where("defect IS NOT NULL").select(*keys, "defect", F.lit("rule").alias("evidence")).unionByName(weighed.where("evidence IS NOT NULL").select(*keys, F.lit("truncated").alias("defect"), "evidence"))
    return found.select(*(F.col(k).alias(c) for c, k in zip(key_cols, keys, strict=True)), "defect", "evidence").distinct()


def defective_pairs(df: DataFrame, key_cols: list[str], question_col: str, answer_col: str, answerable_col: str, truth_col: str | None = None, language_texts: DataFrame | None = None, language_cols: tuple[str, str] = ("text", "lang")) -> DataFrame:
    """One row per defective pair, with its defect.

    ``empty``: no content (null, blank, punctuation, a placeholder).
    ``question_copy``: only the question. ``refusal``: declines although
    answerable is true; null and false excuse it. ``other_language``: not the
    language of the question, quoted phrases apart; languages of one script are
    told apart by what ``language_texts`` (text and label, a bounded sample of
    them) teach, without them only scripts are. ``truncated``: stops before its
    end. The first that holds in this order counts.

    Rows are told apart by ``key_cols``; nulls are key values like others.
    Repeated rows give one row. Null questions make no copy and no language; null
    ground truths tell nothing. An empty table gives no rows; other columns are
    ignored.

    Returns ``key_cols``, defect.
    """
    return judged_pairs(df, key_cols, question_col, answer_col, answerable_col, truth_col, language_texts, language_cols).select(*key_cols, "defect").distinct()
