"""Problem 1: how often every distinct term occurs, in how many records, and whether it helps retrieval.

Heavy-light aggregation. A first pass keeps a Misra-Gries summary per task over
the whole column; the merged summaries name the heavy terms, at most
``1 / heavy_share`` of them, which are broadcast. The second pass counts heavy
terms exactly in a counter array per task and every other term in a bounded
hash table that is emitted when full. Heavy counts leave a task as one row per
heavy term, so a term that stands in every record moves no more than a rare
one; only light counts are shuffled by term. Both tables are then united. The
summary only routes terms: counts are exact whatever it holds.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_arrow, record_key
from ledgerloom.operators.chunking import distinct_rows
from ledgerloom.session import cut_lineage

TERM = "[a-z]{2,}"
LIGHT, HEAVY, RECORDS = 0, 1, 2


def heavy_terms(texts: DataFrame, text_col: str, heavy_share: float) -> list[str]:
    """Terms that make up at least about ``heavy_share`` of all occurrences; never more than ``2 / heavy_share``."""
    counters = int(4 / heavy_share)
    pattern = TERM

    def summarise(batches):
        find, kept, total = re.compile(pattern).findall, Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    terms = find(text.lower())
                    total += len(terms)
                    kept.update(terms)
                    if len(kept) > 4 * counters:
                        least = sorted(kept.values(), reverse=True)[counters]
                        kept = Counter({t: n - least for t, n in kept.items() if n > least})
        if len(kept) > counters:
            least = sorted(kept.values(), reverse=True)[counters]
            kept = Counter({t: n - least for t, n in kept.items() if n > least})
        yield pa.RecordBatch.from_pydict({"term": pa.array([None, *kept], pa.string()), "n": pa.array([total, *kept.values()], pa.int64())})

    sums = map_arrow(texts.select(F.col(text_col).cast("string")), summarise, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    bound = int(2 / heavy_share)
    rows = sums.orderBy(F.desc("n"), "term").limit(bound + 1).collect()
    total = next((r.n for r in rows if r.term is None), 0)
    return [r.term for r in rows if r.term is not None and r.n >= heavy_share / 2 * total and total][:bound]


def term_frequencies(df: DataFrame, id_col: str, text_col: str, rare_below: int = 3, common_above: float = 0.5, heavy_share: float = 0.0005, light_entries: int = 300_000) -> DataFrame:
    """Every term with its occurrences, its records and a mark.

    A term is a maximal run of two or more letters a-z in the lower-cased text.
    ``mark`` is ``rare`` below ``rare_below`` records, ``common`` in more than
    the share ``common_above`` of the records with a text, else null; a term
    that is both is ``rare``.

    Repeated rows of an id with the same text count once; rows without an id
    count once per distinct text. Null texts are no records; empty and blank
    ones are, without terms. An empty table gives no rows. Other columns are
    ignored.

    Returns term, occurrences bigint, records bigint, mark.
    """
    spark = df.sparkSession
    heavy = heavy_terms(df, text_col, heavy_share)
    heavy_b = spark.sparkContext.broadcast(heavy)
    records = df.where(F.col(text_col).isNotNull()).select(record_key(id_col, text_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    records = distinct_rows(records, "k")
    pattern = TERM

    def count(batches):
        find, names = re.compile(pattern).findall, heavy_b.value
        slot = {t: i for i, t in enumerate(names)}
        often, within, light, texts = array("q", bytes(8 * len(names))), array("q", bytes(8 * len(names))), {}, 0

        def rows(kind, terms, occurrences, records):
            n = len(terms)
            return pa.RecordBatch.from_pydict({"kind": pa.array([kind] * n, pa.int8()), "term": pa.array(terms, pa.string()), "occurrences": pa.array(occurrences, pa.int64()), "records": pa.array(records, pa.int64())})

        def emitted():
            return rows(LIGHT, list(light), [v[0] for v in light.values()], [v[1] for v in light.values()])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                texts += 1
                for term, n in Counter(find(text.lower())).items():
                    i = slot.get(term)
                    if i is not None:
                        often[i] += n
                        within[i] += 1
                    elif (v := light.get(term)) is None:
                        light[term] = [n, 1]
                    else:
                        v[0] += n
                        v[1] += 1
                if len(light) >= light_entries:
                    yield emitted()
                    light.clear()
        if light:
            yield emitted()
        some = [i for i, n in enumerate(within) if n]
        if some:
            yield rows(HEAVY, [names[i] for i in some], [often[i] for i in some], [within[i] for i in some])
        if texts:
            yield rows(RECORDS, [None], [0], [texts])

    partial = cut_lineage(map_arrow(records.select("t"), count, "kind byte, term string, occurrences long, records long"))
    total = partial.where(F.col("kind") == RECORDS).agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]

    def summed(kind):
        return partial.where(F.col("kind") == kind).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))

    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * total, "common")
    return summed(HEAVY).unionByName(summed(LIGHT)).withColumn("mark", mark)
