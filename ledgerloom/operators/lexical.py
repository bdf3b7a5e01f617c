"""BM25 over a corpus per partition key, for many questions at once, over an index that may be kept."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import lexical_tokens
from ledgerloom.operators.selection import top_rows
from ledgerloom.operators.topk import Best
from ledgerloom.session import cut_lineage

K1, B, EPSILON = 1.5, 0.75, 0.25
TOKENIZER = "lower-whitespace-v1"
#: Questions scored by one multiplication, distinct terms of them, and weights broadcast for one pass over the corpus: about 40 MB.
BLOCK_QUESTIONS, BLOCK_TERMS, PASS_WEIGHTS = 256, 4096, 400_000
#: Records of one part that are scored together.
BATCH = 1024


def records_of(chunks: DataFrame, part: str, key: str, text: str, group: str | None = None) -> DataFrame:
    """part, key, grp, dl, words of each chunk."""
    words = lexical_tokens(F.col(text))
    grp = F.col(group).cast("string") if group else F.lit(None).cast("string")
    return chunks.select(F.col(part).alias("part"), F.col(key).alias("key"), grp.alias("grp"), words.alias("words")).withColumn("dl", F.size("words"))


def _counts(records: DataFrame) -> DataFrame:
    """part, term, df, words: how many records hold each term; a null term counts the records of a part and their words. Summed in each batch of records before anything is moved."""
    wanted = f"part {dict(records.dtypes)['part']}, term string, df long, words long"

    def count(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0).dictionary_encode()
            of = pc.fill_null(part.indices, len(part.dictionary)).to_numpy().astype(np.int64)
            names = pa.concat_arrays([part.dictionary, pa.nulls(1, part.dictionary.type)])
            words = batch.column(1)
            sizes = np.diff(words.offsets.to_numpy())
            coded = words.flatten().dictionary_encode()
            n = len(coded.dictionary)
            here = np.unique(of)
            rows = [(pa.array(here), pa.nulls(len(here), pa.string()), np.bincount(of)[here], np.bincount(of, sizes)[here])]
            if n:
                # each term of a record once, then records by part and term
                once = np.unique(np.repeat(np.arange(batch.num_rows), sizes) * n + coded.indices.to_numpy())
                cell, df = np.unique(of[once // n] * n + once % n, return_counts=True)
                rows.append((pa.array(cell // n), coded.dictionary.take(pa.array(cell % n)), df, np.zeros(len(df))))
            for owner, term, df, total in rows:
                yield pa.RecordBatch.from_arrays([names.take(owner), term, pa.array(df.astype(np.int64)), pa.array(total.astype(np.int64))], ["part", "term", "df", "words"])

    return records.select("part", "words").mapInArrow(count, wanted).groupBy("part", "term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))


def terms_of(records: DataFrame) -> DataFrame:
    """part, term, df, n, avgdl, idf.

    The idf of terms in more than half of the records, below nought, is a
    quarter of the mean of all. The records are read once.
    """
    counts = cut_lineage(_counts(records))
    totals = counts.where("term IS NULL").select("part", F.col("df").alias("n"), (F.col("words") / F.col("df")).alias("avgdl"))
    raw = counts.where("term IS NOT NULL").select("part", "term", "df").join(totals, "part").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = raw.groupBy("part").agg((EPSILON * F.avg("raw")).alias("floor"))
    return raw.join(floor, "part").select("part", "term", "df", "n", "avgdl", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def source_fingerprint(chunks: DataFrame, part: str, key: str, text: str, group: str | None = None) -> dict[str, str]:
    """What tells whether an index still is of these chunks: their number and a hash of all, independent of their order."""
    r = chunks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(part, key, text, *([group] if group else [])).cast("decimal(38,0)")).alias("h")).first()
    return {"chunks": str(r.n), "content": str(r.h)}


def settings() -> dict:
    return {"retriever": "bm25", "tokenizer": TOKENIZER, "k1": K1, "b": B, "epsilon": EPSILON}


def build_index(chunks: DataFrame, part: str, key: str, text: str, path: str, group: str | None = None) -> dict:
    """Writes the index of ``chunks`` to ``path``: its records, its terms and, last, a manifest of the settings and of what it was built from. An index there is replaced."""
    from ledgerloom.sources import index_store

    def write(folder: str) -> None:
        records = records_of(chunks, part, key, text, group)
        records.write.parquet(f"{folder}/records")
        terms_of(chunks.sparkSession.read.parquet(f"{folder}/records")).write.parquet(f"{folder}/terms")

    return index_store.build(chunks.sparkSession, path, settings() | source_fingerprint(chunks, part, key, text, group), write)


def load_index(spark: SparkSession, path: str, expected: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, terms) of an index; one of other settings, or of other chunks than ``expected`` (``source_fingerprint``), raises an error."""
    from ledgerloom.sources import index_store

    index_store.check(spark, path, settings() | (expected or {}))
    return spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/terms")


def _blocks(rows) -> list[tuple]:
    """(part, mean length, queries, allowed, terms, weights as terms x queries) of rows (query, part, allowed, term, weight, avgdl), in blocks of bounded size."""
    asked: dict = {}
    for r in rows:
        asked.setdefault((r.part, r.query), (frozenset(r.allowed or ()), []))[1].append((r.term, r.weight, r.avgdl))
    done, being_filled = [], {}
    for (part, query), (allowed, weights) in sorted(asked.items(), key=lambda kv: (str(kv[0][0]), str(kv[0][1]))):
        weights = [w for w in weights if w[0] is not None]
        block = being_filled.get(part)
        if block is None or len(block["queries"]) >= BLOCK_QUESTIONS or len(block["terms"].keys() | {t for t, _, _ in weights}) > BLOCK_TERMS:
            block = being_filled[part] = {"part": part, "mean": 1.0, "queries": [], "allowed": [], "terms": {}, "entries": []}
            done.append(block)
        for term, weight, mean in weights:
            block["entries"].append((block["terms"].setdefault(term, len(block["terms"])), len(block["queries"]), weight))
            block["mean"] = mean
        block["queries"].append(query)
        block["allowed"].append(allowed)
    out = []
    for b in done:
        weights = np.zeros((len(b["terms"]), len(b["queries"])))
        for i, j, w in b["entries"]:
            weights[i, j] = w
        out.append((b["part"], b["mean"], b["queries"], b["allowed"], pa.array(list(b["terms"]), pa.string()), weights))
    return out


def best_of_index(records: DataFrame, terms: DataFrame, questions: DataFrame, k: int, per_group: bool = False) -> DataFrame:
    """query, key, grp, score of the best ``k`` records of each question's part, all of which are ranked: those without a term of the question score 0.

    ``questions``: query, part, question, allowed (array<string>: groups that
    count; all where it is empty or null). Groups are compared, and given, in
    upper case without padding. With ``per_group`` the best ``k`` of each group
    are kept. Ties go to the smaller key. Scores are rounded to six places.

    Questions are taken in blocks, as many at a time as ``PASS_WEIGHTS`` of their
    terms allow; a task keeps the best of its records, so ``k`` rows a task and
    question are shuffled, and never a row for each question and record. Records
    of a large part are in as many tasks as they are read by.
    """
    spark = records.sparkSession
    asked = questions.where("part IS NOT NULL").select("query", "part", F.transform(F.coalesce("allowed", F.array().cast("array<string>")), lambda f: F.upper(F.trim(f))).alias("allowed"), F.explode_outer(lexical_tokens(F.col("question"))).alias("term"))
    times = asked.groupBy("query", "part", "allowed", "term").agg(F.count(F.lit(1)).alias("times"))
    # questions are the small side: their terms cut the statistics down
    known = times.join(terms.select("part", "term", "idf", "avgdl"), ["part", "term"], "left")
    weighted = known.select("query", "part", "allowed", F.when(F.col("idf").isNotNull(), F.col("term")).alias("term"), (F.col("times") * F.col("idf") * (K1 + 1)).alias("weight"), "avgdl").persist()
    schema = f"query {dict(questions.dtypes)['query']}, key {dict(records.dtypes)['key']}, grp string, score double"
    passes = max(1, -(-weighted.count() // PASS_WEIGHTS))
    found = []
    for p in range(passes):
        rows = weighted.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == p).collect()  # about PASS_WEIGHTS
        if rows:
            found.append(_score(records, _blocks(rows), k, per_group, schema))
    weighted.unpersist()
    if not found:
        return spark.createDataFrame([], schema)
    return top_rows(reduce(DataFrame.unionByName, found), ["query", "grp"] if per_group else ["query"], [F.desc("score"), F.asc("key")], k)


def _score(records: DataFrame, blocks: list[tuple], k: int, per_group: bool, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    held = records.sparkSession.sparkContext.broadcast(blocks)
    wanted = to_arrow_schema(_parse_datatype_string(schema))
    limited = any(any(b[3]) for b in blocks)
    source = records.select("part", "key", F.upper(F.trim("grp")).alias("grp"), F.col("dl").cast("double").alias("dl"), "words")

    def run(batches):
        blocks = held.value
        by_part: dict = {}
        first, names = [], []
        for b in blocks:
            by_part.setdefault(b[0], []).append(len(first))
            first.append(len(names))
            names += b[2]
        best = Best(k, per_group)
        for batch in batches:
            parts = np.array(batch.column(0).to_pylist(), dtype=object)
            order = pc.sort_indices(batch.column(1)).to_numpy()
            for part in dict.fromkeys(parts):
                numbers = by_part.get(part)
                if not numbers:
                    continue
                # rows by ascending key, so that of equal scores the first is the one to take
                own = order[parts[order] == part]
                for at in range(0, len(own), BATCH):
                    some = batch.take(pa.array(own[at : at + BATCH]))
                    n_rows = some.num_rows
                    keys, groups, dl = np.array(some.column(1).to_pylist(), dtype=object), np.array(some.column(2).to_pylist(), dtype=object), some.column(3).to_numpy()
                    words = some.column(4)
                    row = np.repeat(np.arange(n_rows), np.diff(words.offsets.to_numpy()))
                    flat = words.flatten()
                    for n in numbers:
                        _, mean, queries, allowed, terms, weights = blocks[n]
                        if len(terms):
                            code = pc.index_in(flat, value_set=terms)
                            hit = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
                            cell = row[hit] * len(terms) + code.take(pa.array(hit)).to_numpy().astype(np.int64)
                            tf = np.bincount(cell, minlength=n_rows * len(terms)).reshape(n_rows, len(terms)).astype(np.float64)
                            scores = np.round((tf / (tf + (K1 * (1 - B + B * dl / mean))[:, None])) @ weights, 6) + 0.0
                        else:
                            scores = np.zeros((n_rows, len(queries)))
                        best.add(scores, first[n] + np.arange(len(queries)), keys, groups if limited or per_group else None, allowed if limited else None)
        kept = best.kept()
        if len(kept):
            columns = {"query": [names[i] for i in kept["query"].astype(int)], "key": kept["key"].tolist(), "grp": kept["grp"].tolist() if "grp" in kept else [None] * len(kept), "score": kept["score"].tolist()}
            yield pa.RecordBatch.from_pydict(columns, schema=wanted)

    return source.mapInArrow(run, schema)


def ranked(questions: DataFrame, chunks: DataFrame, part: str, key: str, text: str, query: str, question: str, k: int) -> DataFrame:
    """query, key, score, rank of the best ``k`` records of each question's part, over an index made for this call."""
    records = records_of(chunks, part, key, text)
    asked = questions.select(F.col(query).alias("query"), F.col(part).alias("part"), F.col(question).alias("question"), F.array().cast("array<string>").alias("allowed"))
    best = best_of_index(records, terms_of(records), asked, k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("key")))).select("query", "key", "score", "rank")
