"""Exact cosine search of a set of query vectors in all rows, in blocks, over rows or over an index that is kept."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import unit
from ledgerloom.operators.selection import top_rows
from ledgerloom.operators.topk import Best, in_order

#: Numbers in the query vectors broadcast for one pass over the rows (64 MB), and query vectors of one multiplication.
PASS_NUMBERS, QUERY_BLOCK = 8_000_000, 1024
#: Rows of a batch that are scored together.
BATCH = 1024
DOCUMENT_FORMAT = "labelled-lines-v1"


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), size)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n == 0, 1, n)


def vector_length(*tables: tuple[DataFrame, str]) -> int:
    """The length all vectors of the tables share, 0 if there are none; vectors of several lengths raise an error."""
    lengths = set()
    for df, vector in tables:
        r = df.where(F.col(vector).isNotNull()).agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
        lengths |= {x for x in r if x is not None}
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {', '.join(map(str, sorted(lengths)))}")
    return lengths.pop() if lengths else 0


def dense_top_k(rows: DataFrame, key: str, vector: str, queries: DataFrame, query: str, query_vector: str, k: int, group: str | None = None, allowed: str | None = None, per_group: bool = False) -> DataFrame:
    """query, key, score, rank[, grp] of the best ``k`` rows of each query by cosine, ties to the smaller key.

    All queries meet all rows by multiplications of blocks: as many queries at a
    time as ``PASS_NUMBERS`` allows, the blocks of ``QUERY_BLOCK`` of one pass in
    one scan of the rows. Each task keeps the best of its rows, so what is
    shuffled is ``k`` rows a task and query. With ``allowed``, an array column of
    ``queries``, only rows whose ``group`` is in it count (all, where it is
    empty); with ``per_group`` the best ``k`` of each group are kept. Rows and
    queries with a null vector take no part; vectors of different lengths raise
    an error. Scores are rounded to six places.
    """
    types = dict(rows.dtypes)
    names = ["query", "key", "score", *(["grp"] if group else [])]
    schema = f"query {dict(queries.dtypes)[query]}, key {types[key]}, score double" + (f", grp {types[group]}" if group else "")
    source = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), *([F.col(group).alias("grp")] if group else []))
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query).alias("q"), F.col(query_vector).cast("array<double>").alias("v"), *([F.col(allowed).alias("a")] if allowed else []))
    size = vector_length((source, "v"), (asked, "v"))
    total = asked.count()
    passes = -(-total * max(size, 1) // PASS_NUMBERS)
    found = []
    for p in range(passes):
        some = asked.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == p).collect()  # about a pass's size
        if some:
            found.append(_search(source, some, bool(group), bool(allowed), per_group, k, names, schema))
    if not found:
        return rows.sparkSession.createDataFrame([], schema + ", rank int")
    by = ["query", "grp"] if per_group else ["query"]
    order = [F.desc("score"), F.asc("key")]
    best = top_rows(reduce(DataFrame.unionByName, found), by, order, k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))


def _search(source, asked, grouped, limited, per_group, k, names, schema):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    size = len(asked[0].v)
    queries = [r.q for r in asked]
    held = source.sparkSession.sparkContext.broadcast((_matrix(pa.array([r.v for r in asked], pa.list_(pa.float64())), size), [frozenset(r.a or ()) for r in asked] if limited else None))
    wanted = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        q, allowed = held.value
        best = Best(k, per_group)
        for large in batches:
            for at in range(0, large.num_rows, BATCH):
                batch = in_order(large.slice(at, BATCH), "key")
                m = _matrix(batch.column(1), size)
                keys = np.array(batch.column(0).to_pylist(), dtype=object)
                groups = np.array(batch.column(2).to_pylist(), dtype=object) if grouped else None
                for b in range(0, len(q), QUERY_BLOCK):
                    numbers = np.arange(b, min(b + QUERY_BLOCK, len(q)))
                    best.add(np.round(m @ q[numbers].T, 6) + 0.0, numbers, keys, groups, allowed[b : b + QUERY_BLOCK] if limited else None)
        kept = best.kept()
        if len(kept):
            columns = {"query": [queries[i] for i in kept["query"].astype(int)], "key": kept["key"].tolist(), "score": kept["score"].tolist(), "grp": kept["grp"].tolist() if grouped else None}
            yield pa.RecordBatch.from_pydict({n: columns[n] for n in names}, schema=wanted)

    return source.mapInArrow(run, schema)


def settings(model: str) -> dict:
    return {"retriever": "dense", "embedding_model": model, "document_format": DOCUMENT_FORMAT}


def build_index(vectors: DataFrame, part: str, key: str, vector: str, path: str, model: str, source: dict, group: str | None = None) -> dict:
    """Writes part, key, grp and unit vectors of ``vectors`` to ``path`` with a manifest; null vectors and several lengths raise an error."""
    from ledgerloom.sources import index_store

    def write(folder: str) -> None:
        grp = F.col(group).cast("string") if group else F.lit(None).cast("string")
        vectors.select(F.col(part).alias("part"), F.col(key).alias("key"), grp.alias("grp"), unit(F.col(vector)).cast("array<float>").alias("vector")).write.parquet(f"{folder}/vectors")
        written = vectors.sparkSession.read.parquet(f"{folder}/vectors")
        vector_length((written, "vector"))
        if written.where("vector IS NULL").limit(1).count():
            raise ValueError("rows without a vector; the index is not replaced")

    return index_store.build(vectors.sparkSession, path, settings(model) | source, write)


def load_index(spark: SparkSession, path: str, model: str, expected: dict | None = None) -> DataFrame:
    """part, key, grp, vector of an index; one of another model, format or source than ``expected`` raises an error."""
    from ledgerloom.sources import index_store

    index_store.check(spark, path, settings(model) | (expected or {}))
    return spark.read.parquet(f"{path}/vectors")
