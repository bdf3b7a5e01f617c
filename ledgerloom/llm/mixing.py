"""Problem 9: records of several sources mixed to target shares of all tokens.

Sizes are tokens of a public tokenizer. A source's records are put into blocks
by hash, as many as its tokens need, so that blocks of all sources are of about
one size; each pass over a source takes its blocks in a permutation of its own.
A source's quota is so many whole passes, and of the last pass the first blocks,
the block at the edge being cut between records. A splitting tree spreads the
blocks over the output shards: each node gives its left half a
multivariate-hypergeometric draw of the blocks of every source and pass, so that
each shard holds a random sample without replacement. The shards' blocks are
disjoint runs of the permuted blocks; a shard is shuffled locally.

The driver holds one row a target and pass, and the first levels of the tree;
the subtrees below are grown in tasks, and the blocks of a shard are rows of a
table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.encoding import TOKENIZER_PATH, encode_texts
from ledgerloom.session import cut_lineage

#: Sources with a target at most; more raise an error.
MAX_TARGETS = 10_000
#: Blocks that make a shard, in the mean; nodes of the tree the driver makes; parts of a pass whose tokens it looks at to find the edge.
BLOCKS_A_SHARD, DRIVER_NODES, EDGE_PARTS = 16, 256, 512


def quotas(tokens: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> tuple[int, dict[str, int]]:
    """(total, tokens of each source): its share of the total, at most max_repeats times what it has.

    Without ``total``, the tokens that the sources with a target have together.
    What a source cannot give is not filled up by others: their amounts keep the
    ratio of their shares.
    """
    if total is None:
        total = sum(tokens.get(s, 0) for s, _, _ in targets)
    return total, {s: int(min(share * total, tokens.get(s, 0) * max(repeats, 0))) for s, share, repeats in targets}


def split_node(a: int, b: int, starts: np.ndarray, counts: np.ndarray, seed: int) -> tuple[tuple, tuple]:
    """The halves (first shard, shard after the last, first block of each group, blocks of each group) of a node; the left half's blocks are drawn without replacement."""
    middle, total = (a + b) // 2, int(counts.sum())
    draw = round(total * (middle - a) / (b - a))
    left = np.random.default_rng([seed, a, b]).multivariate_hypergeometric(counts, draw, method="marginals") if total else counts
    return (a, middle, starts, left), (middle, b, starts + left, counts - left)


def split_blocks(counts: list[int], shards: int, seed: int, leaves: int | None = None) -> list[tuple]:
    """The nodes of the splitting tree over ``shards``, grown until each is one shard, or there are ``leaves`` of them; groups are those of ``counts``."""
    nodes = [(0, shards, np.zeros(len(counts), np.int64), np.array(counts, np.int64))]
    while any(b - a > 1 for a, b, _, _ in nodes) and (leaves is None or len(nodes) < leaves):
        nodes = [x for n in nodes for x in (split_node(*n, seed) if n[1] - n[0] > 1 else (n,))]
    return nodes


def _shard_blocks(spark, counts: list[int], shards: int, seed: int) -> DataFrame:
    """grp, place (of a block in the order of its group), shard."""
    top = [(int(a), int(b), starts.tolist(), n.tolist()) for a, b, starts, n in split_blocks(counts, shards, seed, DRIVER_NODES)]
    nodes = spark.createDataFrame(top, "a long, b long, starts array<long>, counts array<long>")

    def grow(frames):
        for frame in frames:
            for a, b, starts, n in frame.itertuples(index=False):
                rows, open_nodes = [], [(a, b, np.array(starts, np.int64), np.array(n, np.int64))]
                while open_nodes:
                    node = open_nodes.pop()
                    if node[1] - node[0] > 1:
                        open_nodes += split_node(*node, seed)
                        continue
                    some = np.flatnonzero(node[3])
                    rows.append(pd.DataFrame({"shard": node[0], "grp": some, "first": node[2][some], "n": node[3][some]}))
                    if len(rows) >= 1000:
                        yield pd.concat(rows)
                        rows = []
                if rows:
                    yield pd.concat(rows)

    runs = nodes.repartition(min(len(top), 64)).mapInPandas(grow, "shard long, grp long, first long, n long")
    return runs.select(F.col("grp").cast("int").alias("grp"), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("place"), F.col("shard").cast("int").alias("shard"))


def _step(n: int, seed: int, source: str, copy: int) -> tuple[int, int]:
    """Factor and shift of a permutation of n places: place = (factor * block + shift) mod n."""
    rng = np.random.default_rng([seed, copy, *source.encode()])
    while math.gcd(factor := int(rng.integers(1, max(n, 2))), n) != 1:
        pass
    return factor, int(rng.integers(0, n))


def mixture(df: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, total_tokens: int | None = None, shard_tokens: int = 1_000_000, seed: int = 3, tokenizer_path: str = TOKENIZER_PATH) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    ``targets`` has source, target_share, max_repeats; nulls there mean no
    target. Records without a source, of a source without a target, and without
    tokens (null and empty texts) are left out. Rows are told apart by their id:
    repeated rows count once. A record is used at most max_repeats times, a
    source's passes before the last use all its records. A quota is met to
    within one record. Where the targets' sources have no records, the mixture is
    empty. Ties do not arise: the order is by hash and id.

    mixture: id, source, copy_no int, tokens int, shard int, position int.
    report: source, target_share, max_repeats, available_tokens, tokens,
    actual_share, passes double, reached boolean.
    """
    spark = df.sparkSession
    some = targets.select("source", "target_share", "max_repeats").dropna().dropDuplicates(["source"]).orderBy("source").limit(MAX_TARGETS + 1).collect()
    if len(some) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS:,} sources with a target")
    wanted = [(r[0], float(r[1]), int(r[2])) for r in some]
    names = [s for s, _, _ in wanted]
    sized = encode_texts(df.where(F.col(source_col).isin(names)), id_col, text_col, tokenizer_path, "id", counts_only=True, keep=(source_col,)).withColumnRenamed(source_col, "source")
    sized = cut_lineage(sized.where("n_tokens > 0 AND id IS NOT NULL").dropDuplicates(["id"]).withColumn("h", F.xxhash64(F.lit(seed), "id")))
    # one row a target
    tokens = dict.fromkeys(names, 0) | {r.source: r.t for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    total, quota = quotas(tokens, wanted, total_tokens)
    shards = max(1, -(-sum(quota.values()) // shard_tokens))
    block_tokens = max(1, shard_tokens // BLOCKS_A_SHARD)
    blocks = {s: max(1, -(-tokens[s] // block_tokens)) for s in names}
    passes = []  # (source, copy, blocks, factor, shift, tokens of the last pass or None)
    for s in names:
        if tokens[s]:
            full, rest = divmod(quota[s], tokens[s])
            passes += [(s, c, blocks[s], *_step(blocks[s], seed, s, c), None if c < full else rest) for c in range(full + bool(rest))]
    listed = spark.createDataFrame([(i, *p[:5], p[5] is not None) for i, p in enumerate(passes)], "grp int, source string, copy_no int, blocks long, factor long, shift long, part boolean")
    # rows of the passes are few: one a target and pass
    taken = sized.join(listed, "source")
    # the product fits, as blocks are fewer than 2^31
    place = F.pmod(F.pmod(F.shiftrightunsigned("h", 8), F.col("blocks")) * F.col("factor") + F.col("shift"), F.col("blocks"))
    placed = taken.withColumn("place", place)
    whole, edges = _edges(placed, passes, block_tokens)
    counts = [p[2] if p[5] is None else whole.get(i, 0) + (i in edges) for i, p in enumerate(passes)]
    edge_rows = spark.createDataFrame([(i, place, room) for i, (place, room) in edges.items()], "grp int, edge long, room long")
    ends = spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "grp int, many long")
    used = placed.join(ends, "grp").where(F.col("place") < F.col("many")).join(edge_rows, "grp", "left")
    # of the block at an edge, one a target, the records that fit, in the order of the hash
    w = Window.partitionBy("grp").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = F.coalesce(F.col("place") == F.col("edge"), F.lit(False))
    fits = used.where(at_edge).withColumn("upto", F.sum("n_tokens").over(w)).where("upto <= room").drop("upto")
    used = used.where(~at_edge).unionByName(fits)
    used = used.join(_shard_blocks(spark, counts, shards, seed), ["grp", "place"]).select("id", "source", "copy_no", "n_tokens", "shard")
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "id", "copy_no"), "id", "copy_no")
    mixed = used.withColumn("position", F.row_number().over(local) - 1).select("id", "source", "copy_no", F.col("n_tokens").alias("tokens"), "shard", "position")
    goal = spark.createDataFrame([(s, share, repeats, tokens[s], share * total) for s, share, repeats in wanted], "source string, target_share double, max_repeats int, available_tokens long, goal double")
    reached = used.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("largest"))
    got = F.coalesce("tokens", F.lit(0))
    everything = Window.partitionBy(F.lit(1))  # one row a target
    report = goal.join(reached, "source", "left").select(
        "source", "target_share", "max_repeats", "available_tokens", got.alias("tokens"),
        F.coalesce(F.round(got / F.nullif(F.sum(got).over(everything), F.lit(0)), 6), F.lit(0.0)).alias("actual_share"),
        F.when(F.col("available_tokens") > 0, F.round(got / F.col("available_tokens"), 6)).alias("passes"),
        (got >= F.col("goal") - F.coalesce("largest", F.lit(0))).alias("reached"),
    )
    return mixed, report


def _edges(placed: DataFrame, passes: list[tuple], block_tokens: int) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
    """(whole blocks, (place of the block at the edge, tokens left for it)) of the passes that take a part of their source.

    A pass is looked at in ``EDGE_PARTS`` parts of its places, then the part with
    the edge in parts of its own, until they are blocks.
    """
    rest = {i: (0, p[2], p[5]) for i, p in enumerate(passes) if p[5]}  # (first place, places, tokens to take from there)
    whole, edges = {}, {}
    spark = placed.sparkSession
    while rest:
        size = {i: max(1, -(-n // EDGE_PARTS)) for i, (_, n, _) in rest.items()}
        looked = spark.createDataFrame([(i, first, first + n, size[i]) for i, (first, n, _) in rest.items()], "grp int, first long, after long, size long")
        some = placed.where("part").join(looked, "grp").where((F.col("place") >= F.col("first")) & (F.col("place") < F.col("after")))
        held: dict[int, dict[int, int]] = {}
        for r in some.groupBy("grp", F.floor((F.col("place") - F.col("first")) / F.col("size")).alias("part_no")).agg(F.sum("n_tokens").alias("t")).collect():
            held.setdefault(r.grp, {})[r.part_no] = r.t
        following = {}
        for i, (first, n, left) in rest.items():
            for no in range(-(-n // size[i])):
                t = held.get(i, {}).get(no, 0)
                if t > left or left == 0:
                    break
                left -= t
            else:
                whole[i] = first + n
                continue
            at = first + no * size[i]
            if left == 0 or size[i] == 1:
                whole[i] = at
                if left:
                    edges[i] = (at, left)
            else:
                following[i] = (at, min(size[i], first + n - at), left)
        rest = following
    return whole, edges
