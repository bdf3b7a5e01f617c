"""Problem 5: records that share most of their runs of words.

LSH forest. Each distinct set of word runs (a class of records) has one minhash
signature; each tree sorts the classes by its own values of it. Classes with a
common prefix are neighbours in that order and candidates: at a prefix of three
values in regions of up to ``REGION`` classes; in denser ones, which are handed
on as they stream by, at four. A region that is still dense is cut into blocks
that are compared block with block, in tasks of their own, as a deeper prefix
would lose links. Neighbours are compared by vector operations on a sketch of 128
bits that the sorted rows carry; the few that are close enough are checked
exactly on their texts.

At similarity 0.7 a tree finds a pair with probability 0.34 at a prefix of
three, eighteen trees with 0.9994; in dense regions, at four, with 0.993. The
sketch drops about one pair in 60,000 at 0.7.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import batches_of, map_arrow, record_key
from ledgerloom.operators.chunking import distinct_rows
from ledgerloom.session import cut_lineage

TREES, DEPTH, SKETCH_BITS = 18, 4, 128
#: Hash functions: every tree has values of its own; the sketch takes another bit of each.
HASHES = max(TREES * DEPTH, SKETCH_BITS)
WORD = "[a-z0-9]+"
SIGNATURE = "k string, h long, c1 long, c2 long, s1 long, s2 long, trees array<struct<hi: bigint, lo: int>>"
#: Classes of a region that one task compares.
REGION = 4096
#: Prefixes that may hold more than about one row in 6,000 are known before rows are moved: at most so many, by a summary of so many counters.
HOT_PREFIXES, HOT_COUNTERS = 2000, 8192
#: Ids of texts to read that may be broadcast (8 bytes each), and half as many classes of copies (16 bytes each); beyond, rows meet by a shuffle.
BROADCAST_IDS = 4_000_000
#: Copies of a class that one task joins with the others.
COPIES = 512


_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True

_BYTES = np.arange(1, 257, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Signer:
    """Signatures of the sets of word runs of many texts at once, by operations on the bytes of all of them."""

    def __init__(self, run: int, min_words: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.run, self.min_words = run, max(min_words, run)
        self.a = (rng.integers(0, 2**31, HASHES, np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 2**32, HASHES, np.uint32)
        self.places = _mixed(np.arange(256, dtype=np.uint64)) | np.uint64(1)
        self.held = np.empty((256, HASHES), np.uint32)

    def runs(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the lower-cased texts in ``data`` that end at ``ends``: (those with enough words, a 64-bit number for each run, where each text's runs begin, and their end)."""
        inside = _IN_WORD[data]
        inside_before = np.concatenate([[False], inside[:-1]])
        inside_before[ends[:-1][ends[:-1] < len(data)]] = False  # words end with their text
        starts = np.flatnonzero(inside & ~inside_before)
        if not len(starts):
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(1, np.int64)
        where = np.flatnonzero(inside)
        word = np.cumsum(inside & ~inside_before)[where] - 1
        # a word's number: its bytes, each multiplied by a number of its place
        place = where - starts[word]
        far = place >= len(self.places)
        place = np.where(far, _mixed(place.astype(np.uint64)) | np.uint64(1), self.places[np.where(far, 0, place)]) if far.any() else self.places[place]
        first = np.searchsorted(where, starts)
        h = _mixed(np.add.reduceat(_BYTES[data[where]] * place, first))
        text = np.searchsorted(ends, starts, "right")
        counts = np.bincount(text, minlength=len(ends))
        n = len(h) - self.run + 1
        x = np.zeros(max(n, 0), np.uint64)
        for i in range(self.run):
            x = _mixed(x * np.uint64(3) + h[i : i + n])
        keep = (text[: len(x)] == text[self.run - 1 :]) & (counts[text[: len(x)]] >= self.min_words)
        texts = np.flatnonzero(counts >= self.min_words)
        return texts, x[keep], np.concatenate([[0], np.cumsum(counts[texts] - self.run + 1)])

    def sign(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """c1, c2, the prefixes of three values (with the tree in the first bits) and fourth values by tree, and the sketch of the texts whose runs begin at ``at``.

        The class is the sum of mixed numbers of all runs: texts with the same
        runs as often share it. Equal sets with other numbers of repeats are found
        as neighbours.
        """
        c1, c2 = (np.add.reduceat(_mixed(x ^ np.uint64(k)), at[:-1]).view(np.int64) for k in (0x51ED27, 0xA0761D6478BD642F))
        low = (x >> np.uint64(32)).astype(np.uint32)[:, None]
        v = np.full((len(at) - 1, HASHES), 2**32 - 1, np.uint32)
        for i in range(len(at) - 1):
            for j in range(at[i], at[i + 1], len(self.held)):
                part = low[j : min(j + len(self.held), at[i + 1])]
                held = np.multiply(part, self.a, out=self.held[: len(part)])
                np.minimum(v[i], np.add(held, self.b, out=held).min(axis=0), out=v[i])
        sketch = np.packbits(((v[:, :SKETCH_BITS] >> np.uint32(3)) & np.uint32(1)).astype(np.uint8), axis=1).view(np.int64)
        value = (v[:, : TREES * DEPTH] ^ (v[:, : TREES * DEPTH] >> np.uint32(15))).reshape(len(v), TREES, DEPTH).astype(np.uint64)
        low = lambda i, bits: value[:, :, i] & np.uint64((1 << bits) - 1)
        hi = np.arange(TREES, dtype=np.uint64) << np.uint64(59) | low(0, 19) << np.uint64(40) | low(1, 20) << np.uint64(20) | low(2, 20)
        return c1, c2, hi.view(np.int64), low(3, 16).astype(np.int32), sketch[:, 0], sketch[:, 1]


def similarity(a: str, b: str, run: int) -> float:
    """Of the distinct runs of ``run`` words in the two texts, the share that both have."""
    find = re.compile(WORD).findall

    def sets(t):
        w = find(t.lower())
        return set(zip(*(w[i:] for i in range(run)), strict=False))

    x, y = sets(a), sets(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 0.0


def close_neighbours(group: np.ndarray, ids: np.ndarray, s1: np.ndarray, s2: np.ndarray, differ: int) -> np.ndarray:
    """Places (i < j) of rows of the same group whose sketches differ in at most ``differ`` bits; rows are sorted by group."""
    n, pairs, step = len(group), [], 0
    at = np.arange(n - 1) if n > 1 else np.empty(0, np.int64)
    # unsigned: of a negative number the bits of its magnitude would be counted
    s1, s2 = s1.astype(np.int64).view(np.uint64), s2.astype(np.int64).view(np.uint64)
    while len(at):
        step += 1
        at = at[at + step < n]
        at = at[group[at] == group[at + step]]
        near = at[np.bitwise_count(s1[at] ^ s1[at + step]) + np.bitwise_count(s2[at] ^ s2[at + step]) <= differ]
        near = near[ids[near] != ids[near + step]]
        if len(near):
            pairs.append(np.stack([near, near + step], axis=1))
    return np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)


def signatures(df: DataFrame, id_col: str, text_col: str, run: int, min_words: int) -> DataFrame:
    """One row per record that takes part: its key, a hash of its text, its class (c1, c2), its sketch and its place in every tree."""
    text = F.lower(F.col(text_col).cast("string"))
    texts = df.where(F.col(text_col).isNotNull()).select(record_key(id_col, text_col).alias("k"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), text.alias("t"))

    def sign(batches):
        signer = Signer(run, min_words)
        for large in batches:
            for batch in batches_of(large, 256):
                column = batch.column(2).cast(pa.large_binary())
                _, offsets, data = column.buffers()
                ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
                if not data or ends[-1] == ends[0]:
                    continue
                some, x, at = signer.runs(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends[1:] - ends[0])
                if not len(some):
                    continue
                c1, c2, hi, lo, s1, s2 = signer.sign(x, at)
                place = pa.StructArray.from_arrays([pa.array(hi.ravel()), pa.array(lo.ravel())], ["hi", "lo"])
                trees = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * TREES), place)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), batch.column(1).take(pa.array(some)), pa.array(c1), pa.array(c2), pa.array(s1), pa.array(s2), trees], ["k", "h", "c1", "c2", "s1", "s2", "trees"])

    return cut_lineage(map_arrow(texts, sign, SIGNATURE))


def _allowed_bits(threshold: float) -> int:
    mean = SKETCH_BITS * (1 + threshold) / 2
    return int(SKETCH_BITS - mean + 4.2 * (mean * (1 - threshold) / 2) ** 0.5)


def candidates(signed: DataFrame, threshold: float, region: int = REGION) -> DataFrame:
    """Pairs of classes (a < b, by c1) that some tree makes neighbours and whose sketches are close."""
    differ = _allowed_bits(threshold)
    # of the classes with several records one row is taken; the others, mostly all, stay where they are
    several = signed.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c1", "c2")
    several = cut_lineage(several)
    if several.count() <= BROADCAST_IDS // 2:
        several = F.broadcast(several)
    alone = signed.join(several, ["c1", "c2"], "left_anti").select("c1", "s1", "s2", "trees")
    one = alone.unionByName(signed.join(several, ["c1", "c2"], "left_semi").groupBy("c1", "c2").agg(F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("trees").alias("trees")).select("c1", "s1", "s2", "trees"))
    trees = one.select(F.col("c1").alias("id"), "s1", "s2", F.inline("trees"))
    # prefixes so frequent that their region would be a great part of all rows go to the dense ones at once
    top = signed.select(F.explode("trees.hi").alias("hi")).agg(F.expr(f"approx_top_k(hi, {HOT_PREFIXES}, {HOT_COUNTERS})").alias("x")).first().x
    hot = [r["item"] for r in top or [] if r["count"] > region]
    is_hot = F.col("hi").isin(hot) if hot else F.lit(False)

    def compare(batches):
        """Pairs of each region (rows by ascending hi); the rows of a region above the limit are handed on."""

        def out(a, b, hi, lo, s1, s2):
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "hi": pa.array(hi, pa.int64()), "lo": pa.array(lo, pa.int32()), "s1": pa.array(s1, pa.int64()), "s2": pa.array(s2, pa.int64())})

        def judged(rows):
            hi = rows["hi"]
            starts = np.flatnonzero(np.concatenate([[True], hi[1:] != hi[:-1]]))
            dense = np.repeat(np.diff(np.append(starts, len(hi))) > region, np.diff(np.append(starts, len(hi))))
            if dense.any():
                on = {c: v[dense] for c, v in rows.items()}
                yield out(on["id"], [None] * len(on["id"]), on["hi"], on["lo"], on["s1"], on["s2"])
                rows = {c: v[~dense] for c, v in rows.items()}
            p = close_neighbours(rows["hi"], rows["id"], rows["s1"], rows["s2"], differ)
            if len(p):
                x, y = rows["id"][p[:, 0]], rows["id"][p[:, 1]]
                none = [None] * len(p)
                yield out(np.minimum(x, y), np.maximum(x, y), none, none, none, none)

        held, passing = None, None
        for batch in batches:
            rows = {c: batch.column(i).to_numpy() for i, c in enumerate(batch.schema.names)}
            if passing is not None:
                # the rest of a region that is handed on
                same = int(np.searchsorted(rows["hi"], passing, "right"))
                if same:
                    yield out(rows["id"][:same], [None] * same, rows["hi"][:same], rows["lo"][:same], rows["s1"][:same], rows["s2"][:same])
                    rows = {c: v[same:] for c, v in rows.items()}
                if not len(rows["hi"]):
                    continue
                passing = None
            if held is not None:
                rows = {c: np.concatenate([held[c], v]) for c, v in rows.items()}
            hi = rows["hi"]
            if not len(hi):
                continue
            cut = int(np.searchsorted(hi, hi[-1], "left"))
            held = {c: v[cut:] for c, v in rows.items()}
            if cut:
                yield from judged({c: v[:cut] for c, v in rows.items()})
            if len(held["hi"]) > region:
                yield from judged(held)
                passing, held = held["hi"][-1], None
        if held is not None:
            yield from judged(held)

    ordered = trees.where(~is_hot).select("hi", "lo", "id", "s1", "s2").repartition("hi").sortWithinPartitions("hi")
    first = cut_lineage(map_arrow(ordered, compare, "a long, b long, hi long, lo int, s1 long, s2 long"))
    pairs = first.where("b IS NOT NULL").select("a", "b")
    dense = first.where("b IS NULL").select("hi", "lo", F.col("a").alias("id"), "s1", "s2")
    if hot:
        dense = dense.unionByName(trees.where(is_hot).select("hi", "lo", "id", "s1", "s2"))
    if hot or not dense.isEmpty():
        pairs = pairs.unionByName(_dense_pairs(cut_lineage(dense), differ, region))
    return pairs.distinct()


def _dense_pairs(dense: DataFrame, differ: int, region: int) -> DataFrame:
    """Close pairs of classes with four common values; more than ``region`` of them are cut into blocks, and each two blocks compared in a group of their own."""
    sizes = dense.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hi", "lo", F.ceil(F.col("n") / region).cast("int").alias("blocks"))
    placed = dense.join(sizes, ["hi", "lo"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sent = placed.select("hi", "lo", "id", "s1", "s2", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = sent.select(F.xxhash64("hi", "lo", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "id", "s1", "s2", "own", (F.col("own") == F.col("other")).alias("inner"))

    def compare(batches):
        def pairs_of(rows):
            p = close_neighbours(rows["g"], rows["id"], rows["s1"], rows["s2"], differ)
            # pairs of one block are those of its own group
            p = p[(rows["own"][p[:, 0]] != rows["own"][p[:, 1]]) | rows["inner"][p[:, 0]]]
            x, y = rows["id"][p[:, 0]], rows["id"][p[:, 1]]
            return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})

        held = None
        for batch in batches:
            rows = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
            if held is not None:
                rows = {c: np.concatenate([held[c], v]) for c, v in rows.items()}
            g = rows["g"]
            if not len(g):
                continue
            # a group, of at most about two blocks, may go on in the next batch
            cut = int(np.searchsorted(g, g[-1], "left"))
            held = {c: v[cut:] for c, v in rows.items()}
            if cut:
                yield pairs_of({c: v[:cut] for c, v in rows.items()})
        if held is not None:
            yield pairs_of(held)

    return map_arrow(tiles.repartition("g").sortWithinPartitions("g"), compare, "a long, b long")


def similar_classes(df: DataFrame, id_col: str, text_col: str, threshold: float, run: int, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(records with their class, links between classes: a, b, similarity), both kept."""
    signed = signatures(df, id_col, text_col, run, min_words)
    members = distinct_rows(signed.select("k", "h", "c1", "c2"), "k")
    pairs = cut_lineage(candidates(signed, threshold))
    # one record's text stands for its class, read for the classes in question only
    asked = pairs.select(F.explode(F.array("a", "b")).alias("c1")).distinct()
    chosen = cut_lineage(signed.select("k", "h", "c1", "c2").join(asked, "c1", "left_semi").groupBy("c1", "c2").agg(F.min(F.struct("k", "h")).alias("m")).select("c1", "c2", "m.*"))
    texts = df.where(F.col(text_col).isNotNull()).select(record_key(id_col, text_col).alias("k"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("t"))
    if chosen.count() <= BROADCAST_IDS:
        # few texts are left before they are moved
        texts = texts.join(F.broadcast(chosen.select("h").distinct()), "h", "left_semi")
    read = cut_lineage(texts.join(chosen, ["k", "h"]).groupBy("c1", "c2").agg(F.first("t").alias("t")))
    side = lambda s: read.select(F.col("c1").alias(s), F.col("c2").alias(f"{s}2"), F.col("t").alias(f"t{s}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "a2", "b", "b2", "ta", "tb")

    def check(batches):
        for batch in batches:
            kept, said = [], []
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                if (s := similarity(x, y, run)) >= threshold:
                    kept.append(i)
                    said.append(s)
            part = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(said, pa.float64())], ["a", "a2", "b", "b2", "similarity"])

    links = map_arrow(joined, check, "a long, a2 long, b long, b2 long, similarity double")
    return members.select("k", "c1", "c2").distinct(), cut_lineage(links)


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.7, run: int = 3, min_words: int = 60) -> DataFrame:
    """Every pair of records whose similarity reaches ``threshold``.

    The similarity is, of the distinct runs of ``run`` words in the two texts,
    the share that both have; a word is a maximal run of a-z and 0-9 in the
    lower-cased text. Texts under ``min_words`` words, empty and null ones take
    no part. Repeated rows of an id count once, two texts of one id each for
    itself; rows without an id are told apart by their text and have keys that begin with a null character. An empty table
    gives no rows. The result holds all pairs within groups of equal records, as
    its form demands; ``near_duplicate_groups`` does not.

    Returns id_a, id_b (a < b as strings), similarity.
    """
    members, links = similar_classes(df, id_col, text_col, threshold, run, min_words)
    counted = members.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / COPIES).cast("int")).drop("n")
    # the copies of a class meet in blocks: each with all of one block, by a key of their own
    copies = members.join(counted, ["c1", "c2"])
    left = copies.select("c1", "c2", F.col("k").alias("id_a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = copies.select("c1", "c2", F.col("k").alias("id_b"), F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int").alias("block"))
    same = left.join(right, ["c1", "c2", "block"]).where("id_a < id_b").select("id_a", "id_b", F.lit(1.0).alias("similarity"))
    near = links.join(members.select(F.col("c1").alias("a"), F.col("c2").alias("a2"), F.col("k").alias("x")), ["a", "a2"]).join(members.select(F.col("c1").alias("b"), F.col("c2").alias("b2"), F.col("k").alias("y")), ["b", "b2"])
    pairs = same.unionByName(near.where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity"))
    return pairs.groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))


def connected(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of links (a, b): alternating large and small stars, kept each round."""
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    measure = lambda e: e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    before = measure(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(edges.groupBy("u").agg(F.min("v").alias("v"))).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        after = measure(edges)
        if after == before:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before = after


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.7, run: int = 3, min_words: int = 60) -> DataFrame:
    """One row per record that takes part: its group and the links of its class.

    Equal sets of runs form a class; classes linked at ``threshold``, directly
    or over others, form a group, named by its least key. Copies are not expanded
    into pairs. Nulls and repeats as in ``near_duplicate_pairs``.

    Returns item_id, group_id, class_size bigint, class_links bigint.
    """
    members, links = similar_classes(df, id_col, text_col, threshold, run, min_words)
    name = lambda *c: F.concat_ws(" ", *c)
    links = links.select(name("a", "a2").alias("a"), name("b", "b2").alias("b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("class_links"))
    keyed = members.withColumn("c", name("c1", "c2"))
    classes = keyed.groupBy("c").agg(F.count(F.lit(1)).alias("class_size"), F.min("k").alias("least"))
    classes = classes.join(connected(links), F.col("c") == F.col("node"), "left").withColumn("root", F.coalesce("root", "c")).join(degree, "c", "left")
    names = classes.groupBy("root").agg(F.min("least").alias("group_id"))
    described = classes.join(names, "root").select("c", "group_id", "class_size", F.coalesce("class_links", F.lit(0)).cast("long").alias("class_links"))
    return keyed.join(described, "c").select(F.col("k").alias("item_id"), "group_id", "class_size", "class_links")
