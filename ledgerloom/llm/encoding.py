"""Problem 8: token ids of a whole corpus by a public byte-level BPE tokenizer.

Texts are cut into pieces by the tokenizer's pattern. The pieces a task has not
met yet are put into padded matrices of one byte length class; in each round
every row merges its leftmost pair of the lowest rank, looked up in a hashed
table of pairs, and the matrix is compacted by the merged column. Pieces longer
than the largest class are encoded by the same rule with a heap, in n log n.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import batches_of, map_arrow

TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.json"
# fixed value: the pattern of the byte-level tokenizers
PIECE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = np.int32(2**31 - 1)
LONGEST_CLASS = 512
CACHE_PIECES = 200_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files of byte-level tokenizers."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def load_vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of the 256 bytes; of each merge in order of rank: its two ids and its result."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return (
        np.array([vocab[c] for _, c in sorted(byte_letters().items())], np.int32),
        np.array([[vocab[a], vocab[b]] for a, b in pairs], np.int32).reshape(-1, 2),
        np.array([vocab[a + b] for a, b in pairs], np.int32),
    )


class PieceEncoder:
    def __init__(self, byte_ids: np.ndarray, pairs: np.ndarray, merged: np.ndarray):
        self.byte_ids, self.merged = byte_ids, np.append(merged, -1).astype(np.int32)
        bits = max(10, int(len(pairs)).bit_length() + 4)
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NO_RANK, np.int32)
        self.probes = 1
        for rank, (a, b) in enumerate(pairs.tolist()):
            key, probe = a << 32 | b, 0
            at = int(self._slots(np.array([key], np.int64))[0])
            while self.keys[at] != -1:
                at, probe = (at + 1) & self.mask, probe + 1
            self.keys[at], self.ranks[at] = key, rank
            self.probes = max(self.probes, probe + 1)
        self.by_pair = None
        self.pairs = pairs

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_RANK where it is none or padding."""
        keys = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        at = self._slots(keys)
        out = np.full(keys.shape, NO_RANK, np.int32)
        for _ in range(self.probes):
            hit = self.keys[at] == keys
            out[hit] = self.ranks[at][hit]
            at = (at + 1) & self.mask
        out[(left < 0) | (right < 0)] = NO_RANK
        return out

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in pieces]
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) > LONGEST_CLASS:
                out[i] = self._encode_long(p)
            elif p:
                classes.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, where in classes.items():
            step = max(1, 2_000_000 // width)
            for a in range(0, len(where), step):
                self._encode_class([pieces[i] for i in where[a : a + step]], width, where[a : a + step], out)
        return out

    def _encode_class(self, pieces: list[bytes], width: int, where: list[int], out: list[list[int]]) -> None:
        m = np.full((len(pieces), width), -1, np.int32)
        lengths = np.array([len(p) for p in pieces])
        m[np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rank, row = self._rank(m[:, :-1], m[:, 1:]), np.array(where)
        while len(m):
            at = rank.argmin(axis=1)
            lowest = rank[np.arange(len(m)), at]
            done = lowest == NO_RANK
            if done.any():
                for i, ids in zip(row[done].tolist(), m[done], strict=True):
                    out[i] = ids[ids >= 0].tolist()
                m, rank, row, at, lowest = m[~done], rank[~done], row[~done], at[~done], lowest[~done]
                if not len(m):
                    break
            lines, w = np.arange(len(m)), m.shape[1]
            m[lines, at] = self.merged[lowest]
            # each row gives up the column behind its merge
            keep = np.arange(w) != (at + 1)[:, None]
            m = m[keep].reshape(len(m), w - 1)
            if w == 2:
                rank = np.full((len(m), 1), NO_RANK, np.int32)
                m = np.concatenate([m, np.full((len(m), 1), -1, np.int32)], axis=1)
                continue
            rank = rank[np.arange(w - 1) != at[:, None]].reshape(len(m), w - 2)
            right = at < w - 2
            rank[lines[right], at[right]] = self._rank(m[lines[right], at[right]], m[lines[right], at[right] + 1])
            left = at > 0
            rank[lines[left], at[left] - 1] = self._rank(m[lines[left], at[left] - 1], m[lines[left], at[left]])

    def _encode_long(self, piece: bytes) -> list[int]:
        if self.by_pair is None:
            self.by_pair = {(a, b): r for r, (a, b) in enumerate(self.pairs.tolist())}
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, by_pair = len(ids), self.by_pair
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := by_pair.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], k = int(self.merged[r]), -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (s := by_pair.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (s, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (s := by_pair.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (s, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]


class TextEncoder:
    """Encodes lists of texts; keeps the ids of pieces it has met, up to a bound."""

    def __init__(self, vocabulary, pattern: str = PIECE_PATTERN):
        import regex

        self.find = regex.compile(pattern).findall
        self.pieces = PieceEncoder(*vocabulary)
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.find(t) if t else [] for t in texts]
        known = self.known
        if len(known) > CACHE_PIECES:
            known.clear()
        new = list({p for pieces in cut for p in pieces if p not in known})
        long = {p for p in new if len(p) > 64}
        known.update(zip(new, self.pieces.encode([p.encode("utf-8", "replace") for p in new]), strict=True))
        out = []
        for pieces in cut:
            ids: list[int] = []
            for p in pieces:
                ids += known[p]
            out.append(ids)
        for p in long:
            del known[p]
        return out


def encode_texts(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str = TOKENIZER_PATH, id_name: str = "doc_id", counts_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The token ids of each text, without special tokens.

    Empty and null texts have an empty list. The strings of special tokens are
    ordinary text. Repeated rows are kept: one row a row, in any column but
    those of ``keep`` ignored. Texts of any length are encoded whole.

    Returns the id as ``id_name``, ids array<int> or, with ``counts_only``,
    n_tokens int, and the columns of ``keep``.
    """
    # bounded by the vocabulary, about 50,000 merges
    vocabulary = df.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer_path))
    source = df.select(F.col(id_col).alias(id_name), F.col(text_col).cast("string").alias("__text"), *keep)
    kinds = dict(source.dtypes)
    what = "n_tokens int" if counts_only else "ids array<int>"
    schema = f"`{id_name}` {kinds[id_name]}, {what}" + "".join(f", `{c}` {kinds[c]}" for c in keep)

    def run(batches):
        encoder = TextEncoder(vocabulary.value)
        for large in batches:
            for part in batches_of(large, 500):
                ids = encoder.encode(part.column(1).to_pylist())
                sizes = [len(x) for x in ids]
                if counts_only:
                    made = pa.array(sizes, pa.int32())
                else:
                    flat = np.fromiter((t for x in ids for t in x), np.int32, sum(sizes))
                    made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), made, *(part.column(2 + i) for i in range(len(keep)))], [id_name, what.split()[0], *keep])

    return map_arrow(source, run, schema)
