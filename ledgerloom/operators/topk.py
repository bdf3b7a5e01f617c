"""The best k rows of many queries in one pass over the rows: what a task keeps of its batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Kept candidates of a task, above which all but the best k of each query are dropped.
KEPT_ROWS = 400_000


def in_order(batch: pa.RecordBatch, key: str) -> pa.RecordBatch:
    """The rows by ascending key, so that of equal scores the first is the one to take."""
    return batch.take(pc.sort_indices(batch, sort_keys=[(key, "ascending")]))


class Best:
    """Of each query, and each group of rows where ``per_group`` holds, the best ``k`` rows; equal scores go to the smaller key."""

    def __init__(self, k: int, per_group: bool):
        self.k, self.by = k, ["query", "grp"] if per_group else ["query"]
        self.per_group, self.parts, self.rows = per_group, [], 0

    def add(self, scores: np.ndarray, queries: np.ndarray, keys: np.ndarray, groups: np.ndarray | None, allowed: list[frozenset] | None) -> None:
        """``scores`` is rows x queries, rows by ascending key; ``queries`` are their numbers; ``allowed``, by the column of ``scores``, the groups that count, all where empty."""
        if groups is None:
            self._take(scores, queries, keys, None)
            return
        held = np.array([None if isinstance(g, float) and g != g else g for g in groups], dtype=object)
        some = list(dict.fromkeys(held))
        fits = lambda j, g: not allowed or not allowed[j] or g in allowed[j]
        if self.per_group:
            for g in some:
                columns = np.array([j for j in range(len(queries)) if fits(j, g)], np.int64)
                rows = np.flatnonzero(np.array([x == g or x is g for x in held]))
                self._take(scores[np.ix_(rows, columns)], queries[columns], keys[rows], held[rows])
            return
        if allowed:
            number = {g: i for i, g in enumerate(some)}
            open_to = np.array([[fits(j, g) for j in range(len(queries))] for g in some])
            scores = np.where(open_to[[number[g] for g in held]], scores, -np.inf)
        self._take(scores, queries, keys, held)

    def _take(self, scores, queries, keys, groups):
        if not scores.size:
            return
        best = np.argsort(-scores, axis=0, kind="stable")[: self.k]
        found = np.take_along_axis(scores, best, axis=0)
        place, column = np.nonzero(found > -np.inf)
        rows = best[place, column]
        part = {"query": queries[column], "score": found[place, column], "key": keys[rows]}
        if groups is not None:
            part["grp"] = groups[rows]
        self.parts.append(pd.DataFrame(part))
        self.rows += len(rows)
        if self.rows > KEPT_ROWS:
            self.parts = [self.kept()]
            self.rows = len(self.parts[0])

    def kept(self) -> pd.DataFrame:
        if not self.parts:
            return pd.DataFrame({"query": [], "score": [], "key": []})
        rows = pd.concat(self.parts, ignore_index=True).sort_values(["query", "score", "key"], ascending=[True, False, True], kind="stable")
        return rows[rows.groupby(self.by, sort=False, dropna=False).cumcount() < self.k]
