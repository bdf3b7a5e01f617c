"""Places for services of embedding, answering and judging; none is called unless one is given.

A provider is a function from a list of texts to a list of results. It runs on
the executors, a batch at a time, with bounded retries and a time limit; a
text that fails has an error instead of a result, never made-up values.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, TimeoutError

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _once(provider: Callable[[list[str]], list], texts: list[str], timeout: float) -> list:
    """One call, given up after ``timeout`` seconds."""
    with_limit = ThreadPoolExecutor(1)
    try:
        out = list(with_limit.submit(provider, texts).result(timeout))
    except TimeoutError:
        raise TimeoutError(f"no result in {timeout:g} s") from None
    finally:
        with_limit.shutdown(wait=False, cancel_futures=True)
    if len(out) != len(texts):
        raise ValueError(f"{len(out)} results for {len(texts)} texts")
    return out


def call(provider: Callable[[list[str]], list], texts: list[str], retries: int = 3, wait: float = 0.0, timeout: float = 60.0) -> tuple[list, list[str | None]]:
    """(results, errors) of the texts; where a batch fails to the last retry, each of its texts is asked for once alone, so that one bad text costs no other."""
    error = None
    for attempt in range(retries + 1):
        try:
            return _once(provider, texts, timeout), [None] * len(texts)
        except Exception as e:  # noqa: BLE001 whatever a service raises is the row's error
            error = f"{type(e).__name__}: {e}"[:160]
            time.sleep(wait * attempt)
    if len(texts) == 1:
        return [None], [error]
    results, errors = [], []
    for text in texts:
        r, e = call(provider, [text], 0, wait, timeout)
        results += r
        errors += e
    return results, errors


def apply_provider(df: DataFrame, text_col: str, result: str, result_type: str, provider: Callable[[list[str]], list] | None, batch: int = 50, timeout: float = 60.0) -> DataFrame:
    """Adds ``result``, ``result_status`` (ok, error, not_run) and ``result_error``; null texts and a missing provider are ``not_run``."""
    status, error = f"{result}_status", f"{result}_error"
    if provider is None:
        return df.withColumns({result: F.lit(None).cast(result_type), status: F.lit("not_run"), error: F.lit(None).cast("string")})

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].copy()
                has = part[text_col].notna()
                values, said = call(provider, part.loc[has, text_col].tolist(), timeout=timeout) if has.any() else ([], [])
                part[result], part[status], part[error] = None, "not_run", None
                part[result] = pd.Series(values, index=part.index[has], dtype=object).reindex(part.index)
                part.loc[has, status] = ["error" if e else "ok" for e in said]
                part.loc[has, error] = said
                yield part

    return df.mapInPandas(run, df.withColumns({result: F.lit(None).cast(result_type), status: F.lit(None).cast("string"), error: F.lit(None).cast("string")}).schema)


def answer_text(blocks: list[str]) -> str:
    """The non-blank blocks of an answer, joined; an answer without any is an error."""
    kept = [b.strip() for b in blocks if b and b.strip()]
    if not kept:
        raise ValueError("the answer has no text")
    return "\n".join(kept)
