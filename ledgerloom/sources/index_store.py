"""Indexes kept in folders: tables, and a manifest written last that says what they were built from."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession

from ledgerloom.sources.files import Files
from ledgerloom.sources.publish import fingerprint

SCHEMA_VERSION = 1


class StaleIndexError(RuntimeError):
    """The index is missing, was changed, or is of other data or settings."""


def build(spark: SparkSession, path: str, about: dict, write: Callable[[str], None]) -> dict:
    """Lets ``write`` fill a folder beside ``path``, adds the manifest, and puts the folder in the place of ``path``; a failure leaves the former index."""
    files, staged = Files(spark), f"{path.rstrip('/')}.staged"
    files.delete(staged)
    write(staged)
    body = about | {"index_schema_version": SCHEMA_VERSION}
    manifest = body | {"index_fingerprint": fingerprint(body)}
    files.write(f"{staged}/manifest.json", json.dumps(manifest, indent=2, sort_keys=True))
    files.delete(path)
    files.move(staged, path)
    return manifest


def check(spark: SparkSession, path: str, expected: dict) -> dict:
    """The manifest of the index at ``path``; an index that is missing, changed, or differs in ``expected`` raises ``StaleIndexError``."""
    try:
        said = json.loads(Files(spark).read(f"{path}/manifest.json"))
    except (FileNotFoundError, ValueError) as e:
        raise StaleIndexError(f"no readable manifest in {path}; build the index") from e
    body = {k: v for k, v in said.items() if k != "index_fingerprint"}
    if said.get("index_fingerprint") != fingerprint(body):
        raise StaleIndexError(f"the manifest of {path} was changed")
    differ = sorted(k for k, v in (expected | {"index_schema_version": SCHEMA_VERSION}).items() if body.get(k) != v)
    if differ:
        raise StaleIndexError(f"{path} differs in {', '.join(differ)}; build it again")
    return said
