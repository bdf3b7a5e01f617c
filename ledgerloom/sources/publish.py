"""Durable results on the file system that their paths name: manifests, atomic writes, publication with rollback, pruning."""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid

from pyspark.sql import SparkSession

from ledgerloom.sources.files import Files


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def write_manifest(spark: SparkSession, path: str, settings: dict) -> dict:
    made = settings | {"manifest_fingerprint": fingerprint(settings)}
    Files(spark).write(path, json.dumps(made, indent=2, sort_keys=True, ensure_ascii=False))
    return made


def check_manifest(spark: SparkSession, path: str, expected: dict) -> dict:
    """The manifest, if it is whole and has the expected settings; else an error that names the differing ones."""
    said = json.loads(Files(spark).read(path))
    body = {k: v for k, v in said.items() if k != "manifest_fingerprint"}
    if said.get("manifest_fingerprint") != fingerprint(body):
        raise ValueError(f"{path} was changed after it was written")
    differ = sorted(k for k, v in expected.items() if body.get(k) != v)
    if differ:
        raise ValueError(f"{path} differs in: {', '.join(differ)}")
    return said


def inside(path: str) -> str:
    """A path below a root, without steps out of it."""
    plain = posixpath.normpath(path)
    if plain.startswith(("/", "..")) or "://" in path:
        raise ValueError(f"{path} lies outside the folder")
    return plain


def publish(spark: SparkSession, staged: dict[str, str]) -> None:
    """Moves each staged file or folder to its target, all or none: on failure what was replaced is put back."""
    files, token, done = Files(spark), uuid.uuid4().hex, []
    try:
        for source, target in staged.items():
            parent, name = posixpath.split(target.rstrip("/"))
            backup = f"{parent}/_{name}.{token}"
            had = files.exists(target)
            if had:
                files.move(target, backup)
            done.append((target, backup, had))
            files.move(source, target)
    except BaseException:
        for target, backup, had in reversed(done):
            if files.exists(target):
                files.delete(target)
            if had:
                files.move(backup, target)
        raise
    for _, backup, had in done:
        if had:
            files.delete(backup)


def prune(spark: SparkSession, root: str, referenced: list[str]) -> list[str]:
    """Deletes the files of ``root`` that nothing refers to, by paths below it, nor to a folder that holds them; returns them. A reference outside ``root`` stops it before anything is deleted."""
    keep = {inside(r) for r in referenced}
    files = Files(spark)
    kept = lambda p: p in keep or any(p.startswith(f"{k}/") for k in keep)
    gone = [p for p, _ in files.files(root) if not kept(p)]
    for p in gone:
        files.delete(f"{root}/{p}")
    return gone


def refuse_existing(spark: SparkSession, *paths: str) -> None:
    found = [p for p in paths if Files(spark).exists(p)]
    if found:
        raise FileExistsError(f"already there: {', '.join(found)}")


def markdown_table(columns: list[str], rows: list[tuple]) -> str:
    if not rows:
        return "_No rows._"
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    line = lambda r: "| " + " | ".join(map(cell, r)) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *map(line, rows)])
