"""Named snapshots of tables, each with a manifest that says what it must still hash to.

A store is a folder that Spark reads, on any file system. A snapshot is staged beside its place and moved there whole;
whoever creates the store's lock first writes, and others are refused.
"""

from __future__ import annotations

import contextlib
import datetime
import json
import os
import re
import uuid

from pyspark.sql import SparkSession

from ..sources import store as files

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}")
MANIFEST = "manifest.json"


class BaselineError(Exception):
    """A snapshot that is missing, changed or badly named."""


def _place(store: str, name: str) -> str:
    if not NAME.fullmatch(name):
        raise BaselineError(f"{name!r} is no name for a baseline")
    return f"{store.rstrip('/')}/{name}"


@contextlib.contextmanager
def _locked(spark: SparkSession, store: str):
    lock = f"{store.rstrip('/')}/.lock"
    try:
        files.create(spark, lock, b"")
    except FileExistsError as error:
        raise BaselineError(f"{store} is in use") from error
    try:
        yield
    finally:
        files.remove(spark, lock)


def save(spark: SparkSession, store: str, name: str, path: str, rows: int, columns: list[str]) -> dict:
    """Copy a file (or a folder of part files) into the store; an empty table is refused."""
    place = _place(store, name)
    if not rows:
        raise BaselineError("a table without rows is no baseline")
    if os.path.islink(path):
        raise BaselineError(f"{path} is a link")
    with _locked(spark, store):
        if files.exists(spark, place):
            raise BaselineError(f"{name!r} exists")
        stage = f"{store.rstrip('/')}/.new-{uuid.uuid4().hex[:12]}"
        try:
            before, own = files.digest(spark, path), path.rstrip("/").rsplit("/", 1)[-1]
            files.copy(spark, path, f"{stage}/{own}")
            if files.digest(spark, f"{stage}/{own}") != before:
                raise BaselineError(f"{path} changed while it was copied")
            manifest = {"name": name, "file": own, "sha256": before, "rows": rows, "columns": columns, "saved": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")}
            files.create(spark, f"{stage}/{MANIFEST}", json.dumps(manifest, indent=1).encode())
            files.move(spark, stage, place)
        except BaseException:
            files.remove(spark, stage)
            raise
    return manifest


def show(spark: SparkSession, store: str, name: str) -> dict:
    path = f"{_place(store, name)}/{MANIFEST}"
    if not files.exists(spark, path):
        raise BaselineError(f"no baseline {name!r}")
    try:
        return json.loads(files.read_small(spark, path))
    except ValueError as error:
        raise BaselineError(f"no baseline {name!r}: {error}") from error


def names(spark: SparkSession, store: str) -> list[str]:
    found = files.listing(spark, store) if files.is_folder(spark, store) else []
    own = [at.rsplit("/", 1)[-1] for at, folder in found if folder and files.exists(spark, f"{at}/{MANIFEST}")]
    return [x for x in own if NAME.fullmatch(x)]


def verify(spark: SparkSession, store: str, name: str) -> str:
    """Path of the snapshot, if it is still what was saved."""
    manifest = show(spark, store, name)
    path = f"{_place(store, name)}/{manifest['file']}"
    if os.path.islink(path) or not files.exists(spark, path) or files.digest(spark, path) != manifest["sha256"]:
        raise BaselineError(f"{name!r} is not what was saved")
    return path


def delete(spark: SparkSession, store: str, name: str) -> None:
    place = _place(store, name)
    show(spark, store, name)
    with _locked(spark, store):
        files.remove(spark, place)
