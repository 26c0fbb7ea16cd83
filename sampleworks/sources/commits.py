"""Commits of table versions on a file system: unique names, a head that one writer moves, and numbers given out once.

Everything rests on one step: a file is made under a name that isn't taken, whole, or not at all. A commit writes rows, then the
body, then claims the next place in the list of heads; who comes second takes its own files away again and is told of the
conflict. So a head always names a whole version, whichever writer stops where. A request with a fingerprint that was
committed before gives the version it gave then.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sampleworks.sources.tables import read_body, read_version, sanitized, write_version

NAMES = 10_000  # tried before giving up


class Conflict(RuntimeError):
    """The head isn't what a commit was made for; nothing was committed."""


@dataclass(frozen=True)
class Head:
    """A committed version: its place in the list of heads, its path, and the fingerprint of the request."""

    number: int
    version: str
    fingerprint: str | None


def _system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def claimed(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with a text under a name that isn't taken. False if it is; the file appears whole."""
    jvm = spark._jvm
    target, system = _system(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".draft-{uuid.uuid4().hex}")
    out = system.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if system.getScheme() == "file":  # here a rename would replace what is there
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(target), local(draft))
        elif not system.rename(draft, target):
            return False
    except Exception as error:
        if "AlreadyExists" in str(error):
            return False
        raise
    finally:
        system.delete(draft, False)
    return True


def claim_number(spark: SparkSession, folder: str, text: str = "") -> int:
    """The next number of a folder, from 1, given to one caller only."""
    target, system = _system(spark, folder)
    system.mkdirs(target)
    number = max((int(s.getPath().getName()) for s in system.listStatus(target) if s.getPath().getName().isdigit()), default=0) + 1
    while not claimed(spark, f"{folder}/{number:08d}", text):
        number += 1
    return number


def unique_path(spark: SparkSession, tables: str, name: str) -> str:
    """A path for a new version under ``tables``: the name, or with ``_1``, ``_2`` ... behind it if taken. It is reserved at once; a
    reservation that nothing came of isn't used again."""
    for i in range(NAMES):
        path = f"{tables}/{sanitized(name if not i else f'{name}_{i}')}"
        target, system = _system(spark, path)
        system.mkdirs(target)
        if not system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")) and claimed(spark, f"{path}/_reserved", ""):
            return path
    raise FileExistsError(f"no free name like {name!r}")


def derive(parent: str, df: DataFrame, tables: str, op: str, *, name: str | None = None, args: dict | None = None, **more) -> str:
    """Write a version made of another by an operation, under a name of its own; nothing is claimed."""
    spark = df.sparkSession
    base = read_body(spark, parent)["base_name"]
    path = unique_path(spark, tables, name or f"{base}_{op}")
    return write_version(df, path, parents=[parent], producer={"op": op, "args": args or {}, **more}, base_name=base)


def create_root(df: DataFrame, tables: str, name: str, *, description: str = "") -> str:
    """Write a version without parents, under a name of its own."""
    return write_version(df, unique_path(df.sparkSession, tables, name), producer={"op": "create", "args": {}}, description=description)


def squash(spark: SparkSession, version: str, tables: str, *, name: str | None = None) -> str:
    """A copy of a version with its history left behind: no parents, and a base name of its own."""
    body = read_body(spark, version)
    path = unique_path(spark, tables, name or f"{version.rpartition('/')[2]}_squashed")
    return write_version(read_version(spark, version), path, producer={"op": "squash", "args": {"from": version}}, description=body["description"])


def heads(spark: SparkSession, folder: str) -> list[Head]:
    """The committed versions of a data set in order. The list is as long as the data set has been committed."""
    target, system = _system(spark, folder)
    if not system.exists(target):
        return []
    names = sorted(s.getPath().getName() for s in system.listStatus(target) if s.getPath().getName().isdigit())
    if not names:
        return []
    rows = spark.read.schema("number int, version string, fingerprint string").json([f"{folder}/{n}" for n in names]).collect()
    return sorted((Head(r.number, r.version, r.fingerprint) for r in rows), key=lambda h: h.number)


def start(spark: SparkSession, folder: str, version: str) -> Head:
    """Make a version the first head of a data set."""
    _system(spark, folder)[1].mkdirs(_system(spark, folder)[0])
    if not claimed(spark, f"{folder}/{0:08d}", json.dumps({"number": 0, "version": version, "fingerprint": None})):
        raise Conflict("the data set has a head")
    return Head(0, version, None)


def commit(df: DataFrame, folder: str, tables: str, *, expected: str, fingerprint: str | None = None, op: str = "edit", name: str | None = None, args: dict | None = None) -> Head:
    """Write ``df`` as the next version after ``expected``, which must be the head. A fingerprint committed before gives that version."""
    spark = df.sparkSession
    known = heads(spark, folder)
    again = next((h for h in known if fingerprint is not None and h.fingerprint == fingerprint), None)
    if again is not None:
        return again
    if not known or known[-1].version != expected:
        raise Conflict(f"the head is {known[-1].version if known else None}, not {expected}")
    path = derive(expected, df, tables, op, name=name, args=args, commit=fingerprint)
    number = known[-1].number + 1
    if not claimed(spark, f"{folder}/{number:08d}", json.dumps({"number": number, "version": path, "fingerprint": fingerprint})):
        for part in ("body.json", "rows"):  # the body first, so no catalog lists what is half gone
            target, system = _system(spark, f"{path}/{part}")
            system.delete(target, True)
        raise Conflict(f"another commit came first after {expected}")
    return Head(number, path, fingerprint)


def commit_change(spark: SparkSession, folder: str, tables: str, change: Callable[[DataFrame], DataFrame], *, fingerprint: str | None = None, op: str = "edit", tries: int = 5) -> Head:
    """Apply a change to whatever the head is, again after each conflict: for changes that fit any version."""
    for left in reversed(range(tries)):
        known = heads(spark, folder)
        if not known:
            raise Conflict("the data set has no head")
        try:
            return commit(change(read_version(spark, known[-1].version)), folder, tables, expected=known[-1].version, fingerprint=fingerprint, op=op)
        except Conflict:
            if not left:
                raise
    raise AssertionError("unreachable")

