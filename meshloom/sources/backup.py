"""Backups of a folder of solver cases, and their restoring, as Spark jobs.

Files are copied by tasks, a row a file, with the digest of the bytes that were read. A backup is put together under a name of its own
and takes its final name when its manifest stands in it, so a copy that was broken off is never a backup. A restore copies the
backup's files beside the folder, compares the digests of the copies with the manifest, and only then lets the copy take the
folder's place; a case with any fault is left as it is. Each step runs again safely: copies go to names of their own
and are moved whole.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import cut
from . import store

#: What a backup's folder adds to the name of the folder that it keeps, and the manifest in it.
SUFFIX, MANIFEST = ".kept", "manifest.jsonl"
FILES = "case_id string, file string, sha256 string, length long"


def _per_case(cases: DataFrame, fn: Callable[[object, str, str], list[tuple]], root: str, schema: str) -> DataFrame:
    """fn(fs, root, case_id) gives rows; a case is a row's work, and cases are dealt over the tasks."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = store.opened(root)
        for b in batches:
            for case in b["case_id"]:
                yield pd.DataFrame(fn(fs, base, case), columns=names).astype(object)

    return cases.select("case_id").distinct().mapInPandas(run, schema)


def _listed(cases: DataFrame, root: str, folder: str) -> DataFrame:
    """case_id, file and length of the files in a folder of each case; contents are not read."""

    def run(fs, base: str, case: str) -> list[tuple]:
        return [(case, n, size) for n, size in store.files_below(f"{base}/{case}/{folder}") if n != MANIFEST]

    return _per_case(cases, run, root, "case_id string, file string, length long")


def _copied(files: DataFrame, root: str, source: str, target: str) -> DataFrame:
    """FILES of what was copied from each case's folder `source` to `target`, by many tasks for a case."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = store.opened(root)
        for b in batches:
            rows = []
            for case, name in zip(b["case_id"], b["file"]):
                to = f"{base}/{case}/{target}/{name}"
                fs.create_dir(to.rsplit("/", 1)[0])
                part = f"{to}.{uuid.uuid4().hex}"
                digest, n = store.copy(fs, f"{base}/{case}/{source}/{name}", part)
                fs.move(part, to)
                rows.append((case, name, digest, n))
            yield pd.DataFrame(rows, columns=["case_id", "file", "sha256", "length"])

    return cut(files.select("case_id", "file").repartition("case_id", "file").mapInPandas(run, FILES), "copied")


def manifests(cases: DataFrame, root: str, folder: str = "0") -> DataFrame:
    """FILES as the backups' manifests say; a case without a backup has no row."""

    def run(fs, base: str, case: str) -> list[tuple]:
        path = f"{base}/{case}/{folder}{SUFFIX}/{MANIFEST}"
        if not store.exists(fs, path):
            return []
        with fs.open_input_stream(path) as f:
            rows = [json.loads(line) for line in f.read().splitlines()]
        return [(case, r["file"], r["sha256"], r["length"]) for r in rows]

    return _per_case(cases, run, root, FILES)


def _digests(files: DataFrame, root: str, folder: str) -> DataFrame:
    """files with `now`: the digest of the file as it stands in the folder, null if it is missing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = store.opened(root)
        for b in batches:
            paths = [f"{base}/{c}/{folder}/{n}" for c, n in zip(b["case_id"], b["file"])]
            yield b.assign(now=[store.sha256(fs, p) if store.exists(fs, p) else None for p in paths])

    return files.repartition("case_id", "file").mapInPandas(run, FILES + ", now string")


def faults(cases: DataFrame, root: str, folder: str = "0", of: str | None = None) -> DataFrame:
    """case_id, file, fault: no backup, missing and changed files of backups (of the folder `of` instead, if given)."""
    told = manifests(cases, root, folder)
    bad = _digests(told, root, of or folder + SUFFIX).where(~F.col("sha256").eqNullSafe(F.col("now")))
    none = cases.select("case_id").distinct().join(told.select("case_id").distinct(), "case_id", "left_anti")
    return bad.select("case_id", "file", F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("fault")).unionByName(none.select("case_id", F.lit(None).cast("string").alias("file"), F.lit("no backup").alias("fault")))


def make(cases: DataFrame, root: str, folder: str = "0") -> DataFrame:
    """case_id, status of backups of a folder of each case (column case_id): made, kept (an older one, found whole), or faulty
    (an older one that is not; it is left). Runs now."""
    todo = cut(cases.select("case_id").distinct(), "cases")
    faulty = cut(faults(todo, root, folder).groupBy("case_id").agg(F.min("fault").alias("fault")), "faults")
    new = faulty.where("fault = 'no backup'")
    part = f"{folder}{SUFFIX}.{uuid.uuid4().hex}"
    copied = _copied(_listed(new, root, folder), root, folder, part)

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        fs, base = store.opened(root)
        case = rows["case_id"].iloc[0]
        at, final = f"{base}/{case}/{part}", f"{base}/{case}/{folder}{SUFFIX}"
        if store.exists(fs, at):  # else an earlier run of this task has moved it
            body = "".join(json.dumps({"file": r.file, "sha256": r.sha256, "length": int(r.length)}) + "\n" for r in rows.sort_values("file").itertuples())
            with fs.open_output_stream(f"{at}/{MANIFEST}") as f:
                f.write(body.encode())
            fs.move(at, final)
        return pd.DataFrame({"case_id": [case], "status": ["made"]})

    made = cut(copied.groupBy("case_id").applyInPandas(finish, "case_id string, status string"), "made")
    rest = todo.join(made, "case_id", "left_anti").join(faulty, "case_id", "left")
    return made.unionByName(rest.select("case_id", F.when(F.col("fault").isNull(), "kept").when(F.col("fault") == "no backup", "nothing to keep").otherwise("faulty").alias("status")))


def restore(cases: DataFrame, root: str, folder: str = "0") -> DataFrame:
    """case_id, status: restored, or what is against it; such a case is left as it is. Runs now."""
    todo = cut(cases.select("case_id").distinct(), "cases")
    bad = cut(faults(todo, root, folder).groupBy("case_id").agg(F.min("fault").alias("fault")), "faults")
    sound = todo.join(bad, "case_id", "left_anti")
    told = cut(manifests(sound, root, folder), "manifest")
    part = f"{folder}.{uuid.uuid4().hex}"
    copied = _copied(told, root, folder + SUFFIX, part)
    # A copy counts if each of its files has the manifest's digest.
    same = told.join(copied.select("case_id", "file", F.col("sha256").alias("got")), ["case_id", "file"], "left")
    verdict = same.groupBy("case_id").agg(F.bool_and(F.col("sha256").eqNullSafe(F.col("got"))).alias("whole"))

    def swap(rows: pd.DataFrame) -> pd.DataFrame:
        fs, base = store.opened(root)
        case, whole = rows["case_id"].iloc[0], bool(rows["whole"].iloc[0])
        at, final, old = f"{base}/{case}/{part}", f"{base}/{case}/{folder}", f"{base}/{case}/{part}.old"
        if not whole:
            store.drop_folder(fs, at)
        elif store.exists(fs, at):
            if store.exists(fs, final):
                fs.move(final, old)
            fs.move(at, final)
        store.drop_folder(fs, old)
        return pd.DataFrame({"case_id": [case], "status": ["restored" if whole else "changed while it was copied"]})

    done = cut(verdict.groupBy("case_id").applyInPandas(swap, "case_id string, status string"), "restored")
    return done.unionByName(bad.select("case_id", F.col("fault").alias("status")))
