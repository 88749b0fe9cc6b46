"""polyMesh directories as tables: points, faces, owner, neighbour and patches, from ascii or binary files."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MeshError(ValueError):
    """A mesh file that contradicts itself."""


def header(data: bytes) -> dict[str, str]:
    """The entries of the FoamFile block; quoted values may hold semicolons."""
    block = re.search(rb"FoamFile\s*\{(.*?)\n\s*\}", data, re.S)
    if block is None:
        raise MeshError("no FoamFile block")
    return {m[1].decode(): (m[2] or m[3]).decode().strip() for m in re.finditer(rb'(\w+)\s+(?:"([^"]*)"|([^;"]*))\s*;', block[1])}


def types(entries: dict[str, str]) -> tuple[np.dtype, np.dtype]:
    """Label and scalar types by the declared architecture."""
    arch = entries.get("arch", "LSB;label=32;scalar=64")
    found = dict(p.split("=") for p in arch.split(";") if "=" in p)
    order = "<" if arch.startswith("LSB") else ">" if arch.startswith("MSB") else None
    if order is None or found.get("label") not in ("32", "64") or found.get("scalar") not in ("32", "64"):
        raise MeshError(f"unknown architecture {arch!r}")
    return np.dtype(f"{order}i{int(found['label']) // 8}"), np.dtype(f"{order}f{int(found['scalar']) // 8}")


def _body(data: bytes) -> bytes:
    end = re.search(rb"FoamFile\s*\{.*?\n\s*\}", data, re.S).end()
    return data[end:]


def _lists(body: bytes, dtype: np.dtype, binary: bool, per: int) -> Iterator[np.ndarray]:
    """The counted lists of a body: n ( ... )."""
    at = 0
    while (m := re.compile(rb"(?:\s|//[^\n]*\n|/\*.*?\*/)*(\d+)\s*\(", re.S).match(body, at)) is not None:
        n = int(m[1]) * per
        if binary:
            size = n * dtype.itemsize
            if len(body) < m.end() + size + 1 or body[m.end() + size : m.end() + size + 1] != b")":
                raise MeshError("a binary list has another length than declared")
            yield np.frombuffer(body, dtype, n, m.end())
            at = m.end() + size + 1
        else:
            end = re.compile(rb"\n\s*\)").search(body, m.end())
            stop = end.start() if end else body.rindex(b")")
            out = np.array(re.sub(rb"[()]", b" ", body[m.end() : stop]).split(), np.float64)
            if len(out) != n:
                raise MeshError(f"{len(out)} values, declared {n}")
            yield out.astype(dtype)
            at = end.end() if end else len(body)


def points(data: bytes) -> np.ndarray:
    h = header(data)
    return next(_lists(_body(data), types(h)[1], h.get("format") == "binary", 3)).astype(np.float64).reshape(-1, 3)


def labels(data: bytes) -> np.ndarray:
    h = header(data)
    return next(_lists(_body(data), types(h)[0], h.get("format") == "binary", 1)).astype(np.int64)


def faces(data: bytes) -> list[np.ndarray]:
    """Vertex ids of each face, from a faceList or a faceCompactList."""
    h = header(data)
    if h.get("class") == "faceCompactList" or h.get("format") == "binary":
        offsets, flat = (x.astype(np.int64) for x in _lists(_body(data), types(h)[0], h.get("format") == "binary", 1))
        if len(offsets) and (offsets[0] != 0 or offsets[-1] != len(flat) or (np.diff(offsets) < 0).any()):
            raise MeshError("face offsets do not fit the vertex list")
        return [flat[a:b] for a, b in zip(offsets, offsets[1:])]
    body = _body(data)
    n = int(re.search(rb"(\d+)\s*\(", body)[1])
    out = [np.array(m[2].split(), np.int64) for m in re.finditer(rb"(\d+)\(([\d\s]+)\)", body)]
    if len(out) != n:
        raise MeshError(f"{len(out)} faces, declared {n}")
    return out


def patches(data: bytes) -> list[tuple[str, str, int, int]]:
    """name, type, nFaces, startFace; comments do not count, nor do patches between processors."""
    text = re.sub(r"//[^\n]*", "", _body(data).decode())
    out = []
    for m in re.finditer(r"([\w.\-]+)\s*\{(.*?)\}", text, re.S):
        entry = dict(re.findall(r"(\w+)\s+([^;]+);", m[2]))
        if "nFaces" in entry and not m[1].startswith("procBoundary"):
            out.append((m[1], entry.get("type", "").strip(), int(entry["nFaces"]), int(entry["startFace"])))
    return out


_READERS = {
    "points": (lambda d: pd.DataFrame(points(d), columns=["x", "y", "z"]).rename_axis("point_id").reset_index(), "point_id long, x double, y double, z double"),
    "faces": (lambda d: pd.DataFrame({"vertices": [v.tolist() for v in faces(d)]}).rename_axis("face_id").reset_index(), "face_id long, vertices array<long>"),
    "owner": (lambda d: pd.DataFrame({"cell_id": labels(d)}).rename_axis("face_id").reset_index(), "face_id long, cell_id long"),
    "neighbour": (lambda d: pd.DataFrame({"cell_id": labels(d)}).rename_axis("face_id").reset_index(), "face_id long, cell_id long"),
    "boundary": (lambda d: pd.DataFrame(patches(d), columns=["name", "type", "n_faces", "start_face"]), "name string, type string, n_faces long, start_face long"),
}


def read(spark: SparkSession, root: str, what: str) -> DataFrame:
    """One of points, faces, owner, neighbour, boundary of every mesh below root, with its case_id (the path of
    the case folder below root). A file is one task's work; meshes are read side by side."""
    parse, schema = _READERS[what]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for case, content in zip(b["case_id"], b["content"]):
                out = parse(bytes(content))
                out.insert(0, "case_id", case)
                yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", what).option("recursiveFileLookup", "true").load(root)
    case = F.regexp_extract("path", r"([^/]+)/constant/polyMesh/[^/]+$", 1).alias("case_id")
    return files.where(F.col("path").rlike(r"/constant/polyMesh/[^/]+$")).select(case, "content").mapInPandas(run, f"case_id string, {schema}")


#: Components of a field's rows, by the type that its file declares.
WIDTHS = {"scalar": 1, "vector": 3, "symmTensor": 6}
FIELDS = "field string, time double, cell_id long, value array<double>"


def internal_field(data: bytes) -> tuple[bool, np.ndarray]:
    """Whether the internal field is uniform, and its rows (one if it is)."""
    h, body = header(data), _body(data)
    m = re.search(rb"internalField\s+(uniform|nonuniform)\s+(?:List<(\w+)>\s*)?", body)
    if m is None:
        raise MeshError("no internalField")
    if m[1] == b"uniform":
        value = re.sub(rb"[()]", b" ", body[m.end() : body.index(b";", m.end())]).split()
        return True, np.array([value], np.float64)
    width = WIDTHS.get((m[2] or b"").decode())
    if width is None:
        raise MeshError(f"a field of {m[2]!r}")
    rows = next(_lists(body[m.end() :], types(h)[1], h.get("format") == "binary", width), None)
    if rows is None:
        raise MeshError("the internal field has no list")
    return False, rows.astype(np.float64).reshape(-1, width)


def read_fields(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """case_id, field, time, cell_id (null for a uniform field: all cells), value of the named fields of every case and
    time folder below root."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for case, name, time, content in zip(b["case_id"], b["field"], b["time"], b["content"]):
                uniform, rows = internal_field(bytes(content))
                for at in range(0, len(rows), 50_000):
                    part = rows[at : at + 50_000]
                    cells = pd.array([None] if uniform else range(at, at + len(part)), dtype="Int64")
                    yield pd.DataFrame({"case_id": case, "field": name, "time": time, "cell_id": cells, "value": part.tolist()})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(names) + "}").load(root)
    part = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)$", i)
    rows = files.select(part(1).alias("case_id"), part(3).alias("field"), part(2).alias("raw"), "content").withColumn("time", F.expr("try_cast(raw as double)")).where(F.col("time").isNotNull())
    return rows.select("case_id", "field", "time", "content").mapInPandas(run, f"case_id string, {FIELDS}")
