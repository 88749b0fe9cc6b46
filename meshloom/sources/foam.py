"""Mesh and field files of solver cases as a Spark data source that cuts files into pieces, and a writer that puts fields back.

    foam.register(spark)
    points = foam.read(spark, root, "points")          # faces, owner, neighbour too
    fields = foam.read(spark, root, "field", names="U,p")

The format `foam` gives the records of each piece of a file: case_id (the path of the case below the root), name (of the file),
time (null for the mesh), piece, at (the number in the piece), base (of the piece's first record; null in text), n (as the
file declares; null for a uniform field, which is one record) and the record: value or labels. Binary files are cut between
records and know their numbers. Text files are cut anywhere; a record belongs to the piece in which it begins. Its
number needs the counts of the pieces before it, which `read` adds up in Spark from a scan that only counts (a schema without
value and labels). What follows a list in a text file has numbers beyond the declared count and is dropped; too few
records are an error.

Writing takes case_id, field, cell_id and value. A field's file is copied with a new internal field, in its own format; its other
entries stay byte for byte. New files stand under names of their own until all tasks have ended; only then they take the
places of the old ones, so a failed or killed job leaves a case as it was.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from .polymesh import MeshError, header, types
from .store import Spool, chunks, exists, files_below, opened, sweep

HEAD = 1 << 16
#: Components of a field's records by the name in the file.
WIDTHS = {"scalar": 1, "vector": 3, "symmTensor": 6, "tensor": 9}
_COUNT = re.compile(rb"(?:\s|//[^\n]*\n|/\*.*?\*/)*(\d+)\s*\(", re.S)
_GROUP = re.compile(rb"\(([^()]*)\)")
SCHEMA = "case_id string, name string, time double, piece int, at long, base long, n long, "


@dataclass
class Place:
    """Where the records of a file stand: `begin` is the first byte behind the list's bracket."""

    binary: bool
    dtype: np.dtype
    width: int
    n: int | None
    begin: int
    uniform: list[float] | None = None
    keyword: int = 0
    more: int = 0  # faces in binary: where the vertex list begins


def _skip_count(fs, path: str, at: int) -> tuple[int, int]:
    m = _COUNT.match(next(chunks(fs, path, at, at + HEAD), b""))
    if m is None:
        raise MeshError(f"{path}: no counted list")
    return int(m[1]), at + m.end()


def locate(fs, path: str, table: str) -> Place:
    """From the head of a file, which is all that is read of it."""
    head = next(chunks(fs, path, 0, HEAD, HEAD), b"")
    entries = header(head)
    at = re.search(rb"FoamFile\s*\{.*?\n\s*\}", head, re.S).end()
    binary, (label, scalar) = entries.get("format") == "binary", types(entries)
    if table == "field":
        m = re.compile(rb"internalField\s+(uniform|nonuniform)\s+(?:List<(\w+)>\s*)?").search(head, at)
        if m is None:
            raise MeshError(f"{path}: no internalField")
        if m[1] == b"uniform":
            stop = head.index(b";", m.end())
            value = [float(x) for x in re.sub(rb"[()]", b" ", head[m.end() : stop]).split()]
            return Place(binary, scalar, len(value), None, stop + 1, value, m.start())
        kind = (m[2] or b"").decode()
        if kind not in WIDTHS:
            raise MeshError(f"{path}: a field of {kind!r}")
        n, begin = _skip_count(fs, path, m.end())
        return Place(binary, scalar, WIDTHS[kind], n, begin, keyword=m.start())
    n, begin = _skip_count(fs, path, at)
    if table == "points":
        return Place(binary, scalar, 3, n, begin)
    if table == "faces" and (binary or entries.get("class") == "faceCompactList"):
        if not binary:
            raise MeshError(f"{path}: a compact face list in text is read by polymesh.read")
        return Place(True, label, 0, n - 1, begin, more=_skip_count(fs, path, begin + n * label.itemsize + 1)[1])
    return Place(binary, label, 0 if table == "faces" else 1, n, begin)


class Piece(InputPartition):
    def __init__(self, path: str, case_id: str, name: str, time: float | None, number: int, lo: int, hi: int, place: Place):
        self.path, self.case_id, self.name, self.time, self.number, self.lo, self.hi, self.place = path, case_id, name, time, number, lo, hi, place


class FoamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "foam"

    def schema(self) -> str:
        return SCHEMA + ("value array<double>" if self.options.get("table", "points") in ("points", "field") else "labels array<long>")

    def reader(self, schema: StructType) -> DataSourceReader:
        return FoamReader(self.options["path"], self.options.get("table", "points"), self.options.get("names", ""), int(self.options.get("bytes", 8 << 20)), schema, self.options.get("pattern", "*"))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FieldWriter(self.options["path"], self.options.get("time", "0"), schema)


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


class FoamReader(DataSourceReader):
    def __init__(self, root: str, table: str, names: str, size: int, schema: StructType, pattern: str):
        self.root, self.table, self.names, self.size, self.schema, self.pattern = root, table, names.split(",") if names else [], size, schema, pattern

    def _files(self) -> Iterator[tuple[str, str, float | None, str]]:
        """case_id, name, time and path below the root."""
        for path, _ in files_below(self.root, self.pattern):
            parts = path.split("/")
            if self.table == "field":
                time = _number(parts[-2]) if len(parts) > 1 else None
                if time is not None and parts[-1] in self.names:
                    yield "/".join(parts[:-2]), parts[-1], time, path
            elif parts[-3:] == ["constant", "polyMesh", self.table]:
                yield "/".join(parts[:-3]), parts[-1], None, path

    def partitions(self) -> list[InputPartition]:
        fs, root = opened(self.root)
        out = []
        for case, name, time, path in self._files():
            full = f"{root}/{path}"
            place = locate(fs, full, self.table)
            if place.uniform is not None:
                cuts = [(0, 1)]
            elif place.binary:
                step = max(1, self.size // (max(1, place.width) * place.dtype.itemsize))
                cuts = [(a, min(a + step, place.n)) for a in range(0, place.n, step)]
            else:
                size = fs.get_file_info(full).size
                cuts = [(a, min(a + self.size, size)) for a in range(place.begin, size, self.size)]
            out += [Piece(full, case, name, time, k, lo, hi, place) for k, (lo, hi) in enumerate(cuts)]
        return out or [Piece("", "", "", None, 0, 0, 0, Place(True, np.dtype("i4"), 1, 0, 0))]  # Spark asks for one at least

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.root)
        place, wanted = piece.place, [f.name for f in self.schema]
        only_count = not {"value", "labels"} & {*wanted}
        if place.uniform is not None:
            records = [place.uniform]
        elif place.binary:
            records = _binary(fs, piece, self.table == "faces")
        else:
            records = _text(fs, piece, self.table in ("points", "faces") or place.width > 1, only_count, self.table == "field" or self.table == "points")
        n = records if isinstance(records, int) else len(records)
        same = lambda v, t: pa.array([v] * n, t)
        columns = {"case_id": same(piece.case_id, pa.string()), "name": same(piece.name, pa.string()), "time": same(piece.time, pa.float64()), "piece": same(piece.number, pa.int32()), "at": pa.array(np.arange(n, dtype=np.int64)),
                   "base": same(piece.lo if place.binary or place.uniform is not None else None, pa.int64()), "n": same(place.n, pa.int64())}
        for c, t in (("value", pa.float64()), ("labels", pa.int64())):
            if c in wanted:
                columns[c] = _lists(records, t)
        yield pa.RecordBatch.from_arrays([columns[c] for c in wanted], wanted)


def _lists(records, kind: pa.DataType) -> pa.Array:
    if isinstance(records, np.ndarray):
        n, w = records.shape
        flat = pa.array(records.ravel().astype(np.float64 if pa.types.is_floating(kind) else np.int64))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), flat)
    return pa.array(records, pa.list_(kind))


def _binary(fs, piece: Piece, faces: bool):
    place = piece.place
    size = place.dtype.itemsize

    def read(at: int, lo: int, hi: int) -> np.ndarray:
        data = b"".join(chunks(fs, piece.path, at + lo * size, at + hi * size))
        if len(data) != (hi - lo) * size:
            raise MeshError(f"{piece.path}: {place.n} records are declared, the file ends before")
        return np.frombuffer(data, place.dtype)

    if faces:
        edges = read(place.begin, piece.lo, piece.hi + 1).astype(np.int64)
        if (np.diff(edges) < 0).any():
            raise MeshError(f"{piece.path}: face offsets go back")
        flat = read(place.more, int(edges[0]), int(edges[-1])).astype(np.int64) if len(edges) else edges
        return [flat[a:b] for a, b in zip(edges - edges[0], edges[1:] - edges[0])]
    return read(place.begin, piece.lo * place.width, piece.hi * place.width).reshape(-1, place.width)


def _text(fs, piece: Piece, groups: bool, only_count: bool, floats: bool):
    """Records that begin in the piece; for a count alone their number."""
    if groups:
        data = b"".join(chunks(fs, piece.path, piece.lo, piece.hi))
        last = data.rfind(b"(")
        if last >= 0 and b")" not in data[last:]:  # the last record goes on behind the piece
            for more in chunks(fs, piece.path, piece.hi, size=4096):
                data += more
                if b")" in more:
                    break
        found = [m[1] for m in _GROUP.finditer(data) if m.start() < piece.hi - piece.lo]
    else:
        lead = next(chunks(fs, piece.path, piece.lo - 1, piece.lo), b" ")
        data = b"".join(chunks(fs, piece.path, piece.lo, piece.hi))
        if data and not data[-1:].isspace():
            tail = next(chunks(fs, piece.path, piece.hi, piece.hi + 64), b"")
            data += re.split(rb"\s", tail, maxsplit=1)[0]
        found = data.split()
        if found and not (lead.isspace() or lead == b"(") and not data[:1].isspace():
            found = found[1:]  # it began in the piece before
    if only_count:
        return len(found)
    out = []
    for record in found:
        try:
            out.append(np.array(record.split(), np.float64 if floats else np.int64))
        except ValueError:  # behind the list: it has a number beyond the count, or the count will not be reached
            out.append(None)
    return out


KEYS = ["case_id", "name", "time"]


def records(spark: SparkSession, root: str, table: str, names: str = "", size: int = 8 << 20, pattern: str = "*") -> DataFrame:
    """case_id, name, time, id (null for a uniform field) and value or labels of every record of a table's files, of those whose path below
    the root fits the pattern (the parts of a divided case are cases of their own)."""
    source = lambda: spark.read.format("foam").option("table", table).option("names", names).option("bytes", size).option("pattern", pattern)
    rows = source().load(root)
    of_file = Window.partitionBy(*KEYS)
    counts = source().schema("case_id string, name string, time double, piece int, n long, base long").load(root).where("base is null").groupBy(*KEYS, "piece").agg(F.count("*").alias("held"), F.first("n").alias("declared"))
    before = counts.select(*[F.col(k).alias(f"c_{k}") for k in KEYS], F.col("piece").alias("c_piece"), (F.sum("held").over(of_file.orderBy("piece")) - F.col("held")).alias("before"), F.sum("held").over(of_file).alias("total"))
    near = F.col("piece") == F.col("c_piece")
    for k in KEYS:
        near = near & F.col(k).eqNullSafe(F.col(f"c_{k}"))
    told = rows.join(before, near, "left").withColumn("id", F.when(F.col("n").isNotNull(), F.coalesce("base", "before") + F.col("at")))
    short = F.col("total") < F.col("n")
    fault = F.raise_error(F.concat(F.lit("a list of "), F.col("n"), F.lit(" records ends early: "), F.concat_ws("/", "case_id", "name")))
    kept = told.where(F.col("id").isNull() | (F.col("id") < F.col("n"))).withColumn("id", F.when(short, fault.cast("long")).otherwise(F.col("id")))
    return kept.select(*KEYS, "id", rows.columns[-1])


def read(spark: SparkSession, root: str, table: str, names: str = "", size: int = 8 << 20, pattern: str = "*") -> DataFrame:
    """points: case_id, point_id, x, y, z; faces: case_id, face_id, vertices; owner, neighbour: case_id, face_id, cell_id;
    field: case_id, field, time, cell_id (null: every cell), value."""
    register(spark)
    d = records(spark, root, table, names, size, pattern)
    if table == "points":
        return d.select("case_id", F.col("id").alias("point_id"), *[F.col("value")[i].alias(c) for i, c in enumerate("xyz")])
    if table == "field":
        return d.select("case_id", F.col("name").alias("field"), "time", F.col("id").alias("cell_id"), "value")
    of = F.col("labels").alias("vertices") if table == "faces" else F.col("labels")[0].alias("cell_id")
    return d.select("case_id", F.col("id").alias("face_id"), of)


# --- writing ------------------------------------------------------------------------------------------------------
@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def _end_of_field(fs, path: str, place: Place) -> int:
    """The first byte behind the internal field's semicolon."""
    if place.uniform is not None:
        return place.begin
    if place.binary:
        at = place.begin + place.n * place.width * place.dtype.itemsize
        tail = next(chunks(fs, path, at, at + HEAD), b"")
        return at + tail.index(b";") + 1
    close, at, held = re.compile(rb"\)\s*;"), place.begin - 1, b""
    for part in chunks(fs, path, at):
        held += part
        if (m := close.search(held)) is not None:
            return at + m.end()
        at, held = at + len(held) - min(len(held), 256), held[-256:]
    raise MeshError(f"{path}: the internal field has no end")


def replace_field(fs, template: str, target: str, spool: Spool, n: int) -> None:
    """A copy of a field file with another internal field of n records."""
    place = locate(fs, template, "field")
    declared = header(next(chunks(fs, template, 0, HEAD, HEAD), b"")).get("class", "")
    kind = next((k for k in WIDTHS if declared.lower() == f"vol{k}field".lower()), None)
    if kind is None:
        raise MeshError(f"{template}: class {declared!r} holds no cell values")
    if n and spool.width != WIDTHS[kind]:
        raise MeshError(f"{template}: values of {spool.width} components for a {kind}")
    if place.n is not None and place.n != n:
        raise MeshError(f"{template}: {n} values for {place.n} cells")
    with fs.open_output_stream(target) as out:
        for part in chunks(fs, template, 0, place.keyword):
            out.write(part)
        out.write(f"internalField   nonuniform List<{kind}> \n{n}\n(".encode() + (b"" if place.binary else b"\n"))
        for lo in range(0, n, 10_000):
            rows = np.frombuffer(spool.rows(lo, min(lo + 10_000, n)), "<f8").reshape(-1, WIDTHS[kind])
            if place.binary:
                out.write(rows.astype(place.dtype).tobytes())
            else:
                line = (lambda r: f"({' '.join(map(repr, r))})\n") if WIDTHS[kind] > 1 else (lambda r: f"{r[0]!r}\n")
                out.write("".join(map(line, rows.tolist())).encode())
        out.write(b")\n;")
        for part in chunks(fs, template, _end_of_field(fs, template, place)):
            out.write(part)


class FieldWriter(DataSourceWriter):
    def __init__(self, root: str, time: str, schema: StructType):
        if not {"case_id", "field", "cell_id", "value"} <= {f.name for f in schema}:
            raise MeshError("case_id, field, cell_id and value are needed")
        self.root, self.time, self.job = root, time, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        fs, root = opened(self.root)
        done: list[tuple[str, str]] = []
        now, spool, n = None, None, 0

        def close() -> None:
            folder, field = f"{root}/{now[0]}/{self.time}", now[1]
            path = f"{folder}/.{field}.{self.job}.{uuid.uuid4().hex}"
            replace_field(fs, f"{folder}/{field}", path, spool, n)
            done.append((path, f"{folder}/{field}"))

        for row in iterator:
            key = row["case_id"], row["field"]
            if key != now:
                if now is not None:
                    close()
                now, spool, n = key, Spool(), 0
                if any(f.base_name.startswith("processor") for f in fs.get_file_info(_selector(f"{root}/{key[0]}"))):
                    raise MeshError(f"{key[0]}: a case that is divided among processors; write into the whole case and divide it again")
                if not exists(fs, f"{root}/{key[0]}/{self.time}/{key[1]}"):
                    raise MeshError(f"{key[0]}/{self.time}/{key[1]}: a file with the boundary conditions is needed")
            if row["cell_id"] != n:
                raise MeshError(f"{key}: cell {row['cell_id']} where {n} was expected")
            spool.add(row["value"])
            n += 1
        if now is not None:
            close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.root)
        for m in messages:
            for path, final in m.files if m else []:
                fs.move(path, final)
        sweep(self.root, self.job)

    def abort(self, messages: list[Written | None]) -> None:
        sweep(self.root, self.job)


def _selector(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSelector(path, allow_not_found=True)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FoamSource)


def write_fields(rows: DataFrame, root: str, time: str = "0") -> None:
    """Put fields (case_id, field, cell_id, value) into the time folder of their cases. A field of a case is one file, so one task
    writes it, from rows in order; every file is written before the first is replaced."""
    register(rows.sparkSession)
    value = F.col("value") if rows.schema["value"].dataType.typeName() == "array" else F.array("value")
    ordered = rows.select("case_id", "field", F.col("cell_id").cast("long").alias("cell_id"), value.cast("array<double>").alias("value")).repartition("case_id", "field").sortWithinPartitions("case_id", "field", "cell_id")
    ordered.write.format("foam").mode("append").option("time", time).save(root)
