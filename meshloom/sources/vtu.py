"""VTK XML unstructured grids (.vtu) as a Spark data source: one row a cell, read by ranges of cells.

    vtu.register(spark)
    cells = spark.read.format("vtu").option("pattern", "*/volume_*.vtu").load(root)
    cells = spark.read.format("vtu").schema("case_id string, cell_id long, UMean array<double>").load(root)

The columns are case_id (the first folder below the root, or the file's stem without one), file, cell_id (from 0 in the
file), cell_type, x, y, z (the mean of the cell's vertices), volume, and the file's cell arrays by name, numbers or arrays of
numbers. Without a schema they are those of the first file. Only what the schema names is decoded: without x, y, z and
volume no point is read. A file with appended data is cut into ranges of `rows` cells; a range decodes the compressed blocks
that hold it, and of the points those that its cells name, one block at a time. Inline data (ascii or base64 between
the tags) cannot be entered in the middle: such a file is one range.

    cells.write.format("vtu").mode("append").option("mesh", "mesh.vtu").option("out", "initial.vtu").save(root)

writes cell arrays back: for each case_id a copy of its mesh with the other columns as further cell arrays. Rows have to come by case
and in order of cell_id (`by_case`); a case that does not name each cell once is an error. A new file stands under a name of
its own until all tasks have ended; then it takes the place of an older one.
"""
from __future__ import annotations

import base64
import lzma
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, Row, StringType, StructField, StructType

from .store import CHUNK, Spool, chunks, files_below, opened, sweep

# The format's type names, and the faces of its linear cells, by number of the cell type, as places in the cell's list of points.
TYPES = {"Float32": "f4", "Float64": "f8", "Int8": "i1", "Int16": "i2", "Int32": "i4", "Int64": "i8", "UInt8": "u1", "UInt16": "u2", "UInt32": "u4", "UInt64": "u8"}
FACES = {
    10: [(0, 1, 3), (1, 2, 3), (2, 0, 3), (0, 2, 1)],
    11: [(0, 4, 6, 2), (1, 3, 7, 5), (0, 1, 5, 4), (2, 6, 7, 3), (0, 2, 3, 1), (4, 5, 7, 6)],
    12: [(0, 4, 7, 3), (1, 2, 6, 5), (0, 1, 5, 4), (3, 7, 6, 2), (0, 3, 2, 1), (4, 5, 6, 7)],
    13: [(0, 1, 2), (3, 5, 4), (0, 3, 4, 1), (1, 4, 5, 2), (2, 5, 3, 0)],
    14: [(0, 3, 2, 1), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)],
}
POLYHEDRON = 42
#: Cells of a range.
ROWS = 250_000


class VolumeError(ValueError):
    """A file that is no such grid, or contradicts itself."""


def _attributes(tag: str) -> dict[str, str]:
    return {m[1]: m[3] for m in re.finditer(r"([\w:]+)\s*=\s*(['\"])(.*?)\2", tag, re.S)}


@dataclass
class Array:
    """A data array: its tag, and where its values stand: an offset into the appended data, or a span of the file."""

    tag: dict[str, str]
    begin: int = 0
    end: int = 0

    @property
    def dtype(self) -> np.dtype:
        if self.tag.get("type") not in TYPES:
            raise VolumeError(f"array {self.tag.get('Name')!r} of type {self.tag.get('type')!r}")
        return np.dtype(TYPES[self.tag["type"]])

    @property
    def width(self) -> int:
        return int(self.tag.get("NumberOfComponents") or 1)


@dataclass
class Piece:
    n_points: int
    n_cells: int
    sections: dict[str, dict[str, Array]] = field(default_factory=dict)


@dataclass
class Grid:
    """What the tags of a file say."""

    byte_order: str
    header: np.dtype
    compressor: str | None
    pieces: list[Piece]
    encoding: str | None = None
    base: int = 0

    @property
    def appended(self) -> bool:
        return self.encoding is not None


_TAG = re.compile(rb"<(/?)(VTKFile|UnstructuredGrid|Piece|CellData|PointData|Points|Cells|DataArray|AppendedData)\b([^<>]*)>")


def scan(fs, path: str, head_only: bool = False) -> Grid:
    """The tags, read piece by piece up to the appended data or the end; head_only stops at the first inline array."""
    grid, section, inline, pending, at = None, None, None, b"", 0
    for part in chunks(fs, path):
        pending += part
        done = 0
        for m in _TAG.finditer(pending):
            close, name, tag = m[1], m[2].decode(), _attributes(m[3].decode("utf-8", "replace"))
            begin, end = at + m.start(), at + m.end()
            done = m.end()
            if name == "VTKFile" and not close:
                if tag.get("type") != "UnstructuredGrid":
                    raise VolumeError(f"{path}: a file of {tag.get('type')!r}")
                order = "<" if tag.get("byte_order", "LittleEndian") == "LittleEndian" else ">"
                grid = Grid(order, np.dtype(TYPES[tag.get("header_type", "UInt32")]).newbyteorder(order), tag.get("compressor"), [])
            elif grid is None:
                continue
            elif name == "Piece" and not close:
                grid.pieces.append(Piece(int(tag["NumberOfPoints"]), int(tag["NumberOfCells"])))
            elif name in ("CellData", "PointData", "Points", "Cells") and not close:
                section = grid.pieces[-1].sections.setdefault(name, {})
                grid.pieces[-1].sections.setdefault(f"<{name}", {})[""] = Array(tag, begin, end)
                if m[3].rstrip().endswith(b"/"):
                    section = None
            elif name == "DataArray" and not close and section is not None:
                inline = Array(tag, end, end)
                section[tag.get("Name", "Points")] = inline
                if tag.get("format") != "appended" and head_only:
                    return grid
            elif name == "DataArray" and close and inline is not None:
                inline.end = begin
            elif name == "AppendedData":
                grid.encoding = tag.get("encoding", "base64")
                lead = next(chunks(fs, path, end, end + 4096), b"")
                if b"_" not in lead:
                    raise VolumeError(f"{path}: appended data without a mark")
                grid.base = end + lead.index(b"_") + 1
                return grid
        keep = max(done, len(pending) - 4096 if b"<" not in pending[-4096:] else pending.rindex(b"<"))
        at, pending = at + keep, pending[keep:]
    if grid is None:
        raise VolumeError(f"{path}: no VTKFile tag")
    return grid


class Values:
    """Ranges of a data array's values (in rows of its width), decoding only the blocks that hold them."""

    def __init__(self, fs, path: str, grid: Grid, array: Array):
        self.f, self.grid, self.array = fs.open_input_file(path), grid, array
        self.dtype, self.width = array.dtype.newbyteorder(grid.byte_order), array.width
        form = array.tag.get("format", "ascii")
        self.text = form == "ascii"
        self._kept: tuple[int, bytes] = (-1, b"")
        if self.text:
            self.whole = np.array(self._bytes(array.begin, array.end).split(), "S").astype(self.dtype) if self.dtype.kind == "f" else np.array(self._bytes(array.begin, array.end).split(), np.int64)
            return
        if form == "appended":
            self.raw, self.at = grid.encoding == "raw", grid.base + int(array.tag["offset"])
        else:
            lead = self._bytes(array.begin, array.begin + 4096)
            self.raw, self.at = False, array.begin + len(lead) - len(lead.lstrip())
        size = grid.header.itemsize
        if grid.compressor is None:
            self.data = self.at + size if self.raw else self.at  # encoded together with the header
            return
        n, block, last = np.frombuffer(self._encoded(self.at, 0, 3 * size), grid.header).astype(np.int64).tolist()
        sizes = np.frombuffer(self._encoded(self.at, 0, (3 + n) * size), grid.header)[3:].astype(np.int64)
        self.block, self.starts = block, np.concatenate([[0], np.cumsum(sizes)])
        self.last = last or block
        self.data = self.at + ((3 + n) * size if self.raw else 4 * -(-(3 + n) * size // 3))

    def _bytes(self, begin: int, end: int) -> bytes:
        self.f.seek(begin)
        return self.f.read(max(0, end - begin))

    def _encoded(self, start: int, lo: int, hi: int) -> bytes:
        """Bytes lo to hi of what is encoded from `start` on."""
        if self.raw:
            return self._bytes(start + lo, start + hi)
        first = lo // 3
        return base64.b64decode(self._bytes(start + 4 * first, start + 4 * -(-hi // 3)) + b"")[lo - 3 * first : hi - 3 * first]

    def _block(self, k: int) -> bytes:
        if self._kept[0] != k:
            packed = self._encoded(self.data, int(self.starts[k]), int(self.starts[k + 1]))
            size = self.last if k == len(self.starts) - 2 else self.block
            self._kept = k, _decompressor(self.grid.compressor)(packed, size)
            if len(self._kept[1]) != size:
                raise VolumeError(f"array {self.array.tag.get('Name')!r}: a block of {len(self._kept[1])} bytes, {size} declared")
        return self._kept[1]

    def _span(self, lo: int, hi: int) -> bytes:
        if self.grid.compressor is None:
            extra = 0 if self.raw else self.grid.header.itemsize
            return self._encoded(self.data, lo + extra, hi + extra)
        out = []
        for k in range(lo // self.block, -(-hi // self.block)):
            out.append(self._block(k)[max(0, lo - k * self.block) : hi - k * self.block])
        return b"".join(out)

    def rows(self, lo: int, hi: int) -> np.ndarray:
        """Rows lo to hi, of shape (n,) or (n, width)."""
        if self.text:
            out = self.whole[lo * self.width : hi * self.width]
        else:
            step = self.width * self.dtype.itemsize
            out = np.frombuffer(self._span(lo * step, hi * step), self.dtype)
        if len(out) != (hi - lo) * self.width:
            raise VolumeError(f"array {self.array.tag.get('Name')!r}: {len(out)} values in rows {lo} to {hi}")
        return out if self.width == 1 else out.reshape(-1, self.width)

    def at_rows(self, wanted: np.ndarray) -> np.ndarray:
        """Rows of sorted distinct numbers, a bounded stretch at a time."""
        out = np.empty((len(wanted), self.width), self.dtype)
        step = max(1, CHUNK // (self.width * self.dtype.itemsize))
        k = 0
        while k < len(wanted):
            lo = int(wanted[k])
            j = int(np.searchsorted(wanted, lo + step))
            out[k:j] = self.rows(lo, int(wanted[j - 1]) + 1).reshape(-1, self.width)[wanted[k:j] - lo]
            k = j
        return out


def _decompressor(name: str):
    if name == "vtkZLibDataCompressor":
        return lambda packed, size: zlib.decompress(packed)
    if name == "vtkLZMADataCompressor":
        return lambda packed, size: lzma.decompress(packed)
    if name == "vtkLZ4DataCompressor":
        return lambda packed, size: pa.Codec("lz4_raw").decompress(packed, size, asbytes=True)
    raise VolumeError(f"compressor {name!r}")


def _faces_volume(corners: list[np.ndarray], centre: np.ndarray) -> np.ndarray:
    """The volume between a face, given by its corners in turn, and a point inside: a fan of triangles around the face's middle."""
    middle = sum(corners) / len(corners)
    area = sum(np.cross(a - middle, b - middle) for a, b in zip(corners, [*corners[1:], corners[0]])) / 2
    return np.abs((area * (middle - centre)).sum(-1)) / 3


def geometry(kind: np.ndarray, ends: np.ndarray, nodes: np.ndarray, points: np.ndarray, polyhedra: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Centres (means of the vertices) and volumes of cells. nodes are places in points, ends the end of each cell's nodes;
    polyhedra: of each cell of that type its face stream (count, then for each face its size and places in points)."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sums = np.add.reduceat(points[nodes], starts, axis=0) if len(starts) else np.zeros((0, 3))
    centre = sums / (ends - starts)[:, None]
    volume = np.full(len(kind), np.nan)
    for t, faces in FACES.items():
        own = np.flatnonzero(kind == t)
        if len(own):
            at = points[nodes[starts[own][:, None] + np.arange(1 + max(map(max, faces)))]]
            volume[own] = sum(_faces_volume([at[:, i] for i in f], centre[own]) for f in faces)
    for cell, stream in zip(np.flatnonzero(kind == POLYHEDRON).tolist(), polyhedra):
        k, total = 1, 0.0
        for _ in range(int(stream[0])):
            n = int(stream[k])
            total += float(_faces_volume([points[i] for i in stream[k + 1 : k + 1 + n]], centre[cell]))
            k += 1 + n
        volume[cell] = total
    return centre, volume


class Part(InputPartition):
    def __init__(self, path: str, case_id: str, name: str, piece: int | None, lo: int, hi: int, first: int):
        self.path, self.case_id, self.name, self.piece, self.lo, self.hi, self.first = path, case_id, name, piece, lo, hi, first


FIXED = {"case_id": StringType(), "file": StringType(), "cell_id": LongType(), "cell_type": IntegerType(), "x": DoubleType(), "y": DoubleType(), "z": DoubleType(), "volume": DoubleType()}
GEOMETRY = ("x", "y", "z", "volume")


def case_of(name: str) -> str:
    head = name.split("/")[0]
    return head if "/" in name else re.sub(r"\.vtu$", "", head)


class VtuSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vtu"

    def _root(self) -> str:
        return self.options["path"]

    def _found(self) -> list[str]:
        found = [n for n, _ in files_below(self._root(), self.options.get("pattern", "*.vtu"))]
        if not found:
            raise VolumeError(f"no file of pattern {self.options.get('pattern', '*.vtu')!r} below {self._root()}")
        return found

    def schema(self) -> StructType:
        fs, root = opened(self._root())
        grid = scan(fs, f"{root}/{self._found()[0]}")
        arrays = grid.pieces[0].sections.get("CellData", {}) if grid.pieces else {}
        own = [StructField(n, DoubleType() if a.width == 1 else ArrayType(DoubleType())) for n, a in arrays.items()]
        return StructType([StructField(n, t) for n, t in FIXED.items()] + own)

    def reader(self, schema: StructType) -> DataSourceReader:
        return VtuReader(self._root(), self._found(), schema, int(self.options.get("rows", ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return VtuWriter(self._root(), schema, self.options.get("mesh", "mesh.vtu"), self.options.get("out", "initial.vtu"))


class VtuReader(DataSourceReader):
    def __init__(self, root: str, names: list[str], schema: StructType, rows: int):
        self.root, self.names, self.schema, self.rows_ = root, names, schema, rows

    def partitions(self) -> list[InputPartition]:
        fs, root = opened(self.root)
        out = []
        for name in self.names:
            grid, first = scan(fs, f"{root}/{name}", head_only=True), 0
            if not grid.appended:
                out.append(Part(f"{root}/{name}", case_of(name), name, None, 0, 0, 0))
                continue
            for k, piece in enumerate(grid.pieces):
                for lo in range(0, piece.n_cells, self.rows_):
                    out.append(Part(f"{root}/{name}", case_of(name), name, k, lo, min(lo + self.rows_, piece.n_cells), first))
                first += piece.n_cells
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.root)
        grid, first = scan(fs, part.path), part.first
        if part.piece is not None:
            yield self._cells(fs, part, grid, grid.pieces[part.piece], part.lo, part.hi, first)
            return
        for piece in grid.pieces:
            for lo in range(0, piece.n_cells, self.rows_):
                yield self._cells(fs, part, grid, piece, lo, min(lo + self.rows_, piece.n_cells), first)
            first += piece.n_cells

    def _cells(self, fs, part: Part, grid: Grid, piece: Piece, lo: int, hi: int, first: int) -> pa.RecordBatch:
        wanted, n = [f.name for f in self.schema], hi - lo
        values = lambda section, name: Values(fs, part.path, grid, piece.sections[section][name])
        columns = {"case_id": pa.array([part.case_id] * n), "file": pa.array([part.name] * n), "cell_id": pa.array(np.arange(first + lo, first + hi))}
        if {"cell_type", *GEOMETRY} & {*wanted}:
            kind = values("Cells", "types").rows(lo, hi).astype(np.int32)
            columns["cell_type"] = pa.array(kind)
        if {*GEOMETRY} & {*wanted}:
            columns |= self._geometry(values, kind, lo, hi)
        data = piece.sections.get("CellData", {})
        for f in self.schema:
            if f.name in FIXED:
                continue
            if f.name not in data:
                columns[f.name] = pa.nulls(n, pa.list_(pa.float64()) if isinstance(f.dataType, ArrayType) else pa.float64())
                continue
            rows = values("CellData", f.name).rows(lo, hi).astype(np.float64)
            if isinstance(f.dataType, ArrayType):
                width = rows.size // max(1, n)
                columns[f.name] = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, max(1, width), dtype=np.int32)[: n + 1]), pa.array(rows.ravel()))
            elif rows.ndim > 1:
                raise VolumeError(f"{part.name}: array {f.name!r} has {rows.shape[1]} components, the schema one")
            else:
                columns[f.name] = pa.array(rows)
        return pa.RecordBatch.from_arrays([columns[c] for c in wanted], wanted)

    def _geometry(self, values, kind: np.ndarray, lo: int, hi: int) -> dict[str, pa.Array]:
        offsets = values("Cells", "offsets")
        ends = offsets.rows(lo, hi).astype(np.int64)
        begin = int(offsets.rows(lo - 1, lo)[0]) if lo else 0
        nodes = values("Cells", "connectivity").rows(begin, int(ends[-1]) if len(ends) else begin).astype(np.int64)
        streams = []
        if (own := np.flatnonzero(kind == POLYHEDRON)).size:
            place, faces = values("Cells", "faceoffsets"), values("Cells", "faces")
            ends_of = place.rows(lo, hi).astype(np.int64)[own]  # other cells have -1
            before, at = 0, lo
            while at and not before:  # the end of the last polyhedron before this range
                at, stop = max(0, at - 4096), at
                before = int(place.rows(at, stop).max(initial=0))
            streams = [faces.rows(a, b).astype(np.int64) for a, b in zip([max(0, before), *ends_of.tolist()], ends_of.tolist())]
        needed = np.unique(nodes)
        points = values("Points", "Points").at_rows(needed).astype(np.float64)
        streams = [_renamed(s, needed) for s in streams]
        centre, volume = geometry(kind, ends - begin, np.searchsorted(needed, nodes), points, streams)
        return {"x": pa.array(centre[:, 0]), "y": pa.array(centre[:, 1]), "z": pa.array(centre[:, 2]), "volume": pa.array(volume)}


def _renamed(stream: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """A face stream with places in `needed` for point numbers."""
    out, k = stream.copy(), 1
    for _ in range(int(stream[0])):
        n = int(stream[k])
        out[k + 1 : k + 1 + n] = np.searchsorted(needed, stream[k + 1 : k + 1 + n])
        k += 1 + n
    return out


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class VtuWriter(DataSourceWriter):
    def __init__(self, root: str, schema: StructType, mesh: str, out: str):
        names = [f.name for f in schema]
        if not {"case_id", "cell_id"} <= {*names}:
            raise VolumeError("case_id and cell_id are needed")
        self.root, self.mesh, self.out, self.job = root, mesh, out, uuid.uuid4().hex
        self.fields = [n for n in names if n not in FIXED]

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        fs, root = opened(self.root)
        done: list[tuple[str, str]] = []
        case, spools, n = None, [], 0

        def close() -> None:
            folder = f"{root}/{case}"
            path = f"{folder}/.{self.out}.{self.job}.{uuid.uuid4().hex}"
            add_arrays(fs, f"{folder}/{self.mesh}", path, dict(zip(self.fields, spools)), n)
            done.append((path, f"{folder}/{self.out}"))

        for row in iterator:
            if row["case_id"] != case:
                if case is not None:
                    close()
                case, spools, n = row["case_id"], [Spool() for _ in self.fields], 0
            if row["cell_id"] != n:
                raise VolumeError(f"{case}: cell {row['cell_id']} where {n} was expected")
            for spool, name in zip(spools, self.fields):
                spool.add(row[name])
            n += 1
        if case is not None:
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


def _inline(grid: Grid, spool: Spool, lo: int, hi: int) -> Iterator[bytes]:
    """Rows of a spool as an inline array: base64 of a header and the values, in blocks if the file declares a compressor."""
    order, step = grid.byte_order, 3 * 8 * 1024  # whole groups of three bytes
    size = (hi - lo) * 8 * spool.width
    if grid.compressor is None:
        head = np.array([size], grid.header).tobytes()
        pending = head
        per = step // (8 * spool.width) or 1
        for a in range(lo, hi, per):
            pending += np.frombuffer(spool.rows(a, min(a + per, hi)), "<f8").astype(f"{order}f8").tobytes()
            whole = len(pending) // 3 * 3
            yield base64.b64encode(pending[:whole])
            pending = pending[whole:]
        yield base64.b64encode(pending)
        return
    press = {"vtkZLibDataCompressor": zlib.compress, "vtkLZMADataCompressor": lzma.compress, "vtkLZ4DataCompressor": lambda b: pa.Codec("lz4_raw").compress(b, asbytes=True)}[grid.compressor]
    per = max(1, (1 << 15) // (8 * spool.width))
    block, sizes = per * 8 * spool.width, []
    with tempfile.TemporaryFile() as packed:
        for a in range(lo, hi, per):
            part = press(np.frombuffer(spool.rows(a, min(a + per, hi)), "<f8").astype(f"{order}f8").tobytes())
            sizes.append(len(part))
            packed.write(part)
        yield base64.b64encode(np.array([len(sizes), block, size % block, *sizes], grid.header).tobytes())
        packed.seek(0)
        while part := packed.read(step):
            yield base64.b64encode(part)


def add_arrays(fs, source: str, target: str, arrays: dict[str, Spool], n: int) -> None:
    """A copy of a grid with further cell arrays, which take the place of arrays of the same names."""
    grid = scan(fs, source)
    total = sum(p.n_cells for p in grid.pieces)
    if total != n:
        raise VolumeError(f"{source}: {n} rows for {total} cells")
    with fs.open_output_stream(target) as out:
        at, first = 0, 0
        for piece in grid.pieces:
            there = piece.sections.get("<CellData", {}).get("")
            clash = [a for name, a in piece.sections.get("CellData", {}).items() if name in arrays]
            if clash:
                raise VolumeError(f"{source} has arrays of the names {[a.tag.get('Name') for a in clash]}")
            anchor = there or piece.sections["<Points"][""]
            closed = there is not None and next(chunks(fs, source, there.end - 2, there.end)) == b"/>"
            stop = anchor.begin if there is None else anchor.end - 2 if closed else anchor.end
            for part in chunks(fs, source, at, stop):
                out.write(part)
            out.write(b"<CellData>" if there is None else b">" if closed else b"")
            for name, spool in arrays.items():
                out.write(f'\n<DataArray type="Float64" Name="{name}" NumberOfComponents="{spool.width or 1}" format="binary">\n'.encode())
                for part in _inline(grid, spool, first, first + piece.n_cells) if piece.n_cells else ():
                    out.write(part)
                out.write(b"\n</DataArray>")
            out.write(b"\n</CellData>\n" if there is None or closed else b"\n")
            at, first = (anchor.begin if there is None else anchor.end), first + piece.n_cells
        for part in chunks(fs, source, at):
            out.write(part)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VtuSource)


def by_case(rows: DataFrame) -> DataFrame:
    """Rows as the writer needs them: a case in one task, in order of its cells; a case is one file, so one task writes it."""
    return rows.repartition("case_id").sortWithinPartitions("case_id", "cell_id")



