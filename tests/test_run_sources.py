"""Data sources of solver cases: the same rows however files are cut, fields written back, backups restored."""
import base64
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.operators.checks import CaseError
from meshloom.sources import backup, foam, polymesh, runs, store, vtu

HEAD = "FoamFile\n{\n    version 2.0;\n    format %s;\n    arch \"LSB;label=32;scalar=64\";\n    class %s;\n    object x;\n}\n"


# --- grids as files -----------------------------------------------------------------------------------------------
def box(n: int):
    """An n x n x n grid of unit cubes, of which one is given as two wedges, one as a pyramid stack's face list (polyhedron)."""
    k = np.arange(n + 1)
    points = np.array([(x, y, z) for z in k for y in k for x in k], float) + 0.25
    at = lambda x, y, z: x + (n + 1) * (y + (n + 1) * z)
    cells = []
    for z in range(n):
        for y in range(n):
            for x in range(n):
                c = [at(x, y, z), at(x + 1, y, z), at(x + 1, y + 1, z), at(x, y + 1, z), at(x, y, z + 1), at(x + 1, y, z + 1), at(x + 1, y + 1, z + 1), at(x, y + 1, z + 1)]
                i = x + n * (y + n * z)
                if i % 5 == 1:
                    cells += [(13, [c[0], c[1], c[3], c[4], c[5], c[7]], None, 0.5), (13, [c[1], c[2], c[3], c[5], c[6], c[7]], None, 0.5)]
                elif i % 5 == 2:
                    faces = [(0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)]
                    cells.append((42, c, [[c[j] for j in f] for f in faces], 1.0))
                elif i % 5 == 3:
                    cells.append((11, [c[0], c[1], c[3], c[2], c[4], c[5], c[7], c[6]], None, 1.0))
                elif i % 5 == 4:
                    cells += [(10, [c[0], c[1], c[2], c[5]], None, 1 / 6), (14, [c[0], c[1], c[2], c[3], c[6]], None, 1 / 3)]
                else:
                    cells.append((12, c, None, 1.0))
    return points, cells


def grid_arrays(points, cells):
    streams = [[len(f), *[v for x in f for v in (len(x), *x)]] if f else [] for _, _, f, _ in cells]
    ends = np.cumsum([len(s) for s in streams])
    rng = np.random.default_rng(len(cells))
    data = {"UMean": rng.normal(size=(len(cells), 3)).astype(np.float32), "pMean": rng.normal(size=len(cells)), "mask": np.arange(len(cells)) % 7}
    mesh = {"connectivity": np.array([v for c in cells for v in c[1]], np.int64), "offsets": np.cumsum([len(c[1]) for c in cells]), "types": np.array([c[0] for c in cells], np.uint8),
            "faces": np.array([v for s in streams for v in s], np.int64), "faceoffsets": np.array([int(e) if s else -1 for e, s in zip(ends, streams)])}
    return data, mesh


NAMES = {"f4": "Float32", "f8": "Float64", "i8": "Int64", "u1": "UInt8"}


def vtu_file(path, points, cells, form: str, compress: bool, order="<", block=1000):
    """An independent writer: ascii, inline base64, or appended (raw or base64) with or without compressed blocks."""
    data, mesh = grid_arrays(points, cells)
    appended = b""

    def coded(x):
        raw = x.astype(x.dtype.newbyteorder(order)).tobytes()
        if not compress:
            head = struct.pack(order + "Q", len(raw))
            return base64.b64encode(head + raw) if form != "raw" else head + raw
        parts = [zlib.compress(raw[i : i + block]) for i in range(0, len(raw), block)]
        head = struct.pack(order + f"{3 + len(parts)}Q", len(parts), block, len(raw) % block, *map(len, parts))
        return head + b"".join(parts) if form == "raw" else base64.b64encode(head) + base64.b64encode(b"".join(parts))

    def tag(name, x):
        nonlocal appended
        comps = f' NumberOfComponents="{x.shape[1]}"' if x.ndim > 1 else ""
        lead = f'<DataArray type="{NAMES[x.dtype.str[1:]]}" Name="{name}"{comps} format='
        if form == "ascii":
            return f'{lead}"ascii">\n{" ".join(repr(v) for v in x.ravel().tolist())}\n</DataArray>\n'
        if form == "inline":
            return f'{lead}"binary">\n{coded(x).decode()}\n</DataArray>\n'
        at = len(appended)
        appended += coded(x)
        return f'{lead}"appended" offset="{at}"/>\n'

    more = ' compressor="vtkZLibDataCompressor"' if compress else ""
    text = f'<?xml version="1.0"?>\n<VTKFile type="UnstructuredGrid" version="1.0" byte_order="{"Little" if order == "<" else "Big"}Endian" header_type="UInt64"{more}>\n<UnstructuredGrid>\n<Piece NumberOfPoints="{len(points)}" NumberOfCells="{len(cells)}">\n'
    text += "<PointData/>\n<CellData>\n" + "".join(tag(n, x) for n, x in data.items()) + "</CellData>\n<Points>\n" + tag("Points", points) + "</Points>\n<Cells>\n" + "".join(tag(n, x) for n, x in mesh.items()) + "</Cells>\n</Piece>\n</UnstructuredGrid>\n"
    body = text.encode()
    if form in ("raw", "base64"):
        body += f'<AppendedData encoding="{form}">\n_'.encode() + appended + b"\n</AppendedData>\n"
    path.write_bytes(body + b"</VTKFile>\n")
    return data


@pytest.mark.parametrize(("form", "compress", "order"), [("ascii", False, "<"), ("inline", False, "<"), ("inline", True, "<"), ("raw", False, ">"), ("raw", True, "<"), ("base64", False, "<"), ("base64", True, ">")])
def test_cells_are_the_same_however_a_grid_is_stored_and_cut(spark, tmp_path, form, compress, order):
    vtu.register(spark)
    points, cells = box(5)
    (tmp_path / "run_1").mkdir()
    data = vtu_file(tmp_path / "run_1" / "volume_1.vtu", points, cells, form, compress, order)
    want = np.array([points[c[1]].mean(0) for c in cells])
    for rows in (10, 40, 10_000):
        d = spark.read.format("vtu").option("rows", rows).load(str(tmp_path))
        got = sorted(d.collect(), key=lambda r: r.cell_id)
        if form in ("raw", "base64"):
            assert d.rdd.getNumPartitions() == -(-len(cells) // rows)
        assert [r.cell_id for r in got] == list(range(len(cells))) and {r.case_id for r in got} == {"run_1"}
        assert np.allclose([(r.x, r.y, r.z) for r in got], want) and np.allclose([r.volume for r in got], [c[3] for c in cells])
        assert np.allclose([r.UMean for r in got], data["UMean"]) and [r.pMean for r in got] == data["pMean"].tolist() and [r["mask"] for r in got] == data["mask"].tolist()
    few = spark.read.format("vtu").option("rows", 33).schema("cell_id long, pMean double, other array<double>").load(f"file://{tmp_path}")
    assert sorted((r.cell_id, r.pMean, r.other) for r in few.collect()) == [(i, p, None) for i, p in enumerate(data["pMean"].tolist())]


def test_a_schema_without_geometry_reads_no_point(spark, tmp_path):
    points, cells = box(3)
    vtu_file(tmp_path / "a.vtu", points, cells, "raw", True)
    raw = (tmp_path / "a.vtu").read_bytes()
    (tmp_path / "a.vtu").write_bytes(raw.replace(b'Name="connectivity"', b'Name="connectiv_ty"'))
    vtu.register(spark)
    read = spark.read.format("vtu")
    assert read.schema("cell_id long, mask double").load(str(tmp_path)).count() == len(cells)
    with pytest.raises(Exception, match="connectivity"):
        read.schema("cell_id long, x double").load(str(tmp_path)).collect()


@pytest.mark.parametrize(("form", "compress"), [("ascii", False), ("inline", True), ("raw", False), ("raw", True), ("base64", True)])
def test_arrays_written_back_are_read_again(spark, tmp_path, form, compress):
    vtu.register(spark)
    points, cells = box(4)
    for case in ("a", "b"):
        (tmp_path / case).mkdir()
        vtu_file(tmp_path / case / "mesh.vtu", points, cells, form, compress)
    n = len(cells)
    rows = spark.range(2 * n).select(F.when(F.col("id") < n, "a").otherwise("b").alias("case_id"), (F.col("id") % n).alias("cell_id"), (F.sqrt("id") * 3).alias("k"), F.array(*[F.col("id") * F.lit(0.5 + i) for i in range(3)]).alias("U")).repartition(5)
    write = lambda d: vtu.by_case(d).write.format("vtu").mode("append").save(str(tmp_path))
    write(rows)
    write(rows)  # again: the older file is replaced
    back = spark.read.format("vtu").option("pattern", "*/initial.vtu").option("rows", 17).load(str(tmp_path))
    assert sorted(map(tuple, back.select("case_id", "cell_id", "k", "U").collect())) == sorted(map(tuple, rows.collect()))
    old = spark.read.format("vtu").option("pattern", "*/mesh.vtu").load(str(tmp_path))
    assert sorted(map(tuple, back.select(old.columns).drop("file").collect())) == sorted(map(tuple, old.drop("file").collect()))
    kept = (tmp_path / "a" / "initial.vtu").read_bytes()
    with pytest.raises(Exception, match="was expected|rows for"):
        write(rows.where("not (case_id = 'b' and cell_id = 9)"))
    assert (tmp_path / "a" / "initial.vtu").read_bytes() == kept and sorted(os.listdir(tmp_path / "a")) == ["initial.vtu", "mesh.vtu"]


# --- mesh and field files -------------------------------------------------------------------------------------------
def foam_case(root, name, n, binary, seed=0):
    rng = np.random.default_rng(seed)
    pts, own = rng.normal(size=(n, 3)), rng.integers(0, n, n)
    faces = [rng.integers(0, n, rng.integers(3, 14)).tolist() for _ in range(n)]
    u, p = rng.normal(size=(n, 3)), rng.normal(size=n)
    m = root / name / "constant" / "polyMesh"
    m.mkdir(parents=True)
    form = "binary" if binary else "ascii"
    edges = np.cumsum([0, *map(len, faces)])

    def put(path, cls, body):
        path.write_bytes((HEAD % (form, cls)).encode() + b"// * * * //\n\n" + body)

    count = lambda x: f"{x}\n(".encode()
    if binary:
        put(m / "points", "vectorField", count(n) + pts.tobytes() + b")\n")
        put(m / "owner", "labelList", count(n) + own.astype("<i4").tobytes() + b")\n")
        put(m / "faces", "faceCompactList", count(n + 1) + edges.astype("<i4").tobytes() + b")\n" + count(edges[-1]) + np.concatenate(faces).astype("<i4").tobytes() + b")\n")
    else:
        long = lambda f: f"{len(f)}({' '.join(map(str, f))})" if len(f) < 11 else f"\n{len(f)}\n(\n" + "\n".join(map(str, f)) + "\n)\n"
        put(m / "points", "vectorField", count(n) + "\n".join(f"({a!r} {b!r} {c!r})" for a, b, c in pts.tolist()).encode() + b"\n)\n// end\n")
        put(m / "owner", "labelList", count(n) + b"\n" + "\n".join(map(str, own)).encode() + b"\n)\n\n// **** //\n")
        put(m / "faces", "faceList", count(n) + b"\n" + "\n".join(map(long, faces)).encode() + b"\n)\n")
    rest = b";\n\nboundaryField\n{\n    wall\n    {\n        type fixedValue;\n        value uniform (0 0 0);\n    }\n    other { type codedMixed; value nonuniform List<vector> 2((1 2 3) (4 5 6)); }\n}\n"
    for time, scale in (("0", 1.0), ("1.5", 2.0)):
        t = root / name / time
        t.mkdir()
        head = b"dimensions [0 1 -1 0 0 0 0];\n\ninternalField   nonuniform List<%s> \n"
        if binary:
            put(t / "U", "volVectorField", head % b"vector" + count(n) + (u * scale).tobytes() + b")\n" + rest)
            put(t / "p", "volScalarField", head % b"scalar" + count(n) + (p * scale).tobytes() + b")\n" + rest)
        else:
            put(t / "U", "volVectorField", head % b"vector" + count(n) + b"\n" + "\n".join(f"({a!r} {b!r} {c!r})" for a, b, c in (u * scale).tolist()).encode() + b"\n)\n" + rest)
            put(t / "p", "volScalarField", head % b"scalar" + count(n) + b"\n" + "\n".join(map(repr, (p * scale).tolist())).encode() + b"\n)\n" + rest)
        put(t / "k", "volScalarField", b"internalField uniform 0.25;\n" + rest)
    return pts, own, faces, u, p


@pytest.mark.parametrize("size", [64, 1000, 8 << 20])
def test_records_have_their_numbers_however_files_are_cut(spark, tmp_path, size):
    want = {f"set/{c}": foam_case(tmp_path / "set", c, 120, c == "bin", seed) for seed, c in enumerate(("txt", "bin"))}
    get = lambda table, names="": foam.read(spark, str(tmp_path), table, names, size).collect()
    points, owner, faces, fields = get("points"), get("owner"), get("faces"), get("field", "U,p,k")
    assert len(points) == len(owner) == len(faces) == 240
    for case, (pts, own, fcs, u, p) in want.items():
        at = lambda rows, key: [r for r in sorted(rows, key=lambda r: -1 if r[key] is None else r[key]) if r.case_id == case]  # noqa: B023, E731
        assert np.array_equal([(r.x, r.y, r.z) for r in at(points, "point_id")], pts)
        assert [r.cell_id for r in at(owner, "face_id")] == own.tolist() and [list(r.vertices) for r in at(faces, "face_id")] == fcs
        for time, scale in ((0.0, 1.0), (1.5, 2.0)):
            of = lambda name: [r.value for r in at(fields, "cell_id") if r.field == name and r.time == time]  # noqa: B023, E731
            assert np.array_equal(of("U"), u * scale) and np.array_equal(np.ravel(of("p")), p * scale) and of("k") == [[0.25]]
    # The readers of whole files say the same.
    whole = polymesh.read(spark, f"file://{tmp_path}/set/txt", "points").orderBy("point_id").collect()
    assert [(r.x, r.y, r.z) for r in whole] == [(r.x, r.y, r.z) for r in sorted(points, key=lambda r: r.point_id) if r.case_id == "set/txt"]


def test_lists_that_end_early_are_errors(spark, tmp_path):
    foam_case(tmp_path, "txt", 30, False)
    path = tmp_path / "txt" / "constant" / "polyMesh" / "points"
    path.write_bytes(path.read_bytes().replace(b"30\n(", b"31\n("))
    with pytest.raises(Exception, match="ends early: txt/points"):
        foam.read(spark, str(tmp_path), "points", size=100).collect()
    foam_case(tmp_path, "bin", 30, True)
    path = tmp_path / "bin" / "constant" / "polyMesh" / "owner"
    path.write_bytes(path.read_bytes()[:-80])
    with pytest.raises(Exception, match="ends before"):
        foam.read(spark, str(tmp_path), "owner").where("case_id = 'bin'").collect()


@pytest.mark.parametrize("binary", [False, True])
def test_fields_are_written_back_and_the_rest_stays(spark, tmp_path, binary):
    n = 90
    for c in ("a", "b"):
        foam_case(tmp_path, c, n, binary)
    before = {c: (tmp_path / c / "0" / "U").read_bytes() for c in "ab"}
    rows = spark.range(2 * n).select(F.when(F.col("id") < n, "a").otherwise("b").alias("case_id"), (F.col("id") % n).alias("cell_id"))
    u = rows.select("*", F.lit("U").alias("field"), F.array(F.col("cell_id") * 0.1, F.lit(-1e-300), F.sqrt("cell_id")).alias("value"))
    k = rows.select("*", F.lit("k").alias("field"), F.array(F.col("cell_id") / 3).alias("value"))
    foam.write_fields(u.unionByName(k).repartition(4), str(tmp_path))
    back = foam.read(spark, str(tmp_path), "field", "U,k", 500).where("time = 0").select("case_id", "cell_id", "field", "value")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, u.unionByName(k).collect()))
    after = {c: (tmp_path / c / "0" / "U").read_bytes() for c in "ab"}
    for c in "ab":
        assert after[c] != before[c]
        cut = lambda b: (b[: b.index(b"internalField")], b[b.index(b"\n\nboundaryField") :])
        assert cut(after[c]) == cut(before[c])
    # A job that fails in one case leaves all as they were, and nothing behind.
    for bad, said in ((u.where("not (case_id = 'b' and cell_id = 5)"), "was expected"), (u.where("cell_id < 80"), "for 90 cells"), (u.withColumn("value", F.array(F.lit(1.0))), "components"), (u.withColumn("field", F.when(F.col("case_id") == "b", "omega").otherwise("U")), "boundary conditions")):
        with pytest.raises(Exception, match=said):
            foam.write_fields(bad.withColumn("value", F.transform("value", lambda x: x + 1)), str(tmp_path))
        assert {c: (tmp_path / c / "0" / "U").read_bytes() for c in "ab"} == after and sorted(os.listdir(tmp_path / "b" / "0")) == ["U", "k", "p"]
    (tmp_path / "b" / "processor0").mkdir()
    with pytest.raises(Exception, match="divided"):
        foam.write_fields(u, str(tmp_path))
    assert (tmp_path / "a" / "0" / "U").read_bytes() == after["a"]


# --- backups ----------------------------------------------------------------------------------------------------------
def contents(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}


def test_backups_restore_byte_for_byte_and_refuse_what_is_changed(spark, tmp_path):
    for c in ("a", "b", "c"):
        foam_case(tmp_path, c, 40, c == "b")
        (tmp_path / c / "0" / "deep").mkdir()
        (tmp_path / c / "0" / "deep" / "x").write_bytes(os.urandom(3_000_000))
    first = {c: contents(tmp_path / c / "0") for c in "abc"}
    cases = spark.createDataFrame([(c,) for c in "abc"], "case_id string")
    status = lambda d: {r.case_id: r.status for r in d.collect()}
    assert status(backup.restore(cases, str(tmp_path))) == dict.fromkeys("abc", "no backup") and contents(tmp_path / "a" / "0") == first["a"]
    assert status(backup.make(cases, str(tmp_path))) == dict.fromkeys("abc", "made")
    assert backup.faults(cases, str(tmp_path)).count() == 0
    value = F.array(F.lit(9.0), F.lit(9.0), F.lit(9.0)).alias("value")
    foam.write_fields(spark.range(120).select(F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("case_id"), F.lit("U").alias("field"), F.floor(F.col("id") / 3).alias("cell_id"), value), str(tmp_path))
    (tmp_path / "a" / "0" / "new").write_text("of the run")
    (tmp_path / "b" / "0" / "p").unlink()
    assert status(backup.make(cases, str(tmp_path))) == dict.fromkeys("abc", "kept")  # the first backup stays
    (tmp_path / "c" / "0.kept" / "deep" / "x").write_bytes(b"changed")
    held = contents(tmp_path / "c" / "0")
    assert status(backup.restore(cases, str(tmp_path))) == {"a": "restored", "b": "restored", "c": "changed"}
    assert contents(tmp_path / "a" / "0") == first["a"] and contents(tmp_path / "b" / "0") == first["b"] and contents(tmp_path / "c" / "0") == held
    assert [tuple(r) for r in backup.faults(cases, str(tmp_path)).collect()] == [("c", "deep/x", "changed")]
    assert sorted(p for p in os.listdir(tmp_path / "a") if p.startswith("0")) == ["0", "0.kept"]


def test_a_copy_that_was_broken_off_is_no_backup(spark, tmp_path):
    foam_case(tmp_path, "a", 10, False)
    (tmp_path / "a" / "0.kept.1234").mkdir()
    (tmp_path / "a" / "0.kept.1234" / "U").write_text("half")
    cases = spark.createDataFrame([("a",), ("missing",)], "case_id string")
    assert {r.case_id: r.fault for r in backup.faults(cases, str(tmp_path)).collect()} == {"a": "no backup", "missing": "no backup"}
    assert {r.case_id: r.status for r in backup.make(cases, str(tmp_path)).collect()} == {"a": "made", "missing": "nothing to keep"}


def test_store_ranges(tmp_path):
    (tmp_path / "f").write_bytes(bytes(range(256)) * 20)
    fs, root = store.opened(f"file://{tmp_path}")
    assert b"".join(store.chunks(fs, f"{root}/f", 100, 3000, 7)) == (bytes(range(256)) * 20)[100:3000]
    assert store.files_below(f"file://{tmp_path}") == [("f", 5120)] and store.files_below(f"{tmp_path}/none") == []


# --- run folders, from files to points ----------------------------------------------------------------------------------
MANIFEST = "source string, solid_field string, solid_value double, stress_order string, pressure string, rho double, p_ref double, inflow_dir array<double>, l_ref_value double, l_ref_rule string, origin_point array<double>, origin_rule string, ground string"


def stl_file(path, triangles):
    path.write_text("solid s\n" + "".join("facet normal 0 0 0\nouter loop\n" + "".join("vertex %r %r %r\n" % tuple(map(float, p)) for p in t) + "endloop\nendfacet\n" for t in triangles) + "endsolid\n")


def cube(at, size):
    p = lambda i: tuple(a + size * (i >> k & 1) for k, a in enumerate(at))
    quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    return [t for a, b, c, d in quads for t in ((p(a), p(b), p(c)), (p(a), p(c), p(d)))]


def test_run_folders_become_canonical_points(spark, tmp_path):
    points, grid = box(4)
    n, data = len(grid), {}
    for i in (1, 2):
        (tmp_path / f"run_{i}").mkdir()
        data[f"run_{i}"] = vtu_file(tmp_path / f"run_{i}" / f"volume_{i}.vtu", points * i, grid, "raw", i == 1)
        body = cube((1.0, 1.0, 0.5), 2.0)
        stl_file(tmp_path / f"run_{i}" / "a_body.stl", [t[::-1] if k % 3 else t for k, t in enumerate(body)])
        stl_file(tmp_path / f"run_{i}" / "b_other.stl", body[:1])
    manifest = spark.createDataFrame([("s", "mask", 3.0, "none", "kinematic", None, None, [1.0, 0.0, 0.0], 2.0, None, [0.5, 0.0, 0.0], None, "none")], MANIFEST)
    params = spark.createDataFrame([("run_1", 2.0, 1e-3), ("run_2", 4.0, None)], "case_id string, u_ref double, nu double")
    got, cases = runs.read_runs(spark, f"file://{tmp_path}", params, manifest, {"U": "UMean", "p": "pMean"}, 10_000)
    rows = {(r.case_id, r.point_id): r for r in got.collect()}
    keep = [i for i in range(n) if i % 7 != 3]
    assert rows.keys() == {(c, i) for c in data for i in keep}
    told = {r.case_id: r for r in cases.collect()}
    assert told["run_1"].n_cells == len(keep) and told["run_2"].log10_re is None and list(told["run_1"].presence) == [True, True, False, False]
    centres = np.array([np.mean(t, 0) for t in cube((1.0, 1.0, 0.5), 2.0)])
    for (case, i), r in rows.items():
        u_ref, at = (2.0 if case == "run_1" else 4.0), points[grid[i][1]].mean(0) * int(case[-1])
        d = np.linalg.norm(at - centres, axis=1).min()
        assert np.allclose([r.x, r.y, r.z, r.wall_dist, r.cp], [*((at - [0.5, 0, 0]) / 2), d / 2, 2 * data[case]["pMean"][i] / u_ref**2])
        assert np.allclose([r.ux, r.uy, r.uz], data[case]["UMean"][i] / u_ref)
    with pytest.raises(CaseError, match="UPrime"):
        runs.read_runs(spark, str(tmp_path), params, manifest, {"U": "UMean", "p": "pMean", "R": "UPrime"})
    outward = {(r.case_id, r.face_id): r for r in runs.bodies(spark, f"file://{tmp_path}").collect()}
    assert len(outward) == 24
    for r in outward.values():
        a, b, c = (np.array([r[f"{x}{k}"] for x in "xyz"]) for k in range(3))
        assert np.cross(b - a, c - a) @ ((a + b + c) / 3 - [2.0, 2.0, 1.5]) > 0


def test_grids_to_be_predicted_and_predictions_written_back(spark, tmp_path):
    points, grid = box(3)
    (tmp_path / "new").mkdir()
    vtu_file(tmp_path / "new" / "mesh.vtu", points, grid, "base64", True)
    stl_file(tmp_path / "new" / "walls.stl", cube((1.0, 1.0, 0.0), 2.0))
    params = spark.createDataFrame([("new", 3.0, None)], "case_id string, u_ref double, l_ref double")
    got, frame = runs.read_volumes(spark, f"file://{tmp_path}", params, ground=0.0)
    f = frame.first()
    assert (round(f.ox, 9), round(f.oy, 9), f.oz, round(f.l_ref, 9)) == (2.0, 2.0, 0.0, 2.0) and got.count() == len(grid)
    assert sorted(round((r.cell_size * 2) ** 3, 6) for r in got.collect()) == sorted(round(c[3], 6) for c in grid)
    predicted = got.select("case_id", F.col("point_id").alias("cell_id"), (F.col("wall_dist") * 2).alias("k"))
    vtu.by_case(predicted).write.format("vtu").mode("append").option("out", "start.vtu").save(f"file://{tmp_path}")
    back = spark.read.format("vtu").option("pattern", "*/start.vtu").load(str(tmp_path))
    assert sorted((r.cell_id, r.k) for r in back.collect()) == sorted((r.cell_id, r.k) for r in predicted.collect())
